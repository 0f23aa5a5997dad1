"""Ladders of access methods: replayed over captured attempts, or run rung by rung over whole tables of targets."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.operators.graph import once
from shelfspark.operators.guards import plausible_record


def successes(records: DataFrame, keys: list[str], min_records: int = 1, plausible: Column | None = None) -> DataFrame:
    """(keys, plausible, records, success): how many records of each key are plausible, and whether they are enough."""
    fine = plausible_record() if plausible is None else plausible
    n = records.groupBy(*keys).agg(F.count_if(F.coalesce(fine, F.lit(False))).alias("plausible"), F.count(F.lit(1)).alias("records"))
    return n.withColumn("success", F.col("plausible") >= min_records)


def hints(fold: DataFrame, params: str = "params") -> DataFrame:
    """(target_key, method, resource_url, params): where a method was last found, its parameters read from JSON; null for none or broken JSON."""
    return fold.select("target_key", "method", "resource_url", F.from_json(params, "map<string,string>", {"mode": "PERMISSIVE"}).alias("params"))


def ladder(targets: DataFrame, catalogue: DataFrame, fold: DataFrame, admitted: DataFrame | None = None) -> DataFrame:
    """(target_key, method, cost_rank, step): the order in which each target's methods are tried.

    The cheapest method that works (``fold``: target_key, method, status,
    cost_rank) goes first, then the others by cost; by cost alone where nothing
    works or what does isn't in the catalogue (method, cost_rank), where a
    cheaper one was never tried, and for targets that ``admitted`` (target_key)
    lists for a new walk.
    """
    known = fold.select("target_key", "method", "status", F.col("cost_rank").alias("won_rank"))
    rows = targets.select("target_key").distinct().crossJoin(catalogue.select("method", "cost_rank")).join(known, ["target_key", "method"], "left")
    again = admitted.select("target_key", F.lit(True).alias("again")).distinct() if admitted is not None else None
    rows = rows.join(again, "target_key", "left") if again is not None else rows.withColumn("again", F.lit(None).cast("boolean"))
    w = Window.partitionBy("target_key")
    # the winner is looked for among all that were ever tried, as it may have left the catalogue
    win = fold.filter("status = 'ok'").groupBy("target_key").agg(F.min(F.struct("cost_rank", "method")).alias("win"))
    rows = rows.join(win, "target_key", "left")
    here = F.max(F.coalesce(F.col("win.method") == F.col("method"), F.lit(False))).over(w)
    untried = F.max(F.coalesce((F.col("cost_rank") < F.col("win.cost_rank")) & F.col("status").isNull(), F.lit(False))).over(w)
    first = here & ~untried & F.col("again").isNull() & (F.col("win.method") == F.col("method"))
    rows = rows.withColumn("first", F.coalesce(first, F.lit(False)))
    order = Window.partitionBy("target_key").orderBy(F.desc("first"), "cost_rank", "method")
    return rows.select("target_key", "method", "cost_rank", F.row_number().over(order).alias("step"))


def replay(order: DataFrame, outcomes: DataFrame, min_records: int = 1, max_yield: bool = False) -> DataFrame:
    """What a walk of ``order`` (target_key, method, cost_rank, step) does, given what each method would find.

    ``outcomes`` has (target_key, method, outcome, plausible, quality): the
    reason why a method yields nothing (null if it answers; "crashed" counts as
    broken), how many of its records are plausible, and what they are worth. A
    walk ends at the first success; with ``max_yield`` it goes on to the end and
    the success of highest quality wins, the cheaper one on ties. Rows are the
    attempts to be recorded (target_key, method, step, status, won): a method
    that isn't ``unequipped``, up to the end of the walk.
    """
    rows = order.join(outcomes.select("target_key", "method", "outcome", "plausible", "quality", F.lit(True).alias("answers")), ["target_key", "method"], "left")
    ok = F.col("outcome").isNull() & (F.coalesce("plausible", F.lit(0)) >= min_records) & F.col("answers").isNotNull()
    status = F.when(F.col("outcome") == "crashed", "broken").when(F.col("outcome").isNotNull(), F.col("outcome")).when(ok, "ok").otherwise("failed")
    w = Window.partitionBy("target_key")
    rows = rows.withColumns({"status": status, "ok": ok})
    if max_yield:
        best = F.min(F.when(F.col("ok"), F.struct((-F.col("quality")).alias("q"), "cost_rank", "method"))).over(w)
        rows = rows.withColumn("won", F.coalesce(best["method"] == F.col("method"), F.lit(False)))
    else:
        end = F.min(F.when(F.col("ok"), F.col("step"))).over(w)
        rows = rows.withColumn("end", end).filter(F.col("end").isNull() | (F.col("step") <= F.col("end"))).withColumn("won", F.coalesce(F.col("step") == F.col("end"), F.lit(False)))
    return rows.filter("status != 'unequipped'").select("target_key", "method", "step", "status", "won")


@dataclass(frozen=True)
class AccessMethod:
    """A rung: ``run`` takes targets (target_key, ...) and gives the records it finds for them (target_key, ...)."""

    name: str
    cost_rank: int
    run: Callable[[DataFrame], DataFrame]


def run_ladder(targets: DataFrame, methods: list[AccessMethod], min_records: int = 1, plausible: Column | None = None, max_yield: bool = False, quality: Callable[[], Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """(winning records with ``method``, attempts (target_key, method, cost_rank, status, records)): each rung runs once, over all targets that no cheaper one satisfied.

    With ``max_yield`` every rung runs over every target, and of those that
    succeed the one of highest ``quality`` (an aggregate over its plausible
    records; their number by default) wins, ties going to the cheaper. Users
    give their own predicate and quality as columns. The lineage of what a rung
    left over is cut off in the shared folder.
    """
    fine = F.coalesce(plausible_record() if plausible is None else plausible, F.lit(False))
    left, found, tried = targets, [], []
    for m in sorted(methods, key=lambda m: (m.cost_rank, m.name)):
        records = m.run(left).withColumn("method", F.lit(m.name))
        value = (quality() if quality else F.count(F.lit(1))).alias("quality")
        per = records.groupBy("target_key").agg(F.count(F.lit(1)).alias("records"), F.count_if(fine).alias("plausible"))
        worth = records.filter(fine).groupBy("target_key").agg(value)
        tally = left.select("target_key").distinct().join(per, "target_key", "left").join(worth, "target_key", "left")
        ok = F.coalesce("plausible", F.lit(0)) >= min_records
        tally = once(tally.select("target_key", F.lit(m.name).alias("method"), F.lit(m.cost_rank).alias("cost_rank"), F.when(ok, "ok").otherwise("failed").alias("status"), F.coalesce("records", F.lit(0)).alias("records"), "quality"))
        tried.append(tally)
        found.append(records)
        if not max_yield:
            left = left.join(tally.filter("status = 'ok'"), "target_key", "left_anti")
    attempts = reduce(lambda a, b: a.unionByName(b), tried)
    best = attempts.filter("status = 'ok'").groupBy("target_key").agg(F.min_by("method", F.struct((-F.col("quality")).alias("q"), "cost_rank", "method") if max_yield else F.struct("cost_rank", "method")).alias("method"))
    records = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)
    return records.join(best, ["target_key", "method"], "left_semi"), attempts.drop("quality")
