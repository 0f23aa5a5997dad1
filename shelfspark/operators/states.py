"""Logs of attempts, jobs and requests reduced to the state they leave: deterministic folds, no wall clock."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

STATUSES = ("ok", "never", "unavailable", "failed", "blocked", "broken")


def severity(status: Column) -> Column:
    """Order of statuses, the worst first."""
    out = F.when(F.lit(False), F.lit(0))
    for k, s in enumerate(reversed(STATUSES)):
        out = out.when(status == s, k)
    return out.otherwise(len(STATUSES))


def host_of(url: Column) -> Column:
    return F.regexp_replace(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")), r"^www\.", "")


def fold_attempts(log: DataFrame, keys: tuple[str, ...] = ("target_type", "target_key", "method")) -> DataFrame:
    """The state of each method: the last attempt's status and count, the number of attempts, the last success and failure.

    The address is the last attempt's; a success without one keeps the address before it, a failure without one clears it.
    """
    order = F.struct("attempted_at", "seq")
    # the last attempt that set or cleared the address: any failure, or a success with one
    sets = (F.col("status") != "ok") | F.col("resource_url").isNotNull()
    return log.groupBy(*keys).agg(
        F.max_by("cost_rank", "seq").alias("cost_rank"),
        F.max_by("status", order).alias("status"),
        F.max_by(F.coalesce("record_count", F.lit(-1)), order).alias("record_count"),
        F.count(F.lit(1)).alias("attempts"),
        F.max(F.when(F.col("status") == "ok", F.col("attempted_at"))).alias("last_ok_at"),
        F.max(F.when(~F.col("status").isin("ok", "never"), F.col("attempted_at"))).alias("last_fail_at"),
        F.max_by("resource_url", F.when(sets, order)).alias("resource_url"),
    )


def winners(fold: DataFrame) -> DataFrame:
    """The cheapest working method of each target."""
    ok = fold.filter("status = 'ok'")
    return ok.groupBy("target_key").agg(F.min_by(F.struct("method", "cost_rank"), F.struct("cost_rank", "method")).alias("w")).select("target_key", "w.*")


def age_probability(age_days: Column, low: float = 25.0, high: float = 35.0, most: float = 0.6) -> Column:
    """The chance to walk the ladder again: none when fresh, rising to ``most``, certain when old."""
    return F.when(age_days < low, 0.0).when(age_days >= high, 1.0).otherwise(most * (age_days - low) / (high - low))


def _fold_in_order(df: DataFrame, key: str, order: list[str], result: str, begin: Callable, step: Callable) -> DataFrame:
    """``df`` (key, order..., more columns) with a boolean ``result`` of an ordered fold a key.

    ``step(state, row values)`` gives (state, answer). Rows are sorted within
    partitions and read as a stream: only the state of the key at hand is held,
    however many rows it has.
    """
    schema = T.StructType([*df.schema, T.StructField(result, T.BooleanType())])

    def run(batches):
        at, state = None, None
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            k, out = batch.schema.get_field_index(key), []
            for row in zip(*columns):
                if state is None or row[k] != at:
                    at, state = row[k], begin()
                state, yes = step(state, row)
                out.append(yes)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.bool_())], names=schema.names)

    return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def admit(walks: DataFrame, soft: int = 3, hard: int = 8, low: float = 25.0, high: float = 35.0, most: float = 0.6) -> DataFrame:
    """(host, seq, admitted) of walks (host, seq, age, u): ``u`` is the draw; a host's admitted walks lower the chance of its later ones."""

    def step(n: int, row: tuple) -> tuple[int, bool]:
        _, _, age, u = row
        chance = 0.0 if age is None or age < low else 1.0 if age >= high else most * (age - low) / (high - low)
        factor = 0.0 if n >= hard else 1.0 - (n - soft + 1) / (hard - soft + 1) if n >= soft else 1.0
        yes = u is not None and u < chance * factor
        return n + yes, yes

    return _fold_in_order(walks.select("host", "seq", "age", "u"), "host", ["seq"], "admitted", lambda: 0, step).select("host", "seq", "admitted")


def claimable(jobs: DataFrame, as_of: str, scope: str = "%") -> DataFrame:
    """Jobs a worker may claim, the lowest id first."""
    return jobs.filter((F.col("status") == "pending") & (F.col("scheduled_at") <= F.lit(as_of).cast("timestamp")) & F.col("target_key").like(scope))


def reap(jobs: DataFrame, as_of: str) -> DataFrame:
    """Claims whose lease has run out: pending again (a spread of 30 seconds), or failed at the limit of attempts."""
    now = F.lit(as_of).cast("timestamp")
    out = jobs.filter((F.col("status") == "claimed") & (F.coalesce("lease_until", "claimed_at") < now))
    again = F.col("attempts") < F.col("max_attempts")
    return out.select(
        "id", F.when(again, "pending").otherwise("failed").alias("status"), F.when(~again, "lease expired").alias("error"),
        F.when(again, F.timestamp_seconds(F.unix_seconds(now) + F.pmod(F.xxhash64("target_key"), F.lit(30)))).otherwise(F.col("scheduled_at")).alias("scheduled_at"),
    )


def _held(jobs: DataFrame, claims: DataFrame, *more: str) -> DataFrame:
    """``jobs`` with ``_c``: the row of ``claims`` (id, worker, more...) of a worker that still holds the job; null elsewhere."""
    own = claims.select("id", F.struct("worker", *more).alias("_c"))
    rows = jobs.join(own, "id", "left")
    holds = (F.col("status") == "claimed") & (F.col("claimed_by") == F.col("_c.worker"))
    return rows.withColumn("_c", F.when(holds, F.col("_c")))


def _set(rows: DataFrame, columns: dict[str, Column], order: list[str]) -> DataFrame:
    hit = F.col("_c").isNotNull()
    return rows.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in columns.items()}).select(*order)


def complete(jobs: DataFrame, results: DataFrame, as_of: str) -> DataFrame:
    """Jobs with ``results`` (id, worker, status, error) written to those that the worker still holds; a job that was handed on stays as it is."""
    return _set(_held(jobs, results, "status", "error"), {"status": F.col("_c.status"), "error": F.col("_c.error"), "finished_at": F.lit(as_of).cast("timestamp")}, jobs.columns)


def release(jobs: DataFrame, claims: DataFrame, as_of: str, delay_seconds: int = 300) -> DataFrame:
    """Jobs in which those that a worker of ``claims`` (id, worker) still holds are given back unworked: pending after a delay, the attempt undone."""
    at = F.timestamp_seconds(F.unix_seconds(F.lit(as_of).cast("timestamp")) + delay_seconds)
    none = {c: F.lit(None).cast(jobs.schema[c].dataType) for c in ("claimed_by", "claimed_at", "lease_until") if c in jobs.columns}
    return _set(_held(jobs, claims), {"status": F.lit("pending"), "attempts": F.greatest(F.col("attempts") - 1, F.lit(0)), "scheduled_at": at, **none}, jobs.columns)


def heartbeat(jobs: DataFrame, beats: DataFrame, as_of: str, lease_minutes: int = 30) -> DataFrame:
    """Jobs whose leases ``beats`` extend: of (id, worker) the job, of (worker) all that the worker holds; a job that it lost isn't brought back."""
    by = ["id"] if "id" in beats.columns else []
    own = beats.select(*by, F.col("worker").alias("claimed_by")).distinct().withColumn("_c", F.struct(F.lit(True)))
    rows = jobs.join(own, [*by, "claimed_by"], "left").withColumn("_c", F.when(F.col("status") == "claimed", F.col("_c")))
    now = F.lit(as_of).cast("timestamp")
    until = F.timestamp_seconds(F.unix_seconds(now) + 60 * lease_minutes)
    return _set(rows, {"last_heartbeat": now, "lease_until": until}, jobs.columns)


def prune_completed(jobs: DataFrame, as_of: str, older_than_hours: int = 168) -> DataFrame:
    """Jobs without those that finished before the window; pending and claimed ones stay, and so do finished ones of unknown time."""
    old = F.col("finished_at") < F.timestamp_seconds(F.unix_seconds(F.lit(as_of).cast("timestamp")) - 3600 * older_than_hours)
    return jobs.filter(~F.coalesce(F.col("status").isin("done", "failed") & old, F.lit(False)))


def live_claim_holders(jobs: DataFrame) -> DataFrame:
    """(task_type, target_key, claimed_by) of the targets that are being worked on."""
    return jobs.filter("status = 'claimed'").select("task_type", "target_key", "claimed_by")


def enqueue(jobs: DataFrame, new: DataFrame, as_of: str | None = None, spread_seconds: int | None = None) -> DataFrame:
    """(id, task_type, target_key) of new jobs, one of each target, whose target has no job pending or claimed; with ``as_of`` also ``scheduled_at``: that moment, or a place of the target's own within the spread after it."""
    live = jobs.filter(F.col("status").isin("pending", "claimed")).select("task_type", "target_key")
    fresh = new.groupBy("task_type", "target_key").agg(F.min("id").alias("id")).join(live, ["task_type", "target_key"], "left_anti").select("id", "task_type", "target_key")
    if as_of is None:
        return fresh
    offset = F.pmod(F.conv(F.substring(F.md5("target_key"), 1, 8), 16, 10).cast("long"), F.lit(spread_seconds)) if spread_seconds else F.lit(0)
    return fresh.withColumn("scheduled_at", F.timestamp_seconds(F.unix_seconds(F.lit(as_of).cast("timestamp")) + offset))


def token_bucket(requests: DataFrame, rate: float, burst: float) -> DataFrame:
    """requests (host, event_id, at, cost) with ``granted``: each host's bucket fills by ``rate`` a second up to ``burst``; a denied request takes nothing.

    A fold in order of time and id, read as a stream. A bucket that never fills
    (``rate`` not above 0) is a ValueError; a request that costs more than
    ``burst`` can never be granted.
    """
    if rate <= 0 or burst <= 0:
        raise ValueError(f"a bucket of rate {rate} and burst {burst} grants nothing")

    def step(s: tuple[float, float | None], row: tuple) -> tuple[tuple[float, float | None], bool]:
        tokens, last = s
        _, t, _, cost = row
        have = burst if last is None else min(burst, tokens + (t - last) * rate)
        if have >= cost:
            return (have - cost, t), True
        return (burst if last is None else tokens, t if last is None else last), False

    timed = requests.select("host", (F.unix_micros(F.col("at").cast("timestamp")) / 1e6).alias("t"), "event_id", F.col("cost").cast("double").alias("cost"))
    return _fold_in_order(timed, "host", ["t", "event_id"], "granted", lambda: (float(burst), None), step).select("host", "event_id", "granted")


def gate_summary(decisions: DataFrame, run: str = "run", worst: int = 3) -> DataFrame:
    """A row a run of decisions (run, host, granted, waited_s, failed): granted, shed and failed-open calls, seconds waited, and the hosts that shed most ("a×3, b×1"; ties by name)."""
    shed = ~F.col("granted") & ~F.coalesce("failed", F.lit(False))
    per = decisions.groupBy(run, "host").agg(F.count_if(F.col("granted") & ~F.coalesce("failed", F.lit(False))).alias("g"), F.count_if(shed).alias("s"), F.count_if("failed").alias("f"), F.sum("waited_s").alias("w"))
    top = F.slice(F.array_sort(F.collect_list(F.when(F.col("s") > 0, F.struct((-F.col("s")).alias("n"), F.col("host").alias("host"))))), 1, worst)
    return per.groupBy(run).agg(
        F.sum("g").alias("granted"), F.sum("s").alias("shed"), F.sum("f").alias("errors"), F.round(F.sum("w"), 1).alias("waited_s"),
        F.array_join(F.transform(top, lambda x: F.concat(x["host"], F.lit("×"), (-x["n"]).cast("string"))), ", ").alias("shed_by"),
    )


def rank_rows(df: DataFrame, partition: list[str], *order: Column, name: str = "rn") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*partition).orderBy(*order)))
