"""Facts with their sources, the fleet's signs of life, and what statutes say of licences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.operators import history

KEYS = ["subject_type", "subject", "predicate", "source_ref"]
REGIMES = ("limited", "open")


def upsert_attestations(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Facts by subject, predicate and source: two sources of one fact are two rows, a source that speaks again replaces what it said."""
    rest = [c for c in stored.columns if c not in KEYS]
    return history.upsert(stored, new, KEYS, dict.fromkeys(rest, "replace"))


def attestations_for(attestations: DataFrame, subjects: DataFrame, predicate: str | None = None) -> DataFrame:
    """Every fact about the ``subjects`` (subject_type, subject, in any case) with ``place``, from 1: the latest retrieved first, then by source. Nothing is settled between sources that disagree."""
    asked = subjects.select("subject_type", F.lower("subject").alias("_s")).distinct()
    rows = attestations.withColumn("_s", F.lower("subject")).join(asked, ["subject_type", "_s"], "left_semi")
    rows = rows if predicate is None else rows.filter(F.col("predicate") == predicate)
    w = Window.partitionBy("subject_type", "_s").orderBy(F.desc("retrieved_at"), "source_ref", "predicate")
    return rows.withColumn("place", F.row_number().over(w)).drop("_s")


def heartbeats(beats: DataFrame) -> DataFrame:
    """Each host's last row, the freshest first (ties by host)."""
    return history.latest(beats, ["host"], "updated_at", "updated_at").orderBy(F.desc("updated_at"), "host")


def regime(c: Column) -> Column:
    """A coded regime; null for anything else, "unchecked" included."""
    return F.when(c.isin(*REGIMES), c)


def regime_records(jurisdictions: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` (abbr) with the record of its jurisdiction, in any case: ``listed``, ``regime_std``, and whatever else is coded."""
    own = jurisdictions.withColumn("_k", F.upper("abbr")).drop("abbr")
    rows = asked.withColumn("_k", F.upper("abbr")).join(own.withColumn("_l", F.lit(True)), "_k", "left")
    return rows.withColumns({"listed": F.col("_l").isNotNull(), "regime_std": regime(F.col("regime"))}).drop("_k", "_l")


def coded(jurisdictions: DataFrame) -> DataFrame:
    return jurisdictions.filter(regime(F.col("regime")).isNotNull()).select(F.upper("abbr").alias("abbr"), "regime")


def unchecked(jurisdictions: DataFrame) -> DataFrame:
    """What is listed but not coded, by name."""
    return jurisdictions.filter(regime(F.col("regime")).isNull()).select(F.upper("abbr").alias("abbr")).orderBy("abbr")
