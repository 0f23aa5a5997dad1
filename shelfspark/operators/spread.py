"""Work dealt out to all cores."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` in as many tasks as there are shuffle partitions, four a core at least, by hash of ``keys``: for small rows of much work, which
    one file or a coalesced shuffle would leave to few tasks. The number is named, so that it isn't coalesced again."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)
