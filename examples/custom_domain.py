"""A domain of one's own: libraries instead of shops, with its own records, ladder, quality and table.

    python examples/custom_domain.py FOLDER
"""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.operators.access import AccessMethod, run_ladder
from shelfspark.workspace import Workspace

LIBRARIES = T.StructType([T.StructField("target_key", T.StringType()), T.StructField("name", T.StringType()), T.StructField("opens", T.StringType()), T.StructField("method", T.StringType())])


def from_register(towns: DataFrame) -> DataFrame:
    """A cheap source that knows names only, of every second town."""
    return towns.filter("population % 2 = 0").select("target_key", F.concat(F.lit("Library of "), "target_key").alias("name"), F.lit(None).cast("string").alias("opens"))


def from_site(towns: DataFrame) -> DataFrame:
    """A dear one that knows opening hours too."""
    return towns.select("target_key", F.concat("target_key", F.lit(" Public Library")).alias("name"), F.lit("9-17").alias("opens"))


METHODS = [AccessMethod("register", 0, from_register), AccessMethod("site", 5, from_site)]


def with_hours() -> Column:
    """What a result is worth: how many of its records have opening hours."""
    return F.count("opens")


def collect(spark: SparkSession, folder: str, towns: DataFrame, richest: bool = False) -> DataFrame:
    """The towns' libraries, by the cheapest method that finds one (or the richest), written as a table and read again."""
    records, _ = run_ladder(towns, METHODS, plausible=F.length("name") > 0, max_yield=richest, quality=with_hours)
    space = Workspace(spark, folder)
    space.replace("libraries", records.select(*LIBRARIES.names))
    return space.read("libraries", LIBRARIES)


if __name__ == "__main__":
    session = SparkSession.builder.master("local[2]").getOrCreate()
    collect(session, sys.argv[1], session.createDataFrame([("Ashford", 4), ("Bourne", 7)], "target_key string, population int")).show()
