"""Addresses placed by published address points, else on the segments of a road network."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions import places as G


def load_points(published: DataFrame, city_key: Column | str, house: str, lat: str, lng: str, street: str | None = None, split: tuple[str, str, str] | None = None, kinds: dict[str, str] | None = None, status: tuple[str, str] | None = None, ordinal: str = "ordinal") -> DataFrame:
    """(city_key, house_number, street_key, y, x, ordinal) of a city's published points: plain house numbers, rows of the right ``status`` (column, value), coordinates that are numbers and not zero; of a repeated address the first.

    The street is one column, ``street``, or ``split`` in name, kind and direction, ``kinds`` mapping the city's own words.
    """
    number = F.trim(F.col(house))
    rows = published.filter(number.rlike("^[0-9]+$"))
    if status:
        rows = rows.filter(F.upper(F.trim(F.col(status[0]))) == status[1].upper())
    if split:
        name, kind, direction = (F.upper(F.trim(F.coalesce(F.col(c), F.lit("")))) for c in split)
        for a, b in (kinds or {}).items():
            kind = F.when(F.upper(F.trim(F.col(split[1]))) == a.upper(), b.upper()).otherwise(kind)
        line = F.concat_ws(" ", number, F.nullif(name, F.lit("")), F.nullif(kind, F.lit("")), F.nullif(direction, F.lit("")))
    else:
        line = F.concat_ws(" ", number, F.nullif(F.trim(F.col(street)), F.lit("")))
    at, key = G.street_parts(line)
    city = F.lit(city_key) if isinstance(city_key, str) else city_key
    points = rows.select(city.alias("city_key"), at.alias("house_number"), key.alias("street_key"), F.col(lat).cast("string").try_cast("double").alias("y"), F.col(lng).cast("string").try_cast("double").alias("x"), F.col(ordinal).alias("ordinal"))
    fine = points.filter("street_key is not null and y != 0 and x != 0")
    first = fine.groupBy("city_key", "house_number", "street_key").agg(F.min_by(F.struct("y", "x", "ordinal"), "ordinal").alias("p"))
    return first.select("city_key", "house_number", "street_key", "p.*")


def covers(addresses: DataFrame, points: DataFrame) -> DataFrame:
    """``addresses`` (city_key, ...) with ``covered``: whether the city publishes points at all, so that a missing address is one that isn't there."""
    cities = points.select("city_key").distinct().withColumn("_c", F.lit(True))
    return addresses.join(cities, "city_key", "left").withColumn("covered", F.col("_c").isNotNull()).drop("_c")


def point_lookup(addresses: DataFrame, points: DataFrame) -> DataFrame:
    """addresses (id, city_key, house_number, street_key) with the first point of the same address; one written without a direction with the only point that has it but for that.

    An address whose direction doesn't match isn't placed.
    """
    first = points.groupBy("city_key", "house_number", "street_key").agg(F.min_by(F.struct("x", "y"), "ordinal").alias("p"))
    loose = F.regexp_extract("street_key", r"^(.*)\|[^|]*$", 1)
    only = first.withColumn("loose", loose).groupBy("city_key", "house_number", "loose").agg(F.count(F.lit(1)).alias("n"), F.first("p").alias("q")).filter("n = 1").drop("n")
    hit = addresses.withColumn("loose", loose).join(first, ["city_key", "house_number", "street_key"], "left").join(only, ["city_key", "house_number", "loose"], "left")
    q = F.when(F.col("street_key").endswith("|"), F.col("q"))
    p = F.coalesce("p", q)
    return hit.select("id", p["x"].alias("x"), p["y"].alias("y"), F.when(F.col("p").isNotNull(), "exact").when(p.isNotNull(), "no_direction").alias("how"))


def road_segments(roads: DataFrame) -> DataFrame:
    """(area, street_key, segment_id, lo_l, hi_l, lo_r, hi_r, pts) of a road network (segment_id, name, kind, direction, area_l, area_r, lo_l, hi_l, lo_r, hi_r as text, pts).

    Segments without a range or a shape are left out; a segment is filed under
    the areas of both its sides, once if they are one.
    """
    number = lambda c: F.when(F.trim(c).rlike("^[0-9]+$"), F.trim(c).try_cast("bigint"))
    _, key = G.street_parts(F.concat_ws(" ", F.lit("1"), *[F.nullif(F.trim(F.col(c)), F.lit("")) for c in ("name", "kind", "direction")]))
    rows = roads.select("segment_id", key.alias("street_key"), *[number(c).alias(c) for c in ("lo_l", "hi_l", "lo_r", "hi_r")], "pts", F.array_distinct(F.array_compact(F.array("area_l", "area_r"))).alias("areas"))
    fine = rows.filter("(lo_l is not null or lo_r is not null) and size(pts) > 0")
    return fine.select(F.explode("areas").alias("area"), "street_key", "segment_id", "lo_l", "hi_l", "lo_r", "hi_r", "pts")


def range_lookup(addresses: DataFrame, segments: DataFrame, by: tuple[str, ...] = ("street_key",)) -> DataFrame:
    """addresses (id, house_number, street_key, more of ``by``) with a point on the segment of the tightest range that holds the number, on its side."""
    slim = segments.select(*by, "segment_id", "lo_l", "hi_l", "lo_r", "hi_r")  # shapes are fetched for the segment that is chosen
    met = addresses.select("id", "house_number", *by).join(slim, list(by)).withColumn("side", G.side_range(F.col("house_number"), F.col("lo_l"), F.col("hi_l"), F.col("lo_r"), F.col("hi_r"))).filter("side is not null")
    lo = F.when(F.col("side") == "l", F.least("lo_l", "hi_l")).otherwise(F.least("lo_r", "hi_r"))
    hi = F.when(F.col("side") == "l", F.greatest("lo_l", "hi_l")).otherwise(F.greatest("lo_r", "hi_r"))
    met = met.withColumns({"lo": lo, "hi": hi})
    best = met.groupBy("id").agg(F.min_by(F.struct("lo", "hi", "side", "house_number", "segment_id", *by), F.struct((F.col("hi") - F.col("lo")).alias("w"), F.col("segment_id").alias("s"))).alias("b"))
    chosen = best.select("id", "b.*").join(segments.select(*by, "segment_id", "pts").dropDuplicates([*by, "segment_id"]), [*by, "segment_id"])
    share = F.when(F.col("hi") > F.col("lo"), (F.col("house_number") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.5)
    placed = chosen.select("id", "segment_id", "side", G.point_along(F.col("pts"), share, side=F.col("side")).alias("p"))
    return placed.select("id", "segment_id", "side", F.col("p.x").alias("x"), F.col("p.y").alias("y"), G.to_wgs84(F.col("p.x"), F.col("p.y")).alias("g")).select("id", "segment_id", "side", "x", "y", "g.latitude", "g.longitude")
