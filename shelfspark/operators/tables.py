"""Tables read and changed a column or a key at a time: readers, updates, deletes, guarded replacement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions import text as X
from shelfspark.operators import history


def update_columns(target: DataFrame, updates: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``target`` with ``columns`` of the rows that ``updates`` names by ``keys`` (once each) set to its values, null ones too; rows it doesn't name, and other columns, stay."""
    new = updates.select(*keys, F.struct(*columns).alias("_new"))
    hit = F.col("_new").isNotNull()
    return target.join(new, keys, "left").select(*[F.when(hit, F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in target.columns])


def clear_column(target: DataFrame, column: str, where: Column) -> DataFrame:
    """``target`` with nulls for ``column`` where a condition holds."""
    return target.withColumn(column, F.when(~F.coalesce(where, F.lit(False)), F.col(column)))


def delete_keys(target: DataFrame, keys: DataFrame) -> DataFrame:
    """``target`` without the rows whose key (the columns of ``keys``) is listed; a null in a key names no row."""
    return target.join(keys.distinct(), keys.columns, "left_anti")


def replace_keys(target: DataFrame, new: DataFrame, keys: DataFrame) -> DataFrame:
    """``target`` in which the rows of ``keys`` are those of ``new``, also if there are none of them now."""
    return delete_keys(target, keys).unionByName(new.join(keys.distinct(), keys.columns, "left_semi"), allowMissingColumns=True)


def replace_roster(stored: DataFrame, new: DataFrame, cache: DataFrame, state: str = "state") -> DataFrame:
    """A roster in which states with new records that have a name are replaced; a state of junk or nothing keeps its rows. What the geocoder knew comes back from its ``cache`` (query, latitude, longitude, zip_code, city)."""
    fine = new.filter(~X.is_placeholder(F.col("name")))
    query = X.geocode_query(*(F.col(c) for c in ("address", "city", state, "zip_code")))
    placed = history.restore_geocodes(fine.withColumn("query", query), cache).drop("query")
    return replace_keys(stored, placed.select(*stored.columns), fine.select(state))


def store_rows(stores: DataFrame, company_id: int, state: str) -> DataFrame:
    """A company's rows in a state."""
    own = ["canonical_name", "storefront_name", "address", "city", "zip_code", "latitude", "longitude", "platform", "external_id"]
    return stores.filter((F.col("company_id") == company_id) & (F.col("state") == state)).select(*[c for c in own if c in stores.columns])


def stores_for_dedupe(stores: DataFrame, state: str) -> DataFrame:
    """A state's stores by id, with what telling them apart needs."""
    return stores.filter(F.col("state") == state).select("id", "company_id", "canonical_name", "name", "address", "city", "zip_code", "latitude", "longitude", "platform", "external_id").orderBy("id")


def recon_companies(recon: DataFrame, companies: DataFrame, state: str | None = None) -> DataFrame:
    """Probed companies (of a state) by name, with "" for a missing homepage."""
    rows = recon.join(companies.select(F.col("id").alias("company_id"), "canonical_name", "state"), "company_id")
    rows = rows if state is None else rows.filter(F.col("state") == state)
    return rows.select("company_id", "state", "canonical_name", F.coalesce("homepage_url", F.lit("")).alias("homepage_url"), "platform").orderBy("canonical_name", "company_id")


def program_records(programs: DataFrame, urls: str = "all_gov_urls") -> DataFrame:
    """Programs by name, with defaults for what is missing: "" for words, "never" for the check, "US" for the country, no addresses for JSON that isn't a list."""
    default = {"program_term": "", "agency": "", "check_status": "never", "country": "US"}
    out = programs.withColumns({c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(v)) for c, v in default.items() if c in programs.columns})
    if urls in programs.columns:
        out = out.withColumn(urls, F.coalesce(F.from_json(urls, "array<string>"), F.array().cast("array<string>")))
    return out.orderBy("name")


def keyed(df: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of a list of keys."""
    return df.join(keys.distinct(), keys.columns, "left_semi")


def only(df: DataFrame, column: str, terms: str) -> DataFrame:
    """The rows whose ``column`` has one of the terms of a list with commas; all if it is blank."""
    return df.filter(X.in_scope(F.col(column), terms))
