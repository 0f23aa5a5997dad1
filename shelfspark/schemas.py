"""The tables' columns, declared once."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {"s": T.StringType(), "d": T.DoubleType(), "i": T.IntegerType(), "l": T.LongType(), "b": T.BooleanType(), "t": T.TimestampType(), "a": T.DateType(), "m": T.MapType(T.StringType(), T.DoubleType())}
_TERPENES = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("unit", T.StringType())]))
_VARIANTS = T.ArrayType(T.StructType([T.StructField("option", T.StringType()), *(T.StructField(f, T.DoubleType()) for f in ("price", "original_price", "size_g", "price_per_g"))]))


def _table(columns: str, **more: T.DataType) -> T.StructType:
    """"name:type" words; a type ending in "!" can't be null."""
    fields = []
    for word in columns.split():
        name, kind = word.split(":")
        fields.append(T.StructField(name, _TYPES[kind[0]], not kind.endswith("!")))
    return T.StructType([*fields, *(T.StructField(n, k) for n, k in more.items())])


TABLES: dict[str, T.StructType] = {
    "roster": _table("id:l! source:s! name:s address:s city:s state:s zip_code:s phone:s website:s latitude:d longitude:d"),
    "company_stores": _table("id:l! company_id:l! canonical_name:s! state:s! source:s! name:s address:s city:s zip_code:s phone:s website:s latitude:d longitude:d platform:s external_id:s store_url:s canonical_company_id:l storefront_name:s"),
    "listings": _table(
        "id:l! company_id:l! state:s! store_key:s! platform:s! external_id:s! source:s! external_product_id:s name:s brand:s category:s category_std:s category_overridden:b strain_type:s strain_type_std:s product_type_std:s "
        "product_type_defaulted:b obtention_std:s price:d size_g:d thc:d cbd:d thc_mg:d cbd_mg:d terp_total:d terpenes_repaired:b potency_implausible:b terpenes_std:m cannabinoids_std:m scraped_at:t", terpenes=_TERPENES, variants=_VARIANTS
    ),
    "products": _table("fingerprint:s! brand:s name:s category_std:s product_type_std:s obtention_std:s strain_type_std:s size_g:d first_seen:t last_seen:t"),
    "observations": _table("product_id:l! store_key:s! state:s! price:d thc:d cbd:d thc_mg:d cbd_mg:d terpenes_std:m terp_total:d cannabinoids_std:m scraped_at:t!"),
    "locations": _table("location_key:s! state:s! latitude:d longitude:d address:s city:s zip_code:s first_seen:t last_seen:t"),
    "location_observations": _table("location_key:s! source:s! operator:s storefront_name:s platform:s external_id:s address:s city:s observed_at:t!"),
    "lifecycle_events": _table("location_key:s! state:s! source:s! kind:s! occurred_on:a operator:s previous_operator:s confidence:s related_location_key:s derived_at:t"),
    "fx_rates": _table("rate_date:a! base_ccy:s! quote_ccy:s! rate:d! source:s! is_carried:b!"),
    "programs": _table("abbr:s! name:s! programs:s! country:s! best_url:s list_url:s list_type:s list_status:s"),
    "companies": _table("canonical_name:s! state:s! homepage:s"),
    "recon": _table("company_id:l! homepage:s platform:s confidence:s error:s updated_at:t"),
    "geocode_cache": _table("query:s! latitude:d longitude:d zip_code:s city:s"),
    "access_attempts": _table("target_type:s! target_key:s! method:s! cost_rank:i! status:s! resource_url:s params:s record_count:i error:s attempted_at:t! seq:l!"),
    "jobs": _table("id:l! task_type:s! target_key:s! payload:s status:s! attempts:i! max_attempts:i! claimed_by:s claimed_at:t scheduled_at:t! lease_until:t last_heartbeat:t created_at:t finished_at:t error:s"),
    "attestations": _table("subject_type:s! subject:s! predicate:s! object:s! source_type:s! source_ref:s! source_url:s quote:s confidence:s! retrieved_at:a! notes:s"),
    "heartbeats": _table("host:s! updated_at:t! detail:s"),
}


def empty(spark, name: str):
    return spark.createDataFrame([], TABLES[name])
