"""Queries over listings: normalised view, taxonomy, sizes, prices, terpenes, potency, fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark import adapters, oracles, rules
from shelfspark.catalog import query
from shelfspark.functions import products as P
from shelfspark.functions import text as X
from shelfspark.operators import guards
from shelfspark.operators.spread import spread

_LISTINGS, _PRODUCTS, _PROGRAMS = (f"({adapters.duckdb(n)})" for n in ("listings", "products", "programs"))
_ENRICHED = f"""SELECT *, {oracles.product_type('name', 'category', 'category_std')} AS product_type_std, {oracles.obtention('name', 'category')} AS obtention_std,
  CASE WHEN category_std IN ({', '.join(repr(c) for c in rules.WEIGHT_CATEGORIES)}) AND g >= 0.05 THEN g END AS size_g
  FROM (SELECT *, {oracles.category_std('category', 'name')} AS category_std, {oracles.grams('size_label')} AS g FROM {_PRODUCTS} p) q"""


def enrich(df: DataFrame) -> DataFrame:
    """Listings with category, kind, obtention, size and potency flag."""
    name, raw = F.col("name"), F.col("category")
    df = df.withColumn("category_std", P.category_std(raw, name))
    grams = P.size_to_grams(F.col("size_label"))
    return df.withColumns(
        {
            "product_type_std": P.product_type(name, raw, F.col("category_std")),
            "obtention_std": P.obtention(name, raw),
            "size_g": F.when(F.col("category_std").isin(rules.WEIGHT_CATEGORIES) & (grams >= 0.05), grams),
            "potency_implausible": P.potency_implausible(F.col("category_std"), F.col("thc"), F.col("cbd")),
        }
    )


def enriched_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich(adapters.read(spark, sf_dir, "products"))


def normalized(listings: DataFrame, programs: DataFrame) -> DataFrame:
    """The normalised view: price a gram, and the currency of the jurisdiction's country (US dollars where it isn't known)."""
    programs = programs.select(F.col("abbr").alias("state"), "country")
    per_g = F.when((F.col("size_g") > 0) & F.col("price").isNotNull(), F.round(F.col("price") / F.col("size_g"), 2))
    return listings.join(programs, "state", "left").withColumn("price_per_g", per_g).withColumn("currency", F.when(F.col("country") == "CA", "CAD").otherwise("USD"))


@query(f"""
SELECT category_std AS category, CASE WHEN country = 'CA' THEN 'CAD' ELSE 'USD' END AS currency, count(*) AS n, count(price_per_g) AS n_priced,
  round(avg(price_per_g), 4) AS avg_price_per_g, count(*) FILTER (WHERE category_std = 'Flower' AND obtention_std IS NULL) AS natural_flower,
  count(*) FILTER (WHERE strain_std IS NOT NULL AND NOT (platform = 'weedmaps' AND scraped_at < TIMESTAMP '1995-01-01')) AS trusted_lineage
FROM (SELECT e.*, b.country, {oracles.first(oracles.alnum('strain'), rules.STRAIN)} AS strain_std, CASE WHEN size_g > 0 AND price IS NOT NULL THEN round(price / size_g, 2) END AS price_per_g
  FROM ({_ENRICHED.replace(_PRODUCTS, _LISTINGS)}) e LEFT JOIN {_PROGRAMS} b ON b.abbr = e.state) v
WHERE platform IS DISTINCT FROM 'leafly' AND (category_std = 'Flower' AND thc > 0 AND thc < 5 AND (cbd IS NULL OR cbd < 1)) IS NOT TRUE
GROUP BY ALL""")
def products_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings by category and currency, without untrusted potencies."""
    # a product's derived columns depend on the product alone: derived once for each, then joined to its listings
    listings = adapters.read(spark, sf_dir, "listings")
    derived = enrich(listings.select("product_id", "name", "category", "size_label", "thc", "cbd").distinct())
    full = listings.join(derived.select("product_id", "category_std", "obtention_std", "size_g", "potency_implausible"), "product_id").withColumn("strain_type_std", P.strain_type(F.col("strain")))
    view = normalized(full, adapters.read(spark, sf_dir, "programs")).filter(guards.trusted_potency() & guards.plausible_potency())
    return view.groupBy(F.col("category_std").alias("category"), "currency").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("price_per_g").alias("n_priced"),
        F.round(F.avg("price_per_g"), 4).alias("avg_price_per_g"),
        F.count_if(guards.natural_flower("category_std")).alias("natural_flower"),
        F.count_if(guards.trusted_lineage("1995-01-01")).alias("trusted_lineage"),
    )


@query(f"SELECT product_id, {oracles.category_std('category', 'name')} AS category_std, {oracles.override('name', oracles.category_base('category'))} IS NOT NULL AS category_overridden FROM {_PRODUCTS} p")
def category_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = adapters.read(spark, sf_dir, "products")
    return df.select("product_id", P.category_std(F.col("category"), F.col("name")).alias("category_std"), P.category_overridden(F.col("category"), F.col("name")).alias("category_overridden"))


@query(f"SELECT product_id, product_type_std, {oracles.defaulted('name', 'category', 'category_std')} AS product_type_defaulted FROM ({_ENRICHED}) e")
def product_type_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = enriched_products(spark, sf_dir)
    return df.select("product_id", "product_type_std", P.product_type_defaulted(F.col("name"), F.col("category"), F.col("category_std")).alias("product_type_defaulted"))


@query(f"SELECT product_id, {oracles.first(oracles.alnum('strain'), rules.STRAIN)} AS strain_type_std, {oracles.obtention('name', 'category')} AS obtention_std FROM {_PRODUCTS} p")
def strain_and_obtention(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = adapters.read(spark, sf_dir, "products")
    return df.select("product_id", P.strain_type(F.col("strain")).alias("strain_type_std"), P.obtention(F.col("name"), F.col("category")).alias("obtention_std"))


@query(f"""SELECT product_id, g AS grams, CASE WHEN g > 0 THEN regexp_replace(regexp_replace(printf('%.4f', g), '0+$', ''), '\\.$', '') || 'g' END AS label
FROM (SELECT product_id, {oracles.grams('size_label')} AS g FROM {_PRODUCTS} p) q""")
def size_to_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = adapters.read(spark, sf_dir, "products").select("product_id", P.size_to_grams(F.col("size_label")).alias("grams"))
    return df.withColumn("label", P.grams_label(F.col("grams")))


@query(f"""
WITH v AS (SELECT product_id, category_std, option, price, sale, orig, {oracles.grams('option')} AS g FROM (
  SELECT product_id, category_std, unnest([size_label, '2g']) AS option, unnest([price, price * 2]) AS price,
    unnest([CASE WHEN product_id % 2 = 0 THEN price - 8 END, NULL]) AS sale, unnest([NULL, price * 4]) AS orig FROM ({_ENRICHED}) e) x
), w AS (SELECT *, least(price, sale) AS low, CASE WHEN category_std IN ('Concentrate', 'Flower', 'Pre-Roll', 'Vape') AND g >= 0.05 THEN g END AS size_g FROM v)
SELECT product_id, min(size_g) AS smallest, min(low) AS low, max(CASE WHEN sale < price AND price > low THEN greatest(price, CASE WHEN orig > low THEN orig END) WHEN orig > low THEN orig END) AS original,
  min(CASE WHEN size_g IS NOT NULL THEN round(low / size_g, 2) END) AS price_per_g FROM w GROUP BY product_id""")
def variant_pricing(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = enriched_products(spark, sf_dir)
    one = lambda option, price, sale, orig: F.struct(option.alias("option"), price.alias("price"), sale.cast("double").alias("sale_price"), orig.cast("double").alias("original_price"))
    first = one(F.col("size_label"), F.col("price").cast("double"), F.when(F.col("product_id") % 2 == 0, F.col("price") - 8), F.lit(None))
    second = one(F.lit("2g"), F.col("price").cast("double") * 2, F.lit(None), F.col("price") * 4)
    v = df.select("product_id", P.enrich_variants(F.array(first, second), F.col("category_std"), ["price", "sale_price", "original_price"]).alias("v"))
    least = lambda f: F.array_min(F.array_compact(F.transform("v", lambda x: x[f])))
    return v.select("product_id", P.smallest_size(F.col("v")).alias("smallest"), least("price").alias("low"), F.array_max(F.array_compact(F.transform("v", lambda x: x["original_price"]))).alias("original"), least("price_per_g").alias("price_per_g"))


_PANEL = "[('b_myrcene', v, '%'), ('Beta Myrcene', v / 4, NULL), ('alpha-pinene', cast(product_id % 60 AS DOUBLE) / 2, CASE WHEN product_id % 3 = 0 THEN 'mg/g' END), ('LIMONENE', cast(product_id % 9 AS DOUBLE) * w, '%'), ('unknown', 5.0, '%'), ('linalool', CASE WHEN product_id % 5 = 0 THEN -1.0 ELSE cast(product_id % 4 AS DOUBLE) END, '%')]"
_REPAIR = "CASE WHEN list_sum(list_transform({a}, lambda x: x.value)) <= 40 THEN {a} WHEN list_max(list_transform({a}, lambda x: x.value)) > list_sum(list_transform({a}, lambda x: x.value)) - list_max(list_transform({a}, lambda x: x.value)) THEN list_filter({a}, lambda x: x.value <> list_max(list_transform({a}, lambda y: y.value))) ELSE list_transform({a}, lambda x: {{'name': x.name, 'value': round(x.value / 10, 4)}}) END"


@query(f"""
WITH raw AS (SELECT product_id, unnest([
    {{'name': 'Myrcene', 'value': v}}, {{'name': 'Myrcene', 'value': v / 4}},
    {{'name': 'Pinene', 'value': CASE WHEN product_id % 3 = 0 THEN cast(product_id % 60 AS DOUBLE) / 20 ELSE cast(product_id % 60 AS DOUBLE) / 2 END}},
    {{'name': 'Limonene', 'value': cast(product_id % 9 AS DOUBLE) * w}},
    {{'name': 'Linalool', 'value': CASE WHEN product_id % 5 = 0 THEN -1.0 ELSE cast(product_id % 4 AS DOUBLE) END}}]) AS t
  FROM (SELECT p_partkey AS product_id, CASE WHEN p_partkey % 7 = 0 THEN 6000.0::DOUBLE ELSE cast(p_partkey % 8 AS DOUBLE) / 2 END AS v, CASE WHEN p_partkey % 11 = 0 THEN 10.0::DOUBLE ELSE 0.5::DOUBLE END AS w FROM part) x
), folded AS (SELECT product_id, t.name AS name, round(sum(t.value), 4) AS value FROM raw WHERE t.value >= 0 GROUP BY ALL),
a0 AS (SELECT product_id, list({{'name': name, 'value': value}} ORDER BY name) AS a FROM folded GROUP BY product_id),
a1 AS (SELECT product_id, a AS f, {_REPAIR.format(a='a')} AS a FROM a0), a2 AS (SELECT product_id, f, {_REPAIR.format(a='a')} AS a FROM a1),
a3 AS (SELECT product_id, f, {_REPAIR.format(a='a')} AS a FROM a2), a4 AS (SELECT product_id, f, {_REPAIR.format(a='a')} AS a FROM a3),
a5 AS (SELECT product_id, f, {_REPAIR.format(a='a')} AS a FROM a4), kept AS (SELECT product_id, f, a, list_filter(a, lambda x: x.value <= 30) AS k FROM a5),
done AS (SELECT product_id, f, a, CASE WHEN len(list_filter(k, lambda x: x.value <> 0)) > 0 THEN k END AS k FROM kept)
SELECT product_id, array_to_string(list_transform(k, lambda x: x.name || '=' || cast(cast(round(x.value * 10000) AS BIGINT) AS VARCHAR)), ',') AS profile, round(list_sum(list_transform(k, lambda x: x.value)), 4) AS total,
  k IS NOT NULL AND (f <> a OR len(k) <> len(a)) AS repaired, list_filter(k, lambda x: x.value = list_max(list_transform(k, lambda y: y.value)))[1].name AS dominant FROM done""")
def terpene_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spread(spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("k")), "k")
    v = F.when(F.col("k") % 7 == 0, 6000.0).otherwise((F.col("k") % 8).cast("double") / 2)
    w = F.when(F.col("k") % 11 == 0, 10.0).otherwise(0.5)
    one = lambda name, value, unit: F.struct(F.lit(name).alias("name"), value.cast("double").alias("value"), (unit if unit is not None else F.lit("%")).cast("string").alias("unit"))
    panel = F.array(
        one("b_myrcene", v, None), one("Beta Myrcene", v / 4, F.lit(None)), one("alpha-pinene", (F.col("k") % 60) / 2, F.when(F.col("k") % 3 == 0, "mg/g")),
        one("LIMONENE", (F.col("k") % 9) * w, None), one("unknown", F.lit(5.0), None), one("linalool", F.when(F.col("k") % 5 == 0, -1.0).otherwise((F.col("k") % 4).cast("double")), None),
    )
    df = P.fold_column(part.select(F.col("k").alias("product_id"), panel.alias("raw")), "raw", "t")
    text = F.array_join(F.transform("t_std", lambda x: F.concat(x["name"], F.lit("="), F.round(x["value"] * 10000).cast("bigint").cast("string"))), ",")
    return df.select("product_id", text.alias("profile"), F.col("t_total").alias("total"), F.col("t_repaired").alias("repaired"), P.dominant_terpene(F.col("t_std")).alias("dominant"))


@query(f"""SELECT product_id, category_std, coalesce(category_std = 'Flower' AND thc > 0 AND thc < 5 AND (cbd IS NULL OR cbd < 1), false) AS potency_implausible,
  (thc IS NOT NULL AND thc_mg IS NOT NULL) OR (cbd IS NOT NULL AND cbd_mg IS NOT NULL) AS unit_violation, thc > 100 AS above_percent FROM ({_ENRICHED}) e""")
def potency_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enriched_products(spark, sf_dir).select("product_id", "category_std", "potency_implausible", guards.unit_violation().alias("unit_violation"), (F.col("thc") > 100).alias("above_percent"))


@query(f"""SELECT product_id, CASE WHEN n <> '' THEN sha1(CASE WHEN thc_mg IS NOT NULL OR cbd_mg IS NOT NULL THEN b || '|thc_mg=' || {oracles.two_places('thc_mg')} || '|cbd_mg=' || {oracles.two_places('cbd_mg')} ELSE b END) END AS fingerprint
FROM (SELECT *, concat_ws('|', {oracles.brand_key("coalesce(brand, '')")}, n, CASE WHEN size_g IS NOT NULL THEN {oracles.two_places('size_g')} ELSE '' END, coalesce(product_type_std, '')) AS b
  FROM (SELECT *, trim(regexp_replace(lower(name), '\\s+', ' ', 'g')) AS n FROM ({_ENRICHED}) e) x) y""")
def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = enriched_products(spark, sf_dir)
    return df.select("product_id", X.fingerprint(*(F.col(c) for c in ("brand", "name", "size_g", "product_type_std", "thc_mg", "cbd_mg"))).alias("fingerprint"))


@query("""SELECT product_id, CASE WHEN price < 950 THEN 0 WHEN price >= 1200 THEN 51 ELSE cast(floor((price - 950) / 5) AS INTEGER) + 1 END AS bucket
FROM (SELECT p_partkey AS product_id, floor(p_retailprice) AS price FROM part) x""")
def width_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.select(F.col("p_partkey").alias("product_id"), F.width_bucket(F.floor("p_retailprice").cast("double"), F.lit(950.0), F.lit(1200.0), F.lit(50)).cast("int").alias("bucket"))
