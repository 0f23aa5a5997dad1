"""Queries over what is written: observations of products and places, rates, rosters, queues, ladders, facts with their sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark import adapters, oracles
from shelfspark.catalog import query
from shelfspark.functions import text as X
from shelfspark.operators import access, evidence, tables
from shelfspark.operators import history as H
from shelfspark.operators import states as S
from shelfspark.plans.history import _FOLD
from shelfspark.plans.stores import _Q

_LISTINGS, _STORES, _PROGRAMS, _JOBS, _RATES, _ATTEMPTS, _OBS = (f"({adapters.duckdb(n)})" for n in ("listings", "stores", "programs", "jobs", "rates", "attempts", "observations"))
DAY, NOW = "2024-03-05", "2024-03-05 12:00:00"
KINDS = [*H.OBSERVED, "Other", "Accessory", ""]


def _cycle(k, values: list):
    """The value of a key in a list that is gone round."""
    return F.element_at(F.array(*[F.lit(v or None) for v in values]), (F.pmod(k, F.lit(len(values))) + 1).cast("int"))


def _cycle_sql(k: str, values: list) -> str:
    return f"CASE {k} % {len(values)} " + " ".join(f"WHEN {i} THEN {v!r}" if v else f"WHEN {i} THEN NULL" for i, v in enumerate(values)) + " END"


# products


def menu_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings as menus of three stores; terpenes are null, empty, or written in one order or the other."""
    k = F.pmod(F.col("product_id") + F.when(F.col("listing_id") % 7 == 0, 1).otherwise(0), F.lit(4))
    one, two = F.create_map(F.lit("a"), F.lit(1.0)), F.when(F.col("listing_id") % 2 == 0, F.create_map(F.lit("a"), F.lit(1.0), F.lit("b"), F.lit(2.0))).otherwise(F.create_map(F.lit("b"), F.lit(2.0), F.lit("a"), F.lit(1.0)))
    none = F.create_map().cast("map<string,double>")
    return adapters.read(spark, sf_dir, "listings").select(
        F.col("listing_id").alias("ordinal"), "product_id", F.concat(F.lit("M"), (F.col("company_id") % 3).cast("string")).alias("store_key"), "brand", "name",
        _cycle(F.col("product_id"), KINDS).alias("category_std"), _cycle(F.col("product_id"), ["Bud", "Gummies", ""]).alias("product_type_std"), F.lit(None).cast("string").alias("obtention_std"), F.lit(None).cast("string").alias("strain_type_std"),
        F.when(F.col("product_id") % 4 != 0, (F.col("product_id") % 4).cast("double") / 2).alias("size_g"), (F.col("price") + F.when(F.col("listing_id") % 5 == 0, 1.0).otherwise(0.0)).alias("price"), "thc", "cbd", "thc_mg", "cbd_mg",
        F.lit(None).cast("double").alias("terp_total"), F.when(k == 1, none).when(k == 2, one).when(k == 3, two).alias("terpenes_std"), F.when(F.col("product_id") % 2 == 0, none).alias("cannabinoids_std"),
    )


_MENU = f"""(SELECT ordinal, product_id, store_key, price, thc, cbd, thc_mg, cbd_mg, terp, brand_std, name, sha1(CASE WHEN thc_mg IS NOT NULL OR cbd_mg IS NOT NULL THEN b || '|thc_mg=' || {oracles.two_places('thc_mg')} || '|cbd_mg=' || {oracles.two_places('cbd_mg')} ELSE b END) AS fingerprint
FROM (SELECT *, {oracles.brand_key("coalesce(brand, '')")} AS brand_std, concat_ws('|', {oracles.brand_key("coalesce(brand, '')")}, trim(regexp_replace(lower(name), '\\s+', ' ', 'g')), CASE WHEN size_g IS NOT NULL THEN {oracles.two_places('size_g')} ELSE '' END, coalesce(kind, '')) AS b
  FROM (SELECT listing_id AS ordinal, product_id, 'M' || cast(company_id % 3 AS VARCHAR) AS store_key, brand, name, {_cycle_sql('product_id', KINDS)} AS category_std, {_cycle_sql('product_id', ['Bud', 'Gummies', ''])} AS kind,
    CASE WHEN product_id % 4 <> 0 THEN cast(product_id % 4 AS DOUBLE) / 2 END AS size_g, price + CASE WHEN listing_id % 5 = 0 THEN 1.0 ELSE 0.0 END AS price, thc, cbd, thc_mg, cbd_mg,
    CASE (product_id + CASE WHEN listing_id % 7 = 0 THEN 1 ELSE 0 END) % 4 WHEN 2 THEN 'a' WHEN 3 THEN 'ab' ELSE '' END AS terp FROM {_LISTINGS} l) x
  WHERE category_std IN ({', '.join(repr(c) for c in H.OBSERVED)}) AND length(trim(name)) > 0) y)"""
_OLD = f"(SELECT *, CASE WHEN product_id % 2 = 0 THEN DATE '{DAY}' ELSE DATE '{DAY}' - 1 END AS day FROM (SELECT *, row_number() OVER (PARTITION BY store_key, fingerprint ORDER BY ordinal DESC) AS rn FROM {_MENU} m WHERE ordinal % 2 = 0) z WHERE rn = 1)"
_NEW = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY store_key, fingerprint ORDER BY ordinal DESC) AS rn FROM {_MENU} m WHERE ordinal % 2 = 1) z WHERE rn = 1)"


@query(f"""SELECT n.store_key, n.fingerprint, n.ordinal FROM {_NEW} n LEFT JOIN {_OLD} o ON o.store_key = n.store_key AND o.fingerprint = n.fingerprint
WHERE o.ordinal IS NULL OR o.day <> DATE '{DAY}' OR o.price IS DISTINCT FROM n.price OR o.thc IS DISTINCT FROM n.thc OR o.cbd IS DISTINCT FROM n.cbd OR o.terp <> n.terp""")
def observation_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of a menu's products is appended to their history: new ones, the day's first, changed ones; maps are equal whatever their order, and empty ones are nulls."""
    menu = menu_records(spark, sf_dir)
    old = H.observed(menu.filter("ordinal % 2 = 0"))
    at = F.when(F.col("product_id") % 2 == 0, F.lit(f"{DAY} 00:30:00")).otherwise(F.lit("2024-03-04 12:00:00")).cast("timestamp")
    return H.record_observations(old.withColumn("scraped_at", at), menu.filter("ordinal % 2 = 1"), NOW).select("store_key", "fingerprint", "ordinal")


@query(f"""SELECT coalesce(o.fingerprint, n.fingerprint) AS fingerprint, coalesce(o.name, n.name) AS name, coalesce(o.brand, n.brand) AS brand, CASE WHEN o.fingerprint IS NULL THEN TIMESTAMP '{NOW}' ELSE TIMESTAMP '2024-03-01' END AS first_seen,
  CASE WHEN n.fingerprint IS NULL THEN TIMESTAMP '2024-03-01' ELSE TIMESTAMP '{NOW}' END AS last_seen
FROM (SELECT fingerprint, min(name) AS name, min(brand_std) AS brand FROM {_OLD} x GROUP BY 1) o FULL JOIN (SELECT fingerprint, max_by(name, (store_key, ordinal)) AS name, min(brand_std) AS brand FROM {_NEW} y GROUP BY 1) n ON n.fingerprint = o.fingerprint""")
def observed_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities of products after a menu: what is known stays, last_seen moves on."""
    menu = menu_records(spark, sf_dir)
    day = F.lit("2024-03-01").cast("timestamp")
    own = ["category_std", "product_type_std", "obtention_std", "strain_type_std", "size_g"]
    known = H.observed(menu.filter("ordinal % 2 = 0")).groupBy("fingerprint").agg(F.min(X.brand_key(F.coalesce("brand", F.lit("")))).alias("brand"), F.min("name").alias("name"), *[F.min(c).alias(c) for c in own])
    return H.observed_products(known.withColumns({"first_seen": day, "last_seen": day}), H.observed(menu.filter("ordinal % 2 = 1")), NOW).select("fingerprint", "name", "brand", "first_seen", "last_seen")


# places


@query(f"""SELECT n.id FROM (SELECT * FROM {_STORES} s WHERE id % 3 = 0) n LEFT JOIN (SELECT id, CASE WHEN id % 5 = 0 THEN 'Other' ELSE canonical_name END AS operator, CASE WHEN id % 7 = 0 THEN DATE '{DAY}' - 1 ELSE DATE '{DAY}' END AS day FROM {_STORES} t WHERE id % 2 = 0) o ON o.id = n.id
WHERE o.id IS NULL OR o.day <> DATE '{DAY}' OR o.operator IS DISTINCT FROM n.canonical_name""")
def location_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of a capture of places is appended to their history."""
    s = adapters.read(spark, sf_dir, "stores").select("id", F.concat(F.lit("K"), F.col("id").cast("string")).alias("location_key"), F.col("canonical_name").alias("operator"), F.col("name").alias("storefront_name"), "platform", "external_id", "address", "city")
    at = F.when(F.col("id") % 7 == 0, "2024-03-04 10:00:00").otherwise(f"{DAY} 08:00:00").cast("timestamp")
    stored = s.filter("id % 2 = 0").withColumns({"operator": F.when(F.col("id") % 5 == 0, "Other").otherwise(F.col("operator")), "source": F.lit("site"), "observed_at": at})
    return H.record_locations(stored, s.filter("id % 3 = 0"), "site", NOW).select("id")


@query(f"""SELECT coalesce(n.location_key, o.location_key) AS location_key, CASE WHEN n.location_key IS NULL THEN o.city ELSE n.city END AS city, CASE WHEN o.location_key IS NULL THEN TIMESTAMP '{NOW}' ELSE TIMESTAMP '2024-03-01' END AS first_seen, CASE WHEN n.location_key IS NULL THEN TIMESTAMP '2024-03-01' ELSE TIMESTAMP '{NOW}' END AS last_seen
FROM (SELECT 'K' || id AS location_key, city FROM {_STORES} s WHERE id % 3 = 0) n FULL JOIN (SELECT 'K' || id AS location_key, 'Old' AS city FROM {_STORES} s WHERE id % 2 = 0) o ON o.location_key = n.location_key""")
def location_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities of places after a capture: attributes follow it, also to null; first_seen stays."""
    s = adapters.read(spark, sf_dir, "stores").select("id", F.concat(F.lit("K"), F.col("id").cast("string")).alias("location_key"), "state", "latitude", "longitude", "address", "city", "zip_code")
    day = F.lit("2024-03-01").cast("timestamp")
    old = s.filter("id % 2 = 0").withColumns({"city": F.lit("Old"), "first_seen": day, "last_seen": day}).drop("id")
    return H.upsert_locations(old, s.filter("id % 3 = 0"), NOW).select("location_key", "city", "first_seen", "last_seen")


@query(f"""WITH loc AS (SELECT id, CASE WHEN latitude IS NOT NULL AND id % 2 = 0 THEN '@' || id ELSE 'A' || id END AS location_key, 'addr' || cast(id % 40 AS VARCHAR) AS address_key FROM {_STORES} s),
geo AS (SELECT address_key, min(location_key) AS g FROM loc WHERE starts_with(location_key, '@') GROUP BY 1 HAVING count(DISTINCT location_key) = 1)
SELECT id, CASE WHEN starts_with(location_key, '@') THEN location_key ELSE coalesce(g, location_key) END AS folded FROM loc LEFT JOIN geo USING (address_key)""".replace("id % 40", "id % 97"))
def location_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places known by address folded into the only one known by coordinates that has it."""
    key = F.when(F.col("latitude").isNotNull() & (F.col("id") % 2 == 0), F.concat(F.lit("@"), F.col("id").cast("string"))).otherwise(F.concat(F.lit("A"), F.col("id").cast("string")))
    s = adapters.read(spark, sf_dir, "stores").select("id", key.alias("location_key"), F.concat(F.lit("addr"), (F.col("id") % 97).cast("string")).alias("address_key"))
    return H.fold_locations(s).select("id", "folded")


_EVENTS = f"(SELECT source, 'L' || id AS loc, CASE WHEN id % 2 = 0 THEN 'closed' ELSE 'opened' END AS kind, DATE '2024-01-01' + cast(id % 90 AS INTEGER) AS occurred_on, 'Op' || cast(company_id % 20 AS VARCHAR) AS operator, city FROM {_STORES} s)"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.read(spark, sf_dir, "stores").select(
        "source", F.concat(F.lit("L"), F.col("id").cast("string")).alias("loc"), F.when(F.col("id") % 2 == 0, "closed").otherwise("opened").alias("kind"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 90).cast("int")).alias("occurred_on"),
        F.concat(F.lit("Op"), (F.col("company_id") % 20).cast("string")).alias("operator"), F.when(F.col("id") % 3 == 0, F.upper("city")).otherwise(F.col("city")).alias("city"),
    )


@query(f"""SELECT o.source, o.loc, c.loc AS from_loc, o.occurred_on FROM {_EVENTS} o JOIN {_EVENTS} c ON o.kind = 'opened' AND c.kind = 'closed' AND o.source = c.source AND o.operator = c.operator AND lower(trim(o.city)) = lower(trim(c.city)) AND o.occurred_on >= c.occurred_on""")
def relocation_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Openings that may be a store that closed elsewhere in the town."""
    return H.relocations(_events(spark, sf_dir))


@query(f"""SELECT source, loc, kind, CASE WHEN (SELECT count(*) FROM (SELECT DISTINCT source, occurred_on AS day FROM {_EVENTS} e WHERE occurred_on < DATE '2024-03-01') c WHERE c.source = e.source AND c.day > e.occurred_on) >= 3 THEN 'high' ELSE 'low' END AS confidence FROM {_EVENTS} e""")
def lifecycle_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How sure an opening or closing is: by the usable cycles that come after it."""
    e = _events(spark, sf_dir)
    return H.confidence(e, e.filter("occurred_on < date'2024-03-01'").select("source", F.col("occurred_on").alias("day"))).select("source", "loc", "kind", "confidence")


# rates

TODAY = "2024-02-05"


@query(f"""WITH d AS (SELECT cast(unnest(generate_series(min(rate_date), DATE '{TODAY}', INTERVAL 1 DAY)) AS DATE) AS rate_date FROM {_RATES} r)
SELECT rate_date, base_ccy, quote_ccy, rate, is_carried FROM (SELECT rate_date, 'CAD' AS base_ccy, 'USD' AS quote_ccy, round(last_value(r.rate IGNORE NULLS) OVER (ORDER BY rate_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS rate, r.rate IS NULL AS is_carried FROM d LEFT JOIN (SELECT * FROM {_RATES} q WHERE rate_date <= DATE '{TODAY}') r USING (rate_date)) x
UNION ALL SELECT DATE '1990-01-01', 'CAD', 'USD', 0.5::DOUBLE, false""")
def fx_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored rates after a refresh from the first priced day to today; what is stored beyond that stays."""
    fetched = adapters.read(spark, sf_dir, "rates")
    old = spark.sql("select date'1990-01-01' as rate_date, 'CAD' as base_ccy, 'USD' as quote_ccy, 0.5d as rate, false as is_carried")
    stored = fetched.filter(f"day(rate_date) % 2 = 0 and rate_date <= date'{TODAY}'").select("rate_date", "base_ccy", "quote_ccy", F.lit(9.9).alias("rate"), F.lit(True).alias("is_carried")).unionByName(old)
    return H.refresh_rates(stored, fetched, adapters.read(spark, sf_dir, "listings"), adapters.read(spark, sf_dir, "observations"), adapters.read(spark, sf_dir, "programs"), TODAY)


@query(f"SELECT base_ccy, quote_ccy, max(rate_date) AS rate_date, max_by(rate, rate_date) AS rate FROM {_RATES} r GROUP BY ALL")
def fx_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.latest_rate(adapters.read(spark, sf_dir, "rates"))


# tables


@query("""SELECT s_suppkey AS company_id, n_name AS state, 'Shop ' || cast(s_suppkey % 97 AS VARCHAR) AS canonical_name, CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE 'https://s' || s_suppkey || '.example.com' END AS homepage_url, CASE WHEN s_suppkey % 2 = 0 THEN 'jane' END AS platform
FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_suppkey % 3 <> 0""")
def recon_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probed companies, a missing homepage being ""."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").join(spark.read.parquet(f"{sf_dir}/nation.parquet"), F.col("s_nationkey") == F.col("n_nationkey"))
    companies = s.select(F.col("s_suppkey").alias("id"), F.concat(F.lit("Shop "), (F.col("s_suppkey") % 97).cast("string")).alias("canonical_name"), F.col("n_name").alias("state"))
    url = F.when(F.col("s_suppkey") % 5 != 0, F.concat(F.lit("https://s"), F.col("s_suppkey").cast("string"), F.lit(".example.com")))
    recon = s.filter("s_suppkey % 3 != 0").select(F.col("s_suppkey").alias("company_id"), url.alias("homepage_url"), F.when(F.col("s_suppkey") % 2 == 0, "jane").alias("platform"))
    return tables.recon_companies(recon, companies)


@query("""SELECT n_name AS abbr, n_name AS name, CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE 'adult use' END AS program_term, CASE WHEN n_nationkey % 4 = 0 THEN 'never' ELSE 'ok' END AS check_status, CASE WHEN n_nationkey % 2 = 0 THEN 'US' ELSE 'CA' END AS country, CASE n_nationkey % 5 WHEN 0 THEN 2 ELSE 0 END AS n_urls FROM nation""")
def program_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Programs with defaults for what is missing; addresses that aren't a JSON list are none."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    k = F.col("n_nationkey")
    rows = n.select(
        F.col("n_name").alias("abbr"), F.col("n_name").alias("name"), F.when(k % 3 != 0, "adult use").alias("program_term"), F.when(k % 4 != 0, "ok").alias("check_status"), F.when(k % 2 != 0, "CA").alias("country"),
        F.when(k % 5 == 0, '["https://a.gov/x", "https://b.gov"]').when(k % 5 == 1, "[broken").when(k % 5 == 2, "").alias("all_gov_urls"),
    )
    return tables.program_records(rows).withColumn("n_urls", F.size("all_gov_urls")).drop("all_gov_urls")


@query(f"SELECT id, CASE WHEN id % 10 = 0 THEN CASE WHEN id % 20 = 0 THEN NULL ELSE 5.5 END ELSE latitude END AS latitude, CASE WHEN id % 10 = 0 THEN 'New' ELSE city END AS city, CASE WHEN state = 'NATION_1' OR state = 'CANADA' THEN NULL ELSE canonical_company_id END AS canonical_company_id FROM {_STORES} s")
def column_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores with some columns of some rows set, nulls too, and one column cleared for a state."""
    s = adapters.read(spark, sf_dir, "stores").select("id", "state", "latitude", "city", "canonical_company_id")
    new = s.filter("id % 10 = 0").select("id", F.when(F.col("id") % 20 != 0, 5.5).alias("latitude"), F.lit("New").alias("city"))
    return tables.clear_column(tables.update_columns(s, new, ["id"], ["latitude", "city"]), "canonical_company_id", F.col("state").isin("NATION_1", "CANADA")).drop("state")


_JUNK = "CASE WHEN n.n_nationkey % 3 = 0 THEN 'Test shop' ELSE s.name END"


@query(f"""WITH n AS (SELECT s.id, {_JUNK} AS name, s.state, s.latitude, s.city, {_Q} AS q FROM {_STORES} s JOIN nation n ON n.n_name = s.state WHERE s.id % 2 = 1),
fine AS (SELECT * FROM n WHERE name <> 'Test shop' AND length(trim(name)) > 0), c AS (SELECT {_Q} AS q, min(id) AS i FROM {_STORES} s WHERE id % 4 = 1 GROUP BY 1)
SELECT id, state, latitude, city FROM {_STORES} s WHERE id % 2 = 0 AND state NOT IN (SELECT state FROM fine)
UNION ALL SELECT id, state, CASE WHEN latitude IS NULL AND i IS NOT NULL THEN 1.5 ELSE latitude END, CASE WHEN city IS NULL AND i IS NOT NULL THEN 'Cached' ELSE city END FROM fine LEFT JOIN c ON c.q = fine.q""")
def roster_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A roster replaced state by state: a state of junk only keeps its rows, and what was geocoded comes back."""
    s = adapters.read(spark, sf_dir, "stores")
    junk = spark.read.parquet(f"{sf_dir}/nation.parquet").filter("n_nationkey % 3 = 0").select(F.col("n_name").alias("state"), F.lit(True).alias("junk"))
    own = ["id", "name", "state", "address", "city", "zip_code", "latitude", "longitude"]
    new = s.filter("id % 2 = 1").join(junk, "state", "left").withColumn("name", F.when(F.col("junk"), "Test shop").otherwise(F.col("name"))).select(*own)
    cache = s.filter("id % 4 = 1").select(X.geocode_query(*(F.col(c) for c in ("address", "city", "state", "zip_code"))).alias("query")).distinct().select("query", F.lit(1.5).alias("latitude"), F.lit(2.5).alias("longitude"), F.lit("99999").alias("zip_code"), F.lit("Cached").alias("city"))
    return tables.replace_roster(s.filter("id % 2 = 0").select(*own), new, cache).select("id", "state", "latitude", "city")


@query(f"SELECT id, state FROM {_STORES} s WHERE NOT (state IN (SELECT n_name FROM nation WHERE n_nationkey % 4 = 0) AND company_id % 2 = 0)")
def state_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores without some companies' rows in some states."""
    s = adapters.read(spark, sf_dir, "stores").select("id", "state", "company_id")
    states = spark.read.parquet(f"{sf_dir}/nation.parquet").filter("n_nationkey % 4 = 0").select(F.col("n_name").alias("state"))
    return tables.delete_keys(s, s.filter("company_id % 2 = 0").join(states, "state", "left_semi").select("state", "company_id")).drop("company_id")


@query(f"SELECT id, platform FROM {_STORES} s WHERE id IN (SELECT c_custkey FROM customer WHERE c_custkey % 7 = 0)")
def keyed_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of a list of keys, some of them twice and some nowhere."""
    keys = spark.range(0, 10**6, 7).union(spark.range(0, 700, 7))
    return tables.keyed(adapters.read(spark, sf_dir, "stores").select("id", "platform"), keys)


@query(f"SELECT id, canonical_name, name, address, city, zip_code, latitude, longitude, platform, external_id, company_id FROM {_STORES} s WHERE state = (SELECT min(n_name) FROM nation)")
def dedupe_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A state's stores, with what telling them apart needs."""
    state = spark.read.parquet(f"{sf_dir}/nation.parquet").agg(F.min("n_name")).first()[0]
    return tables.stores_for_dedupe(adapters.read(spark, sf_dir, "stores"), state)


@query(f"SELECT canonical_name, address, city, zip_code, latitude, longitude, platform, external_id FROM {_STORES} s WHERE company_id = 5 AND state = (SELECT min(state) FROM {_STORES} t WHERE company_id = 5)")
def company_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A company's rows in a state."""
    stores = adapters.read(spark, sf_dir, "stores")
    return tables.store_rows(stores, 5, stores.filter("company_id = 5").agg(F.min("state")).first()[0])


@query(f"SELECT source, loc, kind FROM {_EVENTS} e WHERE kind = 'closed' AND source <> 'own' UNION ALL SELECT source, loc, 'opened' FROM {_EVENTS} f WHERE kind = 'opened' AND source = 'own'")
def lifecycle_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of some sources replaced by new ones, also where there are none now."""
    e = _events(spark, sf_dir).select("source", "loc", "kind")
    return tables.replace_keys(e.filter("kind = 'closed'"), e.filter("kind = 'opened' and source != 'menu'"), spark.createDataFrame([("own",)], "source string"))


@query(f"SELECT id, state FROM {_STORES} s WHERE contains(lower(state), 'nation_1') OR contains(lower(state), 'an')")
def scope_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.only(adapters.read(spark, sf_dir, "stores").select("id", "state"), "state", " NATION_1, an ,,")


# queues

_J = f"(SELECT *, CASE WHEN status = 'claimed' THEN 'w' || cast(id % 4 AS VARCHAR) END AS claimed_by, CASE WHEN status = 'done' AND id % 9 <> 0 THEN scheduled_at END AS finished_at FROM {_JOBS} j)"


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = {"claimed_by": F.when(F.col("status") == "claimed", F.concat(F.lit("w"), (F.col("id") % 4).cast("string"))), "finished_at": F.when((F.col("status") == "done") & (F.col("id") % 9 != 0), F.col("scheduled_at").cast("timestamp"))}
    none = {"error": F.lit(None).cast("string"), "last_heartbeat": F.lit(None).cast("timestamp")}
    return adapters.read(spark, sf_dir, "jobs").withColumns({**own, **none, **{c: F.col(c).cast("timestamp") for c in ("scheduled_at", "claimed_at", "lease_until")}})


@query(f"SELECT id, CASE WHEN hit THEN 'failed' ELSE status END AS status, CASE WHEN hit THEN 'why' END AS error, CASE WHEN hit THEN TIMESTAMP '{NOW}' ELSE finished_at END AS finished_at FROM (SELECT *, status = 'claimed' AND id % 2 = 0 AND claimed_by = 'w2' AS hit FROM {_J} k) x")
def queue_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results written by the workers that still hold their jobs."""
    j = _jobs(spark, sf_dir)
    results = j.filter("id % 2 = 0").select("id", F.lit("w2").alias("worker"), F.lit("failed").alias("status"), F.lit("why").alias("error"))
    return S.complete(j, results, NOW).select("id", "status", "error", "finished_at")


@query(f"SELECT id, CASE WHEN hit THEN 'pending' ELSE status END AS status, CASE WHEN hit THEN greatest(attempts - 1, 0) ELSE attempts END AS attempts, CASE WHEN hit THEN NULL ELSE claimed_by END AS claimed_by, CASE WHEN hit THEN TIMESTAMP '{NOW}' + INTERVAL 300 SECOND ELSE scheduled_at END AS scheduled_at FROM (SELECT *, status = 'claimed' AND claimed_by IN ('w1', 'w3') AND id % 3 = 0 AS hit FROM {_J} k) x")
def queue_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims given back unworked by those that hold them."""
    j = _jobs(spark, sf_dir)
    claims = j.filter("id % 3 = 0").select("id", F.when(F.col("id") % 4 == 0, "w9").otherwise(F.concat(F.lit("w"), (F.col("id") % 4).cast("string"))).alias("worker")).filter("worker != 'w2'")
    return S.release(j, claims, NOW).select("id", "status", "attempts", "claimed_by", "scheduled_at")


@query(f"SELECT id, CASE WHEN hit THEN TIMESTAMP '{NOW}' END AS last_heartbeat, CASE WHEN hit THEN TIMESTAMP '{NOW}' + INTERVAL 30 MINUTE ELSE lease_until END AS lease_until FROM (SELECT *, coalesce(status = 'claimed' AND claimed_by IN ('w1', 'w3'), false) AS hit FROM {_J} k) x")
def queue_heartbeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leases of all claims that two workers hold, extended."""
    return S.heartbeat(_jobs(spark, sf_dir), spark.createDataFrame([("w1",), ("w3",), ("w1",)], "worker string"), NOW).select("id", "last_heartbeat", "lease_until")


@query(f"SELECT id, status FROM {_J} k WHERE NOT (status IN ('done', 'failed') AND finished_at IS NOT NULL AND finished_at < TIMESTAMP '1996-01-01' - INTERVAL 168 HOUR)")
def queue_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs without those that finished a week ago."""
    return S.prune_completed(_jobs(spark, sf_dir), "1996-01-01").select("id", "status")


@query(f"SELECT task_type, target_key, claimed_by FROM {_J} k WHERE status = 'claimed'")
def queue_holders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.live_claim_holders(_jobs(spark, sf_dir))


@query(f"""SELECT min(id) AS id, task_type, target_key, TIMESTAMP '{NOW}' + to_seconds(cast(('0x' || left(md5(target_key), 8)) AS BIGINT) % 600) AS scheduled_at FROM {_JOBS} j WHERE id % 2 = 1 AND (task_type, target_key) NOT IN (SELECT task_type, target_key FROM {_JOBS} k WHERE id % 2 = 0 AND status IN ('pending', 'claimed')) GROUP BY task_type, target_key""")
def queue_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New jobs, each at a place of its target's own within ten minutes."""
    j = adapters.read(spark, sf_dir, "jobs")
    return S.enqueue(j.filter("id % 2 = 0"), j.filter("id % 2 = 1"), NOW, 600)


@query("""WITH d AS (SELECT user_id % 5 AS run, 'h' || cast(user_id % 11 AS VARCHAR) AS host, event_id % 3 <> 0 AS granted, cast(event_id % 10 AS DOUBLE) / 10 AS w, event_id % 50 = 0 AS failed FROM events),
per AS (SELECT run, host, count(*) FILTER (WHERE NOT granted AND NOT failed) AS s FROM d GROUP BY ALL), top AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY s DESC, host) AS rn FROM per WHERE s > 0)
SELECT run, count(*) FILTER (WHERE granted AND NOT failed) AS granted, count(*) FILTER (WHERE NOT granted AND NOT failed) AS shed, count(*) FILTER (WHERE failed) AS errors, round(sum(w), 1) AS waited_s,
  coalesce((SELECT string_agg(host || '×' || s, ', ' ORDER BY rn) FROM top t WHERE t.run = d.run AND rn <= 3), '') AS shed_by FROM d GROUP BY run""")
def gate_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a rate gate did in each run, and which hosts it shed most."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    d = e.select(F.pmod("user_id", F.lit(5)).alias("run"), F.concat(F.lit("h"), F.pmod("user_id", F.lit(11)).cast("string")).alias("host"), (F.col("event_id") % 3 != 0).alias("granted"), (F.pmod("event_id", F.lit(10)) / 10).alias("waited_s"), (F.col("event_id") % 50 == 0).alias("failed"))
    return S.gate_summary(d)


# ladders

CATALOGUE = [("view", 0), ("click", 1), ("api", 2), ("purchase", 3)]
_CATALOGUE = "(SELECT * FROM (VALUES " + ", ".join(f"('{m}', {c})" for m, c in CATALOGUE) + ") v(method, cost_rank))"
_LADDER = f"""(WITH f AS (SELECT * FROM {_FOLD} x), win AS (SELECT target_key, min_by(method, (cost_rank, method)) AS m, min(cost_rank) AS r FROM f WHERE status = 'ok' GROUP BY 1),
rows AS (SELECT t.target_key, c.method, c.cost_rank, f.status, w.m, w.r, bool_or(w.r > c.cost_rank AND f.status IS NULL) OVER (PARTITION BY t.target_key) AS untried FROM (SELECT DISTINCT target_key FROM f) t CROSS JOIN {_CATALOGUE} c
  LEFT JOIN f ON f.target_key = t.target_key AND f.method = c.method LEFT JOIN win w ON w.target_key = t.target_key)
SELECT target_key, method, cost_rank, row_number() OVER (PARTITION BY target_key ORDER BY CASE WHEN m = method AND NOT coalesce(untried, false) AND cast(target_key AS BIGINT) % 10 <> 0 THEN 0 ELSE 1 END, cost_rank, method) AS step FROM rows)"""


def _ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = S.fold_attempts(adapters.read(spark, sf_dir, "attempts"))
    targets = fold.select("target_key").distinct()
    return access.ladder(targets, spark.createDataFrame(CATALOGUE, "method string, cost_rank int"), fold, targets.filter("cast(target_key as bigint) % 10 = 0"))


@query(f"SELECT target_key, method, cost_rank, step FROM {_LADDER} l")
def access_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In which order each target's methods are tried: what works first, unless a cheaper method is untried or a new walk is admitted."""
    return _ladder(spark, sf_dir)


_OUTCOMES = "CASE k % 6 WHEN 0 THEN 'blocked' WHEN 1 THEN 'crashed' WHEN 2 THEN 'unequipped' END AS outcome, CASE k % 6 WHEN 4 THEN 3 WHEN 5 THEN 1 ELSE 0 END AS plausible, k * 5 % 11 AS quality"
_WALK = f"""(SELECT *, CASE WHEN outcome = 'crashed' THEN 'broken' WHEN outcome IS NOT NULL THEN outcome WHEN plausible >= 1 THEN 'ok' ELSE 'failed' END AS status FROM (SELECT target_key, method, cost_rank, step, {_OUTCOMES} FROM (SELECT *, cast(target_key AS BIGINT) * 7 + cost_rank * 3 AS k FROM {_LADDER} l) x) y)"""


def _outcomes(order: DataFrame) -> DataFrame:
    k = F.col("target_key").cast("bigint") * 7 + F.col("cost_rank") * 3
    m = F.pmod(k, F.lit(6))
    return order.select("target_key", "method", F.when(m == 0, "blocked").when(m == 1, "crashed").when(m == 2, "unequipped").alias("outcome"), F.when(m == 4, 3).when(m == 5, 1).otherwise(0).alias("plausible"), F.pmod(k * 5, F.lit(11)).alias("quality"))


@query(f"""SELECT target_key, method, step, status, coalesce(step = e, false) AS won FROM (SELECT *, min(CASE WHEN status = 'ok' THEN step END) OVER (PARTITION BY target_key) AS e FROM {_WALK} w) z WHERE (e IS NULL OR step <= e) AND status <> 'unequipped'""")
def access_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The attempts that walks record, and what they end with."""
    order = _ladder(spark, sf_dir)
    return access.replay(order, _outcomes(order))


@query(f"""SELECT target_key, method, step, status, coalesce(method = b, false) AS won FROM (SELECT w.*, first_value(CASE WHEN status = 'ok' THEN method END) OVER (PARTITION BY target_key ORDER BY CASE WHEN status = 'ok' THEN 0 ELSE 1 END, quality DESC, cost_rank, method) AS b FROM {_WALK} w) z WHERE status <> 'unequipped'""")
def access_max_yield(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walks to the end of the ladder: the best result wins, the cheaper one on ties."""
    order = _ladder(spark, sf_dir)
    return access.replay(order, _outcomes(order), max_yield=True)


@query(f"""SELECT state, count(*) AS records, count(*) FILTER (WHERE name <> '' AND (length(trim(address)) > 0 OR length(trim(city)) > 0 OR length(trim(zip_code)) > 0)) AS plausible,
  count(*) FILTER (WHERE name <> '' AND (length(trim(address)) > 0 OR length(trim(city)) > 0 OR length(trim(zip_code)) > 0)) >= 6 AS success FROM {_STORES} s GROUP BY state""")
def access_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.successes(adapters.read(spark, sf_dir, "stores"), ["state"], min_records=6)


@query(f"SELECT target_key, method, resource_url, CASE WHEN cast(target_key AS BIGINT) % 3 = 0 THEN method END AS page FROM {_FOLD} f")
def access_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a method was last found, with its parameters."""
    k = F.col("target_key").cast("bigint")
    fold = S.fold_attempts(adapters.read(spark, sf_dir, "attempts")).withColumn("params", F.when(k % 3 == 0, F.to_json(F.struct(F.col("method").alias("page")))).when(k % 3 == 1, "not json"))
    return access.hints(fold).select("target_key", "method", "resource_url", F.try_element_at("params", F.lit("page")).alias("page"))


# facts

_FACTS = "(SELECT 'company' AS subject_type, 'Clerk ' || cast(o_custkey % 30 AS VARCHAR) AS subject, CASE WHEN o_orderkey % 2 = 0 THEN 'owns' ELSE 'licence' END AS predicate, 'o' || o_orderkey AS source_ref, cast(o_orderdate AS DATE) AS retrieved_at FROM orders)"


@query(f"""SELECT source_ref, place FROM (SELECT *, row_number() OVER (PARTITION BY lower(subject) ORDER BY retrieved_at DESC, source_ref, predicate) AS place FROM {_FACTS} f WHERE predicate = 'owns' AND lower(subject) IN ('clerk 3', 'clerk 17')) x""")
def attestation_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that is attested of two subjects, the latest first."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    facts = o.select(F.lit("company").alias("subject_type"), F.concat(F.lit("Clerk "), (F.col("o_custkey") % 30).cast("string")).alias("subject"), F.when(F.col("o_orderkey") % 2 == 0, "owns").otherwise("licence").alias("predicate"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("source_ref"), F.to_date("o_orderdate").alias("retrieved_at"))
    asked = spark.createDataFrame([("company", "CLERK 3"), ("company", "clerk 17"), ("company", "Clerk 3"), ("person", "Clerk 4")], "subject_type string, subject string")
    return evidence.attestations_for(facts, asked, "owns").select("source_ref", "place")


@query(f"""WITH b AS (SELECT 'Clerk ' || cast(o_custkey % 30 AS VARCHAR) AS subject, 'r' || cast(o_orderkey % 4 AS VARCHAR) AS source_ref, max(cast(o_orderdate AS DATE)) FILTER (WHERE o_orderkey % 3 = 0) AS a, max(cast(o_orderdate AS DATE)) FILTER (WHERE o_orderkey % 3 = 1) AS b FROM orders WHERE o_orderkey % 3 < 2 GROUP BY ALL)
SELECT subject, source_ref, coalesce(b, a) AS retrieved_at FROM b""")
def attestation_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts after new ones: a row for each source, which replaces what it said before."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    rows = o.select("o_orderkey", F.lit("company").alias("subject_type"), F.concat(F.lit("Clerk "), (F.col("o_custkey") % 30).cast("string")).alias("subject"), F.lit("owns").alias("predicate"), F.concat(F.lit("r"), (F.col("o_orderkey") % 4).cast("string")).alias("source_ref"), F.to_date("o_orderdate").alias("retrieved_at"))
    one = lambda k: rows.filter(F.col("o_orderkey") % 3 == k).groupBy(*evidence.KEYS).agg(F.max("retrieved_at").alias("retrieved_at"))
    return evidence.upsert_attestations(one(0), one(1)).select("subject", "source_ref", "retrieved_at")


@query("SELECT host, updated_at, row_number() OVER (ORDER BY updated_at DESC, host) AS place FROM (SELECT 'h' || cast(user_id % 40 AS VARCHAR) AS host, max(ts) AS updated_at FROM events GROUP BY 1) x")
def heartbeat_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fleet's last signs of life, the freshest first."""
    beats = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.concat(F.lit("h"), F.pmod("user_id", F.lit(40)).cast("string")).alias("host"), F.col("ts").alias("updated_at"))
    fresh = evidence.heartbeats(beats).collect()  # a row a host: small, and its order is the result
    return spark.createDataFrame([(r.host, r.updated_at, k) for k, r in enumerate(fresh, 1)], "host string, updated_at timestamp_ntz, place long" if dict(beats.dtypes)["updated_at"] == "timestamp_ntz" else "host string, updated_at timestamp, place long")


@query(f"SELECT s.id, s.state, p.abbr IS NOT NULL AS listed, CASE WHEN p.regime IN ('limited', 'open') THEN p.regime END AS regime_std FROM {_STORES} s LEFT JOIN (SELECT abbr, coalesce(regime, 'unchecked') AS regime FROM {_PROGRAMS} q WHERE abbr <> 'NATION_2' AND abbr <> 'CHINA') p ON p.abbr = s.state")
def licence_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is coded of each store's jurisdiction: not listed, listed but unchecked, or a regime."""
    coded = adapters.read(spark, sf_dir, "programs").filter("abbr not in ('NATION_2', 'CHINA')").select("abbr", F.coalesce("regime", F.lit("unchecked")).alias("regime"))
    stores = adapters.read(spark, sf_dir, "stores").select("id", "state", F.lower("state").alias("abbr"))
    return evidence.regime_records(coded, stores).select("id", "state", "listed", "regime_std")


@query(f"SELECT abbr, regime FROM {_PROGRAMS} p WHERE regime IS NOT NULL UNION ALL SELECT abbr, NULL FROM {_PROGRAMS} p WHERE regime IS NULL")
def licence_worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The coded jurisdictions, and those that wait."""
    p = adapters.read(spark, sf_dir, "programs")
    return evidence.coded(p).unionByName(evidence.unchecked(p).withColumn("regime", F.lit(None).cast("string")))


PARENTS, REASONS = {f"shop{k}": f"Group {k % 5}" for k in range(0, 40)}, {"shop96": "a label", "shop95": "many"}


@query("""SELECT id, CASE WHEN k IN ('shop95', 'shop96') THEN NULL WHEN n < 40 THEN 'Group ' || cast(n % 5 AS VARCHAR) ELSE name END AS operator, CASE WHEN k IN ('shop95', 'shop96') THEN NULL WHEN n < 40 THEN 'Group ' || cast(n % 5 AS VARCHAR) ELSE k END AS folded,
  CASE k WHEN 'shop96' THEN 'a label' WHEN 'shop95' THEN 'many' END AS reason, k NOT IN ('shop95', 'shop96') AS identity FROM (SELECT s_suppkey AS id, s_suppkey % 97 AS n, CASE WHEN s_suppkey % 2 = 0 THEN 'SHOP ' ELSE 'Shop-' END || cast(s_suppkey % 97 AS VARCHAR) AS name, 'shop' || cast(s_suppkey % 97 AS VARCHAR) AS k FROM supplier) x""")
def operator_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By what operators are counted, with and without spellings folded, and why some names are nobody's."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    name = F.concat(F.when(F.col("s_suppkey") % 2 == 0, "SHOP ").otherwise("Shop-"), (F.col("s_suppkey") % 97).cast("string"))
    key = lambda fold: X.operator_key(F.col("name"), PARENTS, [*REASONS], fold)
    return s.select(F.col("s_suppkey").alias("id"), name.alias("name")).select("id", key(False).alias("operator"), key(True).alias("folded"), X.reason_not_an_identity(F.col("name"), REASONS).alias("reason"), X.is_corporate_identity(F.col("name"), REASONS).alias("identity"))


@query("""SELECT id, CASE id % 5 WHEN 0 THEN cast(id * 1000003 AS VARCHAR) WHEN 1 THEN cast(id AS VARCHAR) WHEN 2 THEN 'Suite ' || id WHEN 3 THEN NULL ELSE '-7' END AS cell, CASE WHEN id % 3 = 0 THEN NULL ELSE id || ' Main St' END AS address, d AS day
FROM (SELECT o_orderkey AS id, cast(o_orderdate AS DATE) AS d FROM orders) x""")
def captured_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of spreadsheets as text, dates in an address's place, and days that texts begin with."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("d"))
    k, text = F.pmod("id", F.lit(5)), F.col("id").cast("string")
    cell = F.when(k == 0, (F.col("id") * 1000003).cast("double").cast("string")).when(k == 1, F.concat(text, F.lit(".0"))).when(k == 2, F.concat(F.lit("  Suite  "), text, F.lit(" "))).when(k == 4, "-7.9")
    address = F.when(F.col("id") % 3 == 0, F.date_format("d", "M/d/yyyy")).otherwise(F.concat(text, F.lit(" Main St")))
    return o.select("id", X.cell_text(cell).alias("cell"), X.address_or_null(address).alias("address"), X.day_of(F.concat(F.col("d").cast("string"), F.lit("T10:00:00Z"))).alias("day"))
