"""Queries over stores and jurisdictions: names, keys, resolution, geocoding, comparison."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfspark import adapters, oracles, rules
from shelfspark.catalog import query
from shelfspark.functions import places as G
from shelfspark.functions import text as X
from shelfspark.operators import discovery, geocode, guards, history, resolve

_STORES, _PROGRAMS, _LISTINGS = (f"({adapters.duckdb(n)})" for n in ("stores", "programs", "listings"))


def _stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.read(spark, sf_dir, "stores")


_SHOP = "(?i)\\s+(?:" + "|".join(rules.SHOP_ENDINGS) + ")$"
_LEGAL = "(?i)[,\\s]+(?:" + "|".join(rules.LEGAL_ENDINGS) + ")\\.?$"


def _keeps(c: str) -> str:
    return f"(length({c}) > 0 AND lower({c}) NOT IN ('a', 'an', 'the') AND regexp_matches({c}, '\\p{{L}}'))"


_LEGAL_STEP = f"""SELECT id, city, CASE WHEN {_keeps('s')} AND trim(regexp_replace(' ' || s, '{_SHOP}', '')) <> '' THEN s ELSE n END AS n FROM (
  SELECT id, city, n, regexp_replace(regexp_replace(regexp_replace(n, '{_LEGAL}', ''), '^[ ,.]+', ''), '[ ,.]+$', '') AS s FROM ({{0}}) a) b"""
_BRAND_0 = f"SELECT id, city, CASE WHEN contains(n, ' - ') THEN trim(string_split(n, ' - ')[1]) ELSE n END AS n FROM (SELECT id, city, trim(regexp_extract(canonical_name, '^[^;,]*', 0)) AS n FROM {_STORES} s) x"
_BRAND_1 = _BRAND_0
for _ in range(4):
    _BRAND_1 = _LEGAL_STEP.replace("{0}", _BRAND_1)
_BRAND_2 = f"SELECT id, city, CASE WHEN {_keeps('s')} THEN s ELSE n END AS n FROM (SELECT *, trim(regexp_replace(n, '{_SHOP}', '')) AS s FROM ({_BRAND_1}) a) b"


@query(f"""SELECT id, CASE WHEN length(city) > 0 AND ends_with(lower(n), ' ' || lower(city)) AND length(trim(left(n, length(n) - length(city)))) >= 3 THEN trim(left(n, length(n) - length(city))) ELSE n END AS brand,
  {oracles.brand_key('canonical_name')} AS brand_key FROM ({_BRAND_2}) a JOIN (SELECT id, canonical_name FROM {_STORES} s) b USING (id)""")
def brand_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stores(spark, sf_dir).select("id", X.extract_brand(F.col("canonical_name"), F.col("city")).alias("brand"), X.brand_key(F.col("canonical_name")).alias("brand_key"))


@query(f"""SELECT id, {oracles.address_std('address')} AS address_std, {oracles.zip_key('zip_code')} AS zip_key, {oracles.address_key('address', 'zip_code')} AS address_key,
  {oracles.geo_key('latitude', 'longitude', 'zip_code')} AS geo_key, {oracles.location_key('latitude', 'longitude', 'address', 'zip_code')} AS location_key, {oracles.handle('platform', 'external_id')} AS handle,
  coalesce(nullif({oracles.geo_key('latitude', 'longitude', 'zip_code')}, ''), nullif({oracles.address_key('address', 'zip_code')}, ''), coalesce(platform, 'None') || ':' || coalesce(external_id, 'None')) AS physical_key
FROM {_STORES} s""")
def address_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    lat, lng, a, z, p, x = (F.col(c) for c in ("latitude", "longitude", "address", "zip_code", "platform", "external_id"))
    return _stores(spark, sf_dir).select(
        "id", G.address_std(a).alias("address_std"), G.zip_key(z).alias("zip_key"), G.address_key(a, z).alias("address_key"), G.geo_key(lat, lng, z).alias("geo_key"),
        G.location_key(lat, lng, a, z).alias("location_key"), G.handle(p, x).alias("handle"), G.physical_key(lat, lng, a, z, p, x).alias("physical_key"),
    )


def _case(c: str, table: dict) -> str:
    return f"CASE {c} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"


_STREET = f"""
WITH t AS (SELECT id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(upper(trim(address)), '(?i)^\\s*(?:(?:BAY|{'|'.join(w.upper() for w in rules.UNIT_WORDS)}|#)\\s*\\.?\\s*#?[\\w-]+\\s*[-,]?\\s*)+', ''),
    '^\\s*[0-9]+[A-Z]?\\s*-\\s*([0-9]+\\s)', '\\1'), '[.,]', ' ', 'g'), '\\s+', ' ', 'g')) AS t FROM {_STORES} s
), w AS (SELECT id, regexp_extract(t, '^([0-9]+)[A-Z]?\\s+', 1) AS num, list_filter(string_split(regexp_replace(t, '^[0-9]+[A-Z]?\\s+', ''), ' '), lambda x: x <> '') AS w FROM t
), d AS (SELECT id, num, CASE WHEN len(w) > 1 THEN {_case('w[-1]', rules.DIRECTIONS)} END AS dir, w FROM w
), d2 AS (SELECT id, num, dir, CASE WHEN dir IS NOT NULL THEN w[1:len(w) - 1] ELSE w END AS w FROM d
), k AS (SELECT id, num, dir, CASE WHEN len(w) > 1 THEN {_case('w[-1]', rules.STREET_TYPES)} END AS kind, w FROM d2
), k2 AS (SELECT id, num, dir, kind, CASE WHEN kind IS NOT NULL THEN w[1:len(w) - 1] ELSE w END AS w FROM k)
SELECT id, CASE WHEN num <> '' AND len(w) > 0 THEN cast(num AS BIGINT) END AS house_number,
  CASE WHEN num <> '' AND len(w) > 0 THEN trim(regexp_replace(regexp_replace(array_to_string(w, ' '), '[^A-Z0-9 ]+', ' ', 'g'), ' +', ' ', 'g')) || '|' || coalesce(kind, '') || '|' || coalesce(dir, '') END AS street_key FROM k2"""


@query(_STREET)
def street_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    number, key = G.street_parts(F.col("address"))
    return _stores(spark, sf_dir).select("id", number.alias("house_number"), key.alias("street_key"))


#: DuckDB's word boundary knows ASCII only: said with the letters and digits of all scripts.
_PLACEHOLDER = re.sub(r"\\b(.*?)\\b", r"(?:^|[^\\p{L}\\p{N}_])\1(?:$|[^\\p{L}\\p{N}_])", rules.PLACEHOLDER)


@query(f"""SELECT doc_id, trim(s) = '' OR regexp_matches(s, '(?i){_PLACEHOLDER}') OR regexp_matches(trim(s), '(?i){rules.LICENCE}') AS placeholder, regexp_matches(lower(s), '\\b(?:edibles|thc|trash)\\b') AS trade
FROM (SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN '12.345-CL' WHEN doc_id % 13 = 0 THEN 'Test shop' ELSE text END AS s FROM documents) x""")
def placeholder_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    s = F.when(F.col("doc_id") % 17 == 0, "12.345-CL").when(F.col("doc_id") % 13 == 0, "Test shop").otherwise(F.col("text"))
    return docs.select("doc_id", X.is_placeholder(s).alias("placeholder"), guards.looks_like_trade(s, ["thc", "edibles", "trash"]).alias("trade"))


PARENTS = {f"shop{k}": f"Group {k % 5}" for k in range(0, 40)}
GENERIC = ["shop96", "store"]
BRAND_ALIASES = [("brand#1", "One"), ("brand#2", "Two"), ("brand", "Rest")]


@query(f"""SELECT supplier.s_suppkey AS id, CASE WHEN k IN ('shop96', 'store', '') THEN NULL WHEN regexp_matches(k, '^shop[0-9]$|^shop[0-3][0-9]$') THEN 'Group ' || cast(s_suppkey % 97 % 5 AS VARCHAR) ELSE n END AS parent, k AS banner_key
FROM supplier JOIN (SELECT s_suppkey AS i, 'Shop ' || cast(s_suppkey % 97 AS VARCHAR) AS n, {oracles.alnum("'Shop ' || cast(s_suppkey % 97 AS VARCHAR)")} AS k FROM supplier) x ON i = s_suppkey""")
def banner_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    name = F.concat(F.lit("Shóp "), (F.col("s_suppkey") % 97).cast("string"))
    plain = F.translate(name, "ó", "o")
    return s.select(F.col("s_suppkey").alias("id"), X.parent_of_banner(plain, PARENTS, GENERIC).alias("parent"), X.banner_key(name).alias("banner_key"))


@query("""SELECT p_partkey AS product_id, CASE WHEN regexp_matches(lower(p_brand), '(^|[^a-z0-9])brand#1($|[^a-z0-9])') THEN 'One' WHEN regexp_matches(lower(p_brand), '(^|[^a-z0-9])brand#2($|[^a-z0-9])') THEN 'Two'
  WHEN regexp_matches(lower(p_brand), '(^|[^a-z0-9])brand($|[^a-z0-9])') THEN 'Rest' END AS parent FROM part""")
def brand_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("product_id"), X.parent_of_brand(F.col("p_brand"), BRAND_ALIASES).alias("parent"))


_HANDLES = f"SELECT id, state, company_id, {oracles.handle('platform', 'external_id')} AS h, {oracles.address_key('address', 'zip_code')} AS a, {oracles.geo_key('latitude', 'longitude', 'zip_code')} AS g FROM {_STORES} s"


@query(f"SELECT h AS handle FROM ({_HANDLES}) x WHERE h <> '' AND a <> '' GROUP BY h HAVING count(DISTINCT a) > 1")
def ambiguous_handles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.ambiguous_handles(_stores(spark, sf_dir))


_GROUPS = f"""WITH RECURSIVE s AS (SELECT id, state, canonical_name, latitude, longitude, {oracles.handle('platform', 'external_id')} AS h, {oracles.address_key('address', 'zip_code')} AS a, {oracles.geo_key('latitude', 'longitude', 'zip_code')} AS g FROM {_STORES} x),
bogus AS (SELECT state, h FROM s WHERE h <> '' AND a <> '' GROUP BY state, h HAVING count(DISTINCT a) > 1),
keys AS (SELECT state, id, unnest([a, g, CASE WHEN (state, h) IN (SELECT state, h FROM bogus) THEN '' ELSE h END]) AS k FROM s),
fine AS (SELECT DISTINCT * FROM keys WHERE k <> ''),
edges AS (SELECT x.id AS a, y.id AS b FROM fine x JOIN fine y ON x.state = y.state AND x.k = y.k AND x.id <> y.id
  UNION SELECT x.id, y.id FROM s x JOIN s y ON x.state = y.state AND x.canonical_name = y.canonical_name AND x.id <> y.id AND x.id IN (SELECT id FROM fine) AND y.id IN (SELECT id FROM fine)
    WHERE 2 * 6371000 * asin(sqrt(pow(sin(radians(y.latitude - x.latitude) / 2), 2) + cos(radians(x.latitude)) * cos(radians(y.latitude)) * pow(sin(radians(y.longitude - x.longitude) / 2), 2))) <= 100),
reach AS (SELECT DISTINCT id AS n, id AS r FROM fine UNION SELECT e.b, reach.r FROM reach JOIN edges e ON e.a = reach.n WHERE reach.r < e.b)
SELECT n AS id, min(r) AS grp FROM reach GROUP BY n"""


@query(_GROUPS)
def store_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.dedupe(_stores(spark, sf_dir)).filter("grp is not null").select("id", "grp")


@query(f"""SELECT s.state, count(*) - coalesce(max(d.folded), 0) AS distinct_stores, coalesce(max(d.folded), 0) AS duplicate_rows FROM {_STORES} s
LEFT JOIN (SELECT x.state, cast(sum(n - 1) AS BIGINT) AS folded FROM (SELECT grp, count(*) AS n FROM ({_GROUPS}) g GROUP BY grp) y JOIN {_STORES} x ON x.id = y.grp GROUP BY x.state) d ON d.state = s.state GROUP BY s.state""")
def dedupe_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many stores a state has once duplicates are folded."""
    return discovery.dedupe_report(resolve.dedupe(_stores(spark, sf_dir)))


@query()
def dedupe_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Survivors, operators, fill-ins and storefronts (an iterative operator; ``store_groups`` has its groups in SQL)."""
    return resolve.dedupe(_stores(spark, sf_dir))


@query(f"SELECT platform, external_id, state, company_id, id FROM (SELECT *, row_number() OVER (PARTITION BY state, platform, external_id ORDER BY company_id, id) AS rn FROM {_STORES} s WHERE canonical_company_id IS NULL AND platform IS NOT NULL AND external_id <> '') x WHERE rn = 1")
def menu_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.kept_handles(_stores(spark, sf_dir), "state").select("platform", "external_id", "state", "company_id", "id")


@query(f"""SELECT l.listing_id, k.company_id AS old_company_id, coalesce(k.c, l.company_id) AS company_id, coalesce(k.c <> l.company_id, false) AS moved FROM
  (SELECT * FROM {_LISTINGS} x) l LEFT JOIN (SELECT platform, external_id, min_by(company_id, company_id * 100000000 + id) AS c, NULL::BIGINT AS company_id FROM {_STORES} s
    WHERE canonical_company_id IS NULL AND platform IS NOT NULL AND external_id <> '' GROUP BY ALL) k ON l.platform = k.platform AND l.external_id = k.external_id""".replace("k.company_id AS old_company_id", "l.company_id AS old_company_id"))
def realign_company(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings with the company of the menu they are of."""
    kept = resolve.kept_handles(_stores(spark, sf_dir)).select("platform", "external_id", F.col("company_id").alias("kept_company"))
    listings = adapters.read(spark, sf_dir, "listings").select("listing_id", "platform", "external_id", "company_id")
    return listings.join(kept, ["platform", "external_id"], "left").select(
        "listing_id", F.col("company_id").alias("old_company_id"), F.coalesce("kept_company", "company_id").alias("company_id"), F.coalesce(F.col("kept_company") != F.col("company_id"), F.lit(False)).alias("moved")
    )


@query(f"""SELECT key, state, spelling AS canonical_name, rows FROM (SELECT *, sum(n) OVER (PARTITION BY key, state) AS rows, row_number() OVER (PARTITION BY key, state ORDER BY n DESC, length(spelling) - length(replace(spelling, ' ', '')) DESC, length(spelling) DESC, spelling DESC) AS rn
  FROM (SELECT {oracles.brand_key('canonical_name')} AS key, state, canonical_name AS spelling, count(*) AS n FROM {_STORES} s GROUP BY ALL) x) y WHERE rn = 1 AND key NOT IN ('shop1llc')""".replace("rows FROM", "cast(rows AS BIGINT) AS rows FROM"))
def seed_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A roster folded to companies, each under its commonest (then most readable) spelling, those that exist left out."""
    spellings = _stores(spark, sf_dir).groupBy(X.brand_key(F.col("canonical_name")).alias("key"), "state", F.col("canonical_name").alias("spelling")).agg(F.count(F.lit(1)).alias("n"))
    folded = spellings.groupBy("key", "state").agg(F.max_by("spelling", F.struct(F.col("n"), X.readability(F.col("spelling")).alias("r"))).alias("canonical_name"), F.sum("n").alias("rows"))
    there = spark.createDataFrame([("shop1llc",)], "key string")
    return folded.join(F.broadcast(there), "key", "left_anti").select("key", "state", "canonical_name", "rows")


@query(f"SELECT s.id, s.state FROM {_STORES} s WHERE s.state IN (SELECT abbr FROM {_PROGRAMS} p WHERE country = 'US' AND abbr <> 'NATION_1')")
def jurisdiction_semijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guards.in_country(_stores(spark, sf_dir), adapters.read(spark, sf_dir, "programs"), "US", without=("NATION_1",)).select("id", "state")


@query(f"SELECT regime, country, count(*) AS n FROM {_PROGRAMS} p WHERE regime IS NOT NULL GROUP BY ALL")
def licence_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.read(spark, sf_dir, "programs").filter("regime is not null").groupBy("regime", "country").agg(F.count(F.lit(1)).alias("n"))


_Q = """CASE WHEN length(address) > 0 THEN concat_ws(', ', trim(regexp_replace(address, '\\s+', ' ', 'g')), CASE WHEN length(city) > 0 THEN trim(regexp_replace(city, '\\s+', ' ', 'g')) END, nullif(concat_ws(' ', nullif(trim(state), ''), nullif(trim(zip_code), '')), '')) END"""


@query(f"""SELECT s.id, s.q AS query, CASE WHEN s.latitude IS NULL AND c.latitude IS NOT NULL AND c.longitude IS NOT NULL THEN c.latitude ELSE s.latitude END AS latitude,
  CASE WHEN s.latitude IS NULL AND c.latitude IS NOT NULL AND c.longitude IS NOT NULL THEN c.longitude ELSE s.longitude END AS longitude, CASE WHEN s.zip_code IS NULL THEN nullif(c.zip_code, '') ELSE s.zip_code END AS zip_code, CASE WHEN s.city IS NULL THEN nullif(c.city, '') ELSE s.city END AS city
FROM (SELECT *, {_Q} AS q FROM {_STORES} x) s LEFT JOIN (SELECT {_Q} AS q, min(latitude) AS latitude, min(longitude) AS longitude, CASE WHEN min(id) % 2 = 0 THEN '' ELSE '00000' END AS zip_code, 'Cached' AS city FROM {_STORES} y WHERE id % 3 <> 0 OR latitude IS NULL GROUP BY 1) c ON c.q = s.q""")
def geocode_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores with coordinates (as a pair), postal code and city filled in from a geocoder's cache."""
    stores = _stores(spark, sf_dir).withColumn("query", X.geocode_query(*(F.col(c) for c in ("address", "city", "state", "zip_code"))))
    known = stores.filter("id % 3 <> 0 or latitude is null")
    cache = known.groupBy("query").agg(F.min("latitude").alias("latitude"), F.min("longitude").alias("longitude"), F.when(F.min("id") % 2 == 0, "").otherwise("00000").alias("zip_code"), F.lit("Cached").alias("city"))
    return history.restore_geocodes(stores, cache).select("id", "query", "latitude", "longitude", "zip_code", "city")


_COMPARE = f"""FULL JOIN (SELECT DISTINCT state, {oracles.address_key('address', 'zip_code')} AS key FROM {_STORES} s WHERE source <> 'own') r ON o.state = r.state AND o.key = r.key"""


@query(f"""SELECT coalesce(o.state, r.state) AS state, CASE WHEN r.key IS NULL THEN 'site_only' WHEN o.key IS NULL THEN 'roster_only' ELSE 'both' END AS status, count(*) AS n
FROM (SELECT DISTINCT state, {oracles.address_key('address', 'zip_code')} AS key FROM {_STORES} s WHERE source = 'own' AND (length(address) > 0 OR {oracles.handle('platform', 'external_id')} <> '')) o {_COMPARE} GROUP BY ALL""")
def compare_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How own sites and rosters agree, by state; own rows with neither address nor menu don't count."""
    stores = _stores(spark, sf_dir).withColumn("key", G.address_key(F.col("address"), F.col("zip_code")))
    own = stores.filter((F.col("source") == "own") & ((F.length("address") > 0) | (G.handle(F.col("platform"), F.col("external_id")) != ""))).select("state", "key").distinct().withColumn("own", F.lit(True))
    roster = stores.filter("source != 'own'").select("state", "key").distinct().withColumn("roster", F.lit(True))
    status = F.when(F.col("roster").isNull(), "site_only").when(F.col("own").isNull(), "roster_only").otherwise("both")
    return own.join(roster, ["state", "key"], "full").groupBy("state", status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""
WITH a AS (SELECT s.id, s.city, t.house_number, t.street_key FROM {_STORES} s JOIN ({_STREET}) t USING (id)),
pts AS (SELECT DISTINCT ON (coalesce(upper(city), ''), house_number, street_key) coalesce(upper(city), '') AS ck, house_number AS h, street_key AS k, cast(id AS DOUBLE) AS x, cast(id % 7 AS DOUBLE) AS y FROM a WHERE id % 4 = 0 ORDER BY coalesce(upper(city), ''), house_number, street_key, id),
loose AS (SELECT ck, h, regexp_extract(k, '^(.*)\\|[^|]*$', 1) AS l, any_value(x) AS x, any_value(y) AS y FROM pts GROUP BY ALL HAVING count(*) = 1)
SELECT a.id, coalesce(p.x, l.x) AS x, coalesce(p.y, l.y) AS y, CASE WHEN p.x IS NOT NULL THEN 'exact' WHEN l.x IS NOT NULL THEN 'no_direction' END AS how
FROM a LEFT JOIN pts p ON p.ck = coalesce(upper(a.city), '') AND p.h = a.house_number AND p.k = a.street_key LEFT JOIN loose l ON ends_with(a.street_key, '|') AND l.ck = coalesce(upper(a.city), '') AND l.h = a.house_number AND l.l = regexp_extract(a.street_key, '^(.*)\\|[^|]*$', 1)""".replace("GROUP BY ALL HAVING", "GROUP BY 1, 2, 3 HAVING"))
def point_geocode(spark: SparkSession, sf_dir: str) -> DataFrame:
    number, key = G.street_parts(F.col("address"))
    a = _stores(spark, sf_dir).select("id", G.city_std(F.col("city")).alias("city_key"), number.alias("house_number"), key.alias("street_key"))
    points = a.filter("id % 4 = 0").select("city_key", "house_number", "street_key", F.col("id").alias("ordinal"), F.col("id").cast("double").alias("x"), (F.col("id") % 7).cast("double").alias("y"))
    return geocode.point_lookup(a, points)


@query(f"""
WITH a AS (SELECT id, house_number AS h, street_key AS k FROM ({_STREET}) t WHERE street_key IS NOT NULL),
seg AS (SELECT k, i, i * 20 AS lo, i * 20 + 18 + (i % 3) * 20 AS hi, 4000000.0 + i * 400 AS x0 FROM (SELECT DISTINCT k FROM a) s, (SELECT unnest(range(0, 12)) AS i) r),
met AS (SELECT id, h, i, lo, hi, x0, CASE WHEN h BETWEEN lo AND hi AND h BETWEEN lo + 1 AND hi + 1 THEN CASE WHEN h % 2 = 1 THEN 'r' ELSE 'l' END WHEN h BETWEEN lo AND hi THEN 'l' WHEN h BETWEEN lo + 1 AND hi + 1 THEN 'r' END AS side FROM a JOIN seg USING (k)),
best AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY hi - lo, i) AS rn FROM met WHERE side IS NOT NULL),
pos AS (SELECT id, i, side, x0, 50 + (cast(h - lo - CASE side WHEN 'r' THEN 1 ELSE 0 END AS DOUBLE) / (hi - lo)) * 300 AS d FROM best WHERE rn = 1)
SELECT id, i AS segment_id, side, round(CASE WHEN d <= 200 THEN x0 + d ELSE x0 + 200 - CASE side WHEN 'l' THEN 18 ELSE -18 END END, 6) AS x, round(CASE WHEN d <= 200 THEN 1500000 + CASE side WHEN 'l' THEN 18 ELSE -18 END ELSE 1500000 + d - 200 END, 6) AS y FROM pos""")
def range_geocode(spark: SparkSession, sf_dir: str) -> DataFrame:
    number, key = G.street_parts(F.col("address"))
    a = _stores(spark, sf_dir).select("id", number.alias("house_number"), key.alias("street_key")).filter("street_key is not null")
    i = F.col("segment_id")
    xy = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    x0 = F.lit(4000000.0) + i * 400
    segments = a.select("street_key").distinct().select("street_key", F.explode(F.expr("sequence(0L, 11L)")).alias("segment_id"))
    lo, hi = i * 20, i * 20 + 18 + (i % 3) * 20
    pts = F.array(xy(x0, F.lit(1500000.0)), xy(x0 + 200, F.lit(1500000.0)), xy(x0 + 200, F.lit(1500200.0)))
    segments = segments.select("street_key", "segment_id", lo.alias("lo_l"), hi.alias("hi_l"), (lo + 1).alias("lo_r"), (hi + 1).alias("hi_r"), pts.alias("pts"))
    return geocode.range_lookup(a, segments).select("id", "segment_id", "side", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


def _inverse_sql(rounds: int = 5) -> str:
    """The inverse projection in SQL, a subquery a round."""
    out = f"SELECT x, y, t, pi() / 2 - 2 * atan(t) AS p FROM (SELECT x, y, pow(sqrt(pow(x - {G._X0}, 2) + pow({G._R0!r} - (y - {G._Y0}), 2)) / {G._A * G._F0!r}, {1 / G._N!r}) AS t FROM g) a"
    for _ in range(rounds):
        out = f"SELECT x, y, t, pi() / 2 - 2 * atan(t * pow((1 - {G._E!r} * sin(p)) / (1 + {G._E!r} * sin(p)), {G._E / 2!r})) AS p FROM ({out}) b"
    return out


@query(f"""WITH g AS (SELECT 4000000.0::DOUBLE + (i % 10) * 100000 AS x, 1500000.0::DOUBLE + (i // 10) * 100000 AS y FROM (SELECT unnest(range(0, 100)) AS i) r)
SELECT x, y, round(degrees(p), 7) AS latitude, round(degrees(atan2(x - {G._X0}, {G._R0!r} - (y - {G._Y0})) / {G._N!r} + {G._LNG0!r}), 7) AS longitude FROM ({_inverse_sql()}) h""")
def range_geocode_wgs84(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corners of a grid of projected metres as coordinates (tests hold them against the projection's own formulae)."""
    grid = spark.range(0, 100).select((F.lit(4000000.0) + (F.col("id") % 10) * 100000).alias("x"), (F.lit(1500000.0) + F.floor(F.col("id") / 10) * 100000).alias("y"))
    return grid.select("x", "y", G.to_wgs84(F.col("x"), F.col("y")).alias("g")).select("x", "y", F.round("g.latitude", 7).alias("latitude"), F.round("g.longitude", 7).alias("longitude"))


@query(f"""SELECT source, count(*) AS rows, count(DISTINCT lower(coalesce(nullif(trim(address), ''), name, ''))) AS distinct_stores, count(DISTINCT CASE WHEN external_id <> '' AND coalesce(source, '') <> 'aggregator' AND coalesce(platform, '') NOT IN ('leafly', 'weedmaps') THEN lower(coalesce(nullif(trim(address), ''), name, '')) END) AS menu_stores,
  count(*) FILTER (WHERE name <> '' AND (length(trim(address)) > 0 OR length(trim(city)) > 0 OR length(trim(zip_code)) > 0)) AS plausible FROM {_STORES} s GROUP BY source""")
def store_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores told apart by address, else name; those with a menu of their own; rows that look like records."""
    one = F.lower(F.coalesce(F.nullif(F.trim("address"), F.lit("")), F.col("name"), F.lit("")))
    menu = (F.col("external_id") != "") & (F.coalesce("source", F.lit("")) != "aggregator") & ~F.coalesce("platform", F.lit("")).isin("leafly", "weedmaps")
    return _stores(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(one).alias("distinct_stores"), F.count_distinct(F.when(menu, one)).alias("menu_stores"), F.count_if(guards.plausible_record()).alias("plausible"))
