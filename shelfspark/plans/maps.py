"""Queries over published maps, address points, road networks, and captured answers; captures are made of the tables, so that what they hold is known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark import adapters
from shelfspark.catalog import query
from shelfspark.functions import places as G
from shelfspark.functions import products as P
from shelfspark.operators import discovery, geocode, resolve
from shelfspark.operators.spread import spread
from shelfspark.sources import extract, layers, registries

_STORES = f"({adapters.duckdb('stores')})"


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys to make captures of, dealt out to all cores: a small file of them is many pages to read."""
    return spread(spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("k")), "k")


# address points and roads


@query("""SELECT city_key, house_number, street_key, y, x, k AS ordinal FROM (SELECT *, row_number() OVER (PARTITION BY house_number, street_key ORDER BY k) AS rn FROM (
  SELECT c_custkey AS k, 'AB:CALGARY' AS city_key, c_custkey % 50 + 1 AS house_number, CASE c_custkey % 3 WHEN 0 THEN 'MAPLE|ST|NW' WHEN 1 THEN 'OAK|AVE|SE' ELSE 'ELM|RD|' END AS street_key, 51.0 + c_custkey / 1000 AS y, -114.0::DOUBLE AS x
  FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey % 11 <> 0 AND c_custkey % 13 <> 0) a) b WHERE rn = 1""".replace("c_custkey / 1000", "cast(c_custkey % 500 AS DOUBLE) / 1024"))
def point_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A city's published points by address: plain numbers of official rows with coordinates, the first of each."""
    k = F.col("k")
    pick = lambda *v: F.when(k % 3 == 0, v[0]).when(k % 3 == 1, v[1]).otherwise(v[2])
    published = _customers(spark, sf_dir).select(
        F.col("k").alias("ordinal"), F.when(k % 7 == 0, _text(k % 50 + 1, "A")).otherwise(_text(k % 50 + 1)).alias("house"), pick("Maple", "oak", "Elm").alias("street"), pick("ST", "AV", "RD").alias("type"), pick("NW", "SE", "").alias("quad"),
        F.when(k % 11 == 0, "RETIRED").otherwise("official ").alias("status"), F.when(k % 13 == 0, "").otherwise(_text(51.0 + (k % 500).cast("double") / 1024)).alias("lat"), F.lit("-114.0").alias("lon"),
    )
    return geocode.load_points(published, "AB:CALGARY", "house", "lat", "lon", split=("street", "type", "quad"), kinds={"AV": "AVENUE", "ST": "STREET", "RD": "ROAD"}, status=("status", "OFFICIAL"))


@query(f"SELECT id, coalesce(upper(city), '') = 'TOWNSVILLE' AS covered FROM {_STORES} s")
def point_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a store's town publishes points at all."""
    s = adapters.read(spark, sf_dir, "stores").select("id", G.city_std(F.col("city")).alias("city_key"))
    return geocode.covers(s, s.filter("id % 4 = 0 and city_key != ''").select("city_key")).drop("city_key")


@query("""SELECT unnest(CASE c_custkey % 4 WHEN 0 THEN ['A', 'B'] WHEN 1 THEN ['A'] WHEN 2 THEN ['B'] ELSE ['A'] END) AS area, 'S' || c_custkey || '|ST|W' AS street_key, c_custkey AS segment_id, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_custkey END AS lo_l, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_custkey + 1 END AS lo_r
FROM customer WHERE NOT (c_custkey % 5 = 0 AND c_custkey % 6 = 0) AND c_custkey % 8 <> 0""")
def road_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of a road network under the areas of both their sides; those without numbers or a shape are left out."""
    k = F.col("k")
    pick = lambda *v: F.when(k % 4 == 0, v[0]).when(k % 4 == 1, v[1]).when(k % 4 == 2, v[2]).otherwise(v[3])
    pts = F.when(k % 8 == 0, F.array().cast("array<struct<x:double,y:double>>")).otherwise(F.array(F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y")), F.struct(F.lit(1.0).alias("x"), F.lit(0.0).alias("y"))))
    none = F.lit(None).cast("string")
    roads = _customers(spark, sf_dir).select(
        F.col("k").alias("segment_id"), _text("S", k).alias("name"), F.lit("St").alias("kind"), F.lit("W").alias("direction"), pick("A", "A", none, "A").alias("area_l"), pick("B", "A", "B", none).alias("area_r"),
        F.when(k % 5 == 0, "1A").otherwise(_text(k)).alias("lo_l"), _text(k).alias("hi_l"), F.when(k % 6 == 0, " ").otherwise(_text(k + 1)).alias("lo_r"), _text(k + 1).alias("hi_r"), pts.alias("pts"),
    )
    return geocode.road_segments(roads).select("area", "street_key", "segment_id", "lo_l", "lo_r")


@query("""WITH p AS (SELECT cast(c_custkey % 37 AS DOUBLE) / 4 AS lat, cast(c_custkey * 7 % 53 AS DOUBLE) / 4 AS lng FROM customer), g AS (SELECT l AS level, y, x, 16.0 / (1 << l) AS s FROM (SELECT unnest(range(0, 4)) AS l), LATERAL (SELECT unnest(range(0, 8)) AS y), LATERAL (SELECT unnest(range(0, 8)) AS x) WHERE y < (1 << l) AND x < (1 << l)),
n AS (SELECT level, y, x, s, (SELECT count(*) FROM p WHERE lat >= y * s AND lat < (y + 1) * s AND lng >= x * s AND lng < (x + 1) * s) AS n FROM g)
SELECT y * s AS lat0, (y + 1) * s AS lat1, x * s AS lng0, (x + 1) * s AS lng1, cast(level AS INTEGER) AS level, n FROM n WHERE (level = 3 OR n <= 40) AND (level = 0 OR (SELECT m.n FROM n m WHERE m.level = n.level - 1 AND m.y = n.y // 2 AND m.x = n.x // 2) > 40)""")
def quadrant_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boxes that a search that shows 40 points at most is asked for, quartered three times at most."""
    k = F.col("k")
    points = _customers(spark, sf_dir).select(((k % 37).cast("double") / 4).alias("lat"), ((k * 7 % 53).cast("double") / 4).alias("lng"))
    return registries.quadrants(points, (0.0, 16.0, 0.0, 16.0), page=40, depth=3)


# captured maps and answers


@query("""SELECT 'app' || c_custkey AS item_id, CASE WHEN c_custkey % 3 = 2 THEN 'https://m' || c_custkey || '/b' ELSE CASE WHEN c_custkey % 4 = 0 THEN 'https://a' ELSE 'https://b' END || c_custkey || '/FeatureServer/0' END AS layer
FROM customer WHERE c_custkey <= 200 AND NOT (c_custkey % 5 = 0 AND c_custkey % 3 <> 2)""".replace("CASE WHEN c_custkey % 4 = 0 THEN 'https://a' ELSE 'https://b' END", "CASE WHEN c_custkey % 4 = 0 THEN 'https://a' ELSE 'https://c' END"))
def map_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first layer with records of each map application, also of those that nest their map."""
    k = F.col("k")
    c = _customers(spark, sf_dir).filter("k <= 200")
    own = _text('{"operationalLayers": [{"title": "no address"}, {"url": "https://a', k, '/FeatureServer/0"}, {"url": "https://c', k, '/FeatureServer/0"}]}')
    nests = _text('{"map": {"itemId": "map', k, '"}}')
    maps = _text('{"operationalLayers": [{"url": ""}, {"url": "https://m', k, '/a"}, {"url": "https://m', k, '/b"}]}')
    items = c.select(_text("app", k).alias("item_id"), F.when(k % 3 == 2, nests).otherwise(own).alias("content")).unionByName(c.filter("k % 3 = 2").select(_text("map", k).alias("item_id"), maps.alias("content")))
    filled = c.select(F.when(k % 3 == 2, _text("https://m", k, "/b")).when(k % 5 != 0, F.when(k % 4 == 0, _text("https://a", k, "/FeatureServer/0")).otherwise(_text("https://c", k, "/FeatureServer/0"))).alias("layer")).filter("layer is not null")
    return layers.first_filled(layers.app_layers(c.select(_text("app", k).alias("item_id")), items), filled)


@query("SELECT 'i' || c_custkey AS item_id, 'https://s.example.com/Authorized_to_open_' || c_custkey || '/FeatureServer' AS layer FROM customer WHERE c_custkey % 3 <> 0")
def named_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The layer of a certain name among an application's data sources."""
    k = F.col("k")
    child = lambda name: _text('{"url": "https://s.example.com/', name, "_", k, '/FeatureServer"}')
    content = _text('{"dataSources": {"d1": {"childDataSourceJsons": {"x": ', child("Cancelled"), '}}, "d2": {}, "d3": {"childDataSourceJsons": {"y": ', child("Public_notice"), ', "z": ', F.when(k % 3 == 0, child("In_progress")).otherwise(child("Authorized_to_open")), "}}}}")
    return layers.named_layer(_customers(spark, sf_dir).select(_text("i", k).alias("item_id"), content.alias("content")))


@query("""SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'app' || c_custkey END AS item_id, c_custkey % 3 = 0 AS service, CASE WHEN c_custkey % 3 = 0 THEN 'https://g.example.com/x/FeatureServer/' || CASE WHEN c_custkey % 2 = 0 THEN '4' ELSE '0' END || '/query?where=' || CASE WHEN c_custkey % 2 = 0 THEN 'kind%3D1' ELSE '1=1' END || '&outFields=*&f=json&returnGeometry=false&resultRecordCount=500&resultOffset=' END AS query FROM customer""")
def layer_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an address of a map leads to, and how a layer's pages are asked for."""
    k = F.col("k")
    url = F.when(k % 3 == 0, F.when(k % 2 == 0, "https://g.example.com/x/FeatureServer/4?where=kind%3D1").otherwise("https://g.example.com/x/FeatureServer/")).otherwise(_text("https://g.example.com/apps/webappviewer/index.html?a=1&id=app", k))
    rows = layers.layer_query(layers.item_of(_customers(spark, sf_dir).withColumn("url", url)), 500, "url")
    return rows.select("k", "item_id", "service", F.when(F.col("service"), F.col("query")).alias("query"))


@query("""SELECT c_custkey AS k, o AS ordinal, CASE o WHEN 0 THEN 'Shop ' || c_custkey END AS name, CASE o WHEN 1 THEN '1 Main St' END AS address FROM customer, (SELECT unnest([0, 1]) AS o) x WHERE c_custkey % 4 < 2""")
def model_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places in the answers of an extraction model, whatever shape they came in."""
    k = F.col("k")
    both = _text('[{"name": "Shop ', k, '"}, {"address": "1 Main St"}, "loose", 7]')
    content = F.when(k % 4 == 0, both).when(k % 4 == 1, _text('{"locations": ', both, "}")).when(k % 4 == 2, '{"locations": "none"}').otherwise("sorry")
    return layers.model_locations(_customers(spark, sf_dir).withColumn("content", content)).select("k", "ordinal", "name", "address")


_HTML = ("<p><a class='x result__a' href='https://duckduckgo.com/l/?uddg=https%3A%2F%2Fs", ".example.com%2Fhome&rut=1'>One <b>shop</b></a> <a class=\"result__a\" href=\"https://t", ".example.com/\">Two</a></p>")


@query("""SELECT k, o AS ordinal, CASE o WHEN 1 THEN 'https://s' || k || '.example.com/home' WHEN 2 THEN 'https://t' || k || '.example.com/' END AS href, false AS blocked FROM (SELECT c_custkey AS k FROM customer WHERE c_custkey % 6 = 0) a, (SELECT unnest([1, 2]) AS o) b
UNION ALL SELECT c_custkey, NULL, NULL, c_custkey % 6 <> 5 AND c_custkey % 6 <> 4 FROM customer WHERE c_custkey % 6 <> 0""")
def search_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of captured search pages; a challenge, a refusal or a page of next to no links is blocked, not empty."""
    k = F.col("k")
    fine = _text(_HTML[0], k, _HTML[1], k, _HTML[2])
    many = F.lit("".join(f"<a href='/p{i}'>p</a>" for i in range(6)))
    html = F.when(k % 6 == 2, _text(fine, "<p>Please complete the following challenge</p>")).when(k % 6 == 3, "<a href='/only'>one</a>").when(k % 6 == 5, many).otherwise(fine)
    status = F.when(k % 6 == 1, 202).when(k % 6 == 4, 500).otherwise(200)
    return discovery.search_results(_customers(spark, sf_dir).select("k", html.alias("html"), status.alias("http_status"))).select("k", "ordinal", "href", "blocked")


@query("""SELECT c_custkey AS k, 'https://gov.example.com/files/retailers-excel-' || c_custkey || '.xlsx' AS href FROM customer WHERE c_custkey % 5 <> 0""")
def rotating_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The address of a list that moves each month, found on its page."""
    k = F.col("k")
    html = F.when(k % 5 == 0, "<a href='/files/other.xlsx'>x</a>").otherwise(_text("<a href='/files/other.pdf'>x</a><A HREF='files/retailers-excel-", k, ".xlsx#sheet'>list</A><a href='files/retailers-excel-old.xlsx'>old</a>"))
    return layers.rotating_link(_customers(spark, sf_dir).select("k", F.lit("https://gov.example.com/start").alias("url"), html.alias("html")), r"retailers-excel[^\"]*\.xlsx").select("k", "href")


# links of pages

_STRONG, _MEDIUM, _DENY = ["store locator"], ["directory", "list"], ["privacy"]


@query("""SELECT c_custkey AS k, href, score, label, kind FROM customer, LATERAL (SELECT unnest([
  {'href': 'https://h.example.com/a/stores-' || c_custkey || '.pdf', 'score': 7, 'label': 'Store locator', 'kind': 'pdf'}, {'href': 'https://h.example.com/dir?x=1', 'score': 3, 'label': 'Directory list', 'kind': 'html'},
  {'href': 'https://other.example.org/list', 'score': 1, 'label': 'Here & now', 'kind': 'html'}]) AS r), LATERAL (SELECT r.href AS href, r.score AS score, r.label AS label, r.kind AS kind)""".replace("'score': 3, 'label': 'Directory list'", "'score': 4, 'label': 'Directory list'"))
def link_harvest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The addresses that look like lists on a page: quotes of either kind, labels with tags, relative links, each address once; anchors in the page, mail and scripts are none."""
    k = F.col("k")
    html = _text(
        "<a href='stores-", k, ".pdf'>Store <b>locator</b></a><a href=\"/a/stores-", k, ".pdf#page2\">store</a><a href='#top'>store locator</a><a href='mailto:a@b.c'>directory</a><a href=\"javascript:list()\">list</a>"
        "<a href='../dir?x=1#f'>Directory\n list</a><A HREF=https://other.example.org/list>Here &amp; now</A><a href='/privacy'>privacy list</a><a href='ftp://x/list'>list</a><a>list</a><a href='/plain'>nothing</a>",
    )
    pages = _customers(spark, sf_dir).select("k", F.lit("https://h.example.com/a/b.html").alias("url"), html.alias("html"))
    return extract.harvest(pages, "url", _STRONG, _MEDIUM, _DENY).select("k", "href", "score", F.regexp_replace("label", r"\s+", " ").alias("label"), "kind")


# profiles and reports


@query("""SELECT p_partkey AS product_id, CASE WHEN p_partkey % 3 = 0 THEN 'a=3,b=2,c=2' WHEN p_partkey % 3 = 1 THEN 'c=5' ELSE '' END AS profile FROM part""")
def terpene_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles from the greatest value down."""
    k = F.col("p_partkey")
    one = lambda n, v: F.struct(F.lit(n).alias("name"), F.lit(v).alias("value"))
    std = F.when(k % 3 == 0, F.array(one("c", 2.0), one("a", 3.0), one("b", 2.0))).when(k % 3 == 1, F.array(one("c", 5.0))).otherwise(F.array().cast("array<struct<name:string,value:double>>"))
    text = F.array_join(F.transform(P.by_value(std), lambda x: F.concat(x["name"], F.lit("="), x["value"].cast("int").cast("string"))), ",")
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(k.alias("product_id"), text.alias("profile"))


@query("""SELECT p_partkey AS product_id, 3.5::DOUBLE AS size_g, CASE WHEN p_partkey % 2 = 0 THEN 5.0::DOUBLE END AS terp_total, p_partkey % 3 = 0 AS potency_implausible, round(floor(p_retailprice) / 3.5, 2)::DOUBLE AS price_per_g FROM part""")
def enriched_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that is derived from a listing's variants, terpenes and potency, in one step."""
    k = F.col("p_partkey")
    variant = lambda o, p: F.struct(F.lit(o).alias("option"), p.cast("double").alias("price"), F.lit(None).cast("double").alias("original_price"))
    t = lambda n, v: F.struct(F.lit(n).alias("name"), F.lit(v).alias("value"), F.lit("%").alias("unit"))
    part = spread(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_retailprice"), "p_partkey")
    rows = part.select(
        k.alias("product_id"), F.lit("Flower").alias("category_std"), F.when(k % 3 == 0, 2.0).otherwise(20.0).alias("thc"), F.lit(None).cast("double").alias("cbd"),
        F.array(variant("7g", F.floor("p_retailprice") * 2), variant("1/8 oz", F.floor("p_retailprice")), variant("each", F.floor("p_retailprice"))).alias("variants"),
        F.when(k % 2 == 0, F.array(t("Myrcene", 3.0), t("limonene", 2.0))).otherwise(F.array(t("Myrcene", 0.0))).alias("terpenes"),
    )
    out = P.enrich_record(rows, fields=["price", "original_price"])
    return out.select("product_id", "size_g", "terp_total", "potency_implausible", F.element_at(F.col("variants")["price_per_g"], 2).alias("price_per_g"))


@query(f"""SELECT n_name AS state, n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'pdf' ELSE '-' END AS list_type, coalesce(c, 0) AS records FROM nation LEFT JOIN (SELECT state, count(*) AS c FROM {_STORES} s WHERE id % 10 = 0 GROUP BY 1) r ON r.state = n_name""")
def extract_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_name").alias("abbr"), F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 2 == 0, "pdf").alias("list_type"))
    return discovery.extract_report(adapters.read(spark, sf_dir, "stores").filter("id % 10 = 0"), programs=n)


@query("""SELECT status, list_type, count(*) AS n, count(u) AS with_list FROM (SELECT CASE WHEN n_nationkey % 5 = 0 THEN 'override' WHEN n_nationkey % 3 = 0 THEN 'stored' WHEN n_nationkey % 7 = 0 THEN 'no-landing' WHEN n_nationkey % 2 = 0 THEN 'found' ELSE 'none' END AS status,
  CASE WHEN n_nationkey % 5 = 0 THEN 'pdf' WHEN n_nationkey % 3 = 0 THEN 'csv' WHEN n_nationkey % 2 = 0 THEN 'html' ELSE '-' END AS list_type, CASE WHEN n_nationkey % 5 = 0 OR n_nationkey % 3 = 0 OR n_nationkey % 2 = 0 THEN 1 END AS u FROM nation) x GROUP BY ALL""".replace("WHEN n_nationkey % 7 = 0 THEN 'no-landing' WHEN n_nationkey % 2 = 0 THEN 'found'", "WHEN n_nationkey % 7 = 0 THEN 'no-landing' WHEN n_nationkey % 2 = 0 THEN 'found'"))
def list_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where jurisdictions' lists come from."""
    k = F.col("n_nationkey")
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    programs = n.select(F.col("n_name").alias("abbr"), F.when(k % 5 == 0, "https://x.gov/a.pdf").alias("override_url"), F.when(k % 3 == 0, "https://x.gov/a.csv").alias("list_url"), F.lit("found").alias("list_status"), F.when(k % 7 != 0, "https://x.gov").alias("best_url"))
    found = n.filter("n_nationkey % 2 = 0").select(F.col("n_name").alias("abbr"), F.lit("https://x.gov/list").alias("list_url"), F.lit("html").alias("list_type"))
    return discovery.list_report(discovery.settle_lists(programs, found))


@query("SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'CA' ELSE 'US' END AS country, CASE WHEN n_nationkey % 3 = 0 THEN 'pdf' ELSE '-' END AS source_type, 'never' AS check_status, count(*) AS n, count(*) FILTER (WHERE n_nationkey % 4 = 0) AS with_url FROM nation GROUP BY ALL")
def coverage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    return discovery.coverage_report(n.select(F.when(k % 2 == 0, "CA").otherwise("US").alias("country"), F.when(k % 3 == 0, "pdf").alias("source_type"), F.lit(None).cast("string").alias("check_status"), F.when(k % 4 == 0, "u").alias("best_url")))


@query("""SELECT id, CASE WHEN n = 1 THEN 'Alias of ' || town END AS pin FROM (SELECT s_suppkey AS id, 'Town' || cast(s_suppkey % 60 AS VARCHAR) AS town, count(*) OVER (PARTITION BY s_suppkey % 60) AS n FROM supplier) x WHERE n = 1 AND id % 60 % 2 = 0""".replace("'Alias of ' || town", "'The ' || town || ' shop'"))
def pinned_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores whose town stands in the name of another company of their operator, if they are the only ones."""
    k = F.col("s_suppkey")
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    kept = s.select(k.alias("id"), _text("town", k % 60).alias("city"), F.lit(1).cast("long").alias("operator"))
    companies = spark.range(0, 60).select((F.col("id") + 2).alias("company_id"), _text("The Town", F.col("id"), " shop").alias("company_name"), F.lit(1).cast("long").alias("operator"), F.when(F.col("id") % 2 == 0, 9).otherwise(1).alias("n_stores"), F.lit(5).alias("operator_stores"))
    return resolve.pinned_aliases(kept, companies)
