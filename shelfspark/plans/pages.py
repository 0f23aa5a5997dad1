"""Queries over captured pages: links, classification, records, domains."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.catalog import query
from shelfspark.functions import text as X
from shelfspark.operators import discovery, guards
from shelfspark.sources import extract

EXCLUDED = ["example.net", "tracker."]
ENDINGS = ["", "shop", "store", "co"]
_LINKS = """(SELECT page_id, m.ord AS ordinal, regexp_extract(m.a, 'href="([^"]*)"', 1) AS href, trim(regexp_replace(regexp_extract(m.a, '>(.*)</a>', 1), '<[^>]*>', '', 'g')) AS label
FROM (SELECT page_id, unnest(list_transform(regexp_extract_all(html, '<a [^>]*href="[^"]*"[^>]*>[^<]*</a>'), lambda x, i: {'a': x, 'ord': i})) AS m FROM pages) x)"""


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.links(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html"))


@query(f"SELECT page_id, cast(ordinal AS BIGINT) AS ordinal, href, label FROM {_LINKS} l")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The anchors of captured pages, by an HTML parser; these pages are plain enough for an expression to find the same."""
    return links(spark, sf_dir).select("page_id", "ordinal", "href", "label")


_KIND = (
    "CASE WHEN ends_with({u}, '.pdf') OR contains({u}, '.pdf?') THEN 'pdf' WHEN regexp_matches({u}, '\\.(csv|xlsx?)(\\?|$)') THEN 'csv' WHEN contains({u}, 'kml') OR contains({u}, '/maps/d/') THEN 'kml' "
    "WHEN regexp_matches({u}, 'arcgis|socrata|tableau|webappviewer') THEN 'arcgis' WHEN regexp_matches({u}, '^[a-z]+://search\\.|lookup|verification|/search') THEN 'lookup' ELSE 'html' END"
)
_URL = "CASE page_id % 6 WHEN 0 THEN url || '.pdf' WHEN 1 THEN url || '/list.csv?x=1' WHEN 2 THEN url || '/map.KML' WHEN 3 THEN 'https://arcgis.example.com/' || page_id WHEN 4 THEN 'https://search.example.com/' || page_id ELSE url END"


@query(f"SELECT page_id, {_KIND.format(u=f'lower({_URL})')} AS kind FROM pages")
def link_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    k = F.pmod("page_id", F.lit(6))
    url = F.when(k == 0, F.concat("url", F.lit(".pdf"))).when(k == 1, F.concat("url", F.lit("/list.csv?x=1"))).when(k == 2, F.concat("url", F.lit("/map.KML"))).when(k == 3, F.concat(F.lit("https://arcgis.example.com/"), F.col("page_id").cast("string"))).when(k == 4, F.concat(F.lit("https://search.example.com/"), F.col("page_id").cast("string"))).otherwise(F.col("url"))
    return p.select("page_id", X.classify_url(url).alias("kind"))


_HOST = "regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), '^www\\.', '')"


@query(f"""SELECT host, count(*) AS n, bool_or(excluded) AS excluded, bool_or(is_brand) AS is_brand FROM (SELECT host, host = 'example.net' OR ends_with(host, '.example.net') OR starts_with(host, 'tracker.') OR contains(host, '.tracker.') AS excluded,
  contains(string_split(host, '.')[-3], 'thonth') AND starts_with(string_split(host, '.')[-3], 'thonth') AND string_split(host, '.')[-3][7:] IN ('', 'shop', 'store', 'co') OR contains(string_split(host, '.')[-3], 'thonth') AS is_brand FROM (SELECT {_HOST} AS host FROM pages) x) y GROUP BY host""")
def domain_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.regexp_replace(F.try_parse_url(F.col("url"), F.lit("HOST")), r"^www\.", "")
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select(host.alias("host"))
    label = F.try_element_at(F.split("host", r"\."), F.lit(-3))
    own = p.select("host", guards.domain_excluded(F.col("host"), EXCLUDED).alias("excluded"), guards.host_is_brand(F.lit("thonth"), label, ENDINGS).alias("is_brand"))
    return own.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.bool_or("excluded").alias("excluded"), F.bool_or("is_brand").alias("is_brand"))


_LABEL = f"string_split({_HOST}, '.')[-2]"
_RANK = f"""SELECT name, url, score, row_number() OVER (PARTITION BY name ORDER BY score DESC, length(rtrim(path, '/')), CASE WHEN starts_with(url, 'https:') THEN 0 ELSE 1 END, CASE WHEN ends_with(host, '.com') THEN 0 ELSE 1 END, url) AS rank FROM (
  SELECT name, url, host, path, CASE WHEN label = key OR (starts_with(label, key) AND label[len(key) + 1:] IN ('shop', 'co')) OR (len(key) >= 5 AND contains(label, key)) THEN 100 + n ELSE list_sum(list_transform(tokens, lambda t: CASE WHEN len(t) >= 5 AND contains(label, t) THEN 1 ELSE 0 END)) END AS score
  FROM (SELECT DISTINCT regexp_replace(url, '(thth|ther|tion|example)', 'acme\\1', 'g') AS url FROM pages WHERE url IS NOT NULL) p, LATERAL (SELECT regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), '^www\\.', '') AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path) h, LATERAL (SELECT coalesce(string_split(host, '.')[-2], host) AS label) l,
  (SELECT 'Acme-Example' AS name, 'acmeexample' AS key, ['acme', 'example'] AS tokens, 2 AS n UNION ALL SELECT 'Example Shop', 'exampleshop', ['example'], 1 UNION ALL SELECT 'Ex', 'ex', ['ex'], 1) b) x"""


@query(f"SELECT name, url, cast(score AS INTEGER) AS score, cast(rank AS INTEGER) AS rank FROM ({_RANK}) r WHERE rank <= 3 AND score >= 1")
def domain_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best homepages of each brand: its own domain, then domains with its words, then the shortest path, secure first, .com first."""
    brands = spark.createDataFrame([("Acme-Example",), ("Example Shop",), ("Ex",)], "name string")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").filter("url is not null").select(F.regexp_replace("url", "(thth|ther|tion|example)", "acme$1").alias("url")).distinct()
    return discovery.rank_homepages(pages.crossJoin(brands), ["shop"], ["shop", "co"], cap=3, least=1)


@query()
def page_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of captured pages: tables, else address blocks, else lines (an HTML parser in Arrow batches; no SQL equivalent)."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    block = F.concat(F.lit("<div><strong>Shop "), F.col("page_id").cast("string"), F.lit("</strong><br>12 Main St, Townsville, PA 17011</div>"))
    html = F.when(F.col("page_id") % 3 == 0, F.replace("html", F.lit("<article>"), F.concat(F.lit("<article>"), block))).otherwise(F.col("html"))
    return extract.page_records(p.select("page_id", html.alias("html")))
