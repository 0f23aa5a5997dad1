"""Domain inputs made of the star-schema tables, in SQL that Spark and DuckDB both read.

``{table}`` stands for a table, ``{@input}`` for another adapter.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_NAMES = ["Infused Flower", "Softgel 10 ct", "Live Resin Cart", "Moon Rock", "Troche", "5pk Pre Roll", "Sour Gummies", "Shake", "Disposable Pen", "Kief Cookie", "Balm", "Dry Sift Hash", "Popcorn Buds", "Rosin", "demo", "Gunpowder Tea", "Suppository"]
_RAW = ["Flower", "Pre-Rolls", "vape cartridges", "Concentrates", "EDIBLES", "Topical", "gear & apparel", "tinctures", "Soda", "mystery", "", "live resin cart"]
_OPTIONS = ["3.5g", "1/8 oz", "eighth_ounce", "5pk 0.5g", "100mg", "each", "1 oz", "Large", "2000g", "2 x 1g", "half_gram", "1 lb", "7 Grams", "0/8 oz"]
_STRAINS = ["Indica", "sativa-dominant", "HYBRID", "1:1 CBD", "n/a", ""]


def _pick(key: str, values: list[str], null_at: str = "") -> str:
    cases = " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(values))
    inner = f"CASE {key} % {len(values)} {cases} END"
    return f"CASE WHEN {null_at} THEN NULL ELSE {inner} END" if null_at else inner


SQL = {
    "programs": """
SELECT n.n_name AS abbr, r.r_name AS region, CASE WHEN n.n_regionkey % 2 = 0 THEN 'CA' ELSE 'US' END AS country,
  CASE WHEN n.n_nationkey % 7 = 0 THEN NULL WHEN n.n_nationkey % 2 = 0 THEN 'limited' ELSE 'open' END AS regime
FROM {nation} n JOIN {region} r ON n.n_regionkey = r.r_regionkey""",
    "listings": f"""
SELECT l.l_orderkey * 10 + l.l_linenumber AS listing_id, p.p_partkey AS product_id, l.l_suppkey AS company_id,
  'S' || cast(l.l_suppkey AS string) AS store_key, n.n_name AS state,
  CASE l.l_suppkey % 6 WHEN 0 THEN 'leafly' WHEN 1 THEN 'weedmaps' WHEN 2 THEN 'jane' WHEN 3 THEN 'dutchie' WHEN 4 THEN 'hytiva' END AS platform,
  'H' || cast(l.l_suppkey % 40 AS string) AS external_id,
  CASE WHEN p.p_partkey % 29 = 0 THEN NULL ELSE p.p_brand END AS brand,
  CASE WHEN p.p_partkey % 37 = 0 THEN NULL ELSE p.p_name || ' ' || {_pick('p.p_partkey', _NAMES)} END AS name,
  {_pick('p.p_size', _RAW, 'p.p_partkey % 23 = 0')} AS category,
  {_pick('p.p_partkey', _STRAINS, 'p.p_partkey % 31 = 0')} AS strain,
  {_pick('p.p_partkey', _OPTIONS, 'p.p_partkey % 41 = 0')} AS size_label,
  CASE WHEN p.p_partkey % 43 = 0 THEN NULL ELSE cast(floor(p.p_retailprice) AS double) END AS price,
  CASE WHEN p.p_partkey % 11 = 0 THEN NULL ELSE cast(p.p_partkey % 40 AS double) + 0.5 END AS thc,
  CASE WHEN p.p_partkey % 3 = 0 THEN NULL ELSE cast(p.p_partkey % 5 AS double) / 2 END AS cbd,
  CASE WHEN p.p_partkey % 13 = 0 THEN cast(p.p_size AS double) END AS thc_mg,
  CASE WHEN p.p_partkey % 17 = 0 THEN cast(p.p_size AS double) / 4 END AS cbd_mg,
  l.l_shipdate AS scraped_at
FROM {{lineitem}} l JOIN {{part}} p ON l.l_partkey = p.p_partkey JOIN {{supplier}} s ON l.l_suppkey = s.s_suppkey
  JOIN {{nation}} n ON s.s_nationkey = n.n_nationkey""",
    "products": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY listing_id) AS rn FROM ({@listings}) x) y WHERE rn = 1""",
    "stores": """
SELECT c.c_custkey AS id, c.c_custkey % 97 AS company_id, 'Shop ' || cast(c.c_custkey % 97 AS string) || CASE c.c_custkey % 5 WHEN 0 THEN ', LLC' WHEN 1 THEN ' Dispensary' WHEN 2 THEN ' Cannabis Co., Inc.' WHEN 3 THEN ' - Main St' ELSE ' Townsville' END AS canonical_name,
  n.n_name AS state, CASE c.c_custkey % 4 WHEN 0 THEN 'own' WHEN 1 THEN 'aggregator' ELSE 'menu' END AS source,
  'Shop ' || cast(c.c_custkey % 97 AS string) || ' No ' || cast(c.c_custkey % 7 AS string) AS name,
  CASE WHEN c.c_custkey % 19 = 0 THEN NULL ELSE cast(1 + c.c_custkey % 200 AS string) || CASE c.c_custkey % 20 WHEN 0 THEN ' Main Street, Suite 4' WHEN 1 THEN ' Stefko Boulevard' WHEN 2 THEN ' North Oak Ave.' WHEN 3 THEN '-12 Hillside Avenue' WHEN 4 THEN ' US-50 West' ELSE ' Elm Road #2' END END AS address,
  CASE WHEN c.c_custkey % 17 = 0 THEN NULL ELSE 'Townsville' END AS city,
  CASE c.c_custkey % 9 WHEN 0 THEN NULL WHEN 1 THEN 'p3e 4m8' WHEN 2 THEN 'P3E4M8' WHEN 3 THEN '17011-1234' ELSE cast(17000 + c.c_custkey % 50 AS string) END AS zip_code,
  CASE WHEN c.c_custkey % 6 = 0 THEN NULL ELSE 40.0 + cast(c.c_custkey % 300 AS double) / 4 END AS latitude,
  CASE WHEN c.c_custkey % 6 = 0 THEN NULL ELSE -75.0 - cast(c.c_nationkey AS double) / 2 END AS longitude,
  CASE c.c_custkey % 6 WHEN 0 THEN 'leafly' WHEN 1 THEN 'weedmaps' WHEN 2 THEN 'jane' WHEN 3 THEN 'dutchie' WHEN 4 THEN '' END AS platform,
  CASE WHEN c.c_custkey % 8 = 0 THEN NULL WHEN c.c_custkey % 8 = 1 THEN '' ELSE 'H' || cast(c.c_custkey % 400 AS string) END AS external_id,
  CASE WHEN c.c_custkey % 10 = 0 THEN c.c_custkey % 97 END AS canonical_company_id
FROM {customer} c JOIN {nation} n ON c.c_nationkey = n.n_nationkey""",
    "observations": """
SELECT e.event_id AS id, e.event_type AS product, e.user_id AS store, n.n_name AS state,
  CASE WHEN e.event_id % 11 = 0 THEN NULL ELSE cast(floor(e.value) AS double) END AS price,
  CASE WHEN e.event_id % 5 = 0 THEN NULL ELSE cast(e.event_id % 3 AS double) END AS thc, e.ts AS scraped_at
FROM {events} e JOIN {nation} n ON n.n_nationkey = e.user_id % 25""",
    "attempts": """
SELECT e.event_id AS seq, 'store' AS target_type, cast(e.user_id AS string) AS target_key, e.event_type AS method,
  CASE e.event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'signup' THEN 2 WHEN 'purchase' THEN 3 ELSE 4 END AS cost_rank,
  CASE e.event_id % 7 WHEN 0 THEN 'blocked' WHEN 1 THEN 'broken' WHEN 2 THEN 'failed' WHEN 3 THEN 'unavailable' ELSE 'ok' END AS status,
  CASE WHEN e.event_id % 3 = 0 THEN NULL ELSE 'https://h' || cast(e.user_id % 9 AS string) || '.example.com/' || e.event_type END AS resource_url,
  cast(e.event_id % 50 AS int) AS record_count, e.ts AS attempted_at
FROM {events} e""",
    "jobs": """
SELECT o.o_orderkey AS id, 'menu' AS task_type, cast(o.o_custkey AS string) AS target_key,
  CASE o.o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'pending' ELSE 'claimed' END AS status, cast(o.o_orderkey % 5 AS int) AS attempts, 3 AS max_attempts,
  o.o_orderdate AS scheduled_at, o.o_orderdate AS claimed_at, CASE WHEN o.o_orderkey % 3 = 0 THEN NULL ELSE o.o_orderdate + INTERVAL '30' MINUTE END AS lease_until
FROM {orders} o""",
    "rates": """
SELECT cast(e.ts AS date) AS rate_date, 'CAD' AS base_ccy, 'USD' AS quote_ccy, cast(count(*) % 40 + 60 AS double) / 100 AS rate
FROM {events} e WHERE day(e.ts) % 7 NOT IN (0, 6) GROUP BY cast(e.ts AS date)""",
}


def _expand(text: str, table) -> str:
    while m := re.search(r"\{@(\w+)\}", text):
        text = text.replace(m[0], SQL[m[1]].strip())
    return re.sub(r"\{(\w+)\}", lambda m: table(m[1]), text)


def duckdb(name: str) -> str:
    """The adapter as a subquery over the tables' names."""
    return _expand(SQL[name], lambda t: t).strip()


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The adapter over the Parquet tables of ``sf_dir``; only the columns asked of it are read."""
    return spark.sql(_expand(SQL[name], lambda t: f"parquet.`{sf_dir}/{t}.parquet`").strip())
