"""Queries over logs: observations, exchange rates, snapshots, access attempts, jobs, lifecycles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfspark import adapters
from shelfspark.catalog import query
from shelfspark.operators import history as H
from shelfspark.operators import states as S

_OBS, _ATTEMPTS, _JOBS, _RATES, _PROGRAMS, _STORES, _LISTINGS = (f"({adapters.duckdb(n)})" for n in ("observations", "attempts", "jobs", "rates", "programs", "stores", "listings"))
#: The moment that queries are asked about; wall clocks are never read.
AS_OF = "2024-02-01 00:00:00"


def _read(name: str):
    return lambda spark, sf_dir: adapters.read(spark, sf_dir, name)


observations, attempts, jobs, rates = map(_read, ("observations", "attempts", "jobs", "rates"))


@query(f"SELECT store, product, id, price, thc, scraped_at FROM (SELECT *, row_number() OVER (PARTITION BY store, product ORDER BY scraped_at DESC, id DESC) AS rn FROM {_OBS} o) x WHERE rn = 1")
def latest_observation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.latest(observations(spark, sf_dir), ["store", "product"]).select("store", "product", "id", "price", "thc", "scraped_at")


@query(f"""SELECT product, count(*) AS stores, min(first_seen) AS first_seen, max(last_seen) AS last_seen, round(avg(price), 4) AS avg_latest_price FROM (
  SELECT product, store, min(scraped_at) AS first_seen, max(scraped_at) AS last_seen, max_by(coalesce(price, -1), scraped_at) AS p0, CASE WHEN max_by(coalesce(price, -1), epoch_us(scraped_at) * 1000000 + id) = -1 THEN NULL ELSE max_by(coalesce(price, -1), epoch_us(scraped_at) * 1000000 + id) END AS price
  FROM {_OBS} o GROUP BY product, store) x GROUP BY product""".replace("epoch_us(scraped_at) * 1000000 + id", "(scraped_at, id)"))
def product_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = H.identities(observations(spark, sf_dir), ["product", "store"])
    last = H.latest(observations(spark, sf_dir), ["product", "store"]).select("product", "store", "price")
    return seen.join(last, ["product", "store"]).groupBy("product").agg(F.count(F.lit(1)).alias("stores"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.round(F.avg("price"), 4).alias("avg_latest_price"))


@query(f"""SELECT id, store, product, reason FROM (SELECT *, CASE WHEN prev IS NULL THEN 'first' WHEN cast(prev AS DATE) <> cast(scraped_at AS DATE) THEN 'new_day' WHEN pp IS DISTINCT FROM price OR pt IS DISTINCT FROM thc THEN 'changed' END AS reason
  FROM (SELECT *, lag(scraped_at) OVER w AS prev, lag(price) OVER w AS pp, lag(thc) OVER w AS pt FROM {_OBS} o WINDOW w AS (PARTITION BY store, product ORDER BY scraped_at, id)) x) y WHERE reason IS NOT NULL""")
def observation_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of a stream of scrapes is written: the first of a product at a store, one of each UTC day, and every change."""
    return H.to_append(observations(spark, sf_dir), ["store", "product"], ["price", "thc"]).select("id", "store", "product", "reason")


_DAYS = f"(SELECT cast(unnest(generate_series(min(rate_date), max(rate_date) + 3, INTERVAL 1 DAY)) AS DATE) AS rate_date FROM {_RATES} r)"
_FILLED = f"""(SELECT rate_date, 'CAD' AS base_ccy, 'USD' AS quote_ccy, round(last_value(r.rate IGNORE NULLS) OVER (ORDER BY rate_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS rate, r.rate IS NULL AS is_carried
  FROM {_DAYS} d LEFT JOIN {_RATES} r USING (rate_date))"""


def filled_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.forward_fill(rates(spark, sf_dir), extra_days=3)


@query(f"SELECT * FROM {_FILLED} f")
def fx_forward_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filled_rates(spark, sf_dir)


@query(f"""SELECT o.id, CASE WHEN p.country = 'CA' THEN 'CAD' ELSE 'USD' END AS currency, CASE WHEN p.country IS DISTINCT FROM 'CA' THEN 1.0::DOUBLE ELSE f.rate END AS fx_rate,
  CASE WHEN p.country IS DISTINCT FROM 'CA' THEN o.price ELSE round(o.price * f.rate, 2) END AS price_usd
FROM {_OBS} o LEFT JOIN {_PROGRAMS} p ON p.abbr = o.state LEFT JOIN {_FILLED} f ON f.base_ccy = CASE WHEN p.country = 'CA' THEN 'CAD' ELSE 'USD' END AND f.quote_ccy = 'USD' AND f.rate_date = cast(o.scraped_at AS DATE)""")
def observations_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.with_usd(observations(spark, sf_dir), adapters.read(spark, sf_dir, "programs"), filled_rates(spark, sf_dir)).select("id", "currency", "fx_rate", "price_usd")


@query(f"""SELECT min(rate_date) AS first_date, max(rate_date) AS last_date, count(*) AS n, count(*) FILTER (WHERE is_carried) AS n_carried, max_by(rate, rate_date) AS latest_rate,
  least((SELECT min(cast(scraped_at AS DATE)) FROM {_OBS} o WHERE price IS NOT NULL), (SELECT min(cast(scraped_at AS DATE)) FROM {_LISTINGS} l WHERE price IS NOT NULL)) AS backfill_start FROM {_FILLED} f""")
def fx_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = filled_rates(spark, sf_dir).agg(F.min("rate_date").alias("first_date"), F.max("rate_date").alias("last_date"), F.count(F.lit(1)).alias("n"), F.count_if("is_carried").alias("n_carried"), F.max_by("rate", "rate_date").alias("latest_rate"))
    first = lambda df, name: df.filter("price is not null").agg(F.min(F.to_date("scraped_at")).alias(name))
    starts = first(observations(spark, sf_dir), "a").crossJoin(first(adapters.read(spark, sf_dir, "listings"), "b")).select(F.least("a", "b").alias("backfill_start"))
    return own.crossJoin(starts)  # one row each


@query(f"SELECT DISTINCT CASE WHEN country = 'CA' THEN 'CAD' ELSE 'USD' END AS currency FROM {_PROGRAMS} p WHERE country = 'CA'")
def currencies_to_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.read(spark, sf_dir, "programs").select(H.currency(F.col("country")).alias("currency")).filter("currency != 'USD'").distinct()


@query(f"""SELECT store, max(scraped_at) AS latest, round(epoch(TIMESTAMP '{AS_OF}' - max(scraped_at)) / 3600, 3) AS age_hours, TIMESTAMP '{AS_OF}' - max(scraped_at) <= INTERVAL 48 HOUR AS fresh FROM {_OBS} o GROUP BY store""")
def freshness_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.freshness(observations(spark, sf_dir), ["store"], AS_OF, 48)


@query(f"""WITH d AS (SELECT store, cast(scraped_at AS DATE) AS day, count(*) AS n, max(scraped_at) AS seen FROM {_OBS} o GROUP BY ALL)
SELECT store, day, n, prior, CASE WHEN prior IS NULL THEN 'replace' WHEN n < prior * 0.5 AND epoch(seen - prior_at) < 48 * 3600 THEN 'keep' ELSE 'replace' END AS verdict
FROM (SELECT *, lag(n) OVER w AS prior, lag(seen) OVER w AS prior_at FROM d WINDOW w AS (PARTITION BY store ORDER BY day)) x""")
def snapshot_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each day's scrape of a store against the one before: under half of a snapshot younger than 48 hours doesn't replace it."""
    days = observations(spark, sf_dir).groupBy("store", F.to_date("scraped_at").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.max("scraped_at").alias("at"))
    w = Window.partitionBy("store").orderBy("day")
    d = days.withColumns({"prior": F.lag("n").over(w), "prior_at": F.lag("at").over(w)})
    hours = (F.unix_micros(F.col("at").cast("timestamp")) - F.unix_micros(F.col("prior_at").cast("timestamp"))) / 3.6e9
    return d.select("store", "day", "n", "prior", H.snapshot_verdict(F.col("prior"), F.col("n"), hours).alias("verdict"))


_BEST = """SELECT company_id, state, count(*) FILTER ({w}) AS rows, count(DISTINCT CASE WHEN {c} THEN lower(coalesce(nullif(trim(address), ''), name, '')) END) AS stores,
  count(DISTINCT CASE WHEN {c} AND external_id <> '' AND coalesce(source, '') <> 'aggregator' AND coalesce(platform, '') NOT IN ('leafly', 'weedmaps') THEN lower(coalesce(nullif(trim(address), ''), name, '')) END) AS menus,
  count(*) FILTER (WHERE {c} AND external_id <> '') AS handles FROM {s} s GROUP BY company_id, state"""


@query(f"""SELECT company_id, state, CASE WHEN n.rows = 0 THEN 'keep' WHEN n.menus < o.menus THEN 'keep' WHEN n.menus > o.menus THEN CASE WHEN n.stores >= o.stores * 0.5 THEN 'replace' ELSE 'keep' END
  WHEN n.stores >= o.stores THEN 'replace' WHEN o.handles = 0 AND n.handles > 0 AND n.stores >= o.stores * 0.8 THEN 'replace' ELSE 'keep' END AS verdict
FROM ({_BEST.format(w='WHERE id % 2 = 0', c='id % 2 = 0', s=_STORES)}) o JOIN ({_BEST.format(w='WHERE id % 2 = 1', c='id % 2 = 1', s=_STORES)}) n USING (company_id, state)""")
def keep_the_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a company's new rows replace the stored ones: menus count first, then stores, then a gain of handles."""
    stores = adapters.read(spark, sf_dir, "stores")
    return H.keep_the_best(stores.filter("id % 2 = 0"), stores.filter("id % 2 = 1"), ["company_id", "state"])


@query(f"SELECT method, status, count(*) AS n FROM {_ATTEMPTS} a GROUP BY ALL")
def access_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = attempts(spark, sf_dir).groupBy("method", "status").agg(F.count(F.lit(1)).alias("n"))
    return n.orderBy(S.severity(F.col("status")), F.desc("n"), "method")


_FOLD = f"""(SELECT target_key, method, max_by(cost_rank, seq) AS cost_rank, max_by(status, (attempted_at, seq)) AS status, max_by(coalesce(record_count, -1), (attempted_at, seq)) AS record_count, count(*) AS attempts,
  max(attempted_at) FILTER (WHERE status = 'ok') AS last_ok_at, max(attempted_at) FILTER (WHERE status NOT IN ('ok', 'never')) AS last_fail_at,
  nullif(max_by(CASE WHEN status = 'ok' THEN coalesce(resource_url, last_url) ELSE coalesce(resource_url, '') END, (attempted_at, seq)), '') AS resource_url
FROM (SELECT *, coalesce(last_value(CASE WHEN status = 'ok' THEN resource_url ELSE coalesce(resource_url, '') END IGNORE NULLS) OVER (PARTITION BY target_key, method ORDER BY attempted_at, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS last_url FROM {_ATTEMPTS} a) x GROUP BY target_key, method)"""


@query(f"SELECT target_key, method, cost_rank, status, record_count, attempts, last_ok_at, last_fail_at, resource_url FROM {_FOLD} f")
def access_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.fold_attempts(attempts(spark, sf_dir)).drop("target_type")


@query(f"""SELECT f.target_key, w.method AS winner, count(*) FILTER (WHERE f.cost_rank < w.cost_rank) AS cheaper_tried, w.cost_rank - count(*) FILTER (WHERE f.cost_rank < w.cost_rank) > 0 AS cheaper_untried
FROM {_FOLD} f JOIN (SELECT target_key, min_by(method, cost_rank) AS method, min(cost_rank) AS cost_rank FROM {_FOLD} g WHERE status = 'ok' GROUP BY target_key) w USING (target_key) GROUP BY f.target_key, w.method, w.cost_rank""")
def access_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest method that works for each target, and whether a cheaper one of the ladder was never tried."""
    fold = S.fold_attempts(attempts(spark, sf_dir))
    win = S.winners(fold).select("target_key", F.col("method").alias("winner"), F.col("cost_rank").alias("rank"))
    tried = fold.join(win, "target_key").groupBy("target_key", "winner", "rank").agg(F.count_if(F.col("cost_rank") < F.col("rank")).alias("cheaper_tried"))
    return tried.select("target_key", "winner", "cheaper_tried", (F.col("rank") - F.col("cheaper_tried") > 0).alias("cheaper_untried"))


@query(f"""SELECT target_key, method, round(CASE WHEN age < 10 THEN 0 WHEN age >= 20 THEN 1 ELSE 0.6 * (age - 10) / 10 END, 6) AS probability
FROM (SELECT target_key, method, epoch(TIMESTAMP '{AS_OF}' - last_ok_at) / 86400 AS age FROM {_FOLD} f WHERE last_ok_at IS NOT NULL) x""")
def rewalk_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = S.fold_attempts(attempts(spark, sf_dir)).filter("last_ok_at is not null")
    age = (F.unix_micros(F.lit(AS_OF).cast("timestamp")) - F.unix_micros(F.col("last_ok_at").cast("timestamp"))) / 86400e6
    return fold.select("target_key", "method", F.round(S.age_probability(age, 10.0, 20.0), 6).alias("probability"))


@query(f"""
WITH RECURSIVE w AS (SELECT regexp_replace(regexp_extract(resource_url, '^[a-z]+://([^/?#]*)', 1), '^www\\.', '') AS host, seq, cast(seq % 40 AS DOUBLE) AS age, cast(seq * 37 % 100 AS DOUBLE) / 100 AS u, row_number() OVER (PARTITION BY regexp_replace(regexp_extract(resource_url, '^[a-z]+://([^/?#]*)', 1), '^www\\.', '') ORDER BY seq) AS k FROM {_ATTEMPTS} a WHERE resource_url IS NOT NULL),
c AS (SELECT *, CASE WHEN age < 25 THEN 0.0 WHEN age >= 35 THEN 1.0 ELSE 0.6 * (age - 25) / 10 END AS p FROM w),
r AS (SELECT host, seq, k, u < p AS admitted, CASE WHEN u < p THEN 1 ELSE 0 END AS n FROM c WHERE k = 1
  UNION ALL SELECT c.host, c.seq, c.k, c.u < c.p * f.f, r.n + CASE WHEN c.u < c.p * f.f THEN 1 ELSE 0 END FROM r JOIN c ON c.host = r.host AND c.k = r.k + 1, LATERAL (SELECT CASE WHEN r.n >= 8 THEN 0.0 WHEN r.n >= 3 THEN 1.0 - (r.n - 2) / 6.0 ELSE 1.0 END AS f) f)
SELECT host, seq, admitted FROM r""")
def rewalk_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which walks a governor admits, in order: an ordered fold for each host."""
    a = attempts(spark, sf_dir).filter("resource_url is not null")
    walks = a.select(S.host_of(F.col("resource_url")).alias("host"), "seq", (F.pmod(F.col("seq"), F.lit(40)).cast("double")).alias("age"), (F.pmod(F.col("seq") * 37, F.lit(100)) / 100).alias("u"))
    return S.admit(walks)


@query(f"SELECT id, target_key FROM {_JOBS} j WHERE status = 'pending' AND scheduled_at <= TIMESTAMP '1996-01-01' AND target_key LIKE '1%'")
def queue_claimable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.claimable(jobs(spark, sf_dir), "1996-01-01", "1%").select("id", "target_key").orderBy("id")


@query(f"""SELECT id, CASE WHEN attempts < max_attempts THEN 'pending' ELSE 'failed' END AS status, CASE WHEN attempts < max_attempts THEN NULL ELSE 'lease expired' END AS error
FROM {_JOBS} j WHERE status = 'claimed' AND coalesce(lease_until, claimed_at) < TIMESTAMP '1996-01-01'""")
def queue_reap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.reap(jobs(spark, sf_dir), "1996-01-01").select("id", "status", "error")


@query(f"""SELECT min(id) AS id, task_type, target_key FROM {_JOBS} j WHERE id % 2 = 1 AND (task_type, target_key) NOT IN (SELECT task_type, target_key FROM {_JOBS} k WHERE id % 2 = 0 AND status IN ('pending', 'claimed')) GROUP BY task_type, target_key""")
def queue_enqueue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New jobs whose target has none alive."""
    j = jobs(spark, sf_dir)
    return S.enqueue(j.filter("id % 2 = 0"), j.filter("id % 2 = 1"))


@query(f"""
WITH RECURSIVE r AS (SELECT user_id AS host, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, event_id, epoch_us(ts) / 1e6 AS t, 1.0::DOUBLE + event_id % 2 AS cost FROM events),
b AS (SELECT host, n, event_id, t AS last, CASE WHEN 3 >= cost THEN 3 - cost ELSE 3 END AS tokens, 3 >= cost AS granted FROM r WHERE n = 1
  UNION ALL SELECT r.host, r.n, r.event_id, CASE WHEN least(3, tokens + (t - last) / 86400) >= cost THEN t ELSE last END, CASE WHEN least(3, tokens + (t - last) / 86400) >= cost THEN least(3, tokens + (t - last) / 86400) - cost ELSE tokens END, least(3, tokens + (t - last) / 86400) >= cost
  FROM b JOIN r ON r.host = b.host AND r.n = b.n + 1)
SELECT event_id, host, granted FROM b""")
def token_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("host"), "event_id", F.col("ts").alias("at"), (1.0 + F.pmod("event_id", F.lit(2))).alias("cost"))
    return S.token_bucket(e, rate=1 / 86400, burst=3.0).select("event_id", "host", "granted")


@query(f"""
WITH seen AS (SELECT DISTINCT product AS source, store AS loc, cast(scraped_at AS DATE) AS day FROM {_OBS} o WHERE (store + day(scraped_at)) % 5 <> 0),
cyc AS (SELECT source, day, count(*) AS n FROM seen GROUP BY source, day),
us AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY day) AS u FROM (SELECT *, n >= 0.9 * coalesce(max(n) OVER (PARTITION BY source ORDER BY day ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), n) AS usable FROM cyc) x WHERE usable),
loc AS (SELECT source, loc, min(day) AS first_day, max(day) AS last_day FROM seen GROUP BY ALL),
j AS (SELECT l.*, (SELECT min(u.day) FROM us u WHERE u.source = l.source) AS u0, (SELECT count(*) FROM us u WHERE u.source = l.source AND u.day = l.first_day) AS fu, (SELECT count(*) FROM us u WHERE u.source = l.source AND u.day > l.last_day) AS missed FROM loc l)
SELECT source, loc, 'opened' AS kind, first_day AS occurred_on FROM j WHERE fu = 1 AND first_day > u0
UNION ALL SELECT source, loc, 'closed', last_day FROM j WHERE missed >= 2""")
def lifecycle_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Openings and closings of locations, judged by the usable cycles of each source."""
    o = observations(spark, sf_dir).filter((F.col("store") + F.dayofmonth("scraped_at")) % 5 != 0)
    return H.lifecycle(o.select(F.col("product").alias("source"), F.col("store").alias("loc"), F.to_date("scraped_at").alias("day")), missed=2, usable=0.9)


@query(f"""SELECT store, id, previous, operator FROM (SELECT store, id, operator, lag(operator) OVER (PARTITION BY store ORDER BY scraped_at, id) AS previous
  FROM (SELECT store, id, scraped_at, CASE product WHEN 'view' THEN 'zen' WHEN 'click' THEN 'zen leaf' ELSE product END AS operator FROM {_OBS} o) x) y
WHERE previous IS NOT NULL AND NOT starts_with(replace(operator, ' ', ''), replace(previous, ' ', '')) AND NOT starts_with(replace(previous, ' ', ''), replace(operator, ' ', ''))""")
def operator_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Another operator at a location; a name that only grew or shrank is the same one."""
    name = F.when(F.col("product") == "view", "zen").when(F.col("product") == "click", "zen leaf").otherwise(F.col("product"))
    return H.operator_changes(observations(spark, sf_dir).select("store", "id", "scraped_at", name.alias("operator")), ["store"]).select("store", "id", "previous", "operator")


@query("""WITH t AS (SELECT o_custkey AS k, max(o_orderdate) AS at, max_by(o_totalprice, (o_orderdate, o_orderkey)) AS v FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY ALL),
u AS (SELECT o_custkey AS k, max(o_orderdate) AS at, max_by(o_totalprice, (o_orderdate, o_orderkey)) AS v FROM orders WHERE o_orderkey % 3 = 0 GROUP BY ALL)
SELECT coalesce(t.k, u.k) AS k, greatest(t.at, u.at) AS at, coalesce(u.v, t.v) AS v FROM t FULL JOIN u ON t.k = u.k""")
def upsert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates written over a table by key, a rule for each column."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    last = lambda df: df.groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_orderdate").alias("at"), F.max_by("o_totalprice", F.struct("o_orderdate", "o_orderkey")).alias("v"))
    return H.upsert(last(o.filter("o_orderkey % 3 <> 0")), last(o.filter("o_orderkey % 3 = 0")), ["k"], {"at": "greatest", "v": "new"})
