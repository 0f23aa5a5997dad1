"""Change-detected logs, snapshots and their guards, exchange rates, lifecycles, upserts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.functions.text import brand_key, day_of, fingerprint
from shelfspark.operators.spread import spread

CHANGED_HOURS, RETAIN, MENU_RETAIN, HANDLE_RETAIN = 48.0, 0.5, 0.5, 0.8


def latest(log: DataFrame, keys: list[str], at: str = "scraped_at", tie: str = "id") -> DataFrame:
    """The last row of each key; of equal times the higher ``tie``. An aggregate, so that rows are combined before the shuffle."""
    rest = [c for c in log.columns if c not in keys]
    row = F.max_by(F.struct(*rest), F.struct(at, tie)).alias("row")
    return log.groupBy(*keys).agg(row).select(*keys, "row.*")


def identities(log: DataFrame, keys: list[str], at: str = "scraped_at") -> DataFrame:
    return log.groupBy(*keys).agg(F.min(at).alias("first_seen"), F.max(at).alias("last_seen"))


def settled(df: DataFrame, field: str, prefix: str = "") -> Column:
    """A field in a form that compares: maps as sorted entries; empty maps and lists as null."""
    kind, c = df.schema[field].dataType, F.col(f"{prefix}{field}")
    if isinstance(kind, T.MapType):
        return F.when(F.size(c) > 0, F.array_sort(F.map_entries(c)))
    return F.when(F.size(c) > 0, c) if isinstance(kind, T.ArrayType) else c


def changed(df: DataFrame, fields: list[str], previous: str = "previous") -> Column:
    """Whether a field of ``df`` differs from the previous row's (settled) one; nulls are equal, and so are null and an empty list or map."""
    out = F.lit(False)
    for f in fields:
        out = out | ~settled(df, f).eqNullSafe(F.col(f"{previous}.{f}"))
    return out


def to_append(log: DataFrame, keys: list[str], fields: list[str], at: str = "scraped_at", tie: str = "id") -> DataFrame:
    """Rows to write, with the ``reason``: the first of a key, the first of a UTC day, a change. The session's time zone must be UTC."""
    w = Window.partitionBy(*keys).orderBy(at, tie)
    rows = log.withColumn("previous", F.lag(F.struct(at, *[settled(log, f).alias(f) for f in fields])).over(w))
    day = F.to_date(F.col(f"previous.{at}")) != F.to_date(at)
    reason = F.when(F.col("previous").isNull(), "first").when(day, "new_day").when(changed(log, fields), "changed")
    return rows.withColumn("reason", reason).filter("reason is not null").drop("previous")


def append_batch(stored: DataFrame, batch: DataFrame, keys: list[str], fields: list[str], at: str = "scraped_at", tie: str = "id") -> DataFrame:
    """Rows of a batch (its last of each key) that change the stored log."""
    now = latest(batch, keys, at, tie)
    return _news(stored, now, keys, fields, at, tie)


def _news(stored: DataFrame, now: DataFrame, keys: list[str], fields: list[str], at: str, tie: str) -> DataFrame:
    known = latest(stored, keys, at, tie).select(*keys, F.struct(at, *[settled(stored, f).alias(f) for f in fields]).alias("previous"))
    rows = now.join(known, keys, "left")
    new = F.col("previous").isNull() | (F.to_date(F.col(f"previous.{at}")) != F.to_date(at)) | changed(now, fields)
    return rows.filter(new).drop("previous")


#: Categories whose goods are observed over time, and what of an observation can change.
OBSERVED = ("Flower", "Pre-Roll", "Vape", "Concentrate", "Edible", "Beverage", "Tincture", "Topical", "Capsule")
OBSERVED_FIELDS = ["price", "thc", "cbd", "thc_mg", "cbd_mg", "terp_total", "terpenes_std", "cannabinoids_std"]


def observed(records: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """Records (store_key, brand, name, category_std, product_type_std, size_g, ...) of observed categories with their ``fingerprint``: of a product that a store lists twice the last, by ``ordinal``; none without a name."""
    key = fingerprint(*(F.col(c) for c in ("brand", "name", "size_g", "product_type_std", "thc_mg", "cbd_mg")))
    own = records.filter(F.col("category_std").isin(*OBSERVED)).withColumn("fingerprint", key).filter("fingerprint is not null")
    rest = [c for c in own.columns if c not in ("store_key", "fingerprint")]
    return own.groupBy("store_key", "fingerprint").agg(F.max_by(F.struct(*rest), ordinal).alias("r")).select("store_key", "fingerprint", "r.*")


def observed_products(products: DataFrame, records: DataFrame, as_of: str) -> DataFrame:
    """Identities of ``products`` (fingerprint, brand, ..., first_seen, last_seen) with those of ``records``: what is known stays as it was, but for ``last_seen``."""
    now = F.lit(as_of).cast("timestamp")
    own = ["category_std", "product_type_std", "obtention_std", "strain_type_std", "size_g"]
    seen = records.groupBy("fingerprint").agg(F.max_by(F.struct(brand_key(F.coalesce("brand", F.lit(""))).alias("brand"), "name", *own), F.struct("store_key", "ordinal")).alias("r"))
    new = seen.select("fingerprint", "r.*", now.alias("first_seen"), now.alias("last_seen"))
    return upsert(products, new, ["fingerprint"], {**dict.fromkeys(["brand", "name", *own, "first_seen"], "old"), "last_seen": "greatest"})


def record_observations(stored: DataFrame, records: DataFrame, as_of: str, fields: list[str] | None = None) -> DataFrame:
    """Rows to append to ``stored`` (store_key, fingerprint, scraped_at, fields): of ``observed(records)`` those that are new at their store, the day's first, or changed."""
    now = observed(records).withColumn("scraped_at", F.lit(as_of).cast("timestamp"))
    return _news(stored.withColumn("_tie", F.lit(0)), now, ["store_key", "fingerprint"], fields or OBSERVED_FIELDS, "scraped_at", "_tie")


LOCATION_FIELDS = ["operator", "storefront_name", "platform", "external_id", "address", "city"]


def upsert_locations(locations: DataFrame, batch: DataFrame, as_of: str) -> DataFrame:
    """Identities of places: first_seen stays, last_seen and the attributes follow the batch."""
    now = F.lit(as_of).cast("timestamp")
    own = ["state", "latitude", "longitude", "address", "city", "zip_code"]
    new = batch.select("location_key", *own, now.alias("first_seen"), now.alias("last_seen")).dropDuplicates(["location_key"])
    known = locations.select("location_key", F.struct("first_seen").alias("old"))
    kept = locations.join(new.select("location_key"), "location_key", "left_anti").select("location_key", *own, "first_seen", "last_seen")
    return kept.unionByName(new.join(known, "location_key", "left").select("location_key", *own, F.coalesce("old.first_seen", "first_seen").alias("first_seen"), "last_seen"))


def record_locations(stored: DataFrame, batch: DataFrame, source: str, as_of: str) -> DataFrame:
    """Rows to append to ``stored`` (location_key, source, observed_at, ``LOCATION_FIELDS``): of a batch's places those that are new to the source, the day's first, or changed."""
    now = batch.withColumns({"source": F.lit(source), "observed_at": F.lit(as_of).cast("timestamp")}).dropDuplicates(["location_key"])
    return _news(stored.filter(F.col("source") == source).withColumn("_tie", F.lit(0)), now, ["location_key", "source"], LOCATION_FIELDS, "observed_at", "_tie")


def currency(country: Column) -> Column:
    return F.when(country == "CA", "CAD").otherwise("USD")


def forward_fill(rates: DataFrame, extra_days: int = 0) -> DataFrame:
    """A row for each day from the first rate to ``extra_days`` after the last, with the last rate known; ``is_carried`` if it isn't the day's own."""
    span = rates.groupBy("base_ccy", "quote_ccy").agg(F.min("rate_date").alias("a"), F.date_add(F.max("rate_date"), extra_days).alias("b"))
    days = span.select("base_ccy", "quote_ccy", F.explode(F.sequence("a", "b")).alias("rate_date"))
    w = Window.partitionBy("base_ccy", "quote_ccy").orderBy("rate_date").rowsBetween(Window.unboundedPreceding, 0)
    filled = days.join(rates.select("base_ccy", "quote_ccy", "rate_date", "rate"), ["base_ccy", "quote_ccy", "rate_date"], "left")
    return filled.select("rate_date", "base_ccy", "quote_ccy", F.round(F.last("rate", ignorenulls=True).over(w), 6).alias("rate"), F.col("rate").isNull().alias("is_carried"))


def fill_between(rates: DataFrame, first: Column, last: Column) -> DataFrame:
    """``forward_fill`` from ``first`` to ``last``, expressions over nothing: rates of before fill the first days; days before any rate have no row."""
    until = rates.filter(F.col("rate_date") <= last)
    span = until.groupBy("base_ccy", "quote_ccy").agg(F.min("rate_date").alias("a"))
    days = span.select("base_ccy", "quote_ccy", F.explode(F.sequence(F.least("a", last), last)).alias("rate_date"))
    w = Window.partitionBy("base_ccy", "quote_ccy").orderBy("rate_date").rowsBetween(Window.unboundedPreceding, 0)
    filled = days.join(until.select("base_ccy", "quote_ccy", "rate_date", "rate"), ["base_ccy", "quote_ccy", "rate_date"], "left")
    out = filled.select("rate_date", "base_ccy", "quote_ccy", F.round(F.last("rate", ignorenulls=True).over(w), 6).alias("rate"), F.col("rate").isNull().alias("is_carried"))
    return out.filter((F.col("rate_date") >= first) & F.col("rate").isNotNull())


def backfill_start(*priced: DataFrame, at: str = "scraped_at"):
    """The earliest day with a price in any of the tables; None if there is none. ``at`` may be a time or an ISO text."""
    days = [df.filter("price is not null").agg(F.min(day_of(F.col(at).cast("string"))).alias("d")) for df in priced]
    return reduce(DataFrame.unionByName, days).agg(F.min("d")).first()[0]


def refresh_rates(stored: DataFrame, fetched: DataFrame, listings: DataFrame, observations: DataFrame, programs: DataFrame, today: str, since: str | None = None) -> DataFrame:
    """``stored`` rates with those of ``fetched`` from the first priced day (or ``since``) to ``today``, carried over days without one; ``stored`` as it is if no price is in another currency."""
    where = programs.select(F.col("abbr").alias("state"), "country")
    foreign = listings.filter("price is not null").join(where, "state").filter(currency(F.col("country")) != "USD")
    if not foreign.take(1):
        return stored
    start = since or backfill_start(listings, observations) or today
    # a week of rates from before the window: its first days may have to be carried
    near = fetched.filter(F.col("rate_date") >= F.date_sub(F.lit(str(start)).cast("date"), 7))
    new = fill_between(near, F.lit(str(start)).cast("date"), F.lit(today).cast("date"))
    return upsert(stored, new, ["rate_date", "base_ccy", "quote_ccy"], {"rate": "new", "is_carried": "new"})


def latest_rate(rates: DataFrame) -> DataFrame:
    """The last known rate of each pair of currencies."""
    return rates.groupBy("base_ccy", "quote_ccy").agg(F.max("rate_date").alias("rate_date"), F.max_by("rate", "rate_date").alias("rate"))


def with_usd(observations: DataFrame, programs: DataFrame, rates: DataFrame) -> DataFrame:
    """Observations with currency, the rate of their own day (never a neighbouring one) and the price in US dollars."""
    where = programs.select(F.col("abbr").alias("state"), "country")
    day = rates.filter("quote_ccy = 'USD'").select(F.col("base_ccy").alias("currency"), F.col("rate_date").alias("day"), "rate")
    rows = observations.join(where, "state", "left").withColumns({"currency": currency(F.col("country")), "day": F.to_date("scraped_at")})
    rows = rows.join(day, ["currency", "day"], "left")
    usd = F.col("currency") == "USD"
    return rows.withColumns({"fx_rate": F.when(usd, 1.0).otherwise(F.col("rate")), "price_usd": F.when(usd, F.col("price")).otherwise(F.round(F.col("price") * F.col("rate"), 2))})


def freshness(log: DataFrame, keys: list[str], as_of: str, max_hours: float, at: str = "scraped_at") -> DataFrame:
    hours = (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(F.col("latest").cast("timestamp"))) / 3.6e9
    return log.groupBy(*keys).agg(F.max(at).alias("latest")).select(*keys, "latest", F.round(hours, 3).alias("age_hours"), (hours <= max_hours).alias("fresh"))


def snapshot_verdict(prior: Column, new: Column, hours: Column) -> Column:
    """"keep" or "replace": nothing new keeps, and so does under half of a fresh prior snapshot."""
    return F.when(new == 0, "keep").when((prior > 0) & (new < prior * RETAIN) & (hours < CHANGED_HOURS), "keep").otherwise("replace")


def best_counts(stores: DataFrame, keys: list[str]) -> DataFrame:
    one = F.lower(F.coalesce(F.nullif(F.trim("address"), F.lit("")), F.col("name"), F.lit("")))
    handle = F.coalesce(F.col("external_id") != "", F.lit(False))
    menu = handle & (F.coalesce("source", F.lit("")) != "aggregator") & ~F.coalesce("platform", F.lit("")).isin("leafly", "weedmaps")
    return stores.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(one).alias("stores"), F.count_distinct(F.when(menu, one)).alias("menus"), F.count_if(handle).alias("handles"))


def keep_the_best(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The verdict for each key that is in either: "keep" what is stored, or "replace" it."""
    o = best_counts(stored, keys).select(*keys, F.struct("rows", "stores", "menus", "handles").alias("o"))
    n = best_counts(new, keys).select(*keys, F.struct("rows", "stores", "menus", "handles").alias("n"))
    of = lambda side, f: F.coalesce(F.col(f"{side}.{f}"), F.lit(0))
    verdict = (
        F.when(of("n", "rows") == 0, "keep")
        .when(of("n", "menus") < of("o", "menus"), "keep")
        .when(of("n", "menus") > of("o", "menus"), F.when(of("n", "stores") >= of("o", "stores") * MENU_RETAIN, "replace").otherwise("keep"))
        .when(of("n", "stores") >= of("o", "stores"), "replace")
        .when((of("o", "handles") == 0) & (of("n", "handles") > 0) & (of("n", "stores") >= of("o", "stores") * HANDLE_RETAIN), "replace")
        .otherwise("keep")
    )
    return o.join(n, keys, "full").select(*keys, verdict.alias("verdict"))


def lifecycle(seen: DataFrame, missed: int = 2, usable: float = 0.9) -> DataFrame:
    """(source, loc, kind, occurred_on) of seen (source, loc, day): "opened" in a usable cycle after the source's first, "closed" after ``missed`` usable cycles without it.

    A cycle is usable unless the source later beats it by more than a share of ``usable``.
    """
    seen = seen.distinct()
    w = Window.partitionBy("source").orderBy("day")
    cycles = seen.groupBy("source", "day").agg(F.count(F.lit(1)).alias("n"))
    later = F.max("n").over(w.rowsBetween(1, Window.unboundedFollowing))
    fine = cycles.withColumn("later", later).filter(F.col("n") >= usable * F.coalesce("later", "n"))
    fine = fine.withColumns({"first_usable": F.min("day").over(Window.partitionBy("source")), "later_cycles": F.count(F.lit(1)).over(w.rowsBetween(1, Window.unboundedFollowing))}).select("source", "day", "first_usable", "later_cycles")
    per = seen.groupBy("source", "loc").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    opened = per.join(fine.withColumnRenamed("day", "first_day"), ["source", "first_day"]).filter("first_day > first_usable").select("source", "loc", F.lit("opened").alias("kind"), F.col("first_day").alias("occurred_on"))
    # usable cycles after a day: those days and the places' last days in one order, counted from the end
    marks = per.select("source", F.col("last_day").alias("day"), F.lit(0).alias("n")).distinct().unionByName(fine.select("source", "day", F.lit(1).alias("n")))
    absent = F.sum("n").over(w.rowsBetween(1, Window.unboundedFollowing))
    after = marks.groupBy("source", "day").agg(F.sum("n").alias("n")).withColumn("absent", F.coalesce(absent, F.lit(0)))
    closed = per.join(after.select("source", F.col("day").alias("last_day"), "absent"), ["source", "last_day"]).filter(F.col("absent") >= missed).select("source", "loc", F.lit("closed").alias("kind"), F.col("last_day").alias("occurred_on"))
    return opened.union(closed)


def operator_changes(log: DataFrame, keys: list[str], operator: str = "operator", at: str = "scraped_at", tie: str = "id") -> DataFrame:
    """Rows whose operator differs from the one before at the same place, with ``previous``; equal or prefixed names are one operator."""
    rows = log.withColumn("previous", F.lag(operator).over(Window.partitionBy(*keys).orderBy(at, tie)))
    key = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")
    a, b = key(F.col(operator)), key(F.col("previous"))
    return rows.filter(F.col("previous").isNotNull() & ~a.startswith(b) & ~b.startswith(a))


def upsert(target: DataFrame, updates: DataFrame, keys: list[str], rules: dict[str, str]) -> DataFrame:
    """``target`` with ``updates`` written over it. Rules of columns: "new" (the update's unless null), "old" (the target's unless null), "greatest", "least", "replace" (the update's, null or not)."""
    u = updates.select(*keys, F.struct(*rules).alias("u"), F.lit(True).alias("hit"))
    t = target.select(*keys, F.struct(*rules).alias("t"))
    new, old = (lambda c: F.col("u")[c]), (lambda c: F.col("t")[c])
    how = {
        "new": lambda c: F.coalesce(new(c), old(c)),
        "old": lambda c: F.coalesce(old(c), new(c)),
        "greatest": lambda c: F.greatest(old(c), new(c)),
        "least": lambda c: F.least(old(c), new(c)),
        "replace": lambda c: F.when(F.col("hit"), new(c)).otherwise(old(c)),
    }
    return t.join(u, keys, "full").select(*keys, *[how[r](c).alias(c) for c, r in rules.items()])


def record_roster(records: DataFrame, state: str, source: str, as_of: str) -> DataFrame:
    """Observations of locations out of a roster (name, address, city, zip_code, latitude, longitude, ordinal): a key each, the first record of a key, keyless ones left out."""
    from shelfspark.functions import places as G

    key = G.location_key(F.col("latitude"), F.col("longitude"), F.col("address"), F.col("zip_code"))
    rows = records.withColumn("location_key", key).filter("location_key != ''")
    first = rows.groupBy("location_key").agg(F.min_by(F.struct(F.col("name").alias("operator"), "address", "city", "zip_code", "latitude", "longitude"), "ordinal").alias("r"))
    return first.select("location_key", F.lit(source).alias("source"), F.lit(state).alias("state"), "r.*", F.lit(as_of).cast("timestamp").alias("scraped_at"))


def restore_geocodes(table: DataFrame, cache: DataFrame, key: str = "query") -> DataFrame:
    """``table`` with coordinates (as a pair), postal code and city where it has none, from ``cache`` (query, latitude, longitude, zip_code, city)."""
    c = cache.select(F.col("query").alias(key), F.struct("latitude", "longitude", "zip_code", "city").alias("_c"))
    rows = table.join(c, key, "left")
    pair = F.col("latitude").isNull() & F.col("_c.latitude").isNotNull() & F.col("_c.longitude").isNotNull()
    some = lambda f: F.coalesce(F.col(f), F.when(F.length(F.col(f"_c.{f}")) > 0, F.col(f"_c.{f}")))
    new = {"latitude": F.when(pair, F.col("_c.latitude")).otherwise(F.col("latitude")), "longitude": F.when(pair, F.col("_c.longitude")).otherwise(F.col("longitude")), "zip_code": some("zip_code"), "city": some("city")}
    return rows.withColumns(new).drop("_c")


def fold_locations(locations: DataFrame) -> DataFrame:
    """locations (location_key, address_key) with ``folded``: a location known by address is the one known by coordinates if exactly one of those has its address."""
    geo = locations.filter(F.col("location_key").startswith("@") & (F.col("address_key") != "")).groupBy("address_key").agg(F.count_distinct("location_key").alias("n"), F.min("location_key").alias("geo")).filter("n = 1")
    rows = locations.join(geo.select("address_key", "geo"), "address_key", "left")
    return rows.withColumn("folded", F.when(F.col("location_key").startswith("@"), F.col("location_key")).otherwise(F.coalesce("geo", "location_key"))).drop("geo")


#: Rows in a list of places; tasks that share the pairs of one operator and town.
_LIST, _SHARES = 512, 24


def relocations(events: DataFrame) -> DataFrame:
    """(source, loc, from_loc, occurred_on) of events (source, loc, kind, occurred_on, operator, city): an opening that may be a closed store of the same operator and town, not before it closed.

    The result grows as the product of an operator's openings and closings in a town. Both meet as bounded lists of one
    day, so that days are compared once a list, and the openings of a town are dealt out to many tasks.
    """
    key = ["source", "operator", "town"]

    def lists(kind: str, loc: str, day: str) -> DataFrame:
        own = events.filter(F.col("kind") == kind).select("source", "operator", F.lower(F.trim("city")).alias("town"), F.col("loc").alias(loc), F.col("occurred_on").alias(day)).dropna()
        part = F.floor((F.row_number().over(Window.partitionBy(*key, day).orderBy(loc)) - 1) / _LIST)
        return own.withColumn("part", part).groupBy(*key, day, "part").agg(F.collect_list(loc).alias(loc))

    closed = lists("closed", "from_loc", "closed_on").drop("part").withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(_SHARES - 1))))
    opened = lists("opened", "loc", "occurred_on").withColumn("share", F.pmod(F.xxhash64("occurred_on", "part"), F.lit(_SHARES)).cast("int")).drop("part")
    met = spread(closed, *key, "share").join(spread(opened, *key, "share"), [*key, "share"]).filter("occurred_on >= closed_on")
    pairs = met.select("source", F.explode("loc").alias("loc"), "from_loc", "occurred_on").select("source", "loc", F.explode("from_loc").alias("from_loc"), "occurred_on")
    return pairs.filter("loc != from_loc")


def confidence(events: DataFrame, cycles: DataFrame, high: int = 3) -> DataFrame:
    """Lifecycle events (source, occurred_on, ...) with ``confidence``: "high" if ``high`` usable cycles (source, day) or more come after them, else "low"."""
    after = events.select("source", "occurred_on").distinct().join(cycles.select("source", "day").distinct(), "source").groupBy("source", "occurred_on").agg(F.count_if(F.col("day") > F.col("occurred_on")).alias("n"))
    return events.join(after, ["source", "occurred_on"], "left").withColumn("confidence", F.when(F.col("n") >= high, "high").otherwise("low")).drop("n")
