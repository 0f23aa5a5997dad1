"""Which store rows are one physical store, which companies one operator, and which row stands for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark import rules
from shelfspark.functions import places as G
from shelfspark.functions import text as X
from shelfspark.operators.graph import components, once
from shelfspark.operators.spread import spread

MERGE_M, CELL = 100.0, 0.002


def ambiguous_handles(stores: DataFrame) -> DataFrame:
    """(handle) of menus that stand at more than one address."""
    keyed = stores.select(G.handle(F.col("platform"), F.col("external_id")).alias("handle"), G.address_key(F.col("address"), F.col("zip_code")).alias("akey"))
    return keyed.filter("handle != '' and akey != ''").groupBy("handle").agg(F.count_distinct("akey").alias("n")).filter("n > 1").select("handle")


def store_keys(stores: DataFrame) -> DataFrame:
    """(state, id, key) of each store: its address, its cell, and its menu unless that is ambiguous within the state; none that is empty."""
    h = G.handle(F.col("platform"), F.col("external_id"))
    keyed = stores.select("state", "id", G.address_key(F.col("address"), F.col("zip_code")).alias("akey"), G.geo_key(F.col("latitude"), F.col("longitude"), F.col("zip_code")).alias("gkey"), h.alias("handle"))
    per = keyed.filter("handle != '' and akey != ''").groupBy("state", "handle").agg(F.count_distinct("akey").alias("n")).filter("n > 1").select("state", "handle", F.lit(True).alias("bogus"))
    marked = keyed.join(per, ["state", "handle"], "left")
    keys = F.array("akey", "gkey", F.when(F.col("bogus").isNull(), F.col("handle")).otherwise(""))
    return marked.select("state", "id", F.explode(F.filter(keys, lambda k: k != "")).alias("key")).distinct()


def near_pairs(stores: DataFrame, metres: float = MERGE_M) -> DataFrame:
    """(a, b), a < b: stores of one state and operator at most ``metres`` apart. They meet in grid cells, each with its neighbours."""
    points = stores.filter("latitude is not null and longitude is not null").select("state", "canonical_name", "id", "latitude", "longitude")
    wide = F.lit(CELL) / F.greatest(F.cos(F.radians(F.round("latitude", 0))), F.lit(0.05))
    cell = points.withColumns({"cy": F.floor(F.col("latitude") / CELL), "cx": F.floor(F.col("longitude") / wide)})
    around = cell.select("*", F.explode(F.sequence(F.lit(-1), F.lit(1))).alias("dy")).select("*", F.explode(F.sequence(F.lit(-1), F.lit(1))).alias("dx"))
    left = around.select("state", "canonical_name", F.col("id").alias("a"), F.col("latitude").alias("y1"), F.col("longitude").alias("x1"), (F.col("cy") + F.col("dy")).alias("cy"), (F.col("cx") + F.col("dx")).alias("cx"))
    right = cell.select("state", "canonical_name", F.col("id").alias("b"), F.col("latitude").alias("y2"), F.col("longitude").alias("x2"), "cy", "cx")
    met = left.join(right, ["state", "canonical_name", "cy", "cx"]).filter("a < b")
    return met.filter(G.haversine_m(F.col("y1"), F.col("x1"), F.col("y2"), F.col("x2")) <= metres).select("a", "b").distinct()


def menu_rank(platform: Column, external_id: Column) -> Column:
    p = F.lower(F.trim(F.coalesce(platform, F.lit(""))))
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in rules.MENU_RANK.items() for x in kv]), p), F.lit(rules.MENU_RANK_OTHER))
    none = F.when((p != "") & (F.trim(F.coalesce(external_id, F.lit(""))) != ""), 0).otherwise(1)
    return F.struct(none.alias("none"), rank.alias("rank"))


def pick_canonical(members: DataFrame) -> DataFrame:
    """(cluster, canonical) of members (cluster, company_id, company_name, hits, n_stores): most stores named after it (``hits``), then most stores, shortest name, least id."""
    order = F.struct(F.col("hits").alias("a"), F.col("n_stores").alias("b"), (-F.length("company_name")).alias("c"), (-F.col("company_id")).alias("d"))
    return members.groupBy("cluster").agg(F.max_by("company_id", order).alias("canonical"))


def key_points(stores: DataFrame) -> DataFrame:
    """(id, reps) of each store with keys: for each of its keys the least id of the stores that have it, ascending. Stores that share one are the same; so are all stores of the least id."""
    keys = once(store_keys(stores).filter("id is not null"))
    least = keys.groupBy(F.col("state").alias("s"), F.col("key").alias("k")).agg(F.min("id").alias("rep"))
    return once(keys.join(least, F.col("state").eqNullSafe(F.col("s")) & (F.col("key") == F.col("k"))).groupBy("id").agg(F.sort_array(F.collect_set("rep")).alias("reps")))


def near_points(stores: DataFrame, points: DataFrame, metres: float = MERGE_M) -> DataFrame:
    """(a, b), the ties of ``near_pairs`` between the least representatives of stores (``points``, of ``key_points``): stores at one point hang on one of them, and only points are met with each other."""
    at = ["state", "canonical_name", "latitude", "longitude"]
    fine = stores.filter(" and ".join(f"{c} is not null" for c in at)).filter("latitude - latitude = 0 and longitude - longitude = 0")  # numbers, and finite
    own = fine.join(points.select("id", F.col("reps")[0].alias("own")), "id").select(*at, "own").distinct()
    tied = own.withColumn("id", F.min("own").over(Window.partitionBy(*at)))
    return tied.select(F.col("id").alias("a"), F.col("own").alias("b")).distinct().union(near_pairs(tied.select(*at, "id").distinct(), metres))


def dedupe(stores: DataFrame) -> DataFrame:
    """Each store row with ``grp`` (least id of its physical store; null without any key), ``operator`` (company that stands for its cluster),
    ``kept`` (row that stands for the store; itself without keys), ``latitude`` and ``longitude`` (and a blank ``address`` or ``zip_code``) filled in from the first located sibling, and ``storefront``.

    Ties that the rules leave open go to the lower id.
    """
    stores = once(spread(stores, "id"))  # a small file of stores is one task, whose addresses take long
    points = key_points(stores)
    first = points.select(F.col("reps")[0].alias("a"), F.explode("reps").alias("b")).distinct()
    roots = components(first.union(near_points(stores, points)))
    groups = points.select("id", F.col("reps")[0].alias("node")).join(roots, "node").select("id", F.col("root").alias("grp"))
    rows = once(stores.join(groups, "id", "left"))
    links = rows.filter("grp is not null").select("grp", "company_id").distinct().withColumn("a", F.min("company_id").over(Window.partitionBy("grp"))).select("a", F.col("company_id").alias("b")).distinct()
    clusters = components(links.union(stores.select(F.col("company_id").alias("a"), F.col("company_id").alias("b")).distinct())).select(F.col("node").alias("company_id"), F.col("root").alias("cluster"))
    per = stores.groupBy("company_id").agg(F.max_by("canonical_name", "id").alias("company_name"), F.count(F.lit(1)).alias("n_stores"))
    token = per.select("company_id", X.first_token(F.col("company_name")).alias("token"))
    hits = stores.join(token, "company_id").groupBy("company_id").agg(F.count_if(F.contains(F.lower(F.coalesce("name", F.lit(""))), F.col("token"))).alias("hits"))
    members = once(per.join(hits, "company_id").join(clusters, "company_id"))
    companies = members.join(pick_canonical(members), "cluster").select("company_id", F.col("canonical").alias("operator"), "n_stores", "company_name")
    operators = companies.select(F.col("company_id").alias("operator"), F.col("n_stores").alias("operator_stores"), F.col("company_name").alias("operator_name"))
    rows = rows.join(companies, "company_id", "left").join(operators, "operator", "left")
    rank = menu_rank(F.col("platform"), F.col("external_id"))
    survivor = F.min_by("id", F.struct(rank.alias("r"), F.when(F.col("company_id") == F.col("operator"), 0).otherwise(1).alias("o"), F.col("id").alias("i")))
    located = F.when(F.col("latitude").isNotNull() & F.col("longitude").isNotNull(), F.struct("id", "latitude", "longitude", "address", "zip_code"))
    smaller = F.when((F.col("company_id") != F.col("operator")) & (F.col("n_stores") < F.col("operator_stores")), F.struct(F.col("n_stores").alias("n"), F.col("company_id").alias("c"), F.col("company_name").alias("name")))
    # an aggregate, not a window: a large group's rows are combined before they meet
    per_group = rows.filter("grp is not null").groupBy("grp").agg(survivor.alias("k"), F.min(located).alias("donor"), F.min(smaller).alias("alias"))
    out = rows.join(per_group, "grp", "left")
    alone = F.col("grp").isNull()
    kept = F.when(alone, F.col("id")).otherwise(F.col("k"))
    fill = lambda c: F.when(~alone & (F.col("id") == F.col("k")) & (F.col("latitude").isNull() | F.col("longitude").isNull()), F.coalesce(F.col("donor")[c], F.col(c))).otherwise(F.col(c))
    blank = lambda c: F.length(F.coalesce(F.col(c), F.lit(""))) == 0
    fill_blank = lambda c: F.when(~alone & (F.col("id") == F.col("k")) & (F.col("latitude").isNull() | F.col("longitude").isNull()) & blank(c), F.coalesce(F.col("donor")[c], F.col(c))).otherwise(F.col(c))
    front = F.when(~alone & (F.col("id") == F.col("k")), F.coalesce(F.col("alias")["name"], F.col("operator_name")))
    final = out.select("id", "state", "company_id", "grp", "operator", kept.alias("kept"), fill("latitude").alias("latitude"), fill("longitude").alias("longitude"), fill_blank("address").alias("address"), fill_blank("zip_code").alias("zip_code"), front.alias("storefront"), F.col("city").alias("_city"))
    pins = pinned_aliases(final.filter((F.col("id") == F.col("kept")) & F.col("grp").isNotNull()).select("id", F.col("_city").alias("city"), "operator"), companies.join(operators, "operator"))
    named = final.join(pins, "id", "left").withColumn("storefront", F.coalesce("pin", "storefront"))
    return named.drop("pin", "_city")


def pinned_aliases(kept: DataFrame, companies: DataFrame) -> DataFrame:
    """(id, pin) of kept stores (id, city, operator) whose city stands in the name of another company of the operator's cluster that has at least as many stores
    as the operator, if it is the only such store: a name that the operator's site redirects to. Of several names the lowest company's."""
    alias = companies.filter((F.col("company_id") != F.col("operator")) & (F.col("n_stores") >= F.col("operator_stores"))).select("operator", "company_id", "company_name")
    met = kept.join(alias, "operator").filter(X.city_in_name(F.col("city"), F.col("company_name")))
    only = met.groupBy("company_id", "company_name").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id")).filter("n = 1")
    return only.groupBy("id").agg(F.min_by("company_name", "company_id").alias("pin"))


def kept_handles(stores: DataFrame, *partition: str) -> DataFrame:
    """The store of each menu, and of each state if asked, that isn't folded: that of the lowest company, then the lowest id."""
    from shelfspark.operators.guards import kept_handle

    w = Window.partitionBy(*partition, "platform", "external_id").orderBy("company_id", "id")
    return stores.filter(kept_handle()).withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")
