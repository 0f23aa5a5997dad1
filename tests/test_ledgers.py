"""Observations, rates, tables, queues, ladders, facts, maps, links, rule files and the workspace on small cases."""

from __future__ import annotations

import datetime as dt
import json
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark import rulefiles, rules
from shelfspark.functions import products as P
from shelfspark.functions import text as X
from shelfspark.operators import access, discovery, evidence, geocode, history, states, tables
from shelfspark.sources import extract, layers, registries
from shelfspark.streaming import lease_timers, watch
from shelfspark.workspace import Cursor, Workspace

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "examples"))
import custom_domain

MENU = "ordinal long, store_key string, brand string, name string, category_std string, product_type_std string, obtention_std string, strain_type_std string, size_g double, price double, thc double, cbd double, thc_mg double, cbd_mg double, terp_total double, terpenes_std map<string,double>, cannabinoids_std map<string,double>"


def menu(spark, *rows):
    return spark.createDataFrame([(k, "s", "B", name, kind, None, None, None, None, price, None, None, None, None, None, terpenes, None) for k, (name, kind, price, terpenes) in enumerate(rows)], MENU)


def test_observations(spark):
    first = history.observed(menu(spark, ("A", "Flower", 1.0, {}), ("A", "Flower", 2.0, None), ("G", "Accessory", 1.0, None), ("", "Flower", 1.0, None), (None, "Flower", 1.0, None), ("T", "Edible", 1.0, {"a": 1.0, "b": 2.0})))
    assert {(r.name, r.price) for r in first.collect()} == {("A", 2.0), ("T", 1.0)}  # the last of a repeated one; neither gear nor the nameless
    stored = first.withColumn("scraped_at", F.lit("2024-03-05 08:00:00").cast("timestamp"))
    again = lambda *rows, at="2024-03-05 12:00:00": sorted(r.name for r in history.record_observations(stored, menu(spark, *rows), at).collect())
    same = [("A", "Flower", 2.0, {}), ("T", "Edible", 1.0, {"b": 2.0, "a": 1.0})]
    assert again(*same) == [] and again(*same, at="2024-03-06 00:00:00") == ["A", "T"]
    assert again(("A", "Flower", 2.5, {}), ("T", "Edible", 1.0, {"a": 1.0})) == ["A", "T"] and again(("New", "Vape", None, None)) == ["New"]
    assert history.record_observations(stored, menu(spark, *same).limit(0), "2024-03-05").count() == 0


def test_empty_lists_and_maps_are_null(spark):
    df = spark.createDataFrame([(1, "k", None, None, dt.datetime(2024, 1, 1, 1)), (2, "k", {}, [], dt.datetime(2024, 1, 1, 2)), (3, "k", {"a": 1.0}, [], dt.datetime(2024, 1, 1, 3))], "id long, k string, m map<string,double>, l array<int>, scraped_at timestamp")
    assert [r.id for r in history.to_append(df, ["k"], ["m", "l"]).orderBy("id").collect()] == [1, 3]


def test_refresh_of_rates(spark):
    d = lambda n: dt.date(2024, 1, n)
    one = "rate_date date, base_ccy string, quote_ccy string, rate double"
    fetched = spark.createDataFrame([(d(5), "CAD", "USD", 0.7), (d(9), "CAD", "USD", 0.8), (d(20), "CAD", "USD", 0.9)], one)
    stored = spark.createDataFrame([(d(2), "CAD", "USD", 0.6, False)], f"{one}, is_carried boolean")
    priced = spark.createDataFrame([(1.0, "ON", "2024-01-07T10:00:00Z"), (None, "ON", "2023-01-01")], "price double, state string, scraped_at string")
    programs = spark.createDataFrame([("ON", "CA"), ("PA", "US")], "abbr string, country string")
    out = history.refresh_rates(stored, fetched, priced, priced.limit(0), programs, "2024-01-10").orderBy("rate_date").collect()
    assert [(r.rate_date.day, r.rate, r.is_carried) for r in out] == [(2, 0.6, False), (7, 0.7, True), (8, 0.7, True), (9, 0.8, False), (10, 0.8, True)]
    assert history.refresh_rates(stored, fetched, priced.withColumn("state", F.lit("PA")), priced, programs, "2024-01-10").collect() == stored.collect()
    assert history.latest_rate(fetched).first().rate == 0.9


def test_tables(spark):
    t = spark.createDataFrame([(1, "a", "x"), (2, "b", None), (3, None, "z")], "id int, s string, v string")
    new = spark.createDataFrame([(1, None), (3, "n"), (9, "q")], "id int, v string")
    assert [(r.id, r.v) for r in tables.update_columns(t, new, ["id"], ["v"]).orderBy("id").collect()] == [(1, None), (2, None), (3, "n")]
    assert [r.id for r in tables.delete_keys(t, t.select("s").filter("s = 'a' or s is null")).orderBy("id").collect()] == [2, 3]  # a null names no row
    assert [r.v for r in tables.clear_column(t, "v", F.col("s") == "a").orderBy("id").collect()] == [None, None, "z"]
    assert [r.id for r in tables.only(t, "s", " A, ").collect()] == [1] and tables.only(t, "s", " ,").count() == 3
    roster = spark.createDataFrame([(1, "Old", "PA", None, None, None, None, None), (2, "Old", "OH", None, None, None, None, None)], "id long, name string, state string, address string, city string, zip_code string, latitude double, longitude double")
    fresh = roster.withColumns({"name": F.when(F.col("state") == "PA", "New").otherwise("Test"), "id": F.col("id") + 10})
    cache = spark.createDataFrame([], "query string, latitude double, longitude double, zip_code string, city string")
    assert sorted((r.id, r.state) for r in tables.replace_roster(roster, fresh, cache).collect()) == [(2, "OH"), (11, "PA")]


def jobs(spark):
    rows = [(1, "claimed", 1, "w"), (2, "claimed", 2, "v"), (3, "done", 1, None), (4, "claimed", 0, "w")]
    df = spark.createDataFrame(rows, "id long, status string, attempts int, claimed_by string").selectExpr("*", "'t' as task_type", "concat('k', id) as target_key", "cast(null as string) as error")
    return df.withColumns({c: F.lit("2024-01-01").cast("timestamp") for c in ("scheduled_at", "claimed_at", "lease_until", "last_heartbeat", "finished_at")})


def test_claims(spark):
    j = jobs(spark)
    done = states.complete(j, spark.createDataFrame([(1, "w", "done", None), (2, "w", "failed", "e")], "id long, worker string, status string, error string"), "2024-02-01")
    assert {r.id: r.status for r in done.collect()} == {1: "done", 2: "claimed", 3: "done", 4: "claimed"} and done.columns == j.columns
    beat = lambda b: sorted(r.id for r in states.heartbeat(j, b, "2024-02-01").filter("last_heartbeat > '2024-01-15'").collect())
    assert beat(spark.createDataFrame([("w",)], "worker string")) == [1, 4] and beat(spark.createDataFrame([(1, "w"), (2, "w")], "id long, worker string")) == [1]
    assert sorted(r.id for r in states.prune_completed(j, "2024-02-01").collect()) == [1, 2, 4] and states.prune_completed(j, "2024-01-02").count() == 4
    assert {(r.target_key, r.claimed_by) for r in states.live_claim_holders(j).collect()} == {("k1", "w"), ("k2", "v"), ("k4", "w")}
    with pytest.raises(ValueError, match="grants nothing"):
        states.token_bucket(j, 0.0, 1.0)


def test_folds_hold_one_key_at_a_time(spark):
    rows = [(f"h{i % 3}", i, float(i)) for i in range(30_000)]  # many Arrow batches a host
    df = spark.createDataFrame(rows, "host string, event_id long, s double").select("host", "event_id", F.timestamp_seconds("s").alias("at"), F.lit(1.0).alias("cost"))
    got = states.token_bucket(df, rate=0.1, burst=2.0).collect()
    want = {}
    for h in range(3):
        tokens, last = 2.0, None
        for i in range(h, 30_000, 3):
            have = 2.0 if last is None else min(2.0, tokens + (i - last) * 0.1)
            want[i] = have >= 1
            if want[i]:
                tokens, last = have - 1, float(i)
    assert {r.event_id: r.granted for r in got} == want


def test_a_ladder_is_run_rung_by_rung(spark, tmp_path):
    towns = spark.createDataFrame([("Ashford", 4), ("Bourne", 7), ("Carn", 2)], "target_key string, population int")
    got = lambda richest: {r.target_key: r.method for r in custom_domain.collect(spark, str(tmp_path / str(richest)), towns, richest).collect()}
    assert got(False) == {"Ashford": "register", "Bourne": "site", "Carn": "register"} and got(True) == dict.fromkeys(("Ashford", "Bourne", "Carn"), "site")
    asked = []
    dear = access.AccessMethod("dear", 9, lambda t: asked.append(t.count()) or t.select("target_key", F.lit("x").alias("name"), F.lit("c").alias("city"), F.lit(None).cast("string").alias("address"), F.lit(None).cast("string").alias("zip_code")))
    cheap = access.AccessMethod("cheap", 1, lambda t: dear.run(t).filter("target_key = 'Carn'"))
    records, attempts = access.run_ladder(towns, [dear, cheap])
    assert asked == [3, 2] and records.count() == 3
    assert {(r.target_key, r.method, r.status) for r in attempts.collect()} == {("Carn", "cheap", "ok"), ("Ashford", "cheap", "failed"), ("Bourne", "cheap", "failed"), ("Ashford", "dear", "ok"), ("Bourne", "dear", "ok")}


def test_tiers(spark):
    targets = spark.createDataFrame([("PA",), ("OH",), ("NV",)], "abbr string")
    some = lambda state, name: lambda t: t.filter(F.col("abbr").isin(*state)).select("target_key", F.lit(name).alias("name"))
    records, report = discovery.run_tiers(targets, [("static", some(["PA", "OH"], "Test")), ("render", some(["PA"], "Shop")), ("model", some(["PA", "OH"], "Store"))])
    assert {r.abbr: (r.records, r.method) for r in report.collect()} == {"PA": (1, "render"), "OH": (1, "model"), "NV": (0, "none")} and records.count() == 2


def test_links_are_parsed(spark):
    html = "<a href='a'>x<a HREF=\"b\" class='k'>y <i>z</i></a> tail</a><a name=n>no</a><a href>empty</a><a href='&amp;q'>q &lt; r"
    assert extract.anchors(html) == [("a", "x", ""), ("b", "y z", "k"), ("", "empty", ""), ("&q", "q < r", "")]
    pages = spark.createDataFrame([(1, html, "http://h/x/"), (2, None, "http://h"), (3, "", "http://h"), (4, "<a href='http://[bad'>z</a>", "http://h")], "page_id int, html string, url string")
    assert [(r.page_id, r.ordinal, r.href) for r in extract.resolved(extract.links(pages), "url").orderBy("page_id", "ordinal").collect()] == [(1, 1, "http://h/x/a"), (1, 2, "http://h/x/b"), (1, 4, "http://h/x/&q")]


def test_maps(spark):
    assert [r.x for r in spark.createDataFrame([(b"PK\x03\x04..",), (b"<html>",), (None,)], "content binary").select(layers.is_workbook().alias("x")).collect()] == [True, False, False]
    cut = spark.createDataFrame([("l", p, '{"features": [{}], "exceededTransferLimit": true}') for p in range(3)], "layer string, page int, content string")
    assert registries.feature_pages_cut(cut, cap=2).count() == 1 and registries.feature_pages_cut(cut, cap=4).count() == 0
    points = spark.createDataFrame([("1", "Elm St W", "51", "-114", 0), ("1", "Elm Street W", "52", "-114", 1), ("x", "Elm", "51", "-114", 2), ("2", "", "51", "-114", 3), ("3", "Elm", "0", "-114", 4)], "house string, street string, lat string, lng string, ordinal long")
    own = geocode.load_points(points, "C", "house", "lat", "lng", street="street")
    assert [(r.house_number, r.street_key, r.y) for r in own.collect()] == [(1, "ELM|ST|W", 51.0)]
    asked = spark.createDataFrame([(1, "C", 1, "ELM|ST|"), (2, "C", 1, "ELM|ST|E"), (3, "C", 1, "ELM|ST|W")], "id int, city_key string, house_number long, street_key string")
    assert [(r.id, r.how) for r in geocode.point_lookup(asked, own).orderBy("id").collect()] == [(1, "no_direction"), (2, None), (3, "exact")]


def test_evidence(spark):
    beats = spark.createDataFrame([("a", dt.datetime(2024, 1, 1)), ("a", dt.datetime(2024, 1, 3)), ("b", dt.datetime(2024, 1, 2))], "host string, updated_at timestamp")
    assert [r.host for r in evidence.heartbeats(beats).collect()] == ["a", "b"]
    j = spark.createDataFrame([("pa", "limited"), ("OH", "unchecked"), ("NV", None)], "abbr string, regime string")
    assert [r.abbr for r in evidence.unchecked(j).collect()] == ["NV", "OH"] and [tuple(r) for r in evidence.coded(j).collect()] == [("PA", "limited")]


def test_rule_files(spark, tmp_path):
    def put(name, data):
        (tmp_path / name).write_text(json.dumps(data))
        return tmp_path / name

    table = rulefiles.categories(put("c.json", {"Vape": ["Cart-ridge", "510"], "Flower": ["bud"], "Gear": None}))
    assert table == [("Vape", ["cartridge", "510"]), ("Flower", ["bud"]), ("Gear", [])]
    over = rulefiles.category_overrides(put("o.json", [{"to": "Edible", "keywords": ["Troche"], "from": [None, "Other"]}]))
    assert over == [("Edible", ["troche"], ["", "Other"])]
    kinds = put("k.json", {"Vape": {"Pod": ["pod"]}, "_defaults": {"Vape": "Cartridge"}})
    assert rulefiles.product_types(kinds) == {"Vape": [("Pod", ["pod"])]} and rulefiles.product_type_defaults(kinds) == {"Vape": "Cartridge"}
    got = rulefiles.obtentions(put("b.json", {"Extracted": {"contains": ["live resin"], "words": ["dab"]}}))
    df = spark.createDataFrame([("510 thing", "Troche"), ("bud", "Pod dab"), (None, "live-resin")], "raw string, name string")
    rows = df.select(P.category_std(F.col("raw"), F.col("name"), table[:2], over).alias("c"), P.product_type(F.col("name"), F.col("raw"), F.lit("Vape"), rulefiles.product_types(kinds), {"Vape": "Cartridge"}).alias("k"), P.obtention(F.col("name"), F.col("raw"), got).alias("o")).collect()
    assert [tuple(r) for r in rows] == [("Vape", "Cartridge", None), ("Flower", "Pod", "Extracted"), (None, "Cartridge", "Extracted")]
    assert rulefiles.company_aliases(tmp_path / "none.json") == {}
    with pytest.raises(FileNotFoundError):
        rulefiles.company_aliases(tmp_path / "none.json", strict=True)
    loose = put("a.json", {"Acme": ["Acme North"], "Bad": "x"})
    assert rulefiles.company_aliases(loose) == {"Acme North": "Acme"}
    with pytest.raises(ValueError, match="Bad"):
        rulefiles.company_aliases(loose, strict=True)
    assert rulefiles.parents(put("p.json", {"parents": {"Group": {"banners": ["Shop One"]}}, "not_corporate_identities": {"Store": "a label"}})) == ({"shopone": "Group"}, {"store": "a label"})
    assert rulefiles.states(put("s.json", {"pa": {"name": "Pennsylvania"}})) == [{"abbr": "PA", "name": "Pennsylvania"}]
    with pytest.raises(ValueError, match="list"):
        rulefiles.category_overrides(kinds)
    assert rules.CATEGORY[0][0] == "Pre-Roll"


def test_many_legal_endings(spark):
    df = spark.createDataFrame([("Acme, Inc. LLC, Corp. Ltd. LLC Inc., LLC",), ("Holdings LLC",), ("Acme",), (None,)], "c string")
    assert [r.s for r in df.select(X.strip_legal_entity(F.col("c")).alias("s")).collect()][0] == "Acme"


def test_workspace_keys_and_cursors(spark, tmp_path, caplog):
    space = Workspace(spark, str(tmp_path))
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("s", T.StringType())])
    space.replace("t", spark.createDataFrame([(1, "a"), (2, "b")], schema))
    space.replace_keys("t", spark.createDataFrame([(3, "a")], schema), spark.createDataFrame([("a",), ("c",)], "s string"), schema)
    assert sorted(r.id for r in space.read("t").collect()) == [2, 3]
    space.delete("t", spark.createDataFrame([("b",)], "s string"))
    space.update_columns("t", spark.createDataFrame([(3, "z")], schema), ["id"], ["s"])
    assert space.views({"t": schema, "u": schema}, "w_") == ["w_t", "w_u"]
    assert spark.sql("select s from w_t").first().s == "z" and spark.sql("select * from w_u").count() == 0
    c = Cursor(spark.range(5).orderBy("id"))
    assert c.fetchone() == (0,) and next(iter(c)) == (1,) and c.fetchall() == [(2,), (3,), (4,)] and c.fetchone() is None and c.description == [("id", "bigint")]
    c.close()
    with caplog.at_level("WARNING"):
        Workspace(spark, str(tmp_path), read_only=True)
        Workspace(spark, str(tmp_path), read_only=True)
    assert sum("nothing can be written" in r.message for r in caplog.records) == 1


def test_leases_run_out(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 4, 12)
    minute = lambda m: t0 + dt.timedelta(minutes=m)
    rows = [
        (1, "w", "claim", minute(0)), (1, "w", "heartbeat", minute(20)), (1, "v", "heartbeat", minute(40)), (2, "w", "claim", minute(1)), (2, "w", "complete", minute(5)),
        (3, "w", "claim", minute(55)), (9, "w", "claim", minute(300)), (3, "v", "claim", minute(400)), (9, "w", "complete", minute(310)),
    ]
    df = spark.createDataFrame(rows, "id long, worker string, kind string, at timestamp")
    for part in ("at < '2024-01-04 12:50:00'", "at >= '2024-01-04 12:50:00' and at < '2024-01-04 13:30:00'", "at >= '2024-01-04 13:30:00'"):
        df.filter(part).coalesce(1).write.mode("append").json(str(tmp_path / "signs"))
    stream = watch(spark, str(tmp_path / "signs"), df.schema, files=1)
    q = lease_timers(stream).writeStream.outputMode("append").format("memory").queryName("leases").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    got = {(r.id, r.worker, r.state) for r in spark.table("leases").collect()}
    assert got >= {(1, "w", "held"), (1, "w", "expired"), (2, "w", "held"), (2, "w", "finished"), (3, "w", "held"), (3, "w", "expired"), (3, "v", "held"), (9, "w", "held"), (9, "w", "finished")}
    assert {r.lease_until for r in spark.table("leases").filter("id = 1 and state = 'expired'").collect()} == {minute(50)}
