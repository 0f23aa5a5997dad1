"""Folds, resolution, histories, sources, the workspace and the streams on small cases."""

from __future__ import annotations

import datetime as dt
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from shelfspark import registry
from shelfspark.operators import access, graph, guards, history, resolve, states
from shelfspark.sources import extract, markup
from shelfspark.streaming import append_changes, token_buckets
from shelfspark.workspace import Workspace, fill, one

T0 = dt.datetime(2024, 1, 4, 12)
STORE = "id long, company_id long, canonical_name string, state string, source string, name string, address string, city string, zip_code string, latitude double, longitude double, platform string, external_id string, canonical_company_id long"


def at(hours: float) -> dt.datetime:
    return T0 + dt.timedelta(hours=hours)


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (7, 8), (9, 9), (None, 4)], "a long, b long")
    assert {r.node: r.root for r in graph.components(e).collect()} == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 9}
    assert graph.components(e.limit(0)).count() == 0


def stores(spark, *rows):
    return spark.createDataFrame([(i, c, n, "PA", "own", f"{n} {i}", a, "Town", z, y, x, p, h, None) for i, c, n, a, z, y, x, p, h in rows], STORE)


def test_dedupe(spark):
    df = stores(
        spark,
        (1, 10, "Acme", "1 Main St", "17011", None, None, "leafly", "a"),
        (2, 10, "Acme", "1 Main Street", "17011", 40.1, -75.1, "dutchie", "b"),
        (3, 11, "Acme North", "1 Main Street Suite 2", "17011", None, None, None, None),
        (4, 12, "Bloom", "9 Oak Ave", "17012", 41.0, -76.0, "jane", "c"),
        (5, 12, "Bloom", "11 Oak Ave", "17012", 41.0005, -76.0, "jane", "d"),  # 56 m from 4, same operator
        (6, 13, "Other", "13 Oak Ave", "17012", 41.0006, -76.0, "jane", "e"),  # near, another operator
        (7, 14, "None", None, None, None, None, None, None),
        (8, 15, "X", "1 First St", "17001", None, None, "weedmaps", "index"),
        (9, 15, "X", "2 Second St", "17001", None, None, "weedmaps", "index"),  # the menu stands at two addresses: it doesn't join
    )
    out = {r.id: r for r in resolve.dedupe(df).collect()}
    assert [out[i].grp for i in range(1, 10)] == [1, 1, 1, 4, 4, 6, None, 8, 9]
    assert out[1].kept == out[2].kept == out[3].kept == 2 and out[7].kept == 7
    assert out[1].operator == out[3].operator == 10 and out[2].storefront == "Acme North" and out[4].storefront == "Bloom"
    assert [r.handle for r in resolve.ambiguous_handles(df).collect()] == ["weedmaps:index"]


def test_siblings_fill_in(spark):
    df = stores(spark, (1, 1, "A", "1 Main St", "17011", 40.1, -75.1, None, None), (2, 1, "A", "1 Main St", "17011", None, None, "dutchie", "b"))
    out = {r.id: r for r in resolve.dedupe(df).collect()}
    assert out[1].kept == 2 and (out[2].latitude, out[2].longitude) == (40.1, -75.1)


def test_appending(spark):
    rows = [(1, "s", 1.0, at(0)), (2, "s", 1.0, at(1)), (3, "s", 2.0, at(2)), (4, "s", 2.0, at(13)), (5, "s", None, at(14)), (6, "s", None, at(15))]
    df = spark.createDataFrame(rows, "id long, k string, price double, scraped_at timestamp")
    assert [(r.id, r.reason) for r in history.to_append(df, ["k"], ["price"]).orderBy("id").collect()] == [(1, "first"), (3, "changed"), (4, "new_day"), (5, "changed")]
    batch = df.filter("id = 3")
    assert history.append_batch(df.filter("id < 3"), batch, ["k"], ["price"]).count() == 1
    assert history.append_batch(df.filter("id < 3"), df.filter("id = 2"), ["k"], ["price"]).count() == 0


def test_forward_fill(spark):
    d = lambda n: dt.date(2024, 1, n)
    df = spark.createDataFrame([(d(4), "CAD", "USD", 0.7), (d(5), "CAD", "USD", 0.71), (d(8), "CAD", "USD", 0.72)], "rate_date date, base_ccy string, quote_ccy string, rate double")
    out = history.forward_fill(df).orderBy("rate_date").collect()
    assert [(r.rate_date.day, r.rate, r.is_carried) for r in out] == [(4, 0.7, False), (5, 0.71, False), (6, 0.71, True), (7, 0.71, True), (8, 0.72, False)]


def test_usd(spark):
    obs = spark.createDataFrame([(1, "ON", 40.0, T0), (2, "PA", 40.0, T0), (3, "ON", 40.0, at(240)), (4, None, None, T0)], "id long, state string, price double, scraped_at timestamp")
    programs = spark.createDataFrame([("ON", "CA"), ("PA", "US"), ("CA", "US")], "abbr string, country string")
    rates = spark.createDataFrame([(T0.date(), "CAD", "USD", 0.7)], "rate_date date, base_ccy string, quote_ccy string, rate double")
    assert [(r.id, r.currency, r.price_usd) for r in history.with_usd(obs, programs, rates).orderBy("id").collect()] == [(1, "CAD", 28.0), (2, "USD", 40.0), (3, "CAD", None), (4, "USD", None)]


def best(spark, menus, listings):
    rows = [(1, "PA", "menu", f"m{i}", f"{i} Main St", "jane", f"h{i}") for i in range(menus)] + [(1, "PA", "aggregator", f"l{i}", f"{i} Oak", "leafly", None) for i in range(listings)]
    return spark.createDataFrame(rows, "company_id long, state string, source string, name string, address string, platform string, external_id string")


@pytest.mark.parametrize(("old", "new", "want"), [((0, 4), (3, 0), "replace"), ((3, 0), (0, 5), "keep"), ((4, 0), (2, 0), "keep"), ((0, 15), (1, 0), "keep"), ((0, 5), (4, 0), "replace"), ((2, 0), (2, 0), "replace"), ((2, 0), (0, 0), "keep")])
def test_keep_the_best(spark, old, new, want):
    assert history.keep_the_best(best(spark, *old), best(spark, *new), ["company_id", "state"]).first().verdict == want


def test_snapshots(spark):
    df = spark.createDataFrame([(10, 1, 1.0, "keep"), (10, 1, 49.0, "replace"), (10, 7, 1.0, "replace"), (10, 0, 99.0, "keep"), (0, 3, None, "replace")], "p int, n int, h double, want string")
    assert all(r.v == r.want for r in df.select("want", history.snapshot_verdict(F.col("p"), F.col("n"), F.col("h")).alias("v")).collect())


def test_guards(spark):
    df = spark.createDataFrame([(1, "leafly", None, None), (2, None, True, "Indica"), (3, "weedmaps", False, "Sativa"), (4, "jane", None, "Sativa")], "id int, platform string, potency_implausible boolean, strain_type_std string").withColumn("scraped_at", F.lit(T0))
    ids = lambda c: [r.id for r in df.filter(c).orderBy("id").collect()]
    assert ids(guards.trusted_potency()) == [2, 3, 4] and ids(guards.plausible_potency()) == [1, 3, 4]
    assert ids(guards.trusted_lineage("2024-06-01")) == [4] and ids(guards.trusted_lineage("2020-01-01")) == [2, 3, 4]
    host = spark.createDataFrame([("a.com", True), ("x.a.com", True), ("ba.com", False), ("google.de", True), ("maps.google.fr", True), ("my-where-to.org", True), ("b.org", False)], "h string, want boolean")
    assert all(r.x == r.want for r in host.select("want", guards.domain_excluded(F.col("h"), ["a.com", "google.", "where-to"]).alias("x")).collect())


def test_attempts(spark):
    rows = [(1, "ok", "u1", 0), (2, "ok", None, 1), (3, "blocked", None, 2), (4, "ok", None, 3)]
    df = spark.createDataFrame([(s, "store", "k", "m", 1, st, u, 5, at(h)) for s, st, u, h in rows], "seq long, target_type string, target_key string, method string, cost_rank int, status string, resource_url string, record_count int, attempted_at timestamp")
    two = states.fold_attempts(df.filter("seq < 3")).first()
    assert (two.resource_url, two.attempts, two.status) == ("u1", 2, "ok")
    end = states.fold_attempts(df).first()
    assert end.resource_url is None and end.attempts == 4 and end.last_ok_at == at(3) and end.last_fail_at == at(2)


def test_governor(spark):
    df = spark.createDataFrame([("h", i, 40.0, 0.5) for i in range(12)] + [("g", 1, 10.0, 0.0), ("g", 2, 30.0, 0.29), ("g", 3, 30.0, 0.31)], "host string, seq long, age double, u double")
    got = {(r.host, r.seq): r.admitted for r in states.admit(df).collect()}
    assert [got["h", i] for i in range(12)] == [True] * 5 + [False] * 7
    assert (got["g", 1], got["g", 2], got["g", 3]) == (False, True, False)


def test_bucket(spark):
    rows = [("a", i, at(0), 1.0) for i in range(3)] + [("a", 10, at(1), 1.0), ("a", 11, at(1), 1.0), ("b", 1, at(0), 9.0), ("b", 2, at(0), 2.0)]
    df = spark.createDataFrame(rows, "host string, event_id long, at timestamp, cost double")
    got = {(r.host, r.event_id): r.granted for r in states.token_bucket(df, rate=1 / 3600, burst=2.0).collect()}
    assert got == {("a", 0): True, ("a", 1): True, ("a", 2): False, ("a", 10): True, ("a", 11): False, ("b", 1): False, ("b", 2): True}


def test_queue(spark):
    df = spark.createDataFrame([(1, "claimed", 1, at(0)), (2, "claimed", 3, at(0)), (3, "claimed", 1, at(5)), (4, "pending", 0, None)], "id long, status string, attempts int, lease_until timestamp").selectExpr("*", "3 as max_attempts", "lease_until as claimed_at", "lease_until as scheduled_at", "'k' as target_key")
    assert [(r.id, r.status, r.error) for r in states.reap(df, "2024-01-04 13:00:00").orderBy("id").collect()] == [(1, "pending", None), (2, "failed", "lease expired")]
    held = df.withColumn("claimed_by", F.when(F.col("status") == "claimed", F.lit("w")))
    claims = spark.createDataFrame([(1, "w"), (2, "other"), (4, "w")], "id long, worker string")
    out = {r.id: r for r in states.release(held, claims, "2024-01-04 13:00:00").collect()}
    assert (out[1].attempts, out[1].status, out[1].claimed_by) == (0, "pending", None) and (out[2].status, out[2].attempts) == ("claimed", 3) and out[4].attempts == 0


def test_lifecycle(spark):
    d = lambda n: dt.date(2024, 1, n)
    seen = [("s", loc, d(day)) for day in range(1, 6) for loc in ("a", "b", "c", "d", "e", "f", "g", "h", "i", "j")] + [("s", "late", d(3)), ("s", "late", d(4)), ("s", "late", d(5)), ("s", "gone", d(1)), ("s", "gone", d(2))]
    got = sorted((r.loc, r.kind, r.occurred_on.day) for r in history.lifecycle(spark.createDataFrame(seen, "source string, loc string, day date")).collect())
    assert got == [("gone", "closed", 2), ("late", "opened", 3)]


def test_pages():
    table = "<table><tr><th>Business Name<th>Address<th>City</tr><tr><td>Acme<td>1 Main St<td>Town</tr><tr><td></td><td>x</td></tr></table>"
    assert [(r["name"], r["address"], r["city"]) for r in markup.page(table)] == [("Acme", "1 Main St", "Town")]
    inferred = "<table><tr><td>a</td><td>b</td></tr>" + "".join(f"<tr><td>Shop Number {i}{{}}</td><td>717-555-000{i}</td></tr>" for i in range(4)) + "</table>"
    assert [(r["name"], r["address"]) for r in markup.page(inferred.replace("{}", " - 1 Main St"))][:1] == [("Shop Number 0", "1 Main St")]
    assert markup.page(inferred.replace("{}", "")) == []  # no header names the names, and nothing locates them
    block = "<div><p><strong>Acme</strong><br>1 Main St, Town, PA 17011</p><p>Bloom 2 Oak Ave, Town, PA 17011</p></div>"
    assert [(r["name"], r["address"], r["zip_code"]) for r in markup.page(block)] == [("Acme", "1 Main St", "17011"), ("Bloom", "2 Oak Ave", "17011")]
    lines = "<div>Acme<br>1 Main St<br>Town, PA 17011<br>Directions<br>2 Oak Ave<br>Town, PA 17012</div>"
    assert [(r["name"], r["address"]) for r in markup.page(lines)] == [("Acme", "1 Main St")]
    assert markup.page("<table><tr></table") == [] and markup.page("") == []


def test_files():
    assert [r["name"] for r in markup.from_csv("Legal Name,DBA,City\nL1,D1,Town\nL2,,Town\n,,\n")] == ["D1", "L2"]
    assert [r["name"] for r in markup.from_csv("DBA,City\nD1,Town\n")] == ["D1"] and markup.from_csv("x") == []
    kml = b'<kml xmlns="' + markup._KML.encode() + b'"><Placemark><name>A</name><description>1 Main St</description><Point><coordinates>-75.1,40.1,0</coordinates></Point></Placemark><Placemark><name>B</name><Point><coordinates>0,0</coordinates></Point></Placemark></kml>'
    assert [(r["name"], r["address"], r["latitude"]) for r in markup.from_kml(kml)] == [("A", "1 Main St", 40.1), ("B", None, None)] and markup.from_kml(b"<") == []
    feats = '{"features": [{"attributes": {"Dispensary": "A", "Longitde": "-75", "LATITUDE": 40}}, {"attributes": {"x": 1}}]}'
    assert [(r["name"], r["latitude"], r["longitude"]) for r in markup.from_features(feats)] == [("A", 40.0, -75.0)]
    assert markup.from_json_list('{"data": [{"n": "A"}, {"n": ""}]}', {"name": "n"})[0]["name"] == "A" and markup.from_json_list("x", {"name": "n"}) == []
    assert markup.unmerge("Green Leaf Scot", "12 tMsadinal eSt", "Scottsdale") == ("Green Leaf Scottsdale", "12 Main St")
    assert markup.unmerge("Green Leaf", "12 Main St", "Scottsdale") == ("Green Leaf", "12 Main St")
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>Name</t></si><si><t>City</t></si><si><t>Acme</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row><c r="A2" t="s"><v>2</v></c><c r="C2"><v>7.0</v></c></row></sheetData></worksheet>')
    assert [(r["name"], r["city"]) for r in markup.dispatch(buf.getvalue(), "csv")] == [("Acme", "7")]


def test_resources(spark):
    df = spark.createDataFrame([(1, bytearray(b"Name,City\nA,T\n"), "csv"), (2, None, "csv"), (3, bytearray(b"%PDF-1"), "pdf"), (4, bytearray(b"<p>x</p>"), "what")], "id int, content binary, list_type string")
    assert [(r.id, r.name, r.ordinal) for r in extract.resource_records(df).collect()] == [(1, "A", 0)]


def test_lines_and_boxes(spark):
    lines = spark.createDataFrame([(1, i, s) for i, s in enumerate(["Acme", "1 Main St", "Town, PA 17011", "x"])], "page_id int, ordinal int, line string")
    assert [(r.name, r.address, r.zip_code) for r in extract.line_addresses(lines).collect()] == [("Acme", "1 Main St", "17011")]
    boxes = [(1, 10.0, 3.0, "0001ES"), (1, 60.0, 3.0, "Acme"), (1, 70.0, 3.2, "Shop"), (1, 60.0, 6.1, "North"), (1, 10.0, 9.0, "0002ES"), (1, 60.0, 9.0, "Bloom"), (1, 60.0, 0.0, "Header")]
    df = spark.createDataFrame(boxes, "page int, x double, top double, text string")
    assert sorted((r.cert, r.name) for r in extract.word_boxes_to_rows(df, [("cert", 10.0), ("name", 60.0)], "ES$").collect()) == [("0001ES", "Acme Shop North"), ("0002ES", "Bloom")]


def test_workspace(spark, tmp_path):
    w = Workspace(spark, str(tmp_path / "w"))
    df = spark.createDataFrame([(1, "a", T0), (1, "b", T0), (2, "c", T0)], "k long, v string, scraped_at timestamp")
    schema = spark.createDataFrame([], "k long, v string, scraped_at timestamp, extra double").schema
    assert w.read("t", schema).count() == 0
    w.replace("t", df)
    assert w.read("t", schema).columns == ["k", "v", "scraped_at", "extra"] and w.read("t", schema).filter("extra is null").count() == 3
    w.replace_guarded("t", spark.createDataFrame([(2, "new", T0)], "k long, v string, scraped_at timestamp"), "k", schema, "2024-01-04 13:00:00")
    assert sorted(r.v for r in w.read("t").collect()) == ["a", "b", "new"]
    w.upsert("u", df.groupBy("k").agg(F.max("v").alias("v")), ["k"], {"v": "new"}, spark.createDataFrame([], "k long, v string").schema)
    assert w.query("select count(*) n from {u} where k = :k", k=1).first().n == 1
    with pytest.raises(ValueError, match="check"):
        w.verified("z", df, F.col("k") > 1)
    with pytest.raises(FileNotFoundError):
        Workspace(spark, str(tmp_path / "no"), read_only=True)
    with pytest.raises(ValueError, match="one row"):
        one(df)
    assert fill(df, schema).columns[-1] == "extra"


def test_registry():
    registry.reset()
    registry.register("a", lambda: 1)
    assert registry.resolve("a")() == 1 and registry.names() == ["a"] and registry.is_registered("a")
    with pytest.raises(LookupError):
        registry.resolve("b")()
    assert registry.load_plugins() == 0 and registry.load_plugins() == 0
    registry.reset()


def stream_of(spark, tmp_path, df, parts, name):
    for k, condition in enumerate(parts):
        df.filter(condition).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))


def drain(spark, out, tmp_path, name):
    q = out.writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"{name}-c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_streams(spark, tmp_path):
    rows = [(1, "s", 1.0, at(0)), (2, "s", 1.0, at(1)), (3, "s", 2.0, at(2)), (4, "s", 2.0, at(13)), (5, "t", None, at(14)), (6, "t", None, at(15))]
    df = spark.createDataFrame(rows, "id long, k string, price double, scraped_at timestamp")
    got = drain(spark, append_changes(stream_of(spark, tmp_path, df, ["id <= 2", "id > 2"], "obs"), ["k"], ["price"]), tmp_path, "changes")
    assert sorted((r.id, r.reason) for r in got.collect()) == sorted((r.id, r.reason) for r in history.to_append(df, ["k"], ["price"]).collect())
    req = spark.createDataFrame([("a", i, at(i / 4), 1.0) for i in range(12)], "host string, event_id long, at timestamp, cost double")
    got = drain(spark, token_buckets(stream_of(spark, tmp_path, req, ["event_id < 5", "event_id >= 5"], "req"), 1 / 3600, 2.0), tmp_path, "grants")
    assert sorted((r.event_id, r.granted) for r in got.collect()) == sorted((r.event_id, r.granted) for r in states.token_bucket(req, 1 / 3600, 2.0).collect())


def capture(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "content string")


def test_registries(spark, tmp_path):
    from shelfspark.sources import registries as R

    (tmp_path / "a.csv").write_text("DBA,Facility Name , Street,City,Zip Code\nD,F,1 Main St,T,1\n,F2,,,\n,,x,,\n")
    assert [(r.name, r.address) for r in R.trade_csv(R.csv_table(spark, str(tmp_path / "a.csv"))).collect()] == [("D", "1 Main St"), ("F2", None)]
    df = spark.createDataFrame([("Retail", "Active ", "A", None, "9 Oak", "T", None, None, None, "40.1", "x"), ("Lab", "Active", "B", *[None] * 8), ("Retail", "Expired", "C", *[None] * 8)], "license_type string, license_status string, business_name string, address_1 string, physical_address_1 string, city string, physical_city string, zip_code string, physical_zip_code string, latitude string, longitude string")
    assert [(r.name, r.address, r.latitude, r.longitude) for r in R.status_csv(df, ["Retail"]).collect()] == [("A", "9 Oak", 40.1, None)]
    sheet = spark.createDataFrame([("A", "4 - 12 Main", "Floor 2", "T", "AB", None, None), ("B", "1 Main", None, "T", "SK", None, None)], "name string, address string, address2 string, city string, province string, zip_code string, phone string")
    assert [(r.name, r.address) for r in R.province_sheet(sheet).collect()] == [("A", "12 Main, Floor 2")]
    active = spark.createDataFrame([("A", "1 Main", "T", "N/A", "Active"), ("B", "1 Main", "T", "b.ca", "closed"), ("C", "2 Main", "T", "c.ca", "ACTIVE ")], "name string, address string, city string, website string, status string")
    assert [(r.name, r.website) for r in R.active_sheet(active).orderBy("name").collect()] == [("A", None), ("C", "c.ca")]
    assert [r.name for r in R.store_json(capture(spark, '[{"name": "A", "latitude": 50.1}, {"name": " "}]', "x")).collect()] == ["A"]
    block = '<i data="{&quot;location&quot;:{&quot;addressTitle&quot;:&quot;A&quot;,&quot;addressLine1&quot;:&quot;1 Main&quot;,&quot;addressLine2&quot;:&quot;T, VA, 22030&quot;,&quot;markerLat&quot;:0,&quot;markerLng&quot;:0}}">'
    assert [(r.name, r.city, r.zip_code, r.latitude) for r in R.map_blocks(capture(spark, block + block)).collect()] == [("A", "T", "22030", None)]
    marks = '[{"name": "A", "lat": "40", "long": -75, "formattedAddress": "1 Main St, Town, PA 17011, USA"}, {"name": "B", "formattedAddress": "?"}]'
    assert [(r.name, r.address, r.state) for r in R.markers_json(capture(spark, marks)).orderBy("name").collect()] == [("A", "1 Main St", "PA"), ("B", None, None)]
    lic = '{"data": [{"businessLegalName": "L", "licenseType": "Commercial - Retailer", "licenseStatus": "Active"}, {"businessDbaName": "X", "licenseStatus": "Revoked", "licenseType": "Retailer"}]}'
    assert [r.name for r in R.licence_search(capture(spark, lic, lic)).collect()] == ["L"]
    pts = spark.createDataFrame([(i / 10, i / 10) for i in range(40)], "lat double, lng double")
    boxes = R.quadrants(pts, (0.0, 4.0, 0.0, 4.0), page=10).collect()
    assert sum(b.lat0 <= i / 10 < b.lat1 and b.lng0 <= i / 10 < b.lng1 for b in boxes for i in range(40)) == 40
    frames = spark.createDataFrame([(1, '<iframe src="https://a.org/x"></iframe><iframe src="https://www.youtube.com/y"></iframe>')], "id int, html string")
    assert [r.src for r in R.content_frames(frames).collect()] == ["https://a.org/x"]
    links = spark.createDataFrame([(1, "https://x.gov/a#b"), (2, "https://x.gov/a"), (3, "https://x.com"), (4, "mailto:x"), (5, "https://skip.us/")], "ordinal int, href string")
    assert [(r.ordinal, r.page) for r in R.official_urls(links, skip=("skip",)).collect()] == [(1, "https://x.gov/a")]
    fx = '{"observations": [{"d": "2024-01-04", "FXUSDCAD": {"v": "1.25"}}, {"d": "2024-01-05", "FXUSDCAD": {"v": ""}}]}'
    assert [(str(r.rate_date), r.rate) for r in R.rates_json(capture(spark, fx)).collect()] == [("2024-01-04", 0.8)]
    page = lambda more, n: '{"exceededTransferLimit": %s, "features": [%s]}' % (more, ",".join(["{}"] * n))
    pages = spark.createDataFrame([("l", 0, page("true", 2)), ("l", 1, page("false", 1)), ("l", 2, page("true", 1)), ("m", 0, page("true", 0)), ("m", 1, page("true", 1))], "layer string, page int, content string")
    assert sorted((r.layer, r.page) for r in R.feature_pages_done(pages).collect()) == [("l", 0), ("l", 1)]


def test_discovery(spark):
    from shelfspark.operators import discovery as D

    scored = spark.createDataFrame([("https://a.gov/", 1, "https://a.gov/more", 5), ("https://a.gov/", 2, "https://a.gov/x", 5), ("https://a.gov/more", 1, "https://a.gov/l.pdf", 9), ("https://b.gov/", 1, "https://c.gov/y", 5), ("https://c.gov/y", 1, "https://c.gov/z.pdf", 9), ("https://d.gov/", 1, "https://d.gov/q", 2)], "page string, ordinal int, href string, score int")
    land = spark.createDataFrame([("A", "https://a.gov/"), ("B", "https://b.gov/"), ("D", "https://d.gov/"), ("E", "https://e.gov/")], "abbr string, page string")
    got = {r.abbr: (r.list_url, r.list_status) for r in D.find_lists(land, scored).collect()}
    assert got == {"A": ("https://a.gov/l.pdf", "found"), "B": ("https://c.gov/y", "found"), "D": (None, "none"), "E": (None, "none")}
    programs = spark.createDataFrame([("A", None, None, None, "u"), ("B", "https://o/x.csv", "s", "found", "u"), ("C", None, "https://s/", "found", "u"), ("D", None, None, "none", None)], "abbr string, override_url string, list_url string, list_status string, best_url string")
    settled = {r.abbr: (r.list_url, r.status) for r in D.settle_lists(programs, D.find_lists(land, scored)).collect()}
    assert settled == {"A": ("https://a.gov/l.pdf", "found"), "B": ("https://o/x.csv", "override"), "C": ("https://s/", "stored"), "D": (None, "no-landing")}
    homes = spark.createDataFrame([("Zen Leaf", u) for u in ("http://zenleaf.com/a", "https://www.zenleaf.com/", "https://other.com", "https://zenleafdispensary.org/")], "name string, url string")
    assert [r.url for r in D.rank_homepages(homes, ["dispensary"], ["", "dispensary"]).orderBy("rank").collect()] == ["https://www.zenleaf.com/", "https://zenleafdispensary.org/", "http://zenleaf.com/a"]
    fold = spark.createDataFrame([("t", "b", "ok", 1), ("t", "a", "failed", 0)], "target_key string, method string, status string, cost_rank int")
    cat = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "method string, cost_rank int")
    steps = access.ladder(spark.createDataFrame([("t",), ("u",)], "target_key string"), cat, fold).orderBy("target_key", "step").collect()
    assert [(r.target_key, r.method) for r in steps] == [("t", "b"), ("t", "a"), ("t", "c"), ("u", "a"), ("u", "b"), ("u", "c")]
    live = spark.createDataFrame([("k", 2, "b", 200), ("k", 1, "a", 404)], "key string, ordinal int, url string, http_status int")
    assert D.first_live(live).first().url == "b"


def test_rosters_and_folds(spark):
    rec = spark.createDataFrame([("A", "1 Main St", "T", "17011", None, None, 1), ("B", "1 Main Street", "T", "17011", None, None, 0), ("C", "county", "T", "17011", None, None, 2), ("D", None, None, None, 40.0, -75.0, 3)], "name string, address string, city string, zip_code string, latitude double, longitude double, ordinal int")
    assert sorted(r.operator for r in history.record_roster(rec, "PA", "roster", "2024-01-04").collect()) == ["B", "D"]
    loc = spark.createDataFrame([("@1,2|x", "a"), ("a", "a"), ("@3,4|x", "b"), ("@5,6|x", "b"), ("b", "b"), ("c", "c")], "location_key string, address_key string")
    assert {r.location_key: r.folded for r in history.fold_locations(loc).collect()} == {"@1,2|x": "@1,2|x", "a": "@1,2|x", "@3,4|x": "@3,4|x", "@5,6|x": "@5,6|x", "b": "b", "c": "c"}
    d = lambda n: dt.date(2024, 1, n)
    ev = spark.createDataFrame([("s", "x", "closed", d(2), "A", "Town"), ("s", "y", "opened", d(3), "A", "town "), ("s", "z", "opened", d(1), "A", "Town"), ("s", "w", "opened", d(3), "B", "Town")], "source string, loc string, kind string, occurred_on date, operator string, city string")
    assert [(r.loc, r.from_loc) for r in history.relocations(ev).collect()] == [("y", "x")]


def test_aliases_are_pinned(spark):
    kept = spark.createDataFrame([(1, "York", 10), (2, "Erie", 10), (3, "York", 11)], "id long, city string, operator long")
    companies = spark.createDataFrame([(10, 10, 2, 2, "Zen"), (20, 10, 2, 2, "Zen of York"), (21, 10, 1, 2, "Zen of Erie"), (22, 10, 3, 2, "Zen Yorkshire")], "company_id long, operator long, n_stores int, operator_stores int, company_name string")
    assert [(r.id, r.pin) for r in resolve.pinned_aliases(kept, companies).collect()] == [(1, "Zen of York")]


def test_schemas(spark):
    from shelfspark import schemas

    assert all(schemas.empty(spark, n).count() == 0 for n in schemas.TABLES) and "terpenes" in schemas.TABLES["listings"].names


def test_relocations_of_one_town_are_shared_out(spark, monkeypatch):
    monkeypatch.setattr(history, "_LIST", 3)
    day = lambda k: dt.date(2024, 1, 1) + dt.timedelta(days=k % 6)
    rows = [("s", f"L{k}", "closed" if k % 2 else "opened", day(k // 2), "op", "Town " if k % 3 else "town") for k in range(60)]
    rows += [("s", "L1", "opened", day(0), "op", "town"), ("s", None, "closed", day(0), "op", "town"), ("s", "M", "opened", None, "op", "town"), ("s", "N", "opened", day(5), None, "town"), ("s", "L3", "closed", day(0), "op", "town"), ("s", "L3", "closed", day(0), "op", "town")]
    ev = spark.createDataFrame(rows, "source string, loc string, kind string, occurred_on date, operator string, city string")
    got = history.relocations(ev).withColumn("task", F.spark_partition_id()).collect()
    fine = [r for r in rows if None not in r]
    want = sorted((o[1], c[1], o[3]) for o in fine for c in fine if o[2] == "opened" and c[2] == "closed" and o[3] >= c[3] and o[1] != c[1])
    assert sorted((r.loc, r.from_loc, r.occurred_on) for r in got) == want
    assert len({r.task for r in got}) > 1
