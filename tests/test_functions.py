"""Scalar functions on tables of cases."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from shelfspark.functions import places as G
from shelfspark.functions import products as P
from shelfspark.functions import text as X


def run(spark, f, cases, schema="string"):
    """Pairs of (given, found) of a function of one column."""
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], f"i int, c {schema}")
    return [r.f for r in df.select("i", f(F.col("c")).alias("f")).orderBy("i").collect()]


def test_sizes(spark):
    cases = {
        "3.5g": 3.5, "100mg": 0.1, "1oz": 28.0, "1 oz": 28.0, "eighth_ounce": 3.5, "1/8 oz": 3.5, "5pk 0.5g": 2.5, "2 x 1g": 2.0, "half gram": 0.5, "Quarter Ounce": 7.0,
        "each": None, "Large": None, None: None, "2000g": None, "": None, "0g": None, "1/0 oz": None, "1 lb": 448.0, "7 Grams": 7.0, "two_gram": 2.0, "3.5 GRAMS flower": 3.5,
    }
    assert run(spark, P.size_to_grams, list(cases)) == list(cases.values())


def test_labels(spark):
    assert run(spark, P.grams_label, [1.0, 0.5, 3.5, 28.0, 0.0, -1.0, None, math.inf, 0.0625], "double") == ["1g", "0.5g", "3.5g", "28g", None, None, None, None, "0.0625g"]


def test_categories(spark):
    rows = [
        ("live resin cart", None, "Vape"), ("rosin gels", None, "Capsule"), ("Ice Cream", None, "Edible"), ("pre-rolls", None, "Pre-Roll"), ("zzz", None, "Other"), ("", None, None), (None, None, None),
        ("Edibles", "CBD Softgel 10ct", "Capsule"), ("Pre-Rolls", "Infused Flower 1g", "Pre-Roll"), ("Concentrates", "Infused Flower", "Flower"), (None, "Disposable 1g", "Vape"), ("flower", "Troche", "Flower"),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, raw string, name string, want string")
    got = df.select("i", "want", P.category_std(F.col("raw"), F.col("name")).alias("got"), P.category_overridden(F.col("raw"), F.col("name")).alias("o")).orderBy("i").collect()
    assert [r.got for r in got] == [r.want for r in got]
    assert [r.o for r in got] == [False] * 7 + [True, False, True, True, False]


def test_kinds(spark):
    rows = [
        ("Blue", "flower", "Flower", "Bud", True), ("Popcorn", None, "Flower", "Smalls", False), ("x", None, "Vape", "Unspecified", False), ("Live Rosin 1g", None, "Concentrate", "Live Rosin", False),
        ("5-pack", None, "Pre-Roll", "Pack", False), ("x", None, "Other", None, False), (None, None, None, None, False),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, n string, r string, c string, want string, d boolean")
    args = [F.col(c) for c in "nrc"]
    got = df.select("i", "want", "d", P.product_type(*args).alias("got"), P.product_type_defaulted(*args).alias("gd")).orderBy("i").collect()
    assert [(r.got, r.gd) for r in got] == [(r.want, r.d) for r in got]


def test_obtention_and_strain(spark):
    df = spark.createDataFrame([(0, "Cookie Flower", None), (1, "Kief Bud", None), (2, "Gunpowder", None), (3, "Infusd Bud", "x"), (4, "x", "Moonrocks"), (5, "1g cart", None), (6, None, None), (7, "CARTS", "")], "i int, n string, c string")
    got = [r.o for r in df.select("i", P.obtention(F.col("n"), F.col("c")).alias("o")).orderBy("i").collect()]
    assert got == [None, "Infused", None, "Infused", "Infused", "Extracted", None, "Extracted"]
    assert run(spark, P.strain_type, ["Indica-dominant", "sativa", "1:1 cbd hybrid", "n/a", "", None]) == ["Indica", "Sativa", "CBD", None, None, None]


TERPENE = "array<struct<name:string,value:double,unit:string>>"


@pytest.mark.parametrize(
    ("panel", "want", "total", "repaired"),
    [
        ([("b_myrcene", 1.0, "%"), ("Beta Myrcene", 0.2, None), ("alpha pinene", 0.5, "%"), ("β-pinene", 0.7, "%")], {"Myrcene": 1.2, "Pinene": 1.2}, 2.4, False),
        ([("myrcene", 6102.0, "%"), ("limonene", 0.5, "%")], {"Limonene": 0.5}, 0.5, True),
        ([("myrcene", 20.0, "%"), ("limonene", 15.0, "%"), ("linalool", 10.0, "%")], {"Myrcene": 2.0, "Limonene": 1.5, "Linalool": 1.0}, 4.5, True),
        ([("myrcene", 32.0, "%"), ("limonene", 1.0, "%")], {"Limonene": 1.0}, 1.0, True),
        ([("myrcene", 12.0, "mg/g")], {"Myrcene": 1.2}, 1.2, False),
        ([("myrcene", 0.0, "%"), ("limonene", 0.0, "%")], None, None, False),
        ([("myrcene", -1.0, "%"), ("other", 3.0, "%"), ("limonene", None, "%")], None, None, False),
        ([], None, None, False),
        (None, None, None, False),
    ],
)
def test_terpenes(spark, panel, want, total, repaired):
    df = P.fold_column(spark.createDataFrame([(panel,)], f"raw {TERPENE}"), "raw", "t")
    r = df.first()
    assert (None if r.t_std is None else {x.name: x.value for x in r.t_std}) == want and r.t_total == total and r.t_repaired == repaired
    if want:
        assert df.select(P.dominant_terpene(F.col("t_std"))).first()[0] == max(sorted(want), key=lambda k: want[k])


def test_potency(spark):
    rows = [("Flower", 3.0, None, True), ("Flower", 5.0, None, False), ("Flower", 3.0, 1.0, False), ("Flower", 0.0, None, False), ("Flower", None, None, False), ("Edible", 3.0, None, False), (None, 3.0, None, False), ("Flower", 4.99, 0.9, True)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, c string, thc double, cbd double, want boolean")
    assert all(r.p == r.want for r in df.select("want", P.potency_implausible(F.col("c"), F.col("thc"), F.col("cbd")).alias("p")).collect())


def test_variants(spark):
    schema = "v array<struct<option:string,price:double,sale_price:double,discounted_price:double,original_price:double>>, c string"
    df = spark.createDataFrame([([("3.5g", 35.0, 28.0, None, None), ("1g", 12.0, None, None, 15.0), ("each", None, None, None, None)], "Flower"), ([("3.5g", 35.0, None, None, None)], "Edible"), (None, "Flower")], schema)
    rows = df.select(P.enrich_variants(F.col("v"), F.col("c"), ["price", "sale_price", "discounted_price", "original_price"]).alias("e")).withColumn("s", P.smallest_size(F.col("e"))).collect()
    a, b, c = rows[0].e
    assert (a.price, a.original_price, a.size_g, a.price_per_g) == (28.0, 35.0, 3.5, 8.0)
    assert (b.price, b.original_price, b.price_per_g) == (12.0, 15.0, 12.0) and c.price is None and rows[0].s == 1.0
    assert rows[1].e[0].size_g is None and rows[1].s is None and rows[2].e is None


def test_addresses(spark):
    cases = {"123 Main Street, Suite 4": "123 main st", "1309 Stefko Blvd": "1309 stefko blvd", "219-17 Hillside Ave.": "21917 hillside ave", "100 US-50 W": "100 us 50 w", "12 North Oak Avenue #2": "12 n oak ave", "": "", None: ""}
    assert run(spark, G.address_std, list(cases)) == list(cases.values())
    assert run(spark, G.zip_key, ["P3E 4M8", "p3e4m8", "17011-1234", None, " 17011 ", "1"]) == ["P3E4M8", "P3E4M8", "17011", "", "17011", "1"]


def test_location_keys(spark):
    rows = [(40.12341, -75.0, "1 Main St", "17011"), (40.12339, -75.0, "1 Main St", "17011"), (40.1244, -75.0, None, "17011"), (None, None, "1 Main St", "17011"), (None, None, "1 Main St", None), (None, None, "Adams County", "17011"), (None, 1.0, None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, lat double, lng double, a string, z string")
    k = [r.k for r in df.select("i", G.location_key(*(F.col(c) for c in ("lat", "lng", "a", "z"))).alias("k")).orderBy("i").collect()]
    assert k[0] == k[1] != k[2] and k[3] == "1 main st|17011" and k[4:] == ["", "", ""]


def test_streets(spark):
    cases = {
        "4 - 123 Main Street NW": (123, "MAIN|ST|NW"), "Unit 4, 55 Elm Rd": (55, "ELM|RD|"), "10 Kings Court": (10, "KINGS|CRT|"), "Main Street": (None, None), None: (None, None), "12": (None, None),
        "7 North": (7, "NORTH||"), "9A Oak Avenue, S.": (9, "OAK|AVE|S"), "100 St. Mary's Road East": (100, "ST MARY S|RD|E"),
    }
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, c string")
    n, key = G.street_parts(F.col("c"))
    assert [(r.n, r.k) for r in df.select("i", n.alias("n"), key.alias("k")).orderBy("i").collect()] == list(cases.values())


def test_brands(spark):
    cases = {
        "Zen Leaf Dispensary": "Zen Leaf", "Green Goods, LLC": "Green Goods", "Bloom Holdings Inc.": "Bloom", "Cannabis Company": "Cannabis Company", "Shop – Main St": "Shop", "The Dispensary": "The Dispensary",
        "Leaf at Main Street": "Leaf", "Acme (Downtown)": "Acme", "Acme 1234 Oak": "Acme", "Curio Wellness Townsville": "Curio Wellness", "House of Townsville": "House of Townsville",
    }
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, c string")
    got = [r.b for r in df.select("i", X.extract_brand(F.col("c"), F.lit("Townsville")).alias("b")).orderBy("i").collect()]
    assert got == list(cases.values())
    assert run(spark, X.brand_key, ["Zen-Leaf™", "!!", None]) == ["zenleaf", "!!", None]
    assert run(spark, X.banner_key, ["MÜV", "Zen Léaf", None]) == ["muv", "zenleaf", None]


def test_parents(spark):
    assert run(spark, lambda c: X.parent_of_banner(c, {"zenleaf": "Verdant"}, ["dispensary"]), ["Zen Leaf", "Other", "Dispensary", "", None]) == ["Verdant", "Other", None, None, None]
    assert run(spark, lambda c: X.parent_of_brand(c, [("good news", "A"), ("news", "B")]), ["The Good News!", "newsy", "news", None]) == ["A", None, "B", None]


def test_fingerprints(spark):
    rows = [("A", "Blue  Dream", 3.5, "Bud", None, None), ("a!", " blue dream ", 3.5, "Bud", None, None), ("A", "Blue Dream", 1.0, "Bud", None, None), ("A", "Blue Dream", 3.5, "Bud", 10.0, None), ("A", "", 3.5, "Bud", None, None), ("A", None, 3.5, "Bud", None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, b string, n string, s double, t string, m double, c double")
    f = [r.f for r in df.select("i", X.fingerprint(*(F.col(c) for c in "bnstmc")).alias("f")).orderBy("i").collect()]
    assert f[0] == f[1] and len({f[0], f[2], f[3]}) == 3 and f[4] is f[5] is None


def test_placeholders(spark):
    assert run(spark, X.is_placeholder, ["TBD", "Test shop", "12.345-CL", "", None, "Contest Winners", "Bloom", "[Equity Retailer]"]) == [True, True, True, True, True, False, False, True]


def test_queries_for_geocoders(spark):
    df = spark.createDataFrame([(0, " 1  Main St", "Town", "PA", "17011"), (1, "1 Main", None, "PA", None), (2, "1 Main", None, None, None), (3, None, "Town", "PA", "1"), (4, "1 Main", "", "", "2")], "i int, a string, c string, s string, z string")
    q = [r.q for r in df.select("i", X.geocode_query(*(F.col(c) for c in "acsz")).alias("q")).orderBy("i").collect()]
    assert q == ["1 Main St, Town, PA 17011", "1 Main, PA", None, None, "1 Main, 2"]


def test_projection(spark):
    """The inverse, taken forward again by the projection's own formulae."""
    df = spark.createDataFrame([(4000000.0, 1500000.0), (6200000.0, 3000000.0), (7500000.0, 1200000.0)], "x double, y double")
    for r in df.select("x", "y", G.to_wgs84(F.col("x"), F.col("y")).alias("g")).collect():
        p, t = math.radians(r.g.latitude), math.radians(r.g.longitude) - G._LNG0
        rho = G._A * G._F0 * G._t(p) ** G._N
        assert abs(G._X0 + rho * math.sin(G._N * t) - r.x) < 1e-3 and abs(G._Y0 + G._R0 - rho * math.cos(G._N * t) - r.y) < 1e-3
    centre = df.select(G.to_wgs84(F.lit(6200000.0), F.lit(3000000.0)).alias("g")).first().g
    assert abs(centre.latitude - 63.390675) < 1e-9 and abs(centre.longitude + 91.86666666666666) < 1e-9


def test_clean(spark):
    assert run(spark, X.clean, ["  a​ \t b ", "", "​", None]) == ["a b", None, None, None]


def test_links(spark):
    kinds = {"http://x/a.PDF?x=1": "pdf", "http://x/a.csv": "csv", "http://x/a.xlsx?d": "csv", "http://x/a.kml": "kml", "http://arcgis.x/": "arcgis", "http://x/lookup": "lookup", "http://search.x/": "lookup", "http://x/": "html"}
    assert run(spark, X.classify_url, list(kinds)) == list(kinds.values())
    assert run(spark, X.classify_page, ["http://x/a.pdf", "http://maps.google.x", "http://api.x", "http://x"]) == ["pdf", "map", "api", "html"]
    rows = [("/list.pdf", "Store  Locator", 9), ("/a", "directory", 2), ("/directory", "x", 1), ("/x", "store locator privacy", -1), ("/tableau", "x", 1), ("/a", "", 0), ("/a.pdf", "x", 0), ("/directory/tableau", "a directory of store locator", 11)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, h string, t string, want int")
    got = df.select("i", "want", X.score_link(F.col("h"), F.col("t"), ["store locator"], ["directory", "locator"], ["privacy"]).alias("s")).orderBy("i").collect()
    assert [r.s for r in got] == [r.want for r in got]


def test_small_parsers(spark):
    assert run(spark, X.numbers_of, ['{"a": 1.5, "b": "x", "c": true, "d": -2}', "[1]", "x", None]) == [{"a": 1.5, "d": -2.0}, {}, {}, {}]
    assert run(spark, X.name_in, ['{"name": " A "}', "B ", "", None]) == ["A", "B", None, None]
    assert run(spark, X.host_label, ["https://www.zen-leaf.com/x", "http://shop.acme.co", "nonsense"]) == ["zenleaf", "acme", ""]
    assert run(spark, lambda c: X.brand_tokens(c, ["dispensary"]), ["Zen-Leaf Dispensary", ""]) == [["zen", "leaf"], []]
    q = run(spark, lambda c: X.homepage_queries(c, F.lit("PA"), F.lit("cannabis")), ["Acme"])[0]
    assert len(q) == 4 and q[0].startswith('"Acme"') and q[-1] == "Acme cannabis"
    assert len(run(spark, lambda c: X.list_queries(c, F.lit("cannabis"), F.lit("")), ["Ohio"])[0]) == 3
