"""Queries over published lists and pages of all shapes; captures are made of the customers' keys, so that their records are known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.catalog import query
from shelfspark.functions import places as G
from shelfspark.functions import text as X
from shelfspark.operators import discovery
from shelfspark.operators import history as H
from shelfspark.plans.maps import _customers, _text
from shelfspark.sources import extract, registries

_C = "(SELECT c_custkey AS k FROM customer) c"


def _k() -> Column:
    return F.col("k")


def _some(c: Column | str, every: int) -> Column:
    """A column, null at every n-th key."""
    return F.when(_k() % every != 0, c)


def _records(df: DataFrame, *fields: str) -> DataFrame:
    return df.select("name", *fields)


@query(f"SELECT CASE WHEN k % 3 = 0 THEN 'Shop ' || k ELSE 'Trade ' || k END AS name, CASE WHEN k % 4 <> 0 THEN k || ' Main St' END AS address, 'Town' AS city, '17011' AS zip_code FROM {_C} WHERE NOT (k % 3 = 0 AND k % 5 = 0)")
def trade_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sheet with trade and facility names; the trade name goes first, nameless rows are left out."""
    df = _customers(spark, sf_dir).select(_some(_text(" Trade  ", _k()), 3).alias("dba"), _some(_text("Shop ", _k()), 5).alias("facility name"), F.when(_k() % 4 != 0, _text(_k(), " Main St")).otherwise("").alias("street"), F.lit("Town ").alias("city"), F.lit("17011").alias("zip code"))
    return _records(registries.trade_csv(df), "address", "city", "zip_code")


@query(f"SELECT 'Shop ' || k AS name, CASE WHEN k % 2 = 0 THEN '1 Own St' ELSE '2 Post St' END AS address, CASE WHEN k % 7 = 0 THEN NULL ELSE 40.5::DOUBLE END AS latitude FROM {_C} WHERE k % 3 <> 0 AND k % 5 <> 0")
def status_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active licences of the right kinds, at the premises' address or else the physical one."""
    df = _customers(spark, sf_dir).select(
        F.when(_k() % 3 == 0, "Lab").otherwise("Retail").alias("license_type"), F.when(_k() % 5 == 0, "Expired").otherwise("Active ").alias("license_status"), _text("Shop ", _k()).alias("business_name"), F.when(_k() % 2 == 0, "1 Own St").alias("address_1"), F.lit("2 Post St").alias("physical_address_1"),
        *[F.lit(None).cast("string").alias(c) for c in ("city", "physical_city", "zip_code", "physical_zip_code", "longitude")], F.when(_k() % 7 == 0, "n/a").otherwise("40.5").alias("latitude"),
    )
    return _records(registries.status_csv(df, ["Retail"]), "address", "latitude")


@query(f"SELECT 'Shop ' || k AS name, k || ' Main' || CASE WHEN k % 2 = 0 THEN ', Floor 2' ELSE '' END AS address, 'AB' AS state FROM {_C} WHERE k % 3 = 0")
def province_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One province's rows of a sheet, lot numbers taken off and both lines of the address joined."""
    df = _customers(spark, sf_dir).select(_text("Shop ", _k()).alias("name"), F.when(_k() % 5 == 0, _text("4 - ", _k(), " Main")).otherwise(_text(_k(), " Main")).alias("address"), F.when(_k() % 2 == 0, "Floor 2").alias("address2"), F.lit("T").alias("city"), F.when(_k() % 3 == 0, "AB").otherwise("SK").alias("province"), F.lit(None).cast("string").alias("zip_code"), F.lit(None).cast("string").alias("phone"))
    return _records(registries.province_sheet(df), "address", "state")


@query(f"SELECT 'Shop ' || k AS name, CASE WHEN k % 2 = 0 THEN 's' || k || '.ca' END AS website FROM {_C} WHERE k % 3 <> 0")
def active_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active rows of a sheet, "N/A" being no website."""
    df = _customers(spark, sf_dir).select(_text("Shop ", _k()).alias("name"), F.lit("1 Main").alias("address"), F.lit("T").alias("city"), F.when(_k() % 2 == 0, _text("s", _k(), ".ca")).otherwise("n/a").alias("website"), F.when(_k() % 3 == 0, "closed").otherwise(" ACTIVE").alias("status"))
    return _records(registries.active_sheet(df), "website")


@query(f"SELECT 'Shop ' || k AS name, 'BC' AS state, 50.25::DOUBLE AS latitude FROM {_C} WHERE k % 4 <> 0")
def store_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores of a JSON list; broken captures have none."""
    content = F.when(_k() % 4 == 0, "oops").otherwise(_text('[{"name": "Shop ', _k(), '", "latitude": 50.25}, {"name": " "}]'))
    return _records(registries.store_json(_customers(spark, sf_dir).select(content.alias("content"))), "state", "latitude")


@query(f"SELECT 'Shop ' || k AS name, '1 Main & Oak' AS address, 'T' AS city, 'VA' AS state, '22030' AS zip_code, CASE WHEN k % 2 = 0 THEN 38.5::DOUBLE END AS latitude FROM {_C}")
def map_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Locations in a page's escaped JSON, each once; both coordinates zero are none."""
    one = _text("{&quot;location&quot;:{&quot;addressTitle&quot;:&quot;Shop ", _k(), "&quot;,&quot;addressLine1&quot;:&quot;1 Main &amp; Oak&quot;,&quot;addressLine2&quot;:&quot;T, VA, 22030&quot;,&quot;markerLat&quot;:", F.when(_k() % 2 == 0, "38.5").otherwise("0"), ",&quot;markerLng&quot;:", F.when(_k() % 2 == 0, "-77").otherwise("0"), "}}")
    return _records(registries.map_blocks(_customers(spark, sf_dir).select(_text("<i data=", one, one, ">").alias("content"))), "address", "city", "state", "zip_code", "latitude")


@query(f"SELECT 'Shop ' || k AS name, CASE WHEN k % 3 <> 0 THEN '1 Main St' END AS address, CASE WHEN k % 3 <> 0 THEN '17011' END AS zip_code, 40.5::DOUBLE AS latitude FROM {_C}")
def marker_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markers with a formatted address, where it can be read."""
    content = _text('[{"name": "Shop ', _k(), '", "lat": "40.5", "long": "-75", "formattedAddress": "', F.when(_k() % 3 == 0, "somewhere").otherwise("1 Main St, Town, PA 17011-1234, United States"), '"}]')
    return _records(registries.markers_json(_customers(spark, sf_dir).select(content.alias("content"))), "address", "zip_code", "latitude")


@query(f"SELECT DISTINCT CASE WHEN k % 2 = 0 THEN 'Dba ' || cast(k % 50 AS VARCHAR) ELSE 'Legal ' || cast(k % 50 AS VARCHAR) END AS name, '1 Main' AS address FROM {_C} WHERE k % 3 <> 0")
def licence_records_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active retailers of a licence search, one a name and address, over all its pages."""
    content = _text('{"data": [{"businessLegalName": "Legal ', _k() % 50, '", ', F.when(_k() % 2 == 0, _text('"businessDbaName": "Dba ', _k() % 50, '", ')).otherwise(""), '"licenseType": "Commercial - Retailer", "premiseStreetAddress": "1 Main", "licenseStatus": "', F.when(_k() % 3 == 0, "Revoked").otherwise("Active"), '"}, {"businessLegalName": "Lab", "licenseType": "Testing", "licenseStatus": "Active"}]}')
    return _records(registries.licence_search(_customers(spark, sf_dir).select(content.alias("content"))), "address")


@query(f"SELECT k, 'https://map' || k || '.org/x' AS src FROM {_C}")
def frame_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames with content, not video or measurement."""
    html = _text("<iframe width=1 src='https://map", _k(), '.org/x\'></iframe><iframe src="https://www.youtube.com/y"></iframe><iframe src="/local"></iframe>')
    return registries.content_frames(_customers(spark, sf_dir).select("k", html.alias("html"))).select("k", "src")


@query(f"SELECT 'https://s' || cast(k % 20 AS VARCHAR) || '.gov/a' AS page, min(k) AS ordinal FROM {_C} WHERE k % 3 <> 0 GROUP BY 1")
def official_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links to official hosts, each page at its first place."""
    href = F.when(_k() % 3 == 0, _text("https://s", _k(), ".com/")).otherwise(_text("https://s", _k() % 20, ".gov/a#", _k()))
    return registries.official_urls(_customers(spark, sf_dir).select(_k().alias("ordinal"), href.alias("href"))).select("page", "ordinal")


@query(f"SELECT 'n' || cast(k % 7 AS VARCHAR) AS name, 'https://s' || cast(k % 20 AS VARCHAR) || '.com/a' AS page, min(k) AS ordinal FROM {_C} WHERE k % 3 = 2 GROUP BY ALL")
def candidate_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links that may lead to a company's own site: aggregators, social networks and what isn't http are none."""
    href = F.when(_k() % 3 == 0, _text("https://www.leafly.com/", _k())).when(_k() % 3 == 1, "mailto:a@b.c").otherwise(_text("https://s", _k() % 20, ".com/a#", _k()))
    return discovery.candidate_domains(_customers(spark, sf_dir).select(_text("n", _k() % 7).alias("name"), _k().alias("ordinal"), href.alias("href")), ["leafly.com"]).select("name", "page", "ordinal")


@query(f"SELECT DATE '2024-01-01' + cast(k AS INTEGER) AS rate_date, round(1 / (1 + cast(k % 50 + 1 AS DOUBLE) / 100), 6) AS rate FROM {_C} WHERE k % 4 <> 0")
def published_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A central bank's series as rates of the other direction; days without a value have none."""
    value = F.when(_k() % 4 == 0, "").otherwise(_text(F.lit(1) + (_k() % 50 + 1).cast("double") / 100))
    content = _text('{"observations": [{"d": "', F.date_add(F.lit("2024-01-01").cast("date"), _k().cast("int")), '", "FXUSDCAD": {"v": "', value, '"}}]}')
    return registries.rates_json(_customers(spark, sf_dir).select(content.alias("content"))).select("rate_date", "rate")


@query(f"SELECT 'l' || cast(k // 10 AS VARCHAR) AS layer, k % 10 AS page FROM {_C} WHERE k % 10 <= (k // 10) % 4 AND (k // 10) % 5 <> 0")
def layer_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of map layers up to the last one; an empty page ends a layer too."""
    layer, page = F.floor(_k() / 10), _k() % 10
    more = F.when(page < layer % 4, "true").otherwise("false")
    content = _text('{"exceededTransferLimit": ', F.when(layer % 5 == 0, "true").otherwise(more), ', "features": [', F.when(layer % 5 == 0, "").otherwise("{}"), "]}")
    return registries.feature_pages_done(_customers(spark, sf_dir).select(_text("l", layer).alias("layer"), page.alias("page"), content.alias("content"))).select("layer", "page")


def _resources(spark: SparkSession, sf_dir: str, content: Column, kind: str) -> DataFrame:
    return extract.resource_records(_customers(spark, sf_dir).select("k", F.encode(content, "utf-8").alias("content"), F.lit(kind).alias("list_type")))


@query(f"SELECT k, 'Shop ' || k AS name, '1 Main St' AS address, 'Town' AS city FROM {_C}")
def csv_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A published CSV file: columns by their headers, rows without a name left out."""
    return _resources(spark, sf_dir, _text("Business Name,Street Address,City\nShop ", _k(), ",1 Main St,Town\n,2 Main St,Town\n"), "csv").select("k", "name", "address", "city")


@query(f"SELECT k, 'Shop ' || k AS name, 40.5::DOUBLE AS latitude, -75.25::DOUBLE AS longitude FROM {_C}")
def kml_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placemarks of a KML file with their points."""
    content = _text('<kml xmlns="http://www.opengis.net/kml/2.2"><Document><Placemark><name>Shop ', _k(), "</name><Point><coordinates>-75.25,40.5,0</coordinates></Point></Placemark><Placemark><description>x</description></Placemark></Document></kml>")
    return _resources(spark, sf_dir, content, "kml").select("k", "name", "latitude", "longitude")


@query(f"SELECT k, 'Shop ' || k AS name, '1 Main' AS address, '17011' AS zip_code FROM {_C}")
def feature_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of a map layer, fields by what their names hold."""
    content = _text('{"features": [{"attributes": {"BusinessName": "Shop ', _k(), '", "StreetAddress": "1 Main", "ZipCode": "17011"}}, {"attributes": {"OBJECTID": 4}}]}')
    return _resources(spark, sf_dir, content, "arcgis").select("k", "name", "address", "zip_code")


@query(f"SELECT k, 'Shop ' || k AS name, '1 Main St' AS address FROM {_C}")
def table_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's table with a header."""
    html = _text("<p>x</p><table><tr><th>Name<th>Address</tr><tr><td>Shop ", _k(), "</td><td>1 Main St</td></tr><tr><td></td><td>2 Main St</td></tr></table>")
    return extract.page_records(_customers(spark, sf_dir).select("k", html.alias("html"))).select("k", "name", "address")


@query(f"SELECT k, 'Shop ' || k AS name, k || ' Main St' AS address, 'Town' AS city, 'PA' AS state, '17011' AS zip_code FROM {_C}")
def line_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses in the lines of a text: the name before, the place after."""
    lines = _customers(spark, sf_dir).select("k", F.posexplode(F.array(F.lit("Our stores"), _text("Shop ", _k()), _text(_k(), " Main St"), F.lit("Town, PA 17011"), F.lit("Phone 555"), F.lit("9 Lone St"))).alias("ordinal", "line"))
    return extract.line_addresses(lines, "k").select("k", "name", "address", "city", "state", "zip_code")


@query(f"SELECT 'g' || cast(k % 30 AS VARCHAR) AS key, 'u' || min(k) AS url FROM {_C} WHERE k % 4 <> 0 GROUP BY 1")
def first_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first candidate that answered."""
    return discovery.first_live(_customers(spark, sf_dir).select(_text("g", _k() % 30).alias("key"), _k().alias("ordinal"), _text("u", _k()).alias("url"), F.when(_k() % 4 == 0, 404).otherwise(200).alias("http_status")))


@query(f"""SELECT 'a' || k AS abbr, CASE k % 4 WHEN 0 THEN 'https://h' || k || '.gov/l.pdf' WHEN 1 THEN 'https://h' || k || '.gov/next' WHEN 2 THEN 'https://other' || k || '.gov/next' END AS list_url, CASE WHEN k % 4 = 3 THEN 'none' ELSE 'found' END AS list_status FROM {_C}""")
def lists_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the links of a landing page lead: to a list, over a middling page of the same host, or nowhere."""
    c = _customers(spark, sf_dir)
    page = lambda *rest: _text("https://h", _k(), ".gov", *rest)
    href = F.when(_k() % 4 == 2, _text("https://other", _k(), ".gov/next")).otherwise(page("/next"))
    first = c.select(page("/").alias("page"), F.lit(1).alias("ordinal"), href.alias("href"), F.when(_k() % 4 == 3, 2).otherwise(5).alias("score"))
    second = c.select(F.when(_k() % 4 == 2, _text("https://other", _k(), ".gov/next")).otherwise(page("/next")).alias("page"), F.lit(1).alias("ordinal"), page("/l.pdf").alias("href"), F.when(_k() % 2 == 1, 3).otherwise(9).alias("score"))
    return discovery.find_lists(c.select(_text("a", _k()).alias("abbr"), page("/").alias("page")), first.unionByName(second)).select("abbr", "list_url", "list_status")


@query(f"SELECT k, CASE WHEN k % 3 <> 2 THEN 'Shop ' || k END AS name, CASE WHEN k % 2 = 0 THEN 2 ELSE 0 END AS numbers, CASE WHEN k % 2 = 0 THEN 1.5::DOUBLE END AS a, k % 5 = 0 AS in_name, CASE WHEN k % 2 = 0 THEN 'acme' ELSE 'zenleaf' END AS label, CASE WHEN k % 2 = 0 THEN 'acme' ELSE 'zen' END AS token FROM {_C}")
def small_parsers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names published as text or objects, numbers in JSON, towns in names, labels of hosts, first words."""
    name = F.when(_k() % 3 == 0, _text('{"name": " Shop ', _k(), '"}')).when(_k() % 3 == 1, _text(" Shop  ", _k()))
    numbers = F.when(_k() % 2 == 0, '{"a": 1.5, "b": "x", "c": -2, "d": null}').otherwise("[broken")
    city = F.when(_k() % 5 == 0, " new  york").otherwise("York Town")
    url = F.when(_k() % 2 == 0, "http://shop.acme.co/x").otherwise("https://www.zen-leaf.com")
    rows = _customers(spark, sf_dir).select("k", X.name_in(name).alias("name"), X.numbers_of(numbers).alias("m"), X.city_in_name(city, F.lit("Shop of New-York No 2")).alias("in_name"), X.host_label(url).alias("label"), X.first_token(F.when(_k() % 2 == 0, "ACME-Shop").otherwise("Zen leaf")).alias("token"))
    return rows.select("k", "name", F.size("m").alias("numbers"), F.try_element_at("m", F.lit("a")).alias("a"), "in_name", "label", "token")


@query(f"SELECT k, ['\"Shop ' || k || '\" books store PA official website', '\"Shop ' || k || '\" store PA', '\"Shop ' || k || '\" books store official website', 'Shop ' || k || ' books'] AS home, CASE WHEN k % 2 = 0 THEN 4 ELSE 3 END AS lists, CASE k % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'map' WHEN 2 THEN 'api' ELSE 'html' END AS page_kind FROM {_C}")
def searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is searched for: companies' sites and jurisdictions' lists; what kind a result is."""
    url = F.when(_k() % 4 == 0, "https://x/a.PDF?b").when(_k() % 4 == 1, "https://maps.google.com/x").when(_k() % 4 == 2, "https://api.x/y").otherwise("https://x/y")
    return _customers(spark, sf_dir).select("k", X.homepage_queries(_text(" Shop ", _k()), F.lit("PA"), F.lit("books")).alias("home"), F.size(X.list_queries(_text("State ", _k()), F.lit("books"), F.when(_k() % 2 == 0, "Agency").otherwise(""))).alias("lists"), X.classify_page(url).alias("page_kind"))


@query(f"""SELECT location_key, operator, city FROM (SELECT *, row_number() OVER (PARTITION BY location_key ORDER BY k) AS rn FROM (SELECT k, CASE WHEN k % 3 = 0 THEN '@405000,-752500|17011' ELSE cast(k % 40 + 1 AS VARCHAR) || ' main st|17011' END AS location_key, 'Op ' || k AS operator, 'Town' AS city FROM {_C} WHERE k % 7 <> 0) x) y WHERE rn = 1""")
def roster_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A roster as observations of places: a key each, the first record of a key, those without one left out."""
    place = F.when(_k() % 3 == 0, 40.5)
    rows = _customers(spark, sf_dir).select(
        _text("Op ", _k()).alias("name"), F.when(_k() % 7 == 0, "no number").otherwise(_text(_k() % 40 + 1, " Main Street")).alias("address"), F.lit("Town").alias("city"), F.when(_k() % 7 == 0, "1").otherwise("17011").alias("zip_code"),
        F.when(_k() % 7 != 0, place).alias("latitude"), F.when((_k() % 7 != 0) & (_k() % 3 == 0), -75.25).alias("longitude"), _k().alias("ordinal"),
    )
    return H.record_roster(rows, "PA", "roster", "2024-01-04").select("location_key", "operator", "city")


@query(f"SELECT k, 'TOWNSVILLE ' || cast(k % 9 AS VARCHAR) AS city FROM {_C}")
def town_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _customers(spark, sf_dir).select("k", G.city_std(_text(F.when(_k() % 2 == 0, " Townsville ").otherwise("townsville "), _k() % 9, " ")).alias("city"))
