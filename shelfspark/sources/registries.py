"""Published lists of particular shapes to records: tables of strings or captured JSON in, columns of ``extract.RECORD`` out, in built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.functions.text import clean
from shelfspark.sources.extract import RECORD


def csv_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header, all strings; headers in lower case, trimmed."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return df.toDF(*[c.strip().lower() for c in df.columns])


def _coords(lat: Column, lng: Column) -> dict[str, Column]:
    """Both coordinates if they are numbers in range and not both zero, else neither."""
    a, b = lat.try_cast("double"), lng.try_cast("double")
    fine = a.between(-90, 90) & b.between(-180, 180) & ((a != 0) | (b != 0))
    return {"latitude": F.when(fine, a), "longitude": F.when(fine, b)}


def to_records(df: DataFrame, source: str, keep: list[str] | None = None, **fields: Column) -> DataFrame:
    """Rows with a name as records; fields that aren't given are null."""
    columns = {"source": F.lit(source), **fields}
    found = df.select(*[F.col(c) for c in keep or []], *[(columns[f.name] if f.name in columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in RECORD])
    return found.filter("name is not null")


def _c(name: str) -> Column:
    return clean(F.col(f"`{name}`"))


def strip_lot(address: Column) -> Column:
    """Without "4 -" before the house number, unless nothing is left."""
    short = F.trim(F.regexp_replace(address, r"^\s*[A-Za-z0-9]{1,4}\s*-\s*(?=[0-9])", ""))
    return F.coalesce(F.nullif(short, F.lit("")), address)


def trade_csv(df: DataFrame) -> DataFrame:
    """dba, facility name, street, city, zip code: the trade name goes before the facility's."""
    return to_records(df, "trade_csv", name=F.coalesce(_c("dba"), _c("facility name")), address=_c("street"), city=_c("city"), zip_code=_c("zip code"))


def status_csv(df: DataFrame, kinds: list[str]) -> DataFrame:
    """Licences of certain kinds that are active; the premises' address, else the physical one."""
    fine = F.col("license_type").isin(kinds) & (F.trim("license_status") == "Active")
    either = lambda c: F.coalesce(_c(c), _c(f"physical_{c}"))
    number = {"latitude": F.col("latitude").try_cast("double"), "longitude": F.col("longitude").try_cast("double")}
    return to_records(df.filter(fine), "status_csv", name=_c("business_name"), address=either("address_1"), city=either("city"), zip_code=either("zip_code"), **number)


def province_sheet(df: DataFrame, province: str = "AB") -> DataFrame:
    """A sheet of establishments (name, address, address2, city, province, zip_code, phone) of one province."""
    street = F.concat_ws(", ", strip_lot(_c("address")), _c("address2"))
    return to_records(df.filter(F.col("province") == province), "province_sheet", name=_c("name"), address=F.nullif(street, F.lit("")), city=_c("city"), state=F.lit(province), zip_code=_c("zip_code"), phone=_c("phone"))


def active_sheet(df: DataFrame, state: str = "SK") -> DataFrame:
    """A sheet with a status; only active rows, "N/A" being no website."""
    site = _c("website")
    return to_records(df.filter(F.lower(F.trim("status")) == "active"), "active_sheet", name=_c("name"), address=strip_lot(_c("address")), city=_c("city"), state=F.lit(state), website=F.when(~F.upper(site).isin("N/A", "NA", "-"), site))


_STORE = "array<struct<name:string,addressStreet:string,addressCity:string,addressPostal:string,phone:string,latitude:double,longitude:double>>"


def store_json(captures: DataFrame, content: str = "content", state: str = "BC") -> DataFrame:
    """A JSON list of stores, also those not open yet."""
    df = captures.select(F.explode(F.from_json(content, _STORE)).alias("s")).select("s.*")
    return to_records(df, "store_json", name=_c("name"), address=_c("addressStreet"), city=_c("addressCity"), state=F.lit(state), zip_code=_c("addressPostal"), phone=_c("phone"), latitude=F.col("latitude"), longitude=F.col("longitude"))


def map_blocks(captures: DataFrame, content: str = "content") -> DataFrame:
    """Flat "location" objects inside a page's escaped JSON; one record a name and address."""
    plain = F.replace(F.replace(F.col(content), F.lit("&quot;"), F.lit('"')), F.lit("&amp;"), F.lit("&"))
    found = captures.select(F.posexplode(F.regexp_extract_all(plain, F.lit(r'"location":([{][^{}]*[}])'), F.lit(1))).alias("pos", "j"))
    df = found.select("pos", F.from_json("j", "addressTitle string, addressLine1 string, addressLine2 string, markerLat double, markerLng double").alias("l")).select("pos", "l.*")
    part = lambda k: F.nullif(F.trim(F.regexp_extract("addressLine2", r"^\s*([^,]+),\s*([A-Z]{2}),?\s*([0-9]{5})", k)), F.lit(""))
    out = to_records(df.filter(F.length(F.trim("addressLine1")) > 0), "map_blocks", ["pos"], name=_c("addressTitle"), address=_c("addressLine1"), city=part(1), state=part(2), zip_code=part(3), **_coords(F.col("markerLat"), F.col("markerLng")))
    first = out.groupBy(F.lower("name").alias("n"), F.lower("address").alias("a")).agg(F.min_by(F.struct(*RECORD.names), "pos").alias("r"))
    return first.select("r.*")


def markers_json(captures: DataFrame, content: str = "content") -> DataFrame:
    """Map markers with a formatted address; one that can't be parsed leaves name, link and coordinates."""
    marker = "array<struct<name:string,lat:string,long:string,formattedAddress:string,buttonLink:string>>"
    df = captures.select(F.explode(F.from_json(content, marker)).alias("m")).select("m.*")
    part = lambda k: F.nullif(clean(F.regexp_extract(F.trim("formattedAddress"), r"^(.+?),\s*([^,]+),\s*([A-Z]{2})\s+([0-9]{5})(?:-[0-9]{4})?(?:,\s*[ .A-Za-z]+)?$", k)), F.lit(""))
    number = {"latitude": F.col("lat").try_cast("double"), "longitude": F.col("long").try_cast("double")}
    return to_records(df, "markers_json", name=_c("name"), address=part(1), city=part(2), state=part(3), zip_code=part(4), website=_c("buttonLink"), **number)


_LICENCE = "businessDbaName:string,businessLegalName:string,licenseStatus:string,licenseType:string,premiseStreetAddress:string,premiseCity:string,premiseState:string,premiseZipCode:string,businessPhone:string,premiseLatitude:double,premiseLongitude:double"


def licence_search(captures: DataFrame, content: str = "content") -> DataFrame:
    """Pages of a licence search: active retailers, one a name and address; the trade name goes before the legal one."""
    parsed = F.from_json(content, f"struct<data:array<struct<{_LICENCE}>>>")
    df = captures.select(F.explode(parsed["data"]).alias("d")).select("d.*").filter((F.col("licenseStatus") == "Active") & F.lower("licenseType").contains("retailer"))
    fields = {"address": "premiseStreetAddress", "city": "premiseCity", "state": "premiseState", "zip_code": "premiseZipCode", "phone": "businessPhone"}
    name = F.coalesce(_c("businessDbaName"), _c("businessLegalName"))
    out = to_records(df, "licence_search", name=name, **{f: _c(c) for f, c in fields.items()}, latitude=F.col("premiseLatitude"), longitude=F.col("premiseLongitude"))
    return out.dropDuplicates(["name", "address"])


def quadrants(points: DataFrame, box: tuple[float, float, float, float], page: int = 1000, depth: int = 6) -> DataFrame:
    """(lat0, lat1, lng0, lng1, level, n) of boxes to ask for so that none holds over ``page`` of the ``points`` (lat, lng): quartered until they fit, ``depth`` times at most; a box of over ``page`` at that depth says so by its ``n``.

    Points are counted once in the finest cells, and cells rolled up to each
    level: a box is asked for if it fits (or can't be quartered) and the box
    around it doesn't.
    """
    lat0, lat1, lng0, lng1 = box
    cells = 2**depth
    inside = points.filter((F.col("lat") >= lat0) & (F.col("lat") < lat1) & (F.col("lng") >= lng0) & (F.col("lng") < lng1))
    at = lambda c, a, b: F.least(F.floor((F.col(c) - a) / (b - a) * cells), F.lit(cells - 1)).cast("int")
    finest = inside.groupBy(at("lat", lat0, lat1).alias("y"), at("lng", lng0, lng1).alias("x")).agg(F.count(F.lit(1)).alias("n"))
    up = finest.select(F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("level"), "y", "x", "n")
    step = F.pow(F.lit(2), F.lit(depth) - F.col("level")).cast("int")
    levels = up.groupBy("level", F.floor(F.col("y") / step).cast("int").alias("y"), F.floor(F.col("x") / step).cast("int").alias("x")).agg(F.sum("n").alias("n"))
    over = levels.filter((F.col("n") > page) & (F.col("level") < depth)).select("level", "y", "x")  # to be quartered
    quarters = over.select((F.col("level") + 1).alias("level"), F.explode(F.array(*[F.struct((F.col("y") * 2 + i).alias("y"), (F.col("x") * 2 + j).alias("x")) for i in (0, 1) for j in (0, 1)])).alias("q")).select("level", "q.y", "q.x")
    root = points.sparkSession.range(1).select(F.lit(0).alias("level"), F.lit(0).alias("y"), F.lit(0).alias("x"))
    asked = root.unionByName(quarters).join(over, ["level", "y", "x"], "left_anti").join(levels, ["level", "y", "x"], "left")
    size = F.pow(F.lit(2.0), F.col("level"))
    edge = lambda c, a, b, k: F.lit(a) + (F.lit(b) - F.lit(a)) * (F.col(c) + k) / size
    return asked.select(edge("y", lat0, lat1, 0).alias("lat0"), edge("y", lat0, lat1, 1).alias("lat1"), edge("x", lng0, lng1, 0).alias("lng0"), edge("x", lng0, lng1, 1).alias("lng1"), "level", F.coalesce("n", F.lit(0)).alias("n"))


def content_frames(pages: DataFrame, html: str = "html") -> DataFrame:
    """Addresses of a page's frames that hold content, not measurement or video."""
    found = F.regexp_extract_all(F.col(html), F.lit(r"""<iframe[^>]*src=["'](http[^"']*)["']"""), F.lit(1))
    rest = [c for c in pages.columns if c != html]
    junk = r"(?i)doubleclick|facebook|google-analytics|googletagmanager|recaptcha|vimeo|youtube"
    return pages.select(*rest, F.posexplode(found).alias("ordinal", "src")).filter(~F.col("src").rlike(junk))


def official_urls(links: DataFrame, url: str = "href", endings: tuple[str, ...] = (".gov", ".us"), skip: tuple[str, ...] = ()) -> DataFrame:
    """(ordinal, page) of links to hosts of certain endings, fragments cut off, each once at its first place."""
    host = F.lower(F.try_parse_url(F.col(url), F.lit("HOST")))
    fine = F.lit(False)
    for e in endings:
        fine = fine | host.endswith(e)
    for s in skip:
        fine = fine & ~host.contains(s)
    page = F.regexp_replace(url, "#.*$", "")
    return links.filter(F.col(url).startswith("http") & fine).groupBy(page.alias("page")).agg(F.min("ordinal").alias("ordinal")).select("ordinal", "page")


def rates_json(captures: DataFrame, content: str = "content", series: str = "FXUSDCAD", source: str = "valet") -> DataFrame:
    """(rate_date, base_ccy, quote_ccy, rate, source) of a central bank's JSON of Canadian dollars a US dollar: the reciprocal, days without a value left out."""
    rows = captures.select(F.explode(F.from_json(F.get_json_object(content, "$.observations"), "array<map<string,string>>")).alias("o"))
    value = F.get_json_object(F.try_element_at("o", F.lit(series)), "$.v").try_cast("double")
    out = rows.select(F.try_to_date(F.try_element_at("o", F.lit("d")), "yyyy-MM-dd").alias("rate_date"), F.lit("CAD").alias("base_ccy"), F.lit("USD").alias("quote_ccy"), F.round(1 / value, 6).alias("rate"), F.lit(source).alias("source"))
    return out.filter("rate_date is not null and rate is not null")


def feature_pages_done(pages: DataFrame, content: str = "content", cap: int = 25) -> DataFrame:
    """Pages (layer, page, content) of a paged map layer up to the first that is empty or says that no more follow, ``cap`` at most."""
    from pyspark.sql import Window

    more = F.coalesce(F.get_json_object(content, "$.exceededTransferLimit") == "true", F.lit(False))
    empty = F.coalesce(F.get_json_object(content, "$.features[0]").isNull(), F.lit(True))
    w = Window.partitionBy("layer").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    rows = pages.withColumns({"_more": more, "_empty": empty})
    ended = F.coalesce(F.max((~F.col("_more") | F.col("_empty")).cast("int")).over(w), F.lit(0))
    return rows.withColumn("_ended", ended).filter((F.col("_ended") == 0) & ~F.col("_empty") & (F.col("page") < cap)).drop("_more", "_empty", "_ended")


def feature_pages_cut(pages: DataFrame, content: str = "content", cap: int = 25) -> DataFrame:
    """(layer) of the paged layers that ``feature_pages_done`` cuts off: their last page within ``cap`` says that more follow."""
    more = F.coalesce(F.get_json_object(content, "$.exceededTransferLimit") == "true", F.lit(False))
    return feature_pages_done(pages, content, cap).filter((F.col("page") == cap - 1) & more).select("layer").distinct()
