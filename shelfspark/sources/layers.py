"""Map applications walked to the layer that holds the records, over captured JSON: items (item_id, content), pages (layer, page, content)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SERVICE = r"(?i)/(?:Feature|Map)Server(?:/[0-9]+)?/?$"


def item_of(urls: DataFrame, url: str = "url") -> DataFrame:
    """``urls`` with ``service``, whether the address is a layer or service itself, and ``item_id``, the application that its query names."""
    path = F.coalesce(F.try_parse_url(F.col(url), F.lit("PATH")), F.lit(""))
    item = F.try_parse_url(F.col(url), F.lit("QUERY"), F.lit("id"))
    return urls.withColumns({"service": path.rlike(_SERVICE), "item_id": F.nullif(item, F.lit(""))})


def _operational(items: DataFrame) -> DataFrame:
    layers = F.from_json(F.get_json_object("content", "$.operationalLayers"), "array<struct<url:string>>")
    return items.select("item_id", F.posexplode(layers).alias("ordinal", "l")).select("item_id", "ordinal", F.col("l.url").alias("layer")).filter("layer != ''")


def app_layers(apps: DataFrame, items: DataFrame) -> DataFrame:
    """(app columns, ordinal, layer) of applications (item_id, ...): their own operational layers, else those of the web map that they nest."""
    own = _operational(items)
    nested = F.coalesce(F.get_json_object("content", "$.map.itemId"), F.get_json_object("content", "$.values.webmap"))
    maps = items.join(own.select("item_id").distinct(), "item_id", "left_anti").select("item_id", nested.alias("map_id")).filter("map_id is not null")
    through = maps.join(own.withColumnRenamed("item_id", "map_id"), "map_id").select("item_id", "ordinal", "layer")
    return apps.join(own.unionByName(through), "item_id")


def first_filled(layers: DataFrame, records: DataFrame, by: str = "item_id") -> DataFrame:
    """(by, layer): of an application's layers the first for which there are ``records`` (layer, ...)."""
    return layers.join(records.select("layer").distinct(), "layer", "left_semi").groupBy(by).agg(F.min_by("layer", "ordinal").alias("layer"))


def named_layer(items: DataFrame, part: str = "authorized_to_open") -> DataFrame:
    """(item_id, layer) of an application whose layers' names change with the day: the first data source whose address has ``part`` in it."""
    sources = F.map_values(F.from_json(F.get_json_object("content", "$.dataSources"), "map<string,struct<childDataSourceJsons:map<string,struct<url:string>>>>"))
    urls = F.flatten(F.transform(F.filter(sources, lambda s: s["childDataSourceJsons"].isNotNull()), lambda s: F.transform(F.map_values(s["childDataSourceJsons"]), lambda c: c["url"])))
    fine = F.filter(urls, lambda u: F.contains(F.lower(u), F.lit(part)))
    return items.select("item_id", F.try_element_at(fine, F.lit(1)).alias("layer")).filter("layer is not null")


def layer_query(layers: DataFrame, size: int = 2000, layer: str = "layer") -> DataFrame:
    """``layers`` with ``query``: the address of a page of ``size`` records, to which an offset is added; a service's first layer where none is named, and the condition that the address carries."""
    where = F.coalesce(F.try_parse_url(F.col(layer), F.lit("QUERY"), F.lit("where")), F.lit("1=1"))
    base = F.regexp_replace(F.regexp_replace(layer, r"\?.*$", ""), "/+$", "")
    base = F.when(base.rlike("/[0-9]+$"), base).otherwise(F.concat(base, F.lit("/0")))
    return layers.withColumn("query", F.concat(base, F.lit("/query?where="), where, F.lit(f"&outFields=*&f=json&returnGeometry=false&resultRecordCount={size}&resultOffset=")))


def rotating_link(pages: DataFrame, pattern: str, base: str = "url", html: str = "html") -> DataFrame:
    """(page columns, href): the page's first link whose address matches ``pattern``, made absolute; a list whose address changes each month."""
    from shelfspark.sources import extract

    rest = [c for c in pages.columns if c != html]
    found = extract.resolved(extract.links(pages, html).filter(F.col("href").rlike(f"(?i){pattern}")), base)
    return found.groupBy(*rest).agg(F.min_by("href", "ordinal").alias("href"))


def is_workbook(content: str = "content"):
    """Whether bytes begin as a zipped workbook does; an error page sent as one doesn't."""
    return F.coalesce(F.hex(F.substring(content, 1, 4)) == "504B0304", F.lit(False))


def model_locations(captures: DataFrame, content: str = "content") -> DataFrame:
    """(capture columns, ordinal, name, address, city, state, zip_code, phone) of answers of an extraction model: {"locations": [...]} or a bare list; items that aren't objects, and answers of any other shape, have none."""
    fields = ("name", "address", "city", "state", "zip_code", "phone")
    rest = [c for c in captures.columns if c != content]
    items = F.from_json(F.when(F.trim(content).startswith("["), F.col(content)).otherwise(F.get_json_object(content, "$.locations")), "array<string>")
    rows = captures.select(*rest, F.posexplode(items).alias("ordinal", "i")).filter(F.trim("i").startswith("{"))
    return rows.select(*rest, "ordinal", *[F.get_json_object("i", f"$.{f}").alias(f) for f in fields])
