"""Captured documents to tables of records and links, in Arrow batches; simple lines without leaving the JVM."""

from __future__ import annotations

from collections.abc import Callable
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.functions.text import classify_url, clean, score_link
from shelfspark.sources import markup

_TEXT = ("source", *markup.FIELDS)
RECORD = T.StructType([*(T.StructField(f, T.StringType()) for f in _TEXT), T.StructField("latitude", T.DoubleType()), T.StructField("longitude", T.DoubleType())])


def _records(df: DataFrame, keep: list[str], fn: Callable[[dict], list[dict]]) -> DataFrame:
    """A row for each record that ``fn`` makes of a row, with columns ``keep`` and the record's place."""
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField("ordinal", T.LongType()), *RECORD.fields])

    def run(batches):
        for batch in batches:
            at, found = [], []
            for k, row in enumerate(batch.to_pylist()):
                for n, r in enumerate(fn(row)):
                    at.append(k)
                    found.append({"ordinal": n, **r})
            kept = [batch.column(batch.schema.get_field_index(c)).take(pa.array(at, pa.int64())) for c in keep]
            new = [pa.array([r["ordinal"] for r in found], pa.int64())]
            new += [pa.array([r[f.name] for r in found], pa.string() if f.dataType == T.StringType() else pa.float64()) for f in RECORD]
            yield pa.RecordBatch.from_arrays([*kept, *new], names=[*keep, "ordinal", *RECORD.names])

    return df.mapInArrow(run, schema)


def page_records(pages: DataFrame, html: str = "html") -> DataFrame:
    """Records of HTML pages: of its tables, else of address blocks, else of lines. Null or broken pages have none."""
    return _records(pages, [c for c in pages.columns if c != html], lambda r: markup.page(r[html]) if r[html] else [])


def resource_records(captures: DataFrame, content: str = "content", kind: str = "list_type") -> DataFrame:
    """Records of captured resources (bytes), each read as its bytes or kind say."""
    return _records(captures, [c for c in captures.columns if c not in (content, kind)], lambda r: markup.dispatch(bytes(r[content]) if r[content] is not None else None, r[kind]))


class _Anchors(HTMLParser):
    """Anchors in order: [href, label, class]. An anchor that begins within another ends it, as in browsers."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[list] = []
        self.open = False

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            own = dict(reversed(attrs))  # the first of a repeated attribute counts
            self.open = "href" in own
            if self.open:
                self.found.append([own["href"] or "", [], own.get("class") or ""])

    def handle_endtag(self, tag):
        if tag == "a":
            self.open = False

    def handle_data(self, data):
        if self.open:
            self.found[-1][1].append(data)


def anchors(html: str) -> list[tuple[str, str, str]]:
    """(href, label, class) of a page's anchors; labels are all the text within, blanks at the ends cut off."""
    p = _Anchors()
    p.feed(html)
    p.close()
    return [(h, "".join(t).strip(), c) for h, t, c in p.found]


def links(pages: DataFrame, html: str = "html") -> DataFrame:
    """(page columns, ordinal from 1, href, label, css) of the anchors of pages, by an HTML parser in Arrow batches. Null pages have none."""
    rest = [c for c in pages.columns if c != html]
    schema = T.StructType([*(pages.schema[c] for c in rest), T.StructField("ordinal", T.LongType()), *(T.StructField(c, T.StringType()) for c in ("href", "label", "css"))])

    def run(batches):
        for batch in batches:
            own = [(k, n, *a) for k, page in enumerate(batch.column(batch.schema.get_field_index(html)).to_pylist()) if page for n, a in enumerate(anchors(page), 1)]
            at, *new = zip(*own) if own else ([],) * 5
            kept = [batch.column(batch.schema.get_field_index(c)).take(pa.array(at, pa.int64())) for c in rest]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(new[0], pa.int64()), *(pa.array(c, pa.string()) for c in new[1:])], names=schema.names)

    return pages.mapInArrow(run, schema)


@F.pandas_udf(T.StringType())
def _joined(base: pd.Series, href: pd.Series) -> pd.Series:
    def one(b, h):
        try:
            return urljoin(b or "", h)
        except ValueError:
            return None

    return pd.Series([one(b, h) for b, h in zip(base, href)], dtype=object)


def resolved(found: DataFrame, base: str) -> DataFrame:
    """``links`` with ``href`` made absolute against the column ``base``, its fragment cut off; anchors within the page, mail, telephone, scripts and what isn't http are left out."""
    skip = F.col("href").rlike("^(#|mailto:|tel:|javascript:)") | (F.col("href") == "")
    full = found.filter(~skip).withColumn("href", _joined(F.col(base), F.col("href")))
    return full.filter(F.col("href").startswith("http")).withColumn("href", F.substring_index("href", "#", 1))


def harvest(pages: DataFrame, base: str, strong: list[str], medium: list[str], deny: list[str], html: str = "html") -> DataFrame:
    """(page columns, href, score, label, kind) of the addresses that a page's links lead to and that look like a list: of several links to one the first of the highest score; labels are cut to 60 characters."""
    rest = [c for c in pages.columns if c != html]
    scored = resolved(links(pages, html), base).withColumn("score", score_link(F.col("href"), F.col("label"), strong, medium, deny)).filter("score > 0")
    best = scored.groupBy(*rest, "href").agg(F.max_by(F.struct("score", "label"), F.struct("score", -F.col("ordinal"))).alias("b"))
    return best.select(*rest, "href", "b.score", F.substring("b.label", 1, 60).alias("label"), classify_url(F.col("href")).alias("kind"))


def line_addresses(lines: DataFrame, page: str = "page_id") -> DataFrame:
    """(page, ordinal, name, address, city, state, zip_code) of lines (page, ordinal, line): a street line, the place after it, the name before it."""
    w = Window.partitionBy(page).orderBy("ordinal")
    rows = lines.withColumns({"after": F.lead("line").over(w), "before": F.lag("line").over(w)})
    place = r"^([-' .A-Za-z]{2,40}),\s*([A-Z]{2})\s+([A-Z][0-9][A-Z] ?[0-9][A-Z][0-9]|[0-9]{5}(?:-[0-9]{4})?)$"
    fine = F.col("line").rlike(r"^[0-9]{1,6}\s+[0-9A-Za-z][-#',. \w]{2,50}$") & F.col("after").rlike(place) & F.col("before").rlike("(?U)\\p{L}") & F.length("before").between(3, 60)
    part = lambda k: clean(F.regexp_extract("after", place, k))
    found = rows.filter(fine).select(page, "ordinal", clean(F.col("before")).alias("name"), clean(F.col("line")).alias("address"), part(1).alias("city"), part(2).alias("state"), part(3).alias("zip_code"))
    first = Window.partitionBy(page, F.lower("address")).orderBy("ordinal")
    return found.withColumn("rn", F.row_number().over(first)).filter("rn = 1").drop("rn")


def word_boxes_to_rows(words: DataFrame, columns: list[tuple[str, float]], start: str, line_height: float = 3.0, slack: float = 6.0) -> DataFrame:
    """(page, record, columns...) of words (page, x, top, text) of a printed table: a word belongs to the last column that begins left of it,
    a line is a step of ``line_height``, a record begins at a line whose first column ``start`` matches, and later lines go on with it."""
    name = F.lit(columns[0][0])
    for c, x in columns:
        name = F.when(F.col("x") >= x - slack, c).otherwise(name)
    w = words.withColumns({"line": F.round(F.col("top") / line_height), "column": name})
    opens = w.groupBy("page", "line").agg(F.bool_or((F.col("column") == columns[0][0]) & F.col("text").rlike(start)).alias("opens"))
    numbered = opens.withColumn("record", F.sum(F.col("opens").cast("int")).over(Window.partitionBy("page").orderBy("line")))
    cells = w.join(numbered.filter("record > 0").drop("opens"), ["page", "line"])
    own = cells.groupBy("page", "record", "column").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "x", "text"))), lambda s: s["text"]), " ").alias("value"))
    return own.groupBy("page", "record").pivot("column", [c for c, _ in columns]).agg(F.first("value"))
