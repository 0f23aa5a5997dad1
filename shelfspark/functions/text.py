"""Names, brands and texts: functions from columns to columns, all of built-in expressions unless said."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark import rules


def _some(c: Column) -> Column:
    """Null for null and ""."""
    return F.when(F.length(c) > 0, c)


def clean(c: Column) -> Column:
    """Without zero-width characters, blanks collapsed; null if nothing is left."""
    bare = F.translate(c, "​‌‍﻿", "")
    return _some(F.trim(F.regexp_replace(bare, r"(?U)\s+", " ")))


def alnum_key(c: Column) -> Column:
    """Lower-case letters and digits only."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def brand_key(c: Column) -> Column:
    """``alnum_key``, or the lower-case name if it has none of those characters."""
    return F.coalesce(_some(alnum_key(c)), F.trim(F.lower(c)))


_SHOP = r"(?i)\s+(?:" + "|".join(rules.SHOP_ENDINGS) + r")$"
_LEGAL = r"(?i)[,\s]+(?:" + "|".join(rules.LEGAL_ENDINGS) + r")\.?$"
_DASHES = ("–—", "--")


def keeps_brand(c: Column) -> Column:
    """Whether a shortened name still has a letter and isn't an article."""
    return (F.length(c) > 0) & ~F.lower(c).isin(rules.ARTICLES) & c.rlike(r"(?U)\p{L}")


def is_bare_generic(c: Column) -> Column:
    """Whether a name only says what kind of shop it is."""
    return F.trim(F.regexp_replace(F.concat(F.lit(" "), c), _SHOP, "")) == ""


def let(c: Column, f) -> Column:
    """``f`` of a value that is evaluated once, however often ``f`` uses it: steps that follow on each other stay linear in size."""
    return F.element_at(F.transform(F.array(c), f), 1)


def strip_legal_entity(c: Column) -> Column:
    """Without endings of incorporation, as long as a brand is left; an ending is a word at least, so as many steps as words come to the end."""

    def step(now: Column, _word: Column) -> Column:
        shorter = F.regexp_replace(F.regexp_replace(now, _LEGAL, ""), r"^[ ,.]+|[ ,.]+$", "")
        return let(shorter, lambda s: F.when(keeps_brand(s) & ~is_bare_generic(s), s).otherwise(now))

    return let(F.trim(c), lambda n: F.aggregate(F.split(n, r"[,\s]+"), n, step))


def _last_word(c: Column) -> Column:
    return F.element_at(F.split(F.lower(c), " "), -1)


def strip_store_suffix(c: Column) -> Column:
    """Without a closing parenthesis or street address, unless too little is left."""

    def fine(s: Column) -> Column:
        return (F.length(s) >= 3) & s.rlike(r"(?U)\p{L}") & ~_last_word(s).isin(rules.CONNECTORS)

    def without(pattern: str):
        return lambda x: let(F.regexp_replace(F.trim(F.regexp_replace(x, pattern, "")), ",+$", ""), lambda s: F.when((s != x) & fine(s), s).otherwise(x))

    return let(let(c, without(r"\s*[(][^()]*[)]\s*$")), without(r"\s+[0-9]{3,}[-',. 0-9A-Za-z]*$"))


def strip_city(brand: Column, city: Column) -> Column:
    """Without the store's city at the end, unless too little is left."""
    name = F.lower(F.trim(city))
    short = F.trim(F.substr(brand, F.lit(1), F.length(brand) - F.length(name)))
    ends = (F.length(name) > 0) & F.lower(brand).endswith(F.concat(F.lit(" "), name))
    return F.when(F.coalesce(ends, F.lit(False)), let(short, lambda s: F.when((F.length(s) >= 3) & ~_last_word(s).isin(rules.CONNECTORS), s).otherwise(brand))).otherwise(brand)


def without_shop(c: Column) -> Column:
    return let(c, lambda x: let(F.trim(F.regexp_replace(x, _SHOP, "")), lambda s: F.when(keeps_brand(s), s).otherwise(x)))


def _before_separator(n: Column) -> Column:
    at = F.trim(F.regexp_extract(n, r"(?i)^(.*?)\s+at\s+", 1))
    fine = keeps_brand(F.trim(F.regexp_replace(F.concat(F.lit(" "), at), _SHOP, "")))
    return (
        F.when(n.contains(" - "), F.trim(F.element_at(F.split(n, " - "), 1)))
        .when(n.contains("- "), F.trim(F.element_at(F.split(n, "- "), 1)))
        .when(n.rlike(r"(?i)\s+at\s+") & (at != "") & fine, at)
        .otherwise(n)
    )


def extract_brand(name: Column, city: Column | None = None) -> Column:
    """The brand in a shop's name: the part before a separator, without legal form, kind of shop, address and city."""
    n = let(F.trim(F.translate(name, *_DASHES)), lambda n: F.coalesce(_some(F.trim(F.element_at(F.split(n, r"\s*[;,]\s*"), 1))), n))
    brand = strip_store_suffix(without_shop(strip_legal_entity(let(n, _before_separator))))
    if city is None:
        return brand
    return let(brand, lambda b: let(strip_city(b, city), lambda s: F.when(s != b, without_shop(s)).otherwise(b)))


def fingerprint(brand: Column, name: Column, size_g: Column, product_type: Column, thc_mg: Column, cbd_mg: Column) -> Column:
    """SHA-1 of what makes a product the same one; null without a name. Doses count only if there is one."""
    tidy = F.trim(F.regexp_replace(F.lower(name), r"(?U)\s+", " "))
    two = lambda c: F.format_string("%.2f", F.coalesce(c, F.lit(0.0)))
    base = F.concat_ws("|", brand_key(F.coalesce(brand, F.lit(""))), tidy, F.when(size_g.isNotNull(), two(size_g)).otherwise(""), F.coalesce(product_type, F.lit("")))
    dose = F.concat_ws("|", base, F.concat(F.lit("thc_mg="), two(thc_mg)), F.concat(F.lit("cbd_mg="), two(cbd_mg)))
    return F.when(F.length(tidy) > 0, F.sha1(F.when(thc_mg.isNotNull() | cbd_mg.isNotNull(), dose).otherwise(base)))


def is_placeholder(c: Column) -> Column:
    """Whether a name is null, blank, a stand-in or a licence number."""
    return F.coalesce((F.trim(c) == "") | c.rlike(f"(?iU){rules.PLACEHOLDER}") | F.trim(c).rlike(f"(?i){rules.LICENCE}"), F.lit(True))


def geocode_query(address: Column, city: Column, state: Column, zip_code: Column) -> Column:
    """One line for a geocoder; null without an address or without all of city, state and zip."""
    one = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    locality = _some(F.concat_ws(" ", _some(F.trim(state)), _some(F.trim(zip_code))))
    there = (F.length(address) > 0) & ((F.coalesce(F.length(city), F.lit(0)) > 0) | (F.coalesce(F.length(zip_code), F.lit(0)) > 0) | (F.coalesce(F.length(state), F.lit(0)) > 0))
    return F.when(there, F.concat_ws(", ", one(address), F.when(F.length(city) > 0, one(city)), locality))


def readability(c: Column) -> Column:
    """Order of spellings: more blanks, then longer, then later in the alphabet is more readable."""
    return F.struct((F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))).alias("blanks"), F.length(c).alias("length"), c.alias("spelling"))


def first_token(c: Column) -> Column:
    """The first run of letters and digits, or the lower-case name if it doesn't begin with one."""
    return F.coalesce(_some(F.element_at(F.split(F.lower(c), "[^a-z0-9]+"), 1)), F.lower(c))


def city_in_name(city: Column, name: Column) -> Column:
    """Whether the city's words stand in the name as a run of whole words."""
    words = lambda c: F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " ")), F.lit(" "))
    return F.coalesce((F.trim(city) != "") & F.contains(words(name), words(city)), F.lit(False))


@F.pandas_udf(T.StringType())
def _fold_accents(s: pd.Series) -> pd.Series:
    import unicodedata

    return s.map(lambda x: None if x is None else "".join(ch for ch in unicodedata.normalize("NFKD", x) if not unicodedata.combining(ch)), na_action="ignore")


def banner_key(c: Column) -> Column:
    """``alnum_key`` with accents folded (a vectorised Python step: there is no such built-in)."""
    return alnum_key(_fold_accents(c))


def lookup(c: Column, table: Mapping[str, str]) -> Column:
    """The value of a key in a small table; null if it isn't there."""
    pairs = F.create_map(*[F.lit(x) for kv in sorted(table.items()) for x in kv]) if table else F.lit(None)
    return F.try_element_at(pairs, c) if table else F.lit(None).cast("string")


def parent_of_banner(name: Column, parents: Mapping[str, str], generic: list[str]) -> Column:
    """The operator behind a banner: its parent if listed, itself if not, null if it names nobody."""
    key = alnum_key(name)
    return F.when(key.isin(generic) | (key == ""), None).otherwise(F.coalesce(lookup(key, parents), name))


def operator_key(name: Column, parents: Mapping[str, str], generic: list[str], fold_spelling: bool = False) -> Column:
    """By what an operator is counted: its parent, or its own name (its key, if spellings are to be folded); null if the name names nobody."""
    parent = parent_of_banner(name, parents, generic)
    return parent if not fold_spelling else F.when(lookup(alnum_key(name), parents).isNotNull(), parent).otherwise(alnum_key(parent))


def reason_not_an_identity(name: Column, reasons: Mapping[str, str]) -> Column:
    """Why a name can't stand for one company; null if it can."""
    return lookup(alnum_key(name), reasons)


def is_corporate_identity(name: Column, reasons: Mapping[str, str]) -> Column:
    return F.coalesce(F.length(name) > 0, F.lit(False)) & reason_not_an_identity(name, reasons).isNull()


def address_or_null(c: Column) -> Column:
    """Null for a date in an address's place."""
    return F.when(~c.rlike(r"^\s*[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}\s*$"), c)


def cell_text(c: Column) -> Column:
    """A spreadsheet's cell as text: numbers (as Java prints them) without their fraction."""
    number = F.trim(c).rlike(r"^-?[0-9]+(\.[0-9]*)?([eE]\+?[0-9]+)?$")
    return F.when(number, F.trim(c).try_cast("double").cast("bigint").cast("string")).otherwise(clean(c))


def only_terms(only: str) -> list[str] | None:
    """The terms of a list with commas, lower-case; None if there are none."""
    return sorted({t.strip().lower() for t in only.split(",") if t.strip()}) or None


def in_scope(c: Column, only: str) -> Column:
    """Whether a text holds one of the terms; everything does if there are none."""
    terms = only_terms(only)
    return F.lit(True) if terms is None else F.coalesce(_any([F.contains(F.lower(c), F.lit(t)) for t in terms]), F.lit(False))


def day_of(iso: Column) -> Column:
    """The date that an ISO text begins with."""
    return F.try_to_date(F.substr(iso, F.lit(1), F.lit(10)), "yyyy-MM-dd")


def parent_of_brand(brand: Column, aliases: list[tuple[str, str]]) -> Column:
    """Parent of the first alias, in the list's order, that stands in the brand as whole words."""
    found = [F.when(F.lower(brand).rlike(rf"(?<![a-z0-9]){alias}(?![a-z0-9])"), F.lit(parent)) for alias, parent in aliases]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


DOCUMENTS, MAPS = (".csv", ".pdf", ".xls", ".xlsx"), ("/maps/d/", "arcgis", "socrata", "tableau", "webappviewer")


def _any(cs: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, cs, F.lit(False))


def score_link(href: Column, label: Column, strong: list[str], medium: list[str], deny: list[str]) -> Column:
    """How much a link looks like one to a list: 4 for each strong phrase in the label, 2 for each medium word in it (1 if only in the address),
    3 for a document or map that also has one of them, 1 for a map without. No label: 0; a denied word in the label: -1."""
    h, t = F.lower(href), F.trim(F.regexp_replace(F.lower(F.coalesce(label, F.lit(""))), r"\s+", " "))
    some = _any([t.contains(w) for w in (*strong, *medium)] + [h.contains(w) for w in medium])
    points = [F.when(t.contains(w), 4).otherwise(0) for w in strong] + [F.when(t.contains(w), 2).when(h.contains(w), 1).otherwise(0) for w in medium]
    points.append(F.when(some & _any([h.endswith(e) for e in DOCUMENTS]), 3).otherwise(0))
    points.append(F.when(_any([h.contains(m) for m in MAPS]), F.when(some, 3).otherwise(1)).otherwise(0))
    return F.when(t == "", 0).when(_any([t.contains(w) for w in deny]), -1).otherwise(reduce(lambda a, b: a + b, points, F.lit(0)))


def classify_url(c: Column) -> Column:
    """What kind of list an address leads to: pdf, csv (any sheet), kml, arcgis (any map application), lookup or html."""
    u = F.lower(c)
    ends = lambda e: u.endswith(e) | u.contains(f"{e}?")
    return (
        F.when(ends(".pdf"), "pdf")
        .when(_any([ends(e) for e in DOCUMENTS]), "csv")
        .when(u.contains("kml") | u.contains("/maps/d/"), "kml")
        .when(_any([u.contains(m) for m in MAPS]), "arcgis")
        .when(u.rlike(r"^[a-z]+://search\.") | u.contains("lookup") | u.contains("verification") | u.contains("/search"), "lookup")
        .otherwise("html")
    )


def classify_page(c: Column) -> Column:
    """What kind of page a search result is: pdf, map, api or html."""
    u = F.lower(c)
    return F.when(u.endswith(".pdf") | u.contains(".pdf?"), "pdf").when(_any([u.contains(m) for m in ("/maps/d/", "kml", "maps.google")]), "map").when(_any([u.contains(m) for m in (".json", "/api/", "api.")]), "api").otherwise("html")


def list_queries(name: Column, term: Column, agency: Column) -> Column:
    """Searches for a jurisdiction's list."""
    own = F.array(F.concat(name, F.lit(" "), term, F.lit(" licensed stores")), F.concat(name, F.lit(" "), term, F.lit(" store list site:gov")), F.when(agency != "", F.concat(agency, F.lit(" store list"))), F.concat(name, F.lit(" licensed retail site:gov")))
    return F.array_compact(own)


def homepage_queries(name: Column, state: Column, term: Column) -> Column:
    """Searches for a company's own site, the most particular first."""
    quoted = F.concat(F.lit('"'), F.trim(name), F.lit('" '))
    return F.array_compact(F.array(F.concat(quoted, term, F.lit(" store "), state, F.lit(" official website")), F.concat(quoted, F.lit("store "), state), F.concat(quoted, term, F.lit(" store official website")), F.concat(F.trim(name), F.lit(" "), term)))


def brand_tokens(name: Column, generic: list[str]) -> Column:
    """The words of a name as keys, without generic ones."""
    words = F.transform(F.split(F.translate(F.lower(name), "-/", "  "), " +"), brand_key)
    return F.array_distinct(F.filter(words, lambda w: (w != "") & ~w.isin(generic)))


def host_label(url: Column) -> Column:
    """The second-level label of an address's host, as a key."""
    host = F.regexp_replace(F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit(""))), r"^www\.", "")
    return brand_key(F.coalesce(F.try_element_at(F.split(host, r"\."), F.lit(-2)), host))


def numbers_of(json: Column) -> Column:
    """The numeric members of a JSON object as a map; anything else gives an empty one."""
    members = F.map_entries(F.coalesce(F.from_json(json, "map<string,string>"), F.create_map().cast("map<string,string>")))
    kept = F.filter(members, lambda e: e["value"].rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][-+]?[0-9]+)?$"))
    return F.map_from_entries(F.transform(kept, lambda e: F.struct(e["key"].alias("key"), e["value"].try_cast("double").alias("value"))))


def name_in(json: Column) -> Column:
    """A name that is published as plain text or as an object with ``name``."""
    return clean(F.when(json.startswith("{"), F.get_json_object(json, "$.name")).otherwise(json))
