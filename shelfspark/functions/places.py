"""Addresses, postal codes, coordinates and the keys made of them, as built-in expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfspark import rules
from shelfspark.functions.text import let


def _words(text: Column, table: dict[str, str]) -> Column:
    short = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.transform(F.filter(F.split(text, " "), lambda w: w != ""), lambda w: F.coalesce(F.try_element_at(short, w), w))


_UNIT = r"(?:\b(?:" + "|".join(rules.UNIT_WORDS) + r")\b|#)\s*[.]?\s*[-\w]+"


def address_std(address: Column) -> Column:
    """A street address in lower case without its unit, in short forms; "" for none."""
    text = F.regexp_replace(F.lower(address), _UNIT, " ")
    text = F.regexp_replace(text, r"(?<=[0-9])-(?=[0-9])", "")
    text = F.regexp_replace(text, "[^a-z0-9 ]+", " ")
    return F.coalesce(F.array_join(_words(text, rules.ADDRESS_WORDS), " "), F.lit(""))


def zip_key(zip_code: Column) -> Column:
    """Six characters of a Canadian code, the first five of any other; "" for none."""
    z = F.upper(F.trim(F.coalesce(zip_code, F.lit(""))))
    return F.when(z.rlike("^[A-Z][0-9][A-Z] ?[0-9][A-Z][0-9]$"), F.replace(z, F.lit(" "), F.lit(""))).otherwise(F.substring(z, 1, 5))


def address_key(address: Column, zip_code: Column) -> Column:
    a = address_std(address)
    return F.when(a == "", "").otherwise(F.concat(a, F.lit("|"), zip_key(zip_code)))


def geo_key(lat: Column, lng: Column, zip_code: Column) -> Column:
    """The cell of 0.0001 degrees, in whole numbers, with the postal code; "" without coordinates."""
    cell = lambda c: F.round(c * 10000).cast("bigint").cast("string")
    return F.coalesce(F.concat(F.lit("@"), cell(lat), F.lit(","), cell(lng), F.lit("|"), zip_key(zip_code)), F.lit(""))


def location_key(lat: Column, lng: Column, address: Column, zip_code: Column) -> Column:
    """The geo key; without coordinates the address key, if there is a whole postal code and a house number."""
    geo = geo_key(lat, lng, zip_code)
    guarded = F.when((F.length(zip_key(zip_code)) < 5) | ~F.coalesce(address, F.lit("")).rlike("[0-9]"), "").otherwise(address_key(address, zip_code))
    return F.when(geo != "", geo).otherwise(guarded)


def handle(platform: Column, external_id: Column) -> Column:
    return F.when((F.length(platform) > 0) & (F.length(external_id) > 0), F.concat(platform, F.lit(":"), external_id)).otherwise("")


def physical_key(lat: Column, lng: Column, address: Column, zip_code: Column, platform: Column, external_id: Column) -> Column:
    some = lambda c: F.when(c != "", c)
    text = lambda c: F.coalesce(c, F.lit("None"))
    return F.coalesce(some(geo_key(lat, lng, zip_code)), some(address_key(address, zip_code)), F.concat(text(platform), F.lit(":"), text(external_id)))


def haversine_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return 2 * 6371000 * F.asin(F.sqrt(h))


def city_std(city: Column) -> Column:
    return F.coalesce(F.trim(F.regexp_replace(F.upper(city), "[^A-Z0-9 ]+", "")), F.lit(""))


def strip_unit_prefix(address: Column) -> Column:
    """Without "unit 4 -" or "4-" before the house number."""
    words = "BAY|" + "|".join(w.upper() for w in rules.UNIT_WORDS)
    text = F.regexp_replace(address, rf"(?i)^\s*(?:(?:{words}|#)\s*[.]?\s*#?[-\w]+\s*[,-]?\s*)+", "")
    return F.regexp_replace(text, r"(?i)^\s*\d+[A-Z]?\s*-\s*(?=\d+\s)", "")


def street_parts(address: Column) -> tuple[Column, Column]:
    """(house number, "NAME|TYPE|DIRECTION"); both null unless the address begins with a number and goes on."""
    table = lambda t: F.create_map(*[F.lit(x) for kv in t.items() for x in kv])

    def cut(word: Column, words: Column) -> Column:
        return F.when(word.isNotNull(), F.slice(words, F.lit(1), F.size(words) - 1)).otherwise(words)

    def end(words: Column, t: dict) -> Column:
        return F.when(F.size(words) > 1, F.try_element_at(table(t), F.try_element_at(words, F.lit(-1))))

    def key(words: Column, kind: Column, to: Column) -> Column:
        name = F.trim(F.regexp_replace(F.regexp_replace(F.array_join(words, " "), "[^A-Z0-9 ]+", " "), " +", " "))
        return F.when(F.size(words) > 0, F.concat(name, F.lit("|"), F.coalesce(kind, F.lit("")), F.lit("|"), F.coalesce(to, F.lit(""))))

    def after_direction(s: Column) -> Column:
        return let(F.struct(s["words"].alias("words"), s["to"].alias("to"), end(s["words"], rules.STREET_TYPES).alias("kind")), lambda k: key(cut(k["kind"], k["words"]), k["kind"], k["to"]))

    def after_number(words: Column) -> Column:
        return let(F.struct(words.alias("all"), end(words, rules.DIRECTIONS).alias("to")), lambda d: let(F.struct(cut(d["to"], d["all"]).alias("words"), d["to"].alias("to")), after_direction))

    bare = F.regexp_replace(F.regexp_replace(strip_unit_prefix(F.upper(F.trim(address))), "[.,]", " "), r"\s+", " ")
    number = F.regexp_extract(F.trim(bare), r"^(\d+)[A-Z]?\s+", 1)
    words = F.filter(F.split(F.regexp_replace(F.trim(bare), r"^\d+[A-Z]?\s+", ""), " "), lambda w: w != "")
    found = F.when(number != "", let(words, after_number))
    return F.when(found.isNotNull(), number.try_cast("bigint")), found


def side_range(number: Column, lo_l: Column, hi_l: Column, lo_r: Column, hi_r: Column) -> Column:
    """"l" or "r": the side whose range holds the number; of both, the one of its parity (by the lower end), else the left."""
    inside = lambda lo, hi: F.coalesce(number.between(F.least(lo, hi), F.greatest(lo, hi)), F.lit(False))
    left, right = inside(lo_l, hi_l), inside(lo_r, hi_r)
    parity = (F.pmod(lo_r, F.lit(2)) == F.pmod(number, F.lit(2))) & (F.pmod(lo_l, F.lit(2)) != F.pmod(number, F.lit(2)))
    return F.when(left & right, F.when(parity, "r").otherwise("l")).when(left, "l").when(right, "r")


def segment_lengths(pts: Column) -> Column:
    """The length of each stretch of a polyline of (x, y)."""
    return F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(pts) - 2, F.lit(0))),
        lambda i: F.sqrt(F.pow(F.get(pts, i + 1)["x"] - F.get(pts, i)["x"], 2) + F.pow(F.get(pts, i + 1)["y"] - F.get(pts, i)["y"], 2)),
    )


def point_along(pts: Column, share: Column, inset: float = 50.0, offset: float = 18.0, side: Column | None = None) -> Column:
    """The point at a share of a polyline's length, kept ``inset`` (a quarter of the length at most) from the ends and ``offset`` to a side."""
    sign = F.when(side == "l", 1.0).when(side == "r", -1.0).otherwise(0.0) if side is not None else F.lit(0.0)

    def measured(s: Column) -> Column:
        edge = F.least(F.lit(inset), s["total"] / 4)
        goal = edge + F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)) * (s["total"] - 2 * edge)
        return let(F.struct(s["lengths"].alias("lengths"), goal.alias("goal")), walked)

    def walked(s: Column) -> Column:
        lengths, goal = s["lengths"], s["goal"]
        begin = F.struct(F.lit(0.0).alias("done"), F.lit(-1).alias("i"), F.lit(0).alias("k"))
        walk = F.aggregate(
            lengths,
            begin,
            lambda s, x: F.when((s["i"] < 0) & ((s["done"] + x >= goal) | (s["k"] == F.size(lengths) - 1)), F.struct(s["done"].alias("done"), s["k"].alias("i"), (s["k"] + 1).alias("k")))
            .when(s["i"] < 0, F.struct((s["done"] + x).alias("done"), s["i"].alias("i"), (s["k"] + 1).alias("k")))
            .otherwise(s),
        )
        return let(walk, lambda w: placed(F.get(pts, w["i"]), F.get(pts, w["i"] + 1), F.get(lengths, w["i"]), goal - w["done"]))

    def placed(a: Column, b: Column, n: Column, rest: Column) -> Column:
        part = F.when(n > 0, rest / n).otherwise(0.0)
        dx, dy = F.when(n > 0, (b["x"] - a["x"]) / n).otherwise(0.0), F.when(n > 0, (b["y"] - a["y"]) / n).otherwise(0.0)
        return F.struct((a["x"] + part * (b["x"] - a["x"]) - sign * offset * dy).alias("x"), (a["y"] + part * (b["y"] - a["y"]) + sign * offset * dx).alias("y"))

    # lengths are bound once: an expression that a lambda names would be evaluated at every step
    return let(segment_lengths(pts), lambda lengths: measured(F.struct(lengths.alias("lengths"), F.aggregate(lengths, F.lit(0.0), lambda s, x: s + x).alias("total"))))


#: Lambert conformal conic (standard parallels 49 and 77, origin 63.390675, -91.866667) on GRS 80.
_A, _E = 6378137.0, 0.0818191910428158
_LAT0, _LNG0, _P1, _P2, _X0, _Y0 = (math.radians(63.390675), math.radians(-91.86666666666666), math.radians(49), math.radians(77), 6200000.0, 3000000.0)


def _t(p: float) -> float:
    return math.tan(math.pi / 4 - p / 2) / ((1 - _E * math.sin(p)) / (1 + _E * math.sin(p))) ** (_E / 2)


def _m(p: float) -> float:
    return math.cos(p) / math.sqrt(1 - (_E * math.sin(p)) ** 2)


_N = (math.log(_m(_P1)) - math.log(_m(_P2))) / (math.log(_t(_P1)) - math.log(_t(_P2)))
_F0 = _m(_P1) / (_N * _t(_P1) ** _N)
_R0 = _A * _F0 * _t(_LAT0) ** _N


def to_wgs84(x: Column, y: Column) -> Column:
    """Struct (latitude, longitude) of projected metres: the closed inverse with five rounds for the latitude."""
    dx, dy = x - _X0, F.lit(_R0) - (y - _Y0)
    t = F.pow(F.sqrt(dx * dx + dy * dy) / (_A * _F0), F.lit(1 / _N))
    p = F.lit(math.pi / 2) - 2 * F.atan(t)
    for _ in range(5):
        s = F.sin(p) * _E
        p = F.lit(math.pi / 2) - 2 * F.atan(t * F.pow((1 - s) / (1 + s), F.lit(_E / 2)))
    return F.struct(F.degrees(p).alias("latitude"), F.degrees(F.atan2(dx, dy) / _N + _LNG0).alias("longitude"))
