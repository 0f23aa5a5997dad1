"""DuckDB expressions of the scalar functions, for the SQL that results are held against."""

from __future__ import annotations

from shelfspark import rules


def alnum(c: str) -> str:
    return f"regexp_replace(lower({c}), '[^a-z0-9]+', '', 'g')"


def brand_key(c: str) -> str:
    return f"coalesce(nullif({alnum(c)}, ''), trim(lower({c})))"


def first(key: str, table, otherwise: str = "NULL") -> str:
    rows = " ".join("WHEN " + " OR ".join(f"contains({key}, '{w}')" for w in words) + f" THEN '{label}'" for label, words in table)
    return f"CASE {rows} ELSE {otherwise} END"


def category_base(raw: str) -> str:
    k = alnum(raw)
    return f"CASE WHEN {raw} IS NOT NULL AND {k} <> '' THEN {first(k, rules.CATEGORY, chr(39) + 'Other' + chr(39))} END"


def override(name: str, base: str) -> str:
    k = alnum(f"coalesce({name}, '')")
    rows = " ".join(
        f"WHEN coalesce({base}, '') IN ({', '.join(repr(f) for f in may)}) AND coalesce({base}, '') <> '{label}' AND ({' OR '.join(f'contains({k}, {w!r})' for w in words)}) THEN '{label}'"
        for label, words, may in rules.CATEGORY_OVERRIDES
    )
    return f"CASE {rows} END"


def category_std(raw: str, name: str) -> str:
    b = category_base(raw)
    return f"coalesce({override(name, b)}, {b})"


def product_type(name: str, raw: str, category: str) -> str:
    k = alnum(f"concat_ws(' ', {name}, {raw})")
    rows = " ".join(f"WHEN {category} = '{c}' THEN {first(k, t, repr(rules.PRODUCT_TYPE_DEFAULT.get(c, rules.UNSPECIFIED)))}" for c, t in rules.PRODUCT_TYPE.items())
    return f"CASE {rows} END"


def defaulted(name: str, raw: str, category: str) -> str:
    k = alnum(f"concat_ws(' ', {name}, {raw})")
    rows = " OR ".join(f"({category} = '{c}' AND NOT ({' OR '.join(f'contains({k}, {w!r})' for _, ws in rules.PRODUCT_TYPE[c] for w in ws)}))" for c in rules.PRODUCT_TYPE_DEFAULT)
    return f"coalesce({rows}, false)"


def obtention(name: str, raw: str) -> str:
    t = f"concat_ws(' ', {name}, {raw})"
    k = alnum(t)
    rows = " ".join(f"WHEN {' OR '.join(f'contains({k}, {w!r})' for w in inside)} OR regexp_matches({t}, '(?i)\\b({'|'.join(words)})\\b') THEN '{label}'" for label, inside, words in rules.OBTENTION)
    return f"CASE {rows} END"


def grams(raw: str) -> str:
    t = f"lower(trim({raw}))"
    word = f"trim(regexp_replace({t}, '[\\s_]+', ' ', 'g'))"
    words = " ".join(f"WHEN {word} = '{w}' THEN {v}::DOUBLE" for w, v in rules.SIZE_WORDS.items())
    units = "|".join(sorted(rules.GRAMS, key=lambda u: (-len(u), u)))
    pack = f"greatest(coalesce(try_cast(regexp_extract({t}, '(\\d{{1,3}})\\s*(?:x|×|pk|pack)\\b', 1) AS DOUBLE), 1.0), 1.0)"
    over = lambda k: f"try_cast(regexp_extract({t}, '(\\d+)\\s*/\\s*(\\d+)\\s*(?:oz|ounce|ounces)\\b', {k}) AS DOUBLE)"
    number = f"'(\\d+(?:\\.\\d+)?)\\s*({units})\\b'"
    unit = " ".join(f"WHEN '{u}' THEN {v}" for u, v in rules.GRAMS.items())
    ok = lambda g: f"CASE WHEN {g} > 0 AND {g} <= 1000 THEN round({g}, 4) END"
    return f"""CASE {words} WHEN {word} = 'each' THEN NULL WHEN {over(2)} > 0 THEN {ok(f'({over(1)} / {over(2)} * 28.0 * {pack})')}
      WHEN try_cast(regexp_extract({t}, {number}, 1) AS DOUBLE) IS NOT NULL
      THEN {ok(f'(try_cast(regexp_extract({t}, {number}, 1) AS DOUBLE) * (CASE regexp_extract({t}, {number}, 2) {unit} END)::DOUBLE * {pack})')} END"""


def two_places(x: str) -> str:
    return f"printf('%.2f', coalesce({x}, 0.0)::DOUBLE)"


def zip_key(z: str) -> str:
    u = f"upper(trim(coalesce({z}, '')))"
    return f"CASE WHEN regexp_matches({u}, '^[A-Z][0-9][A-Z] ?[0-9][A-Z][0-9]$') THEN replace({u}, ' ', '') ELSE left({u}, 5) END"


def address_std(a: str) -> str:
    unit = "|".join(rules.UNIT_WORDS)
    t = f"regexp_replace(lower({a}), '(?:\\b(?:{unit})\\b|#)\\s*\\.?\\s*[\\w-]+', ' ', 'g')"
    t = f"regexp_replace({t}, '([0-9])-([0-9])', '\\1\\2', 'g')"
    t = f"regexp_replace({t}, '[^a-z0-9 ]+', ' ', 'g')"
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in rules.ADDRESS_WORDS.items())
    return f"coalesce(array_to_string(list_transform(list_filter(string_split({t}, ' '), lambda w: w <> ''), lambda w: CASE w {cases} ELSE w END), ' '), '')"


def address_key(a: str, z: str) -> str:
    return f"CASE WHEN {address_std(a)} = '' THEN '' ELSE {address_std(a)} || '|' || {zip_key(z)} END"


def geo_key(lat: str, lng: str, z: str) -> str:
    cell = lambda c: f"cast(cast(round({c} * 10000) AS BIGINT) AS VARCHAR)"
    return f"coalesce('@' || {cell(lat)} || ',' || {cell(lng)} || '|' || {zip_key(z)}, '')"


def location_key(lat: str, lng: str, a: str, z: str) -> str:
    g = geo_key(lat, lng, z)
    return f"CASE WHEN {g} <> '' THEN {g} WHEN length({zip_key(z)}) < 5 OR NOT regexp_matches(coalesce({a}, ''), '[0-9]') THEN '' ELSE {address_key(a, z)} END"


def handle(p: str, x: str) -> str:
    return f"CASE WHEN length({p}) > 0 AND length({x}) > 0 THEN {p} || ':' || {x} ELSE '' END"
