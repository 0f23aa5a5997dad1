"""Rule tables from files: JSON, and YAML where a parser is installed. Keys keep the file's order, which is their priority; keywords become letters and digits."""

from __future__ import annotations

import json
import re
from pathlib import Path
from typing import Any

DEFAULTS = "_defaults"


def load(path: str | Path) -> Any:
    """A file's content. YAML needs the parser; JSON doesn't."""
    text = Path(path).read_text(encoding="utf-8")
    if Path(path).suffix in (".yml", ".yaml"):
        import yaml

        return yaml.safe_load(text)
    return json.loads(text)


def _key(word: object) -> str:
    return re.sub("[^a-z0-9]+", "", str(word).lower())


def _keys(words: list | None) -> list[str]:
    return [k for w in words or [] if (k := _key(w))]


def _mapping(path: str | Path) -> dict:
    data = load(path)
    if not isinstance(data, dict):
        raise ValueError(f"{path} has no mapping at its top")
    return data


def categories(path: str | Path) -> list[tuple[str, list[str]]]:
    """[(label, keywords)] of {label: [keyword]}; also strains."""
    return [(str(label), _keys(words)) for label, words in _mapping(path).items()]


strains = categories


def category_overrides(path: str | Path) -> list[tuple[str, list[str], list[str]]]:
    """[(label, keywords, categories it may replace)] of [{"to", "keywords", "from"}]; a null category is ""."""
    data = load(path)
    if not isinstance(data, list):
        raise ValueError(f"{path} has no list at its top")
    return [(str(r["to"]), _keys(r.get("keywords")), ["" if f is None else str(f) for f in r.get("from") or []]) for r in data]


def product_types(path: str | Path) -> dict[str, list[tuple[str, list[str]]]]:
    """{category: [(kind, keywords)]} of {category: {kind: [keyword]}}, but for the defaults."""
    return {str(c): [(str(kind), _keys(words)) for kind, words in (kinds or {}).items()] for c, kinds in _mapping(path).items() if c != DEFAULTS}


def product_type_defaults(path: str | Path) -> dict[str, str]:
    return {str(c): str(kind) for c, kind in (_mapping(path).get(DEFAULTS) or {}).items()}


def obtentions(path: str | Path) -> list[tuple[str, list[str], list[str]]]:
    """[(label, keywords within joined letters, whole words)] of {label: {"contains", "words"}}."""
    out = []
    for label, own in _mapping(path).items():
        if not isinstance(own, dict):
            raise ValueError(f"{path}: {label} has neither contains nor words")
        out.append((str(label), _keys(own.get("contains")), [re.escape(str(w)) for w in own.get("words") or []]))
    return out


def company_aliases(path: str | Path, strict: bool = False) -> dict[str, str]:
    """{alias: company} of {company: [alias]}. A missing file or entries of other shapes raise if ``strict``, else they are passed over; a repeated alias is the last company's."""
    if not Path(path).is_file():
        if strict:
            raise FileNotFoundError(path)
        return {}
    data = load(path)
    if not isinstance(data, dict):
        if strict:
            raise ValueError(f"{path} has no mapping at its top")
        return {}
    out: dict[str, str] = {}
    for company, names in data.items():
        if isinstance(names, list):
            out.update((str(n), str(company)) for n in names)
        elif strict:
            raise ValueError(f"{path}: the aliases of {company} are no list")
    return out


def parents(path: str | Path) -> tuple[dict[str, str], dict[str, str]]:
    """({banner's key: parent}, {name's key: why it is nobody's}) of {"parents": {parent: [banner]}, "not_corporate_identities": {name: reason}}."""
    data = _mapping(path)
    known = {_key(b): str(p) for p, own in (data.get("parents") or {}).items() for b in (own.get("banners") if isinstance(own, dict) else own) or []}
    return known, {_key(n): str(why) for n, why in (data.get("not_corporate_identities") or {}).items()}


def states(path: str | Path) -> list[dict[str, Any]]:
    """A row a jurisdiction of {abbr: {...}} or [{"abbr", ...}], abbreviations in upper case."""
    data = load(path)
    rows = [{"abbr": a, **(own or {})} for a, own in data.items()] if isinstance(data, dict) else list(data)
    return [{**r, "abbr": str(r["abbr"]).upper()} for r in rows]
