"""Predicates that analyses put before a table; each is a column expression over unqualified names unless given a prefix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(name: str, alias: str) -> Column:
    return F.col(f"{alias}.{name}" if alias else name)


def natural_flower(category: str = "category_std", alias: str = "") -> Column:
    """Flower that nothing was added to or extracted from."""
    return (_c(category, alias) == "Flower") & _c("obtention_std", alias).isNull()


def trusted_lineage(cutoff: str, alias: str = "", platform: str = "weedmaps") -> Column:
    """A known strain, not one of the platform from before its correction. A row of unknown platform from before it isn't kept."""
    old = (_c("platform", alias) == platform) & (_c("scraped_at", alias) < F.lit(cutoff).cast("timestamp"))
    return _c("strain_type_std", alias).isNotNull() & ~old


def trusted_potency(alias: str = "", platform: str = "leafly") -> Column:
    """Not of the platform that makes figures up; a row of unknown platform is kept."""
    return ~_c("platform", alias).eqNullSafe(platform)


def plausible_potency(alias: str = "") -> Column:
    """Not flagged; an unknown flag keeps the row."""
    return ~_c("potency_implausible", alias).eqNullSafe(True)


def unit_violation(alias: str = "") -> Column:
    """A dose both in percent and in milligrams."""
    both = lambda x: _c(x, alias).isNotNull() & _c(f"{x}_mg", alias).isNotNull()
    return both("thc") | both("cbd")


def in_country(df: DataFrame, programs: DataFrame, country: str, state: str = "state", without: tuple[str, ...] = ()) -> DataFrame:
    """Rows of the jurisdictions of a country, territories ``without`` excepted."""
    own = programs.filter(F.col("country") == country)
    own = own.filter(~F.col("abbr").isin(*without)) if without else own
    return df.join(own.select(F.col("abbr").alias(state)), state, "left_semi")


def kept_handle() -> Column:
    """A store that isn't folded into another and has a menu of its own."""
    return F.col("canonical_company_id").isNull() & F.col("platform").isNotNull() & F.col("external_id").isNotNull() & (F.col("external_id") != "")


def plausible_record() -> Column:
    """A name, and some of address, city and postal code."""
    some = lambda c: F.coalesce(F.length(F.trim(c)) > 0, F.lit(False))
    return some("name") & (some("address") | some("city") | some("zip_code"))


def status_known(status: Column) -> Column:
    return status.isin("blocked", "broken", "failed", "ok", "unavailable", "unequipped")


def looks_like_trade(text: Column, terms: list[str]) -> Column:
    """Whether a text has one of the trade's terms as whole words."""
    return F.coalesce(F.lower(text).rlike(rf"\b(?:{'|'.join(sorted(terms))})\b"), F.lit(False))


def domain_excluded(host: Column, domains: list[str]) -> Column:
    """Whether a host is one of ``domains``: "a.com" with its subdomains, "a." with any ending, "a" anywhere in it."""
    out = F.lit(False)
    for d in domains:
        if d.endswith("."):
            out = out | host.startswith(d) | host.contains(f".{d}")
        elif "." not in d:
            out = out | host.contains(d)
        else:
            out = out | (host == d) | host.endswith(f".{d}")
    return out


def host_is_brand(brand_key: Column, host: Column, endings: list[str]) -> Column:
    """Whether a host's label is the brand: equal, with a usual ending, or, if long enough, somewhere in it."""
    rest = F.substr(host, F.length(brand_key) + 1)
    some = (F.length(brand_key) > 0) & (F.length(host) > 0)
    return F.coalesce(some & ((host == brand_key) | (host.startswith(brand_key) & rest.isin(endings)) | ((F.length(brand_key) >= 5) & host.contains(brand_key))), F.lit(False))
