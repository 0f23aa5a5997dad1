"""Taxonomy, sizes, prices, potency and terpenes of listings, as built-in expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfspark import rules
from shelfspark.functions.text import alnum_key, let


def _first(key: Column, table: list[tuple[str, list[str]]], otherwise: Column | None = None) -> Column:
    """The first label of which a keyword is in ``key``: one alternation a label."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for label, words in table:
        out = out.when(key.rlike("|".join(words)), label)
    return out.otherwise(otherwise if otherwise is not None else F.lit(None).cast("string"))


def _override(key: Column, base: Column, table) -> Column:
    at = F.coalesce(base, F.lit(""))
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for label, words, may in table:
        out = out.when(at.isin(may) & (at != label) & key.rlike("|".join(words)), label)
    return out


# Keys are bound once (``let``): a rule names its key many times, and rules build on each other.


def category_base(raw: Column, table=None) -> Column:
    return let(alnum_key(raw), lambda key: F.when(F.length(key) > 0, _first(key, rules.CATEGORY if table is None else table, F.lit("Other"))))


def _overriding(raw: Column, name: Column, table, overrides, f) -> Column:
    overrides = rules.CATEGORY_OVERRIDES if overrides is None else overrides
    both = F.struct(category_base(raw, table).alias("base"), alnum_key(F.coalesce(name, F.lit(""))).alias("key"))
    return let(both, lambda s: f(_override(s["key"], s["base"], overrides), s["base"]))


def category_std(raw: Column, name: Column, table=None, overrides=None) -> Column:
    """The category of a platform's own one, corrected by forms that the name tells; null if both tell nothing."""
    return _overriding(raw, name, table, overrides, lambda told, base: F.coalesce(told, base))


def category_overridden(raw: Column, name: Column, table=None, overrides=None) -> Column:
    return _overriding(raw, name, table, overrides, lambda told, base: told.isNotNull())


def _typed(name: Column, raw: Column, category: Column, f) -> Column:
    return let(F.struct(alnum_key(F.concat_ws(" ", name, raw)).alias("key"), category.alias("category")), lambda s: f(s["key"], s["category"]))


def product_type(name: Column, raw: Column, category: Column, table=None, defaults=None) -> Column:
    """The kind within a category, its default, "Unspecified", or null for a category without kinds."""
    table, defaults = rules.PRODUCT_TYPE if table is None else table, rules.PRODUCT_TYPE_DEFAULT if defaults is None else defaults

    def kind(key: Column, category: Column) -> Column:
        out = F.when(F.lit(False), F.lit(None).cast("string"))
        for c, own in table.items():
            out = out.when(category == c, _first(key, own, F.lit(defaults.get(c, rules.UNSPECIFIED))))
        return out

    return _typed(name, raw, category, kind)


def product_type_defaulted(name: Column, raw: Column, category: Column) -> Column:
    """Whether the kind is a category's default because no keyword told one."""

    def told(key: Column, category: Column) -> Column:
        each = [(category == c) & ~key.rlike("|".join(w for _, words in rules.PRODUCT_TYPE[c] for w in words)) for c in rules.PRODUCT_TYPE_DEFAULT]
        return F.coalesce(reduce(lambda a, b: a | b, each), F.lit(False))

    return _typed(name, raw, category, told)


def strain_type(raw: Column, table=None) -> Column:
    return let(alnum_key(raw), lambda key: _first(key, rules.STRAIN if table is None else table))


def obtention(name: Column, raw: Column, table=None) -> Column:
    """How a product was obtained: keywords within the joined letters, or whole words of the text."""

    def told(s: Column) -> Column:
        out = F.when(F.lit(False), F.lit(None).cast("string"))
        for label, inside, words in rules.OBTENTION if table is None else table:
            fine = F.lit(False)
            if inside:
                fine = fine | s["key"].rlike("|".join(inside))
            if words:
                fine = fine | s["text"].rlike(rf"(?iU)\b({'|'.join(words)})\b")
            out = out.when(fine, label)
        return out

    text = F.concat_ws(" ", name, raw)
    return let(F.struct(text.alias("text"), alnum_key(text).alias("key")), told)


def terpene_name(raw: Column) -> Column:
    return let(alnum_key(raw), lambda key: _first(key, [(t, [t.lower()]) for t in rules.TERPENES]))


_UNITS = "|".join(sorted(rules.GRAMS, key=lambda u: (-len(u), u)))


def _plausible(g: Column) -> Column:
    return F.when((g > 0) & (g <= 1000), F.bround(g, 4))


def size_to_grams(raw: Column) -> Column:
    """Grams of a size label: a word, a fraction of an ounce, or a number with a unit, times the pieces of a pack."""
    return let(F.lower(F.trim(raw)), _grams_of)


def _grams_of(text: Column) -> Column:
    word = F.trim(F.regexp_replace(text, r"[\s_]+", " "))
    grams = F.create_map(*[F.lit(x) for kv in rules.SIZE_WORDS.items() for x in kv])
    unit = F.create_map(*[F.lit(x) for kv in rules.GRAMS.items() for x in kv])
    pack = F.greatest(F.coalesce(F.try_to_number(F.regexp_extract(text, r"([0-9]{1,3})\s*(?:pack|pk|×|x)\b", 1), F.lit("999")).cast("double"), F.lit(1.0)), F.lit(1.0))
    over = lambda k: F.regexp_extract(text, r"([0-9]+)\s*/\s*([0-9]+)\s*(?:ounces?|oz)\b", k).try_cast("double")
    number = rf"([0-9]+(?:\.[0-9]+)?)\s*({_UNITS})\b"
    amount, of = F.regexp_extract(text, number, 1).try_cast("double"), F.regexp_extract(text, number, 2)
    return (
        F.when(word.isin([*rules.SIZE_WORDS]), F.try_element_at(grams, word))
        .when(word == "each", None)
        .when(over(2) > 0, _plausible(over(1) / over(2) * 28.0 * pack))
        .when(amount.isNotNull(), _plausible(amount * F.try_element_at(unit, of) * pack))
    )


def grams_label(g: Column) -> Column:
    """"3.5g" of 3.5; null unless positive."""
    short = F.regexp_replace(F.regexp_replace(F.format_string("%.4f", g), "0+$", ""), r"\.$", "")
    return F.when((g > 0) & (g < float("inf")), F.concat(short, F.lit("g")))


#: The first of equal prices tells whether it is a sale.
PRICE_FIELDS = "price price_med price_rec special_price_med special_price_rec sale_price discounted_price unit_price".split()
REGULAR = dict(discounted_price="price", sale_price="price", special_price_med="price_med", special_price_rec="price_rec")


def variant_pricing(v: Column, fields: list[str]) -> tuple[Column, Column]:
    """(lowest price, price before a discount) of a variant with some of the price fields and perhaps ``original_price``."""
    own = [f for f in PRICE_FIELDS if f in fields]
    lowest = F.array_min(F.array_compact(F.array(*[v[f] for f in own])))
    regular = F.lit(None).cast("double")
    for f in reversed(own):  # the first field with the lowest price tells
        r = v[REGULAR[f]] if REGULAR.get(f) in own else F.lit(None).cast("double")
        regular = F.when(v[f] == lowest, F.when(r > lowest, r)).otherwise(regular)
    explicit = F.when(v["original_price"] > lowest, v["original_price"]) if "original_price" in fields else F.lit(None).cast("double")
    return lowest, F.greatest(regular, explicit)


def enrich_variants(variants: Column, category: Column, fields: list[str]) -> Column:
    """Variants (with ``option``) as structs of option, price, original_price, size_g and price_per_g; sizes only where goods are sold by weight."""

    def one(v: Column) -> Column:
        price, original = variant_pricing(v, fields)
        grams = F.when(category.isin(rules.WEIGHT_CATEGORIES), size_to_grams(v["option"]))

        def priced(grams: Column) -> Column:
            grams = F.when(grams >= 0.05, grams)
            return F.struct(v["option"].alias("option"), price.alias("price"), F.round(original, 2).alias("original_price"), grams.alias("size_g"), F.round(price / grams, 2).alias("price_per_g"))

        return let(grams, priced)

    return F.transform(variants, one)


def smallest_size(enriched: Column) -> Column:
    return F.array_min(F.array_compact(F.transform(enriched, lambda v: v["size_g"])))


def potency_implausible(category: Column, thc: Column, cbd: Column) -> Column:
    """A flower of under 5 % THC that isn't CBD-rich."""
    low = (category == "Flower") & (thc > 0) & (thc < 5) & (cbd.isNull() | (cbd < 1))
    return F.coalesce(low, F.lit(False))


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x["value"])


def fold_terpenes(raw: Column) -> Column:
    """Sorted (name, value) of the known terpenes: values of one name summed, mg/g as percent, negative ones left out."""
    percent = F.transform(
        raw, lambda x: F.struct(terpene_name(x["name"]).alias("name"), F.when(F.lower(F.coalesce(x["unit"], F.lit(""))).contains("mg"), x["value"] / 10).otherwise(x["value"]).alias("value"))
    )

    def sums(kept: Column) -> Column:
        return F.transform(
            F.array(*[F.lit(t) for t in sorted(rules.TERPENES)]),
            lambda t: F.struct(t.alias("name"), F.aggregate(F.filter(kept, lambda x: x["name"] == t), F.lit(None).cast("double"), lambda s, x: F.bround(F.coalesce(s, F.lit(0.0)) + x["value"], 4)).alias("value")),
        )

    # the named values are bound once: every terpene asks for them
    return F.filter(let(F.filter(percent, lambda x: x["name"].isNotNull() & (x["value"] >= 0)), sums), lambda x: x["value"].isNotNull())


def repair_step(a: Column) -> Column:
    """One round on an impossible total: a value above all others' sum goes, else all are divided by ten."""
    total = _total(a)
    top = F.array_max(F.transform(a, lambda x: x["value"]))
    place = F.array_position(F.transform(a, lambda x: x["value"]), top)
    without = F.filter(a, lambda x, i: i != place - 1)
    tenth = F.transform(a, lambda x: F.struct(x["name"].alias("name"), F.bround(x["value"] / 10, 4).alias("value")))
    return F.when(total <= 40, a).when(top > total - top, without).otherwise(tenth)


def fold_column(df, raw: str, out: str):
    """``df`` with terpene columns ``out``_std (sorted array), ``out``_total and ``out``_repaired; a round is a projection, so that its plan stays small."""
    fold, now = f"{out}_fold", f"{out}_now"
    df = df.withColumn(fold, F.coalesce(fold_terpenes(F.col(raw)), F.array().cast("array<struct<name:string,value:double>>"))).withColumn(now, F.col(fold))
    for _ in range(5):
        df = df.withColumn(now, repair_step(F.col(now)))
    kept = F.filter(F.col(now), lambda x: x["value"] <= 30)
    some = F.exists(kept, lambda x: x["value"] != 0)
    df = df.withColumn(f"{out}_std", F.when(some, F.array_sort(kept)))
    df = df.withColumn(f"{out}_total", F.when(F.col(f"{out}_std").isNotNull(), F.bround(_total(F.col(f"{out}_std")), 4)))
    changed = (F.col(now) != F.col(fold)) | (F.size(f"{out}_std") != F.size(now))
    return df.withColumn(f"{out}_repaired", F.coalesce(F.col(f"{out}_std").isNotNull() & changed, F.lit(False))).drop(fold, now)


def dominant_terpene(std: Column) -> Column:
    """The name of the greatest value; of equal ones the first."""
    top = F.array_max(F.transform(std, lambda x: x["value"]))
    return F.filter(std, lambda x: x["value"] == top)[0]["name"]


def by_value(std: Column) -> Column:
    """A profile's (name, value) from the greatest value down; of equal ones by name."""
    down = F.array_sort(F.transform(std, lambda x: F.struct((-x["value"]).alias("minus"), x["name"].alias("name"))))
    return F.transform(down, lambda x: F.struct(x["name"].alias("name"), (-x["minus"]).alias("value")))


def enrich_record(df, variants: str = "variants", terpenes: str = "terpenes", fields: list[str] | None = None):
    """Listings (category_std, thc, cbd, variants, terpenes) with their sizes, prices a gram, terpene profile and potency flag, as one step."""
    out = df.withColumn(variants, enrich_variants(F.col(variants), F.col("category_std"), fields or [f for f in PRICE_FIELDS if f in df.schema[variants].dataType.elementType.names]))
    out = fold_column(out.withColumn("size_g", smallest_size(F.col(variants))), terpenes, "terpenes")
    return out.withColumnRenamed("terpenes_total", "terp_total").withColumn("potency_implausible", potency_implausible(F.col("category_std"), F.col("thc"), F.col("cbd")))
