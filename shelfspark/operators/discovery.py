"""Which captured page has a jurisdiction's list, which site is a company's, what a run has found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.functions import text as X

ACCEPT, SECOND_HOP = 4, 7


def best_links(scored: DataFrame, key: str = "page") -> DataFrame:
    """Each page's best link (page, href, score, kind): the highest score, then the first on the page."""
    best = scored.groupBy(key).agg(F.max_by(F.struct("href", "score"), F.struct("score", -F.col("ordinal"))).alias("b"))
    return best.select(key, "b.href", "b.score", X.classify_url(F.col("b.href")).alias("kind"))


def find_lists(landings: DataFrame, scored: DataFrame, accept: int = ACCEPT, second_hop: int = SECOND_HOP) -> DataFrame:
    """landings (abbr, page) with the link to a list: the best of the landing page or, if that is a middling link to a page of the same host, of the page it leads to."""
    best = best_links(scored)
    host = lambda c: F.try_parse_url(c, F.lit("HOST"))
    one = landings.join(best, "page", "left")
    two = best.select(F.col("page").alias("href"), F.col("href").alias("href2"), F.col("score").alias("score2"), F.col("kind").alias("kind2"))
    both = one.join(two, "href", "left")
    deeper = (F.col("score") < second_hop) & (F.col("kind") == "html") & (host(F.col("href")) == host(F.col("page"))) & (F.col("score2") > F.col("score"))
    pick = lambda c: F.when(F.coalesce(deeper, F.lit(False)), F.col(f"{c}2")).otherwise(F.col(c))
    out = both.select("abbr", pick("href").alias("list_url"), pick("score").alias("score"), pick("kind").alias("list_type"))
    fine = F.col("score") >= accept
    return out.select("abbr", *[F.when(fine, F.col(c)).alias(c) for c in ("list_url", "score", "list_type")], F.when(fine, "found").otherwise("none").alias("list_status"))


def settle_lists(programs: DataFrame, found: DataFrame, force: bool = False) -> DataFrame:
    """programs (abbr, override_url, list_url, list_status, best_url) with where their list is and why: an override, else the stored one (unless ``force``), else what was found."""
    f = found.select("abbr", F.col("list_url").alias("f_url"), F.col("list_type").alias("f_type"))
    stored = F.lit(not force) & F.col("list_url").isNotNull() & (F.coalesce("list_status", F.lit("none")) != "none")
    rows = programs.join(f, "abbr", "left")
    url = F.when(F.col("override_url").isNotNull(), F.col("override_url")).when(stored, F.col("list_url")).otherwise(F.col("f_url"))
    why = F.when(F.col("override_url").isNotNull(), "override").when(stored, "stored").when(F.col("best_url").isNull(), "no-landing").when(F.col("f_url").isNotNull(), "found").otherwise("none")
    return rows.select("abbr", url.alias("list_url"), F.when(url.isNotNull(), X.classify_url(url)).alias("list_type"), why.alias("status"))


def first_live(candidates: DataFrame) -> DataFrame:
    """The first candidate (key, ordinal, url, http_status) of each key that answered below 400."""
    return candidates.filter("http_status < 400").groupBy("key").agg(F.min_by("url", "ordinal").alias("url"))


def homepage_scores(brand_key: Column, tokens: Column, host: Column, endings: list[str]) -> Column:
    """100 and the number of tokens if the host is the brand, else how many longer tokens stand in it."""
    from shelfspark.operators.guards import host_is_brand

    part = F.size(F.filter(tokens, lambda t: (F.length(t) >= 5) & F.contains(host, t)))
    return F.when((host == "") | (brand_key == ""), 0).when(host_is_brand(brand_key, host, endings), 100 + F.size(tokens)).otherwise(part)


def rank_homepages(candidates: DataFrame, generic: list[str], endings: list[str], cap: int = 3, least: int = 2) -> DataFrame:
    """candidates (name, url) that are worth a probe, with ``score`` and ``rank``: by score, shortest path, secure, .com, address; ``cap`` a name, each of ``least`` or more."""
    url = F.col("url")
    host = F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")))
    score = homepage_scores(X.brand_key(F.col("name")), X.brand_tokens(F.col("name"), generic), X.host_label(url), endings)
    path = F.length(F.rtrim(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), F.lit("/")))
    keyed = candidates.withColumns({"score": score, "_path": path, "_https": F.when(url.startswith("https:"), 0).otherwise(1), "_com": F.when(host.endswith(".com"), 0).otherwise(1)})
    w = Window.partitionBy("name").orderBy(F.desc("score"), "_path", "_https", "_com", "url")
    return keyed.withColumn("rank", F.row_number().over(w)).filter((F.col("rank") <= cap) & (F.col("score") >= least)).select("name", "url", "score", "rank")


def search_results(pages: DataFrame, html: str = "html", status: str = "http_status", challenge: str = "complete the following challenge", least: int = 5) -> DataFrame:
    """(page columns, ordinal, href, blocked) of captured pages of a search engine: each result's own address, its redirect undone.

    A page is blocked, which is not the same as empty, if it was answered with
    202 or 403, shows a challenge, or has neither a result nor ``least`` links;
    it then has one row without an address, as has a page of 400 or above.
    """
    from shelfspark.sources import extract

    own = [c for c in pages.columns if c != html]
    found = extract.links(pages.select(*own, html), html)
    real = F.url_decode(F.regexp_extract("href", r"[?&]uddg=([^&]*)", 1))
    hits = found.filter(F.array_contains(F.split("css", r"\s+"), "result__a") & (F.col("href") != "")).withColumn("href", F.when(F.col("href").contains("duckduckgo.com/l/") & (real != ""), real).otherwise(F.col("href")))
    n = found.groupBy(*own).agg(F.count(F.lit(1)).alias("links"), F.count_if(F.array_contains(F.split("css", r"\s+"), "result__a")).alias("hits"))
    same = lambda a, b: [a[c].eqNullSafe(b[c]) for c in own]
    judged = pages.join(n.select(*[F.col(c).alias(f"_{c}") for c in own], "links", "hits"), [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in own], "left").select(*own, html, F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("hits", F.lit(0)).alias("hits"))
    refused = F.col(status).isin(202, 403) | F.coalesce(F.contains(html, F.lit(challenge)), F.lit(False))
    blocked = refused | ((F.col(status) < 400) & (F.col("hits") == 0) & (F.col("links") < least))
    state = judged.select(*own, blocked.alias("blocked"), (refused | (F.col(status) >= 400) | (F.col("hits") == 0)).alias("none"))
    fine = state.filter("not none").alias("s").join(hits.alias("h"), same(*(_Of(x) for x in "sh"))).select(*[f"s.{c}" for c in own], "h.ordinal", "h.href", "s.blocked")
    return fine.unionByName(state.filter("none").select(*own, F.lit(None).cast("bigint").alias("ordinal"), F.lit(None).cast("string").alias("href"), "blocked"))


class _Of:
    """Columns of an alias."""

    def __init__(self, alias: str):
        self.alias = alias

    def __getitem__(self, c: str) -> Column:
        return F.col(f"{self.alias}.{c}")


def dedupe_report(deduped: DataFrame, stores: DataFrame | None = None, moved: DataFrame | None = None) -> DataFrame:
    """By state, of ``resolve.dedupe``: distinct stores and folded rows; with ``stores``, as they were, kept rows that got a sibling's place and operators of several companies; with ``moved`` (state) the listings that changed company."""
    folded = F.count_if(F.col("kept") != F.col("id"))
    out = deduped.groupBy("state").agg((F.count(F.lit(1)) - folded).alias("distinct_stores"), folded.alias("duplicate_rows"))
    zero = lambda df, *cs: df.withColumns({c: F.coalesce(c, F.lit(0)) for c in cs})
    if stores is not None:
        before = stores.select("id", (F.col("latitude").isNull() | F.col("longitude").isNull()).alias("nowhere"))
        located = deduped.join(before, "id").filter("nowhere and latitude is not null and longitude is not null").groupBy("state").agg(F.count(F.lit(1)).alias("located_from_sibling"))
        clusters = deduped.groupBy("state", "operator").agg(F.count_distinct("company_id").alias("n")).filter("n > 1").groupBy("state").agg(F.count(F.lit(1)).alias("clusters"))
        out = zero(out.join(located, "state", "left").join(clusters, "state", "left"), "located_from_sibling", "clusters")
    if moved is not None:
        out = zero(out.join(moved.groupBy("state").agg(F.count(F.lit(1)).alias("realigned_products")), "state", "left"), "realigned_products")
    return out.orderBy("state")


def extract_report(records: DataFrame, by: str = "state", programs: DataFrame | None = None) -> DataFrame:
    """Records by state, most first; with ``programs`` (abbr, name, list_type) also those that yielded nothing."""
    n = records.groupBy(F.col(by).alias(by)).agg(F.count(F.lit(1)).alias("records"))
    if programs is None:
        return n.orderBy(F.desc("records"), by)
    rows = programs.select(F.col("abbr").alias(by), "name", F.coalesce("list_type", F.lit("-")).alias("list_type")).join(n, by, "left")
    return rows.withColumn("records", F.coalesce("records", F.lit(0))).orderBy(F.desc("records"), "name")


def list_report(settled: DataFrame) -> DataFrame:
    """How many jurisdictions' lists are where, by status and kind (of ``settle_lists``)."""
    return settled.groupBy("status", F.coalesce("list_type", F.lit("-")).alias("list_type")).agg(F.count(F.lit(1)).alias("n"), F.count("list_url").alias("with_list")).orderBy(F.desc("n"), "status", "list_type")


def coverage_report(programs: DataFrame) -> DataFrame:
    """Checks of programs (country, source_type, check_status, best_url): how many of each, how many with an address."""
    return programs.groupBy("country", F.coalesce("source_type", F.lit("-")).alias("source_type"), F.coalesce("check_status", F.lit("never")).alias("check_status")).agg(F.count(F.lit(1)).alias("n"), F.count("best_url").alias("with_url")).orderBy("country", F.desc("n"), "source_type", "check_status")


def candidate_domains(links: DataFrame, excluded: list[str], by: str = "name", url: str = "href") -> DataFrame:
    """(by, page, ordinal) of links to sites that may be a company's own: not excluded, fragments cut off, each once at its first place."""
    from shelfspark.operators.guards import domain_excluded

    host = F.regexp_replace(F.lower(F.coalesce(F.try_parse_url(F.col(url), F.lit("HOST")), F.lit(""))), r"^www\.", "")
    fine = F.col(url).startswith("http") & (host != "") & ~domain_excluded(host, excluded)
    return links.filter(fine).groupBy(by, F.regexp_replace(url, "#.*$", "").alias("page")).agg(F.min("ordinal").alias("ordinal"))


def run_tiers(targets: DataFrame, tiers: list[tuple[str, object]], key: str = "abbr") -> tuple[DataFrame, DataFrame]:
    """(records with ``method``, (key, records, method)): tiers (name, function of targets) in order of cost, each over the targets that those before left without a record that has a name."""
    from shelfspark.functions.text import is_placeholder
    from shelfspark.operators.access import AccessMethod, run_ladder

    named = targets.withColumn("target_key", F.col(key))
    methods = [AccessMethod(name, k, f) for k, (name, f) in enumerate(tiers)]
    records, attempts = run_ladder(named, methods, plausible=~is_placeholder(F.col("name")))
    n = records.groupBy("target_key", "method").agg(F.count(F.lit(1)).alias("records"))
    return records, named.select(key, "target_key").distinct().join(n, "target_key", "left").select(key, F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("method", F.lit("none")).alias("method"))
