"""Cross-page questions: duplicates, link graph, depth, sitemap, robots, checklist."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitegrain import constants as K
from sitegrain.functions import urls
from sitegrain.functions.text import collapse
from sitegrain.session import Scratch, materialised


def host_of(url: Column) -> Column:
    return urls.authority(url)


def duplicate_values(values: DataFrame, column: str) -> DataFrame:
    """(host, value) on several pages; values has one row per page and value.

    Counts are combined before the shuffle, so a value on a third of all pages
    arrives as one row per task.
    """
    return (
        values.groupBy("host", column).agg(F.count("*").alias("n_pages"), F.min("page_id").alias("first_page"))
        .filter("n_pages > 1")
    )


#: A group with more members is dealt over several tasks when they are listed.
HEAVY = 100_000


def members(values: DataFrame, groups: DataFrame, keys: list[str], member: str, heavy: int = HEAVY) -> DataFrame:
    """(member, *keys, n): every member of every group; groups(*keys, n) as counted, one row each.

    Groups over ``heavy`` are known from their counts; each is cut into parts, and its
    members go to a part by their own key, so no task gets a whole one.
    """
    size = groups.columns[len(keys)]
    groups = materialised(groups.select(*keys, F.col(size).alias("__n")))
    parts = F.ceil(F.col("__n") / heavy).cast("int").alias("__parts")
    dealt = values.join(groups.filter(F.col("__n") > heavy).select(*keys, parts), keys, "left")
    dealt = dealt.withColumn("__part", F.coalesce(F.pmod(F.hash(member), F.col("__parts")), F.lit(0)))
    cut = groups.withColumn("__part", F.explode(F.sequence(F.lit(0), F.ceil(F.col("__n") / heavy).cast("int") - 1)))
    return dealt.join(cut, [*keys, "__part"]).select(member, *keys, F.col("__n").alias(size))


def content_hashes(texts: DataFrame) -> DataFrame:
    """(source, parts array<string>) → one row per source and distinct text."""
    plain = F.filter(F.transform("parts", lambda t: F.lower(collapse(t))), lambda t: t != "")
    hashed = F.array_distinct(F.transform(plain, lambda t: F.sha2(t, 256)))
    return texts.select("source", F.explode(hashed).alias("digest"))


def duplicate_content(texts: DataFrame) -> DataFrame:
    """Texts found in several sources: digest, number of sources, one of them.

    Only digests are shuffled, already distinct within each source.
    """
    return (
        content_hashes(texts)
        .groupBy("digest")
        .agg(F.count("*").alias("n_sources"), F.min("source").alias("first_source"))
        .filter("n_sources > 1")
    )


# --- link graph -------------------------------------------------------------


def internal_edges(pages: DataFrame) -> DataFrame:
    """pages(page_id, base_host, links) → (page_id, src, dst), distinct, without self links."""
    here = urls.without_fragment(F.col("base_url"))
    targets = F.array_distinct(
        F.transform(
            F.filter("links", lambda a: urls.authority(a["href"]) == F.col("base_host")),
            lambda a: urls.without_fragment(a["href"]),
        )
    )
    rows = pages.select("page_id", here.alias("src"), F.explode(targets).alias("dst"))
    return rows.filter("src <> dst")


def link_degrees(pages: DataFrame) -> DataFrame:
    """pages as for internal_edges → per page its out- and in-degree and whether it is an orphan.

    In-degrees are counted by target before they meet the pages, so a home page
    that everything links to is one row in the join.
    """
    edges = internal_edges(pages)
    came = edges.groupBy(F.col("dst").alias("url")).agg(F.count("*").alias("in_degree"))
    here = urls.without_fragment(F.col("base_url"))
    targets = F.array_distinct(
        F.transform(
            F.filter("links", lambda a: urls.authority(a["href"]) == F.col("base_host")),
            lambda a: urls.without_fragment(a["href"]),
        )
    )
    base = pages.select(
        "page_id", here.alias("url"), F.size(F.array_except(targets, F.array(here))).alias("out_degree")
    )
    return base.join(came, ["url"], "left").select(
        "page_id", "url", "out_degree", F.coalesce("in_degree", F.lit(0)).alias("in_degree"),
        F.col("in_degree").isNull().alias("is_orphan"),
    )


def link_edges(pages: DataFrame) -> DataFrame:
    """Edges between known pages: (page_id, target_page_id)."""
    known = pages.select(F.col("page_id").alias("target_page_id"), urls.without_fragment(F.col("base_url")).alias("dst"))
    return internal_edges(pages).join(known, ["dst"]).select("page_id", "target_page_id")


def orphan_pages(pages: DataFrame) -> DataFrame:
    known = pages.select("page_id", urls.without_fragment(F.col("base_url")).alias("dst"))
    return known.join(internal_edges(pages).select("dst").distinct(), "dst", "left_anti")


def page_depth(edges: DataFrame, roots: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Clicks from the roots: edges(src, dst), roots(url) → (url, depth).

    Addresses are numbered once and joined again at the end; the levels in
    between move numbers only: the front meets the edges by source, what it reaches is made
    distinct, and what was seen before is left out, until a level finds nothing new
    (or ``max_depth``).  Levels are written and removed when all is known.
    """
    work = Scratch(edges.sparkSession)
    edges = edges.select("src", "dst")
    names = edges.select(F.col("src").alias("url")).unionByName(edges.select(F.col("dst").alias("url"))).unionByName(roots.select("url"))
    names = work.table(names.distinct().select("url", F.monotonically_increasing_id().alias("id")))
    numbered = lambda side: names.select(F.col("url").alias(side), F.col("id").alias(f"{side}_id"))
    laid = edges.join(numbered("src"), "src").join(numbered("dst"), "dst").select("src_id", "dst_id")
    laid = work.table(laid.distinct())
    front = work.table(roots.select("url").distinct().join(names, "url").select("id", F.lit(0).alias("depth")))
    seen = front
    for depth in itertools.count(1) if max_depth is None else range(1, max_depth + 1):
        reached = laid.join(front.select(F.col("id").alias("src_id")), "src_id", "left_semi").select(F.col("dst_id").alias("id")).distinct()
        front = work.table(reached.join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    found = materialised(seen.join(names, "id").select("url", "depth"))
    work.remove()
    return found


# --- sitemap and robots -----------------------------------------------------


def sitemap_coverage(pages: DataFrame, sitemap: DataFrame) -> DataFrame:
    """(url, state): on both sides, or missing from the one or the other."""
    crawled = pages.select("url").distinct().withColumn("crawled", F.lit(True))
    listed = sitemap.select("url").distinct().withColumn("listed", F.lit(True))
    both = crawled.join(listed, "url", "full")
    state = (
        F.when(F.col("listed").isNull(), F.lit("not in sitemap"))
        .when(F.col("crawled").isNull(), F.lit("not crawled"))
        .otherwise(F.lit("both"))
    )
    return both.select("url", state.alias("state"))


def robots_blocked(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """pages(page_id, url), rules(host, kind allow|disallow, prefix) → (page_id, rule, blocked).

    The longest matching prefix wins, allow on a tie.  Instead of comparing
    every path with every rule, a path is cut at the lengths its host's rules
    have, and the pieces are looked up by equality.
    """
    rules = rules.filter(F.col("prefix") != "")
    ranked = rules.groupBy("host", "prefix").agg(F.min("kind").alias("kind"))
    lengths = ranked.groupBy("host").agg(F.collect_set(F.length("prefix")).alias("lengths"))
    target = F.concat(urls.path(F.col("url")), urls.query(F.col("url")))
    p = pages.select("page_id", host_of(F.col("url")).alias("host"), F.when(target == "", F.lit("/")).otherwise(target).alias("target"))
    cut = p.join(lengths, ["host"], "left")
    fit = F.filter(F.coalesce("lengths", F.array().cast("array<int>")), lambda n: n <= F.length("target"))
    pieces = cut.select(
        "page_id", "host", F.explode_outer(F.transform(fit, lambda n: F.left("target", n))).alias("prefix")
    )
    hit = pieces.join(ranked, ["host", "prefix"], "left")
    best = F.max(F.when(F.col("kind").isNotNull(), F.struct(F.length("prefix").alias("n"), "prefix", "kind")))
    return hit.groupBy("page_id").agg(best.alias("b")).select(
        "page_id", F.col("b.prefix").alias("rule"),
        F.coalesce(F.col("b.kind") == "disallow", F.lit(False)).alias("blocked"),
    )


# --- checklist --------------------------------------------------------------

# Rules that fail an item; h2 and sitemap are looked at directly.
ITEM_RULES = {
    "meta_title": ["seo.missing-title"],
    "meta_description": ["seo.missing-meta-description", "seo.empty-meta-description"],
    "canonical": ["seo.missing-canonical"],
    "h1": ["seo.missing-h1", "seo.multiple-h1"],
    "robots": ["seo.noindex"],
    "responsive": ["seo.missing-viewport"],
    "accessibility": ["seo.missing-lang", "seo.heading-level-skip", "seo.empty-heading"],
    "images_optimized": ["image.legacy-format", "image.no-dimensions", "image.oversized"],
    "image_alt": ["image.missing-alt", "image.generic-alt"],
    "no_broken_links": ["link.broken"],
}


def qa_checklist(audited: DataFrame, findings: Column, sitemap: DataFrame) -> DataFrame:
    """audited(page_id, url, has_h2, ...) → one row per page and the share passed."""
    names = F.array_distinct(F.transform(findings, lambda f: f["rule"]))
    listed = sitemap.select("url").distinct().withColumn("_listed", F.lit(True))
    df = audited.withColumn("_rules", names).join(listed, ["url"], "left")
    items = {
        item: ~F.arrays_overlap("_rules", F.array(*[F.lit(r) for r in rules]))
        for item, rules in ITEM_RULES.items()
    }
    items["h2"] = F.col("has_h2")
    items["sitemap"] = F.col("_listed").isNotNull()
    done = df.select("page_id", *[items[i].alias(i) for i in K.CHECKLIST_ITEMS])
    passed = sum((F.col(i).cast("int") for i in K.CHECKLIST_ITEMS), F.lit(0))
    return done.withColumn("score", F.bround(passed / len(K.CHECKLIST_ITEMS) * 100, 1))


def axe_pages(violations: DataFrame) -> DataFrame:
    """(page_id, rule, impact, selector, n_pages): the pages of every violation."""
    keys = ["rule", "impact", "selector"]
    rows = violations.select("page_id", *keys).distinct()
    return members(rows, rows.groupBy(*keys).agg(F.count("*").alias("n_pages")), keys, "page_id")


def axe_findings(violations: DataFrame) -> DataFrame:
    """(page_id, rule, impact, selector) → findings, one per violation across pages."""
    severity = F.lit(None).cast("string")
    for impact, name in K.AXE_SEVERITY.items():
        severity = F.when(F.col("impact") == impact, F.lit(name)).otherwise(severity)
    return (
        violations.dropDuplicates(["page_id", "rule", "impact", "selector"])
        .groupBy("rule", "impact", "selector")
        .agg(F.count("*").alias("n_pages"), F.min("page_id").alias("first_page"))
        .withColumn("severity", severity)
    )


# --- content against a brief ------------------------------------------------


def normal(c: Column) -> Column:
    """Lower case, letters, digits and single blanks only."""
    return collapse(F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]+", " ")))


def _left_over(pages: DataFrame, briefs: DataFrame) -> DataFrame:
    """(page_id, n_brief, matched, left_b, left_p): what equal paragraphs leave on both sides, in order."""
    texts = lambda c: F.array_distinct(F.filter(F.transform(c, normal), lambda t: t != ""))
    df = pages.select("page_id", texts(F.col("texts")).alias("p")).join(
        briefs.select("page_id", texts(F.col("texts")).alias("b")), "page_id", "full"
    )
    none = F.array().cast("array<string>")
    df = df.select("page_id", F.coalesce("p", none).alias("p"), F.coalesce("b", none).alias("b"))
    return df.select(
        "page_id", F.size("b").alias("n_brief"), F.size(F.array_intersect("b", "p")).alias("matched"),
        F.array_except("b", "p").alias("left_b"), F.array_except("p", "b").alias("left_p"),
    )


def _similar(left: DataFrame, threshold: float) -> DataFrame:
    """(page_id, b, p, share): pairs of left-over paragraphs that share enough of their words.

    An inverted index by page and word, of each paragraph's rarest words only:
    of n words, two paragraphs that share ``threshold`` of all their words have one in
    common among the n - ceil(threshold * n) + 1 rarest of either.
    """

    def side(name: str) -> DataFrame:
        words = left.select("page_id", F.posexplode(f"left_{name}").alias("k", "text"))
        return words.select("page_id", F.lit(name).alias("side"), "k", F.array_distinct(F.split("text", " ")).alias("words"))

    paragraphs = {name: side(name) for name in "bp"}
    posts = paragraphs["b"].unionByName(paragraphs["p"]).select("page_id", "side", "k", F.size("words").alias("n"), F.explode("words").alias("word"))
    rare = Window.partitionBy("page_id", "side", "k").orderBy("in_page", "word")
    posts = posts.withColumn("in_page", F.count("*").over(Window.partitionBy("page_id", "word"))).withColumn("rank", F.row_number().over(rare))
    posts = posts.filter(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1)
    of = {name: posts.filter(F.col("side") == name).select("page_id", "word", F.col("k").alias(name), F.col("n").alias(f"n_{name}")) for name in "bp"}
    met = of["b"].join(of["p"], ["page_id", "word"])
    met = met.filter((F.col("n_p") >= threshold * F.col("n_b") - 1e-9) & (F.col("n_b") >= threshold * F.col("n_p") - 1e-9)).select("page_id", "b", "p").distinct()
    for name, rows in paragraphs.items():
        met = met.join(rows.select("page_id", F.col("k").alias(name), F.col("words").alias(f"w_{name}")), ["page_id", name])
    share = F.size(F.array_intersect("w_b", "w_p")) / F.size(F.array_union("w_b", "w_p"))
    return met.select("page_id", "b", "p", share.alias("share")).filter(F.col("share") >= threshold)


def _greedy(pairs: DataFrame) -> DataFrame:
    """The pairs a greedy choice takes: highest share first, then in the order of the brief and of the page.

    A pair that is the best of both its sides is taken whatever else is, so
    all such pairs are taken at once; those they touch go, until none is left.
    No page's pairs need to stand in one place.
    """
    order = [F.desc("share"), "b", "p"]
    best = lambda side: F.row_number().over(Window.partitionBy("page_id", side).orderBy(*order))
    rest, taken = materialised(pairs), None
    while not rest.isEmpty():
        now = materialised(rest.withColumn("of_b", best("b")).withColumn("of_p", best("p")).filter("of_b = 1 AND of_p = 1").select(pairs.columns))
        taken = now if taken is None else taken.unionByName(now)
        for side in "bp":
            rest = rest.join(now.select("page_id", side), ["page_id", side], "left_anti")
        rest = materialised(rest.select(pairs.columns))
    return rest if taken is None else taken


def changed_paragraphs(pages: DataFrame, briefs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(page_id, brief_text, page_text, share): paragraphs of the brief that the page words otherwise."""
    left = materialised(_left_over(pages, briefs))
    pairs = _greedy(_similar(left, threshold))
    return left.join(pairs, "page_id").select("page_id", F.get("left_b", "b").alias("brief_text"), F.get("left_p", "p").alias("page_text"), "share")


def content_match(pages: DataFrame, briefs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """pages(page_id, texts), briefs(page_id, texts) → how well the page holds to its brief.

    Paragraphs equal but for case and punctuation match.  What is left over on
    both sides is paired by the share of words in common, wherever it stands,
    the closest first; a pair sharing enough words was changed.
    """
    left = materialised(_left_over(pages, briefs))
    n = _greedy(_similar(left, threshold)).groupBy("page_id").agg(F.count("*").cast("int").alias("changed"))
    df = left.join(n, "page_id", "left").withColumn("changed", F.coalesce("changed", F.lit(0)))
    return df.select(
        "page_id", "n_brief", "matched", "changed",
        (F.size("left_b") - F.col("changed")).alias("missing"),
        (F.size("left_p") - F.col("changed")).alias("extra"),
        F.when(F.col("n_brief") == 0, F.lit(100.0))
        .otherwise(F.bround(F.col("matched") / F.col("n_brief") * 100, 1)).alias("match_pct"),
    )
