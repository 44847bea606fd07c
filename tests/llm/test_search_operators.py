"""URL filter, line de-duplication, main text, fingerprints, top-k: brute force on small tables."""

import pathlib
import random
import sys

import numpy as np
import pytest
import xxhash

from sitegrain.llm import linedup, mainhtml, simhash, topk, urlfilter
from sitegrain.llm.common import ship
from sitegrain.llm.queries import URL_RULES

SF = "/root/testdata/sf0.001"


def brute_url(url, rules):
    host, path = urlfilter.split_url(url)
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[2:] if fits else (None, "allow")))


URLS = ["http://A.Example.NET/en/x?q", "https://example.com/de/", "ftp://x.org/fr/#y", "no scheme", None, "", "http://net", "http://net/", "http://bnet/", "a://b.example.com:80/de/", "x://example.com?/de/", "http://./"]


def test_urls_equal_brute_force_both_ways(spark):
    ship(spark)
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS + URLS[:3])], "page_id int, url string, rule string")
    rules = spark.createDataFrame([*URL_RULES, (None, "/", "block"), ("net", "/", "allow")], "host string, path string, verdict string")
    for limit in (1 << 20, 0):
        got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in urlfilter.filter_urls(df, rules, max_store_bytes=limit).collect()}
        assert got == {(i, *brute_url(u, URL_RULES)) for i, u in enumerate(URLS + URLS[:3])}
    assert urlfilter.filter_urls(df.limit(0), rules).count() == 0
    assert {r.verdict for r in urlfilter.filter_urls(df, rules.limit(0)).collect()} == {"allow"}


def test_equal_digests_are_told_apart():
    flat = lambda key: len(key) % 2
    rng = random.Random(1)
    rules = [(f"h{rng.randint(0, 99)}.com", rng.choice(["/", "/a/", "/b"]), "block") for _ in range(300)]
    store = urlfilter.Store(urlfilter.build_store(rules, flat), flat)
    urls = [(f"x.h{rng.randint(0, 120)}.com", rng.choice(["/", "/a/c", "/b", ""])) for _ in range(200)]
    assert store.judge(urls) == [brute_url(f"http://{h}{p}", rules)[2:] for h, p in urls]


def brute_lines(docs):
    seen, out = [], {}
    for d, text in sorted(docs, key=lambda r: r[0]):
        gone, mine = [], []
        for i, line in enumerate((text or "").split("\n")):
            words = frozenset(line.split())
            if words:
                if any(9 * len(words & v) >= 4 * (len(words) + len(v)) for v in seen):
                    gone.append(i)
                seen.append(words)
        out[d] = gone
    return out


@pytest.mark.parametrize("short", [1, 3, 64])
def test_lines_equal_brute_force(spark, short):
    ship(spark)
    rng = random.Random(short)
    words = [f"w{i}" for i in range(30)]
    base = [[rng.choice(words) for _ in range(rng.randint(1, 90))] for _ in range(12)]

    def line():
        x = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            x[rng.randrange(len(x))] = rng.choice(words)
        return " ".join(x)

    docs = [(i, "\n".join(line() for _ in range(rng.randint(0, 6)))) for i in range(60)] + [(100, None), (101, ""), (102, " \n \n")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {r.d: r.removed for r in linedup.line_verdicts(df, linedup.Similarity(short_list=short)).collect()}
    assert got == brute_lines(docs)


def test_lines_edge_rows(spark):
    rows = [(1, "a b\nx", "k"), (1, "a b\nx", "k"), (2, "b a\ny\ny", None), (None, "a b\nz", "n"), (3, None, "t"), (4, "", "u")]
    df = spark.createDataFrame(rows, "doc_id long, text string, removed string")
    out = linedup.without_repeated_lines(df)
    assert out.columns == df.columns
    assert sorted(((r.doc_id or -1), r.text or "", r.removed or "") for r in out.collect()) == sorted([(1, "a b\nx", "k"), (1, "a b\nx", "k"), (2, "y", ""), (-1, "z", "n"), (3, "", "t"), (4, "", "u")])
    assert linedup.without_repeated_lines(df.limit(0)).count() == 0


def brute_fp(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    parts = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_equal_brute_force():
    texts = [None, "", "One", "a b c d e f g É", "x " * 50, "A b C d", " \x0b tab\tword here now then"]
    assert simhash.fingerprints_of(texts).view(np.uint64).tolist() == [brute_fp(t) for t in texts]


def groups(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("cell_rows", [5, 20_000])
def test_links_hold_components_together(spark, cell_rows):
    ship(spark)
    rng = random.Random(cell_rows)
    fps = [rng.getrandbits(64) for _ in range(150)] + [0]
    for _ in range(250):  # chains and thick clusters
        x = rng.choice(fps)
        for _ in range(rng.randint(1, 5)):
            x ^= 1 << rng.randrange(64)
        fps.append(x)
    fps = sorted(set(fps))
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    pairs = simhash.links(df, 4, cell_rows)
    found = {r.node & (2**64 - 1): r.root for r in simhash.components(df, pairs).collect()}
    want, got = groups(fps), [found.get(x, ("alone", x)) for x in fps]
    assert len(set(want)) == len(set(got)) == len(set(zip(want, got, strict=True)))


def test_components_edge_rows(spark):
    rows = [(3, "same text of five words here", "a"), (1, "Same text OF five words here", "b"), (3, "same text of five words here", "c"), (None, "same text of five words here", "d"), (8, None, "e"), (9, "", "f"), (7, "quite another text to stand alone", "g"), (None, "lonely words without an id at all", "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted(((r.doc_id or -1), r.component_id) for r in simhash.near_components(df).collect() if r.component_id is not None)
    assert got == sorted([(3, 1), (1, 1), (3, 1), (-1, 1), (8, 8), (9, 8), (7, 7)])
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and sorted(r.fp for r in kept.collect()) == ["b", "d", "e", "g", "h"]
    assert simhash.near_components(df.limit(0)).count() == 0


def test_top_k_equals_brute_force(spark):
    ship(spark)
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in rng.normal(0, 0.2, 6)]) for i in range(150)]
    rows += [(200, [0.0] * 6), (201, [1e9] * 6), (202, None), (203, [0.1] * 5 + [None]), (204, [float("nan")] + [0.1] * 5), (205, [float("inf")] * 6), (206, [0.5] * 6), (207, [0.5] * 6), (208, []), (209, [0.1, 0.2])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumnRenamed("none", "none")
    ok = {i: [int(np.floor(64 * x)) for x in v] for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v)}
    want = set()
    for q in (i for i in ok if i % 20 == 0):
        scored = sorted((-sum(a * b for a, b in zip(ok[q], v, strict=True)), i) for i, v in ok.items() if i != q and len(v) == len(ok[q]))
        want |= {(q, r, i, -s) for r, (s, i) in enumerate(scored[:7], 1)}
    got = {(r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(df, df.filter("vec_id % 20 = 0"), 7, block=40, query_block=3).collect()}
    assert got == want
    assert topk.top_k(df.limit(0), df.limit(0), 7).count() == 0


def test_keep_one_tells_rows_of_one_id_apart(spark):
    rng = random.Random(4)
    one, two, other = (" ".join(f"w{rng.getrandbits(30)}" for _ in range(40)) for _ in range(3))
    rows = [(3, one, "a"), (3, two, "b"), (3, two, "b"), (5, two, "c"), (4, other, "d"), (1, one, "e")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, score string")).collect()
    assert sorted(r.score for r in kept) == ["b", "d", "e"]


def test_search_walks_the_lists_to_the_bound():
    rows = np.random.default_rng(2).integers(0, 50, (2000, 64))
    rows[:80] = 1000
    got, scores, read = topk.Lists(np.arange(2000), rows).search(-1, np.ones(64, np.int64), 5)
    assert got.tolist() == [0, 1, 2, 3, 4] and scores.tolist() == [64_000] * 5 and 80 < read < 200


def test_search_stops_early():
    ids, rows = np.arange(5000), np.zeros((5000, 4), np.int64)
    rows[:40] = 100 + np.arange(40)[:, None]
    rows[40:] = np.random.default_rng(1).integers(0, 50, (4960, 4))
    lists = topk.Lists(ids, rows)
    got, scores, read = lists.search(-1, np.array([1, 2, 1, 3]), 5)
    assert got.tolist() == [39, 38, 37, 36, 35] and read < 100


PAGES = [
    ("<html><body><nav><a href=x>Home</a></nav><article><h1>Title &amp; more</h1><p>First  line\nof text, long enough to count.<p>Second &lt;one&gt;, also a whole sentence.<script>var a='<p>no</p>'</script></article><footer>&copy; us</footer></body></html>",
     "Title & more\nFirst line of text, long enough to count.\nSecond <one>, also a whole sentence."),
    (None, ""), ("", ""), ("<html><body><nav>a</nav></body></html>", ""), ("<!-- open", ""),
]


def test_main_text(spark):
    ship(spark)
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    trees = mainhtml.train(pages)
    df = spark.createDataFrame([(i, "u", h, 9) for i, (h, _) in enumerate(PAGES)], "page_id long, url string, html string, n_chars int")
    rows = {r.page_id: r for r in mainhtml.extracted(df, trees).collect()}
    for i, (_, text) in enumerate(PAGES):
        assert rows[i].text == text and rows[i].n_chars == len(text)
    assert mainhtml.extracted(df.limit(0), trees).count() == 0


def test_unseen_pages_made_of_known_parts():
    paragraphs = [[f"Sentence {i} of page {j}, which is long enough to be a paragraph." for i in range(4)] for j in range(20)]
    how = mainhtml.Boosting()
    taught = mainhtml.Nodes([mainhtml.Page(x) for x in mainhtml.composed(paragraphs, 200, seed=1)])
    trees = mainhtml.Trees(taught.x[~taught.root], taught.taught()[~taught.root], how)
    new = mainhtml.Nodes([mainhtml.Page(x) for x in mainhtml.composed(paragraphs, 100, seed=2)])
    keep = new.decoded(trees.log_odds(new.x))
    assert (keep == new.taught())[~new.root].mean() > 0.95
    assert not (keep & ~keep[new.parent]).any()  # nothing kept under a rejected node


def test_deep_and_broken_pages_end():
    trees = mainhtml.Trees(np.random.default_rng(0).random((50, 23)).astype(np.float32), np.arange(50) % 2, mainhtml.Boosting(trees=2))
    assert mainhtml.texts_of(["<div>" * 3000 + "x", "<p" * 5000, "<a href='" * 3000, "</div>" * 3000 + "<td>y"], trees)


def test_pipeline_runs_and_keeps_clean_documents(spark, tmp_path):
    sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[2]))
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    clean = cp.drop_toxic(spark, docs, SF)
    assert clean.columns == docs.columns
    good = labels.filter("toxic = 0 AND quality = 1").join(docs, "doc_id").filter("length(text) > 300").select("doc_id")
    kept = cp.drop_poor(spark, clean, SF)
    assert kept.join(good, "doc_id").count() > 0.85 * good.count()
    lines = cp.drop_lines(spark, kept, SF)
    assert lines.count() == kept.count() and lines.columns == docs.columns
    once = cp.drop_near_copies(spark, lines, SF)
    assert once.columns == docs.columns and once.select("doc_id").distinct().count() == once.count() <= lines.count()
    packed = cp.pack(spark, once, SF)
    assert packed.groupBy("doc_id").agg({"length": "sum"}).count() == once.count()
    empty = docs.limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_pipeline_learns_from_texts_of_short_words_too(spark, tmp_path):
    sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[2]))
    import corpus_pipeline as cp

    texts = ["river stone window paper", "you moronic river stone", "En de ja de y.", ""]
    rows = [(i, f"{texts[i % 4]} {i}" if i % 4 < 2 else texts[i % 4], "en", "s", 1, int(i % 4 == 1)) for i in range(80)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, toxic int")
    table.select("doc_id", "toxic").write.parquet(f"{tmp_path}/labels.parquet")
    kept = cp.drop_toxic(spark, table.drop("toxic"), str(tmp_path))
    assert sorted(r.doc_id for r in kept.collect()) == [i for i in range(80) if i % 4 != 1]


@pytest.mark.parametrize("part", ["<svg-icon name=x></svg-icon>", "<video-player>", "<title-bar>", "<style-guide>", "<svg/>", "<svg class='nav x'/>", "<math/>", "<svg><title/></svg>", "<datalist><option value=1><option value=2></datalist>", "<select><option>", "<iframe src=x>"])
def test_no_element_hides_what_stands_behind_it(part):
    page = mainhtml.Page(f"<div><p>a</p>{part}</div><p>b</p>")
    assert page.text(np.ones(len(page.tag), bool)).split("\n") == ["a", "b"]
    assert all(e > i for i, e in enumerate(page.end))


def test_only_raw_text_is_hidden():
    page = mainhtml.Page("<title>t</title><p>so <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds</p><style>s</style><textarea>f</textarea><script>'<p>'</script ><p>b</p><script>rest")
    assert page.text(np.ones(len(page.tag), bool)) == "so x=1 holds\nb"


def test_hosts_of_many_dots_are_judged_in_time():
    import time

    store = urlfilter.Store(urlfilter.build_store([*URL_RULES, ("", "/e", "block")]))
    began = time.perf_counter()
    hosts = [("." * 100_000 + "net", "/"), ("a." * 50_000 + "example.net", "/en/x"), ("." * 100_000, "/e")]
    assert store.judge(hosts) == [("net/", "block"), ("example.net/en/", "allow"), ("/e", "block")]
    assert time.perf_counter() - began < 2


def nodes_of(html):
    return mainhtml.Nodes([mainhtml.Page(html)])


def test_only_what_hides_or_names_a_part_counts_against_it():
    for html in ("<p style='border:none'>x</p>", "<article style='list-style:none'>x</article>", "<body id='ad-free'><p>x</p></body>", "<main class='social-policy'>x</main>"):
        assert not nodes_of(html).bad.any(), html
    for html in ("<p style='color:red; display : none'>x</p>", "<div style='visibility:hidden'>x</div>", "<div class='ad'>x</div>", "<p hidden>x</p>"):
        assert nodes_of(html).bad.sum() == 1, html
    assert (nodes_of("<div data-y=1>x</div><p data-y='0'>y</p>").label == -1).all()
    assert set(mainhtml.Page("<div data-y=1>x</div>", labelled=True).label) == {-1, 1}


def test_decoding_is_the_best_of_all_labellings():
    import itertools

    rng = np.random.default_rng(4)
    tags = ["div", "section", "p", "ul", "li"]
    for _ in range(40):
        html, open_ = "", []
        for _ in range(int(rng.integers(2, 9))):
            while open_ and rng.random() < 0.4:
                html += f"</{open_.pop()}>"
            tag = tags[rng.integers(0, 2)]
            html += f"<{tag}>{'x' * int(rng.integers(0, 20))}"
            open_.append(tag)
        nodes = nodes_of(html)
        odds = rng.normal(size=len(nodes.parent))
        gain = np.where(nodes.root, 0, odds) * nodes.weight
        best, chosen = -np.inf, None
        for keep in itertools.product([False, True], repeat=len(gain) - 1):
            k = np.array([True, *keep])
            if (k & ~k[nodes.parent]).any():
                continue  # kept under a rejected node
            total = np.where(k, gain, -gain).sum()
            if total > best:
                best, chosen = total, k
        assert (nodes.decoded(odds) == chosen).all(), html


def test_deep_and_unmatched_markup_is_read_in_time():
    import time

    trees = mainhtml.Trees(np.random.default_rng(0).random((50, 23)).astype(np.float32), np.arange(50) % 2, mainhtml.Boosting(trees=2))
    began = time.perf_counter()
    mainhtml.texts_of(["<div>" * 50_000 + "x", "<section>" * 3000 + "</p>" * 100_000 + "y"], trees)
    assert time.perf_counter() - began < 10
