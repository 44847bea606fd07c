"""Cross-page operators on small tables, against plain versions."""

import random

from sitegrain.operators import site as N


def table(spark, rows):
    return spark.createDataFrame(rows, "page_id long, texts array<string>")


def brute_changed(page, brief, t=0.5):
    page, brief = list(dict.fromkeys(page)), list(dict.fromkeys(brief))
    left_b, left_p = [x for x in brief if x not in page], [x for x in page if x not in brief]
    share = lambda a, b: len({*a.split()} & {*b.split()}) / len({*a.split()} | {*b.split()})
    pairs = sorted((-share(b, p), i, j) for i, b in enumerate(left_b) for j, p in enumerate(left_p) if share(b, p) >= t)
    out, used_b, used_p = [], set(), set()
    for s, i, j in pairs:
        if i not in used_b and j not in used_p:
            used_b.add(i)
            used_p.add(j)
            out.append((left_b[i], left_p[j], -s))
    return out


def test_changed_paragraphs_equal_a_greedy_walk(spark):
    rng = random.Random(5)
    base = [[rng.choice("abcdefghij") for _ in range(rng.randint(1, 8))] for _ in range(6)]

    def text():
        x = list(rng.choice(base))
        if rng.random() < 0.7:
            x[rng.randrange(len(x))] = rng.choice("abcdefghijklm")
        return " ".join(x)

    pages = [(i, [text() for _ in range(rng.randint(0, 9))]) for i in range(60)]
    briefs = [(i, [text() for _ in range(rng.randint(0, 9))]) for i in range(60)]
    got = N.changed_paragraphs(table(spark, pages), table(spark, briefs)).collect()
    exp = [(i, *c) for (i, p), (_, b) in zip(pages, briefs, strict=True) for c in brute_changed(p, b)]
    assert sorted(tuple(r) for r in got) == sorted(exp) and len(exp) > 20
    counts = {r.page_id: r for r in N.content_match(table(spark, pages), table(spark, briefs)).collect()}
    for (i, p), (_, b) in zip(pages, briefs, strict=True):
        same = len({*p} & {*b})
        n = len(brute_changed(p, b))
        assert (counts[i].matched, counts[i].changed, counts[i].missing, counts[i].extra) == (same, n, len({*b}) - same - n, len({*p}) - same - n)


def test_an_inserted_paragraph_shifts_no_pair(spark):
    page = ["Brand new words here", "One fine day we went out", "Two birds sat on a wall", "Same"]
    brief = ["One fine day we came out", "Two birds sat on the wall", "same!"]
    row = N.content_match(table(spark, [(1, page), (2, None)]), table(spark, [(1, brief), (3, ["x"])])).orderBy("page_id").collect()
    assert [(r.page_id, r.n_brief, r.matched, r.changed, r.missing, r.extra, r.match_pct) for r in row] == [
        (1, 3, 1, 2, 0, 1, 33.3), (2, 0, 0, 0, 0, 0, 100.0), (3, 1, 0, 0, 1, 0, 0.0),
    ]


def test_members_of_heavy_groups_are_all_listed_once(spark):
    rows = spark.createDataFrame([(i, "h", "x" if i % 3 else f"y{i % 12}") for i in range(300)] + [(300, "h", "alone"), (301, None, "x")], "page_id long, host string, title string")
    got = N.members(rows, N.duplicate_values(rows, "title"), ["host", "title"], "page_id", heavy=7).collect()
    assert sorted((r.page_id, r.title, r.n_pages) for r in got) == sorted([(i, "x", 200) for i in range(300) if i % 3] + [(i, f"y{i % 12}", 25) for i in range(0, 300, 3)])


def test_depth_leaves_no_working_tables(spark, tmp_path):
    import pathlib

    from sitegrain.session import shared_dir

    edges = spark.createDataFrame([(f"u{i}", f"u{2 * i + d}") for i in range(200) for d in (1, 2)] + [("u9", "u0"), ("u9", "u9")], "src string, dst string")
    found = N.page_depth(edges, spark.createDataFrame([("u0",), ("u0",), ("lone",)], "url string"))
    got = dict(found.collect())
    assert got["lone"] == 0 and all(got[f"u{i}"] == (i + 1).bit_length() - 1 for i in range(401)) and len(got) == 402
    assert not list(pathlib.Path(shared_dir(spark).removeprefix("file:")).glob("sitegrain-work-*"))


def test_compare_reads_the_log_once_and_over_long_gaps(spark):
    from sitegrain.operators import history as H

    rows = [(1, "2026-03-01", 1, "a"), (1, "2026-03-01", 1, "b"), (1, "2026-02-28", 1, "a"), (1, "2026-02-28", 2, "c"), (1, "2025-01-05", 1, "b"), (1, "2025-01-05", 7, "z"), (2, "1969-12-31", 1, "a")]
    log = spark.createDataFrame(rows, "site_id long, day string, page_no long, rule string").selectExpr("site_id", "CAST(day AS DATE) AS scan_day", "page_no", "rule")
    got = {(r.site_id, r.period): (r.new, r.fixed, r.persisting) for r in H.scan_compare(log).collect()}
    assert got == {
        (1, "yesterday"): (1, 1, 1), (1, "last week"): (1, 1, 1), (1, "last month"): (1, 1, 1),
        (2, "yesterday"): (1, 0, 0), (2, "last week"): (1, 0, 0), (2, "last month"): (1, 0, 0),
    }
    plan = H.presence(log)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1
