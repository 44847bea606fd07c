"""A cross-section of the registered queries against DuckDB, and the streams against the batch."""

import duckdb
import pytest

import __spark_entry__ as entry
from check import _rows
from conftest import SF
from sitegrain.operators import history as H
from sitegrain.operators import site as N
from sitegrain.sources import sinks
from sitegrain.sources.fixtures import TABLES

SAMPLE = [
    "tokens", "headings", "links", "images", "meta_inventory", "canonical_info", "index_follow", "pack_scores",
    "sorted_findings", "link_graph", "page_depth", "robots_blocked", "content_match", "scan_compare", "gen_documents",
    "stream_audit", "stream_severity_counts", "findings_export",
]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", SAMPLE)
def test_same_as_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    rel = con.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(rel.columns, rel.fetchall())


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 50


def stream_of(spark, *batches):
    from sitegrain.streaming import stream as T

    frames = [spark.sql("SELECT timestamp'2026-01-01 ' + make_dt_interval(0, h) AS ts, k FROM VALUES " + ", ".join(f"({h}, '{k}')" for h, k in b) + " AS v(h, k)") for b in batches]
    return T.paced(frames[0], 1, *frames[1:])


def test_a_key_comes_again_beyond_the_horizon_and_a_late_one_does_not(spark):
    from sitegrain.streaming import stream as T

    rows = stream_of(
        spark,
        [(0, "a"), (1, "a"), (1, "b")],
        [(2, "a"), (6, "b"), (9, "c")],  # a again within 3 hours of its last row, b beyond
        [(10, "d")],  # a batch tells late rows by the watermark that the one before it had
        [(1, "late"), (4, "a")],  # their runs would have ended behind 9 - 1
        [(12, "a"), (40, "end")],
    )
    run = T.run_counted(T.stream_dedup(rows, ["k"], "3 hours"), "t")
    got = sorted((r.k, r.ts.hour) for r in run.table.collect())
    assert got == [("a", 0), ("a", 12), ("b", 1), ("b", 6), ("c", 9), ("d", 10)]
    assert (run.batches, run.dropped) == (5, 2)


def test_a_row_after_closing_changes_no_window(spark):
    from sitegrain.streaming import stream as T

    rows = stream_of(spark, [(0, "low"), (5, "low"), (6, "high")], [(11, "low"), (13, "low")], [(14, "low")], [(2, "low"), (12, "high")], [(60, "end")])
    run = T.run_counted(T.stream_severity_counts(rows.withColumnRenamed("k", "severity")), "t")
    got = sorted((r.start.hour, r.severity, r.n) for r in run.table.filter("severity <> 'end'").collect())
    assert got == [(0, "low", 2), (6, "high", 1), (6, "low", 1), (12, "high", 1), (12, "low", 2)]
    assert (run.batches, run.dropped) == (5, 1)


def test_depth_is_shortest_and_bounded(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("d", "a"), ("x", "y")], "src string, dst string")
    roots = spark.createDataFrame([("a",)], "url string")
    assert dict(N.page_depth(edges, roots, 10).collect()) == {"a": 0, "b": 1, "c": 1, "d": 2}
    assert dict(N.page_depth(edges, roots, 1).collect()) == {"a": 0, "b": 1, "c": 1}


def test_no_link_image_or_attribute_is_cut_off(spark):
    from pyspark.sql import functions as F

    from sitegrain.operators import probes as P
    from sitegrain.operators.extract import extract

    links = "".join(f'<a href="/p{i}">p{i}</a>' for i in range(100))
    images = "".join(f'<img src="/i{i}.png">' for i in range(90))
    many = "<div " + " ".join(f'data-{i}="a>b"' for i in range(80)) + ">seen</div>"
    df = spark.createDataFrame([(1, "https://a.test/", f"<title>t</title>{many}{links}{images}")], "page_id bigint, url string, html string")
    page = extract(df, ["links", "images", "text_length"])
    status = spark.range(100).selectExpr("concat('https://a.test/p', id) AS url", "CASE WHEN id = 77 THEN 404 ELSE 200 END AS status")
    found = P.checked_links(page, status).selectExpr("not_checked", "size(found) AS n", "size(filter(found, x -> x.status = 404)) AS bad").first()
    assert tuple(found) == (0, 100, 1)
    sizes = spark.range(90).selectExpr("concat('https://a.test/i', id, '.png') AS src", "1L AS byte_size", "'image/png' AS content_type", "'' AS error", "false AS at_least")
    assert P.measured_assets(page, sizes).select(F.size("found")).first()[0] == 90
    assert page.select("text_length").first()[0] == len("t") + len("seen") + sum(len(f"p{i}") for i in range(100))


def test_limits_and_export_are_guarded(spark, tmp_path):
    df = spark.range(1)
    with pytest.raises(ValueError):
        H.list_scans(df, 101)
    with pytest.raises(ValueError):
        H.list_findings(df, limit=0)
    with pytest.raises(ValueError):
        sinks.export_findings(df, str(tmp_path), "csv", "auditing")


def test_registered_pack_is_evaluated(spark):
    from pyspark.sql import functions as F

    from sitegrain.operators import rules as R

    mine = R.Rule("x.no-footer", "custom", "low", ("title",), "No title at all", "Add one.", lambda r: R.once(F.col("title").isNull(), R.finding(r)))
    R.register_pack("custom", "Custom", [mine])
    R.register_pack("custom", "Custom", [mine])  # again: replaced, not scored twice
    try:
        df = spark.createDataFrame([(1, "https://a.test/", "x")], "page_id bigint, url string, html string")
        assert [r.rule for r in R.rule_rows(df, "x.no-footer").collect()] == ["x.no-footer"]
        from sitegrain.operators import scoring as C

        pages = spark.createDataFrame([(1, "https://a.test/", 200, "text/html", "x")], "page_id bigint, url string, status int, content_type string, html string")
        packs = {r.module: r for r in C.pack_rows(C.audit_markup(pages)).collect()}
        assert packs["custom"].n_findings == 1 and packs["custom"].score < 100
    finally:
        del R.RULES["x.no-footer"], R.PACKS["custom"]


def test_a_request_writes_its_own_facts_only(spark):
    from sitegrain.operators import results as S
    from sitegrain.sources.fixtures import pages_aug

    pages = pages_aug(spark, SF)
    df = S.audited_rows(pages, ["packs"])
    assert df.columns == ["page_id", "ok", "packs", "static_links", "links", "images"]
    assert set(df.schema["links"].dataType.elementType.names) == set(S.LINK_FIELDS)
    assert set(S.audited_rows(pages, ["dashboard"]).columns) - set(df.columns) == {"url", "requested_url", "byte_size", "n_images", "alt", "index", "has_canonical"}
    written = df._jdf.queryExecution().analyzed().output().mkString(" ")
    assert not any(f"{c}#" in written for c in ("headings", "metas", "title", "canonical", "blocks"))
