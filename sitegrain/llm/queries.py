"""The registered queries of this subpackage, one for each operator, and their SQL."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegrain.llm import linedup, lmscore, mainhtml, merkle, mixing, negatives, packing, pieces, repetition, simhash, topk, toxicity, urlfilter
from sitegrain.llm.common import ship

QUERIES = {}
ORACLE = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _encoded(v: pieces.Vocabulary, text: str | None, ids: np.ndarray) -> tuple[int, bool]:
    return zlib.crc32(ids.astype("<u4").tobytes()), v.decode(ids) == (text or "")


@_query
def op1_sentencepiece_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four best segmentations of every document, each decoded again."""
    return pieces.encode_n_best(_table(spark, sf_dir, "documents"), 4, value=("ids_crc32 long, round_trip boolean", _encoded))


URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


@_query
def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's URL."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urlfilter.filter_urls(_table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


ORACLE["op2_url_filter"] = """
WITH parts AS (
  SELECT page_id, translate(regexp_extract(url, '(?s)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(url, '(?s)://[^/?#]*([^?#]*)', 1) AS path, row_number() OVER () AS n
  FROM pages),
rules(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fits AS (
  SELECT n, max(struct_pack(k := length(h || p), l := length(h), r := h || p, v := v)) AS b
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY n)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, b.r AS rule, coalesce(b.v, 'allow') AS verdict
FROM parts LEFT JOIN fits USING (n)
"""


@_query
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's worded lines and the numbers of the lines it loses."""
    found = linedup.line_verdicts(_table(spark, sf_dir, "documents"))
    doc = F.when(F.col("d") < linedup.LAST, F.col("d")).alias("doc_id")
    return found.select(doc, "n_lines", F.size("removed").cast("long").alias("n_removed"), "removed")


@_query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; a third of ids is held out from training."""
    fold = F.crc32(F.col("doc_id").cast("string")) % 3
    docs = _table(spark, sf_dir, "documents")
    machine = toxicity.train(docs, _table(spark, sf_dir, "labels").filter(fold != 1))
    rows = docs.select("doc_id", "text", F.coalesce(fold == 1, F.lit(False)).alias("held_out"))
    return toxicity.scored(rows, machine, keep_text=False)


@_query
def op5_suffix_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of the repetition rules for every document."""
    return repetition.rated(_table(spark, sf_dir, "documents").select("doc_id", "text"))


@_query
def op6_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's masked pseudo-likelihood under a model of all documents."""
    docs = _table(spark, sf_dir, "documents")
    return lmscore.scored(docs, lmscore.train(docs))


@_query
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into windows of 4,096 tokens."""
    return packing.pack(_table(spark, sf_dir, "documents"), value=packing.IDS_CRC32)


@_query
def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return mainhtml.extracted(pages, mainhtml.train(pages))


@_query
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_components(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@_query
def op10_threshold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best inner products for every twentieth vector."""
    rows = _table(spark, sf_dir, "embeddings")
    return topk.top_k(rows, rows.filter("vec_id % 20 = 0"), 20)


ORACLE["op10_threshold_topk"] = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE list_count(embedding) = len(embedding) AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 20
"""


@_query
def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words the mix of all sources takes of every document."""
    return mixing.taken(mixing.mixed(_table(spark, sf_dir, "documents")))


# What a document gives depends on its source's permutation alone, not on the shards' draws.
ORACLE["op11_mixing"] = """
WITH RECURSIVE docs AS (
  SELECT doc_id, source, row_number() OVER () AS r, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
sources AS MATERIALIZED (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM docs GROUP BY source),
rates(i, rate, last_rate) AS (
  SELECT 0, CAST(0 AS DOUBLE), CAST(-1 AS DOUBLE)
  UNION ALL SELECT i + 1, (1.5::DOUBLE * sum(source_size) - coalesce(sum(CASE WHEN 2 * source_size < weight * rate THEN 2 * source_size END), 0)) / sum(CASE WHEN 2 * source_size < weight * rate THEN 0 ELSE weight END), rate
  FROM rates, sources WHERE rate <> last_rate GROUP BY i, rate),
targets AS (SELECT *, least(CAST(2 * source_size AS DOUBLE), weight * (SELECT max_by(rate, i) FROM rates)) AS target FROM sources),
sized AS (SELECT *, source_size // 256 AS whole, (source_size + 255) // 256 AS per_round, CAST(floor(target + 0.5) AS BIGINT) % source_size AS rest, CAST(floor(target + 0.5) AS BIGINT) // source_size AS rounds FROM targets WHERE source_size > 0),
turns AS (
  SELECT sid, turn, list_transform(range(24), lambda r: struct_pack(
    k := CAST(concat('0x', substr(md5(concat('0|', sid, '|', turn, '|', r)), 1, 10)) AS BIGINT), a := CAST(concat('0x', substr(md5(concat('0|', sid, '|', turn, '|', r)), 11, 10)) AS BIGINT), b := CAST(concat('0x', substr(md5(concat('0|', sid, '|', turn, '|', r)), 21, 10)) AS BIGINT))) AS keys
  FROM sized, (SELECT unnest([0, 1]) AS turn)),
slots AS (SELECT *, unnest(range(rounds * per_round + (rest + 255) // 256)) AS k FROM sized),
placed AS (
  SELECT s.sid, k % per_round AS p, whole, keys, CASE WHEN k = rounds * per_round + (rest + 255) // 256 - 1 AND rest % 256 > 0 THEN rest % 256 ELSE 256 END AS words
  FROM slots s JOIN turns t ON t.sid = s.sid AND t.turn = k // per_round),
blocks AS (
  SELECT sid, words, CASE WHEN p < whole THEN list_reduce(list_prepend(p, range(24)), lambda x, r: CASE WHEN
    ((((greatest(x, (keys[r + 1].k % whole + whole - x) % whole) & 1048575) * (keys[r + 1].a * 2 + 1) + (greatest(x, (keys[r + 1].k % whole + whole - x) % whole) >> 20) * (keys[r + 1].b * 2 + 1) + keys[r + 1].k) >> 40) & 1) = 1
    THEN (keys[r + 1].k % whole + whole - x) % whole ELSE x END) ELSE p END AS block
  FROM placed),
laid AS (SELECT docs.*, t.sid, t.source_size, t.target, CAST(coalesce(sum(size) OVER (PARTITION BY t.sid ORDER BY doc_id NULLS FIRST, size, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM docs JOIN targets t ON docs.source IS NOT DISTINCT FROM t.source),
pieces AS (SELECT r, sid, before, size, unnest(range(before // 256, (before + size - 1) // 256 + 1)) AS block FROM laid WHERE size > 0),
cut AS (SELECT r, sid, block, greatest(before, block * 256) - block * 256 AS at_, least(before + size, block * 256 + 256) - greatest(before, block * 256) AS length FROM pieces),
sums AS (SELECT r, sum(greatest(0, least(length, words - at_))) AS taken FROM cut JOIN blocks USING (sid, block) GROUP BY 1)
SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM laid LEFT JOIN sums USING (r)
"""


@_query
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five hard negatives for the five positives of every hundredth vector; a seventh of the labels is moved."""
    rows = _table(spark, sf_dir, "embeddings")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    whole = negatives.as_integers(rows, 256, "vec_id", "embedding", "label")
    return negatives.hard_negatives(whole, whole.filter("vec_id % 100 = 0"))


ORACLE["op12_hard_negatives"] = """
WITH whole AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND list_count(embedding) = len(embedding) AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_sum(list_transform(list_zip(a.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM whole a JOIN whole c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id),
positives AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS k FROM scored WHERE same) WHERE k <= 5),
negatives AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) AS rank,
    n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
  FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= 5
"""


@_query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, proof and root of every document; half of them are tampered with and checked again."""
    docs = _table(spark, sf_dir, "documents")
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    changed = merkle.leaf_digest(docs, fields, {"text": F.replace("text", F.lit("\n"), F.lit(""))})
    met = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    found = merkle.manifest(docs, fields, "source", "doc_id", {"doc_id": F.col("doc_id"), "changed": F.when(met, changed)})
    found = found.withColumn("folded_root", merkle.folded(F.coalesce("changed", "digest"), F.col("proof")))
    return found.select(
        "doc_id", merkle.shown(F.col("digest")).alias("leaf"), merkle.shown(F.col("subroot")).alias("subroot"), merkle.shown(F.col("root")).alias("root"),
        merkle.proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == merkle.shown(F.col("root"))).alias("verified"),
    )


ORACLE["op13_merkle_manifest"] = """
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
fields AS (
  SELECT doc_id, coalesce(concat('=', source), '-') AS key, text, list_transform([CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars AS VARCHAR)], lambda v: CASE WHEN v IS NULL THEN '-' ELSE concat(strlen(v), ':', v) END) AS f,
    coalesce(xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 2 = 0, false) AS met
  FROM documents, crc),
texts AS (SELECT *, unnest([text, CASE WHEN met THEN replace(text, chr(10), '') ELSE text END]) AS x, unnest([0, 1]) AS which, row_number() OVER () AS r FROM fields),
hashed AS (SELECT r, doc_id, key, which, sha256(concat(array_to_string(f, ''), CASE WHEN x IS NULL THEN '-' ELSE concat(strlen(x), ':', x) END)) AS h FROM texts),
both_ AS (SELECT any_value(doc_id) AS doc_id, any_value(key) AS key, min(h) FILTER (which = 0) AS leaf, min(h) FILTER (which = 1) AS shown FROM hashed GROUP BY r),
leaves AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY key) AS n FROM both_),
lv(key, l, pos, n, h) AS (
  SELECT key, 0, pos, n, leaf FROM leaves
  UNION ALL SELECT key, l + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM lv WHERE n > 1 GROUP BY key, l, pos // 3, n),
subs AS MATERIALIZED (SELECT key, h AS subroot, row_number() OVER (ORDER BY key) - 1 AS pos, count(*) OVER () AS n FROM lv WHERE n = 1),
up(l, pos, n, h) AS (
  SELECT 0, pos, n, subroot FROM subs
  UNION ALL SELECT l + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM up WHERE n > 1 GROUP BY l, pos // 3, n),
nodes AS MATERIALIZED (SELECT key, l, pos, n, h FROM lv UNION ALL SELECT '', 1000 + l, pos, n, h FROM up),
steps AS (
  SELECT a.key, a.l, a.pos, concat(coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), ''), '|', coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '')) AS s
  FROM nodes a JOIN nodes b ON a.key = b.key AND a.l = b.l AND a.pos // 3 = b.pos // 3 WHERE a.n > 1 GROUP BY 1, 2, 3),
paths AS (
  SELECT key, pos, list(s ORDER BY l) AS path FROM (
    SELECT f.key, f.pos, t.l, t.s FROM leaves f JOIN steps t ON t.key = f.key AND t.l < 1000 AND t.pos = f.pos // CAST(3 ** t.l AS BIGINT)
    UNION ALL SELECT f.key, f.pos, t.l, t.s FROM leaves f JOIN subs USING (key) JOIN steps t ON t.l >= 1000 AND t.key = '' AND t.pos = subs.pos // CAST(3 ** (t.l - 1000) AS BIGINT)) GROUP BY 1, 2),
whole AS (SELECT doc_id, leaf, shown, subroot, (SELECT h FROM up WHERE n = 1) AS root, coalesce(path, []) AS path FROM leaves JOIN subs USING (key) LEFT JOIN paths ON paths.key = leaves.key AND paths.pos = leaves.pos),
folded AS (SELECT *, list_reduce(list_prepend(shown, path), lambda a, s: sha256(concat(split_part(s, '|', 1), a, split_part(s, '|', 2)))) AS folded_root FROM whole)
SELECT doc_id, leaf, subroot, root, sha256(replace(array_to_string(path, ''), '|', '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM folded
"""
