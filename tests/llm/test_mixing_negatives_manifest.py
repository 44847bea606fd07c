"""Mixing, hard negatives and the Merkle manifest against plain versions on small tables."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

import __spark_entry__ as entry
from check import _rows
from sitegrain.llm import merkle, mixing, negatives
from sitegrain.llm.common import ship
from sitegrain.llm.ordering import positions

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, pos int, key string, digest string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark, n=120, seed=3):
    """Texts of no word to some hundred, a hot source, a null one, nulls, and columns with names used inside."""
    rng = random.Random(seed)
    words = ["a", "bé", "c d", "漢字", "e"]
    rows = []
    for i in range(n):
        text = "".join(rng.choice(words) + rng.choice([" ", "\n", "\t\n", "  "]) for _ in range(rng.choice([0, 1, 5, 40, 300])))
        source = rng.choice(["hot"] * 6 + ["", "Z", "a", "é", None])
        rows.append((i, rng.choice([text, text, text, None]), rng.choice(["en", None]), source, rng.choice([i, None]), 1, "k", "d"))
    rows += [(None, "no id\n", None, "hot", None, 2, "k", "d")] + [rows[5]] * 2
    return spark.createDataFrame(rows, DOCS).repartition(5)


# --- positions ---------------------------------------------------------------


def test_positions_count_and_sum_within_groups(spark):
    df = documents(spark).withColumn("size", mixing.word_count(F.col("text")))
    got = positions(df.select("source", "doc_id", "size", "text"), ["source"], ["doc_id", "text"], "size").collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.source].append(r)
    for rows in by.values():
        rows.sort(key=lambda r: r.pos)
        assert [r.pos for r in rows] == list(range(len(rows))) and {r.n for r in rows} == {len(rows)}
        assert [r.before for r in rows] == [sum(x.size for x in rows[:i]) for i in range(len(rows))]
        ids = [(r.doc_id is not None, r.doc_id or 0) for r in rows]
        assert ids == sorted(ids)


# --- mixing ------------------------------------------------------------------


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, held = 1.5 * sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in held]
        rate = (total - sum(2 * sizes[s] for s in held)) / sum(weight[s] for s in free) if free else 0.0
        more = {s for s in free if 2 * sizes[s] < weight[s] * rate}
        if not more:
            return order, {s: 2.0 * sizes[s] if s in held else weight[s] * rate for s in order}
        held |= more


def brute_permuted(x, n, sid, turn, rounds=24):
    for r in range(rounds):
        d = hashlib.md5(f"0|{sid}|{turn}|{r}".encode()).hexdigest()
        k, a, b = (int(d[10 * i : 10 * i + 10], 16) for i in range(3))
        other = (k % n + n - x) % n
        far = max(x, other)
        if ((far % (1 << 20)) * (2 * a + 1) + (far >> 20) * (2 * b + 1) + k) >> 40 & 1:
            x = other
    return x


def brute_mix(rows, block):
    sizes = collections.Counter()
    for r in rows:
        sizes[r.source] += len(WORD.findall(r.text or ""))
    order, target = brute_targets(dict(sizes))
    out = []
    for sid, s in enumerate(order):
        # Rows that share an id lie side by side; equal ones take their parts in any order.
        size, use = sizes[s], collections.Counter()
        left, k = int(target[s] + 0.5), 0
        while left > 0:
            turn, at = divmod(k, -(-size // block))
            if at < size // block:
                at = brute_permuted(at, size // block, sid, turn)
            run = range(at * block, min(size, (at + 1) * block))[:left]
            use.update(run)
            left, k = left - len(run), k + 1
        at = 0
        for r in sorted((r for r in rows if r.source == s), key=lambda r: (r.doc_id is not None, r.doc_id or 0)):
            n = len(WORD.findall(r.text or ""))
            out.append((str(r.doc_id), n, size, round(target[s], 6), sum(use[i] for i in range(at, at + n))))
            at += n
    return sorted(out)


@pytest.mark.parametrize(("block", "shard"), [(16, 8), (256, 4096)])
def test_mix_equals_brute_force(spark, block, shard):
    df = documents(spark)
    mix = mixing.Mix(block=block, shard=shard)
    got = [(str(r.doc_id), r.size, r.source_size, round(r.target, 6), r.taken) for r in mixing.taken(mixing.mixed(df, mix)).collect()]
    assert sorted(got) == brute_mix(df.collect(), block)
    again = mixing.taken(mixing.mixed(df.repartition(3), mix)).collect()
    assert sorted((str(r.doc_id), r.size, r.source_size, round(r.target, 6), r.taken) for r in again) == sorted(got)
    assert all(t <= 2 * n for _, n, _, _, t in got)


def test_mixed_shards_hold_the_words(spark):
    df = documents(spark).filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    m = mixing.mixed(df, mixing.Mix(block=16, shard=8), with_text=True)
    texts = {(r.sid, r.pos): WORD.findall(r.text or "") for r in m.docs.join(df.select("doc_id", "text"), "doc_id").collect()}
    spans = m.spans.collect()
    for r in spans:
        assert WORD.findall(r.text) == texts[r.sid, r.pos][r.start : r.start + r.length]
    slots = {(r.sid, r.k): r.shard for r in spans}
    held = collections.Counter(slots.values())
    last = max(held)
    assert all(held[s] == 8 for s in range(last)) and 0 < held[last] <= 8  # every shard is full, the last may not be
    by_shard = collections.Counter((shard, sid) for (sid, _), shard in slots.items())
    hot = collections.Counter(sid for sid, _ in slots).most_common(1)[0][0]
    assert len({by_shard[s, hot] for s in range(last)}) > 2  # drawn, not dealt evenly


@pytest.mark.parametrize("n", [1, 2, 3, 64, 1000])
def test_permutation_is_one_to_one(spark, n):
    keys = F.expr("transform(sequence(0, 23), r -> named_struct('k', conv(substring(md5(string(r)), 1, 10), 16, 10)::bigint, 'a', conv(substring(md5(string(r)), 11, 10), 16, 10)::bigint, 'b', 7L * r))")
    got = [r[0] for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), keys)).collect()]
    assert sorted(got) == list(range(n)) and (n < 64 or sum(a == b for a, b in enumerate(got)) < n / 8)


def test_mix_edge_tables(spark):
    df = documents(spark)
    assert mixing.taken(mixing.mixed(df.limit(0))).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, " \n", None)], "doc_id long, text string, source string")
    assert sorted((r.doc_id, r.size, r.target, r.taken) for r in mixing.taken(mixing.mixed(blank)).collect()) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]
    long = spark.createDataFrame([(1, "w " * 1_000_000, "a")], "doc_id long, text string, source string")
    assert mixing.taken(mixing.mixed(long)).first().taken == 1_500_000


# --- hard negatives ----------------------------------------------------------


def brute_negatives(rows, is_anchor):
    out = []
    for a_id, a_v, a_label in {(i, tuple(v), lab) for i, v, lab in rows if is_anchor(i)}:
        score = lambda v: sum(x * y for x, y in zip(a_v, v, strict=True))
        met = [(-score(v), i, lab) for i, v, lab in rows if i != a_id and len(v) == len(a_v)]
        best = sorted((s, i) for s, i, lab in met if lab == a_label)[:5]
        for s, i in best:
            inside = sorted((t, j) for t, j, lab in met if lab != a_label and 80 * -s <= 100 * -t <= 100 * -s)[:5]
            out += [(a_id, i, r, j, -s, -t) for r, (t, j) in enumerate(inside, 1)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["spread", "clustered", "ties", "large"])
def test_negatives_equal_brute_force(spark, kind):
    ship(spark)
    rng = np.random.default_rng(len(kind))
    v = rng.integers(-20, 20, (150, 6))
    if kind == "clustered":
        v = rng.integers(-200, 200, (5, 6))[rng.integers(0, 5, 150)] + rng.integers(0, 3, (150, 6))
    if kind == "ties":
        v = np.repeat(rng.integers(0, 3, (10, 6)), 15, 0)
    if kind == "large":
        v = v.astype(np.int64) * 30_000_000 + rng.integers(0, 9, (150, 6))
    rows = [(i % 140, [int(x) for x in r[: 6 if i % 11 else 3]], int(rng.integers(0, 3))) for i, r in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>, label long").repartition(3)
    for mining in (negatives.Mining(block=40, anchors=7), negatives.Mining()):
        got = negatives.hard_negatives(df, df.filter("vec_id % 4 = 0"), mining).collect()
        assert sorted(tuple(r) for r in got) == brute_negatives(rows, lambda i: i % 4 == 0)


def test_negatives_equal_sql_and_take_no_broken_rows(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS FROM '{SF}/embeddings.parquet'")
    rel = con.sql(entry.oracle_sql()["op12_hard_negatives"])
    df = entry.queries()["op12_hard_negatives"](spark, SF)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(rel.columns, rel.fetchall())
    bad = spark.createDataFrame(
        [(None, [1.0], 1), (1, None, 1), (2, [1.0, None], 1), (3, [float("nan")], 1), (4, [float("-inf")], 1), (5, [1.0], None), (6, [], 1), (7, [-0.5], 1)],
        "vec_id long, embedding array<float>, label int",
    )
    whole = negatives.as_integers(bad, 256, "vec_id", "embedding", "label")
    assert [(r.vec_id, r.v) for r in whole.collect()] == [(7, [-128])]
    assert negatives.hard_negatives(whole, whole).count() == 0 == negatives.hard_negatives(whole.limit(0), whole.limit(0)).count()


def test_bounds_hold_and_spare_scores():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 16))
    rows = np.floor(256 * (centres[rng.integers(0, 20, 4000)] + rng.normal(scale=0.02, size=(4000, 16)))).astype(np.int64)
    block = negatives.Block(np.arange(4000), rows, np.zeros(4000, np.int64))
    anchors = rows[::40]
    assert len({c for c, _, _ in negatives.spanning_tree(anchors)}) == len(anchors) - 1
    spared = 0

    def wanted(a, low, high):
        exact = rows @ anchors[a]
        assert (low <= exact).all() and (exact <= high).all()
        return high >= 0.9 * exact.max()

    for a, use, scores in block.visit(anchors, wanted):
        assert (scores == rows[use] @ anchors[a]).all()
        spared += len(rows) - len(use)
    assert block.rescored < 0.7 * anchors.shape[0] * len(rows) and spared > 0


# --- manifest ----------------------------------------------------------------


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_leaf(r, text, columns=("doc_id", "source", "lang", "n_chars")):
    return sha(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (*(r[c] for c in columns), text)))


def brute_tree(level):
    proofs, at = [[] for _ in level], list(range(len(level)))
    while len(level) > 1:
        for i, w in enumerate(at):
            run = level[w // 3 * 3 : w // 3 * 3 + 3]
            proofs[i].append(("".join(run[: w % 3]), "".join(run[w % 3 + 1 :])))
        at, level = [w // 3 for w in at], [sha(*level[i : i + 3]) for i in range(0, len(level), 3)]
    return level[0], proofs


def brute_manifest(rows):
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r.source].append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        mine = sorted(groups[s], key=lambda r: (r.doc_id is not None, r.doc_id or 0, brute_leaf(r, r.text)))
        leaves = [brute_leaf(r, r.text) for r in mine]
        trees[s] = (mine, leaves, *brute_tree(leaves))
    root, above = brute_tree([trees[s][2] for s in names])
    out = []
    for s, top in zip(names, above, strict=True):
        mine, leaves, sub, proofs = trees[s]
        for r, leaf, proof in zip(mine, leaves, proofs, strict=True):
            path = proof + top
            met = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 2 == 0 and r.text is not None
            x = brute_leaf(r, r.text.replace("\n", "")) if met else leaf
            for before, after in path:
                x = sha(before, x, after)
            out.append((str(r.doc_id), leaf, sub, root, sha(*(a + b for a, b in path)), x, x == root))
    return sorted(out)


def manifest_of(spark, df, tmp_path):
    path = str(tmp_path / f"sf{random.random()}")
    df.write.parquet(f"{path}/documents.parquet")
    rows = entry.queries()["op13_merkle_manifest"](spark, path).collect()
    return sorted((str(r.doc_id), *tuple(r)[1:]) for r in rows)


def test_manifest_equals_brute_force(spark, tmp_path):
    df = documents(spark)
    got = manifest_of(spark, df, tmp_path)
    assert got == brute_manifest(df.collect())
    assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("n", [0, 1, 2, 4])
def test_small_manifests(spark, tmp_path, n):
    df = spark.createDataFrame([(i, "x\ny", None, "s", 3) for i in range(n)], "doc_id long, text string, lang string, source string, n_chars long")
    got = manifest_of(spark, df, tmp_path)
    assert got == (brute_manifest(df.collect()) if n else [])


@pytest.mark.parametrize("fanout", [2, 5])
def test_other_fanouts_prove_their_leaves(spark, fanout):
    df = documents(spark)
    found = merkle.manifest(df, ["doc_id", "text"], "source", "doc_id", {"digest_of": F.col("digest")}, fanout)
    rows = found.select(merkle.folded(F.col("digest"), F.col("proof")).alias("x"), merkle.shown(F.col("root")).alias("root"), F.max(F.size(F.element_at("proof", 1)["left"])).over(Window.partitionBy()).alias("most")).collect()
    assert len(rows) == df.count() and all(r.x == r.root for r in rows) and rows[0].most == fanout - 1
