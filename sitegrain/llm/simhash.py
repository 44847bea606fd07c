"""SimHash fingerprints and their near-duplicate components.

Fingerprints link at ``max_bits`` (4) or fewer differing bits. Each is mapped
to a point: the bit counts of its 32 two-bit segments. The Manhattan distance
of two points never exceeds the bits in which their fingerprints differ, so
pairs are sought by it: the 32 axes form 7 groups, a distance of at most 4
leaves at least 3 of the groups equal, and so every linked pair meets in one of
the 35 grid cells of each point (3 groups' counts). In a cell the distance of
points is tested first, then the bits. Cells work on distinct fingerprints;
a cell gives a spanning set of its links, not all pairs: members that hang
together already are not compared again. Cells beyond ``cell_rows`` are cut
into blocks and worked through by pairs of blocks, so a task's memory is
bounded whatever a cell holds. Components come from rounds of contraction:
every fingerprint joins its neighbour of least rank, ranks drawn anew each
round, edges are renamed, loops dropped, until no edge is left.

Text without words (null, empty): fingerprint zero, linked like any other.
A component is named by its smallest doc_id; rows without doc_id take the name
of their component (null where no member has an id). Rows may repeat.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegrain.llm.common import as_text, bounds, chunked, release, utf8
from sitegrain.session import materialised

SEED = 42
#: Axes 0..31 in seven groups.
GROUPS = [range(0, 5), range(5, 10), range(10, 15), range(15, 20), range(20, 24), range(24, 28), range(28, 32)]
CELL_ROWS = 20_000
#: Runs up to this long are compared in one sweep over all runs.
SMALL = 8
_ODD = 0x5555555555555555


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


#: One mask over the packed counts (two bits an axis) for each choice of three groups.
MASKS = [_signed(sum(3 << (2 * a) for g in three for a in g)) for three in combinations(GROUPS, 3)]


def fingerprints_of(texts: list[str | None], shingle: int = 4) -> np.ndarray:
    """64-bit fingerprints (as signed numbers) of whole texts."""
    hashes: list[int] = []
    sizes = np.zeros(len(texts), np.int64)
    digest = xxhash.xxh64_intdigest
    for i, t in enumerate(texts):
        words = utf8(t).lower().split()
        if not words:
            continue
        joined = b" ".join(words)
        if len(words) <= shingle:
            hashes.append(digest(joined, SEED))
            sizes[i] = 1
            continue
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        n = len(words) - shingle + 1
        hashes += [digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[shingle - 1 :].tolist(), strict=True)]
        sizes[i] = n
    out = np.zeros(len(texts), np.uint64)
    filled = np.flatnonzero(sizes)
    if len(filled):
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, bounds(sizes[filled])[:-1], axis=0, dtype=np.int32)
        out[filled] = np.packbits(2 * ones > sizes[filled][:, None], axis=1, bitorder="little").view("<u8")[:, 0]
    return out.view(np.int64)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 4, more: str | None = None) -> DataFrame:
    """(doc_id, fp) of every row, and the long column ``more`` if asked for (without nulls)."""
    extra = [more] if more else []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release("simhash")
        for b in batches:
            texts = [as_text(t) for t in b["text"]]
            for lo, hi in chunked(texts, 1 << 20):
                yield pd.DataFrame({"doc_id": b["doc_id"].iloc[lo:hi].to_numpy(), "fp": fingerprints_of(texts[lo:hi], shingle)} | {c: b[c].iloc[lo:hi].to_numpy() for c in extra}).astype({"doc_id": "Int64"})

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"), *extra)
    return rows.mapInPandas(run, "doc_id long, fp long" + "".join(f", {c} long" for c in extra))


def packed_counts(fp):
    """Bit counts of the 32 segments, two bits each (a column, or numpy unsigned numbers)."""
    if isinstance(fp, np.ndarray):
        return (fp & np.uint64(_ODD)) + ((fp >> np.uint64(1)) & np.uint64(_ODD))
    lo, hi = fp.bitwiseAND(F.lit(_ODD)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(_ODD))
    return lo.bitwiseXOR(hi).bitwiseOR(F.shiftleft(lo.bitwiseAND(hi), 1))  # the sum, without a sign overflow


def near(a: np.ndarray, b: np.ndarray, max_bits: int) -> np.ndarray:
    """Which pairs link: Manhattan distance of the counts first, then the bits."""
    ca, cb = packed_counts(a), packed_counts(b)
    odd = np.uint64(_ODD)
    lo, hi = (ca ^ cb) & odd, ((ca ^ cb) >> np.uint64(1)) & odd
    # Counts 0, 1, 2: the low bit differs at distance 1, only the high bit at distance 2.
    distance = np.bitwise_count(lo).astype(np.int16) + 2 * np.bitwise_count(hi & ~lo)
    out = distance <= max_bits
    out[out] = np.bitwise_count(a[out] ^ b[out]) <= max_bits
    return out


def links_in_runs(run: np.ndarray, fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning set of the links inside runs of equal ``run`` (sorted)."""
    edge = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
    size = np.diff(np.append(edge, len(run)))
    of = np.repeat(size, size)
    left, right = [], []
    small = np.flatnonzero((of > 1) & (of <= SMALL))
    for k in range(1, SMALL):
        i = small[small + k < len(run)]
        i = i[run[i] == run[i + k]]
        if not len(i):
            break
        i = i[near(fp[i], fp[i + k], max_bits)]
        left.append(fp[i])
        right.append(fp[i + k])
    for start, n in zip(edge[size > SMALL], size[size > SMALL], strict=True):
        rest = fp[start : start + n]
        while len(rest) > 1:
            front, rest = [rest[0]], rest[1:]
            while front and len(rest):
                at = front.pop()
                hit = near(np.full(len(rest), at), rest, max_bits)
                new = rest[hit]
                if len(new):
                    left.append(np.full(len(new), at))
                    right.append(new)
                    front.extend(new)
                    rest = rest[~hit]
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def links(fps: DataFrame, max_bits: int = 4, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(a, b): links between distinct fingerprints ``fp``, as many as hold components together."""
    assert 0 <= max_bits <= 4, "three of seven groups stay equal up to 4 bits"
    cells = fps.select("fp", packed_counts(F.col("fp")).alias("c")).select("fp", F.posexplode(F.array(*[F.col("c").bitwiseAND(F.lit(m)) for m in MASKS])).alias("mask", "cell"))
    large = cells.groupBy("mask", "cell").agg(F.count("*").alias("n")).filter(F.col("n") > cell_rows).withColumn("parts", F.ceil(F.col("n") / cell_rows).cast("int")).drop("n")
    tagged = (
        cells.join(large, ["mask", "cell"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        .withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
        .withColumn("run", F.xxhash64("mask", "cell", F.least("part", "other"), F.greatest("part", "other")))
        .select("run", "fp")
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release("simhash")
        key, fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def found(key, fp):
            a, b = links_in_runs(key, fp, max_bits)
            return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

        for b in batches:
            key = np.concatenate([key, b["run"].to_numpy(np.int64)])
            fp = np.concatenate([fp, b["fp"].to_numpy(np.int64).view(np.uint64)])
            done = int(np.searchsorted(key, key[-1])) if len(key) else 0
            if done:
                yield found(key[:done], fp[:done])
                key, fp = key[done:], fp[done:]
        if len(key):
            yield found(key, fp)

    return tagged.repartition("run").sortWithinPartitions("run").mapInPandas(run, "a long, b long").distinct()


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge: rounds of contraction with random ranks."""
    del nodes
    edges = materialised(edges.filter("a <> b"))
    steps, turn = [], 0
    while not edges.isEmpty():
        turn += 1
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c, turn=turn: F.struct(F.xxhash64(c, F.lit(turn)).alias("r"), F.col(c).alias("x"))
        to = both.groupBy("a").agg(F.min(rank("b")).alias("m")).select(F.col("a").alias("node"), F.least(F.col("m"), F.struct(F.xxhash64("a", F.lit(turn)).alias("r"), F.col("a").alias("x")))["x"].alias("to"))
        to = materialised(to)
        steps.append(to)
        renamed = edges.join(to.select(F.col("node").alias("a"), F.col("to").alias("ta")), "a").join(to.select(F.col("node").alias("b"), F.col("to").alias("tb")), "b")
        edges = materialised(renamed.filter("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct())
    spark = edges.sparkSession
    if not steps:
        return spark.createDataFrame([], "node long, root long")

    def follow(later: DataFrame, step: DataFrame) -> DataFrame:
        """Nodes of an earlier round sent on by the later rounds."""
        on = later.select(F.col("node").alias("to"), "root")
        return step.join(on, "to", "left").select("node", F.coalesce("root", "to").alias("root"))

    last = steps[-1].select("node", F.col("to").alias("root"))
    return functools.reduce(follow, reversed(steps[:-1]), last)


def _rooted(docs: DataFrame, max_bits: int, cell_rows: int) -> DataFrame:
    """(fp, first, root): every fingerprint of ``docs``, its smallest doc_id, its component."""
    fps = materialised(docs.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(fps, links(fps, max_bits, cell_rows)).withColumnRenamed("node", "fp")
    return fps.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))


def near_components(df: DataFrame, max_bits: int = 4, id_col: str = "doc_id", text: str = "text", shingle: int = 4, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(doc_id, fp, component_id) for every row."""
    docs = materialised(fingerprints(df, id_col, text, shingle))
    rooted = _rooted(docs, max_bits, cell_rows)
    names = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    of_fp = rooted.join(names, "root").select("fp", "component_id")
    return docs.join(of_fp, "fp").select("doc_id", "fp", "component_id")


def keep_one(df: DataFrame, max_bits: int = 4) -> DataFrame:
    """``df`` with one row of each component: of the smallest doc_id the text of least digest.

    Rows that share a doc_id but not a component do not meet. Rows without
    doc_id stay.
    """
    from pyspark.sql.window import Window

    named = df.filter("doc_id IS NOT NULL").withColumn("__t", F.xxhash64("text"))
    pairs = materialised(fingerprints(named, more="__t"))
    rooted = _rooted(pairs, max_bits, CELL_ROWS)
    kept = pairs.join(rooted.select("fp", "root"), "fp").groupBy("root").agg(F.min(F.struct("doc_id", "__t")).alias("m")).select("m.*")
    row = F.row_number().over(Window.partitionBy("doc_id", "__t").orderBy("doc_id"))
    one = named.join(kept, ["doc_id", "__t"]).withColumn("__row", row).filter("__row = 1").select(df.columns)
    return one.union(df.filter("doc_id IS NULL"))
