"""Hard negatives, with bounds handed along a spanning tree of anchors.

Vectors become integers floor(scale * x). Anchors are cut into blocks of
similar ones (by the signs of their first components), candidates into blocks by hash.
Every block of anchors has a minimum spanning tree over Euclidean distances.
In a block of candidates the tree's root scores all of them; from there, a
candidate's score at a parent, plus or minus the length of the edge times the
candidate's norm, bounds its score at the child. Only candidates whose bounds
reach into a window of the child are scored, and their exact scores are what the
child hands on; the others' bounds widen by an edge.

Two rounds: the first finds each anchor's positives, its best rows of the same
label (the window is open above, and closes from below as lower bounds rise); the second
the best rows of other labels within each positive's window,
floor * positive <= ceiling * negative <= ceiling * positive.

A task holds one block of candidates, which are moved once a round, and meets
the blocks of anchors one after the other; only its best rows leave it, and a
window over a few rows per anchor and block ranks them. Anchors are a stated
query set, so every anchor meets every candidate's block.

Rows with a null id, label or vector, or with a null or non-finite component
take no part, nor empty vectors; vectors of different lengths do not meet. Ties
go to the smaller id; rows that share an id are all candidates, and an anchor
leaves out all rows of its own id. An anchor without positives, or a positive
without rows in its window, gives no rows. Scores are taken to fit a long.
Extra columns are not carried. An empty table gives no rows.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sitegrain.llm.ordering import positions
from sitegrain.session import materialised


@dataclasses.dataclass(frozen=True)
class Mining:
    """Positives an anchor and negatives a positive at most, the window in hundredths, and sizes of blocks."""

    positives: int = 5
    negatives: int = 5
    floor: int = 80
    ceiling: int = 100
    block: int = 32_768
    anchors: int = 512
    signs: int = 16


def as_integers(df: DataFrame, scale: int, id_col: str, vector: str, label: str) -> DataFrame:
    """(vec_id, v array<long>, label) of the rows that take part."""
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    known = df.filter(F.col(id_col).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull()).filter(F.coalesce(ok, F.lit(False)) & (F.size(vector) > 0))
    return known.select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("v"), F.col(label).cast("long").alias("label"))


def spanning_tree(rows: np.ndarray) -> list[tuple[int, int, float]]:
    """(child, parent, distance) of a minimum spanning tree of the rows, parents before children; the root has no entry.

    The order visits a node's smaller subtrees first, so few parents wait at a time.
    """
    n = len(rows)
    f = rows.astype(np.float64)
    norms = (f * f).sum(1)
    near, parent, out = np.full(n, np.inf), np.zeros(n, np.int64), [[] for _ in range(n)]
    done = np.zeros(n, bool)
    at, order = 0, []
    for _ in range(n - 1):
        done[at] = True
        d = np.maximum(norms + norms[at] - 2 * (f @ f[at]), 0)
        closer = ~done & (d < near)
        near[closer], parent[closer] = d[closer], at
        at = int(np.argmin(np.where(done, np.inf, near)))
        out[parent[at]].append(at)
        order.append(at)
    size = np.ones(n, np.int64)
    for c in reversed(order):
        size[parent[c]] += size[c]
    tree, stack = [], [0]
    while stack:
        x = stack.pop()
        if x:
            # Distances are taken again, exactly enough to be bounds.
            tree.append((x, int(parent[x]), float(np.sqrt(((f[x] - f[parent[x]]) ** 2).sum()))))
        stack.extend(sorted(out[x], key=lambda c: size[c], reverse=True))
    return tree


class Block:
    """A block of candidates of one length."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, labels: np.ndarray):
        by_id = np.argsort(ids, kind="stable")
        self.ids, self.rows, self.labels = ids[by_id], rows[by_id], labels[by_id]
        f = self.rows.astype(np.float64)
        # A norm a little too long, so that rounding never makes a bound too tight.
        self.norms = np.sqrt((f * f).sum(1)) * (1 + 1e-9) + 1e-9
        self.top = float(np.abs(f).max(initial=0))
        self.floats = f if self.top < 2**53 else None
        self.rescored = 0

    def scores(self, anchor: np.ndarray, at: np.ndarray | slice) -> np.ndarray:
        """Exact inner products; in doubles where every sum is exact."""
        if self.floats is not None and self.top * float(np.abs(anchor.astype(np.float64)).sum()) < 2**53:
            return (self.floats[at] @ anchor.astype(np.float64)).astype(np.int64)
        return self.rows[at] @ anchor

    def visit(self, anchors: np.ndarray, wanted) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(anchor, candidates, exact scores) for those whose bounds ``wanted(anchor, low, high)`` keeps."""
        tree = spanning_tree(anchors)
        children = np.bincount([p for _, p, _ in tree], minlength=len(anchors))
        bounds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for child, parent, edge in [(0, -1, 0.0), *tree]:
            if parent < 0:
                exact = self.scores(anchors[0], slice(None))
                low = exact.astype(np.float64)
                high = low.copy()
                use = np.flatnonzero(wanted(0, low, high))
                found = exact[use]
                self.rescored += len(exact)
            else:
                reach = self.norms * (edge * (1 + 1e-9) + 1e-9)
                low, high = bounds[parent][0] - reach, bounds[parent][1] + reach
                use = np.flatnonzero(wanted(child, low, high))
                found = self.scores(anchors[child], use)
                low[use] = high[use] = found
                self.rescored += len(use)
                children[parent] -= 1
                if not children[parent]:
                    del bounds[parent]
            if children[child]:
                # A score is held as a double, which may be off by its last bit.
                bounds[child] = low - np.abs(low) * 1e-15, high + np.abs(high) * 1e-15
            yield child, use, found


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= kth)
        return near[np.lexsort((ids[near], -scores[near]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def positives_in(block: Block, anchor_ids: np.ndarray, anchors: np.ndarray, labels: np.ndarray, k: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(anchor's place, ids, scores): its k best rows of the same label in the block."""

    def wanted(a: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        fit = (block.labels == labels[a]) & (block.ids != anchor_ids[a])
        sure = low[fit]
        if len(sure) > k:
            fit &= high >= np.partition(sure, len(sure) - k)[len(sure) - k]
        return fit

    out = []
    for a, use, scores in block.visit(anchors, wanted):
        best = _best(block.ids[use], scores, k)
        out.append((a, block.ids[use][best], scores[best]))
    return out


def negatives_in(block: Block, anchor_ids: np.ndarray, anchors: np.ndarray, labels: np.ndarray, windows: list[np.ndarray], m: Mining) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """(anchor's place, positive score, ids, scores): the best rows of other labels in each window of an anchor."""

    def wanted(a: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        fit = np.zeros(len(low), bool)
        other = (block.labels != labels[a]) & (block.ids != anchor_ids[a])
        for p in windows[a]:
            least, most, off = m.floor * float(p) / m.ceiling, float(p), 1 + abs(float(p)) * 1e-12
            inside = other & (high >= least - off) & (low <= most + off)
            sure = low[other & (low >= least + off) & (high <= most - off)]
            if len(sure) > m.negatives:
                inside &= high >= np.partition(sure, len(sure) - m.negatives)[len(sure) - m.negatives]
            fit |= inside
        return fit

    out = []
    for a, use, scores in block.visit(anchors, wanted):
        for p in windows[a]:
            least = -(-m.floor * int(p) // m.ceiling)  # floor * p <= ceiling * score, without products of scores
            inside = np.flatnonzero((scores >= least) & (scores <= int(p)))
            best = inside[_best(block.ids[use][inside], scores[inside], m.negatives)]
            out.append((a, int(p), block.ids[use][best], scores[best]))
    return out


def _round(candidates: DataFrame, anchors: DataFrame, blocks: int, work) -> DataFrame:
    """Every block of candidates meets all blocks of anchors: (q, dims, window, id, score) as ``work`` finds them.

    Rows of a candidate block come first in its partition, then the anchors
    block by block; a task holds one of each at a time.
    """
    deal = F.pmod(F.xxhash64("vec_id", F.hash("v")), F.lit(blocks)).cast("int").alias("b")
    candidate = [F.lit(-1).cast("long").alias(c) for c in ("a", "q")]  # before all blocks of anchors
    left = candidates.select(deal, F.size("v").alias("dims"), *candidate, "vec_id", "v", "label", F.array().cast("array<long>").alias("windows"))
    right = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"), "dims", "a", "q", "vec_id", "v", "label", "windows")
    rows = left.unionByName(right).repartition(blocks, "b").sortWithinPartitions("b", "dims", "a")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        at: tuple = ()
        block: tuple = ()

        def finished() -> pd.DataFrame | None:
            nonlocal block
            df = pd.concat(held, ignore_index=True)
            held.clear()
            v = np.stack(df["v"].to_numpy()).astype(np.int64)
            ids, labels = df["vec_id"].to_numpy(np.int64), df["label"].to_numpy(np.int64)
            if at[2] < 0:
                block = (at[:2], Block(ids, v, labels))
                return None
            if not block or block[0] != at[:2]:
                return None  # no candidates of this length here
            q = df["q"].to_numpy(np.int64)
            found = [(np.full(len(i), q[a]), np.full(len(i), w), i, s) for a, w, i, s in work(block[1], ids, v, labels, list(df["windows"])) if len(i)]
            if not found:
                return None
            q, w, i, s = (np.concatenate(c) for c in zip(*found, strict=True))
            return pd.DataFrame({"q": q, "dims": np.full(len(q), at[1], np.int32), "window": w, "id": i, "score": s})

        for df in frames:
            for k, part in df.groupby(["b", "dims", "a"], sort=False):
                if held and k != at:
                    if (out := finished()) is not None:
                        yield out
                at = k
                held.append(part)
        if held and (out := finished()) is not None:
            yield out

    return rows.mapInPandas(run, "q long, dims int, window long, id long, score long")


def _ranked(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, anchors: DataFrame, mining: Mining = Mining()) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for rows and anchors (vec_id, v, label)."""
    m = mining
    rows = materialised(rows)
    blocks = max(1, -(-rows.count() // m.block))
    sign = F.aggregate(F.slice("v", 1, m.signs), F.lit(0).cast("long"), lambda acc, x: acc * 2 + (x > 0).cast("long"))
    asked = anchors.distinct().select(F.size("v").alias("dims"), sign.alias("sign"), "vec_id", "v", "label", F.xxhash64("v").alias("same"))
    asked = positions(materialised(asked), ["dims"], ["sign", "vec_id", "label", "same"])
    asked = materialised(asked.select("dims", F.expr(f"pos div {m.anchors}").alias("a"), F.col("pos").alias("q"), "vec_id", "v", "label"))

    def first(block, ids, v, labels, _):
        return ((a, 0, i, s) for a, i, s in positives_in(block, ids, v, labels, m.positives))

    def second(block, ids, v, labels, windows):
        return negatives_in(block, ids, v, labels, windows, m)

    none = F.array().cast("array<long>")
    positives = materialised(_ranked(_round(rows, asked.withColumn("windows", none), blocks, first), ["dims", "q"], m.positives))
    windows = positives.groupBy("dims", "q").agg(F.collect_set("score").alias("windows"))
    found = _ranked(_round(rows, asked.join(windows, ["dims", "q"]), blocks, second), ["dims", "q", "window"], m.negatives)
    pairs = positives.join(asked.select("dims", "q", F.col("vec_id").alias("anchor_id")), ["dims", "q"])
    pairs = pairs.select("dims", "q", "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("window"))
    return pairs.join(found, ["dims", "q", "window"]).select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), F.col("window").alias("positive_score"), F.col("score").alias("negative_score")
    )
