"""Exact top-k inner products by the threshold algorithm.

Vectors become integers floor(scale * x). Candidates are dealt into blocks;
in a block every dimension has its list of rows sorted by value. A query walks
the lists in step, from the end that suits the sign of its component, scores
the rows it meets for the first time, and stops once the bound (the sum over
dimensions of query component times the last value read) lies below its k-th
score. What lies at the bound is still read, so ties go to the smaller id.
The blocks' best lists meet in one window over k rows per query and block.

Vectors that are null, empty or hold a null or a non-finite component take no
part (scores are taken to fit a long). A query meets only candidates of
its own number of dimensions. Ids may repeat; a query leaves out every row of
its own id. Null ids take no part. Extra columns are not carried.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of a candidate block and of a query block: 64 dimensions take some 40 MB together.
BLOCK, QUERIES = 32_768, 1_024
#: List entries read before the first test of the bound; doubled after each.
STEP = 8


class Lists:
    """A block's rows and its per-dimension order."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        by_id = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[by_id], rows[by_id]
        self.order = np.argsort(self.rows, axis=0, kind="stable").T.astype(np.int32)  # ascending, one list each
        self.values = np.take_along_axis(self.rows.T, self.order, axis=1)
        top = float(np.abs(self.rows).max(initial=0))
        self.top, self.exact, self.cast = top, {}, self.rows

    def dtype_for(self, query: np.ndarray):
        """The narrowest type in which every sum of products is exact."""
        most = self.top * float(np.abs(query).sum())
        return np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64

    def typed(self, dtype) -> np.ndarray:
        if dtype not in self.exact:
            self.exact[dtype] = self.rows.astype(dtype)
        return self.exact[dtype]

    def search(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(ids, scores) of the k best, and how deep the lists were read."""
        n = len(self.ids)
        dtype = self.dtype_for(query)
        rows, q = self.typed(dtype), query.astype(dtype)
        dims = np.flatnonzero(query)
        up, down = dims[query[dims] > 0], dims[query[dims] < 0]
        seen = np.zeros(n, bool)
        seen[(own := slice(*np.searchsorted(self.ids, [query_id, query_id + 1])))] = True
        left = n - (own.stop - own.start)
        ids = np.zeros(0, np.int64)
        scores = np.zeros(0, np.int64)
        read, step = 0, STEP
        while left > 0:
            upto = min(n, read + step)
            fresh = np.zeros(n, bool)
            if not len(dims):  # no list to read: every score is 0
                upto, fresh[:] = n, True
            else:
                fresh[self.order[up, n - upto : n - read].ravel()] = True
                fresh[self.order[down, read:upto].ravel()] = True
            fresh &= ~seen
            at = np.flatnonzero(fresh)
            seen |= fresh
            left -= len(at)
            if len(at):
                got = rows[at] @ q
                ids, scores = np.concatenate([ids, self.ids[at]]), np.concatenate([scores, got.astype(np.int64)])
                if len(ids) > k:
                    best = np.lexsort((ids, -scores))[:k] if len(ids) < 4 * k else self.best(ids, scores, k)
                    ids, scores = ids[best], scores[best]
            read, step = upto, step * 2
            if read >= n:
                break
            bound = int((self.values[up, n - read] * query[up]).sum() + (self.values[down, read - 1] * query[down]).sum())
            if len(scores) >= k and scores.min() > bound:
                break
        order = np.lexsort((ids, -scores))[:k]
        return ids[order], scores[order], read

    @staticmethod
    def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= kth)
        return near[np.lexsort((ids[near], -scores[near]))[:k]]


def as_integers(df: DataFrame, id_col: str, vector: str, scale: int) -> DataFrame:
    """(vec_id, v array<long>) of the vectors that take part."""
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return df.filter(F.col(id_col).isNotNull() & F.col(vector).isNotNull()).filter(F.coalesce(ok, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("v"))


def top_k(df: DataFrame, queries: DataFrame, k: int, scale: int = 64, id_col: str = "vec_id", vector: str = "embedding", block: int = BLOCK, query_block: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of ``df`` for each row of ``queries``.

    Both sides are dealt into blocks by hash, as many as their counted sizes
    ask for, so a block's size is bounded at every input size. Each query block
    meets each candidate block once.
    """
    rows, asked = as_integers(df, id_col, vector, scale), as_integers(queries, id_col, vector, scale)
    n_blocks = max(1, -(-rows.count() // block))
    n_asked = max(1, -(-asked.count() // query_block))
    deal = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.hash("v"), F.lit(salt)), F.lit(n)).cast("int")
    left = rows.withColumn("b", deal(n_blocks, 1)).withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(n_asked - 1)))).withColumn("dims", F.size("v"))
    right = asked.distinct().withColumn("a", deal(n_asked, 2)).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).withColumn("dims", F.size("v"))

    def search(cands: pd.DataFrame, qs: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(cands) and len(qs):
            lists = Lists(cands["vec_id"].to_numpy(np.int64), np.stack(cands["v"].to_numpy()).astype(np.int64))
            for query_id, v in zip(qs["vec_id"], qs["v"], strict=True):
                ids, scores, _ = lists.search(int(query_id), np.asarray(v, np.int64), k)
                out["query_id"].append(np.full(len(ids), query_id, np.int64))
                out["vec_id"].append(ids)
                out["score"].append(scores)
        return pd.DataFrame({c: np.concatenate(x) if x else np.zeros(0, np.int64) for c, x in out.items()})

    best = (
        left.filter("dims > 0").groupBy("a", "b", "dims").cogroup(right.filter("dims > 0").groupBy("a", "b", "dims"))
        .applyInPandas(search, "query_id long, vec_id long, score long")
    )
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
