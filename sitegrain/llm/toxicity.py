"""Toxicity by a subsequence-kernel support vector machine.

Units are words (in lower case, outer marks stripped; three or more letters
standing alone in a row are read as one word). The kernel of two units sums
over their common subsequences of three characters, each weighted by
decay**(length it spans), so gapped and inserted-character spellings stay close; it
is normalised by the units' own kernels. Nyström landmarks turn it into finite
features, on which a squared-hinge SVM is trained in the primal. The expansion
over landmarks is then folded into one weight for each character triple: the
same decision, computed without visiting landmarks. A text's score is that
of its most toxic unit, put through a logistic fitted on labelled texts.

Labels are on documents, not on units: units never seen in clean documents but
in more toxic ones than chance allows start as positive; then units of clean
documents that score high are added as negatives, round by round.

Training draws a bounded sample of labelled rows (``Training``); scoring reads
every whole text. Null and empty texts get the score of a text without units.
Without labels of both kinds every score is 0. Labels given twice: toxic wins.
Null labels or ids are left out. Extra columns are passed through; the
added ones win over columns of the same name.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitegrain.llm.common import Memo, as_text, bounds, chunked, release
from sitegrain.session import materialised

#: Character codes: 0 nothing, a to z, then classes of all others.
ALPHABET, _OTHERS = 48, 21
WINDOW, STRIDE = 16, 8
#: Letters and marks have no character in common, so a run can be read in one way only.
_SPELLED = re.compile(r"(?<!\S)(?:[^\W_][\W_]{1,2}){2,}[^\W_](?!\w)")
_MARKS = ".,;:!?\"'()[]{}<>«»“”‘’…-–—_*#&%$|/\\"


@dataclass(frozen=True)
class Training:
    """Bounds of the sample and the machine's parameters."""

    toxic_docs: int = 6_000
    clean_docs: int = 18_000
    positives: int = 3_000
    negatives: int = 20_000
    landmarks: int = 192
    decay: float = 0.6
    cost: float = 10.0
    rounds: int = 4


def codes(unit: str) -> list[int]:
    return [o - 96 if 97 <= (o := ord(c)) <= 122 else 27 + o % _OTHERS for c in unit]


def windows_of(units: list[str]) -> tuple[list[str], np.ndarray]:
    """Units in windows of at most WINDOW characters, and the owner of each."""
    out, owner = [], []
    for i, u in enumerate(units):
        if len(u) <= WINDOW:
            out.append(u)
            owner.append(i)
        else:
            got = [u[a : a + WINDOW] for a in range(0, len(u) - STRIDE, STRIDE)]
            out += got
            owner += [i] * len(got)
    return out, np.array(owner, np.int64)


def own_kernel(c: np.ndarray, decay: float) -> np.ndarray:
    """Kernel of each row of codes (one length) with itself."""
    m, n = c.shape
    same = (c[:, :, None] == c[:, None, :]) * decay**2
    level = same
    for _ in range(2):
        g = level.copy()
        for a in range(1, n):
            g[:, a] += decay * g[:, a - 1]
        for b in range(1, n):
            g[:, :, b] += decay * g[:, :, b - 1]
        level = np.zeros_like(same)
        level[:, 1:, 1:] = same[:, 1:, 1:] * g[:, :-1, :-1]
    return level.sum((1, 2))


def by_length(units: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, codes) of units of equal length of three and more, in batches."""
    length = np.fromiter(map(len, units), np.int64, len(units))
    for n in np.unique(length[length >= 3]):
        at = np.flatnonzero(length == n)
        for lo in range(0, len(at), 2048):
            part = at[lo : lo + 2048]
            yield part, np.array([codes(units[i]) for i in part], np.int64)


def triples(c: np.ndarray, decay: float) -> Iterator[tuple[float, np.ndarray]]:
    """(weight, triple codes) of all subsequences of three."""
    n = c.shape[1]
    two = {(i, j): c[:, i] * ALPHABET**2 + c[:, j] * ALPHABET for i in range(n) for j in range(i + 1, n - 1)}
    for (i, j), head in two.items():
        for k in range(j + 1, n):
            yield decay ** (k - i + 1), head + c[:, k]


class Machine:
    """Weights of triples, and the logistic over a text's highest decision."""

    def __init__(self, weights: np.ndarray, bias: float, decay: float, slope: float = 1.0, shift: float = 0.0):
        self.weights, self.bias, self.decay, self.slope, self.shift = weights.astype(np.float32), bias, decay, slope, shift

    def decide(self, units: list[str]) -> np.ndarray:
        """Decision of each unit; units under three characters have no subsequence."""
        parts, owner = windows_of(units)
        out = np.zeros(len(parts))
        for at, c in by_length(parts):
            total = np.zeros(len(at), np.float64)
            for w, t in triples(c, self.decay):
                total += w * self.weights[t]
            out[at] = total / np.sqrt(own_kernel(c, self.decay))
        best = np.full(len(units), -np.inf)
        np.maximum.at(best, owner, out)
        return best + self.bias

    def probability(self, decision: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * decision + self.shift, -40, 40)))


def table_of(mark: str, decay: float) -> np.ndarray:
    """Triple weights of the normalised kernel with one landmark."""
    table = np.zeros(ALPHABET**3)
    c = np.array([codes(mark)], np.int64)
    for w, t in triples(c, decay):
        table[t[0]] += w
    return table / math.sqrt(own_kernel(c, decay)[0])


def kernel(units: list[str], tables: np.ndarray, decay: float) -> np.ndarray:
    """Normalised kernel of units (3 to WINDOW characters) and the landmarks of ``tables`` (one column each)."""
    out = np.zeros((len(units), tables.shape[1]))
    for at, c in by_length(units):
        total = np.zeros((len(at), tables.shape[1]), np.float32)
        for w, t in triples(c, decay):
            total += np.float32(w) * tables[t]
        out[at] = total / np.sqrt(own_kernel(c, decay))[:, None]
    return out


def svm(z: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float) -> np.ndarray:
    """Squared-hinge SVM in the primal by Newton steps; the last feature is the bias."""
    x = np.hstack([z, np.ones((len(z), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    for _ in range(30):
        miss = 1 - y * (x @ w)
        on = miss > 0
        a = x[on] * weight[on, None]
        step = np.linalg.solve(ridge + 2 * cost * a.T @ x[on], ridge @ w - 2 * cost * a.T @ (y[on] * miss[on]))
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit_units(positive: dict[str, int], negative: list[str], t: Training) -> Machine:
    """The machine from positive units with counts and a pool of negative ones."""
    units = [u for u in positive if len(u) >= 3]
    pool = [u for u in dict.fromkeys(windows_of([u for u in negative if len(u) >= 3 and u not in positive])[0])]
    known = set(pool)
    # A long unit is a bag of windows: those of negative units go, the machine picks the best of the others.
    pos, owner = windows_of(units)
    kept = [i for i, u in enumerate(pos) if u not in known or len(units[owner[i]]) <= WINDOW]
    pos, owner = [pos[i] for i in kept], owner[kept]
    neg = pool[: 4 * len(pos) + 500]
    half = t.landmarks // 2
    marks = list(dict.fromkeys(pos[:half] + neg[:half]))  # the commonest positives first
    tables = np.empty((ALPHABET**3, len(marks)), np.float32)
    for j, m in enumerate(marks):
        tables[:, j] = table_of(m, t.decay)
    gram = kernel(marks, tables, t.decay)
    value, vector = np.linalg.eigh((gram + gram.T) / 2)
    root = vector * (1 / np.sqrt(np.maximum(value, 1e-6))) * (value > 1e-6)
    k_pos = kernel(pos, tables, t.decay) @ root
    k_neg = kernel(neg, tables, t.decay) @ root
    machine, count = None, np.sqrt(np.array([positive[units[i]] for i in owner], float)) / np.bincount(owner, minlength=len(units))[owner]
    for _ in range(t.rounds):
        z = np.vstack([k_pos, k_neg])
        y = np.concatenate([np.ones(len(pos)), -np.ones(len(neg))])
        weight = np.concatenate([count / count.sum(), np.full(len(neg), 1 / len(neg))]) * 1_000
        w = svm(z, y, weight, t.cost)
        machine = Machine(tables @ (root @ w[:-1]), float(w[-1]), t.decay)
        best = np.full(len(units), -np.inf)
        np.maximum.at(best, owner, got := machine.decide(pos))
        count = np.sqrt(np.array([positive[units[i]] for i in owner], float)) * (got >= best[owner])
        score = machine.decide(pool)
        hard = [pool[i] for i in np.argsort(-score, kind="stable")[:500] if score[i] > -0.8]
        grown = list(dict.fromkeys(neg + hard))
        if len(grown) == len(neg):
            break
        k_neg = np.vstack([k_neg, kernel(grown[len(neg) :], tables, t.decay) @ root])
        neg = grown
    return machine


def units_of(text: str) -> list[str]:
    """The words of a text as units, letters standing alone joined."""
    out = [w.strip(_MARKS) for w in text.lower().split()]
    return out + ["".join(filter(str.isalnum, m[0].lower())) for m in _SPELLED.finditer(text)]


class Scorer:
    """Highest decision of whole texts, through a bounded memo of words."""

    def __init__(self, machine: Machine, memo: int = 400_000):
        self.machine, self.memo = machine, memo
        self.reset()

    def reset(self) -> None:
        self.words, self.value = Memo(), np.zeros(0)

    def highest(self, texts: list[str | None]) -> np.ndarray:
        if len(self.words) > self.memo:
            self.reset()
        parts: list[str] = []
        count = []
        for t in texts:
            before = len(parts)
            if t:
                parts += t.split()
                parts += ["".join(filter(str.isalnum, m[0])) for m in _SPELLED.finditer(t)]
            count.append(len(parts) - before)
        which = np.fromiter(map(self.words.__getitem__, parts), np.int64, len(parts))
        if self.words.new:
            new = [w.lower().strip(_MARKS) for w in self.words.taken()]
            distinct = Memo()
            back = np.fromiter(map(distinct.__getitem__, new), np.int64, len(new))
            self.value = np.concatenate([self.value, self.machine.decide(list(distinct))[back]])
        sizes = np.array(count, np.int64)
        out = np.full(len(texts), self.machine.bias)
        if len(which):
            filled = np.flatnonzero(sizes)
            out[filled] = np.maximum.reduceat(self.value[which], bounds(sizes)[:-1][filled])
        return out


def sample(docs: DataFrame, labels: DataFrame, t: Training) -> DataFrame:
    """(text, toxic) of a bounded sample of labelled rows, different texts only."""
    marked = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64(F.col("doc_id"), F.lit(4))
    chosen = marked.filter("toxic = 1").orderBy(order).limit(t.toxic_docs).union(marked.filter("toxic = 0").orderBy(order).limit(t.clean_docs))
    # Bounded by the two limits above, hence broadcast.
    rows = docs.select("doc_id", "text").filter("text IS NOT NULL").join(F.broadcast(chosen), "doc_id")
    return materialised(rows.groupBy(F.xxhash64("text"), F.length("text")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic"))


def train(docs: DataFrame, labels: DataFrame, t: Training = Training()) -> Machine | None:
    """Fitted machine; ``labels``: doc_id, toxic (0 or 1), the rows that may be learned from."""
    drawn = sample(docs, labels, t)

    def distinct_units(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release("toxicity")
        for b in batches:
            for text, toxic in zip(b["text"], b["toxic"], strict=True):
                units = list({u for u in units_of(text) if len(u) >= 3})
                if units:  # a text of short words has none, and a frame without rows no strings that Arrow takes
                    yield pd.DataFrame({"unit": units, "toxic": np.full(len(units), toxic, np.int32)})

    sums = drawn.groupBy("toxic").count().collect()
    n = {int(r["toxic"]): r["count"] for r in sums}
    if not n.get(1) or not n.get(0):
        return None
    counts = drawn.mapInPandas(distinct_units, "unit string, toxic int").groupBy("unit").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
    counts = materialised(counts)
    never = counts.filter("good = 0 AND bad >= 2").orderBy(F.desc("bad"), "unit").limit(t.positives).collect()
    seen = counts.filter("good > 0").orderBy(F.xxhash64("unit")).limit(t.negatives).collect()
    if not never or not seen:
        return None
    # As often in toxic texts alone as chance would hardly give any of the units.
    chance = math.log(100 * max(counts.count(), 2)) / -math.log(n[1] / (n[0] + n[1]))
    least = min(max(2.0, chance), never[min(len(never), 20) - 1]["bad"])
    positive = {r["unit"]: int(r["bad"]) for r in never if r["bad"] >= least}
    machine = fit_units(positive, [r["unit"] for r in seen], t)

    def maxima(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(machine)
        for b in batches:
            yield pd.DataFrame({"d": scorer.highest(list(b["text"])), "toxic": b["toxic"].to_numpy(np.int32)})

    rows = drawn.mapInPandas(maxima, "d double, toxic int").collect()  # as many as the sample has
    machine.slope, machine.shift = logistic(np.array([r["d"] for r in rows]), np.array([r["toxic"] for r in rows], float))
    return machine


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a ridge-held logistic fit, classes weighted alike."""
    a, w = np.stack([x, np.ones_like(x)], 1), np.array([1.0, 0.0])
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(2), a.T @ (weight * (p - y)) + 1e-2 * w)
        w = w - np.clip(step, -5, 5)
    return float(w[0]), float(w[1])


def scored(df: DataFrame, machine: Machine | None, text: str = "text", threshold: float = 0.7, keep_text: bool = True) -> DataFrame:
    """``df`` with score (0 to 1) and predicted (1 where score >= threshold)."""
    kept = [c for c in df.columns if c not in ("score", "predicted")]
    out_cols = kept if keep_text else [c for c in kept if c != text]
    if machine is None:
        return df.select(*out_cols, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    schema = T.StructType([df.schema[c] for c in out_cols] + [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    shared = df.sparkSession.sparkContext.broadcast(machine)  # one weight for each triple: 0.5 MB

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release("toxicity")
        scorer = Scorer(shared.value)
        for b in batches:
            texts = [as_text(x) for x in b[text]]
            for lo, hi in chunked(texts):
                out = b.iloc[lo:hi][out_cols].copy()
                out["score"] = shared.value.probability(scorer.highest(texts[lo:hi]))
                out["predicted"] = (out["score"] >= threshold).astype(np.int32)
                yield out

    return df.select(*kept).mapInPandas(run, schema)
