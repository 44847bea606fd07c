"""Documents scored by masked pseudo-likelihood.

A network sees the two words before and the two after a place and predicts the
word there, in two levels. Embeddings of the four words and a hidden layer give
a softmax over 64 word classes (from a word's last two bytes) and, by a fixed
projection of the hidden layer, the shares of ``gates`` experts. Each expert has
its own distribution over the words of every class, so which word of the class
it is depends on both sides too. The experts' parameters are a Spark table with
one row for each different word of the corpus, keyed by the word's 64-bit
digest: it grows with the vocabulary. A document's score is the sum over its
places of the log-probability.

Training takes ``rounds`` passes over all of the corpus: stretches of
``stretch`` places each train the network by Adam steps in numpy, from one
start; Spark averages the weights, weighted by places, and the next round starts
from the average. One more pass counts every word for the expert of the largest
share at its place (mostly zeros, so the table packs well). What
the driver holds is the network, the experts' totals and the cells below.
For scoring, documents are cut into parts of bounded size, and each part is
handed the rows of its own words.

An expert's distribution is smoothed by that of all of them; words that the
corpus does not have share the mass of Witten and Bell in their class, by the
counts of the hashed cell they fall into. Embedding rows of context words are
hashed as well (64 for each class).

Null and empty texts: no places, score 0, no mean. An empty corpus gives a
uniform model. Rows may repeat; extra columns are not carried.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegrain.llm.common import as_text, bounds, chunked, hashed_words, utf8
from sitegrain.session import materialised

#: Characters of a part, and rows of words that a task holds at once.
PART, HELD = 16 << 20, 400_000
#: Places worked on at once, so that what is made of them stays near the processor.
BLOCK = 2048
#: Steps from where a digest's top bits point to, before the rest is found by halving.
STEPS = 16


@dataclass(frozen=True)
class Shape:
    classes: int = 64
    per_class: int = 1024
    #: Rows of the embedding for each class, and its width.
    inputs: int = 64
    width: int = 8
    hidden: int = 16
    side: int = 2
    rate: float = 0.01
    batch: int = 4096
    rounds: int = 2
    #: Places that train one set of weights before they are averaged.
    stretch: int = 2_000_000
    gates: int = 8
    #: Weight of all experts' distribution in that of one.
    prior: float = 64.0

    @property
    def parts(self) -> list[tuple[int, ...]]:
        """Embedding (its last row: outside the text), two layers with their biases."""
        return [(self.classes * self.inputs + 1, self.width), (2 * self.side * self.width, self.hidden), (self.hidden,), (self.hidden, self.classes), (self.classes,)]

    def start(self) -> list[np.ndarray]:
        rng = np.random.default_rng(7)
        return [(rng.normal(0, 0.3, s) if len(s) == 2 else np.zeros(s)).astype(np.float32) for s in self.parts]

    def projection(self) -> np.ndarray:
        return np.random.default_rng(11).normal(0, 1, (self.hidden, self.gates)).astype(np.float32)

    def flat(self, weights: list[np.ndarray]) -> np.ndarray:
        return np.concatenate([w.ravel() for w in weights])

    def shaped(self, flat: np.ndarray) -> list[np.ndarray]:
        at = bounds([int(np.prod(s)) for s in self.parts])
        return [flat[a:b].reshape(s).astype(np.float32) for a, b, s in zip(at[:-1], at[1:], self.parts, strict=True)]


def places(texts: list[str | None], shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words per text, class, cell, context rows) of every place of the texts."""
    return worded_places(texts, shape)[:4]


def worded_places(texts: list[str | None], shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What ``places`` gives, and the digests of the words."""
    data = [utf8(t) for t in texts]
    buf = b"\n".join(data)
    h, starts, ends = hashed_words(buf)
    n = np.bincount(np.searchsorted(bounds([len(d) + 1 for d in data]), starts, "right") - 1, minlength=len(texts))
    if not len(h):
        return n, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 2 * shape.side), np.int64), h
    b = np.frombuffer(buf, np.uint8).astype(np.int64)
    last, before = b[ends - 1], np.where(ends - starts > 1, b[np.maximum(ends - 2, 0)], 0)
    kind = ((last * 31 + before) * 2654435761 >> 8) % shape.classes
    low = (h & np.uint64(0xFFFFFF)).astype(np.int64)
    cell, own = kind * shape.per_class + low % shape.per_class, kind * shape.inputs + low % shape.inputs
    outside = shape.classes * shape.inputs
    text = np.repeat(np.arange(len(texts)), n)
    context = np.full((len(h), 2 * shape.side), outside, np.int64)
    for k in range(1, shape.side + 1):
        same = text[k:] == text[:-k]
        context[k:, shape.side - k] = np.where(same, own[:-k], outside)
        context[:-k, shape.side + k - 1] = np.where(same, own[k:], outside)
    return n, kind, cell, context, h


def hidden_layer(weights: list[np.ndarray], context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(input rows, hidden layer), a row for each place."""
    emb, w1, b1, _, _ = weights
    x = emb.take(context.ravel(), 0).reshape(len(context), -1)
    out = x @ w1
    out += b1
    return x, np.tanh(out, out)


def class_logits(weights: list[np.ndarray], hidden: np.ndarray) -> np.ndarray:
    """Logits of the classes, within what exp bears; a column for each place, so that sums over classes run along memory."""
    _, _, _, w2, b2 = weights
    out = w2.T @ hidden.T
    out += b2[:, None]
    if (np.abs(w2).sum(0) + np.abs(b2)).max() > 60:  # hidden lies within one
        out -= out.max(0)
    return out


def log_softmax(weights: list[np.ndarray], context: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(input rows, hidden layer, log-probabilities of classes), a row for each place."""
    x, hidden = hidden_layer(weights, context)
    out = class_logits(weights, hidden)
    return x, hidden, (out - np.log(np.exp(out).sum(0))).T


class Trainer:
    """Adam over batches of places; weights, gradients and moments are views of one array each."""

    def __init__(self, shape: Shape, start: list[np.ndarray]):
        self.shape, self.t = shape, 0
        self.flat = shape.flat(start)
        self.m, self.v, self.g, self.spare = (np.zeros_like(self.flat) for _ in range(4))
        self.weights, self.grads = self.views(self.flat), self.views(self.g)

    def views(self, flat: np.ndarray) -> list[np.ndarray]:
        at = bounds([int(np.prod(s)) for s in self.shape.parts])
        return [flat[a:b].reshape(s) for a, b, s in zip(at[:-1], at[1:], self.shape.parts, strict=True)]

    def step(self, kind: np.ndarray, context: np.ndarray) -> None:
        g, m, v, spare = self.g, self.m, self.v, self.spare
        g[:] = 0
        for lo in range(0, len(kind), BLOCK):
            self.back(kind[lo : lo + BLOCK], context[lo : lo + BLOCK], len(kind), self.grads)
        self.t += 1
        np.subtract(g, m, spare)
        spare *= np.float32(0.1)
        m += spare
        np.multiply(g, g, spare)
        spare -= v
        spare *= np.float32(0.01)
        v += spare
        np.divide(v, np.float32(1 - 0.99**self.t), spare)
        np.sqrt(spare, spare)
        spare += np.float32(1e-8)
        np.divide(m, np.float32(1 - 0.9**self.t), g)
        g *= np.float32(self.shape.rate)
        g /= spare
        self.flat -= g

    def back(self, kind: np.ndarray, context: np.ndarray, places: int, grads: list[np.ndarray]) -> None:
        """Adds these places' share of the gradients of the mean loss of ``places``."""
        emb, w1, _, w2, _ = self.weights
        x, hidden = hidden_layer(self.weights, context)
        d = class_logits(self.weights, hidden)
        np.exp(d, d)
        d /= d.sum(0) * np.float32(places)
        d[kind, np.arange(len(kind))] -= np.float32(1 / places)
        dh = (w2 @ d).T * (1 - hidden * hidden)
        # A line for each number of an embedding.
        dx = (dh @ w1.T).reshape(-1, self.shape.width).T.astype(float, order="C")
        rows = context.ravel()
        for k, line in enumerate(dx):
            grads[0][:, k] += np.bincount(rows, line, len(emb))
        for g, part in zip(grads[1:], [x.T @ dh, dh.sum(0), (d @ hidden).T, d.sum(1)], strict=True):
            g += part


def gate_shares(hidden: np.ndarray, projection: np.ndarray) -> np.ndarray:
    """Shares of the experts at each place."""
    out = (2 * projection.T) @ hidden.T
    out -= out.max(0)
    np.exp(out, out)
    out /= out.sum(0)
    return out.T


@dataclass
class Model:
    shape: Shape
    weights: list[np.ndarray]
    #: Log-probability of each cell within its class, for words that the corpus does not have.
    shares: np.ndarray
    #: The experts' sums in each class, and its number of different words.
    totals: np.ndarray
    kinds: np.ndarray
    #: (word, s0, s1, ...): every word's sums, one for each expert.
    table: DataFrame | None = None

    def within(self, kind: np.ndarray, cell: np.ndarray, sums: np.ndarray, gates: np.ndarray) -> np.ndarray:
        """Probability of words within their class; ``sums`` is zero for words that the corpus does not have."""
        n = self.totals.sum(1)
        every = np.maximum(n + self.kinds, 1e-300)
        rest = np.where(n > 0, self.kinds / every, 1.0)
        ones = np.ones(self.shape.gates)
        count = sums @ ones
        base = np.where(count > 0, count / every[kind], rest[kind] * np.exp(self.shares[cell]))
        prior = self.shape.prior
        out = sums + (prior * base)[:, None]
        out /= (self.totals + prior).take(kind, 0)
        out *= gates
        return out @ ones

    def score(self, texts: list[str | None], words: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, summed log-probability) of each text; ``words`` in order, with their rows of sums, those of the texts at least."""
        n, kind, cell, context, h = worded_places(texts, self.shape)
        at = found_at(words, h)
        sums = np.vstack([sums, np.zeros((1, self.shape.gates))])
        logp, projection = np.zeros(len(kind)), self.shape.projection()
        for lo in range(0, len(kind), BLOCK):
            part = slice(lo, lo + BLOCK)
            hidden = hidden_layer(self.weights, context[part])[1]
            out = class_logits(self.weights, hidden)
            own = out[kind[part], np.arange(len(hidden))]
            inner = self.within(kind[part], cell[part], sums.take(at[part], 0), gate_shares(hidden, projection))
            logp[part] = own - np.log(np.exp(out, out).sum(0)) + np.log(inner)
        out = np.zeros(len(texts))
        filled = np.flatnonzero(n)
        if len(filled):
            out[filled] = np.add.reduceat(logp, bounds(n[filled])[:-1])
        return n, out


def found_at(words: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Places of digests among ``words`` (ascending, different), their number for those it does not have.

    Digests lie evenly, so their top bits tell where to look; the few steps from there are taken by all at once.
    """
    bits = max(1, (2 * len(words)).bit_length())
    top = np.uint64(64 - bits)
    starts = bounds(np.bincount((words >> top).astype(np.int64), minlength=1 << bits))
    at = starts[(h >> top).astype(np.int64)]
    ahead = np.append(words, np.uint64(0xFFFFFFFFFFFFFFFF))  # stops what is beyond the last word
    less = np.flatnonzero(ahead[at] < h)
    for _ in range(STEPS):
        if not len(less):
            break
        at[less] += 1
        less = less[ahead[at[less]] < h[less]]
    at[less] = np.searchsorted(words, h[less])
    at[np.append(words, np.uint64(0))[at] != h] = len(words)
    return at


def one_round(rows: DataFrame, shape: Shape, start: list[np.ndarray]) -> list[np.ndarray]:
    """The average of the weights that all stretches of ``rows`` reach from ``start``."""
    shared = rows.sparkSession.sparkContext.broadcast(start)  # some 0.2 MB, fixed by Shape
    size = len(shape.flat(start))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, trainer, seen = np.zeros(size + 1), Trainer(shape, shared.value), 0

        def ended() -> None:
            total[:-1] += shape.flat(trainer.weights).astype(float) * seen
            total[-1] += seen

        for b in batches:
            texts = [as_text(t) for t in b["text"]]
            for lo, hi in chunked(texts):
                _, kind, _, context = places(texts[lo:hi], shape)
                for a in range(0, len(kind), shape.batch):
                    if seen >= shape.stretch:
                        ended()
                        trainer, seen = Trainer(shape, shared.value), 0
                    trainer.step(kind[a : a + shape.batch], context[a : a + shape.batch])
                    seen += len(kind[a : a + shape.batch])
        ended()
        if total[-1]:
            yield pd.DataFrame({"key": np.arange(size + 1, dtype=np.int32), "value": total})

    total = np.zeros(size + 1)
    for r in rows.mapInPandas(run, "key int, value double").groupBy("key").agg(F.sum("value").alias("value")).toLocalIterator():
        total[r["key"]] = r["value"]
    return shape.shaped(total[:-1] / total[-1]) if total[-1] else start


def merged(h: np.ndarray, kind: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different words with their classes and the totals of their sums."""
    words, first, inv = np.unique(h, return_index=True, return_inverse=True)
    return words, kind[first], np.stack([np.bincount(inv, sums[:, k], len(words)) for k in range(sums.shape[1])], 1)


def counted(h: np.ndarray, kind: np.ndarray, expert: np.ndarray, gates: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different words with their classes and their places of each expert."""
    words, first, inv = np.unique(h, return_index=True, return_inverse=True)
    return words, kind[first], np.bincount(inv * gates + expert, minlength=len(words) * gates).reshape(-1, gates).astype(np.float32)


def word_sums(rows: DataFrame, shape: Shape, weights: list[np.ndarray]) -> DataFrame:
    """(word, kind, s0, s1, ...): for every word of the corpus its places of each expert."""
    shared = rows.sparkSession.sparkContext.broadcast(weights)  # as in one_round
    names = [f"s{k}" for k in range(shape.gates)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        projection = shape.projection()
        held, rows_held = [], 0

        def frame(words, kind, sums):
            return pd.DataFrame({"word": words.view(np.int64), "kind": kind.astype(np.int32)} | {c: sums[:, k] for k, c in enumerate(names)})

        for b in batches:
            texts = [as_text(t) for t in b["text"]]
            for lo, hi in chunked(texts):
                _, kind, _, context, h = worded_places(texts[lo:hi], shape)
                expert = [gate_shares(hidden_layer(shared.value, context[a : a + BLOCK])[1], projection).argmax(1) for a in range(0, len(kind), BLOCK)]
                held.append(counted(h, kind, np.concatenate([np.zeros(0, np.int64), *expert]), shape.gates))
                rows_held += len(held[-1][0])
                if rows_held > HELD:
                    yield frame(*merged(*(np.concatenate(x) for x in zip(*held, strict=True))))
                    held, rows_held = [], 0
        if rows_held:
            yield frame(*merged(*(np.concatenate(x) for x in zip(*held, strict=True))))

    found = rows.mapInPandas(run, "word long, kind int, " + ", ".join(f"{c} float" for c in names))
    return found.groupBy("word").agg(F.min("kind").alias("kind"), *[F.sum(c).cast("float").alias(c) for c in names])


def packed(table: DataFrame, names: list[str], most: float) -> DataFrame:
    """(word, and all sums): two counts of 32 bits to a column where no count reaches 31 bits, else one."""
    whole = [F.col(c).cast("long") for c in names]
    if most >= 1 << 31 or len(whole) % 2:
        return table.select("word", *[c.alias(f"p{k}") for k, c in enumerate(whole)])
    return table.select("word", *[(low + F.shiftleft(high, 32)).alias(f"p{k}") for k, (low, high) in enumerate(zip(whole[::2], whole[1::2], strict=True))])


def unpacked(rows: np.ndarray, gates: int) -> np.ndarray:
    """The sums of ``packed`` rows, a column for each expert."""
    return (rows if rows.shape[1] == gates else np.ascontiguousarray(rows).view("<i4")).astype(float)


def train(df: DataFrame, shape: Shape = Shape(), text: str = "text") -> Model:
    """The model of all texts of ``df``."""
    rows, weights = df.select(F.col(text).alias("text")), shape.start()
    for _ in range(shape.rounds):
        weights = one_round(rows, shape, weights)
    table = materialised(word_sums(rows, shape, weights))
    names = [c for c in table.columns if c not in ("word", "kind")]
    totals, kinds = np.zeros((shape.classes, shape.gates)), np.zeros(shape.classes)
    for r in table.groupBy("kind").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in names]).collect():  # a row for each class
        totals[r["kind"]], kinds[r["kind"]] = [r[c] for c in names], r["n"]
    counts = np.zeros(shape.classes * shape.per_class)
    cell = (F.col("kind") * shape.per_class + F.col("word").bitwiseAND(F.lit(0xFFFFFF)) % shape.per_class).cast("int")
    for r in table.groupBy(cell.alias("cell")).agg(F.sum(sum(F.col(c) for c in names)).alias("n")).toLocalIterator():  # a row for each cell
        counts[r["cell"]] = r["n"]
    counts = counts.reshape(shape.classes, -1)
    shares = np.log((counts + 1) / (counts.sum(1, keepdims=True) + shape.per_class)).ravel()
    return Model(shape, weights, shares, totals, kinds, table.drop("kind"))


def parted(df: DataFrame) -> DataFrame:
    """(part, doc_id, text), written once: rows in the order of the input, in parts of some PART characters."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, held = TaskContext.get().partitionId() << 32, 0
        for b in batches:
            of = np.zeros(len(b), np.int64)
            for k, t in enumerate(b["text"]):
                size = len(as_text(t) or "") + 16
                if held and held + size > PART:
                    part, held = part + 1, 0
                of[k], held = part, held + size
            yield b.assign(part=of)[["part", "doc_id", "text"]].astype({"doc_id": "Int64"})

    return materialised(df.mapInPandas(run, "part long, doc_id long, text string"))


def words_of_parts(docs: DataFrame) -> DataFrame:
    """(part, word): the different words of each part, as far as a task sees it whole."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, held = None, []

        def ended() -> pd.DataFrame:
            return pd.DataFrame({"part": part, "word": np.unique(np.concatenate([np.zeros(0, np.uint64), *held])).view(np.int64)})

        for b in batches:
            of = b["part"].to_numpy(np.int64)
            texts = [as_text(t) for t in b["text"]]
            for lo, hi in zip(at := np.flatnonzero(np.append(True, of[1:] != of[:-1])), np.append(at[1:], len(of)), strict=True):
                if part is not None and of[lo] != part:
                    yield ended()
                    held.clear()
                part = of[lo]
                for a, z in chunked(texts[lo:hi]):
                    held.append(np.unique(hashed_words(b"\n".join(map(utf8, texts[lo + a : lo + z])))[0]))
        if part is not None:
            yield ended()

    return docs.select("part", "text").mapInPandas(run, "part long, word long")


def scored(df: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, log_likelihood, mean_log_likelihood) of every row."""
    shared = df.sparkSession.sparkContext.broadcast(dataclasses.replace(model, table=None))  # some 0.7 MB, fixed by Shape
    docs = parted(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")))
    table = packed(model.table, [c for c in model.table.columns if c != "word"], model.totals.max())
    known = words_of_parts(docs).join(table, "word")
    names = [c for c in table.columns if c != "word"]

    def run(rows: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        found = found.assign(word=found["word"].to_numpy(np.int64).view(np.uint64)).drop_duplicates("word").sort_values("word")
        words, sums = found["word"].to_numpy(np.uint64), unpacked(found[names].to_numpy(np.int64), shared.value.shape.gates)
        texts = [as_text(t) for t in rows["text"]]
        got = [shared.value.score(texts[lo:hi], words, sums) for lo, hi in chunked(texts)]
        n, logp = (np.concatenate([np.zeros(0, t), *x]) for t, x in zip((np.int64, float), zip(*got, strict=True), strict=False)) if got else (np.zeros(0, np.int64), np.zeros(0))
        out = pd.DataFrame({"doc_id": rows["doc_id"].to_numpy(), "n_words": n, "log_likelihood": logp}).astype({"doc_id": "Int64"})
        out["mean_log_likelihood"] = pd.Series([x / k if k else None for x, k in zip(logp, n, strict=True)], dtype="Float64")
        return out

    return docs.groupBy("part").cogroup(known.groupBy("part")).applyInPandas(run, "doc_id long, n_words long, log_likelihood double, mean_log_likelihood double")
