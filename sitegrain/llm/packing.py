"""Order-preserving packing of token streams into windows.

Documents keep the order of their input partition. A window is a run of tokens
between two cuts; cuts may lie at ends of documents, ends of sentences, or,
where neither comes for a while, at fixed steps. The cost of a window is its
padding (none at a power of two) plus a fixed cost, that of a cut its penalty.
The cheapest cuts follow from dynamic programming over the cuts: for padded
windows the best predecessor is the least (cost + position) within one window
length, a sliding minimum kept in a monotone queue; for the few lengths that
need no padding it is looked up at its one position.

Partitions are worked through in blocks of bounded size; the last window of a
block is put off and opens the next, so only a partition's end is cut short.
Nothing is shuffled. A sequence's id is its partition's number and its number
there, so a task run again gives the same rows.

Null text counts as empty: the end token alone. Every row is packed, repeated
rows and null ids too; extra columns are not carried; an empty table gives none.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegrain.llm.common import Memo, Pool, as_text, chunked, held, release, tokenizer_file


@dataclass(frozen=True)
class Plan:
    window: int = 4096
    end_id: int = 2
    #: What a cut costs, counted in tokens of padding: inside a sentence, at its end, at a document's end.
    hard_cut: int = 96
    sentence_cut: int = 24
    document_cut: int = 0
    #: What any window costs, so that short unpadded ones do not multiply.
    per_window: int = 16
    #: Places to cut inside a document are at least this far apart.
    least_step: int = 64
    #: Longest way without a place to cut.
    hard_step: int = 256
    #: Tokens planned at once.
    block: int = 1 << 19


#: What ends a sentence, quotes and brackets behind it aside; a line end does too.
_SENTENCE_END = re.compile(r"[.!?…]+[\"')\]»”’]*$")
#: Letters that stay one run of letters under the vocabulary's NFC and lower case, and ASCII marks behind them.
_LETTERS = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]*)")
#: Stands for a document's end among the parts, none of which holds a space.
_END = "end of document"


class Encoder:
    """Token ids of whole texts, through a bounded memo of their space-separated parts.

    The vocabulary drops white space before its merges, so a text's ids are the
    ids of its parts in order, and those of a run of letters with plain marks
    behind it are those of the letters and of the marks. Only letters and parts
    new to the memo reach the tokenizer. A full memo keeps the parts it was asked
    for again, half its size at most.
    """

    def __init__(self, path: str, memo: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark spreads the work
        from tokenizers import Tokenizer

        self.tok, self.memo = Tokenizer.from_file(path), memo
        words = self.tok.get_vocab(with_added_tokens=True)
        self.word_end = np.zeros(max(words.values()) + 1, bool)
        self.word_end[[i for w, i in words.items() if w.endswith("</w>")]] = True
        self.reset(None)

    def reset(self, end_id: int | None) -> None:
        self.end_id, self.parts, self.pool, self.ends = end_id, Memo(), Pool(np.uint32), np.zeros(1 << 14, bool)
        self.asked = np.zeros(1 << 14, np.int64)
        if end_id is not None:
            self.parts[_END] = 0
            self.pool.add(np.array([end_id], np.uint32), np.array([1]))

    def shrink(self) -> None:
        """Forget the parts asked for once since the memo was last full, and the rarest of the others."""
        asked, parts, pool, ends = self.asked[: self.pool.n], list(self.parts), self.pool, self.ends
        again = np.flatnonzero(asked[1:] > 1) + 1
        if len(again) > self.memo // 2:
            again = np.sort(again[np.argsort(-asked[again], kind="stable")[: self.memo // 2]])
        self.reset(self.end_id)
        ids, at = pool.gather(again)
        self.parts.update((parts[i], k) for k, i in enumerate(again.tolist(), 1))
        self.add(ids, np.diff(at), ends[again])

    def add(self, ids: np.ndarray, sizes: np.ndarray, ends: np.ndarray) -> None:
        at = self.pool.n
        self.pool.add(ids, sizes)
        while len(self.ends) < self.pool.n:
            self.ends, self.asked = (np.concatenate([x, np.zeros_like(x)]) for x in (self.ends, self.asked))
        self.ends[at : self.pool.n] = ends

    def of_letters(self, cores: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids of each) of runs of letters, encoded as one text: each run's last id is the only one that ends a word."""
        ids = np.array(self.tok.encode_batch_fast([" ".join(cores)], add_special_tokens=False)[0].ids, np.uint32)
        cut = np.flatnonzero(self.word_end[ids]) + 1
        return (ids, np.diff(cut, prepend=0)) if len(cut) == len(cores) else self.of_each(cores)

    def of_each(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        out = [e.ids for e in self.tok.encode_batch_fast(parts, add_special_tokens=False)]
        return np.array([i for x in out for i in x], np.uint32), np.array([len(x) for x in out], np.int64)

    def learn(self, new: list[str]) -> None:
        """Ids of new parts, put together of letters, known ones or new, and the rest."""
        at, known, cores, rest, pairs = self.pool.n, [], Memo(), Memo(), []
        for p in new:
            m = _LETTERS.fullmatch(p)
            if m is None:
                pairs.append((rest[p] * 3 + 2, -1))
                continue
            core = m[1].lower()
            k = self.parts.get(core, at)
            if k < at:
                pairs.append((len(known) * 3, rest[m[2]] * 3 + 2))
                known.append(k)
            else:
                pairs.append((cores[core] * 3 + 1, rest[m[2]] * 3 + 2))
        old, old_at = self.pool.gather(np.array(known, np.int64))
        ids, sizes = zip((old, np.diff(old_at)), self.of_letters(list(cores)), self.of_each(list(rest)), strict=True)
        pool = Pool(np.uint32)
        pool.add(np.concatenate([*ids, np.zeros(0, np.uint32)]), np.concatenate([*sizes, [0]]))
        pair = np.array(pairs, np.int64)
        first = np.array([0, len(known), len(known) + len(cores)])
        place = np.where(pair < 0, pool.n - 1, first[pair % 3] + pair // 3)
        ids, bound = pool.gather(place.ravel())
        last = np.array([p == "\n" or bool(_SENTENCE_END.search(p)) for p in rest], bool)
        self.add(ids, np.diff(bound[::2]), last[np.where(pair[:, 1] < 0, pair[:, 0], pair[:, 1]) // 3])

    def encode(self, texts: list[str | None], end_id: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts, each followed by end_id; ids per text; ends of sentences)."""
        if end_id != self.end_id:
            self.reset(end_id)
        elif len(self.parts) > self.memo:
            self.shrink()
        parts: list[str] = []
        count = []
        for t in texts:
            if t:
                parts += t.replace("\n", " \n ").split(" ")
            parts.append(_END)
            count.append(len(parts))
        which = np.fromiter(map(self.parts.__getitem__, parts), np.int64, len(parts))
        if self.parts.new:
            self.learn(self.parts.taken())
        self.asked[: self.pool.n] += np.bincount(which, minlength=self.pool.n)
        ids, at = self.pool.gather(which)
        return ids, np.diff(at[[0, *count]]), at[1:][self.ends[which]]


def encoder_for(path: str) -> Encoder:
    """One for each Python worker, which serves many tasks."""
    return held(("packing", path), lambda: Encoder(path))


def cuts_of(sizes: np.ndarray, sentences: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """(positions, penalties) of places to cut, ascending, the end of the block last."""
    ends = np.cumsum(sizes)
    total = int(ends[-1])
    if plan.least_step > 1 and len(sentences):  # the last sentence end of each stretch
        sentences = sentences[np.append(np.diff(sentences // plan.least_step) > 0, True)]
    places = np.unique(np.concatenate([[0], ends, sentences]))
    gaps = np.diff(places)
    wide = np.flatnonzero(gaps > plan.hard_step)
    hard = [np.arange(places[i] + plan.hard_step, places[i + 1], plan.hard_step) for i in wide]
    at = np.unique(np.concatenate([places[1:], *hard]))
    at = at[at <= total]
    penalty = np.full(len(at), plan.hard_cut, np.int64)
    penalty[np.isin(at, sentences)] = plan.sentence_cut
    penalty[np.isin(at, ends)] = plan.document_cut
    return at, penalty


def best_cuts(at: list[int], penalty: list[int], plan: Plan) -> list[int]:
    """Ends of the cheapest windows over places ``at`` (ascending); the last place ends the last window."""
    window, fixed = plan.window, plan.per_window
    places = [0, *at]
    cost, back = [0] * len(places), [0] * len(places)
    queue: deque[tuple[int, int, int]] = deque([(0, 0, 0)])  # (cost + position, position, place), both rising
    exact = [1 << k for k in range(window.bit_length()) if 1 << k < window]
    where = {0: 0}
    for j in range(1, len(places)):
        p = places[j]
        while queue[0][1] < p - window:
            queue.popleft()
        best, via = queue[0][0] + window - p, queue[0][2]
        for size in exact:
            i = where.get(p - size)
            if i is not None and cost[i] < best:
                best, via = cost[i], i
        cost[j], back[j] = best + fixed + penalty[j - 1], via
        mark = cost[j] + p
        while queue and queue[-1][0] >= mark:
            queue.pop()
        queue.append((mark, p, j))
        where[p] = j
    out, j = [], len(places) - 1
    while j:
        out.append(places[j])
        j = back[j]
    return out[::-1]


def windows(sizes: np.ndarray, sentences: np.ndarray, plan: Plan, last: bool) -> list[int]:
    """Window ends over a block; unless it is the last block, without the last window."""
    at, penalty = cuts_of(sizes, sentences, plan)
    out = best_cuts(at.tolist(), penalty.tolist(), plan)
    return out if last or len(out) < 2 else out[:-1]


def ids_crc32(ids: np.ndarray) -> int:
    """CRC-32 of the ids as little-endian unsigned 32-bit numbers."""
    return zlib.crc32(ids.astype("<u4").tobytes())


#: What a piece row holds of its ids: column, type, function of the id array.
IDS = ("ids", "array<int>", lambda ids: ids.astype(np.int32))
IDS_CRC32 = ("ids_crc32", "long", ids_crc32)


def pack(df: DataFrame, plan: Plan = Plan(), id_col: str = "doc_id", text: str = "text", vocabulary: str = "word_bpe_49k.json", value: tuple = IDS) -> DataFrame:
    """One row for each piece: doc_id, start, length, its ids (see IDS), doc_tokens, sequence_id, offset."""
    column, kind, of_ids = value
    path = tokenizer_file(vocabulary)
    assert plan.hard_step <= plan.window

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release("packing")
        encoder, number = encoder_for(path), TaskContext.get().partitionId() << 33
        # Not yet packed: document ids, how far each is packed already, its size; all their tokens.
        docs: list = []
        done = np.zeros(0, np.int64)
        whole = np.zeros(0, np.int64)
        ids = np.zeros(0, np.uint32)
        sentences = np.zeros(0, np.int64)

        def flush(last: bool) -> pd.DataFrame:
            nonlocal docs, done, whole, ids, sentences, number
            sizes = whole - done
            cut = np.array(windows(sizes, sentences, plan, last), np.int64)
            ends = np.cumsum(sizes)
            upto = int(cut[-1])
            edges = np.unique(np.concatenate([[0], cut, ends[ends <= upto]]))
            lo, hi = edges[:-1], edges[1:]
            of = np.searchsorted(ends, lo, "right")
            seq = np.searchsorted(cut, lo, "right")
            seq_start = np.concatenate([[0], cut])[seq]
            start = lo - (ends - sizes)[of] + done[of]
            out = pd.DataFrame(
                {
                    "doc_id": pd.Series([docs[i] for i in of], dtype="Int64"), "start": start, "length": hi - lo,
                    column: [of_ids(ids[a:b]) for a, b in zip(lo, hi, strict=True)],
                    "doc_tokens": whole[of], "sequence_id": number + seq, "offset": lo - seq_start,
                }
            )
            number += len(cut)
            rest = int(np.searchsorted(ends, upto, "right"))
            done = done[rest:].copy()
            if len(done):
                done[0] += upto - int((ends - sizes)[rest])
            docs, whole, ids = docs[rest:], whole[rest:], ids[upto:]
            sentences = sentences[sentences > upto] - upto
            return out

        for batch in batches:
            texts = [as_text(t) for t in batch["text"]]
            owners = [None if pd.isna(x) else int(x) for x in batch["doc_id"]]
            for lo, hi in chunked(texts):
                new, sizes, ends = encoder.encode(texts[lo:hi], plan.end_id)
                sentences = np.concatenate([sentences, ends + len(ids)])
                ids = np.concatenate([ids, new])
                docs += owners[lo:hi]
                whole, done = np.concatenate([whole, sizes]), np.concatenate([done, np.zeros(len(sizes), np.int64)])
                if len(ids) >= plan.block:
                    yield flush(False)
        if docs:
            yield flush(True)

    schema = f"doc_id long, start long, length long, {column} {kind}, doc_tokens long, sequence_id long, offset long"
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInPandas(run, schema)

