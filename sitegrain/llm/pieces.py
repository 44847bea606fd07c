"""SentencePiece N-best encoding by A*, and decoding.

A text is one lattice of vocabulary pieces over its characters, spaces written
as U+2581 and one put in front. The lattice falls apart at places no piece
spans (before a space mark that follows another character, beside a character
of no piece), so it is searched unit by unit and units repeat: forward
Viterbi scores give for each position the best score up to it, which is the
exact heuristic for an A* search backward from the unit's end. Its first N
arrivals are the N best. That search runs only for units whose second choice a
text may need; the best and the second score of all others come from Viterbi
forward and backward over many units at once. The N best of a text follow from the N-1 units whose
second choice costs least: any other change is worse than N single ones.

Order: score (sum of the model's piece scores), falling; equal scores: in a
unit by the lengths of pieces read from its end, in a text by the unit choices
in reading order, both lexicographic. Characters without a piece become byte
pieces at a fixed penalty.

Null or empty text: one segmentation of no ids, score 0. Repeated rows and
null ids are encoded like any other; extra columns are not carried.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegrain.llm.common import Memo, Pool, as_text, bounds, chunked, held, tokenizer_file

SPACE = "▁"
#: Below the worst piece, as the library does for unknown characters.
UNKNOWN_PENALTY = 10.0
#: Up to this length units are ranked together, beyond it one by one.
LONG_UNIT = 32
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Units remembered by a worker before it starts afresh.
MEMO = 300_000


class Vocabulary:
    """Pieces of a model file as prefixes, bytes and scores."""

    def __init__(self, path: str):
        import sentencepiece as spm

        model = spm.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.bytes: list[bytes] = [b""] * n
        self.byte_ids: dict[int, int] = {}
        found: dict[str, tuple[int, float]] = {}
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[1:-1], 16)] = i
                self.bytes[i] = bytes([int(piece[1:-1], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.bytes[i] = piece.replace(SPACE, " ").encode()
                if model.get_score(i) > -1e8 or set(piece) == {SPACE}:
                    found[piece] = (i, model.get_score(i))
        scores = [s for _, s in found.values() if s > -1e8]
        self.unknown = min(scores) - UNKNOWN_PENALTY
        # Runs of spaces are user-defined in such models and carry no score of their own: the best one.
        found = {p: (i, s if s > -1e8 else max(scores)) for p, (i, s) in found.items()}
        self.prefixes: dict[str, tuple[int, float] | None] = {}
        for piece, entry in found.items():
            for k in range(1, len(piece)):
                self.prefixes.setdefault(piece[:k], None)
            self.prefixes[piece] = entry
        self.chars = {c for p in found for c in p}
        self.unk_id = model.unk_id()
        if any(SPACE in p.lstrip(SPACE) for p in found):
            raise ValueError("a piece holds a space after another character")
        # Line ends split units only where no piece has them.
        self.unit = re.compile("\n| *[^ \n]+| +" if "\n" not in self.chars else " *[^ ]+| +")

    def edges(self, unit: str) -> list[list[tuple[int, float, tuple[int, ...]]]]:
        """For each position the pieces that end there: (start, score, ids)."""
        n = len(unit)
        into: list[list] = [[] for _ in range(n + 1)]
        get = self.prefixes.get
        for i in range(n):
            j = i + 1
            entry = get(unit[i:j], 0)
            if entry == 0 or entry is None and unit[i] not in self.prefixes:
                entry = 0
            single = False
            while entry != 0:
                if entry is not None:
                    into[j].append((i, entry[1], (entry[0],)))
                    single |= j == i + 1
                j += 1
                if j > n:
                    break
                entry = get(unit[i:j], 0)
            if not single:
                into[i + 1].append((i, self.unknown, self.raw_ids(unit[i])))
        return into

    def n_best(self, unit: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best segmentations of a unit, (score, ids)."""
        into = self.edges(unit)
        end = len(unit)
        best = [0.0] + [-np.inf] * end
        for j in range(1, end + 1):
            best[j] = max(best[i] + s for i, s, _ in into[j])
        out: list[tuple[float, tuple[int, ...]]] = []
        heap: list[tuple] = [(-best[end], (), end, 0.0, None)]
        while heap and len(out) < n:
            f, lengths, at, score, tail = heapq.heappop(heap)
            if not at:
                ids: list[int] = []
                while tail is not None:
                    ids.extend(tail[0])
                    tail = tail[1]
                out.append((score, tuple(ids)))
                continue
            for i, s, ids in into[at]:
                heapq.heappush(heap, (-(best[i] + s + score), (*lengths, at - i), i, score + s, (ids, tail)))
        return out

    def ranked(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Best scores, distances of the second best (inf: none), ids of the best, ids per unit.

        Viterbi forward and backward over many units of one length at once.
        """
        score, gap = np.zeros(len(units)), np.full(len(units), np.inf)
        ids: list = [None] * len(units)
        length = np.fromiter(map(len, units), np.int64, len(units))
        order = np.argsort(length, kind="stable")
        for lo, hi in zip(e := np.flatnonzero(np.append(True, np.diff(length[order]) > 0)), np.append(e[1:], len(units)), strict=True):
            n = int(length[order[lo]])
            for a in range(lo, hi, 20_000):
                rows = order[a : min(hi, a + 20_000)]
                if n > LONG_UNIT:
                    for r in rows:
                        two = self.n_best(units[r], 2)
                        score[r], ids[r] = two[0]
                        gap[r] = two[0][0] - two[1][0] if len(two) > 1 else np.inf
                else:
                    self._ranked([units[r] for r in rows], n, rows, score, gap, ids)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return score, gap, np.fromiter((i for x in ids for i in x), np.int32, int(sizes.sum())), sizes

    def _ranked(self, units: list[str], n: int, rows: np.ndarray, score: np.ndarray, gap: np.ndarray, ids: list) -> None:
        if not hasattr(self, "hashes"):
            self._hash_pieces()
        m = len(units)
        chars = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), "<u4").reshape(m, n).astype(np.uint64) + np.uint64(1)
        piece: dict[tuple[int, int], np.ndarray] = {}
        worth: dict[tuple[int, int], np.ndarray] = {}
        h = np.zeros((m, n), np.uint64)
        for k in range(1, min(n, self.longest) + 1):
            h = h[:, : n - k + 1] * _STEP + chars[:, k - 1 :]
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            hit = self.hashes[at] == h
            if not hit.any() and k > 1:
                continue
            for i in range(n - k + 1):
                if k == 1 or hit[:, i].any():
                    piece[i, i + k] = np.where(hit[:, i], self.hash_ids[at[:, i]], -1)
                    worth[i, i + k] = np.where(hit[:, i], self.hash_scores[at[:, i]], self.unknown if k == 1 else -np.inf)
        fwd, bwd = np.full((n + 1, m), -np.inf), np.full((n + 1, m), -np.inf)
        fwd[0] = bwd[n] = 0.0
        edges = sorted(worth)
        for i, j in sorted(edges, key=lambda e: e[1]):
            np.maximum(fwd[j], fwd[i] + worth[i, j], out=fwd[j])
        for i, j in reversed(edges):
            np.maximum(bwd[i], bwd[j] + worth[i, j], out=bwd[i])
        # Back along the best path, of equal ones the one with the shortest piece last; other edges give the second best.
        on = {e: np.zeros(m, bool) for e in edges}
        here = np.full(m, n)
        for j in range(n, 0, -1):
            open_ = here == j
            for i in range(j - 1, -1, -1):
                if (i, j) in worth:
                    take = open_ & (fwd[i] + worth[i, j] == fwd[j])
                    on[i, j] = take
                    here[take] = i
                    open_ &= ~take
        second = np.full(m, -np.inf)
        for e in edges:
            np.maximum(second, np.where(on[e], -np.inf, fwd[e[0]] + worth[e] + bwd[e[1]]), out=second)
        score[rows], gap[rows] = fwd[n], fwd[n] - second
        steps = [(e, np.flatnonzero(on[e])) for e in edges]
        owner = np.concatenate([u for _, u in steps])
        start = np.concatenate([np.full(len(u), e[0]) for e, u in steps])
        found = np.concatenate([piece[e][u] for e, u in steps])
        by = np.lexsort((start, owner))
        owner, start, found = owner[by], start[by].tolist(), found[by].tolist()
        cut = bounds(np.bincount(owner, minlength=m)).tolist()
        for u, r in enumerate(rows.tolist()):
            got = found[cut[u] : cut[u + 1]]
            if -1 in got:
                got = [x for i, p in zip(start[cut[u] : cut[u + 1]], got, strict=True) for x in (self.raw_ids(units[u][i]) if p < 0 else (p,))]
            ids[r] = got

    def _hash_pieces(self) -> None:
        entries = [(p, e) for p, e in self.prefixes.items() if e is not None]
        hashes = np.zeros(len(entries), np.uint64)
        for k, (p, _) in enumerate(entries):
            h = 0
            for c in p:
                h = (h * int(_STEP) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
            hashes[k] = h
        by = np.argsort(hashes)
        self.hashes, self.longest = hashes[by], max(len(p) for p, _ in entries)
        if len(np.unique(hashes)) != len(hashes):
            raise ValueError("two pieces share a digest")
        self.hash_ids = np.array([e[0] for _, e in entries], np.int64)[by]
        self.hash_scores = np.array([e[1] for _, e in entries])[by]

    def raw_ids(self, char: str) -> tuple[int, ...]:
        raw = char.replace(SPACE, " ").encode("utf-8", "surrogatepass")
        return tuple(self.byte_ids.get(b, self.unk_id) for b in raw)

    def decode(self, ids: np.ndarray) -> str:
        """Text of a segmentation; bytes that are no UTF-8 become U+FFFD."""
        if not hasattr(self, "flat"):
            self.sizes = np.array([len(b) for b in self.bytes], np.int64)
            self.starts, self.flat = bounds(self.sizes)[:-1], np.frombuffer(b"".join(self.bytes), np.uint8)
        lens = self.sizes[ids]
        at = bounds(lens)
        raw = self.flat[np.arange(at[-1]) + np.repeat(self.starts[ids] - at[:-1], lens)].tobytes()
        text = raw.decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


class Encoder:
    def __init__(self, path: str, n: int):
        self.v, self.n = Vocabulary(path), n
        self.reset()

    def reset(self) -> None:
        self.units, self.pool = Memo(), Pool(np.int32)
        self.names: list[str] = []
        self.scores, self.gaps = np.zeros(1 << 14), np.zeros(1 << 14)
        self.full: dict[int, list[tuple[float, np.ndarray]]] = {}

    def learn(self, new: list[str]) -> None:
        at = self.pool.n
        score, gap, flat, sizes = self.v.ranked([u.replace(" ", SPACE) for u in new])
        self.pool.add(flat, sizes)
        while len(self.gaps) < self.pool.n:
            self.scores, self.gaps = (np.concatenate([x, np.zeros_like(x)]) for x in (self.scores, self.gaps))
        self.scores[at : self.pool.n], self.gaps[at : self.pool.n] = score, gap
        self.names += new

    def unit(self, number: int) -> list[tuple[float, np.ndarray]]:
        """The n best segmentations of a unit, by A*; asked for only where a text's n best may hold them."""
        if number not in self.full:
            self.full[number] = [(s, np.array(i, np.int32)) for s, i in self.v.n_best(self.names[number].replace(" ", SPACE), self.n)]
        return self.full[number]

    def encode(self, texts: list[str | None]) -> list[list[tuple[float, np.ndarray]]]:
        """For each text its n best segmentations, (score, ids)."""
        if len(self.units) > MEMO:
            self.reset()
        find = self.v.unit.findall
        parts: list[str] = []
        count = [0]
        for t in texts:
            if t:
                parts += find(" " + t.replace(SPACE, " "))
            count.append(len(parts))
        which = np.fromiter(map(self.units.__getitem__, parts), np.int64, len(parts))
        if self.units.new:
            self.learn(self.units.taken())
        ids, at = self.pool.gather(which)
        gaps, totals = self.gaps[which], bounds(self.scores[which], np.float64)
        out = []
        for lo, hi in zip(count[:-1], count[1:], strict=True):
            base = ids[at[lo] : at[hi]]
            total = float(totals[hi] - totals[lo])
            found = []
            for gap, changes in self.changes(gaps[lo:hi], lambda k, lo=lo: self.unit(int(which[lo + k]))):
                pieces, done = [], 0
                for k, ids_k in changes:
                    a, b = int(at[lo + k] - at[lo]), int(at[lo + k + 1] - at[lo])
                    pieces += [base[done:a], ids_k]
                    done = b
                found.append((total - gap, np.concatenate([*pieces, base[done:]]) if pieces else base))
            out.append(found)
        return out

    def changes(self, gaps: np.ndarray, unit) -> list[tuple[float, list[tuple[int, np.ndarray]]]]:
        """The n cheapest sets of changed units: (cost, [(place, ids)])."""
        need = self.n - 1
        open_ = np.flatnonzero(np.isfinite(gaps))
        if len(open_) > need:
            kth = np.partition(gaps[open_], need - 1)[need - 1] if need else -1.0
            below, same = open_[gaps[open_] < kth], open_[gaps[open_] == kth]
            open_ = np.sort(np.concatenate([below, same[len(same) - (need - len(below)) :]])) if need else open_[:0]
        best: list[tuple[float, tuple[int, ...]]] = [(0.0, ())]
        for k in open_:
            choices = unit(k)
            best = heapq.nsmallest(self.n, [(g + choices[0][0] - s, (*r, j)) for g, r in best for j, (s, _) in enumerate(choices)])
        return [(g, [(int(k), unit(k)[j][1]) for k, j in zip(open_, r, strict=True) if j]) for g, r in best]


def encoder_for(path: str, n: int) -> Encoder:
    """One for each Python worker, which serves many tasks."""
    return held(("pieces", path, n), lambda: Encoder(path, n))


#: What a row holds of its ids: columns, types, function of (vocabulary, text, ids).
IDS = ("ids array<int>", lambda v, text, ids: (ids,))


def encode_n_best(df: DataFrame, n: int = 4, id_col: str = "doc_id", text: str = "text", model: str = "piece_bpe_32k.model", value: tuple = IDS) -> DataFrame:
    """One row for each text and rank: doc_id, rank (from 1), score, n_ids, and its ids (see IDS)."""
    path = tokenizer_file(model)
    columns, of_ids = value
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = encoder_for(path, n)
        for batch in batches:
            texts = [as_text(t) for t in batch["text"]]
            owners = [None if pd.isna(x) else int(x) for x in batch["doc_id"]]
            for lo, hi in chunked(texts):
                rows = [
                    (owners[lo + i], r, score, len(ids), *of_ids(encoder.v, texts[lo + i], ids))
                    for i, found in enumerate(encoder.encode(texts[lo:hi])) for r, (score, ids) in enumerate(found, 1)
                ]
                out = pd.DataFrame(rows, columns=["doc_id", "rank", "score", "n_ids", *names])
                out["doc_id"] = out["doc_id"].astype("Int64")
                yield out

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInPandas(run, f"doc_id long, rank int, score double, n_ids long, {columns}")


def decode_ids(df: DataFrame, ids: str = "ids", out: str = "text", model: str = "piece_bpe_32k.model") -> DataFrame:
    """``df`` with the text of its id lists (null: null; ids out of range: an error)."""
    path = tokenizer_file(model)
    kept = [c for c in df.columns if c != out]
    from pyspark.sql import types as T

    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(out, T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = encoder_for(path, 1).v
        for batch in batches:
            batch = batch.copy()
            batch[out] = [None if x is None else v.decode(np.asarray(x, np.int64)) for x in batch[ids]]
            yield batch

    return df.select(*kept).mapInPandas(run, schema)
