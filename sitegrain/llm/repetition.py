"""Quality rules on repetition inside a document, from a suffix array over words.

The words of a batch of documents become integers; one suffix array is built
over the batch by prefix doubling (document first, so no suffix runs into the
next one), refining only suffixes still tied. Longest common prefixes of
neighbours come from the classes kept at each doubling. A run of neighbours
with a common prefix of l words is an LCP interval, its prefix a repeat that
cannot be extended to the right; the deepest interval a suffix lies in ends
at the longest text it shares with any other suffix, so the union of spans of
all maximal repeats is the union of [i, i + deepest(i)). Rules limit the share
of words in that union and the longest repeat.

Null or empty text: no words, all counts 0, base_failed. Everything is local
to a row, so repeated rows, ties and clashing extra columns have no influence;
columns added win over columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sitegrain.llm.common import BLANKS, as_text, bounds, byte_words, chunked, release

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rules:
    """Limits; a repeat counts from ``min_repeat`` words on."""

    min_words: int = 10
    min_repeat: int = 5
    max_covered_percent: int = 20
    #: Longest repeat, in words and as a share of the document: each fails a text by itself.
    max_longest: int = 100
    max_longest_percent: int = 20


def _refined(rank: np.ndarray, active: np.ndarray, h: int) -> tuple[np.ndarray, np.ndarray]:
    """Ranks by 2h words from ranks by h words, for the tied ones; and those still tied.

    A rank is the place in the suffix array at which its class starts.
    """
    n = len(rank)
    after = active + h
    second = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
    key = rank[active] * np.int64(n + 1) + second
    order = np.argsort(key, kind="stable")
    place, key = active[order], key[order]
    first = rank[place]
    new_class = np.ones(len(place), bool)
    new_class[1:] = key[1:] != key[:-1]
    new_group = np.ones(len(place), bool)
    new_group[1:] = first[1:] != first[:-1]
    at = np.arange(len(place))
    start = np.maximum.accumulate(np.where(new_class, at, 0)) - np.maximum.accumulate(np.where(new_group, at, 0))
    out = rank.copy()
    out[place] = first + start
    last = np.ones(len(place), bool)
    last[:-1] = new_class[1:]
    return out, np.sort(place[~(new_class & last)])


def suffix_array(words: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sa, lcp): suffixes of all documents in order; lcp[k] of sa[k-1] and sa[k], 0 between documents.

    ``words`` are integers; ``doc`` is the non-decreasing document number of each word.
    """
    n = len(words)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends = np.flatnonzero(np.append(doc[1:] != doc[:-1], True))
    # A document's last suffix is cut off by an end mark of its own, which sorts first.
    shift = np.arange(n) + doc
    size = n + len(ends)
    marked = np.full(size, -1, np.int64)
    marked[shift] = words + 1
    marked[ends + np.arange(len(ends)) + 1] = 0
    docs = np.zeros(size, np.int64)
    docs[shift] = doc
    docs[ends + np.arange(len(ends)) + 1] = doc[ends]
    key = docs * np.int64(marked.max() + 1) + marked
    order = np.argsort(key, kind="stable")
    fresh = np.ones(size, bool)
    fresh[1:] = key[order][1:] != key[order][:-1]
    start = np.maximum.accumulate(np.where(fresh, np.arange(size), 0))
    rank = np.empty(size, np.int64)
    rank[order] = start
    tied = np.ones(size, bool)
    tied[:-1] = fresh[1:]
    active = np.sort(order[~(fresh & tied)])
    levels, h = [rank], 1
    while len(active):
        rank, active = _refined(rank, active, h)
        levels.append(rank)
        h *= 2
    sa = np.empty(size, np.int64)
    sa[rank] = np.arange(size)
    lcp = np.zeros(size, np.int64)
    pair = np.flatnonzero(levels[0][sa[1:]] == levels[0][sa[:-1]]) + 1
    pair = pair[marked[sa[pair]] > 0]
    a, b, common = sa[pair - 1], sa[pair], np.zeros(len(pair), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        i, j = np.minimum(a + common, size - 1), np.minimum(b + common, size - 1)
        same = (levels[k][i] == levels[k][j]) & (marked[i] > 0)
        common += np.where(same, 1 << k, 0)
    lcp[pair] = common
    words_only = marked[sa] > 0
    back = np.full(size, -1, np.int64)
    back[shift] = np.arange(n)
    return back[sa[words_only]], lcp[words_only]


def deepest(sa: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """For each word the depth of the deepest LCP interval its suffix lies in."""
    out = np.zeros(len(sa), np.int64)
    out[sa] = np.maximum(lcp, np.append(lcp[1:], 0))
    return out


def repeats(texts: list[str | None], rules: Rules) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: words, words in repeats, longest repeat in words."""
    vocabulary: dict[bytes, int] = {}
    words = [byte_words(t) for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    n = int(sizes.sum())
    if not n:
        return sizes, np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    ids = np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for ws in words for w in ws), np.int64, n)
    filled = np.flatnonzero(sizes)
    doc = np.repeat(np.arange(len(filled)), sizes[filled])
    depth = deepest(*suffix_array(ids, doc))
    depth = np.where(depth >= rules.min_repeat, depth, 0)
    starts = np.flatnonzero(depth)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + depth[starts], -1)
    inside = np.cumsum(edge[:-1]) > 0
    at = bounds(sizes)[:-1][filled]
    covered, longest = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    covered[filled] = np.add.reduceat(inside.astype(np.int64), at)
    longest[filled] = np.maximum.reduceat(depth, at)
    return sizes, covered, longest


def _line_counts(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(BLANKS)] if "\n" in text else ()
    return len(lines) - len(set(lines))


def rated(df: DataFrame, text: str = "text", rules: Rules = Rules(), keep_text: bool = False) -> DataFrame:
    """``df`` (without its text unless asked for) with counts and verdict for each row.

    Added: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    longest_repeat (words), base_failed, kept.
    """
    added = [("n_words", T.LongType()), ("word_chars", T.LongType()), ("n_symbols", T.LongType()), ("n_dup_lines", T.LongType()), ("n_repeat_words", T.LongType()), ("longest_repeat", T.LongType()), ("base_failed", T.BooleanType()), ("kept", T.BooleanType())]
    names = {a for a, _ in added}
    kept = [c for c in df.columns if c not in names]
    out_cols = kept if keep_text else [c for c in kept if c != text]
    schema = T.StructType([df.schema[c] for c in out_cols] + [T.StructField(a, t) for a, t in added])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release("repetition")
        for batch in batches:
            texts = [as_text(t) for t in batch[text]]
            for lo, hi in chunked(texts):
                part = texts[lo:hi]
                n, covered, longest = repeats(part, rules)
                out = batch.iloc[lo:hi][out_cols].copy()
                out["n_words"] = n
                out["word_chars"] = [len(t) - sum(map(t.count, BLANKS)) if t else 0 for t in part]
                out["n_symbols"] = [sum(map(t.count, SYMBOLS)) if t else 0 for t in part]
                out["n_dup_lines"] = [_line_counts(t) if t else 0 for t in part]
                out["n_repeat_words"], out["longest_repeat"] = covered, longest
                failed = (n < rules.min_words) | (100 * covered > rules.max_covered_percent * n)
                out["base_failed"] = failed
                out["kept"] = ~failed & ~((longest > rules.max_longest) | (100 * longest > rules.max_longest_percent * n))
                yield out

    return df.select(*kept).mapInPandas(run, schema)
