"""Line de-duplication by an exact set-similarity join.

A line is the set of its words (64-bit digests). A line is removed if an
earlier one, in the order of (doc_id, line number), has a Jaccard similarity of
``share`` or more with it, whether or not that one is removed itself; lines of
one document count too. So the first of equal or similar lines stays.

Equal sets are one class. Words are ordered by rarity: a table of word counts
of fixed size, hashed, summed over all documents, ranks them (any order that
is the same everywhere gives right results; counts make it selective). Classes
that are similar share a word within their first n - ceil(share * n) + 1 words,
so these prefixes are dealt by word (32 bits of it: what that mixes up is found
out later), and every list of lines gives its pairs under the length and the
positional filter and one of bits: each set has 64 or 128 parities of its words, and two
sets differ in at least as many words as parities, so most pairs that share but
a word go at once. A list longer than ``short_list`` gives only pairs
of heads: its earliest line by doc_id, then the earliest that is no candidate of a head before
it; the pairs are sought among lines near enough in size. Other lines which their heads leave unresolved then meet each other, so
near copies of one passage cost about a pair each. Pairs are verified on
whole sets; of the sets only those are moved whose bit is set in a table of
the ids wanted, of bounded size.

Lines without a word stay. Rows that agree in doc_id and text are one document;
documents that share a doc_id only are equally early, neither removes lines
of the other. Null ids come last in the order; null text has no lines and stays
null. Extra columns are passed through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegrain.llm.common import as_text, bounds, chunked, hashed_words, mixed, release, utf8
from sitegrain.session import materialised, shared_dir

#: Cells of the count table: fixed, whatever the vocabulary.
CELLS = 1 << 18
#: Sets of so many words and more have 128 parities, others 64.
LONG_SET = 64
LAST = 0x7FFFFFFFFFFFFFFF


@dataclass(frozen=True)
class Similarity:
    """Jaccard bound as a fraction, for exact integer tests."""

    over: int = 4
    under: int = 5
    short_list: int = 64
    wide_span: int = 512

    def overlap_ok(self, common, n1, n2):
        return common * (self.over + self.under) >= self.over * (n1 + n2)

    def bits_ok(self, differing, n1, n2):
        return (n1 + n2 - differing) * (self.over + self.under) >= 2 * self.over * (n1 + n2)

    def length_ok(self, n1, n2):
        return (self.under * n1 >= self.over * n2) & (self.under * n2 >= self.over * n1)


def _cells(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(46)).astype(np.int64)


def word_table(texts: DataFrame) -> np.ndarray:
    """Counts of all words of column ``text``, by cell; partial sums leave each partition."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release("linedup")
        total = np.zeros(CELLS, np.int64)
        for b in batches:
            data = [as_text(t) for t in b["text"]]
            for lo, hi in chunked(data):
                h, _, _ = hashed_words(b"\n".join(map(utf8, data[lo:hi])))
                total += np.bincount(_cells(h), minlength=CELLS)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"cell": at.astype(np.int32), "n": total[at]})

    out = np.zeros(CELLS, np.int64)
    for r in texts.mapInPandas(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r["cell"]] = r["n"]
    return out


def _ordered(h: np.ndarray, line: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, lines): each line's different words, by rank, then digest."""
    key = (line.astype(np.uint64) << np.uint64(44)) | (rank[_cells(h)] << np.uint64(32)) | (h >> np.uint64(32))
    order = np.argsort(key)
    key, h = key[order], h[order]
    if len(key) and ((key[1:] == key[:-1]) & (h[1:] != h[:-1])).any():
        again = np.lexsort((h, key))
        key, h = key[again], h[again]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (h[1:] != h[:-1])
    return h[fresh], (key[fresh] >> np.uint64(44)).astype(np.int64)


def line_sets(texts: list[str | None], rank: np.ndarray):
    """Worded lines of texts: (text number, line number, set size, two digests, two words of parities, words in order, starts)."""
    data = [utf8(t) for t in texts]
    size = np.array([len(d) + 1 for d in data], np.int64)
    text_at = bounds(size)
    buf = b"\n".join(data)
    h, starts, _ = hashed_words(buf)
    breaks = np.flatnonzero(np.frombuffer(buf, np.uint8) == 10)
    line = np.searchsorted(breaks, starts)  # over the whole buffer
    used, local = np.unique(line, return_inverse=True)
    if len(used) >> 20:  # more lines than the sort key has room for
        order = np.lexsort((h, rank[_cells(h)], local))
        h, of = h[order], local[order]
        fresh = np.ones(len(h), bool)
        fresh[1:] = (of[1:] != of[:-1]) | (h[1:] != h[:-1])
        h, of = h[fresh], of[fresh]
    else:
        h, of = _ordered(h, local, rank)
    n = np.bincount(of, minlength=len(used))
    at = bounds(n)
    first = np.zeros(0, np.uint64)
    second = first
    bits = more = first.view(np.int64)
    if len(used):
        with np.errstate(over="ignore"):
            first = np.add.reduceat(mixed(h), at[:-1])
            second = np.add.reduceat(mixed(h ^ np.uint64(0x5851F42D4C957F2D)), at[:-1])
        even = ((h >> np.uint64(6)) & np.uint64(1)).astype(bool) | (np.repeat(n, n) < LONG_SET)
        bit = np.uint64(1) << (h & np.uint64(63))
        bits, more = (np.bitwise_xor.reduceat(np.where(which, bit, np.uint64(0)), at[:-1]).view(np.int64) for which in (even, ~even))
    line_start = np.concatenate([[0], breaks + 1])[used]
    text = np.searchsorted(text_at, line_start, "right") - 1
    # Lines before a text: the breaks in front of its start.
    number = used - np.searchsorted(breaks, text_at[:-1])[text]
    return text, number, n, first.view(np.int64), second.view(np.int64), bits, more, h.view(np.int64), at


def worded_lines(df: DataFrame, rank: np.ndarray) -> DataFrame:
    """One row for each worded line, (d, t, line, n, h1, h2, bits, more, words); words only where new to the task.

    Texts without such a line give one row with line -1.
    """
    table = df.sparkSession.sparkContext.broadcast(rank)  # CELLS numbers

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release("linedup")
        seen: set[int] = set()
        for b in batches:
            data = [as_text(t) for t in b["text"]]
            ids, digests = b["d"].to_numpy(np.int64), b["t"].to_numpy(np.int64)
            for lo, hi in chunked(data):
                text, number, n, h1, h2, bits, more, words, at = line_sets(data[lo:hi], table.value)
                new = [not (x in seen or seen.add(x)) for x in h1.tolist()]
                parts = [words[a:z] if f else None for f, a, z in zip(new, at[:-1].tolist(), at[1:].tolist(), strict=True)]
                bare = np.setdiff1d(np.arange(hi - lo), text)
                text, number = np.concatenate([text, bare]) + lo, np.concatenate([number, np.full(len(bare), -1)])
                zero = np.zeros(len(bare), np.int64)
                yield pd.DataFrame(
                    {
                        "d": ids[text], "t": digests[text], "line": number.astype(np.int32), "n": np.concatenate([n, zero]).astype(np.int32),
                        "h1": np.concatenate([h1, zero]), "h2": np.concatenate([h2, zero]), "bits": np.concatenate([bits, zero]), "more": np.concatenate([more, zero]), "words": pd.Series([*parts, *[None] * len(bare)], dtype=object),
                    }
                )

    keyed = df.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("d"), F.xxhash64("text").alias("t"), "text")
    return keyed.mapInPandas(run, "d long, t long, line int, n int, h1 long, h2 long, bits long, more long, words array<long>")


def _written(df: DataFrame) -> DataFrame:
    """Written once to the shared folder; words repeat, so dictionaries are let grow."""
    import uuid

    path = f"{shared_dir(df.sparkSession)}/lines-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("parquet.dictionary.page.size", str(8 << 20)).parquet(path)
    return df.sparkSession.read.parquet(path)


def differing(x, y) -> np.ndarray:
    """Parities in which sets (bits, more, size) differ; of a long and a short set the folded ones."""
    (b1, m1, n1), (b2, m2, n2) = x, y
    one = np.bitwise_count((b1 ^ m1) ^ (b2 ^ m2)).astype(np.int64)
    two = np.bitwise_count(b1 ^ b2).astype(np.int64) + np.bitwise_count(m1 ^ m2)
    return np.where((n1 >= LONG_SET) & (n2 >= LONG_SET), two, one)


def pairs_of_lists(word, id_, n, i, bits, more, early, how: Similarity) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Candidate pairs (left, right places) of lists sorted by (word, size, id); which rows lie in long lists, which are heads.

    A row meets only those of its list that are near enough in size. In a long
    list the earliest row is a head, then the earliest that is no candidate
    of a head so far, so near copies of a head are later lines, which it removes;
    only heads give pairs, with all of the list.
    """
    start = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
    size = np.diff(np.append(start, len(word)))
    of = np.repeat(size, size)
    long = of > how.short_list
    number = np.repeat(np.arange(len(start)), size) << 32
    key = number | n
    ahead = np.searchsorted(key, number | np.minimum(n * how.under // how.over, 0xFFFFFFFF), "right")
    span = ahead - np.arange(len(word)) - 1
    wide = np.repeat(np.maximum.reduceat(span, start), size) > how.wide_span
    long |= wide

    def test(x, y):
        reach = 1 + np.minimum(n[x] - i[x] - 1, n[y] - i[y] - 1)
        ok = how.overlap_ok(reach, n[x], n[y]) & (id_[x] != id_[y])
        x, y = x[ok], y[ok]
        ok = how.bits_ok(differing((bits[x], more[x], n[x]), (bits[y], more[y], n[y])), n[x], n[y])
        return x[ok], y[ok]

    found = [(word[:0].astype(np.int64),) * 2]
    rows = np.flatnonzero((span > 0) & ~wide)
    for k in range(1, how.wide_span + 1):
        rows = rows[span[rows] >= k]
        if not len(rows):
            break
        found.append(test(rows, rows + k))
    left, right = (np.concatenate(x) for x in zip(*found, strict=True))
    head = long & ~wide
    both = np.flatnonzero(long[left])
    here, there = np.concatenate([left[both], right[both]]), np.concatenate([right[both], left[both]])
    order = np.argsort(here, kind="stable")
    here, there = here[order], there[order]
    node, at = np.unique(here, return_index=True)
    by_id = np.lexsort((id_[node], early[node]))
    ends = np.append(at, len(here))[1:]
    for x, lo, hi in zip(node[by_id].tolist(), at[by_id].tolist(), ends[by_id].tolist(), strict=True):
        if head[x]:
            head[there[lo:hi]] = False
    kept = ~long[left] | head[left] | head[right]
    found = [(left[kept], right[kept])]
    for first, k in zip(start[wide[start]], size[wide[start]], strict=True):
        free = np.ones(k, bool)
        for pivot in np.lexsort((id_[first : first + k], early[first : first + k])).tolist():
            if free[pivot]:
                x = first + pivot
                lo = first + np.searchsorted(n[first : first + k], -(-n[x] * how.over // how.under))
                y = np.arange(lo, ahead[x])
                found.append(test(np.full(len(y), x), y))
                free[found[-1][1] - first] = False
                head[x] = True
    left, right = (np.concatenate(x) for x in zip(*found, strict=True))
    return left, right, long, head


def listed(sets: DataFrame, how: Similarity) -> DataFrame:
    """What the prefix lists give: rows (head boolean, a, b) are pairs; rows with a word are places of long lists that are no heads."""
    prefix = F.expr(f"slice(words, 1, n - cast(ceil({how.over} * n / {how.under}) as int) + 1)")
    posts = sets.select("id", "n", "bits", "more", "early", F.posexplode(prefix).alias("i", "w")).select(F.shiftright("w", 32).cast("int").alias("word"), "id", "n", "i", "bits", "more", "early")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release("linedup")
        held = None

        def found(x: pd.DataFrame) -> Iterator[pd.DataFrame]:
            word, id_, n, i, bits, more, early = (x[c].to_numpy(np.int64) for c in ("word", "id", "n", "i", "bits", "more", "early"))
            left, right, long, head = pairs_of_lists(word, id_, n, i, bits.view(np.uint64), more.view(np.uint64), early, how)
            pairs = pd.DataFrame({"head": long[left], "a": np.minimum(id_[left], id_[right]), "b": np.maximum(id_[left], id_[right])})
            yield pairs.drop_duplicates()
            long &= ~head
            if long.any():
                yield pd.DataFrame({"a": id_[long], "word": word[long], "n": n[long], "i": i[long], "bits": bits[long], "more": more[long]})

        for b in batches:
            held = b if held is None or not len(held) else pd.concat([held, b], ignore_index=True)
            done = int(np.searchsorted(held["word"].to_numpy(), held["word"].iloc[-1])) if len(held) else 0
            if done:
                for out in found(held.iloc[:done]):
                    yield _shaped(out)
                held = held.iloc[done:]
        if held is not None and len(held):
            for out in found(held):
                yield _shaped(out)

    return posts.repartition("word").sortWithinPartitions("word", "n", "id").mapInPandas(run, "head boolean, a long, b long, word int, n int, i int, bits long, more long")


def _shaped(x: pd.DataFrame) -> pd.DataFrame:
    return x.reindex(columns=["head", "a", "b", "word", "n", "i", "bits", "more"]).astype({"head": "boolean", "a": "Int64", "b": "Int64", "word": "Int32", "n": "Int32", "i": "Int32", "bits": "Int64", "more": "Int64"})


#: Slots of the table of wanted ids, 64 ids' bits each: at most this many, whatever is wanted.
MOST_SLOTS = 1 << 19


def _verified(pairs: DataFrame, sets: DataFrame, how: Similarity) -> DataFrame:
    """Pairs whose whole sets are similar, with their classes.

    The wanted sets are picked by a bit table first: with more ids than bits it
    lets more sets pass, never fewer.
    """
    pairs = materialised(pairs.distinct())
    slots = 1 << min(MOST_SLOTS.bit_length() - 1, max(6, (pairs.count() // 4).bit_length()))
    slot = F.expr(f"pmod(shiftright(xxhash64(id), 6), {slots}L)")
    bit = F.expr("shiftleft(1L, cast(pmod(xxhash64(id), 64) as int))")
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id")))
    wanted = ids.groupBy(slot.alias("slot")).agg(F.bit_or(bit).alias("mask"))
    picked = sets.withColumn("slot", slot).join(F.broadcast(wanted), "slot").filter(F.col("mask").bitwiseAND(bit) != 0)  # at most MOST_SLOTS rows
    side = lambda k: picked.select(*[F.col(c).alias(f"{c}_{k}") for c in ("id", "n", "h1", "h2", "words")])
    both = pairs.join(side("a"), F.col("a") == F.col("id_a")).join(side("b"), F.col("b") == F.col("id_b"))
    common = F.size(F.array_intersect("words_a", "words_b"))
    return both.filter(how.overlap_ok(common, F.col("n_a"), F.col("n_b"))).select("a", "b", "h1_a", "h2_a", "h1_b", "h2_b")


def line_verdicts(df: DataFrame, how: Similarity = Similarity()) -> DataFrame:
    """(d, t, n_lines, removed): each document's worded lines and the numbers of those to remove.

    ``d`` is doc_id (the largest long for null), ``t`` the digest of its text.
    """
    counts = word_table(df.select("text"))
    rank = np.minimum(64 * np.log2(counts + 1), 4095).astype(np.uint64)
    lines = _written(worded_lines(df, rank).withColumn("id", F.monotonically_increasing_id()))
    # About where a line stands in the order of doc_id, in 31 bits; it chooses heads, any choice gives the same result.
    low, high = lines.filter(F.col("d") < LAST).agg(F.min("d"), F.max("d")).first()
    span = float(high - low + 1) if low is not None else 1.0
    early = F.when(F.col("d") == LAST, F.lit((1 << 31) - 1)).otherwise(((F.col("d").cast("double") - F.lit(float(low or 0))) / span * ((1 << 31) - 2)).cast("int"))
    sets = lines.filter("words IS NOT NULL").select("id", "n", "h1", "h2", "bits", "more", early.alias("early"), "words")
    # (doc_id, line) as one number, so that its least is a plain hash aggregate.
    place = F.col("d").cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(10,0)") + F.col("line")
    place = place.cast("decimal(38,0)")
    classes = lines.filter("line >= 0").groupBy("h1", "h2").agg(F.min(place).alias("first"))
    found = materialised(listed(sets, how))
    verified = _verified(found.filter("head").select("a", "b"), sets, how)
    by_head = materialised(_ranked(verified, classes))
    # Lines of removed classes, and further rows of a class, need no other partner.
    over = by_head.filter("a_gone").select(F.col("a").alias("id")).union(by_head.filter("b_gone OR same").select(F.col("b").alias("id"))).distinct()
    places = found.filter("word IS NOT NULL").select("word", F.col("a").alias("id"), "n", "i", "bits", "more")
    still = places.join(over, "id", "left_anti").alias("x")
    y = places.alias("y")
    reach = 1 + F.least(F.col("x.n") - F.col("x.i") - 1, F.col("y.n") - F.col("y.i") - 1)
    test = (F.col("x.id") != F.col("y.id")) & how.length_ok(F.col("x.n"), F.col("y.n")) & how.overlap_ok(reach, F.col("x.n"), F.col("y.n"))
    one = F.expr("bit_count(x.bits ^ x.more ^ y.bits ^ y.more)")
    two = F.expr("bit_count(x.bits ^ y.bits) + bit_count(x.more ^ y.more)")
    test = test & how.bits_ok(F.when((F.col("x.n") >= LONG_SET) & (F.col("y.n") >= LONG_SET), two).otherwise(one), F.col("x.n"), F.col("y.n"))
    rest = still.join(y, (F.col("x.word") == F.col("y.word")) & test).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))
    others = _ranked(_verified(found.filter("NOT head").select("a", "b").union(rest), sets, how), classes)
    removed = _gone(by_head).union(_gone(others)).distinct()
    judged = (
        lines.select("d", "t", "line", "h1", "h2").join(classes.join(removed.withColumn("gone", F.lit(True)), ["h1", "h2"], "left"), ["h1", "h2"], "left")
        .withColumn("out", (F.col("line") >= 0) & (F.col("gone").isNotNull() | (place > F.col("first"))))
    )
    return judged.groupBy("d", "t").agg(
        F.size(F.collect_set(F.when(F.col("line") >= 0, F.col("line")))).cast("long").alias("n_lines"),
        F.sort_array(F.collect_set(F.when(F.col("out"), F.col("line")))).alias("removed"),
    )


def _ranked(links: DataFrame, classes: DataFrame) -> DataFrame:
    """Links with which of the two is gone, or that both are one class."""
    side = lambda k: classes.select(*[F.col(c).alias(f"{c}_{k}") for c in ("h1", "h2", "first")])
    same = (F.col("h1_a") == F.col("h1_b")) & (F.col("h2_a") == F.col("h2_b"))
    placed = links.join(side("a"), ["h1_a", "h2_a"]).join(side("b"), ["h1_b", "h2_b"])
    return placed.select("a", "b", "h1_a", "h2_a", "h1_b", "h2_b", same.alias("same"), (F.col("first_a") > F.col("first_b")).alias("a_gone"), (F.col("first_b") > F.col("first_a")).alias("b_gone"))


def _gone(links: DataFrame) -> DataFrame:
    pick = lambda k: links.filter(f"{k}_gone").select(F.col(f"h1_{k}").alias("h1"), F.col(f"h2_{k}").alias("h2"))
    return pick("a").union(pick("b"))


def without_repeated_lines(df: DataFrame, how: Similarity = Similarity()) -> DataFrame:
    """``df`` with the removed lines taken out of ``text``; no row is dropped."""
    verdicts = line_verdicts(df, how).filter(F.size("removed") > 0).select(F.col("d").alias("__d"), F.col("t").alias("__t"), F.col("removed").alias("__removed"))
    keyed = df.withColumn("__d", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))).withColumn("__t", F.xxhash64("text"))
    kept = F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains("__removed", i))
    text = F.when(F.col("__removed").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return keyed.join(verdicts, ["__d", "__t"], "left").withColumn("text", text).select(df.columns)
