"""Mixing sources to target weights, block by block.

A text's words (runs of anything but space and U+0009 to U+000D) are its
tokens. Sources are packed, text after text in the order of their ids, into
blocks of a fixed length (the last of a source is shorter). A source takes
part with its target in words, cut into slots of a block each: whole rounds
over its blocks, then a part of one, of which the last slot may be cut short,
so the words taken meet the target. Every output shard draws its slots'
sources as a multinomial with the slots' shares; slots drawn beyond a source's
number go, in order, to sources that were drawn too rarely. The k-th slot of a
source maps to a block by a pseudorandom permutation of the round's block
indexes, and slots meet the blocks' pieces in an equality join by (source, block).

Texts are not moved, unless asked for; a source of any size is spread over
ranges, shards and blocks. What the driver sees are sums.

Targets: sources stand by code point, null last, and weigh ``weights`` in turn;
they share ``share`` times all words, none above ``limit`` times its own; the excess
is shared again by weight until none is above. No text is taken more than
ceil(``limit``) times. A null or empty text has no words and is taken 0 times; a
source without words has target 0; an empty table gives no rows. Null ids come
first; rows that share an id are ordered by size and a digest of their text, and
equal rows are interchangeable. Other columns take no part, whatever their names.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegrain.functions.columns import let
from sitegrain.llm.common import BLANKS
from sitegrain.llm.ordering import positions
from sitegrain.session import materialised

#: Parts of a round key: bits, and the bits of an index that one factor takes.
_BITS, _LOW = 40, 20


#: Slots that a task writes out at once, about.
SLOTS = 1 << 16


@dataclasses.dataclass(frozen=True)
class Mix:
    """Words of a block, slots of a shard, rounds of a permutation, and the targets' rule."""

    block: int = 256
    shard: int = 4096
    rounds: int = 24
    seed: int = 0
    weights: tuple[int, ...] = (3, 1, 2)
    share: float = 1.5
    limit: int = 2


def word_count(text: Column) -> Column:
    """Number of words, without an array of them."""
    marks = F.translate(F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "x"), BLANKS, "")
    return F.coalesce(F.length(marks), F.lit(0)).cast("long")


def targets(sources: DataFrame, mix: Mix) -> DataFrame:
    """(key, sid, source_size, target) of sources(key, source_size), key by code point."""
    ranked = positions(sources, [], ["key"]).withColumnRenamed("pos", "sid")
    weight = F.element_at(F.array(*[F.lit(w) for w in mix.weights]), (F.col("sid") % len(mix.weights) + 1).cast("int"))
    ranked = materialised(ranked.select("key", "sid", "source_size", weight.alias("weight")))
    most = F.col("source_size") * mix.limit
    total = mix.share * (ranked.agg(F.sum("source_size")).first()[0] or 0)
    rate, before = 0.0, None
    while before != rate:  # rises until no source is newly at its limit
        held = most < F.col("weight") * F.lit(rate)
        full, free = ranked.agg(F.sum(F.when(held, most)), F.sum(F.when(~held, F.col("weight")))).first()
        before, rate = rate, (total - (full or 0)) / free if free else rate
    return ranked.select("key", "sid", "source_size", F.least(most.cast("double"), F.col("weight") * F.lit(rate)).alias("target"))


def _slots_of(sources: DataFrame, mix: Mix) -> DataFrame:
    """Sources that take part, with blocks a round, slots, the words of the last slot, and round keys."""
    b = mix.block
    words = F.floor(F.col("target") + 0.5).cast("long")
    rest = F.pmod(words, F.col("source_size"))
    out = sources.filter("source_size > 0 AND target > 0").withColumns({
        "full": F.expr(f"source_size div {b}"), "per_round": F.expr(f"(source_size + {b - 1}) div {b}"),
    })
    slots = F.floor(words / F.col("source_size")) * F.col("per_round") + F.floor((rest + (b - 1)) / b)
    rounds = F.sequence(F.lit(0), F.lit(mix.rounds - 1))

    def keys(turn: int) -> Column:
        digest = lambda r: F.md5(F.concat_ws("|", F.lit(str(mix.seed)), F.col("sid").cast("string"), F.lit(str(turn)), r.cast("string")))
        part = lambda d, i: F.conv(F.substring(d, 10 * i + 1, 10), 16, 10).cast("long")
        parts = F.transform(F.transform(rounds, digest), lambda d: F.struct(part(d, 0).alias("k"), part(d, 1).alias("a"), part(d, 2).alias("b")))
        return parts

    return out.select(
        "sid", "full", "per_round", slots.cast("long").alias("slots"), F.pmod(rest, F.lit(b)).alias("last"),
        F.array(*[keys(i) for i in range(mix.limit)]).alias("keys"),
    ).filter("slots > 0")


def permuted(index: Column, n: Column, keys: Column) -> Column:
    """``index`` below ``n`` under a swap-or-not permutation: each round may swap x with key - x.

    A round's bit is a linear form of the larger of the two, by its key, at bit 40.
    """

    def turn(x: Column, key: Column) -> Column:
        other = F.pmod(key["k"] % n + n - x, n)
        far = F.greatest(x, other)
        low, high = far.bitwiseAND(F.lit((1 << _LOW) - 1)), F.shiftright(far, _LOW)
        bit = F.shiftright(low * (key["a"] * 2 + 1) + high * (key["b"] * 2 + 1) + key["k"], _BITS).bitwiseAND(F.lit(1))
        return F.when(bit == 1, other).otherwise(x)

    return F.aggregate(keys, index, turn)


def _drawn(sources: DataFrame, mix: Mix) -> DataFrame:
    """(shard, sid, first, count): every shard's slots as runs of its sources' slots."""
    spark = sources.sparkSession
    total = sources.agg(F.sum("slots")).first()[0] or 0
    placed = positions(sources.select(F.lit(0).alias("all"), "sid", "slots"), ["all"], ["sid"], "slots").select("sid", "slots", "before")
    placed = materialised(placed)
    # A slot draws a number below the total; the source in whose run it lies is found through runs of 64 numbers.
    wide = 64
    runs = placed.withColumn("run", F.explode(F.sequence(F.expr(f"before div {wide}"), F.expr(f"(before + slots - 1) div {wide}"))))
    draw = F.pmod(F.xxhash64(F.col("id"), F.lit(mix.seed)), F.lit(max(total, 1)))
    slots = spark.range(total).select(F.expr(f"id div {mix.shard}").alias("shard"), draw.alias("draw")).withColumn("run", F.expr(f"draw div {wide}"))
    counts = slots.join(runs, "run").filter("draw >= before AND draw < before + slots").groupBy("shard", "sid").agg(F.count("*").alias("count"))
    counts = positions(materialised(counts), ["sid"], ["shard"], "count").select("shard", "sid", "count", F.col("before").alias("first"))
    counts = materialised(counts.join(sources.select("sid", "slots"), "sid"))
    kept = counts.select("shard", "sid", "first", F.least(F.col("count"), F.col("slots") - F.col("first")).alias("count")).filter("count > 0")
    # Drawn too often: numbered through; drawn too rarely: their missing slots numbered alike.
    over = counts.select(F.lit(0).alias("all"), "shard", "sid", (F.col("first") + F.col("count") - F.greatest("first", "slots")).alias("over")).filter("over > 0")
    over = positions(over, ["all"], ["sid", "shard"], "over").select("shard", F.explode(F.sequence("before", F.col("before") + F.col("over") - 1)).alias("u"))
    had = counts.groupBy("sid").agg(F.sum("count").alias("had"))
    short = sources.select("sid", "slots").join(had, "sid", "left").select(F.lit(0).alias("all"), "sid", "slots", (F.col("slots") - F.coalesce("had", F.lit(0))).alias("short")).filter("short > 0")
    short = positions(short, ["all"], ["sid"], "short")
    short = short.select("sid", (F.col("slots") - F.col("short")).alias("had"), "before", F.explode(F.sequence(F.col("before"), F.col("before") + F.col("short") - 1)).alias("u"))
    moved = over.join(short, "u").select("shard", "sid", (F.col("had") + F.col("u") - F.col("before")).alias("first"), F.lit(1).cast("long").alias("count"))
    return kept.unionByName(moved)


def slots(sources: DataFrame, mix: Mix) -> DataFrame:
    """(shard, sid, k, block, words): the blocks each shard takes, and how many words of each at most."""
    taking = materialised(_slots_of(sources, mix))
    # A run of a few bytes stands for thousands of slots: runs are dealt out by their slots, not by their size.
    parts = 1 + (taking.agg(F.sum("slots")).first()[0] or 0) // SLOTS
    runs = _drawn(taking, mix).join(taking, "sid").repartition(parts, "shard", "sid")
    one = runs.withColumn("k", F.explode(F.sequence("first", F.col("first") + F.col("count") - 1)))
    turn, at = F.expr("k div per_round"), F.expr("k % per_round")
    block = F.when(at < F.col("full"), permuted(at, F.col("full"), F.element_at("keys", (turn + 1).cast("int")))).otherwise(at)
    words = F.when((F.col("k") == F.col("slots") - 1) & (F.col("last") > 0), F.col("last")).otherwise(F.lit(mix.block))
    return one.select("shard", "sid", "k", block.alias("block"), words.cast("long").alias("words"))


@dataclasses.dataclass(frozen=True)
class Mixture:
    """``docs``: id, size, source_size, target, and the row's key (sid, pos); ``spans``: the mix.

    spans(shard, sid, k, block, offset, pos, start, length, [text]): slot k of source sid
    lies in the shard; at offset in it stand length words of the source's row pos, from start.
    """

    docs: DataFrame
    spans: DataFrame


def mixed(df: DataFrame, mix: Mix = Mix(), id_col: str = "doc_id", text: str = "text", source: str = "source", with_text: bool = False) -> Mixture:
    """The mixture of all of ``df``'s texts; with their words, where asked for."""
    key = F.coalesce(F.concat(F.lit("-"), F.col(source).cast("string")), F.lit("="))  # by code point, null last
    rows = df.select(key.alias("key"), F.col(id_col).alias("__id"), word_count(F.col(text)).alias("size"), F.xxhash64(text).alias("__text"), *([F.col(text).alias("__words")] if with_text else []))
    rows = materialised(rows)
    sources = materialised(targets(rows.groupBy("key").agg(F.sum("size").alias("source_size")), mix))
    placed = positions(rows, ["key"], ["__id", "size", "__text"], "size").drop("__text", "n")
    placed = materialised(placed.join(sources, "key").drop("key"))
    b = mix.block
    words = F.filter(F.split("__words", r"[\x20\x09-\x0D]+"), lambda w: w != "") if with_text else F.array().cast("array<string>")

    def piece(block: Column, w: Column) -> Column:
        start = F.greatest(F.lit(0), block * b - F.col("before"))
        length = F.least(F.col("size"), (block + 1) * b - F.col("before")) - start
        cut = [F.slice(w, (start + 1).cast("int"), length.cast("int")).alias("text")] if with_text else []
        return F.struct(block.alias("block"), start.alias("start"), length.alias("length"), (F.col("before") + start - block * b).alias("offset"), *cut)

    blocks = F.sequence(F.expr(f"before div {b}"), F.expr(f"(before + size - 1) div {b}"))
    cuts = let(words, lambda w: F.transform(blocks, lambda k: piece(k, w)))
    pieces = placed.filter("size > 0 AND target > 0").select("sid", "pos", F.inline(cuts))
    spans = slots(sources, mix).join(pieces, ["sid", "block"]).filter("offset < words")
    spans = spans.withColumn("length", F.least(F.col("length"), F.col("words") - F.col("offset"))).drop("words")
    if with_text:
        spans = spans.withColumn("text", F.array_join(F.slice("text", F.lit(1), F.col("length").cast("int")), " "))
    return Mixture(placed.select("sid", "pos", F.col("__id").alias(id_col), "size", "source_size", "target"), spans)


def taken(mixture: Mixture) -> DataFrame:
    """The rows with ``taken``, the words the mix takes of each, repeats counted."""
    sums = mixture.spans.groupBy("sid", "pos").agg(F.sum("length").alias("taken"))
    out = mixture.docs.join(sums, ["sid", "pos"], "left")
    return out.withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long")).drop("sid", "pos")
