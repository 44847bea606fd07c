"""Merkle manifest of a dataset, by pivoting slots.

A row's leaf is the SHA-256 of its fields, each written as ``-`` if null, else
as its UTF-8 byte count, ``:`` and its value (integers in decimals). Leaves of a
group stand by their order column; every ``fanout`` consecutive ones become
their parent, until one is left, the group's subroot; the subroots, by group,
likewise give the root. A level is one aggregation: conditional aggregates
spread a parent's children over ``fanout`` slot columns; the concatenated
columns hash to the parent, and the columns but a child's own are its
siblings. Levels are written as they are made, each a ``fanout``-th of the one
before; proofs are handed down from the root to the children of each parent.

Only digests and keys are moved, never texts, and no window spans a group.
Null order values come first; rows that share one are ordered by their leaf,
and equal rows are interchangeable. A null group comes before all others. A
group of one row has its leaf as subroot, a table of one group its subroot as
root. An empty table gives no rows. Other columns take no part, whatever their
names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegrain.llm.ordering import positions
from sitegrain.session import materialised

NODE = ["key", "pos", "n", "digest"]


def field(value: Column, kind: str) -> Column:
    """A field as the leaf takes it."""
    text = value if kind == "string" else value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(df: DataFrame, columns: list[str], instead: dict[str, Column] | None = None) -> Column:
    """The leaf of a row as binary, some fields replaced by other values."""
    kinds = dict(df.dtypes)
    return _hashed(F.concat(*[field((instead or {}).get(c, F.col(c)), kinds[c]) for c in columns]))


def _hashed(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def shown(digest: Column) -> Column:
    """A digest as lower-case hex, the form that is hashed again."""
    return F.lower(F.hex(digest))


def _joined(slots: list[Column]) -> Column:
    return F.concat_ws("", *[shown(s) for s in slots]) if slots else F.lit("")


def climb(nodes: DataFrame, carried: list[str], fanout: int) -> list[DataFrame]:
    """The levels above nodes(key, pos, n, digest), each written; a key's last has n = 1.

    A parent's row holds its children, with what they carry, in slot columns.
    """
    levels: list[DataFrame] = []
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        child = F.struct("digest", *([] if levels else carried))
        slots = [F.max(F.when(F.pmod("pos", F.lit(fanout)) == i, child)).alias(f"s{i}") for i in range(fanout)]
        spread = nodes.filter("n > 1").groupBy("key", F.expr(f"pos div {fanout}").alias("pos"), F.expr(f"(n + {fanout - 1}) div {fanout}").alias("n")).agg(*slots)
        levels.append(materialised(spread.withColumn("digest", _hashed(_joined([F.col(f"s{i}.digest") for i in range(fanout)])))))
        nodes, most = levels[-1], -(-most // fanout)
    return levels


def tops(nodes: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """(key, digest): what remains of every key."""
    out = nodes.filter("n = 1").select("key", "digest")
    for level in levels:
        out = out.unionByName(level.filter("n = 1").select("key", "digest"))
    return out


def hand_down(nodes: DataFrame, levels: list[DataFrame], above: DataFrame, carried: list[str], fanout: int) -> DataFrame:
    """Every node with its proof: ``above`` has each key's top, and the proof from there on.

    A proof is an array of (left, right) siblings, own level first.
    """
    given = [c for c in above.columns if c not in ("key", "proof")]
    down = None
    for k, level in reversed(list(enumerate(levels))):
        known = level.filter("n = 1").join(above, "key")
        if down is not None:
            known = known.unionByName(level.filter("n > 1").join(down, ["key", "pos"]).select(known.columns))
        own = carried if k == 0 else []
        rows = []
        for i in range(fanout):
            side = lambda js: F.filter(F.array(*[F.col(f"s{j}.digest") for j in js]).cast("array<binary>"), lambda d: d.isNotNull())
            step = F.struct(side(range(i)).alias("left"), side(range(i + 1, fanout)).alias("right"))
            row = F.struct(
                "key", (F.col("pos") * fanout + i).alias("pos"), F.col(f"s{i}.digest").alias("digest"),
                F.concat(F.array(step), "proof").alias("proof"), *given, *[F.col(f"s{i}.{c}").alias(c) for c in own],
            )
            rows.append(F.when(F.col(f"s{i}").isNotNull(), row))
        down = known.select(F.inline(F.array_compact(F.array(*rows))))
        if k:  # written, so that a plan spans one level only
            down = materialised(down.drop("digest"))
    alone = nodes.filter("n = 1").join(above, "key").select("key", "pos", "digest", "proof", *given, *carried)
    return alone if down is None else alone.unionByName(down.select(alone.columns))


def manifest(df: DataFrame, columns: list[str], group: str, order: str, kept: dict[str, Column], fanout: int = 3) -> DataFrame:
    """(digest, proof, subroot, root, *kept): every row of ``df`` with its leaf and proof.

    ``group`` is taken as text. The root is one value, known when the levels are.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-"))  # null first, else by bytes
    rows = df.select(key.alias("key"), F.col(order).alias("__order"), leaf_digest(df, columns).alias("digest"), *[c.alias(n) for n, c in kept.items()])
    rows = materialised(rows)  # dealing by ranges looks at the rows twice
    leaves = materialised(positions(rows, ["key"], ["__order", "digest"]).select(*NODE, *kept))
    levels = climb(leaves, [*kept], fanout)
    subroots = materialised(tops(leaves, levels).withColumnRenamed("key", "group_key").withColumn("key", F.lit("")))
    subroots = materialised(positions(subroots, ["key"], ["group_key"]))
    upper = climb(subroots, ["group_key"], fanout)
    top = tops(subroots, upper).first()
    root = F.lit(bytes(top.digest) if top else None).cast("binary")
    nothing = F.array().cast("array<struct<left:array<binary>,right:array<binary>>>")
    start = subroots.sparkSession.range(1).select(F.lit("").alias("key"), nothing.alias("proof"))
    above = hand_down(subroots, upper, start, ["group_key"], fanout)
    above = materialised(above.select(F.col("group_key").alias("key"), "proof", F.col("digest").alias("subroot")))
    return hand_down(leaves, levels, above, [*kept], fanout).select("digest", "proof", "subroot", root.alias("root"), *kept)


def proof_digest(proof: Column) -> Column:
    """SHA-256 of all siblings of a proof, level by level, left to right."""
    text = lambda ds: F.array_join(F.transform(ds, shown), "")
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(text(s["left"]), text(s["right"]))), ""), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root, as hex, that a leaf and its proof lead to."""
    text = lambda ds: F.array_join(F.transform(ds, shown), "")
    return F.aggregate(proof, shown(leaf), lambda acc, s: F.sha2(F.concat(text(s["left"]), acc, text(s["right"])), 256))
