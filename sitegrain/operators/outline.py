"""Structure outline: the element tree of a page, flattened in document order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegrain import constants as K
from sitegrain.functions.columns import fold_emitting, last, let
from sitegrain.functions.text import collapse
from sitegrain.operators.tokens import attribute

_STACK = "array<struct<ord:int,tag:string,children:int>>"
_OUT = "array<struct<ord:int,parent:int,depth:int,last:int,children:int>>"


def fold_nodes(events: Column) -> Column:
    """Events → array<struct(ord, parent, depth, last, children, tag, element_id, classes, line)>.

    A fold with a stack of open elements: an end tag closes up to its nearest
    open match and is ignored without one; an open paragraph is closed by the
    elements that imply it.  Running sums cannot do this on broken markup.

    Nodes are nested sets: ``ord`` is the number at entry, ``last`` the highest
    number at exit, so a subtree has last - ord + 1 nodes and no later question
    about descendants or children needs the other nodes.
    """
    turns = F.filter(
        events, lambda e: (e["kind"] != "raw") & e["tag"].isin(sorted({*K.STRUCTURAL_TAGS, *K.CLOSES_PARAGRAPH}))
    )

    def cut_to(stack: Column, tag: Column) -> Column:
        """The stack below the nearest open ``tag``, or unchanged."""
        depth = F.size(stack) - F.array_position(F.reverse(F.transform(stack, lambda s: s["tag"])), tag)
        return F.when(
            F.exists(stack, lambda s: s["tag"] == tag), F.slice(stack, F.lit(1), depth.cast("int"))
        ).otherwise(stack)

    def step(acc: Column, e: Column) -> tuple[dict[str, Column], Column]:
        # ``block``: the element the text capture last opened, '' once closed;
        # only an open paragraph there is closed implicitly.
        is_start = e["kind"] == "start"
        structural = e["tag"].isin(K.STRUCTURAL_TAGS)
        implied = is_start & (acc["block"] == "p") & e["tag"].isin(K.CLOSES_PARAGRAPH)
        cut = F.when(implied, F.lit("p")).otherwise(F.when(~is_start, e["tag"]))
        stack = let(cut, lambda t: F.when(t.isNull(), acc["stack"]).otherwise(cut_to(acc["stack"], t)))
        opens = is_start & structural
        n = acc["n"] + 1
        pushed = F.array(F.struct(n.alias("ord"), e["tag"].alias("tag"), F.lit(0).alias("children")))

        def closed(s: Column) -> Column:
            """Nodes of the open elements beyond ``s``; n is the last number given."""
            return closing(acc["stack"], F.size(s), acc["n"])

        def placed(s: Column) -> Column:
            top = last(s)
            counted = F.struct(top["ord"].alias("ord"), top["tag"].alias("tag"), (top["children"] + 1).alias("children"))
            below = F.when(opens & (F.size(s) > 0), F.concat(F.slice(s, F.lit(1), F.size(s) - 1), F.array(counted)).cast(_STACK)).otherwise(s)
            leaf = F.struct(
                n.alias("ord"), F.coalesce(top["ord"], F.lit(0)).alias("parent"), F.size(s).alias("depth"),
                n.alias("last"), F.lit(0).alias("children"),
            )
            void = e["tag"].isin(K.VOID_TAGS)
            return F.struct(
                F.when(opens & ~void, F.concat(below, pushed)).otherwise(below).cast(_STACK).alias("stack"),
                F.concat(closed(s), F.when(opens & void, F.array(leaf).cast(_OUT)).otherwise(F.array().cast(_OUT))).alias("nodes"),
            )

        block = (
            F.when(is_start & e["tag"].isin("p", *K.HEADING_TAGS), e["tag"])
            .when(implied | (~is_start & (acc["block"] == e["tag"])), F.lit(""))
            .otherwise(acc["block"])
        )
        now = let(stack, placed)
        return {"n": F.when(opens, n).otherwise(acc["n"]), "block": block, "stack": now["stack"]}, now["nodes"]

    def closing(stack: Column, kept: Column, n: Column) -> Column:
        def node(f: Column, i: Column) -> Column:
            at = kept + i
            return F.struct(
                f["ord"].alias("ord"), F.when(at > 0, F.get(stack, at - 1)["ord"]).otherwise(F.lit(0)).alias("parent"),
                at.alias("depth"), n.alias("last"), f["children"].alias("children"),
            )

        return F.transform(F.slice(stack, kept + 1, F.size(stack)), node).cast(_OUT)

    zero = {"n": F.lit(0), "block": F.lit(""), "stack": F.array().cast(_STACK)}
    whole = lambda end: F.array_sort(F.concat(end["out"], closing(end["stack"], F.lit(0), end["n"])))
    placed = let(fold_emitting(turns, zero, step, _OUT), whole)
    starts = F.filter(turns, lambda e: (e["kind"] == "start") & e["tag"].isin(K.STRUCTURAL_TAGS))
    read = F.transform(
        starts,
        lambda e: F.struct(e["tag"].alias("tag"), e["line"].alias("line"), e["attrs"].alias("a")),
    )
    return F.zip_with(
        placed, read,
        lambda p, e: F.struct(
            p["ord"].alias("ord"), p["parent"].alias("parent"), p["depth"].alias("depth"),
            p["last"].alias("last"), p["children"].alias("children"),
            e["tag"].alias("tag"), attribute(e["a"], "id").alias("element_id"),
            F.filter(
                F.split(collapse(F.coalesce(attribute(e["a"], "class"), F.lit(""))), " "), lambda c: c != ""
            ).alias("classes"),
            e["line"].alias("line"),
        ),
    )


def node_selector(tag: Column, element_id: Column, classes: Column) -> Column:
    """tag#id.class, the first three classes."""
    return F.concat(
        tag,
        F.when(F.coalesce(element_id, F.lit("")) != "", F.concat(F.lit("#"), element_id)).otherwise(F.lit("")),
        F.array_join(F.transform(F.slice(classes, 1, 3), lambda c: F.concat(F.lit("."), c)), ""),
    )


def structure_outline(
    pages: DataFrame, max_nodes: int = K.OUTLINE_MAX_NODES, max_depth: int = K.OUTLINE_MAX_DEPTH
) -> DataFrame:
    """page_id, nodes → kept rows plus what was left out.

    In document order a subtree too deep is a run of nodes deeper than the
    limit, so the kept nodes are the first ``max_nodes`` of those within the
    depth.  Past the node limit each remaining subtree is counted whole, its
    too-deep part included, because it is not entered any more.
    """
    nodes = F.col("nodes")
    kept = let(F.filter(nodes, lambda n: n["depth"] <= max_depth), lambda shallow: F.slice(shallow, 1, max_nodes))

    def counted(rows: Column) -> Column:
        # A kept node at the depth limit leaves out all below it.
        under = F.aggregate(
            F.filter(rows, lambda n: n["depth"] == max_depth), F.lit(0), lambda acc, n: acc + n["last"] - n["ord"]
        )
        return F.struct(
            rows.alias("rows"),
            F.size(nodes).alias("total_nodes"),
            F.coalesce(F.array_max(F.transform(nodes, lambda n: n["depth"])), F.lit(0)).alias("max_depth"),
            under.alias("truncated_by_depth"),
            (F.size(nodes) - F.size(rows) - under).alias("truncated_by_count"),
        )

    return pages.withColumn("outline", let(kept, counted))


def outline_rows(outlined: DataFrame) -> DataFrame:
    df = outlined.select("page_id", F.posexplode("outline.rows").alias("p", "r"))
    return df.select(
        "page_id", (F.col("p") + 1).alias("ord"), F.col("r.depth").alias("depth"), F.col("r.tag").alias("tag"),
        node_selector(F.col("r.tag"), F.col("r.element_id"), F.col("r.classes")).alias("selector"),
        F.col("r.line").alias("line"), F.col("r.children").alias("children"),
    )


def outline_tag_counts(outlined: DataFrame) -> DataFrame:
    rows = outlined.select("page_id", F.explode("outline.rows.tag").alias("tag"))
    return rows.groupBy("page_id", "tag").agg(F.count("*").alias("n"))
