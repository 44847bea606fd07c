"""Small JSON-LD building blocks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitegrain.functions.columns import fold_emitting, last, let

CONTEXT = "https://schema.org"


def node(kind: str, *fields: Column, context: bool = False) -> Column:
    """struct(@context?, @type, fields...); NULL fields vanish in to_json."""
    head = [F.lit(CONTEXT).alias("@context")] if context else []
    return F.struct(*head, F.lit(kind).alias("@type"), *fields)


def node_if(value: Column, kind: str, field: str) -> Column:
    """A node with the value in one field, NULL without the value."""
    return F.when(value.isNotNull(), node(kind, value.alias(field)))


def script_block(json: Column) -> Column:
    """Ready to paste into the head; '' stays ''."""
    return F.when(F.coalesce(json, F.lit("")) == "", F.lit("")).otherwise(
        F.concat(F.lit('<script type="application/ld+json">\n'), json, F.lit("\n</script>"))
    )


# --- declared types ---------------------------------------------------------

#: Tokens of a JSON text; blanks fall between them, any other character is a token that fits nowhere.
JSON_TOKEN = (
    r'"[^"\\\x00-\x1f]*+(?:\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})[^"\\\x00-\x1f]*+)*+"'
    r"|-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?(?:[eE][+-]?[0-9]++)?|-?Infinity|NaN|true|false|null|[{}\[\]:,]|[^ \t\n\r]"
)
#: Words of JSON texts and how a list of types shows them.
_SHOWN = {"true": "True", "false": "False", "null": "None", "NaN": "nan", "Infinity": "inf", "-Infinity": "-inf"}
_KEYS = "array<struct<k:string,at:int>>"
_FRAMES = f"array<struct<id:int,kind:string,owner:int,keys:{_KEYS}>>"
_FOUND = "array<struct<owner:int,id:int,upto:int,text:string>>"


def _string(token: Column) -> Column:
    """The text of a JSON string token."""
    plain = F.substr(token, F.lit(2), F.length(token) - 2)
    escaped = F.get(F.from_json(F.concat(F.lit("["), token, F.lit("]")), "array<string>"), F.lit(0))
    return F.when(F.contains(token, F.lit("\\")), escaped).otherwise(plain)


def declared_types(block: Column) -> Column:
    """@type values of one JSON text, an outer node before those in it; ["(unparseable)"] if it is none.

    One pass over the tokens with a stack of open objects and lists decides
    validity and finds the types.  Values are numbered as they begin, so what a
    repeated key had before is a run of numbers, which is left out in the
    end: the last value counts.  NaN and Infinity are taken.  List items that are
    strings, numbers or words count as written; items that hold types of their
    own are read as nodes.
    """
    tokens = F.regexp_extract_all(block, F.lit(JSON_TOKEN), F.lit(0))
    none = F.array().cast(_FOUND)

    def step(acc: Column, t: Column) -> tuple[dict[str, Column], Column]:
        want, stack, top, number = acc["want"], acc["stack"], last(acc["stack"]), acc["n"] + 1
        is_string = t.startswith('"') & (F.length(t) >= 2)
        is_word = t.rlike("^(?:-?[0-9]|-?I|NaN|true|false|null)")
        opens, closes = t.isin("{", "["), t.isin("}", "]")
        of_object = F.coalesce(top["kind"] == "o", F.lit(False))
        is_key = is_string & want.isin("key or end", "key")
        is_value = (is_string | is_word | opens) & want.isin("value", "value or end")
        ends = F.when(t == "}", of_object & want.isin("key or end", "more")).otherwise(~of_object & (F.size(stack) > 0) & want.isin("value or end", "more"))
        fits = F.when(is_key | is_value, F.lit(True)).when(t == ":", want == "colon").when(t == ",", want == "more").when(closes, ends).otherwise(F.lit(False))
        below = F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 1, F.lit(0)))

        def after(left: Column) -> Column:
            return F.when(left, F.lit("nothing")).otherwise(F.lit("more"))

        now = (
            F.when(~fits, F.lit("never"))
            .when(is_key, F.lit("colon"))
            .when(t == ":", F.lit("value"))
            .when(t == ",", F.when(of_object, F.lit("key")).otherwise(F.lit("value")))
            .when(t == "{", F.lit("key or end"))
            .when(t == "[", F.lit("value or end"))
            .when(closes, after(F.size(stack) == 1))
            .otherwise(after(F.size(stack) == 0))
        )
        typed = of_object & (acc["key"] == "@type")
        frame = F.struct(
            number.alias("id"), F.when(t == "{", F.lit("o")).otherwise(F.lit("a")).alias("kind"),
            F.when(typed & (t == "["), top["id"]).otherwise(F.lit(-1)).alias("owner"), F.array().cast(_KEYS).alias("keys"),
        )
        name = F.when(is_key, _string(t))
        noted = F.struct(
            top["id"].alias("id"), top["kind"].alias("kind"), top["owner"].alias("owner"),
            F.concat(top["keys"], F.array(F.struct(name.alias("k"), number.alias("at")))).alias("keys"),
        )
        stacked = (
            F.when(fits & is_key, F.concat(below, F.array(noted)).cast(_FRAMES))
            .when(fits & opens, F.concat(stack, F.array(frame)).cast(_FRAMES))
            .when(fits & closes, below)
            .otherwise(stack)
        )

        def replaced(keys: Column) -> Column:
            """The numbers that the key's value so far has."""
            before = F.size(keys) - F.array_position(F.reverse(F.transform(keys, lambda x: x["k"])), name)
            upto = F.coalesce(F.get(keys, (before + 1).cast("int"))["at"], number) - 1
            return F.array(F.struct(F.lit(-1).alias("owner"), F.get(keys, before.cast("int"))["at"].alias("id"), upto.cast("int").alias("upto"), F.lit(None).cast("string").alias("text")))

        owner = F.when(typed & is_string, top["id"]).when(~of_object & (top["owner"] >= 0) & ~opens, top["owner"])
        shown = F.when(is_string, _string(t))
        for word, text in _SHOWN.items():
            shown = shown.when(t == word, F.lit(text))
        type_row = F.array(F.struct(owner.alias("owner"), number.alias("id"), F.lit(None).cast("int").alias("upto"), shown.otherwise(t).alias("text")))
        found = (
            F.when(fits & is_key & F.exists(top["keys"], lambda x: x["k"] == name), replaced(top["keys"]).cast(_FOUND))
            .when(fits & is_value & owner.isNotNull(), type_row.cast(_FOUND))
            .otherwise(none)
        )
        return {"want": now, "stack": stacked, "n": F.when(fits & is_value, number).otherwise(acc["n"]), "key": F.coalesce(name, acc["key"])}, found

    def listed(end: Column) -> Column:
        gone = F.filter(end["out"], lambda r: r["upto"].isNotNull())
        kept = F.filter(end["out"], lambda r: r["upto"].isNull() & ~F.exists(gone, lambda g: (g["id"] <= r["id"]) & (r["id"] <= g["upto"])))
        return F.when(end["want"] == "nothing", F.transform(F.array_sort(kept), lambda r: r["text"])).otherwise(F.array(F.lit("(unparseable)")))

    zero = {"want": F.lit("value"), "stack": F.array().cast(_FRAMES), "n": F.lit(0), "key": F.lit("")}
    return let(fold_emitting(tokens, zero, step, _FOUND), listed)
