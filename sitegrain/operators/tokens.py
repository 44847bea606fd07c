"""Markup as ordered tokens and events, page by page, without a shuffle.

Each page row carries arrays: its tokens, the tag events among them and its
visible text runs.  Everything is built-in expressions, so the work is one
narrow stage whatever the number of pages.

Line numbers would need a running sum over the tokens.  Instead every '<' is
marked with its line number before tokenising, which is linear and page-local.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegrain.constants import QUIET_TAGS, VOID_TAGS
from sitegrain.functions import urls
from sitegrain.functions.columns import fold_emitting, let, remembered, staged
from sitegrain.functions.text import strip, unescape

_OPEN, _CLOSE, _OFF, _STRAY, _OWN = "\x01", "\x02", "\x03", "\x04", "\x05"
#: How a page's own characters of these are written while it is marked, the last first.
_WRITTEN = {_OWN: _OWN + "e", _OPEN: _OWN + "a", _CLOSE: _OWN + "b", _OFF: _OWN + "c", _STRAY: _OWN + "d"}
_MARK = r"\x01\d+\x02"

def token_pattern(mark: str = "", off: str = "", many: str = "*+") -> str:
    """``many``: possessive, so that Java's matcher does not recurse once per quoted
    attribute; engines without it take the plain ``*``, which matches the same."""
    lt = "<" + mark
    tail = r"""[^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)""" + many + ">"
    return (
        rf"(?is){lt}!--.*?-->"
        rf"|{lt}script\b[^>]*>.*?{lt}/script\s*>"
        rf"|{lt}style\b[^>]*>.*?{lt}/style\s*>"
        rf"|{lt}{off}[a-z/!?]{tail}"
        rf"|{lt}{off}[a-z/!?][^>]*>"
        rf"|{lt}"
        r"|[^<]+"
    )


ATTRIBUTE = r"""[^\s/>][^\s/=>]*(?:\s*=+\s*(?:'[^']*'|"[^"]*"|[^>\s"'][^>\s]*)?)?"""


def _written(c: Column) -> Column:
    for own, text in _WRITTEN.items():
        c = F.replace(c, F.lit(own), F.lit(text))
    return c


def _read(c: Column) -> Column:
    """The page's own characters again."""
    read = c
    for own, text in reversed(_WRITTEN.items()):
        read = F.replace(read, F.lit(text), F.lit(own))
    return F.when(F.contains(c, F.lit(_OWN)), read).otherwise(c)


def _marked(html: Column) -> Column:
    """Every '<' followed by its line number between two control characters."""
    plain = F.when(html.rlike("[\x01-\x05]"), _written(html)).otherwise(F.coalesce(html, F.lit("")))
    lines = F.split(plain, "\n")
    text = F.array_join(
        F.transform(
            lines,
            lambda l, i: F.replace(
                l, F.lit("<"), F.concat(F.lit("<" + _OPEN), (i + 1).cast("string"), F.lit(_CLOSE))
            ),
        ),
        "\n",
    )
    for opener, closer in (("!--", "--"), ("script", "/script"), ("style", "/style")):
        text = let(text, _disarming(opener, closer))
    return let(text, _tail_disarmed)


def _tail_disarmed(text: Column) -> Column:
    """Past the last '>' no '<' can open a tag; it is not tried there either."""
    tail = F.substring_index(text, ">", -1)
    return F.concat(
        F.left(text, F.length(text) - F.length(tail)),
        F.regexp_replace(tail, r"\x02([a-zA-Z/!?])", "\x02\x04$1"),
    )


def _disarming(opener: str, closer: str):
    """Openers past the last closer get a mark that stops them from being tried.

    They cannot match there; without the mark each would search to the end of
    the page, which is quadratic on a page with many.
    """
    last_end = rf"(?is)^.*{closer}>" if opener == "!--" else rf"(?is)^.*\x02{closer}\s*>"

    def apply(text: Column) -> Column:
        def cut(n: Column) -> Column:
            tail = F.substr(text, n + 1)
            return F.concat(F.left(text, n), F.regexp_replace(tail, rf"(?i)\x02{opener}", f"\x02\x03{opener}"))

        done = let(F.length(F.regexp_extract(text, last_end, 0)), cut)
        return F.when(text.rlike(rf"(?i)\x02{opener}"), done).otherwise(text)

    return apply


def unmarked(c: Column) -> Column:
    return F.when(c.rlike("[\x01-\x05]"), let(F.regexp_replace(c, _MARK + "|[\x03\x04]", ""), _read)).otherwise(c)


def raw_tokens(html: Column) -> Column:
    """array<string> of marked tokens; they re-concatenate to the page."""
    return F.regexp_extract_all(_marked(html), F.lit(token_pattern(_MARK, r"\x03?")), F.lit(0))


@remembered
def _events(tags: tuple[str, ...] | None, read: tuple[str, ...]) -> Column:
    """Tag events in order: struct(pos, kind start|end|raw, tag, line, body, attrs).

    Attributes are parsed once, here, and only for the tags in ``read``.
    """
    raw = F.col("raw")

    def cut(t: Column, i: Column) -> Column:
        at = F.instr(t, _CLOSE)
        return F.struct(
            i.alias("pos"),
            F.substring(t, 3, 12).alias("head"),
            F.when(t.startswith("<"), F.ltrim(F.substr(t, at + 1), F.lit(_OFF))).alias("rest"),
        )

    def named(c: Column) -> Column:
        rest = c["rest"]
        return F.struct(
            c["pos"].alias("pos"),
            F.when(rest.startswith("/"), F.lit("end"))
            .when(rest.rlike(r"(?is)<\x01\d+\x02/(?:script|style)\s*>$"), F.lit("raw"))
            .otherwise(F.lit("start"))
            .alias("kind"),
            F.lower(F.regexp_extract(rest, r"^/?\s*([a-zA-Z][^\s/>]*)", 1)).alias("tag"),
            F.regexp_extract(c["head"], r"^\d+", 0).cast("int").alias("line"),
            rest.alias("body"),
        )

    def final(e: Column) -> Column:
        return F.struct(
            e["pos"].alias("pos"),
            e["kind"].alias("kind"),
            e["tag"].alias("tag"),
            e["line"].alias("line"),
            F.when(e["kind"] == "end", F.lit("")).otherwise(unmarked(e["body"])).alias("body"),
        )

    def with_attributes(e: Column) -> Column:
        wanted = (e["kind"] != "end") & e["tag"].isin(*read) if read else F.lit(False)
        opening = F.when(e["kind"] == "raw", F.regexp_extract(e["body"], r"^[^>]*>", 0)).otherwise(e["body"])
        return F.struct(
            *[e[f].alias(f) for f in ("pos", "kind", "tag", "line", "body")],
            F.when(wanted, attributes(opening)).alias("attrs"),
        )

    def split_self_closed(e: Column) -> Column:
        closed = (
            (e["kind"] == "start")
            & e["body"].endswith("/>")
            & ~e["tag"].isin(VOID_TAGS)
            & ~e["body"].rlike(r"""=\s*[^\s"'>]+/>$""")
        )
        end = F.struct(
            e["pos"].alias("pos"), F.lit("end").alias("kind"), e["tag"].alias("tag"),
            e["line"].alias("line"), F.lit("").alias("body"),
            F.lit(None).cast("array<struct<name:string,value:string>>").alias("attrs"),
        )
        return F.when(closed, F.array(e, end)).otherwise(F.array(e))

    markup = F.filter(F.transform(raw, cut), lambda c: c["rest"].rlike(r"^(?:/\s*)?[a-zA-Z]"))
    kept = F.transform(markup, named)
    if tags is not None:
        kept = F.filter(kept, lambda e: e["tag"].isin(*tags))
    whole = F.transform(F.transform(kept, final), with_attributes)
    return F.flatten(F.transform(whole, split_self_closed))


@remembered
def _quiet_spans() -> Column:
    """Token ranges inside noscript, template or an unclosed script or style."""
    turns = F.filter("events", lambda e: e["tag"].isin(QUIET_TAGS) & (e["kind"] != "raw"))
    span_type = "array<struct<lo:int,hi:int>>"
    none = F.array().cast(span_type)

    def step(acc: Column, e: Column) -> tuple[dict[str, Column], Column]:
        up = e["kind"] == "start"
        depth = F.when(up, acc["depth"] + 1).otherwise(F.greatest(acc["depth"] - 1, F.lit(0)))
        lo = F.when(up & (acc["depth"] == 0), e["pos"]).otherwise(acc["lo"])
        span = F.array(F.struct(acc["lo"].alias("lo"), e["pos"].alias("hi")))
        return {"depth": depth, "lo": lo}, F.when(~up & (acc["depth"] == 1), span).otherwise(none)

    def closed(end: Column) -> Column:
        rest = F.array(F.struct(end["lo"].alias("lo"), F.lit(2147483647).alias("hi")))
        return F.when(end["depth"] > 0, F.concat(end["out"], rest)).otherwise(end["out"])

    walked = fold_emitting(turns, {"depth": F.lit(0), "lo": F.lit(-1)}, step, span_type)
    return F.when(F.size(turns) == 0, none).otherwise(let(walked, closed))


@remembered
def _visible() -> Column:
    """Per token its visible text, decoded; '' for markup and hidden text.

    Hidden ranges are cut out by slicing, so their number does not matter.
    """
    raw, spans = F.col("raw"), F.col("spans")

    def one(t: Column) -> Column:
        plain = F.replace(t, F.lit(_STRAY), F.lit(""))
        text = F.when(~t.startswith("<"), let(let(plain, _read), unescape)).when(
            t.rlike(r"^<\x01\d+\x02$"), F.lit("<")
        )
        return F.coalesce(text, F.lit(""))

    def resume(s: Column) -> Column:
        """Where text is visible again after a span."""
        return F.when(s.isNotNull(), F.greatest(F.least(s["hi"], F.size(raw)), s["lo"] + 1))

    def masked(t: Column) -> Column:
        def part(s: Column, k: Column) -> Column:
            start = F.coalesce(resume(F.get(spans, k - 1)), F.lit(0))
            shown = F.slice(t, start + 1, F.greatest(s["lo"] + 1 - start, F.lit(0)))
            return F.concat(shown, F.array_repeat(F.lit(""), resume(s) - s["lo"] - 1))

        rest = F.slice(t, resume(F.try_element_at(spans, F.lit(-1))) + 1, F.size(t))
        return F.concat(F.flatten(F.transform(spans, part)), rest)

    return let(
        F.transform(raw, one), lambda t: F.when(F.size(spans) == 0, t).otherwise(masked(t))
    )


@remembered
def _raw_and_base() -> dict[str, Column]:
    return {"raw": raw_tokens(F.col("html")), **urls.base_parts(F.col("url"))}


def tokenised(
    pages: DataFrame,
    tags: Iterable[str] | None = None,
    texts: bool = True,
    read: Iterable[str] = (),
) -> DataFrame:
    """pages(page_id, url, html, ...) → the same rows with ``events``, the
    ``base_*`` URL parts and, if asked for, ``texts`` in place of html.

    ``tags`` names the elements an audit needs; others are dropped early.
    ``read`` names those whose attributes are parsed.
    """
    wanted = None if tags is None else tuple(sorted({*tags, *QUIET_TAGS}))
    carried = [c for c in pages.columns if c != "html"]
    df = staged(pages, carried, _raw_and_base())
    carried += urls.BASE_COLUMNS
    df = staged(df, [*carried, "raw"], {"events": _events(wanted, tuple(sorted(read)))})
    if not texts:
        return df.select(*carried, "events")
    df = staged(df, [*carried, "raw", "events"], {"spans": _quiet_spans()})
    return staged(df, [*carried, "events"], {"texts": _visible()})


def text_between(texts: Column, start: Column, end: Column) -> Column:
    """Text of the tokens strictly between two positions."""
    return F.array_join(F.slice(texts, start + 2, F.greatest(end - start - 1, F.lit(0))), "")


def attributes(body: Column) -> Column:
    """Start tag text → array<struct(name, value)> in order; value NULL if absent."""
    inside = F.regexp_extract(body, r"(?s)^[a-zA-Z][^\s/>]*(.*?)>?$", 1)
    found = F.regexp_extract_all(inside, F.lit(ATTRIBUTE), F.lit(0))

    def pair(a: Column) -> Column:
        name = F.regexp_extract(a, r"^[^\s/>][^\s/=>]*", 0)
        raw = F.regexp_extract(F.substr(a, F.length(name) + 1), r"(?s)^\s*=+\s*(.*)$", 1)
        value = F.when(
            raw.startswith('"') | raw.startswith("'"), F.substr(raw, F.lit(2), F.length(raw) - 2)
        ).otherwise(raw)
        return F.struct(
            F.lower(name).alias("name"),
            F.when(F.contains(a, F.lit("=")), unescape(value)).alias("value"),
        )

    return F.transform(found, pair)


def attribute(attrs: Column, name: str) -> Column:
    """Value of an attribute; the last wins where it is repeated."""
    return F.try_element_at(F.filter(attrs, lambda a: a["name"] == name), F.lit(-1))["value"]


def has_attribute(attrs: Column, name: str) -> Column:
    return F.exists(attrs, lambda a: a["name"] == name)


def tokens(pages: DataFrame) -> DataFrame:
    """One row per token: page_id, pos, kind, tag, line, token.

    kind is text, start, end, raw (script or style with its body) or other
    (comment, doctype, processing instruction).
    """
    df = staged(pages, ["page_id"], {"raw": raw_tokens(F.col("html"))})
    df = df.select("page_id", F.posexplode("raw").alias("pos", "token"))
    t = F.col("token")
    rest = F.regexp_replace(t, r"^<\x01\d+\x02\x03?", "")
    stray = t.rlike(r"^<\x01\d+\x02$")
    kind = (
        F.when(~t.startswith("<") | stray, F.lit("text"))
        .when(rest.rlike(r"^/\s*[a-zA-Z]"), F.lit("end"))
        .when(~rest.rlike(r"^[a-zA-Z]"), F.lit("other"))
        .when(rest.rlike(r"(?is)<\x01\d+\x02/(?:script|style)\s*>$"), F.lit("raw"))
        .otherwise(F.lit("start"))
    )
    return df.select(
        "page_id",
        "pos",
        kind.alias("kind"),
        F.when(
            kind.isin("start", "end", "raw"),
            F.lower(_read(F.regexp_extract(rest, r"^/?\s*([a-zA-Z][^\s/>]*)", 1))),
        ).alias("tag"),
        F.regexp_extract(t, r"^<\x01(\d+)\x02", 1).try_cast("int").alias("line"),
        unmarked(t).alias("token"),
    )


def visible_length(texts: Column) -> Column:
    return F.aggregate(texts, F.lit(0), lambda acc, x: acc + F.length(strip(x)))
