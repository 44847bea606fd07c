"""Text semantics: stripping, collapsing, word counts, character references."""

from __future__ import annotations

import zlib
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitegrain.constants import SPACE_CLASS, SPACES
from sitegrain.functions.columns import let

_SEP = "\x1e"


def strip(c: Column) -> Column:
    """Both ends without blanks; linear, where an anchored regex is not."""
    return F.btrim(c, F.lit(SPACES))


def collapse(c: Column) -> Column:
    """Runs of blanks as one space, ends stripped."""
    return F.btrim(F.regexp_replace(c, SPACE_CLASS + "+", " "), F.lit(" "))


def word_count(collapsed: Column) -> Column:
    """Words of an already collapsed text."""
    return F.when(collapsed == "", F.lit(0)).otherwise(
        F.length(collapsed) - F.length(F.replace(collapsed, F.lit(" "), F.lit(""))) + 1
    )


def quoted(values: list[str]) -> list[Column]:
    return [F.lit(v) for v in values]


# Character references.  The table is the standard one of HTML 5, read from the
# standard library; names that also decode without their semicolon are those
# the table lists without it.
_LEGACY_LENGTHS = sorted({len(n) for n in html5 if not n.endswith(";")}, reverse=True)
_COMMON = {"&amp;": "&", "&amp": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&nbsp;": "\xa0"}
_PIECE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)|[^&]+|&"
# C1 controls written as numbers mean their Windows-1252 characters.
_C1 = {
    n: bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(0x80, 0xA0)
}


_BUCKETS, _NEXT, _IS = 1024, "\x1d", "\x1f"


def _bucket_texts() -> str:
    """The names dealt by their checksum: each bucket a text of name and value pairs, a few each."""
    buckets: list[str] = [_SEP] * _BUCKETS
    for name in sorted(html5):
        buckets[zlib.crc32(f"&{name}".encode()) % _BUCKETS] += f"&{name}{_IS}{html5[name]}{_SEP}"
    return _NEXT.join(buckets)


_TABLE = _bucket_texts()


def _looked_up(name: Column) -> Column:
    """Value of a reference by its name, NULL if there is none: one array access and a search of a few pairs."""
    bucket = F.get(F.split(F.lit(_TABLE), _NEXT), F.pmod(F.crc32(F.encode(name, "UTF-8")), F.lit(_BUCKETS)).cast("int"))
    key = F.concat(F.lit(_SEP), name, F.lit(_IS))
    return let(bucket, lambda b: F.when(F.contains(b, key), F.split_part(F.split_part(b, key, F.lit(2)), F.lit(_SEP), F.lit(1))))


def _code_point(n: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")


def _numeric(piece: Column) -> Column:
    digits = F.regexp_extract(piece, r"^&#[xX]?0*([0-9a-fA-F]*)", 1)
    is_hex = F.lower(F.substring(piece, 3, 1)) == "x"
    short = F.when(F.length(digits) <= 7, F.when(digits == "", F.lit("0")).otherwise(digits))
    n = F.when(is_hex, F.conv(short, 16, 10).try_cast("bigint")).otherwise(
        short.try_cast("bigint")
    )
    c1 = F.split(F.lit(_SEP.join(_C1[k] for k in sorted(_C1))), _SEP)
    surrogate_or_big = n.isNull() | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF) | (n == 0)
    dropped = (
        n.between(0x1, 0x8)
        | n.between(0xE, 0x1F)
        | n.between(0x7F, 0x7F)
        | n.between(0xFDD0, 0xFDEF)
        | (n == 0xB)
        | (F.pmod(n, F.lit(0x10000)) >= 0xFFFE)
    )
    return (
        F.when(surrogate_or_big, F.lit("�"))
        .when(n.between(0x80, 0x9F), F.get(c1, (n - 0x80).cast("int")))
        .when(dropped, F.lit(""))
        .otherwise(_code_point(n))
    )


def _named(piece: Column) -> Column:
    """A whole name, or the longest beginning that is known without its semicolon."""
    begun = [
        F.when(F.length(piece) > n, F.concat(_looked_up(F.left(piece, F.lit(n + 1))), F.substr(piece, F.lit(n + 2))))
        for n in _LEGACY_LENGTHS
    ]
    return F.coalesce(_looked_up(piece), *begun, piece)


def unescape(c: Column) -> Column:
    """Character references decoded; text without '&' is passed through."""

    def one(piece: Column) -> Column:
        out = F.when(~piece.startswith("&") | (piece == "&"), piece)
        for name, value in _COMMON.items():
            out = out.when(piece == name, F.lit(value))
        return out.when(piece.startswith("&#"), _numeric(piece)).otherwise(_named(piece))

    pieces = F.regexp_extract_all(c, F.lit(_PIECE), F.lit(0))
    return F.when(F.contains(c, F.lit("&")), F.array_join(F.transform(pieces, one), "")).otherwise(c)
