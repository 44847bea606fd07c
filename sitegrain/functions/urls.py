"""URL parts and reference resolution as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitegrain.functions.columns import let

_SCHEME = r"^([a-zA-Z][a-zA-Z0-9+.\-]*):"
#: Blanks and controls before an address.
_LEADING = "".join(map(chr, range(33)))
_PREFIX = r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?"


def scheme(u: Column) -> Column:
    return F.lower(F.regexp_extract(u, _SCHEME, 1))


def authority(u: Column) -> Column:
    return F.regexp_extract(u, _PREFIX + r"//([^/?#]*)", 1)


def path(u: Column) -> Column:
    return F.regexp_extract(u, _PREFIX + r"(?://[^/?#]*)?([^?#]*)", 1)


def query(u: Column) -> Column:
    """The query with its '?', or ''."""
    return F.regexp_extract(u, r"^[^?#]*(\?[^#]*)", 1)


def origin(u: Column) -> Column:
    return F.concat(scheme(u), F.lit("://"), authority(u))


def without_fragment(u: Column) -> Column:
    return F.regexp_extract(u, r"^[^#]*", 0)


def is_web(u: Column) -> Column:
    """http or https scheme."""
    return scheme(u).isin("http", "https")


def base_parts(u: Column) -> dict[str, Column]:
    """What resolution needs from the page URL, as flat columns computed once."""
    p = path(u)
    return {
        "base_url": u,
        "base_scheme": scheme(u),
        "base_origin": origin(u),
        "base_host": authority(u),
        "base_path": p,
        "base_dir": F.when(p == "", F.lit("/")).otherwise(F.regexp_extract(p, r"^.*/", 0)),
        "base_query": query(u),
    }


BASE_COLUMNS = [
    "base_url", "base_scheme", "base_origin", "base_host", "base_path", "base_dir", "base_query",
]


def base() -> dict[str, Column]:
    """The columns of ``base_parts`` by their short names."""
    return {c.removeprefix("base_"): F.col(c) for c in BASE_COLUMNS}


def _without_dots(p: Column) -> Column:
    """Dot segments of a path resolved; ``p`` is a bound variable."""

    def walked(parts: Column) -> Column:
        kept = F.aggregate(
            parts, F.array().cast("array<string>"),
            lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
            .when(s == ".", acc)
            .otherwise(F.concat(acc, F.array(s))),
        )
        ends = F.try_element_at(parts, F.lit(-1)).isin(".", "..")
        whole = F.array_join(F.when(ends, F.concat(kept, F.array(F.lit("")))).otherwise(kept), "/")
        return let(whole, lambda w: F.when(w.startswith("/"), w).otherwise(F.concat(F.lit("/"), w)))

    return F.when(p.rlike(r"(?:^|/)\.\.?(?:/|$)"), let(F.split(p, "/"), walked)).otherwise(p)


def _pieces(rest: Column) -> Column:
    """What follows the host: struct(path, params, query, fragment); only the last segment has parameters."""
    path = F.regexp_extract(rest, r"^[^?#]*", 0)
    name = F.substring_index(path, "/", -1)
    at = F.instr(name, ";")
    params = F.when(at > 0, F.substr(name, at + 1)).otherwise(F.lit(""))
    before = F.when(at > 0, F.left(path, F.length(path) - F.length(name) + at - 1)).otherwise(path)
    return F.struct(
        before.alias("path"), params.alias("params"),
        F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1).alias("query"), F.regexp_extract(rest, r"(?s)^[^#]*#(.*)$", 1).alias("fragment"),
    )


def _put(mark: str, part: Column) -> Column:
    """A part with its mark; an empty one leaves none."""
    return F.when(part == "", F.lit("")).otherwise(F.concat(F.lit(mark), part))


def resolve(href: Column, base: dict[str, Column]) -> Column:
    """RFC 3986 reference resolution of ``href`` against the page's base columns.

    As the usual joins of web libraries have it: empty queries, fragments and
    parameters leave no mark, an empty host is the page's, and empty segments within a
    relative path are passed over.
    """

    def joined(rel: Column, host: Column, r: Column) -> Column:
        tail = lambda params, query: F.concat(_put(";", params), _put("?", query), _put("#", r["fragment"]))
        here = let(
            _pieces(base["path"]),
            lambda b: F.concat(
                base["origin"], b["path"],
                tail(b["params"], F.when(r["query"] != "", r["query"]).otherwise(F.substr(base["query"], F.lit(2)))),
            ),
        )
        under = F.regexp_replace(F.concat(base["dir"], r["path"]), "/{2,}", "/")
        target = F.when(r["path"].startswith("/"), r["path"]).otherwise(under)
        return (
            F.when(host != "", F.concat(base["scheme"], F.lit("://"), host, r["path"], tail(r["params"], r["query"])))
            .when((r["path"] == "") & (r["params"] == ""), here)
            .otherwise(F.concat(base["origin"], let(target, _without_dots), tail(r["params"], r["query"])))
        )

    def cut(rel: Column) -> Column:
        host = F.regexp_extract(rel, r"^//([^/?#]*)", 1)
        rest = F.when(rel.startswith("//"), F.substr(rel, F.length(host) + 3)).otherwise(rel)
        return let(F.struct(host.alias("host"), let(rest, _pieces).alias("r")), lambda x: joined(rel, x["host"], x["r"]))

    def bound(h: Column) -> Column:
        # "http:path" with the page's own scheme counts as relative.
        own = scheme(h)
        rel = F.when(own != "", F.substr(h, F.length(own) + 2)).otherwise(h)
        return (
            F.when(href == "", base["url"])
            .when((own != "") & (own != base["scheme"]), href)
            .otherwise(let(rel, cut))
        )

    return let(F.ltrim(F.translate(href, "\t\r\n", ""), F.lit(_LEADING)), bound)


def link_scope(href: Column, page_host: Column) -> Column:
    host = authority(href)
    return (
        F.when(host == page_host, F.lit("internal"))
        .when(host != "", F.lit("external"))
        .otherwise(F.lit("other"))
    )


def extension(u: Column) -> Column:
    """Lower-cased extension of the last path part, with its dot, or ''.

    A name's leading dots are part of the name, not an extension.
    """
    name = F.regexp_extract(path(u), r"[^/]*$", 0)
    return F.lower(F.regexp_extract(name, r"[^.].*?(\.[^.]*)$", 1))


def short_name(u: Column, limit: int = 80) -> Column:
    """Last path part for display, cut with an ellipsis."""
    name = F.regexp_extract(path(u), r"[^/]*$", 0)
    name = F.when(name == "", u).otherwise(name)
    return F.when(F.length(name) <= limit, name).otherwise(
        F.concat(F.substring(name, 1, limit - 1), F.lit("…"))
    )
