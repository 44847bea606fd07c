"""URL filter over a sorted array of 64-bit digests.

A rule is a host and a path prefix. It fits its host and all subdomains where
the path of the URL starts with the rule's; the longest rule that fits wins
(equally long ones: the longer host). Rules are kept as a sorted array of
xxHash64 keys beside their full strings, memory-mapped from one file. A URL
probes the array with every (host suffix, path prefix) it has at the lengths
rules have; a hit counts only if the stored string is the probed one, so
equal digests of different strings do no harm.

Nulls, URLs without ``://``: host and path empty, no rule fits. Rows repeat
as they come; an empty table gives an empty result; other columns are passed
through unless they clash with the columns added, which then win. Rules given
twice: a block wins over an allow. Null rules are left out.
"""

from __future__ import annotations

import mmap
import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rules are broadcast as one array file up to this size; beyond it they are joined.
MAX_STORE_BYTES = 64 << 20
_AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_URL = re.compile(r"://([^/?#]*)([^?#]*)", re.S)


def split_url(url: str | None) -> tuple[str, str]:
    m = _URL.search(url) if isinstance(url, str) else None
    return (m[1].translate(_AZ), m[2]) if m else ("", "")


def digest(key: str) -> int:
    return xxhash.xxh64_intdigest(key.encode("utf-8", "surrogatepass"))


def build_store(rules: list[tuple[str, str, str]], key=digest) -> bytes:
    """One file: counts, sorted keys, offsets, path lengths, verdicts, strings, lengths of paths and hosts in use."""
    seen: dict[str, tuple[str, str]] = {}
    for host, path, verdict in rules:
        if host is None or path is None or verdict not in ("allow", "block"):
            continue
        text = host.translate(_AZ) + path
        if text not in seen or verdict == "block":
            seen[text] = (path, verdict)
    rows = sorted((key(t), t.encode("utf-8", "surrogatepass"), len(p), v == "block") for t, (p, v) in seen.items())
    offsets = np.zeros(len(rows) + 1, "<u8")
    np.cumsum([len(r[1]) for r in rows], out=offsets[1:])
    lengths = np.array(sorted({r[2] for r in rows}), "<u8")
    hosts = np.array(sorted({len(t) - len(p) for t, (p, _) in seen.items()}), "<u8")
    return b"".join(
        [
            np.array([len(rows), len(lengths), len(hosts)], "<u8").tobytes(), np.array([r[0] for r in rows], "<u8").tobytes(),
            offsets.tobytes(), np.array([r[2] for r in rows], "<u8").tobytes(), np.array([r[3] for r in rows], "<u8").tobytes(),
            lengths.tobytes(), hosts.tobytes(), b"".join(r[1] for r in rows),
        ]
    )


class Store:
    """The array file, mapped: pages of it are read as probes need them."""

    def __init__(self, data: bytes, key=digest):
        with tempfile.TemporaryFile() as f:  # gone with the mapping
            f.write(data)
            f.flush()
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        n, k, h = (int(x) for x in np.frombuffer(self.map, "<u8", 3))
        at = 24

        def part(count: int) -> np.ndarray:
            nonlocal at
            at += 8 * count
            return np.frombuffer(self.map, "<u8", count, at - 8 * count)

        self.keys, self.offsets, self.paths, self.block, lengths = part(n), part(n + 1), part(n), part(n), part(k)
        self.hosts = [int(x) for x in part(h)]
        self.lengths, self.strings, self.key = [int(x) for x in lengths], at, key

    def text(self, i: int) -> bytes:
        return self.map[self.strings + int(self.offsets[i]) : self.strings + int(self.offsets[i + 1])]

    def judge(self, urls: list[tuple[str, str]]) -> list[tuple[str | None, str]]:
        """(rule, verdict) for (host, path) pairs; no rule: (None, allow)."""
        probes: list[tuple[int, str, int]] = []
        for i, (host, path) in enumerate(urls):
            # Of a host's many ends only those as long as some rule's host are looked up.
            size = len(host)
            tails = [host[size - n :] for n in self.hosts if 0 < size and (n == size or n < size and host[size - n - 1] == ".")]
            probes += [(i, tail + path[:n], len(tail)) for tail in tails for n in self.lengths if n <= len(path)]
        best: dict[int, tuple[int, int, str, str]] = {}
        if probes and len(self.keys):
            want = np.fromiter((self.key(p[1]) for p in probes), np.uint64, len(probes))
            lo, hi = np.searchsorted(self.keys, want), np.searchsorted(self.keys, want, "right")
            for j in np.flatnonzero(hi > lo):
                i, text, n_host = probes[j]
                raw = text.encode("utf-8", "surrogatepass")
                for k in range(lo[j], hi[j]):  # all rules of that digest
                    if self.text(k) == raw and len(text) - int(self.paths[k]) == n_host:
                        best[i] = max(best.get(i, (-1, 0, "", "")), (len(text), n_host, text, "block" if self.block[k] else "allow"))
        return [best[i][2:] if i in best else (None, "allow") for i in range(len(urls))]


def _probe(df: DataFrame, url: str, stores: list) -> DataFrame:
    kept = [c for c in df.columns if c not in ("host", "path", "rule", "verdict")]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(c, T.StringType()) for c in ("host", "path", "rule", "verdict")])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        opened = [Store(s.value) for s in stores]
        for b in batches:
            parts = [split_url(u) for u in b[url]]
            found = opened[0].judge(parts) if opened else [(None, "allow")] * len(parts)
            out = b[kept].copy()
            out["host"], out["path"] = [p[0] for p in parts], [p[1] for p in parts]
            out["rule"] = pd.Series([f[0] for f in found], dtype=object, index=out.index)
            out["verdict"] = [f[1] for f in found]
            yield out

    return df.select(*dict.fromkeys([*kept, url])).mapInPandas(run, schema)


def _joined(df: DataFrame, rules: DataFrame, url: str) -> DataFrame:
    """The same for rule tables of any size: probes meet rules on digest and string."""
    added = ("host", "path", "rule", "verdict")
    rules = (
        rules.filter("host IS NOT NULL AND path IS NOT NULL AND verdict IN ('allow', 'block')")
        .select(F.concat(F.translate("host", _UPPER, _LOWER), "path").alias("__text"), F.length("path").cast("int").alias("__n"), "verdict")
        .groupBy("__text", "__n").agg(F.max("verdict").alias("__verdict"))
    )
    lengths = rules.agg(F.sort_array(F.collect_set("__n")).alias("__lengths"))
    base = df.drop(*added).withColumn("__row", F.monotonically_increasing_id()) if url not in added else df.withColumn("__row", F.monotonically_increasing_id())
    has = F.instr(url, "://") > 0
    base = base.withColumn("host", F.when(has, F.translate(F.regexp_extract(url, r"(?s)://([^/?#]*)", 1), _UPPER, _LOWER)).otherwise(""))
    base = base.withColumn("path", F.when(has, F.regexp_extract(url, r"(?s)://[^/?#]*([^?#]*)", 1)).otherwise(""))
    parts = F.split("host", r"\.", -1)
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    probes = (
        base.filter("host <> ''").join(F.broadcast(lengths))  # one row: the path lengths rules have
        .select("host", "path", F.explode(tails).alias("__tail"), "__lengths")
        .select("host", "path", "__tail", F.explode("__lengths").alias("__n")).filter("__n <= length(path)")
        .select("host", "path", "__n", F.length("__tail").alias("__h"), F.expr("concat(__tail, substring(path, 1, __n))").alias("__text")).distinct()
    )
    best = (
        probes.join(rules, ["__text", "__n"])
        .groupBy("host", "path").agg(F.max(F.struct(F.length("__text"), "__h", "__text", "__verdict")).alias("__best"))
    )
    out = base.join(best, ["host", "path"], "left")
    kept = [c for c in df.columns if c not in added]
    return out.select(*kept, "host", "path", F.col("__best.__text").alias("rule"), F.coalesce("__best.__verdict", F.lit("allow")).alias("verdict"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def filter_urls(df: DataFrame, rules: DataFrame, url: str = "url", max_store_bytes: int = MAX_STORE_BYTES) -> DataFrame:
    """``df`` with host, path, rule and verdict. ``rules``: host, path, verdict.

    The rules' size is measured first: up to ``max_store_bytes`` they go to the
    executors as one array file, beyond that they are joined by Spark.
    """
    size = rules.agg(F.sum(F.octet_length(F.concat("host", "path")) + 32)).first()[0] or 0
    if size > max_store_bytes:
        return _joined(df, rules, url)
    data = build_store([(r.host, r.path, r.verdict) for r in rules.select("host", "path", "verdict").collect()])
    return _probe(df, url, [df.sparkSession.sparkContext.broadcast(data)])
