"""Helpers the operators share: words, chunks of bounded size, arrays in rows."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import pathlib
import re
import sys
import tempfile
import zipfile
from collections.abc import Iterable, Iterator

import numpy as np

#: A word is a run of anything but space and U+0009 to U+000D.
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Bytes of text that are held as word objects at once.
CHUNK_BYTES = 1 << 21

TOKENIZERS = "/opt/tokenizers"


def tokenizer_file(name: str) -> str:
    """The place of a public vocabulary file."""
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ImportError:
        return f"{TOKENIZERS}/{name}"


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def byte_words(text: str | None) -> list[bytes]:
    """Words as UTF-8; bytes.split() parts at exactly the six blanks."""
    return utf8(text).split()


def chunked(texts: Iterable[str | None], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Index ranges whose texts have about ``limit`` characters; a longer text stands alone."""
    lo = held = i = 0
    for i, t in enumerate(texts, 1):
        held += len(t or "") + 16
        if held >= limit:
            yield lo, i
            lo, held = i, 0
    if i > lo:
        yield lo, i


def as_text(v) -> str | None:
    """A pandas cell as text or None."""
    return v if isinstance(v, str) else None


def bounds(sizes: list[int] | np.ndarray, dtype=np.int64) -> np.ndarray:
    """Starts of consecutive groups, and the end."""
    out = np.zeros(len(sizes) + 1, dtype)
    np.cumsum(sizes, out=out[1:])
    return out


_SHIPPED: set[str] = set()


def ship(spark) -> None:
    """Hand this package to the executors, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    package = pathlib.Path(__file__).resolve().parents[1]
    to = pathlib.Path(tempfile.mkdtemp(prefix="ship-")) / f"{package.name}.zip"
    with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(str(to))
    _SHIPPED.add(sc.applicationId)


_HELD: dict = {}
#: Powers that word digests are made of, as far as they were needed; see ``hashed_words``.
_POWERS: dict[int, np.ndarray] = {}


def held(owner: tuple, make):
    """An object kept by the Python worker, which serves many tasks; what another operator kept goes."""
    if owner not in _HELD:
        _HELD.clear()
        _HELD[owner] = make()
    return _HELD[owner]


_LAST_OWNER: str | None = None


def release(owner: str) -> None:
    """Let go of what tasks of operators other than ``owner`` have left in this worker, down to the system.

    Called as a task starts; tasks of one operator that follow each other keep what they share.
    """
    global _LAST_OWNER
    if owner == _LAST_OWNER:
        return
    _LAST_OWNER = owner
    _HELD.clear()
    _POWERS.clear()
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):  # a libc without it keeps the pages for later
        ctypes.CDLL(None).malloc_trim(0)


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    if base not in _POWERS or len(_POWERS[base]) < n:
        size = 1 << max(20, (n - 1).bit_length())
        out = np.full(size, base, np.uint64)
        out[0] = 1
        with np.errstate(over="ignore"):
            _POWERS[base] = np.cumprod(out, dtype=np.uint64)
    return _POWERS[base][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Numbers scattered over 64 bits, one to one."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> np.uint64(33))


def hashed_words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(digests, starts, ends) of the words of UTF-8 bytes: a 64-bit polynomial, scattered.

    The digests of all words come from one running sum, so no word becomes an object.
    """
    b = np.frombuffer(data, np.uint8)
    solid = np.zeros(len(b) + 2, np.int8)
    solid[1:-1] = ~((b == 32) | ((b >= 9) & (b <= 13)))
    turn = np.diff(solid)
    starts, ends = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    n = len(b)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * _powers(_INVERSE, n), out=sums[1:])
        raw = (sums[ends] - sums[starts]) * _powers(_BASE, n + 1)[ends]
    return mixed(raw), starts, ends


class Memo(dict):
    """Numbers keys in order of first sight and lists the new ones."""

    def __init__(self):
        self.new: list = []

    def __missing__(self, key):
        self[key] = number = len(self)
        self.new.append(key)
        return number

    def taken(self) -> list:
        new, self.new = self.new, []
        return new


class Pool:
    """Number -> array of ids, flat, growing."""

    def __init__(self, dtype):
        self.flat, self.starts, self.sizes = np.zeros(1 << 16, dtype), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.n = self.used = 0

    def add(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        n, used = self.n + len(sizes), self.used + len(flat)
        while n > len(self.sizes):
            self.starts, self.sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes))
        while used > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.sizes[self.n : n] = sizes
        self.starts[self.n : n] = self.used + bounds(sizes)[:-1]
        self.flat[self.used : used] = flat
        self.n, self.used = n, used

    def gather(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all numbers in order, where each one's begin, with the end)."""
        lens = self.sizes[which]
        at = bounds(lens)
        places = np.repeat(self.starts[which] - at[:-1], lens)
        places += np.arange(at[-1])
        return self.flat[places], at


if sys.byteorder != "little":  # pragma: no cover
    raise ImportError("digests are taken over little-endian arrays")
