"""Vectorised word, shingle and record hashing over Arrow batches of text.

A *word* is a maximal run of Unicode letters and digits, lower-cased.  All
functions work on a whole batch at once: the texts are joined into one array of
code points, and polynomial prefix sums modulo 2**64 (with a random value per
code point) give the hash of any run in O(1), so no Python loop runs per word.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np

U = np.uint64
_M1, _M2 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15
#: Code points per chunk: its arrays fit a core's cache, and a worker's memory is bounded whatever the batch holds.
CHUNK_CHARS = 150_000
BAR = 0x7C


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> U(30))
    x = x * _M1
    x = x ^ (x >> U(27))
    x = x * _M2
    return x ^ (x >> U(31))


_tables: dict[str, np.ndarray] = {}


def _alnum() -> np.ndarray:
    if "alnum" not in _tables:
        _tables["alnum"] = np.fromiter((unicodedata.category(chr(i))[0] in "LN" for i in range(0x110000)), bool, 0x110000)
    return _tables["alnum"]


def _values(seed: int) -> np.ndarray:
    if (k := f"v{seed}") not in _tables:
        _tables[k] = mix(np.arange(1, 0x110001, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed))
    return _tables[k]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    if len(_tables.get("pow", ())) < n:
        n = max(n, CHUNK_CHARS + 1)
        for name, b in (("pow", _BASE), ("inv", pow(_BASE, -1, 1 << 64))):
            p = np.full(n, b, U)
            p[0] = 1
            _tables[name] = np.multiply.accumulate(p)
    return _tables["pow"], _tables["inv"]


def _runs(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for each run, independent of where it stands."""
    power, inverse = _powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, U)
    np.cumsum(values * power[: len(values)], out=sums[1:])
    return mix((sums[end] - sums[start]) * inverse[start])


@dataclass
class Words:
    """Words of a chunk of documents: hashes, and where each document's begin."""

    hashes: np.ndarray
    first: np.ndarray  # len docs + 1
    raw: tuple[np.ndarray, np.ndarray, np.ndarray]

    def records(self) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
        """Two 64-bit hashes of each document's canonical record, and its number of fields."""
        return records(*self.raw)

    @property
    def docs(self) -> int:
        return len(self.first) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of k consecutive words, and where each document's begin."""
        h, n = self.hashes, len(self.hashes)
        counts = np.maximum(self.counts - (k - 1), 0)
        first = np.concatenate(([0], np.cumsum(counts)))
        if n < k:
            return np.zeros(0, U), first
        g = np.zeros(n - k + 1, U)
        for j in range(k):
            g = (g + h[j : n - k + 1 + j]) * _M1
            g ^= g >> U(29)
        inside = np.ones(n, bool)
        ends = self.first[1:]
        for j in range(1, k):
            at = ends - j
            inside[at[at >= self.first[:-1]]] = False
        return mix(g[inside[: n - k + 1]]), first

    def sequences(self) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit hashes of each document's word sequence."""
        a = _runs(self.hashes, self.first[:-1], self.first[1:])
        b = _runs(mix(self.hashes ^ U(0xD6E8FEB86659FD93)), self.first[:-1], self.first[1:])
        n = self.counts.astype(U)
        return mix(a + n), mix(b + n)


def chunks(texts: list[str | None]):
    """(first, last, Words) over ranges of the batch of bounded size; a long text is a chunk of its own."""
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j] or "") < CHUNK_CHARS):
            size += len(texts[j] or "") + 1
            j += 1
        yield i, j, words(texts[i:j])
        i = j


def words(texts: list[str | None]) -> Words:
    low = [(t or "").lower() for t in texts]
    lens = np.fromiter(map(len, low), np.int64, len(low))
    cp = np.frombuffer(("\0".join(low) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    begin = np.concatenate(([0], np.cumsum(lens + 1)))  # begin[i]: first code point of document i
    good = _alnum()[cp]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], good, [False])).astype(np.int8)))
    start, end = edge[0::2], edge[1::2]
    hashes = _runs(np.where(good, _values(1)[cp], U(0)), start, end)
    first = np.searchsorted(start, begin)
    return Words(hashes, first, (cp, good, begin))


def records(cp: np.ndarray, good: np.ndarray, begin: np.ndarray):
    """Canonical record: letters and digits of each bar-separated field, empty fields dropped, order ignored."""
    kept = np.concatenate(([0], np.cumsum(good)))  # letters and digits before each code point
    bars = np.flatnonzero(cp == BAR)
    cut = np.sort(np.concatenate((begin[:-1], bars + 1)))
    # a field ends at the next cut's bar or at its document's end; neither is a letter or digit
    a, b = kept[cut], kept[np.concatenate((cut[1:], [begin[-1]]))]
    doc = np.searchsorted(begin, cut, "right") - 1
    full = b > a
    a, b, doc = a[full], b[full], doc[full]
    solid = cp[good]
    n = len(begin) - 1
    out = []
    for seed in (1, 2):
        h = mix(_runs(_values(seed)[solid], a, b) + (b - a).astype(U))
        sums = np.concatenate((np.zeros(1, U), np.cumsum(h)))
        edge = np.searchsorted(doc, np.arange(n + 1))
        out.append(mix(sums[edge[1:]] - sums[edge[:-1]]))
    return tuple(out), np.bincount(doc, minlength=n)


def distinct(g: np.ndarray, first: np.ndarray, late: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Each document's distinct values in order of ``late`` (a function of the value) and value, and where each document's begin."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.lexsort((g, doc) if late is None else (g, late, doc))
    g, doc = g[at], doc[at]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
    return g[new], np.concatenate(([0], np.cumsum(np.bincount(doc[new], minlength=len(first) - 1))))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
