"""Words of a batch of texts, at once: places and hashes by array operations on the texts' UTF-8 bytes.

A word is a run of bytes other than ASCII white space (common.WORD), or than the bytes given; A-Z count as a-z. Memory is bounded by the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes handled at once (more where one text is longer).
CHUNK = 1 << 20
#: Longer words are hashed by themselves.
LONG = 4096

_rng = np.random.RandomState(99)
VALUE = _rng.randint(0, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
VALUE[65:91] = VALUE[97:123]
POWER = 0xD1342543DE82EF95
SHINGLE = _rng.randint(0, 2**63, 64, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, *range(9, 14)]] = True
_powers: list[np.ndarray] = []


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that low and high bits depend on all bits."""
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def sliding_min(v: np.ndarray, size: int) -> np.ndarray:
    """Least value of each run of ``size``."""
    have = 1
    while have * 2 <= size:
        v = np.minimum(v[:-have], v[have:])
        have *= 2
    return np.minimum(v[: len(v) - (size - have)], v[size - have :]) if size > have else v


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and where each text begins (and the last ends); nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if not len(column) or offsets is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)), at


def groups(offsets: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Rows [i, j) of at most ``most`` bytes, or of one text."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j


def powers() -> list[np.ndarray]:
    if not _powers:
        n = CHUNK + LONG + 1
        for base in (np.uint64(POWER), np.uint64(pow(POWER, -1, 1 << 64))):
            with np.errstate(over="ignore"):
                _powers.append(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, base))]))
    return _powers


class Words:
    """``hash``, ``start`` and ``end`` (bytes) of all words of some texts; ``first``: number of the first word of each text, and of all words."""

    def __init__(self, b: np.ndarray, offsets: np.ndarray, outside: np.ndarray = IS_SPACE):
        inside = ~outside[b]
        begin, finish = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1]
        finish[:-1] &= ~inside[1:]
        inner = offsets[(offsets > 0) & (offsets < len(b))]
        begin[inner] = inside[inner]
        finish[inner - 1] = inside[inner - 1]
        self.start, self.end = np.flatnonzero(begin), np.flatnonzero(finish) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.hash = np.empty(len(self.start), np.uint64)
        up, down = powers()
        at = 0
        while at < len(self.start):
            low = self.start[at]
            to = int(np.searchsorted(self.start, low + CHUNK))
            s, e = self.start[at:to], self.end[at:to]
            short = e - s <= LONG
            last = int(e[short][-1]) if short.any() else low
            with np.errstate(over="ignore"):
                p = np.zeros(last - low + 1, np.uint64)
                np.cumsum(VALUE[b[low:last]] * up[: last - low], out=p[1:])
                x, y = s - low, np.minimum(e, last) - low
                self.hash[at:to] = mixed((p[y] - p[np.minimum(x, last - low)]) * down[np.minimum(x, len(down) - 1)] + (e - s).astype(np.uint64))
            for k in np.flatnonzero(~short):
                import xxhash

                self.hash[at + k] = xxhash.xxh64_intdigest(b[s[k] : e[k]].tobytes().lower())
            at = to

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def shingle_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of ``n`` words, from the words' hashes."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.full(len(h) - n + 1, np.uint64(n))
        for k in range(n):
            out += h[k : len(h) - n + 1 + k] * SHINGLE[k % 64]
    return mixed(out)
