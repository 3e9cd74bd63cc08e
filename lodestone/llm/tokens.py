"""Words of whole texts as numpy arrays: boundaries and 64-bit hashes.

A word is a longest run of bytes other than space and 0x09-0x0D. Those bytes never
occur inside a multi-byte UTF-8 character, so bytes give the same words as characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer single text is handled alone.
SLICE = 1 << 20
#: Bytes hashed at once inside a text, cut at white space.
CHUNK = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, modulo 2**64."""
    if n > len(_powers.get("up", ())):
        n = max(n, CHUNK + 4096)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def slices(column: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows with at most ``limit`` bytes together: first row, end row, bytes, offsets."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        yield lo, hi, raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of each word of the texts at ``offsets``, and each text's first word."""
    starts, ends, hashes = [], [], []
    n, i = len(data), 0
    while i < n:
        j = min(i + CHUNK, n)
        while j < n and not SPACE[data[j]]:
            gap = np.flatnonzero(SPACE[data[j : j + 4096]])
            j = j + int(gap[0]) if len(gap) else min(j + 4096, n)
        part = data[i:j]
        solid = ~SPACE[part]
        first, last = solid.copy(), solid.copy()
        first[1:] &= ~solid[:-1]
        last[:-1] &= ~solid[1:]
        edges = offsets[np.searchsorted(offsets, i) : np.searchsorted(offsets, j)] - i
        first[edges] = solid[edges]
        edges = edges[edges > 0] - 1
        last[edges] = solid[edges]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        up, down = _power(len(part))
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[LOWER[part] if lower else part] * up[: len(part)], out=total[1:])
        hashes.append(mix((total[e] - total[s]) * down[s]))
        starts.append(s + i)
        ends.append(e + i)
        i = j
    s, e, h = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((starts, np.int64), (ends, np.int64), (hashes, np.uint64)))
    return s, e, h, np.searchsorted(s, offsets)


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """The hash of the n words from each word on; the last n-1 words have none."""
    k = max(0, len(h) - n + 1)
    out = np.zeros(k, np.uint64)
    for i in range(n):
        out = out * np.uint64(_BASE) + h[i : i + k]
    return mix(out)


def shingles(h: np.ndarray, first: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's n-word shingles and the offsets of the texts in them.

    A text with fewer words has its whole sequence as one; a text without words has none.
    """
    size = np.diff(first)
    count = np.where(size >= n, size - n + 1, (size > 0).astype(size.dtype))
    at = np.concatenate(([0], np.cumsum(count)))
    out = np.empty(at[-1], np.uint64)
    full = grams(h, n)
    inside = np.flatnonzero(size >= n)
    if len(inside):
        keep = np.repeat(first[inside] - at[inside], count[inside])
        to = np.concatenate([np.arange(at[d], at[d + 1]) for d in inside]) if len(inside) < len(size) else np.arange(at[-1])
        out[to] = full[to + keep]
    for d in np.flatnonzero((size > 0) & (size < n)):
        out[at[d]] = mix(grams(h[first[d] : first[d + 1]], int(size[d])) + np.uint64(size[d]))[0]
    return out, at
