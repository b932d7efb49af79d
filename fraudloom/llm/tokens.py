"""Words and word hashes of whole texts, computed on Arrow buffers with numpy.

A word is a run of bytes other than space and 0x09-0x0D, A-Z lower-cased.  Everything is
vectorised over slices of a few MB, so memory does not depend on the batch or the text:
a longer text is its own slice and is hashed in blocks.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
BLOCK_BYTES = 1 << 18
LONG_WORD = 1 << 22  # a longer word is hashed by blake2b, wherever it stands

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True

_rng = np.random.Generator(np.random.PCG64(20240229))
BYTE_CODES = _rng.integers(0, 2**64, 256, dtype=np.uint64)
GRAM_CODES = _rng.integers(0, 2**64, 16, dtype=np.uint64) | np.uint64(1)
STEP = int(_rng.integers(0, 2**62, dtype=np.uint64)) * 4 + 1
UNSTEP = pow(STEP, -1, 2**64)
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        for name, base in (("up", STEP), ("down", UNSTEP)):
            p = np.full(max(n, BLOCK_BYTES + 4096), base, dtype=np.uint64)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets from 0) of a text column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    col = column.cast(pa.large_binary())
    if col.null_count:
        col = col.fill_null(b"")
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows with about `limit` bytes of text."""
    raw, off = flat(column)
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield lo, hi, raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi
    if n and off[-1] > limit:  # long texts passed: give back what Arrow holds for them
        pa.default_memory_pool().release_unused()


def spans(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, index of the first word of each text, with a last entry for the end)."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    ink = ~IS_SPACE[raw]
    begins = ink.copy()
    begins[1:] &= ~ink[:-1]
    edge = off[(off > 0) & (off < n)]
    begins[edge] = ink[edge]
    stops = ink.copy()
    stops[:-1] &= ~ink[1:]
    stops[edge - 1] = ink[edge - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(starts, off, "left")


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hash of every word; depends on the word alone."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        a = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, a + BLOCK_BYTES, "right")))
        b = int(ends[j - 1])
        if b - a > LONG_WORD:
            out[i] = int.from_bytes(hashlib.blake2b((LOWER[raw[a:b]] if lower else raw[a:b]).tobytes(), digest_size=8).digest(), "little")
            i = j
            continue
        up, down = powers(b - a + 1)
        part = raw[a:b]
        codes = BYTE_CODES[LOWER[part] if lower else part]
        codes *= up[: b - a]
        run = np.empty(b - a + 1, np.uint64)
        run[0] = 0
        np.cumsum(codes, out=run[1:])
        s, e = starts[i:j] - a, ends[i:j] - a
        out[i:j] = mix((run[e] - run[s]) * down[s] + (e - s).astype(np.uint64))
        i = j
    return out


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive word hashes (they may cross texts; the caller masks)."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    total = h[: len(h) - k + 1] * GRAM_CODES[0]
    for i in range(1, k):
        total += h[i : len(h) - k + 1 + i] * GRAM_CODES[i]
    return mix(total + np.uint64(k))


def shingle_sets(raw: np.ndarray, off: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct k-word shingle hashes of each text; a shorter text is one shingle, an empty one none."""
    starts, ends, first = spans(raw, off)
    h = word_hashes(raw, starts, ends)
    g = grams(h, k)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= k:
            s = np.sort(g[a : b - k + 1])
            if len(s) > 1:
                s = s[np.concatenate(([True], s[1:] != s[:-1]))]
        elif b > a:
            s = grams(h[a:b], b - a)
        else:
            s = np.zeros(0, np.uint64)
        out.append(s)
    return out


def split_words(text: str | None) -> list[bytes]:
    """The same words as bytes (bytes.split and bytes.lower know ASCII only)."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()
