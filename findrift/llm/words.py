"""Hashes of the words and word runs of whole Arrow batches, by numpy on the texts' bytes.

A word is a longest run of bytes other than space and the control characters 9 to 13.  No step works
row by row, so millions of short texts cost as little as a few long ones of the same size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MULT, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_STEP = np.uint64(0xBF58476D1CE4E5B9)  # odd, so it has an inverse modulo 2 ** 64
_BACK = np.uint64(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
#: Words of more bytes are hashed one by one.
LONG_WORD = 256


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(32))


def text_slices(batches: Iterator[pa.RecordBatch], at: int, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut so that column ``at`` holds about ``size`` bytes of text, one row at least."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(at)), 0).to_numpy(zero_copy_only=False))
        lo = 0
        while lo < b.num_rows:
            base = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, base + size, side="right")))
            yield b.slice(lo, hi - lo)
            lo = hi
        del b
        pa.default_memory_pool().release_unused()


class Words:
    """The words of a column of texts: ``hashes``, and ``bounds``: row i has the words bounds[i] to bounds[i + 1]."""

    def __init__(self, texts: pa.Array, lower: bool = False) -> None:
        texts = texts.cast(pa.large_binary())
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.row_at = np.concatenate([[0], np.cumsum(sizes)])
        n = int(self.row_at[-1])
        data = np.zeros(n + 8, np.uint8)
        if n:
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            raw = np.frombuffer(texts.buffers()[2], np.uint8)
            if texts.null_count == 0 or int(offsets[-1] - offsets[0]) == n:
                data[:n] = raw[offsets[0] : offsets[0] + n]
            else:
                data[:n] = np.concatenate([raw[a : a + s] for a, s in zip(offsets[:-1], sizes, strict=True)])
        self.data = _LOWER[data] if lower else data
        inside = ~_SPACE[self.data[:n]]
        head = inside.copy()
        head[1:] &= ~inside[:-1]
        tail = inside.copy()
        tail[:-1] &= ~inside[1:]
        edges = self.row_at[1:-1]
        edges = edges[(edges > 0) & (edges < n)]
        head[edges] = inside[edges]
        tail[edges - 1] = inside[edges - 1]
        self.starts, self.ends = np.flatnonzero(head), np.flatnonzero(tail) + 1
        self.bounds = np.searchsorted(self.starts, self.row_at)
        self.hashes = self._hashed()

    def _hashed(self) -> np.ndarray:
        length = self.ends - self.starts
        lanes = np.ndarray((len(self.data) - 7,), "<u8", self.data, strides=(1,))
        left = np.minimum(length, 8)
        h = lanes[self.starts] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (64 - 8 * left).astype(np.uint64)) if len(length) else np.empty(0, np.uint64)
        h = mix(h * _MULT + length.astype(np.uint64))
        at = np.flatnonzero(length > 8)
        for k in range(8, LONG_WORD, 8):
            if not len(at):
                break
            left = np.minimum(length[at] - k, 8)
            lane = lanes[self.starts[at] + k] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (64 - 8 * left).astype(np.uint64))
            h[at] = mix((h[at] ^ lane) * _MULT + np.uint64(k))
            at = at[length[at] > k + 8]
        for i in at.tolist():
            h[i] = xxhash.xxh3_64_intdigest(self.data[self.starts[i] : self.ends[i]].tobytes())
        return h

    def row_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, at, side="right") - 1


def run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of every run of ``n`` words, in order."""
    count = len(words) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    if n == 1:
        return mix(words * _MULT)
    out = np.empty(count, np.uint64)
    step = 1 << 20
    for lo in range(0, count, step):
        own = words[lo : lo + step + n - 1]
        up = np.full(len(own) + 1, _STEP)
        up[0] = 1
        up = np.cumprod(up, dtype=np.uint64)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(own * up[:-1], dtype=np.uint64)])
        size = len(own) - n + 1
        down = np.full(size, _BACK)
        down[0] = 1
        out[lo : lo + size] = mix((sums[n:] - sums[:-n]) * np.cumprod(down, dtype=np.uint64))
    return out


def sliding(h: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (np.minimum or np.maximum) over every ``width`` neighbours, by doubling."""
    out, done = h, 1
    while done * 2 <= width:
        out = pick(out[: len(out) - done], out[done:])
        done *= 2
    rest = width - done
    return pick(out[: len(out) - rest], out[rest:]) if rest else out
