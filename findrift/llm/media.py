"""Texts as images: a PNG writer and reader on numpy, and low-frequency cosine hashes.

The payload (UTF-8, padded with spaces to whole rows of 192 bytes) becomes an 8-bit RGB image of 64
pixels a row.  The stored bytes are read back through the chunk structure: each chunk's CRC-32 is
tested, zlib tests its own Adler-32, and the rows are unfiltered with numpy.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import lean, slices

SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH, CHANNELS = 64, 3
STRIDE = WIDTH * CHANNELS
GRID, LOW = 32, 8



def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def pad(data: bytes) -> bytes:
    """``data`` with spaces appended up to a positive multiple of 192 bytes."""
    return data + b" " * (-len(data) % STRIDE if data else STRIDE)


def write_png(payload: bytes, filter_type: int = 0, level: int = 6) -> bytes:
    """A payload of whole rows as a PNG; filter types 0 (none), 1 (sub) and 2 (up)."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, STRIDE)
    body = rows
    if filter_type == 1:
        body = rows.copy()
        body[:, CHANNELS:] -= rows[:, :-CHANNELS]
    elif filter_type == 2:
        body = rows.copy()
        body[1:] -= rows[:-1]
    elif filter_type:
        raise ValueError(f"filter type {filter_type}")
    marked = np.concatenate([np.full((len(rows), 1), filter_type, np.uint8), body], axis=1)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 2, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(marked.tobytes(), level)) + _chunk(b"IEND", b"")


def read_png(data: bytes) -> np.ndarray:
    """The samples, rows x (width * channels), of a non-interlaced 8-bit grey, RGB or RGBA PNG.

    Raises ValueError where the signature, a chunk's CRC, the order or the sizes are wrong.
    """
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, head, parts, ended = 8, None, [], False
    while at < len(data) and not ended:
        if at + 12 > len(data):
            raise ValueError("cut chunk")
        (n,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + n]
        if len(body) != n or at + 12 + n > len(data):
            raise ValueError("cut chunk")
        if zlib.crc32(kind + body) != struct.unpack_from(">I", data, at + 8 + n)[0]:
            raise ValueError(f"bad CRC in {kind!r}")
        if (head is None) != (kind == b"IHDR"):
            raise ValueError("IHDR must come first, once")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            parts.append(body)
        elif kind == b"IEND":
            ended = True
        at += 12 + n
    if not ended or head is None:
        raise ValueError("no IEND")
    width, height, depth, colour, packing, filtering, lace = head
    channels = {0: 1, 2: 3, 6: 4}.get(colour)
    if depth != 8 or channels is None or packing or filtering or lace:
        raise ValueError("unsupported form")
    stride = width * channels
    try:
        raw = zlib.decompress(b"".join(parts))
    except zlib.error as e:
        raise ValueError(str(e)) from None
    if len(raw) != height * (stride + 1):
        raise ValueError("wrong size")
    grid = np.frombuffer(raw, np.uint8).reshape(height, stride + 1)
    return unfilter(grid[:, 0], grid[:, 1:], channels)


def unfilter(types: np.ndarray, rows: np.ndarray, channels: int) -> np.ndarray:
    """Undo the five row filters; runs of rows with a filter that allows it go at once."""
    out = np.array(rows)
    if types.size and types.max() > 4:
        raise ValueError("unknown filter")
    if not types.any():
        return out
    height, stride = out.shape
    edges = np.flatnonzero(np.diff(types)) + 1
    for lo, hi in zip([0, *edges], [*edges, height], strict=True):
        kind = types[lo]
        if kind == 1:
            out[lo:hi] = np.cumsum(out[lo:hi].reshape(hi - lo, -1, channels), axis=1, dtype=np.uint8).reshape(hi - lo, stride)
        elif kind == 2:
            if lo:
                out[lo] += out[lo - 1]
            out[lo:hi] = np.cumsum(out[lo:hi], axis=0, dtype=np.uint8)
        elif kind in (3, 4):
            for y in range(lo, hi):
                row = out[y].reshape(-1, channels)
                above = out[y - 1].reshape(-1, channels) if y else np.zeros_like(row)
                left = corner = np.zeros(channels, np.int16)
                for x in range(len(row)):
                    up = above[x].astype(np.int16)
                    if kind == 3:
                        guess = (left + up) >> 1
                    else:
                        p = left + up - corner
                        a, b, c = abs(p - left), abs(p - up), abs(p - corner)
                        guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
                    row[x] += guess.astype(np.uint8)
                    left, corner = row[x].astype(np.int16), up
    return out


def _cosines(n: int, k: int) -> np.ndarray:
    return np.cos(np.pi * (2 * np.arange(n) + 1) * np.arange(k)[:, None] / (2 * n))


_BASIS = _cosines(GRID, LOW + 1)


def _shrink(a: np.ndarray, n: int) -> np.ndarray:
    """Area means of the rows of ``a`` on ``n`` equal bands, exact for any height."""
    total = np.vstack([np.zeros((1, a.shape[1])), np.cumsum(a, axis=0, dtype=np.float64)])
    at = np.linspace(0, len(a), n + 1)
    low = np.minimum(at.astype(int), len(a) - 1)
    cum = total[low] + (at - low)[:, None] * a[low]
    return np.diff(cum, axis=0) * (n / len(a))


def cosine_hash(samples: np.ndarray, channels: int = CHANNELS) -> bytes:
    """64 bits: which of the 8 x 8 lowest frequencies but the constant one lie above their median."""
    grey = samples.reshape(len(samples), -1, channels).mean(axis=2)
    grid = _shrink(np.ascontiguousarray(_shrink(grey, GRID).T), GRID).T
    low = np.round((_BASIS @ grid @ _BASIS.T).ravel()[1:65], 6)
    return np.packbits(low > np.median(low)).tobytes()


def store(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every whole text as a PNG: ``id_col``, n_bytes, media (the PNG), feature (8 bytes).

    A null text is an empty text, an empty text is one row of spaces; equal texts give equal values;
    one output row per input row, null and repeated ids included, ids of any type; other columns are
    ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 256):
            sizes, media, features = [], [], []
            for t in part.column(1).cast(pa.binary()):
                data = t.as_py() or b""
                stored = write_png(pad(data))
                sizes.append(len(data))
                media.append(stored)
                features.append(cosine_hash(read_png(stored)))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary()), pa.array(features, pa.binary())],
                names=[id_col, "n_bytes", "media", "feature"],
            )

    more = [T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType()), T.StructField("feature", T.BinaryType())]
    return lean(df.select(id_col, text_col)).mapInArrow(run, T.StructType([df.schema[id_col], *more]))


def digest(stored: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Reads the stored images back and returns their digest columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for n, media, feature in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                payload = read_png(media).tobytes()
                rows.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media),
                             hashlib.sha256(media).hexdigest(), feature.hex()))
            cols = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)]],
                                             names=[id_col, *NAMES])

    kinds = [T.LongType(), T.LongType(), T.StringType(), T.LongType(), T.LongType(), T.StringType(), T.StringType()]
    schema = T.StructType([stored.schema[id_col], *[T.StructField(n, k) for n, k in zip(NAMES, kinds, strict=True)]])
    return stored.select(id_col, "n_bytes", "media", "feature").mapInArrow(run, schema)


NAMES = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
