"""SimHash near-duplicates by multi-index hashing.

A 64-bit fingerprint is cut into segments, and each segment has a table of the fingerprints by the
segment's value.  For a distance r = a * segments + b, two fingerprints within r differ by at most a
bits in one of the first b + 1 segments, or by at most a - 1 in one of the others (Norouzi, Punjani and
Fleet, 2012); so the Hamming ball of that radius around each segment's value is enumerated, its values
are fetched from the segment's table, and whole distances are verified.  At r = 2 and two segments of 32
bits that is 33 values in the first table and one in the second.

A value under which many fingerprints lie (data of one kind may share a whole segment) would give all
pairs of them.  Fingerprints that meet such a value are indexed by a nested split instead: the key is
the whole fingerprint with up to half the distance's bits flipped, under which only a few can lie.
Equal fingerprints are one row before all that, so copies cost nothing.

``candidates`` is an index of the same kind for a wide radius, where balls of all bits would be too large:
its balls are of a segment's least certain bits, on both sides of the table, and the caller verifies the
true similarity of the pairs it proposes.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hex64, lean, slices, spread, written
from .graph import components

BITS, SEGMENTS = 64, 2
#: Fingerprints under one segment value above which its members go through the nested split.
BUCKET = 256
#: Of ``candidates``: segments, and bits of each that its balls are of.
TABLES, UNSURE = 3, 4
#: Candidates differ in so many bits at most.  Sets with a Jaccard similarity of 0.8 have cosine 8/9: 9.7 bits differ on average, deviation 2.9.
WIDE = 16


def fingerprint(text: str, words_per_shingle: int = 3, step: int = 65536) -> int:
    """The unsigned 64-bit SimHash of a text's word shingles; 0 where there is no word."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - words_per_shingle + 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[:-1].tolist()]
    stops = (ends - 1)[words_per_shingle - 1 :].tolist() or [len(joined)]
    hash_, ones = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for lo in range(0, n, step):
        h = np.array([hash_(joined[a:b], 42) for a, b in zip(starts[lo : lo + step], stops[lo : lo + step], strict=False)], ">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 3) -> DataFrame:
    """``id_col`` and ``fingerprint`` (signed long) of every whole text; null or wordless texts have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1024):
            values = [fingerprint(t.as_py() or "", words_per_shingle) for t in part.column(1)]
            signed = pa.array([v - (v >> 63 << 64) for v in values], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), signed], names=[id_col, "fingerprint"])

    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("fingerprint", T.LongType())])
    return lean(df.select(id_col, text_col)).mapInArrow(run, schema)


def _segments(count: int) -> list[tuple[int, int]]:
    return list(itertools.pairwise(BITS * s // count for s in range(count + 1)))


def set_fingerprints(hashes: np.ndarray, bounds: np.ndarray, unsure: int = UNSURE) -> tuple[np.ndarray, np.ndarray]:
    """The SimHash of each set ``hashes[bounds[i]:bounds[i + 1]]``, and a mask of the least certain bits of each segment.

    A bit is 1 if set in over half of the hashes, and the less certain the nearer to half; an empty set has 0.
    """
    size = np.diff(bounds).astype(np.int64)
    some = np.flatnonzero(size)
    ones = np.zeros((len(size), BITS), np.int64)
    low, lanes = np.uint64(0xFFFFFFFF), np.uint64(1 << 32 | 1)
    for bit in range(BITS // 2 if len(some) else 0):
        both = np.add.reduceat(hashes >> np.uint64(bit) & lanes, bounds[:-1][some])  # the bit's count, and above it that of the bit 32 places up
        ones[some, bit], ones[some, bit + 32] = both & low, both >> np.uint64(32)
    lead = 2 * ones - size[:, None]
    place = np.uint64(1) << np.arange(BITS, dtype=np.uint64)
    mask = np.zeros(len(size), np.uint64)
    for lo, hi in _segments(TABLES):
        least = lo + np.argsort(np.abs(lead[:, lo:hi]), axis=1, kind="stable")[:, :unsure]
        mask |= np.bitwise_or.reduce(place[least], axis=1)
    return ((lead > 0) * place).sum(axis=1, dtype=np.uint64), mask


def radii(max_distance: int, segments: int) -> list[int]:
    """The radius to be searched in each segment's table; -1 where none has to be."""
    a, b = divmod(max_distance, segments)
    return [a if i <= b else a - 1 for i in range(segments)]


def ball(lo: int, hi: int, radius: int) -> list[int]:
    """Signed masks with up to ``radius`` bits set among the bits ``lo`` to ``hi`` - 1."""
    masks = [sum(1 << bit for bit in bits) for n in range(radius + 1) for bits in itertools.combinations(range(lo, hi), n)]
    return [_signed(m) for m in masks]


def _signed(v: int) -> int:
    return v - (v >> 63 << 64)


def _keyed(prints: DataFrame, masks: list[tuple[int, int]], segments: int) -> DataFrame:
    """fp, seg, key: each fingerprint under every (segment, mask), as the segment's value."""
    width = BITS // segments
    whole = F.array(*[F.lit(_signed(((1 << width) - 1) << (s * width))).cast("long") for s in range(segments)])
    entry = F.explode(F.array(*[F.struct(F.lit(s).alias("s"), F.lit(m).cast("long").alias("m")) for s, m in masks])).alias("e")
    return prints.select("fp", entry).select("fp", F.col("e.s").alias("seg"), F.col("fp").bitwiseXOR(F.col("e.m")).bitwiseAND(F.get(whole, F.col("e.s"))).alias("key"))


def _nested(prints: DataFrame, max_distance: int) -> DataFrame:
    """Links between fingerprints by keys that are half the distance from either: buckets stay small whatever the data."""
    masks = ball(0, BITS, (max_distance + 1) // 2)
    keys = prints.select("fp", F.explode(F.array(*[F.lit(m).cast("long") for m in masks])).alias("m")).select("fp", F.col("fp").bitwiseXOR(F.col("m")).alias("key"))
    if max_distance == 2:
        # Any two members of a bucket are within 2 bits, so each links to the one before it.
        bucket = Window.partitionBy("key").orderBy("fp")
        return keys.select(F.lag("fp").over(bucket).alias("u"), F.col("fp").alias("v")).where("u is not null")
    many = keys.select(F.col("fp").alias("u"), "key").join(keys.select(F.col("fp").alias("v"), "key"), "key")
    return many.where("u < v").select("u", "v")


def links(distinct: DataFrame, max_distance: int = 2, segments: int = SEGMENTS, bucket: int = BUCKET) -> DataFrame:
    """Links (u, v) between distinct fingerprints (column fp), enough to connect all within ``max_distance``.

    The fingerprints go over all partitions before their balls are made, since they are few bytes and
    would fill few tasks.
    """
    if not 0 <= max_distance <= 4 or BITS % segments:
        raise ValueError("max_distance is 0 to 4; segments divide 64")
    radius, width = radii(max_distance, segments), BITS // segments
    spread_out = distinct.select("fp").repartition(spread(distinct))
    searched = [s for s in range(segments) if radius[s] >= 0]
    table = _keyed(spread_out, [(s, 0) for s in searched], segments)
    hot = written(table.groupBy("seg", "key").count().where(F.col("count") > bucket).select("seg", "key"))
    probes = _keyed(spread_out, [(s, m) for s in searched for m in ball(s * width, (s + 1) * width, radius[s])], segments)
    if hot.isEmpty():
        nested = None
    else:
        crowded = probes.join(hot, ["seg", "key"], "left_semi").select("fp").distinct()  # a radius-0 probe is the member itself
        nested = _nested(crowded, max_distance)
        table = table.join(hot, ["seg", "key"], "left_anti")
    met = probes.join(table.withColumnRenamed("fp", "v"), ["seg", "key"]).select(F.col("fp").alias("u"), "v")
    pairs = met.where("u <> v") if nested is None else met.where("u <> v").unionByName(nested)
    return pairs.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= max_distance)


def _met(keyed: DataFrame, widest: int, bucket: int) -> DataFrame:
    """Pairs (u, v) of fingerprints under one key that differ in up to ``widest`` bits; each meets up to ``bucket`` before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp = np.empty(0, np.int64), np.empty(0, np.int64)  # the last rows of the key that the next batch may go on with
        for b in batches:
            before = len(key)
            key, fp = (np.concatenate([old, new.to_numpy()]) for old, new in zip((key, fp), b.columns, strict=True))
            us, vs = [], []
            for k in range(1, min(bucket, len(key) - 1) + 1):
                at = np.flatnonzero(key[k:] == key[:-k])
                if not len(at):
                    break
                at = at[at + k >= before]
                far = np.bitwise_count((fp[at] ^ fp[at + k]).view(np.uint64))
                at = at[(far > 0) & (far <= widest)]
                us.append(fp[at])
                vs.append(fp[at + k])
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], names=["u", "v"])
            if len(key):
                last = max(int(np.searchsorted(key, key[-1])), len(key) - bucket)
                key, fp = key[last:], fp[last:]

    return lean(keyed.select("key", "fp").repartition("key").sortWithinPartitions("key", "fp")).mapInArrow(run, "u long, v long")


def table_keys(fp: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """A row per fingerprint: for each segment its values with every setting of the masked bits, in their places."""
    keys = []
    for lo, hi in _segments(TABLES):
        segment = np.uint64((1 << hi) - (1 << lo))
        left = mask & segment
        own = [fp & ~mask & segment]
        while left.any():
            bit = left & (~left + np.uint64(1))
            own += [k | bit for k in own]
            left ^= bit
        keys += own
    return np.stack(keys, axis=1)


def candidates(prints: DataFrame, widest: int = WIDE, bucket: int = BUCKET) -> DataFrame:
    """Candidate pairs (u, v) of distinct fingerprints (columns fp, unsure) that differ in ``widest`` bits or fewer.

    Each segment's table holds every fingerprint under the Hamming ball of the segment's unsure bits, so
    two fingerprints meet wherever all bits in which one of their segments differs are unsure in either;
    for those are the bits that an edit turns.  Under a crowded value each fingerprint meets the
    ``bucket`` before it only.  What the tables miss, the caller has to find in another way.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp, mask = (c.to_numpy().view(np.uint64) for c in b.columns)
            keys = table_keys(fp, mask)
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(np.repeat(fp, keys.shape[1]).view(np.int64))], names=["key", "fp"])

    keyed = lean(prints.select("fp", "unsure").repartition(spread(prints))).mapInArrow(run, "key long, fp long")
    # Segments keep their places, so their values are apart but for zero, where chance meetings do no harm.
    return _met(keyed, widest, bucket).distinct()


def _classes(df: DataFrame, id_col: str, text_col: str, max_distance: int, words_per_shingle: int) -> tuple[DataFrame, DataFrame]:
    """(_id, _hash, fingerprint of each row; fp, head: the least (_id, _hash) of the fingerprint's class, null ids last)."""
    named = df.select(F.struct(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_hash")).alias("_key"), F.col(text_col).alias("_text"))
    prints = written(fingerprints(named, "_key", "_text", words_per_shingle).select("_key.*", "fingerprint"))
    place = F.struct(F.col("_id").isNull().alias("_none"), "_id", "_hash")
    distinct = prints.groupBy(F.col("fingerprint").alias("fp")).agg(F.min(place).alias("least"))
    roots = components(links(distinct.select("fp"), max_distance))
    placed = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    first = placed.groupBy("root").agg(F.min("least").alias("head"))
    return prints, placed.select("fp", "root").join(first, "root").select("fp", "head")


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_distance: int = 2, words_per_shingle: int = 3
) -> DataFrame:
    """Classes of near-duplicates: ``id_col``, fingerprint (16 hex digits), component_id.

    One row per row of ``df``, repeated rows and ids included.  Fingerprints at ``max_distance`` or
    fewer differing bits link, and component_id is the least id reachable by links (null only where
    all ids of a class are null).  Null and empty texts have fingerprint zero, linked like any other.
    An empty table gives an empty result; other columns of ``df`` are ignored.
    """
    prints, named = _classes(df, id_col, text_col, max_distance, words_per_shingle)
    return prints.join(named, F.col("fingerprint") == F.col("fp")).select(
        F.col("_id").alias(id_col), hex64(F.col("fingerprint")).alias("fingerprint"), F.col("head._id").alias("component_id")
    )


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_distance: int = 2, words_per_shingle: int = 3) -> DataFrame:
    """``df`` with one document of each near-duplicate class: the one with the least id.

    A document is an id with a text: of two texts under the least id, the one with the lesser hash
    stays, and the other goes only if it is in the same class.  Rows that repeat the kept id and text
    keep one row; rows with a null id are never dropped.
    """
    prints, named = _classes(df, id_col, text_col, max_distance, words_per_shingle)
    heads = named.select(F.col("head._id").alias("_hid"), F.col("head._hash").alias("_hhash")).distinct()
    rows = df.select(F.struct("*").alias("_row"), F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_hash"))
    at = (F.col("_id") == F.col("_hid")) & (F.col("_hash") == F.col("_hhash"))
    stay = rows.where("_id is not null").join(heads, at, "left_semi").dropDuplicates(["_id", "_hash"])
    return stay.unionByName(rows.where("_id is null")).select("_row.*")
