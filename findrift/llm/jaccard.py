"""Near-duplicates by the Jaccard similarity of word shingles: a SimHash multi-index, verified and completed.

Every set of shingles has a 64-bit SimHash.  The multi-index of ``simhash.candidates`` proposes pairs of
them within a wide radius, and their similarity is verified on the whole texts.  Sets of similarity 0.8
differ in about 10 bits and now and then in more than any segment table can reach, so what the index
misses is found by an exact prefix join, between sets that the index has not brought into one class.

Two sets of similarity t or more share a shingle among the first n - ceil(t n) + 1 of each, under any
order common to all sets, so these prefixes are a complete index: no pair is lost, whatever its
SimHash distance.  The order takes shingles by hash, but the frequent ones of a sample of texts last,
so that a common sentence seldom stands in a prefix; the sample steers cost only, never results.

Candidates of either kind are compared by bitmaps first: every shingle flips one bit, so two bitmaps differ
in at most as many bits as the sets have shingles not in common, and a pair whose bitmaps differ in more than
the similarity allows is none.  What is left is verified on the whole texts.  Equal sets are one row
before all that, so copies cost nothing; of the sets under a crowded shingle each is compared with one
of them first, and only those that are in different classes after that with each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import simhash
from .common import lean, written
from .graph import components
from .words import Words, mix, run_hashes, text_slices

WORDS, SIMILARITY = 5, 0.8
#: Texts sampled for the order, their shingles that are put last, and how often those occur at least.
SAMPLE_TEXTS, FREQUENT, FREQUENT_AT = 5_000, 100_000, 4
#: Up to so many sets to verify, their keys go to every executor and the other texts stay where they are.
BROADCAST_SETS = 300_000
#: Sets under one shingle from which they are compared with one of them first.
CROWD = 1_000
#: Bits of the smallest and the largest bitmap.
SMALL, LARGE = 512, 1 << 16


def shingle_sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of each text, sorted; a text of fewer words is one shingle."""
    own = Words(texts, lower=True)
    h = run_hashes(own.hashes, words)
    row = own.row_of(np.arange(len(h)))
    inside = np.arange(len(h)) + words <= own.bounds[row + 1]
    rows, hashes = [row[inside]], [h[inside]]
    sizes = np.diff(own.bounds)
    for n in range(1, words):
        short = np.flatnonzero(sizes == n)
        if len(short):
            rows.append(short)
            hashes.append(run_hashes(own.hashes, n)[own.bounds[short]])
    row, h = np.concatenate(rows), np.concatenate(hashes)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    first = np.ones(len(h), bool)
    first[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    return row[first], h[first]


def prefix_length(n: np.ndarray, similarity: float) -> np.ndarray:
    return np.where(n > 0, n - np.ceil(similarity * n - 1e-9).astype(np.int64) + 1, 0)


def bitmap(hashes: np.ndarray) -> bytes:
    """A bit per shingle hash, flipped: about four bits a shingle, a power of two in all."""
    bits = min(LARGE, max(SMALL, 1 << int(np.ceil(np.log2(max(1, 4 * len(hashes)))))))
    odd = np.bincount((hashes >> np.uint64(20) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def may_be_similar(a: bytes, b: bytes, na: int, nb: int, similarity: float) -> bool:
    """False only for sets that cannot have the similarity, by their bitmaps (the larger one folded)."""
    x, y = (np.frombuffer(v, np.uint64) for v in (a, b))
    while len(x) != len(y):
        if len(x) > len(y):
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        else:
            y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum()) <= (1 - similarity) / (1 + similarity) * (na + nb) + 1e-6


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both) - 1e-9


def _frequent(rows: DataFrame, words: int) -> np.ndarray:
    """Sorted hashes of the sample's most frequent shingles, FREQUENT at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, 0):
            yield pa.RecordBatch.from_arrays([pa.array(shingle_sets(part.column(0), words)[1].view(np.int64))], names=["shingle"])

    every = max(1, rows.count() // SAMPLE_TEXTS)
    sample = lean(rows).where(F.pmod("_hash", F.lit(every)) == 0).select("_text").mapInArrow(run, "shingle long")
    most = sample.groupBy("shingle").count().where(F.col("count") >= FREQUENT_AT).orderBy(F.desc("count"), "shingle").limit(FREQUENT)
    return np.sort(np.array([r["shingle"] for r in most.select("shingle").collect()], np.int64).view(np.uint64))


def sets(rows: DataFrame, words: int, similarity: float) -> DataFrame:
    """_id, _hash, node (hash of the shingle set), n (its size), fp, unsure (its SimHash), bits (its bitmap), prefix, for every whole text."""
    frequent = rows.sparkSession.sparkContext.broadcast(_frequent(rows, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = frequent.value
        for part in text_slices(batches, 2):
            row, h = shingle_sets(part.column(2), words)
            at = np.searchsorted(row, np.arange(part.num_rows + 1))
            size = np.diff(at)
            node = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h), dtype=np.uint64)])
            node = mix((node[at[1:]] - node[at[:-1]]) ^ size.astype(np.uint64))
            bits = [bitmap(h[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            found = np.minimum(np.searchsorted(last, h), max(len(last) - 1, 0))
            late = last[found] == h if len(last) else np.zeros(len(h), bool)
            order = np.lexsort((h, late, row))
            keep = np.arange(len(h)) - np.repeat(at[:-1], size) < np.repeat(prefix_length(size, similarity), size)
            prefix = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(prefix_length(size, similarity))]), pa.int32()), pa.array(h[order][keep].view(np.int64))
            )
            fp, unsure = (pa.array(v.view(np.int64)) for v in simhash.set_fingerprints(h, at))
            arrays = [pa.array(node.view(np.int64)), pa.array(size, pa.int32()), fp, unsure, pa.array(bits, pa.binary()), prefix]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *arrays], names=["_id", "_hash", "node", "n", "fp", "unsure", "bits", "prefix"])

    schema = T.StructType(
        [rows.schema["_id"], rows.schema["_hash"], T.StructField("node", T.LongType()), T.StructField("n", T.IntegerType()),
         T.StructField("fp", T.LongType()), T.StructField("unsure", T.LongType()), T.StructField("bits", T.BinaryType()), T.StructField("prefix", T.ArrayType(T.LongType()))]
    )
    return lean(rows.select("_id", "_hash", "_text")).mapInArrow(run, schema)


def _shared(prints: DataFrame) -> DataFrame:
    """shingle, node, n, at, root: the prefix shingles that stand in sets of two roots or more, and where."""
    held = prints.select("node", "n", "root", F.posexplode("prefix").alias("at", "shingle"))
    many = written(held.groupBy("shingle").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most").select(F.col("shingle").alias("s")))
    return written(held.join(many, F.col("shingle") == F.col("s")).select("shingle", "node", "n", "at", "root").distinct())


def _pairs(shared: DataFrame, similarity: float) -> DataFrame:
    """Pairs (u, v) of sets of different roots that share a prefix shingle, within the bounds of length and position.

    The first shingle that two sets share bounds what they have in common by what follows it in either, so a
    similar pair passes there.
    """
    names = [c for c in shared.columns if c != "shingle"]
    a, b = (shared.select("shingle", *[F.col(c).alias(f"{side}_{c}") for c in names]) for side in "uv")
    overlap = F.lit(similarity / (1 + similarity)) * (F.col("u_n") + F.col("v_n"))
    left = F.least(F.col("u_n") - F.col("u_at"), F.col("v_n") - F.col("v_at"))
    near = (F.least("u_n", "v_n") >= F.lit(similarity) * F.greatest("u_n", "v_n") - 1e-6) & (left >= overlap - 1e-6)
    met = a.join(b, "shingle").where((F.col("u_node") < F.col("v_node")) & (F.col("u_root") != F.col("v_root")) & near)
    return met.select(F.col("u_node").alias("u"), F.col("v_node").alias("v")).distinct()


def _similar_bits(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) whose sizes and bitmaps allow the similarity."""
    full = pairs.join(nodes.toDF("u", "un", "ub"), "u").join(nodes.toDF("v", "vn", "vb"), "v").where(F.least("un", "vn") >= F.lit(similarity) * F.greatest("un", "vn") - 1e-6)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [may_be_similar(x.as_py(), y.as_py(), m, n, similarity) for x, y, m, n in zip(b.column(2), b.column(3), b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True)]
            yield b.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))

    return full.select("u", "v", "ub", "vb", "un", "vn").mapInArrow(run, "u long, v long")


def _verified(pairs: DataFrame, rows: DataFrame, prints: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs (u, v) of sets that are similar, by their whole texts."""
    met = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    holder = written(prints.select("node", "_id", "_hash").join(met, "node").groupBy("node").agg(F.min(F.struct("_id", "_hash")).alias("of")))
    holder = F.broadcast(holder) if holder.count() <= BROADCAST_SETS else holder
    same = F.col("_id").eqNullSafe(F.col("of._id")) & F.col("_hash").eqNullSafe(F.col("of._hash"))
    texts = written(rows.join(holder, same).groupBy("node").agg(F.first("_text").alias("text")))
    full = pairs.join(texts.toDF("u", "ut"), "u").join(texts.toDF("v", "vt"), "v").select("u", "v", "ut", "vt")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, 2):
            sides = []
            for c in (2, 3):
                row, h = shingle_sets(part.column(c), words)
                sides.append(np.split(h, np.searchsorted(row, np.arange(1, part.num_rows))))
            ok = [similar(a, b, similarity) for a, b in zip(*sides, strict=True)]
            yield part.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))

    return full.mapInArrow(run, "u long, v long")


def _candidates(nodes: DataFrame) -> DataFrame:
    """Pairs (u, v) of sets by SimHash: each with the least of its fingerprint, and these where fingerprints meet in the multi-index."""
    least = written(nodes.groupBy("fp").agg(F.min(F.struct("node", "unsure")).alias("least")).select("fp", F.col("least.node").alias("head"), "least.unsure"))
    met, heads = simhash.candidates(least), least.select("fp", "head")
    between = met.join(heads.toDF("u", "u_head"), "u").join(heads.toDF("v", "v_head"), "v").select(F.col("u_head").alias("u"), F.col("v_head").alias("v"))
    return nodes.join(heads, "fp").where("node <> head").select(F.col("head").alias("u"), F.col("node").alias("v")).unionByName(between)


def _placed(sets: DataFrame, links: DataFrame) -> DataFrame:
    """``sets`` with the root of each node's class."""
    return sets.join(written(components(links)), "node", "left").withColumn("root", F.coalesce("root", "node"))


def links(rows: DataFrame, prints: DataFrame, words: int, similarity: float) -> DataFrame:
    """Verified links (u, v) between distinct shingle sets of ``prints``, enough to connect all similar ones."""
    prints = prints.where("n > 0")
    nodes = written(prints.groupBy("node").agg(F.max("n").alias("n"), F.max("bits").alias("bits"), F.max("fp").alias("fp"), F.max("unsure").alias("unsure")))
    sized = nodes.select("node", "n", "bits")

    def verified(pairs: DataFrame) -> DataFrame:
        return written(_verified(written(_similar_bits(written(pairs), sized, similarity)), rows, prints, words, similarity))

    near = verified(_candidates(nodes))
    shared = _shared(_placed(prints, near))
    sizes = written(shared.groupBy("shingle").agg(F.count("*").alias("many"), F.min(F.struct("node", "root")).alias("least")))
    few = shared.join(sizes.where(F.col("many") <= CROWD).select("shingle"), "shingle", "left_semi")
    crowded = sizes.where(F.col("many") > CROWD)
    stars = shared.join(crowded, "shingle").where("root <> least.root").select(F.col("least.node").alias("u"), F.col("node").alias("v"))
    found = near.unionByName(verified(_pairs(few, similarity).unionByName(stars).distinct()))
    if crowded.isEmpty():
        return found
    placed = _placed(shared.drop("root").join(crowded.select("shingle"), "shingle", "left_semi"), found)
    split = placed.groupBy("shingle").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("shingle")
    apart = written(placed.join(split, "shingle", "left_semi").select("shingle", "node", "n", "at", "root"))
    return found.unionByName(verified(_pairs(apart, similarity)))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """``df`` with one document of each class of near-duplicates: the one with the least id.

    Texts whose sets of shingles have a Jaccard similarity of ``similarity`` or more link, texts
    without a word (null ones too) link with each other, and a class is what links reach.  A document
    is an id with a text: of two texts under the least id, the one with the lesser hash stays, and the
    other goes only if it is in the same class.  Rows that repeat the kept id and text keep one row;
    rows with a null id are never dropped.  All columns pass through, whatever their names.
    """
    rows = df.select(F.struct("*").alias("_row"), F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_hash"), F.col(text_col).alias("_text"))
    bare = rows.select("_id", "_hash", "_text")
    prints = written(sets(bare, words, similarity))
    roots = components(links(bare, prints, words, similarity))
    own = prints.where("_id is not null").select("_id", "_hash", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = own.groupBy("_id", "_hash").agg(F.count("*").alias("times"), F.first("root").alias("root"))
    heads = named.groupBy("root").agg(F.min(F.struct("_id", "_hash")).alias("head"))
    placed = named.join(heads, "root").withColumn("kept", F.struct("_id", "_hash") == F.col("head"))
    # Those that go and those that repeat are the few: small enough tables of them leave the texts where they are.
    some = written(placed.where("not kept or times > 1").select(F.col("_id").alias("_xid"), F.col("_hash").alias("_xhash"), F.col("kept").alias("_kept")))
    at = (F.col("_id") == F.col("_xid")) & (F.col("_hash") == F.col("_xhash"))
    once = rows.drop("_text").join(some, at, "left_anti").select("_row")
    repeated = some.where("_kept")
    if repeated.isEmpty():
        return once.select("_row.*")
    again = rows.drop("_text").join(repeated, at, "left_semi").dropDuplicates(["_id", "_hash"]).select("_row")
    return once.unionByName(again).select("_row.*")
