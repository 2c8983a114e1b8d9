"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are grouped into buckets of similar length, longest first.  The first bucket gives every
query a proven lower bound of its k-th score.  With it, a query visits only buckets that can still
hold a better product (its length times the bucket's longest), and inside a bucket the local cosine
threshold (bound / lengths) chooses the pruning: above 1 nothing can qualify; high thresholds prune
by the query's largest coordinates, whose feasible intervals are narrow then; others by length alone.
What is left is verified by whole products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written

K, SCALE = 20, 64.0
#: Vectors in a bucket (about) and queries in a block: a task's matrices, whatever the table's size.
BUCKET_ROWS, QUERY_ROWS = 16_384, 2_048
#: Length classes are 2 % wide; their number is bounded by the range of doubles.
CLASSES_PER_E = 50.0
#: From this local cosine threshold on, coordinates prune; below, their intervals are too wide.
COORDINATE_FROM = 0.8
FOCUS = 3
EXACT = float(1 << 53)
OUT = "query_id long, vec_id long, score long"


def quantise(vector: Column, scale: float = SCALE) -> Column:
    """floor(scale * x) of each component as doubles; null where the vector or a component is null or not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    # floor() of a double is a long in SQL; the remainder keeps huge values as doubles.
    whole = F.transform(vector, lambda x: _floor(x.cast("double") * scale))
    return F.when(vector.isNotNull() & ~bad, whole)


def _floor(y: Column) -> Column:
    return F.when(F.abs(y) < EXACT, F.floor(y).cast("double")).otherwise(y)


def _matrix(c: pa.ChunkedArray, dims: int) -> np.ndarray:
    """Rows of a list column, shorter ones padded with zeros."""
    a = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
    if isinstance(a, pa.ChunkedArray):
        a = pa.concat_arrays(a.chunks) if a.num_chunks else pa.array([], pa.list_(pa.float64()))
    sizes = np.diff(a.offsets.to_numpy())
    flat = a.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(sizes), dims))
    out[np.arange(dims) < sizes[:, None]] = flat
    return out


def _width(c: pa.ChunkedArray) -> int:
    return pc.max(pc.list_value_length(c)).as_py() or 0


def _products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact integer products; doubles where they hold them, else Python integers clipped to longs."""
    bound = np.sqrt((q**2).sum(axis=1).max(initial=0)) * np.sqrt((v**2).sum(axis=1).max(initial=0))
    if bound < EXACT / 2:
        return q @ v.T
    whole = np.vectorize(int, otypes=[object])
    exact = whole(q) @ whole(v).T
    return np.vectorize(lambda x: max(-(1 << 63), min((1 << 63) - 1, x)), otypes=[object])(exact)


def _search(qid, q, qnorm, theta, vid, v, vnorm, k) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Best k candidates of one bucket for each query of a block, none below the query's bound."""
    order = np.argsort(-vnorm, kind="stable")
    vid, v, vnorm = vid[order], v[order], vnorm[order]
    longest = vnorm[0]
    with np.errstate(divide="ignore", invalid="ignore"):
        local = np.where((qnorm > 0) & (longest > 0), theta / (qnorm * longest), np.where(theta > 0, np.inf, -np.inf))
    found = []
    near = local >= COORDINATE_FROM
    for i in np.flatnonzero(near & (local <= 1 + 1e-9)):
        with np.errstate(divide="ignore", invalid="ignore"):
            keep = vnorm >= theta[i] / qnorm[i] * (1 - 1e-9)
            t = theta[i] / (qnorm[i] * vnorm)
            for f in np.argsort(-np.abs(q[i]))[:FOCUS]:
                c, x = q[i, f] / qnorm[i], v[:, f] / vnorm
                spread = np.sqrt(np.maximum(1 - t**2, 0) * max(1 - c**2, 0))
                # t * c +- spread bounds x for cosines of at least t, where |c| or t is large enough.
                low = np.where(c >= -t, c * t - spread, -1)
                high = np.where(c <= t, c * t + spread, 1)
                keep &= (x >= low - 1e-9) & (x <= high + 1e-9)
        at = np.flatnonzero(keep)
        if len(at):
            found += _pick(qid[i : i + 1], _products(q[i : i + 1], v[at]), theta[i : i + 1], vid[at], k)
    far = np.flatnonzero(~near)
    for lo in range(0, len(far), 256):
        rows = far[lo : lo + 256]
        with np.errstate(divide="ignore", invalid="ignore"):
            need = np.where(qnorm[rows] > 0, theta[rows] / qnorm[rows], -np.inf).min()
        n = int(np.searchsorted(-vnorm, -need * (1 - 1e-9), side="right")) if need > 0 else len(vnorm)
        if n:
            found += _pick(qid[rows], _products(q[rows], v[:n]), theta[rows], vid[:n], k)
    return found


def _pick(qid, scores, theta, vid, k) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    ids, first = np.unique(vid, return_index=True)
    if len(ids) < len(vid):  # rows that share an id act as one, by their best product
        order = np.argsort(vid, kind="stable")
        starts = np.searchsorted(vid[order], ids)
        scores = np.maximum.reduceat(scores[:, order], starts, axis=1)
    else:
        scores = scores[:, first]
    own = ids[None, :] == qid[:, None]
    low = np.where(np.isfinite(theta), theta, -np.inf)
    if scores.dtype != object:
        scores = np.where(own, -np.inf, scores)
        if scores.shape[1] > k:
            low = np.maximum(low, np.partition(scores, -k, axis=1)[:, -k])
        r, c = np.nonzero((scores >= low[:, None]) & ~own)
        return [(qid[r], ids[c], scores[r, c].astype(np.int64))]
    out = []
    for i in range(len(qid)):
        c = [j for j in range(len(ids)) if not own[i, j] and scores[i, j] >= low[i]]
        c = sorted(c, key=lambda j: (-scores[i, j], ids[j]))[:k]
        out.append((np.full(len(c), qid[i]), ids[c], np.array([scores[i, j] for j in c], np.int64)))
    return out


def _cut(parts: list, k: int) -> pa.Table:
    """At most k rows a query, ties to the smaller id."""
    empty = np.array([], np.int64)
    qid, vid, score = (np.concatenate([empty, *[p[i] for p in parts]]) for i in range(3))
    order = np.lexsort((vid, -score.astype(float), qid)) if (np.abs(score.astype(float)) < EXACT).all() else np.array(
        sorted(range(len(qid)), key=lambda i: (qid[i], -int(score[i]), vid[i])), int
    )
    qid, vid, score = qid[order], vid[order], score[order]
    starts = np.flatnonzero(np.r_[True, qid[1:] != qid[:-1]]) if len(qid) else empty
    rank = np.arange(len(qid)) - np.repeat(starts, np.diff(np.r_[starts, len(qid)]))
    keep = rank < k
    return pa.table({"query_id": qid[keep], "vec_id": vid[keep], "score": score[keep]}, pa.schema([(c, pa.int64()) for c in ("query_id", "vec_id", "score")]))


def _match(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """Joins query blocks and buckets that meet: queries (bucket, block, qid, qv, qnorm, theta), vectors (bucket, block, id, v, norm)."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _cut([], k)
        dims = max(_width(left.column("qv")), _width(right.column("v")))
        q, v = _matrix(left.column("qv"), dims), _matrix(right.column("v"), dims)
        num = lambda t, c: t.column(c).to_numpy()
        return _cut(_search(num(left, "qid"), q, num(left, "qnorm"), num(left, "theta"), num(right, "id"), v, num(right, "norm"), k), k)

    return queries.groupBy("bucket", "block").cogroup(vectors.groupBy("bucket", "block")).applyInArrow(run, OUT)


def _plan(classes: list, bucket_rows: int) -> tuple[list[tuple[int, int, int]], list[float], int]:
    """(class, first bucket, buckets) for each length class, each bucket's longest vector, vectors in bucket 0."""
    out, longest, open_rows, first_rows = [], [], bucket_rows, 0
    for c in sorted(classes, key=lambda r: -r["cls"]):
        n = c["n"]
        if n > bucket_rows:  # a hot class: split by a hash into buckets of its own
            splits = -(-n // bucket_rows)
            out.append((c["cls"], len(longest), splits))
            first_rows = first_rows or n // splits
            longest += [c["longest"]] * splits
            open_rows = bucket_rows
            continue
        if open_rows + n > bucket_rows:
            longest.append(c["longest"])
            open_rows = 0
        open_rows += n
        if len(longest) == 1:
            first_rows = open_rows
        out.append((c["cls"], len(longest) - 1, 1))
    return out, longest, first_rows


def _visits(known: DataFrame, longest: list[float]) -> DataFrame:
    """bucket, block, qid, qv, qnorm, theta: for each query the buckets after the first that may hold a score of theta or more.

    Buckets come longest first, so those are the buckets up to one; it is found in the sorted bounds.
    """
    bounds = known.sparkSession.sparkContext.broadcast(-np.array(longest))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            qnorm, theta = (b.column(c).to_numpy(zero_copy_only=False) for c in ("qnorm", "theta"))
            with np.errstate(divide="ignore", invalid="ignore"):
                least = np.where(qnorm > 0, theta / qnorm * (1 - 1e-9), np.where(theta > 0, np.inf, -np.inf))
            least = np.where(least <= 0, -np.inf, least)
            until = np.searchsorted(bounds.value, -least, side="right") - 1
            yield b.append_column("until", pa.array(until, pa.int32()))

    schema = T.StructType([*known.schema.fields, T.StructField("until", T.IntegerType())])
    bucket = F.explode(F.sequence(F.lit(1), F.col("until"))).alias("bucket")
    return known.mapInArrow(run, schema).where("until >= 1").select(bucket, "block", "qid", "qv", "qnorm", "theta")


def top_k(
    df: DataFrame,
    is_query: Column,
    k: int = K,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: float = SCALE,
    bucket_rows: int = BUCKET_ROWS,
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """Each query's k best rows by the inner product of floor(scale * x): query_id, rank, vec_id, score.

    Queries are the rows where ``is_query`` holds; candidates are all rows but the query's own; ranks
    start at 1, ties go to the smaller id.  Vectors that are null or hold null or non-finite
    components, and null ids, take no part; shorter vectors count as padded with zeros; rows that
    share an id act as one with the best product; products beyond a long are clipped.  A query
    without candidates has no row; other columns are ignored.
    """
    spark = df.sparkSession
    v = quantise(F.col(vector_col), scale)
    all_ = df.select(F.col(id_col).cast("long").alias("id"), v.alias("v"), is_query.alias("is_query")).where("id is not null and v is not null")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    cls = F.when(F.col("norm") > 0, F.floor(F.log("norm") * CLASSES_PER_E)).otherwise(-(1 << 40)).cast("long")
    rows = all_.withColumn("norm", norm).withColumn("cls", cls)
    classes = rows.groupBy("cls").agg(F.count("*").alias("n"), F.max("norm").alias("longest")).collect()  # bounded: classes of doubles
    plan, longest, first_rows = _plan(classes, bucket_rows)
    if not plan:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    n_queries = rows.where("is_query").count()
    blocks = max(1, -(-n_queries // query_rows))
    table = F.broadcast(spark.createDataFrame(plan, "cls long, base int, splits int"))
    placed = rows.join(table, "cls").withColumn("bucket", (F.col("base") + F.pmod(F.xxhash64("id"), F.col("splits"))).cast("int"))
    block = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int")
    queries = rows.where("is_query").select(F.col("id").alias("qid"), F.col("v").alias("qv"), F.col("norm").alias("qnorm"), block.alias("block"))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")

    # The first bucket is bounded by bucket_rows; every block of queries reads it.
    head = placed.where("bucket = 0").select("bucket", every, "id", "v", "norm")
    # A bound needs k candidates besides the query's own row; with fewer it stays below all products.
    seeds = queries.select(F.lit(0).alias("bucket"), "block", "qid", "qv", "qnorm", F.lit(float("-inf")).alias("theta"))
    first = _match(seeds, head, k)
    if len(longest) > 1:
        first = written(first)
        # Groups are one block and bucket: their size is bounded by query_rows and bucket_rows.
        bounds = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("low"))
        theta = F.when(F.col("n") >= k, F.col("low").cast("double")).otherwise(F.lit(float("-inf")))
        known = queries.join(bounds, F.col("qid") == F.col("query_id"), "left").select("qid", "qv", "qnorm", "block", theta.alias("theta"))
        visits = written(_visits(known, longest))
        # A bucket goes only to the blocks with a query that visits it.
        pairs = visits.select("bucket", "block").distinct().toDF("to_bucket", "to_block")
        met = placed.where("bucket > 0").join(pairs, F.col("bucket") == F.col("to_bucket"))
        rest = met.select("bucket", F.col("to_block").alias("block"), "id", "v", "norm")
        first = first.unionByName(_match(visits, rest, k))
    best = first.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    ranked = best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast(T.IntegerType()).alias("rank"), "vec_id", "score")
