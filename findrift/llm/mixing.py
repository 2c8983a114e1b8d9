"""Mixing sources to target weights: every document is repeated a Poisson number of times.

DataFrame functions only.  A source's rate is its target rows over its rows; the number of copies of
a document inverts the Poisson distribution of that mean at a number in [0, 1) hashed from the seed
and the document, so a run can be repeated and a lost task recomputes the same copies.  Copies are
then shuffled over all partitions by a hash.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spread

#: Means above this are sums of equal parts, each drawn on its own, so that exp(-mean) stays exact.
PART = 8.0
#: Terms of a part's distribution: at mean 8 the tail beyond has a probability below 2 ** -53.
TERMS = 64
#: Rates of at most so many sources are broadcast; beyond that they are joined with salted keys.
BROADCAST_SOURCES = 10_000
SALTS = 64


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) with 48 bits from the MD5 of the seed and the parts, colon-separated."""
    shown = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *shown).cast("binary")), 1, 12)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 48))


def poisson_cdf(mean: Column) -> Column:
    """P(X <= 0), P(X <= 1), ... as an array of ``TERMS`` doubles."""

    def add(acc: Column, k: Column) -> Column:
        term = F.when(k == 0, F.exp(-mean)).otherwise(acc["term"] * mean / k)
        total = acc["total"] + term
        return F.struct(term.alias("term"), total.alias("total"), F.concat(acc["cdf"], F.array(total)).alias("cdf"))

    start = F.struct(F.lit(0.0).alias("term"), F.lit(0.0).alias("total"), F.array().cast("array<double>").alias("cdf"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(TERMS - 1)), start, add, lambda acc: acc["cdf"])


def rates(
    df: DataFrame, weights: dict[str, float] | None = None, source_col: str = "source", total: int | None = None, alpha: float = 0.5
) -> DataFrame:
    """One row per source: _source, n_rows, rate, parts, cdf (of one part).

    ``weights`` gives target weights by source (others get none); without it, a source's weight is its
    number of rows to the power ``alpha``.  ``total`` is the expected number of output rows; without
    it, that of the input.  A null source is a source of its own, named by null.
    """
    counts = df.groupBy(F.col(source_col).alias("_source")).agg(F.count("*").alias("n_rows"))
    if weights is None:
        weight = F.pow(F.col("n_rows").cast("double"), F.lit(alpha))
    elif weights:
        table = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))])
        weight = F.when(F.col("_source").isNull(), 0.0).otherwise(F.coalesce(F.try_element_at(table, F.coalesce("_source", F.lit(""))), F.lit(0.0)))
    else:
        weight = F.lit(0.0)
    weighed = counts.select("_source", "n_rows", weight.alias("weight"))
    sums = weighed.agg(F.sum("weight").alias("all_weight"), F.sum("n_rows").alias("all_rows"))
    goal = F.lit(float(total)) if total is not None else F.col("all_rows").cast("double")
    share = F.when(F.col("all_weight") > 0, F.col("weight") / F.col("all_weight")).otherwise(0.0)
    parts = F.greatest(F.ceil(F.col("rate") / PART), F.lit(1)).cast("int")
    # ``sums`` is one row, so this is no growing product.
    return (
        weighed.join(F.broadcast(sums))
        .select("_source", "n_rows", (share * goal / F.col("n_rows")).alias("rate"))
        .withColumn("parts", parts)
        .withColumn("cdf", poisson_cdf(F.col("rate") / F.col("parts")))
    )


def mix(
    df: DataFrame,
    weights: dict[str, float] | None = None,
    id_col: str = "doc_id",
    source_col: str = "source",
    seed: int = 17,
    total: int | None = None,
    alpha: float = 0.5,
    copy_col: str | None = "copy",
    shuffle: bool = True,
) -> DataFrame:
    """``df`` with each row repeated a Poisson number of times, so that sources meet their weights.

    The expected rows of a source are its share of ``total``; see ``rates``.  Rows of the same id get
    the same number of copies (the draw is the id's); null ids share one draw, null sources are one
    source.  ``copy_col`` numbers a row's copies from 0; ``shuffle`` spreads all copies over all
    partitions in an order set by a hash of the whole row.  A column named as ``copy_col`` gives way to
    it; other columns pass through.  An empty table gives an empty result.
    """
    per_source = rates(df, weights, source_col, total, alpha).select("_source", "parts", "cdf")
    rows = df.select(F.struct("*").alias("_row"), F.col(id_col).alias("_id"), F.col(source_col).alias("_src"))
    known = per_source.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    if known:
        joined = rows.join(F.broadcast(per_source), F.col("_src").eqNullSafe(F.col("_source")))
    else:
        salted = per_source.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("_of", F.pmod(F.xxhash64("_id"), F.lit(SALTS)).cast("int")).join(
            salted, F.col("_src").eqNullSafe(F.col("_source")) & (F.col("_of") == F.col("_salt"))
        )

    def draw(part: Column) -> Column:
        u = uniform(seed, F.col("_id"), part)
        return F.size(F.filter("cdf", lambda c: c <= u))

    copies = F.aggregate(F.sequence(F.lit(1), F.col("parts")), F.lit(0), lambda acc, part: acc + draw(part))
    counted = joined.select("_row", "_id", copies.alias("_n")).where("_n > 0")
    many = counted.select("_row", "_id", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_copy"))
    if shuffle:
        # Rows that share an id, or have none, must not share a partition.
        own = [F.col("_row")[f.name] for f in df.schema if not {"map", "variant"} & set(re.findall("[a-z]+", f.dataType.simpleString()))]
        many = many.withColumn("_at", F.xxhash64(F.lit(seed), "_id", "_copy", *own)).repartition(spread(df), "_at").sortWithinPartitions("_at")
    cols = [F.col("_row")[c].alias(c) for c in df.columns if copy_col is None or c.lower() != copy_col.lower()]
    return many.select(*cols, *([F.col("_copy").cast("long").alias(copy_col)] if copy_col else []))
