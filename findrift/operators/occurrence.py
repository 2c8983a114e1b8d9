"""How often evidence occurs: repeated evidence is degraded and never proves identity.

Evidence is counted by digest, and only what repeats is joined back to its findings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from findrift.functions.exprs import ascii_lower

ID = ["case_name", "side", "finding_key"]
BUCKET = ["case_name", "side", "producer_identity", "canonical_rule"]


def producer_fp_counts(findings: DataFrame) -> DataFrame:
    """Findings per producer fingerprint: distinct values of a finding count once; per run and rule."""
    each = findings.select(*BUCKET, "run_key", "finding_key", F.explode(F.array_distinct(F.transform("producer_fps", _fp_identity))).alias("fp"))
    return (
        each.groupBy(*BUCKET, "run_key", "fp").agg(F.count("*").alias("n")).select(*BUCKET, "run_key", "fp.family", "fp.version", "fp.value", "n")
    )


def _fp_identity(x: Column) -> Column:
    return F.struct(x["family"].alias("family"), x["version"].alias("version"), x["value"].alias("value"))


def fp_collisions(findings: DataFrame) -> DataFrame:
    """The values that are not unique in their run and rule (each is a MATCH0005 warning)."""
    return producer_fp_counts(findings).where("n > 1")


def fp_reliability(findings: DataFrame) -> DataFrame:
    """Findings with each fingerprint's reliability: degraded where its name and value recur in the run and rule."""
    each = findings.select(*ID, "run_key", "canonical_rule", F.posexplode("producer_fps").alias("at", "fp"))
    key = ["case_name", "side", "run_key", "canonical_rule"]
    seen = each.select(*key, F.col("fp.name").alias("name"), F.col("fp.value").alias("value"), "finding_key").distinct()
    repeated = seen.groupBy(*key, "name", "value").agg(F.count("*").alias("n")).where("n > 1")
    marked = each.withColumn("name", F.col("fp.name")).withColumn("value", F.col("fp.value")).join(repeated, [*key, "name", "value"], "left")
    level = F.when(F.col("n").isNull(), "high").otherwise("degraded")
    back = marked.groupBy(*ID).agg(F.array_sort(F.collect_list(F.struct("at", F.col("fp").withField("reliability", level).alias("fp")))).alias("fps"))
    joined = findings.join(back.withColumn("fps", F.transform("fps", lambda x: x["fp"])), ID, "left")
    return joined.withColumn("producer_fps", F.coalesce("fps", "producer_fps")).drop("fps")


def _mapped(fold: bool, f) -> list[Column]:
    """``f`` of every countable piece of evidence of a finding, as arrays."""
    none = F.lit(None).cast("string")

    def item(kind: str, name: Column, algorithm: Column, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), name.alias("name"), algorithm.alias("algorithm"), value.alias("value"))

    kinds = {"context-snippet": F.col("context.snippet_hash"), "context-token-window": F.col("context.token_window_hash")}
    context = F.array_compact(F.array(*[F.when(v.isNotNull(), f(item(kind, none, none, v))) for kind, v in kinds.items()]))
    derived = F.transform("derived_fps", lambda x: f(item("derived", x["name"], x["algorithm"], x["value"])))
    anchors = F.transform("anchors", lambda x: f(item("anchor", ascii_lower(x["canonical_path"]) if fold else x["canonical_path"], none, x["context_hash"])))
    empty = F.slice(context, 1, 0)
    return [context, F.coalesce(derived, empty), F.coalesce(anchors, empty)]


def _evidence(fold: bool) -> Column:
    """Every countable piece of evidence of a finding, once."""
    return F.array_distinct(F.concat(*_mapped(fold, lambda x: x)))


def evidence_items(findings: DataFrame, fold: bool = False) -> DataFrame:
    """Every countable piece of evidence of a finding, once: kind, name, algorithm, value."""
    return findings.select(*BUCKET, "finding_key", F.explode(_evidence(fold)).alias("item")).select(*BUCKET, "finding_key", "item.*")


def evidence_counts(findings: DataFrame, fold: bool = False) -> DataFrame:
    """Findings per context hash, derived fingerprint and code-flow anchor, per producer and rule of a side."""
    return evidence_items(findings, fold).groupBy(*BUCKET, "kind", "name", "algorithm", "value").agg(F.count("*").alias("n"))


def _digest(*fields: Column) -> Column:
    """128 bits of the fields and of which are null."""
    told = [x for f in fields for x in (f, f.isNull())]
    return F.struct(F.xxhash64(*told).alias("h"), F.xxhash64(F.lit("again"), *told).alias("g"))


def with_occurrences(findings: DataFrame, fold: bool = False) -> DataFrame:
    """Findings with ``fp_repeats`` and ``repeats``: their own evidence that occurs more than once, with its count.

    Only digests and keys are shuffled to be counted; the values of what repeats are read from the finding itself.
    """
    bucket = [F.col(c) for c in BUCKET]
    items, fps = _evidence(fold), F.array_distinct(F.transform("producer_fps", _fp_identity))
    of_item = lambda x: _digest(*bucket, x["kind"], x["name"], x["algorithm"], x["value"])
    of_fp = lambda x: _digest(*bucket, F.col("run_key"), x["family"], x["version"], x["value"])
    digests = F.array_distinct(F.concat(*_mapped(fold, of_item), F.coalesce(F.transform("producer_fps", of_fp), F.array().cast("array<struct<h:bigint,g:bigint>>"))))
    # Not by way of a column: the optimizer would test that for being empty below, with all that makes it.
    each = findings.select(*ID, F.explode(digests).alias("d"))
    counted = each.select(*ID, F.count("*").over(Window.partitionBy("side", "d.h", "d.g")).alias("n"), "d.h", "d.g").where("n > 1")
    hot = counted.groupBy(*ID).agg(F.collect_list(F.struct("h", "g", "n")).alias("hot"))

    def repeated(own: Column, digest) -> Column:
        n = lambda d: F.get(F.filter("hot", lambda z: (z["h"] == d["h"]) & (z["g"] == d["g"])), F.lit(0))["n"]
        return F.filter(F.transform(own, lambda x: x.withField("n", n(digest(x)))), lambda x: x["n"].isNotNull())

    none_fp = F.array().cast("array<struct<family:string,version:int,value:string,n:bigint>>")
    none = F.array().cast("array<struct<kind:string,name:string,algorithm:string,value:string,n:bigint>>")
    joined = findings.join(hot, ID, "left")
    some = F.col("hot").isNotNull()
    return joined.withColumn("fp_repeats", F.when(some, F.coalesce(repeated(fps, of_fp), none_fp)).otherwise(none_fp)).withColumn(
        "repeats", F.when(some, F.coalesce(repeated(items, of_item), none)).otherwise(none)
    ).drop("hot")


def count_of(repeats: Column, kind: str, value: Column, name: Column | None = None, algorithm: Column | None = None) -> Column:
    """The count of one piece of evidence in ``repeats``; 1 where it isn't there."""
    null = F.lit(None).cast("string")
    name = null if name is None else name
    algorithm = null if algorithm is None else algorithm
    hit = F.filter(
        repeats,
        lambda x: (x["kind"] == kind) & x["value"].eqNullSafe(value) & x["name"].eqNullSafe(name) & x["algorithm"].eqNullSafe(algorithm),
    )
    return F.coalesce(F.get(hit, F.lit(0))["n"], F.lit(1)).cast("long")
