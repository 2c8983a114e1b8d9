"""Candidate pairs by blocking keys, under budgets that are checked before any pair exists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from findrift.config import Config, Limits, RuleAlias
from findrift.functions.exprs import ordinal, producer_identity

SIDE_KEY = ["case_name", "producer_identity", "canonical_rule"]


def _side(findings: DataFrame, side: str) -> DataFrame:
    return findings.where(F.col("side") == side)


def alias_table(spark: SparkSession, aliases: Sequence[RuleAlias]) -> DataFrame:
    """Configured rule aliases with their producers' identities; the first of equal keys counts."""
    rows = [(i, a.baseline_producer, a.baseline_rule, a.candidate_producer, a.candidate_rule) for i, a in enumerate(aliases)]
    table = spark.createDataFrame(rows, "at int, b_producer string, b_rule string, c_producer string, c_rule string")
    named = table.select("*", producer_identity(F.col("b_producer")).alias("b_identity"), producer_identity(F.col("c_producer")).alias("c_identity"))
    w = Window.partitionBy("b_identity", "b_rule", "c_identity", "c_rule").orderBy("at")
    return named.withColumn("first", F.row_number().over(w)).where("first = 1").drop("first")


def _tokens() -> Column:
    return F.explode(F.array_distinct(F.array("canonical_rule", "original_rule")))


def default_pairs(findings: DataFrame) -> DataFrame:
    """Pairs (case_name, b_key, c_key) of one producer and rule, whatever their runs."""
    b = _side(findings, "baseline").select(*SIDE_KEY, F.col("finding_key").alias("b_key"))
    c = _side(findings, "candidate").select(*SIDE_KEY, F.col("finding_key").alias("c_key"))
    return b.join(c, SIDE_KEY).select("case_name", "b_key", "c_key")


def alias_pairs(findings: DataFrame, aliases: Sequence[RuleAlias]) -> DataFrame:
    """Pairs that a configured alias links, by canonical or original rule on either side."""
    # The alias table is configuration, read on the driver and bounded by its input limit.
    table = F.broadcast(alias_table(findings.sparkSession, aliases))
    b = _side(findings, "baseline").select("case_name", F.col("producer_identity").alias("b_identity"), _tokens().alias("b_rule"), F.col("finding_key").alias("b_key"))
    c = _side(findings, "candidate").select("case_name", F.col("producer_identity").alias("c_identity"), _tokens().alias("c_rule"), F.col("finding_key").alias("c_key"))
    return b.join(table, ["b_identity", "b_rule"]).join(c, ["case_name", "c_identity", "c_rule"]).select("case_name", "b_key", "c_key").distinct()


def candidate_pairs(findings: DataFrame, config: Config) -> DataFrame:
    """All coarse pairs: default blocking and aliases, each once."""
    pairs = default_pairs(findings)
    if config.rule_aliases:
        pairs = pairs.unionByName(alias_pairs(findings, config.rule_aliases)).distinct()
    return pairs


def bucket_counts(findings: DataFrame) -> DataFrame:
    """Findings of either side per case, producer and rule."""
    return findings.groupBy(*SIDE_KEY).agg(F.count_if(F.col("side") == "baseline").alias("n_b"), F.count_if(F.col("side") == "candidate").alias("n_c"))


def preflight(findings: DataFrame, limits: Limits, aliases: Sequence[RuleAlias] = ()) -> DataFrame:
    """The refused cases: case_name, code, finding_key (null for the whole comparison's budget).

    The rule takes findings in ordinal order of their keys, and the first violation wins.  Bucket counts settle
    every case within its budgets.  In the others a finding selects too many candidates only where its bucket
    holds too many, and a candidate is selected too often from the finding on that is one too many in its
    bucket; the first such finding is the case's suspect.  The budget of the whole comparison breaks before it
    just where the sizes before it exceed the budget, so sums by bucket tell: no task sees a whole case.
    """
    per, total = limits.maximum_candidate_pair_evaluations_per_finding, limits.maximum_candidate_pair_evaluations
    counts = bucket_counts(findings)
    sums = counts.groupBy("case_name").agg(
        F.max(F.when(F.col("n_b") > 0, F.col("n_c")).otherwise(0)).alias("out"),
        F.max(F.when(F.col("n_c") > 0, F.col("n_b")).otherwise(0)).alias("in"),
        F.sum(F.col("n_b") * F.col("n_c")).alias("pairs"),
    )
    b = _side(findings, "baseline").select(*SIDE_KEY, "original_rule", "finding_key", ordinal(F.col("finding_key")).alias("at"))
    if not aliases:
        # One row per case: the number of cases of one run bounds what is broadcast here and below.
        suspect = sums.where((F.col("out") > per) | (F.col("in") > per) | (F.col("pairs") > total)).select("case_name")
        b = b.join(F.broadcast(suspect), "case_name", "left_semi")
    # The first and the first excessive finding of each bucket; a window's limit applies before the shuffle too.
    ends = b.withColumn("incoming", F.row_number().over(Window.partitionBy(*SIDE_KEY).orderBy("at"))).where(F.col("incoming") <= per + 1).where(F.col("incoming").isin(1, per + 1))
    ends = ends.join(counts.where("n_c > 0").select(*SIDE_KEY, "n_c"), SIDE_KEY)
    if aliases:
        sized = _alias_sizes(findings, b.join(counts.select(*SIDE_KEY, "n_c"), SIDE_KEY, "left").withColumn("size", F.coalesce("n_c", F.lit(0))), aliases)
        over = _alias_sizes(findings, ends.where(F.col("incoming") > per).withColumn("size", F.col("n_c")), aliases).select("case_name", "finding_key", "at", "size", "incoming")
        wide = sized.where(F.col("size") > per).select("case_name", "finding_key", "at", "size", F.lit(0).alias("incoming"))
        ends = over.unionByName(wide)
    else:
        ends = ends.where((F.col("incoming") > per) | (F.col("n_c") > per)).withColumn("size", F.col("n_c"))
    hit = F.struct("finding_key", "at", "size", "incoming")
    # A finding can be the first of two kinds; then the larger count says both.
    first = ends.groupBy("case_name").agg(F.min_by(hit, F.struct("at", (-F.col("incoming")).alias("n"))).alias("hit"))
    before = F.col("hit").isNull() | (F.col("at") < F.col("hit.at"))
    if aliases:
        planned = sized.join(F.broadcast(first), "case_name", "left").where(before).groupBy("case_name").agg(F.sum("size").alias("planned"))
    else:
        early = b.join(F.broadcast(first), "case_name", "left").where(before).groupBy(*SIDE_KEY).agg(F.count("*").alias("n"))
        planned = early.join(counts.where("n_c > 0").select(*SIDE_KEY, "n_c"), SIDE_KEY).groupBy("case_name").agg(F.sum(F.col("n") * F.col("n_c")).alias("planned"))
    size, done = F.col("hit.size"), F.coalesce("planned", F.lit(0))
    bound = F.least(F.lit(per), F.lit(total) - done + 1)
    code = (
        F.when(done > total, "MATCH0008")
        .when(size > bound, F.when(bound < per, "MATCH0008").otherwise("MATCH0007"))
        .when(done + size > total, "MATCH0008")
        .when(F.col("hit.incoming") > per, "MATCH0009")
    )
    found = planned.join(first, "case_name", "full_outer").select("case_name", code.alias("code"), "hit")
    return found.where(F.col("code").isNotNull()).select("case_name", "code", F.when(F.col("code") != "MATCH0008", F.col("hit.finding_key")).alias("finding_key"))


def _alias_sizes(findings: DataFrame, sized: DataFrame, aliases: Sequence[RuleAlias]) -> DataFrame:
    """Adds the work that aliases select, duplicates across buckets included, and incoming counts of distinct pairs."""
    table = F.broadcast(alias_table(findings.sparkSession, aliases))
    targets = (
        _side(findings, "candidate")
        .select("case_name", F.col("producer_identity").alias("c_identity"), _tokens().alias("c_rule"))
        .groupBy("case_name", "c_identity", "c_rule").agg(F.count("*").alias("n_t"))
    )
    extra = (
        sized.select("case_name", "finding_key", F.col("producer_identity").alias("b_identity"), _tokens().alias("b_rule"))
        .join(table, ["b_identity", "b_rule"])
        .select("case_name", "finding_key", "c_identity", "c_rule").distinct()
        .join(targets, ["case_name", "c_identity", "c_rule"])
        .groupBy("case_name", "finding_key").agg(F.sum("n_t").alias("extra"))
    )
    return sized.join(extra, ["case_name", "finding_key"], "left").withColumn("size", F.col("size") + F.coalesce("extra", F.lit(0))).drop("extra")
