"""The comparison: findings of two sides to decisions, diagnostics and counts, for any number of cases."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findrift.checkpoints import checkpoint
from findrift.config import Config
from findrift.operators import assignment, blocking, decisions, occurrence, scoring
from findrift.schema import DIAGNOSTIC


#: A report counts no more edges than an int holds.
MOST_EDGES = 2147483647


@dataclass
class Comparison:
    """The tables of a comparison; all are keyed by case_name."""

    findings: DataFrame
    refused: DataFrame
    edges: DataFrame
    states: DataFrame
    decisions: DataFrame
    diagnostics: DataFrame
    metrics: DataFrame
    summary: DataFrame


def scored_edges(findings: DataFrame, refused: DataFrame, config: Config) -> DataFrame:
    """Admissible edges of all cases that passed the preflight: keys, block, both findings, vector and hits.

    ``findings`` carry their repeats.
    """
    # One row per refused case: the number of cases of one run bounds it.
    open_ = findings.join(F.broadcast(refused.select("case_name")), "case_name", "left_anti")
    marks = scoring.marks(config.allow_weak_message_similarity).alias("marks")
    packed = open_.select("case_name", "side", "finding_key", "producer_identity", "canonical_rule", marks, F.struct("*").alias("f"))
    b = packed.where("side = 'baseline'").select("case_name", "producer_identity", "canonical_rule", F.col("finding_key").alias("b_key"), F.col("marks").alias("b_marks"), F.col("f").alias("b"))
    c = packed.where("side = 'candidate'").select("case_name", "producer_identity", "canonical_rule", F.col("finding_key").alias("c_key"), F.col("marks").alias("c_marks"), F.col("f").alias("c"))
    no_alias = F.array().cast("array<struct<b_producer:string,b_rule:string,c_producer:string,c_rule:string>>")
    alike = F.arrays_overlap("b_marks", "c_marks")
    pairs = b.join(c, blocking.SIDE_KEY).where(alike).select("case_name", "b_key", "c_key", "b", "c", no_alias.alias("aliases"))
    if config.rule_aliases:
        linked = _aliased(open_, config)
        own = b.select("case_name", "b_key", "b").join(linked, ["case_name", "b_key"]).join(c.select("case_name", "c_key", "c"), ["case_name", "c_key"])
        same = (F.col("b.producer_identity") == F.col("c.producer_identity")) & (F.col("b.canonical_rule") == F.col("c.canonical_rule"))
        pairs = pairs.unionByName(own.where(~same).select("case_name", "b_key", "c_key", "b", "c", "aliases"))
    rule = lambda s: F.concat_ws("\0", F.col(f"{s}.producer_identity"), F.col(f"{s}.canonical_rule"))
    edges = scoring.score(pairs, config).withColumn("block", rule("b"))
    return _super_blocks(edges, rule("c")) if config.rule_aliases else edges


def _aliased(findings: DataFrame, config: Config) -> DataFrame:
    """Pairs with the aliases that link them."""
    table = F.broadcast(blocking.alias_table(findings.sparkSession, config.rule_aliases))  # configuration: bounded
    tokens = F.explode(F.array_distinct(F.array("canonical_rule", "original_rule")))
    b = findings.where("side = 'baseline'").select("case_name", F.col("producer_identity").alias("b_identity"), tokens.alias("b_rule"), F.col("finding_key").alias("b_key"))
    c = findings.where("side = 'candidate'").select("case_name", F.col("producer_identity").alias("c_identity"), tokens.alias("c_rule"), F.col("finding_key").alias("c_key"))
    hit = F.struct("b_producer", "b_rule", "c_producer", "c_rule")
    joined = b.join(table, ["b_identity", "b_rule"]).join(c, ["case_name", "c_identity", "c_rule"])
    return joined.groupBy("case_name", "b_key", "c_key").agg(F.array_sort(F.collect_set(hit)).alias("aliases"))


def _super_blocks(edges: DataFrame, c_rule) -> DataFrame:
    """Blocks joined wherever an edge links two of them, so that no edge leaves its block.

    Only pairs of different blocks come to the driver: configured aliases bound those.
    """
    crossing = edges.select("case_name", F.col("block").alias("x"), c_rule.alias("y")).where("x <> y").distinct()
    sets = assignment.Sets()
    for r in crossing.collect():
        sets.union((r["case_name"], r["x"]), (r["case_name"], r["y"]))
    rows = [(case, block, sets.find((case, block))[1]) for case, block in list(sets.up)]
    if not rows:
        return edges
    names = F.broadcast(edges.sparkSession.createDataFrame(rows, "case_name string, block string, whole string"))
    return edges.join(names, ["case_name", "block"], "left").withColumn("block", F.coalesce("whole", "block")).drop("whole")


def compare(findings: DataFrame, config: Config = Config(), assess: bool = True) -> Comparison:  # noqa: B008
    """Compares the baseline and candidate findings of every case.

    ``assess`` sets fingerprint reliability first; findings from the log reader need it, findings that
    carry their own do not.
    """
    known = occurrence.fp_reliability(findings) if assess else findings
    refused = checkpoint(blocking.preflight(findings, config.limits, config.rule_aliases))
    full = checkpoint(occurrence.with_occurrences(known, config.fold_paths))
    edges = checkpoint(scored_edges(full, refused, config))
    states = checkpoint(assignment.assign(edges, config.limits))
    made = checkpoint(decisions.decide(full, edges, states, refused, config))
    return Comparison(full, refused, edges, states, made, diagnostics(full, refused, states, edges), metrics(findings, refused, edges, states), decisions.summary(findings, made))


def classify(findings: DataFrame, config: Config = Config(), assess: bool = True) -> tuple[DataFrame, DataFrame]:  # noqa: B008
    """The decisions of ``compare`` without their explanations (see ``decisions.outcomes``), and the states.

    Only keys, vectors and classes are kept between the steps, so that large tables need no room for evidence.
    """
    known = occurrence.fp_reliability(findings) if assess else findings
    refused = checkpoint(blocking.preflight(findings, config.limits, config.rule_aliases))
    full = occurrence.with_occurrences(known, config.fold_paths)
    edges = checkpoint(decisions.classified(scored_edges(full, refused, config), config))
    states = checkpoint(assignment.assign(edges, config.limits))
    return decisions.outcomes(findings, edges, states, refused), states


def diagnostics(findings: DataFrame, refused: DataFrame, states: DataFrame, edges: DataFrame) -> DataFrame:
    """The matcher's diagnostics: case_name and the diagnostic's fields."""
    messages = F.create_map(*[x for k, v in decisions.HELP.items() for x in (F.lit(k), F.lit(v))])
    none = F.lit(None).cast("string")

    def rows(df: DataFrame, code, subject) -> DataFrame:
        made = F.struct(
            code.alias("code"), F.lit("warning").alias("severity"), F.lit("match").alias("stage"),
            F.concat_ws(" ", F.try_element_at(messages, code), F.concat(F.lit("["), subject, F.lit("]"))).alias("message"),
            none.alias("input"), F.lit(None).cast("int").alias("run_index"), F.lit(None).cast("int").alias("result_index"),
            none.alias("json_pointer"), none.alias("help"),
        )
        return df.select("case_name", made.cast(DIAGNOSTIC).alias("d")).select("case_name", "d.*")

    label = F.concat(F.col("family"), F.coalesce(F.concat(F.lit("/v"), F.col("version").cast("string")), F.lit("")))
    shared = rows(occurrence.fp_collisions(findings), F.lit("MATCH0005"), F.concat_ws(" ", "side", label))
    refusal = rows(refused, F.col("code"), F.coalesce("finding_key", F.lit("all")))
    ties = rows(states.where("state = 'ambiguous' and code in ('MATCH0001', 'MATCH0002')").select("case_name", "code", "component").distinct(), F.col("code"), F.col("component"))
    saturated = edges.groupBy("case_name").agg(F.count("*").alias("n")).where(F.col("n") > MOST_EDGES)
    over = rows(states.where("state = 'overflow'"), F.col("code"), F.coalesce("b_key", "c_key"))
    return shared.unionByName(refusal).unionByName(ties).unionByName(over).unionByName(rows(saturated, F.lit("MATCH0006"), F.col("n").cast("string")))


def metrics(findings: DataFrame, refused: DataFrame, edges: DataFrame, states: DataFrame) -> DataFrame:
    """Per case: candidate edges (saturating at an int), components, ambiguous components."""
    n_edges = edges.groupBy("case_name").agg(F.least(F.count("*"), F.lit(MOST_EDGES)).alias("candidate_edges"))
    sizes = assignment.component_sizes(edges).groupBy("case_name").agg(F.sum("n_components").alias("components"))
    lost = states.where("state = 'ambiguous'").groupBy("case_name").agg(F.count_distinct("component").alias("ambiguous_components"))
    off = refused.select("case_name", F.lit(1).alias("one"))
    every = findings.select("case_name").distinct()
    joined = every.join(n_edges, "case_name", "left").join(sizes, "case_name", "left").join(lost, "case_name", "left").join(off, "case_name", "left")
    return joined.select(
        "case_name",
        F.coalesce("candidate_edges", F.lit(0)).cast("long").alias("candidate_edges"),
        F.coalesce("one", "components", F.lit(0)).cast("long").alias("components"),
        F.coalesce("one", "ambiguous_components", F.lit(0)).cast("long").alias("ambiguous_components"),
    )
