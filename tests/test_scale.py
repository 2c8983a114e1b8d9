"""What must not grow faster than its input: steps against their plain forms, and what their plans hold."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from findrift import queries
from findrift.config import Config, Limits
from findrift.operators import assignment, blocking, occurrence, scoring
from findrift.plans import adapters, compare
from findrift.schema import VECTOR_TYPE


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def many_orders(spark, path, n: int, customers: int):
    rows = spark.range(n).select(F.col("id").alias("o_orderkey"), (F.col("id") % customers).alias("o_custkey"), F.lit("O").alias("o_orderstatus"))
    rows.write.parquet(str(path / "orders.parquet"))
    return str(path)


def test_tables_are_compared_whole_whatever_the_number_of_pairs(spark, tmp_path):
    """1,100 findings of one rule make 1.2 million pairs, which the budgets of untrusted logs refuse."""
    got = {r["classification"]: r["n"] for r in queries.classify_exact(spark, many_orders(spark, tmp_path, 1100, 1)).collect()}
    want = {"moved": 0, "modified": 0, "unchanged": 0}
    for k in range(1100):
        if k % 17 and k % 13 and k % 11:
            want["modified" if k % 7 == 0 else "moved" if k % 5 == 0 or k % 23 == 0 else "unchanged"] += 1
    assert got == want


@pytest.mark.parametrize("limits", [Limits(), Limits(maximum_candidate_pair_evaluations=10)])
def test_outcomes_are_the_decisions_without_their_explanations(spark, sf_dir, limits):
    findings = adapters.to_findings(adapters.order_rows(spark, sf_dir).where("k < 400"))
    columns = ["classification", "b_key", "c_key", "tier", "ambiguous"]
    whole = compare.compare(findings, Config(limits=limits)).decisions.select(columns).collect()
    lean, _ = compare.classify(findings, Config(limits=limits))
    assert sorted(map(str, lean.select(columns).collect())) == sorted(map(str, whole))


def ordered_rule(rows, per: int, total: int):
    """The preflight's rule as it is told: one finding after another."""
    into: dict = {}
    planned = 0
    for key, rule in sorted((k, r) for side, k, r in rows if side == "baseline"):
        size = sum(s == "candidate" and r == rule for s, _, r in rows)
        bound = min(per, total - planned + 1)
        if size:
            into[rule] = into.get(rule, 0) + 1
        if size > bound:
            return ("MATCH0008", None) if bound < per else ("MATCH0007", key)
        if planned + size > total:
            return ("MATCH0008", None)
        if into.get(rule, 0) > per:
            return ("MATCH0009", key)
        planned += size
    return None


def test_preflight_is_the_ordered_rule_and_no_task_sees_a_case(spark):
    rng = random.Random(5)
    cases = {}
    for i in range(60):
        n, rules = rng.randrange(1, 14), rng.randrange(1, 4)
        cases[f"case{i:02}"] = [(rng.choice(["baseline", "candidate"]), f"k{j:02}", f"r{rng.randrange(rules)}") for j in rng.sample(range(40), n)]
    table = [(c, s, "p", r, r, k) for c, rows in cases.items() for s, k, r in rows]
    df = spark.createDataFrame(table, "case_name string, side string, producer_identity string, canonical_rule string, original_rule string, finding_key string")
    seen = set()
    for per, total in ((2, 7), (3, 6), (4, 30)):
        made = blocking.preflight(df, Limits(maximum_candidate_pair_evaluations_per_finding=per, maximum_candidate_pair_evaluations=total))
        got = {r["case_name"]: (r["code"], r["finding_key"]) for r in made.collect()}
        want = {c: w for c, rows in cases.items() if (w := ordered_rule(rows, per, total))}
        assert got == want
        seen |= {code for code, _ in want.values()}
        assert not any("case_name" in line and "producer_identity" not in line for line in plan(made).splitlines() if line.lstrip(" :+-").startswith("Window "))
    assert seen == {"MATCH0007", "MATCH0008", "MATCH0009"}


@pytest.mark.parametrize("weak", [False, True])
def test_only_pairs_with_evidence_in_common_are_scored(spark, sf_dir, weak):
    config = Config(allow_weak_message_similarity=weak)
    full = occurrence.with_occurrences(adapters.to_findings(adapters.order_rows(spark, sf_dir).where("k < 900")))
    none = spark.createDataFrame([], "case_name string, code string, finding_key string")
    edges = compare.scored_edges(full, none, config)
    f = full.select("case_name", "canonical_rule", "side", "finding_key", F.struct("*").alias("f"))
    b = f.where("side = 'baseline'").select("case_name", "canonical_rule", F.col("finding_key").alias("b_key"), F.col("f").alias("b"))
    c = f.where("side = 'candidate'").select("case_name", "canonical_rule", F.col("finding_key").alias("c_key"), F.col("f").alias("c"))
    no_alias = F.array().cast("array<struct<b_producer:string,b_rule:string,c_producer:string,c_rule:string>>")
    every = scoring.score(b.join(c, ["case_name", "canonical_rule"]).withColumn("aliases", no_alias), config)
    rows = [sorted(map(str, e.select("b_key", "c_key", "vector").collect())) for e in (edges, every)]
    assert rows[0] == rows[1] and len(rows[0]) > 100


def test_repeats_are_counted_by_digest_once(spark):
    full = occurrence.with_occurrences(adapters.to_findings(adapters.order_rows(spark, "/root/testdata/sf0.001")))
    counts = {(r["side"], r["canonical_rule"], r["kind"], r["value"]): r["n"] for r in occurrence.evidence_counts(full).collect()}
    got = {(r["side"], r["canonical_rule"], x["kind"], x["value"]): x["n"] for r in full.select("side", "canonical_rule", "repeats").collect() for x in r["repeats"]}
    assert got and got == {k: n for k, n in counts.items() if n > 1}
    assert {(x["value"], x["n"] > 1) for r in full.select("fp_repeats").collect() for x in r["fp_repeats"]} == {("shared", True)}


def test_hashes_and_messages_are_made_once_a_row(spark, sf_dir):
    """Three kinds of rows, two hashes each."""
    assert plan(queries.ctx_occurrence(spark, sf_dir)).count("sha2(") <= 6
    assert plan(queries.message_canonical(spark, sf_dir)).count("regexp_replace(") <= 1


def test_edges_are_made_once_for_an_assignment(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def block(i):
        made.add(1)
        return f"r{i // 10}"

    i = F.col("id")
    vector = F.from_json(F.lit('{"tier":5,"fp_strength":2,"path_match":0,"context_agreement":0,"codeflow_agreement":0,"message_agreement":0,"region_band":0}'), VECTOR_TYPE)
    edges = spark.range(40).select(F.lit("c").alias("case_name"), block(i).alias("block"), F.concat(F.lit("b"), i - i % 2).alias("b_key"), F.concat(F.lit("c"), i).alias("c_key"), vector.alias("vector"))
    states = assignment.assign(edges, Limits()).collect()
    assert sum(r["state"] == "kept" for r in states) == 40 and made.value == 40
    sizes = {(r["size"], r["n_components"]) for r in assignment.component_sizes(edges).collect()}
    assert sizes == {(3, 20)} and made.value == 80


def test_degrees_need_no_second_copy_of_the_edges(spark):
    edges = spark.createDataFrame([("c", "b1", "c1"), ("c", "b1", "c2"), ("c", "b2", "c2")], "case_name string, b_key string, c_key string")
    known = assignment.with_degrees(edges)
    assert sorted((r["b_key"], r["c_key"], r["deg_b"], r["deg_c"]) for r in known.collect()) == [("b1", "c1", 2, 1), ("b1", "c2", 2, 2), ("b2", "c2", 1, 2)]
    assert "Join" not in plan(known)
