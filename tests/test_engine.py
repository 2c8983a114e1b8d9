"""The engine end to end on small labelled cases, and its operators on small tables."""

from __future__ import annotations

import hashlib
import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from findrift.config import Config
from findrift.operators import evaluation
from findrift.plans import adapters, compare, corpus
from findrift.reports import stable
from findrift.sources import generate, repository, sarif


@pytest.fixture(scope="module")
def result(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    generate.write_fixtures(root, 6)
    return corpus.run_corpus(spark, root)


def test_every_labelled_case_passes(result):
    """Moved, reworded, renamed, new, resolved, tied and broken inputs, each as its labels say."""
    assert result.reasons == []
    assert {c.name: c.passed for c in result.cases} == dict.fromkeys(generate.fixture_cases(), True)
    assert result.totals["tp"] == sum(len(c["labels"]["pairs"]) for c in generate.fixture_cases(6).values())
    assert result.totals["fp"] == result.totals["fn"] == result.totals["silent"] == 0
    data = json.loads(corpus.report(result))
    assert data["passed"] and all(c["report"]["sha256"] for c in data["cases"] if not c["invalidInputs"])


def test_wrong_labels_fail(spark, tmp_path):
    generate.write_fixtures(tmp_path, 3)
    for case in sorted((tmp_path / "cases").iterdir()):
        if case.name != "stable":
            for f in case.iterdir():
                f.unlink()
            case.rmdir()
    path = tmp_path / "cases" / "stable" / "labels.json"
    labels = json.loads(path.read_text())
    labels["pairs"][0]["classification"] = "moved"
    path.write_text(json.dumps(labels))
    got = corpus.run_corpus(spark, tmp_path)
    assert not got.passed and got.cases[0].failures == ["decisions differ from the labels"]


def test_every_finding_is_decided_once_and_reports_read_back(spark, sf_dir):
    rows = adapters.order_rows(spark, sf_dir).where("k < 700")
    findings = adapters.to_findings(rows)
    done = compare.compare(findings)
    seen = Counter(k for r in done.decisions.select("b_key", "c_key").collect() for k in r if k)
    assert seen == Counter(r["key"] for r in rows.select("key").collect())
    raw = stable.stable_report(done, adapters.CASE)
    data = stable.read_report(raw)
    summary = done.summary.first().asDict()
    assert data["summary"]["baselineCount"] == summary["baseline_count"] and sum(data["summary"][n] for n in ("new", "moved")) == summary["new"] + summary["moved"]
    assert raw == stable.stable_report(done, adapters.CASE)


@pytest.mark.parametrize(("kind", "edges"), [("unique", 1000), ("pathological", 0)])
def test_generated_cases_have_exact_counts(spark, kind, edges):
    done = compare.compare(generate.benchmark_findings(spark, 1000, kind))
    m = done.metrics.first()
    assert m["candidate_edges"] == edges
    classes = {r["classification"]: r["count"] for r in done.decisions.groupBy("classification").count().collect()}
    if kind == "unique":
        assert (m["components"], m["ambiguous_components"], classes) == (1000, 0, {"unchanged": 1000})
    else:
        assert (m["components"], m["ambiguous_components"], classes) == (1, 1, {"ambiguous": 2000})
        assert {r["code"] for r in done.diagnostics.collect()} & {"MATCH0007", "MATCH0008", "MATCH0009"}


def test_repository_context_comes_from_the_named_files(spark, tmp_path):
    source = "class A {\n  void f() {\n    one();\n    two();\n  }\n}\n"
    (tmp_path / "repo" / "src").mkdir(parents=True)
    (tmp_path / "repo" / "src" / "a0.cs").write_text(source)
    results = [generate._result(i, "R", f"src/a{i}.cs", 3 if i == 0 else 99, "m", None, "kept();") for i in range(2)]
    results.append(generate._result(2, "R", "src/a0.cs", 99, "m"))
    log = tmp_path / "log.sarif"
    log.write_text(json.dumps(generate._log(results)))
    read = sarif.ingest(spark, [("c", "baseline", str(log))])
    own = repository.Root(str(tmp_path / "repo"))
    placed, notes = repository.with_repository(read.findings, {"baseline": own}, Config(snippet_lines_radius=1, enable_token_windows=True))
    by = {r["result_index"]: r for r in placed.collect()}
    shown = "\n".join(source.split("\n")[1:4])
    from findrift.functions import context

    assert by[0]["context"]["snippet_hash"] == context.vhash("source-context/v1", shown) and by[0]["context"]["token_window_hash"]
    assert (by[0]["context"]["start_line"], by[0]["context"]["end_line"]) == (2, 4)
    assert by[1]["context"]["snippet_hash"] == context.vhash("source-context/v1", "kept();")
    assert {(r["result_index"], r["code"]) for r in notes.collect()} == {(1, "IO0001"), (2, "CANON0010")}
    trusted = repository.Root(str(tmp_path / "repo"), {"src/a0.cs": hashlib.sha256(source.encode()).hexdigest()})
    placed, notes = repository.with_repository(read.findings, {"baseline": trusted}, Config())
    by = {r["result_index"]: r for r in placed.collect()}
    assert by[0]["context"]["snippet_hash"] is None and "trusted-filename-lexical-context/v1" in [d["algorithm"] for d in by[0]["derived_fps"]]
    assert {(r["result_index"], r["code"]) for r in notes.collect()} == {(1, "SECURITY0008"), (2, "CANON0010")}


def test_false_matches_take_the_first_free_pair(spark):
    labels = spark.createDataFrame([("c", 0, "b1", "c1"), ("c", 1, "b1", "c2"), ("c", 2, "b3", "c3")], evaluation.PLACES)
    wrong = spark.createDataFrame([("c", "b1", "c9"), ("c", "b0", "c1"), ("c", "b8", "c8")], "case_name string, b_key string, c_key string")
    got = {(r["b_key"], r["c_key"]): r["at"] for r in evaluation.false_match_places(labels, wrong).collect()}
    assert got == {("b0", "c1"): 0, ("b1", "c9"): 1, ("b8", "c8"): None}


def test_release_reasons():
    good = {"precision": "0.96", "recall": "0.91"}
    facts = dict.fromkeys(("ambiguity", "ingestion", "structure", "labels", "determinism", "explained", "completed"), True)
    assert evaluation.release_reasons(good, [good], facts) == []
    assert evaluation.release_reasons(good | {"recall": "0.5"}, [good], facts | {"labels": False}) == ["recall-below-threshold", "complete-label-graph-failed"]
    assert len(evaluation.release_reasons({"precision": 0, "recall": 0}, [{"precision": 0, "recall": 0}], {})) == 11


def test_tree_manifest(spark):
    files = [("b", b"2"), ("a", b"1")]
    got = repository.tree_manifest(spark.createDataFrame(files, "path string, content binary")).first()
    want = "".join(f"{hashlib.sha256(c).hexdigest()}  {p}\n" for p, c in sorted(files))
    assert (got["n_files"], got["tree_sha256"]) == (2, hashlib.sha256(want.encode()).hexdigest())


def test_report_ranks_are_global(spark):
    from findrift.operators import decisions

    rows = [("new" if i % 3 else "moved", None if i % 3 else f"b{i}", f"c{i}") for i in range(500)]
    df = spark.createDataFrame(rows, "classification string, b_key string, c_key string")
    got = [(r["classification"], r["b_key"], r["c_key"]) for r in decisions.report_ranks(df).orderBy("rank").collect()]
    assert got == sorted(rows, key=lambda r: (r[0], r[1] or "", r[2]))
    assert [r["rank"] for r in decisions.report_ranks(df).orderBy("rank").select("rank").collect()] == list(range(1, 501))
    assert decisions.report_ranks(df.where(F.lit(False))).count() == 0
