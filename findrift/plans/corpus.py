"""Labelled cases as one run: read, compare, score, gate and report."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findrift.checkpoints import checkpoint
from findrift.config import Config, Limits, read_config_file
from findrift.operators import compatibility, evaluation
from findrift.plans import compare
from findrift.reports import stable
from findrift.sources import labels as label_files
from findrift.sources import sarif

PAIRS = "case_name string, b_key string, c_key string, classification string"
EXPECTED = "case_name string, kind string, key string"
EXPLAINED = "case_name string, b_key string, c_key string, classification string, tier int, ambiguous boolean, kinds array<string>"


@dataclass
class CaseResult:
    name: str
    expected_invalid: tuple[str, ...]
    invalid: tuple[str, ...]
    metrics: dict
    artifact: dict
    failures: list[str] = field(default_factory=list)

    @property
    def passed(self) -> bool:
        return not self.failures


@dataclass
class CorpusResult:
    cases: list[CaseResult]
    totals: dict
    reasons: list[str]
    thresholds: evaluation.Thresholds

    @property
    def passed(self) -> bool:
        return not self.reasons


def case_folders(root: str | Path, limits: Limits = Limits()) -> list[Path]:  # noqa: B008
    """The case folders below ``root``/cases in ordinal order; links and more cases than runs are allowed are refused."""
    top = Path(root) / "cases"
    if not top.is_dir():
        raise ValueError("the corpus has no folder of cases")
    found = [p for p in top.iterdir() if p.is_dir()]
    if any(p.is_symlink() for p in found):
        raise ValueError("a case is a link")
    if not 0 < len(found) <= limits.maximum_runs:
        raise ValueError(f"a corpus has 1 to {limits.maximum_runs} cases")
    return sorted(found, key=lambda p: p.name.encode("utf-16-be", "surrogatepass"))


def _regular(path: Path) -> Path:
    if path.is_symlink() or not path.is_file():
        raise ValueError(f"{path.parent.name}/{path.name} must be a regular file")
    return path


def run_corpus(spark: SparkSession, root: str | Path, thresholds: evaluation.Thresholds = evaluation.Thresholds(), limits: Limits = Limits(), messages: bool = True) -> CorpusResult:  # noqa: B008
    """Runs all cases: those of one configuration are one job, keyed by case_name.

    ``messages`` false leaves the wording of expected diagnostics out of the comparison.
    """
    folders = case_folders(root, limits)
    known = {p.name: label_files.read_labels_file(_regular(p / "labels.json"), limits) for p in folders}
    groups: dict[Config, list[Path]] = {}
    noted: dict[str, list] = {}
    for p in folders:
        config, notes = read_config_file(str(p / "config.json") if (p / "config.json").exists() else None, limits)
        noted[p.name] = notes
        groups.setdefault(_hashable(config or Config(limits=limits)), []).append(p)
    metrics, decisions, documents, notes, covered, artifacts = [], [], [], [], [], {}
    for config, own in groups.items():
        logs = [(p.name, side, str(_regular(p / f"{side}.sarif"))) for p in own for side in ("baseline", "candidate")]
        read = sarif.ingest(spark, logs, config)
        docs = {(r["case_name"], r["side"]): r["valid"] for r in read.documents.collect()}  # two rows a case
        documents += [(c, s) for (c, s), ok in docs.items() if not ok]
        good = [p.name for p in own if docs.get((p.name, "baseline")) and docs.get((p.name, "candidate"))]
        valid = checkpoint(read.findings.where(F.col("case_name").isin(good)))
        done = compare.compare(valid, config)
        made = done.decisions
        pairs, expected, _ = label_tables(spark, {n: known[n] for n in good})
        metrics.append(evaluation.corpus_metrics(made, pairs, expected))
        decisions.append(made)
        checks = compatibility.compatibility(read.documents, sarif.run_summaries(read.runs, read.results), sarif.ignored_properties(read.runs, read.results))
        notes.append(read.diagnostics.unionByName(done.diagnostics).unionByName(compatibility.diagnostics(checks)))
        covered.append(evaluation.label_coverage(valid, pairs, expected))
        artifacts |= stable.measure_reports(done, good, read.diagnostics)
    return _judged(spark, folders, known, noted, _all(metrics), _all(decisions), documents, _all(notes), _all(covered), artifacts, thresholds, messages)


def _hashable(config: Config) -> Config:
    """The configuration with its URI bases in a form that compares by value."""
    return replace(config, uri_bases=tuple(_Base(b) for b in config.uri_bases))


class _Base(dict):
    def __hash__(self) -> int:
        return hash(tuple(sorted((k, str(v)) for k, v in self.items())))


def _all(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def label_tables(spark: SparkSession, known: dict[str, label_files.Labels]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Labels as tables: pairs, expected keys, expected explanations."""
    pairs = [(n, *p) for n, x in known.items() for p in x.pairs]
    expected = [(n, *e) for n, x in known.items() for e in x.expected]
    told = [(n, *[e[k] for k in ("b_key", "c_key", "classification", "tier", "ambiguous", "kinds")]) for n, x in known.items() for e in x.explanations or []]
    return spark.createDataFrame(pairs, PAIRS), spark.createDataFrame(expected, EXPECTED), spark.createDataFrame(told, EXPLAINED)


def _judged(spark, folders, known, noted, metrics, decisions, documents, notes, covered, artifacts, thresholds, messages) -> CorpusResult:
    rows = {r["case_name"]: r.asDict() for r in metrics.collect()}  # one row a case
    gaps: dict[str, int] = {}
    for r in covered.groupBy("case_name").count().collect():
        gaps[r["case_name"]] = r["count"]
    _, _, told = label_tables(spark, known)
    wrong = {r["case_name"]: r["count"] for r in evaluation.explanation_failures(decisions, told).groupBy("case_name").count().collect()}
    asserting = [n for n, x in known.items() if x.diagnostics is not None]
    seen: dict[str, set] = {}
    for r in notes.where(F.col("case_name").isin(asserting)).collect():  # cases that list all their diagnostics, so few
        seen.setdefault(r["case_name"], set()).add((r["code"], r["severity"], r["stage"], r["input"], r["run_index"], r["result_index"], r["json_pointer"], r["message"] if messages else None))
    invalid: dict[str, list[str]] = {}
    for case, side in documents:
        invalid.setdefault(case, []).append(side)
    empty = evaluation.corpus_metrics(decisions.limit(0), *label_tables(spark, {})[:2]).columns
    cases = []
    for p in folders:
        name, want = p.name, known[p.name]
        own = tuple(sorted(invalid.get(name, [])))
        m = rows.get(name) or {c: 0 for c in empty if c != "case_name"} | {"case_name": name, "precision": 1, "recall": 1, "f1": 1}
        failures = []
        if own != want.invalid:
            failures.append("invalid inputs differ from the labels")
        if own and (want.pairs or want.expected):
            failures.append("a case with an invalid input has labelled findings")
        if gaps.get(name) and not own:
            failures.append("the labels do not cover every finding once")
        if any(m[c] for c in ("fp", "fn", "class_mismatches", *[f"{k}_{s}" for k in ("missing", "unexpected") for s in evaluation.SETS])):
            failures.append("decisions differ from the labels")
        if wrong.get(name):
            failures.append("explanations differ from the labels")
        if want.diagnostics is not None:
            expected = {(d["code"], d["severity"], d["stage"], d.get("input"), d.get("runIndex"), d.get("resultIndex"), d.get("jsonPointer"), d["message"] if messages else None) for d in want.diagnostics}
            stated = {(n.code, n.severity, n.stage, "configuration", None, None, n.pointer, n.message if messages else None) for n in noted[name]} if noted[name] else set()
            if expected != seen.get(name, set()) | stated:
                failures.append("diagnostics differ from the labels")
        cases.append(CaseResult(name, want.invalid, own, m, artifacts.get(name) or {"bytes": 0, "sha256": None}, failures))
    total = evaluation.aggregate_metrics(metrics).first().asDict()
    reasons = sorted({r["reason"] for r in evaluation.quality_gate(metrics, thresholds).collect()} | {f"case {c.name}: {f}" for c in cases for f in c.failures})
    return CorpusResult(cases, total, reasons, thresholds)


def report(result: CorpusResult) -> bytes:
    """The corpus report: thresholds, totals, and each case with its scores, failures and report digest."""
    shown = lambda m: {k: (str(v) if k in ("precision", "recall", "f1") else v) for k, v in m.items() if k != "case_name"}
    return stable.dumps(
        {
            "corpusReportVersion": "1", "tool": {"name": stable.NAME, "version": stable.VERSION},
            "thresholds": {"precision": result.thresholds.precision, "recall": result.thresholds.recall, "silent": result.thresholds.silent},
            "passed": result.passed, "reasons": result.reasons, "totals": shown(result.totals),
            "cases": [
                {"name": c.name, "passed": c.passed, "failures": c.failures, "expectedInvalidInputs": list(c.expected_invalid), "invalidInputs": list(c.invalid), "metrics": shown(c.metrics), "report": c.artifact}
                for c in result.cases
            ],
        }
    )
