"""The stable report: fixed member order, ordinal arrays, no times, a final line feed; byte-equal for equal input."""

from __future__ import annotations

import hashlib
import io
import json
import os
import tempfile
from collections.abc import Iterable, Iterator
from itertools import groupby
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findrift.functions.exprs import ordinal
from findrift.operators.decisions import report_order
from findrift.operators.scoring import MATCHER
from findrift.schema import AGREEMENT, PATH_MATCH, STAGES, TIERS

NAME, VERSION, OUTPUT = "findrift", "1.0.0", "1"


def dumps(value) -> bytes:
    return json.dumps(value, ensure_ascii=False, indent=2, separators=(",", ": ")).encode("utf-8", "surrogatepass") + b"\n"


class Measured:
    """A binary sink that counts and hashes what goes through it; without a file it only measures."""

    def __init__(self, out=None) -> None:
        self.out, self.size, self.hash = out, 0, hashlib.sha256()

    def write(self, raw: bytes) -> None:
        self.size += len(raw)
        self.hash.update(raw)
        if self.out:
            self.out.write(raw)

    def result(self) -> dict:
        return {"bytes": self.size, "sha256": self.hash.hexdigest()}


class Items:
    """A list of a report that is written item by item and never held."""

    def __init__(self, rows: Iterable) -> None:
        self.rows = rows


def stream(value, out, depth: int = 0) -> None:
    """Writes ``value`` as ``dumps`` would, its ``Items`` one after the other."""
    pad = "  " * (depth + 1)

    def flat(x) -> bytes:
        return json.dumps(x, ensure_ascii=False, indent=2, separators=(",", ": ")).replace("\n", "\n" + pad).encode("utf-8", "surrogatepass")

    def held(x) -> bool:
        return isinstance(x, Items) or (isinstance(x, dict) and any(held(v) for v in x.values())) or (isinstance(x, list) and any(held(v) for v in x))

    if isinstance(value, dict):
        first, opened, closed = True, b"{", b"}"
        parts = ((json.dumps(k, ensure_ascii=False).encode() + b": ", v) for k, v in value.items())
    else:
        first, opened, closed = True, b"[", b"]"
        parts = ((b"", v) for v in (value.rows if isinstance(value, Items) else value))
    out.write(opened)
    for name, v in parts:
        out.write((b"" if first else b",") + b"\n" + pad.encode() + name)
        first = False
        stream(v, out, depth + 1) if held(v) else out.write(flat(v))
    out.write((b"" if first else b"\n" + b"  " * depth) + closed)
    if depth == 0:
        out.write(b"\n")


def region_json(r) -> dict | None:
    return None if r is None else {"startLine": r["start_line"], "startColumn": r["start_column"], "endLine": r["end_line"], "endColumn": r["end_column"]}


def diagnostics_order() -> list:
    """Stage, code, input, run, result, pointer, message, severity, help; nulls first."""
    stage = F.create_map(*[x for i, s in enumerate(STAGES) for x in (F.lit(s), F.lit(i))])
    severity = F.create_map(F.lit("note"), F.lit(0), F.lit("warning"), F.lit(1), F.lit("error"), F.lit(2))
    return [
        F.try_element_at(stage, F.col("stage")).asc_nulls_first(), ordinal(F.col("code")), F.col("input").asc_nulls_first(), F.col("run_index").asc_nulls_first(),
        F.col("result_index").asc_nulls_first(), ordinal(F.col("json_pointer")).asc_nulls_first(), ordinal(F.col("message")), F.try_element_at(severity, F.col("severity")),
        ordinal(F.col("help")).asc_nulls_first(),
    ]


def _diagnostic(d) -> dict:
    return {
        "code": d["code"], "severity": d["severity"], "stage": d["stage"], "message": d["message"], "input": d["input"], "runIndex": d["run_index"],
        "resultIndex": d["result_index"], "jsonPointer": d["json_pointer"], "help": d["help"],
    }


def diagnostics_json(diagnostics: DataFrame) -> Iterator[dict]:
    """Diagnostics in order, for a report's own lists; a report names each once."""
    return (_diagnostic(d) for d in diagnostics.orderBy(*diagnostics_order()).toLocalIterator())


def _reference(f, key: str) -> dict | None:
    if f is None:
        return None
    return {"input": f["side"], "runIndex": f["run_index"], "resultIndex": f["result_index"], "jsonPointer": f["json_pointer"]}


def _snapshot(f) -> dict | None:
    if f is None:
        return None
    return {
        "findingKey": f["finding_key"], "producerFamily": f["producer_family"], "producerToolName": f["tool_name"], "producerToolVersion": f["tool_version"],
        "automaticProducerIdentity": f["producer_identity"], "canonicalRule": f["canonical_rule"], "canonicalUri": f["path"]["canonical_uri"] if f["path"] else None,
        "region": region_json(f["region"]), "canonicalMessage": f["message"]["canonical"],
        "sourceMetadata": {"level": f["level"], "kind": f["kind"], "baselineState": f["baseline_state"]},
        "messageNormalisationFlags": list(f["message"]["flags"]), "lossiness": list(f["lossiness"]),
        "derivedFingerprints": [{"name": d["name"], "value": d["value"], "algorithmVersion": d["algorithm"]} for d in f["derived_fps"]],
    }


def _vector(v) -> dict:
    return {
        "precedenceTier": TIERS[v["tier"]], "producerFingerprintStrength": v["fp_strength"], "pathMatchKind": PATH_MATCH[v["path_match"]],
        "contextAgreement": AGREEMENT[v["context_agreement"]], "codeFlowAgreement": AGREEMENT[v["codeflow_agreement"]],
        "messageAgreement": AGREEMENT[v["message_agreement"]], "regionDriftBand": v["region_band"],
    }


def _finding(r) -> dict:
    b, c = r["b"], r["c"]
    rejected = sorted(r["rejected"], key=lambda x: (x["key"].encode("utf-16-be", "surrogatepass"), x["reason"], x["tier"], tuple(x["vector"])))
    return {
        "classification": r["classification"], "baselineRef": _reference(b, "b"), "candidateRef": _reference(c, "c"), "baseline": _snapshot(b), "candidate": _snapshot(c),
        "decision": {"precedenceTier": TIERS[r["tier"]], "displayConfidence": r["confidence"], "ambiguous": r["ambiguous"], "matcherAlgorithmVersion": MATCHER},
        "evidence": [
            {"kind": e["kind"], "baselineValue": e["baseline"], "candidateValue": e["candidate"], "origin": e["origin"], "precedenceTier": TIERS[e["tier"]],
             "lossy": e["lossy"], "algorithmVersion": e["algorithm"]} for e in r["evidence"]
        ],
        "rejectedAlternatives": [{"findingKey": x["key"], "reason": x["reason"], "precedenceTier": TIERS[x["tier"]], "decisionVector": _vector(x["vector"])} for x in rejected],
        "transforms": [{"kind": t["kind"], "originalValue": t["original"], "transformedValue": t["transformed"], "lossy": t["lossy"], "algorithmVersion": t["algorithm"]} for t in r["transforms"]],
        "diagnostics": [{"code": d["code"], "severity": d["severity"], "message": d["message"]} for d in r["diagnostics"]],
    }


def report_rows(findings: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions with both findings, by case and in report order."""
    side = lambda s, k, n: findings.where(F.col("side") == s).select("case_name", F.col("finding_key").alias(k), F.struct("*").alias(n))
    joined = decisions.join(side("baseline", "b_key", "b"), ["case_name", "b_key"], "left").join(side("candidate", "c_key", "c"), ["case_name", "c_key"], "left")
    return joined.orderBy("case_name", *report_order())


class _ByCase:
    """Rows sorted by case, handed out case by case; a case without rows has none."""

    def __init__(self, rows: Iterator) -> None:
        self.groups = groupby(rows, key=lambda r: r["case_name"])
        self.next = next(self.groups, None)

    def of(self, case: str) -> Iterator:
        while self.next and self.next[0] < case:
            self.next = next(self.groups, None)
        if self.next and self.next[0] == case:
            yield from self.next[1]


def write_reports(comparison, cases: Iterable[str], sink, baseline: str = "baseline", candidate: str = "candidate", diagnostics: DataFrame | None = None) -> None:
    """The reports of cases, each written row by row to ``sink(case)``; all cases are one sorted stream.

    A report's order is global, so its sorted rows stream through one writer, a partition at a time;
    ``write_decisions`` is the distributed form.
    """
    wanted = sorted(cases)
    own = lambda df: df.where(F.col("case_name").isin(wanted))
    summaries, metrics = ({r["case_name"]: r for r in own(df).collect()} for df in (comparison.summary, comparison.metrics))  # a row a case
    notes = comparison.diagnostics if diagnostics is None else comparison.diagnostics.unionByName(diagnostics)
    rows = _ByCase(report_rows(own(comparison.findings), own(comparison.decisions)).toLocalIterator())
    noted = _ByCase(own(notes).orderBy("case_name", *diagnostics_order()).toLocalIterator())
    counts = ("new", "unchanged", "moved", "modified", "resolved", "ambiguous")
    for case in wanted:
        summary, m = summaries.get(case), metrics.get(case)
        stream(
            {
                "outputSchemaVersion": OUTPUT, "tool": {"name": NAME, "version": VERSION}, "inputs": {"baseline": baseline, "candidate": candidate},
                "summary": {"baselineCount": summary["baseline_count"] if summary else 0, "candidateCount": summary["candidate_count"] if summary else 0, **{n: summary[n] if summary else 0 for n in counts}},
                "findings": Items(_finding(r) for r in rows.of(case)),
                "diagnostics": Items(_diagnostic(d) for d in noted.of(case)),
                "metrics": {"candidateEdges": m["candidate_edges"] if m else 0, "components": m["components"] if m else 0, "ambiguousComponents": m["ambiguous_components"] if m else 0},
                "determinism": {"ordering": "ordinal", "timestamps": False},
            },
            sink(case),
        )


def write_stable_report(comparison, case_name: str, out, baseline: str = "baseline", candidate: str = "candidate", diagnostics: DataFrame | None = None) -> None:
    """One case's report, written to ``out`` row by row."""
    write_reports(comparison, [case_name], lambda _: out, baseline, candidate, diagnostics)


def measure_reports(comparison, cases: Iterable[str], diagnostics: DataFrame | None = None) -> dict[str, dict]:
    """Size and SHA-256 of the reports of cases, without holding one."""
    sinks: dict[str, Measured] = {}
    write_reports(comparison, cases, lambda case: sinks.setdefault(case, Measured()), diagnostics=diagnostics)
    return {case: sink.result() for case, sink in sinks.items()}


def stable_report(comparison, case_name: str, baseline: str = "baseline", candidate: str = "candidate", diagnostics: DataFrame | None = None) -> bytes:
    """A small report as bytes."""
    out = io.BytesIO()
    write_stable_report(comparison, case_name, out, baseline, candidate, diagnostics)
    return out.getvalue()


def measure_report(comparison, case_name: str, **named) -> dict:
    """Size and SHA-256 of a case's report, without holding it."""
    out = Measured()
    write_stable_report(comparison, case_name, out, **named)
    return out.result()


def read_report(raw: bytes) -> dict:
    """A report read back; its summary must recount its findings."""
    data = json.loads(raw)
    if data.get("outputSchemaVersion") != OUTPUT:
        raise ValueError("unknown report version")
    for name in ("new", "unchanged", "moved", "modified", "resolved", "ambiguous"):
        if data["summary"][name] != sum(f["classification"] == name for f in data["findings"]):
            raise ValueError(f"the summary of {name} differs from the findings")
    keys: set[tuple] = set()
    order: list = []
    for f in data["findings"]:
        named = tuple(f[side]["findingKey"] if f[side] else "" for side in ("baseline", "candidate"))
        for side, key in enumerate(named):
            if key and (side, key) in keys:
                raise ValueError("a finding is named twice")
            keys.add((side, key))
        order.append((f["classification"], *[k.encode("utf-16-be", "surrogatepass") for k in named]))
        sides = (f["baseline"] is not None, f["candidate"] is not None)
        allowed = {"new": {(False, True)}, "resolved": {(True, False)}, "ambiguous": {(True, False), (False, True)}}.get(f["classification"], {(True, True)})
        if sides not in allowed or f["decision"]["ambiguous"] != (f["classification"] == "ambiguous"):
            raise ValueError("a finding's sides don't fit its class")
    if order != sorted(order):
        raise ValueError("the findings are out of order")
    return data


def measure(raw: bytes) -> dict:
    """Size and SHA-256 of report bytes."""
    out = Measured()
    out.write(raw)
    return out.result()


def write_decisions(comparison, path: str) -> None:
    """The decision table as Parquet, by case: the form for results that no single writer should hold."""
    comparison.decisions.write.partitionBy("case_name").parquet(path)


def same_place(a: str, b: str) -> bool:
    """Do two paths name one file, links resolved?"""
    return os.path.realpath(a) == os.path.realpath(b)


def write_all(files: dict[str, bytes], inputs: tuple[str, ...] = ()) -> None:
    """Writes several files or none: all are staged beside their targets first, and put back if one fails."""
    for target in files:
        if any(same_place(target, i) for i in inputs):
            raise ValueError(f"{target} is an input")
    if len({os.path.realpath(t) for t in files}) != len(files):
        raise ValueError("two outputs name one file")
    staged: list[tuple[Path, Path]] = []
    done: list[tuple[Path, bytes | None]] = []
    try:
        for target, raw in files.items():
            path = Path(target)
            handle, name = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}.")
            with os.fdopen(handle, "wb") as f:
                f.write(raw)
            staged.append((Path(name), path))
        for temp, path in staged:
            before = path.read_bytes() if path.exists() else None
            os.replace(temp, path)
            done.append((path, before))
    except OSError:
        for path, before in done:
            path.unlink(missing_ok=True) if before is None else path.write_bytes(before)
        raise
    finally:
        for temp, _ in staged:
            temp.unlink(missing_ok=True)
