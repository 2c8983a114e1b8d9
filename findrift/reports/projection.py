"""Projections of a comparison: states, canonical logs, HTML, summaries."""

from __future__ import annotations

import html
import io
import json
from collections import Counter
from collections.abc import Iterable
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findrift.functions import paths
from findrift.functions.exprs import ordinal
from findrift.reports.stable import NAME, VERSION, Items, dumps, region_json, stream

SCHEMA_URI = "https://json.schemastore.org/sarif-2.1.0.json"
STATES = {"new": "new", "unchanged": "unchanged", "moved": "updated", "modified": "updated", "resolved": "absent"}
FILE_SCHEMES = {"repo", "file", "win-drive", "win-drive-relative", "win-root", "unc", "win-device", "win-device-unc", "relative", "unresolved"}


def baseline_state(classification: Column) -> Column:
    """The SARIF baselineState of a class; null for ambiguous ones."""
    return F.try_element_at(F.create_map(*[x for k, v in STATES.items() for x in (F.lit(k), F.lit(v))]), classification)


def encode_artifact(uri: str | None) -> str | None:
    """An artifact URI with everything outside its grammar percent-encoded; null where that can't be."""
    if uri is None:
        return None
    scheme, _, body = uri.partition(":")
    if body and scheme in FILE_SCHEMES:
        encoded = paths.encode_uri_body(body)
        return None if encoded is None else f"{scheme}:{encoded}"
    if paths.kind_of(uri) == "ExternalUri":
        from urllib.parse import quote

        return quote(uri, safe="%/:?#[]@!$&'()*+,;=~-._")
    return paths.encode_uri_body(uri) or None


def _result(rule: str, message: str, uri: str | None, region: dict | None, extra: dict, fingerprint: dict | None, properties: dict) -> dict:
    out: dict = {"ruleId": rule, "message": {"text": message}}
    encoded = encode_artifact(uri)
    if encoded:
        place: dict = {"artifactLocation": {"uri": encoded}}
        if region and region.get("startLine") is not None:
            place["region"] = {k: v for k, v in region.items() if v is not None}
        out["locations"] = [{"physicalLocation": place}]
    out |= extra
    if fingerprint:
        out["partialFingerprints"] = fingerprint
    return out | {"properties": properties}


def write_canonical_log(findings: DataFrame, decisions: DataFrame, out) -> None:
    """A comparison as one canonical log: the candidate's side of each decision, or the baseline's.

    Results sort by rule, URI, key and class, and are written to ``out`` one by one; only the rules' ids
    are held.
    """
    side = findings.select(
        "case_name", F.col("finding_key").alias("key"), "canonical_rule", F.col("path.canonical_uri").alias("uri"), "region", F.col("message.canonical").alias("text"), "derived_fps"
    )
    shown = decisions.select("case_name", "classification", F.coalesce("c_key", "b_key").alias("key")).join(side, ["case_name", "key"])
    ordered = shown.orderBy(ordinal(F.col("canonical_rule")), ordinal(F.coalesce("uri", F.lit(""))), ordinal(F.col("key")), "classification")
    rules = [{"id": r["canonical_rule"]} for r in shown.select("canonical_rule").distinct().orderBy(ordinal(F.col("canonical_rule"))).toLocalIterator()]

    def results():
        for r in ordered.toLocalIterator():
            state = STATES.get(r["classification"])
            fp = {d["name"]: d["value"] for d in r["derived_fps"] or [] if d["algorithm"] == "rule-path-context/v2"}
            extra = {f"{NAME}/classification": r["classification"], f"{NAME}/findingKey": r["key"]}
            yield _result(r["canonical_rule"], r["text"], r["uri"], region_json(r["region"]), {"baselineState": state} if state else {}, fp, extra)

    driver = {"name": NAME, "version": VERSION, "rules": rules}
    stream({"$schema": SCHEMA_URI, "version": "2.1.0", "runs": [{"tool": {"driver": driver}, "results": Items(results())}]}, out)


def canonical_log(findings: DataFrame, decisions: DataFrame) -> bytes:
    """A small comparison's log as bytes."""
    out = io.BytesIO()
    write_canonical_log(findings, decisions, out)
    return out.getvalue()


def write_canonicalised_log(findings: DataFrame, out) -> None:
    """One log's findings in canonical form, grouped by run, sorted by rule, URI, line, column and key; written one by one."""
    ordered = findings.orderBy(
        "run_index", ordinal(F.col("canonical_rule")), ordinal(F.coalesce("path.canonical_uri", F.lit(""))), F.col("region.start_line").asc_nulls_first(),
        F.col("region.start_column").asc_nulls_first(), ordinal(F.col("finding_key")),
    )
    tools = findings.select("run_index", "tool_name", "tool_version", "canonical_rule").distinct().orderBy("run_index", ordinal(F.col("canonical_rule")))
    heads: dict[int, dict] = {}
    for r in tools.toLocalIterator():
        driver = heads.setdefault(r["run_index"], {"name": r["tool_name"], **({"version": r["tool_version"]} if r["tool_version"] else {}), "rules": []})
        driver["rules"].append({"id": r["canonical_rule"]})

    def result(r) -> dict:
        fp = {d["name"]: d["value"] for d in r["derived_fps"] or []}
        meta = {k: v for k, v in (("level", r["level"]), ("kind", r["kind"])) if v}
        extra = {f"{NAME}/findingKey": r["finding_key"], f"{NAME}/producer": r["producer_identity"], f"{NAME}/originalRule": r["original_rule"]}
        return _result(r["canonical_rule"], r["message"]["canonical"], r["path"]["canonical_uri"] if r["path"] else None, region_json(r["region"]), meta, fp, extra)

    def runs():
        for index, rows in groupby(ordered.toLocalIterator(), key=lambda r: r["run_index"]):
            yield {"tool": {"driver": heads[index]}, "results": Items(result(r) for r in rows)}

    stream({"$schema": SCHEMA_URI, "version": "2.1.0", "runs": Items(runs())}, out)


def canonicalised_log(findings: DataFrame) -> bytes:
    """A small log as bytes."""
    out = io.BytesIO()
    write_canonicalised_log(findings, out)
    return out.getvalue()


def validation_summary(diagnostics: DataFrame, valid: bool, name: str) -> bytes:
    """Counts of diagnostics by severity, and the diagnostics in order."""
    from findrift.reports.stable import diagnostics_json

    rows = list(diagnostics_json(diagnostics))  # bounded by the limits on one log
    by = Counter(d["severity"] for d in rows)
    return dumps({"input": name, "valid": valid, "counts": {k: by.get(k, 0) for k in ("error", "warning", "note")}, "diagnostics": rows})


def diagnostic_line(d: dict) -> str:
    where = f" [{d['jsonPointer']}]" if d.get("jsonPointer") else ""
    return f"{d['code']} {d['severity']}: {d['message']}{where}"


_PAGE = """<!DOCTYPE html>
<html lang="en"><head><meta charset="utf-8"><meta http-equiv="Content-Security-Policy" content="default-src 'none'; style-src 'unsafe-inline'">
<title>{title}</title><style>body{{font-family:sans-serif}}td,th{{text-align:left;padding:.2em .6em;vertical-align:top}}</style></head>
<body><h1>{title}</h1><table><tr>{heads}</tr><tr>{counts}</tr></table><table><tr><th>Class</th><th>Rule</th><th>Baseline</th><th>Candidate</th><th>Evidence</th></tr>
{rows}
</table></body></html>
"""


def html_report(report: bytes) -> str:
    """A stable report as a page of its own: no script, no link, all text escaped."""
    data = json.loads(report)
    esc = lambda x: html.escape("" if x is None else str(x), quote=True)

    def place(side: dict | None) -> str:
        if not side:
            return ""
        line = (side.get("region") or {}).get("startLine")
        return esc(side.get("canonicalUri")) + (f":{line}" if line else "") + "<br>" + esc(side["canonicalMessage"])

    rows = []
    for f in data["findings"]:
        one = f["candidate"] or f["baseline"] or {}
        kinds = ", ".join(dict.fromkeys(e["kind"] for e in f["evidence"]))
        rows.append(f"<tr><td>{esc(f['classification'])}</td><td>{esc(one.get('canonicalRule'))}</td><td>{place(f['baseline'])}</td><td>{place(f['candidate'])}</td><td>{esc(kinds)}</td></tr>")
    summary = data["summary"]
    return _PAGE.format(
        title=esc(f"{data['inputs']['baseline']} and {data['inputs']['candidate']}"), heads="".join(f"<th>{esc(k)}</th>" for k in summary),
        counts="".join(f"<td>{esc(v)}</td>" for v in summary.values()), rows="\n".join(rows),
    )


def policy_failures(classes: Iterable[str], fail_on: Iterable[str], compatibility: Iterable[str] = (), strict: bool = False) -> list[str]:
    """Why a comparison fails its policy: classes that it forbids, and advisory diagnostics where those count."""
    out = sorted(set(classes) & set(fail_on))
    return out + (sorted({s for s in compatibility if s in ("warning", "error")}) if strict else [])
