"""Generated inputs: benchmark logs and small labelled cases, the same bytes every time."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findrift.plans import adapters

SIZES = (1_000, 10_000, 100_000)
KINDS = ("unique", "pathological")


def benchmark_findings(spark: SparkSession, size: int, kind: str) -> DataFrame:
    """Both sides of a benchmark case as canonical findings, made in the cluster.

    ``unique`` gives every finding a rule, path and fingerprint of its own; ``pathological`` puts all under
    one rule and path, so that one bucket holds all pairs.
    """
    _known(size, kind)
    unique = kind == "unique"
    n = F.format_string("%06d", F.col("id"))
    rows = spark.range(size).select(
        F.explode(F.array(F.lit("baseline"), F.lit("candidate"))).alias("side"), F.col("id").alias("k"), n.alias("n"),
        (F.concat(F.lit("bench/"), n) if unique else F.lit("bench/bucket")).alias("rule"), F.concat(F.lit("print-"), n).alias("fp"),
        (F.concat(F.lit("src/made/f"), n, F.lit(".cs")) if unique else F.lit("src/made/one.cs")).alias("path"), F.lit(None).cast("string").alias("snippet"),
        (F.lit(1) if unique else F.col("id").cast("int") + 1).alias("line"), (F.concat(F.lit("Finding "), n) if unique else F.lit("One finding")).alias("message"),
    )
    return adapters.to_findings(rows.withColumn("key", F.concat_ws(":", F.substring("side", 1, 1), "n")), f"{kind}-{size}")


def _known(size: int, kind: str) -> None:
    if size not in SIZES or kind not in KINDS:
        raise ValueError(f"sizes are {SIZES}, kinds are {KINDS}")


def benchmark_log(size: int, kind: str, out) -> None:
    """The benchmark case as a log, written result by result."""
    _known(size, kind)
    unique = kind == "unique"
    head = {"tool": {"driver": {"name": "Generated Findings", "version": "1.0.0"}}}
    out.write(b'{"version":"2.1.0","runs":[' + json.dumps(head)[:-1].encode() + b',"results":[')
    for i in range(size):
        n = f"{i:06d}"
        place = {"artifactLocation": {"uri": f"src/made/f{n}.cs" if unique else "src/made/one.cs"}, "region": {"startLine": 1 if unique else i + 1, "startColumn": 1}}
        result = {
            "ruleId": f"bench/{n}" if unique else "bench/bucket", "message": {"text": f"Finding {n}" if unique else "One finding"},
            "partialFingerprints": {"primaryLocationLineHash/v1": f"print-{n}"}, "locations": [{"physicalLocation": place}],
        }
        out.write((b"," if i else b"") + json.dumps(result, separators=(",", ":")).encode())
    out.write(b"]}]}\n")


def _log(results: list[dict], tool: str = "Case Tool") -> dict:
    return {"version": "2.1.0", "runs": [{"tool": {"driver": {"name": tool, "version": "1"}}, "results": results}]}


def _result(n: int, rule: str, path: str, line: int, message: str, fp: str | None = None, snippet: str | None = None) -> dict:
    region = {"startLine": line} | ({"snippet": {"text": snippet}} if snippet else {})
    out = {"ruleId": rule, "message": {"text": message}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": path}, "region": region}}]}
    return out | ({"partialFingerprints": {"caseHash/v1": fp}} if fp else {})


def fixture_cases(n: int = 12) -> dict[str, dict[str, object]]:
    """Small cases with labels, one for each way in which findings change: name to {baseline, candidate, labels, config}."""
    base = [_result(i, f"R{i % 3}", f"src/a{i}.cs", 10 + i, f"Text of {i}", f"fp{i}", f"call({i});") for i in range(n)]
    pairs = lambda cls, keep=range(n): [{"baselineKey": f"baseline:0:{i}", "candidateKey": f"candidate:0:{i}", "classification": cls} for i in keep]
    labels = lambda p, **more: {"schemaVersion": "1", "pairs": p, "expectedAmbiguous": [], "expectedResolved": [], "expectedNew": [], "expectedInvalidInputs": []} | more
    changed = lambda f: [f(i, json.loads(json.dumps(r))) for i, r in enumerate(base)]

    def place(r: dict) -> dict:
        return r["locations"][0]["physicalLocation"]

    def shift(i, r):
        place(r)["region"]["startLine"] += 40
        return r

    def reword(i, r):
        r["message"]["text"] = f"Quite another text {i * 7}"
        return r

    def rename(i, r):
        place(r)["artifactLocation"]["uri"] = place(r)["artifactLocation"]["uri"].replace("src/", "lib/")
        return r

    def bare(i, r):
        r.pop("partialFingerprints")
        return r

    tied = [_result(i, "R", "src/same.cs", 5, "The same text", None, "same();") for i in range(3)]
    fresh = [_result(i, "R9", f"src/new{i}.cs", 3, f"New {i}", f"new{i}", f"fresh({i});") for i in range(2)]
    return {
        "ambiguous": {"baseline": _log(tied), "candidate": _log(tied), "labels": labels([], expectedAmbiguous=[f"{s}:0:{i}" for s in ("baseline", "candidate") for i in range(3)])},
        "context-only": {"baseline": _log(changed(bare)), "candidate": _log(changed(bare)), "labels": labels(pairs("unchanged"))},
        "invalid": {"baseline": "{", "candidate": _log(base[:1]), "labels": labels([], expectedInvalidInputs=["baseline"])},
        "moved-lines": {"baseline": _log(base), "candidate": _log(changed(shift)), "labels": labels(pairs("moved"))},
        "new-and-resolved": {
            "baseline": _log(base), "candidate": _log(base[: n - 2] + fresh),
            "labels": labels(pairs("unchanged", range(n - 2)), expectedResolved=[f"baseline:0:{i}" for i in (n - 2, n - 1)], expectedNew=[f"candidate:0:{i}" for i in (n - 2, n - 1)]),
        },
        "renamed": {
            "baseline": _log(base), "candidate": _log(changed(rename)), "labels": labels(pairs("moved")),
            "config": {"schemaVersion": "1", "pathAliases": [{"baseline": "src/", "candidate": "lib/"}]},
        },
        "reworded": {"baseline": _log(base), "candidate": _log(changed(reword)), "labels": labels(pairs("modified"))},
        "stable": {"baseline": _log(base), "candidate": _log(base), "labels": labels(pairs("unchanged"))},
    }


def write_fixtures(root: str | Path, n: int = 12) -> None:
    """The cases as folders below ``root``/cases."""
    for name, case in fixture_cases(n).items():
        folder = Path(root) / "cases" / name
        folder.mkdir(parents=True, exist_ok=True)
        for part, value in case.items():
            file = {"baseline": "baseline.sarif", "candidate": "candidate.sarif", "labels": "labels.json", "config": "config.json"}[part]
            (folder / file).write_text(value if isinstance(value, str) else json.dumps(value, indent=1, sort_keys=True) + "\n", encoding="utf-8")
