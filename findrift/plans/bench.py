"""A generated case read, compared and measured, with the budgets that its size has."""

from __future__ import annotations

import resource
import sys
import tempfile
import time
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from findrift.config import Config
from findrift.operators import assignment
from findrift.plans import compare
from findrift.reports import stable
from findrift.sources import generate, sarif

#: Seconds and bytes that a size may take.
BUDGETS = {1_000: (10.0, 512 << 20), 10_000: (20.0, 768 << 20), 100_000: (60.0, 1 << 30)}
REFUSALS = ("MATCH0007", "MATCH0008", "MATCH0009")


def run(spark: SparkSession, size: int, kind: str, config: Config = Config()) -> dict:  # noqa: B008
    """Writes the case's log, reads it as both sides, compares and measures: counts, seconds, budget failures."""
    seconds: dict[str, float] = {}

    def timed(name: str, f):
        began = time.time()
        out = f()
        seconds[name] = round(time.time() - began, 3)
        return out

    with tempfile.TemporaryDirectory() as folder:  # generated input, read by this machine's own session only
        path = Path(folder) / "log.sarif"
        with path.open("wb") as f:
            generate.benchmark_log(size, kind, f)
        case = f"{kind}-{size}"
        read = timed("ingest", lambda: sarif.ingest(spark, [(case, "baseline", str(path)), (case, "candidate", str(path))], config))
        done = timed("compare", lambda: compare.compare(read.findings, config))
        measured = timed("serialise", lambda: stable.measure_reports(done, [case], read.diagnostics)[case])
        m = done.metrics.first().asDict()
        sizes = assignment.component_sizes(done.edges).agg(F.max("size")).first()[0]
        codes = sorted(r["code"] for r in done.diagnostics.select("code").distinct().collect())  # a dozen codes at most
        classes = {r["classification"]: r["count"] for r in done.decisions.groupBy("classification").count().collect()}
    refused = 2 * size if m["candidate_edges"] == 0 and classes.get("ambiguous") == 2 * size else 0
    counts = {
        "candidateEdges": m["candidate_edges"], "components": m["components"], "ambiguousComponents": m["ambiguous_components"],
        "largestComponent": refused or sizes or 0, "codes": codes, "classes": dict(sorted(classes.items())), "report": measured,
    }
    most_s, most_bytes = BUDGETS[size]
    peak = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss * (1 if sys.platform == "darwin" else 1024)
    failures = []
    if sum(seconds.values()) > most_s:
        failures.append("latency-budget-exceeded")
    if peak > most_bytes:
        failures.append("working-set-budget-exceeded")
    if kind == "pathological" and (m["candidate_edges"] or not m["ambiguous_components"] or not set(codes) & set(REFUSALS)):
        failures.append("pathological-bucket-not-bounded")
    return {"dataset": {"kind": kind, "findings": size}, "operations": counts, "observations": {"seconds": seconds, "driverPeakBytes": peak},
            "budget": {"seconds": most_s, "bytes": most_bytes, "failures": failures}}


def report(result: dict, deterministic: bool = False) -> bytes:
    """The benchmark report; without times and memory where it must be the same on every machine."""
    shown = {k: v for k, v in result.items() if not deterministic or k != "observations"}
    if deterministic:
        shown = shown | {"budget": {k: v for k, v in result["budget"].items() if k != "failures"}}
    return stable.dumps({"benchmarkReportVersion": "1", "tool": {"name": stable.NAME, "version": stable.VERSION}, **shown})
