"""Commands: compare, validate, canonicalise, corpus, bench.

``python -m findrift.cli COMMAND --help`` lists a command's options.  Exit codes: 0 passed, 1 the policy or
gate failed, 2 an input is invalid, 3 wrong usage or an output can't be written.
"""

from __future__ import annotations

import argparse
import io
import sys
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import SparkSession

from findrift.config import Config, read_config_file
from findrift.operators import compatibility
from findrift.plans import bench, compare, corpus
from findrift.reports import projection, stable
from findrift.sources import repository, sarif

PASSED, FAILED, INVALID, USAGE = range(4)


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="findrift", description="Compares snapshots of static-analysis findings.")
    commands = top.add_subparsers(dest="command", required=True)
    c = commands.add_parser("compare", help="decide for every finding of two logs whether it is new, unchanged, moved, modified, resolved or ambiguous")
    c.add_argument("--baseline", required=True)
    c.add_argument("--candidate", required=True)
    for side in ("baseline", "candidate"):
        c.add_argument(f"--{side}-repo")
        c.add_argument(f"--{side}-manifest")
    for name in ("json-out", "html-out", "sarif-out"):
        c.add_argument(f"--{name}")
    v = commands.add_parser("validate", help="check one log and list its diagnostics")
    k = commands.add_parser("canonicalise", help="write one log in canonical form")
    for p in (v, k):
        p.add_argument("--input", required=True)
    v.add_argument("--json-out")
    k.add_argument("--sarif-out", required=True)
    for p in (c, v, k):
        p.add_argument("--repo")
        p.add_argument("--config")
    u = commands.add_parser("corpus", help="run labelled cases and gate their quality")
    u.add_argument("--corpus", required=True)
    u.add_argument("--json-out")
    b = commands.add_parser("bench", help="run a generated case against its budget")
    b.add_argument("--size", type=int, default=1_000)
    b.add_argument("--dataset", choices=("unique", "pathological"), default="unique")
    b.add_argument("--json-out")
    b.add_argument("--deterministic-out")
    b.add_argument("--enforce-budgets", action="store_true")
    return top


def _roots(args, config: Config) -> dict[str, repository.Root]:
    roots = {}
    for side in ("baseline", "candidate"):
        path = getattr(args, f"{side}_repo", None) or args.repo or config.repository_root
        manifest = getattr(args, f"{side}_manifest", None)
        if path:
            roots[side] = repository.Root(str(Path(path).resolve()), repository.read_manifest_file(str(Path(manifest).resolve()), config.limits) if manifest else None)
    return roots


def _say(line: str) -> None:
    print(line, file=sys.stderr)


def _compare(spark: SparkSession, args) -> int:
    config, notes = read_config_file(args.config)
    for n in notes:
        _say(f"{n.code} {n.severity}: {n.message} [{n.pointer}]")
    if config is None:
        return INVALID
    read = sarif.ingest(spark, [("case", "baseline", args.baseline), ("case", "candidate", args.candidate)], config)
    placed, more = repository.with_repository(read.findings, _roots(args, config), config)
    every = read.diagnostics.unionByName(more)
    invalid = [r["side"] for r in read.documents.where("not valid").collect()]  # two rows
    if invalid:
        for d in stable.diagnostics_json(every):
            _say(projection.diagnostic_line(d))
        return INVALID
    done = compare.compare(placed, config)
    checks = compatibility.diagnostics(compatibility.compatibility(read.documents, sarif.run_summaries(read.runs, read.results), sarif.ignored_properties(read.runs, read.results)))
    files: dict[str, bytes] = {}
    report = io.BytesIO()
    stable.write_stable_report(done, "case", report, Path(args.baseline).name, Path(args.candidate).name, every.unionByName(checks))
    if args.json_out:
        files[args.json_out] = report.getvalue()
    if args.html_out:
        files[args.html_out] = projection.html_report(report.getvalue()).encode()
    if args.sarif_out:
        files[args.sarif_out] = projection.canonical_log(done.findings, done.decisions)
    stable.write_all(files, (args.baseline, args.candidate))
    if not files:
        sys.stdout.write(report.getvalue().decode())
    classes = [r["classification"] for r in done.decisions.select("classification").distinct().collect()]  # six at most
    advice = [r["severity"] for r in checks.select("severity").distinct().collect()]
    failed = projection.policy_failures(classes, config.fail_on, advice, config.treat_github_incompatibility_as_error)
    for f in failed:
        _say(f"the policy forbids: {f}")
    return FAILED if failed else PASSED


def _one(spark: SparkSession, args):
    config, _ = read_config_file(args.config)
    if config is None:
        return None, None, None
    read = sarif.ingest(spark, [("case", "candidate", args.input)], config)
    placed, more = repository.with_repository(read.findings, _roots(args, config), config)
    return read, placed, read.diagnostics.unionByName(more)


def _validate(spark: SparkSession, args) -> int:
    read, _, notes = _one(spark, args)
    if read is None:
        return INVALID
    valid = read.documents.where("not valid").isEmpty()
    raw = projection.validation_summary(notes, valid, Path(args.input).name)
    stable.write_all({args.json_out: raw}, (args.input,)) if args.json_out else sys.stdout.write(raw.decode())
    return PASSED if valid else INVALID


def _canonicalise(spark: SparkSession, args) -> int:
    read, placed, notes = _one(spark, args)
    if read is None or not read.documents.where("not valid").isEmpty():
        for d in stable.diagnostics_json(notes) if notes is not None else ():
            _say(projection.diagnostic_line(d))
        return INVALID
    stable.write_all({args.sarif_out: projection.canonicalised_log(placed)}, (args.input,))
    return PASSED


def _corpus(spark: SparkSession, args) -> int:
    result = corpus.run_corpus(spark, args.corpus)
    raw = corpus.report(result)
    stable.write_all({args.json_out: raw}) if args.json_out else sys.stdout.write(raw.decode())
    return PASSED if result.passed else FAILED


def _bench(spark: SparkSession, args) -> int:
    result = bench.run(spark, args.size, args.dataset)
    files = {n: raw for n, raw in ((args.json_out, bench.report(result)), (args.deterministic_out, bench.report(result, deterministic=True))) if n}
    stable.write_all(files)
    if not files:
        sys.stdout.write(bench.report(result).decode())
    return FAILED if args.enforce_budgets and result["budget"]["failures"] else PASSED


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        args = _parser().parse_args(argv)
    except SystemExit as e:
        return PASSED if e.code == 0 else USAGE
    spark = spark or SparkSession.builder.appName("findrift").getOrCreate()
    run = {"compare": _compare, "validate": _validate, "canonicalise": _canonicalise, "corpus": _corpus, "bench": _bench}[args.command]
    try:
        return run(spark, args)
    except repository.BadManifest as e:
        _say(f"{e.code} error: {e}")
        return INVALID
    except (OSError, ValueError) as e:
        _say(f"error: {e}")
        return USAGE


if __name__ == "__main__":
    sys.exit(main())
