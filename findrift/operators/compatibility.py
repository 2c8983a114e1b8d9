"""Code-scanning limits of a hosting service, checked on run summaries: advisory diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findrift.schema import DIAGNOSTIC

#: code, severity, run fact, the most that passes
RUN_THRESHOLDS = (
    ("GHCS0004", "warning", "results", 25_000), ("GHCS0005", "note", "results", 5_000), ("GHCS0006", "warning", "rules", 25_000),
    ("GHCS0007", "warning", "extensions", 100), ("GHCS0008", "warning", "max_flow_locations", 10_000), ("GHCS0009", "note", "max_flow_locations", 1_000),
    ("GHCS0010", "warning", "max_locations", 1_000), ("GHCS0011", "note", "max_locations", 100), ("GHCS0015", "warning", "max_tags", 20),
    ("GHCS0016", "note", "max_tags", 10), ("GHCS0012", "warning", "multiple_locations", 0), ("GHCS0018", "warning", "without_location", 0),
    ("GHCS0013", "note", "without_line_hash", 0), ("GHCS0022", "note", "later_directories", 0),
)
MAX_RUNS, MAX_ALERTS, MAX_UPLOAD = 20, 1_000_000, 10_000_000


def run_checks(summaries: DataFrame) -> DataFrame:
    """One row per broken rule of a run: case_name, side, run_index, code, severity, actual."""
    facts = sorted({f for _, _, f, _ in RUN_THRESHOLDS})
    long = summaries.select("case_name", "side", "run_index", F.explode(F.create_map(*[x for f in facts for x in (F.lit(f), F.col(f).cast("long"))])).alias("fact", "actual"))
    # The rules are this module's constant.
    rules = F.broadcast(summaries.sparkSession.createDataFrame(list(RUN_THRESHOLDS), "code string, severity string, fact string, most long"))
    over = long.join(rules, "fact").where("actual > most").select("case_name", "side", "run_index", "code", "severity", "actual")
    absolute = F.col("absolute_uris") + F.col("absolute_paths")
    root = (
        F.when(F.col("absolute_paths") > 0, F.struct(F.lit("GHCS0017").alias("code"), F.lit("warning").alias("severity"), F.col("absolute_paths").alias("actual"))),
        F.when(
            (F.col("absolute_uris") > 0) & (F.col("directory_kind") == "missing"),
            F.struct(F.lit("GHCS0017").alias("code"), F.lit("warning").alias("severity"), F.col("absolute_uris").alias("actual")),
        ),
        F.when(
            (F.col("absolute_uris") > 0) & F.col("directory_kind").isin("relative-reference", "absolute-path", "invalid"),
            F.struct(F.lit("GHCS0019").alias("code"), F.lit("warning").alias("severity"), F.col("absolute_uris").alias("actual")),
        ),
        F.when(F.col("scheme_mismatches") > 0, F.struct(F.lit("GHCS0020").alias("code"), F.lit("warning").alias("severity"), F.col("scheme_mismatches").alias("actual"))),
        F.when(F.col("outside_root") > 0, F.struct(F.lit("GHCS0021").alias("code"), F.lit("note").alias("severity"), F.col("outside_root").alias("actual"))),
        F.when(
            (absolute > 0) & (F.col("non_repository") > absolute),
            F.struct(F.lit("GHCS0017").alias("code"), F.lit("warning").alias("severity"), F.col("non_repository").alias("actual")),
        ),
    )
    rooted = summaries.select("case_name", "side", "run_index", F.explode(F.array_compact(F.array(*root))).alias("x")).select("case_name", "side", "run_index", "x.code", "x.severity", "x.actual")
    return over.unionByName(rooted)


def ignored_checks(ignored: DataFrame) -> DataFrame:
    """GHCS0023 for each ignored property of a run."""
    return ignored.select("case_name", "side", "run_index", F.lit("GHCS0023").alias("code"), F.lit("note").alias("severity"), F.col("n").alias("actual"))


def document_checks(documents: DataFrame, summaries: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """Rules on whole files: version, number of runs, total results, compressed size where it is given (bytes)."""
    none = F.lit(None).cast("int")
    totals = summaries.groupBy("case_name", "side").agg(F.sum("results").alias("results"))
    facts = documents.join(totals, ["case_name", "side"], "left")
    facts = facts.join(sizes, ["case_name", "side"], "left") if sizes is not None else facts.withColumn("bytes", F.lit(None).cast("long"))
    struct = lambda code, severity, actual: F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), actual.cast("long").alias("actual"))
    found = F.array_compact(
        F.array(
            F.when(~F.col("version").eqNullSafe(F.lit("2.1.0")), struct("GHCS0001", "warning", F.lit(0))),
            F.when(F.col("bytes") > MAX_UPLOAD, struct("GHCS0002", "warning", F.col("bytes"))),
            F.when(F.col("n_runs") > MAX_RUNS, struct("GHCS0003", "warning", F.col("n_runs"))),
            F.when(F.col("results") > MAX_ALERTS, struct("GHCS0014", "note", F.col("results"))),
        )
    )
    return facts.select("case_name", "side", none.alias("run_index"), F.explode(found).alias("x")).select("case_name", "side", "run_index", "x.code", "x.severity", "x.actual")


def compatibility(documents: DataFrame, summaries: DataFrame, ignored: DataFrame) -> DataFrame:
    """All advisory diagnostics of the files."""
    return document_checks(documents, summaries).unionByName(run_checks(summaries)).unionByName(ignored_checks(ignored))


def diagnostics(checks: DataFrame) -> DataFrame:
    """Advisory rows as diagnostics: case_name and the diagnostic's fields."""
    none = F.lit(None).cast("string")
    pointer = F.when(F.col("run_index").isNull(), "").otherwise(F.concat(F.lit("/runs/"), F.col("run_index").cast("string")))
    message = F.concat(F.lit("A limit of the hosting service is exceeded or a fact is ignored there: "), F.col("actual").cast("string"), F.lit("."))
    made = F.struct(
        "code", "severity", F.lit("github-compat").alias("stage"), message.alias("message"), F.col("side").alias("input"), "run_index",
        F.lit(None).cast("int").alias("result_index"), pointer.alias("json_pointer"), none.alias("help"),
    )
    return checks.select("case_name", made.cast(DIAGNOSTIC).alias("d")).select("case_name", "d.*")
