"""Findings from plain tables: two snapshots of orders, the second a fixed mutation of the first.

Every choice is arithmetic on the key, so that the same rows can be written in any SQL dialect.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from findrift.functions.exprs import context_hash, derived_fingerprint, with_message
from findrift.schema import ANCHOR, FINGERPRINT, FINDINGS, RELATED

CASE = "orders"


def label(k: Column) -> Column:
    """What happens to an order between the snapshots; the first rule that fits."""
    return (
        F.when(k % 17 == 0, "drop").when(k % 13 == 0, "shared_fp").when(k % 11 == 0, "no_fp").when(k % 7 == 0, "message").when(k % 5 == 0, "move").otherwise("same")
    )


def order_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides flat: side, k, key, label, rule, fp, path, snippet, line, message."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("k"), F.concat_ws("/", F.col("o_custkey").cast("string"), "o_orderstatus").alias("rule"))
    k = F.col("k")
    text = k.cast("string")
    base = orders.withColumn("label", label(k))
    fp = F.when(F.col("label") == "shared_fp", "shared").when(F.col("label") != "no_fp", F.concat(F.lit("fp"), text))
    path = F.concat(F.lit("src/f"), (k % 40).cast("string"), F.lit(".cs"))
    snippet = F.when(k % 31 != 0, F.when(F.col("label") == "no_fp", F.concat(F.lit("s"), (k % 3).cast("string"))).otherwise(F.concat(F.lit("s"), text)))
    line = (k % 1000 + 1).cast("int")
    first = base.select(
        F.lit("baseline").alias("side"), "k", F.concat(F.lit("b:"), text).alias("key"), "label", "rule", fp.alias("fp"), path.alias("path"),
        snippet.alias("snippet"), line.alias("line"), F.concat(F.lit("Message "), text).alias("message"),
    )
    moved = F.when(k % 23 == 0, F.regexp_replace("path", "^src/", "lib/")).otherwise(F.col("path"))
    told = F.when(F.col("label") == "message", F.concat(F.lit("Changed "), text)).when(k % 37 == 0, F.upper("message")).otherwise(F.col("message"))
    shared = first.where("label <> 'drop'").select(
        F.lit("candidate").alias("side"), "k", F.concat(F.lit("c:"), text).alias("key"), "label", "rule", "fp", moved.alias("path"),
        F.when(k % 29 == 0, F.concat("snippet", F.lit("x"))).otherwise(F.col("snippet")).alias("snippet"),
        F.when(F.col("label") == "move", F.col("line") + 100).otherwise(F.col("line")).alias("line"), told.alias("message"),
    )
    n = k + 1_000_000_000
    added = first.where("k % 19 = 0").select(
        F.lit("candidate").alias("side"), n.alias("k"), F.concat(F.lit("c:"), n.cast("string")).alias("key"), F.lit("added").alias("label"), "rule",
        F.concat(F.lit("fp"), n.cast("string")).alias("fp"), "path", F.concat(F.lit("s"), n.cast("string")).alias("snippet"), "line",
        F.concat(F.lit("Message "), n.cast("string")).alias("message"),
    )
    return first.unionByName(shared).unionByName(added)


def findings(spark: SparkSession, sf_dir: str, case: str = CASE) -> DataFrame:
    """The order snapshots as canonical findings."""
    return to_findings(order_rows(spark, sf_dir), case)


def to_findings(rows: DataFrame, case: str = CASE) -> DataFrame:
    """Flat rows (side, key, rule, fp, path, snippet, line, message) as canonical findings of one run."""
    identity, rule = F.lit("known-family/semgrep"), F.concat(F.lit("semgrep/"), F.col("rule"))
    repo = F.col("path")
    none = F.lit(None).cast("string")
    # Hashes are columns of their own, so that each is made once a row however often it is used.
    rows = with_message(rows, "message", "told").withColumn("snippet_hash", context_hash(F.col("snippet")))
    rows = rows.withColumn("derived", derived_fingerprint(identity, rule, repo, F.col("snippet_hash"), none))
    path = F.struct(
        repo.alias("original"), repo.alias("resolved"), F.concat(F.lit("repo://"), repo).alias("canonical_uri"), repo.alias("repo_relative"),
        F.lit("RepositoryRelative").alias("kind"), F.array().cast("array<struct<kind:string,original:string,transformed:string,lossy:boolean,algorithm:string>>").alias("transformations"),
    )
    fps = F.when(
        F.col("fp").isNotNull(),
        F.array(F.struct(F.lit("lineHash/v1").alias("name"), F.lit("lineHash").alias("family"), F.lit(1).alias("version"), F.col("fp").alias("value"),
                         F.lit("high").alias("reliability"), F.lit("partial").alias("source"))),
    ).otherwise(F.array().cast(f"array<{FINGERPRINT}>"))
    snippet_hash, derived = F.col("snippet_hash"), F.col("derived")
    derived_fps = F.when(
        derived.isNotNull(), F.array(F.struct(F.lit("rule-path-context").alias("name"), derived.alias("value"), F.lit("rule-path-context/v2").alias("algorithm")))
    ).otherwise(F.array().cast("array<struct<name:string,value:string,algorithm:string>>"))
    region = F.struct(F.col("line").alias("start_line"), F.lit(None).cast("int").alias("start_column"), F.lit(None).cast("int").alias("end_line"), F.lit(None).cast("int").alias("end_column"))
    context = F.when(
        snippet_hash.isNotNull(),
        F.struct(snippet_hash.alias("snippet_hash"), none.alias("token_window_hash"), F.col("line").alias("start_line"), F.col("line").alias("end_line")),
    )
    made = rows.select(
        F.lit(case).alias("case_name"), "side", F.col("key").alias("finding_key"), F.lit(0).alias("run_index"), F.lit(0).alias("result_index"),
        F.lit("").alias("json_pointer"), F.concat(F.col("side"), F.lit(":0")).alias("run_key"), F.lit("Semgrep").alias("tool_name"), none.alias("tool_version"),
        F.lit("semgrep").alias("producer_family"), identity.alias("producer_identity"), F.col("rule").alias("original_rule"), rule.alias("canonical_rule"),
        F.lit(False).alias("alias_applied"), path.alias("path"), region.alias("region"), F.col("snippet").alias("embedded_snippet"),
        F.col("told").alias("message"), fps.alias("producer_fps"), derived_fps.alias("derived_fps"), context.alias("context"),
        F.array().cast(f"array<{RELATED}>").alias("related"), F.array().cast(f"array<{ANCHOR}>").alias("anchors"), none.alias("level"), none.alias("kind"),
        none.alias("baseline_state"), F.array().cast("array<string>").alias("lossiness"),
    )
    return made.to(spark_schema(made))


def spark_schema(df: DataFrame):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(FINDINGS)
