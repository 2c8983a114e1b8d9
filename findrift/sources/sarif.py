"""Reading SARIF 2.1.0 logs into findings, diagnostics and run summaries.

The strict reader splits a log into runs and results, one row each; everything after that is columns:
rules, messages, regions, fingerprints, locations by joins with the run's artifacts and bases.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from findrift.checkpoints import checkpoint
from findrift.config import Config
from findrift.functions import exprs, paths
from findrift.schema import ANCHOR, CONTEXT, DERIVED, DIAGNOSTIC, FINDINGS, FINGERPRINT, RELATED
from findrift.sources import wire

ROWS = "case_name string, side string, what string, run_index int, result_index int, body string, code string, stage string, message string"
LOC = ["case_name", "side", "run_index", "result_index", "role", "at"]
RESULT_ID = ["case_name", "side", "run_index", "result_index"]
RUN_ID = ["case_name", "side", "run_index"]


@dataclass
class Ingested:
    """What a set of logs holds, keyed by case_name and side."""

    findings: DataFrame
    diagnostics: DataFrame
    runs: DataFrame
    results: DataFrame
    documents: DataFrame


def scan(spark: SparkSession, logs: Sequence[tuple[str, str, str]], config: Config = Config()) -> DataFrame:  # noqa: B008
    """Logs (case, side, path) as rows: one per document, run and result, or a refusal.

    Files over the input limit are refused by their size, before their bytes are read.
    """
    names = spark.createDataFrame([(c, s, _uri(p)) for c, s, p in logs], "case_name string, side string, path string")
    files = spark.read.format("binaryFile").load([p for _, _, p in logs]).select("path", "length", "content")
    # The list of logs is the caller's own, so it is small enough to send.
    named = files.join(F.broadcast(names), "path")
    limit = config.limits.maximum_input_bytes
    big = named.where(F.col("length") > limit).select(
        "case_name", "side", F.lit("refused").alias("what"), F.lit(None).cast("int").alias("run_index"), F.lit(None).cast("int").alias("result_index"),
        F.lit(None).cast("string").alias("body"), F.lit("SECURITY0100").alias("code"), F.lit("security").alias("stage"),
        F.lit("The log exceeds the input limit.").alias("message"),
    )
    limits = config.limits

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for case, side, content in frame[["case_name", "side", "content"]].itertuples(index=False):
                rows = list(_split(case, side, bytes(content), limits))
                yield pd.DataFrame(rows, columns=[x.split()[0] for x in ROWS.split(", ")])

    small = named.where(F.col("length") <= limit).select("case_name", "side", "content")
    return small.mapInPandas(run, ROWS).unionByName(big)


def _uri(path: str) -> str:
    return path if ":" in path else f"file:{path}"


def _split(case: str, side: str, raw: bytes, limits) -> Iterator[tuple]:
    try:
        log = wire.read_log(raw, limits)
    except wire.Refused as e:
        yield case, side, "refused", None, None, None, e.code, e.stage, e.message
        return
    runs = log.get("runs")
    note = lambda code, stage, message, run=None: (case, side, "note", run, None, None, code, stage, message)
    valid = True
    if log.get("version") != "2.1.0":
        yield note("SCHEMA0101", "schema", 'The version must be "2.1.0".')
        valid = False
    if runs is None:
        yield note("SCHEMA0102", "schema", "There is no runs array.")
        valid = False
    elif len(runs) > limits.maximum_runs:
        yield note("SECURITY0101", "security", "There are too many runs.")
        valid = False
    yield case, side, "document", None, None, json.dumps({"version": log.get("version"), "n_runs": len(runs or []), "valid": valid}), None, None, None
    for i, run in enumerate(runs or []):
        if run is None:
            yield note("SCHEMA0103", "schema", "A run cannot be null.", i)
            yield case, side, "run", i, None, None, None, None, None
            continue
        results = run.pop("results", None)
        yield case, side, "run", i, None, json.dumps({**run, "n_results": len(results or [])}), None, None, None
        for j, result in enumerate(results or []):
            yield case, side, "result", i, j, None if result is None else json.dumps(result), None, None, None


RUN_BODY = "struct<" + ",".join(f"{k}:{wire.ddl(v)}" for k, v in wire.RUN.items() if k != "results") + ",n_results:int>"
RESULT_BODY = wire.ddl(wire.RESULT)


def diagnostic(code: str, severity: str, stage: str, message: str, side: Column, run: Column, result: Column, pointer: Column) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(
        F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(stage).alias("stage"), F.lit(message).alias("message"), side.alias("input"),
        run.cast("int").alias("run_index"), result.cast("int").alias("result_index"), pointer.alias("json_pointer"), none.alias("help"),
    )


def _note(code: str, severity: str, stage: str, message: str, when: Column, suffix: str | Column = "") -> Column:
    tail = F.lit(suffix) if isinstance(suffix, str) else suffix
    made = diagnostic(code, severity, stage, message, F.col("side"), F.col("run_index"), F.col("result_index"), F.concat(F.col("pointer"), tail))
    return F.when(F.coalesce(when, F.lit(False)), made)


def _size(c: Column) -> Column:
    return F.coalesce(F.size(c), F.lit(0))


def thread_flow_locations(r: Column) -> Column:
    """Locations over all thread flows of all code flows."""
    return F.coalesce(
        F.aggregate(
            r["codeFlows"], F.lit(0),
            lambda n, f: n + F.coalesce(F.aggregate(f["threadFlows"], F.lit(0), lambda m, t: m + F.greatest(_size(t["locations"]), F.lit(0))), F.lit(0)),
        ),
        F.lit(0),
    )


def ingest(spark: SparkSession, logs: Sequence[tuple[str, str, str]], config: Config = Config()) -> Ingested:  # noqa: B008
    """Findings of all logs, with everything that was noted on the way.

    A log with an error diagnostic is invalid as a whole (see ``documents.valid``); its findings are
    still listed.
    """
    rows = checkpoint(scan(spark, logs, config))
    limits = config.limits
    items = limits.maximum_run_collection_items

    stated = rows.where("what in ('refused', 'note')").select(
        "case_name", diagnosed(F.col("code"), F.col("stage"), F.col("message")).alias("d")
    )
    heads = rows.where("what = 'run' and body is not null").select(*RUN_ID, F.from_json("body", RUN_BODY).alias("run"))
    r = F.col("run")
    pointer = F.concat(F.lit("/runs/"), F.col("run_index").cast("string"))
    runs = heads.withColumn("pointer", pointer).withColumn("result_index", F.lit(None).cast("int"))
    too_long = lambda c: exprs.units(c) > limits.maximum_string_characters
    name = r["tool"]["driver"]["name"]
    blank = name.isNull() | name.rlike(f"^{exprs.SPACE}*$")
    caps = [
        (_size(r["tool"]["driver"]["rules"]), "/tool/driver/rules"), (_size(r["artifacts"]), "/artifacts"), (F.coalesce(r["n_results"], F.lit(0)), "/results"),
        (_size(r["originalUriBaseIds"]), "/originalUriBaseIds"), (_size(r["invocations"]), "/invocations"),
    ]
    fits = ~exprs.any_of([n > items for n, _ in caps])
    run_notes = exprs.keep(
        *[_note("SECURITY0102", "error", "security", "A collection of the run exceeds its limit.", n > items, p) for n, p in caps],
        _note("SCHEMA0114", "error", "schema", "A required string is empty.", fits & blank, "/tool/driver/name"),
        _note("SECURITY0103", "error", "security", "A string exceeds the configured limit.", fits & too_long(name), "/tool/driver/name"),
        _note("UNSUPPORTED0100", "warning", "unsupported", "Graphs are not compared.", r["graphs"].isNotNull(), "/graphs"),
    )
    runs = runs.withColumn("notes", run_notes).withColumn("usable", fits & ~blank & ~F.coalesce(too_long(name), F.lit(False)))
    valid_docs = rows.where("what = 'document'").select("case_name", "side", F.from_json("body", "version string, n_runs int, valid boolean").alias("doc"))

    open_runs = runs.where("usable").join(valid_docs.where("doc.valid").select("case_name", "side"), ["case_name", "side"], "left_semi")
    tool = open_runs.select(
        *RUN_ID, name.alias("tool_name"), F.coalesce(r["tool"]["driver"]["semanticVersion"], r["tool"]["driver"]["version"]).alias("tool_version"),
        exprs.family_slug(name).alias("producer_family"), exprs.producer_identity(name).alias("producer_identity"),
        exprs.producer_allowlisted(name).alias("allowlisted"), F.to_json(r["originalUriBaseIds"]).alias("bases"),
    )
    rules = open_runs.select(*RUN_ID, F.posexplode(r["tool"]["driver"]["rules"]).alias("rule_index", "rule")).select(*RUN_ID, "rule_index", F.col("rule.id").alias("indexed"))
    artifacts = open_runs.select(*RUN_ID, F.posexplode(r["artifacts"]).alias("index", "a")).select(*RUN_ID, "index", F.col("a.location").alias("artifact"))

    raw = rows.where("what = 'result'").select(*RESULT_ID, F.from_json("body", RESULT_BODY).alias("r"), F.col("body").isNull().alias("absent"))
    results = raw.join(tool, RUN_ID).withColumn("pointer", F.concat(pointer, F.lit("/results/"), F.col("result_index").cast("string")))
    q = F.col("r")
    caps = [
        (_size(q["locations"]), limits.maximum_locations_per_result, "/locations"), (_size(q["relatedLocations"]), limits.maximum_locations_per_result, "/relatedLocations"),
        (_size(q["codeFlows"]), limits.maximum_code_flows_per_result, "/codeFlows"), (_size(q["fingerprints"]), items, "/fingerprints"),
        (_size(q["partialFingerprints"]), items, "/partialFingerprints"), (thread_flow_locations(q), limits.maximum_thread_flow_locations_per_result, "/codeFlows"),
    ]
    inside = ~exprs.any_of([n > top for n, top, _ in caps])
    there = ~F.col("absent")
    indexed = results.join(rules, [*[results[c] == rules[c] for c in RUN_ID], F.col("r.ruleIndex") == rules["rule_index"]], "left").select(results["*"], "indexed")
    is_blank = lambda c: c.isNull() | c.rlike(f"^{exprs.SPACE}*$")
    rule = F.coalesce(q["ruleId"], F.when(~is_blank(F.col("indexed")), F.col("indexed")))
    text = F.coalesce(q["message"]["text"], q["message"]["markdown"])
    ok = there & inside
    notes = exprs.keep(
        _note("SCHEMA0104", "error", "schema", "A result cannot be null.", F.col("absent")),
        *[_note("SECURITY0102", "error", "security", "A collection of the result exceeds its limit.", there & (n > top), p) for n, top, p in caps],
        *[_note("UNSUPPORTED0100", "warning", "unsupported", f"{m} are not compared.", ok & q[m].isNotNull(), f"/{m}") for m in ("logicalLocations", "stacks", "suppressions", "attachments")],
        _note("SCHEMA0110", "error", "schema", "The rule index names no driver rule.", ok & q["ruleIndex"].isNotNull() & is_blank(F.col("indexed")), "/ruleIndex"),
        _note("SCHEMA0111", "warning", "schema", "The rule id and the indexed rule differ; the id counts.", ok & (q["ruleId"] != F.col("indexed")), "/ruleId"),
        _note("SCHEMA0112", "error", "schema", "The result names no rule.", ok & is_blank(rule)),
        _note("SCHEMA0113", "error", "schema", "The message has neither text nor markdown.", ok & ~is_blank(rule) & text.isNull(), "/message"),
    )
    gated = indexed.withColumn("notes", notes).withColumn("rule", rule).withColumn("text", text)
    stay = checkpoint(gated.where(ok & ~is_blank(F.col("rule")) & F.col("text").isNotNull()))

    placed = checkpoint(_locations(stay, tool, artifacts, config))
    findings = checkpoint(_findings(stay, placed, config))
    notes_of = lambda df, col: df.select("case_name", F.explode(col).alias("d"))
    blank_fp = stay.select("case_name", "side", "run_index", "result_index", "pointer", F.explode(_fingerprint_entries()).alias("e")).where(
        is_blank(F.col("e.name")) | is_blank(F.col("e.value"))
    )
    blank_notes = blank_fp.select(
        "case_name", diagnostic("CANON0020", "warning", "fingerprint", "A fingerprint without a name or value is ignored.", F.col("side"), F.col("run_index"), F.col("result_index"), F.col("pointer")).alias("d")
    )
    every = (
        stated.unionByName(notes_of(runs, "notes")).unionByName(notes_of(gated, "notes")).unionByName(notes_of(placed, "notes")).unionByName(blank_notes)
    )
    diagnostics = checkpoint(every.select("case_name", F.col("d").cast(DIAGNOSTIC).alias("d")).select("case_name", "d.*").distinct())
    bad = diagnostics.where("severity = 'error'").select("case_name", F.col("input").alias("side")).distinct().withColumn("bad", F.lit(True))
    sides = rows.select("case_name", "side").distinct()
    documents = sides.join(valid_docs, ["case_name", "side"], "left").join(bad, ["case_name", "side"], "left").select(
        "case_name", "side", F.col("doc.version").alias("version"), F.coalesce("doc.n_runs", F.lit(0)).alias("n_runs"), F.col("bad").isNull().alias("valid")
    )
    return Ingested(findings, diagnostics, heads, raw, documents)


def diagnosed(code: Column, stage: Column, message: Column) -> Column:
    """A document's own diagnostic."""
    none = F.lit(None).cast("string")
    where = F.when(F.col("run_index").isNotNull(), F.concat(F.lit("/runs/"), F.col("run_index").cast("string"))).when(code == "SCHEMA0101", "/version").when(code.isin("SCHEMA0102", "SECURITY0101"), "/runs").otherwise("")
    return F.struct(
        code.alias("code"), F.lit("error").alias("severity"), stage.alias("stage"), message.alias("message"), F.col("side").alias("input"),
        F.col("run_index").alias("run_index"), F.col("result_index").alias("result_index"), where.alias("json_pointer"), none.alias("help"),
    )


_RESOLVED = StructType([StructField("uri", StringType()), StructField("codes", ArrayType(StringType())), StructField("used", ArrayType(StringType()))])


def _resolver(config: Config):
    configured = {b["id"]: b for b in config.uri_bases}
    depth = config.limits.maximum_uri_base_depth

    @F.pandas_udf(_RESOLVED)
    def resolve(uri: pd.Series, base: pd.Series, bases: pd.Series) -> pd.DataFrame:
        known: dict[str, dict] = {}
        out = []
        for u, b, text in zip(uri, base, bases, strict=True):
            if u is None or b is None:
                out.append((None, [], []))
                continue
            defined = known.setdefault(text or "", json.loads(text) if text else {})
            whole, notes, used = paths.resolve_base(b, u, defined, configured, depth)
            out.append((whole, [f"{c}:{s}" for c, s in notes], used))
        return pd.DataFrame(out, columns=["uri", "codes", "used"])

    return resolve


def _locations(stay: DataFrame, tool: DataFrame, artifacts: DataFrame, config: Config) -> DataFrame:
    """Every location of every result, canonical: role (primary, related, flow), at, path, region, snippet, notes."""
    q = F.col("r")
    item = lambda role, at, loc, tail: F.struct(F.lit(role).alias("role"), at.alias("at"), loc.alias("loc"), tail.alias("tail"))
    n = lambda x: x.cast("string")
    some = F.coalesce(q["locations"], F.array().cast(wire.ddl([wire.LOCATION])))
    main = F.transform(some, lambda x, i: item("location", i, x, F.concat(F.lit("/locations/"), n(i))))
    other = F.transform(
        F.coalesce(q["relatedLocations"], F.array().cast(wire.ddl([wire.LOCATION]))),
        lambda x, i: item("related", F.size(some) + i, x, F.concat(F.lit("/relatedLocations/"), n(i))),
    )
    flows = F.flatten(
        F.transform(
            F.coalesce(q["codeFlows"], F.array().cast(wire.ddl(wire.RESULT["codeFlows"]))),
            lambda f, i: F.flatten(
                F.transform(
                    F.coalesce(f["threadFlows"], F.array().cast(wire.ddl(wire.RESULT["codeFlows"][0]["threadFlows"]))),
                    lambda t, j: F.transform(
                        F.coalesce(t["locations"], F.array().cast(wire.ddl(wire.RESULT["codeFlows"][0]["threadFlows"][0]["locations"]))),
                        lambda x, k: item("flow", k, x["location"], F.concat(F.lit("/codeFlows/"), n(i), F.lit("/threadFlows/"), n(j), F.lit("/locations/"), n(k), F.lit("/location"))),
                    ),
                )
            ),
        )
    )
    every = stay.select(*RESULT_ID, "pointer", "bases", F.explode(F.concat(main, other, flows)).alias("x")).select(
        *RESULT_ID, F.concat("pointer", F.col("x.tail")).alias("pointer"), "bases", "x.role", "x.at", F.col("x.loc").alias("loc")
    )
    art = F.col("loc.physicalLocation.artifactLocation")
    on = [*[every[c] == artifacts[c] for c in RUN_ID], F.col("loc.physicalLocation.artifactLocation.index") == artifacts["index"]]
    with_artifact = every.join(artifacts, on, "left").select(every["*"], "artifact")
    resolve = _resolver(config)
    both = with_artifact.withColumn("own", resolve(art["uri"], art["uriBaseId"], F.col("bases"))).withColumn(
        "listed", resolve(F.col("artifact.uri"), F.col("artifact.uriBaseId"), F.col("bases"))
    )
    fold, rebases = config.fold_paths, config.rebases()
    both = both.withColumn("_own", art["uri"]).withColumn("_own_uri", F.col("own.uri")).withColumn("_listed", F.col("artifact.uri")).withColumn("_listed_uri", F.col("listed.uri"))
    for source, out in (("_own", "own_path"), ("_listed", "listed_path")):
        # Written out: the steps of a path refer to each other, and inlined they would grow without bound.
        both = checkpoint(paths.canonicalise(both, source, f"{source}_uri", out, root=config.repository_root, rebases=rebases, fold=fold))
    physical = F.col("loc.physicalLocation").isNotNull()
    none_art = physical & art.isNull()
    bad_index = art["index"].isNotNull() & F.col("artifact").isNull()
    blank = lambda c: c.isNull() | c.rlike(r"^\s*$")
    no_uri = art.isNotNull() & ~bad_index & ((art["uri"].isNull() & F.col("artifact").isNull()) | (art["uri"].isNotNull() & blank(art["uri"])) | (F.col("artifact").isNotNull() & blank(F.col("artifact.uri"))))
    base_alone = art["uri"].isNull() & art["uriBaseId"].isNotNull()
    kind = F.col("own_kind")
    both = both.withColumn("own_kind", paths.path_kind(art["uri"]))
    absolute = art["uri"].isNotNull() & art["uriBaseId"].isNotNull() & ~kind.isin("RepositoryRelative", "DriveRelative")
    lost = (art["uriBaseId"].isNotNull() & F.col("own.uri").isNull() & art["uri"].isNotNull()) | (F.col("artifact.uriBaseId").isNotNull() & F.col("listed.uri").isNull())
    differ = art["uri"].isNotNull() & F.col("artifact").isNotNull() & (F.col("own_path.canonical_uri") != F.col("listed_path.canonical_uri"))
    no = F.lit(False)
    broken = exprs.any_of([F.coalesce(c, no) for c in (none_art, bad_index, no_uri, base_alone, absolute, lost, differ)])
    both = both.withColumn("broken", broken)
    both = checkpoint(both.withColumn("made", F.when(physical & art.isNotNull() & ~F.col("broken"), F.coalesce("own_path", "listed_path"))))
    path = F.col("made")
    reg = F.col("loc.physicalLocation.region")
    offsets = exprs.any_of([reg[f].isNotNull() for f in ("charOffset", "charLength", "byteOffset", "byteLength")])
    region = exprs.region_valid(reg["startLine"], reg["startColumn"], reg["endLine"], reg["endColumn"])
    bad_region = reg.isNotNull() & region.isNull() & ~(offsets & reg["startLine"].isNull())
    codes = F.when(
        ~F.coalesce(absolute, no),
        F.transform(
            F.concat(F.col("own.codes"), F.col("listed.codes")),
            lambda c: F.struct(F.substring_index(c, ":", 1).alias("code"), F.substring_index(c, ":", -1).alias("severity"), F.lit("The URI base needs attention.").alias("message")),
        ),
    )
    from_path = F.concat(F.coalesce(codes, F.array().cast("array<struct<code:string,severity:string,message:string>>")), F.coalesce(path["diagnostics"], F.array().cast("array<struct<code:string,severity:string,message:string>>")))
    told = F.transform(
        from_path,
        lambda d: F.struct(
            d["code"].alias("code"), d["severity"].alias("severity"), F.lit("canonicalisation").alias("stage"), d["message"].alias("message"), F.col("side").alias("input"),
            F.col("run_index").alias("run_index"), F.col("result_index").alias("result_index"), F.col("pointer").alias("json_pointer"), F.lit(None).cast("string").alias("help"),
        ),
    )
    at = "/physicalLocation/artifactLocation"
    notes = F.concat(
        exprs.keep(
            _note("SCHEMA0120", "warning", "schema", "A physical location has no artifact location.", none_art, at),
            _note("SCHEMA0122", "error", "schema", "The artifact index names no artifact.", bad_index, at + "/index"),
            _note("SCHEMA0121", "error", "schema", "The artifact location has no URI.", no_uri, at),
            _note("SCHEMA0125", "error", "schema", "A URI base needs a URI.", ~bad_index & base_alone & F.col("artifact").isNotNull(), at + "/uriBaseId"),
            _note("SCHEMA0126", "error", "schema", "An absolute URI can have no base.", absolute, at + "/uriBaseId"),
            _note("SCHEMA0124", "error", "schema", "URI and index name different artifacts.", differ, at),
            _note("UNSUPPORTED0101", "warning", "unsupported", "Offsets of a region are not compared.", offsets, "/physicalLocation/region"),
            _note("SCHEMA0123", "error", "schema", "A region's coordinates are invalid.", bad_region, "/physicalLocation/region"),
        ),
        told,
    )
    used = F.transform(
        F.coalesce(F.concat(F.col("own.used"), F.col("listed.used")), F.array().cast("array<string>")),
        lambda u: F.struct(F.lit("configured-uri-base").alias("kind"), u.alias("original"), F.lit(None).cast("string").alias("transformed"), F.lit(False).alias("lossy"), F.lit("findrift/configured-uri-base/v1").alias("algorithm")),
    )
    full = F.when(path.isNotNull(), path.withField("transformations", F.concat(used, path["transformations"])).dropFields("diagnostics"))
    snippet = F.coalesce(reg["snippet"]["text"], reg["snippet"]["markdown"])
    return both.select(*LOC, "pointer", full.alias("path"), F.when(physical, region).alias("region"), snippet.alias("snippet"), notes.alias("notes"))


def _fingerprint_entries() -> Column:
    entries = lambda m, source: F.transform(F.map_entries(m), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("value"), F.lit(source).alias("source")))
    none = F.array().cast("array<struct<name:string,value:string,source:string>>")
    q = F.col("r")
    return F.concat(F.coalesce(entries(q["fingerprints"], "fingerprint"), none), F.coalesce(entries(q["partialFingerprints"], "partial"), none))


def _findings(stay: DataFrame, placed: DataFrame, config: Config) -> DataFrame:
    primary = placed.where("role = 'location' and at = 0").select(*RESULT_ID, F.col("path").alias("p_path"), F.when(F.col("path").isNotNull(), F.col("region")).alias("p_region"), F.when(F.col("path").isNotNull(), F.col("snippet")).alias("p_snippet"))
    rel = placed.where("(role = 'location' and at > 0) or role = 'related'").groupBy(*RESULT_ID).agg(
        F.array_sort(
            F.collect_list(F.struct(exprs.related_key(F.col("path.canonical_uri"), F.col("region")).alias("stable_key"), F.col("path.canonical_uri").alias("canonical_uri"), "region"))
        ).alias("rel")
    )  # the per-result location limit bounds the list
    anchors = placed.where("role = 'flow' and path is not null").groupBy(*RESULT_ID).agg(
        F.array_sort(
            F.collect_set(
                F.struct(F.col("path.canonical_uri").alias("p"), F.when(F.col("snippet").isNotNull(), exprs.vhash("code-flow-context/v1", exprs.line_feeds(F.col("snippet")))).alias("h"))
            )
        ).alias("flow")
    )
    rows = stay.join(primary, RESULT_ID, "left").join(rel, RESULT_ID, "left").join(anchors, RESULT_ID, "left")
    q, rule, family, identity = F.col("r"), F.col("rule"), F.col("producer_family"), F.col("producer_identity")
    alias = _configured_alias(identity, rule, config)
    canonical = F.coalesce(alias, exprs.canonical_rule(family, rule))
    blank = lambda c: c.isNull() | c.rlike(f"^{exprs.SPACE}*$")
    fps = F.transform(
        F.filter(_fingerprint_entries(), lambda e: ~blank(e["name"]) & ~blank(e["value"])),
        lambda e: F.struct(
            exprs.fingerprint_family(e["name"]).alias("family"), (-F.coalesce(exprs.fingerprint_version(e["name"]), F.lit(-1))).alias("down"), e["name"].alias("name"),
            e["value"].alias("value"), e["source"].alias("source"), exprs.fingerprint_version(e["name"]).alias("version"),
        ),
    )
    fingerprints = F.transform(
        F.array_sort(fps),
        lambda e: F.struct(e["name"].alias("name"), e["family"].alias("family"), e["version"].alias("version"), e["value"].alias("value"), F.lit("high").alias("reliability"), e["source"].alias("source")),
    )
    snippet_hash = exprs.context_hash(F.col("p_snippet"))
    context = F.when(
        snippet_hash.isNotNull(),
        F.struct(snippet_hash.alias("snippet_hash"), F.lit(None).cast("string").alias("token_window_hash"), F.col("p_region.start_line").alias("start_line"),
                 F.coalesce("p_region.end_line", "p_region.start_line").alias("end_line")),
    )
    message = exprs.message_struct(F.col("text"))
    lossy = F.filter(F.col("p_path.transformations"), lambda t: t["lossy"])
    lossiness = F.array_sort(
        F.array_distinct(
            F.concat(
                exprs.keep(F.when(F.col("allowlisted"), "producer-family-allowlist"), F.when(q["message"]["text"].isNull() & q["message"]["markdown"].isNotNull(), "message-markdown-fallback")),
                message["flags"], F.coalesce(F.transform(lossy, lambda t: t["kind"]), F.array().cast("array<string>")),
            )
        )
    )
    none = lambda kind: F.array().cast(f"array<{kind}>")
    made = rows.select(
        "case_name", "side", F.concat_ws(":", "side", "run_index", "result_index").alias("finding_key"), "run_index", "result_index", F.col("pointer").alias("json_pointer"),
        F.concat_ws(":", "side", "run_index").alias("run_key"), "tool_name", "tool_version", "producer_family", "producer_identity", rule.alias("original_rule"),
        canonical.alias("canonical_rule"), alias.isNotNull().alias("alias_applied"), F.col("p_path").alias("path"), F.col("p_region").alias("region"),
        F.col("p_snippet").alias("embedded_snippet"), message.alias("message"), F.coalesce(fingerprints, none(FINGERPRINT)).alias("producer_fps"),
        none(DERIVED).alias("derived_fps"), context.cast(CONTEXT).alias("context"),
        F.coalesce(F.transform("rel", lambda x: F.struct(x["canonical_uri"].alias("canonical_uri"), x["region"].alias("region"), x["stable_key"].alias("stable_key"))), none(RELATED)).alias("related"),
        F.coalesce(F.transform("flow", lambda x, i: F.struct(x["p"].alias("canonical_path"), x["h"].alias("context_hash"), i.alias("ordinal"))), none(ANCHOR)).alias("anchors"),
        q["level"].alias("level"), q["kind"].alias("kind"), q["baselineState"].alias("baseline_state"), lossiness.alias("lossiness"),
    )
    return with_derived(made).to(StructType.fromDDL(FINDINGS))


def with_derived(findings: DataFrame, atom: Column | None = None) -> DataFrame:
    """Findings with their derived fingerprints: rule, path and context; and the trusted lexical one where there is an atom."""
    main = exprs.derived_fingerprint(F.col("producer_identity"), F.col("canonical_rule"), F.col("path.repo_relative"), F.col("context.snippet_hash"), F.col("embedded_snippet"))
    named = lambda name, value, alg: F.when(value.isNotNull(), F.struct(F.lit(name).alias("name"), value.alias("value"), F.lit(alg).alias("algorithm")))
    parts = [named("findrift/rule-path-context/v2", main, "rule-path-context/v2")]
    if atom is not None:
        trusted = exprs.trusted_fingerprint(F.col("path.repo_relative"), atom)
        parts.append(named("findrift/trusted-filename-lexical-context/v1", trusted, "trusted-filename-lexical-context/v1"))
    return findings.withColumn("derived_fps", exprs.keep(*parts))


def _configured_alias(identity: Column, rule: Column, config: Config) -> Column:
    """The rule id that a configured alias gives to either of its sides; the first alias of a side counts."""
    out = F.lit(None).cast("string")
    named = [
        (exprs.producer_identity(F.lit(a.baseline_producer)), F.lit(a.baseline_rule), exprs.producer_identity(F.lit(a.candidate_producer)), F.lit(a.candidate_rule))
        for a in sorted(config.rule_aliases, key=lambda a: (a.baseline_producer, a.baseline_rule, a.candidate_producer, a.candidate_rule))
    ]
    for b_id, b_rule, c_id, c_rule in reversed(named):
        hit = ((identity == b_id) & (rule == b_rule)) | ((identity == c_id) & (rule == c_rule))
        out = F.when(hit, exprs.alias_rule_id(b_id, b_rule, c_id, c_rule)).otherwise(out)
    return out


# Run summaries: facts of the raw log, before any gate.


def run_summaries(heads: DataFrame, results: DataFrame) -> DataFrame:
    """One row per run: counts, maxima (0 where there is nothing) and predicate counts."""
    r, q = F.col("run"), F.col("r")
    tags = lambda rules: F.coalesce(F.array_max(F.transform(rules, lambda x: _size(x["properties"]["tags"]))), F.lit(0))
    ext = F.coalesce(r["tool"]["extensions"], F.array().cast(wire.ddl([wire.COMPONENT])))
    ext_rules = F.aggregate(ext, F.lit(0), lambda n, e: n + F.greatest(_size(e["rules"]), F.lit(0)))
    run_facts = heads.select(
        *RUN_ID, _size(r["tool"]["driver"]["rules"]).alias("driver_rules"), ext_rules.alias("extension_rules"), F.size(ext).alias("extensions"),
        F.greatest(tags(r["tool"]["driver"]["rules"]), F.coalesce(F.array_max(F.transform(ext, lambda e: tags(e["rules"]))), F.lit(0))).alias("max_tags"),
        _size(r["invocations"]).alias("invocations"), F.get(r["invocations"], F.lit(0))["workingDirectory"]["uri"].alias("working_directory"),
        F.size(F.filter(F.slice(F.coalesce(r["invocations"], F.array().cast(wire.ddl(wire.RUN["invocations"]))), 2, 1 << 30), lambda i: i["workingDirectory"]["uri"].rlike(r"\S"))).alias("later_directories"),
    )
    uri = F.get(q["locations"], F.lit(0))["physicalLocation"]["artifactLocation"]["uri"]
    kind = paths.path_kind(uri)
    hashed = F.exists(F.map_keys(q["partialFingerprints"]), lambda k: (k == "primaryLocationLineHash") | F.startswith(k, F.lit("primaryLocationLineHash/v")))
    facts = results.join(run_facts.select(*RUN_ID, "working_directory"), RUN_ID, "left").withColumn("uri", uri).withColumn("uri_kind", kind)
    root = F.regexp_replace(F.regexp_replace("working_directory", "[?#].*$", ""), "(?<!/)$", "/")
    root_kind = paths.path_kind(F.col("working_directory"))
    rooted = root_kind.isin("FileUri", "ExternalUri")
    scheme = lambda c: F.lower(F.substring_index(c, ":", 1))
    absolute = F.col("uri_kind").isin("FileUri", "ExternalUri")
    same = scheme(F.col("uri")) == scheme(F.col("working_directory"))
    inside = F.startswith(F.col("uri"), root)
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    per_run = facts.groupBy(*RUN_ID).agg(
        F.count("*").alias("results"), F.max(F.greatest(_size(q["locations"]), F.lit(0))).alias("max_locations"), F.max(thread_flow_locations(q)).alias("max_flow_locations"),
        F.max(F.greatest(_size(q["partialFingerprints"]), F.lit(0))).alias("max_partial_fingerprints"), count(F.size(q["locations"]) > 1).alias("multiple_locations"),
        F.count_if(~F.coalesce(hashed, F.lit(False))).alias("without_line_hash"), count(F.col("uri").isNotNull() & (F.col("uri_kind") != "RepositoryRelative")).alias("non_repository"),
        F.count_if(~F.coalesce(F.col("uri").rlike(r"\S"), F.lit(False))).alias("without_location"), count(absolute).alias("absolute_uris"),
        count(F.col("uri_kind").isin("PosixAbsolute", "DriveAbsolute", "RootRelative", "Unc", "Device", "DeviceUnc")).alias("absolute_paths"),
        count(absolute & rooted & same & inside).alias("convertible"), count(absolute & rooted & same & ~inside).alias("outside_root"), count(absolute & rooted & ~same).alias("scheme_mismatches"),
    )
    directory = (
        F.when(~F.coalesce(F.col("working_directory").rlike(r"\S"), F.lit(False)), "missing").when(rooted, "absolute-uri").when(root_kind == "RepositoryRelative", "relative-reference")
        .when(root_kind == "DriveRelative", "invalid").otherwise("absolute-path")
    )
    numbers = [c for c in per_run.columns if c not in RUN_ID]
    return (
        run_facts.withColumn("rules", F.col("driver_rules") + F.col("extension_rules")).withColumn("directory_kind", directory)
        .join(per_run, RUN_ID, "left").select(*[c for c in run_facts.columns], "rules", "directory_kind", *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in numbers])
    )


def ignored_properties(heads: DataFrame, results: DataFrame) -> DataFrame:
    """How often a run uses properties outside the code-scanning subset: run, property, n."""
    r, q = F.col("run"), F.col("r")
    automation = r["automationDetails"]["id"]
    of_run = F.array_compact(
        F.array(
            F.when(r["graphs"].isNotNull(), "run.graphs"), F.when(r["artifacts"].isNotNull(), "run.artifacts"),
            F.when(automation.rlike("/[^/]+$"), "automationDetails.id.runId"),
        )
    )
    empty = F.array().cast("array<string>")

    def place(x: Column) -> Column:
        reg = x["physicalLocation"]["region"]
        offsets = exprs.any_of([reg[f].isNotNull() for f in ("charOffset", "charLength", "byteOffset", "byteLength")])
        return F.filter(
            F.array(
                F.when(x["message"]["markdown"].isNotNull(), "location.message.markdown"), F.when(x["logicalLocations"].isNotNull(), "location.logicalLocations"),
                F.when(x["physicalLocation"]["artifactLocation"]["index"].isNotNull(), "artifactLocation.index"), F.when(reg["snippet"].isNotNull(), "region.snippet"),
                F.when(offsets, "region.offsets"),
            ),
            lambda s: s.isNotNull(),
        )

    places = lambda a: F.coalesce(F.flatten(F.transform(a, place)), empty)
    flow = F.coalesce(
        F.flatten(F.transform(q["codeFlows"], lambda f: F.flatten(F.transform(f["threadFlows"], lambda t: F.flatten(F.transform(t["locations"], lambda x: place(x["location"]))))))), empty
    )
    own = F.array_compact(
        F.array(
            *[F.when(q[m].isNotNull(), f"result.{m}") for m in ("fingerprints", "kind", "baselineState", "logicalLocations", "stacks", "suppressions", "attachments")],
            F.when(q["message"]["markdown"].isNotNull(), "result.message.markdown"),
        )
    )
    a = heads.select(*RUN_ID, F.explode(of_run).alias("property"))
    b = results.select(*RUN_ID, F.explode(F.concat(own, places(q["locations"]), places(q["relatedLocations"]), flow)).alias("property"))
    return a.unionByName(b).groupBy(*RUN_ID, "property").agg(F.count("*").alias("n"))
