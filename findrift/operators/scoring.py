"""Pairwise evidence, the tier decision list and explanation records, as column expressions.

A pair is two struct columns, ``b`` and ``c``: findings that carry their repeated evidence (see
``occurrence.with_occurrences``).  The vector is computed first for every pair; explanations are
made only for the edges that are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findrift.config import Config
from findrift.functions.exprs import any_of, ascii_lower, bounded, complete_prefix, is_bounded, keep, made_once, region_text, vhash, vhash_list
from findrift.operators.occurrence import count_of
from findrift.schema import EXACT_CANONICAL, EXACT_PRODUCER, OVERRIDE, REFUSE, STRONG_MOVED, VECTOR, WEAK

MATCHER = "findrift/matcher/v1"
RULE, RULE_ALIAS = "findrift/rule-identity/v1", "findrift/rule-alias/v1"
FINGERPRINT, DERIVED = "findrift/producer-fingerprint-common-version/v1", "findrift/derived-fingerprint/v1"
PATH, PATH_ALIAS, CONTEXT = "findrift/path-evidence/v1", "findrift/path-alias/v1", "findrift/context-evidence/v1"
OCCURRENCE, MESSAGE, TEMPLATE = "findrift/evidence-occurrence/v1", "findrift/message-evidence/v1", "findrift/message-location-template/v1"
REGION, ANCHOR, FLOW = "findrift/region-evidence/v1", "findrift/code-flow-anchor/v1", "findrift/code-flow-set/v1"
FLOW_OCCURRENCE, RELATED, OUTCOME = "findrift/code-flow-occurrence/v1", "findrift/related-location-set/v1", "findrift/assignment-outcome/v1"

EVIDENCE = "struct<kind:string,baseline:string,candidate:string,origin:string,tier:int,lossy:boolean,algorithm:string>"


def _at(version: Column) -> Column:
    return version


def fp_matches(b: Column, c: Column) -> Column:
    """Equal producer fingerprints at each family's greatest common version: array<struct<rank, family, version, value>>.

    rank -2: reliable and unique on both sides; -1: degraded.  A version below the greatest common one never counts.
    """

    def versions(fps: Column, family: Column) -> Column:
        return F.transform(F.filter(fps, lambda z: (z["family"] == family) & z["version"].isNotNull()), lambda z: z["version"])

    def hot(repeats: Column, x: Column) -> Column:
        return F.exists(repeats, lambda z: (z["family"] == x["family"]) & z["version"].eqNullSafe(x["version"]) & (z["value"] == x["value"]))

    def unique(side: Column, x: Column) -> Column:
        return (x["reliability"] == "high") & ~hot(side["fp_repeats"], x)

    def top(x: Column) -> Column:
        return F.array_max(F.array_intersect(versions(b["producer_fps"], x["family"]), versions(c["producer_fps"], x["family"])))

    def equal(x: Column, y: Column) -> Column:
        return (x["family"] == y["family"]) & x["version"].eqNullSafe(y["version"]) & (x["value"] == y["value"])

    hits = F.filter(b["producer_fps"], lambda x: x["version"].eqNullSafe(top(x)) & F.exists(c["producer_fps"], lambda y: equal(x, y)))
    ranked = F.transform(
        hits,
        lambda x: F.struct(
            F.when(unique(b, x) & F.exists(c["producer_fps"], lambda y: equal(x, y) & unique(c, y)), -2).otherwise(-1).alias("rank"),
            x["family"].alias("family"), x["version"].alias("version"), x["value"].alias("value"),
        ),
    )
    return F.coalesce(F.array_sort(ranked), F.array().cast("array<struct<rank:int,family:string,version:int,value:string>>"))


def fp_strength(matches: Column) -> Column:
    return F.coalesce(-F.get(matches, F.lit(0))["rank"], F.lit(0))


def derived_matches(b: Column, c: Column) -> Column:
    """Equal derived fingerprints, unique ones first: array<struct<dup, name, algorithm, value, n_b, n_c>>."""
    shared = F.filter(b["derived_fps"], lambda x: F.exists(c["derived_fps"], lambda y: (x["name"] == y["name"]) & (x["algorithm"] == y["algorithm"]) & (x["value"] == y["value"])))

    def row(x: Column) -> Column:
        n_b = count_of(b["repeats"], "derived", x["value"], x["name"], x["algorithm"])
        n_c = count_of(c["repeats"], "derived", x["value"], x["name"], x["algorithm"])
        dup = F.when((n_b == 1) & (n_c == 1), 0).otherwise(1)
        return F.struct(dup.alias("dup"), x["name"].alias("name"), x["algorithm"].alias("algorithm"), x["value"].alias("value"), n_b.alias("n_b"), n_c.alias("n_c"))

    none = F.array().cast("array<struct<dup:int,name:string,algorithm:string,value:string,n_b:bigint,n_c:bigint>>")
    return F.coalesce(F.array_sort(F.transform(shared, row)), none)


def path_alias(b: Column, c: Column, config: Config) -> Column:
    """The first configured alias under which both paths end alike, as struct<baseline, candidate>; null without one."""
    found = F.lit(None).cast("struct<baseline:string,candidate:string>")
    for left, right in reversed(config.ordered_path_aliases()):

        def pair(x: Column, y: Column, left: str = left, right: str = right) -> Column:
            rest_x, rest_y = F.substring(x, F.lit(len(left) + 1), F.length(x)), F.substring(y, F.lit(len(right) + 1), F.length(y))
            same = ascii_lower(rest_x) == ascii_lower(rest_y) if config.fold_paths else rest_x == rest_y
            return F.coalesce(complete_prefix(x, F.lit(left), config.fold_paths) & complete_prefix(y, F.lit(right), config.fold_paths) & same, F.lit(False))

        hit = pair(b["path"]["repo_relative"], c["path"]["repo_relative"]) | pair(b["path"]["canonical_uri"], c["path"]["canonical_uri"])
        found = F.when(hit, F.struct(F.lit(left).alias("baseline"), F.lit(right).alias("candidate"))).otherwise(found)
    return found


def path_match(b: Column, c: Column, alias: Column, fold: bool) -> Column:
    """0 none, 1 aliased, 2 exact."""
    x, y = b["path"]["canonical_uri"], c["path"]["canonical_uri"]
    same = ascii_lower(x) == ascii_lower(y) if fold else x == y
    return F.when(x.isNull() | y.isNull(), 0).when(same, 2).when(alias.isNotNull(), 1).otherwise(0)


def context_channel(b: Column, c: Column, field: str, kind: str) -> Column:
    """struct<unique, collided, conflict> of one hash channel; all false where a side has none."""
    x, y = b["context"][field], c["context"][field]
    both, same = x.isNotNull() & y.isNotNull(), x == y
    n_b, n_c = count_of(b["repeats"], kind, x), count_of(c["repeats"], kind, y)
    once = (n_b == 1) & (n_c == 1)
    no = F.lit(False)
    return F.struct(
        F.coalesce(both & same & once, no).alias("unique"), F.coalesce(both & same & ~once, no).alias("collided"),
        F.coalesce(both & ~same, no).alias("conflict"), n_b.alias("n_b"), n_c.alias("n_c"),
    )


def anchor_set(side: Column, fold: bool) -> Column:
    """Distinct anchors as structs (path, context hash)."""
    one = lambda x: F.struct((ascii_lower(x["canonical_path"]) if fold else x["canonical_path"]).alias("path"), x["context_hash"].alias("hash"))
    return F.coalesce(F.array_distinct(F.transform(side["anchors"], one)), F.array().cast("array<struct<path:string,hash:string>>"))


def reliable_anchors(side: Column, anchors: Column) -> Column:
    return F.filter(anchors, lambda x: count_of(side["repeats"], "anchor", x["hash"], x["path"]) == 1)


def same_set(a: Column, b: Column) -> Column:
    return (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)


def codeflow_agreement(b: Column, c: Column, fold: bool) -> Column:
    """0 none, 1 compatible, 2 exact; only anchors that occur in one finding of either side count."""
    x, y = anchor_set(b, fold), anchor_set(c, fold)
    rx, ry = reliable_anchors(b, x), reliable_anchors(c, y)
    shared = F.size(F.array_intersect(rx, ry))
    return F.when(shared == 0, 0).when(same_set(rx, ry), 2).otherwise(1)


def message_agreement(b: Column, c: Column) -> Column:
    """2: equal canonical texts; 1: equal comparison texts; else 0."""
    return F.when(b["message"]["canonical"] == c["message"]["canonical"], 2).when(b["message"]["comparison"] == c["message"]["comparison"], 1).otherwise(0)


def region_band(b: Column, c: Column) -> Column:
    """3 equal, 2 within three lines, 1 both there, else 0."""
    x, y = b["region"], c["region"]
    near = F.abs(x["start_line"].cast("long") - y["start_line"].cast("long")) <= 3
    return F.when(x.isNull() | y.isNull(), 0).when(x.eqNullSafe(y), 3).when(near, 2).otherwise(1)


def tier(alias: Column, strength: Column, unique: Column, collided: Column, path: Column, ctx: Column, message: Column, allow_weak: bool) -> Column:
    """struct<tier, collision>: the decision list, the first rule that fits wins."""
    conflicts = ctx["conflict"] & (collided | ctx["collided"])
    dup_derived = collided & (path != 0) & ~conflicts
    dup_context = ctx["collided"] & ~conflicts & ((path == 1) | ((path == 2) & (message >= 1)))
    weak = F.lit(allow_weak) & ~conflicts & (message >= 1) & ((path == 2) | (ctx["agreement"] >= 1))
    collision = ~alias & (strength < 2) & ~unique & ~ctx["reliable"] & (dup_derived | dup_context)
    level = (
        F.when(alias, F.when((path != 0) & ctx["reliable"], OVERRIDE).otherwise(REFUSE))
        .when(strength == 2, EXACT_PRODUCER)
        .when((path == 2) & unique, EXACT_CANONICAL)
        .when(unique | ctx["reliable"], STRONG_MOVED)
        .when(dup_derived | dup_context, WEAK)
        .when(weak, WEAK)
        .otherwise(REFUSE)
    )
    return F.struct(level.cast("int").alias("tier"), collision.alias("collision"))


def context_summary(snippet: Column, tokens: Column) -> Column:
    unique, collided, conflict = (snippet[f] | tokens[f] for f in ("unique", "collided", "conflict"))
    agreement = F.when(unique & ~conflict, 2).when(unique | collided, 1).otherwise(0)
    return F.struct(agreement.alias("agreement"), (agreement == 2).alias("reliable"), collided.alias("collided"), conflict.alias("conflict"))


def marks(allow_weak: bool) -> Column:
    """Hashes of a finding's evidence: every pair that isn't refused has one in common.

    Each tier but refusal needs an equal fingerprint, derived fingerprint or context, or, where weak similarity
    counts, an equal message; equal hashes prove nothing, ``score`` decides.
    """
    one = lambda kind, *x: F.xxhash64(F.lit(kind), *x)
    none = F.array().cast("array<bigint>")
    fps = F.transform("producer_fps", lambda x: one("fp", x["family"], x["version"], x["value"]))
    derived = F.transform("derived_fps", lambda x: one("derived", x["name"], x["algorithm"], x["value"]))
    fields = ["context.snippet_hash", "context.token_window_hash", *(["message.canonical", "message.comparison"] if allow_weak else [])]
    rest = F.array_compact(F.array(*[F.when(F.col(f).isNotNull(), one(f, F.col(f))) for f in fields]))
    return F.concat(F.coalesce(fps, none), F.coalesce(derived, none), rest)


def score(pairs: DataFrame, config: Config) -> DataFrame:
    """Edges: pairs (case_name, b, c, aliases) with their vector; refused pairs are gone.

    ``aliases`` is the array of rule aliases that link the pair, empty for the default rule.
    """
    b, c = F.col("b"), F.col("c")
    fold = config.fold_paths
    stages = (
        pairs.withColumn("fp_hits", fp_matches(b, c))
        .withColumn("derived_hits", derived_matches(b, c))
        .withColumn("path_alias", path_alias(b, c, config))
        .withColumn("snippet", context_channel(b, c, "snippet_hash", "context-snippet"))
        .withColumn("tokens", context_channel(b, c, "token_window_hash", "context-token-window"))
        .withColumn("ctx", context_summary(F.col("snippet"), F.col("tokens")))
        .withColumn("fp_strength", fp_strength(F.col("fp_hits")).cast("int"))
        .withColumn("path_match", path_match(b, c, F.col("path_alias"), fold))
        .withColumn("context_agreement", F.col("ctx.agreement"))
        .withColumn("codeflow_agreement", codeflow_agreement(b, c, fold))
        .withColumn("message_agreement", message_agreement(b, c))
    )
    top = F.get("derived_hits", F.lit(0))
    unique, collided = F.coalesce(top["dup"] == 0, F.lit(False)), F.coalesce(top["dup"] == 1, F.lit(False))
    chosen = tier(F.size("aliases") > 0, F.col("fp_strength"), unique, collided, F.col("path_match"), F.col("ctx"), F.col("message_agreement"), config.allow_weak_message_similarity)
    tiered = stages.withColumn("choice", chosen).where(F.col("choice.tier") != REFUSE)
    band = F.when(F.col("choice.collision"), 0).otherwise(region_band(b, c))
    vector = F.struct(*[x.cast("int").alias(n) for n, x in zip(VECTOR, [F.col("choice.tier"), *[F.col(n) for n in VECTOR[1:-1]], band], strict=True)])
    return tiered.withColumn("vector", vector)


# Explanations of the edges that are kept.


def evidence(kind: str, x: Column, y: Column, origin: str, tier_: Column, lossy: Column, algorithm: str) -> Column:
    return F.struct(
        F.lit(kind).alias("kind"), bounded(x, algorithm).alias("baseline"), bounded(y, algorithm).alias("candidate"), F.lit(origin).alias("origin"),
        tier_.cast("int").alias("tier"), (lossy | is_bounded(x) | is_bounded(y)).alias("lossy"), F.lit(algorithm).alias("algorithm"),
    )


def derived_text(x: Column, n: Column) -> Column:
    return F.concat(x["name"], F.lit("/"), x["algorithm"], F.lit(":"), x["value"], F.lit(":occurrences="), n.cast("string"))


def occurrence_text(kind: str, value: Column, n: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), value, F.lit(":occurrences="), n.cast("string"))


def anchor_value(x: Column) -> Column:
    return vhash(ANCHOR, x["path"], x["hash"])


def collision_summary(side: Column, anchors: Column) -> Column:
    """How many shared anchors repeat, and the first of them with its count."""
    ordered = F.array_sort(F.transform(anchors, lambda x: F.struct(anchor_value(x).alias("v"), count_of(side["repeats"], "anchor", x["hash"], x["path"]).alias("n"))))
    first = F.get(ordered, F.lit(0))
    return F.concat(F.lit("shared-collisions="), F.size(anchors).cast("string"), F.lit(";first="), first["v"], F.lit(":occurrences="), first["n"].cast("string"))


@made_once
def edge_evidence(config: Config) -> Column:
    """All evidence of a scored edge (columns of ``score``), in report order."""
    b, c, t = F.col("b"), F.col("c"), F.col("vector.tier")
    no = F.lit(False)
    fold = config.fold_paths
    fp = F.get("fp_hits", F.lit(0))
    label = F.concat(fp["family"], F.coalesce(F.concat(F.lit("/v"), fp["version"].cast("string")), F.lit("")), F.lit(":"), fp["value"])
    d = F.get("derived_hits", F.lit(0))
    named = F.concat(d["name"], F.lit(":"), d["value"])
    bp, cp = b["path"], c["path"]
    lossy_path = F.exists(bp["transformations"], lambda x: x["lossy"]) | F.exists(cp["transformations"], lambda x: x["lossy"])
    x, y = anchor_set(b, fold), anchor_set(c, fold)
    shared = F.array_intersect(x, y)
    loose = F.array_except(shared, F.array_intersect(reliable_anchors(b, shared), reliable_anchors(c, shared)))
    flow = lambda s: vhash_list(FLOW, F.array_sort(F.transform(s, anchor_value)))
    norm = (lambda v: ascii_lower(v)) if fold else (lambda v: v)

    def uris(side: Column) -> Column:
        return F.array_sort(F.array_distinct(F.transform(F.filter(side["related"], lambda r: r["canonical_uri"].isNotNull()), lambda r: norm(r["canonical_uri"]))))

    def channel(name: str, kind: str, field: str) -> list[Column]:
        s, bx, cy = F.col(name), b["context"][field], c["context"][field]
        return [
            F.when(s["collided"], evidence("context-collision", occurrence_text(kind, bx, s["n_b"]), occurrence_text(kind, cy, s["n_c"]), "system", t, no, OCCURRENCE)),
            F.when(bx.isNotNull() & cy.isNotNull(), evidence(kind, bx, cy, "repository", t, no, CONTEXT)),
        ]

    records = keep(
        F.when(F.size("aliases") == 0, evidence("rule-identity", b["canonical_rule"], c["canonical_rule"], "system", t, no, RULE)),
        F.when(F.col("fp_strength") > 0, evidence("producer-fingerprint", label, label, "producer", t, no, FINGERPRINT)),
        F.when(d.isNotNull(), evidence("derived-fingerprint", named, named, "system", t, no, DERIVED)),
        F.when(d["dup"] == 1, evidence("derived-fingerprint-collision", derived_text(d, d["n_b"]), derived_text(d, d["n_c"]), "system", t, no, OCCURRENCE)),
        F.when(
            bp.isNotNull() & cp.isNotNull(),
            F.when(F.col("path_match") == 1, evidence("path-alias", F.col("path_alias.baseline"), F.col("path_alias.candidate"), "configuration", t, no, PATH_ALIAS)).otherwise(
                evidence("canonical-path", bp["canonical_uri"], cp["canonical_uri"], "system", t, F.coalesce(lossy_path, no), PATH)
            ),
        ),
        *channel("snippet", "context-snippet", "snippet_hash"),
        *channel("tokens", "context-token-window", "token_window_hash"),
        evidence("message", b["message"]["canonical"], c["message"]["canonical"], "system", t, (F.size(b["message"]["flags"]) > 0) | (F.size(c["message"]["flags"]) > 0), MESSAGE),
        F.when(F.size(loose) > 0, evidence("code-flow-anchor-collision", collision_summary(b, loose), collision_summary(c, loose), "system", t, F.lit(True), FLOW_OCCURRENCE)),
        F.when(F.size(shared) > 0, evidence("code-flow", flow(x), flow(y), "system", t, no, FLOW)),
        F.when(F.coalesce(F.arrays_overlap(uris(b), uris(c)), no), evidence("related-location-paths", vhash_list(RELATED, uris(b)), vhash_list(RELATED, uris(c)), "system", t, no, RELATED)),
        F.when(b["region"].isNotNull() & c["region"].isNotNull(), evidence("region", region_text(b["region"]), region_text(c["region"]), "system", t, no, REGION)),
    )
    aliased = F.transform(
        "aliases",
        lambda a: evidence("rule-alias", F.concat(a["b_producer"], F.lit(":"), a["b_rule"]), F.concat(a["c_producer"], F.lit(":"), a["c_rule"]), "configuration", t, no, RULE_ALIAS),
    )
    return order_evidence(F.concat(records, aliased))


def order_evidence(records: Column) -> Column:
    """Distinct evidence by kind, values (nulls first), origin, tier, algorithm and loss."""
    rank = F.create_map(*[x for i, o in enumerate(("producer", "repository", "configuration", "system")) for x in (F.lit(o), F.lit(i))])
    keyed = F.transform(
        F.array_distinct(records),
        lambda r: F.struct(r["kind"].alias("k"), r["baseline"].alias("x"), r["candidate"].alias("y"), F.try_element_at(rank, r["origin"]).alias("o"),
                           r["tier"].alias("t"), r["algorithm"].alias("a"), r["lossy"].alias("l"), r.alias("r")),
    )
    return F.transform(F.sort_array(keyed), lambda k: k["r"])


def degradation_evidence(side: str, finding: Column, fold: bool) -> Column:
    """A finding's own repeated evidence, told once whatever it was paired with."""
    no = F.lit(None).cast("string")

    def record(kind: str, value: Column, lossy: bool, algorithm: str) -> Column:
        x, y = (value, no) if side == "baseline" else (no, value)
        return evidence(kind, x, y, "system", F.lit(REFUSE), F.lit(lossy), algorithm)

    contexts = F.filter(finding["repeats"], lambda r: F.startswith(r["kind"], F.lit("context-")))
    deriveds = F.filter(finding["repeats"], lambda r: r["kind"] == "derived")
    told = F.concat(
        F.transform(contexts, lambda r: record("context-collision", F.concat(r["kind"], F.lit(":"), r["value"], F.lit(":occurrences="), r["n"].cast("string")), False, OCCURRENCE)),
        F.transform(deriveds, lambda r: record("derived-fingerprint-collision", derived_text(r, r["n"]), False, OCCURRENCE)),
    )
    hot = F.filter(anchor_set(finding, fold), lambda x: count_of(finding["repeats"], "anchor", x["hash"], x["path"]) > 1)
    flows = F.when(F.size(hot) > 0, F.array(record("code-flow-anchor-collision", collision_summary(finding, hot), True, FLOW_OCCURRENCE)))
    return F.coalesce(F.concat(told, F.coalesce(flows, F.array().cast(f"array<{EVIDENCE}>"))), F.array().cast(f"array<{EVIDENCE}>"))


def path_tokens(path: Column) -> Column:
    """A repository path as written with either separator."""
    other = F.when(F.contains(path, F.lit("/")), F.translate(path, "/", "\\")).otherwise(F.translate(path, "\\", "/"))
    return F.array_distinct(F.array(path, other))


_LEFT = r"(?:^|[\s\"'`(\[{<=:])$"
_RIGHT = r"^(?:$|[\s\"'`)\]}>]|[.,;:?!](?:$|[\s\"'`)\]}>]))"


def _split_once(message: Column, token: Column) -> Column:
    """struct<prefix, suffix> around the only, delimited occurrence of a token; else null."""
    at = F.instr(message, token)
    prefix, suffix = F.substring(message, F.lit(1), at - 1), F.substring(message, at + F.length(token), F.length(message))
    once = (F.length(token) > 0) & (at > 0) & (F.instr(suffix, token) == 0)
    return F.when(once & prefix.rlike(_LEFT) & suffix.rlike(_RIGHT), F.struct(prefix.alias("prefix"), suffix.alias("suffix")))


def template_transform(b: Column, c: Column, message: Column, path: Column) -> Column:
    """Where a message differs only by its own aliased path: the transformation that says so; else null."""
    bp, cp = b["path"]["repo_relative"], c["path"]["repo_relative"]
    bm, cm = b["message"]["canonical"], c["message"]["canonical"]
    halves = lambda m, p: F.filter(F.transform(path_tokens(p), lambda tok: _split_once(m, tok)), lambda s: s.isNotNull())
    combos = F.flatten(F.transform(halves(bm, bp), lambda s: F.filter(halves(cm, cp), lambda r: r == s)))
    hit = F.get(combos, F.lit(0))
    ok = (message == 0) & (path == 1) & bp.isNotNull() & cp.isNotNull() & (bp != cp) & (F.size(combos) == 1)
    return F.when(
        ok,
        F.struct(
            F.lit("classification-message-location-template").alias("kind"),
            F.concat(F.lit("sha256:"), vhash(TEMPLATE, F.lit("message-pair"), bm, cm)).alias("original"),
            F.concat(F.lit("sha256:"), vhash(TEMPLATE, F.lit("shared-template"), hit["prefix"], hit["suffix"])).alias("transformed"),
            F.lit(True).alias("lossy"), F.lit(TEMPLATE).alias("algorithm"),
        ),
    )


def classify(b: Column, c: Column, vector: Column, template: Column, fold: bool) -> Column:
    """modified, moved or unchanged."""
    conflict = lambda f: F.coalesce(b["context"][f] != c["context"][f], F.lit(False))
    message = (vector["message_agreement"] == 0) & template.isNull()
    x, y = anchor_set(b, fold), anchor_set(c, fold)
    flow = (F.size(x) > 0) & (F.size(y) > 0) & ~same_set(x, y)
    one_sided = b["path"].isNull() != c["path"].isNull()
    both = b["path"].isNotNull() & c["path"].isNotNull()
    moved = one_sided | (both & (vector["path_match"] != 2)) | ~b["region"].eqNullSafe(c["region"])
    return F.when(any_of([message, conflict("snippet_hash"), conflict("token_window_hash"), flow]), "modified").when(moved, "moved").otherwise("unchanged")


def confidence(tier_: Column) -> Column:
    return F.when(tier_ >= STRONG_MOVED, "high").when(tier_ == 2, "medium").otherwise("low")
