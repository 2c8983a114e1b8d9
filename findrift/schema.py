"""Tables of the engine: canonical findings, wire logs, and the names of their enumerations."""

from __future__ import annotations

REGION = "struct<start_line:int,start_column:int,end_line:int,end_column:int>"
TRANSFORM = "struct<kind:string,original:string,transformed:string,lossy:boolean,algorithm:string>"
PATH = f"struct<original:string,resolved:string,canonical_uri:string,repo_relative:string,kind:string,transformations:array<{TRANSFORM}>>"
MESSAGE = "struct<original:string,canonical:string,comparison:string,flags:array<string>>"
FINGERPRINT = "struct<name:string,family:string,version:int,value:string,reliability:string,source:string>"
DERIVED = "struct<name:string,value:string,algorithm:string>"
CONTEXT = "struct<snippet_hash:string,token_window_hash:string,start_line:int,end_line:int>"
RELATED = f"struct<canonical_uri:string,region:{REGION},stable_key:string>"
ANCHOR = "struct<canonical_path:string,context_hash:string,ordinal:int>"
DIAGNOSTIC = "struct<code:string,severity:string,stage:string,message:string,input:string,run_index:int,result_index:int,json_pointer:string,help:string>"

#: One row per finding of one side of one case.
FINDINGS = (
    "case_name string, side string, finding_key string, run_index int, result_index int, json_pointer string, run_key string, "
    "tool_name string, tool_version string, producer_family string, producer_identity string, "
    f"original_rule string, canonical_rule string, alias_applied boolean, path {PATH}, region {REGION}, embedded_snippet string, "
    f"message {MESSAGE}, producer_fps array<{FINGERPRINT}>, derived_fps array<{DERIVED}>, context {CONTEXT}, "
    f"related array<{RELATED}>, anchors array<{ANCHOR}>, level string, kind string, baseline_state string, lossiness array<string>"
)

BASELINE, CANDIDATE = "baseline", "candidate"
TIERS = ("refuse", "weak-contextual", "path-problem", "strong-moved", "exact-canonical", "exact-producer", "override")
REFUSE, WEAK, PATH_PROBLEM, STRONG_MOVED, EXACT_CANONICAL, EXACT_PRODUCER, OVERRIDE = range(7)
PATH_MATCH = ("none", "aliased", "exact")
AGREEMENT = ("none", "compatible", "exact")
CLASSES = ("new", "unchanged", "moved", "modified", "resolved", "ambiguous")
STAGES = (
    "io", "parse", "schema", "unsupported", "canonicalisation", "repository", "fingerprint", "match", "github-compat", "security", "report", "internal",
)

#: The comparable fields of an edge, in the order that ranks them.
VECTOR = ("tier", "fp_strength", "path_match", "context_agreement", "codeflow_agreement", "message_agreement", "region_band")
VECTOR_TYPE = "struct<" + ",".join(f"{c}:int" for c in VECTOR) + ">"
