"""Limits, aliases, rebases and policy of a comparison, read from JSON and checked."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields, replace
from pathlib import Path

from findrift.functions import paths


@dataclass(frozen=True)
class Limits:
    """Hard bounds on untrusted input; configuration may only lower them."""

    maximum_input_bytes: int = 256 << 20
    maximum_json_depth: int = 128
    maximum_runs: int = 64
    maximum_run_collection_items: int = 250_000
    maximum_locations_per_result: int = 1_000
    maximum_code_flows_per_result: int = 100
    maximum_thread_flow_locations_per_result: int = 10_000
    maximum_string_characters: int = 4 << 20
    maximum_uri_base_depth: int = 32
    maximum_repository_file_bytes: int = 4 << 20
    maximum_snippet_radius: int = 20
    maximum_token_window_terms: int = 256
    maximum_candidate_edges_per_finding: int = 64
    maximum_candidate_pair_evaluations_per_finding: int = 256
    maximum_candidate_pair_evaluations: int = 1_000_000
    maximum_rejected_alternatives: int = 100
    maximum_assignment_side_size: int = 12


@dataclass(frozen=True)
class RuleAlias:
    baseline_producer: str
    baseline_rule: str
    candidate_producer: str
    candidate_rule: str


@dataclass(frozen=True)
class Config:
    uri_bases: tuple[dict, ...] = ()
    path_rebases: tuple[tuple[str, str], ...] = ()
    path_aliases: tuple[tuple[str, str], ...] = ()
    rule_aliases: tuple[RuleAlias, ...] = ()
    enable_repo_context: bool = True
    snippet_lines_radius: int = 3
    enable_token_windows: bool = False
    allow_weak_message_similarity: bool = False
    fold_paths: bool = False
    fail_on: tuple[str, ...] = ("new", "modified", "ambiguous")
    treat_github_incompatibility_as_error: bool = False
    repository_root: str | None = None
    limits: Limits = field(default_factory=Limits)

    def ordered_path_aliases(self) -> list[tuple[str, str]]:
        """Longest baseline prefix first, then ordinal order; the first of equal pairs counts."""
        return sorted(dict.fromkeys(a for a in self.path_aliases if all(a)), key=lambda a: (-len(a[0]), _units(a[0]), -len(a[1]), _units(a[1])))

    def rebases(self) -> list[tuple[str, str]]:
        return sorted(self.path_rebases, key=lambda r: (-len(r[0]), _units(r[0]), _units(r[1])))


def _units(s: str) -> bytes:
    return s.encode("utf-16-be", "surrogatepass")


@dataclass(frozen=True)
class ConfigNote:
    code: str
    severity: str
    message: str
    pointer: str


_SECTIONS = {
    "": {"schemaVersion", "uriBaseMappings", "pathRebases", "pathAliases", "ruleAliases", "matching", "policy", "limits", "reporting"},
    "uriBaseMappings": {"id", "uri", "uriBaseId"},
    "pathRebases": {"from", "to"},
    "pathAliases": {"baseline", "candidate"},
    "ruleAliases": {"baselineProducer", "baselineRule", "candidateProducer", "candidateRule"},
    "matching": {"enableRepoContext", "snippetLinesRadius", "enableTokenWindows", "allowWeakMessageSimilarity", "pathCaseSensitivity"},
    "policy": {"failOn", "treatGithubIncompatibilityAsError"},
    "reporting": {"emitHtml", "emitSarif"},
}
CLASS_NAMES = frozenset({"new", "unchanged", "moved", "modified", "resolved", "ambiguous"})


def _camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(x.capitalize() for x in rest)


def read_config(text: str | bytes | None, limits: Limits = Limits()) -> tuple[Config | None, list[ConfigNote]]:  # noqa: B008
    """A configuration and what was noted; null where an error was."""
    notes: list[ConfigNote] = []

    def note(code: str, message: str, pointer: str = "", severity: str = "error") -> None:
        notes.append(ConfigNote(code, severity, message, pointer))

    if text is None:
        return Config(limits=limits), notes
    raw = text.encode() if isinstance(text, str) else text
    if len(raw) > limits.maximum_input_bytes:
        note("SECURITY0010", "The configuration exceeds the input limit.")
        return None, notes
    try:
        data = json.loads(raw.decode("utf-8-sig"), object_pairs_hook=_unique)
    except (ValueError, RecursionError) as e:
        note("PARSE0001", f"The configuration is no valid JSON: {type(e).__name__}.")
        return None, notes
    if not isinstance(data, dict):
        note("SCHEMA0001", "The configuration must be an object.")
        return None, notes
    if data.get("schemaVersion") != "1":
        note("SCHEMA0002", 'The configuration schemaVersion must be "1".', "/schemaVersion")

    def unknown(section: str, item: dict, pointer: str) -> None:
        known = {_camel(f.name) for f in fields(Limits)} if section == "limits" else _SECTIONS[section]
        for k in sorted(set(item) - known):
            note("UNSUPPORTED0001", f"Unknown property '{k}' is ignored.", f"{pointer}/{k}", "warning")

    unknown("", data, "")

    def rows(section: str, required: tuple[str, ...]) -> list[dict]:
        out = []
        for i, item in enumerate(data.get(section) or []):
            pointer = f"/{section}/{i}"
            if not isinstance(item, dict):
                note("SCHEMA0009", "An entry cannot be null.", pointer)
                continue
            unknown(section, item, pointer)
            if any(not isinstance(item.get(k), str) or not item[k].strip() for k in required):
                note("SCHEMA0009", "A required value is missing.", pointer)
                continue
            out.append(item)
        return out

    bases = rows("uriBaseMappings", ("id", "uri"))
    seen: dict[str, dict] = {}
    for b in bases:
        if b["id"] in seen and seen[b["id"]] != b:
            note("SCHEMA0011", "A URI base is mapped twice.", "/uriBaseMappings")
        seen.setdefault(b["id"], b)
        safe = paths.safe_root(b["uri"]) if b.get("uriBaseId") is None else paths.safe_relative(b["uri"])
        if not safe:
            note("SCHEMA0012", "A URI base has an unsafe target.", "/uriBaseMappings")
    rebases = [(r["from"], r["to"]) for r in rows("pathRebases", ("from", "to"))]
    if len({a for a, _ in rebases}) != len(set(rebases)):
        note("SCHEMA0003", "One prefix is rebased to two targets.", "/pathRebases")
    path_aliases = [(r["baseline"], r["candidate"]) for r in rows("pathAliases", ("baseline", "candidate"))]
    aliases = [
        RuleAlias(r["baselineProducer"], r["baselineRule"], r["candidateProducer"], r["candidateRule"])
        for r in rows("ruleAliases", ("baselineProducer", "baselineRule", "candidateProducer", "candidateRule"))
    ]
    left = [(a.baseline_producer, a.baseline_rule) for a in set(aliases)]
    if len(left) != len(set(left)):
        note("SCHEMA0004", "One baseline rule has two aliases.", "/ruleAliases")

    matching = data.get("matching") or {}
    unknown("matching", matching, "/matching")
    radius = matching.get("snippetLinesRadius", 3)
    if not isinstance(radius, int) or not 0 <= radius <= limits.maximum_snippet_radius:
        note("SCHEMA0005", "The snippet radius is out of range.", "/matching/snippetLinesRadius")
        radius = 3
    case = matching.get("pathCaseSensitivity", "sensitive")
    if case not in ("sensitive", "ascii-insensitive"):
        note("SCHEMA0006", "Unknown path case sensitivity.", "/matching/pathCaseSensitivity")
    policy = data.get("policy") or {}
    unknown("policy", policy, "/policy")
    fail_on = policy.get("failOn", ["new", "modified", "ambiguous"])
    if not isinstance(fail_on, list) or set(fail_on) - CLASS_NAMES:
        note("SCHEMA0007", "Unknown classification in failOn.", "/policy/failOn")
        fail_on = []
    lowered: dict[str, int] = {}
    given = data.get("limits") or {}
    unknown("limits", given, "/limits")
    for f in fields(Limits):
        if (value := given.get(_camel(f.name))) is None:
            continue
        top = getattr(limits, f.name)
        if not isinstance(value, int) or isinstance(value, bool) or value <= 0:
            note("SCHEMA0008", "A limit must be a positive number.", f"/limits/{_camel(f.name)}")
        elif value > top:
            note("SECURITY0013", "A limit may only be lowered.", f"/limits/{_camel(f.name)}")
        else:
            lowered[f.name] = value
    if any(n.severity == "error" for n in notes):
        return None, notes
    return (
        Config(
            uri_bases=tuple(seen.values()), path_rebases=tuple(rebases), path_aliases=tuple(path_aliases), rule_aliases=tuple(dict.fromkeys(aliases)),
            enable_repo_context=matching.get("enableRepoContext", True), snippet_lines_radius=radius,
            enable_token_windows=matching.get("enableTokenWindows", False), allow_weak_message_similarity=matching.get("allowWeakMessageSimilarity", False),
            fold_paths=case == "ascii-insensitive", fail_on=tuple(fail_on),
            treat_github_incompatibility_as_error=policy.get("treatGithubIncompatibilityAsError", False), limits=replace(limits, **lowered),
        ),
        notes,
    )


def _unique(pairs: list[tuple[str, object]]) -> dict:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise ValueError("a member is given twice")
    return out


def read_config_file(path: str | None, limits: Limits = Limits()) -> tuple[Config | None, list[ConfigNote]]:  # noqa: B008
    if path is None:
        return read_config(None, limits)
    try:
        return read_config(Path(path).read_bytes(), limits)
    except OSError:
        return None, [ConfigNote("IO0010", "error", "The configuration can't be read.", "")]
