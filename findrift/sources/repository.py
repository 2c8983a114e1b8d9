"""Source files as evidence: only the files that findings name, opened inside an approved root.

The wanted (path, region) pairs are distinct rows, sorted by path, so a task opens each file once and holds
one at a time.  Every part of a path is opened below its parent without following links, so no name can
lead outside the root.  The root must be a folder that all workers see.
"""

from __future__ import annotations

import errno
import hashlib
import json
import os
import re
import stat
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findrift.config import Config, Limits
from findrift.functions import context, exprs
from findrift.schema import CONTEXT, DIAGNOSTIC
from findrift.sources import sarif, wire

NOTES = {
    "IO0001": ("note", "repository", "The file does not exist in the repository."),
    "IO0002": ("error", "repository", "The file could not be read."),
    "IO0003": ("error", "repository", "Reading the file was not permitted."),
    "IO0004": ("error", "repository", "The file is no strict UTF-8."),
    "SECURITY0001": ("error", "security", "The path leaves the approved root."),
    "SECURITY0002": ("error", "security", "The path holds a symbolic link."),
    "SECURITY0003": ("error", "security", "The file exceeds the limit of repository files."),
    "SECURITY0005": ("error", "security", "The path names no regular file."),
    "SECURITY0008": ("error", "security", "The snapshot's manifest does not admit the path."),
    "SECURITY0009": ("error", "security", "The file differs from the snapshot's manifest."),
    "CANON0010": ("warning", "repository", "The region starts behind the file's last line."),
    "CANON0011": ("warning", "canonicalisation", "The region has more terms than a token window may hold; the window is left out."),
    "CANON0012": ("warning", "canonicalisation", "A term is too long; the token window is left out."),
}
_PATH = re.compile(r"(?!.*(?:^|/)\.{1,2}(?:/|$))[\x21-\x2e\x30-\x39\x3b-\x5b\x5d-\x7e][\x20-\x2e\x30-\x39\x3b-\x5b\x5d-\x7e]*(?:/[\x20-\x2e\x30-\x39\x3b-\x5b\x5d-\x7e]+)*")
_DIGEST = re.compile(r"[0-9a-f]{64}")


class BadManifest(ValueError):
    """A manifest that can't be used; ``code`` names the reason."""

    def __init__(self, code: str, message: str) -> None:
        super().__init__(message)
        self.code = code


@dataclass(frozen=True)
class Root:
    """An approved folder; with a manifest only the files that it names, by their digests, are evidence."""

    path: str
    manifest: Mapping[str, str] | None = field(default=None, hash=False)


def canonical_relative(path: str) -> bool:
    """A plain ASCII path below a root: no empty, dot or parent part, no colon, no backslash."""
    return bool(_PATH.fullmatch(path))


def read_manifest(raw: bytes, limits: Limits = Limits()) -> dict[str, str]:  # noqa: B008
    """A snapshot manifest: canonical relative paths and their SHA-256, every path once."""
    if len(raw) > limits.maximum_input_bytes:
        raise BadManifest("SECURITY0007", "the manifest exceeds the input limit")

    def members(pairs: list[tuple[str, object]]) -> dict:
        out = dict(pairs)
        if len(out) != len(pairs):
            raise BadManifest("SCHEMA0021", "the manifest gives a member or path twice")
        return out

    try:
        data = json.loads(raw.decode("utf-8"), object_pairs_hook=members, parse_constant=wire._constant)
    except BadManifest:
        raise
    except (ValueError, RecursionError):
        raise BadManifest("PARSE0020", "the manifest is no valid JSON") from None
    if not isinstance(data, dict):
        raise BadManifest("PARSE0020", "the manifest must be an object")
    if data.keys() - {"schemaVersion", "files"} or data.get("schemaVersion") != "1" or "files" not in data:
        raise BadManifest("SCHEMA0020", "the manifest has schemaVersion '1' and files, nothing else")
    files = data["files"]
    if not isinstance(files, dict) or not all(isinstance(v, str) for v in files.values()):
        raise BadManifest("PARSE0020", "files must map paths to digests")
    if len(files) > limits.maximum_run_collection_items or any(len(x) > limits.maximum_string_characters for kv in files.items() for x in kv):
        raise BadManifest("SCHEMA0024", "the manifest exceeds the limit of items or characters")
    for path, digest in files.items():
        if not canonical_relative(path):
            raise BadManifest("SCHEMA0022", "a path of the manifest is not canonical")
        if not _DIGEST.fullmatch(digest):
            raise BadManifest("SCHEMA0023", "a digest of the manifest is not 64 lowercase hexadecimal digits")
    return files


def read_manifest_file(path: str, limits: Limits = Limits()) -> dict[str, str]:  # noqa: B008
    """The manifest in a regular file with a full path."""
    if not os.path.isabs(path):
        raise BadManifest("SECURITY0006", "the manifest's path must be a full one")
    raw, code = open_inside(os.path.dirname(path), os.path.basename(path), limits.maximum_input_bytes)
    if raw is None:
        raise BadManifest({"SECURITY0003": "SECURITY0007", "IO0001": "IO0005", "IO0002": "IO0006", "IO0003": "IO0007"}.get(code, "SECURITY0006"), "the manifest can't be read")
    return read_manifest(raw, limits)


def tree_manifest(files: DataFrame) -> DataFrame:
    """One row for a set of files (path, content): how many, and the SHA-256 over their sorted paths and digests.

    The lines ``digest  path`` are one text, so the files of one tree must number fewer than fit a row; the
    manifest's own item limit is far below that.
    """
    line = F.concat(F.sha2("content", 256), F.lit("  "), F.col("path"), F.lit("\n"))
    rows = files.select(exprs.ordinal(F.col("path")).alias("k"), line.alias("line"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]), "")
    return rows.agg(F.count("*").alias("n_files"), F.sha2(text.cast("binary"), 256).alias("tree_sha256"))


def open_inside(root: str, relative: str, limit: int) -> tuple[bytes | None, str | None]:
    """(content, None) of a regular file below ``root``, or (None, refusal code)."""
    parts = relative.replace("\\", "/").split("/")
    if not relative or relative[0] in "/\\" or "\0" in relative or ".." in parts or re.match(r"[A-Za-z]:", relative):
        return None, "SECURITY0001"
    parts = [p for p in parts if p not in ("", ".")]
    opened: list[int] = []
    try:
        opened.append(os.open(root, os.O_RDONLY | os.O_DIRECTORY))
        for i, part in enumerate(parts):
            kind = os.stat(part, dir_fd=opened[-1], follow_symlinks=False).st_mode
            if stat.S_ISLNK(kind):
                return None, "SECURITY0002"
            if i < len(parts) - 1:
                if not stat.S_ISDIR(kind):
                    return None, "IO0001"
                opened.append(os.open(part, os.O_RDONLY | os.O_DIRECTORY | os.O_NOFOLLOW, dir_fd=opened[-1]))
            elif not stat.S_ISREG(kind):
                return None, "SECURITY0005"
            else:
                opened.append(os.open(part, os.O_RDONLY | os.O_NOFOLLOW, dir_fd=opened[-1]))
        if not parts:
            return None, "SECURITY0005"
        with os.fdopen(os.dup(opened[-1]), "rb") as f:
            raw = f.read(limit + 1)
        return (None, "SECURITY0003") if len(raw) > limit else (raw, None)
    except FileNotFoundError:
        return None, "IO0001"
    except PermissionError:
        return None, "IO0003"
    except OSError as e:
        return None, "SECURITY0002" if e.errno == errno.ELOOP else "IO0002"
    finally:
        for fd in reversed(opened):
            os.close(fd)


def source_text(root: Root, relative: str, limits: Limits) -> tuple[str | None, str | None]:
    """(text with line feeds, None) of a file, or (None, refusal code)."""
    expected = None
    if root.manifest is not None:
        expected = root.manifest.get(relative) if canonical_relative(relative) else None
        if expected is None:
            return None, "SECURITY0008"
    raw, code = open_inside(root.path, relative, limits.maximum_repository_file_bytes)
    if raw is None:
        return None, code
    if expected is not None and hashlib.sha256(raw).hexdigest() != expected:
        return None, "SECURITY0009"
    try:
        return raw.decode("utf-8-sig").replace("\r\n", "\n").replace("\r", "\n"), None
    except UnicodeDecodeError:
        return None, "IO0004"


EVIDENCE = "side string, path string, start int, end int, found boolean, snippet string, snippet_hash string, window_hash string, first int, last int, atom string, codes array<string>"


def evidence_of(root: Root, path: str, text: str | None, code: str | None, start: int | None, end: int | None, config: Config, atoms) -> tuple:
    """(found, snippet, snippet hash, window hash, first and last line, lexical atom, codes) of one region."""
    none = (None,) * 6
    if text is None:
        return False, *none, [code]
    if start is None:
        return True, *none, []
    lines = text.split("\n")
    if start > len(lines):
        return True, *none, ["CANON0010"]
    radius = config.snippet_lines_radius
    stop = start if end is None else max(end, start)
    first, last = max(1, start - radius), min(len(lines), stop + radius)
    shown = "\n".join(lines[first - 1 : last])
    if root.manifest is not None:
        atom = atoms()[start - 1][0] if end is None or end == start else None
        return True, shown, None, None, first, last, atom, []
    window, codes = None, []
    if config.enable_token_windows:
        window, refusal = context.token_window(text, start, min(stop, len(lines)), config.limits.maximum_token_window_terms)
        codes = [refusal] if refusal else []
    return True, shown, context.vhash("source-context/v1", shown), window, first, last, None, codes


def evidence(findings: DataFrame, roots: Mapping[str, Root], config: Config) -> DataFrame:
    """Evidence of every (side, path, region) that findings name and a root exists for; see ``EVIDENCE``."""
    wanted = (
        findings.where(F.col("path.repo_relative").isNotNull() & F.col("side").isin(list(roots)))
        .select("side", F.col("path.repo_relative").alias("path"), F.col("region.start_line").alias("start"), F.col("region.end_line").alias("end"))
        .distinct()
    )
    sides = dict(roots)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: tuple | None = None
        text = code = made = None
        for frame in frames:
            out = []
            for side, path, start, end in frame.astype(object).where(frame.notna(), None).itertuples(index=False):
                if held != (side, path):
                    held, made = (side, path), None
                    text, code = source_text(sides[side], path, config.limits)

                def atoms():
                    nonlocal made
                    made = context.lexical_atoms(text) if made is None else made
                    return made

                region = (None if start is None else int(start), None if end is None else int(end))
                out.append((side, path, *region, *evidence_of(sides[side], path, text, code, *region, config, atoms)))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in EVIDENCE.split(", ")]).astype({c: "Int32" for c in ("start", "end", "first", "last")})

    return wanted.repartition("side", "path").sortWithinPartitions("side", "path", "start", "end").mapInPandas(run, EVIDENCE)


def with_repository(findings: DataFrame, roots: Mapping[str, Root], config: Config = Config()) -> tuple[DataFrame, DataFrame]:  # noqa: B008
    """(findings with repository context and derived fingerprints, diagnostics of what could not be used).

    A finding whose region has evidence takes its context from the file; all others keep their own.
    """
    none = findings.sparkSession.createDataFrame([], f"case_name string, d {DIAGNOSTIC}").select("case_name", "d.*")
    if not roots or not config.enable_repo_context:
        return findings, none
    e = evidence(findings, roots, config).select(*[F.col(x.split()[0]).alias(f"e_{x.split()[0]}") for x in EVIDENCE.split(", ")])
    same = (
        (F.col("side") == F.col("e_side")) & (F.col("path.repo_relative") == F.col("e_path"))
        & F.col("region.start_line").eqNullSafe(F.col("e_start")) & F.col("region.end_line").eqNullSafe(F.col("e_end"))
    )
    joined = findings.join(e, same, "left")
    own = F.struct(F.col("e_snippet_hash").alias("snippet_hash"), F.col("e_window_hash").alias("token_window_hash"), F.col("e_first").alias("start_line"), F.col("e_last").alias("end_line")).cast(CONTEXT)
    placed = joined.withColumn("context", F.when(F.col("e_first").isNotNull(), own).otherwise(F.col("context")))
    done = sarif.with_derived(placed, F.col("e_atom")).select(*findings.columns)
    table = F.create_map(*[x for k, (s, g, m) in NOTES.items() for x in (F.lit(k), F.struct(F.lit(s).alias("severity"), F.lit(g).alias("stage"), F.lit(m).alias("message")))])
    noted = joined.select("case_name", "side", "run_index", "result_index", "json_pointer", F.explode("e_codes").alias("code")).withColumn("n", F.try_element_at(table, F.col("code")))
    made = F.struct(
        "code", F.col("n.severity"), F.col("n.stage"), F.col("n.message"), F.col("side").alias("input"), "run_index", "result_index", "json_pointer", F.lit(None).cast("string").alias("help")
    ).cast(DIAGNOSTIC)
    return done, noted.select("case_name", made.alias("d")).select("case_name", "d.*")
