"""Paths and URIs without a host: lexical kinds, canonical forms, rebases, base chains."""

from __future__ import annotations

import re
from collections.abc import Sequence
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .exprs import ascii_lower, complete_prefix, keep

ALGORITHM = "cross-platform-path/v1"
KINDS = (
    "Unknown", "RepositoryRelative", "DriveAbsolute", "DriveRelative", "RootRelative", "Unc", "Device", "DeviceUnc", "PosixAbsolute",
    "FileUri", "ExternalUri",
)
SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"


def path_kind(c: Column) -> Column:
    """The lexical kind of a path or URI; the first rule that fits wins."""
    return (
        F.when(c.isNull() | (c == ""), "Unknown")
        .when(c.rlike(r"^(?i:\\\\\?\\UNC\\|//\?/UNC/)"), "DeviceUnc")
        .when(c.rlike(r"^(?:\\\\\?\\|//\?/)"), "Device")
        .when(c.rlike(r"^(?:\\\\|//)"), "Unc")
        .when(c.rlike("^(?i:file:)"), "FileUri")
        .when(c.rlike(r"^[A-Za-z]:[/\\]"), "DriveAbsolute")
        .when(c.rlike("^[A-Za-z]:"), "DriveRelative")
        .when(c.rlike(SCHEME), "ExternalUri")
        .when(F.startswith(c, F.lit("\\")), "RootRelative")
        .when(F.startswith(c, F.lit("/")), "PosixAbsolute")
        .otherwise("RepositoryRelative")
    )


def slashes(c: Column) -> Column:
    return F.translate(c, "\\", "/")


def trim_end(c: Column) -> Column:
    return F.regexp_replace(c, "/+$", "")


def needs_collapse(c: Column) -> Column:
    """Empty segments, dot segments, back slashes or a trailing slash: anything to tidy."""
    return (F.length(c) > 0) & (c.rlike(r"\\|(?:^|/)\.{0,2}(?:/|$)"))


def collapse_segments(c: Column) -> Column:
    """struct<ok, path>: dot segments resolved from the root; not ok where they climb above it."""
    parts = F.filter(F.split(slashes(c), "/"), lambda s: (s != "") & (s != "."))

    def step(acc: Column, s: Column) -> Column:
        up = s == ".."
        stack = F.when(up, F.slice(acc["stack"], 1, F.greatest(F.size(acc["stack"]) - 1, F.lit(0)))).otherwise(F.concat(acc["stack"], F.array(s)))
        return F.struct((acc["ok"] & ~(up & (F.size(acc["stack"]) == 0))).alias("ok"), stack.alias("stack"))

    start = F.struct(F.lit(True).alias("ok"), F.array().cast("array<string>").alias("stack"))
    done = F.aggregate(parts, start, step)
    plain = F.struct(F.lit(True).alias("ok"), c.alias("path"))
    collapsed = F.struct(done["ok"].alias("ok"), F.when(done["ok"], F.array_join(done["stack"], "/")).otherwise(c).alias("path"))
    return F.when(needs_collapse(c), collapsed).otherwise(plain)


def absolute_segments(c: Column) -> Column:
    """Segments tidied, a leading slash kept; unchanged where they climb above the root."""
    done = collapse_segments(c)
    return F.when(~done["ok"], c).when(F.startswith(c, F.lit("/")), F.concat(F.lit("/"), F.regexp_replace(done["path"], "^/+", ""))).otherwise(done["path"])


_ESCAPE = re.compile(r"%([0-9A-Fa-f]{2})")
_UNRESERVED = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-._~")


def decode_unreserved(s: str) -> str:
    """Percent escapes of unreserved characters decoded, in one pass from the left."""
    return _ESCAPE.sub(lambda m: chr(b) if (b := int(m[1], 16)) in _UNRESERVED else m[0], s)


@F.pandas_udf(StringType())
def percent_decode(s: pd.Series) -> pd.Series:
    return s.map(decode_unreserved, na_action="ignore")


def decode_if_needed(c: Column) -> Column:
    """``percent_decode`` where the value has an escape at all."""
    return F.when(F.contains(c, F.lit("%")), percent_decode(c)).otherwise(c)


def encode_uri_body(s: str) -> str | None:
    """Percent-encoded UTF-8 but for unreserved characters, slashes, colons and valid escapes; null for lone surrogates."""
    out, at = [], 0
    for m in _ESCAPE.finditer(s):
        out += [_quote(s[at : m.start()]), m[0].upper()]
        at = m.end()
    out.append(_quote(s[at:]))
    return None if None in out else "".join(out)


def _quote(s: str) -> str | None:
    try:
        return "".join(chr(b) if b in _UNRESERVED or b in b"/:" else f"%{b:02X}" for b in s.encode("utf-8"))
    except UnicodeEncodeError:
        return None


@F.pandas_udf(StringType())
def uri_encode(s: pd.Series) -> pd.Series:
    return s.map(encode_uri_body, na_action="ignore")


def file_location(c: Column) -> Column:
    """A path, or a file URI's path, with forward slashes and no trailing one."""
    flat = slashes(c)
    bare = F.regexp_replace(flat, "^(?i:file:)", "")
    bare = F.when(F.startswith(bare, F.lit("///")), F.substring(bare, F.lit(3), F.length(bare))).otherwise(F.regexp_replace(bare, "^(?i://localhost)(?=/)", ""))
    bare = F.regexp_replace(bare, "^/(?=[A-Za-z]:)", "")
    return trim_end(F.when(flat.rlike("^(?i:file:)"), bare).otherwise(flat))


def reserved_name(c: Column) -> Column:
    """True where a segment is a reserved Windows device name, extension aside."""
    bad = r"(?i)^(?:CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])(?:\.|$)"
    return F.exists(F.split(file_location(c), "/"), lambda s: F.regexp_replace(s, r"[ .]+$", "").rlike(bad))


def rebase_longest(value: Column, rebases: Sequence[tuple[str, str]]) -> Column:
    """The value under the longest configured prefix's target; of equal prefixes the first counts."""
    out = value
    first: dict[str, str] = {}
    for source, target in rebases:
        first.setdefault(source, target)
    for source in sorted(first, key=len):  # the longest test ends up outermost
        rest = F.substring(value, F.lit(len(source) + 1), F.length(value))
        out = F.when(complete_prefix(value, F.lit(source)), F.concat(F.lit(first[source]), rest)).otherwise(out)
    return out


def _change(kind: str, before: Column, after: Column, lossy: bool, when: Column | None = None) -> Column:
    changed = ~before.eqNullSafe(after) if when is None else when & ~before.eqNullSafe(after)
    return F.when(
        changed,
        F.struct(F.lit(kind).alias("kind"), before.alias("original"), after.alias("transformed"), F.lit(lossy).alias("lossy"), F.lit(ALGORITHM).alias("algorithm")),
    )


def _diagnostic(code: str, severity: str, message: str, when: Column) -> Column:
    return F.when(when, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(message).alias("message")))


def canonicalise(
    df: DataFrame,
    original: str,
    resolved: str | None = None,
    out: str = "canonical",
    *,
    root: str | None = None,
    rebases: Sequence[tuple[str, str]] = (),
    fold: bool = False,
) -> DataFrame:
    """``df`` with the canonical form of the path column ``original`` as a struct column ``out``.

    Fields: original, resolved, canonical_uri, repo_relative, kind, transformations, diagnostics.  The
    steps: configured rebase, safe percent decoding, repository-relative or external form, separators,
    segments, optional ASCII case folding.  Each step is a column of its own, so the plan stays as
    small as the steps are.  A null path gives null.
    """
    pre, n = f"_{out}_", [0]

    def put(value: Column) -> Column:
        nonlocal df
        n[0] += 1
        df = df.withColumn(f"{pre}{n[0]}", value)
        return F.col(f"{pre}{n[0]}")

    source = F.col(original)
    logical = put(F.coalesce(F.col(resolved), source) if resolved else source)
    rebased = put(rebase_longest(logical, rebases))
    decoded = put(decode_if_needed(rebased))
    kind, logical_kind = put(path_kind(source)), put(path_kind(decoded))

    repo_scheme = put(decoded.rlike("^(?i:repo:/)"))
    bare = F.regexp_replace(F.substring(decoded, F.lit(7), F.length(decoded)), r"^[/\\]+", "")
    relative = logical_kind == "RepositoryRelative"
    inside, below = F.lit(False), F.lit(None).cast("string")
    if root is not None and root.strip():
        plain = "." if root == "." else re.sub("/+$", "", _file_location(root))
        comparable = put(file_location(decoded))
        seen, top = (ascii_lower(comparable), plain.translate(_FOLD)) if fold else (comparable, plain)
        same = trim_end(seen) == top
        inside = same | F.startswith(seen, F.lit(top + "/"))
        below = F.when(same, "").otherwise(F.substring(seen, F.lit(len(top) + 2), F.length(seen)))
    in_repo = put(F.coalesce(repo_scheme | relative | inside, F.lit(False)))
    start = put(F.when(repo_scheme, bare).when(relative, decoded).otherwise(below))

    flat = put(F.regexp_replace(slashes(start), "^/+", ""))
    done = put(collapse_segments(flat))
    ok = done["ok"]
    folded = put(ascii_lower(done["path"]) if fold else done["path"])
    repo_uri = F.when(ok, F.concat(F.lit("repo://"), folded)).otherwise(F.concat(F.lit("unresolved://repository/"), flat))

    blank = put(decoded.rlike(r"^\s*$"))
    normal = put(slashes(decoded))
    stripped = (
        F.when(logical_kind == "Unc", F.regexp_replace(normal, "^/+", ""))
        .when(logical_kind == "DeviceUnc", F.regexp_replace(normal, r"^(?i://\?/UNC/)", ""))
        .when(logical_kind == "Device", F.regexp_replace(normal, r"^//\?/", ""))
        .otherwise(normal)
    )
    location = put(file_location(normal))
    drive = put(location.rlike("^[A-Za-z]:"))
    file_body = (
        F.when(drive, location)
        .when(F.startswith(location, F.lit("//")), F.regexp_replace(location, "^/+", ""))
        .when(F.startswith(location, F.lit("/")), location)
        .otherwise(F.concat(F.lit("/"), location))
    )
    body = put(F.when(logical_kind == "FileUri", file_body).otherwise(stripped))
    tidy = put(absolute_segments(body))
    file_uri = put(F.concat(F.when(drive, "file:///").otherwise("file://"), tidy))
    prefixes = {"DriveAbsolute": "win-drive://", "RootRelative": "win-root://", "Unc": "unc://", "DeviceUnc": "win-device-unc://", "Device": "win-device://", "PosixAbsolute": "file://"}
    external = F.when(blank, "unresolved://empty")
    for name, prefix in prefixes.items():
        external = external.when(logical_kind == name, F.concat(F.lit(prefix), tidy))
    external = (
        external.when(logical_kind == "DriveRelative", F.concat(F.lit("win-drive-relative://"), normal))
        .when(logical_kind == "FileUri", file_uri)
        .when(logical_kind == "ExternalUri", normal)
        .otherwise("unresolved://empty")
    )
    outside = ~in_repo & ~blank
    tidied = logical_kind.isin("FileUri", *prefixes)
    transforms = keep(
        _change("configured-path-rebase", logical, rebased, False),
        _change("safe-percent-decode", rebased, decoded, True),
        _change("canonical-separators", F.when(in_repo, start).otherwise(decoded), F.when(in_repo, flat).otherwise(normal), True, in_repo | outside),
        _change("collapsed-rooted-segments", flat, done["path"], True, in_repo & ok),
        _change("configured-ascii-case-fold", done["path"], folded, True, in_repo & ok),
        _change("collapsed-absolute-segments", body, tidy, True, outside & tidied),
        _change("canonical-file-uri", normal, file_uri, True, outside & (logical_kind == "FileUri")),
    )
    windows = kind.isin("DriveAbsolute", "DriveRelative", "RootRelative", "Unc", "Device", "DeviceUnc", "FileUri")
    notes = keep(
        _diagnostic("CANON0005", "warning", "A path holds a null character and is kept as text.", F.contains(source, F.lit("\0"))),
        _diagnostic("CANON0004", "warning", "A path holds a reserved Windows name and is kept as it is.", windows & reserved_name(source)),
        _diagnostic("CANON0001", "error", "A path climbs above the repository root.", in_repo & ~ok),
        _diagnostic("CANON0002", "warning", "A path names the repository root, not an artifact.", in_repo & ok & (folded == "")),
        _diagnostic("CANON0003", "error", "An artifact location is empty.", ~in_repo & blank),
    )
    made = F.struct(
        source.alias("original"), decoded.alias("resolved"), F.when(in_repo, repo_uri).otherwise(external).alias("canonical_uri"),
        F.when(in_repo & ok, folded).alias("repo_relative"), kind.alias("kind"), transforms.alias("transformations"), notes.alias("diagnostics"),
    )
    return df.withColumn(out, F.when(source.isNotNull(), made)).drop(*[f"{pre}{i + 1}" for i in range(n[0])])


_FOLD = {c: c + 32 for c in range(65, 91)}


def _file_location(s: str) -> str:
    s = s.replace("\\", "/")
    if s[:5].lower() != "file:":
        return s.rstrip("/")
    s = s[5:]
    if s.startswith("///"):
        s = s[2:]
    elif s[:12].lower() == "//localhost/":
        s = s[11:]
    if re.match("/[A-Za-z]:", s):
        s = s[1:]
    return s.rstrip("/")


# URI-base chains: few per run, resolved in plain Python.


def kind_of(s: str | None) -> str:
    """``path_kind`` for one string."""
    if not s:
        return "Unknown"
    low = s.lower()
    if low.startswith(("\\\\?\\unc\\", "//?/unc/")):
        return "DeviceUnc"
    if s.startswith(("\\\\?\\", "//?/")):
        return "Device"
    if s.startswith(("\\\\", "//")):
        return "Unc"
    if low.startswith("file:"):
        return "FileUri"
    if re.match("[A-Za-z]:", s):
        return "DriveAbsolute" if s[2:3] in ("/", "\\") and len(s) > 2 else "DriveRelative"
    if re.match(SCHEME, s):
        return "ExternalUri"
    return "RootRelative" if s[0] == "\\" else "PosixAbsolute" if s[0] == "/" else "RepositoryRelative"


def combine_uri(base: str, child: str, limit: int = 4 << 20) -> str | None:
    """A child under its base: absolute children win; null beyond the string limit."""
    if kind_of(child) not in ("RepositoryRelative", "DriveRelative", "Unknown"):
        return child if len(child) <= limit else None
    if len(base) + len(child) + 1 > limit:
        return None
    parts = urlsplit(base)
    if len(parts.scheme) > 1 and (parts.netloc or parts.path.startswith("/")):
        return urljoin(base, child) if parts.scheme in ("http", "https", "file", "ftp") else base.rsplit("/", 1)[0] + "/" + child
    return base.rstrip("/\\") + "/" + child.lstrip("/\\")


UNSAFE = re.compile(r"[\x00-\x1f\x7f?#]")


def _climbs(s: str) -> bool:
    return ".." in re.split(r"[/\\]", decode_unreserved(re.sub("%2[Ff]|%5[Cc]", "/", s)))


def safe_root(uri: str) -> bool:
    """A configured base may only end in a local root: repo:/, a file URI without host, or a local absolute path."""
    if not uri or UNSAFE.search(uri) or _climbs(uri):
        return False
    if uri.lower().startswith("repo:/"):
        return True
    kind = kind_of(uri)
    if kind == "FileUri":
        return urlsplit(uri.replace("\\", "/")).netloc.lower() in ("", "localhost")
    return kind in ("PosixAbsolute", "DriveAbsolute")


def safe_relative(uri: str) -> bool:
    return bool(uri) and not UNSAFE.search(uri) and not _climbs(uri) and kind_of(uri) == "RepositoryRelative"


def resolve_base(
    base_id: str, child: str, defined: dict[str, dict | None], configured: dict[str, dict], max_depth: int = 32
) -> tuple[str | None, list[tuple[str, str]], list[str]]:
    """(resolved URI or null, diagnostics (code, severity), configured ids used) of a child under a base chain."""
    notes: list[tuple[str, str]] = []
    used: list[str] = []
    legs: list[str] = []

    def fail(code: str) -> None:
        notes.append((code, "error"))

    def walk(name: str, seen: frozenset[str], depth: int) -> str | None:
        if depth >= max_depth:
            return fail("CANON0030")
        if name in seen:
            return fail("CANON0031")
        own = name in defined
        entry = defined[name] if own else configured.get(name)
        if entry is None or not (entry.get("uri") or "").strip():
            return fail("CANON0032")
        uri, parent = entry["uri"], entry.get("uriBaseId")
        if not own and not (safe_root(uri) if parent is None else safe_relative(uri)):
            return fail("CANON0032")
        whole: str | None = uri
        if parent is not None:
            above = walk(parent, seen | {name}, depth + 1)
            if above is None:
                return None
            whole = combine_uri(above, uri)
            if whole is None:
                return fail("SECURITY0103")
        if not own:
            used.append(name)
            notes.append(("CANON0033", "note"))
        legs.append(uri)
        return whole

    root = walk(base_id, frozenset(), 0)
    if root is None:
        return None, notes, used
    if used:
        if not safe_root(root) or not safe_root(legs[0]) or not all(map(safe_relative, legs[1:])) or _climbs(child):
            fail("CANON0032")
            return None, notes, used
    combined = combine_uri(root, child)
    if combined is None:
        fail("SECURITY0103")
    return combined, notes, used
