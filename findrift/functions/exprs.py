"""Scalar canonical forms as column expressions; everything here stays in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space of the canonical message form, as a regular-expression class.
SPACE = r"[\x09-\x0D\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: The same signs as a string, and runs of them that aren't a single blank already.
SPACES = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
UNEVEN = f"{SPACE.replace(chr(92) + 'x20', '')}{SPACE}*+| {SPACE}++"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Longest evidence value that is kept as it is, in UTF-16 units.
INLINE_UNITS = 512


def made_once(f):
    """Keeps the columns that ``f`` makes, by its arguments: they name columns and hold for any table.

    Large expressions take thousands of calls into the JVM; a session makes each once.
    """
    made: dict = {}

    def get(*args):
        try:
            key = (id(SparkContext._active_spark_context), *args)
            if key not in made:
                made[key] = f(*args)
            return made[key]
        except TypeError:  # arguments that don't hash
            return f(*args)

    return get


def ordinal(c: Column) -> Column:
    """A sort key in UTF-16 code-unit order, which differs from UTF-8's for astral characters."""
    return F.encode(c, "UTF-16BE")


def units(c: Column) -> Column:
    """The length of a string in UTF-16 code units."""
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int")


def _framed(c: Column) -> Column:
    raw = c.cast("binary")
    size = F.unhex(F.lpad(F.hex(F.octet_length(raw)), 8, "0"))
    return F.coalesce(F.concat(size, raw), F.unhex(F.lit("FFFFFFFF")))


def vhash(algorithm: str | Column, *fields: Column) -> Column:
    """SHA-256 over length-framed fields, the algorithm's name first; null fields count as -1 long."""
    first = F.lit(algorithm) if isinstance(algorithm, str) else algorithm
    return F.sha2(F.concat(*[_framed(c) for c in (first, *fields)]), 256)


def vhash_list(algorithm: str, items: Column) -> Column:
    """``vhash`` over an array of strings."""
    framed = F.transform(items, lambda x: F.hex(_framed(x)))
    return F.sha2(F.concat(_framed(F.lit(algorithm)), F.unhex(F.array_join(framed, ""))), 256)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


# Producers and rules


def producer_identity(name: Column) -> Column:
    """The identity that blocks: a known family by exact name, else a hash of the whole name."""
    low = F.lower(name)
    return (
        F.when(low.isin("codeql", "codeql command-line toolchain"), "known-family/codeql")
        .when(low == "semgrep", "known-family/semgrep")
        .otherwise(F.concat(F.lit("producer-tool-name/v1/"), vhash("producer-tool-name/v1", name)))
    )


def producer_allowlisted(name: Column) -> Column:
    return F.lower(name).isin("codeql", "codeql command-line toolchain", "semgrep")


def family_slug(name: Column) -> Column:
    """Display family: ASCII letters and digits, other runs as single dashes inside."""
    slug = F.regexp_replace(F.regexp_replace(ascii_lower(name), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    slug = F.when(slug == "", "unknown-producer").otherwise(slug)
    low = F.lower(name)
    return (
        F.when(low.isin("codeql", "codeql command-line toolchain"), "codeql").when(low == "semgrep", "semgrep").otherwise(slug)
    )


def canonical_rule(family: Column, rule: Column) -> Column:
    """The rule under its family, unless its id already starts with it."""
    return F.when(F.startswith(rule, F.concat(family, F.lit("/"))), rule).otherwise(F.concat(family, F.lit("/"), rule))


def resolve_rule(rule_id: Column, rule_index: Column, rule_ids: Column) -> Column:
    """The explicit id, else the indexed driver rule's; null where neither names one."""
    indexed = F.when(rule_index >= 0, F.get(rule_ids, rule_index))
    blank = lambda c: F.when(~c.rlike(f"^{SPACE}*$"), c)
    return F.coalesce(rule_id, blank(indexed))


def alias_rule_id(base_identity: Column, base_rule: Column, cand_identity: Column, cand_rule: Column) -> Column:
    return F.concat(F.lit("alias/"), vhash("rule-alias/v2", base_identity, base_rule, cand_identity, cand_rule))


# Messages


def line_feeds(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def trim_space(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def even_space(c: Column) -> Column:
    """Runs of white space as one space; most texts show at a glance that they have none but single blanks."""
    return F.when(c.rlike("  |[^ -~]"), F.regexp_replace(c, UNEVEN, " ")).otherwise(c)


def message_canonical(c: Column) -> Column:
    """Line ends unified, trimmed, runs of white space as one space."""
    return even_space(trim_space(line_feeds(c)))


def message_comparison(c: Column) -> Column:
    return F.lower(message_canonical(c))


def message_flags(c: Column) -> Column:
    """Which steps changed the message, in their order."""
    feeds, trimmed, flat = line_feeds(c), trim_space(line_feeds(c)), message_canonical(c)
    return keep(
        F.when(feeds != c, "normalised-line-endings"),
        F.when(trimmed != feeds, "trimmed-whitespace"),
        F.when(flat != trimmed, "collapsed-whitespace"),
        F.when(F.lower(flat) != flat, "invariant-case-fold"),
    )


def message_struct(c: Column) -> Column:
    return F.struct(
        c.alias("original"), message_canonical(c).alias("canonical"), message_comparison(c).alias("comparison"), message_flags(c).alias("flags")
    )


def with_message(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds ``message_struct`` of a text column, each of its steps made once a row."""
    feeds, trimmed, flat, low = (F.col(f"_{name}_{i}") for i in range(4))
    steps = [line_feeds(F.col(text)), trim_space(feeds), even_space(trimmed), F.lower(flat)]
    for i, step in enumerate(steps):
        df = df.withColumn(f"_{name}_{i}", step)
    flags = keep(
        F.when(feeds != F.col(text), "normalised-line-endings"), F.when(trimmed != feeds, "trimmed-whitespace"),
        F.when(flat != trimmed, "collapsed-whitespace"), F.when(low != flat, "invariant-case-fold"),
    )
    made = F.struct(F.col(text).alias("original"), flat.alias("canonical"), low.alias("comparison"), flags.alias("flags"))
    return df.withColumn(name, made).drop(*[f"_{name}_{i}" for i in range(4)])


def keep(*items: Column) -> Column:
    """An array of the items that aren't null."""
    return F.filter(F.array(*items), lambda x: x.isNotNull())


# Regions and locations


def region_valid(start: Column, start_col: Column, end: Column, end_col: Column) -> Column:
    """The region as a struct; null unless its lines and columns are positive and in order."""
    positive = lambda c: F.coalesce(c > 0, F.lit(True))
    needs_line = start.isNotNull() | (start_col.isNull() & end.isNull() & end_col.isNull())
    last = F.coalesce(end, start)
    ordered = F.coalesce(last >= start, F.lit(True))
    columns = F.coalesce(~((last == start) & (end_col < F.coalesce(start_col, F.lit(1)))), F.lit(True))
    ok = start.isNotNull() & needs_line & positive(start) & positive(start_col) & positive(end) & positive(end_col) & ordered & columns
    return F.when(ok, F.struct(start.alias("start_line"), start_col.alias("start_column"), end.alias("end_line"), end_col.alias("end_column")))


def region_text(r: Column) -> Column:
    show = lambda c: F.coalesce(c.cast("string"), F.lit("?"))
    return F.when(
        r.isNotNull(),
        F.concat(show(r["start_line"]), F.lit(":"), show(r["start_column"]), F.lit("-"), show(r["end_line"]), F.lit(":"), show(r["end_column"])),
    )


def related_key(uri: Column, region: Column) -> Column:
    fields = [region[c].cast("string") for c in ("start_line", "start_column", "end_line", "end_column")]
    return vhash("related-location/v1", uri, *fields)


# Fingerprints


def fingerprint_family(name: Column) -> Column:
    return F.when(fingerprint_version(name).isNotNull(), F.regexp_extract(name, r"^(.+)/v[0-9]+$", 1)).otherwise(name)


def fingerprint_version(name: Column) -> Column:
    """The number after the last ``/v``, where it fits an int and something stands before it."""
    digits = F.regexp_extract(name, r"^(?s:.+)/v([0-9]+)$", 1)
    plain = F.regexp_replace(digits, "^0+(?=[0-9])", "")
    return F.when((digits != "") & (F.length(plain) <= 10), F.when(plain.try_cast("bigint") <= 2147483647, plain.try_cast("int")))


def context_hash(snippet: Column) -> Column:
    return F.when(snippet.isNotNull(), vhash("source-context/v1", line_feeds(snippet)))


def derived_fingerprint(identity: Column, rule: Column, path: Column, snippet_hash: Column, snippet: Column) -> Column:
    """Rule, path and context as one hash; null without a path or a context."""
    context = F.coalesce(snippet_hash, F.when(snippet.isNotNull(), vhash("embedded-snippet/v1", line_feeds(snippet))))
    return F.when((F.length(path) > 0) & context.isNotNull(), vhash("rule-path-context/v2", identity, rule, path, context))


def trusted_fingerprint(path: Column, atom: Column) -> Column:
    """A file name with its lexical atom; null for folders, back slashes and missing atoms."""
    fits = (F.length(path) > 0) & ~F.endswith(path, F.lit("/")) & ~F.contains(path, F.lit("\\")) & (F.length(atom) > 0)
    return F.when(fits, vhash("trusted-filename-lexical-context/v1", F.substring_index(path, "/", -1), atom))


def bounded(value: Column, algorithm: str) -> Column:
    """Values of over 512 UTF-16 units as their hash."""
    return F.when(units(value) > INLINE_UNITS, F.concat(F.lit("sha256:"), vhash(algorithm, value))).otherwise(value)


def is_bounded(value: Column) -> Column:
    return F.coalesce(units(value) > INLINE_UNITS, F.lit(False))


def stable_key(key: Column) -> Column:
    return F.concat(units(key).cast("string"), F.lit(":"), key)


def pair_key(a: Column, b: Column) -> Column:
    return F.concat(stable_key(a), stable_key(b))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


# A complete prefix: the value itself, or a cut beside a separator.


def complete_prefix(value: Column, prefix: Column, fold: bool = False) -> Column:
    v, p = (ascii_lower(value), ascii_lower(prefix)) if fold else (value, prefix)
    n = F.length(p)
    cut = F.substring(v, n, F.lit(1)).isin("/", "\\") | F.substring(v, n + 1, F.lit(1)).isin("/", "\\")
    return (n > 0) & F.startswith(v, p) & ((F.length(v) == n) | cut)
