"""Personal data: regular expressions propose, checksums confirm, context words adjust.

DataFrame functions only.  Positions come from the pieces between the matches: ``split`` and
``regexp_extract_all`` with the same pattern yield n + 1 pieces and n matches, whose running
lengths are the code-point offsets.

The patterns are the possessive forms of the plain ones (same matches, no backtracking and no
recursion, so very long runs of digits or letters cost linear time): a run that fails at its first
character fails at every later one too, so a match may only start at the head of its run or where
the previous match ended.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EMAIL = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
)
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b"
SSN = r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b"
#: Long hexadecimal values and two well-known forms of access keys.
SECRET = r"\b(?:[0-9A-Fa-f]{32,128}|AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36})\b"

#: How far before a span its context words may stand, in code points.
CONTEXT_CHARS = 40
#: Spans of the kinds that the method adds need this score; base kinds always stay.
THRESHOLD = 60


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True where a string of 1 to 64 digits passes the Luhn checksum."""
    n = F.length(digits)

    def weigh(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when((n - i) % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + weigh(i))
    return F.when(n.between(1, 64), total % 10 == 0).otherwise(False)


def mod97(iban: Column) -> Column:
    """True where an IBAN (15 to 34 letters and digits) leaves remainder 1."""
    plain = F.regexp_replace(iban, r"\x20", "")
    n = F.length(plain)
    turned = F.concat(F.substring(plain, F.lit(5), n), F.substring(plain, 1, 4))

    def step(acc: Column, i: Column) -> Column:
        code = F.ascii(F.substring(turned, i, F.lit(1)))
        value = F.when(code >= 65, code - 55).otherwise(code - 48)
        return (acc * F.when(value >= 10, 100).otherwise(10) + value) % 97

    rest = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), step)
    return F.when(n.between(15, 34), rest == 1).otherwise(False)


def _ip_ok(m: Column) -> Column:
    return F.forall(
        F.split(m, r"\."),
        lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3)
        & (F.coalesce(F.substring(F.regexp_replace(p, "^0+", ""), 1, 3).try_cast("int"), F.lit(0)) <= 255),
    )


@dataclass(frozen=True)
class Kind:
    """One kind: its pattern, a cheap test without which nothing can match, validator and scores."""

    name: str
    pattern: str
    gate: str
    valid: object
    base: bool
    score: int
    words: str


KINDS = (
    Kind("email", EMAIL, "@", lambda m: F.lit(True), True, 80, r"(?i)mail|contact|write|kontakt|correo|courriel"),
    Kind("ip", IP, r"[0-9]\.[0-9]", _ip_ok, True, 60, r"(?i)\bip\b|host|server|address|adresse"),
    Kind("card", CARD, r"[0-9](?:[\x20-]?[0-9]){12}", lambda m: F.when(F.length(_digits(m)).between(13, 19), luhn(_digits(m))).otherwise(False),
         True, 80, r"(?i)card|visa|credit|karte|tarjeta|carte"),
    Kind("phone", PHONE, r"\+[0-9]", lambda m: F.length(_digits(m)).between(9, 15), True, 60, r"(?i)phone|call|tel|fax|mobil"),
    Kind("iban", IBAN, r"[A-Z]{2}[0-9]{2}", mod97, False, 60, r"(?i)iban|bank|account|konto|cuenta|compte"),
    Kind("ssn", SSN, r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
         lambda m: ~F.substring(m, 1, 3).isin("000", "666") & (F.substring(m, 1, 1) != "9") & (F.substring(m, 5, 2) != "00")
         & (F.substring(m, 8, 4) != "0000"), False, 40, r"(?i)ssn|social|security"),
    Kind("secret", SECRET, r"[0-9A-Fa-f]{32}|AKIA|gh[pousr]_", lambda m: F.lit(True), False, 40, r"(?i)token|secret|key|passw|credential|auth|bearer"),
)


#: Blocks of so many matches keep the growing arrays short: the cost stays near linear in the matches.
BLOCK = 512


def _taken(text: Column, kind: Kind) -> list[Column]:
    """_p_KIND, the pieces between the matches, and _f_KIND, the matches, valid or not; null where there can't be any."""
    gate = F.contains(text, F.lit(kind.gate)) if kind.gate == "@" else text.rlike(kind.gate)
    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    return [F.when(gate, F.split(text, kind.pattern, -1)).alias(f"_p_{kind.name}"), F.when(gate, found).alias(f"_f_{kind.name}")]


def _located(kind: Kind) -> Column:
    """All matches: array<struct<start, end, match, before>>, offsets in code points.

    Pieces and matches must be columns by now: a lambda evaluates what stands in it again for every match.
    ``before`` is the text's last CONTEXT_CHARS code points before the match.
    """
    last = lambda s: F.right(s, F.lit(CONTEXT_CHARS))
    pieces, found = F.col(f"_p_{kind.name}"), F.col(f"_f_{kind.name}")

    def one(acc: Column, i: Column) -> Column:
        start = acc["at"] + F.length(F.get(pieces, i))
        end = start + F.length(F.get(found, i))
        before = last(F.concat(acc["tail"], last(F.get(pieces, i))))
        span = F.struct(start.alias("start"), end.alias("end"), F.get(found, i).alias("match"), before.alias("before"))
        return F.struct(end.alias("at"), last(F.concat(before, F.get(found, i))).alias("tail"), F.concat(acc["out"], F.array(span)).alias("out"))

    empty = F.from_json(F.lit("[]"), "array<struct<start:int,end:int,match:string,before:string>>")

    def many(acc: Column, b: Column) -> Column:
        end = F.least(b * BLOCK + BLOCK, F.size(found)) - 1
        inner = F.aggregate(F.sequence(b * BLOCK, end), F.struct(acc["at"].alias("at"), acc["tail"].alias("tail"), empty.alias("out")), one)
        return F.struct(inner["at"].alias("at"), inner["tail"].alias("tail"), F.concat(acc["out"], F.array(inner["out"])).alias("out"))

    blocks = F.sequence(F.lit(0), F.floor((F.size(found) - 1) / BLOCK).cast("int"))
    none = F.from_json(F.lit("[]"), "array<array<struct<start:int,end:int,match:string,before:string>>>")
    all_ = F.flatten(F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.lit("").alias("tail"), none.alias("out")), many)["out"])
    return F.when(F.size(found) > 0, all_)


def _scored(located: Column, kind: Kind) -> Column:
    """Valid spans of a kind with their scores; an empty array where there is none."""
    valid = F.filter(located, lambda x: kind.valid(x["match"]))

    def shown(x: Column) -> Column:
        score = F.lit(kind.score) + F.when(x["before"].rlike(kind.words), 20).otherwise(0)
        return F.struct(F.lit(kind.name).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), score.alias("score"))

    spans = F.transform(valid, shown)
    if not kind.base:
        spans = F.filter(spans, lambda x: x["score"] >= THRESHOLD)
    return F.coalesce(spans, F.from_json(F.lit("[]"), "array<struct<kind:string,start:int,end:int,score:int>>"))


def _spans(df: DataFrame, keep: list[Column], text: Column) -> DataFrame:
    """``keep`` and the spans of every kind, in columns of the kinds' names."""
    own = [c.alias(f"_k_{i}") for i, c in enumerate(keep)]
    taken = df.select(*own, *[c for k in KINDS for c in _taken(text, k)])
    located = taken.select(*[f"_k_{i}" for i in range(len(keep))], *[_located(k).alias(f"_l_{k.name}") for k in KINDS])
    return located.select(*[f"_k_{i}" for i in range(len(keep))], *[_scored(F.col(f"_l_{k.name}"), k).alias(k.name) for k in KINDS])


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Personal data of every whole text.

    Returns ``id_col``, and per kind an array ``<kind>`` of struct<kind, start, end, score>; offsets
    are code points, end exclusive.  Kinds email, ip, card and phone are always reported where valid;
    iban (mod 97), ssn and secret are added where their score reaches 60, raised by context words in the
    40 code points before.  One output row per input row,
    repeated rows and ids included; a null text is an empty text; an empty table gives an empty result;
    other columns of ``df`` are ignored.
    """
    done = _spans(df, [F.col(id_col)], F.coalesce(F.col(text_col), F.lit("")))
    return done.select(F.col("_k_0").alias(id_col), *[k.name for k in KINDS])


def redact(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with the valid base spans and the added ones replaced by ``<KIND>`` in ``text_col``.

    Where spans overlap, the one that starts first (then the longer) wins.  Null texts stay null.
    """
    spans = _spans(df, [F.struct("*")], F.coalesce(F.col(text_col), F.lit("")))
    text = F.col("_text")
    found = F.array_sort(
        F.concat(*[F.col(k.name) for k in KINDS]),
        lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]),
    )

    def cut(acc: Column, x: Column) -> Column:
        piece = F.concat(F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), F.lit("<"), F.upper(x["kind"]), F.lit(">"))
        return F.when(x["start"] < acc["at"], acc).otherwise(
            F.struct(x["end"].alias("at"), F.concat(acc["out"], F.array(piece)).alias("out"))
        )

    done = F.aggregate(
        "_found", F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")), cut,
        lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))),
    )
    flat = spans.select("_k_0", F.coalesce(F.col("_k_0")[text_col], F.lit("")).alias("_text"), found.alias("_found"))
    own = F.when(F.col("_k_0")[text_col].isNotNull(), done)
    return flat.select(*[(own if c == text_col else F.col("_k_0")[c]).alias(c) for c in df.columns])


def _joined(arrays: list[Column]) -> Column:
    spans = F.concat(*arrays)
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The digest columns of ``find_pii``'s rows."""
    base = [k.name for k in KINDS if k.base]
    return found.select(
        F.col(id_col),
        *[F.size(n).cast("long").alias(f"n_{n}") for n in base],
        F.sha2(_joined([F.col(n) for n in base]).cast("binary"), 256).alias("base_sha256"),
        _joined([F.col(k.name) for k in KINDS]).alias("spans"),
        *[F.size(k.name).cast("long").alias(f"n_{k.name}") for k in KINDS if not k.base],
        F.size(F.concat(*[F.col(k.name) for k in KINDS])).cast("long").alias("n_spans"),
        F.array_join(F.transform(F.concat(*[F.col(k.name) for k in KINDS]), lambda x: x["score"].cast("string")), ",").alias("scores"),
    )
