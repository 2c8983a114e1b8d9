from __future__ import annotations

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from findrift.llm import pii

from .helpers import docs

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind: str, m: str) -> bool:
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "phone":
        return 9 <= len(digits) <= 15
    if kind == "card":
        total = 0
        for i, c in enumerate(reversed(digits)):
            d = int(c) * (1 + i % 2)
            total += d - 9 * (d > 9)
        return 13 <= len(digits) <= 19 and total % 10 == 0
    return True


def base_spans(text: str) -> list[str]:
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PLAIN.items() for m in re.finditer(p, text) if passes(k, m[0])]


CASES = [
    None, "", "plain", "mail a.b@c.d-e.fr, or a@b.c.d@e.f and x@y_z@w.uk", "1.2.3.45.6.7.8 256.1.1.1 001.002.003.255", "4111 1111-1111 1111 x 4111111111111112",
    "call +1 (555) 010-9999. or +123", "\U0001f600 4111111111111111 \U0001f600 a@b.co", "1" * 5000, "a" * 5000 + "@", "a@" + "b.c" * 3000, "9 " * 4000,
    "+1" + " 2" * 5000, "IBAN DE89370400440532013000 and GB82 WEST 1234 5698 7654 32", "ssn 123-45-6789, part 123-45-6789-1 and " + "x" * 60 + " 987-65-4321",
]


@pytest.fixture(scope="module")
def found(spark):
    df = pii.digest(pii.find_pii(docs(spark, CASES)))
    return {r["doc_id"]: r for r in df.collect()}


def test_base_spans_match_plain_patterns(found):
    for i, text in enumerate(CASES):
        base = base_spans(text or "")
        assert found[i]["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest(), text and text[:60]
        for kind in PLAIN:
            assert found[i][f"n_{kind}"] == sum(s.startswith(kind) for s in base)
        assert found[i]["spans"].split(",")[: len(base)] == (base or [found[i]["spans"].split(",")[0]])[: len(base)]


def test_added_kinds_need_checksum_or_context(found):
    assert "iban:5:27" in found[13]["spans"]
    assert "iban:32:59" in found[13]["spans"]
    assert "ssn:4:15" in found[14]["spans"]
    assert found[14]["spans"].count("ssn") == 2  # the second by its context, the third has none


def test_secrets_and_scores(spark):
    hexa = "0123456789abcdef" * 2
    df = docs(spark, [f'token = "{hexa}"', f"checksum {hexa}", "mail me: a@b.co"])
    got = {r["doc_id"]: r for r in pii.digest(pii.find_pii(df)).collect()}
    assert (got[0]["spans"], got[0]["n_secret"], got[0]["scores"]) == ("secret:9:41", 1, "60")
    assert (got[1]["spans"], got[1]["n_spans"]) == ("", 0)
    assert (got[2]["spans"], got[2]["scores"]) == ("email:9:15", "100")


def test_many_matches_in_one_text(spark):
    """100,000 matches in one text of 2.4 MB, linear in the matches."""
    import time

    text = "".join(f"a{i}@b.co 1.2.3.{i % 256} " for i in range(50_000))
    began = time.time()
    got = pii.digest(pii.find_pii(docs(spark, [text, "x"]))).orderBy("doc_id").collect()
    assert time.time() - began < 60
    assert got[0]["base_sha256"] == hashlib.sha256(",".join(base_spans(text)).encode()).hexdigest()
    assert (got[0]["n_email"], got[0]["n_ip"]) == (50_000, 50_000)


def test_random_texts(spark):
    texts = []

    @settings(max_examples=300, deadline=None, derandomize=True)
    @given(st.text(alphabet="0123456789.@+- ()ab_é\U0001f600", max_size=60))
    def collect(t):
        texts.append(t)

    collect()
    got = {r["doc_id"]: r["base_sha256"] for r in pii.digest(pii.find_pii(docs(spark, texts))).collect()}
    for i, t in enumerate(texts):
        assert got[i] == hashlib.sha256(",".join(base_spans(t)).encode()).hexdigest(), t


def test_redact_and_empty(spark):
    df = docs(spark, ["x a@b.co y 4111111111111111", None, "z"])
    assert [r["text"] for r in pii.redact(df).orderBy("doc_id").collect()] == ["x <EMAIL> y <CARD>", None, "z"]
    assert pii.digest(pii.find_pii(df.limit(0))).count() == 0
    assert pii.find_pii(df.unionByName(df)).count() == 6


def test_native(spark):
    plan = pii.digest(pii.find_pii(docs(spark, ["x"])))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
