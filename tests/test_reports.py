"""Streamed reports equal plain ones; reading back finds what is wrong; files are written all or none."""

from __future__ import annotations

import io
import json
import random

import pytest

from findrift.reports import projection, stable


def value(rng: random.Random, depth: int = 0):
    kind = rng.randrange(7 if depth < 3 else 4)
    if kind == 4:
        return {f"k{i}": value(rng, depth + 1) for i in range(rng.randrange(4))}
    if kind in (5, 6):
        return [value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return rng.choice([None, True, 3, "a\nb", 'q"\\', "é\U0001f600", ""])


def test_streams_write_the_same_bytes():
    rng = random.Random(3)
    for _ in range(200):
        rows = [value(rng) for _ in range(rng.randrange(4))]
        plain = {"a": value(rng), "rows": rows, "deep": {"rows": rows, "runs": [{"x": rows}]}}
        held = {"a": plain["a"], "rows": stable.Items(iter(rows)), "deep": {"rows": stable.Items(iter(rows)), "runs": [{"x": stable.Items(iter(rows))}]}}
        out = io.BytesIO()
        sink = stable.Measured(out)
        stable.stream(held, sink)
        assert out.getvalue() == stable.dumps(plain)
        assert sink.result() == stable.measure(stable.dumps(plain))


def finding(cls: str, b: str | None, c: str | None) -> dict:
    side = lambda k: None if k is None else {"findingKey": k, "canonicalMessage": "m <b>", "canonicalUri": "u", "canonicalRule": "r", "region": {"startLine": 2}}
    return {"classification": cls, "baseline": side(b), "candidate": side(c), "decision": {"ambiguous": cls == "ambiguous"}, "evidence": []}


def report(*findings: dict, **counts: int) -> bytes:
    names = ("new", "unchanged", "moved", "modified", "resolved", "ambiguous")
    summary = {n: sum(f["classification"] == n for f in findings) for n in names} | counts
    return json.dumps({"outputSchemaVersion": "1", "inputs": {"baseline": "a", "candidate": "b"}, "summary": summary, "findings": list(findings)}).encode()


def test_reading_back():
    good = report(finding("new", None, "c1"), finding("resolved", "b2", None), finding("unchanged", "b1", "c2"))
    assert len(stable.read_report(good)["findings"]) == 3
    page = projection.html_report(good)
    assert "<script" not in page and "m &lt;b&gt;" in page and "default-src 'none'" in page
    for bad in (
        report(finding("new", "b", None)), report(finding("unchanged", "b", "c"), new=1), report(finding("new", None, "c"), finding("unchanged", "b", "c")),
        report(finding("unchanged", "b1", "c2"), finding("new", None, "c1")), good.replace(b'"outputSchemaVersion": "1"', b'"outputSchemaVersion": "9"'),
    ):
        with pytest.raises(ValueError):
            stable.read_report(bad)


def test_all_files_or_none(tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    a.write_bytes(b"old")
    stable.write_all({str(a): b"1", str(b): b"2"})
    assert (a.read_bytes(), b.read_bytes()) == (b"1", b"2")
    with pytest.raises(ValueError):
        stable.write_all({str(a): b"3"}, inputs=(str(a),))
    with pytest.raises(OSError):
        stable.write_all({str(a): b"3", str(tmp_path / "no" / "c"): b"4"})
    assert a.read_bytes() == b"1" and sorted(p.name for p in tmp_path.iterdir()) == ["a", "b"]


def test_policy():
    assert projection.policy_failures(["new", "moved"], ["new", "modified"]) == ["new"]
    assert projection.policy_failures(["moved"], ["new"], ["warning", "note"], strict=True) == ["warning"]
