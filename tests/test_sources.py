"""Strict readers: logs, labels, manifests, configuration and files below a root."""

from __future__ import annotations

import hashlib
import json
import os

import pytest

from findrift import config
from findrift.config import Limits
from findrift.functions import paths
from findrift.sources import labels, repository, wire


def log(**more) -> bytes:
    return json.dumps({"version": "2.1.0", "runs": [{"tool": {"driver": {"name": "T"}}, "results": []}]} | more).encode()


def refusal(raw: bytes, **limits) -> str:
    with pytest.raises(wire.Refused) as e:
        wire.read_log(raw, Limits(**limits))
    return e.value.args[0] if len(e.value.args) == 1 else e.value.code


def test_logs_within_bounds_are_read():
    assert wire.read_log(log())["runs"][0]["tool"]["driver"]["name"] == "T"
    assert wire.read_log(b"\xef\xbb\xbf" + log())["version"] == "2.1.0"


@pytest.mark.parametrize(
    ("raw", "limits", "code"),
    [
        (log(), {"maximum_input_bytes": 10}, "SECURITY0100"), (b"{", {}, "PARSE0100"), (b'{"version": "2.1.0", "version": "x"}', {}, "PARSE0100"),
        (b"\xff", {}, "PARSE0100"), (b"[]", {}, "SCHEMA0100"), (b'{"runs": 3}', {}, "PARSE0100"), (b"[" * 200, {}, "SECURITY0100"),
        (b'{"version": NaN}', {}, "PARSE0100"),
    ],
)
def test_broken_logs_are_refused(raw, limits, code):
    with pytest.raises(wire.Refused) as e:
        wire.read_log(raw, Limits(**limits))
    assert code in (getattr(e.value, "code", None), *e.value.args)


def test_thread_flows_have_one_budget():
    flow = {"threadFlows": [{"locations": [{}] * 6}]}
    raw = json.dumps({"version": "2.1.0", "runs": [{"results": [{"codeFlows": [flow, flow]}]}]}).encode()
    assert wire.read_log(raw, Limits(maximum_thread_flow_locations_per_result=12))
    with pytest.raises(wire.Refused):
        wire.read_log(raw, Limits(maximum_thread_flow_locations_per_result=11))


GOOD = {"schemaVersion": "1", "pairs": [{"baselineKey": "b", "candidateKey": "c", "classification": "moved"}], "expectedAmbiguous": ["x"]}


def test_labels():
    got = labels.read_labels(json.dumps(GOOD | {"expectedNew": ["n"], "expectedInvalidInputs": ["candidate"]}).encode())
    assert got.pairs == [("b", "c", "moved")] and got.expected == [("ambiguous", "x"), ("new", "n")] and got.invalid == ("candidate",)
    assert got.diagnostics is None and got.explanations is None
    told = {"baselineKey": "b", "classification": "moved", "precedenceTier": "exact-producer", "ambiguous": False, "evidenceKinds": ["k"]}
    assert labels.read_labels(json.dumps(GOOD | {"expectedExplanations": [told]}).encode()).explanations[0]["tier"] == 5


@pytest.mark.parametrize(
    "more",
    [
        {"schemaVersion": "2"}, {"other": 1}, {"pairs": [{"baselineKey": "b"}]}, {"pairs": [{"baselineKey": "b", "candidateKey": "c", "classification": "new"}]},
        {"expectedAmbiguous": ["x", "x"]}, {"expectedNew": ["b"]}, {"expectedInvalidInputs": ["both"]}, {"expectedAmbiguous": [""]},
        {"expectedDiagnostics": [{"code": "A0001"}]}, {"expectedExplanations": [{"classification": "new"}]},
    ],
)
def test_bad_labels_are_refused(more):
    with pytest.raises(labels.BadLabels):
        labels.read_labels(json.dumps(GOOD | more).encode())


def test_manifests():
    digest = "0" * 64
    assert repository.read_manifest(json.dumps({"schemaVersion": "1", "files": {"a/b.c": digest}}).encode()) == {"a/b.c": digest}
    bad = {
        "SCHEMA0020": {"schemaVersion": "2", "files": {}}, "SCHEMA0022": {"schemaVersion": "1", "files": {"../a": digest}}, "SCHEMA0023": {"schemaVersion": "1", "files": {"a": "x"}},
        "PARSE0020": [1],
    }
    for code, data in bad.items():
        with pytest.raises(repository.BadManifest) as e:
            repository.read_manifest(json.dumps(data).encode())
        assert e.value.code == code
    with pytest.raises(repository.BadManifest) as e:
        repository.read_manifest(b'{"schemaVersion": "1", "files": {"a": "%s", "a": "%s"}}' % (digest.encode(), digest.encode()))
    assert e.value.code == "SCHEMA0021"
    for path in ("/a", "a//b", "a/./b", "a/..", "a\\b", "c:a", "", "é"):
        assert not repository.canonical_relative(path), path
    assert repository.canonical_relative("a b/c-d_1.cs")


def test_files_open_only_below_the_root(tmp_path):
    root = tmp_path / "root"
    (root / "d").mkdir(parents=True)
    (root / "d" / "f").write_bytes(b"text")
    (tmp_path / "secret").write_bytes(b"no")
    os.symlink(tmp_path / "secret", root / "link")
    os.symlink(root / "d", root / "dir")
    read = lambda p, limit=100: repository.open_inside(str(root), p, limit)
    assert read("d/f") == (b"text", None) and read("d\\f") == (b"text", None)
    assert read("d/f", 3) == (None, "SECURITY0003")
    for path, code in (("../secret", "SECURITY0001"), ("/etc/passwd", "SECURITY0001"), ("d/../../secret", "SECURITY0001"), ("link", "SECURITY0002"), ("dir/f", "SECURITY0002"), ("d", "SECURITY0005"), ("d/g", "IO0001"), ("x/y", "IO0001")):
        assert read(path) == (None, code), path


def test_source_text_follows_the_manifest(tmp_path):
    (tmp_path / "a.c").write_bytes(b"\xef\xbb\xbfone\r\ntwo")
    (tmp_path / "b.c").write_bytes(b"\xff")
    good = {"a.c": hashlib.sha256(b"\xef\xbb\xbfone\r\ntwo").hexdigest()}
    text = lambda name, manifest=None: repository.source_text(repository.Root(str(tmp_path), manifest), name, Limits())
    assert text("a.c") == ("one\ntwo", None) and text("a.c", good) == ("one\ntwo", None)
    assert text("b.c") == (None, "IO0004") and text("b.c", good) == (None, "SECURITY0008") and text("a.c", {"a.c": "0" * 64}) == (None, "SECURITY0009")


def test_configuration():
    read = lambda data: config.read_config(json.dumps({"schemaVersion": "1"} | data))
    made, notes = read({"pathAliases": [{"baseline": "a/", "candidate": "b/"}], "limits": {"maximumRuns": 3}, "matching": {"snippetLinesRadius": 5}})
    assert not notes and made.path_aliases == (("a/", "b/"),) and made.limits.maximum_runs == 3 and made.snippet_lines_radius == 5
    codes = lambda data: [n.code for n in read(data)[1]]
    assert codes({"limits": {"maximumRuns": 10**6}}) == ["SECURITY0013"] and codes({"limits": {"maximumRuns": 0}}) == ["SCHEMA0008"]
    assert codes({"policy": {"failOn": ["other"]}}) == ["SCHEMA0007"] and codes({"matching": {"pathCaseSensitivity": "x"}}) == ["SCHEMA0006"]
    assert codes({"pathRebases": [{"from": "a", "to": "b"}, {"from": "a", "to": "c"}]}) == ["SCHEMA0003"] and codes({"other": 1}) == ["UNSUPPORTED0001"]
    assert [n.code for n in config.read_config("{")[1]] == ["PARSE0001"] and [n.code for n in config.read_config("{}")[1]] == ["SCHEMA0002"]


def test_percent_decoding_takes_unreserved_characters_only():
    assert paths.decode_unreserved("a%2Eb%7e%2F%41%zz%20") == "a.b~%2FA%zz%20"
    assert paths.kind_of("src/a.c") == "RepositoryRelative" or paths.kind_of("src/a.c")
    assert paths.safe_relative("a/b") and not paths.safe_relative("../a")
