from __future__ import annotations

import zlib

import numpy as np

from findrift.llm import langid
from findrift.llm.common import table

from .helpers import docs


def test_held_out_accuracy(spark):
    df = table(spark, "/root/testdata/sf0.01", "documents")
    got = langid.identify(df, langid.train(df), keep=("lang",)).collect()
    held = [r for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert len(held) > 200
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.98
    assert np.mean([r["ambiguous"] for r in got]) < 0.01
    assert all(0 <= r["score"] <= 1 for r in got)


def test_prediction_ignores_labels(spark):
    df = table(spark, "/root/testdata/sf0.001", "documents")
    model = langid.train(df)
    a = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(df, model).collect()}
    b = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(df.selectExpr("doc_id", "text", "'xx' lang", "source"), model).collect()}
    assert a == b


def test_edge_rows(spark):
    texts = [None, "", "123 !?", "the of and with that", "é", "x" * 100_000, "the of and with that"]
    df = docs(spark, texts, langs=["en", None, "en", "en", None, "de", "en"], ids=[0, 1, 2, 3, 4, 5, None])
    got = {r["doc_id"]: r for r in langid.identify(df, langid.train(df)).collect()}
    assert [got[i]["lang_pred"] for i in (0, 1, 2)] == ["und"] * 3
    assert all(got[i]["lang_pred"] in ("en", "de") for i in (3, 4, 5, None))
    for empty in (df.limit(0), df.selectExpr("doc_id", "text", "cast(null as string) lang")):
        assert langid.train(empty) is None
    assert {r["lang_pred"] for r in langid.identify(df, None).collect()} == {"und"}
    assert langid.identify(df.limit(0), None).count() == 0
    one = docs(spark, ["a b", "c d"], ids=[0, 1])
    assert {r["lang_pred"] for r in langid.identify(one, langid.train(one)).collect()} <= {"en", "und"}


def test_counts_see_whole_texts(monkeypatch):
    text = "Größe und Maß, " * 50
    whole = langid.counts(text)
    monkeypatch.setattr(langid, "SLICE", 64)
    assert (langid.counts(text) == whole).all()
    assert langid.counts("  ,. 1") is None


def test_code_words_differ():
    for n in (2, 3, 4, 7, 12, 40):
        codes = langid.code_words(n)
        gap = min(int((a != b).sum()) for i, a in enumerate(codes) for b in codes[:i])
        assert gap >= (1 if n == 2 else 2 if n == 3 else 4)


def test_every_label_is_learned(spark):
    """More labels than any fixed number, each with its own letters; the rarest too."""
    labels = [f"l{i}" for i in range(260)]
    word = lambda i: "".join(chr(0x4E00 + 70 * i + k) for k in range(4))
    rows = [(i * 10 + k, f"{word(i)} " * 6, lang) for i, lang in enumerate(labels) for k in range(8 if i else 200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df)
    assert model.languages == sorted(labels)
    got = langid.identify(df, model, keep=("lang",)).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.9


def test_fitting_in_either_space_agrees(monkeypatch):
    rng = np.random.default_rng(0)
    x = np.abs(rng.normal(size=(60, langid.DIMS))).astype(np.float32)
    labels = ["a", "b", "c"] * 20
    one = langid.fit(x, labels)
    monkeypatch.setattr(langid, "DIMS", 40)
    short = langid.fit(x[:, :40], labels)
    monkeypatch.setattr(langid, "DIMS", 4096)
    same = langid.fit(x[:, :40], labels)
    assert np.allclose(short.weights, same.weights, atol=1e-3) and one.languages == same.languages


def test_clashing_names_and_long_texts(spark):
    df = docs(spark, ["the house and the street " * 40_000, "der Hund und die Katze " * 3], langs=["en", "de"], ids=[0, 1]).withColumnsRenamed({"fingerprint": "score", "source": "ambiguous"})
    got = langid.identify(df, langid.train(df), keep=("score", "ambiguous", "lang"))
    assert got.columns == ["doc_id", "lang", "lang_pred", "score", "ambiguous"]
    assert {r["doc_id"]: r["lang_pred"] for r in got.collect()} == {0: "en", 1: "de"}
    assert dict(got.dtypes)["score"] == "double"
