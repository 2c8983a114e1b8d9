"""Every registered query and every stage on small tables with awkward rows: nulls, empty and very long texts,
repeated rows, clashing names, and tables without rows."""

from __future__ import annotations

import hashlib
from collections import Counter

import pytest

import corpus_pipeline
from findrift.llm import queries
from findrift.llm.common import table

LONG = "Der lange Text über die Straße und das Haus, in dem wir wohnen. " * 20_000  # 1.3 million code points
PLAIN = "The house on the hill stood empty for many years before anyone came to look at it again"
TEXTS = [None, "", " \n\t", PLAIN, PLAIN, "La casa de la colina estuvo vacía durante muchos años y nadie la quería", LONG, "1234 !?", "x", PLAIN + " today"]
#: Columns whose names the operators use for outputs or inside.
CLASHES = "lang string, source string, n_chars long, score string, lang_pred string, ambiguous string, `copy` string, lines_removed string, fingerprint string, ids string, gone string, removed string, _row string, _id string, _hash string, _text string, n_tokens string"


def documents(spark):
    rows = [(i, t, None if i == 2 else "en" if i % 2 else "de", None if i == 1 else f"s{i % 3}", 7, *["old"] * 14) for i, t in enumerate(TEXTS)]
    rows += [rows[3], (None, PLAIN, "en", "s1", 3, *["old"] * 14), (None, None, None, None, None, *[None] * 14)]
    return spark.createDataFrame(rows, f"doc_id long, text string, {CLASHES}")


@pytest.fixture(scope="module")
def dirs(spark, tmp_path_factory):
    full, empty = (str(tmp_path_factory.mktemp(n)) for n in ("full", "empty"))
    docs = documents(spark)
    pages = spark.createDataFrame(
        [(1, "u", "<body><p>Hello there, this is text.</p></body>", "a", "b"), (1, None, None, "a", "b"), (None, "u", "", None, None), (2, "v", "<p>" + "word " * 300_000, "a", "b")],
        "page_id long, url string, html string, text string, n_chars string",
    )
    talks = spark.createDataFrame(
        [(1, 0, "user", "hi", "x"), (1, 1, "assistant", None, "x"), (1, 1, "assistant", None, "x"), (None, 0, None, "a", "x"), (3, 0, "assistant", "word " * 100_000, "x")],
        "conv_id long, turn long, role string, text string, formatted string",
    )
    vectors = spark.createDataFrame(
        [(0, [1.0, 2.0], 1), (0, [1.0, 2.0], 1), (1, None, 1), (2, [None, 1.0], 1), (None, [1.0, 1.0], 1), (20, [2.0, 2.0], 1), (3, [2.0, 2.0], 1), (4, [2.0, 2.0], 1), (5, [], 1)],
        "vec_id long, embedding array<float>, score long",
    )
    for name, df in (("documents", docs), ("pages", pages), ("conversations", talks), ("embeddings", vectors)):
        df.write.parquet(f"{full}/{name}.parquet")
        df.limit(0).write.parquet(f"{empty}/{name}.parquet")
    return full, empty


BY_DOCUMENT = ["op1_pii", "op2_media", "op3_bpe", "op4_line_dedup", "op5_simhash", "op10_langid"]


@pytest.mark.parametrize("name", BY_DOCUMENT)
def test_one_row_per_document(spark, dirs, name):
    got = queries.queries()[name](spark, dirs[0]).collect()
    assert Counter(r["doc_id"] for r in got) == Counter([*range(len(TEXTS)), 3, None, None])


@pytest.mark.parametrize("name", [*BY_DOCUMENT, "op6_html", "op7_mix", "op9_topk", "pipeline"])
def test_empty_tables(spark, dirs, name):
    full, empty = (queries.queries()[name](spark, d) for d in dirs)
    assert empty.count() == 0 and empty.columns == full.columns


def test_contract_values(spark, dirs):
    q = {n: {r["doc_id"]: r for r in queries.queries()[n](spark, dirs[0]).collect() if r["doc_id"] is not None} for n in BY_DOCUMENT}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for i, t in enumerate(TEXTS):
        data = (t or "").encode()
        payload = data + b" " * (-len(data) % 192 if data else 192)
        assert q["op2_media"][i]["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        assert q["op3_bpe"][i]["decoded_sha256"] == sha(t or "")
        assert q["op1_pii"][i]["base_sha256"] == sha("")
    assert [q["op10_langid"][i]["lang_pred"] for i in (0, 1, 2, 7)] == ["und"] * 4
    assert q["op5_simhash"][0]["fingerprint"] == "0" * 16 and {q["op5_simhash"][i]["component_id"] for i in (0, 1, 2)} == {0}
    assert q["op5_simhash"][4]["component_id"] == 3
    assert q["op4_line_dedup"][3]["text"] == PLAIN and q["op4_line_dedup"][0]["text"] is None


def test_pages(spark, dirs):
    got = {(r["page_id"], r["url"]): r for r in queries.queries()["op6_html"](spark, dirs[0]).collect()}
    assert got[1, "u"]["text"] == "Hello there, this is text." and got[1, None]["text"] == "" and got[None, "u"]["text"] == ""
    assert got[2, "v"]["n_chars"] == 5 * 300_000 - 1


def test_conversations(spark, dirs):
    got = {r["conv_id"]: r for r in queries.queries()["op8_chat"](spark, dirs[0]).collect()}
    assert {c: r["n_turns"] for c, r in got.items()} == {1: 3, None: 1, 3: 1, -7: 2}
    said = "</s>[INST] ok [/INST]"
    assert got[-7]["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest() and got[-7]["loss_chars"] == len(said)
    assert got[-7]["turns_sha256"] == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
    assert [r["conv_id"] for r in queries.queries()["op8_chat"](spark, dirs[1]).collect()] == [-7]


def test_vectors(spark, dirs):
    got = sorted(tuple(r) for r in queries.queries()["op9_topk"](spark, dirs[0]).collect())
    tied = 64 * 128 + 128 * 128
    assert [r for r in got if r[0] == 0] == [(0, 1, 3, tied), (0, 2, 4, tied), (0, 3, 20, tied), (0, 4, 5, 0)]
    assert [r[2] for r in got if r[0] == 20] == [3, 4, 0, 5]


def test_mix_repeats_whole_rows(spark, dirs):
    got = queries.queries()["op7_mix"](spark, dirs[0]).collect()
    by_id = dict(enumerate(TEXTS))
    assert all(r["text"] == by_id[r["doc_id"]] for r in got if r["doc_id"] is not None)


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES[:-1]], ids=[n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_keep_columns_and_clean_documents(spark, dirs, stage):
    docs = table(spark, dirs[0], "documents")
    done = stage(spark, docs, dirs[0])
    assert done.columns == docs.columns and [t for _, t in done.dtypes] == [t for _, t in docs.dtypes]
    rows = done.collect()
    assert all(r["score"] in ("old", None) and r["copy"] in ("old", None) for r in rows)
    empty = stage(spark, docs.limit(0), dirs[1])
    assert empty.count() == 0 and empty.columns == docs.columns
    if stage is not corpus_pipeline.mix_sources:
        kept = {r["doc_id"]: r["text"] for r in rows}
        assert kept[3] == PLAIN and kept[5] == TEXTS[5] and len(kept[6]) > 60


def test_last_stage_on_awkward_rows(spark, dirs):
    docs = table(spark, dirs[0], "documents")
    got = corpus_pipeline.encode(spark, docs, dirs[0]).collect()
    assert len(got) == docs.count()
    assert all(r["n_tokens"] == len(r["ids"]) for r in got)
