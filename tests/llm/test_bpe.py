from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from findrift.llm import bpe
from findrift.llm.queries import vocabulary

from .helpers import docs


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary())
    t.no_truncation()
    t.no_padding()
    return t


def check(spark, library, texts, table_words=bpe.TABLE_WORDS):
    path = vocabulary()
    ids = bpe.encode(docs(spark, texts), path, table_words=table_words)
    got = {r["doc_id"]: r for r in bpe.digest(ids, path).collect()}
    whole = {r["doc_id"]: r["ids"] for r in ids.collect()}
    for i, t in enumerate(texts):
        want = library.encode(t or "", add_special_tokens=False).ids
        assert whole[i] == want, repr(t)[:80]
        assert got[i]["n_tokens"] == len(want)
        assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(library.decode(want, skip_special_tokens=False).encode()).hexdigest()


def test_awkward_texts(spark, library):
    check(
        spark, library,
        [None, "", " ", "a", "it's  we'll\n\n x\t", "<|endoftext|>", "!<|endoftext|> a  <|endoftext|><|endoftext|>\n b", "é中文\U0001f600‍",
         "x  y \u0085 z", "word " * 20_000, "q" * 20_000, "\U00031350 \U000105c0 ͸ text", "a", "\x00\x1c\x1f"],
    )


@pytest.mark.parametrize("table_words", [0, 40])
def test_words_beyond_the_table(spark, library, table_words):
    """Words that tasks don't hold are encoded where they stand; equal texts and repeated words among them."""
    texts = [f"one two {i % 7}{'x' * i} two<|endoftext|> one, {i}" for i in range(60)] + ["one two 00 two<|endoftext|>"] * 3 + [None, "", "\U00031350 z", "long" * 40 + " b " + "long" * 40]
    check(spark, library, texts, table_words)


def test_distinct_words_are_counted_over_all_rows(spark, monkeypatch):
    df = docs(spark, ["b a b", "a b a b c", " a"] * 200)
    words = df.select(bpe.split_words(F.col("text")).alias("_words")).repartition(7)
    counts = bpe.word_counts(words)
    assert sorted((r["word"], r["n"]) for r in counts.collect()) == [(" a", 600), (" b", 600), (" c", 200), ("a", 200), ("b", 200)]
    spec = bpe.load(vocabulary())
    assert sorted(bpe.frequent_words(counts, spec, 3).column("word").to_pylist()) == [" a", " b"]
    assert bpe.frequent_words(counts, spec, 9).num_rows == 5 and bpe.frequent_words(counts, spec, 0).num_rows == 0
    # The table's words are not encoded again by the tasks that hold them.
    table = bpe.frequent_words(counts, spec, 9)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    enc = bpe.WordEncoder(spec)
    monkeypatch.setattr(enc, "words", lambda own: (np.empty(0, np.int32), np.zeros(1, np.int64)) if not own else pytest.fail(str(own)))
    got = bpe._encode_slice(enc, bpe._Table(sink.getvalue().to_pybytes()), pa.array([["b", " a", " b"], [], ["a"]]), pa.array([None] * 3, pa.string()))
    assert [len(x) for x in got.to_pylist()] == [3, 0, 1]


def test_random_texts(spark, library):
    texts = []

    @settings(max_examples=300, deadline=None, derandomize=True)
    @given(st.text(st.characters(exclude_categories=["Cs"]), max_size=40))
    def collect(t):
        texts.append(t)

    collect()
    check(spark, library, texts)


def test_decode(spark):
    path = vocabulary()
    df = bpe.encode(docs(spark, ["a bé", None, ""]), path)
    assert sorted((r["doc_id"], r["text"]) for r in bpe.decode(df, path).collect()) == [(0, "a bé"), (1, ""), (2, "")]
    cut = spark.createDataFrame([(1, [127, 64]), (2, None)], "doc_id long, ids array<int>")
    assert {r["doc_id"]: r["text"] for r in bpe.decode(cut, path).collect()} == {1: "�a", 2: ""}
    assert bpe.encode(docs(spark, ["x"]).limit(0), path).count() == 0
    clash = docs(spark, ["x y"]).withColumnsRenamed({"fingerprint": "ids", "lang": "_words", "source": "_key"})
    got = bpe.encode(clash, path, keep=("doc_id", "ids", "_words", "_key")).collect()
    assert [r.asDict() for r in got] == [{"doc_id": 0, "_words": "en", "_key": "s", "ids": [87, 331]}]
