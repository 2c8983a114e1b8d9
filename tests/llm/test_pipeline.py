"""The pipeline's stages against plain Python, and the whole run."""

from __future__ import annotations

import corpus_pipeline
from findrift.llm import linededup
from findrift.llm.common import table

from .test_jaccard import heads
from .test_linededup import brute
from .test_mixing import want_copies


def test_stages_on_real_rows(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("n_chars < 3000")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "near_dedup", "mix_sources", "encode"]

    kept = corpus_pipeline.language_id(spark, docs, sf_dir).cache()
    assert kept.columns == docs.columns
    assert kept.count() == docs.count()  # every document has a clear language

    deduped = corpus_pipeline.line_dedup(spark, kept, sf_dir).cache()
    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    want = {d: t for d, t in brute(texts, linededup.MIN_WORDS).items() if t == texts[d] or t.strip()}
    got = {r["doc_id"]: r["text"] for r in deduped.collect()}
    size = lambda x: sum(len(t.split()) for t in x.values())
    assert want.keys() <= got.keys() and all(len(want[d]) <= len(got[d]) for d in want)
    assert size(texts) - size(got) >= 0.99 * (size(texts) - size(want))
    assert all(r["n_chars"] == len(r["text"]) for r in deduped.collect())

    near = corpus_pipeline.near_dedup(spark, deduped, sf_dir).cache()
    assert {r["doc_id"] for r in near.collect()} == heads(got)

    mixed = corpus_pipeline.mix_sources(spark, near, sf_dir).cache()
    assert mixed.columns == docs.columns
    rows = near.collect()
    sizes = {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + 1
    total = sum(n**0.5 for n in sizes.values())
    copies = [r["doc_id"] for r in mixed.collect()]
    for r in rows:
        mean = sizes[r["source"]] ** 0.5 / total * len(rows) / sizes[r["source"]]
        assert copies.count(r["doc_id"]) == want_copies(r["doc_id"], mean, 17)

    done = corpus_pipeline.encode(spark, mixed, sf_dir).collect()
    assert sorted(r["doc_id"] for r in done) == sorted(copies)
    assert all(len(r["ids"]) == r["n_tokens"] for r in done)


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 50
    assert corpus_pipeline.ORACLE_SQL is None
