"""The prefix join against all pairs."""

from __future__ import annotations

import random

import corpus_pipeline
from findrift.llm import jaccard
from findrift.llm.common import table

from .helpers import docs


def plain_set(text: str | None) -> frozenset[str]:
    words = (text or "").lower().split()
    return frozenset(" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def heads(texts: dict[int, str | None]) -> set[int]:
    """The least id of each class, by all pairs."""
    sets, root = {d: plain_set(t) for d, t in texts.items()}, {d: d for d in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in texts:
        for b in texts:
            if a < b:
                both = len(sets[a] & sets[b])
                if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {find(d) for d in texts}


def edited(rng: random.Random) -> list[str | None]:
    texts: list[str | None] = [None, "", "one two", "ONE  two", "one two three four five six seven eight nine", "one two three four five six seven eight"]
    sentence = " ".join(f"common{i}" for i in range(40))
    for k in range(25):
        words = [f"k{k}w{rng.randrange(10**6)}" for _ in range(rng.choice([12, 60, 200]))] + sentence.split()
        for _ in range(4):
            own = list(words)
            for _ in range(rng.randrange(len(words) // 20 + 1)):
                own[rng.randrange(len(own))] = f"z{rng.randrange(99)}"
            texts.append(" ".join(own))
    return texts


def test_edited_copies(spark):
    texts = edited(random.Random(11))
    df = docs(spark, texts)
    got = [r["doc_id"] for r in corpus_pipeline.near_dedup(spark, df, "").collect()]
    want = heads(dict(enumerate(texts)))
    assert sorted(got) == sorted(want)
    assert 25 < len(want) < 90


def test_crowded_shingles(spark, monkeypatch):
    """Hundreds of near copies of two texts that share sentences: classes as by all pairs, few pairs."""
    rng = random.Random(4)
    shared = [f"s{i}" for i in range(30)]
    texts: list[str | None] = []
    for k in range(2):
        words = shared + [f"k{k}w{i}" for i in range(70)]
        for _ in range(60):
            own = list(words)
            for _ in range(rng.randrange(4)):
                own[rng.randrange(len(own))] = f"z{rng.randrange(10**6)}"
            texts.append(" ".join(own))
    want = heads(dict(enumerate(texts)))
    for crowd in (2, 10, 10**6):
        monkeypatch.setattr(jaccard, "CROWD", crowd)
        assert {r["doc_id"] for r in jaccard.keep_one(docs(spark, texts)).collect()} == want


def test_bitmaps_never_lose_a_pair():
    import numpy as np

    rng = np.random.default_rng(3)
    lost = 0
    for n in (5, 40, 130, 600, 5000):
        for _ in range(40):
            a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            b = np.concatenate([a[int(n * rng.uniform(0, 0.3)) :], rng.integers(0, 1 << 63, int(n * rng.uniform(0, 0.3)), dtype=np.uint64)])
            a, b = np.unique(a), np.unique(b)
            near = jaccard.may_be_similar(jaccard.bitmap(a), jaccard.bitmap(b), len(a), len(b), 0.8)
            assert near or not jaccard.similar(a, b, 0.8)
            lost += not near
    assert lost > 50


def test_recall_on_real_rows(spark):
    df = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] for r in df.collect()}
    assert {r["doc_id"] for r in jaccard.keep_one(df).collect()} == heads(texts)


def test_repeated_ids_and_no_rows(spark):
    df = docs(spark, ["a b c", "a b c", "d e f", "g h i"], ids=[4, 4, None, 4])
    assert sorted((r["doc_id"] or 0, r["text"]) for r in jaccard.keep_one(df).collect()) == [(0, "d e f"), (4, "a b c"), (4, "g h i")]
    assert jaccard.keep_one(df).columns == df.columns
    assert jaccard.keep_one(df.limit(0)).count() == 0


def near_pairs(texts: list[str | None]) -> set[tuple[int, int]]:
    """All pairs of different sets that are similar."""
    sets = [plain_set(t) for t in texts]
    size = lambda a, b: len(sets[a]) + len(sets[b])
    pairs = ((a, b) for b in range(len(texts)) for a in range(b) if sets[a] and sets[b] and sets[a] != sets[b])
    return {(a, b) for a, b in pairs if 9 * len(sets[a] & sets[b]) >= 4 * size(a, b)}


def test_index_finds_near_copies_by_itself(spark, monkeypatch):
    """Without the prefix join, the SimHash tables alone find at least 0.9 of what all pairs find."""
    real = [r["text"] for r in table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text").orderBy("doc_id").collect()]
    monkeypatch.setattr(jaccard, "_shared", lambda prints: spark.createDataFrame([], "shingle long, node long, n int, at int, root long"))
    for texts in (edited(random.Random(11)), real):
        want = heads(dict(enumerate(texts)))
        exact = len({plain_set(t) for t in texts})
        got = {r["doc_id"] for r in jaccard.keep_one(docs(spark, texts)).collect()}
        assert want <= got and len(want) < exact
        assert exact - len(got) >= 0.9 * (exact - len(want))


def test_candidates_of_edited_copies(spark):
    """Whole table keys against all pairs: recall of single links, before classes join them."""
    import numpy as np
    import pyarrow as pa

    from findrift.llm import simhash

    rng, texts = random.Random(2), []
    for k in range(60):
        words = [f"k{k}w{i}" for i in range(rng.choice([30, 100, 400]))]
        for _ in range(3):
            own = list(words)
            for _ in range(rng.randrange(1 + len(words) // 45)):
                own[rng.randrange(len(own))] = f"z{rng.randrange(10**6)}"
            texts.append(" ".join(own))
    want = near_pairs(texts)
    row, h = jaccard.shingle_sets(pa.array(texts), 5)
    fp, unsure = simhash.set_fingerprints(h, np.searchsorted(row, np.arange(len(texts) + 1)))
    df = spark.createDataFrame(sorted({int(f): int(u) for f, u in zip(fp.view(np.int64), unsure.view(np.int64), strict=True)}.items()), "fp long, unsure long")
    met = {(r["u"], r["v"]) for r in simhash.candidates(df).collect()}
    signed = fp.view(np.int64).tolist()
    found = sum(signed[a] == signed[b] or (signed[a], signed[b]) in met or (signed[b], signed[a]) in met for a, b in want)
    assert len(want) > 60 and found >= 0.9 * len(want)
