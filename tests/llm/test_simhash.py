from __future__ import annotations

import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from findrift.llm import graph, simhash

from .helpers import docs


def plain_print(text: str) -> int:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(values: dict[int, int], radius: int) -> dict[int, int]:
    root = {v: v for v in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in values:
        for b in values:
            if a < b and bin(values[a] ^ values[b]).count("1") <= radius:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {v: find(v) for v in values}


@pytest.mark.parametrize("text", ["", " \t\r\n", "One", "one TWO", "A b c", "a b Été \U0001f600 x", "la la la la la la", "w " * 70_000])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_print(text)


def test_components(spark):
    rng = random.Random(3)
    base = " ".join(f"w{i}" for i in range(400)).split()
    texts: list[str | None] = [None, "", "Same text here", "same TEXT here", "lonely words over there"]
    for _ in range(60):
        own = list(base)
        for _ in range(rng.randrange(3)):
            own[rng.randrange(400)] = f"z{rng.randrange(50)}"
        texts.append(" ".join(own))
    ids = [100 - i for i in range(len(texts))]
    df = docs(spark, texts, ids=ids)
    prints = {i: plain_print(t or "") for i, t in zip(ids, texts, strict=True)}
    for radius in (0, 1, 2, 3):
        got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(df, max_distance=radius).collect()}
        want = classes(prints, radius)
        assert got == {i: (f"{prints[i]:016x}", want[i]) for i in ids}
    assert len(set(classes(prints, 2).values())) < len(set(classes(prints, 1).values()))
    kept = {r["doc_id"] for r in simhash.keep_one(df).collect()}
    assert kept == set(classes(prints, 2).values())


def prints_of(rng: random.Random, groups: int) -> set[int]:
    values = set()
    for _ in range(groups):
        v = rng.getrandbits(64)
        for _ in range(6):
            values.add(v)
            for _ in range(rng.randrange(1, 4)):
                v ^= 1 << rng.randrange(64)
    # A crowded value: all equal in the upper half, one or more bits apart in the lower.
    return values | {(1 << 40) | rng.getrandbits(32) for _ in range(300)} | {(1 << 40) | (1 << b) for b in range(16)}


@pytest.mark.parametrize(("distance", "segments", "bucket"), [(2, 2, 256), (2, 2, 10), (2, 4, 256), (1, 2, 4), (3, 2, 1000), (3, 2, 20), (4, 4, 10)])
def test_links_lose_nothing(spark, distance, segments, bucket):
    values = prints_of(random.Random(5), 40)
    by_id = dict(enumerate(sorted(values)))
    df = spark.createDataFrame([(simhash._signed(v),) for v in values], "fp long")
    pairs = simhash.links(df, distance, segments, bucket)
    roots = {r["node"] % 2**64: r["root"] % 2**64 for r in graph.components(pairs).collect()}
    got = {}
    for i, v in by_id.items():
        got.setdefault(roots.get(v, v), set()).add(i)
    want = {}
    for i, c in classes(by_id, distance).items():
        want.setdefault(c, set()).add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    assert pairs.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) > distance).count() == 0
    if bucket > 300:  # without crowded values every pair within the distance is a link
        flat = sorted(values)
        every = {(a, b) for i, a in enumerate(flat) for b in flat[i + 1 :] if bin(a ^ b).count("1") <= distance}
        assert {tuple(sorted((r["u"] % 2**64, r["v"] % 2**64))) for r in pairs.collect()} == every


def test_segments_have_tables_with_balls():
    assert simhash.radii(2, 2) == [1, 0] and simhash.radii(2, 4) == [0, 0, 0, -1] and simhash.radii(3, 2) == [1, 1] and simhash.radii(5, 4) == [1, 1, 0, 0]
    assert len(simhash.ball(0, 32, 1)) == 33 and len(simhash.ball(32, 64, 0)) == 1 and len(simhash.ball(0, 16, 2)) == 137


def test_one_id_with_two_texts_keeps_both(spark):
    df = docs(spark, ["alpha beta gamma delta", "wholly other words than those", "alpha beta gamma delta"], ids=[1, 1, 2])
    assert sorted(r["text"] for r in simhash.keep_one(df).collect()) == ["alpha beta gamma delta", "wholly other words than those"]


def test_chain_and_star_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 40)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(61)} | {1000 + i: 1000 for i in range(40)}
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_empty_and_repeated_rows(spark):
    df = docs(spark, ["a b c", "a b c", "d e f"], ids=[4, 4, None])
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in simhash.near_duplicates(df).collect()) == [(0, 0), (4, 4), (4, 4)]
    assert sorted(r["doc_id"] or 0 for r in simhash.keep_one(df).collect()) == [0, 4]
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    assert simhash.keep_one(df).columns == df.columns


def test_set_fingerprints_and_unsure_bits():
    import numpy as np

    rng = np.random.default_rng(1)
    sets = [rng.integers(0, 1 << 64, n, dtype=np.uint64) for n in (1, 0, 2, 7, 3000, 0)]
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    fp, mask = simhash.set_fingerprints(np.concatenate(sets), bounds)
    for s, f, m in zip(sets, fp.tolist(), mask.tolist(), strict=True):
        ones = [sum(h >> b & 1 for h in s.tolist()) for b in range(64)]
        assert f == sum(1 << b for b in range(64) if 2 * ones[b] > len(s))
        for lo, hi in ((0, 21), (21, 42), (42, 64)):
            lead = {b: abs(2 * ones[b] - len(s)) for b in range(lo, hi)}
            unsure = [b for b in lead if m >> b & 1]
            assert len(unsure) == simhash.UNSURE and max(lead[b] for b in unsure) <= min(v for b, v in lead.items() if b not in unsure)
    assert [len(v) for v in simhash.set_fingerprints(np.empty(0, np.uint64), np.zeros(1, np.int64))] == [0, 0]


@pytest.mark.parametrize("bucket", [10_000, 3])
def test_candidates_meet_where_unsure_bits_differ(spark, bucket):
    """Against all pairs, with values of more members than an Arrow batch has rows."""
    rng = random.Random(8)
    cuts = ((0, 21), (21, 42), (42, 64))
    prints = {}
    for k in range(100 + 1050):
        # The last 1,050 share their lower two segments, so these values are crowded.
        base = rng.getrandbits(64) if k < 100 else rng.getrandbits(22) << 42 | 12345
        for _ in range(4 if k < 100 else 1):
            mask = sum(1 << b for lo, hi in cuts for b in rng.sample(range(lo, hi), 4))
            v = base
            for _ in range(rng.randrange(8) if k < 100 else 0):
                v ^= 1 << rng.randrange(64)
            prints[v] = mask
    df = spark.createDataFrame([(simhash._signed(v), simhash._signed(m)) for v, m in prints.items()], "fp long, unsure long")
    got = [tuple(sorted((r["u"] % 2**64, r["v"] % 2**64))) for r in simhash.candidates(df, bucket=bucket).collect()]
    flat = sorted(prints)
    want = set()
    for i, a in enumerate(flat):
        for b in flat[i + 1 :]:
            d = a ^ b
            if d.bit_count() <= simhash.WIDE:
                left = d & ~(prints[a] | prints[b])
                if any(not left >> lo & ((1 << (hi - lo)) - 1) for lo, hi in cuts):
                    want.add((a, b))
    assert len(got) == len(set(got)) and set(got) <= want
    assert len(want) > 10_000 and (set(got) == want if bucket > 1050 else 0 < len(got) < 3 * 49 * len(flat))
