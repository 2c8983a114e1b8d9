from __future__ import annotations

import hashlib
import math

from findrift.llm import mixing

from .helpers import docs


def poisson(u: float, mean: float) -> int:
    k, term, total = 0, math.exp(-mean), math.exp(-mean)
    while total <= u and k < 63:
        k += 1
        term *= mean / k
        total += term
    return k


def want_copies(doc, mean: float, seed: int) -> int:
    parts = max(1, math.ceil(mean / mixing.PART))
    total = 0
    for p in range(1, parts + 1):
        u = int(hashlib.md5(f"{seed}:{'' if doc is None else doc}:{p}".encode()).hexdigest()[:12], 16) / 2**48
        total += poisson(u, mean / parts)
    return total


def table(spark):
    sources = ["hot"] * 300 + ["cold"] * 20 + ["one"] + [None] * 30
    ids = [*range(350), None]
    return docs(spark, ["t"] * 351, ids=ids, sources=sources), ids, sources


def test_counts_against_brute_force(spark):
    df, ids, sources = table(spark)
    weights = {"hot": 0.2, "cold": 0.5, "one": 0.3}
    got: dict = {}
    for r in mixing.mix(df, weights, seed=5, total=700).collect():
        got.setdefault(r["doc_id"], []).append(r["copy"])
    for i, s in zip(ids, sources, strict=True):
        mean = weights.get(s, 0.0) * 700 / sources.count(s)
        n = want_copies(i, mean, 5)
        assert sorted(got.get(i, [])) == list(range(n)), (i, s, mean)
    assert len(got[320]) > 150  # one document stands for its whole source


def test_default_weights_and_salted_join_agree(spark, monkeypatch):
    df, ids, sources = table(spark)
    first = sorted((str(r["doc_id"]), r["copy"]) for r in mixing.mix(df).collect())
    roots = {s: math.sqrt(sources.count(s)) for s in set(sources)}
    for i, s in zip(ids, sources, strict=True):
        mean = roots[s] / sum(roots.values()) * len(ids) / sources.count(s)
        assert sum(1 for d, _ in first if d == str(i)) == want_copies(i, mean, 17)
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted((str(r["doc_id"]), r["copy"]) for r in mixing.mix(df).collect()) == first


def test_weights_are_met(spark):
    df = docs(spark, ["t"] * 6000, sources=["a"] * 5000 + ["b"] * 1000)
    got = mixing.mix(df, {"a": 1, "b": 1}, total=6000).groupBy("source").count().collect()
    for r in got:
        assert abs(r["count"] - 3000) < 5 * math.sqrt(3000)


def test_a_column_named_as_the_copy_number_gives_way(spark):
    df, _, _ = table(spark)
    got = mixing.mix(df)
    assert got.columns == [*[c for c in df.columns if c != "copy"], "copy"]
    assert dict(got.dtypes)["copy"] == "bigint"
    assert dict(mixing.mix(df, copy_col=None).dtypes)["copy"] == "string"


def test_very_long_texts_and_one_id_spread_out(spark):
    long = "x " * 500_000
    df = docs(spark, [f"{long}{i}" for i in range(4)] + [f"t{i}" for i in range(400)], ids=[None] * 404)
    got = mixing.mix(df, {"s": 1.0}, total=1212, copy_col="n")
    counts = {r["text"][:9]: 0 for r in df.collect()}
    assert got.count() == want_copies(None, 3.0, 17) * 404
    held = [n for n in got.rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect()]
    assert len(counts) > 100 and max(held) < 0.5 * sum(held)


def test_edges(spark):
    df, _, _ = table(spark)
    assert mixing.mix(df.limit(0)).count() == 0
    assert mixing.mix(df, {}).count() == 0
    assert mixing.mix(df, copy_col=None).columns == df.columns
    plan = mixing.mix(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
