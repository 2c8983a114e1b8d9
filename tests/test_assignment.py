"""The exact assignment against all matchings, and the states of a block."""

from __future__ import annotations

import itertools
import random

from findrift.config import Limits
from findrift.operators import assignment
from findrift.schema import EXACT_PRODUCER


def all_matchings(edges):
    for n in range(len(edges) + 1):
        for own in itertools.combinations(edges, n):
            if len({b for b, _, _ in own}) == n and len({c for _, c, _ in own}) == n:
                yield own


def optima(edges):
    """Every matching of the most pairs whose sorted vectors are the greatest."""
    ranked = [((len(m), tuple(sorted((v for _, _, v in m), reverse=True))), frozenset((b, c) for b, c, _ in m)) for m in all_matchings(edges)]
    best = max(r for r, _ in ranked)
    return {pairs for r, pairs in ranked if r == best}


def component(rng: random.Random):
    nb, nc = rng.randrange(1, 5), rng.randrange(1, 5)
    every = [(f"b{i}", f"c{j}", (rng.randrange(1, 4), rng.randrange(3))) for i in range(nb) for j in range(nc)]
    return [e for e in every if rng.random() < 0.6]


def test_best_assignment_is_the_unique_optimum_or_says_that_there_are_more():
    rng = random.Random(4)
    ties = 0
    for _ in range(300):
        edges = component(rng)
        if not edges:
            continue
        pairs, tied = assignment.best_assignment(edges)
        want = optima(edges)
        assert tied == (len(want) > 1)
        ties += tied
        if not tied:
            assert frozenset(pairs) == next(iter(want))
    assert 20 < ties < 280


def vector(tier: int, *rest: int) -> tuple:
    return (tier, *rest, *[0] * (6 - len(rest)))


def states(edges, **limits):
    return {(r[2], r[0], r[1], r[3]) for r in assignment.resolve(edges, Limits(**limits)) if r[2] != "kept"}


def test_exact_edges_are_committed_first():
    edges = [("b1", "c1", vector(EXACT_PRODUCER)), ("b1", "c2", vector(4)), ("b2", "c1", vector(4)), ("b2", "c2", vector(3))]
    assert states(edges) == {("matched", "b1", "c1", None), ("matched", "b2", "c2", None)}


def test_ties_are_refused_whole():
    edges = [(f"b{i}", f"c{j}", vector(3)) for i in range(2) for j in range(2)]
    assert states(edges) == {("ambiguous", "b0", None, "MATCH0001"), ("ambiguous", "b1", None, "MATCH0001"), ("ambiguous", None, "c0", "MATCH0001"), ("ambiguous", None, "c1", "MATCH0001")}


def test_large_components_are_refused_by_their_side():
    edges = [(f"b{i}", f"c{i}", vector(3)) for i in range(4)] + [(f"b{i}", f"c{i + 1}", vector(2)) for i in range(3)]
    assert {s for s, *_ in states(edges)} == {"matched"}
    assert {code for *_, code in states(edges, maximum_assignment_side_size=3)} == {"MATCH0002"}


def test_findings_with_too_many_edges_make_their_component_ambiguous():
    edges = [("b", f"c{i}", vector(3, i)) for i in range(5)]
    got = states(edges, maximum_candidate_edges_per_finding=3)
    assert ("overflow", "b", None, "MATCH0003") in got
    assert {(b, c) for s, b, c, _ in got if s == "ambiguous"} == {("b", None), *[(None, f"c{i}") for i in range(5)]}
    kept = [r for r in assignment.resolve(edges, Limits(maximum_candidate_edges_per_finding=3)) if r[2] == "kept"]
    assert [r[1] for r in kept] == ["c4", "c3", "c2"]


def test_components_by_disjoint_sets():
    sets = assignment.Sets()
    for i in range(50):
        sets.union(i, i + 1)
    sets.union(100, 101)
    assert sorted(map(sorted, sets.groups())) == [list(range(51)), [100, 101]]
