"""One-to-one assignment per connected component: exact, and refused where the optimum is not unique.

Edges whose two findings have no other edge are decided in the JVM.  The rest goes, grouped by a hash
of its block (an edge never leaves its block), to one function that works block by block: components,
edge retention, commits, forced ambiguity, residual components, exact search.  The preflight's pair
budget bounds what all groups together can hold.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from findrift.checkpoints import checkpoint
from findrift.config import Limits
from findrift.schema import EXACT_PRODUCER, VECTOR

#: Groups of blocks at least, and edges in a group about.
GROUPS, GROUP_EDGES = 16, 200_000
STATE = "case_name string, b_key string, c_key string, state string, code string, component string"
#: Edges: case_name, block, b_key, c_key and the vector's fields.
EDGE = ["case_name", "block", "b_key", "c_key", *VECTOR]


def units(s: str) -> bytes:
    return s.encode("utf-16-be", "surrogatepass")


class Sets:
    """Disjoint sets with path halving and union by size."""

    def __init__(self) -> None:
        self.up: dict = {}
        self.size: dict = {}

    def find(self, x):
        if x not in self.up:
            self.up[x], self.size[x] = x, 1
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def union(self, a, b) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            if self.size[a] < self.size[b]:
                a, b = b, a
            self.up[b] = a
            self.size[a] += self.size[b]

    def groups(self) -> list[list]:
        out: dict = {}
        for x in self.up:
            out.setdefault(self.find(x), []).append(x)
        return list(out.values())


def best_assignment(edges: list[tuple[str, str, tuple]]) -> tuple[list[tuple[str, str]], bool]:
    """(pairs, is there another optimum) of the most pairs, then the lexicographically best sorted vectors."""
    left = sorted({b for b, _, _ in edges}, key=units)
    right = sorted({c for _, c, _ in edges}, key=units)
    if len(edges) == len(left) * len(right) and len({v for _, _, v in edges}) == 1:
        # All pairs alike: any of the equal optima would do, unless there is but one pair.
        return [(left[0], right[0])], len(edges) > 1
    at = {c: i for i, c in enumerate(right)}
    options = [[(at[c], v) for x, c, v in edges if x == b] for b in left]

    @lru_cache(maxsize=None)
    def solve(i: int, used: int) -> tuple[int, tuple, tuple, int]:
        if i == len(left):
            return 0, (), (), 1
        best = solve(i + 1, used)
        for c, v in options[i]:
            if used >> c & 1:
                continue
            n, vectors, pairs, ways = solve(i + 1, used | 1 << c)
            own = (n + 1, tuple(sorted((*vectors, v), reverse=True)))
            if own > best[:2]:
                best = (*own, ((i, c), *pairs), ways)
            elif own == best[:2]:
                best = (*best[:3], min(2, best[3] + ways))
        return best

    _, _, pairs, ways = solve(0, 0)
    return [(left[i], right[c]) for i, c in pairs], ways > 1


def retain(edges: list[tuple], cap: int, exact_b: dict, exact_c: dict) -> list[tuple]:
    """At most ``cap`` edges a finding, the best first: indisputable ones, then by vector, then by keys."""

    def rank(e: tuple) -> tuple:
        sure = e[2][0] == EXACT_PRODUCER and exact_b.get(e[0]) == 1 and exact_c.get(e[1]) == 1
        return (not sure, tuple(-x for x in e[2]), units(f"{len(e[0])}:{e[0]}{len(e[1])}:{e[1]}"))

    n_b: dict = {}
    n_c: dict = {}
    out = []
    for e in sorted(edges, key=rank):
        if n_b.get(e[0], 0) < cap and n_c.get(e[1], 0) < cap:
            out.append(e)
            n_b[e[0]] = n_b.get(e[0], 0) + 1
            n_c[e[1]] = n_c.get(e[1], 0) + 1
    return out


def component_name(nodes: Iterable[tuple[str, str]]) -> str:
    firsts = [min((k for s, k in nodes if s == side), key=units, default="-") for side in "bc"]
    return "|".join(firsts)


def resolve(edges: list[tuple[str, str, tuple]], limits: Limits) -> list[tuple[str | None, str | None, str, str | None, str | None]]:
    """Rows (b_key, c_key, state, code, component) of one block's edges.

    States: matched (both keys), ambiguous (one key), overflow (one key of too many edges), kept (an edge
    that retention kept).
    """
    rows: list[tuple[str | None, str | None, str, str | None, str | None]] = []
    deg_b: dict = {}
    deg_c: dict = {}
    exact_b: dict = {}
    exact_c: dict = {}
    whole = Sets()
    for b, c, v in edges:
        deg_b[b], deg_c[c] = deg_b.get(b, 0) + 1, deg_c.get(c, 0) + 1
        if v[0] == EXACT_PRODUCER:
            exact_b[b], exact_c[c] = exact_b.get(b, 0) + 1, exact_c.get(c, 0) + 1
        whole.union(("b", b), ("c", c))
    cap = limits.maximum_candidate_edges_per_finding
    full = {("b", b) for b, n in deg_b.items() if n > cap} | {("c", c) for c, n in deg_c.items() if n > cap}
    kept = retain(edges, cap, exact_b, exact_c) if full else edges
    rows += [(b, c, "kept", None, None) for b, c, _ in kept]

    done: set = set()
    for b, c, v in kept:
        if v[0] == EXACT_PRODUCER and exact_b[b] == 1 and exact_c[c] == 1:
            rows.append((b, c, "matched", None, None))
            done |= {("b", b), ("c", c)}
    refused: set = set()

    def mark(nodes: Iterable[tuple[str, str]], code: str, name: str) -> None:
        for side, key in nodes:
            refused.add((side, key))
            rows.append((key if side == "b" else None, key if side == "c" else None, "ambiguous", code, name))

    if full:
        for nodes in whole.groups():
            over = [x for x in nodes if x in full and x not in done]
            if over:
                name = component_name(nodes)
                for side, key in over:
                    rows.append((key if side == "b" else None, key if side == "c" else None, "overflow", "MATCH0003" if side == "b" else "MATCH0010", name))
                mark([x for x in nodes if x not in done], "MATCH0003", name)

    residual = [e for e in kept if not {("b", e[0]), ("c", e[1])} & (done | refused)]
    rest = Sets()
    for b, c, _ in residual:
        rest.union(("b", b), ("c", c))
    by_root: dict = {}
    for e in residual:
        by_root.setdefault(rest.find(("b", e[0])), []).append(e)
    for own in by_root.values():
        nodes = {("b", b) for b, _, _ in own} | {("c", c) for _, c, _ in own}
        name = component_name(nodes)
        sides = [sum(s == side for s, _ in nodes) for side in "bc"]
        if max(sides) > limits.maximum_assignment_side_size:
            mark(nodes, "MATCH0002", name)
            continue
        pairs, tied = best_assignment(own)
        if tied:
            mark(nodes, "MATCH0001", name)
        else:
            rows += [(b, c, "matched", None, name) for b, c in pairs]
    return rows


def _group(n: int) -> Column:
    """A group of blocks: as many groups as keep about GROUP_EDGES of ``n`` edges each, so none grows with the data.

    A block itself is bounded by the pair budget of the preflight.
    """
    groups = max(GROUPS, -(-n // GROUP_EDGES))
    return F.pmod(F.xxhash64("case_name", "block"), F.lit(groups)).alias("_g")


def with_degrees(edges: DataFrame) -> DataFrame:
    """``edges`` with how many edges either finding has: deg_b, deg_c."""
    over = lambda key: F.count("*").over(Window.partitionBy("case_name", key))
    return edges.withColumn("deg_b", over("b_key")).withColumn("deg_c", over("c_key"))


def _blocks(pdf: pd.DataFrame, *columns: str) -> dict[tuple, list[tuple]]:
    """The rows of each (case, block)."""
    out: dict = {}
    for case, block, *row in zip(pdf["case_name"], pdf["block"], *(pdf[c] for c in columns), strict=True):
        out.setdefault((case, block), []).append(tuple(row))
    return out


def assign(edges: DataFrame, limits: Limits) -> DataFrame:
    """States of findings and edges: case_name, b_key, c_key, state, code, component.

    ``edges`` has case_name, block, b_key, c_key and vector; every edge stays inside its block.
    """
    # Edges are costly to make and used three times.
    known = checkpoint(with_degrees(edges.select("case_name", "block", "b_key", "c_key", *[F.col(f"vector.{f}").alias(f) for f in VECTOR])))
    lone = known.where("deg_b = 1 and deg_c = 1")
    none = F.lit(None).cast("string")
    easy = lone.select("case_name", "b_key", "c_key", F.explode(F.array(F.lit("matched"), F.lit("kept"))).alias("state"), none.alias("code"), none.alias("component"))
    hard = known.where("not (deg_b = 1 and deg_c = 1)").select(*EDGE)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        pdf = pdf.assign(_v=list(map(tuple, pdf[list(VECTOR)].to_numpy().tolist())))
        for (case, _), own in _blocks(pdf, "b_key", "c_key", "_v").items():
            out += [(case, *r) for r in resolve(own, limits)]
        return pd.DataFrame(out, columns=["case_name", "b_key", "c_key", "state", "code", "component"])

    solved = hard.groupBy(_group(hard.count())).applyInPandas(run, STATE)
    return easy.unionByName(solved)


def component_sizes(edges: DataFrame) -> DataFrame:
    """Case, size and number of the connected components over all edges (sizes count findings)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out: dict = {}
        for (case, _), own in _blocks(pdf, "b_key", "c_key").items():
            sets = Sets()
            for b, c in own:
                sets.union(("b", b), ("c", c))
            for g in sets.groups():
                out[case, len(g)] = out.get((case, len(g)), 0) + 1
        return pd.DataFrame([(c, s, n) for (c, s), n in out.items()], columns=["case_name", "size", "n"])

    known = checkpoint(with_degrees(edges.select("case_name", "block", "b_key", "c_key")))
    lone = known.where("deg_b = 1 and deg_c = 1").select("case_name", F.lit(2).cast("long").alias("size"), F.lit(1).cast("long").alias("n"))
    hard = known.where("not (deg_b = 1 and deg_c = 1)").drop("deg_b", "deg_c")
    sizes = lone.unionByName(hard.groupBy(_group(hard.count())).applyInPandas(run, "case_name string, size long, n long"))
    return sizes.groupBy("case_name", "size").agg(F.sum("n").alias("n_components"))
