"""Linkage by mutual uniqueness, and the joins that compare two sets of results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from findrift.functions.exprs import ordinal


def unique_atoms(rows: DataFrame, scope: Sequence[str], atom: str, key: str) -> DataFrame:
    """Atoms that one row alone has within its scope: scope, atom, key.  Null atoms prove nothing."""
    found = rows.where(F.col(atom).isNotNull()).groupBy(*scope, atom).agg(F.count("*").alias("_n"), F.min(key).alias(key))
    return found.where("_n = 1").drop("_n")


def mutual_unique_links(baseline: DataFrame, candidate: DataFrame, scope: Sequence[str], atom: str, key: str = "key") -> DataFrame:
    """Pairs (scope, atom, b_key, c_key) whose atom is unique on both sides."""
    b = unique_atoms(baseline, scope, atom, key).withColumnRenamed(key, "b_key")
    c = unique_atoms(candidate, scope, atom, key).withColumnRenamed(key, "c_key")
    return b.join(c, [*scope, atom])


def agreed_links(baseline: DataFrame, candidate: DataFrame, scope: Sequence[str], atoms: Sequence[str], key: str = "key") -> DataFrame:
    """Pairs that every available atom nominates alike: each side's only nomination is the other."""
    votes = None
    for atom in atoms:
        own = mutual_unique_links(baseline, candidate, scope, atom, key).select(*scope, "b_key", "c_key")
        votes = own if votes is None else votes.unionByName(own)
    pairs = votes.distinct()
    by_b = pairs.groupBy(*scope, "b_key").agg(F.count("*").alias("n_b"))
    by_c = pairs.groupBy(*scope, "c_key").agg(F.count("*").alias("n_c"))
    return pairs.join(by_b, [*scope, "b_key"]).join(by_c, [*scope, "c_key"]).where("n_b = 1 and n_c = 1").drop("n_b", "n_c")


def staged_links(baseline: DataFrame, candidate: DataFrame, stages: Sequence[tuple[Sequence[str], str]], key: str = "key") -> DataFrame:
    """Mutual uniqueness in stages: each works on what the earlier ones left.  Returns b_key, c_key, stage."""
    out = None
    for i, (scope, atom) in enumerate(stages):
        links = mutual_unique_links(baseline, candidate, scope, atom, key).select("b_key", "c_key", F.lit(i).alias("stage"))
        out = links if out is None else out.unionByName(links)
        baseline = baseline.join(links.select(F.col("b_key").alias(key)), key, "left_anti")
        candidate = candidate.join(links.select(F.col("c_key").alias(key)), key, "left_anti")
    return out


def source_order_pairs(baseline: DataFrame, candidate: DataFrame, scope: Sequence[str], position: str, key: str = "key") -> DataFrame:
    """The unsafe control: rows of a scope paired by their order on either side."""
    w = Window.partitionBy(*scope).orderBy(F.col(position), ordinal(F.col(key)))
    b = baseline.select(*scope, F.col(key).alias("b_key"), F.row_number().over(w).alias("rn"))
    c = candidate.select(*scope, F.col(key).alias("c_key"), F.row_number().over(w).alias("rn"))
    return b.join(c, [*scope, "rn"])


def symmetry_groups(baseline: DataFrame, candidate: DataFrame, signature: Sequence[str]) -> DataFrame:
    """Signatures that equally many, and more than one, rows of either side share: signature, n."""
    b = baseline.groupBy(*signature).agg(F.count("*").alias("n_b"))
    c = candidate.groupBy(*signature).agg(F.count("*").alias("n_c"))
    return b.join(c, list(signature)).where("n_b = n_c and n_b > 1").select(*signature, F.col("n_b").alias("n"))


def version_delta(old: DataFrame, new: DataFrame, key: Sequence[str], outcome: str) -> DataFrame:
    """Full outer join of two versions' outcomes: key, before, after, change."""
    a, b = old.select(*key, F.col(outcome).alias("before")), new.select(*key, F.col(outcome).alias("after"))
    change = (
        F.when(F.col("before").eqNullSafe(F.col("after")), "same").when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").otherwise("changed")
    )
    return a.join(b, list(key), "full_outer").withColumn("change", change)


def signature_matches(inputs: DataFrame, outputs: DataFrame, signature: Sequence[str], state: str, key: str = "key") -> DataFrame:
    """Outputs traced to inputs by content: taken only where the groups are of one size and one state.

    Returns key, state; inputs of other groups have none.
    """
    left = inputs.groupBy(*signature).agg(F.count("*").alias("n_in"))
    right = outputs.groupBy(*signature).agg(F.count("*").alias("n_out"), F.count_distinct(state).alias("n_states"), F.min(state).alias(state))
    clear = left.join(right, list(signature)).where("n_in = n_out and n_states = 1").select(*signature, state)
    return inputs.join(clear, list(signature)).select(key, state)


def relationship_outcomes(own: DataFrame, other: DataFrame, key: Sequence[str], taxonomy: dict[str, str]) -> DataFrame:
    """Relationships that both tools judged, the other tool's states mapped onto ours: key, own, other, agree."""
    names = F.create_map(*[x for k, v in sorted(taxonomy.items()) for x in (F.lit(k), F.lit(v))])
    joined = own.select(*key, F.col("state").alias("own")).join(other.select(*key, F.try_element_at(names, F.col("state")).alias("other")), list(key))
    return joined.withColumn("agree", F.col("own").eqNullSafe(F.col("other")))
