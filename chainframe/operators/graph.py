"""Weighted pair graphs and lineage."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import stored
from .guards import guard_rows
from .research import global_ordinal

MOST_ROUNDS = 64


def both_ways(edges: DataFrame, a: str = "signer_a", b: str = "signer_b") -> DataFrame:
    return edges.select(F.col(a).alias("node"), F.col(b).alias("other"), "weight").union(edges.select(F.col(b).alias("node"), F.col(a).alias("other"), "weight"))


def strength(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy("node").agg(F.sum("weight").alias("strength"), F.count("*").alias("degree"))


def neighbourhood(edges: DataFrame, centre, between: bool = True) -> DataFrame:
    """Edges at the centre, and with ``between`` those among its neighbours."""
    touching = (F.col("signer_a") == centre) | (F.col("signer_b") == centre)
    own = edges.where(touching)
    if not between:
        return own
    near = both_ways(own).where(F.col("node") == centre).select(F.col("other").alias("n")).distinct()
    among = edges.where(~touching).join(near.select(F.col("n").alias("signer_a")), "signer_a", "left_semi").join(near.select(F.col("n").alias("signer_b")), "signer_b", "left_semi")
    return own.unionByName(among)


def closure(roots: DataFrame, parents: DataFrame) -> DataFrame:
    """All (node) reachable from roots along (child, parent), by a join per generation until nothing is new.

    Every generation is written, so a round reads tables and repeats no earlier one.
    """
    frontier = stored(roots.select("node").distinct(), "closure")
    seen, parents = frontier, stored(parents.select("child", "parent").distinct(), "closure-parents")
    for _ in range(MOST_ROUNDS):
        reached = parents.join(frontier.withColumnRenamed("node", "child"), "child").select(F.col("parent").alias("node")).distinct()
        frontier = stored(reached.join(seen, "node", "left_anti"), "closure")
        if frontier.isEmpty():
            return seen
        seen = seen.union(frontier)
    raise ValueError("lineage deeper than the limit")


def group_summary(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """(group, size, internal, crossing): groups numbered by size and then their smallest member."""
    sizes = groups.groupBy("label").agg(F.count("*").alias("size"), F.min("node").alias("first")).withColumn("_by", -F.col("size"))
    numbered = global_ordinal(sizes, ["_by", "first"], "group_no").withColumn("group_no", F.col("group_no") + 1).drop("_by")
    label = lambda end, name: groups.select(F.col("node").alias(end), F.col("label").alias(name))
    joined = edges.join(label("signer_a", "la"), "signer_a").join(label("signer_b", "lb"), "signer_b")
    ends = joined.select(F.col("la").alias("label"), (F.col("la") == F.col("lb")).alias("inside")).union(joined.where("la <> lb").select(F.col("lb").alias("label"), F.lit(False).alias("inside")))
    counted = ends.groupBy("label").agg(F.count_if("inside").alias("internal"), F.count_if(~F.col("inside")).alias("crossing"))
    return numbered.join(counted, "label", "left").select("group_no", "size", "first", F.coalesce("internal", F.lit(0)).alias("internal"), F.coalesce("crossing", F.lit(0)).alias("crossing"))


def modularity(edges: DataFrame, groups: DataFrame) -> float:
    """Weight inside groups over all weight, less what the groups' strengths would give by chance."""
    label = lambda end, name: groups.select(F.col("node").alias(end), F.col("label").alias(name))
    both = edges.join(label("signer_a", "la"), "signer_a").join(label("signer_b", "lb"), "signer_b")
    inside = both.agg(F.sum(F.when(F.col("la") == F.col("lb"), F.col("weight")).otherwise(0)).alias("i"), F.sum("weight").alias("m")).first()
    per = strength(edges).join(groups, "node").groupBy("label").agg(F.sum("strength").cast("double").alias("s")).agg(F.sum(F.col("s") * F.col("s"))).first()[0]
    return inside["i"] / inside["m"] - per / (2 * inside["m"]) ** 2 if inside["m"] else 0.0


class _Moves:
    """Groups of a symmetric weight matrix in compressed rows, one node moved at a time.

    Putting node i into group c changes modularity in proportion to
    w(i, c) - s(i) S(c) / S, with w its weight to the group, s its strength,
    S(c) the strength of the group without it and S that of the graph.
    """

    def __init__(self, rows: np.ndarray, cols: np.ndarray, weights: np.ndarray, n: int):
        by = np.lexsort((cols, rows))
        self.cols, self.weights = cols[by], weights[by].astype(float)
        self.first = np.searchsorted(rows[by], np.arange(n + 1))
        self.strength = np.bincount(rows, weights=weights, minlength=n)
        self.group, self.mass, self.total = np.arange(n), self.strength.copy(), max(self.strength.sum(), 1.0)

    def best_for(self, i: int, least_gain: float) -> int:
        """The group a node gains most by; it stays unless another is better by more than ``least_gain``.

        Groups are tried in ascending order, each against the best before it.
        """
        at = slice(self.first[i], self.first[i + 1])
        near, to = np.unique(self.group[self.cols[at]], return_inverse=True)
        weight = np.bincount(to, weights=self.weights[at], minlength=len(near))
        own, s = self.group[i], self.strength[i]
        without = self.mass[near] - np.where(near == own, s, 0.0)
        gains = weight - s * without / self.total
        stay = weight[near == own].sum() - s * (self.mass[own] - s) / self.total
        best, most = own, stay
        for c, g in zip(near.tolist(), gains.tolist(), strict=True):
            if g > most + least_gain:
                best, most = c, g
        return int(best)

    def sweep(self, least_gain: float) -> bool:
        moved = False
        for i in range(len(self.group)):
            to, own = self.best_for(i, least_gain), self.group[i]
            if to != own:
                self.mass[own] -= self.strength[i]
                self.mass[to] += self.strength[i]
                self.group[i], moved = to, True
        return moved


#: Sweeps at most, and what a move must gain.
PASSES, LEAST_GAIN = 20, 1e-9


def communities(edges: DataFrame, most_nodes: int = 5_000, most_edges: int = 200_000, passes: int = PASSES) -> DataFrame:
    """Groups (node, label) by local moving in the order of the nodes; a label is the first node that gave it.

    Every move depends on those before it, so the graph is one task's; its size is checked first.
    """
    guard_rows(edges, most_edges)
    guard_rows(strength(edges), most_nodes)
    kind = dict(edges.dtypes)["signer_a"]

    def settle(pdf):
        import pandas as pd

        nodes, number = np.unique(np.concatenate([pdf["signer_a"], pdf["signer_b"]]), return_inverse=True)
        a, b, w = number[: len(pdf)], number[len(pdf) :], np.asarray(pdf["weight"], dtype=float)
        moves = _Moves(np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([w, w]), len(nodes))
        for _ in range(passes):
            if not moves.sweep(LEAST_GAIN):
                break
        return pd.DataFrame({"node": nodes, "label": nodes[moves.group]})

    return edges.select("signer_a", "signer_b", "weight").withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(lambda pdf: settle(pdf), f"node {kind}, label {kind}")
