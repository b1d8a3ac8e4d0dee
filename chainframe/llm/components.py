"""Connected components: union-find inside partitions, then contraction between them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced, written


class UnionFind:
    """Roots are the smallest members."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        root = parent.setdefault(x, x)
        while parent[root] != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        if b < a:
            a, b = b, a
        self.parent[b] = a
        return True


_MOST_NODES = 1_000_000


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's links as links to the smallest member; memory is bounded by a flush."""

    def flush(sets: UnionFind) -> pa.RecordBatch:
        pairs = [(x, r) for x in list(sets.parent) if (r := sets.find(x)) != x]
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["a", "b"])

    sets = UnionFind()
    for batch in sliced(batches):
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            sets.union(a, b)
        if len(sets.parent) > _MOST_NODES:
            yield flush(sets)
            sets = UnionFind()
    yield flush(sets)


def components(links: DataFrame, label: str) -> DataFrame:
    """(doc, comp) for every end of a link (a, b): the smallest member of its component.

    Each round every root hooks onto its smallest neighbour and the links are
    renamed; a component of n roots is gone after at most log2(n) rounds.
    """
    edges = written(links.mapInArrow(_contract, "a long, b long").where("a <> b").distinct(), f"{label}-links")
    members = None
    while not edges.isEmpty():
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("doc"), F.least("a", "m").alias("comp")), f"{label}-hooks")
        up = hooks.select(F.col("doc").alias("comp"), F.col("comp").alias("up"))
        hooks = written(hooks.join(up, "comp").select("doc", F.col("up").alias("comp")), f"{label}-jump")
        if members is None:
            members = hooks
        else:
            named = members.join(hooks.select(F.col("doc").alias("comp"), F.col("comp").alias("up")), "comp", "left")
            members = written(named.select("doc", F.coalesce("up", "comp").alias("comp")), f"{label}-members")
        left, right = hooks.select(F.col("doc").alias("a"), F.col("comp").alias("x")), hooks.select(F.col("doc").alias("b"), F.col("comp").alias("y"))
        renamed = edges.join(left, "a").join(right, "b").where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))
        edges = written(renamed.mapInArrow(_contract, "a long, b long").where("a <> b").distinct(), f"{label}-links")
    if members is None:
        return edges.select(F.col("a").alias("doc"), F.col("b").alias("comp"))
    return members
