"""Point-in-time tables and an exact linear model."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exact import floordiv


def gram(rows: DataFrame, features: list[str], label: str) -> list[list[int]]:
    """Exact sums of products of (1, features, label): one row to the driver, whatever the input."""
    names = ["_one", *features, label]
    df = rows.withColumn("_one", F.lit(1)).where(" AND ".join(f"{n} IS NOT NULL" for n in (*features, label)))
    terms = [F.coalesce(F.sum(F.col(a).cast("decimal(19,0)") * F.col(b).cast("decimal(19,0)")).cast("decimal(38,0)"), F.lit(0)).alias(f"s{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j]
    r = df.agg(*terms).first()
    return [[int(r[f"s{min(i, j)}_{max(i, j)}"]) for j in range(len(names))] for i in range(len(names))]


def grams_by(rows: DataFrame, key: str, features: list[str], label: str) -> dict[int, list[list[int]]]:
    """``gram`` per value of ``key``: one row to the driver for each model that is trained."""
    names = ["_one", *features, label]
    df = rows.withColumn("_one", F.lit(1)).where(" AND ".join(f"{n} IS NOT NULL" for n in (key, *features, label)))
    terms = [F.sum(F.col(a).cast("decimal(19,0)") * F.col(b).cast("decimal(19,0)")).cast("decimal(38,0)").alias(f"s{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j]
    return {r[key]: [[int(r[f"s{min(i, j)}_{max(i, j)}"]) for j in range(len(names))] for i in range(len(names))] for r in df.groupBy(key).agg(*terms).collect()}


def predictions(features: DataFrame, schedule: DataFrame, models: DataFrame, divisor: int, delay: int) -> DataFrame:
    """(replay_row_id, model, available, value) of features by the model that the schedule names for their block.

    Available is when features and model both are, and ``delay`` later; without
    a model the value is null; a value beyond 64 bits raises.
    """
    named = features.join(F.broadcast(schedule), F.expr("block_ordinal >= lo AND block_ordinal < hi"), "left").drop("lo", "hi")
    known = named.join(F.broadcast(models), "model", "left")
    total = F.col("w0").cast("decimal(38,0)") + F.col("w1") * F.col("v0") + F.col("w2") * F.col("v1")
    value = floordiv(total, F.lit(divisor)).cast("long")
    return known.select("replay_row_id", "model", (F.greatest("available", F.coalesce("fitted", F.lit(0).cast("long"))) + delay).alias("available"), value.alias("value"))


def ridge(g: list[list[int]], penalty: int) -> list[Fraction]:
    """Intercept and weights by exact Gauss-Jordan elimination; the intercept carries no penalty."""
    n = len(g) - 1
    a = [[Fraction(g[i][j] + (penalty if i == j and i else 0)) for j in range(n)] + [Fraction(g[i][n])] for i in range(n)]
    for i in range(n):
        p = next((r for r in range(i, n) if a[r][i]), None)
        if p is None:
            raise ValueError("the features are dependent")
        a[i], a[p] = a[p], a[i]
        a[i] = [x / a[i][i] for x in a[i]]
        for r in range(n):
            if r != i and a[r][i]:
                a[r] = [x - a[r][i] * y for x, y in zip(a[r], a[i], strict=True)]
    return [row[n] for row in a]


def quantised(solution: list[Fraction], divisor: int) -> list[int]:
    return [round(x * divisor) for x in solution]


def logistic_steps(x, y, steps: int = 400, rate: float = 0.15, penalty: float = 0.01):
    """Standardised logistic regression by gradient descent on a bounded sample."""
    import numpy as np

    mean, spread = x.mean(axis=0), np.where(x.std(axis=0) == 0, 1, x.std(axis=0))
    z = np.column_stack([np.ones(len(x)), (x - mean) / spread])
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-z @ w))
        w -= rate * (z.T @ (p - y) / len(y) + penalty * np.concatenate([[0], w[1:]]))
    return mean, spread, w
