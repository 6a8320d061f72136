"""What the two vector operators share: usable rows, k-means on a bounded sample, blocks of a list."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of the sample that an index is fitted on.
SAMPLE = 20_000
SEED = 7


def usable(vector: Column) -> Column:
    """Not null or empty, not zero, no null or non-finite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | x.isin(float("inf"), float("-inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def sample(df: DataFrame, vector: str, rows: int = SAMPLE) -> np.ndarray:
    """At most `rows` distinct usable vectors of the most common dimension, chosen by hash; the rest of the index
    covers every row."""
    dims = df.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not dims:
        return np.zeros((0, 0))
    picked = df.filter(F.size(vector) == dims[0]["d"]).select(vector).distinct().orderBy(F.xxhash64(vector), vector).limit(rows)
    return np.array([r[0] for r in picked.collect()], np.float64)


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows of x to rows of c."""
    return np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * x @ c.T, 0)


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = SEED) -> np.ndarray:
    rng = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    k = max(1, min(k, len(distinct)))
    c = distinct[rng.choice(len(distinct), k, replace=False)]
    for _ in range(rounds):
        near = distances(x, c).argmin(1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=k)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def matrix(column) -> np.ndarray:
    """An Arrow list column of equally long lists, as rows of doubles."""
    column = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))
