"""k-means over rectangles and weighted centroids (GE1, GE2, AG13, HP2, HP4)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def centre(p: str = ""):
    return (F.col(f"{p}sx") + F.col(f"{p}ex")) / 2.0, (F.col(f"{p}sy") + F.col(f"{p}ey")) / 2.0


def diagonal(a: str, b: str):
    """Diagonal of the joint box."""
    w = F.greatest(f"{a}ex", f"{b}ex") - F.least(f"{a}sx", f"{b}sx")
    h = F.greatest(f"{a}ey", f"{b}ey") - F.least(f"{a}sy", f"{b}sy")
    return F.sqrt((w * w + h * h).cast("double"))


def weighted_centroid(rects: DataFrame, *keys: str) -> DataFrame:
    """Centres weighted by area."""
    area = ((F.col("ex") - F.col("sx") + 1) * (F.col("ey") - F.col("sy") + 1)).cast("double")
    x, y = centre()
    return rects.groupBy(*keys).agg((F.sum(area * x) / F.sum(area)).alias("cx"), (F.sum(area * y) / F.sum(area)).alias("cy"))


def k_means(rects: DataFrame, k: int, id_: str = "id", seed: int = 1, clusters: list[tuple[float, float]] | None = None) -> DataFrame:
    """id, cluster. Starts at k objects chosen by hash, max(10, 5 ln n) rounds at most, stops when nothing moves. An object goes to
    the nearest centroid, the last of equal ones. k >= n: each object is a cluster. An empty cluster keeps its
    centroid. Only k centroids (a parameter) are held by the driver."""
    x, y = centre()
    points = rects.select(F.col(id_).alias("id"), x.alias("cx"), y.alias("cy"), ((F.col("ex") - F.col("sx") + 1) * (F.col("ey") - F.col("sy") + 1)).cast("double").alias("area"))
    n = points.count()
    if k >= n:
        from .grid import numbered

        return numbered(points, ["id"], "cluster").select("id", (F.col("cluster") - 1).alias("cluster"))
    at = clusters or [(r.cx, r.cy) for r in points.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(k).collect()]

    def assigned(at: list[tuple[float, float]]) -> DataFrame:
        d = [F.struct((F.pow(F.col("cx") - cx, 2) + F.pow(F.col("cy") - cy, 2)).alias("d"), F.lit(-i).alias("i")) for i, (cx, cy) in enumerate(at)]
        return points.withColumn("cluster", -F.array_min(F.array(*d))["i"])

    for _ in range(max(10, int(5 * math.log(max(n, 2))))):
        sums = assigned(at).groupBy("cluster").agg((F.sum(F.col("area") * F.col("cx")) / F.sum("area")).alias("x"), (F.sum(F.col("area") * F.col("cy")) / F.sum("area")).alias("y")).collect()
        after = list(at)
        for r in sums:
            after[r.cluster] = (r.x, r.y)
        if after == at:
            break
        at = after
    return assigned(at).select("id", "cluster")


def assign_cells(assigned: DataFrame) -> DataFrame:
    """Members of each cluster."""
    return assigned.groupBy("cluster").agg(F.count("*").alias("members"))
