"""Nearest neighbours by largest inner product over an inverted multi-index.

Vectors are cut in two halves, each quantised by its own k-means (fitted on a bounded sample); a vector's
cell is its pair of centroids, and every row is indexed. For a query q = (q1, q2) a centroid c of the first
half, whose members lie within r of it, bounds their part of the inner product by q1.c + reach |q1| r, and
likewise for the second half. A heap walks the pairs of centroids by falling sum of the two bounds and stops
when the sum is below the query's k-th best score among the sampled rows, which the true k-th best can't be
below. With reach = 1 (the default) no nearest neighbour is lost; a smaller reach reads fewer cells, for
recall to be measured (recall()). Rows of the cells walked are reranked by exact inner products.

Work is dealt as blocks: rows in order of cell, at most `block` to a block, so a cell of many rows spans
several; queries likewise, so that those of a block ask for much the same cells. A block of rows is sent to the
query blocks that ask for it. A task holds one block of rows and one of queries and returns k rows a query.

Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do vectors of
other dimensions than the commonest, nor null ids. Ties go to the smaller id. Rows that repeat an id are
candidates of their own, but not for queries of that id. Fewer candidates than k give fewer rows; none, none.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_batches, materialize, partitions, table
from .vectors import distances, kmeans, matrix, usable


def walk(a: np.ndarray, b: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Pairs (i, j) by falling a[i] + b[j], as far as the sum is at least `least`."""
    i_order, j_order = np.argsort(-a, kind="stable"), np.argsort(-b, kind="stable")
    heap, seen, out = [(-(a[i_order[0]] + b[j_order[0]]), 0, 0)], {(0, 0)}, []
    while heap:
        s, i, j = heapq.heappop(heap)
        if -s < least:
            break
        out.append((int(i_order[i]), int(j_order[j])))
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (-(a[i_order[x]] + b[j_order[y]]), x, y))
    return out


def _top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest, ties to the smaller id."""
    if len(scores) > k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k] - 1e-9)
    else:
        at = np.arange(len(scores))
    return at


def _search(k: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if len(left) and len(right):
            y, ids, cells = matrix(left.column("v")), left.column("id").to_numpy(), left.column("cell").to_numpy()
            x, q_ids = matrix(right.column("v")), right.column("id").to_numpy()
            wanted = right.column("cells").to_pylist()
            for s in range(0, len(x), 256):
                scores = x[s : s + 256] @ y.T
                for q in range(len(scores)):
                    use = np.flatnonzero(np.isin(cells, wanted[s + q]) & (ids != q_ids[s + q]))
                    at = use[_top(scores[q, use], ids[use], k)]
                    exact = (y[at] * x[s + q]).sum(axis=1)
                    order = np.lexsort((ids[at], -exact))[:k]
                    out[0].append(np.full(len(order), q_ids[s + q]))
                    out[1].append(ids[at][order])
                    out[2].append(exact[order])
        arrays = [np.concatenate(c) if c else np.zeros(0) for c in out]
        return pa.table([pa.array(a, type=f.type, from_pandas=False) if len(a) else pa.array([], type=f.type) for a, f in zip(arrays, schema)], schema=schema)

    return run


def search(
    df: DataFrame, queries: Column, k: int = 20, vector: str = "embedding", vec_id: str = "vec_id",
    reach: float = 1.0, centroids: int = 32, sampled: int = 4096, block: int = 4000, query_block: int = 1000,
) -> DataFrame:
    """query_id, rank, vec_id, score for the rows of df where `queries` holds, among all rows of df."""
    spark = df.sparkSession
    good = usable(F.col(vector)) & F.col(vec_id).isNotNull()
    rows = df.filter(good).select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(queries, F.lit(False)).alias("q"))
    rows = materialize(rows, "vectors")
    dims = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not dims:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = dims[0]["d"]
    # A bounded sample of distinct vectors by hash; of each the least and largest id that has it.
    picked = rows.filter(F.size("v") == dim).groupBy("v").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).orderBy(F.xxhash64("v"), "v").limit(sampled).collect()
    data = np.array([r["v"] for r in picked], np.float64)
    # The id whose rows alone have the vector; others' vectors are candidates of any query.
    alone = np.array([r["lo"] for r in picked], np.int64)
    shared = alone != np.array([r["hi"] for r in picked], np.int64)
    half = max(1, dim // 2)
    halves = [(0, half), (half, dim)]
    books = [kmeans(data[:, a:b], centroids) if b > a else np.zeros((1, 0)) for a, b in halves]
    rows = rows.filter(F.size("v") == dim)
    near = np.array([len(books[1])], np.int64)[0]

    def cell_of(batch: pa.RecordBatch) -> dict:
        x = matrix(batch.column(batch.schema.get_field_index("v")))
        parts = [distances(x[:, a:b], c) for (a, b), c in zip(halves, books)]
        i, j = (d.argmin(1) for d in parts)
        far = [np.sqrt(d.min(1)) for d in parts]
        return {"cell": i * near + j, "far1": far[0], "far2": far[1]}

    celled = materialize(map_batches(rows, cell_of, "cell long, far1 double, far2 double"), "cells")
    # Centroids are few, so their radii and the counts of their pairs are bounded tables.
    held = celled.groupBy("cell").agg(F.count("*").alias("n"), F.max("far1").alias("r1"), F.max("far2").alias("r2")).orderBy("cell").collect()
    radius = [np.zeros(len(c)) for c in books]
    start, total, first = {}, 0, {}
    for c in held:
        i, j = divmod(c["cell"], int(near))
        radius[0][i], radius[1][j] = max(radius[0][i], c["r1"]), max(radius[1][j], c["r2"])
        first[c["cell"]] = total
        total += c["n"]
        start[c["cell"]] = c["n"]
    spans = {c: (first[c] // block, (first[c] + n - 1) // block) for c, n in start.items()}

    # A row's block: the blocks that its cell spans, one of them by hash; likewise for queries, so that those of a block
    # are neighbours and ask for the same cells. A cell at a block's edge shares it with its neighbours, so a block holds
    # at most two blocks' rows or so. Cells are centroids x centroids at most, so their table is bounded.
    def dealt(spans: dict, name: str) -> DataFrame:
        table_of = spark.createDataFrame([(c, a, b - a + 1) for c, (a, b) in spans.items()], "cell long, lo int, span int")
        return F.broadcast(table_of.select("cell", (F.col("lo") + F.lit(0)).alias(f"{name}_lo"), F.col("span").alias(f"{name}_span")))

    def block_of(name: str) -> Column:
        return (F.col(f"{name}_lo") + F.pmod(F.xxhash64("id", "v"), F.col(f"{name}_span")).cast("int")).alias(name)

    counted = celled.filter("q").select("id", "v", "cell").distinct().groupBy("cell").count().orderBy("cell").collect()
    q_spans, total = {}, 0
    for c in counted:
        q_spans[c["cell"]] = (total // query_block, (total + c["count"] - 1) // query_block)
        total += c["count"]

    def plan(batch: pa.RecordBatch) -> dict:
        x = matrix(batch.column(batch.schema.get_field_index("v")))
        ids = batch.column(batch.schema.get_field_index("id")).to_numpy()
        scores = x @ data.T
        # A query's own rows are no candidates, however many there are.
        scores[~shared[None, :] & (alone[None, :] == ids[:, None])] = -np.inf
        bound = [x[:, a:b] @ c.T + reach * np.sqrt((x[:, a:b] ** 2).sum(1))[:, None] * r[None, :] for (a, b), c, r in zip(halves, books, radius)]
        out = []
        for q in range(len(ids)):
            least = np.partition(scores[q], len(data) - k)[len(data) - k] if len(data) >= k else -np.inf
            want: dict[int, list[int]] = {}
            for i, j in walk(bound[0][q], bound[1][q], least - 1e-9):
                cell = int(i * near + j)
                if cell in spans:
                    for at in range(spans[cell][0], spans[cell][1] + 1):
                        want.setdefault(at, []).append(cell)
            out.append([{"i": at, "cells": c} for at, c in want.items()])
        return {"want": out}

    each = celled.filter("q").select("id", "v", "cell").distinct().repartition(partitions(spark), "id")
    asked = map_batches(each.join(dealt(q_spans, "j"), "cell").select("id", "v", block_of("j")), plan, "want array<struct<i:int,cells:array<long>>>")
    asked = materialize(asked, "asked")
    # A block of rows goes to the query blocks that ask for it, and to no others.
    pairs = asked.select("j", F.explode("want.i").alias("i")).distinct()
    left = celled.join(dealt(spans, "i"), "cell").select(block_of("i"), "id", "v", "cell").join(pairs, "i")
    right = asked.select("id", "v", F.col("j").alias("q_j"), F.inline("want")).withColumnRenamed("i", "q_i")
    found = left.groupBy("i", "j").cogroup(right.groupBy("q_i", "q_j")).applyInArrow(_search(k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of the exact (query_id, vec_id) pairs that were found."""
    return exact.join(found, ["query_id", "vec_id"], "left_semi").count() / max(1, exact.count())


def op8_approximate_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
