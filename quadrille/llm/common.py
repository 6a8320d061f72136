"""Shared helpers: reading tables, the shared scratch folder, cutting lineage, Arrow batches."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..plans.shared import checkpoint_dir

#: Words are runs of anything but these six ASCII white-space bytes; bytes.split() cuts the same way.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a batch sent to Python: documents can be long, so a batch of them must be short.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (see checkpoint_dir)."""
    return checkpoint_dir(spark).rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Write df to the shared folder and read it back: computed once, and safe when executors are lost."""
    spark = df.sparkSession
    schema = df.schema
    df.write.parquet(path := new_path(spark, what))
    out = spark.read.schema(schema).parquet(path)
    out._scratch_path = path
    return out


def number(df: DataFrame) -> Column:
    """The one value of a global aggregate as a literal. Read at once, so that plans that use it don't repeat
    the aggregate; null stays null."""
    value = df.head()[0]
    return F.lit(None if value is None else float(value)).cast("double")


def discard(*tables: DataFrame) -> None:
    """Delete what materialize() wrote, for tables that no later plan reads, and let Spark's cleaner
    find the shuffle files of plans that nothing refers to any more."""
    for df in tables:
        spark = df.sparkSession
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        gc.collect()
        spark.sparkContext._jvm.System.gc()


#: Rows of a table that is broadcast, at most; larger ones are joined as Spark chooses.
BROADCAST_ROWS = 50_000


def small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it has few rows. It is counted, so it should be cheap: a table in the shared folder."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


class Own:
    """A table under column names of our own, c0, c1 and so on, so that no operator's own column can clash with one of the
    input, whatever its name or case. A name is looked up as Spark does, without regard to case."""

    def __init__(self, df: DataFrame, drop: tuple[str, ...] = ()):
        self.names = df.columns
        self.df = df.toDF(*[f"c{i}" for i in range(len(self.names))])
        lost = {d.lower() for d in drop}
        self.kept = [i for i, n in enumerate(self.names) if n.lower() not in lost]

    def name(self, column: str) -> str:
        exact = [i for i, n in enumerate(self.names) if n == column] or [i for i, n in enumerate(self.names) if n.lower() == column.lower()]
        if len(exact) != 1:
            raise ValueError(f"the table has {len(exact)} columns {column}")
        return f"c{exact[0]}"

    def back(self) -> list[Column]:
        """The input's columns that are kept, under their names."""
        return [F.col(f"c{i}").alias(self.names[i]) for i in self.kept]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def release(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; when they end, memory that Arrow holds but doesn't use goes back, as workers live on between tasks."""
    yield from batches
    pa.default_memory_pool().release_unused()


def together(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Consecutive batches as one, once they hold `size` bytes."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if b.num_rows:
            held.append(b)
            if sum(x.nbytes for x in held) >= size:
                yield pa.concat_batches(held)
                held = []
    if held:
        yield pa.concat_batches(held)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], new: str, drop: tuple[str, ...] = ()) -> DataFrame:
    """df without `drop`, with the columns of the DDL `new`, which fn gives for each batch as name -> array."""
    spark = df.sparkSession
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    added = T._parse_datatype_string(new)
    lost = {x.lower() for x in drop} | {f.name.lower() for f in added}
    keep = [f for f in df.schema if f.name.lower() not in lost]
    names = [f.name for f in keep]
    types = to_arrow_schema(added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in release(batches):
            made = fn(b)
            arrays = [b.column(b.schema.get_field_index(n)) for n in names]
            arrays += [x if isinstance(x := made[f.name], pa.Array) else pa.array(x, type=f.type) for f in types]
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, *types.names])

    return df.mapInArrow(run, T.StructType([*keep, *added]))


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The column's texts in UTF-8; null is empty."""
    column = batch.column(batch.schema.get_field_index(name))
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From links a-b, links (node, least node of its component) that join the same nodes."""
    if not len(a):
        return a, b
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        before = root.copy()
        low = np.minimum(root[x], root[y])
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        np.minimum.at(root, x, low)
        np.minimum.at(root, y, low)
        root = root[root]
        if np.array_equal(root, before):
            break
    off = root != np.arange(len(nodes))
    return nodes[off], nodes[root[off]]
