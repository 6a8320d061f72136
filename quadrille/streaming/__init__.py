"""Continuous loading of workbooks. The engine has no other streaming operators."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources.ods import cells_of_files


def load_directory(spark: SparkSession, path: str, table_path: str, checkpoint: str) -> StreamingQuery:
    """Append the cells of each new .ods file under `path` to a Parquet table, until no new file is left."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.ods").load(path)

    def append(batch, _):
        cells_of_files(batch).write.mode("append").parquet(table_path)

    return files.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
