"""Compression of a growing folder: a file stream, each micro-batch through the batch operators.

The reference notion of streaming is bounded memory over one input; there is no event time, so
there are no watermarks. A batch id names its output folder, which makes the sink idempotent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stratapack.functions.codecs import Options
from stratapack.operators import container


def compress_stream(spark: SparkSession, source: str, schema, file_id: str, content: str, target: str, checkpoint: str, options: Options = Options(), files_per_batch: int = 8) -> StreamingQuery:
    """Parquet files under source -> chunk tables under target, one folder a micro-batch; ends when all is read."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)

    def write(batch: DataFrame, batch_id: int) -> None:
        files = batch.selectExpr(f"cast({file_id} as string) as file_id", f"{content} as content")
        container.compress(files, options).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_compressed(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(target).drop("batch")


def containers_of(spark: SparkSession, target: str, files: DataFrame, options: Options = Options()) -> DataFrame:
    """What a finished stream compressed as container files: files (file_id, n) -> file_id, container. A file that fits no row goes to save_stream()."""
    return container.to_files(files, read_compressed(spark, target), options)


def save_stream(spark: SparkSession, target: str, file_id: str, total: int, path: str, options: Options = Options()) -> int:
    """One file of a finished stream to a container at path, chunk by chunk; returns its size. Byte for byte what compress() and to_files() make."""
    return container.save_container(read_compressed(spark, target).filter(F.col("file_id") == file_id), total, options, path)
