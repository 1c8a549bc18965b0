"""Helpers that the corpus operators share: table access, stage tables, byte-level words."""

from __future__ import annotations

import os
import tempfile
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratapack.session import ship, spread

#: Fixed values of the contracts: the six ASCII white-space characters.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, read by Spark so that any store works; one of a few small files is dealt to all cores."""
    ship(spark)
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path under spark.checkpoint.dir. Where that is unset, under the temp folder in local mode; on a cluster that is an error."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        top = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints", "stratapack")
    return f"{top.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def staged(df: DataFrame, tag: str, by: str | None = None) -> DataFrame:
    """Cut the lineage: write df as Parquet to the shared folder and read it again.

    A lost executor then costs only the tasks that it ran; nothing above the
    written table is computed again.
    """
    spark = df.sparkSession
    path = scratch(spark, tag)
    writer = df.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(*dfs: DataFrame) -> None:
    """Delete the files of stage tables that no later plan reads."""
    for df in dfs:
        for top in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            delete(df.sparkSession, top)


def delete(spark: SparkSession, folder: str) -> None:
    """Delete a folder in whatever store it lies."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def text_of(column: str = "text") -> Column:
    """The text, null read as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def shards_for(n: int, per_shard: int, least: int = 1) -> int:
    """How many shards hold n items at about per_shard each."""
    return max(least, -(-int(n) // per_shard))


def rows_of(batch: pa.RecordBatch) -> Iterator[tuple]:
    """The rows of an Arrow batch as tuples; Arrow converts a column at a time."""
    return zip(*(c.to_pylist() for c in batch.columns), strict=True)


def fold(doc_id: int | None, modulus: int) -> int:
    """crc32 of the id's decimal text (null: of the empty text), modulo modulus."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % modulus


def ascii_lower(text: str | None) -> bytes:
    """UTF-8 bytes with only A-Z lower-cased: bytes.lower() leaves other bytes alone."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


def space_words(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ of the ASCII-lower-cased text: bytes.split() cuts at just those six."""
    return ascii_lower(text).split()


#: Everything in ASCII but letters and digits becomes a space, A-Z lower case; other bytes stay.
_ALNUM = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def alnum_words(text: str | None) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the ASCII-lower-cased text."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_ALNUM).split()
