"""Makes the package importable in Python workers, wherever the driver found it."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="stratapack-"), "stratapack.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for top, _, names in os.walk(here):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(top, name)
                    out.write(full, os.path.join("stratapack", os.path.relpath(full, here)))
    context.addPyFile(path)
    _shipped.add(context.applicationId)


def spread(rows: DataFrame) -> DataFrame:
    """Rows of a few small files, dealt to all cores before work that costs more than moving them.

    Large files are left as they are: Spark cuts them into at least as many tasks as there are cores.
    """
    spark = rows.sparkSession
    # Planning the scan lists the files too.
    cores, files = spark.sparkContext.defaultParallelism, rows.inputFiles()
    if len(files) >= cores:
        return rows
    held = sum(size_of(spark, f) for f in files)
    return rows.repartition(cores) if held < cores * _bytes(spark.conf.get("spark.sql.files.maxPartitionBytes")) else rows


def _bytes(setting: str) -> int:
    """'134217728b', '8m', '1g' -> bytes."""
    number, unit = setting.strip().lower().removesuffix("b"), 1
    if number[-1] in "kmgt":
        number, unit = number[:-1], 1 << 10 * ("kmgt".index(number[-1]) + 1)
    return int(number) * unit


def hadoop(spark: SparkSession, path: str) -> tuple:
    """(file system, path) of any store that Spark reads."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def size_of(spark: SparkSession, path: str) -> int:
    system, at = hadoop(spark, path)
    return system.getFileStatus(at).getLen()


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the folder that driver and executors share, spark.checkpoint.dir. In local mode without it, in the temp folder."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        top = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints", "stratapack")
    return f"{top.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def staged(df: DataFrame, tag: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: a lost executor costs only its own tasks."""
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
