"""Sources and sinks: raw files, benchmark runs, containers as a data source with chunk pruning."""

from __future__ import annotations

import json
import platform
import re
from collections.abc import Iterable, Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from stratapack.functions import layout
from stratapack.session import hadoop

#: A run and its measurements as they lie in JSON; note and cpu may be missing.
RUN_SCHEMA = (
    "date string, commit string, label string, note string, os string, cpu string, adapter string, backend string, "
    "measurements array<struct<name:string,input:string,bytes:bigint,gbps:double,ratio:double,timing:string>>"
)


def raw_files(spark: SparkSession, path: str) -> DataFrame:
    """(file_id, content) of every file under path, by Spark's own reader."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file_id"), "content")


def corpus(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(file_id, content) of each file, as '<name>/<file>'."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.select(F.concat(F.lit(f"{name}/"), F.element_at(F.split("path", "/"), -1)).alias("file_id"), "content")


def corpus_chunks(spark: SparkSession, path: str, name: str, chunk_size: int) -> DataFrame:
    """(file_id, chunk_no, data) of the concatenation '<name>/all' of the files by path, cut into chunks.

    Only paths and lengths are put in order; each file is cut at the whole's chunk borders where it lies, and the few pieces of a
    border chunk meet, so no row holds more than a chunk.
    """
    files = spark.read.format("binaryFile").load(path)
    before = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    # One row of a path and two numbers for each file.
    places = files.select("path", F.col("length").alias("n")).withColumn("begin", F.coalesce(F.sum("n").over(before), F.lit(0)))
    rows = files.select("path", "content").join(places, "path").filter("n > 0")
    size = F.lit(chunk_size).cast("long")
    cut = rows.withColumn("chunk_no", F.explode(F.sequence(F.floor(F.col("begin") / size), F.floor((F.col("begin") + F.col("n") - 1) / size))))
    start = F.greatest(F.col("chunk_no") * size, F.col("begin"))
    end = F.least((F.col("chunk_no") + 1) * size, F.col("begin") + F.col("n"))
    cut = cut.withColumn("start", start).withColumn("skip", (start - F.col("begin") + 1).cast("int")).withColumn("take", (end - start).cast("int"))
    pieces = cut.select("chunk_no", "start", F.expr("substring(content, skip, take)").alias("piece"))
    whole = F.array_sort(F.collect_list(F.struct("start", "piece")))
    joined = pieces.groupBy("chunk_no").agg(whole.alias("p"))
    data = F.aggregate(F.transform("p", lambda x: x["piece"]), F.lit(b""), lambda a, b: F.concat(a, b))
    return joined.select(F.lit(f"{name}/all").alias("file_id"), F.col("chunk_no").cast("long").alias("chunk_no"), data.alias("data"))


def load_runs(spark: SparkSession, path: str) -> DataFrame:
    """Every *.json run under path, oldest first by date text; a missing folder gives no rows."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], RUN_SCHEMA)
    runs = spark.read.schema(RUN_SCHEMA).option("multiLine", True).option("pathGlobFilter", "*.json").json(path)
    return runs.withColumn("note", F.coalesce("note", F.lit(""))).withColumn("cpu", F.coalesce("cpu", F.lit(""))).orderBy("date")


def measurements(runs: DataFrame) -> DataFrame:
    """One row a measurement, `ord` keeping the order measured."""
    rows = runs.select("date", "adapter", F.posexplode("measurements").alias("ord", "m"))
    return rows.select("date", "adapter", "ord", "m.*")


def write_run(spark: SparkSession, run: dict, path: str) -> str:
    """One run as one pretty JSON file in folder path, named by date, label and adapter; returns the file's path."""
    name = re.sub("[^A-Za-z0-9.-]", "-", f"{run['date']}-{run['label']}-{run['adapter']}") + ".json"
    system, at = hadoop(spark, f"{path.rstrip('/')}/{name}")
    out = system.create(at, True)
    try:
        out.write(run_json(run).encode())
    finally:
        out.close()
    return f"{path.rstrip('/')}/{name}"


def host_facts(spark: SparkSession) -> dict[str, str]:
    """What a run records of where it ran: system and processor, and Spark's master, version, cores and limits."""
    cpu = platform.processor() or platform.machine()
    try:
        with open("/proc/cpuinfo") as f:
            cpu = brand(f.read()) or cpu
    except OSError:
        pass
    context = spark.sparkContext
    conf = ("spark.executor.memory", "spark.sql.shuffle.partitions", "spark.sql.files.maxPartitionBytes", "spark.sql.execution.arrow.maxRecordsPerBatch")
    return {"os": f"{platform.system()} {platform.release()}", "cpu": cpu, "adapter": context.master, "backend": f"spark {spark.version}", "cores": str(context.defaultParallelism)} | {f"platform.{k}": spark.conf.get(k, None) or "" for k in conf}


def brand(cpuinfo: str) -> str | None:
    """The first processor's name in the text of /proc/cpuinfo."""
    found = re.search(r"^(?:model name|Hardware|Model)\s*:\s*(.+?)\s*$", cpuinfo, re.MULTILINE)
    return found[1] if found else None


def run_json(run: dict) -> str:
    return json.dumps(run, indent=2, ensure_ascii=False) + "\n"


class _Span(InputPartition):
    def __init__(self, path: str, begin: int, end: int):
        self.path, self.begin, self.end = path, begin, end


class _Reader(DataSourceReader):
    """Splits one container into spans of chunks by its header and table alone; a span reads its payload bytes at once."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.group = int(options.get("chunkspertask", 64))
        self.first, self.last = int(options.get("firstchunk", 0)), options.get("lastchunk")
        self.last = None if self.last is None else int(self.last)
        self.only: set[int] | None = None

    def _open(self):
        """The file in any store that Arrow reads (local, s3, gs, hdfs, abfs, by URI)."""
        system, at = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path.removeprefix("file:"))
        return system.open_input_file(at)

    def _index(self) -> layout.Index:
        with self._open() as f:
            head = f.read_at(layout.HEADER.size, 0)
            count = layout.Header.parse(head).chunk_count
            index = layout.Index.parse(head + f.read_at(count * layout.ENTRY.size, layout.HEADER.size))
            index.validate(f.size() - index.data_offset)
        return index

    def partitions(self) -> list[InputPartition]:
        n = len(self._index().chunks)
        stop = n if self.last is None else min(n, self.last + 1)
        if self.only is not None:
            return [_Span(self.path, k, k + 1) for k in sorted(self.only) if self.first <= k < stop]
        return [_Span(self.path, a, min(stop, a + self.group)) for a in range(self.first, stop, self.group)]

    def read(self, partition: _Span | None) -> Iterator[tuple]:
        # Without any partition Spark asks for one that is None.
        if partition is None:
            return
        index = self._index()
        h, chunks = index.header, index.chunks[partition.begin : partition.end]
        if not chunks:
            return
        low, high = chunks[0].comp_offset, chunks[-1].comp_offset + chunks[-1].comp_size
        with self._open() as f:
            data = f.read_at(high - low, index.data_offset + low)
        for k, c in enumerate(chunks, partition.begin):
            yield (partition.path, k, c.comp_offset, c.comp_size, c.stored, c.uncomp_size, c.checksum, c.filter, data[c.comp_offset - low : c.comp_offset - low + c.comp_size], h.codec)


class _FilterReader(_Reader):
    """Spark refuses a reader with pushFilters unless its setting is on, so it is one of its own."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Comparisons of chunk_no with a number prune chunks before anything is read; the rest stays with Spark."""
        for f in filters:
            column, value = getattr(f, "attribute", None), getattr(f, "value", None)
            if column != ("chunk_no",):
                yield f
            elif isinstance(f, In):
                self.only = set(f.value) if self.only is None else self.only & set(f.value)
            elif isinstance(f, EqualTo):
                self.first, self.last = max(self.first, value), value if self.last is None else min(self.last, value)
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.first = max(self.first, value + isinstance(f, GreaterThan))
            elif isinstance(f, (LessThan, LessThanOrEqual)):
                bound = value - isinstance(f, LessThan)
                self.last = bound if self.last is None else min(self.last, bound)
            else:
                yield f


class ContainerSource(DataSource):
    """spark.read.format('stratapack').option('path', file): the chunk table of one container, in any store that Arrow reads.

    Options firstChunk and lastChunk prune spans before anything is read; with option filters=true, which needs the setting
    spark.sql.python.filterPushdown.enabled, comparisons of chunk_no do. Many containers at once: raw_files() and operators.container.from_files().
    """

    @classmethod
    def name(cls) -> str:
        return "stratapack"

    def schema(self) -> str:
        return "file_id string, chunk_no long, comp_offset long, comp_size long, stored boolean, uncomp_size long, checksum long, filter string, payload binary, codec string"

    def reader(self, schema) -> DataSourceReader:
        options = {k.lower(): v for k, v in self.options.items()}
        return (_FilterReader if options.get("filters", "").lower() == "true" else _Reader)(options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ContainerSource)
