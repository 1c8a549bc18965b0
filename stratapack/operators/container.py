"""The byte plane: chunks through the codecs in Arrow batches, containers, range reads, splices.

Only the fused filter+codec step runs in Python, in place; layout, pruning and
offsets are ordinary columns. Filters on chunk numbers belong before decode(),
where they reach the scan.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratapack.functions import codecs, layout
from stratapack.functions.codecs import Options
from stratapack.functions.lz import BlockError
from stratapack.operators import chunks as plane
from stratapack.session import hadoop, ship, spread

_CHUNKS = "file_id string, chunk_no long, comp_size long, stored boolean, uncomp_size long, checksum long, filter string, payload binary"
_KINDS = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.string(), pa.binary()]


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(c.to_pylist() for c in batch.columns), strict=True)


def encode(split: DataFrame, options: Options) -> DataFrame:
    """file_id, chunk_no, data -> the chunk table with payloads, without offsets."""
    ship(split.sparkSession)
    names = [c.split()[0] for c in _CHUNKS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for file_id, k, data in _rows(batch):
                payload, stored, name = codecs.encode_chunk(data, options)
                out.append((file_id, k, len(payload), stored, len(data), codecs.checksum(data) if options.checksums else 0, name, payload))
            yield _batch(out, names, _KINDS)

    return split.select("file_id", "chunk_no", "data").mapInArrow(run, _CHUNKS)


def compress(files: DataFrame, options: Options = Options()) -> DataFrame:
    """(file_id, content) -> chunk table. An empty file has no rows here; its header still exists."""
    return encode(spread(plane.split(files, options.chunk_size)), options)


def decode(chunks: DataFrame, codec: str, verify: bool = False) -> DataFrame:
    """Chunk table -> file_id, chunk_no, comp_size, data, status ('ok' or the first failing check; data is null then)."""
    ship(chunks.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for payload, stored, size, name, checksum in _rows(batch.select(["payload", "stored", "uncomp_size", "filter", "checksum"])):
                try:
                    out.append((codecs.decode_chunk(payload, stored, codec, size, name, checksum if verify else None), "ok"))
                except BlockError as e:
                    out.append((None, e.status))
            data, status = zip(*out, strict=True) if out else ([], [])
            yield pa.RecordBatch.from_arrays([batch["file_id"], batch["chunk_no"], batch["comp_size"], pa.array(data, pa.binary()), pa.array(status, pa.string())], ["file_id", "chunk_no", "comp_size", "data", "status"])

    rows = chunks.select("file_id", "chunk_no", F.col("comp_size").cast("long").alias("comp_size"), "payload", "stored", "uncomp_size", "filter", "checksum")
    return rows.mapInArrow(run, "file_id string, chunk_no long, comp_size long, data binary, status string")


def joined(parts: DataFrame, order: str = "chunk_no", data: str = "data", size: str | None = None) -> DataFrame:
    """file_id, content (and packed, the sum of column size): a file's pieces in order, null if one is missing. A row bounds the file (2 GB); larger files stay chunk rows or go to save_bytes()."""

    def join(group: pa.Table) -> pa.Table:
        pieces = group.combine_chunks().sort_by(order)[data].to_pylist()
        whole = None if None in pieces else b"".join(pieces)
        out = {"file_id": group["file_id"].slice(0, 1).cast(pa.string()), "content": pa.array([whole], pa.binary())}
        return pa.table(out | ({"packed": pa.array([sum(group[size].to_pylist())], pa.int64())} if size else {}))

    return parts.select("file_id", order, data, *([size] if size else [])).groupBy("file_id").applyInArrow(join, "file_id string, content binary" + ", packed long" * bool(size))


class Damaged(ValueError):
    """A chunk that doesn't decode; the first in order, as a reader from the start would find it."""

    def __init__(self, chunk_no: int, status: str):
        super().__init__(f"chunk {chunk_no}: {status}")
        self.chunk_no, self.status = chunk_no, status


def save_bytes(decoded: DataFrame, path: str) -> int:
    """Ordered writer of one file: decode()'s rows by chunk_no to any store, a partition at a time on the driver; returns the bytes written.

    The first damaged chunk in order raises after everything before it is written.
    """
    written = 0
    with _Output(decoded.sparkSession, path) as out:
        for k, data, status in decoded.select("chunk_no", "data", "status").orderBy("chunk_no").toLocalIterator(prefetchPartitions=True):
            if status != "ok":
                raise Damaged(k, status)
            out.write(bytes(data))
            written += len(data)
    return written


def save_container(chunks: DataFrame, total: int, options: Options, path: str) -> int:
    """Ordered writer of one container: header, chunk table, then payloads by chunk_no; returns its size.

    The driver holds the table (24 bytes a chunk) and a partition of payloads at a time. chunks is read
    twice, so it should be a written table.
    """
    rows = chunks.select("chunk_no", "comp_size", "stored", "uncomp_size", "checksum", "filter").orderBy("chunk_no").collect()
    entries, at = [], 0
    for r in rows:
        entries.append(layout.Entry(at, r["comp_size"], r["stored"], r["uncomp_size"], r["checksum"], r["filter"]))
        at += layout.pad4(r["comp_size"])
    index = layout.Index(layout.Header(options.codec, options.chunk_size, len(entries), total, options.checksums, options.level), tuple(entries))
    index.validate(at)
    with _Output(chunks.sparkSession, path) as out:
        out.write(index.to_bytes())
        for (payload,) in chunks.orderBy("chunk_no").select("payload").toLocalIterator(prefetchPartitions=True):
            out.write(bytes(payload) + b"\0" * (-len(payload) % 4))
    return index.data_offset + at


class _Output:
    """A file of any store that Spark writes."""

    def __init__(self, spark: SparkSession, path: str):
        self.system, self.path = hadoop(spark, path)

    def __enter__(self):
        self.stream = self.system.create(self.path, True)
        return self.stream

    def __exit__(self, *_) -> None:
        self.stream.close()


def decompress(chunks: DataFrame, codec: str, verify: bool = False) -> DataFrame:
    """file_id, content, packed (payload bytes) of each file with chunks."""
    return joined(decode(chunks, codec, verify), size="comp_size")


def read_ranges(chunks: DataFrame, ranges: DataFrame, codec: str, chunk_size: int) -> DataFrame:
    """ranges (range_id, file_id, offset, len, n) -> range_id, file_id, part. Only overlapping chunks are decoded."""
    wanted = plane.overlaps(ranges, chunks, chunk_size)
    ship(chunks.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for range_id, file_id, k, a, b, payload, stored, size, name in _rows(batch):
                out.append((range_id, file_id, k, codecs.decode_chunk(payload, stored, codec, size, name)[a:b]))
            yield _batch(out, ["range_id", "of", "chunk_no", "data"], [pa.int64(), pa.string(), pa.int64(), pa.binary()])

    cut = wanted.select("range_id", "file_id", "chunk_no", "from_byte", "to_byte", "payload", "stored", "uncomp_size", "filter")
    parts = cut.mapInArrow(run, "range_id long, of string, chunk_no long, data binary")
    pieces = joined(parts.withColumn("file_id", F.col("range_id").cast("string")))
    found = pieces.select(F.col("file_id").cast("long").alias("range_id"), F.col("content").alias("part"))
    ok = plane.ranges_to_chunks(ranges, chunk_size).filter("status = 'ok'").select("range_id", "file_id")
    return ok.join(found, "range_id", "left").select("range_id", "file_id", F.coalesce("part", F.lit(b"")).alias("part"))


def to_files(files: DataFrame, chunks: DataFrame, options: Options) -> DataFrame:
    """(file_id, n) and their chunk tables -> file_id, container: one complete container file each."""
    ship(chunks.sparkSession)
    rows = F.struct("chunk_no", "comp_size", "stored", "uncomp_size", "checksum", "filter", "payload")
    tables = chunks.groupBy("file_id").agg(F.array_sort(F.collect_list(rows)).alias("t"))
    both = files.select("file_id", "n").join(tables, "file_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for file_id, n, t in _rows(batch):
                t = t or []
                header = layout.Header(options.codec, options.chunk_size, len(t), n, options.checksums, options.level)
                entries = [layout.Entry(0, c["comp_size"], c["stored"], c["uncomp_size"], c["checksum"], c["filter"]) for c in t]
                out.append((file_id, layout.assemble(header, entries, [c["payload"] for c in t])))
            yield _batch(out, ["file_id", "container"], [pa.string(), pa.binary()])

    return both.select("file_id", "n", "t").mapInArrow(run, "file_id string, container binary")


def from_files(containers: DataFrame) -> DataFrame:
    """file_id, container -> validated chunk tables with codec, offsets and payloads. A malformed file is an error."""
    ship(containers.sparkSession)
    names = ["file_id", "codec", "level", "chunk_size", "total_size", "chunk_no", "comp_offset", "comp_size", "stored", "uncomp_size", "checksum", "filter", "payload"]
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    schema = "file_id string, codec string, level int, chunk_size int, total_size long, chunk_no long, comp_offset long, comp_size long, stored boolean, uncomp_size long, checksum long, filter string, payload binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for file_id, data in _rows(batch):
                index = layout.Index.parse(data)
                index.validate(len(data) - index.data_offset)
                h = index.header
                for k, c in enumerate(index.chunks):
                    at = index.data_offset + c.comp_offset
                    out.append((file_id, h.codec, h.level, h.chunk_size, h.total_size, k, c.comp_offset, c.comp_size, c.stored, c.uncomp_size, c.checksum, c.filter, data[at : at + c.comp_size]))
            yield _batch(out, names, kinds)

    return containers.select("file_id", "container").mapInArrow(run, schema)


def splice(parts: DataFrame, header: Options) -> DataFrame:
    """(file_id, part, n, container): parts of consecutive chunks -> file_id, container of the whole (n: its size)."""
    ship(parts.sparkSession)
    grouped = parts.groupBy("file_id").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("part", "container"))), lambda x: x["container"]).alias("p"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for file_id, n, p in _rows(batch):
                whole = layout.Header(header.codec, header.chunk_size, layout.chunk_count(n, header.chunk_size), n, header.checksums, header.level)
                out.append((file_id, layout.splice(whole, [x for x in p if x is not None])))
            yield _batch(out, ["file_id", "container"], [pa.string(), pa.binary()])

    return grouped.select("file_id", "n", "p").mapInArrow(run, "file_id string, container binary")


def compress_parts(files: DataFrame, parts: list[tuple[int, Options]]) -> DataFrame:
    """(file_id, content) -> file_id, container: consecutive runs of chunks, each by its own encoder, spliced.

    parts has (chunks, options) of each run and must cover every file exactly. What the container's header
    says (codec, chunk size, level, checksums) must be the same in all; filters, dependency groups and the search may differ.
    """
    same = {(o.codec, o.chunk_size, o.level, o.checksums) for _, o in parts}
    if len(same) != 1 or any(n < 0 for n, _ in parts):
        raise layout.FormatError("BadSplit", "parts need one codec, chunk size, level and checksum rule, and counts from 0")
    options, covered = parts[0][1], sum(n for n, _ in parts)
    size = options.chunk_size
    n = F.octet_length("content").cast("long")
    count = F.floor((n + size - 1) / size).cast("long")
    whole = F.when(count == covered, n).otherwise(F.raise_error(F.concat(F.lit(f"BadSplit: parts cover {covered} chunks, the file has "), count.cast("string"))).cast("long"))
    cut, first = files.select("file_id", "content", whole.alias("whole")), 0
    runs = []
    for chunks, own in parts:
        if chunks:
            runs.append((cut.select("file_id", "whole", F.expr(f"substring(content, {first * size + 1}, {chunks * size})").alias("content")), own))
        first += chunks
    return _spliced(runs, options) if runs else splice(cut.select("file_id", F.lit(0).alias("part"), F.col("whole").alias("n"), F.lit(None).cast("binary").alias("container")), options)


def _spliced(runs: list[tuple[DataFrame, Options]], header: Options) -> DataFrame:
    """Runs (file_id, whole, content) with their encoders -> file_id, container."""
    made = None
    for k, (rows, own) in enumerate(runs):
        pieces = rows.select("file_id", "content", F.octet_length("content").cast("long").alias("n"))
        part = to_files(pieces, compress(pieces, own), own).select("file_id", F.lit(k).alias("part"), "container")
        part = part.join(rows.select("file_id", F.col("whole").alias("n")), "file_id").select("file_id", "part", "n", "container")
        made = part if made is None else made.unionByName(part)
    return splice(made, header)


def fixed_split(files: DataFrame, tail_share: float, options: Options = Options(), tail: Options | None = None) -> DataFrame:
    """Head and tail of each file's chunks as two containers, spliced: (file_id, content) -> file_id, container.

    The tail is the last tail_share of the chunks, halves rounded away from zero; it may have an encoder of its own.
    """
    tail = tail or options
    if (tail.codec, tail.chunk_size, tail.level, tail.checksums) != (options.codec, options.chunk_size, options.level, options.checksums):
        raise layout.FormatError("BadSplit", "head and tail need one codec, chunk size, level and checksum rule")
    size = options.chunk_size
    n = F.octet_length("content").cast("long")
    count = F.floor((n + size - 1) / size).cast("long")
    head = (count - F.floor(count * F.lit(tail_share) + 0.5).cast("long")) * size
    cut = files.select("file_id", "content", n.alias("whole"), F.least(n, head).cast("int").alias("h"))
    first = cut.select("file_id", "whole", F.expr("substring(content, 1, h)").alias("content"))
    last = cut.select("file_id", "whole", F.expr("substring(content, h + 1)").alias("content"))
    return _spliced([(first, options), (last, tail)], options)
