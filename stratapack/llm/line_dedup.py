"""Line dedup over levelled sorted runs of line hashes.

The store (`LineRuns`) holds runs: tables of (h1, h2, owner), bucketed and sorted by
the two halves of a 128-bit line hash, so that a batch that is dealt out the same way
joins each of them by a merge without moving the run. A batch of documents brings its
distinct keys with their smallest doc_id; a merge-anti-join against each run leaves
the keys that are new, and these become a run of level 0. When a level holds `fanout`
runs, they are merged into one run of the next level. A key is in one run only, so
a merge is a union. A line stays if its document is the key's owner; the rest of a
batch's (key, document) pairs, found by one more anti-join against the new run, are
the lines to drop.

Batches are ranges of doc_id in ascending order, so that the owner is the smallest
doc_id of all. Keys with many documents are pre-aggregated in the map tasks;
the pairs of such a key are spread by AQE's skew splitting in the anti-join.

Cases: null or empty text is one empty line, which is too short to be a key. A null
doc_id counts as larger than any other. Rows that repeat a doc_id are one document for
ownership, and each row is cut alike. A document whose lines all go keeps the empty
text. Empty tables give empty results. Only doc_id and text are read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratapack.llm.common import SPACES, delete, rows_of, scratch, staged, table
from stratapack.session import ship

_SPACES = SPACES.encode()
_LAST = 9223372036854775807
LEAST_CHARS = 10
_PAIRS = "doc long, part long, h1 long, h2 long"


def line_keys(text: str | None, least: int = LEAST_CHARS) -> Iterator[tuple[bytes, bytes | None]]:
    """Each line with the 16-byte hash of its key, or None where the key is too short."""
    for line in (text or "").encode("utf-8", "surrogatepass").split(b"\n"):
        key = line.strip(_SPACES).lower()
        long = len(key) >= least and (key.isascii() or len(key.decode("utf-8", "replace")) >= least)
        yield line, xxhash.xxh3_128_digest(key) if long else None


def document_lines(docs: DataFrame, least: int = LEAST_CHARS) -> DataFrame:
    """Distinct (doc, part, h1, h2) of each row's keys. A null doc_id becomes the largest long, and part tells its texts apart by a hash (else 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, parts, digests = [], [], []
            for doc_id, text, part in rows_of(batch):
                found = {h for _, h in line_keys(text, least) if h}
                ids += [_LAST if doc_id is None else doc_id] * len(found)
                parts += [part] * len(found)
                digests += found
            halves = pa.py_buffer(b"".join(digests))
            both = pa.Array.from_buffers(pa.int64(), 2 * len(digests), [None, halves]).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(parts, pa.int64()), pa.array(both[0::2].copy()), pa.array(both[1::2].copy())], ["doc", "part", "h1", "h2"])

    return docs.select("doc_id", "text", _part()).mapInArrow(run, _PAIRS)


def _part() -> Column:
    """0 for rows with an id. Rows without one are one document, of any size, so their lists of lines to drop are kept by text."""
    return F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.lit(0).cast("long")).alias("part")


class LineRuns:
    """The levelled store. Runs are tables whose files lie in the folder that driver and executors share."""

    def __init__(self, spark: SparkSession, buckets: int | None = None, fanout: int = 3):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name, self.made = f"line_runs_{uuid.uuid4().hex}", 0
        self.levels: list[list[str]] = [[]]
        self.folders: dict[str, str] = {}

    def _write(self, rows: DataFrame) -> str:
        name = f"{self.name}_{self.made}"
        self.made += 1
        self.folders[name] = scratch(self.spark, "line-run")
        rows.repartition(self.buckets, "h1", "h2").write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").format("parquet").option("path", self.folders[name]).saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        delete(self.spark, self.folders.pop(name))

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(n) for level in self.levels for n in level]

    def ingest(self, pairs: DataFrame) -> DataFrame:
        """Add a batch of (doc, h1, h2) and more; returns the pairs whose lines go, written to the shared folder."""
        fresh = pairs.groupBy("h1", "h2").agg(F.min("doc").alias("owner"))
        for run in self.runs():
            fresh = fresh.join(run.hint("merge"), ["h1", "h2"], "left_anti")
        name = self._write(fresh)
        self.levels[0].append(name)
        owners = self.spark.table(name).withColumnRenamed("owner", "doc")
        drops = staged(pairs.join(owners, ["h1", "h2", "doc"], "left_anti").select(*pairs.columns), "line-drops")
        self._compact()
        return drops

    def _compact(self) -> None:
        level = 0
        while level < len(self.levels):
            names = self.levels[level]
            if len(names) >= self.fanout:
                rows = self.spark.table(names[0])
                for n in names[1:]:
                    rows = rows.unionByName(self.spark.table(n))
                merged = self._write(rows)
                for n in names:
                    self._drop(n)
                self.levels[level] = []
                if level + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[level + 1].append(merged)
            level += 1

    def close(self) -> None:
        for level in self.levels:
            for n in level:
                self._drop(n)
        self.levels = [[]]


def _without(docs: DataFrame, drops: DataFrame, least: int) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_text of each row."""
    # A list holds lines of one document (without an id: of one text), so it is no longer than that.
    gone = drops.groupBy("doc", "part").agg(F.collect_set(F.struct("h1", "h2")).alias("gone"))
    gone = gone.select("doc", "part", F.col("gone.h1").alias("g1"), F.col("gone.h2").alias("g2"))
    mine = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(_LAST)).alias("doc"), _part()).join(gone, ["doc", "part"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text, g1, g2 in rows_of(batch):
                if not g1:
                    out.append((doc_id, (text or "").count("\n") + 1, 0, text or ""))
                    continue
                gone = {a.to_bytes(8, "little", signed=True) + b.to_bytes(8, "little", signed=True) for a, b in zip(g1, g2, strict=True)}
                lines = list(line_keys(text, least))
                kept = [line for line, h in lines if h not in gone]
                out.append((doc_id, len(lines), len(lines) - len(kept), b"\n".join(kept).decode("utf-8", "surrogatepass")))
            cols = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["doc_id", "n_lines", "n_dropped", "kept_text"])

    return mine.select("doc_id", "text", "g1", "g2").mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept_text string")


def drop_repeated_lines(docs: DataFrame, batches: int = 4, least: int = LEAST_CHARS, fanout: int = 3) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_text. The documents arrive as `batches` ranges of doc_id, one after another."""
    spark = docs.sparkSession
    ship(spark)
    cuts = docs.select(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)], 10_000).alias("c")).first()["c"] if batches > 1 else []
    cuts = sorted(set(cuts or []))
    place = sum((F.when(F.col("doc") > c, 1).otherwise(0) for c in cuts), F.lit(0))
    pairs = staged(document_lines(docs, least).withColumn("batch", place.cast("int")), "line-pairs", by="batch")
    store, drops = LineRuns(spark, fanout=fanout), None
    try:
        for k in range(len(cuts) + 1):
            gone = store.ingest(pairs.filter(F.col("batch") == k).select("doc", "part", "h1", "h2"))
            drops = gone if drops is None else drops.unionByName(gone)
    finally:
        store.close()
    return _without(docs, drops, least)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drop_repeated_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
owners AS (SELECT key, min(doc_id) AS owner FROM keyed WHERE length(key) >= 10 GROUP BY key),
flagged AS (SELECT k.*, coalesce(o.owner <> k.doc_id, false) AS gone FROM keyed k LEFT JOIN owners o ON k.key = o.key)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM flagged GROUP BY doc_id
"""
