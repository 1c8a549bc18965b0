"""Byte and number transforms as relational plans: windows, position arithmetic, aggregates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratapack.functions import lz
from stratapack.session import ship, spread

#: Sequences that a Python worker holds before they leave as a batch.
_HELD = 1 << 16


def delta(rows: DataFrame, value: str, group: str, order: str | list[str], bits: int = 64, parts: int = 1) -> DataFrame:
    """Adds `delta`: the wrapping difference to the row before in the group; the first row keeps its value.

    With parts over 1, a group of any size is cut into ranges of its one, numeric order column; a range's first row
    gets the last value of the group's range before, so no task holds a whole group.
    """
    own = F.col(value).cast("long")
    if parts == 1:
        w = Window.partitionBy(group).orderBy(*([order] if isinstance(order, str) else order))
        before = F.lag(own).over(w)
    else:
        names, rows = rows.columns, ranged(rows, order, parts)
        ends = rows.groupBy(group, "_part").agg(F.max_by(own, order).alias("_end"))
        ends = ends.withColumn("_carried", F.lag("_end").over(Window.partitionBy(group).orderBy("_part"))).drop("_end")
        ends = ends.select(F.col(group).alias("_group"), F.col("_part").alias("_place"), "_carried")
        rows = rows.join(ends, rows[group].eqNullSafe(ends["_group"]) & (rows["_part"] == ends["_place"])).drop("_group", "_place")
        inside = F.lag(own).over(Window.partitionBy(group, "_part").orderBy(order))
        rows = rows.withColumn("_before", F.coalesce(inside, "_carried"))
        before = F.col("_before")
    step = own - F.coalesce(before, F.lit(0))
    out = rows.withColumn("delta", step.bitwiseAND(F.lit((1 << bits) - 1)) if bits < 64 else step)
    return out if parts == 1 else out.select(*names, "delta")


def ranged(rows: DataFrame, order: str, parts: int) -> DataFrame:
    """rows with `_part`: ranges of a numeric column between approximate quantiles, about equal in rows."""
    cuts = rows.select(F.percentile_approx(order, [k / parts for k in range(1, parts)], 10 * max(1000, parts)).alias("c")).first()["c"]
    cuts = F.array(*map(F.lit, sorted(set(cuts)))) if cuts else F.array().cast("array<long>")
    return rows.withColumn("_part", F.size(F.filter(cuts, lambda c: c < F.col(order))))


def undelta(rows: DataFrame, group: str, order: str | list[str], bits: int = 64) -> DataFrame:
    """Adds `value_back`: the running sum of `delta`, modulo 2^bits."""
    w = Window.partitionBy(group).orderBy(*([order] if isinstance(order, str) else order)).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("delta").over(w)
    return rows.withColumn("value_back", total.bitwiseAND(F.lit((1 << bits) - 1)) if bits < 64 else total)


def zigzag(d: Column) -> Column:
    """0, -1, 1, -2, ... -> 0, 1, 2, 3, ... of a signed long."""
    return F.shiftleft(d, 1).bitwiseXOR(F.shiftright(d, 63))


def unzigzag(z: Column) -> Column:
    return F.shiftrightunsigned(z, 1).bitwiseXOR(-z.bitwiseAND(F.lit(1).cast("long")))


def shuffled_bytes(rows: DataFrame, value: str, group: str, order: str, width: int) -> DataFrame:
    """(group, pos, byte): byte j of element i of a group of m goes to j * m + i."""
    w = Window.partitionBy(group)
    placed = rows.select(group, F.col(value).cast("long").alias("v"), (F.row_number().over(w.orderBy(order)) - 1).cast("long").alias("i"), F.count(F.lit(1)).over(w).alias("m"))
    placed = placed.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    byte = F.expr("shiftright(v, 8 * j) & 255")
    return placed.select(group, (F.col("j") * F.col("m") + F.col("i")).alias("pos"), byte.cast("long").alias("byte"))


def plane_counts(rows: DataFrame, value: str, group: str, bits: int) -> DataFrame:
    """(group, k, ones): set bits of each plane."""
    planes = rows.select(group, F.col(value).cast("long").alias("v"), F.explode(F.sequence(F.lit(0), F.lit(bits - 1))).alias("k"))
    return planes.groupBy(group, F.col("k").cast("long").alias("k")).agg(F.sum(F.expr("shiftright(v, k) & 1")).alias("ones"))


def byte_histogram(rows: DataFrame, group: str, data: str) -> DataFrame:
    """(group, symbol, cnt). Partial histograms in the tasks, summed by Spark: at most 256 rows a group and batch are shuffled."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: dict[object, np.ndarray] = {}
            for key, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                got = np.bincount(np.frombuffer(content or b"", np.uint8), minlength=256)
                total[key] = total[key] + got if key in total else got
            parts = [(k, np.flatnonzero(v), v) for k, v in total.items()]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k for k, at, _ in parts for _ in at], kind),
                    pa.array(np.concatenate([at for _, at, _ in parts]) if parts else [], pa.int64()),
                    pa.array(np.concatenate([v[at] for _, at, v in parts]) if parts else [], pa.int64()),
                ],
                ["g", "symbol", "cnt"],
            )

    spark_type = rows.select(group).schema[0].dataType.simpleString()
    kind = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}[spark_type]
    part = rows.select(F.col(group).alias("g"), F.col(data).alias("d")).mapInArrow(run, f"g {spark_type}, symbol long, cnt long")
    return part.groupBy(F.col("g").alias(group), "symbol").agg(F.sum("cnt").alias("cnt"))


def symbol_ranks(histogram: DataFrame, group: str) -> DataFrame:
    """Leaf order of the code tree: rank by (cnt, symbol) inside each group of at most 256 rows."""
    return histogram.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy("cnt", "symbol")).cast("long"))


def entropy_bits(histogram: DataFrame, group: str) -> DataFrame:
    """Order-0 entropy in bits a byte."""
    total = F.sum("cnt").over(Window.partitionBy(group))
    p = histogram.withColumn("p", F.col("cnt") / total)
    return p.groupBy(group).agg(F.round(-F.sum(F.col("p") * F.log2("p")), 6).alias("bits"))


def code_table(histogram: DataFrame, group: str) -> DataFrame:
    """(group, symbol, cnt, len, code): length-limited Huffman lengths from one small task a group, canonical codes by windows."""
    from stratapack.functions import entropy

    ship(histogram.sparkSession)

    def lengths(part: pa.Table) -> pa.Table:
        counts = np.zeros(256, np.int64)
        counts[part["symbol"].to_numpy()] = part["cnt"].to_numpy()
        found = entropy.code_lengths(counts) if (counts > 0).sum() > 1 else (counts > 0).astype(np.uint8)
        return part.append_column("len", pa.array(found[part["symbol"].to_numpy()].astype(np.int64)))

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in histogram.schema)
    sized = histogram.groupBy(group).applyInArrow(lengths, f"{kinds}, len long")
    # A canonical code is the sum of 2^-len of all codes before it, at its own length.
    before = Window.partitionBy(group).orderBy("len", "symbol").rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum(F.expr("shiftleft(1L, cast(11 - len as int))")).over(before), F.lit(0))
    return sized.withColumn("code", F.expr("1L") * F.shiftright(used, 0)).withColumn("code", F.expr("shiftright(code, cast(11 - len as int))"))


def match_candidates(files: DataFrame, chunk_size: int = 65536) -> DataFrame:
    """(file_id, content) -> file_id, chunk_no, positions, found, offsets: of each chunk's byte positions that a match may
    start from, how many have a candidate (the latest position of an earlier block with the same hash), and the sum of the distances.

    An as-of self-join inside a chunk: one sort and one binary search in an Arrow batch, and a row a chunk.
    """
    from stratapack.operators.chunks import split

    ship(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = []
            for data in batch["data"].to_pylist():
                first = lz.candidates(data)[1]
                at = np.flatnonzero(first >= 0)
                sums.append((len(first), len(at), int((at - first[at]).sum())))
            columns = list(zip(*sums, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([batch["file_id"], batch["chunk_no"], *(pa.array(c, pa.int64()) for c in columns)], ["file_id", "chunk_no", "positions", "found", "offsets"])

    return spread(split(files, chunk_size)).select("file_id", "chunk_no", "data").mapInArrow(run, "file_id string, chunk_no long, positions long, found long, offsets long")


def lazy_flags(rows: DataFrame, length: str, group: str | list[str], order: str | list[str], least: int = 4) -> DataFrame:
    """Adds `taken`: whether a match of this length is taken here, so is long enough and not shorter than the one at the next position."""
    w = Window.partitionBy(group).orderBy(order)
    return rows.withColumn("taken", (F.col(length) >= least) & ~F.coalesce(F.lead(length).over(w) > F.col(length), F.lit(False)))


def chain(candidates: DataFrame, depth: int) -> DataFrame:
    """(group, pos, candidate) -> group, pos, step, entry: up to `depth` links from each position, step 1 its candidate, each next one the
    candidate of the one before. An equi-join a step; a chain ends at a null."""
    link = candidates.filter("candidate IS NOT NULL").select("group", "pos", F.col("candidate").alias("entry"))
    back = link.select("group", F.col("pos").alias("entry"), F.col("entry").alias("_next"))
    step = link.withColumn("step", F.lit(1))
    out = step
    for k in range(2, depth + 1):
        step = step.join(back, ["group", "entry"]).select("group", "pos", F.col("_next").alias("entry"), F.lit(k).alias("step"))
        out = out.unionByName(step)
    return out.select("group", "pos", "step", "entry")


def segment_of(seqs: DataFrame, segments: DataFrame) -> DataFrame:
    """(file_id, seq_no) and (file_id, segment, first): each sequence with the last segment whose first sequence is not behind it.

    A range join as a union and a running value, so neither side is multiplied. Of segments with
    the same first, the last counts.
    """
    both = seqs.select("file_id", "seq_no", F.lit(1).alias("side"), F.lit(None).cast("long").alias("segment")).unionByName(
        segments.select("file_id", F.col("first").alias("seq_no"), F.lit(0).alias("side"), F.col("segment").cast("long").alias("segment"))
    )
    upto = Window.partitionBy("file_id").orderBy("seq_no", "side", "segment").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("segment", F.last("segment", ignorenulls=True).over(upto)).filter("side = 1").drop("side")


def sequence_table(files: DataFrame, chunk_size: int = 65536, level: int = 1) -> DataFrame:
    """(file_id, content) -> file_id, chunk_no, seq_no, lit_start, lit_len, match_len, offset of the parse."""
    from stratapack.operators.chunks import split

    ship(files.sparkSession)
    names = ["file_id", "chunk_no", "seq_no", "lit_start", "lit_len", "match_len", "offset"]

    def made(batch: pa.RecordBatch, found: dict[int, np.ndarray]) -> pa.RecordBatch:
        counts = [len(s) for s in found.values()]
        of = pa.array(np.repeat(list(found), counts))
        keys = [batch["file_id"].cast(pa.string()).take(of), batch["chunk_no"].take(of), pa.array(np.concatenate([np.arange(n) for n in counts]), pa.int64())]
        return pa.RecordBatch.from_arrays([*keys, *map(pa.array, np.concatenate(list(found.values())).T.copy())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A chunk has far more sequences than a batch may hold rows, so they leave after a few chunks, not after the batch.
        for batch in batches:
            found, held = {}, 0
            for i, data in enumerate(batch["data"]):
                found[i] = np.array(lz.sequences(data.as_py(), lz.for_level(level)), np.int64)
                held += len(found[i])
                if held >= _HELD:
                    yield made(batch, found)
                    found, held = {}, 0
            if found:
                yield made(batch, found)

    return spread(split(files, chunk_size)).mapInArrow(run, "file_id string, chunk_no long, seq_no long, lit_start long, lit_len long, match_len long, offset long")


def output_positions(seqs: DataFrame) -> DataFrame:
    """Prefix sums that free a sequence from those before it: out_at, lit_at, ext_at (escape slots)."""
    before = Window.partitionBy("file_id", "chunk_no").orderBy("seq_no").rowsBetween(Window.unboundedPreceding, -1)
    running = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0)).cast("long")
    escapes = (F.col("lit_len") >= 15).cast("long") + (F.col("match_len") >= 19).cast("long")
    return seqs.withColumn("out_at", running(F.col("lit_len") + F.col("match_len"))).withColumn("lit_at", running(F.col("lit_len"))).withColumn("ext_at", running(escapes))


def human_bytes(n: Column) -> Column:
    """1536 -> '1.5 KiB', 268435456 -> '256 MiB'."""
    unit = F.least(F.floor(F.log2(F.greatest(n, F.lit(1)).cast("double")) / 10 + F.lit(1e-12)), F.lit(4)).cast("int")
    scaled = F.regexp_replace(F.format_string("%.1f", F.bround(n / F.pow(F.lit(1024.0), unit), 1)), r"\.0$", "")
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).otherwise(F.concat_ws(" ", scaled, F.element_at(F.array(*map(F.lit, ("KiB", "MiB", "GiB", "TiB"))), F.greatest(unit, F.lit(1)))))


def run_file_name(date: Column, label: Column, adapter: Column) -> Column:
    return F.concat(F.regexp_replace(F.concat_ws("-", date, label, adapter), "[^A-Za-z0-9.-]", "-"), F.lit(".json"))
