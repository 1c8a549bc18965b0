"""The relational plane: chunk layout, pruning, offsets, validation, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pad4(n: Column) -> Column:
    return F.floor((n + 3) / 4).cast("long") * 4


def layout(sizes: DataFrame, chunk_size: int) -> DataFrame:
    """(file_id, n) -> one row a chunk: file_id, chunk_no, uncomp_size. An empty file has none."""
    numbers = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / chunk_size).cast("long")))
    rows = sizes.filter("n > 0").select("file_id", "n", numbers.alias("chunk_no"))
    return rows.select("file_id", "chunk_no", F.least(F.lit(chunk_size).cast("long"), F.col("n") - F.col("chunk_no") * chunk_size).alias("uncomp_size"))


def split(files: DataFrame, chunk_size: int) -> DataFrame:
    """(file_id, content) -> file_id, chunk_no, data. Binary substring is a slice, so this is linear."""
    n = F.octet_length("content")
    rows = files.withColumn("chunk_no", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.floor((n - 1) / chunk_size)).cast("long"))))
    rows = rows.filter(F.octet_length("content") > 0)
    return rows.select("file_id", "chunk_no", F.expr(f"substring(content, cast(chunk_no * {chunk_size} + 1 as int), {chunk_size})").alias("data"))


def with_offsets(chunks: DataFrame) -> DataFrame:
    """Running padded payload offset inside each file."""
    before = Window.partitionBy("file_id").orderBy("chunk_no").rowsBetween(Window.unboundedPreceding, -1)
    return chunks.withColumn("comp_offset", F.coalesce(F.sum(pad4(F.col("comp_size"))).over(before), F.lit(0)).cast("long"))


def ranges_to_chunks(ranges: DataFrame, chunk_size: int) -> DataFrame:
    """(.., offset, len, n) -> adds status, first_chunk and last_chunk (null where none)."""
    ok = (F.col("offset") >= 0) & (F.col("len") >= 0) & (F.col("offset") + F.col("len") <= F.col("n"))
    some = ok & (F.col("len") > 0)
    return ranges.select(
        "*",
        F.when(ok, F.lit("ok")).otherwise(F.lit("RangeOutOfBounds")).alias("status"),
        F.when(some, F.floor(F.col("offset") / chunk_size).cast("long")).alias("first_chunk"),
        F.when(some, F.floor((F.col("offset") + F.col("len") - 1) / chunk_size).cast("long")).alias("last_chunk"),
    )


def overlaps(ranges: DataFrame, chunks: DataFrame, chunk_size: int) -> DataFrame:
    """Many ranges against a chunk table: each range is exploded to its chunk numbers, so the join is an equi-join."""
    placed = ranges_to_chunks(ranges, chunk_size).filter("first_chunk IS NOT NULL")
    placed = placed.withColumn("chunk_no", F.explode(F.sequence("first_chunk", "last_chunk")))
    begin = F.greatest(F.col("offset"), F.col("chunk_no") * chunk_size) - F.col("chunk_no") * chunk_size
    end = F.least(F.col("offset") + F.col("len"), F.col("chunk_no") * chunk_size + F.col("uncomp_size")) - F.col("chunk_no") * chunk_size
    return placed.join(chunks, ["file_id", "chunk_no"]).withColumn("from_byte", begin).withColumn("to_byte", end)


def violations(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """The first broken rule of each file: file_id, chunk_no, violation. files has data_len beside the header.

    Rules in order: size, alignment, overlap, bounds, stored size, stored codec, checksum.
    """
    by_file = Window.partitionBy("file_id").orderBy("chunk_no")
    rows = chunks.withColumn("free", F.coalesce(F.lag(pad4(F.col("comp_offset") + F.col("comp_size"))).over(by_file), F.lit(0))).join(files, "file_id")
    expected = F.least(F.col("chunk_size").cast("long"), F.col("total_size") - F.col("chunk_no") * F.col("chunk_size"))
    broken = (
        F.when(F.col("uncomp_size") != expected, "size")
        .when(F.col("comp_offset") % 4 != 0, "alignment")
        .when(F.col("comp_offset") < F.col("free"), "overlap")
        .when(pad4(F.col("comp_offset") + F.col("comp_size")) > F.col("data_len"), "bounds")
        .when(F.col("stored") & (F.col("comp_size") != F.col("uncomp_size")), "stored size")
        .when(~F.col("stored") & (F.col("codec") == "stored"), "stored codec")
        .when(~F.col("checksums") & (F.col("checksum") != 0), "checksum")
    )
    bad = rows.withColumn("violation", broken).filter("violation IS NOT NULL")
    return bad.groupBy("file_id").agg(F.min(F.struct("chunk_no", "violation")).alias("f")).select("file_id", "f.chunk_no", "f.violation")


def summary(chunks: DataFrame) -> DataFrame:
    """file_id, chunks, stored, original, compressed (with header and table), ratio, filters in first-seen order."""
    per = chunks.groupBy("file_id", "filter").agg(
        F.count(F.lit(1)).alias("c"), F.min("chunk_no").alias("seen"), F.sum(F.col("stored").cast("long")).alias("s"),
        F.sum("uncomp_size").alias("o"), F.sum(pad4(F.col("comp_size"))).alias("p"),
    )
    out = per.groupBy("file_id").agg(
        F.sum("c").alias("chunks"), F.sum("s").alias("stored"), F.sum("o").cast("long").alias("original"),
        (F.sum("p") + 24 * F.sum("c") + 32).cast("long").alias("compressed"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seen", F.concat_ws(" ", "filter", F.col("c").cast("string")).alias("t")))), lambda x: x["t"]), ", ").alias("filters"),
    )
    return out.withColumn("ratio", F.round(F.col("original") / F.col("compressed"), 4))


def smallest(trials: DataFrame) -> DataFrame:
    """(file_id, chunk_no, ord, filter, size) of trial encodings -> file_id, chunk_no, filter, size: each chunk's smallest, of equal ones the first by ord."""
    best = F.min_by(F.struct("filter", "size"), F.struct("size", "ord"))
    return trials.groupBy("file_id", "chunk_no").agg(best.alias("b")).select("file_id", "chunk_no", "b.*")


def payload_span(chunks: DataFrame) -> DataFrame:
    """file_id, low, high: where the payloads of a group of chunks begin and end, so that one read fetches them."""
    return chunks.groupBy("file_id").agg(F.min("comp_offset").alias("low"), F.max(F.col("comp_offset") + F.col("comp_size")).alias("high"))


def batches(chunks: DataFrame, budget: int, limit: int | None = None) -> DataFrame:
    """chunks with `batch`: consecutive runs of a file's chunks, each as long as its bytes stay within the budget; a chunk over it is alone.

    A chunk counts with its padded payload and its size, and with `limit` neither sum may pass that. The runs reset, which no
    window expresses, so a file's sizes (no payloads) are walked in order in one group.
    """
    import pyarrow as pa

    def walk(group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by("chunk_no")
        out, batch, source, target = [], 0, 0, 0
        for packed, plain in zip(group["comp_size"].to_pylist(), group["uncomp_size"].to_pylist(), strict=True):
            packed = -(-packed // 4) * 4
            over = source + target + packed + plain > budget or limit is not None and max(source + packed, target + plain) > limit
            if over and source + target:
                batch, source, target = batch + 1, 0, 0
            source, target = source + packed, target + plain
            out.append(batch)
        return pa.table({"file_id": group["file_id"], "chunk_no": group["chunk_no"], "batch": pa.array(out, pa.int64())})

    sizes = chunks.select(F.col("file_id").cast("string").alias("file_id"), "chunk_no", "comp_size", "uncomp_size")
    return chunks.join(sizes.groupBy("file_id").applyInArrow(walk, "file_id string, chunk_no long, batch long"), ["file_id", "chunk_no"])


def job_errors(jobs: DataFrame, source_len: int, target_len: int) -> DataFrame:
    """The first invalid filter job: (job, width, src_offset, dst_offset, len) -> job, error; no row if all are valid.

    Width 0 is no filter and not checked. In order: width, alignment, bounds for each job, then two targets that overlap. Overlaps are found between neighbours by
    target (if any two overlap, so do neighbours), not by a self-join.
    """
    own = (
        F.when(~F.col("width").isin(1, 2, 4, 8), "width")
        .when((F.col("src_offset") % 4 != 0) | (F.col("dst_offset") % 4 != 0), "alignment")
        .when((F.col("src_offset") + F.col("len") > source_len) | (F.col("dst_offset") + F.col("len") > target_len), "bounds")
    )
    rows = jobs.filter("width <> 0").withColumn("error", own)
    # Ranges of targets of about equal count; the last job of the ranges before reaches over by its end.
    by_target = Window.partitionBy("part").orderBy("dst_offset", F.col("dst_offset") + F.col("len"), "job")
    placed = rows.withColumn("end", F.col("dst_offset") + F.col("len")).withColumn("part", F.floor(F.col("dst_offset") / max(1, target_len // 64)))
    before = F.max("end").over(by_target.rowsBetween(Window.unboundedPreceding, -1))
    tops = placed.groupBy("part").agg(F.max("end").alias("top"))
    left = tops.select("part", F.max("top").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("left"))
    met = placed.withColumn("before", before).join(left, "part")
    overlap = F.when(F.greatest("before", "left") > F.col("dst_offset"), "overlap")
    bad = met.select("job", "error", overlap.alias("overlap"), "dst_offset").filter("error IS NOT NULL OR overlap IS NOT NULL")
    rank = F.struct(F.when(F.col("error").isNotNull(), 0).otherwise(1).alias("kind"), F.when(F.col("error").isNotNull(), F.col("job")).otherwise(F.col("dst_offset")).alias("at"), "job")
    first = bad.agg(F.min_by(F.struct("job", F.coalesce("error", "overlap").alias("error")), rank).alias("f"))
    return first.filter("f IS NOT NULL").select("f.job", "f.error")


def with_empty(files: DataFrame, summaries: DataFrame) -> DataFrame:
    """summary() of all files: one without chunks is a header of 32 bytes."""
    whole = files.select("file_id").join(summaries, "file_id", "left")
    return whole.fillna({"chunks": 0, "stored": 0, "original": 0, "compressed": 32, "filters": "", "ratio": 0.0})
