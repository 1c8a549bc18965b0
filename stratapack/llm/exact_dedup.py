"""Exact dedup: 128-bit content hash, byte comparison inside groups, smallest stable id. Native.

Plan: one scan computes the normalised text and its MD5. Rows are aggregated by
(hash, normalised text): the aggregate's own key comparison compares the bytes inside
a hash group, and copies collapse in the map tasks, so a group that holds a
third of all rows reaches the shuffle as one row for each task. The group table that
leaves this step has no texts. A second scan joins (doc_id, hash) with it; AQE
splits the hot hash of that join, as each side asks for no more than the join's
own distribution. If, and only if, one hash had two different texts, those
hashes' rows are joined again by the texts themselves.

Cases: a null text counts as empty; empty texts are one group. A null doc_id ranks
as the largest id (9223372036854775807) and stays null in results. Rows that
repeat a doc_id and text are told apart by nothing, so all of them carry the same
decision. An empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratapack.llm.common import SPACES, staged, table, text_of

_BIG = 9223372036854775807


def normalised(text: Column) -> Column:
    """Without any of the six white-space characters. Six byte searches beat a per-character map."""
    for c in SPACES:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _rank(n_chars: Column, doc_id: Column) -> Column:
    """One number that is larger for more code points, then for a smaller id; a decimal stays in the hash aggregate."""
    wide = "decimal(20,0)"
    return (n_chars.cast(wide) * F.lit(1 << 32).cast(wide) * F.lit(1 << 32).cast("decimal(11,0)")).cast("decimal(38,0)") + (
        F.lit(_BIG).cast(wide) - F.coalesce(doc_id, F.lit(_BIG)).cast(wide)
    )


def _keeper(rank: Column) -> Column:
    two64 = F.lit("18446744073709551616").cast("decimal(20,0)")
    found = (F.lit(_BIG).cast("decimal(20,0)") - rank % two64).cast("long")
    return F.when(found != _BIG, found)


def exact_groups(docs: DataFrame, content_hash: Callable[[Column], Column] = F.md5) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_hash, text_sha256 (of the normalised text).

    The join's sides carry hashes only; texts move once, in the first aggregation.

    content_hash is a parameter so that tests can force collisions.
    """
    base = docs.select("doc_id", text_of().alias("t"))
    hashed = base.select("doc_id", F.length("t").alias("n"), normalised(F.col("t")).alias("norm_text"))
    hashed = hashed.withColumn("h", content_hash(F.col("norm_text")))
    groups = (
        hashed.groupBy("h", "norm_text")
        .agg(F.count(F.lit(1)).alias("group_size"), F.max(_rank(F.col("n"), F.col("doc_id"))).alias("r"))
        .select("h", "group_size", _keeper(F.col("r")).alias("keep_id"))
    )
    groups = staged(groups, "exact-groups")
    shared = groups.groupBy("h").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("h")
    clean = groups.select("h", "group_size", "keep_id")
    digests = hashed.select("doc_id", "h", F.sha2("norm_text", 256).alias("text_sha256"))
    if shared.isEmpty():
        out = digests.join(clean, "h")
    else:
        alone = digests.join(shared, "h", "left_anti").join(clean, "h")
        again = hashed.join(shared, "h", "left_semi")
        by_text = again.groupBy("norm_text").agg(F.count(F.lit(1)).alias("group_size"), F.max(_rank(F.col("n"), F.col("doc_id"))).alias("r"))
        by_text = by_text.select("norm_text", "group_size", _keeper(F.col("r")).alias("keep_id"))
        again = again.join(by_text, "norm_text").withColumn("text_sha256", F.sha2("norm_text", 256)).drop("norm_text", "n")
        out = alone.unionByName(again)
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("h").alias("text_hash"), "text_sha256")


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """docs without the rows of which another copy stays; all columns. Rows that repeat a kept doc_id and text stay once."""
    keep = exact_groups(docs.select("doc_id", "text")).filter("kept")
    keep = keep.groupBy(F.col("doc_id").alias("kept_id"), F.col("text_sha256").alias("kept_hash")).agg(F.count(F.lit(1)).alias("kept_times"))
    keep = staged(keep, "exact-kept")
    mine = F.sha2(normalised(F.coalesce(docs["text"], F.lit(""))), 256)
    out = docs.join(keep, docs["doc_id"].eqNullSafe(keep["kept_id"]) & (mine == keep["kept_hash"]), "left_semi")
    if not keep.filter("kept_times > 1").isEmpty():
        out = out.dropDuplicates(["doc_id", "text"])
    return out


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP10_SQL = """
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n,
                  regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS t FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY t ORDER BY n DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY t ORDER BY n DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS kept,
       sha256(t) AS text_sha256
FROM d
"""
