"""Command line: compress, decompress and info of container files.

python -m stratapack compress IN OUT [--codec C] [--chunk-size N] [--level N] [--filter F] [--groups N] [--checksums] [--tail-share S]
python -m stratapack decompress IN OUT [--offset N] [--length N]
python -m stratapack info [IN]

Sizes take K, M and G. Paths may be in any store that Spark reads. The exit code is 0, or 1 with a message for a file that is
malformed or a range outside it, or 2 for wrong arguments.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratapack.functions import layout
from stratapack.functions.codecs import CODECS, Options
from stratapack.functions.filters import FULL_CANDIDATES
from stratapack.operators import chunks as plane
from stratapack.operators import container, relational
from stratapack.session import staged
from stratapack.sources import files


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="stratapack")
    commands = top.add_subparsers(dest="command", required=True)
    pack = commands.add_parser("compress", help="a file to a container")
    pack.add_argument("input")
    pack.add_argument("output")
    pack.add_argument("--codec", choices=CODECS, default="lz4")
    pack.add_argument("--chunk-size", type=layout.parse_size, default=65536)
    pack.add_argument("--level", type=int, default=1)
    pack.add_argument("--filter", default="none", choices=("auto", "exhaustive", *FULL_CANDIDATES))
    pack.add_argument("--groups", type=int)
    pack.add_argument("--checksums", action="store_true")
    pack.add_argument("--tail-share", type=layout.parse_share, help="encode the last share of the chunks apart and splice")
    unpack = commands.add_parser("decompress", help="a container, or a byte range of it, to a file")
    unpack.add_argument("input")
    unpack.add_argument("output")
    unpack.add_argument("--offset", type=layout.parse_bytes, default=0)
    unpack.add_argument("--length", type=layout.parse_bytes)
    info = commands.add_parser("info", help="what a container holds; without one, where this runs")
    info.add_argument("input", nargs="?")
    return top


def compress(spark: SparkSession, a: argparse.Namespace) -> str:
    options = Options(a.codec, a.chunk_size, a.level, a.filter, a.checksums, a.groups)
    rows = files.raw_files(spark, a.input)
    # Spark's reader has no row for an empty file.
    total = rows.agg(F.coalesce(F.sum(F.octet_length("content")), F.lit(0))).first()[0]
    made = container.compress(rows, options) if a.tail_share is None else container.from_files(container.fixed_split(rows, a.tail_share, options))
    packed = container.save_container(staged(made, "cli-chunks"), total, options, a.output)
    return f"{total} -> {packed} bytes, ratio {total / packed:.2f}"


def _table(spark: SparkSession, path: str) -> tuple[layout.Header, DataFrame]:
    """Header and chunk table of a container, which is validated before a row is read."""
    data = files.raw_files(spark, path)
    head = bytes(data.select(F.expr("substring(content, 1, 32)")).first()[0])
    return layout.Header.parse(head), container.from_files(data.withColumnRenamed("content", "container"))


def decompress(spark: SparkSession, a: argparse.Namespace) -> str:
    header, rows = _table(spark, a.input)
    length = header.total_size - a.offset if a.length is None else a.length
    wanted = layout.chunks_for_range(header.total_size, header.chunk_size, a.offset, length)
    first, last = (wanted[0], wanted[-1]) if wanted else (0, -1)
    decoded = container.decode(rows.filter(F.col("chunk_no").between(first, last)), header.codec, header.checksums)
    # The first and the last chunk are cut to the range.
    low = F.greatest(F.lit(a.offset) - F.col("chunk_no") * header.chunk_size, F.lit(0)).cast("int")
    high = F.least(F.lit(a.offset + length) - F.col("chunk_no") * header.chunk_size, F.lit(header.chunk_size)).cast("int")
    cut = decoded.withColumn("low", low).withColumn("high", high).withColumn("data", F.expr("substring(data, low + 1, high - low)"))
    return f"{container.save_bytes(cut, a.output)} bytes"


def info(spark: SparkSession, a: argparse.Namespace) -> str:
    if not a.input:
        return "\n".join(f"{k}: {v}" for k, v in files.host_facts(spark).items())
    header, rows = _table(spark, a.input)
    found = plane.with_empty(files.raw_files(spark, a.input), plane.summary(rows)).select("*", relational.human_bytes(F.col("original")).alias("shown")).first()
    return (
        f"codec {header.codec}, level {header.level}, chunks of {header.chunk_size} bytes, checksums {'yes' if header.checksums else 'no'}\n"
        f"{found['chunks']} chunks, {found['stored']} stored; filters: {found['filters'] or '-'}\n"
        f"{found['original']} bytes ({found['shown']}) in {found['compressed']}, ratio {found['ratio']:.2f}"
    )


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(arguments)
    own = spark is None
    spark = spark or SparkSession.builder.appName("stratapack").config("spark.ui.enabled", "false").getOrCreate()
    try:
        print({"compress": compress, "decompress": decompress, "info": info}[a.command](spark, a))
        return 0
    except (ValueError, PySparkException) as e:
        print(f"error: {str(e).strip().splitlines()[-1] if isinstance(e, PySparkException) else e}", file=sys.stderr)
        return 1
    finally:
        if own:
            spark.stop()
