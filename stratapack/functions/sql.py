"""Filters, codecs and container arithmetic as SQL functions, by name."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from stratapack.functions import codecs, filters
from stratapack.functions.codecs import Options
from stratapack.functions.lz import BlockError
from stratapack.session import ship


def _each(function, kind: pa.DataType):
    """An Arrow UDF over rows; a row with a null argument gives null."""

    def run(*columns: pa.Array) -> pa.Array:
        rows = zip(*(c.to_pylist() for c in columns), strict=True)
        return pa.array([None if None in row else function(*row) for row in rows], kind)

    return run


def _decoded(payload: bytes, codec: str, size: int) -> bytes | None:
    try:
        return codecs.decode_chunk(payload, False, codec, size, "none")
    except BlockError:
        return None


#: Names with the result's type and the function of a row.
FUNCTIONS = {
    "sp_filter": ("binary", pa.binary(), filters.forward),
    "sp_unfilter": ("binary", pa.binary(), filters.inverse),
    "sp_encode": ("binary", pa.binary(), lambda data, codec, level: data if codec == "stored" else codecs.block(data, Options(codec=codec, level=level))),
    "sp_decode": ("binary", pa.binary(), _decoded),
    "sp_checksum": ("long", pa.int64(), codecs.checksum),
}

#: Expressions that Catalyst sees through.
EXPRESSIONS = {
    "sp_pad4(n BIGINT) RETURNS BIGINT": "(n + 3) DIV 4 * 4",
    "sp_chunk_count(n BIGINT, chunk_size BIGINT) RETURNS BIGINT": "(n + chunk_size - 1) DIV chunk_size",
    "sp_container_size(payload BIGINT, chunks BIGINT) RETURNS BIGINT": "32 + 24 * chunks + payload",
    "sp_max_block(n BIGINT) RETURNS BIGINT": "n + n DIV 255 + 16",
    "sp_zigzag(n BIGINT) RETURNS BIGINT": "shiftleft(n, 1) ^ shiftright(n, 63)",
    "sp_unzigzag(n BIGINT) RETURNS BIGINT": "shiftrightunsigned(n, 1) ^ -(n & 1)",
}


def register(spark: SparkSession) -> list[str]:
    """Make them callable from spark.sql; returns the names.

    sp_filter(data, name), sp_unfilter(data, name); sp_encode(data, codec, level) -> block, sp_decode(block, codec, size) -> data, null
    if the block is malformed; sp_checksum(data); and the EXPRESSIONS. Nulls give nulls.
    """
    ship(spark)
    for name, (kind, arrow, function) in FUNCTIONS.items():
        spark.udf.register(name, F.arrow_udf(_each(function, arrow), kind))
    for head, body in EXPRESSIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [*FUNCTIONS, *(head.partition("(")[0] for head in EXPRESSIONS)]
