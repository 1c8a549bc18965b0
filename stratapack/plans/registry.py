"""The library's queries over the driver's tables, each with DuckDB SQL that computes the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratapack.functions.codecs import Options
from stratapack.operators import chunks, container, measures, relational
from stratapack.session import scratch, ship

CHUNK = 4096

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(c: str) -> Column:
    return F.encode(F.coalesce(F.col(c), F.lit("")), "UTF-8")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("file_id"), utf8("text").alias("content"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("file_id"), utf8("html").alias("content"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("file_id"), utf8("text").alias("content"))


def digests(files: DataFrame, back: DataFrame, key: str) -> DataFrame:
    """(key, md5, shrunk) of decoded files: whether a file of 2,000 bytes or more took fewer. A file without chunks is empty."""
    found = files.select("file_id", F.octet_length("content").cast("long").alias("n")).join(back, "file_id", "left")
    return found.select(F.col("file_id").alias(key), F.md5(F.coalesce("content", F.lit(b""))).alias("digest"), ((F.col("n") >= 2000) & (F.col("packed") < F.col("n"))).alias("shrunk"))


def round_trip(files: DataFrame, key: str, options: Options) -> DataFrame:
    return digests(files, container.decompress(container.compress(files, options), options.codec, options.checksums), key)


_DOC_MD5 = "SELECT CAST(doc_id AS VARCHAR) AS doc_id, md5(coalesce(text, '')) AS digest, octet_length(encode(coalesce(text, ''))) >= 2000 AS shrunk FROM documents"
_PAGE_MD5 = "SELECT CAST(page_id AS VARCHAR) AS page_id, md5(coalesce(html, '')) AS digest, octet_length(encode(coalesce(html, ''))) >= 2000 AS shrunk FROM pages"
_TURN_MD5 = "SELECT conv_id || '-' || turn AS turn_id, md5(coalesce(text, '')) AS digest, octet_length(encode(coalesce(text, ''))) >= 2000 AS shrunk FROM conversations"
_TURN_STORED = "SELECT conv_id || '-' || turn AS turn_id, md5(coalesce(text, '')) AS digest, false AS shrunk FROM conversations"


@query(_DOC_MD5)
def container_round_trip(spark, sf_dir):
    """Texts to containers and back: chunk, filter, encode, assemble, parse, validate, decode."""
    files, options = documents(spark, sf_dir), Options(codec="lz4", chunk_size=CHUNK, checksums=True)
    sizes = files.select("file_id", F.octet_length("content").cast("long").alias("n"))
    made = container.to_files(sizes, container.compress(files, options), options)
    return digests(files, container.decompress(container.from_files(made), "lz4", verify=True), "doc_id")


@query(_DOC_MD5)
def lz4_roundtrip(spark, sf_dir):
    return round_trip(documents(spark, sf_dir), "doc_id", Options(codec="lz4"))


@query(_PAGE_MD5)
def lz4_level3_roundtrip(spark, sf_dir):
    return round_trip(pages(spark, sf_dir), "page_id", Options(codec="lz4", level=3))


@query(_PAGE_MD5)
def glz_roundtrip(spark, sf_dir):
    return round_trip(pages(spark, sf_dir), "page_id", Options(codec="glz", level=2))


@query(_TURN_MD5)
def glz_groups_roundtrip(spark, sf_dir):
    return round_trip(turns(spark, sf_dir), "turn_id", Options(codec="glz", groups=32))


@query(_DOC_MD5)
def glze_roundtrip(spark, sf_dir):
    return round_trip(documents(spark, sf_dir), "doc_id", Options(codec="glze", checksums=True))


@query(_TURN_STORED)
def stored_roundtrip(spark, sf_dir):
    return round_trip(turns(spark, sf_dir), "turn_id", Options(codec="stored", chunk_size=CHUNK))


@query(_PAGE_MD5)
def auto_filter_roundtrip(spark, sf_dir):
    return round_trip(pages(spark, sf_dir), "page_id", Options(codec="lz4", filters="auto"))


@query(_PAGE_MD5)
def splice_roundtrip(spark, sf_dir):
    """Each page's chunks as two containers, spliced to one, parsed and decoded."""
    files, options = pages(spark, sf_dir), Options(codec="glz", chunk_size=CHUNK)
    return digests(files, container.decompress(container.from_files(container.fixed_split(files, 0.5, options)), "glz"), "page_id")


@query(_PAGE_MD5)
def fixed_split_roundtrip(spark, sf_dir):
    files, options = pages(spark, sf_dir), Options(codec="lz4", chunk_size=CHUNK)
    return digests(files, container.decompress(container.from_files(container.fixed_split(files, 0.25, options)), "lz4"), "page_id")


@query(_PAGE_MD5)
def hybrid_roundtrip(spark, sf_dir):
    """Head and tail by different encoders: the tail with filters and independent groups."""
    files, options = pages(spark, sf_dir), Options(codec="glz", chunk_size=CHUNK)
    made = container.fixed_split(files, 0.5, options, Options(codec="glz", chunk_size=CHUNK, filters="auto", groups=16))
    return digests(files, container.decompress(container.from_files(made), "glz"), "page_id")


@query(_PAGE_MD5)
def stream_roundtrip(spark, sf_dir):
    """Containers of what a file stream compressed, which ends when everything is read."""
    from stratapack.streaming import compress

    place, rows = scratch(spark, "stream"), pages(spark, sf_dir)
    rows.write.parquet(f"{place}/in")
    compress.compress_stream(spark, f"{place}/in", rows.schema, "file_id", "content", f"{place}/out", f"{place}/state").awaitTermination()
    made = compress.containers_of(spark, f"{place}/out", rows.select("file_id", F.octet_length("content").cast("long").alias("n")))
    return digests(rows, container.decompress(container.from_files(made), "lz4"), "page_id")


@query("""
SELECT CAST(doc_id AS VARCHAR) AS file_id, k AS chunk_no, least(4096, n - k * 4096) AS uncomp_size
FROM (SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents), LATERAL (SELECT unnest(range(0, (n + 4095) // 4096)) AS k)
""")
def chunk_layout(spark, sf_dir):
    sizes = documents(spark, sf_dir).select("file_id", F.octet_length("content").cast("long").alias("n"))
    return chunks.layout(sizes, CHUNK)


_RANGES_SQL = """
d AS (SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents),
r AS (SELECT event_id AS range_id, event_id * 7919 % (SELECT max(doc_id) + 1 FROM documents) AS doc_id FROM events),
x AS (SELECT range_id, CAST(r.doc_id AS VARCHAR) AS file_id, range_id * 977 % (n + 1) AS o, range_id * 131 % (n // 2 + 9) AS l, n FROM r JOIN d ON r.doc_id = d.doc_id)
"""


def _ranges(spark, sf_dir) -> DataFrame:
    """A byte range for each event: documents of the whole table, places in whole texts, some of them past the end."""
    e, docs = F.col("range_id"), documents(spark, sf_dir)
    ids = (docs.agg(F.max(F.col("file_id").cast("long"))).first()[0] or 0) + 1
    asked = table(spark, sf_dir, "events").select(F.col("event_id").alias("range_id"))
    asked = asked.select(e, (e * 7919 % F.lit(ids)).cast("string").alias("file_id")).join(docs.select("file_id", F.octet_length("content").cast("long").alias("n")), "file_id")
    return asked.select(e, "file_id", (e * 977 % (F.col("n") + 1)).alias("offset"), (e * 131 % (F.floor(F.col("n") / 2) + 9)).alias("len"), "n")


@query(f"""WITH {_RANGES_SQL}
SELECT range_id, file_id, CASE WHEN o + l <= n THEN 'ok' ELSE 'RangeOutOfBounds' END AS status,
       CASE WHEN o + l <= n AND l > 0 THEN o // 4096 ELSE -1 END AS first_chunk, CASE WHEN o + l <= n AND l > 0 THEN (o + l - 1) // 4096 ELSE -1 END AS last_chunk
FROM x""")
def range_chunks(spark, sf_dir):
    return chunks.ranges_to_chunks(_ranges(spark, sf_dir), CHUNK).select("range_id", "file_id", "status", *(F.coalesce(c, F.lit(-1).cast("long")).alias(c) for c in ("first_chunk", "last_chunk")))


@query(f"""WITH {_RANGES_SQL}
SELECT range_id, file_id, k AS chunk_no, greatest(o, k * 4096) - k * 4096 AS from_byte, least(o + l, least(n, (k + 1) * 4096)) - k * 4096 AS to_byte
FROM (SELECT *, unnest(range(o // 4096, (o + l - 1) // 4096 + 1)) AS k FROM x WHERE o + l <= n AND l > 0)""")
def range_join(spark, sf_dir):
    sizes = documents(spark, sf_dir).select("file_id", F.octet_length("content").cast("long").alias("n"))
    found = chunks.overlaps(_ranges(spark, sf_dir), chunks.layout(sizes, CHUNK), CHUNK)
    return found.select("range_id", "file_id", "chunk_no", "from_byte", "to_byte")


@query("""
SELECT doc_id AS range_id, upper(substr(hex(encode(coalesce(text, ''))), CAST(2 * (doc_id * 37 % (n + 1)) + 1 AS BIGINT), CAST(2 * least(1000, n - doc_id * 37 % (n + 1)) AS BIGINT))) AS part
FROM (SELECT *, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents)
""")
def range_read(spark, sf_dir):
    """A byte range of every document from its compressed chunks; only the overlapping ones are decoded."""
    files = documents(spark, sf_dir)
    packed = container.compress(files, Options(codec="lz4", chunk_size=CHUNK))
    n = F.octet_length("content").cast("long")
    asked = files.select(F.col("file_id").cast("long").alias("range_id"), "file_id", n.alias("n")).withColumn("offset", F.col("range_id") * 37 % (F.col("n") + 1))
    asked = asked.withColumn("len", F.least(F.lit(1000).cast("long"), F.col("n") - F.col("offset")))
    return container.read_ranges(packed, asked, "lz4", CHUNK).select("range_id", F.hex("part").alias("part"))


@query("""
SELECT CAST(page_id // 64 AS VARCHAR) AS file_id, page_id AS chunk_no, n AS comp_size,
       coalesce(CAST(sum((n + 3) // 4 * 4) OVER (PARTITION BY page_id // 64 ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS comp_offset
FROM (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n FROM pages)
""")
def payload_offsets(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select(F.expr("cast(page_id div 64 as string)").alias("file_id"), F.col("page_id").alias("chunk_no"), F.octet_length(utf8("html")).cast("long").alias("comp_size"))
    return chunks.with_offsets(rows)


@query("""
SELECT CAST(doc_id AS VARCHAR) AS file_id, (n + 4095) // 4096 AS chunks, (n + 4095) // 4096 AS stored, n AS original,
       32 + 24 * ((n + 4095) // 4096) + (n + 3) // 4 * 4 AS compressed, CASE WHEN n > 0 THEN 'none ' || ((n + 4095) // 4096) ELSE '' END AS filters,
       round(n / (32 + 24 * ((n + 4095) // 4096) + (n + 3) // 4 * 4), 4) AS ratio
FROM (SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents)
""")
def container_info(spark, sf_dir):
    files = documents(spark, sf_dir)
    return chunks.with_empty(files, chunks.summary(container.compress(files, Options(codec="stored", chunk_size=CHUNK))))


@query("""
SELECT CAST(doc_id AS VARCHAR) AS file_id, (n - 1) // 4096 AS chunk_no,
       CASE doc_id % 8 WHEN 1 THEN 'size' WHEN 2 THEN 'alignment' WHEN 3 THEN 'overlap' WHEN 4 THEN 'bounds' WHEN 5 THEN 'stored size' WHEN 6 THEN 'stored codec' WHEN 7 THEN 'checksum' END AS violation
FROM (SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents) WHERE n > 0 AND doc_id % 8 <> 0
""")
def index_violations(spark, sf_dir):
    """Chunk tables of which the last entry is spoilt in one way; the first broken rule is reported."""
    sizes = documents(spark, sf_dir).select("file_id", F.octet_length("content").cast("long").alias("n"))
    good = chunks.with_offsets(chunks.layout(sizes, CHUNK).withColumn("comp_size", F.col("uncomp_size"))).join(sizes, "file_id")
    last, kind = F.expr("chunk_no = (n - 1) div 4096"), F.col("file_id").cast("long") % 8
    way = lambda k, value, column: F.when(last & (kind == k), value).otherwise(F.col(column)).alias(column)
    spoilt = good.select(
        "file_id", "chunk_no", way(1, F.col("uncomp_size") + 1, "uncomp_size"),
        F.when(last & (kind == 2), F.col("comp_offset") + 2).when(last & (kind == 3), F.col("comp_offset") - 4).when(last & (kind == 4), F.col("comp_offset") + 4096).otherwise(F.col("comp_offset")).alias("comp_offset"),
        F.when(last & (kind == 5), F.col("comp_size") - 1).otherwise(F.col("comp_size")).alias("comp_size"),
        (~(last & (kind == 6))).alias("stored"), F.when(last & (kind == 7), 1).otherwise(0).alias("checksum"),
    )
    heads = sizes.select("file_id", F.lit("stored").alias("codec"), F.lit(CHUNK).alias("chunk_size"), F.col("n").alias("total_size"), F.lit(False).alias("checksums"), chunks.pad4(F.col("n")).alias("data_len"))
    return chunks.violations(heads, spoilt)


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_linenumber - lag(l_linenumber, 1, 0) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)) & 4294967295 AS delta FROM lineitem")
def delta_i32(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    return relational.delta(rows, "l_linenumber", "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], 32).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "delta")


@query("SELECT o_orderkey, o_custkey, o_orderkey - lag(o_orderkey, 1, 0) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS delta FROM orders")
def delta_i64(spark, sf_dir):
    return relational.delta(table(spark, sf_dir, "orders"), "o_orderkey", "o_custkey", "o_orderkey").select("o_orderkey", "o_custkey", "delta")


@query("SELECT o_orderkey, o_custkey, o_orderkey AS value_back FROM orders")
def undelta(spark, sf_dir):
    there = relational.delta(table(spark, sf_dir, "orders"), "o_orderkey", "o_custkey", "o_orderkey")
    return relational.undelta(there, "o_custkey", "o_orderkey").select("o_orderkey", "o_custkey", "value_back")


@query("""
SELECT event_id, CASE WHEN d >= 0 THEN 2 * d ELSE -2 * d - 1 END AS z, d AS back
FROM (SELECT event_id, user_id - lag(user_id, 1, 0) OVER (PARTITION BY event_type ORDER BY event_id) AS d FROM events)
""")
def zigzag_events(spark, sf_dir):
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = relational.delta(table(spark, sf_dir, "events"), "user_id", "event_type", "event_id", parts=parts)
    return rows.withColumn("z", relational.zigzag(F.col("delta"))).select("event_id", "z", relational.unzigzag(F.col("z")).alias("back"))


@query("""
SELECT o_custkey, j * m + i AS pos, (v >> CAST(8 * j AS INTEGER)) & 255 AS byte
FROM (SELECT o_custkey, o_orderkey AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_custkey) AS m FROM orders), (SELECT unnest(range(0, 4)) AS j)
""")
def shuffle_planes(spark, sf_dir):
    return relational.shuffled_bytes(table(spark, sf_dir, "orders"), "o_orderkey", "o_custkey", "o_orderkey", 4)


@query("SELECT p_brand, k, CAST(sum((p_size >> CAST(k AS INTEGER)) & 1) AS BIGINT) AS ones FROM part, (SELECT unnest(range(0, 8)) AS k) GROUP BY p_brand, k")
def bit_planes(spark, sf_dir):
    return relational.plane_counts(table(spark, sf_dir, "part"), "p_size", "p_brand", 8)


_BYTES_SQL = """
b AS (SELECT lang, ('0x' || h)::INTEGER::BIGINT AS symbol, count(*) AS cnt FROM (SELECT lang, unnest(regexp_extract_all(hex(encode(coalesce(text, ''))), '..')) AS h FROM documents) GROUP BY lang, h)
"""


def _language_bytes(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("lang", utf8("text").alias("d"))
    return relational.byte_histogram(rows, "lang", "d")


@query(f"WITH {_BYTES_SQL} SELECT lang, symbol, cnt FROM b")
def byte_histogram(spark, sf_dir):
    return _language_bytes(spark, sf_dir)


@query(f"WITH {_BYTES_SQL} SELECT lang, symbol, cnt, row_number() OVER (PARTITION BY lang ORDER BY cnt, symbol) AS rank FROM b")
def symbol_rank(spark, sf_dir):
    return relational.symbol_ranks(_language_bytes(spark, sf_dir), "lang")


@query(f"WITH {_BYTES_SQL} SELECT lang, round(-sum(p * log2(p)), 6) AS bits FROM (SELECT lang, cnt / sum(cnt) OVER (PARTITION BY lang) AS p FROM b) GROUP BY lang")
def entropy_bits(spark, sf_dir):
    return relational.entropy_bits(_language_bytes(spark, sf_dir), "lang")


@query("SELECT lang, 2048 AS kraft, true AS ordered FROM documents GROUP BY lang")
def kraft_check(spark, sf_dir):
    """Length-limited code of each language's bytes: complete, and no rarer byte has a shorter code."""
    codes = relational.code_table(_language_bytes(spark, sf_dir), "lang")
    ranked = relational.symbol_ranks(codes, "lang")
    lag = F.lag("len").over(Window.partitionBy("lang").orderBy("rank"))
    ranked = ranked.withColumn("falls", F.coalesce(lag >= F.col("len"), F.lit(True)))
    return ranked.groupBy("lang").agg(F.sum(F.expr("shiftleft(1, cast(11 - len as int))")).cast("int").alias("kraft"), F.min("falls").alias("ordered"))


@query(f"""
WITH RECURSIVE {_BYTES_SQL},
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY cnt, symbol) AS place FROM b),
tree AS (
  SELECT lang, 0 AS age, list_sort(list({{'w': cnt, 'node': 0, 'age': place, 'm': [{{'s': symbol, 'd': 0}}]}})) AS q FROM r GROUP BY lang
  UNION ALL
  SELECT lang, age + 1, list_sort(list_append(q[3:], {{'w': q[1].w + q[2].w, 'node': 1, 'age': CAST(age + 1 AS BIGINT), 'm': [{{'s': x.s, 'd': x.d + 1}} for x in list_concat(q[1].m, q[2].m)]}})) FROM tree WHERE len(q) > 1),
depth AS (SELECT lang, unnest(q[1].m).d AS d FROM tree WHERE len(q) = 1),
held AS (SELECT lang, d, count(*) AS n FROM depth GROUP BY lang, d),
counts AS (
  SELECT lang, [coalesce(list_sum([x.n for x in l if x.d = i]), 0)::BIGINT for i in range(1, 65)] AS n FROM (SELECT lang, list({{'d': d, 'n': n}}) AS l FROM held GROUP BY lang)
  UNION ALL
  SELECT lang, [n[i] - CASE WHEN i = deep THEN 2 ELSE 0 END + CASE WHEN i = deep - 1 THEN 1 ELSE 0 END - CASE WHEN i = above THEN 1 ELSE 0 END + CASE WHEN i = above + 1 THEN 2 ELSE 0 END for i in range(1, 65)]
  FROM (SELECT *, list_max([i for i in range(1, deep - 1) if n[i] > 0]) AS above FROM (SELECT *, list_max([i for i in range(1, 65) if n[i] > 0]) AS deep FROM counts) WHERE deep > 11)),
sized AS (SELECT r.lang, symbol, cnt, list_max([s for s in range(1, 12) if place <= list_sum(n[s:])]) AS len FROM r JOIN counts c ON r.lang = c.lang WHERE list_sum(n[12:]) = 0)
SELECT lang, symbol, cnt, len, coalesce(CAST(sum(1 << CAST(11 - len AS INTEGER)) OVER (PARTITION BY lang ORDER BY len, symbol ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) >> CAST(11 - len AS INTEGER) AS code FROM sized
""")
def code_table(spark, sf_dir):
    """Length-limited canonical code of each language's bytes. The SQL merges the two lightest trees until one is left, folds
    depths beyond 11 back, and hands the lengths out, longest first."""
    return relational.code_table(_language_bytes(spark, sf_dir), "lang")


@query("""
WITH b AS (SELECT page_id, unnest(l) AS h, unnest(range(0, len(l))) AS p, len(l) AS n FROM (SELECT page_id, regexp_extract_all(hex(encode(coalesce(html, ''))), '..') AS l FROM pages)),
v AS (SELECT page_id, p, n, ('0x' || h)::INTEGER::BIGINT AS b FROM b),
w AS (SELECT page_id, p, n, b + 256 * lead(b, 1) OVER s + 65536 * lead(b, 2) OVER s + 16777216 * lead(b, 3) OVER s AS w FROM v WINDOW s AS (PARTITION BY page_id, p // 65536 ORDER BY p)),
h AS (SELECT page_id, p // 65536 AS c, p % 65536 AS pos, ((((w >> 16) * 2654435761) % 65536) * 65536 + (w & 65535) * 2654435761) % 4294967296 >> 20 AS h FROM w WHERE p % 65536 <= least(65536, n - p // 65536 * 65536) - 12),
m AS (SELECT page_id, c, pos, max(pos) OVER (PARTITION BY page_id, c, h ORDER BY pos // 128 RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS candidate FROM h)
SELECT CAST(page_id AS VARCHAR) AS file_id, count(*) AS positions, count(candidate) AS found, CAST(coalesce(sum(pos - candidate), 0) AS BIGINT) AS offsets FROM m GROUP BY page_id
""")
def match_candidates(spark, sf_dir):
    """Hash candidates of every byte position of every page, summed for each page. Pages too short for a match have no position and no row."""
    found = relational.match_candidates(pages(spark, sf_dir)).filter("positions > 0")
    return found.groupBy("file_id").agg(*(F.sum(c).alias(c) for c in ("positions", "found", "offsets")))


@query("SELECT CAST(page_id AS VARCHAR) AS file_id, CAST(octet_length(encode(html)) AS BIGINT) AS original, true AS gapless FROM pages WHERE octet_length(encode(html)) > 0")
def sequence_sums(spark, sf_dir):
    """Parsed sequences tile every page: lengths add up to its bytes, and literal starts follow the prefix sums."""
    placed = relational.output_positions(relational.sequence_table(pages(spark, sf_dir)))
    return placed.groupBy("file_id").agg(F.sum(F.col("lit_len") + F.col("match_len")).alias("original"), F.min(F.col("out_at") == F.col("lit_start")).alias("gapless"))


@query()
def match_statistics(spark, sf_dir):
    seqs = relational.sequence_table(documents(spark, sf_dir))
    return seqs.groupBy("file_id").agg(F.count(F.lit(1)).alias("sequences"), F.sum("match_len").alias("matched"), F.max("offset").alias("farthest"))


def _prices(spark, sf_dir) -> DataFrame:
    """Each supplier's prices in order as packed doubles. A supplier's rows bound the group."""
    import numpy as np
    import pyarrow as pa

    rows = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"))).alias("r"))

    def pack(batches):
        for batch in batches:
            ids, prices = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([str(i) for i in ids]), pa.array([np.array(p, "<f8").tobytes() for p in prices], pa.binary())], ["file_id", "content"])

    return rows.select("l_suppkey", F.transform("r", lambda x: x["l_extendedprice"]).alias("p")).mapInArrow(pack, "file_id string, content binary")


#: Filters whose bytes are compared; widths of 8 fit the packed keys.
_FILTERS = ("shuffle-8", "delta-8", "delta-shuffle-8", "delta-zigzag-shuffle-8", "delta-bitshuffle-8")


@query("""
WITH v AS (SELECT o_custkey % 97 AS grp, o_orderkey AS v, row_number() OVER (PARTITION BY o_custkey % 97 ORDER BY o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_custkey % 97) AS m,
                  o_orderkey - lag(o_orderkey, 1, 0) OVER (PARTITION BY o_custkey % 97 ORDER BY o_orderkey) AS d FROM orders),
j AS (SELECT unnest(range(0, 8)) AS j), b AS (SELECT unnest(range(0, 64)) AS p),
z AS (SELECT *, CASE WHEN d >= 0 THEN 2 * d ELSE -2 * d - 1 END AS z, m // 32 * 32 AS w FROM v),
bytes AS (
  SELECT 'shuffle-8' AS filter, grp, m, j * m + i AS pos, (v >> CAST(8 * j AS INTEGER)) & 255 AS byte FROM z, j
  UNION ALL SELECT 'delta-8', grp, m, 8 * i + j, (d >> CAST(8 * j AS INTEGER)) & 255 FROM z, j
  UNION ALL SELECT 'delta-shuffle-8', grp, m, j * m + i, (d >> CAST(8 * j AS INTEGER)) & 255 FROM z, j
  UNION ALL SELECT 'delta-zigzag-shuffle-8', grp, m, j * m + i, (z >> CAST(8 * j AS INTEGER)) & 255 FROM z, j
  UNION ALL SELECT 'delta-bitshuffle-8', grp, m, 8 * i + j, (d >> CAST(8 * j AS INTEGER)) & 255 FROM z, j WHERE i >= w
  UNION ALL SELECT 'delta-bitshuffle-8', grp, m, p * (w // 8) + i // 8, sum(((d >> CAST(p AS INTEGER)) & 1) << CAST(i % 8 AS INTEGER)) FROM z, b WHERE i < w GROUP BY grp, m, w, p, i // 8)
SELECT CAST(grp AS VARCHAR) AS grp, filter, CAST(max(m) AS BIGINT) AS elements, CAST(sum((pos % 9973 + 1) * byte) AS BIGINT) AS weighted, true AS back FROM bytes GROUP BY grp, filter
""")
def filter_bytes(spark, sf_dir):
    """Packed order keys through each filter: an order-sensitive sum of the filtered bytes, and whether the inverse gives the input."""
    import numpy as np
    import pyarrow as pa

    from stratapack.functions import filters

    def run(group: pa.Table) -> pa.Table:
        data = np.sort(group["v"].to_numpy()).astype("<i8").tobytes()
        out = []
        for name in _FILTERS:
            made = filters.forward(data, name)
            raw = np.frombuffer(made, np.uint8).astype(np.int64)
            out.append((str(group["grp"][0].as_py()), name, len(data) // 8, int(((np.arange(len(raw)) % 9973 + 1) * raw).sum()), filters.inverse(made, name) == data))
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_())
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["grp", "filter", "elements", "weighted", "back"])

    rows = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 97).alias("grp"), F.col("o_orderkey").alias("v"))
    return rows.groupBy("grp").applyInArrow(run, "grp string, filter string, elements long, weighted long, back boolean")


#: Fixed values of the format: payload bytes of 65,536 zeros at level 1.
_ZERO_BLOCKS = {"lz4": 395, "glz": 153, "glze": 40}


@query("SELECT codec, size, true AS back FROM (VALUES ('lz4', 395::BIGINT), ('glz', 153::BIGINT), ('glze', 40::BIGINT)) v(codec, size)")
def zero_blocks(spark, sf_dir):
    """Block sizes of 64 KiB of zeros by codec, and whether they decode."""
    files = spark.createDataFrame([("zeros", bytearray(65536))], "file_id string, content binary")
    rows = None
    for codec in _ZERO_BLOCKS:
        made = container.decompress(container.compress(files, Options(codec=codec)), codec)
        part = made.select(F.lit(codec).alias("codec"), F.col("packed").alias("size"), (F.md5("content") == F.md5(F.lit(bytes(65536)))).alias("back"))
        rows = part if rows is None else rows.unionByName(part)
    return rows


@query()
def filter_wins(spark, sf_dir):
    """Share of chunks that each filter wins on packed prices; candidates without a win stay with 0."""
    from stratapack.functions import filters

    made = container.compress(_prices(spark, sf_dir), Options(codec="glze", chunk_size=CHUNK, filters="auto"))
    won = made.groupBy(F.when(~F.col("stored"), F.col("filter")).alias("filter")).agg(F.count(F.lit(1)).alias("n"))
    # One row for each filter, and one for stored chunks.
    won = won.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))))
    every = spark.createDataFrame([(k, name) for k, name in enumerate(filters.candidates(1))], "ord int, filter string")
    return every.join(won, "filter", "left").select("ord", "filter", F.coalesce("share", F.lit(0.0)).alias("share"))


@query()
def codec_ratio(spark, sf_dir):
    """Bytes before and after, by codec, over all pages."""
    files = pages(spark, sf_dir)
    parts = [container.compress(files, Options(codec=c)).select(F.lit(c).alias("codec"), "uncomp_size", "comp_size") for c in ("stored", "lz4", "glz", "glze")]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy("codec").agg(F.sum("uncomp_size").alias("original"), F.sum(chunks.pad4(F.col("comp_size")) + 24).alias("packed")).withColumn("ratio", F.round(F.col("original") / F.col("packed"), 4))


#: Ratios of 1 MiB of each generated input at level 1 without the 32 header bytes: lz4, glz, glze. Published for 256 MiB: zeros
#: 156.04, 364.07, 1023.88; random 1.00; text 1.92, 1.92, 3.01; mixed 1.96, 1.97, 2.25; glze of sorted-u32 1.29, i16-audio 1.03, f64-walk 1.10.
_RATIOS = """
    zeros 156.04 364.09 1024.00
    random 1.00 1.00 1.00
    text 1.92 1.92 3.01
    mixed 1.96 1.97 2.24
    f32-points 1.00 1.00 1.12
    sorted-u32 1.00 1.00 1.29
    i16-audio 1.00 1.00 1.03
    u64-timestamps 1.56 1.56 2.82
    f64-walk 1.00 1.00 1.10
"""
_RATIO_ROWS = ", ".join(f"('{name}', '{codec}', {value}::DOUBLE)" for name, *values in map(str.split, _RATIOS.strip().splitlines()) for codec, value in zip(("lz4", "glz", "glze"), values, strict=True))


@query(f"SELECT file_id, codec, ratio FROM (VALUES {_RATIO_ROWS}) v(file_id, codec, ratio)")
def synthetic_ratio(spark, sf_dir):
    """Level-1 ratios of the generated inputs (1 MiB each)."""
    from stratapack.sources import generators

    files = generators.inputs(spark, 1 << 20)
    rows = None
    for c in ("lz4", "glz", "glze"):
        part = container.compress(files, Options(codec=c)).withColumn("codec", F.lit(c))
        rows = part if rows is None else rows.unionByName(part)
    sums = rows.groupBy("file_id", "codec").agg(F.sum("uncomp_size").alias("original"), F.sum(chunks.pad4(F.col("comp_size")) + 24).alias("packed"))
    return sums.select("file_id", "codec", F.round(measures.ratio(F.col("original"), F.col("packed")), 2).alias("ratio"))


@query("SELECT file_id, 'delta-bitshuffle-8' AS filter, 1.0::DOUBLE AS share FROM (VALUES ('sorted-u32'), ('u64-timestamps'), ('f64-walk')) v(file_id)")
def synthetic_filter_wins(spark, sf_dir):
    """Share of chunks that each filter wins on generated numbers (published: all of them, for these three)."""
    from stratapack.sources import generators

    files = generators.inputs(spark, 1 << 18).filter(F.col("file_id").isin("sorted-u32", "u64-timestamps", "f64-walk"))
    made = container.compress(files, Options(codec="lz4", filters="auto"))
    won = made.groupBy("file_id", "filter").agg(F.count(F.lit(1)).alias("n"))
    total = won.groupBy("file_id").agg(F.sum("n").alias("total"))
    return won.join(total, "file_id").select("file_id", "filter", (F.col("n") / F.col("total")).alias("share"))


def _events(spark, sf_dir) -> DataFrame:
    """Events as measurements: name = type, input by user, date = day, gbps = value."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.date_format("ts", "yyyy-MM-dd").alias("date"), F.concat(F.lit("host"), (F.col("user_id") % 3).cast("string")).alias("adapter"), F.col("event_id").alias("ord"),
        F.col("event_type").alias("name"), F.concat(F.lit("i"), (F.col("user_id") % 4).cast("string")).alias("input"), F.lit(1000).cast("long").alias("bytes"), F.col("value").alias("gbps"),
    )


_EVENTS_SQL = """
e AS (SELECT strftime(ts, '%Y-%m-%d') AS date, 'host' || (user_id % 3) AS adapter, event_id AS ord, event_type AS name, 'i' || (user_id % 4) AS input, 1000 AS bytes, value AS gbps FROM events)
"""


@query(f"WITH {_EVENTS_SQL} SELECT name, input, median(gbps) AS median FROM e GROUP BY name, input")
def bench_median(spark, sf_dir):
    return measures.exact_medians(_events(spark, sf_dir), ["name", "input"], "gbps")


@query(f"WITH {_EVENTS_SQL} SELECT name, input, median(gbps) AS median FROM (SELECT *, row_number() OVER (PARTITION BY name, input ORDER BY ord) AS r FROM e) WHERE r > 2 GROUP BY name, input")
def bench_warmup(spark, sf_dir):
    return measures.medians(_events(spark, sf_dir), ["name", "input"], "gbps", "ord", warmup=2)


_RUNS_SQL = "r AS (SELECT adapter, date, count(*) AS n, max(CASE WHEN input = 'i3' AND gbps > 200 THEN 1 ELSE 0 END) = 1 AS has_corpus FROM e GROUP BY adapter, date)"


def _runs(spark, sf_dir) -> DataFrame:
    return _events(spark, sf_dir).groupBy("adapter", "date").agg(F.count(F.lit(1)).alias("n"), F.max((F.col("input") == "i3") & (F.col("gbps") > 200)).alias("has_corpus"))


@query(f"WITH {_EVENTS_SQL}, {_RUNS_SQL} SELECT adapter, date, n, has_corpus FROM (SELECT *, row_number() OVER (PARTITION BY adapter ORDER BY has_corpus DESC, date DESC) AS k FROM r) WHERE k = 1")
def bench_latest(spark, sf_dir):
    return measures.latest_runs(_runs(spark, sf_dir))


@query(f"WITH {_EVENTS_SQL}, {_RUNS_SQL} SELECT adapter, date, n, has_corpus, age FROM (SELECT *, row_number() OVER (PARTITION BY adapter ORDER BY date DESC) AS age FROM r) WHERE age <= 8")
def bench_history(spark, sf_dir):
    return measures.history(_runs(spark, sf_dir))


@query(f"WITH {_EVENTS_SQL} SELECT name, arg_min(gbps, ord) FILTER (input = 'i0') AS i0, arg_min(gbps, ord) FILTER (input = 'i1') AS i1, arg_min(gbps, ord) FILTER (input = 'i2') AS i2, arg_min(gbps, ord) FILTER (input = 'i3') AS i3 FROM e GROUP BY name")
def bench_pivot(spark, sf_dir):
    return measures.matrix(_events(spark, sf_dir), ["i0", "i1", "i2", "i3"])


@query(f"WITH {_EVENTS_SQL} SELECT input, min(ord) AS seen FROM e GROUP BY input")
def bench_first_seen(spark, sf_dir):
    return measures.first_seen(_events(spark, sf_dir), "input")


@query(f"WITH {_EVENTS_SQL} SELECT adapter, arg_min(input, ord) AS headline FROM e GROUP BY adapter")
def bench_headline(spark, sf_dir):
    return measures.headline(_events(spark, sf_dir))


@query("SELECT p_partkey, p_retailprice, p_size FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_retailprice >= a.p_retailprice AND b.p_size >= a.p_size AND (b.p_retailprice > a.p_retailprice OR b.p_size > a.p_size))")
def bench_pareto(spark, sf_dir):
    return measures.pareto(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice", "p_size"), "p_retailprice", "p_size")


@query(f"""WITH {_EVENTS_SQL}, f AS (SELECT name, input, arg_min(gbps, ord) AS gbps FROM e GROUP BY name, input)
SELECT p.label, p.ours, p.theirs, a.input, a.gbps AS our_gbps, b.gbps AS their_gbps, round(a.gbps / b.gbps, 6) AS quotient
FROM (VALUES ('views', 'view', 'click'), ('sales', 'purchase', 'signup')) p(label, ours, theirs) JOIN f a ON a.name = p.ours JOIN f b ON b.name = p.theirs AND b.input = a.input""")
def bench_versus(spark, sf_dir):
    pairs = spark.createDataFrame([("views", "view", "click"), ("sales", "purchase", "signup")], "label string, ours string, theirs string")
    return measures.versus(_events(spark, sf_dir), pairs).withColumn("quotient", F.round("quotient", 6))


@query(f"WITH {_EVENTS_SQL} SELECT date, adapter, input, ord, greatest(gbps - coalesce(lag(gbps) OVER (PARTITION BY date, adapter, input ORDER BY ord), 0), 0) AS stage_ms FROM e")
def stage_profile(spark, sf_dir):
    return measures.stage_times(_events(spark, sf_dir), ["date", "adapter", "input"], "ord", "gbps").select("date", "adapter", "input", "ord", "stage_ms")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_runs(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("""
SELECT doc_id, CASE WHEN n < 1024 THEN n || ' B' ELSE regexp_replace(printf('%.1f', n / unit), '\\.0$', '') || CASE unit WHEN 1024.0 THEN ' KiB' WHEN 1048576.0 THEN ' MiB' ELSE ' GiB' END END AS size, 'r-' || lang || '-' || source || '.json' AS file
FROM (SELECT *, CASE WHEN n < 1048576 THEN 1024.0 WHEN n < 1073741824 THEN 1048576.0 ELSE 1073741824.0 END AS unit FROM (SELECT doc_id, lang, source, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents))
""")
def human_sizes(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.octet_length(utf8("text")).cast("long").alias("n"))
    return rows.select("doc_id", relational.human_bytes(F.col("n")).alias("size"), relational.run_file_name(F.lit("r"), F.col("lang"), F.col("source")).alias("file"))


@query("SELECT o_orderkey, xor(o_orderkey, 2863311530) AS flipped FROM orders")
def xor_words(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").bitwiseXOR(F.lit(2863311530)).alias("flipped"))


@query("SELECT name, input, CAST(1000 AS BIGINT) AS total_bytes, round(1000 / (gbps * 1e9) * 1e3, 12) AS ms FROM (WITH " + _EVENTS_SQL + " SELECT name, input, arg_min(gbps, ord) AS gbps FROM e WHERE gbps > 0 GROUP BY name, input)")
def bench_milliseconds(spark, sf_dir):
    rows = measures.first_rows(_events(spark, sf_dir).filter("gbps > 0"), ["name", "input"])
    return rows.select("name", "input", F.col("bytes").alias("total_bytes"), F.round(measures.ms(F.col("bytes"), F.col("gbps")), 12).alias("ms"))


@query(f"""WITH {_EVENTS_SQL}, d AS (SELECT DISTINCT date FROM e ORDER BY date DESC LIMIT 8), r AS (SELECT e.* FROM e JOIN d ON e.date = d.date),
n AS (SELECT name, date, arg_min(input, ord) AS input FROM r GROUP BY name, date), c AS (SELECT name, arg_max(input, date) AS input FROM n GROUP BY name),
f AS (SELECT name, input, date, arg_min(gbps, ord) AS gbps FROM r GROUP BY name, input, date)
SELECT c.name, c.input, d.date, coalesce(f.gbps, -1) AS gbps FROM c CROSS JOIN d LEFT JOIN f ON f.name = c.name AND f.input = c.input AND f.date = d.date""")
def bench_history_matrix(spark, sf_dir):
    """Measurement by run for the last eight runs, as rows."""
    wide = measures.history_matrix(_events(spark, sf_dir))
    return wide.unpivot(["name", "input"], [c for c in wide.columns if c not in ("name", "input")], "date", "gbps").withColumn("gbps", F.coalesce("gbps", F.lit(-1.0)))


_TRADE_SQL = "t AS (SELECT name || ord % 40 AS name, input, ord, gbps, 1 + ord % 37 / 10 AS ratio FROM e)"


@query(f"""WITH {_EVENTS_SQL}, {_TRADE_SQL}, f AS (SELECT name, arg_min(gbps, ord) AS gbps, arg_min(ratio, ord) AS ratio FROM t WHERE input = 'i0' GROUP BY name)
SELECT name, gbps, round(ratio, 6) AS ratio, NOT EXISTS (SELECT 1 FROM f b WHERE b.gbps >= a.gbps AND b.ratio >= a.ratio AND (b.gbps > a.gbps OR b.ratio > a.ratio)) AS pareto FROM f a""")
def bench_tradeoff(spark, sf_dir):
    rows = _events(spark, sf_dir).withColumn("name", F.concat("name", (F.col("ord") % 40).cast("string"))).withColumn("ratio", 1 + F.col("ord") % 37 / 10)
    return measures.tradeoff(rows, "i0").withColumn("ratio", F.round("ratio", 6))


@query(f"""WITH {_EVENTS_SQL}, k AS (SELECT max(ord) + 1 AS n FROM e WHERE name = 'click')
SELECT date, adapter, name, input, CASE WHEN name = 'click' THEN ord ELSE ord + n END AS ord, gbps FROM e, k""")
def bench_appended(spark, sf_dir):
    """The measurements of two suites after one another, none dropped."""
    rows = _events(spark, sf_dir).select("date", "adapter", "name", "input", "ord", "gbps")
    return measures.appended(rows.filter("name = 'click'"), rows.filter("name <> 'click'"))


_KERNEL_SQL = "q AS (SELECT name || CASE WHEN ord % 2 = 0 THEN '.e2e' ELSE '.kernel' END AS name, CASE WHEN ord % 5 = 0 THEN 'c/' || input WHEN ord % 5 = 1 THEN 'c/all' ELSE input END AS input, ord, gbps FROM e)"


@query(f"""WITH {_EVENTS_SQL}, {_KERNEL_SQL}, f AS (SELECT name, input, arg_min(gbps, ord) AS gbps FROM q WHERE NOT contains(input, '/') OR ends_with(input, '/all') GROUP BY name, input)
SELECT a.name, a.input, a.gbps, coalesce(b.gbps, -1) AS kernel_gbps FROM f a LEFT JOIN f b ON b.name = replace(a.name, '.e2e', '.kernel') AND b.input = a.input WHERE ends_with(a.name, '.e2e')""")
def bench_kernel(spark, sf_dir):
    """End-to-end rates of shown inputs with the kernel's rate of the same name, if any."""
    o, i = F.col("ord"), F.col("input")
    rows = _events(spark, sf_dir).withColumn("name", F.concat("name", F.when(o % 2 == 0, ".e2e").otherwise(".kernel")))
    rows = rows.withColumn("input", F.when(o % 5 == 0, F.concat(F.lit("c/"), i)).when(o % 5 == 1, F.lit("c/all")).otherwise(i))
    found = measures.with_kernel(rows.filter(measures.shown(i)))
    return found.select("name", "input", "gbps", F.coalesce("kernel_gbps", F.lit(-1.0)).alias("kernel_gbps"))


@query("""
SELECT CAST(a.o_custkey AS VARCHAR) AS file_id, a.o_orderkey AS seq_no, coalesce(max(b.o_orderkey), -1) AS segment
FROM orders a LEFT JOIN orders b ON b.o_custkey = a.o_custkey AND b.o_orderkey <= a.o_orderkey AND b.o_orderpriority = '1-URGENT' GROUP BY a.o_custkey, a.o_orderkey
""")
def segment_join(spark, sf_dir):
    """Each order with the customer's last urgent order up to it: a range join without a join."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("file_id"), F.col("o_orderkey").alias("seq_no"), "o_orderpriority")
    starts = rows.filter("o_orderpriority = '1-URGENT'").select("file_id", F.col("seq_no").alias("segment"), F.col("seq_no").alias("first"))
    return relational.segment_of(rows, starts).withColumn("segment", F.coalesce("segment", F.lit(-1).cast("long")))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity >= 4 AND NOT coalesce(lead(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) > l_quantity, false) AS taken FROM lineitem")
def lazy_flags(spark, sf_dir):
    """Lines as positions, quantities as match lengths: those that lazy parsing takes."""
    found = relational.lazy_flags(table(spark, sf_dir, "lineitem"), "l_quantity", "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"])
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "taken")


@query("""
SELECT o_custkey, o_orderkey, step, entry FROM (
  SELECT o_custkey, o_orderkey, s AS step, CASE s WHEN 1 THEN lag(o_orderkey, 1) OVER w WHEN 2 THEN lag(o_orderkey, 2) OVER w ELSE lag(o_orderkey, 3) OVER w END AS entry
  FROM orders, (SELECT unnest([1, 2, 3]) AS s) WINDOW w AS (PARTITION BY o_custkey, s ORDER BY o_orderkey)) WHERE entry IS NOT NULL
""")
def chain_join(spark, sf_dir):
    """Each order's last three earlier orders of the customer, by joining links with links."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("group"), F.col("o_orderkey").alias("pos"))
    links = rows.withColumn("candidate", F.lag("pos").over(Window.partitionBy("group").orderBy("pos")))
    return relational.chain(links, 3).select(F.col("group").alias("o_custkey"), F.col("pos").alias("o_orderkey"), "step", "entry")


@query("""
SELECT CAST(o_custkey AS VARCHAR) AS file_id, o_orderkey % 3 AS chunk_no, arg_min(o_orderstatus || o_orderkey, (CAST(o_orderdate AS DATE), o_orderkey)) AS filter, CAST(min(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE))) AS BIGINT) AS size FROM orders GROUP BY ALL
""")
def smallest_trial(spark, sf_dir):
    """Orders as trial encodings, days as sizes: the smallest for each customer and remainder, of equal ones the first key."""
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("file_id"), (F.col("o_orderkey") % 3).alias("chunk_no"), F.col("o_orderkey").alias("ord"),
        F.concat("o_orderstatus", F.col("o_orderkey").cast("string")).alias("filter"), F.unix_date(F.col("o_orderdate").cast("date")).cast("long").alias("size"),
    )
    return chunks.smallest(rows)


@query("""
SELECT CAST(doc_id AS VARCHAR) AS file_id, upper(substr(hex(encode(text)), 8193, 16384)) AS part
FROM documents WHERE octet_length(encode(coalesce(text, ''))) > 4096
""")
def chunk_scan(spark, sf_dir):
    """The second and third chunk of every container, from its chunk table; no other chunk is decoded."""
    packed = container.compress(documents(spark, sf_dir), Options(codec="glz", chunk_size=CHUNK))
    return container.decompress(packed.filter("chunk_no BETWEEN 1 AND 2"), "glz").select("file_id", F.hex("content").alias("part"))


@query("""
SELECT CAST(doc_id AS VARCHAR) AS file_id, (n + 4095) // 4096 AS chunks, CASE doc_id % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'ChecksumMismatch' ELSE 'SizeMismatch' END AS status
FROM (SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents) WHERE n > 0
""")
def decode_status(spark, sf_dir):
    """Chunk tables with wrong checksums or sizes: the first failing check of every chunk, one status for all chunks of a document."""
    packed, kind = container.compress(documents(spark, sf_dir), Options(codec="lz4", chunk_size=CHUNK, checksums=True)), F.col("file_id").cast("long") % 3
    spoilt = packed.withColumn("checksum", F.when(kind == 1, (F.col("checksum") + 1) % (1 << 32)).otherwise(F.col("checksum")))
    spoilt = spoilt.withColumn("uncomp_size", F.when(kind == 2, F.col("uncomp_size") + 1).otherwise(F.col("uncomp_size")))
    found = container.decode(spoilt, "lz4", verify=True)
    return found.groupBy("file_id").agg(F.count(F.lit(1)).alias("chunks"), F.array_join(F.array_sort(F.collect_set("status")), "+").alias("status"))


@query("""
SELECT CAST(doc_id AS VARCHAR) AS file_id, CAST(4096 AS BIGINT) AS low, n AS high
FROM (SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents) WHERE n > 4096
""")
def payload_spans(spark, sf_dir):
    """Where the payloads of all chunks but the first lie in each stored container."""
    sizes = documents(spark, sf_dir).select("file_id", F.octet_length("content").cast("long").alias("n"))
    placed = chunks.with_offsets(chunks.layout(sizes, CHUNK).withColumn("comp_size", F.col("uncomp_size")))
    return chunks.payload_span(placed.filter("chunk_no > 0"))


@query("""
WITH c AS (SELECT doc_id, n, n // 4096 AS f, n % 4096 AS s, k FROM (SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents), LATERAL (SELECT unnest(range(0, (n + 4095) // 4096)) AS k))
SELECT CAST(doc_id AS VARCHAR) AS file_id, k AS chunk_no, CASE WHEN k = f AND f > 0 AND f % 2 = 0 AND 16384 + (s + 3) // 4 * 4 + s <= 20000 THEN k // 2 - 1 ELSE k // 2 END AS batch FROM c
""")
def chunk_batches(spark, sf_dir):
    """Consecutive chunks of each stored container in batches of at most 20,000 bytes in and out."""
    sizes = documents(spark, sf_dir).select("file_id", F.octet_length("content").cast("long").alias("n"))
    rows = chunks.layout(sizes, CHUNK).withColumn("comp_size", F.col("uncomp_size"))
    return chunks.batches(rows, 20_000).select("file_id", "chunk_no", "batch")


@query("""
SELECT page_id, md5(coalesce(html, '')) AS digest, n >= 2000 AS shrunk, (n + 3) // 4 * 4 AS padded, CASE WHEN page_id >= 100 THEN 2 * (page_id - 100) ELSE -2 * (page_id - 100) - 1 END AS z
FROM (SELECT *, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n FROM pages)
""")
def sql_functions(spark, sf_dir):
    """Codec, filter and arithmetic functions called by name from SQL."""
    from stratapack.functions import sql

    sql.register(spark)
    table(spark, sf_dir, "pages").createOrReplaceTempView("sp_pages")
    return spark.sql("""
        WITH d AS (SELECT page_id, cast(coalesce(html, '') AS BINARY) AS data FROM sp_pages),
        p AS (SELECT *, cast(octet_length(data) AS BIGINT) AS n, sp_encode(sp_filter(data, 'shuffle-2'), 'glze', 1) AS block, sp_encode(data, 'lz4', 1) AS plain FROM d)
        SELECT page_id, md5(CASE WHEN n = 0 THEN data ELSE sp_unfilter(sp_decode(block, 'glze', cast(n AS INT)), 'shuffle-2') END) AS digest,
               n >= 2000 AND octet_length(plain) < n AS shrunk, sp_pad4(n) AS padded, sp_zigzag(page_id - 100) AS z FROM p""")
