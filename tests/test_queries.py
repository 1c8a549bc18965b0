"""Every library query against its SQL on the smallest tables, and what SQL cannot say."""

import pytest
from pyspark.sql import functions as F

from stratapack.functions import layout
from stratapack.functions.codecs import Options
from stratapack.operators import chunks, container, measures, relational
from stratapack.plans.registry import ORACLE_SQL, QUERIES
from tests.conftest import SF


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, oracle, name):
    oracle(QUERIES[name](spark, SF), ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_candidates_equal_match_finder(spark):
    """Against the definition: the latest position of an earlier block of 128 with the same hash."""
    from stratapack.functions import lz

    data = b"the cat and the hat and the cat sat on the mat with the other hat " * 30
    found = relational.match_candidates(spark.createDataFrame([("a", bytearray(data)), ("b", bytearray(b"short"))], "file_id string, content binary"))
    got = {r["file_id"]: (r["positions"], r["found"], r["offsets"]) for r in found.collect()}
    words, want = [int.from_bytes(data[p : p + 4], "little") for p in range(len(data) - 11)], []
    hashed = [w * lz.MULTIPLIER % (1 << 32) >> 20 for w in words]
    for p, h in enumerate(hashed):
        earlier = [q for q in range(p // 128 * 128) if hashed[q] == h]
        want += [p - earlier[-1]] if earlier else []
    assert got == {"a": (len(data) - 11, len(want), sum(want)), "b": (0, 0, 0)}


def test_blocks_grow_no_longer_than_the_bound():
    import os

    from stratapack.functions import codecs, lz

    for data in (os.urandom(5000), bytes(70_000), b"", b"x"):
        assert len(codecs.block(data, Options())) <= lz.max_compressed_size(len(data))


def test_files_of_all_sizes(spark):
    rows = [("empty", b""), ("one", b"x"), ("exact", b"ab" * 2048), ("over", b"ab" * 2048 + b"c")]
    files = spark.createDataFrame([(k, bytearray(v)) for k, v in rows], "file_id string, content binary")
    options = Options(chunk_size=4096, checksums=True)
    sizes = files.select("file_id", F.octet_length("content").cast("long").alias("n"))
    made = {r[0]: bytes(r[1]) for r in container.to_files(sizes, container.compress(files, options), options).collect()}
    for name, data in rows:
        index = layout.Index.parse(made[name])
        index.validate(len(made[name]) - index.data_offset)
        assert index.header.total_size == len(data)
    back = {r[0]: bytes(r[1]) for r in container.decompress(container.from_files(spark.createDataFrame([(k, bytearray(v)) for k, v in made.items()], "file_id string, container binary")), "lz4", True).collect()}
    assert back == {k: v for k, v in rows if v}


def test_decode_reports_the_failing_check(spark):
    files = spark.createDataFrame([("a", bytearray(b"hello hello hello hello hello hello"))], "file_id string, content binary")
    packed = container.compress(files, Options(checksums=True, chunk_size=4096))
    spoilt = packed.withColumn("checksum", F.lit(1).cast("long"))
    assert container.decode(spoilt, "lz4", verify=True).first()["status"] == "ChecksumMismatch"
    assert container.decode(spoilt, "lz4").first()["status"] == "ok"


def test_chunk_filter_reaches_the_scan(spark, tmp_path):
    files = spark.createDataFrame([("a", bytearray(b"abc" * 9000))], "file_id string, content binary")
    container.compress(files, Options(chunk_size=4096)).write.parquet(str(tmp_path / "c"))
    plan = container.decode(spark.read.parquet(str(tmp_path / "c")).filter("chunk_no >= 3"), "lz4")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(chunk_no), GreaterThanOrEqual(chunk_no,3)]" in plan
    summary = chunks.summary(spark.read.parquet(str(tmp_path / "c")))._jdf.queryExecution().executedPlan().toString()
    assert "payload" not in summary


def test_medians_and_markdown(spark):
    rows = spark.createDataFrame([("a", float(v)) for v in (4, 1, 2, 100)] + [("b", float(v)) for v in (9, 1, 5)], "k string, v double")
    assert {r["k"]: r["median"] for r in measures.medians(rows, ["k"], "v").collect()} == {"a": 3.0, "b": 5.0}
    assert measures.markdown([{"a": 1.5, "b": None}], ["a", "b"]).splitlines()[-1] == "| 1.50 | — |"
    assert {r["k"]: r["median"] for r in measures.exact_medians(rows, ["k"], "v").collect()} == {"a": 3.0, "b": 5.0}
    assert measures.fill_template("x {{versus}} y", {}) == "x (no measurements) y"
    with pytest.raises(ValueError, match="no section"):
        measures.fill_template("{{nothing}}", {})


def test_rates(spark):
    row = spark.range(1).select(measures.gbps(F.lit(2_000_000_000), F.lit(1.0)), measures.ms(F.lit(2_000_000_000), F.lit(2.0)), measures.ratio(F.lit(300), F.lit(100))).first()
    assert tuple(row) == (2.0, 1000.0, 3.0)


def test_small_files_are_spread(spark, tmp_path):
    from stratapack import session

    assert [session._bytes(x) for x in ("134217728b", "8m", "128MB", "1g", "5")] == [1 << 27, 8 << 20, 1 << 27, 1 << 30, 5]
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "one"))
    rows = spark.read.parquet(str(tmp_path / "one"))
    assert session.spread(rows).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    spark.range(100).repartition(8).write.parquet(str(tmp_path / "many"))
    many = spark.read.parquet(str(tmp_path / "many"))
    assert session.spread(many) is many
    limit = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10b")
    try:
        # A file that Spark cuts into enough tasks isn't moved.
        assert session.spread(rows) is rows
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", limit)


def test_human_bytes(spark):
    rows = spark.createDataFrame([(100,), (1536,), (65536,), (268435456,), (1610612736,)], "n long")
    assert [r[0] for r in rows.select(relational.human_bytes(F.col("n"))).collect()] == ["100 B", "1.5 KiB", "64 KiB", "256 MiB", "1.5 GiB"]


def test_exact_medians_of_large_groups(spark):
    """A group far larger than the bracket, with repeated values, skew and nulls."""
    import random
    from statistics import median

    rng = random.Random(4)
    groups = {"spread": [rng.random() for _ in range(20_001)], "repeats": [float(rng.randrange(3)) for _ in range(10_000)], "skew": [2.0 ** rng.randrange(40) for _ in range(5000)], "one": [7.0]}
    rows = [(k, v) for k, values in groups.items() for v in values] + [("one", None), (None, 1.0), (None, 4.0)]
    rng.shuffle(rows)
    found = {r["k"]: r["median"] for r in measures.exact_medians(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").collect()}
    assert found == {k: median(v) for k, v in groups.items()} | {None: 2.5}


def test_job_errors(spark):
    check = lambda *jobs: [tuple(r) for r in chunks.job_errors(spark.createDataFrame([(k, *j) for k, j in enumerate(jobs)], "job int, width int, src_offset long, dst_offset long, len long"), 1000, 1000).collect()]
    assert check((4, 0, 0, 100), (2, 100, 100, 50), (0, 3, 3, 9999)) == []
    assert check((4, 0, 0, 100), (3, 0, 2, 10)) == [(1, "width")]
    assert check((4, 0, 0, 100), (4, 0, 102, 10)) == [(1, "alignment")]
    assert check((4, 0, 0, 100), (4, 900, 100, 104)) == [(1, "bounds")]
    assert check((4, 0, 100, 100), (4, 0, 400, 40), (4, 0, 196, 8)) == [(2, "overlap")]
    # A long target reaches over others that don't touch each other.
    assert check((1, 0, 0, 900), (1, 0, 904, 4), (1, 0, 500, 4)) == [(2, "overlap")]


def test_report(spark):
    rows = [("compress lz4", "set/all", 2.0, 1.9), ("compress lz4", "set/a", 2.1, 1.8), ("compress z", "set/all", 1.0, 2.9), ("compress slow", "set/all", 0.5, 1.0), ("decompress lz4", "text", 9.0, None), ("compress lz4", "i16-audio", 1.0, 1.1), ("stage parse", "text", 1.0, None)]
    meas = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "ord int, name string, input string, gbps double, ratio double")
    pairs = spark.createDataFrame([("lz4 to z", "compress lz4", "compress z")], "label string, ours string, theirs string")
    made = measures.report_sections(meas, pairs, {"cpu": "x", "platform.cores": "8"})
    assert set(made) == {"setup", "platform", "versus", "compress", "files-compress", "synthetic-decompress", "numeric", "profile"}
    assert made["compress"].splitlines()[2:] == ["| compress lz4 | 2.00 | 1.90 | True |", "| compress z | 1.00 | 2.90 | True |", "| compress slow | 0.50 | 1.00 | False |"]
    assert made["files-compress"].splitlines()[2].startswith("| compress lz4 | set/a |")  # concatenations are last
    assert "2.00" in made["versus"] and set(measures.SECTIONS) > set(made)
    assert [r["ord"] for r in measures.appended(meas, meas).orderBy("ord").collect()] == list(range(14))


def test_parts_by_different_encoders(spark):
    from pyspark.errors import PySparkException

    data = b"some text that repeats, some text that repeats. " * 500
    files = spark.createDataFrame([("a", bytearray(data))], "file_id string, content binary")
    count = layout.chunk_count(len(data), 4096)
    head, tail = Options(codec="glz", chunk_size=4096), Options(codec="glz", chunk_size=4096, groups=4, filters="auto")
    made = container.compress_parts(files, [(2, head), (0, tail), (count - 2, tail)])
    assert bytes(container.decompress(container.from_files(made), "glz").first()["content"]) == data
    with pytest.raises(PySparkException, match="BadSplit"):
        container.compress_parts(files, [(count - 1, head)]).collect()
    with pytest.raises(layout.FormatError, match="BadSplit"):
        container.compress_parts(files, [(1, head), (1, Options(codec="lz4", chunk_size=4096))])
    with pytest.raises(layout.FormatError, match="BadSplit"):
        container.fixed_split(files, 0.5, head, Options(codec="glz", chunk_size=8192))
    assert layout.Index.parse(bytes(container.compress_parts(files.withColumn("content", F.lit(b"")), [(0, head)]).first()["container"])).header.chunk_count == 0


def test_ordered_writer(spark, tmp_path):
    """A saved container is byte for byte the one made in a row; saved bytes stop at the first damaged chunk in order."""
    from stratapack.sources import generators

    data, options = generators.pseudo_text(300_000), Options(chunk_size=4096, checksums=True)
    files = spark.createDataFrame([("a", bytearray(data))], "file_id string, content binary")
    packed = container.compress(files, options).repartition(5).cache()
    size = container.save_container(packed, len(data), options, str(tmp_path / "a.bin"))
    whole = container.to_files(files.select("file_id", F.octet_length("content").cast("long").alias("n")), packed, options).first()["container"]
    assert (tmp_path / "a.bin").read_bytes() == bytes(whole) and size == len(whole)
    assert container.save_bytes(container.decode(packed, "lz4", True), str(tmp_path / "a.out")) == len(data)
    assert (tmp_path / "a.out").read_bytes() == data
    spoilt = packed.withColumn("checksum", F.when(F.col("chunk_no").isin(7, 30), F.lit(1).cast("long")).otherwise(F.col("checksum")))
    with pytest.raises(container.Damaged, match="chunk 7: ChecksumMismatch"):
        container.save_bytes(container.decode(spoilt, "lz4", True), str(tmp_path / "b.out"))
    assert (tmp_path / "b.out").read_bytes() == data[: 7 * 4096]
    packed.unpersist()


def test_command_line(spark, tmp_path, capsys):
    from stratapack import cli
    from stratapack.sources import generators

    data = generators.pseudo_text(100_000)
    (tmp_path / "in").write_bytes(data)
    run = lambda *a: cli.main([str(x) for x in a], spark)
    for k, extra in enumerate((["--codec", "glze", "--level", 2, "--checksums"], ["--chunk-size", "4K", "--filter", "auto"], ["--chunk-size", "8K", "--tail-share", 0.25])):
        packed = tmp_path / f"{k}.bin"
        assert run("compress", tmp_path / "in", packed, *extra) == 0
        assert packed.stat().st_size < 60_000
        assert run("decompress", packed, tmp_path / "out") == 0 and (tmp_path / "out").read_bytes() == data
        assert run("decompress", packed, tmp_path / "out", "--offset", "9K", "--length", 30_000) == 0
        assert (tmp_path / "out").read_bytes() == data[9216:39216]
        assert run("decompress", packed, tmp_path / "out", "--offset", 99_999, "--length", 2) == 1
        capsys.readouterr()
        assert run("info", packed) == 0
        shown = capsys.readouterr().out
        assert "100000 bytes (97.7 KiB)" in shown and "ratio" in shown
    (tmp_path / "in").write_bytes(b"")
    assert run("compress", tmp_path / "in", tmp_path / "e.bin") == 0 and (tmp_path / "e.bin").stat().st_size == 32
    assert run("decompress", tmp_path / "e.bin", tmp_path / "out") == 0 and (tmp_path / "out").read_bytes() == b""
    (tmp_path / "bad").write_bytes(b"not a container at all, not at all")
    assert run("info", tmp_path / "bad") == 1 and run("info") == 0
    assert "BadMagic" in capsys.readouterr().err


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_human_sizes_of_long_texts(spark, tmp_path):
    rows = [(1, "x" * (1 << 20), "en", "web"), (2, "x" * 1572864, "en", "web"), (3, None, "en", "web")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    assert {r["doc_id"]: r["size"] for r in QUERIES["human_sizes"](spark, str(tmp_path)).collect()} == {1: "1 MiB", 2: "1.5 MiB", 3: "0 B"}


def test_container_info_of_empty_files(spark, tmp_path):
    spark.createDataFrame([(1, None), (2, ""), (3, "abcde")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = {r["file_id"]: tuple(r[c] for c in ("chunks", "stored", "original", "compressed", "filters", "ratio")) for r in QUERIES["container_info"](spark, str(tmp_path)).collect()}
    assert found == {"1": (0, 0, 0, 32, "", 0.0), "2": (0, 0, 0, 32, "", 0.0), "3": (1, 1, 5, 64, "none 1", 0.0781)}


def test_sequences_leave_before_the_batch_ends(spark, monkeypatch):
    """A batch of many chunks holds far more sequences than a Python worker may keep; all of them come, in order."""
    import random
    import tracemalloc

    import pyarrow as pa

    from stratapack.functions import lz

    draw = random.Random(5)
    texts = [" ".join(draw.choices(("alpha", "beta", "gamma", "delta", "omega"), k=120)).encode() for _ in range(20)]
    files = spark.createDataFrame([(str(i), bytearray(t)) for i, t in enumerate(texts)], "file_id string, content binary")
    kept, call = [], type(files).mapInArrow
    monkeypatch.setattr(type(files), "mapInArrow", lambda self, f, *a, **b: kept.append(f) or call(self, f, *a, **b))
    table = relational.sequence_table(files)
    want = [(str(i), 0, k, *s) for i, t in enumerate(texts) for k, s in enumerate(lz.sequences(t, lz.for_level(1)))]
    assert sorted(map(tuple, table.collect())) == sorted(want)

    many = 5000
    batch = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(many)]), pa.array([0] * many, pa.int64()), pa.array([texts[i % 20] for i in range(many)], pa.binary())], ["file_id", "chunk_no", "data"])
    tracemalloc.start()
    rows = sum(b.num_rows for b in kept[0](iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == len(want) * many // 20
    assert peak < 25e6 < 200 * rows, f"{peak / 1e6:.0f} MB for {rows} sequences"
