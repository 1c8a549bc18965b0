"""Containers as a data source, benchmark runs as JSON, corpora, the file stream."""

import json

from stratapack.functions.codecs import Options
from stratapack.operators import container
from stratapack.sources import files, generators
from tests.test_layout import container as packed


def test_container_source_prunes(spark, tmp_path):
    data = generators.pseudo_text(100_000)
    path = tmp_path / "a.bin"
    path.write_bytes(packed(data, Options(chunk_size=4096)))
    files.register(spark)
    read = spark.read.format("stratapack").option("path", str(path)).option("chunksPerTask", 4)
    whole = container.decompress(read.load(), "lz4").first()["content"]
    assert bytes(whole) == data
    some = read.option("firstChunk", 3).option("lastChunk", 5).load()
    assert sorted(r["chunk_no"] for r in some.collect()) == [3, 4, 5]
    assert bytes(container.decompress(some, "lz4").first()["content"]) == data[3 * 4096 : 6 * 4096]
    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)
    try:
        load = spark.read.format("stratapack").option("path", f"file://{path}").option("filters", "true").load
        for rule, want in (("chunk_no >= 20", [20, 21, 22, 23, 24]), ("chunk_no > 3 AND chunk_no < 6 AND stored = false", [4, 5]), ("chunk_no = 9", [9]), ("chunk_no IN (2, 7, 90)", [2, 7]), ("chunk_no < 0", [])):
            rows = load().filter(rule)
            assert sorted(r["chunk_no"] for r in rows.collect()) == want
            assert rows.rdd.getNumPartitions() <= max(1, len(want))
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_runs(spark, tmp_path):
    m = {"name": "x", "input": "text", "bytes": 10, "gbps": 1.5, "ratio": None, "timing": "cpu"}
    for day in ("2026-02-02", "2026-01-01"):
        run = {"date": day, "commit": "c", "label": "M", "os": "o", "adapter": "a b", "backend": "k", "measurements": [m, m]}
        (tmp_path / f"{day}.json").write_text(files.run_json(run))
    (tmp_path / "notes.txt").write_text("no run")
    runs = files.load_runs(spark, str(tmp_path))
    assert [(r["date"], r["note"], r["cpu"]) for r in runs.collect()] == [("2026-01-01", "", ""), ("2026-02-02", "", "")]
    assert [r["ord"] for r in files.measurements(runs).collect()] == [0, 1, 0, 1]
    assert files.load_runs(spark, str(tmp_path / "missing")).count() == 0
    (tmp_path / "out").mkdir()
    path = files.write_run(spark, run, str(tmp_path / "out"))
    assert path.endswith("/2026-01-01-M-a-b.json") and (tmp_path / "out" / "2026-01-01-M-a-b.json").read_text() == files.run_json(run)
    assert files.load_runs(spark, str(tmp_path / "out")).first()["measurements"][0]["gbps"] == 1.5
    facts = files.host_facts(spark)
    assert facts["adapter"].startswith("local") and facts["backend"].startswith("spark ") and facts["os"]
    assert files.brand("processor : 0\nmodel name\t: Some CPU 9000\n") == "Some CPU 9000" and files.brand("") is None
    assert json.loads(files.run_json({"a": 1})) == {"a": 1}


def test_corpus(spark, tmp_path):
    for name in ("b", "a"):
        (tmp_path / name).write_bytes(name.encode() * 3)
    rows = {r["file_id"]: bytes(r["content"]) for r in files.corpus(spark, str(tmp_path), "set").collect()}
    assert rows == {"set/a": b"aaa", "set/b": b"bbb"}
    assert files.raw_files(spark, str(tmp_path)).count() == 2


def test_concatenated_corpus_in_chunks(spark, tmp_path):
    """Chunks of the whole, some from several files, some inside one; empty files count for nothing."""
    sizes = {"a": 5000, "b": 0, "c": 10, "d": 3, "e": 20_000, "f": 4096}
    for k, (name, n) in enumerate(sizes.items()):
        (tmp_path / name).write_bytes(bytes([65 + k]) * n)
    whole = b"".join(bytes([65 + k]) * n for k, n in enumerate(sizes.values()))
    rows = sorted((r["chunk_no"], bytes(r["data"])) for r in files.corpus_chunks(spark, str(tmp_path), "set", 4096).collect())
    assert rows == [(k, whole[4096 * k : 4096 * k + 4096]) for k in range(-(-len(whole) // 4096))]


def test_generators():
    made = generators.synthetic(1000)
    assert {k: len(v) for k, v in made.items()} == dict.fromkeys(("zeros", "random", "text", "mixed"), 1000)
    assert all(len(v) == 1001 for v in generators.numeric(1001).values())
    assert made["random"][:8] != made["random"][8:16]


def test_stream_equals_batch(spark, tmp_path):
    from stratapack.streaming import compress

    rows = spark.createDataFrame([(str(k), bytearray(generators.pseudo_text(3000 + k))) for k in range(6)], "file_id string, content binary")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    run = lambda: compress.compress_stream(spark, str(tmp_path / "in"), rows.schema, "file_id", "content", str(tmp_path / "out"), str(tmp_path / "state"), files_per_batch=1).awaitTermination()
    run()
    once = sorted(compress.read_compressed(spark, str(tmp_path / "out")).collect())
    assert once == sorted(container.compress(rows).collect())
    run()
    assert sorted(compress.read_compressed(spark, str(tmp_path / "out")).collect()) == once
    sizes = rows.selectExpr("file_id", "cast(octet_length(content) as long) as n")
    made = {r["file_id"]: bytes(r["container"]) for r in compress.containers_of(spark, str(tmp_path / "out"), sizes).collect()}
    assert made == {r["file_id"]: bytes(r["container"]) for r in container.to_files(sizes, container.compress(rows), Options()).collect()}
    compress.save_stream(spark, str(tmp_path / "out"), "4", 3004, str(tmp_path / "four.bin"))
    assert (tmp_path / "four.bin").read_bytes() == made["4"]
