"""Operators with SQL oracles, and their edge cases."""

import hashlib

import pytest
from pyspark.sql import functions as F

from stratapack.llm import exact_dedup, line_dedup
from stratapack.llm.registry import ORACLE_SQL, QUERIES
from tests.conftest import SF


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, oracle, name):
    oracle(QUERIES[name](spark, SF), ORACLE_SQL[name])


ROWS = [(1, "a b"), (2, "ab"), (3, " a b "), (4, "c"), (5, None), (6, ""), (None, "c"), (None, "q"), (7, "zz"), (7, "zz"), (8, "x" * 200_000), (9, "x" * 200_000 + "\n")]


def test_exact_groups(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("keep_id", F.lit("clash")).withColumn("h", F.lit(1))
    found = exact_dedup.exact_groups(docs)
    got = sorted(((r["doc_id"] or -1, r["keep_id"] or -1, r["group_size"], r["kept"]) for r in found.collect()))
    assert got == [
        (-1, -1, 1, True), (-1, 4, 2, False), (1, 3, 3, False), (2, 3, 3, False), (3, 3, 3, True), (4, 4, 2, True), (5, 5, 2, True), (6, 5, 2, False),
        (7, 7, 2, True), (7, 7, 2, True), (8, 9, 2, False), (9, 9, 2, True),
    ]
    # All hashes collide: bytes decide, with the same result.
    forced = exact_dedup.exact_groups(docs, lambda c: F.lit("one"))
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(str, forced.select(columns).collect())) == sorted(map(str, found.select(columns).collect()))
    kept = exact_dedup.drop_exact_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or -1) for r in kept.collect()) == [-1, 3, 4, 5, 7, 9]
    assert exact_dedup.exact_groups(docs.limit(0)).count() == 0


def brute_lines(rows):
    owners = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            key = line.strip(" \t\n\x0b\x0c\r")
            key = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in key)
            if len(key) >= 10:
                owners.setdefault(key, set()).add(float("inf") if doc is None else doc)
    out = []
    for doc, text in rows:
        lines, kept = (text or "").split("\n"), []
        for line in lines:
            key = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
            if len(key) < 10 or min(owners[key]) == (float("inf") if doc is None else doc):
                kept.append(line)
        out.append((doc or -1, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("batches,fanout", [(1, 2), (3, 2), (7, 3)])
def test_lines(spark, batches, fanout):
    rows = [(k, "\n".join([f"shared line {k % 4}", "Common Line of all", " COMMON line of all\t", "short", f"own line number {k}", "éééééééééé", ""])) for k in range(12)]
    rows += [(20, None), (21, ""), (None, "common line of all\nx"), (22, "common line of all"), (23, "only here twice\nonly here twice"), (24, "w" * 50_000 + "\n" + "common line of all")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h1", F.lit("clash"))
    found = line_dedup.drop_repeated_lines(docs, batches=batches, fanout=fanout)
    got = sorted((r["doc_id"] or -1, r["n_lines"], r["n_dropped"], hashlib.sha256(r["kept_text"].encode()).hexdigest()) for r in found.collect())
    assert got == brute_lines(rows)
    assert line_dedup.drop_repeated_lines(docs.limit(0)).count() == 0


def test_runs_compact(spark):
    store = line_dedup.LineRuns(spark, buckets=2, fanout=2)
    pairs = lambda rows: spark.createDataFrame(rows, "doc long, h1 long, h2 long")
    dropped = []
    for k in range(5):
        dropped += store.ingest(pairs([(k, 1, 1), (k, 2, k), (k + 100, 2, k)])).collect()
    assert sorted(r["doc"] for r in dropped) == [1, 2, 3, 4, 100, 101, 102, 103, 104]
    assert [len(level) for level in store.levels] == [1, 0, 1]
    assert sum(r.count() for r in store.runs()) == 6
    store.close()


def test_rows_without_id_are_cut_by_text(spark):
    """They are one document: lines that a smaller doc_id holds go from each of them, their own lines stay in all."""
    rows = [(1, "a shared line here\nonly in one"), (None, "A shared line here \nanother line of text"), (None, "another line of text\nx"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted((r["doc_id"] or 0, r["kept_text"], r["n_dropped"]) for r in line_dedup.drop_repeated_lines(docs, batches=2).collect())
    assert found == [(0, "", 0), (0, "another line of text", 1), (0, "another line of text\nx", 0), (1, "a shared line here\nonly in one", 0)]
