"""Tokenizer, licence, toxicity, packing and language-model operators against brute force."""

import math
import re
import zlib
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stratapack.llm import bpe_stream, elias_fano, license_scan, ngram_lm, retrieval_pack, toxicity, word_bpe
from stratapack.llm.common import table
from tests.conftest import SF

BYTE = Tokenizer.from_file(bpe_stream.DEFAULT_VOCABULARY)
WORD = Tokenizer.from_file(retrieval_pack.DEFAULT_VOCABULARY)
ODD = [(1, None), (2, ""), (None, "Hello there, hello"), (3, "x" * 30_000), (4, "the same"), (4, "the same"), (5, "naïve 中文 \U0001f600 <|endoftext|> it's\t\r\n")]


def frame(spark, rows=ODD):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("score", F.lit(None).cast("string"))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["the", "ing", " ", "  ", "\n", "'s", "'", "é", "123", "!!", "<|endoftext|>", "<|endo", "a" * 300, "\x1c", "\x85", "zq"]), max_size=40), st.sampled_from([1, 3, 17, 4096]))
def test_bpe_equals_library(parts, piece):
    text = "".join(parts)
    ids = bpe_stream.encode(text, piece=piece)
    want = BYTE.encode(text, add_special_tokens=False).ids
    assert ids.tolist() == want
    assert bpe_stream.decode(array("I", want), piece=2) == BYTE.decode(want, skip_special_tokens=False)


def test_bpe_long_run_leaves_early():
    """A run longer than the window emits before it ends, with bounded state."""
    merges, _ = bpe_stream.transducer(bpe_stream.DEFAULT_VOCABULARY)
    run, text = bpe_stream.Run(merges), ("theringan" * 4000).encode()
    out, most = [], 0
    for k in range(0, len(text), 500):
        out += run.push(text[k : k + 500])
        most = max(most, len(run.held))
    assert len(out) > 1000 and most <= run.window + 2 * merges.lookahead
    assert out + run.finish() == BYTE.encode(text.decode(), add_special_tokens=False).ids


def test_bpe_rows(spark):
    rows = bpe_stream.bpe_round_trip(frame(spark)).collect()
    assert len(rows) == len(ODD)
    for r, (doc, text) in zip(sorted(rows, key=str), sorted(ODD, key=lambda x: str(x)), strict=True):
        del doc
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["n_tokens"] and BYTE.decode(ids, skip_special_tokens=False) == r["decoded"]
        del text
    assert {r["decoded"] for r in rows} == {t or "" for _, t in ODD}
    assert bpe_stream.bpe_round_trip(frame(spark).limit(0)).count() == 0


def pieces_checked(rows, texts, window):
    """Each document's ids once; sequences gapless, at most a window, padded only below a power of two."""
    full = Counter(tuple([*WORD.encode(t or "", add_special_tokens=False).ids, 1]) for t in texts)
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append(r)
        by_doc.setdefault(r["doc_id"], []).append(r)
    got = Counter()
    for own in by_doc.values():
        starts = sorted(own, key=lambda r: (r["start"], -r["length"]))
        while starts:
            ids, at = [], 0
            while at is not None:
                k = next((k for k, r in enumerate(starts) if r["start"] == at), None)
                if k is None:
                    break
                r = starts.pop(k)
                ids += np.frombuffer(r["ids"], "<u4").tolist()
                at = at + r["length"] if at + r["length"] < r["doc_tokens"] else None
            got[tuple(ids)] += 1
    assert got == full
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at and len(r["ids"]) == 4 * r["length"] and r["length"] > 0
            at += r["length"]
        assert at == window or at & (at - 1) == 0


def test_packing(spark):
    docs = table(spark, SF, "documents")
    texts = [r["text"] for r in docs.collect()]
    pieces_checked(retrieval_pack.retrieval_pack(docs, shard_tokens=60_000).collect(), texts, 2048)
    pieces_checked(retrieval_pack.retrieval_pack(frame(spark), window=64).collect(), [t for _, t in ODD], 64)
    pieces_checked(retrieval_pack.retrieval_pack(frame(spark, ODD * 9), window=64, shard_tokens=300).collect(), [t for _, t in ODD * 9], 64)
    assert retrieval_pack.retrieval_pack(frame(spark).limit(0)).count() == 0


def test_packing_follows_neighbours():
    """With default settings a seed's window is filled by documents that share its terms before others, in small tables too."""
    for size in (8, 16, 40):
        rng = np.random.default_rng(0)
        topics = [rng.integers(1000 + 300 * t, 1100 + 300 * t, 40) for t in range(4)]
        docs = [np.array(topics[k % 4], np.uint16) for k in range(size)]
        index = retrieval_pack.ShardIndex(docs, df_of(docs), size, 40.0)
        pieces = retrieval_pack.pack_shard(docs, index, 10 * size)
        for sequence in range(4):
            assert len({p[0] % 4 for p in pieces if p[3] == sequence}) == 1


def df_of(docs):
    df = np.zeros(65536, np.int64)
    for d in docs:
        df[np.unique(d)] += 1
    return df


@pytest.mark.parametrize("size", [10, 100, 1000])
def test_neighbours_equal_brute_force(size):
    """Default settings on the driver's texts: the order is that of the formula, also after used documents have left the index."""
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist()[:size]
    docs = [np.array([*e.ids, 1], np.uint16) for e in WORD.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    df, mean = df_of(docs), sum(map(len, docs)) / size
    index = retrieval_pack.ShardIndex(docs, df, size, mean)
    unused = np.ones(size, bool)
    for seed in range(0, size, max(1, size // 8)):
        unused[seed] = False
        want = np.array(brute_scores(docs[seed], docs, df, size, mean))
        got = list(index.neighbours(seed, unused))
        assert set(got) == {k for k in range(size) if k != seed and unused[k] and want[k] > 0}
        assert all(want[x] >= want[y] - 1e-3 for x, y in zip(got, got[1:]))
        unused[got[: size // 12]] = False
        if seed:
            index.keep(unused[index.docs])


def topical(size, topics, seed=5, words_each=25):
    words = sorted(w for w in WORD.get_vocab() if w.isascii() and w.isalpha() and len(w) > 3)
    rng = np.random.default_rng(seed)
    return [" ".join([words[100 * (k % topics) + j] for j in rng.integers(0, 100, words_each)] + [words[-1 - j] for j in rng.integers(0, 30, 10)]) for k in range(size)]


def test_recall_over_shards(spark):
    """Of texts with topics, a seed's best neighbour in the whole corpus is in its own shard in at least nine of ten cases."""
    texts = topical(1200, 40)
    tokens = retrieval_pack.tokenised(frame(spark, list(enumerate(texts)))).cache()
    rows = sorted(tokens.collect(), key=lambda r: r["doc_id"])
    docs = [np.frombuffer(r["ids"], "<u2") for r in rows]
    df, mean = df_of(docs), sum(map(len, docs)) / len(docs)
    held = retrieval_pack.staged(tokens, "test-tokens")
    dealt = {r["doc_id"]: r["shard"] for r in retrieval_pack.sharded(held, df, len(docs), 6000).select("doc_id", "shard").collect()}
    assert len(set(dealt.values())) >= 6
    found = []
    for seed in range(0, len(docs), 12):
        want = np.array(brute_scores(docs[seed], docs, df, len(docs), mean))
        want[seed] = 0
        found.append(dealt[int(want.argmax())] == dealt[seed])
    tokens.unpersist()
    assert np.mean(found) >= 0.9


def test_packing_over_shards(spark):
    """Several shards lose no token, and the texts of a topic meet wherever their rows are."""
    texts = topical(320, 40)
    rows = retrieval_pack.retrieval_pack(frame(spark, list(enumerate(texts))), window=128, shard_tokens=2500).collect()
    pieces_checked(rows, texts, 128)
    assert len({r["sequence_id"] >> 32 for r in rows}) >= 4
    windows = {}
    for r in rows:
        windows.setdefault(r["sequence_id"], []).append(r["doc_id"] % 40)
    alike = sum(max(Counter(w).values()) > 1 for w in windows.values() if len(w) > 1)
    # Windows of random documents would hold two of a topic in about one case of ten.
    assert alike > 0.5 * sum(len(w) > 1 for w in windows.values())


def test_hot_group_is_dealt_over_shards(spark):
    """A third of all rows are copies of one text: no shard holds much more than its share."""
    texts = topical(200, 40) + ["the same words again and again in every row of it"] * 100
    tokens = retrieval_pack.staged(retrieval_pack.tokenised(frame(spark, list(enumerate(texts)))), "test-tokens")
    docs = [np.frombuffer(r["ids"], "<u2") for r in tokens.collect()]
    dealt = retrieval_pack.sharded(tokens, df_of(docs), len(docs), 300)
    most = dealt.groupBy("shard").agg(F.sum(F.octet_length("ids") / 2).alias("n")).agg(F.max("n")).first()[0]
    assert most <= 900


def brute_scores(query, docs, df, n, mean):
    """BM25 of each document for the distinct terms of query, from the formula."""
    out = []
    for d in docs:
        tf = Counter(d.tolist())
        out.append(sum(math.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(d) / mean)) for t in set(query.tolist()) if t in tf))
    return out


@pytest.mark.parametrize("size", [12, 150])
def test_scores_of_a_hot_group(size):
    """A third of the rows are near copies: their terms count, and with the production parameters they find each other."""
    rng = np.random.default_rng(size)
    base = rng.integers(1000, 1200, 60)
    docs = []
    for k in range(size):
        d = rng.integers(2000, 9000, 60) if k % 3 else base.copy()
        d[:3] = rng.integers(9000, 9900, 3)
        docs.append(np.append(d, 1).astype(np.uint16))
    df = df_of(docs)
    index = retrieval_pack.ShardIndex(docs, df, size, 61.0)
    for seed in (0, 1, 3):
        want = brute_scores(docs[seed], docs, df, size, 61.0)
        assert np.allclose(index.scores(index.terms[seed]), want, rtol=1e-4)
        got = list(index.neighbours(seed, np.ones(size, bool)))
        assert sorted(got) == [k for k in range(size) if k != seed]
        assert all(want[a] >= want[b] - 1e-3 for a, b in zip(got, got[1:]))
    near = list(index.neighbours(0, np.ones(size, bool)))[: size // 3 - 1]
    assert all(k % 3 == 0 for k in near)


def test_word_bpe_equals_library():
    """Many texts at once, of plain and of odd characters: the ids are the library's."""
    known, rng = word_bpe.word_bpe(retrieval_pack.DEFAULT_VOCABULARY), np.random.default_rng(4)
    letters = [*"aAzZ019'strevml.,-_<|>!? \n\x0b\x1c\x1f\x85\xa0ßÉñİſΣσ中²½ǅ", "<|startoftext|>", "<|endoftext|>", "'re", "é", "aaaa", "ing", "tion"]
    texts = ["".join(letters[k] for k in rng.integers(0, len(letters), rng.integers(0, 25))) for _ in range(3000)]
    texts += ["".join(map(chr, rng.integers(0x20, 0x260, 30))) for _ in range(2000)] + [None, "", "ab" * 5000, "x" * 5000]
    for part in (pa.array(texts), pa.array(texts).slice(7, 1000), pa.array(texts[:0], pa.string()), pa.array([None, None], pa.string())):
        ids, ends = known.encode(part, 1)
        begin = 0
        for text, end in zip(part.to_pylist(), ends.tolist(), strict=True):
            assert ids[begin:end].tolist() == [*WORD.encode(text or "", add_special_tokens=False).ids, 1]
            begin = end
        assert begin == len(ids)


def test_licences(spark):
    near = "Permission is hereby granted, fre of charge, to any person obtainng a copy"
    rows = [*ODD, (10, "x MIT License. the mit LICENSE"), (11, near), (12, "gnu general public licence"), (13, "cc-by"), (14, "CC BY-NC 4.0 Licensed under CC BY-NC 4.0."), (15, "mitlicense")]
    found = {(r["doc_id"], r["n_words"]): r for r in license_scan.license_notices(frame(spark, rows)).collect()}
    word = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for doc, text in rows:
        words = word.findall((text or "").encode().lower())
        r = found[doc, len(words)]
        at = {i: label for phrase, label in license_scan.BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.encode().split()}
        assert r["n_base"] == len(at) and r["base_labels"] == ",".join(sorted(set(at.values())))
        assert (r["first_word"], r["last_word"]) == (min(at, default=None), max(at, default=None))
        assert set(at.values()) <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1
    by = {r["doc_id"]: r for r in found.values()}
    assert by[11]["labels"] == "mit" and [s["edits"] for s in by[11]["spans"]] == [2] and 0 < by[11]["score"] < 1
    assert by[12]["labels"] == "gpl" and by[12]["n_base"] == 0
    assert by[14]["labels"] == "cc-by,cc-by-nc" and by[15]["labels"] == "mit" and [s["edits"] for s in by[15]["spans"]] == [1]
    assert by[13]["labels"] == "cc-by" and by[3]["labels"] == "" and by[3]["score"] == 0
    assert license_scan.license_notices(frame(spark).limit(0)).count() == 0


def altered(notice, edits, rng):
    """The notice with up to so many substitutions, insertions and deletions inside it."""
    letters = list(notice)
    for _ in range(edits):
        k, letter = int(rng.integers(1, len(letters) - 1)), "qzx "[rng.integers(0, 4)]
        kind = int(rng.integers(0, 3))
        letters[k : k + (kind != 1)] = [letter] * (kind != 2)
    return " ".join("".join(letters).split())


def test_fuzzy_search_equals_whole_text_regex():
    """What bounded-error matching finds in the whole text, seeds and spans find too, for substitutions, insertions and deletions."""
    search, rng = license_scan.NoticeSearch(), np.random.default_rng(7)
    found = 0
    for notice, _, edits in license_scan.NOTICES:
        for _ in range(6):
            text = f" some words before {altered(notice, int(rng.integers(0, edits + 1)), rng)} and after {altered(notice, edits, rng)} at the end "
            spans = search.candidates(text)[1]
            own = [(h.label, h.allowed, h.start, h.end, h.edits) for h in search.hits(text, spans)]
            for k, (_, label, allowed) in enumerate(license_scan.NOTICES):
                whole = [(m.start() - 1, m.end() - 1, sum(m.fuzzy_counts)) for m in search.patterns[k].finditer(text) if m.end() > m.start()]
                found += len(whole)
                for start, end, n in whole:
                    # A span opens later than the text, so a match there may begin some characters aside, with no more edits.
                    assert any(x[:2] == (label, allowed) and x[2] < end and start < x[3] for x in own), (text, label)
                    assert min(x[4] for x in own if x[:2] == (label, allowed) and x[2] < end and start < x[3]) <= allowed
    assert found > 200


def test_many_notices_take_linear_time():
    import time

    search, took = license_scan.NoticeSearch(), []
    for n in (1000, 4000):
        words = ("the MIT License and the apache license or gnu general public licence, " * n).lower().replace(",", "").encode().split()
        began = time.process_time()
        base, hits = search.scan(words)
        took.append(time.process_time() - began)
        assert len(base) == 2 * n and len({w for _, w in base}) == 2 * n and len(hits) >= 3 * n
    assert took[1] < 10 * took[0]


def test_toxicity(spark):
    rng = np.random.default_rng(3)
    plain = [f"word{k}" for k in range(200)] + ["women", "muslims"]
    bad = ["stupidness", "stupidity", "stupidest", "moron", "morons"]
    rows, labels = [], []
    for k in range(600):
        words = list(rng.choice(plain, 30))
        toxic = k % 5 == 0
        if toxic:
            words += list(rng.choice(bad, 2)) + ["women"] * (k % 2)
        rows.append((k, " ".join(words)))
        labels.append((k, 0, int(toxic)))
    rows += [(None, "a"), (1000, None), (1001, ""), (7, rows[7][1])]
    docs, marks = frame(spark, rows), spark.createDataFrame([*labels, (5, 0, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, marks)
    found = toxicity.toxicity(docs, model).collect()
    assert len(found) == len(rows)
    truth = {k: t for k, _, t in labels}
    held = [r for r in found if r["held_out"] and r["doc_id"] in truth]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in found if r["doc_id"] is not None)
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.95
    score = model.scorer()
    assert abs(score("the women are here") - score("the jews are here")) < 0.05 and score("women muslims") < 0.3 < score("you moron and morons, stupidest")
    assert all(r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in found)
    kept = toxicity.drop_toxic(docs, marks)
    assert kept.columns == docs.columns and kept.count() == sum(not r["predicted"] for r in found)
    none = toxicity.train(docs, marks.limit(0))
    assert {r["predicted"] for r in toxicity.toxicity(docs, none).collect()} == {0}
    assert toxicity.toxicity(docs.limit(0), model).count() == 0


def test_swap_penalty_clears_group_mentions(spark):
    """Group terms that go with toxic rows in the labels get weight without the penalty and lose it with the penalty."""
    rng = np.random.default_rng(11)
    plain = [f"word{k}" for k in range(200)]
    rows, labels = [], []
    for k in range(900):
        toxic = k % 3 == 0
        words = list(rng.choice(plain, 20)) + (["vile"] if toxic and k % 2 else []) + (["muslims"] if rng.random() < (0.6 if toxic else 0.08) else [])
        rows.append((k, " ".join(words)))
        labels.append((k, 0, int(toxic)))
    docs, marks = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    odds = lambda p: math.log(p / (1 - p))
    shift = {}
    for strength in (0.0, 1.0):
        score = toxicity.train(docs, marks, swap_strength=strength).scorer()
        shift[strength] = odds(score("word1 word2 muslims")) - odds(score("word1 word2"))
        assert odds(score("word1 word2 vile")) - odds(score("word1 word2")) > 1
    assert shift[0.0] > 1 and abs(shift[1.0]) < 0.25 * shift[0.0]


def test_elias_fano():
    rng = np.random.default_rng(1)
    for n, universe in ((1, 1), (1, 10), (5, 5), (100, 1000), (1000, 100), (3000, 1 << 40)):
        values = np.sort(rng.integers(0, universe, n).astype(np.uint64))
        packed = elias_fano.EliasFano(values, universe)
        assert (packed.access(np.arange(n)) == values).all()
        x, a = rng.integers(0, universe + 3, 500).astype(np.uint64), rng.integers(0, n + 1, 500)
        b = np.maximum(a, rng.integers(0, n + 1, 500))
        want = [i + int(np.searchsorted(values[i:j], v)) for v, i, j in zip(x, a, b, strict=True)]
        assert packed.successor(x, a, b).tolist() == want
    big = elias_fano.EliasFano(np.arange(0, 1 << 20, 16, dtype=np.uint64), 1 << 20)
    assert big.nbytes() * 8 / big.n < 9


def test_trie(tmp_path):
    rng = np.random.default_rng(2)
    pairs = np.unique(rng.integers(0, 300, 4000) * 5000 + rng.integers(0, 5000, 4000))
    trie = elias_fano.Trie((pairs // 5000).astype(np.uint64), (pairs % 5000).astype(np.uint64), np.arange(len(pairs)) % 250, 5000, str(tmp_path))
    ask = np.sort(np.concatenate([pairs[::3], rng.integers(0, 310 * 5000, 3000)]))
    place = np.searchsorted(pairs, ask)
    want = np.where((place < len(pairs)) & (pairs[np.minimum(place, len(pairs) - 1)] == ask), place, -1)
    assert (trie.find((ask // 5000).astype(np.uint64), (ask % 5000).astype(np.uint64)) == want).all()


def test_word_ids_that_do_not_fit():
    assert ngram_lm.Totals(10**12, 1 << 33, 1, 1, (1 << 22) - 1, 1023).ids == (1 << 22) * 1023
    with pytest.raises(ValueError, match="word ids"):
        ngram_lm.Totals(10**12, 1 << 33, 1, 1, 1 << 22, 1024)
    # Pairs of the largest ids are told apart.
    size = (1 << 32) - 1
    keys = ngram_lm._pairs(np.array([size - 1, size - 1, size - 2], np.uint32), np.array([size - 1, size - 2, size - 1], np.uint32), size)
    assert keys.tolist() == [(size - 1) * size + size - 1, (size - 1) * size + size - 2, (size - 2) * size + size - 1]


@pytest.mark.parametrize("source,fan", [("odd", 256), ("table", 256), ("table", 2), ("odd", 1)])
def test_language_model(spark, source, fan):
    """Against the formulas; with few shards that each block addresses, and with groups of shards and merged messages."""
    docs = frame(spark) if source == "odd" else table(spark, SF, "documents").repartition(5)
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    found = ngram_lm.lm_scores(docs, pair_tokens=4_000 if fan < 9 else 20_000, shard_words=5_000, fan=fan, block_tokens=6_000 if fan < 9 else 2_000_000).collect()
    tokens = [(i, (t or "").encode().lower().split() + [b""]) for i, t in rows]
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1
    words, pairs = Counter(), Counter()
    for i, w in tokens:
        if not held(i):
            words.update(w)
            pairs.update(zip([b"", *w], w, strict=False))
    n, v = sum(words.values()), len(words)
    totals = ngram_lm.Totals(n, v, sum(c == 1 for c in words.values()), sum(c == 2 for c in words.values()), v, 1)
    want = []
    for i, w in tokens:
        base = sum(math.log10((words[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        score = 0.0
        for u, x in zip([b"", *w], w, strict=False):
            p1 = 10 ** float(totals.unigram(np.array([words[x]]))[0])
            share = float(totals.novelty(np.array([float(words[u])]))[0])
            score += math.log10((1 - share) * pairs[u, x] / words[u] + share * p1 if words[u] else p1)
        want.append((i if i is not None else -1, held(i), len(w), sum(words[x] > 0 for x in w), n, base, score))
    got = [(r["doc_id"] if r["doc_id"] is not None else -1, r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in found]
    for a, b in zip(sorted(got), sorted(want), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9) and abs(a[6] - b[6]) <= 0.05 * a[2]
    if source == "table":
        total = lambda k: sum(r[k] for r in got if r[1])
        assert total(6) > total(5)
    assert ngram_lm.lm_scores(docs.limit(0)).count() == 0
    # The two levels sum to one.
    p1 = sum(10 ** totals.unigram(np.array(list(words.values()), float))) + 10 ** float(totals.unigram(np.array([0.0]))[0])
    assert p1 == pytest.approx(1)
