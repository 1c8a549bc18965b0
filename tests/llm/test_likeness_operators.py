"""Near-dedup, fingerprints and the pipeline against brute force."""

import hashlib
import itertools
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stratapack.llm import graph, imatch, near_dedup
from stratapack.llm.common import table
from tests.conftest import SF


def brute_components(rows, words, percent=80):
    sets = [near_dedup.shingle_set(t, words) for _, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, a), (j, b) in itertools.combinations(zip([i for i, _ in rows], sets, strict=True), 2):
        if i is not None and j is not None and a and b and 100 * len(a & b) >= percent * len(a | b):
            x, y = root(i), root(j)
            parent[max(x, y)] = min(x, y)
    return sorted((i if i is not None else -1, len(s), root(i) if i is not None else None, i is None or root(i) == i) for (i, _), s in zip(rows, sets, strict=True))


def family(seed, size=60, words=200, edits=12):
    """Copies of one text at growing distance, a chain of small edits, copies of copies."""
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(3000)]
    base = [rng.choice(vocabulary) for _ in range(words)]
    out = []
    for k in range(size):
        text = list(base if k % 3 else out[-1].split() if out else base)
        for _ in range(rng.randint(0, edits)):
            text[rng.randrange(len(text))] = rng.choice(vocabulary)
        out.append(" ".join(text))
    return out


@pytest.mark.parametrize("words,heavy", [(2, 400), (2, 0), (5, 5)])
def test_components(spark, words, heavy):
    texts = family(1) + family(2, 30, 25, 3) + ["a b c", "A b  c", None, "", "x", "X", "a b", "a b"]
    rows = list(enumerate(texts)) + [(None, "a b c"), (3, texts[3]), (900, "q " * 60_000)]
    random.Random(5).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component", F.lit("clash")).withColumn("n", F.lit(0))
    found = near_dedup.near_duplicates(docs, words=words, heavy_pairs=heavy)
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_shingles"], r["component_id"], r["kept"]) for r in found.collect())
    assert got == brute_components(rows, words)
    assert near_dedup.near_duplicates(docs.limit(0), words=words).count() == 0


def test_components_of_the_table(spark):
    docs = table(spark, SF, "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = sorted(tuple(r) for r in near_dedup.near_duplicates(docs, words=2).collect())
    assert got == brute_components(rows, 2)


def test_signature_estimates():
    """Minima and maxima agree about as often as the sets overlap."""
    sketch = near_dedup.Sketcher(1, 128, 6)
    a, b = (" ".join(f"t{k}" for k in range(i, i + 300)) for i in (0, 50))
    x, y = (sketch.signature(sketch.shingles(t)) for t in (a, b))
    assert abs((x == y).mean() - 250 / 350) < 0.1


def test_graph(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (7, 7)]
    found = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_next_documents_and_edits(spark):
    docs = table(spark, SF, "documents")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    found = sorted(imatch.imatch(docs).collect())
    for k, (doc, text) in enumerate(rows):
        following, n = rows[(k + 1) % len(rows)][1], len(text)
        edited = text[: n - n // 2] + following[: n // 2]
        assert (found[k]["doc_id"], found[k]["n_chars"], found[k]["edited"]) == (doc, n, edited)
    assert sum(r["near_edited"] for r in found) > 5 * sum(r["near_next"] for r in found)
    by_text = {}
    for (_, text), r in zip(rows, found, strict=True):
        by_text.setdefault(text, set()).add(r["fingerprint"])
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert all(len(v) == 1 for v in by_text.values())
    assert len({next(iter(v)) for v in by_text.values()}) > 0.95 * len(by_text)


def test_fingerprints_of_odd_rows(spark):
    rows = [(1, "a b"), (None, None), (2, ""), (2, "zz"), (3, "word " * 40_000), (10**15, "a b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("range", F.lit("clash")).withColumn("edited", F.lit(1))
    found = imatch.imatch(docs).collect()
    assert len(found) == len(rows)
    assert {(r["doc_id"], r["n_chars"]) for r in found} == {(i, len(t or "")) for i, t in rows}
    assert len({r["fingerprint"] for r in found if r["n_chars"] == 3}) == 1
    assert imatch.imatch(docs.limit(0)).count() == 0
    one = imatch.imatch(docs.filter("doc_id = 1")).first()
    assert one["near_next"] == 1.0 and hashlib.sha256(one["edited"].encode()).hexdigest() == hashlib.sha256(b"a a").hexdigest()


def brute_prints(texts, band):
    """xxhash64 of Spark, by hand: term sets and the parts that they give, as comparable values."""
    import re

    import xxhash

    def h(word):
        x = xxhash.xxh64_intdigest(word.encode(), 42)
        return x

    terms = [{h(w) for w in re.split(r"[\W_]+", t.lower())} - {h("")} for t in texts]
    distinct, n = {}, len(texts)
    for t, own in zip(texts, terms, strict=True):
        distinct.setdefault(t, own)
    copies = {t: texts.count(t) for t in distinct}
    hot = {t for t, c in copies.items() if c > 1 and c > imatch.HOT * n}
    n -= sum(copies[t] - 1 for t in hot)
    df = {}
    for t, own in distinct.items():
        for w in own:
            df[w] = df.get(w, 0) + (1 if t in hot else copies[t])
    lex = {w for w, c in df.items() if band[0] * n <= c <= max(1.0, band[1] * n)}

    def parts(text):
        own = {h(w) for w in re.split(r"[\W_]+", text.lower())} & lex or {h(text.lower()) | 1 << 64}
        return [frozenset(own), *(frozenset(w for w in own if w >> s & ((1 << b) - 1) == 0) for s, b in imatch.SUBSETS)]

    return parts


def test_fingerprints_equal_brute_force(spark):
    """Equal parts and likenesses are those of sets of terms in an exact lexicon, with a hot group of copies among the rows."""
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(400)]
    texts = [" ".join(rng.choices(vocabulary, weights=[1 / (k + 3) for k in range(400)], k=rng.randint(1, 60))) for _ in range(90)] + ["hot words of one text, again"] * 30
    band = (0.01, 0.2)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = sorted(imatch.imatch(docs, band).collect())
    parts = brute_prints(texts, band)

    def like(a, b):
        # The part of the whole lexicon, or of the text itself, is never empty.
        used = [(x, y) for x, y in zip(a, b, strict=True) if x or y]
        return sum(x == y for x, y in used) / len(used)

    hashed = lambda p: any(w >> 64 for w in p[0])
    for k, r in enumerate(found):
        own, changed, following = parts(texts[k]), parts(r["edited"]), parts(texts[(k + 1) % len(texts)])
        if not (hashed(own) or hashed(changed)):
            assert r["near_edited"] == pytest.approx(like(own, changed))
        if not (hashed(own) or hashed(following)):
            assert r["near_next"] == pytest.approx(like(own, following))
    assert sum(hashed(parts(t)) for t in texts[:90]) < 20 and not hashed(parts(texts[-1]))


def test_lexicon_is_not_in_the_plan_text(spark):
    """Spark's driver keeps and logs the text of each plan; it doesn't grow with the lexicon, and no row carries the lexicon."""
    rng = random.Random(8)
    docs = spark.createDataFrame([(i, " ".join(f"w{rng.randrange(4000)}" for _ in range(200))) for i in range(200)], "doc_id long, text string")
    band = (0.01, 0.2)
    terms = sum(map(len, imatch.lexicon(docs, band)))
    assert terms > 3000
    plan = imatch.imatch(docs, band)._jdf.queryExecution()
    assert len(plan.toString()) < 40 * terms
    assert "lex" not in plan.executedPlan().output().mkString() and " AS lex#" not in plan.optimizedPlan().toString()


def test_ranges_are_even(spark):
    """Ids far apart don't leave all rows to one range."""
    ids = [*range(1000), 1 << 60, None]
    docs = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    place, n = imatch._ranges(docs, 8)
    sizes = [r["count"] for r in docs.groupBy(place.alias("r")).count().orderBy("r").collect()]
    assert len(sizes) == n == 8 and max(sizes) < 200
    place, n = imatch._ranges(docs, 1)
    assert n == 1
    rows = spark.createDataFrame([(i, str(i)) for i in ids if i is not None], "doc_id long, text string")
    after = {r["doc_id"]: r["next"]["text"] for r in imatch.with_next(rows, count=7).collect()}
    order = sorted(after)
    assert after == {i: str(j) for i, j in zip(order, order[1:] + order[:1], strict=True)}


def odd_documents(spark):
    """Documents with nulls, repeated rows, very long texts and columns that clash with those of the stages."""
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in table(spark, SF, "documents").limit(40).collect()]
    rows += [(1000, None, None), (1001, "", "en"), (1002, " \t\n", None), (None, None, None), (None, "a text without an id", "en"), (1003, "repeated row of one document", "en"), (1003, "repeated row of one document", "en"), (1004, "word " * 50_000, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for name in ("ids", "h", "keep_id", "kept", "kept_id", "gone_id", "cell", "shard", "row", "a", "b", "component", "score", "start"):
        docs = docs.withColumn(name, F.lit(f"clash of {name}"))
    return docs


def test_pipeline_of_odd_rows(spark, tmp_path):
    docs = odd_documents(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = table(spark, SF, "labels")
    labels.unionByName(spark.createDataFrame([(None, None, 1), (5, 1, None), (6, None, 0)], "doc_id long, quality int, toxic int")).write.parquet(str(tmp_path / "labels.parquet"))
    kept, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES[:3]:
        kept = corpus_pipeline.staged(stage(spark, kept, str(tmp_path)), name)
        assert kept.columns == docs.columns
        seen[name] = [(r["doc_id"], r["text"]) for r in kept.collect()]
        assert all(r["row"] == "clash of row" for r in kept.select("row").collect())
    # Of the four texts without words one row stays, of the repeated row too; rows without an id stay.
    exact = seen["exact_dedup"]
    assert sum(not (t or "").strip() for _, t in exact) == 1 and sum(i == 1003 for i, _ in exact) == 1
    assert (None, "a text without an id") in exact and (1004, "word " * 50_000) in exact
    assert {i for i, _ in seen["near_dedup"]} == {i if i != -1 else None for i, _, _, keep in brute_components(exact, 5) if keep}
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in rows} == {i for i, _ in seen["near_dedup"]}


def test_links_of_repeated_ids(spark):
    """Two rows of one doc_id with texts of one length are both compared."""
    a, b = (" ".join(f"{x}{k:03}" for k in range(100)) for x in "xy")
    rows = [(1, a), (1, b), (2, a + " more"), (3, b + " more")]
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=2).collect()
    assert {(r["doc_id"], r["component_id"]) for r in found} == {(1, 1), (2, 1), (3, 1)}


def test_pipeline(spark):
    docs = table(spark, SF, "documents")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        before, kept = kept, corpus_pipeline.staged(stage(spark, kept, SF), name)
        assert kept.columns == docs.columns
        left = {r["doc_id"]: r["text"] for r in kept.collect()}
        all_ = {r["doc_id"]: r["text"] for r in before.collect()}
        assert set(left.items()) <= set(all_.items())
        if name == "exact_dedup":
            norm = lambda t: t.translate(dict.fromkeys(map(ord, " \t\n\x0b\x0c\r")))
            assert len(left) == len({norm(t) for t in all_.values()}) == len({norm(t) for t in left.values()})
        if name == "near_dedup":
            assert set(left) == {i for i, _, _, keep in brute_components(list(all_.items()), 5) if keep}
    packed = corpus_pipeline.STAGES[3][1](spark, kept, SF).collect()
    assert {r["doc_id"] for r in packed} == set(left)
    assert len(corpus_pipeline.run(spark, SF).collect()) == len(packed)


def test_pipeline_of_empty_tables(spark, tmp_path):
    for name in ("documents", "labels"):
        table(spark, SF, name).limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
