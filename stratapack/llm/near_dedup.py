"""MinHash near-dedup by min-max hashing.

One pass over the texts hashes every distinct word shingle once and, under each of
`permutations` permutations, keeps both the smallest and the largest value: two
signature values for one evaluation, each agreeing between two sets with probability equal
to their Jaccard similarity. Bands of `rows` values become bucket keys; with the
default 128 permutations (256 values, 42 bands of 6) a pair at similarity 0.8
shares no bucket with probability (1 - 0.8^6)^42 = 3e-6.

Documents with the same set (128-bit hash of all its shingles) are one class; only its
smallest doc_id goes on, so copies never meet in a bucket. In a bucket, every member is
first compared with the smallest (a star, not all pairs). The full shingle sets are
built from the texts and compared; components are formed of the links. Then
buckets that still hold several components are finished: members outside a
bucket's largest component are compared with the members of other components, each
pair once, unless already compared or too unlike in size; where that takes more than
`heavy_pairs` pairs in a bucket, block against block inside a task, so that only links
leave it. So every pair of a bucket is compared or already connected, and a large
group of near copies costs rows in proportion to its size, not its square.

Cases: without words a document's set is empty and it is linked with nothing; with
fewer words than a shingle takes, the whole sequence is its one shingle. A null doc_id
is linked with nothing and stays (component_id null, kept true). Rows that repeat a
doc_id are one document: linked if any of their texts is. An empty table gives an
empty result. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratapack.llm.common import drop_staged, rows_of, space_words, staged, table
from stratapack.llm.graph import components
from stratapack.session import ship

PERMUTATIONS, ROWS = 128, 6
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Sketcher:
    """Set hash and band keys of one text after another; the word memo is bounded."""

    def __init__(self, words: int, permutations: int, rows: int, memo: int = 400_000):
        self.words, self.rows, self.memo = words, rows, memo
        rng = np.random.default_rng(20240229)
        self.a = rng.integers(0, 1 << 31, permutations, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.b = rng.integers(0, 1 << 32, permutations, dtype=np.uint32)
        self.bands = 2 * permutations // rows
        self.powers = _mixed(np.arange(1, rows + 1, dtype=np.uint64) * _ODD) | np.uint64(1)
        self.salt = _mixed(np.arange(1, self.bands + 1, dtype=np.uint64))
        self.known: dict[bytes, int] = {}

    def shingles(self, text: str | None) -> np.ndarray:
        """Sorted distinct 64-bit hashes of the text's shingles."""
        words, known = space_words(text), self.known
        if not words:
            return np.empty(0, np.uint64)
        new = set(words).difference(known)
        if new:
            if len(known) + len(new) > self.memo:
                known.clear()
                new = set(words)
            known.update({w: xxhash.xxh3_64_intdigest(w) for w in new})
        h = np.array([known[w] for w in words], np.uint64)
        n = min(self.words, len(h))
        out = np.full(len(h) - n + 1, n, np.uint64)
        for k in range(n):
            out = _mixed(out * _ODD + h[k : len(h) - n + 1 + k])
        return np.unique(out)

    def signature(self, shingles: np.ndarray, block: int = 1024) -> np.ndarray:
        """All minima, then all maxima, of a*x + b modulo 2^32."""
        x = (shingles >> np.uint64(32)).astype(np.uint32)
        low, high = np.full(len(self.a), 0xFFFFFFFF, np.uint32), np.zeros(len(self.a), np.uint32)
        for k in range(0, len(x), block):
            v = self.a[:, None] * x[None, k : k + block]
            v += self.b[:, None]
            np.minimum(low, v.min(axis=1), out=low)
            np.maximum(high, v.max(axis=1), out=high)
        return np.concatenate([low, high])

    def keys(self, shingles: np.ndarray) -> np.ndarray:
        s = self.signature(shingles)[: self.bands * self.rows].astype(np.uint64).reshape(self.bands, self.rows)
        return _mixed((s * self.powers).sum(axis=1, dtype=np.uint64) ^ self.salt).view(np.int64)


def sketches(docs: DataFrame, words: int = 5, permutations: int = PERMUTATIONS, rows: int = ROWS) -> DataFrame:
    """doc_id, n (set size), d1, d2 (set hash), bands: one row per row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = Sketcher(words, permutations, rows)
        for batch in batches:
            ids, sizes, digests, bands, ends = [], [], [], [], [0]
            for doc_id, text in rows_of(batch):
                found = sketch.shingles(text)
                ids.append(doc_id)
                sizes.append(len(found))
                digests.append(xxhash.xxh3_128_digest(found.tobytes()))
                if len(found):
                    bands.append(sketch.keys(found))
                ends.append(ends[-1] + (sketch.bands if len(found) else 0))
            halves = np.frombuffer(b"".join(digests), "<i8")
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(halves[0::2].copy()), pa.array(halves[1::2].copy()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(bands) if bands else np.empty(0, np.int64))),
                ],
                ["doc_id", "n", "d1", "d2", "bands"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, d1 long, d2 long, bands array<long>")


def shingle_set(text: str | None, words: int) -> set:
    """The set itself, of word tuples."""
    w = space_words(text)
    return set(zip(*(w[k:] for k in range(words)), strict=False)) if len(w) >= words else {tuple(w)} if w else set()


def similar(mine: set, other: set, percent: int) -> bool:
    """Whether the sets have 100 * intersection >= percent * union and share something."""
    both = len(mine & other)
    return both > 0 and 100 * both >= percent * (len(mine) + len(other) - both)


def confirmed(pairs: DataFrame, docs: DataFrame, words: int, percent: int, fan: int = 256) -> DataFrame:
    """Those of pairs (a, b) whose full sets have 100 * intersection >= percent * union.

    The b of one a are dealt to parts of about `fan`; a part gets the text of its a once, ahead of its members,
    and holds one set beside it. A doc_id with several texts is compared with all of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, mine = None, []
        for batch in batches:
            a_out, b_out = [], []
            for a, part, side, doc, text in rows_of(batch):
                if held != (a, part):
                    held, mine = (a, part), []
                own = shingle_set(text, words)
                if not side:
                    mine.append(own)
                elif any(similar(x, own, percent) for x in mine):
                    a_out.append(a)
                    b_out.append(doc)
            yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], ["a", "b"])

    texts = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").alias("doc"), "text")
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / fan).cast("int").alias("parts"))
    dealt = pairs.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), "parts").cast("int").alias("part"), "b")
    roles = dealt.select("a", "part", F.lit(1).alias("side"), F.col("b").alias("doc")).unionByName(dealt.select("a", "part").distinct().withColumn("side", F.lit(0)).withColumn("doc", F.col("a")))
    # One plan at every size: a broadcast would serve small inputs only.
    met = roles.hint("merge").join(texts, "doc").repartition("a", "part").sortWithinPartitions("a", "part", "side")
    return met.select("a", "part", "side", "doc", "text").mapInArrow(run, "a long, b long")


def _blocks_compared(heavy: DataFrame, docs: DataFrame, words: int, percent: int, block_docs: int = 1024, block_shingles: int = 200_000) -> DataFrame:
    """Links (a, b) of crowded buckets, without a row for each pair.

    Crowded buckets with the same largest component are one neighbourhood, so a text moves once
    for it and not once for each bucket. Its documents outside that component are compared with
    all its documents. Both sides are cut to blocks of bounded documents and shingles; a
    task gets one block of each, and an inverted index over the second block's full sets (64-bit
    shingle hashes) counts all overlaps of a document at once. Of these, pairs of components that the task has
    not yet joined are confirmed on the sets themselves, so fewer links than components leave the task.
    """
    held = heavy.select("main", "doc", "component", "n").distinct()
    size = held.groupBy("main").agg(F.greatest(F.ceil(F.count(F.lit(1)) / block_docs), F.ceil(F.sum("n") / block_shingles)).cast("int").alias("blocks"))
    held = held.join(size, "main").withColumn("own", F.pmod(F.xxhash64("doc"), "blocks").cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    asks = held.filter("component <> main").select("main", F.col("own").alias("i"), every.alias("j"), F.lit(0).alias("side"), "doc", "component")
    answers = held.select("main", every.alias("i"), F.col("own").alias("j"), F.lit(1).alias("side"), "doc", "component")
    texts = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").alias("doc"), "text")
    rows = asks.unionByName(answers).hint("merge").join(texts, "doc")

    def compare(group: pa.Table) -> pa.Table:
        sketch = Sketcher(words, 1, 1)
        side = group["side"].to_numpy()
        ids, labels = group["doc"].to_numpy(), group["component"].to_numpy()
        texts = group["text"].to_pylist()
        sets = [sketch.shingles(t) for t in texts]
        second = np.flatnonzero(side == 1)
        sizes = np.array([len(sets[k]) for k in second], np.int64)
        owner = np.repeat(np.arange(len(second)), sizes)
        found = np.concatenate([sets[k] for k in second]) if len(second) else np.empty(0, np.uint64)
        order = np.argsort(found, kind="stable")
        found, owner = found[order], owner[order]
        above: dict[int, int] = {}

        def root(label: int) -> int:
            while label in above:
                if above[label] in above:
                    above[label] = above[above[label]]
                label = above[label]
            return label

        out = []
        for k in np.flatnonzero(side == 0).tolist():
            mine, exact = sets[k], None
            low, high = np.searchsorted(found, mine, "left"), np.searchsorted(found, mine, "right")
            spans = [owner[a:b] for a, b in zip(low.tolist(), high.tolist(), strict=True) if b > a]
            if not spans:
                continue
            both = np.bincount(np.concatenate(spans), minlength=len(second))
            link = (100 * both >= percent * (len(mine) + sizes - both)) & (both > 0) & (labels[second] != labels[k])
            for other in second[link].tolist():
                x, y = root(int(labels[k])), root(int(labels[other]))
                if x == y:
                    continue
                exact = exact or shingle_set(texts[k], words)
                if similar(exact, shingle_set(texts[other], words), percent):
                    above[max(x, y)] = min(x, y)
                    out.append((min(int(ids[k]), int(ids[other])), max(int(ids[k]), int(ids[other]))))
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return rows.groupBy("main", "i", "j").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, permutations: int = PERMUTATIONS, rows: int = ROWS, heavy_pairs: int = 400) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of docs."""
    ship(docs.sparkSession)
    made = staged(sketches(docs, words, permutations, rows), "sketches")
    sets = made.filter("doc_id IS NOT NULL AND n > 0")
    classes = staged(sets.groupBy("d1", "d2").agg(F.min("doc_id").alias("head"), F.min("n").alias("n")), "classes")
    heads = sets.join(classes.select("d1", "d2", F.col("head").alias("doc_id")), ["d1", "d2", "doc_id"], "left_semi")
    placed = heads.select(F.col("doc_id").alias("doc"), "n", F.explode("bands").alias("bucket"))
    shared = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("c"), F.min("doc").alias("first")).filter("c > 1")
    members = staged(placed.join(shared.select("bucket", "first"), "bucket"), "members")

    alike = lambda x, y: f"100 * least({x}, {y}) >= {percent} * greatest({x}, {y})"
    firsts = members.filter("doc = first").select("bucket", F.col("n").alias("first_n"))
    star = members.filter("doc <> first").join(firsts, "bucket").filter(alike("n", "first_n")).select(F.col("first").alias("a"), F.col("doc").alias("b")).distinct()
    star = staged(star, "star")
    links = staged(confirmed(star, docs, words, percent).distinct(), "links")
    # A doc_id whose rows have different texts heads several classes: one node links them.
    labels = staged(components(links), "labels")

    at = members.join(labels.withColumnRenamed("node", "doc"), "doc", "left").select("bucket", "doc", "n", F.coalesce("component", "doc").alias("component"))
    counts = at.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("c"))
    mixed = counts.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("k"), F.max_by("component", F.struct("c", "component")).alias("main"), F.sum("c").alias("all"), F.max("c").alias("most"),
    )
    mixed = staged(at.join(mixed.filter("k > 1").select("bucket", "main", "all", (F.col("all") - F.col("most")).alias("few")), "bucket"), "mixed")
    light, heavy = mixed.filter(f"few * all <= {heavy_pairs}"), mixed.filter(f"few * all > {heavy_pairs}")
    minor = light.filter("component <> main").select("bucket", F.col("doc").alias("x"), F.col("n").alias("xn"), F.col("component").alias("xc"))
    left = minor.join(light, "bucket").filter(f"component <> xc AND (component = main OR x < doc) AND {alike('n', 'xn')}")
    left = left.select(F.least("x", "doc").alias("a"), F.greatest("x", "doc").alias("b")).distinct().join(star, ["a", "b"], "left_anti")
    left = staged(left, "rest")
    some, many = not left.isEmpty(), not heavy.isEmpty()
    if some or many:
        # The components found so far stand for their members.
        found = labels.select(F.col("node").alias("a"), F.col("component").alias("b"))
        if some:
            found = found.unionByName(confirmed(left, docs, words, percent))
        if many:
            found = found.unionByName(_blocks_compared(heavy, docs, words, percent))
        labels = staged(components(staged(found, "more-links")), "labels")
    drop_staged(members, mixed, star, left)

    of = classes.join(labels.withColumnRenamed("node", "head"), "head", "left").select("d1", "d2", F.coalesce("component", "head").alias("component"))
    linked = made.filter("doc_id IS NOT NULL AND n > 0").drop("bands").join(of, ["d1", "d2"])
    alone = made.filter("doc_id IS NULL OR n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    linked = linked.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), (F.col("doc_id") == F.col("component")).alias("kept"))
    return linked.unionByName(alone)


def drop_near_copies(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each component; all columns. Null doc_ids stay."""
    gone = near_duplicates(docs, words, percent).filter("NOT kept").select(F.col("doc_id").alias("gone_id"))
    return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")


def op4_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=2)
