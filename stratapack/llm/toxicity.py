"""Counterfactual-regularised toxicity classifier.

A logistic model over hashed presence features of a text: its words and their
prefixes of 4 to 6 bytes. It is fitted on at most `max_rows` labelled rows of
the training folds, at most a third of them toxic if there are that many; which rows
is decided by a hash of the id, so the sample spreads over the corpus. The sample is
bounded, so it may be broadcast to find its texts. Its features are counted by class in
the tasks; the driver gets those that differ between the classes, and no texts.

Regulariser: every sampled text is paired with a counterfactual in which identity
terms are swapped for others of their group; a text without any gets a neutral
mention of one. The squared difference of the two scores before the logistic function (the log odds) is
penalised, which drives the weights of group mentions to each other and to zero.

Cases: null and empty texts are scored by the bias alone. With no labelled rows the
score is 0; with one class it is that class's share. Null labels are not used; a
doc_id labelled more than once counts with its highest label. Null doc_ids are
scored. Repeated rows are scored alike. Only doc_id and text of the
documents, and doc_id and toxic of the labels, are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratapack.llm.common import alnum_words, fold, rows_of, table
from stratapack.session import ship

BITS = 18
MAX_ROWS = 24_000
THRESHOLD = 0.3

#: Identity terms; those of one line may stand for each other.
IDENTITY = tuple(
    tuple(line.split())
    for line in (
        "women men girls boys woman man girl boy",
        "muslims christians jews hindus buddhists atheists muslim christian jewish hindu buddhist atheist",
        "black white asian latino african european arab",
        "gay lesbian straight bisexual transgender queer",
        "immigrants refugees foreigners natives citizens",
        "disabled blind deaf elderly young",
        "femmes hommes musulmans chrétiens juifs immigrés",
        "frauen männer muslime christen juden einwanderer",
        "mujeres hombres musulmanes cristianos judíos inmigrantes",
    )
)


def _swaps() -> dict[bytes, tuple[bytes, ...]]:
    out = {}
    for group in IDENTITY:
        for term in group:
            out[term.encode()] = tuple(t.encode() for t in group if t != term)
    return out


SWAPS = _swaps()
_TERMS = sorted(SWAPS)


def word_features(word: bytes) -> list[int]:
    """The word itself and its prefixes of 4, 5 and 6 bytes, hashed."""
    mask = (1 << BITS) - 1
    return [zlib.crc32(b"w" + word) & mask] + [zlib.crc32(b"p" + word[:n]) & mask for n in (4, 5, 6) if len(word) >= n]


def counterfactual(words: set[bytes], salt: int) -> tuple[set[bytes], set[bytes]]:
    """(added, removed) words of the swapped text."""
    held = sorted(w for w in words if w in SWAPS)
    if not held:
        return {_TERMS[salt % len(_TERMS)]}, set()
    added = {SWAPS[w][salt % len(SWAPS[w])] for w in held}
    return added - words, set(held) - added


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def scorer(self, memo: int = 300_000):
        """text -> probability; only words that carry weight are remembered as more than a blank."""
        known: dict[bytes, tuple[int, ...]] = {}
        weights, bias = self.weights, self.bias

        def features(word: bytes) -> tuple[int, ...]:
            if len(known) >= memo:
                known.clear()
            found = known[word] = tuple(f for f in word_features(word) if weights[f])
            return found

        def score(text: str | None) -> float:
            seen: set[int] = set()
            get = known.get
            for w in set(alnum_words(text)):
                f = get(w)
                if f is None:
                    f = features(w)
                if f:
                    seen.update(f)
            z = bias + float(sum(weights[f] for f in sorted(seen)))
            return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))

        return score


def document_features(words: set[bytes]) -> np.ndarray:
    """Sorted distinct feature numbers of a text."""
    return np.unique(np.array([f for w in words for f in word_features(w)], np.int32))


@dataclass
class Sample:
    """Labelled texts as flat arrays: label of each, features that may carry weight, and the signed features by which its counterfactual differs."""

    labels: np.ndarray
    doc: np.ndarray
    feature: np.ndarray
    swap_doc: np.ndarray
    swap_feature: np.ndarray
    swap_sign: np.ndarray


def useful(n1: np.ndarray, n0: np.ndarray, positives: int, negatives: int) -> np.ndarray:
    """Features in at least 3 texts of a class whose log odds between the classes are at least 1.5."""
    odds = np.log((n1 + 0.5) / (positives - n1 + 0.5)) - np.log((n0 + 0.5) / (negatives - n0 + 0.5))
    return (np.maximum(n1, n0) >= 3) & (np.abs(odds) >= 1.5)


def fit(sample: Sample, strength: float = 3e-5, swap_strength: float = 1.0, steps: int = 300) -> Model:
    """Logistic loss + L2 + swap penalty, by full-batch Adam with a fixed number of steps."""
    size, y = 1 << BITS, sample.labels.astype(float)
    if not len(y):
        return Model(np.zeros(size, np.float32), -40.0)
    if y.min() == y.max():
        return Model(np.zeros(size, np.float32), 40.0 if y[0] else -40.0)
    bias = float(np.log(y.mean() / (1 - y.mean())))
    used = np.unique(np.concatenate([sample.feature, sample.swap_feature]))
    col, d_col = np.searchsorted(used, sample.feature), np.searchsorted(used, sample.swap_feature)
    doc, d_doc, d_sign = sample.doc, sample.swap_doc, sample.swap_sign
    n, m = len(y), len(used)
    w, g1, g2 = np.zeros(m), np.zeros(m + 1), np.zeros(m + 1)
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(doc, w[col], n) + bias, -40, 40)))
        e = (p - y) / n
        grad = np.bincount(col, e[doc], m) + strength * w
        if len(d_doc):
            shift = np.bincount(d_doc, w[d_col] * d_sign, n)
            grad += 2 * swap_strength / n * np.bincount(d_col, shift[d_doc] * d_sign, m)
        g = np.append(grad, e.sum())
        g1, g2 = 0.9 * g1 + 0.1 * g, 0.999 * g2 + 0.001 * g * g
        move = 0.05 * (g1 / (1 - 0.9**step)) / (np.sqrt(g2 / (1 - 0.999**step)) + 1e-9)
        w, bias = w - move[:-1], bias - move[-1]
    weights = np.zeros(size, np.float32)
    weights[used] = w
    return Model(weights, float(bias))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, swap_strength: float = 1.0) -> Model:
    """Fit on at most max_rows labelled documents whose fold (crc32 of the id modulo 4) is not 2."""
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("label"))
    known = known.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    pick = lambda which, n: known.filter(which).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    chosen = pick("label = 1", max_rows // 3).unionByName(pick("label <> 1", max_rows - max_rows // 3))
    # At most max_rows rows of two numbers: a bound that holds at any corpus size.
    found = docs.filter("doc_id IS NOT NULL").select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    found = found.select("doc_id", "text", (F.col("label") == 1).cast("int").alias("label"))
    size = 1 << BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, size), np.int64)
        rows = np.zeros(2, np.int64)
        for batch in batches:
            for _, text, label in rows_of(batch):
                n[label, document_features(set(alnum_words(text)))] += 1
                rows[label] += 1
        at = np.flatnonzero(n.any(axis=0))
        feature = np.append(at, -1)
        yield pa.RecordBatch.from_arrays([pa.array(feature, pa.int64()), pa.array(np.append(n[0, at], rows[0])), pa.array(np.append(n[1, at], rows[1]))], ["feature", "n0", "n1"])

    # One row for each of at most 2^BITS hashed features; only those that may carry weight leave Spark.
    sums = found.mapInArrow(count, "feature long, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    table_ = sums.filter("feature < 0 OR n0 >= 3 OR n1 >= 3").toArrow().to_pydict()
    counts = {c: np.array(table_[c], np.int64) for c in ("feature", "n0", "n1")}
    head = counts["feature"] < 0
    negatives, positives = int(counts["n0"][head].sum()), int(counts["n1"][head].sum())
    keep = np.zeros(size, bool)
    keep[counts["feature"][~head]] = useful(counts["n1"][~head], counts["n0"][~head], positives, negatives)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text, label in rows_of(batch):
                words = set(alnum_words(text))
                features = document_features(words)
                added, removed = counterfactual(words, zlib.crc32(b" ".join(sorted(words))))
                plus, minus = (document_features(w) if w else np.empty(0, np.int32) for w in (added, removed))
                out.append((doc_id, label, *(f[keep[f]].astype("<i4").tobytes() for f in (features, plus, minus))))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "label", "features", "plus", "minus"])

    rows = found.mapInArrow(gather, "doc_id long, label int, features binary, plus binary, minus binary").toArrow()
    rows = rows.sort_by([("doc_id", "ascending"), ("features", "ascending")])
    flat = lambda c: [np.frombuffer(x.as_py(), "<i4") for x in rows[c]]
    parts = {c: flat(c) for c in ("features", "plus", "minus")}
    place = {c: np.repeat(np.arange(len(v)), [len(x) for x in v]) for c, v in parts.items()}
    joined = {c: np.concatenate(v) if v else np.empty(0, np.int32) for c, v in parts.items()}
    return fit(
        Sample(
            rows["label"].to_numpy(), place["features"], joined["features"],
            np.concatenate([place["plus"], place["minus"]]), np.concatenate([joined["plus"], joined["minus"]]),
            np.concatenate([np.ones(len(joined["plus"])), -np.ones(len(joined["minus"]))]),
        ),
        swap_strength=swap_strength,
    )


def toxicity(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per row of docs, scored where it lies."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            p = np.array([score(t) for t in texts], float)
            held = [fold(i, 4) == 2 for i in ids.to_pylist()]
            yield pa.RecordBatch.from_arrays([ids, pa.array(held, pa.bool_()), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without those that the classifier rejects; all columns."""
    spark = docs.sparkSession
    ship(spark)
    model = train(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            yield batch.filter(pa.array([score(t) < threshold for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity(docs, train(docs, table(spark, sf_dir, "labels")))
