"""I-Match fingerprints over a document-frequency band and randomised lexicon subsets. Native.

The lexicon is the set of terms, told apart by 64-bit hashes, whose share of documents lies in the band (that
is, whose inverse document frequency does). One aggregation over all documents counts in how many each
term occurs. A band term is in at least the lower share of documents, so there are at most (mean distinct
terms of a document) / (lower share) of them whatever the corpus holds: the lexicon can be one value of the
plan, as a hash table of short arrays, and no terms are joined or shuffled after it is known. Of a text that makes
up over a thousandth of all rows, the copies count as one document, so that a large group of copies doesn't push
its own terms over the band.

A text's terms are its lower-cased runs of letters and digits. The distinct hashes of
those in the lexicon are sorted; the first fingerprint part is the hash of all, the
others are the hashes of what falls in each randomised subset of the lexicon. Subsets
take a quarter to a 256th of it, so that short and long texts both have subsets that
a small edit leaves alone. The likeness of two fingerprints is the share of equal parts
among those that are not empty in both.

The next document by ascending id is found inside ranges of ids between approximate quantiles, so ranges hold
about as many rows however the ids are spread; a window inside a range looks one row ahead, and a range's last row
gets the first of the next range. Texts are shuffled once, each with its own fingerprint.

Cases: a null text counts as empty. A text without terms in the lexicon has its
whole lower-cased self as its only term. Null doc_ids come before all others; rows that repeat
a doc_id are ordered by text. A single row is its own next document. An empty
table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import json
from math import isqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratapack.llm.common import staged, table, text_of

#: Shares of documents that a lexicon term may occur in.
BAND = (5e-4, 0.05)
#: Copies of a text that makes up more than this share of the rows count as one.
HOT = 1e-3
#: (shift, bits): a term is in the subset if so many bits of its hash from there on are 0.
SUBSETS = tuple((s, 2) for s in range(0, 8, 2)) + tuple((s, 4) for s in range(3, 35, 4)) + tuple((s, 6) for s in range(1, 61, 6)) + tuple((s, 8) for s in range(5, 61, 7))
#: xxhash64 of an empty array is its seed.
_EMPTY = 42
_WORDS = r"[^\p{L}\p{N}]+"


def _hashes(text: Column) -> Column:
    return F.transform(F.split(F.lower(text), _WORDS), lambda w: F.xxhash64(w))


def _slot(h: Column, bits: int) -> Column:
    return F.shiftrightunsigned(h, 64 - bits).cast("int")


def lexicon(docs: DataFrame, band: tuple[float, float] = BAND) -> list[list[int]]:
    """The hashes of the terms in the band, in 2^bits slots by their first bits; at least one slot for two terms."""
    n = docs.count()
    docs, mark = docs.select(text_of().alias("text")), F.xxhash64("text")
    # Fewer than 1 / HOT rows.
    hot = dict(docs.groupBy(mark.alias("text_hash")).agg(F.count(F.lit(1)).alias("c")).filter((F.col("c") > HOT * n) & (F.col("c") > 1)).collect())
    if hot:
        n -= sum(hot.values()) - len(hot)
        is_hot = mark.isin(list(hot))
        once = docs.filter(is_hot).groupBy(mark.alias("text_hash")).agg(F.first("text").alias("text")).select("text")
        docs = docs.filter(~is_hot).unionByName(once)
    terms = docs.select(F.explode(F.array_distinct(_hashes(F.col("text")))).alias("h"))
    df = F.count(F.lit(1))
    kept = terms.groupBy("h").agg(df.alias("df")).filter((F.col("df") >= band[0] * n) & (F.col("df") <= max(1.0, band[1] * n)) & (F.col("h") != F.xxhash64(F.lit(""))))
    found = [h for (h,) in kept.select("h").collect()]
    bits = max(1, len(found).bit_length())
    out: list[list[int]] = [[] for _ in range(1 << bits)]
    for h in sorted(found):
        out[(h & ((1 << 64) - 1)) >> (64 - bits)].append(h)
    return out


def value(spark: SparkSession, lex: list[list[int]]) -> Column:
    """The lexicon as one value of a plan. A subquery, as a literal's text would stand in every print of the plan that the driver
    keeps and logs. Lambdas may not hold it: add it to the rows and name each column that is read beside it only once, then the
    optimiser puts it in the column's place and no row gets a copy."""
    return spark.createDataFrame(pa.table({"lex": pa.array([lex], pa.list_(pa.list_(pa.int64())))})).scalar()


def fingerprint(text: Column, lex: Column, bits: int) -> Column:
    """Array of longs, one for the whole lexicon (in 2^bits slots) and one for each subset; _EMPTY where no term falls in. For use in a lambda that binds text and lex."""
    known = lambda h: F.array_contains(F.get(lex, _slot(h, bits)), h)
    terms = F.array_sort(F.array_distinct(F.filter(_hashes(text), known)))

    def parts(found: Column) -> Column:
        subset = lambda shift, bits: F.filter(found, lambda h: F.shiftrightunsigned(h, shift).bitwiseAND(F.lit((1 << bits) - 1)) == 0)
        return F.array(F.xxhash64(found), *(F.xxhash64(subset(s, b)) for s, b in SUBSETS))

    # Lambda variables bind what is used many times, so that it is computed once.
    whole = lambda t: F.when(F.size(t) > 0, t).otherwise(F.array(F.xxhash64(F.lower(text))))
    bound = F.transform(F.array(terms), lambda t: whole(t))
    return F.get(F.transform(bound, parts), F.lit(0))


def shown(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda p: F.when(p == _EMPTY, F.lit("-")).otherwise(F.lower(F.hex(p)))), ".")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal parts among those not empty in both; the part of the whole lexicon is never empty."""
    each = F.zip_with(a, b, lambda x, y: F.when((x == _EMPTY) & (y == _EMPTY), F.lit(0)).when(x == y, F.lit(1001)).otherwise(F.lit(1)))
    total = F.aggregate(each, F.lit(0), lambda s, x: s + x)
    return F.transform(F.array(total), lambda t: F.floor(t / 1000).cast("double") / (t % 1000))[0]


def _ranges(docs: DataFrame, count: int) -> tuple[Column, int]:
    """Each row's range of ids, numbered from 0 without gaps, of about equal row count; nulls are in range 0."""
    shares = [k / count for k in range(1, count)]
    found = docs.agg(F.min("doc_id").alias("low"), F.percentile_approx("doc_id", shares or [0.5], 10 * max(1000, count)).alias("cuts")).first()
    # Every cut is an id of the table other than the least, so no range is empty.
    cuts = sorted(set(found["cuts"] or []) - {found["low"]}) if shares else []
    if not cuts:
        return F.lit(0), 1
    step = isqrt(len(cuts)) + 1
    upto = lambda held: F.size(F.filter(held, lambda c: c <= F.col("doc_id")))
    every = F.from_json(F.lit(json.dumps(cuts)), "array<bigint>")
    # First among every step-th cut, then among the cuts from there on.
    coarse = upto(F.from_json(F.lit(json.dumps(cuts[::step])), "array<bigint>"))
    begin = F.greatest(coarse - 1, F.lit(0)) * step
    place = begin + upto(F.slice(every, begin + 1, F.lit(step)))
    return F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(place), len(cuts) + 1


def with_next(docs: DataFrame, lex: Column | None = None, bits: int = 0, count: int | None = None) -> DataFrame:
    """Each row of docs (doc_id, text), with lex also `print`, its fingerprint, and `next`, a struct of the same columns without doc_id of the row that follows by doc_id, the first after the last."""
    spark = docs.sparkSession
    count = count or int(spark.conf.get("spark.sql.shuffle.partitions"))
    place, n = _ranges(docs, count)

    def owned(rows: DataFrame, at: Column, name: str, *more: str) -> DataFrame:
        if lex is None:
            return rows.select(*more, at.alias("range"), F.struct("text").alias(name))
        both = F.transform(F.array(F.struct("text", "lex")), lambda r: F.struct(r["text"].alias("text"), fingerprint(r["text"], r["lex"], bits).alias("print")))
        return rows.withColumn("lex", lex).select(*more, at.alias("range"), both[0].alias(name))

    placed = owned(docs, place, "own", "doc_id")
    # The first row of each range: as many ids as ranges, then their texts.
    rank = F.coalesce("doc_id", F.lit(-(1 << 63)))
    at = docs.select("doc_id", "text", place.alias("range"))
    heads = at.groupBy("range").agg(F.min(rank).alias("head"))
    first = at.join(F.broadcast(heads), "range").filter(rank == F.col("head")).groupBy("range").agg(F.min("text").alias("text"))
    first = owned(staged(first, "first-texts"), (F.col("range") + F.lit(n - 1)) % F.lit(n), "first")
    inside = Window.partitionBy("range").orderBy("doc_id", "own.text")
    ahead = placed.withColumn("ahead", F.lead("own").over(inside))
    return ahead.join(first.hint("merge"), "range").select("doc_id", "own.*", F.coalesce("ahead", "first").alias("next"))


def imatch(docs: DataFrame, band: tuple[float, float] = BAND) -> DataFrame:
    """doc_id, n_chars, edited, fingerprints of the text and the edited text, and their likenesses."""
    docs = docs.select("doc_id", text_of().alias("text"))
    slots = lexicon(docs, band)
    lex, bits = value(docs.sparkSession, slots), len(slots).bit_length() - 1

    def compared(r: Column) -> Column:
        n = F.length(r["text"])
        half = F.floor(n / 2).cast("int")
        edited = F.concat(r["text"].substr(F.lit(1), n - half), r["next"]["text"].substr(F.lit(1), half))
        # What a lambda returns is copied, so none returns the lexicon.
        printed = F.transform(F.array(edited), lambda e: F.struct(e.alias("edited"), fingerprint(e, r["lex"], bits).alias("print")))
        return F.transform(
            printed,
            lambda e: F.struct(
                n.cast("long").alias("n_chars"), e["edited"].alias("edited"),
                shown(r["print"]).alias("fingerprint"), shown(e["print"]).alias("edited_fingerprint"),
                likeness(r["print"], e["print"]).alias("near_edited"), likeness(r["print"], r["next"]["print"]).alias("near_next"),
            ),
        )[0]

    # Structs bound by lambdas: each fingerprint is computed once, though it is used three times.
    rows = with_next(docs, lex, bits).withColumn("lex", lex)
    found = F.transform(F.array(F.struct("text", "print", "next", "lex")), compared)
    return rows.select("doc_id", found[0].alias("r")).select("doc_id", "r.*")


def op2_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = imatch(table(spark, sf_dir, "documents"))
    return found.withColumn("edited_sha256", F.sha2("edited", 256)).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
