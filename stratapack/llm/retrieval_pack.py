"""Lexical retrieval packing: each seed's window is filled by its unused BM25 neighbours.

Stage 1 tokenises every text where it lies and writes the ids (16 bits each, as the
vocabulary has fewer than 65,536) once. Stage 2 counts, over all documents, in how many
each vocabulary entry occurs: one row per entry whatever the corpus size. Stage 3 routes every
document to a shard of the index by its content. A tree of centroids (two levels of at most 32), fitted on
about `SAMPLE` documents that a hash picks, gives each document a leaf; inside a leaf, a MinHash
of its token 4-grams gives one of 64 cells. Leaves are numbered so that like ones are neighbours, and runs of
cells of about `shard_tokens` tokens are the shards; a cell of more is dealt to several shards by
a hash of the row, so that no group of copies, however large, makes a hot shard. Stage 4
packs each shard: its inverted index, weighted with corpus-wide statistics, returns the
seed's unused neighbours by falling BM25 score, and they fill the window in that order;
the one that doesn't fit is cut and its rest is the next seed. What doesn't
fill a shard's last window is split into sequences whose lengths are powers of two, so nothing is padded.

All terms count, whatever their document frequency, and a seed's neighbours are searched among all
unused documents of its shard: those that many documents hold have a weight for every document, the others
have postings. A corpus of at most `shard_tokens` tokens is one shard. Of a larger one, a neighbour in
another shard is out of reach: work grows in proportion to the input, and recall depends on how well
content tells shards apart (measured in the README).

Cases: a null or empty text is its closing id alone. Null doc_ids, repeated rows and
repeated ids are packed row by row. An empty table gives an empty result. Long
texts are cut at window borders, never shortened. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratapack.llm.common import drop_staged, rows_of, staged, table
from stratapack.llm.word_bpe import word_bpe
from stratapack.session import ship

WINDOW = 2048
END = 1
DEFAULT_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
SHARD_TOKENS, LEAST = 6_000_000, 64
#: Documents that the routing tree is fitted on, about; its columns, branches of a node, and cells of a leaf.
SAMPLE, COLUMNS, BRANCHES, CELLS = 8192, 2048, 32, 64
_PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def tokenised(docs: DataFrame, path: str = DEFAULT_VOCABULARY, slice_rows: int = 2048) -> DataFrame:
    """doc_id, ids (little-endian unsigned 16-bit, closed by id 1), row (the place of its first token, unique): one row per row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, row = word_bpe(path), TaskContext.get().partitionId() << 40
        for batch in batches:
            for k in range(0, batch.num_rows, slice_rows):
                part = batch.slice(k, slice_rows)
                ids, ends = known.encode(part.column(1), END)
                offsets = np.concatenate([[0], 2 * ends])
                held = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(ids, "<u2"))])
                places = row + offsets[:-1] // 2
                row += len(ids)
                yield pa.RecordBatch.from_arrays([part.column(0), held.cast(pa.binary()), pa.array(places, pa.int64())], ["doc_id", "ids", "row"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids binary, row long")


def _ids(cell: bytes) -> np.ndarray:
    return np.frombuffer(cell, "<u2")


def distinct(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, id, times) of the distinct ids of each document, in order; by one sort for all."""
    if not docs:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    sizes = [len(d) for d in docs]
    kind = np.uint32 if len(docs) <= 65536 else np.uint64
    key = np.repeat(np.arange(len(docs), dtype=kind), sizes) << kind(16) | np.concatenate(docs)
    key.sort()
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
    held = key[first]
    return (held >> kind(16)).astype(np.int64), (held & kind(65535)).astype(np.int64), np.diff(np.append(first, len(key)))


def token_df(tokens: DataFrame) -> np.ndarray:
    """In how many documents each id occurs: summed in the tasks, then by Spark; one number per vocabulary entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(65536, np.int64)
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                _, token, _ = distinct([_ids(x) for x in batch.column(0).slice(k, 512).to_pylist()])
                total += np.bincount(token, minlength=65536)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["token", "n"])

    counted = tokens.select("ids").mapInArrow(run, "token int, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(65536, np.int64)
    for token, n in counted:
        df[token] = n
    return df


def inverse_df(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.log1p((n_docs - df + 0.5) / (df + 0.5))


class Router:
    """A document's cell: a leaf of a tree of centroids, fitted on a sample, then a MinHash of its token 4-grams."""

    def __init__(self, df: np.ndarray, n_docs: int):
        self.idf = inverse_df(df, n_docs)
        worth = df * self.idf**2
        top = np.sort(np.argsort(-worth, kind="stable")[:COLUMNS])
        top = top[df[top] > 1]
        self.column = np.full(65536, -1)
        self.column[top] = np.arange(len(top))
        self.weight = self.idf[top].astype(np.float32)
        self.roots = np.zeros((1, len(top)), np.float32)
        self.leaves = [self.roots]

    def vectors(self, docs: list[np.ndarray]) -> np.ndarray:
        """One row of unit length for each document: damped counts times idf."""
        width = max(1, len(self.weight))
        at = self.column[np.concatenate(docs)] if docs else np.empty(0, np.int64)
        place = np.repeat(np.arange(len(docs)) * width, [len(d) for d in docs]) + at
        n = np.bincount(place[at >= 0], minlength=len(docs) * width)
        out = _DAMPED[np.minimum(n, len(_DAMPED) - 1)].reshape(len(docs), width)[:, : len(self.weight)] * self.weight
        norm = np.sqrt(np.einsum("ij,ij->i", out, out))
        out /= np.maximum(norm, 1e-9)[:, None]
        return out

    def fit(self, sample: np.ndarray) -> None:
        """sample: vectors."""
        if len(sample):
            self.roots = centroids(sample, min(BRANCHES, max(1, len(sample) // 8)))
            near = (sample @ self.roots.T).argmax(axis=1)
            self.leaves = [centroids(sample[near == k], min(BRANCHES, max(1, int((near == k).sum()) // 8))) for k in range(len(self.roots))]

    def cells(self, docs: list[np.ndarray]) -> np.ndarray:
        x = self.vectors(docs)
        root = (x @ self.roots.T).argmax(axis=1)
        leaf = np.zeros(len(docs), np.int64)
        for k in np.unique(root):
            mine = root == k
            leaf[mine] = (x[mine] @ self.leaves[k].T).argmax(axis=1)
        return (root * BRANCHES + leaf) * CELLS + sketches(docs) % CELLS


#: Damped counts; above the last, all count alike.
_DAMPED = np.log1p(np.arange(256)).astype(np.float32)


def sketches(docs: list[np.ndarray], width: int = 4) -> np.ndarray:
    """The smallest hash of each document's runs of `width` ids, mixed; 0 for shorter documents."""
    sizes = np.array([len(d) for d in docs], np.int64)
    x = np.concatenate([*docs, np.zeros(width, np.uint16)]).astype(np.uint32)
    h = np.zeros(len(x) - width, np.uint32)
    for k in range(width):
        h = (h ^ x[k : len(x) - width + k]) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
    ends = np.cumsum(sizes)
    for k in range(1, width):
        # Runs that would reach into the next document.
        h[np.maximum(ends - k, 0)[ends >= k]] = 0xFFFFFFFF
    out = np.zeros(len(docs), np.int64)
    long = np.flatnonzero(sizes >= width)
    if len(long):
        least = np.minimum.reduceat(h, (ends - sizes)[sizes > 0])
        mixed = (least.astype(np.uint64) * np.uint64(0x85EBCA6B) & np.uint64(0xFFFFFFFF)) >> np.uint64(11)
        out[sizes > 0] = mixed
        out[sizes < width] = 0
    return out


def centroids(rows: np.ndarray, count: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means; in an order in which each centroid follows the one that it is most like.

    It starts from rows that are each drawn with a weight by how unlike they are to those drawn before.
    """
    if not len(rows):
        return np.zeros((1, rows.shape[1]), np.float32)
    rng = np.random.default_rng(20240229)
    picked, near = [int(rng.integers(len(rows)))], np.full(len(rows), -1.0)
    for _ in range(count - 1):
        near = np.maximum(near, rows @ rows[picked[-1]])
        far = np.cumsum(np.maximum(1 - near, 0) ** 2)
        if far[-1] < 1e-6:
            break
        picked.append(int(np.searchsorted(far, rng.random() * far[-1])))
    centre = rows[picked].copy()
    for _ in range(rounds):
        near = (rows @ centre.T).argmax(axis=1)
        for k in range(len(centre)):
            own = rows[near == k].sum(axis=0)
            size = np.sqrt((own * own).sum())
            if size:
                centre[k] = own / size
    like, left, order = centre @ centre.T, set(range(1, len(centre))), [0]
    while left:
        order.append(max(left, key=lambda k: (like[order[-1], k], -k)))
        left.remove(order[-1])
    return centre[order]


class ShardIndex:
    """BM25 weights of some documents: terms in many of them as one array over all documents each, the others as postings."""

    #: A term in over 1 / DENSE of the documents has an array; at most WIDTH have, the most frequent.
    DENSE, WIDTH, BLOCK = 24, 2048, 32

    def __init__(self, docs: list[np.ndarray], df: np.ndarray, n_docs: int, mean_length: float, k1: float = 1.2, b: float = 0.75):
        doc, token, tf = distinct(docs)
        doc, token = doc.astype(np.int32), token.astype(np.int32)
        lengths = np.array([len(d) for d in docs])
        #: The distinct terms of each document.
        self.terms = np.split(token, np.searchsorted(doc, np.arange(1, len(docs))))
        weight = (inverse_df(df, n_docs)[token] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * lengths[doc] / mean_length))).astype(np.float32)
        held = np.bincount(token, minlength=65536)
        common = np.argsort(-held, kind="stable")[: self.WIDTH]
        common = common[held[common] > len(docs) / self.DENSE] if len(docs) > 64 else common[:0]
        self.column = np.full(65536, -1, np.int32)
        self.column[common] = np.arange(len(common), dtype=np.int32)
        at = self.column[token]
        #: The documents that are searched, and where each stands.
        self.docs = np.arange(len(docs))
        dense = np.zeros((len(common), len(docs)), np.float32)
        dense[at[at >= 0], doc[at >= 0]] = weight[at >= 0]
        self.dense = list(dense)
        #: Sums of BLOCK columns each: a query with most of them subtracts the others.
        self.sums = [dense[k : k + self.BLOCK].sum(axis=0) for k in range(0, len(dense), self.BLOCK)]
        order = np.flatnonzero(at < 0)
        order = order[np.argsort(token[order], kind="stable")]
        self._postings(doc[order], token[order], weight[order])

    def _postings(self, doc: np.ndarray, token: np.ndarray, weight: np.ndarray) -> None:
        self.doc, self.token, self.weight = doc, token, weight
        self.start = np.searchsorted(token, np.arange(65537))

    def keep(self, stay: np.ndarray) -> None:
        """Go on with the documents for which stay holds, by their place in docs."""
        place = np.cumsum(stay, dtype=np.int32) - 1
        self.docs, self.dense, self.sums = self.docs[stay], [column[stay] for column in self.dense], [column[stay] for column in self.sums]
        some = stay[self.doc]
        self._postings(place[self.doc[some]], self.token[some], self.weight[some])

    def scores(self, terms: np.ndarray, plain: bool = False) -> np.ndarray:
        """The score of each searched document for a query of distinct terms; plain: by additions only, so that 0 is 0."""
        out = np.zeros(len(self.docs), np.float32)
        at = self.column[terms]
        asked = np.zeros(len(self.sums) * self.BLOCK, bool)
        asked[at[at >= 0]] = True
        blocks = asked.reshape(-1, self.BLOCK)
        most = (blocks.sum(axis=1) > self.BLOCK // 2) & (not plain)
        for block in np.flatnonzero(most).tolist():
            np.add(out, self.sums[block], out)
        asked = (blocks != most[:, None]).reshape(-1)[: len(self.dense)]
        for column in np.flatnonzero(asked).tolist():
            if most[column // self.BLOCK]:
                np.subtract(out, self.dense[column], out)
            else:
                np.add(out, self.dense[column], out)
        rare = terms[at < 0]
        begin, end = self.start[rare], self.start[rare + 1]
        size = end - begin
        if size.any():
            place = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
            out += np.bincount(self.doc[place], self.weight[place], len(out))
        return out

    def neighbours(self, seed: int, unused: np.ndarray) -> Iterator[int]:
        """Unused documents that share a term with the seed, by falling score, then by place."""
        score, free = self.scores(self.terms[seed]), unused[self.docs] & (self.docs != seed)
        # Sums that were subtracted again leave traces of rounding; what is as small comes last, by additions only.
        small = free & (score < _TRACE)
        score[~free | small] = 0
        top = 16
        while len(score) > 4 * top:
            least = np.partition(score, -top)[-top]
            if least <= 0:
                break
            first = np.flatnonzero(score > least)
            yield from self.docs[first[np.lexsort((first, -score[first]))]].tolist()
            score[first] = 0
            # Equal scores at the border come by place, so they need no sort.
            for at in np.flatnonzero(score == least):
                score[at] = 0
                yield int(self.docs[at])
            top *= 8
        found = np.flatnonzero(score > 0)
        yield from self.docs[found[np.lexsort((found, -score[found]))]].tolist()
        if small.any():
            score = self.scores(self.terms[seed], plain=True)
            found = np.flatnonzero(small & (score > 0))
            yield from self.docs[found[np.lexsort((found, -score[found]))]].tolist()


#: Scores of this size may be what rounding left.
_TRACE = 1e-2


def pack_shard(docs: list[np.ndarray], index: ShardIndex, window: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces (doc, start, length, sequence, offset) of one shard."""
    unused = np.ones(len(docs), bool)
    pieces: list[tuple[int, int, int, int, int]] = []
    sequence, fill, following, left = 0, 0, 0, len(docs)
    rest: tuple[int, int] | None = None
    seed = -1

    def place(doc: int, start: int) -> bool:
        """Whether the window is full now."""
        nonlocal fill, rest, left
        left -= unused[doc]
        unused[doc] = False
        take = min(window - fill, len(docs[doc]) - start)
        pieces.append((doc, start, take, sequence, fill))
        fill += take
        rest = (doc, start + take) if start + take < len(docs[doc]) else None
        return fill == window

    while True:
        if rest:
            seed, full = rest[0], place(*rest)
        else:
            while following < len(docs) and not unused[following]:
                following += 1
            if following == len(docs):
                break
            seed = following
            full = place(seed, 0)
        if not full:
            # Used documents leave the index when they are a fifth of it.
            if len(index.docs) > max(64, 1.25 * left):
                index.keep(unused[index.docs])
            for doc in index.neighbours(seed, unused):
                if full := place(doc, 0):
                    break
        if full:
            sequence, fill = sequence + 1, 0
    if 0 < fill < window:
        last = [p for p in pieces if p[3] == sequence]
        pieces = pieces[: len(pieces) - len(last)] + _powers(last, fill, sequence)
    return pieces


def _powers(pieces: list[tuple[int, int, int, int, int]], fill: int, sequence: int) -> list[tuple[int, int, int, int, int]]:
    """The same tokens in sequences whose lengths are the powers of two of their number."""
    out, left, offset = [], [1 << k for k in range(fill.bit_length() - 1, -1, -1) if fill >> k & 1], 0
    for doc, start, length, _, _ in pieces:
        while length:
            take = min(length, left[0] - offset)
            out.append((doc, start, take, sequence, offset))
            start, length, offset = start + take, length - take, offset + take
            if offset == left[0]:
                left.pop(0)
                sequence, offset = sequence + 1, 0
    return out


def shards_of(cell: np.ndarray, tokens: np.ndarray, shard_tokens: int) -> tuple[np.ndarray, np.ndarray]:
    """For cells in order: the first shard of each and over how many it is dealt. A shard that is half full ends before a
    branch of the tree that would overfill it by a quarter."""
    first, parts = np.zeros(len(cell), np.int64), np.ones(len(cell), np.int64)
    branches = [(width, np.bincount(cell // width, tokens)) for width in (CELLS, CELLS * BRANCHES)] if len(cell) else []
    shard, filled, before = 0, 0, -1
    for k in np.argsort(cell).tolist():
        size, here = int(tokens[k]), int(cell[k])
        full = filled + size // 2 > shard_tokens
        for width, whole in branches:
            if before // width != here // width:
                full |= 2 * filled >= shard_tokens and filled + whole[here // width] > 1.25 * shard_tokens
        if filled and full:
            shard, filled = shard + 1, 0
        first[k], parts[k] = shard, max(1, size // shard_tokens)
        filled, before = filled + size, here
        if parts[k] > 1:
            shard, filled = shard + int(parts[k]), 0
    return first, parts


def _load() -> Column:
    """What a document counts in its shard: its tokens, but LEAST at least, so that a shard's documents are bounded too."""
    return F.greatest(F.floor(F.octet_length("ids") / 2), F.lit(LEAST)).cast("long")


def sharded(tokens: DataFrame, df: np.ndarray, n_docs: int, shard_tokens: int) -> DataFrame:
    """tokens with the column shard; tokens' own files are deleted."""
    spark = tokens.sparkSession
    router = Router(df, n_docs)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = router.vectors([_ids(x) for x in batch.column(1).to_pylist()]).astype(np.float16)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v.tobytes() for v in found], pa.binary())], ["row", "vector"])

    # About SAMPLE rows of COLUMNS half-precision numbers, whatever the corpus holds.
    picked = tokens.filter(F.pmod(F.xxhash64("row"), F.lit(n_docs)) < SAMPLE).select("row", "ids").mapInArrow(sample, "row long, vector binary").toArrow().sort_by("row")
    router.fit(np.stack([np.frombuffer(v, np.float16) for v in picked["vector"].to_pylist()]).astype(np.float32) if len(picked) else np.empty((0, len(router.weight)), np.float32))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(router.cells([_ids(x) for x in part["ids"].to_pylist()]), pa.int64())], [*part.schema.names, "cell"])

    routed = staged(tokens.mapInArrow(route, "doc_id long, ids binary, row long, cell long"), "pack-routed")
    drop_staged(tokens)
    # At most BRANCHES * BRANCHES * CELLS rows of three numbers.
    sizes = routed.groupBy("cell").agg(F.sum(_load()).alias("tokens")).toArrow()
    cell = sizes["cell"].to_numpy()
    first, parts = shards_of(cell, sizes["tokens"].to_numpy(), shard_tokens)
    places = spark.createDataFrame(pa.table({"cell": cell, "first": first, "parts": parts}))
    return routed.join(F.broadcast(places), "cell").select("doc_id", "ids", "row", (F.col("first") + F.pmod(F.xxhash64("row"), F.col("parts"))).alias("shard"))


def retrieval_pack(docs: DataFrame, window: int = WINDOW, shard_tokens: int = SHARD_TOKENS, path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """Pieces: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset."""
    ship(docs.sparkSession)
    tokens = staged(tokenised(docs, path), "pack-tokens")
    n_docs, n_tokens, load = tokens.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("ids")) / 2, F.lit(0)), F.coalesce(F.sum(_load()), F.lit(0))).first()
    df = token_df(tokens)
    mean_length = max(1.0, n_tokens / max(1, n_docs))
    dealt = sharded(tokens, df, n_docs, shard_tokens) if load > shard_tokens else tokens.withColumn("shard", F.lit(0).cast("long"))

    def pack(group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by("row")
        shard = group["shard"][0].as_py()
        doc_ids = group["doc_id"].combine_chunks()
        ids = [_ids(x) for x in group["ids"].to_pylist()]
        del group
        pieces = pack_shard(ids, ShardIndex(ids, df, n_docs, mean_length), window)
        doc, start, length, sequence, offset = (np.array(c, np.int64) for c in zip(*pieces, strict=True))
        return pa.Table.from_arrays(
            [
                doc_ids.take(pa.array(doc)), pa.array(start), pa.array(length),
                pa.array([ids[d][a : a + n].astype("<u4").tobytes() for d, a, n, _, _ in pieces], pa.binary()),
                pa.array(np.array([len(x) for x in ids], np.int64)[doc]), pa.array(sequence + (shard << 32)), pa.array(offset),
            ],
            ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
        )

    return dealt.groupBy("shard").applyInArrow(pack, _PIECES)


def op1_retrieval_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = retrieval_pack(table(spark, sf_dir, "documents"))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
