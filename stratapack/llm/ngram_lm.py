"""LM scoring with a sharded Elias-Fano n-gram trie.

Model: bigrams over words, every text closed by one end token that is also the first
context. p1(w) = (c(w) - D) / N by absolute discounting, the rest D*V/N for all
unknown words together; p(w|u) = (1 - l(u)) c(u,w)/c(u) + l(u) p1(w), where
l(u) = (n + k) / (n + c(u) + k) with n = c(u)^(ln V / ln N): the novelty that a
context of that count is expected to have by the corpus's own vocabulary growth. Both
levels sum to one. No count is cut off, and everything grows with the corpus.

Plan. 1. Texts become token blocks of bounded size where they lie: sorted 64-bit word
hashes, local ids, the training count of each word; written once. 2. The words
of all blocks are dealt by hash; a shard adds counts, numbers the words and answers
each block in the block's own order. 3. Each block meets its answers: base and
backed-off scores are summed for every document, and the block's distinct bigrams go to
shards by a hash of the pair, with their training counts and with the documents
that ask for them. A pair's hash spreads even the most frequent context over all shards.
4. A shard merges the training counts, builds its trie in mapped files (sorted contexts,
pointers, successors relative to their context, one-byte quantised log gains of the
smoothed over the backed-off probability) and answers every block's documents
with their sums. 5. A block's documents add up what the shards say. Every shuffle
carries packed arrays; nothing is collected but five totals. Beyond `fan` shards, a block doesn't address each shard:
it addresses about sqrt(shards) groups of shards, as many blocks' messages to one group are merged and dealt to its
shards, and the answers go back the same way. So B blocks and S shards exchange about 2 * B * sqrt(S) messages, not B * S.

Cases: null and empty texts consist of the end token. Null doc_ids count as held in
(crc32 of the empty text is 0). Repeated rows count as often as they occur. An empty
table gives an empty result, and with no training row every word is unknown (score =
base: p1 falls back to the same formula). Words are told apart by 64-bit hashes.
Only doc_id and text are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratapack.llm.common import fold, rows_of, shards_for, space_words, staged, table
from stratapack.llm.elias_fano import Mapped, Trie
from stratapack.session import ship

FOLDS, HELD = 5, 1
#: The end token's hash; words' hashes are never this value but by accident of 2^-64.
END_HASH = 0
UNKNOWN = np.uint32(0xFFFFFFFF)
#: Quantised values: steps of 1/STEPS in log10.
STEPS, LEAST = 25.0, -3.0
EASE = 5.0
_MESSAGE = "shard long, kind int, block long, blocks array<long>, sizes array<long>, keys binary, counts binary, ratios binary, times binary, docs binary"
_KINDS = [pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), *[pa.binary()] * 5]
_NAMES = [c.split()[0] for c in _MESSAGE.split(", ")]


def _pack(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).tobytes())


def _unpack(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def _planes(values: np.ndarray) -> bytes:
    """Sorted 64-bit numbers: differences, byte by byte, so that the high bytes pack to nothing."""
    steps = np.diff(values, prepend=values.dtype.type(0))
    return _pack(steps.astype("<u8").view(np.uint8).reshape(-1, 8).T)


def _unplanes(data: bytes) -> np.ndarray:
    flat = _unpack(data, "u1")
    return np.cumsum(np.ascontiguousarray(flat.reshape(8, -1).T).view("<u8").reshape(-1), dtype=np.uint64)


def token_blocks(docs: DataFrame, block_tokens: int = 2_000_000) -> DataFrame:
    """block, doc_ids, held, sizes, tokens (packed local ids), words (packed sorted hashes), counts (packed training counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        known: dict[bytes, int] = {}
        hashes, ids, held, sizes, tokens, total = [END_HASH], [], [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal made, known, hashes, ids, held, sizes, tokens, total
            words, place = np.unique(np.array(hashes, np.uint64), return_inverse=True)
            local = place[np.concatenate(tokens)].astype(np.uint32)
            trained = np.repeat(~np.array(held), sizes)
            counts = np.bincount(local[trained], minlength=len(words)).astype(np.uint32)
            row = [[part << 32 | made], [ids], [held], [sizes], [_pack(local)], [_planes(words)], [_pack(counts)], [len(words)]]
            made += 1
            known, hashes, ids, held, sizes, tokens, total = {}, [END_HASH], [], [], [], [], 0
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, kinds, strict=True)], ["block", "doc_ids", "held", "sizes", "tokens", "words", "counts", "n_words"])

        for batch in batches:
            for doc_id, text in rows_of(batch):
                words = space_words(text)
                for w in set(words).difference(known):
                    known[w] = len(hashes)
                    hashes.append(xxhash.xxh3_64_intdigest(w))
                tokens.append(np.array([*map(known.__getitem__, words), 0], np.uint32))
                ids.append(doc_id)
                held.append(fold(doc_id, FOLDS) == HELD)
                sizes.append(len(words) + 1)
                total += len(words) + 1
                if total >= block_tokens:
                    yield flush()
        if ids:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(run, "block long, doc_ids array<long>, held array<boolean>, sizes array<int>, tokens binary, words binary, counts binary, n_words long")


def word_answers(blocks: DataFrame, shards: int) -> DataFrame:
    """block, shard, ids, counts of each block's words of the shard, in order; block -1 has the shard's totals in n, v, n1, n2."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, words, counts in rows_of(batch):
                h, c = _unplanes(words), _unpack(counts, "<u4")
                # Shards are ranges of the hash, so that a block's words of a shard lie together.
                cuts = np.searchsorted(h, np.array([(k << 64) // shards for k in range(1, shards)], np.uint64))
                ends = [0, *cuts.tolist(), len(h)]
                spans = [(k, a, b) for k, (a, b) in enumerate(zip(ends, ends[1:], strict=False)) if b > a]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k for k, _, _ in spans], pa.int64()), pa.array([block] * len(spans), pa.int64()), pa.array([_planes(h[a:b]) for _, a, b in spans], pa.binary()), pa.array([_pack(c[a:b]) for _, a, b in spans], pa.binary())],
                    ["shard", "block", "words", "counts"],
                )

    def merge(group: pa.Table) -> pa.Table:
        shard = group["shard"][0].as_py()
        blocks_, sent = group["block"].to_pylist(), [_unplanes(x) for x in group["words"].to_pylist()]
        counts = np.concatenate([_unpack(x, "<u4") for x in group["counts"].to_pylist()])
        words, place = np.unique(np.concatenate(sent), return_inverse=True)
        total = np.bincount(place, counts, len(words)).astype(np.int64)
        ids = np.full(len(words), UNKNOWN, np.uint32)
        ids[total > 0] = np.arange((total > 0).sum(), dtype=np.uint32) * np.uint32(shards) + np.uint32(shard)
        ends = np.cumsum([0, *map(len, sent)])
        mine = [place[a:b] for a, b in zip(ends, ends[1:], strict=False)]
        out = {
            "block": [*blocks_, -1], "shard": [shard] * (len(mine) + 1),
            "ids": [*(_pack(ids[p]) for p in mine), None], "counts": [*(_pack(total[p].astype("<u8")) for p in mine), None],
            "n": [*[0] * len(mine), int(total.sum())], "v": [*[0] * len(mine), int((total > 0).sum())],
            "n1": [*[0] * len(mine), int((total == 1).sum())], "n2": [*[0] * len(mine), int((total == 2).sum())],
        }
        kinds = {"ids": pa.binary(), "counts": pa.binary()}
        return pa.table({k: pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()})

    dealt = blocks.select("block", "words", "counts").mapInArrow(deal, "shard long, block long, words binary, counts binary")
    return dealt.groupBy("shard").applyInArrow(merge, "block long, shard long, ids binary, counts binary, n long, v long, n1 long, n2 long")


class Totals:
    """What the whole training corpus adds up to, and the formulas on it."""

    def __init__(self, n: int, v: int, n1: int, n2: int, largest: int, word_shards: int):
        self.n, self.v = n, v
        self.discount = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        self.growth = math.log(max(v, 2)) / math.log(max(n, 3))
        #: Ids are below this: a word's place in its shard, times the shards, plus the shard. Places are below `largest`.
        self.ids = (largest + 1) * word_shards
        if self.ids >= 1 << 32:
            raise ValueError(f"{self.ids} word ids don't fit 32 bits, nor pairs of them 64")

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / (self.n + 0.5 * (self.v + 1)))

    def unigram(self, c: np.ndarray) -> np.ndarray:
        """log10 p1."""
        if not self.n:
            return self.base(c)
        return np.log10(np.where(c > 0, c - self.discount, self.discount * self.v) / self.n)

    def novelty(self, c: np.ndarray) -> np.ndarray:
        """l(u) of a context that occurs c times."""
        new = np.where(c > 0, np.maximum(c, 1.0) ** self.growth, 0.0)
        return (new + EASE) / (new + c + EASE)


def _pairs(context: np.ndarray, word: np.ndarray, size: int) -> np.ndarray:
    return context.astype(np.uint64) * np.uint64(size) + word.astype(np.uint64)


def _deal_pairs(keys: np.ndarray, shards: int) -> np.ndarray:
    x = keys * np.uint64(0x9E3779B97F4A7C15)
    return ((x >> np.uint64(33)) % np.uint64(shards)).astype(np.int64)


class Messages:
    """Rows of _MESSAGE in the making."""

    def __init__(self):
        self.rows: list[tuple] = []

    def pairs(self, at: np.ndarray, targets: int, block: int, blocks: list[int], sizes: list[int], keys, seen, ratio, times, begin, docs) -> None:
        """One message of kind 0 for each target that some pair goes to. Pair i is asked for by docs[begin[i] : begin[i] + times[i]]."""
        ranked = np.argsort(at, kind="stable")
        ends = np.searchsorted(at[ranked], np.arange(targets + 1))
        small = np.uint16 if sum(sizes) <= 65536 else np.uint32
        for k in range(targets):
            part = ranked[ends[k] : ends[k + 1]]
            if len(part):
                t = times[part]
                offset = np.repeat(begin[part] - np.concatenate([[0], np.cumsum(t)[:-1]]), t)
                asks = docs[offset + np.arange(t.sum())]
                self.rows.append((k, 0, block, blocks, sizes, _planes(keys[part]), _pack(seen[part].astype("<u4")), _pack(ratio[part]), _pack(t.astype("<u4")), _pack(asks.astype(small))))

    def sums(self, target: int, block: int, size: int, sums: bytes) -> None:
        """A message of kind 1."""
        self.rows.append((target, 1, block, [block], [size], sums, None, None, None, None))

    def table(self, first: int = 0) -> pa.Table:
        """The rows; targets count from `first`."""
        columns = list(zip(*self.rows, strict=True)) or [[]] * len(_NAMES)
        columns[0] = [first + k for k in columns[0]]
        return pa.table({n: pa.array(c, t) for n, c, t in zip(_NAMES, columns, _KINDS, strict=True)})


def block_messages(blocks: DataFrame, answers: DataFrame, totals: Totals, shards: int, width: int = 1) -> DataFrame:
    """Kind 0: a block's pairs of `width` shards. Kind 1: the sums of a block's documents, in keys as packed doubles."""
    targets = -(-shards // width)

    def meet(mine: pa.Table, said: pa.Table) -> pa.Table:
        said = said.sort_by("shard")
        row = mine.slice(0, 1).to_pylist()[0]
        word_id = np.concatenate([_unpack(x, "<u4") for x in said["ids"].to_pylist()])
        count = np.concatenate([_unpack(x, "<u8") for x in said["counts"].to_pylist()]).astype(float)
        tokens, sizes = _unpack(row["tokens"], "<u4"), np.array(row["sizes"], np.int64)
        held = np.array(row["held"], bool)
        end = 0  # the end token's hash is the least
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        before = np.concatenate([[end], tokens[:-1]])
        before[starts] = end
        doc = np.repeat(np.arange(len(sizes)), sizes)
        unigram, novelty, base = totals.unigram(count), totals.novelty(count), totals.base(count)
        n_docs = len(sizes)
        local = np.bincount(doc, unigram[tokens] + np.log10(novelty)[before], n_docs)
        sums = np.concatenate([np.bincount(doc, base[tokens], n_docs), np.bincount(doc, count[tokens] > 0, n_docs), local])
        # Only pairs of known words can have been seen.
        may = (count[tokens] > 0) & (count[before] > 0)
        doc, trained = doc[may], ~held[doc[may]]
        u, w = before[may], tokens[may]
        keys = _pairs(word_id[u], word_id[w], totals.ids)
        order = np.argsort(keys, kind="stable")
        keys, doc, trained, u, w = keys[order], doc[order], trained[order], u[order], w[order]
        first = np.flatnonzero(np.append(len(keys) > 0, keys[1:] != keys[:-1]))
        times = np.diff(np.append(first, len(keys)))
        seen = np.add.reduceat(trained, first).astype(np.int64) if len(first) else np.empty(0, np.int64)
        ratio = np.log10((1 - novelty[u[first]]) / (count[u[first]] * novelty[u[first]])) - unigram[w[first]]
        ratio = np.clip(np.round((ratio + 6) * 16), 0, 255).astype(np.uint8)
        out = Messages()
        out.pairs(_deal_pairs(keys[first], shards) // width, targets, row["block"], [row["block"]], [n_docs], keys[first], seen, ratio, times, first.astype(np.int64), doc)
        out.sums(row["block"] % targets, row["block"], n_docs, _pack(sums))
        return out.table()

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(meet, _MESSAGE)


def _asks(data: bytes, size: int) -> np.ndarray:
    return _unpack(data, "<u2" if size <= 65536 else "<u4")


def dealt_again(messages: DataFrame, shards: int, width: int, together: int) -> DataFrame:
    """Messages to groups of `width` shards, those of one group from about one in `together` of the blocks merged, to the shards themselves."""

    def merge(group: pa.Table) -> pa.Table:
        target = group["shard"][0].as_py()
        first, out = target * width, Messages()
        rows = sorted(group.drop_columns(["many"]).to_pylist(), key=lambda r: (r["kind"], r["block"]))
        asked = [r for r in rows if not r["kind"]]
        if asked:
            sizes = [r["sizes"][0] for r in asked]
            keys, seen, ratio = np.concatenate([_unplanes(r["keys"]) for r in asked]), np.concatenate([_unpack(r["counts"], "<u4") for r in asked]), np.concatenate([_unpack(r["ratios"], "u1") for r in asked])
            times = np.concatenate([_unpack(r["times"], "<u4") for r in asked]).astype(np.int64)
            docs = np.concatenate([_asks(r["docs"], n).astype(np.int64) + before for r, n, before in zip(asked, sizes, np.cumsum([0, *sizes]), strict=False)])
            order = np.argsort(keys, kind="stable")
            begin = np.cumsum(times) - times
            out.pairs(_deal_pairs(keys[order], shards) - first, min(width, shards - first), asked[0]["block"], [r["block"] for r in asked], sizes, keys[order], seen[order], ratio[order], times[order], begin[order], docs)
        for r in rows[len(asked) :]:
            out.sums(0, r["block"], r["sizes"][0], r["keys"])
        return out.table(first)

    return messages.withColumn("many", F.pmod(F.xxhash64("block"), F.lit(together))).groupBy("shard", "many").applyInArrow(merge, _MESSAGE)


def answered_again(gains: DataFrame, width: int) -> DataFrame:
    """Answers to merged messages: those of one group of shards are added up, then cut to blocks."""

    def cut(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: (r["kind"], r["shard"], r["block"]))
        out = [r for r in rows if r["kind"]]
        asked = [r for r in rows if not r["kind"]]
        if asked:
            blocks, sizes = asked[0]["blocks"], asked[0]["sizes"]
            total = np.zeros(sum(sizes))
            for r in asked:
                total[_unpack(r["docs"], "<u4")] += _unpack(r["sums"], "<f4")
            for block, size, end in zip(blocks, sizes, np.cumsum(sizes), strict=True):
                own = total[end - size : end]
                at = np.flatnonzero(own)
                out.append({"shard": 0, "block": block, "blocks": [block], "sizes": [size], "kind": 0, "docs": _pack(at.astype("<u4")), "sums": _pack(own[at].astype("<f4"))})
        return pa.Table.from_pylist(out, _GAIN_SCHEMA)

    # Messages that were merged have the same first block and group of shards.
    group = F.floor(F.col("shard") / width).alias("target")
    return gains.groupBy(group, "block").applyInArrow(lambda t: cut(t.select(_GAIN_SCHEMA.names)), _GAIN)


_GAIN = "shard long, block long, blocks array<long>, sizes array<long>, kind int, docs binary, sums binary"
_GAIN_SCHEMA = pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("blocks", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("kind", pa.int32()), ("docs", pa.binary()), ("sums", pa.binary())])


def shard_gains(messages: DataFrame, totals: Totals) -> DataFrame:
    """Each shard's trie, asked by every message: the sums of the message's documents."""

    def ask(group: pa.Table) -> pa.Table:
        shard = group["shard"][0].as_py()
        kinds, block, blocks, sizes = (group[c].to_pylist() for c in ("kind", "block", "blocks", "sizes"))
        asked = [i for i, k in enumerate(kinds) if k == 0]
        column = lambda c, i: group[c][i].as_py()
        out: list[tuple] = []

        keys, seen, ratios = [], [], []
        for i in asked:
            s = _unpack(column("counts", i), "<u4")
            use = s > 0
            keys.append(_unplanes(column("keys", i))[use])
            seen.append(s[use])
            ratios.append(_unpack(column("ratios", i), "u1")[use])
        size = np.uint64(totals.ids)
        with Mapped() as folder:
            if asked:
                pairs, first, place = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
                count = np.bincount(place, np.concatenate(seen), len(pairs))
                ratio = 10.0 ** (np.concatenate(ratios)[first].astype(float) / 16 - 6)
                gain = np.log10(1 + count * ratio)
                codes = np.clip(np.round(gain * STEPS), 0, 255).astype(np.uint8)
                trie = Trie(pairs // size, pairs % size, codes, totals.ids, folder)
                del keys, seen, ratios, pairs, place, count
            for i in asked:
                q = _unplanes(column("keys", i))
                found = trie.find(q // size, q % size)
                gain = np.zeros(len(q))
                gain[found >= 0] = trie.codes[found[found >= 0]] / STEPS
                n = sum(sizes[i])
                total = np.bincount(_asks(column("docs", i), n), np.repeat(gain, _unpack(column("times", i), "<u4")), n)
                at = np.flatnonzero(total)
                out.append((shard, block[i], blocks[i], sizes[i], 0, _pack(at.astype("<u4")), _pack(total[at].astype("<f4"))))
            if asked:
                del trie
        for i, k in enumerate(kinds):
            if k == 1:
                out.append((shard, block[i], blocks[i], sizes[i], 1, None, column("keys", i)))
        columns = list(zip(*out, strict=True))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, _GAIN_SCHEMA.types, strict=True)], schema=_GAIN_SCHEMA)

    return messages.groupBy("shard").applyInArrow(ask, _GAIN)


def lm_scores(docs: DataFrame, pair_tokens: int = 1_500_000, shard_words: int = 1_000_000, fan: int = 256, block_tokens: int = 2_000_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per row of docs."""
    ship(docs.sparkSession)
    blocks = staged(token_blocks(docs, block_tokens), "lm-blocks")
    n_blocks, n_words, n_tokens = blocks.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_words"), F.lit(0)), F.coalesce(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, b: a + b)), F.lit(0))).first()
    word_shards, pair_shards = shards_for(n_words, shard_words), shards_for(n_tokens, pair_tokens)
    answers = staged(word_answers(blocks, word_shards), "lm-words")
    sums = answers.filter("block = -1").agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "v", "n1", "n2")), F.coalesce(F.max("v"), F.lit(0))).first()
    totals = Totals(*sums, word_shards)
    groups = math.isqrt(pair_shards - 1) + 1 if pair_shards > fan else pair_shards
    width = -(-pair_shards // groups)
    messages = block_messages(blocks.select("block", "held", "sizes", "tokens"), answers.filter("block >= 0").select("block", "shard", "ids", "counts"), totals, pair_shards, width)
    if width > 1:
        messages = dealt_again(messages, pair_shards, width, -(-n_blocks // groups))
    gains = shard_gains(messages, totals)
    if width > 1:
        gains = answered_again(gains, width)

    def finish(mine: pa.Table, said: pa.Table) -> pa.Table:
        row = mine.slice(0, 1).to_pylist()[0]
        n = len(row["doc_ids"])
        score = np.zeros(n)
        said = said.to_pylist()
        for x in sorted(said, key=lambda x: (x["kind"], x["docs"] or b"", x["sums"])):
            if x["kind"]:
                base, known, local = _unpack(x["sums"], "<f8").reshape(3, n)
            else:
                score[_unpack(x["docs"], "<u4")] += _unpack(x["sums"], "<f4")
        return pa.table(
            {
                "doc_id": pa.array(row["doc_ids"], pa.int64()), "held_out": pa.array(row["held"], pa.bool_()), "n_tokens": pa.array(row["sizes"], pa.int64()),
                "n_known": pa.array(known.astype(np.int64)), "train_tokens": pa.array([totals.n] * n, pa.int64()), "base_score": pa.array(base), "score": pa.array(score + local),
            }
        )

    heads = blocks.select("block", "doc_ids", "held", "sizes")
    return heads.groupBy("block").cogroup(gains.groupBy("block")).applyInArrow(
        finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )


def op3_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))
