"""Word-level BPE of many texts at once, in arrays.

The vocabulary drops white space, and no rule of it looks across; so a batch's distinct
chunks between white space are encoded once each. A chunk of visible characters below
U+0250 without apostrophe or "<" is in normal form already, lower-cases letter by letter and
is cut where letters, single digits and other characters meet: those chunks go through the
merges together, all words at once, each round merging every word's pair of least rank
(pairs of a word that overlap: from the left). As a merge's product occurs only in later
merges, this is the order in which the library merges. All other chunks go through the
library's tokenizer, which is the vocabulary's own.
"""

from __future__ import annotations

import json
import os
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from stratapack.llm.bpe_stream import printable_bytes

#: Characters from here on go through the library.
LIMIT = 0x250
_NEVER = np.int32(0x7FFFFFFF)


class PairTable:
    """Pair of ids -> (rank, merged id), by two hash tables in which every pair has one place (cuckoo hashing)."""

    BITS = 18
    MULTIPLIERS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))

    def __init__(self, pairs: np.ndarray, merged: np.ndarray):
        """pairs: left << 16 | right, in order of rank."""
        assert len(pairs) < 1 << (self.BITS - 1)
        pairs = pairs.astype(np.uint64)
        places = [self._place(pairs, k).tolist() for k in range(2)]
        held: tuple[dict[int, int], dict[int, int]] = ({}, {})
        for rank in range(len(pairs)):
            which, item = 0, rank
            for _ in range(500):
                at = places[which][item]
                item, held[which][at] = held[which].get(at, -1), item
                if item < 0:
                    break
                which = 1 - which
            assert item < 0
        self.keys = np.full((2, 1 << self.BITS), 0xFFFFFFFF, np.uint32)
        self.ranks = np.full((2, 1 << self.BITS), _NEVER, np.int32)
        self.merged = merged.astype(np.uint16)
        for k in range(2):
            at, rank = np.array(list(held[k]), np.int64), np.array(list(held[k].values()), np.int64)
            self.keys[k, at], self.ranks[k, at] = pairs[rank], rank

    def _place(self, keys: np.ndarray, k: int) -> np.ndarray:
        return (keys * self.MULTIPLIERS[k]) >> np.uint64(64 - self.BITS)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.uint32) << np.uint32(16) | right
        wide = keys.astype(np.uint64)
        out = None
        for k in range(2):
            at = self._place(wide, k).astype(np.int64)
            found = np.where(self.keys[k].take(at) == keys, self.ranks[k].take(at), _NEVER)
            out = found if out is None else np.minimum(out, found)
        return out


class WordBpe:
    #: Distinct chunks that are remembered.
    KNOWN = 400_000

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        assert self.tokenizer.get_vocab_size() <= 65536
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocabulary, end = model["vocab"], model["end_of_word_suffix"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        pairs = np.array([vocabulary[a] << 16 | vocabulary[b] for a, b in merges], np.uint64)
        self.pairs = PairTable(pairs, np.array([vocabulary[a + b] for a, b in merges]))
        shown = {b: c for c, b in printable_bytes().items()}
        self.inner = np.array([vocabulary[shown[b]] for b in range(256)], np.uint16)
        self.last = np.array([vocabulary[shown[b] + end] for b in range(256)], np.uint16)
        lower = [chr(c).lower() for c in range(LIMIT)]
        kind = [{"L": 0, "N": 1}.get(unicodedata.category(chr(c))[0], 2) for c in range(LIMIT)]
        #: Of each character: what it becomes, and whether it is a letter (0), a digit (1) or else (2).
        self.lower = np.array([ord(x) if len(x) == 1 else 0 for x in lower], np.uint16)
        self.kind = np.array(kind, np.uint8)
        simple = [len(x) == 1 and ord(x) < LIMIT and (0x20 < c < 0x7F or c > 0xA0) and chr(c) not in "<'" for c, x in enumerate(lower)]
        self.simple = np.append(np.array(simple), False)
        self.known, self.ids, self.size = pa.array([], pa.string()), np.empty(0, np.uint16), np.empty(0, np.int64)

    def chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks in a row, and how many each has."""
        n = len(chunks)
        offsets = np.frombuffer(chunks.buffers()[1], np.int32 if chunks.type == pa.string() else np.int64)[chunks.offset : chunks.offset + n + 1].astype(np.int64)
        data = np.frombuffer(chunks.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if n else np.empty(0, np.uint8)
        offsets = offsets - offsets[0] if n else np.zeros(1, np.int64)
        # Code points; those of more than two bytes count as LIMIT.
        lead = (data & 0xC0) != 0x80
        at = np.flatnonzero(lead)
        code = data[at].astype(np.uint16)
        two = (code >= 0xC0) & (code < 0xCA)
        code[two] = (code[two] & 0x1F) << 6 | (data[at[two] + 1] & 0x3F)
        code[~two & (code >= 0xC0) | (code >= LIMIT)] = LIMIT
        ends = np.concatenate([[0], np.cumsum(lead)])[offsets]
        owner = np.repeat(np.arange(n), np.diff(ends))
        odd = np.zeros(n, bool)
        odd[owner[~self.simple[code]]] = True
        plain = ~odd[owner]
        code, owner = code[plain], owner[plain]
        ids, of = self._merged(code, owner)
        size = np.bincount(of, minlength=n)
        if odd.any():
            rare = np.flatnonzero(odd)
            found = [e.ids for e in self.tokenizer.encode_batch(chunks.take(pa.array(rare)).to_pylist(), add_special_tokens=False)]
            size[rare] = [len(x) for x in found]
            more = np.array([i for x in found for i in x], np.uint16)
            both = np.concatenate([of, np.repeat(rare, size[rare])])
            ids = np.concatenate([ids, more])[np.argsort(both, kind="stable")]
        return ids, size

    def _merged(self, code: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of plain characters, and whose they are."""
        if not len(code):
            return np.empty(0, np.uint16), np.empty(0, np.int64)
        kind = self.kind[code]
        begins = np.append(True, (owner[1:] != owner[:-1]) | (kind[1:] != kind[:-1]) | (kind[1:] == 1))
        low = self.lower[code]
        wide = low >= 0x80
        place = np.cumsum(1 + wide) - 1  # of each character's last byte
        raw = np.empty(place[-1] + 1, np.uint8)
        raw[place] = np.where(wide, 0x80 | (low & 0x3F), low)
        raw[place[wide] - 1] = 0xC0 | (low[wide] >> 6)
        start = np.zeros(len(raw), bool)
        start[(place - wide)[begins]] = True
        tail = np.append(start[1:], True)
        symbol = np.where(tail, self.last[raw], self.inner[raw])
        of = np.repeat(owner, 1 + wide)
        # What may still be merged: symbols, their places in the whole, the words' starts, and the rank of each symbol with its right neighbour.
        out, whole = symbol.copy(), np.ones(len(symbol), bool)
        live, at = symbol.copy(), np.arange(len(symbol), dtype=np.int64 if len(symbol) >> 31 else np.int32)
        rank, inner = np.full(len(live), _NEVER, np.int32), np.flatnonzero(~tail)
        rank[inner] = self.pairs.rank(live[inner], live[inner + 1])
        while len(live):
            first = np.flatnonzero(start)
            least = np.minimum.reduceat(rank, first)
            sizes = np.diff(np.append(first, len(live)))
            done = np.repeat(least == _NEVER, sizes)
            out[at[done]] = live[done]
            merge = (rank == np.repeat(least, sizes)) & ~done
            # In a run of neighbouring places, every second one would overlap.
            for k in (np.flatnonzero(merge[1:] & merge[:-1]) + 1).tolist():
                if merge[k - 1]:
                    merge[k] = False
            hit = np.flatnonzero(merge)
            live[hit] = self.pairs.merged[rank[hit]]
            whole[at[hit + 1]] = False
            stay = ~done
            stay[hit + 1] = False
            place = np.cumsum(stay) - 1
            changed = np.concatenate([place[hit], place[hit[~start[hit]]] - 1])
            live, at, start, rank = live[stay], at[stay], start[stay], rank[stay]
            # Merged symbols, and what stands before them in the word, have new right neighbours, or none.
            rank[changed] = _NEVER
            changed = changed[np.append(~start[1:], False)[changed]]
            rank[changed] = self.pairs.rank(live[changed], live[changed + 1])
        return out[whole], of[whole]

    def _distinct(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, begin, size): where each chunk's run of ids lies. The first KNOWN chunks that came are remembered."""
        at = pc.index_in(chunks, value_set=self.known)
        missing = pc.is_null(at)
        new = chunks.filter(missing)
        ids, size = self.chunks(new)
        place = at.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        fresh = missing.to_numpy(zero_copy_only=False)
        place[fresh] = len(self.known) + np.arange(len(new))
        ids, size = np.concatenate([self.ids, ids]), np.concatenate([self.size, size])
        begin = np.cumsum(size) - size
        if len(self.known) + len(new) <= self.KNOWN:
            self.known, self.ids, self.size = pa.concat_arrays([self.known, new]), ids, size
        return ids, begin[place], size[place]

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, each text closed by `end`, and where each text's end. Null texts are empty."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.string()), ""))
        offsets = split.offsets.to_numpy()
        coded = split.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        ids, begin, size = self._distinct(coded.dictionary)
        # The closing id is one more chunk.
        ids, begin, size = np.append(ids, np.uint16(end)), np.append(begin, len(ids)), np.append(size, 1)
        cuts = offsets[1:].astype(np.int64) - offsets[0]
        at = np.insert(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), cuts, len(size) - 1)
        sizes = size[at]
        ends = np.cumsum(sizes)[cuts + np.arange(len(cuts))] if len(cuts) else np.empty(0, np.int64)
        return gathered(ids, begin[at], sizes), ends


def gathered(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs values[start : start + size], one after another."""
    some = size > 0
    start, size = start[some], size[some]
    if not len(size):
        return values[:0]
    step = np.ones(int(size.sum()), np.int64)
    step[0] = start[0]
    step[(np.cumsum(size) - size)[1:]] = start[1:] - (start[:-1] + size[:-1] - 1)
    return values[np.cumsum(step)]


@lru_cache(maxsize=1)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)
