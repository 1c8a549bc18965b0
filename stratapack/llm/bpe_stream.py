"""BPE encoding and decoding as a bounded-lookahead streaming transducer.

Encoding. Text streams in pieces of any size. The pre-token pattern cuts it; a
match is taken once enough characters follow that no continuation can change it.
Inside a pre-token the next token is the longest one that starts there and may
stand after the token before it; if none may, the last token is taken back and
shortened. Two tokens may stand together when merging their bytes gives just
those two, which the merge ranks decide (`Merges.adjacent`), and a token list
is the BPE result exactly when all neighbours may stand together. How far right a
merge decision can depend on the text is bounded by the longest chain of ever
earlier merges that overlap to the right; `Merges.lookahead` computes that bound
from the merge list. In a long run, a token that ends this far before the end of
the read bytes is stable and leaves at once, so the state is one window of bytes,
one token and the memo of short pre-tokens (bounded, and only a cache).

Decoding. Token bytes stream through an incremental UTF-8 state machine that holds
at most three bytes; an invalid sequence gives U+FFFD for each maximal subpart.

Cases: null or empty text has no tokens and decodes to the empty text. Strings of
special tokens in the text become those tokens, as the library does. A null
doc_id stays null; repeated rows give repeated results; an empty table an empty
result. Only doc_id and text are read. Texts are never cut short.
"""

from __future__ import annotations

import codecs
import json
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratapack.llm.common import rows_of, table

#: Fixed value: the byte-level pre-token pattern, with white space as the Unicode property.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Classes of runs that can be longer than any window, in the pattern's order.
RUNS = (r" ?\p{L}+", r" ?\p{N}+", r" ?[^\p{White_Space}\p{L}\p{N}]+", r"\p{White_Space}+")

DEFAULT_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def printable_bytes() -> dict[str, int]:
    """The character that stands for each byte in vocabulary files: itself if printable, else the next from U+0100."""
    kept = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in kept]
    return {chr(b): b for b in kept} | {chr(256 + k): b for k, b in enumerate(rest)}


class Merges:
    """A merge list with what the transducer asks of it."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, of = spec["model"], printable_bytes()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes: dict[int, bytes] = {i: bytes(of[c] for c in s) for s, i in model["vocab"].items() if s not in self.special}
        self.id = {b: i for i, b in self.bytes.items()}
        self.bytes |= {i: s.encode() for s, i in self.special.items()}
        self.rank: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        vocab = model["vocab"]
        for k, m in enumerate(model["merges"]):
            left, right = m if isinstance(m, list) else m.split(" ")
            a, b, c = vocab[left], vocab[right], vocab[left + right]
            self.joined.setdefault((a, b), c)
            if c not in self.parts:
                self.parts[c], self.rank[c] = (a, b), k
        self.order = {p: self.rank[c] for p, c in self.joined.items()}
        #: The tokens' bytes as Latin-1 text in a trie; it tells how far a prefix of any token goes.
        self.size = {i: len(b) for i, b in self.bytes.items()}
        self.name = {b.decode("latin-1"): i for b, i in self.id.items()}
        self.trie = ahocorasick.Automaton()
        for n, i in self.name.items():
            self.trie.add_word(n, i)
        self.most = max(map(len, self.name))
        self.find = regex.compile(PATTERN).findall
        self.runs = [regex.compile(r) for r in RUNS]
        #: What goes on in a run, which has no space before it.
        self.going = [regex.compile(r.removeprefix(" ?")) for r in RUNS]
        self.marks = regex.compile("|".join(regex.escape(x) for x in self.special)) if self.special else None
        self._shorter: dict[int, int] = {}
        self._may: dict[int, bool] = {}
        self.lookahead = self._lookahead()

    def _lookahead(self) -> int:
        """Most bytes right of a merged pair that can decide whether it is merged.

        A merge (u, v) fails at its place only if an earlier merge takes the right
        spine's token x of v together with what follows, y. That merge may itself be
        prevented by a still earlier one, and so on: E(u, v) is the most over x and
        earlier (x, y) of |y| + E(x, y). Merges are visited by rank, so every E that
        is asked for is known.
        """
        best: dict[int, int] = {}
        most = 0
        for (a, b), _ in sorted(self.order.items(), key=lambda x: x[1]):
            far, x = 0, b
            while True:
                far = max(far, best.get(x, 0))
                if x not in self.parts:
                    break
                x = self.parts[x][1]
            reach = len(self.bytes[b]) + far
            best[a] = max(best.get(a, 0), reach)
            most = max(most, reach)
        return most

    def shorter(self, token: int) -> int:
        """The longest token that is a proper prefix of this one, or -1."""
        found = self._shorter.get(token)
        if found is None:
            b = self.bytes[token]
            found = next((i for n in range(len(b) - 1, 0, -1) if (i := self.id.get(b[:n])) is not None), -1)
            self._shorter[token] = found
        return found

    def adjacent(self, a: int, b: int) -> bool:
        """Whether merging the bytes of a and b gives (a, b): undo their merges, latest first, and look for an earlier merge over the border."""
        key = a << 32 | b
        may = self._may.get(key)
        if may is None:
            may = self._adjacent(a, b)
            if len(self._may) > 400_000:
                self._may.clear()
            self._may[key] = may
        return may

    def _adjacent(self, a: int, b: int) -> bool:
        rank, parts, order = self.rank, self.parts, self.order
        # The merge over the border would happen before the one that is undone last: at a tie of ranks the left one goes first.
        bound = (1 << 40, 0)
        while True:
            over = order.get((a, b))
            if over is not None and (over, 1) < bound:
                return False
            ra, rb = rank.get(a, -1), rank.get(b, -1)
            if ra < 0 and rb < 0:
                return True
            if ra >= 0 and (ra > rb):
                bound, a = (ra, 1), parts[a][1]
            else:
                bound, b = (rb, 2), parts[b][0]

    def tokens(self, data: bytes, before: int = -1) -> list[int]:
        """The tokens of data, which stands after the token `before` in the same pre-token."""
        text, size = data.decode("latin-1"), len(data)
        name, length, reach, most, adjacent = self.name.get, self.size, self.trie.longest_prefix, self.most, self.adjacent
        out: list[int] = []
        dead: set[int] = set()
        at, last, token = 0, before, -2
        while at < size:
            if token == -2:
                n = reach(text[at : at + most])
                while (token := name(text[at : at + n], -1)) < 0:
                    n -= 1
            while token >= 0:
                end = at + length[token]
                if end not in dead and (last < 0 or adjacent(last, token)):
                    break
                token = self.shorter(token)
            if token >= 0:
                out.append(token)
                at, last, token = end, token, -2
            elif out:
                dead.add(at)
                token = out.pop()
                at -= length[token]
                last = out[-1] if out else before
            else:
                raise ValueError("no tokens can follow here")
        return out


class _Memo(dict):
    """Pre-token -> tokens, filled by the transducer; cleared when full, so its size is bounded."""

    def __init__(self, merges: Merges, entries: int = 600_000, longest: int = 96):
        super().__init__()
        self.merges, self.entries, self.longest = merges, entries, longest

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(piece) > self.longest:
            run = Run(self.merges)
            return (*run.push(piece.encode("utf-8", "surrogatepass")), *run.finish())
        found = tuple(self.merges.tokens(piece.encode("utf-8", "surrogatepass")))
        if len(self) >= self.entries:
            self.clear()
        self[piece] = found
        return found


class Run:
    """One pre-token of any length: bytes in, stable tokens out."""

    def __init__(self, merges: Merges):
        self.merges, self.held, self.last = merges, b"", -1
        self.window = 4 * merges.lookahead + 1024

    def push(self, data: bytes) -> Iterator[int]:
        for k in range(0, len(data), self.window):
            self.held += data[k : k + self.window]
            if len(self.held) < 2 * self.merges.lookahead:
                continue
            stable, end = len(self.held) - self.merges.lookahead, 0
            for t in self.merges.tokens(self.held, self.last):
                n = len(self.merges.bytes[t])
                if end + n > stable:
                    break
                end += n
                self.last = t
                yield t
            self.held = self.held[end:]

    def finish(self) -> list[int]:
        out = self.merges.tokens(self.held, self.last)
        self.held, self.last = b"", -1
        return out


class Encoder:
    """Text pieces in, token ids out, as soon as they are stable."""

    #: Characters behind a match before it counts as final: contractions and special tokens fit in them.
    MARGIN = 16
    #: A pre-token longer than this streams through a Run.
    LONG = 4096

    def __init__(self, merges: Merges, memo: _Memo | None = None):
        self.merges = merges
        self.memo = _Memo(merges) if memo is None else memo
        self.margin = max([self.MARGIN, *(len(x) + 3 for x in merges.special)])
        self.held = ""
        self.run: tuple[Run, int] | None = None

    def feed(self, text: str) -> list[int]:
        """The tokens that became stable with this piece."""
        out: list[int] = []
        self.held += text
        while self.merges.marks and (m := self.merges.marks.search(self.held)):
            before, self.held = self.held[: m.start()], self.held[m.end() :]
            self._take(before, True, out)
            out.append(self.merges.special[m[0]])
        held, self.held = self.held, ""
        self._take(held, False, out)
        return out

    def finish(self) -> list[int]:
        out: list[int] = []
        held, self.held = self.held, ""
        self._take(held, True, out)
        return out

    def _take(self, text: str, ended: bool, out: list[int]) -> None:
        """Add the tokens of what is final in text; the rest is held. ended: nothing follows."""
        if self.run:
            text = self._continue(text, ended, out)
            if self.run:
                self.held = text
                return
        pieces = self.merges.find(text)
        if not ended:
            left = len(text)
            while pieces and left > len(text) - self.margin:
                left -= len(pieces.pop())
            rest = text[left:]
        out.extend(chain.from_iterable(map(self.memo.__getitem__, pieces)))
        if ended:
            return
        if len(rest) > self.LONG:
            self.run = next((Run(self.merges), k) for k, p in enumerate(self.merges.runs) if (m := p.match(rest)) and m.end() >= len(rest) - self.margin)
            rest = self._continue(rest, False, out)
        self.held = rest

    def _continue(self, text: str, ended: bool, out: list[int]) -> str:
        """Push what surely belongs to the open run; returns the rest."""
        run, kind = self.run
        m = (self.merges.runs if not run.held and run.last < 0 else self.merges.going)[kind].match(text)
        end = m.end() if m else 0
        if not ended and end > len(text) - self.margin:
            end = max(0, len(text) - self.margin)
            out.extend(run.push(text[:end].encode("utf-8", "surrogatepass")))
            return text[end:]
        if kind == 3 and end < len(text) and end:
            end -= 1  # the last white space before something else is not of this run
        out.extend(run.push(text[:end].encode("utf-8", "surrogatepass")))
        out.extend(run.finish())
        self.run = None
        return text[end:]


class Decoder:
    """Token ids in, text out: an incremental byte-to-text state machine of at most three held bytes."""

    def __init__(self, merges: Merges):
        self.bytes = merges.bytes
        self.machine = codecs.getincrementaldecoder("utf-8")(errors="replace")

    def feed(self, ids: Iterable[int]) -> str:
        return self.machine.decode(b"".join(map(self.bytes.__getitem__, ids)))

    def finish(self) -> str:
        return self.machine.decode(b"", True)


@lru_cache(maxsize=2)
def transducer(path: str) -> tuple[Merges, _Memo]:
    """Read once in each Python worker; workers are reused from task to task."""
    merges = Merges(path)
    return merges, _Memo(merges)


def encode(text: str, path: str = DEFAULT_VOCABULARY, piece: int = 1 << 16) -> array:
    """All ids of a text, fed in pieces of `piece` characters."""
    merges, memo = transducer(path)
    encoder, ids = Encoder(merges, memo), array("I")
    for k in range(0, len(text), piece):
        ids.extend(encoder.feed(text[k : k + piece]))
    ids.extend(encoder.finish())
    return ids


def decode(ids: array, path: str = DEFAULT_VOCABULARY, piece: int = 1 << 14) -> str:
    decoder = Decoder(transducer(path)[0])
    return "".join([*(decoder.feed(ids[k : k + piece]) for k in range(0, len(ids), piece)), decoder.finish()])


def bpe_round_trip(docs: DataFrame, path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit), decoded: one row per row of docs, in place, without a shuffle."""
    import sys

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary(), pa.string()), strict=True)], ["doc_id", "n_tokens", "ids", "decoded"])

        rows, size = [], 0
        for batch in batches:
            for doc_id, text in rows_of(batch):
                ids = encode(text or "", path)
                back = decode(ids, path)
                if sys.byteorder != "little":
                    ids.byteswap()
                rows.append((doc_id, len(ids), ids.tobytes(), back))
                size += 4 * len(ids) + len(back)
                if size > 4 << 20:
                    yield flush(rows)
                    rows, size = [], 0
        if rows:
            yield flush(rows)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded string")


def op9_bpe_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe_round_trip(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_tokens", F.lower(F.sha2("ids", 256)).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
