"""LZ77 match finding and parsing of one chunk, and the LZ4 block.

A match may only start from positions of earlier blocks of `block` positions. So the
candidate of a position is an as-of look-up: the latest position with the same hash
before the position's block. One sort of (hash, position) and one binary search
answer it for all positions; longer chains are gathers of the same answer.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Fixed values of the block format.
MIN_MATCH, LAST_LITERALS, MATCH_MARGIN, MAX_OFFSET = 4, 5, 12, 65535
MULTIPLIER = 2654435761


class BlockError(ValueError):
    """A malformed block; status is one of Truncated, BadSequence, ZeroOffset, OffsetBeforeStart,
    OutputOverflow, SizeMismatch, BadMode, BadTable, LaneOverrun, ChecksumMismatch."""

    def __init__(self, status: str):
        super().__init__(status)
        self.status = status


@dataclass(frozen=True)
class Search:
    block: int = 128
    hash_log: int = 12
    probe: int = 16
    lazy: bool = True
    depth: int = 1


def for_level(level: int) -> Search:
    """Levels below 1 count as 1, above 3 as 3."""
    return Search(depth={1: 1, 2: 4, 3: 16}[min(3, max(1, level))])


def hash_words(words: np.ndarray, hash_log: int) -> np.ndarray:
    return (words * np.uint32(MULTIPLIER)) >> np.uint32(32 - hash_log)


def candidates(data: bytes, search: Search = Search()) -> tuple[np.ndarray, np.ndarray]:
    """(words, latest position of an earlier block with the same hash, or -1) of each position that a match may start from."""
    starts = len(data) - MATCH_MARGIN + 1
    if starts < 1:
        return np.empty(0, np.uint32), np.empty(0, np.int64)
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    words = b[:starts] | b[1 : starts + 1] << np.uint32(8) | b[2 : starts + 2] << np.uint32(16) | b[3 : starts + 3] << np.uint32(24)
    place = np.arange(starts, dtype=np.int64)
    bucket = hash_words(words, search.hash_log).astype(np.int64) << 32
    keys = np.sort(bucket | place)
    at = np.searchsorted(keys, bucket | place // search.block * search.block) - 1
    near = np.where(at >= 0, keys[np.maximum(at, 0)], -1)
    return words, np.where((near >= 0) & ((near ^ bucket) >> 32 == 0), near & 0xFFFFFFFF, -1)


def find_matches(data: bytes, search: Search = Search()) -> tuple[np.ndarray, np.ndarray]:
    """(length, offset) at each position; length 0 means none, and is at most search.probe."""
    n = len(data)
    length, offset = np.zeros(n, np.int32), np.zeros(n, np.int32)
    if n < MATCH_MARGIN:
        return length, offset
    raw = np.frombuffer(data, np.uint8)
    words, first = candidates(data, search)
    limit = n - LAST_LITERALS
    candidate = first.copy()
    alive = np.flatnonzero(candidate >= 0)
    for step in range(max(1, search.depth)):
        if step:
            # The next link of the chain; a candidate out of reach has ended it.
            candidate[alive] = first[candidate[alive]]
            alive = alive[candidate[alive] >= 0]
        alive = alive[alive - candidate[alive] <= MAX_OFFSET]
        p, c = alive, candidate[alive]
        same = words[p] == words[c]
        p, c = p[same], c[same]
        found, open_ = np.full(len(p), MIN_MATCH, np.int32), np.ones(len(p), bool)
        for k in range(MIN_MATCH, search.probe):
            q = np.minimum(p + k, n - 1)
            open_ &= (p + k < limit) & (raw[q] == raw[np.minimum(c + k, n - 1)])
            if not open_.any():
                break
            found += open_
        better = found > length[p]
        length[p[better]], offset[p[better]] = found[better], (p - c)[better]
    return length, offset


def _extend(data: bytes, end: int, offset: int, limit: int) -> int:
    """How far a match goes on from end: doubling slices, then the first byte that differs."""
    step = 32
    while end < limit:
        n = min(step, limit - end)
        a, b = data[end - offset : end - offset + n], data[end : end + n]
        if a != b:
            x = int.from_bytes(a, "little") ^ int.from_bytes(b, "little")
            return end + ((x & -x).bit_length() - 1) // 8
        end += n
        step *= 2
    return limit if end > limit else end


class _GroupOutputs:
    """Output ranges of the current group's matches; for dependency elimination."""

    def __init__(self, size: int):
        self.size, self.begins, self.ends, self.made = max(1, size), [], [], 0

    def room(self, source: int) -> int | None:
        """Bytes from source on that no match of the group has written; None: unbounded."""
        if self.made % self.size == 0:
            self.begins.clear()
            self.ends.clear()
        k = bisect_left(self.ends, source + 1)
        return None if k == len(self.ends) else max(0, self.begins[k] - source)

    def add(self, begin: int, end: int) -> None:
        self.begins.append(begin)
        self.ends.append(end)
        self.made += 1


def sequences(data: bytes, search: Search = Search(), groups: int | None = None) -> list[tuple[int, int, int, int]]:
    """(literal start, literal length, match length, offset) in order; the last has match length 0.

    Only sequences are visited one by one; the positions at which a match is taken are
    known beforehand, lazily deferred ones left out. groups: no match of so many
    consecutive sequences copies from another match's output among them.
    """
    n = len(data)
    length, offset = find_matches(data, search)
    take = length >= MIN_MATCH
    if search.lazy and n > MATCH_MARGIN:
        ends = n - MATCH_MARGIN
        take[:ends] &= length[1 : ends + 1] <= length[:ends]
    places = np.flatnonzero(take)
    at, lengths, offsets = places.tolist(), length[places].tolist(), offset[places].tolist()
    limit = n - LAST_LITERALS
    out: list[tuple[int, int, int, int]] = []
    anchor, k, group = 0, 0, _GroupOutputs(groups) if groups is not None else None
    while k < len(at):
        p, size, back = at[k], lengths[k], offsets[k]
        stop = limit
        if group:
            room = group.room(p - back)
            if room is not None and back > room:
                if room < MIN_MATCH:
                    k += 1
                    continue
                stop, size = min(stop, p + room), min(size, room)
        end = _extend(data, p + size, back, stop) if size >= search.probe else p + size
        if group:
            group.add(p, end)
        out.append((anchor, p - anchor, end - p, back))
        anchor = end
        k = bisect_left(at, end, k + 1)
    out.append((anchor, n - anchor, 0, 0))
    return out


def literals_of(data: bytes, found: list[tuple[int, int, int, int]]) -> bytes:
    return b"".join([data[a : a + n] for a, n, _, _ in found])


def lz4_assembled(literal: np.ndarray, code: np.ndarray, offset: np.ndarray, literals: np.ndarray) -> bytes:
    """The block of these sequences (code: match length less 4); the last has no match."""
    count = len(literal)
    more = lambda x: np.where(x >= 15, (x - 15) // 255 + 1, 0)
    lit_more, match_more = more(literal), more(code)
    match_more[-1] = 0
    tail = np.full(count, 2)
    tail[-1] = 0
    size = 1 + lit_more + literal + tail + match_more
    begin = np.cumsum(size) - size
    # Length bytes are 255 but for a run's last.
    out = np.full(int(size.sum()), 255, np.uint8)
    out[begin] = np.minimum(literal, 15) << 4 | np.minimum(code, 15)
    some = lit_more > 0
    out[(begin + lit_more)[some]] = (literal[some] - 15) % 255
    at = begin + 1 + lit_more
    out[np.repeat(at - (np.cumsum(literal) - literal), literal) + np.arange(len(literals))] = literals
    at = (at + literal)[:-1]
    out[at], out[at + 1] = offset[:-1] & 255, offset[:-1] >> 8
    some = match_more > 0
    out[(begin + size - 1)[some]] = (code[some] - 15) % 255
    return out.tobytes()


def lz4_block(data: bytes, found: list[tuple[int, int, int, int]]) -> bytes:
    _, literal, match, offset = np.array(found, np.int64).T
    return lz4_assembled(literal, np.maximum(match - MIN_MATCH, 0), offset, np.frombuffer(literals_of(data, found), np.uint8))


def lz4_size(found: list[tuple[int, int, int, int]]) -> int:
    """The block's size without making it."""
    extra = lambda x: 0 if x < 15 else (x - 15) // 255 + 1
    return sum(1 + extra(lit) + lit + ((2 + extra(m - MIN_MATCH)) if m else 0) for _, lit, m, _ in found)


def max_compressed_size(n: int) -> int:
    """No block of n bytes is longer."""
    return n + n // 255 + 16


def copy_match(out: bytearray, offset: int, length: int) -> None:
    """Append length bytes from offset back; a short offset repeats its pattern."""
    source = out[len(out) - offset : len(out) - offset + length]
    if offset < length:
        source = (bytes(source) * (length // offset + 1))[:length]
    out += source


def lz4_unblock(block: bytes, size: int) -> bytes:
    """Decode to exactly size bytes; the first failing check raises.

    Arrow's decoder copies the bytes. It doesn't say how many it made, and may let a zero offset
    pass, so the sequences' headers are walked beside it; what either refuses goes through all checks one by one.
    """
    return lz4_copied(block, size) if size and _length(block) == size else lz4_checked(block, size)


_RAW = pa.Codec("lz4_raw")


def lz4_copied(block: bytes, size: int) -> bytes:
    """A block of sequences that are known to make size bytes."""
    try:
        return _RAW.decompress(block, size, asbytes=True)
    except (pa.ArrowException, OSError):
        return lz4_checked(block, size)


def _length(block: bytes) -> int:
    """How many bytes the sequences make, or -1 if the block is cut or an offset is 0."""
    at, made, n = 0, 0, len(block)
    try:
        while True:
            token = block[at]
            at += 1
            literals = token >> 4
            if literals == 15:
                while block[at] == 255:
                    literals += 255
                    at += 1
                literals += block[at]
                at += 1
            at += literals
            made += literals
            if at >= n:
                return made if at == n else -1
            if not (block[at] or block[at + 1]):
                return -1
            at += 2
            match = token & 15
            if match == 15:
                while block[at] == 255:
                    match += 255
                    at += 1
                match += block[at]
                at += 1
            made += match + MIN_MATCH
    except IndexError:
        return -1


def lz4_checked(block: bytes, size: int) -> bytes:
    """lz4_unblock, sequence by sequence."""
    out, at, n = bytearray(), 0, len(block)

    def length(nibble: int) -> int:
        nonlocal at
        total = nibble
        while nibble == 15:
            if at >= n:
                raise BlockError("Truncated")
            b = block[at]
            at += 1
            total += b
            if b != 255:
                break
        return total

    while True:
        if at >= n:
            raise BlockError("Truncated")
        token = block[at]
        at += 1
        literals = length(token >> 4)
        if at + literals > n:
            raise BlockError("Truncated")
        if literals > size - len(out):
            raise BlockError("OutputOverflow")
        out += block[at : at + literals]
        at += literals
        if at == n:
            break
        if at + 2 > n:
            raise BlockError("Truncated")
        offset = block[at] | block[at + 1] << 8
        at += 2
        if not offset:
            raise BlockError("ZeroOffset")
        if offset > len(out):
            raise BlockError("OffsetBeforeStart")
        match = length(token & 15) + MIN_MATCH
        if match > size - len(out):
            raise BlockError("OutputOverflow")
        copy_match(out, offset, match)
    if len(out) != size:
        raise BlockError("SizeMismatch")
    return bytes(out)
