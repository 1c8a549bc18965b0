"""The columnar block (each field of the sequences in an array of its own) and its entropy-coded form."""

from __future__ import annotations

import numpy as np

from stratapack.functions import entropy
from stratapack.functions.lz import MIN_MATCH, BlockError, Search, copy_match, literals_of, lz4_assembled, lz4_copied, sequences

#: Fixed value of the format: extension values take 32 bits instead of 16.
WIDE = 1 << 31


def _pad4(n: int) -> int:
    return -(-n // 4) * 4


def field_offsets(count: int, extensions: int, wide: bool) -> tuple[int, int, int, int]:
    """Where tokens, offsets, extensions and literals begin."""
    tokens = 8
    offsets = tokens + _pad4(count)
    ext = offsets + _pad4(2 * count)
    return tokens, offsets, ext, ext + _pad4(extensions * (4 if wide else 2))


def _fields(found: list[tuple[int, int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """Tokens, offsets, extensions, and whether those are wide."""
    _, literal, match, offset = np.array(found, np.int64).T
    code = np.where(match > 0, match - MIN_MATCH, 0)
    both = np.stack([literal, code], axis=1)
    ext = both[both >= 15] - 15  # row by row: a sequence's literal before its match
    wide = bool(len(ext) and ext.max() > 0xFFFF)
    return (np.minimum(literal, 15) << 4 | np.minimum(code, 15)).astype(np.uint8), offset.astype("<u2"), ext.astype("<u4" if wide else "<u2"), wide


def glz_block(data: bytes, found: list[tuple[int, int, int, int]]) -> bytes:
    tokens, offsets, ext, wide = _fields(found)
    head = np.array([len(found) | (WIDE if wide else 0), len(ext)], "<u4").tobytes()
    fields = [tokens.tobytes(), offsets.tobytes(), ext.tobytes()]
    return head + b"".join(f + b"\0" * (-len(f) % 4) for f in fields) + literals_of(data, found)


def glz_size(found: list[tuple[int, int, int, int]]) -> int:
    """The block's size without making it."""
    _, _, ext, wide = _fields(found)
    return field_offsets(len(found), len(ext), wide)[3] + sum(n for _, n, _, _ in found)


def glze_size(data: bytes, found: list[tuple[int, int, int, int]]) -> int:
    """The entropy-coded block's size without making it."""
    tokens, offsets, ext, wide = _fields(found)
    pairs = offsets.view(np.uint8)
    streams = (tokens, pairs[0::2], pairs[1::2], np.frombuffer(literals_of(data, found), np.uint8))
    return 12 + _pad4(len(ext) * (4 if wide else 2)) + sum(map(entropy.stream_size, streams))


def glz_encode(data: bytes, search: Search = Search(), groups: int | None = None) -> bytes:
    return glz_block(data, sequences(data, search, groups))


def _header(block: bytes, size: int) -> tuple[int, int, bool]:
    if len(block) < 8:
        raise BlockError("Truncated")
    head, extensions = np.frombuffer(block[:8], "<u4").tolist()
    count = head & (WIDE - 1)
    if not 1 <= count <= size // MIN_MATCH + 1 or extensions > 2 * count:
        raise BlockError("BadSequence")
    return count, extensions, bool(head & WIDE)


def glz_decode(block: bytes, size: int) -> bytes:
    """Prefix sums say beforehand what every sequence reads and writes. If all checks hold, the same sequences as an LZ4
    block go through Arrow's decoder; if not, one by one to the first that fails."""
    count, extensions, wide = _header(block, size)
    tokens_at, offsets_at, ext_at, literals_at = field_offsets(count, extensions, wide)
    if literals_at <= len(block):
        token = np.frombuffer(block, np.uint8, count, tokens_at).astype(np.int64)
        both = np.stack([token >> 4, token & 15], axis=1)
        escaped = both == 15
        offset = np.frombuffer(block, "<u2", count, offsets_at).astype(np.int64)
        literals = np.frombuffer(block, np.uint8, offset=literals_at)
        if int(escaped.sum()) == extensions:
            both[escaped] += np.frombuffer(block, "<u4" if wide else "<u2", extensions, ext_at).astype(np.int64)
            literal, code = both.T
            match = code + MIN_MATCH
            match[-1] = 0
            before = np.cumsum(literal + match) - match
            ended = not (code[-1] or offset[-1]) and before[-1] == size and int(literal.sum()) == len(literals)
            if ended and (offset[:-1] > 0).all() and (offset[:-1] <= before[:-1]).all():
                return lz4_copied(lz4_assembled(literal, code, offset, literals), size)
    return glz_checked(block, size)


def glz_checked(block: bytes, size: int) -> bytes:
    """glz_decode, sequence by sequence."""
    count, extensions, wide = _header(block, size)
    tokens_at, offsets_at, ext_at, literals_at = field_offsets(count, extensions, wide)
    if literals_at > len(block):
        raise BlockError("Truncated")
    token = np.frombuffer(block, np.uint8, count, tokens_at).astype(np.int64)
    both = np.stack([token >> 4, token & 15], axis=1)
    escaped = both == 15
    if int(escaped.sum()) != extensions:
        raise BlockError("BadSequence")
    both[escaped] += np.frombuffer(block, "<u4" if wide else "<u2", extensions, ext_at).astype(np.int64)
    offset = np.frombuffer(block, "<u2", count, offsets_at).tolist()
    literals = block[literals_at:]
    out, read = bytearray(), 0
    for k, ((literal, code), back) in enumerate(zip(both.tolist(), offset, strict=True)):
        if literal > len(literals) - read:
            raise BlockError("Truncated")
        if literal > size - len(out):
            raise BlockError("OutputOverflow")
        out += literals[read : read + literal]
        read += literal
        if k == count - 1:
            if code or back:
                raise BlockError("BadSequence")
            break
        if not back:
            raise BlockError("ZeroOffset")
        if back > len(out):
            raise BlockError("OffsetBeforeStart")
        if code + MIN_MATCH > size - len(out):
            raise BlockError("OutputOverflow")
        copy_match(out, back, code + MIN_MATCH)
    if len(out) != size or read != len(literals):
        raise BlockError("SizeMismatch")
    return bytes(out)


def glze_from_glz(block: bytes) -> bytes:
    """Tokens, low and high offset bytes and literals as entropy-coded streams."""
    head, extensions = np.frombuffer(block[:8], "<u4").tolist()
    count = head & (WIDE - 1)
    tokens_at, offsets_at, ext_at, literals_at = field_offsets(count, extensions, bool(head & WIDE))
    offsets = block[offsets_at : offsets_at + 2 * count]
    literals = block[literals_at:]
    return b"".join(
        [
            np.array([head, extensions, len(literals)], "<u4").tobytes(),
            entropy.encode_stream(block[tokens_at : tokens_at + count]),
            entropy.encode_stream(offsets[0::2]),
            entropy.encode_stream(offsets[1::2]),
            block[ext_at:literals_at],
            entropy.encode_stream(literals),
        ]
    )


def glz_from_glze(block: bytes, size: int) -> bytes:
    if len(block) < 12:
        raise BlockError("Truncated")
    count, extensions, wide = _header(block, size)
    literal_count = int.from_bytes(block[8:12], "little")
    if literal_count > size:
        raise BlockError("BadSequence")
    tokens, at = entropy.decode_stream(block, 12, count)
    low, at = entropy.decode_stream(block, at, count)
    high, at = entropy.decode_stream(block, at, count)
    ext_size = _pad4(extensions * (4 if wide else 2))
    if at + ext_size > len(block):
        raise BlockError("Truncated")
    ext = block[at : at + ext_size]
    literals, at = entropy.decode_stream(block, at + ext_size, literal_count)
    if at != len(block):
        raise BlockError("SizeMismatch")
    offsets = np.empty(2 * count, np.uint8)
    offsets[0::2], offsets[1::2] = np.frombuffer(low, np.uint8), np.frombuffer(high, np.uint8)
    fields = [tokens, offsets.tobytes(), ext]
    return block[:8] + b"".join(f + b"\0" * (-len(f) % 4) for f in fields) + literals


def glze_encode(data: bytes, search: Search = Search(), groups: int | None = None) -> bytes:
    return glze_from_glz(glz_encode(data, search, groups))


def glze_decode(block: bytes, size: int) -> bytes:
    return glz_decode(glz_from_glze(block, size), size)
