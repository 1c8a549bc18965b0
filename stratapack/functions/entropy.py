"""Order-0 streams of byte symbols: raw, one repeated symbol, or length-limited Huffman in lanes."""

from __future__ import annotations

import heapq

import numpy as np

from stratapack.functions.lz import BlockError

#: Fixed values of the format.
MAX_LEN, MAX_LANES, LANE_SYMBOLS = 11, 32, 512
RAW, RLE, HUFFMAN = 0, 1, 2


def lanes(n: int) -> int:
    return min(MAX_LANES, max(1, -(-n // LANE_SYMBOLS)))


def lane_range(n: int, count: int, k: int) -> tuple[int, int]:
    return k * n // count, (k + 1) * n // count


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Lengths of 256 symbols (0: unused) for at least two used ones.

    Depths come from a heap keyed by (weight, leaf before node, age); overlong ones are folded
    back, and the lengths are handed out, longest first, to the symbols by (count, symbol).
    """
    used = sorted((int(c), s) for s, c in enumerate(counts) if c)
    heap = [(c, 0, k, k) for k, (c, _) in enumerate(used)]
    parent: dict[int, int] = {}
    for node in range(len(used), 2 * len(used) - 1):
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        parent[a[3]] = parent[b[3]] = node
        heapq.heappush(heap, (a[0] + b[0], 1, node, node))
    depth = {2 * len(used) - 2: 0}
    for node in range(2 * len(used) - 3, -1, -1):
        depth[node] = depth[parent[node]] + 1
    at = np.bincount([depth[k] for k in range(len(used))], minlength=MAX_LEN + 3).tolist()
    for deep in range(len(at) - 1, MAX_LEN, -1):
        while at[deep]:
            above = max(j for j in range(deep - 1) if at[j])
            at[deep] -= 2
            at[deep - 1] += 1
            at[above] -= 1
            at[above + 1] += 2
    out, order = np.zeros(256, np.uint8), iter(used)
    for size in range(MAX_LEN, 0, -1):
        for _ in range(at[size]):
            out[next(order)[1]] = size
    return out


def codes(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes (by length, then symbol), bit-reversed for writing the lowest bit first."""
    out, code, before = np.zeros(256, np.uint16), 0, 0
    for s in sorted(np.flatnonzero(lengths), key=lambda s: (lengths[s], s)):
        size = int(lengths[s])
        code <<= size - before
        out[s] = int(format(code, f"0{size}b")[::-1], 2)
        code, before = code + 1, size
    return out


def kraft(lengths: np.ndarray) -> int:
    used = lengths[lengths > 0].astype(int)
    return int((1 << np.maximum(0, MAX_LEN - used)).sum())


def _word(v: int) -> bytes:
    return int(v).to_bytes(4, "little")


def _pad(data: bytes) -> bytes:
    return data + b"\0" * (-len(data) % 4)


def encode_stream(symbols: bytes) -> bytes:
    raw = np.frombuffer(symbols, np.uint8)
    n = len(raw)
    counts = np.bincount(raw, minlength=256)
    used = int((counts > 0).sum())
    if used == 1:
        return _word(RLE | int(raw[0]) << 8)
    plain = _word(RAW) + _pad(symbols)
    if used < 2:
        return plain
    length = code_lengths(counts)
    code, each = codes(length).astype(np.uint32), length[raw].astype(np.int64)
    count = lanes(n)
    sizes, body = [], []
    for k in range(count):
        a, b = lane_range(n, count, k)
        width = each[a:b]
        begin = np.cumsum(width) - width
        total = int(width.sum())
        inside = np.arange(total) - np.repeat(begin, width)
        bits = (np.repeat(code[raw[a:b]], width) >> inside.astype(np.uint32)) & 1
        packed = _pad(np.packbits(bits.astype(np.uint8), bitorder="little").tobytes())
        sizes.append(len(packed) // 4)
        body.append(packed)
    table = (length[0::2] | length[1::2] << 4).astype(np.uint8).tobytes()
    out = _word(HUFFMAN) + table + _pad(np.array(sizes, "<u2").tobytes()) + b"".join(body)
    return out if len(out) < len(plain) else plain


def stream_size(raw: np.ndarray) -> int:
    """The size of encode_stream's result without making it."""
    n = len(raw)
    counts = np.bincount(raw, minlength=256)
    used = int((counts > 0).sum())
    if used == 1:
        return 4
    plain = 4 + n + -n % 4
    if used < 2:
        return plain
    count = lanes(n)
    bits = np.concatenate([[0], np.cumsum(code_lengths(counts).astype(np.int64)[raw])])
    ends = np.array([lane_range(n, count, k) for k in range(count)])
    words = -(-(bits[ends[:, 1]] - bits[ends[:, 0]]) // 32)
    return min(plain, 132 + 2 * count + -(2 * count) % 4 + 4 * int(words.sum()))


def decode_stream(data: bytes, at: int, n: int) -> tuple[bytes, int]:
    """n symbols from data[at:] and the place behind them."""

    def need(a: int, b: int) -> bytes:
        if b > len(data):
            raise BlockError("Truncated")
        return data[a:b]

    head = int.from_bytes(need(at, at + 4), "little")
    mode, rest = head & 255, head >> 8
    if mode == RLE and rest < 256:
        return bytes([rest]) * n, at + 4
    if mode not in (RAW, HUFFMAN) or rest:
        raise BlockError("BadMode")
    if mode == RAW:
        need(at + 4, at + 4 + n + -n % 4)
        return data[at + 4 : at + 4 + n], at + 4 + n + -n % 4
    table = np.frombuffer(need(at + 4, at + 132), np.uint8)
    length = np.empty(256, np.uint8)
    length[0::2], length[1::2] = table & 15, table >> 4
    if length.max() > MAX_LEN or kraft(length) != 1 << MAX_LEN:
        raise BlockError("BadTable")
    count = lanes(n)
    sizes = np.frombuffer(need(at + 132, at + 132 + 2 * count), "<u2").astype(np.int64)
    begin = at + 132 + 2 * count + -(2 * count) % 4
    end = begin + 4 * int(sizes.sum())
    need(begin, end)
    symbol, width = np.zeros(1 << MAX_LEN, np.uint8), np.zeros(1 << MAX_LEN, np.int64)
    code = codes(length)
    for s in np.flatnonzero(length):
        symbol[int(code[s]) :: 1 << int(length[s])] = s
        width[int(code[s]) :: 1 << int(length[s])] = length[s]
    symbols, widths = symbol.tolist(), width.tolist()
    out, at = bytearray(), begin
    for k, words in enumerate(sizes.tolist()):
        # A lane is one integer; what lies behind its last word reads as zero.
        bits, used = int.from_bytes(data[at : at + 4 * words], "little"), 0
        a, b = lane_range(n, count, k)
        for _ in range(b - a):
            index = bits & 2047
            out.append(symbols[index])
            step = widths[index]
            bits >>= step
            used += step
        if used > 32 * words:
            raise BlockError("LaneOverrun")
        at += 4 * words
    return bytes(out), end
