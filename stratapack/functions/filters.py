"""Reversible numeric filters of one chunk, vectorised over its elements.

With w bytes an element, m = len // w elements are transformed; the bytes behind them never
change. Arithmetic is modulo 2^(8w), which NumPy's unsigned types do by themselves.
"""

from __future__ import annotations

import numpy as np

#: Fixed values of the format: filter names by id, and the widths allowed.
KINDS = ("none", "shuffle", "delta", "delta-shuffle", "delta-zigzag-shuffle", "delta-bitshuffle")
WIDTHS = (1, 2, 4, 8)

#: Fixed values of the format: candidates in tie-break order for level 1 and below, and above it.
FAST_CANDIDATES = ("none", "shuffle-4", "delta-4", "delta-shuffle-4", "delta-zigzag-shuffle-2", "delta-bitshuffle-8")
FULL_CANDIDATES = (
    "none",
    "shuffle-2",
    "shuffle-4",
    "shuffle-8",
    "delta-2",
    "delta-4",
    "delta-8",
    "delta-shuffle-2",
    "delta-shuffle-4",
    "delta-shuffle-8",
    "delta-zigzag-shuffle-2",
    "delta-bitshuffle-4",
    "delta-bitshuffle-8",
)


def candidates(level: int) -> tuple[str, ...]:
    return FAST_CANDIDATES if level <= 1 else FULL_CANDIDATES


def sample_len(chunk_size: int) -> int:
    """How much of a chunk decides its filter: an eighth, at least 4 KiB."""
    return max(chunk_size // 8, 4096)


def parse(name: str) -> tuple[int, int]:
    """'delta-shuffle-4' -> (3, 4); 'none' -> (0, 0)."""
    kind, _, width = (name, "", "0") if name == "none" else name.rpartition("-")
    if kind not in KINDS or (int(width) not in WIDTHS) != (kind == "none"):
        raise ValueError(f"unknown filter {name!r}")
    return KINDS.index(kind), int(width)


def name_of(kind: int, width: int) -> str:
    """The other way; raises on an unknown id or a width that doesn't go with it."""
    if not 0 <= kind < len(KINDS):
        raise ValueError(f"unknown filter id {kind}")
    if (kind == 0) != (width == 0) or (kind and width not in WIDTHS):
        raise ValueError(f"invalid filter width {width} for filter id {kind}")
    return KINDS[kind] + (f"-{width}" if kind else "")


def zigzag(delta: np.ndarray) -> np.ndarray:
    """0, -1, 1, -2, ... (two's complement in unsigned words) -> 0, 1, 2, 3, ..."""
    bits = 8 * delta.dtype.itemsize
    signed = delta.view(delta.dtype.str.replace("u", "i"))
    return ((signed << 1) ^ (signed >> (bits - 1))).view(delta.dtype)


def unzigzag(z: np.ndarray) -> np.ndarray:
    one = z.dtype.type(1)
    return (z >> one) ^ (z.dtype.type(0) - (z & one))


def _planes_out(delta: np.ndarray, width: int) -> np.ndarray:
    whole = len(delta) // 32 * 32
    bits = np.unpackbits(delta[:whole].view(np.uint8).reshape(whole, width), axis=1, bitorder="little")
    planes = np.packbits(bits.T, axis=1, bitorder="little")
    return np.concatenate([planes.reshape(-1), delta[whole:].view(np.uint8)])


def _planes_in(data: np.ndarray, count: int, width: int) -> np.ndarray:
    whole = count // 32 * 32
    planes = np.unpackbits(data[: whole * width].reshape(8 * width, whole // 8), axis=1, bitorder="little") if whole else np.empty((8 * width, 0), np.uint8)
    body = np.packbits(planes.T, axis=1, bitorder="little").reshape(-1) if whole else np.empty(0, np.uint8)
    return np.concatenate([body, data[whole * width : count * width]])


def forward(data: bytes, name: str) -> bytes:
    kind, width = parse(name)
    if not kind:
        return data
    raw = np.frombuffer(data, np.uint8)
    count = len(raw) // width
    body, tail = raw[: count * width], raw[count * width :]
    if kind >= 2:
        elements = body.view(f"<u{width}")
        delta = elements.copy()
        delta[1:] -= elements[:-1]
        if kind == 5:
            return _planes_out(delta, width).tobytes() + tail.tobytes()
        body = (zigzag(delta) if kind == 4 else delta).view(np.uint8)
    if kind != 2:
        body = body.reshape(count, width).T
    return np.ascontiguousarray(body).tobytes() + tail.tobytes()


def inverse(data: bytes, name: str) -> bytes:
    kind, width = parse(name)
    if not kind:
        return data
    raw = np.frombuffer(data, np.uint8)
    count = len(raw) // width
    body, tail = raw[: count * width], raw[count * width :]
    if kind == 5:
        body = _planes_in(raw, count, width)
    elif kind != 2:
        body = np.ascontiguousarray(body.reshape(width, count).T).reshape(-1)
    if kind >= 2:
        delta = np.ascontiguousarray(body).view(f"<u{width}")
        body = np.cumsum(unzigzag(delta) if kind == 4 else delta, dtype=delta.dtype)
    return np.ascontiguousarray(body).tobytes() + tail.tobytes()
