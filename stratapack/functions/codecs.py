"""One chunk through filter and codec, and back."""

from __future__ import annotations

from dataclasses import dataclass

import xxhash

from stratapack.functions import columnar, filters, lz

#: Fixed values of the format: codec names by id, chunk sizes.
CODECS = ("stored", "lz4", "glz", "glze")
MIN_CHUNK, MAX_CHUNK, DEFAULT_CHUNK = 4096, 1 << 20, 65536


@dataclass(frozen=True)
class Options:
    """filters: 'none', 'auto' (a sample decides), 'exhaustive', or the name of one filter."""

    codec: str = "lz4"
    chunk_size: int = DEFAULT_CHUNK
    level: int = 1
    filters: str = "none"
    checksums: bool = False
    groups: int | None = None

    def __post_init__(self):
        if self.codec not in CODECS:
            raise ValueError(f"unknown codec {self.codec!r}")
        if self.chunk_size & (self.chunk_size - 1) or not MIN_CHUNK <= self.chunk_size <= MAX_CHUNK:
            raise ValueError(f"chunk size {self.chunk_size} is not a power of two in 4 KiB..=1 MiB")
        if self.groups is not None and (not 1 <= self.groups <= 64 or self.codec not in ("glz", "glze")):
            raise ValueError("dependency groups are 1..=64 and for columnar codecs")
        if self.filters not in ("none", "auto", "exhaustive"):
            filters.parse(self.filters)


def checksum(data: bytes) -> int:
    """Low 32 bits of xxh3-64."""
    return xxhash.xxh3_64_intdigest(data) & 0xFFFFFFFF


def parsed(data: bytes, options: Options) -> list[tuple[int, int, int, int]]:
    return lz.sequences(data, lz.for_level(options.level), options.groups if options.codec != "lz4" else None)


_BLOCK = {"lz4": lz.lz4_block, "glz": columnar.glz_block, "glze": lambda data, found: columnar.glze_from_glz(columnar.glz_block(data, found))}
_SIZE = {"lz4": lambda data, found: lz.lz4_size(found), "glz": lambda data, found: columnar.glz_size(found), "glze": columnar.glze_size}


def block(data: bytes, options: Options) -> bytes:
    """The codec's block of unfiltered bytes, whether it is smaller or not."""
    return _BLOCK[options.codec](data, parsed(data, options))


def smallest(data: bytes, names: tuple[str, ...], options: Options) -> tuple[str, bytes, list[tuple[int, int, int, int]]]:
    """The filter whose block is the smallest, the earliest of equal ones, with the filtered bytes and their parse. No block is made."""
    best = None
    for name in names:
        filtered = filters.forward(data, name)
        found = parsed(filtered, options)
        size = _SIZE[options.codec](filtered, found)
        if best is None or size < best[0]:
            best = (size, name, filtered, found)
    return best[1:]


def encode_chunk(data: bytes, options: Options) -> tuple[bytes, bool, str]:
    """(payload, stored, filter). A chunk that doesn't shrink is stored unfiltered."""
    if options.codec == "stored":
        return data, True, "none"
    name, made = options.filters, None
    if name in ("auto", "exhaustive"):
        sample = data[: filters.sample_len(options.chunk_size)] if name == "auto" else data
        name, *made = smallest(sample, filters.candidates(options.level), options)
        made = made if len(sample) == len(data) else None
    if not made:
        filtered = filters.forward(data, name)
        made = filtered, parsed(filtered, options)
    packed = _BLOCK[options.codec](*made)
    return (packed, False, name) if len(packed) < len(data) else (data, True, "none")


_DECODE = {"lz4": lz.lz4_unblock, "glz": columnar.glz_decode, "glze": columnar.glze_decode}


def decode_chunk(payload: bytes, stored: bool, codec: str, size: int, filter_name: str, expected: int | None = None) -> bytes:
    """The chunk's original bytes; expected: its checksum, which is of the unfiltered bytes."""
    if stored:
        if len(payload) != size:
            raise lz.BlockError("SizeMismatch")
        data = payload
    elif codec == "stored":
        raise lz.BlockError("BadMode")
    else:
        data = _DECODE[codec](payload, size)
    data = filters.inverse(data, filter_name)
    if expected is not None and checksum(data) != expected:
        raise lz.BlockError("ChecksumMismatch")
    return data
