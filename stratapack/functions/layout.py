"""The container's header, chunk table and range arithmetic on plain values."""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass, replace

from stratapack.functions import filters
from stratapack.functions.codecs import CODECS, MAX_CHUNK, MIN_CHUNK

#: Fixed values of the format.
MAGIC, VERSION = b"GPCZ", 1
HEADER, ENTRY = struct.Struct("<4sHHIIQIB3s"), struct.Struct("<QIIIBB2s")
STORED = 1 << 31


class FormatError(ValueError):
    def __init__(self, status: str, detail: object = ""):
        super().__init__(f"{status} {detail}".strip())
        self.status, self.detail = status, detail


def pad4(n: int) -> int:
    return (n + 3) // 4 * 4


def chunk_count(total: int, chunk_size: int) -> int:
    return -(-total // chunk_size)


@dataclass(frozen=True)
class Header:
    codec: str
    chunk_size: int
    chunk_count: int
    total_size: int
    checksums: bool = False
    level: int = 1

    def to_bytes(self) -> bytes:
        return HEADER.pack(MAGIC, VERSION, CODECS.index(self.codec), self.chunk_size, self.chunk_count, self.total_size, int(self.checksums), self.level, b"\0\0\0")

    @staticmethod
    def parse(data: bytes) -> Header:
        if len(data) < HEADER.size:
            raise FormatError("Truncated", HEADER.size)
        magic, version, codec, size, count, total, flags, level, rest = HEADER.unpack_from(data)
        for wrong, status in (
            (magic != MAGIC, "BadMagic"),
            (version != VERSION, "UnsupportedVersion"),
            (codec >= len(CODECS), "UnknownCodec"),
            (flags > 1, "UnknownFlags"),
            (rest != b"\0\0\0", "NonzeroReserved"),
        ):
            if wrong:
                raise FormatError(status)
        return Header(CODECS[codec], size, count, total, bool(flags), level)

    def size_of(self, k: int) -> int:
        """Uncompressed size of chunk k."""
        return max(0, min(self.chunk_size, self.total_size - k * self.chunk_size))


@dataclass(frozen=True)
class Entry:
    comp_offset: int
    comp_size: int
    stored: bool
    uncomp_size: int
    checksum: int = 0
    filter: str = "none"

    def to_bytes(self) -> bytes:
        kind, width = filters.parse(self.filter)
        return ENTRY.pack(self.comp_offset, self.comp_size | (STORED if self.stored else 0), self.uncomp_size, self.checksum, kind, width, b"\0\0")

    @staticmethod
    def parse(data: bytes, at: int = 0) -> Entry:
        offset, size, plain, checksum, kind, width, rest = ENTRY.unpack_from(data, at)
        if rest != b"\0\0":
            raise FormatError("NonzeroReserved")
        try:
            name = filters.name_of(kind, width)
        except ValueError as e:
            raise FormatError("UnknownFilter" if kind >= len(filters.KINDS) else "BadFilterWidth") from e
        return Entry(offset, size & ~STORED, bool(size & STORED), plain, checksum, name)


@dataclass(frozen=True)
class Index:
    header: Header
    chunks: tuple[Entry, ...]

    @property
    def data_offset(self) -> int:
        return HEADER.size + ENTRY.size * len(self.chunks)

    def to_bytes(self) -> bytes:
        return self.header.to_bytes() + b"".join(c.to_bytes() for c in self.chunks)

    @staticmethod
    def parse(data: bytes) -> Index:
        header = Header.parse(data)
        need = HEADER.size + ENTRY.size * header.chunk_count
        if len(data) < need:
            raise FormatError("Truncated", need)
        return Index(header, tuple(Entry.parse(data, HEADER.size + ENTRY.size * k) for k in range(header.chunk_count)))

    def validate(self, data_len: int) -> None:
        """Raises on the first rule that fails, chunk by chunk."""
        h = self.header
        if h.chunk_size & (h.chunk_size - 1) or not MIN_CHUNK <= h.chunk_size <= MAX_CHUNK:
            raise FormatError("BadChunkSize", h.chunk_size)
        if not chunk_count(h.total_size, h.chunk_size) == h.chunk_count == len(self.chunks):
            raise FormatError("ChunkCountMismatch", h.chunk_count)
        free = 0
        for k, c in enumerate(self.chunks):
            end = pad4(c.comp_offset + c.comp_size)
            rules = {
                "size": c.uncomp_size != h.size_of(k),
                "alignment": c.comp_offset % 4 != 0,
                "overlap": c.comp_offset < free,
                "bounds": end > data_len,
                "stored size": c.stored and c.comp_size != c.uncomp_size,
                "stored codec": not c.stored and h.codec == "stored",
                "checksum": not h.checksums and c.checksum != 0,
            }
            for reason, broken in rules.items():
                if broken:
                    raise FormatError("BadChunk", (k, reason))
            free = end


def chunks_for_range(total: int, chunk_size: int, offset: int, length: int) -> range:
    """Numbers of the chunks that overlap [offset, offset + length)."""
    if offset < 0 or length < 0 or offset + length > total:
        raise FormatError("RangeOutOfBounds", (offset, length, total))
    return range(offset // chunk_size, (offset + length - 1) // chunk_size + 1) if length else range(0)


def assemble(header: Header, entries: list[Entry], payloads: list[bytes]) -> bytes:
    """The file: entries get running offsets, payloads their padding."""
    placed, at, body = [], 0, []
    for e, p in zip(entries, payloads, strict=True):
        placed.append(replace(e, comp_offset=at))
        body += [p, b"\0" * (-len(p) % 4)]
        at += pad4(len(p))
    return Index(header, tuple(placed)).to_bytes() + b"".join(body)


def splice(header: Header, parts: list[bytes]) -> bytes:
    """Join files of consecutive chunks into the file of the whole."""
    entries, body, offset = [], [], 0
    for part in parts:
        index = Index.parse(part)
        h = index.header
        if (h.codec, h.chunk_size, h.level, h.checksums) != (header.codec, header.chunk_size, header.level, header.checksums):
            raise FormatError("Splice", "parts differ in codec, chunk size, level or checksums")
        index.validate(len(part) - index.data_offset)
        used = max((pad4(c.comp_offset + c.comp_size) for c in index.chunks[-1:]), default=0)
        entries += [replace(c, comp_offset=c.comp_offset + offset) for c in index.chunks]
        body.append(part[index.data_offset : index.data_offset + used])
        offset += used
    if len(entries) != header.chunk_count:
        raise FormatError("Splice", "the parts' chunk counts don't add up")
    if any(e.uncomp_size != header.size_of(k) for k, e in enumerate(entries)):
        raise FormatError("Splice", "the parts' chunks don't line up")
    return Index(header, tuple(entries)).to_bytes() + b"".join(body)


def head_chunks(total: int, chunk_size: int, tail_share: float) -> int:
    """Chunks before the tail on a fixed split; halves round away from zero."""
    if not 0 <= tail_share <= 1:
        raise FormatError("BadShare", tail_share)
    count = chunk_count(total, chunk_size)
    return count - int(count * tail_share + 0.5)


def parse_bytes(text: str, units: str = "KMG") -> int:
    """'123', '512K', '8M', '2G' in binary units."""
    found = re.fullmatch(rf"(\d+)([{units}]?)", text, re.IGNORECASE)
    if not found:
        raise ValueError(f"invalid byte count {text!r}")
    return int(found[1]) << (10 * (units.index(found[2].upper()) + 1) if found[2] else 0)


def parse_size(text: str) -> int:
    """'4096', '64K', '1M', below 2^32."""
    size = parse_bytes(text, "KM")
    if size >= 1 << 32:
        raise ValueError(f"size {text!r} is too large")
    return size


def parse_share(text: str) -> float:
    share = float(text)
    if not 0 <= share <= 1:
        raise ValueError(f"{text!r} is not a fraction from 0 to 1")
    return share
