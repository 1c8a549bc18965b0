"""Golden vectors, definitions, round trips and malformed blocks of the byte plane."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stratapack.functions import codecs, columnar, entropy, filters, lz
from stratapack.functions.codecs import Options
from stratapack.sources import generators

H = bytes.fromhex

GOLDEN_FILTERS = [
    ("delta-zigzag-shuffle-2", H("0201010100 03EE".replace(" ", "")), H("0401FE020003EE")),
    ("delta-zigzag-shuffle-1", bytes([5, 7, 6]), bytes([10, 4, 1])),
    ("delta-bitshuffle-1", bytes(range(1, 34)), b"\xff" * 4 + b"\0" * 28 + b"\1"),
    ("delta-shuffle-2", H("020101010003EE"), H("02FFFF01FF01EE")),
    ("shuffle-2", H("A0A1B0B1C0C177"), H("A0B0C0A1B1C177")),
    ("shuffle-4", bytes(range(10)), bytes([0, 4, 1, 5, 2, 6, 3, 7, 8, 9])),
    ("delta-2", H("020101010003EE"), H("0201FFFFFF01EE")),
    ("delta-1", bytes([5, 7, 6, 255, 0]), bytes([5, 2, 255, 249, 1])),
]
NAMES = ["none"] + [f"{k}-{w}" for k in filters.KINDS[1:] for w in filters.WIDTHS]


@pytest.mark.parametrize("name,plain,filtered", GOLDEN_FILTERS)
def test_filter_vectors(name, plain, filtered):
    assert filters.forward(plain, name) == filtered
    assert filters.inverse(filtered, name) == plain


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=700), st.sampled_from(NAMES))
def test_filters_reverse(data, name):
    assert filters.inverse(filters.forward(data, name), name) == data


def test_filter_names():
    assert [filters.name_of(*filters.parse(n)) for n in NAMES] == NAMES
    for bad in ("delta", "shuffle-3", "gorilla-4", "none-1"):
        with pytest.raises(ValueError):
            filters.parse(bad)
    assert filters.sample_len(65536) == 8192 and filters.sample_len(32768) == 4096


@pytest.mark.parametrize("codec,size", [("lz4", 395), ("glz", 153), ("glze", 40)])
def test_zero_chunk(codec, size):
    payload, stored, name = codecs.encode_chunk(bytes(65536), Options(codec=codec, filters="auto"))
    assert (len(payload), stored, name) == (size, False, "none")


def test_small_vectors():
    assert lz.hash_words(np.array([1], np.uint32), 12)[0] == 2531
    _, offset = lz.find_matches(bytes(200), lz.Search(block=64))
    assert (offset[64], offset[100]) == (1, 37)
    assert lz.lz4_unblock(b"\x50hello", 5) == b"hello"
    block = columnar.glz_block(b"abcdabcdxy", [(0, 4, 4, 4), (8, 2, 0, 0)])
    assert block == H("02000000000000004020000004000000") + b"abcdxy"
    assert columnar.glz_decode(block, 10) == b"abcdabcdxy"


def defined_matches(data, search):
    """The sequential definition: a table of earlier blocks, chains of candidates."""
    n, found = len(data), [(0, 0)] * len(data)
    if n < 12:
        return found
    table, chain = {}, [0] * n
    bucket = lambda p: int.from_bytes(data[p : p + 4], "little") * 2654435761 % 2**32 >> (32 - search.hash_log)
    for start in range(0, n - 11, search.block):
        block = range(start, min(start + search.block, n - 11))
        for p in block:
            entry = chain[p] = table.get(bucket(p), 0)
            for _ in range(search.depth):
                if not entry or p - entry + 1 > 65535:
                    break
                end, back = p, p - entry + 1
                while end < min(p + search.probe, n - 5) and data[end - back] == data[end]:
                    end += 1
                if end - p >= 4 and end - p > found[p][0]:
                    found[p] = (end - p, back)
                entry = chain[entry - 1]
        for p in block:
            table[bucket(p)] = p + 1
    return found


@settings(max_examples=30, deadline=None)
@given(st.lists(st.sampled_from([b"ab", b"abc", b"xyz", b"hello ", b"\0\0\0\0", b"q"]), max_size=300), st.sampled_from([1, 4, 16]), st.sampled_from([16, 128]))
def test_matches_equal_the_definition(parts, depth, block):
    data, search = b"".join(parts), lz.Search(depth=depth, block=block)
    length, offset = lz.find_matches(data, search)
    assert list(zip(length.tolist(), offset.tolist(), strict=True)) == defined_matches(data, search)


INPUTS = {**generators.synthetic(9001), **generators.numeric(9001), "empty": b"", "one": b"*", "far": (generators.pseudo_random(35000) * 2)[:70000]}


@pytest.mark.parametrize("codec", codecs.CODECS)
@pytest.mark.parametrize("level", [1, 2, 3])
def test_round_trips(codec, level):
    for data in INPUTS.values():
        for mode in ("none", "auto") if len(data) < 20000 and level < 3 else ("none",):
            payload, stored, name = codecs.encode_chunk(data, Options(codec=codec, level=level, filters=mode))
            assert codecs.decode_chunk(payload, stored, codec, len(data), name, codecs.checksum(data)) == data


def test_dependency_groups():
    """No match of a group reads another match's output in it."""
    data = INPUTS["text"]
    found = lz.sequences(data, lz.for_level(1), groups=8)
    at, ranges = 0, []
    for k, (_, literals, match, back) in enumerate(found):
        if k % 8 == 0:
            ranges = []
        at += literals
        if match:
            source = (at - back, at - back + min(back, match))
            assert not any(a < source[1] and source[0] < b for a, b in ranges)
            ranges.append((at, at + match))
        at += match
    assert columnar.glz_decode(columnar.glz_block(data, found), len(data)) == data


def test_sample_decides_like_all_on_small_chunks():
    for name in ("sorted-u32", "text", "f64-walk"):
        data = INPUTS[name][:4096]
        a, b = (codecs.encode_chunk(data, Options(codec="lz4", chunk_size=4096, filters=f)) for f in ("auto", "exhaustive"))
        assert a == b


@pytest.mark.parametrize("codec", ["lz4", "glz", "glze"])
def test_malformed_blocks(codec):
    data = INPUTS["text"][:3000]
    payload, stored, name = codecs.encode_chunk(data, Options(codec=codec))
    assert not stored
    for k in range(len(payload)):
        with pytest.raises(lz.BlockError):
            codecs.decode_chunk(payload[:k], False, codec, len(data), name)
        spoilt = bytearray(payload)
        spoilt[k] ^= 0x5A
        try:
            assert codecs.decode_chunk(bytes(spoilt), False, codec, len(data), name, codecs.checksum(data)) == data
        except lz.BlockError:
            pass


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=3000), st.integers(0, 3))
def test_streams(data, shift):
    data = bytes(b >> shift * 2 for b in data)
    packed = entropy.encode_stream(data)
    assert len(packed) % 4 == 0
    assert entropy.decode_stream(packed, 0, len(data)) == (data, len(packed))


def test_long_codes_are_folded():
    counts = np.zeros(256, np.int64)
    a, b = 1, 1
    for s in range(25):
        counts[s], a, b = a, b, a + b
    lengths = entropy.code_lengths(counts)
    assert lengths.max() == entropy.MAX_LEN and entropy.kraft(lengths) == 1 << entropy.MAX_LEN


def test_options_are_checked():
    for bad in ({"codec": "zip"}, {"chunk_size": 5000}, {"codec": "lz4", "groups": 8}, {"filters": "delta-3"}):
        with pytest.raises(ValueError):
            Options(**bad)
