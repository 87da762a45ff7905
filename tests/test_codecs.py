import gzip
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from glossmill.sources import codecs
from glossmill.sources.mdict import decrypt, encrypt

PAYLOAD = b"Hello, dictzip world, this is the first.\n Second line of text with a little more.\n Third line, which ends the payload here.!\n"


@pytest.mark.parametrize(("message", "digest"), [(b"", "cdf26213a150dc3ecb610f18f6b38b46"), (b"a", "86be7afa339d0fc7cfc785e72f578d33"), (b"abc", "c14a12199c66e4ba84636b0f69144c77")])
def test_ripemd128(message, digest):
    assert codecs.ripemd128(message).hex() == digest


def test_ripemd128_blocks():
    """Lengths around the block size go through, each with its own digest."""
    assert len({codecs.ripemd128(b"x" * n) for n in range(50, 140)}) == 90


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=600), st.integers(1, 80), st.integers(0, 700), st.integers(0, 300))
def test_dictzip(data, chunk, offset, length):
    packed = codecs.dictzip(data, chunk)
    assert gzip.decompress(packed) == data
    reader = codecs.DictZip(packed)
    assert reader.read_all() == data
    if offset < len(data):
        assert reader.read(offset, length) == data[offset : offset + length]


def test_dictzip_reads():
    reader = codecs.DictZip(codecs.dictzip(PAYLOAD, 50))
    assert len(reader.starts) == 4 and reader.read(0, 5) == b"Hello" and reader.read(7, 7) == b"dictzip" and reader.read(42, 6) == b"Second"


def test_dictzip_needs_its_table():
    with pytest.raises(ValueError):
        codecs.DictZip(gzip.compress(b"plain"))


@settings(max_examples=20, deadline=None)
@given(st.binary(max_size=9000), st.integers(0, 2), st.integers(0, 9000), st.integers(0, 9000))
def test_ebzip(data, level, offset, length):
    reader = codecs.EbZip(codecs.ebzip(data, level))
    assert reader.read(offset, length) == data[offset : offset + length]


def test_ebzip_stored_slice():
    data = os.urandom(5000)
    assert codecs.EbZip(codecs.ebzip(data)).read(0, 5000) == data


def test_gunzip_ignores_trailer():
    packed = gzip.compress(b"text" * 99)
    assert codecs.gunzip(packed[:-8] + b"badcrc!!") == b"text" * 99


def test_lzo():
    run = bytes([17 + 8]) + b"abcdefgh"
    assert codecs.lzo1x(run + b"\x11\0\0", 8) == b"abcdefgh"
    near = bytes([(3 << 5) | (3 << 2) | 2, 0])  # four bytes from four back, then two literals
    assert codecs.lzo1x(run + near + b"XY" + b"\x11\0\0", 14) == b"abcdefghefghXY"
    mid = bytes([32 | 3]) + ((7 << 2) | 0).to_bytes(2, "little")  # five bytes from eight back
    assert codecs.lzo1x(run + mid + b"\x11\0\0", 13) == b"abcdefghabcde"
    long = b"\0\x0f" + b"z" * 33 + b"\x11\0\0"  # 3 + 15 + 15 literals
    assert codecs.lzo1x(long, 33) == b"z" * 33
    with pytest.raises(ValueError):
        codecs.lzo1x(bytes([17 + 4]) + b"abcd" + bytes([64 | 28, 9]), 9)


@given(st.binary(max_size=300), st.binary(min_size=4, max_size=4))
def test_mdict_cipher(data, check):
    assert decrypt(encrypt(data, check), check) == data
