"""Byte-level codecs of dictionary files. Everything here is plain Python that runs inside readers."""

from __future__ import annotations

import struct
import zlib
from collections import OrderedDict


class Bytes:
    """A cursor over big-endian fields."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def take(self, n: int) -> bytes:
        out = self.data[self.at : self.at + n]
        if len(out) < n:
            raise ValueError(f"{n} bytes wanted at {self.at}, {len(out)} left")
        self.at += n
        return out

    def number(self, width: int) -> int:
        return int.from_bytes(self.take(width), "big")

    def until(self, end: bytes = b"\0") -> bytes:
        """Up to the terminator, which is aligned to its own width, or to the end."""
        step, stop = len(end), self.at
        while stop < len(self.data) and self.data[stop : stop + step] != end:
            if step == 1:
                found = self.data.find(end, stop)
                stop = found if found >= 0 else len(self.data)
            else:
                stop += step
        out, self.at = self.data[self.at : stop], stop + step
        return out

    @property
    def left(self) -> int:
        return len(self.data) - self.at


class Cache:
    """The last ``size`` results by key."""

    def __init__(self, size: int):
        self.size, self.held = size, OrderedDict()

    def get(self, key, make):
        if key in self.held:
            self.held.move_to_end(key)
        else:
            self.held[key] = make()
            if len(self.held) > self.size:
                self.held.popitem(last=False)
        return self.held[key]


class DictZip:
    """A gzip file with a table of chunks in its header, read from any offset of the unpacked data."""

    def __init__(self, data: bytes, cached: int = 8):
        if data[:3] != b"\x1f\x8b\x08":
            raise ValueError("not a gzip file")
        flags, at = data[3], 10
        if not flags & 4:
            raise ValueError("no dictzip table: the header has no extra field")
        end = at + 2 + int.from_bytes(data[at : at + 2], "little")
        at, self.chunk, sizes = at + 2, 0, None
        while at + 4 <= end:
            kind, size = data[at : at + 2], int.from_bytes(data[at + 2 : at + 4], "little")
            if kind == b"RA":
                _, self.chunk, n = struct.unpack_from("<3H", data, at + 4)
                sizes = struct.unpack_from(f"<{n}H", data, at + 10)
            at += 4 + size
        if sizes is None or not self.chunk:
            raise ValueError("no dictzip table: the extra field has no RA part")
        at = end
        for flag in (8, 16):  # name, comment
            if flags & flag:
                at = data.index(b"\0", at) + 1
        at += 2 if flags & 2 else 0
        self.data, self.starts = data, [at]
        for n in sizes:
            self.starts.append(self.starts[-1] + n)
        self.cache = Cache(cached)

    def _unpacked(self, n: int) -> bytes:
        return self.cache.get(n, lambda: zlib.decompressobj(-15).decompress(self.data[self.starts[n] : self.starts[n + 1]]))

    def read(self, offset: int, length: int) -> bytes:
        if length <= 0:
            return b""
        last = min((offset + length - 1) // self.chunk, len(self.starts) - 2)
        joined = b"".join(self._unpacked(n) for n in range(offset // self.chunk, last + 1))
        within = offset % self.chunk
        return joined[within : within + length]

    def read_all(self) -> bytes:
        return b"".join(zlib.decompressobj(-15).decompress(self.data[a:b]) for a, b in zip(self.starts, self.starts[1:], strict=False))


def dictzip(data: bytes, chunk: int = 58315, level: int = 9) -> bytes:
    """Packs data with a table of chunks; tools and tests write their files with it."""
    parts = []
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    for at in range(0, len(data), chunk):
        parts.append(packer.compress(data[at : at + chunk]) + packer.flush(zlib.Z_FULL_FLUSH))
    tail = packer.flush()
    table = struct.pack("<3H", 1, chunk, len(parts)) + b"".join(struct.pack("<H", len(p)) for p in parts)
    extra = b"RA" + struct.pack("<H", len(table)) + table
    head = b"\x1f\x8b\x08\x04" + bytes(6) + struct.pack("<H", len(extra)) + extra
    return head + b"".join(parts) + tail + struct.pack("<2I", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def gunzip(data: bytes) -> bytes:
    """Unpacks gzip data; what could be unpacked counts, whatever the trailer says."""
    if data[:3] != b"\x1f\x8b\x08":
        raise ValueError("not a gzip file")
    flags, at = data[3], 10
    if flags & 4:
        at += 2 + int.from_bytes(data[at : at + 2], "little")
    for flag in (8, 16):  # name, comment
        if flags & flag:
            at = data.index(b"\0", at) + 1
    at += 2 if flags & 2 else 0
    packer, out = zlib.decompressobj(-15), bytearray()
    try:
        while at < len(data) and not packer.eof:
            out += packer.decompress(data[at : at + (1 << 16)])
            at += 1 << 16
    except zlib.error:
        if not out:
            raise
    return bytes(out)


class EbZip:
    """An EBZIP file: slices of 2048 << level bytes, each deflated or, if that gains nothing, stored."""

    def __init__(self, data: bytes, cached: int = 64):
        if data[:5] != b"EBZip":
            raise ValueError("not an EBZIP file")
        self.data, self.slice = data, 2048 << (data[5] & 0x0F)
        self.size = int.from_bytes(data[9:14], "big")
        limits = ((1 << 16, 2), (1 << 24, 3), (1 << 32, 4))
        self.width = next((w for limit, w in limits if self.size < limit), 5)
        self.count = -(-self.size // self.slice)
        self.cache = Cache(cached)

    def _start(self, n: int) -> int:
        at = 22 + n * self.width
        return int.from_bytes(self.data[at : at + self.width], "big")

    def _unpacked(self, n: int) -> bytes:
        raw = self.data[self._start(n) : self._start(n + 1)]
        return raw if len(raw) == self.slice else zlib.decompress(raw)[: self.slice]

    def read(self, offset: int, length: int) -> bytes:
        length = min(length, self.size - offset)
        if length <= 0:
            return b""
        first, last = offset // self.slice, (offset + length - 1) // self.slice
        joined = b"".join(self.cache.get(n, lambda n=n: self._unpacked(n)) for n in range(first, last + 1))
        within = offset - first * self.slice
        return joined[within : within + length]


def ebzip(data: bytes, level: int = 0) -> bytes:
    """Packs data as EBZIP; tests write their files with it."""
    size = 2048 << level
    width = next((w for limit, w in ((1 << 16, 2), (1 << 24, 3), (1 << 32, 4)) if len(data) < limit), 5)
    parts = []
    for at in range(0, len(data), size):
        piece = data[at : at + size].ljust(size, b"\0")
        packed = zlib.compress(piece)
        parts.append(packed if len(packed) < size else piece)
    starts = [22 + width * (len(parts) + 1)]
    for p in parts:
        starts.append(starts[-1] + len(p))
    head = b"EBZip" + bytes([0x10 | level]) + bytes(3) + len(data).to_bytes(5, "big") + bytes(8)
    return head + b"".join(s.to_bytes(width, "big") for s in starts) + b"".join(parts)


def lzo1x(data: bytes, size: int) -> bytes:
    """Unpacks an LZO1X stream to at most ``size`` bytes.

    Instructions, as the format's public description has them, by the first byte: below 16 a run of literals or a
    short copy, depending on how many literals the last instruction left (state); 16 to 31 a far copy or the end;
    32 to 63 a copy within 16 KB; from 64 on one within 2 KB. The lowest two bits of a copy are literals to follow.
    """
    src, out, state = Bytes(data), bytearray(), 0

    def more(base: int) -> int:
        n = 0
        while (b := src.take(1)[0]) == 0:
            n += 255
        return n + base + b

    def copy(distance: int, length: int) -> None:
        start = len(out) - distance
        if start < 0:
            raise ValueError("LZO: a copy from before the start")
        for k in range(length):
            out.append(out[start + k])

    if src.left and data[0] > 17:
        n = src.take(1)[0] - 17
        out += src.take(n)
        state = n if n < 4 else 4
    while src.left:
        t = src.take(1)[0]
        if t >= 64:
            distance, length, state = (src.take(1)[0] << 3) + ((t >> 2) & 7) + 1, (t >> 5) + 1, t & 3
        elif t >= 32:
            length = (t & 31 or more(31)) + 2
            tail = int.from_bytes(src.take(2), "little")
            distance, state = (tail >> 2) + 1, tail & 3
        elif t >= 16:
            length = (t & 7 or more(7)) + 2
            tail = int.from_bytes(src.take(2), "little")
            distance, state = ((t & 8) << 11) + (tail >> 2), tail & 3
            if not distance:
                break
            distance += 0x4000
        elif state == 0:
            out += src.take((t or more(15)) + 3)
            state = 4
            continue
        else:
            near = src.take(1)[0]
            distance, length = ((near << 2) + (t >> 2) + 1, 2) if state < 4 else ((near << 2) + (t >> 2) + 2049, 3)
            state = t & 3
        copy(distance, length)
        out += src.take(state)
        if len(out) > size:
            raise ValueError("LZO: more data than announced")
    return bytes(out)


#: Fixed values of RIPEMD-128: message word and rotation of each step, by line, and the constants of the rounds.
_WORDS = (
    (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 7, 4, 13, 1, 10, 6, 15, 3, 12, 0, 9, 5, 2, 14, 11, 8, 3, 10, 14, 4, 9, 15, 8, 1, 2, 7, 0, 6, 13, 11, 5, 12, 1, 9, 11, 10, 0, 8, 12, 4, 13, 3, 7, 15, 14, 5, 6, 2),
    (5, 14, 7, 0, 9, 2, 11, 4, 13, 6, 15, 8, 1, 10, 3, 12, 6, 11, 3, 7, 0, 13, 5, 10, 14, 15, 8, 12, 4, 9, 1, 2, 15, 5, 1, 3, 7, 14, 6, 9, 11, 8, 12, 2, 10, 0, 4, 13, 8, 6, 4, 1, 3, 11, 15, 0, 5, 12, 2, 13, 9, 7, 10, 14),
)
_TURNS = (
    (11, 14, 15, 12, 5, 8, 7, 9, 11, 13, 14, 15, 6, 7, 9, 8, 7, 6, 8, 13, 11, 9, 7, 15, 7, 12, 15, 9, 11, 7, 13, 12, 11, 13, 6, 7, 14, 9, 13, 15, 14, 8, 13, 6, 5, 12, 7, 5, 11, 12, 14, 15, 14, 15, 9, 8, 9, 14, 5, 6, 8, 6, 5, 12),
    (8, 9, 9, 11, 13, 15, 15, 5, 7, 7, 8, 11, 14, 14, 12, 6, 9, 13, 15, 7, 12, 8, 9, 11, 7, 7, 12, 7, 6, 15, 13, 11, 9, 7, 15, 11, 8, 6, 6, 14, 12, 13, 5, 14, 13, 13, 7, 5, 15, 5, 8, 11, 14, 14, 6, 14, 6, 9, 12, 9, 12, 5, 15, 8),
)
_ROUND_CONSTANTS = ((0, 0x5A827999, 0x6ED9EBA1, 0x8F1BBCDC), (0x50A28BE6, 0x5C4DD124, 0x6D703EF3, 0))
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_MIXERS = (
    lambda x, y, z: x ^ y ^ z,
    lambda x, y, z: (x & y) | (~x & z),
    lambda x, y, z: (x | ~y) ^ z,
    lambda x, y, z: (x & z) | (y & ~z),
)


def ripemd128(message: bytes) -> bytes:
    """The 16-byte digest: two parallel lines of four rounds, the second with the mixers in reverse."""
    mask = 0xFFFFFFFF
    padded = message + b"\x80" + bytes((55 - len(message)) % 64) + struct.pack("<Q", 8 * len(message))
    state = _START
    for at in range(0, len(padded), 64):
        x = struct.unpack_from("<16I", padded, at)
        ends = []
        for line in (0, 1):
            a, b, c, d = state
            for step in range(64):
                turn = step // 16
                mixer = _MIXERS[3 - turn if line else turn]
                t = (a + mixer(b, c, d) + x[_WORDS[line][step]] + _ROUND_CONSTANTS[line][turn]) & mask
                s = _TURNS[line][step]
                a, d, c, b = d, c, b, ((t << s) | (t >> (32 - s))) & mask
            ends.append((a, b, c, d))
        (a, b, c, d), (e, f, g, h) = ends
        state = ((state[1] + c + h) & mask, (state[2] + d + e) & mask, (state[3] + a + f) & mask, (state[0] + b + g) & mask)
    return struct.pack("<4I", *state)
