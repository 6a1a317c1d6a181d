"""Codes of the binary form: integers of one to nine bytes, compacted integer lists, two-bit DNA,
and length-limited Huffman codes of list bytes.

All are little-endian. These work on bytes; columns use functions.scalars.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

LONGEST = 12  # bits of a Huffman code

# --- integers ------------------------------------------------------------------------------


def put_int(x: int) -> bytes:
    """One byte for 6 bits and a sign, two for 13 bits, else a count and two to eight bytes."""
    size = x if x >= 0 else ~x
    if size < 1 << 6:
        return bytes([(x & 0xBF if x < 0 else x) | 0x40])
    if 0 <= x < 1 << 13:
        return bytes([0x20 | x >> 8, x & 0xFF])
    n = max(2, (size.bit_length() + 7) // 8)
    raw = (x & (1 << 64) - 1).to_bytes(8, "little")[:n]
    return bytes([(0x80 if x < 0 else 0) | n - 1]) + raw


def get_int(raw, at: int) -> tuple[int, int]:
    """The integer at a place, and the place after it."""
    head = raw[at]
    if head & 0x40:
        return (head & 0x3F if head < 0x80 else head - 256), at + 1
    if head & 0x20:
        return (head & 0x1F) << 8 | raw[at + 1], at + 2
    n = (head & 0x07) + 1
    if n == 1:
        raise ValueError("not an integer code")
    body = int.from_bytes(raw[at + 1 : at + 1 + n], "little")
    return (body - (1 << 8 * n) if head & 0x80 else body), at + 1 + n


# --- integer lists -------------------------------------------------------------------------


def put_ints(values) -> tuple[bytes, int, bytes]:
    """The first value's code, bytes of each difference (0 for one value), and the differences."""
    v = np.asarray(values, np.int64)
    first = put_int(int(v[0]))
    if len(v) == 1:
        return first, 0, b""
    d = np.diff(v)
    most = int(np.where(d >= 0, d, ~d).max())
    n = max(1, -(-(most.bit_length() + 1) // 8))
    return first, n, d.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :n].tobytes()


def get_ints(first: int, width: int, raw: bytes) -> list[int]:
    b = np.frombuffer(raw, np.uint8).reshape(-1, width)
    wide = np.empty((len(b), 8), np.uint8)
    wide[:, :width] = b
    wide[:, width:] = np.where(b[:, -1:] >= 128, 255, 0)
    d = wide.reshape(-1).view("<i8")
    return np.cumsum(np.r_[np.int64(first), d]).tolist()


# --- DNA -----------------------------------------------------------------------------------

_NUMBER = np.zeros(256, np.uint8)
for _i, _c in enumerate("acgt"):
    _NUMBER[[ord(_c), ord(_c.upper())]] = _i
_LETTER = np.frombuffer(b"acgt", np.uint8)


def pack_dna(text: bytes) -> bytes:
    """Four letters a byte, the first one highest; other letters count as a."""
    x = _NUMBER[np.frombuffer(text, np.uint8)]
    x = np.r_[x, np.zeros(-len(x) % 4, np.uint8)].reshape(-1, 4)
    return (x[:, 0] << 6 | x[:, 1] << 4 | x[:, 2] << 2 | x[:, 3]).astype(np.uint8).tobytes()


def unpack_dna(raw: bytes, n: int) -> bytes:
    b = np.frombuffer(raw, np.uint8)
    x = np.stack([b >> 6, b >> 4 & 3, b >> 2 & 3, b & 3], 1).reshape(-1)[:n]
    return _LETTER[x].tobytes()


# --- Huffman -------------------------------------------------------------------------------


def code_lengths(counts: dict[int, int], longest: int = LONGEST) -> dict[int, int]:
    """Lengths of an optimal prefix code with no code above `longest` bits, by package merge."""
    symbols = sorted(counts, key=lambda s: (counts[s], s))
    if len(symbols) == 1:
        return {symbols[0]: 1}
    if len(symbols) > 1 << longest:
        raise ValueError("more symbols than codes")
    coins = [(counts[s], (s,)) for s in symbols]
    level = coins
    for _ in range(longest - 1):
        pairs = [(a[0] + b[0], a[1] + b[1]) for a, b in zip(level[::2], level[1::2])]
        level = sorted(coins + pairs, key=lambda x: (x[0], len(x[1])))
    out = dict.fromkeys(symbols, 0)
    for _, members in level[: 2 * len(symbols) - 2]:
        for s in members:
            out[s] += 1
    return out


@dataclass
class Huffman:
    """Codes and lengths of bytes; `escape` is the byte value whose code announces a byte as it is."""

    codes: dict[int, int]
    lengths: dict[int, int]
    escape: int = -1

    @classmethod
    def trained(cls, counts: dict[int, int], partial: bool = True) -> Huffman:
        """From a histogram of bytes; with `partial` a byte of no count gets the escape code."""
        counts = {s: n for s, n in counts.items() if n > 0}
        missing = [b for b in range(256) if b not in counts]
        escape = missing[0] if partial and missing else -1
        lengths = code_lengths(counts | ({escape: 1} if escape >= 0 else {}))
        codes, code, before = {}, 0, 0
        for n, s in sorted((n, s) for s, n in lengths.items()):
            code <<= n - before
            codes[s], before = code, n
            code += 1
        return cls(codes, lengths, escape)

    def dumps(self) -> bytes:
        """Order mark, escape byte and its length, then a length a byte value and the code of those that have one."""
        out = [b"\0", struct.pack("<ii", self.escape, self.lengths.get(self.escape, 0) if self.escape >= 0 else 0)]
        for s in range(256):
            n = self.lengths.get(s, 0)
            out.append(bytes([0 if s == self.escape else n]))
            if n:
                out.append(struct.pack("<H", self.codes[s]))
        return b"".join(out)

    @classmethod
    def loads(cls, raw: bytes) -> Huffman:
        order = ">" if raw[0] else "<"
        escape, escape_length = struct.unpack_from(order + "ii", raw, 1)
        codes, lengths, at = {}, {}, 9
        for s in range(256):
            n, at = raw[at], at + 1
            if n or s == escape:
                codes[s], lengths[s] = struct.unpack_from(order + "H", raw, at)[0], n or escape_length
                at += 2
        return cls(codes, lengths, escape)

    def encode(self, data: bytes) -> tuple[int, bytes]:
        """Bits and bytes. Two marking bits come first; where codes are no shorter, a byte 255 and the data.

        The bits lie in 64-bit words of little-endian order, of which the first one's outer bytes
        are exchanged, so that the marks are in the first byte; the last word is cut to its bytes.
        """
        bits, n = 0, 2
        for b in data:
            if b in self.codes and b != self.escape:
                bits, n = bits << self.lengths[b] | self.codes[b], n + self.lengths[b]
            elif self.escape >= 0:
                k = self.lengths[self.escape]
                bits, n = (bits << k | self.codes[self.escape]) << 8 | b, n + k + 8
            else:
                raise ValueError(f"no code for byte {b}")
        if n > 8 * len(data):
            return 8 * len(data) + 8, b"\xff" + data
        raw = bytearray((bits << -n % 8).to_bytes((n + 7) // 8, "big"))
        return n, bytes(_words(raw, n))

    def decode(self, n: int, raw: bytes) -> bytes:
        if raw[0] == 0xFF:
            return bytes(raw[1 : n // 8])
        raw = bytearray(raw[: (n + 7) // 8])
        big = raw[0] & 0x40
        text = np.unpackbits(np.frombuffer(bytes(raw) if big else bytes(_words(raw, n)), np.uint8))[2:n]
        # 16 bits ahead from every place, then a walk
        wide = np.r_[text, np.zeros(16, np.uint8)].astype(np.uint32)
        ahead = np.zeros(len(text), np.uint32)
        for k in range(16):
            ahead |= wide[k : k + len(text)] << np.uint32(15 - k)
        look = self._lookup()
        out, at = bytearray(), 0
        while at < len(text):
            s = look[ahead[at]]
            at += self.lengths[int(s)]
            if s == self.escape:
                out.append(int(ahead[at]) >> 8)
                at += 8
            else:
                out.append(int(s))
        return bytes(out)

    def _lookup(self) -> np.ndarray:
        look = np.full(1 << 16, -1, np.int16)
        for s, n in self.lengths.items():
            base = self.codes[s] << 16 - n
            look[base : base + (1 << 16 - n)] = s
        return look


def _words(raw: bytearray, n: int) -> bytearray:
    """Between plain bit order and the stored one; it is its own inverse."""
    swapped = bytearray(raw)
    for at in range(0, n // 64 * 8, 8):
        swapped[at : at + 8] = raw[at : at + 8][::-1]
    if n >= 64:  # the first word's outer bytes are exchanged once more
        swapped[0], swapped[7] = swapped[7], swapped[0]
    return swapped
