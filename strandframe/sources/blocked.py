"""Binary sequence files: block-compressed alignments, and read databases with their overlaps.

Alignments and overlaps are read in splits from any store, files of any size by many tasks (see
`pieces`): the first are cut at the headers of their compressed blocks, the second at zeros.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.sources.pieces import Format, read_chained, stretches

_BASES = "=acmgrsvtwyhkdbn"
_OPS = "MIDNSHP=XB"
_LETTERS = np.frombuffer(_BASES.encode(), np.uint8)
BAM_ROW = "file string, qname string, flag int, rname string, pos long, mapq int, cigar string, rnext string, pnext long, tlen long, seq string, qual string, tags map<string,string>"


def blocks(raw, at: int = 0):
    """(place, data) of each block of block-compressed data."""
    n = len(raw)
    while at + 18 <= n:
        if raw[at] != 31 or raw[at + 1] != 139:
            raise ValueError(f"no block at {at}")
        extra = struct.unpack_from("<H", raw, at + 10)[0]
        p, size = at + 12, None
        while p < at + 12 + extra:
            a, b, k = raw[p], raw[p + 1], struct.unpack_from("<H", raw, p + 2)[0]
            if a == 66 and b == 67:
                size = struct.unpack_from("<H", raw, p + 4)[0] + 1
            p += 4 + k
        if size is None:
            raise ValueError(f"the block at {at} has no size")
        data = zlib.decompress(bytes(raw[at + 12 + extra : at + size - 8]), -15)
        if zlib.crc32(data) != struct.unpack_from("<I", raw, at + size - 8)[0]:
            raise ValueError(f"the block at {at} is damaged")
        yield at, data
        at += size


def compress_blocks(data: bytes, size: int = 65280) -> bytes:
    """Block-compressed form, with the empty block that ends a file."""
    out = []
    for i in [*range(0, len(data), size), None]:
        part = b"" if i is None else data[i : i + size]
        c = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = c.compress(part) + c.flush()
        out.append(b"\x1f\x8b\x08\4\0\0\0\0\0\xff\6\0BC\2\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part)))
    return b"".join(out)


class _Stream:
    """Bytes across blocks, with no more than a record and a block in memory."""

    def __init__(self, source):
        self.source, self.buf, self.at = source, b"", 0

    def take(self, n: int) -> bytes | None:
        while len(self.buf) - self.at < n:
            got = next(self.source, None)
            if got is None:
                if self.at == len(self.buf):
                    return None
                raise ValueError("the file ends within a record")
            self.buf, self.at = self.buf[self.at :] + got[1], 0
        self.at += n
        return self.buf[self.at - n : self.at]

    def int(self) -> int | None:
        raw = self.take(4)
        return None if raw is None else struct.unpack("<i", raw)[0]


_TAG = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}


def _tags(raw: bytes) -> list[tuple[str, str]]:
    out, at = [], 0
    while at + 3 <= len(raw):
        name, kind, at = raw[at : at + 2].decode(), chr(raw[at + 2]), at + 3
        if kind in _TAG:
            (v,) = struct.unpack_from("<" + _TAG[kind], raw, at)
            at += struct.calcsize(_TAG[kind])
            out.append((name, f"f:{v:g}" if kind == "f" else f"i:{v}"))
        elif kind == "A":
            out.append((name, f"A:{chr(raw[at])}"))
            at += 1
        elif kind in "ZH":
            end = raw.index(0, at)
            out.append((name, f"{kind}:{raw[at:end].decode()}"))
            at = end + 1
        elif kind == "B":
            sub, n = chr(raw[at]), struct.unpack_from("<i", raw, at + 1)[0]
            values = struct.unpack_from(f"<{n}{_TAG[sub]}", raw, at + 5)
            at += 5 + n * struct.calcsize(_TAG[sub])
            out.append((name, f"B:{sub}" + "".join(f",{v:g}" if sub == "f" else f",{v}" for v in values)))
        else:
            raise ValueError(f"a tag of type {kind!r}")
    return out


def bam_records(source):
    """Rows of BAM_ROW without the file, from an iterator of (place, data). Positions are 1-based, letters as in text."""
    s = _Stream(source)
    if s.take(4) != b"BAM\1":
        raise ValueError("not an alignment file")
    s.take(s.int())
    names = []
    for _ in range(s.int()):
        names.append(s.take(s.int())[:-1].decode())
        s.take(4)
    while (size := s.int()) is not None:
        yield _bam_row(s.take(size), names)


def bam_bytes(header: str, refs: list[tuple[str, int]], rows: list[tuple]) -> bytes:
    """An alignment file of (qname, flag, rname, pos, mapq, cigar, rnext, pnext, tlen, seq, qual, tags) rows."""
    import re

    out = [b"BAM\1", struct.pack("<i", len(header)), header.encode(), struct.pack("<i", len(refs))]
    number = {n: i for i, (n, _) in enumerate(refs)}
    for n, size in refs:
        out.append(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", size))
    for qname, flag, rname, pos, mapq, cigar, rnext, pnext, tlen, seq, qual, tags in rows:
        ops = [int(n) << 4 | _OPS.index(o) for n, o in re.findall(r"(\d+)([MIDNSHP=XB])", cigar)]
        seq = "" if seq == "*" else seq
        code = [_BASES.index(c) if c in _BASES else 15 for c in seq.lower()] + [0] * (len(seq) % 2)
        packed = bytes(a << 4 | b for a, b in zip(code[::2], code[1::2]))
        q = b"\xff" * len(seq) if qual == "*" else bytes(ord(c) - 33 for c in qual)
        aux = b""
        for k, v in tags:
            kind, body = v.split(":", 1)
            if kind == "i":
                aux += k.encode() + b"i" + struct.pack("<i", int(body))
            elif kind == "f":
                aux += k.encode() + b"f" + struct.pack("<f", float(body))
            elif kind == "A":
                aux += k.encode() + b"A" + body.encode()
            elif kind in "ZH":
                aux += k.encode() + kind.encode() + body.encode() + b"\0"
            else:
                sub, *vals = body.split(",")
                vals = [float(x) if sub == "f" else int(x) for x in vals]
                aux += k.encode() + b"B" + sub.encode() + struct.pack(f"<i{len(vals)}{_TAG[sub]}", len(vals), *vals)
        mate = number.get(rname, -1) if rnext == "=" else number.get(rnext, -1)
        body = struct.pack("<iiBBHHHiiii", number.get(rname, -1), pos - 1, len(qname) + 1, mapq, 0, len(ops), flag, len(seq), mate, pnext - 1, tlen)
        body += qname.encode() + b"\0" + struct.pack(f"<{len(ops)}I", *ops) + packed + q + aux
        out.append(struct.pack("<i", len(body)) + body)
    return compress_blocks(b"".join(out))


#: The fixed header of a block up to its size field.
BLOCK_HEAD = b"\x1f\x8b\x08\4\0\0\0\0\0\xff\6\0BC\2\0"


def _block_data(part: bytes) -> bytes:
    """The data of a block from which BLOCK_HEAD was cut."""
    if not part:
        return b""
    size = struct.unpack_from("<H", part)[0] + 1 - len(BLOCK_HEAD)
    if size != len(part):
        raise ValueError(f"a block of {len(part) + 16} bytes says that it has {size + 16}")
    data = zlib.decompress(part[2:-8], -15)
    if zlib.crc32(data) != struct.unpack_from("<I", part, len(part) - 8)[0]:
        raise ValueError("a block is damaged")
    return data


def _bam_head(data: bytes) -> tuple[int, list[str]] | None:
    """Where records begin, and the references' names."""
    try:
        if data[:4] != b"BAM\1":
            if len(data) >= 4:
                raise ValueError("not an alignment file")
            return None
        at = 8 + struct.unpack_from("<i", data, 4)[0]
        (n,) = struct.unpack_from("<i", data, at)
        at, names = at + 4, []
        for _ in range(n):
            (size,) = struct.unpack_from("<i", data, at)
            names.append(data[at + 4 : at + 3 + size].decode())
            at += 8 + size
        return (at, names) if at <= len(data) else None
    except struct.error:
        return None


def _bam_follow(data: bytes, at: int, guess: bool, refs: int | None = None) -> int | None:
    if at + 4 > len(data):
        return None
    (size,) = struct.unpack_from("<i", data, at)
    if guess:
        if not 32 < size < 1 << 28:
            return -1
        if at + 36 > len(data):
            return None
        rid, pos, lname, _, _, ncig, _, lseq, mrid, mpos, _ = struct.unpack_from("<iiBBHHHiiii", data, at + 4)
        if not (-1 <= rid and -1 <= mrid and pos >= -1 and mpos >= -1 and lname and lseq >= 0 and 32 + lname + 4 * ncig + (lseq + 1) // 2 + lseq <= size) or refs is not None and max(rid, mrid) >= refs:
            return -1
        name = data[at + 36 : at + 36 + lname]
        if len(name) == lname and (name[-1] or not all(33 <= c <= 126 for c in name[:-1])):
            return -1
    end = at + 4 + size
    return end if end <= len(data) else None


def _bam_row(raw: bytes, names: list[str]) -> tuple:
    ref = lambda i: names[i] if i >= 0 else "*"
    rid, pos, lname, mapq, _, ncig, flag, lseq, mrid, mpos, tlen = struct.unpack_from("<iiBBHHHiiii", raw)
    at = 32 + lname
    cigar = "".join(f"{c >> 4}{_OPS[c & 15]}" for c in struct.unpack_from(f"<{ncig}I", raw, at)) or "*"
    at += 4 * ncig
    half = np.frombuffer(raw, np.uint8, (lseq + 1) // 2, at)
    seq = _LETTERS[np.stack([half >> 4, half & 15], 1).reshape(-1)[:lseq]].tobytes().decode()
    at += (lseq + 1) // 2
    q = np.frombuffer(raw, np.uint8, lseq, at)
    qual = "*" if not lseq or q[0] == 255 else (q + 33).astype(np.uint8).tobytes().decode("latin-1")
    name = raw[32 : 32 + lname - 1].decode()
    return name, flag, ref(rid), pos + 1, mapq, cigar, "=" if mrid == rid and mrid >= 0 else ref(mrid), mpos + 1, tlen, seq or "*", qual, _tags(raw[at + lseq :])


def bam_references(spark: SparkSession, path: str) -> list[str]:
    """Names of the references of the (first) file: its first blocks are read, as many as its header takes."""
    rows, most = stretches(spark, path, BLOCK_HEAD).filter("split = 0").orderBy("file").limit(1).collect(), 8
    if not rows:
        return []
    first = stretches(spark, path, BLOCK_HEAD).filter((F.col("split") == 0) & (F.col("file") == rows[0].file))
    while True:
        parts = [bytes(r.value) for r in first.limit(most).collect()]
        got = _bam_head(b"".join(_block_data(p) for p in parts))
        if got:
            return got[1]
        if len(parts) < most:
            raise ValueError(f"{path}: the header has no end")
        most *= 8


def read_bam(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The columns of a text alignment table, and file. Files read together have the same references."""
    names = bam_references(spark, path)
    begin = lambda data: got[0] if (got := _bam_head(data)) else None
    fmt = Format(BLOCK_HEAD, _block_data, begin, lambda d, at, guess: _bam_follow(d, at, guess, len(names)), lambda d, a, b: _bam_row(d[a + 4 : b], names), BAM_ROW.split(", ", 1)[1])
    return read_chained(spark, path, fmt)


# --- overlaps and read databases -----------------------------------------------------------

LAS_ROW = "file string, a long, b long, reverse boolean, as_ long, ae long, bs long, be long, diffs long, spacing int, trace array<int>"
_OVERLAP = struct.Struct("<iiiiiiIii")  # tlen diffs abpos bbpos aepos bepos flags aread bread
SMALL_TRACE = 125  # spacing up to which a trace has a byte a number


def _las_follow(data: bytes, at: int, guess: bool, width: int) -> int | None:
    if at + 40 > len(data):
        return None
    tlen, diffs, ab, bb, ae, be, flags, a, b = _OVERLAP.unpack_from(data, at)
    if tlen < 0 or tlen % 2 or not (0 <= ab <= ae and 0 <= bb <= be and a >= 0 and b >= 0 and diffs >= 0 and flags < 64):
        if guess:
            return -1
        raise ValueError(f"an overlap of reads {a + 1} and {b + 1} does not add up")
    end = at + 40 + tlen * width
    if guess and end <= len(data) and int(np.frombuffer(data, f"<u{width}", tlen, at + 40)[1::2].sum(dtype=np.int64)) != be - bb:
        return -1
    return end if end <= len(data) else None


def _las_row(data: bytes, at: int, spacing: int, width: int) -> tuple:
    """Reads are numbered from 1. Records are 40 bytes and a trace of (differences, advance) pairs."""
    tlen, diffs, ab, bb, ae, be, flags, a, b = _OVERLAP.unpack_from(data, at)
    trace = np.frombuffer(data, f"<u{width}", tlen, at + 40).tolist()
    if sum(trace[1::2]) != be - bb:
        raise ValueError(f"the trace of an overlap of reads {a + 1} and {b + 1} does not add up")
    return a + 1, b + 1, bool(flags & 1), ab, ae, bb, be, diffs, spacing, trace


def las_bytes(spacing: int, rows: list[tuple]) -> bytes:
    """A file of (a, b, reverse, as, ae, bs, be, diffs, trace) overlaps, reads numbered from 1."""
    out, width = [struct.pack("<qi", len(rows), spacing)], 1 if spacing <= SMALL_TRACE else 2
    for a, b, rev, ab, ae, bb, be, diffs, trace in rows:
        out.append(_OVERLAP.pack(len(trace), diffs, ab, bb, ae, be, int(rev), a - 1, b - 1) + b"\0\0\0\0" + np.array(trace, f"<u{width}").tobytes())
    return b"".join(out)


_ZERO = b"\0"  # one byte, so that no split can see a run of them otherwise than the others


def read_las(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Overlaps of files of one spacing, which the first file says; a file is cut wherever it has a zero."""
    head, most = b"", 16
    while len(head) < 12:
        rows = stretches(spark, path, _ZERO).filter("split = 0").orderBy("file").limit(most).collect()
        head = b"".join(bytes(r.value) + _ZERO for r in rows)
        if len(rows) < most:
            break
        most *= 4
    if len(head) < 12:
        return spark.createDataFrame([], LAS_ROW)
    (spacing,) = struct.unpack_from("<i", head, 8)
    width = 1 if spacing <= SMALL_TRACE else 2
    follow = lambda d, at, guess: _las_follow(d, at, guess, width)
    fmt = Format(_ZERO, lambda part: part + _ZERO, lambda d: 12 if len(d) >= 12 else None, follow, lambda d, a, b: _las_row(d, a, spacing, width), LAS_ROW.split(", ", 1)[1], _ZERO)
    return read_chained(spark, path, fmt)


DB_READ = struct.Struct("<iiiiqqii")  # origin, rlen, fpulse, -, boff, coff, flags, -
CSS, BEST, QV = 0x400, 0x800, 0x3FF


def db_reads(index, bases, header: int = 112):
    """(ord, well, rlen, pulse, quality, css, best, seq) of a read database's index and two-bit bases.

    `header` is the size of what comes before the first read in the index.
    """
    from strandframe.sources.codec import unpack_dna

    for i in range((len(index) - header) // DB_READ.size):
        origin, rlen, pulse, _, boff, coff, flags, _ = DB_READ.unpack_from(index, header + i * DB_READ.size)
        seq = unpack_dna(bytes(bases[boff : boff + (rlen + 3) // 4]), rlen).decode()
        yield i, origin, rlen, pulse, flags & QV, bool(flags & CSS), bool(flags & BEST), coff, seq


def db_trimmed(rows, cutoff: int, every: bool = False):
    """Those that a trim keeps: the best of each well, or every read, of at least `cutoff` letters."""
    return [r for r in rows if (every or r[6]) and r[2] >= cutoff]


def snr_of(coff):
    """Four signal-to-noise values, packed in 16 bits each, A's the highest."""
    shift = lambda k: F.shiftright(coff, k).bitwiseAND(F.lit(0xFFFF)) / 100
    return F.array(*[shift(k) for k in (48, 32, 16, 0)])
