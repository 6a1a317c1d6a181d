"""Tagged-line files in binary form: index, scan by ranges of objects, and write.

A file is a text header up to `$`, coded data lines, an empty line, and a footer of counts, codes
of list bytes, and the places of objects and groups. `scan` reads a range of objects a task
through a Python data source, so one file is read by many tasks; its paths must be readable by the
executors as files (a shared mount). `scan_any` reads through Spark's own binary source from any
store, one task a file, for files under 2 GB. Both give lines in the text form of `tagged`, so all its
tables work on them. `write_binary` writes lines from any table as the parts of one file, each whole in itself, to any
store; `scan_any(whole=True)` reads such parts as one file.
"""

from __future__ import annotations

import io
import itertools
import struct
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from strandframe.sources import codec
from strandframe.sources import schema as S
from strandframe.sources.tagged import Header, header_lines, parse_header

#: The codes of line types are 128 and twice a letter's place, or for these signs four times it.
_SIGNS = {";": 52, "&": 53, "*": 54, "/": 55, ".": 56}
OBJECTS_A_TASK = 100_000


def type_byte(code: str) -> int:
    if code in _SIGNS:
        return 0x80 | _SIGNS[code] << 2
    place = ord(code) - ord("A") if code.isupper() else 26 + ord(code) - ord("a")
    return 0x80 | place << 1


@dataclass
class Layout:
    """What header and footer say: the type, where data lies, objects' places, groups' first objects, codes."""

    head: Header
    start: int
    end: int
    objects: list[int] = field(default_factory=list)
    groups: list[int] = field(default_factory=list)
    codes: dict[str, codec.Huffman] = field(default_factory=dict)

    def type_of(self) -> dict[int, str]:
        out = {type_byte(c): c for c in (*self.head.type.lines, "/")}
        return out | {b + 1: c for b, c in out.items()}


def _line(raw, at: int) -> tuple[str, int]:
    end = raw.find(b"\n", at)
    return bytes(raw[at:end]).decode("latin-1"), end + 1


def layout(f, types: dict[str, S.FileType] | None = None) -> Layout:
    """Read header and footer of a seekable binary file object."""
    rows, start = [], 0
    while True:
        row = f.readline()
        start += len(row)
        if not row:
            raise ValueError("not a binary file: its header has no end")
        text = row.decode("utf-8").rstrip("\n")
        if text.startswith("$"):
            if text != "$ 0":
                raise ValueError("the file has the other byte order")
            break
        rows.append(text)
    f.seek(-8, io.SEEK_END)
    (foot,) = struct.unpack("<q", f.read(8))
    f.seek(foot)
    raw, at, counts = f.read(), 0, []
    out = Layout(parse_header(rows, types), start, foot - 1)
    while raw[at : at + 1] != b"^":
        if raw[at] < 0x80:
            row, at = _line(raw, at)
            counts.append(row)
        elif raw[at] & 0xFE == type_byte(";"):
            code = chr(raw[at + 1])
            n, at = codec.get_int(raw, at + 2)
            out.codes[code] = codec.Huffman.loads(raw[at : at + n])
            at += n
        else:
            which = raw[at] & 0xFE
            n, at = codec.get_int(raw, at + 1)
            got = []
            if n:
                first, at = codec.get_int(raw, at)
                got = [first]
                if n > 1:
                    width = raw[at]
                    got = codec.get_ints(first, width, raw[at + 1 : at + 1 + (n - 1) * width])
                    at += 1 + (n - 1) * width
            if which == type_byte("&"):
                out.objects = got
            else:
                out.groups = got
    for row in counts:
        p = row.split(" ")
        out.head.counts[(p[0], p[1]) if p[0] != "%" else ("g" + p[2], p[3])] = int(p[-1])
    return out


def _text(v: bytes) -> str:
    return v.decode("utf-8", "replace")


def decode_lines(raw, lay: Layout, obj: int = -1, group: int = -1):
    """(line_type, obj_ord, group_ord, value in text form) of the coded lines in `raw`, from given ordinals on.

    A group's first field, its size, is taken from the index.
    """
    kind, names = lay.head.type, lay.type_of()
    at, end, pending = 0, len(raw), None
    while at < end and raw[at] & 0x80:
        x, at = raw[at], at + 1
        code = names.get(x)
        if code is None:
            raise ValueError(f"an unknown line type: {x}")
        fields = ("STRING",) if code == "/" else kind.lines[code].fields
        out, n = [], 0
        for f in fields:
            if f == "REAL":
                out.append(repr(struct.unpack_from("<d", raw, at)[0]))
                at += 8
            elif f == "CHAR":
                out.append(chr(raw[at]))
                at += 1
            else:
                v, at = codec.get_int(raw, at)
                out.append(str(v))
                n = v if f in S.LISTS else n
        place = next((i for i, f in enumerate(fields) if f in S.LISTS), None)
        if place is not None and n:
            f = fields[place]
            if f == "STRING_LIST":
                begin = at
                for _ in range(n):
                    stop = raw.index(b" ", at + 1)
                    at = stop + 1 + int(raw[at + 1 : stop])
                text = _text(bytes(raw[begin + 1 : at]))
            elif f == "INT_LIST":
                first, at = codec.get_int(raw, at)
                got = [first]
                if n > 1:
                    width, at = raw[at], at + 1
                    if x & 1:
                        bits, at = codec.get_int(raw, at)
                        body = lay.codes[code].decode(bits, raw[at : at + (bits + 7) // 8])
                        at += (bits + 7) // 8
                    else:
                        body, at = bytes(raw[at : at + (n - 1) * width]), at + (n - 1) * width
                    got = codec.get_ints(first, width, body)
                text = " ".join(map(str, got))
            else:
                size = 8 * n if f == "REAL_LIST" else n
                if x & 1:
                    bits, at = codec.get_int(raw, at)
                    body, at = raw[at : at + (bits + 7) // 8], at + (bits + 7) // 8
                    body = codec.unpack_dna(bytes(body), n) if f == "DNA" else lay.codes[code].decode(bits, body)
                else:
                    body, at = bytes(raw[at : at + size]), at + size
                text = " ".join(map(repr, struct.unpack(f"<{n}d", body))) if f == "REAL_LIST" else _text(body)
            out[place] = f"{out[place]} {text}"
        if code == "/":
            if pending:
                pending = (*pending[:3], f"{pending[3]} {out[0].split(' ', 1)[1]}")
            continue
        if pending:
            yield pending
        obj += code == kind.object
        if code == kind.group:
            group += 1
            if fields[:1] == ("INT",) and group + 1 < len(lay.groups):
                out[0] = str(lay.groups[group + 1] - lay.groups[group])
        ahead = code in S.FORWARD.get(kind.primary, ())
        pending = (code, obj + ahead, group if group >= 0 else None, " ".join([code, *out]))
    if pending:
        yield pending


_LINES = "file string, line_type string, obj_ord long, group_ord long, value string"


@dataclass
class _Range(InputPartition):
    path: str
    first: int  # the first object, -1 for what lies before it
    last: int


class ObjectRanges(DataSource):
    """Format "strandframe_binary": options path, and objects (per task) or first and last."""

    @classmethod
    def name(cls):
        return "strandframe_binary"

    def schema(self):
        return _LINES

    def reader(self, schema):
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.paths = options["path"].split(",")
        self.step = int(options.get("objects", OBJECTS_A_TASK))
        self.first, self.last = int(options.get("first", -1)), int(options.get("last", 1 << 62))

    def partitions(self):
        out = []
        for p in self.paths:
            with open(p, "rb") as f:
                n = len(layout(f).objects)
            if self.first < 0:
                out.append(_Range(p, -1, min(self.step, n, self.last)))
            lo, hi = (min(self.step, n, self.last) if self.first < 0 else self.first), min(n, self.last)
            out += [_Range(p, a, min(hi, a + self.step)) for a in range(lo, hi, self.step)]
        return out

    def read(self, partition):
        import bisect

        with open(partition.path, "rb") as f:
            lay = layout(f)
            a, b = partition.first, partition.last
            n = len(lay.objects)
            begin = lay.start if a < 0 else lay.objects[a]
            end = lay.objects[b] if b < n else lay.end
            # pair marks and groups before the next object belong to it
            group = -1 if a < 0 else bisect.bisect_right(lay.groups[:-1], a) - 1
            f.seek(begin)
            raw = f.read(end - begin)
            before = [] if a <= 0 else self._ahead(f, lay, a)
        for code, obj, grp, value in [*before, *decode_lines(raw, lay, max(a, 0) - 1, group)]:
            if code in S.FORWARD.get(lay.head.type.primary, ()) and obj >= b and b < n:
                continue  # the next task has it
            if code == lay.head.type.group and b < n and obj + 1 >= b:
                continue
            yield partition.path, code, obj, grp, value

    @staticmethod
    def _ahead(f, lay: Layout, a: int):
        """The lines after the object before that belong to object a: its pair mark, and a group that begins with it."""
        f.seek(lay.objects[a - 1])
        raw = f.read(lay.objects[a] - lay.objects[a - 1])
        import bisect

        group = bisect.bisect_right(lay.groups[:-1], a - 1) - 1
        kind = lay.head.type
        return [x for x in decode_lines(raw, lay, a - 2, group) if x[1] == a and x[0] in S.FORWARD.get(kind.primary, ()) or x[0] == kind.group]


def scan(spark: SparkSession, path: str, first: int | None = None, last: int | None = None, objects: int = OBJECTS_A_TASK) -> DataFrame:
    """The line table of a binary file, or of its objects first to last without it, read by the index."""
    spark.dataSource.register(ObjectRanges)
    reader = spark.read.format("strandframe_binary").option("objects", objects)
    if first is not None:
        reader = reader.option("first", first)
    if last is not None:
        reader = reader.option("last", last)
    return reader.load(path)


def scan_any(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """The line table of binary files under 2 GB in any store; with `whole` they are the parts, by name, of one.

    Parts' ordinals go on where the part before ended, by a table of one row a part.
    """

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = memoryview(content.as_buffer()).cast("B")
                lay = layout(io.BytesIO(raw))
                rows, size = [], 0
                for n, r in enumerate(decode_lines(bytes(raw[lay.start : lay.end]), lay)):
                    rows.append((name, *r, n))
                    size += len(r[3])
                    if size > 4 << 20:
                        yield _rows(rows)
                        rows, size = [], 0
                yield _rows(rows)

    # a batch of one file: contents are large
    files = spark.read.format("binaryFile").load(path).filter("length > 0").select("path", "content")
    out = files.repartition(max(1, files.select("path").count())).mapInArrow(run, _LINES + ", line_no long")
    if not whole:
        return out
    last = lambda c: F.coalesce(F.max(c), F.lit(-1)) + 1
    before = lambda c: F.coalesce(F.sum(c).over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # the first object of a part goes on with the group of the part before
    base = out.groupBy("file").agg(last("obj_ord").alias("o"), last("group_ord").alias("g"), F.count("*").alias("n")).select("file", before("o").alias("o"), before("g").alias("g"), before("n").alias("n"))
    joined = out.join(base, "file")
    group = F.coalesce(F.col("group_ord") + F.col("g"), F.when(F.col("g") > 0, F.col("g") - 1))
    return joined.select(F.lit(path).alias("file"), "line_type", (F.col("obj_ord") + F.col("o")).alias("obj_ord"), group.alias("group_ord"), "value", (F.col("line_no") + F.col("n")).alias("line_no"))


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * 6
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["file", "line_type", "obj_ord", "group_ord", "value", "line_no"])


# --- write ---------------------------------------------------------------------------------


class Encoder:
    """Codes lines of one part; `places` has where objects begin, `group_at` before which object groups do."""

    def __init__(self, kind: S.FileType, codes: dict[str, codec.Huffman] | None = None):
        self.kind, self.codes = kind, codes or {}
        self.out, self.size, self.places, self.group_at = [], 0, [], []

    def _add(self, b: bytes) -> None:
        self.out.append(b)
        self.size += len(b)

    def line(self, code: str, values: list) -> None:
        fields = self.kind.lines[code].fields
        place = self.kind.lines[code].list_at
        body, packed = b"", False
        if place is not None and len(values[place]):
            v, f = values[place], fields[place]
            if f == "DNA":
                raw = v.encode()
                body, packed = codec.put_int(2 * len(raw)) + codec.pack_dna(raw), True
            elif f == "STRING":
                body = v.encode()
            elif f == "REAL_LIST":
                body = struct.pack(f"<{len(v)}d", *v)
            elif f == "STRING_LIST":
                body = b"".join(b" %d %s" % (len(s.encode()), s.encode()) for s in v)
            else:
                first, width, diffs = codec.put_ints(v)
                body = first + (bytes([width]) if width else b"")
                if width and code in self.codes:
                    n, raw = self.codes[code].encode(diffs)
                    body, packed = body + codec.put_int(n) + raw, True
                else:
                    body += diffs
            if f in ("STRING", "REAL_LIST") and code in self.codes:
                n, raw = self.codes[code].encode(body)
                body, packed = codec.put_int(n) + raw, True
        if code == self.kind.object:
            self.places.append(self.size)
        if code == self.kind.group:
            self.group_at.append(len(self.places))
        # the mark says how the bytes are to be read, also of an empty list
        self._add(bytes([type_byte(code) | packed]))
        for i, f in enumerate(fields):
            if f == "REAL":
                self._add(struct.pack("<d", values[i]))
            elif f == "CHAR":
                self._add(values[i].encode("latin-1"))
            elif i == place:
                self._add(codec.put_int(len(values[i].encode()) if f in ("STRING", "DNA") else len(values[i])))
            else:
                self._add(codec.put_int(int(values[i])))
        self._add(body)

    def data(self) -> bytes:
        return b"".join(self.out)


def _index(sign: str, values: list[int]) -> bytes:
    first, width, diffs = codec.put_ints(values) if values else (b"", 0, b"")
    return bytes([type_byte(sign)]) + codec.put_int(len(values)) + first + (bytes([width]) + diffs if width else b"")


def stitched(head: Header, found: list, parts: list[tuple[bytes, list[int], list[int]]], codes: dict[str, codec.Huffman] | None = None) -> bytes:
    """One file of the data, places and group starts of several parts: indices are shifted by prefix sums.

    `found` are rows of counts().
    """
    rows = [r for r in header_lines(head, None)]
    top = ("\n".join(rows) + "\n$ 0\n").encode()
    places, groups, at, n, bodies = [], [], len(top), 0, []
    for data, own, starts in parts:
        places += [at + p for p in own]
        groups += [n + g for g in starts]
        at, n = at + len(data), n + len(own)
        bodies.append(data)
    foot = [x for x in header_lines(head, found) if x[0] in "#@+%"]
    tail = ("\n".join(foot) + "\n").encode() if foot else b""
    for code, h in sorted((codes or {}).items()):
        raw = h.dumps()
        tail += bytes([type_byte(";")]) + code.encode() + codec.put_int(len(raw)) + raw
    tail += _index("&", places) + (_index("*", [*groups, n]) if groups else b"")
    return top + b"".join(bodies) + b"\n" + tail + b"^\n" + struct.pack("<q", at + 1)


def text_values(fields: tuple[str, ...], raw: bytes) -> list:
    """The fields of a line in text form, from what follows its letter and a space."""
    out, at = [], 0

    def word() -> bytes:
        nonlocal at
        end = raw.find(b" ", at)
        end = len(raw) if end < 0 else end
        got, at = raw[at:end], end + 1
        return got

    def letters(n: int) -> str:
        nonlocal at
        got, at = raw[at : at + n].decode("utf-8", "surrogateescape"), at + n + 1
        return got

    for f in fields:
        if f in ("STRING", "DNA"):
            out.append(letters(int(word())))
        elif f == "STRING_LIST":
            out.append([letters(int(word())) for _ in range(int(word()))])
        elif f in S.LISTS:
            one = int if f == "INT_LIST" else float
            out.append([one(word()) for _ in range(int(word()))])
        else:
            out.append({"INT": int, "REAL": float}.get(f, bytes.decode)(word()))
    return out


def encoded(head: Header, lines, codes: dict[str, codec.Huffman] | None = None) -> bytes:
    """A binary file of lines in text form, with its counts and index."""
    kind = head.type
    e, per, most, own = Encoder(kind, codes), {}, {}, {}

    def close():
        for c, (n, total) in own.items():
            a = most.setdefault(c, [0, 0])
            most[c] = [max(a[0], n), max(a[1], total)]
        own.clear()

    grouped = False
    for line in lines:
        code = line[:1].decode()
        values = text_values(kind.lines[code].fields, line[2:])
        e.line(code, values)
        place = kind.lines[code].list_at
        v = None if place is None else values[place]
        size = 0 if v is None else sum(len(s.encode()) for s in v) if kind.lines[code].fields[place] == "STRING_LIST" else len(v.encode()) if isinstance(v, str) else len(v)
        n = per.setdefault(code, [0, 0, 0])
        per[code] = [n[0] + 1, max(n[1], size), n[2] + size]
        if code == kind.group:
            close()
            grouped = True
        elif grouped:
            n = own.setdefault(code, [0, 0])
            own[code] = [n[0] + 1, n[1] + size]
    close()
    found = [{"line_type": c, "n": n, "max_len": longest, "total_len": total, "group_max_n": most.get(c, [0])[0], "group_max_len": most.get(c, [0, 0])[1]} for c, (n, longest, total) in per.items()]
    return stitched(head, found, [(e.data(), e.places, e.group_at)], codes)


def line_rows(table: DataFrame, kind: S.FileType) -> DataFrame:
    """obj_ord, k, value of a line table: what write_binary() and tagged.write_text() take, so that either form is turned into the other."""
    place = F.when(F.col("line_type") == F.lit(kind.group or ""), F.col("obj_ord") + 1).otherwise(F.col("obj_ord"))
    return table.select(place.alias("obj_ord"), F.pmod(F.col("line_no"), F.lit(1 << 31)).cast("int").alias("k"), "value")


def write_binary(rows: DataFrame, head: Header, path: str, codes: dict[str, codec.Huffman] | None = None, mode: str = "error", objects: int = OBJECTS_A_TASK) -> None:
    """Write obj_ord, k, value (lines in text form, as of tagged.object_lines()) as the parts of one binary file.

    A part has some `objects` objects, all lines of each, and is a binary file in itself, made by one task
    as one value. Spark's text sink writes it to any store: its last byte, which is a zero as an index
    lies below 2^56, is the sink's line separator.
    """
    n = rows.agg(F.max("obj_ord")).first()[0]
    parts = 1 if n is None else max(1, -(-(n + 1) // objects))
    ordered = rows.repartitionByRange(parts, "obj_ord").sortWithinPartitions("obj_ord", "k").select(F.col("value").cast("binary").alias("value"))

    def run(batches):
        lines = (v for batch in batches for v in batch.column(0).to_pylist())
        first = next(lines, None)
        if first is not None:
            raw = encoded(head, itertools.chain([first], lines), codes)
            yield pa.RecordBatch.from_arrays([pa.array([raw[:-1]], pa.binary())], ["value"])

    ordered.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value")).write.mode(mode).option("lineSep", "\0").text(path)
