"""Binary files of chained records, read in splits from any store.

Spark's text source cuts a file into splits wherever a separator of the caller's choice lies, and
gives bytes as they are; so a file without lines is read by as many tasks as it has splits, of any
size. A record says where the next one begins, but a split does not say where its first one does:
it is found as the first place from which CHAIN records in a row are plausible. What lies before it,
and what is left at the split's end, goes with the pieces of the neighbouring splits to a second
step, a row or two a split. There a file's pieces must add up to whole records, or the query stops:
a wrong guess cannot pass.

Files are told apart by their paths. Empty files give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

CHAIN = 4  # records in a row that tell a beginning
_BATCH = 2000
_PIECES = "file string, split long, place int, whole boolean, raw binary"


@dataclass
class Format:
    """How a kind of file is cut and walked."""

    separator: bytes
    unpack: Callable[[bytes], bytes]  # a stretch between separators as data
    begin: Callable[[bytes], int | None]  # where records begin in a file's first data; None where there is not enough
    follow: Callable[[bytes, int, bool], int | None]  # the place after the record at one; None: cut off; -1: no record (asked only where told to guess)
    decode: Callable[[bytes, int, int], tuple]
    schema: str  # of decode()'s rows
    ended: bytes = b""  # what unpack() adds to the last stretch of a file that does not end with a separator


def stretches(spark: SparkSession, path: str | list[str], separator: bytes) -> DataFrame:
    """file, split, value (bytes) of what lies between separators, in the file's order within a split."""
    lines = spark.read.option("encoding", "ISO-8859-1").option("lineSep", separator.decode("latin-1")).text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value").cast("binary").alias("value"))


def _splits(batches) -> Iterator[tuple[str, int, Iterator[bytes]]]:
    """Each split's stretches; a task may have several splits, one after another."""
    rows = ((f, s, v) for batch in batches for f, s, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()))
    ahead = next(rows, None)
    while ahead is not None:
        file, split = ahead[:2]

        def own():
            nonlocal ahead
            while ahead is not None and ahead[:2] == (file, split):
                value = ahead[2]
                ahead = next(rows, None)
                yield value

        yield file, split, own()


def _first(fmt: Format, data: bytes) -> int | None:
    """The first place from which records follow each other."""
    for at in range(len(data)):
        place, n = at, 0
        while n < CHAIN and place is not None and 0 <= place < len(data):
            place = fmt.follow(data, place, True)
            n += 1
        # a chain that the data's end cuts off tells enough only after a whole record
        if place != -1 and (n >= CHAIN or place is not None or n > 2):
            return at
    return None


def _chunks(fmt: Format, parts: Iterator[bytes], size: int = 1 << 18) -> Iterator[bytes]:
    """The stretches' data, joined to chunks."""
    own, n = [], 0
    for part in parts:
        own.append(fmt.unpack(part))
        n += len(own[-1])
        if n >= size:
            yield b"".join(own)
            own, n = [], 0
    yield b"".join(own)


def _walk(fmt: Format, split: int, parts: Iterator[bytes], window: int = 1 << 20) -> Iterator[tuple[str, bytes, int, int]]:
    """('head', data, begin, end), then 'record' of each whole one, and 'tail' of one split."""
    data, at, begun = b"", 0, False
    for part in _chunks(fmt, parts):
        data, at = data[at:] + part, 0
        if not begun:
            if split and len(data) < window:
                continue
            first = fmt.begin(data) if not split else _first(fmt, data)
            if first is None:
                window = 2 * len(data)
                continue
            begun = True
            if split:
                yield "head", data, 0, first
            at = first
        while (end := fmt.follow(data, at, False)) is not None and end <= len(data) and end > at:
            yield "record", data, at, end
            at = end
    if not begun and split and (first := _first(fmt, data)) is not None:
        yield "head", data, 0, first
        at, begun = first, True
        while (end := fmt.follow(data, at, False)) is not None and end <= len(data) and end > at:
            yield "record", data, at, end
            at = end
    # a split without any beginning lies within one record
    yield ("tail" if begun else "all"), data, at, len(data)


def _batch(rows: list[tuple], names: list[str], kinds) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)


def read_chained(spark: SparkSession, path: str | list[str], fmt: Format) -> DataFrame:
    """file and decode()'s columns, one row a record. A file is walked by all tasks that have a split of it."""
    found = stretches(spark, path, fmt.separator)
    schema = f"file string, {fmt.schema}"
    struct = StructType.fromDDL(schema)
    names, arrow = struct.names, [to_arrow_type(f.dataType) for f in struct.fields]

    def records(batches):
        rows = []
        for file, split, parts in _splits(batches):
            for kind, data, a, b in _walk(fmt, split, parts):
                if kind == "record":
                    rows.append((file, *fmt.decode(data, a, b)))
                    if len(rows) >= _BATCH:
                        yield _batch(rows, names, arrow)
                        rows = []
        yield _batch(rows, names, arrow)

    def pieces(batches):
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.binary()]
        for file, split, parts in _splits(batches):
            rows = [(file, split, {"head": 0, "all": 0, "tail": 1}[kind], kind == "all", bytes(data[a:b])) for kind, data, a, b in _walk(fmt, split, parts) if kind != "record"]
            yield _batch(rows, ["file", "split", "place", "whole", "raw"], kinds)

    def stitch(table: pa.Table) -> pa.Table:
        file = table["file"][0].as_py()
        rows, data = [], b""
        ends = [(p, raw) for _, p, raw in sorted(zip(table["split"].to_pylist(), table["place"].to_pylist(), table["raw"].to_pylist()), key=lambda r: r[:2])]
        for n, (place, raw) in enumerate(ends):
            data += raw
            if n + 1 < len(ends) and ends[n + 1][0] == 0:
                continue  # the record goes on in the next split
            at = 0
            while at < len(data):
                end = fmt.follow(data, at, False)
                if end is None and n + 1 == len(ends) and fmt.ended and data[at:] == fmt.ended:
                    break
                if end is None or end <= at or end > len(data):
                    raise ValueError(f"{file}: its splits do not add up to whole records")
                rows.append((file, *fmt.decode(data, at, end)))
                at = end
            data = b""
        return pa.Table.from_batches([_batch(rows, names, arrow)])

    cut = found.mapInArrow(pieces, _PIECES).groupBy("file").applyInArrow(stitch, schema)
    return found.mapInArrow(records, schema).unionByName(cut)
