"""Packing by concatenating and cutting.

One pass turns every text into ids and notes, for each document, the ids before it in its own
partition. Prefix sums over the partitions' totals turn that into an offset in one global
stream, which is cut into windows of a fixed length. A document that crosses a window's end
gives a boundary record on either side: one piece for each window it touches. Only the last
window can be short, so padding is under one window for the whole corpus.

Null and empty texts are documents of the end-of-document id alone. Repeated rows are packed
as often as they occur. Order is that of the input's partitions. An empty table gives no pieces.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.llm.bpe import codec, default_path
from strandframe.llm.common import durable, small

#: A prefix table of one row a partition is broadcast up to this many rows, joined otherwise.
BROADCAST_ROWS = 4_000_000


def token_stream(docs: DataFrame, key: str, text: str, path: str | None = None, end_id: int = 1) -> DataFrame:
    """One row a document: key, ids (little-endian 32-bit), n, and its place: part, before."""
    path = path or default_path()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        bpe, part, before = codec(path, own=False), TaskContext.get().partitionId(), 0
        for batch in small(batches):
            ids = [bpe.id_bytes(t) + end for t in batch.column(1).to_pylist()]
            n = np.array([len(x) // 4 for x in ids], np.int64)
            starts = before + np.cumsum(n) - n
            before += int(n.sum())
            parts = pa.array(np.full(len(ids), part, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array(n), parts, pa.array(starts)], ["key", "ids", "n", "part", "before"])

    kind = docs.schema[key].dataType.simpleString()
    cols = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return durable(cols.mapInArrow(run, f"key {kind}, ids binary, n long, part long, before long"))


def concatenate_and_cut(stream: DataFrame, window: int = 2048) -> DataFrame:
    """Pieces of a token_stream: key, doc_tokens, start, length, sequence_id, offset, ids (binary)."""
    totals = stream.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()  # a row a partition
    bases, base = [], 0
    for part, n in totals:
        bases.append((part, base))
        base += n
    prefix = stream.sparkSession.createDataFrame(bases, "part long, base long")
    if len(bases) <= BROADCAST_ROWS:
        prefix = F.broadcast(prefix)
    placed = stream.join(prefix, "part").withColumn("at", F.col("base") + F.col("before"))
    touched = F.sequence(F.expr(f"at div {window}"), F.expr(f"(at + n - 1) div {window}"))
    cut = placed.select("key", "ids", "n", "at", F.explode(touched).alias("sequence_id"))
    cut = cut.withColumn("start", F.greatest(F.col("sequence_id") * window - F.col("at"), F.lit(0)))
    cut = cut.withColumn("length", F.least((F.col("sequence_id") + 1) * window - F.col("at"), F.col("n")) - F.col("start"))
    return cut.select(
        "key",
        F.col("n").alias("doc_tokens"),
        "start",
        "length",
        "sequence_id",
        (F.col("at") + F.col("start") - F.col("sequence_id") * window).alias("offset"),
        F.expr("substring(ids, cast(start * 4 + 1 as int), cast(length * 4 as int))").alias("ids"),
    )


def pack(docs: DataFrame, key: str, text: str, path: str | None = None, window: int = 2048) -> DataFrame:
    return concatenate_and_cut(token_stream(docs, key, text, path), window)


def digest(pieces: DataFrame) -> DataFrame:
    """The columns of query op10 from pieces of pack()."""
    return pieces.select(F.col("key").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
