"""Shared pieces of the corpus operators: tables, durable intermediates, the held-out fold."""

from __future__ import annotations

import contextlib
import functools
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_scope: list[list[str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column) -> Column:
    """crc32 of the id's decimal text, modulo 4; null ids count as the text 'null'."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")), F.lit(4))


def held_out(doc_id: Column) -> Column:
    return fold(doc_id) == 2


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a local one only where that is unset and Spark is local, as in tests."""
    own = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not own:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        own = "file://" + tempfile.mkdtemp(prefix="strandframe-")
        spark.conf.set("spark.checkpoint.dir", own)
    return own.rstrip("/")


def durable(df: DataFrame, lasting: bool = False) -> DataFrame:
    """Write `df` once under the shared folder and return a scan of it.

    Cuts lineage, so that a lost executor costs one re-read instead of a recomputation, and
    fixes values such as monotonically_increasing_id. Files stay for the life of the result, but
    for those of a scratch() block, which go with the block unless they are `lasting`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/strandframe/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if own := _scope[: len(_scope) - lasting]:
        own[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_tables(spark: SparkSession, paths: list[str]) -> None:
    jvm, hadoop = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(hadoop).delete(at, True)
    paths.clear()


@contextlib.contextmanager
def collecting(paths: list[str]):
    """Tables that durable() writes inside are listed in `paths`, to be dropped later."""
    _scope.append(paths)
    try:
        yield
    finally:
        _scope.pop()


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Tables that durable() writes inside are dropped at the end, but for lasting ones, which belong to the block around."""
    own: list[str] = []
    try:
        with collecting(own):
            yield
    finally:
        drop_tables(spark, own)


#: Words of 64 rows that are broadcast at once, some 50 MB.
WORDS = 1 << 20


def keep_rows(df: DataFrame, row: str, kept: DataFrame, words: int = WORDS) -> DataFrame:
    """The rows of a durable() table whose number is in `kept` (one column of the same name), without a shuffle of `df`.

    Numbers are those of monotonically_increasing_id(), dense within each file. They become bits in
    words of 64, which are broadcast; where there are more than `words`, the table is read in
    ranges of numbers, each by itself: files outside a range are skipped by their statistics.
    """
    word = F.expr(f"`{row}` div 64")
    bits = durable(kept.groupBy(word.alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(`{row}` % 64 as int))")).alias("bits")))
    n = bits.count()
    k = max(1, -(-n // words))
    cuts = bits.approxQuantile("word", [i / k for i in range(1, k)], 0.1 / k) if k > 1 else []
    edges = [None, *sorted({int(c) for c in cuts}), None]
    out = []
    for lo, hi in zip(edges, edges[1:]):
        within = lambda c, unit: (F.lit(True) if lo is None else c >= lo * unit) & (F.lit(True) if hi is None else c < hi * unit)  # noqa: B023, E731
        some = df.filter(within(F.col(row), 64)) if k > 1 else df
        own = bits.filter(within(F.col("word"), 1)) if k > 1 else bits
        held = some.withColumn("word", word).join(F.broadcast(own), "word")
        out.append(held.filter(F.expr(f"shiftrightunsigned(bits, cast(`{row}` % 64 as int)) & 1 = 1")).select(*df.columns))
    return functools.reduce(DataFrame.unionByName, out)


def small(batches, rows: int = 500, size: int = 8 << 20):
    """Arrow batches cut to few rows, and fewer where rows are large, so that a worker holds little."""
    for batch in batches:
        most = max(1, min(rows, rows * size // max(batch.nbytes, 1) if batch.num_rows <= rows else batch.num_rows * size // max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, most):
            yield batch.slice(at, most)
