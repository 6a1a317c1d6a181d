"""Sharding by histogram sort.

Rows are ordered by a 62-bit key: 40 bits of the text's hash, so that equal texts lie side by
side, then 22 bits of the row's own hash, so that a group of copies that is larger than a shard
can still be cut. The driver refines, for all shard borders at once, the exact bytes below
probe keys; each round is one aggregation whose result has a bounded number of rows. When every
border is within tolerance of its share, or cannot come closer as the keys around it are single
rows, the rows are exchanged once.

Null text has no bytes; each row counts one byte beside its text. Repeated rows each get a slot.
An empty table gives no rows. With fewer rows than shards some shards stay empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandframe.llm.common import durable

PROBES = 256  # candidate borders within the interval of a splitter, each round


def _interval_of(key: Column, intervals: list[tuple[int, int]]) -> Column:
    out = F.lit(None).cast("int")
    for i, (lo, hi) in reversed(list(enumerate(intervals))):
        out = F.when((key >= lo) & (key < hi), i).otherwise(out)
    return out


def _pick(index: Column, values: list[int]) -> Column:
    out = F.lit(values[-1])
    for i in reversed(range(len(values) - 1)):
        out = F.when(index == i, F.lit(values[i])).otherwise(out)
    return out.cast("long")


def splitters(rows: DataFrame, key: str, size: str, shards: int, tolerance: float = 1e-4, top: int = 1 << 62) -> list[int]:
    """`shards - 1` keys; shard i holds keys from border i-1 up to, but without, border i."""
    total = rows.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    want = [total * i / shards for i in range(1, shards)]
    near = tolerance * total / shards
    span = [(0, top, 0, total)] * len(want)  # keys from lo to hi; bytes below lo and below hi
    while True:
        def off(s, w):
            return min(abs(s[2] - w), abs(s[3] - w))

        left = sorted({s[:3] for s, w in zip(span, want) if off(s, w) > near and s[1] - s[0] > 1})
        if not left:
            break
        intervals = [s[:2] for s in left]
        steps = [-(-(hi - lo) // PROBES) for lo, hi in intervals]
        which = rows.select(F.col(key).alias("k"), F.col(size).alias("s"), _interval_of(F.col(key), intervals).alias("i")).filter("i is not null")
        which = which.withColumn("b", F.col("k") - _pick(F.col("i"), [lo for lo, _ in intervals]))
        which = which.withColumn("step", _pick(F.col("i"), steps))
        bins = which.groupBy("i", F.expr("b div step").alias("b")).agg(F.sum("s").alias("s"), F.min("k").alias("lo"), F.max("k").alias("hi")).collect()
        found: dict[tuple[int, int], list] = {}
        for i, _, s, lo, hi in sorted(bins):
            found.setdefault(intervals[i], []).append((lo, hi + 1, s))
        for n, (s, w) in enumerate(zip(span, want)):
            if off(s, w) <= near or s[1] - s[0] <= 1:
                continue
            below = s[2]
            for lo, hi, own in found[s[:2]]:
                if below + own >= w:
                    span[n] = (lo, hi, below, below + own)
                    break
                below += own
            else:
                raise AssertionError("bytes of a border's interval are lost")
    return [lo if w - below <= above - w else hi for (lo, hi, below, above), w in zip(span, want)]


def histogram_shards(df: DataFrame, key: str, text: str, shards: int = 16, tolerance: float = 1e-4, rows_a_bin: int = 50_000, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row a row of `df`: key, size, crc, shard, slot and the columns to carry.

    Sizes of shards differ from an equal share by `tolerance` of it, or by single rows. Slots
    are given within bins of a shard, spread by a hash, so that no task has to number a whole
    shard; a small table of counts offsets each bin.
    """
    t = F.col(text)
    narrow = df.select(
        F.col(key).alias("key"),
        (F.coalesce(F.octet_length(t), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(t.cast("binary")), F.lit(0)).cast("long").alias("crc"),
        F.xxhash64(t).alias("same"),
        F.monotonically_increasing_id().alias("row"),
        *[F.col(c).alias(f"carry_{c}") for c in carry],
    )
    rows = durable(narrow.withColumn("order", F.expr("(shiftrightunsigned(same, 24) << 22) | shiftrightunsigned(xxhash64(key, row), 42)")).drop("same"))
    borders = splitters(rows, "order", "size", shards, tolerance)
    shard = sum([(F.col("order") >= b).cast("int") for b in borders], F.lit(0)) if borders else F.lit(0)
    bins = max(8, -(-rows.count() // (shards * rows_a_bin)))
    binned = rows.withColumn("shard", shard).withColumn("bin", F.pmod(F.xxhash64("row"), F.lit(bins)).cast("int"))
    counts = binned.groupBy("shard", "bin").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("bin")) - F.col("n")
    offsets = counts.select("shard", "bin", before.alias("before"))
    place = F.row_number().over(Window.partitionBy("shard", "bin").orderBy("order", "row")) - 1
    out = binned.withColumn("place", place).join(offsets, ["shard", "bin"])
    return out.select("key", "size", "crc", "shard", (F.col("before") + F.col("place")).alias("slot"), *[F.col(f"carry_{c}").alias(c) for c in carry])


def digest(out: DataFrame) -> DataFrame:
    """The columns of query op9; its law is `bytes`, so that no grown shard is given."""
    return out.select(F.col("key").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
