"""Overlap joins by bins, merging of intervals, and region strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


TASK_ROWS = 500_000  # rows of merge() a task, in the mean
MOST_BINS = 16  # bins of its level that an interval may cover


def _levels(df: DataFrame, shift: int) -> DataFrame:
    """`level`: 0, or so many times three bits coarser that an interval covers at most MOST_BINS bins."""
    level = F.lit(0)
    for n in range(1, (63 - shift) // 3):
        s = shift + 3 * (n - 1)
        level = F.when(F.shiftright("end_", s) - F.shiftright("beg_", s) >= MOST_BINS, n).otherwise(level)
    return df.withColumn("level_", level)


def overlap_join(left: DataFrame, right: DataFrame, on: str, shift: int = 13) -> DataFrame:
    """Pairs of rows of one `on` whose inclusive intervals [beg, end] overlap, as l_* and r_* columns.

    Both sides are exploded to the bins of 2^shift that they cover and joined by equality on
    (on, level, bin). An interval that would cover more than MOST_BINS bins goes to a coarser level,
    of bins eight times as long, and so on: a whole chromosome is a bin or two. Two intervals meet at the coarser of
    their levels; a side is exploded to coarser levels only as far as the other side has such (a pass
    over both gives these few numbers). A pair is kept in the first bin that both cover, so no
    deduplication is needed.
    """

    def leveled(df: DataFrame, side: str) -> DataFrame:
        df = df.select(*[F.col(c).alias(f"{side}_{c}") for c in df.columns])
        b, e = F.col(f"{side}_beg"), F.col(f"{side}_end")
        return _levels(df.filter(b <= e).withColumns({"beg_": b.cast("long"), "end_": e.cast("long")}), shift)

    def binned(df: DataFrame, side: str, others: list[int]) -> DataFrame:
        def bins(n: int) -> Column:
            own = F.transform(F.sequence(F.shiftright("beg_", shift + 3 * n), F.shiftright("end_", shift + 3 * n)), lambda x: F.struct(F.lit(n).alias("level"), x.alias("bin")))
            meets = F.col("level_") == n if n not in others else F.col("level_") <= n
            return F.when(meets, own).otherwise(F.array().cast("array<struct<level:int,bin:bigint>>"))

        every = F.explode(F.concat(*[bins(n) for n in sorted({*others, *levels[side]})]))
        return df.withColumn("bin_", every).select("*", "bin_.*", F.col(f"{side}_{on}").alias("on_")).withColumnsRenamed({"beg_": f"beg_{side}_", "level_": f"level_{side}_"}).drop("end_", "bin_")

    sides = {"l": leveled(left, "l"), "r": leveled(right, "r")}
    levels = {k: [r[0] for r in v.select("level_").distinct().collect()] for k, v in sides.items()}
    both = binned(sides["l"], "l", levels["r"]).join(binned(sides["r"], "r", levels["l"]), ["on_", "level", "bin"])
    met = (F.col("l_beg") <= F.col("r_end")) & (F.col("r_beg") <= F.col("l_end"))
    first = (F.col("level") == F.greatest("level_l_", "level_r_")) & (F.col("bin") == F.expr(f"shiftright(greatest(beg_l_, beg_r_), {shift} + 3 * level)"))
    return both.filter(met & first).drop("bin", "level", "on_", "beg_l_", "beg_r_", "level_l_", "level_r_")


def merge(df: DataFrame, on: str, beg: str = "beg", end: str = "end", shift: int = 16) -> DataFrame:
    """Unions of overlapping or touching intervals of each `on`: on, beg, end, n. An interval without a begin is one by itself.

    Windows run within bins of 2^shift begins of one `on` and leave a row a union of the bin. What goes
    on over a bin's border - the furthest end so far, the union that began last - is a row a bin, joined
    back. Rows are dealt over as many tasks as TASK_ROWS asks for, so that a task's memory does not grow
    with the table.
    """
    key = ["on_", "bin_"]
    rows = df.select(F.struct(F.col(on).alias("on")).alias("on_"), F.coalesce(F.shiftright(F.col(beg).cast("long"), shift), F.lit(1 << 62)).alias("bin_"), F.col(beg).alias("beg_"), F.col(end).alias("end_"))
    total, most = rows.count(), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, -(-total // TASK_ROWS), min(most, -(-10 * total // TASK_ROWS)))
    w = Window.partitionBy(*key).orderBy(F.asc_nulls_last("beg_"), F.asc_nulls_last("end_"))
    sofar = w.rowsBetween(Window.unboundedPreceding, 0)
    before = F.max("end_").over(w.rowsBetween(Window.unboundedPreceding, -1))
    begun = rows.repartition(parts, *key).withColumns({"new_": F.when(before >= F.col("beg_"), 0).otherwise(1), "k_": F.row_number().over(w)})
    # of a union in its bin: its number, its first interval and, in its last row, its furthest end
    begun = begun.withColumns({"u_": F.sum("new_").over(sofar), "first_": F.last(F.when(F.col("new_") == 1, F.struct("beg_", "k_")), True).over(sofar), "last_": F.lead("new_", 1, 1).over(w) == 1})
    begun = begun.withColumn("far_", F.max(F.struct("u_", "end_")).over(sofar))
    local = begun.filter("last_").select(*key, "first_", F.col("far_.end_").alias("end_"), (F.col("k_") - F.col("first_.k_") + 1).alias("n_"))
    across = Window.partitionBy("on_").orderBy("bin_").rowsBetween(Window.unboundedPreceding, -1)
    bins = local.groupBy(*key).agg(F.max("end_").alias("m_"), F.max("first_").alias("first_")).withColumn("carried_", F.max("m_").over(across))
    goes_on = F.coalesce(F.col("carried_") >= F.col("first_.beg_"), F.lit(False))
    bins = bins.withColumn("open_", F.last(F.when(~goes_on, F.col("first_")), True).over(across)).select(*key, "carried_", "open_")
    whole = local.join(bins, key).select("on_", F.when(goes_on, F.col("open_")).otherwise(F.col("first_")).alias("union_"), F.col("first_.beg_").alias("beg_"), "end_", "n_")
    whole = whole.repartition(parts, "on_", "union_").groupBy("on_", "union_").agg(F.min("beg_").alias("beg"), F.max("end_").alias("end"), F.sum("n_").alias("n"))
    return whole.select(F.col("on_.on").alias(on), "beg", "end", "n")


def _number(text: Column) -> Column:
    """A decimal with commas, an exponent or a k, M or G; what is left of a fraction is cut off."""
    plain = F.regexp_replace(text, ",", "")
    base = F.regexp_extract(plain, r"^([0-9.]+(?:[eE][+-]?[0-9]+)?)", 1).try_cast("double")
    unit = F.upper(F.regexp_extract(plain, r"([kKmMgG])$", 1))
    times = F.when(unit == "K", 1e3).when(unit == "M", 1e6).when(unit == "G", 1e9).otherwise(1.0)
    return F.floor(base * times + 1e-6).cast("long")


def parse_region(text: Column) -> Column:
    """struct<chrom, beg, end>: 'c', 'c:b', 'c:b-' and 'c:b-e'; 1-based inclusive, open ends null."""
    m = r"^(.*?)(?::([0-9.,eE+kKmMgG]*)(-([0-9.,eE+kKmMgG]*))?)?$"
    b, e = F.regexp_extract(text, m, 2), F.regexp_extract(text, m, 4)
    return F.struct(F.regexp_extract(text, m, 1).alias("chrom"), F.when(b != "", _number(b)).alias("beg"), F.when(e != "", _number(e)).alias("end"))


def ucsc_bin(beg: Column, end: Column, shift: int = 14, depth: int = 5) -> Column:
    """The smallest bin of the binning scheme that holds [beg, end), 0-based."""
    last = (end - 1).cast("long")
    beg = beg.cast("long")
    out, offset = F.lit(0), ((1 << depth * 3) - 1) // 7
    levels = []
    for level in range(depth, 0, -1):
        s = shift + 3 * (depth - level)
        levels.append((F.shiftright(beg, s) == F.shiftright(last, s), F.lit(offset) + F.shiftright(beg, s)))
        offset -= 1 << (level - 1) * 3
    for same, number in reversed(levels):
        out = F.when(same, number).otherwise(out)
    return out.cast("long")


def bed_row(line: Column) -> Column:
    """struct<chrom, beg, end, name>, inclusive ends, 0-based; a lone name is the whole chromosome."""
    f = F.split(line, "\t")
    return F.struct(
        f[0].alias("chrom"),
        F.coalesce(F.get(f, F.lit(1)).cast("long"), F.lit(0).cast("long")).alias("beg"),
        (F.coalesce(F.get(f, F.lit(2)).cast("long"), F.lit((1 << 31) - 1).cast("long")) - 1).alias("end"),
        F.get(f, F.lit(3)).alias("name"),
    )


def read_bed(spark, path: str) -> DataFrame:
    lines = spark.read.text(path).filter(~F.col("value").startswith("#") & (F.trim("value") != ""))
    return lines.select(bed_row(F.col("value")).alias("r")).select("r.*")
