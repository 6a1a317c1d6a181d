"""Running and neighbouring values over one global order, without a one-task window.

A numeric leading key is cut at approximate quantiles into slices, which one task each can hold.
Where one value of it fills more than a slice, the whole order is cut at sampled rows instead, so
that a hot value spans slices. Windows run within slices; what crosses a border is a table with
one row a slice, which is small by construction and broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


SAMPLED = 50  # rows a slice from which borders are chosen; a border may be any tuple, so chance moves no result
SLICE_ROWS = 1_000_000  # of a slice, in the mean: there are as many slices as that takes, and one a shuffle partition at least
GRID = 1000  # quantiles of the first pass; more slices than that take another


def _below(borders: list[Column], test) -> Column:
    """How many of the ascending borders are below a value: first by stretches of them, then within one.

    `test` says whether a border is below. Some 2 sqrt(n) comparisons, by arrays that are part of the plan.
    """
    step = max(1, round(len(borders) ** 0.5))
    parts = [borders[i : i + step] for i in range(0, len(borders), step)]
    if len(parts) < 2:
        return F.size(F.filter(F.array(*borders), test)) if borders else F.lit(0)
    whole = F.size(F.filter(F.array(*[p[-1] for p in parts]), test))
    within = F.coalesce(F.size(F.filter(F.get(F.array(*[F.array(*p) for p in parts]), whole), test)), F.lit(0))
    return whole * step + F.when(whole < len(parts), within).otherwise(0) - F.when(whole == len(parts), len(parts) * step - len(borders)).otherwise(0)


def _between(df: DataFrame, order: list[str], n: int, rows: int) -> Column:
    """The number of borders below a row, of n - 1 tuples of the order's columns; strings are cut to 64 letters."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    short = lambda c: F.substring(c, 1, 64).alias(c) if kinds[c].simpleString() == "string" else F.col(c)
    some = df.select(*order).sample(min(1.0, 1.2 * SAMPLED * n / max(rows, 1)), 17).select(*map(short, order)).orderBy(*order).limit(2 * SAMPLED * n).collect()
    borders = [some[i * len(some) // n] for i in range(1, n)] if some else []
    tuples = [F.struct(*[F.lit(v).cast(kinds[c]).alias(c) for c, v in zip(order, b)]) for b in borders]
    own = F.struct(*[F.col(c).alias(c) for c in order])
    return _below(tuples, lambda b: b < own)


def _quantiles(df: DataFrame, lead: Column, n: int) -> tuple[int, list[float]]:
    rows, cuts = df.agg(F.count("*"), F.percentile_approx(lead.cast("double"), [i / n for i in range(1, n)] or [0.5], 10 * max(n, 1000))).first()
    return rows, sorted(float(c) for c in cuts or [])


class Ordered:
    """`df` with a slice column; `order` must tell all rows apart, its first key must be `lead`."""

    def __init__(self, df: DataFrame, lead: Column, order: list[str], slices: int | None = None):
        rows, grid = _quantiles(df, lead, slices or GRID)
        n = slices or max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // SLICE_ROWS))
        if n > GRID:
            rows, grid = _quantiles(df, lead, n)
        at = [grid[i * (len(grid) + 1) // n - 1] for i in range(1, n)] if grid and n <= len(grid) + 1 else []
        if len(set(at)) < len(at):
            number = _between(df, order, n, rows)
        else:
            number = _below([F.lit(c) for c in at], lambda c: c < lead.cast("double"))
        self.df = df.withColumn("_slice", F.coalesce(number, F.lit(-1)))
        self.order = order
        self.window = Window.partitionBy("_slice").orderBy(*order)
        self._across = Window.orderBy("_slice")  # one row a slice

    def _with(self, df: DataFrame) -> Ordered:
        new = object.__new__(Ordered)
        new.df, new.order, new.window, new._across = df, self.order, self.window, self._across
        return new

    def running_sum(self, value: Column, name: str) -> Ordered:
        """Sum of `value` over all rows up to this one."""
        per = self.df.groupBy("_slice").agg(F.sum(value).alias("_n"))
        base = per.select("_slice", (F.sum("_n").over(self._across) - F.col("_n")).alias("_base"))
        local = F.sum(value).over(self.window.rowsBetween(Window.unboundedPreceding, 0))
        out = self.df.withColumn("_local", local).join(F.broadcast(base), "_slice")
        return self._with(out.withColumn(name, F.coalesce(F.col("_base"), F.lit(0)) + F.col("_local")).drop("_local", "_base"))

    def ordinal(self, name: str = "obj_ord") -> Ordered:
        """Place in the order, from 0."""
        numbered = self.running_sum(F.lit(1).cast("long"), name)
        return numbered._with(numbered.df.withColumn(name, F.col(name) - 1))

    def previous(self, value: Column, name: str) -> Ordered:
        """The value of the row before."""
        last = self.df.groupBy("_slice").agg(F.max_by(F.struct(value.alias("v")), F.struct(*self.order)).alias("_l"))
        base = last.select("_slice", F.lag("_l").over(self._across).alias("_before"))
        df = self.df.withColumn("_lag", F.lag(F.struct(value.alias("v"))).over(self.window)).join(F.broadcast(base), "_slice")
        return self._with(df.withColumn(name, F.coalesce("_lag", "_before")["v"]).drop("_lag", "_before"))

    def fill_forward(self, value: Column, name: str) -> Ordered:
        """The last value that is not null, of this row or an earlier one."""
        order = F.when(value.isNotNull(), F.struct(*self.order))
        last = self.df.groupBy("_slice").agg(F.max_by(value, order).alias("_l"))
        base = last.select("_slice", F.last("_l", True).over(self._across.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
        local = F.last(value, True).over(self.window.rowsBetween(Window.unboundedPreceding, 0))
        df = self.df.withColumn("_local", local).join(F.broadcast(base), "_slice")
        return self._with(df.withColumn(name, F.coalesce("_local", "_before")).drop("_local", "_before"))

    def run_groups(self, key: Column, name: str = "group_ord") -> Ordered:
        """Number, from 0, of the run of equal keys; a key that comes again opens a new run."""
        seen = self.previous(F.struct(key.alias("k")), "_prev")
        new = F.when(F.col("_prev").isNull() | ~F.col("_prev.k").eqNullSafe(key), 1).otherwise(0).cast("long")
        out = seen.running_sum(new, name)
        return out._with(out.df.withColumn(name, F.col(name) - 1).drop("_prev"))

    def result(self) -> DataFrame:
        return self.df.drop("_slice")


def in_ranges(rows: DataFrame, ordinal: str, ranges: DataFrame, lo: str, hi: str) -> DataFrame:
    """Rows with the columns of the range [lo, hi) that holds their ordinal; ranges do not overlap, ordinals are unique.

    A range is a mark in the rows' order, carried forward to the next: no join, whatever the ranges' number and lengths.
    """
    marks = ranges.filter(F.col(lo) < F.col(hi)).select(F.col(lo).cast("long").alias("at_"), F.lit(0).alias("kind_"), F.struct(*ranges.columns).alias("range_"))
    held = rows.select(F.col(ordinal).cast("long").alias("at_"), F.lit(1).alias("kind_"), F.struct(*rows.columns).alias("row_"))
    both = marks.unionByName(held, allowMissingColumns=True)
    filled = Ordered(both, F.col("at_"), ["at_", "kind_"]).fill_forward(F.col("range_"), "own_").result()
    return filled.filter((F.col("kind_") == 1) & (F.col("at_") < F.col(f"own_.{hi}"))).select("row_.*", "own_.*")
