"""Positional pairing, ordinal lookups and pair marking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def zip_by_ordinal(forward: DataFrame, reverse: DataFrame, ordinal: str = "obj_ord", check: bool = False) -> DataFrame:
    """The i-th row of one with the i-th of the other, as f_* and r_*; with `check`, unequal counts are an error."""
    how = "full_outer" if check else "inner"
    f = forward.select(F.col(ordinal).alias("ord_"), *[F.col(c).alias(f"f_{c}") for c in forward.columns if c != ordinal], F.lit(True).alias("f_in_"))
    r = reverse.select(F.col(ordinal).alias("ord_"), *[F.col(c).alias(f"r_{c}") for c in reverse.columns if c != ordinal], F.lit(True).alias("r_in_"))
    out = f.join(r, "ord_", how)
    if check:
        whole = F.col("f_in_").isNotNull() & F.col("r_in_").isNotNull()
        out = out.withColumn("ord_", F.when(whole, F.col("ord_")).otherwise(F.raise_error(F.lit("the files differ in their numbers of sequences")).cast("long")))
    return out.withColumnRenamed("ord_", ordinal).drop("f_in_", "r_in_")


def lookup(df: DataFrame, pointer: str, dimension: DataFrame, ordinal: str, columns: dict[str, str]) -> DataFrame:
    """Columns of the dimension at each pointer. Spark broadcasts it where it is small by its statistics."""
    d = dimension.select(F.col(ordinal).alias("ord_"), *[F.col(c).alias(n) for c, n in columns.items()])
    return df.join(d, F.col(pointer) == F.col("ord_"), "left").drop("ord_")


def dereference(lists: DataFrame, pointers: str, target: DataFrame, ordinal: str) -> DataFrame:
    """One row an element of the list, in place `pos`, with the columns of what it points to."""
    return lists.select("*", F.posexplode(pointers).alias("pos", "ref_")).join(target, F.col("ref_") == F.col(ordinal)).drop("ref_")


def pairs_from_flags(df: DataFrame, group: str, order: list[str], first: Column) -> DataFrame:
    """group, n, n_pairs, n_out_of_phase: first and second are to alternate, beginning with a first."""
    w = Window.partitionBy(group).orderBy(*order)
    seen = df.withColumn("first_", first).withColumn("before_", F.lag("first_").over(w))
    off = F.col("first_") == F.coalesce("before_", F.lit(False))
    return seen.groupBy(group).agg(F.count("*").alias("n"), F.count_if(~F.col("first_") & ~off).alias("n_pairs"), F.count_if(off).alias("n_out_of_phase"))


def pairs_by_identity(runs: DataFrame, run: str, key: str) -> DataFrame:
    """run, key, n, state of runs of one identifier: two make a pair, one is alone, more are an error."""
    n = F.count("*")
    state = F.when(F.col("n") == 2, "pair").when(F.col("n") == 1, "lone").otherwise("extra")
    return runs.groupBy(run, key).agg(n.alias("n")).withColumn("state", state)


def trim_database(df: DataFrame, best: Column, length: Column, cutoff: int, every: bool = False) -> DataFrame:
    """Reads that are the best of theirs (or every one) and at least `cutoff` long."""
    return df.filter((best | F.lit(every)) & (length >= cutoff))


def reset_chain_flags(df: DataFrame, group: str, order: list[str], chained: Column, kept: Column) -> DataFrame:
    """Kept rows with `chained_after`: the first kept row of each insert starts it anew.

    An insert begins with a row that is not chained. Windows stay within a group.
    """
    w = Window.partitionBy(group).orderBy(*order)
    insert = F.sum(F.when(chained, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = df.withColumn("insert_", insert).withColumn("chained_", chained).filter(kept)
    place = F.row_number().over(Window.partitionBy(group, "insert_").orderBy(*order))
    return rows.withColumn("chained_after", F.col("chained_") & (place > 1)).drop("chained_")


def file_groups(df: DataFrame, file: str, name: Column, order: list[str]) -> DataFrame:
    """file, group_ord, name, n: one group a file, in the order of names of files, called after its first record."""
    per = df.groupBy(file).agg(F.min_by(name, F.struct(*order)).alias("name"), F.count("*").alias("n"))
    return per.withColumn("group_ord", F.row_number().over(Window.orderBy(file)) - 1)  # one row a file


def compose_maps(first: DataFrame, second: DataFrame, shift: int = 13) -> DataFrame:
    """Alignments a-b and b-c, of equal lengths on both sides, to a-c where they share a stretch of b.

    Columns a, as_, ae, b, bs, be of either; the second's a is the first's b. Pieces are the
    overlaps, carried over by their distance from the ends. An interval join by bins.
    """
    from strandframe.operators.intervals import overlap_join

    left = first.filter(F.col("bs") < F.col("be")).select("a", "as_", "ae", F.col("b").alias("on"), F.col("bs").alias("beg"), (F.col("be") - 1).alias("end"))
    right = second.filter(F.col("as_") < F.col("ae")).select(F.col("a").alias("on"), F.col("as_").alias("beg"), (F.col("ae") - 1).alias("end"), F.col("b").alias("c"), F.col("bs").alias("cs"))
    both = overlap_join(left, right, "on", shift)
    beg, end = F.greatest("l_beg", "r_beg"), F.least("l_end", "r_end") + 1
    return both.select(
        F.col("l_a").alias("a"),
        (F.col("l_as_") + beg - F.col("l_beg")).alias("as_"),
        (F.col("l_as_") + end - F.col("l_beg")).alias("ae"),
        F.col("r_c").alias("b"),
        (F.col("r_cs") + beg - F.col("r_beg")).alias("bs"),
        (F.col("r_cs") + end - F.col("r_beg")).alias("be"),
    )
