"""Header statistics, checks and usage over objects and their lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def header_counts(objects: DataFrame, group: str | None, length: str, line_type: str) -> DataFrame:
    """Count, longest and total list of one line type, and the largest of each within a group.

    Two aggregations: per group, then over groups, so the second shuffle carries one row a
    group. Objects outside any group (null) count in the totals, not in the group maxima.
    """
    g = F.col(group) if group else F.lit(None)
    per = objects.groupBy(g.alias("g")).agg(
        F.count("*").alias("n"), F.coalesce(F.max(length), F.lit(0)).alias("longest"), F.coalesce(F.sum(length), F.lit(0)).alias("total")
    )
    inside = F.col("g").isNotNull()
    return per.agg(
        F.lit(line_type).alias("line_type"),
        F.sum("n").alias("n_lines"),
        F.max("longest").cast("bigint").alias("max_len"),
        F.sum("total").cast("bigint").alias("total_len"),
        F.max(F.when(inside, F.col("n"))).alias("group_max_count"),
        F.max(F.when(inside, F.col("total"))).cast("bigint").alias("group_max_total"),
    )


def group_check(asserted: DataFrame, objects: DataFrame, group: str, given: str) -> DataFrame:
    """group, given, found where the stated size of a group is not the number of its objects."""
    found = objects.groupBy(group).agg(F.count("*").alias("found"))
    both = asserted.select(group, F.col(given).alias("given")).join(found, group, "left").withColumn("found", F.coalesce("found", F.lit(0)))
    return both.filter(F.col("given") != F.col("found"))


def header_check(given: DataFrame, found: DataFrame) -> DataFrame:
    """line_type, given, found, state of two tables (line_type, n): bad if they differ, missing if none was given."""
    both = given.select("line_type", F.col("n").alias("given")).join(found.select("line_type", F.col("n").alias("found")), "line_type", "full_outer")
    both = both.select("line_type", F.coalesce("given", F.lit(0)).alias("given"), F.coalesce("found", F.lit(0)).alias("found"))
    state = F.when((F.col("given") > 0) & (F.col("given") != F.col("found")), "bad").when((F.col("given") == 0) & (F.col("found") > 0), "missing")
    return both.withColumn("state", state).filter("state is not null")


def usage(lines: DataFrame, line_type: str, text: str) -> DataFrame:
    """Bytes of each line type."""
    return lines.groupBy(line_type).agg(F.count("*").alias("n_lines"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).cast("bigint").alias("n_bytes"))


def symbols(df: DataFrame, text: str) -> DataFrame:
    """symbol, n, code, bits: histogram of characters with a dense order-preserving code and its width."""
    from pyspark.sql import Window

    n = df.select(F.explode(F.split(F.col(text), "")).alias("symbol")).filter("symbol != ''").groupBy("symbol").agg(F.count("*").alias("n"))
    w = Window.orderBy("symbol")  # the alphabet
    whole = Window.partitionBy()
    coded = n.withColumn("code", F.dense_rank().over(w) - 1).withColumn("size_", F.count("*").over(whole))
    bits = F.ceil(F.log2(F.greatest(F.col("size_"), F.lit(2)))).cast("int")
    return coded.select("symbol", "n", "code", bits.alias("bits"))


def nearest_codes(found: DataFrame) -> DataFrame:
    """byte, code of all 256 bytes from a symbols() table of one-byte symbols: an unseen one has the code of the nearest seen, the lower of two."""
    seen = found.filter(F.octet_length("symbol") == 1).select(F.struct(F.ascii("symbol").alias("at"), "code").alias("s"))
    whole = seen.agg(F.array_sort(F.collect_list("s")).alias("all"))  # the alphabet, 256 at most
    byte = F.explode(F.sequence(F.lit(0), F.lit(255))).alias("byte")
    near = F.array_min(F.transform("all", lambda s: F.struct(F.abs(s["at"] - F.col("byte")).alias("d"), s["at"].alias("at"), s["code"].alias("code"))))
    return whole.select("all", byte).select("byte", near["code"].alias("code"))


def totals(reads: DataFrame, length: str) -> DataFrame:
    """n_reads, total and longest of a set of reads."""
    return reads.agg(F.count("*").alias("n_reads"), F.coalesce(F.sum(length), F.lit(0)).cast("long").alias("total"), F.coalesce(F.max(length), F.lit(0)).cast("long").alias("longest"))


def scaffold_lengths(contigs: DataFrame, scaffold: str, start: str, length: str, order: list[str]) -> DataFrame:
    """scaffold, length: where its last contig ends."""
    return contigs.groupBy(scaffold).agg(F.max_by(F.col(start) + F.col(length), F.struct(*order)).alias("length"))
