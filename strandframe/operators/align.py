"""Pileup columns, strand coordinates and chunks of reads over a reference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandframe.functions.scalars import cigar_ops


PILES = 16
BIN = 14  # bits of the positions in a bin of running sums


def strand_swap(reverse: Column, beg: Column, end: Column) -> tuple[Column, Column]:
    """Begin and end as written: swapped on the reverse strand."""
    return F.when(reverse, end).otherwise(beg), F.when(reverse, beg).otherwise(end)


def blocks(reads: DataFrame, pos: str = "pos", cigar: str = "cigar") -> DataFrame:
    """One row an operation of each read, with its start on the reference and on the read (from 0)."""
    zero = F.expr("cast(array() as array<struct<op:string, n:bigint, r:bigint, q:bigint>>)")
    start = F.struct(F.col(pos).cast("long").alias("r"), F.lit(0).cast("long").alias("q"), zero.alias("out"))

    def step(a, x):
        on_ref = F.when(x["op"].isin("M", "D", "N", "=", "X"), x["n"]).otherwise(0)
        on_read = F.when(x["op"].isin("M", "I", "S", "=", "X"), x["n"]).otherwise(0)
        row = F.struct(x["op"].alias("op"), x["n"].alias("n"), a["r"].alias("r"), a["q"].alias("q"))
        return F.struct((a["r"] + on_ref).alias("r"), (a["q"] + on_read).alias("q"), F.concat(a["out"], F.array(row)).alias("out"))

    walked = F.aggregate(cigar_ops(F.col(cigar)), start, step, lambda a: a["out"])
    return reads.select("*", F.explode(walked).alias("b")).select(*reads.columns, "b.op", "b.n", "b.r", "b.q")


def positions(reads: DataFrame, chrom: str = "chrom", pos: str = "pos", cigar: str = "cigar") -> DataFrame:
    """One row a reference position that a read covers: chrom, ref_pos, kind (M, D or N) and query_pos."""
    covered = blocks(reads, pos, cigar).filter(F.col("op").isin("M", "=", "X", "D", "N") & (F.col("n") > 0))
    out = covered.withColumn("k_", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    kind = F.when(F.col("op").isin("=", "X"), "M").otherwise(F.col("op"))
    return out.select(*reads.columns, (F.col("r") + F.col("k_")).alias("ref_pos"), kind.alias("kind"), F.when(kind == "M", F.col("q") + F.col("k_")).alias("query_pos"))


def depth(reads: DataFrame, chrom: str = "chrom", cap: int | None = None, order: list[str] | None = None) -> DataFrame:
    """chrom, ref_pos, depth, n_del, n_skip of each covered position, skips not counted in depth.

    Without a cap a block is two marks, at its begin and after its end, within each bin of 2^BIN
    positions that it touches. Marks are summed before the shuffle, running sums stay within a bin, and
    positions are spelled out at the end alone. A cap keeps the first reads of each position by `order`.
    Reads of one begin and alignment cover the same positions in the same way, so that of each such
    group only the first `cap` reads can be among them: the others go before any position is spelled
    out. A first window, over a position's rows as a hash deals them, cuts each of its PILES to the cap,
    so that no task holds all reads of a deep position.
    """
    if cap is None:
        return _runs(reads, chrom)
    by = order or ["pos", "cigar"]
    own = [c for c in by if c in reads.columns]  # kind and the like are one within a group
    alike = Window.partitionBy(chrom, "pos", "cigar").orderBy(*own or ["pos"])
    first = reads.select(*dict.fromkeys([chrom, "pos", "cigar", *own])).withColumn("rn_", F.row_number().over(alike)).filter(F.col("rn_") <= cap).drop("rn_")
    piles = Window.partitionBy(chrom, "ref_pos", "pile_").orderBy(*by)
    at = positions(first).withColumn("pile_", F.pmod(F.xxhash64(*by), F.lit(PILES)))
    at = at.withColumn("rn_", F.row_number().over(piles)).filter(F.col("rn_") <= cap)
    at = at.withColumn("rn_", F.row_number().over(Window.partitionBy(chrom, "ref_pos").orderBy(*by))).filter(F.col("rn_") <= cap)
    return at.groupBy(chrom, "ref_pos").agg(F.count_if(F.col("kind") != "N").alias("depth"), F.count_if(F.col("kind") == "D").alias("n_del"), F.count_if(F.col("kind") == "N").alias("n_skip"))


def _runs(reads: DataFrame, chrom: str) -> DataFrame:
    covered = blocks(reads).filter(F.col("op").isin("M", "=", "X", "D", "N") & (F.col("n") > 0)).select(F.col(chrom).alias("chrom_"), "op", F.col("r").alias("beg_"), (F.col("r") + F.col("n")).alias("end_"))
    binned = covered.withColumn("bin_", F.explode(F.sequence(F.shiftright("beg_", BIN), F.shiftright(F.col("end_") - 1, BIN))))
    low = F.shiftleft("bin_", BIN)
    mark = lambda at, w: F.struct(at.alias("at"), F.lit(w).alias("w"))
    marks = binned.select("chrom_", "bin_", "op", F.explode(F.array(mark(F.greatest("beg_", low), 1), mark(F.least("end_", low + (1 << BIN)), -1))).alias("m"))
    total = lambda test: F.sum(F.when(test, F.col("m.w")).otherwise(0))
    op = F.col("op")
    summed = marks.groupBy("chrom_", "bin_", F.col("m.at").alias("at_")).agg(total(op != "N").alias("d_"), total(op == "D").alias("x_"), total(op == "N").alias("k_"))
    w = Window.partitionBy("chrom_", "bin_").orderBy("at_")
    sofar = w.rowsBetween(Window.unboundedPreceding, 0)
    runs = summed.select(F.col("chrom_").alias(chrom), "at_", F.lead("at_").over(w).alias("next_"), F.sum("d_").over(sofar).alias("depth"), F.sum("x_").over(sofar).alias("n_del"), F.sum("k_").over(sofar).alias("n_skip"))
    live = runs.filter(F.col("next_").isNotNull() & (F.col("depth") + F.col("n_skip") > 0))
    return live.select(chrom, F.explode(F.sequence(F.col("at_"), F.col("next_") - 1)).alias("ref_pos"), "depth", "n_del", "n_skip")


def depth_by_file(reads: DataFrame, file: str, names: list, chrom: str = "chrom") -> DataFrame:
    """Depth columns of several files by position; the files are named, so no pass looks for them."""
    at = positions(reads).filter(F.col("kind") != "N")
    return at.groupBy(chrom, "ref_pos").agg(*[F.count_if(F.col(file) == n).alias(f"depth_{n}") for n in names])


def overlap_quality(pairs: DataFrame) -> DataFrame:
    """Qualities qa, qb of two mates' bases at one position: equal bases add up on a, else the higher keeps 0.8 of itself."""
    same = F.col("base_a") == F.col("base_b")
    high_a = F.col("qa") >= F.col("qb")
    cut = lambda q: F.floor(q * 0.8).cast("int")
    qa = F.when(same, F.least(F.col("qa") + F.col("qb"), F.lit(200))).when(high_a, cut(F.col("qa"))).otherwise(0)
    qb = F.when(same | high_a, 0).otherwise(cut(F.col("qb")))
    return pairs.withColumns({"qa": qa.cast("int"), "qb": qb.cast("int")})


def fetch(sequences: DataFrame, regions: DataFrame, name: str = "name", seq: str = "seq") -> DataFrame:
    """Pieces [beg, end] (from 0, inclusive, cut to the sequence) of named sequences."""
    both = sequences.join(regions, name)
    beg = F.greatest(F.col("beg"), F.lit(0)).cast("int")
    return both.withColumn("piece", F.substring(F.col(seq), beg + 1, F.greatest(F.col("end").cast("int") - beg + 1, F.lit(0))))


def index_stats(reads: DataFrame, ref: str, unmapped: Column) -> DataFrame:
    return reads.groupBy(ref).agg(F.count_if(~unmapped).alias("n_mapped"), F.count_if(unmapped).alias("n_unmapped"))
