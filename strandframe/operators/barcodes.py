"""Barcode counting, thresholds, unique one-mismatch repair and clouds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LETTERS = "ACGT"


def counts(reads: DataFrame, code: str) -> DataFrame:
    """code, n. Partial counts are combined before the shuffle, so a hot code costs a row a task."""
    return reads.groupBy(F.col(code).alias("code")).agg(F.count("*").alias("n"))


def bucket(n: Column) -> Column:
    """Counts below 50 as they are, below 1000 by tens, and one bucket beyond."""
    return F.when(n < 50, n).when(n < 1000, n - n % 10).otherwise(1000).cast("long")


def histogram(coded: DataFrame) -> DataFrame:
    return coded.groupBy(bucket(F.col("n")).alias("bucket")).agg(F.count("*").alias("n_codes"), F.sum("n").alias("n_reads"))


def neighbours(code: Column, length: int) -> Column:
    """All codes at Hamming distance one: three a place."""
    cells = []
    for i in range(1, length + 1):
        for letter in LETTERS:
            cells.append(F.when(F.substring(code, i, 1) != letter, F.concat(F.substring(code, 1, i - 1), F.lit(letter), F.substring(code, i + 1, length))))
    return F.array_compact(F.array(*cells))


def repairs(coded: DataFrame, threshold: int, length: int) -> DataFrame:
    """code, n, corrected: valid codes as they are, others to the one valid code at distance one.

    A code with none or several valid neighbours has no correction. Works on distinct codes: valid
    ones are exploded to 3 * length neighbours, and joined to the invalid by equality.
    """
    valid = coded.filter(F.col("n") >= threshold)
    near = valid.select(F.col("code").alias("to"), F.explode(neighbours(F.col("code"), length)).alias("code"))
    one = near.groupBy("code").agg(F.count("*").alias("k"), F.min("to").alias("to")).filter("k = 1")
    fixed = coded.filter(F.col("n") < threshold).join(one, "code", "left").select("code", "n", F.col("to").alias("corrected"))
    return valid.select("code", "n", F.col("code").alias("corrected")).union(fixed)


def summary(repaired: DataFrame) -> DataFrame:
    valid, fixed = F.col("code").eqNullSafe(F.col("corrected")), F.col("corrected").isNotNull()
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    return repaired.agg(
        F.count_if(valid).alias("n_valid_codes"), total(valid).alias("n_valid"), total(fixed & ~valid).alias("n_repaired"), total(~fixed).alias("n_dropped")
    )
