"""Selection of objects and groups by ordinal, and prefix keys."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse_ranges(spec: str) -> list[tuple[int, int, int]]:
    """'3,5-9' as (place in the request, from, to without it); a lone x is x to x+1."""
    out = []
    for n, part in enumerate(spec.split(",")):
        m = re.fullmatch(r"(\d+)(?:-(\d+))?", part.strip())
        if not m:
            raise ValueError(f"not a range: {part!r}")
        lo = int(m[1])
        hi = int(m[2]) if m[2] else lo + 1
        if hi <= lo:
            raise ValueError(f"empty range: {part!r}")
        out.append((n, lo, hi))
    return out


def by_ordinal(df: DataFrame, ordinal: str, spec: str) -> DataFrame:
    """Rows whose ordinal is in the ranges, once for each range that holds it, with the range's `seq`.

    The request is part of the plan: a filter that can be pushed to the scan, then a small array
    of the ranges that hold the row.
    """
    ranges = parse_ranges(spec)
    o = F.col(ordinal)
    holds = F.lit(False)
    for _, lo, hi in ranges:
        holds = holds | ((o >= lo) & (o < hi))
    seqs = F.array_compact(F.array(*[F.when((o >= lo) & (o < hi), F.lit(n)) for n, lo, hi in ranges]))
    return df.filter(holds).withColumn("seq", F.explode(seqs))


def prefix_key(name: Column, separator: str, n: int) -> Column:
    """The name up to its n-th separator; the whole name if it has fewer. \\t \\n \\r \\f may be escaped."""
    escapes = {"\\t": "\t", "\\n": "\n", "\\r": "\r", "\\f": "\f"}
    return F.substring_index(name, escapes.get(separator, separator), n)


def identifier(header: Column) -> Column:
    """The header up to the first white space."""
    return F.regexp_extract(header, r"^\S+", 0)


def group_index(objects: DataFrame, group: str, ordinal: str) -> DataFrame:
    """First object and number of objects of each group."""
    return objects.groupBy(group).agg(F.min(ordinal).alias("first_obj"), F.count("*").alias("n_obj"))
