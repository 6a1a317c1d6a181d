"""Rules of the genome file types, as one column a rule: null where a row keeps it, else what is wrong."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _wrong(condition: Column, text: str) -> Column:
    return F.when(condition, F.lit(text))


def sequence_rules(seq: str = "S", qual: str = "Q", pulses: str = "A") -> list[Column]:
    q, s, a = F.col(qual), F.col(seq), F.col(pulses)
    return [
        _wrong(F.length(q) != F.length(s), "quality and sequence differ in length"),
        _wrong(~q.rlike(r"^[!-~]*$"), "a quality letter is out of range"),
        _wrong(F.length(a) != F.length(s), "pulse widths and sequence differ in length"),
        _wrong(~a.rlike("^[1-4]*$"), "a pulse width is not 1 to 4"),
    ]


def map_rules(length: str, sites: str, enzymes: str, intensity: str, noise: str) -> list[Column]:
    r, n = F.col(sites), F.size(sites)
    rising = F.forall(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: (n < 2) | (F.get(r, i) >= F.get(r, i - 1)))
    return [
        _wrong(F.size(enzymes) != n, "enzymes and sites differ in number"),
        _wrong(F.size(intensity) != n, "intensities and sites differ in number"),
        _wrong(F.size(noise) != n, "noise and sites differ in number"),
        _wrong(~rising, "sites are out of order"),
        _wrong(F.array_max(r) > F.col(length), "a site lies beyond the end"),
    ]


def hit_rules(targets: str, offsets: str, positions: str) -> list[Column]:
    n = F.size(targets)
    return [_wrong(F.size(offsets) != n, "offsets and targets differ in number"), _wrong(F.size(positions) != n, "positions and targets differ in number")]


def alignment_rules(as_: str, ae: str, alen: str, bs: str, be: str, blen: str, trace: str | None = None) -> list[Column]:
    """Coordinates are ticks between letters; a reversed b has bs above be. Files without lengths give 0, which checks nothing."""
    lo, hi = F.least(bs, be), F.greatest(bs, be)
    out = [
        _wrong(F.col(as_) > F.col(ae), "a ends before it begins"),
        _wrong((F.col(as_) < 0) | ((F.col(alen) > 0) & (F.col(ae) > F.col(alen))), "a leaves its sequence"),
        _wrong((F.col(blen) > 0) & ((lo < 0) | (hi > F.col(blen))), "b leaves its sequence"),
    ]
    if trace:
        u, n = F.col(trace), F.size(trace)
        step = F.forall(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: (n < 2) | (F.get(u, i) > F.get(u, i - 1)))
        out.append(_wrong(~step | (F.get(u, F.lit(0)) <= F.col(as_)) | (F.element_at(u, -1) >= F.col(ae)), "trace points do not rise from beginning to end"))
    return out


def faults(df: DataFrame, key: list[str], rules: list[Column]) -> DataFrame:
    """key, fault: one row for each rule that a row breaks."""
    return df.select(*key, F.explode(F.array_compact(F.array(*rules))).alias("fault"))


def pair_counts(objects: DataFrame, group: str = "group_ord") -> DataFrame:
    """group, n, n_pairs, ok: every object is one of a pair, and no pair crosses a group's border."""
    per = objects.groupBy(group).agg(F.count("*").alias("n"), F.count_if("P").alias("n_pairs"))
    return per.withColumn("ok", F.col("n") == 2 * F.col("n_pairs"))
