"""Variant rows: types, genotypes, allele counts, filters, trimming and synchronised joins."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandframe.functions.scalars import let

REF, SNP, MNP, INDEL, OTHER, BND, OVERLAP = 0, 1, 2, 4, 8, 16, 32
GENOTYPES = ("HOM_RR", "HOM_AA", "HET_RA", "HET_AA", "HAPL_R", "HAPL_A", "UNKN")


def variant_type(ref: Column, alt: Column) -> Column:
    """struct<type, n>: the class of one alternative allele and its signed length.

    Letters that both share at the start, then at the end, do not count, whatever their case.
    """
    r, a = F.lower(ref), F.lower(alt)
    lr, la = F.length(r), F.length(a)
    shared = lambda x, y, n: F.coalesce(  # noqa: E731  letters before the first difference, of n
        F.array_min(F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(x, i, F.lit(1)) != F.substring(y, i, F.lit(1)))) - 1, n
    )
    shorter = F.least(lr, la)
    head = shared(r, a, shorter)
    tail_max = shorter - head
    tail = F.when(tail_max > 0, shared(F.reverse(r), F.reverse(a), tail_max)).otherwise(0)
    rest_r, rest_a = lr - head - tail, la - head - tail
    kind = (
        F.when(alt.isin("*"), F.struct(F.lit(OVERLAP).alias("type"), F.lit(0).alias("n")))
        .when(alt.isin("<*>", "<X>", "<NON_REF>", ".") | (r == a), F.struct(F.lit(REF).alias("type"), F.lit(0).alias("n")))
        .when(alt.contains("[") | alt.contains("]"), F.struct(F.lit(BND).alias("type"), F.lit(0).alias("n")))
        .when(alt.startswith("<"), F.struct(F.lit(OTHER).alias("type"), F.lit(0).alias("n")))
        .when((rest_r == rest_a) & (rest_r == 1), F.struct(F.lit(SNP).alias("type"), F.lit(1).alias("n")))
        .when(rest_r == rest_a, F.struct(F.lit(MNP).alias("type"), rest_r.alias("n")))
        .when((rest_r == 0) | (rest_a == 0), F.struct(F.lit(INDEL).alias("type"), (la - lr).alias("n")))
        .otherwise(F.struct(F.lit(OTHER).alias("type"), (la - lr).alias("n")))
    )
    return kind


def alleles(genotype: Column) -> Column:
    """'0/1' as [0, 1]; a missing allele is null."""
    return F.transform(F.split(genotype, r"[/|]"), lambda x: x.try_cast("int"))


def genotype_class(genotype: Column) -> Column:
    """0 to 6 as in GENOTYPES; any missing allele makes it unknown."""
    a = alleles(genotype)
    n = F.size(a)
    missing = F.exists(a, lambda x: x.isNull()) | (n == 0) | genotype.isNull()
    refs = F.size(F.filter(a, lambda x: x == 0))
    same = F.array_min(a) == F.array_max(a)
    return (
        F.when(missing, 6).when((n == 1) & (refs == 1), 4).when(n == 1, 5).when(refs == n, 0).when(refs > 0, 2).when(same, 1).otherwise(3)
    )


def allele_counts(sites: DataFrame, key: list[str], genotypes: str, ac: str | None = None, an: str | None = None) -> DataFrame:
    """key, allele, n of each site: INFO's AC and AN where it has both, else counted from genotypes."""
    from_gt = F.filter(F.flatten(F.transform(F.coalesce(F.col(genotypes), F.array().cast("array<string>")), alleles)), lambda x: x.isNotNull())
    counted = sites.select(*key, F.explode(from_gt).alias("allele"), F.lit(1).cast("long").alias("n"), F.lit(False).alias("stated"))
    if ac and an:
        known = F.col(ac).isNotNull() & F.col(an).isNotNull()
        all_ = F.concat(F.array(F.col(an) - F.aggregate(F.col(ac), F.lit(0).cast("long"), lambda s, x: s + x)), F.col(ac))
        stated = sites.filter(known).select(*key, F.posexplode(all_).alias("allele", "n"))
        counted = sites.filter(~known).select(*key, F.explode(from_gt).alias("allele"), F.lit(1).cast("long").alias("n"))
        return stated.select(*key, "allele", F.col("n").cast("long").alias("n")).union(counted.groupBy(*key, "allele").agg(F.sum("n").alias("n")))
    return counted.groupBy(*key, "allele").agg(F.sum("n").alias("n"))


def synced(left: DataFrame, right: DataFrame, mode: str = "exact") -> DataFrame:
    """Full outer join of two variant tables (chrom, pos, ref, alt, kind and others) by position.

    exact: same alleles; any: all records of a position; snps and indels: records of that kind with
    any alleles, others by alleles; both: either kind with its own; the _ref modes also pair a
    record without alternatives. some: records that share an alternative. Columns get l_ and r_.
    """
    if mode == "some":
        return _sharing(left, right)
    ref = F.col("kind") == REF
    keys = {
        "exact": lambda: F.concat_ws(">", "ref", "alt"),
        "any": lambda: F.lit(""),
        "snps": lambda: F.when(F.col("kind") == SNP, F.lit("snp")).otherwise(F.concat_ws(">", "ref", "alt")),
        "indels": lambda: F.when(F.col("kind") == INDEL, F.lit("indel")).otherwise(F.concat_ws(">", "ref", "alt")),
        "both": lambda: F.when(F.col("kind") == SNP, F.lit("snp")).when(F.col("kind") == INDEL, F.lit("indel")).otherwise(F.concat_ws(">", "ref", "alt")),
        "snps_ref": lambda: F.when(ref | (F.col("kind") == SNP), F.lit("snp")).otherwise(F.concat_ws(">", "ref", "alt")),
        "indels_ref": lambda: F.when(ref | (F.col("kind") == INDEL), F.lit("indel")).otherwise(F.concat_ws(">", "ref", "alt")),
        "both_ref": lambda: F.when(ref | F.col("kind").isin(SNP, INDEL), F.lit("any")).otherwise(F.concat_ws(">", "ref", "alt")),
    }[mode]

    def side(df, s):
        return df.withColumn("pair_", keys()).select(*[F.col(c).alias(f"{s}_{c}") for c in df.columns], F.col("chrom").alias("chrom_"), F.col("pos").alias("pos_"), "pair_")

    out = side(left, "l").join(side(right, "r"), ["chrom_", "pos_", "pair_"], "full_outer")
    return out.withColumnsRenamed({"chrom_": "chrom", "pos_": "pos"}).drop("pair_")


def _sharing(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of both with any of their comma-joined alternatives in common, each pair once; others alone."""
    named = {}
    for s, df in (("l", left), ("r", right)):
        named[s] = df.select(*[F.col(c).alias(f"{s}_{c}") for c in df.columns], F.xxhash64(*df.columns).alias(f"{s}_h_"), F.explode(F.split("alt", ",")).alias("one_"), F.col("chrom").alias("chrom"), F.col("pos").alias("pos"), F.col("ref").alias("ref_"))
    both = named["l"].join(named["r"], ["chrom", "pos", "ref_", "one_"]).dropDuplicates(["chrom", "pos", "l_h_", "r_h_"]).drop("ref_", "one_")
    alone = []
    for s, o in (("l", "r"), ("r", "l")):
        own = named[s].dropDuplicates(["chrom", "pos", f"{s}_h_"]).drop("ref_", "one_")
        alone.append(own.join(both.select("chrom", "pos", f"{s}_h_").distinct(), ["chrom", "pos", f"{s}_h_"], "left_anti"))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [both, *alone]).drop("l_h_", "r_h_")


def has_filter(filters: Column, name: str) -> Column:
    """PASS stands for an empty list."""
    return F.size(filters) == 0 if name == "PASS" else F.array_contains(filters, name)


def add_filter(filters: Column, name: str) -> Column:
    return F.array().cast("array<string>") if name == "PASS" else F.array_union(filters, F.array(F.lit(name)))


def remove_filter(filters: Column, name: str) -> Column:
    return F.array_except(filters, F.array(F.lit(name)))


def update_info(info: Column, key: str, value: Column | None) -> Column:
    kept = F.map_filter(info, lambda k, _: k != key)
    return kept if value is None else F.map_concat(kept, F.create_map(F.lit(key), value))


def add_id(ids: Column, value: str | Column) -> Column:
    """A record's names, joined by ';', with one more unless it is there."""
    value = F.lit(value) if isinstance(value, str) else value
    return F.when(ids.isNull(), value).when(F.array_contains(F.split(ids, ";"), value), ids).otherwise(F.concat_ws(";", ids, value))


def update_format(formats: Column, samples: Column, key: str, values: Column | None) -> Column:
    """struct<format, samples> with one field of all samples set, added at the end where it is new, or taken out (no values).

    A sample may state fewer fields than the format has; what it lacks is missing.
    """
    at = F.array_position(formats, key)
    n = F.size(formats)
    cells = lambda s: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.coalesce(F.get(F.split(s, ":"), i), F.lit(".")))
    if values is None:
        out = F.when(at == 0, samples).otherwise(F.transform(samples, lambda s: F.array_join(F.filter(cells(s), lambda _, i: i != at - 1), ":")))
        return F.struct(F.array_remove(formats, key).alias("format"), out.alias("samples"))
    put = lambda s, k: F.when(at == 0, F.array_append(cells(s), F.get(values, k))).otherwise(F.transform(cells(s), lambda x, i: F.when(i == at - 1, F.get(values, k)).otherwise(x)))
    named = F.when(at == 0, F.array_append(formats, F.lit(key))).otherwise(formats)
    return F.struct(named.alias("format"), F.transform(samples, lambda s, k: F.array_join(put(s, k), ":")).alias("samples"))


def used_alleles(alts: Column, genotypes: Column) -> Column:
    """Numbers, from 0, of the alleles in use, the reference always."""
    seen = F.filter(F.flatten(F.transform(genotypes, alleles)), lambda x: x.isNotNull() & (x > 0) & (x <= F.size(alts)))
    return F.concat(F.array(F.lit(0)), F.array_sort(F.array_distinct(seen)))


def _parts(genotype: Column) -> Column:
    return F.regexp_extract_all(genotype, F.lit(r"[0-9.]+|[/|]"), F.lit(0))


def _renumbered(alts: Column, genotypes: Column, kept: Column, missing: Column | None = None) -> Column:
    """struct<alts, genotypes> of the alleles in `kept`, whose places there are their new numbers; others are `missing`."""

    def all_of(kept):
        number = lambda p: (p - 1).cast("string")
        place = lambda x: F.array_position(kept, x.try_cast("int"))
        new = (lambda x: number(place(x))) if missing is None else lambda x: let(place(x), lambda p: F.when(p > 0, number(p)).otherwise(missing))
        one = lambda x: F.when(x.rlike("^[0-9]+$"), new(x)).otherwise(x)
        return F.struct(
            F.filter(alts, lambda _, i: F.array_contains(kept, i + 1)).alias("alts"),
            F.transform(genotypes, lambda g: F.array_join(F.transform(_parts(g), one), "")).alias("genotypes"),
        )

    return let(kept, all_of)


def trim_alleles(alts: Column, genotypes: Column) -> Column:
    """struct<alts, genotypes> without unused alternatives, genotypes renumbered; '|' and '/' stay."""
    return _renumbered(alts, genotypes, used_alleles(alts, genotypes))


def remove_alleles(alts: Column, genotypes: Column, gone: Column) -> Column:
    """struct<alts, genotypes> without the alternatives numbered (from 1) in `gone`; calls of them become missing."""
    kept = F.filter(F.sequence(F.lit(0), F.size(alts)), lambda i: (i == 0) | ~F.array_contains(gone, i))
    return _renumbered(alts, genotypes, kept, F.lit("."))


def per_allele(values: Column, gone: Column, number: str = "A") -> Column:
    """Values of a field with one a alternative (A), allele (R) or genotype of two alleles (G), without those of `gone`."""
    if number == "A":
        return F.filter(values, lambda _, i: ~F.array_contains(gone, i + 1))
    if number == "R":
        return F.filter(values, lambda _, i: (i == 0) | ~F.array_contains(gone, i))
    # genotype j/k, j <= k, is at k (k + 1) / 2 + j
    high = lambda i: F.floor((F.sqrt(8 * i + 1) - 1) / 2).cast("int")
    return F.filter(values, lambda _, i: ~F.array_contains(gone, high(i)) & ~F.array_contains(gone, (i - (high(i) * (high(i) + 1) / 2).cast("int"))))


def restricted(sites: DataFrame, regions: DataFrame, shift: int = 13) -> DataFrame:
    """Sites (chrom, pos) within any of the regions (chrom, beg, end, inclusive), each once.

    Regions are merged first, so that a site lies in one at most and nothing is repeated.
    """
    from strandframe.operators.intervals import merge

    one = merge(regions, "chrom")
    binned = one.withColumn("bin_", F.explode(F.sequence(F.shiftright(F.col("beg").cast("long"), shift), F.shiftright(F.col("end").cast("long"), shift)))).drop("n")
    held = sites.withColumn("bin_", F.shiftright(F.col("pos").cast("long"), shift)).join(binned, ["chrom", "bin_"])
    return held.filter((F.col("pos") >= F.col("beg")) & (F.col("pos") <= F.col("end"))).select(*sites.columns)


def fisher(n11: Column, n12: Column, n21: Column, n22: Column) -> Column:
    """struct<left, right, two>: Fisher's exact test; all 1 where only one table is possible.

    Probabilities follow from their neighbours', from the likeliest table on to both sides, and are kept as
    sums alone: the work grows with the number of possible tables.
    """
    n11, n12, n21, n22 = [c.cast("long") for c in (n11, n12, n21, n22)]
    row, col, n = n11 + n12, n11 + n21, n11 + n12 + n21 + n22
    low, high = F.greatest(F.lit(0).cast("long"), row + col - n), F.least(row, col)
    likeliest = F.greatest(low, F.least(high, F.floor((row + 1).cast("double") * (col + 1) / (n + 2))))
    ratio = lambda i: F.ln((row - i).cast("double") * (col - i) / ((i + 1).cast("double") * (n - row - col + i + 1)))  # noqa: E731  log of p(i + 1) / p(i)
    none = F.array().cast("array<bigint>")
    up = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(none)
    down = F.when(low < likeliest, F.sequence(likeliest - 1, low, F.lit(-1).cast("long"))).otherwise(none)
    fold = lambda steps, sign: F.aggregate(steps, F.lit(0.0), lambda s, i: s + sign * ratio(i))
    own = fold(up(likeliest, n11 - 1), 1) + fold(up(n11, likeliest - 1), -1)  # logs are relative to the likeliest table's

    def sums(of: dict, log: Column, i: Column, most: Column) -> Column:
        p, none_ = F.exp(log), F.lit(0.0)
        tests = {"left": i <= n11, "right": i >= n11, "two": log <= most, "all": F.lit(True)}
        return F.struct(log.alias("log"), most.alias("most"), *[(of.get(k, none_) + F.when(t, p).otherwise(0.0)).alias(k) for k, t in tests.items()])

    fields = ("left", "right", "two", "all")
    step = lambda at, sign: lambda a, i: sums({k: a[k] for k in fields}, a["log"] + sign * ratio(i), i + at, a["most"])
    start = sums({}, F.lit(0.0), likeliest, own + math.log1p(1e-7))
    upper = F.aggregate(up(likeliest, high - 1), start, step(1, 1), lambda a: F.struct(F.lit(0.0).alias("log"), a["most"].alias("most"), *[a[k].alias(k) for k in fields]))
    share = lambda a, k: F.least(F.lit(1.0), a[k] / a["all"]).alias(k)
    return F.when(n.isNotNull(), F.aggregate(down, upper, step(0, -1), lambda a: F.struct(share(a, "left"), share(a, "right"), share(a, "two"))))


def union_metadata(*frames: DataFrame) -> DataFrame:
    """Provenance, reference or deferred rows of several parents, with the parent's place as `step`."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [f.withColumn("step", F.lit(i)) for i, f in enumerate(frames)])
