"""Operators on small inputs: golden values of the published cases, properties, and brute force."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from strandframe.functions import samplers
from strandframe.functions import scalars as X
from strandframe.operators import align, barcodes, expr, intervals, joins, select, stats, validate, variants
from strandframe.operators.ordered import Ordered


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(column.alias("v")).collect()[0].v


# --- scalars -------------------------------------------------------------------------------


def test_letters(spark):
    rng = random.Random(1)
    rows = [("".join(rng.choice("acgt") for _ in range(n)),) for n in range(1, 32)]
    df = spark.createDataFrame(rows, "s string")
    got = df.select("s", X.revcomp(X.revcomp(F.col("s"))).alias("rr"), X.dna_unpack(X.dna_pack(F.col("s")), F.length("s")).alias("u")).collect()
    assert all(r.s == r.rr == r.u for r in got)
    assert one(spark, X.revcomp(F.lit("aaccg"))) == "cggtt" and one(spark, X.dna(F.lit("ACGTNacgtx-"))) == "acgtaacgtaa"
    assert one(spark, X.quality_text(F.array(F.lit(0), F.lit(40)))) == "!I" and one(spark, X.quality_text(F.array(F.lit(255), F.lit(1)))) is None
    assert one(spark, F.concat(*[X.iupac(F.lit(i)) for i in range(16)])) == "=acmgrsvtwyhkdbn"
    assert one(spark, X.pulse_cap(F.array(*map(F.lit, (0, 1, 4, 5, 99))))) == "01444" and one(spark, X.pulse_numbers(F.lit("1240"))) == [0, 1, 3, 3]
    assert one(spark, X.swap_case(F.lit("acgtN"))) == "ACGTn"


def test_lists(spark):
    values = [[5], [1, -2, 7], [1 << 40, 0, -(1 << 40)], []]
    df = spark.createDataFrame([(v,) for v in values], "v array<bigint>")
    got = df.select("v", X.cumulative(X.delta(F.col("v"))).alias("c"), X.byte_width(F.col("v")).alias("w")).collect()
    assert all(r.v == r.c for r in got) and [r.w for r in got][:3] == [1, 1, 6]
    assert one(spark, X.trace_points(F.lit(5), F.lit(35), F.lit(10))) == [10, 20, 30] and one(spark, X.trace_points(F.lit(10), F.lit(20), F.lit(10))) == []
    assert one(spark, X.trace_length(F.lit(5), F.lit(35), F.lit(10))) == 8
    assert one(spark, X.every_other(F.array(*map(F.lit, range(5))), 1)) == [1, 3]


def test_flags(spark):
    assert one(spark, X.flag_names(F.lit(1 + 16 + 2048))) == "PAIRED,REVERSE,SUPPLEMENTARY"
    for f in (0, 1, 77, 0xFFF):
        assert one(spark, X.flag_number(X.flag_names(F.lit(f)))) == f
    assert [one(spark, X.first_of_pair(F.lit(f))) for f in (0x40, 0x80, 0xC0)] == [True, False, False]


@pytest.mark.parametrize("cigar, pos, flag, want", [("8M", 49, 0, (8, 8, 57)), ("6M2S", 199, 5, (8, 6, 200)), ("*", 9, 0, (0, 0, 10)), ("2H3S4M1I2D5N1=1X", 0, 0, (10, 13, 13)), ("3S", 4, 0, (3, 0, 5))])
def test_cigar_lengths(spark, cigar, pos, flag, want):
    c = F.lit(cigar)
    assert tuple(spark.range(1).select(X.query_length(c), X.reference_length(c), X.end_position(F.lit(pos), c, F.lit(flag))).collect()[0]) == want


def test_samplers(spark):
    x, want = 42, (42 * 0x5DEECE66D + 11) % (1 << 48)
    assert one(spark, samplers.lcg_next(F.lit(x))) == want
    u = spark.range(20_000).select(((F.col("id") + 0.5) / 20_000).alias("u"))
    m = u.select(F.avg(samplers.exponential(F.col("u"), 2.0)), F.avg(samplers.geometric(F.col("u"), 0.25)), F.avg(samplers.poisson(F.col("u"), 3.0)), F.avg(samplers.binomial(F.col("u"), 10, 0.3))).collect()[0]
    assert m[0] == pytest.approx(0.5, rel=0.01) and m[1] == pytest.approx(4, rel=0.01) and m[2] == pytest.approx(3, rel=0.01) and m[3] == pytest.approx(3, rel=0.01)
    weights = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "value string, weight double")
    got = {r.value: r["count"] for r in samplers.choose(u, "u", weights, "value", "weight").groupBy("value").count().collect()}
    assert got == {"a": 5000, "b": 15000}
    s = spark.createDataFrame([("acgt" * 2000, 1), ("acgt" * 2000, 2)], "s string, k int")
    r = s.select("s", samplers.mutate(F.col("s"), F.col("k"), 0.05, 0.0, 0.0).alias("i"), samplers.mutate(F.col("s"), F.col("k"), 0.0, 0.05, 0.0).alias("d"), samplers.mutate(F.col("s"), F.col("k"), 0.0, 0.0, 0.05).alias("x")).collect()
    assert r[0].i != r[1].i
    assert 8300 < len(r[0].i) < 8500 and 7500 < len(r[0].d) < 7700 and 300 < sum(a != b for a, b in zip(r[0].s, r[0].x)) < 500


# --- order ---------------------------------------------------------------------------------


def test_ordered_against_lists(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice("ab"), rng.choice([None, i])) for i in range(500)]
    o = Ordered(spark.createDataFrame(rows, "i long, k string, v long").repartition(7), F.col("i"), ["i"], slices=6)
    got = o.ordinal("n").run_groups(F.col("k"), "g").fill_forward(F.col("v"), "f").previous(F.col("k"), "p").result().orderBy("i").collect()
    g, f, before = -1, None, None
    for n, (r, (i, k, v)) in enumerate(zip(got, rows)):
        g += k != before
        f = v if v is not None else f
        assert (r.n, r.g, r.f, r.p) == (n, g, f, before)
        before = k


def test_ordered_with_a_hot_key(spark):
    """A value that fills most rows is cut by the rest of the order."""
    rng = random.Random(6)
    rows = [(7 if i % 5 else i, i, rng.choice([None, "a", "b"])) for i in range(2000)]
    rows.sort(key=lambda r: (r[0], r[1]))
    o = Ordered(spark.createDataFrame(rows, "h long, i long, k string").repartition(5), F.col("h"), ["h", "i"], slices=8)
    assert max(r["count"] for r in o.df.groupBy("_slice").count().collect()) < 600
    got = o.ordinal("n").run_groups(F.col("k"), "g").result().orderBy("h", "i").collect()
    g = -1
    for n, (r, row) in enumerate(zip(got, rows)):
        g += n == 0 or rows[n - 1][2] != row[2]
        assert (r.h, r.i, r.n, r.g) == (row[0], row[1], n, g)


def test_ordered_null_keys(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "a"), (4, None)], "i long, k string")
    got = Ordered(df, F.col("i"), ["i"], slices=3).run_groups(F.col("k"), "g").result().orderBy("i").collect()
    assert [r.g for r in got] == [0, 0, 1, 2]


def test_ranges(spark):
    df = spark.range(20).withColumnRenamed("id", "obj_ord")
    got = [(r.seq, r.obj_ord) for r in select.by_ordinal(df, "obj_ord", "3,5-7,3").orderBy("seq", "obj_ord").collect()]
    assert got == [(0, 3), (1, 5), (1, 6), (2, 3)]
    for bad in ("5-5", "5-3", "x", "1,", "-2"):
        with pytest.raises(ValueError):
            select.parse_ranges(bad)


def test_prefixes(spark):
    assert [one(spark, select.prefix_key(F.lit(s), ":", 2)) for s in ("a:b:c", "a:b", "a", ":x:y")] == ["a:b", "a:b", "a", ":x"]
    assert one(spark, select.prefix_key(F.lit("a\tb\tc"), "\\t", 1)) == "a" and one(spark, select.identifier(F.lit("id rest"))) == "id"


# --- pairs and joins -----------------------------------------------------------------------


def test_zip_checks_counts(spark):
    f = spark.createDataFrame([(0, "a"), (1, "b")], "obj_ord long, s string")
    r = spark.createDataFrame([(0, "x")], "obj_ord long, s string")
    assert joins.zip_by_ordinal(f, r).count() == 1
    with pytest.raises(Exception, match="differ"):
        joins.zip_by_ordinal(f, r, check=True).collect()


def test_pairs(spark):
    df = spark.createDataFrame([("g", 0, True), ("g", 1, False), ("g", 2, True), ("g", 3, True)], "g string, i int, first boolean")
    assert tuple(joins.pairs_from_flags(df, "g", ["i"], F.col("first")).collect()[0]) == ("g", 4, 1, 1)
    runs = spark.createDataFrame([(0, "a"), (0, "a"), (1, "b"), (2, "c"), (2, "c"), (2, "c")], "run int, k string")
    assert sorted(r.state for r in joins.pairs_by_identity(runs, "run", "k").collect()) == ["extra", "lone", "pair"]


def test_compose_maps(spark):
    cols = "a long, as_ long, ae long, b long, bs long, be long"
    ab = spark.createDataFrame([(1, 0, 100, 7, 50, 150), (2, 0, 10, 8, 0, 10)], cols)
    bc = spark.createDataFrame([(7, 100, 200, 9, 1000, 1100), (7, 0, 60, 9, 5, 65)], cols)
    assert sorted(map(tuple, joins.compose_maps(ab, bc, 4).collect())) == [(1, 0, 10, 9, 55, 65), (1, 50, 100, 9, 1000, 1050)]


def test_database_flags(spark):
    rows = [(1, i, c, n) for i, (c, n) in enumerate([(False, 5), (True, 50), (True, 60), (False, 70), (True, 80)])]
    df = spark.createDataFrame(rows, "w int, i int, css boolean, n int")
    got = joins.reset_chain_flags(df, "w", ["i"], F.col("css"), F.col("n") >= 10).orderBy("i").collect()
    assert [(r.i, r.chained_after) for r in got] == [(1, False), (2, True), (3, False), (4, True)]


# --- barcodes ------------------------------------------------------------------------------


def test_repairs_against_definition(spark):
    rng = random.Random(9)
    codes = ["".join(p) for p in itertools.product("ACGT", repeat=4)]
    reads = [(c,) for c in codes for _ in range(rng.choice([0, 0, 1, 2, 6]))]
    n = {}
    for (c,) in reads:
        n[c] = n.get(c, 0) + 1
    valid = {c for c, k in n.items() if k >= 6}
    near = lambda a, b: sum(x != y for x, y in zip(a, b)) == 1
    want = {}
    for c in n:
        found = [v for v in valid if near(c, v)]
        want[c] = c if c in valid else found[0] if len(found) == 1 else None
    got = barcodes.repairs(barcodes.counts(spark.createDataFrame(reads, "code string"), "code"), 6, 4)
    assert {r.code: r.corrected for r in got.collect()} == want
    s = barcodes.summary(got).collect()[0]
    assert (s.n_valid_codes, s.n_valid) == (len(valid), sum(n[c] for c in valid)) and s.n_valid + s.n_repaired + s.n_dropped == len(reads)


def test_buckets(spark):
    assert [one(spark, barcodes.bucket(F.lit(n))) for n in (1, 49, 50, 59, 999, 1000, 10**6)] == [1, 49, 50, 50, 990, 1000, 1000]


# --- filters -------------------------------------------------------------------------------


@pytest.mark.parametrize("text", ["", "ln", "ln>", "ln>1 ln<2", "(ln>1", "ln>1)", "xx>1", "ln=1", "ln>-1", "!ln>1", "ln>1 &&", "ln>1 | ln<2"])
def test_filter_errors(text):
    with pytest.raises((ValueError, IndexError)):
        expr.parse(text, {"ln": F.lit(1)})


def test_filters(spark):
    df = spark.createDataFrame([(600, 800, 1, 2), (400, 900, 3, 3), (600, 700, 3, None)], "ln int, rq int, np int, bc1 int")
    keep = lambda t, **k: [r.ln for r in expr.keep(df, t, **k).collect()]
    assert keep(expr.DEFAULT) == [600] and keep("ln < 500 || rq<=700") == [400, 600] and keep("np == bc1") == [400]
    assert keep("ln>=600 && rq>750 || np==3") == [600, 400, 600] and keep("ln>=600 && (rq>750 || np==3)") == [600, 600] and keep("500 < ln") == [600, 600]
    with pytest.raises(Exception, match="lacks bc1"):
        keep("bc1 > 0", required=True)
    assert one(spark, expr.rq_of(F.lit(0.85).cast("float"))) == int(850.0)


# --- intervals -----------------------------------------------------------------------------


def test_overlaps_and_merges(spark):
    rng = random.Random(4)
    make = lambda n: [(rng.choice("xy"), b := rng.randint(0, 3000), b + rng.choice([0, 1, 50, 900])) for _ in range(n)]
    left, right = make(120), make(120)
    df = lambda rows: spark.createDataFrame(rows, "c string, beg long, end long")
    got = sorted(map(tuple, intervals.overlap_join(df(left), df(right), "c", 6).select("l_c", "l_beg", "l_end", "r_beg", "r_end").collect()))
    assert got == sorted((a[0], a[1], a[2], b[1], b[2]) for a in left for b in right if a[0] == b[0] and a[1] <= b[2] and b[1] <= a[2])
    want = []
    for c in "xy":
        for _, b, e in sorted(x for x in left if x[0] == c):
            if want and want[-1][0] == c and want[-1][2] >= b:
                want[-1] = (c, want[-1][1], max(e, want[-1][2]))
            else:
                want.append((c, b, e))
    assert sorted(tuple(r)[:3] for r in intervals.merge(df(left), "c").collect()) == want
    sites = spark.createDataFrame([(c, p) for c in "xyz" for p in range(0, 4000, 13)], "chrom string, pos long")
    some = df(right).withColumnRenamed("c", "chrom")
    assert sorted(map(tuple, variants.restricted(sites, some, 7).collect())) == [(c, p) for c in "xyz" for p in range(0, 4000, 13) if any(r[0] == c and r[1] <= p <= r[2] for r in right)]


@pytest.mark.parametrize("text, want", [("chr1", ("chr1", None, None)), ("chr1:5", ("chr1", 5, None)), ("chr1:5-", ("chr1", 5, None)), ("c:1,000-2k", ("c", 1000, 2000)), ("c:1.5M-2e6", ("c", 1500000, 2000000)), ("c:1.5-2", ("c", 1, 2)), ("HLA:1:5-6", ("HLA:1", 5, 6))])
def test_regions(spark, text, want):
    assert tuple(one(spark, intervals.parse_region(F.lit(text)))) == want


def test_bins(spark):
    assert [one(spark, intervals.ucsc_bin(F.lit(a), F.lit(b))) for a, b in ((0, 1), (16383, 16385), (0, 1 << 29), (1 << 14, 1 << 15))] == [4681, 585, 0, 4682]
    assert [tuple(one(spark, intervals.bed_row(F.lit(s)))) for s in ("c\t5\t9\tn", "c")] == [("c", 5, 8, "n"), ("c", 0, (1 << 31) - 2, None)]


# --- pileup --------------------------------------------------------------------------------


def test_depth(spark):
    reads = spark.createDataFrame([("c", 1, "3M2D2M"), ("c", 2, "2M1I2M"), ("c", 3, "1S2M2N1M"), ("c", 9, "*")], "chrom string, pos long, cigar string")
    got = {r.ref_pos: (r.depth, r.n_del, r.n_skip) for r in align.depth(reads).collect()}
    assert got == {1: (1, 0, 0), 2: (2, 0, 0), 3: (3, 0, 0), 4: (3, 1, 0), 5: (2, 1, 1), 6: (1, 0, 1), 7: (2, 0, 0)}
    at = {(r.pos, r.ref_pos): r.query_pos for r in align.positions(reads).collect()}
    assert at[2, 4] == 3 and at[1, 4] is None and at[3, 3] == 1
    assert max(r.depth for r in align.depth(reads, cap=2).collect()) == 2


def test_fetch(spark):
    s = spark.createDataFrame([("a", "acgtacgt")], "name string, seq string")
    r = spark.createDataFrame([("a", 2, 4), ("a", -3, 1), ("a", 6, 99), ("a", 20, 30)], "name string, beg long, end long")
    assert sorted(x.piece for x in align.fetch(s, r).collect()) == ["", "ac", "gt", "gta"]


# --- variants ------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "ref, alt, want",
    [("A", "C", (1, 1)), ("AC", "GT", (2, 2)), ("A", "AT", (4, 1)), ("ATT", "A", (4, -2)), ("A", "<X>", (0, 0)), ("A", "a", (0, 0)), ("A", "*", (32, 0)), ("A", "A[c:5[", (16, 0)), ("A", "<DEL>", (8, 0)), ("ACG", "AtG", (1, 1)), ("AC", "GTA", (8, 1))],
)
def test_variant_types(spark, ref, alt, want):
    assert tuple(one(spark, variants.variant_type(F.lit(ref), F.lit(alt)))) == want


def test_genotypes(spark):
    got = [one(spark, variants.genotype_class(F.lit(g))) for g in ("0/0", "1/1", "0/1", "1|2", "0", "3", "./1", ".")]
    assert got == [0, 1, 2, 3, 4, 5, 6, 6]
    alts, gts = F.array(*map(F.lit, ("C", "G", "T"))), F.array(*map(F.lit, ("0/3", "3|.", "0/0")))
    t = one(spark, variants.trim_alleles(alts, gts))
    assert (t.alts, t.genotypes) == (["T"], ["0/1", "1|.", "0/0"])
    r = one(spark, variants.remove_alleles(alts, F.array(F.lit("1/3"), F.lit("2|0")), F.array(F.lit(1))))
    assert (r.alts, r.genotypes) == (["G", "T"], ["./2", "1|0"])
    gone = F.array(F.lit(1))
    assert one(spark, variants.per_allele(F.array(*map(F.lit, (10, 20))), gone)) == [20]
    assert one(spark, variants.per_allele(F.array(*map(F.lit, (5, 10, 20))), gone, "R")) == [5, 20]
    assert one(spark, variants.per_allele(F.array(*map(F.lit, ("00", "01", "11", "02", "12", "22"))), gone, "G")) == ["00", "02", "22"]


def test_allele_counts(spark):
    df = spark.createDataFrame([(1, ["0/1", "1/1", "./."], None, None), (2, ["0/0"], [3, 1], 10)], "pos int, gt array<string>, ac array<int>, an int")
    got = sorted(map(tuple, variants.allele_counts(df, ["pos"], "gt", "ac", "an").collect()))
    assert got == [(1, 0, 1), (1, 1, 3), (2, 0, 6), (2, 1, 3), (2, 2, 1)]


def test_synced_modes(spark):
    cols = "chrom string, pos int, ref string, alt string, kind int"
    left = spark.createDataFrame([("c", 1, "A", "C", 1), ("c", 2, "A", "AT", 4), ("c", 3, "A", "C,G", 1), ("c", 4, "A", ".", 0)], cols)
    right = spark.createDataFrame([("c", 1, "A", "G", 1), ("c", 2, "A", "AC", 4), ("c", 3, "A", "G,T", 1), ("c", 4, "A", "T", 1)], cols)

    def pairs(mode):
        return sorted(r.pos for r in variants.synced(left, right, mode).collect() if r.l_alt and r.r_alt)

    assert pairs("exact") == [] and pairs("any") == [1, 2, 3, 4] and pairs("snps") == [1, 3] and pairs("indels") == [2]
    assert pairs("both") == [1, 2, 3] and pairs("snps_ref") == [1, 3, 4] and pairs("indels_ref") == [2] and pairs("both_ref") == [1, 2, 3, 4] and pairs("some") == [3]
    assert variants.synced(left, right, "some").count() == 7


def test_filters_and_info(spark):
    f = F.array(F.lit("q10"))
    assert one(spark, variants.add_filter(f, "s50")) == ["q10", "s50"] and one(spark, variants.add_filter(f, "PASS")) == [] and one(spark, variants.remove_filter(f, "q10")) == []
    assert one(spark, variants.has_filter(f, "PASS")) is False
    info = F.create_map(F.lit("DP"), F.lit("1"))
    assert one(spark, variants.update_info(info, "DP", F.lit("2"))) == {"DP": "2"} and one(spark, variants.update_info(info, "DP", None)) == {}


@pytest.mark.parametrize("cells, want", [((12, 5, 29, 2), (0.04455, 0.99453, 0.08026)), ((0, 0, 5, 6), (1, 1, 1)), ((3, 1, 1, 3), (0.98571, 0.24286, 0.48571)), ((10, 0, 0, 10), (1, 0.0000054, 0.0000108))])
def test_fisher(spark, cells, want):
    r = one(spark, variants.fisher(*map(F.lit, cells)))
    assert (r.left, r.right, r.two) == pytest.approx(want, abs=2e-5)


# --- statistics and rules ------------------------------------------------------------------


def test_statistics_with_nulls(spark):
    df = spark.createDataFrame([(None, 9), ("a", 2), ("a", None), ("b", 3)], "g string, n int")
    r = stats.header_counts(df, "g", "n", "S").collect()[0]
    assert (r.n_lines, r.max_len, r.total_len, r.group_max_count, r.group_max_total) == (4, 9, 14, 2, 3)
    assert tuple(stats.totals(df, "n").collect()[0]) == (4, 14, 9)
    empty = df.limit(0)
    assert tuple(stats.totals(empty, "n").collect()[0]) == (0, 0, 0)


def test_rules(spark):
    df = spark.createDataFrame([(1, "acgt", "II~", "11"), (2, "ac", "I ", "15"), (3, "ac", None, None)], "k int, S string, Q string, A string")
    got = sorted(map(tuple, validate.faults(df, ["k"], validate.sequence_rules()).collect()))
    assert got == [(1, "pulse widths and sequence differ in length"), (1, "quality and sequence differ in length"), (2, "a pulse width is not 1 to 4"), (2, "a quality letter is out of range")]
    a = spark.createDataFrame([(0, 10, 0, 20, 5, 0, [3, 6]), (5, 3, 2, 0, 9, 5, None), (0, 10, 10, 0, 10, 10, [3, 3])], "as_ int, ae int, alen int, bs int, be int, blen int, u array<int>")
    got = sorted(r.fault for r in validate.faults(a, ["as_"], validate.alignment_rules("as_", "ae", "alen", "bs", "be", "blen", "u")).collect())
    assert got == ["a ends before it begins", "a leaves its sequence", "b leaves its sequence", "trace points do not rise from beginning to end"]
    m = spark.createDataFrame([(10, [1, 5, 4], [1, 1, 1], [1.0], [1.0, 1.0, 1.0]), (3, [1, 5], [1, 1], [1.0, 1.0], [1.0, 1.0])], "n int, r array<int>, e array<int>, i array<double>, s array<double>")
    assert sorted(r.fault for r in validate.faults(m, ["n"], validate.map_rules("n", "r", "e", "i", "s")).collect()) == ["a site lies beyond the end", "intensities and sites differ in number", "sites are out of order"]


def test_intervals_over_many_bins(spark):
    """Merging and joining across bin borders and levels, with hot names, equal and whole-chromosome intervals, against brute force."""
    from strandframe.operators import intervals

    rng = random.Random(5)
    rows = [(rng.choice(["a", "a", "a", "b", None]), b, b + rng.choice([0, 3, 40, 700, 90_000])) for b in (rng.randrange(400_000) for _ in range(400))] + [("a", 5, 9), ("a", 5, 9), ("b", 0, (1 << 31) - 1), ("c", 10, 5)]
    df = spark.createDataFrame(rows, "chrom string, beg long, end long")
    want = []
    for name in {r[0] for r in rows}:
        open_ = None
        for _, b, e in sorted(r for r in rows if r[0] == name and r[0] != "c"):
            if open_ and b <= open_[1]:
                open_ = (open_[0], max(open_[1], e), open_[2] + 1)
            else:
                want += [(name, *open_)] if open_ else []
                open_ = (b, e, 1)
        want += [(name, *open_)] if open_ else []
    got = [tuple(r) for r in intervals.merge(df.filter("chrom is null or chrom <> 'c'"), "chrom", shift=10).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    left, right = df.withColumn("i", F.monotonically_increasing_id()), df.withColumn("j", F.monotonically_increasing_id())
    pairs = [(r.l_i, r.r_j) for r in intervals.overlap_join(left, right, "chrom", shift=8).collect()]
    one, two = left.collect(), right.collect()
    assert sorted(pairs) == sorted((x.i, y.j) for x in one for y in two if x.chrom is not None and x.chrom == y.chrom and x.beg <= x.end and y.beg <= y.end and x.beg <= y.end and y.beg <= x.end)


def test_order_in_many_slices(spark):
    from strandframe.operators.ordered import Ordered, _below, in_ranges

    cuts = list(range(0, 170, 10))
    got = spark.range(200).select("id", _below([F.lit(c) for c in cuts], lambda c: c < F.col("id")).alias("n")).collect()
    assert all(r.n == sum(c < r.id for c in cuts) for r in got)
    df = spark.range(5000).select(F.expr("cast(pow(id % 997, 2) as long) + id").alias("k"))
    out = Ordered(df, F.col("k"), ["k"], slices=37).ordinal().result().collect()
    assert [r.obj_ord for r in sorted(out, key=lambda r: r.k)] == list(range(5000))
    cells = spark.createDataFrame([("a", 0, 3), ("b", 3, 3), ("c", 3, 4000), ("d", 4500, 9000)], "cell string, lo long, hi long")
    found = in_ranges(spark.range(5000).withColumnRenamed("id", "ord"), "ord", cells, "lo", "hi").groupBy("cell").count().collect()
    assert {r["cell"]: r["count"] for r in found} == {"a": 3, "c": 3997, "d": 500}


def test_mutation_follows_its_chances(spark):
    """Letter by letter against the same hashes in Python, at rates between 0 and 1."""
    import xxhash

    def hashed(seed: int, i: int, k: int) -> int:
        h = 42
        for v, n in ((seed, 8), (i, 4), (k, 4)):
            h = xxhash.xxh64_intdigest(v.to_bytes(n, "little", signed=True), h)
        return h - (1 << 64) if h >> 63 else h

    def chance(seed, i, k):
        return hashed(seed, i, k) % (1 << 30) / float(1 << 30)

    text, insert, delete, swap = "acgtacgttgca" * 20, 0.1, 0.2, 0.3
    for seed in (1, 77):
        want = []
        for i, c in enumerate(text):
            u = chance(seed, i, 0)
            if u < delete:
                continue
            if u < delete + swap:
                want.append([x for x in "acgt" if x != c][int(chance(seed, i, 1) * 3)])
            elif u < delete + swap + insert:
                want.append("acgt"[int(chance(seed, i, 2) * 4)] + c)
            else:
                want.append(c)
        got = spark.range(1).select(samplers.mutate(F.lit(text), F.lit(seed).cast("long"), insert, delete, swap).alias("v")).first().v
        assert got == "".join(want) and len(got) != len(text)


def test_poisson_range(spark):
    assert 640 < one(spark, samplers.poisson(F.lit(0.5), 700.0)) < 760 and one(spark, samplers.poisson(F.lit(0.5), 0.0)) == 0
    with pytest.raises(ValueError):
        samplers.poisson(F.lit(0.5), 800.0)


def test_program_chain_and_cells(spark):
    from strandframe.sources import records

    pg = [("PG", {"ID": f"p{i}", "PP": f"p{i + 1}"} if i < 99 else {"ID": "p99"}) for i in range(100)]
    head = spark.createDataFrame(pg, "record string, fields map<string,string>")
    assert records.program_chain(head, "p0").count() == 100
    with pytest.raises(ValueError, match="ring"):
        records.program_chain(spark.createDataFrame([("PG", {"ID": "a", "PP": "b"}), ("PG", {"ID": "b", "PP": "a"})], "record string, fields map<string,string>"), "a")


def test_special_functions(spark):
    import math

    from strandframe.functions import special

    z = [1e-3, 0.3, 1.0, 2.5, 40.0, 900.0]
    got = spark.createDataFrame([(v,) for v in z], "z double").select(special.log_gamma(F.col("z")).alias("g"), special.erfc(F.col("z")).alias("e"), special.erfc(-F.col("z")).alias("n"), special.gamma_p(F.lit(300.0), F.col("z")).alias("p")).collect()
    for v, r in zip(z, got):
        assert r.g == pytest.approx(math.lgamma(v), rel=1e-9, abs=1e-9) and r.e == pytest.approx(math.erfc(v), rel=1e-9, abs=1e-300) and r.n == pytest.approx(math.erfc(-v))
        assert r.p == pytest.approx(0.0 if v < 100 else 1.0, abs=1e-9)
