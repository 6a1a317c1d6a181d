"""Work and memory that follow the input, and values beyond what small tables hold."""

from __future__ import annotations

import math
import time

import duckdb
import pytest
from helpers import rows_of
from pyspark.sql import functions as F

from strandframe.functions import samplers
from strandframe.functions import scalars as X
from strandframe.operators import align, intervals, variants
from strandframe.plans.queries import QUERIES


def test_capped_pile_spells_out_few_reads(spark, monkeypatch):
    """Of reads alike no more than the cap are spelled out, and the first ones by the order are kept."""
    rows = [("c", k % 7, ("2M1D2M", "3M", "1M2N1M")[k % 3], (k * 37) % 1000) for k in range(2000)]
    reads = spark.createDataFrame(rows, "chrom string, pos long, cigar string, name long")
    seen, whole = [], align.positions
    monkeypatch.setattr(align, "positions", lambda df, *a: seen.append(df.count()) or whole(df, *a))
    got = {r.ref_pos: (r.depth, r.n_del, r.n_skip) for r in align.depth(reads, cap=4, order=["name", "pos", "cigar", "kind"]).collect()}
    at = {}
    for _, pos, cigar, name in rows:
        for i, kind in enumerate({"2M1D2M": "MMDMM", "3M": "MMM", "1M2N1M": "MNNM"}[cigar]):
            at.setdefault(pos + i, []).append((name, pos, cigar, kind))
    first = {p: [r[3] for r in sorted(v)[:4]] for p, v in at.items()}
    assert got == {p: (sum(k != "N" for k in v), v.count("D"), v.count("N")) for p, v in first.items()}
    assert seen == [4 * 7 * 3]


@pytest.mark.parametrize("cells", [(3, 5, 4, 9), (0, 7, 9, 2), (30, 2, 1, 40), (0, 0, 5, 6), (1200, 1100, 900, 1000), (40_000, 39_500, 39_900, 40_100)])
def test_fisher_of_large_tables(spark, cells):
    """The work grows with the number of possible tables, not with its square."""
    a, b, c, d = cells
    lf = [0.0]
    for i in range(1, sum(cells) + 1):
        lf.append(lf[-1] + math.log(i))
    choose = lambda n, k: lf[n] - lf[k] - lf[n - k]
    p = {i: math.exp(choose(a + b, i) + choose(c + d, a + c - i) - choose(a + b + c + d, a + c)) for i in range(max(0, a - d), min(a + b, a + c) + 1)}
    began = time.time()
    r = spark.createDataFrame([cells], "a long, b long, c long, d long").select(variants.fisher(*map(F.col, "abcd")).alias("r")).first().r
    assert time.time() - began < 60
    want = [sum(v for i, v in p.items() if i <= a), sum(v for i, v in p.items() if i >= a), sum(v for v in p.values() if v <= p[a] * (1 + 1e-7))]
    assert list(r) == pytest.approx([min(1.0, w) for w in want], rel=1e-6, abs=1e-12)


def test_varint_of_products_beyond_64_bits(spark, tmp_path):
    rows = [(5000, 2, 1 << 40, 1 << 40), (900_000, 2, 120_000, 6_000), (1, 3, 120_000, 1 << 40), (5001, 1, 1 << 40, 1 << 40), (None, 2, 1, 1), (5000, 2, None, 1 << 62)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert {r.bytes: r.n for r in QUERIES["varint_bytes"](spark, str(tmp_path)).collect()} == {1: 2, 9: 4}
    assert spark.range(1).select(X.product(F.lit(3), F.lit(-5)), X.product(F.lit(1 << 40), F.lit(1 << 40), F.lit(0)), X.product(F.lit(1 << 40), F.lit(1 << 40))).first()[:] == (-15, 0, None)
    assert spark.range(1).select(X.product(F.lit((1 << 62) - 1), F.lit(2)), X.product(F.lit(1 << 62), F.lit(2))).first()[:] == ((1 << 63) - 2, None)


def test_mutate_draws_letters_at_once(spark, monkeypatch):
    """The same letters as from Spark's hash of each place, in slices, of texts with any letters; no fold over letters is left."""
    text = "acgtnACé𝄞 -t" * 9000
    df = spark.createDataFrame([(7, text), (8, ""), (9, None)], "k long, s string")
    out = df.select("k", samplers.mutate(F.col("s"), F.col("k"), 0.1, 0.2, 0.3).alias("v"))
    assert "lambda" not in out._jdf.queryExecution().toString()
    got = {r.k: r.v for r in out.collect()}
    h = spark.range(len(text)).select("id", *[(F.pmod(F.xxhash64(F.lit(7).cast("long"), F.col("id").cast("int"), F.lit(k)), F.lit(1 << 30)) / float(1 << 30)).alias(f"u{k}") for k in range(3)]).orderBy("id").collect()
    want = []
    for c, (_, u, v, w) in zip(text, h):
        other = [x for x in "acgt" if x != c]
        want.append("" if u < 0.2 else other[int(v * 3)] if u < 0.2 + 0.3 else "acgt"[int(w * 4)] + c if u < 0.2 + 0.3 + 0.1 else c)
    assert got == {7: "".join(want), 8: "", 9: None}
    pairs = spark.createDataFrame([("acgt", "aggx"), ("é𝄞a", "ét"), ("", ""), (None, "a")], "a string, b string")
    assert [r[0] for r in pairs.select(samplers.differing(F.col("a"), F.col("b"), "acgt")).collect()] == [1, 1, 0, None]


def test_alleles_are_read_once(spark):
    """The alleles in use are found once a row, not once a letter of a genotype."""
    df = spark.createDataFrame([(["0/3", "3|.", "1"],)], "g array<string>")
    alts = F.array(*map(F.lit, "ACG"))
    out = df.withColumn("t", variants.trim_alleles(alts, F.col("g"))).select("t.alts", "t.genotypes")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("[/|]") == 2  # alleles() and _parts()
    assert out.first()[:] == (["A", "G"], ["0/2", "2|.", "1"])
    out = df.withColumn("t", variants.remove_alleles(alts, F.col("g"), F.array(F.lit(1)))).select("t.alts", "t.genotypes")
    assert out.first()[:] == (["C", "G"], ["0/2", "2|.", "."])


def test_merge_deals_rows_out(spark, monkeypatch):
    """As many tasks as the rows ask for; nulls and ends before begins are treated as in SQL."""
    monkeypatch.setattr(intervals, "TASK_ROWS", 20)
    rows = [(k % 4 or None, None if k % 41 == 0 else k * 37 % 900, None if k % 13 == 0 else k * 37 % 900 + (k * 7 % 60) - 5) for k in range(700)]
    rows += [("x", 5, None), ("x", 5, 7), ("x", 5000, 3), ("x", None, 6000), ("x", 6, 4), ("x", 100, 4000), ("x", 4500, None)]
    rows = [(str(c) if c else None, b, e) for c, b, e in rows]
    df = spark.createDataFrame(rows, "c string, beg long, end long")
    out = intervals.merge(df, "c", shift=5)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") > 1 and all(line.rstrip().endswith(f", {-(-len(rows) // 20)}") for line in plan.splitlines() if "RepartitionByExpression" in line)
    con = duckdb.connect()
    con.register("t", df.toArrow())
    sql = """WITH b AS (SELECT *, max("end") OVER (PARTITION BY c ORDER BY beg, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM t),
        g AS (SELECT *, sum(CASE WHEN before >= beg THEN 0 ELSE 1 END) OVER (PARTITION BY c ORDER BY beg, "end" ROWS UNBOUNDED PRECEDING) AS island FROM b)
        SELECT c, min(beg) AS beg, max("end") AS "end", count(*) AS n FROM g GROUP BY c, island"""
    assert rows_of(out.toArrow()) == rows_of(con.execute(sql).to_arrow_table())
