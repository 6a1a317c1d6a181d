"""Queries of intervals, alignments and variants."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandframe.functions import scalars as X
from strandframe.operators import align, intervals, variants
from strandframe.plans.registry import query, table

_IV = "l_suppkey AS on_, l_orderkey AS beg, l_orderkey + CAST(l_quantity AS BIGINT) * 10 AS e, l_partkey AS p, l_linenumber AS ln"


@query(f"""
WITH i AS (SELECT {_IV} FROM lineitem)
SELECT a.on_ AS l_on, count(*) AS n, CAST(sum(least(a.e, b.e) - greatest(a.beg, b.beg) + 1) AS BIGINT) AS shared
FROM i a JOIN i b ON a.on_ = b.on_ AND a.ln % 2 = 1 AND b.ln % 2 = 0 AND a.beg <= b.e AND b.beg <= a.e GROUP BY 1""")
def interval_overlap(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("on"), F.col("l_orderkey").alias("beg"), (F.col("l_orderkey") + F.col("l_quantity").cast("long") * 10).alias("end"), "l_linenumber")
    side = lambda n: li.filter(F.col("l_linenumber") % 2 == n).select("on", "beg", "end")
    both = intervals.overlap_join(side(1), side(0), "on", shift=9)
    shared = F.least("l_end", "r_end") - F.greatest("l_beg", "r_beg") + 1
    return both.groupBy("l_on").agg(F.count("*").alias("n"), F.sum(shared).alias("shared"))


@query(f"""
WITH i AS (SELECT {_IV} FROM lineitem),
     b AS (SELECT *, max(e) OVER (PARTITION BY on_ ORDER BY beg, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM i),
     g AS (SELECT *, sum(CASE WHEN before >= beg THEN 0 ELSE 1 END) OVER (PARTITION BY on_ ORDER BY beg, e ROWS UNBOUNDED PRECEDING) AS island FROM b)
SELECT on_ AS l_suppkey, min(beg) AS beg, max(e) AS "end", count(*) AS n FROM g GROUP BY on_, island""")
def interval_merge(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_orderkey").alias("beg"), (F.col("l_orderkey") + F.col("l_quantity").cast("long") * 10).alias("end"))
    return intervals.merge(li, "l_suppkey")


@query("""
SELECT o_orderkey, 'chr' || CAST(o_custkey % 24 AS VARCHAR) AS chrom, (o_orderkey + 1) * CASE o_orderstatus WHEN 'F' THEN 1000 WHEN 'O' THEN 1 ELSE 1000000 END AS beg,
       CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE (o_orderkey + 2) * 1000000 END AS "end" FROM orders""")
def region_parse(spark, sf_dir):
    key, unit = F.col("o_orderkey"), F.when(F.col("o_orderstatus") == "F", "k").when(F.col("o_orderstatus") == "O", "").otherwise("M")
    text = F.concat(F.lit("chr"), (F.col("o_custkey") % 24).cast("string"), F.lit(":"), F.format_number(key + 1, 0), unit, F.when(key % 3 == 0, F.when(key % 2 == 0, "-").otherwise("")).otherwise(F.concat(F.lit("-"), (key + 2).cast("string"), F.lit("e6"))))
    return table(spark, sf_dir, "orders").select("o_orderkey", intervals.parse_region(text).alias("r")).select("o_orderkey", "r.*")


@query("SELECT l_returnflag AS ref, count(*) FILTER (l_linenumber % 4 <> 0) AS n_mapped, count(*) FILTER (l_linenumber % 4 = 0) AS n_unmapped FROM lineitem GROUP BY 1")
def index_stats(spark, sf_dir):
    return align.index_stats(table(spark, sf_dir, "lineitem").withColumnRenamed("l_returnflag", "ref"), "ref", F.col("l_linenumber") % 4 == 0)


_LAST = "((b + CAST(l_quantity AS BIGINT) * 100) - 1)"
_BINS = " ".join(f"WHEN b >> {14 + 3 * (5 - k)} = {_LAST} >> {14 + 3 * (5 - k)} THEN {((1 << 3 * k) - 1) // 7} + (b >> {14 + 3 * (5 - k)})" for k in range(5, 0, -1))


@query(f"SELECT CASE {_BINS} ELSE 0 END AS bin, count(*) AS n FROM (SELECT *, l_orderkey * 3000 AS b FROM lineitem) GROUP BY 1")
def region_bins(spark, sf_dir):
    b = F.col("l_orderkey") * 3000
    return table(spark, sf_dir, "lineitem").groupBy(intervals.ucsc_bin(b, b + F.col("l_quantity").cast("long") * 100).alias("bin")).agg(F.count("*").alias("n"))


def _cigars(spark, sf_dir):
    q = F.col("l_quantity").cast("int").cast("string")
    n = F.col("l_linenumber").cast("string")
    cigar = F.concat(n, F.lit("S"), q, F.lit("M"), n, F.lit("D"), F.lit("2I"), q, F.lit("M"), F.lit("3N1="), F.lit("4H"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", cigar.alias("cigar"), (F.col("l_orderkey") % 1000).alias("pos"), ((F.col("l_linenumber") % 2) * 4).alias("flag"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_linenumber + 2 * q + 3 AS qlen, 2 * q + l_linenumber + 4 AS rlen,
       l_orderkey % 1000 + CASE WHEN l_linenumber % 2 = 1 THEN 1 ELSE 2 * q + l_linenumber + 4 END AS e
FROM (SELECT *, CAST(l_quantity AS BIGINT) AS q FROM lineitem)""")
def cigar_lengths(spark, sf_dir):
    c = _cigars(spark, sf_dir)
    return c.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", X.query_length(F.col("cigar")).alias("qlen"), X.reference_length(F.col("cigar")).alias("rlen"), X.end_position(F.col("pos"), F.col("cigar"), F.col("flag")).alias("e"))


_PILE = """
WITH r AS (SELECT l_returnflag AS chrom, l_orderkey % 1000 AS pos, CAST(l_quantity AS BIGINT) AS q, l_suppkey % 3 AS file, l_linenumber AS ln, l_orderkey, l_partkey, l_suppkey, l_extendedprice FROM lineitem),
     p AS (SELECT *, unnest(generate_series(pos, pos + q - 1)) AS ref_pos, 'M' AS kind FROM r UNION ALL
           SELECT *, unnest(generate_series(pos + q, pos + q + 1)), 'D' FROM r UNION ALL
           SELECT *, unnest(generate_series(pos + q + 2, pos + q + 4)), 'M' FROM r)"""


def _pile(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    cigar = F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit("M1I2D3M"))
    return li.select(F.col("l_returnflag").alias("chrom"), (F.col("l_orderkey") % 1000).alias("pos"), cigar.alias("cigar"), (F.col("l_suppkey") % 3).alias("file"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


@query(f"{_PILE} SELECT chrom, ref_pos, count(*) AS depth, count(*) FILTER (kind = 'D') AS n_del, CAST(0 AS BIGINT) AS n_skip FROM p GROUP BY 1, 2")
def pileup_depth(spark, sf_dir):
    return align.depth(_pile(spark, sf_dir))


@query(f"""{_PILE}, c AS (SELECT *, row_number() OVER (PARTITION BY chrom, ref_pos ORDER BY pos, l_orderkey, ln, l_partkey, l_suppkey, l_extendedprice, kind) AS rn FROM p)
SELECT chrom, ref_pos, count(*) AS depth, count(*) FILTER (kind = 'D') AS n_del, CAST(0 AS BIGINT) AS n_skip FROM c WHERE rn <= 5 GROUP BY 1, 2""")
def pileup_capped(spark, sf_dir):
    return align.depth(_pile(spark, sf_dir), cap=5, order=["pos", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "kind"])


@query(f"{_PILE} SELECT chrom, ref_pos, count(*) FILTER (file = 0) AS depth_0, count(*) FILTER (file = 1) AS depth_1, count(*) FILTER (file = 2) AS depth_2 FROM p GROUP BY 1, 2")
def pileup_multi(spark, sf_dir):
    return align.depth_by_file(_pile(spark, sf_dir), "file", [0, 1, 2])


@query("""
SELECT doc_id AS name, substr(text, CAST(doc_id % 50 + 1 AS INTEGER), 30) AS piece FROM documents WHERE text IS NOT NULL""")
def faidx_fetch(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter("text is not null").select(F.col("doc_id").alias("name"), "text")
    regions = docs.select("name", (F.col("name") % 50).alias("beg"), (F.col("name") % 50 + 29).alias("end"))
    return align.fetch(docs, regions, seq="text").select("name", "piece")


_REFALT = "substr(p_type, 1, CAST(p_partkey % 3 + 1 AS INTEGER)) AS ref, substr(p_type, 1, CAST(p_partkey % 2 + 1 AS INTEGER)) || substr(p_name, 1, CAST(p_size % 3 AS INTEGER)) AS alt"


@query(f"""
WITH a AS (SELECT p_partkey, lower(ref) AS r, lower(alt) AS a FROM (SELECT p_partkey, {_REFALT} FROM part)),
     h AS (SELECT *, least(length(r), length(a)) AS n, coalesce(list_max(list_filter(generate_series(0, least(length(r), length(a))), lambda i: substr(r, 1, CAST(i AS INTEGER)) = substr(a, 1, CAST(i AS INTEGER)))), 0) AS head FROM a),
     t AS (SELECT *, coalesce(list_max(list_filter(generate_series(0, n - head), lambda i: right(r, CAST(i AS INTEGER)) = right(a, CAST(i AS INTEGER)))), 0) AS tail FROM h),
     k AS (SELECT *, length(r) - head - tail AS rr, length(a) - head - tail AS ra FROM t)
SELECT p_partkey, CAST(CASE WHEN r = a THEN 0 WHEN rr = ra AND rr = 1 THEN 1 WHEN rr = ra THEN 2 WHEN rr = 0 OR ra = 0 THEN 4 ELSE 8 END AS INTEGER) AS type,
       CAST(CASE WHEN r = a THEN 0 WHEN rr = ra THEN rr ELSE length(a) - length(r) END AS INTEGER) AS n FROM k""")
def variant_type(spark, sf_dir):
    k = F.col("p_partkey")
    ref = F.expr("substring(p_type, 1, cast(p_partkey % 3 + 1 as int))")
    alt = F.expr("concat(substring(p_type, 1, cast(p_partkey % 2 + 1 as int)), substring(p_name, 1, p_size % 3))")
    return table(spark, sf_dir, "part").select(k, variants.variant_type(ref, alt).alias("v")).select("p_partkey", "v.type", "v.n")


def _genotypes(spark, sf_dir):
    part = lambda c: F.when(F.col(c) % 11 == 0, ".").otherwise((F.col(c) % 3).cast("string"))
    gt = F.when(F.col("l_linenumber") == 7, part("l_partkey")).otherwise(F.concat(part("l_partkey"), F.lit("/"), part("l_suppkey")))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("pos"), gt.alias("gt"))


_A, _B = [f"CASE WHEN {c} % 11 = 0 THEN NULL ELSE {c} % 3 END" for c in ("l_partkey", "l_suppkey")]


@query(f"""
WITH g AS (SELECT l_orderkey AS pos, {_A} AS a FROM lineitem UNION ALL SELECT l_orderkey, {_B} FROM lineitem WHERE l_linenumber <> 7)
SELECT pos, CAST(a AS INTEGER) AS allele, count(*) AS n FROM g WHERE a IS NOT NULL GROUP BY 1, 2""")
def allele_count(spark, sf_dir):
    sites = _genotypes(spark, sf_dir).groupBy("pos").agg(F.collect_list("gt").alias("gts"))
    return variants.allele_counts(sites, ["pos"], "gts")


@query(f"""
WITH g AS (SELECT {_A} AS a, {_B} AS b, l_linenumber = 7 AS hap FROM lineitem)
SELECT CAST(CASE WHEN a IS NULL OR (NOT hap AND b IS NULL) THEN 6 WHEN hap AND a = 0 THEN 4 WHEN hap THEN 5 WHEN a = 0 AND b = 0 THEN 0 WHEN a = 0 OR b = 0 THEN 2 WHEN a = b THEN 1 ELSE 3 END AS INTEGER) AS class, count(*) AS n
FROM g GROUP BY 1""")
def genotype_class(spark, sf_dir):
    return _genotypes(spark, sf_dir).groupBy(variants.genotype_class(F.col("gt")).alias("class")).agg(F.count("*").alias("n"))


_SIDES = """
WITH v AS (SELECT o_orderkey, o_custkey AS pos, o_orderstatus AS chrom, substr(o_orderpriority, 1, 1) AS ref, CAST(o_orderkey % 3 AS VARCHAR) AS alt FROM orders),
     l AS (SELECT * FROM v WHERE o_orderkey % 2 = 0), r AS (SELECT * FROM v WHERE o_orderkey % 3 = 0)"""


def _sides(spark, sf_dir):
    v = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("pos"), F.col("o_orderstatus").alias("chrom"), F.substring("o_orderpriority", 1, 1).alias("ref"), (F.col("o_orderkey") % 3).cast("string").alias("alt"), F.lit(1).alias("kind"))
    return v.filter("o_orderkey % 2 = 0"), v.filter("o_orderkey % 3 = 0")


def _synced(mode: str, on: str):
    sql = f"""{_SIDES} SELECT coalesce(l.chrom, r.chrom) AS chrom, coalesce(l.pos, r.pos) AS pos, l.o_orderkey AS l_o_orderkey, r.o_orderkey AS r_o_orderkey
FROM l FULL OUTER JOIN r ON l.chrom = r.chrom AND l.pos = r.pos {on}"""

    def run(spark, sf_dir):
        return variants.synced(*_sides(spark, sf_dir), mode).select("chrom", "pos", "l_o_orderkey", "r_o_orderkey")

    run.__name__ = "synced_join" if mode == "exact" else f"synced_join_{mode}"
    query(sql)(run)


_synced("exact", "AND l.ref = r.ref AND l.alt = r.alt")
_synced("any", "")


@query("""
WITH t AS (SELECT lang, count(*) FILTER (quality = 1 AND toxic = 1) AS a, count(*) FILTER (quality = 1 AND toxic = 0) AS b, count(*) FILTER (quality = 0 AND toxic = 1) AS c, count(*) FILTER (quality = 0 AND toxic = 0) AS d
           FROM labels JOIN documents USING (doc_id) GROUP BY lang),
     p AS (SELECT lang, a, b, c, d, unnest(generate_series(greatest(0, a + b + a + c - (a + b + c + d)), least(a + b, a + c))) AS i FROM t),
     q AS (SELECT *, exp(lgamma(a+b+1) - lgamma(i+1) - lgamma(a+b-i+1) + lgamma(c+d+1) - lgamma(a+c-i+1) - lgamma(c+d-a-c+i+1) - lgamma(a+b+c+d+1) + lgamma(a+c+1) + lgamma(b+d+1)) AS p FROM p),
     o AS (SELECT *, max(CASE WHEN i = a THEN p END) OVER (PARTITION BY lang) AS own FROM q)
SELECT lang, a, b, c, d, round(least(1, sum(p) FILTER (i <= a)), 6) AS p_left, round(least(1, sum(p) FILTER (i >= a)), 6) AS p_right, round(least(1, sum(p) FILTER (p <= own * (1 + 1e-7))), 6) AS p_two FROM o GROUP BY ALL""")
def fisher_exact(spark, sf_dir):
    both = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    n = lambda q, t: F.count_if((F.col("quality") == q) & (F.col("toxic") == t))
    t = both.groupBy("lang").agg(n(1, 1).alias("a"), n(1, 0).alias("b"), n(0, 1).alias("c"), n(0, 0).alias("d"))
    p = variants.fisher(*map(F.col, "abcd"))
    return t.withColumn("p", p).select("lang", "a", "b", "c", "d", *[F.round(f"p.{k}", 6).alias(f"p_{k}") for k in ("left", "right", "two")])


@query("""
WITH l AS (SELECT l_orderkey AS pos, l_linenumber AS ln, l_quantity AS q, CASE WHEN l_linestatus = 'O' THEN 'A' ELSE 'C' END AS base, l_partkey, l_suppkey, l_extendedprice FROM lineitem)
SELECT a.pos, a.l_extendedprice AS pa, b.l_extendedprice AS pb,
       CAST(CASE WHEN a.base = b.base THEN least(a.q + b.q, 200) WHEN a.q >= b.q THEN floor(a.q * 0.8) ELSE 0 END AS INTEGER) AS qa,
       CAST(CASE WHEN a.base = b.base OR a.q >= b.q THEN 0 ELSE floor(b.q * 0.8) END AS INTEGER) AS qb
FROM l a JOIN l b ON a.pos = b.pos AND a.ln = 1 AND b.ln = 2""")
def mate_overlap(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    side = lambda n, s: li.filter(F.col("l_linenumber") == n).select(F.col("l_orderkey").alias("pos"), F.col("l_quantity").cast("int").alias(f"q{s}"), F.when(F.col("l_linestatus") == "O", "A").otherwise("C").alias(f"base_{s}"), F.col("l_extendedprice").alias(f"p{s}"))
    return align.overlap_quality(side(1, "a").join(side(2, "b"), "pos")).select("pos", "pa", "pb", "qa", "qb")


@query("""
WITH r AS (SELECT o_orderstatus AS chrom, o_custkey * 100 AS beg, o_custkey * 100 + 40 AS e FROM orders WHERE o_orderkey % 7 = 0)
SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM r WHERE r.chrom = o_orderstatus AND o_orderkey * 3 BETWEEN r.beg AND r.e)""")
def restricted_sites(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    regions = o.filter("o_orderkey % 7 = 0").select(F.col("o_orderstatus").alias("chrom"), (F.col("o_custkey") * 100).alias("beg"), (F.col("o_custkey") * 100 + 40).alias("end"))
    sites = o.select("o_orderkey", F.col("o_orderstatus").alias("chrom"), (F.col("o_orderkey") * 3).alias("pos"))
    return variants.restricted(sites, regions, shift=8).select("o_orderkey")
