"""Queries of run groups, pairing and barcodes."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandframe.operators import barcodes, joins, stats
from strandframe.operators.ordered import Ordered, in_ranges
from strandframe.plans.registry import query, table
from strandframe.plans.selection import LINE, LINE_SQL

CODE = 6  # letters of a barcode
_CODED = "WITH r AS (SELECT *, " + " || ".join(f"substr('ACGT', CAST((o_custkey % 4096) // {4**i} % 4 AS INTEGER) + 1, 1)" for i in range(CODE - 1, -1, -1)) + " AS code FROM orders), c AS (SELECT code, count(*) AS n FROM r GROUP BY code)"
_REPAIRED = f"""{_CODED},
  one AS (SELECT i.code, min(v.code) AS fixed FROM c i JOIN c v ON v.n >= 8 AND i.n < 8 AND hamming(i.code, v.code) = 1 GROUP BY i.code HAVING count(*) = 1),
  rep AS (SELECT c.code, c.n, CASE WHEN c.n >= 8 THEN c.code ELSE one.fixed END AS corrected FROM c LEFT JOIN one ON c.code = one.code)"""


def _reads(spark, sf_dir):
    n = F.col("o_custkey") % 4096
    letters = [F.substring(F.lit("ACGT"), (F.floor(n / 4**i) % 4 + 1).cast("int"), F.lit(1)) for i in range(CODE - 1, -1, -1)]
    return table(spark, sf_dir, "orders").withColumn("code", F.concat(*letters))


@query(f"{_CODED} SELECT code, n FROM c WHERE n >= 8")
def barcode_counts(spark, sf_dir):
    return barcodes.counts(_reads(spark, sf_dir), "code").filter(F.col("n") >= 8)


@query("""
WITH c AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey)
SELECT CASE WHEN n < 50 THEN n WHEN n < 1000 THEN n - n % 10 ELSE 1000 END AS bucket, count(*) AS n_codes, CAST(sum(n) AS BIGINT) AS n_reads FROM c GROUP BY 1""")
def barcode_histogram(spark, sf_dir):
    return barcodes.histogram(barcodes.counts(table(spark, sf_dir, "lineitem"), "l_partkey"))


@query(f"{_REPAIRED} SELECT code, n, corrected FROM rep")
def barcode_hamming1(spark, sf_dir):
    return barcodes.repairs(barcodes.counts(_reads(spark, sf_dir), "code"), 8, CODE)


@query(f"""{_REPAIRED}
SELECT count(*) FILTER (corrected = code) AS n_valid_codes, CAST(coalesce(sum(n) FILTER (corrected = code), 0) AS BIGINT) AS n_valid,
       CAST(coalesce(sum(n) FILTER (corrected <> code), 0) AS BIGINT) AS n_repaired, CAST(coalesce(sum(n) FILTER (corrected IS NULL), 0) AS BIGINT) AS n_dropped FROM rep""")
def barcode_summary(spark, sf_dir):
    return barcodes.summary(barcodes.repairs(barcodes.counts(_reads(spark, sf_dir), "code"), 8, CODE))


@query(f"""{_REPAIRED}, k AS (SELECT corrected, substr(o_orderpriority, 3) AS trimmed FROM r JOIN rep USING (code) WHERE corrected IS NOT NULL),
  g AS (SELECT corrected AS code, count(*) AS n, min(trimmed) AS first_name FROM k GROUP BY corrected)
SELECT row_number() OVER (ORDER BY code) - 1 AS group_ord, code, n, first_name FROM g""")
def barcode_clouds(spark, sf_dir):
    reads = _reads(spark, sf_dir).select("code", F.substring("o_orderpriority", 3, 100).alias("trimmed"))
    fixed = barcodes.repairs(barcodes.counts(reads, "code"), 8, CODE).filter("corrected is not null").select("code", "corrected")
    clouds = reads.join(fixed, "code").groupBy("corrected").agg(F.count("*").alias("n"), F.min("trimmed").alias("first_name")).withColumnRenamed("corrected", "code")
    lead = F.conv(F.translate("code", "ACGT", "0123"), 4, 10).cast("long")
    return Ordered(clouds, lead, ["code"]).ordinal("group_ord").result().select("group_ord", "code", "n", "first_name")


@query("""
WITH p AS (SELECT *, lag(event_type) OVER (ORDER BY ts, event_id) AS before FROM events),
     g AS (SELECT *, sum(CASE WHEN before IS NULL OR before <> event_type THEN 1 ELSE 0 END) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) - 1 AS group_ord FROM p)
SELECT CAST(group_ord AS BIGINT) AS group_ord, event_type, count(*) AS n, min(event_id) AS first_event FROM g GROUP BY 1, 2""")
def run_length_groups(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "ts", "event_type")
    runs = Ordered(e, F.unix_micros(F.col("ts").cast("timestamp")), ["ts", "event_id"]).run_groups(F.col("event_type")).result()
    return runs.groupBy("group_ord", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


@query("""
SELECT row_number() OVER (ORDER BY l_orderkey) - 1 AS group_ord, CAST(l_orderkey AS VARCHAR) AS name, count(*) AS n FROM lineitem GROUP BY l_orderkey""")
def pile_groups(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(*LINE)
    piles = Ordered(li, F.col("l_orderkey"), LINE).run_groups(F.col("l_orderkey")).result()
    return piles.groupBy("group_ord", F.col("l_orderkey").cast("string").alias("name")).agg(F.count("*").alias("n"))


@query("""
WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS ord FROM orders),
     s AS (SELECT o_orderstatus AS cell, count(*) AS n FROM orders GROUP BY 1),
     b AS (SELECT cell, sum(n) OVER (ORDER BY cell) - n AS lo, sum(n) OVER (ORDER BY cell) AS hi FROM s)
SELECT cell, count(*) AS n, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key FROM o JOIN b ON ord >= lo AND ord < hi GROUP BY cell""")
def cell_ranges(spark, sf_dir):
    from pyspark.sql import Window

    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    cells = orders.groupBy(F.col("o_orderstatus").alias("cell")).agg(F.count("*").alias("n"))
    up = F.sum("n").over(Window.orderBy("cell"))  # one row a cell
    bounds = cells.select("cell", (up - F.col("n")).alias("lo"), up.alias("hi"))
    o = Ordered(orders.select("o_orderkey"), F.col("o_orderkey"), ["o_orderkey"]).ordinal("ord").result()
    return in_ranges(o, "ord", bounds, "lo", "hi").groupBy("cell").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"))


@query("""
WITH f AS (SELECT conv_id, role = 'user' AS first, lag(role = 'user') OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM conversations)
SELECT conv_id, count(*) AS n, count(*) FILTER (NOT first AND first <> coalesce(before, false)) AS n_pairs, count(*) FILTER (first = coalesce(before, false)) AS n_out_of_phase
FROM f GROUP BY conv_id""")
def pair_from_flags(spark, sf_dir):
    return joins.pairs_from_flags(table(spark, sf_dir, "conversations"), "conv_id", ["turn", "role", "text"], F.col("role") == "user")


@query("""
SELECT row_number() OVER (ORDER BY conv_id) - 1 AS group_ord, conv_id, count(*) AS n, CASE count(*) WHEN 2 THEN 'pair' WHEN 1 THEN 'lone' ELSE 'extra' END AS state
FROM conversations GROUP BY conv_id""")
def pair_by_identity(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    runs = Ordered(c, F.col("conv_id"), ["conv_id", "turn", "role", "text"]).run_groups(F.col("conv_id")).result()
    return joins.pairs_by_identity(runs, "group_ord", "conv_id")


@query("""
WITH c AS (SELECT unnest(string_split(p_name, '')) AS symbol FROM part), h AS (SELECT symbol, count(*) AS n FROM c WHERE symbol <> '' GROUP BY symbol)
SELECT symbol, n, CAST(row_number() OVER (ORDER BY symbol) - 1 AS INTEGER) AS code, CAST(ceil(log2(greatest((SELECT count(*) FROM h), 2))) AS INTEGER) AS bits FROM h""")
def qv_alphabet(spark, sf_dir):
    return stats.symbols(table(spark, sf_dir, "part"), "p_name")


@query("""
WITH c AS (SELECT unnest(string_split(c_name, '')) AS symbol FROM customer)
SELECT ascii(symbol) AS byte, count(*) AS n FROM c WHERE symbol <> '' GROUP BY 1""")
def codec_histogram(spark, sf_dir):
    h = stats.symbols(table(spark, sf_dir, "customer"), "c_name")
    return h.select(F.ascii("symbol").alias("byte"), "n")


@query(f"""
WITH r AS (SELECT l_orderkey, row_number() OVER (ORDER BY {LINE_SQL}) - 1 AS ord FROM lineitem)
SELECT l_orderkey, min(ord) AS first_obj, count(*) AS n_obj FROM r GROUP BY l_orderkey""")
def group_first_objects(spark, sf_dir):
    from strandframe.operators.select import group_index

    li = Ordered(table(spark, sf_dir, "lineitem").select(*LINE), F.col("l_orderkey"), LINE).ordinal("ord").result()
    return group_index(li, "l_orderkey", "ord")
