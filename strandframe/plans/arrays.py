"""Queries of scalar and array functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandframe.functions import samplers
from strandframe.functions import scalars as X
from strandframe.operators import align
from strandframe.plans.registry import query, table

_DNA = "regexp_replace(lower(text), '[^acgt]', 'a', 'g')"


@query(f"SELECT doc_id, length(text) AS n, md5(reverse(translate({_DNA}, 'acgt', 'tgca'))) AS rc_md5 FROM documents WHERE text IS NOT NULL")
def dna_revcomp(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter("text is not null")
    return docs.select("doc_id", F.length("text").cast("long").alias("n"), F.md5(X.revcomp(X.dna(F.col("text"))).cast("binary")).alias("rc_md5"))


@query(f"""
WITH s AS (SELECT doc_id, substr({_DNA}, 1, 15) AS s FROM documents WHERE length(text) > 0)
SELECT doc_id, list_reduce(list_transform(string_split(translate(s, 'acgt', '0123'), ''), lambda x: CAST(x AS BIGINT)), lambda a, b: a * 4 + b) AS packed, s AS unpacked FROM s""")
def dna_pack(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter(F.length("text") > 0)
    s = docs.select("doc_id", F.substring(X.dna(F.col("text")), 1, 15).alias("s")).withColumn("packed", X.dna_pack(F.col("s")))
    return s.select("doc_id", "packed", X.dna_unpack(F.col("packed"), F.length("s")).alias("unpacked"))


@query("""
WITH d AS (SELECT o_orderkey, list_transform(string_split(CAST(o_orderkey AS VARCHAR), ''), lambda x: CAST(x AS INTEGER)) AS w FROM orders)
SELECT o_orderkey, array_to_string(list_transform(w, lambda x: CAST(least(x, 4) AS VARCHAR)), '') AS capped,
       CAST(list_sum(list_transform(w, lambda x: CASE WHEN x BETWEEN 1 AND 3 THEN x - 1 ELSE 3 END)) AS BIGINT) AS numbers FROM d""")
def pulse_cap(spark, sf_dir):
    key = F.col("o_orderkey").cast("string")
    widths = F.transform(F.split(key, ""), lambda c: c.cast("int"))
    total = F.aggregate(X.pulse_numbers(key), F.lit(0).cast("long"), lambda a, x: a + x)
    return table(spark, sf_dir, "orders").select("o_orderkey", X.pulse_cap(widths).alias("capped"), total.alias("numbers"))


_Q = "list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 100000) AS BIGINT))"
_WIDTH = "CASE " + " ".join(f"WHEN m < {1 << 8 * n - 1} THEN {n}" for n in range(1, 8)) + " ELSE 8 END"


@query(f"""
WITH q AS (SELECT vec_id, {_Q} AS q FROM embeddings),
     d AS (SELECT vec_id, q, list_transform(q, lambda x, i: CASE WHEN i = 1 THEN x ELSE x - q[i - 1] END) AS d FROM q),
     m AS (SELECT *, list_max(list_transform(d, lambda x: CASE WHEN x >= 0 THEN x ELSE -(x + 1) END)) AS m FROM d)
SELECT vec_id, array_to_string(d, ',') AS deltas, array_to_string(q, ',') AS decoded, {_WIDTH} AS width FROM m""")
def intlist_delta(spark, sf_dir):
    q = F.transform("embedding", lambda x: F.floor(x.cast("double") * 100000).cast("long"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", X.delta(q).alias("d"))
    text = lambda c: F.array_join(c.cast("array<string>"), ",")
    return rows.select("vec_id", text(F.col("d")).alias("deltas"), text(X.cumulative(F.col("d"))).alias("decoded"), X.byte_width(F.col("d")).alias("width"))


_V = "((l_orderkey - 5000) * (CASE WHEN l_linenumber = 1 THEN 1 ELSE l_partkey * l_suppkey * 100003 END))"
_VS = f"(CASE WHEN {_V} >= 0 THEN {_V} ELSE -({_V} + 1) END)"


@query(f"""
SELECT CASE WHEN {_VS} < 64 THEN 1 WHEN {_V} >= 0 AND {_V} < 8192 THEN 2 {" ".join(f"WHEN {_VS} < {1 << 8 * n} THEN {n + 1}" for n in range(2, 8))} ELSE 9 END AS bytes,
       count(*) AS n FROM lineitem GROUP BY 1""")
def varint_bytes(spark, sf_dir):
    key = F.col("l_orderkey") - 5000
    v = F.when(F.col("l_linenumber") == 1, key).otherwise(X.product(key, F.col("l_partkey"), F.col("l_suppkey"), F.lit(100003)))
    return table(spark, sf_dir, "lineitem").groupBy(X.varint_bytes(v).alias("bytes")).agg(F.count("*").alias("n"))


@query("""
WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_orderkey % 100 AS s, l_orderkey % 100 + CAST(l_quantity AS BIGINT) AS e FROM lineitem),
     u AS (SELECT *, CASE WHEN s // 10 + 1 <= CAST(ceil(e / 10.0) AS BIGINT) - 1 THEN list_transform(generate_series(s // 10 + 1, CAST(ceil(e / 10.0) AS BIGINT) - 1), lambda k: k * 10) ELSE [] END AS pts FROM t)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, array_to_string(pts, ',') AS points,
       2 * (CAST(ceil(e / 10.0) AS BIGINT) - s // 10) AS trace_len,
       array_to_string(list_transform(pts, lambda p, i: i * (i + 1) // 2 + s), ',') AS b_points FROM u""")
def trace_points(spark, sf_dir):
    s = (F.col("l_orderkey") % 100).alias("s")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", s, (s + F.col("l_quantity").cast("long")).alias("e"))
    rows = rows.withColumn("pts", X.trace_points(F.col("s"), F.col("e"), F.lit(10)))
    text = lambda c: F.array_join(c.cast("array<string>"), ",")
    advance = F.transform("pts", lambda p, i: (i + 1).cast("long"))
    b = F.transform(X.cumulative(advance), lambda v: v + F.col("s"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", text(F.col("pts")).alias("points"), X.trace_length(F.col("s"), F.col("e"), F.lit(10)).alias("trace_len"), text(b).alias("b_points"))


@query("""
SELECT l_linenumber, CAST(sum(2 * q - (q - 5 + l_linenumber)) AS BIGINT) AS subs, CAST(sum(2 * (q - 5 + l_linenumber) - 2 * q) AS BIGINT) AS indels, round(-10 * log10((l_linenumber + 0.0) / 8), 6) AS q
FROM (SELECT l_linenumber, CAST(l_quantity AS BIGINT) AS q FROM lineitem) GROUP BY l_linenumber""")
def edit_algebra(spark, sf_dir):
    q = F.col("l_quantity").cast("long")
    matches, diffs, span = q - 5, F.col("l_linenumber").cast("long"), 2 * q
    rows = table(spark, sf_dir, "lineitem")
    return rows.groupBy("l_linenumber").agg(
        F.sum(X.substitutions(span, matches, diffs)).alias("subs"), F.sum(X.indels(span, matches, diffs)).alias("indels"), F.round(X.phred(F.first("l_linenumber") / 8), 6).alias("q")
    )


@query("""
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_custkey + 10 ELSE o_custkey END AS bs, CASE WHEN o_orderstatus = 'F' THEN o_custkey ELSE o_custkey + 10 END AS be FROM orders""")
def strand_coords(spark, sf_dir):
    bs, be = align.strand_swap(F.col("o_orderstatus") == "F", F.col("o_custkey"), F.col("o_custkey") + 10)
    return table(spark, sf_dir, "orders").select("o_orderkey", bs.alias("bs"), be.alias("be"))


@query("""
WITH s AS (SELECT l_orderkey, list(CAST(l_extendedprice AS BIGINT) ORDER BY CAST(l_extendedprice AS BIGINT)) AS sites FROM (SELECT l_orderkey, floor(l_extendedprice) AS l_extendedprice FROM lineitem) GROUP BY l_orderkey)
SELECT l_orderkey, sites[len(sites)] AS length, CAST(len(sites) - 1 AS BIGINT) AS n_sites, array_to_string(list_transform(sites, lambda x, i: CASE WHEN i = 1 THEN x ELSE x - sites[i - 1] END), ',') AS fragments FROM s""")
def bnx_fragments(spark, sf_dir):
    sites = F.array_sort(F.collect_list(F.floor("l_extendedprice")))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(sites.alias("sites"))
    return rows.select("l_orderkey", F.element_at("sites", -1).alias("length"), (F.size("sites") - 1).cast("long").alias("n_sites"), F.array_join(X.fragments(F.col("sites")).cast("array<string>"), ",").alias("fragments"))


@query("""
SELECT o_orderkey, round(-ln(1 - u) / 0.5, 9) AS exponential, CAST(ceil(ln(1 - u) / ln(1 - 0.25)) AS BIGINT) AS geometric, CASE WHEN u < 0.5 THEN 0 ELSE 1 END AS coin,
       (25214903917 * (o_orderkey % 65536) + 11) % 281474976710656 AS lcg
FROM (SELECT o_orderkey, ((o_orderkey * 7919) % 9973 + 0.5) / 9973 AS u FROM orders)""")
def lcg_sampler(spark, sf_dir):
    u = ((F.col("o_orderkey") * 7919) % 9973 + 0.5) / 9973
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.round(samplers.exponential(u, 0.5), 9).alias("exponential"), samplers.geometric(u, 0.25).alias("geometric"), samplers.coin(u).alias("coin"), samplers.lcg_next(F.col("o_orderkey") % 65536).alias("lcg")
    )


@query("SELECT n_nationkey, format('{:,}', n_nationkey * 1234567) AS grouped, CAST(length(CAST(n_nationkey * 1234567 AS VARCHAR)) AS INTEGER) AS digits, strftime(TIMESTAMP '2020-01-02 03:04:05' + INTERVAL 1 DAY * n_nationkey, '%Y-%m-%d_%H:%M:%S') AS stamp FROM nation")
def name_helpers(spark, sf_dir):
    n = F.col("n_nationkey").cast("long") * 1234567
    ts = F.timestamp_add("DAY", F.col("n_nationkey"), F.lit("2020-01-02 03:04:05").cast("timestamp"))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.format_number(n, 0).alias("grouped"), F.length(n.cast("string")).alias("digits"), X.timestamp_text(ts).alias("stamp"))
