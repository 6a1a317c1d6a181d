"""Queries of statistics, selection, filters and joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandframe.functions import scalars as X
from strandframe.operators import expr, joins, select, stats
from strandframe.operators.ordered import Ordered
from strandframe.plans.registry import query, table

LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
LINE_SQL = ", ".join(LINE)


@query("""
WITH per AS (SELECT lang AS g, count(*) AS n, coalesce(max(length(text)), 0) AS longest, coalesce(sum(length(text)), 0) AS total
             FROM documents GROUP BY lang)
SELECT 'S' AS line_type, CAST(sum(n) AS BIGINT) AS n_lines, CAST(max(longest) AS BIGINT) AS max_len,
       CAST(sum(total) AS BIGINT) AS total_len,
       max(n) FILTER (g IS NOT NULL) AS group_max_count,
       CAST(max(total) FILTER (g IS NOT NULL) AS BIGINT) AS group_max_total
FROM per""")
def one_header_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("lang", F.length("text").alias("len"))
    return stats.header_counts(docs, "lang", "len", "S")


@query("SELECT source AS line_type, count(*) AS n_lines, CAST(coalesce(sum(strlen(text)), 0) AS BIGINT) AS n_bytes FROM documents GROUP BY source")
def one_usage_bytes(spark, sf_dir):
    return stats.usage(table(spark, sf_dir, "documents").withColumnRenamed("source", "line_type"), "line_type", "text")


@query("""
SELECT lang, n - n % 7 AS given, n AS found FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang) WHERE n % 7 <> 0""")
def one_group_check(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("lang")
    stated = docs.groupBy("lang").agg((F.count("*") - F.count("*") % 7).alias("given"))
    return stats.group_check(stated, docs, "lang", "given")


@query("""
WITH g AS (SELECT o_orderstatus AS line_type, count(*) AS n FROM orders GROUP BY 1),
     d AS (SELECT l_returnflag AS line_type, count(*) AS n FROM lineitem GROUP BY 1
           UNION ALL SELECT o_orderstatus, count(*) + CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END FROM orders GROUP BY 1),
     b AS (SELECT coalesce(g.line_type, d.line_type) AS line_type, coalesce(g.n, 0) AS given, coalesce(d.n, 0) AS found
           FROM g FULL OUTER JOIN d ON g.line_type = d.line_type)
SELECT line_type, given, found, CASE WHEN given > 0 AND given <> found THEN 'bad' ELSE 'missing' END AS state
FROM b WHERE (given > 0 AND given <> found) OR (given = 0 AND found > 0)""")
def one_header_check(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    given = orders.groupBy(F.col("o_orderstatus").alias("line_type")).agg(F.count("*").alias("n"))
    found = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("line_type")).agg(F.count("*").alias("n"))
    off = given.withColumn("n", F.col("n") + F.when(F.col("line_type") == "F", 0).otherwise(1))
    return stats.header_check(given, found.union(off))


@query("""
WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS obj_ord FROM orders),
     r(seq, lo, hi) AS (VALUES (0, 3, 4), (1, 5, 9), (2, 3, 4))
SELECT seq, obj_ord, o_orderkey FROM o JOIN r ON obj_ord >= lo AND obj_ord < hi""")
def one_index_ranges(spark, sf_dir):
    orders = Ordered(table(spark, sf_dir, "orders").select("o_orderkey"), F.col("o_orderkey"), ["o_orderkey"]).ordinal()
    return select.by_ordinal(orders.result(), "obj_ord", "3,5-9,3").select("seq", "obj_ord", "o_orderkey")


@query("""
WITH c AS (SELECT conv_id, turn, role, dense_rank() OVER (ORDER BY conv_id) - 1 AS group_ord FROM conversations),
     r(seq, lo, hi) AS (VALUES (0, 0, 3), (1, 7, 8))
SELECT seq, group_ord, conv_id, turn, role FROM c JOIN r ON group_ord >= lo AND group_ord < hi""")
def one_group_ranges(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    groups = Ordered(c.select("conv_id").distinct(), F.col("conv_id"), ["conv_id"]).ordinal("group_ord").result()
    return c.join(select.by_ordinal(groups, "group_ord", "0-3,7"), "conv_id").select("seq", "group_ord", "conv_id", "turn", "role")


@query("""
SELECT conv_id, count(*) AS n_turns, max(length(text)) FILTER (role = 'user') AS user_len,
       max(length(text)) FILTER (role = 'assistant') AS assistant_len, max(turn) FILTER (role = 'system') AS system_turn
FROM conversations GROUP BY conv_id""")
def line_to_object(spark, sf_dir):
    c, n = table(spark, sf_dir, "conversations"), F.length("text").cast("long")
    of = lambda role, v: F.max(F.when(F.col("role") == role, v))
    return c.groupBy("conv_id").agg(F.count("*").alias("n_turns"), of("user", n).alias("user_len"), of("assistant", n).alias("assistant_len"), of("system", F.col("turn")).alias("system_turn"))


@query("""
SELECT event_id, last_value(CASE WHEN event_type = 'view' THEN value END IGNORE NULLS) OVER (ORDER BY ts, event_id) AS t
FROM events""")
def forward_fill_T(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value")
    ordered = Ordered(e, F.unix_micros(F.col("ts").cast("timestamp")), ["ts", "event_id"])
    return ordered.fill_forward(F.when(F.col("event_type") == "view", F.col("value")), "t").result().select("event_id", "t")


@query("""
SELECT array_to_string(string_split(text, ' ')[1:3], ' ') AS prefix, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1""")
def seq_prefix_groups(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter("text is not null")
    return docs.groupBy(select.prefix_key(F.col("text"), " ", 3).alias("prefix")).agg(F.count("*").alias("n"))


@query(r"SELECT doc_id, regexp_extract(text, '^[^ \t\n\r\f]+') AS identifier FROM documents")
def seq_identifier(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", select.identifier(F.col("text")).alias("identifier"))


@query(f"""
WITH o AS (SELECT *, row_number() OVER (ORDER BY {LINE_SQL}) AS rn, l_linestatus AS s FROM lineitem),
     f AS (SELECT row_number() OVER (ORDER BY rn) - 1 AS obj_ord, l_orderkey AS f_key, l_quantity AS f_quantity FROM o WHERE s = 'O'),
     r AS (SELECT row_number() OVER (ORDER BY rn) - 1 AS obj_ord, l_orderkey AS r_key, l_quantity AS r_quantity FROM o WHERE s = 'F')
SELECT obj_ord, f_key, f_quantity, r_key, r_quantity FROM f JOIN r USING (obj_ord)""")
def positional_zip(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    side = lambda s: Ordered(li.filter(F.col("l_linestatus") == s), F.col("l_orderkey"), LINE).ordinal().result().select("obj_ord", F.col("l_orderkey").alias("key"), F.col("l_quantity").alias("quantity"))
    return joins.zip_by_ordinal(side("O"), side("F"))


@query("""
SELECT l_returnflag, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS part_size, CAST(sum(length(s_name)) AS BIGINT) AS name_len, max(l_partkey + 1) AS last_a
FROM lineitem LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey GROUP BY l_returnflag""")
def ordinal_lookup(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag")
    both = joins.lookup(li, "l_partkey", table(spark, sf_dir, "part"), "p_partkey", {"p_size": "alen"})
    supplier = table(spark, sf_dir, "supplier").withColumn("len", F.length("s_name"))
    both = joins.lookup(both, "l_suppkey", supplier, "s_suppkey", {"len": "blen"})
    return both.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum("alen").cast("long").alias("part_size"), F.sum("blen").cast("long").alias("name_len"), F.max(F.col("l_partkey") + 1).alias("last_a"))


@query("""
WITH l AS (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS keys FROM orders GROUP BY o_custkey),
     u AS (SELECT o_custkey, unnest(keys) AS k, generate_subscripts(keys, 1) - 1 AS pos FROM l)
SELECT u.o_custkey, CAST(pos AS INTEGER) AS pos, k AS o_orderkey, o_totalprice FROM u JOIN orders ON k = o_orderkey""")
def list_dereference(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    lists = orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("keys"))
    return joins.dereference(lists, "keys", orders.select("o_orderkey", "o_totalprice"), "o_orderkey").drop("keys")


_LN, _RQ = "CAST(l_quantity AS INTEGER) * 20", "CAST(trunc(CAST(1000 AS FLOAT) * CAST(l_tax * 10 AS FLOAT)) AS INTEGER)"


@query(f"SELECT l_returnflag, count(*) AS n FROM lineitem WHERE {_LN} >= 500 AND {_RQ} >= 750 GROUP BY l_returnflag")
def pb_filter_default(spark, sf_dir):
    columns = {"ln": F.col("l_quantity").cast("int") * 20, "rq": expr.rq_of(F.col("l_tax") * 10)}
    kept = expr.keep(table(spark, sf_dir, "lineitem"), columns=columns, required=True)
    return kept.groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query("""
SELECT l_linenumber, count(*) AS n FROM lineitem
WHERE (CAST(l_quantity AS INTEGER) >= 30 AND CAST(trunc(CAST(1000 AS FLOAT) * CAST(l_discount AS FLOAT)) AS INTEGER) >= 50) OR l_linenumber = 3
GROUP BY l_linenumber""")
def pb_filter_expr(spark, sf_dir):
    columns = {"ln": F.col("l_quantity").cast("int"), "rq": expr.rq_of(F.col("l_discount")), "np": F.col("l_linenumber")}
    kept = expr.keep(table(spark, sf_dir, "lineitem"), "(ln>=30 && rq>=50) || np==3", columns)
    return kept.groupBy("l_linenumber").agg(F.count("*").alias("n"))


_FLAG = "((l_linenumber * 273 + l_partkey) % 4096)"
_NAMES = " || ".join(f"CASE WHEN {_FLAG} & {1 << i} <> 0 THEN '{n},' ELSE '' END" for i, n in enumerate(X.FLAG_NAMES))


@query(f"""
SELECT rtrim({_NAMES}, ',') AS names, count(*) AS n, count(*) FILTER ({_FLAG} & 192 = 64) AS n_first
FROM lineitem WHERE {_FLAG} & 2304 = 0 GROUP BY 1""")
def flag_filter(spark, sf_dir):
    flag = ((F.col("l_linenumber") * 273 + F.col("l_partkey")) % 4096).cast("int")
    kept = table(spark, sf_dir, "lineitem").withColumn("flag", flag).filter(X.primary(F.col("flag")))
    return kept.groupBy(X.flag_names(F.col("flag")).alias("names")).agg(F.count("*").alias("n"), F.count_if(X.first_of_pair(F.col("flag"))).alias("n_first"))


@query(f"""
WITH b AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, {LINE_SQL}) = 1 AS best FROM lineitem)
SELECT row_number() OVER (ORDER BY {LINE_SQL}) - 1 AS obj_ord, l_orderkey, l_linenumber, l_quantity FROM b WHERE best AND l_quantity >= 10""")
def db_trim(spark, sf_dir):
    w = Window.partitionBy("l_orderkey").orderBy(F.col("l_extendedprice").desc(), *LINE)
    reads = table(spark, sf_dir, "lineitem").withColumn("best", F.row_number().over(w) == 1)
    kept = joins.trim_database(reads, F.col("best"), F.col("l_quantity"), 10).select(*LINE, "l_quantity")
    return Ordered(kept, F.col("l_orderkey"), LINE).ordinal().result().select("obj_ord", "l_orderkey", "l_linenumber", "l_quantity")


@query(f"""
WITH i AS (SELECT *, sum(CASE WHEN l_linestatus = 'O' THEN 0 ELSE 1 END) OVER (PARTITION BY l_orderkey ORDER BY {LINE_SQL} ROWS UNBOUNDED PRECEDING) AS ins FROM lineitem),
     k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, ins ORDER BY {LINE_SQL}) AS rn FROM i WHERE l_quantity >= 10)
SELECT l_orderkey, count(*) AS n_kept, count(*) FILTER (l_linestatus = 'O' AND rn > 1) AS n_chained FROM k GROUP BY l_orderkey""")
def db_css(spark, sf_dir):
    rows = joins.reset_chain_flags(table(spark, sf_dir, "lineitem"), "l_orderkey", LINE, F.col("l_linestatus") == "O", F.col("l_quantity") >= 10)
    return rows.groupBy("l_orderkey").agg(F.count("*").alias("n_kept"), F.count_if("chained_after").alias("n_chained"))


@query("""
SELECT DISTINCT 0 AS step, 'import' AS program, '1.0' AS version, o_orderstatus AS command FROM orders
UNION ALL SELECT DISTINCT 1, 'pair', '1.1', l_linestatus FROM lineitem""")
def provenance_union(spark, sf_dir):
    step = lambda df, c, p, v: df.select(F.lit(p).alias("program"), F.lit(v).alias("version"), F.col(c).alias("command")).distinct()
    from strandframe.operators.variants import union_metadata

    return union_metadata(step(table(spark, sf_dir, "orders"), "o_orderstatus", "import", "1.0"), step(table(spark, sf_dir, "lineitem"), "l_linestatus", "pair", "1.1"))


@query("""
WITH f AS (SELECT l_returnflag AS file, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem),
     n AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn FROM f)
SELECT file, max(CASE WHEN rn = 1 THEN CAST(l_orderkey AS VARCHAR) END) AS name, count(*) AS n, row_number() OVER (ORDER BY file) - 1 AS group_ord FROM n GROUP BY file""")
def file_groups(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumnRenamed("l_returnflag", "file")
    return joins.file_groups(li, "file", F.col("l_orderkey").cast("string"), LINE).select("file", "name", "n", F.col("group_ord").cast("long").alias("group_ord"))


@query(f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(c + " DESC" for c in LINE)}) AS rn FROM lineitem)
SELECT l_orderkey, l_linenumber * 100 + CAST(l_quantity AS BIGINT) AS length FROM r WHERE rn = 1""")
def scaffold_lengths(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("start", F.col("l_linenumber") * 100).withColumn("len", F.col("l_quantity").cast("long"))
    return stats.scaffold_lengths(li, "l_orderkey", "start", "len", LINE)


@query("SELECT count(*) AS n_reads, CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS total, CAST(max(length(text)) AS BIGINT) AS longest FROM documents")
def read_totals(spark, sf_dir):
    return stats.totals(table(spark, sf_dir, "documents").select(F.length("text").alias("n")), "n")


_AB = "SELECT l_orderkey AS a, CAST(l_quantity AS BIGINT) * 3 AS as_, CAST(l_quantity AS BIGINT) * 3 + 40 AS ae, l_suppkey AS b, l_partkey % 500 AS bs, l_partkey % 500 + 40 AS be FROM lineitem WHERE l_linenumber % 2 = 1"
_BC = "SELECT l_suppkey AS a, l_partkey % 500 AS as_, l_partkey % 500 + 25 AS ae, l_orderkey AS b, l_orderkey % 300 AS bs, l_orderkey % 300 + 25 AS be FROM lineitem WHERE l_linenumber % 2 = 0"


@query(f"""
WITH x AS ({_AB}), y AS ({_BC}),
     o AS (SELECT x.a, x.as_ - x.bs AS dx, y.b, y.bs - y.as_ AS dy, greatest(x.bs, y.as_) AS s, least(x.be, y.ae) AS e FROM x JOIN y ON x.b = y.a AND x.bs < y.ae AND y.as_ < x.be)
SELECT a, s + dx AS as_, e + dx AS ae, b, s + dy AS bs, e + dy AS be FROM o""")
def map_composition(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    q, p, k = F.col("l_quantity").cast("long") * 3, F.col("l_partkey") % 500, F.col("l_orderkey") % 300
    ab = li.filter("l_linenumber % 2 = 1").select(F.col("l_orderkey").alias("a"), q.alias("as_"), (q + 40).alias("ae"), F.col("l_suppkey").alias("b"), p.alias("bs"), (p + 40).alias("be"))
    bc = li.filter("l_linenumber % 2 = 0").select(F.col("l_suppkey").alias("a"), p.alias("as_"), (p + 25).alias("ae"), F.col("l_orderkey").alias("b"), k.alias("bs"), (k + 25).alias("be"))
    return joins.compose_maps(ab, bc, shift=6)


@query("""
WITH r AS (SELECT doc_id, length(text) AS n, length(source) AS q, text IS NOT NULL AND NOT regexp_full_match(coalesce(source, ''), '[!-~]*') AS odd FROM documents)
SELECT doc_id, 'quality and sequence differ in length' AS fault FROM r WHERE n <> q UNION ALL SELECT doc_id, 'a quality letter is out of range' FROM r WHERE odd""")
def sequence_faults(spark, sf_dir):
    from strandframe.operators import validate

    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("S"), F.col("source").alias("Q"), F.lit(None).cast("string").alias("A"))
    return validate.faults(docs, ["doc_id"], validate.sequence_rules())


@query("""
SELECT doc_id, length(text) AS n, length(text) AS n_replaced, 2 * length(text) AS n_inserted, CAST(0 AS BIGINT) AS n_deleted FROM documents WHERE length(text) > 0""")
def mutated_letters(spark, sf_dir):
    """At rate 1 each kind of change meets every letter; rates between are tested against the same chances in Python."""
    from strandframe.functions import samplers

    docs = table(spark, sf_dir, "documents").filter(F.length("text") > 0).select("doc_id", X.dna(F.col("text")).alias("s"))
    at = lambda *rates: samplers.mutate(F.col("s"), F.col("doc_id"), *rates)
    m = docs.withColumn("replaced", at(0.0, 0.0, 1.0)).withColumn("inserted", at(1.0, 0.0, 0.0)).withColumn("deleted", at(0.0, 1.0, 0.0))
    return m.select("doc_id", F.length("s").cast("long").alias("n"), samplers.differing(F.col("s"), F.col("replaced"), "acgt").alias("n_replaced"), F.length("inserted").cast("long").alias("n_inserted"), F.length("deleted").cast("long").alias("n_deleted"))
