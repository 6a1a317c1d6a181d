"""Queries that write and read files: each in a folder of its own under spark.checkpoint.dir, or a local one where that is unset."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from strandframe.operators.ordered import Ordered
from strandframe.plans.registry import query, table
from strandframe.functions import scalars as X
from strandframe.sources import binary, records, tagged
from strandframe.sources import schema as S


def folder(spark) -> str:
    own = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not own:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        own = "file://" + tempfile.mkdtemp(prefix="strandframe-")
        spark.conf.set("spark.checkpoint.dir", own)
    return f"{own.rstrip('/')}/strandframe/{uuid.uuid4().hex}"


_TYPES = """\
P 3 nat
S 3 reg
G g 2 3 INT 6 STRING
O N 2 3 INT 6 STRING
D K 1 8 INT_LIST
D C 1 6 STRING
"""


@query("""
SELECT n_nationkey, n_name, r_name, n_nationkey * 7 - 3 AS k1, len(string_split(n_name, '')) AS k2 FROM nation JOIN region ON n_regionkey = r_regionkey""")
def one_roundtrip(spark, sf_dir):
    kind = S.parse_schema(_TYPES)["nat"]
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    order = ["n_regionkey", "n_nationkey"]
    rows = Ordered(nation, F.col("n_regionkey"), order).ordinal().result()
    objects = rows.select("obj_ord", F.struct(F.col("n_nationkey").cast("long").alias("N0"), F.col("n_name").alias("N1")).alias("N"), F.array((F.col("n_nationkey") * 7 - 3).cast("long"), F.length("n_name").cast("long")).alias("K"))
    groups = rows.groupBy(F.col("n_regionkey").cast("long").alias("group_ord"), F.col("r_name").alias("g1")).agg(F.min("obj_ord").alias("first_obj"), F.count("*").alias("n_obj")).withColumn("g0", F.col("n_obj"))
    at = folder(spark)
    tagged.write_text(tagged.object_lines(objects, kind, groups), tagged.header_lines(tagged.Header(kind, "reg")), at)
    head = tagged.header(spark, at)
    lines = tagged.lines(spark, at, head.type, whole=True)
    back = tagged.objects(lines, head.type).join(tagged.groups(lines, head.type), ["file", "group_ord"])
    return back.select(F.col("N.N0").alias("n_nationkey"), F.col("N.N1").alias("n_name"), F.col("g1").alias("r_name"), F.get("K", F.lit(0)).alias("k1"), F.get("K", F.lit(1)).alias("k2"))


_BINARY = """\
P 3 cus
G g 2 3 INT 6 STRING
O C 3 3 INT 6 STRING 4 REAL
D K 1 8 INT_LIST
D D 1 3 DNA
"""


@query("""
WITH c AS (SELECT *, dense_rank() OVER (ORDER BY c_nationkey) - 1 AS g FROM customer)
SELECT c_custkey, c_name, c_acctbal, g AS group_ord, 'n' || c_nationkey AS g1, c_custkey * 7 - 3 AS k1, -c_custkey AS k2,
       regexp_replace(lower(c_name), '[^acgt]', 'a', 'g') AS d FROM c""")
def one_binary_roundtrip(spark, sf_dir):
    """Objects in groups, written in binary form as parts of one file with packed letters, and read back."""
    kind = S.parse_schema(_BINARY)["cus"]
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_nationkey")
    order = ["c_nationkey", "c_custkey"]
    rows = Ordered(c, F.col("c_nationkey"), order).ordinal().result()
    groups = rows.groupBy(F.concat(F.lit("n"), "c_nationkey").alias("g1")).agg(F.min("obj_ord").alias("first_obj"), F.count("*").alias("n_obj")).withColumn("group_ord", F.lit(0)).withColumn("g0", F.col("n_obj"))
    objects = rows.select("obj_ord", F.struct(F.col("c_custkey").alias("C0"), F.col("c_name").alias("C1"), F.col("c_acctbal").cast("double").alias("C2")).alias("C"), F.array(F.col("c_custkey") * 7 - 3, -F.col("c_custkey")).alias("K"), X.dna(F.col("c_name")).alias("D"))
    at = folder(spark)
    binary.write_binary(tagged.object_lines(objects, kind, groups), tagged.Header(kind), at, objects=5000)
    lines = binary.scan_any(spark, at, whole=True)
    back = tagged.objects(lines, kind).join(tagged.groups(lines, kind).select("group_ord", "g1"), "group_ord")
    return back.select(F.col("C.C0").alias("c_custkey"), F.col("C.C1").alias("c_name"), F.col("C.C2").alias("c_acctbal"), "group_ord", "g1", F.get("K", F.lit(0)).alias("k1"), F.get("K", F.lit(1)).alias("k2"), F.col("D").alias("d"))


@query(r"""
WITH d AS (SELECT doc_id, regexp_replace(lower(text), '[^acgt]', 'a', 'g') AS seq FROM documents WHERE length(text) > 0)
SELECT doc_id, 'r' || doc_id AS id, length(seq) AS n, md5(seq) AS seq_md5, length(seq) AS n_qual FROM d""")
def fastq_scan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter(F.length("text") > 0)
    seq = F.regexp_replace(F.lower("text"), "[^acgt]", "a")
    text = docs.select("doc_id", seq.alias("s")).select(F.concat(F.lit("@r"), "doc_id", F.lit(" source\n"), "s", F.lit("\n+\n"), F.repeat(F.lit("I"), F.length("s"))).alias("value"))
    at = folder(spark)
    text.write.text(at)
    got = records.read_fastq(spark, at)
    return got.select(F.substring("id", 2, 20).cast("long").alias("doc_id"), "id", F.length("seq").cast("long").alias("n"), F.md5(F.col("seq").cast("binary")).alias("seq_md5"), F.length("qual").cast("long").alias("n_qual"))


@query(r"""
WITH d AS (SELECT doc_id, regexp_replace(lower(text), '[^acgt]', 'a', 'g') AS seq FROM documents WHERE length(text) > 0)
SELECT doc_id, length(seq) AS n, md5(seq) AS seq_md5 FROM d""")
def fasta_scan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter(F.length("text") > 0)
    seq = F.regexp_replace(F.lower("text"), "[^acgt]", "a")
    wrapped = F.regexp_replace(seq, "(.{60})", "$1\n")
    at = folder(spark)
    docs.select(F.concat(F.lit(">"), "doc_id", F.lit(" x\n"), wrapped).alias("value")).write.text(at)
    got = records.read_fasta(spark, at)
    return got.select(F.col("id").cast("long").alias("doc_id"), F.length("seq").cast("long").alias("n"), F.md5(F.col("seq").cast("binary")).alias("seq_md5"))


@query("""
SELECT 'q' || o_orderkey AS qname, CAST(o_orderkey % 4096 AS INTEGER) AS flag, o_custkey AS pos, CAST(o_orderkey % 100 AS VARCHAR) || 'M' AS cigar, CAST(o_orderkey AS INTEGER) AS zm, round(o_orderkey % 997 / 997.0, 4) AS rq
FROM orders WHERE (o_orderkey % 4096) & 2304 = 0""")
def sam_scan(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    text = F.concat_ws("\t", F.concat(F.lit("q"), key), (key % 4096).cast("string"), F.lit("chr1"), F.col("o_custkey").cast("string"), F.lit("60"), F.concat((key % 100).cast("string"), F.lit("M")), F.lit("*"), F.lit("0"), F.lit("0"), F.lit("acgt"), F.lit("IIII"), F.concat(F.lit("zm:i:"), key), F.concat(F.lit("rq:f:"), F.round((key % 997) / 997, 4)))
    at = folder(spark)
    o.select(text.alias("value")).write.text(at)
    sam = records.read_sam(spark, at).filter(F.col("flag").bitwiseAND(F.lit(0x900)) == 0)
    return sam.select("qname", "flag", "pos", "cigar", records.tag(F.col("tags"), "zm", "int").alias("zm"), F.round(records.tag(F.col("tags"), "rq", "double"), 4).alias("rq"))


@query("""
SELECT 'c' || (o_custkey % 20) AS chrom, o_custkey AS pos, o_orderkey AS dp, CASE WHEN o_orderkey % 2 = 0 THEN '0/1' ELSE NULL END AS gt, len(CASE WHEN o_orderkey % 5 = 0 THEN [] ELSE [1] END) AS n_filters FROM orders""")
def vcf_scan(spark, sf_dir):
    key = F.col("o_orderkey")
    text = F.concat_ws("\t", F.concat(F.lit("c"), (F.col("o_custkey") % 20).cast("string")), F.col("o_custkey").cast("string"), F.lit("."), F.lit("A"), F.lit("C,G"), F.lit("."), F.when(key % 5 == 0, "PASS").otherwise("q10"), F.concat(F.lit("DP="), key, F.lit(";DB")), F.lit("GT:GQ"), F.when(key % 2 == 0, "0/1:9").otherwise(".:9"))
    at = folder(spark)
    table(spark, sf_dir, "orders").select(text.alias("value")).write.text(at)
    v = records.read_vcf(spark, at)
    return v.select("chrom", "pos", F.col("info")["DP"].cast("long").alias("dp"), records.sample_value(F.get("samples", F.lit(0)), F.col("format"), "GT").alias("gt"), F.size("filters").cast("long").alias("n_filters"))


@query("""
SELECT l_orderkey, CAST(floor(max(l_extendedprice)) AS BIGINT) AS length, count(*) - 1 AS n_sites, count(*) AS n_snr FROM lineitem GROUP BY l_orderkey""")
def bnx_scan(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", F.floor("l_extendedprice").alias("x"), "l_linenumber")
    one = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("x")).alias("x"))
    joined = lambda c: F.array_join(c.cast("array<string>"), "\t")
    same = F.transform("x", lambda _: F.lit("1.5"))
    # the molecule's number is carried in the first intensity
    text = F.concat(F.lit("0\t"), F.col("l_orderkey").cast("string"), F.lit("\n1\t"), joined(F.col("x")), F.lit("\nQX11\t"), joined(same), F.lit("\nQX12\t"), F.col("l_orderkey").cast("string"))
    at = folder(spark)
    one.select(text.alias("value")).write.text(at)
    m = records.read_bnx(spark, at)
    return m.select(F.get("intensity", F.lit(0)).cast("long").alias("l_orderkey"), "length", "n_sites", F.size("snr").cast("long").alias("n_snr"))
