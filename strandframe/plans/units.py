"""Queries of single functions: letters, lists, names, flags, samplers, tags, interval rows and variant edits."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from strandframe.functions import samplers
from strandframe.functions import scalars as X
from strandframe.functions import special
from strandframe.operators import select, stats, variants
from strandframe.plans.registry import query, table
from strandframe.sources import blocked, records


@query("""
SELECT c_custkey, translate(c_name, 'acgtnACGTN', 'ACGTNacgtn') AS swapped, translate(regexp_replace(lower(c_name), '[^acgt]', 'a', 'g'), 'acgt', '0123') AS numbers FROM customer""")
def letter_cases(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", X.swap_case(F.col("c_name")).alias("swapped"), F.array_join(X.dna_numbers(X.dna(F.col("c_name"))).cast("array<string>"), "").alias("numbers"))


@query("SELECT o_orderkey, substr('=acmgrsvtwyhkdbn', CAST(o_orderkey % 16 AS INTEGER) + 1, 1) AS letter FROM orders")
def iupac_letters(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", X.iupac((F.col("o_orderkey") % 64).cast("int")).alias("letter"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE chr(CAST(o_orderkey % 90 + 33 AS INTEGER)) || chr(CAST(o_custkey % 90 + 33 AS INTEGER)) || '!' END AS quality FROM orders""")
def quality_letters(spark, sf_dir):
    first = F.when(F.col("o_orderkey") % 5 == 0, 255).otherwise(F.col("o_orderkey") % 90)
    q = F.array(first.cast("int"), (F.col("o_custkey") % 90).cast("int"), F.lit(0))
    return table(spark, sf_dir, "orders").select("o_orderkey", X.quality_text(q).alias("quality"))


@query("""
WITH t AS (SELECT o_orderkey, generate_series(o_custkey, o_custkey + o_orderkey % 7) AS v FROM orders)
SELECT o_orderkey, array_to_string(list_filter(v, lambda x, i: i % 2 = 1), ',') AS diffs, array_to_string(list_filter(v, lambda x, i: i % 2 = 0), ',') AS advance FROM t""")
def trace_split(spark, sf_dir):
    v = F.sequence(F.col("o_custkey"), F.col("o_custkey") + F.col("o_orderkey") % 7)
    text = lambda s: F.array_join(X.every_other(v, s).cast("array<string>"), ",")
    return table(spark, sf_dir, "orders").select("o_orderkey", text(0).alias("diffs"), text(1).alias("advance"))


_C = "CASE p_partkey % 4 WHEN 0 THEN '*' WHEN 1 THEN p_size || 'M2I' WHEN 2 THEN p_size || 'M2Q' ELSE 'M' || p_size END"


@query(f"SELECT p_partkey, regexp_full_match(p_type, '[!-~]+') AS plain, p_partkey % 4 < 2 AS plausible, {_C} AS cigar FROM part")
def plausible_names(spark, sf_dir):
    size, k = F.col("p_size").cast("string"), F.col("p_partkey") % 4
    cigar = F.when(k == 0, "*").when(k == 1, F.concat(size, F.lit("M2I"))).when(k == 2, F.concat(size, F.lit("M2Q"))).otherwise(F.concat(F.lit("M"), size))
    return table(spark, sf_dir, "part").select("p_partkey", X.printable(F.col("p_type")).alias("plain"), X.plausible_cigar(cigar).alias("plausible"), cigar.alias("cigar"))


@query(r"""
WITH p AS (SELECT p_partkey, 'data.seq/' || p_type || '/' || p_name || CASE WHEN p_partkey % 2 = 0 THEN '.seq' ELSE '' END AS p FROM part)
SELECT p_partkey, regexp_replace(string_split(p, '/')[-1], '\.seq$', '') AS root, string_split(p, '/')[1] AS to_slash FROM p""")
def path_names(spark, sf_dir):
    path = F.concat(F.lit("data.seq/"), "p_type", F.lit("/"), "p_name", F.when(F.col("p_partkey") % 2 == 0, ".seq").otherwise(""))
    return table(spark, sf_dir, "part").select("p_partkey", X.root_name(path, ".seq").alias("root"), select.prefix_key(path, "/", 1).alias("to_slash"))


@query("""
WITH m AS (SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) + 1 AS mean, (CAST(o_totalprice AS DOUBLE) + 1) / (1 + o_orderkey % 5) AS sd FROM orders)
SELECT o_orderkey, round(ln(mean) - ln(1 + (sd / mean) * (sd / mean)) / 2, 6) AS mu, round(sqrt(ln(1 + (sd / mean) * (sd / mean))), 6) AS sigma FROM m""")
def log_normal(spark, sf_dir):
    mean = F.col("o_totalprice").cast("double") + 1
    mu, sigma = samplers.log_normal_parameters(mean, mean / (1 + F.col("o_orderkey") % 5))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(mu, 6).alias("mu"), F.round(sigma, 6).alias("sigma"))


def _steps(probabilities: list[float]) -> str:
    """SQL for the number of cumulative probabilities that are at most u."""
    total, out = 0.0, []
    for p in probabilities:
        total += p
        out.append(f"CAST(u >= {total!r} AS INTEGER)")
    return " + ".join(out)


_POISSON = _steps([math.exp(-3.0) * 3.0**k / math.factorial(k) for k in range(24)])
_BINOMIAL = _steps([math.comb(10, k) * 0.3**k * 0.7 ** (10 - k) for k in range(10)])


@query(f"""
WITH s AS (SELECT o_orderkey, (o_orderkey * 7919 % 9973 + 0.5) / 9973 AS u, (o_custkey * 31 % 997 + 0.5) / 997 AS v FROM orders)
SELECT o_orderkey, round(2 + u * 3, 6) AS uniform, CAST(u < 0.2 AS INTEGER) AS weighted, {_POISSON} AS poisson, {_BINOMIAL} AS binomial,
       round(1 + 2 * sqrt(-2 * ln(1 - u)) * cos(2 * pi() * v), 6) AS normal FROM s""")
def samplers_by_inverse(spark, sf_dir):
    u, v = (F.col("o_orderkey") * 7919 % 9973 + 0.5) / 9973, (F.col("o_custkey") * 31 % 997 + 0.5) / 997
    s = table(spark, sf_dir, "orders").select("o_orderkey", u.alias("u"), v.alias("v"))
    u, v = F.col("u"), F.col("v")
    return s.select("o_orderkey", F.round(samplers.uniform(u, 2.0, 5.0), 6).alias("uniform"), samplers.weighted_coin(u, 0.2).alias("weighted"), samplers.poisson(u, 3.0).alias("poisson"), samplers.binomial(u, 10, 0.3).alias("binomial"), F.round(samplers.normal(u, v, 1.0, 2.0), 6).alias("normal"))


@query("""
WITH o AS (SELECT o_orderkey AS k, 'c' || o_custkey % 9 AS c, o_custkey AS b, o_orderkey % 90 + 1 AS n FROM orders)
SELECT k, 'bed' AS preset, c AS chrom, b AS beg, b + n - 1 AS "end" FROM o UNION ALL SELECT k, 'gff', c, b, b + n - 1 FROM o
UNION ALL SELECT k, 'sam', c, b, b + n + 3 - 1 FROM o UNION ALL SELECT k, 'vcf', c, b, CASE WHEN k % 2 = 0 THEN b + n ELSE b + 2 END FROM o""")
def interval_rows(spark, sf_dir):
    text = lambda *c: F.concat_ws("\t", *[x.cast("string") if not isinstance(x, str) else F.lit(x) for x in c])
    c, b, n = F.concat(F.lit("c"), (F.col("o_custkey") % 9).cast("string")), F.col("o_custkey"), F.col("o_orderkey") % 90 + 1
    lines = {
        "bed": text(c, b, b + n),
        "gff": text(c, "s", "f", b + 1, b + n),
        "sam": text("q", "0", c, b + 1, "60", F.concat(F.lit("2S"), n.cast("string"), F.lit("M1I3D")), "*", "0", "0", "a", "I"),
        "vcf": text(c, b + 1, ".", "ACG", "A", ".", ".", F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("X;END="), (b + n + 1).cast("string"))).otherwise(".")),
    }
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("preset"), records.indexed_row(v, k).alias("r")) for k, v in lines.items()])).alias("p")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), rows).select("k", "p.preset", "p.r.*")


@query("""
SELECT o_orderkey, CAST(o_custkey AS INTEGER) AS nm, o_orderstatus AS st, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 7 END AS second, CASE WHEN o_orderkey % 2 = 0 THEN 'NM,ST,bc' ELSE 'NM,XX,bc' END AS names FROM orders""")
def sam_tags(spark, sf_dir):
    """Typed values of tags, and tags set and taken out."""
    o = table(spark, sf_dir, "orders")
    body = F.when(F.col("o_orderkey") % 3 == 0, "B:S,5").otherwise("B:S,5,7")
    tags = F.create_map(F.lit("NM"), F.concat(F.lit("i:"), F.col("o_custkey").cast("string")), F.lit("ST"), F.concat(F.lit("Z:"), "o_orderstatus"), F.lit("bc"), body)
    t = o.select("o_orderkey", tags.alias("t"))
    t = t.withColumn("u", F.when(F.col("o_orderkey") % 2 == 0, records.set_tag(F.col("t"), "NM", F.lit("i:1"))).otherwise(records.set_tag(records.set_tag(F.col("t"), "ST", None), "XX", F.lit("A:c"))))
    c = F.col("t")
    return t.select("o_orderkey", records.tag(c, "NM", "int").alias("nm"), records.tag(c, "ST").alias("st"), F.get(records.tag(c, "bc", "ints"), F.lit(1)).alias("second"), F.array_join(F.array_sort(F.map_keys("u")), ",").alias("names"))


@query("""
SELECT p_partkey, p_size % 3 = 0 AS passes, CASE WHEN p_size % 3 = 0 THEN 'q10' WHEN p_size % 3 = 1 THEN 's50,q10' ELSE 'q10' END AS added, CASE WHEN p_size % 3 = 1 THEN '' WHEN p_size % 3 = 0 THEN '' ELSE 'q10' END AS removed,
       CASE p_partkey % 3 WHEN 0 THEN 'rs1' WHEN 1 THEN 'rs1;x' ELSE 'a;rs1' END AS id, 'DP=' || p_size || CASE WHEN p_partkey % 2 = 0 THEN ';END=9' ELSE '' END AS info,
       CASE WHEN p_partkey % 2 = 0 THEN 'GT:GQ|0/1:7,1/1:8' ELSE 'GT:DP:GQ|0/1:3:7,1/1:.:8' END AS formats, CASE WHEN p_partkey % 2 = 0 THEN 'GQ|9,.' ELSE 'DP:GQ|3:9,.:.' END AS without FROM part""")
def variant_edits(spark, sf_dir):
    """Filters, names, info and format fields added, set and taken out."""
    k, odd = F.col("p_partkey"), F.col("p_partkey") % 2 == 1
    filters = F.when(F.col("p_size") % 3 == 0, F.array().cast("array<string>")).when(F.col("p_size") % 3 == 1, F.array(F.lit("s50"))).otherwise(F.array(F.lit("q10")))
    info = F.create_map(F.lit("END"), F.lit("9"))
    fmt = F.when(odd, F.array(*map(F.lit, ("GT", "DP", "GQ")))).otherwise(F.array(F.lit("GT"), F.lit("GQ")))
    samples = F.when(odd, F.array(F.lit("0/1:3:9"), F.lit("1/1"))).otherwise(F.array(F.lit("0/1:9"), F.lit("1/1")))
    ids = F.when(k % 3 == 1, "rs1;x").when(k % 3 == 2, "a")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", filters.alias("f"), info.alias("i"), fmt.alias("fmt"), samples.alias("s"), ids.alias("ids"))
    f, i = F.col("f"), variants.update_info(F.col("i"), "DP", F.col("p_size").cast("string"))
    i = F.when(F.col("p_partkey") % 2 == 0, i).otherwise(variants.update_info(i, "END", None))
    shown = lambda c: F.concat(F.array_join(c["format"], ":"), F.lit("|"), F.array_join(c["samples"], ","))
    return p.select(
        "p_partkey", variants.has_filter(f, "PASS").alias("passes"), F.array_join(variants.add_filter(f, "q10"), ",").alias("added"), F.array_join(variants.remove_filter(f, "s50"), ",").alias("removed"), variants.add_id(F.col("ids"), "rs1").alias("id"),
        F.array_join(F.transform(F.array_sort(F.map_entries(i)), lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("info"),
        shown(variants.update_format(F.col("fmt"), F.col("s"), "GQ", F.array(F.lit("7"), F.lit("8")))).alias("formats"), shown(variants.update_format(F.col("fmt"), F.col("s"), "GT", None)).alias("without"),
    )


@query("""
WITH g AS (SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, l_suppkey AS s, l_extendedprice AS e, l_partkey % 4 AS a, l_suppkey % 4 AS b FROM lineitem),
     u AS (SELECT *, list_sort(list_distinct(list_filter([a, b], lambda x: x > 0))) AS used FROM g)
SELECT k, n, p, s, e, array_to_string(list_transform(used, lambda x: ['A', 'C', 'G'][x]), ',') AS alts, coalesce(list_position(used, a), 0) || '/' || coalesce(list_position(used, b), 0) AS gt,
       'A,G' AS left_alts, ['0', '1', '.', '2'][a + 1] || '/' || ['0', '1', '.', '2'][b + 1] AS left_gt, 'a,c|r,a,c' AS fields FROM u""")
def allele_trim(spark, sf_dir):
    """Unused alternatives taken out, and the second one removed, with genotypes renumbered."""
    gt = F.concat((F.col("l_partkey") % 4).cast("string"), F.lit("/"), (F.col("l_suppkey") % 4).cast("string"))
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), F.col("l_extendedprice").alias("e"), F.array(gt).alias("g"))
    alts, gone = F.array(*map(F.lit, "ACG")), F.array(F.lit(2))
    t, r = variants.trim_alleles(alts, F.col("g")), variants.remove_alleles(alts, F.col("g"), gone)
    per = lambda v, kind: F.array_join(variants.per_allele(F.array(*map(F.lit, v)), gone, kind), ",")
    out = li.withColumns({"t": t, "r": r})
    return out.select("k", "n", "p", "s", "e", F.array_join("t.alts", ",").alias("alts"), F.get("t.genotypes", F.lit(0)).alias("gt"), F.array_join("r.alts", ",").alias("left_alts"), F.get("r.genotypes", F.lit(0)).alias("left_gt"), F.concat(per("abc", "A"), F.lit("|"), per("rabc", "R")).alias("fields"))


_KEYS = {
    "exact": "alleles", "any": "''", "snps": "CASE WHEN kind = 1 THEN 'snp' ELSE alleles END", "indels": "CASE WHEN kind = 4 THEN 'indel' ELSE alleles END", "both": "CASE kind WHEN 1 THEN 'snp' WHEN 4 THEN 'indel' ELSE alleles END",
    "snps_ref": "CASE WHEN kind IN (0, 1) THEN 'snp' ELSE alleles END", "indels_ref": "CASE WHEN kind IN (0, 4) THEN 'indel' ELSE alleles END", "both_ref": "CASE WHEN kind IN (0, 1, 4) THEN 'any' ELSE alleles END",
}
_SITE = "'c' || {key} % 5 AS chrom, {key} // 7 AS pos, ['A', 'AC'][CAST({key} % 2 + 1 AS INTEGER)] AS ref, ['A', 'C', 'ACT', 'AC', 'G'][CAST({other} % 5 + 1 AS INTEGER)] AS alt, {key} AS id"
_SITES = f"""
WITH l0 AS (SELECT {_SITE.format(key="p_partkey", other="p_size")} FROM part), r0 AS (SELECT {_SITE.format(key="s_suppkey", other="(s_suppkey * 3)")} FROM supplier),
     l AS (SELECT *, ref || '>' || alt AS alleles, CASE WHEN ref = alt THEN 0 WHEN length(ref) = length(alt) THEN 1 ELSE 4 END AS kind FROM l0), r AS (SELECT *, ref || '>' || alt AS alleles, CASE WHEN ref = alt THEN 0 WHEN length(ref) = length(alt) THEN 1 ELSE 4 END AS kind FROM r0)"""


@query(_SITES + " UNION ALL ".join(f" SELECT '{m}' AS mode, l.id AS l_id, r.id AS r_id FROM (SELECT *, {k} AS key FROM l) l FULL JOIN (SELECT *, {k} AS key FROM r) r ON l.chrom = r.chrom AND l.pos = r.pos AND l.key = r.key" for m, k in _KEYS.items()))
def synced_modes(spark, sf_dir):
    """All pairing modes of the synchronised join on the same two tables."""

    def sites(name, key, other):
        k = F.col(key)
        at = lambda values, i: F.get(F.array(*map(F.lit, values)), i.cast("int"))
        df = table(spark, sf_dir, name).select(F.concat(F.lit("c"), (k % 5).cast("string")).alias("chrom"), F.floor(k / 7).cast("long").alias("pos"), at(("A", "AC"), k % 2).alias("ref"), at(("A", "C", "ACT", "AC", "G"), other % 5).alias("alt"), k.alias("id"))
        kind = F.when(F.col("ref") == F.col("alt"), variants.REF).when(F.length("ref") == F.length("alt"), variants.SNP).otherwise(variants.INDEL)
        return df.withColumn("kind", kind)

    left, right = sites("part", "p_partkey", F.col("p_size")), sites("supplier", "s_suppkey", F.col("s_suppkey") * 3)
    out = None
    for mode in _KEYS:
        one = variants.synced(left, right, mode).select(F.lit(mode).alias("mode"), "l_id", "r_id")
        out = one if out is None else out.unionByName(one)
    return out


@query("""
WITH c AS (SELECT o_orderkey, (o_orderkey % 3000) * 281474976710656 + (o_custkey % 5000) * 4294967296 + 65536 * 700 + 12 AS v, o_orderkey % 3000 AS a, o_custkey % 5000 AS c FROM orders)
SELECT o_orderkey, a / 100 AS snr_a, c / 100 AS snr_c, 7.0::DOUBLE AS snr_g, 0.12::DOUBLE AS snr_t FROM c""")
def score_scaling(spark, sf_dir):
    v = F.shiftleft(F.col("o_orderkey") % 3000, 48) + F.shiftleft(F.col("o_custkey") % 5000, 32) + F.lit(65536 * 700 + 12)
    s = table(spark, sf_dir, "orders").select("o_orderkey", blocked.snr_of(v).alias("s"))
    return s.select("o_orderkey", *[F.get("s", F.lit(i)).alias(f"snr_{c}") for i, c in enumerate("acgt")])


@query("""
WITH c AS (SELECT DISTINCT ascii(unnest(string_split(c_name, ''))) AS sym FROM customer WHERE c_name <> ''), s AS (SELECT sym, CAST(row_number() OVER (ORDER BY sym) - 1 AS INTEGER) AS code FROM c WHERE sym > 0 AND sym < 128),
     b AS (SELECT CAST(unnest(range(256)) AS INTEGER) AS byte), d AS (SELECT byte, code, row_number() OVER (PARTITION BY byte ORDER BY abs(sym - byte), sym) AS rn FROM b CROSS JOIN s)
SELECT byte, code FROM d WHERE rn = 1""")
def nearest_symbols(spark, sf_dir):
    return stats.nearest_codes(stats.symbols(table(spark, sf_dir, "customer"), "c_name"))


@query("""
SELECT o_orderkey, round(lgamma(o_orderkey % 500 + 0.5), 6) AS log_gamma, round(1 - exp(-x), 9) AS p1, round(1 - exp(-x) * (1 + x), 9) AS p2, round(exp(-x) * (1 + x + x * x / 2), 9) AS q3
FROM (SELECT *, (o_custkey % 400) / 20.0 AS x FROM orders)""")
def special_functions(spark, sf_dir):
    """Incomplete gamma functions of whole shapes have closed forms."""
    x = (F.col("o_custkey") % 400) / 20.0
    one = lambda f, s: F.round(f(F.lit(float(s)), F.col("x")), 9)
    o = table(spark, sf_dir, "orders").select("o_orderkey", x.alias("x"))
    return o.select("o_orderkey", F.round(special.log_gamma(F.col("o_orderkey") % 500 + 0.5), 6).alias("log_gamma"), one(special.gamma_p, 1).alias("p1"), one(special.gamma_p, 2).alias("p2"), one(special.gamma_q, 3).alias("q3"))
