"""Sequence, alignment, map and variant files as tables, read by Spark's text source.

FASTA and SAM rows, VCF rows and interval rows need no shuffle; FASTQ records are put together
where they lie. Compressed files are read by Hadoop's codecs. Empty files give empty tables.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.sources.numbered import assembled, numbered

#: Suffixes by which inputs are told apart.
SUFFIXES = {"fastq": (".fastq", ".fq"), "fasta": (".fasta", ".fa"), "sam": (".sam",), "bam": (".bam",), "cram": (".cram",), "vcf": (".vcf",), "bnx": (".bnx",), "bed": (".bed",)}


def file_kind(path: str) -> str:
    """The format that a path's suffix names; .gz is looked through."""
    plain = path.removesuffix(".gz")
    for kind, ends in SUFFIXES.items():
        if plain.endswith(ends):
            return kind
    raise ValueError(f"no known suffix: {path}")


def one_kind(paths: list[str]) -> str:
    kinds = {file_kind(p) for p in paths}
    if len(kinds) != 1:
        raise ValueError(f"files of several kinds: {sorted(kinds)}")
    return kinds.pop()


def _name_parts(header: Column) -> tuple[Column, Column]:
    name = F.regexp_extract(header, r"^\S*", 0)
    rest = F.ltrim(F.substring(header, F.length(name) + 1, F.length(header)))
    return name, F.when(rest != "", rest)


def read_fastq(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, record (from 0), id, description, seq, qual. Four lines a record; one that breaks a rule stops the query."""
    got = assembled(numbered(spark, path), 4)
    clean = F.transform("parts", lambda x: F.regexp_replace(x, "\r$", ""))
    got = got.select("file", "record", clean.alias("p"))
    wrong = (
        F.when(F.size("p") < 4, "a record is cut off")
        .when(~F.col("p")[0].startswith("@"), "a header does not begin with @")
        .when(~F.col("p")[2].startswith("+"), "the third line does not begin with +")
        .when(F.length(F.col("p")[1]) != F.length(F.col("p")[3]), "sequence and quality differ in length")
        .when(~F.col("p")[3].rlike(r"^[!-~]*$"), "a quality letter is out of range")
    )
    checked = F.when(wrong.isNotNull(), F.raise_error(F.concat(wrong, F.lit(": record "), F.col("record").cast("string"))).cast("string")).otherwise(F.col("p")[0])
    head = F.substring(checked, 2, 1 << 30)
    name, rest = _name_parts(head)
    return got.select("file", "record", name.alias("id"), rest.alias("description"), F.get("p", F.lit(1)).alias("seq"), F.get("p", F.lit(3)).alias("qual"))


def read_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, start (of its split), id, description, seq of each entry, the last one too. Lines of a sequence are joined."""
    rows = spark.read.option("lineSep", "\n>").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    value = F.regexp_replace("value", "^\\s*>", "")
    head = F.regexp_replace(F.substring_index(value, "\n", 1), "\r$", "")
    body = F.regexp_replace(F.substring(value, F.length(F.substring_index(value, "\n", 1)) + 2, F.length(value)), r"[\r\n]", "")
    name, rest = _name_parts(head)
    return rows.filter(F.trim("value") != "").select("file", "start", name.alias("id"), rest.alias("description"), body.alias("seq"))


SAM_COLUMNS = ("qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual")


def sam_fields(line: Column) -> Column:
    """A struct of the eleven fields and `tags` map<string, string> (name to type:value)."""
    p = F.split(line, "\t")
    numbers = {"flag": "int", "pos": "long", "mapq": "int", "pnext": "long", "tlen": "long"}
    cols = [p[i].cast(numbers.get(c, "string")).alias(c) for i, c in enumerate(SAM_COLUMNS)]
    rest = F.slice(p, 12, F.greatest(F.size(p) - 11, F.lit(0)))
    tags = F.map_from_entries(F.transform(rest, lambda t: F.struct(F.substring(t, 1, 2).alias("k"), F.substring(t, 4, 1 << 30).alias("v"))))
    return F.struct(*cols, tags.alias("tags"))


def read_sam(spark: SparkSession, path: str | list[str]) -> DataFrame:
    rows = spark.read.text(path).filter(~F.col("value").startswith("@") & (F.col("value") != ""))
    return rows.select(sam_fields(F.col("value")).alias("r")).select("r.*")


def sam_header(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """record, fields map<string, string> of the header lines; @CO has its text under 'text'."""
    rows = spark.read.text(path).filter(F.col("value").startswith("@"))
    p = F.split("value", "\t")
    kind = F.substring(p[0], 2, 2)
    parts = F.transform(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), lambda t: F.struct(F.substring(t, 1, 2).alias("k"), F.substring(t, 4, 1 << 30).alias("v")))
    text = F.create_map(F.lit("text"), F.array_join(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), "\t"))
    return rows.select(kind.alias("record"), F.when(kind == "CO", text).otherwise(F.map_from_entries(parts)).alias("fields"))


def program_chain(header: DataFrame, last: str) -> DataFrame:
    """step, id of the programs from `last` back along PP; a chain that comes back to itself is an error. A header has few programs."""
    pg = {r[0]: r[1] for r in header.filter("record = 'PG'").select(F.col("fields")["ID"], F.col("fields")["PP"]).collect()}
    out, at = [], last
    while at is not None:
        if len(out) > len(pg):
            raise ValueError(f"the programs before {last!r} form a ring")
        out.append((len(out), at))
        at = pg.get(at)
    return header.sparkSession.createDataFrame(out, "step int, id string")


def sam_line(r: dict[str, Column] | None = None) -> Column:
    """A row's text from the columns of read_sam()."""
    c = r or {}
    get = lambda n: c.get(n, F.col(n))
    tags = F.transform(F.array_sort(F.map_entries(get("tags"))), lambda e: F.concat(e["key"], F.lit(":"), e["value"]))
    return F.concat_ws("\t", *[get(n).cast("string") for n in SAM_COLUMNS], tags)


def tag(tags: Column, name: str, kind: str = "string") -> Column:
    """A tag's value without its type letter; null where it is absent. Kinds: string, int, float, ints, floats."""
    v = F.try_element_at(tags, F.lit(name))
    body = F.substring(v, 3, 1 << 30)
    if kind in ("ints", "floats"):
        return F.transform(F.slice(F.split(body, ","), 2, 1 << 30), lambda x: x.cast("int" if kind == "ints" else "float"))
    return body.cast({"int": "int", "float": "float"}.get(kind, kind))


def set_tag(tags: Column, name: str, typed: Column | None) -> Column:
    """The tags with one set to 'type:value', or without it."""
    kept = F.map_filter(tags, lambda k, _: k != name)
    return kept if typed is None else F.map_concat(kept, F.create_map(F.lit(name), typed))


def long_reads(sam: DataFrame) -> DataFrame:
    """Reads of a single-molecule sequencer: secondary rows dropped, tags as typed columns, `movie` and `ln`.

    Each row has its own values: what its tags lack is null.
    """
    kept = sam.filter(F.col("flag").bitwiseAND(F.lit(0x900)) == 0)
    t = F.col("tags")
    bc = tag(t, "bc", "ints")
    return kept.select(
        "qname",
        F.substring_index("qname", "/", 1).alias("movie"),
        F.length("seq").alias("ln"),
        "seq",
        "qual",
        tag(t, "zm", "int").alias("zm"),
        tag(t, "qs", "int").alias("qs"),
        tag(t, "qe", "int").alias("qe"),
        tag(t, "rq", "float").alias("rq"),
        tag(t, "np", "int").alias("np"),
        F.get(bc, F.lit(0)).alias("bc1"),
        F.get(bc, F.lit(1)).alias("bc2"),
        tag(t, "bq", "int").alias("bq"),
        tag(t, "sn", "floats").alias("sn"),
        tag(t, "pw", "ints").alias("pw"),
    )


VCF_COLUMNS = ("chrom", "pos", "id", "ref", "alts", "qual", "filters", "info", "format", "samples")


def vcf_fields(line: Column) -> Column:
    p = F.split(line, "\t")
    missing = lambda c: F.when(c != ".", c)
    listed = lambda c, sep: F.when(c == ".", F.array().cast("array<string>")).otherwise(F.split(c, sep))
    items = F.transform(F.split(p[7], ";"), lambda kv: F.struct(F.substring_index(kv, "=", 1).alias("k"), F.when(kv.contains("="), F.substring(kv, F.length(F.substring_index(kv, "=", 1)) + 2, F.length(kv))).otherwise("").alias("v")))
    info = F.when(p[7] == ".", F.create_map().cast("map<string,string>")).otherwise(F.map_from_entries(items))
    return F.struct(
        p[0].alias("chrom"),
        p[1].cast("long").alias("pos"),
        missing(p[2]).alias("id"),
        p[3].alias("ref"),
        listed(p[4], ",").alias("alts"),
        missing(p[5]).cast("double").alias("qual"),
        F.when(p[6].isin("PASS", "."), F.array().cast("array<string>")).otherwise(F.split(p[6], ";")).alias("filters"),
        info.alias("info"),
        F.split(F.coalesce(F.get(p, F.lit(8)), F.lit("")), ":").alias("format"),
        F.slice(p, 10, F.greatest(F.size(p) - 9, F.lit(0))).alias("samples"),
    )


def read_vcf(spark: SparkSession, path: str | list[str]) -> DataFrame:
    rows = spark.read.text(path).filter(~F.col("value").startswith("#") & (F.col("value") != ""))
    return rows.select(vcf_fields(F.col("value")).alias("r")).select("r.*")


def vcf_samples(spark: SparkSession, path: str) -> list[str]:
    """Names of the samples, from the line of column names."""
    row = spark.read.text(path).filter(F.col("value").startswith("#CHROM")).limit(1).collect()
    return row[0][0].split("\t")[9:] if row else []


def sample_value(sample: Column, formats: Column, name: str) -> Column:
    """One of a sample's values by its name in FORMAT; null where it is absent or missing."""
    at = F.array_position(formats, name)
    v = F.get(F.split(sample, ":"), (at - 1).cast("int"))
    return F.when((at > 0) & (v != "."), v)


def subset_samples(vcf: DataFrame, names: list[str], keep: list[str]) -> DataFrame:
    at = [names.index(k) for k in keep]
    return vcf.withColumn("samples", F.array(*[F.get("samples", F.lit(i)) for i in at]) if at else F.array().cast("array<string>"))


def vcf_line() -> Column:
    """A row's text from the columns of read_vcf()."""
    info = F.array_join(F.transform(F.array_sort(F.map_entries("info")), lambda e: F.when(e["value"] == "", e["key"]).otherwise(F.concat_ws("=", e["key"], e["value"]))), ";")
    dot = lambda c: F.coalesce(c.cast("string"), F.lit("."))
    lists = lambda c, sep, empty: F.when(F.size(c) == 0, empty).otherwise(F.array_join(c, sep))
    samples = F.when(F.size("samples") > 0, F.concat(F.array(F.array_join("format", ":")), F.col("samples")))
    return F.concat_ws("\t", "chrom", F.col("pos").cast("string"), dot(F.col("id")), "ref", lists(F.col("alts"), ",", "."), dot(F.col("qual")), lists(F.col("filters"), ";", "PASS"), F.when(info == "", ".").otherwise(info), samples)


def indexed_row(line: Column, preset: str = "bed") -> Column:
    """struct<chrom, beg, end> (0-based, inclusive) of a row of an interval-indexed file: bed, gff, sam or vcf."""
    p = F.split(line, "\t")
    if preset == "bed":
        beg, end = p[1].cast("long"), p[2].cast("long") - 1
        return F.struct(p[0].alias("chrom"), beg.alias("beg"), end.alias("end"))
    if preset == "gff":
        return F.struct(p[0].alias("chrom"), (p[3].cast("long") - 1).alias("beg"), (p[4].cast("long") - 1).alias("end"))
    if preset == "sam":
        from strandframe.functions.scalars import reference_length

        beg = p[3].cast("long") - 1
        return F.struct(p[2].alias("chrom"), beg.alias("beg"), (beg + F.greatest(reference_length(p[5]), F.lit(1)) - 1).alias("end"))
    if preset == "vcf":
        beg = p[1].cast("long") - 1
        stated = F.regexp_extract(p[7], r"(?:^|;)END=(\d+)", 1)
        return F.struct(p[0].alias("chrom"), beg.alias("beg"), F.when(stated != "", stated.cast("long") - 1).otherwise(beg + F.length(p[3]) - 1).alias("end"))
    raise ValueError(f"no preset {preset!r}")


def region_row(line: Column, preset: str) -> Column:
    """A line of a region list: 'tab' is 1-based inclusive, one position may stand alone; 'bed' is half-open."""
    p = F.split(line, "\t")
    if preset == "tab":
        beg = p[1].cast("long") - 1
        return F.struct(p[0].alias("chrom"), beg.alias("beg"), F.coalesce(F.get(p, F.lit(2)).cast("long") - 1, beg).alias("end"))
    return indexed_row(line, preset)


def read_bnx(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, record, length, n_sites, sites, snr, intensity of each optical map.

    A row that begins with 1 has the sites; the two rows after it are signal-to-noise and intensity, in
    that order and unlabelled. The last site is the end of the molecule and no label.
    """
    rows = numbered(spark, path, {"record": "1", "notes": "#"}).filter(~F.col("value").startswith("#") & (F.col("record") > 0))
    # rows of one map: places by line number, so they meet by (file, record)
    cells = F.array_sort(F.collect_list(F.struct("line_no", F.slice(F.split("value", "\t"), 2, 1 << 30).alias("v"))))
    per = rows.filter(~F.col("value").startswith("0")).groupBy("file", "record").agg(cells.alias("c"))
    numbers = lambda i, t: F.transform(F.get("c", F.lit(i))["v"], lambda x: x.cast(t))
    sites = F.transform(numbers(0, "double"), lambda x: F.floor(x).cast("long"))
    out = per.select("file", (F.col("record") - 1).alias("record"), sites.alias("all"), numbers(1, "double").alias("snr"), numbers(2, "double").alias("intensity"))
    return out.select("file", "record", F.element_at("all", -1).alias("length"), (F.size("all") - 1).cast("long").alias("n_sites"), F.slice("all", F.lit(1), F.size("all") - 1).alias("sites"), "snr", "intensity")


#: What the first bytes of a kind of file are.
MAGIC = (("bam", b"BAM\1"), ("bcf", b"BCF\2"), ("cram", b"CRAM"), ("tbi", b"TBI\1"), ("csi", b"CSI\1"), ("bai", b"BAI\1"), ("vcf", b"##fileformat=VCF"), ("bnx", b"# BNX"))


def sniff(spark: SparkSession, path: str) -> tuple[str, str]:
    """(format, compression) by content: of the (first) file, compression none, gzip or blocks.

    Text is told by its first lines: sam, vcf, fasta, fastq, bed, or one-code; else 'text', and 'empty' without any.
    """
    import zlib

    rows = spark.read.option("encoding", "ISO-8859-1").option("lineSep", "\n").text(path).select(F.col("value").cast("binary").alias("v")).limit(40).collect()
    raw, how = b"\n".join(bytes(r.v) for r in rows), "none"
    if raw[:2] == b"\x1f\x8b":  # under a name that Spark does not take for compressed
        how = "blocks" if raw[3:4] == b"\4" and raw[12:14] == b"BC" else "gzip"
        raw = zlib.decompressobj(31).decompress(raw, 1 << 16)
    for name, magic in MAGIC:
        if raw.startswith(magic):
            return name, how
    lines = [x for x in raw.decode("latin-1").split("\n") if x]
    if not lines:
        return "empty", how
    first = next((x for x in lines if not x.startswith("#")), lines[0])
    fields = first.split("\t")
    if re.match(r"@(HD|SQ|RG|PG|CO)\t", first) or len(fields) >= 11 and fields[1].isdigit() and fields[3].isdigit():
        return "sam", how
    if first.startswith(">"):
        return "fasta", how
    if first.startswith("@"):
        return "fastq", how
    if len(fields) >= 3 and fields[1].isdigit() and fields[2].isdigit():
        return "bed", how
    if re.match(r"1 \d+ [a-z]+ \d+ \d+", first):
        return "one", how
    return "text", how


def merge_vcf_headers(*headers: list[str]) -> list[str]:
    """One header of several: each definition once, in order of first sight, samples side by side.

    The same name defined with another Number or Type, and a sample that two files have, are errors.
    """
    out, seen, samples = [], {}, []
    for lines in headers:
        for x in lines:
            if x.startswith("#CHROM"):
                own = x.split("\t")[9:]
                if twice := set(own) & set(samples):
                    raise ValueError(f"samples of two files: {sorted(twice)}")
                samples += own
                continue
            m = re.match(r"##(\w+)=<.*?ID=([^,>]+)", x)
            key = (m[1], m[2]) if m else (x,)
            what = tuple(re.findall(r"(?:Number|Type)=([^,>]+)", x)) if m else ()
            if key not in seen:
                if not (x.startswith("##fileformat") and out):
                    out.append(x)
                seen[key] = what
            elif seen[key] != what:
                raise ValueError(f"{key[1]} is defined in two ways: {x}")
    names = "#CHROM POS ID REF ALT QUAL FILTER INFO".split()
    return [*out, "\t".join([*names, *(["FORMAT", *samples] if samples else [])])]
