"""Sources and sinks: small files of the published shapes, round trips and malformed input."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from strandframe.sources import binary, blocked, codec, numbered, records, tagged
from strandframe.sources import schema as S

TYPES = S.genomics()


def put(path, text: str) -> str:
    path.write_bytes(text.encode())
    return f"file://{path}"


# --- schemas -------------------------------------------------------------------------------


def test_registry():
    assert list(TYPES) == ["seq", "rmp", "aln", "hit", "jns", "brk", "lis"]
    assert sum(len(t.secondaries) for t in TYPES.values()) == 16
    assert TYPES["seq"].object == "S" and TYPES["seq"].group == "g" and TYPES["hit"].group is None
    assert S.find(TYPES, "10x").primary == "seq"
    assert [f.dataType.simpleString() for f in TYPES["seq"].struct("W")] == ["bigint", "bigint", "bigint", "double"]
    assert S.parse_schema(TYPES["aln"].text())["aln"].lines == TYPES["aln"].lines


@pytest.mark.parametrize(
    "text",
    [
        "P 3 abc\nD X 1 3 INT\n",  # no object
        "P 3 abc\nO X 1 3 INT\nO Y 1 3 INT\n",
        "P 3 abc\nG g 0\nG h 0\nO X 0\n",
        "P 3 abc\nO X 0\nD X 0\n",
        "P 3 abc\nO 7 0\n",
        "P 4 abcd\nO X 0\n",
        "P 3 abc\nO X 1 4 WORD\n",
        "P 3 abc\nO X 2 6 STRING 3 DNA\n",
        "P 3 abc\nO X 1 5 INT\n",
        "P 3 abc\nO X 33" + " 3 INT" * 33 + "\n",
        "O X 0\n",
    ],
)
def test_bad_schemas(text):
    with pytest.raises(S.SchemaError):
        S.parse_schema(text)


def test_requirement_check():
    need = S.parse_schema("P 3 seq\nO S 1 3 DNA\nD Q 1 6 STRING\n")["seq"]
    assert S.mismatches(TYPES["seq"], need) == []
    assert S.mismatches(S.parse_schema("P 3 seq\nO S 1 6 STRING\n")["seq"], need) == ["line S has fields ('STRING',), not ('DNA',)", "line Q is missing"]


# --- text form -----------------------------------------------------------------------------

PAIRS = """1 3 seq 1 1
2 3 irp
! 4 4 made 3 1.0 7 by hand 19 2020-01-01_00:00:00
.
# P 3
# S 6
@ S 5
+ S 26
g 2 5 lane1
P
S 5 acgta
I 4 r 1a
S 3 ACN
P
S 4 ccgg with a comment
S 5 ttttt
g 1 5 lane2
P
S 4 aaaa
S 5 ggggg
"""


def test_pairs(spark, tmp_path):
    at = put(tmp_path / "x.irp", PAIRS)
    head = tagged.header(spark, at, TYPES)
    assert head.secondary == "irp" and head.provenance == [("made", "1.0", "by hand", "2020-01-01_00:00:00")] and head.counts["+", "S"] == 26
    table = tagged.lines(spark, at, head.type).cache()
    rows = tagged.objects(table, head.type).orderBy("obj_ord").collect()
    assert [r.S for r in rows] == ["acgta", "aca", "ccgg", "ttttt", "aaaa", "ggggg"]
    assert [r.P for r in rows] == [True, None] * 3  # a pair mark belongs to the sequence after it
    assert rows[0].I == "r 1a" and [r.group_ord for r in rows] == [0, 0, 0, 0, 1, 1]
    g = tagged.groups(table, head.type).orderBy("group_ord").collect()
    assert [(r.g0, r.g1, r.first_obj, r.n_obj) for r in g] == [(2, "lane1", 0, 4), (1, "lane2", 4, 2)]
    assert [(r.given, r.found) for r in tagged.group_mismatches(table, head.type).orderBy("group_ord").collect()] == [(2, 4), (1, 2)]
    n = {r.line_type: r for r in tagged.counts(table, head.type).collect()}
    assert (n["S"].n, n["S"].max_len, n["S"].total_len, n["S"].group_max_n, n["S"].group_max_len) == (6, 5, 26, 4, 17)
    off = {(r.line_type, r.sign): r.state for r in tagged.count_mismatches(tagged.counts(table, head.type), head).collect()}
    assert ("S", "#") not in off and off["I", "#"] == "missing"
    note = table.filter("line_type = 'S'").select(tagged.parse(("DNA",), F.col("value"))[1].alias("c")).filter("c is not null").collect()
    assert [r.c for r in note] == ["with a comment"]


def test_sticky_and_lists(spark, tmp_path):
    at = put(tmp_path / "x.aln", "1 3 aln 1 0\n2 3 sxs\nT 100\ng 2 0 \nA 1 2\nI 0 10 0 20 10 0\nW 3 1 -2 3\nA 3 4\nT 50\nA 5 6\nW 0\nX 1 7\n")
    head = tagged.header(spark, at, TYPES)
    rows = tagged.objects(tagged.lines(spark, at, head.type), head.type).orderBy("obj_ord").collect()
    assert [r["T"] for r in rows] == [100, 100, 50]
    assert rows[0].W == [1, -2, 3] and rows[2].W == [] and rows[2].X == [7] and rows[1].W is None
    assert (rows[0].I.I3, rows[0].I.I4) == (20, 10) and rows[0].group_ord == 0


@pytest.mark.parametrize("body", ["S 9 acgt\n", "S x acgt\n", "Z 1\n"])
def test_malformed_lines(spark, tmp_path, body):
    at = put(tmp_path / "x.seq", f"1 3 seq 1 0\nS 1 a\n{body}")
    with pytest.raises(Exception, match="shorter|CAST_INVALID|unknown"):
        tagged.objects(tagged.lines(spark, at, TYPES["seq"]), TYPES["seq"]).collect()


def test_headers_that_do_not_fit(spark, tmp_path):
    with pytest.raises(S.SchemaError):
        tagged.header(spark, put(tmp_path / "a", "S 1 a\n"))  # says no type
    with pytest.raises(S.SchemaError):
        tagged.header(spark, put(tmp_path / "b", "1 3 seq 2 0\n"), TYPES)
    with pytest.raises(S.SchemaError):
        tagged.header(spark, put(tmp_path / "c", "1 3 seq 1 0\n"))  # has no schema
    with pytest.raises(S.SchemaError):
        tagged.header(spark, put(tmp_path / "d", "1 3 seq 1 0\n~ O S 1 6 STRING\n"), TYPES)
    with pytest.raises(S.SchemaError):
        tagged.header(spark, put(tmp_path / "e", "1 3 seq 1 0\n2 3 zzz\n"), TYPES)
    assert tagged.header(spark, put(tmp_path / "f", "S 1 a\n"), TYPES, "ctg").type.primary == "seq"


def test_text_round_trip(spark, tmp_path):
    at = put(tmp_path / "x.irp", PAIRS)
    head = tagged.header(spark, at, TYPES)
    table = tagged.lines(spark, at, head.type)
    rows, grp = tagged.objects(table, head.type), tagged.groups(table, head.type)
    out = str(tmp_path / "copy")
    new = tagged.inherit(head, step=("copy", "1.1", "copy x", "2021-01-01_00:00:00"))
    tagged.write_text(tagged.object_lines(rows, head.type, grp), tagged.header_lines(new, tagged.counts(table, head.type).collect()), out)
    again = tagged.header(spark, out)  # by the schema that it embeds
    assert again.type.lines == TYPES["seq"].lines and len(again.provenance) == 2
    t2 = tagged.lines(spark, out, again.type, whole=True).cache()
    pick = lambda df: [tuple(r)[1:] for r in df.orderBy("obj_ord").collect()]
    assert pick(tagged.objects(t2, again.type)) == pick(rows)
    assert [r.g0 for r in tagged.groups(t2, again.type).orderBy("group_ord").collect()] == [4, 2]  # sizes are computed
    assert tagged.count_mismatches(tagged.counts(t2, again.type), again).count() == 0
    assert tagged.group_mismatches(t2, again.type).count() == 0


def test_every_field_type_round_trips(spark, tmp_path):
    kind = S.parse_schema("P 3 all\nO O 4 3 INT 4 REAL 4 CHAR 11 STRING_LIST\nD L 2 9 REAL_LIST 3 INT\nD S 2 6 STRING 3 INT\nD D 1 3 DNA\n")["all"]
    data = [(0, (5, 0.1, "x", ["a b", "", "é ü"]), ([1.5, -2e-300], 7), ("two words é", 3), "acgt"), (1, (-5, 1e300, "-", []), ([], 0), ("", -1), "")]
    schema = "obj_ord long, O struct<O0:long,O1:double,O2:string,O3:array<string>>, L struct<L0:array<double>,L1:long>, S struct<S0:string,S1:long>, D string"
    df = spark.createDataFrame(data, schema)
    out = str(tmp_path / "all")
    tagged.write_text(tagged.object_lines(df, kind), tagged.header_lines(tagged.Header(kind)), out)
    back = tagged.objects(tagged.lines(spark, out, kind, whole=True), kind).orderBy("obj_ord").select("obj_ord", "O", "L", "S", "D").collect()
    assert [tuple(r) for r in back] == [tuple(r) for r in df.collect()]


def test_numbering_over_splits(spark, tmp_path):
    body = "".join(f"{'S' if i % 3 == 0 else 'I'} line {i}\n" for i in range(3000))
    at = put(tmp_path / "many.txt", body)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
        rows = numbered.numbered(spark, at, {"n": "S"}, "S").orderBy("line_no").collect()
        assert numbered.numbered(spark, at).rdd.getNumPartitions() > 5
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r.line_no for r in rows] == list(range(3000))
    assert [r.n for r in rows] == [i // 3 + 1 for i in range(3000)]
    assert [r.last_S for r in rows] == [f"S line {i - i % 3}" for i in range(3000)]


def test_empty_file(spark, tmp_path):
    at = put(tmp_path / "none.txt", "")
    assert numbered.numbered(spark, at, {"n": "S"}, "S").count() == 0
    assert records.read_fastq(spark, at).count() == 0 and records.read_fasta(spark, at).count() == 0


def test_names(tmp_path):
    have = {"a.fastq", "b.1.las", "b.2.las", "b.3.las"}
    assert tagged.resolve("a", [".fq", ".fastq"], have.__contains__) == "a.fastq"
    assert tagged.expand_blocks("b.@.las", have.__contains__) == ["b.1.las", "b.2.las", "b.3.las"]
    assert tagged.expand_blocks("b.@2.las", have.__contains__) == ["b.2.las", "b.3.las"]
    assert tagged.expand_blocks("b.@1-2.las", have.__contains__) == ["b.1.las", "b.2.las"]
    with pytest.raises(FileNotFoundError):
        tagged.expand_blocks("b.@2-5.las", have.__contains__)
    assert records.one_kind(["a.fq.gz", "b.fastq"]) == "fastq"
    with pytest.raises(ValueError):
        records.one_kind(["a.fq", "b.fasta"])


# --- codes ---------------------------------------------------------------------------------


def test_integer_codes():
    values = [0, 1, -1, 63, 64, -64, -65, 8191, 8192, 65535, 65536, *[s * (1 << k) + d for k in range(7, 63) for s in (1, -1) for d in (-1, 0, 1)], (1 << 63) - 1, -(1 << 63)]
    for v in values:
        raw = codec.put_int(v)
        assert codec.get_int(raw + b"xx", 0) == (v, len(raw)), v
        assert 1 <= len(raw) <= 9
    assert len(codec.put_int(8191)) == 2 and len(codec.put_int(-8191)) == 3 and len(codec.put_int(1 << 62)) == 9


def test_integer_lists():
    rng = random.Random(1)
    for size in (1, 2, 50):
        for width in (3, 12, 40, 62):
            v = [rng.randint(-(1 << width), 1 << width) for _ in range(size)]
            first, n, raw = codec.put_ints(v)
            got = [codec.get_int(first, 0)[0]] if n == 0 else codec.get_ints(codec.get_int(first, 0)[0], n, raw)
            assert got == v


def test_dna_codes():
    for text in (b"", b"a", b"acgtacg", b"ACGTN"):
        assert codec.unpack_dna(codec.pack_dna(text), len(text)) == text.lower().replace(b"n", b"a")


def test_huffman():
    rng = random.Random(2)
    for n in (1, 5, 9, 40, 300, 5000):
        data = bytes(rng.choice(b"aaaaaaaaaaaabbbbbccd" + bytes(range(60, 70))) for _ in range(n))
        h = codec.Huffman.trained({b: data.count(bytes([b])) for b in set(data)})
        assert max(h.lengths.values()) <= codec.LONGEST and sum(2.0**-k for k in h.lengths.values()) <= 1
        again = codec.Huffman.loads(h.dumps())
        for extra in (b"", b"\x01\xff\x02"):
            bits, raw = h.encode(data + extra)
            assert len(raw) == (bits + 7) // 8 and again.decode(bits, raw) == data + extra
    skewed = {i: 1 << i for i in range(40)}
    assert max(codec.code_lengths(skewed).values()) == codec.LONGEST


# --- binary form ---------------------------------------------------------------------------


def make_binary(kind, head, found, objects, codes=None, parts=2):
    """objects: (lines) of each; half of them in each part."""
    made = []
    for k in range(parts):
        e = binary.Encoder(kind, codes)
        for rows in objects[k * len(objects) // parts : (k + 1) * len(objects) // parts]:
            for code, values in rows:
                e.line(code, values)
        made.append((e.data(), e.places, e.group_at))
    return binary.stitched(head, found, made, codes)


@pytest.mark.parametrize("compressed", [False, True])
def test_binary_round_trip(spark, tmp_path, compressed):
    kind = TYPES["seq"]
    rng = random.Random(3)
    objects, want = [], []
    for i in range(50):
        rows = [("g", [0, f"lane {i // 10}"])] if i % 10 == 0 else []
        rows += [("P", [])] if i % 2 == 0 else []
        seq = "".join(rng.choice("acgt") for _ in range(rng.randint(0, 60)))
        qual = "".join(rng.choice("!!!!!IIIIJ~") for _ in seq)
        rows += [("S", [seq]), ("Q", [qual]), ("W", [i, -i, i * 1000, 0.25])]
        objects.append(rows)
        want.append((i, i // 10, seq, qual, (i, -i, i * 1000, 0.25), True if i % 2 == 0 else None))
    codes = {"Q": codec.Huffman.trained({ord(c): n for c, n in zip("!IJ", (50, 40, 10))})} if compressed else None
    head = tagged.Header(kind, "irp", [("made", "1.0", "now", "2020-01-01_00:00:00")])
    raw = make_binary(kind, head, [], objects, codes)
    path = tmp_path / "x.1irp"
    path.write_bytes(raw)
    for table in (binary.scan(spark, str(path), objects=7), binary.scan_any(spark, f"file://{path}")):
        lined = table.withColumn("line_no", F.col("obj_ord"))
        got = tagged.objects(lined, kind).orderBy("obj_ord").select("obj_ord", "group_ord", "S", "Q", "W", "P").collect()
        assert [(r[0], r[1], r[2], r[3], tuple(r[4]), r[5]) for r in got] == want
        g = sorted(r.value for r in table.filter("line_type = 'g'").collect())
        assert g == [f"g 10 6 lane {i}" for i in range(5)]
        assert table.filter("line_type = 'P'").count() == 25
    some = binary.scan(spark, str(path), first=12, last=15, objects=2)
    assert sorted(r.obj_ord for r in some.filter("line_type = 'S'").collect()) == [12, 13, 14]


@pytest.mark.parametrize("compressed", [False, True])
def test_text_to_binary_and_back(spark, tmp_path, compressed):
    """Written as several parts, in the middle of groups, read as one file, and turned back into the same text."""
    kind = TYPES["seq"]
    rng = random.Random(8)
    head = tagged.Header(kind, "irp", [("made", "1.0", "now", "2020-01-01_00:00:00")])
    body = []
    for i in range(120):
        body += [f"g {min(35, 120 - i)} {len(f'lane é{i}'.encode())} lane é{i}"] if i % 35 == 0 else []
        seq, qual = "".join(rng.choice("acgt") for _ in range(i % 40)), "".join(rng.choice("!I~ ") for _ in range(i % 40))
        body += (["P"] if i % 2 == 0 else []) + [f"S {len(seq)} {seq}" if seq else "S 0", f"Q {len(qual)} {qual}" if qual else "Q 0", f"W {i} {-i} {i * 1000} 0.25"]
    at = put(tmp_path / "x.irp", "\n".join([*tagged.header_lines(head), *body]) + "\n")
    lines = tagged.lines(spark, at, tagged.header(spark, at).type)
    codes = {"Q": codec.Huffman.trained({ord(c): n for c, n in zip("!I~ ", (50, 40, 10, 9))})} if compressed else None
    binary.write_binary(binary.line_rows(lines, kind), head, f"file://{tmp_path}/bin", codes, objects=30)
    assert len([p for p in (tmp_path / "bin").glob("part-*") if p.stat().st_size]) > 2
    back = binary.scan_any(spark, f"file://{tmp_path}/bin", whole=True)
    tagged.write_text(binary.line_rows(back, kind), tagged.header_lines(head), f"file://{tmp_path}/text")
    again = [r.value for p in sorted((tmp_path / "text").glob("part-*.txt")) for r in spark.read.text(f"file://{p}").collect()]
    plain = lambda rows: [re.sub("^g [0-9]+ ", "g ", v) for v in rows if v[:1].isalpha()]
    assert plain(again) == plain(body)
    got = tagged.objects(back, kind).orderBy("obj_ord").select("obj_ord", "group_ord", F.length("S").alias("n")).collect()
    assert [tuple(r) for r in got] == [(i, i // 35, i % 40) for i in range(120)]


def test_binary_lists(spark, tmp_path):
    kind = S.parse_schema("P 3 all\nO O 2 3 INT 11 STRING_LIST\nD L 1 9 REAL_LIST\nD I 1 8 INT_LIST\nD C 1 4 CHAR\n")["all"]
    rows = [("O", [3, ["a b", "", "c"]]), ("L", [[1.5, -2.25]]), ("I", [[5, -7, 1 << 40]]), ("I", [[9]]), ("I", [[]]), ("C", ["z"])]
    path = tmp_path / "x.all"
    path.write_bytes(make_binary(kind, tagged.Header(kind), [], [rows], parts=1))
    got = [r.value for r in binary.scan_any(spark, f"file://{path}").collect()]
    assert got == ["O 3 3 3 a b 0  1 c", "L 2 1.5 -2.25", "I 3 5 -7 1099511627776", "I 1 9", "I 0", "C z"]


# --- sequence formats ----------------------------------------------------------------------


def test_fastq(spark, tmp_path):
    body = "".join(f"@r{i} d {i}\r\n{'acgtn'[: i % 5 + 1]}\r\n+\r\n{'@+!I~'[: i % 5 + 1]}\r\n" for i in range(700))
    at = put(tmp_path / "x.fastq", body)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
        rows = records.read_fastq(spark, at).orderBy("record").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [(r.record, r.id, r.description, r.seq, r.qual) for r in rows] == [(i, f"r{i}", f"d {i}", "acgtn"[: i % 5 + 1], "@+!I~"[: i % 5 + 1]) for i in range(700)]


@pytest.mark.parametrize("body", ["@a\nac\n+\nI\n", "a\nac\n+\nII\n", "@a\nac\nII\n", "@a\nac\n-\nII\n", "@a\nac\n+\nI \n", "@a\nac\n+\n"])
def test_bad_fastq(spark, tmp_path, body):
    with pytest.raises(Exception, match="record"):
        records.read_fastq(spark, put(tmp_path / "x.fq", body)).collect()


def test_fasta(spark, tmp_path):
    at = put(tmp_path / "x.fa", ">one first\nACGT\nAC\n>two\n\nGG\r\nTT\n>three\nA\n")
    rows = records.read_fasta(spark, at).orderBy("id").collect()
    assert [(r.id, r.description, r.seq) for r in rows] == [("one", "first", "ACGTAC"), ("three", None, "A"), ("two", None, "GGTT")]


SAM = [
    ("q1/5/0_9", 64, "chr1", 50, 60, "8M", "=", 80, 30, "acgtacgt", "IIIIIIII", [("RG", "Z:a"), ("zm", "i:5"), ("qs", "i:0"), ("qe", "i:9"), ("rq", "f:0.875"), ("np", "i:3"), ("bc", "B:S,1,2"), ("bq", "i:40"), ("sn", "B:f,1.5,2,3,4")]),
    ("q2", 0x900, "*", 0, 0, "*", "*", 0, 0, "nacr", "*", []),
    ("q3", 4, "chr2", 7, 9, "2S2M1D", "chr1", 1, -5, "ttac", "!!~~", [("XA", "A:c")]),
]


def test_sam_and_bam(spark, tmp_path):
    text = "@HD\tVN:1.6\n@SQ\tSN:chr1\tLN:100\n@PG\tID:a\n@PG\tID:b\tPP:a\n@CO\thello\tworld\n" + "".join("\t".join(map(str, r[:11])) + "".join(f"\t{k}:{v}" for k, v in r[11]) + "\n" for r in SAM)
    at = put(tmp_path / "x.sam", text)
    sam = records.read_sam(spark, at)
    (tmp_path / "x.bam").write_bytes(blocked.bam_bytes("@HD\tVN:1.6\n", [("chr1", 100), ("chr2", 50)], SAM))
    bam = blocked.read_bam(spark, f"file://{tmp_path}/x.bam").drop("file")
    key = lambda df: sorted((tuple(r)[:11], sorted(r["tags"].items())) for r in df.collect())
    assert key(sam) == key(bam) == sorted((r[:11], sorted(r[11])) for r in SAM)
    assert [r.value for r in records.read_sam(spark, at).filter("qname = 'q3'").select(records.sam_line().alias("value")).collect()] == ["q3\t4\tchr2\t7\t9\t2S2M1D\tchr1\t1\t-5\tttac\t!!~~\tXA:A:c"]
    long = records.long_reads(sam).orderBy("qname").collect()
    assert [r.qname for r in long] == ["q1/5/0_9", "q3"]  # secondary rows go
    r = long[0]
    assert (r.movie, r.ln, r.zm, r.qs, r.qe, r.rq, r.np, r.bc1, r.bc2, r.bq, r.sn) == ("q1", 8, 5, 0, 9, 0.875, 3, 1, 2, 40, [1.5, 2.0, 3.0, 4.0])
    assert long[1].zm is None and long[1].sn is None
    h = records.sam_header(spark, at)
    assert [r.id for r in records.program_chain(h, "b").orderBy("step").collect()] == ["b", "a"]
    assert h.filter("record = 'CO'").collect()[0].fields == {"text": "hello\tworld"}
    t = sam.filter("qname = 'q3'").select(records.set_tag(records.set_tag(F.col("tags"), "XA", None), "NM", F.lit("i:2")).alias("t")).collect()[0].t
    assert t == {"NM": "i:2"}


def test_damaged_blocks():
    raw = bytearray(blocked.compress_blocks(b"x" * 200_000))
    assert b"".join(d for _, d in blocked.blocks(raw)) == b"x" * 200_000
    raw[30] ^= 255
    with pytest.raises(Exception):
        list(blocked.blocks(raw))


VCF = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tA\tB\nc1\t10\trs1\tA\tC,G\t30.5\tPASS\tDB;DP=7\tGT:GQ\t0/1:9\t.:3\nc1\t20\t.\tAT\t.\t.\tq10;s50\t.\tGT\t1|1\t0/0\n"


def test_vcf(spark, tmp_path):
    at = put(tmp_path / "x.vcf", VCF)
    v = records.read_vcf(spark, at)
    a, b = v.orderBy("pos").collect()
    assert (a.alts, a.qual, a.filters, a.info) == (["C", "G"], 30.5, [], {"DP": "7", "DB": ""}) and (b.id, b.alts, b.filters, b.info) == (None, [], ["q10", "s50"], {})
    names = records.vcf_samples(spark, at)
    assert names == ["A", "B"]
    only = records.subset_samples(v, names, ["B"])
    got = only.orderBy("pos").select(records.sample_value(F.get("samples", F.lit(0)), F.col("format"), "GT").alias("gt")).collect()
    assert [r.gt for r in got] == [None, "0/0"]
    assert [r.v for r in v.orderBy("pos").select(records.vcf_line().alias("v")).collect()] == VCF.splitlines()[2:]


def test_interval_rows(spark):
    rows = [("bed", "c\t5\t9", (5, 8)), ("gff", "c\tx\ty\t5\t9", (4, 8)), ("sam", "q\t0\tc\t5\t9\t3M2D\t*\t0\t0\ta\tI", (4, 8)), ("sam", "q\t4\tc\t5\t9\t*\t*\t0\t0\ta\tI", (4, 4)), ("vcf", "c\t5\t.\tACG\tA\t.\t.\tX;END=20", (4, 19)), ("vcf", "c\t5\t.\tACG\tA\t.\t.\t.", (4, 6))]
    for preset, line, want in rows:
        r = spark.range(1).select(records.indexed_row(F.lit(line), preset).alias("r")).collect()[0].r
        assert (r.chrom, (r.beg, r.end)) == ("c", want), preset
    r = spark.range(1).select(records.region_row(F.lit("c\t5"), "tab").alias("r")).collect()[0].r
    assert (r.beg, r.end) == (4, 4)


def test_optical_maps(spark, tmp_path):
    at = put(tmp_path / "x.bnx", "# BNX\n# more\n0\t1\t100.5\n1\t10.2\t30.9\t100.5\nQX11\t1.5\t2.5\nQX12\t3\t4\n0\t2\t50\n1\t50\nQX11\nQX12\n")
    a, b = records.read_bnx(spark, at).orderBy("record").collect()
    assert (a.length, a.n_sites, a.sites, a.snr, a.intensity) == (100, 2, [10, 30], [1.5, 2.5], [3.0, 4.0])
    assert (b.length, b.n_sites, b.sites) == (50, 0, [])


def test_overlaps(spark, tmp_path):
    rows = [(1, 2, False, 0, 250, 5, 260, 12, [3, 100, 4, 100, 5, 55]), (1, 9, True, 50, 100, 0, 50, 0, [0, 50])]
    for spacing in (100, 500):
        (tmp_path / "x.las").write_bytes(blocked.las_bytes(spacing, rows))
        got = blocked.read_las(spark, f"file://{tmp_path}/x.las").orderBy("b").collect()
        assert [(r.a, r.b, r.reverse, r.as_, r.ae, r.bs, r.be, r.diffs, r.trace) for r in got] == rows and got[0].spacing == spacing
    (tmp_path / "y.las").write_bytes(blocked.las_bytes(100, [(1, 2, False, 0, 9, 0, 9, 0, [0, 8])]))
    with pytest.raises(Exception, match="add up"):
        blocked.read_las(spark, f"file://{tmp_path}/y.las").collect()


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_alignments_in_splits(spark, tmp_path, small_splits):
    """One file is read by many tasks; records that cross their borders, and one longer than a split, come out whole."""
    rng = random.Random(3)
    rows = []
    for i in range(4000):
        n = 60_000 if i == 1500 else rng.randint(0, 90)
        seq = "".join(rng.choice("acgtn") for _ in range(n)) or "*"
        rows.append((f"r{i}", rng.choice([0, 4, 16]), rng.choice(["chr1", "chr2", "*"]), rng.randint(0, 10**6), rng.randint(0, 60), f"{n}M" if n else "*", "*", 0, 0, seq, "".join(chr(33 + rng.randrange(40)) for _ in range(n)) if n else "*", [("NM", f"i:{i}")] if i % 3 else []))
    raw = blocked.bam_bytes("@HD\tVN:1.6\n" * 3000, [("chr1", 10**7), ("chr2", 10**7)], rows)
    (tmp_path / "x.bam").write_bytes(raw)
    df = blocked.read_bam(spark, f"file://{tmp_path}/x.bam")
    assert len(raw) > 100_000 and df.rdd.getNumPartitions() > 4
    assert sorted((tuple(r)[1:12], sorted(r["tags"].items())) for r in df.collect()) == sorted((r[:11], sorted(r[11])) for r in rows)
    (tmp_path / "cut.bam").write_bytes(raw[:90_000])
    with pytest.raises(Exception):
        blocked.read_bam(spark, f"file://{tmp_path}/cut.bam").collect()


def test_overlaps_in_splits(spark, tmp_path, small_splits):
    rng = random.Random(4)
    rows = []
    for i in range(3000):
        steps = [(rng.randrange(30), rng.randint(0, 120)) for _ in range(rng.choice([0, 1, 3, 40]))]
        a, b = rng.randrange(300), rng.choice([0, 5, 256, 65536])
        rows.append((rng.choice([1, 2, 257, i + 1]), i + 1, bool(i % 2), a, a + 100 * len(steps), b, b + sum(s[1] for s in steps), sum(s[0] for s in steps), [x for s in steps for x in s]))
    for spacing in (100, 500):
        (tmp_path / "x.las").write_bytes(blocked.las_bytes(spacing, rows))
        df = blocked.read_las(spark, f"file://{tmp_path}/x.las")
        assert df.rdd.getNumPartitions() > 4
        assert [(r.a, r.b, r.reverse, r.as_, r.ae, r.bs, r.be, r.diffs, r.trace) for r in df.orderBy("b").collect()] == rows
    (tmp_path / "none.las").write_bytes(blocked.las_bytes(100, []))
    assert blocked.read_las(spark, f"file://{tmp_path}/none.las").count() == 0


def test_read_database():
    seqs = ["acgtacg", "ttt", "ggggg"]
    bases, index, at = b"", b"\0" * 112, 0
    for i, s in enumerate(seqs):
        raw = codec.pack_dna(s.encode())
        index += blocked.DB_READ.pack(i, len(s), 10 * i, 0, at, 0, 700 | (blocked.BEST if i != 1 else 0) | (blocked.CSS if i == 1 else 0), 0)
        bases, at = bases + raw, at + len(raw)
    rows = list(blocked.db_reads(index, bases))
    assert [r[-1] for r in rows] == seqs and [r[4] for r in rows] == [700] * 3 and [r[5] for r in rows] == [False, True, False]
    assert [r[0] for r in blocked.db_trimmed(rows, 4)] == [0, 2] and [r[0] for r in blocked.db_trimmed(rows, 1, True)] == [0, 1, 2]


def test_sniffing(spark, tmp_path):
    import gzip

    cases = {
        "a": (b"@HD\tVN:1.6\n", ("sam", "none")), "b": (b"q\t0\tc\t5\t9\t3M\t*\t0\t0\tacg\tIII\n", ("sam", "none")), "c": (b"@r1 x\nac\n+\nII\n", ("fastq", "none")), "d": (b">r1\nac\n", ("fasta", "none")), "e": (b"# c\nchr1\t5\t9\n", ("bed", "none")), "f": (VCF.encode(), ("vcf", "none")),
        "g": (b"1 3 seq 1 0\n", ("one", "none")), "h": (b"hello\n", ("text", "none")), "i": (b"", ("empty", "none")), "j": (gzip.compress(b">r\nac\n"), ("fasta", "gzip")), "k": (blocked.bam_bytes("", [("c", 5)], []), ("bam", "blocks")), "l": (blocked.compress_blocks(VCF.encode()), ("vcf", "blocks")),
    }
    for name, (raw, want) in cases.items():
        (tmp_path / name).write_bytes(raw)
        assert records.sniff(spark, f"file://{tmp_path}/{name}") == want, name


def test_merged_headers():
    a = ["##fileformat=VCFv4.2", "##INFO=<ID=DP,Number=1,Type=Integer,Description=\"x, y\">", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tA"]
    b = ["##fileformat=VCFv4.3", "##INFO=<ID=DP,Number=1,Type=Integer,Description=\"other\">", "##FILTER=<ID=q10,Description=\"q\">", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tB"]
    assert records.merge_vcf_headers(a, b) == [a[0], a[1], b[2], "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tA\tB"]
    with pytest.raises(ValueError, match="samples"):
        records.merge_vcf_headers(a, a)
    with pytest.raises(ValueError, match="two ways"):
        records.merge_vcf_headers(a, [a[1].replace("Integer", "Float")])
