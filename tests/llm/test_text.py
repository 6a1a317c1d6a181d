"""op2, op4, op5, op9, op10: encoding, secrets, pages, shards and packing."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib
from html.parser import HTMLParser

import numpy as np
import pytest
from helpers import DATA, same_rows
from llm_helpers import base_spans
from pyspark.sql import functions as F

from strandframe.llm import bpe, html, packing, secrets, shards
from strandframe.llm.common import durable, keep_rows
from strandframe.llm.queries import ORACLES, QUERIES

AT = f"{DATA}/sf0.001"
TEXTS = [
    None, "", " ", "\n\t ", "a", "Hello, World!  It's", "naïve café — résumé", "日本語テキスト", "👩‍👩‍👧 fam", "x" * 5000, "1234567890" * 30, "don't we'll they're I'd", "<|endoftext|> in <|startoftext|>text", "<|end", "İstanbul ǅ ß ﬁ",
    "á ë", "A\x00B\x1cC​﻿", "".join(map(chr, range(32, 256))), "ΑΣ ς", "!!!???...;;;", "same same same", "same same same", "퟿ \U0010ffff", "tab\tand nbsp　wide",
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


def test_encoding_equals_library(library):
    for own in (True, False):
        codec = bpe.PrefixBpe(bpe.default_path(), own)
        rng = random.Random(1)
        words = [library.id_to_token(rng.randrange(49_000)).replace("</w>", "") for _ in range(300)]
        extra = ["".join(rng.choice(words) for _ in range(rng.randint(1, 5))) for _ in range(400)] + [" ".join(rng.sample(words, 50))]
        for t in [*TEXTS, *extra]:
            want = library.encode(t or "", add_special_tokens=False).ids
            assert codec.encode(t) == want, t
            assert codec.decode(want) == library.decode(want, skip_special_tokens=False), t


def test_encode_query(spark, library):
    docs = spark.read.parquet(f"{AT}/documents.parquet").collect()
    got = {r.doc_id: r for r in QUERIES["op2_bpe_round_trip"](spark, AT).collect()}
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode(d.text or "", add_special_tokens=False).ids
        r = got[d.doc_id]
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_encode_edges(spark):
    df = spark.createDataFrame([(i, t, "clash", 0) for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string, decoded int")
    got = bpe.encode_decode(df, "doc_id", "text")
    assert got.count() == len(TEXTS) and [r.ids for r in got.filter("doc_id < 3").collect()] == [[], [], []]
    assert bpe.encode_decode(df.limit(0), "doc_id", "text").count() == 0


def packed_ok(pieces, texts, library, window=2048):
    """Each id in exactly one piece, sequences gapless and full but the last."""
    by_doc: dict[int, list] = {}
    by_seq: dict[int, list] = {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_seq.setdefault(p.sequence_id, []).append(p)
    assert set(by_doc) == set(texts)
    for k, own in by_doc.items():
        ids = np.array([*library.encode(texts[k] or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for p in sorted(own, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    fill = []
    for s in sorted(by_seq):
        at = 0
        for p in sorted(by_seq[s], key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        fill.append(at)
    assert all(n == window for n in fill[:-1]) and 0 < fill[-1] <= window and sorted(by_seq) == list(range(len(fill)))


def test_packing(spark, library):
    docs = spark.read.parquet(f"{AT}/documents.parquet")
    packed_ok(QUERIES["op10_concatenate_and_cut"](spark, AT).collect(), {r.doc_id: r.text for r in docs.collect()}, library)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, n string").repartition(5)
    packed_ok(packing.digest(packing.pack(df, "doc_id", "text", window=64)).collect(), dict(enumerate(TEXTS)), library, 64)
    assert packing.pack(df.limit(0), "doc_id", "text").count() == 0


# --- secrets -------------------------------------------------------------------------------

KEY40 = "abcdEFGH0123" + "x1Y2" * 7
SECRETS = [
    None, "", "no", "password: hunter22", "PASSWORD='short' passwd=longer_one", "token = abcdef é👩 api_key:ABCDEF.12", "secret:=x secret: abc", "AKIA" + "A" * 16, "AKIA" + "B" * 15, "f" * 23 + " " + "a" * 24 + "g", "é" * 300 + "AKIA" + "C" * 16 + " " + KEY40,
    KEY40, f"AKIA{'D' * 16}{' ' * 300}{KEY40}", f"AKIA{'D' * 16}{' ' * 301}{KEY40}", f"{KEY40} {'.' * 200} AKIA{'E' * 16}", "user: bob1 password: hunter22 at https://x.example/a", "https://x.example/a alone", "password=password=abcdefgh", "token:" + "a" * 40 + " login=me_x",
    ("AKIA" + "Z" * 16 + " " + KEY40 + " ") * 400, f"AKIA{'H' * 16} NAME={KEY40} {KEY40}= x{KEY40}", "password=abcdefg password: a secret=bcdefgh token=1 " * 40,
]


def test_secrets_equal_sql_and_brute_force(spark, tmp_path):
    same_rows(QUERIES["op4_linked_secrets"](spark, AT), ORACLES["op4_linked_secrets"], AT)
    at = str(tmp_path)
    spark.createDataFrame(list(enumerate(SECRETS)), "doc_id long, text string").write.parquet(f"{at}/documents.parquet")
    same_rows(QUERIES["op4_linked_secrets"](spark, at), ORACLES["op4_linked_secrets"], at)
    for df, texts in ((QUERIES["op4_linked_secrets"](spark, at), dict(enumerate(SECRETS))), (QUERIES["op4_linked_secrets"](spark, AT), {r.doc_id: r.text for r in spark.read.parquet(f"{AT}/documents.parquet").collect()})):
        for r in df.collect():
            want = base_spans(texts[r.doc_id])
            assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest(), texts[r.doc_id]
            assert [r.n_assign, r.n_access, r.n_hex] == [want.count(f"{k}:") for k in ("assign", "access", "hex")]
            assert set(filter(None, want.split(","))) <= set(r.spans.split(","))


def test_linked_parts(spark):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(SECRETS)], "doc_id long, text string, spans int")
    found = {r.key: [(s.name, s.start, s.end) for s in r.spans] for r in secrets.scan(df, "doc_id", "text").collect()}
    kinds = lambda i: [k for k, _, _ in found[i]]
    assert found[0] == found[1] == found[2] == found[11] == found[16] == []  # weak parts alone are not reported
    assert kinds(10) == ["access", "secret"] and kinds(12) == ["access", "secret"] and kinds(13) == ["access"] and kinds(14) == ["secret", "access"]
    assert kinds(15) == ["login", "assign", "endpoint"] and len(found[19]) == 800
    clean = {r.doc_id: r.t for r in secrets.scan(df, "doc_id", "text", carry=("doc_id", "text")).select("doc_id", secrets.redact(F.col("text"), F.col("spans")).alias("t")).collect()}
    assert clean[0] is None and clean[2] == "no" and clean[3] == "[SECRET]" and clean[15] == "[SECRET] [SECRET] at [SECRET]" and clean[19] == "[SECRET] [SECRET] " * 400
    assert secrets.scan(df.limit(0), "doc_id", "text").count() == 0


def test_very_many_spans(spark):
    """Cost grows with the number of spans: 30,000 of them in one text, in both directions of links, within some seconds."""
    one = "AKIA" + "Z" * 16 + " " + KEY40 + " é "
    df = spark.createDataFrame([(1, one * 15_000)], "doc_id long, text string")
    began = time.time()
    r = secrets.scan(df, "doc_id", "text", carry=("text",)).select("spans", secrets.redact(F.col("text"), F.col("spans")).alias("t")).first()
    assert time.time() - began < 60
    want = [(k, i * len(one) + s, i * len(one) + e) for i in range(15_000) for k, s, e in (("access", 0, 20), ("secret", 21, 61))]
    assert [(s.name, s.start, s.end) for s in r.spans] == want and r.t == "[SECRET] [SECRET] é " * 15_000


def test_key_after_its_name(spark):
    key = "wJalrXUtnFEMI/K7MDENG/bPxRfiCYzEXAMPLEK0"
    texts = [f"AWS_ACCESS_KEY_ID=AKIA{'F' * 16}\nAWS_SECRET_ACCESS_KEY={key}\n", f"AWS_SECRET_ACCESS_KEY={key}\n", f"AKIA{'G' * 16} KEY={key[:36]}"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = secrets.scan(df, "doc_id", "text", carry=("text",)).select("key", "spans", secrets.redact(F.col("text"), F.col("spans")).alias("t")).collect()
    found = {r.key: [(s.name, texts[r.key][s.start : s.end]) for s in r.spans] for r in rows}
    assert found == {0: [("access", "AKIA" + "F" * 16), ("secret", key)], 1: [], 2: [("access", "AKIA" + "G" * 16)]}
    assert {r.key: r.t for r in rows}[0] == "AWS_ACCESS_KEY_ID=[SECRET]\nAWS_SECRET_ACCESS_KEY=[SECRET]\n"


# --- pages ---------------------------------------------------------------------------------

LONG = "This is a long paragraph, with commas, that carries the story of the page and goes on for a while, so it counts."


@pytest.mark.parametrize(
    "page, want",
    [
        (None, ""),
        ("", ""),
        ("   ", ""),
        ("just text", "just text"),
        ("<p>a &amp; b &eacute; &#x41;\n\n  c</p>", "a & b é A c"),
        (f"<body><nav>Home About</nav><div><p>{LONG}</p><p>{LONG}</p></div><footer>Contact</footer></body>", f"{LONG}\n{LONG}"),
        (f"<article><h1>Title</h1><p>{LONG}</p><aside>Side</aside><script>var x='<p>no</p>'</script><style>p{{}}</style><form>Mail <input></form></article><div class='comments'><p>{LONG} me too</p></div>", f"Title\n{LONG}"),
        (f"<article><p>{LONG}<br>next line", f"{LONG}\nnext line"),
        (f"<div id=main><p>{LONG}<p>{LONG}</div><div class=sidebar><p>{LONG}</p></div>", f"{LONG}\n{LONG}"),
        ("<p data-x=it's>Hello world</p><p>second paragraph</p>", "Hello world\nsecond paragraph"),
        ('<p title="a > b" class=x"y>one</p><p a = \'<nav>\'>two</p></ ><?x?><!-->three<!-- a --!>', "one\ntwo\nthree"),
        ("<p>&lt<b>;</b> &am<i>p;</i></p>", "<; &amp;"),
        (f"<main><p>{LONG}</p><div class=a class=sidebar><p>{LONG}</p></div><div class='&#115;idebar'><p>{LONG}</p></div></main>", f"{LONG}\n{LONG}"),
        ("<div>" * 3000 + LONG + "</div>" * 10, LONG),
        (f"<!-- <p>hidden</p> --><main><p>{LONG}</p></main><div style='display: none'>{LONG}</div>", LONG),
    ],
)
def test_pages(page, want):
    assert html.main_text(page) == want


class Article(HTMLParser):
    """The article by what these pages say of it, read by the library's parser: text below <article>, cut at blocks."""

    INLINE = {"a", "b", "i", "em", "strong", "span", "sup", "sub", "code", "u", "small", "q", "abbr"}
    GONE = {"nav", "aside", "footer", "header", "form", "script", "style"}

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.inside, self.gone, self.found = 0, 0, [""]
        self.feed(page)
        self.close()
        self.lines = [t for t in (" ".join(x.split()) for x in self.found) if t]

    def cut(self, tag):
        if tag not in self.INLINE:
            self.found.append("")

    def handle_starttag(self, tag, attrs):
        self.cut(tag)
        self.inside += tag == "article"
        self.gone += tag in self.GONE

    def handle_endtag(self, tag):
        self.cut(tag)
        self.inside -= tag == "article"
        self.gone -= tag in self.GONE

    def handle_data(self, data):
        if self.inside > 0 and not self.gone:
            self.found[-1] += data


def test_page_query(spark):
    got = QUERIES["op5_scored_main_text"](spark, AT).collect()
    pages = {r.page_id: r for r in spark.read.parquet(f"{AT}/pages.parquet").collect()}
    assert len(got) == len(pages)
    for r in got:
        assert r.n_chars == len(r.text) and r.url == pages[r.page_id].url
        assert r.text == "\n".join(Article(pages[r.page_id].html).lines), pages[r.page_id].html
    df = spark.createDataFrame([(1, None, "u", 3), (2, "<p>a", "u", 3), (2, "<p>a", "u", 3)], "page_id long, html string, url string, text int")
    assert [r.text for r in html.extract(df, "page_id", "html", carry=("url",)).orderBy("page_id").collect()] == ["", "a", "a"]
    assert html.extract(df.limit(0), "page_id", "html", carry=("url",)).count() == 0


def test_pages_are_scored(spark):
    """What an article is called does not matter: the scoring finds it in plain containers, too."""
    for r in spark.read.parquet(f"{AT}/pages.parquet").collect():
        assert html.main_text(r.html.replace("<article", "<div").replace("</article", "</div")) == html.main_text(r.html)


# --- shards --------------------------------------------------------------------------------


def check_shards(rows, texts, n=16):
    slots: dict[int, list] = {}
    size: dict[int, int] = dict.fromkeys(range(n), 0)
    for r in rows:
        t = texts[r.doc_id]
        raw = (t or "").encode()
        assert r["size"] == len(raw) + 1 and r.text_crc32 == zlib.crc32(raw) and r.law == "bytes" and r.grown_shard is None
        slots.setdefault(r.shard, []).append(r.slot)
        size[r.shard] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(n))
    return size


def test_shards(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{AT}/documents.parquet").collect()}
    size = check_shards(QUERIES["op9_histogram_shards"](spark, AT).collect(), docs)
    mean, most = sum(size.values()) / 16, max(len((t or "").encode()) + 1 for t in docs.values())
    assert max(abs(v - mean) for v in size.values()) <= most + 2e-4 * mean


def test_shards_of_copies_and_few_rows(spark):
    rows = [(i, "same text" if i % 3 else f"t{i}", 0) for i in range(3000)] + [(5000, None, 0), (5001, "", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, size int")
    size = check_shards(shards.digest(shards.histogram_shards(df, "doc_id", "text")).collect(), {r[0]: r[1] for r in rows})
    assert max(size.values()) - min(size.values()) <= 20  # a group larger than a shard is cut
    few = spark.createDataFrame([(1, "a"), (2, None), (3, "a")], "doc_id long, text string")
    check_shards(shards.digest(shards.histogram_shards(few, "doc_id", "text")).collect(), {1: "a", 2: None, 3: "a"})
    assert shards.histogram_shards(few.limit(0), "doc_id", "text").count() == 0


def test_keep_rows_in_ranges(spark):
    df = durable(spark.range(3000).repartition(4).select(F.col("id").alias("v"), F.monotonically_increasing_id().alias("row")))
    want = sorted(r.v for r in df.filter("v % 3 = 0").collect())
    for words in (1 << 20, 7):
        assert sorted(r.v for r in keep_rows(df, "row", df.filter("v % 3 = 0").select("row"), words).collect()) == want
    assert keep_rows(df, "row", df.limit(0).select("row")).count() == 0
