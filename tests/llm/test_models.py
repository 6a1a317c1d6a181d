"""op1, op3, op7 and the pipeline: learned models by held-out accuracy, near duplicates against brute force."""

from __future__ import annotations

import os
import random
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
from helpers import DATA
from llm_helpers import base_spans
from pyspark.sql import functions as F

import corpus_pipeline
from strandframe.llm import langid, neardup, quality
from strandframe.llm.common import held_out, table
from strandframe.llm.queries import QUERIES

AT = f"{DATA}/sf0.01"
ODD = [(1, None), (2, ""), (3, "  \n"), (4, "123 !!! 456"), (5, "x"), (6, "word " * 50_000), (7, "é ü 日本"), (7, "é ü 日本"), (9, "² ½ ① Ⅷ _7")]


def odd(spark):
    return spark.createDataFrame([(i, t, "c", 1.0) for i, t in ODD], "doc_id long, text string, lang_pred string, score double")


def test_fold(spark):
    got = spark.range(500).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in got)


def test_language(spark):
    docs = table(spark, AT, "documents")
    got = QUERIES["op1_subword_language"](spark, AT).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(got) == docs.count()
    known = [r for r in got if r.held_out and r.lang is not None and r.text and len(r.text) > 30]
    assert sum(r.lang == r.lang_pred for r in known) / len(known) >= 0.97
    assert all(0 <= r.score <= 1 for r in got) and all((r.lang_pred == "und") == (not any(map(str.isalpha, r.text or ''))) for r in got)
    assert sum(r.rejected for r in known) / len(known) < 0.02


def test_language_edges(spark):
    model = langid.train(["der die das und " * 5, "the and of to " * 5] * 12, ["de", "en"] * 12)
    got = langid.predict(odd(spark), "doc_id", "text", model).orderBy("doc_id").collect()
    assert [r.lang_pred for r in got][:4] == ["und"] * 4 and [r.score for r in got][:4] == [0.0] * 4 and len(got) == len(ODD)
    assert got[6].lang_pred == got[7].lang_pred and got[6].score == got[7].score
    assert model.predict("and the of the and to")[0] == "en" and model.predict("die der und das")[0] == "de"
    assert got[8].lang_pred == "und" and langid.predict(odd(spark).limit(0), "doc_id", "text", model).count() == 0
    assert langid.train([], []).predict("some text") == ("und", 0.0, True)
    long = "the and of to " * 20_000
    assert np.allclose(langid.histogram(long[: 1 << 17]).sum(), 1) and model.predict(long)[0] == "en"


def test_slices_lose_no_subword():
    text = "".join(random.Random(1).choice("abc de") for _ in range(5000))
    whole, before = langid.histogram(text), langid.SLICE
    try:
        langid.SLICE = 333
        assert np.allclose(langid.histogram(text), whole, atol=1e-6)
    finally:
        langid.SLICE = before


def test_quality(spark):
    labels = table(spark, AT, "labels").select("doc_id", "quality").filter("quality is not null").dropDuplicates(["doc_id"])
    got = QUERIES["op3_byte_cnn_quality"](spark, AT).join(labels, "doc_id", "left").collect()
    known = [r for r in got if r.held_out and r.quality is not None]
    assert sum((r.score >= 0.7) == (r.quality == 1) for r in known) / len(known) >= 0.9
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)


def test_quality_edges(spark):
    rng = random.Random(3)
    good = ["The quick brown fox went over the hill, and then it slept. " * rng.randint(1, 9) for _ in range(30)]
    bad = ["$$$ BUY!!! NOW!!! 999 " * rng.randint(1, 20) for _ in range(30)]
    model = quality.train(good + bad, [1] * 30 + [0] * 30, filters=8, epochs=6)
    assert model.score(good[0]) > 0.7 > model.score(bad[0])
    got = quality.predict(odd(spark), "doc_id", "text", model).orderBy("doc_id").collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got) and got[0].score == got[1].score and got[6].score == got[7].score
    assert quality.predict(odd(spark).limit(0), "doc_id", "text", model).count() == 0
    assert quality.train([], []).score("x") == 0.5 and quality.train(["a", "b"], [1, 1]).score("x") == 1.0
    assert quality.fit(odd(spark), spark.createDataFrame([], "doc_id long, quality int"), "doc_id", "text", "quality", F.lit(True)).score("x") == 0.5


@pytest.mark.parametrize("words", [["ab", "cdE", "f.", "77"], ["lo" * 3000, "n", "g" * 9000, "ab"], ["x" * 200_000]])
def test_quality_pools_the_whole_text(words):
    """Slices give what one pass gives, also of words longer than any look back; the last bytes count."""
    model = quality.Model(np.random.default_rng(1).normal(0, 0.3, (quality.WIDTH * quality.DEPTH, 6)).astype(np.float32), np.zeros(6, np.float32), np.ones(19, np.float32), 0.0)
    text = " ".join(w for w in random.Random(2).choices(words, k=20_000 // len("".join(words)) * 3 + 9))
    raw, _ = quality._padded(text)
    a = np.maximum(quality._windows(quality._inputs(raw)) @ model.filters, 0)
    c = np.stack([a[s:e].max(0) for s, e in quality._chunks(len(a))])
    assert np.allclose(model.pooled(raw), np.concatenate([c.max(0), c.min(0), c.mean(0)]), atol=1e-4)
    assert model.pooled(raw)[0] <= model.pooled(np.r_[raw, np.full(40, 36, np.uint8)]).max()


def test_fits_are_bounded(spark, monkeypatch):
    """Hot ids and very long texts: rows and bytes that reach the driver stay within the stated bounds, and both labels are learned."""
    monkeypatch.setattr(quality, "FIT_BYTES", 4096)
    assert quality.spread("a" * 10_000 + "b" * 10_000, 4096, 512) == b"a" * 2048 + b"b" * 2048 and quality.spread(None) == b""
    rows = [(1, "good text of words. " * 3, "en") for _ in range(3000)] + [(i, "good text of words. " * (2000 if i == 5 else 3), "en") for i in range(2, 40)] + [(i, "schlecht und sehr ### " * 3, "de") for i in range(40, 60)] + [(99, None, "de"), (98, "12 ½", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(7).withColumn("label_", F.lit("clash")).withColumn("hash_", F.lit("clash"))
    labels = spark.createDataFrame([(i, int(i < 40)) for i in range(1, 60)] * 2 + [(None, 1), (3, None), (7, 5)], "doc_id long, quality int")
    seen = {}
    monkeypatch.setattr(quality, "train", lambda texts, marks: seen.update(q=(texts, marks)))
    quality.fit(docs, labels, "doc_id", "text", "quality", F.lit(True))
    texts, marks = seen["q"]
    assert sorted(marks) == [0] * 20 + [1] * 39 and sum(map(len, texts)) < 300_000
    shares, langs = langid.sample(docs, "doc_id", "text", "lang", F.lit(True), each=10)
    assert langs.count("de") <= 10 and 1 <= langs.count("en") <= 10 and all(np.isclose(h.sum(), 1) for h in shares)
    model = langid.fit(docs, "doc_id", "text", "lang", F.lit(True))
    assert model.predict("good text")[0] == "en" and model.predict("und sehr schlecht")[0] == "de"


def test_many_languages(spark, tmp_path):
    """Histograms of many languages exceed what the driver may get at once; very many labels are chosen from without a nested condition."""
    script = """
import random
from pyspark.sql import SparkSession, functions as F
from strandframe.llm import langid
spark = SparkSession.builder.master("local[2]").config("spark.driver.maxResultSize", "3m").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
langid.FETCH = 40
rng = random.Random(3)
rows = [(i, " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(500)), f"l{i % 40}") for i in range(240)]
docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
shares, langs = langid.sample(docs, "doc_id", "text", "lang", F.lit(True))
assert sorted(langs) == sorted(r[2] for r in rows), len(langs)
want = {tuple(langid.histogram(t).nonzero()[0]): l for _, t, l in rows}
assert all(want[tuple(h.nonzero()[0])] == l for h, l in zip(shares, langs))
print("whole")
"""
    got = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(Path(langid.__file__).parents[2])}, capture_output=True, text=True, timeout=300)
    assert got.stdout.split()[-1:] == ["whole"], got.stderr[-2000:]
    many = spark.range(6000).select("id", F.concat(F.lit("l"), F.col("id") % 3000).alias("label_"), F.lit("text").alias("text_"))
    assert langid.chosen(many, "label_", 5, "id").agg(F.count("*"), F.count_distinct("label_")).first()[:] == (6000, 3000)


# --- near duplicates -----------------------------------------------------------------------


def weighted(a: str, b: str) -> float:
    from collections import Counter

    def bag(t):
        w = t.split()
        return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()

    x, y = bag(a), bag(b)
    both = sum((x & y).values())
    return both / max(1, sum((x | y).values()))


def brute(texts: dict) -> dict:
    """The smallest id of each class by comparing all texts."""
    ids = sorted(k for k in texts if texts[k] is not None)
    root = {k: k for k in texts}

    def find(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for n, i in enumerate(ids):
        for j in ids[:n]:
            if texts[i] == texts[j] or (texts[i].split() and texts[j].split() and weighted(texts[i], texts[j]) >= 0.8):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {k: find(k) for k in texts}


def test_signatures_are_unbiased():
    rng = np.random.default_rng(1)
    share = []
    for trial in range(60):
        h = rng.integers(0, 1 << 62, 300).astype(np.uint64)
        n, m = rng.integers(1, 20, 300), rng.integers(0, 20, 300)
        x, y = (np.sort(h), n[np.argsort(h)]), (np.sort(h)[m[np.argsort(h)] > 0], m[np.argsort(h)][m[np.argsort(h)] > 0])
        s = neardup.signatures([x, y])
        share.append((s[0] == s[1]).mean() - np.minimum(n, m).sum() / np.maximum(n, m).sum())
    assert abs(np.mean(share)) < 0.02
    assert (neardup.signatures([(np.zeros(0, np.uint64), np.zeros(0, np.int64))]) == 0).all()


def test_briefs_tell_texts_apart(spark):
    """Half bytes of unlike texts agree by chance alone; those of near copies stay above the likeness test."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(3000)]
    base = [[rng.choice(words) for _ in range(300)] for _ in range(40)]
    near = [t[:-30] + [rng.choice(words) for _ in range(27)] for t in base]  # some 0.8
    rows = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(base + near)], "doc_id long, text string")
    got = {r.key: r.brief for r in neardup.sign(rows, "doc_id", "text").collect()}
    import pyarrow as pa

    regs, _ = neardup._signs(pa.array([bytes(got[i]) for i in range(80)]))
    far = np.mean([(regs[i] == regs[j]).mean() for i in range(40) for j in range(i)])
    like = [(regs[i] == regs[i + 40]).mean() for i in range(40)]
    assert far < 0.1 and min(like) >= neardup.LIKELY and 0.75 < np.mean(like) < 0.9


def test_near_copies_at_the_border(spark, monkeypatch):
    """Large buckets of texts of similarity about 0.8 to each other, with small windows and blocks: classes equal brute force."""
    for name, value in (("WINDOW", 8), ("BLOCK", 8), ("BAGS", 4)):
        monkeypatch.setattr(neardup, name, value)
    rng = random.Random(11)
    words = [f"w{i}" for i in range(500)]
    texts = {}
    for _ in range(4):
        base = [rng.choice(words) for _ in range(120)]
        for _ in range(45):
            t = list(base)
            for _ in range(rng.choice([1, 2, 2, 3])):
                t[rng.randrange(120)] = rng.choice(words)
            texts[len(texts)] = " ".join(t)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    assert {r.key: r.class_id for r in neardup.classes(docs, "doc_id", "text").collect()} == brute(texts)


def test_bags_measure_multisets():
    rng = random.Random(4)
    for _ in range(50):
        a = [rng.choice("abcd") for _ in range(rng.randint(0, 60))]
        b = a[: rng.randint(0, 60)] + [rng.choice("abcd") for _ in range(rng.randint(0, 9))]
        x, y = " ".join(a), " ".join(b)
        assert neardup.similarity(neardup.bag_bytes(x), neardup.bag_bytes(y)) == pytest.approx(weighted(x, y))


def test_classes_equal_brute_force(spark):
    docs = table(spark, f"{DATA}/sf0.001", "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r.class_id for r in QUERIES["op7_bagminhash_near_duplicates"](spark, f"{DATA}/sf0.001").collect()}
    assert got == brute(texts)


def test_large_groups_and_chains(spark):
    """Copies beyond a window, near copies around one text, and texts that link two groups."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(4000)]
    rows, want = [], {}

    def add(text, cls):
        rows.append((len(rows), text))
        want[len(rows) - 1] = cls

    base = [rng.choice(words) for _ in range(200)]
    for i in range(1500):  # near copies of one text: every pair is alike
        t = list(base)
        for _ in range(2):
            t[rng.randrange(200)] = f"x{i}"
        add(" ".join(t), 0)
    for i in range(800):
        add("one exact copy of a text of many words that is shared by rows", 1500)
    chain = [rng.choice(words) for _ in range(300)]
    first = len(rows)
    for i in range(12):  # each like the next, the ends unlike
        chain = chain[10:] + [rng.choice(words) for _ in range(10)]
        add(" ".join(chain), first)
    for i in range(300):
        add(" ".join(rng.choice(words) for _ in range(60)), len(rows))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(13)
    got = {r.key: r.class_id for r in neardup.classes(docs, "doc_id", "text").collect()}
    assert got == want


def test_near_duplicate_edges(spark):
    got = [(r.key, r.class_id) for r in neardup.classes(odd(spark).withColumn("bands", F.lit(1)), "doc_id", "text").orderBy("key").collect()]
    assert got == [(1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (6, 6), (7, 7), (7, 7), (9, 9)]
    nulls = spark.createDataFrame([(1, None), (2, None), (4, ""), (3, "")], "doc_id long, text string")
    assert sorted((r.key, r.class_id) for r in neardup.classes(nulls, "doc_id", "text").collect()) == [(1, 1), (2, 2), (3, 3), (4, 3)]
    assert neardup.classes(nulls.limit(0), "doc_id", "text").count() == 0


# --- pipeline ------------------------------------------------------------------------------


def test_pipeline(spark):
    """Each stage against what its operator says of the stage's own input."""
    docs = table(spark, AT, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "language ID", "MinHash near-dedup", "secret scans", "packing"]
    out = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, AT).toArrow())
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.append({r.doc_id: r for r in docs.collect()})
    source = {r.doc_id: r for r in table(spark, AT, "documents").collect()}
    scored = {r.doc_id: r.predicted for r in QUERIES["op3_byte_cnn_quality"](spark, AT).collect()}
    assert set(out[0]) == {k for k, p in scored.items() if p == 1}
    refused = {r.doc_id for r in QUERIES["op1_subword_language"](spark, AT).filter("rejected").collect()}
    assert set(out[1]) == set(out[0]) - refused
    some = spark.createDataFrame([(k, r.text) for k, r in out[1].items()], "doc_id long, text string")
    cls = {r.key: r.class_id for r in neardup.classes(some, "doc_id", "text").collect()}
    assert set(out[2]) == set(cls.values())
    assert set(out[3]) == set(out[2])
    for k, r in out[3].items():
        assert base_spans(r.text) == "" or "[SECRET]" in r.text
        if not base_spans(out[2][k].text):
            assert r.text == out[2][k].text == source[k].text and r.n_chars == source[k].n_chars
        else:
            assert r.n_chars == len(r.text) and r.text != source[k].text
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, AT)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == set(out[3])
    assert pieces.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 2048").count() == 0
