"""Queries whose registered SQL covers a part of the rows or letters, against brute force over all of them."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import pytest

from strandframe.plans.queries import QUERIES

LONG = ["gattaca", "", None, "ACGTN x\n" * 625, "acgt\n!" * 1000, "Gatc, tag. " * 12_000]


@pytest.fixture
def texts(spark, tmp_path):
    spark.createDataFrame(list(enumerate(LONG)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_fastq_scan_takes_whole_texts(spark, texts):
    got = {r.doc_id: (r.id, r.n, r.seq_md5, r.n_qual) for r in QUERIES["fastq_scan"](spark, texts).collect()}
    seq = {i: re.sub("[^acgt]", "a", t.lower()) for i, t in enumerate(LONG) if t}
    assert got == {i: (f"r{i}", len(s), hashlib.md5(s.encode()).hexdigest(), len(s)) for i, s in seq.items()}


def test_mutated_letters_takes_long_texts(spark, texts):
    got = {r.doc_id: (r.n, r.n_replaced, r.n_inserted, r.n_deleted) for r in QUERIES["mutated_letters"](spark, texts).collect()}
    assert got == {i: (len(t), len(t), 2 * len(t), 0) for i, t in enumerate(LONG) if t}


def test_pileups_take_every_line(spark, tmp_path):
    rows = [(o, n, 10 * o + n, (3 * o + n) % 7, q, float(100 * n + o), "AN"[o % 2]) for o in range(1, 9) for n, q in ((1, 2), (2, 4), (3, 1), (7, 3))]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity int, l_extendedprice double, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    piled = defaultdict(list)
    for o, n, _, s, q, _, chrom in rows:
        for i in range(q + 5):
            piled[chrom, o % 1000 + i].append((o % 1000, o, n, s % 3, "D" if q <= i < q + 2 else "M"))
    depth = lambda reads: (len(reads), sum(r[4] == "D" for r in reads), 0)
    got = lambda name: {(r[0], r[1]): tuple(r[2:]) for r in QUERIES[name](spark, str(tmp_path)).collect()}
    assert got("pileup_depth") == {at: depth(reads) for at, reads in piled.items()}
    assert got("pileup_capped") == {at: depth(sorted(reads)[:5]) for at, reads in piled.items()}
    assert got("pileup_multi") == {at: tuple(sum(r[3] == f for r in reads) for f in range(3)) for at, reads in piled.items()}
