"""op6 and op8: exact top-k and learned partitions against brute force, and their edge cases."""

from __future__ import annotations

import numpy as np
import pytest
from helpers import DATA, same_rows
from pyspark.sql import functions as F

from strandframe.llm import ann, topk
from strandframe.llm.queries import ORACLES, QUERIES

AT = f"{DATA}/sf0.001"


def test_top_k_equals_sql(spark):
    same_rows(QUERIES["op6_norm_pruned_top_k"](spark, AT), ORACLES["op6_norm_pruned_top_k"], AT)


ODD = [(0, [1.0, 2.0]), (100, [3.0, -1.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [float("inf"), 0.0]), (7, []), (8, [-1.0, -2.0]), (8, [-1.0, -2.0]), (None, [9.0, 9.0]), (9, [0.0, 0.0])]


def test_top_k_edges(spark):
    df = spark.createDataFrame(ODD, "vec_id long, embedding array<double>").withColumn("id", F.lit("clash")).withColumn("vec", F.lit(1))
    got = topk.exact_top_k(df, "vec_id", "embedding", F.col("id") % 100 == 0, k=10).orderBy("query_id", "rank").collect()
    one = [(r.vec_id, r.score) for r in got if r.query_id == 0]
    s = 1024 * 1024
    assert one == [(1, 5 * s), (2, 5 * s), (100, 1 * s), (9, 0), (8, -5 * s), (8, -5 * s)]  # ties to the smaller id, repeated rows each
    assert [r.rank for r in got if r.query_id == 0] == [1, 2, 3, 4, 5, 6]
    assert topk.exact_top_k(df.limit(0), "vec_id", "embedding", F.col("id") % 100 == 0).count() == 0
    with pytest.raises(ValueError):
        topk.exact_top_k(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>"), "vec_id", "embedding", F.col("id") == 1)


def test_pruned_search_is_exact():
    rng = np.random.default_rng(1)
    vectors = np.floor(rng.normal(0, 300, (3000, 16)) * rng.gamma(1, 1, (3000, 1))).astype(np.int64)
    vectors = vectors[np.argsort(-(vectors.astype(float) ** 2).sum(1), kind="stable")]
    ids, q = np.arange(3000), vectors[::97]
    search = topk.Searcher(ids[::97], q, topk.rotation(vectors.T.astype(float) @ vectors), np.full(len(q), np.iinfo(np.int64).min), 10)
    search.see(ids, vectors)
    for i, (own, v) in enumerate(zip(ids[::97], q)):
        scores = vectors @ v
        want = sorted((-s, j) for j, s in enumerate(scores.tolist()) if j != own)[:10]
        assert list(zip((-search.best.scores[i]).tolist(), search.best.ids[i].tolist())) == want


def brute(ids, m, asked, k):
    unit = m / np.sqrt((m * m).sum(1, keepdims=True))
    out = {}
    for i in asked:
        s = unit @ unit[i]
        s[i] = -np.inf
        out[int(ids[i])] = set(ids[np.argsort(-s, kind="stable")[:k]].tolist())
    return out


def test_learned_partitions(spark):
    df = spark.read.parquet(f"{AT}/embeddings.parquet")
    got: dict[int, list] = {}
    for r in QUERIES["op8_learned_partitions"](spark, AT).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r)
    rows = sorted((r.vec_id, r.embedding) for r in df.collect() if r.embedding is not None and all(x is not None and np.isfinite(x) for x in r.embedding) and any(r.embedding))
    ids, m = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    want = brute(ids, m, np.flatnonzero(ids % 50 == 0), 5)
    assert set(got) == set(want)
    recall = np.mean([len({r.vec_id for r in got[q]} & want[q]) / 5 for q in want])
    assert recall >= 0.9, recall
    place = {int(i): v for i, v in zip(ids, m)}
    for q, found in got.items():
        assert [r.rank for r in found] == list(range(1, len(found) + 1))
        for r in found:
            a, b = place[q], place[r.vec_id]
            assert r.score == pytest.approx(float(a @ b / np.sqrt((a @ a) * (b @ b))), abs=1e-12)


def test_nearest_edges(spark):
    df = spark.createDataFrame(ODD, "vec_id long, embedding array<double>").withColumn("part", F.lit("clash"))
    got = ann.nearest(df, "vec_id", "embedding", F.col("id") % 50 == 0).orderBy("query_id", "rank").collect()
    assert [r.vec_id for r in got if r.query_id == 0] == [1, 2, 100, 8, 8]  # zero, null and non-finite ones take no part
    assert ann.nearest(df.limit(0), "vec_id", "embedding", F.col("id") % 50 == 0).count() == 0
    same = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(300)], "vec_id long, embedding array<double>")
    near = ann.nearest(same, "vec_id", "embedding", F.col("id") == 50).orderBy("rank").collect()
    assert [r.vec_id for r in near] == [0, 1, 2, 3, 4]


def test_recall_beyond_the_sample(spark, monkeypatch):
    """Most rows lie outside the sample: recall holds for all queries, and clustered vectors are found in few parts."""
    monkeypatch.setattr(ann, "SAMPLE", 2048)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(150, 24))
    shapes = {"random": (rng.normal(size=(12_000, 24)), 1.0), "clustered": (centres[rng.integers(0, 150, 12_000)] + 0.4 * rng.normal(size=(12_000, 24)), 0.25)}
    for name, (x, most) in shapes.items():
        df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").repartition(6)
        scored = []
        routes = ann.Router.routes

        def seen(self, q, held, enough):
            out = routes(self, q, held, enough)
            scored.append((out @ held).mean() / held.sum())
            return out

        monkeypatch.setattr(ann.Router, "routes", seen)
        got: dict[int, set] = {}
        for r in ann.nearest(df, "vec_id", "embedding", F.col("id") % 50 == 0).collect():
            got.setdefault(r.query_id, set()).add(r.vec_id)
        monkeypatch.setattr(ann.Router, "routes", routes)
        want = brute(np.arange(12_000), x, np.arange(0, 12_000, 50), 5)
        assert all(len(v) == 5 for v in got.values()) and set(got) == set(want)
        assert np.mean([len(got[q] & want[q]) / 5 for q in want]) >= 0.9, name
        assert np.mean(scored) <= most, (name, scored)


def test_queries_go_on_to_further_parts(spark):
    """A part of few rows next to one of many: every query gets as many as there are."""
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(0, 0.01, (300, 4)) + [1, 0, 0, 0], rng.normal(0, 0.01, (2, 4)) + [0, 0, 0, -1]])
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = ann.nearest(df, "vec_id", "embedding", F.col("id") == 301, parts=8).orderBy("rank").collect()
    assert [r.rank for r in got] == [1, 2, 3, 4, 5] and got[0].vec_id == 300
    assert len(ann.nearest(df.limit(4), "vec_id", "embedding", F.col("id") == 1).collect()) == 3


def test_blocks_of_neighbouring_parts():
    assert ann.part_blocks({0: 5, 1: 4, 3: 9, 7: 25, 8: 1}, 10) == [([0, 1], 1), ([3], 1), ([7], 3), ([8], 1)] and ann.part_blocks({}) == []


def test_parts_are_balanced():
    rng = np.random.default_rng(2)
    x = ann.unit(np.concatenate([rng.normal(c, 0.3, (400, 8)) for c in rng.normal(0, 1, (5, 8))]))
    part = ann.balanced_parts(x, ann.neighbour_graph(x), 16)
    n = np.bincount(part, minlength=16)
    assert n.min() >= 0.9 * len(x) / 16 - 1 and n.max() <= 1.1 * len(x) / 16 + 1
