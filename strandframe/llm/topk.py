"""Exact top-k search by inner product.

Vectors are kept by descending length, in runs. A rotation by the singular vectors of all
candidates (from their d x d Gram matrix, summed by the tasks) puts most of a product into the
first coordinates. A query meets a run's vectors only while length times length can still enter
its best k; for those, a partial sum over the leading coordinates plus the product of the
remaining lengths, by Cauchy and Schwarz, bounds the score, and only candidates whose bound
reaches the query's k-th best are scored, exactly, in integers.

A first job over the longest vectors alone gives each query a floor to prune by from the start;
files whose longest vector is too short for every query of a block are not read.
Ties go to the smaller id. Null, empty and non-finite vectors take no part; vectors of several
lengths are an error. A repeated row is a candidate as often as it occurs, and a query's own id
is never its candidate. An empty table or query set gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandframe.llm.blocks import Best, clean_vectors, matrix, query_blocks, scan_block, width
from strandframe.llm.common import durable

RUN = 1024  # vectors that are pruned and scored together
FIRST = 4096  # the longest vectors, which give the floors
LEAD = 0.5  # share of the rotated coordinates in the partial sum


def quantised(rows: DataFrame, scale: int = 1024) -> DataFrame:
    """floor(scale * x) of each component."""
    return rows.withColumn("vec", F.transform("vec", lambda x: F.floor(x * scale).cast("long")))


def gram(rows: DataFrame, d: int, last: int = 16) -> np.ndarray:
    """Sum of the outer products of all vectors: one d x d matrix a task, added up by `last` tasks, then by the driver."""

    def run(batches):
        total = np.zeros((d, d))
        for batch in batches:
            m = matrix(batch.column(0)).astype(np.float64)
            total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sum"])

    def add(batches):
        total = np.zeros(d * d)
        for batch in batches:
            for raw in batch.column(0):
                total += np.frombuffer(raw.as_buffer(), np.float64)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sum"])

    sums = rows.select("vec").mapInArrow(run, "sum binary").repartition(last).mapInArrow(add, "sum binary").collect()
    return sum((np.frombuffer(r[0]) for r in sums), np.zeros(d * d)).reshape(d, d)


def rotation(g: np.ndarray) -> np.ndarray:
    """Right singular vectors of the candidates, the largest value first."""
    values, vectors = np.linalg.eigh(g / max(1.0, np.abs(g).max()))
    return vectors[:, ::-1]


class Searcher:
    """One task's search of one block of queries."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, turn: np.ndarray, floor: np.ndarray, k: int):
        self.ids, self.whole, self.k = ids, queries, k
        self.plain = queries.astype(np.float64)
        self.norm = np.sqrt((self.plain**2).sum(1))
        self.lead = max(1, int(LEAD * queries.shape[1]))
        self.turned = self.plain @ turn
        self.rest = np.sqrt((self.turned[:, self.lead :] ** 2).sum(1))
        self.turn, self.floor, self.best = turn, floor, Best(len(ids), k, np.int64)

    def see(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        plain = vectors.astype(np.float64)
        norm = np.sqrt((plain**2).sum(1))
        for at in range(0, len(ids), RUN):
            self._run(ids[at : at + RUN], vectors[at : at + RUN], plain[at : at + RUN], norm[at : at + RUN])

    def _run(self, ids, vectors, plain, norm) -> None:
        floor = np.maximum(self.floor, self.best.floor()).astype(np.float64)
        slack = 1e-9 * (1 + self.norm * norm.max())  # rounding of the rotated sums
        rows = np.flatnonzero(self.norm * norm.max() + slack >= floor)
        if not len(rows):
            return
        turned = plain @ self.turn
        rest = np.sqrt((turned[:, self.lead :] ** 2).sum(1))
        bound = self.turned[rows, : self.lead] @ turned[:, : self.lead].T + self.rest[rows, None] * rest + slack[rows, None]
        live = (bound >= floor[rows, None]) & (ids != self.ids[rows, None])
        rows, live = rows[keep := live.any(1)], live[keep]
        cols = np.flatnonzero(live.any(0))
        if not len(cols):
            return
        # lengths below 2^26 keep every partial sum of integers below 2^53, where doubles are exact
        if self.norm.max() < 1 << 26 and norm.max() < 1 << 26:
            score = (self.plain[rows] @ plain[cols].T).astype(np.int64)
        else:
            score = self.whole[rows] @ vectors[cols].T
        score[~live[:, cols]] = self.best.worst
        self.best.add(rows, score, ids[cols])


def exact_top_k(vectors: DataFrame, key: str, vector: str, is_query: Column, k: int = 10, scale: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest integer products of each query with all other rows.

    `is_query` is a condition on the column `id`.
    """
    spark = vectors.sparkSession
    rows = quantised(clean_vectors(vectors, key, vector), scale)
    rows = rows.withColumn("norm2", F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    # by length, then id: equal lengths cannot pile up in one partition
    stored = durable(rows.repartitionByRange(F.col("norm2").desc(), F.col("id")).sortWithinPartitions(F.col("norm2").desc(), F.col("id")))
    d = width(stored)
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not d:
        return out
    turn = rotation(gram(stored, d))
    first = stored.orderBy(F.col("norm2").desc(), "id").limit(FIRST).select("id", "vec").toArrow()
    first_ids, first_vectors = first["id"].to_numpy(), matrix(first["vec"].combine_chunks())
    for ids, queries, _ in query_blocks(stored.filter(is_query)):
        start = Searcher(ids, queries, turn, np.full(len(ids), np.iinfo(np.int64).min), k)
        start.see(first_ids, first_vectors)
        floor = start.best.floor()
        # shorter vectors than this cannot enter any query's best: files of such are not read
        least = float((np.maximum(floor.astype(np.float64), 0) / np.maximum(start.norm, 1e-300)).min()) * (1 - 1e-9)
        long_enough = stored.filter(F.col("norm2") >= least * least) if least > 0 else stored
        out = out.unionByName(scan_block(long_enough.select("id", "vec"), (ids, queries, turn, floor, k), _task, k, "long"))
    return out


def _task(args, batches):
    task = Searcher(*args)
    for batch in batches:
        task.see(batch.column(0).to_numpy(), matrix(batch.column(1)))
    yield task.best.batch(task.ids)
