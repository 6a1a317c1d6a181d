"""A query set against all rows, in blocks.

Queries are dealt into blocks of bounded size. For each block one job broadcasts it and scans
the candidates, which are stored once and never shuffled for a query; every task keeps the best
k of what it has seen for each query, and the tasks' shortlists meet in one exchange by query.
The queries' blocks take turns on the driver, so neither it nor a task holds more than one.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandframe.llm.common import durable

#: Queries that are broadcast at once; with 64 dimensions of 8 bytes, 8 MB.
QUERIES_A_BLOCK = 16_384


def clean_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """id and vec array<double> of the rows whose vector is neither null nor empty and holds finite numbers only."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.select(F.col(key).cast("long").alias("id"), v.alias("vec")).filter(F.col("id").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0)).filter(F.coalesce(finite, F.lit(False)))


def matrix(column) -> np.ndarray:
    """Rows of a list column of equal lengths."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def width(rows: DataFrame) -> int:
    """The one length of the vectors; other lengths cannot be compared and are an error."""
    low, high = rows.agg(F.min(F.size("vec")), F.max(F.size("vec"))).first()
    if low != high:
        raise ValueError(f"vectors of {low} and of {high} components")
    return low or 0


def query_blocks(queries: DataFrame, pieces: int | None = None, size: int = QUERIES_A_BLOCK):
    """Blocks of (ids, matrix, rows of each id), one at a time; a repeated id is asked once, with its smallest vector.

    The queries are dealt by a hash into as many `pieces`, or as many as `size` asks for.
    """
    asked = queries.groupBy("id").agg(F.min("vec").alias("vec"), F.count("*").alias("times"))
    if pieces is None:
        pieces = math.ceil(1.1 * asked.count() / size)
    for piece in range(pieces):
        mine = asked if pieces == 1 else asked.filter(F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(pieces)) == piece)
        got = mine.select("id", "vec", "times").orderBy("id").toArrow()
        if got.num_rows:
            yield got["id"].to_numpy(), matrix(got["vec"].combine_chunks()), got["times"].to_numpy()


class Best:
    """The k best (score, id) seen for each query; ties go to the smaller id."""

    def __init__(self, queries: int, k: int, kind):
        worst = np.iinfo(np.int64).min if kind is np.int64 else -np.inf
        self.worst, self.k = worst, k
        self.scores = np.full((queries, k), worst, kind)
        self.ids = np.full((queries, k), np.iinfo(np.int64).max, np.int64)

    def floor(self) -> np.ndarray:
        """The k-th best score of each query; less than it cannot enter."""
        return self.scores[:, -1]

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """scores: rows x candidates, with `worst` for what must not enter."""
        if not len(rows) or not scores.shape[1]:
            return
        s = np.concatenate([self.scores[rows], scores], 1)
        i = np.concatenate([self.ids[rows], np.broadcast_to(ids, scores.shape)], 1)
        if s.shape[1] > 4 * self.k:  # what lies below the k-th score goes before the sort
            cut = np.partition(s, s.shape[1] - self.k, axis=1)[:, s.shape[1] - self.k]
            most = int((s >= cut[:, None]).sum(1).max())
            if most < s.shape[1]:
                order = np.argsort(s < cut[:, None], axis=1, kind="stable")[:, :most]
                s, i = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
        order = np.lexsort((i, ~s if s.dtype == np.int64 else -s), axis=1)[:, : self.k]
        self.scores[rows], self.ids[rows] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)

    def batch(self, queries: np.ndarray) -> pa.RecordBatch:
        r, c = np.nonzero(self.scores != self.worst)
        return pa.RecordBatch.from_arrays([pa.array(queries[r]), pa.array(self.ids[r, c]), pa.array(self.scores[r, c])], ["query_id", "vec_id", "score"])


def ranked(shortlists: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score of the k best of all tasks' shortlists.

    A first cut within each task's rows is the shortlist itself, so a query's group holds k rows
    a task at most.
    """
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return shortlists.withColumn("rank", F.row_number().over(w).cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def scan_block(stored: DataFrame, args, task, k: int, kind: str) -> DataFrame:
    """One job: `task(args, batches)` over all stored rows with `args` broadcast, and the shortlists joined.

    Its result is written, so that blocks take turns and their broadcasts do not add up.
    """
    shared = stored.sparkSession.sparkContext.broadcast(args)

    def run(batches):
        return task(shared.value, batches)

    out = durable(ranked(stored.mapInArrow(run, f"query_id long, vec_id long, score {kind}"), k))
    shared.unpersist()
    return out
