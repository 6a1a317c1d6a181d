"""Approximate nearest neighbours by cosine with learned partitions.

On a bounded sample, an exact neighbour graph is cut into parts of nearly equal size so that few
edges cross (recursive median splits, then moves that gain edges within a capacity). A small
network learns from a vector which parts its neighbours lie in. It places every row in its
likeliest part, and routes a query to its likeliest parts, in order, until their probabilities
add up to a share under which, in the sample, `recall` of the neighbours were found; all rows
there are scored exactly, in double precision, and the best are kept. Where the routed parts hold
fewer rows than asked for, the query goes on to its next parts.

The sample: at most SAMPLE rows, those with the smallest hash of the id, equal vectors once. All
rows are indexed. Parts number one for each PART_ROWS rows, a power of two, and at most one for
each 32 rows of the sample, which alone can be told apart by it: a table of fewer than 64
distinct vectors is one part. Parts are stored in order of part and id, so that a part that holds
many rows, even equal ones, spans tasks; queries are asked in blocks of neighbouring parts, and a
block reads only the files (row groups) whose parts it is routed to.

Null, empty, zero and non-finite vectors take no part; several lengths are an error. A query's
own id is never its candidate; a repeated row is one as often as it occurs. Ties go to the
smaller id. An empty table or query set gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandframe.llm.blocks import QUERIES_A_BLOCK, Best, clean_vectors, matrix, query_blocks, scan_block, width
from strandframe.llm.common import durable

SAMPLE = 8192  # rows that the partitions are learned from
PART_ROWS = 128  # rows of the table to a part, until the sample's bound on parts is reached
NEIGHBOURS = 30
RECALL = 0.93  # of the sample's neighbours; those of the whole table are nearer, and found more often
SLACK = 0.05  # how much larger than the mean a part of the sample may be


def neighbour_graph(x: np.ndarray, k: int = NEIGHBOURS) -> np.ndarray:
    """Row numbers of the k nearest other rows of each unit vector."""
    k = min(k, len(x) - 1)
    out = np.empty((len(x), max(k, 0)), np.int64)
    for at in range(0, len(x), 1024):
        s = x[at : at + 1024] @ x.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -np.inf
        if k > 0:
            out[at : at + len(s)] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 6, seed: int = 3) -> np.ndarray:
    """A part of 0 to parts - 1 (a power of two) for each row, sizes within SLACK of equal."""
    part = np.zeros(len(x), np.int64)
    n = 1
    while n < parts:  # halve each part at the median of its widest direction
        new = part * 2
        for p in range(n):
            own = np.flatnonzero(part == p)
            if len(own) > 1:
                c = x[own] - x[own].mean(0)
                along = c @ np.linalg.eigh(c.T @ c)[1][:, -1]
                new[own[np.argsort(along, kind="stable")[len(own) // 2 :]]] += 1
        part, n = new, n * 2
    both: list[list[int]] = [list(r) for r in graph]
    for i, row in enumerate(graph):
        for j in row:
            both[j].append(i)
    links = [np.array(b, np.int64) for b in both]
    size = np.bincount(part, minlength=parts)
    most, least = int(np.ceil(len(x) / parts * (1 + SLACK))), int(len(x) / parts * (1 - SLACK))
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0
        for i in rng.permutation(len(x)):
            near = np.bincount(part[links[i]], minlength=parts)
            own = part[i]
            gain = near - near[own]
            gain[size >= most] = -1
            to = int(gain.argmax())
            if gain[to] > 0 and size[own] > least:
                size[own] -= 1
                size[to] += 1
                part[i] = to
                moved += 1
        if moved < len(x) // 200:
            break
    return part


@dataclass
class Router:
    """A network of one hidden layer from unit vectors to parts, and the share of probability to ask for."""

    w: list[np.ndarray]
    share: float = 1.0

    @property
    def parts(self) -> int:
        return self.w[3].shape[0]

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.w[0] + self.w[1], 0) @ self.w[2] + self.w[3]

    def place(self, x: np.ndarray) -> np.ndarray:
        return self.logits(x).argmax(1) if self.parts > 1 else np.zeros(len(x), np.int64)

    def ordered(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Parts from the likeliest on, and the probability of those before each."""
        z = self.logits(x)
        order = np.argsort(-z, axis=1, kind="stable")
        z = np.take_along_axis(z, order, 1)
        p = np.exp(z - z[:, :1])
        p /= p.sum(1, keepdims=True)
        return order, np.cumsum(p, 1) - p

    def routes(self, x: np.ndarray, held: np.ndarray | None = None, enough: np.ndarray | int = 0) -> np.ndarray:
        """queries x parts: whether the part is asked. `held` rows a part must add up to `enough` for each query."""
        order, before = self.ordered(x)
        ask = before < self.share
        ask[:, 0] = True
        if held is not None:
            ask |= np.cumsum(held[order], 1) - held[order] < np.reshape(enough, (-1, 1))
        out = np.zeros(ask.shape, bool)
        np.put_along_axis(out, order, ask, 1)
        return out


def train_router(x: np.ndarray, target: np.ndarray, hidden: int = 128, epochs: int = 15, batch: int = 256, rate: float = 2e-3, seed: int = 4) -> Router:
    """`target`: rows x parts, the shares of a row's neighbours."""
    rng = np.random.default_rng(seed)
    d, parts = x.shape[1], target.shape[1]
    w = [rng.normal(0, np.sqrt(2 / d) * 2, (d, hidden)), np.zeros(hidden), rng.normal(0, np.sqrt(1 / hidden), (hidden, parts)), np.zeros(parts)]
    m, v, t = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
    epochs = max(epochs, min(200, 40_000 // len(x)))  # small samples need more rounds for as many steps
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs) + 1e-5
        for i in np.array_split(rng.permutation(len(x)), max(1, len(x) // batch)):
            h = np.maximum(x[i] @ w[0] + w[1], 0)
            z = h @ w[2] + w[3]
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p -= target[i]
            p /= len(i)
            back = (p @ w[2].T) * (h > 0)
            t += 1
            for a, mm, vv, g in zip(w, m, v, (x[i].T @ back, back.sum(0), h.T @ p, p.sum(0))):
                mm += 0.1 * (g - mm)
                vv += 0.001 * (g * g - vv)
                a -= step * (mm / (1 - 0.9**t)) / (np.sqrt(vv / (1 - 0.999**t)) + 1e-9)
    return Router(w)


def fit(x: np.ndarray, parts: int, recall: float = RECALL, k: int = 5) -> Router:
    """Learn the router on a sample of unit vectors, in at most `parts` parts.

    Every tenth is kept from the network; for these, the share of probability is measured under which
    `recall` of their k nearest in the sample are found, and a margin for how few they are.
    """
    x = np.unique(x, axis=0)
    while parts > 1 and len(x) < 32 * parts:
        parts //= 2
    if parts <= 1:
        return Router([np.zeros((x.shape[1], 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1)])
    x = x[np.random.default_rng(6).permutation(len(x))]
    graph = neighbour_graph(x)
    kept = np.arange(len(x)) % 10 != 0
    part = balanced_parts(x, graph, parts)
    target = np.zeros((len(x), parts))
    for column in graph.T:
        target[np.arange(len(x)), part[column]] += 1
    target[np.arange(len(x)), part] += 2
    target /= target.sum(1, keepdims=True)
    router = train_router(x[kept], target[kept])
    asked = np.flatnonzero(~kept)
    s = x[asked] @ x.T
    s[np.arange(len(asked)), asked] = -np.inf
    near = np.argsort(-s, axis=1)[:, :k]
    order, before = router.ordered(x[asked])
    at = np.take_along_axis(np.argsort(order, axis=1), router.place(x)[near], 1)
    needed = np.take_along_axis(before, at, 1).ravel()
    router.share = float(np.quantile(needed, min(1.0, recall + 0.35 / np.sqrt(len(asked))), method="higher")) + 1e-9
    return router


def unit(m: np.ndarray) -> np.ndarray:
    return m / np.sqrt((m * m).sum(1, keepdims=True))


def index(rows: DataFrame, router: Router) -> DataFrame:
    """id, vec, part of every row, stored by part and id."""
    shared = rows.sparkSession.sparkContext.broadcast(router)

    def run(batches):
        for batch in batches:
            part = shared.value.place(unit(matrix(batch.column(1)))) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(part, pa.int32())], ["id", "vec", "part"])

    placed = rows.select("id", "vec").mapInArrow(run, "id long, vec array<double>, part int")
    return durable(placed.repartitionByRange("part", "id").sortWithinPartitions("part", "id"))


def _task(args, batches):
    """Score each part's rows for the queries that are routed there."""
    ids, queries, routes, k = args
    best = Best(len(ids), k, np.float64)
    norm = np.sqrt((queries * queries).sum(1))
    flat = queries / norm[:, None]
    for batch in batches:
        own, part = batch.column(0).to_numpy(), batch.column(2).to_numpy()
        m = matrix(batch.column(1))
        for p in np.unique(part):
            rows = np.flatnonzero(routes[:, p])
            mine = np.flatnonzero(part == p)
            for at in range(0, len(mine) if len(rows) else 0, 1024):
                some = mine[at : at + 1024]
                v, vid = m[some], own[some]
                length = np.sqrt((v * v).sum(1))
                rough = flat[rows] @ (v / length[:, None]).T
                other = vid != ids[rows, None]
                # the k best of this run by the rough product, and all that rounding could put among them
                cut = np.maximum(best.floor()[rows], np.partition(np.where(other, rough, -np.inf), -k, axis=1)[:, -k] if len(some) > k else -np.inf)
                r, c = np.nonzero(other & (rough >= cut[:, None] - 1e-9))
                # one sum a pair, always in the same order, so that equal vectors get equal scores
                exact = np.full(rough.shape, best.worst)
                for a in range(0, len(r), 65536):
                    i, j = r[a : a + 65536], c[a : a + 65536]
                    exact[i, j] = (queries[rows[i]] * v[j]).sum(1) / (norm[rows[i]] * length[j])
                best.add(rows, exact, vid)
    yield best.batch(ids)


def part_blocks(sizes: dict[int, int], most: int = QUERIES_A_BLOCK) -> list[tuple[list[int], int]]:
    """Neighbouring parts to a block of at most `most` queries, and into how many blocks a larger part is split."""
    out: list[tuple[list[int], int]] = []
    own, n = [], 0
    for part in sorted(sizes):
        if own and n + sizes[part] > most:
            out.append((own, 1))
            own, n = [], 0
        if sizes[part] > most:
            out.append(([part], -(-int(1.1 * sizes[part]) // most)))
        else:
            own, n = [*own, part], n + sizes[part]
    return [*out, (own, 1)] if own else out


def nearest(vectors: DataFrame, key: str, vector: str, is_query: Column, k: int = 5, recall: float = RECALL, parts: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query, by cosine on the original vectors.

    `is_query` is a condition on the column `id`. `parts` is by the table's size where not given.
    """
    spark = vectors.sparkSession
    rows = clean_vectors(vectors, key, vector).filter(F.exists("vec", lambda x: x != 0))
    d = width(rows)
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not d:
        return out
    n = rows.count()
    hashed = F.pmod(F.xxhash64(F.lit(11), "id"), F.lit(1 << 30))
    some = rows.filter(hashed <= min(1.0, 1.2 * SAMPLE / n) * (1 << 30)).select("id", "vec", hashed.alias("h")).orderBy("h", "id").limit(SAMPLE).toArrow()
    if parts is None:
        parts = 1 << max(1, (n // PART_ROWS).bit_length() - 1)
    router = fit(unit(matrix(some["vec"].combine_chunks())), min(parts, SAMPLE // 32), recall, k)
    stored = index(rows, router)
    # a row a part: all rows, and the queries
    counts = stored.groupBy("part").agg(F.count("*").alias("n"), F.count_if(is_query).alias("queries")).collect()
    held = np.zeros(router.parts, np.int64)
    for r in counts:
        held[r.part] = r.n
    for own, pieces in part_blocks({r.part: r.queries for r in counts if r.queries}):
        for ids, queries, times in query_blocks(stored.filter(is_query & F.col("part").isin(own)), pieces):
            routes = router.routes(unit(queries), held, k + times)
            asked = np.flatnonzero(routes.any(0))
            some = stored if len(asked) == router.parts else stored.filter(_within("part", asked))
            out = out.unionByName(scan_block(some, (ids, queries, routes, k), _task, k, "double"))
    return out


def _within(column: str, values: np.ndarray) -> Column:
    """A test by ranges of whole numbers, which the scan's statistics can rule out."""
    cuts = np.flatnonzero(np.diff(values) > 1)
    out = F.lit(False)
    for lo, hi in zip(values[np.r_[0, cuts + 1]].tolist(), values[np.r_[cuts, len(values) - 1]].tolist()):
        out = out | F.col(column).between(lo, hi)
    return out
