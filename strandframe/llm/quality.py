"""Quality classifier: a byte-level convolutional network in numpy.

Each byte becomes a vector of fixed channels (its class, and whether it repeats the byte a few
places back). Learned filters of WIDTH bytes move over the whole document in steps of STEP; a
rectified response is max-pooled within chunks of CHUNK bytes that overlap by half and cover the
document to its last byte. Over the chunks, the largest, smallest and mean pooled response of
each filter, with the length of a short text, are combined by one logistic unit.

Filters and unit are trained together by Adam on the cross entropy; the gradient of a maximum
goes to the place that had it. Null and empty texts are scored as a document of no bytes. Long
texts are read in slices, so memory is bounded; no byte is left out, and slices give what one
pass would. Repeated rows get the same score. Without labels of both kinds the score is the share
of label 1 (0.5 without any). The fit takes at most `PER_LABEL` ids of each label, chosen by a hash
of the id, and for each the smallest of its texts; of a text of more than FIT_BYTES it reads
pieces, evenly spread over the whole, which add up to that. So the driver holds 120 MB at most.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandframe.llm import langid
from strandframe.llm.common import small

PER_LABEL = 900  # texts of each label that the fit may read
FIT_BYTES = 1 << 16  # bytes of each that it may read, in pieces of FIT_PIECE
FIT_PIECE = 1 << 13
WIDTH, STEP, CHUNK = 12, 4, 512
SLICE = 1 << 16  # bytes whose responses are held at once
LEVEL = 0.7


def _channels() -> np.ndarray:
    c = np.zeros((256, 12), np.float32)
    for b in range(256):
        ch = chr(b)
        kind = (
            0 if "a" <= ch <= "z" else 1 if "A" <= ch <= "Z" else 2 if ch.isdigit() and b < 128 else 3 if ch == " " else 4 if ch in "\n\r" else 5 if ch in ".,;:'" else
            6 if ch in "!?" else 7 if ch in "#$%&*@^~" else 8 if ch in "|<>{}[]()/\\_=+-\"`" else 9 if b >= 128 else 10
        )
        c[b, kind] = 1
        if ch in "aeiou":
            c[b, 11] = 1
    return c


_CLASS = _channels()
DEPTH = _CLASS.shape[1] + 1


def _inputs(raw: np.ndarray, lo: int = 0, hi: int | None = None) -> np.ndarray:
    """Channels of the bytes lo to hi; the last one tells a repeat of the text a word back."""
    hi = len(raw) if hi is None else hi
    own = raw[lo:hi]
    x = np.zeros((len(own), DEPTH), np.float32)
    x[:, :-1] = _CLASS[own]
    # within a word: the same byte at the same place of the word before, also where that began long before lo
    before = _spaces_before(raw, lo)
    spaces = np.r_[before, lo + np.flatnonzero(own == 32)]
    if len(spaces) > 1:
        gap = np.r_[0, np.diff(spaces)]
        back = gap[np.cumsum(own == 32) + len(before) - 1]  # by the last space at or before each byte
        at = np.arange(lo, hi) - back
        x[:, -1] = (back > 0) & (at >= 0) & (own == raw[np.maximum(at, 0)])
    return x


def _spaces_before(raw: np.ndarray, lo: int, step: int = 1 << 12) -> list[int]:
    """The last two spaces before a place; one before the text's first byte is taken to be at -1."""
    found: list[int] = []
    while lo > 0 and len(found) < 2:
        start = max(0, lo - step)
        found = [*(start + np.flatnonzero(raw[start:lo] == 32)[len(found) - 2 :]).tolist(), *found]
        lo, step = start, step * 2
    return found if len(found) == 2 else [-1, *found]


def _windows(x: np.ndarray) -> np.ndarray:
    n = (len(x) - WIDTH) // STEP + 1
    return np.lib.stride_tricks.as_strided(x, (n, WIDTH * DEPTH), (STEP * DEPTH * 4, 4))


_PER = CHUNK // STEP  # places of a filter that begin within a chunk


def _chunks(places: int) -> list[tuple[int, int]]:
    """Chunks overlapping by half; the last one ends with the text."""
    if places <= _PER:
        return [(0, places)]
    starts = list(range(0, places - _PER, _PER // 2)) + [places - _PER]
    return [(s, s + _PER) for s in starts]


def _padded(text: str | bytes | None) -> tuple[np.ndarray, float]:
    raw = np.frombuffer(text if isinstance(text, bytes) else (text or "").encode("utf-8", "replace"), np.uint8)
    short = min(len(raw), CHUNK) / CHUNK
    pad = max(WIDTH, -(-max(len(raw) - WIDTH, 0) // STEP) * STEP + WIDTH) - len(raw)  # so that the last byte is within a window
    return np.r_[raw, np.zeros(pad, np.uint8)], short


@dataclass
class Model:
    filters: np.ndarray  # WIDTH * DEPTH x filters
    shift: np.ndarray
    unit: np.ndarray  # 3 * filters + 1
    bias: float
    constant: float | None = None

    def pooled(self, raw: np.ndarray) -> np.ndarray:
        """Largest, smallest and mean over the chunks of the largest response in each."""
        n = (len(raw) - WIDTH) // STEP + 1
        half = _PER // 2
        blocks = []  # largest response within each half chunk; whole ones end at multiples
        tail = np.zeros((0, self.filters.shape[1]), np.float32)
        for at in range(0, n, SLICE // STEP // half * half):
            stop = min(n, at + SLICE // STEP // half * half)
            a = np.maximum(_windows(_inputs(raw, at * STEP, (stop - 1) * STEP + WIDTH)) @ self.filters + self.shift, 0)
            tail = np.concatenate([tail, a])[-_PER:]
            blocks.append(np.maximum.reduceat(a, np.arange(0, len(a), half), axis=0))
        b = np.concatenate(blocks)
        if n <= _PER:
            c = b.max(0, keepdims=True)
        else:
            whole = (n - _PER - 1) // half + 1  # chunks that begin at multiples of half
            c = np.concatenate([np.maximum(b[:whole], b[1 : whole + 1]), tail.max(0, keepdims=True)])
        return np.concatenate([c.max(0), c.min(0), c.mean(0)])

    def score(self, text: str | None) -> float:
        if self.constant is not None:
            return self.constant
        raw, short = _padded(text)
        z = float(np.concatenate([self.pooled(raw), [short]]) @ self.unit + self.bias)
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def spread(text: str | None, most: int = FIT_BYTES, piece: int = FIT_PIECE) -> bytes:
    """A text's bytes, or where there are more than `most`, evenly spread pieces that add up to that, from its first to its last byte."""
    raw = (text or "").encode("utf-8", "replace")
    if len(raw) <= most:
        return raw
    n = most // piece
    return b"".join(raw[(at := (len(raw) - piece) * i // (n - 1)) : at + piece] for i in range(n))


def train(texts: list, labels: list[int], filters: int = 32, epochs: int = 10, batch: int = 16, rate: float = 0.01, seed: int = 5) -> Model:
    """Fit on texts, or their bytes, of which FIT_BYTES each are read at most."""
    y = np.array(labels, np.float32)
    if len(y) == 0 or y.min() == y.max():
        return Model(np.zeros((WIDTH * DEPTH, 1), np.float32), np.zeros(1, np.float32), np.zeros(4, np.float32), 0.0, float(y.mean()) if len(y) else 0.5)
    rng = np.random.default_rng(seed)
    docs = [_padded(t if isinstance(t, bytes) else spread(t)) for t in texts]
    p = [rng.normal(0, 0.25, (WIDTH * DEPTH, filters)).astype(np.float32), np.full(filters, -0.2, np.float32), rng.normal(0, 0.05, 3 * filters + 1).astype(np.float32), np.zeros(1, np.float32)]
    first, second, t = [np.zeros_like(v) for v in p], [np.zeros_like(v) for v in p], 0
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs) + 1e-4
        for some in np.array_split(rng.permutation(len(docs)), max(1, len(docs) // batch)):
            grads = [np.zeros_like(v) for v in p]
            for i in some:
                raw, short = docs[i]
                w = _windows(_inputs(raw))
                a = w @ p[0] + p[1]
                chunks = _chunks(len(w))
                where = np.stack([a[s:e].argmax(0) + s for s, e in chunks])
                cols = np.arange(filters)
                c = np.maximum(a[where, cols], 0)
                hi, lo = c.argmax(0), c.argmin(0)
                f = np.concatenate([c[hi, cols], c[lo, cols], c.mean(0), [short]]).astype(np.float32)
                z = float(f @ p[2] + p[3][0])
                g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[i]) * weight[i] / len(some)
                grads[2] += g * f
                grads[3] += g
                d = np.repeat((g * p[2][2 * filters : -1] / len(chunks))[None], len(chunks), 0)
                d[hi, cols] += g * p[2][:filters]
                d[lo, cols] += g * p[2][filters : 2 * filters]
                d *= c > 0
                grads[1] += d.sum(0)
                grads[0] += np.einsum("cfk,cf->kf", w[where], d, optimize=True)
            grads[2] += 1e-4 * p[2]
            t += 1
            for v, m, q, g in zip(p, first, second, grads):
                m += 0.1 * (g - m)
                q += 0.001 * (g * g - q)
                v -= step * (m / (1 - 0.9**t)) / (np.sqrt(q / (1 - 0.999**t)) + 1e-8)
    return Model(p[0], p[1], p[2], float(p[3][0]))


def fit(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, where: Column) -> Model:
    """Labels may repeat or name no document; null and other values are left out.

    `where` is a condition on the columns of `labels`. Ids are chosen from the labels alone. They
    are bounded by PER_LABEL, so the join that fetches their texts broadcasts them.
    """
    known = labels.filter(where & F.col(key).isNotNull()).select(F.col(key).alias("key_"), F.col(label).cast("int").alias("label_")).filter(F.col("label_").isin(0, 1))
    some = langid.chosen(known, "label_", PER_LABEL, "key_")
    if some is None:
        return train([], [])
    found = docs.select(F.col(key).alias("key_"), F.col(text).alias("text_")).join(F.broadcast(some), "key_")

    def run(batches):
        for batch in small(batches):
            yield pa.RecordBatch.from_arrays([pa.array([spread(t) for t in batch.column(0).to_pylist()], pa.binary()), batch.column(1), batch.column(2)], ["raw", "label_", "hash_"])

    # an id of any number of rows is one, by its smallest text
    read = found.select("text_", "label_", "hash_").mapInArrow(run, "raw binary, label_ int, hash_ long")
    got = read.groupBy("label_", "hash_").agg(F.min("raw").alias("raw")).select("raw", "label_", "hash_").collect()
    return train(*langid.by_label([(bytes(r[0]), r[1], r[2]) for r in got], PER_LABEL))


def predict(df: DataFrame, key: str, text: str, model: Model) -> DataFrame:
    """key and score of each row; the model (some 20 KB) is broadcast."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in small(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m.score(t) for t in batch.column(1).to_pylist()], pa.float64())], ["key", "score"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, score double").withColumnRenamed("key", key)


def keep(df: DataFrame, text: str, model: Model, level: float = LEVEL) -> DataFrame:
    """The rows, with all their columns, that are not rejected; each row is judged where it lies."""
    shared, at = df.sparkSession.sparkContext.broadcast(model), df.columns.index(text)

    def run(batches):
        m = shared.value
        for batch in small(batches):
            yield batch.filter(pa.array([m.score(t) >= level for t in batch.column(at).to_pylist()], pa.bool_()))

    return df.mapInArrow(run, df.schema)
