"""Language identification: averaged embeddings of hashed subwords and a linear softmax.

A text is read as lower-case UTF-8 bytes in which everything but letters is one space. Its
subwords are the byte n-grams of 2 to 5 within a word, its borders included. Each is hashed to a
row of an embedding table; the mean of the rows goes through a linear layer and a softmax. Table
and layer are trained together in numpy by stochastic gradient descent with momentum. A
temperature is then fitted on labelled texts that training has not seen, and the rejection level
is the calibrated probability that all but `lose` of the rightly classified ones reach.

Null texts and texts without a letter (of Unicode's kinds L) are `und` with score 0 and are
rejected. Whole texts are read, in slices where long, so memory is bounded. Repeated rows get the
same answer. Without a labelled row every text is `und`. The fit takes at most `PER_LANGUAGE`
labelled texts a language, chosen by a hash of the id, of an id the smallest; tasks turn them into
shares of buckets, some 50 KB a text at most, whatever its length. The driver fetches FETCH of them
at a time and keeps them in a local file, from which training reads its batches: its memory does not
grow with the number of languages, but for the model (32 KB each). The prediction reads the text alone.
"""

from __future__ import annotations

import os
import re
import tempfile
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandframe.llm.common import small

PER_LANGUAGE = 500  # labelled texts of each language that the fit may read
BUCKETS = 1 << 13
FETCH = 1000  # histograms that the driver gets at once, 50 MB at most
HELD = 2048  # histograms that calibration holds at once
SLICE = 1 << 16  # bytes that are hashed at once
_LETTERLIKE = re.compile(r"[^\W\d_]")  # letters, and numerals such as ² or Ⅷ
_PRIMES = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], np.uint32)
_ASCII = np.array([b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256)], np.uint8)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(m[0].isalpha() for m in _LETTERLIKE.finditer(text))


def _slices(raw: np.ndarray):
    """Pieces of at most SLICE bytes which overlap, so that each n-gram lies whole in one."""
    for at in range(0, max(1, len(raw) - 4), SLICE):
        yield raw[at : at + SLICE + 4], len(raw) - at


def histogram(text: str) -> np.ndarray:
    """Shares of the buckets that the text's subwords hash to."""
    raw = np.frombuffer(b" " + text.lower().encode("utf-8", "replace") + b" ", np.uint8)
    counts = np.zeros(BUCKETS, np.float32)
    for part, left in _slices(raw):
        b = _ASCII[part]
        word = (b != 32).astype(np.uint8)
        n_all, wide = len(b), b.astype(np.uint32)
        last = left <= SLICE + 4  # what the next slice begins with is counted there
        h, inner = wide * _PRIMES[0], np.ones(n_all, bool)
        for n in range(2, 6):
            if n_all < n:
                break
            m = n_all - n + 1
            h = (h[:m] ^ (h[:m] >> np.uint32(15))) * _PRIMES[n - 1] + wide[n - 1 :] * _PRIMES[(n + 1) % 5]
            if n > 2:  # no space between the first and the last byte
                inner = inner[:m] & (word[n - 2 : n - 2 + m] > 0)
            own = m if last else min(m, SLICE)
            ok = inner[:own] & ((word[:own] + word[n - 1 : n - 1 + own]) > 0)
            keep = h[:own][ok]
            counts += np.bincount((keep ^ (keep >> np.uint32(13))) & np.uint32(BUCKETS - 1), minlength=BUCKETS)
    total = counts.sum()
    return counts / total if total else counts


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # buckets x languages: table times layer
    bias: np.ndarray
    temperature: float = 1.0
    level: float = 0.0
    embeddings: np.ndarray | None = None

    def logits(self, shares: np.ndarray) -> np.ndarray:
        return shares @ self.weights + self.bias

    def probabilities(self, shares: np.ndarray) -> np.ndarray:
        z = self.logits(shares) / self.temperature
        p = np.exp(z - z.max(-1, keepdims=True))
        return p / p.sum(-1, keepdims=True)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, calibrated probability, and whether it is rejected."""
        if not self.languages or not has_letter(text):
            return "und", 0.0, True
        p = self.probabilities(histogram(text))
        best = int(p.argmax())
        return self.languages[best], float(p[best]), bool(p[best] < self.level)


class Histograms:
    """Histograms in a local file; memory holds a place of each, and those that are asked for."""

    def __init__(self, found=()):
        self._file, self._ends, self._order = tempfile.TemporaryFile(), [0], None
        for h in found:
            at = np.flatnonzero(h)
            self.add(at.astype("<u2").tobytes(), h[at].astype("<f4").tobytes())

    def add(self, at: bytes, share: bytes) -> None:
        self._ends.append(self._ends[-1] + self._file.write(share) + self._file.write(at))

    def order(self, numbers: list[int]) -> None:
        """From now on only these, in this order."""
        self._file.flush()
        self._order = numbers

    def __len__(self) -> int:
        return len(self._ends) - 1 if self._order is None else len(self._order)

    def __getitem__(self, i: int) -> np.ndarray:
        if i >= len(self):
            raise IndexError(i)
        return self.dense([i])[0]

    def dense(self, some) -> np.ndarray:
        self._file.flush()
        out = np.zeros((len(some), BUCKETS), np.float32)
        for row, i in zip(out, some):
            k = i if self._order is None else self._order[i]
            raw = os.pread(self._file.fileno(), self._ends[k + 1] - self._ends[k], self._ends[k])
            n = len(raw) // 6
            row[np.frombuffer(raw, "<u2", n, 4 * n)] = np.frombuffer(raw, "<f4", n)
        return out


def train(texts: list | Histograms, labels: list[str], dim: int = 16, epochs: int = 30, batch: int = 32, rate: float = 30.0, lose: float = 0.002, seed: int = 7) -> Model:
    """Fit on labelled texts, or their histograms; every fifth is kept for calibration."""
    languages = sorted(set(labels))
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0, np.float32))
    rng = np.random.default_rng(seed)
    x = texts if isinstance(texts, Histograms) else Histograms(histogram(t) if isinstance(t, str) else t for t in texts)
    place = {v: i for i, v in enumerate(languages)}
    y = np.array([place[v] for v in labels])
    order = rng.permutation(len(y))
    held = order[: len(y) // 5] if len(y) >= 20 else order
    fit = order[len(y) // 5 :] if len(y) >= 20 else order
    share = np.bincount(y[fit], minlength=len(languages)).astype(np.float32)
    weight = (len(fit) / (len(languages) * np.maximum(share, 1)))[y]  # each language counts alike
    table = rng.normal(0, 0.1, (BUCKETS, dim)).astype(np.float32)
    layer = rng.normal(0, 0.3, (dim, len(languages))).astype(np.float32)
    bias = np.zeros(len(languages), np.float32)
    speed = [np.zeros_like(v) for v in (table, layer, bias)]
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in np.array_split(rng.permutation(fit), max(1, len(fit) // batch)):
            seen = x.dense(i)
            mean = seen @ table
            z = mean @ layer + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(i)), y[i]] -= 1
            p *= (weight[i] / len(i))[:, None].astype(np.float32)
            grads = seen.T @ (p @ layer.T), mean.T @ p, p.sum(0)
            for v, s, g, r in zip((table, layer, bias), speed, grads, (step, step * 0.02, step * 0.01)):
                s *= 0.8
                s -= r * np.clip(g, -1, 1)
                v += s
    model = Model(languages, table @ layer, bias, embeddings=table)
    # logits lie in a file, too: there are as many a text as languages
    z = np.memmap(tempfile.TemporaryFile(), np.float32, "w+", shape=(len(held), len(languages)))
    for at in range(0, len(held), HELD):
        z[at : at + HELD] = model.logits(x.dense(held[at : at + HELD]))
    step = max(HELD, (1 << 22) // len(languages))
    cuts = [slice(at, at + step) for at in range(0, len(held), step)]
    right = np.concatenate([z[c].argmax(1) == y[held[c]] for c in cuts])

    def softmax(c: slice, t: float) -> tuple[np.ndarray, np.ndarray]:
        """Logits over t without their maximum, and the sums of their exponentials."""
        q = np.asarray(z[c]) / t
        q -= q.max(1, keepdims=True)
        return q, np.exp(q).sum(1)

    def loss(t: float) -> float:
        total = 0.0
        for c in cuts:
            q, sums = softmax(c, t)
            total -= float((q[np.arange(len(q)), y[held[c]]] - np.log(sums)).sum(dtype=np.float64))
        return total / len(held)

    model.temperature = min(np.geomspace(0.25, 20, 60), key=loss)
    sure = np.sort(np.concatenate([1 / softmax(c, model.temperature)[1] for c in cuts])[right])
    if len(sure):
        # a margin below the quantile: few calibration texts say little of the tail
        model.level = min(0.5, float(sure[int(lose * len(sure))]) * 0.9)
    return model


def counted(rows: DataFrame, label: str, key: str) -> dict:
    """About how many ids each label has."""
    return {r[0]: max(1, r[1]) for r in rows.groupBy(label).agg(F.approx_count_distinct(key)).collect()}


def chosen(rows: DataFrame, label: str, each: int, key: str, salt: int = 17, counts: dict | None = None) -> DataFrame | None:
    """Some `each` ids a label, those whose hash is smallest, with that hash as `hash_`: one row an id, of its smallest values.

    A pass counts the labels' ids (one row each). A label's share of the hash's whole range is at
    least what holds one expected id in any number of them; no window holds a label's rows, and an
    id of any number of rows is aggregated before it is shuffled.
    """
    counts = counted(rows, label, key) if counts is None else counts
    if not counts:
        return None
    # a row a label, joined: a condition a label would nest as deep as there are labels
    most = [min((1 << 63) - 1, -(1 << 63) + int((1 << 64) * min(1.0, 1.2 * each / n))) for n in counts.values()]
    limits = rows.sparkSession.createDataFrame(pa.table({label: pa.array(list(counts)), "most_": pa.array(most, pa.int64())}))
    limits = limits.select(F.col(label).cast(rows.schema[label].dataType), "most_")
    hashed = rows.join(F.broadcast(limits), label).withColumn("hash_", F.xxhash64(F.lit(salt), key)).filter(F.col("hash_") <= F.col("most_"))
    others = [c for c in rows.columns if c != label]
    return hashed.groupBy(label, "hash_").agg(*[F.min(c).alias(c) for c in others])


def by_label(rows: list, each: int) -> tuple[list[str], list]:
    """Values and labels of (value, label, hash) rows: the first `each` by hash of each label."""
    taken: dict = {}
    for value, name, _ in sorted(rows, key=lambda r: (str(r[1]), r[2])):
        if len(taken.setdefault(name, [])) < each:
            taken[name].append(value)
    return [t for v in taken.values() for t in v], [n for n, v in taken.items() for _ in v]


def sample(docs: DataFrame, key: str, text: str, label: str, where: Column, each: int = PER_LANGUAGE) -> tuple[Histograms, list[str]]:
    """Histograms of at most `each` whole texts of each label, made by the tasks and fetched FETCH at a time."""
    known = docs.filter(where & F.col(label).isNotNull()).select(F.col(key).alias("key_"), F.col(text).alias("text_"), F.col(label).alias("label_"))
    counts, out = counted(known, "label_", "key_"), Histograms()
    rows = chosen(known, "label_", each, "key_", counts=counts)
    if rows is None:
        return out, []

    def run(batches):
        for batch in small(batches):
            own = [i for i, t in enumerate(batch.column(0).to_pylist()) if has_letter(t)]
            found = [histogram(batch.column(0)[i].as_py()) for i in own]
            places = [np.flatnonzero(h) for h in found]
            raw = [pa.array([v.astype(kind).tobytes() for v in part], pa.binary()) for part, kind in ((places, "<u2"), ([h[p] for h, p in zip(found, places)], "<f4"))]
            yield pa.RecordBatch.from_arrays([*raw, batch.column(1).take(pa.array(own, pa.int64())), batch.column(2).take(pa.array(own, pa.int64()))], ["at", "share", "label_", "hash_"])

    kind = known.schema["label_"].dataType.simpleString()
    made = rows.select("text_", "label_", "hash_").mapInArrow(run, f"at binary, share binary, label_ {kind}, hash_ long")
    parts = max(1, -(-int(sum(min(n, 1.2 * each) for n in counts.values())) // FETCH))
    got = []
    for at, share, name, hashed in made.repartition(parts).toLocalIterator():
        got.append((len(got), name, hashed))
        out.add(bytes(at), bytes(share))
    numbers, labels = by_label(got, each)
    out.order(numbers)
    return out, labels


def fit(docs: DataFrame, key: str, text: str, label: str, where: Column) -> Model:
    model = train(*sample(docs, key, text, label, where))
    model.embeddings = None
    return model


def predict(df: DataFrame, key: str, text: str, model: Model) -> DataFrame:
    """key, lang_pred, score and rejected of each row; the model (under 1 MB a dozen languages) is broadcast."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in small(batches):
            got = [m.predict(t) for t in batch.column(1).to_pylist()]
            cols = zip(*got) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(list(c), k) for c, k in zip(cols, (pa.string(), pa.float64(), pa.bool_()))]], ["key", "lang_pred", "score", "rejected"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, lang_pred string, score double, rejected boolean").withColumnRenamed("key", key)


def keep(df: DataFrame, text: str, model: Model) -> DataFrame:
    """The rows, with all their columns, that are not rejected; each row is judged where it lies."""
    shared, at = df.sparkSession.sparkContext.broadcast(model), df.columns.index(text)

    def run(batches):
        m = shared.value
        for batch in small(batches):
            yield batch.filter(pa.array([not m.predict(t)[2] for t in batch.column(at).to_pylist()], pa.bool_()))

    return df.mapInArrow(run, df.schema)
