"""Inverse-CDF samplers as columns of a uniform u in [0, 1), and a 48-bit congruential step."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE = 1 << 16  # letters that mutate() draws at once
_MASK = (1 << 64) - 1
_P1, _P2, _P3, _P5 = map(np.uint64, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))  # of xxhash64
LCG_MUL, LCG_ADD, LCG_MOD = 0x5DEECE66D, 11, 1 << 48


def uniform(u: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return low + u * (high - low)


def coin(u: Column) -> Column:
    return F.when(u < 0.5, 0).otherwise(1)


def weighted_coin(u: Column, p: float) -> Column:
    return F.when(u < p, 1).otherwise(0)


def exponential(u: Column, rate: float) -> Column:
    return -F.ln(1 - u) / rate


def geometric(u: Column, p: float) -> Column:
    return F.ceil(F.ln(1 - u) / F.ln(F.lit(1 - p)))


def normal(u: Column, v: Column, mean: float = 0.0, sd: float = 1.0) -> Column:
    """From two uniforms."""
    return mean + sd * F.sqrt(-2 * F.ln(1 - u)) * F.cos(2 * F.pi() * v)


def log_normal_parameters(mean: Column, sd: Column) -> tuple[Column, Column]:
    """mu and sigma of the logarithm, from mean and standard deviation."""
    s2 = F.ln(1 + (sd / mean) * (sd / mean))
    return F.ln(mean) - s2 / 2, F.sqrt(s2)


def poisson(u: Column, rate: float) -> Column:
    """The smallest k whose cumulative probability exceeds u; rates above 700, whose first term leaves the doubles, are an error."""
    if not 0 <= rate <= 700:
        raise ValueError(f"a rate of {rate} is not between 0 and 700")
    most = int(rate + 40 * (rate + 1) ** 0.5 + 40)  # beyond that the terms add nothing to a double
    start = F.struct(F.lit(0).alias("k"), F.exp(F.lit(-rate)).alias("p"), F.exp(F.lit(-rate)).alias("c"))

    def step(a, k):
        p = a["p"] * rate / k
        return F.when(a["c"] > u, a).otherwise(F.struct(k.alias("k"), p.alias("p"), (a["c"] + p).alias("c")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, step, lambda a: a["k"])


def binomial(u: Column, n: int, p: float) -> Column:
    first = (1 - p) ** n
    start = F.struct(F.lit(0).alias("k"), F.lit(first).alias("p"), F.lit(first).alias("c"))

    def step(a, k):
        q = a["p"] * (n - k + 1) / k * (p / (1 - p))
        return F.when(a["c"] > u, a).otherwise(F.struct(k.alias("k"), q.alias("p"), (a["c"] + q).alias("c")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(n)), start, step, lambda a: a["k"])


def mutate(seq: Column, seed: Column, insert: float, delete: float, substitute: float) -> Column:
    """A sequence with letters inserted, deleted and replaced at given rates; the same seed gives the same result.

    Chance is a hash of seed and place, xxhash64(seed, place from 0, kind of chance) modulo 2^30, so no
    state is carried from letter to letter; all letters of a slice are drawn at once.
    """

    @F.arrow_udf("string")
    def mutated(texts: pa.Array, seeds: pa.Array) -> pa.Array:
        return pa.array([t and _mutated(t, s, insert, delete, substitute) for t, s in zip(texts.to_pylist(), seeds.to_pylist())], pa.string())

    return mutated(seq, F.xxhash64(seed))


def differing(a: Column, b: Column, among: str) -> Column:
    """Places, as far as both go, where b has another letter than a, one of `among`."""

    @F.arrow_udf("long")
    def places(one: pa.Array, other: pa.Array) -> pa.Array:
        return pa.array([None if x is None or y is None else _differing(x, y, among) for x, y in zip(one.to_pylist(), other.to_pylist())], pa.int64())

    return places(a, b)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


def _places(points: np.ndarray, letters: str) -> np.ndarray:
    """The place of each letter, by its code point, among up to 255 ASCII letters; their number where it is none of them."""
    table = np.full(129, len(letters), np.uint8)
    table[_points(letters)] = np.arange(len(letters))
    return table[np.minimum(points, 128)]


def _differing(a: str, b: str, among: str) -> int:
    n = min(len(a), len(b))
    x, y = (_points(t)[:n] for t in (a, b))
    return int(np.count_nonzero((x != y) & (_places(y, among) < len(among))))


def _hash_int(value: np.ndarray | int, seed: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of 32-bit numbers, not negative, that goes on from `seed`."""
    h = (seed + (_P5 + np.uint64(4))) ^ (np.atleast_1d(np.asarray(value, np.uint64)) * _P1)
    h = (h << np.uint64(23) | h >> np.uint64(41)) * _P2 + _P3
    h = (h ^ h >> np.uint64(33)) * _P2
    h = (h ^ h >> np.uint64(29)) * _P3
    return h ^ h >> np.uint64(32)


def _mutated(text: str, seed: int, insert: float, delete: float, substitute: float) -> str:
    letters, out = _points("acgt"), []
    whole = _points(text)
    for at in range(0, len(whole), SLICE):
        c = whole[at : at + SLICE]
        place = _hash_int(np.arange(at, at + len(c)), np.array([seed & _MASK], np.uint64))
        chance = lambda k, some: (_hash_int(k, place[some]) & np.uint64((1 << 30) - 1)) / float(1 << 30)  # noqa: B023, E731
        u = chance(0, slice(None))
        gone = u < delete
        other = ~gone & (u < delete + substitute)
        more = ~gone & ~other & (u < delete + substitute + insert)
        new, times = c.copy(), np.where(gone, 0, np.where(more, 2, 1))
        pick = np.floor(chance(1, other) * 3).astype(np.int64)
        new[other] = letters[pick + (pick >= _places(c[other], "acgt"))]  # the letter itself is passed over
        made = np.repeat(new, times)
        made[(np.cumsum(times) - times)[more]] = letters[np.floor(chance(2, more) * 4).astype(np.int64)]
        out.append(made.tobytes().decode("utf-32-le"))
    return "".join(out)


def choose(draws: DataFrame, u: str, weights: DataFrame, value: str, weight: str) -> DataFrame:
    """Each draw with the value in whose share of the cumulative weights it falls; a table of more than 100,000 weights is an error."""
    if weights.limit(100_001).count() > 100_000:
        raise ValueError("a table of weights has at most 100,000 rows")
    w = Window.orderBy(value)
    up = F.sum(weight).over(w)
    total = F.sum(weight).over(Window.partitionBy())
    bounds = weights.select(F.col(value), ((up - F.col(weight)) / total).alias("lo_"), (up / total).alias("hi_"))
    return draws.join(F.broadcast(bounds), (F.col(u) >= F.col("lo_")) & (F.col(u) < F.col("hi_"))).drop("lo_", "hi_")


def lcg_next(x: Column) -> Column:
    """x * 0x5DEECE66D + 11 modulo 2^48, for x below 2^48.

    The multiplier is used in parts of 12 bits, so that no product leaves 64 bits.
    """
    out, low = F.lit(LCG_ADD).cast("long"), F.lit(LCG_MOD - 1)
    for shift in (0, 12, 24):
        part = LCG_MUL >> shift & 0xFFF
        room = F.lit((1 << 48 - shift) - 1)
        out = out + F.shiftleft((x.cast("long").bitwiseAND(room) * part).bitwiseAND(room), shift)
    return out.bitwiseAND(low)
