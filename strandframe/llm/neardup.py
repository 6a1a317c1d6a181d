"""Near-duplicate classes: BagMinHash signatures, bands, and verified multiset overlap.

A text is the multiset of its shingles of five words (words stand between white space; a text of
fewer words is one shingle, of no words none). Two texts are near duplicates where the weighted
Jaccard similarity of the multisets is at least 0.8, and classes are what such pairs connect.

Signature. Weights are discretised at the integers and covered by the intervals [0,1), [1,2),
[2,4), [4,8) and so on, each with a Poisson process of its own, seeded by the shingle and the
interval, with a rate of the interval's length. A point has a time, a height within its
interval and a register. A shingle of weight w sees all points of the intervals below w, and of
the one that w cuts the points whose height is below w: the processes are nested, so two texts
share what lies below the smaller weight, and the chance that a register's earliest points agree
is the weighted Jaccard similarity, without bias, at a cost of log w for each shingle. Points are
drawn up to a time by which all registers are filled but with a chance of some 1 %; a document with an
unfilled register is drawn again to twice the time.

Candidates. 16 bands of 4 registers. Rows of (band, signature) are sorted across the cluster by
band value, then signature, so that a bucket of any size lies in runs, spread over tasks, with like
texts side by side. A task walks its run in windows and proposes, for each text, the first and the most similar of the
earlier texts that are likely by signature; buckets of which it has not proposed all likely pairs it reports as
open. Once the proposed pairs are verified and classes formed, an open bucket that lies in one
class has nothing left to find. In the others the texts outside the largest class meet all of the
bucket by their signatures alone, in blocks. Those that have a likely partner in another class meet
a second time, with their multisets, in smaller blocks, and every likely pair across classes is
verified there unless the block has already joined the two. So a bucket of n copies costs some n
pairs, and yet no likely pair between different classes stays unverified, whatever a bucket's size.

Likely are pairs of which LIKELY of the registers agree in half a byte and whose sizes allow a
similarity of 0.8. A pair at 0.8 has 52 of 64 equal half bytes in the mean, with a deviation of 3.1,
and fails the test of 36 with a chance below 0.000001; it shares no band with one of 0.0002.

Verification compares the multisets of each proposed pair exactly. Classes come from repeated
minimum labels over the verified pairs, written to the shared folder each round.

Equal texts are classed together first, by a 128-bit hash, in one aggregation that combines
before the shuffle; so a text that a third of all rows share is signed as often but paired once.
Empty texts are equal to each other; null texts are alone. Repeated rows (also of one id) count
as copies. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandframe.llm.common import durable, scratch, small

WORDS, ENOUGH = 5, 0.8
BANDS, DEPTH = 16, 4
REGISTERS = BANDS * DEPTH
WINDOW = 512  # texts of a bucket that are held side by side in the first pass
BLOCK = 512  # texts of an open bucket, on either side, whose signatures are held at once
BAGS = 128  # the same with their multisets
SPLIT = 500_000  # open bands of several classes that are broadcast, 24 bytes each; joined by a shuffle beyond
FILTERED = 1 << 24  # texts in pairs up to which their Bloom filter, of 64 MB at most, is broadcast
LIKELY = 0.56  # share of registers with equal half bytes from which a pair is proposed: 5 standard deviations below 0.8


def _mix(h: np.ndarray) -> np.ndarray:
    """A full avalanche of 64 bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_GOLD = np.uint64(0x9E3779B97F4A7C15)
_MULT = np.uint64(0xD6E8FEB86659FD93)


def _times(n: int, c: np.uint64) -> np.uint64:
    return np.uint64(n * int(c) & 0xFFFFFFFFFFFFFFFF)


def shingles(text: str | None, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit shingle hashes, sorted, and their counts."""
    found = text.split() if text else []
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    # word hashes: polynomials over the bytes of one buffer, all words at once
    # each with a space after it, the last one too, so that a word's hash does not tell where it stands
    raw = np.frombuffer((" ".join(found) + " ").encode("utf-8", "surrogatepass"), np.uint8)
    if len(found) == 1:
        starts = np.zeros(1, np.int64)
    else:
        at = np.fromiter((len(w.encode("utf-8", "surrogatepass")) if not w.isascii() else len(w) for w in found), np.int64, len(found))
        starts = np.cumsum(at + 1) - at - 1
    place = np.arange(len(raw)) - np.repeat(starts, np.diff(np.r_[starts, len(raw)]))
    h = np.add.reduceat(_mix(raw.astype(np.uint64) + np.uint64(257) * place.astype(np.uint64)), starts)
    h = _mix(h)
    n = max(1, len(h) - words + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(words, len(h))):
        out = _mix(out * _MULT + h[k : k + n] + _GOLD)
    return np.unique(out, return_counts=True)


def _uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], registers: int = REGISTERS) -> np.ndarray:
    """bags x registers: a hash of the earliest point of each register (0 for an empty bag)."""
    out = np.zeros((len(bags), registers), np.uint64)
    todo = [i for i, b in enumerate(bags) if len(b[0])]
    stretch = 1.0
    while todo:
        size = np.array([len(bags[i][0]) for i in todo])
        doc = np.repeat(np.arange(len(todo)), size)
        element = np.concatenate([bags[i][0] for i in todo])
        weight = np.concatenate([bags[i][1] for i in todo]).astype(np.float64)
        horizon = stretch * registers * (np.log(registers) + 4.5) / np.array([bags[i][1].sum() for i in todo])
        first = np.full((len(todo), registers), np.inf)
        name = np.zeros((len(todo), registers), np.uint64)
        low, level = 0.0, 0
        while True:
            some = np.flatnonzero(weight > low)
            if not len(some):
                break
            rate = max(low, 1.0)  # the interval's length: [0,1), then [low, 2 low)
            seed = _mix(element[some] + _times(level + 1, _GOLD))
            time, who, d, w = np.zeros(len(some)), seed, doc[some], weight[some]
            end = horizon[d]
            step = 0
            while len(who):
                step += 1
                r = _mix(who + _times(step, _MULT))
                time = time - np.log(_uniform(r)) / rate
                go = time <= end
                if not go.all():
                    time, who, d, w, end, r = time[go], who[go], d[go], w[go], end[go], r[go]
                if not len(who):
                    break
                point = _mix(r ^ _GOLD)
                seen = w > low + rate * _uniform(_mix(point + _MULT)) if level or rate != 1 else np.ones(len(w), bool)
                reg = (point % np.uint64(registers)).astype(np.int64)
                dd, rr, tt, pp = d[seen], reg[seen], time[seen], point[seen]
                flat = dd * registers + rr
                order = np.lexsort((tt, flat))
                flat, tt, pp = flat[order], tt[order], pp[order]
                lead = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]]) if len(flat) else np.zeros(0, np.int64)
                flat, tt, pp = flat[lead], tt[lead], pp[lead]
                sooner = tt < first.ravel()[flat]
                first.ravel()[flat[sooner]] = tt[sooner]
                name.ravel()[flat[sooner]] = pp[sooner]
            low, level = low + rate, level + 1
        full = np.isfinite(first).all(1)
        out[np.array(todo)[full]] = name[full]
        todo = [i for i, ok in zip(todo, full) if not ok]
        stretch *= 2
    return out


def sign(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, same (16 bytes of the text's hash, null for null), bands array<long> (null without words), brief (half a byte a register, then the size of the multiset)."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in small(batches, 250, 2 << 20):
            texts = batch.column(1).to_pylist()
            bags = [shingles(t) for t in texts]
            sig = signatures(bags)
            named = np.zeros((len(texts), BANDS), np.uint64)
            for k in range(DEPTH):
                named = _mix(named * _MULT + sig[:, k::DEPTH][:, :BANDS] + np.arange(1, BANDS + 1, dtype=np.uint64) * _GOLD)
            empty = [not t or t.isspace() for t in texts]
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * BANDS, pa.int32()), pa.array(named.view(np.int64).ravel()), mask=pa.array(empty))
            half = (sig >> np.uint64(32) & np.uint64(15)).astype(np.uint8)  # the low bits of a point are its register's number
            size = np.array([b[1].sum() for b in bags], "<u4").view(np.uint8).reshape(-1, 4)
            brief = np.concatenate([half[:, 0::2] << 4 | half[:, 1::2], size], 1)
            same = [None if t is None else hashlib.md5(t.encode("utf-8", "surrogatepass")).digest() for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(same, pa.binary()), bands, pa.array([b.tobytes() for b in brief], pa.binary())], ["key", "same", "bands", "brief"])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, same binary, bands array<long>, brief binary")


def _signs(briefs) -> tuple[np.ndarray, np.ndarray]:
    """A byte a register, and the sizes, from a column of briefs."""
    b = np.frombuffer(b"".join(briefs.to_pylist()), np.uint8).reshape(len(briefs), REGISTERS // 2 + 4)
    half = b[:, :-4]
    return np.stack([half >> 4, half & 15], 2).reshape(len(b), -1), b[:, -4:].copy().view("<u4").ravel().astype(np.float64)


def _likely(regs: np.ndarray, sizes: np.ndarray, i_regs: np.ndarray, i_size: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rows that may be near duplicates of one, and all rows' equal registers.

    Sizes that differ by more than the similarity allows rule a pair out for certain.
    """
    equal = (regs == i_regs).sum(1)
    fits = np.minimum(sizes, i_size) >= ENOUGH * np.maximum(sizes, i_size)
    return np.flatnonzero((equal >= LIKELY * REGISTERS) & fits), equal


def _pair_batch(found: list[tuple], opened: list[int]) -> pa.RecordBatch:
    pairs = sorted({(a, b) if a < b else (b, a) for a, b in found})
    opened = sorted(set(opened))
    none = [None] * len(opened)
    cols = [[p[0] for p in pairs] + none, [p[1] for p in pairs] + none, [None] * len(pairs) + opened]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["a", "b", "open"])


_PROPOSED = "a long, b long, open long"


def _band_rows(texts: DataFrame, *more: str) -> DataFrame:
    return texts.filter("bands is not null").select(F.explode("bands").alias("band"), "tid", "brief", *more)


def proposals(texts: DataFrame) -> DataFrame:
    """a, b: pairs of `tid` that agree in a band and are alike by signature; or open: a band with likely pairs left."""
    # by value and signature: a bucket of any size is spread, with like texts side by side
    rows = _band_rows(texts).repartitionByRange("band", "brief", "tid").sortWithinPartitions("band", "brief", "tid")

    def run(batches):
        band, ids, regs, sizes = None, np.zeros(0, np.int64), np.zeros((0, REGISTERS), np.uint8), np.zeros(0)
        found, opened = [], []
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            bands, tids, briefs = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
            cuts = np.flatnonzero(np.r_[True, bands[1:] != bands[:-1]])
            ends = np.r_[cuts[1:], n]
            if band is None:
                opened.append(int(bands[0]))  # what the border of a task cuts
            work = np.flatnonzero(ends - cuts > 1)
            # the first run may go on from the batch before, the last one into the next
            for k in dict.fromkeys([0, *work.tolist(), len(cuts) - 1]):
                s, e = int(cuts[k]), int(ends[k])
                if bands[s] != band:
                    band, ids, regs, sizes = bands[s], ids[:0], regs[:0], sizes[:0]
                for at in range(s, e, WINDOW):
                    stop = min(e, at + WINDOW)
                    if len(ids) > WINDOW // 2:
                        # half a window of the rows before stays, so that like neighbours are not cut apart
                        ids, regs, sizes = ids[-WINDOW // 2 :], regs[-WINDOW // 2 :], sizes[-WINDOW // 2 :]
                        opened.append(int(band))
                    old = len(ids)
                    more, own = _signs(briefs.slice(at, stop - at))
                    ids, regs, sizes = np.r_[ids, tids[at:stop]], np.concatenate([regs, more]), np.r_[sizes, own]
                    for i in range(max(1, old), len(ids)):
                        likely, equal = _likely(regs[:i], sizes[:i], regs[i], sizes[i])
                        if len(likely) > 2:
                            # the earliest one connects what is alike at large, the likeliest one what is nearest
                            likely = {likely[0], likely[equal[likely].argmax()]}
                            opened.append(int(band))
                        found += [(int(ids[j]), int(ids[i])) for j in likely]
            if len(found) > 10_000:
                yield _pair_batch(found, opened)
                found, opened = [], []
        if band is not None:
            opened.append(int(band))
        yield _pair_batch(found, opened)

    return rows.mapInArrow(run, _PROPOSED).distinct()


def bag_bytes(text: str | None) -> bytes:
    """A text's multiset as a sorted set of 6-byte hashes, of a shingle and the number of its occurrence.

    Intersection and union of such sets have the sizes of those of the multisets. Two of the 48-bit hashes
    meet by chance in one of a million pairs of texts of 10,000 words, and then count for one shingle.
    """
    h, n = shingles(text)
    often = n > 1
    if often.any():
        turn = np.arange(n.sum(), dtype=np.uint64) - np.repeat(np.cumsum(n) - n, n).astype(np.uint64)
        h = np.repeat(h, n)
        h = np.where(turn > 0, _mix(h + turn * _GOLD), h)
    return np.unique(h >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def similarity(a: bytes, b: bytes) -> float:
    """Weighted Jaccard of two bags of bag_bytes()."""
    both = []
    for x in (a, b):
        wide = np.zeros((len(x) // 6, 8), np.uint8)
        wide[:, :6] = np.frombuffer(x, np.uint8).reshape(-1, 6)
        both.append(wide.view("<u8").ravel())
    union = np.concatenate(both)
    union.sort()
    shared = int((union[1:] == union[:-1]).sum())
    return shared / max(1, len(union) - shared)


def _places(n: int) -> tuple[int, Column]:
    """Bits of a Bloom filter of n 16-byte ids, a power of two near 16 an id, and an id's four places: pieces of it."""
    bits = 1 << min(28, max(16, (16 * n - 1).bit_length()))
    piece = lambda i: F.conv(F.hex(F.substring("same", 4 * i + 1, 4)), 16, 10).cast("long").bitwiseAND(F.lit(bits - 1))
    return bits, F.array(*[piece(i) for i in range(4)])


def bloom(ids: DataFrame, n: int) -> np.ndarray:
    """64-bit words of the filter. They are made by an aggregation: the driver gets a row a word that has a bit, 4 million at most."""
    bits, places = _places(n)
    words = ids.select(F.explode(places).alias("at")).groupBy(F.expr("at div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("set")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[words["word"].to_numpy()] = words["set"].to_numpy()
    return out.view(np.uint64)


def _maybe(words: np.ndarray, same: pa.Array) -> np.ndarray:
    """Whether all places of each id are set."""
    raw = np.frombuffer(b"".join(same.to_pylist()), ">u4").reshape(-1, 4).astype(np.int64)
    at = raw & (64 * len(words) - 1)
    return ((words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).all(1)


def bags(ids: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """tid, bag of the texts in `ids` (tid, same).

    Only their bags are shuffled, one row a text and task: up to FILTERED texts a Bloom filter of a bounded
    size keeps the others out where they lie; beyond, the bags of all texts are shuffled once.
    """
    n = ids.count()
    rows = docs.select(F.unhex(F.md5(F.col(text).cast("binary"))).alias("same"), F.col(text).alias("text")).filter("same is not null")
    words = docs.sparkSession.sparkContext.broadcast(bloom(ids, n)) if n <= FILTERED else None

    def run(batches):
        # filter and bags in one step: a second Python step in a task would be a second process
        for batch in small(batches):
            if words is not None:
                batch = batch.filter(pa.array(_maybe(words.value, batch.column(0))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bag_bytes(t) for t in batch.column(1).to_pylist()], pa.binary())], ["same", "bag"])

    once = rows.mapInArrow(run, "same binary, bag binary").groupBy("same").agg(F.first("bag").alias("bag"))
    return durable(once.join(ids, "same").select("tid", "bag"))


def verified(pairs: DataFrame, known: DataFrame, enough: float = ENOUGH) -> DataFrame:
    """a, b of the pairs whose multisets overlap enough, by the bags in `known`."""
    side = lambda s: known.select(F.col("tid").alias(s), F.col("bag").alias(f"bag_{s}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "bag_a", "bag_b")

    def run(batches):
        for batch in small(batches, 2000):
            ok = [similarity(x, y) >= enough for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def _meetings(rows: DataFrame, cols: list[str], size: int) -> DataFrame:
    """band, block, turn, asks and `cols`: in each band of several classes, the texts outside the largest one (asks) next to all of the band, `size` on either side.

    `rows` have band, tid and root, and are a written table.
    """
    per = rows.groupBy("band", "root").agg(F.count("*").alias("n"))
    split = per.groupBy("band").agg(F.count("*").alias("roots"), F.max_by("root", "n").alias("largest"), F.sum("n").alias("n"), F.max("n").alias("most")).filter("roots > 1")
    blocks = lambda n: F.greatest(F.ceil(n / size), F.lit(1)).cast("int")
    split = durable(split.select("band", "largest", blocks(F.col("n")).alias("blocks"), blocks(F.col("n") - F.col("most")).alias("turns")))
    # a row a band: broadcast up to a bound, so that the rows of a large band stay where they are
    left = rows.join(F.broadcast(split) if split.count() <= SPLIT else split, "band")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("tid"), F.col(n)).cast("int")
    members = left.select("band", own("blocks").alias("block"), every("turns").alias("turn"), F.lit(False).alias("asks"), *cols)
    askers = left.filter(F.col("root") != F.col("largest")).select("band", every("blocks").alias("block"), own("turns").alias("turn"), F.lit(True).alias("asks"), *cols)
    return members.unionByName(askers)


def _cross_pairs(table: pa.Table):
    """Row numbers i and j, of each asking text and its likely partners in other classes of which this is the first band that both share, the likeliest first."""
    asks, root = table["asks"].to_numpy(), table["root"].to_numpy()
    regs, sizes = _signs(table["brief"])
    bands = table["bands"].combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
    here, them = table["band"][0].as_py(), np.flatnonzero(~asks)
    for i in np.flatnonzero(asks):
        likely, equal = _likely(regs[them], sizes[them], regs[i], sizes[i])
        likely = likely[root[them[likely]] != root[i]]
        if len(likely):
            shared = bands[them[likely]] == bands[i]
            likely = likely[bands[i][shared.argmax(1)] == here]
            yield i, them[likely[np.argsort(-equal[likely], kind="stable")]]


def further_links(rows: DataFrame, classed: DataFrame, known: DataFrame, enough: float = ENOUGH) -> DataFrame:
    """a, b: near duplicates across classes in the open bands, whose `rows` are (band, tid, brief, bands).

    `classed` has tid and root of the texts in classes so far. A first step, by signatures alone, finds
    the texts that have a likely partner in another class; these meet again with their multisets.
    A pair is looked at in the first band that both share, so that none is verified twice.
    """
    rows = durable(rows.join(classed, "tid", "left").select("band", "tid", "brief", "bands", F.coalesce("root", "tid").alias("root")))

    def find(table: pa.Table) -> pa.Table:
        found = [np.r_[i, j] for i, j in _cross_pairs(table) if len(j)]
        tid = np.unique(table["tid"].to_numpy()[np.concatenate(found)]) if found else np.zeros(0, np.int64)
        return pa.table({"band": np.full(len(tid), table["band"][0].as_py(), np.int64), "tid": tid})

    cols = ["tid", "root", "brief", "bands"]
    restless = durable(_meetings(rows, cols, BLOCK).groupBy("band", "block", "turn").applyInArrow(find, "band long, tid long").distinct())
    rows = durable(rows.join(restless, ["band", "tid"]))
    bags = durable(known.join(rows.select("tid").distinct(), "tid"))

    def compare(table: pa.Table) -> pa.Table:
        tid, root, bag, a, b = table["tid"].to_numpy(), table["root"].to_numpy().copy(), table["bag"], [], []
        for i, partners in _cross_pairs(table):
            for j in partners:
                if root[j] != root[i] and similarity(bag[int(i)].as_py(), bag[int(j)].as_py()) >= enough:
                    a.append(int(tid[i]))
                    b.append(int(tid[j]))
                    root[root == root[i]] = root[j]  # what the block has joined needs no more pairs
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    met = _meetings(rows, cols, BAGS).join(bags, "tid").groupBy("band", "block", "turn")
    return durable(met.applyInArrow(compare, "a long, b long").distinct())


def _mark(edges: DataFrame) -> tuple:
    h = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count("*"), F.sum(h.cast("decimal(38,0)")), F.bit_xor(h)).first())


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node that edges connect it to.

    Each round hangs every node's larger neighbours on the smallest one (large star), then every
    node's smaller neighbours (small star); rounds grow with the logarithm of a chain's length.
    The minima are written before they are joined, so that both sides of the join are plain
    exchanges, of which Spark splits a large partition: a node may have any number of edges.
    """
    edges = durable(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = _mark(edges)
    while True:
        around = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = durable(around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        large = around.join(low, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = durable(large.distinct())
        low = durable(large.groupBy("a").agg(F.min("b").alias("m")))
        hung = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        edges = durable(hung.filter(F.col("a") != F.col("b")).distinct())
        before, mark = mark, _mark(edges)
        if mark == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def joined_classes(roots: DataFrame, links: DataFrame) -> DataFrame:
    """node, root with further links: only the roots at their ends, and texts without one, make up the graph to connect."""
    at = lambda s: roots.select(F.col("node").alias(s), F.col("root").alias(f"root_{s}"))
    ends = links.join(at("a"), "a", "left").join(at("b"), "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    new = components(ends.filter("a != b"))
    moved = roots.join(new.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return durable(moved.unionByName(new.join(roots, "node", "left_anti")))


def classes(docs: DataFrame, key: str, text: str, enough: float = ENOUGH) -> DataFrame:
    """key, class_id (the smallest key of its class), same: one row a row of `docs`."""
    with scratch(docs.sparkSession):
        signed = durable(sign(docs, key, text), lasting=True)
        one = F.first(F.struct("bands", "brief")).alias("s")
        texts = signed.filter("same is not null").groupBy("same").agg(F.min("key").alias("first"), one)
        texts = durable(texts.select(F.monotonically_increasing_id().alias("tid"), "same", "first", "s.bands", "s.brief"))
        found = durable(proposals(texts))
        pairs = found.filter("open is null").select("a", "b")
        opened = found.filter("open is not null").select(F.col("open").alias("band"))
        rows = durable(_band_rows(texts, "bands").join(opened, "band"))
        ids = pairs.select(F.explode(F.array("a", "b")).alias("tid")).union(rows.select("tid")).distinct()
        known = bags(durable(texts.select("tid", "same").join(ids, "tid")), docs, text)
        roots = components(verified(pairs, known, enough))
        more = further_links(rows, roots.select(F.col("node").alias("tid"), "root"), known, enough)
        if more.limit(1).count():
            roots = joined_classes(roots, more)
        # a large class has many texts of one root: its join is one of plain exchanges, too
        in_class = texts.select("tid", "same", "first").join(roots.withColumnRenamed("node", "tid"), "tid", "left")
        in_class = durable(in_class.select("same", "first", F.coalesce("root", "tid").alias("root")))
        smallest = durable(in_class.groupBy("root").agg(F.min("first").alias("class_id")))
        named = durable(in_class.join(smallest, "root").select("same", "class_id"), lasting=True)
    return signed.select("key", "same").join(named, "same", "left").select("key", F.coalesce("class_id", "key").alias("class_id"), "same")
