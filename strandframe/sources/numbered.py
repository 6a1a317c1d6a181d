"""Text lines with their places in the file, read in splits and without a shuffle.

Spark reads each split in order and says where it begins. One aggregation counts, for every
split, its lines and those that begin with given letters; prefix sums over that table, of one row
a split, give each split's start. A second pass numbers the lines of a split as they come and adds
the start. So a file of any size is numbered by as many tasks as it has splits.

Empty files give no rows. Several files are numbered each by itself, or, with `whole`, as the
parts of one file in the order of their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Splits up to which the table of their starts is broadcast (some 100 bytes a split); joined by a shuffle beyond.
BROADCAST_SPLITS = 500_000


def _scan(spark: SparkSession, path: str | list[str], whole: bool) -> DataFrame:
    name = path if isinstance(path, str) else ",".join(path)
    file = F.lit(name) if whole else F.col("_metadata.file_path")
    return spark.read.text(path).select("value", file.alias("file"), F.col("_metadata.file_path").alias("part"), F.col("_metadata.file_block_start").alias("split"))


def numbered(spark: SparkSession, path: str | list[str], counters: dict[str, str] | None = None, sticky: str = "", whole: bool = False) -> DataFrame:
    """file, part, split, line_no (from 0), value, a column a counter and a sticky letter.

    `counters` names counts of the lines, up to and with this one, that begin with one of some
    letters. `sticky` letters each give `last_<letter>`: the last line so far that begins with it.
    """
    counters = counters or {}
    rows = _scan(spark, path, whole)
    begins = lambda letters: F.substring("value", 1, 1).isin(*letters)
    marked = rows.withColumn("at", F.monotonically_increasing_id())
    per = marked.groupBy("file", "part", "split").agg(
        F.count("*").alias("n_line_no"),
        *[F.count_if(begins(c)).alias(f"n_{k}") for k, c in counters.items()],
        *[F.max_by("value", F.when(begins(c), F.col("at"))).alias(f"l_{c}") for c in sticky],
    )
    before = Window.partitionBy("file").orderBy("part", "split").rowsBetween(Window.unboundedPreceding, -1)
    starts = per.select(
        "part",
        "split",
        *[F.coalesce(F.sum(f"n_{k}").over(before), F.lit(0)).alias(f"b_{k}") for k in ("line_no", *counters)],
        *[F.last(f"l_{c}", True).over(before).alias(f"b_{c}") for c in sticky],
    )
    if starts.count() <= BROADCAST_SPLITS:
        starts = F.broadcast(starts)
    names, letters = ["line_no", *counters], [None, *counters.values()]

    def run(batches):
        seen, count, last = None, {}, {}
        for batch in batches:
            value, part, split = batch.column(0), batch.column(2), batch.column(3).to_numpy()
            n = batch.num_rows
            if not n:
                continue
            first = pc.fill_null(pc.binary_slice(value.cast(pa.binary()), 0, 1), b"")
            encoded = part.dictionary_encode()
            which = encoded.indices.to_numpy()
            cuts = np.flatnonzero(np.r_[True, (split[1:] != split[:-1]) | (which[1:] != which[:-1])])
            made: dict[str, list] = {k: [] for k in names}
            kept: dict[str, list] = {c: [] for c in sticky}
            for s, e in zip(cuts, np.r_[cuts[1:], n]):
                here = (encoded.dictionary[int(which[s])].as_py(), int(split[s]))
                if here != seen:
                    seen, count, last = here, dict.fromkeys(names, 0), dict.fromkeys(sticky)
                own = first.slice(s, e - s)
                for k, c in zip(names, letters):
                    hit = np.ones(e - s, np.int64) if c is None else pc.is_in(own, value_set=pa.array([x.encode() for x in c], pa.binary())).to_numpy(zero_copy_only=False).astype(np.int64)
                    up = count[k] + np.cumsum(hit)
                    made[k].append(up)
                    count[k] = int(up[-1])
                for c in sticky:
                    hit = pc.equal(own, c.encode()).to_numpy(zero_copy_only=False)
                    at = np.maximum.accumulate(np.where(hit, np.arange(e - s), -1))
                    got = pc.take(value.slice(s, e - s), pa.array(np.maximum(at, 0))).to_pylist()
                    kept[c] += [v if i >= 0 else last[c] for v, i in zip(got, at)]
                    last[c] = kept[c][-1]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(4)], *[pa.array(np.concatenate(made[k])) for k in names], *[pa.array(kept[c], pa.string()) for c in sticky]], ["value", "file", "part", "split", *names, *[f"s_{c}" for c in sticky]])

    schema = "value string, file string, part string, split long" + "".join(f", {k} long" for k in names) + "".join(f", s_{c} string" for c in sticky)
    local = rows.mapInArrow(run, schema)
    out = local.join(starts, ["part", "split"])
    return out.select(
        "file",
        "part",
        "split",
        (F.col("b_line_no") + F.col("line_no") - 1).alias("line_no"),
        "value",
        *[(F.col(f"b_{k}") + F.col(k)).alias(k) for k in counters],
        *[F.coalesce(f"s_{c}", f"b_{c}").alias(f"last_{c}") for c in sticky],
    )


def assembled(lines: DataFrame, size: int) -> DataFrame:
    """file, record, parts array<string>: every `size` lines of a file as one row.

    Records within a split are put together where they lie. Of those that a border cuts, the
    pieces - fewer than `size` lines at either end - meet in a small aggregation.
    """

    def run(batches):
        file, left = None, pa.table({"line_no": pa.array([], pa.int64()), "value": pa.array([], pa.string())})
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.column(0).dictionary_encode()
            which, at = names.indices.to_numpy(), batch.column(1).to_numpy()
            # a new file or split begins where the numbers do not go on
            cuts = np.flatnonzero(np.r_[True, (which[1:] != which[:-1]) | (at[1:] != at[:-1] + 1)])
            for s, e in zip(cuts, np.r_[cuts[1:], batch.num_rows]):
                name, piece = names.dictionary[int(which[s])].as_py(), pa.table({"line_no": batch.column(1).slice(s, e - s), "value": batch.column(2).slice(s, e - s)})
                if left.num_rows and (name != file or left["line_no"][-1].as_py() + 1 != at[s]):
                    yield from rest(file, left)
                    left = left.slice(0, 0)
                file, left = name, pa.concat_tables([left, piece]).combine_chunks()
                n = left["line_no"].to_numpy()
                head = int(-n[0] % size)
                if head and head <= len(n):
                    yield from rest(file, left.slice(0, head))
                    left = left.slice(head)
                elif head:
                    continue
                whole = left.num_rows // size
                if whole:
                    flat = left["value"].slice(0, whole * size).combine_chunks()
                    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
                    parts = pa.ListArray.from_arrays(pa.array(np.arange(whole + 1) * size, pa.int32()), flat)
                    record = pa.array(left["line_no"].to_numpy()[: whole * size : size] // size)
                    zero = pa.array(np.zeros(whole, np.int32))
                    yield pa.RecordBatch.from_arrays([pa.array([file] * whole, pa.string()), record, zero, parts], ["file", "record", "at", "parts"])
                    left = left.slice(whole * size)
        yield from rest(file, left)

    def rest(file, piece):
        if piece.num_rows:
            n = piece["line_no"].to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array([file] * len(n), pa.string()), pa.array(n // size), pa.array((n % size).astype(np.int32) + 1), pa.array([[v] for v in piece["value"].to_pylist()], pa.list_(pa.string()))], ["file", "record", "at", "parts"])

    made = lines.select("file", "line_no", "value").mapInArrow(run, "file string, record long, at int, parts array<string>")
    cut = made.filter("at > 0").groupBy("file", "record").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "parts"))), lambda x: x["parts"][0]).alias("parts"))
    return made.filter("at = 0").select("file", "record", "parts").unionByName(cut)
