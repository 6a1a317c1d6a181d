"""Streaming forms of counting and run grouping.

Counts by time are windows with a watermark: state is dropped once late rows cannot come. Runs
are kept per source: its last key and the number of its run are all the state. Rows of a source
are ordered within a batch by a sequence column; a row that comes in a later batch with a smaller
number than one already seen is late, and is marked so instead of changing past runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_counts(stream: DataFrame, time: str, code: Column, width: str, late: str) -> DataFrame:
    """window_start, code, n; a window is final once the watermark has passed it."""
    seen = stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), code.alias("code")).agg(F.count("*").alias("n"))
    return seen.select(F.col("w.start").alias("window_start"), "code", "n")


def distinct_records(stream: DataFrame, time: str, keys: list[str], late: str) -> DataFrame:
    """Rows, repeated ones once, as far as they come within the watermark of each other."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def enriched(stream: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """A stream with the columns of a static table."""
    return stream.join(table, key, "left")


def run_groups(stream: DataFrame, source: str, sequence: str, key: str) -> DataFrame:
    """source, sequence, key, group_ord, late: a key that is not the one before opens a run, also if it comes again."""
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    out = f"{source} {kinds[source]}, {sequence} long, {key} string, group_ord long, late boolean"

    def step(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, group, top = state.get if state.exists else (None, -1, -(1 << 62))
        rows = pd.concat(list(batches)).sort_values([sequence, key], kind="stable")
        late = (rows[sequence] < top).to_numpy()
        keys, groups = rows[key].tolist(), []
        for k, is_late in zip(keys, late):
            if is_late:
                groups.append(-1)
                continue
            if group < 0 or k != last:
                group, last = group + 1, k
            groups.append(group)
        state.update((last, group, max(top, int(rows[sequence].max()))))
        yield pd.DataFrame({source: name[0], sequence: rows[sequence].to_numpy(), key: keys, "group_ord": groups, "late": late})

    narrow = stream.select(source, F.col(sequence).cast("long").alias(sequence), F.col(key).cast("string").alias(key))
    return narrow.groupBy(source).applyInPandasWithState(step, out, "last string, grp long, top long", "append", GroupStateTimeout.NoTimeout)
