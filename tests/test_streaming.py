"""Streaming forms, fed with files batch by batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandframe.streaming import runs


def feed(spark, tmp_path, frames, schema, build, mode="append"):
    src, name = tmp_path / "in", f"t_{tmp_path.name.replace('-', '_')}"
    src.mkdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    for i, rows in enumerate(frames):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"b{i}"))
        for f in (tmp_path / f"b{i}").glob("*.parquet"):
            f.rename(src / f"{i}-{f.name}")
    q = build(stream).writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    try:
        q.processAllAvailable()
        return spark.table(name).collect()
    finally:
        q.stop()


def test_runs_across_batches(spark, tmp_path):
    frames = [[("f", 0, "a"), ("f", 1, "a"), ("g", 0, "x")], [("f", 2, "a"), ("f", 3, "b"), ("f", 4, "a"), ("f", 0, "z")], [("g", 1, "y")]]
    got = feed(spark, tmp_path, frames, "file string, n long, k string", lambda s: runs.run_groups(s, "file", "n", "k"))
    seen = {(r.file, r.n, r.k): (r.group_ord, r.late) for r in got}
    assert seen == {("f", 0, "a"): (0, False), ("f", 1, "a"): (0, False), ("f", 2, "a"): (0, False), ("f", 3, "b"): (1, False), ("f", 4, "a"): (2, False), ("f", 0, "z"): (-1, True), ("g", 0, "x"): (0, False), ("g", 1, "y"): (1, False)}


def test_windowed_counts(spark, tmp_path):
    frames = [[("2020-01-01 00:00:01", "a"), ("2020-01-01 00:00:02", "a"), ("2020-01-01 00:00:11", "b")], [("2020-01-01 00:10:00", "c")], [("2020-01-01 00:20:00", "d")]]
    make = lambda s: runs.windowed_counts(s.withColumn("t", F.col("ts").cast("timestamp")), "t", F.col("code"), "10 seconds", "30 seconds")
    got = feed(spark, tmp_path, frames, "ts string, code string", make)
    assert {(str(r.window_start), r.code, r.n) for r in got} >= {("2020-01-01 00:00:00", "a", 2), ("2020-01-01 00:00:10", "b", 1)}


def test_distinct_and_enriched(spark, tmp_path):
    frames = [[("2020-01-01 00:00:01", "a"), ("2020-01-01 00:00:01", "a")], [("2020-01-01 00:00:02", "a"), ("2020-01-01 00:00:03", "b")]]
    names = spark.createDataFrame([("a", "A")], "code string, name string")
    make = lambda s: runs.enriched(runs.distinct_records(s.withColumn("t", F.col("ts").cast("timestamp")), "t", ["code"], "1 hour"), names, "code")
    got = feed(spark, tmp_path, frames, "ts string, code string", make)
    assert sorted((r.code, r.name) for r in got) == [("a", "A"), ("b", None)]
