import numpy as np
from pyspark.sql import functions as F

from cinetide.operators import folds
from cinetide.streaming import streams


def run(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def source(spark, tmp_path, rows, schema, files=4):
    spark.createDataFrame(rows, schema).repartition(files).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_a_stream_in_any_order_equals_the_batch(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(k, i, int(rng.integers(0, 60))) for k in range(3) for i in range(40)]
    schema = "video_id int, frame_idx bigint, value bigint"
    stream = source(spark, tmp_path, [rows[i] for i in rng.permutation(len(rows))], schema)
    got = run(spark, streams.in_order(stream, ["video_id"], "frame_idx", ["value"], folds.iir(), "filtered", "bigint", most_gap=None), "iir")
    want = folds.folded(spark.createDataFrame(rows, schema), ["video_id"], ["frame_idx"], ["value"], folds.iir(), "filtered", "bigint")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_duplicates_and_gaps(spark, tmp_path):
    rows = [(0, 0, 5), (0, 1, 5), (0, 1, 9), (0, 3, 50), (0, 4, 50)]
    step = lambda state, row: ((state or 0) + row[0], (state or 0) + row[0])
    stream = source(spark, tmp_path, rows, "video_id int, frame_idx bigint, value bigint", files=1)
    kept = run(spark, streams.in_order(stream, ["video_id"], "frame_idx", ["value"], step, "total", "bigint", most_gap=None), "waits")
    assert sorted(r["frame_idx"] for r in kept.collect()) == [0, 1]
    skipped = run(spark, streams.in_order(stream, ["video_id"], "frame_idx", ["value"], step, "total", "bigint", most_gap=1), "skips")
    assert sorted(r["frame_idx"] for r in skipped.collect()) == [0, 1, 3, 4]


def test_flags_on_a_stream(spark, tmp_path):
    rows = [(0, i, v) for i, v in enumerate((0.0, 0.0, 60.0, 60.01, 61.0))]
    stream = source(spark, tmp_path, rows, "video_id int, frame_idx bigint, value double", files=1)
    step = streams.diff_step(lambda a, b: abs(a - b), 0.05, 40.0)
    got = run(spark, streams.in_order(stream, ["video_id"], "frame_idx", ["value", "frame_idx"], step, "flags", "struct<diff:double,is_dup:boolean,is_cut:boolean,root:bigint>"), "flags")
    flags = [tuple(r["flags"])[1:] for r in got.orderBy("frame_idx").collect()]
    assert flags == [(False, True, 0), (True, False, 0), (False, True, 2), (True, False, 2), (False, False, 4)]


def test_windowed_counts(spark, tmp_path):
    rows = [(0, f"2024-01-01 00:0{m}:00", m % 2 == 0) for m in range(9)]
    stream = source(spark, tmp_path, rows, "video_id int, t string, is_dup boolean").withColumn("ts", F.to_timestamp("t"))
    got = run(spark, streams.windowed_counts(stream, "ts", ["video_id"]), "counts", "complete")
    assert sorted((r["processed"], r["skipped"]) for r in got.collect()) == [(4, 2), (5, 3)]


def test_cache_sink_is_idempotent(spark, tmp_path):
    put = streams.cache_sink(str(tmp_path / "cache"))
    batch = spark.createDataFrame([("a", 1), ("b", 2), ("a", 1)], "key string, v int")
    put(batch, 0)
    put(batch, 0)
    put(spark.createDataFrame([("c", 3)], "key string, v int"), 1)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "cache")).collect())) == [("a", 1), ("b", 2), ("c", 3)]
