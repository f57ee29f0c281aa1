"""Streams end where their batch forms do."""

import math

import numpy as np
from pyspark.sql import functions as F

from keepsake.operators import selection
from keepsake.operators.kernels import Config
from keepsake.streaming import stateful


def _stream(spark, df, path, parts):
    """df as a stream of one file per micro batch, in order of the column part."""
    for i in range(parts):
        df.where(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(f"{path}/p{i}")
    return spark.readStream.schema(df.drop("part").schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)


def test_hawkes_state(spark, tmp_path):
    rows = [("a", 0.0, 0), ("a", 1.0, 0), ("b", 5.0, 0), ("a", 30.0, 1), ("b", 2.0, 1), ("a", 31.0, 1)]
    df = spark.createDataFrame(rows, "key string, day double, part int")
    stream = _stream(spark, df, str(tmp_path / "in"), 2)
    got = {r.key: r for r in stateful.run_to_end(stateful.hawkes_state(stream), str(tmp_path / "ck"), str(tmp_path / "out"), "key").collect()}
    for key in "ab":
        days = [d for k, d, _ in rows if k == key]
        assert got[key].n == len(days) and got[key].last == max(days)
        assert math.isclose(got[key].decayed, sum(math.exp(-0.1 * (max(days) - d)) for d in days), rel_tol=1e-9)


def test_selection_in_a_stream_is_its_replay(spark, tmp_path):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(24, 8)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = [("m", f"{i:02d}", float(i), v[i].tolist(), 10, 1.0, i // 8) for i in range(24)]
    df = spark.createDataFrame(rows, "memory string, id string, at double, vec array<float>, cost int, weight double, part int")
    config = Config(60, write="all", evict="fifo")
    stream = _stream(spark, df, str(tmp_path / "in"), 3)
    admitted = stateful.run_to_end(stateful.select_state(stream, config, 8), str(tmp_path / "ck"), str(tmp_path / "out"), "id")
    assert admitted.where("admitted").count() == 24
    kept = {r.id for r in selection.replay(df.drop("part"), config).collect()}
    assert kept == {f"{i:02d}" for i in range(18, 24)}
    survivors = selection.fifo_survivors(df.select("memory", F.col("id").alias("seq"), "cost"), 60)
    assert {r.seq for r in survivors.collect()} == kept


def test_windows_drop_late_events(spark, tmp_path):
    rows = [(f"2024-01-0{d} 0{h}:30:00", "x", p) for d, h, p in ((1, 1, 0), (1, 2, 0), (3, 1, 1), (3, 2, 2), (1, 3, 3))]
    df = spark.createDataFrame(rows, "t string, event_type string, part int").select(F.to_timestamp("t").alias("ts"), "event_type", "part")
    q = stateful.windows(_stream(spark, df, str(tmp_path / "in"), 4)).writeStream.outputMode("append").trigger(availableNow=True).format("memory").queryName("late").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination()
    assert [r.n for r in spark.sql("SELECT n FROM late ORDER BY window").collect()][0] == 2
