"""Stateful streams: decayed intensity by key, and selection by memory with the batch kernel."""

from __future__ import annotations

import math
import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.hawkes import BETA
from ..operators.kernels import Config, Entry, Selector
from ..session import shared_dir


def hawkes_state(events: DataFrame, beta: float = BETA) -> DataFrame:
    """events: key, day (a stream). (key, n, last, decayed) after each batch, in constant state a key.

    An event that comes late is decayed to the state's time instead of moving it back.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, last, a = state.get if state.exists else (0, -math.inf, 0.0)
        for pdf in frames:
            for day in np.sort(pdf["day"].to_numpy()):
                if day >= last:
                    a = a * math.exp(-beta * (day - last)) + 1 if n else 1.0
                    last = float(day)
                else:
                    a += math.exp(-beta * (last - day))
                n += 1
        state.update((n, last, a))
        yield pd.DataFrame({"key": [key[0]], "n": [n], "last": [last], "decayed": [a]})

    out = f"key {events.schema['key'].dataType.simpleString()}, n long, last double, decayed double"
    return events.groupBy("key").applyInPandasWithState(step, out, "n long, last double, decayed double", "update", GroupStateTimeout.NoTimeout)


def select_state(entries: DataFrame, config: Config, dim: int) -> DataFrame:
    """entries: memory, id, at, vec, cost, weight (a stream, in order within a memory). (memory, id, admitted).

    The state is the batch kernel's own, so a stream of a memory's entries ends where its replay does.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        selector = pickle.loads(state.get[0]) if state.exists else Selector(config, dim)
        rows = pd.concat(list(frames)).sort_values(["at", "id"], kind="stable")
        taken = [selector.offer(Entry(str(r.id), np.asarray(r.vec, np.float32), int(r.cost), float(r.weight), float(r.at))) for r in rows.itertuples(index=False)]
        state.update((pickle.dumps(selector),))
        yield pd.DataFrame({"memory": [key[0]] * len(rows), "id": rows["id"].astype(str), "admitted": taken})

    out = f"memory {entries.schema['memory'].dataType.simpleString()}, id string, admitted boolean"
    return entries.groupBy("memory").applyInPandasWithState(step, out, "selector binary", "update", GroupStateTimeout.NoTimeout)


def windows(events: DataFrame, late: str = "1 hour", size: str = "6 hours") -> DataFrame:
    """Counts by event-time window and type; events later than the watermark are dropped.

    What drops is the watermark that the batches before have set, and with several stateful operators in a stream
    each has it one batch later: surely dropped is what comes two batches after the one that made it late.
    """
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"))


def run_to_end(stream: DataFrame, checkpoint: str, path: str, key: str) -> DataFrame:
    """Runs a stream in update mode over what is there now; the last row of each key."""

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number:09d}")

    q = stream.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(put).start()
    q.awaitTermination()
    rows = stream.sparkSession.read.parquet(path)
    columns = [c for c in stream.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), "_batch").alias("r")).select(key, "r.*")


def run_hawkes(spark: SparkSession, path: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(path).schema
    source, name = path.rsplit("/", 1)
    stream = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(source) if not _is_folder(spark, path) else spark.readStream.schema(schema).parquet(path)
    days = stream.select(F.col("user_id").alias("key"), (F.unix_micros(F.col("ts").cast("timestamp")) / 86400000000.0).alias("day"))
    out = run_to_end(hawkes_state(days), f"{folder}/state", f"{folder}/out", "key")
    return out.select("key", "n", F.round("last", 6).alias("last"), F.round("decayed", 6).alias("decayed"))


def _is_folder(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory())
