"""Streaming variants of the causal operators, and event-time aggregates.

State is one small row a key. Rows of a key are taken in the order of (ts, event_id) within a batch;
batches must not go back in time for a key, as in a log that is read in order.
"""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from framelake.ship import ship

EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)


def read_events(spark: SparkSession, sf_dir: str, files_a_batch: int = 64) -> DataFrame:
    """The events table as a stream; ts becomes a timestamp, which watermarks need."""
    ship(spark)
    rows = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_a_batch).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def shared_folder(spark: SparkSession) -> str:
    """A new folder under the cluster's checkpoint folder; where none is set, under the temporary one in local mode (one machine), an error elsewhere."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = os.path.join(tempfile.gettempdir(), "framelake-streams")
    return f"{top}/stream-{uuid.uuid4().hex}"


def drain(stream: DataFrame) -> DataFrame:
    """Runs a stream over all that is there into Parquet files, and returns them."""
    spark, folder = stream.sparkSession, shared_folder(stream.sparkSession)
    query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/rows").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def keep_changes(stream: DataFrame, threshold: float) -> DataFrame:
    """(key, pos, value): events that differ from the last kept one of their user by more than the threshold."""

    def step(key, batches, state):
        anchor, pos = state.get if state.exists else (None, 0)
        out = []
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for v in rows["value"]:
            if anchor is None or abs(v - anchor) > threshold:
                anchor = v
                out.append((key[0], pos, v))
            pos += 1
        state.update((anchor, pos))
        yield pd.DataFrame(out, columns=["key", "pos", "value"])

    return stream.select("user_id", "ts", "event_id", "value").groupBy("user_id").applyInPandasWithState(step, "key long, pos long, value double", "anchor double, pos long", "append", GroupStateTimeout.NoTimeout)


def hysteresis(stream: DataFrame, threshold: float, commit: int, hold: int) -> DataFrame:
    """(key, pos, value): each event with its committed value, as the batch operator gives it for series of three events or more."""

    def step(key, batches, state):
        now, cand, run, stale, pos = state.get if state.exists else (None, None, 0, 0, 0)
        out = []
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for v in rows["value"]:
            if now is None:
                now = cand = v
            else:
                stable = abs(v - now) <= threshold
                run, cand = (run + 1, cand) if abs(v - cand) <= threshold else (1, v)
                stale = 0 if stable else stale + 1
                if not stable and (run >= commit or stale >= hold):
                    now, stable = v, True
                if stable:
                    cand, run, stale = now, 0, 0
            out.append((key[0], pos, now))
            pos += 1
        state.update((now, cand, run, stale, pos))
        yield pd.DataFrame(out, columns=["key", "pos", "value"])

    return stream.select("user_id", "ts", "event_id", "value").groupBy("user_id").applyInPandasWithState(step, "key long, pos long, value double", "now double, cand double, run int, stale int, pos long", "append", GroupStateTimeout.NoTimeout)


def median3(stream: DataFrame) -> DataFrame:
    """(key, pos, value): the median of each event's value and its two neighbours', one event late.

    The newest event of a user waits in the state until the next one comes; the first counts twice.
    """

    def step(key, batches, state):
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        v = rows["value"].to_numpy(float)
        if state.exists:
            before, now, pos = state.get
        else:
            before, now, pos, v = v[0], v[0], 0, v[1:]
        x = np.concatenate([[before, now], v])
        state.update((float(x[-2]), float(x[-1]), pos + len(v)))
        yield pd.DataFrame({"key": key[0], "pos": pos + np.arange(len(v)), "value": np.median([x[:-2], x[1:-1], x[2:]], axis=0)})

    return stream.select("user_id", "ts", "event_id", "value").groupBy("user_id").applyInPandasWithState(step, "key long, pos long, value double", "before double, now double, pos long", "append", GroupStateTimeout.NoTimeout)


def band_hysteresis(stream: DataFrame, edges: list[float], margin: float) -> DataFrame:
    """(key, pos, band): a value within ``margin`` of an edge keeps the band of the event before it."""
    bounds = np.array(edges)

    def step(key, batches, state):
        band, pos = state.get if state.exists else (-1, 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        v = rows["value"].to_numpy(float)
        own = np.searchsorted(bounds, v, "right")
        sure = (np.abs(v[:, None] - bounds) >= margin).all(1)
        sure[0] |= band < 0
        last = np.maximum.accumulate(np.where(sure, np.arange(len(v)), -1))
        out = np.where(last < 0, band, own[last])
        state.update((int(out[-1]), pos + len(v)))
        yield pd.DataFrame({"key": key[0], "pos": pos + np.arange(len(v)), "band": out})

    return stream.select("user_id", "ts", "event_id", "value").groupBy("user_id").applyInPandasWithState(step, "key long, pos long, band long", "band long, pos long", "append", GroupStateTimeout.NoTimeout)


def _windows(stream: DataFrame, window, delay: str) -> DataFrame:
    agg = stream.withWatermark("ts", delay).groupBy(window.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return agg.select(F.unix_seconds("w.start").alias("start_s"), F.unix_seconds("w.end").alias("end_s"), "event_type", "n", "total")


def tumbling(stream: DataFrame, width: str, delay: str) -> DataFrame:
    """Counts and sums of event types in windows end to end; a window is emitted when the watermark passes its end."""
    return _windows(stream, F.window("ts", width), delay)


def sliding(stream: DataFrame, width: str, slide: str, delay: str) -> DataFrame:
    return _windows(stream, F.window("ts", width, slide), delay)


def sessions(stream: DataFrame, gap: str, delay: str) -> DataFrame:
    """(key, start, end, n, total) of each user's sessions."""
    agg = stream.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return agg.select(F.col("user_id").alias("key"), F.unix_seconds("w.start").alias("start_s"), F.unix_seconds("w.end").alias("end_s"), "n", "total")
