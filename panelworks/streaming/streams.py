"""Structured Streaming operators on readings (ts, key, value), with late-data bounds; replay runs them on stored files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelworks.sources.files import scratch

READINGS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def readings(spark: SparkSession, path: str, delay: str = "10 minutes", files: int = 1000) -> DataFrame:
    """A file stream of readings, `files` at a time, watermarked on ts (UTC). The source lists folders, so the last part of path filters names."""
    folder, _, name = path.rpartition("/")
    return spark.readStream.schema(READINGS).option("pathGlobFilter", name).option("maxFilesPerTrigger", files).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def replay(stream: DataFrame, tag: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all files that are there, into Parquet in the shared folder, and reads the result."""
    spark = stream.sparkSession
    path = scratch(spark, tag)
    run = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def slot_sums(stream: DataFrame, key: str, size: str = "5 minutes", slide: str | None = None) -> DataFrame:
    """Count and mean of each key in tumbling or sliding windows."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = stream.groupBy(w.alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n", "mean")


def activity(stream: DataFrame, key: str, gap: str) -> DataFrame:
    """Sessions of activity of each key."""
    out = stream.groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("peak"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n", "peak")


def causal_join(origins: DataFrame, history: DataFrame, key: str, within: str) -> DataFrame:
    """Readings at or before an origin and not older than `within`; both sides carry watermarks."""
    a = origins.select(F.col(key).alias("_k"), F.col("ts").alias("origin"), F.col("event_id").alias("origin_id"))
    b = history.select(key, "ts", "event_id", "value")
    return a.join(b, F.expr(f"_k = {key} and ts <= origin and ts >= origin - interval {within}")).select("origin_id", "event_id", key, "value")


def once(stream: DataFrame, keys: list[str]) -> DataFrame:
    """The first arrival of each key within the watermark's delay."""
    return stream.dropDuplicatesWithinWatermark(keys)


#: What a fold sees of a key's next readings: times in microseconds, ids and values, in order.
Fold = Callable[[tuple, np.ndarray, np.ndarray, np.ndarray], tuple[dict, tuple]]


def _in_event_order(stream: DataFrame, key: str, fold: Fold, out: str, memory: str) -> DataFrame:
    """The rows that `fold` makes of each key's readings, in order of (ts, event_id) whatever the order of arrival.

    A reading waits in the key's state until the watermark has passed it, so what is said does not depend on how files fall
    into batches; readings later than the watermark are dropped, those after the last watermark wait on. The state holds
    the readings of the watermark's delay and the fold's memory, as bytes: 24 a reading. A timer at the earliest waiting
    reading wakes quiet keys.
    """
    kinds = [np.int64, np.int64, np.float64]

    def run(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        before = state.get if state.exists else (b"", b"", b"", *([None] * len(memory.split(","))))
        waiting, memo = [[np.frombuffer(x, kind)] for x, kind in zip(before[:3], kinds, strict=True)], tuple(before[3:])
        if not state.hasTimedOut:
            for frame in frames:
                for own, c, kind in zip(waiting, ("_t", "event_id", "value"), kinds, strict=True):
                    own.append(frame[c].to_numpy(kind, copy=True))
        t, ids, values = (np.concatenate(own) for own in waiting)
        waiting.clear()
        passed = t // 1000 < state.getCurrentWatermarkMs()
        later = ~passed
        rows = {}
        if passed.any():
            order = np.flatnonzero(passed)
            order = order[np.lexsort([ids[order], t[order]])]
            rows, memo = fold(memo, t[order], ids[order], values[order])
        if later.any():
            first = int(t[later].min() // 1000)
            state.update((t[later].tobytes(), ids[later].tobytes(), values[later].tobytes(), *memo))
            state.setTimeoutTimestamp(first)
        elif any(x is not None for x in memo):
            state.update((b"", b"", b"", *memo))
        elif state.exists:
            state.remove()
        if rows and len(rows["event_id"]):
            yield pd.DataFrame({key: [k[0]] * len(rows["event_id"]), **rows})

    kind = stream.schema[key].dataType.simpleString()
    held = "_times binary, _ids binary, _values binary, " + memory
    timed = stream.withColumn("_t", F.unix_micros("ts"))
    return timed.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, event_id long, {out}", held, "append", "EventTimeTimeout")


def last_valid(stream: DataFrame, key: str, cut: float, keep: float | None = None) -> DataFrame:
    """For each reading the last value at or over `cut` before it in event time, and its age in seconds; NULL if there is none or
    it is older than `keep` seconds."""

    def fold(memo: tuple, t: np.ndarray, ids: np.ndarray, values: np.ndarray) -> tuple[dict, tuple]:
        # the remembered value stands first; at[k] is the last valid place before reading k
        times, held = np.append(-1 if memo[0] is None else memo[0], t), np.append(np.nan if memo[1] is None else memo[1], values)
        valid = np.append(memo[0] is not None, values >= cut)
        at = np.maximum.accumulate(np.where(valid, np.arange(len(valid)), -1))
        seen = at[:-1]
        age = (t - times[seen]) / 1e6
        known = (seen >= 0) & (True if keep is None else age <= keep)
        rows = {"event_id": ids, "last_value": np.where(known, held[seen], np.nan), "age": np.where(known, age, np.nan)}  # NaN is NULL in a frame
        return rows, ((int(times[at[-1]]), float(held[at[-1]])) if at[-1] >= 0 else (None, None))

    return _in_event_order(stream, key, fold, "last_value double, age double", "at long, value double")


def spaced_triggers(stream: DataFrame, key: str, cut: float, spacing: float) -> DataFrame:
    """Readings at or over `cut` that come `spacing` seconds or more after the last accepted one of their key, in event time.

    Readings under the cut move the watermark, but do not wait.
    """

    def fold(memo: tuple, t: np.ndarray, ids: np.ndarray, values: np.ndarray) -> tuple[dict, tuple]:
        over = np.flatnonzero(values >= cut)
        times, last, taken = t[over], memo[0], []
        k = 0 if last is None else int(np.searchsorted(times, last + spacing * 1e6))
        while k < len(times):  # one step for each accepted reading
            taken.append(over[k])
            last = int(times[k])
            k = int(np.searchsorted(times, last + spacing * 1e6))
        return {"event_id": ids[taken], "value": values[taken]}, (last,)

    # one condition on ts and value, so that it stays behind the watermark
    over = stream.filter(F.when(F.col("ts").isNotNull(), F.col("value") >= cut))
    return _in_event_order(over, key, fold, "value double", "last long")
