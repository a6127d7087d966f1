"""Drift gates: a position is passed on when it has moved far enough from the last one passed on."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window


def passed(xs, ys, threshold: float, last: tuple[float, float] | None = None) -> tuple[list[int], tuple[float, float] | None]:
    """Places that pass the gate (Chebyshev distance over the threshold; the first always), and the last position passed."""
    out = []
    for k, (x, y) in enumerate(zip(xs, ys, strict=True)):
        if last is None or abs(x - last[0]) > threshold or abs(y - last[1]) > threshold:
            out.append(k)
            last = (x, y)
    return out, last


def drift_gate(track: DataFrame, threshold: float, key: str = "user_id", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """Rows of a track (key, order, x, y) that pass the gate; each key is a sequence by definition."""

    def gate(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(list(order))
        return part.iloc[passed(part["x"], part["y"], threshold)[0]]

    return track.groupBy(key).applyInPandas(gate, track.schema)


def sun_gate(frames: DataFrame, key: str, order: str, threshold: float = 0.00175) -> DataFrame:
    """Frames (key, order, azimuth, elevation) whose shadow is computed anew.

    The sun is up and has moved by more than the threshold since the last such frame; the first frame with the sun up is one.
    """

    def gate(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(order)
        up = part[part["elevation"] > 0]
        return up.iloc[passed(up["azimuth"], up["elevation"], threshold)[0]]

    return frames.groupBy(key).applyInPandas(gate, frames.schema)


def tile_slides(track: DataFrame, size: float, key: str = "user_id", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """Rows where the tile differs from that of the row before."""
    w = Window.partitionBy(key).orderBy(*order)
    tiled = track.withColumns({"tx": F.floor(F.col("x") / size), "ty": F.floor(F.col("y") / size)})
    moved = tiled.withColumns({"px": F.lag("tx").over(w), "py": F.lag("ty").over(w)})
    return moved.filter((F.col("px") != F.col("tx")) | (F.col("py") != F.col("ty"))).drop("px", "py")


class Gate(StatefulProcessor):
    """The drift gate as a stream operator: the last position passed on, and a generation that may reset it.

    A row with a newer generation (after the base was swapped) always passes; one with an older
    generation is stale and dropped.
    """

    def __init__(self, threshold: float):
        self.threshold = threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("last", "x double, y double, generation long")

    def handleInputRows(self, key, rows, timerValues):
        for part in rows:
            part = part.sort_values(["ts", "event_id"])
            state = self.state.get() if self.state.exists() else None
            last, generation = ((float(state[0]), float(state[1])), int(state[2])) if state else (None, -1)
            keep = []
            for k, row in enumerate(part.itertuples(index=False)):
                g = int(getattr(row, "generation", 0))
                if g < generation:
                    continue
                if g > generation:
                    last, generation = None, g
                places, last = passed([row.x], [row.y], self.threshold, last)
                if places:
                    keep.append(k)
            if last is not None:
                self.state.update((last[0], last[1], generation))
            yield part.iloc[keep]

    def close(self) -> None:
        pass


def drift_stream(track: DataFrame, threshold: float, key: str = "user_id") -> DataFrame:
    """The gate over a streaming track; needs the RocksDB state store."""
    return track.groupBy(key).transformWithStateInPandas(statefulProcessor=Gate(threshold), outputStructType=track.schema, outputMode="append", timeMode="None")


def gated(track: DataFrame, threshold: float, folder: str, key: str = "user_id") -> DataFrame:
    """A stored track run through the gate as a stream, to its end: the rows that passed, as a table in the folder."""
    spark = track.sparkSession
    track.write.mode("overwrite").parquet(f"{folder}/in")
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(track.schema).parquet(f"{folder}/in")
        out = drift_stream(stream, threshold, key).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        out.awaitTermination()
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)
    return spark.read.schema(track.schema).parquet(f"{folder}/out")


def reload_batches(requests: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, key: str = "user_id"):
    """Runs ``work`` on the latest request of each key in every micro-batch; older ones of the batch are dropped."""

    def batch(rows: DataFrame, number: int) -> None:
        newest = rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.struct("ts", "event_id")).alias("m")).select("m.*")
        work(newest, number)

    return requests.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tumbling_rate(events: DataFrame, seconds: int = 1, time: str = "ts") -> DataFrame:
    """Rows per window of so many seconds: at, n."""
    return events.groupBy(F.window(time, f"{seconds} seconds").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("at"), "n")
