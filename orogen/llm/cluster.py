"""Shared folder, intermediate tables, merged counters and sizes that are checked before a broadcast."""

from __future__ import annotations

import atexit
import contextlib
import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only by a local master whose session names no folder, as in tests.
OWN_FOLDER = "/tmp/checkpoints"
#: Parts of a sketch, and tasks whose parts are added in one step.
CHUNKS, FAN = 64, 64

_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; executors and the driver share it.

    Without that setting a local master uses ``OWN_FOLDER``; any other one is refused.
    """
    named, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if not named and master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (named or f"file://{OWN_FOLDER}").rstrip("/")


def _folder(spark: SparkSession) -> str:
    """This application's folder of intermediate tables; deleted when the driver's Python ends."""
    app = spark.sparkContext.applicationId
    if app not in _folders:
        _folders[app] = f"{shared_folder(spark)}/orogen/{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(_remove, spark, _folders[app])
    return _folders[app]


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: the rows as a table in the shared folder, which outlives any executor."""
    spark = df.sparkSession
    path = f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Deletes tables made by written() that no later plan reads."""
    for df in tables:
        for path in {os.path.dirname(x) for x in df.inputFiles()}:
            _remove(df.sparkSession, path)


def small(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """A broadcast hint if a count of the (written) table stays below the bound; else a shuffled join follows."""
    return F.broadcast(df) if df.count() <= rows else df


def sketch(rows: DataFrame, keys: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int) -> np.ndarray:
    """How many of the 64-bit keys that ``keys`` yields for the batches of rows fall on each of 2^bits counters.

    A counter is named by the leading bits of its keys.  Each task sends its counters in chunks, which are added
    in two steps of which the first takes FAN tasks, so that no task gathers the counters of all others.  The driver
    gets 2^bits numbers whatever the input.
    """
    size = (1 << bits) // CHUNKS

    def count(batches):
        total = np.zeros(1 << bits, np.int64)
        for batch in batches:
            for h in keys(batch):
                total += np.bincount((h >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
        kind = np.min_scalar_type(int(total.max()))  # as few bytes a counter as will do
        some = [k for k in range(CHUNKS) if total[k * size : (k + 1) * size].any()]
        if some:
            part = np.full(len(some), TaskContext.get().partitionId() // FAN)
            parts = [total[k * size : (k + 1) * size].astype(kind).tobytes() for k in some]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(part, pa.int32()), pa.array(parts, pa.binary())], ["chunk", "part", "counts"])

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(size, np.uint64)
        for x in group["counts"]:
            total += np.frombuffer(x.as_buffer(), f"u{len(x.as_buffer()) // size}")
        return pa.table([group["chunk"][:1], group["part"][:1], pa.array([total.tobytes()], pa.binary())], ["chunk", "part", "counts"])

    schema = "chunk int, part int, counts binary"
    found = rows.mapInArrow(count, schema).groupBy("chunk", "part").applyInArrow(add, schema).groupBy("chunk").applyInArrow(add, schema)
    out = np.zeros(1 << bits)
    for r in found.collect():
        out[r["chunk"] * size : (r["chunk"] + 1) * size] = np.frombuffer(r["counts"], np.uint64)
    return out
