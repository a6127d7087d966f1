"""Rasters and views derived from plain tables: cells(r, c, h) and friends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense raster: a row for each vector, a column for each component; height in metres, 3 decimals."""
    cells = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("r"), F.posexplode("embedding").alias("c", "x"))
    return cells.select("r", F.col("c").cast("long").alias("c"), F.round(1500.0 + 1000.0 * F.col("x").cast("double"), 3).alias("h"))


def raster_with_voids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same raster with about 42 % of its cells null."""
    void = ((F.col("r") * 7 + F.col("c") * 13) % 11 < 3) | ((F.floor(F.col("r") / 10) + F.floor(F.col("c") / 10)) % 5 == 0)
    return raster(spark, sf_dir).withColumn("h", F.when(~void, F.col("h")))


def track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Camera positions per user in time order: user_id, ts, event_id, x, y (running sums)."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    events = table(spark, sf_dir, "events").withColumn("cents", F.round(F.col("value") * 100).cast("long"))
    return events.select("user_id", "ts", "event_id", (F.sum("cents").over(w) / 100.0).alias("x"), F.sum(F.col("event_id") % 97).over(w).cast("double").alias("y"))


def tile_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names of 50 km tiles."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("k"))
    return part.select("k", F.concat(F.lit("CRS3035RES50000mN"), (F.floor(F.col("k") / 40) * 50000).cast("string"), F.lit("E"), (F.col("k") % 40 * 50000).cast("string"), F.lit(".tif")).alias("path"))


#: The views in DuckDB SQL.
V1 = "v1 AS (SELECT CAST(vec_id AS BIGINT) AS r, CAST(i - 1 AS BIGINT) AS c, round(1500.0 + 1000.0 * CAST(embedding[i] AS DOUBLE), 3) AS h FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))"
V2 = V1 + ", v2 AS (SELECT r, c, CASE WHEN (r * 7 + c * 13) % 11 < 3 OR (r // 10 + c // 10) % 5 = 0 THEN NULL ELSE h END AS h FROM v1)"
TRACK = "track AS (SELECT user_id, ts, event_id, CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER w AS BIGINT) / CAST(100 AS DOUBLE) AS x, CAST(sum(event_id % 97) OVER w AS DOUBLE) AS y FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"
TILES = "tiles AS (SELECT CAST(p_partkey AS BIGINT) AS k, 'CRS3035RES50000mN' || CAST(p_partkey // 40 * 50000 AS VARCHAR) || 'E' || CAST(p_partkey % 40 * 50000 AS VARCHAR) || '.tif' AS path FROM part)"
