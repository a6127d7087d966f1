"""Tile catalogs and file manifests as relational plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orogen.functions.geo import tile_corner, tile_path

#: Side of a tile in metres.
SIDE = 50_000


def overlapping(tiles: DataFrame, squares: DataFrame, side: int = SIDE) -> DataFrame:
    """Tiles whose square overlaps a query square (id, e, n, radius), borders not included: id, path.

    Both sides are keyed by grid cells of one tile side, so that the plan is an equi-join; a square
    of radius r spans about (2 r / side + 2)^2 of them.
    """
    n, e = tile_corner(F.col("path"))
    named = tiles.select("path", n.alias("tn"), e.alias("te")).filter(F.col("tn").isNotNull() & F.col("te").isNotNull())
    named = named.withColumns({"gn": F.floor(F.col("tn") / side), "ge": F.floor(F.col("te") / side)})
    low, high = (lambda x: F.floor((F.col(x) - F.col("radius")) / side) - 1), (lambda x: F.floor((F.col(x) + F.col("radius")) / side) + 1)
    keyed = squares.withColumn("gn", F.explode(F.sequence(low("n"), high("n")))).withColumn("ge", F.explode(F.sequence(low("e"), high("e"))))
    meet = (F.col("tn") < F.col("n") + F.col("radius")) & (F.col("tn") + side > F.col("n") - F.col("radius")) & (F.col("te") < F.col("e") + F.col("radius")) & (F.col("te") + side > F.col("e") - F.col("radius"))
    return keyed.join(named, ["gn", "ge"]).filter(meet).select("id", "path")


def manifest(spark: SparkSession, latitude: int, longitude: int, reach: int = 2, extra: tuple[str, ...] = ()) -> DataFrame:
    """Paths to fetch around a tile, and further fixed files."""
    n = 2 * reach + 1
    square = spark.range(n * n).select((F.floor(F.col("id") / n) + (latitude - reach)).cast("int").alias("lat"), (F.col("id") % n + (longitude - reach)).cast("int").alias("lon"))
    paths = square.select(tile_path(F.col("lat"), F.col("lon")).alias("path"))
    return paths.unionByName(spark.createDataFrame([(p,) for p in extra], "path string")) if extra else paths


def classify(files: DataFrame, local: DataFrame) -> DataFrame:
    """State of each file (path, remote) against local sizes: complete, resume or restart, and bytes still to fetch."""
    joined = files.join(local, "path", "left").withColumn("local", F.coalesce("local", F.lit(0).cast("long")))
    state = F.when((F.col("local") == F.col("remote")) & (F.col("remote") > 0), "complete").when((F.col("local") > 0) & (F.col("local") < F.col("remote")), "resume").otherwise("restart")
    return joined.withColumn("state", state).withColumn("rest", F.when(F.col("state") == "resume", F.col("remote") - F.col("local")).when(F.col("state") == "restart", F.col("remote")).otherwise(F.lit(0).cast("long")))


def missing(files: DataFrame, local: DataFrame) -> DataFrame:
    return files.join(local, "path", "left_anti")


def progress(chunks: DataFrame, session: str = "session", order: str = "seq", size: str = "bytes") -> DataFrame:
    """Running bytes of each session."""
    w = Window.partitionBy(session).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return chunks.withColumn("done", F.sum(size).over(w))


def longest_mount(paths: DataFrame, mounts: DataFrame) -> DataFrame:
    """Per path the mount point with the longest prefix of it: path, mount, free.

    A path is exploded into its own prefixes, so the plan is an equi-join.
    """
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.concat_ws("/", F.slice(parts, 1, k)))
    keyed = paths.select("path", F.explode(prefixes).alias("mount")).withColumn("mount", F.when(F.col("mount") == "", "/").otherwise(F.col("mount")))
    return keyed.join(mounts, "mount").groupBy("path").agg(F.max_by(F.struct("mount", "free"), F.length("mount")).alias("m")).select("path", "m.mount", "m.free")


def latest(messages: DataFrame, key: str, order: list[str], value: list[str]) -> DataFrame:
    """The latest message per key."""
    return messages.groupBy(key).agg(F.max_by(F.struct(*value), F.struct(*order)).alias("m")).select(key, "m.*")
