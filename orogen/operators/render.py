"""Rays from a camera to a raster, with fixed steps (relational) or adaptive ones (per block of pixels)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orogen.operators.surface import SKY, brightness, pixel


def camera(yaw: float, pitch: float, fov: float, width: int, height: int) -> tuple[tuple, tuple, tuple, float, float]:
    """Forward, right and up vectors and the tangents of half the angles of view."""
    f = (math.cos(pitch) * math.sin(yaw), -math.cos(pitch) * math.cos(yaw), math.sin(pitch))
    r = (math.cos(yaw), math.sin(yaw), 0.0)
    u = (f[1] * r[2] - f[2] * r[1], f[2] * r[0] - f[0] * r[2], f[0] * r[1] - f[1] * r[0])
    u = tuple(-x for x in u) if u[2] < 0 else u
    t = math.tan(fov / 2)
    return f, r, u, t * width / height, t


def rays(spark, width: int, height: int, view: tuple) -> DataFrame:
    """Unit directions of all pixels: px, py, ux, uy, uz."""
    f, r, u, tx, ty = view
    px, py = F.col("id") % width, F.floor(F.col("id") / width)
    x, y = (2.0 * (px + 0.5) / width - 1.0) * tx, (1.0 - 2.0 * (py + 0.5) / height) * ty
    d = [f[k] + r[k] * x + u[k] * y for k in range(3)]
    size = F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])
    return spark.range(width * height).select(px.alias("px"), py.alias("py"), *((d[k] / size).alias(n) for k, n in enumerate(("ux", "uy", "uz"))))


#: Points along rays that may be one side of a broadcast join.
POINTS = 500_000


def first_hit(directions: DataFrame, cells: DataFrame, eye: tuple[float, float, float], rows: int, columns: int, dx: float, dy: float, step: float, steps: int, layers: tuple[str, ...] = ()) -> DataFrame:
    """First of ``steps`` points along each ray at or below the ground: px, py, k, h (null for none), and layers of its cell."""
    at = directions.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    x, y, z = (F.lit(e) + F.col(u) * (F.col("k") * step) for e, u in zip(eye, ("ux", "uy", "uz"), strict=True))
    cell = at.select("px", "py", "k", F.floor(y / dy).alias("r"), F.floor(x / dx).alias("c"), z.alias("z"))
    inside = cell.filter(F.col("r").between(0, rows - 1) & F.col("c").between(0, columns - 1))
    # the planner takes the points for as few as the rays and would send any number of them through the driver
    inside = inside if directions.count() * steps <= POINTS else inside.hint("merge")
    hit = inside.join(cells, ["r", "c"]).filter("z <= h").groupBy("px", "py").agg(F.min_by(F.struct("k", "h", *layers), "k").alias("m"))
    return directions.select("px", "py").join(hit, ["px", "py"], "left").select("px", "py", F.col("m.k").cast("long").alias("k"), F.col("m.h").alias("h"), *(F.col(f"m.{x}").alias(x) for x in layers))


def shaded_image(hits: DataFrame, step: float, sun: tuple[float, float, float], strength: float = 0.8) -> DataFrame:
    """Packed BGRA of hits that carry nx, ny, nz, lit and ao of their cells, sky where there is none: px, py, bgra.

    Occlusion darkens by ``strength`` of itself; light is rounded to six digits.
    """
    light = F.round(brightness(F.col("nx"), F.col("ny"), F.col("nz"), sun, F.col("lit"), 1.0 + (F.col("ao") - 1.0) * strength), 6)
    sky = int(SKY[2]) + int(SKY[1]) * 256 + int(SKY[0]) * 65536 + 255 * 16777216
    return hits.select("px", "py", F.coalesce(pixel(F.col("h"), light, F.col("k") * step), F.lit(sky).cast("long")).alias("bgra"))


def image(hits: DataFrame, step: float, light: float) -> DataFrame:
    """Packed BGRA of hits, sky where there is none: px, py, bgra."""
    sky = int(SKY[2]) + int(SKY[1]) * 256 + int(SKY[0]) * 65536 + 255 * 16777216
    return hits.select("px", "py", F.coalesce(pixel(F.col("h"), F.lit(light), F.col("k") * step), F.lit(sky).cast("long")).alias("bgra"))


def march(heights: np.ndarray, eye, directions: np.ndarray, dx: float, dy: float, reach: float, least: float, factor: float = 0.5, halvings: int = 10) -> np.ndarray:
    """Distances to the ground along rays (NaN: none): steps follow the clearance, then the last one is halved."""
    top = np.nanmax(heights) + 100
    out, t, before = np.full(len(directions), np.nan), np.zeros(len(directions)), np.zeros(len(directions))
    live = np.arange(len(directions))

    def ground(p):
        r, c = np.floor(p[:, 1] / dy).astype(int), np.floor(p[:, 0] / dx).astype(int)
        ok = (r >= 0) & (r < heights.shape[0]) & (c >= 0) & (c < heights.shape[1])
        return np.where(ok, heights[np.clip(r, 0, heights.shape[0] - 1), np.clip(c, 0, heights.shape[1] - 1)], np.nan), ok

    while len(live):
        p = np.asarray(eye) + directions[live] * t[live, None]
        h, ok = ground(p)
        hit = ok & (p[:, 2] <= h)
        for k in live[hit]:
            low, high = before[k], t[k]
            for _ in range(halvings):
                mid = (low + high) / 2
                q = (np.asarray(eye) + directions[k] * mid)[None]
                g, inside = ground(q)
                low, high = (low, mid) if inside[0] and q[0, 2] <= g[0] else (mid, high)
            out[k] = low
        gone = ~ok | hit | (t[live] > reach) | ((directions[live, 2] >= 0) & (p[:, 2] > top))
        before[live] = t[live]
        t[live] += np.maximum(np.where(np.isnan(h), least, p[:, 2] - h) * factor, least)
        live = live[~gone]
    return out


#: Bytes of a raster that render_adaptive() broadcasts at most.
HELD = 256 << 20


def render_adaptive(directions: DataFrame, heights: np.ndarray, eye, dx: float, dy: float, reach: float, least: float) -> DataFrame:
    """march() over blocks of pixels with a broadcast raster of at most HELD bytes: px, py, t."""
    if heights.nbytes > HELD:
        raise ValueError("the raster is too large to be held by every executor; crop it or use first_hit")
    held = directions.sparkSession.sparkContext.broadcast(heights)

    def block(parts):
        for part in parts:
            t = march(held.value, eye, part[["ux", "uy", "uz"]].to_numpy(), dx, dy, reach, least)
            yield pd.DataFrame({"px": part["px"], "py": part["py"], "t": t})

    return directions.mapInPandas(block, "px long, py long, t double")
