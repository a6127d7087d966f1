"""Settings, timings and footprints beside the data."""

from __future__ import annotations

import functools
import os
import time
import tomllib
from collections.abc import Callable
from dataclasses import asdict, dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Settings:
    """What a viewer remembers; any field that is missing or broken in a file has its default."""

    skip_launcher: bool = False
    vsync: bool = False
    shadows_enabled: bool = True
    fog_enabled: bool = True
    vat_mode: int = 1
    lod_mode: int = 0
    ao_mode: int = 3
    tiles_refinement: bool = True
    tile_5m_path: str = ""
    tiles_1m_dir: str = ""
    selected_view: str = "None"

    @classmethod
    def load(cls, path: str) -> Settings:
        try:
            with open(path, "rb") as file:
                found = tomllib.load(file)
        except (OSError, ValueError):
            return cls()
        return cls(**{f.name: found[f.name] for f in fields(cls) if type(found.get(f.name)) is type(f.default)})

    def save(self, path: str) -> None:
        quote = lambda v: str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else '"' + v.replace("\\", "\\\\").replace('"', '\\"') + '"'
        with open(f"{path}.part", "w") as file:
            file.writelines(f"{k} = {quote(v)}\n" for k, v in asdict(self).items())
        os.replace(f"{path}.part", path)


def timed(label: str, say: Callable[[str], None] = print):
    """Wraps a function to print its label and nanoseconds, and seconds."""

    def wrap(f):
        @functools.wraps(f)
        def run(*args, **more):
            began = time.perf_counter_ns()
            try:
                return f(*args, **more)
            finally:
                took = time.perf_counter_ns() - began
                say(f"{label},{took}")
                say(f"{label}: {took / 1e9:.3f} s")

        return run

    return wrap


def placemarks(spark: SparkSession, path: str) -> DataFrame:
    """Placemarks of KML files: name, style, points (x, y of the outline)."""
    schema = "name string, styleUrl string, Polygon struct<outerBoundaryIs struct<LinearRing struct<coordinates string>>>"
    rows = spark.read.format("xml").option("rowTag", "Placemark").schema(schema).load(path)
    pairs = F.filter(F.split(F.trim("Polygon.outerBoundaryIs.LinearRing.coordinates"), r"\s+"), lambda x: F.contains(x, F.lit(",")))
    points = F.transform(pairs, lambda p: F.struct(F.split(p, ",")[0].cast("double").alias("x"), F.split(p, ",")[1].cast("double").alias("y")))
    return rows.select("name", F.col("styleUrl").alias("style"), points.alias("points"))
