"""Surface layers: normals, shading, tints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def normals(cells: DataFrame, dx: float, dy: float) -> DataFrame:
    """Unit normals by central differences: r, c, h, nx, ny, nz; zero on the border and beside voids."""
    line, column = Window.partitionBy("r").orderBy("c"), Window.partitionBy("c").orderBy("r")
    near = cells.select("r", "c", "h", F.lag("h").over(line).alias("left"), F.lead("h").over(line).alias("right"), F.lag("h").over(column).alias("upper"), F.lead("h").over(column).alias("lower"))
    a, b = (F.col("left") - F.col("right")) / (2 * dx), (F.col("upper") - F.col("lower")) / (2 * dy)
    size = F.sqrt(a * a + b * b + 1.0)
    return near.select("r", "c", "h", *(F.coalesce(x / size, F.lit(0.0)).alias(n) for x, n in ((a, "nx"), (b, "ny"), (F.lit(1.0), "nz"))))


def brightness(nx: Column, ny: Column, nz: Column, sun: tuple[float, float, float], lit: Column | float = 1.0, ao: Column | float = 1.0) -> Column:
    """Ambient 0.15 (times occlusion) and diffuse light, halved in full shadow."""
    lit, ao = (x if isinstance(x, Column) else F.lit(float(x)) for x in (lit, ao))
    diffuse = F.greatest(F.lit(0.0), nx * sun[0] + ny * sun[1] + nz * sun[2])
    return (0.15 * ao + (1.0 - 0.15) * diffuse) * (0.5 + 0.5 * lit)


def smoothstep(a: float, b: float, x: Column) -> Column:
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - a) / (b - a)))
    return t * t * (3.0 - 2.0 * t)


#: Colours of the tint (red, green, blue) and the heights where each gives way to the next.
TINTS = ((120.0, 160.0, 80.0), (160.0, 175.0, 130.0), (200.0, 200.0, 195.0), (240.0, 245.0, 250.0))
STEPS = ((1800.0, 2000.0), (2000.0, 2200.0), (2600.0, 2800.0))
SKY = (135.0, 206.0, 235.0)


def tint(h: Column) -> list[Column]:
    """Red, green and blue of a height."""
    out = [F.lit(x) for x in TINTS[0]]
    for colour, (a, b) in zip(TINTS[1:], STEPS, strict=True):
        t = smoothstep(a, b, h)
        out = [x + (F.lit(y) - x) * t for x, y in zip(out, colour, strict=True)]
    return out


def pixel(h: Column, light: Column, distance: Column) -> Column:
    """Packed BGRA of a lit height behind fog that thickens from 15 to 60 km."""
    fog = smoothstep(15000.0, 60000.0, distance)
    shaded = [F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), x * light))) for x in tint(h)]
    r, g, b = (F.floor(x + (F.lit(s) - x) * fog).cast("long") for x, s in zip(shaded, SKY, strict=True))
    return b + g * 256 + r * 65536 + F.lit(255 * 16777216).cast("long")
