"""Generated drawings, sampled curves, settings."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings and their defaults.
SETTINGS = {"snap_tolerance_mm": 5.0, "min_segment_length_mm": 1.0, "min_wall_area_mm2": 50.0}


def settings(spark: SparkSession, own: dict[str, float] | None = None) -> DataFrame:
    """name, value of every setting; given values replace defaults."""
    return spark.createDataFrame(sorted({**SETTINGS, **(own or {})}.items()), "name string, value double")


def arc(cx: Column, cy: Column, r: Column, start: Column, end: Column, parts: int) -> Column:
    """Points (k, x, y) along an arc given in degrees, ends included."""
    def point(k: Column) -> Column:
        a = F.radians(start + (end - start) * k / parts)
        return F.struct(k.alias("k"), (cx + r * F.cos(a)).alias("x"), (cy + r * F.sin(a)).alias("y"))
    return F.transform(F.sequence(F.lit(0), F.lit(parts)), point)


def arc_parts(sweep: float, whole: int = 48, least: int = 8) -> int:
    """How many chords stand for an arc of so many degrees."""
    return max(least, math.ceil(whole * abs(sweep) / 360))


def reference_set(spark: SparkSession, n: int, width: float = 12_000.0, height: float = 8_000.0) -> DataFrame:
    """drawing, k, x0, y0, x1, y1: n rectangles with one to three dividers, moved by their number."""
    d = spark.range(n).select(F.col("id").alias("drawing"), (F.col("id") % 3 + 1).cast("int").alias("rooms"))
    ox = F.col("drawing") * F.lit(width * 2)
    wall = lambda k, x0, y0, x1, y1: F.struct(F.lit(k).alias("k"), (F.lit(x0) + ox).alias("x0"), F.lit(y0).alias("y0"), (F.lit(x1) + ox).alias("x1"), F.lit(y1).alias("y1"))
    outer = F.array(wall(0, 0.0, 0.0, width, 0.0), wall(1, width, 0.0, width, height), wall(2, width, height, 0.0, height), wall(3, 0.0, height, 0.0, 0.0))
    def divider(i: Column) -> Column:
        x = F.lit(width) * i / (F.col("rooms") + 1) + ox
        return F.struct((i + 3).alias("k"), x.alias("x0"), F.lit(0.0).alias("y0"), x.alias("x1"), F.lit(height).alias("y1"))
    inner = F.transform(F.sequence(F.lit(1), F.col("rooms")), divider)
    return d.select("drawing", F.explode(F.concat(outer, inner)).alias("w")).select("drawing", "w.*")


def synthetic(spark: SparkSession, n: int, seed: int = 1) -> DataFrame:
    """kind, x0, y0, x1, y1: three fifths lines, a fifth tiny ones, a fifth of no length; seeded."""
    r = spark.range(n).select("id", *[F.rand(seed + i).alias(f"r{i}") for i in range(4)])
    kind = F.when(F.col("id") % 5 < 3, "line").when(F.col("id") % 5 == 3, "tiny").otherwise("point")
    size = F.when(kind == "line", 1000.0).when(kind == "tiny", 0.5).otherwise(0.0)
    x, y = F.col("r0") * 1e5, F.col("r1") * 1e5
    return r.select(kind.alias("kind"), x.alias("x0"), y.alias("y0"), (x + F.col("r2") * size).alias("x1"), (y + F.col("r3") * size).alias("y1"))
