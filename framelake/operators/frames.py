"""Filters and coordinate projections over pixel tables: decimation, picks, crops, scaling, order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RGB = ("r", "g", "b")


def decimate(px: DataFrame, every: int, offset: int = 0) -> DataFrame:
    """Every n-th frame from ``offset``, numbered anew."""
    f = F.col("frame") - offset
    return px.where((f >= 0) & (f % every == 0)).withColumn("frame", F.floor((F.col("frame") - offset) / every).cast("int"))


def frame_counts(px: DataFrame, run: str = "run_id") -> DataFrame:
    """(run, last, n): one row a run, by partial aggregation."""
    return px.groupBy(run).agg(F.max("frame").alias("last"), (F.max("frame") + 1).alias("n"))


def pick(px: DataFrame, index: int, run: str = "run_id") -> DataFrame:
    """One frame of each run; an index past the end is the last."""
    return px.join(frame_counts(px, run).select(run, "last"), run).where(F.col("frame") == F.least(F.lit(index), F.col("last"))).drop("last")


def thin(px: DataFrame, most: int, run: str = "run_id") -> DataFrame:
    """At most ``most`` frames of each run, evenly spread, ends included; half steps go to the even frame."""
    n = frame_counts(px, run)
    at = F.when(F.col("n") <= most, F.sequence(F.lit(0), F.col("n") - 1)).otherwise(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.rint(i * (F.col("n") - 1) / F.lit(max(most - 1, 1))).cast("int")))
    return px.join(n.select(run, F.explode(F.array_distinct(at)).alias("frame")), [run, "frame"], "left_semi")


def crop(px: DataFrame, x: int, y: int, w: int, h: int, width: int, height: int) -> DataFrame:
    """A rectangle, clamped to the frame; coordinates start at 0 again."""
    x0, y0 = min(max(x, 0), width - 1), min(max(y, 0), height - 1)
    x1, y1 = min(max(x + w, x0 + 1), width), min(max(y + h, y0 + 1), height)
    inside = (F.col("x") >= x0) & (F.col("x") < x1) & (F.col("y") >= y0) & (F.col("y") < y1)
    return px.where(inside).withColumns({"x": F.col("x") - x0, "y": F.col("y") - y0})


def snap_crop(px: DataFrame, size: int, ox: int, oy: int, width: int, height: int) -> DataFrame:
    """The largest area of whole cells from the offset."""
    return crop(px, ox, oy, size * ((width - ox) // size), size * ((height - oy) // size), width, height)


def cap(px: DataFrame, most: int) -> DataFrame:
    """The first frames only: the cap is the feature."""
    return px.where(F.col("frame") < most)


def upscale(px: DataFrame, k: int) -> DataFrame:
    """Nearest-neighbour enlargement: each pixel makes k * k."""
    side = F.sequence(F.lit(0), F.lit(k - 1))
    rows = px.withColumn("_i", F.explode(side)).withColumn("_j", F.explode(side))
    return rows.withColumns({"y": F.col("y") * k + F.col("_i"), "x": F.col("x") * k + F.col("_j")}).drop("_i", "_j")


def shrink_premultiplied(px: DataFrame, k: int, keys: tuple[str, ...] = ("run_id", "frame")) -> DataFrame:
    """Area mean of colour times alpha over alpha; cells with alpha of one half or less are empty."""
    cell = px.groupBy(*keys, F.floor(F.col("y") / k).cast("int").alias("y"), F.floor(F.col("x") / k).cast("int").alias("x"))
    mean = cell.agg(F.avg("a").alias("am"), *[F.avg(F.col(c) * F.col("a")).alias(f"{c}m") for c in RGB])
    solid = F.col("am") > 0.5
    return mean.select(*keys, "y", "x", *[F.when(solid, F.col(f"{c}m") / F.greatest(F.col("am"), F.lit(1e-3))).otherwise(0.0).alias(c) for c in RGB], solid.cast("int").alias("a"))


def pingpong(px: DataFrame, run: str = "run_id") -> DataFrame:
    """The frames and, backwards, those between the ends: 2 n - 2 in all; runs of under three frames stay."""
    n = frame_counts(px, run).select(run, "n")
    back = px.join(n, run).where((F.col("n") >= 3) & (F.col("frame") > 0) & (F.col("frame") < F.col("n") - 1))
    return px.unionByName(back.withColumn("frame", 2 * F.col("n") - 2 - F.col("frame")).select(*px.columns))


def numbered(df: DataFrame, by: list[str], order: list, name: str) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)
