"""Table scans and deterministic frame-shaped views.

A pixel table ``px`` has (run_id, frame, y, x, r, g, b); a mask adds ``a``; a series has one value a
step and key. Views are projections and one generator, so filters and columns reach the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framelake.ship import ship

SIDE = 8
CELLS = SIDE * SIDE
FRAMES = 20
PIXEL = ["run_id", "frame", "y", "x"]
RGB = ["r", "g", "b"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _channel(v: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(255), F.floor((v.cast("double") + 0.5) * 255))).cast("int")


def px(spark: SparkSession, sf_dir: str, alpha: bool = False) -> DataFrame:
    """The embeddings as 8 x 8 frames, 20 a run; with ``alpha`` also a 0/1 matte."""
    e = F.col("embedding")
    at = lambda i, d: F.element_at(e, (i + d) % CELLS + 1)
    cell = lambda v, i: F.struct(
        F.floor(i / SIDE).cast("int").alias("y"),
        (i % SIDE).cast("int").alias("x"),
        _channel(v).alias("r"),
        _channel(at(i, 21)).alias("g"),
        _channel(at(i, 42)).alias("b"),
        *([F.when(v.cast("double") > -0.02, 1.0).otherwise(0.0).alias("a")] if alpha else []),
    )
    ids = F.floor(F.col("vec_id") / FRAMES).cast("int").alias("run_id"), (F.col("vec_id") % FRAMES).cast("int").alias("frame")
    return table(spark, sf_dir, "embeddings").select(*ids, F.inline(F.transform(e, cell)))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as one series a user: (key, pos, value, state)."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), (F.row_number().over(w) - 1).alias("pos"), "value", F.col("event_type").alias("state"))
