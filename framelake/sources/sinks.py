"""Sinks: frames, manifests, sheets and previews as files of Spark's own writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.functions import color as C
from framelake.operators import frames as fr
from framelake.operators import texts as X


def assemble_rgba(px: DataFrame) -> DataFrame:
    """Adds one struct of whole channels, alpha from 0 to 255."""
    return px.withColumn("rgba", F.struct(*[F.col(c).cast("int").alias(c) for c in ("r", "g", "b")], C.to_byte(F.col("a")).alias("a")))


def write_frames(px: DataFrame, path: str) -> None:
    """Frames as Parquet, a folder a run: a run's frames are read without the others."""
    px.repartition("run_id").sortWithinPartitions("frame", "y", "x").write.mode("overwrite").partitionBy("run_id").parquet(path)


def write_manifests(frames: DataFrame, path: str, fps: float, tag: str, width: int, height: int) -> None:
    """One JSON line a run."""
    X.manifests(frames, fps, tag, width, height).select(F.col("json").alias("value")).write.mode("overwrite").text(path)


def read_manifests(spark, path: str) -> DataFrame:
    """(run_id, tag, fps, file, duration_s), a run numbered by its line's place in name order of files."""
    lines = spark.read.text(path).withColumn("run_id", F.monotonically_increasing_id())
    return X.read_manifests(lines, "value")


def preview(px: DataFrame, most: int) -> DataFrame:
    """At most ``most`` evenly spread frames a run: the cap is the feature."""
    return fr.thin(px, most)


def free_name(names: DataFrame, base: str, column: str = "name") -> str:
    """The first free ``base_00001_`` of a listing: the first gap, not the end."""
    pattern = rf"^{base}_(\d{{5}})_"
    used = names.select(F.regexp_extract(column, pattern, 1).alias("n")).where("n != ''").select(F.col("n").cast("int").alias("n")).distinct()
    # n + 1 is free if no name has it; 1 is if none has 1
    after = used.select((F.col("n") + 1).alias("n")).unionByName(names.sparkSession.range(1).select(F.lit(1).alias("n")))
    return f"{base}_{after.join(used, 'n', 'left_anti').agg(F.min('n')).first()[0]:05d}_"
