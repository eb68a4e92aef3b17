"""Cutting lineage between the stages of long compositions."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame


def settle(df: DataFrame) -> DataFrame:
    """Writes a stage to the shared checkpoint folder (``spark.checkpoint.dir``; where that is unset, a temporary one in local mode and an error elsewhere) and reads it from there.

    Stages that join a table with what was worked out from it would otherwise repeat all earlier stages in each branch.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(where or os.path.join(tempfile.gettempdir(), f"framelake-{uuid.uuid4().hex[:8]}"))
    return df.checkpoint(eager=True)
