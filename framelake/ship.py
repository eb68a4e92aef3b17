"""Sends the package to the executors, as ``--py-files`` would, once a Spark context."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_NAME = "framelake_package.zip"


def ship(spark: SparkSession) -> None:
    """Workers can import this package afterwards, wherever the driver found it."""
    sc = spark.sparkContext
    if any(str(x).endswith(_NAME) for x in getattr(sc, "_python_includes", ())):
        return
    top = Path(__file__).resolve().parent
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, f"{top.name}/{p.relative_to(top)}")
    path = os.path.join(tempfile.mkdtemp(prefix="framelake-"), _NAME)
    Path(path).write_bytes(raw.getvalue())
    sc.addPyFile(path)
