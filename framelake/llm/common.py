"""Shared pieces of the training-data operators.

Nothing here (or in this subpackage) is imported by the rest of the library.
"""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.ship import ship


HOT, SALTS = 1000, 32
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def prepare(spark: SparkSession) -> None:
    """Sends the package to the workers, and bounds Arrow batches by 8 MB instead of 64 (a value of the user's own stays)."""
    ship(spark)
    if spark.conf.get(BATCH_BYTES).rstrip("b") == str(64 << 20):
        spark.conf.set(BATCH_BYTES, str(8 << 20))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table by name; the path is opened by Spark's reader only."""
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_crc(col: str | Column) -> Column:
    """crc32 of an id written as text (unsigned, as a long)."""
    return F.crc32((F.col(col) if isinstance(col, str) else col).cast("string").cast("binary"))


def bounded_sample(df: DataFrame, key: str, bound: int) -> DataFrame:
    """About ``bound`` rows of ``df``, chosen by a hash of ``key``; all rows if there are fewer.

    The choice depends on the key alone, so it is the same after a lost executor and for any
    partitioning. Rows with a null key never enter.
    """
    df = df.where(F.col(key).isNotNull())
    n = df.count()
    if n <= bound:
        return df
    span = 1 << 40
    return df.where(F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("sample")), F.lit(span)) < int(bound / n * span))


def sample_texts(rows: DataFrame, labels: DataFrame, most_rows: int, most_bytes: int):
    """(_id, _text, _y) of a bounded sample of the labelled rows, by id, as an Arrow table on the driver.

    ``rows`` (_id, _text) and ``labels`` (_id, _y). Texts are whole; where ``most_rows`` of them have
    more than ``most_bytes``, the number of rows is cut in that proportion.
    """
    lab = bounded_sample(labels, "_id", most_rows)
    joined = rows.join(F.broadcast(lab), "_id").select("_id", "_text", "_y")
    n, size = joined.agg(F.count(F.lit(1)), F.sum(F.octet_length("_text"))).first()
    if (size or 0) > most_bytes:
        joined = rows.join(F.broadcast(bounded_sample(labels, "_id", max(1, min(most_rows, lab.count()) * most_bytes // size))), "_id").select("_id", "_text", "_y")
    return joined.toArrow().sort_by([("_id", "ascending")])


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: the cluster's ``spark.checkpoint.dir``; where that is unset, one of our own in local mode (one machine), an error elsewhere."""
    sc = spark.sparkContext
    held = sc._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = os.path.join(tempfile.gettempdir(), f"framelake-checkpoints-{uuid.uuid4().hex[:8]}")
    sc.setCheckpointDir(where)
    return where


def join_hot(rows: DataFrame, table: DataFrame, key: str, weight: str, total: int, spread: str, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``table`` (one row a ``key``), where a key may hold a large part of ``rows``.

    ``weight`` is a key's number of rows and ``total`` a bound of their sum, so at most ``HOT`` keys
    can have a ``HOT``-th of all or more. These are listed (their number is bounded, whatever the
    size), and the rows of each are dealt to ``SALTS`` tasks by ``spread``, with a copy of its one row.
    """
    cols = [c for c in table.columns if c != key]
    table = cut(table)
    hot = [r[0] for r in table.where(F.col(weight) * HOT >= max(HOT, total)).select(key).collect()]
    if not hot:
        return rows.join(table, key, how).select(*rows.columns, *cols)
    salt = lambda yes: F.when(F.col(key).isin(hot), yes).otherwise(0)
    spot = F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")
    every = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), salt(SALTS - 1))))
    return rows.withColumn("_salt", salt(spot)).join(every, [key, "_salt"], how).select(*rows.columns, *cols)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder that Spark has written, wherever it is."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def filter_rows(docs: DataFrame, run) -> DataFrame:
    """``docs.mapInArrow`` of a function that keeps some rows as they are; columns may have any name."""
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def few_parts(rows: int, row_bytes: int = 64) -> int:
    """Partitions of about 32 MB for a table of so many small rows, 12 at least."""
    return max(12, -(-rows * row_bytes // (32 << 20)))


def cut(df: DataFrame, parts: int | None = None) -> DataFrame:
    """Cuts lineage with an eager checkpoint in the shared folder, in at most ``parts`` partitions.

    Shuffle files that only the cut plan needed are then garbage of the driver; collecting it lets
    Spark's cleaner remove them from the executors now, not at its periodic run half an hour later.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    out = (df.coalesce(parts) if parts else df).checkpoint(eager=True)
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return out


def add_counters(parts: DataFrame) -> DataFrame:
    """(slot, counts) with the sums of rows (slot int, counts binary of int64) by slot.

    Used for tables of fixed size that each task counts in memory: what is shuffled is a fixed
    number of bytes a task, and each slot is summed by itself.
    """
    import numpy as np
    import pyarrow as pa

    def run(table):
        total = None
        for raw in table["counts"].to_pylist():
            x = np.frombuffer(raw, np.int64)
            total = x.copy() if total is None else total + x
        return pa.table({"slot": pa.array([table["slot"][0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    return parts.groupBy("slot").applyInArrow(run, "slot int, counts binary")
