"""Sharding along a Hilbert curve, in DataFrame functions only.

Metadata dimensions are quantised to ``2 ** bits`` steps each (numbers by a logarithmic scale, other
values by checksum), the cell's index on the Hilbert curve orders the rows, and equal runs of that
order are cut into shards: each shard, and each file or row group in it, covers a compact box in all
dimensions at once, so that min/max statistics prune by any of them.

The law is ``rows``: row counts of the shards differ by one at most. Rows of one cell are ordered by
checksum of the text and id, so equal texts with equal metadata stand together.

Plan: counts by cell are a partial aggregate over the metadata columns, and prefix sums run over at
most ``2 ** (bits * dims)`` cells. A cell is cut into slices of about ``slice_rows`` rows (or a
thousandth of all, if that is less) by the range of the checksum, with prefix sums of its own, so that
a cell with a third of all rows is dealt over many tasks. A slice that holds more than a thousandth of
all rows (so many copies of a text; there are at most 1000 such slices) is dealt over parts by a hash
of the id. Only the last ranking sorts rows, by (cell, slice, part). Text is read for size and
checksum and never shuffled. No rank needs all rows in one task.

Defined results: a null text has size 1 (none + 1) and checksum 0; null metadata is step 0; equal
keys are ordered by id, and repeated rows get different slots in any order (they are alike); an
empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framelake.llm import common


MOST_CELLS = 1 << 20
HOT_PARTS = 32

def quantise(c: Column, kind: str, bits: int) -> Column:
    """A step from 0 to ``2 ** bits - 1``: null is 0; numbers by half powers of two; others by checksum."""
    top = (1 << bits) - 1
    if kind in ("tinyint", "smallint", "int", "bigint", "float", "double"):
        step = F.floor(2 * F.log2(F.greatest(c.cast("double"), F.lit(0.0)) + 1)).cast("int")
        return F.coalesce(F.least(F.greatest(step, F.lit(0)), F.lit(top)), F.lit(0))
    return F.coalesce((F.crc32(c.cast("string").cast("binary")) % (top + 1)).cast("int"), F.lit(0))


def hilbert_index(dims: list[Column], bits: int) -> Column:
    """The index of a lattice point on the Hilbert curve of ``len(dims)`` dimensions.

    The point is rotated and reflected level by level (from the coarsest), then its coordinates are
    Gray-decoded and interleaved. Each step is one lambda over the coordinate array.
    """
    n = len(dims)
    point = F.array(*[d.cast("int") for d in dims])
    put = lambda x, k, v: F.transform(x, lambda e, j: F.when(j == k, v).otherwise(e))
    first = lambda x: F.element_at(x, 1)

    def turn(x: Column, s: Column) -> Column:
        level, k = s["level"], s["k"]
        low = level - 1
        own = F.element_at(x, k + 1)
        swap = first(x).bitwiseXOR(own).bitwiseAND(low)
        flipped = put(x, F.lit(0), first(x).bitwiseXOR(low))
        swapped = F.transform(x, lambda e, j: F.when(j == 0, first(x).bitwiseXOR(swap)).otherwise(F.when(j == k, e.bitwiseXOR(swap)).otherwise(e)))
        return F.when(own.bitwiseAND(level) != 0, flipped).otherwise(F.when(k == 0, x).otherwise(swapped))

    steps = F.array(*[F.struct(F.lit(1 << b).alias("level"), F.lit(k).alias("k")) for b in range(bits - 1, 0, -1) for k in range(n)])
    x = F.aggregate(steps, point, turn) if bits > 1 else point
    gray = F.aggregate(
        x,
        F.array().cast("array<int>"),
        lambda acc, e: F.array_append(acc, e.bitwiseXOR(F.when(F.size(acc) == 0, F.lit(0)).otherwise(F.element_at(acc, -1)))),
    )
    levels = F.array(*[F.lit(1 << b) for b in range(bits - 1, 0, -1)])
    flip = lambda g: F.aggregate(levels, F.lit(0), lambda t, q: F.when(F.element_at(g, n).bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t)) if bits > 1 else F.lit(0)
    spots = F.array(*[F.struct(F.lit(b).alias("b"), F.lit(k).alias("k")) for b in range(bits - 1, -1, -1) for k in range(n)])
    done = F.transform(F.array(gray), lambda g: F.transform(F.array(flip(g)), lambda t: F.aggregate(spots, F.lit(0).cast("long"), lambda h, s: h * 2 + F.getbit(F.element_at(g, s["k"] + 1).bitwiseXOR(t), s["b"]))))
    return F.flatten(done)[0]


def shard_rows(docs: DataFrame, shards: int = 16, *, id_col: str = "doc_id", text_col: str = "text", dims: tuple[str, ...] = ("lang", "source", "n_chars"), bits: int = 5, slice_rows: int = 10_000) -> DataFrame:
    """(id, size, text_crc32, hilbert, shard, slot) of every row.

    ``2 ** (bits * len(dims))`` cells are counted in a broadcast table: ``MOST_CELLS`` at most.
    """
    if bits * len(dims) > MOST_CELLS.bit_length() - 1:
        raise ValueError(f"{bits} bits in {len(dims)} dimensions make more than {MOST_CELLS} cells")
    kinds = dict(docs.dtypes)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        hilbert_index([quantise(F.col(c), kinds[c], bits) for c in dims], bits).alias("hilbert"),
    )
    n = docs.count()
    slice_rows = max(1, min(slice_rows, max(16, n // 1000)))
    before = lambda *by: Window.partitionBy("hilbert").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    all_before = Window.orderBy("hilbert").rowsBetween(Window.unboundedPreceding, -1)
    cells = rows.groupBy("hilbert").agg(F.count(F.lit(1)).alias("cell_n"))
    cells = cells.select("hilbert", "cell_n", F.coalesce(F.sum("cell_n").over(all_before), F.lit(0)).alias("cell_at"))
    # at most 2 ** (bits * dims) rows of 24 bytes, whatever the input: 786 kB for 5 bits in 3 dimensions
    rows = rows.join(F.broadcast(cells), "hilbert")
    # a cell's rows stand in the order of their texts' checksums, cut into slices that tasks rank one by one
    rows = rows.withColumn("slice", F.floor(F.col("text_crc32") * F.ceil(2 * F.col("cell_n") / slice_rows) / F.lit(1 << 32)).cast("long"))
    # a slice can outgrow a thousandth of all rows only by a text with that many copies: it is dealt by ids
    name = F.concat_ws(":", "hilbert", "slice")
    hot = [r[0] for r in rows.groupBy("hilbert", "slice").count().where(F.col("count") > max(4 * slice_rows, n // 1000)).select(name).collect()]
    part = F.pmod(F.xxhash64("id"), F.lit(HOT_PARTS)).cast("int")
    rows = rows.withColumn("part", F.when(name.isin(hot), part).otherwise(0) if hot else F.lit(0))
    at = ["hilbert", "slice", "part"]
    by_part = rows.groupBy(*at).agg(F.count(F.lit(1)).alias("n"))
    by_part = by_part.select(*at, F.coalesce(F.sum("n").over(before("slice", "part")), F.lit(0)).alias("part_at"))
    rank = F.row_number().over(Window.partitionBy(*at).orderBy("text_crc32", "id"))
    place = rows.withColumn("rank", rank).join(by_part, at).withColumn("place", F.col("cell_at") + F.col("part_at") + F.col("rank") - 1)
    # the first shards take one row more where the count doesn't divide
    each, more = divmod(n, shards)
    edge = more * (each + 1)
    shard = F.when(F.col("place") < edge, F.floor(F.col("place") / (each + 1))).otherwise(more + F.floor((F.col("place") - edge) / max(each, 1)))
    start = F.when(F.col("shard") <= more, F.col("shard") * (each + 1)).otherwise(edge + (F.col("shard") - more) * each)
    return place.withColumn("shard", shard.cast("int")).select("id", "size", "text_crc32", "hilbert", "shard", (F.col("place") - start).cast("long").alias("slot"))


def op8(spark, sf_dir: str) -> DataFrame:
    """The contract's columns over the whole of ``documents``, law ``rows``."""
    return shard_rows(common.read(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert"
    )
