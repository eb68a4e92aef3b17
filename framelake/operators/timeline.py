"""Intervals, as-of lookups, keyframes, layers and cels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RGB = ("r", "g", "b")


def overlapping_texts(segments: DataFrame, start: int, length: int, by: str) -> DataFrame:
    """(by, texts, n): the distinct texts of a group's segments that overlap [start, start + length), in order of start.

    Empty texts and segments that end at or before their start are skipped.
    """
    end = start + max(1, length)
    text = F.trim(F.coalesce(F.col("text"), F.lit("")))
    hit = (text != "") & (F.col("end") > F.col("start")) & (F.col("start") < end) & (F.col("end") > start)
    firsts = segments.where(hit).groupBy(by, text.alias("text")).agg(F.min(F.struct("start", "pos")).alias("o"))
    lists = firsts.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("o", "text"))).alias("l"))
    return lists.select(by, F.array_join(F.transform("l", lambda e: e["text"]), ". ").alias("texts"), F.size("l").alias("n"))


def asof_backward(ticks: DataFrame, rows: DataFrame, by: str, at: str, value: str) -> DataFrame:
    """(by, at, value): for each tick the value of the latest row at or before it; null before the first.

    One union, one sort within a key: no range join.
    """
    both = ticks.select(by, at, F.lit(None).cast(dict(rows.dtypes)[value]).alias(value), F.lit(1).alias("_tick"), F.lit(None).cast("long").alias("_o"))
    both = both.unionByName(rows.select(by, at, value, F.lit(0).alias("_tick"), F.monotonically_increasing_id().alias("_o") if "_o" not in rows.columns else F.col("_o")))
    w = Window.partitionBy(by).orderBy(at, "_tick", "_o").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last(value, ignorenulls=True).over(w)).where("_tick = 1").select(by, at, value)


def interpolate(frames: DataFrame, keys: DataFrame, by: str, base: tuple[float, float, float] = (0.0, 0.0, 1.0)) -> DataFrame:
    """(by, frame, x, y, scale): keyframe transforms of every frame.

    Without keyframes the base; at or outside the ends (or with one key) the key's own values replace
    the base; between keys x and y are added to it and scale is multiplied. That the ends replace and
    the inside adds is the rule kept here.
    """
    lists = keys.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("frame", "x", "y", "scale"))).alias("k"))
    rows = frames.join(lists, by, "left")
    f, k = F.col("frame"), F.col("k")
    first, last = F.try_element_at(k, F.lit(1)), F.try_element_at(k, F.lit(-1))
    rows = rows.withColumns({"p": F.try_element_at(F.filter(k, lambda e: e["frame"] <= f), F.lit(-1)), "n": F.try_element_at(F.filter(k, lambda e: e["frame"] > f), F.lit(1)), "lo": first, "hi": last})
    t = (f - F.col("p.frame")) / (F.col("n.frame") - F.col("p.frame"))
    mix = lambda c: F.col(f"p.{c}") + (F.col(f"n.{c}") - F.col(f"p.{c}")) * t

    def pick(c: str, b: float, times: bool) -> Column:
        inside = mix(c) * b if times else mix(c) + b
        return F.when(k.isNull(), F.lit(b)).when(f <= F.col("lo.frame"), F.col(f"lo.{c}")).when(f >= F.col("hi.frame"), F.col(f"hi.{c}")).otherwise(inside)

    return rows.select(by, "frame", pick("x", base[0], False).alias("x"), pick("y", base[1], False).alias("y"), pick("scale", base[2], True).alias("scale"))


def blend(mode: Column, under: Column, over: Column) -> Column:
    """Separable blending of channels from 0 to 1."""
    screen = under + over - under * over
    overlay = F.when(under <= 0.5, 2 * under * over).otherwise(1 - 2 * (1 - under) * (1 - over))
    return F.when(mode == "multiply", under * over).when(mode == "screen", screen).when(mode == "overlay", overlay).otherwise(over)


def composite(cels: DataFrame, by: list[str]) -> DataFrame:
    """(by, r, g, b, a): layers (pos, r, g, b, a, opacity, mode, visible) over each other from the lowest position; channels 0 to 1.

    A fold over the layers of one pixel: as many entries as there are layers.
    """
    layer = F.struct("pos", *RGB, "a", "opacity", "mode")
    lists = cels.where("visible").groupBy(*by).agg(F.sort_array(F.collect_list(layer)).alias("l"))
    zero = F.struct(*[F.lit(0.0).alias(c) for c in (*RGB, "a")])

    def over(acc: Column, x: Column) -> Column:
        sa = x["a"] * x["opacity"]
        oa = sa + acc["a"] * (1 - sa)

        def channel(c: str) -> Column:
            top = (1 - acc["a"]) * x[c] + acc["a"] * blend(x["mode"], acc[c], x[c])
            return F.when(oa > 0, (sa * top + (1 - sa) * acc["a"] * acc[c]) / oa).otherwise(0.0)

        return F.struct(*[channel(c).alias(c) for c in RGB], oa.alias("a"))

    return lists.select(*by, F.aggregate("l", zero, over).alias("o")).select(*by, "o.*")


def bind_slots(layers: DataFrame, slots: DataFrame, by: str) -> DataFrame:
    """(by, layer, slot): the i-th visible reference layer takes the i-th free slot."""
    i = lambda *o: F.row_number().over(Window.partitionBy(by).orderBy(*o)).alias("i")
    a = layers.where("visible AND kind = 'ref'").select(by, "layer", i("pos", "layer"))
    b = slots.where("free").select(by, "slot", i("slot"))
    return a.join(b, [by, "i"]).select(by, "layer", "slot")


def upsert_layers(old: DataFrame, new: DataFrame, keys: list[str], keep: list[str]) -> DataFrame:
    """New rows take the kept attributes of old rows with their key; old user rows stay; other old rows go."""
    kept = old.select(*keys, *[F.col(c).alias(f"_{c}") for c in keep])
    fresh = new.join(kept, keys, "left").withColumns({c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in keep}).select(*new.columns)
    own = old.where("source = 'user'").join(new.select(*keys), keys, "left_anti")
    return fresh.unionByName(own.select(*new.columns))


def splice(cels: DataFrame, fresh: DataFrame, start: int, count: int, by: str) -> DataFrame:
    """Cels of [start, start + count) are replaced; those outside stay as they were."""
    gone = (F.col("frame") >= start) & (F.col("frame") < start + count)
    inside = fresh.where((F.col("frame") >= 0) & (F.col("frame") < count)).withColumn("frame", F.col("frame") + start)
    return cels.where(~gone).unionByName(inside.select(*cels.columns))


def insert_blank(cels: DataFrame, at: int, count: int = 1) -> DataFrame:
    """Later cels move back."""
    return cels.withColumn("frame", F.when(F.col("frame") >= at, F.col("frame") + count).otherwise(F.col("frame")))


def delete_cel(cels: DataFrame, at: int) -> DataFrame:
    """The cel goes and later ones move up."""
    return cels.where(F.col("frame") != at).withColumn("frame", F.when(F.col("frame") > at, F.col("frame") - 1).otherwise(F.col("frame")))


def duplicate_cel(cels: DataFrame, at: int) -> DataFrame:
    """A copy follows the cel."""
    moved = insert_blank(cels, at + 1)
    return moved.unionByName(cels.where(F.col("frame") == at).withColumn("frame", F.lit(at + 1).cast(dict(cels.dtypes)["frame"])))


def line_points(lines: DataFrame) -> DataFrame:
    """The pixels of lines (x0, y0, x1, y1) by equal steps along the longer side."""
    n = F.greatest(F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0")), F.lit(1))
    rows = lines.withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n"))))
    at = lambda a, b: F.floor(F.col(a) + (F.col(b) - F.col(a)) * F.col("i") / F.col("n") + 0.5).cast("int")
    return rows.withColumns({"x": at("x0", "x1"), "y": at("y0", "y1")}).drop("n", "i")


def zoom_snap(scale: Column, limit: float = 0.0) -> Column:
    """Whole-number zooms, or one over a whole number; at most ``limit`` if that is given."""
    up = F.greatest(F.lit(1.0), F.floor(scale + 0.5)) if not limit else F.when(F.greatest(F.lit(1.0), F.floor(scale)) > limit, max(1.0, float(int(limit)))).otherwise(F.greatest(F.lit(1.0), F.floor(scale)))
    inv = F.greatest(F.lit(1.0), F.floor(1 / scale + 0.5))
    if limit:
        inv = F.when(1 / inv > limit, F.greatest(F.lit(1.0), F.ceil(1 / scale))).otherwise(inv)
    return F.when(scale >= 1, up).otherwise(1 / inv)
