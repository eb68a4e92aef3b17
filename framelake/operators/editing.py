"""Edits of layers, keyframes and prompt segments, canvas extents, guides and playback.

Layers have (group, pos, name, ...) with gapless positions from 0 within a group; edits name positions and
leave groups alone that don't have them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from framelake.operators.texts import RATE, REST, STEP

SEGMENT = 22  # fixed value: frames of a new segment
FLOOR = 64  # fixed value: the least canvas side


def _count(by: str) -> Column:
    return F.count(F.lit(1)).over(Window.partitionBy(by))


def _at(rows: DataFrame, value: Column) -> DataFrame:
    return rows.withColumn("pos", value.cast(rows.schema["pos"].dataType))


def add_layer(layers: DataFrame, by: str, name: str, at: int | None = None, **props) -> DataFrame:
    """Each group gets a layer at a position, or at its end where that is beyond it; other columns are given by name or null."""
    n = F.count(F.lit(1))
    place = n if at is None else F.least(n, F.lit(at))
    fresh = layers.groupBy(by).agg(place.alias("pos"))
    fresh = fresh.select(*[F.col(c) if c in (by, "pos") else F.lit(name if c == "name" else props.get(c)).cast(t).alias(c) for c, t in layers.dtypes])
    pos = F.col("pos")
    moved = layers if at is None else _at(layers, F.when(pos >= at, pos + 1).otherwise(pos))
    return moved.unionByName(_at(fresh, pos))


def remove_layer(layers: DataFrame, by: str, at: int) -> DataFrame:
    """The layer goes and later ones move up; a group's only layer stays."""
    pos = F.col("pos")
    rows = layers.withColumn("_n", _count(by)).where((pos != at) | (F.col("_n") == 1))
    return _at(rows, F.when((pos > at) & (F.col("_n") > 1), pos - 1).otherwise(pos)).drop("_n")


def duplicate_layer(layers: DataFrame, at: int) -> DataFrame:
    """An unlocked copy, so named, follows the layer."""
    pos = F.col("pos")
    copy = layers.where(pos == at).withColumn("name", F.concat("name", F.lit(" copy")))
    if "locked" in layers.columns:
        copy = copy.withColumn("locked", F.lit(False))
    return _at(layers, F.when(pos > at, pos + 1).otherwise(pos)).unionByName(_at(copy, pos + 1))


def move_layer(layers: DataFrame, by: str, source: int, target: int) -> DataFrame:
    """The layer goes to another position, and those between close up; nothing moves where either isn't there."""
    pos = F.col("pos")
    if source < target:
        moved = F.when(pos == source, F.lit(target)).when(pos.between(source + 1, target), pos - 1).otherwise(pos)
    else:
        moved = F.when(pos == source, F.lit(target)).when(pos.between(target, source - 1), pos + 1).otherwise(pos)
    known = F.lit(target >= 0) & (F.greatest(F.lit(source), F.lit(target)) < F.col("_n"))
    rows = layers.withColumn("_n", _count(by))
    return _at(rows, F.when(known, moved).otherwise(pos)).drop("_n")


def put_keyframes(keys: DataFrame, fresh: DataFrame, on: list[str]) -> DataFrame:
    """New keyframes replace those of the same layer and frame; a missing place is 0, a missing or zero scale 1."""
    scale = F.when(F.col("scale") != 0, F.col("scale")).otherwise(1.0)
    fresh = fresh.withColumns({"x": F.coalesce("x", F.lit(0.0)), "y": F.coalesce("y", F.lit(0.0)), "scale": scale})
    return keys.join(fresh.select(*on), on, "left_anti").unionByName(fresh.select(*keys.columns))


def drop_keyframes(keys: DataFrame, gone: DataFrame, on: list[str]) -> DataFrame:
    return keys.join(gone.select(*on), on, "left_anti")


def total_frames(layers: DataFrame, cels: DataFrame, by: str) -> DataFrame:
    """(by, frames): one more than the last frame of any of a group's layers; 0 without cels."""
    ends = cels.groupBy("layer").agg((F.max("frame") + 1).alias("n"))
    return layers.join(ends, "layer", "left").groupBy(by).agg(F.coalesce(F.max("n"), F.lit(0)).alias("frames"))


def canvas_extent(layers: DataFrame, cels: DataFrame) -> DataFrame:
    """(frame, w, h): the largest cel of visible layers that aren't references, 64 at least."""
    counts = F.col("visible") & (F.col("kind") != "ref")
    side = lambda c: F.greatest(F.lit(FLOOR), F.max(F.when(counts, F.col(c)))).alias(c)
    return cels.join(layers.select("layer", "visible", "kind"), "layer").groupBy("frame").agg(side("w"), side("h"))


def shown_cels(layers: DataFrame, cels: DataFrame, frames: int) -> DataFrame:
    """(layer, frame, cel): visible layers' own cels; a reference layer shows its first cel on the frames that it lacks."""
    seen = cels.join(layers.where("visible").select("layer", "kind"), "layer")
    own = seen.where(F.col("frame") < frames).select("layer", "frame", "cel")
    firsts = seen.where("kind = 'ref'").groupBy("layer").agg(F.min_by("cel", "frame").alias("cel"))
    every = firsts.select("layer", F.explode(F.sequence(F.lit(0), F.lit(frames - 1))).alias("frame"), "cel").withColumn("frame", F.col("frame").cast(dict(cels.dtypes)["frame"])).select(*own.columns)
    return own.unionByName(every.join(own, ["layer", "frame"], "left_anti"))


def regen_range(start: Column, end: Column) -> list[Column]:
    """start, count, n and seconds: the frames to splice, and the clip on the 17 k + 5 grid that covers them."""
    count = end - start + 1
    n = F.greatest(F.lit(REST), count)
    n = n + F.pmod(F.lit(REST) - n, F.lit(STEP))
    return [start.alias("start"), count.alias("count"), n.alias("n"), (n / F.lit(float(RATE))).alias("seconds")]


def segment_hits(segments: DataFrame, points: DataFrame, by: str, cell: int, grip: int = 4) -> DataFrame:
    """The points (by, px, ...) with the first segment (pos, start, end) whose frames hold them (-1 if none does), and the edge (l, r or '') within reach.

    Segments are spread over their frames and reduced to the first one a frame: an equi-join, not a range join.
    """
    held = segments.where(F.col("end") > F.col("start")).select(by, F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("frame"), F.struct("pos", "start", "end").alias("s"))
    first = held.groupBy(by, "frame").agg(F.min("s").alias("s"))
    rows = points.withColumn("frame", F.floor(F.col("px") / cell)).join(first, [by, "frame"], "left")
    near = lambda c: F.abs(F.col("px") - F.col(f"s.{c}") * cell) <= grip
    edge = F.when(near("start"), "l").when(near("end"), "r").otherwise("")
    return rows.select(*points.columns, "frame", F.coalesce(F.col("s.pos"), F.lit(-1)).alias("hit"), edge.alias("edge"))


def drag_segment(start: Column, end: Column, by: Column, how: Column) -> tuple[Column, Column]:
    """(start, end) after a drag: move keeps the length and stops at 0, left and right keep one frame at least."""
    moved = F.greatest(F.lit(0), start + by)
    left = F.greatest(F.lit(0), F.least(start + by, end - 1))
    right = F.greatest(start + 1, end + by)
    return F.when(how == "move", moved).when(how == "left", left).otherwise(start), F.when(how == "move", moved + end - start).when(how == "right", right).otherwise(end)


def _ranked(segments: DataFrame, by: str, *order: str) -> DataFrame:
    w = Window.partitionBy(by).orderBy(*order)
    return segments.withColumn("pos", F.row_number().over(w) - 1)


def add_segments(segments: DataFrame, fresh: DataFrame, by: str) -> DataFrame:
    """(by, pos, start, end, text): one new empty segment a row (by, frame) of ``fresh``, and all in order of start; new ones after old ones of the same start."""
    start = F.greatest(F.lit(0), F.col("frame"))
    new = fresh.select(by, F.lit(None).cast("long").alias("pos"), start.alias("start"), (start + SEGMENT).alias("end"), F.lit("").alias("text"))
    rows = segments.select(by, F.col("pos").cast("long"), "start", "end", "text").withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return _ranked(rows, by, "start", "_new", "pos").drop("_new")


def delete_segment(segments: DataFrame, by: str, at: int) -> DataFrame:
    """The segment goes and later ones move up."""
    pos = F.col("pos")
    return segments.where(pos != at).withColumn("pos", F.when(pos > at, pos - 1).otherwise(pos))


def next_frame(frame: Column, count: Column, loop: Column) -> tuple[Column, Column]:
    """(frame, playing) after a step: the first frame follows the last in a loop; otherwise playing ends on the last."""
    past = frame + 1 >= count
    return F.when(~past, frame + 1).when(loop, F.lit(0)).otherwise(count - 1), ~past | loop


def _whole(c: Column) -> Column:
    return F.floor(c + 0.5)


def marquee(x: Column, y: Column, w: Column, h: Column) -> list[Column]:
    """x, y, w and h of a dragged box with sides of either sign, as whole numbers; zeros for an empty drag."""
    drawn = (w != 0) | (h != 0)
    sides = {"x": _whole(F.least(x, x + w)), "y": _whole(F.least(y, y + h)), "w": _whole(F.abs(w)), "h": _whole(F.abs(h))}
    return [F.when(drawn, c).otherwise(0).alias(n) for n, c in sides.items()]


def from_centre(x: Column, y: Column, width: Column, height: Column) -> list[Column]:
    """dx and dy of a dot from the canvas centre; zeros without a canvas."""
    there = (width > 0) & (height > 0)
    return [F.when(there, _whole(c - side / 2)).otherwise(0).alias(n) for n, c, side in (("dx", x, width), ("dy", y, height))]


STATE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("visible", T.BooleanType()),
        T.StructField("opacity", T.DoubleType()),
        T.StructField("blend", T.StringType()),
        T.StructField("locked", T.BooleanType()),
    ]
)


def save_layers(layers: DataFrame, by: str) -> DataFrame:
    """(by, json): a group's layers in order."""
    item = F.struct("pos", F.struct(*STATE.fieldNames()).alias("l"))
    lists = layers.groupBy(by).agg(F.sort_array(F.collect_list(item)).alias("s"))
    return lists.select(by, F.to_json(F.transform("s", lambda e: e["l"])).alias("json"))


def restore_layers(states: DataFrame, by: str) -> DataFrame:
    """The layers of saved states, with defaults for a missing kind or source; an empty list, or bad JSON, gives no rows."""
    rows = states.select(by, F.posexplode(F.from_json("json", T.ArrayType(STATE))).alias("pos", "l")).select(by, "pos", "l.*")
    empty = {"kind": "normal", "source": "user"}
    return rows.withColumns({c: F.when(F.coalesce(F.col(c), F.lit("")) == "", v).otherwise(F.col(c)) for c, v in empty.items()})


def first_existing(wanted: DataFrame, files: DataFrame, by: str) -> DataFrame:
    """(by, path): of each request's candidate paths, in their order, the first that exists; null if none does."""
    there = files.select("path").distinct().withColumn("_there", F.lit(True))
    rank = F.min(F.when(F.col("_there"), F.struct("rank", "path")))
    return wanted.join(there, "path", "left").groupBy(by).agg(rank.alias("b")).select(by, F.col("b.path").alias("path"))
