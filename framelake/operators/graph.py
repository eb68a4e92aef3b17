"""Connected components within frames, and the mask rules built on them.

A component lies within one frame, so labelling is a numpy fixpoint over one frame at a time
(``applyInArrow`` by run and frame); everything after it is joins and aggregates.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framelake.functions import color as C
from framelake.operators.stencil import FRAME, RGB, square

PIXEL = [*FRAME, "y", "x"]


def label_frame(mask: np.ndarray, eight: bool) -> np.ndarray:
    """Each true cell's least linear index in its component, -1 elsewhere: minima spread over neighbours, then labels jump to their own label."""
    h, w = mask.shape
    none = h * w
    lab = np.where(mask, np.arange(none).reshape(h, w), none)
    while True:
        pad = np.pad(lab, 1, constant_values=none)
        views = [pad[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w] for dy, dx in (square(3, False) if eight else ((0, -1), (-1, 0), (1, 0), (0, 1)))]
        new = np.where(mask, np.minimum.reduce([lab, *views]), none)
        flat = np.append(new.ravel(), none)
        new = flat[new]  # jump
        if (new == lab).all():
            return np.where(mask, lab, -1)
        lab = new


def _grow(mask: np.ndarray, steps: int) -> np.ndarray:
    """8-connected dilation."""
    for _ in range(steps):
        pad = np.pad(mask, 1)
        mask = np.logical_or.reduce([pad[1 + dy : pad.shape[0] - 1 + dy, 1 + dx : pad.shape[1] - 1 + dx] for dy, dx in square(3)])
    return mask


def components(px: DataFrame, flag: str, height: int, width: int, eight: bool = True) -> DataFrame:
    """(run, frame, y, x, label, size, main, near) of the flagged pixels.

    label is y * width + x of the component's first pixel in reading order; main marks the largest
    component (of equals the first in reading order), near what lies within two pixels of it.
    """
    src = px.where(F.col(flag)).select(*[F.col(c).cast("long").alias(c) for c in PIXEL])

    def run(table: pa.Table) -> pa.Table:
        y, x = table["y"].to_numpy(), table["x"].to_numpy()
        mask = np.zeros((height, width), bool)
        mask[y, x] = True
        lab = label_frame(mask, eight)
        size = np.bincount(lab[mask], minlength=1)
        main = lab == int(size.argmax())
        cols = (lab, np.where(mask, size[lab], 0), main, _grow(main, 2))
        for name, c in zip(("label", "size", "main", "near"), cols, strict=True):
            table = table.append_column(name, pa.array(c[y, x]))
        return table

    return src.groupBy(*FRAME).applyInArrow(run, "run_id long, frame long, y long, x long, label long, size long, main boolean, near boolean")


def border_flood(px: DataFrame, flag: str, height: int, width: int, eight: bool = True, out: str = "bg") -> DataFrame:
    """Adds whether a flagged pixel's component touches the frame's border."""
    lab = components(px, flag, height, width, eight)
    edge = (F.col("y") == 0) | (F.col("y") == height - 1) | (F.col("x") == 0) | (F.col("x") == width - 1)
    touch = lab.groupBy(*FRAME, "label").agg(F.max(edge).alias(out))
    hit = lab.join(touch, [*FRAME, "label"]).select(*PIXEL, out)
    return px.join(hit, PIXEL, "left").withColumn(out, F.coalesce(out, F.lit(False)))


def interior_gaps(px: DataFrame, flag: str, tight: str, most_area: int, height: int, width: int, share: float = 0.6, out: str = "gap") -> DataFrame:
    """Adds whether a pixel is in an enclosed component of at most ``most_area`` pixels, ``share`` of which match tightly."""
    lab = components(px, flag, height, width).join(px.select(*PIXEL, F.col(tight).alias("_t")), PIXEL)
    edge = (F.col("y") == 0) | (F.col("y") == height - 1) | (F.col("x") == 0) | (F.col("x") == width - 1)
    stat = lab.groupBy(*FRAME, "label").agg(F.max(edge).alias("_b"), F.count(F.lit(1)).alias("_n"), F.avg(F.col("_t").cast("int")).alias("_share"))
    good = stat.where(~F.col("_b") & (F.col("_n") <= most_area) & (F.col("_share") >= share)).select(*FRAME, "label")
    hit = lab.join(good, [*FRAME, "label"], "left_semi").select(*PIXEL, F.lit(True).alias(out))
    return px.join(hit, PIXEL, "left").withColumn(out, F.coalesce(out, F.lit(False)))


def _marked(px: DataFrame, hit: DataFrame, out: str) -> DataFrame:
    """Adds whether a pixel is among the hits."""
    return px.join(hit.select(*PIXEL, F.lit(True).alias(out)), PIXEL, "left").withColumn(out, F.coalesce(out, F.lit(False)))


def largest_island(px: DataFrame, flag: str, height: int, width: int, eight: bool = False, out: str = "kept") -> DataFrame:
    return _marked(px, components(px, flag, height, width, eight).where("main"), out)


def drop_small(px: DataFrame, flag: str, least: int, height: int, width: int, out: str = "kept") -> DataFrame:
    """Keeps the 4-connected components of at least ``least`` pixels."""
    return _marked(px, components(px, flag, height, width, False).where(F.col("size") >= least), out)


def drop_detached(px: DataFrame, flag: str, percent: float, height: int, width: int, delta: float = 18.0, least: int = 20, out: str = "kept") -> DataFrame:
    """Keeps the main component, those of ``percent`` of its size, and near ones whose colour the main one has.

    Near: within two 8-connected dilations of the main component. A colour is there if at least
    ``max(least, size / 1000)`` main pixels are within ``delta`` (CIELAB) of the component's median colour.
    """
    part = [*FRAME, "label"]
    lab = components(px, flag, height, width).join(px.select(*PIXEL, *RGB), PIXEL)
    parts = lab.groupBy(*part).agg(F.max("near").alias("near"), F.max("size").alias("size"), F.max("main").alias("main"), *[F.median(c).alias(c) for c in RGB])
    main = parts.where("main").select(*FRAME, F.col("size").alias("_main"))
    parts = parts.join(main, list(FRAME)).withColumn("big", F.col("size") >= F.col("_main") * (percent / 100))
    named = lambda prefix: dict(zip([f"{prefix}{c}" for c in RGB], C.lab([F.col(c) for c in RGB]), strict=True))
    # the main component's different colours with their numbers, against one median a component
    body = lab.where("main").groupBy(*FRAME, *RGB).agg(F.count(F.lit(1)).alias("n")).withColumns(named("o")).drop(*RGB)
    asked = parts.where("near AND NOT big").withColumns(named("m"))
    gap = F.sqrt(C.euclid2([F.col(f"o{c}") for c in RGB], [F.col(f"m{c}") for c in RGB]))
    alike = asked.join(body, list(FRAME)).where(gap < delta).groupBy(*part).agg(F.sum("n").alias("_alike"))
    parts = parts.join(alike, part, "left")
    keep = F.col("big") | F.coalesce(F.col("_alike") >= F.greatest(F.lit(least), F.floor(F.col("_main") * 0.001)), F.lit(False))
    return _marked(px, lab.join(parts.where(keep).select(*part), part, "left_semi"), out)


def fill_holes(px: DataFrame, flag: str, height: int, width: int) -> DataFrame:
    """Sets the parts of the complement that a 4-connected flood from the border doesn't reach."""
    free = border_flood(px.withColumn("_free", ~F.col(flag)), "_free", height, width, False, "_out")
    return free.withColumn(flag, F.col(flag) | ~F.col("_out")).drop("_free", "_out")


def auto_subject(px: DataFrame, height: int, width: int, tolerance: float = 28.0, least: float = 0.02) -> DataFrame:
    """Adds ``subject``: what a border flood of the border's median colour leaves; all pixels if that is under ``least``."""
    from framelake.operators.matte import border_strips

    key = border_strips(px, height, width, 1).groupBy(*FRAME).agg(*[F.median(c).alias(f"k{c}") for c in RGB])
    rows = px.join(key, list(FRAME)).withColumn("_m", C.redmean2([F.col(c) for c in RGB], [F.col(f"k{c}") for c in RGB]) < tolerance * tolerance).drop(*[f"k{c}" for c in RGB])
    rows = border_flood(rows, "_m", height, width, False, "_bg")
    share = rows.groupBy(*FRAME).agg(F.avg((~F.col("_bg")).cast("int")).alias("_share"))
    return rows.join(share, list(FRAME)).withColumn("subject", F.when(F.col("_share") < least, F.lit(True)).otherwise(~F.col("_bg"))).drop("_m", "_bg", "_share")


def hue_families(palette: DataFrame, chroma: float = 25.0, window: float = 35.0) -> DataFrame:
    """(k, family): chromatic entries chained while neighbours in hue are at most ``window`` degrees apart; named by the least k.

    Sorted by hue, families are the islands between wider gaps on the circle. A palette is one small
    relation (some hundred rows), ordered as a whole by its kind.
    """
    h, c, _ = C.hcl([F.col(x) for x in RGB])
    w = Window.partitionBy("palette").orderBy("h", "k")
    all_ = Window.partitionBy("palette")
    rows = palette.withColumns({"h": h, "c": c}).where(F.col("c") >= chroma)
    gap = F.coalesce(F.col("h") - F.lag("h").over(w), F.lit(1000.0))
    rows = rows.withColumn("island", F.sum((gap > window).cast("int")).over(w))
    rows = rows.withColumns({"lo": F.min("h").over(all_), "hi": F.max("h").over(all_), "last": F.max("island").over(all_)})
    joined = F.when((F.col("island") == F.col("last")) & (F.col("lo") + 360 - F.col("hi") <= window), 1).otherwise(F.col("island"))
    rows = rows.withColumn("island", joined)
    return rows.select("palette", "k", F.min("k").over(Window.partitionBy("palette", "island")).alias("family"))
