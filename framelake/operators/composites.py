"""Whole looks, composed of the operators: keying, quantising, cel shading, and matching to a reference.

Each takes a pixel table and a configuration; stages that are off add nothing to the plan.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.functions import color as C
from framelake.operators import frames as fr
from framelake.operators import graph as G
from framelake.operators import layout as L
from framelake.operators import matte as M
from framelake.operators import palette as P
from framelake.operators import raster as R
from framelake.operators import stencil as S
from framelake.operators import temporal as T
from framelake.operators.lineage import settle
from framelake.sources.palettes import bayer, palette

RGB = ("r", "g", "b")
PIXEL = ["run_id", "frame", "y", "x"]
CELL = ["run_id", "y", "x"]


@dataclass(frozen=True)
class Key:
    """``area`` is a percentage of the frame; ``share`` a percentage of the main component."""

    keys: tuple[tuple[int, int, int], ...] = ((0, 255, 0),)
    tolerance: float = 0.35
    shadow: float = 1.0
    interior: bool = True
    interior_tolerance: float = 0.5
    area: float = 5.0
    vote: bool = True
    erode: int = 0
    share: float = 0.0
    despill: bool = True


def chroma_key(px: DataFrame, c: Key, height: int, width: int) -> DataFrame:
    """Keys backgrounds: flood from the border, enclosed gaps, rescue, vote over three frames, erosion, detached parts, despill.

    Gaps and rescue use the first key only, the flood all of them.
    """
    lab = M.with_lab(px)
    test = lambda keys, tol, sh: reduce(lambda p, q: p | q, [M.is_candidate(list(C.lab([F.lit(v) for v in k])), tol, sh) for k in keys])
    rows = lab.withColumns({"_c": test(c.keys, c.tolerance, c.shadow), "_one": test(c.keys[:1], c.tolerance, c.shadow), "_t": test(c.keys[:1], c.tolerance * c.interior_tolerance, c.shadow), "_strong": ~test(c.keys, min(1.0, 2 * c.tolerance), c.shadow), "_strict": test(c.keys[:1], 0.4 * c.tolerance, c.shadow)}).drop(*M.LAB)
    rows = settle(G.border_flood(rows, "_c", height, width, True, "back"))
    if c.interior:
        rows = rows.withColumn("_in", F.col("_one") & ~F.col("back"))
        rows = G.interior_gaps(rows, "_in", "_t", int(c.area / 100 * height * width), height, width, out="_gap").withColumn("back", F.col("back") | F.col("_gap")).drop("_gap", "_in")
        rows = settle(rows)
    # a rescued subject's hull covers gaps that are backdrop: they are keyed again
    rows = settle(R.rescue_subject(rows, "back", "_strict", height, width)).withColumn("_in", F.col("_one") & ~F.col("back") & F.col("saved"))
    rows = G.interior_gaps(rows, "_in", "_t", int(c.area / 100 * height * width), height, width, out="_gap").withColumn("back", F.col("back") | F.col("_gap")).drop("_gap", "_in", "saved", "_strict")
    rows = settle(rows)
    if c.vote:
        rows = T.guarded_vote(T.vote3(rows, F.col("back"), CELL, out="_v"), "_v", "back", "_t", "_strong", "_k").withColumn("back", F.col("_k")).drop("_v", "_k")
    rows = rows.withColumn("front", ~F.col("back")).drop("_c", "_one", "_t", "_strong", "back")
    rows = settle(rows)
    if c.erode:
        rows = settle(S.morph(rows, "front", "erode", height, width, steps=c.erode))
    if c.share > 0:
        rows = G.drop_detached(rows, "front", c.share, height, width, out="_kept").withColumn("front", F.col("_kept")).drop("_kept")
        rows = settle(rows)
    if c.despill:
        rows = S.inner_ring(rows, "front", height, width, "_ring")
        top = max(range(3), key=lambda i: c.keys[0][i])
        rows = M.despill(rows, RGB[top], F.col("_ring")).drop("_ring")
    return rows.withColumn("a", F.col("front").cast("double")).drop("front")


@dataclass(frozen=True)
class Quantise:
    saturation: float = 1.0
    contrast: float = 1.0
    median: bool = False
    shrink: int = 1
    palette: str = "PICO-8"
    clusters: int = 0
    iterations: int = 4
    metric: str = "lab"
    dither: int = 0
    strength: float = 0.0
    sticky: float = 0.0
    despeckle: int = 0


def quantise(px: DataFrame, c: Quantise, height: int, width: int) -> DataFrame:
    """(pixel, k, r, g, b, a): boost, shrink, palette (built in, or clusters of the clip merged where near), dither, map, despeckle."""
    spark = px.sparkSession
    rows = px if "a" in px.columns else px.withColumn("a", F.lit(1.0))
    if c.saturation != 1:
        rows = R.saturate(rows, c.saturation)
    if c.contrast != 1:
        rows = R.contrast(rows, c.contrast)
    if c.median:
        rows = S.median3x3(rows, [*RGB, "a"], height, width)
    if c.shrink > 1:
        rows, height, width = fr.shrink_premultiplied(rows, c.shrink), -(-height // c.shrink), -(-width // c.shrink)
    pal = palette(spark, c.palette).drop("palette")
    if c.clusters:
        seeds = F.row_number().over(P.Window.orderBy(F.desc("n"), *RGB)) - 1  # over the few most frequent colours only
        common = P.colour_counts(rows.where("a > 0.5")).orderBy(F.desc("n"), *RGB).limit(c.clusters)
        pal = P.kmeans(rows.where("a > 0.5"), common.withColumn("k", seeds).select("k", *RGB), c.iterations)
        pal = P.merge_near(pal.withColumn("palette", F.lit("own")), ["palette"]).drop("palette")
        pal = P.indexed_palette(pal.select(*[F.rint(x).cast("int").alias(x) for x in RGB]).withColumn("palette", F.lit("own")), ["palette"]).drop("palette")
        pal = spark.createDataFrame(pal.limit(P.MOST).collect(), pal.schema)  # at most ``clusters`` rows
    if c.dither and c.strength > 0:
        rows = rows.withColumns(dict(zip(RGB, C.dither([F.col(x) for x in RGB], F.col("y"), F.col("x"), bayer(c.dither), c.strength), strict=True)))
    if c.sticky > 0:
        space = rows.withColumns(dict(zip(RGB, C.lab([F.col(x) for x in RGB]), strict=True))) if c.metric == "lab" else rows
        out = T.sticky_labels(space, P.in_lab(pal) if c.metric == "lab" else pal, c.sticky)
    else:
        out = P.with_nearest(rows, pal, c.metric).select(*PIXEL, "k")
    for _ in range(c.despeckle):
        out = S.despeckle(out, "k", P.as_array(P.in_lab(pal)), height, width)
    return P.lookup(out.join(rows.select(*PIXEL, "a"), PIXEL), _with_rgb(pal))


def _with_rgb(pal: DataFrame) -> DataFrame:
    return pal.select("k", *RGB)


@dataclass(frozen=True)
class Cel:
    palette: str = "SWEETIE-16"
    bands: int = 3
    ambient: float = 0.35
    shadow: float = 0.75
    highlight: float = 1.1
    contrast: float = 1.0
    hue_shift: float = 0.3
    vibrancy: float = 1.0
    hysteresis: float = 0.05
    votes: int = 5
    outline: bool = True


def cel_shade(px: DataFrame, c: Cel, height: int, width: int) -> DataFrame:
    """(pixel, base, band, r, g, b, a): classify on medians, quantise light to bands, vote, outline; colours come from the ramp only."""
    spark = px.sparkSession
    pal = palette(spark, c.palette).drop("palette")
    ramp = P.shade_ramp(pal, c.bands, c.ambient, c.hue_shift, c.vibrancy)
    ramp = spark.createDataFrame(ramp.select("k", "band", *RGB).collect(), "k int, band int, r double, g double, b double")  # palette x bands rows
    soft = S.median3x3(px, [*RGB, "a"], height, width)
    base = P.with_nearest(soft, pal, "redmean", "base").drop("base_d2")
    own = pal.select(F.col("k").alias("base"), C.luminance([F.col(x) for x in RGB]).alias("_base_l"))
    lit = base.join(F.broadcast(own), "base").withColumn("ratio", 1 + (C.luminance([F.col(x) for x in RGB]) / F.greatest(F.col("_base_l"), F.lit(1.0)) - 1) * c.contrast)
    ratio = S.median3x3(lit.select(*PIXEL, "ratio"), ["ratio"], height, width).withColumn("ratio", F.least(F.greatest("ratio", F.lit(0.001)), F.lit(1.5)))
    bounds = {1: [], 2: [c.shadow], 3: [c.shadow, c.highlight]}.get(c.bands, [c.shadow, c.shadow + (c.highlight - c.shadow) * 0.33, c.shadow + (c.highlight - c.shadow) * 0.66])
    band = T.band_hysteresis(ratio, "ratio", c.bands, c.shadow, c.highlight, c.hysteresis, bounds, CELL)
    rows = lit.select(*PIXEL, "base", "a").join(band, PIXEL).withColumn("k", F.col("base") * c.bands + F.col("band"))
    for _ in range(2 if c.votes else 0):
        rows = S.region_vote(rows, "k", F.col("a") > 0.5, F.lit(False), height, width, c.votes)
    rows = rows.withColumns({"base": F.floor(F.col("k") / c.bands).cast("int"), "band": (F.col("k") % c.bands).cast("int")})
    if c.outline:
        rows = S.inner_ring(rows.withColumn("_m", F.col("a") > 0.5), "_m", height, width, "_ring").drop("_m")
    else:
        rows = rows.withColumn("_ring", F.lit(False))
    shades = ramp.select(F.col("k").alias("base"), "band", *RGB)
    dark = ramp.where("band = 0").select(F.col("k").alias("base"), *[(F.col(x) * 0.55).alias(f"_{x}") for x in RGB])
    rows = rows.join(F.broadcast(shades), ["base", "band"]).join(F.broadcast(dark), "base")
    return rows.select(*PIXEL, "base", "band", *[F.when(F.col("_ring"), F.col(f"_{x}")).otherwise(F.col(x)).cast("int").alias(x) for x in RGB], "a")


@dataclass(frozen=True)
class Match:
    black: int = -1
    backdrop: int = -1
    votes: int = 5
    despeckle: int = 1


def match_reference(px: DataFrame, reference: DataFrame, c: Match, height: int, width: int) -> DataFrame:
    """(pixel, k, r, g, b, a): ramp classes of the reference's palette, shade rescue, votes in which black neither spreads nor yields, despeckle."""
    rows = settle(P.with_ramp_class(px, reference).withColumn("subject", F.col("a") > 0.5))
    if c.black >= 0:
        fixed = S.shade_rescue(rows, "k", "subject", c.black, c.backdrop, height, width)
        rows = settle(rows.drop("k").join(fixed, PIXEL))
    for _ in range(2 if c.votes else 0):
        before = rows.select(*PIXEL, F.col("k").alias("_k0"))
        rows = S.region_vote(rows, "k", F.col("subject"), F.col("k") == c.black, height, width, c.votes).join(before, PIXEL)
        rows = settle(rows.withColumn("k", F.when(F.col("k") == c.black, F.col("_k0")).otherwise(F.col("k"))).drop("_k0"))
    for _ in range(c.despeckle):
        rows = rows.drop("k").join(S.despeckle(rows.select(*PIXEL, "k"), "k", P.as_array(P.in_lab(reference)), height, width), PIXEL)
        rows = settle(rows)
    return P.lookup(rows.drop("subject"), reference.select("k", *RGB))


def auto_crop(px: DataFrame, height: int, width: int, padding: int = 2, multiple: int = 8, anchor: str = "bottom_center", union: bool = False) -> DataFrame:
    """Crops each frame (or the run) to its opaque pixels and anchors it on one canvas a run."""
    solid = F.col("a") > 0.5
    boxes = L.bbox(px, solid, height, width)
    if union:
        one = L.union_bbox(px, solid, height, width)
        boxes = boxes.select("run_id", "frame").join(one, "run_id")
    return L.paste(px, L.placements(boxes, L.auto_canvas(boxes, padding, multiple), padding, height, width, anchor))
