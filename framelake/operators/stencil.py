"""Neighbourhood operators on pixel tables.

``neighbours`` sends each pixel to the pixels that see it, by a small literal array of offsets, so a
stencil is one generator and one aggregate by target: no self-join. Outside the frame, ``pad`` says
what is seen: nothing (``none``), the nearest pixel (``edge``), or the other side (``wrap``).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.functions import color as C

FRAME = ("run_id", "frame")
RGB = ("r", "g", "b")
CROSS = ((0, -1), (-1, 0), (1, 0), (0, 1))


def square(k: int, centre: bool = True) -> list[tuple[int, int]]:
    side = range(-(k // 2), k // 2 + 1)
    return [(dy, dx) for dy in side for dx in side if centre or dy or dx]


def neighbours(px: DataFrame, offsets: Sequence[tuple[int, int]], height: int, width: int, pad: str = "edge", keep: Sequence[str] = ()) -> DataFrame:
    """(run, frame, y, x of the target, dy, dx, kept columns of the pixel at that offset)."""
    cands = []
    for dy, dx in offsets:
        ys, xs = [("shift", dy)], [("shift", dx)]
        if pad == "edge":
            reach = lambda n: [(f"stay{i}", n) for i in range(abs(n))]
            ys, xs = ys + reach(dy), xs + reach(dx)
        cands += [(dy, dx, a, b) for a in ys for b in xs]

    def axis(c: Column, how: tuple[str, int], n: int) -> tuple[Column, Column]:
        """Target coordinate and whether it exists."""
        kind, d = how
        if kind == "shift":
            t = F.pmod(c - d, F.lit(n)) if pad == "wrap" else c - d
            return t, (t >= 0) & (t < n)
        i = int(kind[4:])  # a target i steps inside the border sees the border pixel
        edge = 0 if d < 0 else n - 1
        t = F.lit(i if d < 0 else n - 1 - i)
        # clamped only where the true place lies outside
        return t, (c == edge) & F.lit((i + d < 0) if d < 0 else (n - 1 - i + d > n - 1))

    rows = []
    for dy, dx, a, b in cands:
        ty, oky = axis(F.col("y"), a, height)
        tx, okx = axis(F.col("x"), b, width)
        rows.append(F.when(oky & okx, F.struct(ty.cast("int").alias("y"), tx.cast("int").alias("x"), F.lit(dy).alias("dy"), F.lit(dx).alias("dx"))))
    spread = F.filter(F.array(*rows), lambda e: e.isNotNull())
    return px.select(*FRAME, *keep, F.explode(spread).alias("_t")).select(*FRAME, "_t.y", "_t.x", "_t.dy", "_t.dx", *keep)


def _by(rows: DataFrame):
    return rows.groupBy(*FRAME, "y", "x")


def despeckle(px: DataFrame, index: str, palette_lab: Column | None, height: int, width: int, most: float = 30.0) -> DataFrame:
    """One pass: a pixel that shares its colour with none of its 8 neighbours takes the most frequent neighbour, if near enough.

    Of equally frequent neighbours the first in reading order wins. ``palette_lab``: an array of
    structs of CIELAB coordinates (named r, g, b) by index, for the colour gate; without it there is none.
    """
    rows = neighbours(px, square(3), height, width, "edge", [index])
    centre = (F.col("dy") == 0) & (F.col("dx") == 0)
    own = _by(rows.where(centre)).agg(F.first(index).alias("own"))
    votes = rows.where(~centre).groupBy(*FRAME, "y", "x", index).agg(F.count(F.lit(1)).alias("n"), F.min((F.col("dy") + 1) * 3 + F.col("dx") + 1).alias("at"))
    best = votes.groupBy(*FRAME, "y", "x").agg(F.max(F.struct("n", (-F.col("at")).alias("na"), F.col(index).alias("v"))).alias("b"), F.collect_set(index).alias("seen"))
    out = own.join(best, [*FRAME, "y", "x"])
    alone = ~F.array_contains("seen", F.col("own"))
    if palette_lab is not None:
        lab = lambda k: F.element_at(palette_lab, k.cast("int") + 1)
        gap = lambda p, q: F.sqrt(C.euclid2([p[c] for c in RGB], [q[c] for c in RGB]))
        alone = alone & (gap(lab(F.col("own")), lab(F.col("b.v"))) <= most)
    return out.select(*FRAME, "y", "x", F.when(alone, F.col("b.v")).otherwise(F.col("own")).alias(index))


def region_vote(px: DataFrame, index: str, subject: Column, protect: Column, height: int, width: int, least: int = 5) -> DataFrame:
    """A class with ``least`` of the 9 votes of subject pixels takes an unprotected subject pixel; the smallest class wins ties."""
    rows = px.withColumn("_s", subject).withColumn("_p", protect)
    near = neighbours(rows.where("_s"), square(3), height, width, "edge", [index])
    votes = near.groupBy(*FRAME, "y", "x", index).agg(F.count(F.lit(1)).alias("n"))
    best = votes.groupBy(*FRAME, "y", "x").agg(F.max(F.struct("n", (-F.col(index)).alias("nv"))).alias("_best"))
    out = rows.join(best, [*FRAME, "y", "x"], "left")
    take = F.col("_s") & ~F.col("_p") & (F.col("_best.n") >= least)
    return out.withColumn(index, F.when(F.coalesce(take, F.lit(False)), -F.col("_best.nv")).otherwise(F.col(index))).drop("_best", "_s", "_p")


def neighbour_count(px: DataFrame, flag: Column, height: int, width: int, out: str = "n") -> DataFrame:
    """How many of a pixel's 8 neighbours are flagged; outside the frame none is."""
    rows = px.withColumn("_f", flag.cast("int"))
    n = _by(neighbours(rows, square(3, False), height, width, "none", ["_f"])).agg(F.sum("_f").alias(out))
    return rows.join(n, [*FRAME, "y", "x"], "left").withColumn(out, F.coalesce(out, F.lit(0))).drop("_f")


def dark_lines(px: DataFrame, height: int, width: int, dark: int = 60) -> DataFrame:
    """Adds ``line``: near-black with 2 to 6 near-black neighbours."""
    is_dark = F.greatest(*[F.col(c) for c in RGB]) < dark
    return neighbour_count(px, is_dark, height, width).withColumn("line", is_dark & F.col("n").between(2, 6)).drop("n")


def morph(px: DataFrame, flag: str, how: str, height: int, width: int, offsets: Sequence[tuple[int, int]] = CROSS, steps: int = 1) -> DataFrame:
    """Erodes or dilates a boolean column; outside the frame it is false, so erosion eats the frame's edge."""
    offsets = [(0, 0), *offsets]
    for _ in range(steps):
        rows = neighbours(px, offsets, height, width, "none", [flag])
        n = _by(rows).agg(F.sum(F.col(flag).cast("int")).alias("_n"))
        hit = F.col("_n") == len(offsets) if how == "erode" else F.col("_n") > 0
        px = px.drop(flag).join(n, [*FRAME, "y", "x"]).withColumn(flag, hit).drop("_n")
    return px


def inner_ring(px: DataFrame, flag: str, height: int, width: int, out: str = "ring") -> DataFrame:
    """The mask without its erosion."""
    inner = morph(px.select(*FRAME, "y", "x", F.col(flag).alias("_e")), "_e", "erode", height, width)
    return px.join(inner, [*FRAME, "y", "x"]).withColumn(out, F.col(flag) & ~F.col("_e")).drop("_e")


def median(px: DataFrame, cols: Sequence[str], side: int, height: int, width: int) -> DataFrame:
    """Median of a square neighbourhood, edges repeated: one frame at a time, by one shuffle of the pixels.

    An even side is made odd by one more; under 3 nothing changes.
    """
    from framelake.operators.raster import per_frame, taps

    if side < 3:
        return px.select(*FRAME, "y", "x", *cols)
    return per_frame(px, height, width, lambda frame: np.median([near for _, _, near in taps(frame, side // 2)], axis=0), tuple(cols), cols=tuple(cols))


def median3x3(px: DataFrame, cols: Sequence[str], height: int, width: int) -> DataFrame:
    return median(px, cols, 3, height, width)


def binomial_blur(px: DataFrame, cols: Sequence[str], strength: float, height: int, width: int) -> DataFrame:
    """Mixes in the 1-2-1 blur of the 3 x 3 neighbourhood, edges repeated."""
    rows = neighbours(px, square(3), height, width, "edge", cols)
    weight = (2 - F.abs("dy")) * (2 - F.abs("dx")) / 16.0
    own = (F.col("dy") == 0) & (F.col("dx") == 0)
    return _by(rows).agg(*[((1 - strength) * F.max(F.when(own, F.col(c))) + strength * F.sum(F.col(c) * weight)).alias(c) for c in cols])


def shade_rescue(px: DataFrame, index: str, subject: str, black: int, backdrop: int, height: int, width: int, chroma: float = 25.0, dark: float = 70.0) -> DataFrame:
    """Black pixels inside dark fill (no lit or empty pixel around) take the most frequent chromatic class of their 5 x 5; the smallest of equals. Votes read the input."""
    _, c, lum = C.hcl([F.col(x) for x in RGB])
    rows = px.select(*FRAME, "y", "x", index, F.col(subject).alias("_s"), c.alias("_c"), lum.alias("_l"))
    rows = rows.withColumns({"_dark": F.col("_s") & (F.col("_c") < chroma) & (F.col("_l") < dark), "_open": ~F.col("_s") | (F.col("_l") >= dark), "_hue": F.col("_s") & (F.col("_c") >= chroma) & (F.col(index) != black) & (F.col(index) != backdrop)})
    open_ = _by(neighbours(rows, square(3), height, width, "none", ["_open"])).agg(F.max("_open").alias("_near"))
    votes = neighbours(rows.where("_hue"), square(5), height, width, "none", [index]).groupBy(*FRAME, "y", "x", index).agg(F.count(F.lit(1)).alias("n"))
    best = votes.groupBy(*FRAME, "y", "x").agg(F.max(F.struct("n", (-F.col(index)).alias("nv"))).alias("b"))
    out = rows.join(open_, [*FRAME, "y", "x"]).join(best, [*FRAME, "y", "x"], "left")
    inside = F.col("_dark") & ~F.col("_near") & (F.col(index) == black) & F.col("b").isNotNull()
    return out.select(*FRAME, "y", "x", F.when(inside, -F.col("b.nv")).otherwise(F.col(index)).alias(index))
