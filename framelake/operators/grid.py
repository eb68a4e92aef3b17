"""Block reduction and recovery of the pixel grid of enlarged art."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framelake.functions import color as C
from framelake.operators.lineage import settle
from framelake.operators.palette import with_nearest

RGB = ("r", "g", "b")
FRAME = ("run_id", "frame")


def whole_cells(px: DataFrame, s: int, height: int, width: int, ox: int = 0, oy: int = 0) -> DataFrame:
    """Adds the cell (cy, cx) of side ``s`` from the offset; pixels of incomplete cells go."""
    y, x = F.col("y") - oy, F.col("x") - ox
    inside = (y >= 0) & (x >= 0) & (y < s * ((height - oy) // s)) & (x < s * ((width - ox) // s))
    return px.where(inside).withColumns({"cy": F.floor(y / s).cast("int"), "cx": F.floor(x / s).cast("int")})


def block_nearest(px: DataFrame, s: int, height: int, width: int) -> DataFrame:
    """The centre pixel of each cell."""
    rows = whole_cells(px, s, height, width).where((F.col("y") % s == s // 2) & (F.col("x") % s == s // 2))
    return rows.select(*FRAME, F.col("cy").alias("y"), F.col("cx").alias("x"), *RGB)


def trimmed_mean(cells: DataFrame, by: list[str], widths: tuple[float, ...] = (8.0,)) -> DataFrame:
    """Channel medians, then for each width the mean of the pixels within it of the last centre in all channels (or the first median if none is); rounded half to even."""
    mid = cells.groupBy(*by).agg(*[F.median(c).alias(f"m{c}") for c in RGB])
    rows = cells.join(mid, by)
    centre = {c: F.col(f"m{c}") for c in RGB}
    for i, width in enumerate(widths):
        close = C.max_diff([F.col(c) for c in RGB], [centre[c] for c in RGB]) <= width
        w = Window.partitionBy(*by)
        rows = rows.withColumns({f"t{i}{c}": F.coalesce(F.avg(F.when(close, F.col(c))).over(w), F.col(f"m{c}")) for c in RGB})
        centre = {c: F.col(f"t{i}{c}") for c in RGB}
    return rows.groupBy(*by).agg(*[F.rint(F.first(centre[c])).cast("int").alias(c) for c in RGB])


def block_trimmed_mean(px: DataFrame, s: int, height: int, width: int, widths: tuple[float, ...] = (8.0,)) -> DataFrame:
    return trimmed_mean(whole_cells(px, s, height, width), [*FRAME, "cy", "cx"], widths)


def block_masked(px: DataFrame, s: int, height: int, width: int, widths: tuple[float, ...] = (8.0,)) -> DataFrame:
    """As ``block_trimmed_mean``, but mixed cells use their opaque pixels only; alpha is that of most of the cell."""
    by = [*FRAME, "cy", "cx"]
    w = Window.partitionBy(*by)
    cells = whole_cells(px, s, height, width).withColumn("solid", F.sum((F.col("a") > 0.5).cast("int")).over(w))
    used = cells.where((F.col("solid") == 0) | (F.col("a") > 0.5))
    alpha = cells.groupBy(*by).agg((F.avg("a") > 0.5).cast("int").alias("a"))
    return trimmed_mean(used, by, widths).join(alpha, by)


def frac_cells(px: DataFrame, pitch_x: float, pitch_y: float, ox: float, oy: float) -> DataFrame:
    """Adds the cell of a lattice of any pitch that a pixel's centre is in."""
    cell = lambda c, o, p: F.floor((F.col(c) + 0.5 - o) / F.lit(p)).cast("int")
    return px.withColumns({"cy": cell("y", oy, pitch_y), "cx": cell("x", ox, pitch_x)})


def frac_reduce(px: DataFrame, pitch_x: float, pitch_y: float, ox: float = 0.0, oy: float = 0.0) -> DataFrame:
    """Trimmed mean of a fractional lattice's cells; alpha by the majority of opaque pixels."""
    by = [*FRAME, "cy", "cx"]
    cells = frac_cells(px, pitch_x, pitch_y, ox, oy)
    solid = F.sum((F.col("a") > 0.5).cast("int")).over(Window.partitionBy(*by))
    cells = cells.withColumn("solid", solid)
    alpha = cells.groupBy(*by).agg((F.avg((F.col("a") > 0.5).cast("int")) > 0.5).cast("int").alias("a"))
    return trimmed_mean(cells.where((F.col("solid") == 0) | (F.col("a") > 0.5)), by).join(alpha, by)


def block_modal(px: DataFrame, s: int, height: int, width: int, ox: int = 0, oy: int = 0) -> DataFrame:
    """The most frequent colour of each cell; of equally frequent ones the smallest."""
    by = [*FRAME, "cy", "cx"]
    counts = whole_cells(px, s, height, width, ox, oy).groupBy(*by, *RGB).agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy(*by).agg(F.min(F.struct((-F.col("n")).alias("o"), *RGB)).alias("best"))
    return best.select(*by, *[F.col(f"best.{c}").alias(c) for c in RGB], (-F.col("best.o")).alias("n"))


def block_scores(px: DataFrame, sizes: list[int], height: int, width: int, least_cells: int = 4) -> DataFrame:
    """(frame, s, ox, oy, score): share of the luminance variance between cells, for every size and offset.

    Candidates are a small literal array exploded against the pixels of a frame; all sums are partial.
    """
    cand = [(s, ox, oy) for s in sizes for ox in range(s) for oy in range(s) if (height - oy) // s >= least_cells and (width - ox) // s >= least_cells]
    lit = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(ox).alias("ox"), F.lit(oy).alias("oy")) for s, ox, oy in cand])
    rows = px.select(*FRAME, "y", "x", C.luminance([F.col(c) for c in RGB]).alias("v"), F.explode(lit).alias("c")).select(*FRAME, "y", "x", "v", "c.*")
    y, x, s = F.col("y") - F.col("oy"), F.col("x") - F.col("ox"), F.col("s")
    inside = (y >= 0) & (x >= 0) & (y < s * F.floor((height - F.col("oy")) / s)) & (x < s * F.floor((width - F.col("ox")) / s))
    cells = rows.where(inside).groupBy(*FRAME, "s", "ox", "oy", F.floor(y / s).alias("cy"), F.floor(x / s).alias("cx")).agg(F.var_pop("v").alias("within"), F.avg("v").alias("mean"))
    total = cells.groupBy(*FRAME, "s", "ox", "oy").agg(F.avg("within").alias("within"), F.var_pop("mean").alias("between"))
    return total.withColumn("score", F.col("between") / (F.col("within") + F.col("between") + 1e-6)).drop("within", "between")


def choose_block(scores: DataFrame, least: float = 0.55, pool: float = 0.9) -> DataFrame:
    """Of the candidates within ``pool`` of the best score the smallest block, then the better score; none under ``least``."""
    w = Window.partitionBy(*FRAME)
    rows = scores.withColumn("best", F.max("score").over(w)).where((F.col("best") >= least) & (F.col("score") >= pool * F.col("best")))
    pick = rows.groupBy(*FRAME).agg(F.min(F.struct("s", (-F.col("score")).alias("o"), "ox", "oy")).alias("p"))
    return pick.select(*FRAME, F.col("p.s").alias("s"), F.col("p.ox").alias("ox"), F.col("p.oy").alias("oy"), (-F.col("p.o")).alias("score"))


def autocorrelation(profile: DataFrame, by: list[str], lags: int, top: int = 3) -> DataFrame:
    """(by, lag, corr): the strongest local maxima over 0.05 of a centred profile's autocorrelation.

    ``profile`` has (by, pos, v), some hundreds of positions a group: one array a group, no join.
    """
    arr = profile.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("pos", "v"))).alias("s")).select(*by, F.transform("s", lambda e: e["v"]).alias("v"))
    mean = F.aggregate("v", F.lit(0.0), lambda a, e: a + e) / F.size("v")
    arr = arr.withColumn("m", mean).withColumn("v", F.transform("v", lambda e: e - F.col("m")))
    power = F.aggregate("v", F.lit(0.0), lambda a, e: a + e * e)
    corr = F.transform(F.sequence(F.lit(0), F.lit(lags + 1)), lambda k: F.aggregate(F.zip_with(F.expr("v"), F.slice(F.col("v"), k + 1, F.size("v")), lambda p, q: F.coalesce(p * q, F.lit(0.0))), F.lit(0.0), lambda a, e: a + e))
    arr = arr.withColumn("p", power).withColumn("c", corr).where("p > 0")
    rows = arr.select(*by, F.posexplode(F.transform("c", lambda e: e / F.col("p"))).alias("lag", "corr"))
    w = Window.partitionBy(*by).orderBy("lag")
    rows = rows.withColumn("lo", F.lag("corr").over(w)).withColumn("hi", F.lead("corr").over(w))
    peaks = rows.where((F.col("lag").between(2, lags)) & (F.col("corr") > 0.05) & (F.col("corr") >= F.col("lo")) & (F.col("corr") >= F.col("hi")))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(F.round("corr", 9)), "lag"))
    return peaks.withColumn("rank", rank).where(F.col("rank") <= top).select(*by, "lag", "corr", "rank")


def edge_profile(px: DataFrame, weight: Column | None = None) -> DataFrame:
    """(run, frame, pos, v): summed luminance steps between neighbouring columns; with a weight, their mean by the two pixels' mean weight."""
    w = Window.partitionBy(*FRAME, "y").orderBy("x")
    lum = C.luminance([F.col(c) for c in RGB])
    rows = px.withColumn("v", lum).withColumn("d", F.abs(F.lead("v").over(w) - F.col("v")))
    total = F.sum("d")
    if weight is not None:
        rows = rows.withColumn("_w", weight).withColumn("_w", (F.col("_w") + F.lead("_w").over(w)) / 2)
        total = F.sum(F.col("d") * F.col("_w")) / F.greatest(F.sum("_w"), F.lit(1e-6))
    return rows.where(F.col("d").isNotNull()).groupBy(*FRAME, F.col("x").alias("pos")).agg(total.alias("v"))


def edge_peaks(profile: DataFrame, by: list[str], share: float = 0.88) -> DataFrame:
    """(by, at, energy): local maxima at or over the quantile, with parabolic sub-pixel places; groups of under 8 have none."""
    w = Window.partitionBy(*by)
    o = w.orderBy("pos")
    rows = profile.withColumns({"n": F.count(F.lit(1)).over(w), "t": F.expr(f"percentile(v, {share})").over(w), "lo": F.lag("v").over(o), "hi": F.lead("v").over(o)})
    v, lo, hi = F.col("v"), F.col("lo"), F.col("hi")
    peak = rows.where((F.col("n") >= 8) & lo.isNotNull() & hi.isNotNull() & (v >= F.col("t")) & (v >= lo) & (v >= hi))
    bend = lo - 2 * v + hi
    shift = F.when(bend > 1e-9, 0.5 * (lo - hi) / bend).otherwise(0.0)
    return peak.select(*by, (F.col("pos") + 1 + F.least(F.greatest(shift, C.d(-0.5)), C.d(0.5))).alias("at"), v.alias("energy"))


def lattice_recall(peaks: DataFrame, by: list[str], pitch: float | Column, tolerance: float = 1.2, phases: int = 160) -> DataFrame:
    """(by, recall, phase): the best phase of a lattice by the share of edge energy within tolerance; the first of equal ones.

    A pitch may be a column that is the same for all peaks of a group.
    """
    step = pitch / phases
    pitch, step = (x if isinstance(x, Column) else F.lit(x) for x in (pitch, step))
    o = F.explode(F.sequence(F.lit(0), F.lit(phases - 1))).alias("i")
    rows = peaks.select("*", o).withColumn("o", F.col("i") * step)
    k = F.rint((F.col("at") - F.col("o")) / pitch)
    on = F.abs(F.col("at") - (F.col("o") + k * pitch)) <= tolerance
    got = rows.groupBy(*by, "i", "o").agg((F.sum(F.when(on, F.col("energy")).otherwise(0.0)) / F.sum("energy")).alias("r"))
    best = got.groupBy(*by).agg(F.min(F.struct((-F.round("r", 9)).alias("n"), "i", "o")).alias("b"))
    return best.select(*by, (-F.col("b.n")).alias("recall"), F.col("b.o").alias("phase"))


def within_cell_std(px: DataFrame, pitch: float, ox: float = 0.0, oy: float = 0.0, weight: Column | None = None) -> DataFrame:
    """(frame, std): pooled weighted deviation of luminance in the cells of a fractional lattice."""
    wgt = weight if weight is not None else F.lit(1.0)
    cells = frac_cells(px, pitch, pitch, ox, oy).withColumn("v", C.luminance([F.col(c) for c in RGB])).withColumn("w", wgt)
    part = cells.groupBy(*FRAME, "cy", "cx").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("v")).alias("wv"), F.sum(F.col("w") * F.col("v") * F.col("v")).alias("wvv"))
    spread = F.greatest(F.col("wvv") - F.col("wv") * F.col("wv") / F.col("w"), F.lit(0.0))
    return part.where("w > 0").groupBy(*FRAME).agg(F.sqrt(F.sum(spread) / F.sum("w")).alias("std"))


def _cell_spread(v: np.ndarray, w: np.ndarray, fixed: tuple[float, float]):
    """f(pitch, phase) along the second axis: the pooled deviation of v in lattice cells, the first axis' lattice being fixed.

    Rows of one cell row are summed once; a candidate then only cuts these sums into runs.
    """
    row = np.floor((np.arange(v.shape[0]) + 0.5 - fixed[1]) / fixed[0])
    cut = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    wv, ws = np.add.reduceat(w * v, cut, 0), np.add.reduceat(w, cut, 0)
    whole, weight, place = float((w * v * v).sum()), float(w.sum()), np.arange(v.shape[1]) + 0.5

    def of(pitch: float, phase: float) -> float:
        col = np.floor((place - phase) / pitch)
        at = np.flatnonzero(np.append(True, col[1:] != col[:-1]))
        a, b = np.add.reduceat(wv, at, 1), np.add.reduceat(ws, at, 1)
        inside = whole - float(np.divide(a * a, b, out=np.zeros_like(a), where=b > 0).sum())
        return round(float(np.sqrt(max(inside, 0.0) / weight)), 9) if weight else 0.0

    return of


def _least(of, pitches, phases) -> tuple[float, float, float]:
    """(deviation, pitch, phase): the least, the first of equal ones."""
    return min(((of(p, o), p, o) for p in pitches for o in phases), key=lambda x: x[0])


def _steps(lo: float, hi: float, step: float) -> list[float]:
    return [lo + i * step for i in range(int((hi - lo) / step + 1e-6) + 1)]


def fit_lattice(px: DataFrame, found: DataFrame, height: int, width: int, pitch_reach: float = 0.06, pitch_step: float = 0.0025, phase_reach: float = 1.3, phase_step: float = 0.0625, least_cells: int = 4, least_pitch: float = 2.5, weight: Column | None = None) -> DataFrame:
    """(frame, pitch_x, phase_x, pitch_y, phase_y, std): lattices refined to the least deviation of luminance inside their cells.

    ``found`` (frame, pitch_x, phase_x, pitch_y, phase_y) has one row a frame. First x moves with y
    fixed, then y with the new x. A pitch within 0.05 of the frame's side over a whole number (``least_cells`` at
    least) becomes exactly that if a phase near 0, or else near the fitted one, has at most 1.15 times the deviation.
    One frame at a time.
    """
    names = ["pitch_x", "phase_x", "pitch_y", "phase_y"]
    lum = C.luminance([F.col(c) for c in RGB])
    src = px.select(*[F.col(c).cast("long").alias(c) for c in (*FRAME, "y", "x")], lum.alias("v"), (weight if weight is not None else F.lit(1.0)).cast("double").alias("w"))

    def refine(of, p0: float, o0: float) -> tuple[float, float]:
        _, p, o = _least(of, _steps(max(least_pitch, p0 - pitch_reach), p0 + pitch_reach, pitch_step), _steps(o0 - phase_reach, o0 + phase_reach, phase_step))
        return round(p, 4), round(o, 4)

    def snap(of, p: float, o: float, side: int) -> tuple[float, float]:
        n = round(side / p)
        if n < least_cells or abs(side / n - p) > 0.05:
            return p, o
        near, zero = (_least(of, [side / n], _steps(c - 0.25, c + 0.25, 0.0625)) for c in (o, 0.0))
        most = 1.15 * of(p, o)
        for std, pitch, phase in ([zero] if zero[0] <= 1.15 * near[0] else []) + [near]:
            if std <= most:
                return round(pitch, 4), round(phase, 4)
        return p, o

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        if left.num_rows and right.num_rows:
            v, w = np.zeros((height, width)), np.zeros((height, width))
            at = left["y"].to_numpy(), left["x"].to_numpy()
            v[at], w[at] = left["v"].to_numpy(), left["w"].to_numpy()
            x, xo, y, yo = (float(right[c][0].as_py()) for c in names)
            x, xo = refine(_cell_spread(v, w, (y, yo)), x, xo)
            y, yo = refine(_cell_spread(v.T, w.T, (x, xo)), y, yo)
            x, xo = snap(_cell_spread(v, w, (y, yo)), x, xo, width)
            y, yo = snap(_cell_spread(v.T, w.T, (x, xo)), y, yo, height)
            rows = [(key[0].as_py(), key[1].as_py(), x, xo, y, yo, _cell_spread(v, w, (y, yo))(x, xo))]
        cols = list(zip(*rows, strict=True)) or [()] * 7
        kinds = [pa.int64()] * 2 + [pa.float64()] * 5
        return pa.table([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], [*FRAME, *names, "std"])

    start = found.select(*[F.col(c).cast("long").alias(c) for c in FRAME], *[F.col(c).cast("double").alias(c) for c in names])
    return src.groupBy(*FRAME).cogroup(start.groupBy(*FRAME)).applyInArrow(run, ", ".join([*(f"{c} long" for c in FRAME), *(f"{c} double" for c in (*names, "std"))]))


def find_lattice(px: DataFrame, hint: float, height: int, width: int, least_peaks: int = 16, weight: Column | None = None) -> DataFrame:
    """(frame, pitch_x, phase_x, pitch_y, phase_y, recall, whole_recall, excess) of frames with a proven fractional lattice near a whole pitch.

    Pitches around the hint, twice and half of it are scanned on both axes' edge peaks; the choice is
    refined (``fit_lattice``), and accepted before and after that by ``lattice_holds``.
    """
    by = list(FRAME)
    around = sorted({round(p, 3) for base in (hint, 2 * hint, hint / 2) for p in _steps(max(2.5, base - 1.25), min(16.0, base + 1.25), 0.025)})
    turned = px.withColumnsRenamed({"x": "_y", "y": "x"}).withColumnRenamed("_y", "y")
    found = None
    for axis, rows in (("x", px), ("y", turned)):
        peaks = edge_peaks(edge_profile(rows, weight), by)
        many = peaks.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum("energy").alias("e")).where((F.col("n") >= least_peaks) & (F.col("e") > 0)).select(*by)
        peaks = settle(peaks.join(many, by))
        best = choose_pitch(pitch_scan(peaks, by, around), by)
        own = lattice_recall(peaks.join(best.select(*by, "pitch"), by), by, F.col("pitch"), phases=240)
        whole = lattice_recall(peaks, by, float(hint)).select(*by, F.col("recall").alias(f"whole_{axis}"))
        held = peaks.groupBy(*by).agg(F.collect_list(F.struct("at", "energy")).alias(f"peaks_{axis}"))
        side = best.select(*by, F.col("pitch").alias(f"pitch_{axis}")).join(own.select(*by, F.col("recall").alias(f"recall_{axis}"), F.col("phase").alias(f"phase_{axis}")), by).join(whole, by).join(held, by)
        found = side if found is None else found.join(side, by)
    found = settle(found.where(lattice_holds()))
    fit = settle(fit_lattice(px, found, height, width, weight=weight))
    rows = fit.join(found.select(*by, "whole_x", "whole_y", "peaks_x", "peaks_y"), by)
    for axis in "xy":
        again = rows.select(*by, F.col(f"pitch_{axis}").alias("pitch"), F.explode(f"peaks_{axis}").alias("p")).select(*by, "pitch", "p.*")
        rows = rows.join(lattice_recall(again, by, F.col("pitch")).select(*by, F.col("recall").alias(f"recall_{axis}")), by)
    excess = F.least(*[F.col(f"recall_{a}") - F.least(F.lit(1.0), 2.4 / F.col(f"pitch_{a}")) for a in "xy"])
    return rows.where(lattice_holds()).select(*by, "pitch_x", "phase_x", "pitch_y", "phase_y", ((F.col("recall_x") + F.col("recall_y")) / 2).alias("recall"), ((F.col("whole_x") + F.col("whole_y")) / 2).alias("whole_recall"), excess.alias("excess"))


def lattice_holds(tolerance: float = 1.2) -> Column:
    """Whether both axes' recall (recall_x, recall_y) is 0.6 or more, 0.45 over chance, and 1.35 times that of the whole pitch (whole_x, whole_y), and the pitches agree within 4 %."""
    ok = F.abs(F.col("pitch_x") - F.col("pitch_y")) <= 0.04 * F.least("pitch_x", "pitch_y")
    for a in "xy":
        r, p = F.col(f"recall_{a}"), F.col(f"pitch_{a}")
        ok = ok & (r >= 0.6) & (r - F.least(F.lit(1.0), 2 * tolerance / p) >= 0.45) & (r >= 1.35 * F.greatest(F.col(f"whole_{a}"), F.lit(1e-6)))
    return ok


def pitch_scan(peaks: DataFrame, by: list[str], pitches: list[float], tolerance: float = 1.2, phases: int = 160) -> DataFrame:
    """(by, pitch, recall, excess): for each pitch the best phase's share of edge energy, and how far it is over chance."""
    lits = F.array(*[F.lit(float(p)) for p in pitches])
    rows = peaks.select(*by, "at", "energy", F.explode(lits).alias("pitch")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(phases - 1))))
    p, o = F.col("pitch"), F.col("i") * (F.col("pitch") / phases)
    on = F.abs(F.col("at") - (o + F.rint((F.col("at") - o) / p) * p)) <= tolerance
    got = rows.groupBy(*by, "pitch", "i").agg((F.sum(F.when(on, F.col("energy")).otherwise(0.0)) / F.sum("energy")).alias("r"))
    chance = F.least(F.lit(1.0), 2 * tolerance / p)
    return got.groupBy(*by, "pitch").agg(F.max(F.round("r", 9)).alias("recall")).withColumn("excess", F.col("recall") - chance)


def choose_pitch(scores: DataFrame, by: list[str], pool: float = 0.98) -> DataFrame:
    """(by, pitch, recall, excess): of the pitches within ``pool`` of the best excess the largest; those without recall don't count."""
    rows = scores.where(F.col("recall") > 0).withColumn("best", F.max("excess").over(Window.partitionBy(*by)))
    near = rows.where(F.col("excess") >= pool * F.col("best"))
    pick = near.groupBy(*by).agg(F.max(F.struct("pitch", "recall", "excess")).alias("p"))
    return pick.select(*by, "p.*")


def extreme_support(px: DataFrame, cells: DataFrame, palette: DataFrame, s: int, height: int, width: int, reach: float = 12.0, share: float = 0.1, least: int = 3, gap: float = 40.0) -> DataFrame:
    """``cells`` (frame, cy, cx, r, g, b) with the label ``k`` of the lightest family of a palette that takes over the cell, or null.

    It needs ``least`` opaque pixels and a ``share`` of the cell's, and the cell must be darker than the lightest entry by
    ``gap``. Labels are counted a cell; of equally frequent ones the first.
    """
    by = [*FRAME, "cy", "cx"]
    lum = C.luminance([F.col(c) for c in RGB])
    top = palette.agg(F.max(lum)).first()[0]  # one number
    light = [r[0] for r in palette.where(lum >= top - reach).select("k").orderBy("k").collect()]  # at most the palette's entries
    labels = with_nearest(whole_cells(px.where("a > 0.5"), s, height, width), palette, "redmean")
    counts = labels.groupBy(*by, "k").agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.when(F.col("k").isin(light), F.struct((-F.col("n")).alias("o"), "k")))
    votes = counts.groupBy(*by).agg(F.sum("n").alias("total"), best.alias("best"))
    enough = -F.col("best.o") >= F.greatest(F.lit(float(least)), share * F.col("total"))
    rows = cells.join(votes, by, "left")
    return rows.select(*cells.columns, F.when(enough & (lum <= top - gap), F.col("best.k")).alias("k"))
