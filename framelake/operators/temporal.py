"""Temporal operators: one series a cell, in frame order.

Rules that look at raw neighbours are window functions. Rules that look at their own corrected past
are folds over one cell's array of frames (``fold``): the array is one cell of one clip, so it is
bounded by the clip's length, and cells are dealt over all tasks by their key.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framelake.functions import color as C

CELL = ("run_id", "y", "x")
RGB = ("r", "g", "b")


def _w(by, order) -> Window:
    return Window.partitionBy(*by).orderBy(order)


def fold(df: DataFrame, by: list[str], order: str, cols: list[str], state: dict[str, str], emit: dict[str, str], step: Callable[[Column, Column, Column], dict[str, Column]]) -> DataFrame:
    """Folds each series in order. ``state`` and ``emit``: names and types of what is carried and what
    is emitted a frame; ``step(acc, x, first)`` gives the new value of each.
    """
    kinds = dict(df.dtypes)
    out = f"array<struct<`{order}`:{kinds[order]},{','.join(f'`{n}`:{t}' for n, t in emit.items())}>>"
    whole = df.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(order, *[c for c in cols if c != order]))).alias("_all"))
    zero = F.struct(*[F.lit(None).cast(t).alias(n) for n, t in state.items()], F.array().cast(out).alias("_out"))

    def go(acc: Column, x: Column) -> Column:
        new = step(acc, x, F.size(acc["_out"]) == 0)
        row = F.struct(x[order].alias(order), *[new[n].cast(t).alias(n) for n, t in emit.items()])
        return F.struct(*[new[n].cast(t).alias(n) for n, t in state.items()], F.array_append(acc["_out"], row).alias("_out"))

    return whole.select(*by, F.inline(F.aggregate("_all", zero, go, lambda acc: acc["_out"])))


def median3(df: DataFrame, cols: list[str], by: list[str], order: str = "frame") -> DataFrame:
    """Median of a frame and its neighbours, ends repeated."""
    w = _w(by, order)

    def mid(c: str) -> Column:
        v = F.col(c)
        a, b = F.coalesce(F.lag(c).over(w), v), F.coalesce(F.lead(c).over(w), v)
        return a + b + v - F.greatest(a, b, v) - F.least(a, b, v)

    return df.withColumns({c: mid(c) for c in cols})


def median3_inner(px: DataFrame, by: list[str], order: str = "frame") -> DataFrame:
    """Median of three where all three are opaque; the ends stay."""
    w = _w(by, order)
    before, after = F.lag("a").over(w), F.lead("a").over(w)
    inner = (before > 0.5) & (F.col("a") > 0.5) & (after > 0.5)

    def mid(c: str) -> Column:
        v, p, n = F.col(c), F.lag(c).over(w), F.lead(c).over(w)
        return F.when(inner, p + n + v - F.greatest(p, n, v) - F.least(p, n, v)).otherwise(v)

    return px.withColumns({c: mid(c) for c in RGB})


def vote3(df: DataFrame, flag: Column, by: list[str], order: str = "frame", out: str = "voted") -> DataFrame:
    """True where at least two of the frame and its neighbours are; at the ends both must be."""
    w = _w(by, order).rowsBetween(-1, 1)
    return df.withColumn(out, F.sum(flag.cast("int")).over(w) >= 2)


def guarded_vote(df: DataFrame, voted: str, full: str, tight: str, strong: str, out: str = "keyed") -> DataFrame:
    """The vote, except on strong foreground; and the frame's own key where it is tight or strong foreground."""
    v, f, t, s = (F.col(c) for c in (voted, full, tight, strong))
    return df.withColumn(out, (v & ~s) | (f & (t | s)))


def motion(px: DataFrame, by: list[str] = list(CELL), order: str = "frame") -> DataFrame:
    """Adds the largest channel step from the frame before; null in the first frame."""
    w = _w(by, order)
    return px.withColumn("motion", C.max_diff([F.col(c) for c in RGB], [F.lag(c).over(w) for c in RGB]))


def static_cells(px: DataFrame, threshold: float, height: int, width: int) -> DataFrame:
    """(run, y, x, static): the median step is under the threshold here and at all four neighbours, wrapped at the edges."""
    med = motion(px).where("motion IS NOT NULL").groupBy(*CELL).agg((F.median("motion") < threshold).alias("still"))
    offs = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))])
    near = med.select("run_id", "y", "x", "still", F.explode(offs).alias("o"))
    to = near.select("run_id", F.pmod(F.col("y") + F.col("o.dy"), F.lit(height)).alias("y"), F.pmod(F.col("x") + F.col("o.dx"), F.lit(width)).alias("x"), "still")
    return to.groupBy(*CELL).agg(F.min("still").alias("static"))


def noise_blend(df: DataFrame, value: str, beta: float, by: list[str], order: str) -> DataFrame:
    """Mixes the first value into all later ones, keeping variance: sqrt(1 - b b) x + b x0."""
    first = F.first(value).over(_w(by, order))
    return df.withColumn(value, F.when(F.col(order) == F.min(order).over(Window.partitionBy(*by)), F.col(value)).otherwise((1 - beta * beta) ** 0.5 * F.col(value) + beta * first))


def loop_ramp(df: DataFrame, value: str, strength: float, by: list[str], order: str) -> DataFrame:
    """Leads the series back to its first value: weight strength * (t / (n - 1)) squared."""
    all_ = Window.partitionBy(*by)
    t = (F.row_number().over(_w(by, order)) - 1) / F.greatest(F.count(F.lit(1)).over(all_) - 1, F.lit(1))
    first = F.first(value).over(_w(by, order))
    return df.withColumn("_wt", strength * t * t).withColumn(value, F.sqrt(1 - F.col("_wt") * F.col("_wt")) * F.col(value) + F.col("_wt") * first).drop("_wt")


def despike(df: DataFrame, cols: list[str], threshold: float, by: list[str], order: str = "frame") -> DataFrame:
    """A frame that leaves the corrected one before it, to which the next frame returns, becomes it. The ends stay."""
    w = _w(by, order)
    rows = df.select(*by, order, *cols, *[F.lead(c).over(w).alias(f"n_{c}") for c in cols])

    def step(acc, x, first):
        prev = [acc[c] for c in cols]
        blip = ~first & x[f"n_{cols[0]}"].isNotNull() & (C.max_diff([x[c] for c in cols], prev) > threshold) & (C.max_diff([x[f"n_{c}"] for c in cols], prev) <= threshold)
        return {c: F.when(F.coalesce(blip, F.lit(False)), acc[c]).otherwise(x[c]) for c in cols}

    kinds = {c: dict(df.dtypes)[c] for c in cols}
    return fold(rows, by, order, [*cols, *[f"n_{c}" for c in cols]], kinds, kinds, step)


def despike_matte(px: DataFrame, threshold: float, by: list[str] = list(CELL), order: str = "frame") -> DataFrame:
    """Despikes colours and, by itself, the matte; a pixel made opaque again takes the colour of the frame before."""
    colours = despike(px, list(RGB), threshold, by, order)
    rows = colours.join(px.select(*by, order, "a"), [*by, order])
    rows = rows.withColumn("n_a", F.lead("a").over(_w(by, order)))

    def step(acc, x, first):
        prev, cur, nxt = acc["a"] > 0.5, x["a"] > 0.5, x["n_a"] > 0.5
        blip = F.coalesce(~first & x["n_a"].isNotNull() & (cur != prev) & (nxt == prev), F.lit(False))
        again = blip & prev & ~cur
        return {c: F.when(again, acc[c]).otherwise(x[c]) for c in RGB} | {"a": F.when(blip, acc["a"]).otherwise(x["a"])}

    kinds = {c: dict(px.dtypes)[c] for c in (*RGB, "a")}
    return fold(rows, by, order, [*RGB, "a", "n_a"], kinds, kinds, step)


def minrun(df: DataFrame, state: str, by: list[str], order: str = "frame") -> DataFrame:
    """Erases excursions of two frames, then of one, that return to the state before them; in place, twice."""
    whole = df.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(order, state))).alias("_all"))
    whole = whole.withColumn("_s", F.transform("_all", lambda e: e[state])).withColumn("_n", F.size("_all"))
    n = F.col("_n")

    def put(s: Column, t: Column, width: int) -> Column:
        return F.transform(s, lambda v, i: F.when((i >= t) & (i < t + width), F.element_at(s, t)).otherwise(v))

    def two(s: Column, t: Column) -> Column:
        at = lambda k: F.element_at(s, t + k + 1)
        return F.when((at(0) == at(1)) & (at(0) != at(-1)) & (at(2) == at(-1)), put(s, t, 2)).otherwise(s)

    def one(s: Column, t: Column) -> Column:
        at = lambda k: F.element_at(s, t + k + 1)
        return F.when((at(0) != at(-1)) & (at(1) == at(-1)), put(s, t, 1)).otherwise(s)

    for rule, last in ((two, 3), (one, 2)) * 2:
        whole = whole.withColumn("_s", F.when(n > last, F.aggregate(F.sequence(F.lit(1), F.greatest(n - last, F.lit(1))), F.col("_s"), rule)).otherwise(F.col("_s")))
    return whole.select(*by, F.posexplode("_s").alias("_i", state), "_all").select(*by, F.element_at("_all", F.col("_i") + 1)[order].alias(order), state)


def hysteresis(df: DataFrame, cols: list[str], threshold: float, commit: int, hold: int, by: list[str], order: str = "frame") -> DataFrame:
    """Commits a change when it has lasted ``commit`` frames, or when no return was seen for ``hold`` frames. Series of under three frames stay."""
    rows = df.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*by)))

    def step(acc, x, first):
        v = [x[c] for c in cols]
        now, cand = [acc[c] for c in cols], [acc[f"c_{c}"] for c in cols]
        stable = C.max_diff(v, now) <= threshold
        match = C.max_diff(v, cand) <= threshold
        run, stale = F.when(match, acc["run"] + 1).otherwise(1), F.when(stable, 0).otherwise(acc["stale"] + 1)
        fire = ~stable & ((run >= commit) | (stale >= hold))
        start = first | (x["_n"] < 3)
        new = [F.when(start | fire, a).otherwise(b) for a, b in zip(v, now, strict=True)]
        reset = start | fire | stable
        return (
            dict(zip(cols, new, strict=True))
            | {f"c_{c}": F.when(reset, n).when(match, k).otherwise(a) for c, n, k, a in zip(cols, new, cand, v, strict=True)}
            | {"run": F.when(reset, 0).otherwise(run), "stale": F.when(reset, 0).otherwise(stale)}
        )

    kinds = {c: dict(df.dtypes)[c] for c in cols}
    return fold(rows, by, order, [*cols, "_n"], kinds | {f"c_{c}": t for c, t in kinds.items()} | {"run": "int", "stale": "int"}, kinds, step)


def matte_lock(df: DataFrame, flag: str, commit: int, by: list[str], order: str = "frame", out: str = "locked") -> DataFrame:
    """A matte flips only when it has disagreed for ``commit`` frames in a row."""

    def step(acc, x, first):
        other = x[flag] != acc[out]
        run = F.when(other, acc["run"] + 1).otherwise(0)
        fire = first | (other & (run >= commit))
        return {out: F.when(fire, x[flag]).otherwise(acc[out]), "run": F.when(fire, 0).otherwise(run)}

    return fold(df, by, order, [flag], {out: "boolean", "run": "int"}, {out: "boolean"}, step)


def lockdown(px: DataFrame, threshold: float, commit: int, hold: int, by: list[str] = list(CELL), order: str = "frame") -> DataFrame:
    """Hysteresis on colours and the lock on the matte; pixels that only the lock keeps opaque take the colour of the frame before."""
    rows = px.withColumn("_raw", F.col("a") > 0.5)
    locked = matte_lock(rows, "_raw", commit, by, order)
    steady = hysteresis(px, list(RGB), threshold, commit, hold, by, order)
    rows = steady.join(locked, [*by, order]).join(rows.select(*by, order, "_raw"), [*by, order])

    def step(acc, x, first):
        hole = ~first & x["locked"] & ~x["_raw"]
        return {c: F.when(hole, acc[c]).otherwise(x[c]) for c in RGB} | {"a": F.when(x["locked"], 1.0).otherwise(0.0)}

    kinds = {c: dict(px.dtypes)[c] for c in RGB}
    return fold(rows, by, order, [*RGB, "locked", "_raw"], kinds, kinds | {"a": "double"}, step)


def sticky_labels(px: DataFrame, palette: DataFrame, margin: float, by: list[str] = list(CELL), order: str = "frame") -> DataFrame:
    """Nearest palette entry, but the one of the frame before while its squared distance is at most 1 + margin times the nearest's."""
    from framelake.operators.palette import as_array

    cols = lambda e: [e[c] for c in RGB]
    dist = F.transform(as_array(palette), lambda e: C.euclid2([F.col(c) for c in RGB], cols(e)))
    rows = px.select(*by, order, dist.alias("_d"))
    rows = rows.withColumn("_near", F.array_position("_d", F.array_min("_d")).cast("int") - 1)

    def step(acc, x, first):
        keep = ~first & (F.element_at(x["_d"], acc["k"] + 1) <= F.element_at(x["_d"], x["_near"] + 1) * (1 + margin))
        return {"k": F.when(F.coalesce(keep, F.lit(False)), acc["k"]).otherwise(x["_near"])}

    return fold(rows, by, order, ["_d", "_near"], {"k": "int"}, {"k": "int"}, step)


def band_hysteresis(df: DataFrame, ratio: str, bands: int, shadow: float, highlight: float, near: float, bounds: list[float], by: list[str], order: str = "frame") -> DataFrame:
    """Bands of a ratio; within ``near`` of a bound the band of the frame before stays."""
    rows = df.select(*by, order, F.col(ratio).alias("_v"), C.band_of_ratio(F.col(ratio), bands, shadow, highlight).alias("_b"))

    def step(acc, x, first):
        close = F.lit(False)
        for b in bounds:
            close = close | (F.abs(x["_v"] - b) < near)
        return {"band": F.when(~first & close, acc["band"]).otherwise(x["_b"])}

    return fold(rows, by, order, ["_v", "_b"], {"band": "int"}, {"band": "int"}, step)


def keep_changes(df: DataFrame, value: str, threshold: float, by: list[str], order: str) -> DataFrame:
    """(by, order, value, duration): the entries that differ by more than the threshold from the last kept one, and how many entries each stands for."""

    def step(acc, x, first):
        new = first | (F.abs(x[value] - acc["anchor"]) > threshold)
        return {"anchor": F.when(new, x[value]).otherwise(acc["anchor"]), value: x[value], "kept": new}

    kind = dict(df.dtypes)[value]
    rows = fold(df, by, order, [value], {"anchor": kind}, {value: kind, "kept": "boolean"}, step)
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    rows = rows.withColumn("_n", n).where("kept")
    following = F.lead(order).over(_w(by, order))
    return rows.withColumn("duration", F.coalesce(following, F.col("_n")) - F.col(order)).drop("_n", "kept")


def frame_pair_error(px: DataFrame, other: DataFrame, keys: list[str], matte: bool = True) -> DataFrame:
    """Mean visible difference of paired frames (``other`` has the same pixels under o_r, o_g, o_b, o_a).

    With a matte: half the mean, over pixels opaque in either, of the premultiplied colour step plus the
    matte step; 0 where nothing is opaque. Colours count from 0 to 1.
    """
    both = px.join(other, [*keys, "y", "x"])
    if not matte:
        diff = sum(F.abs(F.col(c) - F.col(f"o_{c}")) for c in RGB) / (3 * 255.0)
        return both.groupBy(*keys).agg(F.avg(diff).alias("err"))
    diff = sum(F.abs(F.col(c) * F.col("a") - F.col(f"o_{c}") * F.col("o_a")) for c in RGB) / (3 * 255.0) + F.abs(F.col("a") - F.col("o_a"))
    seen = (F.col("a") > 0.5) | (F.col("o_a") > 0.5)
    return both.groupBy(*keys).agg(F.coalesce(F.avg(F.when(seen, diff)) / 2, F.lit(0.0)).alias("err"))


def loop_trim(px: DataFrame, share: float, most: float, run: str = "run_id") -> DataFrame:
    """(run, n, cut, err): where each run best returns to its first frame within the last ``share``; cut is n if no error is at most ``most``."""
    n = px.groupBy(run).agg((F.max("frame") + 1).alias("n"))
    first = px.where("frame = 0").select(run, "y", "x", *[F.col(c).alias(f"o_{c}") for c in (*RGB, "a")])
    tail = px.join(n, run).where(F.col("frame") >= F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(1 - share)))).drop("n")
    keys = [run, "frame"]
    pairs = tail.join(first, [run, "y", "x"]).select(*keys, "y", "x", *RGB, "a", *[f"o_{c}" for c in (*RGB, "a")])
    diff = sum(F.abs(F.col(c) * F.col("a") - F.col(f"o_{c}") * F.col("o_a")) for c in RGB) / (3 * 255.0) + F.abs(F.col("a") - F.col("o_a"))
    seen = (F.col("a") > 0.5) | (F.col("o_a") > 0.5)
    err = pairs.groupBy(*keys).agg(F.coalesce(F.avg(F.when(seen, diff)) / 2, F.lit(0.0)).alias("err"))
    best = err.groupBy(run).agg(F.min(F.struct(F.round("err", 9).alias("e"), "frame")).alias("b"))
    return n.join(best, run).select(run, "n", F.when((F.col("n") >= 3) & (F.col("b.e") <= most), F.col("b.frame")).otherwise(F.col("n")).alias("cut"), F.col("b.e").alias("err"))


def dedup_frames(px: DataFrame, threshold: float, by: str = "run_id", matte: bool = True) -> DataFrame:
    """(by, frame, duration): frames that differ by more than the threshold from the last kept one, and how many frames each stands for.

    The difference is that of ``frame_pair_error``, by one division of whole numbers where channels and mattes are whole: so one of
    exactly the threshold is not more, whatever the order of pixels. Each frame is compared with one that depends on
    all before it, so a clip is one group: its frames are read in order, two at a time.
    """
    cols = [*RGB, *(["a"] if matte else [])]
    src = px.select(F.col(by).cast("long").alias(by), *[F.col(c).cast("long").alias(c) for c in ("frame", "y", "x")], *[F.col(c).cast("double").alias(c) for c in cols])

    def run(clip: pa.Table) -> pa.Table:
        clip = clip.sort_by([("frame", "ascending"), ("y", "ascending"), ("x", "ascending")])
        number, first = np.unique(clip["frame"].to_numpy(), return_index=True)
        values = np.column_stack([clip[c].to_numpy() for c in cols])
        frames = np.split(values, first[1:])
        kept = [0]
        for i in range(1, len(frames)):
            p, q = frames[i], frames[kept[-1]]
            if matte:
                step = np.abs(p[:, :3] * p[:, 3:] - q[:, :3] * q[:, 3:]).sum(1) + 765.0 * np.abs(p[:, 3] - q[:, 3])
                seen = (p[:, 3] > 0.5) | (q[:, 3] > 0.5)
                error = step[seen].sum() / (1530.0 * seen.sum()) if seen.any() else 0.0
            else:
                error = np.abs(p - q).sum() / (255.0 * p.size)
            if error > threshold:
                kept.append(i)
        stands = np.diff([*kept, len(frames)])
        return pa.table([pa.array([clip[by][0].as_py()] * len(kept), pa.int64()), pa.array(number[kept]), pa.array(stands, pa.int64())], [by, "frame", "duration"])

    return src.groupBy(by).applyInArrow(run, f"{by} long, frame long, duration long")
