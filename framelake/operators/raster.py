"""Whole-frame rasters: filters, scaling, dithering by error diffusion, palette cutting, and the motion lock.

What is serial or needs a window of many taps runs in numpy on one frame at a time
(``per_frame``), which bounds memory by a frame; the rest are joins and aggregates.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framelake.functions import color as C
from framelake.operators.stencil import FRAME, RGB, neighbours, square
from framelake.operators.temporal import CELL, despike_matte, static_cells

PIXEL = [*FRAME, "y", "x"]


def per_frame(px: DataFrame, height: int, width: int, work: Callable[[np.ndarray], np.ndarray], out: tuple[str, ...] = RGB, kind: str = "double", cols: tuple[str, ...] = RGB) -> DataFrame:
    """Applies ``work`` to each frame's (height, width, columns) array; the result's last axis has one entry a name of ``out``."""
    src = px.select(*[F.col(c).cast("long").alias(c) for c in PIXEL], *[F.col(c).cast("double").alias(c) for c in cols])
    arrow = pa.float64() if kind == "double" else pa.int64()

    def run(table: pa.Table) -> pa.Table:
        y, x = table["y"].to_numpy(), table["x"].to_numpy()
        frame = np.zeros((height, width, len(cols)))
        for i, c in enumerate(cols):
            frame[y, x, i] = table[c].to_numpy()
        done = np.atleast_3d(work(frame))
        return pa.table([*(table[c] for c in PIXEL), *(pa.array(done[y, x, i]).cast(arrow) for i in range(len(out)))], [*PIXEL, *out])

    return src.groupBy(*FRAME).applyInArrow(run, ", ".join([*(f"{c} long" for c in PIXEL), *(f"{c} {kind}" for c in out)]))


def taps(frame: np.ndarray, reach: int, border: str = "edge"):
    """(dy, dx, shifted frame), edges repeated or, with ``reflect``, mirrored about the border pixel."""
    h, w = frame.shape[:2]
    pad = np.pad(frame, ((reach, reach), (reach, reach), (0, 0)), mode=border)
    for dy in range(-reach, reach + 1):
        for dx in range(-reach, reach + 1):
            yield dy, dx, pad[reach + dy : reach + dy + h, reach + dx : reach + dx + w]


def gaussian(px: DataFrame, sigma: float, height: int, width: int) -> DataFrame:
    """Gaussian blur cut at three deviations, edges repeated."""
    reach = max(1, int(np.ceil(3 * sigma)))

    def work(frame: np.ndarray) -> np.ndarray:
        total, weight = np.zeros_like(frame), 0.0
        for dy, dx, near in taps(frame, reach):
            g = np.exp(-(dy * dy + dx * dx) / (2 * sigma * sigma))
            total, weight = total + g * near, weight + g
        return total / weight

    return per_frame(px, height, width, work)


def feather(px: DataFrame, softness: float, height: int, width: int) -> DataFrame:
    """The matte ``a`` blurred by 8 pixels of deviation a unit of softness, cut at four deviations, mirrored at the frame's edge."""
    sigma = 8.0 * softness
    reach = int(4 * sigma + 0.5)
    kernel = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * sigma * sigma))
    kernel /= kernel.sum()

    def work(frame: np.ndarray) -> np.ndarray:
        for axis in (0, 1):
            edges = [(reach, reach) if k == axis else (0, 0) for k in range(3)]
            pad, n = np.pad(frame, edges, mode="symmetric"), frame.shape[axis]
            frame = sum(g * np.take(pad, range(k, k + n), axis) for k, g in enumerate(kernel))
        return np.clip(frame, 0, 1)

    soft = per_frame(px, height, width, work, ("_soft",), cols=("a",))
    return px.join(soft, PIXEL).withColumn("a", F.col("_soft")).drop("_soft")


def bilateral(px: DataFrame, strength: float, passes: int, height: int, width: int) -> DataFrame:
    """Flattens areas and keeps edges, in whole values.

    Taps within 4 pixels (a round window), mirrored about the border pixel, weighted by distance
    (deviation 9) and by the sum of channel steps (deviation 16 + 14 a unit of strength).
    """
    colour, space = 16 + 14 * strength, 9.0

    def work(frame: np.ndarray) -> np.ndarray:
        for _ in range(passes):
            total, weight = np.zeros_like(frame), np.zeros(frame.shape[:2])
            for dy, dx, near in taps(frame, 4, "reflect"):
                if dy * dy + dx * dx > 16:
                    continue
                gap = np.abs(near - frame).sum(2)
                g = np.exp(-(dy * dy + dx * dx) / (2 * space * space) - gap * gap / (2 * colour * colour))
                total, weight = total + g[:, :, None] * near, weight + g
            frame = np.rint(total / weight[:, :, None])
        return frame

    return per_frame(px, height, width, work)


def unsharp(px: DataFrame, sharpen: float, height: int, width: int, sigma: float = 2.0, threshold: float = 2.0) -> DataFrame:
    """Adds a whole percentage (150 a unit of ``sharpen``) of the difference from the blur where that is over the threshold."""
    amount = int(sharpen * 150) / 100
    blurred = gaussian(px, sigma, height, width).withColumnsRenamed({c: f"_{c}" for c in RGB})
    gap = lambda c: F.col(c) - F.col(f"_{c}")
    rows = px.join(blurred, PIXEL)
    return rows.withColumns({c: F.least(F.greatest(F.when(F.abs(gap(c)) > threshold, F.col(c) + amount * gap(c)).otherwise(F.col(c)), C.d(0)), C.d(255)) for c in RGB}).drop(*[f"_{c}" for c in RGB])


def saturate(px: DataFrame, factor: float) -> DataFrame:
    """Moves channels from the pixel's luminance by a factor."""
    rows = px.withColumn("_l", C.luminance([F.col(c) for c in RGB]))
    return rows.withColumns({c: F.least(F.greatest(F.col("_l") + (F.col(c) - F.col("_l")) * factor, C.d(0)), C.d(255)) for c in RGB}).drop("_l")


def contrast(px: DataFrame, factor: float) -> DataFrame:
    """Moves channels from the frame's mean luminance (a whole number) by a factor."""
    mean = px.groupBy(*FRAME).agg(F.floor(F.avg(C.luminance([F.col(c) for c in RGB])) + 0.5).alias("_m"))
    rows = px.join(mean, list(FRAME))
    return rows.withColumns({c: F.least(F.greatest(F.col("_m") + (F.col(c) - F.col("_m")) * factor, C.d(0)), C.d(255)) for c in RGB}).drop("_m")


def area_resize(px: DataFrame, height: int, width: int, new_h: int, new_w: int) -> DataFrame:
    """Area means over any ratio: each pixel goes to the targets that it overlaps, weighted by the overlap."""

    def spread(c: str, old: int, new: int) -> Column:
        lo, hi = F.col(c) * F.lit(new) / F.lit(float(old)), (F.col(c) + 1) * F.lit(new) / F.lit(float(old))
        cells = F.sequence(F.floor(lo).cast("int"), F.least(F.lit(new - 1), F.ceil(hi).cast("int") - 1))
        return F.transform(cells, lambda t: F.struct(t.alias("t"), (F.least(hi, t + 1.0) - F.greatest(lo, t + 0.0)).alias("w")))

    rows = px.select(*FRAME, *RGB, F.explode(spread("y", height, new_h)).alias("_y"), "x").select(*FRAME, *RGB, "_y", F.explode(spread("x", width, new_w)).alias("_x"))
    w = F.col("_y.w") * F.col("_x.w")
    return rows.groupBy(*FRAME, F.col("_y.t").alias("y"), F.col("_x.t").alias("x")).agg(*[(F.sum(F.col(c) * w) / F.sum(w)).alias(c) for c in RGB])


def kernel_weights(kind: str, old: int, new: int) -> np.ndarray:
    """(new, old) weights of an axis: a kernel stretched over the old cells when shrinking, cut at the frame, summing to 1."""
    scale = old / new
    wide = max(scale, 1.0)
    reach = {"bilinear": 1, "bicubic": 2, "lanczos": 3}[kind] * wide
    centre, cell = (np.arange(new)[:, None] + 0.5) * scale, np.arange(old)[None, :]
    x = np.abs(cell + 0.5 - centre) / wide
    if kind == "bilinear":
        w = np.maximum(0, 1 - x)
    elif kind == "bicubic":
        w = np.where(x < 1, (1.5 * x - 2.5) * x * x + 1, np.where(x < 2, -0.5 * (((x - 5) * x + 8) * x - 4), 0))
    else:
        w = np.where(x < 3, np.sinc(x) * np.sinc(x / 3), 0)
    w = np.where((cell >= np.floor(centre - reach + 0.5)) & (cell < np.floor(centre + reach + 0.5)), w, 0)
    return w / w.sum(1, keepdims=True)


def resample(px: DataFrame, kind: str, height: int, width: int, new_h: int, new_w: int) -> DataFrame:
    """Resizes frames by a bilinear, bicubic or Lanczos kernel: rows, then columns, whole bytes after each; one shuffle of the pixels."""
    down, across = kernel_weights(kind, height, new_h), kernel_weights(kind, width, new_w)
    byte = lambda v: np.clip(np.floor(np.round(v, 6) + 0.5), 0, 255)
    src = px.select(*[F.col(c).cast("long").alias(c) for c in PIXEL], *[F.col(c).cast("double").alias(c) for c in RGB])

    def run(table: pa.Table) -> pa.Table:
        frame = np.zeros((height, width, 3))
        for i, c in enumerate(RGB):
            frame[table["y"].to_numpy(), table["x"].to_numpy(), i] = table[c].to_numpy()
        frame = byte(np.einsum("tx,yxc->ytc", across, frame))
        frame = byte(np.einsum("ty,yxc->txc", down, frame))
        y, x = np.divmod(np.arange(new_h * new_w), new_w)
        keys = [pa.array(np.full(len(y), table[c][0].as_py())) for c in FRAME]
        return pa.table([*keys, pa.array(y), pa.array(x), *(pa.array(frame[y, x, i].astype(np.int64)) for i in range(3))], [*PIXEL, *RGB])

    return src.groupBy(*FRAME).applyInArrow(run, ", ".join(f"{c} long" for c in [*PIXEL, *RGB]))


def close_holes(px: DataFrame, flag: str, height: int, width: int, steps: int = 2) -> DataFrame:
    """Grows a boolean column by ``steps`` crosses, shrinks it again (outside the frame it is false), and fills what the border can't reach; one shuffle."""

    def spread(m: np.ndarray) -> np.ndarray:
        pad = np.pad(m, 1)
        return pad[1:-1, 1:-1] | pad[:-2, 1:-1] | pad[2:, 1:-1] | pad[1:-1, :-2] | pad[1:-1, 2:]

    def work(frame: np.ndarray) -> np.ndarray:
        m = frame[..., 0] > 0.5
        for _ in range(steps):
            m = spread(m)
        for _ in range(steps):
            m = ~spread(np.pad(~m, 1, constant_values=True))[1:-1, 1:-1]
        free, reached = ~m, np.zeros_like(m)
        reached[[0, -1]], reached[:, [0, -1]] = free[[0, -1]], free[:, [0, -1]]
        while True:
            more = spread(reached) & free
            if (more == reached).all():
                return ~reached
            reached = more

    return per_frame(px, height, width, work, (flag,), "long", (flag,)).withColumn(flag, F.col(flag) == 1)


def pad_to(px: DataFrame, height: int, width: int, multiple: int, fill: tuple[int, int, int]) -> DataFrame:
    """Centres each frame on the next canvas of whole multiples, filled with a colour."""
    ch, cw = -(-height // multiple) * multiple, -(-width // multiple) * multiple
    oy, ox = (ch - height) // 2, (cw - width) // 2
    moved = px.select(*FRAME, (F.col("y") + oy).alias("y"), (F.col("x") + ox).alias("x"), *RGB)
    canvas = px.select(*FRAME).distinct().withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(ch - 1)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(cw - 1))))
    inside = F.col("y").between(oy, oy + height - 1) & F.col("x").between(ox, ox + width - 1)
    return moved.unionByName(canvas.where(~inside).select(*PIXEL, *[F.lit(v).alias(c) for c, v in zip(RGB, fill, strict=True)]))


def floyd_steinberg(px: DataFrame, colours: list[tuple[int, int, int]], height: int, width: int) -> DataFrame:
    """(pixel, k): error diffusion in reading order: 7, 3, 5 and 1 sixteenths to the next pixels. Serial within a frame."""
    pal = np.array(colours, float)

    def work(frame: np.ndarray) -> np.ndarray:
        f, out = frame.copy(), np.zeros(frame.shape[:2], np.int64)
        h, w = out.shape
        for y in range(h):
            for x in range(w):
                old = np.clip(f[y, x], 0, 255)
                k = int(((pal - old) ** 2).sum(1).argmin())
                out[y, x], err = k, old - pal[k]
                for dy, dx, part in ((0, 1, 7), (1, -1, 3), (1, 0, 5), (1, 1, 1)):
                    if y + dy < h and 0 <= x + dx < w:
                        f[y + dy, x + dx] += err * part / 16
        return out

    return per_frame(px, height, width, work, ("k",), "long")


def _nearest(solid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the nearest set pixel of each place (one is set); the first in reading order of equally near ones.

    Two passes: the nearest set pixel of the same row for each place, then the best of all rows.
    """
    height, width = solid.shape
    far = 4 * (height + width) ** 2
    xs = np.arange(width)
    left = np.maximum.accumulate(np.where(solid, xs, -far), axis=1)
    right = np.minimum.accumulate(np.where(solid, xs, far)[:, ::-1], axis=1)[:, ::-1]
    spot = np.where(xs - left <= right - xs, left, right)  # of equally near ones the left
    across = np.minimum((spot - xs) ** 2, far)
    ys = np.arange(height)
    best, row = np.full((height, width), 2 * far), np.zeros((height, width), np.int64)
    for y in range(height):  # rows in order: only a nearer one replaces an earlier one
        d = (ys[:, None] - y) ** 2 + across[y][None]
        nearer = d < best
        best, row = np.where(nearer, d, best), np.where(nearer, y, row)
    return row, np.clip(spot[row, xs[None]], 0, width - 1)


def nearest_opaque(px: DataFrame, height: int, width: int) -> DataFrame:
    """Transparent pixels take the colour of the nearest opaque one of their frame; the first in reading order of equally near ones."""

    def work(frame: np.ndarray) -> np.ndarray:
        solid = frame[:, :, 3] > 0.5
        if not solid.any():
            return frame[:, :, :3]
        row, x = _nearest(solid)
        return np.where(solid[:, :, None], frame[:, :, :3], frame[row, x, :3])

    rows = px.withColumn("_a", (F.col("a") > 0.5).cast("double"))
    return per_frame(rows, height, width, work, cols=(*RGB, "_a"))


def ring_class(px: DataFrame, height: int, width: int) -> DataFrame:
    """(frame, y, x, k): the pixels that touch the subject (``a``) at a side from outside, with the class ``k`` of the nearest subject pixel.

    Frames without subject, or full of it, have no ring.
    """

    def work(frame: np.ndarray) -> np.ndarray:
        solid = frame[:, :, 1] > 0.5
        if not solid.any():
            return np.full((height, width, 1), -1.0)
        row, x = _nearest(solid)
        near = np.pad(solid, 1)
        touch = near[:-2, 1:-1] | near[2:, 1:-1] | near[1:-1, :-2] | near[1:-1, 2:]
        return np.where(touch & ~solid, frame[row, x, 0], -1.0)[:, :, None]

    return per_frame(px, height, width, work, out=("k",), kind="long", cols=("k", "a")).where("k >= 0")


def median_cut(px: DataFrame, colours: int, by: str = "run_id") -> DataFrame:
    """(by, k, r, g, b): boxes of colours split at the median of their longest side, most populous first; a box's mean is its entry.

    Works on the counts of distinct colours, one group at a time.
    """
    counts = px.groupBy(by, *RGB).agg(F.count(F.lit(1)).alias("n")).select(F.col(by).cast("long").alias(by), *[F.col(c).cast("double").alias(c) for c in RGB], "n")

    def run(table: pa.Table) -> pa.Table:
        c, n = np.column_stack([table[x].to_numpy() for x in RGB]), table["n"].to_numpy()
        boxes = [np.lexsort((c[:, 2], c[:, 1], c[:, 0]))]
        while len(boxes) < colours:
            open_ = [(int(n[b].sum()), -i) for i, b in enumerate(boxes) if len(b) > 1]
            if not open_:
                break
            i = -max(open_)[1]
            b = boxes.pop(i)
            axis = int(np.ptp(c[b], axis=0).argmax())
            b = b[np.argsort(c[b, axis], kind="stable")]
            half = int(np.searchsorted(np.cumsum(n[b]), n[b].sum() / 2)) + 1
            half = min(max(half, 1), len(b) - 1)
            boxes[i:i] = [b[:half], b[half:]]
        mean = np.array([np.average(c[b], axis=0, weights=n[b]) for b in boxes])
        key = table[by][0].as_py()
        return pa.table([pa.array([key] * len(boxes), pa.int64()), pa.array(range(len(boxes)), pa.int64()), *(pa.array(mean[:, i]) for i in range(3))], [by, "k", *RGB])

    return counts.groupBy(by).applyInArrow(run, f"{by} long, k long, r double, g double, b double")


def shared_palette(px: DataFrame, most: int = 255, by: str = "run_id") -> DataFrame:
    """(by, exact, k, r, g, b): the distinct colours if they are ``most`` at most, else a median cut to that many."""
    from framelake.operators.palette import indexed_palette

    n = px.select(by, *RGB).distinct().groupBy(by).agg((F.count(F.lit(1)) <= most).alias("exact"))
    own = indexed_palette(px, [by]).join(n.where("exact"), by)
    cut = median_cut(px.join(n.where("NOT exact"), by, "left_semi"), most, by).withColumn("exact", F.lit(False))
    cols = [F.col(by).cast("long").alias(by), "exact", F.col("k").cast("long").alias("k"), *[F.col(c).cast("double").alias(c) for c in RGB]]
    return own.select(*cols).unionByName(cut.select(*cols))


def sample_pixels(px: DataFrame, most: int, by: str = "run_id") -> DataFrame:
    """At most ``most`` pixels a run, equally from each frame, by a hash of their place: the sampling is the feature."""
    n = px.groupBy(by).agg(F.countDistinct("frame").alias("_f"))
    key = F.md5(F.concat_ws("-", by, "frame", "y", "x").cast("binary"))
    rank = F.row_number().over(Window.partitionBy(by, "frame").orderBy(key))
    rows = px.withColumn("_rank", rank).join(n, by)
    return rows.where(F.col("_rank") <= F.greatest(F.lit(1), F.floor(most / F.col("_f")))).drop("_rank", "_f")


def stride_sample(px: DataFrame, most: int, by: str = "run_id") -> DataFrame:
    """Every n-th pixel in order, so that at most ``most`` a run stay: the sampling is the feature."""
    w = Window.partitionBy(by)
    rows = px.withColumns({"_n": F.count(F.lit(1)).over(w), "_i": F.row_number().over(w.orderBy("frame", "y", "x")) - 1})
    step = F.when(F.col("_n") > most, F.floor(F.col("_n") / most) + 1).otherwise(F.lit(1))
    return rows.where(F.col("_i") % step == 0).drop("_n", "_i")


def block_mismatch(px: DataFrame, label: str, sizes: list[int], height: int, width: int) -> DataFrame:
    """(frame, s, mismatch, ox, oy): for each block size the share of pixels off the majority of their run of ``s``, along rows and columns, at the best offsets."""
    parts = []
    for axis, other, n in (("x", "y", width), ("y", "x", height)):
        cand = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(o).alias("o")) for s in sizes for o in range(s) if (n - o) // s >= 2])
        rows = px.select(*FRAME, axis, other, label, F.explode(cand).alias("c")).select(*FRAME, axis, other, label, "c.*")
        at = F.col(axis) - F.col("o")
        rows = rows.where((at >= 0) & (at < F.col("s") * F.floor((n - F.col("o")) / F.col("s")))).withColumn("cell", F.floor(at / F.col("s")))
        counts = rows.groupBy(*FRAME, "s", "o", other, "cell", label).agg(F.count(F.lit(1)).alias("n"))
        best = counts.groupBy(*FRAME, "s", "o", other, "cell").agg(F.max("n").alias("top"), F.sum("n").alias("all"))
        fit = best.groupBy(*FRAME, "s", "o").agg((1 - F.sum("top") / F.sum("all")).alias("m"))
        pick = fit.groupBy(*FRAME, "s").agg(F.min(F.struct(F.round("m", 9).alias("m"), "o")).alias("p"))
        parts.append(pick.select(*FRAME, "s", F.col("p.m").alias(f"m{axis}"), F.col("p.o").alias(f"o{axis}")))
    return parts[0].join(parts[1], [*FRAME, "s"]).select(*FRAME, "s", ((F.col("mx") + F.col("my")) / 2).alias("mismatch"), "ox", "oy")


def choose_reference_block(fits: DataFrame, most: float = 0.08, pool: float = 1.3) -> DataFrame:
    """Of the sizes within ``pool`` of the best mismatch the largest; none if the best is over ``most``."""
    rows = fits.withColumn("best", F.min("mismatch").over(Window.partitionBy(*FRAME)))
    rows = rows.where((F.col("best") <= most) & (F.col("mismatch") <= F.col("best") * pool + 1e-9))
    pick = rows.groupBy(*FRAME).agg(F.max(F.struct("s", "mismatch", "ox", "oy")).alias("p"))
    return pick.select(*FRAME, F.col("p.s").alias("s"), F.col("p.mismatch").alias("mismatch"), F.col("p.ox").alias("ox"), F.col("p.oy").alias("oy"))


def movelock(source: DataFrame, px: DataFrame, threshold: float, height: int, width: int, passes: int = 3) -> DataFrame:
    """Locks the colours and the matte of pixels whose source barely moves; others are despiked.

    A pixel's candidates are colours with a tenth of its opaque frames and no fewer than its fourth
    most frequent; it locks if they cover 0.70 of at least three opaque frames. Locked pixels then
    take, in a few passes, the candidate that most locked neighbours (wrapped) hold. Static pixels
    get the majority matte, and where that makes them opaque the locked colour, or that before.
    """
    key = C.packed([F.col(c) for c in RGB])
    static = static_cells(source, threshold, height, width)
    votes = px.withColumn("k", key).groupBy(*CELL, "k").agg(F.sum((F.col("a") > 0.5).cast("int")).alias("n"))
    w = Window.partitionBy(*CELL)
    rank = F.row_number().over(w.orderBy(F.desc("n"), "k"))
    votes = votes.withColumns({"total": F.sum("n").over(w), "rank": rank})
    votes = votes.withColumn("fourth", F.coalesce(F.max(F.when(F.col("rank") == 4, F.col("n"))).over(w), F.lit(0)))
    cand = votes.where((F.col("n") > 0) & (F.col("n") >= F.greatest(F.lit(0.10) * F.col("total"), F.col("fourth"))))
    cover = cand.groupBy(*CELL).agg((F.sum("n") / F.max("total")).alias("cover"), F.max("total").alias("total"))
    state = votes.where("rank = 1").select(*CELL, F.col("k").alias("mode")).join(cover, CELL_LIST, "left")
    state = state.select(*CELL, "mode", F.coalesce((F.col("cover") >= 0.70) & (F.col("total") >= 3), F.lit(False)).alias("lock"))
    own = cand.select(*CELL, "k")
    for _ in range(passes):
        near = neighbours(state.where("lock").withColumn("frame", F.lit(0)), square(3, False), height, width, "wrap", ["mode"])
        vote = near.groupBy("run_id", "y", "x", F.col("mode").alias("k")).agg(F.count(F.lit(1)).alias("n")).join(own, [*CELL, "k"], "left_semi")
        best = vote.groupBy(*CELL).agg(F.max(F.struct("n", (-F.col("k")).alias("nk"))).alias("b"))
        state = state.join(best, CELL_LIST, "left").select(*CELL, F.when(F.col("lock") & F.col("b").isNotNull(), -F.col("b.nk")).otherwise(F.col("mode")).alias("mode"), "lock")
    opaque = px.groupBy(*CELL).agg((F.avg((F.col("a") > 0.5).cast("int")) > 0.5).alias("most"))
    info = state.join(static, CELL_LIST).join(opaque, CELL_LIST).withColumn("lockable", F.col("static") & F.col("lock") & F.col("most"))
    calm = despike_matte(px, 4.0).join(px.select(*PIXEL, F.col("a").alias("_raw")), PIXEL).join(info, CELL_LIST)
    back = {"r": F.shiftright("mode", 16).bitwiseAND(255), "g": F.shiftright("mode", 8).bitwiseAND(255), "b": F.col("mode").bitwiseAND(255)}
    set_ = F.col("static") & ((F.col("a") > 0.5) != F.col("most"))
    again = set_ & F.col("most") & (F.col("_raw") <= 0.5)
    w = Window.partitionBy(*CELL).orderBy("frame")
    first = {c: F.when(F.col("lockable"), v.cast("int")).otherwise(F.col(c)) for c, v in back.items()}
    calm = calm.withColumns(first).withColumns({f"_p{c}": F.lag(c).over(w) for c in RGB})
    return calm.select(*PIXEL, *[F.when(again & ~F.col("lockable"), F.coalesce(F.col(f"_p{c}"), F.col(c))).otherwise(F.col(c)).cast("int").alias(c) for c in RGB], F.when(set_, F.col("most").cast("double")).otherwise(F.col("a")).alias("a"))


CELL_LIST = list(CELL)


def rescue_subject(px: DataFrame, flag: str, strict: str, height: int, width: int, eaten: float = 0.85, least: float = 0.02) -> DataFrame:
    """Brings back a subject that a flood has eaten: where the background ``flag`` takes ``eaten`` of a frame and leaves under ``least``.

    ``strict`` marks pixels that are background by a narrower tolerance. What a flood of these from
    the border leaves still has the subject's outline: the hull is its largest 8-connected part, closed
    twice, with its holes filled, and is foreground again. Adds ``saved``, whether the frame changed.
    """
    from framelake.operators.graph import border_flood, fill_holes, largest_island
    from framelake.operators.stencil import morph

    share = px.groupBy(*FRAME).agg(F.avg(F.col(flag).cast("int")).alias("_bg")).where((F.col("_bg") >= eaten) & (1 - F.col("_bg") < least)).select(*FRAME)
    failed = px.join(share, list(FRAME), "left_semi").select(*PIXEL, F.col(flag).alias("_flag"), F.col(strict).alias("_strict"))
    left = border_flood(failed, "_strict", height, width, True, "_out").withColumn("_in", ~F.col("_out"))
    hull = largest_island(left, "_in", height, width, True, "_hull").select(*PIXEL, "_flag", "_hull")
    for how in ("dilate", "erode"):
        hull = morph(hull, "_hull", how, height, width, square(3, False), 2)
    hull = fill_holes(hull, "_hull", height, width)
    back = hull.where("_hull AND _flag").select(*PIXEL, F.lit(True).alias("_back"))
    saved = back.select(*FRAME).distinct().withColumn("saved", F.lit(True))
    rows = px.join(back, PIXEL, "left").join(saved, list(FRAME), "left")
    return rows.withColumns({flag: F.col(flag) & F.col("_back").isNull(), "saved": F.coalesce("saved", F.lit(False))}).drop("_back")
