"""Boxes, canvases, anchored placement, sheets, and guards over whole clips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framelake.functions import color as C
from framelake.operators.stencil import FRAME, RGB

BOX = ("x0", "y0", "x1", "y1")


def _box(flag: Column) -> list[Column]:
    y, x = (F.when(flag, F.col(c)) for c in ("y", "x"))
    return [F.min(x).alias("x0"), F.min(y).alias("y0"), (F.max(x) + 1).alias("x1"), (F.max(y) + 1).alias("y1")]


def bbox(px: DataFrame, flag: Column, height: int, width: int, by: tuple[str, ...] = FRAME) -> DataFrame:
    """(by, x0, y0, x1, y1) of the flagged pixels, half open; the whole frame where there are none."""
    whole = dict(zip(BOX, (0, 0, width, height), strict=True))
    return px.groupBy(*by).agg(*_box(flag)).select(*by, *[F.coalesce(F.col(c), F.lit(whole[c])).alias(c) for c in BOX])


def union_bbox(px: DataFrame, flag: Column, height: int, width: int) -> DataFrame:
    """One box a run."""
    return bbox(px, flag, height, width, ("run_id",))


def auto_canvas(boxes: DataFrame, padding: int, multiple: int) -> DataFrame:
    """(run, cw, ch): the largest padded box of each run, rounded up."""
    up = lambda c: (F.ceil((F.max(c) + 2 * padding) / multiple) * multiple).cast("int")
    return boxes.groupBy("run_id").agg(up(F.col("x1") - F.col("x0")).alias("cw"), up(F.col("y1") - F.col("y0")).alias("ch"))


def placements(boxes: DataFrame, canvas: DataFrame, padding: int, height: int, width: int, anchor: str = "bottom_center", dx: int = 0, dy: int = 0) -> DataFrame:
    """Padded boxes, and the origin (ox, oy) of each on its canvas.

    anchor: bottom_center, center, top_left, or one of the nine places such as bottom_left or right_center.
    """
    pad = boxes.join(F.broadcast(canvas), "run_id")
    pad = pad.withColumns({"x0": F.greatest(F.lit(0), F.col("x0") - padding), "y0": F.greatest(F.lit(0), F.col("y0") - padding), "x1": F.least(F.lit(width), F.col("x1") + padding), "y1": F.least(F.lit(height), F.col("y1") + padding)})
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    parts = anchor.split("_") if anchor != "center" else ["center", "center"]
    vert, horiz = (parts[0], parts[1]) if parts[0] not in ("left", "right") else ("center", parts[0])
    ox = {"left": F.lit(0), "center": F.floor((F.col("cw") - w) / 2), "right": F.col("cw") - w}[horiz]
    oy = {"top": F.lit(0), "center": F.floor((F.col("ch") - h) / 2), "bottom": F.col("ch") - h}[vert]
    return pad.withColumns({"ox": (ox + dx).cast("int"), "oy": (oy + dy).cast("int")})


def paste(px: DataFrame, placed: DataFrame, by: tuple[str, ...] = FRAME) -> DataFrame:
    """The boxes' pixels at their place on the canvas; what falls outside goes."""
    rows = px.join(placed.select(*by, *BOX, "ox", "oy", "cw", "ch"), list(by))
    inside = (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1")) & (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y1"))
    rows = rows.where(inside).withColumns({"x": F.col("x") - F.col("x0") + F.col("ox"), "y": F.col("y") - F.col("y0") + F.col("oy")})
    rows = rows.where((F.col("x") >= 0) & (F.col("x") < F.col("cw")) & (F.col("y") >= 0) & (F.col("y") < F.col("ch")))
    return rows.drop(*BOX, "ox", "oy", "cw", "ch")


def sheet_layout(frames: DataFrame, width: int, height: int, padding: int, columns: int = 0) -> DataFrame:
    """(run, frame, col, row, x, y, sheet_w, sheet_h): frames in a grid, near square unless ``columns`` is given."""
    n = frames.groupBy("run_id").agg((F.max("frame") + 1).alias("n"))
    cols = F.lit(columns) if columns > 0 else F.ceil(F.sqrt("n")).cast("int")
    n = n.withColumn("cols", cols).withColumn("rows", F.ceil(F.col("n") / F.col("cols")).cast("int"))
    out = frames.select("run_id", "frame").distinct().join(n, "run_id")
    col, row = F.col("frame") % F.col("cols"), F.floor(F.col("frame") / F.col("cols")).cast("int")
    cw, ch = width + padding, height + padding
    return out.select("run_id", "frame", col.alias("col"), row.alias("row"), (padding + col * cw).alias("x"), (padding + row * ch).alias("y"), (F.col("cols") * cw + padding).alias("sheet_w"), (F.col("rows") * ch + padding).alias("sheet_h"))


def proportional_padding(boxes: DataFrame) -> DataFrame:
    """(run, pad): a tenth of the longer side, 3 at least and 32 at most."""
    side = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    return boxes.select("run_id", F.least(F.lit(32), F.greatest(F.lit(3), F.bround(side * F.lit(0.10).cast("double"), 0).cast("int"))).alias("pad"))


def occupancy(boxes: DataFrame, height: int, width: int) -> DataFrame:
    """(run, share_w, share_h, verdict): how much of the canvas the subject fills."""
    w, h = (F.col("x1") - F.col("x0")) / width, (F.col("y1") - F.col("y0")) / height
    verdict = F.when((w > 0.92) | (h > 0.92), "fills").when((w < 0.40) & (h < 0.40), "tiny").otherwise("fits")
    return boxes.select("run_id", w.alias("share_w"), h.alias("share_h"), verdict.alias("verdict"))


def outlier_frames(px: DataFrame) -> DataFrame:
    """(run, frame, opaque, typical, bad): frames far more opaque than their run, where the run's median is under 0.45."""
    share = px.groupBy(*FRAME).agg(F.avg((F.col("a") > 0.5).cast("int")).alias("opaque"))
    med = share.groupBy("run_id").agg(F.median("opaque").alias("typical"))
    bad = (F.col("typical") < 0.45) & (F.col("opaque") > 0.45) & (F.col("opaque") > F.greatest(2 * F.col("typical"), F.col("typical") + 0.30))
    return share.join(med, "run_id").withColumn("bad", bad)


def mad_2x2(px: DataFrame) -> DataFrame:
    """(run, mad): median over frames of the mean deviation within 2 x 2 cells that are wholly opaque (0 for a frame without)."""
    by = [*FRAME, F.floor(F.col("y") / 2).alias("cy"), F.floor(F.col("x") / 2).alias("cx")]
    cells = px.groupBy(*by).agg(*[F.avg(c).alias(f"m{c}") for c in RGB], *[F.collect_list(c).alias(f"l{c}") for c in RGB], F.min("a").alias("solid"))

    def spread(c: str) -> Column:
        return F.aggregate(F.transform(f"l{c}", lambda v: F.abs(v - F.col(f"m{c}"))), F.lit(0.0), lambda t, v: t + v) / F.size(f"l{c}")

    dev = sum(spread(c) for c in RGB) / 3
    frame = cells.withColumn("d", dev).groupBy(*FRAME).agg(F.coalesce(F.avg(F.when(F.col("solid") > 0.5, F.col("d"))), F.lit(0.0)).alias("mad"))
    return frame.groupBy("run_id").agg(F.median("mad").alias("mad"))


def palette_guard(px: DataFrame, palette: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """(by, core, typical, match): percent of opaque pixels within 30 of a palette colour, and the median distance."""
    from framelake.operators.palette import with_nearest

    d = F.sqrt("k_d2")
    near = with_nearest(px.where("a > 0.5"), palette, "redmean")
    out = near.groupBy(*by).agg((F.avg((d < 30).cast("int")) * 100).alias("core"), F.median(d).alias("typical"))
    return out.withColumn("match", (F.col("core") >= 27) & (F.col("typical") <= 75))


def frame_quorum(px: DataFrame, palette: DataFrame) -> DataFrame:
    """(run, quorum, passes): the share of frames that match by themselves; a third is enough, or the pooled run."""
    frames = palette_guard(px, palette, FRAME).groupBy("run_id").agg(F.avg(F.col("match").cast("int")).alias("quorum"))
    pooled = palette_guard(px, palette, ("run_id",)).select("run_id", "match")
    return frames.join(pooled, "run_id").select("run_id", "quorum", (F.col("match") | (F.col("quorum") >= F.lit(1.0) / 3)).alias("passes"))


def band_boundaries(px: DataFrame, shares: list[float], by: str = "run_id") -> DataFrame:
    """(by, band, bound): luminance quantiles at the cumulative shares of all bands but the last.

    Between two neighbours in order a quantile is lo * (1 - part) + hi * part with one rounding of the sum (a fused multiply-add, as
    in DuckDB): where the two are next to each other as doubles, the last bit decides on which side of it pixels lie.
    """
    total, at, cum = sum(shares), 0.0, []
    for s in shares[:-1]:
        at += s
        cum.append(at / total)
    lum = C.luminance([F.col(c) for c in RGB])
    counts = px.select(by, lum.alias("_l")).where("_l IS NOT NULL").groupBy(by, "_l").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(by)
    ranked = counts.select(by, "_l", F.sum("_n").over(w.orderBy("_l").rowsBetween(Window.unboundedPreceding, 0)).alias("_to"), (F.sum("_n").over(w) - 1).alias("_last"))
    place = [F.col("_last") * F.lit(c) for c in cum]
    at = lambda k: F.min(F.when(F.col("_to") > k, F.col("_l")))
    ends = [F.struct(at(F.floor(p)).alias("lo"), at(F.ceil(p)).alias("hi"), F.max(p - F.floor(p)).alias("part")).alias(f"q{i}") for i, p in enumerate(place)]
    fma = lambda q: F.java_method(F.lit("java.lang.Math"), F.lit("fma"), q["lo"], 1 - q["part"], q["hi"] * q["part"]).cast("double")
    q = ranked.groupBy(by).agg(*ends).select(by, F.array(*[fma(F.col(f"q{i}")) for i in range(len(cum))]).alias("q"))
    return q.select(by, F.posexplode("q").alias("band", "bound"))


def band_remap(px: DataFrame, bounds: DataFrame, by: str = "run_id") -> DataFrame:
    """Adds ``band``: how many boundaries lie strictly below the pixel's luminance."""
    lists = bounds.groupBy(by).agg(F.collect_list("bound").alias("_q"))
    lum = C.luminance([F.col(c) for c in RGB])
    return px.join(F.broadcast(lists), by).withColumn("_l", lum).withColumn("band", F.size(F.filter("_q", lambda b: b < F.col("_l")))).drop("_q", "_l")


def clamped_masks(px: DataFrame, masks: DataFrame, height: int, width: int, mask_height: int, mask_width: int) -> DataFrame:
    """``px`` with the matte ``a`` of a mask stack (run, frame, y, x, a): frames past the last mask take the last one; other sizes are sampled at pixel centres.

    An equi-join on the clamped frame: the stack's length is one small row a run.
    """
    last = masks.groupBy("run_id").agg(F.max("frame").alias("_last"))
    at = lambda c, have, want: F.floor((F.col(c) + 0.5) * have / want).cast("int").alias(f"_{c}")
    rows = px.join(last, "run_id").select("*", F.least("frame", "_last").alias("_frame"), at("y", mask_height, height), at("x", mask_width, width))
    src = masks.select("run_id", F.col("frame").alias("_frame"), F.col("y").alias("_y"), F.col("x").alias("_x"), "a")
    return rows.join(src, ["run_id", "_frame", "_y", "_x"]).select(*px.columns, "a")


def character_scale(px: DataFrame, reference_height: int, least_pixels: int = 100, least: int = 3, most: int = 24) -> DataFrame:
    """(run, block): the median over frames of the opaque height over the reference's, rounded half to even and clamped; null where no frame has enough opaque pixels."""
    solid = F.col("a") > 0.5
    y = F.when(solid, F.col("y"))
    frames = px.groupBy(*FRAME).agg(F.count(y).alias("n"), (F.max(y) - F.min(y) + 1).alias("h"))
    ratio = F.when(F.col("n") >= least_pixels, F.col("h") / F.lit(float(reference_height)))
    block = F.rint(F.median(ratio))
    return frames.groupBy("run_id").agg(F.when(block.isNotNull(), F.greatest(F.lit(least), F.least(F.lit(most), block))).cast("int").alias("block"))


def fit_reference(px: DataFrame, height: int, width: int, out_height: int, out_width: int, background: tuple[int, int, int], dx: int = 0, dy: int = 0) -> DataFrame:
    """Each frame's opaque part, flattened on a colour, enlarged a whole number of times (or shrunk to fit) without blending, and centred on a canvas.

    dx and dy move it, in pixels of the source. The canvas is spread from one box row a frame and joined to the pixels it shows.
    """
    boxes = bbox(px, F.col("a") > 0, height, width)
    bw, bh = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    k = F.least(F.floor(out_width / bw), F.floor(out_height / bh))
    s = F.when(k >= 1, k.cast("double")).otherwise(F.least(out_width / bw, out_height / bh))
    boxes = boxes.withColumns({"s": s, "nw": F.greatest(F.lit(1), F.rint(bw * s)), "nh": F.greatest(F.lit(1), F.rint(bh * s))})
    origin = lambda side, n, off: F.floor((side - F.col(n)) / 2) + F.rint(off * F.col("s"))
    boxes = boxes.withColumns({"ox": origin(out_width, "nw", dx), "oy": origin(out_height, "nh", dy)})
    cells = boxes.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(out_height - 1)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(out_width - 1))))

    def source(c: str, n: str, lo: str, hi: str, o: str) -> Column:
        t = F.col(c) - F.col(o)
        return F.when((t >= 0) & (t < F.col(n)), F.col(lo) + F.floor((t + 0.5) * (F.col(hi) - F.col(lo)) / F.col(n))).cast("int")

    cells = cells.select(*FRAME, "y", "x", source("y", "nh", "y0", "y1", "oy").alias("_y"), source("x", "nw", "x0", "x1", "ox").alias("_x"))
    src = px.select(*FRAME, F.col("y").alias("_y"), F.col("x").alias("_x"), "a", *RGB)
    mix = lambda c, v: F.coalesce(F.rint(F.col("a") * F.col(c) + (1 - F.col("a")) * v), F.lit(v)).cast("int").alias(c)
    return cells.join(src, [*FRAME, "_y", "_x"], "left").select(*FRAME, "y", "x", *[mix(c, v) for c, v in zip(RGB, background, strict=True)])
