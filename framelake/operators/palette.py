"""Joins to a palette and palette building.

A palette has at most some hundred entries, so it is broadcast behind a check of its size, or folded
as an array literal; the pixel table is never shuffled for a nearest-colour join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framelake.functions import color as C
from framelake.operators.lineage import settle

RGB = ("r", "g", "b")
MOST = 4096


def as_array(palette: DataFrame, cols: tuple[str, ...] = RGB) -> Column:
    """The palette as an array literal of structs, in the order of k. Its size is checked: at most 4096 entries."""
    rows = palette.select("k", *cols).orderBy("k").limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"a palette of more than {MOST} entries")
    return F.array(*[F.struct(*[F.lit(x[n]).alias(n) for n in ("k", *cols)]) for x in rows])


def in_lab(palette: DataFrame) -> DataFrame:
    """(k, r, g, b) with the CIELAB coordinates in place of the channels, worked out once an entry."""
    return palette.select("k", *[v.alias(n) for n, v in zip(RGB, C.lab([F.col(c) for c in RGB]), strict=True)])


def _cols(x: Column) -> list[Column]:
    return [x[n] for n in RGB]


def with_nearest(px: DataFrame, palette: DataFrame, metric: str = "rgb", out: str = "k") -> DataFrame:
    """Adds the index of the nearest entry (the first of equally near ones) and its squared distance ``out``_d2.

    metric: rgb, lab or redmean. The palette is folded inside the row: no join and no shuffle.
    """
    pal = as_array(in_lab(palette) if metric == "lab" else palette)
    own = [F.col(n) for n in RGB]
    if metric == "lab":
        px = px.withColumns(dict(zip(("_L", "_A", "_B"), C.lab(own), strict=True)))
        own = [F.col(n) for n in ("_L", "_A", "_B")]
    dist = C.redmean2 if metric == "redmean" else C.euclid2
    best = F.array_min(F.transform(pal, lambda e: F.struct(dist(own, _cols(e)).alias("d"), e["k"].alias("k"))))
    return px.withColumn("_best", best).withColumn(out, F.col("_best.k")).withColumn(f"{out}_d2", F.col("_best.d")).drop("_best", "_L", "_A", "_B")


def lookup(px: DataFrame, palette: DataFrame, index: str = "k") -> DataFrame:
    """Replaces r, g, b by the entry at the index, clamped to the palette."""
    n = palette.count()
    pal = palette.select(F.col("k").alias("_k"), *[F.col(c).alias(f"_{c}") for c in RGB])
    if n > MOST:
        raise ValueError(f"a palette of more than {MOST} entries")
    at = F.least(F.greatest(F.col(index), F.lit(0)), F.lit(n - 1))
    return px.drop(*RGB).join(F.broadcast(pal), at == F.col("_k")).drop("_k").withColumnsRenamed({f"_{c}": c for c in RGB})


def with_ramp_class(px: DataFrame, palette: DataFrame, chroma: float = 25.0, window: float = 35.0, out: str = "k") -> DataFrame:
    """Classifies by hue family first, then by luminance.

    Chromatic pixels take the entry of nearest luminance among the chromatic ones within ``window``
    degrees (or the nearest in hue); light, slightly tinted ones the lightest of that family; grey
    ones the grey of nearest luminance; where a kind is missing, the redmean nearest.
    """
    hcl = dict(zip(("h", "c", "l"), C.hcl([F.col(n) for n in RGB]), strict=True))
    pal = as_array(palette.withColumns(hcl), (*RGB, "h", "c", "l"))
    own = [F.col(n) for n in RGB]
    px = px.withColumns(dict(zip(("_h", "_c", "_l"), C.hcl(own), strict=True)) | {"_pal": pal})
    h, c, lum = F.col("_h"), F.col("_c"), F.col("_l")
    greys, hued = F.filter("_pal", lambda e: e["c"] < chroma), F.filter("_pal", lambda e: e["c"] >= chroma)
    near = F.filter(hued, lambda e: C.hue_distance(h, e["h"]) <= window)
    by = lambda a, f: F.array_min(F.transform(a, lambda e: F.struct(f(e).alias("d"), e["k"].alias("k"))))["k"]
    level = lambda e: F.abs(lum - e["l"])
    redmean = by(F.col("_pal"), lambda e: C.redmean2(own, _cols(e)))
    grey = F.coalesce(by(greys, level), redmean)
    tint = F.coalesce(by(near, lambda e: -e["l"]), grey)
    hue = F.coalesce(by(near, level), by(hued, lambda e: C.hue_distance(h, e["h"])), redmean)
    tinted = (c >= 6) & (c < chroma) & (lum >= 200)
    return px.withColumn(out, F.when(tinted, tint).when(c < chroma, grey).otherwise(hue)).drop("_h", "_c", "_l", "_pal")


def snap_capped(px: DataFrame, palette: DataFrame, cap: float) -> DataFrame:
    """Takes the redmean-nearest entry's colour where it is within ``cap``; else the pixel stays."""
    near = with_nearest(px, palette, "redmean", "_k")
    pal = palette.select(F.col("k").alias("_k"), *[F.col(c).alias(f"_{c}") for c in RGB])
    near = near.join(F.broadcast(pal), "_k").withColumn("snapped", F.col("_k_d2") <= cap * cap)
    return near.withColumns({c: F.when(F.col("snapped"), F.col(f"_{c}")).otherwise(F.col(c)) for c in RGB}).drop("_k", "_k_d2", *[f"_{c}" for c in RGB])


def colour_counts(px: DataFrame, *by: str) -> DataFrame:
    """Pixels of each colour, in each group of ``by``: one partial aggregate."""
    return px.groupBy(*by, *RGB).agg(F.count(F.lit(1)).alias("n"))


def top_colours(px: DataFrame, by: list[str], most: int = 24) -> DataFrame:
    """The most frequent colours; ties by colour. The limit is the feature."""
    w = Window.partitionBy(*by).orderBy(F.desc("n"), *RGB)
    return colour_counts(px, *by).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def indexed_palette(px: DataFrame, by: list[str]) -> DataFrame:
    """The distinct colours, numbered in ascending order."""
    w = Window.partitionBy(*by).orderBy(*RGB)
    return px.select(*by, *RGB).distinct().withColumn("k", F.row_number().over(w) - 1)


def merge_near(palette: DataFrame, by: list[str], threshold: float = 7.0) -> DataFrame:
    """Drops entries nearer in CIELAB than ``threshold`` to one already kept, in order; two entries or fewer stay.

    A fold over one palette's array (some hundred entries at most, by its kind).
    """
    rows = palette.withColumns(dict(zip(("lab_l", "lab_a", "lab_b"), C.lab([F.col(c) for c in RGB]), strict=True)))
    item = F.struct("k", *RGB, "lab_l", "lab_a", "lab_b")
    whole = rows.groupBy(*by).agg(F.sort_array(F.collect_list(item)).alias("all"))
    lab = lambda e: [e["lab_l"], e["lab_a"], e["lab_b"]]
    fold = F.aggregate("all", F.slice("all", 1, 0), lambda kept, e: F.when(F.exists(kept, lambda o: F.sqrt(C.euclid2(lab(o), lab(e))) < threshold), kept).otherwise(F.array_append(kept, e)))
    return whole.select(*by, F.inline(F.when(F.size("all") <= 2, F.col("all")).otherwise(fold))).drop("lab_l", "lab_a", "lab_b")


def pull_to_core(px: DataFrame, palette: DataFrame, by: list[str]) -> DataFrame:
    """(by, k, r, g, b): for each group, each entry moved three quarters to the most chromatic pixel of its core.

    The core: of the pixels nearest to the entry, the closest 40 of 100, one at least and 150 at
    most; it moves entries only where that chroma is over 20 and over the entry's own.
    """
    own = [F.col(n) for n in RGB]
    pal = F.broadcast(palette.select("k", *[F.col(c).alias(f"p{c}") for c in RGB]))
    near = with_nearest(px, palette, "redmean").join(pal, "k")
    order = Window.partitionBy(*by, "k").orderBy("k_d2", *[c for c in px.columns])
    size = Window.partitionBy(*by, "k")
    core = near.withColumn("rank", F.row_number().over(order)).withColumn("size", F.count(F.lit(1)).over(size))
    core = core.where(F.col("rank") <= F.greatest(F.lit(1), F.least(F.lit(150), F.floor(F.col("size") * F.lit(0.4).cast("double")))))
    chroma = F.greatest(*own) - F.least(*own)
    best = core.groupBy(*by, "k").agg(F.max(F.struct(chroma.alias("c"), (-F.col("rank")).alias("nr"), *RGB)).alias("best"))
    out = px.select(*by).distinct().crossJoin(F.broadcast(palette)).join(best, [*by, "k"], "left")
    flat = F.greatest(*own) - F.least(*own)
    move = (F.col("best.c") > 20) & (F.col("best.c") > flat)
    return out.select(*by, "k", *[F.when(move, F.rint(F.col(c) * 0.25 + F.col(f"best.{c}") * 0.75)).otherwise(F.col(c)).cast("int").alias(c) for c in RGB])


def shade_ramp(palette: DataFrame, bands: int = 4, ambient: float = 0.35, hue_shift: float = 0.3, vibrancy: float = 1.0) -> DataFrame:
    """(k, band, r, g, b as numbers): each colour in ``bands`` shades, shadows towards indigo, lights towards amber."""
    palette = palette.withColumns(dict(zip(("_h", "_s", "_v"), C.hsv([F.col(c) for c in RGB]), strict=True)))
    h, s, v = F.col("_h"), F.col("_s"), F.col("_v")
    out = None
    # Hues of shadow and light in degrees, and their shares.
    indigo, amber, dark_share, dark_gain = 250.0 / 360.0, 40.0 / 360.0, 0.8, 0.35
    for band, mult in enumerate(C.band_multipliers(bands, ambient)):
        t = 1.0 if bands <= 1 else band / (bands - 1)
        hue, sat = h, s
        if hue_shift > 0:
            hue = C.hue_lerp(C.hue_lerp(h, indigo, hue_shift * (1 - t) * dark_share), amber, hue_shift * max(0.0, t - 0.5))
            sat = F.least(F.greatest(s * (1 + hue_shift * (1 - t) * dark_gain), C.d(0)), C.d(1))
        rows = palette.select("k", hue.alias("_h"), sat.alias("_s"), F.least(F.greatest(v * mult, C.d(0)), C.d(1)).alias("_v"))
        rgb = C.rgb_from_hsv([F.col("_h"), F.col("_s"), F.col("_v")])
        part = rows.select("k", F.lit(band).alias("band"), *[x.alias(c) for c, x in zip(RGB, rgb, strict=True)])
        out = part if out is None else out.unionByName(part)
    if vibrancy != 1.0:
        lum = C.luminance([F.col(c) for c in RGB])
        out = out.withColumns({c: F.least(F.greatest(lum + (F.col(c) - lum) * vibrancy, C.d(0)), C.d(255)) for c in RGB})
    return out


def spread_seeds(counts: DataFrame, most: int) -> DataFrame:
    """(k, r, g, b): k-means++ seeds from colour counts (r, g, b, n), at most one a colour.

    Each seed is drawn with a chance in proportion to n times the squared distance to the nearest seed
    before it: the colour with the least -ln(u) over that weight, where u is a hash of the step and the colour.
    So a step is one aggregate, and the draw is the same for any partitioning.
    """
    own, seeds = [F.col(c) for c in RGB], []
    for step in range(most):
        u = (F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(step), *RGB)), 1, 8), 16, 10).cast("double") + 1) / C.d(1 << 32)
        far = [C.euclid2(own, [C.d(v) for v in x]) for x in seeds]
        gap = F.least(*far) if len(far) > 1 else far[0] if far else C.d(1)
        best = counts.where(gap > 0).agg(F.min(F.struct((-F.ln(u) / (F.col("n") * gap)).alias("o"), *RGB)).alias("b")).first()[0]
        if best is None:
            break
        seeds.append(tuple(float(best[c]) for c in RGB))
    return counts.sparkSession.createDataFrame([(i, *x) for i, x in enumerate(seeds)], "k int, r double, g double, b double")


def kmeans(px: DataFrame, seeds: DataFrame | int, iterations: int = 3, space: str = "rgb", tolerance: float = 0.0) -> DataFrame:
    """(k, r, g, b): Lloyd's steps in RGB or CIELAB from given seeds, or from so many k-means++ seeds; a cluster without pixels keeps its centre.

    Works on colour counts, written once: each step is one aggregate of one row a colour, and only the
    centres (a palette) go round. Stops when no coordinate moves by more than the tolerance.
    """
    counts = settle(colour_counts(px))
    points = counts
    if space == "lab":
        points = settle(counts.withColumns(dict(zip(("_l", "_a", "_b"), C.lab([F.col(c) for c in RGB]), strict=True))).select(F.col("_l").alias("r"), F.col("_a").alias("g"), F.col("_b").alias("b"), "n"))
        seeds = spread_seeds(points, seeds) if isinstance(seeds, int) else in_lab(seeds)
    elif isinstance(seeds, int):
        seeds = spread_seeds(counts, seeds)
    spark = px.sparkSession
    held = {x["k"]: [float(x[c]) for c in RGB] for x in seeds.select("k", *RGB).limit(MOST + 1).collect()}
    table = lambda: spark.createDataFrame([(k, *v) for k, v in sorted(held.items())], "k int, r double, g double, b double")
    for _ in range(iterations if held else 0):
        near = with_nearest(points, table())
        means = near.groupBy("k").agg(*[(F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias(c) for c in RGB]).collect()  # one row a centre
        moved = {x["k"]: [x[c] for c in RGB] for x in means}
        still = all(abs(a - b) <= tolerance for k, v in moved.items() for a, b in zip(v, held[k], strict=True))
        held |= moved
        if still:
            break
    if space != "lab":
        return table()
    return table().select("k", *[v.alias(c) for c, v in zip(RGB, C.rgb_from_lab([F.col(c) for c in RGB]), strict=True)])


def concat(first: DataFrame, second: DataFrame) -> DataFrame:
    """(k, r, g, b): the second palette's entries after the first's, numbered on."""
    n = first.agg(F.coalesce(F.max("k") + 1, F.lit(0))).first()[0]  # one number
    after = second.select((F.col("k") + n).alias("k"), *RGB)
    return first.select("k", *RGB).unionByName(after)


def with_outlines(ramp: DataFrame, bands: int, share: float = 0.55) -> DataFrame:
    """(k, r, g, b in whole bytes): a ramp (k, band, r, g, b), colour by colour, and then one outline a colour, deeper than its darkest band."""
    byte = lambda c: F.floor(F.least(F.greatest(c, F.lit(0.0)), F.lit(255.0))).cast("int")
    shades = ramp.select((F.col("k") * bands + F.col("band")).alias("k"), *[byte(F.col(c)).alias(c) for c in RGB])
    lines = ramp.where("band = 0").select("k", *[byte(F.col(c) * share).alias(c) for c in RGB])
    return concat(shades, lines)
