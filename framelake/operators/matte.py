"""Background keying predicates, matte algebra and residue sweeps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framelake.functions import color as C

RGB = ("r", "g", "b")
LAB = ("lab_l", "lab_a", "lab_b")


def own() -> list[Column]:
    return [F.col(c) for c in RGB]


def border_strips(px: DataFrame, height: int, width: int, depth: int) -> DataFrame:
    """The four border strips one after another: a corner pixel is in two of them, and counts twice."""
    y, x = F.col("y"), F.col("x")
    parts = [px.where(c) for c in (y < depth, y >= height - depth, x < depth, x >= width - depth)]
    return reduce(DataFrame.unionByName, parts)


def border_keys(px: DataFrame, height: int, width: int, most: int = 3, share: float = 0.08, apart: float = 32.0, by: str = "run_id") -> DataFrame:
    """(run, rank, r, g, b, n): the background colours of each run.

    Border pixels fall into buckets of 16 steps a channel; buckets are taken most frequent first while
    they hold ``share`` of the border; a bucket's key is its channel median, and one nearer than
    ``apart`` to a key already taken is skipped. At most ``1 / share`` buckets a run reach the fold.
    """
    depth = max(2, min(height, width) // 16)
    ring = border_strips(px, height, width, depth)
    bucket = [F.floor(F.col(c) / 16).cast("int").alias(f"q{c}") for c in RGB]
    hist = ring.groupBy(by, *bucket).agg(F.count(F.lit(1)).alias("n"), *[F.median(c).alias(c) for c in RGB])
    total = Window.partitionBy(by)
    hist = hist.withColumn("all", F.sum("n").over(total)).where(F.col("n") >= share * F.col("all"))
    item = F.struct((-F.col("n")).alias("order"), "qr", "qg", "qb", *RGB, "n")
    lists = hist.groupBy(by).agg(F.sort_array(F.collect_list(item)).alias("all"))
    cols = lambda e: [e[c] for c in RGB]
    near = lambda kept, e: F.exists(kept, lambda o: F.sqrt(C.euclid2(cols(o), cols(e))) < apart)
    kept = F.aggregate("all", F.slice("all", 1, 0), lambda acc, e: F.when((F.size(acc) >= most) | near(acc, e), acc).otherwise(F.array_append(acc, e)))
    return lists.select(by, F.posexplode(kept).alias("rank", "e")).select(by, "rank", *[F.col(f"e.{c}").alias(c) for c in RGB], F.col("e.n").alias("n"))


def corner_key(px: DataFrame, height: int, width: int, depth: int = 2, by: str = "run_id") -> DataFrame:
    """(run, r, g, b): channel medians of the four corner patches over all frames."""
    edge = lambda c, n: (F.col(c) < depth) | (F.col(c) >= n - depth)
    return px.where(edge("y", height) & edge("x", width)).groupBy(by).agg(*[F.median(c).alias(c) for c in RGB])


def with_lab(px: DataFrame) -> DataFrame:
    return px.withColumns(dict(zip(LAB, C.lab(own()), strict=True)))


def is_candidate(key_lab: list[Column], tolerance: float, shadow: float, tight_neutral: bool = False) -> Column:
    """Whether a pixel (with its CIELAB columns) may be background of a key colour, in CIELAB."""
    lum, a, b = (F.col(c) for c in LAB)
    kl, ka, kb = key_lab
    dl = lum - kl
    up, down = 25 + 40 * tolerance, (10 + 160 * tolerance) * shadow  # fixed values, as all numbers below
    kc, pc = F.sqrt(ka * ka + kb * kb), F.sqrt(a * a + b * b)
    turn = F.degrees(F.atan2(b, a)) - F.degrees(F.atan2(kb, ka))
    gap = F.abs(F.pmod(turn + 180, F.lit(360.0)) - 180)
    hue = (12 + 48 * tolerance) * (1 + F.least(F.greatest(-dl / 40, C.d(0)), C.d(1)))
    saturated = (gap < hue) & (dl < up) & (dl > -down) & (pc >= F.greatest(C.d(12), 0.2 * kc))
    ab2 = (a - ka) * (a - ka) + (b - kb) * (b - kb)
    neutral = (ab2 < 81) & (dl > -8) & (dl < 10) if tight_neutral else (ab2 < (12 + 120 * tolerance) ** 2) & (dl < up) & (dl > -down)
    return F.when(kc >= 25, saturated).otherwise(neutral)


def key_candidates(px: DataFrame, keys: list[tuple[int, int, int]], tolerance: float, shadow: float, out: str = "candidate") -> DataFrame:
    """Adds whether a pixel may be background of any of some given keys."""
    tests = [is_candidate(list(C.lab([F.lit(v) for v in k])), tolerance, shadow) for k in keys]
    return with_lab(px).withColumn(out, reduce(lambda p, q: p | q, tests)).drop(*LAB)


def soft_key(px: DataFrame, key: tuple[int, int, int], tolerance: float, softness: float) -> DataFrame:
    """Alpha by distance from the key: 0 up to the tolerance, 1 beyond tolerance plus softness."""
    dist = F.sqrt(C.euclid2(own(), [F.lit(v) for v in key])) / 255
    return px.withColumn("a", F.least(F.greatest((dist - tolerance) / max(1e-4, softness), C.d(0)), C.d(1)))


def despill(px: DataFrame, channel: str, where: Column) -> DataFrame:
    """Caps a channel at the larger of the other two, on the given pixels."""
    others = F.greatest(*[F.col(c) for c in RGB if c != channel])
    return px.withColumn(channel, F.when(where, F.least(F.col(channel), others)).otherwise(F.col(channel)))


def green_sweep(px: DataFrame, reference: DataFrame, margin: int = 25) -> DataFrame:
    """Clears opaque pixels greener than both other channels by ``margin``, unless the reference palette has such a colour."""
    green = lambda p: (F.col("g") > F.col("r") + p) & (F.col("g") > F.col("b") + p)
    known = reference.agg(F.coalesce(F.max(green(margin).cast("int")), F.lit(0)).alias("known"))  # one row
    hit = (F.col("a") > 0.5) & green(margin) & (F.col("known") == 0)
    return px.crossJoin(F.broadcast(known)).withColumn("a", F.when(hit, 0.0).otherwise(F.col("a"))).drop("known")


def fringe_snap(px: DataFrame) -> DataFrame:
    """Dark greenish opaque pixels lose their green cast."""
    r, g, b = own()
    hit = (F.col("a") > 0.5) & (F.greatest(r, g, b) < 90) & (g > r + 12) & (g > b + 12)
    return px.withColumn("g", F.when(hit, F.least(g, F.floor((r + b) / 2).cast("int") + 6)).otherwise(g))


def content_mask(px: DataFrame, height: int, width: int, apart: float = 24.0, depth: int = 2) -> DataFrame:
    """Adds ``content``: farther than ``apart`` from the corner colour of the frame in any channel."""
    edge = lambda c, n: (F.col(c) < depth) | (F.col(c) >= n - depth)
    key = px.where(edge("y", height) & edge("x", width)).groupBy("run_id", "frame").agg(*[F.median(c).alias(f"k{c}") for c in RGB])
    return px.join(key, ["run_id", "frame"]).withColumn("content", C.max_diff(own(), [F.col(f"k{c}") for c in RGB]) > apart).drop(*[f"k{c}" for c in RGB])


def least_matte(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """The intersection of two mattes: the smaller alpha."""
    return a.join(b.select(*keys, F.col("a").alias("_a")), keys).withColumn("a", F.least("a", "_a")).drop("_a")
