"""Configured pipelines: a typed configuration becomes an ordered list of operators."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.functions import color as C
from framelake.operators import frames as fr
from framelake.operators import graph as G
from framelake.operators import grid as GR
from framelake.operators import palette as P
from framelake.operators import temporal as T
from framelake.plans.base import ORACLES, query
from framelake.plans.sqltext import PX, SERIES, pal, redmean2
from framelake.sources.palettes import bayer, palette
from framelake.sources.tables import px

RGB = ["r", "g", "b"]
CELL = ["run_id", "y", "x"]


@dataclass(frozen=True)
class Studio:
    """Stages that are off add nothing to the plan."""

    every: int = 1
    offset: int = 0
    key: tuple[int, int, int] | None = None
    key_tolerance: float = 0.2
    block: int = 1
    stabilise: str = "off"  # off, despike, hysteresis, median3
    threshold: float = 40.0
    commit: int = 2
    hold: int = 3
    palette: str = ""
    metric: str = "redmean"
    dither: int = 0
    dither_strength: float = 0.0
    pingpong: bool = False
    height: int = 8
    width: int = 8


#: Presets of the look.
PRESETS = {
    "crisp": dict(palette="PICO-8", stabilise="despike", block=2),
    "classic": dict(palette="SWEETIE-16", dither=4, dither_strength=0.3, block=2),
    "handheld": dict(palette="GAMEBOY", stabilise="hysteresis", block=2),
}


def preset(name: str, **own) -> Studio:
    """A preset's configuration; values given by hand win."""
    return replace(Studio(), **(PRESETS[name] | own))


def run_studio(frames: DataFrame, c: Studio) -> DataFrame:
    """Decimate, key, reduce blocks, stabilise, dither, snap to a palette, loop: in this order."""
    spark = frames.sparkSession
    out = frames
    if c.every > 1 or c.offset:
        out = fr.decimate(out, c.every, c.offset)
    if c.key:
        flag = C.redmean2([F.col(x) for x in RGB], [F.lit(v) for v in c.key]) < (c.key_tolerance * 255) ** 2
        out = G.border_flood(out.withColumn("_m", flag), "_m", c.height, c.width).withColumn("a", F.when(F.col("bg"), 0.0).otherwise(1.0)).drop("_m", "bg")
    if c.block > 1:
        out = GR.block_trimmed_mean(out, c.block, c.height, c.width).withColumnsRenamed({"cy": "y", "cx": "x"})
    if c.stabilise == "despike":
        out = T.despike(out, RGB, c.threshold, CELL)
    elif c.stabilise == "hysteresis":
        out = T.hysteresis(out, RGB, c.threshold, c.commit, c.hold, CELL)
    elif c.stabilise == "median3":
        out = T.median3(out, RGB, CELL)
    if c.dither and c.dither_strength > 0:
        out = out.withColumns(dict(zip(RGB, C.dither([F.col(x) for x in RGB], F.col("y"), F.col("x"), bayer(c.dither), c.dither_strength), strict=True)))
    if c.palette:
        pal_ = palette(spark, c.palette).drop("palette")
        out = P.lookup(P.with_nearest(out, pal_, c.metric), pal_).drop("k_d2")
    if c.pingpong:
        out = fr.pingpong(out)
    return out


_E2 = redmean2(("r", "g", "b"), ("pr", "pg", "pb"))


@query("easy_studio", f"""WITH RECURSIVE {PX}, d0 AS (SELECT run_id, frame // 2 AS frame, y // 2 AS y, x // 2 AS x, r, g, b FROM px WHERE frame % 2 = 0),
m AS (SELECT *, median(r) OVER w AS mr, median(g) OVER w AS mg, median(b) OVER w AS mb FROM d0 WINDOW w AS (PARTITION BY run_id, frame, y, x)), nr AS (SELECT *, greatest(abs(r - mr), abs(g - mg), abs(b - mb)) <= 8 AS nr FROM m),
bl AS (SELECT run_id, frame, y, x, {', '.join(f"CAST(round_even(coalesce(avg({c}) FILTER (WHERE nr), any_value(m{c})), 0) AS BIGINT) AS {c}" for c in RGB)} FROM nr GROUP BY ALL),
n AS (SELECT *, lead(r) OVER w AS n_r, lead(g) OVER w AS n_g, lead(b) OVER w AS n_b FROM bl WINDOW w AS (PARTITION BY run_id, y, x ORDER BY frame)),
f AS (SELECT run_id, frame, y, x, r, g, b FROM n WHERE frame = 0 UNION ALL SELECT n.run_id, n.frame, n.y, n.x, CASE WHEN z THEN f.r ELSE n.r END, CASE WHEN z THEN f.g ELSE n.g END, CASE WHEN z THEN f.b ELSE n.b END FROM f JOIN n ON n.run_id = f.run_id AND n.y = f.y AND n.x = f.x AND n.frame = f.frame + 1,
 LATERAL (SELECT n_r IS NOT NULL AND greatest(abs(n.r - f.r), abs(n.g - f.g), abs(n.b - f.b)) > 40 AND greatest(abs(n_r - f.r), abs(n_g - f.g), abs(n_b - f.b)) <= 40 AS z)),
{pal('PICO-8')}, q AS (SELECT f.*, k, pr, pg, pb, row_number() OVER (PARTITION BY run_id, frame, y, x ORDER BY {_E2}, k) AS o FROM f CROSS JOIN pal)
SELECT run_id, frame, y, x, k, pr AS r, pg AS g, pb AS b FROM q WHERE o = 1""")
def _(s, d):
    return run_studio(px(s, d), preset("crisp", every=2)).select("run_id", "frame", "y", "x", "k", *RGB)


@query("quantize_pipeline", f"""WITH {PX}, t AS (SELECT run_id, frame, y, x, {', '.join(f"least(greatest({c} + (CAST([{', '.join(str(v) for row in bayer(4) for v in row)}][CAST((y % 4) * 4 + x % 4 + 1 AS INT)] AS DOUBLE) - 0.5) * 96 * 0.3, 0), 255) AS {c}" for c in RGB)} FROM px), {pal('SWEETIE-16')},
q AS (SELECT run_id, frame, y, x, k, row_number() OVER (PARTITION BY run_id, frame, y, x ORDER BY {_E2}, k) AS o FROM t CROSS JOIN pal) SELECT run_id, k, count(*) AS n FROM q WHERE o = 1 GROUP BY 1, 2""")
def _(s, d):
    out = run_studio(px(s, d), preset("classic", block=1))
    return out.groupBy("run_id", "k").agg(F.count(F.lit(1)).alias("n"))


from framelake.plans.temporals import _DEDUP, _hyst, _mid  # noqa: E402
from framelake.streaming import stateful as ST  # noqa: E402


@query("stream_dedup", f"{_DEDUP} SELECT key, pos, round(value, 6) AS value FROM o")
def _(s, d):
    return ST.drain(ST.keep_changes(ST.read_events(s, d), 150.0))


@query("stream_hysteresis", f"WITH RECURSIVE {SERIES}, {_hyst('series', 'key', 'pos', ['value'], 100, 2, 3)} SELECT key, pos, round(value, 6) AS value FROM f")
def _(s, d):
    return ST.drain(ST.hysteresis(ST.read_events(s, d), 100.0, 2, 3))


@query("stream_median3", f"WITH {SERIES}, m AS (SELECT key, pos, {_mid('value', True)} AS value, lead(value) OVER w IS NOT NULL AS known FROM series WINDOW w AS (PARTITION BY key ORDER BY pos)) SELECT key, pos, round(value, 6) AS value FROM m WHERE known")
def _(s, d):
    return ST.drain(ST.median3(ST.read_events(s, d)))


@query("stream_bands", ORACLES["band_hysteresis"])
def _(s, d):
    scaled = ST.read_events(s, d).withColumn("value", F.col("value") / 250)
    return ST.drain(ST.band_hysteresis(scaled, [0.6, 1.2], 0.1))


def _win(width: int, slide: int) -> str:
    k = width // slide
    return f"WITH e AS (SELECT CAST(epoch_us(ts) AS BIGINT) AS u, event_type, value FROM events), m AS (SELECT max(u) // 1000 / 1000.0 - 86400 AS wm FROM e), w AS (SELECT (u // 1000000 // {slide} - i) * {slide} AS s, event_type, value FROM e CROSS JOIN (SELECT unnest(range({k})) AS i)) SELECT CAST(s AS BIGINT) AS start_s, CAST(s + {width} AS BIGINT) AS end_s, event_type, count(*) AS n, round(sum(value), 6) AS total FROM w CROSS JOIN m WHERE s + {width} <= wm GROUP BY s, event_type"


@query("stream_tumbling", _win(3600, 3600))
def _(s, d):
    return ST.drain(ST.tumbling(ST.read_events(s, d), "1 hour", "1 day"))


@query("stream_sliding", _win(7200, 1800))
def _(s, d):
    return ST.drain(ST.sliding(ST.read_events(s, d), "2 hours", "30 minutes", "1 day"))


@query("stream_session", """WITH e AS (SELECT user_id AS key, CAST(epoch_us(ts) AS BIGINT) AS u, event_id, value FROM events), m AS (SELECT max(u) // 1000 * 1000 - CAST(86400000000 AS BIGINT) AS wm FROM e), g AS (SELECT *, CASE WHEN u - lag(u) OVER w >= 7200000000 OR lag(u) OVER w IS NULL THEN 1 ELSE 0 END AS st FROM e WINDOW w AS (PARTITION BY key ORDER BY u, event_id)),
c AS (SELECT *, sum(st) OVER (PARTITION BY key ORDER BY u, event_id) AS sid FROM g) SELECT key, min(u) // 1000000 AS start_s, (max(u) + 7200000000) // 1000000 AS end_s, count(*) AS n, round(sum(value), 6) AS total FROM c CROSS JOIN m GROUP BY key, sid, wm HAVING max(u) + 7200000000 <= wm""")
def _(s, d):
    return ST.drain(ST.sessions(ST.read_events(s, d), "2 hours", "1 day"))
