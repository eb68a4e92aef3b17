"""Queries on rasters, sampling and the motion lock."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelake.operators import raster as R
from framelake.plans.base import query
from framelake.plans.sqltext import LUM, PX
from framelake.sources.palettes import colours
from framelake.sources.tables import px, table

K = "run_id, frame, y, x"
KEY = ["run_id", "frame", "y", "x"]
RGB = ["r", "g", "b"]
H = W = 8


def _clip(e: str) -> str:
    return f"least(greatest({e}, 0), 255)"


@query("saturation", f"WITH {PX} SELECT {K}, " + ", ".join(f"round({_clip(f'{LUM} + ({c} - {LUM}) * CAST(1.25 AS DOUBLE)')}, 6) AS {c}" for c in RGB) + " FROM px")
def _(s, d):
    return R.saturate(px(s, d), 1.25)


@query("contrast", f"WITH {PX}, m AS (SELECT run_id, frame, floor(avg({LUM}) + 0.5) AS m FROM px GROUP BY 1, 2) SELECT {K}, " + ", ".join(f"round({_clip(f'm + ({c} - m) * CAST(1.1 AS DOUBLE)')}, 6) AS {c}" for c in RGB) + " FROM px JOIN m USING (run_id, frame)")
def _(s, d):
    return R.contrast(px(s, d), 1.1)


_OV = "greatest(0, least((p.{0} + 1) * 3 / CAST(8 AS DOUBLE), t.t + 1) - greatest(p.{0} * 3 / CAST(8 AS DOUBLE), t.t))"


@query("area_resize", f"WITH {PX}, t AS (SELECT unnest(range(3)) AS t), o AS (SELECT run_id, frame, ty.t AS ty, tx.t AS tx, r, g, b, {_OV.format('y').replace('t.t', 'ty.t')} * {_OV.format('x').replace('t.t', 'tx.t')} AS w FROM px p CROSS JOIN t ty CROSS JOIN t tx) SELECT run_id, frame, ty AS y, tx AS x, " + ", ".join(f"round(sum({c} * w) / sum(w), 6) AS {c}" for c in RGB) + " FROM o WHERE w > 0 GROUP BY run_id, frame, ty, tx")
def _(s, d):
    return R.area_resize(px(s, d), H, W, 3, 3)


#: Kernels by the distance z of a cell in units of the stretched cell; reach and new size of each query's part.
_KERNELS = {
    "bilinear": ("greatest(0, 1 - z)", 1, 5),
    "bicubic": ("CASE WHEN z < 1 THEN (1.5e0 * z - 2.5e0) * z * z + 1 WHEN z < 2 THEN -0.5e0 * (((z - 5) * z + 8) * z - 4) ELSE 0 END", 2, 3),
    "lanczos": ("CASE WHEN z < 1e-12 THEN 1 WHEN z < 3 THEN 3 * sin(pi() * z) * sin(pi() * z / 3) / (pi() * z * pi() * z) ELSE 0 END", 3, 12),
}


def _resample(kind: str) -> str:
    kernel, reach, new = _KERNELS[kind]
    scale, wide = f"{8 / new:.17e}", max(8 / new, 1.0)
    c = f"((t + 0.5e0) * {scale})"
    byte = lambda e: f"least(greatest(floor(round({e}, 6) + 0.5e0), 0), 255)"
    sums = ", ".join(f"{byte(f'sum({x} * w)')} AS {x}" for x in RGB)
    cells = f"SELECT t, i, abs(i + 0.5e0 - {c}) / {wide:.17e} AS z FROM (SELECT unnest(range({new})) AS t), (SELECT unnest(range(8)) AS i) WHERE i >= floor({c} - {reach * wide:.17e} + 0.5e0) AND i < floor({c} + {reach * wide:.17e} + 0.5e0)"
    return f"""{kind}_w AS (SELECT t, i, k / sum(k) OVER (PARTITION BY t) AS w FROM (SELECT t, i, CAST({kernel} AS DOUBLE) AS k FROM ({cells}))),
{kind}_h AS (SELECT run_id, frame, y, t AS x, {sums} FROM px JOIN {kind}_w ON x = i GROUP BY run_id, frame, y, t), {kind} AS (SELECT '{kind}' AS kernel, run_id, frame, t AS y, x, {sums} FROM {kind}_h JOIN {kind}_w ON y = i GROUP BY run_id, frame, t, x)"""


@query("resample", f"WITH {PX}, {', '.join(_resample(k) for k in _KERNELS)} " + " UNION ALL ".join(f"SELECT kernel, {K}, " + ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in RGB) + f" FROM {k}" for k in _KERNELS))
def _(s, d):
    parts = [R.resample(px(s, d), k, H, W, new, new).withColumn("kernel", F.lit(k)) for k, (_, _, new) in _KERNELS.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("pad_canvas", f"WITH {PX}, f AS (SELECT DISTINCT run_id, frame FROM px), c AS (SELECT run_id, frame, y, x FROM f, (SELECT unnest(range(12)) AS y), (SELECT unnest(range(12)) AS x)) SELECT c.run_id, c.frame, c.y, c.x, coalesce(r, 1) AS r, coalesce(g, 2) AS g, coalesce(b, 3) AS b FROM c LEFT JOIN px ON px.run_id = c.run_id AND px.frame = c.frame AND px.y = c.y - 2 AND px.x = c.x - 2")
def _(s, d):
    return R.pad_to(px(s, d), H, W, 12, (1, 2, 3))


@query("nearest_opaque", f"WITH {PX}, w AS (SELECT p.run_id, p.frame, p.y, p.x, q.r, q.g, q.b, row_number() OVER (PARTITION BY p.run_id, p.frame, p.y, p.x ORDER BY power(q.y - p.y, 2) + power(q.x - p.x, 2), q.y, q.x) AS o FROM px p JOIN px q ON p.run_id = q.run_id AND p.frame = q.frame WHERE q.a > 0.5) SELECT {K}, CAST(r AS DOUBLE) AS r, CAST(g AS DOUBLE) AS g, CAST(b AS DOUBLE) AS b FROM w WHERE o = 1")
def _(s, d):
    return R.nearest_opaque(px(s, d, alpha=True), H, W)


@query("sample_pixels", f"WITH {PX}, n AS (SELECT run_id, count(DISTINCT frame) AS f FROM px GROUP BY 1), k AS (SELECT *, row_number() OVER (PARTITION BY run_id, frame ORDER BY md5(concat_ws('-', run_id, frame, y, x))) AS o FROM px) SELECT {K}, r, g, b FROM k JOIN n USING (run_id) WHERE o <= greatest(1, floor(200 / f))")
def _(s, d):
    return R.sample_pixels(px(s, d), 200)


@query("stride_sample", f"WITH {PX}, k AS (SELECT *, count(*) OVER (PARTITION BY run_id) AS n, row_number() OVER (PARTITION BY run_id ORDER BY frame, y, x) - 1 AS i FROM px) SELECT {K}, r, g, b FROM k WHERE i % CASE WHEN n > 500 THEN n // 500 + 1 ELSE 1 END = 0")
def _(s, d):
    return R.stride_sample(px(s, d), 500)


_MIS = ", ".join(
    f"c{a} AS (SELECT run_id, frame, s, o, {b} AS l, ({a} - o) // s AS cell, lb, count(*) AS n FROM lb CROSS JOIN cand WHERE {a} >= o AND {a} - o < s * ((8 - o) // s) GROUP BY ALL), "
    f"tp{a} AS (SELECT run_id, frame, s, o, l, cell, max(n) AS top, sum(n) AS al FROM c{a} GROUP BY ALL), f{a} AS (SELECT run_id, frame, s, o, round(1 - sum(top) / CAST(sum(al) AS DOUBLE), 9) AS m FROM tp{a} GROUP BY ALL), "
    f"pk{a} AS (SELECT *, row_number() OVER (PARTITION BY run_id, frame, s ORDER BY m, o) AS rk FROM f{a})"
    for a, b in (("x", "y"), ("y", "x"))
)
_FIT = f"WITH {PX}, lb AS (SELECT {K}, r // 86 AS lb FROM px), cand AS (SELECT s, o FROM (SELECT unnest([2, 3, 4]) AS s), (SELECT unnest(range(4)) AS o) WHERE o < s AND (8 - o) // s >= 2), {_MIS}, ft AS (SELECT x.run_id, x.frame, x.s, (x.m + y.m) / 2 AS mm, x.o AS ox, y.o AS oy FROM pkx x JOIN pky y ON x.run_id = y.run_id AND x.frame = y.frame AND x.s = y.s WHERE x.rk = 1 AND y.rk = 1)"


@query("block_mismatch", f"{_FIT} SELECT run_id, frame, CAST(s AS BIGINT) AS s, round(mm, 6) AS mismatch, ox, oy FROM ft")
def _(s, d):
    return R.block_mismatch(px(s, d).withColumn("l", F.floor(F.col("r") / 86)), "l", [2, 3, 4], H, W)


@query("reference_block", f"{_FIT}, z AS (SELECT *, min(mm) OVER (PARTITION BY run_id, frame) AS best FROM ft), w AS (SELECT *, row_number() OVER (PARTITION BY run_id, frame ORDER BY s DESC, mm DESC, ox DESC, oy DESC) AS rk FROM z WHERE best <= 0.3 AND mm <= best * 1.3 + 1e-9) SELECT run_id, frame, CAST(s AS BIGINT) AS s, round(mm, 6) AS mismatch, ox, oy FROM w WHERE rk = 1")
def _(s, d):
    return R.choose_reference_block(R.block_mismatch(px(s, d).withColumn("l", F.floor(F.col("r") / 86)), "l", [2, 3, 4], H, W), 0.3)


@query("payload_groups", "SELECT event_type || '/' || CAST(user_id AS VARCHAR) AS stage, count(*) AS n, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY ts, event_id) AS ids FROM events GROUP BY 1")
def _(s, d):
    stage = F.concat_ws("/", "event_type", "user_id").alias("stage")
    lists = table(s, d, "events").groupBy(stage).agg(F.sort_array(F.collect_list(F.struct("ts", "event_id"))).alias("l"))
    return lists.select("stage", F.size("l").alias("n"), F.array_join(F.transform("l", lambda e: e["event_id"].cast("string")), ",").alias("ids"))


def _taps(src: str, name: str, axis: str, place: str, weights: str, cols: list[str]) -> str:
    """CTE ``name``: sums of ``cols`` of ``src`` along an axis, weighted by g at the steps d of ``weights``; ``place`` folds p + d into the frame."""
    other = "x" if axis == "y" else "y"
    at = place.format(e=f"(p.{axis} + n.d)")
    sums = ", ".join(f"sum(q.{c} * n.g) AS {c}" for c in cols)
    return f"{name} AS (SELECT p.run_id, p.frame, p.y, p.x, {sums} FROM px p CROSS JOIN {weights} n JOIN {src} q ON q.run_id = p.run_id AND q.frame = p.frame AND q.{other} = p.{other} AND q.{axis} = {at} GROUP BY p.run_id, p.frame, p.y, p.x)"


def _gauss(reach: int, sigma: float) -> str:
    return f"gw AS (SELECT d, g / sum(g) OVER () AS g FROM (SELECT d, exp(-d * d / {2 * sigma * sigma:.17e}) AS g FROM (SELECT unnest(range({-reach}, {reach + 1})) AS d)))"


_MIRROR = "(CASE WHEN {e} < 0 THEN -1 - {e} WHEN {e} > 7 THEN 15 - {e} ELSE {e} END)"
_CLAMP = "least(greatest({e}, 0), 7)"
_REFLECT = "(CASE WHEN {e} < 0 THEN -{e} WHEN {e} > 7 THEN 14 - {e} ELSE {e} END)"


@query("gaussian_feather", f"WITH {PX}, {_gauss(3, 0.8)}, {_taps('px', 'v', 'y', _MIRROR, 'gw', ['a'])}, {_taps('v', 'z', 'x', _MIRROR, 'gw', ['a'])} SELECT {K}, r, g, b, round(least(greatest(z.a, 0), 1), 6) AS a FROM px JOIN z USING ({K})")
def _(s, d):
    return R.feather(px(s, d, alpha=True), 0.1, H, W)


_ROUND9 = "o AS (SELECT dy, dx FROM (SELECT unnest(range(-4, 5)) AS dy), (SELECT unnest(range(-4, 5)) AS dx) WHERE dy * dy + dx * dx <= 16)"


@query("bilateral_flatten", f"WITH {PX}, {_ROUND9}, n AS (SELECT p.run_id, p.frame, p.y, p.x, q.r, q.g, q.b, exp(-(dy * dy + dx * dx) / 162e0 - power(abs(q.r - p.r) + abs(q.g - p.g) + abs(q.b - p.b), 2) / 1800e0) AS w FROM px p CROSS JOIN o JOIN px q ON q.run_id = p.run_id AND q.frame = p.frame AND q.y = {_REFLECT.format(e='(p.y + dy)')} AND q.x = {_REFLECT.format(e='(p.x + dx)')}) SELECT {K}, " + ", ".join(f"round_even(sum({c} * w) / sum(w), 0) AS {c}" for c in RGB) + f" FROM n GROUP BY {K}")
def _(s, d):
    return R.bilateral(px(s, d), 1.0, 1, H, W)


@query("unsharp", f"WITH {PX}, {_gauss(6, 2.0)}, {_taps('px', 'v', 'y', _CLAMP, 'gw', RGB)}, {_taps('v', 'z', 'x', _CLAMP, 'gw', RGB)} SELECT {K}, " + ", ".join(f"round(CASE WHEN abs(px.{c} - z.{c}) > 2 THEN {_clip(f'px.{c} + 0.9e0 * (px.{c} - z.{c})')} ELSE CAST(px.{c} AS DOUBLE) END, 6) AS {c}" for c in RGB) + f" FROM px JOIN z USING ({K})")
def _(s, d):
    return R.unsharp(px(s, d), 0.6, H, W)


@query("floyd_steinberg")
def _(s, d):
    return R.floyd_steinberg(px(s, d), colours("PICO-8"), H, W)


@query("median_cut")
def _(s, d):
    return R.median_cut(px(s, d), 16)


@query("shared_palette")
def _(s, d):
    return R.shared_palette(px(s, d).withColumns({c: F.floor(F.col(c) / F.when(F.col("run_id") % 2 == 0, 64).otherwise(8)) for c in RGB}), 32)


@query("movelock")
def _(s, d):
    p = px(s, d, alpha=True)
    coarse = p.withColumns({c: (F.floor(F.col(c) / 64) * 64).cast("int") for c in RGB})
    return R.movelock(p, coarse, 60.0, H, W)


@query("subject_rescue")
def _(s, d):
    p = px(s, d, alpha=True).withColumns({"bg": F.col("r") < 215, "strict": F.col("r") < 120})
    return R.rescue_subject(p, "bg", "strict", H, W, 0.9, 0.08).select(*KEY, "bg", "saved")
