"""Queries on scans, colour functions, palette joins and palette building."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelake.functions import color as C
from framelake.operators import frames as fr
from framelake.operators import palette as P
from framelake.plans.base import query
from framelake.plans.sqltext import LUM, PX, channel, hcl, lab_cte, pal, redmean2
from framelake.sources.palettes import bayer, palette, palette_sql
from framelake.sources.tables import px, table

KEY = ["run_id", "frame", "y", "x"]
RGB = ["r", "g", "b"]


def cols():
    return [F.col(c) for c in RGB]


K = "run_id, frame, y, x"
P3 = ("pr", "pg", "pb")
C3 = ("r", "g", "b")


def p8(spark):
    return palette(spark, "PICO-8").drop("palette")


@query("px_view", f"WITH {PX} SELECT {K}, r, g, b, a FROM px")
def _(s, d):
    return px(s, d, alpha=True)


@query("frame_decimate", f"WITH {PX} SELECT run_id, (frame - 1) // 3 AS frame, y, x, r, g, b FROM px WHERE frame >= 1 AND (frame - 1) % 3 = 0")
def _(s, d):
    return fr.decimate(px(s, d), every=3, offset=1)


@query("frame_pick", f"WITH {PX}, m AS (SELECT run_id, max(frame) AS last FROM px GROUP BY 1) SELECT {K}, r, g, b FROM px JOIN m USING (run_id) WHERE frame = least(25, last)")
def _(s, d):
    return fr.pick(px(s, d), 25)


@query("thin_indices", f"WITH {PX}, n AS (SELECT run_id, max(frame) + 1 AS n FROM px GROUP BY 1), t AS (SELECT DISTINCT run_id, CAST(round_even(i * (n - 1) / CAST(6 AS DOUBLE), 0) AS BIGINT) AS frame FROM n, (SELECT unnest(range(7)) AS i) WHERE n > 7 UNION SELECT run_id, f FROM n, (SELECT unnest(range(20)) AS f) WHERE n <= 7 AND f < n) SELECT {K}, r, g, b FROM px JOIN t USING (run_id, frame)")
def _(s, d):
    return fr.thin(px(s, d), 7)


@query("marquee_crop", f"WITH {PX} SELECT run_id, frame, y - 1 AS y, x - 2 AS x, r, g, b FROM px WHERE y BETWEEN 1 AND 5 AND x BETWEEN 2 AND 7")
def _(s, d):
    return fr.crop(px(s, d), 2, 1, 12, 5, 8, 8)


@query("snapped_grid_crop", f"WITH {PX} SELECT run_id, frame, y - 1 AS y, x - 1 AS x, r, g, b FROM px WHERE y >= 1 AND y < 7 AND x >= 1 AND x < 7")
def _(s, d):
    return fr.snap_crop(px(s, d), 3, 1, 1, 8, 8)


@query("frame_cap", f"WITH {PX} SELECT {K}, r, g, b FROM px WHERE frame < 5")
def _(s, d):
    return fr.cap(px(s, d), 5)


@query("upscale_nearest", f"WITH {PX} SELECT run_id, frame, y * 2 + i AS y, x * 2 + j AS x, r, g, b FROM px, (SELECT unnest(range(2)) AS i), (SELECT unnest(range(2)) AS j)")
def _(s, d):
    return fr.upscale(px(s, d), 2)


@query("premultiplied_downscale", f"""WITH {PX}, s AS (SELECT run_id, frame, y // 2 AS y, x // 2 AS x, avg(a) AS am, avg(r * a) AS rm, avg(g * a) AS gm, avg(b * a) AS bm FROM px GROUP BY ALL)
SELECT {K}, CASE WHEN am > 0.5 THEN round(rm / greatest(am, 1e-3), 6) ELSE 0 END AS r, CASE WHEN am > 0.5 THEN round(gm / greatest(am, 1e-3), 6) ELSE 0 END AS g, CASE WHEN am > 0.5 THEN round(bm / greatest(am, 1e-3), 6) ELSE 0 END AS b, CAST(am > 0.5 AS BIGINT) AS a FROM s""")
def _(s, d):
    return fr.shrink_premultiplied(px(s, d, alpha=True), 2)


@query("lab", f"WITH {PX}, {lab_cte('px', 'q')} SELECT {K}, round(L, 6) + 0.0 AS l, round(A, 6) + 0.0 AS a, round(B, 6) + 0.0 AS b FROM (SELECT {K}, L, A, B FROM (SELECT * EXCLUDE (a, b) FROM q_3) t, LATERAL (SELECT 116.0 * f2 - 16.0 AS L, 500.0 * (f1 - f2) AS A, 200.0 * (f2 - f3) AS B))")
def _(s, d):
    L, A, B = C.lab(cols())
    return px(s, d).select(*KEY, L.alias("l"), A.alias("a"), B.alias("b"))


@query("lab_roundtrip", f"WITH {PX} SELECT {K}, r, g, b FROM px")
def _(s, d):
    rows = px(s, d).withColumns(dict(zip(("cl", "ca", "cb"), C.lab(cols()), strict=True)))
    return rows.select(*KEY, *[F.rint(v).cast("int").alias(n) for n, v in zip(RGB, C.rgb_from_lab([F.col("cl"), F.col("ca"), F.col("cb")]), strict=True)])


@query("luminance", f"WITH {PX} SELECT {K}, round({LUM}, 6) AS lum FROM px")
def _(s, d):
    return px(s, d).select(*KEY, C.luminance(cols()).alias("lum"))


@query("redmean", f"WITH {PX} SELECT {K}, round({redmean2(C3, ('29', '43', '83'))}, 6) AS d2 FROM px")
def _(s, d):
    return px(s, d).select(*KEY, C.redmean2(cols(), [F.lit(29), F.lit(43), F.lit(83)]).alias("d2"))


HSV_SQL = f"""WITH {PX}, u AS (SELECT {K}, r / CAST(255 AS DOUBLE) AS r, g / CAST(255 AS DOUBLE) AS g, b / CAST(255 AS DOUBLE) AS b FROM px),
m AS (SELECT *, greatest(r, g, b) AS mx, greatest(r, g, b) - least(r, g, b) AS ch FROM u),
t AS (SELECT *, CASE WHEN mx = b THEN (r - g) / greatest(ch, 1e-9) + 4 WHEN mx = g THEN (b - r) / greatest(ch, 1e-9) + 2 ELSE (g - b) / greatest(ch, 1e-9) - 6 * floor((g - b) / greatest(ch, 1e-9) / 6) END AS h6 FROM m)
SELECT {K}, round(CASE WHEN ch > 1e-6 THEN h6 / 6 ELSE 0 END, 6) AS h, round(CASE WHEN mx > 1e-6 THEN ch / mx ELSE 0 END, 6) AS s, round(mx, 6) AS v FROM t"""


@query("hsv", HSV_SQL)
def _(s, d):
    h, sat, v = C.hsv(cols())
    return px(s, d).select(*KEY, h.alias("h"), sat.alias("s"), v.alias("v"))


@query("hsv_roundtrip", f"WITH {PX} SELECT {K}, r, g, b FROM px")
def _(s, d):
    rows = px(s, d).withColumns(dict(zip(("h", "s", "v"), C.hsv(cols()), strict=True)))
    return rows.select(*KEY, *[F.rint(v).cast("int").alias(n) for n, v in zip(RGB, C.rgb_from_hsv([F.col("h"), F.col("s"), F.col("v")]), strict=True)])


@query("hcl", f"WITH {PX}, q AS (SELECT {K}, {hcl()} FROM px) SELECT {K}, round(h, 6) AS h, c, round(l, 6) AS l FROM q")
def _(s, d):
    h, c, lum = C.hcl(cols())
    return px(s, d).select(*KEY, h.alias("h"), c.alias("c"), lum.alias("l"))


@query("hex_encode", f"WITH {PX} SELECT {K}, '#' || printf('%02X%02X%02X', r, g, b) AS hex FROM px")
def _(s, d):
    return px(s, d).select(*KEY, C.hex_of(cols()).alias("hex"))


@query("hex_decode", f"SELECT palette, k, r, g, b FROM ({palette_sql()})")
def _(s, d):
    pal = palette(s).select("palette", "k", C.hex_of(cols()).alias("hex"))
    return pal.select("palette", "k", *[v.alias(n) for n, v in zip(RGB, C.rgb_of_hex(F.col("hex")), strict=True)])


_B4 = ", ".join(str(v) for row in bayer(4) for v in row)


@query("bayer_dither", f"WITH {PX}, t AS (SELECT *, (CAST([{_B4}][CAST((y % 4) * 4 + x % 4 + 1 AS INT)] AS DOUBLE) - 0.5) * 96 * 0.3 AS t FROM px) SELECT {K}, round(least(greatest(r + t, 0), 255), 6) AS r, round(least(greatest(g + t, 0), 255), 6) AS g, round(least(greatest(b + t, 0), 255), 6) AS b FROM t")
def _(s, d):
    return px(s, d).select(*KEY, *[v.alias(n) for n, v in zip(RGB, C.dither(cols(), F.col("y"), F.col("x"), bayer(4), 0.3), strict=True)])


@query("circular_hue", f"WITH {PX}, q AS (SELECT {K}, {hcl()} FROM px) SELECT {K}, round(least(abs(h - 350), 360 - abs(h - 350)), 6) AS gap, round((h / 360 + (((250.0 / CAST(360 AS DOUBLE) - h / 360 + 0.5) - floor(250.0 / CAST(360 AS DOUBLE) - h / 360 + 0.5)) - 0.5) * 0.4) - floor(h / 360 + (((250.0 / CAST(360 AS DOUBLE) - h / 360 + 0.5) - floor(250.0 / CAST(360 AS DOUBLE) - h / 360 + 0.5)) - 0.5) * 0.4), 6) AS turned FROM q")
def _(s, d):
    h, _, _ = C.hcl(cols())
    return px(s, d).select(*KEY, h.alias("h")).select(*KEY, C.hue_distance(F.col("h"), F.lit(350)).alias("gap"), C.hue_lerp(F.col("h") / 360, 250.0 / 360.0, 0.4).alias("turned"))


def _argmin(dist: str, name: str = "PICO-8") -> str:
    return f"WITH {PX}, {pal(name)}, d AS (SELECT {K}, r, g, b, k, {dist} AS d FROM px CROSS JOIN pal), w AS (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY d, k) AS n FROM d)"


_E2 = "(power(r - pr, 2) + power(g - pg, 2) + power(b - pb, 2))"


@query("nearest_rgb", f"{_argmin(_E2)} SELECT {K}, k, round(d, 6) AS k_d2 FROM w WHERE n = 1")
def _(s, d):
    return P.with_nearest(px(s, d), p8(s)).select(*KEY, "k", "k_d2")


@query("nearest_lab", f"""WITH {PX}, {pal('PICO-8')}, px0 AS (SELECT {K}, r, g, b AS bb FROM px), {lab_cte('px0', 'q', b='bb')}, pal0 AS (SELECT k, pr, pg, pb FROM pal), {lab_cte('pal0', 'e', 'pr', 'pg', 'pb')},
d AS (SELECT q.run_id, q.frame, q.y, q.x, e.k, power(q.L - e.L, 2) + power(q.A - e.A, 2) + power(q.B - e.B, 2) AS d FROM q CROSS JOIN e), w AS (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY d, k) AS n FROM d) SELECT {K}, k FROM w WHERE n = 1""")
def _(s, d):
    return P.with_nearest(px(s, d), p8(s), "lab").select(*KEY, "k")


@query("redmean_snap", f"{_argmin(redmean2(C3, P3))} SELECT run_id, k, count(*) AS n FROM w WHERE n = 1 GROUP BY 1, 2")
def _(s, d):
    return P.with_nearest(px(s, d), p8(s), "redmean").groupBy("run_id", "k").agg(F.count(F.lit(1)).alias("n"))


@query("palette_lookup", f"WITH {PX}, {pal('PICO-8')} SELECT {K}, pr AS r, pg AS g, pb AS b FROM px JOIN pal ON k = least(px.r // 8, 15)")
def _(s, d):
    return P.lookup(px(s, d).withColumn("k", F.floor(F.col("r") / 8).cast("int")), p8(s)).select(*KEY, *RGB)


@query("ref_snap_capped", f"{_argmin(redmean2(C3, P3))} SELECT {K}, CASE WHEN d <= 14400 THEN pr ELSE r END AS r, CASE WHEN d <= 14400 THEN pg ELSE g END AS g, CASE WHEN d <= 14400 THEN pb ELSE b END AS b, d <= 14400 AS snapped FROM w JOIN pal USING (k) WHERE n = 1")
def _(s, d):
    return P.snap_capped(px(s, d), p8(s), 120.0).select(*KEY, *RGB, "snapped")


@query("ramp_classify", f"""WITH {PX}, {pal('ENDESGA-32')}, e AS (SELECT k, pr, pg, pb, {hcl('pr', 'pg', 'pb', ('eh', 'ec', 'el'))} FROM pal), q AS (SELECT {K}, r, g, b, {hcl()} FROM px),
j AS (SELECT q.*, e.*, least(abs(h - eh), 360 - abs(h - eh)) AS gap, abs(l - el) AS dl, {redmean2(C3, P3)} AS rd FROM q CROSS JOIN e),
a AS (SELECT {K}, any_value(c) AS c, any_value(l) AS l,
  arg_min(k, dl * 1000000 + k) FILTER (WHERE ec < 25) AS grey, arg_min(k, -el * 1000000 + k) FILTER (WHERE ec >= 25 AND gap <= 35) AS light,
  arg_min(k, dl * 1000000 + k) FILTER (WHERE ec >= 25 AND gap <= 35) AS near, arg_min(k, gap * 1000000 + k) FILTER (WHERE ec >= 25) AS hue, arg_min(k, rd * 1000000 + k) AS red FROM j GROUP BY ALL)
SELECT {K}, CASE WHEN c >= 6 AND c < 25 AND l >= 200 THEN coalesce(light, grey, red) WHEN c < 25 THEN coalesce(grey, red) ELSE coalesce(near, hue, red) END AS k FROM a""")
def _(s, d):
    return P.with_ramp_class(px(s, d), palette(s, "ENDESGA-32").drop("palette")).select(*KEY, "k")


@query("palette_top24", f"WITH {PX}, n AS (SELECT run_id, r, g, b, count(*) AS n FROM px WHERE a > 0.5 GROUP BY ALL), w AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY n DESC, r, g, b) AS rank FROM n) SELECT * FROM w WHERE rank <= 24")
def _(s, d):
    return P.top_colours(px(s, d, alpha=True).where("a > 0.5"), ["run_id"])


@query("exact_palette", f"WITH {PX}, n AS (SELECT run_id, count(DISTINCT r * 65536 + g * 256 + b) AS n FROM px GROUP BY 1) SELECT run_id, n, n <= 255 AS exact FROM n")
def _(s, d):
    return P.colour_counts(px(s, d), "run_id").groupBy("run_id").agg(F.count(F.lit(1)).alias("n")).withColumn("exact", F.col("n") <= 255)


@query("used_palette", f"WITH {PX}, n AS (SELECT DISTINCT run_id, r // 32 AS r, g // 32 AS g, b // 32 AS b FROM px) SELECT run_id, r, g, b, row_number() OVER (PARTITION BY run_id ORDER BY r, g, b) - 1 AS k FROM n")
def _(s, d):
    coarse = px(s, d).select("run_id", *[F.floor(F.col(c) / 32).alias(c) for c in RGB])
    return P.indexed_palette(coarse, ["run_id"])


@query("merge_palette", f"""WITH RECURSIVE p0 AS (SELECT palette, k, r, g, b AS bb FROM ({palette_sql()})), {lab_cte('p0', 'q', b='bb')}, n AS (SELECT palette, count(*) AS n FROM p0 GROUP BY 1),
f AS (SELECT palette, 0 AS i, [{{'k': k, 'l': L, 'a': A, 'b': B}}] AS kept FROM q WHERE k = 0
  UNION ALL SELECT f.palette, i + 1, CASE WHEN n.n > 2 AND list_min(list_transform(kept, lambda o: sqrt(power(o.l - q.L, 2) + power(o.a - q.A, 2) + power(o.b - q.B, 2)))) < 7 THEN kept ELSE list_append(kept, {{'k': q.k, 'l': q.L, 'a': q.A, 'b': q.B}}) END
  FROM f JOIN q ON q.palette = f.palette AND q.k = f.i + 1 JOIN n ON n.palette = f.palette),
l AS (SELECT palette, kept FROM f JOIN n USING (palette) WHERE i = n.n - 1), u AS (SELECT palette, unnest(list_transform(kept, lambda o: o.k)) AS k FROM l)
SELECT palette, k, r, g, bb AS b FROM u JOIN p0 USING (palette, k)""")
def _(s, d):
    return P.merge_near(palette(s), ["palette"]).select("palette", "k", *RGB)


@query("demuddy_core", f"""WITH {PX}, {pal('PICO-8')}, rn AS (SELECT DISTINCT run_id FROM px), d AS (SELECT {K}, r, g, b, k, pr, pg, pb, {redmean2(C3, P3)} AS d FROM px CROSS JOIN pal),
w AS (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY d, k) AS n FROM d), o AS (SELECT *, row_number() OVER (PARTITION BY run_id, k ORDER BY d, {K}, r, g, b) AS rk, count(*) OVER (PARTITION BY run_id, k) AS sz FROM w WHERE n = 1),
c AS (SELECT *, greatest(r, g, b) - least(r, g, b) AS ch FROM o WHERE rk <= greatest(1, least(150, floor(sz * CAST(0.4 AS DOUBLE))))), m AS (SELECT *, row_number() OVER (PARTITION BY run_id, k ORDER BY ch DESC, rk) AS t FROM c)
SELECT rn.run_id, pal.k, CAST(CASE WHEN m.ch > 20 AND m.ch > greatest(pal.pr, pal.pg, pal.pb) - least(pal.pr, pal.pg, pal.pb) THEN round_even(pal.pr * 0.25 + m.r * 0.75, 0) ELSE pal.pr END AS BIGINT) AS r,
 CAST(CASE WHEN m.ch > 20 AND m.ch > greatest(pal.pr, pal.pg, pal.pb) - least(pal.pr, pal.pg, pal.pb) THEN round_even(pal.pg * 0.25 + m.g * 0.75, 0) ELSE pal.pg END AS BIGINT) AS g,
 CAST(CASE WHEN m.ch > 20 AND m.ch > greatest(pal.pr, pal.pg, pal.pb) - least(pal.pr, pal.pg, pal.pb) THEN round_even(pal.pb * 0.25 + m.b * 0.75, 0) ELSE pal.pb END AS BIGINT) AS b FROM rn CROSS JOIN pal LEFT JOIN m ON m.run_id = rn.run_id AND m.k = pal.k AND m.t = 1""")
def _(s, d):
    return P.pull_to_core(px(s, d), p8(s), ["run_id"])


def _ramp_sql() -> str:
    u = "u AS (SELECT k, pr / CAST(255 AS DOUBLE) AS r, pg / CAST(255 AS DOUBLE) AS g, pb / CAST(255 AS DOUBLE) AS b FROM pal), m AS (SELECT *, greatest(r, g, b) AS v, greatest(r, g, b) - least(r, g, b) AS ch FROM u), t AS (SELECT *, CASE WHEN v = b THEN (r - g) / greatest(ch, 1e-9) + 4 WHEN v = g THEN (b - r) / greatest(ch, 1e-9) + 2 ELSE (g - b) / greatest(ch, 1e-9) - 6 * floor((g - b) / greatest(ch, 1e-9) / 6) END / 6 AS h6 FROM m), s0 AS (SELECT k, CASE WHEN ch > 1e-6 THEN h6 ELSE 0 END AS h, CASE WHEN v > 1e-6 THEN ch / v ELSE 0 END AS s, v FROM t)"
    mod1 = lambda e: f"(({e}) - floor({e}))"
    lerp = lambda h, t, a: mod1(f"{h} + ({mod1(f'{t} - {h} + 0.5')} - 0.5) * {a}")
    bands = "b0 AS (SELECT * FROM (VALUES (CAST(0 AS BIGINT), 0.35, 0.0), (1, 0.6425, 0.3333333333333333), (2, 0.8375, 0.6666666666666666), (3, 1.0, 1.0)) AS z(band, mult, t))"
    h1 = lerp("h", "(250.0 / CAST(360 AS DOUBLE))", "(0.3 * (1 - CAST(t AS DOUBLE)) * 0.8)")
    w = f"w1 AS (SELECT k, band, t, s, v * CAST(mult AS DOUBLE) AS v, {h1} AS h FROM s0 CROSS JOIN b0), w2 AS (SELECT k, band, least(s * (1 + 0.3 * (1 - CAST(t AS DOUBLE)) * 0.35), 1) AS s, v, {lerp('h', '(40.0 / CAST(360 AS DOUBLE))', '(0.3 * greatest(0, CAST(t AS DOUBLE) - 0.5))')} AS h FROM w1), w3 AS (SELECT *, CAST(floor(h * 6) AS INT) % 6 AS i, h * 6 - floor(h * 6) AS f FROM w2), w4 AS (SELECT *, v * (1 - s) AS p, v * (1 - f * s) AS q, v * (1 - (1 - f) * s) AS u FROM w3)"
    pick = lambda *x: "CASE i " + " ".join(f"WHEN {n} THEN {e}" for n, e in enumerate(x)) + " END"
    return f"WITH {pal('SWEETIE-16')}, {u}, {bands}, {w} SELECT k, band, round({pick('v', 'q', 'p', 'p', 'u', 'v')} * 255, 6) AS r, round({pick('u', 'v', 'v', 'q', 'p', 'p')} * 255, 6) AS g, round({pick('p', 'p', 'u', 'v', 'v', 'q')} * 255, 6) AS b FROM w4"


@query("shade_ramp", _ramp_sql())
def _(s, d):
    return P.shade_ramp(palette(s, "SWEETIE-16").drop("palette"), 4, 0.35, 0.3)


def _kmeans_sql(steps: int) -> str:
    ctes = [PX, "n AS (SELECT r, g, b, count(*) AS n FROM px GROUP BY ALL)", pal("GAMEBOY", "c0")]
    for i in range(steps):
        ctes.append(f"d{i} AS (SELECT r, g, b, n, k, row_number() OVER (PARTITION BY r, g, b ORDER BY {_E2}, k) AS o FROM n CROSS JOIN c{i})")
        ctes.append(f"m{i} AS (SELECT k, sum(r * n) / CAST(sum(n) AS DOUBLE) AS r, sum(g * n) / CAST(sum(n) AS DOUBLE) AS g, sum(b * n) / CAST(sum(n) AS DOUBLE) AS b FROM d{i} WHERE o = 1 GROUP BY k)")
        ctes.append(f"c{i + 1} AS (SELECT c.k, coalesce(m.r, pr) AS pr, coalesce(m.g, pg) AS pg, coalesce(m.b, pb) AS pb FROM c{i} c LEFT JOIN m{i} m USING (k))")
    return f"WITH {', '.join(ctes)} SELECT k, round(pr, 6) AS r, round(pg, 6) AS g, round(pb, 6) AS b FROM c{steps}"


@query("kmeans_palette", _kmeans_sql(3))
def _(s, d):
    return P.kmeans(px(s, d), palette(s, "GAMEBOY").drop("palette"), 3)


def _seeds_sql(most: int) -> str:
    ctes = [PX, "n AS (SELECT r, g, b, count(*) AS n FROM px GROUP BY ALL)"]
    for i in range(most):
        gaps = [f"(power(n.r - s{j}.r, 2) + power(n.g - s{j}.g, 2) + power(n.b - s{j}.b, 2))" for j in range(i)]
        gap = f"least({', '.join(gaps)})" if gaps else "CAST(1 AS DOUBLE)"
        u = f"(CAST('0x' || substr(md5(concat_ws('-', {i}, n.r, n.g, n.b)), 1, 8) AS BIGINT) + 1) / 4294967296e0"
        ctes.append(f"s{i} AS (SELECT {i} AS k, n.r, n.g, n.b FROM n{''.join(f', s{j}' for j in range(i))} WHERE {gap} > 0 ORDER BY -ln({u}) / (n.n * {gap}), n.r, n.g, n.b LIMIT 1)")
    return f"WITH {', '.join(ctes)} " + " UNION ALL ".join(f"SELECT k, CAST(r AS DOUBLE) AS r, CAST(g AS DOUBLE) AS g, CAST(b AS DOUBLE) AS b FROM s{i}" for i in range(most))


@query("kmeans_seeds", _seeds_sql(5))
def _(s, d):
    return P.spread_seeds(P.colour_counts(px(s, d)), 5)
