"""Queries on neighbourhoods and components."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelake.operators import graph as G
from framelake.operators import palette as P
from framelake.operators import raster as R
from framelake.operators import stencil as S
from framelake.plans.base import query
from framelake.plans.sqltext import PX, hcl, lab_cte, pal, redmean2
from framelake.sources.palettes import palette, palette_sql
from framelake.sources.tables import px

K = "run_id, frame, y, x"
KEY = ["run_id", "frame", "y", "x"]
RGB = ["r", "g", "b"]
H = W = 8

_CLASS = "c AS (SELECT *, r // 86 * 4 + g // 128 * 2 + b // 128 AS k FROM px)"


def _classes(s, d):
    k = F.floor(F.col("r") / 86) * 4 + F.floor(F.col("g") / 128) * 2 + F.floor(F.col("b") / 128)
    return px(s, d, alpha=True).withColumn("k", k.cast("int"))


def _off(k: int, centre: bool = True) -> str:
    return "o AS (SELECT * FROM (VALUES " + ", ".join(f"({dy}, {dx})" for dy, dx in S.square(k, centre)) + ") AS o(dy, dx))"


def _near(src: str, name: str, cols: str, pad: str = "edge", where: str = "") -> str:
    """CTE ``name``: target pixels of ``src``, offset, and columns of the neighbour as q_*."""
    q = ", ".join(f"q.{c} AS q_{c}" for c in cols.split(", "))
    if pad == "edge":
        on = "q.y = greatest(0, least(7, p.y + dy)) AND q.x = greatest(0, least(7, p.x + dx))"
    else:
        on = "q.y = p.y + dy AND q.x = p.x + dx"
    return f"{name} AS (SELECT p.*, dy, dx, {q} FROM {src} p CROSS JOIN o JOIN {src} q ON q.run_id = p.run_id AND q.frame = p.frame AND {on}{where})"


@query("despeckle", f"""WITH {PX}, p8 AS (SELECT k, r AS pr, g AS pg, b AS pb FROM ({palette_sql('CGA-16')})), {lab_cte('p8', 'e', 'pr', 'pg', 'pb', 'k')}, {_CLASS}, {_off(3, False)}, {_near('c', 'n', 'k')},
v AS (SELECT {K}, any_value(k) AS own, q_k, count(*) AS n, min((dy + 1) * 3 + dx + 1) AS at_ FROM n GROUP BY {K}, q_k), w AS (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY n DESC, at_) AS o, bool_or(q_k = own) OVER (PARTITION BY {K}) AS has FROM v)
SELECT {K}, CASE WHEN NOT has AND sqrt(power(a1.L - a2.L, 2) + power(a1.A - a2.A, 2) + power(a1.B - a2.B, 2)) <= 60 THEN q_k ELSE own END AS k FROM w JOIN e a1 ON a1.k = own JOIN e a2 ON a2.k = q_k WHERE o = 1""")
def _(s, d):
    lab = P.as_array(P.in_lab(palette(s, "CGA-16").drop("palette")))
    return S.despeckle(_classes(s, d), "k", lab, H, W, 60.0)


@query("region_vote", f"""WITH {PX}, {_CLASS}, {_off(3)}, {_near('c', 'n', 'k, a')}, v AS (SELECT {K}, q_k, count(*) AS n FROM n WHERE q_a > 0.5 GROUP BY {K}, q_k), w AS (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY n DESC, q_k) AS o FROM v)
SELECT {K}, CASE WHEN c.a > 0.5 AND NOT greatest(r, g, b) < 100 AND w.n >= 4 THEN w.q_k ELSE c.k END AS k FROM c LEFT JOIN (SELECT * FROM w WHERE o = 1) w USING ({K})""")
def _(s, d):
    dark = F.greatest(*[F.col(c) for c in RGB]) < 100
    return S.region_vote(_classes(s, d), "k", F.col("a") > 0.5, dark, H, W, 4).select(*KEY, "k")


@query("neighbour_count", f"WITH {PX}, {_off(3, False)}, {_near('px', 'n', 'a', 'none')} SELECT {K}, CAST(sum(CASE WHEN q_a > 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS n FROM n GROUP BY {K}")
def _(s, d):
    return S.neighbour_count(px(s, d, alpha=True), F.col("a") > 0.5, H, W).select(*KEY, "n")


@query("dark_lines", f"WITH {PX}, {_off(3, False)}, {_near('px', 'n', 'r, g, b', 'none')} SELECT {K}, any_value(greatest(r, g, b)) < 140 AND sum(CASE WHEN greatest(q_r, q_g, q_b) < 140 THEN 1 ELSE 0 END) BETWEEN 2 AND 6 AS line FROM n GROUP BY {K}")
def _(s, d):
    return S.dark_lines(px(s, d), H, W, 140).select(*KEY, "line")


_CROSS = "o AS (SELECT * FROM (VALUES (0, 0), (0, -1), (-1, 0), (1, 0), (0, 1)) AS o(dy, dx))"
_MASK = "mk AS (SELECT run_id, frame, y, x, a > 0.5 AS f FROM px)"


@query("erode", f"WITH {PX}, {_MASK}, {_CROSS}, {_near('mk', 'n', 'f', 'none')} SELECT {K}, sum(CASE WHEN q_f THEN 1 ELSE 0 END) = 5 AS f FROM n GROUP BY {K}")
def _(s, d):
    return S.morph(px(s, d, alpha=True).select(*KEY, (F.col("a") > 0.5).alias("f")), "f", "erode", H, W).select(*KEY, "f")


@query("dilate", f"WITH {PX}, {_MASK}, {_off(3)}, {_near('mk', 'n', 'f', 'none')} SELECT {K}, bool_or(q_f) AS f FROM n GROUP BY {K}")
def _(s, d):
    return S.morph(px(s, d, alpha=True).select(*KEY, (F.col("a") > 0.5).alias("f")), "f", "dilate", H, W, S.square(3, False)).select(*KEY, "f")


@query("ring", f"WITH {PX}, {_MASK}, {_CROSS}, {_near('mk', 'n', 'f', 'none')} SELECT {K}, any_value(f) AND NOT sum(CASE WHEN q_f THEN 1 ELSE 0 END) = 5 AS ring FROM n GROUP BY {K}")
def _(s, d):
    return S.inner_ring(px(s, d, alpha=True).select(*KEY, (F.col("a") > 0.5).alias("f")), "f", H, W).select(*KEY, "ring")


@query("median3x3", f"WITH {PX}, {_off(3)}, {_near('px', 'n', 'r, g, b')} SELECT {K}, median(q_r) AS r, median(q_g) AS g, median(q_b) AS b FROM n GROUP BY {K}")
def _(s, d):
    return S.median3x3(px(s, d), RGB, H, W)


@query("median_side4", f"WITH {PX}, {_off(5)}, {_near('px', 'n', 'r, g, b')} SELECT {K}, median(q_r) AS r, median(q_g) AS g, median(q_b) AS b FROM n GROUP BY {K}")
def _(s, d):
    return S.median(px(s, d), RGB, 4, H, W)


@query("binomial_blur", f"WITH {PX}, {_off(3)}, {_near('px', 'n', 'r')} SELECT {K}, round(0.6 * any_value(r) + 0.4 * sum(q_r * (2 - abs(dy)) * (2 - abs(dx)) / CAST(16 AS DOUBLE)), 6) AS r FROM n GROUP BY {K}")
def _(s, d):
    return S.binomial_blur(px(s, d), ["r"], 0.4, H, W)


@query("shade_rescue", f"""WITH {PX}, c0 AS (SELECT {K}, a > 0.5 AS s, CASE WHEN r < 135 THEN 0 ELSE 1 + r // 86 END AS k, {hcl()} FROM px), c AS (SELECT *, s AND c < 40 AND l < 140 AS dk, NOT s OR l >= 140 AS op, s AND c >= 40 AND k <> 0 AND k <> 1 AS hu FROM c0), {_off(5)}, {_near('c', 'n', 'k, op, hu', 'none')},
op AS (SELECT {K}, bool_or(q_op) AS near FROM n WHERE abs(dy) <= 1 AND abs(dx) <= 1 GROUP BY {K}), v AS (SELECT {K}, q_k, count(*) AS n FROM n WHERE q_hu GROUP BY {K}, q_k), w AS (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY n DESC, q_k) AS o FROM v)
SELECT {K}, CASE WHEN dk AND NOT near AND k = 0 AND w.q_k IS NOT NULL THEN w.q_k ELSE k END AS k FROM c JOIN op USING ({K}) LEFT JOIN (SELECT * FROM w WHERE o = 1) w USING ({K})""")
def _(s, d):
    rows = px(s, d, alpha=True).withColumns({"s": F.col("a") > 0.5, "k": F.when(F.col("r") < 135, 0).otherwise(1 + F.floor(F.col("r") / 86).cast("int"))})
    return S.shade_rescue(rows, "k", "s", 0, 1, H, W, 40.0, 140.0)


def _comp(eight: bool, mask: str = "a > 0.5", name: str = "cc") -> str:
    far = "abs(q.y - p.y) <= 1 AND abs(q.x - p.x) <= 1" if eight else "abs(q.y - p.y) + abs(q.x - p.x) <= 1"
    return f"""{name}_m AS (SELECT run_id, frame, y, x FROM px WHERE {mask}), {name}_r AS (SELECT run_id, frame, y, x, y * 8 + x AS label FROM {name}_m UNION SELECT q.run_id, q.frame, q.y, q.x, p.label FROM {name}_r p JOIN {name}_m q ON q.run_id = p.run_id AND q.frame = p.frame AND {far} AND p.label < q.y * 8 + q.x),
{name} AS (SELECT {K}, min(label) AS label FROM {name}_r GROUP BY {K})"""


@query("components8", f"WITH RECURSIVE {PX}, {_comp(True)} SELECT {K}, label FROM cc")
def _(s, d):
    return G.components(px(s, d, alpha=True).withColumn("f", F.col("a") > 0.5), "f", H, W).select(*KEY, "label")


@query("components4", f"WITH RECURSIVE {PX}, {_comp(False)} SELECT {K}, label FROM cc")
def _(s, d):
    return G.components(px(s, d, alpha=True).withColumn("f", F.col("a") > 0.5), "f", H, W, False).select(*KEY, "label")


_EDGE = "(y = 0 OR y = 7 OR x = 0 OR x = 7)"


@query("border_flood", f"WITH RECURSIVE {PX}, {_comp(True)}, t AS (SELECT run_id, frame, label, bool_or({_EDGE}) AS bg FROM cc GROUP BY ALL) SELECT {K}, coalesce(bg, false) AS bg FROM px LEFT JOIN (cc JOIN t USING (run_id, frame, label)) USING ({K})")
def _(s, d):
    return G.border_flood(px(s, d, alpha=True).withColumn("f", F.col("a") > 0.5), "f", H, W).select(*KEY, "bg")


@query("interior_gaps", f"WITH RECURSIVE {PX}, {_comp(True, 'a <= 0.5')}, t AS (SELECT cc.run_id, cc.frame, label, bool_or({_EDGE}) AS e, count(*) AS n, avg(CASE WHEN g < 140 THEN 1 ELSE 0 END) AS sh FROM cc JOIN px USING ({K}) GROUP BY ALL) SELECT {K}, coalesce(NOT e AND n <= 6 AND sh >= 0.6, false) AS gap FROM px LEFT JOIN (cc JOIN t USING (run_id, frame, label)) USING ({K})")
def _(s, d):
    rows = px(s, d, alpha=True).withColumns({"f": F.col("a") <= 0.5, "t": F.col("g") < 140})
    return G.interior_gaps(rows, "f", "t", 6, H, W).select(*KEY, "gap")


_SIZES = "sz AS (SELECT run_id, frame, label, count(*) AS n FROM cc GROUP BY ALL), rk AS (SELECT *, row_number() OVER (PARTITION BY run_id, frame ORDER BY n DESC, label) AS o FROM sz)"


@query("largest_island", f"WITH RECURSIVE {PX}, {_comp(False)}, {_SIZES} SELECT {K}, coalesce(o = 1, false) AS kept FROM px LEFT JOIN (cc JOIN rk USING (run_id, frame, label)) USING ({K})")
def _(s, d):
    return G.largest_island(px(s, d, alpha=True).withColumn("f", F.col("a") > 0.5), "f", H, W).select(*KEY, "kept")


@query("drop_small", f"WITH RECURSIVE {PX}, {_comp(False)}, {_SIZES} SELECT {K}, coalesce(n >= 3, false) AS kept FROM px LEFT JOIN (cc JOIN rk USING (run_id, frame, label)) USING ({K})")
def _(s, d):
    return G.drop_small(px(s, d, alpha=True).withColumn("f", F.col("a") > 0.5), "f", 3, H, W).select(*KEY, "kept")


@query("drop_detached", f"""WITH RECURSIVE {PX}, {_comp(True, 'r > 150')}, {_SIZES}, mn AS (SELECT run_id, frame, label AS ml, n AS mn FROM rk WHERE o = 1), j AS (SELECT cc.*, ml, mn, sz.n, sz.n >= mn * 0.5 AS big FROM cc JOIN sz USING (run_id, frame, label) JOIN mn USING (run_id, frame)),
near AS (SELECT DISTINCT p.run_id, p.frame, p.label FROM j p JOIN j q ON p.run_id = q.run_id AND p.frame = q.frame AND q.label = q.ml AND abs(p.y - q.y) <= 2 AND abs(p.x - q.x) <= 2 WHERE NOT p.big),
col AS (SELECT run_id, frame, label, any_value(mn) AS mn, median(r) AS mr, median(g) AS mg, median(b) AS mb FROM near JOIN j USING (run_id, frame, label) JOIN px USING ({K}) GROUP BY ALL), {lab_cte('col', 'cl', 'mr', 'mg', 'mb')},
body AS (SELECT {K}, r AS br, g AS bg, b AS bb FROM j JOIN px USING ({K}) WHERE label = ml), {lab_cte('body', 'bl', 'br', 'bg', 'bb')},
al AS (SELECT cl.run_id, cl.frame, cl.label, any_value(cl.mn) AS mn, sum(CASE WHEN sqrt(power(cl.L - bl.L, 2) + power(cl.A - bl.A, 2) + power(cl.B - bl.B, 2)) < 18 THEN 1 ELSE 0 END) AS n FROM cl JOIN bl USING (run_id, frame) GROUP BY cl.run_id, cl.frame, cl.label),
kp AS (SELECT run_id, frame, label FROM j WHERE big UNION SELECT run_id, frame, label FROM al WHERE n >= greatest(1, floor(mn * CAST(0.001 AS DOUBLE))))
SELECT {K}, label IS NOT NULL AS kept FROM px LEFT JOIN (cc JOIN kp USING (run_id, frame, label)) USING ({K})""")
def _(s, d):
    return G.drop_detached(px(s, d).withColumn("f", F.col("r") > 150), "f", 50.0, H, W, least=1).select(*KEY, "kept")


@query("fill_holes", f"WITH RECURSIVE {PX}, {_comp(False, 'a <= 0.5')}, t AS (SELECT run_id, frame, label, bool_or({_EDGE}) AS e FROM cc GROUP BY ALL) SELECT {K}, a > 0.5 OR NOT coalesce(e, false) AS f FROM px LEFT JOIN (cc JOIN t USING (run_id, frame, label)) USING ({K})")
def _(s, d):
    return G.fill_holes(px(s, d, alpha=True).withColumn("f", F.col("a") > 0.5), "f", H, W).select(*KEY, "f")


def _steps() -> str:
    """CTEs s0 to s4: a mask grown by two crosses and shrunk by two."""
    out = ["s0 AS (SELECT run_id, frame, y, x, r > 150 AS f FROM px0)", _CROSS]
    for i, hit in enumerate(["bool_or(q_f)"] * 2 + ["sum(CASE WHEN q_f THEN 1 ELSE 0 END) = 5"] * 2):
        out += [_near(f"s{i}", f"n{i}", "f", "none"), f"s{i + 1} AS (SELECT {K}, {hit} AS f FROM n{i} GROUP BY {K})"]
    return ", ".join(out)


@query("close_holes", f"WITH RECURSIVE px0 AS (WITH {PX} SELECT * FROM px), {_steps()}, px AS (SELECT * FROM s4), {_comp(False, 'NOT f')}, t AS (SELECT run_id, frame, label, bool_or({_EDGE}) AS e FROM cc GROUP BY ALL) SELECT {K}, f OR NOT coalesce(e, false) AS f FROM px LEFT JOIN (cc JOIN t USING (run_id, frame, label)) USING ({K})")
def _(s, d):
    return R.close_holes(px(s, d).withColumn("f", F.col("r") > 150), "f", H, W)


@query("auto_subject", f"""WITH RECURSIVE px0 AS (WITH {PX} SELECT * FROM px), rg AS (SELECT * FROM px0 WHERE y < 1 UNION ALL SELECT * FROM px0 WHERE y >= 7 UNION ALL SELECT * FROM px0 WHERE x < 1 UNION ALL SELECT * FROM px0 WHERE x >= 7), ky AS (SELECT run_id, frame, median(r) AS kr, median(g) AS kg, median(b) AS kb FROM rg GROUP BY 1, 2),
px AS (SELECT px0.*, {redmean2(('r', 'g', 'b'), ('kr', 'kg', 'kb'))} < 8100 AS mt FROM px0 JOIN ky USING (run_id, frame)), {_comp(False, 'mt')}, t AS (SELECT run_id, frame, label, bool_or({_EDGE}) AS bg FROM cc GROUP BY ALL), z AS (SELECT {K}, coalesce(bg, false) AS bg FROM px LEFT JOIN (cc JOIN t USING (run_id, frame, label)) USING ({K})),
sh AS (SELECT run_id, frame, avg(CASE WHEN bg THEN 0 ELSE 1 END) AS sh FROM z GROUP BY 1, 2) SELECT {K}, CASE WHEN sh < 0.02 THEN true ELSE NOT bg END AS subject FROM z JOIN sh USING (run_id, frame)""")
def _(s, d):
    return G.auto_subject(px(s, d), H, W, 90.0).select(*KEY, "subject")


@query("hue_families", f"""WITH RECURSIVE p AS (SELECT palette, k, {hcl()} FROM ({palette_sql()})), c AS (SELECT palette, k, h FROM p WHERE c >= 25), r AS (SELECT palette, k, h, k AS family FROM c UNION SELECT b.palette, b.k, b.h, a.family FROM r a JOIN c b ON a.palette = b.palette AND least(abs(a.h - b.h), 360 - abs(a.h - b.h)) <= 35)
SELECT palette, k, min(family) AS family FROM r GROUP BY ALL""")
def _(s, d):
    return G.hue_families(palette(s))
