"""Queries on keying, mattes and grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelake.operators import grid as G
from framelake.operators import matte as M
from framelake.plans.base import query
from framelake.plans.sqltext import LUM, PX, lab_cte
from framelake.sources.palettes import palette, palette_sql
from framelake.sources.tables import px

K = "run_id, frame, y, x"
KEY = ["run_id", "frame", "y", "x"]
RGB = ["r", "g", "b"]

RING = "ring AS (SELECT * FROM px WHERE y < 2 UNION ALL SELECT * FROM px WHERE y >= 6 UNION ALL SELECT * FROM px WHERE x < 2 UNION ALL SELECT * FROM px WHERE x >= 6)"


@query("border_keys", f"""WITH RECURSIVE {PX}, {RING}, h AS (SELECT run_id, r // 64 AS qr, g // 64 AS qg, b // 64 AS qb, count(*) AS n, median(r) AS mr, median(g) AS mg, median(b) AS mb FROM ring GROUP BY ALL),
t AS (SELECT *, sum(n) OVER (PARTITION BY run_id) AS tot FROM h), o AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY n DESC, qr, qg, qb) AS i FROM t WHERE n >= CAST(0.08 AS DOUBLE) * tot),
f AS (SELECT run_id, i, [{{'r': mr, 'g': mg, 'b': mb, 'n': n}}] AS kept FROM o WHERE i = 1 UNION ALL SELECT f.run_id, o.i, CASE WHEN len(kept) >= 3 OR list_min(list_transform(kept, lambda k: sqrt(power(k.r - o.mr, 2) + power(k.g - o.mg, 2) + power(k.b - o.mb, 2)))) < 32 THEN kept ELSE list_append(kept, {{'r': o.mr, 'g': o.mg, 'b': o.mb, 'n': o.n}}) END FROM f JOIN o ON o.run_id = f.run_id AND o.i = f.i + 1),
l AS (SELECT run_id, max(i) AS i FROM f GROUP BY 1), u AS (SELECT run_id, unnest(kept) AS k, generate_subscripts(kept, 1) - 1 AS rank FROM f JOIN l USING (run_id, i))
SELECT run_id, rank, k.r AS r, k.g AS g, k.b AS b, k.n AS n FROM u""")
def _(s, d):
    # the frames are noise, so steps of 64 stand in for those of 16: colours are quartered for the buckets
    coarse = px(s, d)
    return M.border_keys(coarse.withColumns({c: F.col(c) / 4 for c in RGB}), 8, 8, apart=8.0).withColumns({c: F.col(c) * 4 for c in RGB})


@query("corner_key", f"WITH {PX} SELECT run_id, median(r) AS r, median(g) AS g, median(b) AS b FROM px WHERE (y < 2 OR y >= 6) AND (x < 2 OR x >= 6) GROUP BY 1")
def _(s, d):
    return M.corner_key(px(s, d), 8, 8)


def _cand(key: tuple[int, int, int], tol: float, shadow: float, name: str) -> str:
    """CTEs ``name``: px with ``cand`` for one key."""
    up, down = 25 + 40 * tol, (10 + 160 * tol) * shadow
    kc = "sqrt(kA * kA + kB * kB)"
    dl = "(L - kL)"
    gap = "abs((degrees(atan2(B, A)) - degrees(atan2(kB, kA)) + 180) - 360 * floor((degrees(atan2(B, A)) - degrees(atan2(kB, kA)) + 180) / 360) - 180)"
    sat = f"{gap} < {12 + 48 * tol} * (1 + least(greatest(-{dl} / 40, 0), 1)) AND {dl} < {up} AND {dl} > -{down} AND sqrt(A * A + B * B) >= greatest(12, 0.2 * {kc})"
    neu = f"power(A - kA, 2) + power(B - kB, 2) < {(12 + 120 * tol) ** 2} AND {dl} < {up} AND {dl} > -{down}"
    return f"""{name}_k0 AS (SELECT {key[0]} AS kr, {key[1]} AS kg, {key[2]} AS kb), {lab_cte(f'{name}_k0', f'{name}_k', 'kr', 'kg', 'kb')}, {name}_kk AS (SELECT L AS kL, A AS kA, B AS kB FROM {name}_k),
{name}_p AS (SELECT {K}, r AS cr, g AS cg, b AS cb FROM px), {lab_cte(f'{name}_p', f'{name}_q', 'cr', 'cg', 'cb')},
{name} AS (SELECT {K}, CASE WHEN {kc} >= 25 THEN {sat} ELSE {neu} END AS cand FROM {name}_q CROSS JOIN {name}_kk)"""


@query("key_candidates", f"WITH {PX}, {_cand((40, 200, 60), 0.35, 1.0, 'c')} SELECT {K}, cand AS candidate FROM c")
def _(s, d):
    return M.key_candidates(px(s, d), [(40, 200, 60)], 0.35, 1.0).select(*KEY, "candidate")


@query("key_union", f"WITH {PX}, {_cand((40, 200, 60), 0.2, 0.6, 'c')}, {_cand((128, 128, 128), 0.2, 0.6, 'e')} SELECT {K}, c.cand OR e.cand AS candidate FROM c JOIN e USING ({K})")
def _(s, d):
    return M.key_candidates(px(s, d), [(40, 200, 60), (128, 128, 128)], 0.2, 0.6).select(*KEY, "candidate")


@query("soft_key", f"WITH {PX} SELECT {K}, round(least(greatest((sqrt(power(r - 120, 2) + power(g - 130, 2) + power(b - 110, 2)) / 255 - 0.1) / 0.25, 0), 1), 6) AS a FROM px")
def _(s, d):
    return M.soft_key(px(s, d), (120, 130, 110), 0.1, 0.25).select(*KEY, "a")


@query("despill", f"WITH {PX} SELECT {K}, r, CASE WHEN a > 0.5 THEN least(g, greatest(r, b)) ELSE g END AS g, b FROM px")
def _(s, d):
    return M.despill(px(s, d, alpha=True), "g", F.col("a") > 0.5).select(*KEY, *RGB)


@query("green_sweep", f"WITH {PX}, k AS (SELECT max(CASE WHEN g > r + 25 AND g > b + 25 THEN 1 ELSE 0 END) AS known FROM ({palette_sql('1-BIT')})) SELECT {K}, CASE WHEN a > 0.5 AND g > r + 25 AND g > b + 25 AND known = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(a AS DOUBLE) END AS a FROM px CROSS JOIN k")
def _(s, d):
    return M.green_sweep(px(s, d, alpha=True), palette(s, "1-BIT")).select(*KEY, "a")


@query("fringe_snap", f"WITH {PX} SELECT {K}, r, CASE WHEN a > 0.5 AND greatest(r, g, b) < 90 AND g > r + 12 AND g > b + 12 THEN least(g, (r + b) // 2 + 6) ELSE g END AS g, b FROM px")
def _(s, d):
    return M.fringe_snap(px(s, d, alpha=True)).select(*KEY, *RGB)


@query("content_mask", f"WITH {PX}, k AS (SELECT run_id, frame, median(r) AS kr, median(g) AS kg, median(b) AS kb FROM px WHERE (y < 2 OR y >= 6) AND (x < 2 OR x >= 6) GROUP BY 1, 2) SELECT {K}, greatest(abs(r - kr), abs(g - kg), abs(b - kb)) > 24 AS content FROM px JOIN k USING (run_id, frame)")
def _(s, d):
    return M.content_mask(px(s, d), 8, 8).select(*KEY, "content")


@query("matte_intersection", f"WITH {PX} SELECT p.run_id, p.frame, p.y, p.x, CAST(least(p.a, q.a) AS DOUBLE) AS a FROM px p JOIN px q ON p.run_id = q.run_id AND p.frame = q.frame AND p.y = q.y AND p.x = 7 - q.x")
def _(s, d):
    a = px(s, d, alpha=True)
    return M.least_matte(a, a.withColumn("x", 7 - F.col("x")), KEY).select(*KEY, "a")


@query("block_nearest", f"WITH {PX} SELECT run_id, frame, y // 3 AS y, x // 3 AS x, r, g, b FROM px WHERE y < 6 AND x < 6 AND y % 3 = 1 AND x % 3 = 1")
def _(s, d):
    return G.block_nearest(px(s, d), 3, 8, 8)


def _trim(cells: str, widths: tuple[float, ...], alpha: str = "") -> str:
    by = "run_id, frame, cy, cx"
    ctes = [cells, f"m AS (SELECT *, median(r) OVER w AS mr, median(g) OVER w AS mg, median(b) OVER w AS mb FROM cells WINDOW w AS (PARTITION BY {by}))"]
    last, c = "m", ("mr", "mg", "mb")
    for i, wd in enumerate(widths):
        near = f"greatest(abs(r - {c[0]}), abs(g - {c[1]}), abs(b - {c[2]})) <= {wd}"
        new = ", ".join(f"coalesce(avg(CASE WHEN {near} THEN {ch} END) OVER w, m{ch}) AS t{i}{ch}" for ch in RGB)
        ctes.append(f"t{i} AS (SELECT *, {new} FROM {last} WINDOW w AS (PARTITION BY {by}))")
        last, c = f"t{i}", tuple(f"t{i}{ch}" for ch in RGB)
    out = ", ".join(f"CAST(round_even(any_value({x}), 0) AS BIGINT) AS {ch}" for x, ch in zip(c, RGB, strict=True))
    return f"WITH {PX}, {', '.join(ctes)} SELECT {by}, {out}{alpha} FROM {last} GROUP BY ALL"


@query("block_trimmed_mean", _trim("cells AS (SELECT *, y // 4 AS cy, x // 4 AS cx FROM px)", (8.0,)))
def _(s, d):
    return G.block_trimmed_mean(px(s, d), 4, 8, 8)


@query("block_majority", _trim("cells AS (SELECT *, y // 4 AS cy, x // 4 AS cx FROM px)", (12.0, 8.0)))
def _(s, d):
    return G.block_trimmed_mean(px(s, d), 4, 8, 8, (12.0, 8.0))


@query("block_masked", _trim("c0 AS (SELECT *, y // 4 AS cy, x // 4 AS cx FROM px), c1 AS (SELECT *, sum(CASE WHEN a > 0.5 THEN 1 ELSE 0 END) OVER (PARTITION BY run_id, frame, cy, cx) AS solid, avg(a) OVER (PARTITION BY run_id, frame, cy, cx) AS am FROM c0), cells AS (SELECT * FROM c1 WHERE solid = 0 OR a > 0.5)", (8.0,), ", CAST(any_value(am) > 0.5 AS BIGINT) AS a"))
def _(s, d):
    return G.block_masked(px(s, d, alpha=True), 4, 8, 8)


@query("frac_cells", _trim("c0 AS (SELECT *, CAST(floor((y + 0.5 - CAST(0.25 AS DOUBLE)) / CAST(2.5 AS DOUBLE)) AS BIGINT) AS cy, CAST(floor((x + 0.5 - CAST(0.5 AS DOUBLE)) / CAST(2.75 AS DOUBLE)) AS BIGINT) AS cx FROM px), c1 AS (SELECT *, sum(CASE WHEN a > 0.5 THEN 1 ELSE 0 END) OVER (PARTITION BY run_id, frame, cy, cx) AS solid, count(*) OVER (PARTITION BY run_id, frame, cy, cx) AS sz FROM c0), cells AS (SELECT * FROM c1 WHERE solid = 0 OR a > 0.5)", (8.0,), ", CAST(any_value(solid) / CAST(any_value(sz) AS DOUBLE) > 0.5 AS BIGINT) AS a"))
def _(s, d):
    return G.frac_reduce(px(s, d, alpha=True), 2.75, 2.5, 0.5, 0.25)


@query("block_modal", f"WITH {PX}, n AS (SELECT run_id, frame, y // 4 AS cy, x // 4 AS cx, r // 64 AS r, g // 64 AS g, b // 64 AS b, count(*) AS n FROM px GROUP BY ALL), w AS (SELECT *, row_number() OVER (PARTITION BY run_id, frame, cy, cx ORDER BY n DESC, r, g, b) AS o FROM n) SELECT run_id, frame, cy, cx, r, g, b, n FROM w WHERE o = 1")
def _(s, d):
    return G.block_modal(px(s, d).withColumns({c: F.floor(F.col(c) / 64) for c in RGB}), 4, 8, 8)


_SCORE = f"WITH {PX}, l AS (SELECT run_id, frame, y, x, {LUM} AS v FROM px), cand AS (SELECT s, ox, oy FROM (SELECT unnest([1, 2]) AS s), (SELECT unnest(range(2)) AS ox), (SELECT unnest(range(2)) AS oy) WHERE ox < s AND oy < s AND (8 - oy) // s >= 3 AND (8 - ox) // s >= 3), c AS (SELECT run_id, frame, s, ox, oy, var_pop(v) AS wi, avg(v) AS m FROM l CROSS JOIN cand WHERE y >= oy AND x >= ox AND y - oy < s * ((8 - oy) // s) AND x - ox < s * ((8 - ox) // s) GROUP BY run_id, frame, s, ox, oy, (y - oy) // s, (x - ox) // s), t AS (SELECT run_id, frame, s, ox, oy, avg(wi) AS wi, var_pop(m) AS be FROM c GROUP BY ALL), z AS (SELECT run_id, frame, s, ox, oy, be / (wi + be + 1e-6) AS score FROM t)"


@query("block_score", f"{_SCORE} SELECT CAST(run_id AS BIGINT) AS run_id, frame, CAST(s AS BIGINT) AS s, ox, oy, round(score, 6) AS score FROM z")
def _(s, d):
    return G.block_scores(px(s, d), [1, 2], 8, 8, 3)


@query("detect_block", f"{_SCORE}, y AS (SELECT *, max(score) OVER (PARTITION BY run_id, frame) AS best FROM z WHERE s > 1), w AS (SELECT *, row_number() OVER (PARTITION BY run_id, frame ORDER BY s, score DESC, ox, oy) AS o FROM y WHERE best >= 0.2 AND score >= 0.9 * best) SELECT run_id, frame, CAST(s AS BIGINT) AS s, ox, oy, round(score, 6) AS score FROM w WHERE o = 1")
def _(s, d):
    return G.choose_block(G.block_scores(px(s, d), [2], 8, 8, 3), 0.2)


PROFILE = f"l AS (SELECT run_id, frame, y, x, {LUM} AS v FROM px), e AS (SELECT run_id, frame, x, abs(lead(v) OVER (PARTITION BY run_id, frame, y ORDER BY x) - v) AS d FROM l), pf AS (SELECT run_id, frame, x AS pos, sum(d) AS v FROM e WHERE d IS NOT NULL GROUP BY ALL)"
SERIESV = "s0 AS (SELECT user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, value AS v FROM events)"


@query("edge_profile", f"WITH {PX}, {PROFILE} SELECT run_id, frame, pos, round(v, 6) AS v FROM pf")
def _(s, d):
    return G.edge_profile(px(s, d))


def _series(s, d):
    from framelake.sources.tables import series

    return series(s, d).select("key", "pos", F.col("value").alias("v"))


@query("autocorr_lags", f"""WITH {SERIESV}, m AS (SELECT key, pos, v - avg(v) OVER (PARTITION BY key) AS v FROM s0), p AS (SELECT key, sum(v * v) AS p FROM m GROUP BY 1),
c AS (SELECT a.key, b.pos - a.pos AS lag, sum(a.v * b.v) AS c FROM m a JOIN m b ON a.key = b.key AND b.pos - a.pos BETWEEN 0 AND 21 GROUP BY ALL), r AS (SELECT key, lag, c / p AS corr FROM c JOIN p USING (key)),
n AS (SELECT *, lag(corr) OVER w AS lo, lead(corr) OVER w AS hi FROM r WINDOW w AS (PARTITION BY key ORDER BY lag)), k AS (SELECT * FROM n WHERE lag BETWEEN 2 AND 20 AND corr > 0.05 AND corr >= lo AND corr >= hi), o AS (SELECT key, lag, corr, row_number() OVER (PARTITION BY key ORDER BY round(corr, 9) DESC, lag) AS rank FROM k)
SELECT key, lag, round(corr, 6) AS corr, rank FROM o WHERE rank <= 3""")
def _(s, d):
    return G.autocorrelation(_series(s, d), ["key"], 20)


_PEAKS = f"WITH {SERIESV}, q AS (SELECT *, quantile_cont(v, 0.88) OVER (PARTITION BY key) AS t, count(*) OVER (PARTITION BY key) AS n, lag(v) OVER (PARTITION BY key ORDER BY pos) AS lo, lead(v) OVER (PARTITION BY key ORDER BY pos) AS hi FROM s0), pk AS (SELECT key, pos + 1 + CASE WHEN lo - 2 * v + hi > 1e-9 THEN least(greatest(0.5 * (lo - hi) / (lo - 2 * v + hi), -0.5), 0.5) ELSE CAST(0 AS DOUBLE) END AS pl, v AS energy FROM q WHERE n >= 8 AND lo IS NOT NULL AND hi IS NOT NULL AND v >= t AND v >= lo AND v >= hi)"


@query("edge_peaks", f"{_PEAKS} SELECT key, round(pl, 6) AS place, round(energy, 6) AS energy FROM pk")
def _(s, d):
    return G.edge_peaks(_series(s, d), ["key"]).withColumnRenamed("at", "place")


@query("lattice_recall", f"{_PEAKS}, g AS (SELECT key, i, i * (CAST(4.5 AS DOUBLE) / 160) AS o, pl, energy FROM pk CROSS JOIN (SELECT unnest(range(160)) AS i)), r AS (SELECT key, i, o, sum(CASE WHEN abs(pl - (o + round_even((pl - o) / CAST(4.5 AS DOUBLE), 0) * 4.5)) <= 1.2 THEN energy ELSE 0 END) / sum(energy) AS r FROM g GROUP BY ALL), w AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY round(r, 9) DESC, i) AS n FROM r) SELECT key, round(r, 6) AS recall, round(o, 6) AS phase FROM w WHERE n = 1")
def _(s, d):
    return G.lattice_recall(G.edge_peaks(_series(s, d), ["key"]), ["key"], 4.5)


@query("within_cell_std", f"WITH {PX}, l AS (SELECT run_id, frame, CAST(floor((y + 0.5) / CAST(2.5 AS DOUBLE)) AS INT) AS cy, CAST(floor((x + 0.5) / CAST(2.5 AS DOUBLE)) AS INT) AS cx, {LUM} AS v FROM px), c AS (SELECT run_id, frame, count(*) AS w, sum(v) AS wv, sum(v * v) AS wvv FROM l GROUP BY run_id, frame, cy, cx) SELECT run_id, frame, round(sqrt(sum(greatest(wvv - wv * wv / w, 0)) / sum(w)), 6) AS std FROM c GROUP BY ALL")
def _(s, d):
    return G.within_cell_std(px(s, d), 2.5)
