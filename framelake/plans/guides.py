"""Queries on clamped joins, references, rings, pitches, prompts of stills and edits, payloads, and functions of SQL text."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelake.functions import sqlfuncs
from framelake.operators import grid as G
from framelake.operators import layout as L
from framelake.operators import palette as P
from framelake.operators import raster as R
from framelake.operators import texts as X
from framelake.plans.base import query
from framelake.plans.mattes import _PEAKS, _series
from framelake.plans.sqltext import LUM, PX, pal, redmean2
from framelake.sources.palettes import palette
from framelake.sources.tables import px, table

K = "run_id, frame, y, x"
KEY = ["run_id", "frame", "y", "x"]
RGB = ["r", "g", "b"]
H = W = 8


@query("clamped_masks", f"WITH {PX}, m AS (SELECT run_id, frame, y, x, a FROM px WHERE frame <= run_id % 5 AND y < 4 AND x < 4), n AS (SELECT run_id, max(frame) AS top FROM m GROUP BY 1) SELECT p.run_id, p.frame, p.y, p.x, p.r, m.a FROM px p JOIN n USING (run_id) JOIN m ON m.run_id = p.run_id AND m.frame = least(p.frame, top) AND m.y = p.y // 2 AND m.x = p.x // 2")
def _(s, d):
    masks = px(s, d, alpha=True).where("frame <= run_id % 5 AND y < 4 AND x < 4").select(*KEY, "a")
    return L.clamped_masks(px(s, d).select(*KEY, "r"), masks, H, W, 4, 4)


@query("clamped_durations", f"WITH {PX}, f AS (SELECT DISTINCT run_id, frame FROM px) SELECT run_id, frame, CAST(greatest(1, round_even(1000 * (least(frame, run_id % 7) % 4 + 1) / CAST(12 AS DOUBLE), 0)) AS BIGINT) AS ms FROM f")
def _(s, d):
    frames = px(s, d).select("run_id", "frame").distinct()
    held = F.transform(F.sequence(F.lit(0), F.col("run_id") % 7), lambda i: i % 4 + 1)
    return frames.select("run_id", "frame", X.clamped_duration_ms(held, F.col("frame"), 12).alias("ms"))


@query("ring_class", f"WITH {PX}, t AS (SELECT {K}, r % 6 AS k, a > 0.5 AS s FROM px), g AS (SELECT {K} FROM t p WHERE NOT s AND EXISTS (SELECT 1 FROM t q WHERE q.run_id = p.run_id AND q.frame = p.frame AND q.s AND abs(q.y - p.y) + abs(q.x - p.x) = 1)), w AS (SELECT g.*, q.k, row_number() OVER (PARTITION BY g.run_id, g.frame, g.y, g.x ORDER BY power(q.y - g.y, 2) + power(q.x - g.x, 2), q.y, q.x) AS o FROM g JOIN t q ON q.run_id = g.run_id AND q.frame = g.frame WHERE q.s) SELECT {K}, k FROM w WHERE o = 1")
def _(s, d):
    return R.ring_class(px(s, d, alpha=True).withColumn("k", F.col("r") % 6), H, W)


@query("character_scale", f"WITH {PX}, f AS (SELECT run_id, frame, count(*) FILTER (a > 0.5 AND r > 120) AS n, max(CASE WHEN a > 0.5 AND r > 120 THEN y END) - min(CASE WHEN a > 0.5 AND r > 120 THEN y END) + 1 AS h FROM px GROUP BY 1, 2) SELECT run_id, CAST(greatest(3, least(24, round_even(median(CASE WHEN n >= 30 THEN h * 8 / CAST(11 AS DOUBLE) END), 0))) AS BIGINT) AS block FROM f GROUP BY 1 HAVING max(n) >= 30")
def _(s, d):
    rows = px(s, d, alpha=True).withColumn("a", F.when(F.col("r") > 120, F.col("a")).otherwise(0.0))
    return L.character_scale(rows, 11 / 8, 30).where("block IS NOT NULL")


_FIT = "SELECT run_id, frame, coalesce(min(CASE WHEN a > 0 THEN x END), 0) AS x0, coalesce(min(CASE WHEN a > 0 THEN y END), 0) AS y0, coalesce(max(CASE WHEN a > 0 THEN x END) + 1, 8) AS x1, coalesce(max(CASE WHEN a > 0 THEN y END) + 1, 8) AS y1 FROM sp GROUP BY 1, 2"


def _fit_sql(h: int, w: int, dx: int, dy: int, thin: str) -> str:
    return f"""WITH {PX}, sp AS (SELECT {K}, r, g, b, CASE WHEN {thin} THEN a ELSE 0 END AS a FROM px), bx AS ({_FIT}), sc AS (SELECT *, x1 - x0 AS bw, y1 - y0 AS bh, least({w} // (x1 - x0), {h} // (y1 - y0)) AS k FROM bx), sd AS (SELECT *, CASE WHEN k >= 1 THEN CAST(k AS DOUBLE) ELSE least({w} / CAST(bw AS DOUBLE), {h} / CAST(bh AS DOUBLE)) END AS s FROM sc),
nn AS (SELECT *, CAST(greatest(1, round_even(bw * s, 0)) AS BIGINT) AS nw, CAST(greatest(1, round_even(bh * s, 0)) AS BIGINT) AS nh FROM sd), oo AS (SELECT *, CAST(floor(({w} - nw) / CAST(2 AS DOUBLE)) + round_even({dx} * s, 0) AS BIGINT) AS ox, CAST(floor(({h} - nh) / CAST(2 AS DOUBLE)) + round_even({dy} * s, 0) AS BIGINT) AS oy FROM nn),
c AS (SELECT oo.*, cy.t AS y, cx.t AS x FROM oo CROSS JOIN (SELECT unnest(range({h})) AS t) cy CROSS JOIN (SELECT unnest(range({w})) AS t) cx)
SELECT c.run_id, c.frame, c.y, c.x, CASE WHEN a = 1 THEN r ELSE 0 END AS r, CASE WHEN a = 1 THEN g ELSE 255 END AS g, CASE WHEN a = 1 THEN b ELSE 0 END AS b FROM c LEFT JOIN sp p ON p.run_id = c.run_id AND p.frame = c.frame AND c.x >= ox AND c.x < ox + nw AND c.y >= oy AND c.y < oy + nh
AND p.x = x0 + CAST(floor((c.x - ox + 0.5) * bw / CAST(nw AS DOUBLE)) AS BIGINT) AND p.y = y0 + CAST(floor((c.y - oy + 0.5) * bh / CAST(nh AS DOUBLE)) AS BIGINT)"""


def _sparse(s, d):
    return px(s, d, alpha=True).withColumn("a", F.when(F.col("r") > 165, F.col("a")).otherwise(0.0))


@query("fit_reference", _fit_sql(17, 20, 1, -1, "r > 165"))
def _(s, d):
    return L.fit_reference(_sparse(s, d), H, W, 17, 20, (0, 255, 0), 1, -1)


@query("shrink_reference", _fit_sql(5, 4, 1, 0, "r > 100"))
def _(s, d):
    rows = px(s, d, alpha=True).withColumn("a", F.when(F.col("r") > 100, F.col("a")).otherwise(0.0))
    return L.fit_reference(rows, H, W, 5, 4, (0, 255, 0), 1, 0)


@query("extreme_support", f"""WITH {PX}, {pal('GAMEBOY')}, cl AS (SELECT run_id, frame, y // 4 AS cy, x // 4 AS cx, r, g, b FROM px WHERE y % 4 = 2 AND x % 4 = 2), pl AS (SELECT *, CAST(0.299 AS DOUBLE) * pr + CAST(0.587 AS DOUBLE) * pg + CAST(0.114 AS DOUBLE) * pb AS pl FROM pal), tp AS (SELECT max(pl) AS top FROM pl),
n AS (SELECT {K}, k, row_number() OVER (PARTITION BY {K} ORDER BY {redmean2(('r', 'g', 'b'), ('pr', 'pg', 'pb'))}, k) AS o FROM px CROSS JOIN pal WHERE a > 0.5), c AS (SELECT run_id, frame, y // 4 AS cy, x // 4 AS cx, k, count(*) AS n FROM n WHERE o = 1 GROUP BY ALL), t AS (SELECT run_id, frame, cy, cx, sum(n) AS total FROM c GROUP BY ALL),
b AS (SELECT c.run_id, c.frame, cy, cx, k, n FROM c JOIN pl USING (k), tp WHERE pl >= top - 12 QUALIFY row_number() OVER (PARTITION BY c.run_id, c.frame, cy, cx ORDER BY n DESC, k) = 1)
SELECT run_id, frame, cy, cx, r, g, b, coalesce(CASE WHEN n >= greatest(3, 0.1 * total) AND {LUM} <= top - 40 THEN k END, -1) AS k FROM cl LEFT JOIN t USING (run_id, frame, cy, cx) LEFT JOIN b USING (run_id, frame, cy, cx), tp""")
def _(s, d):
    cells = G.block_nearest(px(s, d), 4, H, W).withColumnsRenamed({"y": "cy", "x": "cx"})
    rows = G.extreme_support(px(s, d, alpha=True), cells, palette(s, "GAMEBOY").drop("palette"), 4, H, W)
    return rows.withColumn("k", F.coalesce("k", F.lit(-1)))


_PITCHES = (2.5, 3.25, 4.5, 5.125, 9.0)


@query("pitch_choice", f"{_PEAKS}, g AS (SELECT key, p, i, i * (p / 160) AS o, pl, energy FROM pk CROSS JOIN (SELECT unnest(range(160)) AS i) CROSS JOIN (SELECT CAST(unnest([{', '.join(map(str, _PITCHES))}]) AS DOUBLE) AS p)), r AS (SELECT key, p, i, sum(CASE WHEN abs(pl - (o + round_even((pl - o) / p, 0) * p)) <= 1.2 THEN energy ELSE 0 END) / sum(energy) AS r FROM g GROUP BY ALL), m AS (SELECT key, p, max(round(r, 9)) AS r FROM r GROUP BY ALL), e AS (SELECT *, r - least(1, 2.4 / p) AS e FROM m WHERE r > 0), w AS (SELECT *, max(e) OVER (PARTITION BY key) AS b FROM e) SELECT key, p AS pitch, round(r, 6) AS recall, round(e, 6) AS excess FROM w WHERE e >= CAST(0.98 AS DOUBLE) * b QUALIFY row_number() OVER (PARTITION BY key ORDER BY p DESC) = 1")
def _(s, d):
    scores = G.pitch_scan(G.edge_peaks(_series(s, d), ["key"]), ["key"], list(_PITCHES))
    return G.choose_pitch(scores, ["key"])


def _axis(name: str, move: str, start: str, pitch: str, phase: str, fixed_pitch: str, fixed_phase: str, reach: int) -> str:
    """CTE ``name``: the start's columns and p, o of the least deviation, the moving axis over the candidates."""
    still = "y" if move == "x" else "x"
    near = f"s{name} AS (SELECT st.*, i, j, greatest(25e-1, {pitch} - 6e-2) + i * 3e-2 AS p, {phase} - 125e-2 + j * 25e-2 AS o FROM {start} st CROSS JOIN (SELECT unnest(range(5)) AS i) CROSS JOIN (SELECT unnest(range({reach})) AS j))"
    cells = f"c{name} AS (SELECT s.run_id, s.frame, i, j, count(*) AS w, sum(v) AS wv, sum(v * v) AS wvv FROM s{name} s JOIN l USING (run_id, frame) WHERE p <= {pitch} + 6e-2 + 1e-9 GROUP BY s.run_id, s.frame, i, j, floor((l.{move} + 0.5e0 - o) / p), floor((l.{still} + 0.5e0 - {fixed_phase}) / {fixed_pitch}))"
    std = f"d{name} AS (SELECT run_id, frame, i, j, round(sqrt(greatest(sum(wvv) - sum(wv * wv / w), 0) / sum(w)), 9) AS std FROM c{name} GROUP BY ALL)"
    return f"{near}, {cells}, {std}, {name} AS (SELECT * EXCLUDE (i, j, p, o), round(p, 4) AS {move}p, round(o, 4) AS {move}o FROM s{name} JOIN d{name} USING (run_id, frame, i, j) QUALIFY row_number() OVER (PARTITION BY run_id, frame ORDER BY std, i, j) = 1)"


@query("lattice_fit", f"WITH {PX}, l AS (SELECT {K}, {LUM} AS v FROM px), st AS (SELECT DISTINCT run_id, frame, 26e-1 + frame % 3 * 2e-1 AS p0, 0e0 AS o0 FROM px), {_axis('fx', 'x', 'st', 'p0', 'o0', 'p0', 'o0', 11)}, fx2 AS (SELECT * EXCLUDE (std) FROM fx), {_axis('fy', 'y', 'fx2', 'p0', 'o0', 'xp', 'xo', 11)} SELECT run_id, frame, xp AS pitch_x, xo AS phase_x, yp AS pitch_y, yo AS phase_y, round(std, 6) AS std FROM fy")
def _(s, d):
    p0 = 2.6 + F.col("frame") % 3 * 0.2
    start = px(s, d).select("run_id", "frame").distinct().select("run_id", "frame", p0.alias("pitch_x"), F.lit(0.0).alias("phase_x"), p0.alias("pitch_y"), F.lit(0.0).alias("phase_y"))
    return G.fit_lattice(px(s, d), start, H, W, pitch_step=0.03, phase_reach=1.25, phase_step=0.25)


@query("palette_concat", f"WITH {pal('GAMEBOY', 'a')}, {pal('PICO-8', 'b')} SELECT k, pr AS r, pg AS g, pb AS b FROM a UNION ALL SELECT k + 4, pr, pg, pb FROM b")
def _(s, d):
    return P.concat(palette(s, "GAMEBOY").drop("palette"), palette(s, "PICO-8").drop("palette"))


@query("ramp_outlines", f"WITH {pal('SWEETIE-16')}, m AS (SELECT k, band, pr * m AS r, pg * m AS g, pb * m AS b FROM pal CROSS JOIN (SELECT * FROM (VALUES (0, CAST(0.5 AS DOUBLE)), (1, 0.75), (2, 1.25)) t(band, m))) SELECT k * 3 + band AS k, CAST(floor(least(r, 255)) AS BIGINT) AS r, CAST(floor(least(g, 255)) AS BIGINT) AS g, CAST(floor(least(b, 255)) AS BIGINT) AS b FROM m UNION ALL SELECT 48 + k, CAST(floor(r * CAST(0.55 AS DOUBLE)) AS BIGINT), CAST(floor(g * CAST(0.55 AS DOUBLE)) AS BIGINT), CAST(floor(b * CAST(0.55 AS DOUBLE)) AS BIGINT) FROM m WHERE band = 0")
def _(s, d):
    mult = F.array(*[F.struct(F.lit(i).alias("band"), F.lit(m).alias("m")) for i, m in enumerate((0.5, 0.75, 1.25))])
    ramp = palette(s, "SWEETIE-16").select("k", *RGB, F.inline(mult)).select("k", "band", *[(F.col(c) * F.col("m")).alias(c) for c in RGB])
    return P.with_outlines(ramp, 3)


@query("knob_defaults", "SELECT p_partkey AS id, CASE WHEN p_size % 4 = 0 THEN p_size * 2 ELSE p_size % 4 END AS value, CASE p_size % 3 WHEN 0 THEN p_partkey % 2 = 0 ELSE p_size % 3 = 1 END AS flag FROM part")
def _(s, d):
    n = F.col("p_size")
    knob = F.when(n % 4 == 0, -1).otherwise(n % 4)
    state = F.when(n % 3 == 0, "preset").when(n % 3 == 1, "on").otherwise("off")
    return table(s, d, "part").select(F.col("p_partkey").alias("id"), X.pick(knob, n * 2).alias("value"), X.tri_state(state, F.col("p_partkey") % 2 == 0).alias("flag"))


_TEMPLATE = "Plain %s screen, nothing but %s."
_CLAUSES = {"#00FF00": "a green screen", "#000000": "black"}


@query("backdrops", "SELECT id, flat, CASE h WHEN '#00FF00' THEN 'a green screen' WHEN '#000000' THEN 'black' ELSE 'Plain ' || h || ' screen, nothing but ' || h || '.' END AS clause FROM (SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 1 THEN '#000000' ELSE CASE WHEN p_size % 5 = 0 THEN '#00FF00' ELSE printf('ab%02d0f', p_size) END END AS flat, CASE p_partkey % 3 WHEN 0 THEN '#00FF00' WHEN 1 THEN '#000000' ELSE printf('#AB%02d0F', p_size) END AS h FROM part)")
def _(s, d):
    k, n = F.col("p_partkey"), F.col("p_size")
    kind = F.element_at(F.array(*map(F.lit, ("auto", "solid black", "scene", "custom"))), (k % 4 + 1).cast("int"))
    custom = F.when(n % 5 != 0, F.format_string("ab%02d0f", n.cast("int")))
    said = F.when(k % 3 == 0, " 00ff00 ").when(k % 3 == 1, "#000000").otherwise(F.format_string("ab%02d0f", n.cast("int")))
    flat = X.flat_hex(kind, custom, {"solid black": "#000000", "scene": "a plain scene"})
    return table(s, d, "part").select(k.alias("id"), flat.alias("flat"), X.backdrop_clause(said, _CLAUSES, _TEMPLATE).alias("clause"))


@query("still_prompt", "SELECT p_partkey AS id, concat_ws(' ', 'One sprite.', regexp_replace(trim(p_name), '\\.+$', '') || ', side view, ' || p_type || '.', 'Whole figure.', 'Nothing moves.', p_brand || '.', 'Crisp.', CASE WHEN p_size % 3 = 0 THEN 'note ' || p_size END) AS prompt, CAST(5 AS BIGINT) AS length, CAST(24 AS BIGINT) AS fps FROM part")
def _(s, d):
    notes = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit(" note "), F.col("p_size"), F.lit(" "))).otherwise(" ")
    parts = X.still_prompt(F.lit("One sprite."), F.col("p_name"), F.lit("side view"), F.concat("p_type", F.lit(". ")), F.col("p_brand"), [F.lit("Whole figure."), F.lit("Nothing moves."), F.lit("Crisp.")], notes)
    return table(s, d, "part").select(F.col("p_partkey").alias("id"), *parts)


@query("edit_prompt", "SELECT p_partkey AS id, concat_ws(' ', 'Edit <Picture 1>: ' || regexp_replace(trim(p_name), '\\.+$', '') || '.', 'Keep the pose.', CASE WHEN p_size % 2 = 0 THEN 'Keep the palette.' END, 'Nothing moves.', p_brand || '.', 'Crisp.', CASE WHEN p_size % 3 = 0 THEN 'note ' || p_size END) AS prompt, CAST(5 AS BIGINT) AS length, CAST(24 AS BIGINT) AS fps FROM part")
def _(s, d):
    notes = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit(" note "), F.col("p_size"), F.lit(" "))).otherwise("")
    parts = X.edit_prompt(F.lit("Edit <Picture 1>"), F.concat("p_name", F.lit("..")), F.lit("Keep the pose."), F.col("p_size") % 2 == 0, F.lit("Keep the palette."), F.lit("Nothing moves."), F.col("p_brand"), F.lit("Crisp."), notes)
    return table(s, d, "part").select(F.col("p_partkey").alias("id"), *parts)


_REF = "{\"filename\":\"' || stage || '_' || lpad(CAST(frame AS VARCHAR), 3, '0') || '.png\",\"subfolder\":\"\",\"type\":\"temp\"}"


@query("result_payload", f"""WITH {PX}, f AS (SELECT DISTINCT run_id, frame, CASE frame % 4 WHEN 0 THEN 'final' WHEN 1 THEN 'look' WHEN 2 THEN 'source' ELSE 'other' END AS stage FROM px WHERE frame % 4 <> 2 OR run_id % 2 = 0), g AS (SELECT run_id, stage, count(*) AS n, '[' || string_agg('{_REF}', ',' ORDER BY frame) || ']' AS l FROM f GROUP BY 1, 2), r AS (SELECT run_id, max(CASE WHEN stage = 'final' THEN l END) AS fl, max(CASE WHEN stage = 'final' THEN n END) AS n, coalesce(string_agg('{{"stage":"' || stage || '","frames":' || l || '}}', ',' ORDER BY CASE stage WHEN 'source' THEN 1 ELSE 4 END) FILTER (stage IN ('source', 'look')), '') AS dbg FROM g GROUP BY 1)
SELECT run_id, '{{"layers":[{{"id":"gen_default","name":"Generated","frames":' || coalesce(fl, '[]') || ',"source":"forge","meta":{{"w":8,"h":8,"frameCount":' || coalesce(n, 0) || '}}}}],"frame_count":' || coalesce(n, 0) || ',"debug_stages":[' || dbg || '],"report":"run ' || run_id || '"}}' AS json FROM r""")
def _(s, d):
    frames = px(s, d).select("run_id", "frame").distinct().where("frame % 4 <> 2 OR run_id % 2 = 0")
    stage = F.element_at(F.array(*map(F.lit, ("final", "look", "source", "other"))), (F.col("frame") % 4 + 1).cast("int"))
    files = frames.withColumn("stage", stage).withColumn("filename", F.format_string("%s_%03d.png", "stage", "frame"))
    return X.result_payload(files, W, H, F.concat(F.lit("run "), F.col("run_id")))


@query("export_report", "SELECT p_partkey AS id, concat_ws(' | ', CASE WHEN p_size % 2 = 0 THEN 'sheet: packed' END, CASE WHEN p_size % 3 = 0 THEN 'anim: ' || p_size END, CASE WHEN p_size % 5 = 0 THEN 'script' END) AS report FROM part")
def _(s, d):
    n = F.col("p_size")
    parts = {"sheet": (n % 2 == 0, F.lit("sheet: packed")), "anim": (n % 3 == 0, F.concat(F.lit("anim: "), n)), "script": (n % 5 == 0, F.lit("script"))}
    return table(s, d, "part").select(F.col("p_partkey").alias("id"), X.export_report(parts).alias("report"))


@query("sql_functions", f"WITH {PX}, {pal('PICO-8')} SELECT {K}, round({LUM}, 6) AS lum, round({redmean2(('r', 'g', 'b'), ('pr', 'pg', 'pb'))}, 6) AS apart, greatest(abs(r - pr), abs(g - pg), abs(b - pb)) AS most, printf('#%02X%02X%02X', r, g, b) AS hex, 5 + 17 * CAST(ceil(greatest(0, r - 5) / CAST(17 AS DOUBLE)) AS BIGINT) AS snapped FROM px JOIN pal ON k = r % 16")
def _(s, d):
    sqlfuncs.register(s)
    return s.sql(
        """SELECT run_id, frame, y, x, fl_luminance(f.r, f.g, f.b) AS lum, fl_redmean2(f.r, f.g, f.b, p.r, p.g, p.b) AS apart,
        CAST(fl_max_diff(f.r, f.g, f.b, p.r, p.g, p.b) AS BIGINT) AS most, fl_hex(f.r, f.g, f.b) AS hex, fl_snap_frames(f.r / 24D) AS snapped
        FROM {px} f JOIN fl_palette('PICO-8') p ON p.k = f.r % 16""",
        px=px(s, d),
    )
