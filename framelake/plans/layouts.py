"""Queries on layout, guards, timelines, text and JSON."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framelake.operators import layout as L
from framelake.operators import texts as X
from framelake.operators import timeline as TL
from framelake.plans.base import query
from framelake.plans.sqltext import LUM, PX, pal, redmean2
from framelake.sources.palettes import palette
from framelake.sources.tables import px, series, table

K = "run_id, frame, y, x"
KEY = ["run_id", "frame", "y", "x"]
RGB = ["r", "g", "b"]
H = W = 8
HIT = "r > 165"


def _bb(by: str) -> str:
    return f"SELECT {by}, coalesce(min(CASE WHEN {HIT} THEN x END), 0) AS x0, coalesce(min(CASE WHEN {HIT} THEN y END), 0) AS y0, coalesce(max(CASE WHEN {HIT} THEN x END) + 1, 8) AS x1, coalesce(max(CASE WHEN {HIT} THEN y END) + 1, 8) AS y1 FROM px GROUP BY {by}"


@query("bbox_per_frame", f"WITH {PX} {_bb('run_id, frame')}")
def _(s, d):
    return L.bbox(px(s, d), F.col("r") > 165, H, W)


@query("bbox_union", f"WITH {PX} {_bb('run_id')}")
def _(s, d):
    return L.union_bbox(px(s, d), F.col("r") > 165, H, W)


_CV = "cv AS (SELECT run_id, CAST(ceil((max(x1 - x0) + 2) / CAST(4 AS DOUBLE)) * 4 AS BIGINT) AS cw, CAST(ceil((max(y1 - y0) + 2) / CAST(4 AS DOUBLE)) * 4 AS BIGINT) AS ch FROM bx GROUP BY 1)"


@query("auto_crop_canvas", f"WITH {PX}, bx AS ({_bb('run_id, frame')}), {_CV} SELECT * FROM cv")
def _(s, d):
    return L.auto_canvas(L.bbox(px(s, d), F.col("r") > 165, H, W), 1, 4)


@query("anchor_paste", f"WITH {PX}, bx AS ({_bb('run_id, frame')}), {_CV}, pb AS (SELECT run_id, frame, cw, ch, greatest(0, x0 - 1) AS x0, greatest(0, y0 - 1) AS y0, least(8, x1 + 1) AS x1, least(8, y1 + 1) AS y1 FROM bx JOIN cv USING (run_id)) SELECT run_id, frame, y - y0 + (ch - (y1 - y0)) AS y, x - x0 + CAST(floor((cw - (x1 - x0)) / CAST(2 AS DOUBLE)) AS BIGINT) AS x, r, g, b FROM px JOIN pb USING (run_id, frame) WHERE x >= x0 AND x < x1 AND y >= y0 AND y < y1")
def _(s, d):
    p = px(s, d)
    boxes = L.bbox(p, F.col("r") > 165, H, W)
    return L.paste(p, L.placements(boxes, L.auto_canvas(boxes, 1, 4), 1, H, W)).select(*KEY, *RGB)


_SHEET = "n AS (SELECT run_id, max(frame) + 1 AS n FROM px GROUP BY 1), c AS (SELECT run_id, CAST(ceil(sqrt(n)) AS BIGINT) AS cols, n FROM n), sh AS (SELECT DISTINCT px.run_id, frame, frame % cols AS col, frame // cols AS row, 2 + (frame % cols) * 10 AS x, 2 + (frame // cols) * 10 AS y, cols * 10 + 2 AS sheet_w, CAST(ceil(n / CAST(cols AS DOUBLE)) AS BIGINT) * 10 + 2 AS sheet_h FROM px JOIN c USING (run_id))"


@query("sheet_layout", f"WITH {PX}, {_SHEET} SELECT * FROM sh")
def _(s, d):
    return L.sheet_layout(px(s, d), W, H, 2)


@query("proportional_padding", f"WITH {PX}, bx AS ({_bb('run_id')}) SELECT run_id, CAST(least(32, greatest(3, round_even(greatest(x1 - x0, y1 - y0) * 8 * CAST(0.1 AS DOUBLE), 0))) AS BIGINT) AS pad FROM bx")
def _(s, d):
    boxes = L.union_bbox(px(s, d), F.col("r") > 165, H, W)
    return L.proportional_padding(boxes.withColumns({c: F.col(c) * 8 for c in L.BOX}))


@query("occupancy_audit", f"WITH {PX}, bx AS ({_bb('run_id, frame')}) SELECT run_id * 20 + frame AS run_id, round((x1 - x0) / CAST(8 AS DOUBLE), 6) AS share_w, round((y1 - y0) / CAST(8 AS DOUBLE), 6) AS share_h, CASE WHEN (x1 - x0) / CAST(8 AS DOUBLE) > 0.92 OR (y1 - y0) / CAST(8 AS DOUBLE) > 0.92 THEN 'fills' WHEN (x1 - x0) / CAST(8 AS DOUBLE) < 0.4 AND (y1 - y0) / CAST(8 AS DOUBLE) < 0.4 THEN 'tiny' ELSE 'fits' END AS verdict FROM bx")
def _(s, d):
    # each frame counts as a run
    return L.occupancy(L.bbox(px(s, d), F.col("r") > 165, H, W).withColumn("run_id", F.col("run_id") * 20 + F.col("frame")), H, W)


@query("outlier_frames", f"WITH {PX}, s AS (SELECT run_id, frame, avg(CASE WHEN r > 140 THEN 1 ELSE 0 END) AS o FROM px GROUP BY 1, 2), m AS (SELECT run_id, median(o) AS m FROM s GROUP BY 1) SELECT run_id, frame, round(o, 6) AS opaque, round(m, 6) AS typical, m < 0.45 AND o > 0.45 AND o > greatest(2 * m, m + 0.3) AS bad FROM s JOIN m USING (run_id)")
def _(s, d):
    return L.outlier_frames(px(s, d).withColumn("a", F.when(F.col("r") > 140, 1.0).otherwise(0.0)))


@query("mad_2x2", f"WITH {PX}, c AS (SELECT *, y // 2 AS cy, x // 2 AS cx FROM px), m AS (SELECT *, avg(r) OVER w AS mr, avg(g) OVER w AS mg, avg(b) OVER w AS mb, min(a) OVER w AS so FROM c WINDOW w AS (PARTITION BY run_id, frame, cy, cx)), e AS (SELECT run_id, frame, cy, cx, any_value(so) AS so, avg(abs(r - mr) + abs(g - mg) + abs(b - mb)) / 3 AS d FROM m GROUP BY ALL), f AS (SELECT run_id, frame, coalesce(avg(CASE WHEN so > 0.5 THEN d END), 0) AS mad FROM e GROUP BY 1, 2) SELECT run_id, round(median(mad), 6) AS mad FROM f GROUP BY 1")
def _(s, d):
    return L.mad_2x2(px(s, d, alpha=True))


def _guard(by: str, name: str) -> str:
    return f"{name} AS (SELECT {by}, avg(CASE WHEN d < 30 THEN 1 ELSE 0 END) * 100 AS core, median(d) AS med FROM gd GROUP BY {by})"


_GD = f"gd AS (SELECT {K}, sqrt(min({redmean2(('r', 'g', 'b'), ('pr', 'pg', 'pb'))})) AS d FROM px CROSS JOIN pal WHERE a > 0.5 GROUP BY {K})"


@query("ref_guard", f"WITH {PX}, {pal('ENDESGA-32')}, {_GD}, {_guard('run_id', 'q')} SELECT run_id, round(core, 6) AS core, round(med, 6) AS typical, core >= 27 AND med <= 75 AS match FROM q")
def _(s, d):
    return L.palette_guard(px(s, d, alpha=True), palette(s, "ENDESGA-32").drop("palette"), ("run_id",))


@query("frame_quorum", f"WITH {PX}, {pal('ENDESGA-32')}, {_GD}, {_guard('run_id, frame', 'f')}, {_guard('run_id', 'q')}, u AS (SELECT run_id, avg(CASE WHEN core >= 27 AND med <= 75 THEN 1 ELSE 0 END) AS quorum FROM f GROUP BY 1) SELECT run_id, round(quorum, 6) AS quorum, (core >= 27 AND med <= 75) OR quorum >= 1 / CAST(3 AS DOUBLE) AS passes FROM u JOIN q USING (run_id)")
def _(s, d):
    return L.frame_quorum(px(s, d, alpha=True), palette(s, "ENDESGA-32").drop("palette"))


@query("band_boundaries", f"WITH {PX}, l AS (SELECT run_id, {LUM} AS l FROM px), q AS (SELECT run_id, quantile_cont(l, [CAST(0.2 AS DOUBLE), CAST(0.7 AS DOUBLE)]) AS q FROM l GROUP BY 1) SELECT run_id, CAST(unnest([0, 1]) AS BIGINT) AS band, round(unnest(q), 6) AS bound FROM q")
def _(s, d):
    return L.band_boundaries(px(s, d), [2.0, 5.0, 3.0])


@query("band_remap", f"WITH {PX}, l AS (SELECT {K}, {LUM} AS l FROM px), q AS (SELECT run_id, quantile_cont(l, CAST(0.2 AS DOUBLE)) AS q1, quantile_cont(l, CAST(0.7 AS DOUBLE)) AS q2 FROM l GROUP BY 1) SELECT {K}, CAST(CASE WHEN q1 < l THEN 1 ELSE 0 END + CASE WHEN q2 < l THEN 1 ELSE 0 END AS BIGINT) AS band FROM l JOIN q USING (run_id)")
def _(s, d):
    p = px(s, d)
    return L.band_remap(p, L.band_boundaries(p, [2.0, 5.0, 3.0])).select(*KEY, "band")


@query("segment_overlap", """WITH sg AS (SELECT o_custkey % 50 AS lane, o_orderkey AS pos, CAST(floor(o_totalprice / 1000) AS BIGINT) AS st, CAST(floor(o_totalprice / 1000) AS BIGINT) + o_orderkey % 23 AS en, o_orderpriority AS tx FROM orders),
h AS (SELECT lane, trim(tx) AS t, min(st * 1000000000 + pos) AS o FROM sg WHERE en > st AND st < 220 AND en > 100 AND trim(tx) <> '' GROUP BY 1, 2) SELECT lane, string_agg(t, '. ' ORDER BY o) AS texts, count(*) AS n FROM h GROUP BY 1""")
def _(s, d):
    start = F.floor(F.col("o_totalprice") / 1000)
    seg = table(s, d, "orders").select((F.col("o_custkey") % 50).alias("lane"), F.col("o_orderkey").alias("pos"), start.alias("start"), (start + F.col("o_orderkey") % 23).alias("end"), F.col("o_orderpriority").alias("text"))
    return TL.overlapping_texts(seg, 100, 120, "lane")


@query("asof_resample", """WITH b AS (SELECT user_id AS key, CAST(epoch_us(ts) AS BIGINT) // 1000000 AS t, event_id, value FROM events), r AS (SELECT CAST(min(t) // 21600 * 21600 AS BIGINT) AS lo, CAST(max(t) AS BIGINT) AS hi FROM b),
tk AS (SELECT key, unnest(range(lo, hi + 1, 21600)) AS t FROM (SELECT DISTINCT key FROM b), r), u AS (SELECT key, t, value, event_id FROM b QUALIFY row_number() OVER (PARTITION BY key, t ORDER BY event_id DESC) = 1) SELECT tk.key, tk.t AS tick, round(u.value, 6) AS value FROM tk ASOF LEFT JOIN u ON tk.key = u.key AND tk.t >= u.t""")
def _(s, d):
    t = F.unix_seconds(F.col("ts").cast("timestamp"))
    rows = table(s, d, "events").select(F.col("user_id").alias("key"), t.alias("tick"), F.col("event_id").alias("_o"), "value")
    span = rows.agg((F.floor(F.min("tick") / 21600) * 21600).alias("lo"), F.max("tick").alias("hi"))  # one row
    ticks = rows.select("key").distinct().crossJoin(F.broadcast(span)).select("key", F.explode(F.sequence("lo", "hi", F.lit(21600).cast("bigint"))).alias("tick"))
    return TL.asof_backward(ticks, rows, "key", "tick", "value")


_KEYF = "e AS (SELECT event_type || '/' || CAST(user_id AS VARCHAR) AS layer, value, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) - 1 AS i FROM events), k AS (SELECT layer, i * 7 + 3 AS frame, value AS x, value / 2 AS y, 1 + value / 1000 AS scale FROM e)"


@query("keyframe_interp", f"""WITH {_KEYF}, f AS (SELECT layer, unnest(range(top + 11)) AS frame FROM (SELECT layer, max(frame) AS top FROM k GROUP BY 1)), j AS (SELECT f.layer, f.frame, p.frame AS pf, p.x AS px, p.y AS py, p.scale AS ps, n.frame AS nf, n.x AS nx, n.y AS ny, n.scale AS ns FROM f ASOF LEFT JOIN k p ON f.layer = p.layer AND f.frame >= p.frame ASOF LEFT JOIN k n ON f.layer = n.layer AND f.frame < n.frame),
w AS (SELECT *, CAST(frame - pf AS DOUBLE) / (nf - pf) AS t, pf IS NULL OR pf = 3 AND frame = 3 AS lo, nf IS NULL AS hi FROM j) SELECT layer, frame, round(CASE WHEN pf IS NULL THEN nx WHEN lo OR hi THEN px ELSE 10 + px + (nx - px) * t END, 6) AS x, round(CASE WHEN pf IS NULL THEN ny WHEN lo OR hi THEN py ELSE 20 + py + (ny - py) * t END, 6) AS y, round(CASE WHEN pf IS NULL THEN ns WHEN lo OR hi THEN ps ELSE 2 * (ps + (ns - ps) * t) END, 6) AS scale FROM w""")
def _(s, d):
    w = Window.partitionBy("event_type", "user_id").orderBy("ts", "event_id")
    e = table(s, d, "events").withColumn("i", F.row_number().over(w) - 1)
    v = F.col("value")
    keys = e.select(F.concat_ws("/", "event_type", "user_id").alias("layer"), (F.col("i") * 7 + 3).alias("frame"), v.alias("x"), (v / 2).alias("y"), (1 + v / 1000).alias("scale"))
    frames = keys.groupBy("layer").agg(F.max("frame").alias("top")).select("layer", F.explode(F.sequence(F.lit(0), F.col("top") + 10)).alias("frame"))
    return TL.interpolate(frames, keys, "layer", (10.0, 20.0, 2.0))


_LAYERS = "ly AS (SELECT n_nationkey AS pos, n_regionkey, (n_nationkey + 5) / CAST(40 AS DOUBLE) AS opacity, CASE n_nationkey % 4 WHEN 0 THEN 'normal' WHEN 1 THEN 'multiply' WHEN 2 THEN 'screen' ELSE 'overlay' END AS mode, n_nationkey % 7 <> 3 AS visible FROM nation)"


@query("layer_composite", f"""WITH RECURSIVE {PX}, {_LAYERS}, v AS (SELECT *, row_number() OVER (ORDER BY pos) AS i FROM ly WHERE visible),
c AS (SELECT p.run_id AS run_id, p.y, p.x, v.i, p.r / CAST(255 AS DOUBLE) AS r, p.g / CAST(255 AS DOUBLE) AS g, p.b / CAST(255 AS DOUBLE) AS b, p.a * v.opacity AS sa, v.mode FROM px p JOIN v ON p.frame = v.pos),
f AS (SELECT DISTINCT run_id, y, x, CAST(0 AS BIGINT) AS i, CAST(0 AS DOUBLE) AS r, CAST(0 AS DOUBLE) AS g, CAST(0 AS DOUBLE) AS b, CAST(0 AS DOUBLE) AS a FROM c UNION ALL
SELECT c.run_id, c.y, c.x, c.i, {', '.join(f"CASE WHEN oa > 0 THEN (c.sa * ((1 - f.a) * c.{ch} + f.a * (CASE c.mode WHEN 'multiply' THEN f.{ch} * c.{ch} WHEN 'screen' THEN f.{ch} + c.{ch} - f.{ch} * c.{ch} WHEN 'overlay' THEN CASE WHEN f.{ch} <= 0.5 THEN 2 * f.{ch} * c.{ch} ELSE 1 - 2 * (1 - f.{ch}) * (1 - c.{ch}) END ELSE c.{ch} END)) + (1 - c.sa) * f.a * f.{ch}) / oa ELSE 0 END" for ch in RGB)}, oa
FROM f JOIN c ON c.run_id = f.run_id AND c.y = f.y AND c.x = f.x AND c.i = f.i + 1, LATERAL (SELECT c.sa + f.a * (1 - c.sa) AS oa)) SELECT run_id, y, x, round(r, 6) AS r, round(g, 6) AS g, round(b, 6) AS b, round(a, 6) AS a FROM f QUALIFY row_number() OVER (PARTITION BY run_id, y, x ORDER BY i DESC) = 1""")
def _(s, d):
    k = F.col("n_nationkey")
    mode = F.when(k % 4 == 0, "normal").when(k % 4 == 1, "multiply").when(k % 4 == 2, "screen").otherwise("overlay")
    layers = table(s, d, "nation").select(k.alias("pos"), ((k + 5) / 40.0).alias("opacity"), mode.alias("mode"), (k % 7 != 3).alias("visible"))
    cels = px(s, d, alpha=True).withColumnRenamed("frame", "pos").join(F.broadcast(layers), "pos")
    return TL.composite(cels.withColumns({c: F.col(c) / 255.0 for c in RGB}), ["run_id", "y", "x"])


@query("ref_binding", "WITH l AS (SELECT n_regionkey AS grp, n_name AS layer, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey, n_name) AS i FROM nation WHERE n_nationkey % 3 <> 1 AND n_nationkey % 2 = 0), s AS (SELECT c_nationkey % 5 AS grp, c_custkey AS slot, row_number() OVER (PARTITION BY c_nationkey % 5 ORDER BY c_custkey) AS i FROM customer WHERE c_acctbal > 5000) SELECT grp, layer, slot FROM l JOIN s USING (grp, i)")
def _(s, d):
    layers = table(s, d, "nation").select(F.col("n_regionkey").alias("grp"), F.col("n_name").alias("layer"), F.col("n_nationkey").alias("pos"), (F.col("n_nationkey") % 3 != 1).alias("visible"), F.when(F.col("n_nationkey") % 2 == 0, "ref").otherwise("art").alias("kind"))
    slots = table(s, d, "customer").select((F.col("c_nationkey") % 5).alias("grp"), F.col("c_custkey").alias("slot"), (F.col("c_acctbal") > 5000).alias("free"))
    return TL.bind_slots(layers, slots, "grp")


@query("layer_upsert", "WITH o AS (SELECT c_custkey AS id, c_acctbal AS opacity, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN 'user' ELSE 'forge' END AS source FROM customer WHERE c_custkey % 2 = 0), n AS (SELECT c_custkey AS id, CAST(1 AS DOUBLE) AS opacity, c_mktsegment AS name, 'forge' AS source FROM customer WHERE c_custkey % 5 = 0) SELECT n.id, round(coalesce(o.opacity, n.opacity), 6) AS opacity, n.name, n.source FROM n LEFT JOIN o USING (id) UNION ALL SELECT id, round(opacity, 6), name, source FROM o WHERE source = 'user' AND id NOT IN (SELECT id FROM n)")
def _(s, d):
    c = table(s, d, "customer")
    old = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("opacity"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 3 == 0, "user").otherwise("forge").alias("source"))
    new = c.where("c_custkey % 5 = 0").select(F.col("c_custkey").alias("id"), F.lit(1.0).alias("opacity"), F.col("c_mktsegment").alias("name"), F.lit("forge").alias("source"))
    return TL.upsert_layers(old, new, ["id"], ["opacity"])


_CEL = "cl AS (SELECT l_suppkey % 20 AS layer, l_linenumber * 3 + l_orderkey % 3 AS frame, max(l_partkey) AS cel FROM lineitem GROUP BY 1, 2)"


@query("cel_splice", f"WITH {_CEL} SELECT layer, frame, cel FROM cl WHERE frame < 8 OR frame >= 13 UNION ALL SELECT layer, frame - 3 + 8, cel FROM cl WHERE frame >= 3 AND frame - 3 < 5")
def _(s, d):
    li = table(s, d, "lineitem")
    cels = li.groupBy((F.col("l_suppkey") % 20).alias("layer"), (F.col("l_linenumber") * 3 + F.col("l_orderkey") % 3).alias("frame")).agg(F.max("l_partkey").alias("cel"))
    return TL.splice(cels, cels.withColumn("frame", F.col("frame") - 3), 8, 5, "layer")


@query("cel_edit", f"WITH {_CEL}, a AS (SELECT layer, CASE WHEN frame >= 6 THEN frame + 1 ELSE frame END AS frame, cel FROM cl UNION ALL SELECT layer, 6, cel FROM cl WHERE frame = 5), b AS (SELECT layer, CASE WHEN frame > 9 THEN frame - 1 ELSE frame END AS frame, cel FROM a WHERE frame <> 9) SELECT layer, CASE WHEN frame >= 12 THEN frame + 2 ELSE frame END AS frame, cel FROM b")
def _(s, d):
    li = table(s, d, "lineitem")
    cels = li.groupBy((F.col("l_suppkey") % 20).alias("layer"), (F.col("l_linenumber") * 3 + F.col("l_orderkey") % 3).alias("frame")).agg(F.max("l_partkey").alias("cel"))
    return TL.insert_blank(TL.delete_cel(TL.duplicate_cel(cels, 5), 9), 12, 2)


@query("line_raster", "WITH l AS (SELECT s_suppkey AS id, s_suppkey % 17 AS x0, s_nationkey AS y0, s_suppkey % 29 AS x1, (s_suppkey * 7) % 31 AS y1 FROM supplier), n AS (SELECT *, greatest(abs(x1 - x0), abs(y1 - y0), 1) AS n FROM l), i AS (SELECT *, unnest(range(CAST(n AS BIGINT) + 1)) AS i FROM n) SELECT id, CAST(floor(x0 + (x1 - x0) * i / CAST(n AS DOUBLE) + 0.5) AS BIGINT) AS x, CAST(floor(y0 + (y1 - y0) * i / CAST(n AS DOUBLE) + 0.5) AS BIGINT) AS y FROM i")
def _(s, d):
    k = F.col("s_suppkey")
    lines = table(s, d, "supplier").select(k.alias("id"), (k % 17).alias("x0"), F.col("s_nationkey").alias("y0"), (k % 29).alias("x1"), (k * 7 % 31).alias("y1"))
    return TL.line_points(lines).select("id", "x", "y")


@query("zoom_snap", "SELECT s_suppkey AS id, round(CASE WHEN z >= 1 THEN CASE WHEN greatest(1, floor(z)) > 3.5 THEN 3 ELSE greatest(1, floor(z)) END ELSE 1 / CASE WHEN 1 / greatest(1, floor(1 / z + 0.5)) > 3.5 THEN greatest(1, ceil(1 / z)) ELSE greatest(1, floor(1 / z + 0.5)) END END, 6) AS zoom FROM (SELECT s_suppkey, (s_suppkey % 97 + 1) / CAST(16 AS DOUBLE) AS z FROM supplier)")
def _(s, d):
    return table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), TL.zoom_snap((F.col("s_suppkey") % 97 + 1) / 16.0, 3.5).alias("zoom"))


_LOOP = "The motion is a perfect seamless loop: the animation ends exactly in the pose it started in."


@query("prompt_build", f"SELECT p_partkey AS id, concat_ws(' ', 'Sprite, ' || p_type || '.', regexp_replace(trim(p_name), '\\.+$', '') || ', side view.', 'The character ' || regexp_replace(trim(p_brand || '..'), '\\.+$', '') || '.', 'Plain ground.', CASE WHEN p_size % 2 = 0 THEN '{_LOOP}' END, CASE WHEN p_size % 3 = 0 THEN 'note ' || p_size END) AS prompt FROM part")
def _(s, d):
    notes = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit(" note "), F.col("p_size"), F.lit(" "))).otherwise(" ")
    prompt = X.build_prompt(F.concat(F.lit("Sprite, "), "p_type", F.lit(".")), F.col("p_name"), F.concat("p_brand", F.lit("..")), F.lit("side view"), [F.lit("Plain ground.")], F.col("p_size") % 2 == 0, notes)
    return table(s, d, "part").select(F.col("p_partkey").alias("id"), prompt.alias("prompt"))


@query("tag_binding", "WITH t AS (SELECT p_partkey AS id, p_name || CASE WHEN p_size % 2 = 0 THEN ' <Picture 1> ' ELSE ' ' END AS p FROM part) SELECT id, CASE WHEN contains(p, '<Picture 1>') THEN rtrim(p) || ' The subject matches <Picture 3>.' ELSE rtrim(p) || ' The subject matches <Picture 1>, <Picture 3>.' END AS prompt FROM t")
def _(s, d):
    p = F.concat("p_name", F.when(F.col("p_size") % 2 == 0, " <Picture 1> ").otherwise(" "))
    rows = table(s, d, "part").select(F.col("p_partkey").alias("id"), p.alias("p"))
    return rows.select("id", X.bind_tags(F.col("p"), F.array(F.lit("<Picture 1>"), F.lit("<Picture 3>")), "The subject matches").alias("prompt"))


@query("frame_grid_snap", "WITH n AS (SELECT p_partkey AS id, greatest(5, CAST(round_even(p_size * CAST(0.25 AS DOUBLE) * 24, 0) AS BIGINT)) AS n FROM part), u AS (SELECT id, n, n + (17 + (5 - n) % 17) % 17 AS up, greatest(5, n - (n - 5) % 17) AS down FROM n) SELECT id, up, down, CASE WHEN n - down <= up - n THEN down ELSE up END AS nearest FROM u")
def _(s, d):
    sec = F.col("p_size") * F.lit(0.25).cast("double")
    return table(s, d, "part").select(F.col("p_partkey").alias("id"), *[X.snap_frames(sec, h).alias(h) for h in ("up", "down", "nearest")])


_DUR = "du AS (SELECT DISTINCT run_id, frame, 1 + frame % 4 AS duration FROM px)"


@query("manifest_json", f"""WITH {PX}, {_DUR} SELECT run_id, '{{"tag":"walk","fps":12.0,"frame_size":[8,8],"frames":[' || string_agg('{{"file":"frame_' || lpad(CAST(frame AS VARCHAR), 3, '0') || '.png","duration_ms":' || CAST(CAST(greatest(1, round_even(1000 * duration / CAST(12 AS DOUBLE), 0)) AS BIGINT) AS VARCHAR) || '}}', ',' ORDER BY frame) || ']}}' AS json FROM du GROUP BY 1""")
def _(s, d):
    return X.manifests(_durations(s, d), 12, "walk", 8, 8)


def _durations(s, d):
    return px(s, d).select("run_id", "frame").distinct().withColumn("duration", 1 + F.col("frame") % 4)


@query("manifest_read", f"WITH {PX}, {_DUR} SELECT run_id, 'walk' AS tag, CAST(12 AS DOUBLE) AS fps, 'frame_' || lpad(CAST(frame AS VARCHAR), 3, '0') || '.png' AS file, round(greatest(1, round_even(1000 * duration / CAST(12 AS DOUBLE), 0)) / 1000, 6) AS duration_s FROM du")
def _(s, d):
    return X.read_manifests(X.manifests(_durations(s, d), 12, "walk", 8, 8))


@query("sheet_json", f"""WITH {PX}, {_SHEET} SELECT run_id, '{{"frames":{{' || string_agg('"frame_' || lpad(CAST(frame AS VARCHAR), 3, '0') || '":{{"frame":{{"x":' || x || ',"y":' || y || ',"w":8,"h":8}},"rotated":false,"trimmed":false,"spriteSourceSize":{{"x":0,"y":0,"w":8,"h":8}},"sourceSize":{{"w":8,"h":8}}}}', ',' ORDER BY frame) || '}},"meta":{{"size":{{"w":' || any_value(sheet_w) || ',"h":' || any_value(sheet_h) || '}},"scale":"1"}}}}' AS json FROM sh GROUP BY 1""")
def _(s, d):
    return X.sheet_json(L.sheet_layout(px(s, d), W, H, 2), W, H)


@query("build_script", f"WITH {PX}, {_DUR} SELECT run_id, string_agg('frame(' || (frame + 1) || ', ''frame_' || lpad(CAST(frame AS VARCHAR), 3, '0') || '.png'', ' || printf('%.3f', duration / CAST(12 AS DOUBLE)) || ')', chr(10) ORDER BY frame) AS script FROM du GROUP BY 1")
def _(s, d):
    return X.build_script(_durations(s, d))


@query("sigma_warp", "WITH s AS (SELECT user_id AS key, event_id, value, max(value) OVER (PARTITION BY user_id) AS top FROM events) SELECT key, event_id, round(CASE WHEN value <= 0 THEN value ELSE top * pow(value / top, CAST(1 - 0.7 * 0.5 AS DOUBLE)) END, 6) AS sigma FROM s")
def _(s, d):
    rows = table(s, d, "events").select(F.col("user_id").alias("key"), "event_id", "value", F.max("value").over(Window.partitionBy("user_id")).alias("top"))
    return rows.select("key", "event_id", X.sigma_warp(F.col("value"), F.col("top"), 0.5).alias("sigma"))


@query("latent_split", "SELECT vec_id, CAST(48 AS BIGINT) AS n_video, CAST(16 AS BIGINT) AS n_audio, round(list_sum(list_transform(embedding[1:48], lambda v: CAST(v AS DOUBLE))), 6) AS video, round(list_sum(list_transform(embedding[49:64], lambda v: CAST(v AS DOUBLE))), 6) AS audio FROM embeddings")
def _(s, d):
    v, a = X.split_latent(F.col("embedding"), 48)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda t, e: t + e.cast("double"))
    return table(s, d, "embeddings").select("vec_id", F.size(v).alias("n_video"), F.size(a).alias("n_audio"), total(v).alias("video"), total(a).alias("audio"))
