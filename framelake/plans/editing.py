"""Queries on edits of layers, keyframes and segments."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framelake.operators import editing as E
from framelake.plans.base import query
from framelake.sources.tables import table

#: groups of 1, 3, 5, 7 and 9 layers
_GROUP = "CAST(floor(sqrt(CAST(n_nationkey AS DOUBLE))) AS BIGINT)"
_LISTS = f"a AS (SELECT {_GROUP} AS grp, list(n_name ORDER BY n_nationkey) AS l FROM nation GROUP BY 1)"
_UNNEST = "SELECT grp, CAST(i AS BIGINT) AS pos, l[i + 1] AS name FROM (SELECT grp, l, unnest(range(len(l))) AS i FROM {0})"


def _layers(s, d):
    n = table(s, d, "nation").select(F.floor(F.sqrt("n_nationkey")).alias("grp"), F.col("n_name").alias("name"), "n_nationkey")
    pos = F.row_number().over(Window.partitionBy("grp").orderBy("n_nationkey")) - 1
    return n.select("grp", pos.alias("pos"), "name")


@query("layer_edit", f"WITH {_LISTS}, b AS (SELECT grp, l[1:2] || ['New'] || l[3:] AS l FROM a), c AS (SELECT grp, l[1:2] || [l[2] || ' copy'] || l[3:] AS l FROM b), m AS (SELECT grp, CASE WHEN len(l) > 3 THEN [l[4]] || l[1:3] || l[5:] ELSE l END AS l FROM c), n AS (SELECT grp, CASE WHEN len(l) > 5 THEN l[1:1] || l[3:6] || [l[2]] || l[7:] ELSE l END AS l FROM m) {_UNNEST.format('n')}")
def _(s, d):
    rows = E.duplicate_layer(E.add_layer(_layers(s, d), "grp", "New", 2), 1)
    return E.move_layer(E.move_layer(rows, "grp", 3, 0), "grp", 1, 5)


@query("layer_remove", f"WITH {_LISTS}, b AS (SELECT grp, CASE WHEN len(l) > 1 THEN l[2:] ELSE l END AS l FROM a), c AS (SELECT grp, CASE WHEN len(l) > 1 THEN l[1:4] || l[6:] ELSE l END || ['Top'] AS l FROM b) {_UNNEST.format('c')}")
def _(s, d):
    return E.add_layer(E.remove_layer(E.remove_layer(_layers(s, d), "grp", 0), "grp", 4), "grp", "Top")


_KEYS = "k AS (SELECT o_custkey % 20 AS layer, o_orderkey % 48 AS frame, max(o_totalprice) AS x, min(o_totalprice) AS y, CAST(2 AS DOUBLE) AS scale FROM orders GROUP BY 1, 2), n AS (SELECT c_custkey % 25 AS layer, c_custkey % 47 AS frame, max(CASE WHEN c_acctbal > 0 THEN c_acctbal END) AS x, min(c_acctbal) AS y, max(CAST(c_custkey % 3 AS DOUBLE)) AS scale FROM customer GROUP BY 1, 2), g AS (SELECT DISTINCT s_suppkey % 20 AS layer, s_nationkey AS frame FROM supplier)"


@query("keyframe_edit", f"WITH {_KEYS}, u AS (SELECT layer, frame, coalesce(n.x, CASE WHEN n.scale IS NULL THEN k.x ELSE 0 END) AS x, coalesce(n.y, k.y) AS y, coalesce(CASE WHEN n.scale = 0 THEN 1 ELSE n.scale END, k.scale) AS scale FROM k FULL JOIN n USING (layer, frame)) SELECT layer, frame, round(x, 6) AS x, round(y, 6) AS y, round(scale, 6) AS scale FROM u WHERE (layer, frame) NOT IN (SELECT (layer, frame) FROM g)")
def _(s, d):
    o, c, on = table(s, d, "orders"), table(s, d, "customer"), ["layer", "frame"]
    keys = o.groupBy((F.col("o_custkey") % 20).alias("layer"), (F.col("o_orderkey") % 48).alias("frame")).agg(F.max("o_totalprice").alias("x"), F.min("o_totalprice").alias("y"), F.lit(2.0).alias("scale"))
    k = F.col("c_custkey")
    fresh = c.groupBy((k % 25).alias("layer"), (k % 47).alias("frame")).agg(F.max(F.when(F.col("c_acctbal") > 0, F.col("c_acctbal"))).alias("x"), F.min("c_acctbal").alias("y"), F.max((k % 3).cast("double")).alias("scale"))
    gone = table(s, d, "supplier").select((F.col("s_suppkey") % 20).alias("layer"), F.col("s_nationkey").alias("frame"))
    return E.drop_keyframes(E.put_keyframes(keys, fresh, on), gone, on)


_CELS = "cl AS (SELECT l_suppkey % 20 AS layer, l_linenumber * 3 + l_orderkey % 3 AS frame, max(l_partkey) AS cel, CAST(max(l_quantity) AS BIGINT) + l_suppkey % 20 * 2 AS w, CAST(min(l_quantity) AS BIGINT) * 70 - l_suppkey % 20 AS h FROM lineitem GROUP BY 1, 2)"
_LY = "ly AS (SELECT n_nationkey AS layer, n_nationkey // 5 AS grp, n_nationkey % 7 <> 3 AS visible, CASE WHEN n_nationkey % 5 = 0 THEN 'ref' ELSE 'normal' END AS kind FROM nation)"


def _cels(s, d):
    k = F.col("l_suppkey") % 20
    rows = table(s, d, "lineitem").groupBy(k.alias("layer"), (F.col("l_linenumber") * 3 + F.col("l_orderkey") % 3).alias("frame"))
    cels = rows.agg(F.max("l_partkey").alias("cel"), F.max("l_quantity").cast("long").alias("w"), F.min("l_quantity").cast("long").alias("h"))
    return cels.withColumns({"w": F.col("w") + F.col("layer") * 2, "h": F.col("h") * 70 - F.col("layer")})


def _kinds(s, d):
    k = F.col("n_nationkey")
    return table(s, d, "nation").select(k.alias("layer"), F.floor(k / 5).alias("grp"), (k % 7 != 3).alias("visible"), F.when(k % 5 == 0, "ref").otherwise("normal").alias("kind"))


@query("total_frames", f"WITH {_CELS}, {_LY} SELECT grp, coalesce(max(frame) + 1, 0) AS frames FROM ly LEFT JOIN cl USING (layer) GROUP BY 1")
def _(s, d):
    return E.total_frames(_kinds(s, d), _cels(s, d), "grp")


@query("canvas_extent", f"WITH {_CELS}, {_LY} SELECT frame, greatest(64, coalesce(max(w) FILTER (visible AND kind <> 'ref'), 0)) AS w, greatest(64, coalesce(max(h) FILTER (visible AND kind <> 'ref'), 0)) AS h FROM cl JOIN ly USING (layer) GROUP BY 1")
def _(s, d):
    return E.canvas_extent(_kinds(s, d), _cels(s, d))


@query("ref_guides", f"WITH {_CELS}, {_LY}, sp AS (SELECT layer, frame, cel FROM cl WHERE frame % 4 <> layer % 4), f AS (SELECT layer, kind, unnest(range(30)) AS frame FROM ly WHERE visible), j AS (SELECT f.layer, f.frame, coalesce(sp.cel, CASE WHEN kind = 'ref' THEN (SELECT arg_min(q.cel, q.frame) FROM sp q WHERE q.layer = f.layer) END) AS cel FROM f LEFT JOIN sp ON sp.layer = f.layer AND sp.frame = f.frame) SELECT * FROM j WHERE cel IS NOT NULL")
def _(s, d):
    cels = _cels(s, d).where(F.col("frame") % 4 != F.col("layer") % 4)
    return E.shown_cels(_kinds(s, d), cels.select("layer", "frame", "cel"), 30)


@query("regen_range", "WITH r AS (SELECT o_orderkey AS id, o_custkey % 90 AS a, o_custkey % 90 + o_orderkey % 53 AS e FROM orders), n AS (SELECT *, e - a + 1 AS c, (SELECT min(k * 17 + 5) FROM range(9) t(k) WHERE k * 17 + 5 >= e - a + 1) AS n FROM r) SELECT id, a AS start, c AS count, n, round(n / CAST(24 AS DOUBLE), 6) AS seconds FROM n")
def _(s, d):
    a = F.col("o_custkey") % 90
    return table(s, d, "orders").select(F.col("o_orderkey").alias("id"), *E.regen_range(a, a + F.col("o_orderkey") % 53))


_SEG = "sg AS (SELECT o_custkey % 50 AS lane, o_orderkey AS pos, CAST(floor(o_totalprice / 1000) AS BIGINT) AS st, CAST(floor(o_totalprice / 1000) AS BIGINT) + o_orderkey % 23 AS en, o_orderpriority AS tx FROM orders)"


def _segments(s, d):
    start = F.floor(F.col("o_totalprice") / 1000)
    return table(s, d, "orders").select((F.col("o_custkey") % 50).alias("lane"), F.col("o_orderkey").alias("pos"), start.alias("start"), (start + F.col("o_orderkey") % 23).alias("end"), F.col("o_orderpriority").alias("text"))


@query("segment_hit", f"WITH {_SEG}, p AS (SELECT event_id, user_id % 50 AS lane, event_id * 13 % 6007 AS px FROM events) SELECT event_id, p.lane, px, px // 14 AS frame, coalesce(pos, -1) AS hit, CASE WHEN abs(px - st * 14) <= 4 THEN 'l' WHEN abs(px - en * 14) <= 4 THEN 'r' ELSE '' END AS edge FROM p LEFT JOIN sg ON p.lane = sg.lane AND px // 14 >= st AND px // 14 < en QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY pos) = 1")
def _(s, d):
    points = table(s, d, "events").select("event_id", (F.col("user_id") % 50).alias("lane"), (F.col("event_id") * 13 % 6007).alias("px"))
    return E.segment_hits(_segments(s, d), points, "lane", 14)


@query("segment_drag", f"WITH {_SEG}, m AS (SELECT *, pos % 61 - 30 AS dv, pos // 4 % 3 AS how FROM sg) SELECT pos AS id, CASE how WHEN 0 THEN greatest(0, st + dv) WHEN 1 THEN greatest(0, least(st + dv, en - 1)) ELSE st END AS start, CASE how WHEN 0 THEN greatest(0, st + dv) + en - st WHEN 2 THEN greatest(st + 1, en + dv) ELSE en END AS \"end\" FROM m")
def _(s, d):
    how = F.element_at(F.array(F.lit("move"), F.lit("left"), F.lit("right")), (F.floor(F.col("pos") / 4) % 3 + 1).cast("int"))
    start, end = E.drag_segment(F.col("start"), F.col("end"), F.col("pos") % 61 - 30, how)
    return _segments(s, d).select(F.col("pos").alias("id"), start.alias("start"), end.alias("end"))


@query("segment_edit", f"WITH {_SEG}, f AS (SELECT s_suppkey % 50 AS lane, s_suppkey * 7 % 300 - 20 AS frame FROM supplier), u AS (SELECT lane, pos, st, en, tx, 0 AS fresh FROM sg UNION ALL SELECT lane, NULL, greatest(0, frame), greatest(0, frame) + 22, '', 1 FROM f), r AS (SELECT *, row_number() OVER (PARTITION BY lane ORDER BY st, fresh, pos) - 1 AS i FROM u) SELECT lane, CASE WHEN i > 3 THEN i - 1 ELSE i END AS pos, st AS start, en AS \"end\", tx AS text FROM r WHERE i <> 3")
def _(s, d):
    k = F.col("s_suppkey")
    fresh = table(s, d, "supplier").select((k % 50).alias("lane"), (k * 7 % 300 - 20).alias("frame"))
    return E.delete_segment(E.add_segments(_segments(s, d), fresh, "lane"), "lane", 3)


@query("playback", "SELECT p_partkey AS id, CASE WHEN p_partkey % 9 + 1 < p_size % 9 + 1 THEN p_partkey % 9 + 1 WHEN p_partkey % 2 = 0 THEN 0 ELSE p_size % 9 END AS frame, p_partkey % 9 < p_size % 9 OR p_partkey % 2 = 0 AS playing FROM part")
def _(s, d):
    k = F.col("p_partkey")
    frame, playing = E.next_frame(k % 9, F.col("p_size") % 9 + 1, k % 2 == 0)
    return table(s, d, "part").select(k.alias("id"), frame.alias("frame"), playing.alias("playing"))


@query("marquee", "WITH m AS (SELECT s_suppkey AS id, s_suppkey % 40 / CAST(4 AS DOUBLE) AS x, s_suppkey % 27 / CAST(2 AS DOUBLE) AS y, (s_suppkey % 5 - 2) / CAST(2 AS DOUBLE) AS w, (s_suppkey % 3 - 1) / CAST(4 AS DOUBLE) AS h, s_nationkey * 5 AS cw FROM supplier), z AS (SELECT *, w <> 0 OR h <> 0 AS ok FROM m) SELECT id, " + ", ".join(f"CAST(CASE WHEN ok THEN floor({e} + 0.5) ELSE 0 END AS BIGINT) AS {n}" for n, e in (("x", "least(x, x + w)"), ("y", "least(y, y + h)"), ("w", "abs(w)"), ("h", "abs(h)"))) + ", CAST(CASE WHEN cw > 0 THEN floor(x - cw / CAST(2 AS DOUBLE) + 0.5) ELSE 0 END AS BIGINT) AS dx, CAST(CASE WHEN cw > 0 THEN floor(y - cw / CAST(2 AS DOUBLE) + 0.5) ELSE 0 END AS BIGINT) AS dy FROM z")
def _(s, d):
    k = F.col("s_suppkey")
    x, y, cw = k % 40 / 4, k % 27 / 2, F.col("s_nationkey") * 5
    return table(s, d, "supplier").select(k.alias("id"), *E.marquee(x, y, (k % 5 - 2) / 2, (k % 3 - 1) / 4), *E.from_centre(x, y, cw, cw))


@query("layer_state", "SELECT n_regionkey AS grp, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS pos, CAST(n_nationkey AS VARCHAR) AS id, n_name || ' \"x\"' AS name, CASE WHEN n_nationkey % 3 = 0 THEN 'ref' ELSE 'normal' END AS kind, CASE WHEN n_nationkey % 4 = 0 THEN 'forge' ELSE 'user' END AS source, n_nationkey % 2 = 0 AS visible, round(n_nationkey / CAST(25 AS DOUBLE), 6) AS opacity, 'multiply' AS blend, n_nationkey % 5 = 0 AS locked FROM nation")
def _(s, d):
    k = F.col("n_nationkey")
    cols = {"id": k.cast("string"), "name": F.concat("n_name", F.lit(' "x"')), "kind": F.when(k % 3 == 0, "ref"), "source": F.when(k % 4 == 0, "forge").otherwise(""), "visible": k % 2 == 0, "opacity": k / 25, "blend": F.lit("multiply"), "locked": k % 5 == 0}
    layers = table(s, d, "nation").select(F.col("n_regionkey").alias("grp"), k.alias("pos"), *[v.alias(n) for n, v in cols.items()])
    return E.restore_layers(E.save_layers(layers, "grp"), "grp")


@query("first_existing", "WITH f AS (SELECT 'a/' || s_suppkey * 3 AS p FROM supplier UNION SELECT 'b/' || s_suppkey * 2 FROM supplier) SELECT c_custkey AS id, CASE WHEN 'a/' || c_custkey IN (SELECT p FROM f) THEN 'a/' || c_custkey WHEN 'b/' || c_custkey IN (SELECT p FROM f) THEN 'b/' || c_custkey END AS path FROM customer")
def _(s, d):
    sup = table(s, d, "supplier")
    path = lambda top, c: F.concat(F.lit(top), c.cast("string"))
    files = sup.select(path("a/", F.col("s_suppkey") * 3).alias("path")).union(sup.select(path("b/", F.col("s_suppkey") * 2)))
    wanted = table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.posexplode(F.array(path("a/", F.col("c_custkey")), path("b/", F.col("c_custkey")))).alias("rank", "path"))
    return E.first_existing(wanted, files, "id")
