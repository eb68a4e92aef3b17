"""Queries on temporal operators. Series come from events, pixels from embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framelake.operators import frames as fr
from framelake.operators import temporal as T
from framelake.plans.base import query
from framelake.plans.sqltext import PX, SERIES, pal
from framelake.sources.palettes import palette
from framelake.sources.tables import px, series

K = "run_id, frame, y, x"
KEY = ["run_id", "frame", "y", "x"]
RGB = ["r", "g", "b"]
CELL = ["run_id", "y", "x"]
W = "WINDOW w AS (PARTITION BY run_id, y, x ORDER BY frame)"


def _mid(c: str, ends: bool) -> str:
    p, n = (f"coalesce(lag({c}) OVER w, {c})", f"coalesce(lead({c}) OVER w, {c})") if ends else (f"lag({c}) OVER w", f"lead({c}) OVER w")
    return f"({p} + {n} + {c} - greatest({p}, {n}, {c}) - least({p}, {n}, {c}))"


@query("median3", f"WITH {PX} SELECT {K}, {', '.join(f'{_mid(c, True)} AS {c}' for c in RGB)} FROM px {W}")
def _(s, d):
    return T.median3(px(s, d), RGB, CELL).select(*KEY, *RGB)


@query("median3_inner", f"WITH {PX} SELECT {K}, {', '.join(f'CASE WHEN lag(a) OVER w > 0.5 AND a > 0.5 AND lead(a) OVER w > 0.5 THEN {_mid(c, False)} ELSE {c} END AS {c}' for c in RGB)} FROM px {W}")
def _(s, d):
    return T.median3_inner(px(s, d, alpha=True), CELL).select(*KEY, *RGB)


@query("matte_vote3", f"WITH {PX} SELECT {K}, sum(CASE WHEN a > 0.5 THEN 1 ELSE 0 END) OVER (PARTITION BY run_id, y, x ORDER BY frame ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) >= 2 AS voted FROM px")
def _(s, d):
    return T.vote3(px(s, d, alpha=True), F.col("a") > 0.5, CELL).select(*KEY, "voted")


@query("guarded_vote", f"WITH {PX}, v AS (SELECT {K}, sum(CASE WHEN a > 0.5 THEN 1 ELSE 0 END) OVER (PARTITION BY run_id, y, x ORDER BY frame ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) >= 2 AS v, a > 0.5 AS f, r > 150 AS t, g > 150 AS s FROM px) SELECT {K}, (v AND NOT s) OR (f AND (t OR s)) AS keyed FROM v")
def _(s, d):
    rows = T.vote3(px(s, d, alpha=True), F.col("a") > 0.5, CELL)
    rows = rows.withColumns({"f": F.col("a") > 0.5, "t": F.col("r") > 150, "s": F.col("g") > 150})
    return T.guarded_vote(rows, "voted", "f", "t", "s").select(*KEY, "keyed")


@query("frame_motion", f"WITH {PX} SELECT {K}, greatest(abs(r - lag(r) OVER w), abs(g - lag(g) OVER w), abs(b - lag(b) OVER w)) AS motion FROM px {W} QUALIFY lag(r) OVER w IS NOT NULL")
def _(s, d):
    return T.motion(px(s, d)).where("motion IS NOT NULL").select(*KEY, "motion")


@query("static_cells", f"WITH {PX}, m AS (SELECT {K}, greatest(abs(r - lag(r) OVER w), abs(g - lag(g) OVER w), abs(b - lag(b) OVER w)) AS m FROM px {W}), s AS (SELECT run_id, y, x, median(m) < 50 AS st FROM m WHERE m IS NOT NULL GROUP BY ALL), o AS (SELECT * FROM (VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) AS o(dy, dx)) SELECT run_id, (y + dy + 8) % 8 AS y, (x + dx + 8) % 8 AS x, bool_and(st) AS static FROM s CROSS JOIN o GROUP BY ALL")
def _(s, d):
    return T.static_cells(px(s, d), 50.0, 8, 8)


@query("noise_blend", f"WITH {SERIES} SELECT key, pos, round(CASE WHEN pos = 0 THEN value ELSE sqrt(CAST(1 - 0.3 * 0.3 AS DOUBLE)) * value + 0.3 * first_value(value) OVER (PARTITION BY key ORDER BY pos) END, 6) AS value FROM series")
def _(s, d):
    return T.noise_blend(series(s, d), "value", 0.3, ["key"], "pos").select("key", "pos", "value")


@query("loop_ramp", f"WITH {SERIES}, t AS (SELECT *, 0.4 * power((pos / CAST(max(pos) OVER (PARTITION BY key) AS DOUBLE)), 2) AS w, first_value(value) OVER (PARTITION BY key ORDER BY pos) AS x0 FROM series) SELECT key, pos, round(sqrt(1 - w * w) * value + w * x0, 6) AS value FROM t")
def _(s, d):
    return T.loop_ramp(series(s, d), "value", 0.4, ["key"], "pos").select("key", "pos", "value")


@query("despike", f"""WITH RECURSIVE {SERIES}, n AS (SELECT key, pos, value, lead(value) OVER (PARTITION BY key ORDER BY pos) AS nx FROM series),
f AS (SELECT key, pos, value FROM n WHERE pos = 0 UNION ALL SELECT n.key, n.pos, CASE WHEN nx IS NOT NULL AND abs(n.value - f.value) > 100 AND abs(nx - f.value) <= 100 THEN f.value ELSE n.value END FROM f JOIN n ON n.key = f.key AND n.pos = f.pos + 1) SELECT key, pos, round(value, 6) AS value FROM f""")
def _(s, d):
    return T.despike(series(s, d), ["value"], 100.0, ["key"], "pos")


_DS = f"""n AS (SELECT *, lead(r) OVER w AS nr, lead(g) OVER w AS ng, lead(b) OVER w AS nb, lead(a) OVER w AS na FROM px {W}),
f AS (SELECT {K}, r, g, b FROM n WHERE frame = 0 UNION ALL SELECT n.run_id, n.frame, n.y, n.x, CASE WHEN z THEN f.r ELSE n.r END, CASE WHEN z THEN f.g ELSE n.g END, CASE WHEN z THEN f.b ELSE n.b END FROM f JOIN n ON n.run_id = f.run_id AND n.y = f.y AND n.x = f.x AND n.frame = f.frame + 1,
 LATERAL (SELECT nr IS NOT NULL AND greatest(abs(n.r - f.r), abs(n.g - f.g), abs(n.b - f.b)) > 60 AND greatest(abs(nr - f.r), abs(ng - f.g), abs(nb - f.b)) <= 60 AS z))"""


@query("despike_pixels", f"WITH RECURSIVE {PX}, {_DS} SELECT {K}, r, g, b FROM f")
def _(s, d):
    return T.despike(px(s, d), RGB, 60.0, CELL).select(*KEY, *RGB)


@query("despike_matte", f"""WITH RECURSIVE {PX}, {_DS}, j AS (SELECT {K}, f.r, f.g, f.b, n.a, n.na FROM f JOIN n USING ({K})),
m AS (SELECT {K}, r, g, b, a FROM j WHERE frame = 0 UNION ALL SELECT j.run_id, j.frame, j.y, j.x, CASE WHEN z AND m.a > 0.5 AND j.a <= 0.5 THEN m.r ELSE j.r END, CASE WHEN z AND m.a > 0.5 AND j.a <= 0.5 THEN m.g ELSE j.g END, CASE WHEN z AND m.a > 0.5 AND j.a <= 0.5 THEN m.b ELSE j.b END, CASE WHEN z THEN m.a ELSE j.a END
 FROM m JOIN j ON j.run_id = m.run_id AND j.y = m.y AND j.x = m.x AND j.frame = m.frame + 1, LATERAL (SELECT na IS NOT NULL AND (j.a > 0.5) <> (m.a > 0.5) AND (na > 0.5) = (m.a > 0.5) AS z)) SELECT {K}, r, g, b, CAST(a AS DOUBLE) AS a FROM m""")
def _(s, d):
    return T.despike_matte(px(s, d, alpha=True), 60.0).select(*KEY, *RGB, "a")


@query("minrun", f"""WITH RECURSIVE {SERIES}, l AS (SELECT key, list(state ORDER BY pos) AS s FROM series GROUP BY 1),
p AS (SELECT unnest([2, 1, 2, 1]) AS w, generate_subscripts([2, 1, 2, 1], 1) AS ph), q AS (SELECT key, ph, w, t, row_number() OVER (PARTITION BY key ORDER BY ph, t) AS i FROM l CROSS JOIN p, LATERAL (SELECT unnest(range(1, len(s) - w)) AS t)),
f AS (SELECT key, CAST(0 AS BIGINT) AS i, s FROM l UNION ALL SELECT f.key, q.i, CASE WHEN q.w = 2 AND s[t + 1] = s[t + 2] AND s[t + 1] <> s[t] AND s[t + 3] = s[t] THEN list_concat(list_concat(s[1:t], [s[t], s[t]]), s[t + 3:]) WHEN q.w = 1 AND s[t + 1] <> s[t] AND s[t + 2] = s[t] THEN list_concat(list_concat(s[1:t], [s[t]]), s[t + 2:]) ELSE s END FROM f JOIN q ON q.key = f.key AND q.i = f.i + 1),
e AS (SELECT key, s FROM f QUALIFY row_number() OVER (PARTITION BY key ORDER BY i DESC) = 1) SELECT key, unnest(s) AS state, generate_subscripts(s, 1) - 1 AS pos FROM e""")
def _(s, d):
    return T.minrun(series(s, d), "state", ["key"], "pos")


def _hyst(src: str, key: str, pos: str, cols: list[str], thr: float, commit: int, hold: int, name: str = "f") -> str:
    """Recursive CTE ``name`` with the committed columns."""
    keys = key.split(", ")
    diff = lambda p: "greatest(" + ", ".join([f"abs(s.{c} - f.{p}{c})" for c in cols] + ["0"]) + ")"
    on = " AND ".join(f"s.{k} = f.{k}" for k in keys)
    new = {c: f"CASE WHEN fire THEN s.{c} ELSE f.{c} END" for c in cols}
    cand = {c: f"CASE WHEN fire OR st THEN {new[c]} WHEN ma THEN f.c_{c} ELSE s.{c} END" for c in cols}
    q = f"""{name} AS (SELECT {key}, {pos}, {', '.join(cols)}, {', '.join(f'{c} AS c_{c}' for c in cols)}, 0 AS run, 0 AS stale FROM {src} WHERE {pos} = 0
UNION ALL SELECT {', '.join(f's.{k}' for k in keys)}, s.{pos}, {', '.join(new.values())}, {', '.join(cand.values())}, CASE WHEN fire OR st THEN 0 ELSE rn END, CASE WHEN fire OR st THEN 0 ELSE sl END
FROM {name} f JOIN {src} s ON {on} AND s.{pos} = f.{pos} + 1, LATERAL (SELECT {diff('')} <= {thr} AS st, {diff('c_')} <= {thr} AS ma), LATERAL (SELECT CASE WHEN ma THEN f.run + 1 ELSE 1 END AS rn, CASE WHEN st THEN 0 ELSE f.stale + 1 END AS sl), LATERAL (SELECT NOT st AND (rn >= {commit} OR sl >= {hold}) AS fire))"""
    return q


@query("hysteresis", f"WITH RECURSIVE {SERIES}, {_hyst('series', 'key', 'pos', ['value'], 100, 2, 3)} SELECT key, pos, round(value, 6) AS value FROM f")
def _(s, d):
    return T.hysteresis(series(s, d), ["value"], 100.0, 2, 3, ["key"], "pos")


@query("hysteresis_pixels", f"WITH RECURSIVE {PX}, {_hyst('px', 'run_id, y, x', 'frame', RGB, 40, 3, 4)} SELECT {K}, r, g, b FROM f")
def _(s, d):
    return T.hysteresis(px(s, d), RGB, 40.0, 3, 4, CELL).select(*KEY, *RGB)


_LOCK = "lk AS (SELECT run_id, y, x, frame, a > 0.5 AS lo, 0 AS run FROM px WHERE frame = 0 UNION ALL SELECT s.run_id, s.y, s.x, s.frame, CASE WHEN fire THEN s.a > 0.5 ELSE lk.lo END, CASE WHEN fire THEN 0 ELSE rn END FROM lk JOIN px s ON s.run_id = lk.run_id AND s.y = lk.y AND s.x = lk.x AND s.frame = lk.frame + 1, LATERAL (SELECT (s.a > 0.5) <> lk.lo AS dis), LATERAL (SELECT CASE WHEN dis THEN lk.run + 1 ELSE 0 END AS rn), LATERAL (SELECT dis AND rn >= {0} AS fire))"


@query("matte_lock", f"WITH RECURSIVE {PX}, {_LOCK.format(2)} SELECT {K}, lo AS locked FROM lk")
def _(s, d):
    return T.matte_lock(px(s, d, alpha=True).withColumn("f", F.col("a") > 0.5), "f", 2, CELL).select(*KEY, "locked")


@query("lockdown", f"""WITH RECURSIVE {PX}, {_hyst('px', 'run_id, y, x', 'frame', RGB, 40, 3, 4)}, {_LOCK.format(3)}, j AS (SELECT f.run_id, f.frame, f.y, f.x, f.r, f.g, f.b, lo, px.a > 0.5 AS raw FROM f JOIN lk USING (run_id, frame, y, x) JOIN px USING (run_id, frame, y, x)),
c AS (SELECT {K}, r, g, b, lo FROM j WHERE frame = 0 UNION ALL SELECT j.run_id, j.frame, j.y, j.x, CASE WHEN j.lo AND NOT j.raw THEN c.r ELSE j.r END, CASE WHEN j.lo AND NOT j.raw THEN c.g ELSE j.g END, CASE WHEN j.lo AND NOT j.raw THEN c.b ELSE j.b END, j.lo FROM c JOIN j ON j.run_id = c.run_id AND j.y = c.y AND j.x = c.x AND j.frame = c.frame + 1)
SELECT {K}, r, g, b, CASE WHEN lo THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS a FROM c""")
def _(s, d):
    return T.lockdown(px(s, d, alpha=True), 40.0, 3, 4).select(*KEY, *RGB, "a")


@query("sticky_labels", f"""WITH RECURSIVE {PX}, {pal('PICO-8')}, d AS (SELECT {K}, list(power(r - pr, 2) + power(g - pg, 2) + power(b - pb, 2) ORDER BY k) AS d FROM px CROSS JOIN pal GROUP BY ALL), n AS (SELECT *, list_position(d, list_min(d)) - 1 AS near FROM d),
f AS (SELECT {K}, CAST(near AS BIGINT) AS k FROM n WHERE frame = 0 UNION ALL SELECT n.run_id, n.frame, n.y, n.x, CASE WHEN d[f.k + 1] <= d[near + 1] * (1 + CAST(0.35 AS DOUBLE)) THEN f.k ELSE near END FROM f JOIN n ON n.run_id = f.run_id AND n.y = f.y AND n.x = f.x AND n.frame = f.frame + 1) SELECT {K}, k FROM f""")
def _(s, d):
    return T.sticky_labels(px(s, d), palette(s, "PICO-8").drop("palette"), 0.35).select(*KEY, "k")


@query("band_hysteresis", f"""WITH RECURSIVE {SERIES}, v AS (SELECT key, pos, value / 250 AS v FROM series), b AS (SELECT *, CAST(CASE WHEN v >= 1.2 THEN 2 WHEN v >= 0.6 THEN 1 ELSE 0 END AS BIGINT) AS b, abs(v - CAST(0.6 AS DOUBLE)) < 0.1 OR abs(v - CAST(1.2 AS DOUBLE)) < 0.1 AS near FROM v),
f AS (SELECT key, pos, b AS band FROM b WHERE pos = 0 UNION ALL SELECT b.key, b.pos, CASE WHEN near THEN f.band ELSE b.b END FROM f JOIN b ON b.key = f.key AND b.pos = f.pos + 1) SELECT key, pos, band FROM f""")
def _(s, d):
    return T.band_hysteresis(series(s, d).withColumn("v", F.col("value") / 250), "v", 3, 0.6, 1.2, 0.1, [0.6, 1.2], ["key"], "pos")


DEDUP_AT = 0.42
_DEDUP = f"""WITH RECURSIVE {SERIES}, f AS (SELECT key, pos, value, value AS anchor, true AS kept FROM series WHERE pos = 0 UNION ALL SELECT s.key, s.pos, s.value, CASE WHEN abs(s.value - f.anchor) > 150 THEN s.value ELSE f.anchor END, abs(s.value - f.anchor) > 150 FROM f JOIN series s ON s.key = f.key AND s.pos = f.pos + 1),
n AS (SELECT key, count(*) AS n FROM series GROUP BY 1), o AS (SELECT key, pos, value, coalesce(lead(pos) OVER (PARTITION BY key ORDER BY pos), n) - pos AS duration FROM f JOIN n USING (key) WHERE kept)"""


@query("frame_dedup", f"{_DEDUP} SELECT key, pos, round(value, 6) AS value, duration FROM o")
def _(s, d):
    return T.keep_changes(series(s, d), "value", 150.0, ["key"], "pos")


@query("durations", f"{_DEDUP} SELECT key, count(*) AS kept, CAST(sum(duration) AS BIGINT) AS total, CAST(max(greatest(1, round_even(1000 * duration / CAST(12 AS DOUBLE), 0))) AS BIGINT) AS longest_ms FROM o GROUP BY 1")
def _(s, d):
    rows = T.keep_changes(series(s, d), "value", 150.0, ["key"], "pos")
    ms = F.greatest(F.lit(1), F.rint(1000 * F.col("duration") / 12.0).cast("int"))
    return rows.groupBy("key").agg(F.count(F.lit(1)).alias("kept"), F.sum("duration").alias("total"), F.max(ms).alias("longest_ms"))


_ERR = "coalesce(avg(CASE WHEN p.a > 0.5 OR q.a > 0.5 THEN (abs(p.r * p.a - q.r * q.a) + abs(p.g * p.a - q.g * q.a) + abs(p.b * p.a - q.b * q.a)) / CAST(765 AS DOUBLE) + abs(p.a - q.a) END) / 2, 0)"


@query("frame_dedup_pixels", f"""WITH RECURSIVE {PX}, e AS (SELECT p.run_id, p.frame AS fa, q.frame AS fb, {_ERR} AS err FROM px p JOIN px q ON p.run_id = q.run_id AND p.y = q.y AND p.x = q.x AND q.frame > p.frame GROUP BY 1, 2, 3), m AS (SELECT run_id, count(DISTINCT frame) AS n FROM px GROUP BY 1),
f AS (SELECT run_id, CAST(0 AS BIGINT) AS frame, CAST(0 AS BIGINT) AS anchor, true AS kept FROM m UNION ALL SELECT f.run_id, e.fb, CASE WHEN e.err > {DEDUP_AT} THEN e.fb ELSE f.anchor END, e.err > {DEDUP_AT} FROM f JOIN e ON e.run_id = f.run_id AND e.fa = f.anchor AND e.fb = f.frame + 1)
SELECT run_id, frame, coalesce(lead(frame) OVER (PARTITION BY run_id ORDER BY frame), n) - frame AS duration FROM f JOIN m USING (run_id) WHERE kept""")
def _(s, d):
    return T.dedup_frames(px(s, d, alpha=True), DEDUP_AT)


@query("frame_error", f"WITH {PX} SELECT p.run_id, p.frame, round(coalesce(avg(CASE WHEN p.a > 0.5 OR q.a > 0.5 THEN (abs(p.r * p.a - q.r * q.a) + abs(p.g * p.a - q.g * q.a) + abs(p.b * p.a - q.b * q.a)) / CAST(765 AS DOUBLE) + abs(p.a - q.a) END) / 2, 0), 6) AS err FROM px p JOIN px q ON p.run_id = q.run_id AND p.y = q.y AND p.x = q.x AND q.frame = p.frame + 1 GROUP BY 1, 2")
def _(s, d):
    p = px(s, d, alpha=True)
    after = p.select("run_id", (F.col("frame") - 1).alias("frame"), "y", "x", *[F.col(c).alias(f"o_{c}") for c in (*RGB, "a")])
    return T.frame_pair_error(p, after, ["run_id", "frame"])


@query("loop_trim", f"WITH {PX}, n AS (SELECT run_id, max(frame) + 1 AS n FROM px GROUP BY 1), e AS (SELECT p.run_id, p.frame, coalesce(avg(CASE WHEN p.a > 0.5 OR q.a > 0.5 THEN (abs(p.r * p.a - q.r * q.a) + abs(p.g * p.a - q.g * q.a) + abs(p.b * p.a - q.b * q.a)) / CAST(765 AS DOUBLE) + abs(p.a - q.a) END) / 2, 0) AS err FROM px p JOIN n USING (run_id) JOIN px q ON p.run_id = q.run_id AND p.y = q.y AND p.x = q.x AND q.frame = 0 WHERE p.frame >= greatest(1, floor(n * CAST(0.6 AS DOUBLE))) GROUP BY 1, 2), w AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY round(err, 9), frame) AS o FROM e) SELECT run_id, n, CASE WHEN n >= 3 AND err <= 0.26 THEN frame ELSE n END AS cut, round(err, 6) AS err FROM n JOIN w USING (run_id) WHERE o = 1")
def _(s, d):
    return T.loop_trim(px(s, d, alpha=True), 0.4, 0.26)


@query("pingpong", f"WITH {PX}, n AS (SELECT run_id, max(frame) + 1 AS n FROM px GROUP BY 1) SELECT {K}, r, g, b FROM px UNION ALL SELECT run_id, 2 * n - 2 - frame, y, x, r, g, b FROM px JOIN n USING (run_id) WHERE n >= 3 AND frame > 0 AND frame < n - 1")
def _(s, d):
    return fr.pingpong(px(s, d))


@query("cumulative_share", f"WITH {SERIES} SELECT key, pos, round(coalesce(sum(value) OVER (PARTITION BY key ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(value) OVER (PARTITION BY key), 6) AS before FROM series")
def _(s, d):
    w = Window.partitionBy("key")
    before = F.sum("value").over(w.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    return series(s, d).select("key", "pos", (F.coalesce(before, F.lit(0.0)) / F.sum("value").over(w)).alias("before"))


@query("phase_durations", "SELECT user_id AS key, event_id, CAST(epoch_us(lead(ts) OVER w) - epoch_us(ts) AS BIGINT) AS elapsed_us FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id) QUALIFY lead(ts) OVER w IS NOT NULL")
def _(s, d):
    from framelake.sources.tables import table

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = table(s, d, "events").select(F.col("user_id").alias("key"), "event_id", (F.lead(us).over(w) - us).alias("elapsed_us"))
    return rows.where("elapsed_us IS NOT NULL")
