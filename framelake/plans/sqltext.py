"""SQL text shared by the oracles (DuckDB)."""

from __future__ import annotations

from framelake.sources.palettes import palette_sql


def channel(at: str) -> str:
    return f"CAST(greatest(0, least(255, floor((CAST(embedding[{at} + 1] AS DOUBLE) + 0.5) * 255))) AS BIGINT)"


PX = f"""px AS (
  SELECT vec_id // 20 AS run_id, vec_id % 20 AS frame, p // 8 AS y, p % 8 AS x,
    {channel('p')} AS r, {channel('((p + 21) % 64)')} AS g, {channel('((p + 42) % 64)')} AS b,
    CASE WHEN CAST(embedding[p + 1] AS DOUBLE) > -0.02 THEN 1.0 ELSE 0.0 END AS a
  FROM embeddings CROSS JOIN (SELECT unnest(range(64)) AS p))"""

SERIES = """series AS (
  SELECT user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, value, event_type AS state
  FROM events)"""


def pal(name: str, alias: str = "pal") -> str:
    return f"{alias} AS (SELECT k, r AS pr, g AS pg, b AS pb FROM ({palette_sql(name)}))"


def lin(c: str) -> str:
    return f"(CASE WHEN {c} / 255.0 <= 0.04045 THEN {c} / 255.0 / 12.92 ELSE pow(({c} / 255.0 + 0.055) / 1.055, 2.4) END)"


def lab_cte(source: str, name: str, r: str = "r", g: str = "g", b: str = "b", keep: str = "*") -> str:
    """CTEs ``name``: the columns of ``source`` and L, A, B."""
    e, k = "CAST(216.0 AS DOUBLE) / 24389.0", "(CAST(24389.0 AS DOUBLE) / 27.0)"
    f = lambda t: f"CASE WHEN {t} > {e} THEN cbrt({t}) ELSE ({k} * {t} + 16.0) / 116.0 END"
    c = [f"CAST({x} AS DOUBLE)" for x in (r, g, b)]
    return f"""{name}_1 AS (SELECT {keep}, {lin(c[0])} AS l1, {lin(c[1])} AS l2, {lin(c[2])} AS l3 FROM {source}),
{name}_2 AS (SELECT *, (0.4124564 * l1 + 0.3575761 * l2 + 0.1804375 * l3) / 0.95047 AS t1,
  0.2126729 * l1 + 0.7151522 * l2 + 0.0721750 * l3 AS t2, (0.0193339 * l1 + 0.1191920 * l2 + 0.9503041 * l3) / 1.08883 AS t3 FROM {name}_1),
{name}_3 AS (SELECT *, {f('t1')} AS f1, {f('t2')} AS f2, {f('t3')} AS f3 FROM {name}_2),
{name} AS (SELECT * EXCLUDE (l1, l2, l3, t1, t2, t3, f1, f2, f3), 116.0 * f2 - 16.0 AS L, 500.0 * (f1 - f2) AS A, 200.0 * (f2 - f3) AS B FROM {name}_3)"""


def redmean2(a: tuple[str, str, str], b: tuple[str, str, str]) -> str:
    m = f"(({a[0]} + {b[0]}) / CAST(2.0 AS DOUBLE))"
    return f"((2 + {m} / 256.0) * power({a[0]} - {b[0]}, 2) + 4.0 * power({a[1]} - {b[1]}, 2) + (2 + (255.0 - {m}) / 256.0) * power({a[2]} - {b[2]}, 2))"


LUM = "(CAST(0.299 AS DOUBLE) * r + CAST(0.587 AS DOUBLE) * g + CAST(0.114 AS DOUBLE) * b)"


def hcl(r: str = "r", g: str = "g", b: str = "b", as_: tuple[str, str, str] = ("h", "c", "l")) -> str:
    """Select list of hue, chroma and luminance."""
    mx, ch = f"greatest({r}, {g}, {b})", f"(greatest({r}, {g}, {b}) - least({r}, {g}, {b}))"
    deg = lambda e: f"CAST(60.0 AS DOUBLE) * ({e}) / {ch}"
    wrap = f"({deg(f'{g} - {b}')} - 360.0 * floor(({deg(f'{g} - {b}')}) / 360.0))"
    hue = f"CASE WHEN {ch} = 0 THEN CAST(0 AS DOUBLE) WHEN {mx} = {r} THEN {wrap} WHEN {mx} = {g} THEN {deg(f'{b} - {r}')} + 120 ELSE {deg(f'{r} - {g}')} + 240 END"
    return f"{hue} AS {as_[0]}, CAST({ch} AS DOUBLE) AS {as_[1]}, CAST(0.299 AS DOUBLE) * {r} + CAST(0.587 AS DOUBLE) * {g} + CAST(0.114 AS DOUBLE) * {b} AS {as_[2]}"
