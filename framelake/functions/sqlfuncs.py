"""Column rules and palettes as functions that SQL text can call, temporary in the session."""

from __future__ import annotations

from pyspark.sql import SparkSession

from framelake.sources.palettes import PALETTES, colours

#: signature -> (type, expression); parameters are doubles or whole numbers, as in ``functions.color`` and ``operators.texts``.
SCALARS = {
    "fl_luminance(r DOUBLE, g DOUBLE, b DOUBLE)": ("DOUBLE", "0.299D * r + 0.587D * g + 0.114D * b"),
    "fl_max_diff(r1 DOUBLE, g1 DOUBLE, b1 DOUBLE, r2 DOUBLE, g2 DOUBLE, b2 DOUBLE)": ("DOUBLE", "greatest(abs(r1 - r2), abs(g1 - g2), abs(b1 - b2))"),
    "fl_redmean2(r1 DOUBLE, g1 DOUBLE, b1 DOUBLE, r2 DOUBLE, g2 DOUBLE, b2 DOUBLE)": (
        "DOUBLE",
        "(2D + (r1 + r2) / 2D / 256D) * (r1 - r2) * (r1 - r2) + 4D * (g1 - g2) * (g1 - g2) + (2D + (255D - (r1 + r2) / 2D) / 256D) * (b1 - b2) * (b1 - b2)",
    ),
    "fl_hex(r INT, g INT, b INT)": ("STRING", "format_string('#%02X%02X%02X', r, g, b)"),
    "fl_snap_frames(seconds DOUBLE)": ("INT", "greatest(5, CAST(rint(seconds * 24) AS INT)) + pmod(5 - greatest(5, CAST(rint(seconds * 24) AS INT)), 17)"),
}


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to the session, with ``fl_palette(name)``, a table (k, r, g, b); returns the signatures."""
    for signature, (kind, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {kind} RETURN {body}")
    rows = ", ".join(f"('{n}', {k}, {r}, {g}, {b})" for n in PALETTES for k, (r, g, b) in enumerate(colours(n)))
    table = "fl_palette(wanted STRING)"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {table} RETURNS TABLE (k INT, r INT, g INT, b INT) RETURN SELECT t.k, t.r, t.g, t.b FROM VALUES {rows} AS t(name, k, r, g, b) WHERE t.name = wanted")
    return [*SCALARS, table]
