"""Built-in palettes and dither matrices as small relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The built-in palettes, in order.
PALETTES = {
    "PICO-8": "000000 1D2B53 7E2553 008751 AB5236 5F574F C2C3C7 FFF1E8 FF004D FFA300 FFEC27 00E436 29ADFF 83769C FF77A8 FFCCAA",
    "GAMEBOY": "0F380F 306230 8BAC0F 9BBC0F",
    "SWEETIE-16": "1A1C2C 5D275D B13E53 EF7D57 FFCD75 A7F070 38B764 257179 29366F 3B5DC9 41A6F6 73EFF7 F4F4F4 94B0C2 566C86 333C57",
    "ENDESGA-32": "BE4A2F D77643 EAD4AA E4A672 B86F50 733E39 3E2731 A22633 E43B44 F77622 FEAE34 FEE761 63C74D 3E8948 265C42 193C3E "
    "124E89 0099DB 2CE8F5 FFFFFF C0CBDC 8B9BB4 5A6988 3A4466 262B44 181425 FF0044 68386C B55088 F6757A E8B796 C28569",
    "NES": "7C7C7C 0000FC 0000BC 4428BC 940084 A80020 A81000 881400 503000 007800 006800 005800 004058 000000 000000 000000 "
    "BCBCBC 0078F8 0058F8 6844FC D800CC E40058 F83800 E45C10 AC7C00 00B800 00A800 00A844 008888 000000 000000 000000 "
    "F8F8F8 3CBCFC 6888FC 9878F8 F878F8 F85898 F87858 FCA044 F8B800 B8F818 58D854 58F898 00E8D8 787878 000000 000000 "
    "FCFCFC A4E4FC B8B8F8 D8B8F8 F8B8F8 F8A4C0 F0D0B0 FCE0A8 F8D878 D8F878 B8F8B8 B8F8D8 00FCFC F8D8F8 000000 000000",
    "CGA-16": "000000 0000AA 00AA00 00AAAA AA0000 AA00AA AA5500 AAAAAA 555555 5555FF 55FF55 55FFFF FF5555 FF55FF FFFF55 FFFFFF",
    "1-BIT": "000000 FFFFFF",
}


def colours(name: str) -> list[tuple[int, int, int]]:
    return [tuple(int(h[i : i + 2], 16) for i in (0, 2, 4)) for h in PALETTES[name].split()]


def palette(spark: SparkSession, *names: str) -> DataFrame:
    """(palette, k, r, g, b) of the named palettes, or of all: at most 150 rows."""
    rows = ", ".join(f"('{n}', {k}, {r}, {g}, {b})" for n in names or PALETTES for k, (r, g, b) in enumerate(colours(n)))
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(palette, k, r, g, b)")


def palette_sql(*names: str) -> str:
    """The same rows as SQL text."""
    rows = ", ".join(f"('{n}', {k}, {r}, {g}, {b})" for n in names or PALETTES for k, (r, g, b) in enumerate(colours(n)))
    return "SELECT palette, " + ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in ("k", "r", "g", "b")) + f" FROM (VALUES {rows}) AS t(palette, k, r, g, b)"


def bayer(n: int) -> list[list[float]]:
    """The ordered-dither thresholds of side 2, 4 or 8, by doubling the matrix of half the side.

    Side 8 spreads the scaled matrix of side 4, so its thresholds stay under 0.11: kept for equal results.
    """
    spread = ((0, 2), (3, 1))
    if n == 2:
        return [[v / 4 for v in row] for row in spread]
    half = bayer(n // 2)
    if n == 4:
        return [[half[y % 2][x % 2] + spread[y // 2][x // 2] / 16 for x in range(4)] for y in range(4)]
    return [[(4 * half[y // 2][x // 2] + spread[y % 2][x % 2]) / 64 for x in range(8)] for y in range(8)]
