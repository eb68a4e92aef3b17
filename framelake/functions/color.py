"""Colour functions on columns, all inside code generation.

Channels are numbers from 0 to 255. Every function takes and returns columns.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

RGB = Sequence[Column]

# sRGB, D65 and CIELAB.
TO_XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
FROM_XYZ = ((3.2404542, -1.5371385, -0.4985314), (-0.9692660, 1.8760108, 0.0415560), (0.0556434, -0.2040259, 1.0572252))
WHITE = (0.95047, 1.0, 1.08883)
EPS, KAPPA = 216.0 / 24389.0, 24389.0 / 27.0


def d(c: Column | float) -> Column:
    return (c if isinstance(c, Column) else F.lit(c)).cast("double")


def to_byte(v: Column) -> Column:
    """0..1 to 0..255, rounded half to even."""
    return F.rint(F.least(F.greatest(d(v), d(0)), d(1)) * 255).cast("int")


def to_unit(v: Column) -> Column:
    return d(v) / 255


def luminance(c: RGB) -> Column:
    return 0.299 * d(c[0]) + 0.587 * d(c[1]) + 0.114 * d(c[2])


def lab(c: RGB) -> tuple[Column, Column, Column]:
    lin = []
    for v in c:
        u = d(v) / 255
        lin.append(F.when(u <= 0.04045, u / 12.92).otherwise(F.pow((u + 0.055) / 1.055, 2.4)))
    f = []
    for row, white in zip(TO_XYZ, WHITE, strict=True):
        t = (row[0] * lin[0] + row[1] * lin[1] + row[2] * lin[2]) / white
        f.append(F.when(t > EPS, F.cbrt(t)).otherwise((KAPPA * t + 16) / 116))
    return 116 * f[1] - 16, 500 * (f[0] - f[1]), 200 * (f[1] - f[2])


def rgb_from_lab(c: RGB) -> tuple[Column, Column, Column]:
    fy = (d(c[0]) + 16) / 116
    fx, fz = fy + d(c[1]) / 500, fy - d(c[2]) / 200
    cube = lambda v: F.when(v * v * v > EPS, v * v * v).otherwise((116 * v - 16) / KAPPA)
    y = F.when(d(c[0]) > KAPPA * EPS, fy * fy * fy).otherwise(d(c[0]) / KAPPA)
    xyz = cube(fx) * WHITE[0], y, cube(fz) * WHITE[2]
    out = []
    for row in FROM_XYZ:
        v = row[0] * xyz[0] + row[1] * xyz[1] + row[2] * xyz[2]
        s = F.when(v <= 0.0031308, 12.92 * v).otherwise(1.055 * F.pow(F.greatest(v, d(0)), 1 / 2.4) - 0.055)
        out.append(F.least(F.greatest(s, d(0)), d(1)) * 255)
    return tuple(out)


def redmean2(a: RGB, b: RGB) -> Column:
    """Squared redmean distance."""
    mean = (d(a[0]) + d(b[0])) / 2
    dr, dg, db = (d(x) - d(y) for x, y in zip(a, b, strict=True))
    return (2 + mean / 256) * dr * dr + 4 * dg * dg + (2 + (255 - mean) / 256) * db * db


def euclid2(a: RGB, b: RGB) -> Column:
    return reduce(lambda s, t: s + t, [(d(x) - d(y)) * (d(x) - d(y)) for x, y in zip(a, b, strict=True)])


def max_diff(a: RGB, b: RGB) -> Column:
    steps = [F.abs(x - y) for x, y in zip(a, b, strict=True)]
    return F.greatest(*steps) if len(steps) > 1 else steps[0]


def hsv(c: RGB) -> tuple[Column, Column, Column]:
    """Hue in [0, 1), saturation, value; of equal largest channels the last names the hue."""
    r, g, b = (d(v) / 255 for v in c)
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    span = top - low
    safe = F.greatest(span, d(1e-9))
    h = F.when(top == b, (r - g) / safe + 4).when(top == g, (b - r) / safe + 2).otherwise(F.pmod((g - b) / safe, d(6)))
    return F.when(span > 1e-6, h / 6).otherwise(d(0)), F.when(top > 1e-6, span / F.greatest(top, d(1e-6))).otherwise(d(0)), top


def rgb_from_hsv(c: RGB) -> tuple[Column, Column, Column]:
    h, s, v = (d(x) for x in c)
    i = F.pmod(F.floor(h * 6), F.lit(6))
    f = h * 6 - F.floor(h * 6)
    p, q, t = v * (1 - s), v * (1 - f * s), v * (1 - (1 - f) * s)
    pick = lambda *xs: reduce(lambda w, k: w.when(i == k, xs[k]), range(1, 6), F.when(i == 0, xs[0])) * 255
    return pick(v, q, p, p, t, v), pick(t, v, v, q, p, p), pick(p, p, t, v, v, q)


def hcl(c: RGB) -> tuple[Column, Column, Column]:
    """Hexcone hue in degrees (0 for grey), chroma, luminance; of equal largest channels the first names the hue."""
    r, g, b = (d(v) for v in c)
    top = F.greatest(r, g, b)
    chroma = top - F.least(r, g, b)
    some = F.when(chroma > 1e-6, chroma).otherwise(d(1))
    h = F.when(top == r, F.pmod(60 * ((g - b) / some), d(360))).when(top == g, 60 * ((b - r) / some) + 120).otherwise(60 * ((r - g) / some) + 240)
    return F.when(chroma > 1e-6, h).otherwise(d(0)), chroma, luminance(c)


def hue_lerp(h: Column, target: float, amount: Column | float) -> Column:
    """Along the shorter arc, hue in [0, 1)."""
    step = F.pmod(d(target) - d(h) + 0.5, d(1)) - 0.5
    return F.pmod(d(h) + step * d(amount), d(1))


def hue_distance(a: Column, b: Column) -> Column:
    """Degrees between two hues, at most 180."""
    gap = F.abs(d(a) - d(b))
    return F.least(gap, 360 - gap)


def hex_of(c: RGB) -> Column:
    return F.format_string("#%02X%02X%02X", *[v.cast("int") for v in c])


def rgb_of_hex(h: Column) -> tuple[Column, Column, Column]:
    bare = F.regexp_replace(h, "^#+", "")
    return tuple(F.conv(F.substring(bare, i, 2), 16, 10).cast("int") for i in (1, 3, 5))


def packed(c: RGB) -> Column:
    """One number a colour; 0 is black."""
    return c[0].cast("long") * 65536 + c[1] * 256 + c[2]


def dither(c: RGB, y: Column, x: Column, matrix: list[list[float]], strength: float) -> tuple[Column, ...]:
    """Ordered dithering: channels moved by at most 48 * strength, clipped."""
    n = len(matrix)
    t = F.element_at(F.array(*[F.lit(float(v)) for row in matrix for v in row]), (F.pmod(y, F.lit(n)) * n + F.pmod(x, F.lit(n)) + 1).cast("int"))
    return tuple(F.least(F.greatest(d(v) + (t - 0.5) * (96.0 * strength), d(0)), d(255)) for v in c)


def band_multipliers(bands: int, ambient: float) -> list[float]:
    # Where the bands lie between ambient and full light.
    at = {1: (1.0,), 2: (0.4, 1.0), 3: (0.0, 0.65, 1.0), 4: (0.0, 0.45, 0.75, 1.0)}[min(max(bands, 1), 4)]
    return [ambient + (1 - ambient) * t for t in at] if bands > 1 else [1.0]


def band_of_ratio(ratio: Column, bands: int, shadow: float, highlight: float) -> Column:
    if bands <= 1:
        return F.lit(0)
    # Four bands split the middle at 33 and 66 hundredths.
    cuts = {2: [shadow], 3: [shadow, highlight]}.get(bands, [shadow, shadow + (highlight - shadow) * 0.33, shadow + (highlight - shadow) * 0.66])
    return reduce(lambda s, t: s + t, [(ratio >= t).cast("int") for t in cuts])
