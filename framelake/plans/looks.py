"""Queries on composite looks; ``tests/test_composites.py`` holds their properties."""

from __future__ import annotations

from framelake.operators import composites as K
from framelake.plans.base import query
from framelake.sources.palettes import palette
from framelake.sources.tables import px

H = W = 8


@query("quantise_look")
def _(s, d):
    return K.quantise(px(s, d, alpha=True), K.Quantise(dither=4, strength=0.3, despeckle=1), H, W)


@query("cel_look")
def _(s, d):
    return K.cel_shade(px(s, d, alpha=True), K.Cel(palette="GAMEBOY"), H, W)


@query("match_look")
def _(s, d):
    return K.match_reference(px(s, d, alpha=True), palette(s, "PICO-8").drop("palette"), K.Match(black=0), H, W)


@query("key_look")
def _(s, d):
    return K.chroma_key(px(s, d), K.Key(keys=((120, 130, 120),), tolerance=0.1, share=10.0), H, W)
