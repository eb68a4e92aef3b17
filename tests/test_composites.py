"""Composite looks and sinks: properties that hold by construction."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from framelake.operators import composites as K
from framelake.operators import palette as P
from framelake.sources import sinks
from framelake.sources.palettes import colours, palette
from framelake.sources.tables import px

H = W = 8


@pytest.fixture(scope="module")
def clip(spark, sf):
    return px(spark, sf, alpha=True).where("run_id < 2").cache()


@pytest.fixture(scope="module")
def screen(spark):
    """A red square on green, with a green hole and a detached speck, three frames."""
    rows = []
    for f in range(3):
        for y in range(8):
            for x in range(8):
                red = 2 <= y <= 5 and 2 <= x <= 5 and (y, x) != (3, 3) or (y, x) == (0, 7)
                rows.append((0, f, y, x, *((200, 20, 20) if red else (0, 250, 0))))
    return spark.createDataFrame(rows, "run_id int, frame int, y int, x int, r int, g int, b int")


def opaque(df):
    return {(r.frame, r.y, r.x) for r in df.where("a > 0.5").collect()}


def test_chroma_key(screen):
    body = {(f, y, x) for f in range(3) for y in range(2, 6) for x in range(2, 6)} - {(f, 3, 3) for f in range(3)}
    speck = {(f, 0, 7) for f in range(3)}
    assert opaque(K.chroma_key(screen, K.Key(), H, W)) == body | speck
    assert opaque(K.chroma_key(screen, K.Key(share=20.0), H, W)) == body
    assert opaque(K.chroma_key(screen, K.Key(interior=False, share=20.0), H, W)) == body | {(f, 3, 3) for f in range(3)}


def test_quantise_uses_the_palette(clip):
    for c in (K.Quantise(dither=4, strength=0.3, despeckle=1), K.Quantise(palette="GAMEBOY", sticky=0.35, saturation=1.2, contrast=1.1), K.Quantise(palette="GAMEBOY", shrink=2, median=True, metric="rgb", sticky=0.2)):
        out = K.quantise(clip, c, H, W)
        assert {(r.r, r.g, r.b) for r in out.select("r", "g", "b").distinct().collect()} <= set(colours(c.palette))
        assert out.count() == clip.count() // c.shrink**2


def test_quantise_with_clusters(clip):
    out = K.quantise(clip, K.Quantise(clusters=6, iterations=2), H, W)
    assert 1 < out.select("r", "g", "b").distinct().count() <= 6


def test_cel_shade_uses_the_ramp(clip, spark):
    c = K.Cel(palette="GAMEBOY")
    ramp = {(r.k, r.band): (int(r.r), int(r.g), int(r.b)) for r in P.shade_ramp(palette(spark, "GAMEBOY").drop("palette"), 3, 0.35, 0.3).collect()}
    out = K.cel_shade(clip, K.Cel(palette="GAMEBOY", outline=False), H, W).collect()
    assert len(out) == clip.count() and all((r.r, r.g, r.b) == ramp[r.base, r.band] for r in out)
    assert K.cel_shade(clip, c, H, W).count() == len(out)


def test_match_reference(clip, spark):
    ref = palette(spark, "PICO-8").drop("palette")
    out = K.match_reference(clip, ref, K.Match(black=0), H, W)
    assert out.count() == clip.count()
    assert {(r.r, r.g, r.b) for r in out.select("r", "g", "b").distinct().collect()} <= set(colours("PICO-8"))


def test_auto_crop(screen):
    keyed = K.chroma_key(screen, K.Key(share=20.0), H, W)
    out = K.auto_crop(keyed, H, W, 1, 4)
    assert (out.agg(F.max("x")).first()[0], out.agg(F.max("y")).first()[0]) == (6, 7)
    assert K.auto_crop(keyed, H, W, 1, 4, union=True).count() == out.count()


def test_sinks(clip, spark, tmp_path):
    sinks.write_frames(sinks.assemble_rgba(clip), str(tmp_path / "f"))
    back = spark.read.parquet(str(tmp_path / "f"))
    assert back.count() == clip.count() and back.where("rgba.a NOT IN (0, 255)").count() == 0
    frames = clip.select("run_id", "frame").distinct().withColumn("duration", F.lit(2))
    sinks.write_manifests(frames, str(tmp_path / "m"), 12, "walk", 8, 8)
    assert sinks.read_manifests(spark, str(tmp_path / "m")).count() == frames.count()
    assert sinks.preview(clip, 4).select("frame").distinct().count() == 4
    names = spark.createDataFrame([("a_00001_.gif",), ("a_00002_.gif",), ("a_00004_.gif",), ("b_00003_.gif",)], "name string")
    assert [sinks.free_name(names, b) for b in "abc"] == ["a_00003_", "b_00001_", "c_00001_"]
