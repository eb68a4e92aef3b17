"""Fractional lattices and k-means on made-up art with known answers."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.operators import grid as G
from framelake.operators import palette as P


def art(spark, pitch, phase, side, seed=0):
    """Cells of flat random colours on a lattice."""
    at = np.floor((np.arange(side) + 0.5 - phase) / pitch).astype(int)
    at -= at.min()
    cells = np.random.default_rng(seed).integers(0, 256, (at.max() + 1, at.max() + 1, 3))
    rows = [(1, 0, y, x, *map(int, cells[at[y], at[x]])) for y in range(side) for x in range(side)]
    return spark.createDataFrame(rows, "run_id int, frame int, y int, x int, r int, g int, b int")


def test_fit_recovers_pitch_and_phase(spark):
    start = spark.createDataFrame([(1, 0, 8.55, 6.6, 8.55, 6.6)], "run_id int, frame int, pitch_x double, phase_x double, pitch_y double, phase_y double")
    got = G.fit_lattice(art(spark, 8.585, 7.3, 180), start, 180, 180).first()
    assert abs(got.pitch_x - 8.585) < 0.03 and abs(got.pitch_y - 8.585) < 0.03
    assert abs(got.phase_x - 7.3) < 0.6 and got.std < 12  # at the start 40 and more; one sweep, x before y
    # 8 cells of 7.5 fill the side: the pitch becomes exact, the phase 0
    start = start.withColumns({c: start[c] * 0 + v for c, v in (("pitch_x", 7.53), ("pitch_y", 7.54), ("phase_x", 0.2), ("phase_y", 0.2))})
    got = G.fit_lattice(art(spark, 7.5, 0.0, 60), start, 60, 60).first()
    assert (got.pitch_x, got.pitch_y) == (7.5, 7.5) and abs(got.phase_x) <= 0.25


@pytest.mark.parametrize("pitch, phase", [(8.585, 7.3), (7.3, 0.0)])
def test_find_lattice(spark, pitch, phase):
    got = G.find_lattice(art(spark, pitch, phase, 200, 3), 9.0 if pitch > 8 else 8.0, 200, 200, least_peaks=10).collect()
    assert len(got) == 1 and abs(got[0].pitch_x - pitch) < 0.05 and got[0].recall > 0.9


def test_weights_hide_the_backdrop(spark):
    rng, pitch = np.random.default_rng(5), 200 / 23
    px = art(spark, pitch, 0.0, 200, 3).toPandas()
    out = px.y >= 120
    px.loc[out, ["r", "g", "b"]] = rng.integers(0, 256, (int(out.sum()), 3)).astype("int32")
    px = spark.createDataFrame(px.assign(a=(~out).astype(float)))
    got = G.find_lattice(px, 9.0, 200, 200, least_peaks=8, weight=F.col("a")).collect()
    assert len(got) == 1 and abs(got[0].pitch_x - pitch) < 0.05 and abs(got[0].pitch_y - pitch) < 0.05
    assert G.find_lattice(px, 9.0, 200, 200, least_peaks=8).count() == 0


def test_no_lattice_in_noise(spark):
    rng = np.random.default_rng(1)
    rows = [(1, 0, y, x, *map(int, rng.integers(0, 256, 3))) for y in range(96) for x in range(96)]
    px = spark.createDataFrame(rows, "run_id int, frame int, y int, x int, r int, g int, b int")
    assert G.find_lattice(px, 8.0, 96, 96, least_peaks=8).count() == 0


@pytest.mark.parametrize("space", ["rgb", "lab"])
def test_kmeans_finds_separate_groups(spark, space):
    rng = np.random.default_rng(2)
    centres = [(20, 20, 20), (230, 40, 40), (40, 220, 60), (240, 240, 240)]
    rows = [(1, 0, i, 0, *map(int, np.clip(np.array(c) + rng.integers(-4, 5, 3), 0, 255))) for c in centres for i in range(50)]
    px = spark.createDataFrame(rows, "run_id int, frame int, y int, x int, r int, g int, b int")
    got = sorted((x.r, x.g, x.b) for x in P.kmeans(px, 4, 24, space, 1e-3).collect())
    for a, b in zip(got, sorted(centres), strict=True):
        assert np.abs(np.array(a) - np.array(b)).max() < 6
    assert P.kmeans(px.where("y < 0"), 4, 3, space).count() == 0
