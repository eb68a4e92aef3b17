"""Properties and small hand-made cases."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.functions import color as C
from framelake.operators import frames as fr
from framelake.operators import graph as G
from framelake.operators import layout as L
from framelake.operators import palette as P
from framelake.operators import stencil as S
from framelake.operators import temporal as T
from framelake.operators import texts as X
from framelake.operators import timeline as TL
from framelake.plans.pipelines import Studio, preset, run_studio
from framelake.sources.palettes import PALETTES, bayer, colours, palette
from framelake.sources.tables import px


def series(spark, values, key=1):
    return spark.createDataFrame([(key, i, float(v)) for i, v in enumerate(values)], "key long, pos int, value double")


def values(df, col="value"):
    return [r[col] for r in df.orderBy("pos").collect()]


def test_palette_sizes_and_bayer():
    assert [len(colours(n)) for n in PALETTES] == [16, 4, 16, 32, 64, 16, 2]
    assert sorted(round(v * 16) for row in bayer(4) for v in row) == list(range(16))
    assert max(v for row in bayer(8) for v in row) < 0.11


def test_frames_snap_to_the_grid(spark):
    rows = spark.range(200).select((F.lit(0.1) * F.col("id")).alias("s"))
    got = rows.select(*[X.snap_frames(F.col("s"), h).alias(h) for h in ("up", "down", "nearest")]).collect()
    assert all(v % 17 == 5 for r in got for v in r)
    assert all(r["down"] <= r["nearest"] <= r["up"] for r in got)


def test_despike_needs_a_return(spark):
    assert values(T.despike(series(spark, [0, 9, 0, 9, 9, 0]), ["value"], 5.0, ["key"], "pos")) == [0, 0, 0, 9, 9, 0]


def test_despike_looks_at_its_corrected_past(spark):
    # after 9 is erased, the second 9 is judged against 0, and so is erased too
    assert values(T.despike(series(spark, [0, 9, 0, 9, 0]), ["value"], 5.0, ["key"], "pos")) == [0, 0, 0, 0, 0]


def test_short_series_pass(spark):
    s = series(spark, [1, 50])
    assert values(T.hysteresis(s, ["value"], 5.0, 2, 2, ["key"], "pos")) == [1, 50]
    assert values(T.despike(s, ["value"], 5.0, ["key"], "pos")) == [1, 50]


def test_hysteresis_commits_and_escapes(spark):
    s = series(spark, [0, 10, 10, 0, 10, 20, 30, 40])
    got = values(T.hysteresis(s, ["value"], 1.0, 2, 3, ["key"], "pos"))
    assert got == [0, 0, 10, 10, 10, 10, 10, 40]


def test_minrun_erases_pairs_then_singles(spark):
    s = spark.createDataFrame([(1, i, c) for i, c in enumerate("aabbaacaa")], "key int, pos int, state string")
    assert "".join(values(T.minrun(s, "state", ["key"], "pos"), "state")) == "aaaaaaaaa"


def test_durations_sum_to_the_length(spark):
    rng = np.random.default_rng(0)
    s = series(spark, rng.integers(0, 50, 40))
    kept = T.keep_changes(s, "value", 12.0, ["key"], "pos")
    assert kept.agg(F.sum("duration")).first()[0] == 40


def test_pingpong_length(spark, sf):
    p = px(spark, sf).where("run_id = 0")
    n = p.select("frame").distinct().count()
    assert fr.pingpong(p).select("frame").distinct().count() == 2 * n - 2


def test_studio_off_is_identity(spark, sf):
    p = px(spark, sf).where("run_id = 0")
    assert run_studio(p, Studio()).exceptAll(p).count() == 0


def test_studio_colours_are_palette_colours(spark, sf):
    out = run_studio(px(spark, sf).where("run_id < 2"), preset("handheld"))
    assert {(r.r, r.g, r.b) for r in out.select("r", "g", "b").distinct().collect()} <= set(colours("GAMEBOY"))


def test_noise_keeps_variance(spark):
    rng = np.random.default_rng(1)
    rows = [(k, t, float(v)) for k in range(400) for t, v in enumerate(rng.standard_normal(5))]
    df = T.noise_blend(spark.createDataFrame(rows, "key int, pos int, value double"), "value", 0.6, ["key"], "pos")
    sd = [r[0] for r in df.groupBy("pos").agg(F.stddev("value")).select("stddev(value)").collect()]
    assert all(0.85 < x < 1.15 for x in sd)


@pytest.mark.parametrize("eight", [True, False])
def test_labels_match_a_flood(eight):
    rng = np.random.default_rng(2)
    for _ in range(20):
        mask = rng.random((9, 13)) < 0.5
        lab, seen = G.label_frame(mask, eight), np.full(mask.shape, -1)
        steps = S.square(3, False) if eight else S.CROSS
        for y, x in np.argwhere(mask):
            if seen[y, x] < 0:
                todo, seen[y, x] = [(y, x)], y * 13 + x
                while todo:
                    a, b = todo.pop()
                    for dy, dx in steps:
                        p, q = a + dy, b + dx
                        if 0 <= p < 9 and 0 <= q < 13 and mask[p, q] and seen[p, q] < 0:
                            seen[p, q] = y * 13 + x
                            todo.append((p, q))
        assert (lab == seen).all()


def test_wrapped_and_empty_padding(spark):
    p = spark.createDataFrame([(0, 0, y, x, y * 3 + x) for y in range(3) for x in range(3)], "run_id int, frame int, y int, x int, v int")
    wrap = S.neighbours(p, [(-1, 0)], 3, 3, "wrap", ["v"]).collect()
    assert {(r.y, r.x): r.v for r in wrap}[0, 1] == 7
    assert S.neighbours(p, [(-1, 0)], 3, 3, "none", ["v"]).count() == 6
    assert {(r.y, r.x): r.v for r in S.neighbours(p, [(-1, 0)], 3, 3, "edge", ["v"]).collect()}[0, 1] == 1


def test_splice_leaves_the_rest(spark):
    cels = spark.createDataFrame([(1, f, f"old{f}") for f in range(6)], "layer int, frame int, cel string")
    new = spark.createDataFrame([(1, f, f"new{f}") for f in range(2)], "layer int, frame int, cel string")
    got = [r.cel for r in TL.splice(cels, new, 2, 2, "layer").orderBy("frame").collect()]
    assert got == ["old0", "old1", "new0", "new1", "old4", "old5"]


def test_first_of_equally_near_entries(spark):
    pal = spark.createDataFrame([(0, 10, 0, 0), (1, 30, 0, 0)], "k int, r int, g int, b int")
    p = spark.createDataFrame([(20, 0, 0)], "r int, g int, b int")
    assert P.with_nearest(p, pal).first().k == 0


def test_a_large_palette_is_refused(spark):
    with pytest.raises(ValueError):
        P.as_array(spark.range(5000).selectExpr("id AS k", "0 AS r", "0 AS g", "0 AS b"))


def test_rounding_is_half_to_even(spark):
    assert [r[0] for r in spark.createDataFrame([(0.5 / 255,), (1.5 / 255,), (2.5 / 255,)], "v double").select(C.to_byte(F.col("v"))).collect()] == [0, 2, 2]


def test_palette_table(spark):
    assert palette(spark).count() == 150


def test_edits_of_layers_that_are_not_there(spark):
    from framelake.operators import editing as E

    rows = spark.createDataFrame([(1, 0, "a"), (2, 0, "b"), (2, 1, "c")], "grp int, pos int, name string")
    got = lambda df: {(r.grp, r.pos, r.name) for r in df.collect()}
    assert got(E.move_layer(rows, "grp", 1, 0)) == {(1, 0, "a"), (2, 1, "b"), (2, 0, "c")}
    assert got(E.move_layer(rows, "grp", 0, 5)) == got(rows)
    assert got(E.remove_layer(rows, "grp", 0)) == {(1, 0, "a"), (2, 0, "c")}
    assert got(E.add_layer(rows, "grp", "n", 9)) == got(rows) | {(1, 1, "n"), (2, 2, "n")}
    assert got(E.duplicate_layer(rows, 1)) == got(rows) | {(2, 2, "c copy")}
    assert got(E.add_layer(rows.limit(0), "grp", "n")) == set()


def test_saved_states_with_gaps(spark):
    from framelake.operators import editing as E

    rows = spark.createDataFrame([(1, '[{"id":"x","kind":null},{"id":"y","kind":"ref","source":"paint","opacity":0.5}]'), (2, "[]"), (3, "{"), (4, None)], "grp int, json string")
    got = {(r.grp, r.pos, r.id, r.kind, r.source, r.opacity) for r in E.restore_layers(rows, "grp").collect()}
    assert got >= {(1, 0, "x", "normal", "user", None), (1, 1, "y", "ref", "paint", 0.5)}
    assert not [g for g in got if g[0] in (2, 4)]


def test_clamped_durations_and_rings_of_empty_frames(spark):
    from pyspark.sql import functions as F

    from framelake.operators import raster as R
    from framelake.operators import texts as X

    rows = spark.createDataFrame([([1, 2], 0), ([1, 2], 5), ([], 0), (None, 0)], "d array<int>, i int")
    assert [r[0] for r in rows.select(X.clamped_duration_ms(F.col("d"), F.col("i"), 10)).collect()] == [100, 200, None, None]
    cells = [(0, f, y, x, 3, float(f == 1 or (f == 2 and (y, x) == (1, 1)))) for f in range(3) for y in range(3) for x in range(3)]
    px = spark.createDataFrame(cells, "run_id int, frame int, y int, x int, k int, a double")
    assert {(r.frame, r.y, r.x, r.k) for r in R.ring_class(px, 3, 3).collect()} == {(2, 0, 1, 3), (2, 1, 0, 3), (2, 1, 2, 3), (2, 2, 1, 3)}


@pytest.mark.parametrize("share, below, pair, above", [(0.7, 6, [(33, 3, 0), (0, 0, 102)], 2), (0.2, 0, [(66, 6, 51), (0, 0, 255)], 3)])
def test_bounds_between_neighbouring_doubles(spark, duck, share, below, pair, above):
    # the pair has one luminance, which comes out as two doubles next to each other; the bound lies between them
    colours = [(0, 0, 0)] * below + pair + [(255, 255, 255)] * above
    df = spark.createDataFrame([(1, 0, 0, x, *c) for x, c in enumerate(colours)], "run_id int, frame int, y int, x int, r int, g int, b int")
    shares = [share * 10, 10 - share * 10]
    values = [0.299 * r + 0.587 * g + 0.114 * b for r, g, b in colours]
    want = duck.execute(f"SELECT quantile_cont(v, CAST({share} AS DOUBLE)) FROM (SELECT unnest($1) AS v)", [values]).fetchone()[0]
    bounds = L.band_boundaries(df, shares)
    assert bounds.first().bound == want
    assert [r.band for r in L.band_remap(df, bounds).orderBy("x").collect()] == [int(want < v) for v in values]
    assert L.band_boundaries(df.where("r < 0"), shares).count() == 0


@pytest.mark.parametrize("matte, size, threshold, total", [(True, 55, 0.42, 35343), (False, 50, 0.48, 18360)])
def test_a_difference_of_exactly_the_threshold_is_not_more(spark, matte, size, threshold, total):
    # the steps of a clip's pixels sum to exactly the threshold's share of the most there can be: 1530 a pixel, or 765 without mattes
    rng, rows = np.random.default_rng(4), []
    for run in range(20):
        steps = rng.integers(0, 765, size)
        if matte:
            steps[rng.permutation(size)[: size // 2]] += 765
        while off := total - int(steps.sum()):
            i = rng.integers(size)
            low = steps[i] // 765 * 765
            steps[i] = np.clip(steps[i] + off, low, low + 764)
        for x, step in enumerate(steps.tolist()):
            appears, left = divmod(step, 765)
            rgb = [min(255, max(0, left - 255 * c)) for c in range(3)]
            rows += [(run, 0, 0, x, 0, 0, 0, float(1 - appears)), (run, 1, 0, x, *rgb, 1.0)]
    df = spark.createDataFrame(rows, "run_id int, frame int, y int, x int, r int, g int, b int, a double")
    assert [r.duration for r in T.dedup_frames(df, threshold, matte=matte).orderBy("run_id").collect()] == [2] * 20
    assert T.dedup_frames(df, threshold - 0.0001, matte=matte).count() == 40
