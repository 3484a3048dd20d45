"""Analyses, radar classes and calendar functions on small cases with known answers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratocast.functions import calendar
from stratocast.operators import analysis, radar


def test_a_correction_meets_a_lone_station(spark):
    cells = spark.createDataFrame([(y, x, 1.0) for y in range(5) for x in range(5)], "iy int, ix int, value double")
    station = spark.createDataFrame([(1, 2.0, 2.0, 6.0)], "id int, sy double, sx double, value double")
    got = {(r.iy, r.ix): r.value for r in analysis.cressman(station, cells, [2, 1]).collect()}
    assert got[2, 2] == pytest.approx(6.0) and got[0, 0] == 1.0 and len(got) == 25


def test_no_stations_change_nothing(spark):
    cells = spark.createDataFrame([(0, 0, 1.0), (0, 1, None)], "iy int, ix int, value double")
    none = spark.createDataFrame([], "id int, sy double, sx double, value double")
    for out in (analysis.cressman_step(none, cells, 2), analysis.nearest_residual(none, cells, 2), analysis.spread_residuals(none, cells, 2, 3, 1.0)):
        assert sorted((r.ix, r.value) for r in out.select("ix", "value").collect()) == [(0, 1.0), (1, None)]


def test_level_map_is_continuous_and_keeps_nulls(spark):
    rows = spark.createDataFrame([(8.0,), (4.0,), (70.0,), (None,)], "v double").select(analysis.level_map(F.col("v"), [8.0, 35.0], [10.0, 50.0]).alias("m"))
    assert [r.m for r in rows.collect()] == pytest.approx([10.0, 5.0, 100.0, None])


def test_each_centroid_is_its_own_class(spark):
    for band in "CX":
        rows = spark.createDataFrame([(i, *map(float, c)) for i, c in enumerate(radar.CENTROIDS[band], 1)], f"n int, {', '.join(f'{v} double' for v in radar.VARIABLES)}")
        x = radar.class_distances({v: F.col(v) for v in radar.VARIABLES}, band)
        shares = rows.select("n", radar.nearest_class(x).alias("c"), radar.class_shares(x, band).alias("s"), radar.class_entropy(radar.class_shares(x, band)).alias("e")).collect()
        assert all(r.n == r.c for r in shares)
        assert all(sum(r.s) == pytest.approx(100) and 0 <= r.e <= 1 and r.s[r.n - 1] == max(r.s) for r in shares)


def test_no_echo_has_no_class(spark):
    row = spark.createDataFrame([(None, 1.0)], "z double, o double")
    x = radar.class_distances({v: F.col("z" if v == "Zh" else "o") for v in radar.VARIABLES})
    assert row.select(radar.nearest_class(x).alias("c")).first().c == 0


def test_wavelet_parts_sum_to_the_field():
    f = np.random.default_rng(1).random((16, 20))
    parts, rest = radar.a_trous(f, 2)
    assert np.allclose(parts.sum(axis=0) + rest, f) and np.allclose(radar.a_trous(np.ones((8, 8)), 2)[0], 0)


def test_echo_classes():
    f = np.full((21, 21), 20.0)
    f[10, 10], f[0, 0] = 50.0, np.nan
    got = radar.convective_stratiform(1000.0, 1000.0, radius=5000.0)(f)
    assert got[10, 10] == 2 and got[10, 12] == 2 and got[20, 0] == 1 and math.isnan(got[0, 0])
    want = 10 * math.log10((10**5 + 4 * 10**2) / 5)
    assert radar.background(f, 1000.0, 1000.0, 1000.0)[10, 10] == pytest.approx(want)
    waves = radar.wavelet_classes(2)(f)
    assert waves[10, 10] == 3 and waves[20, 20] == 1 and math.isnan(waves[0, 0])


@pytest.mark.parametrize("seed", range(5))
def test_unfolding_restores_a_smooth_sweep(seed):
    rng = np.random.default_rng(seed)
    rays = np.arange(36) * 2 * np.pi / 36
    true = np.outer(np.linspace(0.4, 1, 20), 16 * np.sin(rays + rng.random())) + rng.random((20, 36))
    folded = (true + 10) % 20 - 10
    folded[3, 4] = np.nan
    turns = (radar.unfolded(10.0)(folded) - true) / 20
    good = ~np.isnan(turns)
    assert good.sum() == turns.size - 1 and np.allclose(turns[good], np.round(turns[good][0]))


def test_gate_predicates_and_missing_values(spark):
    v = F.col("v")
    rows = spark.createDataFrame([(1.0,), (2.0,), (None,), (float("nan"),), (float("inf"),)], "v double")
    got = rows.select(radar.below(v, 2.0).alias("a"), radar.above(v, 2.0, inclusive=True, missing=False).alias("b"), radar.inside(v, 2.0, 1.0).alias("c"), radar.invalid(v).alias("d")).collect()
    assert [r.a for r in got][:3] == [True, False, True] and [r.b for r in got][:3] == [False, True, False]
    assert [r.c for r in got][:3] == [True, True, True] and [r.d for r in got] == [False, False, True, True, True]


def test_times_and_paths(spark):
    row = spark.createDataFrame([("2026-03-01 08", "2026", "x")], "a string, b string, c string")
    got = row.select(*[calendar.parsed_time(F.col(c)).cast("string").alias(c) for c in "abc"], calendar.path("YYYYMMDDHH.VVV", calendar.parsed_time(F.col("a")), F.lit(6)).alias("p")).first()
    assert got.a == "2026-03-01 08:00:00" and got.b == "2026-01-01 00:00:00" and got.c is None and got.p == "2026030108.006"
