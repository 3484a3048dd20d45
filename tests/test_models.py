"""Satellite disks, wind profiles, multi-model rain and nowcasts on small cases with known answers."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratocast.functions import satellite
from stratocast.operators import multimodel, nowcast, profiles


def test_disk_places_return(spark):
    df = spark.createDataFrame([(0.0, 133.0), (35.0, 110.0), (-20.0, 150.0), (10.0, -60.0)], "lat double, lon double")
    line, column, visible = satellite.line_column(F.col("lat"), F.col("lon"), satellite.NOMINAL)
    back = satellite.lat_lon(F.col("line"), F.col("col"), satellite.NOMINAL)
    rows = df.select("*", line.alias("line"), column.alias("col"), visible.alias("visible")).select("*", back[0].alias("lat2"), back[1].alias("lon2")).collect()
    assert (rows[0].line, rows[0].col) == (pytest.approx(1373.5), pytest.approx(1373.5))
    assert rows[1].line < 1373.5 and rows[1].col < 1373.5
    for r in rows[:3]:
        assert r.visible and r.lat2 == pytest.approx(r.lat) and r.lon2 == pytest.approx(r.lon)
    assert not rows[3].visible


def test_space_has_no_place(spark):
    lat, lon = satellite.lat_lon(F.lit(0.0), F.lit(0.0), satellite.NOMINAL)
    assert tuple(spark.range(1).select(lat, lon).first()) == (None, None)


def test_counts_and_channels(spark):
    table = F.array(F.lit(1.0), F.lit(2.0))
    df = spark.createDataFrame([(0, "1-3,7"), (1, "3, 2,2"), (2, "3-1"), (-1, "a"), (None, None)], "n int, spec string")
    rows = df.select(satellite.calibrated(F.col("n"), table).alias("v"), satellite.channel_numbers(F.col("spec")).alias("c")).collect()
    assert [r.v for r in rows] == [1.0, 2.0, None, None, None]
    assert [r.c for r in rows] == [[1, 2, 3, 7], [2, 3], None, None, None]


def test_wind_between_levels(spark):
    levels = F.array(*[F.struct(F.lit(h).alias("h"), F.lit(u).alias("u")) for h, u in ((10.0, 2.0), (20.0, 4.0), (40.0, 5.0))])
    at = [F.lit(x) for x in (5.0, 15.0, 20.0, 70.0)]
    got = spark.range(1).select(*[profiles.wind_at(levels, h) for h in at]).first()
    assert list(got) == pytest.approx([1.0, 3.0, 4.0, 5.0 + (70 - 40) / (10 - 40) * (2 - 5)])


def test_flat_cells_keep_their_wind(spark):
    rows = [(c, h, u) for c in (1, 2, 3) for h, u in ((10.0, 3.0), (500.0, 9.0))]
    df = profiles.profiles(spark.createDataFrame(rows, "cell int, h double, u double"), ["cell"], "h", "u")
    static = spark.createDataFrame(
        [(1, 0.0, 0.0, 0.1, 100.0, 50.0), (2, 80.0, 0.2, 0.1, 100.0, 100.0), (3, 80.0, 0.2, None, None, 50.0)],
        "cell int, sigma double, a_over_s double, z0 double, terrain double, model_terrain double",
    )
    got = {r.cell: [x.u for x in r.corrected] for r in profiles.corrected_profiles(df.join(static, "cell"), 1000.0, 4000.0).collect()}
    assert got[1] == [3.0, 9.0] and got[3] == [3.0, 9.0]
    assert got[2][0] != 3.0 and got[2][1] == 9.0


def _stations(spark, models):
    rows = [("b", i, m, 30.0 if good or i % 2 else 0.0, 30.0) for i in range(40) for m, good in models]
    return spark.createDataFrame(rows, "block string, id int, model string, forecast double, observed double")


def test_better_models_weigh_more(spark):
    history = _stations(spark, [("good", True), ("poor", False)])
    got = {r.model: r.now for r in multimodel.block_scores(history, ["block"], "id", ["good", "poor", "gone"], multimodel.NEAR_WEIGHTS).collect()}
    # at 50 mm nobody is judged, so that grade is shared evenly
    assert got["gone"] == pytest.approx(0.45 / 3, abs=1e-6) and got["good"] == pytest.approx(0.55 * 2 / 3 + 0.15, abs=1e-4)
    assert sum(got.values()) == pytest.approx(1)


def test_memory_and_presence(spark):
    now = spark.createDataFrame([("b", m, 0.25) for m in "wxyz"] + [("c", "w", 1.0)], "block string, model string, now double")
    before = spark.createDataFrame([("b", "w", 2.0), ("b", "x", 2.0)], "block string, model string, score double")
    scores = multimodel.remembered(now, before, ["block"])
    got = {(r.block, r.model): r.score for r in scores.collect()}
    assert got["b", "w"] == pytest.approx(0.475) and got["b", "z"] == pytest.approx(0.025) and got["c", "w"] == pytest.approx(1.0)
    current = spark.createDataFrame([("b", 1, "w", 4.0), ("b", 1, "z", 8.0), ("b", 1, "y", None), ("d", 2, "w", 1.0)], "block string, id int, model string, forecast double")
    weights = multimodel.presence_weights(scores, current, ["block"], list("wxyz"), most=3)
    # of the equal scores of y and z the later model stays; x is kept but not present
    assert {r.model: round(r.weight, 3) for r in weights.where("block = 'b'").collect()} == {"w": 0.95, "z": 0.05}
    values = {r.id: r.value for r in multimodel.blended(current, weights, ["block"], "id").collect()}
    assert values[1] == pytest.approx(4.2, abs=1e-3) and values[2] == 0.0
    alone = multimodel.presence_weights(scores, current, ["block"], list("wxyz"), only="z").collect()
    assert [(r.model, round(r.weight, 3)) for r in alone] == [("z", 1.0)]


def test_newest_earlier_state(spark):
    day = lambda n: datetime.datetime(2026, 1, n)
    states = spark.createDataFrame([("b", day(1), "w", 1.0), ("b", day(2), "w", 2.0), ("b", day(3), "w", 3.0), ("b", day(1), "x", 9.0)], "block string, issued timestamp, model string, score double")
    got = multimodel.latest_before(states, ["block"], "issued", F.lit(day(3))).collect()
    assert [(r.model, r.score) for r in got] == [("w", 2.0)]


def _moving(n=48):
    y, x = np.mgrid[:n, :n]
    return [8 * np.exp(-((x - 18 - k) ** 2 + (y - 24) ** 2) / 60.0) for k in range(3)]


def test_rain_moves_on():
    out = nowcast.extrapolated(_moving(), 3, levels=4, half=8, fewest=20, change=0.01)
    centre = lambda f: (f * np.arange(f.shape[1])).sum() / f.sum()
    moves = [centre(out[0, k]) - centre(_moving()[2]) for k in range(3)]
    assert 0.4 < moves[0] < 1.6 and moves[0] < moves[1] < moves[2]
    now = _moving()[2]
    assert all((f > 0).sum() == (now >= 0.1).sum() and f[f > 0].mean() == pytest.approx(now[now >= 0.1].mean()) for f in out[0])
    assert not nowcast.extrapolated([np.zeros((8, 8))] * 3, 2, levels=3).any()


def test_members_differ_and_agree_on_reruns():
    a, b = (nowcast.extrapolated(_moving(), 2, levels=4, members=2, seed=5, half=8, fewest=20) for _ in range(2))
    assert np.array_equal(a, b) and not np.allclose(a[0], a[1])
    assert np.allclose(np.sort(a[0, 0], axis=None)[-50:], np.sort(_moving()[2], axis=None)[-50:])


def test_nowcast_rows(spark):
    rows = [(k, s, iy, ix, float(iy * ix % 5)) for k, n in (("a", 3), ("b", 2)) for s in range(n) for iy in range(6) for ix in range(6)]
    got = nowcast.nowcast(spark.createDataFrame(rows, "k string, step int, iy int, ix int, value double"), "k", 2, members=2, levels=3).collect()
    assert len(got) == 2 * 2 * 36 and {r.k for r in got} == {"a"} and {r.lead for r in got} == {1, 2}


def test_corners():
    field = np.zeros((20, 20))
    field[5:12, 6:14] = 10
    found = nowcast.features(field, most=4)
    assert len(found) == 4 and all(min(abs(y - a) + abs(x - b) for a in (5, 11) for b in (6, 13)) <= 3 for y, x, _ in found)
    assert nowcast.features(np.zeros((5, 5))) == []
