"""Published cases of cleaning, neighbourhoods, text and raw formats, listing, cloud units and codes."""

from datetime import datetime

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from stratocast import catalog, catalog_cleaning, run  # noqa: F401  the second registers its queries in the first
from stratocast.functions import calendar as C
from stratocast.functions import cleaning as Q
from stratocast.operators import blending, datasets, relational
from stratocast.operators import calibration as CAL
from stratocast.operators import fields as K
from stratocast.operators import neighbours as N
from stratocast.operators import nowcast as NC
from stratocast.operators import phenomena as P
from stratocast.operators import radar as D
from stratocast.operators import selection as S
from stratocast.sources import config, micaps, netcdf
from stratocast.sources import listing as L
from stratocast.streaming import state
from tests.test_catalog import steps


@pytest.mark.parametrize("cloud,code", [(0.5, "00101"), (0.95, "00202"), (0.2, "00000"), (95.0, "00202")])
def test_cloud_fractions_count_as_per_cent(spark, cloud, code):
    rows = steps(spark, [(0.0, 0.0, cloud, 0.0, 0.0, 0.0, 0.0, 0.0)] * 4)
    assert P.code_weather(rows, ["cell"], cloud_unit="auto").first().code == code
    if cloud < 1:
        assert P.code_weather(rows, ["cell"], cloud_unit="1").first().code == code


@pytest.mark.parametrize("code,phrase", [(10207, "阴转小雨"), (20001, "晴间多云"), (35661, "中度霾伴有轻雾"), (101, "多云")])
def test_codes_are_decoded(spark, code, phrase):
    got = spark.range(1).select(P.decoded(F.lit(code)).alias("x")).first().x
    assert got.phrase == phrase and f"{got.logic}{got.a}{got.b}" == f"{code:05d}"


def grid_of(spark, values):
    rows = [(y, x, None if np.isnan(v) else float(v)) for (y, x), v in np.ndenumerate(values)]
    return spark.createDataFrame(rows, "iy int, ix int, v double")


@pytest.mark.parametrize("weighted", [False, True])
def test_circles_equal_their_kernel_with_holes(spark, weighted):
    rng = np.random.default_rng(0)
    values = rng.random((9, 11))
    values[rng.random((9, 11)) < 0.2] = np.nan
    got = {(r.iy, r.ix): r["mean"] for r in N.circle_mean(grid_of(spark, values), [], 3, "v", weighted).collect()}
    for y in range(9):
        for x in range(11):
            near = [(w, values[y + a, x + b]) for a, b, w in N.kernel(3, weighted) if 0 <= y + a < 9 and 0 <= x + b < 11 and not np.isnan(values[y + a, x + b])]
            assert got[y, x] == pytest.approx(sum(w * v for w, v in near) / sum(w for w, _ in near))


def test_masked_means_keep_to_their_layer(spark):
    values = np.array([[1.0, 2, 3], [4, 5, 6], [7, 8, 9]])
    mask = spark.createDataFrame([(0, y, x, int(x < 2)) for y in range(3) for x in range(3)], "band int, iy int, ix int, m int")
    own = {(r.iy, r.ix): r["mean"] for r in N.masked_mean(grid_of(spark, values), mask, [], 1, "v").collect()}
    assert own[1, 1] == pytest.approx(np.mean(values[:, :2])) and own[1, 2] is None
    free = {(r.iy, r.ix): r["mean"] for r in N.masked_mean(grid_of(spark, values), mask, [], 1, "v", remask=False).collect()}
    assert free[1, 2] == pytest.approx(np.mean(values[:, 1]))


def test_collapsed_layers_round_halves_as_their_sql(spark):
    """sf0.01 holds means that end in a 5 at the fifth decimal."""
    d = "/root/testdata/sf0.01"
    duck = duckdb.connect()
    for name in ("lineitem", "part"):
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{d}/{name}.parquet'")
    want = {(y, x): m for y, x, m in duck.sql(catalog.ORACLES["collapsed_layers"]).select("iy, ix, mean").fetchall()}
    assert {(r.iy, r.ix): r["mean"] for r in catalog.QUERIES["collapsed_layers"](spark, d).collect()} == want


def test_radius_under_a_cell_is_refused():
    assert N.radius_in_cells(10_000, 2_000) == 5
    with pytest.raises(ValueError):
        N.radius_in_cells(900, 1_000)


def test_circular_mean_crosses_north(spark):
    df = spark.createDataFrame([(1, 350.0), (1, 10.0), (1, 0.0)], "k int, d double")
    got = N.circular_mean(df, ["k"], "d").first().direction
    assert min(got, 360 - got) < 1e-6


def test_raw_masks_round_trip(spark, tmp_path):
    values = np.arange(12, dtype=np.float32).reshape(3, 4) / 3
    micaps.write_mask(grid_of(spark, values).withColumnRenamed("v", "value"), str(tmp_path), "mask.dat")
    assert np.fromfile(f"{tmp_path}/mask.dat", "<f4").tolist() == values.ravel().tolist()
    assert {(r.iy, r.ix): r.value for r in micaps.read_mask(spark, f"{tmp_path}/mask.dat", 4).collect()} == {(y, x): float(v) for (y, x), v in np.ndenumerate(values)}


def test_grid_text_has_22_tokens_and_station_text_a_count(spark, tmp_path):
    cells = grid_of(spark, np.array([[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]])).select("iy", "ix", (20 + F.col("iy") * 0.5).alias("lat"), (100 + F.col("ix") * 0.25).alias("lon"), F.col("v").alias("value"))
    micaps.write_grid(cells, f"{tmp_path}/g", "title", datetime(2026, 3, 1, 8), 24, 850)
    lines = [r.value for r in spark.read.text(f"{tmp_path}/g").coalesce(1).collect()]
    assert lines[0].split()[:9] == ["diamond", "4", "title", "2026", "03", "01", "08", "24", "850"] and len(lines[0].split()) == 22
    assert [x.split() for x in lines[1:]] == [["1.0000", "2.0000"], ["3.0000", "4.0000"], ["5.0000", "6.0000"]]
    head = spark.createDataFrame([(lines[0],), ("diamond 3 x",)], "l string").select(micaps.header(F.col("l")).alias("h")).collect()
    assert (head[0].h.issue, head[0].h.lead, head[0].h.nlon, head[0].h.nlat, head[0].h.dlon) == (datetime(2026, 3, 1, 8), 24, 2, 3, 0.25) and head[1].h is None
    stations = spark.createDataFrame([(9, 1.0, 1.0, 0.0, 2.0), (10, 2.0, 2.0, 0.0, None), (7, 3.0, 3.0, 0.0, 4.0)], "id long, lon double, lat double, alt double, value double")
    micaps.write_stations(stations, f"{tmp_path}/s", "title")
    assert "\n".join(r.value for r in spark.read.text(f"{tmp_path}/s").coalesce(1).collect()).split("\n")[2:] == ["1 2", "7 3.0000 3.0000 0.0000 4.0000", "9 1.0000 1.0000 0.0000 2.0000"]


def test_a_grid_from_north_to_south_is_turned(spark, tmp_path):
    (tmp_path / "n.txt").write_text("diamond 4 t 2026 3 1 0 24 850 0.5 -0.5 100 100.5 21 20 2 3 1 0 9 1 0\n1 2\n3 4\n5 6\n")
    got = {(r.iy, r.ix): (r.lat, r.value) for r in micaps.ascending(micaps.read_grid(spark, f"{tmp_path}/n.txt")).collect()}
    assert got[0, 0] == (20.0, 5.0) and got[2, 1] == (21.0, 2.0)


def test_strict_leads_raise_and_copies_write_once(spark, tmp_path):
    found = spark.createDataFrame([("a", 1), ("a", 3)], "k string, lead int")
    assert [tuple(r) for r in L.lacking(found, ["k"], "lead", [1, 2, 3]).collect()] == [("a", 2)]
    with pytest.raises(Exception, match="missing lead 2"):
        L.lacking(found, ["k"], "lead", [1, 2, 3], strict=True).collect()
    L.write_parts(found.withColumn("v", F.lit(1)), f"{tmp_path}/p", ["lead"], overwrite=False)
    L.write_parts(spark.createDataFrame([("b", 1, 2), ("b", 5, 2)], "k string, lead int, v int"), f"{tmp_path}/p", ["lead"], overwrite=False)
    assert sorted((r.k, r.lead, r.v) for r in spark.read.parquet(f"{tmp_path}/p").collect()) == [("a", 1, 1), ("a", 3, 1), ("b", 5, 2)]


def test_long_leads_keep_their_digits(spark):
    got = spark.range(1).select(*[C.path("VVV", F.lit(datetime(2026, 1, 1)), F.lit(n)).alias(f"x{n}") for n in (6, 120, 1000)]).first()
    assert tuple(got) == ("006", "120", "1000")


def test_lambert_cone_keeps_its_centre_and_north(spark):
    got = spark.range(1).select(*[c.alias(n) for n, c in zip("abcd", [*Q.lambert(F.lit(110.0), F.lit(36.0), 110.0, 25.0, 47.0, 36.0), *Q.lambert(F.lit(110.0), F.lit(37.0), 110.0, 25.0, 47.0, 36.0)], strict=True)]).first()
    assert abs(got.a) < 1e-6 and abs(got.b) < 1e-6 and abs(got.c) < 1e-6 and 105_000 < got.d < 112_000


def test_equal_values_have_a_seeded_order(spark):
    df = spark.createDataFrame([(1, i, float(i // 4)) for i in range(12)], "k int, i int, v double")
    one, two = ([r.i for r in S.seeded_order(df, ["k"], "v", seed).orderBy("place").collect()] for seed in (0, 0))
    assert one == two and [i // 4 for i in one] == [0] * 4 + [1] * 4 + [2] * 4 and one != list(range(12))


def test_units_that_are_not_known_raise():
    with pytest.raises(KeyError):
        Q.converted(F.lit(1.0), "K", "mm")


def test_components_follow_a_winding_area():
    """A spiral is one area whatever its length; kinds and missing cells part areas."""
    n = 61
    kind = np.full((n, n), -1)
    kind[::2, :] = 0
    for k, y in enumerate(range(1, n, 2)):
        kind[y, -1 if k % 2 == 0 else 0] = 0
    assert set(np.unique(K.components(kind))) == {-1, 0}
    assert K.components(np.array([[0, 1, 0], [0, 1, 0]])).tolist() == [[0, 1, 2], [0, 1, 2]]
    assert K.components(np.array([[0, 1, 0], [0, 1, 0]]), wrap=True).tolist() == [[0, 1, 0], [0, 1, 0]]


def test_unfolding_crosses_gaps_and_anchors():
    true = np.add.outer(np.zeros(6), np.linspace(-4, 26, 24))
    folded = (true + 10) % 20 - 10
    assert np.allclose(D.unfolded(10.0, wrap=False)(folded) - true, (D.unfolded(10.0, wrap=False)(folded) - true)[0, 0])
    holes = folded.copy()
    holes[:, 9] = np.nan
    filled = D.unfolded(10.0, gaps=(0, 1), wrap=False)(holes)
    rest = ~np.isnan(holes)
    assert np.allclose((filled - true)[rest], (filled - true)[0, 0]) and np.isnan(filled[0, 9])
    assert np.allclose(D.anchored(10.0, gaps=(0, 1), wrap=False)(holes, true + 1.5)[rest], true[rest])


def test_scan_order_of_convective_cells():
    """Against a plain scan: columns first, covered cells are passed over as centres."""
    rng = np.random.default_rng(4)
    dbz = rng.normal(25, 12, (14, 17))
    dbz[rng.random(dbz.shape) < 0.1] = np.nan
    back = D.background(dbz, 4000.0, 1000.0, 1000.0)
    want = np.where(np.isnan(dbz), np.nan, 1.0)
    for i in range(17):
        for j in range(14):
            if np.isnan(dbz[j, i]) or want[j, i] == 2:
                continue
            b = back[j, i]
            need = 10.0 if b < 0 else 10 - b * b / 180 if b < 42.43 else 0.0
            if dbz[j, i] >= 42 or dbz[j, i] - b >= need:
                reach = 5 if b >= 40 else 4 if b >= 35 else 3 if b >= 30 else 2 if b >= 25 else 1
                for y in range(14):
                    for x in range(17):
                        if np.hypot(y - j, x - i) <= reach and not np.isnan(dbz[y, x]):
                            want[y, x] = 2.0
    got = D.convective_stratiform(1000.0, 1000.0, radius=4000.0)(dbz)
    assert np.array_equal(got, want, equal_nan=True)
    free = D.convective_stratiform(1000.0, 1000.0, radius=4000.0, in_order=False)(dbz)
    assert (free >= got)[~np.isnan(dbz)].all()


def test_flow_follows_its_velocities():
    y, x = np.mgrid[:20, :30].astype(float)
    plane = 2 * y + 3 * x
    ones = np.ones(plane.shape)
    moved = K.advect_along(3)(plane, 2 * ones, -1 * ones)
    assert np.allclose(moved[:17, 6:], (plane - 3 * (2 * -1 + 3 * 2))[:17, 6:]) and np.isnan(moved[:, :6]).all()
    turn = K.advect_along(1, passes=8)(plane, -(y - 10) * 0.1, (x - 15) * 0.1)  # a rotation keeps its centre
    assert turn[10, 15] == pytest.approx(plane[10, 15])


def test_resizing_mirroring_and_cubic_values_keep_planes():
    y, x = np.mgrid[:6, :9].astype(float)
    plane = y - 2 * x
    assert np.allclose(K.resized(plane, (11, 17))[::2, ::2], plane)
    assert K.mirrored(plane, 2).shape == (10, 13) and K.mirrored(plane, 1)[0, 1] == plane[0, 0]
    at = np.array([1.3, 3.5]), np.array([2.25, 5.5])
    assert np.allclose(K.bicubic(plane, *at), at[0] - 2 * at[1])


def test_motion_errors_are_seeded_and_noise_has_the_texture():
    u, v = np.full((5, 5), 2.0), np.zeros((5, 5))
    one, two = (NC.perturbed_motion(u, v, 60, 1.0, 10.0, np.random.default_rng(3)) for _ in range(2))
    assert np.array_equal(one[0], two[0]) and np.ptp(one[0]) == 0 and not np.allclose(one[0], u)
    field = np.add.outer(np.sin(np.arange(32) / 5), np.zeros(32))
    noise = NC.noise_of(NC.mean_spectrum([field, field * 2]), np.random.default_rng(0))
    assert noise.mean() == pytest.approx(0) and noise.std() == pytest.approx(1) and np.abs(np.diff(noise, axis=1)).max() < 1e-6


def test_spectra_are_averaged_over_fields(spark):
    rng = np.random.default_rng(1)
    fields = rng.random((3, 4, 4))
    rows = [(k, 7, y, x, float(fields[k, y, x])) for k in range(3) for y in range(4) for x in range(4)]
    got = {(r.iy, r.ix): r.amplitude for r in NC.spectra(spark.createDataFrame(rows, "k int, g int, iy int, ix int, value double"), "k", "g").collect()}
    want = NC.mean_spectrum(list(fields))
    assert all(got[y, x] == pytest.approx(want[y, x]) for y in range(4) for x in range(4))


def test_features_drop_single_cells():
    dbz = np.full((15, 15), 15.0)
    dbz[3, 3] = 50.0
    dbz[9:12, 9:12] = 50.0
    out = D.feature_classes(1000.0, 1000.0, radius=3000.0, least_cells=4)(dbz)
    assert out[3, 3] == 1 and out[10, 10] == 2


def test_lines_with_several_predictors(spark):
    rng = np.random.default_rng(2)
    p, q = rng.normal(size=200), rng.normal(size=200)
    rows = [(int(i % 2), float(a), float(b), 5.0, float(1 + 2 * a - 3 * b + (i % 2))) for i, (a, b) in enumerate(zip(p, q, strict=True))] + [(0, None, 1.0, 5.0, 9.0)]
    df = spark.createDataFrame(rows, "k int, p double, q double, c double, y double")
    fits = CAL.linear_fit(df, ["k"], ["p", "q", "c"], "y")
    got = {r.k: r.coefficients for r in fits.collect()}
    assert got[0] == pytest.approx([1, 2, -3, 0], abs=1e-6) and got[1] == pytest.approx([2, 2, -3, 0], abs=1e-6)
    out = CAL.fitted(df.where("p is not null"), fits, ["k"], ["p", "q", "c"]).collect()
    assert all(r.fitted == pytest.approx(r.y, abs=1e-6) for r in out)


def test_many_pairs_of_a_key_meet_in_bounded_bins(spark):
    rng = np.random.default_rng(3)
    mean = rng.normal(10, 3, 4000)
    rows = [(1, float(m), float(v), float(2 + 0.9 * m + e)) for m, v, e in zip(mean, rng.random(4000), rng.normal(0, 0.5, 4000), strict=True)]
    df = spark.createDataFrame(rows, "k int, mean double, var double, truth double")
    whole, binned = (CAL.fit(df, ["k"], most_bins=n).first() for n in (65_536, 1000))
    assert binned.alpha == pytest.approx(whole.alpha, abs=0.1) and binned.beta == pytest.approx(whole.beta, abs=0.01)


def test_truncated_percentiles_are_not_negative(spark):
    df = spark.createDataFrame([(0.0, 1.0), (-3.0, 0.0)], "location double, scale double")
    got = [r.value for r in CAL.truncated_percentiles(df, [50.0]).orderBy("location", ascending=False).collect()]
    assert got == pytest.approx([0.67449, 0.0], abs=1e-4)


def test_streams_remember_scores_and_write_once(spark, tmp_path):
    for n, rows in enumerate([[(1, "a", 0, 1.0), (1, "b", 0, 4.0)], [(1, "a", 1, 3.0), (1, "b", 1, None)]]):
        spark.createDataFrame(rows, "block long, model string, ts long, score double").coalesce(1).write.parquet(f"{tmp_path}/in/b{n}")
    stream = spark.readStream.schema("block long, model string, ts long, score double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = state.remembered_scores(stream, 0.1).writeStream.format("memory").queryName("scores").outputMode("update").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.model, round(r.score, 6)) for r in spark.table("scores").collect()}
    assert ("a", 1.2) in got and ("b", 4.0) in got
    write = state.written_once(f"{tmp_path}/out", ["ts"])
    batch = spark.createDataFrame([(1, 5), (2, 6)], "ts long, v int")
    for _ in range(2):
        write(batch, 0)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2


def test_streams_take_allowed_cycles_once_and_pair(spark, tmp_path):
    t = lambda h, m=0: datetime(2026, 3, 1, h, m)
    spark.createDataFrame([(t(1), 1), (t(1), 1), (t(1, 10), 1), (t(2), 3)], "cycle timestamp, lead int").coalesce(1).write.parquet(f"{tmp_path}/f")
    stream = spark.readStream.schema("cycle timestamp, lead int").parquet(f"{tmp_path}/f")
    q = state.allowed_cycles(stream, [0], "1 hour").writeStream.format("memory").queryName("cycles").option("checkpointLocation", f"{tmp_path}/c1").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.cycle, r.lead) for r in spark.table("cycles").collect()) == [(t(1), 1), (t(2), 3)]
    spark.createDataFrame([(7, t(1), 1.0), (7, t(2), 2.0)], "id int, valid timestamp, forecast double").write.parquet(f"{tmp_path}/a")
    spark.createDataFrame([(7, t(1), 5.0), (8, t(2), 6.0)], "id int, time timestamp, observed double").write.parquet(f"{tmp_path}/b")
    a, b = (spark.readStream.schema(spark.read.parquet(f"{tmp_path}/{n}").schema).parquet(f"{tmp_path}/{n}") for n in "ab")
    q = state.paired(a, b, ["id"], "1 hour").writeStream.format("memory").queryName("pairs").option("checkpointLocation", f"{tmp_path}/c2").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.id, r.forecast, r.observed) for r in spark.table("pairs").collect()] == [(7, 1.0, 5.0)]


def test_a_model_list_gives_its_run():
    text = "\ufeff# note\nmodelNum=2\nec=/in/ec/YYYYMMDDHH.VVV.m4\ncma = /in/cma/YYYY/MMDDHH.VVV\nfact=/ob/YYYYMMDDHH.000\nstaoutputPath=/out/YYYYMMDDHH.VVV\nblock=5,5\ntitle=x\n"
    run = config.run_of(text, datetime(2026, 3, 1, 8), (24, 120))
    assert run.paths() == [("ec", 24, "/in/ec/2026030108.024.m4"), ("ec", 120, "/in/ec/2026030108.120.m4"), ("cma", 24, "/in/cma/2026/030108.024"), ("cma", 120, "/in/cma/2026/030108.120")]
    assert run.observed()[0] == (24, "/ob/2026030208.000") and run.block == (5.0, 5.0) and run.other == {"title": "x"}
    with pytest.raises(ValueError):
        config.run_of("modelNum=3\na=/YYYY\n", datetime(2026, 3, 1), (24,))
    assert config.settings("[a]\nb=1 = 2\n")["a"] == {"b": "1 = 2"}


def test_the_latest_cycle_is_old_enough():
    assert config.cycle_before(datetime(2026, 3, 1, 9), (8, 20), 6) == datetime(2026, 2, 28, 20)
    assert config.cycle_before(datetime(2026, 3, 1, 14), (8, 20), 6) == datetime(2026, 3, 1, 8)


def test_functions_are_fanned_out(spark):
    import pandas as pd

    parameters = pd.DataFrame({"n": [1, 2, 3]})
    got = datasets.fanned_out(spark, lambda n, by: pd.DataFrame({"n": [n], "m": [n * by]}), parameters, "n long, m long", {"by": 10}).collect()
    assert sorted(map(tuple, got)) == [(1, 10), (2, 20), (3, 30)]
    assert datasets.in_turn(spark.range(5), [lambda d: d.where("id > 1"), lambda d: d.limit(2)]).count() == 2


def test_a_query_runs_from_the_command_line_once(spark, small, tmp_path):
    out = f"{tmp_path}/out"
    assert run.main(["wind_chill", small, out]) and spark.read.parquet(out).count() > 0
    assert not run.main(["wind_chill", small, out]) and run.main(["wind_chill", small, out, "--overwrite"])


def test_ties_of_members_take_a_seeded_order(spark):
    raw = spark.createDataFrame([(1, m, 0.0) for m in range(8)], "id int, member int, value double")
    calibrated = spark.createDataFrame([(1, float(p), float(p)) for p in range(8)], "id int, percentile double, value double")
    order = lambda seed: [r.value for r in relational.ensemble_reorder(raw, calibrated, ["id"], seed).orderBy("member").collect()]
    assert order(None) == [float(p) for p in range(8)] and order(3) == order(3) != order(None) and sorted(order(3)) == order(None)


def test_classic_files_hold_what_the_format_says(spark, tmp_path):
    values = np.array([[1.5, np.nan], [3.0, 4.0]])
    raw = netcdf.encoded({"lat": np.array([10.0, 20.0]), "lon": np.array([1.0, 2.0])}, "t", values, {"units": "K"}, version=1)
    assert raw[:4] == b"CDF\x01" and raw[8:24] == b"\0\0\0\x0a\0\0\0\x02\0\0\0\x03lat\0"
    nc = netcdf.Classic(raw)
    assert nc.dims == {"lat": 2, "lon": 2} and nc.variables["t"].attributes["units"] == "K" and nc.variables["t"].dims == ["lat", "lon"]
    assert np.array_equal(nc.values("t"), values, equal_nan=True) and raw[nc.variables["t"].begin :][:4] == b"\x3f\xc0\0\0"
    with pytest.raises(ValueError):
        netcdf.Classic(b"HDF stuff")


def test_classic_records_scales_and_other_names(spark, tmp_path):
    """A file made by hand: two record variables of shorts, so records interleave with padding; scale, offset and fill."""
    import struct

    name = lambda s: struct.pack(">I", len(s)) + s.encode() + b"\0" * (-len(s) % 4)
    att = lambda k, kind, raw: name(k) + struct.pack(">II", kind, 1) + raw
    dims = struct.pack(">II", 10, 2) + name("time") + struct.pack(">I", 0) + name("x") + struct.pack(">I", 3)
    atts = struct.pack(">II", 12, 3) + att("scale_factor", 6, struct.pack(">d", 0.5)) + att("add_offset", 6, struct.pack(">d", 10.0)) + att("_FillValue", 3, struct.pack(">hxx", -1))
    var = lambda n, a, begin: name(n) + struct.pack(">III", 2, 0, 1) + a + struct.pack(">III", 3, 8, begin)
    head = lambda begin: b"CDF\x01" + struct.pack(">I", 2) + dims + b"\0" * 8 + struct.pack(">II", 11, 2) + var("a", atts, begin) + var("b", b"\0" * 8, begin + 8)
    body = b"".join(struct.pack(">3hxx3hxx", *r) for r in [(0, 2, -1, 7, 8, 9), (4, 6, 8, 1, 2, 3)])
    (tmp_path / "r.nc").write_bytes(head(len(head(0))) + body)
    nc = netcdf.Classic((tmp_path / "r.nc").read_bytes())
    assert nc.values("b").tolist() == [[7, 8, 9], [1, 2, 3]]
    got = {(r.time, r.lon): r.value for r in netcdf.read(spark, f"{tmp_path}/r.nc", "data", ["time", "lon"], {"data": ("t", "a"), "lon": ("longitude", "x")}).collect()}
    assert got == {(0, 0): 10.0, (0, 1): 11.0, (0, 2): None, (1, 0): 12.0, (1, 1): 13.0, (1, 2): 14.0}


def test_files_that_are_there_stay(spark, tmp_path):
    rows = spark.createDataFrame([("c1", 1.0, 1.0, 5.0), ("c2", 1.0, 1.0, 6.0), ("c2", 2.0, 1.0, None)], "channel string, lat double, lon double, value double")
    first = netcdf.write(rows.where("channel = 'c1'"), f"{tmp_path}/n", ["channel"], ["lat", "lon"], pattern="{channel}/x.nc").collect()
    again = netcdf.write(rows.withColumn("value", F.col("value") + 1), f"{tmp_path}/n", ["channel"], ["lat", "lon"], pattern="{channel}/x.nc", overwrite=False).collect()
    assert [r.written for r in first] == [True] and {r.file.split("/")[-2]: r.written for r in again} == {"c1": False, "c2": True}
    got = netcdf.read(spark, f"{tmp_path}/n/*/x.nc", "data0", ["lat", "lon"]).collect()
    assert sorted((r.lat, r.value) for r in got if r.value is not None) == [(1.0, 5.0), (1.0, 7.0)]


def test_a_salient_blend_leans_to_what_stands_out():
    flat, edge = np.full((9, 9), 2.0), np.zeros((9, 9))
    edge[:, 5:] = 8.0
    plain = blending.salient_blend(0.5, strength=0.0)(edge, flat)
    assert np.allclose(plain, (edge + flat) / 2)
    lean = blending.salient_blend(0.5, strength=1.0)(edge, flat)
    at = blending.saliency(edge)[4, 5] / blending.saliency(edge).max()
    share = (at + 0.05) / (at + 0.1)
    assert lean[4, 5] == pytest.approx(2 + share * 6) and lean[4, 0] == pytest.approx(1.0, abs=0.01)
    assert np.allclose(blending.salient_blend(0.3)(flat, flat), flat)
