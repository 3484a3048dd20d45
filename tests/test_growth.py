"""Operators on crowded and tied tables: what their plans may hold, and the rows they must give."""

import duckdb
import pytest
from pyspark.sql import functions as F

from stratocast import catalog, catalog_analysis, catalog_cleaning  # noqa: F401  the others register their queries in the first
from stratocast.functions import cleaning
from stratocast.operators import neighbours as N
from stratocast.operators import radar, relational, selection


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_crowded_stations_are_neither_multiplied_nor_lost(spark):
    """40 stations at each of 5 places: the nearest by (distance, id), from a plan that holds no dealt stations."""
    stations = spark.range(200).select("id", (100.0 + F.col("id") % 5).alias("lon"), F.lit(20.0).alias("lat"), F.col("id").cast("double").alias("value"))
    cells = spark.createDataFrame([(1, 100.1, 20.0), (2, 104.0, 20.5), (3, -80.0, -20.0)], "id int, lon double, lat double")
    near = N.sphere_neighbours(stations, cells, 42, 300.0)
    got = {}
    for r in near.orderBy("id", "place").collect():
        got.setdefault(r.id, []).append(r.value)
    assert got[1] == [*map(float, range(0, 200, 5)), 1.0, 6.0] and got[2] == [*map(float, range(4, 200, 5)), 3.0, 8.0] and len(got[3]) == 42
    assert "Generate" not in plan(near) and "Exchange" not in plan(near)


def test_lines_that_occur_twice_are_taken_as_the_file_has_them(spark, tmp_path):
    """The scan meets the larger second file first; DuckDB on one thread keeps the first row of the first file."""
    duck = duckdb.connect()
    duck.execute("SET threads = 1")
    (tmp_path / "lineitem.parquet").mkdir()
    for name, first, n in (("a", 0, 50), ("b", 1000, 5000)):
        duck.execute(f"COPY (SELECT r % 40 AS l_orderkey, 1::INT AS l_linenumber, ({first} + r)::DOUBLE AS l_quantity, 0.1 AS l_discount, 0.1 AS l_tax FROM range({n}) t(r)) TO '{tmp_path}/lineitem.parquet/{name}.parquet'")
    duck.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = sorted(duck.sql(catalog.ORACLES["last_rows"]).select("ok, ln, refl").fetchall())
    assert sorted((r.ok, r.ln, r.refl) for r in catalog.QUERIES["last_rows"](spark, str(tmp_path)).collect()) == want == [(k, 1, float(k)) for k in range(40)]


def test_every_station_at_a_place_counts(spark):
    """At sf0.1 stations share places, whose order the SQL leaves open: ordered by id too, it gives these rows."""
    d = "/root/testdata/sf0.1"
    duck = duckdb.connect()
    for name in ("lineitem", "part", "supplier"):
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{d}/{name}.parquet'")
    sql = catalog.ORACLES["projected_nearest"].replace("SELECT t.id, s.value,", "SELECT t.id, s.id AS point, s.value,").replace("ORDER BY d, s.x, s.y)", "ORDER BY d, s.x, s.y, s.id)")
    want = dict(duck.sql(sql).select("id, value").fetchall())
    assert sql != catalog.ORACLES["projected_nearest"] and {r.id: r.value for r in catalog.QUERIES["projected_nearest"](spark, d).collect()} == want


def test_times_are_paired_without_making_pairs(spark):
    """Each event meets its nearest, ties to the earlier, over slots, gaps and equal times; the plan holds no join."""
    left = spark.createDataFrame([(i, i % 2, t) for i, t in enumerate([0, 9, 10, 19, 20, 25, 40, 41, 70, 100, None])], "event_id int, u int, t int")
    right = spark.createDataFrame([(u, t, 100 * u + t) for u in (0, 1) for t in (0, 5, 15, 29, 30, 51, 80)] + [(None, 9, 7)], "u int, t2 int, other int")
    got = relational.nearest_in_time(left, right, ["u"], 10)
    want = set()
    for i, u, t in left.collect():
        near = [(abs(t - r.t2), r.t2, r.other) for r in right.collect() if r.u == u and abs(t - r.t2) <= 10] if t is not None else []
        want |= {(i, u, t, *min(near)[1:])} if near else set()
    assert got.columns == ["event_id", "u", "t", "t2", "other"] and {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    assert "Join" not in plan(got)


def test_lists_are_cut_without_an_array_of_all(spark):
    rows = spark.range(11).select((F.col("id") % 2).alias("k"), (F.col("id") * 7 % 11).alias("p"), F.col("id").alias("x"))
    got = {(r.k, r.chunk): r.x for r in selection.chunked_rows(rows, ["k"], "p", 4, "x").collect()}
    want = {k: [str(x) for _, x in sorted((x * 7 % 11, x) for x in range(11) if x % 2 == k)] for k in (0, 1)}
    assert got == {(k, c): want[k][4 * c : 4 * c + 4] for k in (0, 1) for c in (0, 1)}
    assert "posexplode" not in plan(catalog.QUERIES["chunked_lists"](spark, "/root/testdata/sf0.001"))
    assert spark.range(1).select(cleaning.chunked(F.sequence(F.lit(1), F.lit(5)), 2).alias("x")).first().x == [["1", "2"], ["3", "4"], ["5"]]


def test_hydrometeors_by_steps_equal_their_columns(spark):
    rows = [(1, 30.0, 1.0, 0.1, 0.98, 500.0), (2, None, 1.0, 0.1, 0.98, 500.0), (3, 70.0, None, -3.0, 1.5, None), (4, -20.0, 9.0, None, None, -2000.0)]
    table = spark.createDataFrame(rows, f"id int, {', '.join(f'{v} double' for v in radar.VARIABLES)}")
    moments = {v: F.col(v) for v in radar.VARIABLES}
    for band in "X":
        x = radar.class_distances(moments, band)
        want = table.select("id", x.alias("x"), radar.class_shares(x, band).alias("s"), radar.class_entropy(radar.class_shares(x, band)).alias("e")).orderBy("id").collect()
        got = radar.with_shares(radar.with_distances(table, moments, band, "x"), "x", band, "s", "e").orderBy("id").collect()
        for a, b in zip(got, want, strict=True):
            assert (a.x, a.s, a.e) == ((None, None, None) if b.x is None else (pytest.approx(b.x), pytest.approx(b.s), pytest.approx(b.e)))


@pytest.mark.parametrize("weighted", [False, True])
def test_circles_across_tiles_send_cells_once(spark, weighted):
    values = {(y, x): float((y * 7 + x * 3) % 11) for y in range(-4, 5) for x in range(122, 136) if (y + x) % 5}
    grid = spark.createDataFrame([(y, x, v) for (y, x), v in values.items()], "iy int, ix int, v double")
    out = N.circle_mean(grid, [], 3, "v", weighted)
    got = {(r.iy, r.ix): r["mean"] for r in out.collect()}
    for y, x in values:
        near = [(w, values[y + a, x + b]) for a, b, w in N.kernel(3, weighted) if (y + a, x + b) in values]
        assert got[y, x] == pytest.approx(sum(w * v for w, v in near) / sum(w for w, _ in near))
    assert len(got) == len(values) and "Join" not in plan(out)
