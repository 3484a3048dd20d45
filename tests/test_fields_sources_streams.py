"""Field kernels, text formats and keyed state."""

import numpy as np
import pytest

from stratocast import catalog
from stratocast.operators import fields
from stratocast.sources import micaps
from stratocast.streaming import state


def test_kernels():
    rng = np.random.default_rng(0)
    f = rng.random((8, 10))
    assert np.allclose(fields.cascade(f, 4).sum(axis=0), f)
    plane = np.add.outer(np.arange(6.0), 2 * np.arange(7.0))
    assert np.allclose(fields.smooth9(3)(plane), plane)
    assert np.allclose(fields.advect(1.0, 0.0)(f)[:, 1:], f[:, :-1])
    assert len(np.unique(fields.labelled(0.5)(np.array([[1.0, 0, 1], [1, 0, 1], [0, 0, 1]])))) == 3


@pytest.mark.parametrize("name", ["smooth9_fields", "cascade_fields", "advected_fields", "labelled_fields"])
def test_field_queries(spark, small, name):
    assert catalog.QUERIES[name](spark, small).count() == 500 * 64


def test_station_text_round_trip(spark, tmp_path):
    rows = [(54511, 116.4, 39.9, 31.0, 1.5), (54512, 117.0, 40.0, 10.0, 0.0)]
    df = spark.createDataFrame(rows, "id long, lon double, lat double, alt double, value double")
    micaps.write_stations(df, f"{tmp_path}/s", "test")
    assert sorted(tuple(r)[1:] for r in micaps.read_stations(spark, f"{tmp_path}/s").collect()) == rows


def test_grid_text(spark, tmp_path):
    head = "diamond 4 t 2026 3 1 0 24 850 0.5 0.5 100 101 20 20.5 3 2 1 0 9 1 0"
    (tmp_path / "g.txt").write_text(f"{head}\n1 2 3\n4 5 6\n")
    got = {(r.iy, r.ix): (r.lat, r.lon, r.value, r.lead) for r in micaps.read_grid(spark, f"{tmp_path}/g.txt").collect()}
    assert got[1, 2] == (20.5, 101.0, 6.0, 24) and len(got) == 6


def test_state_follows_the_recurrence(spark, tmp_path):
    schema = "id long, ts long, error double"
    for n, rows in enumerate([[(1, 0, 1.0), (1, 1, 3.0), (2, 0, 7.0)], [(1, 2, 5.0), (1, 3, None)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/b{n}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{tmp_path}/in/*")
    q = state.decaying_means(stream, 0.1).writeStream.format("memory").queryName("means").outputMode("update").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    got = [(r.id, round(r.me, 6)) for r in spark.table("means").collect()]
    assert (1, 1.58) in got and (2, 7.0) in got
