"""Every query with SQL equals DuckDB's rows on the smallest tables; weather rules give the published codes."""

import math
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from stratocast import catalog, catalog_cleaning  # noqa: F401
from stratocast.operators import phenomena, relational

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SMALL):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SMALL}/{f}'")
    return c


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, abs_tol=1.1e-4, rel_tol=1e-9)
    return a == b


def order(row):
    return tuple((x is None, f"{x:.2f}" if isinstance(x, float) else str(x)) for x in row)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equals_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SMALL)
    columns = sorted(got.columns)
    rows = sorted((tuple(r[c] for c in columns) for r in got.collect()), key=order)
    found = duck.sql(catalog.ORACLES[name])
    assert sorted(found.columns) == columns
    want = sorted(found.select(*[f'"{c}"' for c in columns]).fetchall(), key=order)
    assert len(rows) == len(want)
    for a, b in zip(rows, want, strict=True):
        assert all(map(same, a, b)), (a, b)


def test_flagship(spark):
    assert __spark_entry__.entry(spark).count() > 0


def steps(spark, rows):
    names = "cell step r03 ptype tcc fog haze sand thunder hail".split()
    return spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], ", ".join(f"{n} {'int' if n in ('cell', 'step') else 'double'}" for n in names))


@pytest.mark.parametrize(
    "rows,code",
    [
        ([(0.0, 0.0, 95.0, 0.0, 0.0, 0.0, 0.0, 0.0)] * 2 + [(1.0, 1.0, 60.0, 0.0, 0.0, 0.0, 0.0, 0.0)] * 2, "20702"),
        ([(0.0, 0.0, 95.0, 0.0, 0.0, 0.0, 0.0, 0.0)] * 3 + [(1.0, 1.0, 60.0, 0.0, 0.0, 0.0, 0.0, 0.0)], "20207"),
        ([(0.0, 0.0, 20.0, 0.0, 0.0, 0.0, 0.0, 0.0)] * 3 + [(0.0, 0.0, 60.0, 0.0, 0.0, 0.0, 0.0, 0.0)], "20001"),
        ([(0.0, 0.0, 20.0, 0.0, 2.0, 0.0, 0.0, 0.0)] + [(0.0, 0.0, 20.0, 1.0, 0.0, 0.0, 0.0, 0.0)] * 3, "35661"),
        ([(0.0, 0.0, 60.0, 0.0, 0.0, 0.0, 0.0, 0.0)] * 4, "00101"),
        ([(None, None, None, None, None, None, None, None)] * 4, "00101"),
    ],
)
def test_published_codes(spark, rows, code):
    assert phenomena.code_weather(steps(spark, rows), ["cell"]).first().code == code


def test_decaying_mean_is_the_recurrence(spark):
    df = spark.createDataFrame([(1, t, e) for t, e in enumerate([1.0, 3.0, None, 5.0])], "id int, t int, e double")
    assert relational.decaying_mean(df, ["id"], ["t"], "e", 0.1).first().me == pytest.approx(1.58)


def test_imports_without_llm(tmp_path):
    """A copy of the tree without the two folders and the pipeline's module lists the other queries."""
    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "stratocast", tmp_path / "stratocast", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'phenomenon_codes' in q and not any(n.startswith('op') for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
