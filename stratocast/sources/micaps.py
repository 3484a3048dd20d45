"""MICAPS text formats: stations (3) and grids (4), and raw masks, read and written as tables."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratocast.functions.cleaning import in_box


def read_stations(spark: SparkSession, path: str) -> DataFrame:
    """file, id, lon, lat, alt, value: the lines of exactly five numbers of station files."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), parts.alias("p")).where(F.size("p") == 5)
    names = ("id", "lon", "lat", "alt", "value")
    typed = rows.select("file", *[F.expr(f"try_cast(p[{i}] AS {'bigint' if i == 0 else 'double'})").alias(n) for i, n in enumerate(names)])
    return typed.where("id is not null and value is not null")


def read_grid(spark: SparkSession, path: str) -> DataFrame:
    """file, lead, level, iy, ix, lat, lon, value of grid files: 22 header tokens, then rows of nlon values from lat0 on."""
    t = F.split(F.regexp_replace("value", r"^\s+|\s+$", ""), r"\s+")
    number = lambda i: F.element_at("t", i + 1).cast("double")
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), t.alias("t")).where(F.size("t") > 22)
    head = files.select("file", number(7).cast("int").alias("lead"), number(8).alias("level"), *[number(i).alias(n) for i, n in ((9, "dlon"), (10, "dlat"), (11, "lon0"), (13, "lat0"), (15, "nlon"))], F.slice("t", 23, F.size("t") - 22).alias("v"))
    cells = head.select("*", F.posexplode("v").alias("at", "text"))
    iy, ix = F.floor(F.col("at") / F.col("nlon")).cast("int"), (F.col("at") % F.col("nlon")).cast("int")
    return cells.select("file", "lead", "level", iy.alias("iy"), ix.alias("ix"), (F.col("lat0") + iy * F.col("dlat")).alias("lat"), (F.col("lon0") + ix * F.col("dlon")).alias("lon"), F.col("text").cast("double").alias("value"))


def station_list(spark: SparkSession, path: str, kind: str = "m3") -> DataFrame:
    """id (text), lon, lat, value of station lists: info (id lon lat), data (id lon lat value) or m3 (five fields, value last).

    Of lines that repeat a file's id the first counts. Lines of another shape are passed over.
    """
    least, value, exact = {"info": (3, None, False), "data": (4, 3, False), "m3": (5, 4, True)}[kind]
    parts = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("line", "value"))
    rows = lines.select("file", "line", parts.alias("p")).where(F.size("p") == least if exact else F.size("p") >= least)
    number = lambda i: F.expr(f"try_cast(p[{i}] AS double)")
    typed = rows.select("file", "line", F.col("p")[0].alias("id"), number(1).alias("lon"), number(2).alias("lat"), (F.lit(0.0) if value is None else number(value)).alias("value")).where("lon is not null and lat is not null")
    return typed.groupBy("file", "id").agg(F.min_by(F.struct("lon", "lat", "value"), "line").alias("s")).select("file", "id", "s.*")


def ascending(grid: DataFrame) -> DataFrame:
    """A read grid with iy counted from the south, whatever the order of its file."""
    by = Window.partitionBy("file")
    n = F.max("iy").over(by)
    down = F.max_by("lat", "iy").over(by) < F.min_by("lat", "iy").over(by)
    return grid.withColumn("iy", F.when(down, n - F.col("iy")).otherwise(F.col("iy")))


def header(line: Column) -> Column:
    """The typed fields of a grid header of at least 18 tokens, as a struct; null for other lines."""
    t = F.split(F.trim(line), r"\s+")
    number = lambda i, kind="double": F.get(t, F.lit(i)).try_cast(kind)
    year = number(3, "int")
    time = F.try_make_timestamp(F.when(year < 50, year + 2000).when(year < 100, year + 1900).otherwise(year), number(4, "int"), number(5, "int"), number(6, "int"), F.lit(0), F.lit(0))
    fields = [F.get(t, F.lit(2)).alias("title"), time.alias("issue"), number(7, "int").alias("lead"), number(8).alias("level")]
    fields += [number(9 + i).alias(n) for i, n in enumerate(("dlon", "dlat", "lon0", "lon1", "lat0", "lat1"))] + [number(15, "int").alias("nlon"), number(16, "int").alias("nlat")]
    return F.when((F.size(t) >= 18) & (F.lower(F.get(t, F.lit(0))) == "diamond") & (F.get(t, F.lit(1)) == "4"), F.struct(*fields))


def _one_file(lines: DataFrame, path: str) -> None:
    """Lines (place, value) as one text file, in order: a sorted partition streams through Spark's writer."""
    lines.repartition(1).sortWithinPartitions("place").select("value").write.mode("overwrite").text(path)


def write_stations(stations: DataFrame, path: str, title: str, box: tuple[float, float, float, float] | None = None, least: float | None = None) -> None:
    """One station file: three header lines, then id, lon, lat, alt and value by id; only those in the box and from `least` on."""
    rows = stations.where("value is not null")
    if box:
        rows = rows.where(in_box(F.col("lon"), F.col("lat"), *box))
    if least is not None:
        rows = rows.where(F.col("value") >= least)
    line = F.concat_ws(" ", F.col("id").cast("string"), *[F.format_string("%.4f", F.col(c)) for c in ("lon", "lat", "alt", "value")])
    place = lambda i: F.struct(F.lit(i).alias("part"), F.lit("").alias("id")).alias("place")
    body = rows.select(F.struct(F.lit(1).alias("part"), F.lpad(F.col("id").cast("string"), 20, "0").alias("id")).alias("place"), line.alias("value"))
    head = rows.agg(F.format_string(f"diamond 3 {title}\n0 0 0 0 0 0 0 0\n1 %d", F.count("*")).alias("value")).select(place(0), "value")
    _one_file(head.unionByName(body), path)


def write_grid(grid: DataFrame, path: str, title: str, issue, lead: int, level: float = 0.0, digits: int = 4) -> None:
    """One grid file from iy, ix, lat, lon, value: a header of 22 tokens, then a line for each row of the grid from the south."""
    axis = grid.agg(*[f(c).alias(n) for c in ("lat", "lon") for f, n in ((F.min, f"{c}0"), (F.max, f"{c}1"))], (F.max("iy") + 1).alias("ny"), (F.max("ix") + 1).alias("nx"))
    step = lambda c, n: F.round((F.col(f"{c}1") - F.col(f"{c}0")) / F.greatest(F.col(n) - 1, F.lit(1)), 6)
    tokens = [F.lit(f"diamond 4 {title} {issue:%Y %m %d %H} {lead} {level:g}"), step("lon", "nx"), step("lat", "ny"), *map(F.col, ("lon0", "lon1", "lat0", "lat1")), F.col("nx"), F.col("ny"), F.lit("1 0 9 1 0")]
    head = axis.select(F.lit(-1).alias("place"), F.concat_ws(" ", *[t.cast("string") for t in tokens]).alias("value"))
    cells = F.array_sort(F.collect_list(F.struct("ix", F.format_string(f"%.{digits}f", F.col("value").cast("double")).alias("v"))))  # one row of the grid
    body = grid.groupBy(F.col("iy").alias("place")).agg(F.concat_ws(" ", F.transform(cells, lambda c: c["v"])).alias("value"))
    _one_file(head.unionByName(body), path)


def read_mask(spark: SparkSession, path: str, nlon: int) -> DataFrame:
    """file, iy, ix, value of raw little-endian float32 rows of nlon cells."""

    def cells(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                values = np.frombuffer(content, "<f4")
                at = np.arange(len(values))
                for a in range(0, len(values), 1 << 20):
                    part = slice(a, a + (1 << 20))
                    columns = [pa.array([name] * len(at[part])), pa.array((at[part] // nlon).astype(np.int32)), pa.array((at[part] % nlon).astype(np.int32)), pa.array(values[part])]
                    yield pa.RecordBatch.from_arrays(columns, names=["file", "iy", "ix", "value"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(cells, "file string, iy int, ix int, value float")


def write_mask(grid: DataFrame, folder: str, name: str) -> None:
    """value by iy and ix as raw float32 rows in one file of a mounted folder, written aside and moved into place."""

    def write(batches):
        os.makedirs(folder, exist_ok=True)
        partial, n = f"{folder}/.{name}.{os.getpid()}", 0
        with open(partial, "wb") as f:
            for batch in batches:
                values = batch.column(0).to_numpy(zero_copy_only=False).astype("<f4")
                f.write(values.tobytes())
                n += len(values)
        os.replace(partial, f"{folder}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    grid.repartition(1).sortWithinPartitions("iy", "ix").select("value").mapInArrow(write, "n long").collect()


def templated_path(template: str, time, lead: int) -> str:
    """YYYY, MM, DD, HH and VVV of a path template filled in."""
    return template.replace("YYYY", f"{time:%Y}").replace("MM", f"{time:%m}").replace("DD", f"{time:%d}").replace("HH", f"{time:%H}").replace("VVV", f"{lead:03d}")
