"""The driver's tables seen as weather tables, by the same rules in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


PLACES = ["file", "row"]


def table_in_order(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table with each row's place in its scan: PLACES, its file and its number in it."""
    rows = table(spark, sf_dir, name)
    hidden = rows.metadataColumn("_metadata")
    return rows.select("*", hidden["file_path"].alias("file"), hidden["row_index"].alias("row"))


def moments(spark: SparkSession, sf_dir: str, in_order: bool = False) -> DataFrame:
    """Line items as radar gates and surface values: key columns ok and ln, then refl, kdp, att, hydro, t, w, rh; in_order adds PLACES."""
    return (table_in_order if in_order else table)(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("ok"), F.col("l_linenumber").alias("ln"), F.col("l_quantity").alias("refl"), (F.col("l_discount") * 10).alias("kdp"), F.col("l_tax").alias("att"),
        (1 + F.col("l_linenumber") % 9).alias("hydro"), (F.col("l_quantity") - 20).alias("t"), (1 + F.col("l_tax") * 100).alias("w"), (F.col("l_discount") * 5 + 0.3).alias("rh"),
        *(PLACES if in_order else []),
    )


MOMENTS = """(SELECT l_orderkey AS ok, l_linenumber AS ln, l_quantity AS refl, l_discount * 10 AS kdp, l_tax AS att, 1 + l_linenumber % 9 AS hydro,
    l_quantity - 20 AS t, 1 + l_tax * 100 AS w, l_discount * 5 + 0.3 AS rh FROM lineitem)"""


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 20 x 20 field: iy, ix, v (greatest quantity), z (terrain, from part sizes)."""
    at = lambda c: [(F.floor(F.col(c) / 20) % 20).cast("int").alias("iy"), (F.col(c) % 20).cast("int").alias("ix")]
    v = table(spark, sf_dir, "lineitem").select(*at("l_partkey"), "l_quantity", "l_suppkey").groupBy("iy", "ix").agg((F.max("l_quantity") - F.min("l_quantity") + F.countDistinct("l_suppkey") % 7).cast("double").alias("v"))
    z = table(spark, sf_dir, "part").select(*at("p_partkey"), "p_size").groupBy("iy", "ix").agg((F.max("p_size") * 3).cast("double").alias("z"))
    return v.join(z, ["iy", "ix"])


GRID = """(SELECT iy, ix, v, z FROM
    (SELECT CAST((l_partkey // 20) % 20 AS INTEGER) AS iy, CAST(l_partkey % 20 AS INTEGER) AS ix, CAST(max(l_quantity) - min(l_quantity) + count(DISTINCT l_suppkey) % 7 AS DOUBLE) AS v FROM lineitem GROUP BY 1, 2)
    JOIN (SELECT CAST((p_partkey // 20) % 20 AS INTEGER) AS iy, CAST(p_partkey % 20 AS INTEGER) AS ix, CAST(max(p_size) * 3 AS DOUBLE) AS z FROM part GROUP BY 1, 2) USING (iy, ix))"""


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field that grows with the tables: 700 columns, seven for each order; iy, ix, v (quantity, null where there is no item) and z (from the part)."""
    cell = lambda key, number: [F.floor(F.col(key) / 100).cast("int").alias("iy"), (F.col(key) % 100 * 7 + number).cast("int").alias("ix")]
    cells = table(spark, sf_dir, "orders").select("o_orderkey", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("k")).select(*cell("o_orderkey", F.col("k")))
    items = table(spark, sf_dir, "lineitem").select(*cell("l_orderkey", F.col("l_linenumber") % 7), "l_quantity", "l_partkey")
    return cells.join(items.groupBy("iy", "ix").agg(F.max("l_quantity").alias("v"), F.max(F.col("l_partkey") % 300).cast("double").alias("z")), ["iy", "ix"], "left")


WIDE = """(SELECT iy, ix, v, z FROM (SELECT CAST(o_orderkey // 100 AS INTEGER) AS iy, CAST(o_orderkey % 100 * 7 + k AS INTEGER) AS ix FROM orders, range(7) r(k)) LEFT JOIN
    (SELECT CAST(l_orderkey // 100 AS INTEGER) AS iy, CAST(l_orderkey % 100 * 7 + l_linenumber % 7 AS INTEGER) AS ix, max(l_quantity) AS v, CAST(max(l_partkey % 300) AS DOUBLE) AS z FROM lineitem GROUP BY 1, 2) USING (iy, ix))"""


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily sums of line items by supplier: id, day (days since 1970), v."""
    day = F.datediff(F.to_date("l_shipdate"), F.lit("1970-01-01")).cast("long").alias("day")
    return table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 40).alias("id"), day).agg(F.sum("l_quantity").alias("v"))


SERIES = "(SELECT l_suppkey % 40 AS id, date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS day, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2)"


def models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecasts f and observations o (mm) of models m: a block is a supplier modulo 30."""
    return table(spark, sf_dir, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("m"), (F.col("l_suppkey") % 30).alias("block"), F.col("l_quantity").alias("f"), (F.col("l_partkey") % 51).cast("double").alias("o"), "l_orderkey", "l_linenumber"
    )


MODELS = "(SELECT l_returnflag || l_linestatus AS m, l_suppkey % 30 AS block, l_quantity AS f, CAST(l_partkey % 51 AS DOUBLE) AS o, l_orderkey, l_linenumber FROM lineitem)"


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as stations in cell units: id, sy, sx, value."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k.alias("id"), ((k * 13 % 190) / 10.0).alias("sy"), ((k * 7 % 190) / 10.0).alias("sx"), (k * 37 % 101).cast("double").alias("value"))


STATIONS = "(SELECT s_suppkey AS id, (s_suppkey * 13 % 190) / 10.0::DOUBLE AS sy, (s_suppkey * 7 % 190) / 10.0::DOUBLE AS sx, CAST(s_suppkey * 37 % 101 AS DOUBLE) AS value FROM supplier)"


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as 64-member ensembles: id, member, value."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.posexplode("embedding").alias("member", "x")).select("id", "member", F.col("x").cast("double").alias("value"))


MEMBERS = "(SELECT vec_id AS id, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS member, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings)"


def weather_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as 3-hourly weather: cell (part), step 0 to 3 and the eight fields."""
    q, n = F.max("l_quantity"), F.count("*")
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy((F.col("l_partkey") % 997).alias("cell"), (F.col("l_linenumber") % 4).alias("step"))
        .agg(
            F.when(q % 3 == 0, 0.0).otherwise(q * (1 + F.min("l_linenumber")) / 8).alias("r03"), (F.max("l_suppkey") % 5).alias("ptype"), (q * 2).alias("tcc"), (n % 6).alias("fog"), (F.min("l_suppkey") % 5).alias("haze"),
            F.when(F.max("l_orderkey") % 11 == 0, n % 4).otherwise(0).alias("sand"), (F.max("l_orderkey") % 3 == 0).cast("int").alias("thunder"), (F.min("l_orderkey") % 7 == 0).cast("int").alias("hail"),
        )
    )


STEPS = """(SELECT l_partkey % 997 AS cell, l_linenumber % 4 AS step, CASE WHEN max(l_quantity) % 3 = 0 THEN 0.0 ELSE max(l_quantity) * (1 + min(l_linenumber)) / 8 END AS r03,
    max(l_suppkey) % 5 AS ptype, max(l_quantity) * 2 AS tcc, count(*) % 6 AS fog, min(l_suppkey) % 5 AS haze, CASE WHEN max(l_orderkey) % 11 = 0 THEN count(*) % 4 ELSE 0 END AS sand,
    CAST(max(l_orderkey) % 3 = 0 AS INTEGER) AS thunder, CAST(min(l_orderkey) % 7 = 0 AS INTEGER) AS hail FROM lineitem GROUP BY 1, 2)"""
