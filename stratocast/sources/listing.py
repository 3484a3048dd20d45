"""Files and fields by cycle and lead: names decoded, newest and missing ones found, segments filled, states kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def cycles(files: DataFrame, column: str = "path") -> DataFrame:
    """files with cycle and lead decoded from names like YYYYMMDDHHMM.LLL.ext; other names go."""
    name = r"(\d{12})\.(\d{3,})\.[A-Za-z0-9]+$"
    got = files.withColumn("cycle", F.try_to_timestamp(F.regexp_extract(column, name, 1), F.lit("yyyyMMddHHmm"))).withColumn("lead", F.regexp_extract(column, name, 2).try_cast("int"))
    return got.where("cycle is not null and lead is not null")


def list_files(spark: SparkSession, folder: str, pattern: str = "*.nc") -> DataFrame:
    """path, size and changed of a folder's files, by Spark's own listing: no content is read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("changed"))


def newest(decoded: DataFrame, minutes: list[int] | None = None) -> DataFrame:
    """The files of the newest cycle that begins at one of the minutes."""
    allowed = decoded if minutes is None else decoded.where(F.minute("cycle").isin(minutes))
    return allowed.join(F.broadcast(allowed.agg(F.max("cycle").alias("cycle"))), "cycle")


def between(decoded: DataFrame, first: str, last: str) -> DataFrame:
    """The files of cycles from first to last."""
    return decoded.where(F.col("cycle").between(F.lit(first).cast("timestamp"), F.lit(last).cast("timestamp")))


def lacking(found: DataFrame, keys: list[str], lead: str, leads: list[int], strict: bool = False) -> DataFrame:
    """The leads that a key lacks; strict raises when the table is read and one is."""
    kind = found.schema[lead].dataType
    wanted = found.select(*keys).distinct().withColumn(lead, F.explode(F.array(*[F.lit(i).cast(kind) for i in leads])))
    out = wanted.join(found.select(*keys, lead).distinct(), [*keys, lead], "left_anti")
    if strict:  # beside the key, so that it is not looked at before the join has left the row
        out = out.groupBy(*keys, lead).agg(F.count("*").alias("n")).withColumn(lead, F.when(F.col("n") > 0, F.raise_error(F.concat(F.lit("missing lead "), F.col(lead).cast("string")))).cast(kind)).drop("n")
    return out


def segment_fields(found: DataFrame, horizon: dict[str, int], leads: list[int]) -> DataFrame:
    """v, lead, value for every variable and lead: missing ones stay null for long-range variables, 0 for short-range ones.

    A variable is short-range if its horizon is at most 72 hours; beyond its horizon it counts 0 whatever is there.
    """
    spark = found.sparkSession
    wanted = spark.createDataFrame([(v, lead, hours) for v, hours in horizon.items() for lead in leads], "v string, lead long, hours int")
    joined = wanted.join(found, ["v", "lead"], "left")
    value = F.when(F.col("lead") > F.col("hours"), 0.0).otherwise(F.coalesce("value", F.when(F.col("hours") <= 72, 0.0)))
    return joined.select("v", "lead", value.alias("value"))


def new_only(source: DataFrame, there: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are not there yet: what an idempotent copy still has to write."""
    return source.join(there.select(*keys).distinct(), keys, "left_anti")


def write_parts(table: DataFrame, path: str, by: list[str], overwrite: bool = True) -> None:
    """Partitions by the columns; with overwrite those that are written replace their former selves, others stay; else only new ones are written."""
    spark = table.sparkSession
    exists = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = exists.getFileSystem(spark._jsc.hadoopConfiguration()).exists(exists)
    rows = table if overwrite or not there else new_only(table, spark.read.parquet(path), by)
    rows.repartition(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def save_states(states: DataFrame, path: str, issued: str) -> None:
    """States by issue time; a repeated issue time replaces what it wrote before."""
    write_parts(states, path, [issued])


def latest_states(spark: SparkSession, path: str, keys: list[str], issued: str, before: int) -> DataFrame:
    """Each key's last state issued before a time: only the partitions before it are read."""
    w = Window.partitionBy(*keys).orderBy(F.desc(issued))
    rows = spark.read.parquet(path).where(F.col(issued) < before).withColumn("turn", F.row_number().over(w)).where("turn = 1").drop("turn")
    return rows.withColumn(issued, F.col(issued).cast("long"))
