"""Wide tables of observations and models, steps in a row, and functions fanned out over parameters."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Step = Callable[[DataFrame], DataFrame]


def combined(observed: DataFrame, models: dict[str, DataFrame], on: str = "valid", how: str = "outer", shift: dict[str, int] | None = None, operations: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """valid, id, ob and a column for each model, from rows (time, dtime hours, id, value) of observations and models.

    A model's rows meet the observation at time + dtime (+ its shift in hours); with on = "issue" rows keep their time and
    dtime too, so every lead stands apart. how: inner wants all of them, outer any, left the observation. operations are
    applied to values as they come in. Repeated rows of a source count once, the greatest value of those that differ. All
    sources go through one aggregation instead of a join each.
    """
    shift, operations = shift or {}, operations or {}
    names = ["ob", *models]
    parts = []
    for name, table in zip(names, [observed, *models.values()], strict=True):
        valid = F.col("time") + F.make_dt_interval(hours=F.col("dtime").cast("int") + F.lit(shift.get(name, 0)))
        value = operations.get(name, lambda c: c)(F.col("value"))
        lead = F.col("dtime").cast("int") if name != "ob" else F.lit(None).cast("int")
        parts.append(table.select(valid.alias("valid"), "id", lead.alias("dtime"), F.lit(name).alias("source"), value.cast("double").alias("value")))
    rows = reduce(DataFrame.unionByName, parts)
    each = [F.max(F.when(F.col("source") == n, F.col("value"))).alias(n) for n in names]
    if on == "issue":
        seen = rows.where("source = 'ob'").groupBy("valid", "id").agg(F.max("value").alias("ob"))
        wide = rows.where("source <> 'ob'").groupBy("valid", "id", "dtime").agg(*each[1:]).join(seen, ["valid", "id"], "left").select("valid", "id", "dtime", *names)
    else:
        wide = rows.groupBy("valid", "id").agg(*each)
    wanted = {"inner": names, "left": ["ob"], "outer": []}[how]
    return wide.dropna(subset=wanted) if wanted else wide


def in_turn(table: DataFrame, steps: Iterable[Step]) -> DataFrame:
    """The steps one after the other, each a function from table to table."""
    return reduce(lambda df, step: step(df), steps, table)


def weighted(df: DataFrame, keys: list[str], value: str, score: str, weight: Callable[[Column], Column]) -> DataFrame:
    """Mean of value by weights that a function makes of scores, over pairs that are whole; null where they sum to nothing."""
    w = F.when(F.col(value).isNotNull() & F.col(score).isNotNull(), weight(F.col(score)))
    return df.groupBy(*keys).agg((F.sum(w * F.col(value)) / F.when(F.abs(F.sum(w)) > 1e-12, F.sum(w))).alias("blend"))


def fanned_out(spark: SparkSession, function: Callable[..., pd.DataFrame], parameters: pd.DataFrame, schema: str, fixed: dict | None = None, tasks: int | None = None) -> DataFrame:
    """What function(**row, **fixed) returns for every row of parameters, one after the other: Spark deals the rows out and repeats what is lost."""
    fixed = fixed or {}

    def run(batches):
        for rows in batches:
            for row in rows.to_dict("records"):
                yield function(**row, **fixed)

    return spark.createDataFrame(parameters).repartition(tasks or max(len(parameters), 1)).mapInPandas(run, schema)
