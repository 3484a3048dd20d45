"""Tables against tables: arithmetic by key, checks of axes and leads, pairing, filling, accumulation and extremes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def cellwise(one: DataFrame, two: DataFrame, keys: list[str], value: str, how: str) -> DataFrame:
    """Both tables' values by key joined by how: add, subtract, multiply."""
    other = two.select(*keys, F.col(value).alias("other"))
    a, b = F.col(value), F.col("other")
    return one.join(other, keys).select(*keys, {"add": a + b, "subtract": a - b, "multiply": a * b}[how].alias(value))


def updated(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """old with new's value where new has the key and a value."""
    return old.join(new.select(*keys, F.col(value).alias("newer")), keys, "left").withColumn(value, F.coalesce("newer", value)).drop("newer")


def thinned(grid: DataFrame, mask: str, every: int) -> DataFrame:
    """Every `every`-th cell of rows and columns where the mask is negative."""
    return grid.where((F.col("iy") % every == 0) & (F.col("ix") % every == 0) & (F.col(mask) < 0))


def masked(grid: DataFrame, value: str, mask: str) -> DataFrame:
    """0 where the mask is not positive."""
    return grid.withColumn(value, F.when(F.col(mask) <= 0, 0.0).otherwise(F.col(value)))


def from_vectors(vectors: DataFrame, keys: list[str], lon: str, lat: str, value: str) -> DataFrame:
    """A row for each place of the arrays lon, lat and value."""
    zipped = F.arrays_zip(F.col(lon).alias("lon"), F.col(lat).alias("lat"), F.col(value).alias("value"))
    return vectors.select(*keys, F.posexplode(zipped).alias("at", "z")).select(*keys, "at", "z.lon", "z.lat", "z.value")


def block_edges(left: Column, right: Column, step: float = 5.0) -> Column:
    """Array of (lower, upper) of the blocks that multiples of step cut [left, right] into; none if it is empty."""
    first = F.floor(left / step) + 1
    inner = F.transform(F.sequence(first, F.greatest(F.ceil(right / step) - 1, first - 1)), lambda i: i * step)
    inner = F.filter(inner, lambda x: (x > left) & (x < right))
    lower, upper = F.concat(F.array(left), inner), F.concat(inner, F.array(right))
    return F.when(left < right, F.arrays_zip(lower.alias("lower"), upper.alias("upper"))).otherwise(F.array().cast("array<struct<lower:double,upper:double>>"))


def only_on_one_side(one: DataFrame, two: DataFrame, axes: list[str], tolerance: float = 1e-3) -> DataFrame:
    """Coordinates that only one of two tables has, and on which side: none if their axes agree within the tolerance."""
    cells = lambda df: df.select(*[F.round(F.col(a) / tolerance).cast("long").alias(a) for a in axes]).distinct()
    a, b = cells(one), cells(two)
    sides = a.exceptAll(b).withColumn("side", F.lit("first")).unionByName(b.exceptAll(a).withColumn("side", F.lit("second")))
    return sides.select(*[(F.col(c) * tolerance).alias(c) for c in axes], "side")


def not_contained(one: DataFrame, two: DataFrame, valid: list[str]) -> DataFrame:
    """Valid times of the first table that the second lacks."""
    return one.select(*valid).distinct().join(two.select(*valid).distinct(), valid, "left_anti")


def first_pairs(forecast: DataFrame, truth: DataFrame, valid: str, keys: list[str], order: list[str]) -> DataFrame:
    """Forecast and truth at one valid time and key; of several forecasts the first in order; times without any value go."""
    first = forecast.withColumn("turn", F.row_number().over(Window.partitionBy(*keys, valid).orderBy(*order))).where("turn = 1").drop("turn")
    pairs = first.join(truth, [*keys, valid])
    times = pairs.groupBy(valid).agg(F.count("forecast").alias("f"), F.count("truth").alias("t")).where("f > 0 and t > 0").select(valid)
    return pairs.join(times, valid, "left_semi")


def mixed_leads(table: DataFrame, source: str, lead: str, cycle: str) -> DataFrame:
    """Sources with more than one lead or cycle hour: none if their forecasts agree."""
    return table.groupBy(source).agg(F.count_distinct(lead).alias("leads"), F.count_distinct(F.hour(cycle)).alias("cycle_hours")).where("leads > 1 or cycle_hours > 1")


def with_observed(stations: DataFrame, observed: DataFrame, key: str, value: str) -> DataFrame:
    """All stations with their observation; 0 where there is none."""
    return stations.join(observed.select(key, value), key, "left").withColumn(value, F.coalesce(F.when(~F.isnan(value), F.col(value)), F.lit(0.0)))


def pairs_by_cycle(one: DataFrame, two: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(pairs by cycle and lead, keys that lack the other side and which one)."""
    lacks = one.select(*keys).join(two, keys, "left_anti").withColumn("lacking", F.lit("second"))
    return one.join(two, keys), lacks.unionByName(two.select(*keys).join(one, keys, "left_anti").withColumn("lacking", F.lit("first")))


def collapsed(table: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean and variance (over n - 1) over all axes but keys."""
    return table.groupBy(*keys).agg(F.avg(value).alias("mean"), F.var_samp(value).alias("variance"))


def nearest_level(table: DataFrame, keys: list[str], level: str, target: float, within: float = 0.1) -> DataFrame:
    """The row of each key whose level is nearest to the target, at most `within` away; ties to the lower one."""
    away = F.abs(F.col(level) - target)
    ranked = table.where(away <= within).withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(away, level)))
    return ranked.where("place = 1").drop("place")


def availability(wanted: DataFrame, found: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """How many of the wanted keys are there, by group."""
    flags = wanted.join(found.select(*keys).distinct().withColumn("there", F.lit(1)), keys, "left")
    return flags.groupBy(*by).agg(F.count("*").alias("wanted"), F.sum(F.coalesce("there", F.lit(0))).alias("found"))


def run_times(spark: SparkSession, first: str, last: str, hours: list[int]) -> DataFrame:
    """Cycle times of all days from first to last."""
    days = spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(first)), F.to_date(F.lit(last)))).alias("day"))
    return days.select(F.explode(F.transform(F.array(*map(F.lit, hours)), lambda h: F.col("day").cast("timestamp") + F.make_dt_interval(hours=h))).alias("cycle"))


def window_extremes(table: DataFrame, keys: list[str], lead: str, value: str, hours: int = 24, correction: Column | None = None) -> DataFrame:
    """Greatest and least value of each window of `hours` leads, corrected before."""
    v = F.col(value) if correction is None else F.col(value) + correction
    return table.groupBy(*keys, F.ceil(F.col(lead) / hours).cast("int").alias("window")).agg(F.max(v).alias("greatest"), F.min(v).alias("least"))


def accumulated(table: DataFrame, keys: list[str], value: str, parts: int, missing: float = 9999.0) -> DataFrame:
    """Sum of all parts of each key; null where one is missing or marked so."""
    whole = (F.count(value) == parts) & (F.max(F.coalesce(F.col(value) == missing, F.lit(False)).cast("int")) == 0)
    return table.groupBy(*keys).agg(F.when(whole, F.sum(value)).alias("total"))


def equal_steps(table: DataFrame, keys: list[str], time: str) -> DataFrame:
    """Each series' number of different steps and its least one: a series is regular with one."""
    w = Window.partitionBy(*keys).orderBy(time)
    steps = table.select(*keys, (F.col(time) - F.lag(time).over(w)).alias("step")).where("step is not null")
    return steps.groupBy(*keys).agg(F.count_distinct("step").alias("steps"), F.min("step").alias("least"))


def last_rows(table: DataFrame, keys: list[str], order: list[str], places: list[str] | None = None) -> DataFrame:
    """Of rows with equal keys the last in order; of those that are equal in it the first by `places`, such as those of a scan."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order], *(places or []))
    return table.withColumn("turn", F.row_number().over(w)).where("turn = 1").drop("turn")


def chunked_rows(table: DataFrame, keys: list[str], order: str, n: int, value: str) -> DataFrame:
    """Each key's values in order, as text, in rows of n (chunk from 0, the last one shorter): no array holds a whole key."""
    placed = table.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1)
    chunks = placed.groupBy(*keys, F.floor(F.col("n") / n).cast("int").alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("n", F.col(value).cast("string").alias("x")))).alias("x"))
    return chunks.select(*keys, "chunk", F.col("x.x").alias(value))


def stacked(tables: list[DataFrame], distinct: bool = True) -> DataFrame:
    """All tables' rows, columns that one lacks as null; each different row once."""
    out = tables[0]
    for more in tables[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out.dropDuplicates() if distinct else out


def valid_on_both(forecast: DataFrame, truth: DataFrame, key: str, value: str) -> DataFrame:
    """Stations with a value on both sides."""
    there = lambda df: df.where(F.col(value).isNotNull() & ~F.isnan(value)).select(key)
    return there(forecast).intersect(there(truth))


def as_members(percentiles: DataFrame, keys: list[str]) -> DataFrame:
    """Percentiles in ascending order renumbered as members from 0."""
    w = Window.partitionBy(*keys).orderBy("percentile")
    return percentiles.withColumn("member", (F.row_number().over(w) - 1).cast("int")).drop("percentile")


def dense(table: DataFrame, dims: DataFrame, keys: list[str], fill: float | None = None) -> DataFrame:
    """A row for each key of dims, with fill for the values the table lacks."""
    values = [c for c in table.columns if c not in keys]
    out = dims.select(*keys).join(table, keys, "left")
    return out.select(*keys, *[F.coalesce(F.col(c), F.lit(fill)).alias(c) for c in values])


def background(spark: SparkSession, lon: tuple[float, float, float], lat: tuple[float, float, float], value: float = 0.0) -> DataFrame:
    """iy, ix, lat, lon, value of an empty regular grid; lon and lat are (first, last, step)."""
    count = lambda a: int(round((a[1] + 1e-5 - a[0]) / a[2])) + 1
    nx = count(lon)
    cells = spark.range(count(lat) * nx).select(F.floor(F.col("id") / nx).cast("int").alias("iy"), (F.col("id") % nx).cast("int").alias("ix"))
    return cells.select("iy", "ix", (F.lit(lat[0]) + F.col("iy") * lat[2]).alias("lat"), (F.lit(lon[0]) + F.col("ix") * lon[2]).alias("lon"), F.lit(float(value)).alias("value"))


def seeded_order(table: DataFrame, keys: list[str], value: str, seed: int = 0) -> DataFrame:
    """Each key's values in ascending order, equal ones in a seeded random order."""
    w = Window.partitionBy(*keys).orderBy(value, F.xxhash64(F.lit(seed), *[F.col(c) for c in table.columns]))
    return table.withColumn("place", F.row_number().over(w))


def padded_cycle(fused: DataFrame, observed: DataFrame, model: DataFrame, keys: list[str], lead: str, value: str, first: int, last: int, step: int) -> DataFrame:
    """Every lead from first to last: the fused value; before lead 1 else the observed one, after it else the model's."""
    wanted = fused.select(*keys).distinct().withColumn(lead, F.explode(F.sequence(F.lit(first), F.lit(last), F.lit(step))))
    named = lambda df, name: df.select(*keys, lead, F.col(value).alias(name))
    out = wanted.join(named(fused, "own"), [*keys, lead], "left").join(named(observed, "seen"), [*keys, lead], "left").join(named(model, "model"), [*keys, lead], "left")
    return out.select(*keys, lead, F.coalesce("own", F.when(F.col(lead) <= 0, F.col("seen")).otherwise(F.col("model"))).alias(value))


def corrected_by_last(forecast: DataFrame, errors: DataFrame, keys: list[str], time: str, value: str) -> DataFrame:
    """Forecasts less the latest error mean (time, me) not after them; unchanged where there is none.

    One window over both tables by key carries the error forward: no join on ranges.
    """
    both = forecast.select(*keys, time, value, F.lit(None).cast("double").alias("me"), F.lit(1).alias("side")).unionByName(
        errors.select(*keys, time, F.lit(None).cast("double").alias(value), F.col("me").cast("double").alias("me"), F.lit(0).alias("side"))
    )
    w = Window.partitionBy(*keys).orderBy(time, "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = both.withColumn("latest", F.last("me", ignorenulls=True).over(w)).where("side = 1")
    return carried.select(*keys, time, (F.col(value) - F.coalesce("latest", F.lit(0.0))).alias(value))


def error_means(pairs: DataFrame, keys: list[str], time: str, error: str, alpha: float, absolute: bool = False) -> DataFrame:
    """The running mean ME = (1 - alpha) ME + alpha e after every pair of each series; missing pairs leave it as it was."""
    e = F.abs(error) if absolute else F.col(error)
    series = pairs.where(F.col(error).isNotNull()).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(time).alias("t"), e.alias("e")))).alias("s"))
    grown = F.aggregate(
        F.slice("s", 2, F.size("s")),
        F.array(F.struct(F.col("s")[0]["t"].alias("t"), F.col("s")[0]["e"].cast("double").alias("me"))),
        lambda done, x: F.concat(done, F.array(F.struct(x["t"].alias("t"), ((1 - alpha) * F.element_at(done, -1)["me"] + alpha * x["e"]).alias("me")))),
    )
    return series.select(*keys, F.inline(grown)).withColumnRenamed("t", time)


def extrapolated_leads(table: DataFrame, keys: list[str], lead: str, value: str, at: list[int]) -> DataFrame:
    """Values at other leads: linear between known ones, along the first or last slope beyond them."""
    w = Window.partitionBy(*keys).orderBy(lead)
    nxt = table.withColumn("l1", F.lead(lead).over(w)).withColumn("v1", F.lead(value).over(w)).where("l1 is not null")
    ends = nxt.withColumn("first", F.row_number().over(w) == 1).withColumn("last", F.lead(lead).over(w).isNull())
    points = ends.withColumn("q", F.explode(F.array(*map(F.lit, at))))
    here = (F.col("q") > F.col(lead)) & (F.col("q") <= F.col("l1")) | F.col("first") & (F.col("q") <= F.col(lead)) | F.col("last") & (F.col("q") > F.col("l1"))
    slope = (F.col("v1") - F.col(value)) / (F.col("l1") - F.col(lead))
    return points.where(here).select(*keys, F.col("q").alias(lead), (F.col(value) + (F.col("q") - F.col(lead)) * slope).alias(value))


def sweeps(volumes: DataFrame, keys: list[str], start: str, end: str, angle: str, nyquist: str) -> DataFrame:
    """A row for each ray of a volume from its arrays of sweep starts, ends, angles and Nyquist speeds."""
    zipped = F.arrays_zip(*[F.col(c).alias(n) for c, n in ((start, "a"), (end, "b"), (angle, "angle"), (nyquist, "nyquist"))])
    rows = volumes.select(*keys, F.posexplode(zipped).alias("sweep", "z"))
    return rows.select(*keys, "sweep", F.explode(F.sequence(F.col("z.a"), F.col("z.b"))).alias("ray"), "z.angle", "z.nyquist")
