"""Joins, verification, recurrences, windows, stencils and quantile maps as DataFrame operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def pair_on_valid_time(forecast: DataFrame, observed: DataFrame, ids: list[str]) -> DataFrame:
    """Forecast rows (time, dtime hours) with the observation at time + dtime: a hash join on the derived time."""
    f = forecast.withColumn("valid", F.col("time") + F.make_dt_interval(hours=F.col("dtime")))
    return f.join(observed.withColumnRenamed("time", "valid"), [*ids, "valid"])


def nearest_in_time(left: DataFrame, right: DataFrame, keys: list[str], tolerance: int) -> DataFrame:
    """For each left row (t seconds) the right row (t2) nearest in time within tolerance; ties to the earlier.

    Both sides are cut into slots of the tolerance. Of the slots beside its own a row can only meet the last right row
    before and the first one after, so these are lent to their neighbours, and in each slot one running window carries
    the latest right row forward and one the next backward: rows go once, no pairs are made. Of right rows with equal
    keys and time one is taken.
    """
    others = [c for c in right.columns if c not in keys]
    slot = lambda c: F.floor(F.col(c) / tolerance)
    there = lambda df, time: df.where(F.col(time).isNotNull()).dropna(subset=keys)
    own = there(right, "t2").select(*keys, slot("t2").alias("slot"), F.col("t2").alias("at"), F.struct(*others).alias("m"))
    ends = own.groupBy(*keys, "slot").agg(F.min_by(F.struct("at", "m"), "at").alias("first"), F.max_by(F.struct("at", "m"), "at").alias("last"))
    lent = F.inline(F.array(F.struct((F.col("slot") - 1).alias("slot"), F.col("first").alias("e")), F.struct((F.col("slot") + 1).alias("slot"), F.col("last").alias("e"))))
    met = own.unionByName(ends.select(*keys, lent).select(*keys, "slot", "e.at", "e.m"))
    asked = there(left, "t").select(*keys, slot("t").alias("slot"), F.col("t").alias("at"), F.struct(*left.columns).alias("l"))
    both = asked.unionByName(met, allowMissingColumns=True)
    w = Window.partitionBy(*keys, "slot")
    carried = both.withColumn("before", F.last("m", ignorenulls=True).over(w.orderBy("at").rangeBetween(Window.unboundedPreceding, 0)))
    carried = carried.withColumn("after", F.last("m", ignorenulls=True).over(w.orderBy(F.desc("at")).rangeBetween(Window.unboundedPreceding, 0))).where("l is not null")
    back, ahead = F.col("l.t") - F.col("before.t2"), F.col("after.t2") - F.col("l.t")
    best = F.when(ahead.isNull() | (back <= ahead), F.col("before")).otherwise(F.col("after"))
    return carried.withColumn("m", best).where(F.least(back, ahead) <= tolerance).select("l.*", "m.*")


def missing_pairs(wanted: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that should be there and are not."""
    return wanted.select(*keys).distinct().join(found, keys, "left_anti")


def contingency(df: DataFrame, keys: list[str], forecast: str, observed: str, grades: list[float]) -> DataFrame:
    """hits, misses, false alarms, ts and bias of each grade: a single aggregation over all grades."""
    n = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    f, o = F.col(forecast), F.col(observed)
    counts = []
    for i, g in enumerate(grades):  # a conditional sum a grade, so rows are not multiplied
        counts += [n((f >= g) & (o >= g)).alias(f"h{i}"), n(~(f >= g) & (o >= g)).alias(f"m{i}"), n((f >= g) & ~(o >= g)).alias(f"x{i}")]
    wide = df.groupBy(*keys).agg(*counts)
    rows = F.array(*[F.struct(F.lit(float(g)).alias("grade"), F.col(f"h{i}").alias("hits"), F.col(f"m{i}").alias("misses"), F.col(f"x{i}").alias("false_alarms")) for i, g in enumerate(grades)])
    out = wide.select(*keys, F.inline(rows))
    any_ = F.col("hits") + F.col("misses") + F.col("false_alarms")
    seen = F.col("hits") + F.col("misses")
    ts = F.when(any_ > 0, F.col("hits") / any_).otherwise(0.0)
    return out.withColumn("ts", ts).withColumn("bias", F.when(seen > 0, (F.col("hits") + F.col("false_alarms")) / seen))


def similarity(ts: Column, bias: Column) -> Column:
    """Threat score raised by a bias near one; -1 without a signal."""
    return F.coalesce(ts + 0.2 / (F.abs(9 * (bias - 1)) + 1), F.lit(-1.0))


def error_scores(df: DataFrame, group: str, error: str, threshold: float) -> DataFrame:
    """MAE and hit rate for all rows and each group in one grouping-sets aggregation (null group: all)."""
    return df.rollup(group).agg(F.avg(F.abs(error)).alias("mae"), F.avg((F.abs(error) <= threshold).cast("double")).alias("hit"))


def geometric_mean(df: DataFrame, keys: list[str], value: str, floor: float = 1e-10) -> DataFrame:
    return df.groupBy(*keys).agg(F.exp(F.avg(F.log(F.greatest(F.col(value), F.lit(floor))))).alias("skill"))


def decaying_mean(df: DataFrame, keys: list[str], order: list[str], error: str, alpha: float) -> DataFrame:
    """The last value of ME = (1 - alpha) ME + alpha e along each series; the first error starts it, nulls are passed over.

    Closed form: weights alpha (1 - alpha)**k over the row number from the end, so it is one window and one sum.
    """
    rows = df.where(F.col(error).isNotNull())
    back = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    whole = Window.partitionBy(*keys)
    k, n = F.row_number().over(back) - 1, F.count("*").over(whole)
    weight = F.when(k == n - 1, F.pow(F.lit(1 - alpha), k)).otherwise(alpha * F.pow(F.lit(1 - alpha), k))
    return rows.withColumn("w", weight).groupBy(*keys).agg(F.sum(F.col("w") * F.col(error)).alias("me"))


def between_steps(df: DataFrame, keys: list[str], lead: str, value: str, step: int) -> DataFrame:
    """Linear interpolation of each series onto every `step` between its leads."""
    w = Window.partitionBy(*keys).orderBy(lead)
    nxt = df.withColumn("lead1", F.lead(lead).over(w)).withColumn("value1", F.lead(value).over(w))
    ends = F.coalesce(F.col("lead1") - 1, F.col(lead))
    points = nxt.withColumn("at", F.explode(F.sequence(F.col(lead), ends, F.lit(step))))
    share = F.coalesce((F.col("at") - F.col(lead)) / (F.col("lead1") - F.col(lead)), F.lit(0.0))
    return points.select(*keys, F.col("at").alias(lead), (F.col(value) + share * (F.coalesce("value1", value) - F.col(value))).alias(value))


def deaccumulate(df: DataFrame, keys: list[str], lead: str, value: str) -> DataFrame:
    """Amounts of each period from running totals, never below zero."""
    w = Window.partitionBy(*keys).orderBy(lead)
    return df.withColumn(value, F.greatest(F.col(value) - F.coalesce(F.lag(value).over(w), F.lit(0.0)), F.lit(0.0)))


def split_three(value: Column) -> Column:
    """Three hourly amounts of a 3-hour one, equal to a tenth; under 0.1 nothing falls before the last hour."""
    third = F.round(value / 3, 1)
    part = F.when(third < 0.1, 0.0).otherwise(third)
    return F.array(part, part, F.round(value - 2 * part, 4))


def box_mean(df: DataFrame, keys: list[str], radius: int, value: str) -> DataFrame:
    """Mean over the (2r+1)**2 cells around each cell that are not null: two separable range windows.

    The grid has a row for every cell; a missing value is null.
    """
    across = Window.partitionBy(*keys, "iy").orderBy("ix").rangeBetween(-radius, radius)
    down = Window.partitionBy(*keys, "ix").orderBy("iy").rangeBetween(-radius, radius)
    rows = df.withColumn("s", F.sum(value).over(across)).withColumn("n", F.count(value).over(across))
    return rows.withColumn("box", F.sum("s").over(down) / F.sum("n").over(down)).drop("s", "n")


def around(df: DataFrame, keys: list[str], radius: float, value: str) -> DataFrame:
    """Rows (cell, neighbour value) within a circle: offsets exploded, then an equi-join on cells."""
    r = int(radius)
    offsets = [(y, x) for y in range(-r, r + 1) for x in range(-r, r + 1) if y * y + x * x <= radius * radius]
    moved = df.select(*keys, "iy", "ix", F.col(value).alias("v"), F.explode(F.array(*[F.struct(F.lit(y).alias("dy"), F.lit(x).alias("dx")) for y, x in offsets])).alias("o"))
    return moved.select(*keys, (F.col("iy") + F.col("o.dy")).alias("iy"), (F.col("ix") + F.col("o.dx")).alias("ix"), "v").join(df.select(*keys, "iy", "ix"), [*keys, "iy", "ix"])


def circle_percentiles(df: DataFrame, keys: list[str], radius: float, value: str, shares: list[float]) -> DataFrame:
    return around(df, keys, radius, value).groupBy(*keys, "iy", "ix").agg(F.percentile("v", F.array(*map(F.lit, shares))).alias("p"))


def local_slope(df: DataFrame, radius: int, y: str, x: str, most: float, default: float, land: str | None = None) -> DataFrame:
    """Slope of y on x over the window around each cell, using neighbours within `most` of the cell's x.

    With a land column, sea cells (not 1) get the default and are no neighbours.
    """
    if land:
        own = local_slope(df.where(F.col(land) == 1), radius, y, x, most, default)
        return df.select("iy", "ix").join(own, ["iy", "ix"], "left").select("iy", "ix", F.coalesce("slope", F.lit(default)).alias("slope"))
    near = df.select("iy", "ix", F.col(x).alias("x0"))
    moves = F.explode(F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1)]))
    sides = df.select((F.col("iy")).alias("y1"), F.col("ix").alias("x1"), F.col(y).alias("v"), F.col(x).alias("z"), moves.alias("o"))
    joined = sides.select((F.col("y1") + F.col("o.dy")).alias("iy"), (F.col("x1") + F.col("o.dx")).alias("ix"), "v", "z").join(near, ["iy", "ix"]).where(F.abs(F.col("z") - F.col("x0")) <= most)
    return joined.groupBy("iy", "ix").agg(F.coalesce(F.when(F.var_pop("z") > 1e-9, F.regr_slope("v", "z")), F.lit(default)).alias("slope"))


def bilinear(points: DataFrame, grid: DataFrame, value: str) -> DataFrame:
    """grid at points (id, fy, fx in cell units): the four corners by an equi-join, weighted; null where one is missing."""
    y0, x0 = F.floor("fy").cast("int"), F.floor("fx").cast("int")
    wy, wx = F.col("fy") - y0, F.col("fx") - x0
    corners = F.array(*[F.struct((y0 + a).alias("iy"), (x0 + b).alias("ix"), ((wy if a else 1 - wy) * (wx if b else 1 - wx)).alias("w")) for a in (0, 1) for b in (0, 1)])
    rows = points.select("id", F.inline(corners)).join(grid.select("iy", "ix", value), ["iy", "ix"], "left")
    return rows.groupBy("id").agg(F.when(F.count(value) == 4, F.sum(F.col("w") * F.col(value))).alias(value))


def inverse_distance(stations: DataFrame, cells: DataFrame, k: int, reach: int, power: float) -> DataFrame:
    """Weighted mean of the k nearest stations within reach cells of each cell (0 where there is none).

    Stations are sent to the cells of their square by exploding offsets: an equi-join whose size follows the number
    of stations times the square, not stations times cells.
    """
    moves = F.explode(F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a in range(-reach, reach + 1) for b in range(-reach, reach + 1)]))
    spread = stations.select("id", "sy", "sx", "value", moves.alias("o")).select("id", "sy", "sx", "value", (F.floor("sy") + F.col("o.dy")).cast("int").alias("iy"), (F.floor("sx") + F.col("o.dx")).cast("int").alias("ix"))
    d = F.sqrt(F.pow(F.col("sy") - F.col("iy"), 2) + F.pow(F.col("sx") - F.col("ix"), 2))
    near = cells.select("iy", "ix").join(spread, ["iy", "ix"]).withColumn("d", F.greatest(d, F.lit(1e-6))).where(F.col("d") <= reach)
    ranked = near.withColumn("r", F.row_number().over(Window.partitionBy("iy", "ix").orderBy("d", "id"))).where(F.col("r") <= k)
    w = 1 / F.pow("d", F.lit(power))
    means = ranked.groupBy("iy", "ix").agg((F.sum(w * F.col("value")) / F.sum(w)).alias("value"))
    return cells.select("iy", "ix").join(means, ["iy", "ix"], "left").select("iy", "ix", F.coalesce("value", F.lit(0.0)).alias("value"))


def snap_max(stations: DataFrame, cells: DataFrame) -> DataFrame:
    """Cells with the greatest station value at the nearest cell in place of their own."""
    at = stations.groupBy(F.round("sy").cast("int").alias("iy"), F.round("sx").cast("int").alias("ix")).agg(F.max("value").alias("station"))
    return cells.join(at, ["iy", "ix"], "left").withColumn("value", F.coalesce("station", "value")).drop("station")


def ensemble_reorder(raw: DataFrame, calibrated: DataFrame, keys: list[str], seed: int | None = None) -> DataFrame:
    """Ensemble copula coupling: calibrated quantiles take the rank order of the raw members.

    Ties go by member; with a seed in a random order that the seed fixes.
    """
    tie = "member" if seed is None else F.xxhash64(F.lit(seed), *keys, "member")
    a = raw.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("value", tie))).drop("value")
    b = calibrated.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("value", "percentile"))).drop("percentile")
    return a.join(b, [*keys, "r"]).select(*keys, "member", "value")


def wet_mask(df: DataFrame, keys: list[str], value: str, share: float) -> DataFrame:
    """Rows in the upper `share` of each group, ties together."""
    rank = F.percent_rank().over(Window.partitionBy(*keys).orderBy(F.desc(value)))
    return df.withColumn("wet", rank < share)


def matched_levels(df: DataFrame, keys: list[str], forecast: str, observed: str, levels: list[float]) -> DataFrame:
    """For each observed level, the forecast value of the same relative rank: the frequency-matching map.

    One aggregation counts observations below each level. Forecasts are counted by value first, so the running count that
    gives ranks goes over a key's different values, not over its rows; a level then takes the values at its two places.
    """
    shares = [F.avg((F.col(observed) < x).cast("double")).alias(f"s{i}") for i, x in enumerate(levels)]
    wide = df.groupBy(*keys).agg(F.count(forecast).alias("total"), *shares)
    at = lambda i: F.col(f"s{i}") * (F.col("total") - 1)
    wanted = wide.select(*keys, "total", F.inline(F.array(*[F.struct(F.lit(float(x)).alias("observed_level"), at(i).alias("at")) for i, x in enumerate(levels)])))
    counted = df.where(F.col(forecast).isNotNull()).groupBy(*keys, F.col(forecast).alias("value")).agg(F.count("*").alias("n"))
    ranked = counted.withColumn("upto", F.sum("n").over(Window.partitionBy(*keys).orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    held = lambda place: (place >= F.col("upto") - F.col("n")) & (place < F.col("upto"))
    low, high = F.floor("at"), F.least(F.floor("at") + 1, F.col("total") - 1)
    met = wanted.join(ranked, keys).where(held(low) | held(high))
    ends = met.groupBy(*keys, "observed_level", "at").agg(F.max(F.when(held(low), F.col("value"))).alias("a"), F.max(F.when(held(high), F.col("value"))).alias("b"))
    return ends.select(*keys, "observed_level", (F.col("a") + (F.col("at") - F.floor("at")) * (F.col("b") - F.col("a"))).alias("forecast_level"))


def weighted_blend(df: DataFrame, keys: list[str], value: str, score: str, power: float = -2.0) -> DataFrame:
    """Sum of w v over sum of w, w = score**power, over pairs that are whole; null where there is none."""
    w = F.when(F.col(value).isNotNull() & F.col(score).isNotNull(), F.pow(score, F.lit(power)))
    total = F.sum(w)
    return df.groupBy(*keys).agg((F.sum(w * F.col(value)) / F.when(F.abs(total) < 1e-8, 1.0).otherwise(total)).alias("blend"))


def most_alike(df: DataFrame, keys: list[str], score: str, tie: str, k: int) -> DataFrame:
    """The k rows of each key with the greatest score."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), tie))).where(F.col("place") <= k)


def resampled_percentiles(df: DataFrame, keys: list[str], at: list[float]) -> DataFrame:
    """Values at other percentiles by linear interpolation between a group's (percentile, value) rows."""
    w = Window.partitionBy(*keys).orderBy("percentile")
    b = df.withColumn("p1", F.lead("percentile").over(w)).withColumn("v1", F.lead("value").over(w)).where("p1 is not null")
    rows = b.withColumn("q", F.explode(F.array(*map(F.lit, at)))).where("q >= percentile and (q < p1 or (q = p1 and p1 = 100))")
    return rows.select(*keys, F.col("q").alias("percentile"), (F.col("value") + (F.col("q") - F.col("percentile")) / (F.col("p1") - F.col("percentile")) * (F.col("v1") - F.col("value"))).alias("value"))


def lag_correlation(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """gamma1, gamma2 and the AR(2) coefficients by Yule-Walker for each series."""
    w = Window.partitionBy(*keys).orderBy(*order)
    x = df.withColumn("x1", F.lag(value, 1).over(w)).withColumn("x2", F.lag(value, 2).over(w))
    g = x.groupBy(*keys).agg(F.corr(value, "x1").alias("gamma1"), F.corr(value, "x2").alias("gamma2"))
    g1, g2 = F.col("gamma1"), F.col("gamma2")
    return g.withColumn("phi1", g1 * (1 - g2) / (1 - g1 * g1)).withColumn("phi2", (g2 - g1 * g1) / (1 - g1 * g1))


def same_length_sum(df: DataFrame, keys: list[str], value: str, expected: int) -> DataFrame:
    """Totals of keys that have all expected values; null where one is missing."""
    return df.groupBy(*keys).agg(F.when(F.count(value) == expected, F.sum(value)).alias("total"))
