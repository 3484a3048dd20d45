"""Station analyses, residual spreading, level maps, sample scores and column profiles as DataFrame operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def in_reach(stations: DataFrame, reach: int) -> DataFrame:
    """stations (id, sy, sx, ...) with every cell iy, ix at most `reach` cells away and the distance d.

    Offsets are exploded, so the size follows stations times the square, never stations times cells.
    """
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    moved = stations.withColumn("dy", F.explode(steps)).withColumn("dx", F.explode(steps))
    cells = moved.withColumn("iy", (F.floor("sy") + F.col("dy")).cast("int")).withColumn("ix", (F.floor("sx") + F.col("dx")).cast("int"))
    d = F.sqrt(F.pow(F.col("sy") - F.col("iy"), 2) + F.pow(F.col("sx") - F.col("ix"), 2))
    return cells.withColumn("d", d).where(F.col("d") <= reach).drop("dy", "dx")


def cressman_step(stations: DataFrame, cells: DataFrame, reach: int, smooth: float = 0.001, power: float = 2.0, least: int = 1, floor: float | None = None) -> DataFrame:
    """One successive correction of cells (iy, ix, value) by stations (id, sy, sx, value) within reach.

    The increment of a station is its value less the weighted mean of the cells around it; a cell takes the weighted
    mean of the increments that reach it, if there are `least` of them and the result lies above `floor`.
    """
    w = F.pow(F.col("d") + smooth, F.lit(-power))
    near = in_reach(stations, reach).withColumn("w", w)
    seen = near.join(cells.select("iy", "ix", F.col("value").alias("back")), ["iy", "ix"])
    steps = seen.groupBy("id", "value").agg((F.sum(F.col("w") * F.col("back")) / F.sum("w")).alias("mean"))
    steps = steps.select("id", (F.col("value") - F.col("mean")).alias("step"))
    sums = near.drop("value").join(steps, "id").groupBy("iy", "ix").agg((F.sum(F.col("w") * F.col("step")) / F.sum("w")).alias("step"), F.sum("w").alias("w"), F.count("*").alias("n"))
    moved = F.col("value") + F.col("step")
    holds = (F.col("w") >= 1e-5) & (F.col("n") >= least)
    if floor is not None:
        holds &= moved > floor
    return cells.join(sums, ["iy", "ix"], "left").withColumn("value", F.when(holds, moved).otherwise(F.col("value"))).drop("step", "w", "n")


def cressman(stations: DataFrame, cells: DataFrame, radii: list[int], **options) -> DataFrame:
    """Corrections with each radius in turn, the widest first as listed."""
    for reach in radii:
        cells = cressman_step(stations, cells, reach, **options)
    return cells


def nearest_residual(residuals: DataFrame, cells: DataFrame, reach: int) -> DataFrame:
    """cells plus the residual of the nearest station (ties by id), falling as exp(-(d / reach)**2), 0 beyond reach."""
    best = in_reach(residuals, reach).groupBy("iy", "ix").agg(F.min_by(F.struct("value", "d"), F.struct("d", "id")).alias("near"))
    add = F.coalesce(F.exp(-F.pow(F.col("near.d") / reach, 2)) * F.col("near.value"), F.lit(0.0))
    return cells.join(best, ["iy", "ix"], "left").withColumn("value", F.col("value") + add).drop("near")


def spread_residuals(residuals: DataFrame, cells: DataFrame, reach: int, k: int, scale: float, power: float = 2.0) -> DataFrame:
    """cells plus the inverse-distance mean of the k nearest residuals, each damped by exp(-(d / scale)**2).

    The damping is left out of the divisor, so far stations weaken the sum.
    """
    order = Window.partitionBy("iy", "ix").orderBy("d", "id")
    near = in_reach(residuals, reach).withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)
    w = F.pow(F.col("d") + 1e-6, F.lit(-power))
    damped = F.exp(-F.pow((F.col("d") + 1e-6) / scale, 2))
    means = near.groupBy("iy", "ix").agg((F.sum(w * damped * F.col("value")) / F.sum(w)).alias("add"))
    return cells.join(means, ["iy", "ix"], "left").withColumn("value", F.col("value") + F.coalesce("add", F.lit(0.0))).drop("add")


def level_map(value: Column, model: list[float], fact: list[float]) -> Column:
    """value moved from model levels to fact levels: linear between them, in proportion below and above."""
    if not model:
        return value
    ratio = lambda i: fact[i] / model[i] if model[i] else 0.0
    out = F.when(value < model[0], value * ratio(0))
    for i in range(len(model) - 1):
        if model[i + 1] > model[i]:
            out = out.when(value < model[i + 1], fact[i] + (fact[i + 1] - fact[i]) * (value - model[i]) / (model[i + 1] - model[i]))
    return out.otherwise(value * ratio(-1))


def sample_similarity(counts: DataFrame, keys: list[str], fewest: float = 10.0) -> DataFrame:
    """Mean over grades of threat score times bias factor from hits, misses and false_alarms; few events do not count."""
    h, m, f = (F.col(c) for c in ("hits", "misses", "false_alarms"))
    factor = 1 + 0.2 / (F.abs(9 * ((h + f + 0.001) / (h + m + 0.001) - 1)) + 1)
    score = F.when(h + m + f > fewest, h / (h + m + f + 0.001) * factor)
    return counts.groupBy(*keys).agg(F.coalesce(F.avg(score), F.lit(0.0)).alias("score"))


def first_beyond(df: DataFrame, keys: list[str], order: list[Column], value: str, limit: float) -> DataFrame:
    """How many rows, in order, until their running sum exceeds limit: all rows where it never does."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).withColumn("total", F.sum(value).over(w))
    return rows.groupBy(*keys).agg(F.coalesce(F.min(F.when(F.col("total") > limit, F.col("place"))), F.count("*")).cast("int").alias("length"))


def amounts_at(df: DataFrame, keys: list[str], lead: str, value: str, parts: int) -> DataFrame:
    """Running totals at every 1/parts of a step: whole steps summed, the last one in proportion.

    lead counts the steps from 1; the row of a step covers (lead - 1, lead].
    """
    w = Window.partitionBy(*keys).orderBy(lead)
    sums = df.withColumn("total", F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    rows = sums.withColumn("part", F.explode(F.sequence(F.lit(1), F.lit(parts))))
    share = F.col("part") / F.lit(float(parts))
    return rows.select(*keys, ((F.col(lead) - 1) * parts + F.col("part")).alias("at"), (F.col("total") - F.col(value) + share * F.col(value)).alias("total"))


def level_gradient(df: DataFrame, keys: list[str], level: str, value: str, height: str, digits: int = 4) -> DataFrame:
    """Change of value with height between adjacent levels; the first level takes the second's, a lone level null."""
    w = Window.partitionBy(*keys).orderBy(level)
    slope = lambda a, b: F.round((a[0] - b[0]) / F.when(a[1] != b[1], a[1] - b[1]), digits)
    here = (F.col(value), F.col(height))
    before = (F.lag(value).over(w), F.lag(height).over(w))
    after = (F.lead(value).over(w), F.lead(height).over(w))
    first = F.row_number().over(w) == 1
    return df.withColumn("gradient", F.when(first, slope(after, here)).otherwise(slope(here, before)))


def declustered(df: DataFrame, keys: list[str], y: str, x: str, values: list[str], scale: float, fewest: int) -> DataFrame:
    """Medians of the values, and of y and x, of each square of `scale` that holds `fewest` rows."""
    square = [F.floor(F.col(y) / scale).alias("by"), F.floor(F.col(x) / scale).alias("bx")]
    medians = [F.percentile(c, F.lit(0.5)).alias(c) for c in (y, x, *values)]
    return df.groupBy(*keys, *square).agg(*medians, F.count("*").alias("n")).where(F.col("n") >= fewest)


def pair_gaps(df: DataFrame, keys: list[str], forecast: str, truth: str, most: float) -> DataFrame:
    """Share of rows whose forecast or truth is missing, and whether a fit may use the group."""
    gap = (F.col(forecast).isNull() | F.col(truth).isNull() | F.isnan(forecast) | F.isnan(truth)).cast("double")
    out = df.groupBy(*keys).agg(F.avg(gap).alias("gaps"))
    return out.withColumn("usable", F.col("gaps") <= most)


def best_parameter(df: DataFrame, keys: list[str], candidate: Column, plain: str, truth: str, values: list[float]) -> DataFrame:
    """The parameter with the least mean absolute error of `candidate` (a column over `eta`), 0 where plain is as good.

    Rows are aggregated once over all parameters: sums of the group's errors, then the least of a bounded array.
    """
    errors = [F.avg(F.abs(F.col(plain) - F.col(truth))).alias("e0")]
    tried = df.withColumn("eta", F.explode(F.array(*[F.lit(float(v)) for v in values])))
    per = tried.groupBy(*keys, "eta").agg(*errors, F.avg(F.abs(candidate - F.col(truth))).alias("e"))
    best = F.min_by(F.struct("eta", "e", "e0"), F.struct(F.round("e", 9), "eta")).alias("b")
    out = per.groupBy(*keys).agg(best)
    better = F.round("b.e", 9) < F.round("b.e0", 9)
    return out.select(*keys, F.when(better, F.col("b.eta")).otherwise(0.0).alias("eta"), F.when(better, F.col("b.e")).otherwise(F.col("b.e0")).alias("error"))


def percentiles_from_probabilities(df: DataFrame, keys: list[str], threshold: str, below: str, at: list[float], low: float, high: float) -> DataFrame:
    """Values at percentiles from rows (threshold, probability of less): linear between, with the bounds as 0 and 1."""
    ends = df.select(*keys).distinct().select(*keys, F.explode(F.array(F.struct(F.lit(low).alias("t"), F.lit(0.0).alias("p")), F.struct(F.lit(high).alias("t"), F.lit(1.0).alias("p")))).alias("e"))
    rows = df.select(*keys, F.col(threshold).cast("double").alias("t"), F.col(below).cast("double").alias("p")).unionByName(ends.select(*keys, "e.*"))
    w = Window.partitionBy(*keys).orderBy("t", "p")
    sides = rows.withColumn("t1", F.lead("t").over(w)).withColumn("p1", F.lead("p").over(w)).where("p1 > p")
    asked = sides.withColumn("percentile", F.explode(F.array(*[F.lit(float(q)) for q in at])))
    q = F.col("percentile") / 100
    inside = asked.where((q >= F.col("p")) & ((q < F.col("p1")) | ((q == 1) & (F.col("p1") == 1))))
    return inside.select(*keys, "percentile", (F.col("t") + (q - F.col("p")) / (F.col("p1") - F.col("p")) * (F.col("t1") - F.col("t"))).alias("value"))


def standardised_fit(df: DataFrame, keys: list[str], coefficients: DataFrame, name: str, value: str) -> DataFrame:
    """b0 + sum of coef (x - mean) / std over a site's predictors; null where a predictor is missing.

    coefficients: keys, name, coef, mean, std, b0; small (a row a site and predictor), joined on the site and name.
    """
    term = F.col("coef") * (F.col(value) - F.col("mean")) / F.col("std")
    rows = coefficients.join(df.select(*keys, name, value), [*keys, name], "left")
    whole = F.count(value) == F.count("*")
    return rows.groupBy(*keys).agg(F.when(whole, F.first("b0") + F.sum(term)).alias("fitted"))


def filled_leads(df: DataFrame, fallback: DataFrame, keys: list[str], lead: str, value: str, step: int, last: int) -> DataFrame:
    """A row for each lead from 0 to last in steps: df's value, else the fallback's, else null."""
    wanted = df.select(*keys).unionByName(fallback.select(*keys)).distinct()
    wanted = wanted.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(last), F.lit(step)))).select(*keys, F.col("at").cast(dict(df.dtypes)[lead]).alias(lead))
    out = wanted.join(df.select(*keys, lead, F.col(value).alias("main")), [*keys, lead], "left").join(fallback.select(*keys, lead, F.col(value).alias("other")), [*keys, lead], "left")
    return out.select(*keys, lead, F.coalesce("main", "other").alias(value))


def fused(nowcast: Column, model: Column, weight: Column) -> Column:
    """weight of the nowcast and the rest of the model; what is missing or below zero counts as 0."""
    clean = lambda c: F.when(c > 0, c).otherwise(0.0)
    return weight * clean(nowcast) + (1 - weight) * clean(model)


def terrain_bilinear(points: DataFrame, grid: DataFrame, value: str, height: str, lapse: float, eta: float) -> DataFrame:
    """Bilinear at points (id, fy, fx, alt), each corner first moved to the point's height by lapse * eta."""
    y0, x0 = F.floor("fy").cast("int"), F.floor("fx").cast("int")
    wy, wx = F.col("fy") - y0, F.col("fx") - x0
    corners = F.array(*[F.struct((y0 + a).alias("iy"), (x0 + b).alias("ix"), ((wy if a else 1 - wy) * (wx if b else 1 - wx)).alias("w")) for a in (0, 1) for b in (0, 1)])
    rows = points.select("id", "alt", F.inline(corners)).join(grid.select("iy", "ix", value, height), ["iy", "ix"], "left")
    moved = F.col(value) + (F.col("alt") - F.col(height)) * (lapse * eta)
    return rows.groupBy("id").agg(F.when(F.count(value) == 4, F.sum(F.col("w") * moved)).alias(value))
