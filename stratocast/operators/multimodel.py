"""Several models' rain by blocks: scores by grade against observations, remembered scores, weights and the blend."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rain grades (mm) and their weights up to 60 hours ahead and beyond.
GRADES = (0.1, 10.0, 25.0, 50.0)
NEAR_WEIGHTS = (0.1, 0.15, 0.3, 0.45)
FAR_WEIGHTS = (0.1, 0.2, 0.45, 0.25)
#: Leads (hours) at which a single model is taken.
SINGLE_LEADS = (108, 238)


def grade_weights(lead: int) -> tuple[float, ...]:
    return NEAR_WEIGHTS if lead <= 60 else FAR_WEIGHTS


def training_blocks(df: DataFrame, y: str, x: str, size: tuple[float, float], reach: float, blocks: tuple[int, int]) -> DataFrame:
    """Each row once for every block (by, bx) whose area, widened by `reach` of its size, holds the point, edges included."""
    for name, at, step, n in (("by", y, size[0], blocks[0]), ("bx", x, size[1], blocks[1])):
        low = F.greatest(F.ceil(F.col(at) / step - 1 - reach), F.lit(0)).cast("int")
        high = F.least(F.floor(F.col(at) / step + reach), F.lit(n - 1)).cast("int")
        df = df.withColumn(name, F.explode(F.when(low <= high, F.sequence(low, high))))
    return df


def _bit(mask: str, place: Column) -> Column:
    return F.getbit(F.col(mask), place) == 1


def wet_sets(history: DataFrame, keys: list[str], station: str, models: list[str], grades: tuple[float, ...]) -> DataFrame:
    """How many stations n of a block show each set of wet and of present models at each grade (bits; the last: observed).

    history: keys, station, model, forecast, observed. One row a station, then one a set: no model pair is joined.
    Rows of other models and null forecasts are passed over; repeated rows of a model count by their greatest value.
    """
    place = F.array_position(F.array(*map(F.lit, models)), F.col("model")).cast("int") - 1
    bit = F.get(F.array(*[F.lit(1 << n).cast("long") for n in range(len(models))]), place)
    rows = history.withColumn("bit", bit).where((place >= 0) & F.col("forecast").isNotNull())
    wet = [F.bit_or(F.when(F.col("forecast") >= g, F.col("bit")).otherwise(0)).alias(f"wet{i}") for i, g in enumerate(grades)]
    one = rows.groupBy(*keys, station).agg(F.bit_or("bit").alias("present"), F.max("observed").alias("observed"), *wet)
    last = F.lit(1 << len(models)).cast("long")
    seen = F.when(F.col("observed").isNotNull(), last).otherwise(0)
    sets = [F.struct(F.lit(float(g)).alias("grade"), F.col(f"wet{i}").bitwiseOR(F.when(F.col("observed") >= g, last).otherwise(0)).alias("wet")) for i, g in enumerate(grades)]
    flat = one.select(*keys, F.col("present").bitwiseOR(seen).alias("present"), F.inline(F.array(*sets)))
    return flat.groupBy(*keys, "grade", "present", "wet").agg(F.count("*").alias("n"))


def block_scores(history: DataFrame, keys: list[str], station: str, models: list[str], weights: tuple[float, ...], grades: tuple[float, ...] = GRADES, fewest: int = 10, useful: float = 0.1, smooth: float = 1e5) -> DataFrame:
    """keys, model, now: the model's share of the threat scores of its block, weighed over grades.

    A threat score with under `fewest` events is 0. A model's score is divided by its mean score against all models
    plus `smooth`, so models that repeat others count less. A grade at which no model reaches `useful` gives equal shares.
    """
    m = len(models)
    sets = wet_sets(history, keys, station, models, grades)
    pairs = sets.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(m - 1)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(m))))
    i, j = F.col("i"), F.col("j")
    pairs = pairs.where(_bit("present", i) & _bit("present", j))
    hits = F.sum(F.when(_bit("wet", i) & _bit("wet", j), F.col("n")).otherwise(0))
    events = F.sum(F.when(_bit("wet", i) | _bit("wet", j), F.col("n")).otherwise(0))
    ts = pairs.groupBy(*keys, "grade", "i", "j").agg(hits.alias("hits"), events.alias("events"))
    ts = ts.withColumn("ts", F.when((F.col("events") >= fewest) & (F.col("events") > 0), F.col("hits") / F.col("events")).otherwise(0.0))
    raw = ts.groupBy(*keys, "grade", "i").agg(F.coalesce(F.max(F.when(j == m, F.col("ts"))), F.lit(0.0)).alias("ts"), (F.sum(F.when(j < m, F.col("ts")).otherwise(0.0)) / m).alias("alike"))
    raw = raw.withColumn("raw", F.col("ts") / (F.col("alike") + smooth))
    totals = raw.groupBy(*keys, "grade").agg(F.sum("raw").alias("total"), F.max("ts").alias("best"), F.map_from_entries(F.collect_list(F.struct("i", "raw"))).alias("by_model"))
    share = F.when((F.col("best") >= useful) & (F.col("total") > 0), F.coalesce(F.try_element_at("by_model", F.col("i")), F.lit(0.0)) / F.col("total")).otherwise(1.0 / m)
    weight = F.element_at(F.create_map(*[F.lit(x) for g, w in zip(grades, weights, strict=True) for x in (float(g), float(w))]), F.col("grade"))
    every = totals.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(m - 1)))).withColumn("share", share * weight)
    name = F.element_at(F.array(*map(F.lit, models)), F.col("i") + 1).alias("model")
    return every.groupBy(*keys, "i").agg(F.sum("share").alias("now")).select(*keys, name, "now")


def latest_before(states: DataFrame, keys: list[str], issued: str, moment: Column) -> DataFrame:
    """keys, model, score of the newest state of each block issued before `moment`."""
    state = F.max_by(F.struct("score"), F.col(issued)).alias("s")
    newest = states.where(F.col(issued) < moment).groupBy(*keys).agg(F.max(issued).alias(issued))
    return states.join(newest, [*keys, issued]).groupBy(*keys, "model").agg(state).select(*keys, "model", "s.score")


def remembered(now: DataFrame, before: DataFrame, keys: list[str], share: float = 0.1) -> DataFrame:
    """keys, model, score: (1 - share) of the earlier scores, scaled to sum 1, and share of now's.

    A model without an earlier score counts 0 there; a block without any takes now's.
    """
    old = before.select(*keys, "model", F.col("score").alias("old"))
    rows = now.join(old, [*keys, "model"], "left").withColumn("old", F.coalesce("old", F.lit(0.0)))
    total = F.sum("old").over(Window.partitionBy(*keys))
    start = F.when(total == 0, F.col("now")).otherwise(F.col("old") / total)
    return rows.select(*keys, "model", ((1 - share) * start + share * F.col("now")).alias("score"))


def presence_weights(scores: DataFrame, current: DataFrame, keys: list[str], models: list[str], most: int = 5, only: str | None = None) -> DataFrame:
    """keys, model, weight: the `most` best (or the single model `only`), shared among those with a current forecast.

    Of equal scores the model later in `models` leads. Weights sum to nearly 1, or 0 where none of them is present.
    """
    if only is None:
        place = F.array_position(F.array(*map(F.lit, models)), F.col("model"))
        best = Window.partitionBy(*keys).orderBy(F.desc("score"), F.desc(place))
        kept = scores.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most).drop("rank")
    else:
        kept = scores.where(F.col("model") == only)
    here = current.where("forecast is not null").select(*keys, "model").distinct()
    rows = kept.join(here, [*keys, "model"], "left_semi")
    return rows.select(*keys, "model", (F.col("score") / (F.sum("score").over(Window.partitionBy(*keys)) + 1e-6)).alias("weight"))


def blended(current: DataFrame, weights: DataFrame, keys: list[str], station: str) -> DataFrame:
    """keys, station, value: the weighted sum of the current forecasts; stations of blocks without weights get 0."""
    joined = current.join(weights, [*keys, "model"], "left")
    return joined.groupBy(*keys, station).agg(F.coalesce(F.sum(F.col("weight") * F.col("forecast")), F.lit(0.0)).alias("value"))


def multi_model_rain(history: DataFrame, current: DataFrame, before: DataFrame, keys: list[str], station: str, models: list[str], lead: int, single: str | None = None, fewest: int = 10) -> tuple[DataFrame, DataFrame]:
    """(keys, station, value; the scores to remember) of one lead: scores, memory, weights and blend in turn.

    At leads of 108 to 238 hours the model `single`, if given, stands alone.
    """
    scores = remembered(block_scores(history, keys, station, models, grade_weights(lead), fewest=fewest), before, keys)
    alone = single if SINGLE_LEADS[0] <= lead <= SINGLE_LEADS[1] else None
    return blended(current, presence_weights(scores, current, keys, models, only=alone), keys, station), scores
