"""Cycle-to-cycle memory as keyed state, and windowed totals with late data."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from stratocast.sources.listing import write_parts


def decaying_means(errors: DataFrame, alpha: float) -> DataFrame:
    """id, me after each batch, from a stream of (id long, ts, error): ME = (1 - alpha) ME + alpha e, the first e starts it.

    State is one number a key. Within a batch a key's rows are taken in time order.
    """

    def step(key, batches, state):
        rows = pd.concat(list(batches)).sort_values("ts")
        me = state.get[0] if state.exists else None
        for e in rows["error"].dropna():
            me = float(e) if me is None else (1 - alpha) * me + alpha * float(e)
        if me is not None:
            state.update((me,))
            yield pd.DataFrame({"id": [key[0]], "me": [me]})

    return errors.groupBy("id").applyInPandasWithState(step, "id long, me double", "me double", "update", GroupStateTimeout.NoTimeout)


def remembered_scores(scores: DataFrame, share: float = 0.1) -> DataFrame:
    """block, model, score after each batch, from a stream of (block long, model string, ts, score): a new score enters with
    `share`, what is remembered keeps the rest; the first one starts it. Null scores leave the memory as it was."""

    def step(key, batches, state):
        rows = pd.concat(list(batches)).sort_values("ts")
        held = state.get[0] if state.exists else None
        for new in rows["score"].dropna():
            held = float(new) if held is None else (1 - share) * held + share * float(new)
        if held is not None:
            state.update((held,))
            yield pd.DataFrame({"block": [key[0]], "model": [key[1]], "score": [held]})

    return scores.groupBy("block", "model").applyInPandasWithState(step, "block long, model string, score double", "score double", "update", GroupStateTimeout.NoTimeout)


def allowed_cycles(files: DataFrame, minutes: list[int], late: str) -> DataFrame:
    """Of a stream of (cycle, lead, ...) the cycles that begin at one of the minutes, each cycle and lead once within `late`."""
    held = files.where(F.minute("cycle").isin(minutes)).withWatermark("cycle", late)
    return held.dropDuplicatesWithinWatermark(["cycle", "lead"])


def paired(forecast: DataFrame, observed: DataFrame, keys: list[str], late: str) -> DataFrame:
    """Stream-stream pairs of forecast (valid) and observation (time) at one time and key; unmatched rows go with the watermark."""
    f = forecast.withWatermark("valid", late)
    o = observed.select(*[F.col(k).alias(f"o_{k}") for k in keys], "time", "observed").withWatermark("time", late)
    same = F.col("valid") == F.col("time")
    for k in keys:
        same = same & (F.col(k) == F.col(f"o_{k}"))
    return f.join(o, same).drop("time", *[f"o_{k}" for k in keys])


def written_once(path: str, by: list[str]):
    """A foreachBatch function that replaces only the partitions a batch writes: a repeated batch leaves the same table."""
    return lambda batch, _: write_parts(batch, path, by)


def windowed_totals(events: DataFrame, width: str, slide: str, late: str) -> DataFrame:
    """Count and sum of value by sliding window and kind; rows later than `late` are left out by the watermark."""
    held = events.withWatermark("ts", late).groupBy(F.window("ts", width, slide), "kind")
    return held.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "kind", "n", "total")
