"""Blends of two fields and motion between them: cascades by skill, saliency, windowed flow, upstream drift."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratocast.operators.fields import cascade


def _paired(first: DataFrame, second: DataFrame, key: str):
    """Both sides' rows (key, iy, ix, value) with `second_side`, grouped by key."""
    columns = (key, "iy", "ix", "value")
    sides = [df.select(*columns, F.lit(n).alias("second_side")) for n, df in enumerate((first, second))]
    return sides[0].unionByName(sides[1]).groupBy(key)


def _dense(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    """The two fields in one shape, NaN where a cell is missing; None where a side has no rows."""
    if rows["second_side"].nunique() < 2:
        return None
    fields = np.full((2, rows["iy"].max() + 1, rows["ix"].max() + 1), np.nan)
    fields[rows["second_side"], rows["iy"], rows["ix"]] = rows["value"]
    return fields[0], fields[1]


def per_pair(first: DataFrame, second: DataFrame, key: str, kernel: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """kernel over the dense fields (iy, ix, value) of both sides of each key; keys of one side alone are left out."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        pair = _dense(rows)
        a = rows[rows["second_side"] == 0] if pair else rows[:0]
        y, x = a["iy"].to_numpy(), a["ix"].to_numpy()
        value = kernel(*pair)[y, x].astype(float) if pair else np.zeros(0)
        return pd.DataFrame({key: a[key], "iy": y, "ix": x, "value": value})

    return _paired(first, second, key).applyInPandas(run, f"{key} {dict(first.dtypes)[key]}, iy int, ix int, value double")


def skill_blend(lead_minutes: float, levels: int = 6, tau: float = 90.0, skill: list[float] | None = None, least: float = 0.1, dry: float = 0.05, most: float = 50.0) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Nowcast and model blended in decibels level by level: the nowcast weighs its skill, the model the rest.

    Without a measured skill of each level it falls as exp(-lead / tau). Rain under `dry` becomes 0, over `most` most.
    """
    weight = np.maximum(np.asarray(skill, float), 0.15) if skill is not None else np.full(levels, np.exp(-lead_minutes / tau))

    def decibels(rain):
        return 10 * np.log10(np.maximum(np.nan_to_num(rain), least))

    def parts(field):
        c = cascade(field, len(weight))
        mean, spread = c.mean(axis=(1, 2)), c.std(axis=(1, 2)) + 1e-8
        return (c - mean[:, None, None]) / spread[:, None, None], mean, spread

    def kernel(nowcast, model):
        (a, am, asd), (b, bm, bsd) = parts(decibels(nowcast)), parts(decibels(model))
        w = weight[:, None, None]
        spread = (weight * asd + (1 - weight) * bsd)[:, None, None]
        total = ((w * a + (1 - w) * b) * spread).sum(axis=0) + (weight * am + (1 - weight) * bm).sum()
        rain = 10 ** (np.clip(total, -15, 35) / 10)
        return np.where(rain < dry, 0.0, np.minimum(rain, most))

    return kernel


def _smoothed(field: np.ndarray, sigma: float) -> np.ndarray:
    reach = int(4 * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    k /= k.sum()
    for axis in (0, 1):
        pad = [(reach, reach) if a == axis else (0, 0) for a in (0, 1)]
        wide = np.pad(field, pad, mode="symmetric")
        field = sum(w * np.take(wide, np.arange(i, i + field.shape[axis]), axis=axis) for i, w in enumerate(k))
    return field


def saliency(field: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Smoothed size of the Sobel gradient."""
    p = np.pad(field, 1, mode="symmetric")
    down = p[2:] - p[:-2]
    across = p[:, 2:] - p[:, :-2]
    gy = down[:, :-2] + 2 * down[:, 1:-1] + down[:, 2:]
    gx = across[:-2] + 2 * across[1:-1] + across[2:]
    return _smoothed(np.hypot(gx, gy), sigma)


def salient_blend(weight: float, floor: float = 0.05, strength: float = 0.35, sigma: float = 1.0) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Nowcast and model blended by a weight that leans to the one that stands out: strength 0 keeps the plain weight.

    Each field's saliency counts relative to its own greatest; floor is what a flat place still counts.
    """
    strength = min(max(strength, 0.0), 1.0)

    def kernel(nowcast, model):
        a, b = (s / s.max() if (s := saliency(f, sigma)).max() > 0 else s for f in (nowcast, model))
        one, two = weight * (a + floor), (1 - weight) * (b + floor)
        leaning = np.divide(one, one + two, out=np.full(nowcast.shape, float(weight)), where=one + two > 1e-12)
        share = (1 - strength) * weight + strength * leaning
        return model + share * (nowcast - model)

    return kernel


def flow(before: list[np.ndarray], after: list[np.ndarray], half: int, wet: float = 0.1, change: float = 0.1, fewest: int = 100) -> list[tuple[int, int, float, float]]:
    """(iy, ix, u, v) in cells a step: least squares of the change on the mean gradient in overlapping windows.

    All pairs of fields add to a window's equations; windows with under `fewest` wet, changing cells are left out.
    """
    gy, gx, dv, use = [], [], [], []
    for a, b in zip(before, after, strict=True):
        y, x = np.gradient((np.nan_to_num(a) + np.nan_to_num(b)) / 2)
        gy.append(y)
        gx.append(x)
        dv.append(np.nan_to_num(b) - np.nan_to_num(a))
        with np.errstate(invalid="ignore"):
            use.append((np.abs(dv[-1]) >= change) & (a >= wet) & (b >= wet))
    gy, gx, dv, use = (np.array(x) for x in (gy, gx, dv, use))
    out = []
    for iy in range(half, dv.shape[1] - half, half):
        for ix in range(half, dv.shape[2] - half, half):
            at = np.s_[:, iy - half : iy + half + 1, ix - half : ix + half + 1]
            m = use[at]
            if m.sum() >= fewest:
                (u, v), *_ = np.linalg.lstsq(np.column_stack((gx[at][m], gy[at][m])), -dv[at][m], rcond=None)
                out.append((iy, ix, float(u), float(v)))
    return out


def flows(first: DataFrame, second: DataFrame, key: str, half: int, **limits) -> DataFrame:
    """flow() of each key's pair of fields as rows (key, iy, ix, u, v)."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        pair = _dense(rows)
        found = flow([pair[0]], [pair[1]], half, **limits) if pair else []
        out = pd.DataFrame(found, columns=["iy", "ix", "u", "v"]).astype({"iy": "int32", "ix": "int32", "u": float, "v": float})
        out.insert(0, key, rows[key].iloc[0])
        return out

    return _paired(first, second, key).applyInPandas(run, f"{key} {dict(first.dtypes)[key]}, iy int, ix int, u double, v double")


def drifted(df: DataFrame, value: str, last: tuple[int, int], reach: float, spacing: float, lifetime: float, efficiency: float = 0.23265) -> DataFrame:
    """Enhancement carried down wind: the mean of value at the cells up wind (iy, ix, u, v, value), by distance.

    A cell looks back in whole rows or columns, at most `reach` metres, with Gaussian weights whose width is the way
    the wind makes in `lifetime` seconds, and takes `efficiency` of the mean; cells beyond the field count as those of
    its edge (the field ends at row and column `last`); cells without wind keep 0. Offsets are exploded and met by an
    equi-join on cells.
    """
    speed = F.sqrt(F.col("u") * F.col("u") + F.col("v") * F.col("v"))
    rows = df.withColumn("speed", speed).where("speed > 1e-8")
    rows = rows.withColumn("s", F.col("u") / F.col("speed")).withColumn("c", F.col("v") / F.col("speed"))
    rows = rows.withColumn("lead", F.greatest(F.abs("s"), F.abs("c")))
    back = F.floor(F.col("lead") * (reach / spacing)).cast("int") - 1
    rows = rows.where(back >= 0).withColumn("step", F.explode(F.sequence(F.lit(0), back))).withColumn("d", F.col("step") / F.col("lead"))
    held = lambda at, most: F.greatest(F.lit(0), F.least(F.bround(at).cast("int"), F.lit(most)))
    asked = rows.select("iy", "ix", "d", "speed", held(F.col("iy") - F.col("d") * F.col("c"), last[0]).alias("sy"), held(F.col("ix") - F.col("d") * F.col("s"), last[1]).alias("sx"))
    source = df.select(F.col("iy").alias("sy"), F.col("ix").alias("sx"), F.col(value).alias("there"))
    w = F.exp(-0.5 * F.pow(F.col("d") / (F.col("speed") * lifetime / spacing), 2))
    means = asked.join(source, ["sy", "sx"]).groupBy("iy", "ix").agg((efficiency * F.sum(w * F.col("there")) / F.sum(w)).alias("carried"))
    return df.join(means, ["iy", "ix"], "left").withColumn("carried", F.coalesce("carried", F.lit(0.0)))
