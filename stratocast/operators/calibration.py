"""Ensemble calibration: fitting location and spread to past errors, and applying the fit."""

from __future__ import annotations

import math
from collections.abc import Callable
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ERF = np.vectorize(math.erf, otypes=[float])


def normal_cdf(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + _ERF(np.asarray(x, float) / math.sqrt(2)))


def normal_pdf(x: np.ndarray) -> np.ndarray:
    return np.exp(-0.5 * np.square(x)) / math.sqrt(2 * math.pi)


def crps(mu: np.ndarray, sigma: np.ndarray, truth: np.ndarray, truncated: bool = False) -> np.ndarray:
    """Continuous ranked probability score of a normal distribution, or of one cut off below zero."""
    z = (truth - mu) / sigma
    if not truncated:
        return sigma * (z * (2 * normal_cdf(z) - 1) + 2 * normal_pdf(z) - 1 / math.sqrt(math.pi))
    p = np.maximum(normal_cdf(mu / sigma), 1e-12)
    tail = normal_cdf(math.sqrt(2) * mu / sigma) / math.sqrt(math.pi)
    return sigma / p**2 * (z * p * (2 * normal_cdf(z) + p - 2) + 2 * normal_pdf(z) * p - tail)


def nelder_mead(function: Callable[[np.ndarray], float], start: np.ndarray, rounds: int = 400, close: float = 1e-8) -> np.ndarray:
    """The least point that a simplex finds by reflecting, stretching, contracting and shrinking."""
    n = len(start)
    points = [np.array(start, float)]
    for i in range(n):
        p = points[0].copy()
        p[i] = p[i] * 1.05 if p[i] else 0.00025
        points.append(p)
    scored = sorted(((function(p), i, p) for i, p in enumerate(points)), key=lambda x: x[:2])
    for _ in range(rounds * n):
        if abs(scored[-1][0] - scored[0][0]) <= close and max(np.abs(p - scored[0][2]).max() for _, _, p in scored) <= 1e-5:
            break
        middle = np.mean([p for _, _, p in scored[:-1]], axis=0)
        worst = scored[-1][2]
        at = lambda t: (lambda p: (function(p), 0, p))(middle + t * (middle - worst))  # noqa: B023, E731
        new = at(1.0)
        if new[0] < scored[0][0]:
            far = at(2.0)
            new = far if far[0] < new[0] else new
        elif new[0] >= scored[-2][0]:
            inner = at(0.5 if new[0] < scored[-1][0] else -0.5)
            if inner[0] < min(new[0], scored[-1][0]):
                new = inner
            else:
                best = scored[0][2]
                scored = [scored[0]] + [(function(q), 0, q) for q in (best + 0.5 * (p - best) for _, _, p in scored[1:])]
                new = None
        if new is not None:
            scored[-1] = new
        scored.sort(key=lambda x: x[0])
    return scored[0][2]


def fit(pairs: DataFrame, keys: list[str], truncated: bool = False, fewest: int = 3, most_bins: int = 65_536) -> DataFrame:
    """alpha, beta, gamma, delta of each key from rows (mean, var, truth): location alpha + beta mean, variance
    gamma**2 + delta**2 var, with the least mean score.

    Rows with a missing number are left out; keys with under `fewest` rows get the neutral fit 0, 1, 0, 1. A key's
    rows are first added up in bins of equal (mean, var, truth) in float precision, so repeated pairs cost one row;
    a key must otherwise fit in a task, as a level or a site of a few years does.
    """
    clean = pairs.select(*keys, *[F.col(c).cast("float").cast("double").alias(c) for c in ("mean", "var", "truth")]).dropna(subset=["mean", "var", "truth"])
    binned = clean.groupBy(*keys, "mean", "var", "truth").agg(F.count("*").alias("n"))
    columns = ("mean", "var", "truth")
    ranges = binned.groupBy(*keys).agg(F.count("*").alias("bins"), *[f(c).alias(f"{c}_{n}") for c in columns for n, f in (("low", F.min), ("high", F.max))])
    step = lambda c, n: F.when(F.col("bins") > most_bins, F.floor((F.col(c) - F.col(f"{c}_low")) / F.greatest(F.col(f"{c}_high") - F.col(f"{c}_low"), F.lit(1e-30)) * (n - 1e-9)).cast("double")).otherwise(F.col(c)).alias(f"{c}_step")
    placed = binned.join(ranges, keys).select(*keys, *columns, "n", *[step(c, n) for c, n in zip(columns, (64, 16, 64), strict=True)])
    weighted = [(F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias(c) for c in columns]
    binned = placed.groupBy(*keys, *[f"{c}_step" for c in columns]).agg(*weighted, F.sum("n").alias("n")).select(*keys, *columns, "n")
    kinds = ", ".join(f"{k} {t}" for k, t in pairs.select(*keys).dtypes)

    def solve(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x, v, y, n = (rows[c].to_numpy(float) for c in ("mean", "var", "truth", "n"))
        found = np.array([0.0, 1.0, 0.0, 1.0])
        if n.sum() >= fewest:
            mx, my = np.average(x, weights=n), np.average(y, weights=n)
            spread = np.average((x - mx) ** 2, weights=n)
            beta = np.average((x - mx) * (y - my), weights=n) / spread if spread > 1e-12 else 1.0
            left = np.average((y - my - beta * (x - mx)) ** 2, weights=n)
            start = np.array([my - beta * mx, beta, math.sqrt(max(left, 1e-6)), 0.1])

            def score(p):
                sigma = np.sqrt(p[2] ** 2 + p[3] ** 2 * v)
                if not (sigma > 1e-9).all():
                    return 99999.0
                return float(np.average(crps(p[0] + p[1] * x, sigma, y, truncated), weights=n))

            found = nelder_mead(score, start)
        values = dict(zip(("alpha", "beta", "gamma", "delta"), found, strict=True))
        return pd.DataFrame([{**dict(zip(keys, key, strict=True)), **values}])

    return binned.groupBy(*keys).applyInPandas(solve, f"{kinds}, alpha double, beta double, gamma double, delta double")


def linear_fit(rows: DataFrame, keys: list[str], xs: list[str], y: str, ridge: float = 1e-9) -> DataFrame:
    """intercept and slopes of each key's least-squares line through several predictors, as array `coefficients`.

    One aggregation adds up products of predictors, so a key's rows never meet in one task; a key's few sums are then
    solved. Rows with a missing number are left out; a predictor without spread gets slope 0.
    """
    terms = [F.lit(1.0), *[F.col(x).cast("double") for x in xs]]
    n = len(terms)
    whole = rows.dropna(subset=[*xs, y])
    sums = whole.groupBy(*keys).agg(
        F.array(*[F.sum(terms[i] * terms[j]) for i in range(n) for j in range(n)]).alias("a"), F.array(*[F.sum(t * F.col(y)) for t in terms]).alias("b")
    )

    @F.pandas_udf("array<double>")
    def solve(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for m, r in zip(a, b, strict=True):
            m, r = np.array(m, float).reshape(n, n), np.array(r, float)
            middle, weight = m[0, 1:] / m[0, 0], m[0, 0]
            inner, right = m[1:, 1:] / weight - np.outer(middle, middle), r[1:] / weight - middle * r[0] / weight
            flat = np.diag(inner) <= ridge
            inner[flat], inner[:, flat] = 0, 0
            inner[flat, flat], right[flat] = 1, 0
            slopes = np.linalg.lstsq(inner, right, rcond=None)[0]
            out.append([float(r[0] / weight - slopes @ middle), *slopes.tolist()])
        return pd.Series(out)

    return sums.select(*keys, solve("a", "b").alias("coefficients"))


def fitted(rows: DataFrame, coefficients: DataFrame, keys: list[str], xs: list[str]) -> DataFrame:
    """rows with the value of their key's line; without a fit the first predictor stands."""
    at = lambda i: F.get("coefficients", F.lit(i))
    line = at(0)
    for i, x in enumerate(xs):
        line = line + at(i + 1) * F.col(x)
    return rows.join(coefficients, keys, "left").withColumn("fitted", F.coalesce(line, F.col(xs[0]))).drop("coefficients")


def truncated_percentiles(df: DataFrame, percentiles: list[float]) -> DataFrame:
    """A row for each percentile of the normal distribution of location and scale cut off below zero."""

    @F.pandas_udf("double")
    def quantile(location: pd.Series, scale: pd.Series, percentile: pd.Series) -> pd.Series:
        inverse = np.vectorize(NormalDist().inv_cdf, otypes=[float])
        m, s, p = (x.to_numpy(float) for x in (location, scale, percentile))
        below = normal_cdf(-m / np.maximum(s, 1e-12))
        share = np.clip(below + p / 100 * (1 - below), 1e-12, 1 - 1e-12)
        return pd.Series(np.where(s > 0, np.maximum(m + s * inverse(share), 0), np.maximum(m, 0)))

    rows = df.withColumn("percentile", F.explode(F.array(*[F.lit(float(p)) for p in percentiles])))
    return rows.withColumn("value", quantile("location", "scale", "percentile"))


def location_and_scale(members: DataFrame, keys: list[str], value: str) -> DataFrame:
    """mean and sample variance of each key's members (variance 0 for a lone one)."""
    return members.groupBy(*keys).agg(F.avg(value).alias("mean"), F.coalesce(F.var_samp(value), F.lit(0.0)).alias("var"))


def calibrated(forecast: DataFrame, coefficients: DataFrame, on: list[str]) -> DataFrame:
    """forecast rows (mean, var) with location and scale; rows whose key has no fit keep their mean and spread."""
    c = lambda name, other: F.coalesce(F.col(name), F.lit(other))
    out = forecast.join(coefficients, on, "left")
    location = c("alpha", 0.0) + c("beta", 1.0) * F.col("mean")
    scale = F.sqrt(F.pow(c("gamma", 0.0), 2) + F.pow(c("delta", 1.0), 2) * F.col("var"))
    return out.withColumn("location", location).withColumn("scale", scale).drop("alpha", "beta", "gamma", "delta")


def at_percentiles(df: DataFrame, percentiles: list[float]) -> DataFrame:
    """A row for each percentile of the normal distribution of location and scale: the quantiles are constants."""
    q = F.array(*[F.struct(F.lit(float(p)).alias("percentile"), F.lit(NormalDist().inv_cdf(p / 100)).alias("z")) for p in percentiles])
    rows = df.select("*", F.inline(q))
    return rows.withColumn("value", F.col("location") + F.col("z") * F.col("scale")).drop("z")


def even_percentiles(n: int) -> list[float]:
    """k / (n + 1) in per cent."""
    return [100.0 * k / (n + 1) for k in range(1, n + 1)]


def exceedance(location: Column, scale: Column, threshold: float) -> Column:
    """Probability of more than threshold, by a pandas UDF over Arrow batches."""

    @F.pandas_udf("double")
    def tail(a: pd.Series, b: pd.Series) -> pd.Series:
        x, s = a.to_numpy(float), b.to_numpy(float)
        with np.errstate(divide="ignore", invalid="ignore"):
            p = np.where(s > 0, 1 - normal_cdf((threshold - x) / np.where(s > 0, s, 1)), (x > threshold).astype(float))
        return pd.Series(np.where(np.isnan(x) | np.isnan(s), np.nan, p))

    return tail(location, scale)
