"""Whole-field numerics as NumPy kernels, one field a group: (keys, iy, ix, value) in and out."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def per_field(df: DataFrame, key: str, kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """kernel over each key's dense field; cells that are missing are NaN in and left out of the result."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        y, x = rows["iy"].to_numpy(), rows["ix"].to_numpy()
        field = np.full((y.max() + 1, x.max() + 1), np.nan)
        field[y, x] = rows["value"]
        return pd.DataFrame({key: rows[key], "iy": y, "ix": x, "value": kernel(field)[y, x].astype(float)})

    kind = dict(df.dtypes)[key]
    return df.select(key, "iy", "ix", "value").groupBy(key).applyInPandas(run, f"{key} {kind}, iy int, ix int, value double")


def per_fields(df: DataFrame, key: str, columns: list[str], kernel: Callable[..., np.ndarray]) -> DataFrame:
    """kernel over several dense fields of each key, given in the order of columns; the result is `value`."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        y, x = rows["iy"].to_numpy(), rows["ix"].to_numpy()
        fields = []
        for c in columns:
            field = np.full((y.max() + 1, x.max() + 1), np.nan)
            field[y, x] = rows[c]
            fields.append(field)
        return pd.DataFrame({key: rows[key], "iy": y, "ix": x, "value": kernel(*fields)[y, x].astype(float)})

    kind = dict(df.dtypes)[key]
    return df.select(key, "iy", "ix", *columns).groupBy(key).applyInPandas(run, f"{key} {kind}, iy int, ix int, value double")


def sampled(field: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Bilinear values at places inside the field; NaN outside."""
    inside = (y >= 0) & (x >= 0) & (y <= field.shape[0] - 1) & (x <= field.shape[1] - 1)
    y0, x0 = (np.clip(np.floor(c), 0, max(n - 2, 0)).astype(int) for c, n in ((y, field.shape[0]), (x, field.shape[1])))
    y1, x1 = np.minimum(y0 + 1, field.shape[0] - 1), np.minimum(x0 + 1, field.shape[1] - 1)
    b, a = y - y0, x - x0
    out = (1 - b) * ((1 - a) * field[y0, x0] + a * field[y0, x1]) + b * ((1 - a) * field[y1, x0] + a * field[y1, x1])
    return np.where(inside, out, np.nan)


def advect_along(steps: int = 1, passes: int = 3) -> Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """Semi-Lagrangian steps along a field of velocities (u, v cells a step).

    Each step's way back is found in `passes` rounds of taking the velocity at its middle, and the ways of all steps are
    added before the field is read once, so it is not smoothed again and again. What comes from outside is NaN.
    """

    def kernel(field, u, v):
        y, x = np.mgrid[: field.shape[0], : field.shape[1]].astype(float)
        inner = lambda c, n: np.clip(c, 0, n - 1)
        back_y, back_x = np.zeros(field.shape), np.zeros(field.shape)
        for _ in range(steps):
            at_y, at_x = y - back_y, x - back_x
            dy, dx = np.zeros(field.shape), np.zeros(field.shape)
            for _ in range(passes):
                my, mx = inner(at_y - dy / 2, field.shape[0]), inner(at_x - dx / 2, field.shape[1])
                dy, dx = sampled(v, my, mx), sampled(u, my, mx)
            back_y, back_x = back_y + dy, back_x + dx
        return sampled(field, y - back_y, x - back_x)

    return kernel


def resized(field: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """The field on another number of rows and columns over the same extent, bilinear."""
    y, x = (np.linspace(0, n - 1, m) for n, m in zip(field.shape, shape, strict=True))
    return sampled(field, *np.meshgrid(y, x, indexing="ij"))


def mirrored(field: np.ndarray, border: int) -> np.ndarray:
    """The field with a border in which it is mirrored at its edges."""
    return np.pad(field, border, mode="symmetric")


def bicubic(field: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Values at places by cubic convolution (a = -1/2) over 4 x 4 cells, edges held."""

    def weights(t):
        t = np.abs(t)
        return np.where(t <= 1, 1.5 * t**3 - 2.5 * t**2 + 1, np.where(t < 2, -0.5 * t**3 + 2.5 * t**2 - 4 * t + 2, 0.0))

    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    out = np.zeros(np.shape(y))
    for j in range(-1, 3):
        for i in range(-1, 3):
            cell = field[np.clip(y0 + j, 0, field.shape[0] - 1), np.clip(x0 + i, 0, field.shape[1] - 1)]
            out = out + cell * weights(y - y0 - j) * weights(x - x0 - i)
    return out


def smooth9(times: int) -> Callable[[np.ndarray], np.ndarray]:
    """[1 2 1] by [1 2 1] over 16, times over; borders are extended linearly."""

    def kernel(field):
        for _ in range(times):
            p = np.pad(field, 1, mode="reflect", reflect_type="odd") if min(field.shape) > 1 else np.pad(field, 1, mode="edge")
            across = (p[:, :-2] + 2 * p[:, 1:-1] + p[:, 2:]) / 4
            field = (across[:-2] + 2 * across[1:-1] + across[2:]) / 4
        return field

    return kernel


def cascade(field: np.ndarray, levels: int) -> np.ndarray:
    """levels x field: Gaussian band-pass parts by wavelength, equal steps of its logarithm; they sum to the field."""
    wave = np.hypot(np.fft.fftfreq(field.shape[0])[:, None], np.fft.fftfreq(field.shape[1])[None, :]) * max(field.shape)
    scale = np.log(np.maximum(wave, 0.5))
    middles = np.linspace(scale.min(), scale.max(), levels)
    weights = np.exp(-0.5 * ((scale[None] - middles[:, None, None]) / max(middles[1] - middles[0], 1e-9)) ** 2) if levels > 1 else np.ones((1, *field.shape))
    weights /= weights.sum(axis=0)
    return np.real(np.fft.ifft2(np.fft.fft2(field)[None] * weights))


def cascade_level(level: int, levels: int) -> Callable[[np.ndarray], np.ndarray]:
    return lambda field: cascade(np.nan_to_num(field), levels)[level]


def advect(u: float, v: float) -> Callable[[np.ndarray], np.ndarray]:
    """One backward semi-Lagrangian step by (u, v) cells, bilinear; what comes from outside keeps its value."""

    def kernel(field):
        y, x = np.mgrid[: field.shape[0], : field.shape[1]].astype(float)
        y, x = y - v, x - u
        inside = (y >= 0) & (x >= 0) & (y <= field.shape[0] - 1) & (x <= field.shape[1] - 1)
        y0, x0 = np.clip(np.floor(y), 0, field.shape[0] - 2).astype(int), np.clip(np.floor(x), 0, field.shape[1] - 2).astype(int)
        b, a = y - y0, x - x0
        moved = (1 - b) * ((1 - a) * field[y0, x0] + a * field[y0, x0 + 1]) + b * ((1 - a) * field[y0 + 1, x0] + a * field[y0 + 1, x0 + 1])
        return np.where(inside, moved, field)

    return kernel


def components(kind: np.ndarray, wrap: bool = False) -> np.ndarray:
    """For each cell the least place among the 4-connected cells of its kind; -1 where the kind is negative.

    Neighbours of one kind are edges; roots hook to the lesser root and paths halve, so the number of passes follows the
    logarithm of an area's length, however it winds. wrap: the first and last column are neighbours.
    """
    place = np.arange(kind.size).reshape(kind.shape)
    sides = [(np.s_[:-1, :], np.s_[1:, :]), (np.s_[:, :-1], np.s_[:, 1:])] + ([(np.s_[:, -1], np.s_[:, 0])] if wrap else [])
    edges = [(place[one][same], place[two][same]) for one, two in sides if (same := (kind[one] == kind[two]) & (kind[one] >= 0)).any()]
    root = place.ravel().copy()
    if edges:
        a, b = (np.concatenate(x) for x in zip(*edges, strict=True))
        while len(a):
            ra, rb = root[a], root[b]
            apart = ra != rb
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while (root[root] != root).any():
                root = root[root]
    return np.where(kind >= 0, root.reshape(kind.shape), -1)


def labelled(threshold: float) -> Callable[[np.ndarray], np.ndarray]:
    """Connected areas (4 neighbours) of value >= threshold: each cell the least place in its area plus one, 0 outside."""
    return lambda field: components(np.where(np.nan_to_num(field, nan=-np.inf) >= threshold, 0, -1)) + 1
