"""Rain nowcasts by scales: motion, a cascade with second-order autoregression, and members with seeded noise."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratocast.operators.blending import flow
from stratocast.operators.fields import advect, cascade


def autoregression(newest: np.ndarray, middle: np.ndarray, oldest: np.ndarray) -> tuple[float, float, float]:
    """(phi1, phi2, noise factor) of a level from its correlations at one and two steps, held stationary."""

    def correlation(a, b):
        spread = a.std() * b.std()
        return float(((a - a.mean()) * (b - b.mean())).mean() / spread) if spread > 1e-12 else 0.0

    r1 = float(np.clip(correlation(newest, middle), 0.0, 0.999))
    r2 = float(np.clip(correlation(newest, oldest), 2 * r1 * r1 - 1, 0.999))
    phi1, phi2 = r1 * (1 - r2) / (1 - r1 * r1), (r2 - r1 * r1) / (1 - r1 * r1)
    return phi1, phi2, float(np.sqrt(max(0.0, 1 - phi1 * r1 - phi2 * r2)))


def shaped_noise(field: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """White noise with the field's amplitude spectrum."""
    shape = np.abs(np.fft.fft2(field - field.mean()))
    return np.real(np.fft.ifft2(np.fft.fft2(rng.standard_normal(field.shape)) * shape))


def motion(fields: list[np.ndarray], half: int, **limits) -> tuple[float, float]:
    """The median (u, v) of all windows of all pairs, in cells a step; no motion where no window has enough rain."""
    found = flow(fields[:-1], fields[1:], half, **limits)
    return (float(np.median([f[2] for f in found])), float(np.median([f[3] for f in found]))) if found else (0.0, 0.0)


def _like(field: np.ndarray, now: np.ndarray, wet: float, whole: bool) -> np.ndarray:
    """field with as many wet cells as now: with now's sorted values (whole), or only its mean over wet cells."""
    n = int((now >= wet).sum())
    out = np.zeros(field.size)
    if n:
        top = np.argsort(-field, axis=None, kind="stable")[:n]
        if whole:
            out[top] = np.sort(now, axis=None)[::-1][:n]
        else:
            kept = np.maximum(field.ravel()[top], wet)
            out[top] = kept * now[now >= wet].mean() / kept.mean()
    return out.reshape(field.shape)


def extrapolated(fields: list[np.ndarray], leads: int, levels: int = 6, members: int = 0, seed: int = 0, wet: float = 0.1, dry_db: float = -15.0, half: int = 16, **limits) -> np.ndarray:
    """(members or 1) x leads x field, from three fields a step apart, oldest first. Missing cells count as dry.

    The earlier fields are moved onto the newest; each level of the cascade, in decibels, goes on by its own
    autoregression, so small scales fade first, and the sum is moved by the motion. Without members the wet area and
    its mean stay as they are; members get noise of the newest field's spectrum and keep its distribution.
    """
    rain = [np.nan_to_num(f) for f in fields]
    now = rain[-1]
    u, v = motion(rain, half, **limits)
    step = advect(u, v)
    decibels = [np.where(f >= wet, 10 * np.log10(np.maximum(f, wet)), dry_db) for f in rain]
    parts = [cascade(x, levels) for x in (step(step(decibels[0])), step(decibels[1]), decibels[2])]
    mean, spread = parts[2].mean(axis=(1, 2)), parts[2].std(axis=(1, 2))
    scaled = [(p - mean[:, None, None]) / np.maximum(spread, 1e-9)[:, None, None] for p in parts]
    models = [autoregression(scaled[2][k], scaled[1][k], scaled[0][k]) for k in range(levels)]
    out = np.zeros((max(members, 1), leads, *now.shape))
    for member in range(max(members, 1)):
        rng = np.random.default_rng((seed, member))
        older, newer = scaled[1], scaled[2]
        for lead in range(leads):
            following = np.array([m[0] * b + m[1] * a for m, a, b in zip(models, older, newer, strict=True)])
            if members:
                noise = cascade(shaped_noise(decibels[2], rng), levels)
                size = np.maximum(noise.std(axis=(1, 2)), 1e-9)
                following += np.array([m[2] * (x - x.mean()) / s for m, x, s in zip(models, noise, size, strict=True)])
            older, newer = newer, following
            total = (newer * spread[:, None, None] + mean[:, None, None]).sum(axis=0)
            moved = 10 ** (total / 10)
            for _ in range(lead + 1):
                moved = step(moved)
            out[member, lead] = _like(moved, now, wet, whole=members > 0)
    return out


def nowcast(df: DataFrame, key: str, leads: int, members: int = 0, seed: int = 0, **options) -> DataFrame:
    """(key, member, lead from 1, iy, ix, value) of each key's last three steps; rows: key, step, iy, ix, value.

    A key's fields form one task's work, bounded by the grid. Keys with under three steps give no rows. Noise is
    seeded by the key's text, so reruns agree.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        steps = np.sort(rows["step"].unique())[-3:]
        columns = [key, "member", "lead", "iy", "ix", "value"]
        if len(steps) < 3:
            return pd.DataFrame({c: rows[key][:0] if c == key else np.zeros(0) for c in columns})
        rows = rows[rows["step"].isin(steps)]
        fields = np.full((3, rows["iy"].max() + 1, rows["ix"].max() + 1), np.nan)
        fields[np.searchsorted(steps, rows["step"]), rows["iy"], rows["ix"]] = rows["value"]
        name = rows[key].iloc[0]
        out = extrapolated(list(fields), leads, members=members, seed=seed + zlib.crc32(str(name).encode()), **options)
        member, lead, y, x = (a.ravel() for a in np.indices(out.shape))
        return pd.DataFrame({key: [name] * out.size, "member": member, "lead": lead + 1, "iy": y, "ix": x, "value": out.ravel()})

    kind = dict(df.dtypes)[key]
    return df.select(key, "step", "iy", "ix", "value").groupBy(key).applyInPandas(run, f"{key} {kind}, member int, lead int, iy int, ix int, value double")


def features(fields: np.ndarray, most: int = 100, apart: int = 3, edge: int = 1, share: float = 0.01) -> list[tuple[int, int, float]]:
    """(iy, ix, strength) of corners: local maxima of the lesser eigenvalue of the gradients' 3 x 3 sums, strongest first.

    Corners weaker than share of the strongest, within edge of the border, or within apart cells of a stronger one go.
    """
    y, x = np.gradient(np.nan_to_num(fields))
    sums = []
    for product in (y * y, x * x, y * x):
        p = np.pad(product, 1)
        sums.append(sum(p[a : a + product.shape[0], b : b + product.shape[1]] for a in range(3) for b in range(3)))
    yy, xx, yx = sums
    least = (yy + xx) / 2 - np.sqrt(((yy - xx) / 2) ** 2 + yx**2)
    inner = np.zeros(least.shape, bool)
    inner[edge : least.shape[0] - edge, edge : least.shape[1] - edge] = True
    least = np.where(inner & (least > 1e-12) & (least >= share * least.max()), least, 0)
    found: list[tuple[int, int, float]] = []
    for at in np.argsort(-least, axis=None, kind="stable"):
        iy, ix = divmod(int(at), least.shape[1])
        if least[iy, ix] <= 0 or len(found) == most:
            break
        if all((iy - b) ** 2 + (ix - c) ** 2 > apart * apart for b, c, _ in found):
            found.append((iy, ix, float(least[iy, ix])))
    return found


# Growth of motion errors with the lead (minutes), along and across the motion: a t**b + c km/h.
ALONG, ACROSS = (10.88, 0.23, -7.68), (5.76, 0.31, -2.72)


def perturbed_motion(u: np.ndarray, v: np.ndarray, minutes: float, km: float, step_minutes: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """(u, v) in cells a step with one Laplace-distributed error along and one across the motion, growing with the lead."""
    length = np.hypot(u, v)
    along_u, along_v = (np.divide(c, length, out=np.zeros_like(length), where=length > 1e-12) for c in (u, v))
    size = [max(a * minutes**b + c, 0.0) for a, b, c in (ALONG, ACROSS)]
    one, two = (rng.laplace(0, 1 / np.sqrt(2)) * s * step_minutes / 60 / km for s in size)  # km/h to cells a step
    return u + one * along_u - two * along_v, v + one * along_v + two * along_u


def mean_spectrum(fields: list[np.ndarray]) -> np.ndarray:
    """Mean amplitude spectrum of fields (missing cells as the least value): a filter for noise of their texture."""
    clean = [np.where(np.isnan(f), np.nanmin(f), f) for f in fields]
    return np.mean([np.abs(np.fft.fft2(f - f.mean())) for f in clean], axis=0)


def spectra(df: DataFrame, key: str, group: str) -> DataFrame:
    """group, iy, ix, amplitude: mean_spectrum over each group's fields; fields are transformed one a task and then averaged."""

    def transform(rows: pd.DataFrame) -> pd.DataFrame:
        y, x = rows["iy"].to_numpy(), rows["ix"].to_numpy()
        field = np.full((y.max() + 1, x.max() + 1), np.nan)
        field[y, x] = rows["value"]
        return pd.DataFrame({group: rows[group], "iy": y, "ix": x, "amplitude": mean_spectrum([field])[y, x]})

    each = df.groupBy(key).applyInPandas(transform, f"{group} {dict(df.dtypes)[group]}, iy int, ix int, amplitude double")
    return each.groupBy(group, "iy", "ix").agg(F.avg("amplitude").alias("amplitude"))


def noise_of(spectrum: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """White noise shaped by the spectrum, with mean 0 and deviation 1."""
    noise = np.real(np.fft.ifft2(np.fft.fft2(rng.normal(size=spectrum.shape)) * spectrum))
    return (noise - noise.mean()) / max(noise.std(), 1e-12)
