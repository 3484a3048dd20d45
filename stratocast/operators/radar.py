"""Radar operators: gate filters and hydrometeor classes as columns, echo classes as whole-field kernels."""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from stratocast.operators.fields import components

# Centroids of the nine classes by band (reflectivity, differential reflectivity, differential phase,
# correlation, height above the freezing level) and the limits (high, low) to which the moments are scaled.
VARIABLES = ("Zh", "ZDR", "KDP", "RhoHV", "relH")
WEIGHTS = (1.0, 1.0, 1.0, 0.75, 0.5)
CLASSES = ("DS", "CR", "LR", "GR", "RN", "VI", "WS", "MH", "IH")
CENTROIDS = {
    "C": [
        (13.5829, 0.4063, 0.0497, 0.9868, 1330.3),
        (2.8453, 0.2457, 0.0000, 0.9798, 653.8),
        (7.6597, 0.2180, 0.0019, 0.9799, -1426.5),
        (31.6815, 0.3926, 0.0828, 0.9978, 535.3),
        (39.4703, 1.0734, 0.4919, 0.9876, -1036.3),
        (4.8267, -0.5690, 0.0000, 0.9691, 869.8),
        (30.8613, 0.9819, 0.1998, 0.9845, -66.1),
        (52.3969, 2.1094, 2.4675, 0.9730, -1550.2),
        (50.6186, -0.0649, 0.0946, 0.9904, 1179.9),
    ],
    "X": [
        (19.0770, 0.4139, 0.0099, 0.9841, 1061.7),
        (3.9877, 0.5040, 0.0000, 0.9642, 856.6),
        (20.7982, 0.3177, 0.0004, 0.9858, -1375.1),
        (34.7124, -0.3748, 0.0988, 0.9828, 1224.2),
        (33.0134, 0.6614, 0.0819, 0.9802, -1169.8),
        (8.2610, -0.4681, 0.0000, 0.9722, 1100.7),
        (35.1801, 1.2830, 0.1322, 0.9162, -159.8),
        (52.4539, 2.3714, 1.1120, 0.9382, -1618.5),
        (44.2216, -0.3419, 0.0687, 0.9683, 1272.7),
    ],
}
LIMITS = {"Zh": (60.0, -10.0), "ZDR": (5.0, -1.5), "KDP": (7.0, -10.0), "RhoHV": (-5.23, -50.0)}


def centred(value: float, name: str) -> float:
    """A moment on the scale -1 to 1."""
    if name == "relH":
        return 2 / (1 + math.exp(-0.005 * value)) - 1
    if name == "KDP":
        value = 10 * math.log10(max(value, -0.5) + 0.6)
    elif name == "RhoHV":
        value = 10 * math.log10(1.0000000000001 - min(value, 1.0))
    high, low = LIMITS[name]
    return min(max(2 * (value - low) / (high - low) - 1, -1.0), 1.0)


def centred_column(value: Column, name: str) -> Column:
    """centred() inside Spark's code generation; null stays null."""
    if name == "relH":
        return 2 / (1 + F.exp(-0.005 * value)) - 1
    if name == "KDP":
        value = 10 * F.log10(F.when(value < -0.5, F.lit(-0.5)).otherwise(value) + 0.6)
    elif name == "RhoHV":
        value = 10 * F.log10(1.0000000000001 - F.when(value > 1, F.lit(1.0)).otherwise(value))
    high, low = LIMITS[name]
    scaled = 2 * (value - low) / (high - low) - 1
    return F.when(scaled < -1, F.lit(-1.0)).when(scaled > 1, F.lit(1.0)).otherwise(scaled)


def centred_centroids(band: str) -> list[list[float]]:
    return [[centred(v, name) for v, name in zip(row, VARIABLES, strict=True)] for row in CENTROIDS[band]]


def class_distances(moments: dict[str, Column], band: str = "C") -> Column:
    """Array of weighted distances to the nine centroids; a missing moment adds nothing, a missing Zh gives null."""
    scaled = {name: centred_column(moments[name], name) for name in VARIABLES}

    def distance(centre):
        total = F.lit(0.0)
        for name, c, w in zip(VARIABLES, centre, WEIGHTS, strict=True):
            total = total + F.coalesce(F.pow(F.lit(c) - scaled[name], F.lit(2.0)) * w, F.lit(0.0))
        return F.sqrt(total)

    return F.when(moments["Zh"].isNotNull(), F.array(*[distance(c) for c in centred_centroids(band)]))


def nearest_class(distances: Column) -> Column:
    """1 to 9: the first of the nearest centroids; 0 without distances."""
    return F.coalesce(F.array_position(distances, F.array_min(distances)), F.lit(0)).cast("int")


def decay(band: str, value: float = 50.0) -> list[float]:
    """How fast each class's share falls with distance: ln(value) over the distance to its nearest other centroid."""
    c, w = np.array(centred_centroids(band)), np.array(WEIGHTS)
    d = np.sqrt((w * (c[:, None] - c[None]) ** 2).sum(axis=2))
    return [float(math.log(value) / x) for x in np.sort(d, axis=1)[:, 1]]


def class_shares(distances: Column, band: str = "C") -> Column:
    """Shares of the classes in per cent, by the nearest class's decay."""
    rate = F.element_at(F.array(*map(F.lit, decay(band))), nearest_class(distances))
    raw = F.transform(distances, lambda d: F.exp(-rate * d))
    return F.when(distances.isNotNull(), F.transform(raw, lambda x: 100 * x / F.aggregate(raw, F.lit(0.0), lambda a, b: a + b)))


def class_entropy(shares: Column) -> Column:
    """Entropy of the shares in units of ln(9); a share of zero adds nothing."""
    part = lambda s: F.when(s > 0, -(s / 100) * F.log(s / 100) / math.log(len(CLASSES))).otherwise(0.0)
    return F.aggregate(shares, F.lit(0.0), lambda a, s: a + part(s))


def with_distances(table: DataFrame, moments: dict[str, Column], band: str, name: str) -> DataFrame:
    """The table with class_distances as a column. Each moment is scaled once for a row, in a step before the distances.

    As one expression the scaling stands in it 45 times, in a method too large to be compiled.
    """
    scaled = {f"{name}_{v}": centred_column(moments[v], v) for v in VARIABLES}
    weights = {f"{name}_{v}_w": F.when(F.col(f"{name}_{v}").isNull(), F.lit(0.0)).otherwise(F.lit(w)) for v, w in zip(VARIABLES, WEIGHTS, strict=True)}
    there = {f"{name}_{v}": F.coalesce(f"{name}_{v}", F.lit(0.0)) for v in VARIABLES}
    steps = table.withColumns(scaled | {f"{name}_there": moments["Zh"].isNotNull()}).withColumns(weights | there)
    distances = {}
    for i, centre in enumerate(centred_centroids(band)):
        total = F.lit(0.0)
        for v, c in zip(VARIABLES, centre, strict=True):
            away = F.lit(c) - F.col(f"{name}_{v}")
            total = total + away * away * F.col(f"{name}_{v}_w")
        distances[f"{name}_{i}"] = F.sqrt(total)
    every = F.array(*distances)
    return steps.withColumns(distances).withColumn(name, F.when(F.col(f"{name}_there"), every)).drop(*scaled, *weights, *distances, f"{name}_there")


def with_shares(table: DataFrame, distances: str, band: str, name: str, entropy: str) -> DataFrame:
    """The table with class_shares of a column of distances and their class_entropy, each class's share reckoned once for a row."""
    rates, schema = np.array(decay(band)), StructType([*table.schema.fields, StructField(name, ArrayType(DoubleType())), StructField(entropy, DoubleType())])

    def run(batches):
        for batch in batches:
            x = batch.column(distances)
            there = x.is_valid().to_numpy(zero_copy_only=False)
            d = x.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(CLASSES))
            raw = np.exp(-rates[np.where(np.isnan(d), np.inf, d).argmin(axis=1)][:, None] * d)
            shares = 100 * raw / sum(raw.T)[:, None]
            parts = np.where(shares > 0, -(shares / 100) * np.log(np.where(shares > 0, shares, 1.0) / 100) / math.log(len(CLASSES)), 0.0)
            every = np.zeros(len(there))
            every[there] = sum(parts.T)
            offsets = np.concatenate([[0], np.cumsum(there * len(CLASSES))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(shares.ravel()), mask=pa.array(~there))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array(every, mask=~there)], names=schema.names)

    return table.mapInArrow(run, schema)


def below(value: Column, limit: float, inclusive: bool = False, missing: bool = True) -> Column:
    """Gates under a limit; a missing value counts as `missing`. The other predicates follow the same rule."""
    return F.coalesce(value <= limit if inclusive else value < limit, F.lit(missing))


def above(value: Column, limit: float, inclusive: bool = False, missing: bool = True) -> Column:
    return F.coalesce(value >= limit if inclusive else value > limit, F.lit(missing))


def inside(value: Column, low: float, high: float, inclusive: bool = True, missing: bool = True) -> Column:
    low, high = min(low, high), max(low, high)
    return F.coalesce((value >= low) & (value <= high) if inclusive else (value > low) & (value < high), F.lit(missing))


def outside(value: Column, low: float, high: float, inclusive: bool = False, missing: bool = True) -> Column:
    low, high = min(low, high), max(low, high)
    return F.coalesce((value <= low) | (value >= high) if inclusive else (value < low) | (value > high), F.lit(missing))


def invalid(value: Column) -> Column:
    """Missing, NaN or infinite."""
    return F.coalesce(F.isnan(value) | (F.abs(value) == float("inf")), F.lit(True))


def excluded_by_moments(velocity: Column, refl: Column, ncp: Column, rhv: Column, least_ncp: float = 0.5, least_rhv: float = 0.5, refl_range: tuple[float, float] = (-20.0, 100.0)) -> Column:
    """Gates that a velocity retrieval leaves out: bad velocity, incoherent or uncorrelated signal, odd reflectivity."""
    return invalid(velocity) | below(ncp, least_ncp) | below(rhv, least_rhv) | outside(refl, *refl_range)


def a_trous(field: np.ndarray, scales: int) -> tuple[np.ndarray, np.ndarray]:
    """(detail of each scale, rest): B-spline smoothing with holes of 2**scale, borders mirrored. They sum to field."""
    most = max(int(math.log2(max(min(field.shape), 1))) - 1, 0)
    scales = most if scales < 0 else min(scales, most)

    def smooth(values, step, axis):
        n = values.shape[axis]
        at = np.arange(n)
        mirrored = lambda i: np.where(i < 0, -i, np.where(i > n - 1, 2 * (n - 1) - i, i))
        take = lambda k: np.take(values, mirrored(at + k), axis=axis)
        return (take(-2 * step) + take(2 * step)) / 16 + (take(-step) + take(step)) / 4 + 3 * values / 8

    details = np.zeros((scales, *field.shape))
    for s in range(scales):
        rest = smooth(smooth(field, 2**s, 1), 2**s, 0)
        details[s] = field - rest
        field = rest
    return details, field


def wavelet_classes(scale_break: int, zr: tuple[float, float] = (200.0, 1.6), core: float = 5.0, convective: float = 1.5, least: float = 5.0, least_convective: float = 25.0) -> Callable[[np.ndarray], np.ndarray]:
    """1 stratiform, 2 mixed, 3 convective core, 0 none; NaN where dBZ is missing."""

    def kernel(dbz):
        filled = np.nan_to_num(dbz)
        total = a_trous((10 ** (filled / 10) / zr[0]) ** (1 / zr[1]), scale_break)[0].sum(axis=0)
        strong = filled >= least_convective
        out = np.select([strong & (total >= core), strong & (total >= convective), filled >= least], [3.0, 2.0, 1.0], 0.0)
        return np.where(np.isnan(dbz), np.nan, out)

    return kernel


def scale_break(metres: float, kilometres: float) -> int:
    """The dyadic scale that parts convective from stratiform features."""
    return round(math.log2(kilometres / (metres / 1000)) + 1)


def _disc(radius: float, dx: float, dy: float) -> list[tuple[int, int]]:
    h, w = int(radius / dy), int(radius / dx)
    return [(j, i) for j in range(-h, h + 1) for i in range(-w, w + 1) if math.hypot(j * dy, i * dx) <= radius]


def background(dbz: np.ndarray, radius: float, dx: float, dy: float) -> np.ndarray:
    """Mean of linear reflectivity over a circle, back in dBZ; cells that are missing do not count."""
    z = np.where(np.isnan(dbz), 0.0, 10 ** (dbz / 10))
    known = ~np.isnan(dbz)
    total, count = np.zeros(dbz.shape), np.zeros(dbz.shape)
    ny, nx = dbz.shape
    for j, i in _disc(radius, dx, dy):
        to = (slice(max(-j, 0), ny - max(j, 0)), slice(max(-i, 0), nx - max(i, 0)))
        at = (slice(max(j, 0), ny - max(-j, 0)), slice(max(i, 0), nx - max(-i, 0)))
        total[to] += z[at]
        count[to] += known[at]
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(count > 0, 10 * np.log10(total / count), np.inf)


def convective_stratiform(dx: float, dy: float, intense: float = 42.0, radius: float = 11000.0, steps=((-999, 1000), (25, 2000), (30, 3000), (35, 4000), (40, 5000)), in_order: bool = True) -> Callable[[np.ndarray], np.ndarray]:
    """Steiner classes: 2 convective, 1 stratiform, NaN without echo.

    A cell is a centre where it is intense or stands out from its background; a centre makes every echo within its
    background's radius convective. The field is scanned column by column, and a cell that an earlier centre covers is no
    centre itself; with in_order False every centre counts, so the result does not depend on the order. First rows and
    columns count as all others.
    """

    def kernel(dbz):
        back = background(dbz, radius, dx, dy)
        known = ~np.isnan(dbz)
        need = np.where(back < 0, 10.0, np.where(back < 42.43, 10 - back**2 / 180, 0.0))
        with np.errstate(invalid="ignore"):
            centre = known & ((dbz >= intense) | (dbz - back >= need))
        spread = np.full(dbz.shape, float(steps[0][1]))
        for level, metres in steps[1:]:
            spread[back >= level] = metres
        hit = np.zeros(dbz.shape, bool)
        ny, nx = dbz.shape
        if in_order:
            for i, j in np.argwhere(centre.T).tolist():
                if not hit[j, i]:
                    h, w = int(spread[j, i] / dy), int(spread[j, i] / dx)
                    rows, columns = slice(max(j - h, 0), j + h + 1), slice(max(i - w, 0), i + w + 1)
                    y, x = np.ogrid[rows.start : min(j + h + 1, ny), columns.start : min(i + w + 1, nx)]
                    hit[rows, columns] |= np.hypot((y - j) * dy, (x - i) * dx) <= spread[j, i]
            return np.where(known, np.where(hit, 2.0, 1.0), np.nan)
        for metres in np.unique(spread[centre]):
            here = centre & (spread == metres)
            for j, i in _disc(metres, dx, dy):
                hit[max(j, 0) : ny - max(-j, 0), max(i, 0) : nx - max(-i, 0)] |= here[max(-j, 0) : ny - max(j, 0), max(-i, 0) : nx - max(i, 0)]
        return np.where(known, np.where(hit, 2.0, 1.0), np.nan)

    return kernel


def feature_classes(dx: float, dy: float, radius: float = 11000.0, always: float = 42.0, most: float = 10.0, zero_at: float = 42.43, least_cells: int = 1, edges: tuple[float, ...] = (25.0, 30.0, 35.0, 40.0), reach: float = 1000.0, weak: float | None = None) -> Callable[[np.ndarray], np.ndarray]:
    """2 for features, 1 for other echo, 0 for echo under `weak`, NaN without echo.

    Cores stand out from their background by a difference that falls as a cosine; connected cores of under least_cells
    cells are dropped; a core spreads over echo within reach times one more than the number of edges its background meets.
    """

    def kernel(dbz):
        back, known = background(dbz, radius, dx, dy), ~np.isnan(dbz)
        need = np.where(back < 0, most, np.maximum(most * np.cos(np.pi * np.where(np.isfinite(back), back, 0) / (2 * zero_at)), 0))
        with np.errstate(invalid="ignore"):
            core = known & ((dbz >= always) | (dbz - back >= need))
        area = components(np.where(core, 0, -1))
        sizes = np.bincount(area[area >= 0], minlength=dbz.size)
        core &= sizes[np.maximum(area, 0)] >= least_cells
        spread = reach * (1 + sum((back >= e).astype(int) for e in edges))
        hit = np.zeros(dbz.shape, bool)
        ny, nx = dbz.shape
        for metres in np.unique(spread[core]):
            here = core & (spread == metres)
            for j, i in _disc(metres, dx, dy):
                hit[max(j, 0) : ny - max(-j, 0), max(i, 0) : nx - max(-i, 0)] |= here[max(-j, 0) : ny - max(j, 0), max(-i, 0) : nx - max(i, 0)]
        out = np.where(hit, 2.0, 1.0)
        if weak is not None:
            with np.errstate(invalid="ignore"):
                out = np.where(dbz < weak, 0.0, out)
        return np.where(known, out, np.nan)

    return kernel


def _edges(velocity: np.ndarray, label: np.ndarray, gaps: tuple[int, int], wrap: bool) -> dict[int, dict[int, list[float]]]:
    """edges[a][b] = [number, sum of a's velocity less b's] of neighbouring gates of different regions.

    Gates with up to gaps (gates along a ray, rays) missing ones between them are neighbours too.
    """
    edges: dict[int, dict[int, list[float]]] = {}
    for axis, gap in ((0, gaps[0]), (1, gaps[1])):
        n = label.shape[axis]
        turned, values = (np.moveaxis(x, axis, 0) for x in (label, velocity))
        last = n if axis == 1 and wrap else 0  # how far a step may lead beyond the end
        for step in range(1, min(gap + 1, n - 1 if n > 1 else 0) + 1):
            start = np.arange(n if last else n - step)
            ahead = (start + step) % n
            use = (turned[start] >= 0) & (turned[ahead] >= 0) & (turned[start] != turned[ahead])
            for between in range(1, step):
                use &= turned[(start + between) % n] < 0
            la, lb, diff = turned[start][use], turned[ahead][use], (values[start] - values[ahead])[use]
            order = np.lexsort((lb, la))
            la, lb, diff = la[order], lb[order], diff[order]
            if not len(la):
                continue
            cuts = np.flatnonzero(np.r_[True, (np.diff(la) != 0) | (np.diff(lb) != 0)])
            for c, e in zip(cuts, [*cuts[1:], len(la)], strict=True):
                a, b, k, total = int(la[c]), int(lb[c]), int(e - c), float(diff[c:e].sum())
                for x, y, t in ((a, b, total), (b, a, -total)):
                    entry = edges.setdefault(x, {}).setdefault(y, [0, 0.0])
                    entry[0] += k
                    entry[1] += t
    return edges


def unfolded(nyquist: float, gaps: tuple[int, int] = (0, 0), wrap: bool = True) -> Callable[[np.ndarray], np.ndarray]:
    """Velocities of one sweep made continuous: regions are joined, the pair with the most common edges first.

    Gates fall into three bands of the Nyquist interval and connected gates of a band form regions. Joined regions
    differ by the multiple of the interval that brings their common edges closest; the larger one keeps its fold.
    Columns are rays; with wrap the first and the last are neighbours. Pairs wait in a heap and folds follow from a
    region's way to its root, so the work follows the number of common borders.
    """
    span = 2 * nyquist

    def kernel(velocity):
        band = np.where(~np.isnan(velocity), np.clip(((velocity + nyquist) / span * 3).astype(float), 0, 2.999), -1).astype(int)
        label = components(band, wrap)
        edges = _edges(velocity, label, gaps, wrap)
        size = {int(k): int(n) for k, n in zip(*np.unique(label[label >= 0], return_counts=True), strict=True)}
        up: dict[int, tuple[int, int]] = {}  # region: the one it joined, and by how many turns
        heap = [(-k, a, b) for a, near in edges.items() for b, (k, _) in near.items() if a < b]
        heapq.heapify(heap)
        while heap:
            k, a, b = heapq.heappop(heap)
            if b not in edges.get(a, ()) or edges[a][b][0] != -k:
                continue  # changed since
            keep, move = (a, b) if size[a] >= size[b] else (b, a)
            turn = round(edges[keep][move][1] / -k / span)
            up[move] = (keep, turn)
            size[keep] += size.pop(move)
            del edges[keep][move]
            for other, (n, total) in edges.pop(move).items():
                if other == keep:
                    continue
                del edges[other][move]
                for x, y, t in ((keep, other, total + turn * span * n), (other, keep, -total - turn * span * n)):
                    entry = edges.setdefault(x, {}).setdefault(y, [0, 0.0])
                    entry[0] += n
                    entry[1] += t
                low, high = min(keep, other), max(keep, other)
                heapq.heappush(heap, (-edges[low][high][0], low, high))
        turns = np.zeros(velocity.size)
        for region in reversed(up):  # joined last, resolved first
            keep, turn = up[region]
            turns[region] = turns[keep] + turn
        return np.where(label >= 0, velocity + turns[np.maximum(label, 0)] * span, velocity)

    return kernel


def anchored(nyquist: float, gaps: tuple[int, int] = (0, 0), wrap: bool = True) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Unfolded velocities moved to a reference field: each connected part by the turns that bring its mean difference closest to zero."""
    span = 2 * nyquist

    def kernel(velocity, reference):
        out = unfolded(nyquist, gaps, wrap)(velocity)
        part = components(np.where(np.isnan(velocity), -1, 0), wrap)
        both = (part >= 0) & ~np.isnan(reference)
        ids, at = np.unique(part[both], return_inverse=True)
        turns = np.zeros(velocity.size)
        turns[ids] = np.round(np.bincount(at, (reference - out)[both]) / np.maximum(np.bincount(at), 1) / span) if len(ids) else 0
        return np.where(part >= 0, out + turns[np.maximum(part, 0)] * span, out)

    return kernel
