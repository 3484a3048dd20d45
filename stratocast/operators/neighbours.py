"""Windows over space: weighted circles, masked and lead-dependent neighbourhoods, regridding, local correlation, cells of storms."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import Window

from stratocast.session import stored


def kernel(radius: int, weighted: bool) -> list[tuple[int, int, float]]:
    """(dy, dx, weight) of the cells in a circle; weights fall from 1 by the square of the distance to 0 at its edge."""
    out = []
    for y in range(-radius, radius + 1):
        for x in range(-radius, radius + 1):
            away = y * y + x * x
            if away < radius * radius or (away == radius * radius and not weighted):
                out.append((y, x, (radius * radius - away) / (radius * radius) if weighted else 1.0))
    return out


def circle_mean(grid: DataFrame, keys: list[str], radius: int, value: str, weighted: bool = False) -> DataFrame:
    """Mean (weighted or not) over the cells of a circle that exist and are not null; a row for each cell.

    Cells are dealt to square tiles, those near an edge also to the tiles beyond it; a tile's sums are array operations.
    """
    side, offsets = max(128, 8 * radius), kernel(radius, weighted)
    tiles = lambda c: F.explode(F.sequence(F.floor((F.col(c) - radius) / side), F.floor((F.col(c) + radius) / side)))
    dealt = grid.dropna(subset=keys).withColumn("tile_y", tiles("iy")).withColumn("tile_x", tiles("ix"))
    schema = StructType([*grid.schema.fields, StructField("mean", DoubleType())])

    def run(key, cells):
        ty, tx = key[-2].as_py(), key[-1].as_py()
        y, x = (cells[c].to_numpy().astype(np.int64) - t * side + radius for c, t in (("iy", ty), ("ix", tx)))
        there = cells[value].is_valid().to_numpy()
        v = cells[value].cast(pa.float64()).to_numpy()
        wide = side + 2 * radius
        place = (y * wide + x)[there]
        sums, counts = (np.bincount(place, w, wide * wide).reshape(wide, wide) for w in (v[there], np.ones(len(place))))
        s, n = np.zeros((side, side)), np.zeros((side, side))
        for dy, dx, w in offsets:
            here = np.s_[radius + dy : radius + dy + side, radius + dx : radius + dx + side]
            s += w * sums[here]
            n += w * counts[here]
        own = (y >= radius) & (y < radius + side) & (x >= radius) & (x < radius + side)
        at = (y[own] - radius, x[own] - radius)
        some = n[at] > 1e-9
        mean = pa.array(s[at] / np.where(some, n[at], 1.0), mask=~some)
        return cells.select(grid_columns).filter(pa.array(own)).append_column("mean", mean)

    grid_columns = grid.columns
    return dealt.groupBy(*keys, "tile_y", "tile_x").applyInArrow(run, schema)


def masked_mean(grid: DataFrame, mask: DataFrame, keys: list[str], radius: int, value: str, remask: bool = True) -> DataFrame:
    """Square-window means of each mask layer (band, iy, ix, m): cells outside a layer take no part in it.

    remask leaves out of the result the cells that their layer does not hold.
    """
    layers = grid.select(*keys, "iy", "ix", value).join(mask.select("band", "iy", "ix", "m"), ["iy", "ix"])
    inside = layers.withColumn("u", F.when(F.col("m") > 0, F.col(value)))
    by = [*keys, "band"]
    across = Window.partitionBy(*by, "iy").orderBy("ix").rangeBetween(-radius, radius)
    down = Window.partitionBy(*by, "ix").orderBy("iy").rangeBetween(-radius, radius)
    rows = inside.withColumn("s", F.sum("u").over(across)).withColumn("n", F.count("u").over(across))
    out = rows.withColumn("total", F.sum("s").over(down)).withColumn("count", F.sum("n").over(down))
    mean = F.when(F.col("count") > 0, F.col("total") / F.col("count"))
    return out.select(*by, "iy", "ix", (F.when(F.col("m") > 0, mean) if remask else mean).alias("mean"))


def collapsed_layers(layers: DataFrame, weights: DataFrame, keys: list[str]) -> DataFrame:
    """Weighted mean of the layers' means (band, mean) by their weights (band, iy, ix, w), nulls passed over."""
    joined = layers.join(weights, ["band", "iy", "ix"]).where("mean is not null and w is not null")
    return joined.groupBy(*keys, "iy", "ix").agg((F.sum(F.col("w") * F.col("mean")) / F.when(F.sum("w") != 0, F.sum("w"))).alias("mean"))


def circular_mean(table: DataFrame, keys: list[str], degrees: str) -> DataFrame:
    """Mean direction as the angle of the mean unit vector, and that vector's length."""
    x, y = F.avg(F.cos(F.radians(degrees))), F.avg(F.sin(F.radians(degrees)))
    return table.groupBy(*keys).agg(F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0)).alias("direction"), F.sqrt(x * x + y * y).alias("length"))


def lead_box_mean(grid: DataFrame, keys: list[str], lead: str, radii: list[tuple[int, int]], value: str) -> DataFrame:
    """Square-window means whose radius (cells) depends on the lead: (lead, radius) pairs, the lead's own kept apart."""
    out = None
    for hours, radius in radii:
        own = grid.where(F.col(lead) == hours)
        across = Window.partitionBy(*keys, lead, "iy").orderBy("ix").rangeBetween(-radius, radius)
        down = Window.partitionBy(*keys, lead, "ix").orderBy("iy").rangeBetween(-radius, radius)
        rows = own.withColumn("s", F.sum(value).over(across)).withColumn("n", F.count(value).over(across))
        mean = rows.withColumn("mean", F.sum("s").over(down) / F.sum("n").over(down)).drop("s", "n")
        out = mean if out is None else out.unionByName(mean)
    return out


def spacing(axis: DataFrame, coordinate: str, tolerance: float = 1e-6) -> DataFrame:
    """least and greatest step of an axis and whether they agree."""
    c = F.col(coordinate)
    steps = axis.select(coordinate).distinct().select((c - F.lag(c).over(Window.orderBy(coordinate))).alias("step")).where("step is not null")
    return steps.agg(F.min("step").alias("least"), F.max("step").alias("greatest")).withColumn("equal", F.col("greatest") - F.col("least") <= tolerance)


def radius_in_cells(metres: float, spacing_metres: float) -> int:
    """Whole cells within a radius; raises for a radius under one cell."""
    cells = int(metres / spacing_metres)
    if cells < 1:
        raise ValueError(f"{metres} metres hold no cell of {spacing_metres}")
    return cells


def regridded(grid: DataFrame, keys: list[str], value: str, shape: tuple[int, int], y: tuple[float, float, int], x: tuple[float, float, int]) -> DataFrame:
    """Linear interpolation to a regular target: y and x are (first, step, number) in source cells, edges held.

    Each target cell asks for its four source cells; a weight table in columns, so one equi-join and one sum.
    """
    spark = grid.sparkSession
    target = spark.range(y[2] * x[2]).select(F.floor(F.col("id") / x[2]).cast("int").alias("ty"), (F.col("id") % x[2]).cast("int").alias("tx"))
    held = lambda first, step, at, n: F.least(F.greatest(F.lit(float(first)) + at * step, F.lit(0.0)), F.lit(float(n - 1)))
    at = target.withColumn("fy", held(y[0], y[1], F.col("ty"), shape[0])).withColumn("fx", held(x[0], x[1], F.col("tx"), shape[1]))
    y0, x0 = (F.least(F.floor(c), F.lit(n - 2)).cast("int") for c, n in (("fy", shape[0]), ("fx", shape[1])))
    wy, wx = F.col("fy") - y0, F.col("fx") - x0
    corners = F.array(*[F.struct((y0 + a).alias("iy"), (x0 + b).alias("ix"), ((wy if a else 1 - wy) * (wx if b else 1 - wx)).alias("w")) for a in (0, 1) for b in (0, 1)])
    asked = at.select("ty", "tx", F.inline(corners))
    return grid.join(asked, ["iy", "ix"]).groupBy(*keys, "ty", "tx").agg(F.sum(F.col("w") * F.col(value)).alias(value))


def nearest_weighted(source: DataFrame, target: DataFrame, k: int, reach: float) -> DataFrame:
    """Inverse-square mean of the k nearest source points (point, x, y metres, value) within reach of each target (id, x, y).

    Both sides are dealt into squares of the reach; a target asks its square and the eight around it. Every source row
    is a point of its own, also where several share a place: the nearest by distance, x, y and point count. Points that
    a target stands on give their greatest value alone.
    """
    cell = lambda c: F.floor(F.col(c) / reach).cast("long")
    asked = target.select("id", F.col("x").alias("x0"), F.col("y").alias("y0"), F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])).alias("o"))
    asked = asked.select("id", "x0", "y0", (cell("x0") + F.col("o.a")).alias("cx"), (cell("y0") + F.col("o.b")).alias("cy"))
    near = asked.join(source.select("point", "x", "y", "value", cell("x").alias("cx"), cell("y").alias("cy")), ["cx", "cy"])
    near = near.withColumn("d", F.sqrt(F.pow(F.col("x") - F.col("x0"), 2) + F.pow(F.col("y") - F.col("y0"), 2))).where(F.col("d") <= reach)
    ranked = near.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy("d", "x", "y", "point"))).where(F.col("place") <= k)
    w = 1 / F.pow(F.greatest("d", F.lit(1e-3)), 2)
    on = F.max(F.when(F.col("d") < 1e-3, F.col("value")))
    return ranked.groupBy("id").agg(F.coalesce(on, F.sum(w * F.col("value")) / F.sum(w)).alias("value"))


def gates_on_grid(gates: DataFrame, spacing_degrees: float, lon0: float, lat0: float) -> DataFrame:
    """Cells with the gate nearest to their middle, of the gates (lon, lat, value) that fall in them; ties to the least value."""
    iy, ix = F.round((F.col("lat") - lat0) / spacing_degrees).cast("int"), F.round((F.col("lon") - lon0) / spacing_degrees).cast("int")
    placed = gates.where("value is not null").withColumn("iy", iy).withColumn("ix", ix)
    away = F.pow(F.col("lat") - lat0 - F.col("iy") * spacing_degrees, 2) + F.pow(F.col("lon") - lon0 - F.col("ix") * spacing_degrees, 2)
    return placed.groupBy("iy", "ix").agg(F.min_by("value", F.struct(F.round(away, 12).alias("a"), F.col("value").alias("b"))).alias("value"))


def gradient_recentred(grid: DataFrame, keys: list[str], value: str, along: str, other: str, spacing_metres: float) -> DataFrame:
    """Gradient between neighbouring cells brought back to cell middles; at the ends 1.5 of the first less 0.5 of the next."""
    w = Window.partitionBy(*keys, other).orderBy(along)
    steps = grid.withColumn("up", (F.lead(value).over(w) - F.col(value)) / spacing_metres).withColumn("down", (F.col(value) - F.lag(value).over(w)) / spacing_metres)
    up2, down2 = F.lead("up").over(w), F.lag("down").over(w)
    middle = F.when(F.col("down").isNull(), 1.5 * F.col("up") - 0.5 * F.coalesce(up2, F.col("up"))).when(F.col("up").isNull(), 1.5 * F.col("down") - 0.5 * F.coalesce(down2, F.col("down")))
    return steps.withColumn("gradient", middle.otherwise((F.col("up") + F.col("down")) / 2)).drop("up", "down")


def dilated(grid: DataFrame, keys: list[str], mask: str, radius: int) -> DataFrame:
    """Whether any cell within a square of the radius is set: two separable windows."""
    across = Window.partitionBy(*keys, "iy").orderBy("ix").rangeBetween(-radius, radius)
    down = Window.partitionBy(*keys, "ix").orderBy("iy").rangeBetween(-radius, radius)
    return grid.withColumn("row_max", F.max(F.col(mask).cast("int")).over(across)).withColumn("dilated", F.max("row_max").over(down) > 0).drop("row_max")


def window_correlation(grid: DataFrame, keys: list[str], a: str, b: str, radius: int) -> DataFrame:
    """Correlation of two fields over the square window around each cell, where both have values; null where one of them is constant.

    As all windows here it wants a row for every cell, with null for a missing value.
    """
    across = Window.partitionBy(*keys, "iy").orderBy("ix").rangeBetween(-radius, radius)
    down = Window.partitionBy(*keys, "ix").orderBy("iy").rangeBetween(-radius, radius)
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y = (F.when(both, F.col(c).cast("double")) for c in (a, b))
    terms = {"n": F.when(both, 1.0), "sx": x, "sy": y, "sxx": x * x, "syy": y * y, "sxy": x * y}
    rows = grid
    for name, term in terms.items():
        rows = rows.withColumn(f"r_{name}", F.sum(term).over(across))
    for name in terms:
        rows = rows.withColumn(f"w_{name}", F.sum(f"r_{name}").over(down))
    n, sx, sy, sxx, syy, sxy = (F.col(f"w_{t}") for t in terms)
    vx, vy = n * sxx - sx * sx, n * syy - sy * sy
    out = rows.withColumn("corr", F.when((vx > 1e-9) & (vy > 1e-9), (n * sxy - sx * sy) / F.sqrt(vx * vy)))
    return out.drop(*[f"{p}_{t}" for p in "rw" for t in terms])


def storm_cells(labels: DataFrame, keys: list[str], label: str, value: str, fewest: int, least_peak: float) -> DataFrame:
    """A row for each labelled storm: cells, peak, where it peaks, centre weighted by value; small and weak ones go."""
    y, x, v = F.col("iy"), F.col("ix"), F.col(value)
    peak = F.max_by(F.struct("iy", "ix"), F.struct(v.alias("v"), (-y).alias("y"), (-x).alias("x")))
    cells = labels.where(F.col(label) > 0).groupBy(*keys, label).agg(
        F.count("*").alias("cells"), F.max(v).alias("peak"), peak.alias("at"), (F.sum(y * v) / F.sum(v)).alias("centre_y"), (F.sum(x * v) / F.sum(v)).alias("centre_x")
    )
    kept = cells.where((F.col("cells") >= fewest) & (F.col("peak") >= least_peak))
    return kept.select(*keys, label, "cells", "peak", F.col("at.iy").alias("peak_y"), F.col("at.ix").alias("peak_x"), "centre_y", "centre_x")


def local_peaks(grid: DataFrame, keys: list[str], value: str, radius: int, least: float) -> DataFrame:
    """Cells that hold the greatest value of the square window around them, at or over `least`."""
    across = Window.partitionBy(*keys, "iy").orderBy("ix").rangeBetween(-radius, radius)
    down = Window.partitionBy(*keys, "ix").orderBy("iy").rangeBetween(-radius, radius)
    rows = grid.withColumn("m", F.max(value).over(across)).withColumn("m", F.max("m").over(down))
    return rows.where((F.col(value) == F.col("m")) & (F.col(value) >= least)).drop("m")


def region_greatest(grid: DataFrame, inside: Column, value: str) -> DataFrame:
    """Greatest value and number of the cells inside a region."""
    return grid.where(inside).agg(F.max(value).alias("greatest"), F.count("*").alias("cells"))


EARTH = 6371.0  # km


def _on_sphere(lon: str, lat: str) -> list[Column]:
    a, b = F.radians(lon), F.radians(lat)
    return [(EARTH * F.cos(b) * F.cos(a)).alias("x"), (EARTH * F.cos(b) * F.sin(a)).alias("y"), (EARTH * F.sin(b)).alias("z")]


def sphere_neighbours(stations: DataFrame, cells: DataFrame, k: int, reach: float) -> DataFrame:
    """id, place, d (chord in km), value: the k nearest stations (id, lon, lat, value) of each cell (id, lon, lat), at any distance.

    Stations are dealt to the cubes of `reach` km around theirs, so a cell meets only those near it. Cells with under k
    stations within reach go on with four times the reach, till the earth is covered: their number falls with every round.
    Of the stations at one place only the first k can be among the k nearest of any cell. Rounds are written, so a
    plan does not hold those before it, and the dealt stations are never broadcast: they are 27 times as many.
    """
    there = stations.where("value is not null").select(F.col("id").alias("station"), "value", *_on_sphere("lon", "lat"))
    first = F.row_number().over(Window.partitionBy("x", "y", "z").orderBy("station"))
    spots = stored(there.withColumn("turn", first).where(F.col("turn") <= k).drop("turn"), "spots")
    todo = stored(cells.select("id", *[c.alias(f"{n}0") for c, n in zip(_on_sphere("lon", "lat"), "xyz", strict=True)]), "cells")
    done = None
    while True:
        cube = lambda c: F.floor(F.col(c) / reach).cast("long")  # noqa: B023, E731
        moves = F.array(*[F.struct(*[F.lit(s).alias(n) for s, n in zip((a, b, c), "abc", strict=True)]) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)])
        spread = spots.select("*", F.explode(moves).alias("o")).select("station", "value", "x", "y", "z", *[(cube(c) + F.col(f"o.{n}")).alias(f"c{c}") for c, n in zip("xyz", "abc", strict=True)])
        asked = todo.select("*", *[cube(f"{c}0").alias(f"c{c}") for c in "xyz"])
        d = F.sqrt(F.pow(F.col("x") - F.col("x0"), 2) + F.pow(F.col("y") - F.col("y0"), 2) + F.pow(F.col("z") - F.col("z0"), 2))
        near = asked.join(spread.hint("merge"), ["cx", "cy", "cz"]).withColumn("d", d).where(F.col("d") <= reach)
        ranked = near.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy("d", "station"))).where(F.col("place") <= k)
        whole = ranked.withColumn("n", F.count("*").over(Window.partitionBy("id")))
        last = reach >= 2 * EARTH
        found = stored((whole if last else whole.where(F.col("n") == k)).select("id", "place", "d", "value"), "neighbours")
        done = found if done is None else done.unionByName(found)
        if last:
            return done
        todo = stored(todo.join(found.select("id").distinct(), "id", "left_anti"), "cells")
        if todo.isEmpty():
            return done
        reach = max(reach * 4, 2 * EARTH) if reach * 4 > EARTH else reach * 4


def sphere_analysis(stations: DataFrame, cells: DataFrame, k: int = 8, effect: float = 1000.0, power: float = 2.0, background: str | None = None) -> DataFrame:
    """Cells (id, lon, lat) with value: without a background the inverse-distance mean of the k nearest stations, 0 where the
    nearest is beyond `effect`; with one (a column of cells), the background and the mean residual, each station's also
    falling as a Gaussian of effect. Stations' values are residuals then (see residuals)."""
    cells = stored(cells, "cells")
    near = sphere_neighbours(stations, cells, k, effect).withColumn("d", F.col("d") + 1e-6 if k > 1 else F.col("d"))
    w, gauss = 1 / F.pow("d", F.lit(power)), F.exp(-F.pow(F.col("d") / effect, 2))
    if background is None:
        mean = F.sum(w * F.col("value")) / F.sum(w) if k > 1 else F.max("value")
        out = near.groupBy("id").agg(F.when(F.min("d") <= effect, mean).otherwise(0.0).alias("value"))
        return cells.drop("value").join(out, "id", "left").withColumn("value", F.coalesce("value", F.lit(0.0)))
    mean = F.sum(w * gauss * F.col("value")) / F.sum(w) if k > 1 else F.max(F.when(F.col("d") <= effect, gauss * F.col("value")).otherwise(0.0))
    out = near.groupBy("id").agg(mean.alias("step"))
    return cells.join(out, "id", "left").withColumn("value", F.col(background) + F.coalesce("step", F.lit(0.0))).drop("step")


def residuals(stations: DataFrame, grid: DataFrame, value: str) -> DataFrame:
    """Stations (id, fy, fx in cell units, value) with their value less the grid's at their place; those off the grid go."""
    y0, x0 = F.floor("fy").cast("int"), F.floor("fx").cast("int")
    wy, wx = F.col("fy") - y0, F.col("fx") - x0
    corners = F.array(*[F.struct((y0 + a).alias("iy"), (x0 + b).alias("ix"), ((wy if a else 1 - wy) * (wx if b else 1 - wx)).alias("w")) for a in (0, 1) for b in (0, 1)])
    met = stations.select("id", F.inline(corners)).where("w > 0").join(grid.select("iy", "ix", F.col(value).alias("at")), ["iy", "ix"], "left")
    there = met.groupBy("id").agg(F.when(F.count("at") == F.count("*"), F.sum(F.col("w") * F.col("at"))).alias("at"))
    return stations.join(there, "id").where("at is not null").withColumn("value", F.col("value") - F.col("at")).drop("at")
