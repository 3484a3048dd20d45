"""Cleaning and selecting values as columns: ranges, replacements, boxes, polygons, masks, units and physical limits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def in_range(value: Column, low: float, high: float, fill: float | None = None) -> Column:
    """The value as a float where it lies within [low, high]; fill elsewhere and for nulls."""
    return F.when(value.between(low, high), value).otherwise(F.lit(fill)).cast("float")


def replaced_below(value: Column, number: float, limit: float, most: float | None = None) -> Column:
    """number in place of values under the limit; values over `most` come down to it."""
    low = F.when(value < limit, F.lit(float(number))).otherwise(value)
    return low if most is None else F.when(low > most, F.lit(float(most))).otherwise(low)


def replaced_from(value: Column, number: float, limit: float, most: float | None = None) -> Column:
    """number in place of values at and over the limit."""
    high = F.when(value >= limit, F.lit(float(number))).otherwise(value)
    return high if most is None else F.when(high > most, F.lit(float(most))).otherwise(high)


def set_to(value: Column, number: float) -> Column:
    """number wherever a value stands."""
    return F.when(value.isNotNull(), F.lit(float(number)))


def in_box(lon: Column, lat: Column, left: float, right: float, bottom: float, top: float) -> Column:
    """Whether a point lies in the box, its right and top edges left out."""
    return (lon >= left) & (lon < right) & (lat >= bottom) & (lat < top)


def in_polygon(x: Column, y: Column, corners: list[tuple[float, float]]) -> Column:
    """Whether a point lies in the polygon: an odd number of edges lies to its right. Level edges are passed over."""
    edges = [(x1, y1, x2, y2) for (x1, y1), (x2, y2) in zip(corners, [*corners[1:], *corners[:1]], strict=True) if abs(y1 - y2) > 1e-12]
    sides = [((F.lit(float(y1)) > y) != (F.lit(float(y2)) > y)) & (x < F.lit((x2 - x1) / (y2 - y1)) * (y - y1) + x1) for x1, y1, x2, y2 in edges]
    return reduce(lambda a, b: a + b, [s.cast("int") for s in sides], F.lit(0)) % 2 == 1


def replaced_where_far(value: Column, other: Column, least: float) -> Column:
    """other where the two differ by at least `least`."""
    return F.when(F.abs(value - other) >= least, other).otherwise(value)


def land_only(value: Column, land: Column) -> Column:
    """The value where land is 1."""
    return F.when(land == 1, value)


def land_and_sea(calibrated: Column, uncalibrated: Column) -> Column:
    """The calibrated value; where there is none, the uncalibrated one."""
    return F.coalesce(calibrated, uncalibrated)


# Physical limits by element: (low, replacement or None to drop, whether the limit itself counts), the same above.
LIMITS = {
    "temperature": ((-60.0, None, True), (60.0, None, True)),
    "relative_humidity": ((0.0, 0.1, True), (100.0, 100.0, False)),
    "total_cloud": ((0.0, 0.0, True), (1.0, 1.0, False)),
    "visibility": ((10.0, 10.0, False), (100000.0, 100000.0, True)),
    "ws": ((0.0, 0.0, False), (120.0, None, True)),
    "u": ((-80.0, None, True), (80.0, None, True)),
    "v": ((-80.0, None, True), (80.0, None, True)),
    "precipitation": ((0.0, 0.0, False), (2000.0, None, True)),
}


def physical(value: Column, element: Column) -> Column:
    """The value within its element's limits: brought to them or dropped; other elements pass."""
    out = F.lit(None).cast("double")
    known = F.lit(False)
    for name, ((low, at_low, low_counts), (high, at_high, high_counts)) in LIMITS.items():
        under = value <= low if low_counts else value < low
        over = value >= high if high_counts else value > high
        here = element == name
        known = known | here
        out = F.when(here, F.when(under, F.lit(at_low)).when(over, F.lit(at_high)).otherwise(value)).otherwise(out)
    return F.when(known, out).otherwise(value)


def joined_predicate(before: Column, added: Column, how: str) -> Column:
    """How a further predicate joins those before it: or, and, new (it alone counts)."""
    return {"or": before | added, "and": before & added, "new": added}[how]


def flat_gate(value: Column, before: Column, after: Column) -> Column:
    """Whether a gate and both neighbours hold the same value; gates at the ends do not."""
    return F.coalesce((value == before) & (value == after), F.lit(False))


def core_by_cosine(value: Column, background: Column, most: float, zero_at: float, always: float) -> Column:
    """Whether an echo is a core: over `always`, or over its background by a difference that falls as a cosine to zero."""
    least = F.when(background < 0, F.lit(most)).otherwise(F.greatest(most * F.cos(F.lit(3.141592653589793) * background / (2 * zero_at)), F.lit(0.0)))
    return (value >= always) | (value - background >= least)


def core_by_factor(value: Column, background: Column, factor: float, always: float, add: bool = False) -> Column:
    """The same with a difference that is constant (add) or grows with the background."""
    least = F.when(background < 0, F.lit(0.0)).otherwise(F.greatest(F.lit(factor) if add else factor * background - background, F.lit(0.0)))
    return (value >= always) | (value - background >= least)


def radius_class(background: Column, edges: list[float]) -> Column:
    """How many of the ascending edges the background reaches."""
    return reduce(lambda a, b: a + b, [(background >= e).cast("int") for e in edges], F.lit(0))


def segment(lead_hours: Column, hours: int = 12) -> Column:
    """The segment of leads a lead falls in, from 1: (s - 1) * hours < lead <= s * hours."""
    return F.ceil(lead_hours / hours).cast("int")


def segment_leads(segment_: Column, hours: int = 12, step: int = 3) -> Column:
    """The leads of a segment."""
    return F.sequence((segment_ - 1) * hours + step, segment_ * hours, F.lit(step))


def cloud_percent(cloud: Column, greatest: Column, fraction_at_most: float = 1.1) -> Column:
    """Cloud in per cent: 100 times the value where the whole field's greatest shows that it holds fractions."""
    return F.when(greatest <= fraction_at_most, cloud * 100).otherwise(cloud)


#: Unit pairs as (factor, offset): new = factor * old + offset.
UNITS = {
    ("K", "celsius"): (1.0, -273.15), ("celsius", "K"): (1.0, 273.15), ("celsius", "fahrenheit"): (1.8, 32.0), ("fahrenheit", "celsius"): (5 / 9, -160 / 9), ("hPa", "Pa"): (100.0, 0.0), ("Pa", "hPa"): (0.01, 0.0),
    ("m s-1", "km h-1"): (3.6, 0.0), ("km h-1", "m s-1"): (1 / 3.6, 0.0), ("m s-1", "knot"): (3600 / 1852, 0.0), ("knot", "m s-1"): (1852 / 3600, 0.0), ("m", "mm"): (1000.0, 0.0), ("mm", "m"): (0.001, 0.0),
    ("m", "km"): (0.001, 0.0), ("km", "m"): (1000.0, 0.0), ("1", "%"): (100.0, 0.0), ("%", "1"): (0.01, 0.0), ("mm h-1", "m s-1"): (1 / 3.6e6, 0.0), ("m s-1", "mm h-1"): (3.6e6, 0.0),
}
#: Seconds of a time unit.
SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}


def converted(value: Column, unit: str, wanted: str) -> Column:
    """The value in another unit; raises for pairs that are not known."""
    factor, offset = (1.0, 0.0) if unit == wanted else UNITS[unit, wanted]
    return value * factor + offset


def lead_seconds(lead: Column, unit: str = "hour") -> Column:
    """A lead as seconds."""
    return (lead * SECONDS[unit.rstrip("s")]).cast("long")


def lead_in(seconds: Column, unit: str = "hour") -> Column:
    """Seconds as a lead."""
    return seconds / SECONDS[unit.rstrip("s")]


def rounded(coordinate: Column, digits: int = 4) -> Column:
    """Coordinates as they are compared."""
    return F.round(coordinate, digits)


def angle_parts(degrees: Column, radius: Column) -> tuple[Column, Column]:
    """An angle as a vector of the radius: real and imaginary part."""
    return radius * F.cos(F.radians(degrees)), radius * F.sin(F.radians(degrees))


def angle_of(real: Column, imaginary: Column) -> Column:
    """A vector's angle in degrees from 0 up to 360."""
    return F.pmod(F.degrees(F.atan2(imaginary, real)), F.lit(360.0))


def filled(value: Column, missing: Column, fill: float | None = None) -> Column:
    """fill where missing holds."""
    return F.when(missing, F.lit(fill)).otherwise(value)


def row_interpolated(x: Column, xs: list[float], values: Column) -> Column:
    """Linear interpolation at x between points xs with an array of values; beyond the ends the end's value."""
    y = [F.get(values, F.lit(i)) for i in range(len(xs))]
    out = F.when(x <= xs[0], y[0])
    for i in range(1, len(xs)):
        out = out.when(x <= xs[i], y[i - 1] + (x - xs[i - 1]) / (xs[i] - xs[i - 1]) * (y[i] - y[i - 1]))
    return out.otherwise(y[-1])


def recycled(index: Column, n: int) -> Column:
    """A member's number when n members are used again in turn."""
    return F.pmod(index, F.lit(n))


def time_parts(text: Column) -> list[Column]:
    """Year, month, day and hour of a text of ten digits."""
    return [F.substring(text, a, n).alias(name) for a, n, name in ((1, 4, "year"), (5, 2, "month"), (7, 2, "day"), (9, 2, "hour"))]


def chunked(values: Column, n: int) -> Column:
    """An array cut into arrays of n, the last one shorter."""
    starts = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(values) / n).cast("int") - 1, F.lit(0)))
    return F.when(F.size(values) == 0, F.array().cast("array<array<string>>")).otherwise(F.transform(starts, lambda i: F.slice(values, i * n + 1, n).cast("array<string>")))


def lambert(lon: Column, lat: Column, lon0: float, lat1: float, lat2: float, lat0: float, radius: float = 6371229.0) -> tuple[Column, Column]:
    """Metres east and north on a Lambert conformal cone through lat1 and lat2, from (lon0, lat0)."""
    import math

    turn = lambda d: math.tan(math.pi / 4 + math.radians(d) / 2)
    n = math.sin(math.radians(lat1)) if abs(lat1 - lat2) < 1e-9 else math.log(math.cos(math.radians(lat1)) / math.cos(math.radians(lat2))) / math.log(turn(lat2) / turn(lat1))
    f = math.cos(math.radians(lat1)) * turn(lat1) ** n / n
    rho0 = radius * f / turn(lat0) ** n
    rho = radius * f / F.pow(F.tan(F.radians(lat) / 2 + math.pi / 4), F.lit(n))
    theta = F.radians(F.pmod(lon - lon0 + 180, F.lit(360.0)) - 180) * n
    return rho * F.sin(theta), rho0 - rho * F.cos(theta)


def equal_area(lon: Column, lat: Column, lon0: float, lat0: float, radius: float = 6371229.0) -> tuple[Column, Column]:
    """Metres east and north on the Lambert azimuthal equal-area plane that touches at (lon0, lat0)."""
    import math

    a, b = F.radians(lat), F.radians(lon - lon0)
    s, c = math.sin(math.radians(lat0)), math.cos(math.radians(lat0))
    k = radius * F.sqrt(2 / (1 + s * F.sin(a) + c * F.cos(a) * F.cos(b)))
    return k * F.cos(a) * F.sin(b), k * (c * F.sin(a) - s * F.cos(a) * F.cos(b))


def equal_distance(lon: Column, lat: Column, lon0: float, lat0: float, radius: float = 6371229.0) -> tuple[Column, Column]:
    """Metres east and north on the plane that keeps distances along meridians and the circle of latitude lat0."""
    import math

    return F.radians(lon - lon0) * (radius * math.cos(math.radians(lat0))), F.radians(lat - lat0) * radius
