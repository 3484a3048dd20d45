"""Scalar weather functions: Column in, Column out, all inside Spark's code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The constants of the published formulas.
TRIPLE_POINT_K = 273.16
ZERO_C_K = 273.15
LIQUID = (10.79574, 5.028, 1.50475e-4, -8.2969, 0.42873e-3, 4.76955, 0.78614)
ICE = (-9.09685, 3.56654, 0.87682, 0.78614)
RAIN_BY_KDP = {"S": (50.70, 0.85), "C": (29.70, 0.85), "X": (15.81, 0.7992)}
RAIN_BY_ATTENUATION = {"S": (3100.0, 1.03), "C": (250.0, 0.91), "X": (45.5, 0.83)}
LAPSE_K_PER_M = -0.0098
STANDARD_LAPSE_K_PER_M = -0.0065


def wind_chill(temperature_c: Column, wind_kmh: Column) -> Column:
    """Wind chill in deg C; wind counts as at least 4.824 km/h."""
    v = F.pow(F.greatest(wind_kmh, F.lit(4.824)), F.lit(0.16))
    return 13.12 + 0.6215 * temperature_c - 11.37 * v + 0.3965 * temperature_c * v


def vapour_pressure_goff_gratch(temperature_k: Column) -> Column:
    """Saturation vapour pressure of pure water in hPa, over liquid above the triple point and over ice below."""
    a, b, c, d, e, f, g = LIQUID
    t = temperature_k / TRIPLE_POINT_K
    over_water = a * (1 - 1 / t) - b * F.log10(t) + c * (1 - F.pow(F.lit(10.0), d * (t - 1))) + e * (F.pow(F.lit(10.0), f * (1 - 1 / t)) - 1) + g
    p, q, r, s = ICE
    over_ice = p * (1 / t - 1) - q * F.log10(1 / t) + r * (1 - t) + s
    return F.pow(F.lit(10.0), F.when(temperature_k > TRIPLE_POINT_K, over_water).otherwise(over_ice))


def vapour_pressure_in_air(temperature_k: Column, pressure_pa: Column) -> Column:
    """Saturation vapour pressure in Pa, corrected for pressure and temperature."""
    c = temperature_k - ZERO_C_K
    return 100 * vapour_pressure_goff_gratch(temperature_k) * (1 + 1e-8 * pressure_pa * (4.5 + 6e-4 * c * c))


def relative_humidity(temperature_k: Column, dew_point_k: Column) -> Column:
    """Per cent, from the two vapour pressures; neither input is changed."""
    return 100 * vapour_pressure_goff_gratch(dew_point_k) / vapour_pressure_goff_gratch(temperature_k)


def apparent_temperature(temperature_c: Column, wind_ms: Column, humidity: Column, pressure_pa: Column) -> Column:
    """Apparent temperature in deg C; humidity as a fraction."""
    svp = vapour_pressure_in_air(temperature_c + ZERO_C_K, pressure_pa)
    return -2.7 + 1.04 * temperature_c + 2.0 * (0.001 * svp * humidity) - 0.65 * wind_ms


def feels_like(temperature_c: Column, wind_ms: Column, humidity: Column, pressure_pa: Column) -> Column:
    """Wind chill below 10 deg C, apparent temperature above 20, a linear passage between."""
    cold, warm = wind_chill(temperature_c, wind_ms * 3.6), apparent_temperature(temperature_c, wind_ms, humidity, pressure_pa)
    share = (temperature_c - 10) / 10
    return F.when(temperature_c < 10, cold).when(temperature_c > 20, warm).otherwise(share * warm + (1 - share) * cold)


def wind_speed(u: Column, v: Column) -> Column:
    return F.sqrt(u * u + v * v)


def wind_direction(u: Column, v: Column) -> Column:
    """Degrees the wind comes from, 0 to 360."""
    return F.pmod(270 - F.degrees(F.atan2(v, u)), F.lit(360.0))


def wind_components(direction: Column, speed: Column) -> tuple[Column, Column]:
    """(u, v) of a wind from direction."""
    return -speed * F.sin(F.radians(direction)), -speed * F.cos(F.radians(direction))


def rain_from_reflectivity(dbz: Column, alpha: float = 0.0376, beta: float = 0.6112) -> Column:
    return alpha * F.pow(F.pow(F.lit(10.0), 0.1 * dbz), F.lit(beta))


def rain_from_marshall_palmer(dbz: Column, a: float = 200.0, b: float = 1.6) -> Column:
    """(Z / a) ** (1 / b)."""
    return F.pow(F.pow(F.lit(10.0), 0.1 * dbz) / a, F.lit(1 / b))


def rain_from_polynomial(dbz: Column) -> Column:
    return F.pow(F.lit(10.0), -2.3 + 0.17 * dbz - 5.1e-3 * dbz * dbz + 9.8e-5 * dbz * dbz * dbz - 6e-7 * dbz * dbz * dbz * dbz)


def rain_from_kdp(kdp: Column, band: str = "C") -> Column:
    alpha, beta = RAIN_BY_KDP[band]
    return alpha * F.pow(F.greatest(kdp, F.lit(0.0)), F.lit(beta))


def rain_from_attenuation(attenuation: Column, band: str = "C") -> Column:
    alpha, beta = RAIN_BY_ATTENUATION[band]
    return alpha * F.pow(attenuation, F.lit(beta))


def rain_switched(main: Column, other: Column, thresh: float, above: bool = True) -> Column:
    """main, but other where main lies beyond thresh or is null."""
    beyond = main > thresh if above else main < thresh
    return F.when(main.isNull() | beyond, other).otherwise(main)


def rain_by_class(dbz: Column, attenuation: Column, hydro: Column, thresh: float = 0.04, wet_factor: float = 0.6, band: str = "C") -> Column:
    """Snow reflectivity for classes 1, 2, 4, 6 and 9, rain for 3 and 5, a share of the rain for 7 and 8."""
    snow, rain = rain_from_reflectivity(dbz, 0.1, 0.5), rain_from_reflectivity(dbz)
    by_attenuation = rain_from_attenuation(attenuation, band)
    wet = rain_switched(by_attenuation, rain, thresh, above=False)
    return F.when(hydro.isin(1, 2, 4, 6, 9), snow).when(hydro.isin(3, 5), wet).when(hydro.isin(7, 8), wet_factor * rain)


def radar_band(frequency_hz: Column) -> Column:
    """S, C or X; beyond 2 to 12 GHz the nearest of them."""
    return F.when(frequency_hz < 4e9, "S").when(frequency_hz < 8e9, "C").otherwise("X")


def lapse_adjusted(temperature: Column, lapse: Column, height_change: Column, most: float = 50.0) -> Column:
    """temperature moved by the local lapse rate within most metres and by the standard one beyond."""
    near = F.greatest(F.least(height_change, F.lit(most)), F.lit(-most))
    return temperature + lapse * near + STANDARD_LAPSE_K_PER_M * (height_change - near)


def db_transform(rain: Column, threshold: float = 0.1, zero: float = -15.0) -> Column:
    return F.when(rain < threshold, F.lit(zero)).otherwise(10 * F.log10(rain))


def db_inverse(db: Column, threshold_db: float = -10.0, zero: float = 0.0) -> Column:
    return F.when(db < threshold_db, F.lit(zero)).otherwise(F.pow(F.lit(10.0), db / 10))


def boxcox(rain: Column, power: float, threshold: float, zero: float) -> Column:
    moved = F.log(rain) if power == 0 else (F.pow(rain, F.lit(power)) - 1) / power
    return F.when(rain < threshold, F.lit(zero)).otherwise(moved)


def scaled(value: Column, low: float, high: float) -> Column:
    """value held within low and high, as 0 to 1."""
    return (F.least(F.greatest(value, F.lit(low)), F.lit(high)) - low) / (high - low)


def piecewise(value: Column, knots: list[tuple[float, float]]) -> Column:
    """Linear between knots (x, y), constant beyond them: weights of lead times, radii, level maps."""
    out = F.lit(float(knots[-1][1]))
    for (x0, y0), (x1, y1) in reversed(list(zip(knots, knots[1:], strict=False))):
        out = F.when(value <= x1, y0 + (value - x0) * ((y1 - y0) / (x1 - x0))).otherwise(out)
    return F.when(value <= knots[0][0], F.lit(float(knots[0][1]))).otherwise(out)


def convective_radius(background_dbz: Column, steps: list[tuple[float, float]]) -> Column:
    """Step table: the radius of the highest step that the background reaches; below all, the first."""
    out = F.lit(float(steps[0][1]))
    for level, radius in steps[1:]:
        out = F.when(background_dbz >= level, F.lit(float(radius))).otherwise(out)
    return out


def orographic_rate(temperature_k: Column, humidity: Column, pressure_pa: Column, lift: Column) -> Column:
    """mm/h from air lifted at `lift` m/s: 3600 / Rv * rh * svp * w / T, never below zero."""
    return F.greatest(3600 / 461.5 * humidity * vapour_pressure_in_air(temperature_k, pressure_pa) * lift / temperature_k, F.lit(0.0))


def enhance(rain: Column, enhancement: Column, add: bool = True, threshold: float = 0.2, floor: float = 0.0) -> Column:
    """rain plus (or minus, not under floor) the enhancement where it reaches threshold."""
    changed = rain + enhancement if add else F.greatest(rain - enhancement, F.lit(floor))
    return F.when(rain >= threshold, changed).otherwise(rain)


def season(month: Column, northern: bool = True) -> Column:
    """1 spring to 4 winter."""
    warm = F.when(month.isin(3, 4, 5), 1).when(month.isin(6, 7, 8), 2).when(month.isin(9, 10, 11), 3).otherwise(4)
    return warm if northern else (warm + 1) % 4 + 1


def friction_velocity(wind: Column, height: Column, roughness: Column, karman: float = 0.4) -> Column:
    return karman * wind / F.log(height / roughness)


def polar_to_lonlat(lon0: Column, lat0: Column, azimuth: Column, metres: Column, radius: float = 6371000.0) -> tuple[Column, Column]:
    """Great-circle end point of a ray."""
    d, a, p = metres / radius, F.radians(azimuth), F.radians(lat0)
    lat = F.asin(F.sin(p) * F.cos(d) + F.cos(p) * F.sin(d) * F.cos(a))
    lon = F.atan2(F.sin(a) * F.sin(d) * F.cos(p), F.cos(d) - F.sin(p) * F.sin(lat))
    return lon0 + F.degrees(lon), F.degrees(lat)
