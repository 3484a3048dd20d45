"""Geostationary full-disk images: places on the disk, counts to physical values, file names."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Disk:
    """A nominal disk: axes of the earth and height of the satellite (metres), centre longitude, step (radians), size."""

    major: float
    minor: float
    height: float
    lon0: float
    step: float
    size: int


def line_column(lat: Column, lon: Column, disk: Disk) -> tuple[Column, Column, Column]:
    """(line, column, visible) of geodetic degrees; lines and columns are fractional and count from the north-west."""
    e = 1 - (disk.minor / disk.major) ** 2
    turn = F.radians(lon - disk.lon0)
    centric = F.atan((1 - e) * F.tan(F.radians(lat)))
    r = disk.minor / F.sqrt(1 - e * F.pow(F.cos(centric), 2))
    away = disk.height - r * F.cos(centric) * F.cos(turn)
    east, north = r * F.cos(centric) * F.sin(turn), r * F.sin(centric)
    middle = (disk.size - 1) / 2
    column = middle + F.atan2(east, away) / disk.step
    line = middle - F.asin(north / F.sqrt(away * away + east * east + north * north)) / disk.step
    facing = disk.height * (disk.height - away) >= disk.major**2
    return line, column, facing & line.between(0, disk.size - 1) & column.between(0, disk.size - 1)


def lat_lon(line: Column, column: Column, disk: Disk) -> tuple[Column, Column]:
    """Geodetic degrees of a line and column; null where the line of sight misses the earth."""
    x, y = (column - (disk.size - 1) / 2) * disk.step, (line - (disk.size - 1) / 2) * disk.step
    flat = (disk.major / disk.minor) ** 2
    ahead = disk.height * F.cos(x) * F.cos(y)
    bend = F.pow(F.cos(y), 2) + flat * F.pow(F.sin(y), 2)
    root = ahead * ahead - bend * (disk.height**2 - disk.major**2)
    far = F.when(root >= 0, (ahead - F.sqrt(F.greatest(root, F.lit(0.0)))) / bend)
    along = disk.height - far * F.cos(x) * F.cos(y)
    across, up = far * F.sin(x) * F.cos(y), -far * F.sin(y)
    return F.degrees(F.atan(flat * up / F.sqrt(along * along + across * across))), disk.lon0 + F.degrees(F.atan2(across, along))


def calibrated(count: Column, table: Column, most: int = 4095) -> Column:
    """The physical value of a raw count from its channel's table (an array); null beyond the table or `most`."""
    return F.when((count >= 0) & (count <= most), F.get(table, count.cast("int")))


def channel_numbers(spec: Column) -> Column:
    """The sorted distinct numbers of texts such as "1-3,7"; null where a part is no number or falling range."""
    part = F.split(F.regexp_replace(spec, r"\s", ""), ",")
    low = lambda p: F.split_part(p, F.lit("-"), F.lit(1)).cast("int")
    high = lambda p: F.when(p.contains("-"), F.split_part(p, F.lit("-"), F.lit(2)).cast("int")).otherwise(low(p))
    sound = F.forall(part, lambda p: p.rlike(r"^\d+(-\d+)?$") & (low(p) <= high(p)))
    return F.when(sound, F.array_sort(F.array_distinct(F.flatten(F.transform(part, lambda p: F.sequence(low(p), high(p)))))))


#: A nominal disk of 4 km pixels over 133 degrees east.
NOMINAL = Disk(major=6378137.0, minor=6356752.3, height=42164000.0, lon0=133.0, step=112e-6, size=2748)
