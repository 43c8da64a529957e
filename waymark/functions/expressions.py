"""Column expressions: time, geography, energy."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from waymark.functions import units


def seconds(ts: str) -> Column:
    """Seconds since 1970 of a zone-free timestamp; no session zone takes part."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {ts}) / 1e6D")


def local_time(ts: Column, zone: Column) -> Column:
    """The local wall time of a zone-free UTC time."""
    return F.convert_timezone(F.lit("UTC"), zone, ts)


def direction(local: Column, cutoff: int = 12) -> Column:
    return F.when(F.hour(local) < cutoff, F.lit("Morning")).otherwise(F.lit("Afternoon"))


def parse_activity_date(text: Column) -> Column:
    """A date such as ``Jan 5, 2026, 8:00:00 AM`` as a zone-free UTC time; null if it is none."""
    return F.try_to_timestamp(text, F.lit("MMM d, yyyy, h:mm:ss a")).cast("timestamp_ntz")


def week_ending(day: Column, weekday: str = "SUN") -> Column:
    """The first such weekday on or after the day."""
    return F.next_day(F.date_sub(day, 1), weekday)


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = units.EARTH_MEAN_M) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    s = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return 2 * radius * F.asin(F.least(F.lit(1.0), F.sqrt(s)))


def utm_zone(lon: Column) -> Column:
    return (F.floor((lon + 180) / 6) % 60 + 1).cast("int")


def utm(lat: Column, lon: Column, zone: Column) -> tuple[Column, Column]:
    """(easting, northing) in metres in the given zone, by Krueger's series to the third order (WGS 84)."""
    f = 1 / 298.257223563
    n = f / (2 - f)
    scale = 0.9996 * units.EARTH_EQUATOR_M / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alphas = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    ecc = 2 * math.sqrt(n) / (1 + n)
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    t = F.sinh(F.atanh(F.sin(phi)) - ecc * F.atanh(ecc * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(alphas, 1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return 500000 + scale * east, F.when(lat < 0, F.lit(1e7)).otherwise(F.lit(0.0)) + scale * north


def _eer(base: float, per_year: float, per_kg: float, per_cm: float, weight_lb: Column, height_in: Column, born: Column, day: Column) -> Column:
    years = F.datediff(day, born) / 365.25
    return base - per_year * years + per_kg * (weight_lb * units.KG_PER_LB) + per_cm * (height_in * units.CM_PER_INCH)


def eer_male(weight_lb: Column, height_in: Column, born: Column, day: Column) -> Column:
    """Estimated energy requirement (kcal a day) of an inactive man."""
    return _eer(753.07, 10.83, 14.10, 6.50, weight_lb, height_in, born, day)


def eer_female(weight_lb: Column, height_in: Column, born: Column, day: Column) -> Column:
    """Estimated energy requirement (kcal a day) of an inactive woman."""
    return _eer(584.90, 7.01, 11.71, 5.72, weight_lb, height_in, born, day)
