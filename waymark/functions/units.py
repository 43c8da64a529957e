"""Constants of units, as literals for expressions."""

from __future__ import annotations

import math

KM_PER_MILE = 1.609344
M_PER_FOOT = 0.3048
KG_PER_LB = 0.45359237
CM_PER_INCH = 2.54
#: Energy of a pound of body fat, and what a pound a week is in a day.
KCAL_PER_LB = 3500.0
KCAL_DAY_PER_LB_WEEK = KCAL_PER_LB / 7
SECONDS = {"s": 1.0, "m": 60.0, "h": 3600.0, "D": 86400.0, "W": 604800.0}
#: Equatorial radius for boxes and neighbourhoods, mean radius for great circles.
EARTH_EQUATOR_M = 6378137.0
EARTH_MEAN_M = 6371009.0
EARTH_M_PER_DEG = EARTH_EQUATOR_M * math.pi / 180


def ewm_min_periods(halflife: float, coverage: float, floor: int = 2) -> int:
    """How many evenly spaced points hold ``coverage`` of an exponential window's weight."""
    if not 0 < coverage < 1:
        raise ValueError("coverage must lie between 0 and 1")
    if halflife <= 0:
        raise ValueError("halflife must be positive")
    return max(floor, math.ceil(math.log(1 - coverage) / math.log(0.5 ** (1 / halflife))))


def power_windows(longest: int = 43200, density: int = 50) -> list[int]:
    """Whole seconds spaced evenly on a logarithmic scale, 1 and ``longest`` included."""
    decades = math.log10(longest)
    n = round(density * decades)
    steps = [decades * k / (n - 1) for k in range(n)] if n > 1 else [0.0]
    return sorted({round(10**x) for x in steps})
