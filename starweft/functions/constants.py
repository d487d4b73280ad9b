"""Units, constants and default thresholds."""

from __future__ import annotations

import math

# Fixed values.
COS_OBLIQUITY = 0.9174820620691818
SIN_OBLIQUITY = 0.3977771559319137
LIGHT_AU_PER_DAY = 173.14463267424034
MU_SUN = 2.9591220828559093e-4
MU_BARY = 2.9630927492e-4
ARCSEC = math.pi / (180.0 * 3600.0)

# Defaults of the linker; every operator takes them as parameters.
MIN_UNIQUE_TIMES = 12
MIN_NIGHTS = 6
MAX_DT = 4000.0
CLUSTER_ARCSEC = 7.0
HPIX_DEPTH = 15
MIN_CELL = 3
BOUNDS_DAYS = 365.25
DEFAULT_UCTY_ARCSEC = 0.2


def mu_of(origin: str) -> float:
    """mu of 'ssb' or 'sun', in au^3 / day^2."""
    known = {"ssb": MU_BARY, "sun": MU_SUN}
    if origin.lower() not in known:
        raise ValueError(f"unknown origin {origin!r}: use ssb or sun")
    return known[origin.lower()]
