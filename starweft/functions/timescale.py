"""UTC and TDB Julian Dates."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# First UTC Julian Date of each TAI - UTC, in seconds, since 1972. Before 1972 the first one is used.
LEAP_SECONDS = [
    (2441317.5, 10), (2441499.5, 11), (2441683.5, 12), (2442048.5, 13), (2442413.5, 14), (2442778.5, 15), (2443144.5, 16),
    (2443509.5, 17), (2443874.5, 18), (2444239.5, 19), (2444786.5, 20), (2445151.5, 21), (2445516.5, 22), (2446247.5, 23),
    (2447161.5, 24), (2447892.5, 25), (2448257.5, 26), (2448804.5, 27), (2449169.5, 28), (2449534.5, 29), (2450083.5, 30),
    (2450630.5, 31), (2451179.5, 32), (2453736.5, 33), (2454832.5, 34), (2456109.5, 35), (2457204.5, 36), (2457754.5, 37),
]
TT_MINUS_TAI = 32.184


def tai_minus_utc(jd_utc: Column) -> Column:
    starts = F.array(*[F.lit(start) for start, _ in LEAP_SECONDS[1:]])  # a literal array, folded once
    passed = F.size(F.filter(starts, lambda start: jd_utc >= start))
    # TAI - UTC has gone up by one second at each of them
    return F.lit(float(LEAP_SECONDS[0][1])) + passed


def utc_to_tdb(jd_utc: Column, periodic: bool = True) -> Column:
    """TDB Julian Date; with the two largest periodic terms of TDB - TT (under 2 ms) unless `periodic` is off."""
    tt = jd_utc + (tai_minus_utc(jd_utc) + TT_MINUS_TAI) / 86400.0
    if not periodic:
        return tt
    g = (357.53 + 0.9856003 * (tt - 2451545.0)) * (math.pi / 180.0)
    return tt + (0.001658 * F.sin(g) + 0.000014 * F.sin(2.0 * g)) / 86400.0
