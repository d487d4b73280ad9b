"""Trial orbits with what the linker needs of them: constants of motion and polynomials of their motion in time.

Orbits are a small table; it is worked out once in numpy batches and broadcast afterwards, behind a check of its size.
Defined results: a null or non-finite number in an orbit gives null polynomials, and such an orbit moves nothing; an empty
table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import kepler
from ..functions.constants import BOUNDS_DAYS, MU_BARY
from ..functions.geometry import chebyshev

POLYS = ["r_poly", "vr_poly", "f_poly", "g_poly"]
_NUMBERS = ["r", "vr", "vo", "inc", "kappa"]
ORBIT = T.StructType(
    [T.StructField("id", T.StringType())]
    + [T.StructField(c, T.DoubleType()) for c in [*_NUMBERS, "orbit_epoch", "mu", "h", "energy", "alpha", "cos_inc", "sin_lat", "bounds"]]
    + [T.StructField(c, T.ArrayType(T.DoubleType())) for c in POLYS]
)


def spherical(table: DataFrame, epoch: float, mu: float = MU_BARY, bounds: float = BOUNDS_DAYS) -> DataFrame:
    """Orbits from (id, r, vr, vo[, inc, kappa]); without inclination those columns are null."""
    have = [c for c in ["id", *_NUMBERS] if c in table.columns]
    cols = [F.col("id").cast("string").alias("id")] + [(F.col(c) if c in have else F.lit(None)).cast("double").alias(c) for c in _NUMBERS]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matrix = kepler.chebyshev_matrix(kepler.NODES / bounds)
        for b in batches:
            r, vr, vo = (b[c].to_numpy(float) for c in ("r", "vr", "vo"))
            ok = np.isfinite(r) & np.isfinite(vr) & np.isfinite(vo) & (r > 0)
            rs, vrs, vos = np.where(ok, r, 1.0), np.where(ok, vr, 0.0), np.where(ok, vo, np.sqrt(mu))
            samples = kepler.motion(rs[:, None], vrs[:, None], vos[:, None], mu, kepler.NODES[None, :])
            out = b.copy()
            out["orbit_epoch"], out["mu"], out["bounds"] = epoch, mu, bounds
            out["h"] = r * vo
            out["energy"] = (vr**2 + vo**2) / 2 - mu / r
            out["alpha"] = -2 * out["energy"] / mu
            inc = b["inc"].to_numpy(float)
            out["cos_inc"], out["sin_lat"] = np.cos(inc), np.sin(np.minimum(inc, np.pi - inc))
            for name, y in zip(POLYS, samples):
                fit = y @ matrix.T
                out[name] = [list(v) if good and np.isfinite(v).all() else None for v, good in zip(fit, ok)]
            yield out[ORBIT.fieldNames()]

    return table.select(*cols).mapInPandas(run, ORBIT)


def keplerian(table: DataFrame, epoch: float, mu: float = MU_BARY, m0_is_true_anomaly: bool = False) -> DataFrame:
    """Orbits from (id, q, e, inc, M0, kappa). M0 is the mean anomaly; the flag takes it for the true one."""
    names = ["q", "e", "inc", "M0", "kappa"]
    cols = [F.col("id").cast("string").alias("id")] + [(F.col(c) if c in table.columns else F.lit(None)).cast("double").alias(c) for c in names]
    schema = T.StructType([T.StructField("id", T.StringType())] + [T.StructField(c, T.DoubleType()) for c in _NUMBERS])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            q, e, m = (b[c].to_numpy(float) for c in ("q", "e", "M0"))
            nu = m if m0_is_true_anomaly else kepler.true_anomaly_from_mean(m, e)
            r, vr, vo = kepler.spherical_of_elements(q, e, nu, mu)
            yield pd.DataFrame({"id": b["id"], "r": r, "vr": vr, "vo": vo, "inc": b["inc"], "kappa": b["kappa"]})

    return spherical(table.select(*cols).mapInPandas(run, schema), epoch, mu)


def first_orbits(table: DataFrame, n: int, order: str = "id") -> DataFrame:
    """The first n orbits in a stated order (a slice is the feature here), all of them if there are fewer."""
    return table.orderBy(order).limit(n)


def at_epoch(poly: str, epoch: Column) -> Column:
    """r, vr, f or g of an orbit at an epoch, from its polynomial; not limited to the fitted interval."""
    return chebyshev(F.col(poly), (epoch - F.col("orbit_epoch")) / F.col("bounds"))


def extrapolated(epoch: Column) -> Column:
    return F.abs(epoch - F.col("orbit_epoch")) > F.col("bounds")
