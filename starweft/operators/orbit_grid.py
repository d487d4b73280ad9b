"""Grids of trial orbits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kepler
from ..functions.constants import ARCSEC, MU_BARY
from ..staging import Stage

AXES = ["gamma", "gamma_dot", "eta_x", "eta_y"]
CELLS_PER_TASK = 20_000
_BOUNDS = [f"{a}_{e}" for a in AXES for e in ("lo", "hi")]


def from_scaled(gamma: Column, gamma_dot: Column, eta_x: Column, eta_y: Column) -> list[Column]:
    """r, vr, vo, psi of scaled coordinates."""
    r = 1.0 / gamma
    return [r.alias("r"), (gamma_dot * r).alias("vr"), (F.hypot(eta_x, eta_y) * r).alias("vo"), F.atan2(eta_y, eta_x).alias("psi")]


def _ends(orbits: np.ndarray, dt: float, mu: float) -> np.ndarray:
    """Where orbits (rows r, vr, vo, psi) that start in the same direction are after dt, as unit vectors: along that direction,
    and across it in the direction psi and the one beside it. NaN where the motion does not converge."""
    r, vr, vo, psi = orbits.T
    _, _, f, g = kepler.motion(r, vr, vo, mu, dt)
    v = np.stack([f * r + g * vr, g * vo * np.cos(psi), g * vo * np.sin(psi)], axis=1)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip((a * b).sum(axis=1), -1, 1)) / ARCSEC


def separation(one: np.ndarray, two: np.ndarray, dt: float, mu: float) -> np.ndarray:
    """Angle in arcsec after dt between orbits (rows r, vr, vo, psi) that start in the same direction."""
    return _apart(_ends(one, dt, mu), _ends(two, dt, mu))


def _scaled(v: np.ndarray) -> np.ndarray:
    r = 1 / v[:, 0]
    return np.stack([r, v[:, 1] * r, np.hypot(v[:, 2], v[:, 3]) * r, np.arctan2(v[:, 3], v[:, 2])], axis=1)


def axis_separations(cells: np.ndarray, span: float, mu: float, epsilon: float) -> np.ndarray:
    """cells x 4: along each axis, the separation at the end of the span between the two ends of the axis, over the 8 corners of
    the others in order; the first one above epsilon stands, else the largest. Each of a cell's 16 corners is moved once. A
    corner that does not converge counts as farther than any."""
    corners = np.stack([cells[:, [2 * a + (c >> (3 - a) & 1) for a in range(4)]] for c in range(16)], axis=1)
    ends = _ends(_scaled(corners.reshape(-1, 4)), span / 2, mu).reshape(len(cells), 16, 3)
    out = np.zeros((len(cells), 4))
    for axis in range(4):
        bit = 8 >> axis
        settled = np.zeros(len(cells), bool)
        for c in (c for c in range(16) if not c & bit):
            s = np.nan_to_num(_apart(ends[:, c], ends[:, c | bit]), nan=np.inf)
            out[:, axis] = np.where(settled, out[:, axis], np.where(s > epsilon, s, np.maximum(out[:, axis], s)))
            settled |= s > epsilon
    return out


def refine(cells: DataFrame, span: float, epsilon: float, mu: float = MU_BARY, most_levels: int = 40) -> DataFrame:
    """Cells (bounds per axis) bisected along the axis of largest separation until none is epsilon or more. All open cells of
    a level are split at once, level by level, over a staged table. Cells that are still open after most_levels are an error."""
    stage = Stage(cells.sparkSession, "orbit-grid")
    schema = ", ".join(f"{b} double" for b in _BOUNDS) + ", final boolean"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            v = b[_BOUNDS].to_numpy(float)
            s = axis_separations(v, span, mu, epsilon)
            axis, final = s.argmax(axis=1), s.max(axis=1) < epsilon
            low, high = v[~final].copy(), v[~final].copy()
            k, rows = axis[~final], np.arange(int((~final).sum()))
            mid = (v[~final][rows, 2 * k] + v[~final][rows, 2 * k + 1]) / 2
            low[rows, 2 * k + 1], high[rows, 2 * k] = mid, mid
            out = pd.DataFrame(np.concatenate([v[final], low, high]), columns=_BOUNDS)
            out["final"] = np.arange(len(out)) < final.sum()
            yield out

    done = None
    open_cells = cells.select(*_BOUNDS)
    for _ in range(most_levels):
        level, n = stage.write_counted(open_cells.mapInPandas(run, schema))
        final = level.filter("final").select(*_BOUNDS)
        done = final if done is None else done.unionByName(final)
        open_cells = level.filter("not final").select(*_BOUNDS)
        if n > CELLS_PER_TASK:
            open_cells = open_cells.repartition(-(-n // CELLS_PER_TASK))
        if open_cells.isEmpty():
            break
    else:
        raise ValueError(f"{open_cells.count()} cells are still {epsilon} arcsec or more wide after {most_levels} levels")
    return done


def halve_gamma(spark: SparkSession, r_min: float, r_max: float) -> DataFrame:
    """Ranges of gamma = 1 / r, bisected until rmax / rmin <= 2."""
    out, todo = [], [(1.0 / r_max, 1.0 / r_min)]
    while todo:
        lo, hi = todo.pop()
        if hi / lo <= 2.0:
            out.append((lo, hi))
        else:
            mid = (lo + hi) / 2
            todo += [(lo, mid), (mid, hi)]
    return spark.createDataFrame(sorted(out), "gamma_lo double, gamma_hi double")


def bound_cells(cells: DataFrame, mu: float = MU_BARY) -> DataFrame:
    """Cells of which some corner is bound at gamma_dot = 0: (eta^2 / gamma^2) / 2 < mu gamma."""
    corners = F.array(*[F.struct(F.col(f"gamma_{a}").alias("g"), F.col(f"eta_x_{b}").alias("x"), F.col(f"eta_y_{c}").alias("y")) for a in ("lo", "hi") for b in ("lo", "hi") for c in ("lo", "hi")])
    return cells.filter(F.exists(corners, lambda c: (c["x"] * c["x"] + c["y"] * c["y"]) / (c["g"] * c["g"]) / 2.0 - mu * c["g"] < 0))


def midpoints(cells: DataFrame) -> DataFrame:
    return cells.select(*[((F.col(f"{a}_lo") + F.col(f"{a}_hi")) / 2).alias(a) for a in AXES])


def rate_grid(orbits: DataFrame, pixel: float, span: float, mu: float = MU_BARY) -> DataFrame:
    """(id, gamma, adot, bdot): for each distance all rates on a square grid of 3 pixels per span inside of the disc of bound
    motion. A product of two sequences, stated by the grid itself."""
    top = F.sqrt(2.0 * mu * F.pow("gamma", 3))
    step = 3.0 * pixel / span
    n = (2 * F.ceil(top / step)).cast("long")
    df = orbits.select("id", (1.0 / F.col("r")).alias("gamma")).select("*", top.alias("top"), n.alias("steps"))
    df = df.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("steps"))).alias("i")).withColumn("adot", F.col("i") * step - F.col("top"))
    df = df.filter(F.abs("adot") <= F.col("top")).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("steps"))).alias("j")).withColumn("bdot", F.col("j") * step - F.col("top"))
    return df.filter(F.sqrt(F.col("adot") * F.col("adot") + F.col("bdot") * F.col("bdot")) <= F.col("top")).select("id", "gamma", "i", "j", "adot", "bdot")


def parallel_rates(orbits: DataFrame) -> DataFrame:
    """Rate orbits (r, vr, adot, bdot, id) of spherical ones, moving at their inclination."""
    rate = F.col("vo") / F.col("r")
    return orbits.select("r", "vr", (rate * F.cos("inc")).alias("adot"), (F.col("kappa") * rate * F.sin("inc")).alias("bdot"), "id")

