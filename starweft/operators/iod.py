"""Orbits from three lines of sight (Gauss' method, as in textbooks on orbital mechanics)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.constants import LIGHT_AU_PER_DAY, MU_BARY


def gauss_states(rho: np.ndarray, obs: np.ndarray, t: np.ndarray, min_distance: float, mu: float = MU_BARY) -> list[tuple[float, ...]]:
    """(x, y, z, vx, vy, vz, light-corrected epoch) of the middle time, one for each real root beyond min_distance. rho, obs:
    3 x 3, one line of sight per row. None for lines in one plane or equal times."""
    cross = np.stack([np.cross(rho[1], rho[2]), np.cross(rho[0], rho[2]), np.cross(rho[0], rho[1])])
    volume = rho[0] @ cross[0]
    before, after, span = t[0] - t[1], t[2] - t[1], t[2] - t[0]
    if volume == 0 or 0 in (before, after, span) or not np.isfinite(rho).all() or not np.isfinite(obs).all():
        return []
    d = obs @ cross.T  # d[i, j] = R_i . p_j
    a = (-d[0, 1] * after / span + d[1, 1] + d[2, 1] * before / span) / volume
    b = (d[0, 1] * (after**2 - span**2) * after / span + d[2, 1] * (span**2 - before**2) * before / span) / (6 * volume)
    e, r2 = obs[1] @ rho[1], obs[1] @ obs[1]
    poly = np.zeros(9)
    poly[[0, 2, 5, 8]] = 1.0, -(a * a + 2 * a * e + r2), -2 * mu * b * (a + e), -((mu * b) ** 2)
    out = []
    for root in np.roots(poly):
        if abs(root.imag) > 1e-9 * max(1.0, abs(root)) or root.real <= min_distance:
            continue
        x = root.real
        k = mu / x**3
        first = (6 * (d[2, 0] * before / after + d[1, 0] * span / after) + k * d[2, 0] * (span**2 - before**2) * before / after) / (6 + k * (span**2 - after**2)) - d[0, 0]
        last = (6 * (d[0, 2] * after / before - d[1, 2] * span / before) + k * d[0, 2] * (span**2 - after**2) * after / before) / (6 + k * (span**2 - before**2)) - d[2, 2]
        place = obs + np.array([first / volume, a + k * b, last / volume])[:, None] * rho
        f1, f3 = 1 - k * before**2 / 2, 1 - k * after**2 / 2
        g1, g3 = before - k * before**3 / 6, after - k * after**3 / 6
        v = (f1 * place[2] - f3 * place[0]) / (f1 * g3 - f3 * g1)
        out.append((*place[1], *v, t[1] - np.linalg.norm(place[1]) / LIGHT_AU_PER_DAY))
    return sorted(out, key=lambda s: s[0] ** 2 + s[1] ** 2 + s[2] ** 2)


def triplets(members: DataFrame, keys: list[str]) -> DataFrame:
    """First, middle (place n / 2) and last member of each group by descending epoch, ties by id; groups of 3 or more. Only
    ranks are compared, no group is collected."""
    from pyspark.sql import Window

    order = Window.partitionBy(*keys).orderBy(F.desc("epoch"), "intid")
    ranked = members.select("*", F.row_number().over(order).alias("__r"), F.count("*").over(Window.partitionBy(*keys)).alias("__n"))
    place = F.when(F.col("__r") == 1, 0).when(F.col("__r") == F.floor(F.col("__n") / 2) + 1, 1).when(F.col("__r") == F.col("__n"), 2)
    return ranked.filter("__n >= 3").withColumn("place", place).filter("place is not null").drop("__r", "__n")


def gauss(members: DataFrame, keys: list[str], min_distance: float, mu: float = MU_BARY) -> DataFrame:
    """(keys, root_no, x, y, z, vx, vy, vz, epoch): one row per root of each group's triplet."""
    cols = ["rho_x", "rho_y", "rho_z", "obs_x", "obs_y", "obs_z", "epoch"]
    wide = triplets(members, keys).groupBy(*keys).agg(*[F.max(F.when(F.col("place") == p, F.col(c))).alias(f"{c}_{p}") for p in range(3) for c in cols])
    head = ", ".join(f.simpleString().replace(":", " ") for f in wide.select(*keys).schema.fields)
    names = [*keys, "root_no", "x", "y", "z", "vx", "vy", "vz", "epoch"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.to_dict("records"):
                m = np.array([[r[f"{c}_{p}"] for c in cols] for p in range(3)], float)
                rows += [[*[r[k] for k in keys], i + 1, *s] for i, s in enumerate(gauss_states(m[:, :3], m[:, 3:6], m[:, 6], min_distance, mu))]
            yield pd.DataFrame(rows, columns=names).astype({"root_no": "int32"})

    return wide.mapInPandas(run, head + ", root_no int, x double, y double, z double, vx double, vy double, vz double, epoch double")
