"""Trial orbits improved so that a cluster's detections move closest together."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..functions import kepler
from ..functions.constants import ARCSEC, BOUNDS_DAYS, LIGHT_AU_PER_DAY, MU_BARY
from ..staging import Stage
from .fits import nelder_meads
from .sync import MOST_STEPS, TOLERANCE


_MATRIX = kepler.chebyshev_matrix(kepler.NODES / BOUNDS_DAYS).T
ROWS = 16_384  # members that a task searches for at a time


def np_sync(rho: np.ndarray, obs: np.ndarray, t: np.ndarray, r, vr, vo, inc, kappa, epoch: float, mu: float) -> np.ndarray:
    """Synced points (rows with NaN where there is none) of one orbit: what sync.sync does, for the search's many orbits of few
    detections each. With orbits in arrays, rho, obs and t have an axis for them before that of the detections."""
    r, vr, vo, inc, kappa = (np.asarray(x, float)[..., None] for x in (r, vr, vo, inc, kappa))
    c = np.stack(kepler.motion(r, vr, vo, mu, kepler.NODES)) @ _MATRIX

    def series(k, dt):  # Clenshaw
        x, (c0, c1, c2, c3) = dt / BOUNDS_DAYS, (c[k][..., j, None] for j in range(4))
        a, b = c1 - c3, c2 + c3 * (2 * x)
        return c0 - b + (a + b * (2 * x)) * x

    dot, obs2 = (rho * obs).sum(axis=-1), (obs * obs).sum(axis=-1)
    d = np.full(t.shape, np.nan)
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        at, far, when, along, miss2 = np.arange(t.size), (r - 1.0 + np.zeros(t.shape)).ravel(), (t - epoch).ravel(), dot.ravel(), (dot**2 - obs2).ravel()
        cs = [np.broadcast_to(c[0][..., j, None], t.shape).ravel() for j in range(4)]
        for _ in range(MOST_STEPS):
            old, x, (c0, c1, c2, c3) = far, (when - far / LIGHT_AU_PER_DAY) / BOUNDS_DAYS, cs
            a, b = c1 - c3, c2 + c3 * (2 * x)
            far = np.sqrt((c0 - b + (a + b * (2 * x)) * x) ** 2 + miss2) - along
            done = np.abs(far - old) < TOLERANCE
            d.flat[at[done]] = far[done]
            on = ~done & ~np.isnan(far)  # a NaN stays one
            if not on.any():
                break
            if not on.all():
                at, far, when, along, miss2, *cs = (v[on] for v in (at, far, when, along, miss2, *cs))
        px, py, pz = (obs[..., k] + d * rho[..., k] for k in range(3))
        xy2 = px * px + py * py
        rt, xy = np.sqrt(xy2 + pz * pz), np.sqrt(xy2)
        tl = t - d / LIGHT_AU_PER_DAY
        f, g = series(2, epoch - tl), series(3, epoch - tl)
        h, energy = r * vo, (vr**2 + vo**2) / 2 - mu / r
        tan = h / rt
        rad = np.sqrt(np.maximum(2 * np.maximum(energy + mu / rt, 0) - tan**2, 0))
        cos_psi = np.cos(inc) * rt / xy
        sin_psi = kappa * np.sqrt(1 - cos_psi**2)
        along, across, up = f + g * rad / rt, g * tan * cos_psi / xy, g * tan * sin_psi / (rt * xy)
        reach = np.abs(pz / rt) <= np.sin(np.minimum(inc, np.pi - inc))
        out = np.stack([along * px - across * py - up * pz * px, along * py + across * px - up * pz * py, along * pz + up * xy2], axis=-1)
        return np.where(reach[..., None], out / r[..., None], np.nan)


def spread_cost(points: np.ndarray, min_points: int = 10, sigma: float = 0.3 * ARCSEC) -> np.ndarray:
    """Cost of each cluster of points (clusters x points x 3, NaN where there is none)."""
    there = np.isfinite(points).all(axis=-1)
    n = there.sum(axis=-1)
    few = n < min_points
    at = np.arange(len(n))
    s = np.sort(np.where(there[..., None], points, np.inf), axis=1)
    c = (s[at, np.maximum(n - 1, 0) // 2] + s[at, np.minimum(n // 2, points.shape[1] - 1)]) / 2
    with np.errstate(invalid="ignore", divide="ignore"):
        c /= np.sqrt((c * c).sum(axis=-1, keepdims=True))
        a = np.arccos(np.clip(1 - ((points - c[:, None]) ** 2).sum(axis=-1) / 2, -1, 1))
        a[~there] = 0.0
        for k in range(11):
            n = np.maximum(there.sum(axis=-1), 1)
            off = np.where(there, a - (a.sum(axis=-1, where=there) / n)[:, None], 0.0)
            rest = there & (off <= (5 * np.sqrt((off * off).sum(axis=-1) / n))[:, None])
            if k == 10 or (rest == there).all():
                break
            there = rest
        cost = (0.5 * off**2 / sigma**2 + there * (0.5 * np.log(2 * np.pi * sigma**2))).sum(axis=-1)
    return np.where(few, np.inf, cost)


def optimise(members: DataFrame, keys: list[str], epoch: float, mu: float = MU_BARY, step: tuple = (0.1, 1e-6, 1e-6, 1e-3), most: int = 10_000) -> DataFrame:
    """(keys, r, vr, vo, inc, kappa, cost_before, cost, converged): members carry rho, obs, epoch and their orbit's r, vr, vo,
    inc, kappa. converged is false where `most` iterations ended the search, null where the start has no cost and none was made.
    The clusters of a task are searched side by side, each with a simplex of its own, until the last one has ended."""
    head = ", ".join(f.simpleString().replace(":", " ") for f in members.select(*keys).schema.fields)
    names = [*keys, "r", "vr", "vo", "inc", "kappa", "cost_before", "cost", "converged"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [b for b in batches if len(b)]
        if not rows:
            return
        b = pd.concat(rows, ignore_index=True)
        group = b.groupby(keys, sort=False, dropna=False)
        code, place = group.ngroup().to_numpy(), group.cumcount().to_numpy()
        first = b[place == 0]  # in the order of the codes
        shape = (len(first), place.max() + 1)
        rho, obs, t = np.full((*shape, 3), np.nan), np.full((*shape, 3), np.nan), np.full(shape, np.nan)
        rho[code, place], obs[code, place] = b[["rho_x", "rho_y", "rho_z"]].to_numpy(float), b[["obs_x", "obs_y", "obs_z"]].to_numpy(float)
        t[code, place] = b["epoch"].to_numpy(float)
        p0, kappa = first[["r", "vr", "vo", "inc"]].to_numpy(float), first["kappa"].to_numpy(float)

        def cost(p: np.ndarray, at: np.ndarray) -> np.ndarray:
            ok = p[:, 0] > 0
            out = np.full(len(p), np.inf)
            if ok.any():
                q, k = p[ok], at[ok]
                out[ok] = spread_cost(np_sync(rho[k], obs[k], t[k], *q.T, kappa[k], epoch, mu))
            return out

        before = cost(p0, np.arange(len(p0)))
        best, after, converged = p0.copy(), before.copy(), np.full(len(p0), None, object)
        go = np.flatnonzero(np.isfinite(before))
        if len(go):
            best[go], after[go], converged[go] = nelder_meads(lambda p, at: cost(p, go[at]), p0[go], step, most=most)
        yield first[keys].reset_index(drop=True).assign(**dict(zip(("r", "vr", "vo", "inc"), best.T)), kappa=kappa, cost_before=before, cost=after, converged=converged)[names]

    cols = [*keys, "rho_x", "rho_y", "rho_z", "obs_x", "obs_y", "obs_z", "epoch", "r", "vr", "vo", "inc", "kappa"]
    rows, n = Stage(members.sparkSession, "refine").write_counted(members.select(*cols))
    tasks = max(-(-n // ROWS), 2 * members.sparkSession.sparkContext.defaultParallelism)
    return rows.repartition(tasks, *keys).mapInPandas(run, head + ", r double, vr double, vo double, inc double, kappa double, cost_before double, cost double, converged boolean")
