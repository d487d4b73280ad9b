"""Least-squares fits of clusters on the tangent plane.

The model is x = a + b t + c f, y = d + e t + c g with weights 1 / sigma^2. One fit per group is plain weighted sums: a, b
and d, e each touch one coordinate only, so they are taken out by regression on (1, t), and c follows from what is left. The
fits that drop outliers step by step work on one group at a time in Python; a group is a cluster within a small radius.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import ARCSEC, DEFAULT_UCTY_ARCSEC, MIN_NIGHTS, MIN_UNIQUE_TIMES

PARAMS = ["a", "b", "c", "d", "e"]


def fit_rows(members: DataFrame, ucty_arcsec: str = "ast_ucty") -> DataFrame:
    """What a fit takes of cluster members: t, f, g, x, y and sigma in radians, 0.2 arcsec where it is null."""
    sigma = F.coalesce(F.col(ucty_arcsec), F.lit(DEFAULT_UCTY_ARCSEC)) * ARCSEC
    return members.select("*", F.col("dt").alias("t"), (-F.col("xe")).alias("f"), (-F.col("ye")).alias("g"), F.col("theta_x").alias("x"), F.col("theta_y").alias("y"), sigma.alias("sigma"))


def coupled_fit(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, a, b, c, d, e, chi2, dof, r2, covariance) of each group; groups that are too small or singular have no row.
    covariance: the 25 numbers of (X'WX)^-1 chi2 / dof, row by row."""
    w = 1.0 / (F.col("sigma") * F.col("sigma"))
    # offsets make the sums well conditioned
    low = rows.groupBy(*keys).agg(F.count("*").alias("n"), *[F.avg(v).alias(f"m_{v}") for v in "tfgxy"])
    centred = rows.select(*keys, "t", "f", "g", "x", "y", w.alias("w")).join(low, keys)
    at = {v: F.col(v) - F.col(f"m_{v}") for v in "tfgxy"}

    def s(*of: str) -> Column:
        term = F.col("w")
        for v in of:
            term = term * at[v]
        return F.sum(term)

    names = ["", "t", "tt", "f", "ft", "ff", "x", "xt", "xf", "g", "gt", "gg", "y", "yt", "yg"]
    sums = centred.groupBy(*keys, "n", *[f"m_{v}" for v in "tfgxy"]).agg(*[s(*v).alias(f"s_{v}") for v in names])
    c_ = {v: F.col(f"s_{v}") for v in names}
    det = c_[""] * c_["tt"] - c_["t"] * c_["t"]
    sums = sums.filter((F.col("n") >= 3) & (det > 0)).withColumn("det", det)

    def line(v: str) -> tuple[Column, Column]:
        """Intercept and slope of the weighted line of v on t."""
        return (c_["tt"] * c_[v] - c_["t"] * c_[f"{v}t"]) / F.col("det"), (c_[""] * c_[f"{v}t"] - c_["t"] * c_[v]) / F.col("det")

    lines = {v: line(v) for v in "fgxy"}
    ff = c_["ff"] - lines["f"][0] * c_["f"] - lines["f"][1] * c_["ft"]
    gg = c_["gg"] - lines["g"][0] * c_["g"] - lines["g"][1] * c_["gt"]
    xf = c_["xf"] - lines["f"][0] * c_["x"] - lines["f"][1] * c_["xt"]
    yg = c_["yg"] - lines["g"][0] * c_["y"] - lines["g"][1] * c_["yt"]
    fits = sums.withColumn("den", ff + gg).filter(F.col("den") > 1e-12 * (c_["ff"] + c_["gg"]))
    fits = fits.withColumn("c", (xf + yg) / F.col("den"))
    b = lines["x"][1] - F.col("c") * lines["f"][1]
    e = lines["y"][1] - F.col("c") * lines["g"][1]
    a0 = lines["x"][0] - F.col("c") * lines["f"][0]
    d0 = lines["y"][0] - F.col("c") * lines["g"][0]
    fits = fits.withColumns({"b": b, "e": e, "a0": a0, "d0": d0})
    fits = fits.withColumns(
        {
            "a": F.col("a0") + F.col("m_x") - F.col("b") * F.col("m_t") - F.col("c") * F.col("m_f"),
            "d": F.col("d0") + F.col("m_y") - F.col("e") * F.col("m_t") - F.col("c") * F.col("m_g"),
        }
    )
    covariance = _covariance(c_, F.col("det"), lines, F.col("den"))
    fits = fits.select(*keys, "n", *PARAMS, F.array(*covariance).alias("cov"))
    left = rows.select(*keys, "t", "f", "g", "x", "y", w.alias("w")).join(fits, keys)
    rx = F.col("x") - F.col("a") - F.col("b") * F.col("t") - F.col("c") * F.col("f")
    ry = F.col("y") - F.col("d") - F.col("e") * F.col("t") - F.col("c") * F.col("g")
    stats = left.groupBy(*keys, "n", *PARAMS, "cov").agg(
        F.sum(F.col("w") * (rx * rx + ry * ry)).alias("chi2"),
        F.sum(2.0 * F.col("w")).alias("sw"), F.sum(F.col("w") * (F.col("x") + F.col("y"))).alias("sy"),
        F.sum(F.col("w") * (F.col("x") * F.col("x") + F.col("y") * F.col("y"))).alias("syy"),
    )
    total = F.col("syy") - F.col("sy") * F.col("sy") / F.col("sw")
    return stats.select(*keys, "n", *PARAMS, "chi2", (2 * F.col("n") - 5).alias("dof"), (1.0 - F.col("chi2") / F.nullif(total, F.lit(0.0))).alias("r2"), F.transform("cov", lambda v: v * F.col("chi2") / (2 * F.col("n") - 5)).alias("covariance"))


def _covariance(sums: dict[str, Column], det: Column, lines: dict[str, tuple[Column, Column]], den: Column) -> list[Column]:
    """(X'WX)^-1 of a, b, c, d, e, row by row. With c taken out, (a, b) and (d, e) each have the inverse of the sums over 1
    and t; c, whose variance is 1 / den, adds its slopes on them. Last, from centred to given times and observers."""
    line = [[sums["tt"] / det, -sums["t"] / det], [-sums["t"] / det, sums[""] / det]]
    slope = [-lines["f"][0], -lines["f"][1], F.lit(1.0), -lines["g"][0], -lines["g"][1]]
    block = {0: (0, 0), 1: (0, 1), 3: (1, 0), 4: (1, 1)}

    def centred(i: int, j: int) -> Column:
        joint = slope[i] * slope[j] / den
        if i in block and j in block and block[i][0] == block[j][0]:
            return joint + line[block[i][1]][block[j][1]]
        return joint

    one, zero = F.lit(1.0), None
    back = [[one, -F.col("m_t"), -F.col("m_f"), zero, zero], [zero, one, zero, zero, zero], [zero, zero, one, zero, zero], [zero, zero, -F.col("m_g"), one, -F.col("m_t")], [zero, zero, zero, zero, one]]
    return [
        sum((back[i][k] * back[j][m] * centred(k, m) for k in range(5) if back[i][k] is not None for m in range(5) if back[j][m] is not None), F.lit(0.0))
        for i in range(5) for j in range(5)
    ]


def _design(t, f, g):
    n = len(t)
    m = np.zeros((2 * n, 5))
    m[:n, 0], m[:n, 1], m[:n, 2] = 1, t, f
    m[n:, 3], m[n:, 4], m[n:, 2] = 1, t, g
    return m


def np_fit(t, f, g, x, y, sx, sy) -> dict | None:
    """The same fit in numpy with its covariance; None if it is too small or singular."""
    n = len(t)
    if 2 * n - 5 <= 0 or n < 3:
        return None
    m, v, s = _design(t - t.mean(), f, g), np.concatenate([x, y]), np.concatenate([sx, sy])
    mw, vw = m / s[:, None], v / s
    scale = np.linalg.norm(mw, axis=0)
    if (scale == 0).any() or np.linalg.matrix_rank(mw / scale) < 5:
        return None
    inv = np.linalg.inv((mw / scale).T @ (mw / scale)) / np.outer(scale, scale)
    p = np.linalg.lstsq(mw / scale, vw, rcond=None)[0] / scale
    back = np.eye(5)
    back[0, 1] = back[3, 4] = -t.mean()
    p, inv = back @ p, back @ inv @ back.T
    res = v - _design(t, f, g) @ p
    chi2, dof = float(((res / s) ** 2).sum()), 2 * n - 5
    mean = (v / s**2).sum() / (1 / s**2).sum()
    total = ((v - mean) ** 2 / s**2).sum()
    return {"params": p, "cov": inv * chi2 / dof, "sigma": (chi2 / dof) ** 0.5, "r2": 1 - chi2 / total if total else np.nan, "chi2": chi2, "dof": dof, "pull": np.maximum(np.abs(res[:n] / s[:n]), np.abs(res[n:] / s[n:]))}


def reject_outliers(t, f, g, x, y, sx, sy, threshold=5.0, min_kept=MIN_UNIQUE_TIMES, min_nights=MIN_NIGHTS, fraction: float | None = None):
    """(fit, kept indices, rejected indices), or None. Drops the worst pull (the first of equal ones), or with `fraction` that
    part of the kept, until all are below the threshold; fails where nights or kept points become too few, where a fit fails,
    or where a pull is not finite."""
    keep, out = np.arange(len(t)), []
    while True:
        nights = len(np.unique(np.floor(np.abs(t[keep]) + 0.5) * np.sign(t[keep])))
        if fraction is None and nights < min_nights:
            return None
        fit = np_fit(*(v[keep] for v in (t, f, g, x, y, sx, sy)))
        if fit is None or not np.isfinite(fit["pull"]).all():
            return None
        if fit["pull"].max() < threshold:
            return fit, keep, out
        k = 1 if fraction is None else max(1, min(int(np.ceil(fraction * len(keep))), len(keep) - min_kept))
        worst = np.argsort(-fit["pull"], kind="stable")[:k]
        out += keep[worst].tolist()
        keep = np.delete(keep, worst)
        if len(keep) < min_kept:
            return None


FIT_FIELDS = "n bigint, n_rejected bigint, a double, b double, c double, d double, e double, sigma double, r2 double, chi2 double, dof bigint, covariance array<double>, kept array<bigint>, rejected array<bigint>"


def rejecting_fits(rows: DataFrame, keys: list[str], threshold: float = 5.0, min_kept: int = MIN_UNIQUE_TIMES, min_nights: int = MIN_NIGHTS, fraction: float | None = None) -> DataFrame:
    """One row per group whose fit succeeds, with its covariance (25 numbers), kept and rejected ids."""
    parts = [f.simpleString().replace(":", " ") for f in rows.select(*keys).schema.fields]

    def run(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("intid", kind="stable").reset_index(drop=True)
        v = [b[c].to_numpy(float) for c in ("t", "f", "g", "x", "y", "sigma", "sigma")]
        got = reject_outliers(*v, threshold, min_kept, min_nights, fraction)
        names = [*keys, "n", "n_rejected", *PARAMS, "sigma", "r2", "chi2", "dof", "covariance", "kept", "rejected"]
        if got is None:
            return pd.DataFrame(columns=names)
        fit, keep, out = got
        ids = b["intid"].to_numpy(np.int64)
        row = [*[b[k].iloc[0] for k in keys], len(keep), len(out), *fit["params"], fit["sigma"], fit["r2"], fit["chi2"], fit["dof"], fit["cov"].ravel().tolist(), ids[keep].tolist(), ids[out].tolist()]
        return pd.DataFrame([row], columns=names)

    return rows.select(*keys, "intid", "t", "f", "g", "x", "y", "sigma").groupBy(*keys).applyInPandas(run, ", ".join(parts) + ", " + FIT_FIELDS)


def line_fit(rows: DataFrame, keys: list[str], t: str, values: list[str], weight: str | None = None) -> DataFrame:
    """Weighted straight lines of each value on t: (keys, n, <v>_0, <v>_1, var_0, var_01, var_1), the variances being those
    of unit weight."""
    w = F.col(weight) if weight else F.lit(1.0)
    mean = rows.groupBy(*keys).agg((F.sum(w * F.col(t)) / F.sum(w)).alias("__m"))
    df = rows.join(mean, keys).withColumn("__t", F.col(t) - F.col("__m"))
    u = F.col("__t")
    sums = df.groupBy(*keys, "__m").agg(F.count("*").alias("n"), F.sum(w).alias("w0"), F.sum(w * u * u).alias("w2"), *[F.sum(w * F.col(v)).alias(f"v_{v}") for v in values], *[F.sum(w * F.col(v) * u).alias(f"vt_{v}") for v in values])
    sums = sums.filter(F.col("w2") > 0)
    out = []
    for v in values:
        slope = F.col(f"vt_{v}") / F.col("w2")
        out += [(F.col(f"v_{v}") / F.col("w0") - slope * F.col("__m")).alias(f"{v}_0"), slope.alias(f"{v}_1")]
    m = F.col("__m")
    return sums.select(*keys, "n", *out, (1.0 / F.col("w0") + m * m / F.col("w2")).alias("var_0"), (-m / F.col("w2")).alias("var_01"), (1.0 / F.col("w2")).alias("var_1"))


def predict_line(fits: DataFrame, times: DataFrame, keys: list[str], t: str, values: list[str], keep: list[str] | None = None) -> DataFrame:
    """Values of fitted lines at given times, with the variance of unit weight and the columns `keep` of the times."""
    df = times.join(fits, keys)
    u = F.col(t)
    return df.select(*keys, *(keep or []), t, *[(F.col(f"{v}_0") + F.col(f"{v}_1") * u).alias(v) for v in values], (F.col("var_0") + 2.0 * u * F.col("var_01") + u * u * F.col("var_1")).alias("variance"))


def robust_cost(points: DataFrame, keys: list[str], min_points: int = 10, rounds: int = 10, clip: float = 5.0, sigma: float = 0.3 * ARCSEC) -> DataFrame:
    """(keys, n, clipped, cost): minus the log likelihood of the angles to the median centre, after upper clipping; infinite
    for groups of fewer than min_points. The rounds are windows over the same keys: one shuffle, no group in one row."""
    centre = points.groupBy(*keys).agg(F.count("*").alias("n"), *[F.median(f"s_{c}").alias(f"m_{c}") for c in "xyz"])
    norm = F.sqrt(sum((F.col(f"m_{c}") * F.col(f"m_{c}") for c in "xyz"), F.lit(0.0)))
    df = points.join(centre, keys).withColumn("__k", norm)
    d2 = sum(((F.col(f"s_{c}") - F.col(f"m_{c}") / F.col("__k")) * (F.col(f"s_{c}") - F.col(f"m_{c}") / F.col("__k")) for c in "xyz"), F.lit(0.0))
    df = df.select(*keys, "n", F.acos(F.least(F.greatest(1.0 - d2 / 2.0, F.lit(-1.0)), F.lit(1.0))).alias("a"))
    group = Window.partitionBy(*keys)
    for _ in range(rounds):  # what is clipped becomes null
        df = df.select(*keys, "n", "a", F.avg("a").over(group).alias("mean"), F.stddev_pop("a").over(group).alias("sd"))
        df = df.select(*keys, "n", F.when((F.col("a") <= F.col("mean") + clip * F.col("sd")) | (F.col("n") < min_points), F.col("a")).alias("a"))
    out = df.groupBy(*keys, "n").agg(F.count("a").alias("clipped"), F.var_pop("a").alias("v"))
    likelihood = F.col("clipped") * (0.5 * F.col("v") / sigma**2 + 0.5 * math.log(2 * math.pi * sigma**2))
    return out.select(*keys, "n", "clipped", F.when(F.col("n") < min_points, F.lit(float("inf"))).otherwise(likelihood).alias("cost"))


def nelder_mead(cost, p0, step, tol: float = 1e-12, most: int = 10_000) -> tuple[np.ndarray, float, bool]:
    """Minimum by the simplex method, and whether it converged: it ends when the costs' standard deviation is below tol, or
    after `most` iterations without that."""
    n, converged = len(p0), False
    pts = [np.array(p0, float)] + [np.array(p0, float) + np.eye(n)[i] * step[i] for i in range(n)]
    val = [cost(p) for p in pts]
    for _ in range(most):
        o = np.argsort(val, kind="stable")
        pts, val = [pts[i] for i in o], [val[i] for i in o]
        if np.isfinite(val).all() and np.std(val) < tol:
            converged = True
            break
        mid = np.mean(pts[:-1], axis=0)

        def at(k, mid=mid, worst=pts[-1]):
            p = mid + k * (worst - mid)
            return p, cost(p)

        p, v = at(-1.0)
        if v < val[0]:
            q, u = at(-2.0)
            p, v = (q, u) if u < v else (p, v)
        elif v >= val[-2]:
            p, v = at(-0.5) if v < val[-1] else at(0.5)
            if v >= val[-1]:
                pts = [pts[0]] + [pts[0] + 0.5 * (x - pts[0]) for x in pts[1:]]
                val = [val[0]] + [cost(x) for x in pts[1:]]
                continue
        pts[-1], val[-1] = p, v
    i = int(np.argmin(val))
    return pts[i], float(val[i]), converged


def nelder_meads(cost, p0: np.ndarray, step, tol: float = 1e-12, most: int = 10_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """nelder_mead from each row of p0, side by side: the same moves, of all searches that go on at once. cost(p, at): the costs
    of places p for the searches `at`. A simplex that comes back to where it was goes round for ever; its rounds up to `most` are
    not made, only the rest of the last one."""
    m, n = p0.shape
    at = np.arange(m)
    pts = p0[:, None, :] + np.vstack([np.zeros(n), np.diag(step)])
    val = np.stack([cost(pts[:, k], at) for k in range(n + 1)], axis=1)
    best, least, converged = p0.copy(), np.empty(m), np.zeros(m, bool)
    until, mark, since = np.full(m, most), np.full_like(pts, np.nan), 0

    def leave(which: np.ndarray) -> None:
        i = np.argmin(val[which], axis=1)
        best[at[which]], least[at[which]] = pts[which, i], val[which, i]

    for now in range(most):
        o = np.argsort(val, axis=1, kind="stable")
        pts, val = np.take_along_axis(pts, o[..., None], 1), np.take_along_axis(val, o, 1)
        with np.errstate(invalid="ignore"):
            done = np.isfinite(val).all(axis=1) & (val.std(axis=1) < tol)
        same = (until == most) & (pts == mark).all(axis=(1, 2))
        until[same] = now + (most - now) % max(1, now - since)
        if now & (now - 1) == 0:
            mark, since = pts.copy(), now
        converged[at[done]] = True
        done |= until <= now
        if done.any():
            leave(np.flatnonzero(done))
            at, pts, val, until, mark = (x[~done] for x in (at, pts, val, until, mark))
            if not len(at):
                return best, least, converged
        mid = pts[:, :-1].mean(axis=1)
        away = pts[:, -1] - mid
        p = mid - away
        v = cost(p, at)
        far, poor = v < val[:, 0], ~(v < val[:, 0]) & (v >= val[:, -2])
        k = np.where(far, -2.0, np.where(v < val[:, -1], -0.5, 0.5))
        again = np.flatnonzero(far | poor)
        if len(again):
            q = mid[again] + k[again, None] * away[again]
            u = cost(q, at[again])
            take = poor[again] | (u < v[again])
            p[again[take]], v[again[take]] = q[take], u[take]
        shrunk = poor & (v >= val[:, -1])
        w = np.flatnonzero(~shrunk)
        pts[w, -1], val[w, -1] = p[w], v[w]
        w = np.flatnonzero(shrunk)
        if len(w):
            pts[w, 1:] = pts[w, :1] + 0.5 * (pts[w, 1:] - pts[w, :1])
            val[w, 1:] = cost(pts[w, 1:].reshape(-1, n), np.repeat(at[w], n)).reshape(-1, n)
    leave(np.arange(len(at)))
    return best, least, converged
