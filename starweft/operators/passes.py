"""Whole passes over all detections for one orbit after another, in numpy: for results that are small next to the product of
detections and orbits, or that need all of an orbit's points at once.

The detections' numbers are staged once, uncompressed, in the folder that all executors share; orbits are dealt to tasks, and a
task reads the stage for its orbits batch by batch. So the product is neither shuffled nor written, and no more than one
orbit's points are in a task's memory. Where these may be too many (`PASS_ROWS`), callers go by shuffle.

Defined results: as in sync; a null or non-finite number of a detection or an orbit gives no point.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow.dataset
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import healpix
from ..functions.constants import ARCSEC, LIGHT_AU_PER_DAY
from ..functions.geometry import chord2_of
from ..staging import new_path
from . import sync

PASS_ROWS = 20_000_000  # of one orbit in a task: about 60 bytes each at the most
BATCH = 16_384  # rows of which the steps' arrays stay in a core's cache
NUMBERS = ["epoch", "rho_x", "rho_y", "rho_z", "obs_x", "obs_y", "obs_z", "rho_dot_obs", "obs2"]
Arrays = dict[str, np.ndarray]


def stage(detections: DataFrame, keep: list[str] | None = None) -> tuple[str, int]:
    """Path of the detections' numbers (and intid and `keep`), and their count."""
    path = new_path(detections.sparkSession, "numbers")
    own = ["intid"] if "intid" in detections.columns else []
    sync.with_dots(detections).select(*own, *NUMBERS, *(keep or [])).write.option("compression", "none").parquet(path)
    return path, detections.sparkSession.read.parquet(path).count()


QUANTITIES = ["n", "id_low", "id_high", "mix_low", "mix_high"]  # of a set of ids: sums of their parts and of a hash's


def stage_distinct(spark: SparkSession, path: str) -> tuple[str, int]:
    """Path and count of the distinct numbers of a stage: of equal rows the lowest intid and the QUANTITIES of their ids."""
    mixed = F.xxhash64("intid")
    parts = [F.lit(1), F.col("intid").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftright("intid", 32), mixed.bitwiseAND(F.lit(0xFFFFFF)), F.shiftrightunsigned(mixed, 40)]
    sums = [F.sum(p).cast("long").alias(c) for c, p in zip(QUANTITIES, parts)]
    out = new_path(spark, "distinct")
    spark.read.parquet(path).groupBy(*NUMBERS).agg(F.min("intid").alias("intid"), *sums).write.option("compression", "none").parquet(out)
    return out, spark.read.parquet(out).count()


def batches(path: str, rows: int = BATCH, columns: tuple[str, ...] = (*NUMBERS, "intid", "row")) -> Iterator[Arrays]:
    """The stage's rows, always in the same order."""
    files, root = pyarrow.fs.FileSystem.from_uri(path)
    found = pyarrow.dataset.dataset(root, filesystem=files, format="parquet")
    own = [c for c in columns if c in found.schema.names]
    for b in found.to_batches(columns=own, batch_size=rows * 16, batch_readahead=1, fragment_readahead=1, use_threads=False):
        whole = {c: b.column(c).to_numpy(zero_copy_only=False) for c in b.schema.names}
        for k in range(0, b.num_rows, rows):
            yield {c: v[k : k + rows] for c, v in whole.items()}


def over_orbits(orbits: DataFrame, schema: str, run: Callable[[list[dict]], Iterator[pd.DataFrame]]) -> DataFrame:
    """run over lists of orbits (dicts with ic_id and the numbers o_... of sync.flat_orbits), one list per task."""
    flat = sync.flat_orbits(orbits)
    tasks = 4 * orbits.sparkSession.sparkContext.defaultParallelism

    def each(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [o for b in parts for o in b.to_dict("records")]
        if rows:
            yield from run(rows)

    return flat.repartition(tasks).mapInPandas(each, schema)


def series(o: dict, name: str, x: np.ndarray) -> np.ndarray:
    return o[f"o_{name}0"] + x * (o[f"o_{name}1"] + x * (o[f"o_{name}2"] + x * o[f"o_{name}3"]))


def _settled(o: dict, b: Arrays, step, most: int) -> np.ndarray:
    """rho of step's (rho, settled) from r - 1 on; NaN where it does not settle within `most` steps. Settled rows leave."""
    out, at, rho, part = np.full(len(b["epoch"]), np.nan), None, np.full(len(b["epoch"]), o["o_r"] - 1.0), b
    for _ in range(most):
        rho, done = step(part, rho)
        if at is None and done.all():
            return rho
        at = np.arange(len(out)) if at is None else at
        out[at[done]] = rho[done]
        on = ~done & ~np.isnan(rho)
        if not on.any():
            break
        if not on.all():
            at, rho, part = at[on], rho[on], {c: part[c][on] for c in ("epoch", "rho_dot_obs", "obs2")}
    return out


def _distance(o: dict, b: Arrays, rho: np.ndarray) -> np.ndarray:
    return series(o, "r", (b["epoch"] - rho / LIGHT_AU_PER_DAY - o["o_orbit_epoch"]) / o["o_bounds"])


def ranges(o: dict, b: Arrays) -> np.ndarray:
    """rho of sync.solve_range."""

    def step(part: Arrays, rho: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rt, dot = _distance(o, part, rho), part["rho_dot_obs"]
        new = np.sqrt(rt * rt + (dot * dot - part["obs2"])) - dot
        return new, np.abs(new - rho) < sync.TOLERANCE

    return _settled(o, b, step, sync.MOST_STEPS)


def newton_ranges(o: dict, b: Arrays) -> np.ndarray:
    """rho of sync.newton_range."""

    def step(part: Arrays, rho: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rt, dot = _distance(o, part, rho), part["rho_dot_obs"]
        cost, slope = part["obs2"] + 2.0 * rho * dot + rho * rho - rt * rt, 2.0 * (rho + dot)
        done = np.abs(cost) < 1e-8
        return np.where(done, rho, rho - cost / np.where(slope == 0, np.nan, slope)), done

    return _settled(o, b, step, sync.MOST_STEPS)


def points(o: dict, b: Arrays) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(which rows have a point, s_x, s_y, s_z of these): what sync.sync gives."""
    rho, dot = ranges(o, b), b["rho_dot_obs"]
    r_at = np.sqrt(rho * rho + 2.0 * rho * dot + b["obs2"])
    x, y, z = (b[f"obs_{c}"] + rho * b[f"rho_{c}"] for c in "xyz")
    back = -((b["epoch"] - rho / LIGHT_AU_PER_DAY) - o["o_orbit_epoch"]) / o["o_bounds"]
    v_tan, xy2 = o["o_h"] / r_at, x * x + y * y
    xy = np.sqrt(xy2)
    v_rad = np.sqrt(np.maximum(2.0 * np.maximum(o["o_energy"] + o["o_mu"] / r_at, 0.0) - v_tan * v_tan, 0.0))
    g = series(o, "g", back)
    cos_psi = o["o_cos_inc"] * r_at / xy
    sin_psi = o["o_kappa"] * np.sqrt(1.0 - cos_psi * cos_psi)
    across, up, along = g * v_tan * cos_psi / xy, g * v_tan * sin_psi / (r_at * xy), series(o, "f", back) + g * v_rad / r_at
    q = along * x - across * y - up * z * x, along * y + across * x - up * z * y, along * z + up * xy2
    good = np.flatnonzero((np.abs(z / r_at) <= o["o_sin_lat"]) & ~np.isnan(q[0] + q[1] + q[2]))
    return good, *(v[good] / o["o_r"] for v in q)


def newton_sums(detections: DataFrame, orbits: DataFrame) -> DataFrame:
    """(ic_id, n, total): number and sum of the ranges that Newton's method settles."""
    path, _ = stage(detections)

    def run(rows: list[dict]) -> Iterator[pd.DataFrame]:
        n, total = np.zeros(len(rows), np.int64), np.zeros(len(rows))
        with np.errstate(all="ignore"):
            for b in batches(path):
                for k, o in enumerate(rows):
                    rho = newton_ranges(o, b)
                    rho = rho[~np.isnan(rho)]
                    n[k] += len(rho)
                    total[k] += rho.sum()
        yield pd.DataFrame({"ic_id": [o["ic_id"] for o in rows], "n": n, "total": total})

    return over_orbits(orbits, "ic_id string, n bigint, total double", run)


def sweep_counts(detections: DataFrame, orbits: DataFrame, steps: int = 100) -> DataFrame:
    """(ic_id, inc_no, n): how many points of sync.inclination_sweep each inclination holds. It holds those up to a sine of the
    latitude and up to a ratio r / xy, so each point is counted once under how many inclinations, in the order of their
    cosines' sizes, hold it."""
    path, _ = stage(detections)
    cosines = np.abs(1.0 - 2.0 * (np.arange(steps) + 0.5) / steps)
    order = np.argsort(cosines, kind="stable")
    sines = np.sort(np.sqrt(1.0 - cosines * cosines))
    ratios = np.empty(steps)
    for k, c in enumerate(cosines):  # the largest ratio whose product with c is at most 1
        r = 1.0 / max(c, 1e-300)
        while c * r > 1.0:
            r = np.nextafter(r, 0.0)
        while c * np.nextafter(r, np.inf) <= 1.0 and np.isfinite(np.nextafter(r, np.inf)):
            r = np.nextafter(r, np.inf)
        ratios[k] = r
    ratios.sort()

    def run(rows: list[dict]) -> Iterator[pd.DataFrame]:
        seen = np.zeros((len(rows), steps + 1), np.int64)
        use = [k for k, o in enumerate(rows) if np.isfinite([o[f"o_{c}"] for c in ("r", "h", "energy", "mu", "f0", "f1", "f2", "f3", "g0", "g1", "g2", "g3")]).all()]
        with np.errstate(all="ignore"):
            for b in batches(path):
                for k in use:
                    o = rows[k]
                    rho = ranges(o, b)
                    open_ = np.isnan(rho)
                    r_at = np.sqrt(rho * rho + 2.0 * rho * b["rho_dot_obs"] + b["obs2"])
                    rho[open_], r_at[open_] = o["o_r"], o["o_r"]
                    x, y, z = (b[f"obs_{c}"] + rho * b[f"rho_{c}"] for c in "xyz")
                    sine, ratio = np.abs(z / r_at), r_at / np.sqrt(x * x + y * y)
                    ok = ~np.isnan(sine + ratio + b["epoch"]) & ~np.isinf(ratio)
                    held = np.minimum(steps - np.searchsorted(sines, sine[ok]), steps - np.searchsorted(ratios, ratio[ok]))
                    seen[k] += np.bincount(held, minlength=steps + 1)
        for o, s in zip(rows, seen):
            n = np.empty(steps, np.int64)
            n[order] = s[::-1].cumsum()[::-1][1:]  # the inclination at place j holds what more than j hold
            yield pd.DataFrame({"ic_id": o["ic_id"], "inc_no": np.arange(steps, dtype=np.int32), "n": n})[n > 0]

    return over_orbits(orbits, "ic_id string, inc_no int, n bigint", run)


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and their counts; the keys are sorted in place."""
    keys.sort()
    first = np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1))
    return keys[first], np.diff(first, append=len(keys))


def _count_of(values: np.ndarray, n: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(values, wanted), len(values) - 1)
    return np.where(values[at] == wanted, n[at], 0)


def dense_peaks(path: str, n_rows: int, orbits: DataFrame, scale: float, threshold: int, centred: bool) -> DataFrame:
    """(ic_id, i, j, n, total): peaks.grid_peaks of at least `threshold` of grids.sky_grid or grids.centred_grid of the points."""
    turn = 2 * np.pi

    def cells(u: np.ndarray) -> tuple[np.ndarray, int]:
        low, high = u.min(), u.max()
        bins = max(int(np.ceil((high - low) * (1.0 / scale))), 1)
        return np.minimum(np.floor((u - low) * (1.0 / scale)).astype(np.int64), bins - 1), bins

    def run(rows: list[dict]) -> Iterator[pd.DataFrame]:
        lon, lat = np.empty(n_rows), np.empty(n_rows)
        for o in rows:
            n = 0
            with np.errstate(all="ignore"):
                for b in batches(path):
                    good, x, y, z = points(o, b)
                    lon[n : n + len(good)], lat[n : n + len(good)] = np.arctan2(y, x), np.arcsin(np.clip(z, -1.0, 1.0))
                    n += len(good)
            if not n:
                continue
            u = lon[:n]
            if centred:
                u = u - np.mod(np.arctan2(np.sin(u).sum(), np.cos(u).sum()), turn)
                np.mod(u, turn, out=u)
                u[u > np.pi] -= turn
            i, _ = cells(u)
            j, wide = cells(lat[:n])
            key = i * (wide + 2)
            key += j + 1
            del i, j, u
            key, count = _runs(key)
            c = count >= max(1, -(-threshold // 9))  # no neighbour of a peak exceeds it
            at, own = key[c], count[c]
            total, most = own.copy(), own.copy()
            for by in (-wide - 3, -wide - 2, -wide - 1, -1, 1, wide + 1, wide + 2, wide + 3):
                near = _count_of(key, count, at + by)
                total += near
                np.maximum(most, near, out=most)
            top = (most <= own) & (total >= threshold)
            yield pd.DataFrame({"ic_id": o["ic_id"], "i": at[top] // (wide + 2), "j": at[top] % (wide + 2) - 1, "n": own[top], "total": total[top]})

    return over_orbits(orbits, "ic_id string, i bigint, j bigint, n bigint, total bigint", run)


def _rings(depth: int, pix: np.ndarray, rim: dict[int, np.ndarray]) -> np.ndarray:
    """healpix.np_neighbours as rows of 8, -1 where there are fewer; rim remembers the pixels at the faces' borders."""
    n = 1 << depth
    face, ix, iy = healpix.np_split(depth, pix)
    out = np.stack([healpix.np_join(depth, face, (ix + a) % n, (iy + b) % n) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b], axis=1)
    border = np.flatnonzero((ix == 0) | (ix == n - 1) | (iy == 0) | (iy == n - 1))
    for k, p in zip(border.tolist(), pix[border].tolist()):
        if p not in rim:
            rim[p] = np.full(8, -1, np.int64)
            near = healpix.np_neighbours(depth, pix[k : k + 1])[0]
            rim[p][: len(near)] = near
        out[k] = rim[p]
    return out


def _mixed(v: np.ndarray, seed: int) -> np.ndarray:
    v = (v.astype(np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    v = (v ^ (v >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    v = (v ^ (v >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return v ^ (v >> np.uint64(31))


PAIRS = 2_000_000  # of centres and points near them that are looked at together


def clusters(path: str, n_rows: int, orbits: DataFrame, ref_epoch: float, depth: int, arcsec: float, min_points: int, min_times: int, min_nights: int, max_dt: float, rows_of: bool) -> DataFrame:
    """What linker.clusters finds, one orbit in a task: (ic_id, hpix, n, members), number and sum of the ids; or with rows_of its
    members (ic_id, hpix, total, c_x, c_y, c_z, row, s_x, s_y, s_z, d2, dt)."""
    limit = chord2_of(arcsec * ARCSEC)
    reach = limit**0.5 * (1 + 1e-9)
    side, wide = 2.0 * reach, int(1.1 / reach) + 5

    def bucket(x, y, z):
        return (x * wide + y) * wide + z

    def of_orbit(o: dict, rim: dict) -> Iterator[pd.DataFrame]:
        s, intid, epoch, row, n = np.empty((3, n_rows)), np.empty(n_rows, np.int64), np.empty(n_rows), np.empty(n_rows, np.int64), 0
        pix = np.empty(n_rows, np.int64)
        for b in batches(path):
            good, *v = points(o, b)
            end = n + len(good)
            s[:, n:end], intid[n:end], epoch[n:end], row[n:end] = v, b["intid"][good], b["epoch"][good], b["row"][good]
            pix[n:end] = healpix.np_pixel(depth, s[:, n:end].T)
            n = end
        if not n:
            return
        key, count = _runs(pix[:n])
        full = count >= 2
        at, own = key[full], count[full]
        ring = _rings(depth, at, rim)
        sums = own + sum(_count_of(key, count, r) for r in ring.T)
        peak = np.flatnonzero(sums >= min_points)
        if not len(peak):
            return
        most = np.max([_count_of(at, sums, r) for r in ring[peak].T], axis=0)
        peak = peak[most <= sums[peak]]
        at, total = at[peak], sums[peak]
        c = healpix.np_centre(depth, at).T
        del pix, key, count, ring
        # the points of the buckets that a ball around a centre touches
        low, high = (np.floor((c + by) / side).astype(np.int64) for by in (-reach, reach))
        probes = []
        for dx in range(3):
            for dy in range(3):
                for dz in range(3):
                    k = np.flatnonzero((low[0] + dx <= high[0]) & (low[1] + dy <= high[1]) & (low[2] + dz <= high[2]))
                    probes.append((k, bucket(low[0, k] + dx, low[1, k] + dy, low[2, k] + dz)))
        who, where = (np.concatenate(x) for x in zip(*probes))
        o_ = np.argsort(who, kind="stable")
        who, where = who[o_], where[o_]
        home = bucket(*(np.floor(x[:n] / side).astype(np.int64) for x in s))
        wanted = np.unique(where)
        near = np.flatnonzero(wanted[np.minimum(np.searchsorted(wanted, home), len(wanted) - 1)] == home)
        near = near[np.argsort(home[near], kind="stable")]
        home = home[near]
        first, last = np.searchsorted(home, where), np.searchsorted(home, where, "right")

        def met(which: np.ndarray | None = None) -> Iterator[tuple]:
            """(centre, point, d2), whole centres at a time in their order."""
            use = np.arange(len(who)) if which is None else np.flatnonzero(which[who])
            load = np.cumsum(last[use] - first[use])
            ends = np.flatnonzero(np.diff(who[use], append=-1)) + 1
            begin = 0
            while begin < len(use):
                before = load[begin - 1] if begin else 0
                at_most = np.searchsorted(load[ends - 1], before + PAIRS, "right") - 1
                k = ends[max(at_most, np.searchsorted(ends, begin, "right"))]
                part = use[begin:k]
                size = last[part] - first[part]
                p = near[np.repeat(first[part] - np.cumsum(size) + size, size) + np.arange(size.sum())]
                w = np.repeat(who[part], size)
                d = [s[x, p] - c[x, w] for x in range(3)]
                d2 = d[0] * d[0] + d[1] * d[1] + d[2] * d[2]
                keep = d2 <= limit
                yield w[keep], p[keep], d2[keep]
                begin = k

        m = len(at)
        stats = {x: np.zeros(m, np.int64) for x in ("n", "members", "times", "nights")}
        digest = np.zeros((m, 6), np.uint64)
        for w, p, _ in met():
            if not len(w):
                continue
            cut = np.flatnonzero(np.diff(w, prepend=-1))
            g, ids = w[cut], intid[p]
            digest[g, 0] = np.diff(cut, append=len(w))
            digest[g, 1], digest[g, 2] = np.minimum.reduceat(ids, cut).astype(np.uint64), np.maximum.reduceat(ids, cut).astype(np.uint64)
            for k in (1, 2, 3):
                digest[g, 2 + k] = np.bitwise_xor.reduceat(_mixed(ids, k), cut)
            dt = epoch[p] - ref_epoch
            ok = np.abs(dt) <= max_dt
            w, dt, ids = w[ok], dt[ok], ids[ok]
            stats["n"] += np.bincount(w, minlength=m)
            np.add.at(stats["members"], w, ids)
            dt = dt[np.lexsort((dt, w))]  # w is in order already
            fresh = np.diff(w, prepend=-1) != 0
            stats["times"] += np.bincount(w[fresh | (np.diff(dt, prepend=0) != 0)], minlength=m)
            day = np.floor(np.abs(dt) + 0.5) * np.sign(dt)
            stats["nights"] += np.bincount(w[fresh | (np.diff(day, prepend=0) != 0)], minlength=m)
        # of equal sets the fuller, then lower pixel
        o_ = np.lexsort((at, -total, *digest.T))
        same = np.r_[False, (digest[o_][1:] == digest[o_][:-1]).all(axis=1)]
        kept = np.zeros(m, bool)
        kept[o_[~same]] = True
        kept &= (stats["n"] >= max(min_points, 1)) & (stats["times"] >= min_times) & (stats["nights"] >= min_nights)
        if not rows_of:
            yield pd.DataFrame({"ic_id": o["ic_id"], "hpix": at[kept], "n": stats["n"][kept], "members": stats["members"][kept]})
            return
        for w, p, d2 in met(kept) if kept.any() else ():
            dt = epoch[p] - ref_epoch
            ok = np.abs(dt) <= max_dt
            w, p = w[ok], p[ok]
            yield pd.DataFrame({"ic_id": o["ic_id"], "hpix": at[w], "total": total[w], **dict(zip(("c_x", "c_y", "c_z"), c[:, w])), "row": row[p], **dict(zip(("s_x", "s_y", "s_z"), s[:, p])), "d2": d2[ok], "dt": dt[ok]})

    def run(rows: list[dict]) -> Iterator[pd.DataFrame]:
        rim: dict[int, np.ndarray] = {}
        for o in rows:
            with np.errstate(all="ignore"):
                yield from of_orbit(o, rim)

    doubles = ", ".join(f"{c} double" for c in ("s_x", "s_y", "s_z", "d2", "dt"))
    return over_orbits(orbits, f"ic_id string, hpix bigint, total bigint, c_x double, c_y double, c_z double, row bigint, {doubles}" if rows_of else "ic_id string, hpix bigint, n bigint, members bigint", run)


BLOCK = 65_536  # pairs that are looked at together: their arrays stay in a core's cache
TILE = 128  # centres that meet the points near them together,
COLUMNS = 2_048  # so many of these at a time; sums of as many limbs are exact in single precision
DENSE = 4_096  # from so many pairs on, a cell's centres meet the points near them as a block
CROWD = 1_500.0  # points that a cell is to hold where there are many
LIMB = 13  # bits


def _spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[k], first[k] + 1, ... of size[k] numbers each, one after another."""
    return np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())


class _Cells:
    """An orbit's points in the order of buckets of space and, within them, of bins of time. A bucket's side is a `parts`-th of
    the search radius and a bin's length that of max_days, or more where the keys would not fit 62 bits. `row`: of the points in
    the stage, whose rows stand for `weights` detections."""

    def __init__(self, s: np.ndarray, epoch: np.ndarray, row: np.ndarray, weights: np.ndarray, reach: float, max_days: float, angle: float, parts: int):
        self.reach, self.max_days, self.angle, self.parts = reach, max_days, angle, parts
        self.side = reach / parts * (1 + 1e-9)
        low, high, begin, end = s.min(axis=1), s.max(axis=1), epoch.min(), epoch.max()
        self.bin = max(max_days / parts * (1 + 1e-9), (end - begin) / 16_000)
        self.bins = int((end - begin) / self.bin) + 1
        while True:
            dims = [int(d) + 2 * parts + 2 for d in (high - low) / self.side]
            if dims[0] * dims[1] * dims[2] * self.bins < 1 << 62:
                break
            self.side *= 2
        self.strides = (dims[1] * dims[2], dims[2])
        key = np.zeros(s.shape[1], np.int64)
        for x, d in zip(range(3), dims):
            key *= d
            key += ((s[x] - low[x]) / self.side).astype(np.int64) + parts
        key *= self.bins
        key += np.minimum(((epoch - begin) / self.bin).astype(np.int64), self.bins - 1)
        order = np.argsort(key)
        key = key[order]
        for x in range(3):
            s[x] = s[x, order]
        self.s, self.epoch, self.row = s, epoch[order], row[order]
        self.weight = np.r_[0, np.cumsum(weights[self.row])]
        self.at = np.r_[np.flatnonzero(np.diff(key, prepend=key[0] - 1)), len(key)]  # of cells among the points
        key, self.time = np.divmod(key[self.at[:-1]], self.bins)
        self.first = np.r_[np.flatnonzero(np.diff(key, prepend=key[0] - 1)), len(key)]  # of buckets among the cells
        self.key = key[self.first[:-1]]
        self.ranked = np.repeat(np.arange(len(self.key)), np.diff(self.first)) * self.bins + self.time
        self.table = None
        if len(self.key) * self.bins <= max(8 * len(self.epoch), 1 << 20):  # looking up beats searching
            self.table = np.zeros(len(self.key) * self.bins + 1, np.int32)
            self.table[self.ranked + 1] = np.diff(self.at)
            np.cumsum(self.table, out=self.table)

    def before(self, ranked: np.ndarray) -> np.ndarray:
        """Number of points of buckets and bins before those of a rank."""
        return self.at[np.searchsorted(self.ranked, ranked)] if self.table is None else self.table[ranked].astype(np.int64)

    def load(self) -> float:
        """Points in the cell of a point, on an average."""
        return float((np.diff(self.at).astype(float) ** 2).sum() / len(self.epoch))

    def _columns(self, buckets: np.ndarray):
        """(dx, dy, key of the middle, first, last) of the buckets around the given ones that share an x and a y."""
        q = self.parts
        for dx in range(-q, q + 1):
            for dy in range(-q, q + 1):
                if self._gap2(dx, dy, 0) <= self.reach**2:
                    middle = self.key[buckets] + (dx * self.strides[0] + dy * self.strides[1])
                    yield dx, dy, middle, np.searchsorted(self.key, middle - q), np.searchsorted(self.key, middle + q, "right")

    def _gap2(self, *by):
        """The square of the least distance of points of buckets so many apart."""
        return sum((np.maximum(np.abs(d) - 1, 0) * (self.side * (1 - 1e-9))) ** 2 for d in by)

    def near(self, least: int, wanted: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(cells, of, first, last), many cells at a time: ranges first to last of all points that may be near those of
        cells[of]. Cells with fewer than `least` detections there are left out, and those not wanted."""
        place = self.weight[self.at[self.first]]
        buckets = np.arange(len(self.key)) if wanted is None else np.unique(np.searchsorted(self.first, np.flatnonzero(wanted), "right") - 1)
        total = np.zeros(len(buckets), np.int64)
        for *_, low, high in self._columns(buckets):
            total += place[high] - place[low]
        buckets = buckets[total >= least]
        for k in range(0, len(buckets), 8192):
            yield from self._near(buckets[k : k + 8192], least, wanted)

    def _near(self, buckets: np.ndarray, least: int, wanted: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        found = []
        for dx, dy, middle, low, high in self._columns(buckets):
            a, b = np.repeat(np.arange(len(buckets)), high - low), _spread(low, high - low)
            gap2 = self._gap2(dx, dy, self.key[b] - middle[a])
            # the time by which the angle may have grown to the gap, in bins
            wait = np.ceil((np.sqrt(gap2) - ARCSEC) / self.angle * self.max_days / self.bin - 1 - 1e-6)
            ok = (gap2 <= self.reach**2) & (wait <= self.parts)
            a, b, wait = buckets[a[ok]], b[ok], np.maximum(wait[ok], 0).astype(np.int64)
            size = self.first[a + 1] - self.first[a]
            cell, b, wait = _spread(self.first[a], size), np.repeat(b, size), np.repeat(wait, size)
            if wanted is not None:
                ok = wanted[cell]
                cell, b, wait = cell[ok], b[ok], wait[ok]
            whole = wait == 0
            for c, r, by, to in ((cell[whole], b[whole], -self.parts, self.parts), (cell[~whole], b[~whole], -self.parts, -wait[~whole]), (cell[~whole], b[~whole], wait[~whole], self.parts)):
                t, r = self.time[c], r * self.bins
                begin, end = np.maximum(t + by, 0), np.minimum(t + to, self.bins - 1)
                c, r, begin, end = (x[begin <= end] for x in (c, r, begin, end))
                first, last = self.before(r + begin), self.before(r + end + 1)
                ok = first < last
                found.append((c[ok], first[ok], last[ok]))
        cell, first, last = (np.concatenate(x) for x in zip(*found))
        cells, of = np.unique(cell, return_inverse=True)
        ok = np.bincount(of, self.weight[last] - self.weight[first], minlength=len(cells))[of] >= least
        order = np.flatnonzero(ok)[np.argsort(of[ok], kind="stable")]
        cells, of = np.unique(cell[order], return_inverse=True)
        if len(cells):
            yield cells, of, first[order], last[order]


class _Ids:
    """What the stage's rows stand for: `ids`, the lowest of each, and the QUANTITIES of sets in `limbs` of a few bits, whose
    sums single precision holds."""

    def __init__(self, path: str, n_rows: int):
        own = {c: np.ones(n_rows, np.int64) for c in ("intid", *QUANTITIES)}
        n = 0
        for b in batches(path, columns=("intid", *QUANTITIES)):
            end = n + len(b["intid"])
            for c, v in b.items():
                own[c][n:end] = v
            n = end
        self.ids, mixed = own["intid"], None
        if "n" not in b:  # a row for each id
            mixed = _mixed(self.ids, 1)
            own |= dict(zip(QUANTITIES[1:], (self.ids & 0xFFFFFFFF, self.ids >> 32, (mixed & np.uint64(0xFFFFFF)).astype(np.int64), (mixed >> np.uint64(40)).astype(np.int64))))
        self.weights = own["n"]
        self.layout = []
        for k, c in enumerate(QUANTITIES):
            low, high = int(own[c].min()), int(own[c].max())
            bits = max(high.bit_length(), (~low).bit_length() + 1 if low < 0 else 0)
            self.layout += [(k, shift, shift + LIMB >= bits) for shift in range(0, bits, LIMB)]
        self.limbs = np.empty((n_rows, len(self.layout)), np.float32)
        for x, (k, shift, top) in enumerate(self.layout):
            v = own[QUANTITIES[k]] >> shift
            self.limbs[:, x] = v if top else v & ((1 << LIMB) - 1)  # the top one has the sign

    def whole(self, sums: np.ndarray) -> np.ndarray:
        """The QUANTITIES of sums of limbs, by row."""
        out = np.zeros((len(QUANTITIES), len(sums)), np.int64)
        for x, (k, shift, _) in enumerate(self.layout):
            out[k] += sums[:, x].astype(np.int64) << shift
        return out


class _Near(NamedTuple):
    """Points in order of time, in a block's own coordinates: p of the cells' points, sums of what they stand for, and their
    columns of the product for later and for earlier centres."""

    p: np.ndarray
    b: np.ndarray
    t: np.ndarray
    epoch: np.ndarray
    limbs: np.ndarray
    behind: np.ndarray
    ahead: np.ndarray


def _tiles(v: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Places of at most so many columns of v that are near each other, until all are dealt out."""
    left = [np.arange(v.shape[1])]
    while left:
        g = left.pop()
        if len(g) <= most:
            yield g
            continue
        half = np.argpartition(v[np.argmax(np.ptp(v[:, g], axis=1)), g], len(g) // 2)
        left += [g[half[: len(g) // 2]], g[half[len(g) // 2 :]]]


def _first_of_equal(key: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Places of the columns of key of which there is one, or of equal ones the one of the lowest `order`."""
    short = np.zeros(key.shape[1], np.uint64)
    for k in range(len(key)):
        short = _mixed(short ^ key[k].astype(np.uint64), k)
    by = np.argsort(short)
    same = short[by[1:]] == short[by[:-1]]
    many = np.r_[False, same] | np.r_[same, False]
    alone, by = by[~many], by[many]
    by = by[np.lexsort((order[by], *key[:, by]))]
    if len(by):
        by = by[np.r_[True, (key[:, by[1:]] != key[:, by[:-1]]).any(axis=0)]]
    return np.concatenate([alone, by])


def neighbourhoods(path: str, n_rows: int, orbits: DataFrame, arcsec: float, max_days: float, min_detections: int, min_duration: float, min_nights: int, rows_of: bool) -> DataFrame:
    """The distinct neighbourhoods of linking.neighbours_of_points that pass linking.duration_screen, of equal ones that of the
    lowest centre, one orbit in a task; ids occur once: (ic_id, centre_intid, n, members), number and sum of the ids; or with
    rows_of its members (ic_id, centre_intid, intid, angle, dt). `path`: of stage, or without rows_of of stage_distinct."""
    limit, angle = chord2_of(arcsec * ARCSEC), arcsec * ARCSEC
    reach = limit**0.5 * (1 + 1e-9)
    least = max(min_detections, 1)

    def fits(d2: np.ndarray, dt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        wide = np.arccos(np.clip(1.0 - d2 / 2.0, -1.0, 1.0))
        return (d2 <= limit) & (dt <= max_days) & (wide <= dt / max_days * angle + ARCSEC), wide

    def night_of(epoch: np.ndarray) -> np.ndarray:
        whole = np.floor(np.abs(epoch))
        return np.copysign(whole + (np.abs(epoch) - whole >= 0.5), epoch)

    slope, rest = angle / reach, ARCSEC / reach
    sure = (1.0 - rest) / slope - 1e-5  # until then the angle's limit is below the search radius

    def block(c: _Cells, ids: _Ids, k0: int, k1: int, p: np.ndarray) -> Iterator[tuple]:
        """Of the centres k0 to k1 that pass: (centre, sums of limbs). With lengths in search radii and times in max_days, and
        for one order in time, d2 - (dt * slope + rest)^2 is a product of matrices; single precision tells all pairs but those
        at the border, which are looked at again. The centres are dealt to tiles of a few that are near each other."""
        origin, start = (c.s[:, k0:k1].min(axis=1) + c.s[:, k0:k1].max(axis=1)) / 2, c.epoch[k0]

        def local(k: np.ndarray | slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            v = np.stack([(c.s[x][k] - origin[x]) / reach for x in range(3)]).astype(np.float32)
            return v, (v * v).sum(axis=0), (c.epoch[k] - start) / max_days

        (a, a2, ta), (b, b2, tb) = local(slice(k0, k1)), local(p)
        early, late = ta.min(), ta.max()
        gap = np.maximum(early - tb, tb - late)  # to the nearest centre in time
        use = np.sqrt(b2) <= np.minimum((gap + (late - early)) * slope + rest, 1.0) + (float(np.sqrt(a2.max())) + 1e-5)
        use &= gap <= 1.0 + 1e-5
        order = np.flatnonzero(use)
        order = order[np.argsort(tb[order])]
        if not len(order):
            return
        p, b, b2, tb = p[order], b[:, order], b2[order], tb[order]

        def right(turn: float) -> np.ndarray:
            out = np.empty((6, len(tb)), np.float32)
            out[:3], out[3], out[4], out[5] = b * np.float32(-2.0), 2.0 * slope**2 * tb + turn, 1.0, b2 - (slope**2 * tb + turn) * tb
            return out

        left = np.stack([*a, ta, a2 - slope**2 * ta**2 - rest**2, np.ones(len(ta))], axis=1).astype(np.float32)
        eps = np.float32(6e-6 * (1.0 + b2.max() + (tb * tb).max()) + limit + 1e-15 / limit)
        near = _Near(p, b, tb, c.epoch[p], c.limbs[p], right(-2.0 * slope * rest), right(2.0 * slope * rest))
        for g in _tiles(np.stack([*a, 1.5 * ta]), TILE):
            ok, total = tile(c, ids, k0 + g, a[:, g], ta[g], left[g], near, eps)
            if len(ok):
                yield k0 + g[ok], total

    def tile(c: _Cells, ids: _Ids, centres: np.ndarray, a: np.ndarray, ta: np.ndarray, left: np.ndarray, near: _Near, eps: float) -> tuple[np.ndarray, np.ndarray]:
        """(which centres pass, their sums). Points near all centres are summed up once."""
        m, early, late, origin = len(centres), ta.min(), ta.max(), (a.min(axis=1) + a.max(axis=1)) / 2
        wide = float(np.sqrt(((a - origin[:, None]) ** 2).sum(axis=0).max())) + 1e-5
        k = slice(*np.searchsorted(near.t, [early - 1.0 - 1e-5, late + 1.0 + 1e-5]))
        away = near.b[:, k] - origin[:, None]
        away = np.sqrt(np.einsum("ij,ij->j", away, away))
        t = near.t[k].astype(np.float32)
        gap = np.maximum(np.float32(early) - t, t - np.float32(late))
        use = away <= np.minimum((gap + np.float32(late - early)) * np.float32(slope) + np.float32(rest), np.float32(1.0)) + np.float32(wide)
        inner = away + np.float32(wide + 1e-5 + limit + (1e-15 / limit) ** 0.5) <= np.maximum(gap, np.float32(0.0)) * np.float32(slope) + np.float32(rest)
        inner &= gap <= np.float32(sure - (late - early) - 1e-5)
        always = k.start + np.flatnonzero(inner)
        p = k.start + np.flatnonzero(use & ~inner)
        t, n = near.t[p], len(p)
        mid = slice(*np.searchsorted(t, [early, late]))  # before some centres and after others
        ahead, behind = np.concatenate([near.behind[:, p[: mid.start]], near.ahead[:, p[mid.start :]]], axis=1), near.behind[:, p[mid]]
        limbs = near.limbs[p]
        total = np.zeros((m, limbs.shape[1])) + near.limbs[always].sum(axis=0, dtype=float)
        some = always[:: max(1, len(always) // 64)]
        enough = bool(lasting(np.ones((1, len(some)), bool), near.epoch[some])[0])
        seen = None if enough else np.empty((m, n), bool)
        # by time: from begin to end, of which from first to last the search radius needs no look
        begin, first, last, end = (np.searchsorted(t, ta + by) for by in (-1.0 - 1e-6, -sure, sure, 1.0 + 1e-6))
        if sure <= 0.0:
            first = last = begin
        border = [(np.repeat(np.arange(m), y - x), _spread(x, y - x)) for x, y in ((begin, first), (last, end))]
        edges = first.max(), last.min()
        for j in range(0, n, COLUMNS):
            to = min(j + COLUMNS, n)
            met = left @ ahead[:, j:to]
            x = slice(max(mid.start, j), min(mid.stop, to))
            if x.start < x.stop:
                both = met[:, x.start - j : x.stop - j]
                np.minimum(both, left @ behind[:, x.start - mid.start : x.stop - mid.start], out=both)
            if j < edges[0] or to > edges[1]:
                for row, x, y in zip(met, first.tolist(), last.tolist()):
                    row[: max(x - j, 0)] = row[max(y - j, 0) :] = np.inf
            met, open_ = met <= -eps, met <= eps
            open_ ^= met
            i, at = np.divmod(np.flatnonzero(open_), to - j)
            border.append((i, at + j))
            if seen is not None:
                seen[:, j:to] = met
            total += met.astype(np.float32) @ limbs[j:to]
        i, j = (np.concatenate(x) for x in zip(*border))
        q, w = near.p[p[j]], centres[i]
        d = c.s[:, w] - c.s[:, q]
        ok = fits(d[0] * d[0] + d[1] * d[1] + d[2] * d[2], np.abs(c.epoch[w] - c.epoch[q]))[0]
        i, j = i[ok], j[ok]
        for x in range(limbs.shape[1]):
            total[:, x] += np.bincount(i, limbs[j, x], minlength=m)
        ok = np.flatnonzero(ids.whole(total)[0] >= least)
        if seen is not None and len(ok):
            seen[i, j] = True
            open_, steps = np.ones(len(ok), bool), (max(1, n // 128), 1)
            for step in steps:  # some of the members tell most centres that pass, all of them the others
                if open_.any():
                    use, which = p[::step], seen[:, ::step][ok[open_]]
                    if len(always):
                        use = np.r_[use, always[::step]]
                        by = np.argsort(use)  # near is in order of time
                        use, which = use[by], np.concatenate([which, np.ones((len(which), len(use) - which.shape[1]), bool)], axis=1)[:, by]
                    open_[open_] = ~lasting(which, near.epoch[use])
            ok = ok[~open_]
        return ok, total[ok]

    def lasting(members: np.ndarray, when: np.ndarray) -> np.ndarray:
        """Which rows of members, at times in their order, last long enough and have enough nights."""
        ok = members.any(axis=1)
        some = members[ok]
        if len(some):
            long = when[len(when) - 1 - some[:, ::-1].argmax(axis=1)] - when[some.argmax(axis=1)] >= min_duration
            nights = np.logical_or.reduceat(some, np.flatnonzero(np.diff(night_of(when), prepend=np.nan) != 0), axis=1).sum(axis=1)
            ok[ok] = long & (nights >= min_nights)
        return ok

    def listed(c: _Cells, found: tuple, use: np.ndarray | None = None) -> Iterator[tuple]:
        """(centre, point, angle, dt) of the pairs that fit, whole centres at a time in their order; `use`: of these centres."""
        cells, of, first, last = found
        size = last - first
        begin = np.searchsorted(of, np.arange(len(cells) + 1))
        load = np.add.reduceat(size, begin[:-1])
        many = np.diff(c.at)[cells]
        centre, cell = _spread(c.at[cells], many), np.repeat(np.arange(len(cells)), many)
        if use is not None:
            centre, cell = centre[use[centre]], cell[use[centre]]
        batch = np.cumsum(load[cell]) // (2 * BLOCK)
        for k in np.split(np.arange(len(centre)), np.flatnonzero(np.diff(batch)) + 1):
            runs = begin[cell[k] + 1] - begin[cell[k]]
            r = _spread(begin[cell[k]], runs)
            w, p = np.repeat(np.repeat(centre[k], runs), size[r]), _spread(first[r], size[r])
            dt = np.abs(c.epoch[p] - c.epoch[w])
            ok = dt <= max_days
            w, p, dt = w[ok], p[ok], dt[ok]
            d = [c.s[x, p] - c.s[x, w] for x in range(3)]
            d2 = d[0] * d[0] + d[1] * d[1] + d[2] * d[2]
            ok = d2 <= limit
            w, p, dt = w[ok], p[ok], dt[ok]
            ok, wide = fits(d2[ok], dt)
            yield w[ok], p[ok], wide[ok], dt[ok]

    def sparse(c: _Cells, ids: _Ids, found: tuple) -> Iterator[tuple]:
        """What block gives, from lists of pairs."""
        for w, p, *_ in listed(c, found):
            if not len(w):
                continue
            cut = np.flatnonzero(np.diff(w, prepend=-1))
            ok = np.add.reduceat(ids.weights[c.row[p]], cut) >= least
            ok = np.repeat(ok, np.diff(cut, append=len(w)))
            w, p = w[ok], p[ok]
            if not len(w):
                continue
            cut = np.flatnonzero(np.diff(w, prepend=-1))
            epoch = c.epoch[p]
            night = night_of(epoch)
            night = night[np.lexsort((night, w))]  # w is in order already
            fresh = (np.diff(w, prepend=-1) != 0) | (np.diff(night, prepend=0) != 0)
            ok = (np.maximum.reduceat(epoch, cut) - np.minimum.reduceat(epoch, cut) >= min_duration) & (np.add.reduceat(fresh.astype(np.int64), cut) >= min_nights)
            if ok.any():
                yield w[cut[ok]], np.add.reduceat(c.limbs[p], cut, axis=0, dtype=float)[ok]

    def passing(c: _Cells, ids: _Ids, found: tuple) -> Iterator[tuple]:
        cells, of, first, last = found
        begin = np.searchsorted(of, np.arange(len(cells) + 1))
        dense = np.add.reduceat(last - first, begin[:-1]) * np.diff(c.at)[cells] >= DENSE
        for k in np.flatnonzero(dense):
            r = slice(begin[k], begin[k + 1])
            yield from block(c, ids, c.at[cells[k]], c.at[cells[k] + 1], _spread(first[r], last[r] - first[r]))
        rest = ~dense[of]
        if rest.any():
            cells, of = np.unique(cells[of[rest]], return_inverse=True)
            yield from sparse(c, ids, (cells, of, first[rest], last[rest]))

    def of_orbit(o: dict, ids: _Ids) -> Iterator[pd.DataFrame]:
        s, epoch, row, n, begin = np.empty((3, n_rows)), np.empty(n_rows), np.empty(n_rows, np.int32), 0, 0
        for b in batches(path, columns=tuple(NUMBERS)):
            good, *v = points(o, b)
            end = n + len(good)
            s[:, n:end], epoch[n:end], row[n:end] = v, b["epoch"][good], begin + good
            n, begin = end, begin + len(b["epoch"])
        if not n:
            return
        c = _Cells(s[:, :n], epoch[:n], row[:n], ids.weights, reach, max_days, angle, 1)
        parts = int(min(max(round((c.load() / CROWD) ** (1 / 3)), 1), 4))
        if parts > 1:
            c = _Cells(c.s, c.epoch, c.row, ids.weights, reach, max_days, angle, parts)
        del s, epoch, row
        c.limbs = ids.limbs[c.row]
        passed = [x for found in c.near(least) for x in passing(c, ids, found)]
        if not passed:
            return
        centre, sums = (np.concatenate(x) for x in zip(*passed))
        del passed
        sums = ids.whole(sums)
        kept = _first_of_equal(sums, ids.ids[c.row[centre]])
        if not rows_of:
            for k in range(0, len(kept), 1 << 20):
                x = kept[k : k + (1 << 20)]
                yield pd.DataFrame({"ic_id": o["ic_id"], "centre_intid": ids.ids[c.row[centre[x]]], "n": sums[0][x], "members": sums[1][x] + (sums[2][x] << 32)})
            return
        use = np.zeros(n, bool)
        use[centre[kept]] = True
        for found in c.near(least, np.logical_or.reduceat(use, c.at[:-1])):
            for w, p, wide, dt in listed(c, found, use):
                yield pd.DataFrame({"ic_id": o["ic_id"], "centre_intid": ids.ids[c.row[w]], "intid": ids.ids[c.row[p]], "angle": wide, "dt": dt})

    def run(rows: list[dict]) -> Iterator[pd.DataFrame]:
        ids = _Ids(path, n_rows) if n_rows else None
        for o in rows if n_rows else ():
            with np.errstate(all="ignore"):
                yield from of_orbit(o, ids)

    return over_orbits(orbits, "ic_id string, centre_intid bigint, intid bigint, angle double, dt double" if rows_of else "ic_id string, centre_intid bigint, n bigint, members bigint", run)
