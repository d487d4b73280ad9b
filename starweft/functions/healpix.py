"""Sky pixels of the hierarchical equal-area scheme in nested order (Gorski et al. 2005), depth 0 to 16."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPREAD = [(16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)]


def nside(depth: int) -> int:
    if not 0 <= depth <= 16:
        raise ValueError("depth must be 0 to 16")
    return 1 << depth


def morton(i: Column, j: Column) -> Column:
    """Bits of i and j interleaved, i in the even places: binary digits read as a number to the base 4."""

    def spread(v: Column) -> Column:
        return F.conv(F.bin(v.cast("long")), 4, 10).cast("long")

    return spread(i) + 2 * spread(j)


def with_pixel(df: DataFrame, depth: int, prefix: str, name: str = "hpix") -> DataFrame:
    """df with the nested pixel of the direction <prefix>_x, _y, _z (of any length); rows without a direction are dropped.

    Worked out in steps of few columns each, so that generated code computes every intermediate value once.
    """
    n = nside(depth)
    v = [F.col(f"{prefix}_{c}") for c in "xyz"]
    length = F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])
    cols = df.columns
    df = df.filter((length > 0) & (length < F.lit(float("inf"))))
    df = df.select(*cols, (v[2] / length).alias("__z"), ((v[0] * v[0] + v[1] * v[1]) / (length * length)).alias("__s2"), (F.pmod(F.atan2(v[1], v[0]), F.lit(2 * math.pi)) * (2.0 / math.pi)).alias("__t"))
    z, t = F.col("__z"), F.least(F.col("__t"), F.lit(3.9999999999999996))
    df = df.select(*cols, "__z", "__s2", t.alias("__t"), F.floor(t).cast("long").alias("__q"), (t - F.floor(t)).alias("__tp"))
    size = n * F.sqrt(3.0 * F.col("__s2") / (1.0 + F.abs(z)))
    belt = F.abs(z) <= 2.0 / 3.0
    # j, k: the two diagonal coordinates, of the belt or of the caps
    j = F.when(belt, n * (0.5 + F.col("__t") - 0.75 * z)).otherwise(F.least(F.col("__tp") * size, F.lit(n - 0.5)))
    k = F.when(belt, n * (0.5 + F.col("__t") + 0.75 * z)).otherwise(F.least((1.0 - F.col("__tp")) * size, F.lit(n - 0.5)))
    df = df.select(*cols, belt.alias("__b"), (z >= 0).alias("__n"), "__q", F.floor(j).cast("long").alias("__j"), F.floor(k).cast("long").alias("__k"))
    low = F.lit(n - 1).cast("long")
    df = df.select(*cols, "__b", "__n", "__q", F.shiftright("__j", depth).alias("__fj"), F.shiftright("__k", depth).alias("__fk"), F.col("__j").bitwiseAND(low).alias("__j"), F.col("__k").bitwiseAND(low).alias("__k"))
    fj, fk = F.col("__fj"), F.col("__fk")
    face = F.when(F.col("__b"), F.when(fj == fk, F.pmod(fj, F.lit(4)) + 4).when(fj < fk, fj).otherwise(fk + 8)).when(F.col("__n"), F.col("__q")).otherwise(F.col("__q") + 8)
    ix = F.when(F.col("__b"), F.col("__k")).when(F.col("__n"), n - 1 - F.col("__k")).otherwise(F.col("__j"))
    iy = F.when(F.col("__b") | F.col("__n"), n - 1 - F.col("__j")).otherwise(F.col("__k"))
    # declared free of nulls, else a join on it would push a null check through all the steps
    return df.select(*cols, F.coalesce(F.shiftleft(face.cast("long"), 2 * depth) + morton(ix, iy), F.lit(-1)).alias(name))


# The same in numpy, for centres and neighbours.
def np_pixel(depth: int, v: np.ndarray) -> np.ndarray:
    n = 1 << depth
    v = v / np.linalg.norm(v, axis=-1, keepdims=True)
    x, y, z = v[..., 0], v[..., 1], v[..., 2]
    tt = np.mod(np.arctan2(y, x) * (2 / np.pi), 4.0)
    tt = np.where(tt >= 4.0, 0.0, tt)
    jp, jm = np.floor(n * (0.5 + tt - 0.75 * z)).astype(np.int64), np.floor(n * (0.5 + tt + 0.75 * z)).astype(np.int64)
    fp, fm = jp // n, jm // n
    face_belt = np.where(fp == fm, fp % 4 + 4, np.where(fp < fm, fp, fm + 8))
    quarter = np.minimum(np.floor(tt), 3).astype(np.int64)
    tp, size = tt - quarter, n * np.sqrt(3 * (x * x + y * y) / (1 + np.abs(z)))
    kp, km = np.minimum(np.floor(tp * size), n - 1).astype(np.int64), np.minimum(np.floor((1 - tp) * size), n - 1).astype(np.int64)
    belt, north = np.abs(z) <= 2 / 3, z >= 0
    face = np.where(belt, face_belt, np.where(north, quarter, quarter + 8))
    ix = np.where(belt, jm % n, np.where(north, n - 1 - km, kp))
    iy = np.where(belt, n - 1 - jp % n, np.where(north, n - 1 - kp, km))
    return np_join(depth, face, ix, iy)


def np_join(depth: int, face: np.ndarray, ix: np.ndarray, iy: np.ndarray) -> np.ndarray:
    def spread(v):
        for shift, mask in _SPREAD:
            v = (v | (v << shift)) & mask
        return v

    return (face.astype(np.int64) << (2 * depth)) + (spread(ix.astype(np.int64)) | (spread(iy.astype(np.int64)) << 1))


def np_split(depth: int, pix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    def gather(v):
        v = v & 0x5555555555555555
        for shift, mask in ((1, 0x3333333333333333), (2, 0x0F0F0F0F0F0F0F0F), (4, 0x00FF00FF00FF00FF), (8, 0x0000FFFF0000FFFF), (16, 0x00000000FFFFFFFF)):
            v = (v | (v >> shift)) & mask
        return v

    inner = pix & ((1 << (2 * depth)) - 1)
    return pix >> (2 * depth), gather(inner), gather(inner >> 1)


def np_place(depth: int, face: np.ndarray, fx: np.ndarray, fy: np.ndarray) -> np.ndarray:
    """Direction of a place in a face, fx and fy in pixels from its southern corner."""
    n = float(1 << depth)
    row = face // 4  # 0 north, 1 belt, 2 south
    x, y = fx / n, fy / n
    h = 1 - row + (x + y) - 1  # height in units in which the caps begin at +-1
    shift = np.where(row == 1, 0.0, 0.5)
    across = (x - y) / 2
    ah = np.abs(h)
    cap = ah > 1
    sigma = np.where(cap, 2 - ah, 1.0)
    z = np.where(cap, np.sign(h) * (1 - sigma**2 / 3), 2 * h / 3)
    stretch = np.where(cap, across / np.maximum(sigma, 1e-300), across)
    phi = (np.pi / 2) * ((face % 4) + shift + np.where(cap & (sigma < 1e-12), 0.0, stretch))
    s = np.where(cap, sigma * np.sqrt(np.maximum((1 + np.abs(z)) / 3, 0)), np.sqrt(np.maximum(1 - z * z, 0)))
    return np.stack([s * np.cos(phi), s * np.sin(phi), z], axis=-1)


def np_centre(depth: int, pix: np.ndarray) -> np.ndarray:
    face, ix, iy = np_split(depth, pix)
    return np_place(depth, face, ix + 0.5, iy + 0.5)


def np_neighbours(depth: int, pix: np.ndarray) -> list[np.ndarray]:
    """Pixels that share an edge or a corner with each pixel: inside of a face by their place, at its border by looking
    which pixels meet around the pixel's own outline."""
    n = 1 << depth
    face, ix, iy = np_split(depth, pix)
    out: list[np.ndarray] = [None] * len(pix)
    steps = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0)]
    inside = (ix > 0) & (ix < n - 1) & (iy > 0) & (iy < n - 1)
    at = np.flatnonzero(inside)
    if len(at):
        near = np.sort(np.stack([np_join(depth, face[at], ix[at] + a, iy[at] + b) for a, b in steps], axis=1), axis=1)
        for k, row in zip(at.tolist(), near):
            out[k] = row
    for k in np.flatnonzero(~inside).tolist():
        corners = np.array([(ix[k] + a, iy[k] + b) for a in (0, 1) for b in (0, 1)], float)
        p = np_place(depth, np.full(4, face[k]), corners[:, 0], corners[:, 1])
        up = p / np.linalg.norm(p, axis=1, keepdims=True)
        east = np.cross(np.where(np.abs(up[:, 2:]) < 0.99, [[0.0, 0, 1]], [[1.0, 0, 0]]), up)
        east /= np.linalg.norm(east, axis=1, keepdims=True)
        north = np.cross(up, east)
        turn = np.arange(24) * (2 * np.pi / 24) + 0.05
        r = 0.04 * math.sqrt(4 * math.pi / 12) / n
        around = up[:, None] + r * (np.cos(turn)[None, :, None] * east[:, None] + np.sin(turn)[None, :, None] * north[:, None])
        found = np.unique(np_pixel(depth, around.reshape(-1, 3)))
        out[k] = found[found != pix[k]]
    return out


def neighbours(depth: int):
    """Column function: the ring of pixels around a pixel, ascending, without itself."""

    @F.pandas_udf("array<bigint>")
    def ring(pix: pd.Series) -> pd.Series:
        return pd.Series(np_neighbours(depth, pix.to_numpy(np.int64)))

    return ring


def centre(depth: int):
    """Column function: a pixel's centre as struct<x, y, z>."""

    @F.pandas_udf("x double, y double, z double")
    def of(pix: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(np_centre(depth, pix.to_numpy(np.int64)), columns=["x", "y", "z"])

    return of
