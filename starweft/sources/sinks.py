"""Results written out: text, CSV and images. Tables are written by Spark; only an image, whose size is checked, is drawn on
the driver."""

from __future__ import annotations

import struct
import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import equatorial_radec
from ..functions.constants import ARCSEC


def write_peaks(peaks: DataFrame, path: str) -> None:
    """`ic_id theta_bin phi_bin count`, separated by blanks."""
    peaks.select("ic_id", "i", "j", "total").write.mode("overwrite").option("sep", " ").csv(path)


def fit_members(fits: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """One line per kept member of a fitted cluster: residuals and pulls in arcsec, and its place in the equatorial plane."""
    eps = 84381.448 / 3600.0 * 3.141592653589793 / 180.0
    kept = fits.select(*keys, "a", "b", "c", "d", "e", F.explode("kept").alias("intid"))
    df = kept.join(rows, [*keys, "intid"])
    xm, ym = F.col("a") + F.col("b") * F.col("t") + F.col("c") * F.col("f"), F.col("d") + F.col("e") * F.col("t") + F.col("c") * F.col("g")
    lam, beta = F.atan2("s_y", "s_x"), F.asin(F.least(F.greatest(F.col("s_z"), F.lit(-1.0)), F.lit(1.0)))
    ra, dec = equatorial_radec(lam, beta, eps)
    return df.select(
        *keys, "intid", "t", (F.col("x") / ARCSEC).alias("theta_x"), (F.col("y") / ARCSEC).alias("theta_y"), (xm / ARCSEC).alias("x_model"), (ym / ARCSEC).alias("y_model"),
        ((F.col("x") - xm) / F.col("sigma")).alias("pull_x"), ((F.col("y") - ym) / F.col("sigma")).alias("pull_y"), F.degrees(ra).alias("ra"), F.degrees(dec).alias("dec"),
    )


def fit_report(fits: DataFrame, keys: list[str]) -> DataFrame:
    """A text line per fit."""
    head = F.concat_ws(" ", *[F.col(k).cast("string") for k in keys])
    return fits.select(F.format_string("# Fit of %s: a=%.9e b=%.9e c=%.9e d=%.9e e=%.9e sigma=%.4f kept %d rejected %d", head, "a", "b", "c", "d", "e", "sigma", "n", "n_rejected").alias("line"))


def search_lines(best: DataFrame, digits: int = 8) -> DataFrame:
    """A text line per orbit with a significant peak."""
    return best.select(F.format_string(f"%s: %d peaks, best %d at alpha %.{digits}f beta %.{digits}f", "ic_id", "peaks", "total", "alpha", "beta").alias("line"))


def write_linked(members: DataFrame, path: str, name: str = "detid") -> None:
    """`ic,count` and the members' names of each cluster on one CSV row."""
    rows = members.groupBy("ic_id", "centre_intid").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(F.col(name).cast("string"))), ",").alias("members"))
    rows.select("ic_id", "n", "members").write.mode("overwrite").csv(path)


def write_orbit_cells(midpoints: DataFrame, path: str) -> None:
    """gamma,gamma_dot,eta_x,eta_y with 6 decimals and a header."""
    cols = ["gamma", "gamma_dot", "eta_x", "eta_y"]
    midpoints.select(*[F.format_string("%.6f", c).alias(c) for c in cols]).write.mode("overwrite").option("header", True).csv(path)


def png(cells: DataFrame, path: str, nx: int, ny: int, flip: bool = True, most: int = 50_000_000) -> None:
    """Grey image of (ix, iy, grey) cells. The image's size, not the data's, bounds what comes to the driver."""
    if nx * ny > most:
        raise ValueError(f"an image of {nx} x {ny} pixels is too large")
    rows = [bytearray(nx) for _ in range(ny)]
    for r in cells.select("ix", "iy", "grey").filter((F.col("ix") < nx) & (F.col("iy") < ny)).toLocalIterator():
        rows[ny - 1 - r["iy"] if flip else r["iy"]][r["ix"]] = min(255, max(0, r["grey"]))

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    raw = b"".join(b"\0" + bytes(r) for r in rows)
    with open(path, "wb") as f:
        f.write(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", nx, ny, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def scatter(before: DataFrame, after: DataFrame, x: str, y: str, pixels: int) -> DataFrame:
    """(ix, iy, grey) of a picture of two sets of points in one frame: grey 255 where there are points after a refinement, 128
    where only before it. A frame without extent is one pixel wide."""
    both = before.select(F.col(x).alias("x"), F.col(y).alias("y"), F.lit(128).alias("grey")).unionByName(after.select(F.col(x).alias("x"), F.col(y).alias("y"), F.lit(255).alias("grey")))
    both = both.filter("x is not null and y is not null and not isnan(x) and not isnan(y)")
    frame = both.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    at = both.crossJoin(F.broadcast(frame))

    def pixel(c: str) -> Column:
        width = F.nullif(F.col(f"{c}1") - F.col(f"{c}0"), F.lit(0.0))
        return F.coalesce(F.least(F.floor((F.col(c) - F.col(f"{c}0")) / width * pixels), F.lit(pixels - 1)), F.lit(0)).cast("long")

    return at.select(pixel("x").alias("ix"), pixel("y").alias("iy"), "grey").groupBy("ix", "iy").agg(F.max("grey").alias("grey"))


def scatter_png(before: DataFrame, after: DataFrame, path: str, x: str = "theta_x", y: str = "theta_y", pixels: int = 512) -> None:
    png(scatter(before, after, x, y, pixels), path, pixels, pixels)
