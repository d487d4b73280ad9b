"""Counts of points in grid cells or sky pixels, always as sparse tables. Counting is combined before the shuffle; a cell
that most points fall into is one row per task by then. Null coordinates take no part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import healpix
from ..functions.geometry import Vec, lonlat, wrap_2pi, wrap_pi


def extents(points: DataFrame, keys: list[str], u: str, v: str) -> DataFrame:
    return points.groupBy(*keys).agg(F.min(u).alias("u_min"), F.max(u).alias("u_max"), F.min(v).alias("v_min"), F.max(v).alias("v_max"))


def placed(points: DataFrame, keys: list[str], u: str, v: str, scale: float, bounds: DataFrame | None = None, keep: list[str] | None = None) -> DataFrame:
    """(keys, keep, i, j): index of each point's cell of side `scale`, from the smallest coordinates of each key; points at the
    very end of an exact multiple go to the last cell. `bounds`: the extents, if they are known without the points."""
    points = points.filter(F.col(u).isNotNull() & F.col(v).isNotNull() & ~F.isnan(u) & ~F.isnan(v))
    keep = keep or []
    bounds = extents(points, keys, u, v) if bounds is None else bounds
    # one row per key (an orbit or an image): few next to the points, and left to the optimiser's size check
    df = points.select(*keys, *keep, u, v).join(bounds, keys) if keys else points.select(*keep, u, v).crossJoin(bounds)

    def index(c: str, low: str, high: str) -> Column:
        bins = F.greatest(F.ceil((F.col(high) - F.col(low)) * (1.0 / scale)), F.lit(1))
        # declared free of nulls, else a join on the cells would push null checks into the points' expressions
        return F.coalesce(F.least(F.floor((F.col(c) - F.col(low)) * (1.0 / scale)), bins - 1).cast("long"), F.lit(-1))

    return df.select(*keys, *keep, index(u, "u_min", "u_max").alias("i"), index(v, "v_min", "v_max").alias("j"))


def grid(points: DataFrame, keys: list[str], u: str, v: str, scale: float, bounds: DataFrame | None = None) -> DataFrame:
    """(keys, i, j, n): points per cell."""
    return placed(points, keys, u, v, scale, bounds).groupBy(*keys, "i", "j").agg(F.count("*").alias("n"))


def cell_members(points: DataFrame, keys: list[str], u: str, v: str, scale: float, min_count: int = 1, member: str = "intid") -> DataFrame:
    """(keys, i, j, n, member): one row per point of the cells with at least `min_count` points; a cell that holds most points
    is never one row."""
    at = placed(points, keys, u, v, scale, keep=[member])
    full = at.groupBy(*keys, "i", "j").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)
    return at.join(full, [*keys, "i", "j"]).select(*keys, "i", "j", "n", member)


def cells_holding(cells: DataFrame, frame: DataFrame, places: DataFrame, scale: float) -> DataFrame:
    """places (ra, dec in radians) with the image cell ix, iy they fall into and its count n, 0 for an empty cell; places
    outside of the image are dropped."""
    df = places.crossJoin(F.broadcast(frame))
    df = df.withColumns({"ix": F.floor((wrap_pi(F.col("ra") - F.col("ra_centre")) - F.col("dx_min")) / scale).cast("long"), "iy": F.floor((F.col("dec") - F.col("dec_min")) / scale).cast("long")})
    df = df.filter("ix >= 0 and iy >= 0 and ix < nx and iy < ny").select(*places.columns, "ix", "iy")
    return df.join(cells.select("ix", "iy", "n"), ["ix", "iy"], "left").select(*places.columns, "ix", "iy", F.coalesce("n", F.lit(0)).alias("n"))


def sky_grid(points: DataFrame, keys: list[str], scale: float, prefix: str = "s") -> DataFrame:
    """grid over longitude in (-pi, pi] and latitude."""
    lon, lat = lonlat(Vec.of(prefix))
    return grid(points.select(*keys, lon.alias("lon"), lat.alias("lat")), keys, "lon", "lat", scale)


def centred_grid(points: DataFrame, keys: list[str], scale: float, prefix: str = "s") -> DataFrame:
    """sky_grid with longitudes counted from each key's circular mean, so that a cluster at +-pi stays whole."""
    lon, lat = lonlat(Vec.of(prefix))
    df = points.select(*keys, lon.alias("lon"), lat.alias("lat"))
    mean = circular_mean(df, keys, "lon")
    df = df.join(mean, keys) if keys else df.crossJoin(mean)
    return grid(df.select(*keys, wrap_pi(F.col("lon") - F.col("mean_angle")).alias("lon"), "lat"), keys, "lon", "lat", scale)


def circular_mean(points: DataFrame, keys: list[str], angle: str) -> DataFrame:
    return points.groupBy(*keys).agg(wrap_2pi(F.atan2(F.sum(F.sin(angle)), F.sum(F.cos(angle)))).alias("mean_angle"))


def time_cube(points: DataFrame, keys: list[str], scale: float, days: float = 15.0, min_count: int = 13) -> DataFrame:
    """(keys, i, j, k, n): cells of longitude, latitude and epoch with at least `min_count` points."""
    lon, lat = lonlat(Vec.of("s"))
    df = points.select(*keys, F.floor(lon / scale).cast("long").alias("i"), F.floor(lat / scale).cast("long").alias("j"), F.floor(F.col("epoch") / days).cast("long").alias("k"))
    return df.groupBy(*keys, "i", "j", "k").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)


def pixel_counts(points: DataFrame, keys: list[str], depth: int, prefix: str = "s") -> DataFrame:
    """(keys, hpix, n)"""
    at = healpix.with_pixel(points.select(*keys, *[f"{prefix}_{c}" for c in "xyz"]), depth, prefix)
    return at.groupBy(*keys, "hpix").agg(F.count("*").alias("n"))


def hit_grid(points: DataFrame, scale: float, prefix: str = "rho") -> tuple[DataFrame, DataFrame]:
    """(cells, frame): an image of points around their mean right ascension. cells: (ix, iy, n); frame: one row with
    ra_centre, dx_min, dec_min, nx, ny. Points are placed by floor and dropped if outside; a single column or row of points
    makes an image one pixel wide."""
    v = Vec.of(prefix)
    df = points.select(F.atan2(v.y, v.x).alias("ra"), F.atan2(v.z, F.hypot(v.x, v.y)).alias("dec")).filter("ra is not null and dec is not null")
    centre = circular_mean(df, [], "ra")
    df = df.crossJoin(centre).select(wrap_pi(F.col("ra") - F.col("mean_angle")).alias("dx"), "dec", "mean_angle")
    frame = df.agg(F.first("mean_angle").alias("ra_centre"), F.min("dx").alias("dx_min"), F.max("dx").alias("dx_max"), F.min("dec").alias("dec_min"), F.max("dec").alias("dec_max"))
    frame = frame.filter("dx_min is not null").select(
        "ra_centre", "dx_min", "dec_min",
        F.greatest(F.ceil((F.col("dx_max") - F.col("dx_min")) / scale), F.lit(1)).cast("long").alias("nx"),
        F.greatest(F.ceil((F.col("dec_max") - F.col("dec_min")) / scale), F.lit(1)).cast("long").alias("ny"),
    )
    at = df.select("dx", "dec").crossJoin(F.broadcast(frame)).select(F.floor((F.col("dx") - F.col("dx_min")) / scale).cast("long").alias("ix"), F.floor((F.col("dec") - F.col("dec_min")) / scale).cast("long").alias("iy"), "nx", "ny")
    return at.filter("ix < nx and iy < ny").groupBy("ix", "iy").agg(F.count("*").alias("n")), frame


def pixel_radec(cells: DataFrame, frame: DataFrame, scale: float) -> DataFrame:
    """Right ascension in [0, 2 pi) and declination of the centres of an image's cells; cells outside of it are dropped."""
    df = cells.crossJoin(F.broadcast(frame)).filter("ix >= 0 and iy >= 0 and ix < nx and iy < ny")
    return df.select(*cells.columns, wrap_2pi(F.col("ra_centre") + F.col("dx_min") + (F.col("ix") + 0.5) * scale).alias("ra"), (F.col("dec_min") + (F.col("iy") + 0.5) * scale).alias("dec"))


def intensity(cells: DataFrame, stretch: str = "log") -> DataFrame:
    """Grey value 0 to 255 of each cell: count / 10 clipped ('linear'), or log1p against the fullest cell ('log')."""
    if stretch == "linear":
        return cells.select("*", F.least(F.floor(F.col("n") / 10.0 * 255.0), F.lit(255)).cast("int").alias("grey"))
    top = cells.agg(F.max("n").alias("n_max"))
    return cells.crossJoin(F.broadcast(top)).select(*cells.columns, F.round(F.log1p(F.col("n").cast("double")) / F.log1p(F.col("n_max").cast("double")) * 255.0).cast("int").alias("grey"))
