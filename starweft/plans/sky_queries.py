"""Queries of the linker's operators over whole tables, with their SQL where it can express them.

Numbers with rounding differences between engines come out as integers of a stated unit (`q(x, digits)`).
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import healpix
from ..functions.constants import ARCSEC, MU_BARY
from ..functions.geometry import Vec, ecliptic_lonlat, equatorial_radec, in_plane, local_axes, lonlat, night, pointing, principal, principal_0, project, proper_motion, radec, to_ecliptic, to_equatorial, unproject, wrap_2pi, wrap_pi
from ..functions.timescale import utc_to_tdb
from ..operators import exposures, fits, grids, iod, linking, orbit_grid, orbit_refine, orbits, peaks, sync
from ..tables import finite, table, valid_positions
from . import linker
from . import sky_base as base
from .sky_base import REF_EPOCH

EPSILON = 3.0  # arcsec, dense grids: cells of a third of it
PIXEL = EPSILON * ARCSEC / 3  # radians, tangent-plane grids of the queries
DEPTH = 9  # pixel searches of the queries
NEAR = 3600.0  # arcsec
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def q(x: Column, digits: int) -> Column:
    return F.floor(x * float(10**digits) + 0.5).cast("long")


def Q(x: str, digits: int) -> str:
    return f"CAST(floor(({x}) * 1e{digits} + 0.5e0) AS BIGINT)"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def triple(v: Vec, digits: int) -> list[Column]:
    return [q(c, digits).alias(n) for c, n in zip((v.x, v.y, v.z), ("x", "y", "z"))]


_P = "(SELECT intid, cos(radians(ra)) * cos(radians(dec)) AS px, sin(radians(ra)) * cos(radians(dec)) AS py, sin(radians(dec)) AS pz, ra, dec, epoch FROM (" + base.VALID + "))"
_C, _S = "0.9174820620691818e0", "0.3977771559319137e0"


# ---- projections
@query(f"SELECT intid, {Q('px', 8)} AS x, {Q('py', 8)} AS y, {Q('pz', 8)} AS z FROM {_P}")
def pointing_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Unit vectors of the catalog's positions."""
    return valid_positions(table(spark, d, "detection_catalog")).select("intid", *triple(pointing(F.col("ra"), F.col("dec")), 8))


@query(f"SELECT intid, {Q('px', 8)} AS x, {Q(f'({_C} * py + {_S} * pz)', 8)} AS y, {Q(f'({_C} * pz - {_S} * py)', 8)} AS z FROM {_P}")
def ecliptic_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The same in the ecliptic plane."""
    return valid_positions(table(spark, d, "detection_catalog")).select("intid", *triple(to_ecliptic(pointing(F.col("ra"), F.col("dec"))), 8))


@query(f"SELECT intid, {Q('px', 8)} AS x, {Q('py', 8)} AS y, {Q('pz', 8)} AS z FROM {_P}")
def ecliptic_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    return valid_positions(table(spark, d, "detection_catalog")).select("intid", *triple(to_equatorial(to_ecliptic(pointing(F.col("ra"), F.col("dec")))), 8))


@query(
    f"""SELECT intid, CASE WHEN reference_plane = 'ECLIPJ2000' THEN {Q('rho_y', 8)} ELSE {Q(f'({_C} * rho_y + {_S} * rho_z)', 8)} END AS y,
    CASE WHEN reference_plane = 'ECLIPJ2000' THEN {Q('rho_z', 8)} ELSE {Q(f'({_C} * rho_z - {_S} * rho_y)', 8)} END AS z
    FROM detections WHERE rho_x IS NOT NULL AND rho_y IS NOT NULL AND rho_z IS NOT NULL AND NOT isnan(rho_x) AND NOT isnan(rho_y) AND NOT isnan(rho_z)"""
)
def in_ecliptic_plane(spark: SparkSession, d: str) -> DataFrame:
    """Stored directions brought into one plane; those already in it stay."""
    rows = table(spark, d, "detections").filter(finite(F.col("rho_x")) & finite(F.col("rho_y")) & finite(F.col("rho_z")))
    v = in_plane(Vec.of("rho"), F.col("reference_plane"), "ECLIPJ2000")
    return rows.select("intid", q(v.y, 8).alias("y"), q(v.z, 8).alias("z"))


@query(f"SELECT intid, {Q('atan2(py, px)', 7)} AS lon, {Q('asin(greatest(least(pz, 1e0), -1e0))', 7)} AS lat, {Q('radians(ra)', 7)} AS ra_back, {Q('radians(dec)', 7)} AS dec_back FROM {_P}")
def angles_of_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Longitude and latitude, and right ascension and declination, back from vectors."""
    v = pointing(F.col("ra"), F.col("dec"))
    (lon, lat), (ra, dec) = lonlat(v), radec(v)
    return valid_positions(table(spark, d, "detection_catalog")).select("intid", q(lon, 7).alias("lon"), q(lat, 7).alias("lat"), q(ra, 7).alias("ra_back"), q(dec, 7).alias("dec_back"))


_EPS = math.radians(84381.448 / 3600.0)
_CE, _SE = f"cos({_EPS!r})", f"sin({_EPS!r})"


@query(f"SELECT intid, {Q(f'atan2({_CE} * py + {_SE} * pz, px)', 7)} AS lam, {Q(f'asin({_CE} * pz - {_SE} * py)', 7)} AS beta, {Q('radians(ra)', 7)} AS ra_back, {Q('radians(dec)', 7)} AS dec_back FROM {_P}")
def ecliptic_angles(spark: SparkSession, d: str) -> DataFrame:
    """Ecliptic angles and the way back."""
    rows = valid_positions(table(spark, d, "detection_catalog"))
    lam, beta = ecliptic_lonlat(F.radians("ra"), F.radians("dec"), _EPS)
    rows = rows.select("intid", lam.alias("lam"), beta.alias("beta"))
    ra, dec = equatorial_radec(F.col("lam"), F.col("beta"), _EPS)
    return rows.select("intid", q(F.col("lam"), 7).alias("lam"), q(F.col("beta"), 7).alias("beta"), q(ra, 7).alias("ra_back"), q(dec, 7).alias("dec_back"))


_T = "(radians(ra) * 3 - 9.1234e0)"
_2PI = repr(2 * math.pi)


@query(
    f"""SELECT intid, {Q(f'({_T} - {_2PI} * floor({_T} / {_2PI}))', 7)} AS w2, {Q(f'({_T} - {_2PI} * floor({_T} / {_2PI}))', 7)} AS p2,
    {Q(f'({_T} - {_2PI} * floor({_T} / {_2PI} + 0.5e0))', 7)} AS w1, {Q(f'({_T} - {_2PI} * floor({_T} / {_2PI} + 0.5e0))', 7)} AS p1 FROM ({base.VALID})"""
)
def wrapped_angles(spark: SparkSession, d: str) -> DataFrame:
    a = F.radians("ra") * 3 - 9.1234
    return valid_positions(table(spark, d, "detection_catalog")).select("intid", q(wrap_2pi(a), 7).alias("w2"), q(principal(a), 7).alias("p2"), q(wrap_pi(a), 7).alias("w1"), q(principal_0(a), 7).alias("p1"))


@query(f"SELECT intid, {Q('sqrt(power(radians(ra) * 0.01e0, 2) * power(cos(radians(dec)), 2) + power(radians(dec) * 0.01e0, 2))', 7)} AS rate FROM ({base.VALID})")
def sky_motion(spark: SparkSession, d: str) -> DataFrame:
    """Total rate of motion for rates of a hundredth of the position per day."""
    return valid_positions(table(spark, d, "detection_catalog")).select("intid", q(proper_motion(F.radians("ra") * 0.01, F.radians("dec") * 0.01, F.radians("dec")), 7).alias("rate"))


@query(f"SELECT intid, {Q(f'(({base.TDB} - epoch) * 86400)', 2)} AS shift FROM ({base.VALID}) WHERE epoch > 2400000")
def utc_to_tdb_shift(spark: SparkSession, d: str) -> DataFrame:
    """Seconds from UTC to TDB; dates before the Julian Date 2,400,000 have no leap seconds of their own."""
    rows = valid_positions(table(spark, d, "detection_catalog")).filter("epoch > 2400000")
    return rows.select("intid", q((utc_to_tdb(F.col("epoch")) - F.col("epoch")) * 86400, 2).alias("shift"))


@query(f"SELECT intid, {Q('ux', 8)} AS x, {Q('uy', 8)} AS y, {Q('uz', 8)} AS z FROM (SELECT intid, px AS ux, py AS uy, pz AS uz FROM {_P})")
def local_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Directions in the local frame of the mean pointing, and back."""
    rows = valid_positions(table(spark, d, "detection_catalog")).select("intid", *pointing(F.col("ra"), F.col("dec")).named("rho"))
    ref = exposures.mean_pointing(rows)
    axes = local_axes(Vec.of("ref"))
    return rows.crossJoin(F.broadcast(ref)).select("intid", *triple(unproject(project(Vec.of("rho"), axes), axes), 8))


# ---- loading
@query("SELECT DISTINCT nullif(upper(trim(obscode)), '') AS obscode FROM detection_catalog WHERE nullif(trim(obscode), '') IS NOT NULL")
def distinct_obscodes(spark: SparkSession, d: str) -> DataFrame:
    code = F.nullif(F.upper(F.trim("obscode")), F.lit(""))
    return table(spark, d, "detection_catalog").select(code.alias("obscode")).filter("obscode is not null").distinct()


@query(f"SELECT intid, own_position, {Q('obs_x', 8)} AS x, {Q('obs_y', 8)} AS y, {Q('obs_z', 8)} AS z FROM ({base.OBSERVER})")
def observer_positions(spark: SparkSession, d: str) -> DataFrame:
    """Each row's observer: its own position where complete, else the ephemeris."""
    return base.observer(spark, d).select("intid", "own_position", *triple(Vec.of("obs"), 8))


# ---- exposures and the tangent plane
@query(f"{base.EXPOSED} SELECT {Q('exposure_id', 6)} AS exposure, count(*) AS n, min(intid) AS first_intid, {Q('any_value(xe0)', 8)} AS xe FROM exposed GROUP BY exposure_id")
def exposure_groups(spark: SparkSession, d: str) -> DataFrame:
    rows = exposures.exposures(base.detections(spark, d))
    return rows.groupBy("exposure_id").agg(F.count("*").alias("n"), F.min("intid").alias("first_intid"), F.first("xe0").alias("xe")).select(q(F.col("exposure_id"), 6).alias("exposure"), "n", "first_intid", q(F.col("xe"), 8).alias("xe"))


@query(f"{base.EXPOSED} SELECT {Q('ux', 8)} AS x, {Q('uy', 8)} AS y, {Q('uz', 8)} AS z FROM ref")
def mean_pointing(spark: SparkSession, d: str) -> DataFrame:
    return exposures.mean_pointing(base.detections(spark, d)).select(*triple(Vec.of("ref"), 8))


@query(f"{base.EXPOSED} SELECT intid, {Q('theta_x', 6)} AS tx, {Q('theta_y', 6)} AS ty, {Q('ze', 6)} AS ze FROM tp")
def tangent_projection(spark: SparkSession, d: str) -> DataFrame:
    p = linker.tangent_points(base.detections(spark, d), base.TANGENT_MIN_DEPTH)
    return p.select("intid", q(F.col("theta_x"), 6).alias("tx"), q(F.col("theta_y"), 6).alias("ty"), q(F.col("ze"), 6).alias("ze"))


def _tangent(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    points = linker.tangent_points(base.detections(spark, d), base.TANGENT_MIN_DEPTH)
    return points.select("intid", "exposure_id", "epoch", "xe", "ye", "ze", "theta_x", "theta_y", "mean_x", "mean_y"), base.rate_orbits(spark, d)


@query(f"{base.tangent_sync_sql()} SELECT ic_id, count(*) AS n, {Q('avg(alpha)', 6)} AS alpha, {Q('avg(beta)', 6)} AS beta FROM moved GROUP BY ic_id")
def tangent_sync(spark: SparkSession, d: str) -> DataFrame:
    points, rates = _tangent(spark, d)
    moved = sync.tangent_sync(points, rates, MU_BARY, REF_EPOCH)
    return moved.groupBy("ic_id").agg(F.count("*").alias("n"), q(F.avg("alpha"), 6).alias("alpha"), q(F.avg("beta"), 6).alias("beta"))


_GRID = f"{base.tangent_sync_sql()}, {base.grid_sql('moved', 'ic_id', 'alpha', 'beta', PIXEL)}"


@query()
def sparse_grid(spark: SparkSession, d: str) -> DataFrame:
    """Cells, points and fullest cell of each rate orbit's grid. No SQL: at the plane's edge the last bits of sine and cosine
    move points to the next cell; tested against numpy."""
    points, rates = _tangent(spark, d)
    cells, _ = linker.tangent_cells(points, rates, REF_EPOCH, PIXEL)
    return cells.groupBy("ic_id").agg(F.count("*").alias("cells"), F.sum("n").alias("points"), F.max("n").alias("fullest"))


@query()
def convolved_peaks(spark: SparkSession, d: str) -> DataFrame:
    """Local maxima of at least 3 points and their 3 x 3 sums. No SQL, as for sparse_grid."""
    return linker.tangent_peaks(*_tangent(spark, d), REF_EPOCH, PIXEL)


@query(
    f"""{_GRID}, {base.peaks_sql('cells', 3)}, sig AS (SELECT *, count(*) OVER (PARTITION BY ic_id) AS peaks, row_number() OVER (PARTITION BY ic_id ORDER BY total DESC, i, j) AS r FROM peaks WHERE total >= 12)
    SELECT ic_id, peaks, i, j, n, total, {Q(f'(i + 0.5e0) * {PIXEL!r} + u0', 6)} AS alpha, {Q(f'(j + 0.5e0) * {PIXEL!r} + v0', 6)} AS beta FROM sig JOIN lim_cells USING (ic_id) WHERE r = 1"""
)
def tangent_search(spark: SparkSession, d: str) -> DataFrame:
    """Best-supported place of every rate orbit: the whole tangent-plane search."""
    out = linker.tangent_search(*_tangent(spark, d), REF_EPOCH, PIXEL)
    return out.withColumns({"alpha": q(F.col("alpha"), 6), "beta": q(F.col("beta"), 6)})


# ---- orbits and the spherical sync
_DIST = ["r0", "r1", "r2", "r3", "f0", "f1", "f2", "f3", "g0", "g1", "g2", "g3"]


@query(f"SELECT ic_id, {Q('energy', 12)} AS energy, {Q('sin_lat', 8)} AS sin_lat, {', '.join(f'{Q(c, 6)} AS {c}' for c in _DIST)} FROM ({base.orbit_sql()})")
def orbit_table(spark: SparkSession, d: str) -> DataFrame:
    """Constants and polynomials of the trial orbits."""
    polys = {f"{c}{k}": q(F.get(F.col(f"{c}_poly"), F.lit(k)), 6) for c in "rfg" for k in range(4)}
    return base.trial_orbits(spark, d).select(F.col("id").alias("ic_id"), q(F.col("energy"), 12).alias("energy"), q(F.col("sin_lat"), 8).alias("sin_lat"), *[v.alias(k) for k, v in polys.items()])


_XS = "[-400e0, -180e0, 0e0, 90e0, 365e0]"


@query(f"SELECT ic_id, t, {Q(base.cheb_sql('r', '(t / 365.25e0)'), 6)} AS r_t, {Q(base.cheb_sql('f', '(t / 365.25e0)'), 6)} AS f_t, {Q(base.cheb_sql('g', '(t / 365.25e0)'), 6)} AS g_t, abs(t) > 365.25e0 AS beyond FROM ({base.orbit_sql()}), (SELECT unnest({_XS}) AS t)")
def orbit_at_epochs(spark: SparkSession, d: str) -> DataFrame:
    """r, f and g of the trial orbits at some epochs."""
    df = base.trial_orbits(spark, d).select("*", F.explode(F.array(*[F.lit(x) for x in (-400.0, -180.0, 0.0, 90.0, 365.0)])).alias("t"))
    at = F.col("orbit_epoch") + F.col("t")
    return df.select(F.col("id").alias("ic_id"), "t", *[q(orbits.at_epoch(f"{c}_poly", at), 6).alias(f"{c}_t") for c in "rfg"], orbits.extrapolated(at).alias("beyond"))


_SYNC = base.sync_sql()


@query(f"SELECT ic_id, count(*) AS n, {Q('avg(rho)', 6)} AS rho, {Q('avg(rt)', 6)} AS r_at FROM ({_SYNC}) GROUP BY ic_id")
def range_solution(spark: SparkSession, d: str) -> DataFrame:
    """Mean range and distance of the detections each orbit can move."""
    return sync.sync(base.detections(spark, d), base.trial_orbits(spark, d)).groupBy("ic_id").agg(F.count("*").alias("n"), q(F.avg("rho"), 6).alias("rho"), q(F.avg("r_at"), 6).alias("r_at"))


@query(f"SELECT ic_id, count(*) AS n, {Q('avg(s_x)', 6)} AS x, {Q('avg(s_y)', 6)} AS y, {Q('avg(s_z)', 6)} AS z FROM ({_SYNC}) GROUP BY ic_id")
def sphere_sync(spark: SparkSession, d: str) -> DataFrame:
    """Mean synced point of each orbit over all detections."""
    out = sync.sync(base.detections(spark, d), base.trial_orbits(spark, d))
    return out.groupBy("ic_id").agg(F.count("*").alias("n"), *[q(F.avg(f"s_{c}"), 6).alias(c) for c in "xyz"])


_DENSE = f"WITH pts AS MATERIALIZED (SELECT ic_id, intid, epoch, s_x, s_y, s_z, atan2(s_y, s_x) AS lon, asin(greatest(least(s_z, 1e0), -1e0)) AS lat FROM ({_SYNC})), {base.grid_sql('pts', 'ic_id', 'lon', 'lat', EPSILON * ARCSEC / 3)}"


@query(f"{_DENSE}, {base.peaks_sql('cells', 1)} SELECT * FROM peaks WHERE total >= 12")
def dense_search(spark: SparkSession, d: str) -> DataFrame:
    """Peaks of each orbit's longitude-latitude grid: the whole dense search."""
    return linker.dense_search(base.detections(spark, d), base.trial_orbits(spark, d), EPSILON)


@query()
def centred_dense_search(spark: SparkSession, d: str) -> DataFrame:
    """The same on grids centred on each orbit's circular mean longitude."""
    return linker.dense_search(base.detections(spark, d), base.trial_orbits(spark, d), EPSILON, centred=True)


@query(f"{_DENSE} SELECT ic_id, i, j, k, count(*) AS n FROM (SELECT ic_id, CAST(floor(lon / {600 * ARCSEC!r}) AS BIGINT) AS i, CAST(floor(lat / {600 * ARCSEC!r}) AS BIGINT) AS j, CAST(floor(epoch / 15e0) AS BIGINT) AS k FROM pts) GROUP BY ALL HAVING count(*) > 12")
def time_cube_peaks(spark: SparkSession, d: str) -> DataFrame:
    return grids.time_cube(sync.sync(base.detections(spark, d), base.trial_orbits(spark, d)), ["ic_id"], 600 * ARCSEC)


# ---- sky pixels
@query(f"SELECT intid, hpix FROM ({base.hpix_sql(15, 'px', 'py', 'pz').format(source=_P)})")
def pixel_index(spark: SparkSession, d: str) -> DataFrame:
    """Nested pixel of depth 15 of every position."""
    rows = valid_positions(table(spark, d, "detection_catalog")).select("intid", *pointing(F.col("ra"), F.col("dec")).named("rho"))
    return healpix.with_pixel(rows, 15, "rho").select("intid", "hpix")


@query(f"SELECT hpix, count(*) AS n FROM ({base.hpix_sql(DEPTH, 'px', 'py', 'pz').format(source=_P)}) GROUP BY hpix ORDER BY n DESC")
def pixel_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = valid_positions(table(spark, d, "detection_catalog")).select(*pointing(F.col("ra"), F.col("dec")).named("rho"))
    return grids.pixel_counts(rows, [], DEPTH, "rho").orderBy(F.desc("n"), "hpix")


@query(f"SELECT ic_id, count(DISTINCT hpix) AS pixels, count(*) AS points FROM ({base.hpix_sql(15, 's_x', 's_y', 's_z').format(source='(' + _SYNC + ')')}) GROUP BY ic_id")
def synced_pixels(spark: SparkSession, d: str) -> DataFrame:
    """Occupied pixels and points of each orbit."""
    counts = grids.pixel_counts(sync.sync(base.detections(spark, d), base.trial_orbits(spark, d)), ["ic_id"], 15)
    return counts.groupBy("ic_id").agg(F.count("*").alias("pixels"), F.sum("n").alias("points"))


@query()
def linked_objects(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: pixel peaks of every orbit, range search, unique sets, screening, outlier-rejecting fits."""
    return linker.hpix_linker(base.detections(spark, d), base.trial_orbits(spark, d), REF_EPOCH)


# ---- linking
_UNIT = "(SELECT intid, catalog_id, epoch, rho_x AS x, rho_y AS y, rho_z AS z FROM detections WHERE abs(sqrt(rho_x * rho_x + rho_y * rho_y + rho_z * rho_z) - 1) <= 1e-6 AND NOT isnan(rho_x) AND NOT isnan(rho_y) AND NOT isnan(rho_z) AND catalog_id IS NOT NULL)"


def _unit(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "detections").filter(finite(F.col("rho_x")) & finite(F.col("rho_y")) & finite(F.col("rho_z")) & F.col("catalog_id").isNotNull())
    return rows.filter(F.abs(Vec.of("rho").norm() - 1.0) <= 1e-6).select("intid", "catalog_id", "epoch", *[F.col(f"rho_{c}").alias(f"s_{c}") for c in "xyz"])


@query(
    f"""WITH u AS {_UNIT}, b AS (SELECT *, CAST(floor(x * 50) AS BIGINT) AS bx FROM u)
    SELECT c.cluster_id, b.intid, {Q('2e0 * asin(sqrt(power(b.x - c.ref_x, 2) + power(b.y - c.ref_y, 2) + power(b.z - c.ref_z, 2)) / 2)', 7)} AS angle
    FROM linked_clusters c, (VALUES (-1), (0), (1)) o(dx), b WHERE b.bx = CAST(floor(c.ref_x * 50) AS BIGINT) + dx
      AND power(b.x - c.ref_x, 2) + power(b.y - c.ref_y, 2) + power(b.z - c.ref_z, 2) <= 4 * power(sin({NEAR * ARCSEC / 2!r}), 2)"""
)
def range_join(spark: SparkSession, d: str) -> DataFrame:
    """Detections within a degree of each linked cluster's reference point."""
    centres = table(spark, d, "linked_clusters").select("cluster_id", *[F.col(f"ref_{c}").alias(f"c_{c}") for c in "xyz"])
    met = linking.within(centres, _unit(spark, d).drop("catalog_id"), [], NEAR)
    return met.select("cluster_id", "intid", q(2.0 * F.asin(F.sqrt("d2") / 2.0), 7).alias("angle"))


@query(
    f"""WITH u AS {_UNIT}, b AS (SELECT *, CAST(floor(x * 20000) AS BIGINT) AS bx, CAST(floor(y * 20000) AS BIGINT) AS byy FROM u)
    SELECT a.catalog_id, a.intid AS centre_intid, count(*) AS n FROM b a, (VALUES (-1), (0), (1)) o(dx), (VALUES (-1), (0), (1)) p(dy), b
    WHERE b.bx = a.bx + dx AND b.byy = a.byy + dy AND a.catalog_id = b.catalog_id AND abs(a.epoch - b.epoch) <= 15
      AND power(a.x - b.x, 2) + power(a.y - b.y, 2) + power(a.z - b.z, 2) <= 4 * power(sin({7 * ARCSEC / 2!r}), 2)
      AND acos(greatest(least(1 - (power(a.x - b.x, 2) + power(a.y - b.y, 2) + power(a.z - b.z, 2)) / 2, 1e0), -1e0)) <= abs(a.epoch - b.epoch) / 15e0 * {7 * ARCSEC!r} + {ARCSEC!r}
    GROUP BY ALL"""
)
def point_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Number of neighbours of every detection within 7 arcsec and an angle that fits their time."""
    near = linking.neighbours_of_points(_unit(spark, d).filter(finite(F.col("epoch"))), ["catalog_id"], 7.0)
    return near.groupBy("catalog_id", "centre_intid").agg(F.count("*").alias("n"))


@query()
def point_linker(spark: SparkSession, d: str) -> DataFrame:
    """Neighbourhoods of synced points that last long enough, by orbit. No SQL: too slow on whole tables."""
    return linker.point_linker(base.detections(spark, d), base.trial_orbits(spark, d))


_SETS = "(SELECT cluster_id, ic_id, list_sort(list_distinct(list_filter(local_intids, lambda x: x IS NOT NULL))) AS s FROM linked_clusters)"


@query(f"SELECT ic_id, min(cluster_id) AS cluster_id FROM {_SETS} WHERE len(s) > 0 GROUP BY ic_id, s")
def unique_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Of an orbit's clusters with the same members, the first."""
    m = table(spark, d, "linked_clusters").select("ic_id", "cluster_id", F.explode("local_intids").alias("intid")).distinct()
    return linking.unique_sets(m, ["ic_id"], "cluster_id", [F.lit(0)])


@query(f"SELECT a.cluster_id, b.cluster_id AS larger FROM {_SETS} a, {_SETS} b WHERE len(a.s) > 0 AND len(a.s) < len(b.s) AND list_has_all(b.s, a.s)")
def contained_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Clusters that are a proper subset of another one."""
    m = table(spark, d, "linked_clusters").select("cluster_id", F.explode("local_intids").alias("member"))
    return linking.contained_sets(m, "cluster_id")


@query(f"SELECT cluster_id, min(cluster_id) OVER (PARTITION BY s) AS same_as FROM {_SETS} WHERE len(s) > 0")
def equal_clusters(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "linked_clusters").select("cluster_id", F.explode("local_intids").alias("member"))
    return linking.equal_sets(m, "cluster_id")


_NIGHT = "sign(epoch - ref_epoch) * floor(abs(epoch - ref_epoch) + 0.5e0)"


@query(f"SELECT cluster_id, count(*) AS n, count(DISTINCT {_NIGHT}) AS nights, count(DISTINCT epoch - ref_epoch) AS times FROM ({base.MEMBERS}) WHERE abs(epoch - ref_epoch) <= 4000 GROUP BY cluster_id")
def unique_nights(spark: SparkSession, d: str) -> DataFrame:
    """Members, distinct nights and distinct times of each cluster."""
    m = base.members(spark, d).withColumn("dt", F.col("epoch") - F.col("ref_epoch")).filter("abs(dt) <= 4000")
    return m.groupBy("cluster_id").agg(F.count("*").alias("n"), F.count_distinct(night(F.col("dt"))).alias("nights"), F.count_distinct("dt").alias("times"))


@query(
    f"""WITH m AS ({base.MEMBERS}), k AS (SELECT cluster_id FROM m WHERE abs(epoch - {REF_EPOCH}e0) <= 4000 GROUP BY 1
      HAVING count(DISTINCT epoch - {REF_EPOCH}e0) >= 6 AND count(DISTINCT sign(epoch - {REF_EPOCH}e0) * floor(abs(epoch - {REF_EPOCH}e0) + 0.5e0)) >= 3)
    SELECT cluster_id, intid FROM m WHERE cluster_id IN (SELECT cluster_id FROM k)"""
)
def cluster_cull(spark: SparkSession, d: str) -> DataFrame:
    """Members of the clusters with 6 distinct times on 3 distinct nights."""
    return linking.cull(base.members(spark, d), ["cluster_id"], REF_EPOCH, min_times=6, min_nights=3).select("cluster_id", "intid")


@query(
    f"""SELECT cluster_id, count(*) AS n, {Q('max(epoch) - min(epoch)', 6)} AS duration, count(DISTINCT round(epoch)) AS nights FROM ({base.MEMBERS})
    GROUP BY cluster_id HAVING count(*) >= 8 AND max(epoch) - min(epoch) >= 20 AND count(DISTINCT round(epoch)) >= 4"""
)
def lasting_clusters(spark: SparkSession, d: str) -> DataFrame:
    out = linking.duration_screen(base.members(spark, d), ["cluster_id"], 8, 20.0, 4)
    return out.withColumn("duration", q(F.col("duration"), 6))


@query("SELECT ic_id, string_agg(CAST(cluster_id AS VARCHAR), ',' ORDER BY cluster_id) AS clusters, count(*) AS n FROM linked_clusters GROUP BY ic_id")
def clusters_by_orbit(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of each orbit as a list, as written to text."""
    t = table(spark, d, "linked_clusters").groupBy("ic_id").agg(F.array_sort(F.collect_list("cluster_id")).alias("c"), F.count("*").alias("n"))
    return t.select("ic_id", F.array_join(F.transform("c", lambda x: x.cast("string")), ",").alias("clusters"), "n")


# ---- fits
def _fit_rows(spark: SparkSession, d: str) -> DataFrame:
    m = base.members(spark, d).filter(finite(F.col("s_x")) & finite(F.col("s_y")) & finite(F.col("s_z")))
    return fits.fit_rows(linking.cluster_plane(m.withColumn("dt", F.col("epoch") - F.col("ref_epoch"))))


@query()
def rejecting_fits(spark: SparkSession, d: str) -> DataFrame:
    """Fits that drop the worst outlier at a time."""
    return fits.rejecting_fits(_fit_rows(spark, d), ["cluster_id"], threshold=5.0, min_kept=6, min_nights=3)


@query()
def fraction_rejecting_fits(spark: SparkSession, d: str) -> DataFrame:
    """Fits that drop a tenth of the members at a time."""
    return fits.rejecting_fits(_fit_rows(spark, d), ["cluster_id"], threshold=5.0, min_kept=6, fraction=0.1)


@query(
    f"""SELECT cluster_id, count(*) AS n, {Q('regr_slope(rho_x, epoch - 2460960.5e0)', 9)} AS x_1, {Q('regr_slope(rho_y, epoch - 2460960.5e0)', 9)} AS y_1, {Q('regr_intercept(rho_x, epoch - 2460960.5e0)', 7)} AS x_0
    FROM ({base.MEMBERS}) GROUP BY cluster_id HAVING max(epoch) > min(epoch)"""
)
def line_fits(spark: SparkSession, d: str) -> DataFrame:
    """Straight lines of the direction on time."""
    m = base.members(spark, d).withColumn("t", F.col("epoch") - REF_EPOCH)
    out = fits.line_fit(m, ["cluster_id"], "t", ["rho_x", "rho_y"])
    return out.select("cluster_id", "n", q(F.col("rho_x_1"), 9).alias("x_1"), q(F.col("rho_y_1"), 9).alias("y_1"), q(F.col("rho_x_0"), 7).alias("x_0"))


@query()
def refined_orbits(spark: SparkSession, d: str) -> DataFrame:
    """Each cluster's orbit moved to where its detections lie closest together, searched to the tolerance."""
    o = table(spark, d, "trial_orbits").select(F.col("id").alias("ic_id"), "r", "vr", "vo", "inc", "kappa")
    m = base.members(spark, d).join(table(spark, d, "linked_clusters").select("cluster_id", "ic_id"), "cluster_id").join(o, "ic_id")
    return orbit_refine.optimise(m, ["cluster_id"], REF_EPOCH)


@query()
def gauss_orbits(spark: SparkSession, d: str) -> DataFrame:
    """Orbits from the first, middle and last member of each cluster, one per root."""
    return iod.gauss(base.members(spark, d), ["cluster_id"], 1.5)


# ---- images
_HIT = f"WITH v AS (SELECT atan2(py, px) AS ra, atan2(pz, sqrt(px * px + py * py)) AS dec FROM {_P}), c AS (SELECT atan2(sum(sin(ra)), sum(cos(ra))) AS c FROM v)"
_DX = f"(CASE WHEN w > {math.pi!r} THEN w - {_2PI} ELSE w END)"


@query(f"{_HIT} SELECT {Q(f'(CASE WHEN c < 0 THEN c + {_2PI} ELSE c END)', 7)} AS mean_angle FROM c")
def mean_right_ascension(spark: SparkSession, d: str) -> DataFrame:
    rows = valid_positions(table(spark, d, "detection_catalog")).select(F.radians("ra").alias("ra"))
    return grids.circular_mean(rows, [], "ra").select(q(F.col("mean_angle"), 7).alias("mean_angle"))


@query(
    f"""{_HIT}, w AS (SELECT ((ra - c) - {_2PI} * floor((ra - c) / {_2PI})) AS w, dec FROM v, c), x AS (SELECT {_DX} AS dx, dec FROM w),
    f AS (SELECT min(dx) AS d0, min(dec) AS e0, greatest(ceil((max(dx) - min(dx)) / 0.0123e0), 1) AS nx, greatest(ceil((max(dec) - min(dec)) / 0.0123e0), 1) AS ny FROM x)
    SELECT CAST(floor((dx - d0) / 0.0123e0) AS BIGINT) AS ix, CAST(floor((dec - e0) / 0.0123e0) AS BIGINT) AS iy, count(*) AS n FROM x, f
    WHERE floor((dx - d0) / 0.0123e0) < nx AND floor((dec - e0) / 0.0123e0) < ny GROUP BY ALL"""
)
def hit_grid(spark: SparkSession, d: str) -> DataFrame:
    """Image of all positions around their mean right ascension."""
    rows = valid_positions(table(spark, d, "detection_catalog")).select(*pointing(F.col("ra"), F.col("dec")).named("rho"))
    return grids.hit_grid(rows, 0.0123)[0]


# ---- grids of orbits
_TOP = f"sqrt(2e0 * {MU_BARY!r} / (r * r * r))"
_STEP = repr(3.0 * 2e-5 / 30.0)


@query(
    f"""SELECT id, count(*) AS n, {Q('sum(adot * adot)', 6)} AS spread FROM (SELECT id, top, i * {_STEP} - top AS adot, j * {_STEP} - top AS bdot FROM
      (SELECT id, top, unnest(range(0, CAST(2 * ceil(top / {_STEP}) AS BIGINT) + 1)) AS i, steps FROM (SELECT id, {_TOP} AS top, CAST(2 * ceil({_TOP} / {_STEP}) AS BIGINT) AS steps FROM trial_orbits)) a,
      LATERAL (SELECT unnest(range(0, a.steps + 1)) AS j)) WHERE sqrt(adot * adot + bdot * bdot) <= top GROUP BY id"""
)
def rate_grid(spark: SparkSession, d: str) -> DataFrame:
    """Number and spread of the rates of bound motion at each trial orbit's distance."""
    g = orbit_grid.rate_grid(table(spark, d, "trial_orbits"), 2e-5, 30.0)
    return g.groupBy("id").agg(F.count("*").alias("n"), q(F.sum(F.col("adot") * F.col("adot")), 6).alias("spread"))


@query()
def orbit_cells(spark: SparkSession, d: str) -> DataFrame:
    """Cells of orbit space, bisected until neighbours move alike within 60 arcsec (25 million of them), counted by octave of
    gamma with the mean of their middles; the range follows the trial orbits' distances."""
    edge = table(spark, d, "trial_orbits").agg(F.min("r").alias("lo"), F.max("r").alias("hi")).first()
    g = orbit_grid.halve_gamma(spark, edge["lo"], edge["hi"])
    top = F.sqrt(2 * MU_BARY * F.pow("gamma_hi", 3))
    cells = g.select("gamma_lo", "gamma_hi", (-top * 0.5).alias("gamma_dot_lo"), (top * 0.5).alias("gamma_dot_hi"), (-top).alias("eta_x_lo"), top.alias("eta_x_hi"), (-top).alias("eta_y_lo"), top.alias("eta_y_hi"))
    middles = orbit_grid.midpoints(orbit_grid.bound_cells(orbit_grid.refine(cells, 13.0, 60.0)))
    return middles.groupBy(F.floor(F.log2("gamma")).cast("int").alias("octave")).agg(F.count("*").alias("cells"), *[F.avg(c).alias(f"mean_{c}") for c in orbit_grid.AXES])


