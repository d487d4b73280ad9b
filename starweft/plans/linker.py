"""The engine's whole searches: from detections and trial orbits to candidate objects.

Synced points (detections x orbits) are never staged: the second use recomputes them in generated code, which is cheaper than
writing the product. Results of different orbits stay apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import healpix
from ..functions.constants import ARCSEC, CLUSTER_ARCSEC, HPIX_DEPTH, MAX_DT, MIN_CELL, MIN_NIGHTS, MIN_UNIQUE_TIMES, MU_BARY
from ..operators import exposures, fits, grids, linking, passes, peaks, sync
from ..staging import Stage, small


def candidates(detections: DataFrame, orbits: DataFrame, depth: int = HPIX_DEPTH, min_points: int = MIN_UNIQUE_TIMES) -> DataFrame:
    """(ic_id, hpix, total): pixels whose sum with their ring is a local maximum of at least min_points."""
    points = sync.sync(detections, orbits).select("ic_id", "s_x", "s_y", "s_z")
    counts = grids.pixel_counts(points, ["ic_id"], depth)
    return peaks.pixel_peaks(peaks.neighbour_sums(counts, ["ic_id"], depth), ["ic_id"], depth, min_points)


def clusters(
    detections: DataFrame, orbits: DataFrame, ref_epoch: float, depth: int = HPIX_DEPTH, arcsec: float = CLUSTER_ARCSEC, min_points: int = MIN_UNIQUE_TIMES, min_times: int = MIN_UNIQUE_TIMES, min_nights: int = MIN_NIGHTS, max_dt: float = MAX_DT
) -> DataFrame:
    """Members of the clusters around the peaks, each distinct set once (the one of the fuller, then lower pixel), screened, in
    tangent-plane coordinates. Up to half of passes.PASS_ROWS detections an orbit's points are searched in a task, without a shuffle."""
    keep = ["intid", "epoch", *[f"obs_{c}" for c in "xyz"]] + [c for c in ("ast_ucty", "detid", "obscode", "mag") if c in detections.columns]
    path, n = passes.stage(detections.withColumn("row", F.monotonically_increasing_id()), ["row", *keep[5:]])
    if n <= passes.PASS_ROWS // 2:  # twice the columns
        members = Stage(detections.sparkSession, "members").write(passes.clusters(path, n, orbits, ref_epoch, depth, arcsec, min_points, min_times, min_nights, max_dt, True))
        return linking.cluster_plane(members.join(detections.sparkSession.read.parquet(path).select("row", *keep), "row").drop("row"))
    found, n = Stage(detections.sparkSession, "candidates").write_counted(candidates(detections, orbits, depth, min_points))
    centres = found.withColumn("c", healpix.centre(depth)("hpix")).select("ic_id", "hpix", "total", *[F.col(f"c.{c}").alias(f"c_{c}") for c in "xyz"])
    keep = ["intid", "epoch", "ic_id", "s_x", "s_y", "s_z", "obs_x", "obs_y", "obs_z"] + [c for c in ("ast_ucty", "detid", "obscode", "mag") if c in detections.columns]
    points = sync.sync(detections, orbits).select(*keep)
    members = linking.within(centres, points, ["ic_id"], arcsec, n)
    kept = linking.unique_sets(members, ["ic_id"], "hpix", [F.col("total") * -1])
    members = members.join(kept, ["ic_id", "hpix"], "left_semi")
    return linking.cluster_plane(linking.cull(members, ["ic_id", "hpix"], ref_epoch, max_dt, min_times, min_nights, min_points))


def cluster_sums(detections: DataFrame, orbits: DataFrame, ref_epoch: float, depth: int, arcsec: float) -> DataFrame:
    """(ic_id, hpix, n, members): number and sum of the ids of each cluster's members."""
    path, n = passes.stage(detections.withColumn("row", F.monotonically_increasing_id()), ["row"])
    if n <= passes.PASS_ROWS // 2:
        return passes.clusters(path, n, orbits, ref_epoch, depth, arcsec, MIN_UNIQUE_TIMES, MIN_UNIQUE_TIMES, MIN_NIGHTS, MAX_DT, False)
    return clusters(detections, orbits, ref_epoch, depth, arcsec).groupBy("ic_id", "hpix").agg(F.count("*").alias("n"), F.sum("intid").alias("members"))


def hpix_linker(detections: DataFrame, orbits: DataFrame, ref_epoch: float, **options) -> DataFrame:
    """One row per cluster whose outlier-rejecting fit succeeds."""
    rows = clusters(detections, orbits, ref_epoch, **options)
    if "ast_ucty" not in rows.columns:
        rows = rows.withColumn("ast_ucty", F.lit(None).cast("double"))
    return fits.rejecting_fits(fits.fit_rows(rows), ["ic_id", "hpix"], min_kept=options.get("min_points", MIN_UNIQUE_TIMES), min_nights=options.get("min_nights", MIN_NIGHTS))


def tangent_points(detections: DataFrame, min_depth: float = 0.0) -> DataFrame:
    """Detections on the tangent plane of their mean direction; staged, since every orbit goes over them several times."""
    exposed = exposures.exposures(detections)
    return Stage(detections.sparkSession, "tangent").write(exposures.tangent_plane(exposed, exposures.mean_pointing(detections), min_depth))


def tangent_cells(points: DataFrame, rate_orbits: DataFrame, ref_epoch: float, pixel: float, mu: float = MU_BARY) -> tuple[DataFrame, DataFrame]:
    """(counts of each rate orbit's grid, its extents). The product of points and orbits is worked out once: the extents come
    from one row per exposure."""
    low = Stage(points.sparkSession, "extents").write(sync.tangent_extents(points, rate_orbits, mu, ref_epoch))
    moved = sync.tangent_sync(points, rate_orbits, mu, ref_epoch)
    return grids.grid(moved, ["ic_id"], "alpha", "beta", pixel, low), low


def tangent_peaks(points: DataFrame, rate_orbits: DataFrame, ref_epoch: float, pixel: float, mu: float = MU_BARY, min_count: int = MIN_CELL) -> DataFrame:
    """(ic_id, i, j, n, total): peaks of each rate orbit's grid."""
    return peaks.grid_peaks(tangent_cells(points, rate_orbits, ref_epoch, pixel, mu)[0], ["ic_id"], min_count)


def tangent_search(points: DataFrame, rate_orbits: DataFrame, ref_epoch: float, pixel: float, mu: float = MU_BARY, threshold: int = MIN_UNIQUE_TIMES) -> DataFrame:
    """(ic_id, peaks, i, j, n, total, alpha, beta): number of significant peaks of each orbit that has one, and its best."""
    cells, low = tangent_cells(points, rate_orbits, ref_epoch, pixel, mu)
    # few rows, used twice
    found = Stage(points.sparkSession, "peaks").write(peaks.grid_peaks(cells, ["ic_id"], MIN_CELL).filter(F.col("total") >= threshold))
    best = peaks.top_peak(found, ["ic_id"]).join(found.groupBy("ic_id").agg(F.count("*").alias("peaks")), "ic_id")
    return best.join(low, "ic_id").select("ic_id", "peaks", "i", "j", "n", "total", ((F.col("i") + 0.5) * pixel + F.col("u_min")).alias("alpha"), ((F.col("j") + 0.5) * pixel + F.col("v_min")).alias("beta"))


def dense_search(detections: DataFrame, orbits: DataFrame, epsilon_arcsec: float = 3.0, threshold: int = MIN_UNIQUE_TIMES, centred: bool = False) -> DataFrame:
    """(ic_id, i, j, n, total): peaks of at least `threshold` of each orbit's longitude-latitude grid with cells of a third of
    epsilon. Up to passes.PASS_ROWS detections an orbit's points are counted in a task, without a shuffle."""
    path, n = passes.stage(detections)
    if n <= passes.PASS_ROWS:
        return passes.dense_peaks(path, n, orbits, epsilon_arcsec * ARCSEC / 3.0, threshold, centred)
    points = sync.sync(detections, orbits)
    cells = (grids.centred_grid if centred else grids.sky_grid)(points, ["ic_id"], epsilon_arcsec * ARCSEC / 3.0)
    # no neighbour of a peak exceeds it, so its sum is at most nine times its own count
    return peaks.grid_peaks(cells, ["ic_id"], max(1, -(-threshold // 9))).filter(F.col("total") >= threshold)


def synced_counts(detections: DataFrame, orbits: DataFrame) -> DataFrame:
    """(ic_id, n): how many detections each orbit can move."""
    return sync.sync(detections, orbits).groupBy("ic_id").agg(F.count("*").alias("n"))


def point_linker(detections: DataFrame, orbits: DataFrame, arcsec: float = CLUSTER_ARCSEC, min_detections: int = 8, min_duration: float = 20.0, min_nights: int = 6) -> DataFrame:
    """Members (ic_id, centre_intid, intid) of the distinct neighbourhoods of points that last long enough. Up to half of
    passes.PASS_ROWS detections with an id each an orbit's points are searched in a task, without a shuffle."""
    path, n = numbered(detections)
    if path:
        return passes.neighbourhoods(path, n, orbits, arcsec, 15.0, min_detections, min_duration, min_nights, True)
    stage = Stage(detections.sparkSession, "point-linker")
    points = sync.sync(detections, orbits).select("ic_id", "intid", "epoch", "s_x", "s_y", "s_z")
    screened = linking.duration_screen(linking.neighbours_of_points(points, ["ic_id"], arcsec), ["ic_id", "centre_intid"], min_detections, min_duration, min_nights)
    enough, n = stage.write_counted(screened.select("ic_id", "centre_intid"))
    # only centres that passed are searched again
    near = stage.write(linking.neighbours_of_points(points, ["ic_id"], arcsec, only=small(enough, n), n_centres=n))
    first = linking.unique_sets(near, ["ic_id"], "centre_intid", [F.lit(0)])
    return near.join(first, ["ic_id", "centre_intid"], "left_semi").select("ic_id", "centre_intid", "intid", "angle", "dt")


def point_sums(detections: DataFrame, orbits: DataFrame, arcsec: float, min_detections: int, min_duration: float, min_nights: int) -> DataFrame:
    """(ic_id, centre_intid, n, members): number and sum of the ids of each neighbourhood that point_linker finds."""
    path, n = numbered(detections)
    if path:
        path, n = passes.stage_distinct(detections.sparkSession, path)  # equal detections have equal neighbourhoods
        return passes.neighbourhoods(path, n, orbits, arcsec, 15.0, min_detections, min_duration, min_nights, False)
    found = point_linker(detections, orbits, arcsec, min_detections, min_duration, min_nights)
    return found.groupBy("ic_id", "centre_intid").agg(F.count("*").alias("n"), F.sum("intid").alias("members"))


def numbered(detections: DataFrame) -> tuple[str | None, int]:
    """passes.stage; None for the path if there are too many detections for neighbourhoods, or an id is missing or repeated."""
    path, n = passes.stage(detections)
    ids = detections.sparkSession.read.parquet(path).select("intid")
    return (path if n <= passes.PASS_ROWS // 2 and ids.filter("intid is not null").distinct().count() == n else None), n
