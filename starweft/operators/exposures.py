"""Detections grouped into exposures and put on the tangent plane of their mean direction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import Vec, local_axes, project

WITHIN_DAYS = 1e-6


def exposures(detections: DataFrame, within: float = WITHIN_DAYS, by_obscode: bool = False) -> DataFrame:
    """detections with `exposure_id` (the epoch of the exposure's first row) and that row's observer position xe, ye, ze.

    An exposure takes what lies less than `within` after its first epoch; it is not chained on. Distinct epochs are cut into
    islands at gaps of `within` (always a new exposure), and only inside an island, nearly always a single epoch, the anchors
    are folded in order. Islands are found per coarse time bin with the last epoch of the bin before, so no window runs over
    all rows. Null epochs take no part.
    """
    key = ["obscode"] if by_obscode else []
    times = detections.filter(F.col("epoch").isNotNull() & ~F.isnan("epoch")).select(*key, "epoch").distinct()
    bin_of = F.floor("epoch").cast("long")
    times = times.withColumn("bin", bin_of)
    # a gap of a bin's border is decided by the last epoch of the latest bin before: one row per bin
    last = times.groupBy(*key, "bin").agg(F.max("epoch").alias("last"))
    over_bins = Window.partitionBy(*key).orderBy("bin") if key else Window.orderBy("bin")
    last = last.select(*key, "bin", F.lag("last").over(over_bins).alias("before"))
    times = times.join(last, [*key, "bin"])
    in_bin = Window.partitionBy(*key, "bin").orderBy("epoch")
    previous = F.coalesce(F.lag("epoch").over(in_bin), F.col("before"))
    fresh = previous.isNull() | (F.col("epoch") - previous >= within)
    marked = times.select(*key, "epoch", "bin", F.when(fresh, F.col("epoch")).alias("start"))
    # the island's first epoch; an island that runs over a bin's border looks back into the bin before
    island = F.last("start", ignorenulls=True).over(in_bin)
    marked = marked.select(*key, "epoch", "bin", island.alias("island"))
    ends = marked.groupBy(*key, "bin").agg(F.max("island").alias("last_island")).select(*key, "bin", F.last("last_island", ignorenulls=True).over(over_bins.rowsBetween(Window.unboundedPreceding, -1)).alias("open"))
    islands = marked.join(ends, [*key, "bin"]).select(*key, "epoch", F.coalesce("island", "open").alias("island"))

    def step(acc, e):
        opened = acc["anchor"].isNull() | (e - acc["anchor"] >= within)
        anchor = F.when(opened, e).otherwise(acc["anchor"])
        return F.struct(anchor.alias("anchor"), F.concat(acc["out"], F.array(F.struct(e.alias("epoch"), anchor.alias("exposure_id")))).alias("out"))

    start = F.struct(F.lit(None).cast("double").alias("anchor"), F.array().cast("array<struct<epoch:double,exposure_id:double>>").alias("out"))
    folded = islands.groupBy(*key, "island").agg(F.array_sort(F.collect_list("epoch")).alias("times"))
    anchors = folded.select(*key, F.explode(F.aggregate("times", start, step)["out"]).alias("a")).select(*key, F.col("a.epoch").alias("epoch"), F.col("a.exposure_id").alias("exposure_id"))
    tagged = detections.join(anchors, [*key, "epoch"])
    first = tagged.groupBy(*key, "exposure_id").agg(F.min(F.struct("epoch", "intid", "obs_x", "obs_y", "obs_z")).alias("f"))
    first = first.select(*key, "exposure_id", F.col("f.obs_x").alias("xe0"), F.col("f.obs_y").alias("ye0"), F.col("f.obs_z").alias("ze0"))
    return tagged.join(first, [*key, "exposure_id"])


def mean_pointing(detections: DataFrame) -> DataFrame:
    """One row (ref_x, ref_y, ref_z): the normalised mean direction; none if there are no directions or they cancel out."""
    sums = detections.agg(*[F.sum(f"rho_{c}").alias(f"m_{c}") for c in "xyz"])
    n = Vec.of("m").norm()
    return sums.select(*[(F.col(f"m_{c}") / F.nullif(n, F.lit(0.0))).alias(f"ref_{c}") for c in "xyz"]).filter("ref_x is not null")


def tangent_plane(exposed: DataFrame, reference: DataFrame, min_depth: float = 0.0) -> DataFrame:
    """theta_x, theta_y and the exposure's observer xe, ye, ze in local coordinates, with the exposure's mean theta.

    Directions on or behind the plane (radial part not above `min_depth`) have no image and are dropped.
    """
    df = exposed.crossJoin(F.broadcast(reference))
    axes = local_axes(Vec.of("ref"))
    p = project(Vec.of("rho"), axes)
    o = project(Vec(F.col("xe0"), F.col("ye0"), F.col("ze0")), axes)
    df = df.select(*[c for c in exposed.columns if c not in ("xe0", "ye0", "ze0")], p.x.alias("px"), p.y.alias("py"), p.z.alias("pz"), o.x.alias("xe"), o.y.alias("ye"), o.z.alias("ze"))
    df = df.filter(F.col("pz") > min_depth).select(*[c for c in df.columns if c not in ("px", "py", "pz")], (F.col("px") / F.col("pz")).alias("theta_x"), (F.col("py") / F.col("pz")).alias("theta_y"))
    means = df.groupBy("exposure_id").agg(F.avg("theta_x").alias("mean_x"), F.avg("theta_y").alias("mean_y"))
    return df.join(means, "exposure_id")
