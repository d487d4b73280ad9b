"""Synced points gathered around peaks, screened and freed of duplicates.

The range search is an equi-join on 3-D buckets of a few search radii: a point lies in one, a centre looks into those that its
ball touches (about 3 on average, 8 at most).
Clusters stay member rows with a key; sets are compared by their size, extremes and three independent 64-bit digests instead
of collected arrays, so a large cluster never becomes one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import ARCSEC, CLUSTER_ARCSEC, MAX_DT, MIN_NIGHTS, MIN_UNIQUE_TIMES
from ..functions.geometry import Vec, chord2_of, chord2_to_angle, local_axes, night, project
from ..staging import small


def _buckets(side: float, prefix: str) -> list[Column]:
    return [F.floor(F.col(f"{prefix}_{c}") / side).cast("long").alias(f"b{c}") for c in "xyz"]


CELLS = 4.0  # side of a bucket in search radii


def within(centres: DataFrame, points: DataFrame, keys: list[str], arcsec: float = CLUSTER_ARCSEC, n_centres: int | None = None) -> DataFrame:
    """points joined to the centres (c_x, c_y, c_z) of the same keys no farther than `arcsec` (border included), with d2. The
    centres are broadcast if their number is given and small."""
    limit = chord2_of(arcsec * ARCSEC)
    reach = limit**0.5 * (1 + 1e-9)
    side = reach * CELLS
    probes = centres
    for c in "xyz":  # the few buckets that the ball around a centre touches
        span = F.sequence(F.floor((F.col(f"c_{c}") - reach) / side).cast("long"), F.floor((F.col(f"c_{c}") + reach) / side).cast("long"))
        probes = probes.select("*", F.explode(span).alias(f"b{c}"))
    rest = [c for c in points.columns if c not in keys and c not in centres.columns]
    placed = points.select(*keys, *rest, *_buckets(side, "s"))
    d = [F.col(f"s_{c}") - F.col(f"c_{c}") for c in "xyz"]
    if n_centres is not None:
        probes = small(probes, 8 * n_centres)
    met = placed.join(probes, [*keys, "bx", "by", "bz"]).withColumn("d2", d[0] * d[0] + d[1] * d[1] + d[2] * d[2])
    return met.filter(F.col("d2") <= limit).drop("bx", "by", "bz")


def neighbours_of_points(points: DataFrame, keys: list[str], arcsec: float = CLUSTER_ARCSEC, max_days: float = 15.0, only: DataFrame | None = None, n_centres: int | None = None) -> DataFrame:
    """(keys, centre_intid, intid, angle, dt): each point's neighbours within `arcsec`, itself included, whose angle fits their
    time: dt <= max_days and angle <= dt / max_days * arcsec + 1 arcsec. `only`: the (keys, centre_intid) to be searched."""
    centres = points.select(*keys, F.col("intid").alias("centre_intid"), F.col("epoch").alias("centre_epoch"), *[F.col(f"s_{c}").alias(f"c_{c}") for c in "xyz"])
    if only is not None:
        centres = centres.join(only, [*keys, "centre_intid"], "left_semi")
    met = within(centres, points.select(*keys, "intid", "epoch", "s_x", "s_y", "s_z"), keys, arcsec, n_centres)
    out = met.select(*keys, "centre_intid", "intid", chord2_to_angle(F.col("d2")).alias("angle"), F.abs(F.col("epoch") - F.col("centre_epoch")).alias("dt"), "epoch")
    return out.filter((F.col("dt") <= max_days) & (F.col("angle") <= F.col("dt") / max_days * (arcsec * ARCSEC) + ARCSEC))


def set_digest(member: str) -> list[Column]:
    """Aggregates that are equal for equal sets of members (of rows without repeats)."""
    m = F.col(member)
    return [F.count("*").alias("d_n"), F.min(m).alias("d_lo"), F.max(m).alias("d_hi"), *[F.bit_xor(F.xxhash64(m, F.lit(k))).alias(f"d_{k}") for k in (1, 2, 3)]]


DIGEST = ["d_n", "d_lo", "d_hi", "d_1", "d_2", "d_3"]


def unique_sets(members: DataFrame, keys: list[str], group: str, order: list[Column], member: str = "intid") -> DataFrame:
    """(keys, group): of the groups with the same members, the first in the given order. Null members take no part."""
    sets = members.filter(F.col(member).isNotNull()).groupBy(*keys, group).agg(*set_digest(member), *[F.first(o).alias(f"o{i}") for i, o in enumerate(order)])
    first = Window.partitionBy(*keys, *DIGEST).orderBy(*[F.col(f"o{i}") for i in range(len(order))], group)
    return sets.withColumn("__r", F.row_number().over(first)).filter("__r = 1").select(*keys, group)


def contained_sets(groups: DataFrame, group: str = "group_id", member: str = "member") -> DataFrame:
    """(group, larger): groups that are a proper subset of another one. A group without members is contained in none."""
    g = groups.filter(F.col(group).isNotNull() & F.col(member).isNotNull()).select(F.col(group).alias("g"), F.col(member).alias("m")).distinct()
    size = g.groupBy("g").agg(F.count("*").alias("n"))
    other = g.select(F.col("g").alias("h"), "m")
    # each group is followed through its rarest member only: whoever contains the group contains that one
    rare = g.groupBy("m").agg(F.count("*").alias("uses"))
    pivot = g.join(rare, "m").groupBy("g").agg(F.min(F.struct("uses", "m")).alias("p")).select("g", F.col("p.m").alias("m"))
    maybe = pivot.join(other, "m").filter("g <> h").select("g", "h")
    sizes = size.select(F.col("g").alias("h"), F.col("n").alias("hn"))
    maybe = maybe.join(size, "g").join(sizes, "h").filter("n < hn").select("g", "h", "n")
    shared = maybe.join(g, "g").join(other, ["h", "m"]).groupBy("g", "h", "n").agg(F.count("*").alias("both"))
    return shared.filter("both = n").select(F.col("g").alias(group), F.col("h").alias("larger"))


def equal_sets(groups: DataFrame, group: str = "group_id", member: str = "member") -> DataFrame:
    """(group, same_as): the smallest group with the same members, for every group."""
    g = groups.filter(F.col(group).isNotNull() & F.col(member).isNotNull()).select(group, member).distinct()
    sets = g.groupBy(group).agg(*set_digest(member))
    return sets.select(group, F.min(group).over(Window.partitionBy(*DIGEST)).alias("same_as"))


def sets_holding(groups: DataFrame, given: DataFrame, group: str = "group_id", member: str = "member") -> DataFrame:
    """(given_id, group): the groups of which each given set (given_id, member) is a proper subset; none for a set without
    members."""
    g = groups.filter(F.col(group).isNotNull() & F.col(member).isNotNull()).select(F.col(group).alias("h"), F.col(member).alias("m")).distinct()
    a = given.filter("given_id is not null and member is not null").select("given_id", F.col("member").alias("m")).distinct()
    sizes = g.groupBy("h").agg(F.count("*").alias("hn"))
    own = a.groupBy("given_id").agg(F.count("*").alias("n"))
    shared = a.join(g, "m").groupBy("given_id", "h").agg(F.count("*").alias("both"))
    return shared.join(own, "given_id").join(sizes, "h").filter("both = n and n < hn").select("given_id", F.col("h").alias(group))


def given_sets(groups: DataFrame, given: DataFrame, group: str = "group_id", member: str = "member") -> DataFrame:
    """(given_id, is_group, in_larger) of each given set: whether some group has just its members, and whether one has more
    than these."""
    larger = sets_holding(groups, given, group, member).select("given_id").distinct().withColumn("in_larger", F.lit(True))
    mine = given.filter("given_id is not null and member is not null").select("given_id", "member").distinct().groupBy("given_id").agg(*set_digest("member"))
    theirs = groups.filter(F.col(group).isNotNull() & F.col(member).isNotNull()).select(group, member).distinct().groupBy(group).agg(*set_digest(member)).select(*DIGEST).distinct()
    same = mine.join(theirs, DIGEST, "left_semi").select("given_id").withColumn("is_group", F.lit(True))
    all_ids = given.filter("given_id is not null").select("given_id").distinct()
    return all_ids.join(same, "given_id", "left").join(larger, "given_id", "left").select("given_id", F.coalesce("is_group", F.lit(False)).alias("is_group"), F.coalesce("in_larger", F.lit(False)).alias("in_larger"))


def insert_members(groups: DataFrame, more: DataFrame) -> DataFrame:
    return groups.unionByName(more).distinct()


def remove_members(groups: DataFrame, gone: DataFrame) -> DataFrame:
    """groups without the (group_id, member) rows of `gone`; groups left empty vanish."""
    return groups.join(gone, ["group_id", "member"], "left_anti")


def remove_groups(groups: DataFrame, gone: DataFrame) -> DataFrame:
    return groups.join(gone, "group_id", "left_anti")


def cull(members: DataFrame, keys: list[str], ref_epoch: float, max_dt: float = MAX_DT, min_times: int = MIN_UNIQUE_TIMES, min_nights: int = MIN_NIGHTS, min_size: int = 1) -> DataFrame:
    """Members within max_dt of the reference epoch, of clusters with enough members, distinct times and distinct nights;
    with dt. Two sums over sorted runs replace nested sets."""
    near = members.withColumn("dt", F.col("epoch") - ref_epoch).filter(F.abs("dt") <= max_dt)
    good = near.groupBy(*keys).agg(F.count("*").alias("n"), F.count_distinct("dt").alias("times"), F.count_distinct(night(F.col("dt"))).alias("nights"))
    good = good.filter((F.col("n") >= min_size) & (F.col("times") >= min_times) & (F.col("nights") >= min_nights)).select(*keys)
    return near.join(good, keys, "left_semi")


def cluster_plane(members: DataFrame) -> DataFrame:
    """Members with tangent-plane coordinates theta_x, theta_y at their cluster's centre (c_x, c_y, c_z) and the observer's
    position xe, ye, ze in local coordinates."""
    axes = local_axes(Vec.of("c"))
    p, o = project(Vec.of("s"), axes), project(Vec.of("obs"), axes)
    return members.select("*", (p.x / p.z).alias("theta_x"), (p.y / p.z).alias("theta_y"), o.x.alias("xe"), o.y.alias("ye"), o.z.alias("ze"))


def duration_screen(members: DataFrame, keys: list[str], min_detections: int = 8, min_duration: float = 20.0, min_nights: int = 6) -> DataFrame:
    """(keys, n, duration, nights) of groups long enough in members, days and distinct rounded epochs."""
    out = members.groupBy(*keys).agg(F.count("*").alias("n"), (F.max("epoch") - F.min("epoch")).alias("duration"), F.count_distinct(F.round("epoch")).alias("nights"))
    return out.filter((F.col("n") >= min_detections) & (F.col("duration") >= min_duration) & (F.col("nights") >= min_nights))
