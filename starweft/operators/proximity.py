"""Points near other points, and the regions that hold a point.

`near_pairs` is an exact join on a grid of declination strips, right ascension bins and time bins. `regions_of` is a crossing
parity in SQL operations: the edges of every outline (boxes, polygons, arcs of circles), one row each, are binned into
strips of declination and sectors of right ascension, each point meets the edges of the regions whose frame holds it, the
crossings of its ray towards larger right ascension are summed by point and region, and an odd number of them means inside.
Borders are handled explicitly: a point on an edge is inside whatever the parity.

Defined results: invalid positions must be filtered beforehand (`tables.valid_positions`); repeated rows count as points of
their own, an id that occurs twice with other coordinates too; a region with a null needed for its shape holds nothing; empty
inputs give empty results.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import Stage, small

ARCSEC = 1.0 / 3600.0
STRIP, SECTOR = 1.0, 10.0  # degrees of declination and right ascension per cell of region edges
PAD = 1e-7  # degrees by which the frames of circles are widened


def haversine(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> Column:
    """sin^2 of half the angle between two directions, all in degrees."""
    half = math.pi / 360.0
    a, b = F.sin((dec2 - dec1) * half), F.sin((ra2 - ra1) * half)
    return a * a + F.cos(F.radians(dec1)) * F.cos(F.radians(dec2)) * b * b


def near_pairs(points: DataFrame, arcsec: float, days: float, cells: float = 6.0) -> DataFrame:
    """(id_a, id_b) of all pairs with id_a < id_b within `arcsec` on the sphere and `days` in time; points: (intid, ra, dec,
    epoch).

    A cell is `cells` radii wide, so a point has one home cell and reaches few others; each pair meets where one of the two
    is at home and is kept only there. Candidates per point are a constant times its true neighbours where points lie
    evenly. Cells fuller than the rest are split by Spark's adaptive skew join, as the join's result is not grouped again.
    """
    r = arcsec * ARCSEC
    side, tside = r * cells, max(days, 1e-9) * cells
    pad = r * (1 + 1e-9) + 1e-12
    tpad = days * (1 + 1e-9) + 1e-9

    def strip(dec: Column) -> Column:
        return F.floor((dec + 90.0) / side).cast("long")

    def bins(s: Column) -> Column:
        """RA bins of a strip: as many as keep them at least `side` wide at its narrower edge."""
        low, high = s * side - 90.0, (s + 1) * side - 90.0
        widest = F.least(F.greatest(F.abs(low), F.abs(high)), F.lit(90.0))
        return F.greatest(F.floor(F.cos(F.radians(widest)) * (360.0 / side)), F.lit(1)).cast("long")

    def bin_of(ra: Column, n: Column) -> Column:
        return F.pmod(F.floor(ra * n / 360.0).cast("long"), n)

    s0 = strip(F.col("dec"))
    t0 = F.floor(F.col("epoch") / tside).cast("long")
    home = points.select(
        F.col("intid").alias("id_a"),
        F.col("ra").alias("ra_a"),
        F.col("dec").alias("dec_a"),
        F.col("epoch").alias("t_a"),
        F.xxhash64(s0, bin_of(F.col("ra"), bins(s0)), t0).alias("cell"),
    )
    # the strips, then the RA bins, then the time bins within reach of a point
    reach = points.select("intid", "ra", "dec", "epoch", F.explode(F.sequence(strip(F.greatest(F.col("dec") - pad, F.lit(-90.0))), strip(F.least(F.col("dec") + pad, F.lit(90.0))))).alias("s"))
    narrow = F.cos(F.radians(F.least(F.abs(F.col("dec")) + pad, F.lit(90.0))))
    # |dRA| of any point within r is at most asin(sin r / cos dec); near a pole all of it
    ratio = F.lit(math.sin(math.radians(pad))) / F.greatest(narrow, F.lit(1e-12))
    half = F.when(ratio < 1.0, F.degrees(F.asin(F.least(ratio, F.lit(1.0)))) + 1e-9).otherwise(F.lit(360.0))
    n = F.col("n")
    first, last = F.floor((F.col("ra") - F.col("half")) * n / 360.0).cast("long"), F.floor((F.col("ra") + F.col("half")) * n / 360.0).cast("long")
    reach = (
        reach.select("*", bins(F.col("s")).alias("n"), half.alias("half"))
        .select("*", F.explode(F.sequence(first, F.least(last, first + n - 1))).alias("k"))
        .select("*", F.explode(F.sequence(F.floor((F.col("epoch") - tpad) / tside).cast("long"), F.floor((F.col("epoch") + tpad) / tside).cast("long"))).alias("t"))
        .select(F.col("intid").alias("id_b"), F.col("ra").alias("ra_b"), F.col("dec").alias("dec_b"), F.col("epoch").alias("t_b"), F.xxhash64("s", F.pmod("k", "n"), "t").alias("cell"))
    )
    limit = math.sin(math.radians(r) / 2) ** 2
    joined = home.join(reach, "cell").filter(
        (F.col("id_a") < F.col("id_b"))
        & (F.abs(F.col("t_a") - F.col("t_b")) <= days)
        & (haversine(F.col("ra_a"), F.col("dec_a"), F.col("ra_b"), F.col("dec_b")) <= limit)
    )
    return joined.select("id_a", "id_b")


def _parts(regions: DataFrame) -> DataFrame:
    """One row per simple part of a region: (region_id, epoch_from, epoch_to, d_lo, d_hi, west, east, edges, c_ra, c_dec, rad).

    A box is a polygon of four edges; one through RA = 0 has a part on either side of it. A polygon's edges join its `vertices`
    (array of ra, dec), straight in right ascension and declination; the last vertex is joined to the first, and vertices may
    run beyond 0 and 360, which gives parts shifted by a turn. A circle has no vertices but its centre and radius.
    """
    turn = "array<struct<ra:double,dec:double>>"
    vertices = F.col("vertices").cast(turn) if "vertices" in regions.columns else F.lit(None).cast(turn)
    r = regions.filter(F.col("region_id").isNotNull()).withColumn("__v", vertices)

    def corner(ra: Column, dec: Column) -> Column:
        return F.struct(ra.cast("double").alias("ra"), dec.cast("double").alias("dec"))

    def box(w: Column, e: Column) -> Column:
        return F.array(corner(w, F.col("dec_min")), corner(e, F.col("dec_min")), corner(e, F.col("dec_max")), corner(w, F.col("dec_max")))

    whole = F.col("ra_min").isNotNull() & F.col("ra_max").isNotNull() & (F.col("dec_min") <= F.col("dec_max"))
    wraps = F.col("ra_min") > F.col("ra_max")
    boxes = F.when(wraps, F.array(box(F.col("ra_min"), F.lit(360.0)), box(F.lit(0.0), F.col("ra_max")))).otherwise(F.array(box(F.col("ra_min"), F.col("ra_max"))))
    shifted = F.transform(F.array(F.lit(-360.0), F.lit(0.0), F.lit(360.0)), lambda by: F.transform("__v", lambda v: corner(v["ra"] + by, v["dec"])))
    whole_polygon = (F.size("__v") >= 3) & F.forall("__v", lambda v: v["ra"].isNotNull() & v["dec"].isNotNull())
    rings = F.when((F.col("shape") == "box") & whole, boxes).when((F.col("shape") == "polygon") & whole_polygon, shifted)
    ring = r.select("region_id", "epoch_from", "epoch_to", F.explode(rings).alias("ring"))
    ends = F.transform("ring", lambda v, i: F.struct(v["ra"].alias("x1"), v["dec"].alias("y1"), F.get("ring", (i + 1) % F.size("ring"))["ra"].alias("x2"), F.get("ring", (i + 1) % F.size("ring"))["dec"].alias("y2")))
    ras, decs = F.transform("ring", lambda v: v["ra"]), F.transform("ring", lambda v: v["dec"])
    none = F.lit(None).cast("double")
    straight = ring.select("region_id", "epoch_from", "epoch_to", F.array_min(decs).alias("d_lo"), F.array_max(decs).alias("d_hi"), F.array_min(ras).alias("west"), F.array_max(ras).alias("east"), ends.alias("edges"), none.alias("c_ra"), none.alias("c_dec"), none.alias("rad"))
    straight = straight.filter("east >= 0 and west <= 360")
    circle = r.filter((F.col("shape") == "circle") & F.col("centre_ra").isNotNull() & F.col("centre_dec").isNotNull() & (F.col("radius_deg") >= 0))
    edge = "array<struct<x1:double,y1:double,x2:double,y2:double>>"
    arc = F.lit(None).cast("double")
    sides = F.transform(F.array(F.lit(-1.0), F.lit(1.0), F.lit(0.0)), lambda side: F.struct(side.alias("x1"), arc.alias("y1"), arc.alias("x2"), arc.alias("y2"))).cast(edge)
    lowest, highest = F.col("centre_dec") - F.col("radius_deg") - PAD, F.col("centre_dec") + F.col("radius_deg") + PAD
    # widest right ascension: all of it at a pole
    wide = F.sin(F.radians(F.least(F.col("radius_deg"), F.lit(90.0)))) / F.cos(F.radians("centre_dec"))
    reach = F.when((lowest <= -90) | (highest >= 90) | (wide >= 1) | (F.col("radius_deg") >= 90), F.lit(360.0)).otherwise(F.degrees(F.asin(F.least(wide, F.lit(1.0)))) + PAD)
    c_ra = F.pmod(F.col("centre_ra"), F.lit(360.0))
    return straight.unionByName(
        circle.select(
            "region_id", "epoch_from", "epoch_to", F.greatest(lowest, F.lit(-90.0)).alias("d_lo"), F.least(highest, F.lit(90.0)).alias("d_hi"),
            (c_ra - reach).alias("west"), (c_ra + reach).alias("east"), sides.alias("edges"), c_ra.alias("c_ra"), F.col("centre_dec").alias("c_dec"), F.col("radius_deg").alias("rad"),
        )
    )


def region_edges(regions: DataFrame) -> DataFrame:
    """One row per edge and cell that its part's frame touches: (strip, sector, region_id, part's frame, edge). Cells are
    strips of declination times sectors of right ascension; a polygon's edge is only in the strips it runs through."""
    parts = _parts(regions).filter(F.col("d_lo") <= F.col("d_hi"))
    rows = parts.select("*", F.explode("edges").alias("e")).drop("edges")
    rows = rows.select("*", F.col("e.x1").alias("x1"), F.col("e.y1").alias("y1"), F.col("e.x2").alias("x2"), F.col("e.y2").alias("y2")).drop("e")
    low, high = F.coalesce(F.least("y1", "y2"), F.col("d_lo")), F.coalesce(F.greatest("y1", "y2"), F.col("d_hi"))
    strips = F.sequence(F.floor(low / STRIP).cast("int"), F.floor(high / STRIP).cast("int"))
    last = int(360 / SECTOR) - 1
    first = F.floor(F.col("west") / SECTOR).cast("int")
    sectors = F.array_distinct(F.transform(F.sequence(first, F.least(F.floor(F.col("east") / SECTOR).cast("int"), first + last)), lambda k: F.pmod(k, F.lit(last + 1))))
    return rows.select("*", F.explode(strips).alias("strip")).select("*", F.explode(sectors).alias("sector"))


def regions_of(points: DataFrame, regions: DataFrame) -> DataFrame:
    """(region_id, intid): the regions that hold each point, borders and epoch limits included; points as in near_pairs.

    Each edge of a region that may hold the point is crossed by the point's ray towards larger right ascension or is not; the
    crossings are summed by point and region, and only their parity and the borders decide. The edges are counted before
    they may be broadcast.
    """
    stage = Stage(points.sparkSession, "regions")
    edges, n = stage.write_counted(region_edges(regions))
    at = points.select("intid", "ra", "dec", "epoch", F.floor(F.col("dec") / STRIP).cast("int").alias("strip"), F.floor(F.col("ra") / SECTOR).cast("int").alias("sector"))
    ra, dec = F.col("ra"), F.col("dec")
    # a seam: points at RA = 0 are at 360 too
    framed = ((ra >= F.col("west")) & (ra <= F.col("east"))) | (F.col("c_ra").isNotNull() & ((ra + 360 <= F.col("east")) | (ra - 360 >= F.col("west")))) | ((ra == 0) & (F.col("east") == 360.0))
    met = at.join(small(edges, n), ["strip", "sector"]).filter(
        (dec >= F.col("d_lo")) & (dec <= F.col("d_hi")) & framed
        & (F.col("epoch_from").isNull() | (F.col("epoch") >= F.col("epoch_from")))
        & (F.col("epoch_to").isNull() | (F.col("epoch") <= F.col("epoch_to")))
    )
    # straight edges: half-open in declination, so that a vertex on the ray counts once
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    spans = (F.least(y1, y2) <= dec) & (dec < F.greatest(y1, y2))
    cut = F.when(x1 == x2, x1).otherwise(x1 + (dec - y1) / F.nullif(y2 - y1, F.lit(0.0)) * (x2 - x1))
    level = (y1 == y2) & (dec == y1) & (ra >= F.least(x1, x2)) & (ra <= F.greatest(x1, x2))
    on_line = level | ((y1 != y2) & (dec >= F.least(y1, y2)) & (dec <= F.greatest(y1, y2)) & ((ra == cut) | ((ra == 0) & (cut == 360.0))))
    # arcs: half the circle's width at the point's declination, from the haversine formula; over a pole all round
    limit = F.pow(F.sin(F.radians("rad") / 2), 2)
    rise = F.pow(F.sin(F.radians(dec - F.col("c_dec")) / 2), 2)
    share = (limit - rise) / F.greatest(F.cos(F.radians(dec)) * F.cos(F.radians("c_dec")), F.lit(1e-300))
    half = F.when(share >= 1, F.lit(180.0)).otherwise(F.degrees(2 * F.asin(F.sqrt(F.greatest(share, F.lit(0.0))))))
    side = F.col("c_ra") + x1 * half
    all_round, wraps = half >= 180, (F.col("c_ra") - half < 0) | (F.col("c_ra") + half >= 360)
    arc = F.when(share < 0, F.lit(False)).when(all_round, x1 == 0).when(x1 == 0, wraps).otherwise(F.pmod(side, F.lit(360.0)) > ra)
    apart = haversine(ra, dec, F.col("c_ra"), F.col("c_dec"))
    on_arc = F.abs(apart - limit) <= limit * 1e-12
    crossed = F.when(F.col("c_ra").isNotNull(), arc).otherwise(spans & (cut > ra))
    border = F.when(F.col("c_ra").isNotNull(), on_arc | (apart == 0)).otherwise(on_line)
    hits = met.select("intid", "ra", "dec", "epoch", "region_id", F.coalesce(crossed, F.lit(False)).cast("int").alias("crossed"), F.coalesce(border, F.lit(False)).cast("int").alias("border"))
    # not filtered before: a filter would be pushed down and have every edge worked out twice
    inside = (
        hits.groupBy("region_id", "intid", "ra", "dec", "epoch")
        .agg((F.sum("crossed") % 2).alias("odd"), F.max("border").alias("border"))
        .filter((F.col("odd") == 1) | (F.col("border") == 1))
    )
    return inside.select("region_id", "intid")
