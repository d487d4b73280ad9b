"""The data model's tables from the stored ones, in Spark and, written on its own, in SQL."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.constants import COS_OBLIQUITY, MU_BARY, SIN_OBLIQUITY
from ..functions.geometry import Vec, pointing, to_ecliptic
from ..functions.kepler import NODES, chebyshev_matrix
from ..functions.timescale import LEAP_SECONDS, utc_to_tdb
from ..operators import orbit_grid, orbits
from ..staging import Stage
from ..tables import finite, table, valid_positions

REF_EPOCH = 2460960.5


def earth(epoch: Column) -> Vec:
    """The stand-in for an ephemeris: a circular orbit of the Earth."""
    angle = (2 * math.pi / 365.25) * (epoch - 2451545.0)
    return Vec(F.cos(angle), F.sin(angle) * COS_OBLIQUITY, F.sin(angle) * SIN_OBLIQUITY)


def observer(spark: SparkSession, d: str) -> DataFrame:
    """Valid catalog rows with an observer, by the reader's rule: the ephemeris where there is an obscode, else the row's own
    position if all of it is there; where there is neither, which the reader refuses, the ephemeris."""
    code = F.nullif(F.upper(F.trim("obscode")), F.lit("")).alias("obscode")
    rows = valid_positions(table(spark, d, "detection_catalog"), keep=[code, *[F.col(c) for c in ("obs_x", "obs_y", "obs_z", "ast_ucty", "mag", "detid")]])
    own = F.col("obscode").isNull() & finite(F.col("obs_x")) & finite(F.col("obs_y")) & finite(F.col("obs_z"))
    at = earth(F.col("epoch"))
    place = {f"obs_{c}": F.when(own, F.col(f"obs_{c}")).otherwise(e) for c, e in zip("xyz", (at.x, at.y, at.z))}
    return rows.withColumns({**place, "own_position": own})


def detections(spark: SparkSession, d: str) -> DataFrame:
    """Detections in the ecliptic plane with TDB epochs."""
    rows = observer(spark, d)
    rho, obs = to_ecliptic(pointing(F.col("ra"), F.col("dec"))), to_ecliptic(Vec.of("obs"))
    return rows.select("intid", utc_to_tdb(F.col("epoch")).alias("epoch"), "obscode", "detid", "ast_ucty", "mag", *rho.named("rho"), *obs.named("obs"))


def trial_orbits(spark: SparkSession, d: str) -> DataFrame:
    return Stage(spark, "orbits").write(orbits.spherical(table(spark, d, "trial_orbits"), REF_EPOCH))


def rate_orbits(spark: SparkSession, d: str) -> DataFrame:
    return orbit_grid.parallel_rates(table(spark, d, "trial_orbits"))


def members(spark: SparkSession, d: str) -> DataFrame:
    """One row per member of a linked cluster with its point, its time and its observer."""
    clusters = table(spark, d, "linked_clusters")
    # by place, so that a cluster without points keeps its members
    m = clusters.select("cluster_id", "ref_epoch", "ref_x", "ref_y", "ref_z", "local_points", F.posexplode("local_intids").alias("at", "intid")).filter("intid >= 0")
    point = F.get("local_points", F.col("at"))
    m = m.select("cluster_id", "ref_epoch", *[F.col(f"ref_{c}").alias(f"c_{c}") for c in "xyz"], "intid", "at", *[F.get(point, F.lit(k)).alias(f"s_{c}") for k, c in enumerate("xyz")])
    seen = detections(spark, d).select("intid", "epoch", "ast_ucty", "rho_x", "rho_y", "rho_z", "obs_x", "obs_y", "obs_z")
    m = m.withColumn("__r", F.row_number().over(Window.partitionBy("cluster_id", "intid").orderBy("at"))).filter("__r = 1").drop("__r")
    return m.join(seen, "intid")


# ---- the same in SQL
PI2 = repr(2 * math.pi)
VALID = """SELECT intid, CASE WHEN ra >= 0 AND ra < 360 THEN ra ELSE ((ra % 360) + 360) % 360 END AS ra, dec, epoch, nullif(upper(trim(obscode)), '') AS obscode,
    obs_x, obs_y, obs_z, ast_ucty, mag, detid FROM detection_catalog
  WHERE ra IS NOT NULL AND NOT isnan(ra) AND dec IS NOT NULL AND NOT isnan(dec) AND abs(dec) <= 90 AND epoch > 0 AND NOT isnan(epoch)"""
_OWN = "(obscode IS NULL AND obs_x IS NOT NULL AND obs_y IS NOT NULL AND obs_z IS NOT NULL AND NOT isnan(obs_x) AND NOT isnan(obs_y) AND NOT isnan(obs_z))"
_ANGLE = f"({PI2} / 365.25e0 * (epoch - 2451545e0))"
OBSERVER = f"""SELECT * REPLACE (
    CASE WHEN {_OWN} THEN obs_x ELSE cos({_ANGLE}) END AS obs_x,
    CASE WHEN {_OWN} THEN obs_y ELSE sin({_ANGLE}) * {COS_OBLIQUITY}e0 END AS obs_y,
    CASE WHEN {_OWN} THEN obs_z ELSE sin({_ANGLE}) * {SIN_OBLIQUITY}e0 END AS obs_z), {_OWN} AS own_position FROM ({VALID})"""
LEAPS = "CASE " + " ".join(f"WHEN epoch >= {s}e0 THEN {n}e0" for s, n in reversed(LEAP_SECONDS)) + f" ELSE {LEAP_SECONDS[0][1]}e0 END"
_TT = f"(epoch + ({LEAPS} + 32.184e0) / 86400e0)"
_G = f"radians(357.53e0 + 0.9856003e0 * ({_TT} - 2451545e0))"
TDB = f"({_TT} + (0.001658e0 * sin({_G}) + 0.000014e0 * sin(2e0 * {_G})) / 86400e0)"


def _ecl(x: str, y: str, z: str, name: str) -> str:
    c, s = f"{COS_OBLIQUITY}e0", f"{SIN_OBLIQUITY}e0"
    return f"{x} AS {name}_x, {c} * {y} + {s} * {z} AS {name}_y, {c} * {z} - {s} * {y} AS {name}_z"


DETECTIONS = f"""SELECT intid, {TDB} AS epoch, obscode, detid, ast_ucty, mag,
    {_ecl('cos(radians(ra)) * cos(radians(dec))', 'sin(radians(ra)) * cos(radians(dec))', 'sin(radians(dec))', 'rho')},
    {_ecl('obs_x', 'obs_y', 'obs_z', 'obs')} FROM ({OBSERVER})"""

RATES = "SELECT id AS ic_id, 1e0 / r AS gamma, vr / r AS gdot, vo / r * cos(inc) AS adot, kappa * (vo / r) * sin(inc) AS bdot FROM trial_orbits"


def orbit_sql(steps: int = 12, source: str = "trial_orbits") -> str:
    """Bound orbits by Kepler's equation in the eccentric anomaly's change since the epoch, and their least-squares series."""
    mu = f"{MU_BARY!r}"
    base = f"""SELECT id, r, vr, vo, inc, kappa, r * vo AS h, (vr * vr + vo * vo) / 2 - {mu} / r AS energy, cos(inc) AS cos_inc, sin(least(inc, {math.pi!r} - inc)) AS sin_lat FROM {source}"""
    q = f"""SELECT *, -{mu} / (2 * energy) AS a FROM ({base})"""
    q = f"""SELECT *, 1 - r / a AS ec, r * vr / sqrt({mu} * a) AS es, sqrt({mu} / (a * a * a)) AS n FROM ({q})"""
    q = f"""SELECT q.*, k, k * 7e0 - 365e0 AS dt, n * (k * 7e0 - 365e0) AS u FROM ({q}) q, (SELECT unnest(range({len(NODES)})) AS k)"""
    q = f"SELECT *, u AS x FROM ({q})"
    for _ in range(steps):
        q = f"SELECT * REPLACE (x - (x - ec * sin(x) + es * (1 - cos(x)) - u) / (1 - ec * cos(x) + es * sin(x)) AS x) FROM ({q})"
    q = f"""SELECT *, a * (1 - ec * cos(x) + es * sin(x)) AS rt, 1 - a / r * (1 - cos(x)) AS ft, dt - (x - sin(x)) / n AS gt, (ec * sin(x) + es * cos(x)) * n * a / (1 - ec * cos(x) + es * sin(x)) AS vt FROM ({q})"""
    m = chebyshev_matrix(NODES / 365.25)
    rows = "[" + ", ".join("[" + ", ".join(repr(float(v)) for v in row) + "]::DOUBLE[]" for row in m) + "]"
    sums = ", ".join(f"sum({c}t * m[{j + 1}][k + 1]) AS {c}{j}" for c in "rfgv" for j in range(4))
    return f"""SELECT id AS ic_id, r, vr, vo, inc, kappa, h, energy, cos_inc, sin_lat, {sums} FROM ({q}), (SELECT {rows} AS m) GROUP BY ALL"""


def cheb_sql(c: str, x: str) -> str:
    return f"({c}0 + {c}1 * {x} + {c}2 * (2e0 * {x} * {x} - 1e0) + {c}3 * (4e0 * {x} * {x} * {x} - 3e0 * {x}))"


def sync_sql(steps: int = 30, signed: bool = False) -> str:
    """(all of the pair, s_x, s_y, s_z) of every detection and orbit that meet."""
    mu, c = f"{MU_BARY!r}", "173.14463267424034e0"
    q = f"""SELECT d.*, o.*, rho_x * obs_x + rho_y * obs_y + rho_z * obs_z AS dot, obs_x * obs_x + obs_y * obs_y + obs_z * obs_z AS obs2
      FROM ({DETECTIONS}) d, ({orbit_sql()}) o"""
    q = f"SELECT *, r - 1e0 AS rho, CAST(NULL AS DOUBLE) AS rt, false AS done FROM ({q})"
    for _ in range(steps):
        x = f"((epoch - rho / {c} - {REF_EPOCH}e0) / 365.25e0)"
        q = f"SELECT *, {cheb_sql('r', x)} AS rn FROM ({q})"
        q = f"SELECT *, CASE WHEN rn * rn + dot * dot - obs2 >= 0 THEN sqrt(rn * rn + dot * dot - obs2) - dot END AS nn FROM ({q}) WHERE done OR rn * rn + dot * dot - obs2 >= 0"
        q = f"SELECT * EXCLUDE (rn, nn) REPLACE (CASE WHEN done THEN rho ELSE nn END AS rho, CASE WHEN done THEN rt ELSE rn END AS rt, done OR abs(nn - rho) < 1e-6 AS done) FROM ({q})"
    q = f"SELECT *, obs_x + rho * rho_x AS px, obs_y + rho * rho_y AS py, obs_z + rho * rho_z AS pz, epoch - rho / {c} AS tl FROM ({q}) WHERE done"
    q = f"""SELECT *, sqrt(px * px + py * py) AS xy, ({REF_EPOCH}e0 - tl) / 365.25e0 AS um, h / rt AS vt FROM ({q})"""
    radial = cheb_sql("v", f"((tl - {REF_EPOCH}e0) / 365.25e0)") if signed else f"sqrt(greatest(2 * greatest(energy + {mu} / rt, 0) - vt * vt, 0))"
    q = f"""SELECT *, {radial} AS vrad, cos_inc * rt / xy AS cpsi, {cheb_sql('f', 'um')} AS fm, {cheb_sql('g', 'um')} AS gm FROM ({q})"""
    q = f"""SELECT *, kappa * sqrt(1 - cpsi * cpsi) AS spsi FROM ({q}) WHERE abs(pz / rt) <= sin_lat AND abs(cpsi) <= 1"""
    return f"""SELECT *, (px * fm + gm * (vrad * px / rt + vt * (cpsi * -py / xy - spsi * pz * px / (rt * xy)))) / r AS s_x,
        (py * fm + gm * (vrad * py / rt + vt * (cpsi * px / xy - spsi * pz * py / (rt * xy)))) / r AS s_y,
        (pz * fm + gm * (vrad * pz / rt + vt * spsi * xy / rt)) / r AS s_z FROM ({q})"""


TANGENT_MIN_DEPTH = 0.0
EXPOSED = f"""WITH det AS MATERIALIZED ({DETECTIONS}),
  anchors AS (SELECT unnest(list_reduce(list_transform(list_sort(list(DISTINCT epoch)), lambda e: [e]), lambda a, b: CASE WHEN b[1] - a[len(a)] >= 1e-6 THEN list_append(a, b[1]) ELSE a END)) AS exposure_id FROM det),
  tagged AS (SELECT det.*, exposure_id FROM det ASOF JOIN anchors ON det.epoch >= anchors.exposure_id),
  firsts AS (SELECT exposure_id, arg_min(obs_x, (epoch, intid)) AS xe0, arg_min(obs_y, (epoch, intid)) AS ye0, arg_min(obs_z, (epoch, intid)) AS ze0 FROM tagged GROUP BY 1),
  exposed AS (SELECT tagged.*, xe0, ye0, ze0 FROM tagged JOIN firsts USING (exposure_id)),
  m AS (SELECT sum(rho_x) AS mx, sum(rho_y) AS my, sum(rho_z) AS mz FROM det),
  ref AS (SELECT mx / sqrt(mx * mx + my * my + mz * mz) AS ux, my / sqrt(mx * mx + my * my + mz * mz) AS uy, mz / sqrt(mx * mx + my * my + mz * mz) AS uz FROM m),
  ax AS (SELECT *, sqrt(ux * ux + uy * uy) AS u FROM ref),
  pr AS (SELECT exposed.*, (rho_y * ux - rho_x * uy) / u AS p0, -uz * ux / u * rho_x - uz * uy / u * rho_y + u * rho_z AS p1, ux * rho_x + uy * rho_y + uz * rho_z AS p2,
      (ye0 * ux - xe0 * uy) / u AS xe, -uz * ux / u * xe0 - uz * uy / u * ye0 + u * ze0 AS ye, ux * xe0 + uy * ye0 + uz * ze0 AS ze FROM exposed, ax),
  plane AS (SELECT *, p0 / p2 AS theta_x, p1 / p2 AS theta_y FROM pr WHERE p2 > {TANGENT_MIN_DEPTH}),
  tp AS (SELECT *, avg(theta_x) OVER (PARTITION BY exposure_id) AS mean_x, avg(theta_y) OVER (PARTITION BY exposure_id) AS mean_y FROM plane)"""


def tangent_sync_sql() -> str:
    """CTEs up to moved(ic_id, intid, alpha, beta)."""
    mu, c = f"{MU_BARY!r}", "173.14463267424034e0"
    return f"""{EXPOSED},
  rates AS ({RATES}),
  k1 AS (SELECT tp.*, rates.*, sqrt((1 + mean_x * mean_x + mean_y * mean_y) * (1 / gamma - ze) * (1 / gamma - ze)) AS rho FROM tp, rates),
  k2 AS (SELECT *, epoch - {REF_EPOCH}e0 - rho / {c} AS tp FROM k1),
  k3 AS (SELECT *, 1 - 0.5e0 * {mu} * gamma * gamma * gamma * tp * tp AS f FROM k2),
  k4 AS (SELECT *, 1 + tp / f * gdot - gamma / f * ze AS fac FROM k3),
  moved AS (SELECT ic_id, intid, theta_x * fac + gamma / f * xe - tp / f * adot AS alpha, theta_y * fac + gamma / f * ye - tp / f * bdot AS beta FROM k4)"""


def grid_sql(source: str, keys: str, u: str, v: str, scale: float, name: str = "cells") -> str:
    """CTEs name(keys, i, j, n) of counts in cells of `scale`."""
    s = f"{1.0 / scale!r}"
    return f"""lim_{name} AS (SELECT {keys}, min({u}) AS u0, max({u}) AS u1, min({v}) AS v0, max({v}) AS v1 FROM {source} GROUP BY {keys}),
  {name} AS (SELECT {keys}, i, j, count(*) AS n FROM (SELECT {keys},
      CAST(least(floor(({u} - u0) * {s}), greatest(ceil((u1 - u0) * {s}), 1) - 1) AS BIGINT) AS i,
      CAST(least(floor(({v} - v0) * {s}), greatest(ceil((v1 - v0) * {s}), 1) - 1) AS BIGINT) AS j FROM {source} JOIN lim_{name} USING ({keys})) GROUP BY ALL)"""


def peaks_sql(cells: str, min_count: int, name: str = "peaks") -> str:
    return f"""{name} AS (SELECT a.ic_id, a.i, a.j, a.n, CAST(sum(b.n) AS BIGINT) AS total FROM {cells} a, (VALUES (-1), (0), (1)) x(di), (VALUES (-1), (0), (1)) y(dj), {cells} b
      WHERE a.n >= {min_count} AND b.ic_id = a.ic_id AND b.i = a.i + di AND b.j = a.j + dj GROUP BY ALL HAVING max(b.n) <= a.n)"""


def hpix_sql(depth: int, x: str, y: str, z: str) -> str:
    """Nested pixel of a unit vector."""
    n = 1 << depth
    zz = f"({z} / sqrt({x} * {x} + {y} * {y} + {z} * {z}))"
    tt = f"((atan2({y}, {x}) + CASE WHEN atan2({y}, {x}) < 0 THEN {PI2} ELSE 0 END) / {math.pi / 2!r})"
    sx, sy = (_spread_sql(c) for c in ("ix", "iy"))
    a = f"SELECT *, {zz} AS hz, {tt} AS ht, (({x}) * ({x}) + ({y}) * ({y})) / ({x} * {x} + {y} * {y} + {z} * {z}) AS h2 FROM {{source}}"
    b = f"""SELECT *, CAST(floor({n} * (0.5e0 + ht - 0.75e0 * hz)) AS BIGINT) AS jp, CAST(floor({n} * (0.5e0 + ht + 0.75e0 * hz)) AS BIGINT) AS jm,
        least(CAST(floor(ht) AS BIGINT), 3) AS qd, {n} * sqrt(3e0 * h2 / (1e0 + abs(hz))) AS sz FROM ({a})"""
    c = f"""SELECT *, least(CAST(floor((ht - qd) * sz) AS BIGINT), {n - 1}) AS kp, least(CAST(floor((1e0 - (ht - qd)) * sz) AS BIGINT), {n - 1}) AS km FROM ({b})"""
    d = f"""SELECT *, CASE WHEN abs(hz) <= 2e0 / 3e0 THEN CASE WHEN jp // {n} = jm // {n} THEN (jp // {n}) % 4 + 4 WHEN jp // {n} < jm // {n} THEN jp // {n} ELSE jm // {n} + 8 END WHEN hz >= 0 THEN qd ELSE qd + 8 END AS face,
        CASE WHEN abs(hz) <= 2e0 / 3e0 THEN jm % {n} WHEN hz >= 0 THEN {n - 1} - km ELSE kp END AS ix,
        CASE WHEN abs(hz) <= 2e0 / 3e0 THEN {n - 1} - jp % {n} WHEN hz >= 0 THEN {n - 1} - kp ELSE km END AS iy FROM ({c})"""
    return f"SELECT *, face * {n * n} + {sx} + 2 * {sy} AS hpix FROM ({d})"


def _spread_sql(v: str) -> str:
    """Bits of v moved to the even places: a sum over its bits."""
    return "(" + " + ".join(f"(({v} >> {b}) & 1) * {4**b}" for b in range(16)) + ")"


MEMBERS = f"""SELECT DISTINCT ON (cluster_id, intid) cluster_id, ref_epoch, ref_x AS c_x, ref_y AS c_y, ref_z AS c_z, intid, epoch, ast_ucty, rho_x, rho_y, rho_z, obs_x, obs_y, obs_z
  FROM (SELECT cluster_id, ref_epoch, ref_x, ref_y, ref_z, unnest(local_intids) AS intid FROM linked_clusters) JOIN ({DETECTIONS}) USING (intid) WHERE intid >= 0"""
