"""Queries of the data-pipeline operators of the core, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bad_rows, key_chunks, proximity
from ..operators.sessions import sessions
from ..tables import table, valid_positions


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Bad lines of both raw tables with the first reason that holds."""
    out = None
    for name, split in (("raw_catalog", bad_rows.split_catalog), ("raw_orbits", bad_rows.split_orbits)):
        _, bad = split(table(spark, d, name).select("line_id", "line"))
        one = bad.select(F.lit(name).alias("table_name"), "line_id", "reason")
        out = one if out is None else out.unionByName(one)
    return out


def p2_catalog_rows(spark: SparkSession, d: str) -> DataFrame:
    """The valid lines of the raw catalog as typed rows."""
    good, _ = bad_rows.split_catalog(table(spark, d, "raw_catalog").select("line_id", "line"))
    return good.select("input.line_id", "row.ra", "row.obscode", "row.detid", "row.mag")


def p2_orbit_rows(spark: SparkSession, d: str) -> DataFrame:
    """The valid lines of the raw orbit files as typed rows."""
    good, _ = bad_rows.split_orbits(table(spark, d, "raw_orbits").select("line_id", "line"))
    return good.select("input.line_id", "row.id", "row.r", "row.kappa")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Catalog rows near each other in place and time, and the sky regions that hold each row."""
    points = valid_positions(table(spark, d, "detection_catalog"))
    near = proximity.near_pairs(points, arcsec=2.0, days=0.02)
    inside = proximity.regions_of(points, table(spark, d, "sky_regions"))
    return near.select(F.lit("near").alias("kind"), "id_a", "id_b").unionByName(
        inside.select(F.lit("region").alias("kind"), F.col("region_id").alias("id_a"), F.col("intid").alias("id_b"))
    )


def _sessions(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "detection_catalog").select(F.upper(F.trim("obscode")).alias("obscode"), "epoch", "intid")
    return sessions(rows, "obscode", "epoch", "intid", gap=0.2)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """First and last catalog row of each observing session."""
    return _sessions(spark, d).select("obscode", F.col("first_id").alias("first_intid"), F.col("last_id").alias("last_intid"))


def p6_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Start, end, duration and number of detections of each observing session."""
    return _sessions(spark, d).select("obscode", "session_no", "start_time", "end_time", "duration", "events")


def _cells(spark: SparkSession, d: str) -> DataFrame:
    points = valid_positions(table(spark, d, "detection_catalog"))
    rows = points.select(F.floor("ra").cast("long").alias("cell_ra"), F.floor("dec").cast("long").alias("cell_dec"), "epoch", "intid")
    return key_chunks.per_key(rows, ["cell_ra", "cell_dec"], "epoch", "intid")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """First and last row of each one-degree sky cell in the order (epoch, intid)."""
    return _cells(spark, d).select("cell_ra", "cell_dec", F.col("first_id").alias("first_intid"), F.col("last_id").alias("last_intid"))


def p7_cells(spark: SparkSession, d: str) -> DataFrame:
    """Rows, first and last epoch and the longest pause of each one-degree sky cell."""
    return _cells(spark, d).select("cell_ra", "cell_dec", "n_rows", F.col("first_value").alias("first_epoch"), F.col("last_value").alias("last_epoch"), F.col("max_step").alias("longest_pause"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p2_found, p2_catalog_rows, p2_orbit_rows, p4_found, p6_found, p6_sessions, p7_found, p7_cells)
}

_NUM = r"[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?"
_FIELD = r'("([^"]|"")*"|[^",]*)'


def _raw_sql(name: str, fields: int) -> str:
    """Lines cut by one regular expression per field; null fields where the line's shape is bad."""
    cols = ", ".join(
        f"CASE WHEN starts_with(m[{i}], '\"') THEN replace(m[{i}][2:-2], '\"\"', '\"') ELSE m[{i}] END AS f{i}" for i in range(1, fields + 1)
    )
    return f"""
    SELECT line_id, line, quoted, n, {cols} FROM (
      SELECT line_id, line,
        regexp_full_match(line, '{_FIELD}(,{_FIELD})*', 's') AS quoted,
        len(regexp_extract_all(',' || line, ',{_FIELD}', 0, 's')) AS n,
        list_transform(regexp_extract_all(',' || line, ',{_FIELD}', 0, 's'), lambda x: x[2:]) AS m
      FROM {name})"""


_CATALOG_REASON = f"""
  SELECT line_id, CASE WHEN line IS NULL THEN 'columns' WHEN NOT quoted THEN 'quoting' WHEN n <> 14 THEN 'columns'
    WHEN NOT (regexp_full_match(f1, '{_NUM}') AND coalesce(try_cast(f1 AS DOUBLE) >= 0 AND try_cast(f1 AS DOUBLE) < 360, false)) THEN 'ra'
    WHEN NOT (regexp_full_match(f4, '[A-Z0-9]{{3}}') OR (f4 = '' AND regexp_full_match(f5, '{_NUM}') AND regexp_full_match(f6, '{_NUM}') AND regexp_full_match(f7, '{_NUM}'))) THEN 'obscode'
    WHEN NOT regexp_full_match(f12, '[A-Za-z0-9_-]{{1,16}}') THEN 'detid' END AS reason, f1, f4, f9, f12
  FROM ({_raw_sql('raw_catalog', 14)})"""
_ORBIT_REASON = f"""
  SELECT line_id, CASE WHEN line IS NULL THEN 'columns' WHEN NOT quoted THEN 'quoting' WHEN n <> 6 THEN 'columns'
    WHEN NOT (regexp_full_match(f6, '{_NUM}') AND coalesce(abs(try_cast(f6 AS DOUBLE)) = 1, false)) THEN 'kappa' END AS reason, f1, f2, f6
  FROM ({_raw_sql('raw_orbits', 6)})"""
_POINTS = """
  SELECT intid, CASE WHEN ra >= 0 AND ra < 360 THEN ra ELSE ((ra % 360) + 360) % 360 END AS ra, dec, epoch FROM detection_catalog
  WHERE ra IS NOT NULL AND NOT isnan(ra) AND dec IS NOT NULL AND NOT isnan(dec) AND abs(dec) <= 90 AND epoch > 0 AND NOT isnan(epoch)"""
_HAV = "pow(sin(radians({d2} - {d1}) / 2), 2) + cos(radians({d1})) * cos(radians({d2})) * pow(sin(radians({r2} - {r1}) / 2), 2)"
_NEAR = _HAV.format(d1="a.dec", d2="b.dec", r1="a.ra", r2="b.ra")
_CIRCLE = _HAV.format(d1="p.dec", d2="r.centre_dec", r1="p.ra", r2="r.centre_ra")
_SESSIONS = """
  WITH e AS (SELECT upper(trim(obscode)) AS obscode, epoch, intid FROM detection_catalog
             WHERE epoch > 0 AND NOT isnan(epoch) AND trim(obscode) <> ''),
  g AS (SELECT *, CASE WHEN epoch - lag(epoch) OVER (PARTITION BY obscode ORDER BY epoch, intid) <= 0.2e0 THEN 0 ELSE 1 END AS new FROM e),
  s AS (SELECT *, sum(new) OVER (PARTITION BY obscode ORDER BY epoch, intid) AS session_no FROM g)"""

SQL: dict[str, str] = {
    "p2_found": f"""
      SELECT 'raw_catalog' AS table_name, line_id, reason FROM ({_CATALOG_REASON}) WHERE reason IS NOT NULL
      UNION ALL SELECT 'raw_orbits', line_id, reason FROM ({_ORBIT_REASON}) WHERE reason IS NOT NULL""",
    "p2_catalog_rows": f"SELECT line_id, CAST(f1 AS DOUBLE) AS ra, nullif(f4, '') AS obscode, f12 AS detid, CASE WHEN regexp_full_match(f9, '{_NUM}') THEN try_cast(f9 AS DOUBLE) END AS mag FROM ({_CATALOG_REASON}) WHERE reason IS NULL",
    "p2_orbit_rows": f"SELECT line_id, nullif(f1, '') AS id, CASE WHEN regexp_full_match(f2, '{_NUM}') THEN try_cast(f2 AS DOUBLE) END AS r, CAST(f6 AS DOUBLE) AS kappa FROM ({_ORBIT_REASON}) WHERE reason IS NULL",
    "p4_found": f"""
      WITH p AS ({_POINTS}),
      c AS (SELECT *, CAST(floor(dec * 120) AS BIGINT) AS cd, CAST(floor(epoch / 0.05e0) AS BIGINT) AS ct FROM p),
      o AS (SELECT c.*, cd + i.x AS jd, ct + j.x AS jt FROM c, (VALUES (-1), (0), (1)) i(x), (VALUES (-1), (0), (1)) j(x))
      SELECT 'near' AS kind, a.intid AS id_a, b.intid AS id_b FROM c a JOIN o b ON a.cd = b.jd AND a.ct = b.jt AND a.intid < b.intid
        AND abs(a.epoch - b.epoch) <= 0.02e0 AND {_NEAR} <= pow(sin(radians(2e0 / 3600) / 2), 2)
      UNION ALL
      SELECT 'region', r.region_id, p.intid FROM p, sky_regions r
      WHERE (r.epoch_from IS NULL OR p.epoch >= r.epoch_from) AND (r.epoch_to IS NULL OR p.epoch <= r.epoch_to)
        AND CASE WHEN r.shape = 'box' THEN p.dec BETWEEN r.dec_min AND r.dec_max AND
              CASE WHEN r.ra_min > r.ra_max THEN p.ra >= r.ra_min OR p.ra <= r.ra_max ELSE p.ra BETWEEN r.ra_min AND r.ra_max END
            ELSE {_CIRCLE} <= pow(sin(radians(r.radius_deg) / 2), 2) * (1 + 1e-12) END""",
    "p6_found": f"{_SESSIONS} SELECT obscode, arg_min(intid, (epoch, intid)) AS first_intid, arg_max(intid, (epoch, intid)) AS last_intid FROM s GROUP BY obscode, session_no",
    "p6_sessions": f"{_SESSIONS} SELECT obscode, CAST(session_no AS BIGINT) AS session_no, min(epoch) AS start_time, max(epoch) AS end_time, max(epoch) - min(epoch) AS duration, count(*) AS events FROM s GROUP BY obscode, session_no",
    "p7_found": f"SELECT CAST(floor(ra) AS BIGINT) AS cell_ra, CAST(floor(dec) AS BIGINT) AS cell_dec, arg_min(intid, (epoch, intid)) AS first_intid, arg_max(intid, (epoch, intid)) AS last_intid FROM ({_POINTS}) GROUP BY 1, 2",
    "p7_cells": f"""SELECT cell_ra, cell_dec, count(*) AS n_rows, min(epoch) AS first_epoch, max(epoch) AS last_epoch, max(step) AS longest_pause FROM (
      SELECT *, epoch - lag(epoch) OVER (PARTITION BY cell_ra, cell_dec ORDER BY epoch, intid) AS step FROM (
        SELECT CAST(floor(ra) AS BIGINT) AS cell_ra, CAST(floor(dec) AS BIGINT) AS cell_dec, epoch, intid FROM ({_POINTS}))) GROUP BY 1, 2""",
}
