"""Queries of the operators for training data, with SQL where it can express them over whole tables."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import table
from . import components, encode, leak, mixture, neighbours, split


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """The 10 detections nearest to each probe in direction and epoch."""
    vectors = neighbours.detection_vectors(table(spark, d, "detections"))
    probes = table(spark, d, "probes").select("probe_id", F.col("intid").alias("id"))
    return neighbours.most_similar(vectors, "intid", ["x", "y", "z", "t"], 10, probes).select("probe_id", F.col("id").alias("intid"))


def p1_every_50th(spark: SparkSession, d: str) -> DataFrame:
    """The 10 nearest of every detection whose id is divisible by 50, against all detections."""
    vectors = neighbours.detection_vectors(table(spark, d, "detections"))
    asked = vectors.filter("intid % 50 = 0").select(F.col("intid").alias("probe_id"), F.col("intid").alias("id"))
    return neighbours.most_similar(vectors, "intid", ["x", "y", "z", "t"], 10, asked).select(F.col("probe_id").alias("query_id"), F.col("id").alias("intid"), "rank")


def _groups(spark: SparkSession, d: str) -> DataFrame:
    points = mixture.detection_points(table(spark, d, "detections"), table(spark, d, "linked_clusters"))
    return mixture.similarity_groups(points, radius=3.4e-5, least=4)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Members of the groups of mutually similar points."""
    return _groups(spark, d).select("scope", "group_id", F.col("id").alias("intid"))


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    """Size and most typical members of each group of mutually similar points."""
    return mixture.described(_groups(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Group identifier of every linked detid."""
    return components.detection_groups(*(table(spark, d, x) for x in ("linked_clusters", "detections", "match_pairs", "detection_catalog")))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    return encode.encode(table(spark, d, "documents"))


def p8_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Every document's text, encoded and decoded again."""
    return encode.decode(encode.encode(table(spark, d, "documents")))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with passages of evaluation items."""
    return leak.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p9_clean(spark: SparkSession, d: str) -> DataFrame:
    """The documents that stay once those with leaks are removed."""
    return leak.without_leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "lang", "source")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that are cut into several pieces."""
    out = split.pieces(table(spark, d, "documents"), with_text=False)
    return out.filter((F.col("n_pieces") > 1) & (F.col("piece_no") == 0)).select("doc_id")


def p10_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of every document."""
    out = split.pieces(table(spark, d, "documents"))
    return out.select("doc_id", "piece_no", "n_pieces", "start", "stop", F.size("ids").alias("n_tokens"), "text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_every_50th, p3_found, p3_groups, p5_found, p8_ids, p8_roundtrip, p9_found, p9_clean, p10_found, p10_pieces)}

_APART = "sqrt((p.rho_x - v.rho_x) * (p.rho_x - v.rho_x) + (p.rho_y - v.rho_y) * (p.rho_y - v.rho_y) + (p.rho_z - v.rho_z) * (p.rho_z - v.rho_z) + (p.t - v.t) * (p.t - v.t))"
_VECTORS = """SELECT intid, rho_x, rho_y, rho_z, 0.01e0 * (epoch - 2460000.5e0) AS t FROM detections
  WHERE epoch IS NOT NULL AND NOT isnan(epoch) AND NOT isnan(rho_x) AND NOT isnan(rho_y) AND NOT isnan(rho_z)
    AND abs(sqrt(rho_x * rho_x + rho_y * rho_y + rho_z * rho_z) - 1) <= 1e-6"""

_RADIUS = 3.4e-5
# Points near each other by a grid on x and y; a point is near itself. Groups as neighbourhoods that are whole: all of their
# points are near the same points.
_GROUPS = f"""WITH pts AS MATERIALIZED (SELECT scope, id, x, y, z, CAST(floor(x / {_RADIUS!r}) AS BIGINT) AS i, CAST(floor(y / {_RADIUS!r}) AS BIGINT) AS j FROM (
      SELECT catalog_id AS scope, intid AS id, rho_x AS x, rho_y AS y, rho_z AS z FROM detections
      WHERE NOT isnan(rho_x) AND NOT isnan(rho_y) AND NOT isnan(rho_z) AND abs(sqrt(rho_x * rho_x + rho_y * rho_y + rho_z * rho_z) - 1) <= 1e-6
      UNION ALL SELECT CAST(cluster_id AS VARCHAR), m.id, m.p[1], m.p[2], m.p[3] FROM (
        SELECT cluster_id, unnest(list_transform(range(1, len(local_intids) + 1), lambda k: {{'id': local_intids[k], 'p': local_points[k]}})) AS m FROM linked_clusters WHERE local_points IS NOT NULL)
      WHERE m.p IS NOT NULL) WHERE id >= 0 AND scope IS NOT NULL),
    near AS (SELECT a.scope, a.id, a.x, a.y, a.z, min(b.id) AS low, count(*) AS n, sum(hash(b.id, b.x, b.y, b.z)) AS who FROM pts a, (VALUES (-1), (0), (1)) di(di), (VALUES (-1), (0), (1)) dj(dj), pts b
      WHERE b.scope = a.scope AND b.i = a.i + di AND b.j = a.j + dj AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) <= {_RADIUS!r}
      GROUP BY a.scope, a.id, a.x, a.y, a.z),
    whole AS (SELECT scope, low, who FROM near GROUP BY scope, low, who HAVING count(*) = min(n) AND min(n) >= 4)
    SELECT near.scope, near.low AS group_id, near.id AS intid FROM near JOIN whole USING (scope, low, who)"""
_LINKS = """k AS (SELECT DISTINCT cluster_id, detid FROM (SELECT cluster_id, unnest(local_intids) AS intid FROM linked_clusters) JOIN detections USING (intid) WHERE detid IS NOT NULL AND cluster_id IS NOT NULL),
    p AS (SELECT trim(detid_a) AS a, trim(detid_b) AS b FROM match_pairs WHERE verdict = 'match'),
    links AS MATERIALIZED (SELECT f.detid AS a, k.detid AS b FROM k JOIN (SELECT cluster_id, min(detid) AS detid FROM k GROUP BY 1) f USING (cluster_id)
      UNION SELECT a, b FROM p WHERE a <> b AND a IN (SELECT detid FROM detection_catalog) AND b IN (SELECT detid FROM detection_catalog)),
    ways AS MATERIALIZED (SELECT a, b FROM links WHERE a <> b UNION SELECT b, a FROM links WHERE a <> b)"""
# NFKC in SQL: characters with a compatible form of one character by translate, of several (up to the ligatures) by replace.
_FORMS = {c: n for c in map(chr, [*range(0x80, 0xD800), *range(0xF900, 0x10000)]) if (n := unicodedata.normalize("NFKC", c)) != unicodedata.normalize("NFC", c)}
_ONE = {c: n for c, n in _FORMS.items() if len(n) == 1}
_MORE = {c: n for c, n in _FORMS.items() if len(n) > 1 and (ord(c) < 0x2180 or 0xFB00 <= ord(c) < 0xFB07)}


def _nfkc(column: str) -> str:
    quoted = "".join(_ONE.values()).replace("'", "''")
    sql = f"translate({column}, '{''.join(_ONE)}', '{quoted}')"
    for c, n in _MORE.items():
        sql = f"replace({sql}, '{c}', '{n}')"
    return f"nfc_normalize({sql})"


_RUNS = f"""words AS (SELECT item_id, part, regexp_extract_all(lower({_nfkc('t')}), '[\\p{{L}}\\p{{N}}]+') AS w FROM (SELECT item_id, 0 AS part, prompt AS t FROM eval_items UNION ALL SELECT item_id, 1, answer FROM eval_items) WHERE t IS NOT NULL),
    need AS (SELECT item_id, w, least(12, len(w)) AS n FROM words WHERE len(w) >= 12 OR (part = 0 AND len(w) > 0)),
    runs AS MATERIALIZED (SELECT DISTINCT item_id, n, hash(list_slice(w, k, k + n - 1)) AS h FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS k FROM need)),
    docs AS MATERIALIZED (SELECT doc_id, regexp_extract_all(lower({_nfkc('text')}), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
    hits AS (SELECT DISTINCT doc_id, item_id FROM (SELECT doc_id, n, hash(list_slice(w, k, k + n - 1)) AS h FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM docs, (SELECT DISTINCT n FROM runs))) JOIN runs USING (n, h))"""

SQL: dict[str, str] = {
    "p1_found": f"""WITH v AS ({_VECTORS}),
      p AS (SELECT probe_id, v.* FROM probes JOIN v USING (intid)),
      c AS (SELECT probe_id, v.intid, {_APART} AS distance FROM p, v WHERE p.intid <> v.intid)
      SELECT probe_id, intid FROM c QUALIFY row_number() OVER (PARTITION BY probe_id ORDER BY distance, intid) <= 10""",
    "p1_every_50th": f"""WITH v AS ({_VECTORS}), p AS (SELECT * FROM v WHERE intid % 50 = 0),
      c AS (SELECT p.intid AS query_id, v.intid, {_APART} AS distance FROM p, v WHERE p.intid <> v.intid)
      SELECT query_id, intid, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, intid) AS INTEGER) AS rank FROM c QUALIFY rank <= 10""",
    "p8_roundtrip": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p3_found": _GROUPS,
    "p5_found": f"""WITH RECURSIVE {_LINKS},
      reach(node, low) AS (SELECT DISTINCT a, a FROM ways UNION SELECT ways.b, reach.low FROM reach JOIN ways ON ways.a = reach.node WHERE reach.low < ways.b)
      SELECT min(low) AS group_id, node AS detid FROM reach GROUP BY node""",
    "p9_found": f"WITH {_RUNS} SELECT doc_id, item_id FROM hits",
    "p9_clean": f"WITH {_RUNS} SELECT doc_id, lang, source FROM documents WHERE doc_id IS NULL OR doc_id NOT IN (SELECT doc_id FROM hits)"}
