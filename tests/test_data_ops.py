"""Defined results of the core's data operators on awkward inputs."""

import random

import pytest
from pyspark.sql import functions as F

from starweft.operators import bad_rows, key_chunks, proximity, sessions
from starweft.staging import lookup
import starweft.staging as staging


def lines(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "line_id long, line string, reason_not string")


def reasons(spark, split, texts):
    _, bad = split(lines(spark, texts))
    return {r["line_id"]: r["reason"] for r in bad.collect()}


def test_bad_orbit_lines(spark):
    texts = ["a,1,2,3,4,1", "a,1,2,3,4,-1.0", 'a,"1",2,3,4,"+1e0"', "a,1,2,3,4,2", "a,1,2,3,4", "", None, 'a,"1,2,3,4,1', 'a,1"0,2,3,4,1', '"a""b, c",1,2,3,4,1', "a,1,2,3,4, 1", '"a\nb",1,2,3,4,-1', 'a,""1"",2,3,4,1', "x" * 200_000 + ",1,2,3,4,1", "a,1,2,3,4,±1", 'a,1,2,3,4,""']
    got = reasons(spark, bad_rows.split_orbits, texts)
    assert got == {3: "kappa", 4: "columns", 5: "columns", 6: "columns", 7: "quoting", 8: "quoting", 10: "kappa", 12: "quoting", 14: "kappa", 15: "kappa"}


def test_bad_catalog_lines(spark):
    row = "{ra},1,2460000.5,{obs},{x},0,0,,,,g,{det},,"
    mk = lambda ra="10", obs="X05", x="", det="d1": row.format(ra=ra, obs=obs, x=x, det=det)
    texts = [mk(), mk(ra="360"), mk(ra="-0.0"), mk(ra="1e400"), mk(ra="nan"), mk(obs="x05"), mk(obs="", x="1"), mk(obs=""), mk(det=""), mk(det="a" * 17), mk(det="ok_-9"), mk(ra="359.999"), "ra,dec,epoch,obscode,obs_x,obs_y,obs_z,ast_ucty,mag,mag_ucty,filter,detid,objid,trackid"]
    got = reasons(spark, bad_rows.split_catalog, texts)
    assert got == {1: "ra", 3: "ra", 4: "ra", 5: "obscode", 7: "obscode", 8: "detid", 9: "detid", 12: "ra"}
    good, _ = bad_rows.split_catalog(lines(spark, texts))
    assert good.count() == 5 and good.select("row.detid").first()


def test_bad_rows_of_nothing_and_repeats(spark):
    good, bad = bad_rows.split_orbits(lines(spark, []))
    assert good.count() == bad.count() == 0
    df = spark.createDataFrame([(None, "a,1"), (None, "a,1"), (1, "a,1")], "line_id long, line string")
    assert bad_rows.split_orbits(df)[1].count() == 3


def test_closing_and_runs():
    for seed in range(200):
        r = random.Random(seed)
        n, reach = r.randint(1, 120), r.randint(1, 20)
        on = sorted(r.sample(range(n), r.randint(1, min(n, 12))))
        bits = sum(1 << i for i in on)
        got = sessions.runs_of(bits.to_bytes(n // 8 + 1, "little"), reach)
        want = []
        for i in on:
            if want and i - want[-1][1] - 1 <= reach:
                want[-1] = (want[-1][0], i)
            else:
                want.append((i, i))
        assert got == want


def brute_sessions(rows, gap):
    out, by = [], {}
    for e, t, i in rows:
        if e and t is not None and t == t and 0 < t < float("inf"):
            by.setdefault(e, []).append((t, i))
    for e, v in by.items():
        v.sort()
        cur = [v[0]]
        for a in v[1:]:
            if a[0] - cur[-1][0] > gap:
                out.append((e, cur[0][1], cur[-1][1], len(cur)))
                cur = []
            cur.append(a)
        out.append((e, cur[0][1], cur[-1][1], len(cur)))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_sessions_against_brute_force(spark, seed):
    r = random.Random(seed)
    rows = [("hot" if r.random() < 0.4 else r.choice(["a", "b", "", None]), r.choice([2460000 + r.random() * 40, 2460000 + round(r.random() * 200) * 0.2, None, float("nan"), 0.0, -1.0, float("inf"), 2460400.0 + r.random() * 500]), i) for i in range(1500)]
    rows += rows[:50]
    df = spark.createDataFrame([(*x, "extra") for x in rows], "e string, t double, i long, n string")
    got = sorted((x["e"], x["first_id"], x["last_id"], x["events"]) for x in sessions.sessions(df, "e", "t", "i", 0.2).collect())
    assert got == brute_sessions(rows, 0.2)
    assert sessions.sessions(df.limit(0), "e", "t", "i", 0.2).count() == 0


def test_key_chunks_against_brute_force(spark):
    r = random.Random(3)
    rows = [(0 if r.random() < 0.5 else r.choice([None, 1, 2, 3]), r.choice([None, float(r.randint(0, 50))]), i) for i in range(3000)]
    df = spark.createDataFrame([(*x, 1) for x in rows], "k long, v double, i long, n_rows int")
    got = {x["k"]: (x["n_rows"], x["first_id"], x["last_id"], x["max_step"]) for x in key_chunks.per_key(df, ["k"], "v", "i", chunk_rows=100).collect()}
    by = {}
    for k, v, i in rows:
        by.setdefault(k, []).append((v is not None, v or 0, i))
    want = {}
    for k, v in by.items():
        v.sort()
        known = [x[1] for x in v if x[0]]
        want[k] = (len(v), v[0][2], v[-1][2], max((b - a for a, b in zip(known, known[1:])), default=None))
    assert got == want
    assert key_chunks.per_key(df.limit(0), ["k"], "v", "i").count() == 0
    sizes = [x["count"] for x in key_chunks.numbered(df, ["k"], ["v", "i"], 100).groupBy("k", "chunk_no").count().collect()]
    assert max(sizes) == 100


def test_near_pairs_against_brute_force(spark):
    import math

    r = random.Random(5)
    pts = []
    for i in range(700):
        base = r.choice([(0.0, 0.0), (359.9999, 10.0), (120.0, 89.9999), (5.0, -90.0), (77.0, -89.99), (200.0, 45.0)])
        ra, dec = base[0] + r.uniform(-3, 3) / 3600 / max(math.cos(math.radians(base[1])), 1e-3), base[1] + r.uniform(-3, 3) / 3600
        pts.append((i, ra % 360, max(-90.0, min(90.0, dec)), 2460000.5 + r.choice([0, 0.01, 0.02, 0.03, 5])))
    pts += [(1000 + k, *pts[k][1:]) for k in range(20)]
    df = spark.createDataFrame(pts, "intid long, ra double, dec double, epoch double")
    got = sorted((x["id_a"], x["id_b"]) for x in proximity.near_pairs(df, 2.0, 0.02).collect())

    def near(a, b):
        h = math.pi / 360
        s = math.sin((a[2] - b[2]) * h) ** 2 + math.cos(math.radians(a[2])) * math.cos(math.radians(b[2])) * math.sin((a[1] - b[1]) * h) ** 2
        return s <= math.sin(math.radians(2 / 3600) / 2) ** 2 and abs(a[3] - b[3]) <= 0.02

    want = sorted((a[0], b[0]) if a[0] < b[0] else (b[0], a[0]) for n, a in enumerate(pts) for b in pts[n + 1 :] if near(a, b))
    assert got == want and len(set(got)) == len(got)


def test_regions_with_borders_seams_and_poles(spark):
    cols = "region_id long, shape string, ra_min double, ra_max double, dec_min double, dec_max double, centre_ra double, centre_dec double, radius_deg double, epoch_from double, epoch_to double"
    regions = [
        (1, "box", 10.0, 20.0, -5.0, 5.0, None, None, None, None, None), (2, "box", 350.0, 10.0, 0.0, 1.0, None, None, None, 100.0, 200.0),
        (3, "circle", None, None, None, None, 0.0, 0.0, 1.0, None, None), (4, "circle", None, None, None, None, 0.0, 89.5, 1.0, None, None),
        (5, "box", 0.0, 360.0, -90.0, 90.0, None, None, None, None, 50.0), (6, "circle", None, None, None, None, None, 1.0, 1.0, None, None), (7, "box", 10.0, 10.0, 2.0, 2.0, None, None, None, None, None),
    ]
    pts = [(1, 10.0, 5.0, 150.0), (2, 20.0, -5.0, 150.0), (3, 0.0, 0.5, 150.0), (4, 355.0, 1.0, 100.0), (5, 355.0, 1.0, 99.9), (6, 359.5, 0.0, 1.0), (7, 180.0, 89.6, 60.0), (8, 10.0, 2.0, 150.0), (9, 20.0001, 0.0, 1.0), (10, 0.0, 1.0, 300.0)]
    got = {(x["region_id"], x["intid"]) for x in proximity.regions_of(spark.createDataFrame(pts, "intid long, ra double, dec double, epoch double"), spark.createDataFrame(regions, cols)).collect()}
    assert got == {(1, 1), (1, 2), (1, 8), (2, 3), (2, 4), (3, 3), (3, 6), (3, 10), (4, 7), (5, 6), (5, 9), (7, 8)}
    assert proximity.regions_of(spark.createDataFrame(pts, "intid long, ra double, dec double, epoch double"), spark.createDataFrame([], cols)).count() == 0


def test_hot_keys_are_split(spark, monkeypatch):
    monkeypatch.setattr(staging, "BROADCAST_ROWS", 1)
    monkeypatch.setattr(staging, "HOT_ROWS", 50)
    left = spark.range(500).select(F.when(F.col("id") < 300, 0).otherwise(F.col("id")).cast("long").alias("k"), "id")
    table = spark.range(450).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    assert sorted(map(tuple, lookup(left, 500, "k", table, 450).collect())) == sorted(map(tuple, left.join(table, "k").collect()))
    assert lookup(left, 500, "k", table, 450, "left").count() == 500


def test_sessions_keep_very_late_events(spark):
    late = 1e12
    rows = [("a", t, i) for i, t in enumerate([1.0, 1.1, late - 0.25, late - 0.125, late, late + 0.125, late + 1, 1e300, 1e300])]
    got = sessions.sessions(spark.createDataFrame(rows, "e string, t double, i long"), "e", "t", "i", 0.2).collect()
    assert {(r["first_id"], r["last_id"], r["events"]) for r in got} == {(0, 1, 2), (2, 5, 4), (6, 6, 1), (7, 8, 2)}


def test_sessions_of_a_hot_entity_in_milliseconds(spark):
    """Most events under one entity, far apart and close together, over many blocks, at epoch milliseconds."""
    r = random.Random(9)
    t, rows = 1.7e12, []
    for i in range(6000):
        t += r.choice([0, 1000.0, 60_000.0, 1_799_999.0, 1_800_000.0, 1_800_001.0, 1_700_000.0, 1_900_000.0, 4e6, 9e9 if r.random() < 0.01 else 5e5])
        rows.append(("hot" if r.random() < 0.9 else "b", t, i))
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "e string, t double, i long")
    out = sessions.sessions(df, "e", "t", "i", 1_800_000.0).collect()
    assert sorted((x["e"], x["first_id"], x["last_id"], x["events"]) for x in out) == brute_sessions(rows, 1_800_000.0)
    for e in ("hot", "b"):
        mine = sorted((x["session_no"], x["start_time"]) for x in out if x["e"] == e)
        assert [n for n, _ in mine] == list(range(1, len(mine) + 1)) and [s for _, s in mine] == sorted(s for _, s in mine)


def test_polygons_by_crossing_parity(spark):
    cols = "region_id long, shape string, ra_min double, ra_max double, dec_min double, dec_max double, centre_ra double, centre_dec double, radius_deg double, epoch_from double, epoch_to double, vertices array<struct<ra:double,dec:double>>"
    none = (None,) * 9
    diamond = [(10.0, 0.0), (15.0, 5.0), (10.0, 10.0), (5.0, 5.0)]
    hollow = [(40.0, 0.0), (50.0, 0.0), (50.0, 10.0), (45.0, 2.0), (40.0, 10.0)]
    seam = [(355.0, -3.0), (365.0, -3.0), (365.0, 3.0), (355.0, 3.0)]
    regions = [(1, "polygon", *none, diamond), (2, "polygon", *none, hollow), (3, "polygon", *none, seam), (4, "polygon", *none, diamond[:2]), (5, "polygon", *none, None)]
    pts = [(10.0, 5.0), (6.0, 5.0), (4.0, 5.0), (5.0, 5.0), (15.0, 5.0), (10.0, 0.0), (2.0, 10.0), (2.0, 0.0), (12.5, 2.5), (13.0, 2.5), (45.0, 1.0), (45.0, 2.0), (45.0, 3.0), (41.0, 8.0), (49.0, 8.0), (40.0, 0.0), (45.0, 0.0), (0.0, 0.0), (359.0, 2.0), (4.0, 3.0), (5.0, 0.0), (6.0, 0.0), (355.0, 3.0)]
    df = spark.createDataFrame([(i, *p, 1.0) for i, p in enumerate(pts)], "intid long, ra double, dec double, epoch double")
    got = {(x["region_id"], x["intid"]) for x in proximity.regions_of(df, spark.createDataFrame(regions, cols)).collect()}
    assert got == {(1, i) for i in (0, 1, 3, 4, 5, 8)} | {(2, i) for i in (10, 11, 13, 14, 15, 16)} | {(3, i) for i in (7, 17, 18, 19, 20, 22)}


def test_circles_against_the_distance(spark):
    cols = "region_id long, shape string, ra_min double, ra_max double, dec_min double, dec_max double, centre_ra double, centre_dec double, radius_deg double, epoch_from double, epoch_to double"
    import math

    r = random.Random(2)
    circles = [(k, "circle", None, None, None, None, r.uniform(0, 360), r.choice([r.uniform(-90, 90), 89.9, -89.5, 0.0]), r.choice([0.5, 3.0, 40.0, 100.0, 180.0]), None, None) for k in range(25)]
    pts = [(i, r.choice([r.uniform(0, 360), 0.0, 359.99]), r.choice([r.uniform(-90, 90), 90.0, -90.0]), 1.0) for i in range(600)]
    pts += [(1000 + k, c[6], max(-90.0, min(90.0, c[7] + r.uniform(-1, 1) * c[8])), 1.0) for k, c in enumerate(circles)]
    got = {(x["region_id"], x["intid"]) for x in proximity.regions_of(spark.createDataFrame(pts, "intid long, ra double, dec double, epoch double"), spark.createDataFrame(circles, cols)).collect()}
    rad = math.radians
    want = {(c[0], p[0]) for c in circles for p in pts if math.sin(rad(p[2] - c[7]) / 2) ** 2 + math.cos(rad(p[2])) * math.cos(rad(c[7])) * math.sin(rad(p[1] - c[6]) / 2) ** 2 <= math.sin(rad(c[8]) / 2) ** 2 * (1 + 1e-12)}
    assert got == want


def test_values_are_checked_once_each(spark):
    """The checks are planned above the staged distinct values, never in the scan of the lines."""
    seen = []
    write = staging.Stage.write
    texts = [f"a,{k},2,3,4,{k % 3}" for k in range(300)]
    try:
        staging.Stage.write = lambda self, df: seen.append(df) or write(self, df)
        _, bad = bad_rows.split_orbits(lines(spark, texts))
    finally:
        staging.Stage.write = write
    assert bad.count() == 200
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in seen]
    checks = [p for p in plans if bad_rows.NUMBER in p]
    assert len(checks) == 1 and "Aggregate" not in checks[0] and "Generate" not in checks[0]


def test_staged_tables_go_at_the_end_of_their_scope(spark):
    import os

    with staging.kept_for(spark):
        s = staging.Stage(spark, "scope")
        assert s.write(spark.range(5)).count() == 5
        path = s.root.removeprefix("file://")
        assert os.path.isdir(path)
    assert not os.path.isdir(path)
