"""Analytic values and properties of the linker's operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from starweft.functions import healpix, kepler
from starweft.functions.constants import COS_OBLIQUITY, MU_BARY, SIN_OBLIQUITY
from starweft.functions.geometry import night, pointing, to_ecliptic
from starweft.operators import exposures, fits, grids, iod, linking, orbits, passes, peaks, sync
from starweft.plans import linker
from starweft.sources import config, readers

EPOCH = 2460000.5


def test_frames(spark):
    df = spark.createDataFrame([(0.0, 0.0), (90.0, 0.0), (0.0, 90.0)], "ra double, dec double").select(*to_ecliptic(pointing(F.col("ra"), F.col("dec"))).named("v"))
    got = np.array([list(r) for r in df.collect()])
    assert np.allclose(got, [[1, 0, 0], [0, COS_OBLIQUITY, -SIN_OBLIQUITY], [0, SIN_OBLIQUITY, COS_OBLIQUITY]], atol=1e-15)


def test_nights(spark):
    assert [r[0] for r in spark.createDataFrame([(0.5,), (-0.5,), (1.49,)], "t double").select(night(F.col("t"))).collect()] == [1, -1, 1]


def test_pixels(spark):
    v = np.random.default_rng(1).normal(size=(3000, 3))
    df = spark.createDataFrame([tuple(map(float, x)) for x in v], "rho_x double, rho_y double, rho_z double")
    for depth in (0, 8, 15):
        rows = healpix.with_pixel(df, depth, "rho").collect()
        assert [r["hpix"] for r in rows] == healpix.np_pixel(depth, v).tolist()
    sizes = [len(x) for x in healpix.np_neighbours(3, np.arange(12 * 64))]
    assert sizes.count(7) == 24 and sizes.count(8) == 12 * 64 - 24
    assert healpix.with_pixel(spark.createDataFrame([(0.0, 0.0, 0.0), (None, 1.0, 0.0)], df.schema), 3, "rho").count() == 0


def test_motion_and_orbits(spark):
    r, vo = 40.0, math.sqrt(MU_BARY / 40.0)
    row = orbits.spherical(spark.createDataFrame([(r, 0.0, vo, 0.1, 1.0, "a"), (None, 0.0, 1.0, 0.1, 1.0, "b")], "r double, vr double, vo double, inc double, kappa double, id string"), EPOCH).orderBy("id").collect()
    assert np.allclose(row[0]["r_poly"], [40, 0, 0, 0], atol=1e-9) and row[0]["alpha"] == pytest.approx(1 / 40) and row[1]["r_poly"] is None
    e = 0.3
    m = np.linspace(-3, 3, 11)
    x = kepler.solve_kepler(m, e)
    assert np.allclose(x - e * np.sin(x), m, atol=1e-12)
    assert np.allclose(kepler.fit_chebyshev(np.linspace(-1, 1, 50), 4 * np.linspace(-1, 1, 50) ** 3 - 3 * np.linspace(-1, 1, 50)), [0, 0, 0, 1], atol=1e-12)


def one_object(n=20, nights=12, noise=0, seed=2):
    """A circular orbit seen from the Earth, light time included, with uniform noise around."""
    rng = np.random.default_rng(seed)
    r, inc = 42.0, 0.2
    vo = math.sqrt(MU_BARY / r)
    p0 = r * np.array([math.cos(0.4), math.sin(0.4) * math.cos(inc), math.sin(0.4) * math.sin(inc)])
    v0 = vo * np.array([-math.sin(0.4), math.cos(0.4) * math.cos(inc), math.cos(0.4) * math.sin(inc)])
    rows = []
    for k in range(n):
        t = EPOCH - 15 + (k % nights) * 2.5 + 0.03 * (k // nights)
        a = 2 * math.pi * t / 365.25
        obs, d = np.array([math.cos(a), math.sin(a), 0.0]), 40.0
        for _ in range(8):
            _, _, f, g = kepler.motion(r, 0.0, vo, MU_BARY, t - d / 173.14463267424034 - EPOCH)
            line = f * p0 + g * v0 - obs
            d = np.linalg.norm(line)
        rows.append((k, t, *(line / d).tolist(), *obs.tolist()))
    for k in range(noise):
        u = rng.normal(size=3)
        rows.append((1000 + k, EPOCH + float(rng.uniform(-15, 15)), *(u / np.linalg.norm(u)).tolist(), 1.0, 0.0, 0.0))
    return rows, (r, 0.0, vo, inc, 1.0, "right")


SCHEMA = "intid long, epoch double, rho_x double, rho_y double, rho_z double, obs_x double, obs_y double, obs_z double"


def test_injected_object_is_recovered(spark):
    rows, orbit = one_object(noise=300)
    det = spark.createDataFrame(rows, SCHEMA)
    orb = orbits.spherical(spark.createDataFrame([orbit, (60.0, 0.0, 0.002, 0.1, -1.0, "wrong")], "r double, vr double, vo double, inc double, kappa double, id string"), EPOCH)
    fitted = linker.hpix_linker(det, orb, EPOCH, depth=13, arcsec=60.0).collect()
    assert {(f["ic_id"], tuple(sorted(f["kept"]))) for f in fitted} == {("right", tuple(range(20)))}
    assert linker.point_linker(det, orb, 30.0).filter("ic_id = 'wrong'").count() == 0


def test_point_linker_finds_the_same_by_pass_and_by_shuffle(spark, monkeypatch):
    """Two objects whose points fall in dense and in sparse cells, one of them seen twice under other ids; a repeated id goes by
    shuffle."""
    rows, orbit = one_object(n=40, nights=14, noise=200)
    rng = np.random.default_rng(5)
    for k in range(400):  # a crowd around the object's points
        i, t, x, y, z, *obs = rows[k % 40]
        v = np.array([x, y, z]) + rng.normal(size=3) * 1.5e-4
        rows.append((2000 + k, t + float(rng.uniform(-1, 1)), *map(float, v / np.linalg.norm(v)), *obs))
    rows += [(5000 + i, *rest) for i, *rest in rows[:10]]
    orb = orbits.spherical(spark.createDataFrame([orbit, (60.0, 0.0, 0.002, 0.1, -1.0, "wrong")], "r double, vr double, vo double, inc double, kappa double, id string"), EPOCH)
    det = spark.createDataFrame(rows, SCHEMA)

    def found(det, arcsec):
        return {tuple(r[:3]): (r["angle"], r["dt"]) for r in linker.point_linker(det, orb, arcsec).collect()}

    monkeypatch.setattr(passes, "BLOCK", 1000)
    for arcsec in (7.0, 60.0):
        with monkeypatch.context() as m:
            m.setattr(passes, "PASS_ROWS", 0)
            by_shuffle = found(det, arcsec)
        for dense in (1, 4096, 1 << 40):
            monkeypatch.setattr(passes, "DENSE", dense)
            got = found(det, arcsec)
            assert len(got) > 100 and got.keys() == by_shuffle.keys()
            assert all(v == pytest.approx(by_shuffle[k], abs=1e-9) for k, v in got.items())
            sums = {}
            for o, c, i in got:
                n, members = sums.get((o, c), (0, 0))
                sums[o, c] = n + 1, members + i
            assert {(r["ic_id"], r["centre_intid"]): (r["n"], r["members"]) for r in linker.point_sums(det, orb, arcsec, 8, 20.0, 6).collect()} == sums
    assert linker.numbered(det)[0] and not linker.numbered(spark.createDataFrame([*rows, rows[3]], SCHEMA))[0]


def test_point_sums_search_equal_detections_once(spark, monkeypatch):
    """Each of an object's crowd is there three times, under ids of any size; tiles of few centres and columns."""
    rows, orbit = one_object(n=40, nights=14, noise=50)
    rng = np.random.default_rng(8)
    for k in range(300):
        i, t, x, y, z, *obs = rows[k % 40]
        v = np.array([x, y, z]) + rng.normal(size=3) * 1e-4
        rows.append((2000 + k, t + float(rng.uniform(-4, 4)), *map(float, v / np.linalg.norm(v)), *obs))
    n = len(rows)
    rows += [(i + 10**6, *rest) for i, *rest in rows] + [((i + 1) << 40 if i % 2 else -1 - i, *rest) for i, *rest in rows]
    det = spark.createDataFrame(rows, SCHEMA)
    orb = orbits.spherical(spark.createDataFrame([orbit], "r double, vr double, vo double, inc double, kappa double, id string"), EPOCH)
    assert passes.stage_distinct(spark, linker.numbered(det)[0])[1] == n

    def found(arcsec):
        return {r["centre_intid"]: (r["n"], r["members"]) for r in linker.point_sums(det, orb, arcsec, 24, 10.0, 4).collect()}

    monkeypatch.setattr(passes, "COLUMNS", 64)
    for arcsec in (7.0, 30.0, 120.0):
        with monkeypatch.context() as m:
            m.setattr(passes, "PASS_ROWS", 0)
            by_shuffle = found(arcsec)
        assert len(by_shuffle) > 10
        for dense, tile in ((1, 8), (1, 1 << 20), (1 << 40, 8)):
            monkeypatch.setattr(passes, "DENSE", dense)
            monkeypatch.setattr(passes, "TILE", tile)
            assert found(arcsec) == by_shuffle


def test_point_linker_shuffles_no_points(spark):
    rows, orbit = one_object(n=40, nights=14)
    orb = orbits.spherical(spark.createDataFrame([orbit], "r double, vr double, vo double, inc double, kappa double, id string"), EPOCH)
    plan = linker.point_linker(spark.createDataFrame(rows, SCHEMA), orb)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "MapInPandas" in plan


def test_sync_drops_nulls_and_far_latitudes(spark):
    rows, orbit = one_object()
    rows += [(50, None, 1.0, 0.0, 0.0, 1.0, 0.0, 0.0), (51, EPOCH, None, 0.0, 0.0, 1.0, 0.0, 0.0), (52, EPOCH, 0.0, 0.0, 1.0, 1.0, 0.0, 0.0)]
    orb = orbits.spherical(spark.createDataFrame([orbit], "r double, vr double, vo double, inc double, kappa double, id string"), EPOCH)
    out = sync.sync(spark.createDataFrame(rows, SCHEMA), orb)
    got = np.array([[r["s_x"], r["s_y"], r["s_z"]] for r in out.collect()])
    assert len(got) == 20 and np.abs(np.linalg.norm(got, axis=1) - 1).max() < 1e-6
    assert np.linalg.norm(got - got.mean(axis=0), axis=1).max() < 1e-4
    assert sync.sync(spark.createDataFrame(rows, SCHEMA), orb, keep_all=True).count() == 23


def test_anchored_exposures(spark):
    rows = [(i, t, 1.0, 0.0, 0.0, float(i), 0.0, 0.0) for i, t in enumerate([0.0, 0.7e-6, 1.4e-6, 5.0, None, 0.9999999, 1.0000001])]
    got = {r["intid"]: (r["exposure_id"], r["xe0"]) for r in exposures.exposures(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {0: (0.0, 0.0), 1: (0.0, 0.0), 2: (1.4e-6, 2.0), 3: (5.0, 3.0), 5: (0.9999999, 5.0), 6: (0.9999999, 5.0)}


def test_peaks_and_edges(spark):
    cells = spark.createDataFrame([("a", 0, 0, 5), ("a", 0, 1, 5), ("a", 5, 5, 3), ("a", 6, 6, 4)], "ic_id string, i long, j long, n long")
    got = {(r["i"], r["j"]): r["total"] for r in peaks.grid_peaks(cells, ["ic_id"]).collect()}
    assert got == {(0, 0): 10, (0, 1): 10, (6, 6): 7}
    pts = spark.createDataFrame([("a", 0.0, 0.0), ("a", 1.0, 1.0), ("b", 3.0, 3.0), ("a", None, 1.0)], "ic_id string, u double, v double")
    assert sorted(map(tuple, grids.grid(pts, ["ic_id"], "u", "v", 0.5).collect())) == [("a", 0, 0, 1), ("a", 1, 1, 1), ("b", 0, 0, 1)]


def test_sets(spark):
    g = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 2), (2, 3), (3, 2), (3, 1), (4, None), (5, 9)], "group_id long, member long")
    assert {tuple(r) for r in linking.contained_sets(g).collect()} == {(1, 2), (3, 2)}
    assert {tuple(r) for r in linking.equal_sets(g).collect()} == {(1, 1), (3, 1), (2, 2), (5, 5)}


def test_fits(spark):
    rng = np.random.default_rng(0)
    t = np.repeat(np.arange(12.0) * 2.5 - 15, 2)[:20] + np.arange(20) * 0.01
    f, g = np.sin(t / 10), np.cos(t / 10)
    s = 0.2 * math.pi / 180 / 3600
    x, y = 1e-3 + 2e-5 * t + 2.5e-2 * f, -2e-3 + 1e-5 * t + 2.5e-2 * g
    bad = [3, 8, 15]
    x2 = x.copy()
    x2[bad] += 5 * math.pi / 180 / 3600
    rows = [(k, i, *map(float, (t[i], f[i], g[i], xs[i], y[i], s))) for k, xs in (("clean", x), ("outliers", x2)) for i in range(20)]
    df = spark.createDataFrame(rows + [("two", 1, 0.0, 0.0, 0.0, 0.0, 0.0, s)], "k string, intid long, t double, f double, g double, x double, y double, sigma double")
    clean = [r for r in fits.coupled_fit(df, ["k"]).collect() if r["k"] == "clean"][0]
    assert np.allclose([clean[c] for c in "abcde"], [1e-3, 2e-5, 2.5e-2, -2e-3, 1e-5], rtol=1e-6)
    ours = fits.np_fit(t, f, g, x + s * rng.normal(size=20), y, np.full(20, s), np.full(20, s))
    assert ours["dof"] == 35 and np.allclose(ours["params"][2], 2.5e-2, rtol=1e-2)
    got = {r["k"]: sorted(r["rejected"]) for r in fits.rejecting_fits(df, ["k"]).collect()}
    assert got == {"clean": [], "outliers": bad}


def test_gauss_recovers_an_orbit():
    rows, (r, _, vo, *_rest) = one_object(3, 3)
    m = np.array([x[1:] for x in rows])
    states = iod.gauss_states(m[:, 1:4], m[:, 4:7], m[:, 0], 1.5)
    assert any(abs(np.linalg.norm(s[:3]) - r) < 0.5 and abs(np.linalg.norm(s[3:6]) - vo) < 0.1 * vo for s in states)


def test_readers(spark, tmp_path):
    good = tmp_path / "cat.csv"
    good.write_text("ra,dec,epoch,obs_x,obs_y,obs_z,detid,ast_ucty\n10,5,2460000.5,1,0,0,123,0.2\n")
    row = readers.read_detections(spark, str(good), "equatorial").first()
    assert row["detid"] == "123" and row["ast_ucty"] == pytest.approx(0.2 / 3600 * math.pi / 180) and row["obs_vx"] is None
    with pytest.raises(ValueError):
        readers.detections(spark.createDataFrame([(1.0, 2.0)], "ra double, epoch double"))
    with pytest.raises(ValueError):
        readers.detections(spark.createDataFrame([(1.0, 2.0, 3.0)], "ra double, dec double, epoch double"))
    null = spark.createDataFrame([(1.0, 2.0, None, 1.0, 1.0, 1.0)], "ra double, dec double, epoch double, obs_x double, obs_y double, obs_z double")
    with pytest.raises(Exception, match="epoch is null"):
        readers.detections(null).collect()
    ics = tmp_path / "ics.csv"
    ics.write_text("q,e,inc,M0,kappa,id\n30,0.1,0.2,0.5,1,7\n")
    assert readers.read_orbits(spark, str(ics), "keplerian", "ssb", EPOCH).first()["id"] == "7"
    assert config.parse('a: "x # y"\nb: 3.0 # c\n# d: 1\n') == {"a": "x # y", "b": 3.0}


def test_stream_counts(spark, tmp_path):
    from starweft.streaming.live import watch_peaks

    rows, orbit = one_object()
    path = str(tmp_path / "in")
    spark.createDataFrame(rows, SCHEMA).write.parquet(path)
    orb = orbits.spherical(spark.createDataFrame([orbit], "r double, vr double, vo double, inc double, kappa double, id string"), EPOCH)
    seen = []
    stream = watch_peaks(spark.readStream.schema(SCHEMA).parquet(path), orb, 11, 12, lambda df, n: seen.extend(df.collect()), str(tmp_path / "ck"))
    stream.processAllAvailable()
    stream.stop()
    assert any(r["total"] == 20 for r in seen)


def test_orbit_refinement_runs_to_the_tolerance_and_says_so(spark):
    from starweft.operators import orbit_refine

    rows, (r, vr, vo, inc, kappa, _) = one_object()
    start = (float(r * 1.02), vr, vo * 1.01, inc + 0.002, kappa)
    m = spark.createDataFrame([(1, *x[1:], *start) for x in rows] + [(2, *x[1:], *start) for x in rows[:5]], "cluster_id long, epoch double, rho_x double, rho_y double, rho_z double, obs_x double, obs_y double, obs_z double, r double, vr double, vo double, inc double, kappa double")
    got = {x["cluster_id"]: x for x in orbit_refine.optimise(m, ["cluster_id"], EPOCH).collect()}
    assert got[1]["converged"] is True and got[1]["cost"] < got[1]["cost_before"]
    assert got[2]["converged"] is None and got[2]["r"] == start[0]
    cut = orbit_refine.optimise(m, ["cluster_id"], EPOCH, most=60).filter("cluster_id = 1").first()
    assert cut["converged"] is False and cut["cost"] >= got[1]["cost"]


def test_orbit_grids_are_whole(spark, tmp_path, monkeypatch):
    """The range is that of the table's distances, at 60 arcsec; cells that stay open are not passed as final."""
    from starweft.operators import orbit_grid
    from starweft.plans import sky_queries

    spark.createDataFrame([(1.6, "a"), (79.9, "b")], "r double, id string").write.parquet(str(tmp_path / "trial_orbits.parquet"))
    seen = []
    monkeypatch.setattr(orbit_grid, "refine", lambda cells, span, epsilon: seen.append((cells.collect(), epsilon)) or cells)
    sky_queries.orbit_cells(spark, str(tmp_path))
    cells, epsilon = seen[0]
    assert min(c["gamma_lo"] for c in cells) == 1 / 79.9 and max(c["gamma_hi"] for c in cells) == 1 / 1.6 and epsilon == 60.0
    monkeypatch.undo()
    one = spark.createDataFrame([(0.02, 0.04, -1e-4, 1e-4, -1e-4, 1e-4, -1e-4, 1e-4)], ", ".join(f"{b} double" for b in orbit_grid._BOUNDS))
    with pytest.raises(ValueError, match="still"):
        orbit_grid.refine(one, 13.0, 1.0, most_levels=2)
    monkeypatch.setattr(orbit_grid, "rate_grid", lambda orbits, pixel, span: seen.append((pixel, span)) or spark.createDataFrame([("a", 0.0)], "id string, adot double"))
    sky_queries.rate_grid(spark, str(tmp_path))
    assert seen[-1] == (2e-5, 30.0)


def test_tangent_queries_keep_rows_at_the_edge_of_the_plane(spark, monkeypatch):
    from starweft.plans import sky_base, sky_queries

    edge = math.acos(0.01)
    places = [(0.001 * k, 0.001) for k in range(40)] + [(edge, 0.0), (-edge, 0.0), (math.pi, 0.0)]
    rows = [(k, EPOCH, math.cos(a) * math.cos(b), math.sin(a) * math.cos(b), math.sin(b), 1.0, 0.0, 0.0) for k, (a, b) in enumerate(places)]
    monkeypatch.setattr(sky_base, "detections", lambda *_: spark.createDataFrame(rows, SCHEMA))
    assert {r["intid"] for r in sky_queries.tangent_projection(spark, "").collect()} >= set(range(41))
    assert 42 not in {r["intid"] for r in sky_queries.tangent_projection(spark, "").collect()}


def test_registered_searches_have_the_default_resolution(spark, monkeypatch):
    """12 unrelated points within some arcmin are no peak, 12 at one place are; linked objects take the linker's defaults."""
    from starweft.plans import sky_base, sky_queries

    (_, *one), orbit = one_object(1, 1)[0][0], one_object(1, 1)[1]
    rng = np.random.default_rng(4)
    spread = []
    for k in range(12):
        v = np.array(one[1:4]) + rng.uniform(-1, 1, 3) * 7e-4
        spread.append((100 + k, one[0], *map(float, v / np.linalg.norm(v)), *one[4:]))
    orb = orbits.spherical(spark.createDataFrame([orbit], "r double, vr double, vo double, inc double, kappa double, id string"), EPOCH)
    monkeypatch.setattr(sky_base, "trial_orbits", lambda *_: orb)
    for rows, totals in ((spread, []), ([(k, *one) for k in range(12)], [12])):
        monkeypatch.setattr(sky_base, "detections", lambda *_, rows=rows: spark.createDataFrame(rows, SCHEMA))
        for query in (sky_queries.dense_search, sky_queries.centred_dense_search):
            assert [r["total"] for r in query(spark, "").collect()] == totals
    seen = []
    for name in ("hpix_linker", "point_linker"):
        monkeypatch.setattr(linker, name, lambda *a, **k: seen.append((len(a), k)))
    sky_queries.linked_objects(spark, "")
    sky_queries.point_linker(spark, "")
    assert seen == [(3, {}), (2, {})] and sky_queries.PIXEL == pytest.approx(math.radians(1 / 3600))


def test_rejecting_queries_take_the_default_threshold(spark, monkeypatch):
    from starweft.plans import sky_queries

    t = np.arange(20) * 1.5 - 15
    s = 0.2 * math.pi / 180 / 3600
    x, y = 1e-3 + 2e-5 * t + 2.5e-2 * np.sin(t / 10), -2e-3 + 1e-5 * t + 2.5e-2 * np.cos(t / 10)
    x[8] += 20 * s
    rows = [(1, i, *map(float, (t[i], np.sin(t[i] / 10), np.cos(t[i] / 10), x[i], y[i], s))) for i in range(20)]
    monkeypatch.setattr(sky_queries, "_fit_rows", lambda *_: spark.createDataFrame(rows, "cluster_id long, intid long, t double, f double, g double, x double, y double, sigma double"))
    assert sky_queries.rejecting_fits(spark, "").first()["rejected"] == [8]
    assert 8 in sky_queries.fraction_rejecting_fits(spark, "").first()["rejected"]


def test_ranges_that_settle_late(spark):
    """What the unrolled steps leave open goes on in the loop to the same end; without the loop it would be dropped."""
    rows = []
    for k, b in enumerate(np.linspace(-0.02, 0.02, 60).tolist()):  # lines that graze the sphere
        rows.append((k, EPOCH, math.sqrt(1 - b * b), b, 0.0, 0.0, -1.0, 0.0))
    orb = orbits.spherical(spark.createDataFrame([(1.0002, 0.005, 0.017, 0.1, 1.0, "a")], "r double, vr double, vo double, inc double, kappa double, id string"), EPOCH)
    pairs = sync.each_orbit(sync.with_dots(spark.createDataFrame(rows, SCHEMA)), sync.flat_orbits(orb))
    few, looped, unrolled = ({r["intid"]: r["rho"] for r in sync.solve_range(pairs, steps=n, most=m).collect()} for n, m in ((1, 1), (1, 100), (12, 12)))
    lost = [k for k, v in few.items() if math.isnan(v) and not math.isnan(unrolled[k])]
    assert lost and all(looped[k] == pytest.approx(v, nan_ok=True, abs=1e-9) for k, v in unrolled.items())
    newton = {r["intid"]: r["rho"] for r in sync.newton_range(pairs, steps=1).collect()}
    settled = {r["intid"]: r["rho"] for r in sync.newton_range(pairs, steps=30).collect()}
    assert all(newton[k] == pytest.approx(settled[k], nan_ok=True, abs=1e-9) for k in settled)


def test_orbits_in_blocks(spark, monkeypatch):
    """More orbits than may be broadcast at once go in blocks, with the same result."""
    rows, orbit = one_object()
    orb = orbits.spherical(spark.createDataFrame([(*orbit[:5], f"o{k}") for k in range(9)], "r double, vr double, vo double, inc double, kappa double, id string"), EPOCH)
    det = spark.createDataFrame(rows, SCHEMA)
    whole = sorted(map(tuple, sync.sync(det, orb).select("intid", "ic_id", "s_x").collect()))
    monkeypatch.setattr(sync, "BROADCAST_ROWS", 4)
    assert sorted(map(tuple, sync.sync(det, orb).select("intid", "ic_id", "s_x").collect())) == whole and len(whole) == 180


def test_inclination_sweep_against_numpy(spark):
    rows, orbit = one_object(3, 3)
    orb = orbits.spherical(spark.createDataFrame([(orbit[0], orbit[1], orbit[2], None, None, "flat")], "r double, vr double, vo double, inc double, kappa double, id string"), EPOCH)
    got = {(r["intid"], r["inc_no"]): (r["s_x"], r["s_y"], r["s_z"]) for r in sync.inclination_sweep(spark.createDataFrame(rows, SCHEMA), orb).collect()}
    from starweft.operators.orbit_refine import np_sync

    m = np.array([x[1:] for x in rows])
    for k in range(100):
        inc = math.acos(1 - 2 * (k + 0.5) / 100)
        s = np_sync(m[:, 1:4], m[:, 4:7], m[:, 0], *orbit[:3], inc, 1.0, EPOCH, MU_BARY)
        s /= np.linalg.norm(s, axis=1, keepdims=True)
        for i in range(3):
            if (i, k) in got:
                assert np.allclose(got[i, k], s[i], atol=1e-6)
    assert {k for _, k in got} and all(abs(1 - 2 * (k + 0.5) / 100) <= 1 for _, k in got)


def test_fraction_rejection(spark):
    """A tenth of the kept members goes at a time until all pulls are below 5."""
    t = np.arange(30) * 1.5 - 20
    s = 0.2 * math.pi / 180 / 3600
    f, g = np.sin(t / 10), np.cos(t / 10)
    x, y = 1e-3 + 2e-5 * t + 2.5e-2 * f, -2e-3 + 1e-5 * t + 2.5e-2 * g
    x[[4, 11]] += 60 * s
    kept = fits.reject_outliers(t, f, g, x, y, np.full(30, s), np.full(30, s), fraction=0.1)
    assert set(kept[2]) >= {4, 11} and len(kept[2]) % 3 == 0 and kept[0]["pull"].max() < 5


def test_covariance_of_the_joint_fit(spark):
    rng = np.random.default_rng(5)
    t = np.sort(rng.uniform(-20, 20, 25))
    f, g, s = np.sin(t / 9), np.cos(t / 7), rng.uniform(1, 3, 25) * 1e-6
    x, y = 1e-3 + 2e-5 * t + 2.5e-2 * f + s * rng.normal(size=25), -2e-3 + 1e-5 * t + 2.5e-2 * g + s * rng.normal(size=25)
    rows = [(1, i, *map(float, v)) for i, v in enumerate(zip(t, f, g, x, y, s))]
    got = fits.coupled_fit(spark.createDataFrame(rows, "k int, intid long, t double, f double, g double, x double, y double, sigma double"), ["k"]).first()
    want = fits.np_fit(t, f, g, x, y, s, s)
    assert np.allclose(np.array(got["covariance"]).reshape(5, 5), want["cov"], rtol=1e-6, atol=1e-6 * np.abs(want["cov"]).min())
    assert got["chi2"] == pytest.approx(want["chi2"], rel=1e-6)


def test_sinks(spark, tmp_path):
    import struct
    import zlib

    from starweft.sources import sinks

    cells = spark.createDataFrame([(0, 0, 10), (2, 1, 300), (5, 5, 1)], "ix long, iy long, grey int")
    path = str(tmp_path / "a.png")
    sinks.png(cells, path, 3, 2)
    data = open(path, "rb").read()
    assert struct.unpack(">II", data[16:24]) == (3, 2)
    at = data.index(b"IDAT")
    assert zlib.decompress(data[at + 4 : at + 4 + struct.unpack(">I", data[at - 4 : at])[0]]) == bytes([0, 0, 0, 255, 0, 10, 0, 0])
    rows, orbit = one_object()
    fit = spark.createDataFrame([("k", 0.1, 0.2, 0.3, 0.4, 0.5, 1.25, 2, 1, [0, 1])], "ic_id string, a double, b double, c double, d double, e double, sigma double, n long, n_rejected long, kept array<long>")
    line = sinks.fit_report(fit, ["ic_id"]).first()["line"]
    assert line.startswith("# Fit of k: a=1.0") and line.endswith("sigma=1.2500 kept 2 rejected 1")
    members = spark.createDataFrame([("k", i, 1.0, 2.0, 3.0, 1.3, 2.3, 0.5, 1.0, 0.0, 0.0) for i in range(3)], "ic_id string, intid long, t double, f double, g double, x double, y double, sigma double, s_x double, s_y double, s_z double")
    out = sinks.fit_members(fit, members, ["ic_id"]).collect()
    assert len(out) == 2 and out[0]["pull_x"] == pytest.approx((1.3 - (0.1 + 0.2 + 0.6)) / 0.5) and out[0]["ra"] == pytest.approx(0.0)


def test_observations_of_all_kinds(spark):
    from starweft.operators import observations as o

    cols = "kind string, ra double, dec double, ra_rate double, dec_rate double, range double, range_rate double, covariance array<double>"
    four = np.diag([1.0, 2.0, 4.0, 5.0]) + 0.1
    rows = [("astrometry", 10.0, 5.0, None, None, None, None, [4.0, 1.0, 1.0, 3.0]), ("streak", 10.0, 60.0, 0.3, 0.4, None, None, four.ravel().tolist()), ("radar", None, None, None, None, 2.0, 3.0, None), ("astrometry", 1.0, 2.0, None, None, None, None, [1.0, 1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, cols)
    out = o.with_derived(o.inverses(df)).withColumn("text", o.shown()).collect()
    assert np.allclose(out[0]["inverse_covariance"], np.linalg.inv([[4.0, 1.0], [1.0, 3.0]]).ravel()) and np.allclose(out[1]["inverse_covariance"], np.linalg.inv(four).ravel())
    assert out[1]["proper_motion"] == pytest.approx(math.sqrt(0.3**2 * 0.25 + 0.4**2)) and out[0]["proper_motion"] is None and out[3]["inverse_covariance"] is None
    assert out[2]["text"] == "Radar Range: 2.000000 Range rate: 3.000000" and out[0]["text"] == "Astrometry RA: 10.000000 Dec: 5.000000"
    back = o.inverses(o.inverses(df), "inverse_covariance", "again").first()["again"]
    assert np.allclose(back, [4.0, 1.0, 1.0, 3.0])
    with pytest.raises(Exception, match="singular"):
        o.inverses(spark.createDataFrame([("complete", 1.0, 1.0, 0.0, 0.0, 1.0, 0.0, [1.0, 1.0, 1.0, 1.0])], cols)).collect()


def test_runs_from_settings(spark, tmp_path):
    """The settings' thresholds reach every search."""
    from starweft.plans import run

    rows, orbit = one_object()
    head = "intid,ra,dec,epoch,obs_x,obs_y,obs_z\n"
    lines = []
    for r in rows:
        x, y, z = r[2], COS_OBLIQUITY * r[3] - SIN_OBLIQUITY * r[4], SIN_OBLIQUITY * r[3] + COS_OBLIQUITY * r[4]
        o = (r[5], COS_OBLIQUITY * r[6], SIN_OBLIQUITY * r[6])
        lines.append(f"{r[0]},{math.degrees(math.atan2(y, x)) % 360!r},{math.degrees(math.asin(z))!r},{r[1]!r},{o[0]!r},{o[1]!r},{o[2]!r}\n")
    (tmp_path / "cat.csv").write_text(head + "".join(lines))
    (tmp_path / "ics.csv").write_text("r,vr,vo,inc,kappa,id\n" + ",".join(map(repr, orbit[:5])) + ",right\n")
    text = lambda n, nights, eps: "\n".join(f"{k}: {v}" for k, v in dict(epsilon_arcsec=eps, min_detections=n, max_detections=99, min_duration=20.0, min_nites=nights, spice_path="x", detection_catalog=str(tmp_path / "cat.csv"), initial_conditions_file=str(tmp_path / "ics.csv"), reference_epoch=EPOCH, orbit_reference_plane="ecliptic", ic_type="spherical", ic_origin="ssb", output_path="o", clusters_filename="c").items())
    good, many = config.of(text(12, 6, 60.0)), config.of(text(21, 6, 60.0))
    assert {tuple(sorted(r["kept"])) for r in run.pixels(spark, good, depth=12).collect()} == {tuple(range(20))}
    assert run.pixels(spark, many, depth=12).count() == 0
    assert run.points(spark, good).select("intid").distinct().count() == 20 and run.points(spark, config.of(text(12, 20, 60.0))).count() == 0
    assert run.dense(spark, config.of(text(12, 6, 900.0))).count() >= 1 and run.dense(spark, config.of(text(21, 6, 900.0))).count() == 0
    with pytest.raises(ValueError, match="lack"):
        config.of("epsilon_arcsec: 3")
    with pytest.raises(SystemExit):
        run.main(["dense"])


def test_tangent_search_against_numpy(spark):
    """Grid, extents, peaks and the best place of every rate orbit, from the tangent-plane points on."""
    from collections import Counter

    rng = np.random.default_rng(12)
    rows = []
    for k in range(400):
        a, b = (0.01 * rng.normal(), 0.01 * rng.normal()) if k % 2 else (rng.uniform(-1.2, 1.2), rng.uniform(-1.2, 1.2))
        t = EPOCH + float(rng.integers(0, 12))
        rows.append((k, t, math.cos(a) * math.cos(b), math.sin(a) * math.cos(b), math.sin(b), math.cos(t / 58), math.sin(t / 58), 0.0))
    points = linker.tangent_points(spark.createDataFrame(rows, SCHEMA))
    rates = spark.createDataFrame([(30.0, 0.0, 1e-4, 0.0, "a"), (45.0, 1e-4, -5e-5, 2e-5, "b"), (2.0, 0.001, 1e-3, -1e-3, "c")], "r double, vr double, adot double, bdot double, id string")
    pixel, p = 0.004, points.collect()
    want_cells, want_best = {}, {}
    for r in rates.collect():
        ab = []
        for x in p:
            gamma = 1 / r["r"]
            rho = math.sqrt((1 + x["mean_x"] ** 2 + x["mean_y"] ** 2) * (1 / gamma - x["ze"]) ** 2)
            tp = x["epoch"] - EPOCH - rho / 173.14463267424034
            f = 1 - 0.5 * MU_BARY * gamma**3 * tp**2
            fac = 1 + tp / f * (r["vr"] * gamma) - gamma / f * x["ze"]
            ab.append((x["theta_x"] * fac + gamma / f * x["xe"] - tp / f * r["adot"], x["theta_y"] * fac + gamma / f * x["ye"] - tp / f * r["bdot"]))
        ab = np.array(ab)
        low = ab.min(axis=0)
        most = np.maximum(np.ceil((ab.max(axis=0) - low) / pixel), 1) - 1
        n = Counter(map(tuple, np.minimum(np.floor((ab - low) / pixel), most).astype(int).tolist()))
        around = lambda c, n=n: [n.get((c[0] + i, c[1] + j), 0) for i in (-1, 0, 1) for j in (-1, 0, 1)]
        found = {c: sum(around(c)) for c, v in n.items() if v >= 3 and max(around(c)) <= v}
        want_cells |= {(r["id"], *c): v for c, v in n.items()}
        good = {c: v for c, v in found.items() if v >= 12}
        if good:
            c = min(good, key=lambda c: (-good[c], c))
            want_best[r["id"]] = (len(good), *c, good[c], *((np.array(c) + 0.5) * pixel + low))
    cells, _ = linker.tangent_cells(points, rates, EPOCH, pixel)
    assert {(r["ic_id"], r["i"], r["j"]): r["n"] for r in cells.collect()} == want_cells
    got = {r["ic_id"]: (r["peaks"], r["i"], r["j"], r["total"], r["alpha"], r["beta"]) for r in linker.tangent_search(points, rates, EPOCH, pixel).collect()}
    assert set(got) == set(want_best) and got
    for k, v in got.items():
        assert v[:4] == want_best[k][:4] and v[4:] == pytest.approx(want_best[k][4:])


def test_axis_separations_against_pairs_of_corners():
    from starweft.operators import orbit_grid

    rng = np.random.default_rng(3)
    lo = np.stack([rng.uniform(0.02, 0.5, 40), *(rng.uniform(-2e-3, 2e-3, 40) for _ in range(3))], axis=1)
    cells = np.empty((40, 8))
    cells[:, ::2], cells[:, 1::2] = lo, lo + np.abs(rng.normal(size=(40, 4))) * [0.02, 1e-4, 1e-4, 1e-4]
    for epsilon in (1.0, 50.0, 1e9):
        got = orbit_grid.axis_separations(cells, 13.0, MU_BARY, epsilon)
        for n, cell in enumerate(cells):
            for axis in range(4):
                others = [a for a in range(4) if a != axis]
                best = 0.0
                for corner in range(8):
                    ends = []
                    for e in (0, 1):
                        v = np.zeros((1, 4))
                        v[0, axis] = cell[2 * axis + e]
                        for bit, a in zip((4, 2, 1), others):
                            v[0, a] = cell[2 * a + (1 if corner & bit else 0)]
                        ends.append(orbit_grid._scaled(v))
                    s = float(orbit_grid.separation(*ends, 6.5, MU_BARY)[0])
                    best = max(best, s)
                    if s > epsilon:
                        best = s
                        break
                assert got[n, axis] == pytest.approx(best, rel=1e-6, abs=1e-3)


def test_searches_side_by_side_make_the_moves_of_single_ones():
    starts, calls = np.random.default_rng(5).normal(size=(200, 3)), []

    def cost(p, at):
        calls.append(len(p))
        return ((p - np.array([1.0, 2.0, 3.0])) ** 2).sum(axis=1) + p[:, 0] * p[:, 1]

    best, least, converged = fits.nelder_meads(cost, starts, (0.1, 0.1, 0.1))
    for k in (0, 77, 199):
        p, v, done = fits.nelder_mead(lambda q: float(cost(q[None], None)[0]), starts[k], (0.1, 0.1, 0.1))
        assert np.array_equal(p, best[k]) and v == least[k] and done == converged[k]
    assert sum(calls) > 30 * len(calls[:1000]) and len([c for c in calls if c > 1]) < 2000


def _crowd(spark, noise=60):
    rows, orbit = one_object(noise=noise)
    rows += [(5000, None, 1.0, 0.0, 0.0, 1.0, 0.0, 0.0), (5001, EPOCH, None, 0.0, 0.0, 1.0, 0.0, 0.0), (5002, EPOCH, 0.0, 0.0, 1.0, 1.0, 0.0, 0.0)]
    table = [orbit, (60.0, 0.0, 0.002, 0.1, -1.0, "wrong"), (1.7, 0.0, 0.013, 2.9, 1.0, "near"), (None, 0.0, 0.013, 0.3, 1.0, "none")]
    orb = orbits.spherical(spark.createDataFrame(table, "r double, vr double, vo double, inc double, kappa double, id string"), EPOCH)
    return spark.createDataFrame(rows, SCHEMA), orb.cache()


def test_newton_sums_row_by_row(spark):
    from starweft.operators import passes

    det, orb = _crowd(spark)
    rows, want = [r.asDict() for r in sync.with_dots(det).collect()], {}
    for o in sync.flat_orbits(orb).collect():
        found = []
        for d in rows:
            rho = o["o_r"] - 1.0
            for _ in range(100):
                x = (d["epoch"] - rho / 173.14463267424034 - EPOCH) / 365.25
                rt = o["o_r0"] + x * (o["o_r1"] + x * (o["o_r2"] + x * o["o_r3"]))
                cost = d["obs2"] + 2 * rho * d["rho_dot_obs"] + rho * rho - rt * rt
                if abs(cost) < 1e-8:
                    found.append(rho)
                    break
                rho -= cost / (2 * (rho + d["rho_dot_obs"]))
        want[o["ic_id"]] = (len(found), pytest.approx(sum(found), rel=1e-12))
    assert want["right"][0] >= 20 and want["none"][0] == 0
    assert {r["ic_id"]: (r["n"], r["total"]) for r in passes.newton_sums(det, orb).collect()} == want


def test_sweep_counts_against_the_product(spark):
    from starweft.operators import passes

    det, orb = _crowd(spark)
    want = {tuple(r) for r in sync.inclination_sweep(det, orb).groupBy("ic_id", "inc_no").agg(F.count("*").alias("n")).collect()}
    assert len(want) == 300 and {tuple(r) for r in passes.sweep_counts(det, orb).collect()} == want


@pytest.mark.parametrize("centred", [False, True])
def test_dense_search_by_task_and_by_shuffle(spark, monkeypatch, centred):
    from starweft.operators import passes

    det, orb = _crowd(spark)
    by_task = sorted(map(tuple, linker.dense_search(det, orb, 20_000.0, 6, centred).collect()))
    monkeypatch.setattr(passes, "PASS_ROWS", 0)
    assert by_task and by_task == sorted(map(tuple, linker.dense_search(det, orb, 20_000.0, 6, centred).collect()))
    monkeypatch.undo()
    plan = linker.dense_search(det, orb)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan  # the product is not shuffled


def test_clusters_by_task_and_by_shuffle(spark, monkeypatch):
    from starweft.operators import passes

    det, orb = _crowd(spark, noise=40)

    def found():
        return sorted((r["ic_id"], r["hpix"], r["total"], r["intid"], round(r["theta_x"], 12), round(r["xe"], 12)) for r in linker.clusters(det, orb, EPOCH, 9, 600.0).collect())

    monkeypatch.setattr(passes, "PAIRS", 30)
    by_task = found()
    sums = {(r["ic_id"], r["hpix"]): (r["n"], r["members"]) for r in linker.cluster_sums(det, orb, EPOCH, 9, 600.0).collect()}
    monkeypatch.setattr(passes, "PASS_ROWS", 0)
    assert by_task and by_task == found()
    ids = {k: [r[3] for r in by_task if r[:2] == k] for k in sums}
    assert sums == {k: (len(v), sum(v)) for k, v in ids.items()} and sum(map(len, ids.values())) == len(by_task)
