"""Detections moved to where the object of a trial orbit would be at the reference epoch.

All of it is Column expressions over detections x orbits (a stated cross product: the orbits are few, are checked to be, and
are broadcast), so it is one generated loop without a shuffle. What depends on the detection or on the orbit alone is
computed before the product. Defined results: an unreachable, unconverged or non-finite result is dropped (or null with
keep_all); nulls in a position or direction give the same.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import LIGHT_AU_PER_DAY
from ..functions.geometry import Vec
from ..staging import BROADCAST_ROWS

STEPS = 6  # unrolled; what is not settled by then goes on in a loop
MOST_STEPS = 100
TOLERANCE = 1e-6


def nan() -> Column:
    return F.lit(float("nan"))


def _number(c: str) -> Column:
    """A column without nulls: NaN runs through all arithmetic by itself, and the generated code stays small enough for the
    JVM to compile it."""
    return F.coalesce(F.col(c).cast("double"), nan())


def with_dots(detections: DataFrame) -> DataFrame:
    """rho . R and R^2 of each detection, computed once."""
    numbers = ["epoch", *[f"{p}_{c}" for p in ("rho", "obs") for c in "xyz"]]
    df = detections.withColumns({c: _number(c) for c in numbers})
    rho, obs = Vec.of("rho"), Vec.of("obs")
    return df.withColumns({"rho_dot_obs": rho.dot(obs), "obs2": obs.dot(obs)})


def flat_orbits(orbits: DataFrame) -> DataFrame:
    """Orbits with their series as coefficients of powers, in columns without nulls."""
    out = [F.col("id").alias("ic_id")] + [_number(c).alias(f"o_{c}") for c in ("r", "kappa", "orbit_epoch", "mu", "h", "energy", "cos_inc", "sin_lat", "bounds")]
    for name in ("r", "vr", "f", "g"):
        c = [F.coalesce(F.get(F.col(f"{name}_poly"), F.lit(k)), nan()) for k in range(4)]
        for k, power in enumerate((c[0] - c[2], c[1] - 3.0 * c[3], 2.0 * c[2], 4.0 * c[3])):
            out.append(power.alias(f"o_{name}{k}"))
    return orbits.select(*out)


def _series(name: str, x: Column) -> Column:
    c = [F.col(f"o_{name}{k}") for k in range(4)]
    return c[0] + x * (c[1] + x * (c[2] + x * c[3]))


def each_orbit(detections: DataFrame, orbits: DataFrame) -> DataFrame:
    """The stated product; orbits are counted first, so the broadcasts have a known size. Beyond it orbits go in blocks, each
    a product of its own."""
    n = orbits.count()
    if n <= BROADCAST_ROWS:
        return detections.crossJoin(F.broadcast(orbits))
    blocks = -(-2 * n // BROADCAST_ROWS)
    return reduce(DataFrame.unionByName, [detections.crossJoin(F.broadcast(orbits.filter(F.pmod(F.xxhash64("ic_id"), F.lit(blocks)) == k))) for k in range(blocks)])


def _loop(start: Column, going: Column, step, steps: int) -> Column:
    """start where it is settled; else the end of up to `steps` further steps of a struct (v, gap). The loop is worked out for
    the rows that need it only."""
    def more(acc: Column, _: Column) -> Column:
        return F.when(acc["gap"] < TOLERANCE, acc).otherwise(step(acc))

    first = F.struct(start.alias("v"), F.lit(1.0).alias("gap"))
    last = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), first, more)
    return F.when(going, F.when(last["gap"] < TOLERANCE, last["v"]).otherwise(nan())).otherwise(start)


def solve_range(pairs: DataFrame, sign: float = 1.0, steps: int = STEPS, most: int = MOST_STEPS) -> DataFrame:
    """rho and r_at: the range at which the line of sight meets the orbit's distance, light time included; NaN where the
    line misses it or the fixed point does not settle within `most` steps. The first steps are unrolled, since lambdas are
    not code-generated; the step after the first settled one changes nothing."""
    keep = pairs.columns
    df = pairs.select(*keep, (F.col("o_r") - 1.0).alias("rho"), F.lit(1.0).alias("gap"), (F.col("rho_dot_obs") * F.col("rho_dot_obs") - F.col("obs2")).alias("miss2"))

    def at(rho: Column) -> Column:
        return (F.col("epoch") - rho / LIGHT_AU_PER_DAY - F.col("o_orbit_epoch")) / F.col("o_bounds")

    def met(rt: Column) -> Column:
        return sign * F.sqrt(rt * rt + F.col("miss2")) - F.col("rho_dot_obs")

    for _ in range(steps):
        df = df.select(*keep, "rho", "gap", "miss2", at(F.col("rho")).alias("x"))
        df = df.select(*keep, "rho", "gap", "miss2", _series("r", F.col("x")).alias("rt"))
        new = F.when(F.col("gap") < TOLERANCE, F.col("rho")).otherwise(met(F.col("rt")))
        df = df.select(*keep, F.col("rho").alias("old"), "gap", "miss2", new.alias("rho"))
        df = df.select(*keep, "rho", F.when(F.col("gap") < TOLERANCE, F.col("gap")).otherwise(F.abs(F.col("rho") - F.col("old"))).alias("gap"), "miss2")

    def step(acc: Column) -> Column:
        rho = met(_series("r", at(acc["v"])))
        return F.struct(rho.alias("v"), F.abs(rho - acc["v"]).alias("gap"))

    # NaN is settled: it stays what it is
    open_ = (F.col("gap") >= TOLERANCE) & ~F.isnan("rho")
    df = df.select(*keep, (_loop(F.col("rho"), open_, step, most - steps) if most > steps else F.when(open_, nan()).otherwise(F.col("rho"))).alias("rho"))
    return df.select(*keep, "rho", F.sqrt(F.col("rho") * F.col("rho") + 2.0 * F.col("rho") * F.col("rho_dot_obs") + F.col("obs2")).alias("r_at"))


def _sync_vectors(df: DataFrame, velocity: str) -> DataFrame:
    """The orbit's position and velocities at the detection's light-corrected time, and f and g at the mirrored one."""
    keep = df.columns
    p = [(F.col(f"obs_{c}") + F.col("rho") * F.col(f"rho_{c}")).alias(f"p_{c}") for c in "xyz"]
    df = df.select(*keep, *p, (F.col("epoch") - F.col("rho") / LIGHT_AU_PER_DAY).alias("t_light"))
    ahead = (F.col("t_light") - F.col("o_orbit_epoch")) / F.col("o_bounds")
    df = df.select(*keep, "p_x", "p_y", "p_z", "t_light", ahead.alias("u"), (F.col("o_h") / F.col("r_at")).alias("v_tan"), F.sqrt(F.col("p_x") * F.col("p_x") + F.col("p_y") * F.col("p_y")).alias("xy"))
    v2 = 2.0 * F.greatest(F.col("o_energy") + F.col("o_mu") / F.col("r_at"), F.lit(0.0)) - F.col("v_tan") * F.col("v_tan")
    radial = _series("vr", F.col("u")) if velocity == "signed" else F.sqrt(F.greatest(v2, F.lit(0.0)))
    return df.select(*keep, "p_x", "p_y", "p_z", "t_light", "u", "v_tan", "xy", radial.alias("v_rad"), _series("f", -F.col("u")).alias("f_m"), _series("g", -F.col("u")).alias("g_m"))


def _point(df: DataFrame, keep: list[str], cos_psi: Column, sin_psi_sign: Column) -> DataFrame:
    """keep and the moved point times the orbit's distance (q_x, q_y, q_z); NaN where the inclination cannot hold it."""
    df = df.select(*keep, "p_x", "p_y", "p_z", "xy", "r_at", "v_tan", "v_rad", "f_m", "g_m", cos_psi.alias("cos_psi"))
    sin_psi = sin_psi_sign * F.sqrt(1.0 - F.col("cos_psi") * F.col("cos_psi"))
    across = F.col("g_m") * F.col("v_tan") * F.col("cos_psi") / F.col("xy")
    up = F.col("g_m") * F.col("v_tan") * sin_psi / (F.col("r_at") * F.col("xy"))
    along = F.col("f_m") + F.col("g_m") * F.col("v_rad") / F.col("r_at")
    df = df.select(*keep, "p_x", "p_y", "p_z", "xy", across.alias("across"), up.alias("up"), along.alias("along"))
    x, y, z, a, b, k = (F.col(c) for c in ("p_x", "p_y", "p_z", "across", "up", "along"))
    return df.select(*keep, (k * x - a * y - b * z * x).alias("q_x"), (k * y + a * x - b * z * y).alias("q_y"), (k * z + b * F.col("xy") * F.col("xy")).alias("q_z"))


def _pairs(detections: DataFrame, orbits: DataFrame) -> tuple[DataFrame, list[str]]:
    """The product with what all syncs need, and the columns of the detections to hand on."""
    return each_orbit(with_dots(detections), flat_orbits(orbits)), detections.columns


def sync(detections: DataFrame, orbits: DataFrame, keep_all: bool = False, velocity: str = "absolute") -> DataFrame:
    """detections x orbits with the synced point (s_x, s_y, s_z), not of exactly unit length, and `extrapolated`.

    `velocity`: 'absolute' takes the radial velocity as not negative, 'signed' takes its sign from the orbit.
    """
    pairs, own = _pairs(detections, orbits)
    df = _sync_vectors(solve_range(pairs), velocity)
    keep = [*own, "ic_id", "rho", "r_at", "t_light", "u", "o_r"]
    reach = F.abs(F.col("p_z") / F.col("r_at")) <= F.col("o_sin_lat")
    df = df.withColumn("reach", reach)
    df = _point(df, [*keep, "reach", "o_kappa"], F.col("o_cos_inc") * F.col("r_at") / F.col("xy"), F.col("o_kappa"))
    good = F.col("reach") & ~F.isnan(F.col("q_x") + F.col("q_y") + F.col("q_z"))
    values = [F.col("rho"), F.col("r_at"), F.col("t_light"), (F.abs("u") > 1.0).alias("extrapolated"), *[(F.col(f"q_{c}") / F.col("o_r")).alias(f"s_{c}") for c in "xyz"]]
    return _generated(df, [*own, "ic_id"], good, values, keep_all)


def _generated(df: DataFrame, keep: list[str], good: Column, values: list[Column], keep_all: bool = False) -> DataFrame:
    """keep and values of the rows for which `good` holds. Rows are dropped by exploding a null, not by a filter: a filter
    would be pushed through the unrolled steps, each of which it would copy into itself."""
    names = [f"{k}" for k in df.select(*values).columns]
    one = F.when(good, F.array(F.struct(*values)))
    out = df.select(*keep, (F.explode_outer(one) if keep_all else F.explode(one)).alias("__s"))
    return out.select(*keep, *[F.col(f"__s.{n}").alias(n) for n in names])


def inclination_sweep(detections: DataFrame, orbits: DataFrame, steps: int = 100) -> DataFrame:
    """Synced unit vectors for inclinations uniform in their cosine, of orbits without one. Range, position and velocities
    are worked out once per detection and orbit, then met with each inclination (a product of a fixed size). An unsettled
    range takes the orbit's own distance; the sense is always direct."""
    pairs, own = _pairs(detections, orbits)
    df = solve_range(pairs)
    df = df.withColumns({c: F.when(F.isnan(c), F.col("o_r")).otherwise(F.col(c)) for c in ("rho", "r_at")})
    df = _sync_vectors(df, "absolute")
    cosines = F.array(*[F.struct(F.lit(k).alias("inc_no"), F.lit(1.0 - 2.0 * (k + 0.5) / steps).alias("cos_i")) for k in range(steps)])
    used = ["p_x", "p_y", "p_z", "xy", "r_at", "v_tan", "v_rad", "f_m", "g_m"]
    df = df.select(*own, "ic_id", *used, F.explode(cosines).alias("i"))
    df = df.select(*own, "ic_id", *used, F.col("i.inc_no").alias("inc_no"), F.col("i.cos_i").alias("cos_i"), (F.abs(F.col("p_z") / F.col("r_at")) <= F.sqrt(1.0 - F.col("i.cos_i") * F.col("i.cos_i"))).alias("reach"))
    df = _point(df, [*own, "ic_id", "inc_no", "reach"], F.col("cos_i") * F.col("r_at") / F.col("xy"), F.lit(1.0))
    good = F.col("reach") & ~F.isnan(F.col("q_x") + F.col("q_y") + F.col("q_z"))
    out = _generated(df, [*own, "ic_id", "inc_no"], good, [F.col(f"q_{c}") for c in "xyz"])
    n = Vec.of("q").norm()
    return out.select(*own, "ic_id", "inc_no", *[(F.col(f"q_{c}") / n).alias(f"s_{c}") for c in "xyz"])


def newton_range(pairs: DataFrame, steps: int = 12, most: int = MOST_STEPS) -> DataFrame:
    """rho by Newton's method on |R + rho rho_hat|^2 = r(t)^2, the light time's own slope left out; NaN where the cost does
    not fall below 1e-8 within `most` steps, the first of which are unrolled."""
    keep = pairs.columns
    df = pairs.select(*keep, (F.col("o_r") - 1.0).alias("rho"), F.lit(1.0).alias("cost"))

    def at(rho: Column) -> Column:
        return (F.col("epoch") - rho / LIGHT_AU_PER_DAY - F.col("o_orbit_epoch")) / F.col("o_bounds")

    def cost(rho: Column, rt: Column) -> Column:
        return F.col("obs2") + 2.0 * rho * F.col("rho_dot_obs") + rho * rho - rt * rt

    def down(rho: Column, c: Column) -> Column:
        return F.try_divide(c, 2.0 * (rho + F.col("rho_dot_obs")))

    for _ in range(steps):
        df = df.select(*keep, "rho", _series("r", at(F.col("rho"))).alias("rt"))
        df = df.select(*keep, "rho", cost(F.col("rho"), F.col("rt")).alias("cost"))
        df = df.select(*keep, (F.col("rho") - F.when(F.abs("cost") < 1e-8, F.lit(0.0)).otherwise(down(F.col("rho"), F.col("cost")))).alias("rho"), "cost")

    def step(acc: Column) -> Column:
        c = cost(acc["v"], _series("r", at(acc["v"])))
        # settled costs are told by a gap below the tolerance of the loop
        return F.struct(F.when(F.abs(c) < 1e-8, acc["v"]).otherwise(F.coalesce(acc["v"] - down(acc["v"], c), nan())).alias("v"), F.when(F.abs(c) < 1e-8, F.lit(0.0)).otherwise(F.lit(1.0)).alias("gap"))

    open_ = (F.abs("cost") >= 1e-8) & ~F.isnan("rho")
    return df.select(*keep, F.when(F.col("rho").isNull(), nan()).otherwise(_loop(F.col("rho"), open_, step, most - steps)).alias("rho"))


def _tangent_terms(points: DataFrame, rate_orbits: DataFrame, mu: float, ref_epoch: float) -> DataFrame:
    """Points or exposures x rate orbits with what moves theta to alpha and beta: theta * fac + on - off, for x and y."""
    rates = rate_orbits.select(F.col("id").alias("ic_id"), (1.0 / F.col("r")).alias("gamma"), (F.col("vr") / F.col("r")).alias("gdot"), "adot", "bdot")
    df = each_orbit(points, rates)
    gamma = F.col("gamma")
    depth = 1.0 / gamma - F.col("ze")
    df = df.withColumn("rho", F.sqrt((1.0 + F.col("mean_x") * F.col("mean_x") + F.col("mean_y") * F.col("mean_y")) * depth * depth))
    df = df.withColumn("tp", F.col("epoch") - ref_epoch - F.col("rho") / LIGHT_AU_PER_DAY)
    df = df.withColumn("f", 1.0 - 0.5 * mu * gamma * gamma * gamma * F.col("tp") * F.col("tp"))
    gf, yf = F.col("tp") / F.col("f"), gamma / F.col("f")
    return df.withColumns({"fac": 1.0 + gf * F.col("gdot") - yf * F.col("ze"), "on_x": yf * F.col("xe"), "on_y": yf * F.col("ye"), "off_x": gf * F.col("adot"), "off_y": gf * F.col("bdot")})


def _moved(theta: str, c: str) -> Column:
    return F.col(theta) * F.col("fac") + F.col(f"on_{c}") - F.col(f"off_{c}")


def tangent_sync(points: DataFrame, rate_orbits: DataFrame, mu: float, ref_epoch: float) -> DataFrame:
    """alpha and beta of each detection on the tangent plane for each rate orbit (r, vr, adot, bdot, id).

    points: tangent-plane rows (exposure_id, epoch, xe, ye, ze, theta_x, theta_y, mean_x, mean_y); one light time per exposure.
    """
    df = _tangent_terms(points, rate_orbits, mu, ref_epoch)
    alpha = F.coalesce(_moved("theta_x", "x"), nan())
    beta = F.coalesce(_moved("theta_y", "y"), nan())
    df = df.select(*points.columns, "ic_id", alpha.alias("alpha"), beta.alias("beta"))
    return _generated(df, [*points.columns, "ic_id"], ~F.isnan(F.col("alpha") + F.col("beta")), [F.col("alpha"), F.col("beta")])


def tangent_extents(points: DataFrame, rate_orbits: DataFrame, mu: float, ref_epoch: float) -> DataFrame:
    """(ic_id, u_min, u_max, v_min, v_max) of what tangent_sync gives, without its product: an exposure and epoch's map is
    affine in theta and keeps the order, so its ends come from the ends of theta."""
    same = ["epoch", "xe", "ye", "ze", "mean_x", "mean_y"]
    whole = points.filter(~F.isnan(F.col("theta_x") + F.col("theta_y")))
    ends = whole.groupBy(*same).agg(*[f(f"theta_{c}").alias(f"{n}_{c}") for c in "xy" for n, f in (("lo", F.min), ("hi", F.max))])
    # few rows that make many: spread them out again before the product
    ends = ends.repartition(points.sparkSession.sparkContext.defaultParallelism, *same)
    image = {f"{n}_{c}": F.coalesce(_moved(f"{n}_{c}", c), nan()) for c in "xy" for n in ("lo", "hi")}
    df = _tangent_terms(ends, rate_orbits, mu, ref_epoch).select("ic_id", *[v.alias(k) for k, v in image.items()])
    df = _generated(df, ["ic_id"], ~F.isnan(F.col("lo_x") + F.col("hi_x") + F.col("lo_y") + F.col("hi_y")), [F.col(k) for k in image])
    return df.groupBy("ic_id").agg(*[f(g(f"lo_{c}", f"hi_{c}")).alias(f"{u}_{n}") for c, u in (("x", "u"), ("y", "v")) for n, f, g in (("min", F.min, F.least), ("max", F.max, F.greatest))])
