"""Detection catalogs and trial orbits from CSV files with a header, by explicit types.

Integer-looking numbers are read as DOUBLE and numeric ids as STRING. Columns beyond the known ones are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.constants import mu_of
from ..functions.geometry import Vec, pointing, to_ecliptic
from ..functions.timescale import utc_to_tdb
from ..operators import orbits

REQUIRED = ["ra", "dec", "epoch"]
NUMBERS = [*REQUIRED, "obs_x", "obs_y", "obs_z", "obs_vx", "obs_vy", "obs_vz", "ast_ucty", "ra_ucty", "dec_ucty", "mag", "mag_ucty"]
STRINGS = ["obscode", "filter", "detid", "objid", "trackid"]
PLANES = {"ecliptic": "ECLIPJ2000", "equatorial": "J2000"}


def _csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("inferSchema", False).option("multiLine", True).option("escape", '"').csv(path)


def _typed(raw: DataFrame, numbers: list[str], strings: list[str]) -> DataFrame:
    """Known columns by name; missing optional ones are null, text that is no number becomes null."""
    have = set(raw.columns)
    cols = [(F.col(f"`{c}`").try_cast("double") if c in have else F.lit(None).cast("double")).alias(c) for c in numbers]
    cols += [(F.col(f"`{c}`").cast("string") if c in have else F.lit(None).cast("string")).alias(c) for c in strings]
    return raw.select(*cols)


def read_detections(spark: SparkSession, path: str, plane: str = "ecliptic", ephemeris: DataFrame | None = None, raw_uncertainty: bool = False) -> DataFrame:
    return detections(_csv(spark, path), plane, ephemeris, raw_uncertainty)


def detections(raw: DataFrame, plane: str = "ecliptic", ephemeris: DataFrame | None = None, raw_uncertainty: bool = False) -> DataFrame:
    """Rows of the data model from catalog columns.

    ra, dec and epoch must be there and not null (else the query fails when it reads such a row). The observer is the
    row's obscode looked up in `ephemeris` (obscode, jd_lo, jd_hi, x0.., x1..: positions at both ends of each interval,
    interpolated linearly), else the row's own position, else an error. Velocities count only if all three are there.
    ast_ucty is given in arcsec and kept in radians unless raw_uncertainty. intid is the row's number in no stated order if
    the input has none.
    """
    missing = [c for c in REQUIRED if c not in raw.columns]
    if missing:
        raise ValueError(f"the catalog lacks {', '.join(missing)}")
    own_columns = all(c in raw.columns for c in ("obs_x", "obs_y", "obs_z"))
    if not own_columns and ("obscode" not in raw.columns or ephemeris is None):
        raise ValueError("the catalog needs obs_x, obs_y, obs_z, or obscode together with an ephemeris")
    if plane.lower() not in PLANES:
        raise ValueError(f"unknown plane {plane!r}: use ecliptic or equatorial")
    names = {"filter_name": "filter"} if "filter_name" in raw.columns and "filter" not in raw.columns else {}
    given = raw.withColumnsRenamed(names)
    intid = F.col("intid").cast("long") if "intid" in raw.columns else F.monotonically_increasing_id()
    df = _typed(given.withColumn("__intid", intid), NUMBERS, [*STRINGS, "__intid"]).withColumnRenamed("__intid", "intid").withColumn("intid", F.col("intid").cast("long"))

    def must(c: str) -> Column:
        return F.when(F.col(c).isNull(), F.raise_error(F.lit(f"{c} is null")).cast("double")).otherwise(F.col(c))

    df = df.withColumns({c: must(c) for c in REQUIRED})
    if ephemeris is not None:
        df = from_ephemeris(df, ephemeris)
    else:
        df = df.withColumns({f"eph_{c}": F.lit(None).cast("double") for c in "xyz"})
    own = F.col("obs_x").isNotNull() & F.col("obs_y").isNotNull() & F.col("obs_z").isNotNull()
    for c in "xyz":
        lost = F.raise_error(F.lit("a row has neither a known obscode nor a whole position")).cast("double")
        df = df.withColumn(f"obs_{c}", F.coalesce(F.col(f"eph_{c}"), F.when(own, F.col(f"obs_{c}")), lost))
    whole = F.col("obs_vx").isNotNull() & F.col("obs_vy").isNotNull() & F.col("obs_vz").isNotNull()
    df = df.withColumns({f"obs_v{c}": F.when(whole, F.col(f"obs_v{c}")) for c in "xyz"})
    rho, obs, vel = pointing(F.col("ra"), F.col("dec")), Vec.of("obs"), Vec(F.col("obs_vx"), F.col("obs_vy"), F.col("obs_vz"))
    if plane.lower() == "ecliptic":
        rho, obs, vel = to_ecliptic(rho), to_ecliptic(obs), to_ecliptic(vel)
    ucty = F.col("ast_ucty") if raw_uncertainty else F.radians(F.col("ast_ucty") / 3600.0)
    return df.select(
        "intid", utc_to_tdb(F.col("epoch")).alias("epoch"), F.lit(PLANES[plane.lower()]).alias("reference_plane"), *rho.named("rho"), *obs.named("obs"),
        vel.x.alias("obs_vx"), vel.y.alias("obs_vy"), vel.z.alias("obs_vz"), *STRINGS, "mag", "mag_ucty", ucty.alias("ast_ucty"), "ra_ucty", "dec_ucty",
    )


def from_ephemeris(rows: DataFrame, ephemeris: DataFrame) -> DataFrame:
    """rows (obscode, epoch) with eph_x, eph_y, eph_z; null where no interval holds the epoch. Both sides carry the day, so that
    a row meets the few intervals of its observatory and day, not all of the observatory's."""
    codes = rows.select("obscode").filter("obscode is not null").distinct()
    known = ephemeris.join(codes, "obscode", "left_semi").withColumnRenamed("obscode", "__code")
    known = known.select("*", F.explode(F.sequence(F.floor("jd_lo").cast("long"), (F.ceil("jd_hi") - 1).cast("long"))).alias("__kday"))
    df = rows.withColumn("__day", F.floor("epoch").cast("long"))
    df = df.join(known, (F.col("obscode") == F.col("__code")) & (F.col("__day") == F.col("__kday")) & (F.col("epoch") >= F.col("jd_lo")) & (F.col("epoch") < F.col("jd_hi")), "left")
    part = (F.col("epoch") - F.col("jd_lo")) / (F.col("jd_hi") - F.col("jd_lo"))
    place = {f"eph_{c}": F.col(f"{c}0") + part * (F.col(f"{c}1") - F.col(f"{c}0")) for c in "xyz"}
    return df.select(*rows.columns, *[v.alias(k) for k, v in place.items()])


FORMATS = {"spherical": ["r", "vr", "vo", "inc", "kappa"], "keplerian": ["q", "e", "inc", "M0", "kappa"], "three": ["r", "vr", "vo"]}


def read_orbits(spark: SparkSession, path: str, method: str, origin: str, epoch: float, m0_is_true_anomaly: bool = False) -> DataFrame:
    """Trial orbits of the formats spherical, keplerian or three (without inclination); the epoch is a TDB Julian Date."""
    if method.lower() not in FORMATS:
        raise ValueError(f"unknown format {method!r}: use {', '.join(FORMATS)}")
    need = FORMATS[method.lower()]
    raw = _csv(spark, path)
    missing = [c for c in [*need, "id"] if c not in raw.columns]
    if missing:
        raise ValueError(f"the orbits lack {', '.join(missing)}")
    table = _typed(raw, need, ["id"])
    if method.lower() == "keplerian":
        return orbits.keplerian(table, epoch, mu_of(origin), m0_is_true_anomaly)
    return orbits.spherical(table, epoch, mu_of(origin))


def read_rate_orbits(spark: SparkSession, path: str) -> DataFrame:
    """(r, vr, adot, bdot, id) by position; the header is skipped."""
    schema = "r double, vr double, adot double, bdot double, id string"
    return spark.read.option("header", True).option("enforceSchema", True).schema(schema).csv(path)


def read_positional_detections(spark: SparkSession, path: str, obscode: str, ephemeris: DataFrame, plane: str = "ecliptic") -> DataFrame:
    """The older layout without names, of one observatory: column 2 (from 0) is the detid, 3 and 4 ra and dec, 5 the uncertainty
    in arcsec, 6 the filter, 7 the magnitude, 8 and 9 the flux and its error, 14 the epoch. mag_ucty is the flux error over the
    flux, null for a flux of 0."""
    raw = spark.read.option("header", True).csv(path)
    at = {2: "detid", 3: "ra", 4: "dec", 5: "ast_ucty", 6: "filter", 7: "mag", 8: "flux", 9: "dflux", 14: "epoch"}
    named = raw.select(*[F.col(f"`{raw.columns[i]}`").alias(n) for i, n in at.items()], F.lit(obscode).alias("obscode"))
    ratio = F.col("dflux").try_cast("double") / F.nullif(F.col("flux").try_cast("double"), F.lit(0.0))
    return detections(named.withColumn("mag_ucty", ratio.cast("string")).drop("flux", "dflux"), plane, ephemeris)


def read_positional_orbits(spark: SparkSession, path: str, origin: str, epoch: float) -> DataFrame:
    """The older layout of orbits: r, vr, vo, inc, kappa by position; ids are ic_ and the row's number in the file."""
    schema = "r double, vr double, vo double, inc double, kappa double"
    raw = spark.read.option("header", True).option("enforceSchema", True).schema(schema).csv(path)
    # orbits are few; one task numbers them in the order of the file
    number = F.row_number().over(Window.orderBy(F.monotonically_increasing_id())) - 1
    return orbits.spherical(raw.withColumn("id", F.format_string("ic_%06d", number)), epoch, mu_of(origin))
