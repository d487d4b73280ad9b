"""Rows that fail to parse, set apart with the reason for it.

Method: structural checks on the line itself, parsed once; of the fields, the distinct values of the checked columns are staged
and each is cast once, the ones that fail form a dictionary (column, value), and that dictionary is joined back to the rows.

Defined results: a null line has no fields and fails with 'columns'; an empty line has one field; identical lines under
different ids fail alike, each with its own row; other columns of the input are kept, whatever their names; an empty input
gives two empty results.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import Stage, lookup

NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\z"


@dataclass(frozen=True)
class Check:
    """A check named by its reason. `value` makes the checked value from the fields (a Column array); `bad` tells of a
    distinct value whether it fails."""

    reason: str
    value: Callable[[Column], Column]
    bad: Callable[[Column], Column]


def is_number(c: Column) -> Column:
    return F.coalesce(c.rlike(NUMBER), F.lit(False))


def number(c: Column) -> Column:
    """The value of a number in that grammar, null otherwise."""
    return F.when(is_number(c), c.try_cast("double"))


def well_quoted(line: Column) -> Column:
    """Every field with a double quote starts and ends with one and doubles those inside.

    Cut at the quotes, the pieces outside of quotes are those at even places: the first must be empty or end in a comma, the
    last be empty or start with one, and each in between be empty (a doubled quote) or start and end with one.
    """
    pieces = F.split(line, '"', -1)
    n = F.size(pieces)

    def fits(piece: Column, i: Column) -> Column:
        starts, ends = (i == 0) | piece.startswith(","), (i == n - 1) | piece.endswith(",")
        return (i % 2 == 1) | (piece == "") | (starts & ends)

    odd_quotes = n % 2 == 0
    return ~line.contains('"') | (~odd_quotes & F.forall(F.transform(pieces, lambda p, i: fits(p, i)), lambda x: x))


def fields_of(line: Column) -> Column:
    """The fields of a well-quoted line, with quotes taken off. Commas outside of quotes become a mark that no line can
    hold, because its first character is escaped beforehand."""
    marked = F.replace(line, F.lit("\x01"), F.lit("\x01\x02"))
    pieces = F.split(marked, '"', -1)
    cut = F.transform(pieces, lambda p, i: F.when(i % 2 == 0, F.replace(p, F.lit(","), F.lit("\x01\x03"))).otherwise(p))
    fields = F.split(F.array_join(cut, '"'), "\x01\x03", -1)

    def plain(f: Column) -> Column:
        inner = F.when(
            f.startswith('"'), F.replace(F.substring(f, F.lit(2), F.length(f) - 2), F.lit('""'), F.lit('"'))
        ).otherwise(f)
        return F.replace(inner, F.lit("\x01\x02"), F.lit("\x01"))

    return F.when(line.contains('"'), F.transform(fields, plain)).otherwise(F.split(line, ",", -1))


def split_rows(
    lines: DataFrame, columns: list[str], checks: list[Check], line: str = "line", types: dict[str, str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """(good, bad): the good rows have one typed column per name of `columns` in the struct `row`, the bad ones `reason`.

    Reasons in order: quoting, columns, then the checks as listed; the first that holds is reported. Lines are parsed once,
    into a staged table that all further steps read. The distinct values are a staged table too, so that no check can be
    planned below the distinct. The dictionary of the failing ones is joined back by `lookup`, which splits off a value that
    many rows share; lines of a bad shape have no values and take no part in these joins.
    """
    spark = lines.sparkSession
    own = list(lines.columns)
    text = F.col(f"`{line}`")
    base = lines.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("__in"), text.alias("__line"))
    ok = F.coalesce(well_quoted(F.col("__line")), F.lit(True))
    parsed = base.select("__in", F.when(ok, fields_of(F.col("__line"))).alias("__f"), ok.alias("__ok"))
    shape = (
        F.when(~F.col("__ok"), F.lit("quoting"))
        .when(F.col("__f").isNull() | (F.size("__f") != len(columns)), F.lit("columns"))
        .otherwise(F.lit(None).cast("string"))
    )
    stage = Stage(spark, "raw-lines")
    shaped, n_rows = stage.write_counted(parsed.select("__in", "__f", shape.alias("reason")))
    names = [f"__v{i}" for i in range(len(checks))]
    values = shaped.filter(F.col("reason").isNull()).select("__in", "__f", *[k.value(F.col("__f")).alias(v) for k, v in zip(checks, names)])
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.col(v).alias("v")) for i, v in enumerate(names)])
    distinct = stage.write(values.select(F.explode(cells).alias("c")).select("c.i", "c.v").distinct())
    failing = F.lit(False)
    for i, k in enumerate(checks):
        failing = failing | ((F.col("i") == i) & F.coalesce(k.bad(F.col("v")), F.lit(True)))
    dictionary, n_bad = stage.write_counted(distinct.filter(failing))
    judged = values
    for i, v in enumerate(names):
        one = dictionary.filter(F.col("i") == i).select(F.col("v").alias(v), F.lit(True).alias(f"__b{i}"))
        judged = lookup(judged, n_rows, v, one, n_bad, "left")
    reason = F.lit(None).cast("string")
    for i, k in enumerate(checks):
        reason = F.coalesce(reason, F.when(F.col(f"__b{i}"), F.lit(k.reason)))
    judged = judged.select("__in", "__f", reason.alias("reason"))
    bad = shaped.filter(F.col("reason").isNotNull()).unionByName(judged.filter(F.col("reason").isNotNull()))
    bad = bad.select("__in.*", "reason") if "reason" not in own else bad.select(F.col("__in").alias("input"), "reason")
    types = types or {}
    typed = [
        (number(F.get("__f", F.lit(i))) if types.get(c) == "double" else F.nullif(F.get("__f", F.lit(i)), F.lit(""))).alias(c)
        for i, c in enumerate(columns)
    ]
    good = judged.filter(F.col("reason").isNull()).select(F.col("__in").alias("input"), F.struct(*typed).alias("row"))
    return good, bad


CATALOG = "ra dec epoch obscode obs_x obs_y obs_z ast_ucty mag mag_ucty filter detid objid trackid".split()
CATALOG_TYPES = dict.fromkeys("ra dec epoch obs_x obs_y obs_z ast_ucty mag mag_ucty".split(), "double")
ORBITS = "id r vr vo inc kappa".split()
ORBIT_TYPES = dict.fromkeys("r vr vo inc kappa".split(), "double")


def _field(names: list[str], name: str) -> Callable[[Column], Column]:
    return lambda f: F.get(f, F.lit(names.index(name)))


def _observer(f: Column) -> Column:
    """The obscode; where that is empty, whether each of obs_x, obs_y, obs_z is a number follows after a blank mark."""
    code = F.get(f, F.lit(CATALOG.index("obscode")))
    xyz = [F.get(f, F.lit(CATALOG.index(c))) for c in ("obs_x", "obs_y", "obs_z")]
    return F.when(code != "", code).otherwise(F.concat(F.lit("\n"), F.array_join(F.array(*xyz), "\n")))


def _bad_observer(v: Column) -> Column:
    parts = F.split(v, "\n", -1)
    numbers = (F.size(parts) == 4) & is_number(F.get(parts, F.lit(1))) & is_number(F.get(parts, F.lit(2))) & is_number(F.get(parts, F.lit(3)))
    return F.when(v.startswith("\n"), ~numbers).otherwise(~v.rlike(r"^[A-Z0-9]{3}\z"))


CATALOG_CHECKS = [
    Check("ra", _field(CATALOG, "ra"), lambda v: ~(is_number(v) & (number(v) >= 0) & (number(v) < 360))),
    Check("obscode", _observer, _bad_observer),
    Check("detid", _field(CATALOG, "detid"), lambda v: ~v.rlike(r"^[A-Za-z0-9_-]{1,16}\z")),
]
ORBIT_CHECKS = [Check("kappa", _field(ORBITS, "kappa"), lambda v: ~(is_number(v) & F.abs(number(v)).eqNullSafe(1.0)))]


def split_catalog(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    return split_rows(lines, CATALOG, CATALOG_CHECKS, types=CATALOG_TYPES)


def split_orbits(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    return split_rows(lines, ORBITS, ORBIT_CHECKS, types=ORBIT_TYPES)
