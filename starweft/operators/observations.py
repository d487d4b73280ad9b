"""Observations of several kinds in one table: kind 'astrometry', 'streak', 'radar' or 'complete' with nullable columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geometry import pointing, proper_motion

SIZES = {"astrometry": 2, "streak": 4, "complete": 6}
_MATRIX = T.ArrayType(T.DoubleType())


def inverses(table: DataFrame, source: str = "covariance", target: str = "inverse_covariance") -> DataFrame:
    """Inverse of each row's matrix (row-major); null for null. A 'complete' row with a singular matrix is an error, others
    give null. Applied to an inverse it gives the matrix back."""
    schema = T.StructType([f for f in table.schema.fields if f.name != target] + [T.StructField(target, _MATRIX)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for kind, m in zip(b["kind"], b[source]):
                if m is None:
                    out.append(None)
                    continue
                n = round(len(m) ** 0.5)
                a = np.asarray(m, float).reshape(n, n)
                det = np.linalg.det(a)
                if det == 0 or not np.isfinite(det):
                    if kind == "complete":
                        raise ValueError("the covariance of a complete observation is singular")
                    out.append(None)
                else:
                    out.append(np.linalg.inv(a).ravel().tolist())
            b = b.assign(**{target: out})
            yield b[schema.fieldNames()]

    return table.mapInPandas(run, schema)


def with_derived(table: DataFrame) -> DataFrame:
    """Adds proper_motion (radians per day, null without rates) and the pointing p_x, p_y, p_z; ra and dec in degrees."""
    v = pointing(F.col("ra"), F.col("dec"))
    return table.select("*", proper_motion(F.col("ra_rate"), F.col("dec_rate"), F.radians("dec")).alias("proper_motion"), *v.named("p"))


def shown() -> Column:
    """One line of text per observation."""
    place = F.format_string("%s RA: %.6f Dec: %.6f", F.initcap("kind"), F.col("ra"), F.col("dec"))
    rates = F.format_string(" RA rate: %.6f Dec rate: %.6f", F.col("ra_rate"), F.col("dec_rate"))
    ranges = F.format_string(" Range: %.6f Range rate: %.6f", F.col("range"), F.col("range_rate"))
    return F.when(F.col("kind") == "astrometry", place).when(F.col("kind") == "streak", F.concat(place, rates)).when(F.col("kind") == "radar", F.concat(F.lit("Radar"), ranges)).otherwise(F.concat(place, rates, ranges))
