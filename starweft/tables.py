"""Access to the tables of a data folder (one Parquet file or folder each)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def finite(c: Column) -> Column:
    """Neither null nor NaN nor infinite."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def valid_positions(catalog: DataFrame, id_col: str = "intid", keep: list[Column] | None = None) -> DataFrame:
    """(intid, ra, dec, epoch) and the columns `keep` of the rows with non-null, non-NaN ra and dec, |dec| <= 90 and epoch > 0;
    ra is brought into [0, 360). Infinite values count as invalid, and so does a row without an id."""
    ra = F.pmod(F.col("ra"), F.lit(360.0))
    return (
        catalog.filter(F.col(id_col).isNotNull() & finite(F.col("ra")) & finite(F.col("dec")) & finite(F.col("epoch")))
        .filter((F.abs(F.col("dec")) <= 90) & (F.col("epoch") > 0))
        .select(F.col(id_col).alias("intid"), F.when(ra >= 360.0, F.lit(0.0)).otherwise(ra).alias("ra"), "dec", "epoch", *(keep or []))
    )
