"""Local maxima of sparse count tables and sums over their neighbours.

Only cells that may be peaks are expanded to their neighbours' keys, so the join's one side is the few full cells; where it
is small the optimiser broadcasts it at run time. Cells that do not exist count 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import healpix


def grid_peaks(counts: DataFrame, keys: list[str], min_count: int = 1) -> DataFrame:
    """(keys, i, j, n, total): cells with n >= min_count that none of their 8 neighbours exceeds (equal ones stay), and the
    sum over the 3 x 3 cells."""
    around = F.array(*[F.struct(F.lit(a).alias("di"), F.lit(b).alias("dj")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    centres = counts.filter(F.col("n") >= min_count).select(*keys, F.col("i").alias("ci"), F.col("j").alias("cj"), F.col("n").alias("cn"), F.explode(around).alias("o"))
    centres = centres.select(*keys, "ci", "cj", "cn", (F.col("ci") + F.col("o.di")).alias("i"), (F.col("cj") + F.col("o.dj")).alias("j"))
    met = centres.join(counts, [*keys, "i", "j"])
    out = met.groupBy(*keys, "ci", "cj", "cn").agg(F.max("n").alias("most"), F.sum("n").alias("total")).filter(F.col("most") <= F.col("cn"))
    return out.select(*keys, F.col("ci").alias("i"), F.col("cj").alias("j"), F.col("cn").alias("n"), "total")


def top_peak(peaks: DataFrame, keys: list[str], by: str = "total") -> DataFrame:
    """The peak of each key with the largest value; of equal ones the smallest cell."""
    order = Window.partitionBy(*keys).orderBy(F.desc(by), "i", "j")
    return peaks.withColumn("__r", F.row_number().over(order)).filter("__r = 1").drop("__r")


def neighbour_sums(counts: DataFrame, keys: list[str], depth: int, min_centre: int = 2) -> DataFrame:
    """(keys, hpix, total): each pixel with at least min_centre points plus the ring around it."""
    centres = counts.filter(F.col("n") >= min_centre).select(*keys, F.col("hpix").alias("c"), F.explode(F.array_append(healpix.neighbours(depth)("hpix"), F.col("hpix"))).alias("hpix"))
    return centres.join(counts, [*keys, "hpix"]).groupBy(*keys, "c").agg(F.sum("n").alias("total")).withColumnRenamed("c", "hpix")


def pixel_peaks(sums: DataFrame, keys: list[str], depth: int, threshold: int) -> DataFrame:
    """(keys, hpix, total): pixels of at least `threshold` that no pixel of their ring exceeds."""
    centres = sums.filter(F.col("total") >= threshold).select(*keys, F.col("hpix").alias("c"), F.col("total").alias("ct"), F.explode(F.array_append(healpix.neighbours(depth)("hpix"), F.col("hpix"))).alias("hpix"))
    met = centres.join(sums, [*keys, "hpix"]).groupBy(*keys, "c", "ct").agg(F.max("total").alias("most"))
    return met.filter(F.col("most") <= F.col("ct")).select(*keys, F.col("c").alias("hpix"), F.col("ct").alias("total"))
