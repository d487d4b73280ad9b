"""A run from a settings file: python -m starweft.plans.run <pixels|dense|tangent|points> <settings.yaml> <output folder>."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession

from ..functions.constants import mu_of
from ..sources import config, readers
from ..sources.config import Config
from ..staging import kept_for
from . import linker


def inputs(spark: SparkSession, c: Config, ephemeris: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The detections and trial orbits that the settings name. The ephemeris stands in for the kernel files of spice_path,
    which cannot be read here; without one the rows' own positions are used."""
    detections = readers.read_detections(spark, c.detection_catalog, c.orbit_reference_plane, ephemeris)
    return detections, readers.read_orbits(spark, c.initial_conditions_file, c.ic_type, c.ic_origin, c.reference_epoch)


def dense(spark: SparkSession, c: Config, ephemeris: DataFrame | None = None) -> DataFrame:
    """Peaks of at least min_detections on grids with cells of a third of epsilon_arcsec."""
    return linker.dense_search(*inputs(spark, c, ephemeris), c.epsilon_arcsec, c.min_detections)


def pixels(spark: SparkSession, c: Config, ephemeris: DataFrame | None = None, **options) -> DataFrame:
    """Fitted clusters of at least min_detections on min_nites nights, gathered within epsilon_arcsec."""
    detections, orbits = inputs(spark, c, ephemeris)
    return linker.hpix_linker(detections, orbits, c.reference_epoch, arcsec=c.epsilon_arcsec, min_points=c.min_detections, min_nights=c.min_nites, **options)


def points(spark: SparkSession, c: Config, ephemeris: DataFrame | None = None) -> DataFrame:
    """Members of neighbourhoods within epsilon_arcsec that have min_detections, last min_duration days and min_nites nights."""
    return linker.point_linker(*inputs(spark, c, ephemeris), c.epsilon_arcsec, c.min_detections, c.min_duration, c.min_nites)


def tangent(spark: SparkSession, c: Config, ephemeris: DataFrame | None = None) -> DataFrame:
    """Best place of every rate orbit; initial_conditions_file holds r, vr, adot, bdot, id by position."""
    from ..functions.constants import ARCSEC

    detections = readers.read_detections(spark, c.detection_catalog, c.orbit_reference_plane, ephemeris)
    rates = readers.read_rate_orbits(spark, c.initial_conditions_file)
    return linker.tangent_search(linker.tangent_points(detections), rates, c.reference_epoch, c.epsilon_arcsec * ARCSEC / 3, mu_of(c.ic_origin), c.min_detections)


SEARCHES = {"dense": dense, "pixels": pixels, "points": points, "tangent": tangent}


def main(arguments: list[str]) -> None:
    if len(arguments) != 3 or arguments[0] not in SEARCHES:
        raise SystemExit(__doc__)
    spark = SparkSession.builder.getOrCreate()
    with kept_for(spark):
        SEARCHES[arguments[0]](spark, config.load(arguments[1])).write.mode("overwrite").parquet(arguments[2])


if __name__ == "__main__":
    main(sys.argv[1:])
