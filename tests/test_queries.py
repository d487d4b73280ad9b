"""Queries against their SQL on the smallest driver tables."""

import os

import pytest
from compare import compare

from starweft.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
NAMES = """p2_found p2_catalog_rows p2_orbit_rows p4_found p6_found p6_sessions p7_found p7_cells pointing_vectors in_ecliptic_plane ecliptic_angles
wrapped_angles utc_to_tdb_shift observer_positions exposure_groups tangent_search orbit_table sphere_sync pixel_index range_join point_neighbours
unique_clusters contained_clusters equal_clusters unique_nights cluster_cull line_fits hit_grid wide_dense_search wide_centred_search
configured_search peaks_text loaded_detections legacy_detections loaded_orbits legacy_orbits loaded_rate_orbits keplerian_orbits kepler_anomalies newton_ranges
signed_sync radial_velocity_at_epochs pixel_rings pixel_centres pixel_neighbour_peaks hit_image hits_at_clusters members_of_cells fit_inputs coupled_fits
robust_costs line_predictions orbit_triplets known_sets maintained_groups linked_text astrometric_observations orbits_from_scaled orbit_separations
gamma_ranges bound_boxes boxes_text""".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    ours, theirs, diff = compare(spark, SF, registry.queries()[name], registry.oracle_sql()[name])
    assert not diff and ours == theirs


def test_every_query_is_callable():
    assert all(callable(f) for f in registry.queries().values())
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_tangent_search_stages_nothing_large(spark):
    plan = registry.flagship(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 100_000
