"""Every core query against its SQL twin on the smallest tables."""

import pandas as pd
import pytest

from voxloom.plans import registry

registry.load()
D = "/root/testdata/sf0.001"
#: One or two of each family; the SQL gate runs all of them on larger tables.
CHOSEN = """v1_object_properties v4_fused_blocks v5_merge_partials v9_overlap_ratio v13_interior_small v15_contact_voxels v18_contact_synapses v22_morphology v24_unique_labels
    v25_stitch_pairs v28_instance_segmentation v34_box_fraction v36_cube_vote x1_export_table x4_wiring_matrix x5_type_blocks x7_top_partners x16_upsert x18_wiring_distance
    g2_singletons g4_prune g8_cell_rollup g16_bfs_neighbourhoods g18_radius_graph g21_smooth_labels j1_nearest_in_group j2_pairs_within j3_nearest_anywhere m3_background_corrected
    m4_full_mapping p1_cell_class p3_certainty p11_performance p12_knn_classify c3_between_cells c8_medoid c12_proximity k5_window_majority k9_transfer_labels k14_soma_distance
    k27_mesh_area k31_vertex_normals n6_compartment_stats n13_axon_vector n18_pairwise_distance s12_type_sum_files s15_merge_list q5_bulk_lookup u1_map_blocks v21_smoothed v28_distances k7_smooth_compartments k16_synapse_distance
    k17_prune_branches k18_prune_by_path k19_thin k20_weld k21_point_skeleton k28_merged_faces x4_matrix_places x18_wiring_distance_compat g1_components g19_stitch g23_largest_cloud c5_cluster_fragments c17_match_labels""".split()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    return con


def norm(df: pd.DataFrame) -> list[tuple]:
    def one(v):
        if isinstance(v, bool) or type(v).__name__ in ("bool_", "bool"):
            return str(bool(v))
        if v is None or (not isinstance(v, str) and pd.isna(v)):
            return "null"
        return v if isinstance(v, str) else f"{float(v):.9g}"

    return sorted(tuple(one(v) for v in row) for row in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", CHOSEN)
def test_twin(spark, duck, name):
    got, want = registry.QUERIES[name](spark, D).toPandas(), duck.execute(registry.ORACLES[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert norm(got) == norm(want)
