"""Name -> query callable (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import arrangement_queries as aq
from .plans import crime_measures as cm
from .plans import crime_queries as cq
from .plans import zone_queries as zq
from .plans import hazard_queries as hq
from .plans import serve_queries as sq
from .plans import name_queries as nq
from .plans import geo_queries as gq
from .plans import quality_queries as qq

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    "q_safety_score": cq.q_safety_score,
    "q_left_join_fill": cq.q_left_join_fill,
    "q_wide_left_chain": cq.q_wide_left_chain,
    "q_smooth_rate": cq.q_smooth_rate,
    "q_pct_score": cq.q_pct_score,
    "q_topk_safety": cq.q_topk_safety,
    "q_business_flag": cq.q_business_flag,
    "q_median_by_count": cq.q_median_by_count,
    "q_unmatched": cq.q_unmatched,
    "q_mart_crime": cq.q_mart_crime,
    "q_crime_groups": cm.q_crime_groups,
    "q_mart_crime_full": cm.q_mart_crime_full,
    "q_safety_evidence": cm.q_safety_evidence,
    "q_describe": cq.q_describe,
    "q_match_rate": cq.q_match_rate,
    "q_top_wards": cq.q_top_wards,
    "q_pip_count": zq.q_pip_count,
    "q_zone_depth_stats": zq.q_zone_depth_stats,
    "q_flood_by_zone": zq.q_flood_by_zone,
    "q_top1_per_group": zq.q_top1_per_group,
    "q_ordered_list": zq.q_ordered_list,
    "q_other_basins": zq.q_other_basins,
    "q_elev_score": zq.q_elev_score,
    "q_coverage_summary": zq.q_coverage_summary,
    "q_basin_label": zq.q_basin_label,
    "q_tide_exposure": zq.q_tide_exposure,
    "q_class_counts": zq.q_class_counts,
    "q_ground_pl": zq.q_ground_pl,
    "q_unknown_codes": zq.q_unknown_codes,
    "q_history_flags": zq.q_history_flags,
    "q_poly_intersects": hq.q_poly_intersects,
    "q_semi_candidates": hq.q_semi_candidates,
    "q_overlay_area": hq.q_overlay_area,
    "q_overlay_chunks": hq.q_overlay_chunks,
    "q_union_area": hq.q_union_area,
    "q_collapse_ratio": hq.q_collapse_ratio,
    "q_national_rivers": hq.q_national_rivers,
    "q_weighted_exposure": hq.q_weighted_exposure,
    "q_distinct_list": hq.q_distinct_list,
    "q_code_lookup": hq.q_code_lookup,
    "q_combine_scores": sq.q_combine_scores,
    "q_mart_towns": sq.q_mart_towns,
    "q_mart_scores": sq.q_mart_scores,
    "q_mart_hazard": sq.q_mart_hazard,
    "q_index": sq.q_index,
    "q_masked_index": sq.q_masked_index,
    "q_index_meta": sq.q_index_meta,
    "q_ward_codes": sq.q_ward_codes,
    "q_ward_map": sq.q_ward_map,
    "q_town_detail": sq.q_town_detail,
    "q_town_one": sq.q_town_one,
    "q_town_json": sq.q_town_json,
    "q_axis_corr": sq.q_axis_corr,
    "q_axis_status": sq.q_axis_status,
    "q_evidence": sq.q_evidence,
    "q_card_summary": sq.q_card_summary,
    "q_all_good_measured": sq.q_all_good_measured,
    "q_typhoon_specific": sq.q_typhoon_specific,
    "q_safety_flood_gap": sq.q_safety_flood_gap,
    "q_flood_tide_gap": sq.q_flood_tide_gap,
    "q_national_decided": sq.q_national_decided,
    "q_score_bucket": sq.q_score_bucket,
    "q_ward_rollup": sq.q_ward_rollup,
    "q_dq_status": sq.q_dq_status,
    "q_geojson_features": sq.q_geojson_features,
    "q_scored_features": sq.q_scored_features,
    "q_geojson_split": sq.q_geojson_split,
    "q_dq_set_equality": sq.q_dq_set_equality,
    "q_rebuild_diff": sq.q_rebuild_diff,
    "q_ward_prefix": nq.q_ward_prefix,
    "q_norm_name": nq.q_norm_name,
    "q_kanji_number": nq.q_kanji_number,
    "q_search_normalize": nq.q_search_normalize,
    "q_town_search": nq.q_town_search,
    "q_ward_search": nq.q_ward_search,
    "q_slug_lookup": nq.q_slug_lookup,
    "q_detail_paths": nq.q_detail_paths,
    "q_ring_area": gq.q_ring_area,
    "q_ring_validity": gq.q_ring_validity,
    "q_ring_centroid": gq.q_ring_centroid,
    "q_project": gq.q_project,
    "q_snap_precision": gq.q_snap_precision,
    "q_ward_outline_edges": gq.q_ward_outline_edges,
    "q_ward_outline_rings": gq.q_ward_outline_rings,
    "q_ring_repair": aq.q_ring_repair,
    "q_union_outline": aq.q_union_outline,
    "q_big_ring_count": aq.q_big_ring_count,
    "q_dissolve_attrs": gq.q_dissolve_attrs,
    "q_alias_resolve": gq.q_alias_resolve,
    "q_shared_keys": gq.q_shared_keys,
    "q_shared_polygon_key": gq.q_shared_polygon_key,
    "q_density": gq.q_density,
    "q_infer_types": qq.q_infer_types,
    "q_pk_violations": qq.q_pk_violations,
    "q_mart_pk_check": qq.q_mart_pk_check,
    "q_byte_batches": qq.q_byte_batches,
    "q_byte_batch_totals": qq.q_byte_batch_totals,
    "q_stream_zone_stats": qq.q_stream_zone_stats,
}
