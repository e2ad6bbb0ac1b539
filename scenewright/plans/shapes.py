"""Schemas of the documents of every layer, of compiled records and of answers, for plans/schemas.py."""

from __future__ import annotations

from typing import Any

from scenewright.operators.validate import ADAPTERS, CAPABILITIES, DEPTH_TYPES, GATES, LEVELS, SCALES, STATUSES, TASK, UNITS, VERSION

Schema = dict[str, Any]


def shape(needed: dict[str, Schema], may: dict[str, Schema] | None = None, more: bool | Schema = False) -> Schema:
    """An object with keys that it needs, keys that it may have, and others only if more says so."""
    return {"type": "object", "required": list(needed), "properties": needed | (may or {}), "additionalProperties": more}


def ornull(s: Schema) -> Schema:
    return s | {"type": [s["type"], "null"]}


def listed(of: Schema, least: int | None = None, most: int | None = None) -> Schema:
    bounds = {k: n for k, n in (("minItems", least), ("maxItems", most)) if n is not None}
    return {"type": "array", "items": of} | bounds


def exactly(n: int, of: Schema) -> Schema:
    return listed(of, n, n)


def real(low: float | None = None, high: float | None = None, kind: str = "number") -> Schema:
    return {"type": kind} | {k: n for k, n in (("minimum", low), ("maximum", high)) if n is not None}


def words(*allowed: str) -> Schema:
    return {"enum": list(allowed)}


def like(pattern: str) -> Schema:
    return {"type": "string", "pattern": pattern}


TEXT, NAMED, FLAG, ANY_OBJECT = {"type": "string"}, {"type": "string", "minLength": 1}, {"type": "boolean"}, {"type": "object"}
TEXTS, MAYBE_TEXT, MAYBE_FLAG = listed(TEXT), ornull(TEXT), ornull(FLAG)
COUNT, SHARE, LENGTH = real(0, kind="integer"), real(0, 1), real(0)
MAYBE, MAYBE_SHARE, MAYBE_LENGTH = ornull(real()), ornull(SHARE), ornull(LENGTH)
VECTOR, BOX, SIZES = exactly(3, real()), exactly(6, real()), exactly(2, {"type": "integer"})
MATRIX3, MATRIX4 = exactly(3, exactly(3, real())), exactly(4, exactly(4, real()))

# Fixed values from here to the end: names, words, patterns and bounds of the file format.
ENTITY = like(r"^<(obj|part|wire|region|route|track|pose)_\d{3,}>$")
MAYBE_ENTITY = {"oneOf": [ENTITY, {"type": "null"}]}
HEAD = {"schema_version": like(VERSION), "scene_id": NAMED}
SNAPSHOT_REF = {"metadata_snapshot_id": MAYBE_TEXT}
LEVEL = words(*LEVELS)


def made(*refs: str, **more: Schema) -> Schema:
    """Provenance of a document: when, by which code, from what."""
    return shape({"created_at": NAMED, "code_version": NAMED} | {r: NAMED for r in refs}, {"notes": MAYBE_TEXT} | more, more=True)


MODEL = shape(
    {"name": NAMED, "version": NAMED},
    {"commit": MAYBE_TEXT, "checkpoint_sha256": MAYBE_TEXT, "precision": words("fp32", "fp16", "bf16", "unknown"), "expert_card": MAYBE_TEXT, "lineage_group": MAYBE_TEXT},
)
MASK = shape({"uri": NAMED, "producer": MODEL}, {"encoding": words("probability_map", "binary_mask", "coco_rle"), "calibrated": FLAG})
REASONS = (
    "sky", "water", "reflection_or_transparency", "low_depth_confidence", "reprojection_inconsistent", "dynamic_geometry", "out_of_bounds", "texture_poor",
)
SCALE = shape(
    {
        "status": words(*SCALES),
        "source": words("rtk_gps", "gnss", "lidar", "stereo_baseline", "gcp", "imu", "camera_trajectory", "none", "unknown"),
        "depth_type": words(*DEPTH_TYPES),
        "domain_calibrated": FLAG,
        "anchor_provenance_verified": FLAG,
    },
    {"scale_factor": {"type": ["number", "null"], "exclusiveMinimum": 0}, "alignment_version": MAYBE_TEXT}
    | {k: MAYBE_LENGTH for k in ("uncertainty_m", "camera_baseline_m", "alignment_residual_m")},
)
CAMERA = shape(
    {"frame_id": NAMED, "K": MATRIX3, "T_world_from_camera": MATRIX4, "coordinate_convention": TEXT, "pose_source": words("native", "estimated", "refined", "unknown")},
    {
        "distortion_model": words("opencv", "none", "unknown"),
        "distortion": listed(real()),
        "image_size_hw": exactly(2, real(1, kind="integer")),
        "nadir_angle_deg": ornull(real(0, 180)),
        "altitude_agl_m": MAYBE,
    },
)
PREPROCESSING = shape(
    {"original_size_hw": SIZES, "processed_size_hw": SIZES},
    {"H_original_to_model": ornull(MATRIX3), "crop_xywh": ornull(exactly(4, real())), "resize_mode": MAYBE_TEXT},
)
DEPTH = shape(
    {"artifact_id": NAMED, "producer": MODEL, "depth_uri": NAMED, "depth_type": words(*DEPTH_TYPES), "frame_ids": listed(TEXT, 1)},
    {
        "role": words("primary", "cross_check", "metric_prior"),
        "confidence_uri": MAYBE_TEXT,
        "preprocessing": PREPROCESSING,
        "alignment_to_primary": ornull(ANY_OBJECT),
    },
)
NORMAL = shape(
    {"artifact_id": NAMED, "producer": MODEL, "normal_uri": NAMED, "derivation": words("independent_estimator", "depth_differentiation", "plane_fit")},
    {"uncertainty_uri": MAYBE_TEXT},
)
CLOUD = shape(
    {"point_uri": NAMED, "source": words("direct_lidar", "depth_backprojection", "fused", "native_map"), "point_count": COUNT}, {"fields": TEXTS, "producer": MODEL},
)
SIGNATURES = ("dynamic_ghosting", "sky_depth", "water_glass_failure", "repeated_texture_drift", "textureless_surface")
DIAGNOSTICS = shape(
    {},
    {"drift_indicator": MAYBE, "failure_signatures": listed(words(*SIGNATURES))}
    | {k: MAYBE_SHARE for k in ("coverage_ratio", "invalid_depth_ratio")}
    | {k: MAYBE_LENGTH for k in ("reprojection_error_px", "point_density_per_m2", "depth_relief_ratio")},
    more=True,
)
GEOMETRY = shape(
    HEAD
    | {
        "coordinate_frame": NAMED,
        "unit": words(*UNITS),
        "scale": SCALE,
        "cameras": listed(CAMERA, 1),
        "depth": listed(DEPTH, 1),
        "provenance": made("source_scene_manifest", transforms_applied=TEXTS),
    },
    SNAPSHOT_REF
    | {
        "normals": listed(NORMAL),
        "point_cloud": ornull(CLOUD),
        "invalid_geometry": shape({}, {"reason_masks": shape({}, {r: MASK for r in REASONS}), "combined_uri": MAYBE_TEXT}),
        "diagnostics": DIAGNOSTICS,
    },
)

POINTS = shape({"point_count": COUNT}, {"point_indices_uri": MAYBE_TEXT, "source_frames": TEXTS})
CONFIDENCE = shape(
    {},
    {k: MAYBE_SHARE for k in ("semantic", "detector_box", "mask", "mask_boundary", "geometry", "association")}
    | {"cross_view_support": ornull(COUNT), "expert_disagreement": MAYBE_LENGTH, "calibrated": FLAG},
)
ORIGIN = shape({"source_frames": TEXTS, "producers": listed(TEXT, 1)}, {"derivation_program": MAYBE_TEXT, "supervision_level": LEVEL}, more=True)
ORIENTED = shape({"center": VECTOR, "extent": exactly(3, LENGTH), "axes": MATRIX3})
OBJECT = shape(
    {
        "object_id": ENTITY,
        "category": NAMED,
        "geometry": shape(
            {"centroid": VECTOR},
            {
                "centroid_covariance": ornull(MATRIX3),
                "aabb": ornull(BOX),
                "obb": ornull(ORIENTED),
                "height_above_ground_m": MAYBE,
                "ground_reference_surface_id": MAYBE_TEXT,
            },
        ),
        "visibility": shape({"visible_frames": TEXTS}, {"visible_ratio": MAYBE_SHARE, "occlusion_ratio": MAYBE_SHARE, "best_view_frame_id": MAYBE_TEXT}),
        "confidence": CONFIDENCE,
        "provenance": ORIGIN,
    },
    {
        "category_candidates": listed(shape({"label": TEXT, "score": SHARE})),
        "point_support": POINTS,
        "dynamic_state": words("static", "dynamic", "unknown"),
        "lineage": shape({}, {"merged_from": TEXTS, "split_from": MAYBE_TEXT, "previous_snapshot_id": MAYBE_TEXT}),
    },
)
SURFACE = shape(
    {
        "surface_id": ENTITY,
        "plane": shape({"normal": VECTOR, "offset_m": real(), "fit_method": words("least_squares", "ransac", "pca")}, {"inlier_ratio": MAYBE_SHARE}),
        "extent": shape({"area_m2": LENGTH}, {"bbox_3d": ornull(BOX), "boundary_uri": MAYBE_TEXT, "largest_inscribed_circle_m": MAYBE_LENGTH}),
        "quality": CONFIDENCE,
        "provenance": ORIGIN,
    },
    {
        "surface_type": words("ground", "roof", "water", "vegetation_canopy", "paved", "facade", "unknown"),
        "slope_deg": ornull(real(0, 90)),
        "aspect_deg": ornull(real(-180, 180)),
        "roughness_m": MAYBE_LENGTH,
        "planarity_residual_p95_m": MAYBE_LENGTH,
        "point_support": POINTS,
    },
)
REGION = shape(
    {
        "region_id": ENTITY,
        "purpose": words("depth_reliability", "landing_candidate", "terrain_patch", "change_region", "generic"),
        "point_support": POINTS,
        "provenance": ORIGIN,
    },
    {"pixel_mask_uri": MAYBE_TEXT, "frame_ids": TEXTS},
)
CONFLICT = shape(
    {
        "conflict_type": words("association_unresolved", "category_disagreement", "geometry_disagreement", "duplicate_candidate"),
        "entity_ids": listed(TEXT, 1),
        "reason": NAMED,
    },
    {"evidence": ANY_OBJECT},
)
ENTITIES = shape(
    HEAD | {"objects": listed(OBJECT), "surfaces": listed(SURFACE), "regions": listed(REGION), "provenance": made("l0_geometry_ref")},
    SNAPSHOT_REF | {"id_minter_state": {"type": "object", "additionalProperties": COUNT}, "unresolved_conflicts": listed(CONFLICT)},
)

RELATION_TYPES = (
    "distance_m", "height_difference_m", "azimuth_deg", "elevation_deg", "observer_relative_direction", "slope_difference_deg", "surface_height_above_m",
    "occludes", "visible_from", "near", "intersect", "contain", "support", "connect", "adjacent",
)
DIRECTION = {"longitudinal": words("front", "behind"), "lateral": words("left", "right", "ambiguous"), "vertical": words("above", "below")}
DERIVATION = shape({"program": NAMED, "inputs": listed(TEXT, 1)}, {"program_version": MAYBE_TEXT, "supervision_level": LEVEL})
RELATION = shape(
    {
        "relation_id": NAMED,
        "relation_type": words(*RELATION_TYPES),
        "subject_id": ENTITY,
        "value": {"oneOf": [real(), FLAG, TEXT, shape({}, DIRECTION)]},
        "derivation": DERIVATION,
    },
    {
        "object_id": MAYBE_ENTITY,
        "observer_pose_id": MAYBE_TEXT,
        "unit": words("meter", "degree", "ratio", "none"),
        "uncertainty": MAYBE_LENGTH,
        "ambiguous": FLAG,
    },
)
SEEN = shape({"observation_id": NAMED, "frame_id": NAMED}, {"mask_uri": MAYBE_TEXT, "box_xyxy": ornull(exactly(4, real()))})
LINK = shape(
    {"link_id": NAMED, "observation_a": SEEN, "observation_b": SEEN, "same_entity": MAYBE_FLAG, "probability": SHARE, "derivation": DERIVATION},
    {
        "entity_id": MAYBE_ENTITY,
        "evidence": shape(
            {},
            {"appearance_similarity": MAYBE, "class_compatible": MAYBE_FLAG}
            | {k: MAYBE_LENGTH for k in ("centroid_distance_m", "size_ratio", "view_baseline_m")}
            | {k: MAYBE_SHARE for k in ("reprojection_iou", "point_support_iou")},
        ),
    },
)
RELATIONS = shape(HEAD | {"relations": listed(RELATION), "provenance": made("l1_entities_ref")}, SNAPSHOT_REF | {"cross_view_links": listed(LINK)})

LAYER_REF = shape({"uri": NAMED, "schema_version": like(VERSION), "content_sha256": like("^[0-9a-f]{64}$")})
TEXT_MAP = {"type": "object", "additionalProperties": TEXT}
SNAPSHOT = shape(
    HEAD
    | {
        "snapshot_id": NAMED,
        "dataset_id": NAMED,
        "split_group_id": NAMED,
        "layers": shape({k: LAYER_REF for k in ("l0_geometry", "l1_entities", "l2_relations")}, {"l3_capability": {"oneOf": [LAYER_REF, {"type": "null"}]}}),
        "capabilities": shape(
            {"scale_status": words(*SCALES), "depth_type": words(*DEPTH_TYPES), "metric_task_eligible": FLAG, "reasons": TEXTS},
            {"available_entity_types": listed(words("object", "surface", "region")), "nadir_angle_median_deg": MAYBE, "entity_count": ornull(COUNT)}
            | {k: MAYBE_LENGTH for k in ("camera_baseline_m", "depth_relief_ratio", "parallax_ratio")},
        ),
        "gate": shape({"gate_id": words(*GATES), "status": words(*STATUSES)}, {"error_codes": TEXTS, "warnings": TEXTS, "report_uri": MAYBE_TEXT}),
        "provenance": shape(
            {"created_at": NAMED, "code_version": NAMED, "schema_versions": TEXT_MAP}, {"input_digests": TEXT_MAP, "notes": MAYBE_TEXT}, more=True,
        ),
    },
    {"parent_snapshot_id": MAYBE_TEXT},
)

LOW_ALTITUDE = (
    "nadir_view", "uav_pose_altitude", "weak_depth_cue", "water_surface", "textureless_surface", "reflection", "terrain_relief", "landing_candidate",
    "repeated_flight", "evening_run",
)
ANCHORS = ("point_indices", "point_mask", "object_obb", "surface_plane", "region", "camera_pose", "spatial_relation")
INPUTS = shape(
    {"visible_metadata_fields": TEXTS},
    {
        "pointcloud_ref": MAYBE_TEXT,
        "visual_inputs": TEXTS,
        "camera_refs": TEXTS,
        "observer_pose_id": MAYBE_TEXT,
        "visible_metadata": ANY_OBJECT,
        "question": MAYBE_TEXT,
        "choices": ornull(listed(shape({"key": like("^[A-Z]$"), "text": TEXT}))),
    },
)
RECORD = shape(
    HEAD
    | {
        "sample_id": NAMED,
        "task_spec_id": like(TASK),
        "metadata_snapshot_id": NAMED,
        "capability_tags": listed(words(*CAPABILITIES), 1),
        "supervision_level": LEVEL,
        "inputs": INPUTS,
        "hidden_target": ANY_OBJECT,
        "target_geometry": shape(
            {"anchor_kind": words(*ANCHORS)},
            {
                "entity_ids": TEXTS,
                "point_indices_uri": MAYBE_TEXT,
                "obb": ornull(ANY_OBJECT),
                "plane": ornull(ANY_OBJECT),
                "reference_uri": MAYBE_TEXT,
            },
        ),
        "evidence": shape({"used_entities": TEXTS, "used_fields": TEXTS, "derivation_program": NAMED}, {"derivation_inputs": ANY_OBJECT}),
        "checker": shape({"name": NAMED, "version": NAMED}, {"tolerance_m": MAYBE_LENGTH, "lateral_deadzone_deg": MAYBE_LENGTH}, more=True),
        "adapters": listed(words(*ADAPTERS), 1),
        "provenance": made("task_spec_version", prompt_template=MAYBE_TEXT),
    },
    {
        "split_group_id": MAYBE_TEXT,
        "low_altitude_tags": listed(words(*LOW_ALTITUDE)),
        "structurally_visible_target_ids": TEXTS,
        "ambiguity": shape({}, {"is_ambiguous": FLAG, "reason": MAYBE_TEXT, "equivalent_answers": TEXTS}),
        "quality": shape(
            {},
            {"status": words(*STATUSES), "geometry_confidence": MAYBE_SHARE, "three_d_necessity_verified": FLAG, "leakage_checked": FLAG},
            more=True,
        ),
    },
)

SCHEMAS: dict[str, Schema] = {
    "l0_geometry": GEOMETRY,
    "l1_entities": ENTITIES,
    "l2_relations": RELATIONS,
    "metadata_snapshot": SNAPSHOT,
    "canonical_task_record": RECORD,
}

SHARED = {"confidence": SHARE}
#: Answers whose shape is one; that of grounding has two of the same kind, which plans/answers.py judges.
ANSWERS: dict[str, Schema] = {
    "vqa_metric_distance_answer": shape({"object_id": ENTITY, "distance_m": LENGTH, "unit": {"const": "meter"}}, {"evidence_fields": TEXTS} | SHARED),
    "vqa_situated_direction_answer": shape({k: DIRECTION[k] for k in ("longitudinal", "lateral")}, {"vertical": DIRECTION["vertical"], "observer_pose_id": ENTITY} | SHARED),
    "cross_view_correspondence_answer": shape({"same_entity": FLAG}, {"reason": {"type": "string", "maxLength": 500}, "insufficient_evidence": FLAG} | SHARED),
}
