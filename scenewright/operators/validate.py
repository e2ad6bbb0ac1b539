"""Cross-layer checks of scene metadata; each gives rows (scene_id, code, location, detail), and no rows mean no issue."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenewright.functions import geometry as G
from scenewright.functions import text as T
from scenewright.plans import errors as E

COMPONENTS = ("semantic", "detector_box", "mask", "geometry", "association")


def _issues(df: DataFrame, code: str, location: str, detail: Column) -> DataFrame:
    return df.select("scene_id", F.lit(E.CODES[code]).alias("code"), F.lit(location).alias("location"), detail.alias("detail"))


def duplicate_ids(entities: DataFrame) -> DataFrame:
    """An issue for each repeat of an id within a scene, across entity kinds."""
    again = entities.filter("entity_id is not null").groupBy("scene_id", "entity_id").agg(F.count("*").alias("n")).filter("n > 1")
    return _issues(again.withColumn("k", F.explode(F.sequence(F.lit(2), "n"))), "DUPLICATE_ENTITY_ID", "l1_entities", F.col("entity_id"))


def malformed_ids(entities: DataFrame) -> DataFrame:
    return _issues(
        entities.filter(F.col("entity_id").isNotNull() & ~T.valid_id(F.col("entity_id"))).select("scene_id", "entity_id").distinct(),
        "BROKEN_ID_REFERENCE",
        "l1_entities",
        F.col("entity_id"),
    )


def broken_references(references: DataFrame, entities: DataFrame, location: str = "l2_relations") -> DataFrame:
    """references: scene_id, source, field, ref. Those whose ref no entity of the scene has."""
    there = entities.select("scene_id", F.col("entity_id").alias("ref"))
    lost = references.filter("ref is not null and ref <> ''").join(there, ["scene_id", "ref"], "left_anti")
    return _issues(lost, "BROKEN_ID_REFERENCE", location, F.concat_ws("|", "source", "field", "ref"))


def metric_claims(capabilities: DataFrame) -> DataFrame:
    """capabilities: scene_id, depth_type, domain_calibrated, anchor_verified, metric_task_eligible, scale_status. The claim must follow from the rest."""
    want = G.supports_metric_target(F.coalesce("depth_type", F.lit("pseudo")), F.col("domain_calibrated"), F.col("anchor_verified"))
    rows = capabilities.withColumn("want", want).withColumn("declared", F.coalesce("metric_task_eligible", F.lit(False)))
    found = [
        rows.filter("want is null").withColumn("what", F.lit("unknown depth type")),
        rows.filter("want is not null and declared <> want").withColumn("what", F.lit("claim does not follow")),
        rows.filter("want is not null and declared and coalesce(scale_status, '') <> 'metric'").withColumn("what", F.lit("scale is not metric")),
    ]
    return reduce(DataFrame.unionByName, [_issues(f, "SCALE_CLAIM_INCONSISTENT", "capabilities", F.col("what")) for f in found])


def unknown_programs(relations: DataFrame, known: list[str]) -> DataFrame:
    lost = relations.filter(F.col("program").isNotNull() & (F.col("program") != "") & ~F.col("program").isin(known))
    return _issues(lost, "DERIVED_FIELD_NOT_RECOMPUTABLE", "l2_relations", F.concat_ws("|", "relation_id", "program"))


def collapsed_masks(geometry: DataFrame) -> DataFrame:
    """geometry: scene_id, combined_uri, n_reason_masks. Only a combined mask, without its reasons."""
    return _issues(
        geometry.filter("coalesce(combined_uri, '') <> '' and coalesce(n_reason_masks, 0) = 0"), "REASON_MASKS_COLLAPSED", "l0_geometry", F.col("combined_uri"),
    )


def collapsed_confidence(entities: DataFrame, location: str = "l1_entities.objects") -> DataFrame:
    """Exactly one of the five components there and no support across views. Columns that are missing count as null."""
    have = lambda c: F.col(c) if c in entities.columns else F.lit(None).cast("double")
    n = sum(have(c).isNotNull().cast("int") for c in COMPONENTS)
    return _issues(entities.filter((n == 1) & have("cross_view_support").isNull()), "CONFIDENCE_COMPONENTS_COLLAPSED", location, F.col("entity_id"))


def primary_depth(depths: DataFrame, family: str = "vggt") -> DataFrame:
    """depths: scene_id, role, producer. Scenes with primary depth need one of the given family, and only one."""
    of = depths.filter("role = 'primary'").groupBy("scene_id").agg(
        F.count("*").alias("n"), F.bool_or(F.lower(F.coalesce("producer", F.lit(""))).contains(family)).alias("named"),
    )
    return _issues(
        of.filter("not named"), "CONFLICTING_SCALE_CLAIM", "l0_geometry.depth", F.lit("no primary of the required family"),
    ).unionByName(_issues(of.filter("n > 1"), "CONFLICTING_SCALE_CLAIM", "l0_geometry.depth", F.lit("more than one primary")))


def missing_digests(layers: DataFrame) -> DataFrame:
    """layers: scene_id, layer, uri, content_sha256; a layer that isn't there (null uri) is passed over."""
    return _issues(layers.filter("uri is not null and trim(coalesce(content_sha256, '')) = ''"), "MISSING_PROVENANCE", "layers", F.col("layer"))


def all_issues(*parts: DataFrame) -> DataFrame:
    """Issues of several checks with status and severity from the catalogue."""
    spark = parts[0].sparkSession
    return reduce(DataFrame.unionByName, parts).join(F.broadcast(E.catalog(spark)), "code")


def constraint_issues(df: DataFrame, constraints: dict[str, Column], key: str) -> DataFrame:
    """(key, constraint) for each named condition that isn't true of a row: structural validation."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in constraints.items()]))
    return df.select(F.col(key), F.explode(failed).alias("constraint"))


def scene_rules() -> dict[str, Column]:
    """Structural rules of normalized scenes with columns schema_version, scene_id, split_group_id, frames (array of struct with frame_id, timestamp_ns, K, pose, image_sha256)."""
    frames = F.col("frames")
    matrix = lambda m, n: (F.size(m) == n) & F.forall(m, lambda r: (F.size(r) == n) & F.forall(r, G.finite))
    return {
        "schema_version": F.col("schema_version").rlike(r"^\d+\.\d+\.\d+$"),
        "scene_id": F.length("scene_id") > 0,
        "split_group_id": F.length("split_group_id") > 0,
        "frames": F.size(frames) > 0,
        "frame_id": F.forall(
            frames, lambda f: F.length(f["frame_id"]) > 0,
        ), "timestamp_ns": F.forall(frames, lambda f: f["timestamp_ns"] >= 0), "K": F.forall(frames, lambda f: matrix(f["K"], 3)), "pose": F.forall(frames, lambda f: G.is_pose(f["pose"])),
        "image_sha256": F.forall(frames, lambda f: f["image_sha256"].isNull() | f["image_sha256"].rlike("^[0-9a-f]{64}$")),
    }


#: Fixed values of the file format: allowed words, and what ids and versions look like.
VERSION, TASK = r"^\d+\.\d+\.\d+$", r"^[a-z0-9_.]+@\d+\.\d+\.\d+$"
UNITS, SCALES = ("meter", "unknown"), ("metric", "relative", "unknown")
DEPTH_TYPES = ("metric", "externally_anchored", "relative", "affine_invariant", "pseudo")
GATES, STATUSES = ("G0", "G1", "G2", "G3", "G4", "G5", "G6"), ("pass", "warn", "quarantine", "reject")
CAPABILITIES = (
    "perception", "metric_geometry", "metric_terrain", "perception_reliability", "failure_attribution", "landability", "viewpoint_reasoning",
    "cross_view_identity", "visibility_occlusion", "temporal_change", "illumination_robustness", "uncertainty", "grounded_language",
)
LEVELS = ("strong", "deterministic_derived", "filtered_pseudo", "weak", "language_generated")
ADAPTERS = ("qwen_2d_metadata", "pointcloud_native", "multimodal_3d")


def layer_rules(layer: str) -> dict[str, Column]:
    """Structural rules of one layer's documents, by name: l0_geometry, l1_entities, l2_relations, metadata_snapshot, canonical_task_record. Columns are the documents' own fields."""
    named = lambda *fields: {f: F.length(F.col(f)) > 0 for f in fields}
    there = lambda *fields: {f: F.col(f).isNotNull() for f in fields}
    optional = lambda c: c.isNull() | (c >= 0)
    rules = {"schema_version": F.col("schema_version").rlike(VERSION)} | named("scene_id")
    if layer == "l0_geometry":
        return rules | named("coordinate_frame") | {
            "unit": F.col("unit").isin(*UNITS),
            "scale.status": F.col("scale.status").isin(*SCALES),
            "scale.depth_type": F.col("scale.depth_type").isin(*DEPTH_TYPES),
            "cameras": F.size("cameras") > 0,
            "depth": F.size("depth") > 0,
        }
    if layer == "l1_entities":
        return rules | there("objects", "surfaces", "regions") | {"objects.object_id": F.forall("objects", lambda o: T.valid_id(o["object_id"]))}
    if layer == "l2_relations":
        return rules | there("relations")
    if layer == "metadata_snapshot":
        caps = F.col("capabilities")
        return rules | named("snapshot_id", "dataset_id", "split_group_id") | {
            "layers": F.size(F.array_except(F.array(*[F.lit(x) for x in ("l0_geometry", "l1_entities", "l2_relations")]), F.map_keys("layers"))) == 0,
            "scale_status": caps["scale_status"].isin(*SCALES),
            "depth_type": caps["depth_type"].isin(*DEPTH_TYPES),
            "metric_task_eligible": caps["metric_task_eligible"].isNotNull(),
            "parallax_ratio": optional(caps["parallax_ratio"]),
            "entity_count": optional(caps["entity_count"]),
            "gate_id": F.col("gate.gate_id").isin(*GATES),
            "status": F.col("gate.status").isin(*STATUSES),
        }
    if layer == "canonical_task_record":
        words = lambda c, allowed: (F.size(c) > 0) & F.forall(c, lambda x: x.isin(*allowed))
        return rules | named("sample_id", "metadata_snapshot_id") | {
            "task_spec_id": F.col("task_spec_id").rlike(TASK),
            "capability_tags": words("capability_tags", CAPABILITIES),
            "supervision_level": F.col("supervision_level").isin(*LEVELS),
            "adapters": words("adapters", ADAPTERS), "hidden_target": F.col("hidden_target.target_type").isNotNull(),
        }
    raise KeyError(f"unknown layer {layer!r}")
