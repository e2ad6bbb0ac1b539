"""Layers of a scene's metadata from what operators measured: geometry, entities, snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenewright.functions import text as T

#: What wrote a layer, by where its semantics come from, and what every layer states about its scale.
DEPTH_PRODUCER, CODE_VERSION, SCHEMA_VERSION = "VGGT-Omega/1b_512", "pipeline-0.1.0", "0.1.0"
SEMANTIC_PRODUCERS = {"model": "OneFormer/ade20k_swin_large", "native": "uavscenes_native_semantic"}
#: A snapshot with fewer entities lets pass with a warning only.
LEAST_ENTITIES = 3


def parallax_ratio(span: Column, median_depth: Column) -> Column:
    """Baseline over depth: whether views are far enough apart, in any unit."""
    return span / F.greatest(median_depth, F.lit(1e-9))


def geometry_layer(statistics: DataFrame, spans: DataFrame) -> DataFrame:
    """One row per scene of depth_statistics and camera_span: the geometry layer without any claim to metric scale."""
    rows = statistics.join(spans.select("scene_id", "span"), "scene_id")
    scale = F.struct(
        F.lit("relative").alias("status"),
        F.lit("none").alias("source"),
        F.lit("relative").alias("depth_type"),
        F.lit(False).alias("domain_calibrated"),
        F.lit(False).alias("anchor_provenance_verified"),
    )
    depth = F.struct(
        F.concat(F.lit("dep_"), T.short_hash(F.col("scene_id"), F.lit("vggt"))).alias("artifact_id"),
        F.lit(DEPTH_PRODUCER).alias("producer"),
        F.lit("primary").alias("role"),
        F.lit("relative").alias("depth_type"),
    )
    return rows.select(
        F.lit(SCHEMA_VERSION).alias("schema_version"), "scene_id", F.concat(
            F.lit("vggt_omega_local::"), "scene_id",
        ).alias("coordinate_frame"), F.lit("unknown").alias("unit"), scale.alias("scale"), F.array(depth).alias("depth"),
        "coverage",
        "invalid_ratio",
        F.col("span").alias("camera_span"),
        "median_depth",
        parallax_ratio(F.col("span"), F.col("median_depth")).alias("parallax_ratio"),
    )


def entity_rows(objects: DataFrame, classes: list[str], semantic_source: str = "native") -> DataFrame:
    """Objects of components (objects_of) as rows of the entity layer, numbered within a scene by frame, class and component.

    category is the class's name, class_<id> beyond the list. The box is axis-aligned. A scene's objects are numbered by one task.
    """
    order = Window.partitionBy("scene_id").orderBy("frame", "class_id", "component")
    name = F.coalesce(F.get(F.array(*[F.lit(c) for c in classes]), F.col("class_id").cast("int")), F.concat(F.lit("class_"), F.col("class_id").cast("string")))
    centroid = F.array("cx", "cy", "cz")
    low, high = (F.array(*[F.col(f"{n}_{c}") for c in "xyz"]) for n in ("min", "max"))
    extent = F.array(*[F.col(f"max_{c}") - F.col(f"min_{c}") for c in "xyz"])
    confidence = F.struct(F.lit(0.95).alias("semantic"), F.col("confidence").alias("geometry"), F.lit(False).alias("calibrated"))
    provenance = F.struct(
        F.array(F.lit(SEMANTIC_PRODUCERS[semantic_source]), F.lit(DEPTH_PRODUCER)).alias("producers"),
        F.lit("semantic_mask_backprojection").alias("derivation_program"),
        F.lit("deterministic_derived").alias("supervision_level"),
    )
    return objects.select(
        "scene_id",
        T.format_id("obj", F.row_number().over(order)).alias("object_id"),
        name.alias("category"),
        centroid.alias("centroid"),
        F.concat(low, high).alias("aabb"),
        extent.alias("extent"),
        F.col("n_points").alias("point_count"), F.array("frame").alias("visible_frames"), confidence.alias("confidence"), provenance.alias("provenance"),
    )


def snapshots(geometry: DataFrame, entities: DataFrame, digests: DataFrame, groups: DataFrame, dataset: str, created_at: str | None = None) -> DataFrame:
    """One snapshot per scene of the geometry layer: capabilities, layer digests, entity_count and its gate.

    entities: scene_id of each; digests: scene_id, layers (map of name to digest); groups: scene_id, split_group. A
    scene without entities has a count of 0. Relations that nobody derived are an empty layer, not a missing one.
    created_at is what the caller says it is; no clock is read, so that runs can be compared.
    """
    counts = entities.groupBy("scene_id").agg(F.count("*").alias("entity_count"))
    rows = geometry.select("scene_id", "parallax_ratio").join(counts, "scene_id", "left").fillna(0, ["entity_count"]).join(digests, "scene_id", "left").join(groups, "scene_id", "left")
    few = F.col("entity_count") < LEAST_ENTITIES
    caps = F.struct(
        F.lit("relative").alias("scale_status"),
        F.lit("relative").alias("depth_type"),
        F.lit(False).alias("metric_task_eligible"),
        F.array(F.lit("object")).alias("available_entity_types"),
        F.lit(None).cast("double").alias("camera_baseline_m"),
        "parallax_ratio",
        F.lit(None).cast("double").alias("nadir_angle_median_deg"),
        F.lit(None).cast("double").alias("depth_relief_ratio"),
        "entity_count",
    )
    warning = F.when(few, F.array(F.format_string(f"%d entities, fewer than {LEAST_ENTITIES}", "entity_count"))).otherwise(F.array().cast("array<string>"))
    gate = F.struct(F.lit("G2").alias("gate_id"), F.when(few, "warn").otherwise("pass").alias("status"), warning.alias("warnings"))
    versions = F.create_map(*[F.lit(x) for n in ("l0_geometry", "l1_entities", "metadata_snapshot") for x in (n, SCHEMA_VERSION)])
    provenance = F.struct(F.lit(created_at).cast("string").alias("created_at"), F.lit(CODE_VERSION).alias("code_version"), versions.alias("schema_versions"))
    return rows.select(
        F.lit(SCHEMA_VERSION).alias("schema_version"), F.concat(
            F.lit("meta_"), T.short_hash(F.col("scene_id"), F.lit(CODE_VERSION)),
        ).alias("snapshot_id"), "scene_id", F.lit(dataset).alias("dataset_id"),
        F.col("split_group").alias("split_group_id"), "layers", caps.alias("capabilities"), gate.alias("gate"), provenance.alias("provenance"),
    )
