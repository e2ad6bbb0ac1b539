"""Queries over whole scenes and their layers, beside those of queries.py, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenewright.functions import text as T
from scenewright.operators import entities, grading, layers, scenes, validate
from scenewright.plans import render, specs
from scenewright.queries import _CASES, _PAIRED, _PKG, _REACH, _RUN, _VOTES, _lifted, compiled, query
from scenewright.sources import readers
from scenewright.sources import views as V

# --- scenes of recordings ---

_SCENES = f""", {_PAIRED},
  po AS (SELECT run, stem, max(pos) AS pos, arg_max(x, pos) AS x, arg_max(y, pos) AS y, arg_max(z, pos) AS z FROM v_poses GROUP BY ALL),
  cl AS (SELECT DISTINCT split_part(path, '/', 2) AS run, regexp_extract(path, 'image([\\d.]+)_lidar', 1) AS stem FROM v_members WHERE archive = 'interval5_LIDAR_label'),
  im AS (SELECT p.*, po.pos IS NOT NULL AS there, po.x, po.y, po.z, cl.stem IS NOT NULL AS has3,
    row_number() OVER (PARTITION BY p.run ORDER BY p.ts_ns, p.stem) - 1 AS n, count(*) OVER (PARTITION BY p.run) AS total
    FROM paired p LEFT JOIN po ON p.run = po.run AND p.stem = po.stem LEFT JOIN cl ON p.run = cl.run AND p.stem = cl.stem),
  wi AS (SELECT *, n // 50 AS scene_index FROM im WHERE least(50, total - n // 50 * 50) >= 20),
  sc AS (SELECT run, scene_index, count(*) AS frames_requested, count(*) FILTER (there) AS frames_emitted, count(*) FILTER (NOT there) AS frames_missing_pose,
    count(*) FILTER (there AND lidar_ns IS NULL) AS frames_missing_lidar, min(ts_ns) FILTER (there) AS a, max(ts_ns) FILTER (there) AS b,
    round(max(x) - min(x), 3) AS span_x, round(max(y) - min(y), 3) AS span_y, round(max(z) - min(z), 3) AS span_z,
    bool_or(there AND label_path IS NOT NULL) AS labels_2d, bool_or(there AND has3) AS labels_3d,
    string_agg(CASE WHEN there THEN stem END, ',' ORDER BY n) AS stems FROM wi GROUP BY ALL)"""


@query(
    V.with_views(
        _SCENES + f""" SELECT 'uavscenes_' || replace(run, 'interval5_', '') || '_' || lpad(CAST(scene_index AS VARCHAR), 4, '0') AS scene_id, {_RUN} AS split_group,
          frames_requested, frames_emitted, frames_missing_pose, frames_missing_lidar,
    round((b - a)/1e9, 3) AS duration_s, (SELECT count(*) FROM v_tracks t WHERE t.run = sc.run AND t.ts_ns BETWEEN sc.a AND sc.b) AS track_samples, span_x, span_y,
      span_z,
    concat_ws(',', CASE WHEN labels_2d THEN 'semantic_2d' END, CASE WHEN labels_3d THEN 'semantic_3d' END) AS annotations, sha256(stems) AS frames FROM sc""",
        "members",
        "poses",
        "tracks",
    )
)
def e6_scenes(spark: SparkSession, sf: str) -> DataFrame:
    """Whole scenes with every diagnostic: runs overlap in time, poses repeat, and a tenth of the frames has none."""
    s = scenes.build_scenes(scenes.pair_frames(V.members(spark, sf), V.poses(spark, sf)), V.tracks(spark, sf))
    names = ("scene_id", "split_group", "frames_requested", "frames_emitted", "frames_missing_pose", "frames_missing_lidar", "duration_s", "track_samples")
    return s.select(
        *names,
        *[F.get("span", F.lit(k)).alias(f"span_{c}") for k, c in enumerate("xyz")],
        F.array_join("annotations", ",").alias("annotations"),
        F.sha2(F.array_join(F.col("frames.frame_id"), ","), 256).alias("frames"),
    )


@query(
    V.with_views(
        f", {_PAIRED}, po AS (SELECT run, stem, max(pos) AS pos, arg_max(z, pos) AS z FROM v_poses GROUP BY ALL) SELECT p.run, p.stem, coalesce(pos, -1) AS pos, "
            f"z FROM paired p LEFT JOIN po ON p.run = po.run AND p.stem = po.stem",
        "members",
        "poses",
    )
)
def j1_frames_with_poses(spark: SparkSession, sf: str) -> DataFrame:
    """Frames with their run's pose, the last of repeated ones; null where there is none."""
    paired = scenes.pair_frames(V.members(spark, sf), V.poses(spark, sf))
    return paired.select("run", "stem", F.coalesce("pose.pos", F.lit(-1).cast("bigint")).alias("pos"), F.get(F.get("pose.T4x4", F.lit(2)), F.lit(3)).alias("z"))


# --- layers ---


def _cameras(spark: SparkSession, sf: str) -> DataFrame:
    s = V.table(spark, sf, "supplier")
    return s.select(
        F.concat(F.lit("scene_"), F.expr("cast(s_suppkey div 10 as string)")).alias("scene_id"),
        (F.col("s_acctbal") / 100).alias("x"),
        F.col("s_suppkey").cast("double").alias("y"),
        F.col("s_nationkey").cast("double").alias("z"),
    )


def _geometry(spark: SparkSession, sf: str) -> DataFrame:
    return layers.geometry_layer(entities.depth_statistics(V.pixels(spark, sf)), entities.camera_span(_cameras(spark, sf), ["scene_id"]))


_L0 = """, f AS (SELECT scene_id, quantile_cont(conf, 0.25) AS conf_floor, quantile_cont(depth, 0.5) AS median_depth FROM v_pixels GROUP BY scene_id),
  ca AS (SELECT 'scene_' || (s_suppkey // 10) AS scene_id, s_acctbal/100 AS x, CAST(s_suppkey AS DOUBLE) AS y, CAST(s_nationkey AS DOUBLE) AS z FROM supplier),
  sp AS (SELECT scene_id, sqrt((max(x)-min(x))**2 + (max(y)-min(y))**2 + (max(z)-min(z))**2) AS span FROM ca GROUP BY scene_id),
  l0 AS (SELECT p.scene_id, avg(CASE WHEN conf > conf_floor THEN 1.0 ELSE 0.0 END) AS coverage, max(median_depth) AS median_depth, max(span) AS camera_span,
    max(span)/greatest(max(median_depth), 1e-9) AS parallax_ratio
    FROM v_pixels p JOIN f USING (scene_id) JOIN sp USING (scene_id) GROUP BY p.scene_id)"""


@query(
    V.with_views(
        _L0 +
            " SELECT scene_id, 'vggt_omega_local::' || scene_id AS coordinate_frame, 'relative' AS scale_status, 'dep_' || substr(sha256(scene_id || '|vggt'), 1, "
            "8) AS artifact_id, round(coverage, 6) AS coverage, round(median_depth, 6) AS median_depth, round(camera_span, 6) AS camera_span, round(parallax_ratio, "
            "6) AS parallax_ratio FROM l0",
        "pixels",
    )
)
def e1_geometry_layer(spark: SparkSession, sf: str) -> DataFrame:
    g = _geometry(spark, sf)
    return g.select(
        "scene_id",
        "coordinate_frame",
        F.col("scale.status").alias("scale_status"),
        F.get("depth", F.lit(0))["artifact_id"].alias("artifact_id"),
        *[F.round(c, 6).alias(c) for c in ("coverage", "median_depth", "camera_span", "parallax_ratio")],
    )


def _entities(spark: SparkSession, sf: str) -> DataFrame:
    return layers.entity_rows(entities.objects_of(_lifted(spark, sf), entities.depth_statistics(V.pixels(spark, sf)), 5, 3), T.CLASSES[:2])


_L1 = """, fl AS (SELECT scene_id, quantile_cont(conf, 0.25) AS conf_floor, max(conf) AS top FROM v_pixels GROUP BY scene_id),
  pw AS (SELECT p.*, c.component, fl.top, (p.x - 10)/20.0*depth + 1 AS px, (p.y - 10)/20.0*depth + 2 AS py, depth + 3 AS pz, p.conf >= fl.conf_floor AS good
    FROM v_pixels p JOIN c ON p.frame = c.frame AND p.class_id = c.class_id AND p.y*20 + p.x = c.id JOIN fl ON p.scene_id = fl.scene_id),
  ob AS (SELECT scene_id, frame, class_id, component, count(*) FILTER (good) AS n_points, avg(px) FILTER (good) AS cx,
    max(pz) FILTER (good) - min(pz) FILTER (good) AS ez, avg(conf) FILTER (good)/(max(top) + 1e-9) AS confidence
    FROM pw GROUP BY ALL HAVING count(*) >= 5 AND count(*) FILTER (good) >= 3)"""


@query(V.with_views(_REACH + _L1 + f""" SELECT scene_id, format('<obj_{{:03d}}>', row_number() OVER (PARTITION BY scene_id ORDER BY frame, class_id,
    component)) AS object_id, coalesce({V._CLASS_LIST}[:2][class_id + 1], 'class_' || class_id) AS category,
  round(cx, 3) AS cx, round(ez, 3) AS extent_z, n_points AS point_count, CAST(frame AS VARCHAR) AS visible_frames, round(confidence, 3) AS confidence,
    'uavscenes_native_semantic,VGGT-Omega/1b_512' AS producers FROM ob""", "pixels", recursive=True))
def e2_entity_layer(spark: SparkSession, sf: str) -> DataFrame:
    o = _entities(spark, sf)
    return o.select(
        "scene_id",
        "object_id",
        "category",
        F.round(F.get("centroid", F.lit(0)), 3).alias("cx"),
        F.round(F.get("extent", F.lit(2)), 3).alias("extent_z"),
        "point_count",
        F.array_join(
            F.col("visible_frames").cast("array<string>"), ",",
        ).alias("visible_frames"), F.round("confidence.geometry", 3).alias("confidence"), F.array_join("provenance.producers", ",").alias("producers"),
    )


@query(V.with_views(_REACH + _L1 + _L0.replace(" f AS", " fq AS").replace("JOIN f USING", "JOIN fq USING") + """, en AS (SELECT scene_id, count(*) AS n FROM ob
    WHERE class_id = 0 AND component = 0 GROUP BY scene_id)
  SELECT 'meta_' || substr(sha256(l0.scene_id || '|pipeline-0.1.0'), 1, 8) AS snapshot_id, l0.scene_id, 'g' || length(l0.scene_id) AS split_group, round(parallax_ratio,
    6) AS parallax_ratio, coalesce(n, 0) AS entity_count,
  CASE WHEN coalesce(n, 0) < 3 THEN 'warn' ELSE 'pass' END AS gate_status, CASE WHEN coalesce(n, 0) < 3 THEN coalesce(n,
    0) || ' entities, fewer than 3' ELSE '' END AS warnings, sha256(l0.scene_id) AS l0_digest, '2026-01-01T00:00:00Z|pipeline-0.1.0' AS made FROM l0 LEFT JOIN en ON l0.scene_id = en.scene_id""", "pixels",
    recursive=True))
def e4_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """Snapshots over the geometry layer and the first components of class 0 only, so that some scenes have too few entities."""
    first = entities.objects_of(_lifted(spark, sf), entities.depth_statistics(V.pixels(spark, sf)), 5, 3).filter("class_id = 0 and component = 0")
    geometry = readers.materialized(_geometry(spark, sf))
    digests = geometry.select("scene_id", F.create_map(F.lit("l0_geometry"), F.sha2("scene_id", 256)).alias("layers"))
    groups = geometry.select("scene_id", F.concat(F.lit("g"), F.length("scene_id").cast("string")).alias("split_group"))
    s = layers.snapshots(geometry, layers.entity_rows(first, T.CLASSES), digests, groups, "uavscenes", "2026-01-01T00:00:00Z")
    return s.select(
        "snapshot_id",
        "scene_id",
        F.col("split_group_id").alias("split_group"),
        F.round("capabilities.parallax_ratio", 6).alias("parallax_ratio"),
        "capabilities.entity_count",
        F.col("gate.status").alias("gate_status"),
        F.array_join("gate.warnings", ",").alias("warnings"),
        F.try_element_at("layers", F.lit("l0_geometry")).alias("l0_digest"), F.concat_ws("|", "provenance.created_at", "provenance.code_version").alias("made"),
    )


@query(
    V.with_views(
        _VOTES +
            f", cn AS (SELECT instance_id, label, (y1 - y0 + 1)*(x1 - x0 + 1) AS mask_pixels, CASE {_CASES} ELSE 'other' END AS canonical FROM v_masks) "
            f"SELECT w.instance_id, {V._CLASS_LIST}[class_id + 1] AS category, label AS label_proposed, canonical AS label_proposed_canonical, "
            f"{V._CLASS_LIST}[class_id + 1] = canonical AS category_agrees, mask_pixels, 'grounded_sam2::gdino_base+sam2.1_hiera_bplus' AS boundary_from, "
            f"'oneformer_ade20k_swin_large' AS category_from FROM w JOIN cn USING (instance_id) WHERE k = 1",
        "masks",
        "pixels",
    )
)
def e5_proposed_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the label proposed for an instance agrees with the vote that names it."""
    m = V.masks(spark, sf)
    out = entities.with_proposals(entities.fuse_instances(m, V.pixels(spark, sf), [0]), m, T.CLASSES)
    return out.select(
        "instance_id", "category", "label_proposed", "label_proposed_canonical", "category_agrees", "mask_pixels", "boundary_from", "category_from",
    )


@query(
    V.with_views(
        """ SELECT instance_id, frame, CASE WHEN frame % 4 = 0 THEN 'no such frame' ELSE 'shape differs from the frame''s' END AS err FROM v_masks
  WHERE frame % 4 = 0 OR (frame % 3 = 0 AND (y1 >= 15 OR x1 >= 18))""",
        "masks",
    )
)
def j12_misfits(spark: SparkSession, sf: str) -> DataFrame:
    """Masks over frames of 20 x 20, but every third has 15 x 18 and every fourth is missing."""
    frame = F.col("s_suppkey")
    small = frame % 3 == 0
    height, width = (F.when(small, n).otherwise(V.SIDE) for n in (15, 18))
    shapes = V.table(spark, sf, "supplier").filter("s_suppkey % 4 <> 0").select(frame.alias("frame"), height.alias("height"), width.alias("width"))
    return entities.misfits(V.masks(spark, sf), shapes)


@query(
    "SELECT instance_id, k, iou FROM (SELECT *, row_number() OVER (PARTITION BY instance_id ORDER BY iou DESC NULLS LAST, k) AS r "
        "FROM (SELECT p_partkey AS instance_id, CAST(u.k AS BIGINT) AS k, CASE WHEN (p_partkey + u.k) % 11 = 0 THEN NULL ELSE (p_partkey*(u.k + 3)*7 % "
        "10)/10.0::DOUBLE END AS iou FROM part, unnest(range(0, 3)) AS u(k))) WHERE r = 1"
)
def t5_best_masks(spark: SparkSession, sf: str) -> DataFrame:
    p = V.table(spark, sf, "part").select(
        F.col("p_partkey").alias("instance_id"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(2).cast("bigint"))).alias("k"),
    )
    iou = F.when((F.col("instance_id") + F.col("k")) % 11 != 0, (F.col("instance_id") * (F.col("k") + 3) * 7 % 10) / 10.0)
    return entities.best_masks(p.withColumn("iou", iou))


_LEVELS = [*specs.LEVELS, "unheard_of"]


@query(
    f"SELECT level, coalesce(level IN ('strong', 'deterministic_derived'), false) AS for_evaluation, count(*) AS n "
        f"FROM (SELECT [{', '.join(repr(x) for x in _LEVELS)}, NULL][p_partkey % {len(_LEVELS) + 1} + 1] AS level FROM part) GROUP BY ALL"
)
def p15_evaluation_levels(spark: SparkSession, sf: str) -> DataFrame:
    level = F.get(F.array(*[F.lit(x) for x in _LEVELS], F.lit(None).cast("string")), (F.col("p_partkey") % (len(_LEVELS) + 1)).cast("int"))
    return V.table(spark, sf, "part").select(level.alias("level")).groupBy("level").agg(F.count("*").alias("n")).withColumn(
        "for_evaluation", specs.for_evaluation(F.col("level")),
    ).select("level", "for_evaluation", "n")


@query(
    """WITH s AS (SELECT 'scene_' || s_suppkey AS scene_id, s_suppkey AS k FROM supplier),
  i AS (SELECT scene_id, 'l0_geometry' AS layer, 'unit' AS c FROM s WHERE k % 3 = 0 UNION ALL SELECT scene_id, 'l0_geometry', 'depth' FROM s WHERE k % 5 = 0 UNION ALL
    SELECT scene_id, 'l0_geometry', 'scale.status' FROM s WHERE k % 4 = 3
  UNION ALL SELECT scene_id, 'l0_geometry', 'schema_version' FROM s WHERE k % 9 = 0
  UNION ALL SELECT scene_id, 'l1_entities', 'objects.object_id' FROM s WHERE k % 6 = 1 UNION ALL SELECT scene_id, 'l1_entities', 'regions' FROM s WHERE k % 7 = 0
  UNION ALL SELECT scene_id, 'l2_relations', 'relations' FROM s WHERE k % 8 = 0
  UNION ALL SELECT scene_id, 'metadata_snapshot', 'layers' FROM s WHERE k % 4 = 0 UNION ALL SELECT scene_id, 'metadata_snapshot', 'parallax_ratio' FROM s WHERE k % 5 = 1
    UNION ALL SELECT scene_id, 'metadata_snapshot', 'status' FROM s WHERE k % 6 = 0
  UNION ALL SELECT scene_id, 'metadata_snapshot', 'snapshot_id' FROM s WHERE k % 10 = 0
  UNION ALL SELECT scene_id, 'canonical_task_record', 'task_spec_id' FROM s WHERE k % 3 = 1 UNION ALL SELECT scene_id, 'canonical_task_record', 'capability_tags' FROM s
    WHERE k % 4 = 2 OR k % 5 = 2
  UNION ALL SELECT scene_id, 'canonical_task_record', 'adapters' FROM s WHERE k % 7 = 1 UNION ALL SELECT scene_id, 'canonical_task_record', 'hidden_target' FROM s
    WHERE k % 11 = 0)
  SELECT scene_id, layer, c AS "constraint" FROM i"""
)
def v2_layer_issues(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of every layer, each broken in ways that its number decides."""
    k = F.col("s_suppkey")
    s = V.table(spark, sf, "supplier").select(
        F.concat(F.lit("scene_"), k.cast("string")).alias("scene_id"), k.alias("k"), F.lit("0.1.0").alias("schema_version"),
    )
    k = F.col("k")
    good = F.array(F.lit("x"))
    l0 = s.select(
        "scene_id",
        F.when(k % 9 == 0, "one").otherwise("0.1.0").alias("schema_version"),
        F.lit("local").alias("coordinate_frame"),
        F.when(k % 3 == 0, "feet").otherwise("meter").alias("unit"),
        F.struct(
            F.when(k % 4 != 3, "metric").alias("status"), F.lit("relative").alias("depth_type"),
        ).alias("scale"), good.alias("cameras"), F.when(k % 5 == 0, F.slice(good, 1, 0)).otherwise(good).alias("depth"),
    )
    ids = F.array(F.struct(F.when(k % 6 == 1, "obj_1").otherwise("<obj_001>").alias("object_id")))
    l1 = s.select("scene_id", "schema_version", ids.alias("objects"), good.alias("surfaces"), F.when(k % 7 != 0, good).alias("regions"))
    l2 = s.select("scene_id", "schema_version", F.when(k % 8 != 0, good).alias("relations"))
    refs = F.create_map(F.lit("l0_geometry"), F.lit("a"), F.lit("l1_entities"), F.lit("b"), F.when(k % 4 == 0, "l3").otherwise("l2_relations"), F.lit("c"))
    caps = F.struct(
        F.lit("relative").alias("scale_status"),
        F.lit("relative").alias("depth_type"),
        F.lit(False).alias("metric_task_eligible"),
        F.when(k % 5 == 1, -1.0).when(k % 5 == 2, 0.5).alias("parallax_ratio"),
        F.lit(3).alias("entity_count"),
    )
    snap = s.select(
        "scene_id",
        "schema_version",
        F.when(k % 10 == 0, "").otherwise("meta_1").alias("snapshot_id"),
        F.lit("d").alias("dataset_id"),
        F.lit("g").alias("split_group_id"),
        refs.alias("layers"),
        caps.alias("capabilities"),
        F.struct(F.lit("G2").alias("gate_id"), F.when(k % 6 == 0, "maybe").otherwise("warn").alias("status")).alias("gate"),
    )
    tags = F.when(k % 4 == 2, F.array().cast("array<string>")).when(
        k % 5 == 2, F.array(F.lit("perception"), F.lit("magic")),
    ).otherwise(F.array(F.lit("perception")))
    record = s.select(
        "scene_id",
        "schema_version",
        F.lit("task_sample_1").alias("sample_id"),
        F.when(k % 3 == 1, "Task 1").otherwise("3d_grounding.object@0.1.0").alias("task_spec_id"),
        F.lit("meta_1").alias("metadata_snapshot_id"),
        tags.alias("capability_tags"),
        F.lit("strong").alias("supervision_level"), F.array(F.when(k % 7 == 1, "other").otherwise("multimodal_3d")).alias("adapters"), F.struct(
            F.when(k % 11 != 0, "object_grounding").alias("target_type")
        ).alias("hidden_target"),
    )
    out = None
    for name, df in (("l0_geometry", l0), ("l1_entities", l1), ("l2_relations", l2), ("metadata_snapshot", snap), ("canonical_task_record", record)):
        got = validate.constraint_issues(df, validate.layer_rules(name), "scene_id").select("scene_id", F.lit(name).alias("layer"), "constraint")
        out = got if out is None else out.unionByName(got)
    return out


# --- arms of a comparison ---

_SHOWN = "observer struct<pose_id:string>, entities array<struct<object_id:string,geometry:struct<centroid:array<double>>>>"


@query(
    V.with_views(
        """, o AS (SELECT scene_id, string_agg(object_id, ',' ORDER BY sha256(scene_id || '|entities|' || object_id)) AS ids, count(*) AS n FROM v_objects
          GROUP BY scene_id)
  SELECT scene_id, arm, ids, arm <> 'a' AS has_observer, arm <> 'a' AS has_geometry, CASE WHEN arm = 'c' AND n > 1 THEN n WHEN arm = 'a' THEN n ELSE 0 END AS n_other
    FROM o, (VALUES ('a'), ('b'), ('c')) t(arm)""",
        "objects",
    )
)
def f21_arms(spark: SparkSession, sf: str) -> DataFrame:
    """What each arm shows of the direction task: ids stay, and n_other candidates have not their own geometry."""
    c = compiled(spark, sf, "3d_vqa.situated.observer_relative_direction").select("sample_id", "scene_id", F.from_json("visible", _SHOWN).alias("metadata"))
    seen = grading.arms(c, "metadata").withColumn("v", F.from_json("view", _SHOWN))
    own, given = F.col("metadata")["entities"], F.col("v")["entities"]
    other = F.filter(F.zip_with(own, given, lambda a, b: ~F.coalesce(a["geometry"]["centroid"] == b["geometry"]["centroid"], F.lit(False))), lambda x: x)
    return seen.select(
        "scene_id",
        "arm",
        F.array_join(given["object_id"], ",").alias("ids"),
        F.col("v")["observer"].isNotNull().alias("has_observer"),
        F.exists(given, lambda e: e["geometry"].isNotNull()).alias("has_geometry"),
        F.size(other).cast("bigint").alias("n_other"),
    )


@query(
    V.with_views(
        _PKG + """ SELECT f.scene_id, arm, CAST(CASE WHEN arm = 'b' OR label % 2 = 0 THEN 2 ELSE 0 END AS BIGINT) AS hits, CAST(2 AS BIGINT) AS trials,
          abs(d1 - d2) < 0.05*greatest(d1, 1e-9) AS is_ambiguous, '{"object_id": "<obj_XXX>"}' AS hint
  FROM f JOIN g USING (scene_id) JOIN p USING (scene_id), (VALUES ('a'), ('b'), ('c')) t(arm) WHERE reasons = ''""",
        "objects",
    )
)
def j13_graded_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Answers meet their records and samples; some answer samples that don't exist. Arm b is always right, the others in even scenes."""
    records = readers.materialized(compiled(spark, sf, "3d_grounding.object"))
    rendered = render.render(records, "multimodal_3d")
    label = F.split("scene_id", "_")[1].cast("int")
    trials = F.explode(F.array(*[F.struct(F.lit(a).alias("arm"), F.lit(t).alias("trial")) for a in grading.ARMS for t in range(2)]))
    said = records.filter("status = 'record'").select("sample_id", "scene_id", F.col("target.object_id").alias("right"), trials.alias("e")).select(
        "sample_id", "e.*", F.when((F.col("e.arm") == "b") | (label % 2 == 0), F.col("right")).otherwise("<obj_999999>").alias("object_id"),
    )
    said = said.unionByName(said.withColumn("sample_id", F.lit("task_sample_none")))
    met = grading.answered(said, records, rendered)
    wanted = F.col("target")["object_id"]
    result = grading.check_grounding(F.struct("object_id", F.lit(False).alias("ambiguous")), wanted, F.array(wanted, F.lit("<obj_999999>")), F.array())
    counted = grading.hits(met.withColumn("result", result), ["scene_id", "spec_id", "is_ambiguous"])
    return counted.select("scene_id", "arm", "hits", "trials", "is_ambiguous", render.answer_hint(F.col("spec_id")).alias("hint"))


@query(
    """WITH d AS (SELECT event_id, event_id % 5 AS k FROM events)
  SELECT event_id, CASE k WHEN 0 THEN 'v' || event_id WHEN 4 THEN CAST(event_id AS VARCHAR) END AS value,
    CASE k WHEN 1 THEN 'null: a.b' WHEN 2 THEN 'missing: a.b' WHEN 3 THEN 'missing: a.b' END AS err FROM d"""
)
def f25_required_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Fields that are there, null, or missing at either level, and a number."""
    k, i = F.col("event_id") % 5, F.col("event_id").cast("string")
    said = F.when(
        k == 0, F.concat(F.lit('{"a": {"b": "v'), i, F.lit('"}}')),
    ).when(k == 1, '{"a": {"b": null}}').when(k == 2, '{"a": {"c": 1}}').when(k == 3, '{"b": 1}').otherwise(F.concat(F.lit('{"a": {"b": '), i, F.lit("}}")))
    r = T.required(said, "a.b")
    return V.table(spark, sf, "events").select("event_id", r.alias("r")).select("event_id", "r.value", "r.err")
