"""Task specifications compiled over scene packages: eligibility, answer, field mask, shuffle, leakage scan, record.

A package is one row per scene with columns scene_id, caps, cameras (of the entity layer, then of the relation layer),
objects, links, observer_pose_id, question, visual_inputs, pointcloud_ref, and perhaps surfaces and regions. All steps of one specification are one narrow transformation, so compiling adds no
shuffle; specifications are few and known when the plan is made, so their plans are united instead of joined.
Outcomes are rows: status is record, skipped (with reasons) or failed (with code and detail).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from scenewright.functions import geometry as G
from scenewright.plans import errors, leakage, projection
from scenewright.plans.specs import Spec, SpecError

TARGET = "struct<distance_to_observer:double,is_ambiguous:boolean,lateral:string,lateral_angle_deg:double,longitudinal:string,minimum_distance:double,nearest_segment_index:int,object_id:string,point_support_iou:double,same_entity:boolean,target_type:string>"
#: Ordinal answers are unique if the two best differ by this share of the best.
MARGIN = 0.05
#: Half length of the stand-in for a missing centre line, in metres.
STUB = 0.001
CHECKERS = {
    "check_minimum_distance_answer", "check_object_grounding_answer", "check_observer_relative_direction_answer", "check_cross_view_correspondence_answer",
}


def _target(**values: Column) -> Column:
    fields = [f.split(":") for f in TARGET.removeprefix("struct<").removesuffix(">").split(",")]
    return F.struct(*[values.get(n, F.lit(None)).cast(k).alias(n) for n, k in fields])


def _answer(target: Column, ambiguous: Column, equivalent: Column, *checks: tuple[Column, str]) -> Column:
    """struct(value: struct(target, is_ambiguous, equivalent), err)."""
    return G.outcome(
        F.struct(
            target.alias("target"),
            F.coalesce(ambiguous, F.lit(False)).alias("is_ambiguous"),
            F.coalesce(equivalent, F.array().cast("array<string>")).alias("equivalent"),
        ),
        *checks,
    )


def observer_camera() -> Column:
    """The first camera with the observer's pose id, null if there is none."""
    return F.get(F.filter("cameras", lambda c: c["pose_id"] == F.col("observer_pose_id")), F.lit(0))


def best_view_observer(objects: Column, cameras: Column) -> Column:
    """struct(pose_id, position, forward) of the first camera with the first frame in which the first object is seen.

    cameras: array of struct(pose_id, frame_id, pose); null if there is no such camera or its pose isn't rigid.
    """
    frame = F.get(F.get(objects, F.lit(0))["visibility"]["visible_frames"], F.lit(0))
    cam = F.get(F.filter(cameras, lambda c: c["frame_id"] == frame), F.lit(0))
    return F.when(
        G.is_pose(cam["pose"]),
        F.struct(
            cam["pose_id"].alias("pose_id"), G.camera_center(cam["pose"])["value"].alias("position"), G.camera_forward(cam["pose"])["value"].alias("forward"),
        ),
    )


def minimum_distance(spec: Spec) -> Column:
    """Nearest centre line; a candidate without one stands for a short segment at its centroid."""
    eye = F.col("observer")["position"]

    def of(o: Column, i: Column) -> Column:
        c = o["geometry"]["centroid"]
        line = F.when(F.size(o["geometry"]["centerline"]) >= 2, o["geometry"]["centerline"]).otherwise(F.array(c, G.add(c, G.vec(STUB, 0, 0))))
        return G.let(
            line,
            lambda at: G.let(
                G.point_to_polyline(eye, at),
                lambda r: F.struct(
                    r["value"]["d"].alias("d"), i.alias("pos"), r["value"]["seg"].alias("seg"), o["object_id"].alias("id"), r["err"].alias("err"),
                ),
            ),
        )

    def answer(ranked: Column) -> Column:
        first, second = F.get(ranked, F.lit(0)), F.get(ranked, F.lit(1))
        close = second["d"] - first["d"] <= (spec.tolerance or 0.1)
        return _answer(
            _target(
                target_type=F.lit("minimum_distance"), object_id=first["id"], minimum_distance=F.round(first["d"], 4), nearest_segment_index=first["seg"],
            ), close, F.when(close, F.array(first["id"], second["id"])),
            (~G.is_point(eye), "observer has no position"), (F.size("objects") < 2, "fewer than two candidates"), (
                F.exists(ranked, lambda x: x["err"].isNotNull()), "a candidate is degenerate",
            ),
        )

    return G.let(F.array_sort(F.transform("objects", of)), answer)


def farthest(spec: Spec) -> Column:
    """The candidate farthest from the observer, the earlier of equal ones."""
    eye = F.col("observer")["position"]
    ranked = F.array_sort(
        F.transform("objects", lambda o, i: F.struct((-G.distance(o["geometry"]["centroid"], eye)).alias("d"), i.alias("pos"), o["object_id"].alias("id")))
    )

    def answer(ranked: Column) -> Column:
        first, second = F.get(ranked, F.lit(0)), F.get(ranked, F.lit(1))
        close = F.abs(first["d"] - second["d"]) < MARGIN * F.greatest(-first["d"], F.lit(1e-9))
        return _answer(
            _target(
                target_type=F.lit("object_grounding"), object_id=first["id"], distance_to_observer=F.round(-first["d"], 4), is_ambiguous=close,
            ), close, F.when(close, F.array(first["id"], second["id"])),
            (~G.is_point(eye), "observer has no position"), (F.size("objects") < 3, "fewer than three candidates"), (
                F.exists("objects", lambda o: ~G.is_point(o["geometry"]["centroid"])), "a candidate has no place",
            ),
        )

    return G.let(ranked, answer)


def direction(spec: Spec) -> Column:
    """Where the first candidate with a centroid lies from the observer."""
    o, cam = F.get(F.filter("objects", lambda x: x["geometry"]["centroid"].isNotNull()), F.lit(0)), F.col("observer")
    up = F.coalesce(cam["up"], G.vec(0, 0, 1))
    r = G.relative_direction(o["geometry"]["centroid"], cam["position"], cam["forward"], up, spec.deadzone)

    def answer(r: Column) -> Column:
        v = r["value"]
        return _answer(
            _target(
                target_type=F.lit("relative_direction"),
                object_id=o["object_id"],
                longitudinal=v["longitudinal"],
                lateral=v["lateral"],
                lateral_angle_deg=F.round(v["lateral_angle_deg"], 4),
            ), v["lateral"] == "ambiguous", F.lit(None).cast("array<string>"),
            (o.isNull(), "no candidate has a place"), (cam["forward"].isNull(), "observer has no direction"), (r["err"].isNotNull(), "direction is degenerate"),
        )

    return G.let(r, answer)


def correspondence(spec: Spec) -> Column:
    """The first resolved link between views."""
    link = F.get(F.filter("links", lambda x: x["same_entity"].isNotNull()), F.lit(0))
    return _answer(
        _target(target_type=F.lit("cross_view_correspondence"), same_entity=link["same_entity"], point_support_iou=link["point_support_iou"]),
        F.lit(False),
        F.lit(None).cast("array<string>"),
        (link.isNull(), "no link is resolved"),
    )


PROGRAMS: dict[str, Callable[[Spec], Column]] = {
    "minimum_point_to_polyline_distance": minimum_distance,
    "select_referent_by_spatial_predicate": farthest,
    "observer_relative_direction": direction,
    "link_observations_via_lifted_point_support": correspondence,
}


def facts(capabilities: StructType | None = None) -> dict[str, Column]:
    """What eligibility may ask of a package: every capability of its snapshot, and what follows from the other layers, which goes first."""
    c, o, links = F.col("caps"), F.col("objects"), F.col("links")
    own = {f.name: c[f.name] for f in capabilities.fields} if capabilities else {}
    none = lambda x: F.coalesce(x, F.lit(False))
    return own | {
        "candidate_count": F.coalesce(F.greatest(F.size(o), F.lit(0)), F.lit(0)),
        "view_baseline_meters": c["camera_baseline_m"],
        "camera_baseline_m": c["camera_baseline_m"],
        "parallax_ratio": c["parallax_ratio"],
        "association_confidence": F.coalesce(F.array_max(F.transform(links, lambda x: F.coalesce(x["probability"], F.lit(0.0)))), F.lit(0.0)),
        "all_candidates_have_valid_obb": F.coalesce(F.forall(o, lambda x: x["geometry"]["obb"].isNotNull()), F.lit(True)),
        "all_centerlines_have_at_least_two_vertices": F.coalesce(
            F.forall(o, lambda x: F.coalesce(F.size(x["geometry"]["centerline"]), F.lit(0)) != 1), F.lit(True),
        ),
        "target_visible_in_at_least_n_views": F.coalesce(
            F.array_max(F.transform(o, lambda x: F.greatest(F.coalesce(F.size(x["visibility"]["visible_frames"]), F.lit(0)), F.lit(0)))), F.lit(0),
        ),
        "both_observations_have_valid_point_support": none(F.size(links) > 0),
        "observer_forward_available": none(F.exists("cameras", lambda x: x["forward"].isNotNull())),
        "entity_centroid_available": none(F.exists(o, lambda x: x["geometry"]["centroid"].isNotNull())),
        "scale_status_is_metric": none(c["scale_status"] == "metric"),
        "domain_calibrated": F.coalesce(c["domain_calibrated"], c["metric_task_eligible"]),
    }


def eligibility(spec: Spec, capabilities: StructType | None = None) -> Column:
    """Reasons against a package, none if it is eligible. A null fact is the reason unknown:<fact>; an unknown name is an error of the specification."""
    raw, c, known = spec.raw, F.col("caps"), facts(capabilities)
    needs = raw["required_scene_capabilities"] or {}
    reasons = []
    if want := needs.get("scale_status"):
        reasons.append(F.when(~F.coalesce(c["scale_status"] == want, F.lit(False)), f"scale_status:{want}"))
    if spec.tolerance is not None:
        reasons.append(F.when(~F.coalesce(c["metric_task_eligible"], F.lit(False)), "metric_task_eligible"))
    if allowed := needs.get("depth_type_allowed"):
        reasons.append(F.when(~F.coalesce(c["depth_type"].isin(*allowed), F.lit(False)), "depth_type"))
    if (least := needs.get("minimum_candidates")) is not None:
        reasons.append(F.when(known["candidate_count"] < least, f"candidates:{least}"))
    if any(w in str(g) for g in needs.get("geometry") or () for w in ("surface", "slope", "plane")):
        reasons.append(F.when(~F.coalesce(F.array_contains(c["available_entity_types"], "surface"), F.lit(False)), "surface"))
    for item in raw["eligibility"].get("require_all") or ():
        for key, want in item.items():
            base = key.removesuffix("_at_least")
            fact = known.get(key, known.get(base))
            if fact is None:
                raise SpecError(f"{spec.qualified_id}: nothing is known of {key}")
            bad = ~F.coalesce(fact.cast("boolean"), F.lit(False)).eqNullSafe(F.lit(want)) if isinstance(want, bool) else fact.cast("double") < float(want)
            reasons.append(F.when(fact.isNull(), f"unknown:{base}").when(bad, f"{key}:{want}".lower()))
    return F.array_compact(F.array(*reasons))


def low_altitude_tags(spec: Spec) -> Column:
    """Tags for declared signals that the snapshot bears out."""
    signals, c = (spec.raw.get("low_altitude_specificity") or {}).get("signals") or (), F.col("caps")
    tags = [F.lit(None).cast("string")]
    if "uav_pose_altitude_nadir_geometry" in signals:
        tags += [F.when(c["nadir_angle_median_deg"].isNotNull(), t) for t in ("nadir_view", "uav_pose_altitude")]
    if "weak_depth_cue_from_nadir_view" in signals:
        relief = F.when(c["depth_relief_ratio"] != 0, c["depth_relief_ratio"])
        tags.append(F.when(F.coalesce(relief, F.lit(99.0)) < 2.0, "weak_depth_cue"))
    return F.array_compact(F.array(*tags))


def shuffled(items: Column, id_field: str, scene: Column, key: str) -> Column:
    """A list in an order that its scene and key decide and its answer doesn't: by a hash of each id."""
    hashed = F.transform(items, lambda x: F.struct(F.sha2(F.concat_ws("|", scene, F.lit(key), x[id_field]), 256).alias("h"), x.alias("x")))
    return F.transform(F.array_sort(hashed, lambda a, b: F.when(a["h"] < b["h"], -1).when(a["h"] > b["h"], 1).otherwise(0)), lambda s: s["x"])


def mask(packages: DataFrame, spec: Spec) -> DataFrame:
    """packages with column visible: the fields that the specification shows, candidates in shuffled order."""
    observations = F.flatten(F.transform("links", lambda x: F.array_compact(F.array(x["observation_a"], x["observation_b"]))))
    lists = {"observer": F.col("observer"), "entities": F.col("objects"), "observations": observations, "cameras": F.col("cameras")}
    lists |= {n: F.col(n) for n in ("surfaces", "regions") if n in packages.columns}
    source = packages.select(F.struct(*[c.alias(n) for n, c in lists.items()]).alias("source")).schema["source"].dataType
    ids = {"entities": "object_id", "observations": "observation_id", "surfaces": "surface_id", "regions": "region_id"}
    fields = []
    for root, below in projection.trie(spec.visible).items():
        if root not in lists:
            continue
        got = projection.project(lists[root], source[root].dataType, below)
        if got is not None:
            fields.append((shuffled(got, ids[root], F.col("scene_id"), root) if ids.get(root) in below else got).alias(root))
    return held(packages, visible=F.struct(*fields))


def held(rows: DataFrame, **columns: Column) -> DataFrame:
    """rows with more columns. What is used more than once and costs something is computed once: the optimizer keeps such projections apart."""
    return rows.withColumns(columns)


def compile_spec(packages: DataFrame, spec: Spec) -> DataFrame:
    """One row per package; see the module."""
    rows = held(packages, observer=observer_camera(), reasons=eligibility(spec, packages.schema["caps"].dataType))
    rows = mask(held(rows, derived=PROGRAMS[spec.raw["derivation_program"]](spec)), spec)
    target = F.col("derived")["value"]["target"]
    rows = held(rows, target=target, asked=F.replace(F.col("question"), F.lit("{target}"), F.coalesce(target["object_id"], F.lit("the target"))))
    kind: StructType = rows.schema["visible"].dataType
    rows = held(rows, wanted=leakage.atoms(F.col("target"), rows.schema["target"].dataType, keep_ids=not spec.shows_ids))
    found = leakage.findings(F.col("visible"), kind, F.col("wanted"))
    rows = held(rows, findings=F.when((F.size("reasons") == 0) & F.col("target").isNotNull(), found).otherwise(F.array().cast("array<string>")))
    err = F.col("derived")["err"]
    status = F.when(F.size("reasons") > 0, "skipped").when(err.isNotNull() | (F.size("findings") > 0), "failed").otherwise("record")
    code = F.when(status == "failed", F.when(err.isNotNull(), errors.CODES["TARGET_NOT_RECOMPUTABLE"]).otherwise(errors.CODES["TARGET_LEAKAGE"]))
    q = spec.raw["quality_requirements"]
    number = lambda x: F.lit(None if x is None else float(x)).cast("double")
    anchors = {
        "object_id_with_point_support": "point_indices",
        "entity_id_with_centerline_and_segment": "object_obb",
        "object_id_with_centroid_and_observer_pose": "spatial_relation",
        "entity_pair_with_point_support": "point_indices",
    }
    target_ids = F.array_compact(F.array(F.col("target")["object_id"]))
    return rows.select(
        "scene_id",
        F.lit(spec.qualified_id).alias("spec_id"),
        status.alias("status"),
        "reasons",
        code.alias("code"),
        F.coalesce(err, F.get("findings", F.lit(0))).alias("detail"),
        "findings",
        F.concat(
            F.lit("task_sample_"), F.substring(F.sha2(F.concat_ws("|", F.lit(spec.qualified_id), "scene_id", F.to_json("target")), 256), 1, 12),
        ).alias("sample_id"),
        "target", F.col("derived")["value"]["is_ambiguous"].alias("is_ambiguous"), F.col("derived")["value"]["equivalent"].alias("equivalent"),
        F.to_json("visible").alias("visible"), F.col("asked").alias("question"), "visual_inputs", "pointcloud_ref",
        F.struct(
            F.lit(spec.raw["checker"]).alias("name"),
            F.lit("0.1.0").alias("version"),
            number(q.get("numeric_tolerance_m")).alias("tolerance_m"),
            number(q.get("lateral_deadzone_deg")).alias("lateral_deadzone_deg"),
        ).alias("checker"),
        F.lit(spec.raw["derivation_program"]).alias("derivation_program"),
        F.struct(
            F.lit(anchors.get(spec.raw["target_anchor"]["kind"], "spatial_relation")).alias("anchor_kind"), target_ids.alias("entity_ids"),
        ).alias("target_geometry"),
        (
            target_ids if spec.shows_ids else F.array().cast("array<string>")
        ).alias("structural_ids"), low_altitude_tags(spec).alias("tags"), F.array(*[F.lit(a) for a in spec.raw.get("adapters") or ()]).cast("array<string>").alias("adapters"),
    )


def compile_all(packages: DataFrame, specs: list[Spec]) -> DataFrame:
    """Every package under every specification."""
    return reduce(DataFrame.unionByName, [compile_spec(packages, s) for s in specs])


def accounting(compiled: DataFrame) -> DataFrame:
    """By specification: records, skipped, failed."""
    return compiled.groupBy("spec_id").agg(
        *[F.count_if(F.col("status") == s).alias(n) for n, s in (("records", "record"), ("skipped", "skipped"), ("failed", "failed"))]
    )
