"""A scene package worked out by hand, and what breaking it in one place does."""

from __future__ import annotations

import copy
import json
import math

import pytest
import yaml
from pyspark.sql import functions as F

from scenewright.operators import grading
from scenewright.plans import compiler, leakage, projection, render, specs

VEC = "array<double>"
PACKAGE = (
    "scene_id string, caps struct<scale_status:string,depth_type:string,metric_task_eligible:boolean,available_entity_types:array<string>,camera_baseline_m:double,parallax_ratio:double,nadir_angle_median_deg:double,depth_relief_ratio:double,domain_calibrated:boolean>, "
    f"cameras array<struct<pose_id:string,position:{VEC},forward:{VEC},up:{VEC}>>, objects array<struct<object_id:string,category:string,geometry:struct<centroid:{VEC},obb:struct<center:{VEC},extent:{VEC},axes:array<{VEC}>>,centerline:array<{VEC}>>,visibility:struct<visible_frames:array<string>>>>, "
    "links array<struct<link_id:string,entity_id:string,same_entity:boolean,probability:double,point_support_iou:double,observation_a:struct<observation_id:string,frame_id:string,mask_or_box:string,category_candidates:array<string>>,observation_b:struct<observation_id:string,frame_id:string,mask_or_box:string,category_candidates:array<string>>>>, "
    "observer_pose_id string, question string, visual_inputs array<string>, pointcloud_ref string"
)


def thing(i, category, *centroid):
    obb = {"center": [float(c) for c in centroid], "extent": [2.0 + i, 5.0, 1.5 * i], "axes": [[0.0, 1.0, 0.0], [-1.0, 0.0, 0.0], [0.0, 0.0, 1.0]]}
    return {
        "object_id": f"<obj_{i:03d}>",
        "category": category,
        "geometry": {"centroid": [float(c) for c in centroid], "obb": obb, "centerline": None},
        "visibility": {"visible_frames": [f"k{4 * i:04d}", "k0031"]},
    }


def package():
    seen = lambda k: {"observation_id": f"o{k}", "frame_id": f"k{k}", "mask_or_box": "box", "category_candidates": ["car"]}
    return {
        "scene_id": "s1", "caps": {
            "scale_status": "metric",
            "depth_type": "externally_anchored",
            "metric_task_eligible": True,
            "available_entity_types": ["object"],
            "camera_baseline_m": 17.5,
            "parallax_ratio": 0.21,
            "nadir_angle_median_deg": 81.4,
            "depth_relief_ratio": 1.4,
            "domain_calibrated": None,
        },
        "cameras": [
            {"pose_id": "<pose_012>", "position": [3.0, -2.0, 41.0], "forward": [1.0, 0.0, 0.0], "up": [0.0, 0.0, 1.0]}
        ], "objects": [thing(1, "crane", 17, 8, 4), thing(2, "shed", -21, 31, 2), thing(3, "mast", 44, -39, 9)],
        "links": [
            {
                "link_id": "l",
                "entity_id": "<obj_001>",
                "same_entity": True,
                "probability": 0.9,
                "point_support_iou": 0.4,
                "observation_a": seen(1),
                "observation_b": seen(2),
            }
        ],
        "observer_pose_id": "<pose_012>", "question": "Which one, and how far off?", "visual_inputs": ["a.jpg"], "pointcloud_ref": "c.ply",
    }


SPECS = {s.raw["task_id"]: s for s in specs.load_all(set(compiler.PROGRAMS), compiler.CHECKERS)}
GROUNDING, DISTANCE, DIRECTION, CROSS = SPECS["3d_grounding.object"], SPECS["3d_vqa.metric.minimum_distance"], SPECS[
    "3d_vqa.situated.observer_relative_direction"
], SPECS["cross_view_correspondence.object"]


def compiled(spark, spec, *packages):
    return compiler.compile_spec(spark.createDataFrame(list(packages), PACKAGE), spec)


def test_answers(spark):
    r = compiled(spark, DISTANCE, package()).first()
    assert r["status"] == "record" and r["target"]["object_id"] == "<obj_001>" and r["target"]["minimum_distance"] == pytest.approx(
        math.sqrt(14**2 + 10**2 + 37**2), abs=1e-3,
    )
    assert r["tags"] == ["nadir_view", "uav_pose_altitude", "weak_depth_cue"] and r["checker"]["tolerance_m"] == 0.1 and r["structural_ids"] == ["<obj_001>"]
    assert compiled(spark, GROUNDING, package()).first()["target"]["object_id"] == "<obj_003>"
    assert compiled(spark, DIRECTION, package()).first()["target"]["longitudinal"] == "front"
    assert compiled(spark, CROSS, package()).first()["target"]["same_entity"] is True


def test_ambiguity_and_equivalents(spark):
    p = package()
    p["objects"][1]["geometry"]["centroid"] = [17.02, 8.0, 4.0]
    r = compiled(spark, DISTANCE, p).first()
    assert r["is_ambiguous"] and r["equivalent"] == ["<obj_001>", "<obj_002>"]


def test_only_masked_fields_are_visible_and_absent_ones_are_not_null(spark):
    visible = json.loads(compiled(spark, DIRECTION, package()).first()["visible"])
    assert set(visible["entities"][0]) == {"object_id", "category", "geometry"} and set(visible["entities"][0]["geometry"]) == {"centroid"}
    assert len(visible["entities"]) == 3 and set(visible) == {"observer", "entities"}


def test_channels_stay_apart(spark):
    few, leaking, blind, unknown = (copy.deepcopy(package()) for _ in range(4))
    for i, p in enumerate((few, leaking, blind, unknown)):
        p["scene_id"] = f"s{i + 2}"
    few["objects"] = few["objects"][:1]
    leaking["objects"][1]["category"] = "shed at 40.8044 meters"
    blind["observer_pose_id"] = "<pose_999>"
    unknown["caps"]["camera_baseline_m"] = None
    got = {r["scene_id"]: r for r in compiled(spark, DISTANCE, package(), few, leaking, blind, unknown).collect()}
    assert [got[f"s{i}"]["status"] for i in range(1, 6)] == ["record", "skipped", "failed", "failed", "skipped"]
    assert got["s3"]["code"] == "G3-E03" and "40.8044" in got["s3"]["findings"][0]
    assert got["s4"]["code"] == "G3-E07" and got["s4"]["detail"] == "observer has no position"
    assert got["s5"]["reasons"] == ["unknown:camera_baseline_m"]


def test_nulls_and_empty_lists(spark):
    bare = {**package(), "objects": None, "links": None, "cameras": None, "question": None}
    none = {**package(), "scene_id": "s2", "objects": [], "links": [], "cameras": []}
    for spec in SPECS.values():
        assert {r["status"] for r in compiled(spark, spec, bare, none).collect()} <= {"skipped", "failed"}
    assert compiled(spark, DISTANCE).count() == 0


def test_unknown_facts_are_errors_of_the_specification(spark):
    raw = copy.deepcopy(GROUNDING.raw)
    raw["eligibility"]["require_all"].append({"phase_of_the_moon_at_least": 1})
    with pytest.raises(specs.SpecError):
        compiled(spark, specs.Spec(raw), package())


def test_sample_ids_are_stable_and_order_is_independent_of_input_order(spark):
    p = package()
    q = {**package(), "objects": package()["objects"][::-1]}
    a, b = compiled(spark, GROUNDING, p).first(), compiled(spark, GROUNDING, q).first()
    assert a["sample_id"] == b["sample_id"] and a["visible"] == b["visible"]


def test_rendering(spark):
    records = compiled(spark, DISTANCE, package())
    for adapter in render.ADAPTERS:
        r = render.render(records, adapter).first()
        assert r["status"] == "rendered" and (
            "40.8044" not in r["payload"] or adapter == "pointcloud_native"
        ) and r["verification"]["target"]["object_id"] == "<obj_001>"
    assert "point_cloud" not in json.loads(render.render(records, "qwen_2d_metadata").first()["payload"])
    turns = json.loads(render.render(records, "pointcloud_native").first()["payload"])["conversations"]
    assert turns[0]["value"].startswith("<point_cloud>") and "40.8044" in turns[1]["value"]
    assert render.render(compiled(spark, CROSS, package()), "pointcloud_native").first()["status"] == "unsupported"
    assert render.render(compiled(spark, DISTANCE, {**package(), "pointcloud_ref": None}), "pointcloud_native").first()["detail"] == "no point cloud"
    with pytest.raises(KeyError):
        render.render(records, "other")


def test_rendering_of_choices(spark):
    records = compiled(spark, GROUNDING, package())
    choice = lambda k, t: F.struct(F.lit(k).alias("key"), F.lit(t).alias("text"))
    good = records.withColumn("choices", F.array(choice("A", "<obj_001>"), choice("B", "<OBJ_003>")))
    turns = json.loads(render.render(good, "pointcloud_native").first()["payload"])["conversations"]
    assert turns[1]["value"] == "B" and "A. <obj_001>\nB. <OBJ_003>" in turns[0]["value"]
    assert render.render(records.withColumn("choices", F.array(choice("A", "x"))), "pointcloud_native").first()["detail"] == "no choice is the answer"


def test_leak_in_a_question_is_found_by_every_adapter(spark):
    records = compiled(spark, DISTANCE, package()).withColumn("question", F.lit("Is it 40.8044 away?"))
    assert {render.render(records, a).first()["status"] for a in render.ADAPTERS} == {"failed"}


def test_leakage_rules(spark):
    def found(payload, target, **more):
        df = spark.range(1).select(payload.alias("p"), target.alias("t"))
        k = {c: df.schema[c].dataType for c in "pt"}
        return df.select(leakage.findings(F.col("p"), k["p"], leakage.atoms(F.col("t"), k["t"], **more)).alias("f")).first()["f"]

    s = lambda **kv: F.struct(*[F.lit(x).alias(n) for n, x in kv.items()])
    assert found(s(a="at 18.37 m"), s(minimum_distance=18.37)) == ["a|18.37"]
    assert found(s(a=18.37), s(minimum_distance=18.370001)) == ["a|18.37"]
    assert found(s(a="left of it"), s(lateral="left")) == []
    assert found(s(a=0.0, b="12"), s(segment_index=0, k=12)) == []
    assert found(s(task_spec_id="the southern rooftop"), s(a="the southern rooftop")) == []
    assert found(s(choices="the southern rooftop"), s(a="the southern rooftop")) == []
    assert found(s(a="see <obj_042>"), s(object_id="<obj_042>")) == ["a|<obj_042>"]
    assert found(s(a="see <obj_042>"), s(object_id="<obj_042>"), keep_ids=False) == []
    assert found(s(evidence="x"), s(a="y")) == ["key|evidence"]
    assert found(s(a="by minimum_distance_program"), s(b=1), program="minimum_distance_program") == ["a|minimum_distance_program"]


def test_mask_prunes_nested_columns(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.createDataFrame([package()], PACKAGE).write.parquet(path)
    df = spark.read.parquet(path)
    kind = df.schema["objects"].dataType
    got = df.select(projection.project(F.col("objects"), kind, projection.trie(["object_id", "geometry.centroid", "nothing"])).alias("x"))
    schema = got._jdf.queryExecution().executedPlan().toString().split("ReadSchema: ")[1].split("\n")[0]
    assert "centroid" in schema and "obb" not in schema and "visible_frames" not in schema
    assert got.first()["x"][0].asDict(True) == {"object_id": "<obj_001>", "geometry": {"centroid": [17.0, 8.0, 4.0]}}


MUTATIONS = {
    "checker is not registered": lambda r: r.update(checker="none"),
    "program is not registered": lambda r: r.update(derivation_program="none"),
    "nothing is hidden": lambda r: r.update(hidden_target_fields=[]),
    "a hidden field is visible": lambda r: r["metadata_input_fields"].append("target.object_id"),
    "a forbidden field is visible": lambda r: r["metadata_input_fields"].append("entities.rank"),
    "a visible field holds a hidden one": lambda r: r["metadata_input_fields"].append("target"),
    "a tolerance in metres needs a metric scene": lambda r: r["quality_requirements"].update(numeric_tolerance_m=0.1),
    "no reason for three dimensions": lambda r: r["three_d_necessity"].update(rationale=" "),
    "no conditions for three dimensions": lambda r: r["three_d_necessity"].update(conditions=[]),
    "no reason for low altitude": lambda r: r["low_altitude_specificity"].update(rationale=""),
    "no signals of low altitude": lambda r: r["low_altitude_specificity"].update(signals=[]),
    "target has no anchor": lambda r: r.update(target_anchor={}),
    "unknown generation mode": lambda r: r.update(generation_mode="x"),
    "unknown supervision level": lambda r: r.update(supervision_level="x"),
    "unknown answer schema": lambda r: r.update(output_schema="x"),
    "missing keys: leakage_rules": lambda r: r.pop("leakage_rules"),
}


@pytest.mark.parametrize("what", sorted(MUTATIONS))
def test_each_rule_of_a_specification_bites(what, tmp_path):
    raw = copy.deepcopy(GROUNDING.raw)
    MUTATIONS[what](raw)
    (tmp_path / "a.yaml").write_text(yaml.safe_dump(raw))
    with pytest.raises(specs.SpecError, match=what):
        specs.load(tmp_path / "a.yaml", set(compiler.PROGRAMS), compiler.CHECKERS)


def test_specifications_as_rows_are_judged_alike(spark):
    """Every mutation as a JSON row, and what is none of a specification."""
    raws = {"good": GROUNDING.raw}
    for what, change in MUTATIONS.items():
        raws[what] = copy.deepcopy(GROUNDING.raw)
        change(raws[what])
    raws |= {"list": [1], "empty": {}, "null lists": raws["good"] | {"hidden_target_fields": None, "leakage_rules": None, "three_d_necessity": None}}
    texts = [(k, json.dumps(r)) for k, r in raws.items()] + [("broken", "{"), ("none", None)]
    programs, checkers = set(compiler.PROGRAMS), compiler.CHECKERS
    got = {}
    for r in specs.judged(spark.createDataFrame(texts, "k string, t string"), "k", "t", programs, checkers).collect():
        got.setdefault(r["k"], []).append(r["problem"])
    assert got == {k: p for k, r in raws.items() if (p := specs.problems(r, programs, checkers))} | {"broken": ["not a mapping"], "none": ["not a mapping"]}


def test_fixed_values_of_specifications(tmp_path):
    """The allowed words and required keys of the format, and what is optional."""
    assert set(specs.MODES) == {"program_first", "hybrid", "model_first_constrained"}
    assert len(specs.REQUIRED) == 17 and "adapters" not in specs.REQUIRED
    for change in ({"generation_mode": "model_first_constrained"}, {"generation_mode": "hybrid"}):
        raw = {k: v for k, v in GROUNDING.raw.items() if k not in ("adapters", "low_altitude_specificity", "description")} | change
        assert specs.problems(raw, set(compiler.PROGRAMS), compiler.CHECKERS) == []
    raw = GROUNDING.raw | {"output_schema": "own_answer"}
    assert specs.problems(raw, set(compiler.PROGRAMS), compiler.CHECKERS, (*specs.ANSWER_SCHEMAS, "own_answer")) == []


def test_repeated_specifications(tmp_path):
    for n in "ab":
        (tmp_path / f"{n}.yaml").write_text(yaml.safe_dump(GROUNDING.raw))
    with pytest.raises(specs.SpecError, match="repeated"):
        specs.load_all(set(compiler.PROGRAMS), compiler.CHECKERS, tmp_path)


def test_distance_grades(spark):
    def grade(object_id, distance, second=9.0, lines=True):
        entry = lambda i, y: F.struct(F.lit(i).alias("id"), F.array(F.array(F.lit(0.0), F.lit(y), F.lit(0.0)), F.array(F.lit(10.0), F.lit(y), F.lit(0.0))).alias("line"))
        wires = F.array(entry("<wire_004>", 3.0), entry("<wire_007>", second))
        answer = F.struct(F.lit(object_id).alias("object_id"), F.lit(distance).cast("string").alias("distance_m"))
        r = spark.range(1).select(
            grading.check_distance(answer, F.array(F.lit(5.0), F.lit(0.0), F.lit(0.0)), wires if lines else F.slice(wires, 1, 0)).alias("r")
        ).first()["r"]
        return r["passed"], r["code"], r["error"]

    assert grade("<wire_004>", "3.02") == (True, None, None)
    assert grade("<wire_004>", "3.5") == (False, "G5-E01", None) and grade("<wire_007>", "3.0") == (False, "G5-E01", None)
    assert grade("<wire_004>", "3.0", second=3.05) == (False, "G3-E04", None)
    assert grade("<wire_004>", "three") == (False, "G4-E03", None) and grade("<wire_004>", None) == (False, "G4-E03", None)
    assert grade("<wire_004>", "3.0", lines=False) == (None, None, "no evidence")


def test_best_view(spark):
    pose = lambda x: [[1.0, 0.0, 0.0, x], [0.0, 1.0, 0.0, 0.0], [0.0, 0.0, 1.0, 0.0], [0.0, 0.0, 0.0, 1.0]]
    cams = [("<pose_001>", "k0031", pose(9.0)), ("<pose_002>", "k0004", pose(1.0)), ("<pose_003>", "k0004", pose(2.0))]
    df = spark.createDataFrame([package()], PACKAGE).withColumn("c", F.lit(None).cast("int"))
    views = spark.createDataFrame([("s1", cams)], "scene_id string, views array<struct<pose_id:string,frame_id:string,pose:array<array<double>>>>")
    r = df.join(views, "scene_id").select(compiler.best_view_observer(F.col("objects"), F.col("views")).alias("o")).first()["o"]
    assert (r["pose_id"], r["position"], r["forward"]) == ("<pose_002>", [1.0, 0.0, 0.0], [0.0, 0.0, 1.0])


def test_scene_rules(spark):
    from scenewright.operators import validate

    k, pose = [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]], [[1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0], [0.0, 0.0, 1.0, 0.0], [0.0, 0.0, 0.0, 1.0]]
    kind = "schema_version string, scene_id string, split_group_id string, frames array<struct<frame_id:string,timestamp_ns:bigint,K:array<array<double>>,pose:array<array<double>>,image_sha256:string>>"
    good = ("0.1.0", "a", "g", [("f", 1, k, pose, None)])
    bad = ("one", "b", "", [("f", -1, k[:2], pose[:3], "xyz")])
    got = {
        (r["scene_id"], r["constraint"]) for r in validate.constraint_issues(
            spark.createDataFrame([good, bad], kind), validate.scene_rules(), "scene_id",
        ).collect()
    }
    assert got == {("b", c) for c in ("schema_version", "split_group_id", "timestamp_ns", "K", "pose", "image_sha256")}


def test_cameras_of_both_layers_surfaces_and_every_capability(spark):
    """An observer that only the relation layer has, shuffled surfaces, and a capability that no rule derives."""
    from scenewright.sources import readers

    p = package()
    cam = {"pose_id": "<pose_099>", "position": [0.0, 0.0, 5.0], "forward": [1.0, 0.0, 0.0], "up": [0.0, 0.0, 1.0]}
    kind = dict(f.split(" ", 1) for f in PACKAGE.replace(", ", "\n").split("\n"))
    l1 = spark.createDataFrame(
        [("s1", p["cameras"], p["objects"], [(f"<surf_{i:03d}>",) for i in range(9)], [])],
        f"scene_id string, cameras {kind['cameras']}, objects {kind['objects']}, surfaces array<struct<surface_id:string>>, regions array<struct<region_id:string>>",
    )
    l2 = spark.createDataFrame(
        [("s1", [cam, {**p["cameras"][0], "position": [7.0, 7.0, 7.0]}], p["links"])],
        f"scene_id string, cameras {kind['cameras']}, cross_view_links {kind['links']}",
    )
    snap = spark.createDataFrame([("s1", p["caps"])], f"scene_id string, capabilities {kind['caps']}")
    asked = spark.createDataFrame(
        [("s1", "<pose_099>", "q", ["a"], "c")], "scene_id string, observer_pose_id string, question string, visual_inputs array<string>, pointcloud_ref string",
    )
    made = readers.packages(l1, l2, snap, asked)
    assert [c["pose_id"] for c in made.first()["cameras"]] == ["<pose_012>", "<pose_099>", "<pose_012>"]
    assert made.select(compiler.observer_camera().alias("c")).first()["c"]["position"] == [0.0, 0.0, 5.0]
    first = made.withColumn("observer_pose_id", F.lit("<pose_012>")).select(compiler.observer_camera().alias("c")).first()["c"]
    assert first["position"] == [3.0, -2.0, 41.0]
    raw = copy.deepcopy(DIRECTION.raw)
    raw["metadata_input_fields"] += ["surfaces.surface_id", "cameras.pose_id"]
    raw["eligibility"]["require_all"].append({"nadir_angle_median_deg_at_least": 80})
    got = compiler.compile_spec(made, specs.Spec(raw)).first()
    assert got["status"] == "record"
    seen = json.loads(got["visible"])
    ids = [x["surface_id"] for x in seen["surfaces"]]
    assert sorted(ids) == [f"<surf_{i:03d}>" for i in range(9)] != ids and len(seen["cameras"]) == 3
    raw["eligibility"]["require_all"][-1] = {"nadir_angle_median_deg_at_least": 85}
    assert compiler.compile_spec(made, specs.Spec(raw)).first()["status"] == "skipped"
