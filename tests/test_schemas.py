"""Documents against schemas: whole documents of every layer, each rule as a mutation, and walks of open documents against a recursive one."""

from __future__ import annotations

import json

import pytest

from scenewright.plans import answers, schemas, shapes
from scenewright.sources import readers

SHA = "0" * 64
PLACE = {"source_frames": ["f1"], "producers": ["p"]}
MODEL = {"name": "m", "version": "1"}
EYE3, EYE4 = [[1, 0, 0], [0, 1, 0], [0, 0, 1]], [[1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1]]
HEAD = {"schema_version": "0.1.0", "scene_id": "scene_a"}
REF = {"uri": "x.json", "schema_version": "0.1.0", "content_sha256": SHA}
GOOD = {
    "l0_geometry": HEAD
    | {
        "coordinate_frame": "local",
        "unit": "meter",
        "scale": {"status": "metric", "source": "lidar", "depth_type": "metric", "domain_calibrated": True, "anchor_provenance_verified": False, "scale_factor": None},
        "cameras": [{"frame_id": "f1", "K": EYE3, "T_world_from_camera": EYE4, "coordinate_convention": "opencv", "pose_source": "native", "image_size_hw": [480, 640]}],
        "depth": [{"artifact_id": "d1", "producer": MODEL, "depth_uri": "d.npy", "depth_type": "relative", "frame_ids": ["f1"], "alignment_to_primary": {"any": [1]}}],
        "point_cloud": None,
        "invalid_geometry": {"reason_masks": {"sky": {"uri": "s.png", "producer": MODEL}}, "combined_uri": None},
        "diagnostics": {"coverage_ratio": 0.5, "failure_signatures": ["sky_depth"], "own": {"x": 1}},
        "provenance": {"created_at": "t", "code_version": "1", "source_scene_manifest": "m", "more": 1},
    },
    "l1_entities": HEAD
    | {
        "id_minter_state": {"obj": 3, "wire": 0},
        "objects": [
            {
                "object_id": "<obj_001>", "category": "tower", "geometry": {"centroid": [0, 1.5, 2], "obb": None}, "visibility": {"visible_frames": []},
                "confidence": {"semantic": 0.5, "cross_view_support": 2.0}, "provenance": PLACE,
            }
        ],
        "surfaces": [
            {
                "surface_id": "<region_001>", "plane": {"normal": [0, 0, 1], "offset_m": -1, "fit_method": "pca"}, "slope_deg": 12, "extent": {"area_m2": 3.5},
                "quality": {}, "provenance": PLACE,
            }
        ],
        "regions": [{"region_id": "<region_002>", "purpose": "generic", "point_support": {"point_count": 0}, "provenance": PLACE}],
        "provenance": {"created_at": "t", "code_version": "1", "l0_geometry_ref": "g"},
    },
    "l2_relations": HEAD
    | {
        "relations": [
            {"relation_id": "r1", "relation_type": "near", "subject_id": "<obj_001>", "object_id": None, "value": True, "derivation": {"program": "p", "inputs": ["a"]}},
            {"relation_id": "r2", "relation_type": "azimuth_deg", "subject_id": "<obj_001>", "object_id": "<wire_0001>", "value": {"lateral": "left"}, "derivation": {"program": "p", "inputs": ["a"]}},
        ],
        "cross_view_links": [
            {
                "link_id": "l", "observation_a": {"observation_id": "a", "frame_id": "f"}, "observation_b": {"observation_id": "b", "frame_id": "g", "box_xyxy": [0, 0, 1, 1]},
                "same_entity": None, "probability": 1, "evidence": {"size_ratio": 0.2}, "derivation": {"program": "p", "inputs": ["a"]},
            }
        ],
        "provenance": {"created_at": "t", "code_version": "1", "l1_entities_ref": "e"},
    },
    "metadata_snapshot": HEAD
    | {
        "snapshot_id": "meta_1", "dataset_id": "d", "split_group_id": "g",
        "layers": {"l0_geometry": REF, "l1_entities": REF, "l2_relations": REF, "l3_capability": None},
        "capabilities": {"scale_status": "metric", "depth_type": "metric", "metric_task_eligible": True, "reasons": [], "parallax_ratio": 0.3},
        "gate": {"gate_id": "G2", "status": "pass"},
        "provenance": {"created_at": "t", "code_version": "1", "schema_versions": {"l0_geometry": "0.1.0"}},
    },
    "canonical_task_record": HEAD
    | {
        "sample_id": "s", "task_spec_id": "a.b@0.1.0", "metadata_snapshot_id": "m", "capability_tags": ["perception"], "supervision_level": "weak",
        "inputs": {"visible_metadata_fields": [], "choices": [{"key": "A", "text": "x"}], "visible_metadata": {"open": [{}]}},
        "hidden_target": {"whatever": 1}, "target_geometry": {"anchor_kind": "region"},
        "evidence": {"used_entities": [], "used_fields": ["f"], "derivation_program": "p"}, "checker": {"name": "c", "version": "1", "own": True},
        "adapters": ["multimodal_3d"], "provenance": {"created_at": "t", "code_version": "1", "task_spec_version": "0.1.0"},
    },
}

#: layer, steps to a place, its new value (or None to take it away: GONE), and the issue that must come of it
GONE = object()
BROKEN = [
    ("l0_geometry", ("typoed_field",), 1, ("typoed_field", "additionalProperties")),
    ("l0_geometry", ("unit",), "feet", ("unit", "enum")),
    ("l0_geometry", ("scale", "depth_type"), "sort_of_metric", ("scale.depth_type", "enum")),
    ("l0_geometry", ("scale", "scale_factor"), 0, ("scale.scale_factor", "exclusiveMinimum")),
    ("l0_geometry", ("cameras",), [], ("cameras", "minItems")),
    ("l0_geometry", ("cameras", 0, "K", 1), [0, 1], ("cameras[0].K[1]", "minItems")),
    ("l0_geometry", ("cameras", 0, "K", 1, 2), "0", ("cameras[0].K[1][2]", "type")),
    ("l0_geometry", ("cameras", 0, "image_size_hw", 0), 480.5, ("cameras[0].image_size_hw[0]", "type")),
    ("l0_geometry", ("cameras", 0, "T_world_from_camera"), GONE, ("cameras[0].T_world_from_camera", "required")),
    ("l0_geometry", ("invalid_geometry", "reason_masks", "fog"), {}, ("invalid_geometry.reason_masks.fog", "additionalProperties")),
    ("l0_geometry", ("invalid_geometry", "reason_masks", "sky", "producer", "version"), "", ("invalid_geometry.reason_masks.sky.producer.version", "minLength")),
    ("l0_geometry", ("diagnostics", "failure_signatures", 0), "ghost", ("diagnostics.failure_signatures[0]", "enum")),
    ("l1_entities", ("objects", 0, "object_id"), "obj_1", ("objects[0].object_id", "pattern")),
    ("l1_entities", ("objects", 0, "confidence", "cross_view_support"), 2.5, ("objects[0].confidence.cross_view_support", "type")),
    ("l1_entities", ("objects", 0, "confidence", "semantic"), 1.5, ("objects[0].confidence.semantic", "maximum")),
    ("l1_entities", ("objects", 0, "geometry", "obb"), {"center": [0, 0, 0], "extent": [1, -1, 1], "axes": EYE3}, ("objects[0].geometry.obb.extent[1]", "minimum")),
    ("l1_entities", ("surfaces", 0, "plane"), GONE, ("surfaces[0].plane", "required")),
    ("l1_entities", ("surfaces", 0, "extent"), GONE, ("surfaces[0].extent", "required")),
    ("l1_entities", ("surfaces", 0, "slope_deg"), 120.0, ("surfaces[0].slope_deg", "maximum")),
    ("l1_entities", ("id_minter_state", "a/b~c.d"), -1, ("id_minter_state.a/b~c.d", "minimum")),
    ("l1_entities", ("regions", 0, "provenance", "producers"), [], ("regions[0].provenance.producers", "minItems")),
    ("l2_relations", ("relations", 0, "derivation"), GONE, ("relations[0].derivation", "required")),
    ("l2_relations", ("relations", 1, "derivation", "inputs"), [], ("relations[1].derivation.inputs", "minItems")),
    ("l2_relations", ("relations", 1, "object_id"), "tower", ("relations[1].object_id", "pattern")),
    ("l2_relations", ("relations", 0, "value"), None, ("relations[0].value", "type")),
    ("l2_relations", ("relations", 1, "value", "up"), 1, ("relations[1].value.up", "additionalProperties")),
    ("l2_relations", ("cross_view_links", 0, "same_entity"), GONE, ("cross_view_links[0].same_entity", "required")),
    ("l2_relations", ("cross_view_links", 0, "probability"), True, ("cross_view_links[0].probability", "type")),
    ("metadata_snapshot", ("layers", "l0_geometry", "content_sha256"), GONE, ("layers.l0_geometry.content_sha256", "required")),
    ("metadata_snapshot", ("layers", "l1_entities", "content_sha256"), "A" * 64, ("layers.l1_entities.content_sha256", "pattern")),
    ("metadata_snapshot", ("provenance", "schema_versions", "l1"), 1, ("provenance.schema_versions.l1", "type")),
    ("metadata_snapshot", ("gate", "gate_id"), 2, ("gate.gate_id", "enum")),
    ("canonical_task_record", ("inputs", "choices", 0, "key"), "AA", ("inputs.choices[0].key", "pattern")),
    ("canonical_task_record", ("hidden_target",), [], ("hidden_target", "type")),
    ("canonical_task_record", ("adapters", 0), "other", ("adapters[0]", "enum")),
    ("canonical_task_record", ("ambiguity",), {"is_ambiguous": "no"}, ("ambiguity.is_ambiguous", "type")),
]


def changed(doc: dict, steps: tuple, value: object) -> dict:
    doc = json.loads(json.dumps(doc))  # nothing is shared within it
    at = doc
    for s in steps[:-1]:
        at = at[s]
    if value is GONE:
        del at[steps[-1]]
    else:
        at[steps[-1]] = value
    return doc


@pytest.mark.parametrize("layer", sorted(GOOD))
def test_each_broken_place_is_the_one_issue(spark, layer):
    cases = [(k, json.dumps(changed(GOOD[layer], steps, value)), issue) for k, (at, steps, value, issue) in enumerate(BROKEN) if at == layer]
    without = json.dumps(changed(GOOD[layer], ("layers", "l3_capability"), GONE) if layer == "metadata_snapshot" else GOOD[layer])
    rows = [(k, text) for k, text, _ in cases] + [(-1, json.dumps(GOOD[layer])), (-2, without), (-3, None), (-4, "{"), (-5, "[]"), (-6, '{"scene_id": 1, "scene_id": 2}')]
    got = schemas.issues(spark.createDataFrame(rows, "k int, content string"), shapes.SCHEMAS[layer], "k").collect()
    want = [(k, *issue) for k, _, issue in cases] + [(-3, "", "readable"), (-4, "", "readable"), (-5, "", "type"), (-6, "", "readable")]
    assert sorted(map(tuple, got)) == sorted(want)


def test_clashing_columns_empty_tables_and_repeated_rows(spark):
    docs = spark.createDataFrame([("a", "[1]", 0), ("a", "[1]", 0)], "`_v` string, content string, `key` int")
    assert schemas.issues(docs, {"type": "object"}, "key").count() == 2
    assert schemas.issues(docs.limit(0), shapes.GEOMETRY, "key").count() == 0
    assert schemas.walk(docs.limit(0), "key").count() == 0


def test_schema_files_and_what_cannot_be_judged(spark, tmp_path):
    own = {
        "$defs": {"id": {"type": "string", "pattern": "^x"}},
        "type": "object",
        "required": ["id"],
        "properties": {"id": {"$ref": "#/$defs/id"}, "n": {"oneOf": [{"type": "integer", "minimum": 3}, {"type": "null"}]}, "c": {"const": True}},
        "additionalProperties": False,
    }
    (tmp_path / "own.json").write_text(json.dumps(own))
    rows = [(0, '{"id": "x1", "n": null, "c": true}'), (1, '{"id": "y", "n": 2, "c": "true"}'), (2, '{"n": 3.0, "d": 1, "c": 1}')]
    got = schemas.issues(spark.createDataFrame(rows, "k int, content string"), schemas.load(spark, str(tmp_path / "own.json")), "k").collect()
    want = [(1, "id", "pattern"), (1, "n", "minimum"), (1, "c", "const"), (2, "id", "required"), (2, "d", "additionalProperties"), (2, "c", "const")]
    assert sorted(map(tuple, got)) == sorted(want)
    for bad, said in (
        ({"uniqueItems": True}, "not judged"),
        ({"oneOf": [{"type": "string"}, {"type": ["string", "null"]}]}, "different kinds"),
        ({"oneOf": [{"type": "number"}, {"enum": ["x"]}]}, "enum or const"),
        ({"$defs": {"n": {"items": {"$ref": "#/$defs/n"}}}, "$ref": "#/$defs/n"}, "refers to itself"),
        ({"additionalProperties": {"type": "array", "items": {}}}, "plain values"),
    ):
        with pytest.raises(ValueError, match=said):
            schemas.rules(bad)


def test_answers_are_judged_as_by_their_rules(spark):
    answer = shapes.ANSWERS["vqa_metric_distance_answer"]
    texts = [
        '{"object_id": "<obj_001>", "distance_m": 1.5, "unit": "meter"}', '{"object_id": "obj", "distance_m": 1.5, "unit": "meter"}', '{"distance_m": 1}',
        '{"object_id": "<obj_001>", "distance_m": -1, "unit": "meter"}', '{"object_id": "<obj_001>", "distance_m": "1", "unit": "meter"}', "no", "[]",
        '{"object_id": "<obj_001>", "distance_m": 1, "unit": "feet", "confidence": 2}', '{"object_id": "<obj_001>", "distance_m": 1, "unit": "meter", "x": 1}',
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "k int, content string")
    bad = {r.k for r in schemas.issues(docs, answer, "k").collect()}
    rules = answers.answer_rules("vqa_metric_distance_answer", docs["content"])
    held = docs.select("k", *[c.alias(f"r{i}") for i, c in enumerate(rules.values())]).collect()
    assert bad == {r[0] for r in held if not all(x is True for x in r[1:])} == {1, 2, 3, 4, 5, 6, 7, 8}


def places(node, path=""):
    items = [(f"{path}.{k}" if path else k, v) for k, v in node.items()] if isinstance(node, dict) else [(f"{path}[{i}]", v) for i, v in enumerate(node)] if isinstance(node, list) else []
    for p, v in items:
        yield p, v
        yield from places(v, p)


def test_walk_equals_a_recursive_walk(spark):
    docs = [{"a": [1, {"b": None, "c.d": "x"}], "e": 1.5, "f": {}, "g": [], "h": True}, [[], [[2]], "t"], {}, "text", {"k": {"k": {"k": ["é"]}}}]
    got = schemas.walk(spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "k int, content string"), "k").collect()
    want = []
    for i, d in enumerate(docs):
        for p, v in places(d):
            number = isinstance(v, int | float) and not isinstance(v, bool)
            want.append((i, p, v if isinstance(v, str) else None, float(v) if number else None, False))
    assert sorted(map(str, want)) == sorted(str((r.k, r.path, r.text, r.num, r.deeper)) for r in got)
    deep = schemas.walk(spark.createDataFrame([(0, "[[[1]]]")], "k int, content string"), "k", depth=2).collect()
    assert [(r.path, r.deeper) for r in sorted(deep, key=lambda r: r.path)] == [("[0]", False), ("[0][0]", True)]


def test_whole_documents_are_read(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(GOOD["l0_geometry"], indent=2))
    (tmp_path / "b.json").write_text(json.dumps(GOOD["l0_geometry"] | {"unit": "feet"}, indent=2))
    got = schemas.issues(readers.read_documents(spark, str(tmp_path)), shapes.GEOMETRY, "uri").collect()
    assert [(r.uri.rpartition("/")[2], r.path, r.rule) for r in got] == [("b.json", "unit", "enum")]
