from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scenewright.operators import entities, grading, scenes, state
from scenewright.sources import readers


def test_components_equal_a_flood_fill():
    rng = random.Random(5)
    for share in (0.2, 0.6, 0.9):
        cells = {(y, x) for y in range(25) for x in range(25) if rng.random() < share}
        left, want = set(cells), {}
        for n, start in enumerate(sorted(cells)):
            if start not in left:
                continue
            stack, k = [start], len(set(want.values()))
            left.discard(start)
            while stack:
                y, x = stack.pop()
                want[y, x] = k
                for near in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                    if near in left:
                        left.discard(near)
                        stack.append(near)
        mixed = rng.sample(sorted(cells), len(cells))
        got = entities.label_components(np.array([y for y, _ in mixed]), np.array([x for _, x in mixed]))
        assert {c: int(k) for c, k in zip(mixed, got, strict=True)} == want


def test_merge_is_greedy_and_in_order(spark):
    # a takes b; c lies near b but not near a, so it stays alone: no transitive closure
    rows = [
        ("s", "car", 1, 0, 0.0, 0.0, 0.0, 10),
        ("s", "car", 2, 1, 2.0, 0.0, 0.0, 30),
        ("s", "car", 3, 2, 4.0, 0.0, 0.0, 10),
        ("s", "bus", 4, 0, 10.0, 0.0, 0.0, 5),
    ]
    df = spark.createDataFrame(rows, "scene_id string, category string, pos long, frame long, x double, y double, z double, point_count long")
    df = df.withColumns({"lo": F.array("x", "y", "z"), "hi": F.array(F.col("x") + 1, "y", "z")})
    got = {r["seed"]: r for r in entities.merge_objects(df).collect()}
    assert sorted(got) == [1, 3, 4]
    assert got[1]["merged_from"] == [1, 2] and got[1]["cx"] == pytest.approx(1.5) and got[1]["hi"][0] == 3.0 and got[1]["frames"] == [0, 1]
    assert [got[k]["object_id"] for k in (1, 3, 4)] == ["<obj_001>", "<obj_002>", "<obj_003>"]


def test_fusion_votes(spark):
    pixels = spark.createDataFrame(
        [(1, y, x, 1 if x < 4 else 2) for y in range(8) for x in range(8)] + [(2, y, x, 0) for y in range(8) for x in range(8)],
        "frame long, y long, x long, class_id long",
    )
    masks = spark.createDataFrame([(1, 1, 0, 7, 2, 5), (2, 2, 0, 7, 0, 7)], "instance_id long, frame long, y0 long, y1 long, x0 long, x1 long")
    got = entities.fuse_instances(masks, pixels, [0]).collect()
    assert [(r["instance_id"], r["class_id"], r["purity"]) for r in got] == [(1, 1, 0.5)]  # a tie goes to the lower class; a mask of ignored classes goes
    assert entities.fuse_instances(masks, pixels, [0], 0.8).count() == 0 and entities.fuse_instances(masks, pixels, [0], 0.4).count() == 1


def test_window_positions_over_many_stretches(spark):
    rows = [("r", i, (i * 37 % 500) * 1_000_000_000) for i in range(500)]
    df = spark.createDataFrame(rows, "run string, frame_id long, ts_ns long")
    got = {r["frame_id"]: r["n"] for r in scenes.positions(df, ["run"], "ts_ns", "frame_id", 7_000_000_000).collect()}
    assert got == {r[1]: n for n, r in enumerate(sorted(rows, key=lambda r: (r[2], r[1])))}


def test_split_groups(spark):
    names = ["interval5_AMtown01", "interval5_AMtown_GNSS02", "interval5_HKairport_GNSS_Evening", "somewhere"]
    df = spark.createDataFrame([(n,) for n in names], "run string").select("run", scenes.split_group(F.col("run")).alias("g"))
    assert [r["g"] for r in df.collect()] == ["AMtown", "AMtown", "HKairport", None]
    assert len({r[0] for r in df.filter("g = 'AMtown'").select(scenes.split_of(F.col("g"))).collect()}) == 1


def test_wilson_and_rotation(spark):
    df = spark.createDataFrame([(0, 0), (7, 14)], "h long, n long").select(grading.wilson(F.col("h"), F.col("n")).alias("w"))
    a, b = (r["w"] for r in df.collect())
    assert tuple(a) == (0.0, 1.0) and b["low"] == pytest.approx(0.2680, abs=1e-3) and b["high"] == pytest.approx(0.7320, abs=1e-3)
    for n in (2, 3, 7):
        r = spark.range(1).select(grading.rotated(F.sequence(F.lit(1), F.lit(n)), F.lit("seed")).alias("x")).first()["x"]
        assert sorted(r) == list(range(1, n + 1)) and all(x != i + 1 for i, x in enumerate(r))


def test_states_and_lineage(spark, tmp_path):
    moves = spark.createDataFrame(
        [
            ("REGISTERED", "SAMPLE_VERIFIED", "pass"),
            ("REGISTERED", "SAMPLE_VERIFIED", None),
            ("INGESTED", "GEOMETRY_READY", "reject"),
            ("RELEASED", "REJECTED", None),
            ("TASK_COMPILED", "QUARANTINED", None),
            ("QUARANTINED", "INGESTED", "pass"),
        ],
        "from_state string, to_state string, gate_status string",
    )
    got = {(r[0], r[1], r[2]): r["why_not"] for r in state.judge_transitions(moves).select("from_state", "to_state", "gate_status", "why_not").collect()}
    assert list(got.values()).count(None) == 2 and got["RELEASED", "REJECTED", None] == "final state" and got["REGISTERED", "SAMPLE_VERIFIED", None] == "gate report missing"
    a = spark.createDataFrame([("scene_1", ["x"])], "artifact_id string, parents array<string>")
    b = state.derive(a, "l1", F.lit("content"))
    assert b.first()["parents"] == ["x", "scene_1"] and b.first() == state.derive(a, "l1", F.lit("content")).first()
    path = str(tmp_path / "artifacts")
    state.write_once(b, path)
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        state.write_once(b, path)
    assert state.append_new(b, path).count() == 0


def test_readers(spark, tmp_path):
    (tmp_path / "poses.json").write_text('[{"OriginalImageName": "1.5.jpg", "Height": 10}, {"OriginalImageName": "1.5.jpg", "Height": 20}]')
    assert scenes.last_pose(readers.read_poses(spark, str(tmp_path / "poses.json"))).first()["pose"]["Height"] == 20
    assert readers.read_track(spark, str(tmp_path / "none*.csv")).count() == 0
    (tmp_path / "t.csv").write_text("headerstamp,lat,lon,alt,easting,northing\n12.5,1,2,3,4,5\n")
    assert readers.read_track(spark, str(tmp_path / "t.csv")).first()["ts_ns"] == 12_500_000_000
    (tmp_path / "l1.json").write_text('{"scene_id": "s", "objects": [{"object_id": "<obj_001>", "geometry": {"centroid": [1, 2, 3]}, "more": 1}]}')
    assert readers.read_layer(spark, str(tmp_path / "l1.json"), "l1_entities").first()["objects"][0]["geometry"]["centroid"] == [1, 2, 3]
    assert len(readers.layer_refs(spark, str(tmp_path / "l1.json")).first()["content_sha256"]) == 64


def test_scenes_from_archives(spark, tmp_path):
    """Zip files of two runs at one time: poses, tracks and labels of a run are its own, repeated poses count by their order, and every frame left out is counted."""
    import json
    import zipfile

    stamp = lambda i: f"{100 + i}.500000000"
    t = lambda x: [[1, 0, 0, x], [0, 1, 0, 2], [0, 0, 1, 3], [0, 0, 0, 1]]
    pose = lambda i, x: {"OriginalImageName": f"{stamp(i)}.jpg", "Height": 4, "Width": 6, "P3x3": [[1, 0, 0], [0, 1, 0], [0, 0, 1]], "K1": 0, "K2": 0, "P1": 0, "P2": 0, "K3": 0, "T4x4": t(x)}
    with zipfile.ZipFile(tmp_path / "interval5_CAM_LIDAR.zip", "w") as z, zipfile.ZipFile(tmp_path / "interval5_CAM_label.zip", "w") as label, zipfile.ZipFile(
        tmp_path / "interval5_LIDAR_label.zip", "w",
    ) as cloud:
        for run, x in (("interval5_Bay01", 0), ("interval5_Bay_GNSS02", 50)):
            top = f"interval5_CAM_LIDAR/{run}"
            for i in range(25):
                z.writestr(f"{top}/interval5_CAM/{stamp(i)}.jpg", b"")
                if i % 4:
                    z.writestr(f"{top}/interval5_LIDAR/image{stamp(i)}_lidar{stamp(i)}.txt", b"")
            z.writestr(f"{top}/sampleinfos_interpolated.json", json.dumps([pose(i, x + i) for i in range(24)] + [pose(3, x + 90)]))
            if x:
                z.writestr(
                    f"{top}/rtk_positions_raw.csv",
                    "lat,headerstamp,lon,alt,easting,northing\n" + "".join(f"1.5,{stamp(i)},2,3,{i},5\n" for i in range(0, 40, 2)),
                )
            label.writestr(f"interval5_CAM_label/{run}/interval5_CAM_label_id/{stamp(2)}.png", b"")
        cloud.writestr(f"interval5_LIDAR_label/interval5_Bay01/interval5_LIDAR_label_id/image{stamp(1)}_lidar{stamp(1)}.txt", b"")
    members = readers.read_archives(spark, str(tmp_path), r"\.(json|csv)$")
    assert members.filter("content is not null").count() == 3 and members.count() == 2 * (25 + 18 + 1 + 1) + 1 + 1
    files = members.filter("content is not null")
    poses, track = readers.poses_of(files.filter("path like '%.json'")), readers.track_of(files.filter("path like '%.csv'"))
    assert track.count() == 20 and track.first()["lat"] == 1.5
    paired = scenes.pair_frames(members.drop("content"), poses)
    got = {r["run"]: r for r in scenes.build_scenes(paired, track).collect()}
    a, b = got["interval5_Bay01"], got["interval5_Bay_GNSS02"]
    for r in (a, b):
        assert (
            r["split_group"], r["frames_requested"], r["frames_emitted"], r["frames_missing_pose"], r["frames_missing_lidar"], r["duration_s"], r["err"],
        ) == ("Bay", 25, 24, 1, 6, 23.0, None)
        assert [f["frame_id"] for f in r["frames"]] == [stamp(i) for i in range(24)]
    assert (a["track_samples"], b["track_samples"]) == (0, 12)
    assert a["span"] == [90.0, 0.0, 0.0] and b["span"] == [90.0, 0.0, 0.0] and b["frames"][3]["pose"][0][3] == 140.0
    assert a["annotations"] == ["semantic_2d", "semantic_3d"] and b["annotations"] == ["semantic_2d"] and a["scene_id"] == "uavscenes_Bay01_0000"
    assert a["frames"][2]["semantic_2d"] == f"labels_cam/{stamp(2)}.png" and a["frames"][0]["lidar_uri"] is None
    none = scenes.build_scenes(scenes.pair_frames(members.drop("content"), poses.limit(0)), track).first()
    assert none["err"] == "no frame has a pose" and none["frames_missing_pose"] == 25 and none["track_samples"] == 0


def test_pixels_are_written_once_and_read_back(spark, tmp_path):
    df = spark.createDataFrame(
        [("a", 1, 0, 0, 1.5, 0.25), ("a", 1, 0, 1, None, 0.5), ("b", 2, 0, 0, 2.0, 1.0)],
        "scene_id string, frame bigint, y bigint, x bigint, depth double, conf double",
    )
    path = str(tmp_path / "pixels")
    readers.write_pixels(df, path)
    assert sorted(map(str, readers.read_pixels(spark, path).collect())) == sorted(map(str, df.collect()))
    assert "PartitionFilters: [isnotnull(scene_id" in readers.read_pixels(spark, path).filter("scene_id = 'a'")._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(Exception, match="already exists"):
        readers.write_pixels(df, path)


def test_components_of_frames_over_batches(spark):
    """The same whatever a batch holds; null frames and classes, and frames larger than a batch."""
    rng = np.random.default_rng(3)
    rows = [(f, int(y), int(x), c) for f in (0, 1, 2, None, 7) for c in (0, 1, None) for y, x in {tuple(p) for p in rng.integers(0, 12, (60, 2))}]
    df = spark.createDataFrame(rows, "frame long, y long, x long, class_id long")
    want = {}
    for f in (0, 1, 2, None, 7):
        for c in (0, 1, None):
            there, n = {(r[1], r[2]) for r in rows if r[0] == f and r[3] == c}, 0
            for p in sorted(there):
                if (f, c, *p) in want:
                    continue
                todo = [p]
                while todo:
                    q = todo.pop()
                    if q in there and (f, c, *q) not in want:
                        want[f, c, *q] = n
                        todo += [(q[0] + a, q[1] + b) for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0))]
                n += 1
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in ("7", "100", before):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            got = {(r["frame"], r["class_id"], r["y"], r["x"]): r["component"] for r in entities.components(df).collect()}
            assert got == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert entities.components(df.limit(0)).count() == 0
