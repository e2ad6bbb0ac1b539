"""Relations of boxes, views, alignment and matching against plain versions; degenerate and empty inputs."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from scenewright.operators import alignment, matching, relations, visibility

BOX = "scene_id string, entity_id string, center array<double>, axes array<array<double>>, extent array<double>"
UPRIGHT = [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]]


def turned(rng):
    q, r = np.linalg.qr(rng.normal(size=(3, 3)))
    q *= np.sign(np.diag(r))
    return q.tolist()


def corners(box):
    c, x, e = (np.array(v) for v in box)
    return np.array([c + sum(s * x[k] * e[k] / 2 for k, s in enumerate(signs)) for signs in itertools.product((-1, 1), repeat=3)])


def plain_gap(a, b):
    """The largest gap between the shadows of both boxes' corners on the axes of both, their cross products and the coordinate axes."""
    pa, pb, best = corners(a), corners(b), -math.inf
    axes = [*np.eye(3), *map(np.array, a[1]), *map(np.array, b[1]), *(np.cross(u, v) for u in a[1] for v in b[1])]
    for u in axes:
        n = np.linalg.norm(u)
        if n > 1e-9:
            sa, sb = pa @ u / n, pb @ u / n
            best = max(best, sb.min() - sa.max(), sa.min() - sb.max())
    return best


def plain_relations(boxes, near=2.0, tol=0.05):
    out = set()
    for (s, i, *a), (t, j, *b) in itertools.combinations(sorted(boxes), 2):
        if s != t:
            continue
        gap = plain_gap(a, b)
        if gap <= near:
            out.add((s, "intersect" if gap < -tol else "adjacent" if gap <= tol else "near", i, j))
        for (x, p), (y, q) in (((i, a), (j, b)), ((j, b), (i, a))):
            c, ax, e = (np.array(v) for v in p)
            if (np.abs((corners(q) - c) @ ax.T) <= e / 2 + tol).all():
                out.add((s, "contain", x, y))
            lo, hi = corners(p), corners(q)
            over = all(hi[:, k].min() < lo[:, k].max() and lo[:, k].min() < hi[:, k].max() for k in (0, 1))
            if over and abs(hi[:, 2].min() - lo[:, 2].max()) <= tol:
                out.add((s, "support", x, y))
    return out


def found(df):
    return {tuple(r[:4]) for r in df.collect()}


def test_relations_equal_those_of_all_pairs(spark):
    """Boxes from a hundredth of a metre to a whole scene, some in one another, some on top of others."""
    rng = np.random.default_rng(5)
    boxes = []
    for i in range(150):
        size = 10 ** rng.uniform(-2, 1.3, 3)
        boxes.append((f"s{i % 2}", f"e{i:03d}", (rng.normal(size=3) * 12).tolist(), turned(rng) if i % 3 else UPRIGHT, size.tolist()))
    boxes.append(("s0", "ground", [0.0, 0.0, -50.5], UPRIGHT, [300.0, 300.0, 1.0]))
    for i in range(6):  # on the ground, on each other, and in each other
        boxes += [("s0", f"g{i}", [20.0 * i, 0.0, -49.0], UPRIGHT, [4.0, 4.0, 2.0]), ("s0", f"h{i}", [20.0 * i, 0.5, -47.49], UPRIGHT, [1.0, 1.0, 1.0])]
        boxes.append(("s0", f"i{i}", [20.0 * i, 0.0, -49.0], turned(rng), [0.5, 0.5, 0.5]))
    want = plain_relations(boxes)
    got = relations.spatial_relations(spark.createDataFrame(boxes, BOX).repartition(5))
    rows = got.collect()
    assert (found(got) - want, want - found(got)) == (set(), set()) and len(rows) == len(want)
    assert {r[1] for r in want} == {"intersect", "adjacent", "near", "contain", "support"}
    by = {(b[0], b[1]): b[2:] for b in boxes}
    for r in rows:
        assert r["gap"] == pytest.approx(plain_gap(by[r[0], r[2]], by[r[0], r[3]]), abs=1e-9)
    far = relations.spatial_relations(spark.createDataFrame(boxes, BOX), near=30.0, tolerance=0.5)
    assert found(far) == plain_relations(boxes, 30.0, 0.5)


def test_touching_and_equal_boxes(spark):
    boxes = [("s", n, c, UPRIGHT, [1.0, 1.0, 1.0]) for n, c in (("a", [0.0, 0.0, 0.0]), ("b", [1.0, 0.0, 0.0]), ("c", [1.0, 0.0, 0.0]), ("d", [0.5, 0.5, 1.0]), ("e", [5.0, 5.0, 5.0]))]
    boxes.append(("other", "f", [0.0, 0.0, 0.0], UPRIGHT, [1.0, 1.0, 1.0]))
    got = found(relations.spatial_relations(spark.createDataFrame(boxes, BOX), near=0.5))
    want = {("adjacent", "a", "b"), ("adjacent", "a", "c"), ("intersect", "b", "c"), ("contain", "b", "c"), ("contain", "c", "b")}
    want |= {(k, *p) for x in "abc" for k, p in (("adjacent", (x, "d")), ("support", (x, "d")))}
    assert got == {("s", *w) for w in want}


def test_a_pair_is_met_once_and_only_near_ones_meet(spark):
    boxes = [("s", f"e{i:04d}", [3.0 * i, 0.0, 0.0], UPRIGHT, [1.0, 1.0, 1.0]) for i in range(400)]
    rows = spark.createDataFrame(boxes, BOX)
    lo, hi = relations.upright_extent(F.col("center"), F.col("axes"), F.col("extent"))
    met = relations.meeting_pairs(rows.withColumns({"lo": lo, "hi": hi}), 2.0).select("a.entity_id", "b.entity_id").collect()
    assert sorted(tuple(sorted(m)) for m in met) == [(f"e{i:04d}", f"e{i + 1:04d}") for i in range(399)]


def test_boxes_that_are_none(spark):
    nan = float("nan")
    boxes = [
        ("s", "good", [0.0, 0.0, 0.0], UPRIGHT, [1.0, 1.0, 1.0]),
        ("s", "point", [0.0, 0.0, 0.2], UPRIGHT, [0.0, 0.0, 0.0]),
        ("s", "flat", [0.0, 0.0, 0.0], UPRIGHT, [1.0, -1.0, 1.0]),
        ("s", "nan", [nan, 0.0, 0.0], UPRIGHT, [1.0, 1.0, 1.0]),
        ("s", "skew", [0.0, 0.0, 0.0], [[1.0, 0.0, 0.0], [1.0, 0.0, 0.0], [0.0, 0.0, 1.0]], [1.0, 1.0, 1.0]),
        ("s", "null", None, None, None),
        ("s", None, [0.0, 0.0, 0.0], UPRIGHT, [1.0, 1.0, 1.0]),
    ]
    df = spark.createDataFrame(boxes, BOX)
    assert found(relations.spatial_relations(df)) == {("s", "intersect", "good", "point"), ("s", "contain", "good", "point")}
    assert {(r["entity_id"], r["err"]) for r in relations.bad_boxes(df).collect()} == {(n, "not a box") for n in ("flat", "nan", "skew", "null")} | {(None, "no id")}
    assert relations.bad_boxes(df.union(df).filter("entity_id = 'good'")).select("err").distinct().collect() == [("repeated id",)]
    assert relations.spatial_relations(df.limit(0)).count() == 0


CAMERA = "scene_id string, frame long, pose array<array<double>>, k array<array<double>>, height int, width int"
EYE = np.eye(4).tolist()
LENS = [[100.0, 0.0, 50.0], [0.0, 100.0, 40.0], [0.0, 0.0, 1.0]]


def test_a_wall_hides_what_is_behind_it(spark):
    grid = [i / 10 for i in range(-20, 21)]
    points = [("s", "wall", x, y, 5.0) for x in grid for y in grid if x <= 0]
    points += [("s", "tree", x * 2, y * 2, 10.0) for x in grid for y in grid]
    points += [("s", "behind", 0.0, 0.0, -5.0), ("s", "lost", float("nan"), 0.0, 5.0), ("s", "aside", 99.0, 0.0, 5.0), ("none", "wall", 0.0, 0.0, 5.0)]
    cameras = [("s", 0, EYE, LENS, 80, 100), ("s", 1, None, LENS, 80, 100), ("t", 0, EYE, LENS, 80, 100)]
    seen = visibility.seen_points(spark.createDataFrame(points, "scene_id string, entity_id string, x double, y double, z double"), spark.createDataFrame(cameras, CAMERA), 2)
    want = {}
    for s, e, x, y, z in points:
        if s == "s" and z > 0.1 and 0 <= 100 * x / z + 50 < 100 and 0 <= 100 * y / z + 40 < 80:
            want.setdefault((math.floor((100 * x / z + 50) / 2), math.floor((100 * y / z + 40) / 2)), []).append((z, e))
    assert seen.count() == sum(map(len, want.values()))
    buffer = visibility.depth_buffer(seen)
    assert {(r["px"], r["py"]): (r["front_depth"], r["front"]) for r in buffer.collect()} == {k: min(v) for k, v in want.items()}
    n = sum(e == "tree" for v in want.values() for _, e in v)
    hidden = sum(e == "tree" and min(v)[1] == "wall" for v in want.values() for _, e in v)
    of = {r["entity_id"]: r for r in visibility.visible_from(seen, buffer, least=0.8).collect()}
    assert set(of) == {"wall", "tree"} and (of["tree"]["n_points"], of["tree"]["n_visible"]) == (n, n - hidden)
    assert of["wall"]["share"] == 1.0 and of["wall"]["visible"] and not of["tree"]["visible"]
    assert [tuple(r) for r in visibility.occlusions(seen, buffer).collect()] == [("s", 0, "wall", "tree", hidden, hidden / n)]
    assert visibility.occlusions(seen, buffer, least=0.9).count() == 0 and visibility.visible_from(seen.limit(0), buffer).count() == 0


def planted(rng, scale, n, wrong=0, flat=False, origin=0.0):
    r = np.array(turned(rng))
    r *= np.sign(np.linalg.det(r))
    a = rng.normal(size=(n, 3)) * 20 + origin
    if flat:
        a[:, 2] = 1.0
    shift = rng.normal(size=3) * 100
    b = scale * a @ r.T + shift
    b[:wrong] += rng.normal(size=(wrong, 3)) * 300
    return a, b, r, shift


PAIR = "run string, ax double, ay double, az double, bx double, by double, bz double"


def test_planted_transforms_come_back(spark):
    rng = np.random.default_rng(6)
    cases = {f"clean{i}": planted(rng, s, 40) for i, s in enumerate((1.0, 0.01, 7.5))}
    cases |= {"wrong": planted(rng, 2.0, 90, 25), "flat": planted(rng, 1.5, 30, flat=True), "far": planted(rng, 1.0, 50, 5, origin=4e5), "three": planted(rng, 3.0, 3)}
    rows = [(k, *map(float, p), *map(float, q)) for k, (a, b, *_) in cases.items() for p, q in zip(a, b, strict=True)]
    rows += [("clean0", float("nan"), 1.0, 1.0, 1.0, 1.0, 1.0), ("clean0", None, 1.0, 1.0, 1.0, 1.0, 1.0)]
    got = {r["run"]: r for r in alignment.similarity(spark.createDataFrame(rows, PAIR).repartition(4), ["run"]).collect()}
    for k, (a, b, r, shift) in cases.items():
        scale = {"clean0": 1.0, "clean1": 0.01, "clean2": 7.5, "wrong": 2.0, "flat": 1.5, "far": 1.0, "three": 3.0}[k]
        g, far = got[k], k == "far"
        assert g["err"] is None and g["n_pairs"] == len(a)
        assert g["scale"] == pytest.approx(scale, rel=1e-9) and np.allclose(g["rotation"], r.ravel(), atol=1e-9)
        assert np.allclose(g["shift"], shift, atol=1e-3 if far else 1e-7) and g["rmse"] < (1e-6 if far else 1e-9)
        assert g["n_used"] == len(a) - {"wrong": 25, "far": 5}.get(k, 0)


def test_alignments_that_cannot_be(spark):
    rng = np.random.default_rng(7)
    a, b, r, _ = planted(rng, 2.0, 20)
    line = np.outer(np.arange(10.0), [1.0, 2.0, 3.0])
    cases = {"mirrored": (a, a * [1, 1, -1]), "line": (line, line + 1), "same": (np.ones((5, 3)), np.ones((5, 3))), "two": (a[:2], b[:2]), "good": (a, b)}
    rows = [(k, *map(float, p), *map(float, q)) for k, (x, y) in cases.items() for p, q in zip(x, y, strict=True)] + [(None, *map(float, p), *map(float, q)) for p, q in zip(a, b, strict=True)]
    df = spark.createDataFrame(rows, PAIR)
    got = {r["run"]: r for r in alignment.similarity(df, ["run"]).collect()}
    assert {k: g["err"] for k, g in got.items()} == {"mirrored": "mirrored", "line": "points on a line", "same": "points on a line", "two": "fewer than three points", "good": None, None: None}
    assert got["mirrored"]["scale"] is None and got["mirrored"]["shift"] is None and got[None]["scale"] == pytest.approx(2.0)
    stiff = {g["run"]: g for g in alignment.similarity(df, ["run"], rigid=True).collect()}
    assert stiff["good"]["scale"] == 1.0 and np.allclose(stiff["good"]["rotation"], r.ravel(), atol=0.2) and stiff["good"]["rmse"] > 1
    assert alignment.similarity(df.limit(0), ["run"]).count() == 0


def test_as_of_equals_a_search(spark):
    rng = np.random.default_rng(8)
    left = [(rng.choice(["a", "b", "c"]), int(rng.integers(0, 1000)), i) for i in range(300)] + [("d", 5, 300), (None, 5, 301), ("a", None, 302)]
    right = [(rng.choice(["a", "b", "e"]), int(rng.integers(100, 900) // 7 * 7), i, float(i)) for i in range(120)] + [(None, 1, 500, 1.0), ("a", None, 501, 1.0), ("c", 300, 502, None)]
    lf, rt = spark.createDataFrame(left, "run string, ts long, id int"), spark.createDataFrame(right, "run string, ts long, tie int, v double")
    for width, within in ((1, None), (50, None), (10**6, None), (50, 20)):
        got = {r["id"]: (r["as_of_ts"], r["v"]) for r in matching.as_of(lf, rt, ["run"], "ts", ["v"], "tie", width, within).collect()}
        assert len(got) == len(left)
        for run, ts, i in left:
            there = [(t, k, v) for n, t, k, v in right if run is not None and n == run and ts is not None and t is not None and t <= ts]
            best = max(there, key=lambda x: x[:2], default=None)
            if best and within is not None and ts - best[0] > within:
                best = None
            assert got[i] == ((best[0], best[2]) if best else (None, None))
    assert matching.as_of(lf, rt.limit(0), ["run"], "ts", ["v"], "tie", 50).filter("as_of_ts is not null").count() == 0
    assert matching.as_of(lf.limit(0), rt, ["run"], "ts", ["v"], "tie", 50).count() == 0


def test_nearest_equals_a_search(spark):
    rng = np.random.default_rng(9)
    rows = [(f"r{i % 4}", i, float(x), float(y)) for i, (x, y) in enumerate(rng.normal(size=(300, 2)) * 30)]
    rows += [(f"r{i % 2}", 300 + i, 5.0, 5.0) for i in range(40)] + [("r0", 900, None, 1.0), (None, 901, 1.0, 1.0), ("r1", 902, float("nan"), 1.0), ("r9", 903, 1e6, 1e6)]
    df = spark.createDataFrame(rows, "run string, id long, x double, y double")
    clean = [r for r in rows if None not in r and r[2] == r[2]]
    for radius, rings in ((6.0, 4), (0.5, 1), (100.0, 6)):
        want = {}
        for run, i, x, y in clean:
            near = [(math.sqrt((x - p) ** 2 + (y - q) ** 2), s, j) for s, j, p, q in clean if s != run]
            best = min(near)
            if best[0] <= radius:
                want[run, i] = best
        got = {(r["run"], r["id"]): (r["distance"], r["other_run"], r["other_id"]) for r in matching.nearest_of_other_runs(df, radius, rings).collect()}
        assert got.keys() == want.keys()
        assert all(got[k][1:] == want[k][1:] and got[k][0] == pytest.approx(want[k][0]) for k in want)
    assert matching.nearest_of_other_runs(df.limit(0), 5.0).count() == 0


def test_no_plan_joins_everything(spark, sf):
    from scenewright import queries, spatial_queries  # noqa: F401

    for name in ("l2_spatial_relations", "l2_visible_from", "l2_occlusions", "j_track_as_of"):
        plan = queries.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "Python" not in plan
