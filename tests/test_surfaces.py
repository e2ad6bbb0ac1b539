"""Planted planes with wrong points, and clearances against all missing cells."""

from __future__ import annotations

import math

import numpy as np

from scenewright.operators import surfaces

POINTS = "k string, x double, y double, z double"


def test_planted_planes_come_back(spark):
    rng = np.random.default_rng(3)
    rows = []
    for name, slope, aspect in (("east", 30.0, 90.0), ("north", 12.0, 0.0), ("southwest", 60.0, -135.0)):
        s, a = math.radians(slope), math.radians(aspect)
        n = np.array([math.sin(s) * math.sin(a), math.sin(s) * math.cos(a), math.cos(s)])
        xy = rng.uniform(-20, 20, (200, 2))
        z = (7.0 - xy @ n[:2]) / n[2] + np.where(rng.random(200) < 0.2, rng.uniform(5, 30, 200), 0.0)
        rows += [(name, 5e5 + x, 4e6 + y, c) for (x, y), c in zip(xy.tolist(), z.tolist(), strict=True)]
    rows += [(None, float(x), float(y), 3.0) for x in range(4) for y in range(4)] + [("line", float(i), 2.0 * i, 0.0) for i in range(9)]
    rows += [("two", 0.0, 0.0, 0.0), ("two", 1.0, 0.0, 0.0), ("two", float("nan"), 0.0, 0.0), ("two", None, 1.0, 1.0)]
    got = {r.k: r for r in surfaces.planes(spark.createDataFrame(rows, POINTS), ["k"]).collect()}
    for name, slope, aspect in (("east", 30.0, 90.0), ("north", 12.0, 0.0), ("southwest", 60.0, -135.0)):
        r = got[name]
        assert abs(r.slope_deg - slope) < 1e-6 and abs(r.aspect_deg - aspect) < 1e-6 and r.roughness_m < 1e-6 and r.planarity_residual_p95_m < 1e-6
        assert 0.7 < r.inlier_ratio < 0.9 and r.n_points == 200 and r.err is None
        assert abs(np.dot(r.normal, [5e5, 4e6, 0]) + 7.0 - r.offset_m) < 1e-2
    assert got[None].slope_deg == 0 and got[None].aspect_deg is None and got[None].offset_m == 3.0
    assert got["line"].err == "points on a line" and got["two"].err == "fewer than three points" and got["two"].normal is None and got["two"].n_points == 2
    assert surfaces.planes(spark.createDataFrame([], POINTS), ["k"]).count() == 0


def test_clearances_equal_those_to_all_missing_cells(spark):
    rng = np.random.default_rng(5)
    grids = {"full": np.ones((9, 14), bool), "holes": rng.random((20, 17)) < 0.9, "few": rng.random((12, 12)) < 0.3, None: np.ones((1, 1), bool)}
    rows, want = [], {}
    for k, grid in grids.items():
        wide = np.pad(grid, 1)
        out = np.argwhere(~wide) - 1
        for i, j in np.argwhere(grid):
            rows.append((k, int(i) - 5, int(j) - 3))
            want[k, int(i) - 5, int(j) - 3] = int(((out - [i, j]) ** 2).sum(1).min())
    cells = spark.createDataFrame(rows + rows[:40] + [("full", None, 1), ("full", 1, None)], "k string, i long, j long")
    assert {(r.k, r.i, r.j): r.far2 for r in surfaces.clearances(cells, ["k"]).collect()} == want
    circles = {r.k: r for r in surfaces.inscribed_circles(cells, ["k"], 0.5).collect()}
    for k, grid in grids.items():
        best = max(v for (q, _, _), v in want.items() if q == k)
        first = min((i, j) for (q, i, j), v in want.items() if q == k and v == best)
        assert (circles[k].radius_m, circles[k].area_m2, circles[k].i, circles[k].j) == (math.sqrt(best) / 2, grid.sum() / 4, *first)
    assert surfaces.inscribed_circles(cells.limit(0), ["k"]).count() == 0
