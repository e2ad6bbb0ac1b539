"""Calibration against pairs counted one by one."""

from __future__ import annotations

import random

import pytest

from scenewright.operators import calibration as C

SCHEMA = "run string, score double, truth boolean"


def plain(rows, bins):
    good = [(s, t) for s, t in rows if s is not None and 0 <= s <= 1 and t is not None]
    pos, neg = [s for s, t in good if t], [s for s, t in good if not t]
    auc = sum((p > q) + (p == q) / 2 for p in pos for q in neg) / (len(pos) * len(neg)) if pos and neg else None
    by = {}
    for s, t in good:
        by.setdefault(min(int(s * bins), bins - 1), []).append((s, t))
    brier = sum((s - t) ** 2 for s, t in good) / len(good) if good else None
    ece = sum(abs(sum(t for _, t in b) - sum(s for s, _ in b)) for b in by.values()) / len(good) if good else None
    return len(rows), len(rows) - len(good), len(pos), len(neg), auc, brier, ece


@pytest.mark.parametrize("bins", [1, 10])
def test_calibration_equals_counted_pairs(spark, bins):
    rng = random.Random(4)
    of = {"even": [(rng.random(), rng.random() < 0.4) for _ in range(300)], "ties": [(rng.randrange(5) / 4, rng.random() < 0.5) for _ in range(200)]}
    of |= {"near": [(0.5 + rng.random() * 1e-9, rng.random() < 0.5) for _ in range(150)], "true": [(0.3, True), (1.0, True)], "zeros": [(0.0, True), (-0.0, False)]}
    of |= {"bad": [(None, True), (float("nan"), False), (1.1, True), (-0.1, False), (0.5, None)], None: [(0.2, False), (0.9, True), (None, None)]}
    df = spark.createDataFrame([(k, s, t) for k, v in of.items() for s, t in v], SCHEMA).repartition(3)
    got = {r["run"]: r for r in C.calibration(df, ["run"], "score", "truth", bins).collect()}
    assert got.keys() == of.keys()
    for k, v in of.items():
        *want, auc, brier, ece = plain(v, bins)
        assert [got[k][n] for n in ("n_rows", "n_bad", "n_true", "n_false")] == want
        assert got[k]["auc"] == (None if auc is None else pytest.approx(auc, abs=1e-12))
        assert got[k]["brier"] == (None if brier is None else pytest.approx(brier)) and got[k]["ece"] == (None if ece is None else pytest.approx(ece))
    assert {k: r["err"] for k, r in got.items() if r["err"]} == {"true": "one truth only", "bad": "no usable row"}
    assert C.calibration(df.limit(0), ["run"], "score", "truth").count() == 0
