"""Point clouds written by hand in each format, also cut into many ranges of bytes."""

from __future__ import annotations

import numpy as np
import pytest

from scenewright.sources import clouds

RNG = np.random.default_rng(1)
XYZI = RNG.normal(0, 100, (500, 4))


def points(df):
    return [(r.i, r.x, r.y, r.z, r.intensity) for r in sorted(df.collect(), key=lambda r: r.i)]


def expected(a):
    return [(i, *map(float, r[:3]), float(r[3]) if len(r) > 3 else None) for i, r in enumerate(a)]


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(clouds, "RANGE", 700)


def test_npy(spark, tmp_path, small):
    for name, a in (("wide", XYZI), ("single", XYZI[:, :3].astype("f4")), ("fortran", np.asfortranarray(XYZI)), ("none", XYZI[:0])):
        np.save(tmp_path / f"{name}.npy", a)
        df = clouds.read_files(spark, str(tmp_path / f"{name}.npy"), "binary_npy")
        assert points(df) == expected(a)
    assert df.rdd.getNumPartitions() == 1
    assert clouds.read_files(spark, str(tmp_path / "wide.npy"), "binary_npy").rdd.getNumPartitions() > 20
    assert clouds.read_files(spark, str(tmp_path), "binary_npy").groupBy("uri").count().count() == 3
    (tmp_path / "none").mkdir()
    assert clouds.read_files(spark, str(tmp_path / "none"), "binary_npy").count() == 0


def test_pcd(spark, tmp_path, small):
    head = "# .PCD v0.7\nVERSION 0.7\nFIELDS x y z _ intensity\nSIZE 4 4 4 1 8\nTYPE F F F U F\nCOUNT 1 1 1 4 1\nWIDTH 500\nHEIGHT 1\nPOINTS 500\nDATA "
    rows = np.zeros(500, np.dtype([("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("pad", "u1", (4,)), ("intensity", "<f8")]))
    for i, c in enumerate(("x", "y", "z", "intensity")):
        rows[c] = XYZI[:, i]
    (tmp_path / "a.pcd").write_bytes(head.encode() + b"binary\n" + rows.tobytes())
    want = [(i, float(r["x"]), float(r["y"]), float(r["z"]), float(r["intensity"])) for i, r in enumerate(rows)]
    assert points(clouds.read_files(spark, str(tmp_path / "a.pcd"), "pcd")) == want
    text = "".join(f"{a!r} {b!r} {c!r} 0 0 0 0 {d!r}\n" for _, a, b, c, d in want)
    (tmp_path / "b.pcd").write_text(head + "ascii\n" + text)
    assert points(clouds.read_files(spark, str(tmp_path / "b.pcd"), "pcd")) == want
    (tmp_path / "c.pcd").write_text(head + "binary_compressed\n")
    with pytest.raises(Exception, match="binary_compressed"):
        clouds.read_files(spark, str(tmp_path / "c.pcd"), "pcd").count()


def test_ply(spark, tmp_path, small):
    for form, order in (("binary_little_endian", "<"), ("binary_big_endian", ">")):
        rows = np.zeros(500, np.dtype([("x", f"{order}f8"), ("red", "u1"), ("y", f"{order}f8"), ("z", f"{order}f8")]))
        for i, c in enumerate(("x", "y", "z")):
            rows[c] = XYZI[:, i]
        head = f"ply\nformat {form} 1.0\ncomment c\nelement vertex 500\nproperty double x\nproperty uchar red\nproperty float64 y\nproperty double z\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n"
        (tmp_path / f"{form}.ply").write_bytes(head.encode() + rows.tobytes() + b"\x03" + b"\0" * 12)
        assert points(clouds.read_files(spark, str(tmp_path / f"{form}.ply"), "ply")) == expected(XYZI[:, :3])
    (tmp_path / "t.ply").write_text("ply\nformat ascii 1.0\nelement vertex 2\nproperty float x\nproperty float y\nproperty float z\nend_header\n1 2 3\n4 5 6.5\n3 0 1 2\n")
    assert points(clouds.read_files(spark, str(tmp_path / "t.ply"), "ply")) == [(0, 1.0, 2.0, 3.0, None), (1, 4.0, 5.0, 6.5, None)]
    (tmp_path / "cut.ply").write_bytes((tmp_path / "binary_little_endian.ply").read_bytes()[:400])
    with pytest.raises(Exception, match="cut short"):
        clouds.read_files(spark, str(tmp_path / "cut.ply"), "ply").count()


def test_texts(spark, tmp_path):
    (tmp_path / "a.xyz").write_text("# c\n1 2 3\n\n 1.5\t-2e1,3 9\r\n1 2\nx 1 2\n")
    got = sorted((r.x or 0, r.y, r.z, r.intensity, r.err) for r in clouds.read_texts(spark, str(tmp_path / "a.xyz"), "ascii_xyz").collect())
    assert [g for g in got if g[4] is None] == [(1.0, 2.0, 3.0, None, None), (1.5, -20.0, 3.0, None, None)]
    assert sorted(g[4] for g in got if g[4]) == ["not 3 numbers: 1 2", "not 3 numbers: x 1 2"]
    (tmp_path / "b.xyzi").write_text("1 2 3 4\n1 2 3\n")
    assert sorted((r.intensity, r.err) for r in clouds.read_texts(spark, str(tmp_path / "b.xyzi"), "ascii_xyzi").collect() if r.err is None) == [(4.0, None)]
