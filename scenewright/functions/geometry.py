"""Geometry as Column builders over arrays of doubles.

Every builder that the task truth rests on returns struct(value, err): err is null for a good input and says what is
wrong with a degenerate one, whose value is then null. Rows are thus routed by err instead of failing a whole job.
NaN and infinity count as bad input everywhere, because Spark orders NaN above all numbers.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

#: Tolerances of "all close" and of a vector that counts as zero.
RTOL, ATOL, TINY = 1e-5, 1e-8, 1e-8


def vec(x: Column | float, y: Column | float, z: Column | float) -> Column:
    return F.array(*[(c if isinstance(c, Column) else F.lit(float(c))).cast("double") for c in (x, y, z)])


def vec4(*values: float) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def at(v: Column, i: int) -> Column:
    return F.get(v, F.lit(i))


def vec4_of(*values: Column | float) -> Column:
    """The same of columns and numbers."""
    return F.array(*[(c if isinstance(c, Column) else F.lit(float(c))).cast("double") for c in values])


def dot(a: Column, b: Column, n: int = 3) -> Column:
    return reduce(lambda s, i: s + at(a, i) * at(b, i), range(1, n), at(a, 0) * at(b, 0))


def sub(a: Column, b: Column) -> Column:
    return F.array(*[at(a, i) - at(b, i) for i in range(3)])


def add(a: Column, b: Column) -> Column:
    return F.array(*[at(a, i) + at(b, i) for i in range(3)])


def scale(a: Column, k: Column) -> Column:
    return F.array(*[at(a, i) * k for i in range(3)])


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def distance(a: Column, b: Column) -> Column:
    return norm(sub(a, b))


def cross(a: Column, b: Column) -> Column:
    return F.array(*[at(a, (i + 1) % 3) * at(b, (i + 2) % 3) - at(a, (i + 2) % 3) * at(b, (i + 1) % 3) for i in range(3)])


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def is_point(p: Column) -> Column:
    """Three finite numbers; false, never null."""
    return F.coalesce((F.size(p) == 3) & F.forall(p, finite), F.lit(False))


def is_points(ps: Column) -> Column:
    """At least one point and all of them good."""
    return F.coalesce((F.size(ps) > 0) & F.forall(ps, is_point), F.lit(False))


def outcome(value: Column, *checks: tuple[Column, str]) -> Column:
    """struct(value, err): the first check that holds names the error."""
    err = F.lit(None).cast("string")
    for cond, what in reversed(checks):
        err = F.when(cond, F.lit(what)).otherwise(err)
    return F.struct(F.when(err.isNull(), value).alias("value"), err.alias("err"))


def rounded(x: Column, digits: int) -> Column:
    """x to so many decimals as SQL engines and C do it: x times the power of ten, halves away from zero, divided again.

    Spark's own round goes by the shortest decimal form of x, and so differs once that has no digits left after the half.
    """
    power = 10.0**digits
    r = F.round(x * power) / power
    return F.when(F.abs(r) < float("inf"), r).otherwise(x)


@F.pandas_udf(ArrayType(DoubleType()))
def _cos_sin(angle: pd.Series) -> pd.Series:
    return pd.Series([[math.cos(a), math.sin(a)] if math.isfinite(a) else [math.nan, math.nan] for a in angle.tolist()], dtype=object)


def cos_sin(angle: Column) -> Column:
    """[cosine, sine] of radians by the C library, as SQL engines have them; the JVM's differ in the last bit of one angle in 500."""
    return F.when(angle.isNotNull(), _cos_sin(angle.cast("double")))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, where an expression would otherwise repeat it many times over."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _segment_distance(p: Column, a: Column, b: Column) -> Column:
    """Distance to a segment that is not a point."""

    def measured(ab: Column, ap: Column) -> Column:
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(dot(ap, ab), dot(ab, ab))))
        return let(t, lambda k: norm(sub(ap, scale(ab, k))))

    return let(sub(b, a), lambda ab: let(sub(p, a), lambda ap: measured(ab, ap)))


def point_to_segment(p: Column, a: Column, b: Column) -> Column:
    ab = sub(b, a)
    return outcome(
        _segment_distance(p, a, b), (~(is_point(p) & is_point(a) & is_point(b)), "not three finite points"), (dot(ab, ab) == 0, "segment of no length"),
    )


def all_close(a: Column, b: Column) -> Column:
    return reduce(
        lambda c, i: c & (F.abs(at(a, i) - at(b, i)) <= ATOL + RTOL * F.abs(at(b, i))), range(1, 3), F.abs(at(a, 0) - at(b, 0)) <= ATOL + RTOL * F.abs(at(b, 0)),
    )


def point_to_polyline(p: Column, line: Column) -> Column:
    """value: struct(d, seg) of the nearest segment, the first of equal ones. Segments of no length are passed over."""
    # guarded: nothing is built from a line of fewer than two vertices
    starts = F.when(is_points(line) & (F.size(line) >= 2), F.sequence(F.lit(0), F.size(line) - 2))
    there = F.filter(
        F.transform(starts, lambda i: F.struct(F.get(line, i).alias("a"), F.get(line, i + 1).alias("b"), i.alias("i"))), lambda s: ~all_close(s["a"], s["b"]),
    )
    best = F.array_min(F.transform(there, lambda s: F.struct(_segment_distance(p, s["a"], s["b"]).alias("d"), s["i"].alias("seg"))))
    none = F.lit(None).cast("struct<d:double,seg:int>")
    return let(
        F.coalesce(best, none),
        lambda b: outcome(
            b,
            (~is_point(p), "not a finite point"),
            (~is_points(line), "not a line of finite points"),
            (F.size(line) < 2, "fewer than two vertices"),
            (b.isNull(), "no segment has a length"),
        ),
    )


def nearest_polyline(p: Column, lines: Column, line_of: Callable[[Column], Column], id_of: Callable[[Column], Column]) -> Column:
    """value: struct(id, d, seg) of the nearest of an array of lines; of equal distances the earlier entry. One bad line spoils all."""

    def best(found: Column) -> Column:
        top = F.array_min(
            F.transform(
                found, lambda x: F.struct(x["r"]["value"]["d"].alias("d"), x["pos"].alias("pos"), x["r"]["value"]["seg"].alias("seg"), x["id"].alias("id")),
            )
        )
        bad = F.exists(found, lambda x: x["r"]["err"].isNotNull())
        return outcome(
            let(top, lambda t: F.struct(t["id"].alias("id"), t["d"].alias("d"), t["seg"].alias("seg"))),
            (F.coalesce(F.size(lines), F.lit(0)) <= 0, "no lines"),
            (bad, "a line is degenerate"),
        )

    return let(F.transform(lines, lambda x, i: F.struct(point_to_polyline(p, line_of(x)).alias("r"), i.alias("pos"), id_of(x).alias("id"))), best)


def pairwise_min(a: Column, b: Column) -> Column:
    """Least distance between two small arrays of points."""
    least = F.array_min(F.transform(a, lambda p: F.array_min(F.transform(b, lambda q: distance(p, q)))))
    return outcome(least, (~(is_points(a) & is_points(b)), "not two sets of finite points"))


def is_pose(t: Column) -> Column:
    """A 4x4 of finite numbers, rigid to 1e-4, last row 0 0 0 1."""
    shaped = F.coalesce((F.size(t) == 4) & F.forall(t, lambda r: (F.size(r) == 4) & F.forall(r, finite)), F.lit(False))
    row = lambda i: F.get(t, F.lit(i))
    last = reduce(lambda c, k: c & (F.abs(at(row(3), k) - (1.0 if k == 3 else 0.0)) <= 1e-6), range(4), F.lit(True))
    rigid = reduce(
        lambda c, ij: c & (F.abs(dot(row(ij[0]), row(ij[1])) - (1.0 if ij[0] == ij[1] else 0.0)) <= 1e-4),
        [(i, j) for i in range(3) for j in range(i, 3)],
        F.lit(True),
    )
    return shaped & F.coalesce(last & rigid, F.lit(False))


def _column(t: Column, k: int) -> Column:
    return F.array(*[at(at(t, i), k) for i in range(3)])


def camera_center(t: Column) -> Column:
    return outcome(_column(t, 3), (~is_pose(t), "not a rigid pose"))


def camera_forward(t: Column, convention: str | Column = "opencv") -> Column:
    """The viewing direction: +z of an OpenCV camera, -z of an OpenGL one."""
    c = convention if isinstance(convention, Column) else F.lit(convention)
    z = _column(t, 2)
    sign = F.when(c == "opencv", 1.0).when(c == "opengl", -1.0)
    return outcome(scale(z, F.try_divide(sign, norm(z))), (~is_pose(t), "not a rigid pose"), (sign.isNull(), "unknown camera convention"))


def world_to_camera(p: Column, t: Column) -> Column:
    """(p - centre) in camera axes."""
    d = sub(p, _column(t, 3))
    return F.array(*[dot(d, _column(t, k)) for k in range(3)])


def project(p: Column, t: Column, k: Column) -> Column:
    """struct(u, v, depth); u and v are null at depth zero."""
    c = world_to_camera(p, t)
    ratio = lambda i: F.try_divide(at(c, i), at(c, 2))
    return F.struct(
        (at(at(k, 0), 0) * ratio(0) + at(at(k, 0), 1) * ratio(1) + at(at(k, 0), 2)).alias("u"),
        (at(at(k, 1), 1) * ratio(1) + at(at(k, 1), 2)).alias("v"),
        at(c, 2).alias("depth"),
    )


def in_frustum(p: Column, t: Column, k: Column, height: int, width: int, near: float = 0.1, far: float = 1e4) -> Column:
    """Between near and far and inside the image; false where it can't be told."""
    got = project(p, t, k)
    inside = (got["depth"] > near) & (got["depth"] < far) & finite(got["u"]) & finite(got["v"]) & (got["u"] >= 0) & (got["u"] < width) & (got["v"] >= 0) & (got["v"] < height)
    return F.coalesce(inside & ~F.isnan(got["depth"]), F.lit(False))


def _clamped(x: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))


def relative_direction(target: Column, observer: Column, forward: Column, up: Column, deadzone_deg: Column | float = 10.0) -> Column:
    """value: struct(longitudinal, lateral, vertical, lateral_angle_deg) of a target as an observer sees it.

    Lateral is "ambiguous" strictly inside the dead zone.
    """
    deadzone = deadzone_deg if isinstance(deadzone_deg, Column) else F.lit(float(deadzone_deg))
    d = sub(target, observer)
    far, f, u = norm(d), norm(forward), norm(up)
    right = cross(forward, up)
    r = F.try_divide(dot(d, right), far * norm(right))
    ahead, above = dot(d, forward), dot(d, up)
    angle = F.degrees(F.asin(_clamped(r)))
    value = F.struct(
        F.when(ahead >= 0, "front").otherwise("behind").alias("longitudinal"),
        F.when(F.abs(angle) < deadzone, "ambiguous").when(r > 0, "right").otherwise("left").alias("lateral"),
        F.when(above >= 0, "above").otherwise("below").alias("vertical"),
        angle.alias("lateral_angle_deg"),
    )
    good = is_point(target) & is_point(observer) & is_point(forward) & is_point(up)
    return outcome(
        value,
        (~good, "not finite vectors"),
        (far < TINY, "target at the observer"),
        ((f < TINY) | (u < TINY), "zero direction"),
        (F.try_divide(norm(right), f * u) < TINY, "forward and up are parallel"),
    )


def azimuth_elevation(target: Column, observer: Column, forward: Column, up: Column) -> Column:
    """value: struct(azimuth_deg, elevation_deg); azimuth in (-180, 180], right positive, from forward laid flat."""
    good = is_point(target) & is_point(observer) & is_point(forward) & is_point(up)

    def measured(d: Column, unit: Column, flat: Column) -> Column:
        azimuth = F.degrees(F.atan2(dot(d, cross(flat, unit)), dot(d, flat)))
        value = let(
            azimuth,
            lambda a: F.struct(
                F.when(a <= -180.0, F.lit(180.0)).otherwise(a).alias("azimuth_deg"),
                F.degrees(F.asin(_clamped(F.try_divide(dot(d, unit), norm(d))))).alias("elevation_deg"),
            ),
        )
        return outcome(
            value,
            (~good, "not finite vectors"),
            (norm(d) < TINY, "target at the observer"),
            (norm(up) < TINY, "zero direction"),
            (norm(flat) < TINY, "forward is vertical"),
        )

    unit = scale(up, F.try_divide(F.lit(1.0), norm(up)))
    flat = lambda u: sub(forward, scale(u, dot(forward, u)))
    return let(sub(target, observer), lambda d: let(unit, lambda u: let(flat(u), lambda f: measured(d, u, f))))


def height_difference(target: Column, reference: Column, up: Column) -> Column:
    """Signed, along up."""
    u = norm(up)
    return outcome(
        F.try_divide(dot(sub(target, reference), up), u),
        (~(is_point(target) & is_point(reference) & is_point(up)), "not finite vectors"),
        (u < TINY, "zero direction"),
    )


def back_project(x: Column, y: Column, depth: Column, k: Column, t: Column) -> Column:
    """World point of a pixel at a depth."""
    cx, cy = F.try_divide(x - at(at(k, 0), 2), at(at(k, 0), 0)) * depth, F.try_divide(y - at(at(k, 1), 2), at(at(k, 1), 1)) * depth
    return F.array(*[at(at(t, i), 0) * cx + at(at(t, i), 1) * cy + at(at(t, i), 2) * depth + at(at(t, i), 3) for i in range(3)])


def invert_rigid(t: Column) -> Column:
    """World-from-camera of camera-from-world (3x4 or 4x4): the transposed rotation, and minus it times the translation."""
    rows = [
        F.array(
            *[at(at(t, j), i) for j in range(3)], -reduce(lambda s, j: s + at(at(t, j), i) * at(at(t, j), 3), range(1, 3), at(at(t, 0), i) * at(at(t, 0), 3))
        ) for i in range(3)
    ]
    return F.array(*rows, F.array(*[F.lit(v) for v in (0.0, 0.0, 0.0, 1.0)]))


def box_corners(cx: Column, cy: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """[x0, y0, x1, y1] in pixels of a box given by its centre and size as shares of the image."""
    return F.array((cx - w / 2) * width, (cy - h / 2) * height, (cx + w / 2) * width, (cy + h / 2) * height)


def supports_metric_target(depth_type: Column, domain_calibrated: Column, anchor_verified: Column) -> Column:
    """Whether a depth type can carry absolute metric answers; null for an unknown type."""
    calibrated, verified = F.coalesce(domain_calibrated, F.lit(False)), F.coalesce(anchor_verified, F.lit(False))
    return F.when(depth_type == "metric", calibrated).when(depth_type == "externally_anchored", verified).when(
        depth_type.isin("relative", "affine_invariant", "pseudo"), F.lit(False),
    )
