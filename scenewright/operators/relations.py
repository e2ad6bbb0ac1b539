"""Relations in space between entities with oriented boxes: intersect, contain, support, adjacent, near.

A box is center (vec3), axes (three unit vectors) and extent (full lengths along them). Boxes meet on grid cells of
their own size, never all against all; what is decided about a pair that met is exact.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenewright.functions import geometry as G

#: Sides of grid cells are powers of two between these.
FINEST, COARSEST = -20, 40
#: Cross products shorter than this belong to parallel edges and separate nothing that other axes don't.
PARALLEL = 1e-9


def is_box(center: Column, axes: Column, extent: Column) -> Column:
    """Three finite numbers, three orthonormal axes, no negative length; false, never null."""
    unit = F.forall(axes, lambda a: G.is_point(a) & (F.abs(G.dot(a, a) - 1) < 1e-6))
    square = reduce(lambda c, ij: c & (F.abs(G.dot(G.at(axes, ij[0]), G.at(axes, ij[1]))) < 1e-6), ((0, 1), (0, 2), (1, 2)), F.lit(True))
    return F.coalesce(G.is_point(center) & G.is_point(extent) & (F.size(axes) == 3) & unit & square & F.forall(extent, lambda e: e >= 0), F.lit(False))


def _reach(axes: Column, extent: Column, along: Column) -> Column:
    """Half of a box's length along a direction, which need not be of length 1."""
    return reduce(lambda s, k: s + F.abs(G.dot(G.at(axes, k), along)) * G.at(extent, k), (1, 2), F.abs(G.dot(G.at(axes, 0), along)) * G.at(extent, 0)) / 2


def _upright() -> list[Column]:
    return [G.vec4(*[float(i == k) for k in range(3)]) for i in range(3)]


def upright_extent(center: Column, axes: Column, extent: Column) -> tuple[Column, Column]:
    """Lowest and highest coordinates of a box."""
    reach = F.array(*[_reach(axes, extent, u) for u in _upright()])
    return G.sub(center, reach), G.add(center, reach)


def box_gap(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> Column:
    """The largest distance that any of 18 axes keeps between two boxes (center, axes, extent).

    Fifteen of them, the boxes' axes and the cross products of these, decide whether the boxes have a common point:
    they have if and only if it is at most 0. Where it is positive they are at least so far apart. The three
    coordinate axes are tried too, so it is never less than the distance of the upright extents along any of them.
    """
    (ca, xa, ea), (cb, xb, eb) = a, b
    edges = F.flatten(F.transform(xa, lambda u: F.transform(xb, lambda v: G.cross(u, v))))

    def kept(d: Column, u: Column) -> Column:
        apart = lambda n: F.when(n > PARALLEL, (F.abs(G.dot(u, d)) - _reach(xa, ea, u) - _reach(xb, eb, u)) / n)
        return G.let(G.norm(u), apart)

    return G.let(G.sub(cb, ca), lambda d: F.array_max(F.transform(F.concat(F.array(*_upright()), xa, xb, edges), lambda u: kept(d, u))))


def box_contains(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column], tolerance: float) -> Column:
    """Whether no point of b lies further than tolerance outside of a."""
    (ca, xa, ea), (cb, xb, eb) = a, b
    inside = lambda d: reduce(
        lambda c, k: c & (F.abs(G.dot(G.at(xa, k), d)) + _reach(xb, eb, G.at(xa, k)) <= G.at(ea, k) / 2 + tolerance), range(3), F.lit(True)
    )
    return G.let(G.sub(cb, ca), inside)


def meeting_pairs(boxes: DataFrame, margin: float = 0.0) -> DataFrame:
    """Pairs (scene_id, a, b: structs of the columns of boxes) whose upright extents are at most margin apart, each once.

    boxes: scene_id, entity_id and columns lo, hi. A box stands in the cells of the power of two not below its longest
    side, eight at most, and visits the cells of every coarser size that some box of its scene stands in. So pairs of
    any two sizes meet, a box of a scene's size costs the others one visit each, and a cell is never much larger than
    what stands in it. A pair is taken in the one cell that holds the lowest corner of what both cover.
    """
    of = F.struct(*[F.col(f"`{c}`") for c in boxes.columns])
    side = F.greatest(*[G.at(F.col("hi"), i) - G.at(F.col("lo"), i) for i in range(3)]) + margin
    own = F.greatest(F.lit(FINEST), F.least(F.lit(COARSEST), F.ceil(F.log2(F.greatest(side, F.lit(2.0**FINEST)))))).cast("int")
    low = F.array(*[G.at(F.col("lo"), i) - margin / 2 for i in range(3)])
    high = F.array(*[G.at(F.col("hi"), i) + margin / 2 for i in range(3)])
    rows = boxes.select("scene_id", of.alias("of"), low.alias("low"), high.alias("high"), own.alias("own"))
    sizes = rows.groupBy("scene_id").agg(F.collect_set("own").alias("sizes"))  # at most COARSEST - FINEST + 1 numbers
    rows = rows.join(sizes, "scene_id").withColumn("level", F.explode(F.filter("sizes", lambda s: s >= F.col("own")))).drop("sizes")
    size = F.pow(F.lit(2.0), F.col("level"))
    rows = rows.withColumn("size", size)
    for i, c in enumerate(("cx", "cy", "cz")):
        at = lambda v, i=i: F.floor(G.at(F.col(v), i) / F.col("size")).cast("bigint")
        rows = rows.withColumn(c, F.explode(F.sequence(at("low"), at("high"))))
    cell = ["scene_id", "level", "size", "cx", "cy", "cz"]
    standing = rows.filter("own = level").select(*cell, F.col("of").alias("b"), F.col("low").alias("low_b"), F.col("high").alias("high_b"))
    visiting = rows.select(*cell, "own", F.col("of").alias("a"), F.col("low").alias("low_a"), F.col("high").alias("high_a"))
    met = visiting.join(standing, cell)
    first = (F.col("own") < F.col("level")) | (F.col("a.entity_id") < F.col("b.entity_id"))
    here = reduce(
        lambda c, i: c & (F.floor(F.greatest(G.at(F.col("low_a"), i), G.at(F.col("low_b"), i)) / F.col("size")) == F.col(("cx", "cy", "cz")[i])), range(3), F.lit(True)
    )
    cover = reduce(
        lambda c, i: c & (G.at(F.col("low_a"), i) <= G.at(F.col("high_b"), i)) & (G.at(F.col("low_b"), i) <= G.at(F.col("high_a"), i)), range(3), F.lit(True)
    )
    return met.filter(first & here & cover).select("scene_id", "a", "b")


def bad_boxes(boxes: DataFrame) -> DataFrame:
    """scene_id, entity_id and err of boxes that are none, and of ids that a scene has more than once."""
    again = F.count("*").over(Window.partitionBy("scene_id", "entity_id")) > 1
    err = F.when(F.col("entity_id").isNull(), "no id").when(~is_box(F.col("center"), F.col("axes"), F.col("extent")), "not a box").when(again, "repeated id")
    return boxes.withColumn("err", err).filter("err is not null").select("scene_id", "entity_id", "err")


def spatial_relations(boxes: DataFrame, near: float = 2.0, tolerance: float = 0.05) -> DataFrame:
    """scene_id, relation_type, subject_id, object_id, gap of all pairs of one scene that stand in a relation.

    boxes: scene_id, entity_id, center, axes, extent. gap is that of box_gap().

    intersect: they overlap by more than tolerance. adjacent: they touch, within tolerance. near: they are further
    apart, but gap is at most near. These three exclude each other; the subject is the smaller id. contain: the
    object lies in the subject, within tolerance; so each of two equal boxes contains the other. support: the object
    stands on the subject, its lowest point within tolerance of the subject's highest one and its upright extent over
    the subject's. Boxes that are none (see bad_boxes()) stand in no relation. No boxes: no rows.
    """
    good = boxes.filter(is_box(F.col("center"), F.col("axes"), F.col("extent")) & F.col("entity_id").isNotNull())
    lo, hi = upright_extent(F.col("center"), F.col("axes"), F.col("extent"))
    rows = good.select("scene_id", "entity_id", "center", "axes", "extent", lo.alias("lo"), hi.alias("hi"))
    met = meeting_pairs(rows, max(near, tolerance))
    box = lambda s: (F.col(f"{s}.center"), F.col(f"{s}.axes"), F.col(f"{s}.extent"))
    met = met.withColumn("gap", box_gap(box("a"), box("b")))
    gap = F.col("gap")

    def stands(low: str, up: str) -> Column:
        over = [(G.at(F.col(f"{up}.lo"), i) < G.at(F.col(f"{low}.hi"), i)) & (G.at(F.col(f"{low}.lo"), i) < G.at(F.col(f"{up}.hi"), i)) for i in (0, 1)]
        return (F.abs(G.at(F.col(f"{up}.lo"), 2) - G.at(F.col(f"{low}.hi"), 2)) <= tolerance) & over[0] & over[1]

    kind = F.when(gap < -tolerance, "intersect").when(gap <= tolerance, "adjacent").when(gap <= near, "near")
    a, b = F.col("a.entity_id"), F.col("b.entity_id")
    row = lambda cond, name, s, o: F.when(cond, F.struct(name.alias("relation_type"), s.alias("subject_id"), o.alias("object_id")))
    found = F.array_compact(
        F.array(
            row(kind.isNotNull(), kind, F.least(a, b), F.greatest(a, b)),
            *[row(box_contains(box(s), box(o), tolerance), F.lit("contain"), x, y) for s, o, x, y in (("a", "b", a, b), ("b", "a", b, a))],
            *[row(stands(s, o), F.lit("support"), x, y) for s, o, x, y in (("a", "b", a, b), ("b", "a", b, a))],
        )
    )
    return met.select("scene_id", F.inline(found), "gap")
