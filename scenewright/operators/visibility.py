"""What hides what: points of entities in every view of their scene, and a depth buffer as an aggregate over pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenewright.functions import geometry as G

VIEW = ["scene_id", "frame"]
PIXEL = [*VIEW, "px", "py"]


def seen_points(points: DataFrame, cameras: DataFrame, cell: int = 1, near: float = 0.1) -> DataFrame:
    """scene_id, frame, entity_id, px, py, depth of every point in every image it falls in.

    points: scene_id, entity_id, x, y, z. cameras: scene_id, frame, pose (camera to world), k, height, width. A point
    meets the cameras of its scene only; so rows are points times the views of a scene. Points that aren't finite,
    lie nearer than near or beside the image are in no view. cell: pixels on a side that count as one, for sparse points.
    """
    there = points.filter(G.is_point(F.array("x", "y", "z"))).select("scene_id", "entity_id", F.array("x", "y", "z").alias("p"))
    rows = there.join(cameras.filter(G.is_pose(F.col("pose"))), "scene_id").withColumn("at", G.project(F.col("p"), F.col("pose"), F.col("k")))
    u, v, depth = F.col("at.u"), F.col("at.v"), F.col("at.depth")
    inside = (depth > near) & G.finite(u) & G.finite(v) & (u >= 0) & (u < F.col("width")) & (v >= 0) & (v < F.col("height"))
    return rows.filter(inside).select(*VIEW, "entity_id", *[F.floor(c / cell).cast("bigint").alias(n) for c, n in ((u, "px"), (v, "py"))], depth.alias("depth"))


def depth_buffer(seen: DataFrame) -> DataFrame:
    """PIXEL, nearest depth, and front: the entity it belongs to (of equal depths the smallest id). Rows of a pixel are reduced where they are before they move."""
    nearest = seen.groupBy(*PIXEL).agg(F.min(F.struct("depth", "entity_id")).alias("f"))
    return nearest.select(*PIXEL, F.col("f.depth").alias("front_depth"), F.col("f.entity_id").alias("front"))


def _judged(seen: DataFrame, buffer: DataFrame, tolerance: float) -> DataFrame:
    return seen.join(buffer, PIXEL).withColumn("hidden", (F.col("depth") > F.col("front_depth") + tolerance) & (F.col("entity_id") != F.col("front")))


def visible_from(seen: DataFrame, buffer: DataFrame, tolerance: float = 0.05, least: float = 0.1) -> DataFrame:
    """VIEW, entity_id, n_points, n_visible, share, visible: of an entity's points in a view those that no other
    entity hides by more than tolerance, and whether at least that share of them is to be seen."""
    of = _judged(seen, buffer, tolerance).groupBy(*VIEW, "entity_id").agg(F.count("*").alias("n_points"), F.count_if(~F.col("hidden")).alias("n_visible"))
    share = F.col("n_visible") / F.col("n_points")
    return of.withColumn("share", share).withColumn("visible", share >= least)


def occlusions(seen: DataFrame, buffer: DataFrame, tolerance: float = 0.05, least: float = 0.1) -> DataFrame:
    """VIEW, subject_id (what hides), object_id (what is hidden), n_hidden, share: of the object's points in the view
    those behind the subject, where that is at least the share least of them."""
    judged = _judged(seen, buffer, tolerance)
    hidden = judged.filter("hidden").groupBy(*VIEW, F.col("front").alias("subject_id"), "entity_id").agg(F.count("*").alias("n_hidden"))
    all_of = seen.groupBy(*VIEW, "entity_id").agg(F.count("*").alias("n_points"))
    out = hidden.join(all_of, [*VIEW, "entity_id"]).withColumn("share", F.col("n_hidden") / F.col("n_points")).filter(F.col("share") >= least)
    return out.select(*VIEW, "subject_id", F.col("entity_id").alias("object_id"), "n_hidden", "share")
