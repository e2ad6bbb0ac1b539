"""Named queries over the driver's tables and, where SQL can express them, the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scenewright.functions import geometry as G
from scenewright.functions import text as T
from scenewright.operators import entities, grading, scenes, state, validate
from scenewright.plans import answers, compiler, leakage, render, specs
from scenewright.sources import readers
from scenewright.sources import views as V

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
EYE, AHEAD, UP = V.OBSERVER, (1.0, 0.0, 0.0), (0.0, 0.0, 1.0)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def xyz() -> Column:
    return F.array("x", "y", "z")


def task_specs() -> list[specs.Spec]:
    return specs.load_all(set(compiler.PROGRAMS), compiler.CHECKERS)


# --- catalogue, pairing, windows ---

_RUN = "regexp_extract(run, '^interval5_([A-Za-z]+?)(?:_GNSS)?(?:_Evening)?(\\d*)$', 1)"
_PAIRED = f"""paired AS (SELECT i.run, i.stem, i.ts_ns, l.lidar_ns, b.path AS label_path FROM (
  SELECT split_part(path, '/', 2) AS run, replace(split_part(path, '/', 4), '.jpg', '') AS stem,
    CAST(split_part(replace(split_part(path, '/', 4), '.jpg', ''), '.', 1) AS BIGINT)*1000000000 + CAST(split_part(replace(split_part(path, '/', 4), '.jpg', ''), '.',
      2) AS BIGINT) AS ts_ns
  FROM v_members WHERE path LIKE '%/interval5_CAM/%.jpg') i
  LEFT JOIN (SELECT split_part(path, '/', 2) AS run, regexp_extract(path, 'image([\\d.]+)_lidar', 1) AS stem,
    max(CAST(replace(regexp_extract(path, '_lidar([\\d.]+)\\.txt', 1), '.', '') AS BIGINT)) AS lidar_ns FROM v_members WHERE path LIKE '%/interval5_LIDAR/%'
      GROUP BY ALL) l ON i.run = l.run AND i.stem = l.stem
  LEFT JOIN (SELECT DISTINCT path FROM v_members WHERE archive = 'interval5_CAM_label') b ON b.path = 'interval5_CAM_label/' || i.run || '/interval5_CAM_label_id/' ||
    i.stem || '.png')"""


@query(
    V.with_views(
        f"SELECT run, CASE WHEN {_RUN} <> '' THEN {_RUN} END AS split_group FROM (SELECT DISTINCT split_part(path, '/', 2) AS run FROM v_members "
            f"WHERE archive = 'interval5_CAM_LIDAR')",
        "members",
    )
)
def s2_runs(spark: SparkSession, sf: str) -> DataFrame:
    return scenes.runs(V.members(spark, sf))


@query(V.with_views(f", {_PAIRED} SELECT run, stem, ts_ns, coalesce(lidar_ns, -1) AS lidar_ns, label_path FROM paired", "members"))
def s6_paired_frames(spark: SparkSession, sf: str) -> DataFrame:
    return scenes.pair_frames(V.members(spark, sf)).select(
        "run", "stem", "ts_ns", F.coalesce("lidar_ns", F.lit(-1).cast("bigint")).alias("lidar_ns"), "label_path",
    )


@query(
    V.with_views(
        f", {_PAIRED} SELECT run, count(*) AS requested, count(*) FILTER (lidar_ns IS NULL) AS missing_lidar, "
            f"count(*) FILTER (label_path IS NULL) AS missing_label, bool_or(label_path IS NOT NULL) AS has_labels FROM paired GROUP BY run",
        "members",
    )
)
def a27_ingest_report(spark: SparkSession, sf: str) -> DataFrame:
    return scenes.ingest_report(scenes.pair_frames(V.members(spark, sf)))


@query("SELECT c_mktsegment AS run, c_nationkey AS stem, max(c_custkey) AS pos, arg_max(c_name, c_custkey) AS name FROM customer GROUP BY ALL")
def s3_last_pose(spark: SparkSession, sf: str) -> DataFrame:
    rows = V.table(spark, sf, "customer").select(
        F.col("c_mktsegment").alias("run"), F.col("c_nationkey").alias("stem"), F.col("c_custkey").alias("pos"), F.col("c_name").alias("name"),
    )
    return scenes.last_pose(rows).select("run", "stem", "pose.pos", "pose.name")


def _windows_sql(step: int, length: int = 50, least: int = 20) -> str:
    return V.with_views(
        f""", r AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY ts_ns, frame_id) - 1 AS n, count(*) OVER (PARTITION BY run) AS total FROM v_frames),
  w AS (SELECT r.*, k AS scene_index FROM r, unnest(range(0, r.n // {step} + 1)) AS u(k) WHERE n < k*{step} + {length} AND least({length}, total - k*{step}) >= {least}),
  sc AS (SELECT run, CAST(scene_index AS BIGINT) AS scene_index, count(*) AS n_frames, min(ts_ns) AS first_ns, max(ts_ns) AS last_ns,
    round((max(ts_ns) - min(ts_ns))/1e9, 3) AS duration_s FROM w GROUP BY ALL)""",
        "frames",
    )


@query(_windows_sql(50) + " SELECT * FROM sc")
def w1_scene_windows(spark: SparkSession, sf: str) -> DataFrame:
    return scenes.scenes(scenes.scene_windows(V.frames(spark, sf)))


@query(_windows_sql(20) + " SELECT * FROM sc")
def w2_sliding_windows(spark: SparkSession, sf: str) -> DataFrame:
    return scenes.scenes(scenes.scene_windows(V.frames(spark, sf), stride=20))


@query(_windows_sql(80) + " SELECT * FROM sc WHERE scene_index = 3")
def w3_window_by_index(spark: SparkSession, sf: str) -> DataFrame:
    return scenes.scenes(scenes.scene_windows(V.frames(spark, sf), stride=80).filter("scene_index = 3"))


@query(
    _windows_sql(50) +
        " SELECT s.run, s.scene_index, count(*) AS n_rows, round(max(f.value) - min(f.value), 3) AS value_span FROM v_frames f "
        "JOIN sc s ON f.run = s.run AND f.ts_ns BETWEEN s.first_ns AND s.last_ns GROUP BY ALL"
)
def j4_track_in_scenes(spark: SparkSession, sf: str) -> DataFrame:
    """A run's own track only, though runs overlap in time."""
    track = V.frames(spark, sf).select("run", "ts_ns", "value")
    found = scenes.rows_in_scenes(track, scenes.scenes(scenes.scene_windows(V.frames(spark, sf))))
    return scenes.span(found, ["run", "scene_index"], ["value"])


@query(
    "SELECT user_id % 7 AS k, CAST(x.sec AS BIGINT)*1000000000 + CAST(rpad(x.frac, 9, '0') AS BIGINT) AS ns FROM (SELECT user_id, "
        "CAST(event_id AS VARCHAR) AS sec, substr(lpad(CAST(user_id AS VARCHAR), 3, '0'), 1, 3) AS frac FROM events) x"
)
def s9_nanoseconds(spark: SparkSession, sf: str) -> DataFrame:
    stamp = F.concat(F.col("event_id").cast("string"), F.lit("."), F.substring(F.lpad(F.col("user_id").cast("string"), 3, "0"), 1, 3))
    return V.table(spark, sf, "events").select((F.col("user_id") % 7).alias("k"), T.ns_of(stamp).alias("ns"))


# --- geometry over objects ---


@query(
    V.with_views(
        """, d AS (SELECT *, sqrt(x*x + y*y + (z-30)*(z-30)) AS d FROM v_objects), r AS (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY d DESC, pos) AS k,
          count(*) OVER (PARTITION BY scene_id) AS n FROM d)
  SELECT scene_id, max(object_id) FILTER (k = 1) AS object_id, max(n) AS n_candidates,
    abs(max(d) FILTER (k = 1) - max(d) FILTER (k = 2)) < 0.05*greatest(max(d) FILTER (k = 1), 1e-9) AS is_ambiguous FROM r WHERE n >= 3 GROUP BY scene_id""",
        "objects",
    )
)
def d3_farthest_object(spark: SparkSession, sf: str) -> DataFrame:
    """The object of each scene that lies farthest from the observer, and whether the runner-up is too close to tell."""
    o = V.objects(spark, sf).withColumn("d", G.distance(xyz(), G.vec(*EYE)))
    w = Window.partitionBy("scene_id")  # scenes hold at most 500 objects
    o = o.withColumn("k", F.row_number().over(w.orderBy(F.desc("d"), "pos"))).withColumn("n", F.count("*").over(w)).filter("n >= 3 and k <= 2")
    first, second = F.max(F.when(F.col("k") == 1, F.col("d"))), F.max(F.when(F.col("k") == 2, F.col("d")))
    return o.groupBy("scene_id").agg(
        F.max(F.when(F.col("k") == 1, F.col("object_id"))).alias("object_id"),
        F.max("n").alias("n_candidates"),
        (F.abs(first - second) < 0.05 * F.greatest(first, F.lit(1e-9))).alias("is_ambiguous"),
    )


_SEG = """, s AS (SELECT scene_id, pos, i, x AS ax, y AS ay, z AS az, lead(x) OVER w AS bx, lead(y) OVER w AS by_, lead(z) OVER w AS bz
    FROM v_points WINDOW w AS (PARTITION BY pos ORDER BY i)),
  t AS (SELECT *, greatest(0.0, least(1.0, ((0-ax)*(bx-ax) + (0-ay)*(by_-ay) + (30-az)*(bz-az)) / ((bx-ax)**2 + (by_-ay)**2 + (bz-az)**2))) AS t FROM s
    WHERE bx IS NOT NULL),
  g AS (SELECT scene_id, pos, i, sqrt((ax+t*(bx-ax))**2 + (ay+t*(by_-ay))**2 + (30-az-t*(bz-az))**2) AS d FROM t),
  l AS (SELECT scene_id, pos, min(d) AS d, arg_min(i, d) AS seg FROM g GROUP BY ALL)"""


@query(V.with_views(_SEG + " SELECT scene_id, pos, round(d, 6) AS d, seg FROM l", "points"))
def g2_point_to_polyline(spark: SparkSession, sf: str) -> DataFrame:
    r = G.point_to_polyline(G.vec(*EYE), F.col("line"))
    return V.polylines(spark, sf).withColumn("r", r).select(
        "scene_id", "pos", F.round("r.value.d", 6).alias("d"), F.col("r.value.seg").cast("bigint").alias("seg"),
    )


@query(V.with_views(_SEG + " SELECT scene_id, arg_min(pos, d) AS pos, round(min(d), 6) AS d FROM l GROUP BY scene_id", "points"))
def g3_nearest_polyline(spark: SparkSession, sf: str) -> DataFrame:
    """Distances are made row by row; only the best of each scene travels."""
    r = G.point_to_polyline(G.vec(*EYE), F.col("line"))
    rows = V.polylines(spark, sf).select("scene_id", "pos", r.alias("r"))
    return rows.groupBy("scene_id").agg(F.min(F.struct("r.value.d", "pos")).alias("b")).select("scene_id", "b.pos", F.round("b.d", 6).alias("d"))


@query(
    V.with_views(
        ", s AS (SELECT p.pos, p.x AS px, p.y AS py, p.z AS pz, q.x AS ax, q.y AS ay, q.z AS az, r.x AS bx, r.y AS by_, r.z AS bz FROM v_points p "
            "JOIN v_points q ON p.pos = q.pos AND q.i = 1 JOIN v_points r ON p.pos = r.pos AND r.i = 2 WHERE p.i = 0), t AS (SELECT *, greatest(0.0, least(1.0, "
            "((px-ax)*(bx-ax) + (py-ay)*(by_-ay) + (pz-az)*(bz-az)) / ((bx-ax)**2 + (by_-ay)**2 + (bz-az)**2))) AS t FROM s) SELECT pos, "
            "round(sqrt((px-ax-t*(bx-ax))**2 + (py-ay-t*(by_-ay))**2 + (pz-az-t*(bz-az))**2), 6) AS d, CAST(NULL AS VARCHAR) AS err FROM t",
        "points",
    )
)
def g1_point_to_segment(spark: SparkSession, sf: str) -> DataFrame:
    at = lambda i: F.get("line", F.lit(i))
    return V.polylines(spark, sf).withColumn("r", G.point_to_segment(at(0), at(1), at(2))).select("pos", F.round("r.value", 6).alias("d"), "r.err")


@query(
    V.with_views(
        " SELECT a.pos, round(min(sqrt((a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2)), 6) AS d FROM v_points a JOIN v_points b ON b.pos = a.pos + 1 GROUP BY a.pos",
        "points",
    )
)
def g4_pairwise_min(spark: SparkSession, sf: str) -> DataFrame:
    """Each object against the next one by number; both sides are 21 points."""
    line = V.polylines(spark, sf)
    nxt = line.select((F.col("pos") - 1).alias("pos"), F.col("line").alias("other"))
    return line.join(nxt, "pos").withColumn("r", G.pairwise_min(F.col("line"), F.col("other"))).select("pos", F.round("r.value", 6).alias("d"))


@query(
    V.with_views(
        """, d AS (SELECT scene_id, object_id, x AS ahead, -y AS r, z - 30 AS above, sqrt(x*x + y*y + (z-30)**2) AS far FROM v_objects),
  a AS (SELECT *, degrees(asin(greatest(-1.0, least(1.0, r/far)))) AS angle FROM d)
  SELECT scene_id, object_id, CASE WHEN ahead >= 0 THEN 'front' ELSE 'behind' END AS longitudinal,
    CASE WHEN abs(angle) < 10 THEN 'ambiguous' WHEN r > 0 THEN 'right' ELSE 'left' END AS lateral,
    CASE WHEN above >= 0 THEN 'above' ELSE 'below' END AS vertical, round(angle, 6) AS lateral_angle_deg FROM a""",
        "objects",
    )
)
def g10_relative_direction(spark: SparkSession, sf: str) -> DataFrame:
    r = G.relative_direction(xyz(), G.vec(*EYE), G.vec(*AHEAD), G.vec(*UP))
    return V.objects(spark, sf).withColumn("r", r).select(
        "scene_id",
        "object_id",
        "r.value.longitudinal",
        "r.value.lateral",
        "r.value.vertical",
        F.round("r.value.lateral_angle_deg", 6).alias("lateral_angle_deg"),
    )


@query(
    V.with_views(
        " SELECT object_id, round(degrees(atan2(-y, x)), 6) AS azimuth_deg, round(degrees(asin((z-30)/sqrt(x*x + y*y + (z-30)**2))), 6) AS elevation_deg FROM v_objects",
        "objects",
    )
)
def g11_azimuth_elevation(spark: SparkSession, sf: str) -> DataFrame:
    r = G.azimuth_elevation(xyz(), G.vec(*EYE), G.vec(*AHEAD), G.vec(*UP))
    return V.objects(spark, sf).withColumn("r", r).select(
        "object_id", F.round("r.value.azimuth_deg", 6).alias("azimuth_deg"), F.round("r.value.elevation_deg", 6).alias("elevation_deg"),
    )


@query(V.with_views(" SELECT object_id, round(z - 30, 6) AS height FROM v_objects", "objects"))
def g12_height_difference(spark: SparkSession, sf: str) -> DataFrame:
    return V.objects(spark, sf).withColumn(
        "r", G.height_difference(xyz(), G.vec(*EYE), G.vec(0, 0, 2)),
    ).select("object_id", F.round("r.value", 6).alias("height"))


def _poses(spark: SparkSession, sf: str) -> DataFrame:
    """A pose for each supplier: turned about z by its balance, 5 behind the origin; every 11th isn't rigid."""
    c, s = G.at(F.col("turn"), 0), G.at(F.col("turn"), 1)
    bad = F.when(F.col("s_suppkey") % 11 == 0, 2.0).otherwise(1.0)
    t = F.array(
        F.array(c * bad, -s, F.lit(0.0), F.col("s_suppkey").cast("double")),
        F.array(s, c, F.lit(0.0), F.lit(2.0)),
        F.array(F.lit(0.0), F.lit(0.0), bad, F.lit(-5.0)),  # bad here too: a quarter turn has no cosine to spoil
        G.vec4(0, 0, 0, 1),
    )
    turned = V.table(spark, sf, "supplier").select("s_suppkey", "s_acctbal", G.cos_sin(F.radians("s_acctbal")).alias("turn"))
    return turned.select("s_suppkey", "s_acctbal", t.alias("t"))


@query(
    "SELECT s_suppkey, CASE WHEN s_suppkey % 11 <> 0 THEN CAST(s_suppkey AS DOUBLE) END AS cx, "
        "CASE WHEN s_suppkey % 11 <> 0 THEN CAST(-1.0 AS DOUBLE) END AS gl_forward_z, CASE WHEN s_suppkey % 11 = 0 THEN 'not a rigid pose' END AS err, "
        "round(-(cos(radians(s_acctbal))*s_suppkey*CASE WHEN s_suppkey % 11 = 0 THEN 2.0 ELSE 1.0 END + sin(radians(s_acctbal))*2), 6) AS inverse_x FROM supplier"
)
def g5_pose_parts(spark: SparkSession, sf: str) -> DataFrame:
    p = _poses(spark, sf).withColumns({"c": G.camera_center(F.col("t")), "f": G.camera_forward(F.col("t"), "opengl"), "i": G.invert_rigid(F.col("t"))})
    return p.select(
        "s_suppkey",
        F.get("c.value", F.lit(0)).alias("cx"),
        F.get("f.value", F.lit(2)).alias("gl_forward_z"),
        "c.err",
        G.rounded(F.get(F.get("i", F.lit(0)), F.lit(3)), 6).alias("inverse_x"),
    )


_K = "array(array(100D, 0D, 50D), array(0D, 100D, 40D), array(0D, 0D, 1D))"


@query(
    V.with_views(
        ", c AS (SELECT pos, x, y, z + 25 AS d FROM v_points), p AS (SELECT pos, d, CASE WHEN d <> 0 THEN 100*x/d + 50 END AS u, "
            "CASE WHEN d <> 0 THEN 100*y/d + 40 END AS v FROM c) SELECT pos, round(avg(CASE WHEN d > 0.1 AND d < 10000 AND u >= 0 AND u < 100 AND v >= 0 AND v < 80 "
            "THEN 1.0 ELSE 0.0 END), 6) AS visible_ratio, round(min(u), 4) AS min_u, round(max(v), 4) AS max_v FROM p GROUP BY pos",
        "points",
    )
)
def a4_visible_ratio(spark: SparkSession, sf: str) -> DataFrame:
    """Points of each object through a camera 25 behind the origin that looks along z."""
    pose = F.array(G.vec4(1, 0, 0, 0), G.vec4(0, 1, 0, 0), G.vec4(0, 0, 1, -25), G.vec4(0, 0, 0, 1))
    rows = V.points(spark, sf).select("pos", G.project(xyz(), pose, F.expr(_K)).alias("p"), G.in_frustum(xyz(), pose, F.expr(_K), 80, 100).alias("seen"))
    return rows.groupBy("pos").agg(
        F.round(F.avg(F.col("seen").cast("double")), 6).alias("visible_ratio"), F.round(F.min("p.u"), 4).alias("min_u"), F.round(F.max("p.v"), 4).alias("max_v"),
    )


@query(
    V.with_views(
        " SELECT pos, count(*) AS n, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy, round(avg(z), 6) AS cz, round(min(x), 6) AS min_x, round(max(x), "
            "6) AS max_x, round(min(y), 6) AS min_y, round(max(y), 6) AS max_y, round(min(z), 6) AS min_z, round(max(z), 6) AS max_z FROM v_points GROUP BY pos",
        "points",
    )
)
def a1_centroid_box(spark: SparkSession, sf: str) -> DataFrame:
    s = entities.point_statistics(V.points(spark, sf), ["pos"])
    return s.select("pos", "n", *[F.round(c, 6).alias(c) for c in ("cx", "cy", "cz", "min_x", "max_x", "min_y", "max_y", "min_z", "max_z")])


@query(
    V.with_views(
        """, c AS (SELECT pos, var_samp(x) AS a, var_samp(y) AS b, var_samp(z) AS c, covar_samp(x, y) AS d, covar_samp(x, z) AS e, covar_samp(y, z) AS f FROM v_points
          GROUP BY pos),
  q AS (SELECT *, (a+b+c)/3 AS q, d*d+e*e+f*f AS p1 FROM c), r AS (SELECT *, sqrt(((a-q)**2 + (b-q)**2 + (c-q)**2 + 2*p1)/6) AS p FROM q),
  t AS (SELECT *, acos(greatest(-1.0, least(1.0, (((a-q)/p)*(((b-q)/p)*((c-q)/p) - (f/p)*(f/p)) - (d/p)*((d/p)*((c-q)/p) - (f/p)*(e/p)) + (e/p)*((d/p)*(f/p) -
    ((b-q)/p)*(e/p)))/2)))/3 AS phi FROM r)
  SELECT pos, round(q + 2*p*cos(phi), 4) AS v0, round(3*q - (q + 2*p*cos(phi)) - (q + 2*p*cos(phi + 2*pi()/3)), 4) AS v1, round(q + 2*p*cos(phi + 2*pi()/3), 4) AS v2
    FROM t""",
        "points",
    )
)
def a3_oriented_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """The SQL finds the variances by the cubic formula; the tests hold extents and axes."""
    b = entities.oriented_boxes(V.points(spark, sf), ["pos"])
    return b.select("pos", *[F.round(F.get("variances", F.lit(k)), 4).alias(f"v{k}") for k in range(3)])


@query(
    V.with_views(
        " SELECT object_id, round((ex - ez/2)*200, 6) AS x0, round((ey - ez/2)*100, 6) AS y0, round((ex + ez/2)*200, 6) AS x1, round((ey + ez/2)*100, 6) AS y1 "
            "FROM v_objects",
        "objects",
    )
)
def g20_box_corners(spark: SparkSession, sf: str) -> DataFrame:
    b = G.box_corners(F.col("ex"), F.col("ey"), F.col("ez"), F.col("ez"), F.lit(200), F.lit(100))
    return V.objects(spark, sf).withColumn("b", b).select(
        "object_id", *[F.round(F.get("b", F.lit(i)), 6).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))]
    )


@query(
    "SELECT s, c, v, CASE s WHEN 'metric' THEN c WHEN 'externally_anchored' THEN v WHEN 'relative' THEN false END AS ok, n "
        "FROM (SELECT (['metric','externally_anchored','relative','odd'])[p_partkey % 4 + 1] AS s, p_size % 2 = 0 AS c, p_partkey % 3 = 0 AS v, count(*) AS n "
        "FROM part GROUP BY ALL)"
)
def p6_metric_eligibility(spark: SparkSession, sf: str) -> DataFrame:
    kinds = F.array(*[F.lit(x) for x in ("metric", "externally_anchored", "relative", "odd")])
    rows = V.table(spark, sf, "part").select(
        F.element_at(kinds, (F.col("p_partkey") % 4 + 1).cast("int")).alias("s"),
        (F.col("p_size") % 2 == 0).alias("c"),
        (F.col("p_partkey") % 3 == 0).alias("v"),
    ).groupBy("s", "c", "v").agg(F.count("*").alias("n"))
    return rows.select("s", "c", "v", G.supports_metric_target(F.col("s"), F.col("c"), F.col("v")).alias("ok"), "n")


# --- pixels to objects ---

_STATS = """, f AS (SELECT scene_id, quantile_cont(conf, 0.25) AS conf_floor FROM v_pixels GROUP BY scene_id)"""


@query(
    V.with_views(
        _STATS +
            " SELECT p.scene_id, f.conf_floor, count(*) AS n_pixels, round(avg(CASE WHEN conf > conf_floor THEN 1.0 ELSE 0.0 END), 6) AS coverage, "
            "round(avg(CASE WHEN depth > 0 THEN 0.0 ELSE 1.0 END), 6) AS invalid_ratio, round(quantile_cont(depth, 0.5), 6) AS median_depth FROM v_pixels p "
            "JOIN f USING (scene_id) GROUP BY ALL",
        "pixels",
    )
)
def a8_depth_statistics(spark: SparkSession, sf: str) -> DataFrame:
    s = entities.depth_statistics(V.pixels(spark, sf))
    return s.select("scene_id", "conf_floor", "n_pixels", *[F.round(c, 6).alias(c) for c in ("coverage", "invalid_ratio", "median_depth")])


@query(
    V.with_views(
        _STATS + " SELECT scene_id, class_id, count(*) AS n FROM v_pixels JOIN f USING (scene_id) WHERE class_id <> 0 AND depth > 0 AND conf >= conf_floor GROUP BY ALL",
        "pixels",
    )
)
def p8_kept_pixels(spark: SparkSession, sf: str) -> DataFrame:
    p = V.pixels(spark, sf)
    return entities.kept_pixels(p, entities.depth_statistics(p), [0]).groupBy("scene_id", "class_id").agg(F.count("*").alias("n"))


_REACH = """, e AS (SELECT frame, class_id, y*20 + x AS id, y, x FROM v_pixels),
  n AS (SELECT a.frame, a.class_id, a.id AS a, b.id AS b FROM e a JOIN e b ON a.frame = b.frame AND a.class_id = b.class_id AND abs(a.y - b.y) + abs(a.x - b.x) <= 1),
  r AS (SELECT frame, class_id, a, b FROM n UNION SELECT r.frame, r.class_id, r.a, n.b FROM r JOIN n ON r.frame = n.frame AND r.class_id = n.class_id AND r.b = n.a),
  m AS (SELECT frame, class_id, a AS id, min(b) AS first FROM r GROUP BY ALL), c AS (SELECT *, dense_rank() OVER (PARTITION BY frame,
    class_id ORDER BY first) - 1 AS component FROM m)"""


@query(V.with_views(_REACH + " SELECT frame, class_id, component, count(*) AS n_pixels, min(id) AS first FROM c GROUP BY ALL", "pixels", recursive=True))
def e3_components(spark: SparkSession, sf: str) -> DataFrame:
    return entities.components(V.pixels(spark, sf).select("frame", "class_id", "y", "x")).groupBy("frame", "class_id", "component").agg(
        F.count("*").alias("n_pixels"), F.min(F.col("y") * V.SIDE + F.col("x")).alias("first"),
    )


def _lifted(spark: SparkSession, sf: str) -> DataFrame:
    """Pixels with components and world points through a camera at the origin."""
    p = entities.components(V.pixels(spark, sf))
    pose = F.array(G.vec4(1, 0, 0, 1), G.vec4(0, 1, 0, 2), G.vec4(0, 0, 1, 3), G.vec4(0, 0, 0, 1))
    world = G.back_project(F.col("x"), F.col("y"), F.col("depth"), F.expr("array(array(20D, 0D, 10D), array(0D, 20D, 10D), array(0D, 0D, 1D))"), pose)
    return p.withColumn("w", world).select("*", *[F.get("w", F.lit(i)).alias(f"p{c}") for i, c in enumerate("xyz")]).drop("w")


@query(
    V.with_views(
        _REACH + """, f AS (SELECT scene_id, quantile_cont(conf, 0.25) AS conf_floor, max(conf) AS top FROM v_pixels GROUP BY scene_id),
  w AS (SELECT p.*, c.component, f.conf_floor, f.top, (p.x - 10)/20.0*depth + 1 AS px, (p.y - 10)/20.0*depth + 2 AS py, depth + 3 AS pz, p.conf >= f.conf_floor AS good
    FROM v_pixels p JOIN c ON p.frame = c.frame AND p.class_id = c.class_id AND p.y*20 + p.x = c.id JOIN f ON p.scene_id = f.scene_id)
  SELECT frame, class_id, component, count(*) AS n_pixels, count(*) FILTER (good) AS n_points, round(avg(px) FILTER (good), 3) AS cx, round(max(pz) FILTER (good),
    3) AS max_z, round(avg(conf) FILTER (good)/(max(top) + 1e-9), 3) AS confidence FROM w GROUP BY ALL HAVING count(*) >= 5 AND count(*) FILTER (good) >= 3""",
        "pixels",
        recursive=True,
    )
)
def a5_objects_of_components(spark: SparkSession, sf: str) -> DataFrame:
    o = entities.objects_of(_lifted(spark, sf), entities.depth_statistics(V.pixels(spark, sf)), 5, 3)
    return o.select("frame", "class_id", "component", "n_pixels", "n_points", *[F.round(c, 3).alias(c) for c in ("cx", "max_z", "confidence")])


_NEAR_FIRST = "sqrt((o.x - rest[1].x)**2 + (o.y - rest[1].y)**2 + (o.z - rest[1].z)**2) <= threshold"


@query(
    V.with_views(
        f""", size AS (SELECT scene_id, sqrt((max(x)-min(x))**2 + (max(y)-min(y))**2 + (max(z)-min(z))**2) AS s FROM v_objects GROUP BY scene_id),
  g AS (SELECT o.scene_id, category, CASE WHEN max(s) > 0 THEN max(s)*0.25 ELSE 1.0 END AS threshold,
    list({{'pos': pos, 'x': x, 'y': y, 'z': z, 'n': point_count}} ORDER BY pos) AS rest
    FROM v_objects o JOIN size ON o.scene_id = size.scene_id GROUP BY o.scene_id, category),
  r AS (SELECT scene_id, category, threshold, rest, rest[:0] AS taken FROM g
    UNION ALL SELECT scene_id, category, threshold, list_filter(rest, lambda o: o.pos <> rest[1].pos AND NOT ({_NEAR_FIRST})), list_filter(rest,
      lambda o: o.pos = rest[1].pos OR {_NEAR_FIRST}) FROM r WHERE len(rest) > 0)
  SELECT scene_id, category, taken[1].pos AS seed, format('<obj_{{:03d}}>', row_number() OVER (PARTITION BY scene_id ORDER BY taken[1].pos)) AS object_id,
    CAST(list_sum(list_transform(taken, lambda o: o.n)) AS BIGINT) AS point_count,
    CAST(len(taken) AS INTEGER) AS n_merged, array_to_string(list_transform(taken, lambda o: CAST(o.pos AS VARCHAR)), ',') AS merged_from FROM r WHERE len(taken) > 0""",
        "objects",
        recursive=True,
    )
)
def a6_merge_objects(spark: SparkSession, sf: str) -> DataFrame:
    """Greedy and dependent on order: the SQL takes the first object left, and all near it, again and again."""
    o = V.objects(spark, sf).withColumns(
        {"frame": F.col("pos") % 5, "lo": F.array(*[F.col(c) - F.col(f"e{c}") for c in "xyz"]), "hi": F.array(*[F.col(c) + F.col(f"e{c}") for c in "xyz"])}
    )
    return entities.merge_objects(o).select(
        "scene_id",
        "category",
        "seed",
        "object_id",
        "point_count",
        F.size("merged_from").alias("n_merged"),
        F.array_join(F.transform("merged_from", lambda x: x.cast("string")), ",").alias("merged_from"),
    )


@query(
    V.with_views(
        " SELECT a.scene_id, a.category, a.pos AS a, b.pos AS b, round(sqrt((a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2), 6) AS distance FROM v_objects a "
            "JOIN v_objects b ON a.scene_id = b.scene_id AND a.category = b.category AND a.pos < b.pos WHERE sqrt((a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2) <= 10",
        "objects",
    )
)
def j11_close_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return entities.close_pairs(V.objects(spark, sf), 10.0).withColumn("distance", F.round("distance", 6))


_VOTES = """, v AS (SELECT m.instance_id, p.class_id, count(*) AS votes FROM v_masks m
    JOIN v_pixels p ON p.frame = m.frame AND p.y BETWEEN m.y0 AND m.y1 AND p.x BETWEEN m.x0 AND m.x1 WHERE p.class_id <> 0 GROUP BY ALL),
  w AS (SELECT *, row_number() OVER (PARTITION BY instance_id ORDER BY votes DESC, class_id) AS k, sum(votes) OVER (PARTITION BY instance_id) AS n FROM v)"""


@query(
    V.with_views(
        _VOTES + " SELECT instance_id, class_id, votes, CAST(n AS BIGINT) AS n_votes, round(votes/n, 4) AS purity FROM w WHERE k = 1 AND round(votes/n, 4) >= 0.6",
        "masks",
        "pixels",
    )
)
def e5_fused_instances(spark: SparkSession, sf: str) -> DataFrame:
    return entities.fuse_instances(V.masks(spark, sf), V.pixels(spark, sf), [0], 0.6)


@query(
    V.with_views(
        _VOTES +
            " SELECT label, count(*) AS n, round(quantile_cont(p, 0.5), 6) AS median_purity, round(quantile_cont(p, 0.25), 6) AS p25_purity, "
            "round(avg(CASE WHEN p < 0.6 THEN 1.0 ELSE 0.0 END), 6) AS low_share FROM (SELECT w.instance_id, round(votes/n, 4) AS p, m.label FROM w "
            "JOIN v_masks m USING (instance_id) WHERE k = 1) GROUP BY label",
        "masks",
        "pixels",
    )
)
def a17_purity_report(spark: SparkSession, sf: str) -> DataFrame:
    m = V.masks(spark, sf)
    f = entities.fuse_instances(m, V.pixels(spark, sf), [0]).join(m.select("instance_id", "label"), "instance_id")
    f = readers.materialized(f.select("label", "purity"))
    shares = f.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg((F.col("purity") < 0.6).cast("double")), 6).alias("low_share"))
    for name, share in (("median_purity", 0.5), ("p25_purity", 0.25)):
        shares = shares.join(entities.exact_percentile(f, ["label"], "purity", share, name).withColumn(name, F.round(name, 6)), "label")
    return shares


@query(
    "SELECT CAST(l_suppkey % 7 AS BIGINT) AS k, round(sqrt((max(l_quantity) - min(l_quantity))**2 + (max(l_discount) - min(l_discount))**2 + (max(l_tax) - "
        "min(l_tax))**2), 6) AS span FROM lineitem GROUP BY ALL"
)
def a10_camera_span(spark: SparkSession, sf: str) -> DataFrame:
    rows = V.table(spark, sf, "lineitem").select(
        (F.col("l_suppkey") % 7).alias("k"), F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"), F.col("l_tax").alias("z"),
    )
    return entities.camera_span(rows, ["k"]).withColumn("span", F.round("span", 6))


_CASES = " ".join(f"WHEN regexp_matches(lower(label), '\\b(?:{'|'.join(keys)})') THEN '{name}'" for name, keys in T.CLASS_KEYWORDS)


@query(
    f"SELECT label, category, count(*) AS n FROM (SELECT label, CASE {_CASES} ELSE 'other' END AS category "
        f"FROM (SELECT {V._LABEL_LIST}[p_partkey % {len(V.LABELS)} + 1] AS label FROM part)) GROUP BY ALL"
)
def f1_canonical_classes(spark: SparkSession, sf: str) -> DataFrame:
    rows = V.table(spark, sf, "part").select(V.labels_of(F.col("p_partkey")).alias("label"))
    return rows.groupBy("label").agg(F.count("*").alias("n")).select("label", T.canonical_class(F.col("label")).alias("category"), "n")


@query(V.with_views(" SELECT category, n_views, count(*) AS n FROM v_objects GROUP BY ALL ORDER BY n DESC, category, n_views LIMIT 10", "objects"))
def a16_top_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return V.objects(spark, sf).groupBy("category", "n_views").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category", "n_views").limit(10)


@query(V.with_views(f" SELECT frame, {V._CLASS_LIST}[class_id + 1] AS category, count(*) AS n FROM v_pixels GROUP BY ALL", "pixels"))
def j15_relabel(spark: SparkSession, sf: str) -> DataFrame:
    return entities.relabel(V.pixels(spark, sf), T.CLASSES).groupBy("frame", "category").agg(F.count("*").alias("n"))


@query(
    V.with_views(
        " SELECT frame, CAST(a.i AS BIGINT) AS y, CAST(b.i AS BIGINT) AS x, class_id FROM v_pixels p JOIN unnest(range(0, "
            "8)) AS a(i) ON floor((a.i + 0.5)*20/8) = p.y JOIN unnest(range(0, 8)) AS b(i) ON floor((b.i + 0.5)*20/8) = p.x",
        "pixels",
    )
)
def s17_resize_nearest(spark: SparkSession, sf: str) -> DataFrame:
    p = entities.resize_nearest(V.pixels(spark, sf).select("frame", "y", "x", "class_id"), V.SIDE, V.SIDE, 8, 8)
    return p.select("frame", F.col("y").cast("bigint").alias("y"), F.col("x").cast("bigint").alias("x"), "class_id")


@query(
    V.with_views(
        " SELECT instance_id, round((y1 - y0 + 1)*(x1 - x0 + 1)/400.0, 6) AS box_share, "
            "round(sum(CASE WHEN p.class_id = 1 THEN 1 ELSE 0 END)/((y1 - y0 + 1)*(x1 - x0 + 1)), 6) AS mask_share, "
            "round(sum(CASE WHEN p.class_id = 1 AND NOT (p.y BETWEEN y0 + 2 AND y1 - 2 AND p.x BETWEEN x0 + 2 AND x1 - 2) THEN 1.0 ELSE 0.0 END)/greatest(sum(CASE "
            "WHEN p.class_id = 1 THEN 1 ELSE 0 END), 1), 6) AS rim_share FROM v_masks m "
            "JOIN v_pixels p ON p.frame = m.frame AND p.y BETWEEN m.y0 AND m.y1 AND p.x BETWEEN m.x0 AND m.x1 GROUP BY instance_id, y0, y1, x0, x1",
        "masks",
        "pixels",
    )
)
def a22_mask_box_ratio(spark: SparkSession, sf: str) -> DataFrame:
    """Of each box the share of the frame, of it the share that is mask (class 1), and how much of the mask lies on its two-pixel rim."""
    cover = V.masks(spark, sf).withColumn("y", F.explode(F.sequence("y0", "y1")))  # a run for each line
    mask = (F.col("class_id") == 1).cast("int")
    inner = F.col("y").between(F.col("y0") + 2, F.col("y1") - 2) & F.col("x").between(F.col("x0") + 2, F.col("x1") - 2)
    area = (F.col("y1") - F.col("y0") + 1) * (F.col("x1") - F.col("x0") + 1)
    met = cover.join(
        V.pixels(spark, sf).select("frame", "y", "x", "class_id"), ["frame", "y"],
    ).filter(F.col("x").between(F.col("x0"), F.col("x1"))).groupBy("instance_id", "y0", "y1", "x0", "x1").agg(F.sum(mask).alias("m"), F.sum(mask * (~inner).cast("int")).alias("rim"))
    return met.select(
        "instance_id",
        F.round(area / 400.0, 6).alias("box_share"),
        F.round(F.col("m") / area, 6).alias("mask_share"),
        F.round(F.col("rim") / F.greatest("m", F.lit(1)), 6).alias("rim_share"),
    )


# --- text, digests, ids ---


@query(
    "SELECT o_orderkey, format('{:.6g}', sqrt(o_totalprice)) AS a, format('{:.6g}', sqrt(o_totalprice) / 10000000) AS b, format('{:.6g}', "
        "CAST(round(o_totalprice) AS DOUBLE)) AS c FROM orders"
)
def f10_six_digits(spark: SparkSession, sf: str) -> DataFrame:
    o = V.table(spark, sf, "orders")
    return o.select(
        "o_orderkey",
        T.six_digits(F.sqrt("o_totalprice")).alias("a"),
        T.six_digits(F.sqrt("o_totalprice") / 10000000).alias("b"),
        T.six_digits(F.round("o_totalprice")).alias("c"),
    )


@query(
    "SELECT c_custkey, substr(sha256(c_name || '|' || c_mktsegment), 1, 8) AS short, "
        "sha256('{\"a\":\"' || c_mktsegment || '\",\"b\":' || c_custkey || '}') AS digest FROM customer"
)
def f5_digests(spark: SparkSession, sf: str) -> DataFrame:
    c = V.table(spark, sf, "customer")
    return c.select(
        "c_custkey",
        T.short_hash(F.col("c_name"), F.col("c_mktsegment")).alias("short"),
        T.digest(("b", F.col("c_custkey")), ("a", F.col("c_mktsegment"))).alias("digest"),
    )


@query(f"SELECT frame, string_agg(lower(trim(label, ' .')), '. ' ORDER BY instance_id) || '.' AS prompt FROM ({V.SQL['masks']}) GROUP BY frame")
def f2_prompt_text(spark: SparkSession, sf: str) -> DataFrame:
    m = V.masks(spark, sf).groupBy("frame").agg(F.array_sort(F.collect_list(F.struct("instance_id", "label"))).alias("m"))  # a frame's instances
    return m.select("frame", T.prompt_text(F.transform("m", lambda x: x["label"])).alias("prompt"))


@query(
    "SELECT k, CASE WHEN regexp_matches(k, '^<(obj|part|wire|region|route|track|pose)_\\d{3,}>$') THEN regexp_extract(k, '_(\\d+)>', "
        "1)::BIGINT ELSE -1 END AS num, regexp_matches(k, '^<wire_\\d{3,}>$') AS is_wire "
        "FROM (SELECT '<' || (['obj','wire','pose','box','track'])[p_partkey % 5 + 1] || '_' || lpad(CAST(p_partkey AS VARCHAR), "
        "CAST(greatest(length(CAST(p_partkey AS VARCHAR)), 2 + p_partkey % 2) AS INT), '0') || '>' AS k FROM part)"
)
def p11_ids(spark: SparkSession, sf: str) -> DataFrame:
    kinds, n = F.array(*[F.lit(x) for x in ("obj", "wire", "pose", "box", "track")]), F.col("p_partkey").cast("string")
    width = F.greatest(F.length(n), (2 + F.col("p_partkey") % 2).cast("int"))
    k = F.concat(F.lit("<"), F.element_at(kinds, (F.col("p_partkey") % 5 + 1).cast("int")), F.lit("_"), F.lpad(n, width, "0"), F.lit(">"))
    rows = V.table(spark, sf, "part").select(k.alias("k"))
    return rows.select("k", F.coalesce(T.parse_id(F.col("k"))["num"], F.lit(-1).cast("bigint")).alias("num"), T.valid_id(F.col("k"), "wire").alias("is_wire"))


@query("SELECT event_id, json_extract_string(j, '$.k') AS k FROM (SELECT event_id, CASE event_id % 3 WHEN 2 THEN NULL ELSE props END AS j FROM events)")
def f16_json_salvage(spark: SparkSession, sf: str) -> DataFrame:
    """Answers wrapped in fences, in prose, or without an object."""
    p = F.col("props")
    said = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("```json\n"), p, F.lit("\n```"))).when(
        F.col("event_id") % 3 == 1, F.concat(F.lit("The answer is "), p, F.lit(", I think.")),
    ).otherwise("no idea")
    return V.table(spark, sf, "events").select("event_id", F.get_json_object(T.json_object(said), "$.k").alias("k"))


# --- validation and states ---


_ENT = """, e AS (SELECT 'all' AS scene_id, CASE WHEN pos % 97 = 0 THEN 'odd_' || pos WHEN pos % 50 = 7 THEN format('<obj_{:03d}>', pos - 1) ELSE object_id END AS entity_id, semantic, pos FROM v_objects)"""


def _entity_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Objects as entities of one scene, some ids malformed, some repeated, some with a single confidence."""
    o, pos = V.objects(spark, sf), F.col("pos")
    eid = F.when(pos % 97 == 0, F.concat(F.lit("odd_"), pos.cast("string"))).when(pos % 50 == 7, T.format_id("obj", pos - 1)).otherwise(F.col("object_id"))
    return o.select(
        F.lit("all").alias("scene_id"),
        eid.alias("entity_id"),
        "semantic",
        F.when(pos % 3 != 0, F.lit(0.5)).alias("geometry"),
        F.when(pos % 6 == 0, F.lit(0.5)).alias("cross_view_support"),
        "pos",
    )


@query(
    V.with_views(
        _ENT + """, i AS (
  SELECT 'DUPLICATE' AS k, 'G2-E02' AS code, 'l1_entities' AS location, entity_id AS detail FROM (SELECT entity_id, count(*) AS n FROM e GROUP BY entity_id),
    unnest(range(1, n)) AS u(j)
  UNION ALL SELECT DISTINCT 'FORMAT', 'G2-E01', 'l1_entities', entity_id FROM e WHERE NOT regexp_matches(entity_id, '^<(obj|part|wire|region|route|track|pose)_\\d{3,}>$')
  UNION ALL SELECT 'REF', 'G2-E01', 'l2_relations', relation_id || '|subject_id|' || subject_id FROM v_relations WHERE subject_id NOT IN (SELECT entity_id FROM e)
  UNION ALL SELECT 'REF', 'G2-E01', 'l2_relations', relation_id || '|object_id|' || object_id FROM v_relations WHERE object_id NOT IN (SELECT entity_id FROM e)
  UNION ALL SELECT 'PROGRAM', 'G2-E05', 'l2_relations', relation_id || '|' || program FROM v_relations WHERE program = 'unheard_of'
  UNION ALL SELECT 'CONF', 'G2-E07', 'l1_entities.objects', entity_id FROM e WHERE pos % 3 = 0 AND pos % 6 <> 0)
  SELECT code, location, detail, count(*) AS n FROM i GROUP BY ALL""",
        "objects",
        "relations",
    )
)
def v1_entity_issues(spark: SparkSession, sf: str) -> DataFrame:
    e, r = _entity_rows(spark, sf), V.relations(spark, sf).withColumn("scene_id", F.lit("all"))
    refs = r.select(
        "scene_id",
        F.col("relation_id").alias("source"),
        F.explode(
            F.array(
                F.struct(F.lit("subject_id").alias("field"), F.col("subject_id").alias("ref")),
                F.struct(F.lit("object_id").alias("field"), F.col("object_id").alias("ref")),
            )
        ).alias("r"),
    ).select("scene_id", "source", "r.field", "r.ref")
    found = validate.all_issues(
        validate.duplicate_ids(e),
        validate.malformed_ids(e),
        validate.broken_references(refs, e),
        validate.unknown_programs(r, ["height_difference", "pairwise_min_distance"]),
        validate.collapsed_confidence(e),
    )
    return found.groupBy("code", "location", "detail").agg(F.count("*").alias("n"))


@query(
    """WITH s AS (SELECT 'scene_' || s_suppkey AS scene_id, s_suppkey AS k, (['metric','externally_anchored','relative','odd'])[s_suppkey % 4 + 1] AS depth_type,
      s_suppkey % 3 = 0 AS cal, s_suppkey % 5 = 0 AS ver, s_suppkey % 2 = 0 AS declared, CASE WHEN s_suppkey % 7 = 0 THEN 'relative' ELSE 'metric' END AS scale
      FROM supplier),
  w AS (SELECT *, CASE depth_type WHEN 'metric' THEN cal WHEN 'externally_anchored' THEN ver WHEN 'relative' THEN false END AS want FROM s),
  i AS (SELECT scene_id, 'G0-E08' AS code, 'capabilities' AS location, 'unknown depth type' AS detail FROM w WHERE want IS NULL
  UNION ALL SELECT scene_id, 'G0-E08', 'capabilities', 'claim does not follow' FROM w WHERE want IS NOT NULL AND want <> declared
  UNION ALL SELECT scene_id, 'G0-E08', 'capabilities', 'scale is not metric' FROM w WHERE want IS NOT NULL AND declared AND scale <> 'metric'
  UNION ALL SELECT scene_id, 'G2-E06', 'l0_geometry', 'mask' FROM s WHERE k % 9 = 0
  UNION ALL SELECT scene_id, 'G1-E02', 'l0_geometry.depth', 'no primary of the required family' FROM s WHERE k % 4 = 1
  UNION ALL SELECT scene_id, 'G1-E02', 'l0_geometry.depth', 'more than one primary' FROM s WHERE k % 4 = 2
  UNION ALL SELECT scene_id, 'G2-E03', 'layers', 'l1_entities' FROM s WHERE k % 10 = 3)
  SELECT scene_id, code, location, detail FROM i"""
)
def v1_scene_issues(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    s = V.table(spark, sf, "supplier").select(F.concat(F.lit("scene_"), k.cast("string")).alias("scene_id"), k.alias("k"))
    kinds = F.array(*[F.lit(x) for x in ("metric", "externally_anchored", "relative", "odd")])
    k = F.col("k")
    caps = s.select(
        "scene_id",
        F.element_at(kinds, (k % 4 + 1).cast("int")).alias("depth_type"),
        (k % 3 == 0).alias("domain_calibrated"),
        (k % 5 == 0).alias("anchor_verified"),
        (k % 2 == 0).alias("metric_task_eligible"),
        F.when(k % 7 == 0, "relative").otherwise("metric").alias("scale_status"),
    )
    masks = s.select("scene_id", F.when(k % 3 == 0, "mask").alias("combined_uri"), F.when(k % 9 != 0, 2).alias("n_reason_masks"))
    primary = F.when(k % 4 == 1, F.array(F.lit("other"))).when(k % 4 == 2, F.array(F.lit("VGGT-x"), F.lit("b"))).when(k % 4 == 3, F.array(F.lit("VGGT-x")))
    depths = s.select("scene_id", F.lit("primary").alias("role"), F.explode(primary).alias("producer"))
    layers = s.select(
        "scene_id", F.lit("l1_entities").alias("layer"), F.when(k % 10 != 4, "uri").alias("uri"), F.when(~(k % 10).isin(3, 4), "ab").alias("content_sha256"),
    )
    return validate.all_issues(
        validate.metric_claims(caps), validate.collapsed_masks(masks), validate.primary_depth(depths), validate.missing_digests(layers),
    ).select("scene_id", "code", "location", "detail")


_STATES = [s for s, _ in state.ORDER] + ["QUARANTINED", "REJECTED"]


@query(
    "WITH t(from_state, to_state, gate) AS (VALUES " + ", ".join(
        f"('{a}', '{b}', '{g}')" for (a, _), (b, g) in zip(state.ORDER, state.ORDER[1:], strict=False)
    ) + ", "
    + ", ".join(
        f"('{s}', '{o}', NULL)" for s, _ in state.ORDER[:-1] for o in ("QUARANTINED", "REJECTED")
    ) + ", ('QUARANTINED', 'REGISTERED', NULL), ('QUARANTINED', 'REJECTED', NULL)), "
    +
        f"m AS (SELECT [{', '.join(repr(s) for s in _STATES)}][p_partkey % 14 + 1] AS from_state, "
        f"[{', '.join(repr(s) for s in _STATES)}][(p_partkey % 14 + p_size) % 14 + 1] AS to_state, (['pass','warn','quarantine', "
        f"NULL])[p_partkey % 4 + 1] AS gate_status FROM part), "
    +
        "j AS (SELECT m.*, t.from_state IS NOT NULL AND (gate IS NULL OR coalesce(gate_status IN ('pass', 'warn'), false)) AS allowed FROM m LEFT "
        "JOIN t USING (from_state, to_state)) SELECT from_state, to_state, gate_status, allowed, count(*) AS n FROM j GROUP BY ALL"
)
def p13_transitions(spark: SparkSession, sf: str) -> DataFrame:
    names, p = F.array(*[F.lit(s) for s in _STATES]), F.col("p_partkey") % 14
    gates = F.array(F.lit("pass"), F.lit("warn"), F.lit("quarantine"), F.lit(None).cast("string"))
    m = V.table(spark, sf, "part").select(
        F.element_at(names, (p + 1).cast("int")).alias("from_state"),
        F.element_at(names, ((p + F.col("p_size")) % 14 + 1).cast("int")).alias("to_state"),
        F.element_at(gates, (F.col("p_partkey") % 4 + 1).cast("int")).alias("gate_status"),
    )
    return state.judge_transitions(m).groupBy("from_state", "to_state", "gate_status", "allowed").agg(F.count("*").alias("n"))


@query(
    "SELECT c_custkey, format('<obj_{:03d}>', 500 + (SELECT max(vec_id) FROM embeddings) + row_number() OVER (ORDER BY c_acctbal, c_custkey)) AS entity_id FROM customer"
)
def w7_minted_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers go on after the largest reserved one, in the order given."""
    taken = V.table(spark, sf, "embeddings").select(T.format_id("obj", F.col("vec_id") + 500).alias("entity_id"))
    rows = V.table(spark, sf, "customer").select(F.lit("obj").alias("namespace"), "c_acctbal", "c_custkey")
    return state.mint_ids(rows, ["c_acctbal", "c_custkey"], taken).select("c_custkey", "entity_id")


@query(
    "SELECT 'artifact_' || s_suppkey AS parent, sha256('l1_entities|root,artifact_' || s_suppkey || '|' || s_name) AS content_sha256, "
        "'l1_entities_' || substr(sha256('l1_entities|root,artifact_' || s_suppkey || '|' || s_name), 1, 12) AS artifact_id FROM supplier"
)
def ar1_derived_artifacts(spark: SparkSession, sf: str) -> DataFrame:
    a = V.table(spark, sf, "supplier").select(
        F.concat(F.lit("artifact_"), F.col("s_suppkey").cast("string")).alias("artifact_id"), F.array(F.lit("root")).alias("parents"), "s_name",
    )
    return state.derive(a, "l1_entities", F.col("s_name")).select(F.element_at("parents", -1).alias("parent"), "content_sha256", "artifact_id")


# --- compiling, rendering, grading ---

QUESTION = "Which entity is meant, and where is it?"


def packages(spark: SparkSession, sf: str) -> DataFrame:
    """Scenes of at most 500 objects as packages: all are good but for what their first number decides.

    Scenes whose label is 3 have little parallax, 4 an unknown one, 5 a relative scale; a sixth of the objects lacks its box;
    links are resolved in odd scenes.
    """
    o = V.objects(spark, sf)
    centre = xyz()
    line = F.when(F.col("pos") % 2 == 0, F.array(centre, F.array(F.col("x") + F.col("ex"), F.col("y") + F.col("ey"), F.col("z"))))
    obb = F.struct(centre.alias("center"), F.array("ex", "ey", "ez").alias("extent"), F.array(G.vec4(1, 0, 0), G.vec4(0, 1, 0), G.vec4(0, 0, 1)).alias("axes"))
    views = F.transform(F.sequence(F.lit(1).cast("bigint"), "n_views"), lambda i: F.format_string("f%04d", i))
    entity = F.struct(
        "pos", "object_id", "category",
        F.struct(
            centre.alias("centroid"), F.when(~F.col("scene_id").startswith("scene_6") | (F.col("pos") % 6 != 0), obb).alias("obb"), line.alias("centerline"),
        ).alias("geometry"),
        F.struct(views.alias("visible_frames")).alias("visibility"), F.struct(F.col("semantic").alias("semantic")).alias("confidence"),
    )
    g = o.groupBy("scene_id").agg(F.array_sort(F.collect_list(entity)).alias("objects"))
    label = F.split("scene_id", "_")[1].cast("int")
    cam = lambda n, x: F.struct(F.lit(f"<pose_{n:03d}>").alias("pose_id"), G.vec(x, 0, 30).alias("position"), G.vec(*AHEAD).alias("forward"), G.vec(*UP).alias("up"))
    seen = lambda k: F.struct(F.concat("scene_id", F.lit(f"/o{k}")).alias("observation_id"), F.lit(f"f000{k}").alias("frame_id"), F.lit("box").alias("mask_or_box"), F.array(F.lit("car"), F.lit("vehicle")).alias("category_candidates"))
    link = F.struct(
        F.lit("link_1").alias("link_id"),
        F.lit("<obj_001>").alias("entity_id"),
        F.when(label % 2 == 1, label % 4 == 1).alias("same_entity"),
        F.lit(0.9).alias("probability"),
        (label / 16.0).alias("point_support_iou"),
        seen(1).alias("observation_a"),
        seen(2).alias("observation_b"),
    )
    caps = F.struct(
        F.when(label == 5, "relative").otherwise("metric").alias("scale_status"),
        F.lit("externally_anchored").alias("depth_type"),
        (label != 5).alias("metric_task_eligible"),
        F.array(F.lit("object")).alias("available_entity_types"),
        F.lit(12.0).alias("camera_baseline_m"),
        F.when(label == 3, 0.01).when(label != 4, 0.3).alias("parallax_ratio"),
        F.lit(87.6).alias("nadir_angle_median_deg"),
        F.when(label % 2 == 0, 1.15).otherwise(5.0).alias("depth_relief_ratio"),
        F.lit(None).cast("boolean").alias("domain_calibrated"),
    )
    return g.select(
        "scene_id",
        caps.alias("caps"),
        F.array(cam(3, 9.0), cam(7, 0.0)).alias("cameras"),
        "objects",
        F.array(link).alias("links"),
        F.lit("<pose_007>").alias("observer_pose_id"),
        F.lit(QUESTION).alias("question"),
        F.array(F.lit("f0001.jpg"), F.lit("f0002.jpg")).alias("visual_inputs"),
        F.lit("cloud.ply").alias("pointcloud_ref"),
    )


def compiled(spark: SparkSession, sf: str, task: str | None = None) -> DataFrame:
    """All specifications, or one. For several, packages are made once and stored."""
    chosen = [s for s in task_specs() if task in (None, s.raw["task_id"])]
    p = packages(spark, sf)
    return compiler.compile_all(readers.materialized(p) if len(chosen) > 1 else p, chosen)


_PKG = """, p AS (SELECT scene_id, CAST(split_part(scene_id, '_', 2) AS INT) AS label, count(*) AS n, max(n_views) AS views, count(*) FILTER (split_part(scene_id, '_',
    2) = '6' AND pos % 6 = 0) AS boxless FROM v_objects GROUP BY scene_id),
  far AS (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY d DESC, pos) AS k FROM (SELECT *, sqrt(x*x + y*y + (z-30)**2) AS d FROM v_objects)),
  f AS (SELECT scene_id, max(object_id) FILTER (k = 1) AS id1, max(object_id) FILTER (k = 2) AS id2, max(d) FILTER (k = 1) AS d1, max(d) FILTER (k = 2) AS d2 FROM far
    GROUP BY scene_id),
  c AS (SELECT *, CASE WHEN pos % 2 = 0 THEN x + ex ELSE x + 0.001 END AS bx, CASE WHEN pos % 2 = 0 THEN y + ey ELSE y END AS by_ FROM v_objects),
  c2 AS (SELECT *, greatest(0.0, least(1.0, (-x*(bx-x) - y*(by_-y))/((bx-x)**2 + (by_-y)**2))) AS t FROM c),
  near AS (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY d, pos) AS k FROM (SELECT *, sqrt((x+t*(bx-x))**2 + (y+t*(by_-y))**2 + (30-z)**2) AS d FROM c2)),
  m AS (SELECT scene_id, max(object_id) FILTER (k = 1) AS id1, max(d) FILTER (k = 1) AS d1, max(d) FILTER (k = 2) AS d2 FROM near GROUP BY scene_id),
  g AS (SELECT scene_id, concat_ws(',', CASE WHEN n < 3 THEN 'candidates:3' END, CASE WHEN n < 3 THEN 'candidate_count_at_least:3' END,
    CASE WHEN boxless > 0 THEN 'all_candidates_have_valid_obb:true' END, CASE WHEN label = 4 THEN 'unknown:parallax_ratio' WHEN label = 3 THEN
    'parallax_ratio_at_least:0.05' END) AS reasons FROM p),
  q AS (SELECT scene_id, concat_ws(',', CASE WHEN label = 5 THEN 'scale_status:metric,metric_task_eligible' END,
    CASE WHEN label = 5 THEN 'scale_status_is_metric:true,domain_calibrated:true' END) AS reasons FROM p)"""


@query(
    V.with_views(
        _PKG +
            " SELECT scene_id, CASE WHEN reasons = '' THEN 'record' ELSE 'skipped' END AS status, reasons, CASE WHEN reasons = '' THEN id1 END AS object_id, "
            "reasons = '' AND abs(d1 - d2) < 0.05*greatest(d1, 1e-9) AS is_ambiguous, CASE WHEN reasons = '' AND abs(d1 - d2) < 0.05*greatest(d1, "
            "1e-9) THEN id1 || ',' || id2 WHEN reasons = '' THEN '' END AS equivalent FROM g JOIN f USING (scene_id)",
        "objects",
    )
)
def k1_compile_grounding(spark: SparkSession, sf: str) -> DataFrame:
    c, ok = compiled(spark, sf, "3d_grounding.object"), F.col("status") == "record"
    return c.select(
        "scene_id",
        "status",
        F.array_join("reasons", ",").alias("reasons"),
        F.when(ok, F.col("target.object_id")).alias("object_id"),
        (ok & F.coalesce("is_ambiguous", F.lit(False))).alias("is_ambiguous"),
        F.when(ok, F.array_join("equivalent", ",")).alias("equivalent"),
    )


@query(
    V.with_views(
        _PKG +
            " SELECT scene_id, CASE WHEN reasons = '' THEN 'record' ELSE 'skipped' END AS status, reasons, CASE WHEN reasons = '' THEN id1 END AS object_id, "
            "CASE WHEN reasons = '' THEN round(d1, 4) END AS minimum_distance, reasons = '' AND d2 - d1 <= 0.1 AS is_ambiguous, CASE WHEN split_part(scene_id, '_', "
            "2)::INT % 2 = 0 THEN 'nadir_view,uav_pose_altitude,weak_depth_cue' ELSE 'nadir_view,uav_pose_altitude' END AS tags FROM q JOIN m USING (scene_id)",
        "objects",
    )
)
def k1_compile_distance(spark: SparkSession, sf: str) -> DataFrame:
    c, ok = compiled(spark, sf, "3d_vqa.metric.minimum_distance"), F.col("status") == "record"
    return c.select(
        "scene_id",
        "status",
        F.array_join("reasons", ",").alias("reasons"),
        F.when(ok, F.col("target.object_id")).alias("object_id"),
        F.when(ok, F.col("target.minimum_distance")).alias("minimum_distance"),
        (ok & F.coalesce("is_ambiguous", F.lit(False))).alias("is_ambiguous"),
        F.array_join("tags", ",").alias("tags"),
    )


@query(
    V.with_views(
        """, o AS (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY pos) AS k, degrees(asin(-y/sqrt(x*x + y*y + (z-30)**2))) AS a FROM v_objects)
  SELECT scene_id, CASE WHEN split_part(scene_id, '_', 2) IN ('3', '4') THEN 'skipped' ELSE 'record' END AS status, object_id,
    CASE WHEN x >= 0 THEN 'front' ELSE 'behind' END AS longitudinal,
    CASE WHEN abs(a) < 10 THEN 'ambiguous' WHEN a > 0 THEN 'right' ELSE 'left' END AS lateral, round(a, 4) AS angle FROM o WHERE k = 1""",
        "objects",
    )
)
def k1_compile_direction(spark: SparkSession, sf: str) -> DataFrame:
    c = compiled(spark, sf, "3d_vqa.situated.observer_relative_direction")
    return c.select("scene_id", "status", "target.object_id", "target.longitudinal", "target.lateral", F.col("target.lateral_angle_deg").alias("angle"))


@query(
    V.with_views(
        " SELECT scene_id, CASE WHEN l % 2 = 1 THEN 'record' ELSE 'failed' END AS status, CASE WHEN l % 2 = 0 THEN 'G3-E07' END AS code, "
            "l % 4 = 1 AS same_entity, CASE WHEN l % 2 = 1 THEN l/16.0::DOUBLE END AS iou FROM (SELECT DISTINCT scene_id, CAST(split_part(scene_id, '_', "
            "2) AS INT) AS l FROM v_objects)",
        "objects",
    )
)
def k1_compile_correspondence(spark: SparkSession, sf: str) -> DataFrame:
    return compiled(spark, sf, "cross_view_correspondence.object").select(
        "scene_id", "status", "code", F.coalesce("target.same_entity", F.lit(False)).alias("same_entity"), F.col("target.point_support_iou").alias("iou"),
    )


@query(
    V.with_views(
        _PKG + """, a AS (SELECT '3d_grounding.object@0.1.0' AS spec_id, CASE WHEN reasons = '' THEN 'r' ELSE 's' END AS s FROM g UNION ALL
          SELECT '3d_vqa.metric.minimum_distance@0.1.0', CASE WHEN reasons = '' THEN 'r' ELSE 's' END FROM q
  UNION ALL SELECT '3d_vqa.situated.observer_relative_direction@0.1.0', CASE WHEN label IN (3, 4) THEN 's' ELSE 'r' END FROM p UNION ALL
    SELECT 'cross_view_correspondence.object@0.1.0', CASE WHEN label % 2 = 1 THEN 'r' ELSE 'f' END FROM p)
  SELECT spec_id, count(*) FILTER (s = 'r') AS records, count(*) FILTER (s = 's') AS skipped, count(*) FILTER (s = 'f') AS failed FROM a GROUP BY spec_id""",
        "objects",
    )
)
def a25_compile_accounting(spark: SparkSession, sf: str) -> DataFrame:
    return compiler.accounting(compiled(spark, sf))


@query(
    V.with_views(
        " SELECT scene_id, count(*) AS n_entities, string_agg(object_id, ',' ORDER BY sha256(scene_id || '|entities|' || object_id)) AS ids, "
            "'<pose_007>' AS pose_id, false AS shows_more FROM v_objects GROUP BY scene_id",
        "objects",
    )
)
def p1_masked_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """What the direction task shows: the order follows a hash, and no field outside the mask is there."""
    c = compiled(spark, sf, "3d_vqa.situated.observer_relative_direction")
    v = F.from_json("visible", "observer struct<pose_id:string>, entities array<struct<object_id:string>>")
    return c.select(
        "scene_id",
        F.size(v["entities"]).cast("bigint").alias("n_entities"),
        F.array_join(v["entities"]["object_id"], ",").alias("ids"),
        v["observer"]["pose_id"].alias("pose_id"),
        F.col("visible").rlike('"(obb|confidence|visibility|centerline)"').alias("shows_more"),
    )


@query(
    V.with_views(
        " SELECT object_id, category || ' at ' || format('{:.6g}', round(d, CASE WHEN pos % 2 = 0 THEN 4 ELSE 1 END)) || ' meters' LIKE '%' || format('{:.6g}', "
            "round(d, 4)) || '%' AS leaks FROM (SELECT *, sqrt(x*x + y*y + (z-30)**2) AS d FROM v_objects)",
        "objects",
    )
)
def f11_leakage_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a category text holds the distance it should hide, whole metres of one or two digits too; null where there is no distance."""
    d = G.distance(xyz(), G.vec(*EYE))
    o = V.objects(spark, sf).select(
        "object_id",
        F.struct(
            F.concat(
                "category", F.lit(" at "), T.six_digits(F.when(F.col("pos") % 2 == 0, F.round(d, 4)).otherwise(F.round(d, 1))), F.lit(" meters"),
            ).alias("category")
        ).alias("payload"),
        F.struct(F.round(d, 4).alias("minimum_distance"), F.lit("minimum_distance").alias("target_type")).alias("target"),
    )
    wanted = leakage.atoms(F.col("target"), o.schema["target"].dataType, least_number=1)
    found = leakage.findings(F.col("payload"), o.schema["payload"].dataType, wanted)
    return o.select("object_id", F.when(F.col("payload.category").isNotNull(), F.size(found) > 0).alias("leaks"))


@query(
    V.with_views(
        _PKG + """, r AS (SELECT scene_id, '3d_grounding.object@0.1.0' AS spec_id, ['pointcloud_native', 'qwen_2d_metadata', 'multimodal_3d'] AS a FROM g
          WHERE reasons = '' UNION ALL SELECT scene_id, '3d_vqa.metric.minimum_distance@0.1.0', ['pointcloud_native', 'qwen_2d_metadata', 'multimodal_3d'] FROM q
          WHERE reasons = ''
  UNION ALL SELECT scene_id, '3d_vqa.situated.observer_relative_direction@0.1.0', ['pointcloud_native', 'qwen_2d_metadata', 'multimodal_3d'] FROM p
    WHERE label NOT IN (3, 4) UNION ALL SELECT scene_id, 'cross_view_correspondence.object@0.1.0', ['qwen_2d_metadata', 'multimodal_3d'] FROM p WHERE label % 2 = 1)
  SELECT spec_id, adapter, CASE WHEN list_contains(a, adapter) THEN 'rendered' ELSE 'unsupported' END AS status, count(*) AS n, count(*) FILTER (list_contains(a,
    adapter)) AS n_asked, count(*) FILTER (list_contains(a, adapter)) AS n_verified FROM r, (VALUES ('pointcloud_native'), ('qwen_2d_metadata'),
    ('multimodal_3d')) t(adapter) GROUP BY ALL""",
        "objects",
    )
)
def r4_rendered_samples(spark: SparkSession, sf: str) -> DataFrame:
    records = readers.materialized(compiled(spark, sf))
    out = None
    for adapter in render.ADAPTERS:
        asked = F.coalesce(F.get_json_object("payload", "$.question"), F.get_json_object("payload", "$.conversations[0].value"))
        got = render.render(records, adapter).select(
            "spec_id",
            "adapter",
            "status",
            asked.contains(QUESTION).alias("asked"),
            (F.split("spec_id", "@")[0] == F.col("verification.task_spec_id")).alias("verified"),
        )
        out = got if out is None else out.unionByName(got)
    return out.groupBy("spec_id", "adapter", "status").agg(
        F.count("*").alias("n"), F.count_if("asked").alias("n_asked"), F.count_if("verified").alias("n_verified"),
    )


@query(
    V.with_views(
        " SELECT object_id, 'A. ' || category || chr(10) || 'B. ' || object_id AS lines, CASE WHEN pos % 3 = 0 THEN 'A' WHEN pos % 3 = 1 THEN 'B' END AS key "
            "FROM v_objects",
        "objects",
    )
)
def f13_choices(spark: SparkSession, sf: str) -> DataFrame:
    choices = F.array(F.struct(F.lit("A").alias("key"), F.col("category").alias("text")), F.struct(F.lit("B").alias("key"), F.col("object_id").alias("text")))
    said = F.array(F.when(F.col("pos") % 3 == 0, F.upper("category")).when(F.col("pos") % 3 == 1, F.col("object_id")).otherwise("none of them"))
    return V.objects(spark, sf).select("object_id", render.choice_lines(choices).alias("lines"), render.answer_key(choices, said).alias("key"))


@query(
    V.with_views(
        _PKG + """, a AS (SELECT m.scene_id, k, CASE k WHEN 0 THEN (id1 = id1) ELSE true END AS x, d1, d2, k FROM m, unnest(range(0, 5)) AS u(k))
  SELECT scene_id, CAST(k AS BIGINT) AS k, d2 - d1 > 0.1 AND k = 0 AS passed, CASE WHEN d2 - d1 <= 0.1 THEN 'G3-E04' WHEN k = 1 THEN 'G5-E01' WHEN k IN (2,
    3) THEN 'G4-E03' WHEN k = 4 THEN 'G5-E01' END AS code FROM a""",
        "objects",
    )
)
def c1_check_distance(spark: SparkSession, sf: str) -> DataFrame:
    """The right answer, a wrong id, no number, no distance, and a distance too far off."""
    p = packages(spark, sf)
    lines = F.transform(
        "objects",
        lambda o: F.struct(
            o["object_id"].alias("id"),
            F.when(F.size(o["geometry"]["centerline"]) >= 2, o["geometry"]["centerline"]).otherwise(
                F.array(o["geometry"]["centroid"], G.add(o["geometry"]["centroid"], G.vec(0.001, 0, 0)))
            ).alias("line"),
        ),
    )
    best = G.nearest_polyline(G.vec(*EYE), F.col("lines"), lambda x: x["line"], lambda x: x["id"])["value"]
    rows = p.select("scene_id", lines.alias("lines")).withColumn("best", best).withColumn(
        "k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(4).cast("bigint"))),
    )
    text = F.when(F.col("k") == 2, "three metres").when(
        F.col("k") == 4, (F.col("best.d") + 0.5).cast("string"),
    ).when(F.col("k") != 3, F.col("best.d").cast("string"))
    answer = F.struct(F.when(F.col("k") == 1, "<obj_999999>").otherwise(F.col("best.id")).alias("object_id"), text.alias("distance_m"))
    return rows.withColumn("r", grading.check_distance(answer, G.vec(*EYE), F.col("lines"))).select("scene_id", "k", "r.passed", "r.code")


@query(
    V.with_views(
        """, k AS (SELECT object_id, pos, pos % 7 AS k FROM v_objects)
  SELECT object_id, CASE WHEN k <> 6 THEN k IN (0, 4) END AS passed, CASE k WHEN 1 THEN 'G5-E01' WHEN 2 THEN 'G4-E02' WHEN 3 THEN 'G5-E04' WHEN 5 THEN 'G5-E01' END AS
    code, CASE k WHEN 6 THEN 'target is no candidate' END AS error FROM k""",
        "objects",
    )
)
def c2_check_grounding(spark: SparkSession, sf: str) -> DataFrame:
    k, i = F.col("pos") % 7, F.col("object_id")
    cands = F.when(k == 6, F.array(F.lit("<obj_000>x"))).otherwise(F.array(i, F.lit("<obj_100000>")))
    many = F.when(k.isin(3, 4), F.array(i, F.lit("<obj_100000>"))).otherwise(F.array().cast("array<string>"))
    answer = F.struct(F.when(k == 1, "<obj_100000>").when(k == 2, "<obj_99999>").otherwise(i).alias("object_id"), k.isin(4, 5).alias("ambiguous"))
    return V.objects(spark, sf).withColumn("r", grading.check_grounding(answer, i, cands, many)).select("object_id", "r.passed", "r.code", "r.error")


_DIR = """, d AS (SELECT *, degrees(asin(-y/sqrt(x*x + y*y + (z-30)**2))) AS a FROM v_objects), e AS (SELECT *,
    CASE WHEN pos % 3 = 0 THEN 'right' ELSE CASE WHEN a > 0 THEN 'right' ELSE 'left' END END AS said FROM d),
  r AS (SELECT *, abs(a) >= 10 AND (said = CASE WHEN a > 0 THEN 'right' ELSE 'left' END) AS passed FROM e)"""


@query(V.with_views(_DIR + " SELECT object_id, passed, CASE WHEN abs(a) < 10 THEN 'G3-E04' WHEN NOT passed THEN 'G5-E01' END AS code FROM r", "objects"))
def c3_check_direction(spark: SparkSession, sf: str) -> DataFrame:
    return _direction_grades(spark, sf).select("object_id", "r.passed", "r.code")


def _direction_grades(spark: SparkSession, sf: str) -> DataFrame:
    side = F.when(-F.col("y") > 0, "right").otherwise("left")
    answer = F.struct(
        F.when(F.col("x") >= 0, "front").otherwise("behind").alias("longitudinal"), F.when(F.col("pos") % 3 == 0, "right").otherwise(side).alias("lateral"),
    )
    return V.objects(spark, sf).withColumn("r", grading.check_direction(answer, xyz(), G.vec(*EYE), G.vec(*AHEAD), G.vec(*UP)))


@query(
    V.with_views(
        " SELECT object_id, pos % 5 = 0 AS passed, CASE pos % 5 WHEN 0 THEN NULL WHEN 1 THEN 'G5-E01' ELSE 'G4-E01' END AS code FROM v_objects "
            "WHERE pos % 5 <> 4 UNION ALL SELECT object_id, NULL, NULL FROM v_objects WHERE pos % 5 = 4",
        "objects",
    )
)
def c4_check_correspondence(spark: SparkSession, sf: str) -> DataFrame:
    k, truth = F.col("pos") % 5, F.col("pos") % 2 == 0
    answer = F.struct(F.when(k == 1, ~truth).when(k != 2, truth).alias("same_entity"), F.when(k == 3, 1.5).otherwise(0.5).alias("confidence"))
    return V.objects(spark, sf).withColumn("r", grading.check_correspondence(answer, F.when(k != 4, truth))).select("object_id", "r.passed", "r.code")


@query(
    V.with_views(
        _DIR + """, t AS (SELECT (['a','b','c'])[pos % 3 + 1] AS arm, CASE WHEN passed THEN 1.0 ELSE 0.0 END AS hit FROM r), g AS (SELECT arm, sum(hit) AS hits,
          count(*) AS n, sum(hit)/count(*) AS p FROM t GROUP BY arm)
  SELECT arm, CAST(hits AS DOUBLE) AS hits, n, round(p, 6) AS accuracy, round(greatest(0,
    (p + 1.96*1.96/(2*n))/(1 + 1.96*1.96/n) - 1.96*sqrt(p*(1-p)/n + 1.96*1.96/(4*n*n))/(1 + 1.96*1.96/n)), 6) AS low,
    round(least(1, (p + 1.96*1.96/(2*n))/(1 + 1.96*1.96/n) + 1.96*sqrt(p*(1-p)/n + 1.96*1.96/(4*n*n))/(1 + 1.96*1.96/n)), 6) AS high,
      round(max(p) FILTER (arm = 'b') OVER () - max(p) FILTER (arm = 'a') OVER (), 6) AS lift,
      round(max(p) FILTER (arm = 'b') OVER () - max(p) FILTER (arm = 'c') OVER (), 6) AS net FROM g""",
        "objects",
    )
)
def a18_lift_report(spark: SparkSession, sf: str) -> DataFrame:
    arms = F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("pos") % 3 + 1).cast("int"))
    trials = _direction_grades(spark, sf).select(arms.alias("arm"), grading.score(F.col("r")).alias("hit"))
    return grading.lift(trials).select("arm", "hits", "n", *[F.round(c, 6).alias(c) for c in ("accuracy", "low", "high", "lift", "net")])


@query(
    "WITH s AS (SELECT p_size % 4 = 0 AS negative, p_retailprice/2500 + CASE WHEN p_size % 4 = 0 THEN 0 ELSE 0.1 END AS score FROM part), "
        "t AS (SELECT CAST(t AS DOUBLE) AS threshold, count(*) FILTER (NOT negative AND score > t) AS n_real, count(*) FILTER (negative AND score > t) AS n_negative "
        "FROM s, (VALUES (0.2), (0.3), (0.35), (0.4), (0.45), (0.5), (0.6), (0.9)) v(t) GROUP BY t) SELECT *, round(n_real/12.0, 6) AS real_rate, "
        "CASE WHEN n_negative > 0 THEN round(n_real/n_negative, 6) END AS discriminability, coalesce(threshold = min(threshold) FILTER (n_negative = 0) OVER (), "
        "false) AS is_lowest_clean FROM t"
)
def a20_threshold_sweep(spark: SparkSession, sf: str) -> DataFrame:
    s = V.table(spark, sf, "part").select(
        (F.col("p_size") % 4 == 0).alias("negative"), (F.col("p_retailprice") / 2500 + F.when(F.col("p_size") % 4 == 0, 0.0).otherwise(0.1)).alias("score"),
    )
    return grading.threshold_sweep(s, [0.2, 0.3, 0.35, 0.4, 0.45, 0.5, 0.6, 0.9], 12).withColumn("real_rate", F.round("real_rate", 6)).withColumn(
        "discriminability", F.round("discriminability", 6),
    )


@query("SELECT p_brand AS phrase, max(p_retailprice) AS peak, round(quantile_cont(p_retailprice, 0.99), 6) AS p99 FROM part GROUP BY p_brand")
def a21_phrase_peaks(spark: SparkSession, sf: str) -> DataFrame:
    s = V.table(spark, sf, "part").select(F.col("p_brand").alias("phrase"), F.col("p_retailprice").alias("score"))
    tails = entities.exact_percentile(s, ["phrase"], "score", 0.99, "p99")
    return s.groupBy("phrase").agg(F.max("score").alias("peak")).join(tails, "phrase").select("phrase", "peak", F.round("p99", 6).alias("p99"))


@query(
    "WITH s AS (SELECT p_partkey % 50 AS query, p_brand AS phrase, max(p_retailprice) AS score FROM part GROUP BY ALL), r AS (SELECT *, "
        "row_number() OVER (PARTITION BY query ORDER BY score DESC, phrase) AS k FROM s) SELECT query, score, phrase FROM r WHERE k = 1 AND score > 500"
)
def t6_best_phrases(spark: SparkSession, sf: str) -> DataFrame:
    s = V.table(spark, sf, "part").select((F.col("p_partkey") % 50).alias("query"), F.col("p_brand").alias("phrase"), F.col("p_retailprice").alias("score"))
    return grading.best_phrases(s, 500.0)


@query(
    V.with_views(
        " SELECT object_id, list_contains(['building','structure'], category) AS supported, greatest(0, ex) AS e FROM v_objects "
            "WHERE category IN (SELECT category FROM v_objects EXCEPT SELECT 'sky')",
        "objects",
    )
)
def u3_off_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    o = V.objects(spark, sf)
    named = o.select("category").exceptAll(o.filter("category = 'sky'").select("category")).distinct()
    return o.join(named, "category", "left_semi").select(
        "object_id",
        F.array_contains(F.array(F.lit("building"), F.lit("structure")), F.col("category")).alias("supported"),
        F.greatest(F.lit(0.0), "ex").alias("e"),
    )


@query(
    V.with_views(
        " SELECT scene_id, category, count(*) AS n, CAST(grouping(scene_id) AS BIGINT) AS all_scenes, CAST(grouping(category) AS BIGINT) AS all_categories "
            "FROM v_objects GROUP BY CUBE (scene_id, category)",
        "objects",
    )
)
def x_release_distribution(spark: SparkSession, sf: str) -> DataFrame:
    """Beyond the reference: how entities spread over scenes and categories, with all subtotals."""
    return V.objects(spark, sf).cube("scene_id", "category").agg(
        F.count("*").alias("n"), F.grouping("scene_id").cast("bigint").alias("all_scenes"), F.grouping("category").cast("bigint").alias("all_categories"),
    )


@query(
    V.with_views(" SELECT p, CAST(crc AS BIGINT) AS n FROM (SELECT split_part(scene_id, '_', 2) AS p, count(*) AS crc FROM v_objects GROUP BY 1)", "objects")
)
def t8_rotated_geometry(spark: SparkSession, sf: str) -> DataFrame:
    """Objects whose centroid moved to another one when their scene's geometry is turned: all of them."""
    p = packages(spark, sf).withColumn("turned", grading.rotated(F.col("objects")["geometry"]["centroid"], F.col("scene_id")))
    moved = F.size(
        F.filter(
            F.transform(F.arrays_zip(F.col("objects")["geometry"]["centroid"].alias("a"), F.col("turned").alias("b")), lambda x: x["a"] != x["b"]), lambda x: x,
        )
    )
    return p.groupBy(F.split("scene_id", "_")[1].alias("p")).agg(F.sum(moved.cast("bigint")).alias("n"))


@query(
    "SELECT object_id, CASE k WHEN 1 THEN 'unit' WHEN 2 THEN 'distance_m' WHEN 3 THEN 'keys' WHEN 4 THEN 'object_id' WHEN 5 THEN 'confidence' END AS broken "
        "FROM (SELECT format('<obj_{:03d}>', vec_id) AS object_id, vec_id % 6 AS k FROM embeddings) WHERE k > 0"
)
def p19_answer_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Answers that each break one rule of the distance schema; good ones give no row."""
    k, i = F.col("pos") % 6, F.col("object_id")
    said = F.concat(
        F.lit('{"object_id": "'),
        F.when(k == 4, "obj_1").otherwise(i),
        F.lit('", "distance_m": '),
        F.when(k == 2, '"about 3"').otherwise("3.5"),
        F.when(k == 1, ', "unit": "feet"').otherwise(', "unit": "meter"'),
        F.when(k == 3, ', "more": 1').otherwise(""),
        F.when(k == 5, ', "confidence": 1.5').otherwise(""),
        F.lit("}"),
    )
    rows = V.objects(spark, sf).select("object_id", said.alias("answer"))
    return validate.constraint_issues(
        rows, answers.answer_rules("vqa_metric_distance_answer", F.col("answer")), "object_id",
    ).withColumnRenamed("constraint", "broken")
