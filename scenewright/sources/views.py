"""Tables of the shape that the operators take, derived from the driver's tables; the same definitions as SQL stand beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenewright.functions import text as T

#: Side of a frame's pixel grid.
SIDE = 20
#: Where the observer of every scene stands.
OBSERVER = (0.0, 0.0, 30.0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _dim(i: int):
    return F.get(F.col("embedding"), F.lit(i)).cast("double") * 100


def _scene():
    """Scenes of at most 500 objects each, whatever the table's size."""
    return F.concat(F.lit("scene_"), F.col("label").cast("string"), F.lit("_"), F.expr("cast(vec_id div 500 as string)"))


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per candidate object: scene_id, object_id, category, x, y, z, ex, ey, ez, point_count, n_views, semantic, pos."""
    return table(spark, sf_dir, "embeddings").select(
        _scene().alias("scene_id"),
        T.format_id("obj", F.col("vec_id")).alias("object_id"),
        F.element_at(F.array(*[F.lit(c) for c in T.CLASSES]), (F.col("vec_id") % 10 + 1).cast("int")).alias("category"),
        *[_dim(i).alias(n) for i, n in enumerate("xyz")],
        *[F.abs(_dim(i + 3) / 10).alias(n) for i, n in enumerate(("ex", "ey", "ez"))],
        (100 + F.col("vec_id") * 7 % 400).alias("point_count"),
        (1 + F.col("vec_id") % 4).alias("n_views"),
        (F.col("vec_id") * 13 % 100 / 100.0).alias("semantic"),
        F.col("vec_id").alias("pos"),
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """21 points of each object: scene_id, pos, i, x, y, z."""
    triples = F.transform(
        F.sequence(F.lit(0), F.lit(20)),
        lambda k: F.struct(
            k.cast("bigint").alias("i"), *[(F.get(F.col("embedding"), k * 3 + 1 + d).cast("double") * 100).alias(n) for d, n in enumerate("xyz")]
        ),
    )
    return table(spark, sf_dir, "embeddings").select(_scene().alias("scene_id"), F.col("vec_id").alias("pos"), F.inline(triples))


def polylines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each object's points in order as one line: scene_id, pos, line (array of vec3). The arrays are built from the row itself, without a shuffle."""
    line = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda k: F.array(*[F.get(F.col("embedding"), k * 3 + 1 + d).cast("double") * 100 for d in range(3)]))
    return table(spark, sf_dir, "embeddings").select(_scene().alias("scene_id"), F.col("vec_id").alias("pos"), line.alias("line"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images: run, frame_id, ts_ns, user_id, value."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("run"),
        F.col("event_id").alias("frame_id"),
        (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("ts_ns"),
        "user_id",
        "value",
    )


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames with the names that recordings give them: frame_id, run, stamp, ts_ns, user_id, value."""
    run = F.concat(
        F.lit("interval5_"),
        F.col("run"),
        F.when(F.col("frame_id") % 5 == 0, "_GNSS").when(F.col("frame_id") % 5 == 1, "_Evening").otherwise(""),
        F.lpad((F.col("frame_id") % 3 + 1).cast("string"), 2, "0"),
    )
    stamp = F.concat(F.expr("cast(ts_ns div 1000000000 as string)"), F.lit("."), F.lpad((F.col("ts_ns") % 1_000_000_000).cast("string"), 9, "0"))
    return frames(spark, sf_dir).select("frame_id", run.alias("run"), stamp.alias("stamp"), "ts_ns", "user_id", "value")


def poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Poses of nine frames in ten: run, stem, pos, Height, Width, P3x3, T4x4. Every seventh frame has a second, later one a metre higher."""
    f = _named(spark, sf_dir).filter("frame_id % 10 <> 9")
    f = f.withColumn("again", F.explode(F.when(F.col("frame_id") % 7 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    row = lambda *xs: F.array(*[x if not isinstance(x, (int, float)) else F.lit(float(x)) for x in xs])
    t = F.array(
        row(1, 0, 0, F.col("value")),
        row(0, 1, 0, F.col("user_id").cast("double")),
        row(0, 0, 1, (F.col("frame_id") % 13 + F.col("again")).cast("double")),
        row(0, 0, 0, 1),
    )
    k = F.array(row(100, 0, 50), row(0, 100, 40), row(0, 0, 1))
    return f.select(
        "run",
        F.col("stamp").alias("stem"),
        (F.col("frame_id") * 2 + F.col("again")).alias("pos"),
        F.lit(80).alias("Height"),
        F.lit(100).alias("Width"),
        k.alias("P3x3"),
        t.alias("T4x4"),
    )


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One track row for each frame, half a second late: run, ts_ns, easting."""
    return _named(spark, sf_dir).select("run", (F.col("ts_ns") + 500_000_000).alias("ts_ns"), F.col("value").alias("easting"))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive members: archive, path. Every frame has an image; some a label, some a point cloud; and there is some other content."""
    f = _named(spark, sf_dir)
    cam, lidar, label = "interval5_CAM_LIDAR", "interval5_CAM_LIDAR", "interval5_CAM_label"
    image = f.select(F.lit(cam).alias("archive"), F.concat(F.lit(f"{cam}/"), "run", F.lit("/interval5_CAM/"), "stamp", F.lit(".jpg")).alias("path"))
    cloud = f.filter("frame_id % 4 <> 0").select(
        F.lit(lidar).alias("archive"),
        F.concat(F.lit(f"{lidar}/"), "run", F.lit("/interval5_LIDAR/image"), "stamp", F.lit("_lidar"), "stamp", F.lit(".txt")).alias("path"),
    )
    ids = f.filter("frame_id % 3 <> 0").select(
        F.lit(label).alias("archive"),
        F.concat(
            F.lit(f"{label}/"), "run", F.lit(f"/{label}_"), F.when(F.col("frame_id") % 2 == 0, "id").otherwise("color"), F.lit("/"), "stamp", F.lit(".png"),
        ).alias("path"),
    )
    points = f.filter("frame_id % 4 <> 0 and frame_id % 6 = 1").select(
        F.lit("interval5_LIDAR_label").alias("archive"),
        F.concat(
            F.lit("interval5_LIDAR_label/"), "run", F.lit("/interval5_LIDAR_label_id/image"), "stamp", F.lit("_lidar"), "stamp", F.lit(".txt"),
        ).alias("path"),
    )
    other = f.filter("frame_id % 50 = 0").select(F.lit(cam).alias("archive"), F.concat(F.lit(f"{cam}/"), "run", F.lit("/readme.txt")).alias("path"))
    return image.unionByName(cloud).unionByName(ids).unionByName(points).unionByName(other)


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of frames of SIDE x SIDE, the rows that fall on one pixel taken together: scene_id, frame, y, x, class_id, depth, conf."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_suppkey").alias("frame"), (F.col("l_orderkey") % SIDE).alias("y"), (F.col("l_partkey") % SIDE).alias("x"))
        .agg(F.min("l_returnflag").alias("flag"), (F.max("l_extendedprice") / 1000).alias("depth"), (F.max("l_quantity") / 10).alias("conf"))
        .select(
            F.concat(F.lit("scene_"), F.expr("cast(frame div 10 as string)")).alias("scene_id"),
            "frame",
            "y",
            "x",
            F.when(F.col("flag") == "A", 0).when(F.col("flag") == "N", 1).otherwise(2).cast("bigint").alias("class_id"),
            "depth",
            "conf",
        )
    )


def masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles on the pixel grid as instances: instance_id, frame, y0, y1, x0, x1 (inclusive), label."""
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("frame"))
    last = suppliers.agg(F.max("frame").alias("last"))  # one row
    p = table(spark, sf_dir, "part").crossJoin(F.broadcast(last)).select(
        F.col("p_partkey").alias("instance_id"),
        (F.col("p_partkey") % F.col("last") + 1).cast("bigint").alias("frame"),
        (F.col("p_partkey") * 3 % SIDE).alias("y0"),
        (F.col("p_partkey") * 7 % SIDE).alias("x0"),
        (2 + F.col("p_size") % 6).cast("bigint").alias("h"),
        labels_of(F.col("p_partkey")).alias("label"),
    )
    return p.join(suppliers, "frame", "left_semi").select(
        "instance_id",
        "frame",
        "y0",
        F.least(F.col("y0") + F.col("h"), F.lit(SIDE - 1)).alias("y1"),
        "x0",
        F.least(F.col("x0") + F.col("h"), F.lit(SIDE - 1)).alias("x1"),
        "label",
    )


#: Labels with traps for keyword rules.
LABELS = [
    "tower crane",
    "birdhouse",
    "snowman",
    "carpet",
    "bushes",
    "stonework",
    "courtyard",
    "cabling duct",
    "wiretap",
    "watershed",
    "old man",
    "grass strip",
    "landing pad",
    "chairlift",
    "bicycle rack",
    "skylight",
    "barn",
    "rockery",
    "seat cover",
]


def labels_of(key):
    return F.element_at(F.array(*[F.lit(x) for x in LABELS]), (key % len(LABELS) + 1).cast("int"))


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between objects, some of them dangling: scene_id, relation_id, subject_id, object_id, program."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.concat(F.lit("rel_"), F.col("o_orderkey").cast("string")).alias("relation_id"),
        T.format_id("obj", F.col("o_orderkey") % 520).alias("subject_id"),
        T.format_id("obj", F.col("o_custkey") % 505).alias("object_id"),
        F.when(F.col("o_orderkey") % 7 == 0, "unheard_of").when(
            F.col("o_orderkey") % 2 == 0, "height_difference",
        ).otherwise("pairwise_min_distance").alias("program"),
    )


_SEGMENTS = "list_transform(range(0, 21), lambda k: {'i': CAST(k AS BIGINT), 'x': CAST(embedding[k*3+2] AS DOUBLE)*100, 'y': CAST(embedding[k*3+3] AS DOUBLE)*100, 'z': CAST(embedding[k*3+4] AS DOUBLE)*100})"
_CLASS_LIST = "[" + ", ".join(f"'{c}'" for c in T.CLASSES) + "]"
_LABEL_LIST = "[" + ", ".join(f"'{c}'" for c in LABELS) + "]"

_NAMED = """SELECT *, 'interval5_' || event_type || CASE event_id % 5 WHEN 0 THEN '_GNSS' WHEN 1 THEN '_Evening' ELSE '' END || lpad(CAST(event_id % 3 + 1 AS VARCHAR),
    2, '0') AS run,
    CAST(epoch_us(ts) // 1000000 AS VARCHAR) || '.' || lpad(CAST(epoch_us(ts)*1000 % 1000000000 AS VARCHAR), 9, '0') AS stamp FROM events"""

#: The same tables for a WITH clause.
SQL = {
    "poses": f"""SELECT run, stamp AS stem, event_id*2 + a.again AS pos, value AS x, CAST(user_id AS DOUBLE) AS y, CAST(event_id % 13 + a.again AS DOUBLE) AS z
  FROM ({_NAMED}), unnest(range(0, CASE WHEN event_id % 7 = 0 THEN 2 ELSE 1 END)) AS a(again) WHERE event_id % 10 <> 9""",
    "tracks": f"SELECT run, epoch_us(ts)*1000 + 500000000 AS ts_ns, value AS easting FROM ({_NAMED})",
    "objects": f"""SELECT 'scene_' || label || '_' || vec_id // 500 AS scene_id, format('<obj_{{:03d}}>', vec_id) AS object_id,
      {_CLASS_LIST}[vec_id % 10 + 1] AS category,
  CAST(embedding[1] AS DOUBLE)*100 AS x, CAST(embedding[2] AS DOUBLE)*100 AS y, CAST(embedding[3] AS DOUBLE)*100 AS z,
  abs(CAST(embedding[4] AS DOUBLE)*100/10) AS ex, abs(CAST(embedding[5] AS DOUBLE)*100/10) AS ey, abs(CAST(embedding[6] AS DOUBLE)*100/10) AS ez,
  100 + vec_id*7 % 400 AS point_count, 1 + vec_id % 4 AS n_views, (vec_id*13 % 100) / 100.0 AS semantic, vec_id AS pos FROM embeddings""",
    "points":
        f"SELECT scene_id, pos, p.i AS i, p.x AS x, p.y AS y, p.z AS z FROM (SELECT 'scene_' || label || '_' || vec_id // 500 AS scene_id, vec_id AS pos, "
        f"unnest({_SEGMENTS}) AS p FROM embeddings)",
    "frames": "SELECT event_type AS run, event_id AS frame_id, epoch_us(ts)*1000 AS ts_ns, user_id, value FROM events",
    "members": f"""SELECT archive, path FROM ({_NAMED}) f,
  LATERAL (SELECT 'interval5_CAM_LIDAR' AS archive, 'interval5_CAM_LIDAR/' || f.run || '/interval5_CAM/' || f.stamp || '.jpg' AS path
    UNION ALL SELECT 'interval5_CAM_LIDAR', 'interval5_CAM_LIDAR/' || f.run || '/interval5_LIDAR/image' || f.stamp || '_lidar' || f.stamp || '.txt'
      WHERE f.event_id % 4 <> 0
    UNION ALL SELECT 'interval5_CAM_label', 'interval5_CAM_label/' || f.run || '/interval5_CAM_label_' || CASE WHEN f.event_id % 2 = 0 THEN 'id' ELSE 'color' END || '/'
      || f.stamp || '.png' WHERE f.event_id % 3 <> 0
    UNION ALL SELECT 'interval5_LIDAR_label', 'interval5_LIDAR_label/' || f.run || '/interval5_LIDAR_label_id/image' || f.stamp || '_lidar' || f.stamp || '.txt'
      WHERE f.event_id % 4 <> 0 AND f.event_id % 6 = 1
    UNION ALL SELECT 'interval5_CAM_LIDAR', 'interval5_CAM_LIDAR/' || f.run || '/readme.txt' WHERE f.event_id % 50 = 0) m""",
    "pixels": f"""SELECT 'scene_' || (frame // 10) AS scene_id, frame, y, x, CAST(CASE flag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS BIGINT) AS class_id, depth,
      conf FROM (
  SELECT l_suppkey AS frame, l_orderkey % {SIDE} AS y, l_partkey % {SIDE} AS x, min(l_returnflag) AS flag, max(l_extendedprice)/1000 AS depth, max(l_quantity)/10 AS conf
    FROM lineitem GROUP BY ALL)""",
    "masks": f"""SELECT instance_id, frame, y0, least(y0 + h, {SIDE - 1}) AS y1, x0, least(x0 + h, {SIDE - 1}) AS x1, label FROM (
  SELECT p_partkey AS instance_id, p_partkey % (SELECT max(s_suppkey) FROM supplier) + 1 AS frame, p_partkey*3 % {SIDE} AS y0, p_partkey*7 % {SIDE} AS x0,
    CAST(2 + p_size % 6 AS BIGINT) AS h, {_LABEL_LIST}[p_partkey % {len(LABELS)} + 1] AS label FROM part)
  WHERE frame IN (SELECT s_suppkey FROM supplier)""",
    "relations": """SELECT 'rel_' || o_orderkey AS relation_id, format('<obj_{:03d}>', o_orderkey % 520) AS subject_id, format('<obj_{:03d}>',
      o_custkey % 505) AS object_id,
  CASE WHEN o_orderkey % 7 = 0 THEN 'unheard_of' WHEN o_orderkey % 2 = 0 THEN 'height_difference' ELSE 'pairwise_min_distance' END AS program FROM orders""",
}


def with_views(body: str, *names: str, recursive: bool = False) -> str:
    """body after a WITH clause of these tables; body may go on with CTEs of its own if it begins with a comma."""
    head = ", ".join(f"v_{n} AS ({SQL[n]})" for n in names)
    return f"WITH {'RECURSIVE ' * recursive}{head} {body}"
