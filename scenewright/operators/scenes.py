"""From archive members and frames to scenes: catalogue, pairing, count windows and track ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenewright.functions import text as T

RUN = r"^interval5_([A-Za-z]+?)(?:_GNSS)?(?:_Evening)?(\d*)$"
LIDAR = r"^image([\d.]+)_lidar([\d.]+)\.txt$"
CAMERA_ARCHIVE, LABEL_ARCHIVE, CLOUD_LABEL_ARCHIVE = "interval5_CAM_LIDAR", "interval5_CAM_label", "interval5_LIDAR_label"
DATASET = "uavscenes"


def runs(members: DataFrame) -> DataFrame:
    """run and split_group of every run folder. Runs of one place share a group, so a split by group never parts them."""
    name = F.get(F.split("path", "/"), F.lit(1))
    return members.filter(
        (F.col("archive") == CAMERA_ARCHIVE) & (F.size(F.split("path", "/")) >= 3)
    ).select(name.alias("run")).distinct().select("run", split_group(F.col("run")).alias("split_group"))


def split_group(run: Column) -> Column:
    """The place in a run's name; null where the name isn't one."""
    return F.when(run.rlike(RUN), F.regexp_extract(run, RUN, 1))


def split_of(group: Column, test_share: float = 0.2) -> Column:
    """train or test, decided for a whole split group."""
    return F.when(F.pmod(F.crc32(group.cast("binary")), F.lit(1000)) < int(1000 * test_share), "test").otherwise("train")


def images(members: DataFrame) -> DataFrame:
    """run, stem, path, ts_ns of each image."""
    parts = F.split("path", "/")
    found = members.filter((F.col("archive") == CAMERA_ARCHIVE) & F.col("path").rlike(r"^[^/]+/[^/]+/interval5_CAM/[^/]+\.jpg$"))
    stem = F.regexp_replace(F.get(parts, F.lit(3)), r"\.jpg$", "")
    return found.select(F.get(parts, F.lit(1)).alias("run"), stem.alias("stem"), "path").withColumn("ts_ns", T.ns_of(F.col("stem")))


def clouds(members: DataFrame) -> DataFrame:
    """run, stem (of the image it belongs to), lidar_path, lidar_ns; of several the last by path."""
    name = F.element_at(F.split("path", "/"), -1)
    found = members.filter((F.col("archive") == CAMERA_ARCHIVE) & F.col("path").contains("/interval5_LIDAR/") & name.rlike(LIDAR))
    found = found.select(
        F.get(F.split("path", "/"), F.lit(1)).alias("run"),
        F.regexp_extract(name, LIDAR, 1).alias("stem"),
        F.regexp_extract(name, LIDAR, 2).alias("stamp"),
        "path",
    )
    return found.groupBy("run", "stem").agg(
        F.max("path").alias("lidar_path"), F.max_by("stamp", "path").alias("stamp"),
    ).select("run", "stem", "lidar_path", T.ns_of(F.col("stamp")).alias("lidar_ns"))


def pair_frames(members: DataFrame, poses: DataFrame | None = None) -> DataFrame:
    """Images with their point cloud, id labels of both and pose, each null where there is none: keys are the same in all, so one partitioning serves every join."""
    img = images(members)
    out = img.join(clouds(members), ["run", "stem"], "left")
    cloud = F.regexp_replace(F.element_at(F.split("lidar_path", "/"), -1), r"\.txt$", "")
    for column, archive, name, ending in (("label_path", LABEL_ARCHIVE, F.col("stem"), ".png"), ("cloud_label_path", CLOUD_LABEL_ARCHIVE, cloud, ".txt")):
        label = members.filter(F.col("archive") == archive).select(F.col("path").alias(column)).distinct()
        wanted = F.concat(F.lit(f"{archive}/"), "run", F.lit(f"/{archive}_id/"), name, F.lit(ending))
        out = out.withColumn("wanted", wanted).join(label, F.col("wanted") == F.col(column), "left").drop("wanted")
    return out if poses is None else out.join(last_pose(poses), ["run", "stem"], "left")


def last_pose(poses: DataFrame) -> DataFrame:
    """One pose per image name of a run, the last of repeated ones by pos."""
    others = [c for c in poses.columns if c not in ("run", "stem")]
    return poses.groupBy("run", "stem").agg(F.max_by(F.struct(*others), "pos").alias("pose"))


def positions(df: DataFrame, keys: list[str], ts: str, tie: str, width: int) -> DataFrame:
    """df with column n: the row's place from 0 among the rows of its keys by (ts, tie).

    Rows are counted by stretches of width of ts; a window over the counts gives each stretch its start and one over
    each stretch the rest. No task orders a whole key, however many rows it has.
    """
    rows = df.withColumn("stretch", F.floor(F.col(ts) / width).cast("bigint"))
    counts = rows.groupBy(*keys, "stretch").agg(F.count("*").alias("stretch_rows"))
    before = Window.partitionBy(*keys).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("stretch_start", F.coalesce(F.sum("stretch_rows").over(before), F.lit(0))).drop("stretch_rows")
    within = Window.partitionBy(*keys, "stretch").orderBy(ts, tie)
    return rows.withColumn("in_stretch", F.row_number().over(within) - 1).join(counts, [*keys, "stretch"]).withColumn(
        "n", (F.col("stretch_start") + F.col("in_stretch")).cast("bigint"),
    ).drop("stretch", "stretch_start", "in_stretch")


def scene_windows(frames: DataFrame, length: int = 50, stride: int | None = None, least: int = 20, width: int = 3_600_000_000_000) -> DataFrame:
    """frames with scene_index and n: count windows of length frames of a run, one each stride frames (length if not given).

    A smaller stride makes windows overlap, a larger one leaves gaps. Windows of fewer than least frames are dropped.
    """
    step = stride or length
    placed = positions(frames, ["run"], "ts_ns", "frame_id", width)
    totals = placed.groupBy("run").agg(F.max("n").alias("last"))
    placed = placed.join(totals, "run")
    first = F.greatest(F.lit(0), F.ceil((F.col("n") - (length - 1)) / step))
    placed = placed.withColumn("low", first.cast("bigint")).withColumn("high", F.floor(F.col("n") / step).cast("bigint")).filter("low <= high")
    placed = placed.withColumn("scene_index", F.explode(F.sequence("low", "high")))
    size = F.least(F.lit(length), F.col("last") + 1 - F.col("scene_index") * step)
    return placed.filter((size >= least) & (F.col("n") < F.col("scene_index") * step + length)).drop("last", "low", "high")


def scenes(windows: DataFrame) -> DataFrame:
    """run, scene_index, n_frames, first_ns, last_ns, duration_s."""
    return windows.groupBy("run", "scene_index").agg(
        F.count("*").alias("n_frames"), F.min("ts_ns").alias("first_ns"), F.max("ts_ns").alias("last_ns"),
    ).withColumn("duration_s", F.round((F.col("last_ns") - F.col("first_ns")) / 1e9, 3))


def rows_in_scenes(track: DataFrame, scene: DataFrame, width: int = 60_000_000_000) -> DataFrame:
    """Track rows of a run within [first_ns, last_ns] of its scenes, as an equi-join on run and stretches of time plus the exact test."""
    by = scene.withColumn("stretch", F.explode(F.sequence(F.floor(F.col("first_ns") / width), F.floor(F.col("last_ns") / width))))
    return track.withColumn(
        "stretch", F.floor(F.col("ts_ns") / width),
    ).join(by, ["run", "stretch"]).filter("ts_ns BETWEEN first_ns AND last_ns").drop("stretch")


def span(rows: DataFrame, keys: list[str], axes: list[str]) -> DataFrame:
    """Largest less smallest value of each axis, to 3 places."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n_rows"), *[F.round(F.max(a) - F.min(a), 3).alias(f"{a}_span") for a in axes])


def ingest_report(paired: DataFrame) -> DataFrame:
    """By run: images, those without point cloud, without label, whether any label exists."""
    return paired.groupBy("run").agg(
        F.count("*").alias("requested"),
        F.count_if(F.col("lidar_path").isNull()).alias("missing_lidar"),
        F.count_if(F.col("label_path").isNull()).alias("missing_label"),
        F.bool_or(F.col("label_path").isNotNull()).alias("has_labels"),
    )


def build_scenes(paired: DataFrame, track: DataFrame, length: int = 50, stride: int | None = None, least: int = 20) -> DataFrame:
    """Scenes of runs, one row each: their frames in order, what was left out of them, and their track.

    paired: pair_frames with poses, whose T4x4 is the camera's place in the world. Windows count all images; frames
    without a pose are counted and left out, and only the others count for the rest. scene_id, split_group; frames
    (frame_id, timestamp_ns, image_uri, original_size, K, pose, lidar_uri, lidar_ns, labels); annotations (the kinds of
    labels that any frame has); frames_requested, frames_emitted, frames_missing_pose, frames_missing_lidar,
    duration_s, track_samples, span (of camera places, by axis); err where no frame is left. A row holds at most
    length frames.
    """
    windows = scene_windows(paired.withColumn("frame_id", F.col("stem")), length, stride, least)
    there, t = F.col("pose").isNotNull(), F.col("pose")["T4x4"]
    at = [F.when(there, F.get(F.get(t, F.lit(k)), F.lit(3))) for k in range(3)]
    last = lambda c: F.element_at(F.split(c, "/"), -1)
    frame = F.struct(
        "n",
        "frame_id",
        F.col("ts_ns").alias("timestamp_ns"),
        F.concat(F.lit("images/"), last("path")).alias("image_uri"),
        F.array("pose.Height", "pose.Width").alias("original_size"),
        F.col("pose.P3x3").alias("K"),
        t.alias("pose"),
        F.concat(F.lit("lidar/"), last("lidar_path")).alias("lidar_uri"), "lidar_ns", F.concat(F.lit("labels_cam/"), last("label_path")).alias("semantic_2d"), F.concat(
            F.lit("labels_lidar/"), last("cloud_label_path"),
        ).alias("semantic_3d"),
    )
    has = lambda c, kind: F.when(F.max((there & F.col(c).isNotNull()).cast("int")) == 1, kind)
    scene = windows.groupBy("run", "scene_index").agg(
        F.count("*").alias("frames_requested"),
        F.count_if(there).alias("frames_emitted"),
        F.count_if(~there).alias("frames_missing_pose"),
        F.count_if(there & F.col("lidar_path").isNull()).alias("frames_missing_lidar"),
        F.min(F.when(there, F.col("ts_ns"))).alias("first_ns"), F.max(F.when(there, F.col("ts_ns"))).alias("last_ns"),
        F.array(*[F.round(F.max(a) - F.min(a), 3) for a in at]).alias("span"),
        F.array_compact(F.array(has("label_path", "semantic_2d"), has("cloud_label_path", "semantic_3d"))).alias("annotations"),
        F.array_sort(F.collect_list(F.when(there, frame))).alias("frames"),
    )
    counted = rows_in_scenes(
        track.select("run", "ts_ns"), scene.select("run", "scene_index", "first_ns", "last_ns").filter("first_ns is not null"),
    ).groupBy("run", "scene_index").agg(F.count("*").alias("track_samples"))
    out = scene.join(counted, ["run", "scene_index"], "left")
    return out.select(
        F.format_string(
            f"{DATASET}_%s_%04d", F.regexp_replace("run", "interval5_", ""), "scene_index",
        ).alias("scene_id"), split_group(F.col("run")).alias("split_group"), "run", "scene_index", "frames", "annotations",
        "frames_requested", "frames_emitted", "frames_missing_pose", "frames_missing_lidar", F.round(
            (F.col("last_ns") - F.col("first_ns")) / 1e9, 3,
        ).alias("duration_s"),
        F.coalesce("track_samples", F.lit(0)).cast("bigint").alias("track_samples"), "span", F.when(
            F.col("frames_emitted") == 0, "no frame has a pose",
        ).alias("err"),
    )
