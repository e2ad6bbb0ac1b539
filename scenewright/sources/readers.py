"""Files that recordings and scene layers come in, with explicit schemas; nothing is inferred."""

from __future__ import annotations

import io
import re
import tempfile
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scenewright.functions import text as T

POSES = "OriginalImageName string, Height int, Width int, P3x3 array<array<double>>, K1 double, K2 double, P1 double, P2 double, K3 double, T4x4 array<array<double>>"
TRACK = "headerstamp string, lat double, lon double, alt double, easting double, northing double"
VEC = "array<double>"
OBJECT = f"struct<object_id:string,category:string,geometry:struct<centroid:{VEC},obb:struct<center:{VEC},extent:{VEC},axes:array<{VEC}>>,centerline:array<{VEC}>>,visibility:struct<visible_frames:array<string>>,confidence:struct<semantic:double,detector_box:double,mask:double,geometry:double,association:double,cross_view_support:double>>"
OBSERVATION = "struct<observation_id:string,frame_id:string,mask_or_box:string,category_candidates:array<string>>"
LAYERS = {
    "l0_geometry": "scene_id string, scale struct<depth_type:string,domain_calibrated:boolean,anchor_provenance_verified:boolean>, depth array<struct<role:string,producer:struct<name:string>>>, invalid_geometry struct<combined_uri:string,reason_masks:map<string,string>>",
    "l1_entities": f"scene_id string, cameras array<struct<pose_id:string,position:{VEC},forward:{VEC},up:{VEC}>>, objects array<{OBJECT}>, surfaces array<struct<surface_id:string>>, regions array<struct<region_id:string>>",
    "l2_relations": f"scene_id string, cameras array<struct<pose_id:string,position:{VEC},forward:{VEC},up:{VEC}>>, relations array<struct<relation_id:string,subject_id:string,object_id:string,derivation:struct<program:string>>>, cross_view_links array<struct<link_id:string,entity_id:string,same_entity:boolean,probability:double,point_support_iou:double,observation_a:{OBSERVATION},observation_b:{OBSERVATION}>>",
    "metadata_snapshot": "scene_id string, snapshot_id string, split_group_id string, layers map<string,struct<uri:string,schema_version:string,content_sha256:string>>, capabilities struct<scale_status:string,depth_type:string,metric_task_eligible:boolean,available_entity_types:array<string>,camera_baseline_m:double,parallax_ratio:double,nadir_angle_median_deg:double,depth_relief_ratio:double,domain_calibrated:boolean>",
}

_MEMBERS = pa.schema([("archive", pa.string()), ("path", pa.string()), ("content", pa.binary())])


def read_members(spark: SparkSession, folder: str) -> DataFrame:
    """archive and path of every file below folder/<archive>/, without reading contents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
    below = F.substring_index(F.col("path"), folder.rstrip("/").rpartition("/")[2] + "/", -1)
    return files.select(F.substring_index(below, "/", 1).alias("archive"), below.alias("path"))


def read_archives(spark: SparkSession, folder: str, wanted: str | None = None) -> DataFrame:
    """archive, path and content of every member of the zip files in a folder; content is null but for paths like wanted (a regular expression).

    An archive is one row of binaryFile, so it may have 2 GB at most; its members are listed and unpacked by the task
    that reads it. A file that is no zip archive fails the job.
    """

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = re.compile(wanted) if wanted else None
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                with zipfile.ZipFile(io.BytesIO(content.as_buffer())) as z:
                    for m in z.infolist():
                        if m.is_dir():
                            continue
                        got = z.read(m) if pattern and pattern.search(m.filename) else None
                        yield pa.RecordBatch.from_pylist(
                            [{"archive": path.rpartition("/")[2].removesuffix(".zip"), "path": m.filename, "content": got}], schema=_MEMBERS,
                        )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(folder).select("path", "content")
    return files.mapInArrow(members, "archive string, path string, content binary")


def _run_of(path: Column) -> Column:
    """The folder that a file of a run lies in."""
    return F.element_at(F.split(path, "/"), -2)


def _stem(image: Column) -> Column:
    return F.regexp_replace(image, r"\.jpg$", "")


def read_poses(spark: SparkSession, path: str) -> DataFrame:
    """run, stem, pos, and pose columns of JSON arrays of poses; the last of repeated names has the largest pos.

    A file is read by one task, so pos follows its order.
    """
    rows = spark.read.schema(POSES).option("multiLine", "true").json(path).withColumn("run", _run_of(F.col("_metadata.file_path")))
    return rows.withColumn("pos", F.monotonically_increasing_id()).withColumn("stem", _stem(F.col("OriginalImageName"))).drop("OriginalImageName")


def poses_of(files: DataFrame) -> DataFrame:
    """The same of unpacked members with path and content."""
    rows = files.select(
        _run_of(F.col("path")).alias("run"),
        F.posexplode(F.from_json(F.col("content").cast("string"), f"array<struct<{POSES.replace(' ', ':')}>>".replace(",:", ","))).alias("pos", "p"),
    )
    return rows.select("run", F.col("pos").cast("bigint").alias("pos"), _stem(F.col("p.OriginalImageName")).alias("stem"), "p.*").drop("OriginalImageName")


TRACK_ROWS = "run string, ts_ns bigint, lat double, lon double, alt double, easting double, northing double"


def read_track(spark: SparkSession, path: str) -> DataFrame:
    """run, ts_ns and position columns of CSV tracks with a header; a path without files gives no rows."""
    jvm = spark.sparkContext._jvm
    pattern = jvm.org.apache.hadoop.fs.Path(path)
    found = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern)
    if not found:
        return spark.createDataFrame([], TRACK_ROWS)
    rows = spark.read.schema(TRACK).option("header", "true").csv(path)
    return rows.select(
        _run_of(F.col("_metadata.file_path")).alias("run"), T.ns_of(F.col("headerstamp")).alias("ts_ns"), "lat", "lon", "alt", "easting", "northing",
    )


def track_of(files: DataFrame) -> DataFrame:
    """The same of unpacked members with path and content; columns are found by the names in the header."""
    lines = F.filter(F.split(F.col("content").cast("string"), r"\r?\n"), lambda x: x != "")
    rows = files.select(
        _run_of(F.col("path")).alias("run"), F.split(F.get(lines, F.lit(0)), ",").alias("names"), F.explode(F.slice(lines, 2, 1 << 30)).alias("line"),
    )
    cell = lambda n: F.try_element_at(F.map_from_arrays("names", F.split("line", ",")), F.lit(n))
    return rows.select(
        "run", T.ns_of(cell("headerstamp")).alias("ts_ns"), *[cell(n).cast("double").alias(n) for n in ("lat", "lon", "alt", "easting", "northing")]
    )


def read_layer(spark: SparkSession, path: str, layer: str) -> DataFrame:
    """One document per file of a scene layer; fields outside the schema are left out."""
    return spark.read.schema(LAYERS[layer]).option("multiLine", "true").json(path)


def packages(l1: DataFrame, l2: DataFrame, snapshots: DataFrame, asked: DataFrame) -> DataFrame:
    """Scene packages for the compiler; asked: scene_id, observer_pose_id, question, visual_inputs, pointcloud_ref.

    Cameras are those of the entity layer, then those of the relation layer. Scenes without a snapshot are left out.
    """
    s = snapshots.select("scene_id", F.col("capabilities").alias("caps"))
    first = l1.select("scene_id", F.col("cameras").alias("own"), "objects", "surfaces", "regions")
    second = l2.select("scene_id", F.col("cameras").alias("more"), F.col("cross_view_links").alias("links"))
    out = s.join(first, "scene_id").join(second, "scene_id", "left").join(asked, "scene_id")
    none = lambda c: F.coalesce(F.col(c), F.array())
    return out.withColumn("cameras", F.concat(none("own"), none("more"))).drop("own", "more")


def layer_refs(spark: SparkSession, path: str, schema_version: str = "0.1.0") -> DataFrame:
    """uri, schema_version, content_sha256 of each file."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.col("path").alias("uri"), F.lit(schema_version).alias("schema_version"), F.sha2("content", 256).alias("content_sha256"))


def write_documents(df: DataFrame, path: str) -> None:
    """Rows as JSON documents, write-once; null fields are left out."""
    df.write.mode("errorifexists").json(path)


PIXELS = "scene_id string, frame bigint, y bigint, x bigint, depth float, conf float"


def write_pixels(pixels: DataFrame, path: str) -> None:
    """Depth and confidence of every pixel, write-once, by scene; single precision, which holds what half precision did."""
    pixels.select(
        "scene_id", "frame", "y", "x", F.col("depth").cast("float").alias("depth"), F.col("conf").cast("float").alias("conf"),
    ).write.mode("errorifexists").partitionBy("scene_id").parquet(path)


def read_pixels(spark: SparkSession, path: str) -> DataFrame:
    """The same back; a filter on scene_id reads that scene's files only."""
    return spark.read.schema(PIXELS).parquet(path).select(*[f.split()[0] for f in PIXELS.split(", ")])


def write_records(compiled: DataFrame, path: str) -> None:
    """Outcomes of compiling by status, so that each channel is read without the others."""
    compiled.write.mode("errorifexists").partitionBy("status").parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, in which files between steps lie. Only in a local session where that is unset, it is a temporary one."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(found or tempfile.mkdtemp(prefix="scenewright-"))
    return context.getCheckpointDir()


def materialized(df: DataFrame) -> DataFrame:
    """df written once as a checkpoint in the shared folder, for plans that several others start from."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """uri and content of JSON files, one document each and whole, for plans/schemas.py."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("uri"), F.col("value").alias("content"))
