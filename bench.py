"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

from pyspark.sql import SparkSession

HERE = Path(__file__).resolve().parent
sys.path.insert(0, str(HERE))
os.environ["PYTHONPATH"] = f"{HERE}:{os.environ.get('PYTHONPATH', '')}"

from scenewright import queries  # noqa: E402

HEADLINE = [
    "s6_paired_frames",
    "w1_scene_windows",
    "j4_track_in_scenes",
    "d3_farthest_object",
    "g3_nearest_polyline",
    "g10_relative_direction",
    "a3_oriented_boxes",
    "a8_depth_statistics",
    "e3_components",
    "a5_objects_of_components",
    "a6_merge_objects",
    "j11_close_pairs",
    "e5_fused_instances",
    "v1_entity_issues",
    "k1_compile_grounding",
    "k1_compile_distance",
    "r4_rendered_samples",
    "c1_check_distance",
    "a18_lift_report",
    "x_release_distribution",
]


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries.d3_farthest_object(spark, sf).write.format("noop").mode("overwrite").save()  # starts what every query needs
    took = {}
    for name in HEADLINE:
        began = time.time()
        queries.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
