"""Artifacts and their states: transitions, ids that are never used twice, lineage, write-once sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scenewright.functions import text as T
from scenewright.sources.readers import materialized

#: States in their order with the gate that leads into each.
ORDER = [
    ("REGISTERED", None),
    ("SAMPLE_VERIFIED", "G0"),
    ("INGESTED", "G0"),
    ("GEOMETRY_READY", "G1"),
    ("EXPERT_OUTPUTS_READY", "G1"),
    ("METADATA_FUSED", "G2"),
    ("METADATA_VALIDATED", "G2"),
    ("TASK_COMPILED", "G3"),
    ("MODEL_OUTPUT_READY", "G4"),
    ("SAMPLE_VALIDATED", "G5"),
    ("RELEASE_CANDIDATE", "G5"),
    ("RELEASED", "G6"),
]
FINAL = ("RELEASED", "REJECTED")
PROGRESS = ("pass", "warn")


def transitions(spark: SparkSession) -> DataFrame:
    """from_state, to_state, gate (null: none needed): a fixed table of a few dozen rows."""
    rows = [(a, b, gate) for (a, _), (b, gate) in zip(ORDER, ORDER[1:], strict=False)]
    rows += [(s, out, None) for s, _ in ORDER if s not in FINAL for out in ("QUARANTINED", "REJECTED")]
    rows += [("QUARANTINED", "REGISTERED", None), ("QUARANTINED", "REJECTED", None)]
    return spark.createDataFrame(rows, "from_state string, to_state string, gate string")


def judge_transitions(moves: DataFrame) -> DataFrame:
    """moves with columns from_state, to_state, gate_status: allowed, and why not."""
    table = F.broadcast(transitions(moves.sparkSession).withColumn("known", F.lit(True)))
    out = moves.join(table, ["from_state", "to_state"], "left")
    why = (
        F.when(F.col("known").isNull(), F.when(F.col("from_state").isin(*FINAL), "final state").otherwise("no such transition"))
        .when(F.col("gate").isNotNull() & F.col("gate_status").isNull(), "gate report missing")
        .when(F.col("gate").isNotNull() & ~F.col("gate_status").isin(*PROGRESS), "gate does not let pass")
    )
    return out.withColumn("why_not", why).withColumn("allowed", why.isNull()).drop("known")


def mint_ids(rows: DataFrame, order: list[str], taken: DataFrame, start: int = 1) -> DataFrame:
    """rows with entity_id, numbered in the order given, on from the largest number their namespace has in taken (entity_id). Numbers are never used again.

    Rows are dealt by ranges of (namespace, order) and stored, so that a range's rows stay its own; ranges are counted
    first, then each numbers its rows, and no task numbers a whole namespace.
    """
    used = taken.select(
        T.parse_id(F.col("entity_id")).alias("id")
    ).filter("id is not null").groupBy(F.col("id.ns").alias("namespace")).agg(F.max("id.num").alias("last"))
    spread = materialized(rows.repartitionByRange("namespace", *order).withColumn("bucket", F.spark_partition_id()))
    counts = spread.groupBy("namespace", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("namespace").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("namespace", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("namespace", "bucket").orderBy(*order)
    out = spread.withColumn("k", F.row_number().over(within)).join(counts, ["namespace", "bucket"]).join(used, "namespace", "left")
    number = F.greatest(F.coalesce(F.col("last") + 1, F.lit(start)), F.lit(start)) + F.col("offset") + F.col("k") - 1
    return out.withColumn("entity_id", F.format_string("<%s_%03d>", "namespace", number.cast("bigint"))).drop("bucket", "offset", "k", "last")


def derive(artifacts: DataFrame, kind: str, *content: Column) -> DataFrame:
    """New artifacts made from each row: the parent chain grows by the row's id, and the new id follows from content and parents."""
    parents = F.concat(F.col("parents"), F.array("artifact_id"))
    digest = F.sha2(F.concat_ws("|", F.lit(kind), F.array_join(parents, ","), *content), 256)
    return artifacts.select(
        F.concat(F.lit(f"{kind}_"), F.substring(digest, 1, 12)).alias("artifact_id"),
        F.lit(kind).alias("kind"),
        parents.alias("parents"),
        digest.alias("content_sha256"),
    )


def append_new(artifacts: DataFrame, path: str) -> DataFrame:
    """Artifacts whose id isn't in the table at path yet; what is there never changes."""
    there = artifacts.sparkSession.read.parquet(path).select("artifact_id")
    return artifacts.join(there, "artifact_id", "left_anti")


def write_once(df: DataFrame, path: str) -> None:
    """Write, or fail if anything is there."""
    df.write.mode("errorifexists").parquet(path)
