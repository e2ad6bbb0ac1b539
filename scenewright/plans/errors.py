"""The error catalogue: names, codes, and what a gate makes of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Every error's name and code; the letter is E for hard, W for warning, S for stop.
CODES = {
    "UNREADABLE_FILE": "G0-E01",
    "UNKNOWN_SOURCE_IDENTITY": "G0-E02",
    "DATASET_ALIAS_COLLISION": "G0-E03",
    "UNSUPPORTED_HIGH_ALTITUDE_SOURCE": "G0-E04",
    "SPLIT_LEAKAGE": "G0-E05",
    "MISSING_REQUIRED_MODALITY": "G0-E06",
    "CHECKSUM_MISMATCH": "G0-E07",
    "LICENSE_BLOCKS_INTENDED_USE": "G0-S01",
    "LICENSE_UNRESOLVED": "G0-S02",
    "SCALE_CLAIM_INCONSISTENT": "G0-E08",
    "INSUFFICIENT_VIEW_OVERLAP": "G0-W01",
    "TIMESTAMP_MISALIGNMENT": "G0-W02",
    "UNKNOWN_COORDINATE_FRAME": "G1-E01",
    "CONFLICTING_SCALE_CLAIM": "G1-E02",
    "RECONSTRUCTION_UNUSABLE": "G1-E03",
    "MISSING_PREPROCESSING_TRANSFORM": "G1-E04",
    "EXPERT_NOT_APPROVED_FOR_USE": "G1-S01",
    "DEGENERATE_GEOMETRY_SIGNATURE": "G1-W01",
    "BROKEN_ID_REFERENCE": "G2-E01",
    "DUPLICATE_ENTITY_ID": "G2-E02",
    "MISSING_PROVENANCE": "G2-E03",
    "INVALID_GEOMETRY_VALUE": "G2-E04",
    "DERIVED_FIELD_NOT_RECOMPUTABLE": "G2-E05",
    "REASON_MASKS_COLLAPSED": "G2-E06",
    "CONFIDENCE_COMPONENTS_COLLAPSED": "G2-E07",
    "DYNAMIC_PROB_NOT_RESIDUAL_BASED": "G2-E08",
    "THIN_OBSTACLE_EVIDENCE_INSUFFICIENT": "G2-W01",
    "CIRCULAR_VALIDATION_DETECTED": "G2-E09",
    "THREE_D_NECESSITY_FAILED": "G3-E01",
    "LOW_ALTITUDE_CLAIM_UNSUPPORTED": "G3-E02",
    "TARGET_LEAKAGE": "G3-E03",
    "NON_UNIQUE_ANSWER": "G3-E04",
    "MISSING_CHECKER": "G3-E05",
    "SCENE_CAPABILITY_UNMET": "G3-E06",
    "TARGET_NOT_RECOMPUTABLE": "G3-E07",
    "METRIC_TASK_ON_NONMETRIC_SCENE": "G3-E08",
    "QUALITY_THRESHOLD_LOWERING_REQUIRED": "G3-S01",
    "SCHEMA_UNREPAIRABLE": "G4-E01",
    "NONEXISTENT_ENTITY_REFERENCE": "G4-E02",
    "INVALID_UNIT": "G4-E03",
    "FORMAT_REPAIRED": "G4-W01",
    "CHECKER_DISAGREEMENT": "G5-E01",
    "INSUFFICIENT_EVIDENCE": "G5-E02",
    "UNSUPPORTED_CLAIM": "G5-E03",
    "AMBIGUITY_UNMARKED": "G5-E04",
    "TWO_D_SHORTCUT_DETECTED": "G5-E05",
    "SEMANTIC_REWRITTEN": "G5-W01",
    "LEAKAGE_RATE_EXCEEDED": "G6-E01",
    "DUPLICATE_RATE_EXCEEDED": "G6-E02",
    "DEPENDENCY_TEST_FAILED": "G6-E03",
    "DISTRIBUTION_FAILURE": "G6-E04", "DERIVATIVE_LICENSE_UNRESOLVED": "G6-S01",
}


def catalog(spark: SparkSession) -> DataFrame:
    """code, name, gate, severity, gate_status: a warning warns, anything else quarantines. A fixed small table, so it may be broadcast."""
    kinds = {"E": "hard", "W": "warning", "S": "stop"}
    rows = [(code, name, code[:2], kinds[code[3]], "warn" if code[3] == "W" else "quarantine") for name, code in CODES.items()]
    return spark.createDataFrame(rows, "code string, name string, gate string, severity string, gate_status string")


def judged(found: DataFrame, code: str = "code") -> DataFrame:
    """found with name, gate, severity and gate_status of each row's code. A code that the catalogue hasn't, or none, is quarantined and has no name."""
    of = catalog(found.sparkSession).withColumnRenamed("code", "_code")
    return found.join(F.broadcast(of), F.col(code) == F.col("_code"), "left").drop("_code").withColumn("gate_status", F.coalesce("gate_status", F.lit("quarantine")))
