"""Compiled records as samples for three kinds of model; what a model sees and what grades it stay in separate columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenewright.plans import leakage
from scenewright.plans.compiler import held

CLOUD_MARK = "<point_cloud>"


def verification() -> Column:
    """What grading needs, kept apart from the payload."""
    return F.struct("target", "checker", "target_geometry", "is_ambiguous", "equivalent", F.split("spec_id", "@")[0].alias("task_spec_id"))


def choice_lines(choices: Column) -> Column:
    return F.array_join(F.transform(choices, lambda c: F.concat(c["key"], F.lit(". "), c["text"])), "\n")


def answer_key(choices: Column, values: Column) -> Column:
    """Key of the first choice whose text equals any of the answer's values, case aside."""
    low = F.transform(values, F.lower)
    return F.get(F.filter(choices, lambda c: F.array_contains(low, F.lower(c["text"]))), F.lit(0))["key"]


def answer_values() -> Column:
    t = F.col("target")
    return F.array_compact(F.array(t["object_id"], t["lateral"], t["longitudinal"], F.when(t["same_entity"], "True").when(~t["same_entity"], "False")))


def answer_text() -> Column:
    """k=v; k=v of the answer's parts, without its type."""
    t = F.col("target")
    parts = [
        F.concat(F.lit(f"{n}="), t[n].cast("string")) for n in (
            "object_id",
            "minimum_distance",
            "nearest_segment_index",
            "distance_to_observer",
            "longitudinal",
            "lateral",
            "lateral_angle_deg",
            "same_entity",
            "point_support_iou",
        )
    ]
    return F.concat_ws("; ", *parts)


#: The form of an answer that a model is asked for, by the beginning of a task's id or a part of it.
HINTS = (
    ("3d_grounding", True, '{"object_id": "<obj_XXX>"}'),
    ("observer_relative_direction", False, '{"longitudinal": "front|behind", "lateral": "left|right|ambiguous"}'),
)


def answer_hint(spec_id: Column) -> Column:
    """The form of answer that a task asks for; an empty object where there is none."""
    out = F.lit("{}")
    for word, first, hint in reversed(HINTS):
        out = F.when(spec_id.startswith(word) if first else spec_id.contains(word), hint).otherwise(out)
    return out


def _chat(rows: DataFrame) -> tuple[DataFrame, Column, tuple[str, ...]]:
    """Question and answer as turns about a point cloud; the answering turn is the label and may hold the answer."""
    has = F.size("choices") > 0
    human = F.when(F.col("question").contains(CLOUD_MARK), F.col("question")).otherwise(F.concat(F.lit(f"{CLOUD_MARK}\n"), "question"))
    human = F.when(has, F.concat(human, F.lit("\n"), choice_lines(F.col("choices")))).otherwise(human)
    rows = rows.withColumn("key", answer_key(F.col("choices"), answer_values()))
    label = F.when(has, F.col("key")).otherwise(answer_text())
    err = F.when(F.col("pointcloud_ref").isNull(), "no point cloud").when(F.col("question").isNull(), "no question").when(
        has & F.col("key").isNull(), "no choice is the answer",
    )
    turns = F.array(F.struct(F.lit("human").alias("from"), human.alias("value")), F.struct(F.lit("gpt").alias("from"), label.alias("value")))
    payload = F.struct(F.col("sample_id").alias("sample_id"), F.col("pointcloud_ref").alias("point_cloud"), turns.alias("conversations"))
    return rows.withColumn("err", err).withColumn("bare", F.struct(F.col("question").alias("asked"))), payload, ("conversations[1].value",)


def _views(rows: DataFrame) -> tuple[DataFrame, Column, tuple[str, ...]]:
    """Images and metadata, never the point cloud."""
    err = F.when(F.coalesce(F.size("visual_inputs"), F.lit(0)) < 1, "no image").when(F.col("question").isNull(), "no question")
    return rows.withColumn("err", err), F.struct(
        "sample_id",
        F.split("spec_id", "@")[0].alias("task_spec_id"),
        F.col("visual_inputs").alias("images"),
        F.col("visible").alias("metadata"),
        "question",
        "choices",
    ), ("metadata",)


def _all(rows: DataFrame) -> tuple[DataFrame, Column, tuple[str, ...]]:
    err = F.when(F.col("question").isNull(), "no question")
    return rows.withColumn("err", err), F.struct(
        "sample_id",
        F.split("spec_id", "@")[0].alias("task_spec_id"),
        F.col("visual_inputs").alias("images"),
        F.col("pointcloud_ref").alias("point_cloud"),
        F.col("visible").alias("metadata"),
        "question",
        "choices",
    ), ("metadata",)


ADAPTERS: dict[str, Callable[[DataFrame], tuple[DataFrame, Column, tuple[str, ...]]]] = {
    "pointcloud_native": _chat, "qwen_2d_metadata": _views, "multimodal_3d": _all,
}


def render(records: DataFrame, adapter: str) -> DataFrame:
    """sample_id, adapter, status (rendered, unsupported, failed), detail, payload (JSON), verification.

    Every payload is scanned for the answer; ids that the specification shows by design don't count, nor does the
    label of a conversation, nor the list of choices. Choices, if the records have none, are empty.
    """
    if adapter not in ADAPTERS:
        raise KeyError(f"unknown adapter {adapter!r}")
    rows = records.filter("status = 'record'")
    if "choices" not in rows.columns:
        rows = rows.withColumn("choices", F.array().cast("array<struct<key:string,text:string>>"))
    rows, payload, exempt = ADAPTERS[adapter](rows)
    # of a chat with choices the question alone is scanned, since the human turn lists them all
    rows = held(rows, payload=payload)
    wanted = leakage.atoms(F.col("target"), rows.schema["target"].dataType, keep_ids=F.size("structural_ids") == 0)
    wanted = F.when(F.length("derivation_program") >= leakage.LEAST_TEXT, F.array_union(wanted, F.array("derivation_program"))).otherwise(wanted)
    rows = held(rows.drop("wanted"), wanted=wanted)
    found = leakage.findings(F.col("payload"), rows.schema["payload"].dataType, F.col("wanted"), exempt)
    if adapter == "pointcloud_native":
        only = leakage.findings(F.col("payload"), rows.schema["payload"].dataType, F.col("wanted"), (*exempt, "conversations[0].value"))
        asked = leakage.findings(F.col("bare"), rows.schema["bare"].dataType, F.col("wanted"))
        found = F.when(F.size("choices") > 0, F.concat(only, asked)).otherwise(found)
    else:
        # the metadata is text by now: its numbers were compared as numbers when it was compiled, other atoms are looked for again
        rows = held(rows, shown=F.struct(F.col("visible").alias("metadata")), names=F.filter("wanted", lambda a: a.try_cast("double").isNull()))
        found = F.concat(found, leakage.findings(F.col("shown"), rows.schema["shown"].dataType, F.col("names")))
    rows = held(rows, leaks=found)
    supported = F.array_contains("adapters", adapter)
    status = F.when(~supported, "unsupported").when(F.col("err").isNotNull() | (F.size("leaks") > 0), "failed").otherwise("rendered")
    good = status == "rendered"
    return rows.select(
        "sample_id",
        "scene_id",
        "spec_id",
        F.lit(adapter).alias("adapter"),
        status.alias("status"),
        F.when(supported, F.coalesce("err", F.get("leaks", F.lit(0)))).alias("detail"),
        F.when(good, F.to_json("payload")).alias("payload"),
        F.when(good, verification()).alias("verification"),
    )
