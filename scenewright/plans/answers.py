"""What an answer's JSON must be for each kind of task: one condition per rule, over the text of the answer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from scenewright.functions import text as T


def _get(answer: Column, key: str) -> Column:
    return F.get_json_object(answer, f"$.{key}")


def _has(answer: Column, *keys: str) -> Column:
    return F.forall(F.array(*[F.lit(k) for k in keys]), lambda k: F.array_contains(F.json_object_keys(answer), k))


def _only(answer: Column, *keys: str) -> Column:
    return F.size(F.array_except(F.json_object_keys(answer), F.array(*[F.lit(k) for k in keys]))) == 0


def _absent_or(answer: Column, key: str, good: Callable[[Column], Column]) -> Column:
    return ~_has(answer, key) | F.coalesce(good(_get(answer, key)), F.lit(False))


def _is_number(answer: Column, key: str, low: float, high: float = float("inf")) -> Column:
    """A JSON number, not a text that looks like one."""
    bare = answer.rlike(rf'"{key}"\s*:\s*-?[0-9]')
    return _absent_or(answer, key, lambda v: bare & v.try_cast("double").between(low, high))


def _one_of(*values: str) -> Callable[[Column], Column]:
    return lambda v: v.isin(*values)


def answer_rules(schema: str, answer: Column) -> dict[str, Column]:
    """Named conditions of one of the four answer schemas. Any rule but "object" presumes that the text is a JSON object."""
    confidence = {"confidence": _is_number(answer, "confidence", 0, 1)}
    rules = {"object": F.json_object_keys(answer).isNotNull()}
    if schema == "grounding_object_answer":
        one = _has(answer, "object_id") & _only(answer, "object_id", "evidence_frames", "confidence") & T.valid_id(_get(answer, "object_id"))
        ids = F.from_json(_get(answer, "candidate_ids"), "array<string>")
        many = _has(answer, "ambiguous") & _only(answer, "ambiguous", "candidate_ids", "reason") & (_get(answer, "ambiguous") == "true") & (
            ~_has(answer, "candidate_ids") | ((F.size(ids) >= 2) & F.forall(ids, T.valid_id))
        )
        return rules | {"one object or ambiguous": F.coalesce(one, F.lit(False)) | F.coalesce(many, F.lit(False)), **confidence}
    if schema == "vqa_metric_distance_answer":
        return rules | {
            "keys": _has(answer, "object_id", "distance_m", "unit") & _only(answer, "object_id", "distance_m", "unit", "evidence_fields", "confidence"),
            "object_id": T.valid_id(_get(answer, "object_id")),
            "distance_m": _is_number(answer, "distance_m", 0),
            "unit": _get(answer, "unit") == "meter",
            **confidence,
        }
    if schema == "vqa_situated_direction_answer":
        return rules | {
            "keys": _has(answer, "longitudinal", "lateral") & _only(
                answer, "longitudinal", "lateral", "vertical", "observer_pose_id", "confidence",
            ), "longitudinal": _get(answer, "longitudinal").isin("front", "behind"), "lateral": _get(answer, "lateral").isin("left", "right", "ambiguous"),
            "vertical": _absent_or(
                answer, "vertical", _one_of("above", "below"),
            ), "observer_pose_id": _absent_or(answer, "observer_pose_id", T.valid_id), **confidence,
        }
    if schema == "cross_view_correspondence_answer":
        return rules | {
            "keys": _has(answer, "same_entity") & _only(
                answer, "same_entity", "confidence", "reason", "insufficient_evidence",
            ), "same_entity": _get(answer, "same_entity").isin("true", "false"), "reason": _absent_or(answer, "reason", lambda v: F.length(v) <= 500),
            "insufficient_evidence": _absent_or(answer, "insufficient_evidence", _one_of("true", "false")), **confidence,
        }
    raise KeyError(f"unknown answer schema {schema!r}")
