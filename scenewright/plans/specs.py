"""Task specifications: YAML files, read and checked on the driver when a plan is made."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path
from typing import Any

import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HERE = Path(__file__).parent / "task_specs"
#: Fixed values of the file format from here on: required keys and allowed words.
REQUIRED = (
    "task_id", "version", "task_family", "generation_mode",
    "three_d_necessity", "required_scene_capabilities", "visual_input_policy",
    "metadata_input_fields", "hidden_target_fields", "derivation_program",
    "checker", "output_schema", "leakage_rules", "eligibility",
    "quality_requirements", "supervision_level", "target_anchor",
)
MODES = ("program_first", "hybrid", "model_first_constrained")
LEVELS = ("strong", "deterministic_derived", "filtered_pseudo", "weak", "language_generated")
ANSWER_SCHEMAS = ("grounding_object_answer", "vqa_metric_distance_answer", "vqa_situated_direction_answer", "cross_view_correspondence_answer")


#: Levels of supervision whose samples may be used for evaluation as they are.
EVALUABLE = ("strong", "deterministic_derived")


def for_evaluation(level: Column) -> Column:
    """Whether a sample of this level may be used for evaluation; an unknown or missing level may not."""
    return F.coalesce(level.isin(*EVALUABLE), F.lit(False))


class SpecError(ValueError):
    """A specification breaks a rule; nothing is compiled from it."""


@dataclass(frozen=True)
class Spec:
    raw: dict[str, Any]

    @property
    def qualified_id(self) -> str:
        return f"{self.raw['task_id']}@{self.raw['version']}"

    @property
    def visible(self) -> list[str]:
        return list(self.raw["metadata_input_fields"])

    @property
    def tolerance(self) -> float | None:
        return self.raw["quality_requirements"].get("numeric_tolerance_m")

    @property
    def deadzone(self) -> float:
        return float(self.raw["quality_requirements"].get("lateral_deadzone_deg") or 10.0)

    @property
    def shows_ids(self) -> bool:
        """Whether ids of candidates are part of the input, so that an answer's id is among them by design."""
        return any(f.rpartition(".")[2] in ("object_id", "observation_id", "surface_id", "region_id") for f in self.visible)


def problems(raw: Any, programs: set[str], checkers: set[str], schemas: tuple[str, ...] = ANSWER_SCHEMAS) -> list[str]:
    """Everything that is wrong with a specification. schemas: the answer schemas there are."""
    if not isinstance(raw, dict):
        return ["not a mapping"]
    if missing := [k for k in REQUIRED if k not in raw]:
        return [f"missing keys: {', '.join(missing)}"]
    visible, hidden = set(raw["metadata_input_fields"]), set(raw["hidden_target_fields"] or ())
    forbidden = set((raw["leakage_rules"] or {}).get("forbidden_input_fields") or ())
    quality, needs, why = raw["quality_requirements"] or {}, raw["required_scene_capabilities"] or {}, raw["three_d_necessity"] or {}
    found = []
    rules = [
        (raw["generation_mode"] not in MODES, "unknown generation mode"),
        (raw["supervision_level"] not in LEVELS, "unknown supervision level"),
        (raw["checker"] not in checkers, "checker is not registered"),
        (raw["derivation_program"] not in programs, "program is not registered"),
        (raw["output_schema"] not in schemas, "unknown answer schema"),
        (not (raw["target_anchor"] or {}).get("kind"), "target has no anchor"),
        (not hidden, "nothing is hidden"),
        (bool(visible & hidden), "a hidden field is visible"),
        (bool(visible & forbidden), "a forbidden field is visible"),
        (any(h.startswith(v + ".") for v in visible for h in hidden), "a visible field holds a hidden one"),
        (quality.get("numeric_tolerance_m") is not None and needs.get("scale_status") != "metric", "a tolerance in metres needs a metric scene"),
        (not str(why.get("rationale") or "").strip(), "no reason for three dimensions"),
        (not why.get("conditions"), "no conditions for three dimensions"),
    ]
    low = raw.get("low_altitude_specificity")
    if low is not None:
        rules += [(not str(low.get("rationale") or "").strip(), "no reason for low altitude"), (not low.get("signals"), "no signals of low altitude")]
    found += [what for bad, what in rules if bad]
    return found


#: What the rules look at, as types of a JSON document.
JUDGED = (
    "generation_mode string, supervision_level string, checker string, derivation_program string, output_schema string, target_anchor struct<kind:string>, "
    "metadata_input_fields array<string>, hidden_target_fields array<string>, leakage_rules struct<forbidden_input_fields:array<string>>, "
    "quality_requirements struct<numeric_tolerance_m:double>, required_scene_capabilities struct<scale_status:string>, "
    "three_d_necessity struct<rationale:string,conditions:array<string>>, low_altitude_specificity struct<rationale:string,signals:array<string>>"
)


def judged(rows: DataFrame, key: str, text: str, programs: set[str], checkers: set[str], schemas: tuple[str, ...] = ANSWER_SCHEMAS) -> DataFrame:
    """(key, problem): everything that problems() finds, for many specifications as JSON texts in a column.

    A text that is no JSON object is not a mapping. A field of another type than JUDGED says counts as absent; a null
    list has no members. Specifications without a problem have no row.
    """
    s = F.from_json(F.col(text), JUDGED)
    rows = rows.select(F.col(key), F.json_object_keys(text).alias("_keys"), s.alias("_s"))
    f = lambda name: F.col(f"_s.{name}")
    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    none = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    visible, hidden, forbidden = none(f("metadata_input_fields")), none(f("hidden_target_fields")), none(f("leakage_rules.forbidden_input_fields"))
    holds = F.exists(visible, lambda v: F.exists(hidden, lambda h: F.startswith(h, F.concat(v, F.lit(".")))))
    given = lambda c, allowed: F.coalesce(c.isin(*sorted(allowed)), F.lit(False))
    metres = f("quality_requirements.numeric_tolerance_m").isNotNull()
    low = f("low_altitude_specificity").isNotNull()
    rules = [
        (~given(f("generation_mode"), MODES), "unknown generation mode"),
        (~given(f("supervision_level"), LEVELS), "unknown supervision level"),
        (~given(f("checker"), checkers), "checker is not registered"),
        (~given(f("derivation_program"), programs), "program is not registered"),
        (~given(f("output_schema"), schemas), "unknown answer schema"),
        (F.coalesce(f("target_anchor.kind"), F.lit("")) == "", "target has no anchor"),
        (~some(hidden), "nothing is hidden"),
        (F.arrays_overlap(visible, hidden), "a hidden field is visible"),
        (F.arrays_overlap(visible, forbidden), "a forbidden field is visible"),
        (holds, "a visible field holds a hidden one"),
        (metres & (F.coalesce(f("required_scene_capabilities.scale_status"), F.lit("")) != "metric"), "a tolerance in metres needs a metric scene"),
        (blank(f("three_d_necessity.rationale")), "no reason for three dimensions"),
        (~some(f("three_d_necessity.conditions")), "no conditions for three dimensions"),
        (low & blank(f("low_altitude_specificity.rationale")), "no reason for low altitude"),
        (low & ~some(f("low_altitude_specificity.signals")), "no signals of low altitude"),
    ]
    lost = F.array_except(F.array(*[F.lit(k) for k in REQUIRED]), "_keys")
    missing = F.concat(F.lit("missing keys: "), F.array_join(lost, ", "))
    broken = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(what)) for bad, what in rules]))
    found = F.when(F.col("_keys").isNull(), F.array(F.lit("not a mapping"))).when(F.size(lost) > 0, F.array(missing)).otherwise(broken)
    return rows.select(key, F.explode(found).alias("problem"))


def load(path: Path, programs: set[str], checkers: set[str]) -> Spec:
    try:
        raw = yaml.safe_load(path.read_text(encoding="utf-8"))
    except yaml.YAMLError as e:
        raise SpecError(f"{path.name}: {e}") from e
    if bad := problems(raw, programs, checkers):
        raise SpecError(f"{path.name}: {'; '.join(bad)}")
    return Spec(raw)


def load_all(programs: set[str], checkers: set[str], folder: Path = HERE) -> list[Spec]:
    """All specifications below folder, in the order of their paths; ids with versions must be unique."""
    specs = [load(p, programs, checkers) for p in sorted(folder.rglob("*.yaml"))]
    ids = [s.qualified_id for s in specs]
    if len(set(ids)) < len(ids):
        raise SpecError(f"repeated: {sorted({i for i in ids if ids.count(i) > 1})}")
    return specs
