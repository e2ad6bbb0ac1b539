"""Whether what a model sees gives away what it is asked for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from scenewright.functions import text as T
from scenewright.plans import projection

#: Keys that never appear in a payload.
FORBIDDEN = ("hidden_target", "evidence", "checker", "target_geometry", "derivation_program", "derivation_inputs", "used_fields", "used_entities")
#: Keys that describe an answer without being it; suffixes of such keys; keys whose value is the same in every sample of a task.
NO_ANSWER, NO_ANSWER_SUFFIX, IDENTITY = (
    "target_type", "unit", "answer_mode", "reason",
), ("_index", "_count", "_id_hint"), ("task_spec_id", "adapter", "sample_id")
#: Shortest string and shortest number (digits without the sign) that are specific enough to look for.
LEAST_TEXT, LEAST_NUMBER = 8, 3
ANY_ID = r"^<(?:" + "|".join(T.NAMESPACES) + r")_\d{3,}>$"


def _key(path: Column) -> Column:
    return F.regexp_replace(F.substring_index(path, ".", -1), r"\[.*", "")


def atoms(
    target: Column, kind: DataType, program: str | None = None, keep_ids: Column | bool = True, least_number: int = LEAST_NUMBER,
) -> Column:
    """Strings to look for: ids, long strings and specific numbers of a target. keep_ids false: ids are visible by design.

    least_number 1: numbers of any length, for a payload whose only number is the one that may be the answer.
    """
    found = projection.leaves(target, kind)
    telling = F.filter(found, lambda x: ~_key(x["path"]).isin(*NO_ANSWER) & ~_key(x["path"]).rlike("(?:" + "|".join(NO_ANSWER_SUFFIX) + ")$"))
    number = lambda x: T.six_digits(x["num"])
    ids = keep_ids if isinstance(keep_ids, Column) else F.lit(keep_ids)

    def atom(x: Column) -> Column:
        is_id = x["text"].rlike(ANY_ID)
        text = F.when(is_id, F.when(ids, x["text"])).when(F.length(x["text"]) >= LEAST_TEXT, x["text"])
        num = F.when(F.length(F.regexp_replace(number(x), "^-+", "")) >= least_number, number(x))
        return F.coalesce(text, num)

    out = F.array_distinct(F.array_compact(F.transform(telling, atom)))
    return F.array_union(out, F.array(F.lit(program))) if program and len(program) >= LEAST_TEXT else out


def findings(payload: Column, kind: DataType, wanted: Column, exempt: tuple[str, ...] = ()) -> Column:
    """Messages "path|atom" for each place of a payload that holds one of the wanted atoms, and one for each forbidden key of its schema.

    Exempt paths are exact; everything under the key choices may name the answer, since it must be among them.
    """
    forbidden = [F.lit(f"key|{k}") for k in sorted(projection.keys(kind) & set(FORBIDDEN))]
    places = projection.leaves(payload, kind, skip=("choices",))
    if exempt:
        places = F.filter(places, lambda x: ~x["path"].isin(*exempt))

    def hits(x: Column) -> Column:
        texts = F.when(x["text"].isNotNull() & ~_key(x["path"]).isin(*IDENTITY), F.filter(wanted, lambda a: x["text"].contains(a)))
        nums = F.when(x["num"].isNotNull(), F.filter(wanted, lambda a: a == T.six_digits(x["num"])))
        return F.transform(F.coalesce(texts, nums, F.array().cast("array<string>")), lambda a: F.concat(x["path"], F.lit("|"), a))

    return F.concat(F.array(*forbidden).cast("array<string>"), F.flatten(F.transform(places, hits)))
