"""Grading of answers by recomputation, and what is made of many grades."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from scenewright.functions import geometry as G
from scenewright.plans import projection
from scenewright.plans.errors import CODES

RESULT = "struct<passed:boolean,code:string,error:string>"


def _result(*cases: tuple[Column, bool | None, str | None, str | None], otherwise: Column) -> Column:
    """The first case that holds: passed, code, error. An error isn't a failed answer: passed is null then."""
    make = lambda p, c, e: F.struct(F.lit(p).cast("boolean").alias("passed"), F.lit(CODES[c] if c else None).cast("string").alias("code"), F.lit(e).cast("string").alias("error"))
    ok = F.when(otherwise, make(True, None, None)).otherwise(make(False, "CHECKER_DISAGREEMENT", None))
    return reduce(lambda rest, case: F.when(F.coalesce(case[0], F.lit(False)), make(*case[1:])).otherwise(rest), reversed(cases), ok)


def check_distance(answer: Column, observer: Column, lines: Column, tolerance: float = 0.10) -> Column:
    """answer: struct(object_id, distance_m as text). lines: array of struct(id, line). Ambiguity is looked at before the answer."""
    number = answer["distance_m"].try_cast("double")

    def graded(ranked: Column) -> Column:
        first, second = F.get(ranked, F.lit(0)), F.get(ranked, F.lit(1))
        return _result(
            (F.coalesce(F.size(lines), F.lit(0)) <= 0, None, None, "no evidence"), (
                F.exists(ranked, lambda x: x["err"].isNotNull()), None, None, "evidence is degenerate",
            ),
            (second["d"] - first["d"] <= tolerance, False, "NON_UNIQUE_ANSWER", None), (
                ~F.coalesce(answer["object_id"] == first["id"], F.lit(False)), False, "CHECKER_DISAGREEMENT", None,
            ),
            (answer["distance_m"].isNull() | number.isNull() | F.isnan(number), False, "INVALID_UNIT", None), otherwise=F.abs(number - first["d"]) <= tolerance,
        )

    each = F.transform(
        lines,
        lambda x, i: G.let(
            G.point_to_polyline(observer, x["line"]), lambda r: F.struct(r["value"]["d"].alias("d"), i.alias("pos"), x["id"].alias("id"), r["err"].alias("err")),
        ),
    )
    return G.let(F.array_sort(each), graded)


def check_grounding(answer: Column, target_id: Column, candidates: Column, ambiguous_ids: Column) -> Column:
    """answer: struct(object_id, ambiguous). Where several candidates fit, only "ambiguous" is right."""
    many, said = F.coalesce(F.size(ambiguous_ids), F.lit(0)) > 1, F.coalesce(answer["ambiguous"], F.lit(False))
    return _result(
        (
            ~F.coalesce(F.array_contains(candidates, target_id), F.lit(False)), None, None, "target is no candidate",
        ), (many & ~said, False, "AMBIGUITY_UNMARKED", None), (many & said, True, None, None),
        (said, False, "CHECKER_DISAGREEMENT", None), (
            ~F.coalesce(F.array_contains(candidates, answer["object_id"]), F.lit(False)), False, "NONEXISTENT_ENTITY_REFERENCE", None,
        ),
        otherwise=answer["object_id"] == target_id,
    )


def check_direction(answer: Column, target: Column, observer: Column, forward: Column, up: Column, deadzone: float = 10.0) -> Column:
    """answer: struct(longitudinal, lateral). Inside the dead zone no answer is right."""
    r = G.relative_direction(target, observer, forward, up, deadzone)
    same = F.coalesce((answer["longitudinal"] == r["value"]["longitudinal"]) & (answer["lateral"] == r["value"]["lateral"]), F.lit(False))
    return _result(
        (r["err"].isNotNull(), None, None, "evidence is degenerate"), (r["value"]["lateral"] == "ambiguous", False, "NON_UNIQUE_ANSWER", None), otherwise=same,
    )


def check_correspondence(answer: Column, same_entity: Column) -> Column:
    """answer: struct(same_entity, confidence)."""
    c = answer["confidence"]
    return _result(
        (same_entity.isNull(), None, None, "no evidence"), (answer["same_entity"].isNull(), False, "SCHEMA_UNREPAIRABLE", None), (
            c.isNotNull() & (F.isnan(c) | (c < 0) | (c > 1)), False, "SCHEMA_UNREPAIRABLE", None,
        ),
        otherwise=answer["same_entity"] == same_entity,
    )


def score(result: Column) -> Column:
    """1 for a pass; failures and checker errors are 0."""
    return F.when(F.coalesce(result["passed"], F.lit(False)), 1.0).otherwise(0.0)


def wilson(hits: Column, n: Column, z: float = 1.96) -> Column:
    """struct(low, high) of a share; (0, 1) without trials."""
    p = F.try_divide(hits.cast("double"), n)
    mid, half = (p + z * z / (2 * n)) / (1 + z * z / n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.struct(
        F.when(n > 0, F.greatest(F.lit(0.0), mid - half)).otherwise(0.0).alias("low"),
        F.when(n > 0, F.least(F.lit(1.0), mid + half)).otherwise(1.0).alias("high"),
    )


def lift(trials: DataFrame) -> DataFrame:
    """trials: arm (a without geometry, b with, c with shuffled geometry), hit. Accuracy of each arm with its interval, and lift b - a, pseudo c - a, net b - c beside them."""
    arms = trials.groupBy("arm").agg(F.sum("hit").alias("hits"), F.count("*").alias("n")).withColumn("accuracy", F.col("hits") / F.col("n"))
    arms = arms.withColumn("ci", wilson(F.col("hits"), F.col("n")))
    of = lambda a: F.max(F.when(F.col("arm") == a, F.col("accuracy")))
    whole = trials.groupBy("arm").agg((F.sum("hit") / F.count("*")).alias("accuracy")).agg(
        (of("b") - of("a")).alias("lift"), (of("c") - of("a")).alias("pseudo"), (of("b") - of("c")).alias("net"),
    )
    return arms.crossJoin(F.broadcast(whole)).select("arm", "hits", "n", "accuracy", F.col("ci")["low"].alias("low"), F.col("ci")["high"].alias("high"), "lift", "pseudo", "net")  # one row beside three


def rotated(items: Column, seed: Column) -> Column:
    """A list turned by 1 to n - 1 places as the seed says, so that nothing keeps its place; lists of one stay."""
    n = F.size(items)
    shift = 1 + F.pmod(F.crc32(seed.cast("binary")), F.greatest(n - 1, F.lit(1))).cast("int")
    return F.when(n < 2, items).otherwise(F.transform(items, lambda x, i: F.get(items, F.pmod(i + shift, n))))


#: Arms of a comparison: without geometry, with it, with geometry that belongs to other candidates.
ARMS = ("a", "b", "c")


def without_geometry(metadata: Column, kind: StructType) -> Column:
    """Arm a: no observer, no geometry, no visibility; candidates keep their ids, so that the same answers can be given."""
    fields = []
    for f in kind.fields:
        if f.name == "observer":
            continue
        part = metadata[f.name]
        if f.name == "entities":
            left = {n: {} for n in f.dataType.elementType.names if n not in ("geometry", "visibility")}
            part = projection.project(part, f.dataType, left)
        if part is not None:
            fields.append(part.alias(f.name))
    return F.struct(*fields)


def with_moved_geometry(metadata: Column, kind: StructType, seed: Column) -> Column:
    """Arm c: each candidate has another one's geometry; everything else, also the multiset of geometries, stays."""
    if "entities" not in kind.names or "geometry" not in kind["entities"].dataType.elementType.names:
        return metadata
    moved = rotated(metadata["entities"]["geometry"], seed)
    return metadata.withField("entities", F.transform(metadata["entities"], lambda e, i: e.withField("geometry", F.get(moved, i))))


def arms(rows: DataFrame, metadata: str, trials: int = 1) -> DataFrame:
    """rows once for each arm and trial, with arm, trial and view (JSON of what that arm shows of a metadata column). Needs sample_id."""
    kind = rows.schema[metadata].dataType
    rows = rows.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))))
    seed = F.concat_ws(":", "sample_id", "trial")
    m = F.col(metadata)
    views = (F.to_json(without_geometry(m, kind)), F.to_json(m), F.to_json(with_moved_geometry(m, kind, seed)))
    each = F.array(*[F.struct(F.lit(a).alias("arm"), v.alias("view")) for a, v in zip(ARMS, views, strict=True)])
    return rows.withColumn("e", F.explode(each)).select(*rows.columns, "e.arm", "e.view")


def answered(answers: DataFrame, records: DataFrame, rendered: DataFrame) -> DataFrame:
    """answers (sample_id, arm, trial, ...) with their record's columns; those whose sample is no record, or wasn't rendered, are left out."""
    shown = rendered.filter("status = 'rendered'").select("sample_id").distinct()
    return answers.join(records.filter("status = 'record'"), "sample_id").join(shown, "sample_id", "left_semi")


def hits(graded: DataFrame, keys: list[str]) -> DataFrame:
    """By keys and arm: hits and trials, of rows with result (what a checker says)."""
    return graded.groupBy(*keys, "arm").agg(F.sum(score(F.col("result"))).cast("bigint").alias("hits"), F.count("*").alias("trials"))


def threshold_sweep(scores: DataFrame, thresholds: list[float], frames: int) -> DataFrame:
    """scores: phrase, negative (a phrase that isn't there), score. By threshold: counts above it, rates, discriminability, and whether it is the lowest without a negative."""
    marks = F.array(*[F.lit(float(t)) for t in thresholds])
    rows = scores.withColumn("passed", F.filter(marks, lambda t: F.col("score") > t)).withColumn("threshold", F.explode_outer("passed"))
    counts = rows.filter("threshold is not null").groupBy("threshold").agg(F.count_if(~F.col("negative")).alias("real"), F.count_if("negative").alias("false"))
    every = scores.sparkSession.createDataFrame([(float(t),) for t in thresholds], "threshold double")
    out = every.join(counts, "threshold", "left").fillna(0, ["real", "false"])
    lowest = out.agg(F.min(F.when(F.col("false") == 0, F.col("threshold"))).alias("lowest"))
    out = out.crossJoin(F.broadcast(lowest))
    return out.select(
        "threshold",
        F.col("real").alias("n_real"),
        F.col("false").alias("n_negative"),
        (F.col("real") / frames).alias("real_rate"),
        F.try_divide(F.col("real").cast("double"), F.col("false")).alias("discriminability"),
        F.coalesce(F.col("threshold") == F.col("lowest"), F.lit(False)).alias("is_lowest_clean"),
    )


def best_phrases(token_scores: DataFrame, threshold: float) -> DataFrame:
    """token_scores: query, phrase, score. Of each query the phrase with the largest score, the first by name of equal ones, if over threshold."""
    top = token_scores.groupBy("query", "phrase").agg(F.max("score").alias("score"))
    won = top.groupBy("query").agg(F.max("score").alias("score"))
    return top.join(won, ["query", "score"]).groupBy("query", "score").agg(F.min("phrase").alias("phrase")).filter(F.col("score") > threshold)
