"""Mixing sources to target weights by Efraimidis-Spirakis sampling, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scenewright.llm.common import WORD, documents, shared_dir

#: No source is repeated more often than this.
MOST = 3
#: Weights of the sources in code point order, repeating.
WEIGHTS = (1, 2, 3)
#: Ranges of sampling keys that a source's sizes are first summed over.
RANGES = 4096


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, most: int = MOST) -> DataFrame:
    """source, source_size, target, from rows with source and size.

    Sources in code point order, null last, get the weights in turn. Together they get share of all sizes. With
    targets least(level * weight, most * source_size), the level that uses up everything is found by adding up the
    limits in the order of limit over weight. The level of the sources that remain rises as long as those left out
    lie below it and falls afterwards, so it is the largest one.
    """
    of = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1  # one row per source
    of = of.withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    ).withColumn("limit", F.lit(float(most)) * F.col("source_size"))
    everything = Window.partitionBy()
    order = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(order), F.lit(0.0))
    level = left / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(order), F.lit(0.0)))
    of = of.withColumn("level", level).withColumn("level", F.max("level").over(everything))
    return of.select("source", "source_size", F.greatest(F.least(F.col("level") * F.col("weight"), "limit"), F.lit(0.0)).alias("target"))


def sampling_key(doc_id: Column, quality: Column) -> Column:
    """1 - u^(1/w), in the order of the exponential key -ln(u)/w, for u in (0, 1) from the MD5 of doc_id."""
    u = (F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("null"))), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    return 1 - F.pow(u, 1 / quality)


def mix(
    docs: DataFrame,
    quality: Column | None = None,
    labels: DataFrame | None = None,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = 1.0,
    most: int = MOST,
    text: str = "text",
    source: str = "source",
    doc_id: str = "doc_id",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words, repeats counted) and the columns keep of every row.

    A target of e whole source sizes and a rest takes every document e times, then documents in the order of their
    sampling keys until the rest is used up; the one that crosses it is taken if at least half of it fits. quality
    (a positive number; null or not positive: 1), or label_quality of labels, makes documents come earlier. Null and
    empty texts have size 0 and take 0. Rows with the same doc_id share a key and follow each other by size, then by
    keep. Reruns and other partitionings agree. No documents: no rows.

    Sizes are summed over ranges of keys first, so that only the range in which a source's rest ends is ordered row
    by row, and no window holds a whole source. Labels meet ids and sizes, never texts.
    """
    shared_dir(docs.sparkSession)
    size = F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(WORD)), F.lit(0)).cast("long")
    q = F.lit(1.0) if quality is None else quality.cast("double")
    rows = docs.select(
        F.col(f"`{doc_id}`").cast("long").alias("doc_id"),
        F.col(f"`{source}`").cast("string").alias("source"),
        size.alias("size"),
        q.alias("quality"),
        *[F.col(f"`{c}`") for c in keep],
    )
    if labels is not None:
        of = label_quality(labels).withColumnRenamed("doc_id", "labelled_id")
        rows = rows.drop("quality").join(of, F.col("doc_id") == F.col("labelled_id"), "left").drop("labelled_id").withColumnRenamed("quality_weight", "quality")
    rows = rows.withColumn("quality", F.when(F.col("quality") > 0, F.col("quality")).otherwise(F.lit(1.0)))
    key = sampling_key(F.col("doc_id"), F.col("quality"))
    rows = rows.withColumn("key", key).withColumn("range", F.least(F.floor(F.col("key") * RANGES), F.lit(RANGES - 1))).drop("quality").checkpoint()
    targets = source_targets(rows.groupBy("source", "range").agg(F.sum("size").alias("size")), weights, share, most)
    targets = targets.withColumn(
        "epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-9)).otherwise(0),
    ).withColumn("rest", F.greatest(F.col("target") - F.col("epochs") * F.col("source_size"), F.lit(0.0)))
    ranges = rows.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # at most RANGES rows
    ranges = ranges.withColumn("range_start", F.coalesce(F.sum("range_size").over(before), F.lit(0)))
    # Every row of a range takes the same decision, but for the range in which the rest ends.
    plan = ranges.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    plan = plan.withColumn(
        "whole", F.col("range_start") + F.col("range_size") <= F.col("rest"),
    ).withColumn("open", ~F.col("whole") & (F.col("range_start") <= F.col("rest")))
    plan = plan.withColumnsRenamed({"source": "s", "range": "r"})
    met = rows.join(plan, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
    decided = met.filter("not open").withColumn("more", F.col("whole"))
    within = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size", *keep).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = met.filter("open").withColumn("more", F.col("range_start") + F.sum("size").over(within) - F.col("size") / 2 <= F.col("rest"))
    taken = (F.col("size") * (F.col("epochs") + F.col("more").cast("int"))).cast("long")
    return decided.unionByName(cut).select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), *keep)


def label_quality(labels: DataFrame) -> DataFrame:
    """doc_id and quality_weight of labelled documents: 2 for good ones, 0.5 for bad or toxic ones. Several labels of a document: the worst counts; a null label is a good one."""
    bad = (F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)
    return labels.groupBy("doc_id").agg(F.when(F.max(bad.cast("int")) == 1, F.lit(0.5)).otherwise(F.lit(2.0)).alias("quality_weight"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir), labels=spark.read.parquet(f"{sf_dir}/labels.parquet")).drop("source")


OP8_SQL = r"""
WITH q AS (
  SELECT doc_id AS labelled_id, CASE WHEN bool_or(coalesce(quality, 1) = 0 OR coalesce(toxic, 0) = 1) THEN 0.5 ELSE 2.0 END AS quality
  FROM labels GROUP BY doc_id),
rows AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         1 - pow((CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 12)) AS BIGINT) + 0.5) / 281474976710656.0, 1 / coalesce(quality, 1.0)) AS k
  FROM documents LEFT JOIN q ON doc_id = labelled_id),
s AS (SELECT source, CAST(sum(size) AS DOUBLE) AS source_size, 1.0 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM rows GROUP BY source),
l AS (SELECT *, 3 * source_size AS cap,
        (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER o, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS lev
      FROM s WINDOW o AS (ORDER BY 3 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, greatest(least(w * max(lev) OVER (), cap), 0) AS target FROM l),
e AS (SELECT *, floor(target / source_size + 1e-9) AS epochs FROM t),
c AS (SELECT r.*, e.source_size, e.target, e.epochs, greatest(e.target - e.epochs * e.source_size, 0) AS rest,
        sum(r.size) OVER (PARTITION BY r.source ORDER BY r.k, r.doc_id, r.size ROWS UNBOUNDED PRECEDING) AS upto
      FROM rows r JOIN e ON r.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target, CAST(size * (epochs + CASE WHEN upto - size / 2.0 <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM c
"""
