"""How well scores between 0 and 1 foretell what is true, by scene and condition: area under the curve, Brier score, expected calibration error."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenewright.sources.readers import materialized

#: Stretches that the distinct scores are cut into.
STRETCHES = 64


def _same(keys: list[str]) -> Column:
    return reduce(lambda c, k: c & F.col(k).eqNullSafe(F.col(f"_of_{k}")), keys, F.lit(True))


def calibration(rows: DataFrame, keys: list[str], score: str, truth: str, bins: int = 10) -> DataFrame:
    """keys, n_rows, n_bad, n_true, n_false, auc, brier, ece, err, one row for each key.

    auc is the exact share of (true, false) pairs in which the true row has the higher score, equal ones counting half.
    ece weighs the gap between mean score and share of true rows in bins of equal width; a score of 1 is in the last.
    Rows whose score is null, NaN or outside 0 to 1, or whose truth is null, are bad: counted and left out. auc is
    null with an err where only one truth occurs, all three where no row is good. Nulls in a key make a key of their own.

    Equal scores of a key are counted first. Ranks are then sums over stretches of the scores, at whose ends one small
    row for each key and stretch is carried on, so no task orders all scores of a key.
    """
    good = F.coalesce(F.col(score).between(0.0, 1.0) & ~F.isnan(score) & F.col(truth).isNotNull(), F.lit(False))
    rows = rows.select(*keys, F.col(score).cast("double").alias("_s"), F.col(truth).cast("boolean").alias("_t"), good.alias("_good"))
    counts = rows.groupBy(*keys, "_good", F.when(F.col("_good"), F.col("_s") + 0.0).alias("_s")).agg(F.count("*").alias("_n"), F.count_if("_t").alias("_p"))
    counts = materialized(counts)
    every = counts.groupBy(*keys).agg(F.sum("_n").alias("n_rows"), F.sum(F.when(F.col("_good"), 0).otherwise(F.col("_n"))).alias("n_bad"))
    usable = counts.filter("_good").withColumn("_q", F.col("_n") - F.col("_p"))

    shares = [i / STRETCHES for i in range(1, STRETCHES)]
    ends = usable.agg(F.percentile_approx("_s", shares, 10_000)).first()[0] or []
    stretch = F.size(F.filter(F.array(*[F.lit(e) for e in sorted(set(ends))]), lambda e: e <= F.col("_s"))) if ends else F.lit(0)
    placed = usable.withColumn("_stretch", stretch)
    # Of floats, n * s is summed; counts are whole numbers, their products decimals.
    inside = Window.partitionBy(*keys, "_stretch").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    ranked = placed.withColumn("_below", F.coalesce(F.sum("_q").over(inside), F.lit(0)))
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    parts = ranked.groupBy(*keys, "_stretch").agg(
        F.sum(wide("_p") * (2 * F.col("_below") + F.col("_q")).cast("decimal(19,0)")).alias("_own"),
        F.sum("_p").alias("_p"),
        F.sum("_q").alias("_q"),
        F.sum(F.col("_p") * F.pow(F.col("_s") - 1, 2) + F.col("_q") * F.pow("_s", F.lit(2.0))).alias("_squares"),
    )
    before = Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_below", F.coalesce(F.sum("_q").over(before), F.lit(0)))
    twice = F.sum(F.col("_own") + 2 * wide("_p") * wide("_below")).cast("double")
    p, q = F.sum("_p"), F.sum("_q")
    ranks = parts.groupBy(*keys).agg(
        p.alias("n_true"), q.alias("n_false"), F.try_divide(twice, 2.0 * p.cast("double") * q.cast("double")).alias("auc"), (F.sum("_squares") / (p + q)).alias("brier")
    )
    binned = usable.groupBy(*keys, F.least(F.floor(F.col("_s") * bins), F.lit(bins - 1)).alias("_bin")).agg(
        F.abs(F.sum("_p") - F.sum(F.col("_n") * F.col("_s"))).alias("_gap"), F.sum("_n").alias("_n")
    )
    gaps = binned.groupBy(*keys).agg((F.sum("_gap") / F.sum("_n")).alias("ece"))

    of = [f"_of_{k}" for k in keys]
    out = every
    for found in (ranks, gaps):
        out = out.join(found.withColumnsRenamed(dict(zip(keys, of, strict=True))), _same(keys), "left").drop(*of)
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    none = F.coalesce(F.col("n_true") + F.col("n_false"), F.lit(0)) == 0
    err = F.when(none, "no usable row").when((F.col("n_true") == 0) | (F.col("n_false") == 0), "one truth only")
    return out.select(*keys, "n_rows", "n_bad", count("n_true"), count("n_false"), "auc", "brier", "ece", err.alias("err"))
