"""Similarity transforms between two sets of corresponding points: scale, rotation and shift of each key, robust against wrong pairs.

Sums of products are taken over all pairs of a key in one pass with partial sums; numpy decomposes one 3x3 matrix for
each key, and residuals are Spark's again.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenewright.functions import geometry as G
from scenewright.sources.readers import materialized

A, B = ("ax", "ay", "az"), ("bx", "by", "bz")
FIT = "scale double, rotation array<double>, shift array<double>, err string"


def solve(n: np.ndarray, cov: np.ndarray, var: np.ndarray, rigid: bool) -> list[tuple]:
    """(scale, rotation by rows, err) of each key from its number of points, mean products b a' and mean square of a, both centred.

    A second singular value of nothing means that the points lie on a line, which leaves a rotation open. A negative
    determinant with a third one that is something means mirrored points, which no rotation maps on each other; with
    points in a plane the rotation is the better of the two.
    """
    out = []
    for count, c, v in zip(n, cov, var, strict=True):
        if count < 3:
            out.append((None, None, "fewer than three points"))
            continue
        if not np.isfinite(c).all():
            out.append((None, None, "not finite"))
            continue
        u, s, vt = np.linalg.svd(c.reshape(3, 3))
        sign = np.sign(np.linalg.det(u) * np.linalg.det(vt)) or 1.0
        if s[1] <= 1e-9 * max(s[0], 1e-300) or v <= 0:
            out.append((None, None, "points on a line"))
        elif sign < 0 and s[2] > 1e-6 * s[0]:
            out.append((None, None, "mirrored"))
        else:
            r = u @ np.diag([1.0, 1.0, sign]) @ vt
            out.append((1.0 if rigid else float((s * [1, 1, sign]).sum() / v), r.ravel().tolist(), None))
    return out


def _fit(pairs: DataFrame, keys: list[str], rigid: bool) -> DataFrame:
    """keys, n and fit of pairs with weights w."""
    w, mean = F.col("w"), lambda c: F.try_divide(F.sum(F.col("w") * c), F.sum("w"))
    sums = pairs.groupBy(*keys).agg(
        F.count_if(w > 0).alias("n"),
        F.array(*[mean(F.col(a)) for a in A]).alias("ma"),
        F.array(*[mean(F.col(b)) for b in B]).alias("mb"),
        F.array(*[mean(F.col(b) * F.col(a)) for b in B for a in A]).alias("ba"),
        mean(sum(F.col(a) * F.col(a) for a in A)).alias("aa"),
    )
    cov = F.array(*[G.at(F.col("ba"), 3 * i + j) - G.at(F.col("mb"), i) * G.at(F.col("ma"), j) for i in range(3) for j in range(3)])
    sums = sums.withColumn("cov", cov).withColumn("var", F.col("aa") - G.dot(F.col("ma"), F.col("ma")))

    @F.pandas_udf("scale double, rotation array<double>, err string")
    def solved(n: pd.Series, c: pd.Series, v: pd.Series) -> pd.DataFrame:
        clean = [np.asarray(x, dtype=float) if x is not None else np.full(9, np.nan) for x in c]
        return pd.DataFrame(solve(n.to_numpy(), clean, v.to_numpy(), rigid), columns=["scale", "rotation", "err"])

    out = sums.withColumn("s", solved("n", "cov", "var"))
    turned = _turned(F.col("s.rotation"), F.col("ma"))
    return out.select(*keys, "n", F.col("s.scale").alias("scale"), F.col("s.rotation").alias("rotation"), G.sub(F.col("mb"), G.scale(turned, F.col("s.scale"))).alias("shift"), F.col("s.err").alias("err"))


def _turned(rotation: Column, p: Column) -> Column:
    return F.array(*[G.dot(F.slice(rotation, 3 * i + 1, 3), p) for i in range(3)])


def similarity(pairs: DataFrame, keys: list[str], rigid: bool = False, soft: int = 3, hard: int = 3, keep: float = 5.0) -> DataFrame:
    """keys, n_pairs, n_used, scale, rotation (9 numbers by rows), shift, rmse, err: b = scale * rotation a + shift.

    pairs: keys and ax..bz. Pairs with a number that isn't finite are left out. soft rounds weigh each pair by the
    inverse of its residual; hard rounds then keep the pairs within keep times the median residual. Up to about a
    third of wrong pairs so have no influence on the result. rigid: the scale is 1. rmse is that of the pairs used, n_used their
    number. Points are moved to their key's mean first, so large coordinates cost no digits. Fewer than three points,
    points on a line and mirrored points are errors, told in err. A null in a key makes a key of its own.
    """
    good = F.lit(True)
    for c in A + B:
        good &= G.finite(F.col(c))
    clean = pairs.filter(good).select(*keys, *[F.col(c).cast("double").alias(c) for c in A + B])
    of = [f"_of_{k}" for k in keys]

    def met(rows: DataFrame, table: DataFrame) -> DataFrame:
        named = table.withColumnsRenamed(dict(zip(keys, of, strict=True)))
        cond = F.lit(True)
        for k, o in zip(keys, of, strict=True):
            cond &= F.col(k).eqNullSafe(F.col(o))
        return rows.join(named, cond).drop(*of)

    means = materialized(clean.groupBy(*keys).agg(F.count("*").alias("n_pairs"), *[F.avg(c).alias(f"m{c}") for c in A + B]))
    rows = materialized(met(clean, means.drop("n_pairs")).select(*keys, *[(F.col(c) - F.col(f"m{c}")).alias(c) for c in A + B]))
    moved = G.add(G.scale(_turned(F.col("rotation"), F.array(*A)), F.col("scale")), F.col("shift"))
    residual = G.distance(moved, F.array(*B))
    fit = materialized(_fit(rows.withColumn("w", F.lit(1.0)), keys, rigid))
    for k in range(soft + hard):
        far = met(rows, fit.select(*keys, "scale", "rotation", "shift")).withColumn("r", residual)
        size = F.sqrt(F.avg(sum(F.col(b) * F.col(b) for b in B)))
        scale = materialized(far.groupBy(*keys).agg(F.percentile_approx("r", 0.5, 1000).alias("mid"), (1e-9 * size).alias("tiny")))
        w = F.try_divide(F.lit(1.0), F.greatest(F.col("r"), F.col("mid") / 10, F.col("tiny"))) if k < soft else (F.col("r") <= keep * F.col("mid") + F.col("tiny")).cast("double")
        weighed = met(far.drop("scale", "rotation", "shift"), scale).withColumn("w", F.coalesce(w, F.lit(1.0)))
        fit = materialized(_fit(weighed, keys, rigid))
    far = met(weighed.filter("w > 0").drop("r", "mid", "tiny", "w"), fit.select(*keys, "scale", "rotation", "shift")).withColumn("r", residual)
    error = far.groupBy(*keys).agg(F.sqrt(F.avg(F.col("r") * F.col("r"))).alias("rmse"))
    out = met(met(fit.withColumnRenamed("n", "n_used"), error), means)
    a, b = (F.array(*[F.col(f"m{c}") for c in cs]) for cs in (A, B))
    shift = G.sub(G.add(F.col("shift"), b), G.scale(_turned(F.col("rotation"), a), F.col("scale")))
    return out.select(*keys, "n_pairs", "n_used", "scale", "rotation", F.when(F.col("err").isNull(), shift).alias("shift"), F.when(F.col("err").isNull(), F.col("rmse")).alias("rmse"), "err")
