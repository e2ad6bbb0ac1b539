"""Surfaces: planes through points with slope, aspect and roughness, and the largest circle inside a region of cells.

Sums of products are taken in one pass with partial sums; numpy sees one 3x3 matrix for each key. The circle comes from
an exact distance transform: gaps and islands along the rows, then along the columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenewright.functions import geometry as G
from scenewright.operators.entities import _axes, exact_percentile
from scenewright.sources.readers import materialized

AXES = ("x", "y", "z")


def _met(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the columns of a table that has one row a key; a null in a key meets a null."""
    of = [f"_of_{k}" for k in keys]
    cond = F.lit(True)
    for k, o in zip(keys, of, strict=True):
        cond &= F.col(k).eqNullSafe(F.col(o))
    return rows.join(table.withColumnsRenamed(dict(zip(keys, of, strict=True))), cond).drop(*of)


def _fit(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, normal (upwards), shift and err of rows x, y, z with weights w."""
    mean = lambda c: F.try_divide(F.sum(F.col("w") * c), F.sum("w"))
    pairs = [(a, b) for a, b in ("xx", "yy", "zz", "xy", "xz", "yz")]
    sums = rows.groupBy(*keys).agg(
        F.count_if(F.col("w") > 0).alias("n"), *[mean(F.col(a)).alias(f"m{a}") for a in AXES], *[mean(F.col(a) * F.col(b)).alias(f"e{a}{b}") for a, b in pairs],
    )
    e = sums.withColumn("e", _axes(*[F.col(f"e{a}{b}") - F.col(f"m{a}") * F.col(f"m{b}") for a, b in pairs]))
    down = (G.at(F.col("e"), 11) < 0) | ((G.at(F.col("e"), 11) == 0) & (G.at(F.col("e"), 10) < 0))
    normal = G.scale(F.slice("e", 10, 3), F.when(down, -1.0).otherwise(1.0))
    flat = G.at(F.col("e"), 1) <= 1e-12 * F.greatest(G.at(F.col("e"), 0), F.lit(1e-300))
    err = F.when(F.col("n") < 3, "fewer than three points").when(F.col("e").isNull() | flat, "points on a line")
    out = e.withColumn("err", err).withColumn("normal", F.when(err.isNull(), normal))
    return out.select(*keys, "n", "normal", G.dot(F.col("normal"), F.array("mx", "my", "mz")).alias("shift"), "err")


def planes(points: DataFrame, keys: list[str], soft: int = 2, hard: int = 2, keep: float = 5.0) -> DataFrame:
    """keys, n_points, n_used, normal, offset_m, inlier_ratio, slope_deg, aspect_deg, roughness_m, planarity_residual_p95_m, err.

    normal . p = offset_m on the plane, the normal upwards. soft rounds weigh each point by the inverse of its distance,
    hard rounds then keep those within keep times the median distance; without rounds this is least squares. aspect is
    where the slope falls, clockwise from y, null on level planes; roughness is the root mean square distance of the
    points used, and the percentile is exact. Points with a coordinate that isn't finite are left out. Points are moved
    to their key's mean first, so large coordinates cost no digits. Fewer than three points and points on a line are
    errors, told in err. Repeated points count as often as they come; a null in a key makes a key of its own; an empty
    table gives no rows.
    """
    good = F.lit(True)
    for a in AXES:
        good &= G.finite(F.col(a))
    clean = points.filter(good).select(*keys, *[F.col(a).cast("double").alias(a) for a in AXES])
    means = materialized(clean.groupBy(*keys).agg(F.count("*").alias("n_points"), *[F.avg(a).alias(f"c{a}") for a in AXES]))
    rows = materialized(_met(clean, means.drop("n_points"), keys).select(*keys, *[(F.col(a) - F.col(f"c{a}")).alias(a) for a in AXES]))
    weighed = rows.withColumn("w", F.lit(1.0))
    fit = materialized(_fit(weighed, keys))
    far = F.abs(G.dot(F.col("normal"), F.array(*AXES)) - F.col("shift"))
    for k in range(soft + hard):
        seen = _met(rows, fit.select(*keys, "normal", "shift"), keys).withColumn("r", far).drop("normal", "shift")
        size = F.sqrt(F.avg(sum(F.col(a) * F.col(a) for a in AXES)))
        limits = materialized(seen.groupBy(*keys).agg(F.percentile_approx("r", 0.5, 1000).alias("mid"), (1e-9 * size).alias("tiny")))
        w = F.try_divide(F.lit(1.0), F.greatest(F.col("r"), F.col("mid") / 10, F.col("tiny"))) if k < soft else (F.col("r") <= keep * F.col("mid") + F.col("tiny")).cast("double")
        weighed = materialized(_met(seen, limits, keys).select(*keys, *AXES, F.coalesce(w, F.lit(1.0)).alias("w")))
        fit = materialized(_fit(weighed, keys))
    used = _met(weighed.filter("w > 0"), fit.filter("err IS NULL").select(*keys, "normal", "shift"), keys).withColumn("r", far)
    used = materialized(used.withColumn("key", F.struct(*keys)).select("key", "r"))
    rough = used.groupBy("key").agg(F.sqrt(F.avg(F.col("r") * F.col("r"))).alias("roughness_m"))
    rough = rough.join(exact_percentile(used, ["key"], "r", 0.95, "planarity_residual_p95_m"), "key").select("key.*", "roughness_m", "planarity_residual_p95_m")
    out = _met(fit, means, keys).join(rough.withColumnsRenamed({k: f"_r_{k}" for k in keys}), _same(keys, "_r_"), "left").drop(*[f"_r_{k}" for k in keys])
    n = F.col("normal")
    level = F.greatest(F.abs(G.at(n, 0)), F.abs(G.at(n, 1))) < 1e-9
    return out.select(
        *keys,
        "n_points",
        F.col("n").alias("n_used"),
        n,
        (F.col("shift") + G.dot(n, F.array(*[F.col(f"c{a}") for a in AXES]))).alias("offset_m"),
        (F.col("n") / F.col("n_points")).alias("inlier_ratio"),
        F.degrees(F.atan2(F.sqrt(G.at(n, 0) * G.at(n, 0) + G.at(n, 1) * G.at(n, 1)), G.at(n, 2))).alias("slope_deg"),
        F.when(~level, F.degrees(F.atan2(G.at(n, 0), G.at(n, 1)))).alias("aspect_deg"),
        "roughness_m",
        "planarity_residual_p95_m",
        "err",
    )


def _same(keys: list[str], prefix: str) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond &= F.col(k).eqNullSafe(F.col(f"{prefix}{k}"))
    return cond


def _gap(cells: DataFrame, line: list[str], along: str) -> DataFrame:
    """cells with _first and _last of the run of cells, without a hole, that each lies in along its line."""
    run = F.col(along) - F.row_number().over(Window.partitionBy(*line).orderBy(along))
    of = Window.partitionBy(*line, "_run")
    return cells.withColumn("_run", run).withColumns({"_first": F.min(along).over(of), "_last": F.max(along).over(of)}).drop("_run")


def clearances(cells: DataFrame, keys: list[str]) -> DataFrame:
    """keys, i, j and far2 of each distinct cell: the squared distance, in cells, to the nearest cell that the key doesn't have.

    Whole numbers of cells, so far2 is exact. A row's cells meet in one window and an unbroken stretch of a column in
    one array, so memory goes by a region's side and not by its area; a cell looks along its column no farther than its
    row's clearance. Cells with a null place are left out, repeated ones count once, and a null in a key makes a key of its own.
    """
    clean = cells.select(*keys, F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j")).filter("i IS NOT NULL AND j IS NOT NULL").distinct()
    rows = _gap(clean, [*keys, "j"], "i")
    rows = rows.select(*keys, "i", "j", F.least(F.col("i") - F.col("_first") + 1, F.col("_last") - F.col("i") + 1).alias("g"))
    columns = _gap(rows, [*keys, "i"], "j").groupBy(*keys, "i", "_first").agg(F.sort_array(F.collect_list(F.struct("j", "g"))).alias("s"))
    last = F.size("s") - 1

    def nearest(cell: Column, p: Column) -> Column:
        ends = F.least(p + 1, last - p + 1).cast("long")
        reach = F.least(cell["g"], ends).cast("int")
        near = F.sequence(F.greatest(p - reach, F.lit(0)), F.least(p + reach, last))
        best = F.array_min(F.transform(near, lambda q: (q - p).cast("long") * (q - p) + F.get(F.col("s"), q)["g"] * F.get(F.col("s"), q)["g"]))
        return F.struct(cell["j"].alias("j"), F.least(best, ends * ends).alias("far2"))

    return columns.select(*keys, "i", F.inline(F.transform("s", nearest)))


def inscribed_circles(cells: DataFrame, keys: list[str], side: float = 1.0) -> DataFrame:
    """keys, area_m2, i, j and radius_m of the largest circle about a cell's middle that holds no middle of a missing cell; of several the smallest (i, j)."""
    best = F.max_by(F.struct("i", "j", "far2"), F.struct("far2", -F.col("i"), -F.col("j")))
    found = clearances(cells, keys).groupBy(*keys).agg(F.count("*").alias("n"), best.alias("b"))
    return found.select(*keys, (F.col("n") * side * side).alias("area_m2"), "b.i", "b.j", (F.sqrt("b.far2") * side).alias("radius_m"))
