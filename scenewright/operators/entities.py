"""From pixels and points to objects: filters, statistics, components, merging and fusion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from scenewright.functions import geometry as G
from scenewright.functions import text as T

#: What boundaries and categories of fused instances rest on.
BOUNDARY_SOURCE, CATEGORY_SOURCE = "grounded_sam2::gdino_base+sam2.1_hiera_bplus", "oneformer_ade20k_swin_large"
#: Quantile of confidence below which a scene's pixels are dropped; least pixels of a component and valid points of an object.
FLOOR_QUANTILE, LEAST_PIXELS, LEAST_POINTS = 0.25, 400, 120


def valid_depth(depth: Column) -> Column:
    return F.coalesce(depth.isNotNull() & ~F.isnan(depth) & (depth > 0) & (depth < float("inf")), F.lit(False))


def exact_percentile(rows: DataFrame, keys: list[str], value: str, share: float, name: str) -> DataFrame:
    """keys and the exact percentile (linear between neighbours) of a column by keys; nulls and NaN don't count.

    Equal values are counted first, with partial sums; a running sum over the counts then finds the two values around
    the place. No buffer holds a key's values.
    """
    counts = rows.filter(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(*keys, value).agg(F.count("*").alias("n"))
    order = Window.partitionBy(*keys).orderBy(value)
    counts = counts.withColumn("upto", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    totals = counts.groupBy(*keys).agg(((F.sum("n") - 1) * share).alias("place"))
    met = counts.join(totals, keys)
    at = lambda p: F.min(F.when(F.col("upto") > p, F.col(value)))
    low, high = at(F.floor("place")), at(F.ceil("place"))
    part = F.max(F.col("place") - F.floor("place"))
    return met.groupBy(*keys).agg((low + (high - low) * part).alias(name))


def depth_statistics(pixels: DataFrame) -> DataFrame:
    """By scene: conf_floor (exact percentile), coverage (share of pixels over it), invalid_ratio (share of depths that are no finite number), median_depth over depths that are numbers."""
    floors = exact_percentile(pixels, ["scene_id"], "conf", FLOOR_QUANTILE, "conf_floor")
    rows = pixels.join(floors, "scene_id")
    finite = F.coalesce(F.col("depth").isNotNull() & ~F.isnan("depth") & (F.abs("depth") < float("inf")), F.lit(False))
    out = rows.groupBy("scene_id", "conf_floor").agg(
        F.count("*").alias("n_pixels"),
        F.avg((F.col("conf") > F.col("conf_floor")).cast("double")).alias("coverage"),
        F.avg((~finite).cast("double")).alias("invalid_ratio"),
        F.max("conf").alias("scene_conf"),
    )
    return out.join(exact_percentile(pixels, ["scene_id"], "depth", 0.5, "median_depth"), "scene_id", "left")


def kept_pixels(pixels: DataFrame, floors: DataFrame, skip: list[int]) -> DataFrame:
    """Pixels of classes not skipped, with a valid depth and a confidence at or over their scene's floor."""
    return pixels.join(floors.select("scene_id", "conf_floor"), "scene_id").filter(
        valid_depth(F.col("depth")) & (F.col("conf") >= F.col("conf_floor")) & ~F.col("class_id").isin(skip)
    )


def label_components(y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Component of each pixel under 4-neighbourhood: the row-major rank of the component's first pixel.

    Each round every pixel takes the least label around it and then the label of that label, so rounds grow with the
    logarithm of a component's size.
    """
    if not len(y):
        return np.empty(0, np.int64)
    width = int(x.max()) + 2
    place = y.astype(np.int64) * width + x
    order = np.argsort(place, kind="stable")
    sorted_place = place[order]
    label = np.arange(len(place))

    def neighbour(step: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(sorted_place, sorted_place + step)
        here = np.flatnonzero((at < len(at)) & (sorted_place[np.minimum(at, len(at) - 1)] == sorted_place + step))
        return here, at[here]

    pairs = [neighbour(1), neighbour(width)]
    while True:
        before = label.copy()
        for a, b in pairs:
            low = np.minimum(label[a], label[b])
            np.minimum.at(label, label[a], low)
            np.minimum.at(label, label[b], low)
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    rank = np.unique(label, return_inverse=True)[1]
    out = np.empty(len(place), np.int64)
    out[order] = rank
    return out


def label_frames(part: pd.DataFrame) -> pd.DataFrame:
    """Whole frames with component, numbered from 0 within (frame, class_id): all classes of all frames are laid out below each other, with a gap, and labelled at once."""
    group = part.groupby(["frame", "class_id"], dropna=False, sort=False).ngroup().to_numpy()
    y = part["y"].to_numpy() - part["y"].min()
    label = label_components(group * (int(y.max()) + 2) + y, part["x"].to_numpy() - part["x"].min())
    first = np.full(group.max() + 1, len(part), np.int64)
    np.minimum.at(first, group, label)
    return part.assign(component=label - first[group])


def components(pixels: DataFrame) -> DataFrame:
    """pixels with component, numbered from 0 within (frame, class_id).

    Frames come to a task one after the other and are labelled as many at a time as a batch brings, so memory is that
    of a batch and one frame, and no call is made for each class of each frame. A null frame or class is one of its own.
    """

    def label(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # of the last frame, which the next batch may go on with
        for part in parts:
            if part.empty:
                continue
            last = part["frame"].iloc[-1]
            ends = (part["frame"].isna() if pd.isna(last) else part["frame"].eq(last)).to_numpy()
            before = held[-1]["frame"].iloc[-1] if held else last
            if ends.all() and (before == last or (pd.isna(before) and pd.isna(last))):
                held.append(part)
                continue
            yield label_frames(pd.concat([*held, part[~ends]]))
            held = [part[ends]]
        if held:
            yield label_frames(pd.concat(held))

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pixels.schema)
    return pixels.repartition("frame").sortWithinPartitions("frame").mapInPandas(label, f"{names}, component long")


def objects_of(pixels: DataFrame, floors: DataFrame, least_pixels: int = LEAST_PIXELS, least_points: int = LEAST_POINTS) -> DataFrame:
    """Components as objects: pixels, valid points, centroid, box, mean and relative confidence. Needs columns px, py, pz of back-projected points; floors are depth_statistics of all pixels."""
    rows = pixels.join(floors.select("scene_id", "conf_floor", "scene_conf"), "scene_id")
    good = valid_depth(F.col("depth")) & (F.col("conf") >= F.col("conf_floor"))
    of = lambda c: F.when(good, F.col(c))
    return (
        rows.groupBy("scene_id", "frame", "class_id", "component")
        .agg(
            F.count("*").alias("n_pixels"), F.count_if(good).alias("n_points"),
            *[F.avg(of(c)).alias(f"c{c[1]}") for c in ("px", "py", "pz")],
            *[f(of(c)).alias(f"{n}{c[1]}") for c in ("px", "py", "pz") for n, f in (("min_", F.min), ("max_", F.max))],
            F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.avg(of("conf")) / (F.first("scene_conf") + 1e-9))).alias("confidence"),
        )
        .filter((F.col("n_pixels") >= least_pixels) & (F.col("n_points") >= least_points))
    )


def point_statistics(points: DataFrame, keys: list[str]) -> DataFrame:
    """Centroid, box and covariance (ddof 1) of each key's points in one pass with partial sums."""
    agg = [F.count("*").alias("n")]
    for a in "xyz":
        agg += [F.avg(a).alias(f"c{a}"), F.min(a).alias(f"min_{a}"), F.max(a).alias(f"max_{a}"), F.var_samp(a).alias(f"v{a}{a}")]
    agg += [F.covar_samp(a, b).alias(f"v{a}{b}") for a, b in ("xy", "xz", "yz")]
    return points.groupBy(*keys).agg(*agg)


@F.pandas_udf(ArrayType(DoubleType()))
def _axes(xx: pd.Series, yy: pd.Series, zz: pd.Series, xy: pd.Series, xz: pd.Series, yz: pd.Series) -> pd.Series:
    """Eigenvalues, largest first, and unit eigenvectors of symmetric matrices: 12 numbers."""
    m = np.stack([np.stack([xx, xy, xz], -1), np.stack([xy, yy, yz], -1), np.stack([xz, yz, zz], -1)], -2).astype(float)
    good = np.isfinite(m).all(axis=(1, 2))
    out: list[np.ndarray | None] = [None] * len(m)
    if good.any():
        values, vectors = np.linalg.eigh(m[good])
        for i, v, w in zip(np.flatnonzero(good), values[:, ::-1], vectors[:, :, ::-1], strict=True):
            out[i] = np.concatenate([v, w.T.ravel()])
    return pd.Series(out)


def oriented_boxes(points: DataFrame, keys: list[str]) -> DataFrame:
    """keys, variances (largest first), axes, extent, center, err. Fewer than three points or no spread: err.

    Only one row per key meets numpy, six numbers each in batches; points are projected on the axes and reduced by
    Spark.
    """
    stats = point_statistics(points, keys)
    axes = stats.withColumn("e", _axes(*[F.col(c) for c in ("vxx", "vyy", "vzz", "vxy", "vxz", "vyz")]))
    err = F.when(F.col("n") < 3, "fewer than three points").when(F.col("e").isNull() | (F.get("e", F.lit(0)) <= 1e-12), "points do not spread")
    axes = axes.select(
        *keys,
        F.array("cx", "cy", "cz").alias("mean"),
        F.slice("e", 1, 3).alias("variances"),
        F.array(*[F.slice("e", 4 + 3 * k, 3) for k in range(3)]).alias("axes"),
        err.alias("err"),
    )
    p = F.array("x", "y", "z")
    met = points.join(axes, keys)
    along = [G.dot(G.sub(p, F.col("mean")), F.get("axes", F.lit(k))) for k in range(3)]
    out = met.groupBy(*keys).agg(
        F.first("mean").alias("mean"),
        F.first("variances").alias("variances"),
        F.first("axes").alias("axes"),
        F.first("err").alias("err"),
        *[f(a).alias(f"{n}{k}") for k, a in enumerate(along) for n, f in (("lo", F.min), ("hi", F.max))],
    )
    center = F.col("mean")
    for k in range(3):
        center = G.add(center, G.scale(F.get("axes", F.lit(k)), (F.col(f"lo{k}") + F.col(f"hi{k}")) / 2))
    good = F.col("err").isNull()
    return out.select(
        *keys,
        "variances",
        F.when(good, F.col("axes")).alias("axes"),
        F.when(good, F.array(*[F.col(f"hi{k}") - F.col(f"lo{k}") for k in range(3)])).alias("extent"),
        F.when(good, center).alias("center"),
        "err",
    )


MERGED = "scene_id string, category string, seed long, cx double, cy double, cz double, point_count long, lo array<double>, hi array<double>, frames array<long>, merged_from array<long>"


def merge_objects(objects: DataFrame, factor: float = 0.25) -> DataFrame:
    """Greedy merge across frames: in the order of pos, the first unused object takes all later unused ones of its
    category whose centroid lies within factor times the scene's extent of its own; then the next.

    Needs scene_id, category, pos, frame, x, y, z, point_count and lo, hi (arrays). The result depends on the order
    and isn't transitive, so one category of one scene is one group; the scene's extent is aggregated before.
    """
    size = objects.groupBy("scene_id").agg(F.sqrt(sum(F.pow(F.max(a) - F.min(a), 2) for a in "xyz")).alias("size"))
    rows = objects.join(size.select("scene_id", F.when(F.col("size") > 0, F.col("size") * factor).otherwise(1.0).alias("threshold")), "scene_id")

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("pos", ignore_index=True)
        xyz, weight = part[["x", "y", "z"]].to_numpy(), part["point_count"].to_numpy()
        lo, hi = np.stack(part["lo"].to_numpy()), np.stack(part["hi"].to_numpy())
        free, rows = np.ones(len(part), dtype=bool), []
        for i in range(len(part)):
            if not free[i]:
                continue
            take = np.flatnonzero(free & (np.arange(len(part)) >= i) & (np.sqrt(((xyz - xyz[i]) ** 2).sum(axis=1)) <= part["threshold"].iat[i]))
            take = take if i in take else np.append(i, take)  # a seed without a centroid stands alone
            free[take] = False
            w = weight[take]
            mean = (xyz[take] * w[:, None]).sum(axis=0) / max(w.sum(), 1)
            rows.append(
                (
                    part["scene_id"].iat[i],
                    part["category"].iat[i],
                    part["pos"].iat[i],
                    *mean,
                    int(w.sum()),
                    lo[take].min(axis=0).tolist(),
                    hi[take].max(axis=0).tolist(),
                    sorted(set(part["frame"].iloc[take].tolist())),
                    part["pos"].iloc[take].tolist(),
                )
            )
        return pd.DataFrame(rows, columns=[f.split()[0] for f in MERGED.split(", ")])

    merged = rows.groupBy("scene_id", "category").applyInPandas(merge, MERGED)
    order = Window.partitionBy("scene_id").orderBy("seed")
    return merged.withColumn("object_id", T.format_id("obj", F.row_number().over(order)))


def close_pairs(objects: DataFrame, radius: float) -> DataFrame:
    """Pairs a < b of one scene and category no further apart than radius, by cells of that size: each row meets its own and the neighbouring cells only."""
    cell = lambda c: F.floor(F.col(c) / radius).cast("bigint")
    left = objects.select("scene_id", "category", F.col("pos").alias("a"), *[F.col(c).alias(f"a{c}") for c in "xyz"], *[cell(c).alias(f"g{c}") for c in "xyz"])
    for c in "xyz":
        left = left.withColumn(f"g{c}", F.explode(F.sequence(F.col(f"g{c}") - 1, F.col(f"g{c}") + 1)))
    right = objects.select("scene_id", "category", F.col("pos").alias("b"), *[F.col(c).alias(f"b{c}") for c in "xyz"], *[cell(c).alias(f"g{c}") for c in "xyz"])
    d = F.sqrt(sum(F.pow(F.col(f"a{c}") - F.col(f"b{c}"), 2) for c in "xyz"))
    return left.join(right, ["scene_id", "category", "gx", "gy", "gz"]).filter((F.col("a") < F.col("b")) & (d <= radius)).select(
        "scene_id", "category", "a", "b", d.alias("distance"),
    )


def runs_of(masks: DataFrame) -> DataFrame:
    """Rectangles (y0, y1, x0, x1) as one run (y, x0, x1) for each of their lines; runs stay."""
    return masks if "y" in masks.columns else masks.withColumn("y", F.explode(F.sequence("y0", "y1"))).drop("y0", "y1")


def fuse_instances(masks: DataFrame, pixels: DataFrame, ignore: list[int], min_purity: float = 0.0) -> DataFrame:
    """Each mask's class by majority of its pixels, ignored classes not voting, and the share of that class (purity).

    Ties go to the lowest class. Masks without a vote disappear, as do those whose purity is below min_purity.
    masks: instance_id, frame and the inclusive rectangle y0..y1, x0..x1, or rows of runs (y, x0, x1) with one row for
    each run of an instance of any shape. They meet pixels by (frame, y), never pixel by pixel of their own.
    """
    cover = runs_of(masks)
    votes = cover.join(
        pixels.select("frame", "y", "x", "class_id"), ["frame", "y"],
    ).filter(F.col("x").between(F.col("x0"), F.col("x1"))).filter(~F.col("class_id").isin(ignore)).groupBy("instance_id", "class_id").agg(F.count("*").alias("votes"))
    won = votes.groupBy("instance_id").agg(
        F.max_by("class_id", F.struct("votes", -F.col("class_id"))).alias("class_id"), F.max("votes").alias("votes"), F.sum("votes").alias("n_votes"),
    )
    return won.withColumn("purity", F.round(F.col("votes") / F.col("n_votes"), 4)).filter(F.col("purity") >= min_purity)


def misfits(masks: DataFrame, shapes: DataFrame) -> DataFrame:
    """instance_id, frame, err of masks that can't be laid over their frame: beyond its height and width, or of a frame that shapes (frame, height, width) hasn't.

    Fusing such a mask would count only the part that fits, so it is an error of the input.
    """
    runs = runs_of(masks).groupBy("instance_id", "frame").agg(F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x0").alias("x0"), F.max("x1").alias("x1"))
    met = runs.join(shapes.select("frame", "height", "width"), "frame", "left")
    out = (F.col("y0") < 0) | (F.col("x0") < 0) | (F.col("y1") >= F.col("height")) | (F.col("x1") >= F.col("width"))
    err = F.when(F.col("height").isNull(), "no such frame").when(out, "shape differs from the frame's")
    return met.withColumn("err", err).filter("err is not null").select("instance_id", "frame", "err")


def best_masks(candidates: DataFrame) -> DataFrame:
    """Of each instance's candidate masks (instance_id, k, iou) the one with the largest predicted overlap, the first of equal ones."""
    known = F.when(~F.isnan("iou"), F.col("iou"))
    return candidates.groupBy("instance_id").agg(F.max_by("k", F.struct(known, -F.col("k"))).alias("k"), F.max(known).alias("iou"))


def with_proposals(fused: DataFrame, masks: DataFrame, classes: list[str]) -> DataFrame:
    """fused instances with their class's name, the label that was proposed for them, its canonical class, and whether both agree.

    The name comes from the vote alone; a proposal never changes it. boundary_from and category_from say what each rests on.
    """
    rows = fused.join(
        masks.select(
            "instance_id", F.col("label").alias("label_proposed"), ((F.col("y1") - F.col("y0") + 1) * (F.col("x1") - F.col("x0") + 1)).alias("mask_pixels"),
        ),
        "instance_id",
    )
    name = F.coalesce(F.get(F.array(*[F.lit(c) for c in classes]), F.col("class_id").cast("int")), F.lit("other"))
    rows = rows.withColumn("category", name).withColumn("label_proposed_canonical", T.canonical_class(F.col("label_proposed")))
    rows = rows.withColumn("category_agrees", F.col("category") == F.col("label_proposed_canonical"))
    return rows.withColumns({"boundary_from": F.lit(BOUNDARY_SOURCE), "category_from": F.lit(CATEGORY_SOURCE)})


def camera_span(poses: DataFrame, keys: list[str]) -> DataFrame:
    """Length of the diagonal of the box around camera centres x, y, z."""
    return poses.groupBy(*keys).agg(F.sqrt(sum(F.pow(F.max(a) - F.min(a), 2) for a in "xyz")).alias("span"))


def relabel(pixels: DataFrame, table: list[str]) -> DataFrame:
    """class_id looked up in a small table of canonical classes; ids outside it are "other"."""
    return pixels.withColumn("category", F.coalesce(F.get(F.array(*[F.lit(c) for c in table]), F.col("class_id").cast("int")), F.lit("other")))


def resize_nearest(pixels: DataFrame, height: int, width: int, to_height: int, to_width: int) -> DataFrame:
    """Nominal pixels at another size, never interpolated: target (y, x) takes source floor((y + 0.5) * height / to_height), alike for x."""
    # the targets t with floor((t + 0.5) * n / m) = s are those from ceil(s * m / n - 0.5) to the next one's first
    def targets(c: str, n: int, m: int) -> Column:
        first = lambda at: F.greatest(F.lit(0), F.ceil(at * m / n - 0.5)).cast("int")
        low, high = first(F.col(c)), F.least(first(F.col(c) + 1), F.lit(m))
        return F.when(low < high, F.sequence(low, high - 1))

    return pixels.withColumn(
        "new_y", F.explode(targets("y", height, to_height)),
    ).withColumn("new_x", F.explode(targets("x", width, to_width))).drop("y", "x").withColumnsRenamed({"new_y": "y", "new_x": "x"})
