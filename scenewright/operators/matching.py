"""Rows that go together across sources: the last one at or before a time, and the nearest one of another run."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scenewright.sources.readers import materialized


def as_of(left: DataFrame, right: DataFrame, keys: list[str], ts: str, values: list[str], tie: str, width: int, within: int | None = None) -> DataFrame:
    """left with values of the last row of right of the same keys at or before its ts, and as_of_ts; null where there is none.

    Of rows of right at one time the one with the largest tie is the last. within: rows older than that don't count.
    Both sides are put in order together once, by stretches of width, so no task orders a whole key, and no pair of
    rows is made; what the stretches before hold is one row of each, carried forward. Rows with a null key or time get
    nulls. Other columns of left stay; names in values must not be among them.
    """
    found = F.struct(F.col(ts).alias("as_of_ts"), *values)
    stretch = F.floor(F.col(ts) / width).alias("_stretch")
    whole = F.struct(*[F.col(f"`{c}`") for c in left.columns])
    order = [*keys, "_stretch"]
    r = right.select(*keys, stretch, F.col(ts).alias("_ts"), F.lit(0).alias("_side"), F.col(tie).alias("_tie"), found.alias("_found"))
    rows = left.select(*keys, stretch, F.col(ts).alias("_ts"), F.lit(1).alias("_side"), whole.alias("_row"))
    both = r.filter("_ts is not null").unionByName(rows, allowMissingColumns=True)
    last = F.last("_found", ignorenulls=True)
    held = both.groupBy(*order).agg(F.max_by("_found", F.when(F.col("_side") == 0, F.struct("_ts", "_tie"))).alias("_found"))
    held = held.withColumn("_before", last.over(Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1))).drop("_found")
    placed = both.withColumn("_own", last.over(Window.partitionBy(*order).orderBy("_ts", "_side", "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    placed, held = placed.filter("_side = 1").select(*order, "_row", "_own"), held.withColumnsRenamed({c: f"_of{c}" for c in order})
    same = reduce(lambda c, k: c & F.col(k).eqNullSafe(F.col(f"_of{k}")), order, F.lit(True))
    got = F.coalesce("_own", "_before")
    bad = reduce(lambda c, k: c | F.col(f"_row.{k}").isNull(), [*keys, ts], F.lit(False))
    if within is not None:
        bad |= F.col(f"_row.{ts}") - got["as_of_ts"] > within
    out = placed.join(held, same, "left").withColumn("_got", F.when(~bad, got))
    return out.select("_row.*", "_got.as_of_ts", *[F.col(f"_got.{v}") for v in values])


def nearest_of_other_runs(rows: DataFrame, radius: float, rings: int = 4) -> DataFrame:
    """run, id, other_run, other_id, distance: for each row with a neighbour in another run within radius the nearest one, of equal ones the smallest (run, id).

    rows: run, id, x, y. The search begins with cells of radius / 2^(rings - 1): what has a neighbour no further than
    a cell's side has its nearest one in the cell or those around it, and is done; the rest goes on with cells of
    twice the size. So in crowded places few cells are looked at, and only rows with nobody near see large ones. Rows
    of a run at one place are one row for others to find. Rows with a null run, id or coordinate find nothing and
    aren't found.
    """
    clean = rows.filter(" and ".join(f"{c} is not null" for c in ("run", "id", "x", "y"))).filter(~(F.isnan("x") | F.isnan("y")))
    places = clean.groupBy(F.col("run").alias("other_run"), F.col("x").alias("ox"), F.col("y").alias("oy")).agg(F.min("id").alias("other_id"))
    waiting, found = clean.select("run", "id", "x", "y"), []
    for ring in reversed(range(rings)):
        size = radius / 2**ring
        at = lambda c: F.floor(F.col(c) / size).cast("bigint")  # noqa: E731, B023
        around = waiting
        for c in ("x", "y"):
            around = around.withColumn(f"c{c}", F.explode(F.sequence(at(c) - 1, at(c) + 1)))
        d = F.sqrt(F.pow(F.col("x") - F.col("ox"), 2) + F.pow(F.col("y") - F.col("oy"), 2))
        met = around.join(places.withColumns({"cx": at("ox"), "cy": at("oy")}), ["cx", "cy"]).filter((F.col("run") != F.col("other_run")) & (d <= size))
        best = met.groupBy("run", "id").agg(F.min(F.struct(d.alias("distance"), "other_run", "other_id")).alias("best"))
        best = materialized(best.select("run", "id", "best.other_run", "best.other_id", "best.distance"))
        found.append(best)
        waiting = materialized(waiting.join(best, ["run", "id"], "left_anti")) if ring else waiting
    return reduce(DataFrame.unionByName, found)
