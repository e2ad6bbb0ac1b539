from __future__ import annotations

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from oracle import rows_of, run_sql
from scenewright import document_queries, layer_queries, queries, spatial_queries  # noqa: F401
from scenewright.functions import geometry as G
from scenewright.plans import leakage


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, sf, name):
    got, want = queries.QUERIES[name](spark, sf).toPandas(), run_sql(queries.SQL[name], sf)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_entry_has_rows(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
    assert all(isinstance(s, str) for s in e.oracle_sql().values())


def test_rows_do_not_depend_on_partitioning(spark, sf):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found.append([rows_of(queries.QUERIES[q](spark, sf).toPandas()) for q in ("w2_sliding_windows", "a6_merge_objects", "k1_compile_grounding")])
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1]


def test_scan_reads_wanted_columns_only(spark, sf):
    plan = queries.d3_farthest_object(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<vec_id:bigint,embedding:array<float>,label:" in plan
    pixels = queries.p8_kept_pixels(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "l_comment" not in pixels and "l_tax" not in pixels


def _embeddings(spark, folder, rows) -> str:
    rows = [(k, None if v is None else v + [0.0] * (64 - len(v)), 0) for k, v in rows]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(str(folder / "made"))
    next((folder / "made").glob("*.parquet")).rename(folder / "embeddings.parquet")
    return str(folder)


def test_leakage_scan_finds_distances_of_one_or_two_digits(spark, tmp_path):
    at = {0: 0.5, 1: 0.5, 2: 0.375, 3: 0.375, 5: 0.25, 7: 0.31640625}  # 20, 20, 7.5, 7.5, 5 and 1.640625 from the observer
    data = _embeddings(spark, tmp_path, [(k, [0.0, 0.0, z]) for k, z in at.items()] + [(9, None)])
    got, want = queries.f11_leakage_scan(spark, data).toPandas(), run_sql(queries.SQL["f11_leakage_scan"], data)
    assert rows_of(got) == rows_of(want)
    assert dict(zip(got["object_id"], got["leaks"])) == {
        "<obj_000>": True, "<obj_001>": True, "<obj_002>": True, "<obj_003>": True, "<obj_005>": True, "<obj_007>": False, "<obj_009>": None,
    }


def test_short_words_are_no_atoms(spark):
    """Nor does one turn into the word null."""
    o = spark.sql("SELECT named_struct('a', 'null or left') AS p, named_struct('lateral', 'left') AS t")
    found = leakage.findings(F.col("p"), o.schema["p"].dataType, leakage.atoms(F.col("t"), o.schema["t"].dataType))
    assert o.select(found.alias("f")).first()["f"] == []


def test_pose_parts_equal_their_sql_to_the_last_digit(spark, tmp_path):
    """Keys so large that a double ends near the sixth decimal; a quarter turn; cosines whose last bit depends on the library."""
    rows = [(k * 1_000_000_000 + i, float(b)) for k in range(4) for i, b in enumerate(range(-1000, 10000, 7))] + [(11, 90.0), (22, 270.0)]
    pd.DataFrame(rows, columns=["s_suppkey", "s_acctbal"]).to_parquet(tmp_path / "supplier.parquet")
    got, want = queries.g5_pose_parts(spark, str(tmp_path)).toPandas(), run_sql(queries.SQL["g5_pose_parts"], str(tmp_path))
    assert rows_of(got) == rows_of(want)
    assert set(got.loc[got["s_suppkey"].isin([11, 22]), "err"]) == {"not a rigid pose"}


def test_rounding_goes_by_the_product(spark):
    """Not by the shortest decimal form; what can't be rounded stays."""
    numbers = [818350672.4570015, -539506003.5804805, 0.5, -2.5, 1e300, float("inf"), float("nan"), None]
    got = [r["r"] for r in spark.createDataFrame([(x,) for x in numbers], "x double").select(G.rounded(F.col("x"), 6).alias("r")).collect()]
    want = duckdb.sql("SELECT list(round(x, 6) ORDER BY i) FROM (SELECT unnest($v) AS x, unnest(range(0, 8)) AS i)", params={"v": numbers}).fetchall()[0][0]
    assert [repr(x) for x in got] == [repr(x) for x in want]
