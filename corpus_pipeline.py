"""From raw documents to packed training sequences: five stages, each reading the Parquet table that the one before wrote.

ORACLE_SQL is None: SQL can express neither the classifier nor the packing; the tests hold the stages against
brute-force versions.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scenewright.llm import cotraining, line_dedup, mixing, packing
from scenewright.llm import near_copies as near
from scenewright.llm.common import documents, row_keys, stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained views together take for good ones."""
    model = cotraining.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return cotraining.score(docs, model, prefix="_qc_").filter("_qc_quality_keep").select(*[F.col(f"`{c}`") for c in docs.columns])


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the runs of lines that start earlier in the corpus; n_chars follows the text."""
    out = line_dedup.dedup_lines(docs, removed="_ld_n_removed")  # a name of its own, so that a column of the usual one stays
    length = F.when(F.col("_ld_n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", length).select(*[F.col(f"`{c}`") for c in docs.columns])


def _first_of_groups(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """One row of each component: that of the smallest doc_id, null last, and of several the smallest text hash.

    groups has doc_id, component and the two text hashes of common.row_keys for every row. Rows of one id are told
    apart by their texts; only where a row that stays occurs again, its copies meet in an aggregate of their own.
    """
    names = ["_nc_id", "_nc_x", "_nc_y"]
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("_nc_id"), F.col("x").alias("_nc_x"), F.col("y").alias("_nc_y")))
    counted = groups.groupBy("component", "doc_id", "x", "y").agg(F.count("*").alias("n"))
    chosen = counted.groupBy("component").agg(first.alias("f")).select(*[F.col(f"f.{n}") for n in names])
    same = F.col("doc_id").eqNullSafe(F.col("_nc_id")) & (F.col("x") == F.col("_nc_x")) & (F.col("y") == F.col("_nc_y"))
    chosen = stored(counted.join(chosen, same).select(*names, F.col("n").alias("_nc_n")), "near-kept")
    x, y = row_keys(F.col("text"))
    keyed = docs.withColumns({"_nc_p": x, "_nc_q": y})
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_nc_id")) & (F.col("_nc_p") == F.col("_nc_x")) & (F.col("_nc_q") == F.col("_nc_y"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    once = keyed.join(chosen.filter("_nc_n = 1"), same, "left_semi").select(*columns)
    again = chosen.filter("_nc_n > 1")
    if again.isEmpty():
        return once
    met = keyed.join(again, same)
    row = F.struct(*columns)
    one = met.groupBy(*names).agg(F.min_by(row, F.to_json(row)).alias("_nc_row")).select("_nc_row.*").select(*columns)
    return once.unionByName(one)


def alike_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (Jaccard similarity of five-word shingles 0.8 or more) the document with the smallest doc_id.

    Rows that share a doc_id or have none are documents of their own: only near copies go, whatever their ids.
    """
    return _first_of_groups(docs, near.near_rows(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; better labelled ones come first within their source.

    Rows are told apart by id and text. Of rows equal in both the mix may take some once more than the others; which
    of them doesn't matter, and only these rows are numbered.
    """
    x, y = row_keys(F.col("text"))
    keyed = docs.withColumns({"_mx_x": x, "_mx_y": y})
    taken = mixing.mix(keyed, labels=spark.read.parquet(f"{sf_dir}/labels.parquet"), keep=("_mx_x", "_mx_y"))
    times = F.sum(F.when(F.col("size") > 0, F.expr("taken div size")).otherwise(0)).alias("times")
    plan = taken.groupBy("doc_id", "_mx_x", "_mx_y").agg(F.count("*").alias("n"), times).filter("times > 0")
    plan = stored(plan.selectExpr("doc_id AS _mx_id", "_mx_x AS _mx_p", "_mx_y AS _mx_q", "times div n AS _mx_each", "times % n AS _mx_more"), "mix-times")
    met = keyed.join(plan, F.col("doc_id").cast("long").eqNullSafe(F.col("_mx_id")) & (F.col("_mx_x") == F.col("_mx_p")) & (F.col("_mx_y") == F.col("_mx_q")))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    out = met.filter("_mx_more = 0")
    if not plan.filter("_mx_more > 0").isEmpty():
        place = F.row_number().over(Window.partitionBy("_mx_id", "_mx_x", "_mx_y").orderBy(F.to_json(F.struct(*columns))))
        some = met.filter("_mx_more > 0").withColumn("_mx_place", place)
        out = out.unionByName(some.withColumn("_mx_each", F.col("_mx_each") + (F.col("_mx_place") <= F.col("_mx_more")).cast("long")).drop("_mx_place"))
    return out.filter("_mx_each > 0").withColumn("_mx_copy", F.explode(F.sequence(F.lit(1), F.col("_mx_each").cast("int")))).select(*columns)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of tokenized documents with their place in sequences of 4096 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("lines", lines),
    ("near_copies", alike_copies),
    ("mix_sources", mix_sources),
    ("sequences", sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; each but the last is written to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
