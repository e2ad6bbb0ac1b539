"""Phrase collocation mining over whole corpora.

Every run of one to `most` words within a piece of text becomes a row; rows are counted by language and phrase. A
phrase of two words or more that occurs often enough is a candidate. Each way of cutting it in two is scored by its
count against those of its parts, which are looked up by joins; the worst cut counts. A candidate that mostly occurs
within one that is a word longer is dropped: the longer ones name their two shorter ones, the most frequent of them is
kept for each, and an anti-join takes out what it covers. A phrase inside a still longer one is inside one of the
phrases between them, which occurs at least as often, so one word more is all that has to be looked at.

A task numbers its words and counts phrases as numbers before it makes rows of them, BATCH words at a time; everything
from there on is DataFrame functions.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scenewright.llm.common import discard, documents, stored, trim, utf8, word_runs

#: Characters between pieces; all become line breaks, then a word of their own, which no other word is.
BREAKS, STOP = b".,;:!?\n\x0b\x0c\r", b"."
TO_STOPS = bytes.maketrans(BREAKS, b"\n" * len(BREAKS))
#: Words of a phrase; occurrences of a candidate; per cent of its occurrences within a longer one; phrases of a language.
MOST, LEAST, COVER, TOP = 3, 10, 50, 2000
#: Scores are in millionths. Words that a task counts at once. Parts in which a language is ranked before the whole.
SCALE, BATCH, PARTS = 1_000_000, 1_500_000, 64


def counted(ids: np.ndarray, names: pa.Array, most: int, head: int = 0) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Phrases of 1 to most words and their counts, from numbered words (0: a break) and the words' names.

    Those that end within the first head words were counted before. A phrase of k words is known by the number of its
    first k - 1 and its last one.
    """
    size, code, open_ = len(names), ids, ids != 0
    found, n = np.unique(ids[head:][open_[head:]], return_counts=True)
    yield names.take(pa.array(found)), n
    begun = names
    for k in range(2, min(most, len(ids)) + 1):
        at = np.flatnonzero(open_[: len(ids) - k + 1] & (ids[k - 1 :] != 0))
        codes, keys = pd.factorize(code[at] * size + ids[at + k - 1], sort=True)
        n = np.bincount(codes[at >= head - k + 1], minlength=len(keys))
        begun = pc.binary_join_element_wise(begun.take(pa.array(keys // size)), names.take(pa.array(keys % size)), " ")
        yield begun.filter(pa.array(n > 0)), n[n > 0]
        code = np.zeros(len(ids) - k + 1, dtype=np.int64)
        open_ = np.zeros(len(code), dtype=bool)
        code[at], open_[at] = codes, True


def phrase_rows(batches: Iterator[pa.RecordBatch], most: int = MOST, size: int = BATCH) -> Iterator[pa.RecordBatch]:
    """Rows (lang, phrase, n) of rows (lang, text), counted over size words at a time, however long a text is."""
    ids: dict[bytes, int] = defaultdict(count().__next__)
    held: dict[str, list[np.ndarray]] = defaultdict(list)
    heads: dict[str, int] = {}
    words = 0

    def numbered(found: list[bytes]) -> np.ndarray:
        return np.fromiter(map(ids.__getitem__, found), dtype=np.int64, count=len(found))

    def rows() -> Iterator[pa.RecordBatch]:
        names = pa.array(list(ids), pa.binary())
        order = np.concatenate([[0], pc.sort_indices(names[1:]).to_numpy().astype(np.int64) + 1])
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        names = names.take(pa.array(order)).cast(pa.string())
        for lang, parts in held.items():
            for phrases, n in counted(rank[np.concatenate(parts)], names, most, heads.get(lang, 0)):
                # By length, then by words: neighbouring rows differ in few bytes, so that shuffle files compress.
                by = pa.array(np.argsort(pc.binary_length(phrases).to_numpy(), kind="stable"))
                phrases, n = phrases.take(by), n[by.to_numpy()]
                for i in range(0, len(phrases), 1 << 16):
                    some = phrases[i : i + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(some)), some, pa.array(n[i : i + (1 << 16)])], names=["lang", "phrase", "n"])
        for x in (held, heads, ids):
            x.clear()

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
            tail: list[bytes] = []
            for found in word_runs(text.lower().translate(TO_STOPS).replace(b"\n", b" " + STOP + b" ")):
                if not ids:
                    ids.default_factory = count().__next__
                    ids[STOP]  # number 0
                held[lang].append(numbered(found))
                words += len(found)
                tail = (tail + found)[-most + 1 :] if most > 1 else []
                if words >= size:
                    yield from rows()
                    trim()
                    ids.default_factory = count().__next__
                    ids[STOP]
                    heads[lang], words = len(tail), 0
                    held[lang].append(numbered(tail))
            held[lang].append(np.zeros(1, dtype=np.int64))
    if words:
        yield from rows()
    trim()  # a worker that waits for its next task holds no batch


def phrase_counts(docs: DataFrame, most: int = MOST, text: str = "text", lang: str = "lang", batch: int = BATCH) -> DataFrame:
    """lang (null: und), phrase, n: every phrase of 1 to most words and how often it occurs, overlaps included.

    Rows come counted by task, so few tasks' rows of a phrase are equal, and they are dealt out by phrase at once.
    """
    rows = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")), F.coalesce(F.col(f"`{text}`"), F.lit("")))
    rows = rows.mapInArrow(lambda batches: phrase_rows(batches, most, batch), "lang string, phrase string, n long")
    return rows.repartition("lang", "phrase").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def collocations(
    docs: DataFrame,
    most: int = MOST,
    least: int = LEAST,
    cover: int = COVER,
    top: int = TOP,
    text: str = "text",
    lang: str = "lang",
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first top phrases of each language.

    a counts the phrase, l and r the parts of its lowest-scoring cut (of equal scores the earliest), n all words of the
    language; score is floor(1000000 a a / (l r)), in decimals of 38 digits, which hold it up to 10^15 occurrences.
    Ranked by score and a, both descending, then by the phrase's bytes. A null text is empty, a null language und.
    Repeated rows count each time. Other columns are not looked at, whatever they are called. A language without
    candidates has no row, and so have no documents.

    A frequent phrase is counted by task before it is shuffled, and counts are stored before they are joined, so that
    Spark can split the words that are part of very many candidates. A language is ranked in parts first, of which
    each sends at most top rows on. Texts of any length are counted BATCH words at a time.
    """
    counts = phrase_counts(docs, most, text, lang).withColumn("k", F.regexp_count("phrase", F.lit(" ")) + 1)
    counts = stored(counts.filter((F.col("k") == 1) | (F.col("n") >= least)), "phrase-counts")
    totals = counts.filter("k = 1").groupBy("lang").agg(F.sum("n").alias("words"))
    often = counts.filter(F.col("n") >= least)
    found = often.filter("k > 1").withColumnRenamed("n", "a")
    longer = found.filter("k > 2").withColumn("w", F.split("phrase", " "))
    shorter = F.array(*[F.array_join(F.slice("w", F.lit(i), F.col("k") - 1), " ") for i in (1, 2)])
    longer = longer.select("lang", F.explode(shorter).alias("inner"), "a").groupBy("lang", "inner").agg(F.max("a").alias("outer_a"))
    longer = stored(longer.withColumnRenamed("lang", "inner_lang"), "phrase-outer")
    covered = (F.col("lang") == F.col("inner_lang")) & (F.col("phrase") == F.col("inner")) & (100 * F.col("outer_a") >= cover * F.col("a"))
    found = found.join(longer, covered, "left_anti").withColumn("w", F.split("phrase", " "))
    cut = lambda i: F.struct(
        i.alias("cut"), F.array_join(F.slice("w", F.lit(1), i), " ").alias("left"), F.array_join(F.slice("w", i + 1, F.col("k") - i), " ").alias("right")
    )
    cuts = found.select("lang", "phrase", "a", F.inline(F.transform(F.sequence(F.lit(1), F.col("k") - 1), cut)))
    part = lambda name, n: often.select(F.col("lang").alias(f"{name}_lang"), F.col("phrase").alias(name), F.col("n").alias(n))
    for side, n in (("left", "l"), ("right", "r")):
        cuts = cuts.join(part(f"{side}_phrase", n), (F.col("lang") == F.col(f"{side}_phrase_lang")) & (F.col(side) == F.col(f"{side}_phrase")))
        cuts = cuts.drop(f"{side}_phrase_lang", f"{side}_phrase", side)
    exact = lambda c: f"CAST({c} AS DECIMAL(19, 0))"
    score = F.expr(f"CAST({SCALE} AS DECIMAL(7, 0)) * {exact('a')} * {exact('a')} div ({exact('l')} * {exact('r')})").cast("long")
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("worst"))
    scored = scored.select("lang", "phrase", "a", "worst.l", "worst.r", "worst.score").withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    first = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top)
    first = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    out = stored(first.join(totals.withColumnRenamed("lang", "of"), F.col("lang") == F.col("of")).select("lang", "rank", "phrase", "a", "l", "r", F.col("words").alias("n"), "score"), "phrase-top")
    discard(counts, longer)
    return out


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir).select("lang", "text"))


OP13_SQL = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n-\r]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS w FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM w, range(1, {MOST + 1}) AS v(k)),
c AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
t AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM c WHERE k = 1 GROUP BY lang),
x AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM c WHERE k > 1 AND f >= {LEAST}),
s AS (SELECT x.*, j, array_to_string(w[1:j], ' ') AS lp, array_to_string(w[j + 1:], ' ') AS rp FROM x, range(1, {MOST}) AS v(j) WHERE j < k
  AND NOT EXISTS (SELECT 1 FROM x AS y WHERE y.lang = x.lang AND y.k > x.k AND contains(' ' || y.phrase || ' ', ' ' || x.phrase || ' ') AND 100 * y.a >= {COVER} * x.a)),
z AS (SELECT s.lang, s.phrase, s.a, j, l.f AS l, r.f AS r, CAST({SCALE}::HUGEINT * s.a * s.a // (l.f::HUGEINT * r.f) AS BIGINT) AS score
  FROM s JOIN c AS l ON l.lang = s.lang AND l.phrase = lp JOIN c AS r ON r.lang = s.lang AND r.phrase = rp),
b AS (SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM b JOIN t USING (lang) QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= {TOP}
"""
