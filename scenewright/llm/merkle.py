"""Merkle-tree fingerprints of texts, with DataFrame functions only.

A text of any length is cut into paragraphs by one rule that looks at a few characters only: a paragraph ends after a
sentence end or line break, after white space that follows one of every second Latin letter or digit, or after certain
letters of every other script, by one rule over code points (scripts.py). So a cut stays where it is whatever is put in
front of it, and an edit changes the few paragraphs it touches. Only where no such place comes within MOST code points,
a paragraph ends there; from the next such place on the cuts are again those of the content.

A paragraph's digest is the first DIGITS hex digits of its SHA-256. A section ends with a paragraph whose digest begins with 0, and its
digest is the SHA-256 of its paragraphs' digests; the root is the SHA-256 of the sections' digests. A fingerprint is
written

    root:section=paragraphs;section=paragraphs;...

with the root in full, the first 8 hex digits of each section's digest and the first 6 of each paragraph's. Equal
texts have equal fingerprints, different texts different roots. Comparing two trees goes from the root to the
sections, and on to the paragraphs of those sections only that the other tree has not.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scenewright.llm.common import buckets_for, documents, texts_of
from scenewright.llm.scripts import nested_class, plain_class

#: Code points of a paragraph in which no place to cut comes; hex digits of a paragraph's digest in the tree.
MOST, DIGITS = 24, 32
#: Hex digits of a section's and of a paragraph's digest in a fingerprint.
SECTION, PARAGRAPH = 8, 6
#: Bytes of text that one task puts in order.
RANGE = 8 << 20
#: Before white space: every second Latin letter and digit.
BEFORE_BLANK = "ACEGIKMOQSUWYacegikmoqsuwy02468"
#: The same for Spark and for SQL.
CUT, CUT_SQL = (
    rf"(?s).{{0,{MOST - 1}}}?(?:[{BEFORE_BLANK}][ \t\r\n]+|[.!?\n\x{{3002}}]+ *|{letter})|.{{1,{MOST}}}"
    for letter in (nested_class(), f"[{plain_class()}]")
)


def paragraphs(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(CUT), F.lit(0))


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with the fingerprint of column text in column out. No paragraphs: the SHA-256 of nothing, then a colon."""
    of, sections, short = f"{out}_of", f"{out}_sections", f"{out}_short"
    parts = lambda joined: F.filter(F.split(F.array_join(joined, ""), ";"), lambda x: x != "")
    ends = lambda d: d.startswith("0")
    df = df.withColumn(of, F.transform(paragraphs(F.col(text)), lambda p: F.substring(F.sha2(p, 256), 1, DIGITS)))
    whole = parts(F.transform(of, lambda d: F.concat(d, F.when(ends(d), F.lit(";")).otherwise(F.lit(",")))))
    few = parts(F.transform(of, lambda d: F.concat(F.substring(d, 1, PARAGRAPH), F.when(ends(d), F.lit(";")).otherwise(F.lit("")))))
    df = df.withColumn(sections, F.transform(whole, lambda x: F.sha2(x, 256))).withColumn(short, few)
    tree = F.array_join(F.zip_with(sections, short, lambda x, p: F.concat(F.substring(x, 1, SECTION), F.lit("="), p)), ";")
    return df.withColumn(out, F.concat(F.sha2(F.array_join(sections, ""), 256), F.lit(":"), tree)).drop(of, sections, short)


def sections_of(fingerprint: Column) -> Column:
    """The sections of a fingerprint, in order, each as its digest, = and its paragraphs."""
    return F.filter(F.split(F.substring_index(fingerprint, ":", -1), ";"), lambda x: x != "")


def leaves(sections: Column) -> Column:
    """The paragraph digests of sections, in order."""
    return F.regexp_extract_all(
        F.array_join(F.transform(sections, lambda x: F.substring(x, SECTION + 2, 1 << 30)), ""), F.lit("[0-9a-f]{%d}" % PARAGRAPH), F.lit(0),
    )


def likeness(a: Column, b: Column, of_a: Column, of_b: Column) -> Column:
    """Of fingerprints a and b with sections of_a and of_b: 1 if the roots are equal, else twice the paragraphs that
    both have over those of each and one for the roots. Sections in both count with all their paragraphs; only the
    others' paragraphs are compared. Sections and paragraphs that one tree has more than once count once."""
    both = F.aggregate(F.array_intersect(of_a, of_b), F.lit(0), lambda n, x: n + ((F.length(x) - (SECTION + 1)) / PARAGRAPH).cast("int"))
    left, right = F.array_distinct(leaves(F.array_except(of_a, of_b))), F.array_distinct(leaves(F.array_except(of_b, of_a)))
    same = F.substring_index(a, ":", 1) == F.substring_index(b, ":", 1)
    return F.when(same, F.lit(1.0)).otherwise(2.0 * (both + F.size(F.array_intersect(left, right))) / (2 * both + F.size(left) + F.size(right) + 1))


def changed_paragraphs(a: Column, b: Column) -> Column:
    """Where two fingerprints differ: positions in a of the paragraphs that lie in sections which b has not, and are in none of b's sections which a has not."""
    of_a, of_b = sections_of(a), sections_of(b)
    others = leaves(F.array_except(of_b, of_a))
    marked = F.flatten(
        F.transform(
            of_a,
            lambda x: F.transform(
                F.regexp_extract_all(F.substring(x, SECTION + 2, 1 << 30), F.lit("[0-9a-f]{%d}" % PARAGRAPH), F.lit(0)),
                lambda p: ~F.array_contains(of_b, x) & ~F.array_contains(others, p),
            ),
        )
    )
    return F.filter(F.transform(marked, lambda m, i: F.when(m, i)), lambda i: i.isNotNull())


def with_next(rows: DataFrame, columns: dict[str, str], buckets: int, derive: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """rows with columns of the row that follows by (doc_id, text), under the names given; the first follows the last.

    Rows are cut into ranges of doc_id at values that occur, found by an approximate percentile of the ids alone.
    A range's first rows are also sent to the range before it, where they close it, so that a window per range
    suffices and texts are shuffled once. derive: adds columns after the shuffle. A null doc_id comes first. Each
    range is ordered by one task: rows that share one doc_id stay together.
    """
    key = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    cuts = rows.agg(F.percentile_approx(key, [i / buckets for i in range(buckets)], 100 * buckets).alias("cuts"), F.min(key).alias("least")).first()
    if cuts["least"] is None:
        return derive(rows).withColumns({new: F.col(old) for old, new in columns.items()})
    bounds = sorted({cuts["least"], *cuts["cuts"]})
    at = F.array(*[F.lit(b).cast("long") for b in bounds])
    # the last bound at or below the key, found among the bounds by halving
    low: Column = F.lit(0)
    step = 1 << max(0, (len(bounds) - 1).bit_length() - 1) if len(bounds) > 1 else 0
    rows = rows.withColumn("k", key).withColumn("b", low)
    while step:
        nxt = F.col("b") + step
        rows = rows.withColumn("b", F.when((nxt < len(bounds)) & (F.get(at, nxt) <= F.col("k")), nxt).otherwise(F.col("b")))
        step >>= 1
    n = len(bounds)
    to = F.when(
        F.get(at, F.col("b")) == F.col("k"),
        F.array(F.struct(F.col("b").alias("to"), F.lit(0).alias("ghost")), F.struct(F.pmod(F.col("b") - 1, F.lit(n)).alias("to"), F.lit(1).alias("ghost"))),
    ).otherwise(F.array(F.struct(F.col("b").alias("to"), F.lit(0).alias("ghost"))))
    dealt = rows.withColumn("t", F.explode(to)).select(*[c for c in rows.columns if c not in ("b",)], "t.to", "t.ghost")
    dealt = dealt.repartitionById(n, F.col("to").cast("int"))  # a range is a task
    dealt = derive(dealt)
    order = Window.partitionBy("to").orderBy("ghost", "k", "text")
    dealt = dealt.withColumns({new: F.lead(old).over(order) for old, new in columns.items()})
    return dealt.filter("ghost = 0").drop("k", "to", "ghost")


def fingerprint_edits(docs: DataFrame, text: str = "text", buckets: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    The edited text has the last floor(n_chars / 4) code points replaced by as many of the first of the next row, by
    (doc_id, text), or all of it. Null and empty texts have no paragraphs and are like each other alone. Rows that
    share a doc_id come in the order of their texts. A single row is its own next. Texts of any length are cut whole;
    other columns are not looked at. No documents: no rows. buckets: ranges of doc_id to be put in order on their own,
    by default one for RANGE bytes of text.
    """
    n = buckets or buckets_for(texts_of(docs, text).agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0], RANGE)
    rows = with_next(texts_of(docs, text), {"text": "next_text", "fingerprint": "next_fingerprint"}, n, lambda df: with_fingerprint(df, "text", "fingerprint"))
    rows = rows.withColumn("n_chars", F.char_length("text").cast("long")).withColumn("cut", F.floor(F.col("n_chars") / 4).cast("int"))
    rows = rows.withColumn(
        "edited",
        F.concat(F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - F.col("cut")).cast("int")), F.substring(F.col("next_text"), F.lit(1), F.col("cut"))),
    )
    rows = with_fingerprint(rows, "edited", "edited_fingerprint")
    names = ("fingerprint", "edited_fingerprint", "next_fingerprint")
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), *names)
    rows = rows.withColumns({f"of_{c}": sections_of(F.col(c)) for c in names})
    near = lambda c: likeness(F.col("fingerprint"), F.col(c), F.col("of_fingerprint"), F.col(f"of_{c}"))
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        near("edited_fingerprint").alias("near_edited"),
        near("next_fingerprint").alias("near_next"),
    )


def op4_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(documents(spark, sf_dir))


_SECTIONS = "list_filter(string_split(split_part({0}, ':', 2), ';'), lambda x: x <> '')"
_LEAVES = f"list_distinct(regexp_extract_all(array_to_string(list_transform({{0}}, lambda x: substr(x, {SECTION + 2})), ''), '[0-9a-f]{{{{{PARAGRAPH}}}}}'))"
_NEAR = """SELECT *, CASE WHEN split_part(fingerprint, ':', 1) = split_part({0}, ':', 1) THEN 1.0
  ELSE 2.0 * (nb + len(list_intersect(la, lb))) / (2 * nb + len(la) + len(lb) + 1) END AS near_{1}
  FROM (SELECT *, {2} AS la, {3} AS lb, coalesce(CAST(list_sum(list_transform(list_distinct(list_intersect(sa, sb)), lambda x: (length(x) - {4}) // {5})) AS BIGINT), 0) AS nb
    FROM (SELECT *, {6} AS sa, {7} AS sb FROM {8}))"""


def _near_sql(other: str, name: str, table: str) -> str:
    only = "list_filter({0}, lambda x: NOT list_contains({1}, x))"
    return _NEAR.format(
        other,
        name,
        _LEAVES.format(only.format("sa", "sb")),
        _LEAVES.format(only.format("sb", "sa")),
        SECTION + 1,
        PARAGRAPH,
        _SECTIONS.format("fingerprint"),
        _SECTIONS.format(other),
        table,
    )


OP4_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents),
x AS (SELECT doc_id, text, n, coalesce(lead(text) OVER o, first_value(text) OVER o) AS nxt FROM d WINDOW o AS (ORDER BY doc_id)),
e AS (SELECT *, substring(text, 1, n - n // 4) || substring(nxt, 1, n // 4) AS edited FROM x),
t AS (SELECT doc_id, 1 AS k, text AS s FROM e UNION ALL SELECT doc_id, 2, edited FROM e),
p AS (SELECT doc_id, k, list_transform(regexp_extract_all(s, '{CUT_SQL}'), lambda q: substr(sha256(q), 1, {DIGITS})) AS hs FROM t),
c AS (SELECT doc_id, k,
  list_transform(list_filter(string_split(array_to_string(list_transform(hs, lambda h: h || CASE WHEN h[1] = '0' THEN ';' ELSE ',' END), ''), ';'), lambda q: q <> ''), lambda q: sha256(q)) AS secs,
  list_filter(string_split(array_to_string(list_transform(hs, lambda h: substr(h, 1, {PARAGRAPH}) || CASE WHEN h[1] = '0' THEN ';' ELSE '' END), ''), ';'), lambda q: q <> '') AS short FROM p),
f AS (SELECT doc_id, k, sha256(array_to_string(secs, '')) || ':' || array_to_string(list_transform(secs, lambda q, i: substr(q, 1, {SECTION}) || '=' || short[i]), ';') AS fp FROM c),
a AS (SELECT doc_id, fp AS fingerprint, coalesce(lead(fp) OVER o, first_value(fp) OVER o) AS next_fingerprint FROM f WHERE k = 1 WINDOW o AS (ORDER BY doc_id)),
g AS (SELECT a.*, f.fp AS edited_fingerprint, CAST(e.n AS BIGINT) AS n_chars, sha256(e.edited) AS edited_sha256 FROM a JOIN f ON f.doc_id = a.doc_id AND f.k = 2 JOIN e ON e.doc_id = a.doc_id),
ne AS ({_near_sql("edited_fingerprint", "edited", "g")}),
nn AS ({_near_sql("next_fingerprint", "next", "(SELECT * EXCLUDE (sa, sb, la, lb, nb) FROM ne)")})
SELECT doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next FROM nn
"""
