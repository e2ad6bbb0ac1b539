"""Removal of repeated runs of lines by winnowing, with DataFrame functions only.

A line ends with sentence ends, line breaks or certain letters, which the same text always has at the same places, white
space after them included. These are a few rare letters of Latin and, by one rule over code points, some of every other
script (scripts.py). So a long sentence is several lines, a passage is several lines however it is punctuated, and but
for its first and last words they are the same lines wherever it stands. No line ends by its length; text without any
such character is one line.

Of every window of `window` successive grams (runs of `gram` lines) the one whose first line has the smallest hash is
selected, the first of equals. Whatever gram + window - 1 lines two documents share, both select the same gram of
them. Of the places where a gram is selected the earliest, by doc_id and line, keeps it. Every later place is compared
with that one, line by line, and the match is extended to both sides for up to window - 1 lines, as far as it takes to
reach the ends of a shared run from its outermost selected grams. Lines that matched and follow each other are a
run; a run of at least `least` words is removed. What is kept stays as it is, in its order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scenewright.llm.common import discard, documents, release, row_keys, stored
from scenewright.llm.scripts import nested_class, plain_class

#: Latin letters that end a line within a sentence: about one in fifty, in several languages.
LETTERS = "KQXZkqxz"
_BLANK, _MARKS = r" \t\r\n", rf".!?\n{LETTERS}"
#: Group 1 is a line without the white space that follows it; the same for Spark and for SQL. Java tests the characters of
#: a class written one by one with a single look, so a line of Latin-1 characters is tried with such classes first.
_OTHER = "".join(rf"\x{c:02x}" for c in range(256) if chr(c) not in ".!?\n" + LETTERS)
_END, _END_SQL = (rf"{_MARKS}\x{{3002}}{others}" for others in (nested_class(), plain_class()))
LINE = rf"([{_OTHER}]*+[{_MARKS}][{_END}]*+|[^{_END}]*[{_END}]+|[^{_END}]+)[{_BLANK}]*"
LINE_SQL = rf"([^{_END_SQL}]*[{_END_SQL}]+|[^{_END_SQL}]+)[{_BLANK}]*"
WORD = rf"[^{_BLANK}]+"
GRAM, WINDOW, LEAST = 2, 3, 24


def _lines(text: Column, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(LINE), F.lit(group))


def _hash(line: Column) -> Column:
    """60 bits of a line's MD5; SQL can say the same."""
    return F.conv(F.substring(F.md5(line), 1, 15), 16, 10).cast("long")


def _keyed(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """docs with _ld_doc, _ld_x, _ld_text: rows equal in the first two, id and a hash of the text, are one document."""
    x, _ = row_keys(F.col(f"`{text}`"))
    return docs.withColumns({"_ld_doc": F.col(f"`{doc_id}`").cast("long"), "_ld_x": x, "_ld_text": F.coalesce(F.col(f"`{text}`"), F.lit(""))})


def line_hashes(docs: DataFrame, gram: int = GRAM, window: int = WINDOW, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc, x, h (hashes of its lines) and at (places of its selected grams) of every document.

    Of each window the gram with the smallest first hash is selected, the first of equals. A document with fewer
    lines than a window needs is one window; without a gram it has no place.
    """
    rows = _keyed(docs, text, doc_id).select(
        F.col("_ld_doc").alias("doc"), F.col("_ld_x").alias("x"), F.transform(_lines(F.col("_ld_text"), 1), _hash).alias("h"),
    )
    grams = F.size("h") - (gram - 1)
    at = lambda p: F.get(F.col("h"), p)

    def smallest(s: Column) -> Column:
        """The selected place of the window that starts at s: the first hash that none after it is smaller than."""
        out = s + (window - 1)
        for i in reversed(range(window - 1)):
            rest = [at(s + j) for j in range(i + 1, window)]
            out = F.when(at(s + i) <= (F.least(*rest) if len(rest) > 1 else rest[0]), s + i).otherwise(out)
        return out

    many = F.array_distinct(F.transform(F.sequence(F.lit(0), grams - window), smallest))
    firsts = F.slice("h", F.lit(1), grams)
    few = F.array((F.array_position(firsts, F.array_min(firsts)) - 1).cast("int"))
    return rows.withColumn("at", F.when(grams >= window, many).when(grams > 0, few).otherwise(F.array().cast("array<int>")))


def _selected(hashes: DataFrame, gram: int) -> DataFrame:
    """seed, doc, x, at: one row for each selected gram."""
    rows = hashes.select("doc", "x", "h", F.explode("at").alias("p"))
    seed = F.xxhash64(*[F.get(F.col("h"), F.col("p") + i) for i in range(gram)])
    return rows.select(seed.alias("seed"), "doc", "x", F.col("p").alias("at"))


def matched_lines(docs: DataFrame, gram: int = GRAM, window: int = WINDOW, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc, x, lines: of every document the places of its lines that a match with an earlier place covers, in order.

    Selected grams meet by an aggregate that finds the earliest place of each, and by one join of every later place
    with it. Thus a line that a third of all documents share costs a row for each of them and no pairs. Seeds are
    hashes and only say which places to compare; a match is one of every line's hash by itself. What is collected
    into one row is of one document.
    """
    side = window - 1
    hashes = stored(line_hashes(docs, gram, window, text, doc_id), "line-hashes")
    found = _selected(hashes, gram)
    # Aggregates are written before they are joined: a join of two plain exchanges is one whose hot keys Spark splits.
    place = F.struct("doc", "x", "at")
    first = stored(found.groupBy("seed").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1").select("seed", "first.*"), "line-first")
    around = lambda p: F.transform(F.sequence(F.lit(-side), F.lit(gram - 1 + side)), lambda i: F.get(F.col("h"), p + i))
    same = lambda a, b: a["doc"].eqNullSafe(b["of_doc"]) & (a["x"] == b["of_x"])

    def with_lines(of: DataFrame) -> DataFrame:
        """Rows of documents (of_doc, of_x) with their hashes h."""
        return hashes.join(of, same(hashes, of)).drop("doc", "x", "at")

    owners = first.groupBy(F.col("doc").alias("of_doc"), F.col("x").alias("of_x")).agg(F.collect_list(F.struct("seed", "at")).alias("grams"))
    lines = with_lines(owners).select(
        "of_doc", "of_x", F.inline(F.transform("grams", lambda g: F.struct(g["seed"].alias("of_seed"), g["at"].alias("of_at"), around(g["at"]).alias("lines")))),
    )
    lines = stored(lines.dropDuplicates(["of_seed"]), "line-contexts")
    later = found.join(lines, (found["seed"] == lines["of_seed"]) & (place > F.struct("of_doc", "of_x", "of_at")))
    later = later.groupBy(F.col("doc"), F.col("x")).agg(F.collect_set(F.struct("at", "lines")).alias("places"))
    later = stored(later.select(F.col("doc").alias("of_doc"), F.col("x").alias("of_x"), "places"), "line-later")
    discard(first, lines)
    release(docs.sparkSession)

    def compared(m: Column) -> Column:
        """Which lines around a place are those of the earliest one; null if a line of the gram itself is not."""
        equal = F.zip_with(around(m["at"]), m["lines"], lambda a, b: F.coalesce(a == b, F.lit(False)))
        return F.when(F.forall(F.slice(equal, side + 1, gram), lambda e: e), equal)

    matches = with_lines(later).select("of_doc", "of_x", F.transform("places", lambda m: F.struct(m["at"].alias("at"), compared(m).alias("equal"))).alias("m"))

    def reach(equal: Column) -> tuple[Column, Column]:
        left, right = F.lit(side), F.lit(side)
        for i in range(side):  # from the farthest line to the nearest, whose difference counts last and so first
            left = F.when(~F.get(equal, F.lit(i)), F.lit(side - 1 - i)).otherwise(left)
            right = F.when(~F.get(equal, F.lit(2 * side + gram - 1 - i)), F.lit(side - 1 - i)).otherwise(right)
        return left, right

    def span(m: Column) -> Column:
        left, right = reach(m["equal"])
        return F.sequence(m["at"] - left, m["at"] + (gram - 1) + right)

    spans = F.transform(F.filter("m", lambda m: m["equal"].isNotNull()), span)
    found = matches.select(
        F.col("of_doc").alias("doc"), F.col("of_x").alias("x"), F.array_sort(F.array_distinct(F.flatten(spans))).alias("lines"),
    ).filter(F.size("lines") > 0)
    found = stored(found.groupBy("doc", "x").agg(F.first("lines").alias("lines")), "line-matches")  # rows of one document say the same
    discard(hashes, later)
    return found


def _runs(lines: Column) -> Column:
    """(from, to) of the runs of a sorted list of places."""
    starts = F.filter(lines, lambda x, i: (i == 0) | (F.get(lines, F.greatest(i - 1, F.lit(0))) != x - 1))
    ends = F.filter(lines, lambda x, i: F.coalesce(F.get(lines, i + 1) != x + 1, F.lit(True)))
    return F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def dedup_lines(
    docs: DataFrame,
    gram: int = GRAM,
    window: int = WINDOW,
    least: int = LEAST,
    text: str = "text",
    doc_id: str = "doc_id",
    removed: str = "n_removed",
) -> DataFrame:
    """docs with every row and column, repeated runs removed from text; one more column: n_removed, the number of lines removed.

    Null and empty texts have no lines; a null text stays null. Rows equal in doc_id and text are one document and
    change alike; rows that share a doc_id only come in the order of a hash of the text. A null doc_id comes first. A
    document that wholly repeats is left with an empty text. No documents: no rows. A column of the input with the
    name in removed is replaced.
    """
    lines = matched_lines(docs, gram, window, text, doc_id).withColumnsRenamed({"doc": "_ld_of_doc", "x": "_ld_of_x", "lines": "_ld_places"})
    release(docs.sparkSession)
    docs = docs.drop(removed)
    rows = _keyed(docs, text, doc_id)  # names of its own, so that no column of the input is lost
    rows = rows.join(lines, F.col("_ld_doc").eqNullSafe(F.col("_ld_of_doc")) & (F.col("_ld_x") == F.col("_ld_of_x")), "left")
    rows = rows.withColumn("_ld_list", F.when(F.col("_ld_places").isNotNull(), _lines(F.col("_ld_text"))))
    words = lambda r: F.regexp_count(F.array_join(F.slice(F.col("_ld_list"), r["a"] + 1, r["b"] - r["a"] + 1), ""), F.lit(WORD))
    rows = rows.withColumn("_ld_runs", F.filter(_runs(F.col("_ld_places")), lambda r: words(r) >= least))
    gone = F.flatten(F.transform("_ld_runs", lambda r: F.sequence(r["a"], r["b"])))
    changed = F.size(F.coalesce("_ld_runs", F.array())) > 0
    kept = F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size("_ld_list") - 1), gone), lambda i: F.get(F.col("_ld_list"), i)), "")
    new = {text: F.when(changed, kept).otherwise(F.col(f"`{text}`")), removed: F.when(changed, F.size(gone)).otherwise(0)}
    return rows.withColumns(new).select(*[F.col(f"`{c}`") for c in docs.columns], removed)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def _reach_sql(offsets: list[int]) -> str:
    """How many of the lines at these offsets from a place, nearest first, are equal in both documents."""
    cases = " ".join(
        f"WHEN p + {o} < 0 OR q + {o} < 0 OR h[p + {o + 1}] IS DISTINCT FROM fh[q + {o + 1}] OR h[p + {o + 1}] IS NULL THEN {i}" for i, o in enumerate(offsets)
    )
    return f"CASE {cases} ELSE {len(offsets)} END"


OP5_SQL = rf"""
WITH l AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{LINE_SQL}') AS ls FROM documents),
hs AS (SELECT doc_id, list_transform(ls, lambda x: CAST('0x' || substr(md5(x), 1, 15) AS BIGINT)) AS h FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{LINE_SQL}', 1) AS ls FROM documents) WHERE len(ls) >= {GRAM}),
ws AS (SELECT doc_id, h, s, h[s + 1:least(s + {WINDOW}, len(h) - {GRAM - 1})] AS win FROM hs, unnest(range(0, greatest(len(h) - {GRAM + WINDOW - 2}, 1))) AS u(s)),
g AS (SELECT DISTINCT doc_id, s + list_position(win, list_min(win)) - 1 AS p FROM ws),
k AS (SELECT g.doc_id, p, {", ".join(f"h[p + {i + 1}] AS k{i}" for i in range(GRAM))} FROM g JOIN hs USING (doc_id)),
f AS (SELECT *, first_value(doc_id) OVER o AS fd, first_value(p) OVER o AS q FROM k WINDOW o AS (PARTITION BY {", ".join(f"k{i}" for i in range(GRAM))} ORDER BY doc_id, p)),
m AS (SELECT f.doc_id, p, {_reach_sql([-i - 1 for i in range(WINDOW - 1)])} AS lft, {_reach_sql([GRAM + i for i in range(WINDOW - 1)])} AS rgt
  FROM (SELECT f.*, a.h, b.h AS fh FROM f JOIN hs a ON a.doc_id = f.doc_id JOIN hs b ON b.doc_id = f.fd WHERE (f.doc_id, p) > (fd, q)) f),
c AS (SELECT DISTINCT doc_id, unnest(range(p - lft, p + {GRAM} + rgt)) AS i FROM m),
r AS (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS run FROM c),
j AS (SELECT r.doc_id, r.run, len(regexp_extract_all(string_agg(l.ls[r.i + 1], '' ORDER BY r.i), '{WORD}')) AS words FROM r JOIN l USING (doc_id) GROUP BY r.doc_id, r.run),
w AS (SELECT r.doc_id, r.i, j.words FROM r JOIN j ON j.doc_id = r.doc_id AND j.run = r.run),
k2 AS (SELECT doc_id, i, line FROM (SELECT doc_id, unnest(ls) AS line, unnest(range(0, CAST(len(ls) AS BIGINT))) AS i FROM l)),
t AS (SELECT k2.doc_id, count(w.i) AS n_removed, coalesce(string_agg(CASE WHEN w.i IS NULL THEN k2.line END, '' ORDER BY k2.i), '') AS kept
  FROM k2 LEFT JOIN (SELECT * FROM w WHERE words >= {LEAST}) w ON k2.doc_id = w.doc_id AND k2.i = w.i GROUP BY k2.doc_id)
SELECT l.doc_id, CAST(coalesce(t.n_removed, 0) AS INTEGER) AS n_removed, sha256(coalesce(t.kept, '')) AS kept_sha256
FROM l LEFT JOIN t USING (doc_id)
"""
