"""Fill-in-the-middle transformation by lookaround splitting, with DataFrame functions only.

A unit grammar says what the units of a text are; it is translated to a regular expression of zero width that matches
between two neighbouring characters, by the classes they belong to, wherever one unit ends and the next begins.
Splitting there loses no character. An empty text has no neighbours and no units; split() would give one empty piece,
so it is told apart first.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scenewright.llm.common import documents

#: Any character, line breaks too.
ANY = r"[\s\S]"


@dataclass(frozen=True)
class Units:
    """A unit grammar: its units as a pattern to be matched from left to right, and the boundaries between them."""

    pattern: str
    boundary: str


def ended_by(ends: str) -> Units:
    """A unit ends with a character of the class ends (the inside of brackets) or with the text."""
    return Units(rf"[^{ends}]*[{ends}]|[^{ends}]+", rf"(?<=[{ends}])(?={ANY})")


def runs_of(*classes: str) -> Units:
    """Units are the longest runs of one class's characters; what belongs to no class makes runs of its own. The classes share no character."""
    rest = "[^" + "".join(classes) + "]+"
    ends = [rf"(?<=[{c}])(?=[^{c}])|(?<=[^{c}])(?=[{c}])" for c in classes]
    return Units("|".join([*(f"[{c}]+" for c in classes), rest]), "|".join(ends))


def led_by(leads: str) -> Units:
    """A unit is a run of characters outside of the class leads together with the run of leads before it."""
    return Units(rf"[{leads}]*[^{leads}]+|[{leads}]+", rf"(?<=[^{leads}])(?=[{leads}])")


#: Lines with their ends; runs of blanks and of others; words with the blanks before them; characters.
LINES, RUNS, WORDS = ended_by(r"\n"), runs_of(r"\x20\x09-\x0D"), led_by(r"\x20\x09-\x0D")
CHARACTERS = Units(ANY, rf"(?<={ANY})(?={ANY})")
#: What opens prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
SEED, RATE, SPM = 7, 100, 50
#: Columns that fill_in_middle() adds.
ADDED = ("fim_n", "fim_form", "fim_prefix", "fim_middle", "fim_suffix", "fim_output")


def units(text: Column, grammar: Units = LINES) -> Column:
    """The units of a text in order; joined they are the text. Empty text: none. Null: null."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, grammar.boundary, -1))


def fill_in_middle(
    docs: DataFrame,
    grammar: Units = LINES,
    rate: int = RATE,
    spm: int = SPM,
    seed: int = SEED,
    marks: tuple[str, str, str] = MARKS,
    text: str = "text",
    doc_id: str = "doc_id",
) -> DataFrame:
    """docs with every row and column and the columns ADDED: number of units, form, the three parts and the output.

    Two places among the n units, drawn by a hash of seed and doc_id, cut a text into prefix, middle and suffix.
    rate of 100 texts are turned; of those spm of 100 have form spm (suffix, prefix, middle), the others psm (prefix,
    suffix, middle). A text that is empty or holds a mark stays as it is: form plain, its parts null, its output the
    text. A null text is an empty one. A null doc_id draws as the word null would; rows of one id draw alike, each
    from its own units. Texts of any length are one row as before; no row meets another. Columns of the input with
    the names in ADDED are replaced. No documents: no rows.
    """
    prefix_mark, suffix_mark, middle_mark = marks
    names = [c for c in docs.columns if c not in ADDED]
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("null"))), 256)
    draw = lambda i: F.conv(F.substring("_fim_h", 8 * i + 1, 8), 16, 10).cast("long")
    whole = F.col("_fim_text")
    rows = docs.select(*[F.col(f"`{c}`") for c in names], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_fim_text"), h.alias("_fim_h"))
    rows = rows.withColumn("_fim_units", units(whole, grammar)).withColumn("fim_n", F.size("_fim_units").cast("long"))
    a, b = draw(0) % (F.col("fim_n") + 1), draw(1) % (F.col("fim_n") + 1)
    marked = F.lit(False)
    for m in marks:
        marked |= F.contains(whole, F.lit(m))
    plain = (whole == "") | marked | (draw(2) % 100 >= rate)
    form = F.when(plain, "plain").when(draw(3) % 100 < spm, "spm").otherwise("psm")
    rows = rows.withColumns({"_fim_a": F.least(a, b).cast("int"), "_fim_b": F.greatest(a, b).cast("int"), "fim_form": form})
    part = lambda start, n: F.when(F.col("fim_form") != "plain", F.array_join(F.slice("_fim_units", start + 1, n), ""))
    rows = rows.withColumns(
        {
            "fim_prefix": part(F.lit(0), F.col("_fim_a")),
            "fim_middle": part(F.col("_fim_a"), F.col("_fim_b") - F.col("_fim_a")),
            "fim_suffix": part(F.col("_fim_b"), F.col("fim_n").cast("int") - F.col("_fim_b")),
        }
    )
    psm = F.concat(F.lit(prefix_mark), "fim_prefix", F.lit(suffix_mark), "fim_suffix", F.lit(middle_mark), "fim_middle")
    spm_out = F.concat(F.lit(suffix_mark), "fim_suffix", F.lit(prefix_mark), "fim_prefix", F.lit(middle_mark), "fim_middle")
    output = F.when(F.col("fim_form") == "psm", psm).when(F.col("fim_form") == "spm", spm_out).otherwise(whole)
    return rows.withColumn("fim_output", output).select(*[F.col(f"`{c}`") for c in names], *ADDED)


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output of the given form was made of. No part holds a mark, and no mark begins as another ends, so marks split it."""
    parts = F.split(output, "|".join(map(re.escape, marks)), -1)
    put = lambda *order: F.concat(*[F.get(parts, F.lit(i)) for i in order])
    return F.when(form == "psm", put(1, 3, 2)).when(form == "spm", put(2, 3, 1)).otherwise(output)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fill_in_middle(documents(spark, sf_dir).select("doc_id", "text"))
    return rows.select(
        "doc_id",
        F.col("fim_n").alias("n"),
        F.col("fim_form").alias("form"),
        F.char_length("fim_prefix").cast("long").alias("prefix_chars"),
        F.char_length("fim_middle").cast("long").alias("middle_chars"),
        F.sha2("fim_output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("fim_output"), F.col("fim_form")), 256).alias("restored_sha256"),
    )


_DRAW = "CAST('0x' || substr(h, {0}, 8) AS BIGINT)"
OP11_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('{SEED}:' || CAST(doc_id AS VARCHAR)) AS h, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u FROM documents),
n AS (SELECT *, len(u) AS n, {_DRAW.format(1)} % (len(u) + 1) AS x, {_DRAW.format(9)} % (len(u) + 1) AS y,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR {_DRAW.format(17)} % 100 >= {RATE} THEN 'plain'
       WHEN {_DRAW.format(25)} % 100 < {SPM} THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, array_to_string(u[1:least(x, y)], '') AS pre, array_to_string(u[least(x, y) + 1:greatest(x, y)], '') AS mid, array_to_string(u[greatest(x, y) + 1:], '') AS suf FROM n),
o AS (SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END AS out FROM p),
b AS (SELECT *, split_part(out, '<M>', 2) AS m, split_part(split_part(out, '<M>', 1), '<P>', 2) AS after_p, split_part(split_part(out, '<M>', 1), '<S>', 2) AS after_s FROM o)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(out) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN out WHEN 'psm' THEN split_part(after_p, '<S>', 1) || m || after_s ELSE after_p || m || split_part(after_s, '<P>', 1) END) AS restored_sha256
FROM b
"""
