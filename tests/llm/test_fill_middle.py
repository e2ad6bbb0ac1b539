"""Fill-in-the-middle: units against their pattern, every part by hand, exact round trips."""

from __future__ import annotations

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from scenewright.llm import fill_middle as fm

GRAMMARS = {"lines": fm.LINES, "runs": fm.RUNS, "words": fm.WORDS, "characters": fm.CHARACTERS, "three": fm.runs_of("0-9", "a-z"), "sentences": fm.ended_by(".!?")}
TEXTS = ["", "\n", "\n\n\n", "no end", "one\n", "one\ntwo", " lead\n\ttrail ", "ab12 cd3.\r\n", "é日本\n語😀😀\n😀", "x\0y\nz", "a. b! c", "<P", "12ab" * 3000 + "\n" + "w " * 2000]


@pytest.mark.parametrize("name", sorted(GRAMMARS))
def test_splitting_gives_the_units_of_the_pattern(spark, name):
    g = GRAMMARS[name]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string").select("i", fm.units(F.col("t"), g).alias("u"))
    got = {r["i"]: r["u"] for r in df.collect()}
    assert all(got[i] == re.findall(g.pattern, t) for i, t in enumerate(TEXTS))


def by_hand(doc_id, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 100:
        return len(units), "plain", None, None, None, text
    if h4 % 100 < 50:
        return len(units), "spm", pre, mid, suf, f"<S>{suf}<P>{pre}<M>{mid}"
    return len(units), "psm", pre, mid, suf, f"<P>{pre}<S>{suf}<M>{mid}"


def test_every_row_by_hand(spark, docs, rows):
    more = [(1000 + i, t, "en", "a", 0) for i, t in enumerate([*TEXTS, "has <S> in it\nx", "a<\nP>\n<", "<\nS>M>\n<P\n>"])]
    df = docs.unionByName(spark.createDataFrame(more, docs.schema))
    got = {r["doc_id"]: r for r in fm.fill_in_middle(df).withColumn("back", fm.restored(F.col("fim_output"), F.col("fim_form"))).collect()}
    assert len(got) == len(rows) + len(more)
    for d, t, *_ in [*rows, *more]:
        r = got[d]
        assert tuple(r[c] for c in fm.ADDED) == by_hand(d, t)
        assert r["back"] == (t or "") and r["text"] == t
    assert {r["fim_form"] for r in got.values()} == {"plain", "psm", "spm"}


def test_rate_seed_and_marks(docs, rows):
    none = fm.fill_in_middle(docs, rate=0)
    assert {r["fim_form"] for r in none.collect()} == {"plain"}
    marks = ("[fim.p]", "(fim|s)", "<fim+m>")
    out = fm.fill_in_middle(docs, grammar=fm.CHARACTERS, seed=11, spm=100, marks=marks)
    out = out.withColumn("back", fm.restored(F.col("fim_output"), F.col("fim_form"), marks)).collect()
    assert {r["fim_form"] for r in out} == {"plain", "spm"} and all(r["back"] == (r["text"] or "") for r in out)


def test_odd_rows(spark, odd, none):
    out = fm.fill_in_middle(odd.withColumn("fim_form", F.lit(9)).withColumn("units", F.lit(1)))
    assert out.count() == 5 and out.columns == [*odd.columns, "units", *fm.ADDED]
    by = [(r["doc_id"], r["text"], r["fim_form"], r["fim_output"]) for r in out.collect()]
    assert by.count((None, None, "plain", "")) == 1 and len({x for x in by if x[1] and x[1].startswith("same")}) == 1
    assert fm.fill_in_middle(none).count() == 0


def test_no_row_is_shuffled(docs):
    plan = fm.fill_in_middle(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and plan.count("Exchange") == plan.count("Exchange RoundRobin")
