from __future__ import annotations

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and river stone light under seven copper window garden letter quiet winter signal harbor basket violet ribbon thunder".split()


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n)).capitalize() + ". "


@pytest.fixture(scope="session")
def rows():
    """Prose with exact copies, shared passages, nulls, empty and very long texts, odd white space and other scripts."""
    rng = random.Random(3)
    texts = ["".join(sentence(rng, rng.randrange(4, 14)) for _ in range(rng.randrange(1, 25))) for _ in range(60)]
    passage = "".join(sentence(rng, 9) for _ in range(7))
    for i in (5, 17, 33, 48):
        texts[i] = texts[i][:100] + passage + texts[i][100:]
    texts[20] = texts[3]
    texts[21] = texts[3]
    texts[40] = texts[7].replace("river", "rivers", 1)
    texts += [
        None,
        "",
        "   ",
        "\n\n\t",
        "one",
        "two words",
        "Ünïcödé straße ça und " * 9,
        "日本語の文章。" * 30,
        "a" * 500,
        "  spaced   out  \r\n lines \x0b here ",
        "".join(sentence(rng, 12) for _ in range(1500)),
        "<|endoftext|> is text, <|startoftext|>as<|endoftext|> is <|ENDOFTEXT|>",
        "x\0y nul",
    ]
    sources = ["a", "b", None, "a", "a"]
    return [(i, t, "en", sources[i % 5], None if t is None else len(t)) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def odd(spark):
    """Repeated rows, a null id, and columns whose names clash with those the operators use."""
    rows = [
        (1, "same same same. words here now. and again so. last one here.", "en", "a", 1),
        (1, "same same same. words here now. and again so. last one here.", "en", "a", 1),
        (1, "other", "en", "a", 2),
        (None, "no id", None, None, None),
        (None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, DOCS)
    names = "bucket part key size seed h starts line_doc k to ghost range weight fingerprint component_id quality_weight copy first_id taken_id times kept_row labelled_id x y node n_lines n_removed quality_keep quality content_score".split()
    from pyspark.sql import functions as F

    return df.withColumns({n: F.lit(7) for n in names})


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
