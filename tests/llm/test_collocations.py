"""Collocations against a plain version with exact fractions."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import functions as F

from scenewright.llm import collocations as co


def by_hand(rows, most=3, least=10, cover=50, top=2000):
    f, n = defaultdict(Counter), Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(lower)):
            words = re.findall(r"[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, most + 1):
                for i in range(len(words) - k + 1):
                    f[lang][tuple(words[i : i + k])] += 1
    out = set()
    for lang, counts in f.items():
        cand = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in cand.items():
            inside = lambda q, p=p: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
            if any(len(q) > len(p) and 100 * b >= cover * a and inside(q) for q, b in cand.items()):
                continue
            score, _, le, r = min((1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), le, r))
        for i, (s, a, p, le, r) in enumerate(sorted(scored)[:top]):
            out.add((lang, i + 1, p.decode(), -a, le, r, n[lang], -s))
    return out


def corpus(seed=5, docs=900):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(7)] + ["É", "日本", "😀", "ﬀ", "B c", "x\x0by"]
    fixed = ["New York City", "in spite of", "red herring", "red herring sandwich", "aa aa aa aa", "of of"]
    out = []
    for i in range(docs):
        parts = []
        for _ in range(rng.randrange(0, 12)):
            parts.append(rng.choice(fixed) if rng.random() < 0.35 else " ".join(rng.choice(words) for _ in range(rng.randrange(1, 6))))
        text = "".join(p + rng.choice([" ", "  ", "\t", ". ", ",", "\r\n", "? ", " "]) for p in parts)
        out.append((text, [None, "en", "en", "und", "de"][i % 5]))
    return out + [(None, "en"), ("", "xx"), ("  \t ", "en"), ("...", None), ("solo", "yy"), ("go " * 9001, "zz")]


def rows_of(df):
    return {tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect()}


def test_phrases_by_hand(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(4)
    want = by_hand(rows)
    assert rows_of(co.collocations(docs)) == want and len(want) > 60
    assert rows_of(co.collocations(docs.repartition(2), most=4, least=5, cover=80, top=7)) == by_hand(rows, 4, 5, 80, 7)
    assert rows_of(co.collocations(docs, most=2)) == by_hand(rows, 2)


def test_batches_join_without_loss_or_repeats():
    """Counts over a few words at a time, also within a text of several parts, are those of whole texts."""
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["a", "b", "c.", "dd", ". ", "É"]) for _ in range(n)) for n in (1, 2, 3, 50, 0, 7, 400)]
    texts.append("x" * (5 << 20) + " y z " + "w" * (5 << 20) + " x y z")  # several runs of words
    langs = ["en", "de", "en", "en", "xx", "de", "en", "de"]
    batch = pa.RecordBatch.from_arrays([pa.array(langs), pa.array(texts)], names=["lang", "text"])
    for most in (1, 2, 3, 5):
        want = Counter()
        for lang, text in zip(langs, texts, strict=True):
            for piece in re.split(r"[.,;:!?\n-\r]", text):
                words = piece.split()
                want.update((lang, " ".join(words[i : i + k])) for k in range(1, most + 1) for i in range(len(words) - k + 1))
        for size in (1, 5, 100, 10**6):
            got = Counter()
            for b in co.phrase_rows(iter([batch, batch.slice(0, 0)]), most, size):
                for lang, phrase, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    got[lang, phrase] += n
            assert got == want


def test_scores_of_more_than_64_bits(spark):
    e = spark.createDataFrame([(10**13, 10**13 + 7, 10**13 + 9)], "a long, l long, r long")
    d = lambda c: f"CAST({c} AS DECIMAL(19, 0))"
    got = e.select(F.expr(f"CAST({co.SCALE} AS DECIMAL(7, 0)) * {d('a')} * {d('a')} div ({d('l')} * {d('r')})")).first()[0]
    assert got == 10**6 * 10**26 // ((10**13 + 7) * (10**13 + 9))


def test_odd_rows(spark, odd, none):
    names = "phrase a l r n k words piece inner outer_a left right score cut of part worst inner_lang".split()
    docs = odd.withColumns({c: F.lit("q") for c in names})
    assert co.collocations(docs, least=2).filter("phrase = 'same same'").count() == 0  # within a phrase of three words
    assert rows_of(co.collocations(docs, least=2)) == by_hand([(r["text"], r["lang"]) for r in odd.collect()], least=2)
    assert co.collocations(none).count() == 0
