"""A quality classifier by co-training two views of a document: what it says, and what is known about its page.

The content view sees the distinct words, without marks around them and in lower case, and their first letters. The
metadata view sees none of them: source, language, length and layout alone, that is lines, words to a line, and the
shares of capitals, digits, repeated words and every mark. Each is a logistic regression on labelled documents. Over some rounds each view labels the pool documents that it is surest about, as many of either class as
their shares allow, for the other view to train on. Then, on labelled documents that neither has seen, each view is
calibrated (a logistic curve over its score) and the two calibrated views are combined by a third regression.

Models are fitted on a bounded sample, LABELLED and POOL documents about, of each document at most SEEN features, those
with the smallest hashes; all documents are scored, by all their words.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenewright.llm.common import documents, utf8, word_runs

#: About how many labelled and unlabelled documents the models are fitted on, those with a hash of doc_id under a bound.
LABELLED, POOL, SEEN = 8_000, 4_000, 8_192
#: Rounds of exchange; pool documents that a view labels in each; passes over the data in each fit.
ROUNDS, EXCHANGED, PASSES = 4, 400, 12
#: Step of a weight in a fit; least probability of a good document that stays.
RATE, THRESHOLD = 0.5, 0.4
#: Besides each word, its first so many bytes are features, as words of one stem share what they say.
PREFIXES = (5, 7)
#: Words are numbered by CRC-32 in so many bits; those in fewer labelled documents than LEAST, or whose share in good and bad ones differs by less than APART standard errors, have no weight.
BITS, LEAST, APART = 22, 6, 4.5
META = 12
#: One labelled document in so many is kept for calibration.
CALIBRATE = 4
MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
CAPITALS, DIGITS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"


def content(text: bytes) -> tuple[set[bytes], int]:
    """The distinct words of a text, marks around them off and A-Z lower, and the number of all its words."""
    found: set[bytes] = set()
    n = 0
    for run in word_runs(text.lower()):
        n += len(run)
        found.update(run)
    return {w.strip(MARKS) or w for w in found}, n


def metadata(text: bytes, words: int, distinct: int, source: str | None, lang: str | None) -> list[int]:
    """Numbers of the metadata features: each measure in steps."""
    n = len(text) or 1
    share = lambda marks: (len(text) - len(text.translate(None, marks))) / n
    lines = text.count(b"\n") + 1
    step = lambda x, k: min(k, int(x * k))
    got = {
        "source": source,
        "lang": lang,
        "bytes": int(math.log2(n) * 2),
        "lines": int(math.log2(lines) * 2),
        "line": int(math.log2(words / lines + 1) * 2),
        "word": step(n / (words + 1) / 40, 20),
        "capitals": step(share(CAPITALS), 40),
        "digits": step(share(DIGITS), 40),
        "marks": step(share(MARKS), 40),
        "distinct": step(distinct / (words or 1), 20),
    }
    got |= {chr(m): step(text.count(m) / n, 40) for m in MARKS}
    return [zlib.crc32(f"{k}={v}".encode()) & (1 << META) - 1 for k, v in got.items()]


def features_of(word: bytes) -> list[int]:
    """Numbers of the content features of one word."""
    return [zlib.crc32(x) & (1 << BITS) - 1 for x in (word, *(b" " + word[:n] for n in PREFIXES if len(word) > n))]


def numbered(words: set[bytes]) -> np.ndarray:
    return np.array(sorted({i for w in words for i in features_of(w)}), dtype=np.int32)


class Rows:
    """Documents as lists of feature numbers, end to end."""

    def __init__(self, lists: list[np.ndarray]):
        self.n = np.array([len(x) for x in lists], dtype=np.int64)
        self.at = np.cumsum(self.n) - self.n
        self.flat = np.concatenate(lists) if lists else np.empty(0, np.int32)

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(features, row of each) of some documents."""
        n = self.n[rows]
        of = np.repeat(np.arange(len(rows)), n)
        return self.flat[np.repeat(self.at[rows], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)], of


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class View:
    """Logistic regression over present features, fitted with a rate of its own for each weight.

    Only features in at least `least` labelled documents count whose share among good and bad ones differs by
    `apart` standard errors or more: most words say nothing about quality, and thousands of them together mislead.
    """

    def __init__(self, rows: Rows, size: int, least: int, apart: float, labelled: np.ndarray, good: np.ndarray):
        self.rows = rows
        n, k = (np.bincount(rows.take(x)[0], minlength=size) for x in (labelled, labelled[good == 1]))
        expected = n * good.mean()
        self.used = (n >= least) & (np.abs(k - expected) >= apart * np.sqrt(np.maximum(expected * (1 - good.mean()), 1e-9)))
        self.weight, self.bias, self.grown, self.grown_bias = np.zeros(size), 0.0, np.full(size, 1e-3), 1e-3

    def fit(self, rows: np.ndarray, good: np.ndarray, passes: int, rng: np.random.Generator) -> None:
        for _ in range(passes):
            order = rng.permutation(len(rows))
            for i in range(0, len(order), 256):
                pick = order[i : i + 256]
                features, of = self.rows.take(rows[pick])
                error = sigmoid(self.score(rows[pick])) - good[pick]
                there, index = np.unique(features, return_inverse=True)
                slope = np.bincount(index, error[of], len(there)) / len(pick) + 1e-5 * self.weight[there]
                slope[~self.used[there]] = 0
                self.grown[there] += slope**2
                self.weight[there] -= RATE * slope / np.sqrt(self.grown[there])
                self.grown_bias += error.mean() ** 2
                self.bias -= RATE * error.mean() / math.sqrt(self.grown_bias)

    def score(self, rows: np.ndarray) -> np.ndarray:
        features, of = self.rows.take(rows)
        return np.bincount(of, self.weight[features], len(rows)) + self.bias


def logistic(x: np.ndarray, good: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights, the constant last, of a small regression by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = sigmoid(x @ w)
        w -= np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge * np.eye(len(w)), x.T @ (p - good) + ridge * w)
    return w


class Model:
    """What scoring needs: the two views' weights, their calibration and their combination. blank: nothing could be fitted."""

    def __init__(self, content_view: View | None = None, meta_view: View | None = None, curves=None, mix=None, prior: float = 1.0):
        self.blank, self.prior = content_view is None, prior
        if not self.blank:
            self.number = np.flatnonzero(content_view.weight).astype(np.int32)
            self.weight, self.bias = content_view.weight[self.number], content_view.bias
            self.meta, self.meta_bias = meta_view.weight, meta_view.bias
            self.curves, self.mix = curves, mix

    def weights(self) -> dict[int, float]:
        return dict(zip(self.number.tolist(), self.weight.tolist(), strict=True))

    def combined(self, content_score: np.ndarray, meta_score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probability of a good document by content, by metadata, by both."""
        a, b = (np.clip(c[0] * s + c[1], -12, 12) for c, s in zip(self.curves, (content_score, meta_score), strict=True))
        return sigmoid(a), sigmoid(b), sigmoid(self.mix[0] * a + self.mix[1] * b + self.mix[2])


def sample(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, pool: int = POOL) -> DataFrame:
    """doc_id and good (null: of the pool) of about as many labelled and unlabelled documents, bounded whatever the input.

    Good: quality 1 and not toxic. Of several labels of a document the worst counts; a null label is a good one.
    """
    of = labels.filter("doc_id is not null").groupBy("doc_id").agg(
        F.min((F.coalesce(F.col("quality"), F.lit(1)) > 0).cast("int") * (F.coalesce(F.col("toxic"), F.lit(0)) < 1).cast("int")).alias("good")
    )
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32))
    share = lambda most, n: int(min(1.0, most / max(1, n)) * (1 << 32))
    known = of.filter(place < share(labelled, labels.count())).limit(2 * labelled)
    bound = share(pool, docs.count())
    others = docs.select("doc_id").filter(place < bound).join(of.filter(place < bound), "doc_id", "left_anti").distinct().limit(2 * pool)
    return known.unionByName(others.withColumn("good", F.lit(None).cast("int")))


def fit(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS) -> Model:
    """Co-train on a sample of docs (doc_id, text, lang, source). Without good and bad labelled documents the model is blank and keeps everything."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, text, lang, source, good in zip(b.column(0).to_pylist(), utf8(b.column(1)), *(b.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                words, n = content(text)
                rows.append({"doc_id": doc, "good": good, "words": numbered(words)[:SEEN].tobytes(), "meta": metadata(text, n, len(words), source, lang)})
            yield pa.RecordBatch.from_pylist(
                rows, schema=pa.schema([("doc_id", pa.int64()), ("good", pa.int32()), ("words", pa.binary()), ("meta", pa.list_(pa.int32()))]),
            )

    picked = _read(docs).join(F.broadcast(sample(docs, labels)), "doc_id").mapInArrow(features, "doc_id long, good int, words binary, meta array<int>")
    got = sorted(picked.collect(), key=lambda r: (r["doc_id"], bytes(r["words"])))
    good = np.array([-1 if r["good"] is None else r["good"] for r in got])
    known = np.flatnonzero(good >= 0)
    turn = np.array([zlib.crc32(str(r["doc_id"]).encode()) % CALIBRATE == 0 for r in got], dtype=bool)
    train, check = known[~turn[known]], known[turn[known]]
    if min((good[train] == 1).sum(), (good[train] == 0).sum(), (good[check] == 1).sum(), (good[check] == 0).sum()) < 1:
        return Model()
    rng = np.random.default_rng(11)
    views = [
        View(Rows([np.frombuffer(r["words"], dtype=np.int32) for r in got]), 1 << BITS, LEAST, APART, train, good[train]),
        View(Rows([np.array(r["meta"], dtype=np.int32) for r in got]), 1 << META, 1, 0.0, train, good[train]),
    ]
    lessons = [(train, good[train].astype(float))] * 2
    pool = np.flatnonzero(good < 0)
    prior = good[train].mean()
    for k in range(rounds + 1):
        for view, (rows, y) in zip(views, lessons, strict=True):
            view.fit(rows, y, PASSES, rng)
        if k == rounds or not len(pool):
            break
        taken, new = np.zeros(len(pool), dtype=bool), []
        for view in views:
            order = np.argsort(view.score(pool), kind="stable")
            most = min(EXCHANGED, len(pool) // 4)
            bad, fine = order[: int(most * (1 - prior))], order[len(order) - int(most * prior) :]
            new.append((pool[np.concatenate([bad, fine])], np.concatenate([np.zeros(len(bad)), np.ones(len(fine))])))
            taken[np.concatenate([bad, fine])] = True
        lessons = [tuple(np.concatenate(x) for x in zip(mine, other, strict=True)) for mine, other in zip(lessons, reversed(new), strict=True)]
        pool = pool[~taken]
    scores, y = [v.score(check) for v in views], good[check].astype(float)
    curves = [logistic(s[:, None], y) for s in scores]
    return Model(*views, curves, logistic(np.column_stack([np.clip(c[0] * s + c[1], -12, 12) for c, s in zip(curves, scores, strict=True)]), y), prior)


def _read(docs: DataFrame) -> DataFrame:
    """The columns that both views need; missing ones are null."""
    have = lambda c, kind: (F.col(c) if c in docs.columns else F.lit(None)).cast(kind).alias(c)
    return docs.select(have("doc_id", "long"), F.coalesce(have("text", "string"), F.lit("")).alias("text"), have("lang", "string"), have("source", "string"))


SCORES = "content_score double, metadata_score double, quality_score double, quality_keep boolean"


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, prefix: str = "") -> DataFrame:
    """docs with content_score, metadata_score, quality_score (probabilities of a good document) and quality_keep.

    Every row and column stays; columns of these names, each after prefix, are replaced. Null and empty texts have no words and are
    judged by the rest. A blank model gives null scores and keeps every row.
    """
    new = [prefix + f.split()[0] for f in SCORES.split(", ")]
    docs = docs.drop(*new)
    if model.blank:
        return docs.withColumns({**{n: F.lit(None).cast("double") for n in new[:3]}, new[3]: F.lit(True)})
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    columns = {c: docs.columns.index(c) if c in docs.columns else None for c in ("text", "lang", "source")}

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = model.weights()
        known: dict[bytes, tuple[int, ...]] = {}
        for b in batches:
            if not b.num_rows:
                continue
            col = lambda c, b=b: [None] * b.num_rows if columns[c] is None else b.column(columns[c]).to_pylist()
            texts = [b""] * b.num_rows if columns["text"] is None else [t or b"" for t in utf8(b.column(columns["text"]))]
            first, second = [], []
            for text, lang, source in zip(texts, col("lang"), col("source"), strict=True):
                words, n = content(text)
                total = model.bias
                hit: set[int] = set()
                for w in words:
                    found = known.get(w)
                    if found is None:
                        found = tuple(i for i in features_of(w) if i in weights)
                        if len(known) < 400_000:
                            known[w] = found
                    hit.update(found)
                total += sum(weights[i] for i in sorted(hit))
                first.append(total)
                second.append(model.meta[metadata(text, n, len(words), source, lang)].sum() + model.meta_bias)
            p = model.combined(np.array(first), np.array(second))
            yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, p), pa.array(p[2] >= threshold)], names=[*b.schema.names, *new])

    return docs.mapInArrow(scored, ", ".join([names, *(f"`{n}` {f.split()[1]}" for n, f in zip(new, SCORES.split(", "), strict=True))]))


def op1_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's scores and whether it stays."""
    docs = documents(spark, sf_dir)
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs.select("doc_id", "text", "lang", "source"), model).select("doc_id", "content_score", "metadata_score", "quality_score", "quality_keep")
