"""A hidden Markov language model: trained by Baum-Welch, scored by the scaled forward recursion.

A document is its lower-cased words and one end. Each word belongs to a class: frequent training words have one each,
the others share classes by their last bytes and length, and the end has its own. Both kinds of classes grow with
the corpus (Classes, class_sizes). States emit classes; within a class a word has the share
(c + 1) / (N_class + V_class + 1) of its training count, what is left being for words never seen. The exact likelihood
of a text is that of its classes under the states times these shares.

Texts are read once: every task writes its documents in chunks of about CHUNK bytes, as numbers of the chunk's own
list of words. Word counts are summed over all chunks and come back to each chunk for its own words, so no task and
not the driver holds the vocabulary, and no text is shuffled. The states' first values come from counts over all training
documents of what stands before and after each class; each Baum-Welch round then sums expected counts, as many as states
times classes, over all training documents.
Chunks follow the input's own partitions, so no id or key decides their size.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scenewright.llm.common import documents, release, stored, texts_of, trim, utf8, word_runs

#: Latent states; rounds of Baum-Welch over all training documents.
STATES, ROUNDS = 6, 2
#: A word has a class of its own if it is at least one in OWN training tokens, and LEAST times there; so there are at most OWN.
OWN, LEAST = 20_000, 50
#: Other words share at least SHARED classes, else as many as the root of the number of distinct words.
SHARED = 512
#: Bytes of text to a chunk; words of a document that the recursions go through one after the other; rows of a batch that are
#: bytes at a time; words of documents that are gone through side by side.
CHUNK, PIECE, ROWS, SIDE = 8 << 20, 2_048, 256, 500_000
#: The first values: buckets of classes before and after a class, half of them for the most frequent; random starts of the
#: factors of their counts, steps of each; share of moves that stay in a state.
NEAR, STARTS, STEPS, STAY = 32, 16, 60, 0.9
#: Expected counts that every state has of its own accord; significant digits of a probability and decimals of a score, which
#: leave nothing of the order in which sums were taken.
SMOOTH, DIGITS, DECIMALS = 0.1, 6, 6
#: Documents with this remainder of crc32(doc_id as text) mod 7 are held out.
HELD_OUT = 2
END = b"\n"  # no word holds it


def class_sizes(tokens: int, distinct: int) -> tuple[int, int]:
    """(least count of a word with a class of its own, number of shared classes)."""
    return max(LEAST, -(-tokens // OWN)), max(SHARED, int(distinct**0.5))


def shape(word: bytes) -> int:
    """What shared classes go by: a word's last two bytes and its length; -1 for the end."""
    return -1 if word == END else (zlib.crc32(word[-2:]) * 31 + min(len(word), 12)) & 0x7FFFFFFF


class Classes:
    """Class numbers: 0 for the end, then the frequent words, then the shared classes."""

    def __init__(self, frequent: list[bytes], shared: int = SHARED):
        self.own = {w: i + 1 for i, w in enumerate(frequent)}
        self.shared, self.first = shared, len(frequent) + 1
        self.n = self.first + shared

    def of(self, word: bytes) -> int:
        found = self.own.get(word)
        return found if found is not None else 0 if word == END else self.first + shape(word) % self.shared

    def all_of(self, words: pa.Array, shapes: np.ndarray) -> np.ndarray:
        """The same of many words whose shapes are known."""
        frequent = pa.array(list(self.own), words.type)
        place = pc.index_in(words, value_set=frequent).fill_null(-1).to_numpy(zero_copy_only=False)
        return np.where(place >= 0, place + 1, np.where(shapes < 0, 0, self.first + shapes % self.shared)).astype(np.int32)


def rounded(a: np.ndarray) -> np.ndarray:
    """To DIGITS significant digits."""
    scale = 10.0 ** (DIGITS - 1 - np.floor(np.log10(np.maximum(a, 1e-300))))
    return np.rint(a * scale) / scale


class Lanes:
    """Sequences in pieces of at most PIECE, the longest first: flat (all classes), begin and n (place and length of each
    piece), longer (pieces with more than t classes), doc, ahead and after (the pieces before and after it, or -1)."""

    def __init__(self, docs: list[np.ndarray]):
        cut = [(i, at, min(PIECE, len(d) - at)) for i, d in enumerate(docs) for at in range(0, len(d), PIECE)]
        doc, at, n = (np.array(c, dtype=np.int64) for c in zip(*cut, strict=True))
        size = np.array([len(d) for d in docs], dtype=np.int64)
        order = np.argsort(-n, kind="stable")
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        ahead = np.where(at > 0, np.append(-1, rank[:-1]), -1)
        after = np.where(at + n < size[doc], np.append(rank[1:], -1), -1)
        self.flat, self.doc, self.n = np.concatenate(docs), doc[order], n[order]
        self.begin, self.ahead, self.after = (np.cumsum(size) - size)[self.doc] + at[order], ahead[order], after[order]
        self.longer = np.searchsorted(-self.n, -np.arange(int(self.n[0])), side="left")


class Model:
    """start (S), move (S, S), emit (S, classes): probabilities that each sum to one, to DIGITS digits."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @staticmethod
    def from_counts(start: np.ndarray, move: np.ndarray, emit: np.ndarray, prior: np.ndarray) -> Model:
        """From expected counts, a little of the classes' overall shares added so that no class is impossible."""
        norm = lambda a: rounded(a / a.sum(axis=-1, keepdims=True))
        return Model(norm(start + SMOOTH), norm(move + SMOOTH), norm(emit + SMOOTH * len(prior) * prior))

    def forward(self, docs: list[np.ndarray]) -> np.ndarray:
        """log10 likelihood of each sequence of classes, all at once."""
        out = np.zeros(len(docs))
        if not len(docs):
            return out
        lanes, onto = Lanes(docs), np.ascontiguousarray(self.move.T)
        a = self._entries(lanes)[0]
        total, pending = np.zeros(len(lanes.n)), np.ones(len(lanes.n))
        for t in range(int(lanes.n[0])):
            n = int(lanes.longer[t])
            step = (onto @ a[:, :n] if t else a[:, :n]) * self.emit.take(lanes.flat[lanes.begin[:n] + t], axis=1)
            scale = step.sum(axis=0)
            a = step / scale
            pending[:n] *= scale
            if t % 16 == 15:
                total += np.log10(pending)
                pending[:] = 1.0
        total += np.log10(pending)
        np.add.at(out, lanes.doc, total)
        return out

    def _entries(self, lanes: Lanes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each piece, one to a column: what its first emission is multiplied by, the state probabilities before it (of pieces that go on), and beta at its end.

        A piece is a matrix from the states before it to those at its end. Pieces' matrices are made side by side and
        then chained, so a long document takes as many steps as one piece, not as many as it has words.
        """
        s, count = len(self.start), len(lanes.n)
        enter, before, last = np.repeat(self.start[:, None], count, axis=1), np.zeros((s, count)), np.ones((s, count))
        parts = np.flatnonzero((lanes.after >= 0) | (lanes.ahead >= 0))
        if not len(parts):
            return enter, before, last
        emit = np.ascontiguousarray(self.emit.T)
        m = np.where((lanes.ahead[parts] < 0)[:, None, None], np.eye(s), self.move)
        longer = np.searchsorted(-lanes.n[parts], -np.arange(int(lanes.n[parts[0]])), side="left")
        for t, n in enumerate(longer.tolist()):
            step = (m[:n] @ self.move if t else m[:n]) * emit[lanes.flat[lanes.begin[parts[:n]] + t]][:, None, :]
            m[:n] = step / step.sum(axis=(1, 2), keepdims=True)
        at = dict(zip(parts.tolist(), range(len(parts)), strict=True))
        for head in parts[lanes.ahead[parts] < 0].tolist():
            chain, a = [], self.start
            while head >= 0:
                before[:, head] = a
                chain.append(head)
                a = a @ m[at[head]]
                a = a / a.sum()
                head = int(lanes.after[head])
            for x, y in zip(chain[-2::-1], chain[:0:-1], strict=True):
                v = m[at[y]] @ last[:, y]
                last[:, x] = v / (before[:, y] @ v)
        on = parts[lanes.ahead[parts] >= 0]
        enter[:, on] = self.move.T @ before[:, on]
        return enter, before, last

    def expected(self, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected counts of starts, moves and emissions over the sequences, by the scaled forward and backward recursions."""
        s, classes = self.emit.shape
        start, move, emitted = np.zeros(s), np.zeros((s, s)), np.zeros((s, classes))
        docs = [d for d in docs if len(d)]
        if not docs:
            return start, move, emitted
        lanes, onto = Lanes(docs), np.ascontiguousarray(self.move.T)
        a, before, beta = self._entries(lanes)
        top, flat, begin = int(lanes.n[0]), lanes.flat, lanes.begin
        place = np.cumsum(lanes.longer) - lanes.longer  # step t's lanes stand together
        alpha, scale = np.empty((s, len(flat))), np.empty(len(flat))
        seen = np.empty(len(flat), dtype=flat.dtype)
        for t in range(top):
            n, p = int(lanes.longer[t]), int(place[t])
            seen[p : p + n] = flat[begin[:n] + t]
            step = (onto @ a[:, :n] if t else a[:, :n]) * self.emit.take(seen[p : p + n], axis=1)
            c = step.sum(axis=0)
            a = step / c
            alpha[:, p : p + n], scale[p : p + n] = a, c
        for t in range(top - 1, -1, -1):
            n, p = int(lanes.longer[t]), int(place[t])
            here = alpha[:, p : p + n]
            if t + 1 < top:
                m, q = int(lanes.longer[t + 1]), int(place[t + 1])
                onward = self.emit.take(seen[q : q + m], axis=1)
                onward *= beta[:, :m]
                onward /= scale[q : q + m]
                move += here[:, :m] @ onward.T
                beta[:, :m] = self.move @ onward
            here *= beta[:, :n]  # now the states' probabilities given the whole text
        on = np.flatnonzero(lanes.ahead >= 0)  # moves from one piece into the next
        move += before[:, on] @ (self.emit[:, seen[on]] * beta[:, on] / scale[on]).T
        move *= self.move
        for k in range(s):
            emitted[k] = np.bincount(seen, weights=alpha[k], minlength=classes)
        start += alpha[:, np.flatnonzero(lanes.ahead < 0)].sum(axis=1)
        return start, move, emitted


def _batches(docs: Iterator[np.ndarray], most: int) -> Iterator[list[np.ndarray]]:
    run, size = [], 0
    for d in docs:
        run.append(d)
        size += len(d)
        if size >= most:
            yield run
            run, size = [], 0
    if run:
        yield run


def held_out(doc_id: str = "doc_id"):
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(7)) == HELD_OUT


CHUNKS = "chunk long, ids array<long>, held array<boolean>, lens array<long>, tokens binary, words array<binary>, shapes array<int>, counts array<long>"
_CHUNKS = pa.schema([
    ("chunk", pa.int64()), ("ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("lens", pa.list_(pa.int64())),
    ("tokens", pa.binary()), ("words", pa.list_(pa.binary())), ("shapes", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64())),
])


class Chunk:
    """Documents under way into one row: each token as the number of its word in the chunk's own list."""

    def __init__(self):
        self.ids, self.held, self.lens, self.tokens, self.size = [], [], [], [], 0
        self.index: defaultdict[bytes, int] = defaultdict()
        self.index.default_factory = self.index.__len__

    def add(self, doc: int | None, held: bool, text: bytes) -> None:
        n, number = 1, self.index.__getitem__
        for run in word_runs(text.lower()):
            self.tokens.append(np.fromiter(map(number, run), dtype=np.uint32, count=len(run)))
            n += len(run)
        self.tokens.append(np.array([number(END)], dtype=np.uint32))
        self.ids.append(doc)
        self.held.append(held)
        self.lens.append(n)
        self.size += len(text) + 1

    def row(self, chunk: int) -> pa.RecordBatch:
        tokens = np.concatenate(self.tokens)
        counts = np.bincount(tokens[np.repeat(~np.array(self.held), self.lens)], minlength=len(self.index))
        shapes = np.fromiter(map(shape, self.index), dtype=np.int32, count=len(self.index))
        words = pa.array(self.index.keys(), pa.binary(), size=len(self.index))
        lists = [pa.array(self.ids, pa.int64()), pa.array(self.held), pa.array(self.lens, pa.int64()), words, pa.array(shapes), pa.array(counts)]
        ids, held, lens, words, shapes, counts = (pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists)
        made = [pa.array([chunk], pa.int64()), ids, held, lens, pa.array([zstandard.compress(tokens.tobytes(), 1)]), words, shapes, counts]
        return pa.RecordBatch.from_arrays(made, schema=_CHUNKS)


def chunks(rows: DataFrame) -> DataFrame:
    """One row for about CHUNK bytes of text of one task: its documents' ids, folds, lengths and tokens, and its words with their training counts."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at, now = TaskContext.get().partitionId() << 32, Chunk()
        for b in batches:
            for some in (b.slice(i, ROWS) for i in range(0, b.num_rows, ROWS)):
                for doc, out, text in zip(some.column(0).to_pylist(), some.column(2).to_pylist(), utf8(some.column(1)), strict=True):
                    now.add(doc, out, text)
                    if now.size >= CHUNK:
                        made, at, now = now.row(at), at + 1, Chunk()
                        yield made
                        del made
                        trim()
        if now.ids:
            yield now.row(at)
        b = some = text = now = None
        trim()  # a worker that waits for its next task holds no chunk

    return rows.select("doc_id", "text", "held_out").mapInArrow(read, CHUNKS)


READ = ("held", "lens", "tokens", "words", "shapes")


def _training(batch: pa.RecordBatch, classes: Classes) -> Iterator[np.ndarray]:
    """The classes of each training document of rows with the columns READ."""
    for i in range(batch.num_rows):
        held, lens, tokens, words, shapes = (batch.column(n)[i] for n in READ)
        of = classes.all_of(words.values, shapes.values.to_numpy())[np.frombuffer(zstandard.decompress(tokens.as_buffer()), dtype=np.uint32)]
        n = lens.values.to_numpy()
        end = np.cumsum(n)
        for out, a, b in zip(held.as_py(), (end - n).tolist(), end.tolist(), strict=True):
            if not out:
                yield of[a:b]


def neighbours(made: DataFrame, classes: Classes) -> np.ndarray:
    """(classes, 2 NEAR): how often a class of each bucket follows and precedes each class, over all training documents."""

    def bucket(c: np.ndarray) -> np.ndarray:
        return np.where(c < NEAR // 2, c, NEAR // 2 + c % (NEAR // 2))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(classes.n * 2 * NEAR, dtype=np.int64)
        for b in batches:
            for run in _batches(_training(b, classes), SIDE):
                of, row = np.concatenate(run), np.repeat(np.arange(len(run)), [len(d) for d in run])
                on = np.flatnonzero(row[:-1] == row[1:])
                x, y = of[on].astype(np.int64), of[on + 1].astype(np.int64)
                for cell in (x * 2 * NEAR + bucket(y), y * 2 * NEAR + NEAR + bucket(x)):
                    total += np.bincount(cell, minlength=len(total))
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(total[there])], names=["i", "n"])
        trim()

    got = made.select(*READ).mapInArrow(counted, "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(classes.n * 2 * NEAR)
    out[got.column("i").to_numpy()] = got.column("n").to_numpy()
    return out.reshape(classes.n, 2 * NEAR)


def first_model(made: DataFrame, classes: Classes, prior: np.ndarray, states: int) -> Model:
    """The model whose states are what best explains the neighbours of all classes, of STARTS random starts.

    The counts are factored into shares of the states in each class and of the buckets in each state, by expectation
    and maximization. They are whole numbers, so the order in which Spark sums them doesn't matter.
    """
    x = neighbours(made, classes)
    n, best = x.sum(axis=1) + 1, (-np.inf, None)
    for seed in range(STARTS):
        rng = np.random.default_rng(seed)
        p, q = rng.gamma(1.0, 1.0, (classes.n, states)).clip(0.05), rng.gamma(5.0, 1.0, (states, x.shape[1])) * (x.sum(axis=0) + 1)
        for step in range(STEPS + 1):
            p, q = p / p.sum(axis=1, keepdims=True), q / q.sum(axis=1, keepdims=True)
            if step < STEPS:
                r = x / (p @ q)
                p, q = p * (r @ q.T), q * (p.T @ r) + 1e-3
                p += (p.sum(axis=0) + 1e-9) / (p.sum() + 1e-9) * SMOOTH
        fit = float((x * np.log(p @ q)).sum())
        if fit > best[0]:
            best = fit, p
    weight = best[1] * n[:, None]
    share = (weight.sum(axis=0) / weight.sum())[None, :]
    emit = weight.T + SMOOTH * states * prior
    return Model(share[0], (1 - STAY) * np.repeat(share, states, axis=0) + STAY * np.eye(states), emit / emit.sum(axis=1, keepdims=True))


def one_round(made: DataFrame, model: Model, classes: Classes, prior: np.ndarray) -> Model:
    """One Baum-Welch round over all training documents: expected counts are summed by each task, then by Spark."""
    states = len(model.start)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for i in range(b.num_rows):
                for run in _batches(_training(b.slice(i, 1), classes), SIDE):
                    found = model.expected(run)
                    total = found if total is None else tuple(x + y for x, y in zip(total, found, strict=True))
                trim()
        if total is not None:
            flat = np.concatenate([x.ravel() for x in total])
            there = np.flatnonzero(flat)
            yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(flat[there])], names=["i", "x"])
        trim()

    got = made.select(*READ).mapInArrow(step, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()
    if not got:
        return model
    flat = np.zeros(states + states * states + states * classes.n)
    for r in got:
        flat[r["i"]] = r["x"]
    cut = [states, states + states * states]
    return Model.from_counts(flat[: cut[0]], flat[cut[0] : cut[1]].reshape(states, states), flat[cut[1] :].reshape(states, classes.n), prior)


def train(
    made: DataFrame, vocabulary: DataFrame, tokens: int, distinct: int, states: int = STATES, rounds: int = ROUNDS,
) -> tuple[Model, Classes, np.ndarray, np.ndarray]:
    """Model, classes, and each class's training count and number of distinct words. tokens, distinct: of the training fold."""
    least, shared = class_sizes(tokens, distinct)
    top = vocabulary.filter(F.col("word") != F.lit(END)).filter(F.col("c") >= least).select("c", "word").collect()  # at most OWN
    classes = Classes([bytes(r["word"]) for r in sorted(top, key=lambda r: (-r["c"], bytes(r["word"])))], shared)

    def classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cls, c = classes.all_of(b.column(0), b.column(2).to_numpy()), b.column(1).to_numpy()
            n, v = np.bincount(cls, c, classes.n), np.bincount(cls, c > 0, classes.n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(classes.n), pa.int32()), pa.array(n.astype(np.int64)), pa.array(v.astype(np.int64))], names=["class", "n", "v"],
            )

    sums = vocabulary.mapInArrow(classed, "class int, n long, v long").groupBy("class").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()
    n, v = np.zeros(classes.n), np.zeros(classes.n)
    for r in sums:
        n[r["class"]], v[r["class"]] = r["n"], r["v"]
    prior = (n + 1) / (n + 1).sum()
    model = first_model(made, classes, prior, states)
    for _ in range(rounds):
        model = one_round(made, model, classes, prior)
    return model, classes, n, v


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_SCORES = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("held_out", pa.bool_()),
        ("n_tokens", pa.int64()),
        ("n_known", pa.int64()),
        ("train_tokens", pa.int64()),
        ("base_score", pa.float64()),
        ("score", pa.float64()),
    ]
)


def score_documents(docs: DataFrame, text: str = "text", states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row; learns from those not held out.

    base_score is the log10 probability under words alone, (c + 1) / (N + V + 1) each, score that of the hidden Markov
    model, to DECIMALS places. Null and empty texts are one end. A null doc_id counts as the empty text for the fold.
    Rows that share a doc_id each count and get a row. With no training documents every count is zero and both scores
    still exist. No documents: no rows. Scores don't depend on how the input is partitioned.
    """
    spark = docs.sparkSession
    made = stored(chunks(texts_of(docs, text).withColumn("held_out", held_out())), "lm-chunks")
    # One shuffle of words: each chunk's row learns its word's count, and the first row of a word keeps it for the vocabulary.
    rows = made.select(
        F.col("chunk").alias("of"), F.posexplode(F.arrays_zip("words", "counts", "shapes")).alias("k", "w"),
    ).select("of", "k", F.col("w.words").alias("word"), F.col("w.counts").alias("n"), F.col("w.shapes").alias("shape"))
    by = Window.partitionBy("word")
    rows = rows.select("of", "k", F.sum("n").over(by).alias("c"), F.when(F.row_number().over(by.orderBy("of", "k")) == 1, F.col("word")).alias("word"), "shape")
    counted = stored(rows, "lm-words")
    vocabulary = counted.filter("word is not null").select("word", "c", "shape")
    release(spark)
    sums = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    n_all, v_all = int(sums["n"]), int(sums["v"])
    model, classes, n_class, v_class = train(made, vocabulary, n_all, v_all, states, rounds)
    release(spark)
    asked = counted.select("of", "k", "c")
    end_share = np.log10((n_class + v_class + 1).clip(1))

    def score(docs: pa.Table, words: pa.Table) -> pa.Table:
        names, shapes, tokens = (docs.column(n).combine_chunks()[0] for n in ("words", "shapes", "tokens"))
        (r,) = docs.select(["ids", "held", "lens"]).to_pylist()
        c = np.zeros(len(names.values))
        c[words.column("k").to_numpy()] = words.column("c").to_numpy()
        of = classes.all_of(names.values, shapes.values.to_numpy())
        base = np.log10(c + 1.0) - np.log10(n_all + v_all + 1.0)
        share = np.log10(c + 1.0) - end_share[of]
        share[of == 0] = 0.0  # the end's class has nothing else in it
        known = c > 0
        tokens = np.frombuffer(zstandard.decompress(tokens.as_buffer()), dtype=np.uint32)
        end = np.cumsum(r["lens"])
        out = []
        for doc, held, n, b in zip(r["ids"], r["held"], r["lens"], end.tolist(), strict=True):
            at = tokens[b - n : b]
            out.append(
                {
                    "doc_id": doc,
                    "held_out": held,
                    "n_tokens": n,
                    "n_known": int(known[at].sum()),
                    "train_tokens": n_all,
                    "base_score": float(base[at].sum()),
                    "score": float(share[at].sum()),
                }
            )
        done = 0
        for run in _batches((of[tokens[b - n : b]] for n, b in zip(r["lens"], end.tolist(), strict=True)), SIDE):
            for x in model.forward(run):
                out[done]["score"] = round(out[done]["score"] + float(x), DECIMALS)
                done += 1
        trim()
        return pa.Table.from_pylist(out, schema=_SCORES)

    return made.select("chunk", "ids", "held", "lens", "tokens", "words", "shapes").groupBy("chunk").cogroup(asked.groupBy("of")).applyInArrow(score, SCORES)


def op10_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(documents(spark, sf_dir))
