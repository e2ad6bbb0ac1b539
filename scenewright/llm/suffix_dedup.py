"""Removal of long byte strings that occur in an earlier document, by longest-previous-factor arrays.

A byte goes if a string of LENGTH bytes that covers it also starts in a document with a smaller doc_id. One suffix
array over a whole corpus can't be split among machines, so suffixes are sampled such that none that matters is
lost, and each sample is sorted where all suffixes that could match it are:

1. Anchors. In every string of LENGTH bytes the GRAM bytes with the smallest hash are an anchor. Equal strings have
   equal anchors at equal places. Anchors meet by hash; those of one document alone are dropped.
2. Contexts. Of a shared anchor, the LENGTH - GRAM bytes before it and the LENGTH bytes from it on hold every string
   that it is an anchor of. Contexts meet by their anchor's bytes.
3. Suffix order. Contexts sorted by the bytes from the anchor on, and by those before it, tell how far each can
   match another at most. For the starts that remain, the suffixes, each up to its context's end, are sorted, with
   longest common prefixes and, for each, the previous and next suffix of a smaller document: the longest previous
   factor. Where it reaches LENGTH, all of it is removed. Nothing is removed in another way: of contexts that are
   equal throughout, the first and one later one are sorted, and what the later one's factor says holds for all later
   ones; a task that reads several of them decides in the same way, by the factors of whole contexts in their order.

What travels is packed by numpy into a few large rows: anchors as 6 bytes of hash with places as differences,
compressed. Equal anchors and equal contexts are reduced where they are read, so what a group gets of one string
grows with the number of batches of TOGETHER bytes of text, not with its copies. Different contexts of one anchor are
all sorted in one group, at SIDE + LENGTH bytes each.

Rows are told apart by doc_id and, only where a doc_id occurs more than once, by a 64-bit hash of the text (mark).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenewright.llm.common import buckets_for, documents, release, stored, texts_of, trim, utf8

LENGTH, GRAM = 50, 24
SIDE = LENGTH - GRAM
#: Bytes of text that are hashed at once, that are reduced together before they are sent, and that a group gets; contexts
#: that are reduced together. They bound a Python worker's memory, at about 300 MB. With more text, larger groups and
#: more memory send fewer and fuller rows.
HASHED, TOGETHER, GROUP, CONTEXTS_TOGETHER = 1 << 18, 8 << 20, 8 << 20, 1 << 17
_NONE = np.uint64(2**64 - 1)

#: One packed row: entries of documents (doc_id, mark, bucket, entries of each) and two numbers and some bytes of each entry.
PACKED = "part int, kind int, docs binary, marks binary, buckets binary, counts binary, x binary, y binary, data binary"
_PACKED = pa.schema([("part", pa.int32()), ("kind", pa.int32()), *((n, pa.binary()) for n in ("docs", "marks", "buckets", "counts", "x", "y", "data"))])
ANCHORS, COVERED, CONTEXTS = 0, 1, 2


def _dump(a: np.ndarray) -> bytes:
    """Numbers byte by byte, all first bytes together, compressed."""
    a = np.ascontiguousarray(a)
    return zstandard.compress(a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes(), 1)


def _load(data: bytes, kind: str) -> np.ndarray:
    kind = np.dtype(kind)
    raw = np.frombuffer(zstandard.decompress(data), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(kind.itemsize, -1).T).view(kind).ravel()


class Entries:
    """Entries of documents: doc_id, mark, bucket, x, y and perhaps bytes, one of each per entry."""

    FIELDS = ("doc", "mark", "bucket", "x", "y")

    def __init__(self, doc, mark, bucket, x, y, data=None):
        self.doc, self.mark, self.bucket, self.x, self.y, self.data = doc, mark, bucket, x, y, data

    def take(self, at: np.ndarray) -> Entries:
        return Entries(*(getattr(self, f)[at] for f in self.FIELDS), None if self.data is None else self.data[at])

    def packed(self, part: np.ndarray, kind: int) -> Iterator[dict]:
        """Rows, one for each value of part; within them entries in the order of document and x."""
        order = np.lexsort((self.x, self.mark, self.doc, part))
        cuts = np.flatnonzero(np.diff(part[order])) + 1
        for run in np.split(order, cuts) if len(order) else ():
            e = self.take(run)
            new = np.concatenate([[True], (e.doc[1:] != e.doc[:-1]) | (e.mark[1:] != e.mark[:-1])])
            at = np.flatnonzero(new)
            x = e.x.astype(np.uint32)
            step = np.diff(x, prepend=np.uint32(0))
            step[at] = x[at]
            yield {
                "part": int(part[run[0]]), "kind": kind, "docs": _dump(
                    np.diff(e.doc[at], prepend=np.int64(0))
                ), "marks": _dump(e.mark[at]), "buckets": _dump(e.bucket[at]),
                "counts": _dump(
                    np.diff(at, append=len(x)).astype(np.uint32)
                ), "x": _dump(step), "y": _dump(e.y), "data": None if e.data is None else zstandard.compress(e.data.tobytes(), 1),
            }

    @staticmethod
    def unpacked(rows: list[dict], kind: str, width: int = 0) -> Entries:
        out = []
        for r in rows:
            counts = _load(r["counts"], "u4")
            step = _load(r["x"], "u4")
            first = np.cumsum(counts) - counts
            x = np.cumsum(step.astype(np.int64))
            x -= np.repeat(x[first] - step[first], counts)
            spread = lambda a, c=counts: np.repeat(a, c)
            data = np.frombuffer(zstandard.decompress(r["data"]), dtype=np.uint8).reshape(-1, width) if width else None
            out.append(
                (spread(np.cumsum(_load(r["docs"], "i8"))), spread(_load(r["marks"], "u8")), spread(_load(r["buckets"], "i4")), x, _load(r["y"], kind), data)
            )
        if not out:
            return Entries(
                np.empty(0, "i8"), np.empty(0, "u8"), np.empty(0, "i4"), np.empty(0, "i8"), np.empty(0, kind), np.empty((0, width), np.uint8) if width else None,
            )
        cols = list(zip(*out, strict=True))
        return Entries(*(np.concatenate(c) for c in cols[:5]), np.concatenate(cols[5]) if width else None)


def _table(rows: list[dict]) -> pa.Table:
    return pa.Table.from_pylist(rows, schema=_PACKED)


def _hashes(buf: np.ndarray, n: int) -> np.ndarray:
    """A hash of the GRAM bytes from each of the first n places on; buf goes on for GRAM + 8 bytes at least."""
    eight = np.lib.stride_tricks.as_strided(buf, shape=(n + GRAM - 8, 8), strides=(1, 1))
    words = np.ascontiguousarray(eight).view("<u8").ravel()
    h = words[:n] * np.uint64(0x9E3779B97F4A7C15)
    for at, m in ((8, 0xBF58476D1CE4E5B9), (16, 0x94D049BB133111EB)):
        h ^= h >> np.uint64(32)
        h += words[at : at + n]
        h *= np.uint64(m)
    h ^= h >> np.uint64(29)
    return h


def _part(h: np.ndarray, parts: int) -> np.ndarray:
    """Groups by the lower half of hashes: anchors have the smallest hashes around, so their upper halves crowd at zero."""
    return ((h & np.uint64(0xFFFFFFFF)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _slide(h: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Smallest of the width numbers from each place on, or largest of the width up to it."""
    f = np.minimum if least else np.maximum
    out, step = h.copy(), 1
    while step < width:
        s = min(step, width - step)
        if s >= len(out):
            break
        if least:
            out[:-s] = f(out[:-s], out[s:])
        else:
            out[s:] = f(out[s:], out[:-s].copy())
        step += s
    return out


def anchors(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts laid end to end: piece, place in it, and hash of every anchor."""
    lens = np.array([len(p) for p in pieces])
    n = int(lens.sum())
    buf = np.frombuffer(b"".join(pieces) + b"\0" * (GRAM + 8), dtype=np.uint8)
    h = np.minimum(_hashes(buf, n), _NONE - np.uint64(1))
    piece = np.repeat(np.arange(len(pieces)), lens)
    start = np.cumsum(lens) - lens
    left = np.repeat(start + lens, lens) - np.arange(n)  # bytes from here to the text's end
    h[left < GRAM] = _NONE
    low = _slide(h, SIDE + 1, True)
    low[left < LENGTH] = 0
    at = np.flatnonzero((_slide(low, SIDE + 1, False) == h) & (left >= GRAM))
    return piece[at], at - start[piece[at]], h[at]


def _pieces(texts: list[bytes]) -> Iterator[list[tuple[int, int, bytes]]]:
    """(text, place, bytes) in lists of about HASHED bytes; long texts in pieces that share LENGTH - 1 bytes."""
    run, size = [], 0
    for i, t in enumerate(texts):
        if len(t) < LENGTH:
            continue
        for at in range(0, max(1, len(t) - LENGTH + 1), HASHED):
            p = t[at : at + HASHED + LENGTH - 1]
            if len(p) >= LENGTH:
                run.append((i, at, p))
                size += len(p)
            if size >= HASHED:
                yield run
                run, size = [], 0
    if run:
        yield run


def _anchor_rows(docs: np.ndarray, marks: np.ndarray, buckets: np.ndarray, texts: list[bytes], parts: int) -> Iterator[dict]:
    """Anchors of some documents, packed. Of equal ones, those of the first document go to a part by hash; those of several documents are known to be shared."""
    found = []
    for run in _pieces(texts):
        piece, at, h = anchors([p for _, _, p in run])
        found.append((np.array([i for i, _, _ in run])[piece], np.array([a for _, a, _ in run])[piece] + at, h))
    if not found:
        return
    text, at, h = (np.concatenate(c) for c in zip(*found, strict=True))
    doc = docs[text]
    order = np.lexsort((doc, h))
    text, at, h, doc = text[order], at[order], h[order], doc[order]
    new = np.concatenate([[True], h[1:] != h[:-1]])
    group = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    least, most = doc[first], doc[np.append(first[1:], len(h)) - 1]
    e = Entries(doc, marks[text], buckets[text], at, h & np.uint64((1 << 48) - 1))
    part = _part(h, parts)
    send = doc == least[group]
    shared = (least < most)[group]
    yield from ((e.take(send)).packed(part[send], ANCHORS))
    yield from (e.take(shared).packed(e.bucket[shared] % parts, COVERED))


def _narrow(rows: Iterator[dict]) -> list[dict]:
    """Hashes as 6 bytes in place of 8."""
    out = []
    for r in rows:
        r["y"] = _six(_load(r["y"], "u8"))
        out.append(r)
    return out


def _six(h: np.ndarray) -> bytes:
    return np.ascontiguousarray(h.view(np.uint8).reshape(-1, 8)[:, :6].T).tobytes()


def _from_six(data: bytes) -> np.ndarray:
    raw = np.zeros((len(data) // 6, 8), dtype=np.uint8)
    raw[:, :6] = np.frombuffer(data, dtype=np.uint8).reshape(6, -1).T
    return raw.view("<u8").ravel()


def shared_anchors(rows: DataFrame, parts: int) -> DataFrame:
    """Places of anchors that several documents have, packed by the documents' bucket (column part)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(held: list) -> list[pa.RecordBatch]:
            ids, buckets, marks, texts = (list(c) for c in zip(*held, strict=True))
            made = _narrow(_anchor_rows(np.array(ids, "i8"), np.array(marks, "i8").view("u8"), np.array(buckets, "i4"), texts, parts))
            return _table(made).to_batches()

        held, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(3)), utf8(batch.column(3)), strict=True):
                held.append(row)
                size += len(row[3])
                if size >= TOGETHER:
                    yield from emit(held)
                    held, size = [], 0
                    trim()
        if held:
            yield from emit(held)

    def meet(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        known = [r for r in rows if r["kind"] == COVERED]
        rows = [r for r in rows if r["kind"] == ANCHORS]
        for r in rows + known:
            r["y"] = _dump(_from_six(r["y"]))
        e = Entries.unpacked(rows, "u8")
        order = np.lexsort((e.doc, e.y))
        h, doc = e.y[order], e.doc[order]
        if len(h):
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            end = np.append(first[1:], len(h))
            order = order[np.repeat(doc[first] < doc[end - 1], end - first)]
        found = [e.take(order), Entries.unpacked(known, "u8")]
        both = Entries(*(np.concatenate([getattr(f, n) for f in found]) for n in Entries.FIELDS))
        both.y = np.zeros(len(both.x), np.uint8)
        del rows, known, e, h, doc, order, found
        trim()
        return _table(list(both.packed(both.bucket, ANCHORS)))

    return rows.select("doc_id", "bucket", "mark", "text").mapInArrow(read, PACKED).groupBy("part").applyInArrow(meet, PACKED)


def _gather(texts: list[bytes], text: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Contexts (SIDE bytes before each place and LENGTH from it on, zero beyond the text) and how many bytes of either exist."""
    lens = np.array([len(t) for t in texts], dtype=np.int64)
    gap = LENGTH + SIDE
    start = np.cumsum(lens + gap) - lens
    buf = np.zeros(int(start[-1] + lens[-1] + gap) if len(texts) else gap, dtype=np.uint8)
    for s, t in zip(start.tolist(), texts, strict=True):
        buf[s : s + len(t)] = np.frombuffer(t, dtype=np.uint8)
    rows = np.lib.stride_tricks.as_strided(buf, shape=(len(buf) - gap + 1, gap), strides=(1, 1))
    before, after = np.minimum(at, SIDE), np.minimum(lens[text] - at, LENGTH)
    return rows[start[text] + at - SIDE], (before * 64 + after).astype(np.uint16)


def _words(data: np.ndarray) -> np.ndarray:
    """Rows of bytes as rows of numbers that compare alike."""
    wide = np.zeros((len(data), -(-data.shape[1] // 8) * 8), dtype=np.uint8)
    wide[:, : data.shape[1]] = data
    return wide.view(">u8").astype(np.uint64)


def _suffix_order(data: np.ndarray, size: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, group): whole contexts in suffix order, the smallest document first of equal ones, and the group of equal ones that each is in."""
    words = _words(data)
    order = np.lexsort((doc, size, *words.T[::-1]))
    equal = (words[order[1:]] == words[order[:-1]]).all(axis=1) & (size[order[1:]] == size[order[:-1]])
    return order, np.cumsum(np.concatenate([[0], ~equal])) if len(order) else np.empty(0, np.int64)


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many bytes the rows of a and b begin with in common."""
    out = np.empty(len(a), dtype=np.int64)
    for i in range(0, len(a), 1 << 17):
        differ = a[i : i + (1 << 17)] != b[i : i + (1 << 17)]
        out[i : i + (1 << 17)] = np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])
    return out


def _reach(data: np.ndarray) -> np.ndarray:
    """The most bytes that each row begins with in common with any other: that with a neighbour in sorted order."""
    best = np.zeros(len(data), dtype=np.int64)
    if len(data) > 1:
        order = np.lexsort(_words(data).T[::-1])
        common = _common(data[order[:-1]], data[order[1:]])
        best[order[:-1]] = common
        best[order[1:]] = np.maximum(best[order[1:]], common)
    return best


def previous_factors(doc: np.ndarray, common: np.ndarray, least: int) -> np.ndarray:
    """Longest previous factors of suffixes in sorted order, those under least as any number under it.

    common[i] is the longest common prefix of suffixes i - 1 and i. From each suffix on, the previous one of a
    smaller document is found by jumping from candidate to candidate, and with it the smallest common prefix on the
    way; then the next one alike. The longer of the two is the longest prefix shared with any smaller document.
    """

    def one_way(doc: np.ndarray, common: np.ndarray) -> np.ndarray:
        to, low = np.arange(len(doc)) - 1, common.copy()
        now = np.flatnonzero((to >= 0) & (low >= least))
        now = now[doc[to[now]] >= doc[now]]
        while len(now):
            via = to[now]
            low[now] = np.minimum(low[now], low[via])
            to[now] = to[via]
            now = now[(to[now] >= 0) & (low[now] >= least)]
            now = now[doc[to[now]] >= doc[now]]
        low[to < 0] = 0
        return low

    if not len(doc):
        return np.empty(0, np.int64)
    back = np.append(common[1:], 0)[::-1]
    return np.maximum(one_way(doc, common), one_way(doc[::-1], back)[::-1])


def covered_contexts(e: Entries) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entry, start, end) of what is to be removed around each context (e.x its anchor's place, e.y its extent, e.data its bytes)."""
    order, group = _suffix_order(e.data, e.y, e.doc)
    if not len(order):
        return order, order, order
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    least = e.doc[order[first]][group]  # of each context the smallest document that has it
    is_late = e.doc[order] > least
    # one entry for each different context, of the smallest document that has it, and one for all later documents
    later = np.flatnonzero(is_late)
    second = later[np.flatnonzero(np.concatenate([[True], group[later[1:]] != group[later[:-1]]]))] if len(later) else later
    stands = np.concatenate([first, second])  # places in order
    one, of_group, is_second = order[stands], group[stands], np.arange(len(stands)) >= len(first)
    before, after = (e.y[one] // 64).astype(np.int64), (e.y[one] % 64).astype(np.int64)
    data, doc = e.data[one], e.doc[one]
    right = np.zeros(len(one), np.int64)
    left = np.zeros(len(one), np.int64)
    own = ~is_second
    right[own] = _reach(data[own, SIDE:])
    left[own] = _reach(np.concatenate([data[own, SIDE : SIDE + GRAM], data[own, :SIDE][:, ::-1]], axis=1)) - GRAM
    low, high = np.maximum(LENGTH - np.minimum(right, after), 0), np.minimum(np.minimum(left, before), SIDE)
    low[is_second] = high[is_second] = before[is_second]  # the longest suffix of an equal context is all of it
    # and that of the context it equals is sorted with it
    pair = np.flatnonzero(np.isin(of_group, of_group[is_second]) & own)
    start, end = np.full(len(one), 1 << 40), np.full(len(one), -1)
    for j in range(SIDE + 1):  # suffixes that start j bytes before the anchor
        at = np.flatnonzero((low <= j) & (j <= high))
        more = pair[(before[pair] == j) & ~((low[pair] <= j) & (j <= high[pair]))]
        at = np.concatenate([at, more])
        at = at[j + after[at] >= LENGTH]
        if len(at) < 2:
            continue
        suffix, length = data[at, SIDE - j :], j + after[at]
        order_j = np.lexsort((doc[at], *_words(suffix).T[::-1]))
        suffix, length, at = suffix[order_j], length[order_j], at[order_j]
        common = np.concatenate([[0], np.minimum(_common(suffix[:-1], suffix[1:]), np.minimum(length[:-1], length[1:]))])
        factor = previous_factors(doc[at], common, LENGTH)
        hit = factor >= LENGTH
        start[at[hit]] = np.minimum(start[at[hit]], -j)
        end[at[hit]] = np.maximum(end[at[hit]], factor[hit] - j)
    # what a context's factors say holds for all documents that have it first, or later
    of_own, of_late = np.full(group[-1] + 1, -1), np.full(group[-1] + 1, -1)
    of_own[of_group[own]] = np.flatnonzero(own)
    of_late[of_group[is_second]] = np.flatnonzero(is_second)
    which = np.where(is_late, of_late[group], of_own[group])
    hit = end[which] >= 0
    entry, which = order[hit], which[hit]
    return entry, e.x[entry] + start[which], e.x[entry] + end[which]


def _positions(table: pa.Table) -> Entries:
    return Entries.unpacked(table.to_pylist(), "u1")


def covered(rows: DataFrame, shared: DataFrame, parts: int) -> DataFrame:
    """What is to be removed of each document, packed by bucket (column part): starts in x, lengths in y."""

    def contexts(docs: pa.Table, places: pa.Table) -> pa.Table:
        e = _positions(places)
        texts, ids = utf8(docs.column("text").combine_chunks()), docs.column("doc_id").to_numpy()
        known = {(int(d), int(m)): i for i, (d, m) in enumerate(zip(ids, docs.column("mark").to_numpy().view("u8"), strict=True))}
        if not len(e.x):
            return _table([])
        e = e.take(np.lexsort((e.x, e.mark, e.doc)))
        e = e.take(np.flatnonzero(np.concatenate([[True], (e.doc[1:] != e.doc[:-1]) | (e.mark[1:] != e.mark[:-1]) | (e.x[1:] != e.x[:-1])])))
        key = np.concatenate([[True], (e.doc[1:] != e.doc[:-1]) | (e.mark[1:] != e.mark[:-1])])
        index = np.array([known[int(d), int(c)] for d, c in zip(e.doc[key], e.mark[key], strict=True)])[np.cumsum(key) - 1]
        out = []
        for i in range(0, len(index), CONTEXTS_TOGETHER):
            part = slice(i, i + CONTEXTS_TOGETHER)
            used, where = np.unique(index[part], return_inverse=True)
            data, size = _gather([texts[u] for u in used], where, e.x[part])
            c = Entries(e.doc[part], e.mark[part], e.bucket[part], e.x[part], size, data)
            order, group = _suffix_order(data, size, c.doc)
            # factors of whole contexts in suffix order: all of a context that an earlier document has too, else nothing yet
            whole = (size[order] // 64 + size[order] % 64).astype(np.int64)
            common = np.concatenate([[0], np.where(group[1:] == group[:-1], whole[1:], 0)])
            gone = previous_factors(c.doc[order], common, LENGTH) >= np.maximum(whole, LENGTH)
            least = c.doc[order[np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))]][group]
            late = order[gone]
            before, after = (size[late] // 64).astype(np.int64), (size[late] % 64).astype(np.int64)
            full = before + after >= LENGTH
            done = c.take(late[full])
            done.x, done.y, done.data = done.x - before[full], (before + after)[full].astype(np.uint16), None
            out += done.packed(done.bucket % parts, COVERED)
            c = c.take(order[c.doc[order] == least])
            h = _hashes(
                np.concatenate([np.ascontiguousarray(c.data[:, SIDE : SIDE + 32]).ravel(), np.zeros(32, np.uint8)]), 32 * len(c.x),
            )[::32] if len(c.x) else np.empty(0, np.uint64)
            out += c.packed(_part(h, parts), CONTEXTS)
        trim()
        return _table(out)

    def meet(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        done = Entries.unpacked([r for r in rows if r["kind"] == COVERED], "u2")
        e = Entries.unpacked([r for r in rows if r["kind"] == CONTEXTS], "u2", SIDE + LENGTH)
        at, start, end = covered_contexts(e)
        found = Entries(e.doc[at], e.mark[at], e.bucket[at], start, (end - start).astype(np.uint16))
        both = Entries(*(np.concatenate([getattr(f, n) for f in (found, done)]) for n in Entries.FIELDS))
        del rows, done, e, at, start, end, found
        trim()
        return _table(list(both.packed(both.bucket, COVERED)))

    made = rows.groupBy("bucket").cogroup(shared.groupBy("part")).applyInArrow(contexts, PACKED)
    return made.groupBy("part").applyInArrow(meet, PACKED)


def union_of(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the separate runs that intervals cover; touching ones are one run."""
    order = np.argsort(start, kind="stable")
    start, upto = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], start[1:] > upto[:-1]])
    at = np.flatnonzero(new)
    return start[at], upto[np.append(at[1:], len(start)) - 1]


RESULT = "doc_id long, n_bytes long, span_starts array<long>, span_ends array<long>, kept binary"
_RESULT = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("span_starts", pa.list_(pa.int64())), ("span_ends", pa.list_(pa.int64())), ("kept", pa.binary())]
)


def remove_repeats(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_bytes, span_starts and span_ends (the maximal removed runs of bytes) and kept (the other bytes) of every row.

    Null and empty texts and those shorter than LENGTH bytes lose nothing. Rows that share a doc_id are no earlier
    than one another; equal rows change alike. A null doc_id is the smallest and stays null. No documents: no rows.
    """
    spark = docs.sparkSession
    size = texts_of(docs, text).agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = buckets_for(size, GROUP)
    lowest = -(1 << 63)
    rows = texts_of(docs, text).withColumn("doc_id", F.coalesce("doc_id", F.lit(lowest)))
    again = not rows.groupBy("doc_id").count().filter("count > 1").isEmpty()
    mark = F.xxhash64("text") if again else F.lit(0).cast("long")
    key = F.xxhash64("doc_id", mark) if again else F.xxhash64("doc_id")  # rows of one id are dealt apart
    rows = rows.withColumn("mark", mark).withColumn("bucket", F.pmod(key, F.lit(parts)).cast("int"))
    shared = stored(shared_anchors(rows, parts), "shared-anchors")
    release(spark)
    spans = stored(covered(rows, shared, parts), "repeats")
    release(spark)

    def cut(docs: pa.Table, spans: pa.Table) -> pa.Table:
        e = Entries.unpacked(spans.to_pylist(), "u2")
        e = e.take(np.lexsort((e.mark, e.doc)))
        new = np.flatnonzero(np.concatenate([[True], (e.doc[1:] != e.doc[:-1]) | (e.mark[1:] != e.mark[:-1])])) if len(e.x) else np.empty(0, np.int64)
        runs = {
            (int(e.doc[a]), int(e.mark[a])): union_of(e.x[a:b], e.x[a:b] + e.y[a:b]) for a, b in zip(new, np.append(new[1:], len(e.x))[: len(new)], strict=True)
        }
        out = []
        for d, m, t in zip(
            docs.column("doc_id").to_pylist(), docs.column("mark").to_numpy().view("u8").tolist(), utf8(docs.column("text").combine_chunks()), strict=True,
        ):
            starts, ends = runs.get((d, m), ([], []))
            starts, ends = [int(s) for s in starts], [int(s) for s in ends]
            kept = b"".join(t[a:b] for a, b in zip([0, *ends], [*starts, len(t)], strict=True))
            out.append({"doc_id": None if d == lowest else d, "n_bytes": len(t), "span_starts": starts, "span_ends": ends, "kept": kept})
        trim()
        return pa.Table.from_pylist(out, schema=_RESULT)

    return rows.groupBy("bucket").cogroup(spans.groupBy("part")).applyInArrow(cut, RESULT)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(documents(spark, sf_dir))
    return out.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
        F.size("span_starts").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
