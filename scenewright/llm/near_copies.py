"""Near copies: SimHash fingerprints over runs of five words find candidates, banded MinHash those that lie too many bits
apart for fingerprints; the Jaccard similarity of all of them is then verified."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenewright.llm.common import row_keys, stored, texts_of, utf8, word_runs
from scenewright.llm.components import components
from scenewright.llm.simhash import fingerprint_links, fingerprint_of

#: Words of a shingle; the similarity from which two texts are near copies.
WIDTH, ALIKE = 5, 0.8
#: Bits by which linked SimHash fingerprints differ at most.
RADIUS = 2
#: Bands of a signature and minima of a band: a pair at 0.8 shares none with a probability of 3e-5.
BANDS, ROWS = 20, 4
#: Texts of a bucket that are compared pair by pair; texts of a larger one that all others are first compared with.
PAIRWISE, CENTRES = 32, 4
#: Times that a bucket takes centres, each time twice as many, before texts unlike all of them meet by their rarest shingles.
ROUNDS = 3
#: Similarity to another's centre that a text has if it is a near copy of one of that centre's: Jaccard distances add up.
ZONE = 1 - 2 * (1 - ALIKE)

_RNG = np.random.default_rng(5)
_FLIP, _TIMES = (_RNG.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64) for _ in range(2))
_TIMES |= np.uint64(1)
_P, _Q = np.uint64(0x9E3779B185EBCA87), np.uint64(0xC2B2AE3D27D4EB4F)


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    """One hash for the values at each place of parts, in their order."""
    h = np.zeros_like(parts[0])
    for p in parts:
        h = h * _P + p
    h = (h ^ h >> np.uint64(32)) * _Q
    return h ^ h >> np.uint64(29)


def shingles(text: bytes, width: int = WIDTH) -> tuple[int, np.ndarray]:
    """A hash of the lower-cased words, and the distinct hashes of all runs of width of them. Fewer words are one run; none: no hashes."""
    hashed, whole = partial(xxhash.xxh64_intdigest, seed=42), xxhash.xxh64()
    found, tail = [], np.zeros(0, dtype=np.uint64)
    for words in word_runs(text.lower()):
        new = np.fromiter(map(hashed, words), dtype=np.uint64, count=len(words))
        whole.update(new.tobytes())
        tail = np.concatenate([tail, new])
        if (m := len(tail) - width + 1) > 0:
            found.append(_joined([tail[i : i + m] for i in range(width)]))
            tail = tail[m:]
    if not found and len(tail):
        found = [_joined([tail[i : i + 1] for i in range(len(tail))])]
    return whole.intdigest(), np.unique(np.concatenate(found)) if found else tail


def band_keys(of: np.ndarray) -> np.ndarray:
    """One key for each band, of the minima of ROWS permutations and the band's number; none without shingles."""
    if not len(of):
        return of
    least = np.full(BANDS * ROWS, (1 << 64) - 1, dtype=np.uint64)
    for at in range(0, len(of), 1 << 11):
        np.minimum(least, ((of[at : at + (1 << 11), None] ^ _FLIP) * _TIMES).min(axis=0), out=least)
    least = least.reshape(BANDS, ROWS)
    return _joined([np.arange(BANDS, dtype=np.uint64), *(least[:, i] for i in range(ROWS))])


def _signed(x: np.ndarray | int) -> np.ndarray:
    return np.asarray(x, dtype=np.uint64).view(np.int64)


def sketches(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, x and y (common.row_keys of the text), node (equal for equal words), n (distinct shingles), print (SimHash fingerprint of these) and keys of every row."""

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(node, len(of), fingerprint_of(of), _signed(band_keys(of))) for node, of in map(shingles, utf8(b.column(3)))]
            nodes, prints = (pa.array(_signed(np.array([x[i] for x in found], dtype=np.uint64))) for i in (0, 2))
            made = [nodes, pa.array([x[1] for x in found], pa.int64()), prints, pa.array([x[3] for x in found], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *made], names=["doc_id", "x", "y", "node", "n", "print", "keys"])

    x, y = row_keys(F.col(f"`{text}`"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), x.alias("x"), y.alias("y"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    return rows.mapInArrow(sketched, "doc_id long, x long, y long, node long, n long, print long, keys array<long>")


def _sets(texts: DataFrame) -> DataFrame:
    """node and its shingles, of rows of doc_id and text."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in utf8(b.column(1)):
                node, of = shingles(t)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_signed(np.array([node], dtype=np.uint64))), pa.array([_signed(of)], pa.list_(pa.int64()))], names=["node", "of"],
                )

    return texts.mapInArrow(found, "node long, of array<long>")


def _met(rows: DataFrame, name: str) -> DataFrame:
    """rows of buckets with more than one member, with their number."""
    sizes = stored(rows.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1"), f"{name}-sizes")
    return stored(rows.join(sizes, "key"), name)


def _near_in_size(x: str, y: str, alike: float = ALIKE) -> Column:
    """No pair whose sizes fail this has the similarity."""
    return F.least(x, y) >= alike * F.greatest(x, y) - 1e-6


def _pairs(few: DataFrame) -> DataFrame:
    """(a, b) of the members of small buckets."""
    x, y = few.select("key", F.col("node").alias("a"), F.col("n").alias("na")), few.select("key", F.col("node").alias("b"), F.col("n").alias("nb"))
    return x.join(y, "key").filter(F.col("a") < F.col("b")).filter(_near_in_size("na", "nb")).select("a", "b")


def _bit_pairs(one: DataFrame) -> DataFrame:
    """(a, b): texts whose fingerprints lie within RADIUS, as many as join all whose fingerprints such links join.

    one: node, n, print. Texts of one fingerprint meet the smallest of them, which stands for them in links to others.
    """
    prints = stored(one.groupBy("print").agg(F.min(F.struct("node", "n")).alias("first")), "near-prints")
    links = fingerprint_links(prints.select(F.col("print").alias("fingerprint")), RADIUS)
    x, y = (prints.select(F.col("print").alias(k), F.col("first").alias(f"of_{k}")) for k in ("a", "b"))
    across = links.join(x, "a").join(y, "b").select("of_a", "of_b")
    within = one.join(prints, "print").filter("node != first.node").select("first", F.struct("node", "n"))
    met = across.union(within).filter(_near_in_size("of_a.n", "of_b.n"))
    return met.select(F.least("of_a.node", "of_b.node").alias("a"), F.greatest("of_a.node", "of_b.node").alias("b"))


def _rare_pairs(members: DataFrame, by: list[str], sets: DataFrame, within: bool, name: str) -> DataFrame:
    """(a, b): members (by, node, side) of sides 0 and 1, and with within also two of side 0, that share one of their rarest shingles.

    Shingles are put in order by the number of members of the same by that have them. The first n - ceil(ALIKE n) + 1
    of n shingles are enough: whatever pair is ALIKE has one of them in common. A shingle that most members have comes
    last, so that texts that only share their commonplaces don't meet.
    """
    of = stored(members.join(sets, "node").select(*by, "side", "node", F.size("of").alias("n"), F.explode("of").alias("shingle")), f"{name}-shingles")
    often = of.groupBy(*by, "shingle").agg(F.count("*").alias("often"))
    place = F.row_number().over(Window.partitionBy(*by, "node").orderBy("often", "shingle"))
    rare = of.join(often, [*by, "shingle"]).withColumn("place", place).filter(F.col("place") <= F.col("n") - F.ceil(ALIKE * F.col("n") - 1e-6) + 1)
    rare = stored(rare.select(*by, "shingle", "side", "node", "n"), f"{name}-rare")
    x = rare.filter("side = 0").select(*by, "shingle", F.col("node").alias("a"), F.col("n").alias("na"))
    y = rare.select(*by, "shingle", "side", F.col("node").alias("b"), F.col("n").alias("nb"))
    wanted = (F.col("side") == 1) | (F.col("a") < F.col("b")) if within else F.col("side") == 1
    met = x.join(y, [*by, "shingle"]).filter(wanted & (F.col("a") != F.col("b")) & _near_in_size("na", "nb"))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _between(stars: DataFrame, links: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): pairs of texts that are each like a centre of their own and might link two centres' components.

    stars: key, node, centre, like (ALIKE, or else at least ZONE). If a and b are near copies, a is in the zone of
    b's centre and b in that of a's. Centres that are linked already need no such pair.
    """
    own = stars.filter("like").groupBy("key", "node").agg(F.min("centre").alias("own"))
    zone = stars.filter("not like").select("key", "node", F.col("centre").alias("other")).join(own, ["key", "node"]).select("own", "other", "node").distinct()
    zone = stored(zone, "near-zone")
    if zone.isEmpty():
        return links.limit(0)
    reached = components(links)
    x, y = (reached.select(F.col("node").alias(n), F.col("component").alias(f"{n}_in")) for n in ("own", "other"))
    apart = zone.join(x, "own").join(y, "other").filter("own_in != other_in")
    low = F.least("own", "other")
    apart = apart.select(low.alias("low"), F.greatest("own", "other").alias("high"), (F.col("own") != low).cast("int").alias("side"), "node").distinct()
    return _rare_pairs(stored(apart, "near-apart"), ["low", "high"], sets, False, "near-apart")


def near_links(found: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    """(a, b): nodes whose shingles have a Jaccard similarity of at least ALIKE, as many as join all nodes that such pairs join.

    Texts whose SimHash fingerprints lie within RADIUS meet (covering LSH, simhash.fingerprint_links). Near copies at ALIKE
    may lie further apart than fingerprints can be linked, so texts that share a MinHash band meet too, in its bucket. Buckets of up to PAIRWISE are compared pair by pair. Members of larger
    ones meet again where they share two bands that are both large. Of what is still large, a few members are centres
    that all others are compared with; those unlike every centre of their bucket take twice as many centres from among
    themselves. What is left after ROUNDS meets the members of its buckets by rarest shingles. Two texts like two
    centres that no link joins meet in the same way, if each is near enough to the other's centre to be a near copy of
    one of its texts. So no pair that joins two groups of a bucket is left out, and no bucket is compared pair by pair.
    """
    one = found.filter("n > 0").dropDuplicates(["node"])
    met = _met(one.select("node", "n", F.explode("keys").alias("key")), "near-buckets")
    large = met.filter(F.col("members") > PAIRWISE).groupBy("node", "n").agg(F.array_sort(F.collect_list("key")).alias("k"))
    twos = F.flatten(F.transform("k", lambda x, i: F.transform(F.slice(F.col("k"), i + 2, F.size("k")), lambda y: F.xxhash64(x, y))))
    again = _met(large.select("node", "n", F.explode(twos).alias("key")), "near-twos")
    few = F.col("members") <= PAIRWISE
    pairs = _pairs(met.filter(few)).union(_pairs(again.filter(few))).union(_bit_pairs(one.select("node", "n", "print")))
    pairs = stored(pairs.distinct(), "near-pairs")
    whole = stored(again.filter(~few).select("key", "node", "n"), "near-large")

    need = stored(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(whole.select("node")).distinct(), "near-need")
    ids = found.join(need, "node").groupBy("node").agg(F.min("doc_id").alias("id")).select("id").distinct()
    texts = texts_of(docs, text).join(ids, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
    sets = stored(_sets(texts).join(need, "node", "left_semi").dropDuplicates(["node"]), "near-sets")

    def verified(pairs: DataFrame, name: str, least: float = ALIKE) -> DataFrame:
        x, y = sets.select(F.col("node").alias("a"), F.col("of").alias("x")), sets.select(F.col("node").alias("b"), F.col("of").alias("y"))
        both = F.size(F.array_intersect("x", "y"))
        one = F.size("x") + F.size("y") - both
        return stored(pairs.join(x, "a").join(y, "b").filter(both >= least * one - 1e-6).select("a", "b", (both >= ALIKE * one - 1e-6).alias("like")), name)

    links, left, stars = verified(pairs, "near-links").select("a", "b"), whole, None
    for n in range(ROUNDS):
        if left.isEmpty():
            break
        place = F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64("node"), "node"))
        of = left.withColumn("place", place).filter(F.col("place") <= CENTRES << n).select("key", F.col("node").alias("centre"), F.col("n").alias("nc"))
        of = stored(of, f"near-centres-{n}")
        tried = stored(
            whole.join(of, "key").filter(F.col("node") != F.col("centre")).filter(_near_in_size("n", "nc", ZONE)).select(
                "key", "node", "centre", F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b"),
            ),
            f"near-tried-{n}",
        )
        new = verified(tried.select("a", "b").distinct(), f"near-stars-{n}", ZONE)
        star = stored(tried.join(new, ["a", "b"]).select("key", "node", "centre", "like"), f"near-star-{n}")
        done = star.filter("like").select("key", "node").union(of.select("key", F.col("centre").alias("node"))).distinct()
        left = stored(left.join(done, ["key", "node"], "left_anti"), f"near-left-{n}")
        links, stars = links.union(new.filter("like").select("a", "b")), star if stars is None else stars.union(star)
    if not left.isEmpty():
        rest = whole.join(left.select("key").distinct(), "key", "left_semi").join(left.select("node", F.lit(0).alias("side")).distinct(), "node", "left")
        rest = rest.select("node", F.coalesce("side", F.lit(1)).alias("side")).distinct()
        links = links.union(verified(_rare_pairs(rest, [], sets, True, "near-rest"), "near-rest-links").select("a", "b"))
    if stars is not None:
        links = stored(links.distinct(), "near-joined")
        links = links.union(verified(_between(stars, links, sets), "near-between").select("a", "b"))
    return links.distinct()


def near_rows(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, x, y, and the component of near copies that each row's text belongs to.

    Texts with equal words are one node, also those without words, which are like no others. No documents: no rows.
    """
    found = stored(sketches(docs, text), "near-sketches")
    reached = components(near_links(found, docs, text))
    return found.join(reached, "node", "left").select("doc_id", "x", "y", F.coalesce("component", "node").alias("component"))


def near_groups(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and component_id, the smallest doc_id reachable over near copies, of every row.

    A null doc_id belongs to its text's component and never names it unless all of them are null.
    """
    rows = near_rows(docs, text)
    least = rows.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return rows.join(least, "component").select("doc_id", "component_id")
