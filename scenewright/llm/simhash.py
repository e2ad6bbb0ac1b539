"""SimHash fingerprints, linked through covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scenewright.llm.common import documents, stored, texts_of, utf8, word_runs
from scenewright.llm.components import components

BITS = 64
#: Distinct fingerprints of a bucket that are compared pair by pair; the rest of the buckets go to masked keys.
PAIRWISE = 32


def _bit_counts(h: np.ndarray) -> np.ndarray:
    """How often each bit is set in unsigned 64-bit hashes."""
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(h), 1 << 15):
        bits = np.unpackbits(h[at : at + (1 << 15)].view(np.uint8), bitorder="little").reshape(-1, BITS)
        counts += bits.sum(axis=0, dtype=np.uint32)
    return counts


def majority(counts: np.ndarray, n: int) -> int:
    """The fingerprint: bit b is set if it is set in over half of n hashes."""
    return int(sum(1 << int(b) for b in np.flatnonzero(2 * counts > n)))


def fingerprint_of(h: np.ndarray) -> int:
    """The fingerprint of hashes that are there already; of none: zero."""
    return majority(_bit_counts(h), len(h))


def _hash_counts(runs: Iterator[list[bytes]], width: int) -> tuple[np.ndarray, int]:
    """How often each bit is set in the hashes of all shingles, and the number of shingles."""
    hashed = partial(xxhash.xxh64_intdigest, seed=42)
    counts, n, tail = np.zeros(BITS, dtype=np.int64), 0, []
    for words in runs:
        words = tail + words
        if len(words) >= width:
            m = len(words) - width + 1
            shingles = map(b" ".join, zip(*(words[i : i + m] for i in range(width)), strict=True))
            h = np.fromiter(map(hashed, shingles), dtype=np.uint64, count=m)
            counts += _bit_counts(h)
            n += m
        tail = words[-(width - 1) :] if width > 1 else []
    if not n and tail:
        h = np.array([hashed(b" ".join(tail))], dtype=np.uint64)
        counts, n = counts + _bit_counts(h), 1
    return counts, n


def fingerprint(text: bytes, width: int) -> int:
    """Bit b is set if it is set in over half of the XXH64 (seed 42) of all shingles of width lower-cased words,
    repeats included. Fewer words than width are one shingle; no words: zero."""
    counts, n = _hash_counts(word_runs(text.lower()), width)
    return majority(counts, n)


def fingerprints(docs: DataFrame, width: int = 3, text: str = "text") -> DataFrame:
    """doc_id and fingerprint (a long, the 64 bits as a signed number) of every row."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, width) for t in utf8(batch.column(1))], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["doc_id", "fingerprint"])

    return texts_of(docs, text).mapInArrow(hashed, "doc_id long, fingerprint long")


def covering_masks(radius: int, bits: int = BITS) -> list[int]:
    """Masks of covering LSH: bit i carries a nonzero vector of radius + 1 bits, and mask v keeps the bits whose
    vector has an odd product with v. Any radius differing bits have a v orthogonal to all their vectors, so a pair
    within the radius agrees on that whole mask."""
    top = 1 << (radius + 1)
    vectors = [1 + i % (top - 1) for i in range(bits)]
    return [sum(1 << i for i, x in enumerate(vectors) if (x & v).bit_count() & 1) for v in range(1, top)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _masks(values: list[int]) -> Column:
    return F.array(*[F.lit(_signed(v)).cast("long") for v in values])


def fingerprint_links(prints: DataFrame, radius: int = 2) -> DataFrame:
    """(a, b): enough links between distinct fingerprints within radius to connect all that are connected.

    prints: distinct longs in column fingerprint. A fingerprint meets others in 2^(radius+1) - 1 tables, keyed by
    what a mask keeps. Buckets of up to PAIRWISE are compared pair by pair. In larger ones two members may differ
    in at most radius of the bits outside the mask: each member gives one key for every choice of radius such bits,
    blanked out; all that share a key are within the radius of each other and are linked to the smallest. Rows thus
    grow with the members of a bucket, never with their pairs, and no link that matters is lost.
    """
    masks = covering_masks(radius)
    tables = prints.select("fingerprint", F.posexplode(_masks(masks)).alias("t", "mask")).select(
        "fingerprint", "t", F.col("fingerprint").bitwiseAND(F.col("mask")).alias("key"),
    )
    sizes = tables.groupBy("t", "key").agg(F.count("*").alias("n")).filter("n > 1")
    met = stored(tables.join(sizes, ["t", "key"]), "simhash-buckets")
    few = met.filter(F.col("n") <= PAIRWISE)
    pairs = few.alias("x").join(
        few.alias("y"),
        (F.col("x.t") == F.col("y.t")) & (F.col("x.key") == F.col("y.key")) & (F.col("x.fingerprint") < F.col("y.fingerprint")) & (
            F.bit_count(F.col("x.fingerprint").bitwiseXOR(F.col("y.fingerprint"))) <= radius
        ),
    )
    pairs = pairs.select(F.col("x.fingerprint").alias("a"), F.col("y.fingerprint").alias("b"))
    many = met.filter(F.col("n") > PAIRWISE)
    blanks = F.array(*[_masks(_choices(~m & (1 << BITS) - 1, radius)) for m in masks])
    keyed = many.select("fingerprint", "t", F.explode(F.get(blanks, F.col("t"))).alias("blank")).select(
        "fingerprint", "t", "blank", F.col("fingerprint").bitwiseAND(F.bitwise_not("blank")).alias("rest"),
    )
    # "blank" and "rest" name the table as well: the same choice of bits in another table links the same fingerprints.
    groups = keyed.groupBy("blank", "rest").agg(F.min("fingerprint").alias("a"), F.collect_set("fingerprint").alias("all")).filter(F.size("all") > 1)
    stars = groups.select("a", F.explode("all").alias("b")).filter("a != b")
    return pairs.union(stars).distinct()


def _choices(outside: int, radius: int) -> list[int]:
    """Every choice of radius bits of outside; of all bits if they are fewer."""
    from itertools import combinations

    bits = [1 << i for i in range(BITS) if outside >> i & 1]
    return [sum(c) for c in combinations(bits, min(radius, len(bits)))]


def simhash_groups(docs: DataFrame, width: int = 3, radius: int = 2, text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id reachable over links, of every row.

    Null and empty texts have fingerprint zero, which links like any other. Rows with the same doc_id each keep a
    row; a null doc_id belongs to its fingerprint's component and never names it unless all of them are null. No
    documents: no rows. Equal fingerprints are one node, so copies cost one row per document and no links.
    """
    found = stored(fingerprints(docs, width, text), "simhash")
    nodes = found.groupBy("fingerprint").agg(F.min("doc_id").alias("first"))
    reached = components(fingerprint_links(nodes.select("fingerprint"), radius)).withColumnRenamed("node", "fingerprint")
    named = nodes.join(reached, "fingerprint", "left").withColumn("component", F.coalesce("component", "fingerprint"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    of = named.join(least, "component").select("fingerprint", "component_id")
    return found.join(of, "fingerprint").select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(documents(spark, sf_dir))
