"""The near-copy stage against all pairs of five-word Jaccard similarities."""

from __future__ import annotations

import random

import corpus_pipeline as cp
import pytest
from conftest import DOCS, sentence
from test_llm_operators import linked, plain_simhash

from scenewright.llm import near_copies


def plain_shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_groups(texts):
    """The smallest id that each id reaches over equal texts and Jaccard similarities of 0.8 or more."""
    of = {i: plain_shingles(t) for i, t in texts.items()}
    to, empty = {i: i for i in of}, [i for i in of if not of[i]]
    to |= {i: empty[0] for i in empty}

    def top(i):
        while to[i] != i:
            i = to[i]
        return i

    for a in of:
        for b in of:
            if a < b and of[a] | of[b] and 5 * len(of[a] & of[b]) >= 4 * len(of[a] | of[b]):
                x, y = sorted((top(a), top(b)))
                to[y] = x
    return {i: top(i) for i in of}


def edited(rng, words, n):
    words = list(words)
    for i in rng.sample(range(len(words)), n):
        words[i] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def copies():
    rng = random.Random(11)
    texts = {}
    for i in range(0, 200, 4):
        words = "".join(sentence(rng, 12) for _ in range(10)).split()
        texts |= {i + k: edited(rng, words, n) for k, n in enumerate((0, 1, 2, 3))}
    texts |= {200: "only four words here", 201: "Only  four words\nhere", 202: "only four words there"}
    return texts


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in texts.items()], DOCS).repartition(3)


def test_edited_copies_beyond_two_bits_go(spark, copies):
    want = plain_groups(copies)
    bits = linked({i: plain_simhash(t) for i, t in copies.items()}, 2)
    assert len(set(want.values())) < len(set(bits.values()))
    kept = sorted(r["doc_id"] for r in dict(cp.STAGES)["near_copies"](spark, frame(spark, copies), "").collect())
    assert kept == sorted(set(want.values()))


def test_fingerprints_alone_find_what_lies_within_two_bits(spark, monkeypatch, copies):
    """Without any band, near copies whose fingerprints are linked still meet; the stage's SimHash step is there."""
    monkeypatch.setattr(near_copies, "band_keys", lambda of: of[:0])
    texts = {i: t for i, t in copies.items() if i < 40}
    texts |= {300 + i: t + " at" for i, t in texts.items()}
    prints = {i: near_copies.fingerprint_of(near_copies.shingles(t.encode())[1]) for i, t in texts.items()}
    near = {
        (i, j) for i in texts for j in texts if i < j and (prints[i] ^ prints[j]).bit_count() <= 2
        and 5 * len(plain_shingles(texts[i]) & plain_shingles(texts[j])) >= 4 * len(plain_shingles(texts[i]) | plain_shingles(texts[j]))
    }
    got = {r["doc_id"]: r["component_id"] for r in near_copies.near_groups(frame(spark, texts)).collect()}
    assert near_copies.sketches(frame(spark, texts)).filter("size(keys) > 0").isEmpty()
    assert len(near) >= 10 and all(got[i] == got[j] for i, j in near)


def test_equal_fingerprints_are_no_proof(spark, monkeypatch, copies):
    """Texts of one fingerprint are compared like any others."""
    monkeypatch.setattr(near_copies, "fingerprint_of", lambda of: 5)
    got = {r["doc_id"]: r["component_id"] for r in near_copies.near_groups(frame(spark, copies)).collect()}
    assert got == plain_groups(copies)


@pytest.mark.parametrize("pairwise", [2, 8])
def test_large_buckets(spark, monkeypatch, pairwise):
    """A group of near copies and one of texts that share half their words and are no copies, both above the bound."""
    monkeypatch.setattr(near_copies, "PAIRWISE", pairwise)
    rng = random.Random(5)
    words, passage = "".join(sentence(rng, 12) for _ in range(10)).split(), sentence(rng, 60)
    texts = {i: edited(rng, words, 1) for i in range(40)}
    texts |= {40 + i: passage + sentence(rng, 50) for i in range(40)}
    got = {r["doc_id"]: r["component_id"] for r in near_copies.near_groups(frame(spark, texts)).collect()}
    assert got == plain_groups(texts)


def chained(rng, groups, length=200, step=24):
    """Groups of near copies around centres that are not alike, with one pair between each two of them that alone joins them."""
    words = [f"w{rng.randrange(10**7)}" for _ in range(length)]
    texts, k = {}, 0
    for g in range(groups):
        for _ in range(30):
            texts[k] = edited(rng, words, 1)
            k += 1
        for part in (2, 1):  # half of the way to the next centre: one of this group, one of the next
            moved = list(words)
            moved[: step // part] = [f"g{g}x{i}" for i in range(step // part)]
            texts[k] = " ".join(moved)
            k += 1
        words = moved
    return texts


@pytest.mark.parametrize(("pairwise", "rounds"), [(2, 3), (2, 0)])
def test_a_pair_between_two_unlike_centres_joins_them(spark, monkeypatch, pairwise, rounds):
    """Buckets above the bound in which centres are unlike each other; with no round of centres all meet by rarest shingles."""
    monkeypatch.setattr(near_copies, "PAIRWISE", pairwise)
    monkeypatch.setattr(near_copies, "ROUNDS", rounds)
    monkeypatch.setattr(near_copies, "CENTRES", 1)
    texts = chained(random.Random(3), 4)
    want = plain_groups(texts)
    got = {r["doc_id"]: r["component_id"] for r in near_copies.near_groups(frame(spark, texts)).collect()}
    assert got == want and len(set(want.values())) < 4


def test_rare_shingles_find_every_near_pair_and_few_others(spark):
    """Texts that share half their words with all others; near copies among them."""
    rng = random.Random(8)
    common = [f"c{i}" for i in range(60)]
    sets = {}
    for g in range(40):
        own = [f"o{g}_{i}" for i in range(60)]
        for k in range(3):
            changed = own[:]
            changed[: 3 * k] = [f"x{g}_{k}_{i}" for i in range(3 * k)]
            sets[3 * g + k] = set(common + changed)
    ids = {w: i for i, w in enumerate(sorted(set().union(*sets.values())))}
    table = spark.createDataFrame([(n, sorted(ids[w] for w in s)) for n, s in sets.items()], "node long, of array<long>")
    sides = spark.createDataFrame([(n, n % 2) for n in sets], "node long, side int")
    met = {tuple(r) for r in near_copies._rare_pairs(sides, [], table, True, "test").collect()}
    near = {(a, b) for a in sets for b in sets if a < b and not (a % 2 and b % 2) and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert near <= met and len(met) < 2 * 120


def test_stage_on_odd_rows(spark, docs, rows, odd, none):
    stage = dict(cp.STAGES)["near_copies"]
    want = plain_groups({d: t for d, t, *_ in rows})
    assert sorted(r["doc_id"] for r in stage(spark, docs, "").collect()) == sorted(set(want.values()))
    assert stage(spark, none, "").count() == 0
    out = stage(spark, odd, "")
    assert out.count() == 4 and out.columns == odd.columns  # the two equal rows are one; rows of one id or of none stay apart
