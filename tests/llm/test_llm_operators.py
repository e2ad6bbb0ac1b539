"""Each operator against a plain version of itself, an exact round trip, or held-out accuracy."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from scenewright.llm import cotraining, hmm, line_dedup, media, merkle, mixing, packing, simhash, suffix_dedup, token_store
from scenewright.llm.scripts import nested_class, plain_class, taken

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def encoded(rows, name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return {r[0]: t.encode(r[1] or "", add_special_tokens=False).ids for r in rows}


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


# --- 1: quality classifier ---


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(4)
    plain = [f"word{i}" for i in range(60)]
    rows = []
    for i in range(1200):
        kind = i % 4  # three good ones, one bad: half of the bad ones by words, half by layout
        words = list(rng.choice(plain, 40))
        bad = kind == 3
        if bad and i % 8 == 3:
            words[:4] = ["awful", "trashy", "awfulness", "trashier"]
        rows.append((i, (" | " if bad and i % 8 == 7 else " ").join(words), "en", "s", int(not bad)))
    docs = spark.createDataFrame([(*r[:4], len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return docs, spark.createDataFrame([(r[0], r[4], 0) for r in rows if r[0] % 10 < 7], "doc_id long, quality int, toxic int"), {r[0]: r[4] for r in rows}


def test_classifier_on_held_out_documents(labelled):
    docs, labels, truth = labelled
    scored = cotraining.score(docs, cotraining.fit(docs, labels)).collect()
    unseen = [r for r in scored if r["doc_id"] % 10 >= 7]
    right = sum(r["quality_keep"] == bool(truth[r["doc_id"]]) for r in unseen)
    assert len(scored) == 1200 and right / len(unseen) > 0.95
    assert all(0 <= r["quality_score"] <= 1 for r in scored)


def test_scores_equal_those_by_hand(docs, rows, labelled):
    """Each document's features, sums and curves, one word and one mark at a time."""
    model = cotraining.fit(*labelled[:2])
    weights, marks = model.weights(), "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
    number = lambda x, bits: zlib.crc32(x) & (1 << bits) - 1
    curve = lambda x: 1 / (1 + math.exp(-x))
    clip = lambda x: max(-12.0, min(12.0, x))
    got = {r["doc_id"]: r for r in cotraining.score(docs, model).collect()}
    for d, t, lang, source, *_ in rows:
        text = (t or "").encode()
        seen = text.lower().split()
        words = {w.strip(marks.encode()) or w for w in seen}
        features = {number(x, 22) for w in words for x in [w] + [b" " + w[:k] for k in (5, 7) if len(w) > k]}
        n, lines = len(text) or 1, text.count(b"\n") + 1
        share = lambda which, text=text, n=n: min(40, int(sum(chr(b) in which for b in text) / n * 40))
        layout = {
            "source": source,
            "lang": lang,
            "bytes": int(math.log2(n) * 2),
            "lines": int(math.log2(lines) * 2),
            "line": int(math.log2(len(seen) / lines + 1) * 2),
            "word": min(20, int(n / (len(seen) + 1) / 40 * 20)),
            "capitals": share("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "digits": share("0123456789"), "marks": share(marks), "distinct": min(
                20, int(len(words) / (len(seen) or 1) * 20),
            ), **{m: share(m) for m in marks},
        }
        first = model.bias + sum(weights.get(i, 0.0) for i in features)
        second = model.meta_bias + sum(model.meta[number(f"{k}={v}".encode(), 12)] for k, v in layout.items())
        a, b = (clip(c[0] * x + c[1]) for c, x in zip(model.curves, (first, second), strict=True))
        both = curve(model.mix[0] * a + model.mix[1] * b + model.mix[2])
        r = got[d]
        assert (r["content_score"], r["metadata_score"], r["quality_score"]) == pytest.approx((curve(a), curve(b), both))
        assert r["quality_keep"] == (both >= cotraining.THRESHOLD)


def test_classifier_is_the_same_again(labelled):
    docs, labels, _ = labelled
    a, b = ({r["doc_id"]: r["quality_score"] for r in cotraining.score(d, cotraining.fit(d, labels)).collect()} for d in (docs, docs.repartition(7)))
    assert a == b


def test_classifier_without_labels_keeps_all(docs, none, odd, labelled):
    labels = labelled[1]
    for d in (docs, odd):
        out = cotraining.score(d, cotraining.fit(d, labels.limit(0)))
        assert out.filter("quality_keep").count() == d.count() and set(d.columns) <= set(out.columns)
    model = cotraining.fit(labelled[0], labels)
    assert cotraining.score(none, model).count() == 0
    assert cotraining.score(odd, model).count() == 5
    assert cotraining.score(odd.drop("lang", "source"), model).count() == 5


# --- 2: packing ---


def test_packing(spark, docs, rows):
    path = public_tokenizers.path("word_bpe_49k.json")
    want = {d: [*ids, 1] for d, ids in encoded(rows, "word_bpe_49k.json").items()}
    got = packing.pack_documents(docs, path).collect()
    by = defaultdict(list)
    for r in got:
        ids = want[r["doc_id"]]
        assert (r["start"], r["length"]) == (4096 * r["piece"], min(4096, len(ids) - r["start"]))
        assert r["ids_crc32"] == crc(ids[r["start"] : r["start"] + r["length"]])
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sum(r["length"] for r in got) == sum(map(len, want.values()))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(by) == math.ceil(sum(map(len, want.values())) / 4096)


def test_sum_of_squares_rule():
    """Bins are chosen as by trying every open gap."""
    rng, capacity = np.random.default_rng(1), 32
    lengths = rng.integers(1, capacity + 1, 400)
    place, offset = packing.pack_group(lengths, capacity)
    gaps, counts = {}, Counter()
    for s, b, o in zip(lengths.tolist(), place.tolist(), offset.tolist(), strict=True):
        def cost(gap):
            new = counts.copy()
            if gap < capacity:
                new[gap] -= 1
            if gap > s:
                new[gap - s] += 1
            return sum(new[g] ** 2 for g in range(1, capacity))

        options = [g for g in range(s, capacity) if counts[g]] or [capacity]
        gap = gaps.get(b, capacity)
        assert gap == capacity - o and cost(gap) == min(map(cost, options))
        if gap < capacity:
            counts[gap] -= 1
        gaps[b] = gap - s
        if gap > s:
            counts[gap - s] += 1


def test_as_few_sequences_as_best_fit_takes():
    rng, capacity = np.random.default_rng(6), 512
    for _ in range(5):
        lengths = np.sort(np.minimum(rng.geometric(0.01, 1500), capacity))[::-1]
        gaps, opened = [], 0
        for s in lengths.tolist():
            fit = min((g for g in gaps if g >= s), default=None)
            if fit is None:
                opened, fit = opened + 1, capacity
            else:
                gaps.remove(fit)
            gaps.append(fit - s)
        assert packing.pack_group(lengths, capacity)[0].max() + 1 <= opened


def test_packing_edges(none, odd):
    path = public_tokenizers.path("word_bpe_49k.json")
    assert packing.pack_documents(none, path).count() == 0
    assert packing.pack_documents(odd, path).count() == 5


# --- 3: media ---


def plain_hash(payload, width=192):
    """The low-frequency cosine hash by its sums, one coefficient at a time."""
    image = [payload[i : i + width] for i in range(0, len(payload), width)]
    side, low, h = media.SIDE, media.LOW, len(image)

    def bands(n):
        return [range(min(i * n // side, n - 1), max((i + 1) * n // side, min(i * n // side, n - 1) + 1)) for i in range(side)]

    small = [[sum(image[y][x] for y in ys for x in xs) / (len(ys) * len(xs)) for xs in bands(width)] for ys in bands(h)]
    wave = [[math.cos(math.pi * k * (2 * x + 1) / (2 * side)) for x in range(side)] for k in range(low)]
    found = [round(sum(wave[a][y] * wave[b][x] * small[y][x] for y in range(side) for x in range(side)), 6) for a in range(low) for b in range(low)]
    middle = sorted(found[1:])
    n = len(middle)
    median = middle[n // 2] if n % 2 else (middle[n // 2 - 1] + middle[n // 2]) / 2
    return f"{int(''.join('1' if f > median else '0' for f in found), 2):0{low * low // 4}x}"


def test_media_columns(docs, rows, none, odd):
    stored = media.store_texts(docs)
    kept = {r["doc_id"]: r["media"] for r in stored.collect()}
    got = {r["doc_id"]: r for r in media.media_features(stored).collect()}
    for d, text, *_ in rows:
        data = (text or "").encode()
        padded = data + b" " * (-len(data) % 192) if data else b" " * 192
        r = got[d]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (
            len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]),
        )
        assert len(r["feature"]) == 16 and r["feature"] == plain_hash(padded)
        media_of = bytes(kept[d])
        assert (r["media_bytes"], r["media_sha256"]) == (len(media_of), hashlib.sha256(media_of).hexdigest())
        assert media.decode_png(media_of).tobytes() == padded
    assert got[3]["media_sha256"] == got[20]["media_sha256"] and got[3]["feature"] == got[20]["feature"]
    assert media.media_features(media.store_texts(none)).count() == 0 and media.media_features(media.store_texts(odd)).count() == 5


def test_png_filters_and_checksums():
    rng = np.random.default_rng(2)
    for shape in ((1, 1), (7, 5), (40, 192)):
        image = rng.integers(0, 256, shape, dtype=np.uint8)
        data = media.encode_png(image)
        assert (media.decode_png(data) == image).all()
        for at in (20, len(data) // 2, len(data) - 3):
            broken = bytearray(data)
            broken[at] ^= 1
            with pytest.raises((ValueError, zlib.error)):
                media.decode_png(bytes(broken))
    # all five row filters, colour
    image = rng.integers(0, 256, (10, 6, 3), dtype=np.uint8)
    raw = bytearray()
    flat = image.reshape(10, 18).astype(int)
    for y in range(10):
        kind, line = y % 5, flat[y]
        up = flat[y - 1] if y else np.zeros(18, int)
        left = np.concatenate([np.zeros(3, int), line[:-3]])
        corner = np.concatenate([np.zeros(3, int), up[:-3]])
        p = left + up - corner
        d = np.abs(np.stack([p - left, p - up, p - corner]))
        paeth = np.where((d[0] <= d[1]) & (d[0] <= d[2]), left, np.where(d[1] <= d[2], up, corner))
        raw += bytes([kind]) + ((line - (0, left, up, (left + up) // 2, paeth)[kind]) % 256).astype(np.uint8).tobytes()
    import struct

    png = media.SIGNATURE + media._chunk(
        b"IHDR", struct.pack(">IIBBBBB", 6, 10, 8, 2, 0, 0, 0),
    ) + media._chunk(b"IDAT", zlib.compress(bytes(raw))) + media._chunk(b"IEND", b"")
    assert (media.decode_png(png) == image).all()


def test_cosine_hash_of_like_images_is_near():
    a = np.kron(np.random.default_rng(5).integers(20, 230, (8, 8)), np.ones((8, 8))).astype(np.uint8)
    near = np.clip(a.astype(int) + np.random.default_rng(0).integers(-4, 5, a.shape), 0, 255).astype(np.uint8)
    far = np.random.default_rng(1).integers(0, 256, a.shape, dtype=np.uint8)
    bits = lambda p, q: (int.from_bytes(media.cosine_hash(p), "big") ^ int.from_bytes(media.cosine_hash(q), "big")).bit_count()
    assert bits(a, near) <= 8 < bits(a, far)


# --- 4: Merkle fingerprints ---


def plain_leaves(text):
    """Cuts found one character at a time."""
    before = {*"ACEGIKMOQSUWYacegikmoqsuwy02468"}
    out, at = [], 0
    while at < len(text):
        end = min(at + merkle.MOST, len(text))
        for i in range(at, end):
            j = i + 1
            if text[i] in before and j < len(text) and text[j] in " \t\r\n":
                while j < len(text) and text[j] in " \t\r\n":
                    j += 1
            elif text[i] in ".!?\n\u3002":
                while j < len(text) and text[j] in ".!?\n\u3002":
                    j += 1
                while j < len(text) and text[j] == " ":
                    j += 1
            elif not taken(ord(text[i])):
                continue
            end = j
            break
        out.append(text[at:end])
        at = end
    return out


def plain_merkle(text):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    digests = [sha(p)[:32] for p in plain_leaves(text)]
    sections, now = [], []
    for d in digests:
        now.append(d)
        if d[0] == "0":
            sections.append((now, ";"))
            now = []
    if now:
        sections.append((now, ""))
    of = [sha("".join(d + "," for d in s) if not end else ",".join(s)) for s, end in sections]
    return sha("".join(of)) + ":" + ";".join(x[:8] + "=" + "".join(d[:6] for d in s) for x, (s, _) in zip(of, sections, strict=True))


def plain_likeness(a, b):
    if a.split(":")[0] == b.split(":")[0]:
        return 1.0
    of_a, of_b = ({s for s in x.split(":")[1].split(";") if s} for x in (a, b))
    cut = lambda ss: {s[i : i + 6] for s in ss for i in range(9, len(s), 6)}
    both, left, right = sum((len(s) - 9) // 6 for s in of_a & of_b), cut(of_a - of_b), cut(of_b - of_a)
    return 2 * (both + len(left & right)) / (2 * both + len(left) + len(right) + 1)


def test_merkle(docs, rows):
    got = {r["doc_id"]: r for r in merkle.fingerprint_edits(docs, buckets=5).collect()}
    texts = [t or "" for _, t, *_ in rows]
    for i, text in enumerate(texts):
        nxt = texts[(i + 1) % len(texts)]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + nxt[:cut]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r["fingerprint"] == plain_merkle(text) and r["edited_fingerprint"] == plain_merkle(edited)
        assert r["near_edited"] == pytest.approx(plain_likeness(plain_merkle(text), plain_merkle(edited)))
        assert r["near_next"] == pytest.approx(plain_likeness(plain_merkle(text), plain_merkle(nxt)))
        assert 0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1
        assert (r["near_edited"] == 1.0) == (edited == text)
    assert got[3]["fingerprint"] == got[20]["fingerprint"] != got[7]["fingerprint"]
    long = [r for r in got.values() if r["n_chars"] > 400 and len(texts[r["doc_id"]].split()) > 50]
    assert np.mean([r["near_edited"] for r in long]) > 0.6 > 0.2 > np.mean([r["near_next"] for r in long])


def differing(spark, a, b):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    df = merkle.with_fingerprint(merkle.with_fingerprint(df, "a", "fa"), "b", "fb")
    near = merkle.likeness(F.col("fa"), F.col("fb"), merkle.sections_of(F.col("fa")), merkle.sections_of(F.col("fb")))
    return df.select(merkle.changed_paragraphs(F.col("fa"), F.col("fb")).alias("c"), near.alias("near")).first()


def test_merkle_locates_edits(spark):
    a = "".join(f"Sentence number {i} stands here. " for i in range(40))
    b = a.replace("number 17", "number 71")
    assert differing(spark, a, b)["c"] == [i for i, p in enumerate(plain_leaves(a)) if p not in plain_leaves(b)] != []


def test_merkle_insertions_change_few_paragraphs(spark):
    """Also in front of a text without any mark."""
    rng = np.random.default_rng(8)
    words = " ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(1, 9))) for _ in range(400))
    for b in ("x" + words, words[:900] + "new words " + words[900:], "quite another beginning " + words):
        got = differing(spark, words, b)
        assert len(got["c"]) <= 4 and got["near"] > 0.95
    kanji = "".join(chr(int(c)) for c in rng.integers(0x4E00, 0x9F00, 800))
    assert differing(spark, kanji, "\u4e00\u4e8c" + kanji)["near"] > 0.9


def test_merkle_keeps_what_an_edit_leaves_alone(spark):
    """Texts of 200 to 500 characters whose last quarter is replaced, whatever follows, also by nothing."""
    rng = np.random.default_rng(9)
    made = [
        (
            f"{i}",
            " ".join(
                "".join(rng.choice(list("aeinorstlmdcbg"), rng.integers(2, 9))) + str(rng.choice(["", "", ".", ","])) for _ in range(90)
            )[: int(rng.integers(200, 501))],
        ) for i in range(60)
    ]
    rows = [(2 * i, t) for i, (_, t) in enumerate(made)] + [(2 * i + 1, ["", "short one", made[(i * 7) % 60][1]][i % 3]) for i in range(60)]
    got = merkle.fingerprint_edits(spark.createDataFrame(rows, "doc_id long, text string")).filter("doc_id % 2 = 0").collect()
    assert min(r["near_edited"] for r in got) > 0.5


def test_merkle_edges(none, odd):
    assert merkle.fingerprint_edits(none).count() == 0 and merkle.fingerprint_edits(odd).count() == 5


# --- 5: lines ---


def plain_split(text):
    """Lines, and lines without the white space after them, found one character at a time."""
    blank, ends, out, i = " \t\r\n", ".!?\n\u3002KQXZkqxz", [], 0
    while i < len(text):
        j = i
        while j < len(text) and text[j] not in ends and not taken(ord(text[j])):
            j += 1
        while j < len(text) and (text[j] in ends or taken(ord(text[j]))):
            j += 1
        k = j
        while k < len(text) and text[k] in blank:
            k += 1
        out.append((text[i:k], text[i:j]))
        i = k
    return out


def plain_lines(rows):
    """Each document's text without what winnowing finds, one window, place and line at a time. Rows have different ids."""
    lines = {d: [x for x, _ in plain_split(t or "")] for d, t, *_ in rows}
    key = {d: [int(hashlib.md5(x.encode()).hexdigest()[:15], 16) for _, x in plain_split(t or "")] for d, t, *_ in rows}
    first, chosen = {}, defaultdict(list)
    for d in sorted(key):
        h = key[d]
        grams = len(h) - 1
        for s in range(max(grams - 3, 0) + 1 if grams > 0 else 0):
            at = min(range(s, min(s + 3, grams)), key=lambda g: (h[g], g))
            if at not in chosen[d]:
                chosen[d].append(at)
                first.setdefault((h[at], h[at + 1]), (d, at))
    out = {}
    for d, ls in lines.items():
        h, gone = key[d], set()
        for p in chosen[d]:
            e, q = first[h[p], h[p + 1]]
            if (e, q) >= (d, p):
                continue
            a, b = 0, 1
            while a > -2 and p + a > 0 and q + a > 0 and h[p + a - 1] == key[e][q + a - 1]:
                a -= 1
            while b < 3 and p + b + 1 < len(h) and q + b + 1 < len(key[e]) and h[p + b + 1] == key[e][q + b + 1]:
                b += 1
            gone.update(range(p + a, p + b + 1))
        kept, run = [], []
        for i in range(len(ls) + 1):
            if i in gone:
                run.append(ls[i])
                continue
            if len("".join(run).split()) < 24:
                kept += run
            run = []
            kept += ls[i : i + 1]
        out[d] = "".join(kept)
    return out


def test_lines_are_cut_as_by_hand(spark, rows):
    texts = [t for _, t, *_ in rows if t] + ["a\rb\r\nc", " lead", "\n\n x\n", "w " * 35, "h i", "tail\n", "one. two! three? four", "\u3002\u3002 x"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", line_dedup._lines(F.col("t")).alias("ls")).collect()
    for r in got:
        assert r["ls"] == [x for x, _ in plain_split(texts[r["i"]])]


def test_line_dedup(docs, rows):
    want = plain_lines(rows)
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs).collect()}
    assert {d: r["text"] or "" for d, r in got.items()} == want
    assert got[20]["text"] == "" and got[17]["n_removed"] >= 4 and got[5]["n_removed"] == 0 and got[60]["text"] is None


def test_shared_passages_go_however_they_are_punctuated(spark):
    """Of passages of 60 words in one to five sentences, each joined to other words, little but the ends is left."""
    rng = np.random.default_rng(12)
    word = lambda: "".join(rng.choice(list("aeioulnrstdhkm"), rng.integers(2, 8)))
    rows, left, words = [], 0, 0
    for k in range(40):
        passage = [word() for _ in range(60)]
        for i in range(1, k % 5 + 1):
            passage[i * 12] += "."
        for d in (k, 100 + k):
            rows.append((d, " ".join([word() for _ in range(30)] + passage + [word() for _ in range(30)])))
    rows.append((500, " ".join(word() for _ in range(3000))))
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain_lines(rows) and got[500] == rows[-1][1]
    for d, text in rows[1:-1:2]:
        assert got[d - 100] == dict(rows)[d - 100]
        words += 60
        left += len(got[d].split()) - 60
    assert left / words < 0.25


#: Letters of running text, most frequent first.
SCRIPTS = {
    "latin": "etaoinshrdlucmfwypvbgkjqxz",
    "cyrillic": "оеаинтсрвлкмдпуяыьгзбчйхжшюцщэф",
    "greek": "αοιετσνηυρπκμλςωδγχθφβξζψ",
    "arabic": "اليمنورتبةعدسفهكقحجشصطخضزذثغظ",
    "devanagari": "रकनतसमहयपलवदजबगचशथखधभटडफठछझघषण",
    "thai": "นรอกเงมลวายสดทตบคปหขพจใชถซผธไณฉ",
    "hebrew": "יהולאתמבשרנדחפעקכטגצסזךםןףץ",
    "georgian": "აიერსმნდობლვთგუხკცშზპტქყჩფღწჭჯჟძ",
    "kana": "のいにはをしてとたがでなるかもれさこらりきつすあまおけう",
}


def written(rng, letters, n, mark=""):
    """n words of a script, the letters drawn as they occur, without marks or with one after every mark-th word."""
    weights = 1 / (np.arange(len(letters)) + 3.0)
    words = ["".join(rng.choice(list(letters), int(rng.integers(2, 9)), p=weights / weights.sum())) for _ in range(n)]
    return " ".join(w + mark * (i % 12 == 11) for i, w in enumerate(words))


@pytest.mark.parametrize("mark", ["", "."])
@pytest.mark.parametrize("script", sorted(SCRIPTS))
def test_passages_of_every_script_go(spark, script, mark):
    """20 passages of 120 words, each in two documents after different beginnings: most of every later copy is gone."""
    rng = np.random.default_rng(21)
    passages = [written(rng, SCRIPTS[script], 120, mark) for _ in range(20)]
    rows = [(d, written(rng, SCRIPTS[script], 7 + d % 5) + " " + passages[d % 20] + " " + written(rng, SCRIPTS[script], 9)) for d in range(40)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[d] == t for d, t in rows[:20])
    left = [len(set(got[d].split()) & set(passages[d % 20].split())) / len(set(passages[d % 20].split())) for d in range(20, 40)]
    assert max(left) < 0.25 and np.mean(left) < 0.1


@pytest.mark.parametrize("script", sorted(SCRIPTS))
def test_paragraphs_of_every_script_stay_after_an_insertion(spark, script):
    text = written(np.random.default_rng(22), SCRIPTS[script], 200)
    for put in ("abcd", SCRIPTS[script][:4] + " "):
        got = differing(spark, text, put + text)
        assert len(got["c"]) <= 0.05 * len(plain_leaves(text)) and got["near"] > 0.9


def test_classes_of_letters_are_the_rule(spark):
    points = [p for p in range(1, 0x11000) if not 0xD800 <= p < 0xE000]
    df = spark.createDataFrame([(p, chr(p)) for p in points], "p int, c string")
    got = df.select("p", F.col("c").rlike(nested_class()).alias("a"), F.col("c").rlike(f"[^.K{nested_class()}]").alias("b"), F.col("c").rlike(f"[{plain_class()}]").alias("d"))
    assert all((r["a"], r["b"], r["d"]) == (taken(r["p"]), not taken(r["p"]) and chr(r["p"]) not in ".K", taken(r["p"])) for r in got.collect())


def test_rows_without_an_id_are_packed_in_many_groups(spark):
    pieces = spark.range(0, 3000, 1, 3).select(F.lit(None).cast("long").alias("doc_id"), F.lit(0).alias("piece"), F.lit(7).cast("long").alias("length"))
    got = packing.pack(pieces, 32, 3000, 300).groupBy(F.shiftright("sequence_id", 40).alias("g")).count().collect()
    assert len(got) == 10 and max(r["count"] for r in got) < 450 and sum(r["count"] for r in got) == 3000


def test_line_dedup_edges(none, odd):
    assert line_dedup.dedup_lines(none).count() == 0
    out = line_dedup.dedup_lines(odd)
    assert out.count() == 5 and set(odd.columns) <= set(out.columns) and out.filter("line_doc <> 7 or starts <> 7").count() == 0
    assert {r["text"] for r in out.filter("doc_id = 1 and n_chars = 1").collect()} == {"same same same. words here now. and again so. last one here."}  # equal rows are one document


# --- 6: SimHash ---


def plain_simhash(text):
    words = WORD.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode())
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    counts = Counter(b for g in grams for b in range(64) if xxhash.xxh64_intdigest(g, seed=42) >> b & 1)
    return sum(1 << b for b, c in counts.items() if 2 * c > len(grams))


def linked(prints, radius):
    """Smallest id reachable, by trying all pairs."""
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash(docs, rows):
    prints = {d: plain_simhash(t) for d, t, *_ in rows}
    want = linked(prints, 2)
    got = simhash.simhash_groups(docs).collect()
    assert {r["doc_id"]: r["fingerprint"] for r in got} == {d: f"{p:016x}" for d, p in prints.items()}
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert want[21] == 3 and want[61] == want[60] == 60


@pytest.mark.parametrize("pairwise", [0, 3, 32])
def test_links_connect_all_that_are_near(spark, monkeypatch, pairwise):
    """Also through buckets too large to compare pair by pair."""
    monkeypatch.setattr(simhash, "PAIRWISE", pairwise)
    rng = np.random.default_rng(7)
    centres = [int(x) for x in rng.integers(0, 1 << 63, 12)]
    values = {c ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for c in centres for _ in range(12)}
    prints = {v: v for v in values}
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    links = simhash.fingerprint_links(spark.createDataFrame([(signed(v),) for v in values], "fingerprint long"), 2).collect()
    back = {signed(v): v for v in values}
    for r in links:
        assert (back[r["a"]] ^ back[r["b"]]).bit_count() <= 2
    root = {v: v for v in values}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for r in links:
        x, y = find(back[r["a"]]), find(back[r["b"]])
        root[max(x, y)] = min(x, y)
    assert {v: find(v) for v in values} == linked(prints, 2)


def test_masks_cover():
    masks = simhash.covering_masks(2)
    rng = np.random.default_rng(0)
    for _ in range(300):
        differ = sum(1 << int(b) for b in rng.choice(64, 2, replace=False))
        assert any(m & differ == 0 for m in masks)


def test_simhash_edges(none, odd):
    assert simhash.simhash_groups(none).count() == 0 and simhash.simhash_groups(odd).count() == 5


# --- 7: token store ---


def test_token_store(spark, docs, rows, tmp_path):
    want = {d: [*ids, 2] for d, ids in encoded(rows, "byte_bpe_50k.json").items()}
    path = str(tmp_path / "store")
    token_store.write_tokens(docs, path, public_tokenizers.path("byte_bpe_50k.json"), shards=3)
    got = {r["doc_id"]: r for r in token_store.token_index(spark, path).collect()}
    at = 0
    for d in sorted(want):
        assert (got[d]["start"], got[d]["n_tokens"], got[d]["ids_crc32"]) == (at, len(want[d]), crc(want[d]))
        at += len(want[d])
    some = {r["doc_id"]: r["ids"] for r in token_store.read_documents(spark, path, [3, 60, 66]).collect()}
    assert some == {d: want[d] for d in (3, 60, 66)}


def test_token_store_edges(spark, none, odd, tmp_path):
    for name, df, n in (("none", none, 0), ("odd", odd, 5)):
        path = str(tmp_path / name)
        token_store.write_tokens(df, path, public_tokenizers.path("byte_bpe_50k.json"))
        assert token_store.token_index(spark, path).count() == n


# --- 8: mixing ---


def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    total, target, open_ = sum(sizes.values()), {}, list(order)
    left = float(total)
    while open_:
        share = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if share * weight[s] > 3 * sizes[s]]
        if not full:
            return target | {s: share * weight[s] for s in open_}
        for s in full:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
            open_.remove(s)
    return target


def test_mixing(docs, rows):
    size = {d: len(WORD.findall((t or "").encode())) for d, t, *_ in rows}
    of = {r[0]: r[3] for r in rows}
    sizes = Counter()
    for d, n in size.items():
        sizes[of[d]] += n
    target = plain_targets(sizes)
    got = mixing.mix(docs).collect()
    assert {r["doc_id"]: (r["size"], r["source_size"]) for r in got} == {d: (n, sizes[of[d]]) for d, n in size.items()}
    taken = Counter()
    for r in got:
        assert r["target"] == pytest.approx(target[of[r["doc_id"]]])
        assert r["taken"] % max(r["size"], 1) == 0 and r["taken"] <= 3 * r["size"]
        taken[of[r["doc_id"]]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - target[s]) <= max(n for d, n in size.items() if of[d] == s)
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(tuple, [r[:1] + r[-1:] for r in got])) == sorted(map(tuple, [r[:1] + r[-1:] for r in again]))


def test_better_documents_come_first(spark):
    df = spark.createDataFrame([(i, "w " * 10, "ab"[i % 2]) for i in range(2000)], "doc_id long, text string, source string")
    # source a has weight 1 of 3: two thirds of it come once
    got = mixing.mix(df, F.when(F.col("doc_id") % 4 == 0, 4.0).otherwise(0.25)).filter("source = 'a' and taken > 0").select("doc_id").collect()
    good = sum(r["doc_id"] % 4 == 0 for r in got)
    assert 600 < len(got) < 740 and good > 450


def test_labels_weigh_documents(spark):
    """Drawn by the key -ln(u) / w: the share of good ones among those taken is what a draw by hand gives."""
    df = spark.createDataFrame([(i, "w " * 10, "ab"[i % 2]) for i in range(2000)], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0), 0) for i in range(0, 2000, 2)] + [(0, 0, 0), (4, None, None)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"] for r in mixing.mix(df, labels=labels).filter("source = 'a' and taken > 0").select("doc_id").collect()}
    key = lambda i: -math.log((int(hashlib.md5(str(i).encode()).hexdigest()[:12], 16) + 0.5) / (1 << 48)) / (2.0 if i % 4 == 0 and i else 0.5)
    order = sorted(range(0, 2000, 2), key=key)
    assert got == set(order[: len(got)]) and 600 < len(got) < 740
    # other labels only: every weight is 1
    plain = mixing.mix(df, labels=labels.filter("doc_id < 0")).select("doc_id", "taken").collect()
    assert sorted(map(tuple, plain)) == sorted(map(tuple, mixing.mix(df).select("doc_id", "taken").collect()))


def test_mixing_edges(none, odd):
    assert mixing.mix(none).count() == 0 and mixing.mix(odd).count() == 5


# --- 9: repeated strings ---


def plain_repeats(rows):
    seen, out = set(), {}
    for d, t, *_ in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone, mine = np.zeros(len(b), dtype=bool), []
        for i in range(len(b) - 49):
            s = b[i : i + 50]
            if s in seen:
                gone[i : i + 50] = True
            mine.append(s)
        seen.update(mine)
        out[d] = gone
    return out


@pytest.mark.parametrize("group", [None, 2_000])
def test_suffix_dedup(docs, rows, monkeypatch, group):
    if group:
        monkeypatch.setattr(suffix_dedup, "GROUP", group)
    want = plain_repeats(rows)
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(docs).collect()}
    for d, t, *_ in rows:
        b, gone = (t or "").encode(), want[d]
        assert bytes(got[d]["kept"]) == bytes(c for c, g in zip(b, gone, strict=True) if not g)
        assert len(got[d]["span_starts"]) == int((np.diff(gone.astype(int), prepend=0) == 1).sum())
    assert want[20].all() and want[17].sum() > 50


def test_previous_factors_equal_a_scan():
    rng = np.random.default_rng(3)
    for _ in range(50):
        n = int(rng.integers(1, 30))
        doc, common = rng.integers(0, 5, n), np.concatenate([[0], rng.integers(0, 6, n - 1)])
        got = suffix_dedup.previous_factors(doc, common, 3)
        for i in range(n):
            best = max([min(common[min(i, j) + 1 : max(i, j) + 1]) for j in range(n) if doc[j] < doc[i]], default=0)
            assert (got[i] >= 3) == (best >= 3) and (best < 3 or got[i] == best)


def test_equal_contexts_go_by_their_factors(docs, rows, monkeypatch):
    """Nothing is removed but by a longest previous factor: without factors, nothing goes."""
    made = [(d, (t or "").encode()) for d, t, *_ in rows]
    ids, texts = np.array([d for d, _ in made]), [t for _, t in made]
    piece, at, _ = suffix_dedup.anchors([t for t in texts if len(t) >= 50])
    long = [i for i, t in enumerate(texts) if len(t) >= 50]
    data, size = suffix_dedup._gather([texts[i] for i in long], piece, at)
    e = suffix_dedup.Entries(ids[long][piece], np.zeros(len(at), "u8"), np.zeros(len(at), "i4"), at, size, data)
    assert len(suffix_dedup.covered_contexts(e)[0]) > 0
    monkeypatch.setattr(suffix_dedup, "previous_factors", lambda doc, common, least: np.zeros(len(doc), np.int64))
    assert len(suffix_dedup.covered_contexts(e)[0]) == 0


def test_one_anchor_in_very_many_surroundings():
    """100,000 different contexts of one anchor are sorted in a worker's memory; the few equal windows among them are found."""
    import tracemalloc

    rng = np.random.default_rng(4)
    n = 100_000
    data = rng.integers(97, 123, (n, suffix_dedup.SIDE + suffix_dedup.LENGTH), dtype=np.uint8)
    data[:, suffix_dedup.SIDE : suffix_dedup.SIDE + suffix_dedup.GRAM] = np.frombuffer(b"anchor of just 24 bytes!", np.uint8)
    data[70_000, 10:60] = data[5, 10:60]
    e = suffix_dedup.Entries(
        np.arange(n), np.zeros(n, "u8"), np.zeros(n, "i4"), np.full(n, 100), np.full(n, suffix_dedup.SIDE * 64 + suffix_dedup.LENGTH, np.uint16), data,
    )
    tracemalloc.start()
    at, start, end = suffix_dedup.covered_contexts(e)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (at.tolist(), start.tolist(), end.tolist()) == ([70_000], [84], [134]) and peak < 200 << 20


def test_suffix_dedup_of_repeated_ids(spark):
    """Texts of one id are told apart and not removed for one another; a later id loses what either has."""
    a, b = "the first text of this id, long enough to be met again further on. " * 2, "another text of the same id, which is just as long and says other things. " * 2
    df = spark.createDataFrame([(1, a), (1, b), (1, b), (None, b), (2, a + b)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_bytes"], len(r["kept"])) for r in suffix_dedup.remove_repeats(df).collect()), key=str)
    assert got == sorted([(1, len(a), len(a)), (1, len(b), 0), (1, len(b), 0), (None, len(b), len(b)), (2, len(a + b), 0)], key=str)


def test_suffix_dedup_edges(none, odd):
    assert suffix_dedup.remove_repeats(none).count() == 0
    got = suffix_dedup.remove_repeats(odd).collect()
    assert len(got) == 5 and all(not r["span_starts"] for r in got)  # rows of one doc_id are no earlier than one another


# --- 10: language model ---


def test_counts_and_base_scores(docs, rows):
    folds = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d, *_ in rows}
    low = {d: [*WORD.findall((t or "").encode().lower()), b"\n"] for d, t, *_ in rows}
    counts = Counter(w for d, ws in low.items() if not folds[d] for w in ws)
    n, v = sum(counts.values()), len(counts)
    got = {r["doc_id"]: r for r in hmm.score_documents(docs).collect()}
    for d, ws in low.items():
        r = got[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (folds[d], len(ws), sum(counts[w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws))
        assert r["score"] < 0


def test_forward_equals_the_sum_over_paths():
    from itertools import product

    rng = np.random.default_rng(0)
    norm = lambda a: a / a.sum(axis=-1, keepdims=True)
    m = hmm.Model(norm(rng.random(3)), norm(rng.random((3, 3))), norm(rng.random((3, 5))))
    seqs = [rng.integers(0, 5, k).astype(np.int32) for k in (4, 1, 6)]
    for s, got in zip(seqs, m.forward(seqs), strict=True):
        total = sum(
            m.start[p[0]] * m.emit[p[0], s[0]] * math.prod(
                m.move[p[i - 1], p[i]] * m.emit[p[i], s[i]] for i in range(1, len(s))
            ) for p in product(range(3), repeat=len(s))
        )
        assert got == pytest.approx(math.log10(total))


def test_expected_counts_equal_those_over_all_paths():
    from itertools import product

    rng = np.random.default_rng(3)
    norm = lambda a: a / a.sum(axis=-1, keepdims=True)
    m = hmm.Model(norm(rng.random(2)), norm(rng.random((2, 2))), norm(rng.random((2, 4))))
    seqs = [rng.integers(0, 4, k).astype(np.int32) for k in (5, 1, 3)]
    start, move, emit = np.zeros(2), np.zeros((2, 2)), np.zeros((2, 4))
    for s in seqs:
        paths = {
            p: m.start[p[0]] * m.emit[p[0], s[0]] * math.prod(
                m.move[p[i - 1], p[i]] * m.emit[p[i], s[i]] for i in range(1, len(s))
            ) for p in product(range(2), repeat=len(s))
        }
        for p, w in paths.items():
            w /= sum(paths.values())
            start[p[0]] += w
            for i, k in enumerate(p):
                emit[k, s[i]] += w
                if i:
                    move[p[i - 1], k] += w
    for got, want in zip(m.expected(seqs), (start, move, emit), strict=True):
        assert got == pytest.approx(want)


@pytest.mark.parametrize("piece", [3, 7])
def test_pieces_of_long_documents_change_nothing(monkeypatch, piece):
    rng = np.random.default_rng(piece)
    norm = lambda a: a / a.sum(axis=-1, keepdims=True)
    m = hmm.Model(norm(rng.random(4)), norm(rng.random((4, 4))), norm(rng.random((4, 9))))
    seqs = [rng.integers(0, 9, k).astype(np.int32) for k in (1, 40, 6, 7, 21, 3, 14)]
    whole, counts = m.forward(seqs), m.expected(seqs)
    monkeypatch.setattr(hmm, "PIECE", piece)
    assert m.forward(seqs) == pytest.approx(whole)
    for got, want in zip(m.expected(seqs), counts, strict=True):
        assert got == pytest.approx(want)


def plain_forward(m, classes):
    a, total = m.start * m.emit[:, classes[0]], 0.0
    for c in classes[1:]:
        total += math.log10(a.sum())
        a = (a / a.sum()) @ m.move * m.emit[:, c]
    return total + math.log10(a.sum())


def test_whole_scores_equal_a_plain_model(spark, docs, rows, monkeypatch):
    """Training on all rows and scoring, one document at a time, with the same first values."""
    kept = []
    real = hmm.first_model

    def first(*args):
        kept.append((args[1], args[2], real(*args)))
        return kept[0][2]

    monkeypatch.setattr(hmm, "first_model", first)
    monkeypatch.setattr(hmm, "CHUNK", 20_000)
    got = {r["doc_id"]: r["score"] for r in hmm.score_documents(docs, rounds=2).collect()}
    classes, prior, model = kept[0]
    low = {d: [*WORD.findall((t or "").encode().lower()), b"\n"] for d, t, *_ in rows}
    train = [d for d in low if zlib.crc32(str(d).encode()) % 7 != 2]
    counts = Counter(w for d in train for w in low[d])
    n, v = Counter(), Counter()
    for w, c in counts.items():
        n[classes.of(w)] += c
        v[classes.of(w)] += 1
    for _ in range(2):
        sums = [model.expected([np.array([*map(classes.of, low[d])], dtype=np.int32)]) for d in train]
        model = hmm.Model.from_counts(*(sum(x) for x in zip(*sums, strict=True)), prior)
    for d, ws in low.items():
        share = sum(math.log10((counts[w] + 1) / (n[classes.of(w)] + v[classes.of(w)] + 1)) for w in ws if w != b"\n")
        assert got[d] == pytest.approx(share + plain_forward(model, [*map(classes.of, ws)]), abs=1e-5)


def test_first_values_come_from_all_training_documents(spark):
    """More documents than a sample would hold: every neighbour of every training document is counted, and each counts in the model."""
    rng = np.random.default_rng(2)
    texts = {i: rng.choice(list("abcdefgh"), rng.integers(0, 9)).tolist() for i in range(4_000)}
    cls = hmm.Classes([bytes([x]) for x in b"abcdefgh"])

    def made(texts):
        df = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string").repartition(5)
        return hmm.chunks(df.withColumn("held_out", hmm.held_out()))

    want = np.zeros((cls.n, 2 * hmm.NEAR))
    for i, t in texts.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            of = [*(cls.of(w.encode()) for w in t), 0]
            for x, y in zip(of, of[1:], strict=False):
                want[x, y] += 1
                want[y, hmm.NEAR + x] += 1
    assert (hmm.neighbours(made(texts), cls) == want).all()
    prior = np.full(cls.n, 1 / cls.n)
    model = hmm.first_model(made(texts), cls, prior, 3)
    other = hmm.first_model(made({i: t if i % 4 else sorted(t) for i, t in texts.items()}), cls, prior, 3)
    assert abs(model.emit - other.emit).max() > 1e-4
    for m in (model.start, model.move, model.emit):
        assert np.allclose(m.sum(axis=-1), 1)


def test_scores_are_the_same_under_another_partitioning(docs):
    a, b = (sorted((r["doc_id"], r["score"]) for r in hmm.score_documents(d).collect()) for d in (docs, docs.repartition(7, "text")))
    assert a == b


def test_rounds_of_training_raise_the_likelihood():
    rng = np.random.default_rng(1)
    seqs = [np.array([(k + i) % 2 * 3 + rng.integers(0, 3) for i in range(40)], dtype=np.int32) for k in range(30)]
    norm = lambda a: a / a.sum(axis=-1, keepdims=True)
    m, prior, last = hmm.Model(norm(rng.random(2)), norm(rng.random((2, 2))), norm(rng.random((2, 6)))), np.full(6, 1 / 6), -1e9
    for _ in range(12):
        m = hmm.Model.from_counts(*m.expected(seqs), prior)
        now = m.forward(seqs).sum()
        assert now > last - 0.5
        last = now
    assert last > 1.15 * 30 * 40 * math.log10(1 / 6) * 0.75 and last > 30 * 40 * math.log10(1 / 6)


def test_model_beats_words_alone_on_held_out_text(spark):
    from corpus_pipeline import documents

    got = hmm.score_documents(documents(spark, "/root/testdata/sf0.001")).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


def test_model_edges(spark, none, odd):
    assert hmm.score_documents(none).count() == 0 and hmm.score_documents(odd).count() == 5
    alone = spark.createDataFrame(
        [(9, "only held out", "a", "b", 1)], "doc_id long, text string, lang string, source string, n_chars long",
    ).filter("crc32(cast(doc_id as string)) % 7 = 2")
    assert hmm.score_documents(alone).count() == alone.count()
