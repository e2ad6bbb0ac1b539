"""Each stage of the pipeline against a plain version, and the whole of it on tables with nulls and copies."""

from __future__ import annotations

import math
from collections import Counter

import corpus_pipeline as cp
import pytest
from test_llm_operators import WORD, crc, encoded, plain_lines, plain_targets

from scenewright.llm import common


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    at = tmp_path_factory.mktemp("sf")
    docs.write.parquet(str(at / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(str(at / "labels.parquet"))
    return str(at)


def plain_rows(df):
    return sorted((r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in df.collect())


def test_names_and_columns(spark, docs, folder):
    assert [n for n, _ in cp.STAGES] == ["quality", "lines", "near_copies", "mix_sources", "sequences"]
    for _, stage in cp.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns


def test_quality_keeps_whole_rows(spark, docs, rows, folder):
    """Exactly those documents stay that the classifier keeps, whose scores the operator's own tests hold against a plain version."""
    from scenewright.llm import cotraining

    labels = spark.read.parquet(f"{folder}/labels.parquet")
    keep = {r["doc_id"] for r in cotraining.score(docs, cotraining.fit(docs, labels)).filter("quality_keep").collect()}
    kept = plain_rows(cp.quality(spark, docs, folder))
    assert sorted(kept, key=str) == sorted((tuple(r) for r in rows if r[0] in keep), key=str)


def test_lines(spark, docs, rows, folder):
    want = plain_lines(rows)
    got = {r["doc_id"]: r for r in cp.lines(spark, docs, folder).collect()}
    assert {d: r["text"] or "" for d, r in got.items()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in got.values() if r["text"] is not None)


def test_near_copies_of_odd_rows(spark, odd, none, folder):
    """Rows of one id, or of none, stay unless their texts are near copies."""
    assert cp.alike_copies(spark, none, folder).count() == 0
    out = cp.alike_copies(spark, odd, folder)
    texts = {r["text"] for r in odd.collect()}
    assert sorted(map(str, (r["text"] for r in out.collect()))) == sorted(map(str, texts)) and out.columns == odd.columns
    five = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in ((7, "one thing said here now"), (7, "another thing is told there"), (None, "a third of them comes late"), (None, "and a fourth one as well"), (8, "the fifth is by itself"))], "doc_id long, text string, lang string, source string, n_chars long")
    assert cp.alike_copies(spark, five, folder).count() == 5
    assert cp.alike_copies(spark, five.union(five), folder).count() == 5


def test_stages_keep_clashing_columns(spark, odd, folder):
    """Whatever an input's columns are called, each stage gives them back, and rows of repeated or null ids stay apart."""
    want = {(r["doc_id"], r["text"]) for r in odd.collect()}
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, odd, folder)
        assert out.columns == odd.columns, name
        got = [r for r in out.collect()]
        assert all(r[c] == 7 for r in got for c in odd.columns[5:]), name
        assert {(r["doc_id"], r["text"]) for r in got} <= want, name
        if name in ("quality", "lines"):
            assert len(got) == 5, name


def test_mix_of_repeated_rows(spark, folder):
    """Rows equal in id and text share what the mix takes of them, to within one."""
    rows = [(5, "w " * 10, "en", "a", 1)] * 7 + [(None, "v " * 10, "en", "a", 1)] * 6 + [(i, "u " * 30, "en", "b", 1) for i in range(10, 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    from scenewright.llm import mixing

    taken = mixing.mix(docs, labels=spark.read.parquet(f"{folder}/labels.parquet")).groupBy("source").sum("taken").collect()
    out = cp.mix_sources(spark, docs, folder)
    words = Counter()
    for r in out.collect():
        words[r["source"]] += len(r["text"].split())
    assert words == {r["source"]: r["sum(taken)"] for r in taken if r["sum(taken)"]}


def test_mix(spark, docs, rows, folder):
    size = {d: len(WORD.findall((t or "").encode())) for d, t, *_ in rows}
    source, sizes, taken = {r[0]: r[3] for r in rows}, Counter(), Counter()
    for d, n in size.items():
        sizes[source[d]] += n
    out = [r["doc_id"] for r in cp.mix_sources(spark, docs, folder).collect()]
    for d in out:
        taken[source[d]] += size[d]
    assert max(Counter(out).values()) <= 3
    for s, t in plain_targets(sizes).items():
        assert abs(taken[s] - t) <= max(n for d, n in size.items() if source[d] == s)


def test_sequences(spark, docs, rows, folder):
    want = {d: [*ids, 1] for d, ids in encoded(rows, "word_bpe_49k.json").items()}
    got = cp.sequences(spark, docs, folder).collect()
    assert all(r["ids_crc32"] == crc(want[r["doc_id"]][r["start"] : r["start"] + r["length"]]) for r in got)
    assert len({r["sequence_id"] for r in got}) <= math.ceil(sum(map(len, want.values())) / 4096) + 1


def test_run(spark, folder):
    out = cp.run(spark, folder)
    assert out.count() > 0
    used = out.groupBy("sequence_id").sum("length").collect()
    assert all(r["sum(length)"] <= 4096 for r in used)


def test_empty_corpus(spark, none, folder, tmp_path):
    none.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{folder}/labels.parquet").limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_shared_folder_is_the_sessions(spark):
    assert common.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
