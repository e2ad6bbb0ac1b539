"""Token ids in files: each document a zstandard frame of its own under one dictionary shared by all.

The files are Parquet tables below one folder, so that Spark's committer decides which of several task attempts
count and any store that Spark reaches will do:

  dictionary  one row: dictionary (bytes, may be empty), dictionary_hash (SHA-256), width (bytes of an id: 2 or 4)
  blocks      shard, block, dictionary_hash, doc_ids, n_tokens, offsets (one more than documents), payload

A block is a run of documents in ascending doc_id; shards follow each other in doc_id. Frame i of a payload is
payload[offsets[i]:offsets[i + 1]] and can be read without its neighbours.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scenewright.llm import tokens
from scenewright.llm.common import buckets_for, documents, scratch, texts_of

BLOCKS = "shard int, block long, dictionary_hash string, doc_ids array<long>, n_tokens array<long>, offsets array<long>, payload binary"
_BLOCKS = pa.schema(
    [
        ("shard", pa.int32()),
        ("block", pa.int64()),
        ("dictionary_hash", pa.string()),
        ("doc_ids", pa.list_(pa.int64())),
        ("n_tokens", pa.list_(pa.int64())),
        ("offsets", pa.list_(pa.int64())),
        ("payload", pa.binary()),
    ]
)
#: About so many documents' ids are what the dictionary is trained on, those with a hash of doc_id under a bound. Of a
#: longer document a slice of SLICE bytes of ids at a place that its id decides is the sample, so that the driver gets a
#: bounded number of bytes. The dictionary has DICTIONARY bytes, fewer if the samples are small.
TRAIN_DOCS, SLICE, DICTIONARY = 1_000, 8_192, 64 << 10
#: A block is closed at so many compressed bytes; a shard has about so many bytes of text.
BLOCK, SHARD = 1 << 20, 64 << 20


def _narrow(ids: bytes, width: int) -> bytes:
    return ids if width == 4 else np.frombuffer(ids, dtype="<u4").astype("<u2").tobytes()


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int, width: int, most: int = TRAIN_DOCS, size: int = DICTIONARY, text: str = "text") -> bytes:
    """A zstandard dictionary from the id arrays of about `most` documents; smaller where there is less to train on.

    Empty only where zstandard finds nothing to train on: no documents, or fewer than eight samples.
    """
    bound = int(min(1.0, most / max(1, docs.count())) * (1 << 32))
    picked = texts_of(docs, text).filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)) < bound)

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = tokens.encoder(tokenizer).encode, int(end_id).to_bytes(4, "little")
        for b in batches:
            ids, made = b.column(0).to_pylist(), []
            for at, run in tokens.grouped(b.column(1).to_pylist()):
                for doc, data in zip(ids[at:], encode(run), strict=False):
                    data = _narrow(data + end, width)
                    spare = max(0, len(data) - SLICE) // width
                    first = zlib.crc32(str(doc).encode()) % (spare + 1) * width
                    made.append(data[first : first + SLICE])
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["ids"])

    samples = sorted(bytes(r["ids"]) for r in picked.mapInArrow(sampled, "ids binary").limit(2 * most).collect())
    size = min(size, sum(map(len, samples)) // 8)
    if size < 256 or len(samples) < 8:
        return b""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, level: int = 3, shards: int | None = None, text: str = "text") -> None:
    """Encode all documents, end_id after each, into files below path, in ascending doc_id order.

    Null and empty texts hold the end id alone. Rows that share a doc_id follow each other; a null doc_id comes
    first. No documents: an empty table of blocks. Other columns are ignored.
    """
    spark = docs.sparkSession
    vocabulary = max(tokens.encoder(tokenizer).tokenizer.get_vocab_size(), end_id + 1)
    width = 2 if vocabulary <= 1 << 16 else 4
    dictionary = train_dictionary(docs, tokenizer, end_id, width, text=text)
    digest = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame(
        [(bytearray(dictionary), digest, width)], "dictionary binary, dictionary_hash string, width int",
    ).coalesce(1).write.parquet(f"{path}/dictionary")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, encode = TaskContext.get().partitionId(), tokens.encoder(tokenizer).encode
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        if shared:
            shared.precompute_compress(level)  # else every document digests the dictionary anew
        pack = zstandard.ZstdCompressor(level=level, dict_data=shared)
        end, at = int(end_id).to_bytes(4, "little"), 0
        ids, counts, frames, size = [], [], [], 0

        def block() -> pa.RecordBatch:
            offsets = np.concatenate([[0], np.cumsum([len(f) for f in frames])]).tolist()
            return pa.RecordBatch.from_pylist(
                [{"shard": shard, "block": at, "dictionary_hash": digest, "doc_ids": ids, "n_tokens": counts, "offsets": offsets, "payload": b"".join(frames)}],
                schema=_BLOCKS,
            )

        for batch in batches:
            docs_in = batch.column(0).to_pylist()
            for start, run in tokens.grouped(batch.column(1).to_pylist()):
                for doc, data in zip(docs_in[start:], encode(run), strict=False):
                    data += end
                    frame = pack.compress(_narrow(data, width))
                    ids.append(doc)
                    counts.append(len(data) // 4)
                    frames.append(frame)
                    size += len(frame)
                    if size >= BLOCK:
                        yield block()
                        at, ids, counts, frames, size = at + 1, [], [], [], 0
        if ids:
            yield block()

    n = shards or max(
        int(spark.conf.get("spark.sql.shuffle.partitions")), buckets_for(texts_of(docs, text).agg(F.sum(F.octet_length("text"))).first()[0] or 0, SHARD),
    )
    ordered = texts_of(docs, text).repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    ordered.mapInArrow(blocks, BLOCKS).write.parquet(f"{path}/blocks")


def read_blocks(spark: SparkSession, path: str) -> tuple[DataFrame, bytes, int]:
    """The blocks, their dictionary and the width of an id. The dictionary is checked against its hash."""
    row = spark.read.parquet(f"{path}/dictionary").first()
    dictionary = bytes(row["dictionary"])
    if hashlib.sha256(dictionary).hexdigest() != row["dictionary_hash"]:
        raise ValueError(f"{path}: the dictionary doesn't have its hash")
    return spark.read.schema(BLOCKS).parquet(f"{path}/blocks"), dictionary, row["width"]


def _frames(dictionary: bytes, width: int, batch: pa.RecordBatch) -> Iterator[tuple[dict, int, bytes]]:
    digest = hashlib.sha256(dictionary).hexdigest()
    unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    for i in range(batch.num_rows):
        block = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
        if block["dictionary_hash"] != digest:
            raise ValueError("a block needs another dictionary")
        for k, (a, b) in enumerate(zip(block["offsets"], block["offsets"][1:], strict=False)):
            data = unpack.decompress(block["payload"][a:b])
            yield block, k, data if width == 4 else np.frombuffer(data, dtype="<u2").astype("<u4").tobytes()


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """Read every document's ids back: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    blocks, dictionary, width = read_blocks(spark, path)
    # One small row per block, summed per shard, then over shards: no window holds more than one shard's blocks.
    sizes = blocks.select("shard", "block", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("tokens"))
    shards = sizes.groupBy("shard").agg(F.sum("tokens").alias("tokens"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("shard_start"))
    within = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "block", F.coalesce(F.sum("tokens").over(within), F.lit(0)).alias("block_start"))
    starts = starts.join(shards, "shard").select("shard", "block", (F.col("shard_start") + F.col("block_start")).alias("start"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, at = [], 0
            for block, k, data in _frames(dictionary, width, batch):
                at = 0 if k == 0 else at
                rows.append((block["shard"], block["block"], block["doc_ids"][k], at, len(data) // 4, zlib.crc32(data)))
                at += len(data) // 4
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["shard", "block", "doc_id", "at", "n_tokens", "ids_crc32"]
            )

    found = blocks.mapInArrow(read, "shard int, block long, doc_id long, at long, n_tokens long, ids_crc32 long")
    return found.join(starts, ["shard", "block"]).select("doc_id", (F.col("start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def read_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """doc_id and ids of a few documents; only the blocks that hold them are read, only their frames decompressed."""
    blocks, dictionary, width = read_blocks(spark, path)
    wanted = frozenset(doc_ids)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        for batch in batches:
            rows = []
            for block in batch.to_pylist():
                for k, doc in enumerate(block["doc_ids"]):
                    if doc in wanted:
                        data = unpack.decompress(block["payload"][block["offsets"][k] : block["offsets"][k + 1]])
                        rows.append({"doc_id": doc, "ids": np.frombuffer(data, dtype=f"<u{width}").tolist()})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int64()))]))

    return blocks.filter(F.arrays_overlap("doc_ids", F.array(*[F.lit(d).cast("long") for d in doc_ids]))).mapInArrow(read, "doc_id long, ids array<long>")


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch(spark, "tokens")
    write_tokens(documents(spark, sf_dir), path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_index(spark, path)
