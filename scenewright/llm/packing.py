"""Sum-of-squares packing of tokenized documents into fixed-length training sequences."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenewright.llm import tokens
from scenewright.llm.common import buckets_for, documents, stored, texts_of

#: Pieces that one packing task holds; packing loses a few open sequences for each such group.
GROUP = 32_768

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pack_group(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length, taken in the given order.

    counts[g] is the number of open bins with g places left. A length goes into the open bin for which the sum of
    counts squared over all open gaps 1..capacity-1 becomes smallest; ties go to the smallest gap. A new bin is opened
    only where no open one has room: with longest lengths first, that takes as few bins as best fit does.
    """
    counts = np.zeros(capacity + 1, dtype=np.int64)
    bins_with: list[list[int]] = [[] for _ in range(capacity + 1)]
    place, offset, opened = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64), 0
    for i, s in enumerate(lengths.tolist()):
        there = counts[s:capacity]
        if there.any():
            # one bin less with gap g, one more with gap g - s; a gap of 0 counts nothing
            costs = 2 * (counts[: capacity - s] - there) + 2
            costs[0] -= 1 + 2 * int(counts[0])
            gap = s + int(np.where(there > 0, costs, np.iinfo(np.int64).max).argmin())
            b = bins_with[gap].pop()
            counts[gap] -= 1
        else:
            gap, b, opened = capacity, opened, opened + 1
        if gap > s:
            counts[gap - s] += 1
            bins_with[gap - s].append(b)
        place[i], offset[i] = b, capacity - gap
    return place, offset


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, text: str = "text") -> DataFrame:
    """One row per piece of at most capacity tokens, each document's ids followed by end_id."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(tokenizer).encode
        end = int(end_id).to_bytes(4, "little")
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for at, run in tokens.grouped(batch.column(1).to_pylist()):
                rows = []
                for doc, data in zip(ids[at:], encode(run), strict=False):
                    data += end
                    for k in range(0, len(data) // 4, capacity):
                        piece = data[4 * k : 4 * (k + capacity)]
                        rows.append((doc, k // capacity, k, len(piece) // 4, zlib.crc32(piece)))
                cols = list(zip(*rows, strict=True))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"]
                )

    return texts_of(docs, text).mapInArrow(cut, PIECES)


def pack(pieces: DataFrame, capacity: int, rows: int, group: int = GROUP) -> DataFrame:
    """Add sequence_id and offset to rows with doc_id, piece and length (1 to capacity).

    rows: how many there are, for the number of groups. Pieces are dealt into groups by a hash of all their columns
    and, as rows may be equal in all of them, of the task that holds them and their place in it; so neither a null or
    repeated doc_id nor a repeated row decides a group's size. Each group is packed on its own, longest piece first.
    Every piece gets a place; the same stored rows give the same sequences.
    """
    n = buckets_for(rows, group)

    def place(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable", ignore_index=True)
        at, offset = pack_group(part["length"].to_numpy(), capacity)
        return part.drop(columns="pack_group").assign(sequence_id=(np.int64(key[0]) << 40) + at, offset=offset)

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema]
    dealt = F.xxhash64(*[F.col(f"`{c}`") for c in pieces.columns], F.monotonically_increasing_id())
    return pieces.withColumn("pack_group", F.pmod(dealt, F.lit(n))).groupBy("pack_group").applyInPandas(place, ", ".join([*kept, "sequence_id long", "offset long"]))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, text: str = "text") -> DataFrame:
    """Pack all documents into sequences of at most capacity tokens.

    Returns one row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Null and empty texts
    are one end id. Documents longer than capacity are cut into pieces of capacity tokens, the last one shorter.
    Repeated rows are packed each for itself. No documents: no rows. Other columns are ignored.
    """
    pieces = stored(token_pieces(docs, tokenizer, capacity, end_id, text), "pieces")  # small, and counted before it is dealt
    return pack(pieces, capacity, pieces.count())


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
