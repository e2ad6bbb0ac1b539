"""Lossless 8-bit images in binary columns: PNG written and read with zlib and numpy, and cosine-transform hashes."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from scenewright.llm.common import documents, stored, texts_of, utf8

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Samples in a row of the images that payloads are stored in.
WIDTH = 192
#: Largest IDAT chunk.
CHUNK = 1 << 18
#: Images are averaged to SIDE x SIDE before the transform, of which the LOW x LOW lowest frequencies count.
SIDE, LOW = 32, 8


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(image: np.ndarray, level: int = 6) -> bytes:
    """A grayscale PNG of an (h, w) array of uint8. Each row takes the filter with the smallest sum of differences."""
    h, w = image.shape
    left, up = image.copy(), image.copy()
    left[:, 1:] -= image[:, :-1]
    up[1:] -= image[:-1]
    lines = np.stack([image, left, up])
    costs = np.abs(lines.view(np.int8).astype(np.int16)).sum(axis=2)
    best = costs.argmin(axis=0)
    raw = np.empty((h, w + 1), dtype=np.uint8)
    raw[:, 0] = best  # none, sub and up are PNG's filters 0, 1 and 2
    raw[:, 1:] = lines[best, np.arange(h)]
    data = zlib.compress(raw.tobytes(), level)
    body = b"".join(_chunk(b"IDAT", data[i : i + CHUNK]) for i in range(0, len(data), CHUNK))
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + body + _chunk(b"IEND", b"")


def _unfilter(raw: np.ndarray, kinds: np.ndarray, step: int) -> np.ndarray:
    """Undo PNG's row filters. Runs of rows with filters that add along one axis are sums modulo 256; the others go row by row."""
    h, w = raw.shape
    out = raw.copy()
    sub = kinds == 1
    if sub.any():
        rows = out[sub].reshape(-1, w // step, step)
        out[sub] = np.cumsum(rows, axis=1, dtype=np.uint8).reshape(-1, w)
    y = 0
    while y < h:
        kind = kinds[y]
        if kind < 2:
            y += 1
            continue
        before = out[y - 1] if y else np.zeros(w, dtype=np.uint8)
        if kind == 2:
            end = y + 1
            while end < h and kinds[end] == 2:
                end += 1
            out[y:end] = np.cumsum(np.concatenate([before[None], raw[y:end]]), axis=0, dtype=np.uint8)[1:]
            y = end
            continue
        line = raw[y].astype(np.int32)
        prior = before.astype(np.int32)
        for x in range(0, w, step):
            a = line[x - step : x] if x else np.zeros(step, dtype=np.int32)
            b, c = prior[x : x + step], prior[x - step : x] if x else np.zeros(step, dtype=np.int32)
            if kind == 3:
                guess = (a + b) >> 1
            else:
                p = a + b - c
                pa_, pb, pc = np.abs(p - a), np.abs(p - b), np.abs(p - c)
                guess = np.where((pa_ <= pb) & (pa_ <= pc), a, np.where(pb <= pc, b, c))
            line[x : x + step] = (line[x : x + step] + guess) & 255
        out[y] = line
        y += 1
    return out


def decode_png(data: bytes) -> np.ndarray:
    """The samples of an 8-bit PNG without interlace: (h, w) or (h, w, channels). Any checksum that fails raises ValueError."""
    if data[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, body, head, ended = 8, [], None, False
    while at < len(data) and not ended:
        (n,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        piece, check = data[at + 8 : at + 8 + n], data[at + 8 + n : at + 12 + n]
        if len(piece) != n or len(check) != 4 or struct.unpack(">I", check)[0] != zlib.crc32(piece, zlib.crc32(kind)):
            raise ValueError(f"chunk {kind!r} at {at} fails its checksum")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", piece)
        elif kind == b"IDAT":
            body.append(piece)
        ended = kind == b"IEND"
        at += 12 + n
    if head is None or not ended:
        raise ValueError("no header or no end")
    w, h, depth, colour, _, _, interlace = head
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour)
    if depth != 8 or channels is None or interlace:
        raise ValueError("only 8-bit samples without palette and interlace")
    raw = np.frombuffer(zlib.decompress(b"".join(body)), dtype=np.uint8)
    if len(raw) != h * (1 + w * channels):
        raise ValueError("wrong number of samples")
    raw = raw.reshape(h, 1 + w * channels)
    if raw[:, 0].max(initial=0) > 4:
        raise ValueError("unknown row filter")
    out = _unfilter(raw[:, 1:], raw[:, 0], channels)
    return out if channels == 1 else out.reshape(h, w, channels)


@lru_cache(1)
def _cosines() -> np.ndarray:
    k, x = np.arange(LOW)[:, None], np.arange(SIDE)[None]
    return np.cos(np.pi * k * (2 * x + 1) / (2 * SIDE))


def _bands(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of SIDE bands over n places; fewer places than bands: places repeat."""
    at = (np.arange(SIDE + 1) * n) // SIDE
    start = np.minimum(at[:-1], n - 1)
    return start, np.maximum(at[1:] - at[:-1], 1)


def cosine_hash(image: np.ndarray) -> bytes:
    """64 bits: which of the lowest cosine-transform coefficients of the averaged image lie above their median."""
    h, w = image.shape
    y, ny = _bands(h)
    x, nx = _bands(w)
    if h >= SIDE:
        rows = np.add.reduceat(image, y, axis=0, dtype=np.float64) / ny[:, None]
    else:
        rows = image[y].astype(np.float64)
    small = np.add.reduceat(rows, x, axis=1) / nx if w >= SIDE else rows[:, x]
    low = (_cosines() @ small @ _cosines().T).round(6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes()


def as_image(payload: bytes) -> np.ndarray:
    """Payload, blanks up to a positive multiple of WIDTH appended, as rows of WIDTH samples."""
    padded = payload + b" " * (-len(payload) % WIDTH) if payload else b" " * WIDTH
    return np.frombuffer(padded, dtype=np.uint8).reshape(-1, WIDTH)


STORED = "doc_id long, n_bytes long, media binary"


def store_texts(docs: DataFrame, text: str = "text", level: int = 6) -> DataFrame:
    """doc_id, n_bytes and a PNG of each whole text's UTF-8 bytes (null: empty), every row for itself."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), utf8(batch.column(1))
            for at in range(0, len(texts), 256):
                run = texts[at : at + 256]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, len(run)), pa.array([len(t) for t in run], pa.int64()), pa.array([encode_png(as_image(t), level) for t in run], pa.binary())],
                    names=["doc_id", "n_bytes", "media"],
                )

    return texts_of(docs, text).mapInArrow(write, STORED)


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width int, height int, cosine_hash binary"


def media_features(media: DataFrame) -> DataFrame:
    """Decode each PNG of store_texts and describe what was read back; equal media have equal features."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for stored_form in batch.column(2):
                data = stored_form.as_py()
                image = decode_png(data)
                payload, code = image.tobytes(), cosine_hash(image)
                rows.append(
                    (
                        len(payload),
                        hashlib.sha256(payload).hexdigest(),
                        zlib.crc32(payload[-16:]),
                        len(data),
                        hashlib.sha256(data).hexdigest(),
                        code.hex(),
                        image.shape[1],
                        image.shape[0],
                        code,
                    )
                )
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.binary())
            names = [f.split()[0] for f in FEATURES.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names=names)

    return media.mapInArrow(read, FEATURES)


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as PNG in a table, read back and described."""
    return media_features(stored(store_texts(documents(spark, sf_dir)), "media"))
