"""Point clouds as rows: texts of coordinates by Spark's own reader, npy, pcd and ply files by a data source in ranges of bytes."""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any, BinaryIO

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

TEXT_KINDS = {"ascii_xyz": 3, "ascii_xyzi": 4}
FILE_KINDS = ("binary_npy", "pcd", "ply")
POINTS = "uri string, i long, x double, y double, z double, intensity double"
#: Names that the fourth number of a point goes by.
INTENSITY = ("intensity", "scalar_intensity", "reflectance")
#: Bytes of a task's range, and points that a task holds at a time.
RANGE, BLOCK = 64 << 20, 1 << 18
_SCHEMA = pa.schema([("uri", pa.string()), ("i", pa.int64()), *[(c, pa.float64()) for c in ("x", "y", "z", "intensity")]])
# Fixed values of the ply format.
_PLY = {
    "char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4",
    "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8",
}


def read_texts(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """uri, x, y, z, intensity and err of lines of three (ascii_xyz) or four numbers (ascii_xyzi) parted by blanks, tabs or commas.

    Files are split at lines, so one large file is many tasks. Empty lines and those that begin with # are left out; a
    line of too few numbers, or of something else, is a row with err and without coordinates. More numbers don't matter.
    """
    n = TEXT_KINDS[kind]
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("uri"), F.trim(F.regexp_replace("value", r"[\t\r,]", " ")).alias("line"))
    cells = F.slice(F.split("line", " +"), 1, n)
    numbers = F.transform(cells, lambda c: c.try_cast("double"))
    rows = lines.filter("line <> '' AND line NOT LIKE '#%'").withColumn("p", numbers)
    good = (F.size("p") == n) & F.forall("p", lambda v: v.isNotNull())
    at = lambda i: F.when(good, F.get("p", F.lit(i))) if i < n else F.lit(None).cast("double")
    coordinates: list[Column] = [at(i).alias(c) for i, c in enumerate(("x", "y", "z", "intensity"))]
    return rows.select("uri", *coordinates, F.when(~good, F.concat(F.lit(f"not {n} numbers: "), F.left("line", F.lit(80)))).alias("err"))


def read_files(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """uri, i (place in its file), x, y, z, intensity (null if a file has none) of binary_npy, pcd or ply files: one file, or all of a folder.

    Points of one size are cut into ranges of bytes, so one large file is many tasks; npy files in Fortran order and pcd
    and ply files as text are one task each, which holds BLOCK points at a time (a Fortran file: whole columns). Faces and
    other elements after a ply file's vertices are left out. Files that aren't of their kind, are cut short or are
    compressed fail the job with their name.
    """
    if kind not in FILE_KINDS:
        raise ValueError(f"unknown kind {kind!r}")
    spark.dataSource.register(CloudSource)
    return spark.read.format("scenewright_cloud").option("kind", kind).option("range", RANGE).load(path)


@dataclass
class _Layout:
    """What a header tells: where points begin, how many there are, and their fields (dtype, or names of a text's columns)."""

    start: int
    count: int
    dtype: np.dtype[Any] | None = None
    names: tuple[str, ...] = ()
    columns: int = 0


def _lines(f: BinaryIO, last: str) -> Iterator[list[str]]:
    """Words of a header's lines up to the one that begins with last."""
    while line := f.readline():
        words = line.decode("latin-1").split()
        yield words
        if words and words[0] == last:
            return
    raise ValueError("the header has no end")


def _npy(f: BinaryIO) -> _Layout:
    read = {(1, 0): np.lib.format.read_array_header_1_0, (2, 0): np.lib.format.read_array_header_2_0}.get(np.lib.format.read_magic(f))
    if read is None:
        raise ValueError("unknown version of npy")
    shape, fortran, kind = read(f)
    if kind.names:
        return _Layout(f.tell(), int(np.prod(shape)), kind)
    if len(shape) != 2 or shape[1] < 3 or kind.hasobject:
        raise ValueError(f"points are rows of three numbers or more, not {shape} of {kind}")
    if fortran:
        return _Layout(f.tell(), shape[0], kind, columns=shape[1])
    return _Layout(f.tell(), shape[0], np.dtype([(n, kind) for n in ("x", "y", "z", "intensity", *[f"f{i}" for i in range(4, shape[1])])[: shape[1]]]))


def _pcd(f: BinaryIO) -> _Layout:
    head = {w[0]: w[1:] for w in _lines(f, "DATA") if w and not w[0].startswith("#")}
    counts = [int(c) for c in head.get("COUNT", ["1"] * len(head["FIELDS"]))]
    fields = [(n, f"<{'f' if t == 'F' else t.lower()}{s}", (c,)) if c != 1 else (n, f"<{t.lower()}{s}") for n, t, s, c in zip(head["FIELDS"], head["TYPE"], head["SIZE"], counts, strict=True)]
    total, how = int(head["POINTS"][0]), head["DATA"][0]
    if how == "binary":
        return _Layout(f.tell(), total, np.dtype([(f"_{i}" if x[0] == "_" else x[0], *x[1:]) for i, x in enumerate(fields)]))
    if how == "ascii":
        return _Layout(f.tell(), total, names=tuple(n for (n, *_), c in zip(fields, counts, strict=True) for n in [n] * c))
    raise ValueError(f"data stored as {how} are not read")


def _ply(f: BinaryIO) -> _Layout:
    form, total, fields, within = "", -1, [], ""
    for w in _lines(f, "end_header"):
        if w[:1] == ["format"]:
            form = w[1]
        elif w[:1] == ["element"]:
            if total < 0 and w[1] != "vertex":
                raise ValueError(f"{w[1]} before the vertices")
            within, total = w[1], int(w[2]) if w[1] == "vertex" else total
        elif w[:1] == ["property"] and within == "vertex":
            fields.append((w[2], w[1]))
    if form == "ascii":
        return _Layout(f.tell(), total, names=tuple(n for n, _ in fields))
    order = {"binary_little_endian": "<", "binary_big_endian": ">"}[form]
    return _Layout(f.tell(), total, np.dtype([(n, order + _PLY[t]) for n, t in fields]))


@dataclass
class _Range(InputPartition):
    path: str
    start: int
    stop: int


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.root, self.kind, self.range = options["path"], options["kind"], int(options["range"])

    def partitions(self) -> list[InputPartition]:
        """Ranges of bytes by the files' sizes alone; headers are read by the tasks."""
        system, path = fs.FileSystem.from_uri(self.root) if "://" in self.root or self.root.startswith("file:") else (fs.LocalFileSystem(), self.root)
        found = system.get_file_info(path)
        files = [found] if found.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path, recursive=True))
        end = {"binary_npy": ".npy"}.get(self.kind, f".{self.kind}")
        wanted = sorted((x.path, x.size) for x in files if x.type == fs.FileType.File and x.path.endswith(end))
        return [_Range(p, a, a + self.range) for p, size in wanted for a in range(0, max(size, 1), self.range)] or [_Range("", 0, 0)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        assert isinstance(partition, _Range)
        if not partition.path:
            return
        system = fs.FileSystem.from_uri(self.root)[0] if "://" in self.root or self.root.startswith("file:") else fs.LocalFileSystem()
        with io.BufferedReader(system.open_input_file(partition.path), 1 << 20) as f:
            try:
                yield from self._points(f, partition)
            except (ValueError, KeyError, IndexError) as e:
                raise ValueError(f"{partition.path}: {e}") from e

    def _points(self, f: BinaryIO, part: _Range) -> Iterator[pa.RecordBatch]:
        at = {"binary_npy": _npy, "pcd": _pcd, "ply": _ply}[self.kind](f)
        if at.dtype is not None and not at.columns:
            size = at.dtype.itemsize
            first = max(0, -(-(part.start - at.start) // size))  # points that begin in the range
            last = min(at.count, max(0, -(-(part.stop - at.start) // size)))
            for a in range(first, last, BLOCK):
                n = min(BLOCK, last - a)
                f.seek(at.start + a * size)
                rows = np.frombuffer(self._whole(f, n * size), at.dtype)
                yield self._batch(part.path, a, {c: rows[c] for c in rows.dtype.names or ()})
        elif part.start == 0 and at.dtype is not None:
            size = at.dtype.itemsize * at.count
            columns = {}
            for i, c in enumerate(("x", "y", "z", "intensity")[: at.columns]):
                f.seek(at.start + i * size)
                columns[c] = np.frombuffer(self._whole(f, size), at.dtype)
            for a in range(0, at.count, BLOCK):
                yield self._batch(part.path, a, {c: v[a : a + BLOCK] for c, v in columns.items()})
        elif part.start == 0:
            for a in range(0, at.count, BLOCK):
                rows = np.array([self._line(f, len(at.names)) for _ in range(min(BLOCK, at.count - a))])
                yield self._batch(part.path, a, {c: rows[:, i] for i, c in reversed(list(enumerate(at.names)))})

    @staticmethod
    def _whole(f: BinaryIO, n: int) -> bytes:
        got = f.read(n)
        if len(got) < n:
            raise ValueError("the file is cut short")
        return got

    @staticmethod
    def _line(f: BinaryIO, n: int) -> list[float]:
        words = f.readline().split()
        if len(words) < n:
            raise ValueError("the file is cut short")
        return [float(w) for w in words[:n]]

    @staticmethod
    def _batch(path: str, first: int, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
        n = len(columns["x"])
        extra = next((columns[c] for c in INTENSITY if c in columns), None)
        numbers = [pa.array(columns[c].astype(np.float64)) for c in ("x", "y", "z")]
        last = pa.nulls(n, pa.float64()) if extra is None else pa.array(extra.astype(np.float64))
        return pa.RecordBatch.from_arrays([pa.repeat(path, n), pa.array(np.arange(first, first + n)), *numbers, last], schema=_SCHEMA)


class CloudSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "scenewright_cloud"

    def schema(self) -> str:
        return POINTS

    def reader(self, schema: Any) -> DataSourceReader:
        return _Reader(dict(self.options))
