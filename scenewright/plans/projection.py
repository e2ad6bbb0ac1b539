"""Projection of nested rows to dotted paths, and their leaves, both built from the schema when the plan is made."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, NumericType, StringType, StructType

LEAF = "array<struct<path:string,text:string,num:double>>"


def trie(paths: list[str]) -> dict[str, Any]:
    """Paths as nested dicts; an empty dict takes all that lies below."""
    root: dict[str, Any] = {}
    for path in sorted(paths, key=lambda p: p.count("."), reverse=True):
        node, parts = root, path.split(".")
        for i, part in enumerate(parts):
            node = node.setdefault(part, {})
            if i == len(parts) - 1:
                node.clear()
    return root


def _leaf_paths(kind: DataType, node: dict[str, Any]) -> list[tuple[str, ...]] | None:
    """Paths below a struct that can be reached by field access alone; None if a list of structs is on the way."""
    out: list[tuple[str, ...]] = []
    for name, below in node.items():
        if name not in kind.names:
            continue
        of = kind[name].dataType
        if below and isinstance(of, StructType):
            inner = _leaf_paths(of, below)
            if inner is None:
                return None
            out += [(name, *p) for p in inner]
        elif below and isinstance(of, ArrayType) and isinstance(of.elementType, StructType):
            return None
        elif not below:
            out.append((name,))
    return out


def project(col: Column, kind: DataType, node: dict[str, Any]) -> Column | None:
    """col with the fields of node alone; lists keep their length and order. Paths that the schema lacks are passed
    over; None if nothing is left.

    Of a list of structs each wanted field is extracted on its own and the extractions are zipped, so that the scan
    reads these fields only; a lambda over the whole element would make it read the hidden ones too.
    """
    if not node:
        return col
    if isinstance(kind, StructType):
        parts = [(n, project(col[n], kind[n].dataType, below)) for n, below in node.items() if n in kind.names]
        parts = [(n, c) for n, c in parts if c is not None]
        return F.struct(*[c.alias(n) for n, c in parts]) if parts else None
    if isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType):
        paths = _leaf_paths(kind.elementType, node)
        if paths is None:
            inner = kind.elementType
            return None if project(F.lit(None), inner, {}) is None else F.transform(col, lambda e: project(e, inner, node))
        if not paths:
            return None

        def extracted(path: tuple[str, ...]) -> Column:
            c = col
            for name in path:
                c = c[name]
            return c

        zipped = F.arrays_zip(*[extracted(p).alias("__".join(p)) for p in paths])

        def rebuilt(e: Column, below: dict[str, Any], at: tuple[str, ...]) -> Column:
            fields = []
            for name, under in below.items():
                here = (*at, name)
                if here in paths:
                    fields.append(e["__".join(here)].alias(name))
                elif any(p[: len(here)] == here for p in paths):
                    fields.append(rebuilt(e, under, here).alias(name))
            return F.struct(*fields)

        return F.transform(zipped, lambda e: rebuilt(e, node, ()))
    return None


def leaves(col: Column, kind: DataType, path: Column | str = "", skip: tuple[str, ...] = ()) -> Column:
    """array of (path, text, num) of every string and number below col; list places in brackets. skip: top names left out."""
    where = path if isinstance(path, Column) else F.lit(path)
    if isinstance(kind, StructType):
        parts = []
        for f in kind.fields:
            if f.name in skip:
                continue
            below = f.name if not isinstance(path, Column) and path == "" else F.concat(where, F.lit(f".{f.name}"))
            parts.append(leaves(col[f.name], f.dataType, below))
        return F.concat(*parts) if parts else F.array().cast(LEAF)
    if isinstance(kind, ArrayType):
        of = kind.elementType
        return F.coalesce(
            F.flatten(F.transform(col, lambda e, i: leaves(e, of, F.concat(where, F.lit("["), i.cast("string"), F.lit("]"))))), F.array().cast(LEAF),
        )
    if isinstance(kind, StringType):
        return F.when(
            col.isNotNull(), F.array(F.struct(where.alias("path"), col.alias("text"), F.lit(None).cast("double").alias("num"))),
        ).otherwise(F.array().cast(LEAF))
    if isinstance(kind, NumericType):
        return F.when(
            col.isNotNull(), F.array(F.struct(where.alias("path"), F.lit(None).cast("string").alias("text"), col.cast("double").alias("num"))),
        ).otherwise(F.array().cast(LEAF))
    return F.array().cast(LEAF)


def keys(kind: DataType) -> set[str]:
    """All field names below a type."""
    if isinstance(kind, StructType):
        return {f.name for f in kind.fields} | {k for f in kind.fields for k in keys(f.dataType)}
    return keys(kind.elementType) if isinstance(kind, ArrayType) else set()
