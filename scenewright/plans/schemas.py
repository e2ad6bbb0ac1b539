"""JSON texts of any shape as rows of their places, and JSON Schemas as rows of rules that these places meet.

A schema's rules are a fixed table as large as the schema, so it is broadcast; documents are opened in a narrow chain of
as many steps as the schema is deep, and nothing is shuffled. Schemas come from files (load) or from plans/shapes.py.
Of JSON Schema (2020-12) the keywords of CHECKED are judged; ANNOTATIONS say nothing about validity. Any other keyword,
alternatives that a value's kind can't tell apart and a schema that refers to itself are errors when the plan is made,
so that no rule is silently left out.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Schema = dict[str, Any]

KINDS = ("null", "object", "array", "string", "boolean", "integer", "number")
CHECKED = {
    "type", "enum", "const", "pattern", "minLength", "maxLength", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "minItems",
    "maxItems", "required", "properties", "additionalProperties", "items", "oneOf", "anyOf", "$ref",
}
ANNOTATIONS = {"$schema", "$id", "$defs", "$comment", "title", "description", "default", "examples"}
#: Steps of a place without its numbers: keys are escaped as in JSON pointers, in which these two can't occur.
ELEMENT, OTHER = "/~2", "/~3"
#: Keywords that are one number or text, and the kinds that they say something about.
BOUNDS = {
    "pattern": ("string",), "minLength": ("string",), "maxLength": ("string",), "minimum": ("integer", "number"), "maximum": ("integer", "number"),
    "exclusiveMinimum": ("integer", "number"), "exclusiveMaximum": ("integer", "number"), "minItems": ("array",), "maxItems": ("array",),
}
RULES = (
    "place string, kinds array<string>, words array<string>, numbers array<double>, flags array<boolean>, none boolean, chosen string, "
    "required array<string>, allowed array<string>, " + ", ".join(f"{b} {'string' if b == 'pattern' else 'double'}" for b in BOUNDS)
)


def load(spark: SparkSession, path: str) -> Schema:
    """The schema in a JSON file of any file system that Spark reads; it is one small row."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


# --- documents ---


def _members(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def _elements(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _number(v: Column) -> Column:
    return F.try_variant_get(v, "$", "double")


def _kind(v: Column) -> Column:
    """One of KINDS; a number without a fraction is an integer. Null for SQL null."""
    scalar = F.schema_of_variant(v)
    return (
        F.when(F.is_variant_null(v), "null")
        .when(_members(v).isNotNull(), "object")
        .when(_elements(v).isNotNull(), "array")
        .when(scalar == "STRING", "string")
        .when(scalar == "BOOLEAN", "boolean")
        .when(v.isNotNull(), F.when(F.floor(_number(v)) == _number(v), "integer").otherwise("number"))
    )


def _places(docs: DataFrame, keys: tuple[str, ...], text_column: str, depth: int) -> DataFrame:
    """_of (the keys), _v, _path, _place and _more of the whole documents and of all that lies at most depth steps below."""
    of = F.struct(*[F.col(f"`{k}`") for k in keys]).alias("_of")  # in one column, so that no name clashes
    holds = lambda v: F.greatest(F.coalesce(F.size(_members(v)), F.lit(0)), F.coalesce(F.size(_elements(v)), F.lit(0))) > 0
    v = F.col("_v")
    rows = docs.select(of, F.try_parse_json(F.col(f"`{text_column}`")).alias("_v"))
    rows = rows.withColumns({"_path": F.lit(""), "_place": F.lit(""), "_more": F.when(v.isNotNull(), holds(v)).otherwise(F.lit(False))})
    key, go = F.col("key"), F.col("_go")
    named = F.when(F.col("_path") == "", key).otherwise(F.concat("_path", F.lit("."), key))
    path = F.when(key.isNull(), F.concat("_path", F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(named)
    step = F.when(key.isNull(), F.lit(ELEMENT)).otherwise(F.concat(F.lit("/"), F.replace(F.replace(key, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))))
    for _ in range(depth):
        # a container stays as it is and is opened beside that; all else only stays
        rows = rows.withColumn("_go", F.explode(F.when(F.col("_more"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
        rows = rows.withColumn("_open", F.when(go, v))
        rows = rows.lateralJoin(docs.sparkSession.tvf.variant_explode_outer(F.col("_open").outer()))
        rows = rows.select(
            "_of",
            F.when(go, F.col("value")).otherwise(v).alias("_v"),
            F.when(go, path).otherwise(F.col("_path")).alias("_path"),
            F.when(go, F.concat("_place", step)).otherwise(F.col("_place")).alias("_place"),
            (go & holds(F.col("value"))).alias("_more"),
        )
    return rows


def walk(docs: DataFrame, *keys: str, text_column: str = "content", depth: int = 8) -> DataFrame:
    """keys, path, kind, text, num and deeper of every place in JSON texts of any shape, whole documents not counted.

    Containers are places too; text is that of strings, num that of numbers. Each of depth steps opens the containers
    that the one before has met. Containers at the last step that still hold something are marked deeper, so nothing is
    left out unseen. Texts that are null, no JSON or name a member twice have one row whose path and kind are null.
    Repeated rows are each walked; other columns don't matter; an empty table gives no rows.
    """
    v, kind = F.col("_v"), F.col("_kind")
    rows = _places(docs, keys, text_column, depth).filter((F.col("_place") != "") | v.isNull()).withColumn("_kind", _kind(v))
    return rows.select(
        "_of.*",
        F.when(v.isNotNull(), F.col("_path")).alias("path"),
        kind.alias("kind"),
        F.when(kind == "string", F.try_variant_get(v, "$", "string")).alias("text"),
        F.when(kind.isin("integer", "number"), _number(v)).alias("num"),
        F.col("_more").alias("deeper"),
    )


# --- schemas ---


def _kinds(schema: Schema) -> set[str]:
    """Kinds that a schema's own type, enum and const leave."""
    kinds = set(KINDS)
    if "type" in schema:
        named = {schema["type"]} if isinstance(schema["type"], str) else set(schema["type"])
        kinds = named | ({"integer"} if "number" in named else set())
    if "enum" in schema or "const" in schema:
        kinds &= {k for x in _choices(schema) for k in _kinds_of(x)}
    return kinds


def _choices(schema: Schema) -> list[Any]:
    return list(schema["enum"]) if "enum" in schema else [schema["const"]]


def _kinds_of(x: Any) -> tuple[str, ...]:
    if x is None:
        return ("null",)
    if isinstance(x, bool):
        return ("boolean",)
    if isinstance(x, int | float):
        return ("integer", "number")
    if isinstance(x, str):
        return ("string",)
    raise ValueError("enum and const take strings, booleans, numbers and null only")


def _merged(schema: Schema, root: Schema, seen: tuple[str, ...] = ()) -> tuple[Schema, tuple[str, ...]]:
    """A schema with its reference followed and alternatives of different kinds made one, and the references on the way.

    A keyword other than type, enum and const says something about one kind only, so alternatives that share no kind
    can stand together.
    """
    unknown = set(schema) - CHECKED - ANNOTATIONS
    if unknown:
        raise ValueError(f"keywords that are not judged: {sorted(unknown)}")
    schema = {k: x for k, x in schema.items() if k in CHECKED}
    if "$ref" in schema:
        name = schema["$ref"]
        if name in seen:
            raise ValueError(f"{name} refers to itself")
        if len(schema) > 1 or not name.startswith("#/"):
            raise ValueError(f"{name}: references stand alone and point into their own file")
        target: Any = root
        for step in name[2:].split("/"):
            target = target[step]
        return _merged(target, root, (*seen, name))
    for word in ("oneOf", "anyOf"):
        if word not in schema:
            continue
        one: Schema = {"type": []}
        for option in schema[word]:
            s, more = _merged(option, root, seen)
            seen = (*seen, *more)
            kinds = _kinds(s)
            if kinds & set(one["type"]) or (set(s) - {"type"}) & set(one):
                raise ValueError(f"{word}: alternatives must be of different kinds")
            one = one | s | {"type": [*one["type"], *sorted(kinds)]}
        if ("enum" in one or "const" in one) and len(schema[word]) > 1:
            raise ValueError(f"{word}: alternatives with enum or const are not judged")
        if set(schema) - {word, "type"} or ("type" in schema and not set(one["type"]) <= _kinds({"type": schema["type"]})):
            raise ValueError(f"{word} stands alone")
        return one, seen
    return schema, seen


def rules(schema: Schema) -> list[dict[str, Any]]:
    """One row of RULES for each place that a schema says something about."""
    out: list[dict[str, Any]] = []

    def add(s: Schema, place: str, seen: tuple[str, ...]) -> None:
        s, seen = _merged(s, schema, seen)
        row: dict[str, Any] = {"place": place, "required": list(s.get("required", []))}
        if "type" in s:
            row["kinds"] = sorted(_kinds({"type": s["type"]}))
        if "enum" in s or "const" in s:
            row["chosen"] = "enum" if "enum" in s else "const"
            by = {k: [x for x in _choices(s) if _kinds_of(x)[0] == k] for k in ("string", "integer", "boolean", "null")}
            row |= {"words": by["string"], "numbers": [float(x) for x in by["integer"]], "flags": by["boolean"], "none": bool(by["null"])}
        row |= {b: s[b] if b == "pattern" else float(s[b]) for b in BOUNDS if b in s}
        given, more = s.get("properties", {}), s.get("additionalProperties", True)
        if more is False:
            row["allowed"] = list(given)
        out.append(row)
        for name, below in given.items():
            add(below, f"{place}/{name.replace('~', '~0').replace('/', '~1')}", seen)
        if isinstance(more, dict):
            if {"properties", "items", "oneOf", "anyOf"} & set(_merged(more, schema, seen)[0]):
                raise ValueError("additionalProperties takes plain values only")
            add(more, place + OTHER, seen)
        if "items" in s:
            add(s["items"], place + ELEMENT, seen)

    add(schema, "", ())
    return out


def _broken() -> Column:
    """array of (key, rule) of a place and its rules: what is broken, and the member that it is about, if any."""
    v, kind = F.col("_v"), F.col("_kind")
    word = F.try_variant_get(v, "$", "string")
    chosen = (
        F.when(kind == "string", F.array_contains("words", word))
        .when(kind == "boolean", F.array_contains("flags", F.try_variant_get(v, "$", "boolean")))
        .when(kind.isin("integer", "number"), F.array_contains("numbers", _number(v)))
        .otherwise((kind == "null") & F.col("none"))
    )
    size, length = F.size(_elements(v)), F.char_length(word)
    holds = {
        "pattern": F.expr("try_variant_get(_v, '$', 'string') RLIKE pattern"),
        "minLength": length >= F.col("minLength"),
        "maxLength": length <= F.col("maxLength"),
        "minimum": _number(v) >= F.col("minimum"),
        "maximum": _number(v) <= F.col("maximum"),
        "exclusiveMinimum": _number(v) > F.col("exclusiveMinimum"),
        "exclusiveMaximum": _number(v) < F.col("exclusiveMaximum"),
        "minItems": size >= F.col("minItems"),
        "maxItems": size <= F.col("maxItems"),
    }
    itself = lambda rule: F.struct(F.lit(None).cast("string").alias("key"), rule.alias("rule"))
    of = lambda rule: lambda k: F.struct(k.alias("key"), F.lit(rule).alias("rule"))
    no = lambda ok: ~F.coalesce(ok, F.lit(False))
    unread = F.array(itself(F.lit("readable")))  # only a whole text has no value
    found = [F.when(F.col("kinds").isNotNull() & no(F.array_contains("kinds", kind)), itself(F.lit("type")))]
    found.append(F.when(F.col("chosen").isNotNull() & no(chosen), itself(F.col("chosen"))))
    found += [F.when(F.col(b).isNotNull() & kind.isin(*BOUNDS[b]) & no(ok), itself(F.lit(b))) for b, ok in holds.items()]
    named = F.map_keys(_members(v))
    none = F.array().cast("array<struct<key:string,rule:string>>")
    return F.when(v.isNull(), unread).otherwise(F.concat(
        F.filter(F.array(*found), lambda i: i.isNotNull()),
        F.when(kind == "object", F.transform(F.array_except("required", named), of("required"))).otherwise(none),
        F.coalesce(F.when(kind == "object", F.transform(F.array_except(named, "allowed"), of("additionalProperties"))), none),
    ))


def issues(docs: DataFrame, schema: Schema, *keys: str, text_column: str = "content") -> DataFrame:
    """keys, path and rule (a keyword) of everything that a schema refuses in the JSON texts of a column.

    Keys that are missing or not allowed have their own path; the whole document's path is empty. Alternatives are judged
    by the one of the value's kind. A text that is null or no JSON, or that names a member twice, is one row with the
    rule "readable". Other columns don't matter. An empty table gives no rows; repeated rows are each judged.
    """
    found = rules(schema)
    names = [r.split()[0] for r in RULES.split(", ")]
    table = docs.sparkSession.createDataFrame([tuple(r.get(n) for n in names) for r in found], RULES)
    depth = max(r["place"].count("/") for r in found)
    rows = _places(docs, keys, text_column, depth).withColumn("_kind", _kind(F.col("_v")))
    maps = [r["place"].removesuffix(OTHER) for r in found if r["place"].endswith(OTHER)]
    if maps:
        known = [r["place"] for r in found]
        up = F.regexp_extract("_place", "^(.*)/[^/]*$", 1)
        other = up.isin(*maps) & ~F.col("_place").isin(*known) & (F.col("_place") != "")
        rows = rows.withColumn("_place", F.when(other, F.concat(up, F.lit(OTHER))).otherwise(F.col("_place")))
    judged = rows.join(F.broadcast(table), F.col("_place") == F.col("place")).select("_of", "_path", F.explode(_broken()).alias("_i"))
    below = F.when(F.col("_i.key").isNull(), F.col("_path")).when(F.col("_path") == "", F.col("_i.key")).otherwise(F.concat("_path", F.lit("."), F.col("_i.key")))
    return judged.select("_of.*", below.alias("path"), F.col("_i.rule").alias("rule"))
