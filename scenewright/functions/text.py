"""Labels, prompts, digests and number formats as Column builders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Keywords of each canonical class, the first class that matches wins.
CLASS_KEYWORDS = [
    ("sky", ["sky"]),
    ("water", ["water", "sea", "lake", "river", "pool", "waterfall"]),
    ("vegetation", ["tree", "plant", "grass", "flower", "palm", "bush", "field"]),
    ("building", ["building", "house", "skyscraper", "hut", "tower", "roof"]),
    ("person", ["person", "man", "woman", "child", "crowd"]),
    ("vehicle", ["car", "truck", "bus", "van", "boat", "ship", "bicycle", "motorbike", "airplane", "minibike"]),
    ("ground_paved", ["road", "sidewalk", "pavement", "runway", "path", "floor", "court", "parking"]),
    ("ground_natural", ["earth", "ground", "sand", "dirt", "land", "hill", "mountain", "mount", "rock", "stone"]),
    (
        "structure",
        [
            "fence",
            "pole",
            "railing",
            "wall",
            "bridge",
            "bannister",
            "column",
            "rail",
            "signboard",
            "streetlight",
            "street lamp",
            "stair",
            "step",
            "bench",
            "table",
            "chair",
            "sculpture",
            "trash",
            "door",
            "awning",
            "booth",
            "kiosk",
            "solar panel",
            "power line",
            "powerline",
            "cable",
            "wire",
        ],
    ),
]
CLASSES = [*(name for name, _ in CLASS_KEYWORDS), "other"]


def canonical_class(label: Column) -> Column:
    """Class of a free label by keywords that begin a word; "other" if none does."""
    low = F.lower(label)
    case = reduce(lambda c, rule: c.when(low.rlike(r"\b(?:" + "|".join(rule[1]) + ")"), rule[0]), CLASS_KEYWORDS[1:], F.when(low.rlike(r"\b(?:sky)"), "sky"))
    return case.otherwise("other")


def _stripped(text: Column) -> Column:
    """Without blanks and full stops at either end."""
    return F.regexp_replace(text, r"^[ .]+|[ .]+$", "")


def prompt_text(phrases: Column) -> Column:
    return F.concat(F.array_join(F.transform(phrases, lambda p: F.lower(_stripped(p))), ". "), F.lit("."))


def phrase_spans(text: Column, phrases: Column, offsets: Column) -> Column:
    """struct(value, err): for each phrase, in order, the indexes of the tokens (start, end) that overlap it.

    Phrases are looked for one after the other, each from where the one before ends; a missing one is an error.
    """
    start = F.struct(F.lit(1).alias("cursor"), F.array().cast("array<struct<a:int,b:int>>").alias("spans"), F.lit(False).alias("missing"))

    def step(state: Column, phrase: Column) -> Column:
        p = F.lower(_stripped(phrase))
        found = F.expr("0") + F.call_function("locate", p, text, state["cursor"])
        span = F.struct((found - 1).cast("int").alias("a"), (found - 1 + F.length(p)).cast("int").alias("b"))
        return F.struct(
            (found + F.length(p)).cast("int").alias("cursor"),
            F.concat(state["spans"], F.array(span)).alias("spans"),
            (state["missing"] | (found == 0)).alias("missing"),
        )

    done = F.aggregate(phrases, start, step)
    tokens = F.transform(
        done["spans"],
        lambda s: F.filter(F.transform(offsets, lambda o, i: F.when((o["a"] < s["b"]) & (o["b"] > s["a"]) & (o["b"] > o["a"]), i)), lambda i: i.isNotNull()),
    )
    return F.struct(F.when(~done["missing"], tokens).alias("value"), F.when(done["missing"], F.lit("a phrase is missing")).alias("err"))


def digest(*parts: tuple[str, Column]) -> Column:
    """SHA-256 of a JSON object of named parts in the order of their names; null parts are left out."""
    return F.sha2(F.to_json(F.struct(*[c.alias(n) for n, c in sorted(parts, key=lambda p: p[0])])), 256)


def short_hash(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 8)


def six_digits(x: Column) -> Column:
    """A number with six significant digits and no needless zeros; what lies halfway in its shortest decimal form goes up."""
    text = F.format_string("%.6g", x.cast("double"))
    short = F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+($|e)", "$1$2"), r"\.($|e)", "$1")
    return F.when(x.cast("double") == 0, F.lit("0")).when(x.isNotNull(), short)  # a format would write null as a word


def json_object(text: Column) -> Column:
    """The object in an answer: code fences off, or what lies between the first { and the last }."""
    bare = F.trim(F.regexp_replace(text, r"```(?:json)?", ""))
    return F.coalesce(F.when(F.try_parse_json(bare).isNotNull() & bare.startswith("{"), bare), F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit("")))


def ns_of(timestamp: Column) -> Column:
    """"seconds.fraction" as nanoseconds, digits beyond the ninth dropped; no floating point."""
    parts = F.split(timestamp, r"\.", 2)
    return F.get(parts, F.lit(0)).cast("bigint") * 1_000_000_000 + F.substring(
        F.rpad(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), 9, "0"), 1, 9,
    ).cast("bigint")


#: Namespaces of entity ids.
NAMESPACES = ("obj", "part", "wire", "region", "route", "track", "pose")
ID = r"^<(" + "|".join(NAMESPACES) + r")_(\d{3,})>$"


def format_id(namespace: str, number: Column) -> Column:
    if namespace not in NAMESPACES:
        raise ValueError(f"unknown namespace {namespace!r}")
    return F.format_string(f"<{namespace}_%03d>", number.cast("bigint"))


def valid_id(text: Column, namespace: str | None = None) -> Column:
    good = F.coalesce(text.rlike(ID), F.lit(False))
    return good if namespace is None else good & (F.regexp_extract(text, ID, 1) == namespace)


def parse_id(text: Column) -> Column:
    """struct(ns, num), null for what isn't an id."""
    return F.when(valid_id(text), F.struct(F.regexp_extract(text, ID, 1).alias("ns"), F.regexp_extract(text, ID, 2).cast("bigint").alias("num")))


def required(document: Column, path: str) -> Column:
    """struct(value, err): what a JSON document has at a path of names; err tells a missing name from a null value.

    value is JSON text, a string without its quotes. A document that is no JSON object has none of the names.
    """
    root = F.try_parse_json(document)
    err, at = F.lit(None).cast("string"), "$"
    found = []
    for name in path.split("."):
        at += f".{name}"
        found.append((F.try_variant_get(root, at, "variant"), f"missing: {path}"))
    for v, message in reversed(found):
        err = F.when(v.isNull(), message).otherwise(err)
    last = found[-1][0]
    err = F.coalesce(err, F.when(F.is_variant_null(last), f"null: {path}"))
    return F.struct(F.when(err.isNull(), last.try_cast("string")).alias("value"), err.alias("err"))
