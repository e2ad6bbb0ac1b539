"""Queries over documents and cloud files: places of open JSON, documents against schemas, points through texts, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenewright.plans import schemas, shapes
from scenewright.queries import query
from scenewright.sources import clouds, readers
from scenewright.sources import views as V

#: One expression for both engines: a document of an event around its own properties.
_EVENT = (
    """'{"event":' || CAST(event_id AS STRING) || ',"props":' || coalesce(props, 'null') || ',"seen":[' || CAST(user_id AS STRING) || ',{"type":"' || event_type """
    """|| '","none":null}' || CASE WHEN event_id % 3 = 0 THEN ',[[true],{}]' ELSE '' END || '],"rest":{}}'"""
)


@query(
    f"""WITH d AS (SELECT event_id, CAST({_EVENT} AS JSON) AS doc FROM events), t AS (SELECT event_id, t.* FROM d, json_tree(d.doc) AS t)
  SELECT event_id, substr(fullkey, 3) AS path, CASE WHEN type = 'VARCHAR' THEN json_extract_string(value, '$') END AS text,
    CASE WHEN type IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN CAST(value AS DOUBLE) END AS num FROM t WHERE fullkey <> '$'"""
)
def f8_open_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Every place of documents whose shape is not known beforehand."""
    docs = V.table(spark, sf, "events").selectExpr("event_id", f"{_EVENT} AS content")
    return schemas.walk(docs, "event_id", depth=5).select("event_id", "path", "text", "num")


def _relation(i: int) -> str:
    n = f"(p_partkey + {i})"
    return (
        f"""'{{"relation_id":"r","relation_type":"' || CASE WHEN {n} % 4 = 0 THEN 'beside' ELSE 'near' END || '","subject_id":"' || CASE WHEN {n} % 9 = 0 THEN 'obj' """
        f"""ELSE '<obj_' || lpad(CAST(p_size AS STRING), 3, '0') || '>' END || '"' || CASE {n} % 3 WHEN 0 THEN '' WHEN 1 THEN ',"object_id":null' """
        f"""ELSE ',"object_id":"<wire_1>"' END || ',"value":' || CASE p_size % 4 WHEN 0 THEN 'true' WHEN 1 THEN CAST(p_size AS STRING) """
        f"""WHEN 2 THEN '{{"lateral":"left","up":1}}' ELSE 'null' END || ',"uncertainty":' || CAST(p_size - 10 AS STRING) || CASE WHEN p_size % 13 = {i} THEN '' """
        f"""ELSE ',"derivation":{{"program":"p","inputs":[' || CASE WHEN {n} % 8 = 0 THEN '' ELSE '"a"' END || ']}}' END || '}}'"""
    )


#: One expression for both engines: a document of the relation layer, broken in ways that a part's size and key decide.
_LAYER = (
    """'{"schema_version":"' || CASE WHEN p_size % 7 = 0 THEN 'v1' ELSE '0.1.0' END || '","scene_id":"' || CASE WHEN p_size % 11 = 0 THEN '' """
    """ELSE 'scene_' || CAST(p_partkey AS STRING) END || '"' || CASE WHEN p_size % 5 = 0 THEN ',"' || lower(p_brand) || '":1' ELSE '' END || ',"relations":[' || """
    f"""{_relation(0)} || ',' || {_relation(1)} || ']' || CASE WHEN p_size % 6 = 1 THEN '' """
    """ELSE ',"provenance":{"created_at":"t","code_version":"1","l1_entities_ref":"e","own":[]}' END || CASE WHEN p_size = 50 THEN '' ELSE '}' END"""
)
_ID = r"^<(obj|part|wire|region|route|track|pose)_\d{3,}>$"
_TYPES = ", ".join(f"'{t}'" for t in shapes.RELATION_TYPES)


@query(
    f"""WITH t AS (SELECT p_partkey AS k, {_LAYER} AS doc FROM part), d AS (SELECT k, CAST(doc AS JSON) AS j FROM t WHERE json_valid(doc)),
  n AS (SELECT k, j, unnest(range(CAST(json_array_length(j, '$.relations') AS BIGINT))) AS i FROM d),
  r AS (SELECT k, 'relations[' || i || ']' AS p, json_extract(j, '$.relations[' || i || ']') AS r FROM n),
  f AS (SELECT k, '' AS path, 'readable' AS rule FROM t WHERE NOT json_valid(doc)
    UNION ALL SELECT k, key, 'additionalProperties' FROM (SELECT k, unnest(json_keys(j)) AS key FROM d)
      WHERE key NOT IN ('schema_version', 'scene_id', 'metadata_snapshot_id', 'relations', 'cross_view_links', 'provenance')
    UNION ALL SELECT k, v.c, 'required' FROM d, (VALUES ('schema_version'), ('scene_id'), ('relations'), ('provenance')) v(c) WHERE NOT list_contains(json_keys(j), v.c)
    UNION ALL SELECT k, 'schema_version', 'pattern' FROM d WHERE NOT regexp_matches(j->>'schema_version', '^\\d+\\.\\d+\\.\\d+$')
    UNION ALL SELECT k, 'scene_id', 'minLength' FROM d WHERE length(j->>'scene_id') < 1
    UNION ALL SELECT k, p || '.' || v.c, 'required' FROM r, (VALUES ('relation_id'), ('relation_type'), ('subject_id'), ('value'), ('derivation')) v(c)
      WHERE NOT list_contains(json_keys(r), v.c)
    UNION ALL SELECT k, p || '.relation_type', 'enum' FROM r WHERE r->>'relation_type' NOT IN ({_TYPES})
    UNION ALL SELECT k, p || '.' || v.c, 'pattern' FROM r, (VALUES ('subject_id'), ('object_id')) v(c)
      WHERE json_type(r, '$.' || v.c) = 'VARCHAR' AND NOT regexp_matches(json_extract_string(r, '$.' || v.c), '{_ID}')
    UNION ALL SELECT k, p || '.value', 'type' FROM r WHERE json_type(r, '$.value') IN ('NULL', 'ARRAY')
    UNION ALL SELECT k, p || '.value.' || key, 'additionalProperties' FROM (SELECT k, p, unnest(json_keys(r, '$.value')) AS key FROM r)
      WHERE key NOT IN ('longitudinal', 'lateral', 'vertical')
    UNION ALL SELECT k, p || '.uncertainty', 'minimum' FROM r WHERE CAST(r->>'uncertainty' AS DOUBLE) < 0
    UNION ALL SELECT k, p || '.derivation.inputs', 'minItems' FROM r WHERE json_array_length(r, '$.derivation.inputs') < 1)
  SELECT k, path, rule FROM f"""
)
def v2_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Whole documents of the relation layer against their schema: keys that are missing or not allowed, kinds, words, patterns and bounds at every depth."""
    docs = V.table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.expr(_LAYER).alias("content"))
    return schemas.issues(docs, shapes.RELATIONS, "k")


@query(
    V.with_views(
        " SELECT CAST(floor(x / 5) AS BIGINT) AS cell, count(*) AS n, round(avg(y), 6) AS y, round(max(z), 6) AS z, CAST(sum(i) AS BIGINT) AS intensity FROM v_points GROUP BY 1",
        "points",
    )
)
def s5_cloud_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Points of every object written as text and read again as a cloud of four numbers a line."""
    folder = f"{readers.shared_folder(spark)}/clouds-{uuid.uuid4().hex}"
    V.points(spark, sf).select(F.concat_ws(" ", "x", "y", "z", "i")).write.text(folder)
    c = clouds.read_texts(spark, folder, "ascii_xyzi").filter("err IS NULL")
    return c.groupBy(F.floor(F.col("x") / 5).alias("cell")).agg(
        F.count("*").alias("n"), F.round(F.avg("y"), 6).alias("y"), F.round(F.max("z"), 6).alias("z"), F.sum("intensity").cast("bigint").alias("intensity"),
    )
