"""Queries over relations in space, views, alignment, matching across sources and specifications as rows, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scenewright.functions import geometry as G
from scenewright.operators import alignment, calibration, matching, relations, surfaces, visibility
from scenewright.plans import compiler, errors, specs
from scenewright.queries import query
from scenewright.sources import views as V

# --- relations of boxes ---

_BOXES = """, bx AS (SELECT scene_id, object_id AS id, [x, y, z] AS c, [ex*4, ey*4, ez*4] AS e,
    [[cos(t), sin(t), 0.0], [-sin(t)*cos(u), cos(t)*cos(u), sin(u)], [sin(t)*sin(u), -cos(t)*sin(u), cos(u)]] AS ax
    FROM (SELECT *, radians(30.0*(pos % 12)) AS t, radians(10.0*(pos % 4)) AS u FROM v_objects))"""
_REACH_SQL = "(abs(list_inner_product({b}.ax[1], {u}))*{b}.e[1] + abs(list_inner_product({b}.ax[2], {u}))*{b}.e[2] + abs(list_inner_product({b}.ax[3], {u}))*{b}.e[3])/2"
_NEAR, _TOLERANCE = 2.0, 0.05


def _inside_sql(a: str, b: str) -> str:
    return " AND ".join(f"abs(list_inner_product({a}.ax[{k}], d)) + {_REACH_SQL.format(b=b, u=f'{a}.ax[{k}]')} <= {a}.e[{k}]/2 + {_TOLERANCE}" for k in (1, 2, 3))


def _stands_sql(low: str, up: str) -> str:
    return f"abs({up}_lo[3] - {low}_hi[3]) <= {_TOLERANCE} AND " + " AND ".join(f"{up}_lo[{i}] < {low}_hi[{i}] AND {low}_lo[{i}] < {up}_hi[{i}]" for i in (1, 2))


def _corner_sql(b: str, sign: str) -> str:
    units = ("[1.0, 0.0, 0.0]", "[0.0, 1.0, 0.0]", "[0.0, 0.0, 1.0]")
    return "[" + ", ".join(f"{b}.c[{i + 1}] {sign} {_REACH_SQL.format(b=b, u=u)}" for i, u in enumerate(units)) + "]"


_ALL_PAIRS = f"""{_BOXES},
  pr AS (SELECT a.scene_id, a, b, [b.c[1] - a.c[1], b.c[2] - a.c[2], b.c[3] - a.c[3]] AS d,
    {_corner_sql("a", "-")} AS a_lo, {_corner_sql("a", "+")} AS a_hi, {_corner_sql("b", "-")} AS b_lo, {_corner_sql("b", "+")} AS b_hi
    FROM bx a JOIN bx b ON a.scene_id = b.scene_id AND a.id < b.id),
  gp AS (SELECT *, list_max(list_transform(list_filter(list_concat([[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]], a.ax, b.ax, flatten(list_transform(a.ax, lambda u: list_transform(b.ax,
      lambda v: [u[2]*v[3] - u[3]*v[2], u[3]*v[1] - u[1]*v[3], u[1]*v[2] - u[2]*v[1]])))), lambda u: sqrt(list_inner_product(u, u)) > {relations.PARALLEL}),
      lambda u: (abs(list_inner_product(u, d)) - {_REACH_SQL.format(b="a", u="u")} - {_REACH_SQL.format(b="b", u="u")})/sqrt(list_inner_product(u, u)))) AS gap FROM pr),
  rl AS (SELECT scene_id, CASE WHEN gap < -{_TOLERANCE} THEN 'intersect' WHEN gap <= {_TOLERANCE} THEN 'adjacent' ELSE 'near' END AS relation_type, a.id AS subject_id,
      b.id AS object_id, gap FROM gp WHERE gap <= {_NEAR}
    UNION ALL SELECT scene_id, 'contain', a.id, b.id, gap FROM gp WHERE {_inside_sql("a", "b")}
    UNION ALL SELECT scene_id, 'contain', b.id, a.id, gap FROM gp WHERE {_inside_sql("b", "a")}
    UNION ALL SELECT scene_id, 'support', a.id, b.id, gap FROM gp WHERE {_stands_sql("a", "b")}
    UNION ALL SELECT scene_id, 'support', b.id, a.id, gap FROM gp WHERE {_stands_sql("b", "a")})"""


def _boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Objects as boxes, turned about the vertical and tilted."""
    t, u = F.radians((F.col("pos") % 12) * 30.0), F.radians((F.col("pos") % 4) * 10.0)
    c, s, ct, st = F.cos(t), F.sin(t), F.cos(u), F.sin(u)
    axes = F.array(G.vec(c, s, 0), G.vec(-s * ct, c * ct, st), G.vec(s * st, -c * st, ct))
    extent = F.array(*[F.col(e) * 4 for e in ("ex", "ey", "ez")])
    return V.objects(spark, sf).select("scene_id", F.col("object_id").alias("entity_id"), F.array("x", "y", "z").alias("center"), axes.alias("axes"), extent.alias("extent"))


@query(V.with_views(_ALL_PAIRS + " SELECT scene_id, relation_type, subject_id, object_id, round(gap, 6) AS gap FROM rl", "objects"))
def l2_spatial_relations(spark: SparkSession, sf: str) -> DataFrame:
    """All relations of a scene's boxes; the SQL tries every pair."""
    return relations.spatial_relations(_boxes(spark, sf), _NEAR, _TOLERANCE).withColumn("gap", F.round("gap", 6))


# --- views ---

_CELL = 8
_SEEN = f""", cm AS (SELECT DISTINCT scene_id, f.frame, radians(40.0*f.frame) AS t FROM v_points, range(0, 3) AS f(frame)),
  pt AS (SELECT p.scene_id, c.frame, p.pos AS entity_id, p.x + 200*sin(t) AS dx, p.y AS dy, p.z + 200*cos(t) AS dz, t FROM v_points p JOIN cm c USING (scene_id)),
  pj AS (SELECT *, dx*sin(t) + dz*cos(t) AS depth, 400*(dx*cos(t) - dz*sin(t)) AS un, 400*dy AS vn FROM pt),
  se AS (SELECT scene_id, frame, entity_id, CAST(floor((un/depth + 160)/{_CELL}) AS BIGINT) AS px, CAST(floor((vn/depth + 120)/{_CELL}) AS BIGINT) AS py, depth FROM pj
    WHERE depth > 0.1 AND un/depth + 160 >= 0 AND un/depth + 160 < 320 AND vn/depth + 120 >= 0 AND vn/depth + 120 < 240),
  bu AS (SELECT scene_id, frame, px, py, min(depth) AS fd, arg_min(entity_id, (depth, entity_id)) AS front FROM se GROUP BY ALL),
  ju AS (SELECT se.*, front, depth > fd + 0.05 AND entity_id <> front AS hidden FROM se JOIN bu USING (scene_id, frame, px, py))"""


def _cameras(points: DataFrame) -> DataFrame:
    """Three cameras of every scene, 200 metres from its origin and looking at it."""
    t = F.radians(F.col("frame") * 40.0)
    c, s = F.cos(t), F.sin(t)
    pose = F.array(G.vec4_of(c, 0, s, -200 * s), G.vec4_of(0, 1, 0, 0), G.vec4_of(-s, 0, c, -200 * c), G.vec4(0, 0, 0, 1))
    k = F.array(G.vec(400, 0, 160), G.vec(0, 400, 120), G.vec(0, 0, 1))
    frames = points.select("scene_id").distinct().withColumn("frame", F.explode(F.array(*[F.lit(i).cast("bigint") for i in range(3)])))
    return frames.select("scene_id", "frame", pose.alias("pose"), k.alias("k"), F.lit(240).alias("height"), F.lit(320).alias("width"))


def _seen(spark: SparkSession, sf: str) -> DataFrame:
    points = V.points(spark, sf)
    return visibility.seen_points(points.withColumnRenamed("pos", "entity_id"), _cameras(points), _CELL)


@query(
    V.with_views(
        _SEEN + " SELECT scene_id, frame, entity_id, count(*) AS n_points, count(*) FILTER (NOT hidden) AS n_visible, "
        "round(count(*) FILTER (NOT hidden)/count(*), 6) AS share, count(*) FILTER (NOT hidden)/count(*) >= 0.5 AS visible FROM ju GROUP BY ALL",
        "points",
    )
)
def l2_visible_from(spark: SparkSession, sf: str) -> DataFrame:
    seen = _seen(spark, sf)
    return visibility.visible_from(seen, visibility.depth_buffer(seen), least=0.5).withColumn("share", F.round("share", 6))


@query(
    V.with_views(
        _SEEN + ", al AS (SELECT scene_id, frame, entity_id, count(*) AS n FROM se GROUP BY ALL) SELECT scene_id, frame, front AS subject_id, entity_id AS object_id, "
        "count(*) AS n_hidden, round(count(*)/max(n), 6) AS share FROM ju JOIN al USING (scene_id, frame, entity_id) WHERE hidden GROUP BY ALL HAVING count(*)/max(n) >= 0.1",
        "points",
    )
)
def l2_occlusions(spark: SparkSession, sf: str) -> DataFrame:
    seen = _seen(spark, sf)
    return visibility.occlusions(seen, visibility.depth_buffer(seen)).withColumn("share", F.round("share", 6))


# --- alignment ---

_FITTED = ("scale", "r00", "r10", "shift_x", "shift_y", "shift_z")


@query(
    V.with_views(
        " SELECT scene_id, count(*) AS n_pairs, count(*) FILTER (i % 7 <> 3) AS n_used, round(1 + pos_k/10, 6) AS scale, round(cos(radians(20.0*pos_k)), 6) AS r00, "
        "round(sin(radians(20.0*pos_k)), 6) AS r10, CAST(1000*pos_k AS DOUBLE) AS shift_x, CAST(-pos_k AS DOUBLE) AS shift_y, 2.0*pos_k AS shift_z, true AS close "
        "FROM (SELECT *, CAST(split_part(scene_id, '_', 2) AS BIGINT) AS pos_k FROM v_points) GROUP BY scene_id, pos_k",
        "points",
    )
)
def l0_similarity(spark: SparkSession, sf: str) -> DataFrame:
    """Each scene's points against themselves scaled, turned and moved, one in seven of them wrongly paired; the SQL says what was done to them."""
    k = F.split_part("scene_id", F.lit("_"), F.lit(2)).cast("bigint")
    t, s = F.radians(k * 20.0), 1 + k / 10
    wrong = F.when(F.col("i") % 7 == 3, 50.0 + F.col("pos") % 11 * 9.0).otherwise(0.0)
    pairs = V.points(spark, sf).select(
        "scene_id",
        *[F.col(c).alias(f"a{c}") for c in "xyz"],
        (s * (F.cos(t) * F.col("x") - F.sin(t) * F.col("y")) + 1000 * k + wrong).alias("bx"),
        (s * (F.sin(t) * F.col("x") + F.cos(t) * F.col("y")) - k - wrong).alias("by"),
        (s * F.col("z") + 2 * k + wrong * 2).alias("bz"),
    )
    fit = alignment.similarity(pairs, ["scene_id"])
    cells: list[Column] = [F.col("scale"), *[F.get("rotation", F.lit(i)) for i in (0, 3)], *[F.get("shift", F.lit(i)) for i in range(3)]]
    return fit.select("scene_id", "n_pairs", "n_used", *[F.round(c, 6).alias(n) for c, n in zip(cells, _FITTED, strict=True)], (F.col("rmse") < 1e-6).alias("close"))


# --- matching across sources ---


@query(
    V.with_views(
        ", t AS (SELECT run, ts_ns + 250000000 AS at, max(frame_id) AS fix, arg_max(value, frame_id) AS fix_value FROM v_frames WHERE frame_id % 3 = 0 GROUP BY ALL) "
        "SELECT f.frame_id, coalesce(t.at, -1) AS as_of_ts, coalesce(t.fix, -1) AS fix, t.fix_value FROM v_frames f ASOF LEFT JOIN t ON f.run = t.run AND f.ts_ns >= t.at",
        "frames",
    )
)
def j_track_as_of(spark: SparkSession, sf: str) -> DataFrame:
    """For each frame the last track row of its run at or before it; -1 where there is none."""
    f = V.frames(spark, sf)
    track = f.filter("frame_id % 3 = 0").select("run", (F.col("ts_ns") + 250_000_000).alias("ts_ns"), F.col("frame_id").alias("fix"), F.col("value").alias("fix_value"))
    got = matching.as_of(f, track, ["run"], "ts_ns", ["fix", "fix_value"], "fix", 60_000_000_000)
    return got.select("frame_id", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("as_of_ts", "fix")], "fix_value")


_PLACES = """, p AS (SELECT run, frame_id AS id, value + 40*(frame_id % 25) AS x, user_id + 40.0*(frame_id % 17) AS y FROM v_frames)"""


@query(
    V.with_views(
        _PLACES + """, d AS (SELECT a.run, a.id, b.run AS other_run, b.id AS other_id, sqrt((a.x - b.x)**2 + (a.y - b.y)**2) AS d FROM p a JOIN p b
    ON a.run <> b.run AND abs(a.x - b.x) <= 10 AND abs(a.y - b.y) <= 10)
  SELECT run, id, other_run, other_id, round(d, 6) AS distance FROM d WHERE d <= 10 QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, other_run, other_id) = 1""",
        "frames",
    )
)
def j_nearest_runs(spark: SparkSession, sf: str) -> DataFrame:
    """For each frame the nearest one of another run within ten metres; the SQL tries all of them."""
    x, y = F.col("value") + 40 * (F.col("frame_id") % 25), F.col("user_id") + 40.0 * (F.col("frame_id") % 17)
    places = V.frames(spark, sf).select("run", F.col("frame_id").alias("id"), x.alias("x"), y.alias("y"))
    return matching.nearest_of_other_runs(places, 10.0).withColumn("distance", F.round("distance", 6))


# --- specifications and codes as rows ---

_VISIBLE = "string_split(p_name, ' ')"


@query(
    f"""WITH s AS (SELECT *, {_VISIBLE} AS v, CASE WHEN p_size % 7 = 0 THEN [] WHEN p_size % 3 = 0 THEN [split_part(p_name, ' ', 1)]
      WHEN p_size % 5 = 1 THEN [split_part(p_name, ' ', 1) || '.deep'] ELSE ['answer'] END AS h FROM part)
    SELECT p_partkey, problem FROM s, LATERAL (SELECT unnest(CASE WHEN p_partkey % 50 = 0 THEN ['not a mapping'] WHEN p_partkey % 50 = 1 THEN ['missing keys: checker, output_schema']
      ELSE list_filter([
        CASE WHEN p_type NOT IN ('ECONOMY', 'STANDARD', 'PROMO') THEN 'unknown generation mode' END,
        CASE WHEN p_brand IN ('Brand#1', 'Brand#4') THEN 'unknown supervision level' END,
        CASE WHEN len(h) = 0 THEN 'nothing is hidden' END,
        CASE WHEN len(list_intersect(v, h)) > 0 THEN 'a hidden field is visible' END,
        CASE WHEN list_contains(v, 'ring') THEN 'a forbidden field is visible' END,
        CASE WHEN len(list_filter(h, lambda x: list_contains(v, replace(x, '.deep', '')) AND x LIKE '%.deep')) > 0 THEN 'a visible field holds a hidden one' END,
        CASE WHEN p_retailprice > 950 AND p_partkey % 3 <> 0 THEN 'a tolerance in metres needs a metric scene' END,
        CASE WHEN p_size < 10 THEN 'no reason for three dimensions' END,
        CASE WHEN p_partkey % 4 = 0 AND p_size > 20 THEN 'no signals of low altitude' END], lambda x: x IS NOT NULL) END) AS problem)"""
)
def s15_task_specs(spark: SparkSession, sf: str) -> DataFrame:
    """One specification for each part, as a JSON document, with what is wrong with it."""
    k, size, first = F.col("p_partkey"), F.col("p_size"), F.split_part("p_name", F.lit(" "), F.lit(1))
    none = F.array().cast("array<string>")
    hidden = F.when(size % 7 == 0, none).when(size % 3 == 0, F.array(first)).when(size % 5 == 1, F.array(F.concat(first, F.lit(".deep")))).otherwise(F.array(F.lit("answer")))
    part = V.table(spark, sf, "part").withColumn("type", F.col("p_type"))
    mode = F.create_map(*[F.lit(x) for pair in (("ECONOMY", "program_first"), ("STANDARD", "hybrid"), ("PROMO", "model_first_constrained")) for x in pair])
    good = specs.load_all(set(compiler.PROGRAMS), compiler.CHECKERS)[0].raw
    text = lambda name: F.lit(good[name])
    fields = {
        "task_id": F.col("p_name"),
        "version": F.lit("0.1.0"),
        "task_family": F.lit("x"),
        "generation_mode": F.coalesce(F.try_element_at(mode, F.col("type")), F.col("type")),
        "three_d_necessity": F.struct(F.when(size < 10, " ").otherwise("so").alias("rationale"), F.array(F.lit("c")).alias("conditions")),
        "required_scene_capabilities": F.struct(F.when(k % 3 == 0, "metric").otherwise("relative").alias("scale_status")),
        "visual_input_policy": F.struct(F.lit(2).alias("min_views")),
        "metadata_input_fields": F.split("p_name", " "),
        "hidden_target_fields": hidden,
        "derivation_program": text("derivation_program"),
        "checker": text("checker"),
        "output_schema": text("output_schema"),
        "leakage_rules": F.struct(F.array(F.lit("ring")).alias("forbidden_input_fields")),
        "eligibility": F.struct(F.lit(1).alias("x")),
        "quality_requirements": F.struct(F.when(F.col("p_retailprice") > 950, F.lit(0.5)).alias("numeric_tolerance_m")),
        "supervision_level": F.when(F.col("p_brand").isin("Brand#1", "Brand#4"), "some").otherwise("weak"),
        "target_anchor": F.struct(F.lit("k").alias("kind")),
        "low_altitude_specificity": F.when(k % 4 == 0, F.struct(F.lit("r").alias("rationale"), F.when(size > 20, none).otherwise(F.array(F.lit("s"))).alias("signals"))),
    }
    whole = F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))
    fewer = F.to_json(F.struct(*[c.alias(n) for n, c in fields.items() if n not in ("checker", "output_schema")]))
    rows = part.select("p_partkey", F.when(k % 50 == 0, F.lit("[1, 2]")).when(k % 50 == 1, fewer).otherwise(whole).alias("spec"))
    return specs.judged(rows, "p_partkey", "spec", set(compiler.PROGRAMS), compiler.CHECKERS)


_CODES = list(errors.CODES.items())
_CODE_ROWS = ", ".join(f"({i}, '{c}', '{n}', '{c[:2]}', '{'warn' if c[3] == 'W' else 'quarantine'}')" for i, (n, c) in enumerate(_CODES))


@query(
    f"WITH c AS (SELECT * FROM (VALUES {_CODE_ROWS}) t(i, code, name, gate, gate_status)) SELECT o_orderstatus AS batch, gate, gate_status, name, count(*) AS n "
    f"FROM orders JOIN c ON o_orderkey % {len(_CODES) + 3} = i GROUP BY ALL UNION ALL SELECT o_orderstatus, NULL, 'quarantine', NULL, count(*) FROM orders "
    f"WHERE o_orderkey % {len(_CODES) + 3} >= {len(_CODES)} GROUP BY ALL"
)
def p14_gate_status(spark: SparkSession, sf: str) -> DataFrame:
    """What the gates make of the codes that were found in batches of data, some of them in no catalogue."""
    found = V.table(spark, sf, "orders").select(
        F.col("o_orderstatus").alias("batch"), F.coalesce(F.get(F.array(*[F.lit(c) for _, c in _CODES]), (F.col("o_orderkey") % (len(_CODES) + 3)).cast("int")), F.lit("G9-X00")).alias("code")
    )
    return errors.judged(found).groupBy("batch", "gate", "gate_status", "name").agg(F.count("*").alias("n"))


# --- calibration ---

_SCORES = """WITH s AS (SELECT l_returnflag, l_linenumber, (l_partkey % 101)/100.0::DOUBLE AS s, (l_orderkey*7 + l_suppkey*3) % 101 < l_partkey % 101 AS t FROM lineitem),
  r AS (SELECT *, rank() OVER (PARTITION BY l_returnflag, l_linenumber ORDER BY s) + (count(*) OVER (PARTITION BY l_returnflag, l_linenumber, s) - 1)/2.0 AS r FROM s),
  b AS (SELECT l_returnflag, l_linenumber, least(floor(s*10), 9) AS bin, abs(sum(s) - count(*) FILTER (t)) AS gap FROM s GROUP BY ALL),
  e AS (SELECT l_returnflag, l_linenumber, sum(gap) AS gap FROM b GROUP BY ALL),
  g AS (SELECT l_returnflag, l_linenumber, count(*) AS n, count(*) FILTER (t) AS p, count(*) FILTER (NOT t) AS q, sum(r) FILTER (t) AS rs, avg((s - t::INT)**2) AS brier FROM r GROUP BY ALL)"""


@query(
    _SCORES + " SELECT l_returnflag, l_linenumber, n AS n_rows, 0::BIGINT AS n_bad, p AS n_true, q AS n_false, CASE WHEN p > 0 AND q > 0 THEN round((rs - p*(p + 1)/2.0)/(p*q), 9) END AS auc, "
    "round(brier, 9) AS brier, round(gap/n, 9) AS ece, CASE WHEN p = 0 OR q = 0 THEN 'one truth only' END AS err FROM g JOIN e USING (l_returnflag, l_linenumber)"
)
def a_calibration(spark: SparkSession, sf: str) -> DataFrame:
    """How well a score foretells the truth, by scene and condition; the SQL takes the area from ranks."""
    line, part = V.table(spark, sf, "lineitem"), F.col("l_partkey") % 101
    rows = line.select("l_returnflag", "l_linenumber", (part / 100.0).alias("s"), ((F.col("l_orderkey") * 7 + F.col("l_suppkey") * 3) % 101 < part).alias("t"))
    got = calibration.calibration(rows, ["l_returnflag", "l_linenumber"], "s", "t")
    return got.withColumns({c: F.round(c, 9) for c in ("auc", "brier", "ece")})


# --- surfaces ---


@query(
    V.with_views(
        """, c AS (SELECT pos, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, var_pop(x) AS a, var_pop(y) AS b, var_pop(z) AS c, covar_pop(x, y) AS d,
    covar_pop(x, z) AS e, covar_pop(y, z) AS f FROM v_points GROUP BY pos),
  q AS (SELECT *, (a+b+c)/3 AS q, d*d+e*e+f*f AS p1 FROM c), r AS (SELECT *, sqrt(((a-q)**2 + (b-q)**2 + (c-q)**2 + 2*p1)/6) AS p FROM q),
  t AS (SELECT *, acos(greatest(-1.0, least(1.0, (((a-q)/p)*(((b-q)/p)*((c-q)/p) - (f/p)*(f/p)) - (d/p)*((d/p)*((c-q)/p) - (f/p)*(e/p)) + (e/p)*((d/p)*(f/p) -
    ((b-q)/p)*(e/p)))/2)))/3 AS phi FROM r), l AS (SELECT *, q + 2*p*cos(phi + 2*pi()/3) AS low FROM t),
  m AS (SELECT *, a - low AS aa, b - low AS bb, c - low AS cc FROM l),
  k AS (SELECT *, [d*f - e*bb, e*d - aa*f, aa*bb - d*d] AS k1, [d*cc - e*f, e*e - aa*cc, aa*f - d*e] AS k2, [bb*cc - f*f, f*e - d*cc, d*f - bb*e] AS k3 FROM m),
  s AS (SELECT *, list_inner_product(k1, k1) AS s1, list_inner_product(k2, k2) AS s2, list_inner_product(k3, k3) AS s3 FROM k),
  u AS (SELECT *, CASE WHEN s1 >= s2 AND s1 >= s3 THEN k1 WHEN s2 >= s3 THEN k2 ELSE k3 END AS w, sqrt(greatest(s1, s2, s3)) AS size FROM s),
  v AS (SELECT pos, n, low, mx, my, mz, [x / size * CASE WHEN w[3] < 0 THEN -1 ELSE 1 END FOR x IN w] AS v FROM u),
  far AS (SELECT pos, quantile_cont(abs(v[1]*(x-mx) + v[2]*(y-my) + v[3]*(z-mz)), 0.95) AS p95 FROM v_points JOIN v USING (pos) GROUP BY pos)
  SELECT pos, n, round(degrees(acos(v[3])), 4) AS slope_deg, round(degrees(atan2(v[1], v[2])), 4) AS aspect_deg, round(v[1]*mx + v[2]*my + v[3]*mz, 4) AS offset_m,
    round(sqrt(low), 4) AS roughness_m, round(p95, 4) AS p95_m FROM v JOIN far USING (pos)""",
        "points",
    )
)
def l1_planes(spark: SparkSession, sf: str) -> DataFrame:
    """Planes of least squares through the points of every object; the SQL finds the normal by the cubic formula and cross products."""
    p = surfaces.planes(V.points(spark, sf), ["pos"], soft=0, hard=0)
    return p.select(
        "pos",
        F.col("n_points").alias("n"),
        *[F.round(c, 4).alias(c) for c in ("slope_deg", "aspect_deg", "offset_m", "roughness_m")],
        F.round("planarity_residual_p95_m", 4).alias("p95_m"),
    )


@query(
    V.with_views(
        """, b AS (SELECT frame, min(y) - 1 AS y0, max(y) + 1 AS y1, min(x) - 1 AS x0, max(x) + 1 AS x1 FROM v_pixels GROUP BY frame),
  g AS (SELECT frame, y, unnest(range(x0, x1 + 1)) AS x FROM (SELECT *, unnest(range(y0, y1 + 1)) AS y FROM b)),
  o AS (SELECT g.* FROM g ANTI JOIN v_pixels p ON g.frame = p.frame AND g.y = p.y AND g.x = p.x),
  d AS (SELECT p.frame, p.y, p.x, min((p.y - o.y)**2 + (p.x - o.x)**2) AS far2 FROM v_pixels p JOIN o ON p.frame = o.frame GROUP BY ALL),
  k AS (SELECT *, count(*) OVER (PARTITION BY frame) AS n, row_number() OVER (PARTITION BY frame ORDER BY far2 DESC, y, x) AS r FROM d)
  SELECT frame, n * 0.25 AS area_m2, y AS i, x AS j, round(sqrt(far2) * 0.5, 6) AS radius_m FROM k WHERE r = 1""",
        "pixels",
    )
)
def l1_inscribed_circles(spark: SparkSession, sf: str) -> DataFrame:
    """The largest circle within the pixels that each frame has, half a metre a pixel; the SQL compares every pixel with every missing one."""
    cells = V.pixels(spark, sf).select("frame", F.col("y").alias("i"), F.col("x").alias("j"))
    return surfaces.inscribed_circles(cells, ["frame"], 0.5).withColumn("radius_m", F.round("radius_m", 6))
