"""Queries over the fixed scene view for summaries, references, readings and scalar rules, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sketchgraph.functions import geometry as g
from sketchgraph.functions import text as t
from sketchgraph.model import as_json, from_json
from sketchgraph.operators import control, evaluate, export, fusion, identity, model_json, summary, topology
from sketchgraph.plans.oracle import _ATTACHED, _CROSSED, _HOLDERS, _LENGTH, _PARENTS, SCENE, _corners, _inside, _iou, _outline_distance, _points, _shared
from sketchgraph.sources.scenes import order_scenes, outlined, predicted

QUERIES, ORACLE_SQL = {}, {}
Z = "z AS (SELECT 1) "


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


_KINDS = "string_agg(n || ' ' || replace(type, '_', ' ') || CASE WHEN n > 1 THEN 's' ELSE '' END, ', ' ORDER BY type)"
_KEPT = f""", kept AS (SELECT c.* FROM connections c
  JOIN (SELECT image_id, connection_id, count(DISTINCT ref) AS n, count(*) FILTER (text_id IS NULL AND side = 'boundary') AS b FROM attached GROUP BY ALL) a ON a.image_id = c.image_id AND a.connection_id = c.id
  WHERE c.heavy OR c.type <> 'line' OR a.n >= 2 OR a.b > 0 OR {_LENGTH} >= 192 OR EXISTS (SELECT 1 FROM crossed x WHERE x.image_id = c.image_id AND x.connection_id = c.id)),
ref AS (SELECT a.image_id, a.connection_id AS id, max(ref) FILTER (pos = 0) AS a, max(ref) FILTER (pos = 1) AS b FROM attached a JOIN kept k ON k.image_id = a.image_id AND k.id = a.connection_id GROUP BY ALL),
{_points(3).replace("points AS", "steps3 AS", 1).replace("FROM connections c", "FROM kept c")},
label AS (SELECT image_id, id, connection_id FROM (SELECT *, row_number() OVER (PARTITION BY image_id, id ORDER BY round(d, 6), c_ord) AS r FROM (
  SELECT t.image_id, t.id, p.id AS connection_id, p.ord AS c_ord, min(sqrt((px - t.x - t.w / 2) * (px - t.x - t.w / 2) + (py - t.y - t.h / 2) * (py - t.y - t.h / 2))) - greatest(t.w, t.h) / 2 AS d
  FROM texts t JOIN steps3 p ON t.image_id = p.image_id WHERE NOT EXISTS (SELECT 1 FROM attached a JOIN kept k ON k.image_id = a.image_id AND k.id = a.connection_id WHERE a.image_id = t.image_id AND a.text_id = t.id) GROUP BY t.image_id, t.id, p.id, p.ord, t.w, t.h
  ) WHERE d <= CAST(0.8 AS DOUBLE) * 16) WHERE r = 1)"""
_PAIRS = f"""pairs AS (SELECT image_id, a, b, CASE WHEN o > 0.03 THEN 'overlaps' ELSE 'touches' END AS relation FROM (
  SELECT a.image_id, a.id AS a, b.id AS b, {_shared('a', 'b')} / least(a.w * a.h, b.w * b.h) AS o, least({_corners('a', 'b')}, {_corners('b', 'a')}) AS d FROM shapes a JOIN shapes b ON a.image_id = b.image_id AND a.ord < b.ord
    AND a.x - 6 < b.x + b.w + 6 AND b.x - 6 < a.x + a.w + 6 AND a.y - 6 < b.y + b.h + 6 AND b.y - 6 < a.y + a.h + 6
  WHERE NOT EXISTS (SELECT 1 FROM ancestors n WHERE n.image_id = a.image_id AND ((n.id = a.id AND n.ancestor = b.id) OR (n.id = b.id AND n.ancestor = a.id)))
) WHERE o > CAST(0.03 AS DOUBLE) OR d <= 5)"""


@query(SCENE + _PARENTS + ", " + _HOLDERS + ", " + _ATTACHED + ", " + _CROSSED + _KEPT + ", " + _PAIRS + """, every AS (
  SELECT image_id, 'contains' AS type, parent_id AS s, id AS o FROM parents UNION SELECT image_id, 'contains', inside_shape_id, id FROM held
  UNION SELECT image_id, 'near', id, s_id FROM close_ WHERE k <= 3 UNION SELECT image_id, 'labels', id, connection_id FROM label
  UNION SELECT image_id, relation, a, b FROM pairs UNION SELECT image_id, 'connected', a, b FROM ref WHERE a IS NOT NULL AND b IS NOT NULL AND a <> b
) SELECT image_id, type, count(*) AS n FROM every GROUP BY ALL""")  # fmt: skip
def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relation counts of each drawing by type, after the whole topology."""
    return topology.updated(order_scenes(spark, sf_dir)).relations.groupBy("image_id", "type").agg(F.count("*").alias("n"))


@query(SCENE + Z + ", pts AS (SELECT image_id, id, type, heavy, [CAST(round_even(1000 * ax / 1200, 0) AS INT), CAST(round_even(1000 * ay / 900, 0) AS INT)] AS p, [CAST(round_even(1000 * bx / 1200, 0) AS INT), CAST(round_even(1000 * by_ / 900, 0) AS INT)] AS q, ord FROM connections), box AS (SELECT image_id, ord, id, 0 AS part, type, '' AS text, x, y, w, h FROM shapes UNION ALL SELECT image_id, ord, id, 1, '', text, x, y, w, h FROM texts), n AS (SELECT *, [CAST(round_even(1000 * x / 1200, 0) AS INT), CAST(round_even(1000 * y / 900, 0) AS INT), CAST(round_even(1000 * (x + w) / 1200, 0) AS INT), CAST(round_even(1000 * (y + h) / 900, 0) AS INT)] AS b FROM box)," + """
s AS (SELECT image_id, list({'id': id, 'type': type, 'bbox': b, 'parent': CAST(NULL AS VARCHAR), 'crossed_out': false} ORDER BY ord) AS v FROM n WHERE part = 0 GROUP BY 1),
t AS (SELECT image_id, list({'id': id, 'text': text, 'bbox': b, 'inside': CAST(NULL AS VARCHAR), 'near': CAST([] AS VARCHAR[]), 'crossed_out': false} ORDER BY ord) AS v FROM n WHERE part = 1 GROUP BY 1),
c AS (SELECT image_id, list({'id': id, 'type': type, 'heavy': heavy, 'ends': CAST([NULL, NULL] AS VARCHAR[]), 'path': [p, q]} ORDER BY ord) AS v FROM pts GROUP BY 1),
j AS (SELECT i.image_id, CAST(to_json({'is_drawing': true, 'shapes': coalesce(s.v, []), 'texts': coalesce(t.v, []), 'connections': coalesce(c.v, []), 'summary': ''}) AS VARCHAR) AS target FROM images i LEFT JOIN s USING (image_id) LEFT JOIN t USING (image_id) LEFT JOIN c USING (image_id))
SELECT printf('syn_%06d', image_id) AS id, CAST(to_json([{'role': 'system', 'content': 'You read drawings.'}, {'role': 'user', 'content': '<image>' || chr(10) || 'Describe it as JSON.'}, {'role': 'assistant', 'content': target}]) AS VARCHAR) AS messages FROM j""")  # fmt: skip
def chat_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training chats: the drawing's compact target as the assistant's answer."""
    s = order_scenes(spark, sf_dir)
    return export.chat_samples(model_json.targets(s), "You read drawings.", "Describe it as JSON.").select("id", F.to_json("messages").alias("messages"))


@query(SCENE + Z + f", p AS (SELECT image_id, sum(2 * (w + h)) AS l, count(*) FILTER (greatest(w, h) > 24) AS long, avg(ink_density) AS d FROM shapes GROUP BY 1), q AS (SELECT i.image_id, coalesce(l, 0) * 2 / (1200 * 900) AS ink, 40 + 60 * coalesce(d, 0) AS sat, coalesce(long, 0) AS n FROM images i LEFT JOIN p USING (image_id)), r AS (SELECT image_id, CASE WHEN ink > CAST(0.003 AS DOUBLE) AND ink < CAST(0.25 AS DOUBLE) THEN CAST(0.4 AS DOUBLE) ELSE 0 END + CASE WHEN sat < 70 THEN CAST(0.3 AS DOUBLE) ELSE 0 END + CASE WHEN n >= 1 THEN CAST(0.3 AS DOUBLE) ELSE 0 END AS score FROM q) SELECT image_id, round(score, 3) AS score, round(score, 3) >= 0.6 AS is_drawing FROM r")
def triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each scene looks like a drawing, from the ink of its outlines."""
    s = order_scenes(spark, sf_dir)
    long = F.count_if(F.greatest("bbox.w", "bbox.h") > 12 * F.lit(2.0)).alias("long_strokes")
    stats = s.shapes.groupBy("image_id").agg(F.sum(2 * (F.col("bbox.w") + F.col("bbox.h"))).alias("l"), long, F.avg("ink_density").alias("d"))
    rows = s.images.select("image_id").join(stats, "image_id", "left").select("image_id", (F.coalesce("l", F.lit(0.0)) * 2 / (1200 * 900)).alias("ink"), (40 + 60 * F.coalesce("d", F.lit(0.0))).alias("saturation"), F.coalesce("long_strokes", F.lit(0)).alias("long_strokes"))
    return summary.triage(rows).select("image_id", "score", "is_drawing")


@query(SCENE + "c AS (SELECT l_orderkey AS image_id, CAST(rn AS INT) AS ord, 'S' || rn AS id, CAST(0.5 AS DOUBLE) + l_tax AS confidence FROM l JOIN part ON l_partkey = p_partkey) SELECT image_id, string_agg(id, ',' ORDER BY ord) AS ids FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY ord) AS r FROM c WHERE confidence < CAST(0.6 AS DOUBLE)) WHERE r <= 15 GROUP BY 1")
def unsure_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.unsure_shapes(order_scenes(spark, sf_dir).shapes).select("image_id", F.array_join("ids", ",").alias("ids"))


@query(SCENE + Z + "SELECT image_id, count(*) AS connectors, count(*) FILTER (heavy) AS heavy, count(*) FILTER (type = 'arrow') AS arrows FROM connections GROUP BY 1")
def connector_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.connector_counts(order_scenes(spark, sf_dir).connections)


@query(SCENE + Z + "SELECT image_id, round(least(60, greatest(6, quantile_cont(h, 0.6))), 4) AS text_height FROM shapes WHERE h >= 4 AND h <= 80 GROUP BY 1")
def text_height(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes as the blobs of a page: the 60th percentile of their heights."""
    blobs = order_scenes(spark, sf_dir).shapes.select("image_id", F.col("bbox.h").alias("h"))
    return summary.text_height(blobs, F.lit(2.0)).select("image_id", F.round("text_height", 4).alias("text_height"))


@query(SCENE + Z + ", r AS (SELECT image_id, (sum(CASE WHEN h > 2 * w THEN w * h ELSE 0 END) + 1) / (sum(CASE WHEN w > 2 * h THEN w * h ELSE 0 END) + 1) AS ratio FROM shapes GROUP BY 1) SELECT image_id, CASE WHEN ratio > 2 THEN 90 ELSE 0 END AS rotation, round(least(1, ln(CASE WHEN ratio > 2 THEN ratio ELSE 1 / greatest(ratio, 1e-6) END) / ln(20)), 6) AS confidence FROM r")
def page_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turn that a page's blobs suggest."""
    b = order_scenes(spark, sf_dir).shapes.select("image_id", F.col("bbox.w").alias("w"), F.col("bbox.h").alias("h"), g.box_area(F.col("bbox")).alias("area"))
    return summary.rotation_of(summary.direction_ratio(b)).select("image_id", "rotation", F.round("confidence", 6).alias("confidence"))


@query(SCENE + _HOLDERS + ", " + _ATTACHED + ", " + _CROSSED + _KEPT + """ SELECT t.image_id, t.id FROM texts t LEFT JOIN held h USING (image_id, id) LEFT JOIN near n USING (image_id, id) LEFT JOIN label b USING (image_id, id)
WHERE t.ord = 1 OR h.id IS NOT NULL OR n.id IS NOT NULL OR b.id IS NOT NULL OR EXISTS (SELECT 1 FROM attached a JOIN kept k ON k.image_id = a.image_id AND k.id = a.connection_id WHERE a.image_id = t.image_id AND a.text_id = t.id)""")  # fmt: skip
def target_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second text taken as prose: it stays only where the drawing uses it."""
    s = order_scenes(spark, sf_dir)
    s = topology.with_placement(s.with_(texts=s.texts.withColumn("source", F.when(F.col("ord") == 2, F.array(F.lit("para"))).otherwise(F.array(F.lit("cv"))))))
    s = topology.with_labels(topology.kept(topology.pruned(topology.with_attachment(s))))
    return summary.target_texts(s.texts, s.connections).select("image_id", "id")


@query(SCENE + _PARENTS + f""", k AS (SELECT image_id, {_KINDS} AS kinds, sum(n) AS n FROM (SELECT image_id, type, count(*) AS n FROM shapes GROUP BY ALL) GROUP BY 1),
low AS (SELECT image_id, string_agg(id, ', ' ORDER BY ord) AS ids FROM (SELECT l_orderkey AS image_id, rn AS ord, 'S' || rn AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY rn) AS r FROM l JOIN part ON l_partkey = p_partkey WHERE CAST(0.5 AS DOUBLE) + l_tax < CAST(0.6 AS DOUBLE)) WHERE r <= 15 GROUP BY 1),
x AS (SELECT image_id, count(*) AS n, count(*) FILTER (text <> '') AS r FROM texts GROUP BY 1)
SELECT i.image_id, concat_ws(chr(10), 'facts: shapes, topology', printf('image: 1200x900, rotation %d', i.rotation), printf('shapes: %d (%s), max depth %d', CAST(coalesce(k.n, 0) AS INT), coalesce(k.kinds, 'none'), coalesce(d.d, 0)), printf('connections: %d, texts: %d (%d transcribed)', coalesce(c.n, 0), x.n, x.r), 'low-confidence shapes: ' || low.ids) AS state
FROM images i LEFT JOIN k USING (image_id) LEFT JOIN low USING (image_id) LEFT JOIN x USING (image_id) LEFT JOIN (SELECT image_id, count(*) AS n FROM connections GROUP BY 1) c USING (image_id) LEFT JOIN (SELECT image_id, max(depth) AS d FROM depths GROUP BY 1) d USING (image_id)""")  # fmt: skip
def state_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = order_scenes(spark, sf_dir)
    s = s.with_(shapes=topology.with_containment(s.shapes))
    return summary.state_lines(s, topology.stats(s).drop("shape_types"), ["topology", "shapes"])


@query(SCENE + _PARENTS + f""", k AS (SELECT image_id, {_KINDS} AS kinds FROM (SELECT image_id, type, count(*) AS n FROM shapes GROUP BY ALL) GROUP BY 1), d AS (SELECT image_id, max(depth) AS d FROM depths GROUP BY 1), x AS (SELECT image_id, string_agg(text, ', ' ORDER BY ord) AS labels FROM texts WHERE text <> '' GROUP BY 1)
SELECT k.image_id, kinds || CASE WHEN d.d > 0 THEN printf(', nested %d deep', d.d) ELSE '' END || CASE WHEN labels IS NOT NULL THEN '; labels: ' || labels ELSE '' END AS summary FROM k JOIN d USING (image_id) LEFT JOIN x USING (image_id)""")  # fmt: skip
def scene_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = order_scenes(spark, sf_dir)
    return summary.scene_summary(topology.with_containment(s.shapes), s.texts)


@query(SCENE + _ATTACHED + ", r AS (SELECT image_id, connection_id, list_sort(list_distinct(list(ref) FILTER (ref IS NOT NULL))) AS ids FROM attached GROUP BY ALL) SELECT DISTINCT image_id, array_to_string(ids, ',') AS ids FROM r WHERE len(ids) > 0")
def joined_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = topology.with_attachment(order_scenes(spark, sf_dir))
    return summary.joined_sets(s.connections).select("image_id", F.array_join("ids", ",").alias("ids"))


@query(SCENE + _PARENTS + """, walk AS (SELECT s.image_id, s.id, [s.ord] AS path FROM shapes s WHERE NOT EXISTS (SELECT 1 FROM parents p WHERE p.image_id = s.image_id AND p.id = s.id)
  UNION ALL SELECT s.image_id, s.id, list_append(w.path, s.ord) FROM walk w JOIN parents p ON p.image_id = w.image_id AND p.parent_id = w.id JOIN shapes s ON s.image_id = p.image_id AND s.id = p.id)
SELECT image_id, id, len(path) - 1 AS depth, row_number() OVER (PARTITION BY image_id ORDER BY path) AS position FROM walk""")  # fmt: skip
def reading_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapes in the order of a walk through their nesting."""
    s = order_scenes(spark, sf_dir)
    return summary.reading_walk(s.shapes, topology.ancestors(topology.parents(s.shapes)))


@query(SCENE + _ATTACHED + ", r AS (SELECT image_id, connection_id AS id, max(ref) FILTER (pos = 0) AS a, max(ref) FILTER (pos = 1) AS b FROM attached GROUP BY ALL) SELECT image_id, id, a, b FROM r WHERE a IS NOT NULL AND b IS NOT NULL AND a <> b")
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges that DOT and Mermaid draw: each end of a connector with the next."""
    s = topology.with_attachment(order_scenes(spark, sf_dir))
    return summary.consecutive_ends(s.connections).select("image_id", "id", "a", "b")


@query(SCENE + Z + """, m AS (SELECT image_id, id, unnest([x, x + w, x + w, x]) AS px, unnest([y, y, y + h, y + h]) AS py FROM shapes), q AS (SELECT image_id, id, round_even(CAST(0.5 AS DOUBLE) * px + CAST(0.25 AS DOUBLE) * py + 10, 1) AS x, round_even(CAST(-0.25 AS DOUBLE) * px + CAST(0.5 AS DOUBLE) * py + 400, 1) AS y FROM m)
SELECT image_id, id, round(min(x), 4) AS x, round(min(y), 4) AS y, round(max(x) - min(x), 4) AS w, round(max(y) - min(y), 4) AS h FROM q GROUP BY ALL""")  # fmt: skip
def affine_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes after a page is warped."""
    s = order_scenes(spark, sf_dir).shapes
    b = summary.affine_box(F.col("bbox"), [0.5, 0.25, 10.0, -0.25, 0.5, 400.0])
    return s.select("image_id", "id", b.alias("bbox")).select("image_id", "id", *(F.round(f"bbox.{c}", 4).alias(c) for c in "xywh"))


@query(SCENE + Z + "SELECT image_id, id, CAST(floor(((ord * CAST(0.618033988749895 AS DOUBLE)) % 1) * 180) AS INT) AS hue, round_even((x - 3) / 7, 1) AS x, round_even((y - 3) / 7, 1) AS y, round_even((w + 6) / 7, 1) AS w FROM shapes")
def mark_hues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlay colours, and widened boxes rounded to one decimal."""
    s = order_scenes(spark, sf_dir).shapes
    b = g.expand(F.col("bbox"), F.lit(3.0))
    return s.select("image_id", "id", summary.hue(F.col("ord")).alias("hue"), *(g.half_even(b[c] / 7, 1).alias(c) for c in "xyw"))


@query(SCENE + _ATTACHED + """, names AS (SELECT image_id, id AS old, 'S' || row_number() OVER (PARTITION BY image_id ORDER BY round_even(y / 40, 0), x, ord) AS new FROM shapes UNION ALL SELECT image_id, id, 'T' || row_number() OVER (PARTITION BY image_id ORDER BY round_even(y / 40, 0), x, ord) FROM texts
  UNION ALL SELECT image_id, id, 'C' || row_number() OVER (PARTITION BY image_id ORDER BY round_even(least(ay, by_) / 40, 0), least(ax, bx), ord) FROM connections)
SELECT a.image_id, n.new AS id, a.pos, s.new AS shape_id, t.new AS text_id FROM (SELECT e.*, x.shape_id FROM attached e LEFT JOIN end_shape x USING (image_id, connection_id, pos)) a JOIN names n ON n.image_id = a.image_id AND n.old = a.connection_id
LEFT JOIN names s ON s.image_id = a.image_id AND s.old = a.shape_id LEFT JOIN names t ON t.image_id = a.image_id AND t.old = a.text_id""")  # fmt: skip
def renumbered_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connectors' ends after renumbering: their own ids and those that they refer to."""
    s = identity.renumbered(topology.with_attachment(order_scenes(spark, sf_dir)))
    return s.connections.select("image_id", "id", F.posexplode("endpoints").alias("pos", "e")).select("image_id", "id", "pos", "e.shape_id", "e.text_id")


@query(SCENE + Z + "SELECT image_id, id, type, x, y, w, h FROM shapes")
def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenes written as JSON and read again."""
    s = order_scenes(spark, sf_dir)
    return from_json(as_json(s), s).shapes.select("image_id", "id", "type", "bbox.*")


@query(SCENE + _PARENTS + """, c AS (SELECT image_id, parent_id AS id, count(*) AS children FROM parents GROUP BY ALL)
SELECT s.image_id, s.id, p.type AS parent_type, coalesce(c.children, 0) AS children, x.parent_id IS NULL AS is_root FROM shapes s LEFT JOIN parents x USING (image_id, id) LEFT JOIN shapes p ON p.image_id = x.image_id AND p.id = x.parent_id LEFT JOIN c ON c.image_id = s.image_id AND c.id = s.id""")  # fmt: skip
def family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each shape's parent, looked up, and how many children it has."""
    s = topology.with_containment(order_scenes(spark, sf_dir).shapes)
    parent = s.select("image_id", F.col("id").alias("parent_id"), F.col("type").alias("parent_type"))
    children = s.where("parent_id is not null").groupBy("image_id", F.col("parent_id").alias("id")).agg(F.count("*").alias("children"))
    return s.join(parent, ["image_id", "parent_id"], "left").join(children, ["image_id", "id"], "left").select("image_id", "id", "parent_type", F.coalesce("children", F.lit(0)).alias("children"), F.col("parent_id").isNull().alias("is_root"))


@query(SCENE + Z + f", m AS (SELECT t.image_id, t.id, t.ord, t.text, t.x + t.ord * 6 AS x, t.y, t.w, t.h FROM texts t) SELECT b.image_id, b.id, a.text FROM m b LEFT JOIN texts a ON a.image_id = b.image_id AND a.ord = (SELECT o.ord FROM texts o WHERE o.image_id = b.image_id AND {_iou('o', 'b')} > CAST(0.6 AS DOUBLE) ORDER BY {_iou('o', 'b')} DESC, o.ord LIMIT 1) WHERE NOT EXISTS (SELECT 1 FROM texts k WHERE k.image_id = b.image_id AND k.ord = 2 AND k.image_id % 3 = 0 AND {_iou('k', 'b')} > 0.5)")
def carried_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions found again, six pixels a place to the right: they inherit texts, but none over a kept one."""
    x = order_scenes(spark, sf_dir).texts
    moved = F.struct((F.col("bbox.x") + F.col("ord") * 6.0).alias("x"), F.col("bbox.y").alias("y"), F.col("bbox.w").alias("w"), F.col("bbox.h").alias("h"))
    fresh = x.withColumn("bbox", moved).withColumn("text", F.lit(None).cast("string"))
    return fusion.carried_over(x, x.where("ord = 2 and image_id % 3 = 0"), fresh).select("image_id", "id", "text")


@query(SCENE + Z + ", a AS (SELECT image_id, id, ord, CASE WHEN l_returnflag = 'R' THEN 'vlm' ELSE 'cv' END AS o FROM shapes) SELECT image_id, id, 'cv' AS origin FROM a WHERE ord % 2 = 0 UNION ALL SELECT image_id, id, 'vlm' FROM a WHERE o = 'vlm' AND ord % 2 = 1")
def replaced_by_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new scan replaces what the old one found; what a model read stays."""
    s = order_scenes(spark, sf_dir).shapes
    old = s.where("ord % 2 = 1").withColumn("source", F.when(F.array_contains("source", "vlm"), F.array(F.lit("vlm"))).otherwise(F.array(F.lit("cv"))))
    new = s.where("ord % 2 = 0").withColumn("source", F.array(F.lit("cv")))
    return fusion.replaced(old, new, "cv").select("image_id", "id", F.element_at("source", 1).alias("origin"))


@query(SCENE + Z + ", q AS (SELECT image_id, id, ord, CASE WHEN ord = 1 THEN text END AS text, CASE WHEN image_id % 2 = 0 THEN CAST(0.4 AS DOUBLE) ELSE CAST(0.9 AS DOUBLE) END AS c FROM texts) SELECT image_id, id FROM q WHERE text IS NULL OR c < 0.5")
def reading_todo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that need a reader: without words, or unsure."""
    x = order_scenes(spark, sf_dir).texts.withColumn("text", F.when(F.col("ord") == 1, F.col("text"))).withColumn("confidence", F.when(F.col("image_id") % 2 == 0, 0.4).otherwise(0.9))
    return control.to_read(x.withColumn("source", F.array(F.lit("cv")))).select("image_id", "id")


@query(SCENE + Z + ", r AS (SELECT image_id, id, text, row_number() OVER (PARTITION BY image_id ORDER BY y, x, ord) AS rank FROM texts) SELECT image_id, CASE WHEN image_id % 2 = 0 THEN id ELSE (SELECT o.id FROM r o WHERE o.image_id = r.image_id AND o.rank = r.rank) END AS id, 'read ' || text AS text FROM r")
def placed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a reader put to their texts: by id in even drawings, by place in the batch in odd ones, unknown ids dropped."""
    x = order_scenes(spark, sf_dir).texts.withColumn("placement", F.lit("free"))
    batches = control.reading_batches(x)
    item = F.struct(F.when(F.col("image_id") % 2 == 0, F.col("id")).otherwise("").alias("id"), F.concat(F.lit("read "), "text").alias("text"))
    listed = batches.groupBy("image_id", "batch").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", item.alias("i")))), lambda r: r["i"]).alias("items"))
    more = F.when(F.col("image_id") % 2 == 0, F.concat("items", F.array(F.struct(F.lit("T99").alias("id"), F.lit("none").alias("text"))))).otherwise(F.col("items"))
    return control.placed_answers(batches, listed.withColumn("items", more))


@query(SCENE + Z + """, p AS (SELECT a.image_id, a.id, a.text AS t, CASE WHEN a.ord = 1 THEN substr(a.text, 2) ELSE lower(a.text) END AS p FROM texts a WHERE a.image_id % 5 <> 0), e AS (SELECT count(*) AS matched, avg(levenshtein(t, p) / length(t)) AS cer, count(*) FILTER (lower(t) = lower(p)) AS exact FROM p WHERE t <> '' AND p <> '')
SELECT matched, round(cer, 4) AS cer, round(exact / matched, 4) AS exact FROM e""")  # fmt: skip
def text_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean error rate and exact share of a second reading of the texts."""
    x = order_scenes(spark, sf_dir).texts.where("image_id % 5 <> 0")
    rows = x.select(F.col("text").alias("t"), F.when(F.col("ord") == 1, F.expr("substr(text, 2)")).otherwise(F.lower("text")).alias("p")).where("t <> '' and p <> ''")
    out = rows.agg(F.count("*").alias("matched"), F.avg(t.character_error_rate(F.col("t"), F.col("p"))).alias("cer"), F.count_if(t.same_text(F.col("t"), F.col("p"))).alias("exact"))
    return out.select("matched", F.round("cer", 4).alias("cer"), evaluate.share(F.col("exact"), F.col("matched")).alias("exact"))


@query(SCENE + _ATTACHED + """, r AS (SELECT a.image_id, a.connection_id, max(ref) FILTER (pos = 0) AS a, max(ref) FILTER (pos = 1) AS b, max(c.ord) AS ord FROM attached a JOIN connections c ON c.image_id = a.image_id AND c.id = a.connection_id GROUP BY ALL),
s AS (SELECT DISTINCT image_id, least(a, b) AS a, greatest(a, b) AS b, ord FROM r WHERE a IS NOT NULL AND b IS NOT NULL AND a <> b), t AS (SELECT DISTINCT image_id, a, b FROM s), p AS (SELECT DISTINCT image_id, a, b FROM s WHERE ord % 2 = 1 UNION SELECT image_id, a, 'X' || b FROM s WHERE ord % 2 = 0),
j AS (SELECT coalesce(t.image_id, p.image_id) AS image_id, t.a AS t, p.a AS p FROM t FULL JOIN p ON t.image_id = p.image_id AND t.a = p.a AND t.b = p.b) SELECT image_id, count(*) FILTER (t IS NOT NULL AND p IS NOT NULL) AS tp, count(*) FILTER (t IS NULL) AS fp, count(*) FILTER (p IS NULL) AS fn FROM j GROUP BY 1""")  # fmt: skip
def connection_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unordered pairs joined by connectors against a reading whose even connectors end elsewhere."""
    s = topology.with_attachment(order_scenes(spark, sf_dir))
    true = evaluate.joined_pairs(s.connections)
    even = evaluate.joined_pairs(s.connections.where("ord % 2 = 0")).withColumn("b", F.concat(F.lit("X"), "b"))
    pred = evaluate.joined_pairs(s.connections.where("ord % 2 = 1")).unionByName(even)
    return evaluate.set_counts(true, pred, ["image_id", "a", "b"])


@query(SCENE + Z + "SELECT c.image_id, c.id, least(ax, bx) AS x, least(ay, by_) AS y, abs(bx - ax) AS w, abs(by_ - ay) AS h FROM connections c")
def connector_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boxes of connectors: of the path, or of the ends where there is none."""
    c = order_scenes(spark, sf_dir).connections.withColumn("path", F.when(F.col("ord") % 2 == 0, F.array().cast(g.POINTS)).otherwise(F.col("path")))
    return c.select("image_id", "id", identity.connector_box().alias("b")).select("image_id", "id", "b.*")


@query(SCENE + Z + f"SELECT s.image_id, s.id, t.id AS text_id, round(CASE WHEN {_inside('s', '(t.x + t.w / 2)', '(t.y + t.h / 2)')} THEN 1 ELSE -1 END * {_outline_distance('s', '(t.x + t.w / 2)', '(t.y + t.h / 2)').replace('CASE', '(CASE', 1)}), 4) AS d FROM shapes s JOIN texts t ON t.image_id = s.image_id")
def signed_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each text's centre lies within each shape, negative outside."""
    s = order_scenes(spark, sf_dir)
    at = s.texts.select("image_id", F.col("id").alias("text_id"), g.center(F.col("bbox")).alias("at"))
    return s.shapes.join(at, "image_id").select("image_id", "id", "text_id", (F.round(g.signed_distance(F.col("polygon"), F.col("at.x"), F.col("at.y")), 4) + 0.0).alias("d"))


@query(SCENE + Z + "SELECT image_id, id, least(greatest(x * CAST(1.2 AS DOUBLE), 0), 1200) AS x, least(greatest(y * CAST(0.9 AS DOUBLE), 0), 900) AS y, least(greatest(x * (CAST(1200 AS DOUBLE) / 600), 0), 1200) AS px, least(greatest(y * (CAST(900 AS DOUBLE) / 450), 0), 900) AS py FROM shapes")
def model_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points as a model gives them, in thousandths and in pixels of a smaller copy, on the page."""
    s = order_scenes(spark, sf_dir)
    v = F.array(F.col("bbox.x"), F.col("bbox.y"))
    page = (F.col("width"), F.col("height"))
    sent = F.struct(F.lit(600.0).alias("w"), F.lit(450.0).alias("h"))
    rows = s.shapes.join(s.images, "image_id").select("image_id", "id", g.point_from_model(v, *page).alias("a"), g.point_from_model(v, *page, F.lit("xyxy_pixels"), sent).alias("b"))
    return rows.select("image_id", "id", F.col("a.x").alias("x"), F.col("a.y").alias("y"), F.col("b.x").alias("px"), F.col("b.y").alias("py"))


_WORD = "CASE p_partkey % 8 WHEN 0 THEN 'TRUE ' WHEN 1 THEN ' no' WHEN 2 THEN '' WHEN 3 THEN '[1, 2]' WHEN 4 THEN 'false' WHEN 5 THEN CAST(p_partkey AS VARCHAR) WHEN 6 THEN 'y' ELSE '{\"a\": 1}' END"


@query(f"""WITH w AS (SELECT *, {_WORD} AS w FROM part) SELECT p_partkey, lower(trim(p_name)) = lower(trim(' ' || upper(p_name))) AS same, replace(replace(p_name || '"\\', '\\', '\\\\'), '"', '\\"') AS quoted,
CASE WHEN trim(w) <> '' AND trim(w) <> 'false' AND left(trim(w), 1) NOT IN ('[', '{{') THEN trim(w) END AS ref, CASE WHEN lower(trim(w)) IN ('true', 'yes', 'y', '1') THEN true ELSE false END AS truth,
least(20, greatest(5, coalesce(TRY_CAST(trim(w) AS DOUBLE), 7.5))) AS num, CASE WHEN length(p_name) > 8 THEN substr(p_name, 1, 8) || '...' ELSE p_name END AS cut, 'Part ' || p_name || ' of ' || p_size || '.' AS prompt FROM w""")  # fmt: skip
def word_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules for a model's words: equality, quoting, references, truth values, clamped numbers, truncation, prompts."""
    k = F.col("p_partkey") % 8
    word = F.when(k == 0, "TRUE ").when(k == 1, " no").when(k == 2, "").when(k == 3, "[1, 2]").when(k == 4, "false").when(k == 5, F.col("p_partkey").cast("string")).when(k == 6, "y").otherwise('{"a": 1}')
    p = spark.read.parquet(f"{sf_dir}/part.parquet").withColumn("w", word)
    n = F.col("p_name")
    return p.select(
        "p_partkey", t.same_text(n, F.concat(F.lit(" "), F.upper(n))).alias("same"), t.dot_quoted(F.concat(n, F.lit('"\\'))).alias("quoted"), t.reference(F.col("w")).alias("ref"), t.truth(F.col("w")).alias("truth"),
        t.number(t.strip(F.col("w")), 5.0, 20.0, 7.5).alias("num"), t.truncated(n, 8).alias("cut"), summary.prompt_text("Part {name} of {size}.", name=n, size=F.col("p_size").cast("string")).alias("prompt"),
    )


@query("SELECT p_partkey, 'model' || p_size AS model, CASE p_partkey % 3 WHEN 0 THEN 'ollama' WHEN 1 THEN 'openai_compatible' END AS provider, CASE p_partkey % 3 WHEN 0 THEN 'http://host:' || p_size WHEN 1 THEN NULL END AS base_url FROM part WHERE p_partkey % 3 <> 2 UNION ALL SELECT p_partkey, NULL, NULL, NULL FROM part WHERE p_partkey % 3 = 2")
def model_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Specifications of responders: provider by alias, model, address."""
    size = F.col("p_size").cast("string")
    k = F.col("p_partkey") % 3
    spec = F.when(k == 0, F.concat(F.lit("ollama:model"), size, F.lit("@http://host:"), size)).when(k == 1, F.concat(F.lit("openai-compatible:model"), size)).otherwise("nonsense")
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", t.model_spec(spec).alias("m")).select("p_partkey", F.col("m.model").alias("model"), F.col("m.provider").alias("provider"), F.col("m.base_url").alias("base_url"))


@query("SELECT event_id, CASE WHEN event_id % 7 IN (5, 6) THEN -1 ELSE CAST(json_extract_string(props, '$.k') AS INT) END AS k FROM events")
def json_in_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number in each event's properties, written as models answer: plain, in prose with a stray quotation mark, fenced, with
    a comment, with a trailing comma; cut off or closed wrongly there is none (-1)."""
    e, k, p = spark.read.parquet(f"{sf_dir}/events.parquet"), F.col("event_id") % 7, F.col("props")
    body = F.expr("substr(props, 1, length(props) - 1)")
    answer = F.when(k == 0, p).when(k == 1, F.concat(F.lit('The 5" box: '), p, F.lit(" as asked."))).when(k == 2, F.concat(F.lit("Sure.\n```json\n"), p, F.lit("\n```\nDone {")))
    answer = answer.when(k == 3, F.concat(body, F.lit(" // a note\n}"))).when(k == 4, F.concat(body, F.lit(",}"))).when(k == 5, body).otherwise(F.concat(body, F.lit("] then "), p))
    rows = model_json.strict_json(e.select("event_id", answer.alias("answer")), "answer", "json")
    return rows.select("event_id", F.coalesce(F.from_json("json", "k string")["k"].try_cast("int"), F.lit(-1)).alias("k"))


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 2 WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 0 ELSE 1 END AS n, CASE p_partkey % 5 WHEN 0 THEN 'S1' WHEN 2 THEN CAST(p_size AS VARCHAR) WHEN 4 THEN '{\"a\":1}' END AS first FROM part")
def list_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values where a list was asked for: a list, nothing, a scalar, an empty object, an object."""
    k = F.col("p_partkey") % 5
    value = F.when(k == 0, '["S1", "S2"]').when(k == 1, "null").when(k == 2, F.col("p_size").cast("string")).when(k == 3, "{}").otherwise('{"a":1}')
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", summary.as_list(value).alias("v")).select("p_partkey", F.size("v").cast("long").alias("n"), F.get("v", F.lit(0)).alias("first"))


@query(SCENE + Z + "SELECT image_id, CASE WHEN image_id < 1500 THEN 'val' ELSE 'train' END AS split, CASE WHEN image_id % 2 = 0 THEN 2 ELSE 1 END AS n_parts, CASE WHEN image_id % 2 = 0 THEN 'image' ELSE 'text' END AS first, 'read ' || image_id AS words FROM images")
def chat_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The split of a data set, and chat content as typed parts."""
    i = order_scenes(spark, sf_dir).images
    content = F.concat(F.when(F.col("image_id") % 2 == 0, "<image>\n").otherwise(""), F.lit("read "), F.col("image_id").cast("string"))
    parts = export.typed_parts(content)
    return i.select("image_id", export.split_of(F.col("image_id"), 15_000, 0.1).alias("split"), F.size(parts).alias("n_parts"), F.get(parts, F.lit(0))["type"].alias("first"), F.element_at(parts, -1)["text"].alias("words"))


@query(SCENE + Z + """, c AS (SELECT o_orderpriority AS system, count(*) AS n, sum(o_custkey % 7) AS k FROM orders GROUP BY 1), r AS (SELECT system, k / (6.0 * n) AS p, CASE WHEN k % 2 = 0 THEN CAST(k AS DOUBLE) / (7 * n) END AS q FROM c)
SELECT system, '| ' || system || ' | ' || printf('%.2f/%.2f/%.2f', p, p, p) || ' | ' || coalesce(printf('%.2f', q), '-') || ' | ' || coalesce(printf('%.2f', q), '-') || ' | ' || printf('%.2f', p) || ' | ' || printf('%.2f', p) || ' | ' || coalesce(printf('%.2f', q), '-') || ' | ' || coalesce(printf('%.2f', q), '-') || ' | ' || printf('%.2f', p) || ' |' AS line FROM r""")  # fmt: skip
def report_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports as rows of a Markdown table, undefined numbers as a dash."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.col("o_orderpriority").alias("system")).agg(F.count("*").alias("n"), F.sum(F.col("o_custkey") % 7).alias("k"))
    p, q = F.col("k") / (6.0 * F.col("n")), F.when(F.col("k") % 2 == 0, F.col("k").cast("double") / (7 * F.col("n")))
    names = {"shapes_precision": p, "shapes_recall": p, "shapes_f1": p, "shape_type_accuracy": q, "shape_family_accuracy": q, "containment_f1": p, "texts_f1": p, "text_cer": q, "text_inside_accuracy": q, "connections_f1": p}
    return evaluate.report_lines(o.select("system", *(v.alias(k) for k, v in names.items())))


@query(SCENE + Z + """, a AS (SELECT image_id, id, ord, [type, CASE WHEN ord % 2 = 0 THEN 'x' ELSE 'y' END] AS s FROM shapes), p AS (SELECT a.image_id, a.id AS a, b.id AS b, a.s AS s, list_concat(b.s, ['x']) AS t FROM a JOIN a b ON a.image_id = b.image_id AND b.ord = a.ord + 1)
SELECT image_id, a, b, len(list_filter(s, lambda v: NOT list_contains(t, v))) = 0 AND len(list_distinct(s)) < len(list_distinct(t)) AS inside FROM p""")  # fmt: skip
def subset_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether one set of holes lies properly within another."""
    from sketchgraph.operators.detections import proper_subset

    s = order_scenes(spark, sf_dir).shapes.select("image_id", "id", "ord", F.array(F.col("type"), F.when(F.col("ord") % 2 == 0, "x").otherwise("y")).alias("s"))
    b = s.select("image_id", F.col("id").alias("b"), (F.col("ord") - 1).alias("ord"), F.concat("s", F.array(F.lit("x"))).alias("t"))
    return s.join(b, ["image_id", "ord"]).select("image_id", F.col("id").alias("a"), "b", proper_subset(F.col("s"), F.col("t")).alias("inside"))


@query(SCENE + Z + "SELECT image_id, id, rank FROM (SELECT image_id, id, row_number() OVER (PARTITION BY image_id ORDER BY round(w * h, 6) DESC, ord) AS rank FROM shapes) WHERE rank <= 2")
def largest_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two largest regions of each drawing."""
    from sketchgraph.operators.detections import largest_holes

    s = order_scenes(spark, sf_dir).shapes
    return largest_holes(s.select("image_id", "id", F.col("ord").alias("hole"), g.rounded(g.box_area(F.col("bbox"))).alias("area")), 2).select("image_id", "id", "rank")


@query(SCENE + Z + """, a AS (SELECT image_id, ord AS a, ord + 1 AS b FROM shapes WHERE EXISTS (SELECT 1 FROM shapes n WHERE n.image_id = shapes.image_id AND n.ord = shapes.ord + 1))
SELECT image_id, a || ',' || b AS holes FROM a UNION ALL SELECT x.image_id, x.a || ',' || x.b || ',' || y.b FROM a x JOIN a y ON x.image_id = y.image_id AND y.a = x.b""")  # fmt: skip
def hole_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connected sets of two and three regions where each borders on the next."""
    from sketchgraph.operators import detections

    s = order_scenes(spark, sf_dir).shapes
    n = s.select("image_id", F.col("ord").alias("b"))
    adjacent = s.select("image_id", F.col("ord").alias("a")).join(n, "image_id").where("b = a + 1")
    return detections.hole_sets(adjacent).select("image_id", F.array_join(F.transform("holes", lambda v: v.cast("string")), ",").alias("holes"))


@query(SCENE + Z + "SELECT image_id, id, 'text' AS kind FROM texts UNION ALL SELECT image_id, id, CASE WHEN type IN ('region', 'scribble', 'unknown') THEN 'ignored' ELSE 'scored' END FROM shapes")
def scored_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an evaluation counts."""
    s = order_scenes(spark, sf_dir)
    kept = evaluate.scored(s.shapes).select("image_id", "id", F.lit("scored").alias("kind"))
    gone = s.shapes.join(kept, ["image_id", "id"], "left_anti").select("image_id", "id", F.lit("ignored").alias("kind"))
    return kept.unionByName(gone).unionByName(s.texts.select("image_id", "id", F.lit("text").alias("kind")))


@query()
def detection_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes merged with a detector's; no SQL, since each detection sees what the ones before it changed."""
    from sketchgraph.operators.detections import merged_detections

    s = order_scenes(spark, sf_dir).shapes
    found = predicted(s).select("image_id", "ord", F.when(F.col("ord") % 4 == 0, "line").when(F.col("ord") % 3 == 0, "circle").otherwise(F.col("type")).alias("class"), (F.col("confidence") + 0.02 * (F.col("ord") % 3)).alias("conf"), "bbox", F.array().cast(g.POINTS).alias("polygon"))
    return merged_detections(s.where("ord % 5 <> 0"), found).select("image_id", "id", "type", F.round("confidence", 3).alias("confidence"), F.array_join("source", ",").alias("source"), "cv_type", "action")


_ROUND = "type IN ('ellipse', 'circle', 'region', 'unknown', 'scribble')"
#: The outlines of shapes by type, corner by corner, their edges, and their areas.
_OUTLINES = f"""corners AS (
  SELECT image_id, id, ord, type, n, k, CASE WHEN {_ROUND} THEN x + w / 2 + w / 2 * cos(k * CAST(2 AS DOUBLE) * pi() / 48) WHEN type = 'triangle' THEN CASE k WHEN 0 THEN x + w / 2 WHEN 1 THEN x + w ELSE x END WHEN type = 'diamond' THEN CASE k WHEN 0 THEN x + w / 2 WHEN 1 THEN x + w WHEN 2 THEN x + w / 2 ELSE x END ELSE CASE WHEN k IN (1, 2) THEN x + w ELSE x END END AS px,
    CASE WHEN {_ROUND} THEN y + h / 2 + h / 2 * sin(k * CAST(2 AS DOUBLE) * pi() / 48) WHEN type = 'triangle' THEN CASE k WHEN 0 THEN y ELSE y + h END WHEN type = 'diamond' THEN CASE k WHEN 0 THEN y WHEN 2 THEN y + h ELSE y + h / 2 END ELSE CASE WHEN k IN (2, 3) THEN y + h ELSE y END END AS py
  FROM (SELECT *, unnest(range(n)) AS k FROM (SELECT s.*, CASE WHEN {_ROUND} THEN 48 WHEN type = 'triangle' THEN 3 ELSE 4 END AS n FROM shapes s))
), edges AS (SELECT a.image_id, a.id, a.ord, a.type, a.px AS ax, a.py AS ay, b.px AS bx, b.py AS by_ FROM corners a JOIN corners b ON a.image_id = b.image_id AND a.id = b.id AND b.k = (a.k + 1) % a.n
), areas AS (SELECT image_id, id, round(abs(sum(ax * by_ - ay * bx)) / 2, 6) AS area FROM edges GROUP BY ALL
)"""
_IN = "(count(*) FILTER ((e.ay > q.py) <> (e.by_ > q.py) AND q.px < e.ax + (q.py - e.ay) * (e.bx - e.ax) / nullif(e.by_ - e.ay, 0)) % 2 = 1 OR count(*) FILTER ((e.bx - e.ax) * (q.py - e.ay) - (e.by_ - e.ay) * (q.px - e.ax) = 0 AND q.px BETWEEN least(e.ax, e.bx) AND greatest(e.ax, e.bx) AND q.py BETWEEN least(e.ay, e.by_) AND greatest(e.ay, e.by_)) > 0)"
_T = "(CASE WHEN (e.bx - e.ax) * (e.bx - e.ax) + (e.by_ - e.ay) * (e.by_ - e.ay) > 0 THEN least(1, greatest(0, ((q.px - e.ax) * (e.bx - e.ax) + (q.py - e.ay) * (e.by_ - e.ay)) / ((e.bx - e.ax) * (e.bx - e.ax) + (e.by_ - e.ay) * (e.by_ - e.ay)))) ELSE 0 END)"
_FAR = f"min(sqrt((q.px - e.ax - {_T} * (e.bx - e.ax)) * (q.px - e.ax - {_T} * (e.bx - e.ax)) + (q.py - e.ay - {_T} * (e.by_ - e.ay)) * (q.py - e.ay - {_T} * (e.by_ - e.ay))))"
_CENTERS = "q AS (SELECT image_id, id, x + w / 2 AS px, y + h / 2 AS py, sqrt(w * w + h * h) / 2 + 40 AS reach FROM texts)"


@query(SCENE + _OUTLINES + f""", q AS (SELECT c.*, s.x, s.y, s.w, s.h FROM corners c JOIN shapes s USING (image_id, id)),
held AS (SELECT q.image_id, q.id, q.k, q.n, e.id AS p, {_IN} AS inside FROM q JOIN shapes b ON b.image_id = q.image_id AND b.id <> q.id AND b.x <= q.x + q.w AND q.x <= b.x + b.w AND b.y <= q.y + q.h AND q.y <= b.y + b.h
  JOIN areas ca ON ca.image_id = q.image_id AND ca.id = q.id JOIN areas pa ON pa.image_id = q.image_id AND pa.id = b.id AND pa.area > CAST(1.05 AS DOUBLE) * ca.area JOIN edges e ON e.image_id = b.image_id AND e.id = b.id GROUP BY ALL),
f AS (SELECT h.image_id, h.id, h.p, row_number() OVER (PARTITION BY h.image_id, h.id ORDER BY a.area, s.ord) AS r FROM (SELECT image_id, id, p FROM held GROUP BY ALL HAVING count(*) FILTER (inside) / max(n) >= 0.92) h JOIN areas a ON a.image_id = h.image_id AND a.id = h.p JOIN shapes s ON s.image_id = h.image_id AND s.id = h.p)
SELECT image_id, id, p AS parent_id FROM f WHERE r = 1""")  # fmt: skip
def outline_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containment of shapes with the outlines of their types."""
    return topology.parents(outlined(order_scenes(spark, sf_dir).shapes))


@query(SCENE + _OUTLINES + f", {_CENTERS}, held AS (SELECT q.image_id, q.id, e.id AS s, max(e.ord) AS ord, {_IN} AS inside FROM q JOIN edges e ON e.image_id = q.image_id AND e.type <> 'scribble' GROUP BY q.image_id, q.id, e.id) SELECT image_id, id, s AS inside_shape_id FROM (SELECT h.image_id, h.id, h.s, row_number() OVER (PARTITION BY h.image_id, h.id ORDER BY a.area, h.ord) AS r FROM held h JOIN areas a ON a.image_id = h.image_id AND a.id = h.s WHERE inside) WHERE r = 1")
def outline_text_inside(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = order_scenes(spark, sf_dir)
    return topology.text_holders(outlined(s.shapes), s.texts)


@query(SCENE + _OUTLINES + f", {_CENTERS}, near AS (SELECT q.image_id, q.id, e.id AS s, max(e.ord) AS ord, max(q.reach) AS reach, {_IN} AS inside, {_FAR} AS d FROM q JOIN edges e ON e.image_id = q.image_id AND e.type <> 'scribble' GROUP BY q.image_id, q.id, e.id) SELECT image_id, id, string_agg(s, ',' ORDER BY k) AS near FROM (SELECT *, row_number() OVER (PARTITION BY image_id, id ORDER BY round(d, 6), ord) AS k FROM near WHERE NOT inside AND d <= reach) WHERE k <= 3 GROUP BY ALL")
def outline_text_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = order_scenes(spark, sf_dir)
    return topology.near_shapes(outlined(s.shapes), s.texts, s.images).select("image_id", "id", F.array_join("near_shape_ids", ",").alias("near"))


@query(SCENE + _OUTLINES + f", q AS (SELECT image_id, connection_id, pos, x AS px, y AS py FROM ends), side AS (SELECT q.image_id, q.connection_id, q.pos, e.id AS s, max(e.ord) AS ord, {_IN} AS inside, {_FAR} AS d FROM q JOIN edges e ON e.image_id = q.image_id GROUP BY q.image_id, q.connection_id, q.pos, e.id) SELECT image_id, connection_id, pos, s AS shape_id, CASE WHEN d <= 8 THEN 'boundary' ELSE 'inside' END AS side FROM (SELECT x.*, row_number() OVER (PARTITION BY x.image_id, x.connection_id, x.pos ORDER BY CASE WHEN d <= 8 THEN 0 ELSE 1 END, a.area, x.ord) AS r FROM side x JOIN areas a ON a.image_id = x.image_id AND a.id = x.s WHERE d <= 8 OR inside) WHERE r = 1")
def outline_end_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = order_scenes(spark, sf_dir)
    return topology.end_shapes(topology.ends_of(s.connections), outlined(s.shapes), s.images)


@query(SCENE + _OUTLINES + f""", {_points(2).replace("points AS", "steps AS", 1)}, q AS (SELECT image_id, id, k, px, py, ax AS x0, ay AS y0, bx AS x1, by_ AS y1 FROM steps),
signs AS (SELECT q.image_id, q.id AS connection_id, e.id AS shape_id, q.k, q.px, q.py, x0, y0, x1, y1, count(*) FILTER ((e.ay > q.py) <> (e.by_ > q.py) AND q.px < e.ax + (q.py - e.ay) * (e.bx - e.ax) / nullif(e.by_ - e.ay, 0)) % 2 = 1 AND count(*) FILTER ((e.bx - e.ax) * (q.py - e.ay) - (e.by_ - e.ay) * (q.px - e.ax) = 0 AND q.px BETWEEN least(e.ax, e.bx) AND greatest(e.ax, e.bx) AND q.py BETWEEN least(e.ay, e.by_) AND greatest(e.ay, e.by_)) = 0 AS sign
  FROM q JOIN edges e ON e.image_id = q.image_id GROUP BY ALL)
SELECT DISTINCT image_id, connection_id, shape_id FROM (SELECT *, lead(sign) OVER (PARTITION BY image_id, connection_id, shape_id ORDER BY k) AS after FROM signs)
WHERE sign <> after AND sqrt((px - x0) * (px - x0) + (py - y0) * (py - y0)) > 12 AND sqrt((px - x1) * (px - x1) + (py - y1) * (py - y1)) > 12""")  # fmt: skip
def outline_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = order_scenes(spark, sf_dir)
    return topology.crossings(s.with_(shapes=outlined(s.shapes))).select("image_id", "connection_id", "shape_id")
