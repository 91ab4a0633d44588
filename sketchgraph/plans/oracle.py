"""The queries in SQL over the same tables (DuckDB's dialect). For boxes, geometry has closed forms."""

from __future__ import annotations

from sketchgraph.functions.text import DETECTOR_CLASSES, SHAPE_TYPES

_TYPES = "[" + ", ".join(f"'{x}'" for x in SHAPE_TYPES) + "]"
_CLASSES = "[" + ", ".join(f"'{x}'" for x in DETECTOR_CLASSES) + "]"

SCENE = f"""
WITH RECURSIVE l AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS rn
  FROM lineitem
), shapes AS (
  SELECT l_orderkey AS image_id, CAST(rn AS INT) AS ord, 'S' || rn AS id, ({_TYPES})[CAST(p_size % 10 + 1 AS INT)] AS type,
    CAST((l_partkey * 37 + rn * 211) % 800 AS DOUBLE) AS x, CAST((l_suppkey * 91 + rn * 157) % 600 AS DOUBLE) AS y,
    CAST(40 AS DOUBLE) + l_quantity * p_size * CAST(0.25 AS DOUBLE) AS w, CAST(30 AS DOUBLE) + l_quantity * p_size * CAST(0.2 AS DOUBLE) AS h,
    l_discount * 5 AS ink_density, l_returnflag, l_linestatus
  FROM l JOIN part ON l_partkey = p_partkey
), texts AS (
  SELECT o_orderkey AS image_id, k AS ord, 'T' || k AS id, CASE WHEN k = 1 THEN o_orderpriority ELSE o_orderstatus END AS text,
    CAST((o_custkey * 53 + k * 307) % 900 AS DOUBLE) AS x, CAST((o_orderkey * 29 + k * 173) % 700 AS DOUBLE) AS y,
    CAST(20 + (o_custkey % 5) * 10 AS DOUBLE) AS w, CAST(16 AS DOUBLE) AS h
  FROM orders, (VALUES (1), (2)) AS t(k)
), images AS (SELECT o_orderkey AS image_id, CAST((o_custkey % 4) * 90 AS INT) AS rotation FROM orders
), connections AS (
  SELECT a.image_id, 'C' || CAST((a.ord + 1) // 2 AS INT) AS id, (a.ord + 1) // 2 AS ord, CASE WHEN a.l_linestatus = 'F' THEN 'arrow' ELSE 'line' END AS type, a.l_returnflag = 'R' AS heavy,
    a.x + a.w / 2 AS ax, a.y + a.h / 2 AS ay, b.x + b.w / 2 AS bx, b.y + b.h / 2 AS by_
  FROM shapes a JOIN shapes b ON a.image_id = b.image_id AND b.ord = a.ord + 1 WHERE a.ord % 2 = 1
), ends AS (
  SELECT image_id, id AS connection_id, 0 AS pos, ax AS x, ay AS y FROM connections
  UNION ALL SELECT image_id, id, 1, bx, by_ FROM connections
), pred AS (SELECT image_id, ord, id, x + ord % 3 AS x, y, w, h FROM shapes WHERE ord % 7 <> 0
), """


def _parents(shapes: str) -> str:
    """All four corners of a box lie in its parent's: 92 % of four is four."""
    return f"""(
  SELECT image_id, id, parent_id FROM (
    SELECT c.image_id, c.id, p.id AS parent_id, row_number() OVER (PARTITION BY c.image_id, c.id ORDER BY round(p.w * p.h, 6), p.ord) AS r
    FROM {shapes} c JOIN {shapes} p ON c.image_id = p.image_id AND c.id <> p.id AND p.w * p.h > c.w * c.h * CAST(1.05 AS DOUBLE)
      AND c.x >= p.x AND c.x + c.w <= p.x + p.w AND c.y >= p.y AND c.y + c.h <= p.y + p.h
  ) WHERE r = 1)"""


_PARENTS = f"""parents AS {_parents('shapes')}, ancestors AS (
  SELECT image_id, id, parent_id AS ancestor, 1 AS steps FROM parents
  UNION ALL SELECT a.image_id, a.id, p.parent_id, a.steps + 1 FROM ancestors a JOIN parents p ON a.image_id = p.image_id AND a.ancestor = p.id
), depths AS (
  SELECT s.image_id, s.id, coalesce(max(a.steps), 0) AS depth FROM shapes s LEFT JOIN ancestors a ON s.image_id = a.image_id AND s.id = a.id GROUP BY ALL
)"""

_OUT = "greatest({s}.x - {px}, 0, {px} - {s}.x - {s}.w)"
_OUT_Y = "greatest({s}.y - {py}, 0, {py} - {s}.y - {s}.h)"


def _inside(s: str, px: str, py: str) -> str:
    return f"({px} BETWEEN {s}.x AND {s}.x + {s}.w AND {py} BETWEEN {s}.y AND {s}.y + {s}.h)"


def _outside_distance(s: str, px: str, py: str) -> str:
    dx, dy = _OUT.format(s=s, px=px), _OUT_Y.format(s=s, py=py)
    return f"sqrt({dx} * {dx} + {dy} * {dy})"


def _outline_distance(s: str, px: str, py: str) -> str:
    return f"CASE WHEN {_inside(s, px, py)} THEN least({px} - {s}.x, {s}.x + {s}.w - {px}, {py} - {s}.y, {s}.y + {s}.h - {py}) ELSE {_outside_distance(s, px, py)} END"


_HOLDERS = f"""held AS (
  SELECT image_id, id, inside_shape_id FROM (
    SELECT t.image_id, t.id, s.id AS inside_shape_id, row_number() OVER (PARTITION BY t.image_id, t.id ORDER BY round(s.w * s.h, 6), s.ord) AS r
    FROM texts t JOIN shapes s ON t.image_id = s.image_id AND s.type <> 'scribble' AND {_inside('s', '(t.x + t.w / 2)', '(t.y + t.h / 2)')}
  ) WHERE r = 1
), close_ AS (
  SELECT image_id, id, s_id, row_number() OVER (PARTITION BY image_id, id ORDER BY round(d, 6), s_ord) AS k FROM (
    SELECT t.image_id, t.id, s.id AS s_id, s.ord AS s_ord, {_outside_distance('s', '(t.x + t.w / 2)', '(t.y + t.h / 2)')} AS d, sqrt(t.w * t.w + t.h * t.h) / 2 + 40 AS reach
    FROM texts t JOIN shapes s ON t.image_id = s.image_id AND s.type <> 'scribble' AND NOT {_inside('s', '(t.x + t.w / 2)', '(t.y + t.h / 2)')}
  ) WHERE d <= reach
), near AS (SELECT image_id, id, string_agg(s_id, ',' ORDER BY k) AS near FROM close_ WHERE k <= 3 GROUP BY ALL
)"""

_ATTACHED = f"""end_text AS (
  SELECT image_id, connection_id, pos, text_id FROM (
    SELECT e.image_id, e.connection_id, e.pos, t.id AS text_id, {_outside_distance('t', 'e.x', 'e.y')} AS d, row_number() OVER (PARTITION BY e.image_id, e.connection_id, e.pos ORDER BY round({_outside_distance('t', 'e.x', 'e.y')}, 6), t.ord) AS r
    FROM ends e JOIN texts t ON e.image_id = t.image_id
  ) WHERE r = 1 AND d <= CAST(0.6 AS DOUBLE) * 16
), end_shape AS (
  SELECT image_id, connection_id, pos, shape_id, CASE WHEN side = 0 THEN 'boundary' ELSE 'inside' END AS side FROM (
    SELECT *, row_number() OVER (PARTITION BY image_id, connection_id, pos ORDER BY side, round(area, 6), s_ord) AS r FROM (
      SELECT e.image_id, e.connection_id, e.pos, s.id AS shape_id, s.w * s.h AS area, s.ord AS s_ord, CASE WHEN {_outline_distance('s', 'e.x', 'e.y')} <= 8 THEN 0 WHEN {_inside('s', 'e.x', 'e.y')} THEN 1 END AS side
      FROM ends e JOIN shapes s ON e.image_id = s.image_id
    ) WHERE side IS NOT NULL
  ) WHERE r = 1
), attached AS (
  SELECT e.image_id, e.connection_id, e.pos, coalesce(t.text_id, s.shape_id) AS ref, s.side, t.text_id
  FROM ends e LEFT JOIN end_text t USING (image_id, connection_id, pos) LEFT JOIN end_shape s USING (image_id, connection_id, pos)
)"""

_LENGTH = "sqrt((c.bx - c.ax) * (c.bx - c.ax) + (c.by_ - c.ay) * (c.by_ - c.ay))"


def _points(step: int, more: str = "") -> str:
    return f"""points AS (
  SELECT image_id, id, ord, ax, ay, bx, by_, k, CASE WHEN n = 1 THEN ax ELSE ax + (k * len / (n - 1)) / len * (bx - ax) END AS px, CASE WHEN n = 1 THEN ay ELSE ay + (k * len / (n - 1)) / len * (by_ - ay) END AS py
  FROM (SELECT *, unnest(range(n)) AS k FROM (SELECT c.*, {_LENGTH} AS len, CASE WHEN {_LENGTH} = 0 THEN 1 ELSE greatest(2, CAST(floor({_LENGTH} / {step}) AS INT) + 1) END AS n FROM connections c {more}))
)"""


_CROSSED = f"""{_points(2)}, signs AS (
  SELECT p.image_id, p.id AS connection_id, s.id AS shape_id, p.k, p.px, p.py, p.ax, p.ay, p.bx, p.by_, (p.px > s.x AND p.px < s.x + s.w AND p.py > s.y AND p.py < s.y + s.h) AS sign
  FROM points p JOIN shapes s ON p.image_id = s.image_id
), crossed AS (
  SELECT DISTINCT image_id, connection_id, shape_id FROM (
    SELECT *, lead(sign) OVER (PARTITION BY image_id, connection_id, shape_id ORDER BY k) AS after FROM signs
  ) WHERE sign <> after AND sqrt((px - ax) * (px - ax) + (py - ay) * (py - ay)) > 12 AND sqrt((px - bx) * (px - bx) + (py - by_) * (py - by_)) > 12
)"""

_IOU = "CASE WHEN {u} > 0 THEN {i} / {u} ELSE 0 END"


def _shared(a: str, b: str) -> str:
    return f"(greatest(least({a}.x + {a}.w, {b}.x + {b}.w) - greatest({a}.x, {b}.x), 0) * greatest(least({a}.y + {a}.h, {b}.y + {b}.h) - greatest({a}.y, {b}.y), 0))"


def _iou(a: str, b: str) -> str:
    i = _shared(a, b)
    return _IOU.format(i=i, u=f"({a}.w * {a}.h + {b}.w * {b}.h - {i})")


#: Least distance of two boxes' outlines by corners against sides, both ways (side to side it is the same).
def _corners(a: str, b: str) -> str:
    corners = [f"({a}.x + {i} * {a}.w)" for i in (0, 1)], [f"({a}.y + {i} * {a}.h)" for i in (0, 1)]
    return ", ".join(_outline_distance(b, x, y) for x in corners[0] for y in corners[1])


_SETOPS = f"""tp_ AS {_parents('shapes')}, pp_ AS {_parents('pred')}, both_ AS (
  SELECT coalesce(t.image_id, p.image_id) AS image_id, t.id AS t, p.id AS p FROM tp_ t FULL JOIN pp_ p ON t.image_id = p.image_id AND t.id = p.id AND t.parent_id = p.parent_id
), counts AS (SELECT image_id, count(*) FILTER (t IS NOT NULL AND p IS NOT NULL) AS tp, count(*) FILTER (t IS NULL) AS fp, count(*) FILTER (p IS NULL) AS fn FROM both_ GROUP BY 1)"""

_ROTATED = """SELECT s.image_id, s.id, round_even(min(ox) , 4) AS x, round_even(min(oy), 4) AS y, round_even(max(ox) - min(ox), 4) AS w, round_even(max(oy) - min(oy), 4) AS h FROM (
  SELECT image_id, id, round_even(CAST(CASE rotation WHEN 90 THEN py WHEN 180 THEN 1200 - 1 - px WHEN 270 THEN 900 - 1 - py ELSE px END / 0.5 + 30 AS DOUBLE), 1) AS ox, round_even(CAST(CASE rotation WHEN 90 THEN 1200 - 1 - px WHEN 180 THEN 900 - 1 - py WHEN 270 THEN px ELSE py END / 0.5 + 50 AS DOUBLE), 1) AS oy
  FROM (SELECT s.image_id, s.id, i.rotation, unnest([s.x, s.x + s.w, s.x, s.x + s.w]) AS px, unnest([s.y, s.y + s.h, s.y + s.h, s.y]) AS py FROM shapes s JOIN images i USING (image_id))
) s GROUP BY ALL"""

#: Detector objects by their four corners: shapes, connectors 4.8 wide about their two points, texts.
_OBJECTS = f"""o AS (
  SELECT image_id, 0 AS part, ord, type AS class, x AS x0, y AS y0, x + w AS x1, y AS y1, x + w AS x2, y + h AS y2, x AS x3, y + h AS y3 FROM shapes WHERE list_contains({_CLASSES}, type)
  UNION ALL SELECT image_id, 1, ord, type, ax - dy, ay + dx, bx - dy, by_ + dx, bx + dy, by_ - dx, ax + dy, ay - dx
  FROM (SELECT *, (bx - ax) / greatest(len, 1e-9) * 4.8 / 2 AS dx, (by_ - ay) / greatest(len, 1e-9) * 4.8 / 2 AS dy FROM (SELECT c.*, {_LENGTH} AS len FROM connections c))
  UNION ALL SELECT image_id, 2, ord, 'text', x, y, x + w, y, x + w, y + h, x, y + h FROM texts
)"""


def _share(v: str, of: int) -> str:
    return f"round_even(greatest(0, least(1, {v} / {of})), 5)"


ORACLE_SQL = {
    "scene_stats": SCENE + _PARENTS + """
SELECT i.image_id, coalesce(s.n, 0) AS shapes, coalesce(c.n, 0) AS connections, t.n AS texts, t.r AS texts_read, coalesce(s.d, 0) AS max_depth FROM images i
LEFT JOIN (SELECT image_id, count(*) AS n, max(depth) AS d FROM depths GROUP BY 1) s USING (image_id) LEFT JOIN (SELECT image_id, count(*) AS n FROM connections GROUP BY 1) c USING (image_id)
LEFT JOIN (SELECT image_id, count(*) AS n, count(*) FILTER (text <> '') AS r FROM texts GROUP BY 1) t USING (image_id)""",
    "shape_type_counts": SCENE + "z AS (SELECT 1) SELECT image_id, type, count(*) AS n FROM shapes GROUP BY ALL",
    "containment_parent": SCENE + _PARENTS + " SELECT * FROM parents",
    "ancestor_pairs": SCENE + _PARENTS + " SELECT * FROM ancestors",
    "nesting_depth": SCENE + _PARENTS + " SELECT * FROM depths",
    "bbox_iou": SCENE + f"z AS (SELECT 1) SELECT a.image_id, a.ord, round({_iou('a', 'b')}, 4) AS iou FROM shapes a JOIN shapes b ON a.image_id = b.image_id AND b.ord = a.ord + 1",
    "norm_box": SCENE + "z AS (SELECT 1) SELECT image_id, id, CAST(round_even(1000 * x / 1200, 0) AS INT) AS x0, CAST(round_even(1000 * y / 900, 0) AS INT) AS y0, CAST(round_even(1000 * (x + w) / 1200, 0) AS INT) AS x1, CAST(round_even(1000 * (y + h) / 900, 0) AS INT) AS y1 FROM shapes",
    "polygon_area": SCENE + """z AS (SELECT 1) SELECT image_id, id, round(CASE WHEN type IN ('ellipse', 'circle', 'region', 'unknown', 'scribble') THEN w * h / 4 * 24 * sin(2 * pi() / 48) WHEN type IN ('triangle', 'diamond') THEN w * h / 2 ELSE w * h END, 2) AS area FROM shapes""",
    "map_to_original": SCENE + "z AS (SELECT 1) " + _ROTATED,
    "text_inside": SCENE + _HOLDERS + " SELECT * FROM held",
    "text_near_top3": SCENE + _HOLDERS + " SELECT * FROM near",
    "text_placement": SCENE + _HOLDERS + " SELECT t.image_id, t.id, CASE WHEN h.id IS NOT NULL THEN 'inside' WHEN n.id IS NOT NULL THEN 'near' ELSE 'free' END AS placement FROM texts t LEFT JOIN held h USING (image_id, id) LEFT JOIN near n USING (image_id, id)",
    "endpoint_nearest_text": SCENE + _ATTACHED + " SELECT * FROM end_text",
    "endpoint_attach_shape": SCENE + _ATTACHED + " SELECT * FROM end_shape",
    "path_crossings": SCENE + _CROSSED + " SELECT * FROM crossed",
    "attached_ids": SCENE + _ATTACHED + """ SELECT image_id, connection_id AS id, concat_ws(',', a, CASE WHEN b IS DISTINCT FROM a THEN b END) AS ids FROM (SELECT image_id, connection_id, max(ref) FILTER (pos = 0) AS a, max(ref) FILTER (pos = 1) AS b FROM attached GROUP BY ALL)""",
    "connector_labels": SCENE + _ATTACHED + ", " + _points(3) + """ SELECT image_id, id, connection_id FROM (
  SELECT *, row_number() OVER (PARTITION BY image_id, id ORDER BY round(d, 6), c_ord) AS r FROM (
    SELECT t.image_id, t.id, p.id AS connection_id, p.ord AS c_ord, min(sqrt((px - t.x - t.w / 2) * (px - t.x - t.w / 2) + (py - t.y - t.h / 2) * (py - t.y - t.h / 2))) - greatest(t.w, t.h) / 2 AS d
    FROM texts t JOIN points p ON t.image_id = p.image_id WHERE NOT EXISTS (SELECT 1 FROM attached a WHERE a.image_id = t.image_id AND a.text_id = t.id) GROUP BY t.image_id, t.id, p.id, p.ord, t.w, t.h
  ) WHERE d <= CAST(0.8 AS DOUBLE) * 16) WHERE r = 1""",
    "prune_connections": SCENE + _ATTACHED + ", " + _CROSSED + f""" SELECT c.image_id, c.id FROM connections c
JOIN (SELECT image_id, connection_id, count(DISTINCT ref) AS n, count(*) FILTER (text_id IS NULL AND side = 'boundary') AS b FROM attached GROUP BY ALL) a ON a.image_id = c.image_id AND a.connection_id = c.id
WHERE c.heavy OR c.type <> 'line' OR a.n >= 2 OR a.b > 0 OR {_LENGTH} >= 192 OR EXISTS (SELECT 1 FROM crossed x WHERE x.image_id = c.image_id AND x.connection_id = c.id)""",
    "shape_pairs": SCENE + _PARENTS + f""" SELECT image_id, a, b, CASE WHEN o > 0.03 THEN 'overlaps' ELSE 'touches' END AS relation FROM (
  SELECT a.image_id, a.id AS a, b.id AS b, {_shared('a', 'b')} / least(a.w * a.h, b.w * b.h) AS o, least({_corners('a', 'b')}, {_corners('b', 'a')}) AS d FROM shapes a JOIN shapes b ON a.image_id = b.image_id AND a.ord < b.ord
    AND a.x - 6 < b.x + b.w + 6 AND b.x - 6 < a.x + a.w + 6 AND a.y - 6 < b.y + b.h + 6 AND b.y - 6 < a.y + a.h + 6
  WHERE NOT EXISTS (SELECT 1 FROM ancestors n WHERE n.image_id = a.image_id AND ((n.id = a.id AND n.ancestor = b.id) OR (n.id = b.id AND n.ancestor = a.id)))
) WHERE o > CAST(0.03 AS DOUBLE) OR d <= 5""",
    "crossed_out": SCENE + "z AS (SELECT 1) SELECT image_id, id FROM shapes WHERE ink_density > CAST(0.33 AS DOUBLE) AND type <> 'region'",
    "renumber": SCENE + """z AS (SELECT 1) SELECT image_id, id AS old, 'S' || row_number() OVER (PARTITION BY image_id ORDER BY round_even(y / 40, 0), x, ord) AS new FROM shapes
UNION ALL SELECT image_id, id, 'T' || row_number() OVER (PARTITION BY image_id ORDER BY round_even(y / 40, 0), x, ord) FROM texts""",
    "drop_dangling": SCENE + _PARENTS + """ SELECT s.image_id, s.id, k.id AS parent_id FROM shapes s LEFT JOIN parents p USING (image_id, id) LEFT JOIN (SELECT image_id, id FROM shapes WHERE ord % 7 <> 0) k ON k.image_id = s.image_id AND k.id = p.parent_id WHERE s.ord % 7 <> 0""",
    "cer": "SELECT p_partkey, round(CASE WHEN trim(p_name) = '' THEN CASE WHEN trim(p_type) = '' THEN 0 ELSE 1 END ELSE levenshtein(trim(p_name), trim(p_type)) / length(trim(p_name)) END, 4) AS cer FROM part",
    "match_best_or_loose": SCENE + f"""z AS (SELECT 1) SELECT image_id, id, known_id, round(iou, 4) AS iou, tier = 1 AS loose FROM (
  SELECT *, row_number() OVER (PARTITION BY image_id, id ORDER BY tier, CASE WHEN tier = 0 THEN -iou ELSE 0 END, k_ord) AS r FROM (
    SELECT b.image_id, b.id, a.id AS known_id, a.ord AS k_ord, {_iou('a', 'b')} AS iou, CASE WHEN {_iou('a', 'b')} >= CAST(0.45 AS DOUBLE) THEN 0 WHEN {_inside('a', '(b.x + b.w / 2)', '(b.y + b.h / 2)')} AND a.w * a.h / greatest(b.w * b.h, 1) > 0.5 AND a.w * a.h / greatest(b.w * b.h, 1) < 2 THEN 1 END AS tier
    FROM pred b JOIN shapes a ON a.image_id = b.image_id) WHERE tier IS NOT NULL) WHERE r = 1""",
    "merge_anti": SCENE + f"z AS (SELECT 1) SELECT b.image_id, b.id FROM shapes b WHERE b.ord % 2 = 1 AND NOT EXISTS (SELECT 1 FROM shapes a WHERE a.image_id = b.image_id AND a.ord % 2 = 0 AND {_iou('a', 'b')} >= 0.5)",
    "containment_setops": SCENE + _SETOPS + " SELECT * FROM counts",
    "prf_report": SCENE + _SETOPS + """ SELECT round(p, 4) AS precision, round(r, 4) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 4) AS f1
FROM (SELECT CASE WHEN sum(tp) + sum(fp) > 0 THEN sum(tp) / (sum(tp) + sum(fp)) ELSE 0 END AS p, CASE WHEN sum(tp) + sum(fn) > 0 THEN sum(tp) / (sum(tp) + sum(fn)) ELSE 0 END AS r FROM counts)""",
    "yolo_lines": SCENE + _OBJECTS + f""" SELECT image_id, part, ord, printf('%d %.5f %.5f %.5f %.5f %.5f %.5f %.5f %.5f', list_position({_CLASSES}, class) - 1, {", ".join(f"{_share(f'x{k}', 1200)}, {_share(f'y{k}', 900)}" for k in range(4))}) AS line FROM o""",
    "coco_annotations": SCENE + _OBJECTS + f""" SELECT row_number() OVER (ORDER BY image_id, part, ord) AS id, image_id, list_position({_CLASSES}, class) AS category_id, round_even(abs((((x0 * y1 - y0 * x1) + x1 * y2 - y1 * x2) + x2 * y3 - y2 * x3) + x3 * y0 - y3 * x0) / 2, 1) AS area FROM o""",
    "ocr_tsv": SCENE + "z AS (SELECT 1) SELECT printf('syn_%06d_', image_id) || id || '.png' AS path, text, 0 AS crossed_out FROM texts WHERE text <> '' AND least(1200, x + w + 3) - greatest(0, x - 3) >= 4 AND least(900, y + h + 3) - greatest(0, y - 3) >= 4",
    "model_box": SCENE + """n AS (SELECT image_id, id, round_even(1000 * x / 1200, 0) AS x0, round_even(1000 * y / 900, 0) AS y0, round_even(1000 * (x + w) / 1200, 0) AS x1, round_even(1000 * (y + h) / 900, 0) AS y1 FROM shapes),
b AS (SELECT image_id, id, greatest(0, x0 * CAST(1.2 AS DOUBLE)) AS x0, greatest(0, y0 * CAST(0.9 AS DOUBLE)) AS y0, least(1200, x1 * CAST(1.2 AS DOUBLE)) AS x1, least(900, y1 * CAST(0.9 AS DOUBLE)) AS y1 FROM n)
SELECT image_id, id, round(least(x0, x1), 4) AS x, round(least(y0, y1), 4) AS y, round(abs(x1 - x0), 4) AS w, round(abs(y1 - y0), 4) AS h FROM b WHERE abs(x1 - x0) > 1 AND abs(y1 - y0) > 1""",
    "model_graph_parse": SCENE + """n AS (SELECT image_id, id, type, round_even(1000 * x / 1200, 0) AS x0, round_even(1000 * y / 900, 0) AS y0, round_even(1000 * (x + w) / 1200, 0) AS x1, round_even(1000 * (y + h) / 900, 0) AS y1 FROM shapes),
b AS (SELECT image_id, id, type, greatest(0, x0 * CAST(1.2 AS DOUBLE)) AS x0, greatest(0, y0 * CAST(0.9 AS DOUBLE)) AS y0, least(1200, x1 * CAST(1.2 AS DOUBLE)) AS x1, least(900, y1 * CAST(0.9 AS DOUBLE)) AS y1 FROM n)
SELECT image_id, id, type, round(least(x0, x1), 4) AS x, round(least(y0, y1), 4) AS y, round(abs(x1 - x0), 4) AS w, round(abs(y1 - y0), 4) AS h FROM b WHERE abs(x1 - x0) > 1 AND abs(y1 - y0) > 1""",
    "json_value": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events",
    "apply_corrections": SCENE + f"""kept AS (SELECT image_id, id, ord, x, y, w, h, type, CASE WHEN id = 'S2' AND type <> 'circle' THEN 'retyped' ELSE 'kept' END AS change FROM shapes WHERE id <> 'S1'),
tops AS (SELECT i.image_id, coalesce(max(s.ord), 0) AS top FROM images i LEFT JOIN shapes s USING (image_id) GROUP BY 1), new AS (SELECT 1080.0::DOUBLE AS x, 810.0::DOUBLE AS y, 60.0::DOUBLE AS w, 45.0::DOUBLE AS h)
SELECT image_id, id, CASE WHEN id = 'S2' THEN 'circle' ELSE type END AS type, change FROM kept
UNION ALL SELECT t.image_id, 'S' || (t.top + 1), 'rectangle', 'added' FROM tops t, new n WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.image_id = t.image_id AND {_iou('k', 'n')} > 0.5)""",
    "reading_queue": SCENE + _HOLDERS + """ SELECT image_id, id, rank, (rank - 1) // 6 AS batch FROM (SELECT t.image_id, t.id, row_number() OVER (PARTITION BY t.image_id ORDER BY CASE WHEN h.id IS NOT NULL THEN 0 WHEN n.id IS NOT NULL THEN 1 ELSE 2 END, t.y, t.x, t.ord) AS rank
FROM texts t LEFT JOIN held h USING (image_id, id) LEFT JOIN near n USING (image_id, id)) WHERE rank <= 150""",
    "describe_line": SCENE + _PARENTS + """, k AS (SELECT image_id, string_agg(n || ' ' || replace(type, '_', ' ') || CASE WHEN n > 1 THEN 's' ELSE '' END, ', ' ORDER BY type) AS kinds, sum(n) AS n FROM (SELECT image_id, type, count(*) AS n FROM shapes GROUP BY ALL) GROUP BY 1)
SELECT i.image_id, printf('Found %d shape(s) (%s), %d connection(s) and %d text item(s); nesting depth %d.', CAST(coalesce(k.n, 0) AS INT), coalesce(k.kinds, 'none'), coalesce(c.n, 0), 2, coalesce(d.d, 0)) AS line FROM images i
LEFT JOIN k USING (image_id) LEFT JOIN (SELECT image_id, count(*) AS n FROM connections GROUP BY 1) c USING (image_id) LEFT JOIN (SELECT image_id, max(depth) AS d FROM depths GROUP BY 1) d USING (image_id)""",
}
