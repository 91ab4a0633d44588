"""The relational operators on a drawn fixture, on literal cases, and against their SQL on the small tables."""

import itertools
import math
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from sketchgraph.functions import geometry as g
from sketchgraph.functions import text as t
from sketchgraph.model import Scene, as_json, from_json
from sketchgraph.operators import control, evaluate, export, fusion, identity, model_json, topology
from sketchgraph.sources.synthetic import drawing, generated

SF = "/root/testdata/sf0.001"


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def box(x, y, w, h):
    return g.box(*map(F.lit, (x, y, w, h)))


@pytest.fixture(scope="module")
def scene(spark):
    """Nested ellipses, a box, a triangle, two overlapping circles, three texts and a heavy line."""
    shapes = [(1, "S1", 1, "ellipse", (60.0, 90.0, 340.0, 220.0)), (1, "S2", 2, "ellipse", (150.0, 150.0, 160.0, 100.0)), (1, "S3", 3, "rectangle", (520.0, 90.0, 260.0, 220.0)), (1, "S4", 4, "triangle", (840.0, 80.0, 220.0, 220.0)), (1, "S5", 5, "circle", (490.0, 450.0, 220.0, 220.0)), (1, "S6", 6, "circle", (630.0, 450.0, 220.0, 220.0))]
    shapes = spark.createDataFrame(shapes, "image_id long, id string, ord int, type string, bbox struct<x:double,y:double,w:double,h:double>").withColumns({"polygon": g.outline(F.col("bbox"), F.col("type")), "source": F.array(F.lit("cv")), "confidence": F.lit(0.7), "ink_density": F.lit(0.1)})
    texts = spark.createDataFrame([(1, "T1", 1, "A", (215.0, 190.0, 20.0, 22.0)), (1, "T2", 2, "B", (640.0, 190.0, 20.0, 22.0)), (1, "T3", 3, None, (1000.0, 700.0, 30.0, 16.0))], "image_id long, id string, ord int, text string, bbox struct<x:double,y:double,w:double,h:double>")
    end = "struct<point:struct<x:double,y:double>,shape_id:string,text_id:string,attachment:string,is_head:boolean>"
    line = [(1, "C1", 1, "line", [(520.0, 200.0), (400.0, 200.0)], [((520.0, 200.0), None, None, "free", False), ((400.0, 200.0), None, None, "free", False)], True, ["cv"], 120.0, False)]
    lines = spark.createDataFrame(line, f"image_id long, id string, ord int, type string, path array<struct<x:double,y:double>>, endpoints array<{end}>, heavy boolean, source array<string>, length_px double, locked_ends boolean")
    images = spark.createDataFrame([(1, 1100.0, 760.0, 3.0, 16.0), (2, 10.0, 10.0, 3.0, 16.0)], "image_id long, width double, height double, stroke_width double, text_height double")
    return Scene(images, shapes, texts, lines)


def test_boxes(spark):
    r = one(spark, g.iou(box(0.0, 0.0, 10.0, 10.0), box(5.0, 5.0, 10.0, 10.0)).alias("i"), g.box_contains(box(0.0, 0.0, 10.0, 10.0), F.lit(5.0), F.lit(5.0)).alias("a"), g.box_contains(box(0.0, 0.0, 10.0, 10.0), F.lit(11.0), F.lit(5.0)).alias("b"), g.box_of_points(F.array(g.point(F.lit(3), F.lit(4)), g.point(F.lit(1), F.lit(9)))).alias("p"), g.box_of_points(F.array().cast(g.POINTS)).alias("none"))
    assert r["i"] == pytest.approx(25 / 175) and r["a"] and not r["b"]
    assert tuple(r["p"]) == (1, 4, 2, 5) and tuple(r["none"]) == (0, 0, 0, 0)


def test_polygons(spark):
    square = F.array(*(g.point(F.lit(x), F.lit(y)) for x, y in ((0, 0), (10, 0), (10, 10), (0, 10))))
    right = F.array(*(g.point(F.lit(x), F.lit(y)) for x, y in ((0, 0), (3, 0), (0, 4))))
    at = lambda x, y: (F.lit(float(x)), F.lit(float(y)))
    r = one(spark, g.polygon_area(right).alias("a"), g.inside(square, *at(10, 5)).alias("on"), g.inside(square, *at(10.01, 5)).alias("out"), g.signed_distance(square, *at(5, 4)).alias("d"), g.signed_distance(square, *at(13, 14)).alias("e"))
    assert (r["a"], r["on"], r["out"], r["d"], r["e"]) == (6.0, True, False, 4.0, -5.0)
    path = F.array(*(g.point(F.lit(x), F.lit(y)) for x, y in ((0, 0), (3, 0), (3, 4))))
    points = one(spark, g.resampled(path, 2.0).alias("p"), g.polyline_length(path).alias("n"))
    want = np.linspace(0, 7, 4)
    assert points["n"] == 7
    assert [c for p in points["p"] for c in p] == pytest.approx([c for v in want for c in (np.interp(v, [0, 3, 7], [0, 3, 3]), np.interp(v, [0, 3, 7], [0, 0, 4]))])


@pytest.mark.parametrize("rotation", [0, 90, 180, 270])
def test_original_pixels(spark, rotation):
    for x, y in ((100, 120), (500, 300)):
        px, py = (x - 30) * 0.5, (y - 50) * 0.5
        w0, h0 = 400, 300
        turned = {0: (px, py), 90: (h0 - 1 - py, px), 180: (w0 - 1 - px, h0 - 1 - py), 270: (py, w0 - 1 - px)}[rotation]
        w, h = (h0, w0) if rotation in (90, 270) else (w0, h0)
        r = one(spark, g.to_original(*map(F.lit, (*turned, rotation, w, h, 0.5, 30.0, 50.0))).alias("p"))["p"]
        assert abs(r["x"] - x) <= 0.6 and abs(r["y"] - y) <= 0.6


def test_model_boxes(spark):
    v = lambda *x: F.array(*map(F.lit, map(float, x)))
    page = (F.lit(1000.0), F.lit(800.0))
    sent = F.struct(F.lit(500.0).alias("w"), F.lit(400.0).alias("h"))
    r = one(spark, g.box_from_model(v(10, 20, 100, 200), *page, F.lit("xyxy_pixels"), sent).alias("a"), g.box_from_model(v(0.1, 0.1, 0.5, 0.5), *page).alias("b"), g.box_from_model(v(1, 1, 1, 1), *page).alias("c"), g.box_from_model(v(1, 2, 3), *page).alias("d"), g.box_from_model(v(20, 10, 200, 100), *page, F.lit("yxyx_1000")).alias("e"))
    assert tuple(r["a"]) == (20, 40, 180, 360) and tuple(r["b"]) == (100, 80, 400, 320) and r["c"] is None is r["d"]
    assert tuple(r["e"]) == pytest.approx((10, 16, 90, 144))


def test_words(spark):
    cases = [("loves", "loves", 0.0), ("loves", "lovez", 0.2), ("", "", 0.0), ("", "x", 1.0), (" äb\t", "ab", 0.5)]
    df = spark.createDataFrame(cases, "a string, b string, want double")
    assert all(r["want"] == r["got"] for r in df.select("want", t.character_error_rate(F.col("a"), F.col("b")).alias("got")).collect())
    values = [("true", True, "true"), ("No", False, "No"), ("", False, None), (None, False, None), ("3", False, "3"), ("[1]", False, None), ("false", False, None), ("maybe", False, "maybe")]
    df = spark.createDataFrame(values, "v string, truth boolean, ref string")
    assert all((r[0], r[1]) == (r[2], r[3]) for r in df.select("truth", "ref", t.truth(F.col("v")), t.reference(F.col("v"))).collect())
    kinds = spark.createDataFrame([("Oval", "ellipse"), ("rounded-rect", "rounded_rectangle"), (None, "unknown"), ("star", "unknown"), (" square ", "rectangle")], "v string, k string")
    assert all(r[0] == r[1] for r in kinds.select("k", t.shape_type(F.col("v"))).collect())
    specs = spark.createDataFrame([("ollama:qwen",), ("openai:gpt@http://x:1/v1",), ("nonsense",)], "s string").select(t.model_spec(F.col("s")).alias("m")).collect()
    assert [tuple(r["m"]) if r["m"] else None for r in specs] == [("ollama", "qwen", "http://localhost:11434"), ("openai", "gpt", "http://x:1/v1"), None]


def test_topology(scene):
    s = topology.updated(scene)
    found = {(r["type"], r["subject"], r["object"]) for r in s.relations.collect()}
    assert {("contains", "S1", "S2"), ("contains", "S2", "T1"), ("contains", "S3", "T2"), ("overlaps", "S5", "S6"), ("connected", "S3", "S1")} <= found
    assert {r["id"]: (r["parent_id"], r["depth"]) for r in s.shapes.collect()}["S2"] == ("S1", 1)
    assert {r["id"]: r["placement"] for r in s.texts.collect()} == {"T1": "inside", "T2": "inside", "T3": "free"}
    stats = {r["image_id"]: r for r in topology.stats(s).collect()}
    assert (stats[1]["shapes"], stats[1]["texts_read"], stats[1]["max_depth"], stats[2]["shapes"]) == (6, 2, 1, 0)
    texts = export.graph_texts(s).where("image_id = 1").first()
    assert texts["dot"].count("{") == texts["dot"].count("}") and 'S3 -> S1 [label="C1" penwidth=3 dir=none];' in texts["dot"]
    assert "S3 === S1" in texts["mermaid"] and texts["description"].startswith("Found 6 shape(s) (2 circles, 2 ellipses, 1 rectangle, 1 triangle), 1 connection(s) and 3 text item(s); nesting depth 1.")
    assert evaluate.report(evaluate.evaluation(s, s)).select("shapes_f1", "texts_f1", "connections_f1", "text_cer").first() == (1.0, 1.0, 1.0, 0.0)
    assert as_json(from_json(as_json(scene), scene)).orderBy("image_id").collect() == as_json(scene).orderBy("image_id").collect()


def test_ids(spark, scene):
    end = "struct<point:struct<x:double,y:double>,shape_id:string,text_id:string,attachment:string,is_head:boolean>"
    b = "bbox struct<x:double,y:double,w:double,h:double>"
    shapes = spark.createDataFrame([(1, "x2", 1, (500.0, 10.0, 50.0, 50.0), None), (1, "x1", 2, (10.0, 10.0, 50.0, 50.0), "x2")], f"image_id long, id string, ord int, {b}, parent_id string")
    texts = spark.createDataFrame([(1, "t9", 1, (20.0, 20.0, 5.0, 5.0), "x1")], f"image_id long, id string, ord int, {b}, inside_shape_id string")
    lines = spark.createDataFrame([(1, "c5", 1, [], [((0.0, 0.0), "x1", None, "free", False), ((0.0, 0.0), None, "t9", "free", False)])], f"image_id long, id string, ord int, path array<struct<x:double,y:double>>, endpoints array<{end}>")
    new = identity.renumbered(scene.with_(shapes=shapes, texts=texts, connections=lines))
    assert {r["id"]: r["parent_id"] for r in new.shapes.collect()} == {"S1": "S2", "S2": None}
    assert new.texts.first()["inside_shape_id"] == "S1" and new.connections.select(t.attached_ids(F.col("endpoints"))).first()[0] == ["S1", "T1"]
    cut = identity.without_dangling(scene.with_(shapes=shapes.where("id <> 'x1'"), texts=texts, connections=lines))
    assert cut.texts.first()["inside_shape_id"] is None and cut.connections.select(t.attached_ids(F.col("endpoints"))).first()[0] == ["t9"]


def test_assignment_is_best():
    rng = np.random.default_rng(0)
    for _ in range(60):
        score = np.round(rng.random((rng.integers(1, 6), rng.integers(1, 6))), 2)
        got = evaluate.assignment(score)
        small, large = min(score.shape), max(score.shape)
        best = max(sum((score if score.shape[0] <= score.shape[1] else score.T)[i, p[i]] for i in range(small)) for p in itertools.permutations(range(large), small))
        assert len(got) == small and sum(score[r, c] for r, c in got) == pytest.approx(best)


def test_fusion(spark):
    b = "bbox struct<x:double,y:double,w:double,h:double>"
    ddl = f"image_id long, id string, ord int, type string, {b}, confidence double, crossed_out boolean, source array<string>"
    known = spark.createDataFrame([(1, "S1", 1, "region", (0.0, 0.0, 100.0, 100.0), 0.5, False, ["cv"]), (1, "S4", 2, "circle", (300.0, 0.0, 50.0, 50.0), 0.9, False, ["cv"])], ddl)
    read = spark.createDataFrame([(1, "a", 1, "rectangle", (2.0, 2.0, 100.0, 100.0), 0.6, True, ["vlm"]), (1, "b", 2, "triangle", (600.0, 600.0, 40.0, 40.0), 0.6, False, ["vlm"]), (1, "c", 3, "triangle", (602.0, 602.0, 40.0, 40.0), 0.6, False, ["vlm"]), (2, "d", 1, "circle", (0.0, 0.0, 9.0, 9.0), 0.6, False, ["vlm"])], ddl)
    rows = {(r["image_id"], r["id"]): r for r in fusion.fused_shapes(known, read).collect()}
    assert rows.keys() == {(1, "S1"), (1, "S4"), (1, "S5"), (2, "S1")}
    assert (rows[1, "S1"]["type"], rows[1, "S1"]["cv_type"], rows[1, "S1"]["crossed_out"], rows[1, "S1"]["confidence"]) == ("rectangle", "region", True, 0.65)
    assert (rows[1, "S5"]["read_id"], rows[1, "S5"]["confidence"], rows[1, "S4"]["action"]) == ("c", 0.65, "kept")
    assert {r["id"] for r in fusion.greedy_merge(known, read).where("image_id = 1").collect()} == {"b"}


ANSWERS = [
    ('{"shapes": [{"id": 1, "type": "oval", "bbox": [0, 0, 500, 500], "parent": 3, "crossed_out": "false"}], "texts": [{"id": 2, "text": "hi", "bbox": [10, 10, 100, 50], "inside": 1, "near": 2}], "connections": [{"id": 9, "type": "arrow", "ends": [1, 2], "path": [[1, 1], [900, 900]]}]}', 1),
    ('```json\n{"shapes": [], "summary": "x",}\n```', 0),
    ('{"a": 1, // note\n "b": "http://x"}', None),
    ("no json", None),
    ('{"shapes": [', None),
]


def test_model_answers(spark):
    assert model_json.extracted(ANSWERS[2][0]) == '{"a":1,"b":"http://x"}'
    assert model_json.extracted('Readings: [{"id":"T1"},{"id":"T2"}]') == '[{"id":"T1"},{"id":"T2"}]'
    assert model_json.extracted('text {"a": "}"} more') == '{"a":"}"}' and model_json.extracted("{") is None and model_json.extracted(None) is None
    rows = model_json.answers(spark.createDataFrame([(i, 1000.0, 800.0, a) for i, (a, _) in enumerate(ANSWERS)], "image_id long, width double, height double, answer string"))
    shapes, texts = model_json.read_shapes(rows), model_json.read_texts(rows)
    lines = model_json.read_connections(rows, shapes, texts)
    s, x, c = shapes.first(), texts.first(), lines.first()
    assert shapes.count() == 1 and (s["id"], s["type"], s["parent_id"], s["crossed_out"], len(s["polygon"])) == ("1", "ellipse", None, False, 48)
    assert (x["id"], x["near_shape_ids"], x["placement"]) == ("2", ["2"], "inside")
    assert (c["type"], [(e["shape_id"], e["text_id"], e["attachment"], e["is_head"]) for e in c["endpoints"]]) == ("arrow", [("1", None, "boundary", False), (None, "2", "text", True)])


def test_planner():
    names, log = ["a", "b", "c"], []
    stages = [control.Stage(n, lambda s, n=n: (log.append(n), s)[1], frozenset(names[:i]), frozenset({n})) for i, n in enumerate(names)]
    _, progress = control.run_planner(stages, None, lambda p, ready: "nonsense")
    assert log == ["a", "b", "c"]
    assert control.next_action("a", ["a", "a"], ["a", "b"], {"a"}) == "b"
    bad = control.Stage("bad", lambda s: 1 / 0, provides=frozenset({"x"}))
    _, progress = control.run_plan([bad, stages[1], stages[0]], None)
    assert [x[2] for x in progress.trace] == ["failed: ZeroDivisionError", "not ready", "done"]
    assert control.chosen_responder("x", {"*": "none"}, {}, ["m"]) is None and control.chosen_responder("x", {}, {}, ["m"]) == "m"


def test_a_step_that_fails_in_execution_is_skipped(scene):
    broken = control.Stage("broken", lambda s: s.with_(texts=s.texts.withColumn("text", F.raise_error(F.lit("no")).cast("string"))), provides=frozenset({"x"}))
    fine = control.Stage("fine", lambda s: s.with_(texts=s.texts.withColumn("text", F.lit("y"))), provides=frozenset({"y"}))
    out, progress = control.run_plan([broken, fine], scene, topology.kept)
    assert [t[2].split(":")[0] for t in progress.trace] == ["failed", "done"] and progress.facts == {"y"}
    assert {r["text"] for r in out.texts.collect()} == {"y"}


def test_generated(spark):
    rows = generated(spark, 20, seed=1, val_fraction=0.25).collect()
    assert sum(r["split"] == "val" for r in rows) == 5 and drawing(7) == drawing(7)
    for r in rows:
        by_id = {s["id"]: s["bbox"] for s in r["shapes"]}
        for s in r["shapes"]:
            b = s["bbox"]
            assert b["x"] >= -2 and b["y"] >= -2 and b["x"] + b["w"] <= r["width"] + 2 and b["y"] + b["h"] <= r["height"] + 2
            if s["parent_id"]:
                p = by_id[s["parent_id"]]
                assert p["x"] <= b["x"] and b["x"] + b["w"] <= p["x"] + p["w"]
        assert all(x["text"] and (x["inside_shape_id"] is None or x["inside_shape_id"] in by_id) for x in r["texts"])


def test_random_containment(spark):
    """Parents of random boxes against a direct search."""
    rng = random.Random(3)
    rows = [(i % 4, f"S{i}", i, (float(rng.randrange(100)), float(rng.randrange(100)), float(rng.randrange(5, 120)), float(rng.randrange(5, 120)))) for i in range(80)]
    shapes = spark.createDataFrame(rows, "image_id long, id string, ord int, bbox struct<x:double,y:double,w:double,h:double>").withColumn("polygon", g.outline(F.col("bbox"), F.lit("rectangle")))
    want = {}
    for i, name, _, (x, y, w, h) in rows:
        holders = [(p[3][2] * p[3][3], p[2], p[1]) for p in rows if p[0] == i and p[1] != name and p[3][2] * p[3][3] > 1.05 * w * h and p[3][0] <= x and p[3][1] <= y and x + w <= p[3][0] + p[3][2] and y + h <= p[3][1] + p[3][3]]
        if holders:
            want[name] = min(holders)[2]
    assert {r["id"]: r["parent_id"] for r in topology.parents(shapes).collect()} == want and math.isfinite(len(want))


WHOLE = "/root/testdata/sf0.01"


def _registered():
    from sketchgraph.plans.queries import ORACLE_SQL

    return sorted(ORACLE_SQL)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    db = duckdb.connect()
    for p in Path(WHOLE).glob("*.parquet"):
        db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return db


@pytest.fixture(scope="module")
def answers(spark):
    """All queries' results, several queries at a time: each alone is too small to keep the cores busy."""
    from concurrent.futures import ThreadPoolExecutor

    from sketchgraph.plans.queries import QUERIES

    with ThreadPoolExecutor(4) as pool:
        return {n: pool.submit(lambda n=n: QUERIES[n](spark, WHOLE).toPandas()) for n in _registered()}


@pytest.mark.skipif(not Path(WHOLE).exists(), reason="test tables are not here")
@pytest.mark.parametrize("name", _registered())
def test_queries_match_their_sql(answers, duck, name):
    from sketchgraph.plans.queries import ORACLE_SQL

    got, want = answers[name].result(), duck.sql(ORACLE_SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    key = lambda df: sorted(tuple("" if v is None or v != v else str(round(v, 6) if isinstance(v, float) else v) for v in r) for r in df[columns].astype(object).itertuples(index=False))
    assert key(got) == key(want)


def test_stream_of_drawings(spark, tmp_path):
    from sketchgraph.streaming.batches import per_batch

    rows = generated(spark, 12, seed=2)
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    per_batch(stream, lambda d: d.select("image_id", F.size("shapes").alias("n")), str(tmp_path / "out"), str(tmp_path / "state"), once=True).awaitTermination(60)
    assert {(r["image_id"], r["n"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {(r["image_id"], len(r["shapes"])) for r in rows.collect()}


def test_whole_detector_export_has_connectors(spark):
    """Every connector of two points is a rectangle 4.8 wide about its path, and ids run on over all objects."""
    from math import hypot

    from sketchgraph.plans.queries import QUERIES
    from sketchgraph.sources.scenes import order_scenes

    sf = "/root/testdata/sf0.001"
    s = order_scenes(spark, sf)
    page = {r["image_id"]: (r["width"], r["height"]) for r in s.images.collect()}
    lines = {(r["image_id"], r["part"], r["ord"]): r["line"].split(" ") for r in QUERIES["yolo_lines"](spark, sf).collect()}
    areas = {}
    for r in s.connections.collect():
        if r["image_id"] not in page:
            continue
        (ax, ay), (bx, by) = ((p["x"], p["y"]) for p in r["path"])
        long = max(hypot(bx - ax, by - ay), 1e-9)
        dx, dy = -(by - ay) / long * 2.4, (bx - ax) / long * 2.4
        w, h = page[r["image_id"]]
        want = [v for x, y in ((ax + dx, ay + dy), (bx + dx, by + dy), (bx - dx, by - dy), (ax - dx, ay - dy)) for v in (min(max(x / w, 0), 1), min(max(y / h, 0), 1))]
        assert [float(v) for v in lines[r["image_id"], 1, r["ord"]][1:]] == pytest.approx(want, abs=2e-5)
        areas.setdefault(r["image_id"], []).append(hypot(bx - ax, by - ay) * 4.8)
    assert areas
    rows = QUERIES["coco_annotations"](spark, sf).collect()
    assert sorted(r["id"] for r in rows) == list(range(1, len(rows) + 1)) and len(rows) == len(lines)
    kinds = {int(v[0]) + 1 for (_, part, _), v in lines.items() if part == 1}
    got = {}
    for r in rows:
        if r["category_id"] in kinds:
            got.setdefault(r["image_id"], []).append(r["area"])
    assert {k: pytest.approx(sorted(v), abs=0.06) for k, v in areas.items()} == {k: sorted(v) for k, v in got.items()}


def test_detections_merge_in_their_order(spark):
    """A detection updates the shape it overlaps most, new ones included, or becomes a shape."""
    from sketchgraph.operators import detections

    b = "bbox struct<x:double,y:double,w:double,h:double>"
    p = "polygon array<struct<x:double,y:double>>"
    shapes = spark.createDataFrame([(1, "S1", 1, "region", (0.0, 0.0, 100.0, 100.0), [], 0.9, ["cv"]), (1, "S7", 2, "circle", (300.0, 0.0, 50.0, 50.0), [], 0.8, ["cv"])], f"image_id long, id string, ord int, type string, {b}, {p}, confidence double, source array<string>")
    rows = [(1, 1, "circle", 0.5, (2.0, 2.0, 100.0, 100.0), []), (1, 2, "diamond", 0.7, (300.0, 0.0, 50.0, 50.0), None), (1, 3, "triangle", 0.6, (600.0, 600.0, 40.0, 40.0), []), (1, 4, "diamond", 0.8, (601.0, 601.0, 40.0, 40.0), []), (1, 5, "arrow", 0.9, (0.0, 0.0, 9.0, 9.0), []), (2, 1, "circle", 0.4, (0.0, 0.0, 10.0, 10.0), None)]
    found = spark.createDataFrame(rows, f"image_id long, ord int, class string, conf double, {b}, {p}")
    got = {(r["image_id"], r["id"]): (r["type"], r["confidence"], r["source"], r["cv_type"], r["action"]) for r in detections.merged_detections(shapes, found).collect()}
    assert got == {
        (1, "S1"): ("circle", 0.9, ["cv", "yolo"], "region", "retyped"), (1, "S7"): ("circle", 0.8, ["cv", "yolo"], None, "matched"),
        (1, "S8"): ("diamond", 0.8, ["yolo"], "triangle", "added"), (2, "S1"): ("circle", 0.4, ["yolo"], None, "added"),
    }
    sets = spark.createDataFrame([(1, 1, 2), (1, 2, 3), (1, 3, 4), (2, 1, 1)], "image_id long, a int, b int")
    assert sorted(tuple(r["holes"]) for r in detections.hole_sets(sets).collect()) == [(1, 2), (1, 2, 3), (2, 3), (2, 3, 4), (3, 4)]
    box = lambda x: (x, 0.0, 10.0, 10.0)
    candidates = spark.createDataFrame([(1, 1, [1, 2], 0.9, box(0.0)), (1, 2, [1], 0.95, box(50.0)), (1, 3, [3], 0.8, box(1.0)), (1, 4, [4], 0.7, box(100.0))], f"image_id long, candidate long, holes array<int>, score double, {b}")
    assert sorted(r["candidate"] for r in detections.suppressed(candidates).collect()) == [1, 4]


def test_readings_of_texts_and_connections_fuse(spark):
    b = "bbox struct<x:double,y:double,w:double,h:double>"
    ddl = f"image_id long, id string, ord int, text string, {b}, confidence double, crossed_out boolean, source array<string>"
    known = spark.createDataFrame([(1, "T1", 1, None, (0.0, 0.0, 20.0, 10.0), 0.5, False, ["cv"]), (1, "T2", 2, "b", (100.0, 0.0, 20.0, 10.0), 0.9, False, ["cv"])], ddl)
    read = spark.createDataFrame([(1, "a", 1, "loves", (1.0, 0.0, 20.0, 10.0), 0.6, True, ["vlm"]), (1, "b", 2, "other", (100.0, 1.0, 20.0, 10.0), 0.6, False, ["vlm"]), (1, "c", 3, "new", (300.0, 0.0, 20.0, 10.0), 0.6, False, ["vlm"])], ddl)
    texts = fusion.fused_texts(known, read)
    got = {r["id"]: (r["text"], r["confidence"], r["crossed_out"], r["read_id"], r["action"]) for r in texts.collect()}
    assert got == {"T1": ("loves", 0.6, True, "a", "filled"), "T2": ("b", 0.9, False, "b", "matched"), "T3": ("new", 0.5, False, "c", "added")}
    shapes = spark.createDataFrame([(1, "S1", (0.0, 100.0, 10.0, 10.0))], f"image_id long, id string, {b}")
    end = "struct<point:struct<x:double,y:double>,shape_id:string,text_id:string,attachment:string,is_head:boolean>"
    line = f"image_id long, id string, ord int, type string, path array<struct<x:double,y:double>>, endpoints array<{end}>, heavy boolean"
    e = lambda s, x: ((0.0, 0.0), s, x, "free", False)
    old = spark.createDataFrame([(1, "C4", 1, "line", [], [e("S1", None), e(None, "T2")], False)], line)
    new = spark.createDataFrame([(1, "x", 1, "arrow", [], [e(None, "a"), e("s", None)], True), (1, "y", 2, "line", [], [e(None, "b"), e("s", None)], False), (1, "z", 3, "line", [], [e("s", None), e(None, "a")], False), (1, "w", 4, "line", [], [e(None, "gone"), e("s", None)], False)], line)
    names = texts.select("image_id", "read_id", "id").unionByName(spark.createDataFrame([(1, "s", "S1")], "image_id long, read_id string, id string"))
    rows = fusion.fused_connections(old, new, shapes, texts, names).collect()
    assert [(r["id"], r["type"], [(x["text_id"], x["shape_id"], tuple(x["point"])) for x in r["endpoints"]], r["heavy"], r["locked_ends"], len(r["path"])) for r in rows] == [("C5", "arrow", [("T1", None, (10.0, 5.0)), (None, "S1", (5.0, 105.0))], True, True, 2)]


def test_corrections_reach_every_table(spark, scene):
    s = topology.updated(scene)
    answer = '{"remove_shapes": ["S2", 6], "remove_texts": ["T9"], "remove_connections": ["C1"], "retype_shapes": {"S3": "oval"}, "add_shapes": [{"type": "box", "bbox": [900, 900, 950, 950]}], "text_corrections": {"T2": " C "}, "add_connections": [{"type": "arrow", "ends": ["T2", "S1", "S9"]}, {"ends": ["S2", "S1"]}]}'
    fixes = s.images.select("image_id", F.from_json(F.lit(answer), model_json.CORRECTIONS).alias("fix"))
    new = model_json.corrected(s, fixes)
    shapes = {r["id"]: (r["type"], r["parent_id"]) for r in new.shapes.where("image_id = 1").collect()}
    assert "S2" not in shapes and shapes["S3"][0] == "ellipse" and shapes["S7"][0] == "rectangle"
    texts = {r["id"]: (r["text"], r["inside_shape_id"]) for r in new.texts.collect()}
    assert texts["T2"] == ("C", "S3") and texts["T1"][1] is None
    lines = new.connections.where("image_id = 1").collect()
    assert [(r["id"], r["type"], [(e["text_id"], e["shape_id"], e["is_head"]) for e in r["endpoints"]]) for r in lines] == [("C2", "arrow", [("T2", None, False), (None, "S1", True)])]


def test_json_spans_follow_brackets_only_within_values():
    assert model_json.extracted('the 5" box is {"a": 1}') == '{"a":1}'
    assert model_json.extracted('{"a": [1, 2} then {"b": 1}') is None and model_json.extracted('see // {x\n {"a":1}') is None
    assert model_json.extracted('[1] {"b":2}') == "[1]" and model_json.extracted('{"a":1} {') == '{"a":1}'
    assert model_json.extracted('{"a": "x\\"}"}') == '{"a":"x\\"}"}'


def _reads(df, table):
    """How often a plan reads a table."""
    return df._jdf.queryExecution().optimizedPlan().toString().count(f"Relation [{table[0]}_")


def test_labels_need_neither_shapes_nor_crossings(spark, scene):
    import __spark_entry__ as entry

    assert _reads(entry.queries()["connector_labels"](spark, SF), "lineitem") == 1 + 1  # paths, and ends
    ends = topology.with_attachment(scene).connections.select("image_id", F.explode("endpoints.text_id").alias("id")).where("id is not null").distinct()
    assert sorted(map(tuple, topology.texts_at_ends(scene).collect())) == sorted(map(tuple, ends.collect()))


def test_boxes_are_scored_by_their_sides_as_by_their_pixels(spark):
    from sketchgraph.functions.raster import mask_iou, shape_mask

    rng = random.Random(5)
    boxes = lambda n: [(i // 8, f"S{i % 8}", i % 8, tuple(map(float, (rng.randint(-30, 700), rng.randint(-30, 500), rng.choice([0, 1, 40, 333]), rng.choice([0, 3, 60, 250]))))) for i in range(n)]
    frame = lambda rows: spark.createDataFrame(rows, "image_id long, id string, ord int, bbox struct<x:double,y:double,w:double,h:double>").withColumn("polygon", g.outline(F.col("bbox"), F.lit("rectangle")))
    a, b = boxes(160), boxes(160)
    images = spark.createDataFrame([(i, 800.0, 450.0) for i in range(20)], "image_id long, width double, height double")
    rows = evaluate.mask_scores(frame(a), frame(b), images).collect()
    corners = lambda x, y, w, h: np.array([(x, y), (x + w, y), (x + w, y + h), (x, y + h)])
    mask = lambda v: shape_mask(corners(*v), v, int(450 * 0.75) + 2, int(800 * 0.75) + 2, 0.75)
    true, read = ({(r[0], r[1]): mask(r[3]) for r in x} for x in (a, b))
    assert len(rows) > 50 and {r["drawn"] for r in rows} == {None}
    assert all(r["score"] == mask_iou(true[r["image_id"], r["t_id"]], read[r["image_id"], r["p_id"]]) for r in rows)


def test_uncontested_pairs_are_the_best_assignment():
    rng = np.random.default_rng(2)
    sizes = [rng.integers(1, 6, 2) for _ in range(200)]
    scores = [np.round(rng.random(tuple(s)) ** 3, k % 4 + 1) for k, s in enumerate(sizes)]
    image = np.concatenate([np.full(m.size, k) for k, m in enumerate(scores)])
    rows, columns = (np.concatenate([np.indices(m.shape)[a].ravel() for m in scores]) for a in (0, 1))
    got = evaluate.best_pairs(image, rows, columns, np.concatenate([m.ravel() for m in scores]))
    for k, m in enumerate(scores):
        r, c = rows[(image == k) & got], columns[(image == k) & got]
        assert len(set(r)) == len(r) == len(set(c))
        assert m[r, c].sum() == pytest.approx(sum(m[p] for p in evaluate.assignment(m)))


def test_crossings_near_meeting_places_are_those_of_all_points():
    from sketchgraph.functions import crossing

    rng = np.random.default_rng(4)
    turn = np.arange(48) * 2 * np.pi / 48
    rows, want = [], []
    for k in range(600):
        a, b = rng.integers(0, 60, (2, 2)) * 5.0
        if k % 5 == 0:
            b[k // 5 % 2] = a[k // 5 % 2]  # upright or level, often along a side
        x, y, w, h = (rng.integers(0, 30, 4) * 5.0) + (0, 0, 5, 5)
        poly = [np.array([(x + w / 2, y), (x + w, y + h), (x, y + h)]), np.array([(x, y), (x + w, y), (x + w, y + h), (x, y + h)]), np.stack([x + w / 2 + w / 2 * np.cos(turn), y + h / 2 + h / 2 * np.sin(turn)], 1), np.zeros((0, 2))][k % 4]
        ends = np.array([a, b])
        rows.append(np.concatenate([[1, 2, 2, x, y, w, h, 12, 2], a, b, ends.ravel(), poly.ravel()]))
        long = np.sqrt(((b - a) ** 2).sum())
        n = max(2, int(long / 2) + 1)
        points = a + np.minimum(1, np.arange(n)[:, None] * long / (n - 1) / long) * (b - a) if long else a[None]
        rows.append(np.concatenate([[0, len(points), 2, x, y, w, h, 12, 2], points.ravel(), ends.ravel(), poly.ravel()]))
    stops = np.cumsum([len(r) for r in rows])
    got = crossing.crossed(np.concatenate(rows), np.r_[0, stops[:-1]], stops).reshape(-1, 2)
    assert (got[:, 0] == got[:, 1]).all() and 100 < got[:, 0].sum() < 500


def test_pruning_looks_for_crossings_only_where_they_decide(spark, scene):
    point = lambda x, y: ((float(x), float(y)), None, None, "free", False)
    lines = [(1, f"C{k}", k, kind, [a, b], [point(*a), point(*b)], heavy, ["cv"], long, False) for k, (a, b, kind, heavy, long) in enumerate((
        ((700.0, 20.0), (800.0, 20.0), "line", False, 100.0), ((700.0, 20.0), (800.0, 20.0), "arrow", False, 100.0), ((700.0, 20.0), (800.0, 20.0), "line", True, 100.0), ((500.0, 20.0), (800.0, 20.0), "line", False, 300.0),
        ((480.0, 200.0), (600.0, 200.0), "line", False, 120.0), ((450.0, 110.0), (550.0, 60.0), "line", False, 110.0), ((520.0, 60.0), (540.0, 330.0), "line", False, 190.0), ((450.0, 700.0), (480.0, 690.0), "line", None, 30.0),
    ))]
    s = scene.with_(connections=spark.createDataFrame(lines, scene.connections.schema))
    want = {r["id"] for r in topology.pruned(topology.with_attachment(s)).connections.collect()}
    assert {r["id"] for r in topology.pruned_ids(s).collect()} == want and {"C1", "C2", "C3"} <= want < {r[1] for r in lines}
    import __spark_entry__ as entry

    assert _reads(entry.queries()["prune_connections"](spark, SF), "lineitem") == 0  # all from its tables


def test_an_evaluation_finds_only_what_it_compares(scene):
    full, lean = topology.updated(scene), topology.scorable(topology.kept(scene))
    assert lean.relations is None
    rows = lambda df, *c: sorted(map(str, df.select("image_id", "id", *c).collect()))
    assert rows(lean.shapes, "parent_id") == rows(full.shapes, "parent_id") and rows(lean.texts, "inside_shape_id") == rows(full.texts, "inside_shape_id")
    assert rows(lean.connections, "endpoints") == rows(full.connections, "endpoints")
