"""The operators over the fixed scene view, one query each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sketchgraph.functions import geometry as g
from sketchgraph.functions import text as t
from sketchgraph.operators import evaluate, export, fusion, identity, model_json, topology
from sketchgraph.plans import reports
from sketchgraph.plans.oracle import ORACLE_SQL as SCENE_SQL
from sketchgraph.sources.scenes import order_scenes, predicted

QUERIES = dict(reports.QUERIES)
ORACLE_SQL = SCENE_SQL | reports.ORACLE_SQL


def query(f):
    QUERIES[f.__name__] = f
    return f


def _flat(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, *(F.round(f"bbox.{c}", 4).alias(c) for c in "xywh"))


@query
def scene_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = order_scenes(spark, sf_dir)
    s = s.with_(shapes=topology.with_containment(s.shapes))
    return topology.stats(s).select("image_id", "shapes", "connections", "texts", "texts_read", "max_depth")


@query
def shape_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_scenes(spark, sf_dir).shapes.groupBy("image_id", "type").agg(F.count("*").alias("n"))


@query
def containment_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.parents(order_scenes(spark, sf_dir).shapes)


@query
def ancestor_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.ancestors(topology.parents(order_scenes(spark, sf_dir).shapes))


@query
def nesting_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.with_containment(order_scenes(spark, sf_dir).shapes).select("image_id", "id", "depth")


@query
def bbox_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = order_scenes(spark, sf_dir).shapes
    a, b = s.select("image_id", F.col("ord"), F.col("bbox").alias("a")), s.select("image_id", (F.col("ord") - 1).alias("ord"), F.col("bbox").alias("b"))
    return a.join(b, ["image_id", "ord"]).select("image_id", "ord", F.round(g.iou(F.col("a"), F.col("b")), 4).alias("iou"))


@query
def norm_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = order_scenes(spark, sf_dir)
    v = g.normalised_box(F.col("bbox"), F.col("width"), F.col("height"))
    return s.shapes.join(s.images, "image_id").select("image_id", "id", *(F.get(v, F.lit(k)).alias(n) for k, n in enumerate(("x0", "y0", "x1", "y1"))))


@query
def model_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes as a model would give them, in thousandths, back in pixels."""
    s = order_scenes(spark, sf_dir)
    v = g.normalised_box(F.col("bbox"), F.col("width"), F.col("height")).cast("array<double>")
    rows = s.shapes.join(s.images, "image_id").withColumn("bbox", g.box_from_model(v, F.col("width"), F.col("height"))).where("bbox is not null")
    return _flat(rows, "image_id", "id")


@query
def polygon_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = order_scenes(spark, sf_dir).shapes
    return s.select("image_id", "id", F.round(g.polygon_area(g.outline(F.col("bbox"), F.col("type"))), 2).alias("area"))


@query
def map_to_original(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = order_scenes(spark, sf_dir)
    return _flat(evaluate.in_original(s.shapes, s.images, "bbox"), "image_id", "id")


@query
def text_inside(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = order_scenes(spark, sf_dir)
    return topology.text_holders(s.shapes, s.texts)


@query
def text_near_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = order_scenes(spark, sf_dir)
    return topology.near_shapes(s.shapes, s.texts, s.images).select("image_id", "id", F.array_join("near_shape_ids", ",").alias("near"))


@query
def text_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.with_placement(order_scenes(spark, sf_dir)).texts.select("image_id", "id", "placement")


@query
def endpoint_nearest_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = order_scenes(spark, sf_dir)
    return topology.end_texts(topology.ends_of(s.connections), s.texts, s.images)


@query
def endpoint_attach_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = order_scenes(spark, sf_dir)
    return topology.end_shapes(topology.ends_of(s.connections), s.shapes, s.images)


@query
def path_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.crossings(order_scenes(spark, sf_dir)).select("image_id", "connection_id", "shape_id")


@query
def attached_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = topology.with_attachment(order_scenes(spark, sf_dir))
    return s.connections.select("image_id", "id", F.array_join(t.attached_ids(F.col("endpoints")), ",").alias("ids"))


@query
def connector_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = order_scenes(spark, sf_dir)
    return topology.labels(s, topology.texts_at_ends(s))


@query
def prune_connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.pruned_ids(order_scenes(spark, sf_dir))


@query
def shape_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping and touching pairs."""
    return topology.shape_pairs(order_scenes(spark, sf_dir)).select("image_id", "a", "b", "relation")


@query
def crossed_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.crossed_out(order_scenes(spark, sf_dir).shapes).where("crossed_out").select("image_id", "id")


@query
def renumber(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = order_scenes(spark, sf_dir)
    return identity.reading_order(s.shapes, "S").unionByName(identity.reading_order(s.texts, "T"))


@query
def drop_dangling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parents after every seventh shape is removed: references to it become null."""
    s = order_scenes(spark, sf_dir)
    s = s.with_(shapes=topology.with_containment(s.shapes).where("ord % 7 <> 0"))
    return identity.without_dangling(s).shapes.select("image_id", "id", "parent_id")


@query
def cer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error rates of part names against brands and types (ASCII)."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.select("p_partkey", F.round(t.character_error_rate(F.col("p_name"), F.col("p_type")), 4).alias("cer"))


@query
def match_best_or_loose(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = order_scenes(spark, sf_dir).shapes
    return fusion.matches(s, predicted(s)).select("image_id", "id", "known_id", F.round("iou", 4).alias("iou"), "loose")


@query
def merge_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapes of odd places that overlap none of the even places by half."""
    s = order_scenes(spark, sf_dir).shapes
    return fusion.not_present(s.where("ord % 2 = 0"), s.where("ord % 2 = 1")).select("image_id", "id")


@query
def fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = order_scenes(spark, sf_dir).shapes
    read = predicted(s).withColumns({"type": F.when(F.col("ord") % 2 == 0, "circle").otherwise(F.col("type")), "source": F.array(F.lit("vlm"))})
    return fusion.fused_shapes(s.where("ord % 5 <> 0"), read).select("image_id", "id", "type", F.round("confidence", 3).alias("confidence"), "action")


@query
def assignment_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    scene = order_scenes(spark, sf_dir)
    s = scene.shapes
    return evaluate.matched(s, predicted(s), images=scene.images).select("image_id", "t_id", "p_id", F.round("score", 4).alias("score"))


@query
def containment_setops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parent pairs of the two readings, matched by their ids: tp, fp and fn of each drawing."""
    s = order_scenes(spark, sf_dir).shapes
    name = lambda df: topology.parents(df).select("image_id", F.col("id").alias("child"), F.col("parent_id").alias("parent"))
    return evaluate.set_counts(name(s), name(predicted(s)), ["image_id", "child", "parent"])


@query
def prf_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = containment_setops(spark, sf_dir).agg(*(F.sum(n).alias(n) for n in ("tp", "fp", "fn")))
    p, r, f = evaluate.rates(F.col("tp"), F.col("fp"), F.col("fn"))
    return c.select(p.alias("precision"), r.alias("recall"), f.alias("f1"))


@query
def evaluation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    true = topology.scorable(topology.kept(order_scenes(spark, sf_dir)))
    return evaluate.report(evaluate.evaluation(true, topology.scorable(true.with_(shapes=predicted(true.shapes)))))


@query
def yolo_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole detector export, connectors as thick lines included."""
    s = order_scenes(spark, sf_dir)
    return export.yolo_lines(export.detector_objects(s), s.images)


@query
def coco_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All detection records, ids counted over shapes, connectors and texts."""
    objects = export.detector_objects(order_scenes(spark, sf_dir))
    return export.annotations(objects).select("id", "image_id", "category_id", "area")


@query
def ocr_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = order_scenes(spark, sf_dir)
    return export.ocr_rows(s.texts, s.images)


@query
def model_graph_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drawings written as a model's target and read back as untrusted answers."""
    s = order_scenes(spark, sf_dir)
    rows = model_json.answers(model_json.targets(s), "target").join(s.images.select("image_id", "width", "height"), "image_id")
    return _flat(model_json.read_shapes(rows), "image_id", "id", "type")


@query
def json_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number in each event's properties."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", F.from_json("props", "k string")["k"].try_cast("int").alias("k"))


@query
def apply_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixed verifier's answer applied to every drawing: S1 goes, S2 becomes a circle, one box is added."""
    s = order_scenes(spark, sf_dir)
    answer = '{"remove_shapes": ["S1"], "retype_shapes": {"S2": "circle"}, "add_shapes": [{"type": "box", "bbox": [900, 900, 950, 950]}]}'
    fixes = s.images.select("image_id", F.from_json(F.lit(answer), model_json.CORRECTIONS).alias("fix"))
    return model_json.corrected_shapes(s.shapes, s.images, fixes).select("image_id", "id", "type", "change")


@query
def reading_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in the order in which they are read, by placement and place, in batches of six."""
    from sketchgraph.operators.control import reading_batches

    s = topology.with_placement(order_scenes(spark, sf_dir))
    return reading_batches(s.texts).select("image_id", "id", "rank", "batch")


@query
def describe_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = order_scenes(spark, sf_dir)
    return export.description_heads(s.with_(shapes=topology.with_containment(s.shapes)))


@query
def graph_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOT, Mermaid and a description of each drawing."""
    return export.graph_texts(topology.updated(order_scenes(spark, sf_dir)))


@query
def synthetic_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many generated drawings as there are customers."""
    from sketchgraph.sources.synthetic import generated

    n = spark.read.parquet(f"{sf_dir}/customer.parquet").count()
    return generated(spark, n, seed=3).select("image_id", "split", F.size("shapes").alias("shapes"), F.size("texts").alias("texts"), F.size("connections").alias("connections"))
