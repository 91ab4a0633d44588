"""What is said of each drawing in numbers and short texts: triage, state, counts, lists, and the filters that reports use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sketchgraph.functions import geometry as g
from sketchgraph.functions import text as t
from sketchgraph.model import Scene

# Fixed values.
INK_LOW, INK_HIGH, SATURATION, IS_DRAWING = 0.003, 0.25, 70, 0.6
UNSURE, UNSURE_SHOWN, LABELS_SHOWN = 0.6, 15, 6
TALL_STROKES = (2.0, 40.0)
HEIGHT_SHARE = 0.6


def triage(stats: DataFrame) -> DataFrame:
    """``stats`` (image_id, ink, saturation, long_strokes) with ``score`` and ``is_drawing``: little ink but some, pale, and with long strokes."""
    score = F.when((F.col("ink") > INK_LOW) & (F.col("ink") < INK_HIGH), 0.4).otherwise(0.0) + F.when(F.col("saturation") < SATURATION, 0.3).otherwise(0.0) + F.when(F.col("long_strokes") >= 1, 0.3).otherwise(0.0)
    return stats.withColumn("score", g.half_even(score, 3)).withColumn("is_drawing", F.col("score") >= IS_DRAWING)


def ids_in_order(rows: DataFrame, name: str = "ids", most: int | None = None) -> DataFrame:
    """(image_id, ids): the ids of each drawing by their number, S2 before S10, the first ``most`` of them."""
    number = F.regexp_extract("id", r"([0-9]+)$", 1).try_cast("long")
    listed = F.transform(F.array_sort(F.collect_list(F.struct(number.alias("n"), "id"))), lambda r: r["id"])
    return rows.groupBy("image_id").agg((F.slice(listed, 1, most) if most else listed).alias(name))


def unsure_shapes(shapes: DataFrame) -> DataFrame:
    """(image_id, ids): the first 15 shapes (by place) of confidence under 0.6."""
    low = shapes.where(F.col("confidence") < UNSURE).groupBy("image_id")
    return low.agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("ord", "id"))), 1, UNSURE_SHOWN), lambda r: r["id"]).alias("ids"))


def connector_counts(connections: DataFrame) -> DataFrame:
    """(image_id, connectors, heavy, arrows)."""
    return connections.groupBy("image_id").agg(F.count("*").alias("connectors"), F.count_if("heavy").alias("heavy"), F.count_if(F.col("type") == "arrow").alias("arrows"))


def text_height(blobs: DataFrame, strokes: Column) -> DataFrame:
    """(image_id, text_height): the 60th percentile (interpolated) of the heights of blobs (image_id, h) between 2 and 40 strokes,
    kept between 3 and 30 strokes; ``strokes`` is the stroke width."""
    low, high = TALL_STROKES
    fit = blobs.where((F.col("h") >= low * strokes) & (F.col("h") <= high * strokes))
    middle = F.percentile("h", HEIGHT_SHARE)
    return fit.groupBy("image_id").agg(F.least(30 * F.first(strokes), F.greatest(3 * F.first(strokes), middle)).alias("text_height"))


def direction_ratio(blobs: DataFrame) -> DataFrame:
    """(image_id, ratio): area of blobs (w, h, area) over twice as high as wide against that of those over twice as wide as high."""
    tall = F.sum(F.when(F.col("h") > 2 * F.col("w"), F.col("area")).otherwise(0.0))
    wide = F.sum(F.when(F.col("w") > 2 * F.col("h"), F.col("area")).otherwise(0.0))
    return blobs.groupBy("image_id").agg(((tall + 1) / (wide + 1)).alias("ratio"))


def rotation_of(ratios: DataFrame) -> DataFrame:
    """``ratios`` with the turn to apply (90 where writing runs upright) and how sure that is."""
    sideways = F.col("ratio") > 2.0
    sure = F.log(F.when(sideways, F.col("ratio")).otherwise(1 / F.greatest("ratio", F.lit(1e-6)))) / F.log(F.lit(20.0))
    return ratios.withColumn("rotation", F.when(sideways, 90).otherwise(0)).withColumn("confidence", F.least(F.lit(1.0), sure))


def target_texts(texts: DataFrame, connections: DataFrame) -> DataFrame:
    """The texts that a model is asked for: prose (source ``para``) only where it is in or near a shape, a label or a line's end."""
    ends = connections.select("image_id", F.explode("endpoints").alias("e")).select("image_id", F.col("e.text_id").alias("id")).where("coalesce(id, '') <> ''").distinct().withColumn("used", F.lit(True))
    placed = F.col("inside_shape_id").isNotNull() | (F.size("near_shape_ids") > 0) | F.col("connection_id").isNotNull()
    return texts.join(ends, ["image_id", "id"], "left").where(~F.array_contains("source", "para") | placed | F.coalesce("used", F.lit(False))).drop("used")


def state_lines(scene: Scene, stats: DataFrame, facts: list[str]) -> DataFrame:
    """(image_id, state): what a planner is told of each drawing: facts, page, counts, and shapes that are unsure."""
    kinds = scene.shapes.groupBy("image_id").agg(F.array_sort(F.collect_list("type")).alias("types")).select("image_id", t.kinds(F.col("types")).alias("kinds"))
    rows = scene.images.join(stats, "image_id").join(kinds, "image_id", "left").join(unsure_shapes(scene.shapes), "image_id", "left")
    whole = lambda c: F.format_string("%d", F.col(c).cast("long"))
    lines = [
        F.lit("facts: " + ", ".join(sorted(facts))),
        F.concat(F.lit("image: "), whole("width"), F.lit("x"), whole("height"), F.lit(", rotation "), whole("rotation")),
        F.concat(F.lit("shapes: "), whole("shapes"), F.lit(" ("), F.coalesce("kinds", F.lit("none")), F.lit("), max depth "), whole("max_depth")),
        F.concat(F.lit("connections: "), whole("connections"), F.lit(", texts: "), whole("texts"), F.lit(" ("), whole("texts_read"), F.lit(" transcribed)")),
        F.concat(F.lit("low-confidence shapes: "), F.array_join("ids", ", ")),
    ]
    return rows.select("image_id", F.concat_ws("\n", *lines).alias("state"))


def scene_summary(shapes: DataFrame, texts: DataFrame) -> DataFrame:
    """(image_id, summary): kinds of shapes, nesting, and the first six texts, as a generated drawing is summed up."""
    first = texts.where(F.coalesce("text", F.lit("")) != "").groupBy("image_id").agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("ord", "text"))), 1, LABELS_SHOWN), lambda r: r["text"]).alias("labels"))
    rows = shapes.groupBy("image_id").agg(t.kinds(F.collect_list("type")).alias("kinds"), F.max("depth").alias("depth")).join(first, "image_id", "left")
    nested = F.when(F.col("depth") > 0, F.format_string(", nested %d deep", F.col("depth"))).otherwise("")
    said = F.when(F.size("labels") > 0, F.concat(F.lit("; labels: "), F.array_join("labels", ", "))).otherwise("")
    return rows.select("image_id", F.concat("kinds", nested, said).alias("summary"))


def joined_sets(connections: DataFrame) -> DataFrame:
    """(image_id, ids): the distinct sets of elements that connectors join."""
    ids = F.array_sort(F.array_distinct(t.attached_ids(F.col("endpoints"))))
    return connections.select("image_id", ids.alias("ids")).where(F.size("ids") > 0).distinct()


def reading_walk(shapes: DataFrame, closure: DataFrame) -> DataFrame:
    """(image_id, id, depth, position): shapes with parent_id in the order of a walk through the nesting, children by ``ord``.

    ``closure`` (image_id, id, ancestor, steps) lists the ancestors. A shape's place is its ancestors' places and its own.
    """
    own = shapes.select("image_id", "id", "ord")
    above = closure.join(own.select("image_id", F.col("id").alias("ancestor"), F.col("ord").alias("at")), ["image_id", "ancestor"]).groupBy("image_id", "id").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("steps")).alias("s"), "at"))), lambda r: r["at"]).alias("above"))
    path = own.join(above, ["image_id", "id"], "left").withColumn("path", F.concat(F.coalesce("above", F.array().cast("array<int>")), F.array("ord")))
    order = Window.partitionBy("image_id").orderBy("path")
    return path.select("image_id", "id", (F.size("path") - 1).alias("depth"), F.row_number().over(order).alias("position"))


def consecutive_ends(connections: DataFrame) -> DataFrame:
    """(image_id, id, pos, a, b): each connector's attached elements, every one with the next."""
    ids = t.attached_ids(F.col("endpoints"))
    return connections.select("image_id", "id", F.posexplode(ids).alias("pos", "a"), ids.alias("ids")).withColumn("b", F.get("ids", F.col("pos") + 1)).where("b is not null").drop("ids")


def affine(points: Column, m: list[float]) -> Column:
    """Points under the map (x, y) -> (m0 x + m1 y + m2, m3 x + m4 y + m5), one decimal."""
    a, b, c, d, e, f = m
    return F.transform(points, lambda p: g.point(g.half_even(a * p["x"] + b * p["y"] + c, 1), g.half_even(d * p["x"] + e * p["y"] + f, 1)))


def affine_box(b: Column, m: list[float]) -> Column:
    """The box around a box's four corners under an affine map."""
    return g.box_of_points(affine(g.outline(b, F.lit("rectangle")), m))


def hue(n: Column) -> Column:
    """The hue (0 to 179) of the n-th of many marks: steps of the golden ratio keep neighbours apart."""
    return F.floor((n * 0.618033988749895) % 1.0 * 180).cast("int")


def prompt_text(template: str, **values: Column) -> Column:
    """A prompt with each {name} replaced by its value."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def as_list(value: Column) -> Column:
    """A model's value (JSON) as an array of JSON values: an array's elements, else the value alone; null, "" and {} give none."""
    v = t.strip(value)
    none = F.array().cast("array<string>")
    alone = v.isNull() | v.isin("null", '""', "{}")
    return F.when(alone, none).when(v.startswith("["), F.coalesce(F.from_json(v, "array<string>"), none)).otherwise(F.array(v))
