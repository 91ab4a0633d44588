"""Ids and references: fresh ids, compact renumbering in reading order, and dangling references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sketchgraph.functions import geometry as g
from sketchgraph.model import Scene

#: Height of a row of elements in reading order.
ROW = 40


def reading_order(df: DataFrame, prefix: str, x: str = "bbox.x", y: str = "bbox.y") -> DataFrame:
    """(image_id, old, new): compact ids by rows of 40 pixels, then from the left; ties by ``ord``."""
    order = Window.partitionBy("image_id").orderBy(F.rint(F.col(y) / ROW), F.col(x), F.col("ord"))
    return df.select("image_id", F.col("id").alias("old"), F.concat(F.lit(prefix), F.row_number().over(order).cast("string")).alias("new"))


def connector_box() -> Column:
    """The box of a connector's path, or of its ends where it has none."""
    return F.when(F.size("path") > 0, g.box_of_points(F.col("path"))).otherwise(g.box_of_points(F.transform("endpoints", lambda e: e["point"])))


def renumbered(scene: Scene) -> Scene:
    """Compact ids S1.., T1.., C1.. in reading order; every reference follows, unknown ones stay."""
    boxed = scene.connections.withColumn("box", connector_box())
    names = reading_order(scene.shapes, "S").unionByName(reading_order(scene.texts, "T")).unionByName(reading_order(boxed, "C", "box.x", "box.y"))
    maps = names.groupBy("image_id").agg(F.map_from_entries(F.collect_list(F.struct("old", "new"))).alias("names"))
    one = lambda c: F.coalesce(F.try_element_at("names", c), c)
    many = lambda c: F.transform(c, lambda i: F.coalesce(F.try_element_at(F.col("names"), i), i))

    def moved(df: DataFrame, singles: tuple, lists: tuple, **more: Column) -> DataFrame:
        out = df.join(maps, "image_id", "left")
        new = {c: one(F.col(c)) for c in singles if c in df.columns} | {c: many(F.col(c)) for c in lists if c in df.columns} | more
        out = out.withColumns(new).drop("names")
        return out.withColumn("ord", F.substring("id", 2, 12).cast("int")) if "ord" in df.columns else out

    ends = F.transform("endpoints", lambda e: F.struct(e["point"].alias("point"), one(e["shape_id"]).alias("shape_id"), one(e["text_id"]).alias("text_id"), e["attachment"].alias("attachment"), e["is_head"].alias("is_head")))
    return scene.with_(
        shapes=moved(scene.shapes, ("id", "parent_id"), ("text_inside", "text_near")),
        texts=moved(scene.texts, ("id", "inside_shape_id", "connection_id"), ("near_shape_ids",)),
        connections=moved(scene.connections, ("id",), ("crosses", "label_ids"), endpoints=ends),
        relations=None if scene.relations is None else moved(scene.relations, ("subject", "object", "via"), ()),
    )


def without_dangling(scene: Scene) -> Scene:
    """References to shapes and texts that are not there become null, or leave their list."""
    ids = lambda df, name: df.groupBy("image_id").agg(F.collect_set("id").alias(name))
    shapes, texts = ids(scene.shapes, "sids"), ids(scene.texts, "tids")
    known = lambda c, name: F.when(F.array_contains(F.coalesce(name, F.array().cast("array<string>")), c), c)
    out = {}
    if "parent_id" in scene.shapes.columns:
        out["shapes"] = scene.shapes.join(shapes, "image_id", "left").withColumn("parent_id", known(F.col("parent_id"), "sids")).drop("sids")
    held = scene.texts.join(shapes, "image_id", "left")
    for c in {"inside_shape_id", "near_shape_ids"} & set(scene.texts.columns):
        held = held.withColumn(c, known(F.col(c), "sids") if c == "inside_shape_id" else F.array_intersect(c, F.coalesce("sids", F.array().cast("array<string>"))))
    ends = F.transform("endpoints", lambda e: F.struct(e["point"].alias("point"), known(e["shape_id"], "sids").alias("shape_id"), known(e["text_id"], "tids").alias("text_id"), e["attachment"].alias("attachment"), e["is_head"].alias("is_head")))
    connections = scene.connections.join(shapes, "image_id", "left").join(texts, "image_id", "left").withColumn("endpoints", ends).drop("sids", "tids")
    return scene.with_(texts=held.drop("sids"), connections=connections, **out)


def fresh_numbers(existing: DataFrame, new: DataFrame, prefix: str, floors: DataFrame | None = None) -> DataFrame:
    """``new`` (image_id, ord, ...) with ids above any that the image has or, by ``floors`` (image_id, floor), ever had."""
    number = F.regexp_extract("id", f"^{prefix}([0-9]+)$", 1).try_cast("int")
    top = existing.select("image_id", number.alias("n"))
    if floors is not None:
        top = top.unionByName(floors.select("image_id", F.col("floor").alias("n")))
    top = top.groupBy("image_id").agg(F.coalesce(F.max("n"), F.lit(0)).alias("top"))
    rank = F.row_number().over(Window.partitionBy("image_id").orderBy("ord"))
    return new.join(top, "image_id", "left").withColumn("id", F.concat(F.lit(prefix), (F.coalesce("top", F.lit(0)) + rank).cast("string"))).drop("top")
