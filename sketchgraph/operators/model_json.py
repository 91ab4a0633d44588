"""Models' answers as tables: tolerant JSON, a model's drawing, a verifier's corrections, and the compact target."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sketchgraph.functions import geometry as g
from sketchgraph.functions import text as t
from sketchgraph.model import Scene

FENCE = re.compile(r"```(?:json)?\s*(.*?)```", re.DOTALL)
#: Model answers are untrusted: every leaf is read as a string.
ANSWER = "is_drawing string, summary string, shapes array<struct<id:string,type:string,bbox:array<double>,parent:string,crossed_out:string>>, texts array<struct<id:string,text:string,bbox:array<double>,inside:string,near:string,crossed_out:string>>, connections array<struct<id:string,type:string,heavy:string,ends:array<string>,path:array<array<double>>>>"
CORRECTIONS = "remove_shapes array<string>, remove_texts array<string>, remove_connections array<string>, retype_shapes map<string,string>, add_shapes array<struct<type:string,bbox:array<double>>>, text_corrections map<string,string>, add_connections array<struct<type:string,ends:array<string>>>"
READ_CONFIDENCE, PATH_POINTS = 0.6, 6
ADD_IOU, FIXED_CONFIDENCE = 0.5, 0.8


STRING = r'"(?:[^"\\]|\\.)*"?'
COMMENTS = re.compile(STRING + r"|//[^\n]*", re.DOTALL)
MARKS = re.compile(STRING + r"|[{}\[\]]", re.DOTALL)
OPENING, CLOSING = re.compile(r"[{\[]"), {"{": "}", "[": "]"}


def without_comments(text: str) -> str:
    """Text less ``//`` comments that stand outside strings."""
    return COMMENTS.sub(lambda m: "" if m[0].startswith("//") else m[0], text)


def balanced_spans(text: str):
    """Outermost balanced objects and arrays, in order, up to the first that is cut off or closed wrongly.

    Strings count within a value only: a quotation mark in the prose around it begins none.
    """
    at = 0
    while (start := OPENING.search(text, at)) is not None:
        open_: list[str] = []
        for m in MARKS.finditer(text, start.start()):
            if m[0] in CLOSING:
                open_.append(CLOSING[m[0]])
            elif m[0] in ("}", "]") and open_.pop() != m[0]:
                return
            if not open_:
                break
        if open_:
            return
        yield text[start.start() : m.end()]
        at = m.end()


def extracted(text: str | None) -> str | None:
    """The first JSON value of a model's answer as strict JSON; None if there is none or it is cut off.

    Fenced blocks come before the whole answer; each is tried as it is, then by its balanced spans; each of those as it is,
    without comments, and without trailing commas.
    """
    for block in [*FENCE.findall(text or ""), text or ""]:
        block = block.strip()
        for part, repairs in [(block, 1), *((s, 3) for s in balanced_spans(block))]:
            bare = without_comments(part) if repairs > 1 else part
            for attempt in (part, bare, re.sub(r",(\s*[}\]])", r"\1", bare))[:repairs]:
                try:
                    return json.dumps(json.loads(attempt), ensure_ascii=False, separators=(",", ":"))
                except ValueError:
                    continue
    return None


def _repaired(column: Column) -> Column:
    @F.pandas_udf("string")
    def repair(texts: pd.Series) -> pd.Series:
        return texts.map(extracted)

    return repair(column)


def strict_json(rows: DataFrame, column: str, out: str) -> DataFrame:
    """``rows`` with strict JSON from the answers in ``column``: only those that do not parse as they are go to Python."""
    good = F.coalesce(F.try_parse_json(column).isNotNull() & F.col(column).rlike(r"^\s*[{\[]"), F.lit(False))
    return rows.where(good).withColumn(out, F.col(column)).unionByName(rows.where(~good).withColumn(out, _repaired(F.col(column))))


def answers(rows: DataFrame, column: str = "answer") -> DataFrame:
    """``rows`` with ``read``, the answer's drawing with every leaf a string (null if unusable)."""
    return strict_json(rows, column, "_json").withColumn("read", F.from_json("_json", ANSWER)).drop("_json")


def read_shapes(rows: DataFrame, layout: Column | None = None, sent: Column | None = None) -> DataFrame:
    """Shapes of answers (image_id, width, height, read): those without a usable box are left out, dangling parents cleared."""
    each = rows.select("image_id", "width", "height", F.posexplode("read.shapes").alias("pos", "r")).where("r is not null")
    b = g.box_from_model(F.col("r.bbox"), F.col("width"), F.col("height"), layout, sent)
    out = each.select("image_id", F.coalesce(F.nullif("r.id", F.lit("")), F.concat(F.lit("S"), (F.col("pos") + 1).cast("string"))).alias("id"), (F.col("pos") + 1).alias("ord"), t.shape_type(F.col("r.type")).alias("type"), b.alias("bbox"), t.reference(F.col("r.parent")).alias("parent_id"), t.truth(F.col("r.crossed_out")).alias("crossed_out"))
    out = out.where("bbox is not null").withColumns({"polygon": g.outline(F.col("bbox"), F.col("type")), "confidence": F.lit(READ_CONFIDENCE), "source": F.array(F.lit("vlm"))})
    ids = out.select("image_id", F.col("id").alias("known")).distinct()
    kept = out.alias("s").join(ids.alias("k"), (F.col("s.image_id") == F.col("k.image_id")) & (F.col("parent_id") == F.col("known")), "left")
    return kept.select(*(F.col(f"s.{c}") for c in out.columns if c != "parent_id"), F.col("known").alias("parent_id"))


def read_texts(rows: DataFrame, layout: Column | None = None, sent: Column | None = None) -> DataFrame:
    """Texts of answers; ``near`` may be one reference or an array of them."""
    each = rows.select("image_id", "width", "height", F.posexplode("read.texts").alias("pos", "r")).where("r is not null")
    b = g.box_from_model(F.col("r.bbox"), F.col("width"), F.col("height"), layout, sent)
    near = F.when(F.col("r.near").rlike(r"^\s*\["), F.from_json("r.near", "array<string>")).otherwise(F.array("r.near"))
    near = F.filter(F.transform(F.coalesce(near, F.array().cast("array<string>")), t.reference), lambda i: i.isNotNull())
    inside = t.reference(F.col("r.inside"))
    return each.select(
        "image_id", F.coalesce(F.nullif("r.id", F.lit("")), F.concat(F.lit("T"), (F.col("pos") + 1).cast("string"))).alias("id"), (F.col("pos") + 1).alias("ord"), F.nullif("r.text", F.lit("")).alias("text"), b.alias("bbox"),
        F.when(inside.isNotNull(), "inside").when(F.size(near) > 0, "near").otherwise("free").alias("placement"), inside.alias("inside_shape_id"), near.alias("near_shape_ids"), t.truth(F.col("r.crossed_out")).alias("crossed_out"), F.lit(READ_CONFIDENCE).alias("confidence"), F.array(F.lit("vlm")).alias("source"),
    ).where("bbox is not null")


def read_connections(rows: DataFrame, shapes: DataFrame, texts: DataFrame, layout: Column | None = None) -> DataFrame:
    """Connections of answers, their ends resolved against the answer's own shapes and texts."""
    each = rows.select("image_id", "width", "height", F.posexplode("read.connections").alias("pos", "r")).where("r is not null")
    ids = lambda df, n: df.groupBy("image_id").agg(F.collect_set("id").alias(n))
    each = each.join(ids(shapes, "sids"), "image_id", "left").join(ids(texts, "tids"), "image_id", "left")
    path = F.filter(F.transform(F.coalesce("r.path", F.array().cast("array<array<double>>")), lambda p: g.point_from_model(p, F.col("width"), F.col("height"), layout)), lambda p: p.isNotNull())
    each = each.withColumn("path", path).withColumn("kind", F.when(F.lower("r.type") == "arrow", "arrow").otherwise("line"))
    known = lambda i, n: F.coalesce(F.array_contains(n, i), F.lit(False))
    origin = g.point(F.lit(0.0), F.lit(0.0))

    def end(ref, j):
        i = t.reference(ref)
        at = F.when(F.size("path") == 0, origin).when(j == 0, F.get("path", F.lit(0))).otherwise(F.try_element_at("path", F.lit(-1)))
        attachment = F.when(known(i, "tids"), "text").when(known(i, "sids"), "boundary").otherwise("free")
        return F.struct(at.alias("point"), F.when(known(i, "sids"), i).alias("shape_id"), F.when(known(i, "tids"), i).alias("text_id"), attachment.alias("attachment"), ((F.col("r.type") == "arrow") & (j == F.size("r.ends") - 1)).alias("is_head"))

    ends = F.transform(F.coalesce("r.ends", F.array().cast("array<string>")), end)
    return each.select("image_id", F.coalesce(F.nullif("r.id", F.lit("")), F.concat(F.lit("C"), (F.col("pos") + 1).cast("string"))).alias("id"), (F.col("pos") + 1).alias("ord"), F.col("kind").alias("type"), "path", ends.alias("endpoints"), t.truth(F.col("r.heavy")).alias("heavy"), F.lit(READ_CONFIDENCE).alias("confidence"), F.array(F.lit("vlm")).alias("source"))


def corrected_shapes(shapes: DataFrame, images: DataFrame, answers_: DataFrame) -> DataFrame:
    """Shapes after a verifier's removals, retypings and additions, with ``change`` (removed rows are gone).

    ``answers_`` has (image_id, fix) with ``fix`` read by CORRECTIONS. Added shapes that overlap a kept one by more than half
    are left out; ids of added ones follow the highest number of the image, removed ones included.
    """
    fix = answers_.select("image_id", "fix").join(images.select("image_id", "width", "height"), "image_id")
    held = shapes.join(fix, "image_id", "left")
    gone = F.coalesce(F.array_contains(F.transform("fix.remove_shapes", t.reference), F.col("id")), F.lit(False))
    asked = F.try_element_at("fix.retype_shapes", F.col("id"))
    new = t.shape_type(asked)
    retyped = asked.isNotNull() & (new != "unknown") & (new != F.col("type"))
    kept = held.where(~gone).select(*(c for c in shapes.columns if c not in ("type", "source")), F.col("type").alias("old_type"), F.when(retyped, new).otherwise(F.col("type")).alias("type"), F.when(retyped, F.array_union("source", F.array(F.lit("verifier")))).otherwise(F.col("source")).alias("source"), F.when(retyped, "retyped").otherwise("kept").alias("change"))
    added = fix.select("image_id", "width", "height", F.posexplode("fix.add_shapes").alias("pos", "r")).where("r is not null")
    added = added.select("image_id", F.col("pos").alias("ord"), t.shape_type(F.col("r.type")).alias("type"), g.box_from_model(F.col("r.bbox"), F.col("width"), F.col("height")).alias("bbox")).where("bbox is not null")
    over = kept.select(F.col("image_id").alias("k_image"), F.col("bbox").alias("k"))
    added = added.join(over, (F.col("image_id") == F.col("k_image")) & (g.iou(F.col("k"), F.col("bbox")) > ADD_IOU), "left_anti")
    from sketchgraph.operators.identity import fresh_numbers

    added = fresh_numbers(shapes, added, "S").withColumns({"polygon": g.outline(F.col("bbox"), F.col("type")), "confidence": F.lit(0.5), "source": F.array(F.lit("verifier")), "change": F.lit("added")})
    return kept.unionByName(added, allowMissingColumns=True)


def corrected_texts(texts: DataFrame, answers_: DataFrame) -> DataFrame:
    """Texts after a verifier's removals and corrections, with ``change``."""
    held = texts.join(answers_.select("image_id", "fix"), "image_id", "left")
    gone = F.coalesce(F.array_contains(F.transform("fix.remove_texts", t.reference), F.col("id")), F.lit(False))
    new = t.strip(F.try_element_at("fix.text_corrections", F.col("id")))
    fixed = F.coalesce((new != "") & ~new.eqNullSafe(F.col("text")), F.lit(False))
    return held.where(~gone).select(*(c for c in texts.columns if c != "text"), F.when(fixed, new).otherwise(F.col("text")).alias("text"), F.when(fixed, "fixed").otherwise("kept").alias("change"))


def corrected_connections(connections: DataFrame, shapes: DataFrame, texts: DataFrame, answers_: DataFrame) -> DataFrame:
    """Connections after a verifier's removals and additions, with ``change``; ``shapes`` and ``texts`` are the corrected ones.

    An added connection needs two elements that are there; ids go on from the highest number, removed ones included.
    """
    from sketchgraph.operators.fusion import added_connections

    held = connections.join(answers_.select("image_id", "fix"), "image_id", "left")
    gone = F.coalesce(F.array_contains(F.transform("fix.remove_connections", t.reference), F.col("id")), F.lit(False))
    kept = held.where(~gone).select(*connections.columns, F.lit("kept").alias("change"))
    wanted = answers_.select("image_id", F.posexplode("fix.add_connections").alias("n", "r")).where("r is not null")
    ends = F.filter(F.transform(F.coalesce("r.ends", F.array().cast("array<string>")), t.reference), lambda e: e.isNotNull())
    wanted = wanted.select("image_id", "n", F.coalesce("r.type", F.lit("line")).alias("type"), F.lit(False).alias("heavy"), ends.alias("ends"), F.array().cast(g.POINTS).alias("path"))
    added = added_connections(connections, wanted, shapes, texts, "verifier", False)
    return kept.unionByName(added.withColumn("change", F.lit("added")), allowMissingColumns=True)


def corrected(scene: Scene, answers_: DataFrame) -> Scene:
    """A scene after a verifier's answers (image_id, fix): removals, then dangling references, then all other corrections."""
    from sketchgraph.operators.identity import without_dangling

    gone = lambda df, what: df.join(answers_.select("image_id", F.explode(F.transform(f"fix.{what}", t.reference)).alias("id")).distinct(), ["image_id", "id"], "left_anti")
    left = without_dangling(scene.with_(shapes=gone(scene.shapes, "remove_shapes"), texts=gone(scene.texts, "remove_texts"), connections=gone(scene.connections, "remove_connections")))
    # ids are counted over the scene as it was, so no removed id comes back
    shapes = corrected_shapes(scene.shapes, scene.images, answers_).drop("change", "old_type")
    if "parent_id" in left.shapes.columns:
        shapes = shapes.drop("parent_id").join(left.shapes.select("image_id", "id", "parent_id"), ["image_id", "id"], "left")
    texts = corrected_texts(left.texts, answers_).drop("change")
    connections = corrected_connections(scene.connections, shapes, texts, answers_).drop("change")
    ends = left.connections.select("image_id", "id", F.col("endpoints").alias("cleared"))
    connections = connections.join(ends, ["image_id", "id"], "left").withColumn("endpoints", F.coalesce("cleared", "endpoints")).drop("cleared")
    return scene.with_(shapes=shapes, texts=texts, connections=connections)


def targets(scene: Scene) -> DataFrame:
    """(image_id, target): each drawing as the compact JSON that a model is trained to answer."""
    w, h = F.col("width"), F.col("height")
    size = scene.images.select("image_id", "width", "height")

    def listed(df: DataFrame, name: str, **columns: Column) -> DataFrame:
        item = F.struct("ord", F.struct(*(c.alias(k) for k, c in columns.items())).alias("item"))
        rows = df.join(size, "image_id").select("image_id", item.alias("i")).groupBy("image_id").agg(F.array_sort(F.collect_list("i"), lambda a, b: a["ord"] - b["ord"]).alias(name))
        return rows.withColumn(name, F.transform(name, lambda i: i["item"]))

    c = F.col
    has = lambda df, n, d: c(n) if n in df.columns else d
    null = F.lit(None).cast("string")
    shapes = listed(scene.shapes, "shapes", id=c("id"), type=c("type"), bbox=g.normalised_box(c("bbox"), w, h), parent=has(scene.shapes, "parent_id", null), crossed_out=has(scene.shapes, "crossed_out", F.lit(False)))
    texts = listed(scene.texts, "texts", id=c("id"), text=F.coalesce("text", F.lit("")), bbox=g.normalised_box(c("bbox"), w, h), inside=has(scene.texts, "inside_shape_id", null), near=has(scene.texts, "near_shape_ids", F.array().cast("array<string>")), crossed_out=has(scene.texts, "crossed_out", F.lit(False)))
    points = F.when(F.size("path") > 0, c("path")).otherwise(F.transform("endpoints", lambda e: e["point"]))
    few = F.transform(F.sequence(F.lit(0), F.lit(PATH_POINTS - 1)), lambda i: F.get(points, F.rint(i * (F.size(points) - 1) / (PATH_POINTS - 1)).cast("int")))
    path = F.transform(F.when(F.size(points) > PATH_POINTS, few).otherwise(points), lambda p: F.array(F.rint(1000 * p["x"] / w).cast("int"), F.rint(1000 * p["y"] / h).cast("int")))
    lines = listed(scene.connections, "connections", id=c("id"), type=c("type"), heavy=c("heavy"), ends=F.transform("endpoints", lambda e: F.coalesce(F.nullif(e["text_id"], F.lit("")), e["shape_id"])), path=path)
    out = scene.images.select("image_id", *(has(scene.images, n, F.lit(None)).alias(n) for n in ("is_drawing", "summary")))
    for df in (shapes, texts, lines):
        out = out.join(df, "image_id", "left")
    empty = lambda n, like: F.coalesce(n, F.array().cast(like.schema[n].dataType))
    target = F.struct(F.coalesce(c("is_drawing").cast("boolean"), F.lit(True)).alias("is_drawing"), empty("shapes", shapes).alias("shapes"), empty("texts", texts).alias("texts"), empty("connections", lines).alias("connections"), F.coalesce(c("summary").cast("string"), F.lit("")).alias("summary"))
    return out.select("image_id", F.to_json(target, {"ignoreNullFields": "false"}).alias("target"))
