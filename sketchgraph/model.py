"""Schemas of the scene tables, and a scene as a set of DataFrames keyed by image_id."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BOX = "struct<x:double,y:double,w:double,h:double>"
POINT = "struct<x:double,y:double>"
ENDPOINT = f"struct<point:{POINT},shape_id:string,text_id:string,attachment:string,is_head:boolean>"
SHAPES = f"image_id long, id string, ord int, type string, bbox {BOX}, polygon array<{POINT}>, confidence double, parent_id string, depth int, crossed_out boolean, source array<string>, ink_density double, attributes map<string,string>"
TEXTS = f"image_id long, id string, ord int, text string, bbox {BOX}, placement string, inside_shape_id string, near_shape_ids array<string>, connection_id string, crossed_out boolean, confidence double, source array<string>"
CONNECTIONS = f"image_id long, id string, ord int, type string, path array<{POINT}>, endpoints array<{ENDPOINT}>, heavy boolean, crosses array<string>, label_ids array<string>, confidence double, source array<string>, length_px double, locked_ends boolean"
IMAGES = f"image_id long, path string, width double, height double, rotation int, scale double, crop {BOX}, stroke_width double, text_height double, is_drawing boolean, summary string"
RELATIONS = "image_id long, type string, subject string, object string, via string, confidence double"


@dataclass(frozen=True)
class Scene:
    """Many drawings: one row of ``images`` each, and their elements. Operators map scenes to scenes, lazily."""

    images: DataFrame
    shapes: DataFrame
    texts: DataFrame
    connections: DataFrame
    relations: DataFrame | None = None

    def with_(self, **tables: DataFrame) -> Scene:
        return replace(self, **tables)


def blank(df: DataFrame, ddl: str) -> DataFrame:
    """``df`` with the columns of a schema: those it lacks are null, others are dropped."""
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(ddl)
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))


def nested(scene: Scene) -> DataFrame:
    """One row an image: (image_id, image, shapes, texts, connections), elements in order."""
    out = scene.images.select("image_id", F.struct(*(c for c in scene.images.columns if c != "image_id")).alias("image"))
    for name in ("shapes", "texts", "connections"):
        df = getattr(scene, name)
        columns = ["ord", *(c for c in df.columns if c not in ("image_id", "ord"))]
        out = out.join(df.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct(*columns)), lambda a, b: a["ord"] - b["ord"]).alias(name)), "image_id", "left")
    return out


def normalised(rows: DataFrame) -> Scene:
    """The scene of rows that :func:`nested` made."""
    elements = {n: rows.select("image_id", F.inline(n)) for n in ("shapes", "texts", "connections")}
    return Scene(rows.select("image_id", "image.*"), **elements)


def as_json(scene: Scene) -> DataFrame:
    """(image_id, json): each drawing as a JSON object, nulls written out."""
    rows = nested(scene)
    return rows.select("image_id", F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("json"))


def from_json(rows: DataFrame, like: Scene) -> Scene:
    """The scene of (json) rows; malformed input fails."""
    schema = nested(like).schema
    return normalised(rows.select(F.from_json("json", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*"))
