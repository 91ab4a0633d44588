"""Where scenes come from: annotation files, images, chat lines, and a fixed view over the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sketchgraph.functions.geometry import box, outline, point
from sketchgraph.functions.text import SHAPE_TYPES
from sketchgraph.model import Scene

WIDTH, HEIGHT, STROKE, TEXT_HEIGHT = 1200.0, 900.0, 2.0, 16.0
#: Rows of parts (a long and an int) that go to all tasks; more are joined by a shuffle.
PARTS = 2_000_000
IMAGE_GLOB = "*.{jpg,jpeg,png,webp,tif,tiff,bmp,JPG,JPEG,PNG,WEBP,TIF,TIFF,BMP}"


def read_annotations(spark: SparkSession, folder: str, schema: StructType, limit: int | None = None) -> DataFrame:
    """(path, stem, ...) of the JSON files of a folder in order of path, optionally the first ``limit``."""
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(f"{folder}/*.json").withColumn("path", F.input_file_name())
    rows = rows.withColumn("stem", F.regexp_extract("path", r"([^/]+)\.json$", 1))
    return rows.orderBy("path").limit(limit) if limit else rows


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content, ...) of the image files directly in a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", IMAGE_GLOB).option("recursiveFileLookup", False).load(folder)


def read_lines(spark: SparkSession, path: str, schema: StructType, limit: int | None = None) -> DataFrame:
    """Rows of a JSON-lines file; blank lines are skipped."""
    rows = spark.read.schema(schema).json(path)
    return rows.limit(limit) if limit else rows


def order_scenes(spark: SparkSession, sf_dir: str) -> Scene:
    """One drawing an order: a box for each line item, two texts, and connectors between neighbouring boxes."""
    table = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
    # the next item comes from the same window, and a bounded table of parts goes to all tasks: items are dealt once, by their order
    after = F.lead(F.struct("l_partkey", "l_suppkey", "l_quantity")).over(order)
    numbered = table("lineitem").withColumn("rn", F.row_number().over(order))
    part = table("part").select("p_partkey", "p_size")
    part = F.broadcast(part) if part.count() <= PARTS else part

    def box_at(partkey, suppkey, quantity, size, rn):
        return box((F.col(partkey) * 37 + rn * 211) % 800, (F.col(suppkey) * 91 + rn * 157) % 600, F.lit(40.0) + F.col(quantity) * F.col(size) * 0.25, F.lit(30.0) + F.col(quantity) * F.col(size) * 0.2)

    items = numbered.join(part, F.col("l_partkey") == F.col("p_partkey"))
    b = box_at("l_partkey", "l_suppkey", "l_quantity", "p_size", F.col("rn"))
    shapes = items.select(
        F.col("l_orderkey").alias("image_id"), F.concat(F.lit("S"), F.col("rn").cast("string")).alias("id"), F.col("rn").cast("int").alias("ord"),
        F.element_at(F.array(*map(F.lit, SHAPE_TYPES)), (F.col("p_size") % 10 + 1).cast("int")).alias("type"), b.alias("bbox"), outline(b, F.lit("rectangle")).alias("polygon"),
        (F.col("l_discount") * 5).alias("ink_density"), F.when(F.col("l_returnflag") == "R", F.array(F.lit("cv"), F.lit("vlm"))).otherwise(F.array(F.lit("cv"))).alias("source"), (F.lit(0.5) + F.col("l_tax")).alias("confidence"),
    )
    orders = table("orders")
    k = F.col("k")
    texts = orders.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("k")).select(
        F.col("o_orderkey").alias("image_id"), F.concat(F.lit("T"), k.cast("string")).alias("id"), k.alias("ord"), F.when(k == 1, F.col("o_orderpriority")).otherwise(F.col("o_orderstatus")).alias("text"),
        box((F.col("o_custkey") * 53 + k * 307) % 900, (F.col("o_orderkey") * 29 + k * 173) % 700, F.lit(20) + (F.col("o_custkey") % 5) * 10, F.lit(16)).alias("bbox"),
    )
    mid = lambda c: point(F.col(c)["x"] + F.col(c)["w"] / 2, F.col(c)["y"] + F.col(c)["h"] / 2)
    next_part = part.select(F.col("p_partkey").alias("n_partkey"), F.col("p_size").alias("n_size"))
    pairs = numbered.withColumn("n", after).where("rn % 2 = 1 and n is not null").join(part, F.col("l_partkey") == F.col("p_partkey")).join(next_part, F.col("n.l_partkey") == F.col("n_partkey"))
    joined = pairs.select(F.col("l_orderkey").alias("image_id"), F.col("rn").alias("ord"), "l_returnflag", "l_linestatus", b.alias("a"), box_at("n.l_partkey", "n.l_suppkey", "n.l_quantity", "n_size", F.col("rn") + 1).alias("b"))
    ends = F.array(*(F.struct(mid(c).alias("point"), F.lit(None).cast("string").alias("shape_id"), F.lit(None).cast("string").alias("text_id"), F.lit("free").alias("attachment"), ((F.col("l_linestatus") == "F") & F.lit(c == "b")).alias("is_head")) for c in "ab"))
    connections = joined.select(
        "image_id", F.concat(F.lit("C"), ((F.col("ord") + 1) / 2).cast("int").cast("string")).alias("id"), ((F.col("ord") + 1) / 2).cast("int").alias("ord"), F.when(F.col("l_linestatus") == "F", "arrow").otherwise("line").alias("type"),
        F.array(mid("a"), mid("b")).alias("path"), ends.alias("endpoints"), (F.col("l_returnflag") == "R").alias("heavy"), F.array(F.lit("cv")).alias("source"),
        F.hypot(F.col("b.x") + F.col("b.w") / 2 - F.col("a.x") - F.col("a.w") / 2, F.col("b.y") + F.col("b.h") / 2 - F.col("a.y") - F.col("a.h") / 2).alias("length_px"), F.lit(False).alias("locked_ends"),
    )
    images = orders.select(F.col("o_orderkey").alias("image_id"), F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"), F.lit(STROKE).alias("stroke_width"), F.lit(TEXT_HEIGHT).alias("text_height"), ((F.col("o_custkey") % 4) * 90).cast("int").alias("rotation"), F.lit(0.5).alias("scale"), box(F.lit(30), F.lit(50), F.lit(WIDTH), F.lit(HEIGHT)).alias("crop"))
    return Scene(images, shapes, texts, connections)


def outlined(shapes: DataFrame) -> DataFrame:
    """Shapes with the outlines of their types: round, three-cornered, tilted or the box."""
    return shapes.withColumn("polygon", outline(F.col("bbox"), F.col("type")))


def predicted(shapes: DataFrame) -> DataFrame:
    """A second reading of the boxes: every seventh is missed, others lie up to two pixels to the right."""
    shift = (F.col("ord") % 3).cast("double")
    moved = F.struct((F.col("bbox.x") + shift).alias("x"), F.col("bbox.y").alias("y"), F.col("bbox.w").alias("w"), F.col("bbox.h").alias("h"))
    return shapes.where("ord % 7 <> 0").withColumn("bbox", moved).withColumn("polygon", outline(F.col("bbox"), F.lit("rectangle")))
