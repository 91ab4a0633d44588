"""Data sets and results on disk: one folder a split, written by Spark wherever there is a row an image."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sketchgraph.functions.text import DETECTOR_CLASSES
from sketchgraph.model import Scene, as_json
from sketchgraph.operators import export, model_json

FORMATS = ("yolo", "coco", "vlm", "ocr")


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text file at a path of any file system that Spark knows; an old one is replaced."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    out.write(bytearray(text.encode()))
    out.close()


def data_yaml(folder: str, has_val: bool) -> str:
    """A detector's data file; without a validation split the training images stand for it."""
    names = "\n".join(f"  {i}: {c}" for i, c in enumerate(DETECTOR_CLASSES))
    return f"path: {folder}\ntrain: images/train\nval: images/{'val' if has_val else 'train'}\nnames:\n{names}\n"


def coco_images(images: DataFrame) -> DataFrame:
    """(id, file_name, width, height) of images (image_id, split, width, height)."""
    name = F.format_string("images/%s/syn_%06d.jpg", F.col("split"), F.col("image_id"))
    return images.select(F.col("image_id").alias("id"), name.alias("file_name"), F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"))


def coco_categories(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i + 1, c) for i, c in enumerate(DETECTOR_CLASSES)], "id int, name string")


def split_counts(images: DataFrame) -> dict[str, int]:
    found = {r["split"]: r["count"] for r in images.groupBy("split").count().collect()}
    return {f"n_{s}": found.get(s, 0) for s in ("train", "val")}


def write_dataset(scene: Scene, splits: DataFrame, folder: str, formats: tuple[str, ...] = FORMATS, system: str = "", prompt: str = "") -> dict:
    """A training set of a scene with ``splits`` (image_id, split): annotations, then per split the formats asked for; the summary.

    ``annotations`` has a JSON line a drawing, ``labels`` (image_id, name, lines), ``coco`` images, annotations and categories,
    ``vlm`` chat samples, ``ocr`` a table of texts to crop; all by split. ``data.yaml`` and ``dataset.json`` are single files.
    """
    spark = scene.images.sparkSession
    images = scene.images.join(splits, "image_id")
    put = lambda df, name: df.write.mode("overwrite").partitionBy("split").json(f"{folder}/{name}")
    put(as_json(scene).join(splits, "image_id"), "annotations")
    counts = split_counts(images)
    objects = export.detector_objects(scene).join(splits, "image_id") if {"yolo", "coco"} & set(formats) else None
    if "yolo" in formats:
        lines = export.yolo_lines(objects.drop("split"), scene.images).groupBy("image_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "ord", "line"))), lambda r: r["line"]).alias("lines"))
        put(lines.join(splits, "image_id").withColumn("name", F.format_string("syn_%06d.txt", "image_id")), "labels")
        put_text(spark, f"{folder}/data.yaml", data_yaml(folder, counts["n_val"] > 0))
    if "coco" in formats:
        for split in ("train", "val"):
            mine = objects.where(F.col("split") == split).drop("split")
            export.annotations(mine).write.mode("overwrite").json(f"{folder}/coco/annotations/split={split}")
        put(coco_images(images).join(splits.withColumnRenamed("image_id", "id"), "id"), "coco/images")
        coco_categories(spark).write.mode("overwrite").json(f"{folder}/coco/categories")
    if "vlm" in formats:
        chats = export.chat_samples(model_json.targets(scene), system, prompt)
        put(chats.join(splits.select(F.format_string("syn_%06d", "image_id").alias("id"), "split"), "id"), "vlm")
    if "ocr" in formats:
        rows = export.ocr_rows(scene.texts, scene.images).withColumn("image_id", F.regexp_extract("path", r"syn_([0-9]+)_", 1).cast("long")).join(splits, "image_id")
        rows.select("split", "path", "text", "crossed_out").write.mode("overwrite").partitionBy("split").option("sep", "\t").option("header", True).csv(f"{folder}/ocr")
    summary = {"out_dir": folder, **counts, "formats": list(formats), "classes": list(DETECTOR_CLASSES)}
    put_text(spark, f"{folder}/dataset.json", json.dumps(summary, indent=2))
    return summary


def paired(annotations: DataFrame, images: DataFrame) -> DataFrame:
    """Annotations (stem, ...) with the image file (path, content) of the same name."""
    files = images.select(F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("stem"), F.col("path").alias("image_path"), "content")
    return annotations.join(files, "stem")


def write_results(scene: Scene, folder: str, notes: DataFrame | None = None) -> None:
    """Each drawing as JSON, DOT, Mermaid and a Markdown description, a row each in four folders.

    ``scene`` has its topology; ``notes`` (image_id, step, agent, message) are appended to the descriptions.
    """
    texts = export.graph_texts(scene)
    as_json(scene).write.mode("overwrite").json(f"{folder}/json")
    for name in ("dot", "mermaid"):
        texts.select("image_id", name).write.mode("overwrite").json(f"{folder}/{name}")
    rows = texts.select("image_id", F.concat(F.format_string("# drawing %d\n\n", "image_id"), "description").alias("text"), "mermaid")
    if notes is not None:
        said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step", "agent", "message"))), lambda r: F.concat(r["step"].cast("string"), F.lit(". **"), r["agent"], F.lit("**: "), r["message"])), "\n")
        rows = rows.join(notes.groupBy("image_id").agg(said.alias("trace")), "image_id", "left")
        rows = rows.withColumn("text", F.concat("text", F.coalesce(F.concat(F.lit("\n\n## Steps\n\n"), "trace"), F.lit(""))))
    rows.select("image_id", F.concat("text", F.lit("\n\n```mermaid\n"), "mermaid", F.lit("\n```")).alias("text")).write.mode("overwrite").json(f"{folder}/descriptions")


def write_reports(reports: DataFrame, folder: str) -> list[str]:
    """Evaluation reports (system, ...) as JSON lines and as a Markdown table, which is also returned."""
    from sketchgraph.operators.evaluate import report_lines

    head = "| system | shapes P/R/F1 | type acc | family acc | containment F1 | texts F1 | text CER | inside acc | connections F1 |"
    lines = [head, "|" + "---|" * (head.count("|") - 1), *(r["line"] for r in report_lines(reports).orderBy("system").collect())]
    reports.write.mode("overwrite").json(f"{folder}/reports")
    put_text(reports.sparkSession, f"{folder}/report.md", "\n".join(lines) + "\n")
    return lines

