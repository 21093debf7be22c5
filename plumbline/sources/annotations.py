"""Annotation sources as record rows: COCO JSON, YOLO text files, VOC XML. A row holds a record and its boxes.

All readers return record_id, width, height, boxes (array of source_label, x1, y1, x2, y2) and counts of
what policies dropped, so one contract serves every layout.
"""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import corner_box
from plumbline.operators.stash import stash

BOX = "struct<source_label:string,x1:double,y1:double,x2:double,y2:double>"
COCO = "images array<struct<id:long,file_name:string,width:int,height:int>>, annotations array<struct<id:long,image_id:long,category_id:long,bbox:array<double>,iscrowd:int>>, categories array<struct<id:long,name:string>>"


def read_coco(spark: SparkSession, path: str, labels: list[str] | None = None, lines: bool = False) -> DataFrame:
    """COCO annotations. Crowd boxes, boxes without area and boxes of other labels are dropped and counted.

    An annotation of an unknown image or category, or a repeated id, is an error. Several files are one
    dataset: they may share categories, if ids and names agree, but no image or annotation id. A file is
    one JSON object; with `lines` each of its lines is one, and counts as a file of its own.
    """
    raw = spark.read.schema(COCO).json(path, multiLine=not lines)
    part = lambda c: F.transform(F.coalesce(c, F.array()), lambda x: F.struct(*((x if n == c else F.lit(None).cast(raw.schema[n].dataType.elementType)).alias(n) for n in raw.columns)))
    # files are parsed once: each image, annotation and category becomes a row
    rows = stash(raw.withColumn("f", F.monotonically_increasing_id()).select("f", F.explode(F.concat(*map(part, raw.columns))).alias("r")).select("f", "r.*"), "coco-rows")
    kinds = rows.where("categories is not null").select("f", "categories.*")
    doubled = kinds.groupBy("f", "id").count().where("count > 1").select("id").unionByName(kinds.groupBy("id").agg(F.countDistinct("name").alias("n")).where("n > 1").select("id")).distinct().count()
    images = rows.where("images is not null").select("images.*")
    names = kinds.select(F.col("id").alias("category_id"), F.col("name").alias("source_label")).distinct()
    marks = rows.where("annotations is not null").select("annotations.*")
    stray = marks.join(images.select(F.col("id").alias("image_id")), "image_id", "left_anti").count() + marks.join(names, "category_id", "left_anti").count()
    repeated = images.groupBy("id").count().where("count > 1").count() + marks.groupBy("id").count().where("count > 1").count()
    if stray or repeated or doubled:
        raise ValueError(f"COCO: {stray} annotations of unknown images or categories, {repeated} repeated ids, {doubled} repeated categories")
    x, y, w, h = (F.col("bbox")[k] for k in range(4))
    wanted = F.col("source_label").isin(labels) if labels else F.lit(True)
    state = F.when(F.coalesce("iscrowd", F.lit(0)) == 1, "crowd").when((w <= 0) | (h <= 0), "invalid").when(~wanted, "unselected").otherwise("kept")
    box = F.struct("source_label", x.alias("x1"), y.alias("y1"), (x + w).alias("x2"), (y + h).alias("y2"))
    per = marks.join(F.broadcast(names), "category_id").withColumn("state", state).groupBy("image_id").agg(  # categories: a fixed vocabulary
        F.array_sort(F.collect_list(F.when(F.col("state") == "kept", box))).alias("boxes"), *(F.count_if(F.col("state") == s).alias(f"dropped_{s}") for s in ("crowd", "invalid", "unselected"))
    )
    joined = images.join(per, F.col("id") == F.col("image_id"), "left")
    return joined.select(
        F.col("file_name").alias("record_id"), "width", "height", F.coalesce("boxes", F.array().cast(f"array<{BOX}>")).alias("boxes"), *(F.coalesce(f"dropped_{s}", F.lit(0)).alias(f"dropped_{s}") for s in ("crowd", "invalid", "unselected"))
    )


def read_yolo(spark: SparkSession, path: str, images: DataFrame, names: list[str], missing: str = "empty") -> DataFrame:
    """YOLO label files joined to `images` (record_id, width, height); a record's file is <record_id>.txt under `path`.

    A record in a subfolder has that folder in its id, so equal names in two folders do not mix. Folders
    record_id=<id>, as Spark writes them, count too. A line is class, centre x, centre y, width, height, all normalised.
    Lines of another form, with a class that is no whole number of the names', or out of [0, 1] are an
    error; records without a file have no boxes, or are an error with missing='error'.
    """
    place = F.url_decode(F.regexp_extract(F.input_file_name(), re.escape(path.rstrip("/").split("://")[-1].replace("file:", "")) + r"/(.+)\.txt$", 1))
    told = F.regexp_extract(place, "(^|/)record_id=([^/]+)/", 2)
    text = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select("value", F.when(told != "", F.url_decode(told)).otherwise(place).alias("record_id"))
    lines = text.select("record_id", F.explode(F.filter(F.split("value", r"\r?\n"), lambda s: F.trim(s) != "")).alias("line"))
    fields = lines.select("record_id", F.split(F.trim("line"), r"\s+").alias("f")).select("record_id", F.size("f").alias("n"), F.transform("f", lambda s: s.try_cast("double")).alias("v"))
    bad = fields.where((F.col("n") != 5) | F.exists("v", lambda x: x.isNull()) | F.exists(F.slice("v", 2, 4), lambda x: (x < 0) | (x > 1)) | (F.col("v")[0] >= len(names)) | (F.col("v")[0] < 0) | (F.col("v")[0] != F.floor(F.col("v")[0])))
    if k := bad.count():
        raise ValueError(f"YOLO: {k} lines are not class, x, y, width, height in [0, 1]")
    if missing == "error" and (k := images.join(text, "record_id", "left_anti").count()):
        raise ValueError(f"YOLO: {k} records have no label file")
    v = F.col("v")
    sized = fields.join(images, "record_id")
    corners = corner_box(v[1], v[2], v[3], v[4], F.col("width"), F.col("height"))
    box = F.struct(F.element_at(F.array(*map(F.lit, names)), (v[0] + 1).cast("int")).alias("source_label"), *(c.alias(n) for c, n in zip(corners, ("x1", "y1", "x2", "y2"), strict=True)))
    per = sized.groupBy("record_id").agg(F.array_sort(F.collect_list(box)).alias("boxes"))
    return images.join(per, "record_id", "left").select("record_id", "width", "height", F.coalesce("boxes", F.array().cast(f"array<{BOX}>")).alias("boxes"))


VOC = "filename string, size struct<width:int,height:int>, object array<struct<name:string,difficult:int,bndbox:struct<xmin:double,ymin:double,xmax:double,ymax:double>>>"


def read_voc(spark: SparkSession, path: str, keep_difficult: bool = False) -> DataFrame:
    """VOC XML, a file a record. Difficult objects and boxes without area or outside the image are dropped and counted."""
    raw = spark.read.format("xml").option("rowTag", "annotation").schema(VOC).load(path)
    objects = F.coalesce("object", F.array().cast("array<struct<name:string,difficult:int,bndbox:struct<xmin:double,ymin:double,xmax:double,ymax:double>>>"))
    hard = lambda o: F.coalesce(o["difficult"], F.lit(0)) == 1
    b = lambda o, k: o["bndbox"][k]
    sound = lambda o: (b(o, "xmax") > b(o, "xmin")) & (b(o, "ymax") > b(o, "ymin")) & (b(o, "xmin") >= 0) & (b(o, "ymin") >= 0) & (b(o, "xmax") <= F.col("size.width")) & (b(o, "ymax") <= F.col("size.height"))
    eligible = objects if keep_difficult else F.filter(objects, lambda o: ~hard(o))
    kept = F.filter(eligible, lambda o: F.coalesce(sound(o), F.lit(False)))
    boxes = F.transform(kept, lambda o: F.struct(o["name"].alias("source_label"), b(o, "xmin").alias("x1"), b(o, "ymin").alias("y1"), b(o, "xmax").alias("x2"), b(o, "ymax").alias("y2")))
    return raw.select(F.col("filename").alias("record_id"), F.col("size.width").alias("width"), F.col("size.height").alias("height"), boxes.alias("boxes"), (F.size(objects) - F.size(eligible)).alias("dropped_difficult"), (F.size(eligible) - F.size(kept)).alias("dropped_invalid"))
