"""Detections against annotated boxes: pairing, greedy matching, average precision, concept scores."""
from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import iou

BOX = ("x1", "y1", "x2", "y2")


def box_pairs(truth: DataFrame, predicted: DataFrame, key: Sequence[str], least: float = 0.0) -> DataFrame:
    """Pairs of boxes of one record and concept with their overlap, where it is at least `least` and positive."""
    t = truth.select(*key, "box_id", *(F.col(c).alias(f"t_{c}") for c in BOX))
    p = predicted.select(*key, "detection_id", "score", *(F.col(c).alias(f"p_{c}") for c in BOX))
    overlap = iou([F.col(f"p_{c}") for c in BOX], [F.col(f"t_{c}") for c in BOX])
    return p.join(t, list(key)).withColumn("iou", overlap).where((F.col("iou") > 0) & (F.col("iou") >= least)).select(*key, "detection_id", "score", "box_id", "iou")


def match_boxes(pairs: DataFrame, key: Sequence[str], threshold: str) -> DataFrame:
    """Greedy matching per key and threshold: (key, threshold, detection_id, box_id).

    Detections by descending score, then id, each take their unused box of greatest overlap (then
    smaller id) that reaches the threshold. Pairs stream through a sorted partition; only the ids taken
    in the open unit are kept.
    """
    unit = [*key, threshold]
    rows = pairs.where(F.col("iou") >= F.col(threshold)).select(*unit, "score", "detection_id", "iou", "box_id")
    n = len(unit)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, used, taken = None, set(), set()
        for batch in batches:
            keep, columns = [], [c.to_pylist() for c in batch.columns]
            for i, key_ in enumerate(zip(*columns[:n], strict=True)):
                if key_ != now:
                    now, used, taken = key_, set(), set()
                detection, box = columns[n + 1][i], columns[n + 3][i]
                if detection not in used and box not in taken:
                    used.add(detection)
                    taken.add(box)
                    keep.append(i)
            found = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(found.column(k) for k in range(n)), found.column(n + 1), found.column(n + 3)], names=[*unit, "detection_id", "box_id"])

    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*unit, "detection_id", "box_id"])
    ordered = rows.repartition(*unit).sortWithinPartitions(*unit, F.desc("score"), "detection_id", F.desc("iou"), "box_id")
    return ordered.mapInArrow(walk, schema)


def _running(unit: Sequence[str], order: Sequence) -> tuple:
    """Windows over a unit that is cut into buckets of score: up to a row in its bucket, from it on, and over the buckets before and after."""
    own, all_ = Window.partitionBy(*unit, "_b").orderBy(*order), Window.partitionBy(*unit).orderBy(F.desc("_b"))
    return own.rowsBetween(Window.unboundedPreceding, 0), own.rowsBetween(0, Window.unboundedFollowing), all_.rowsBetween(Window.unboundedPreceding, -1), all_.rowsBetween(1, Window.unboundedFollowing)


def detection_precision(truth: DataFrame, predicted: DataFrame, record: str, concept: str, thresholds: Sequence[float]) -> DataFrame:
    """Per concept and overlap threshold: truths, matches (tp), detections without (fp), truths without (missed), envelope average precision.

    Detections are ranked once; only pairs that overlap are repeated for the thresholds. Precision is
    best where a detection matches, so the envelope follows from the matches and their ranks alone. A
    concept with truths and no detection has an ap of 0, one without truths null. No concept is sorted
    in one task: ranks are those inside a bucket of scores plus the totals of the buckets before.
    """
    key, unit = [record, concept], [concept, "threshold"]
    marks = F.explode(F.array(*map(F.lit, thresholds))).alias("threshold")
    scored = predicted.select(*key, "detection_id", "score", F.floor(F.col("score") * 1024).alias("_b"))
    upto, _, before, _ = _running([concept], [F.desc("score"), record, "detection_id"])
    totals = scored.groupBy(concept, "_b").agg(F.count("*").alias("_n")).select(concept, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranked = scored.withColumn("_own", F.count("*").over(upto)).join(totals, [concept, "_b"]).select(*key, "detection_id", "_b", (F.col("_own") + F.col("_before")).alias("n"))
    pairs = box_pairs(truth, predicted, key, min(thresholds))
    hits = match_boxes(pairs.select("*", marks), key, "threshold").join(ranked, [*key, "detection_id"]).select(*unit, "_b", "n")
    upto, on, before, after = _running(unit, ["n"])
    totals = hits.groupBy(*unit, "_b").agg(F.count("*").alias("_n")).select(*unit, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    curve = hits.withColumn("_own", F.count("*").over(upto)).join(totals, [*unit, "_b"]).withColumn("precision", (F.col("_own") + F.col("_before")) / F.col("n"))
    later = curve.groupBy(*unit, "_b").agg(F.max("precision").alias("_m")).select(*unit, "_b", F.max("_m").over(after).alias("_later"))
    envelope = curve.withColumn("_m", F.max("precision").over(on)).join(later, [*unit, "_b"])
    area = envelope.groupBy(*unit).agg(F.sum(F.greatest("_m", "_later")).alias("_area"), F.count("*").alias("tp"))
    count = lambda df, name: df.groupBy(concept).agg(F.count("*").alias(name))
    grid = predicted.select(concept).unionByName(truth.select(concept)).distinct().select(concept, marks)
    out = grid.join(count(truth, "truths"), concept, "left").join(count(predicted, "_told"), concept, "left").join(area, unit, "left").fillna(0, ["truths", "_told", "tp"])
    ap = F.when(F.col("truths") > 0, F.coalesce("_area", F.lit(0.0)) / F.col("truths"))
    return out.select(*unit, "truths", "tp", (F.col("_told") - F.col("tp")).alias("fp"), (F.col("truths") - F.col("tp")).alias("missed"), ap.alias("ap"))


def detection_summary(precision: DataFrame, concept: str, at: float = 0.5) -> DataFrame:
    """Per concept, from `detection_precision`: counts and ap at one overlap, and the mean ap over all overlaps; and a row of means (concept null)."""
    here = F.abs(F.col("threshold") - at) < 1e-9
    per = precision.groupBy(concept).agg(*(F.max(F.when(here, F.col(c))).alias(c) for c in ("truths", "tp", "fp", "missed")), F.max(F.when(here, F.col("ap"))).alias("ap50"), F.avg("ap").alias("ap50_95"))
    total = per.agg(*(F.sum(c).alias(c) for c in ("truths", "tp", "fp", "missed")), F.avg("ap50").alias("ap50"), F.avg("ap50_95").alias("ap50_95"))
    return per.unionByName(total.withColumn(concept, F.lit(None).cast(per.schema[concept].dataType)))


def concept_scores(predicted: DataFrame, records: DataFrame, record: str, concept: str, concepts: Sequence[str]) -> DataFrame:
    """The greatest score of every record and concept, 0 without a detection. The concepts are a fixed list."""
    top = predicted.groupBy(record, concept).agg(F.max("score").alias("score"))
    full = records.select(record).distinct().select(record, F.explode(F.array(*map(F.lit, concepts))).alias(concept))
    return full.join(top, [record, concept], "left").fillna(0.0, ["score"])


def concept_presence(truth: DataFrame, records: DataFrame, record: str, concept: str, concepts: Sequence[str]) -> DataFrame:
    """Whether every record holds each concept, as 0 or 1: the full product, zero-filled."""
    seen = truth.select(record, concept).distinct().withColumn("concept_truth", F.lit(1))
    full = records.select(record).distinct().select(record, F.explode(F.array(*map(F.lit, concepts))).alias(concept))
    return full.join(seen, [record, concept], "left").fillna(0, ["concept_truth"])
