"""Fusion controls, skeleton masks, canonical JSON, box audits, reuse: literal cases and edge cases."""
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from plumbline.functions import canonical_json
from plumbline.operators import contracts, controls, episodes, records


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_canonical_json_is_that_of_the_standard_library(spark):
    texts = ["plain", 'quote " and \\ and /', "\n\r\t\b\f\x00\x1f\x7f", "Grüße 漢字", "\U0001f600 ퟿￿", ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n long, t string")
    made = canonical_json({"z": F.col("t"), "a": F.col("n"), "list": F.array("t", F.lit("é")), "ok": F.col("n") > 1}, texts=("z",), lists=("list",))
    for n, t, got in df.select("n", "t", made).collect():
        assert got == json.dumps({"z": t, "a": n, "list": [t, "é"], "ok": n > 1}, sort_keys=True, separators=(",", ":"))


def test_canonical_json_of_null(spark):
    df = spark.createDataFrame([(None, None)], "t string, n long")
    assert df.select(canonical_json({"t": F.col("t"), "n": F.col("n")}, texts=("t",))).first()[0] == '{"n":null,"t":null}'


def test_temporal_shuffle_moves_every_step_by_the_seeded_offset(spark):
    df = spark.createDataFrame([("e", s, 10.0 * s) for s in (3, 5, 8, 9)] + [("one", 1, 7.0)], "e string, s long, p double")
    n = 4
    offset = int(hashlib.sha256(f"temporal|11|{n}".encode()).hexdigest()[:16], 16) % (n - 1) + 1
    steps = [3, 5, 8, 9]
    want = [("e", s, 10.0 * steps[(i + offset) % n]) for i, s in enumerate(steps)] + [("one", 1, 7.0)]
    assert rows(controls.temporal_shuffle(df, ["e"], "s", ["p"], 11)) == sorted(want)


def test_score_shuffle_keeps_marginals_and_moves_all(spark):
    data = [(i, "ab"[i % 2], float(i), i % 5 != 0) for i in range(40)]
    df = spark.createDataFrame(data, "id long, c string, p double, there boolean")
    out = {r.id: r for r in controls.score_shuffle(df, ["c"], ["id"], "p", 5, F.col("there")).collect()}
    assert len(out) == 40
    for i, c, p, there in data:
        assert (out[i].p != p) == there and out[i].c == c
    for c in "ab":
        assert sorted(r.p for r in out.values() if r.c == c) == sorted(p for _, k, p, _ in data if k == c)


def test_pair_alignment_keeps_the_most_available_node(spark):
    data = [(i, node, "c", float(i), node == "a" or i % 2 == 0) for i in range(10) for node in "ab"]
    df = spark.createDataFrame(data, "id long, node string, concept string, p double, there boolean")
    out = {(r.id, r.node): r.p for r in controls.pair_alignment_shuffle(df, "concept", "node", ["id"], "p", "there", 3).collect()}
    assert all(out[i, "a"] == float(i) for i in range(10))
    assert all((out[i, "b"] != float(i)) == (i % 2 == 0) for i in range(10))


def test_controls_of_empty_tables(spark):
    df = spark.createDataFrame([], "id long, node string, concept string, p double, there boolean")
    assert rows(controls.pair_alignment_shuffle(df, "concept", "node", ["id"], "p", "there", 3)) == []
    assert rows(controls.temporal_shuffle(df, ["node"], "id", ["p"], 3)) == []
    assert rows(controls.mask_only(df.withColumn("y", F.lit(1)), df, "concept", "y", "p", "there")) == []


def test_mask_only(spark):
    train = spark.createDataFrame([("x", 1), ("x", 0), ("x", 1), ("x", 1)], "c string, y int")
    test = spark.createDataFrame([("x", 0.1, True), ("x", 0.2, False), ("new", 0.3, True), ("x", 0.4, None)], "c string, p double, a boolean")
    assert sorted(controls.mask_only(train, test, "c", "y", "p", "a").collect(), key=str) == sorted([("x", 0.75, True), ("x", None, False), ("new", None, True), ("x", None, None)], key=lambda r: str(spark.createDataFrame([r], test.schema).first()))


def test_drop_masked_nodes(spark):
    def lost(family, positives=(), nodes="ab", steps=6):
        data = [("e", "c", s, n, family, s in positives) for s in range(steps) for n in nodes]
        df = spark.createDataFrame(data, "e string, c string, s long, n string, f string, y boolean")
        kept = {(r.s, r.n) for r in controls.drop_masked_nodes(df, "e", "c", "s", "n", "f", F.col("y"), 7).collect()}
        return {(s, n) for s in range(steps) for n in nodes} - kept

    last = lambda s, nodes: max(nodes, key=lambda n: hashlib.sha256(f"7|e|c|{s}|{n}".encode()).hexdigest())
    assert lost("modality_missingness") == {(1, last(1, "ab")), (5, last(5, "ab"))}
    assert lost("evidence_delay", (2, 3, 4)) == {(2, last(2, "ab")), (3, last(3, "ab"))}
    assert lost("steady", (2, 3)) == set()
    assert lost("modality_missingness", nodes="a") == set()


def test_labels_refuse_roles_that_differ(spark):
    df = spark.createDataFrame([(1, "c", "r1", "positive_observation"), (1, "c", "r2", "background")], "s long, c string, r string, role string")
    with pytest.raises(Exception, match="several roles"):
        episodes.episode_labels(df, ["s", "c"], "role", "r", "c", "risk").collect()


def test_labels_hash_what_they_rest_on(spark):
    df = spark.createDataFrame([(1, "c", "r2", "positive_observation"), (1, "c", "r1", "positive_observation")], "s long, c string, r string, role string")
    got = episodes.episode_labels(df, ["s", "c"], "role", "r", "c", "risk").first()
    source = json.dumps({"record_ids": ["r1", "r2"], "concept_id": "c", "event_position_role": "positive_observation"}, sort_keys=True, separators=(",", ":"))
    assert (got.event_truth, got.state_truth, got.event_semantics, got.raw_annotation_hash) == (1, "alarm", "observable_presence", hashlib.sha256(source.encode()).hexdigest())


def test_audit_refuses_items_without_record(spark):
    items = spark.createDataFrame([(1, "r1"), (2, "gone")], "s long, r string")
    meta = spark.createDataFrame([("r1", " ")], "r string, pair string")
    with pytest.raises(contracts.ContractError):
        episodes.episode_audit(items, meta, "r", ["s"], "pair")
    got = episodes.episode_audit(items.where("s = 1"), meta, "r", ["s"], "pair").first()
    assert (got.pair, got.edge_provenance) == (None, "no_edge")


def test_box_faults(spark):
    boxes = [(1, 1, [0.0, 0.0, 5.0, 5.0]), (2, 1, [-1.0, 0.0, 0.0, 5.0]), (3, 1, [8.0, 0.0, 5.0, 5.0]), (4, 9, [0.0, 0.0, 5.0, 5.0]), (5, 1, [1.0]), (6, 1, None), (7, 1, [0.0, 0.0, float("nan"), 1.0]), (8, 1, [0.0, None, 1.0, 1.0])]
    df = spark.createDataFrame(boxes, "id long, image long, box array<double>")
    images = spark.createDataFrame([(1, 10.0, 10.0, 4)], "image long, w double, h double, license int")
    out = records.box_faults(df, images, "image", "box", "w", "h")
    bad = ["nonfinite_or_invalid_shape"]
    assert {r.id: r.reasons for r in out.collect()} == {1: [], 2: ["nonpositive", "negative_origin"], 3: ["exceeds_image_bounds"], 4: ["missing_image"], 5: bad, 6: bad, 7: bad, 8: bad}
    assert dict(rows(records.fault_counts(out)))["nonfinite_or_invalid_shape"] == 4
    assert rows(records.license_boundary(out.withColumn("crowd", F.lit(None).cast("boolean")), "image", "license", "crowd", [4])) == [(-1, 1, 0, False), (4, 1, 1, True)]


def test_scaling_summary(spark):
    df = spark.createDataFrame([("m", 1, 10.0, 4.0, 7, "h"), ("m", 1, 20.0, 6.0, 9, "h"), ("m", 2, 24.0, 3.0, 5, "h"), ("m", 2, 24.0, 3.0, 6, "other")], "m string, w int, r double, t double, b long, d string")
    got = {r.w: r for r in records.scaling_summary(df, "m", "w", "r", "t", "b", "d").collect()}
    assert (got[1].mean_rate, got[1].mean_wall, got[1].peak_memory, got[1].deterministic, got[1].speedup) == (15.0, 5.0, 9, True, 1.0)
    assert (got[2].deterministic, got[2].speedup, got[2].efficiency) == (False, 1.6, 0.8)


def test_reuse_decision(spark):
    archives = spark.createDataFrame([("a", "h1", 3), ("b", "h2", 4), ("c", "h3", 5), ("d", "h4", 6)], "d string, h string, n long")
    receipts = spark.createDataFrame([("a", "h1", 3), ("b", "old", 4), ("c", "h3", 1)], "d string, h string, n long")
    assert [(r.d, r.decision) for r in records.reuse_decision(archives, receipts, "d", "h", "n").orderBy("d").collect()] == [("a", "reuse"), ("b", "drift"), ("c", "drift"), ("d", "build")]


def test_names_of_truth():
    assert contracts.names_of_truth(["id", "Event_Truth", "label_kind", "relabelled", "metric", "y"], names=("y",)) == ["Event_Truth", "label_kind", "y"]


def test_ontology_contract(spark):
    good = ("d", "l", "c", "compatible", "observable_presence", "exhaustive_verified_absence", ["confirmatory_f1"], "p", "e")
    change = lambda i, v, label: tuple(v if k == i else label if k == 1 else x for k, x in enumerate(good))
    data = [good, change(2, None, "l2"), change(3, "ignored", "l3"), change(5, "not_applicable", "l4"), change(6, None, "l5"), change(8, " ", "l6"), (*good[:3], "guess", *good[4:])]
    df = spark.createDataFrame(data, "dataset_id string, source_label string, canonical_concept_id string, mapping_status string, event_semantics string, negative_semantics string, allowed_tasks array<string>, annotation_policy string, evidence_reference string")
    broken = {r.rule: r.broken for r in contracts.ontology_contract().violations(df).where("broken > 0").collect()}
    assert broken == {"enum:mapping_status": 1, "rule:concept": 1, "rule:verified negatives": 1, "rule:tasks": 1, "rule:evidence": 1, "key": 1}


def test_episode_features_small_margins(spark):
    margins = {1: 0.000625, 2: 0.0001, 3: 0.00005, 4: 0.000015, 5: 0.000001, 6: 0.5, 7: 0.25, 8: 0.0, 9: 0.001, 10: 0.0005}
    rows = [(k, 0.5 + m, True) for k, m in margins.items()] + [(11, None, True), (12, 0.25, None)]
    out = episodes.episode_features(spark.createDataFrame(rows, "k int, p double, a boolean"), ["k"], "p", "a")
    got = {r.k: r.quality_vector_json for r in out.collect()}
    assert got == {k: f'{{"available":true,"probability_margin":{m!r}}}' for k, m in margins.items()} | {11: None, 12: None}
