"""Queries of fusion controls, skeleton masks, episode features, audits, reuse and canonical JSON."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import canonical_json, hash_modulo, joined_sha256, rounded
from plumbline.operators import contracts, controls, episodes, records
from plumbline.plans.catalogue import register
from plumbline.sources.tables import table

SEED = 9103

#: Two nodes' probabilities of every turn, as wide rows (SQL).
WIDE = """w AS (
        SELECT conv_id, turn, role, least(1.0::DOUBLE, length(text) / 1600.0::DOUBLE) AS visible, length(text) % 4 <> 0 AS visible_available, (length(text) % 100) / 100.0::DOUBLE AS thermal, length(text) % 3 <> 0 AS thermal_available,
            length(text) > 600 AS positive, sha256('9103|' || conv_id) < '8' AS train FROM conversations
    )"""
#: The same as a row per node (SQL).
ITEMS = f"""{WIDE}, i AS (
        SELECT conv_id, turn, role, 'visible' AS node, visible AS p, visible_available AS available, positive, train FROM w UNION ALL SELECT conv_id, turn, role, 'thermal', thermal, thermal_available, positive, train FROM w
    )"""


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text")
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", "role", F.least(F.lit(1.0), n / 1600.0).alias("visible"), (n % 4 != 0).alias("visible_available"), ((n % 100) / 100.0).alias("thermal"), (n % 3 != 0).alias("thermal_available"),
        (n > 600).alias("positive"), (joined_sha256(SEED, "conv_id") < "8").alias("train"),
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = [F.struct(F.lit(n).alias("node"), F.col(n).alias("p"), F.col(f"{n}_available").alias("available")) for n in ("visible", "thermal")]
    return wide(spark, sf_dir).select("conv_id", "turn", "role", "positive", "train", F.explode(F.array(*nodes)).alias("n")).select("conv_id", "turn", "role", "n.*", "positive", "train")


@register(f"""
    WITH {ITEMS}, f AS (SELECT role, avg(positive::INTEGER) AS prior FROM i WHERE train GROUP BY role)
    SELECT conv_id, turn, role, node, CASE WHEN available THEN round(prior, 6) END AS p, available FROM i LEFT JOIN f USING (role) WHERE NOT train
""")
def e_mask_only(spark, sf_dir):
    i = items(spark, sf_dir)
    out = controls.mask_only(i.where("train"), i.where("not train"), "role", "positive", "p", "available")
    return out.select("conv_id", "turn", "role", "node", rounded("p").alias("p"), "available")


@register(f"""
    WITH {WIDE}, r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1 AS k, count(*) OVER (PARTITION BY conv_id, role) AS n FROM w),
    o AS (SELECT *, (k + CASE WHEN n > 1 THEN 1 + CAST(('0x' || substr(sha256('temporal|{SEED}|' || n), 1, 16))::UBIGINT % (n - 1)::UBIGINT AS BIGINT) ELSE 0 END) % n AS src FROM r)
    SELECT o.conv_id, o.turn, o.role, round(s.visible, 6) AS visible, s.visible_available, s.thermal, s.thermal_available FROM o JOIN r s ON o.conv_id = s.conv_id AND o.role = s.role AND o.src = s.k
""")
def e_temporal_shuffle(spark, sf_dir):
    w = wide(spark, sf_dir).drop("positive", "train")
    out = controls.temporal_shuffle(w, ["conv_id", "role"], "turn", ["visible", "visible_available", "thermal", "thermal_available"], SEED)
    return out.withColumn("visible", rounded("visible"))


MOVED = """r AS (SELECT *, row_number() OVER (PARTITION BY role, node ORDER BY sha256('9103|' || conv_id || '|' || turn), conv_id, turn) - 1 AS k, count(*) OVER (PARTITION BY role, node) AS n FROM m),
    o AS (SELECT *, (k + CASE WHEN n > 1 THEN 1 + CAST(('0x' || substr(sha256('9103|' || role || '|' || node), 1, 16))::UBIGINT % (n - 1)::UBIGINT AS BIGINT) ELSE 0 END) % n AS src FROM r),
    x AS (SELECT o.conv_id, o.turn, o.role, o.node, s.p FROM o JOIN r s ON o.role = s.role AND o.node = s.node AND o.src = s.k)"""


@register(f"""
    WITH {ITEMS}, m AS (SELECT * FROM i WHERE available), {MOVED}
    SELECT conv_id, turn, role, node, round(p, 6) AS p FROM x UNION ALL SELECT conv_id, turn, role, node, round(p, 6) FROM i WHERE NOT available
""")
def e_score_shuffle(spark, sf_dir):
    i = items(spark, sf_dir).select("conv_id", "turn", "role", "node", "p", "available")
    return controls.score_shuffle(i, ["role", "node"], ["conv_id", "turn"], "p", SEED, F.col("available")).drop("available").withColumn("p", rounded("p"))


@register(f"""
    WITH {ITEMS}, c AS (SELECT node FROM i GROUP BY node ORDER BY count(*) FILTER (available) DESC, node LIMIT 1), m AS (SELECT * FROM i WHERE available AND node NOT IN (FROM c)), {MOVED}
    SELECT conv_id, turn, role, node, round(p, 6) AS p FROM x UNION ALL SELECT conv_id, turn, role, node, round(p, 6) FROM i WHERE NOT available OR node IN (FROM c)
""")
def e_pair_alignment_shuffle(spark, sf_dir):
    i = items(spark, sf_dir).select("conv_id", "turn", "role", "node", "p", "available")
    return controls.pair_alignment_shuffle(i, "role", "node", ["conv_id", "turn"], "p", "available", SEED).drop("available").withColumn("p", rounded("p"))


# Template families that take nodes away, and one that does not.
FAMILIES = ["modality_missingness", "evidence_delay", "steady"]


@register(f"""
    WITH {ITEMS}, f AS (SELECT *, (['modality_missingness', 'evidence_delay', 'steady'])[CAST(('0x' || substr(sha256('{SEED}|' || conv_id), 1, 16))::UBIGINT % 3 + 1 AS BIGINT)] AS family FROM i),
    s AS (SELECT DISTINCT conv_id, turn, role, family, positive FROM f),
    k AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1 AS k, count(*) FILTER (positive) OVER (PARTITION BY conv_id, role ORDER BY turn) AS pos FROM s),
    h AS (SELECT conv_id, role, turn FROM k WHERE (family = 'modality_missingness' AND k % 4 = 1) OR (family = 'evidence_delay' AND positive AND pos <= 2)),
    d AS (SELECT conv_id, role, turn, max_by(node, sha256('{SEED}|' || conv_id || '|' || role || '|' || turn || '|' || node)) AS node FROM i JOIN h USING (conv_id, role, turn) GROUP BY ALL)
    SELECT conv_id, role, turn, node, family FROM f ANTI JOIN d USING (conv_id, role, turn, node)
""")
def e_masked_skeleton(spark, sf_dir):
    pick = F.element_at(F.array(*map(F.lit, FAMILIES)), (hash_modulo(joined_sha256(SEED, "conv_id"), 3) + 1).cast("int"))
    i = items(spark, sf_dir).select("conv_id", "role", "turn", "node", "positive", pick.alias("family"))
    return controls.drop_masked_nodes(i, "conv_id", "role", "turn", "node", "family", F.col("positive"), SEED).drop("positive")


@register(f"""
    WITH {ITEMS}
    SELECT conv_id, turn, role, node, round(p, 6) AS p, available, '{{"available":' || available || ',"probability_margin":' || round(abs(p - 0.5), 6) || '}}' AS quality_vector_json FROM i
""")
def e_episode_features(spark, sf_dir):
    out = episodes.episode_features(items(spark, sf_dir), ["conv_id", "turn", "role", "node"], "p", "available")
    return out.withColumn("p", rounded("p"))


@register(f"""
    WITH {ITEMS}, m AS (SELECT conv_id, any_value(dataset_id) AS dataset_id, any_value(pair_id) AS pair_id FROM (SELECT conv_id, 'chat' AS dataset_id, CASE WHEN bool_or(role = 'system') OVER (PARTITION BY conv_id) THEN ' ' ELSE 'pair ' || (conv_id // 2) END AS pair_id FROM conversations) GROUP BY conv_id)
    SELECT conv_id, turn, role, node, dataset_id, CASE WHEN trim(pair_id) <> '' THEN pair_id END AS pair_id, CASE WHEN trim(pair_id) <> '' THEN 'observed_pair' ELSE 'no_edge' END AS edge_provenance FROM i JOIN m USING (conv_id)
""")
def e_episode_audit(spark, sf_dir):
    pair = F.when(F.max(F.col("role") == "system"), " ").otherwise(F.concat(F.lit("pair "), F.expr("conv_id div 2")))
    meta = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.lit("chat").alias("dataset_id"), pair.alias("pair_id"))
    i = items(spark, sf_dir).select("conv_id", "turn", "role", "node")
    return episodes.episode_audit(i, meta, "conv_id", ["conv_id", "turn", "role", "node"], "pair_id")


@register(f"""
    WITH {ITEMS}, g AS (SELECT conv_id, turn, role, any_value(positive) AS y, string_agg('"' || conv_id || '/' || node || '"', ',' ORDER BY node) AS ids FROM i GROUP BY conv_id, turn, role)
    SELECT conv_id, turn, role, y::INTEGER AS event_truth, CASE WHEN y THEN 'alarm' ELSE 'normal' END AS state_truth, CASE WHEN role = 'system' THEN 'threshold_risk' ELSE 'observable_presence' END AS event_semantics,
        sha256('{{"concept_id":"' || role || '","event_position_role":"' || CASE WHEN y THEN 'positive_observation' ELSE 'background' END || '","record_ids":[' || ids || ']}}') AS raw_annotation_hash FROM g
""")
def e_concept_labels(spark, sf_dir):
    i = items(spark, sf_dir).select("conv_id", "turn", "role", F.concat_ws("/", "conv_id", "node").alias("record_id"), F.when(F.col("positive"), "positive_observation").otherwise("background").alias("position"))
    return episodes.episode_labels(i, ["conv_id", "turn", "role"], "position", "record_id", "role", "system")


@register("""
    WITH c AS (SELECT conv_id, turn, role, list_transform(regexp_extract_all(text || role, '(?s).'), lambda x: unicode(x)) AS u FROM (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations)),
    e AS (SELECT conv_id, turn, role, list_aggregate(list_transform(u, lambda x: CASE
        WHEN x = 34 THEN '\\"' WHEN x = 92 THEN '\\\\' WHEN x = 8 THEN '\\b' WHEN x = 12 THEN '\\f' WHEN x = 10 THEN '\\n' WHEN x = 13 THEN '\\r' WHEN x = 9 THEN '\\t'
        WHEN x BETWEEN 32 AND 126 THEN chr(x) WHEN x < 65536 THEN format('\\u{:04x}', x) ELSE format('\\u{:04x}\\u{:04x}', 55296 + ((x - 65536) >> 10), 56320 + ((x - 65536) & 1023)) END), 'string_agg', '') AS t FROM c)
    SELECT conv_id, turn, sha256('{"conv_id":' || conv_id || ',"said":"' || coalesce(t, '') || '","spoken":' || (role <> 'system') || '}') AS digest FROM e
""")
def c_canonical_json(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    said = F.concat(F.coalesce("text", F.lit("")), "role")
    return c.select("conv_id", "turn", F.sha2(canonical_json({"said": said, "spoken": F.col("role") != "system", "conv_id": F.col("conv_id")}, texts=("said",)), 256).alias("digest"))


@register("""
    WITH o AS (
        SELECT lang AS dataset_id, source AS source_label, CASE WHEN min(n_chars) < 40 THEN '' ELSE 'c' END AS concept, CASE WHEN count(*) % 2 = 0 THEN 'compatible' ELSE 'guessed' END AS status,
            count(*) % 3 = 0 AS confirms, CASE WHEN count(*) % 5 = 0 THEN 'not_applicable' ELSE 'exhaustive_verified_absence' END AS negative, CASE WHEN max(n_chars) > 2000 THEN NULL ELSE 'p' END AS policy FROM documents GROUP BY ALL
    )
    SELECT unnest(['enum:mapping_status', 'enum:event_semantics', 'enum:negative_semantics', 'rule:tasks', 'rule:concept', 'rule:policy', 'rule:evidence', 'rule:verified negatives', 'key']) AS rule,
        unnest([count(*) FILTER (status = 'guessed'), 0, 0, 0, count(*) FILTER (status = 'compatible' AND concept = ''), count(*) FILTER (status = 'compatible' AND policy IS NULL), 0, count(*) FILTER (confirms AND negative = 'not_applicable'), 0]) AS broken FROM o
""")
def v_ontology(spark, sf_dir):
    """An ontology of languages and sources in which some entries break the contract."""
    n = F.count("*")
    entries = table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("dataset_id"), F.col("source").alias("source_label")).agg(
        F.when(F.min("n_chars") < 40, "").otherwise("c").alias("canonical_concept_id"), F.when(n % 2 == 0, "compatible").otherwise("guessed").alias("mapping_status"), F.lit("observable_presence").alias("event_semantics"),
        F.when(n % 5 == 0, "not_applicable").otherwise("exhaustive_verified_absence").alias("negative_semantics"), F.when(n % 3 == 0, F.array(F.lit("confirmatory_f1"))).otherwise(F.array().cast("array<string>")).alias("allowed_tasks"),
        F.when(F.max("n_chars") > 2000, F.lit(None)).otherwise("p").alias("annotation_policy"), F.lit("e").alias("evidence_reference"),
    )
    return contracts.ontology_contract().violations(entries)


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes from the first four components of embeddings on images of labelled documents; every label 7 lost a number."""
    at = lambda i: F.get("embedding", F.lit(i)).cast("double")
    box = F.array(at(0) * 100 + 10, at(1) * 100 + 10, at(2) * 100 + 20, F.when(F.col("label") == 7, F.lit(None)).otherwise(at(3) * 100 + 20))
    marks = table(spark, sf_dir, "embeddings").select("vec_id", F.col("vec_id").alias("image_id"), box.alias("box"), (F.col("label") == 3).alias("iscrowd"))
    size = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("image_id"), F.lit(40.0).alias("width"), (F.col("n_chars") % 40 + 20.0).alias("height"))
    license = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("image_id")).agg(F.min("quality").alias("license"))
    return records.box_faults(marks, size.join(license, "image_id"), "image_id", "box", "width", "height")


BOXES = """q AS (SELECT doc_id AS image_id, 40.0 AS width, n_chars % 40 + 20.0 AS height, license FROM documents JOIN (SELECT doc_id, min(quality) AS license FROM labels GROUP BY doc_id) USING (doc_id)),
    a AS (SELECT vec_id, vec_id AS image_id, label = 3 AS iscrowd, label = 7 AS bad, embedding[1]::DOUBLE * 100 + 10 AS x, embedding[2]::DOUBLE * 100 + 10 AS y, embedding[3]::DOUBLE * 100 + 20 AS w, embedding[4]::DOUBLE * 100 + 20 AS h FROM embeddings),
    f AS (SELECT a.*, width IS NULL AS r1, bad AS r2, NOT bad AND (w <= 0 OR h <= 0) AS r3, NOT bad AND (x < 0 OR y < 0) AS r4, coalesce(NOT bad AND (x + w > width + 1e-9 OR y + h > height + 1e-9), false) AS r5, coalesce(license, -1) AS license FROM a LEFT JOIN q USING (image_id))"""


@register(f"""
    WITH {BOXES} SELECT unnest(['selected_annotations', 'missing_image', 'nonfinite_or_invalid_shape', 'nonpositive', 'negative_origin', 'exceeds_image_bounds']) AS reason,
        unnest([count(*), count(*) FILTER (r1), count(*) FILTER (r2), count(*) FILTER (r3), count(*) FILTER (r4), count(*) FILTER (r5)]) AS annotations FROM f
""")
def d_box_faults(spark, sf_dir):
    return records.fault_counts(boxes(spark, sf_dir))


@register(f"""
    WITH {BOXES}, g AS (SELECT image_id, license, bool_or(NOT (r1 OR r2 OR r3 OR r4 OR r5 OR iscrowd)) AS sound FROM f GROUP BY ALL)
    SELECT license, count(*) AS images, count(*) FILTER (sound) AS usable_images, license IN (2, 3, 4) AS eligible FROM g GROUP BY license
""")
def d_license_boundary(spark, sf_dir):
    return records.license_boundary(boxes(spark, sf_dir), "image_id", "license", "iscrowd", [2, 3, 4])


@register("""
    WITH m AS (SELECT l_linestatus AS module, 1 + l_linenumber % 2 AS workers, count(*) AS repeats, avg(l_quantity) AS r, avg(l_tax) AS t, max(l_partkey) AS peak_memory, count(DISTINCT l_returnflag) = 1 AS deterministic FROM lineitem GROUP BY ALL),
    b AS (SELECT module, min_by(r, workers) AS r0, min(workers) AS w0 FROM m GROUP BY module)
    SELECT module, workers, repeats, round(r, 6) AS mean_rate, round(t, 6) AS mean_wall, peak_memory, deterministic, round(r / r0, 6) AS speedup, round(r / r0 / (workers / w0), 6) AS efficiency FROM m JOIN b USING (module)
""")
def r_scaling_summary(spark, sf_dir):
    trials = table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("module"), (1 + F.col("l_linenumber") % 2).alias("workers"), "l_quantity", "l_tax", "l_partkey", "l_returnflag")
    out = records.scaling_summary(trials, "module", "workers", "l_quantity", "l_tax", "l_partkey", "l_returnflag")
    return out.withColumns({c: rounded(c) for c in ("mean_rate", "mean_wall", "speedup", "efficiency")})


@register("""
    WITH a AS (SELECT conv_id, sha256(string_agg(turn || ':' || sha256(text) || ':' || length(text), chr(10) ORDER BY CAST(turn AS VARCHAR), sha256(text))) AS set_hash, count(*) AS parts, bool_or(role = 'system') AS s, max(length(text)) > 900 AS l FROM conversations GROUP BY conv_id)
    SELECT conv_id, parts, set_hash, CASE WHEN s THEN 'build' WHEN l THEN 'drift' ELSE 'reuse' END AS decision FROM a
""")
def r_reuse_decision(spark, sf_dir):
    """Archives of turns against receipts: conversations with a system turn have none, those with a long text changed since."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.sha2("text", 256).alias("d"), F.length("text").cast("long").alias("n"))
    archives = records.part_set_hash(c, "conv_id", "turn", "d", "n").drop("bytes")
    facts = c.groupBy("conv_id").agg(F.max(F.col("role") == "system").alias("system"), (F.max("n") > 900).alias("long"))
    receipts = archives.join(facts, "conv_id").where("not system").select("conv_id", "parts", F.when(F.col("long"), F.sha2("set_hash", 256)).otherwise(F.col("set_hash")).alias("set_hash"))
    return records.reuse_decision(archives, receipts, "conv_id", "set_hash", "parts")
