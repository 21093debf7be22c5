"""Queries of record summaries, eligibility, roles, budgets, opaque ids and grids."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import rounded
from plumbline.operators import records
from plumbline.plans.catalogue import register
from plumbline.sources.tables import table, with_utc

SECRET = b"fixture secret"
INNER = "".join(f"\\x{b ^ 0x36:02X}" for b in SECRET.ljust(64, b"\0"))
OUTER = "".join(f"\\x{b ^ 0x5C:02X}" for b in SECRET.ljust(64, b"\0"))


@register("""
    WITH c AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL)
    SELECT lang, CAST(sum(n) AS BIGINT) AS records, count(*) AS groups, string_agg(source || '=' || n, ',' ORDER BY source) AS concepts FROM c GROUP BY lang
""")
def r_dataset_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = records.dataset_summary(table(spark, sf_dir, "documents"), "lang", "source", "source")
    text = F.array_join(F.transform(F.map_entries("concepts"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return out.select("lang", "records", "groups", text.alias("concepts"))


@register("SELECT source FROM documents WHERE lang IN ('en', 'fr', 'de') GROUP BY source HAVING count(DISTINCT lang) = 3")
def r_present_everywhere(spark, sf_dir):
    return records.present_everywhere(table(spark, sf_dir, "documents"), "source", "lang", ["en", "fr", "de"])


@register("""
    SELECT user_id, count(DISTINCT event_id) AS members, count(DISTINCT event_type) FILTER (event_type IN ('purchase', 'signup')) AS kinds,
        count(DISTINCT event_id) >= 60 AND count(DISTINCT event_type) FILTER (event_type IN ('purchase', 'signup')) >= 2 AS eligible FROM events GROUP BY user_id
""")
def r_eligible_groups(spark, sf_dir):
    return records.eligible_groups(table(spark, sf_dir, "events"), "user_id", "event_id", "event_type", 60, ["purchase", "signup"])


@register("""
    WITH e AS (SELECT user_id, epoch_us(ts) AS t, CASE WHEN value >= 50 THEN 'high' ELSE 'low' END AS role FROM events),
    n AS (SELECT *, CASE WHEN coalesce(lag(role) OVER w <> role, true) THEN 1 ELSE 0 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t)),
    r AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY t) AS BIGINT) AS run FROM n),
    b AS (SELECT user_id, run, any_value(role) AS role, min(t) AS "first", max(t) AS "last" FROM r GROUP BY user_id, run)
    SELECT *, "first" - lag("last") OVER (PARTITION BY user_id ORDER BY run) AS gap FROM b
""")
def r_role_bounds(spark, sf_dir):
    e = with_utc(table(spark, sf_dir, "events"), "ts").select("user_id", F.unix_micros("ts").alias("t"), F.when(F.col("value") >= 50, "high").otherwise("low").alias("role"))
    return records.role_bounds(e, ["user_id"], "t", "role")


@register("""
    SELECT 'documents' AS package, lang AS "group", 'n_chars' AS metric, CAST(sum(n_chars) AS DOUBLE) AS value, NULL AS note FROM documents GROUP BY lang
    UNION ALL SELECT 'conversations', role, 'turns', CAST(count(*) AS DOUBLE), 'by role' FROM conversations GROUP BY role
""")
def r_result_table(spark, sf_dir):
    d = table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("group")).agg(F.sum("n_chars").cast("double").alias("value")).withColumn("metric", F.lit("n_chars")).withColumn("package", F.lit("documents"))
    c = table(spark, sf_dir, "conversations").groupBy(F.col("role").alias("group")).agg(F.count("*").cast("double").alias("value")).withColumns({"metric": F.lit("turns"), "package": F.lit("conversations"), "note": F.lit("by role")})
    return records.result_table([d, c], ["package", "group", "metric"]).select("package", "group", "metric", "value", "note")


@register("""
    WITH u AS (SELECT o_custkey, sum(o_totalprice) AS used FROM orders GROUP BY o_custkey)
    SELECT c_custkey, c_acctbal, round(coalesce(used, 0), 2) AS used, round(c_acctbal - coalesce(used, 0), 2) AS "left", coalesce(used, 0) <= c_acctbal AS within FROM customer LEFT JOIN u ON c_custkey = o_custkey
""")
def r_budget_roll_up(spark, sf_dir):
    used = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_totalprice")
    out = records.budget_roll_up(used, table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), "c_custkey", "o_totalprice", "c_acctbal")
    return out.select("c_custkey", "c_acctbal", F.round("used", 2).alias("used"), F.round("left", 2).alias("left"), "within")


@register("""
    SELECT conv_id, count(*) AS parts, CAST(sum(length(text)) AS BIGINT) AS bytes, sha256(string_agg(turn || ':' || sha256(text) || ':' || length(text), chr(10) ORDER BY CAST(turn AS VARCHAR), sha256(text))) AS set_hash FROM conversations GROUP BY conv_id
""")
def r_part_set_hash(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2("text", 256).alias("d"), F.length("text").cast("long").alias("n"))
    return records.part_set_hash(c, "conv_id", "turn", "d", "n")


@register(f"SELECT vec_id, sha256('{OUTER}'::BLOB || unhex(sha256('{INNER}'::BLOB || encode(vec_id || '|' || label)))) AS opaque FROM embeddings")
def r_opaque_ids(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", records.opaque_id(SECRET, F.col("vec_id").cast("string"), F.col("label").cast("string")).alias("opaque"))


@register("""
    SELECT item_id, k AS corruption_type, CAST(s AS INTEGER) AS severity, CAST(p AS DOUBLE) AS parameter FROM benchmark,
        (VALUES ('fog', 1, 0.8), ('fog', 2, 0.65), ('fog', 3, 0.5), ('gamma', 1, 1.3), ('gamma', 2, 1.7), ('gamma', 3, 2.1)) AS g(k, s, p)
""")
def r_corruption_grid(spark, sf_dir):
    return records.corruption_grid(table(spark, sf_dir, "benchmark"), "item_id", {"gamma": [1.3, 1.7, 2.1], "fog": [0.8, 0.65, 0.5]})


@register("""
    WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), p AS (SELECT a.vec_id, a.e AS a, b.e AS b, list_avg(a.e) AS ma, list_avg(b.e) AS mb FROM v a JOIN v b ON b.vec_id = a.vec_id + 1)
    SELECT vec_id, round(list_sum(list_transform(range(1, 65), lambda i: (a[i] - ma) * (b[i] - mb))) / sqrt(list_sum(list_transform(a, lambda x: (x - ma) * (x - ma))) * list_sum(list_transform(b, lambda x: (x - mb) * (x - mb)))), 6) AS correlation FROM p
""")
def c_vector_correlation(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    after = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"))
    return v.join(after, "vec_id").select("vec_id", rounded(records.vector_correlation(F.col("a"), F.col("b"))).alias("correlation"))


@register("""
    WITH g AS (SELECT conv_id, min(length(text) > 400) <> max(length(text) > 400) AS conflict, ('0x' || substr(sha256('9103|' || conv_id), 1, 16))::UBIGINT AS h FROM conversations GROUP BY conv_id)
    SELECT conv_id, conflict, CASE WHEN conflict THEN (['conflict_early', 'conflict_late'])[CAST(h % 2 + 1 AS BIGINT)] ELSE (['steady', 'onset', 'recovery', 'gap'])[CAST(h % 4 + 1 AS BIGINT)] END AS template_family FROM g
""")
def e_template_families(spark, sf_dir):
    from plumbline.functions import joined_sha256

    long = F.length("text") > 400
    groups = table(spark, sf_dir, "conversations").groupBy("conv_id").agg((F.min(long) != F.max(long)).alias("conflict"))
    return records.template_family(groups, F.col("conflict"), ["steady", "onset", "recovery", "gap"], ["conflict_early", "conflict_late"], joined_sha256(9103, "conv_id"))
