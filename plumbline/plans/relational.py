"""Queries of constraint checks, joins, aggregations, windows, selections and set operations."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline import functions as fn
from plumbline.operators import contracts, selection
from plumbline.operators.quantiles import exact_quantiles, null_safe_join
from plumbline.operators.scans import in_ranges, running
from plumbline.plans.catalogue import register
from plumbline.sources.tables import finite, table, with_utc

LINE_KEY = ("l_orderkey", "l_linenumber")


@register("""
    SELECT * FROM (VALUES ('blank:source', (SELECT count(*) FROM documents WHERE NOT coalesce(trim(source) <> '', false))),
        ('enum:lang', (SELECT count(*) FROM documents WHERE NOT coalesce(lang IN ('en', 'fr', 'de'), false))),
        ('regex:source', (SELECT count(*) FROM documents WHERE NOT coalesce(regexp_matches(source, '^src[0-9]$'), false))),
        ('range:n_chars', (SELECT count(*) FROM documents WHERE n_chars IS NOT NULL AND NOT (n_chars >= 100 AND n_chars <= 20000))),
        ('rule:n_chars', (SELECT count(*) FROM documents WHERE NOT coalesce(n_chars = length(text), false))),
        ('key', (SELECT coalesce(sum(n - 1), 0)::BIGINT FROM (SELECT count(*) AS n FROM documents GROUP BY lang, source)))) AS t(rule, broken)
""")
def v_contract_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    contract = contracts.TableContract(
        required=("doc_id", "text"), key=("lang", "source"), not_blank=("source",), one_of={"lang": ("en", "fr", "de")}, matches={"source": "^src[0-9]$"},
        between={"n_chars": (100, 20000)}, rules={"n_chars": F.col("n_chars") == F.length("text")},
    )
    return contract.violations(table(spark, sf_dir, "documents"))


@register("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def v_surplus_keys(spark, sf_dir):
    return contracts.surplus_keys(table(spark, sf_dir, "orders"), ["o_custkey"])


@register("""
    SELECT event_type, user_id, count(DISTINCT d) + max(CASE WHEN d IS NULL THEN 1 ELSE 0 END) AS values
    FROM (SELECT event_type, user_id, date_trunc('day', ts) AS d FROM events) GROUP BY event_type, user_id HAVING values > 1
""")
def v_functional_dependency(spark, sf_dir):
    events = with_utc(table(spark, sf_dir, "events"), "ts").withColumn("d", F.date_trunc("day", "ts"))
    return contracts.determines(events, ["event_type", "user_id"], "d")


@register("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events WHERE TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) >= 50")
def v_json_objects(spark, sf_dir):
    parsed = table(spark, sf_dir, "events").withColumn("p", F.from_json("props", "map<string,string>")).where(F.col("p").isNotNull())
    return parsed.select("event_id", F.col("p")["k"].alias("k")).where(F.expr("try_cast(k as bigint) >= 50"))


@register("""
    WITH p AS (SELECT sha256(text) AS h, CAST(doc_id % 4 AS INTEGER) AS pool, doc_id FROM documents)
    SELECT h, count(DISTINCT pool) AS pools, count(*) AS n, min(doc_id) AS first_doc FROM p GROUP BY h HAVING count(DISTINCT pool) > 1
""")
def v_duplicates_across_pools(spark, sf_dir):
    p = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("h"), (F.col("doc_id") % 4).cast("int").alias("pool"), "doc_id")
    return p.groupBy("h").agg(F.countDistinct("pool").alias("pools"), F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where("pools > 1")


@register("""
    WITH a AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus <> 'F'), b AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 1000)
    SELECT 'left' AS side, count(*) AS rows FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)
    UNION ALL SELECT 'right', count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)
""")
def v_partition_equality(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    pick = lambda c: orders.where(c).select("o_orderkey", "o_custkey")
    return contracts.differences(pick("o_orderstatus <> 'F'"), pick("o_totalprice > 1000"))


@register("""
    WITH w AS (
        SELECT user_id, event_id, (epoch_us(ts) // 1000000) AS e, CAST(hash_pool AS INTEGER) AS pool FROM (
            SELECT *, CAST(conv AS INTEGER) % 3 AS hash_pool FROM (SELECT *, event_id % 7 AS conv FROM events))
    ),
    a AS (SELECT *, max(CASE WHEN pool = 0 THEN e + 300 END) OVER o AS m0, max(CASE WHEN pool = 1 THEN e + 300 END) OVER o AS m1, max(CASE WHEN pool = 2 THEN e + 300 END) OVER o AS m2
        FROM w WINDOW o AS (PARTITION BY user_id ORDER BY e, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT user_id, event_id, CAST(e - greatest(CASE WHEN pool <> 0 THEN m0 END, CASE WHEN pool <> 1 THEN m1 END, CASE WHEN pool <> 2 THEN m2 END) AS BIGINT) AS gap
    FROM a WHERE e - greatest(CASE WHEN pool <> 0 THEN m0 END, CASE WHEN pool <> 1 THEN m1 END, CASE WHEN pool <> 2 THEN m2 END) < 3600
""")
def v_purge_gaps(spark, sf_dir):
    from plumbline.operators.timeseries import purge_gaps

    events = with_utc(table(spark, sf_dir, "events"), "ts").withColumn("e", F.unix_timestamp("ts"))
    events = events.select("user_id", "event_id", "e", (F.col("e") + 300).alias("end"), (F.col("event_id") % 7 % 3).cast("int").alias("pool"))
    return purge_gaps(events, "user_id", "e", "end", "pool", [0, 1, 2], ["event_id"]).where("gap < 3600").select("user_id", "event_id", "gap")


@register("SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
def j_many_to_one(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return contracts.join_checked(table(spark, sf_dir, "orders"), customers, ["o_custkey"], cardinality="m:1").select("o_orderkey", "c_name", "o_totalprice")


@register("SELECT doc_id, lang, quality, toxic FROM documents JOIN labels USING (doc_id)")
def j_one_to_one(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    return contracts.join_checked(table(spark, sf_dir, "documents").select("doc_id", "lang"), labels, ["doc_id"], cardinality="1:1")


@register("SELECT doc_id, source, quality, quality IS NULL AS unlabelled FROM documents LEFT JOIN labels USING (doc_id)")
def j_left_outer(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", "source", "quality", F.col("quality").isNull().alias("unlabelled"))


@register("SELECT coalesce(c_custkey, s_suppkey) AS k, c_name, s_name FROM customer FULL JOIN supplier ON c_custkey = s_suppkey")
def j_full_outer(spark, sf_dir):
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    return c.join(s, F.col("c_custkey") == F.col("s_suppkey"), "full").select(F.coalesce("c_custkey", "s_suppkey").alias("k"), "c_name", "s_name")


@register("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)")
def j_semi(spark, sf_dir):
    rich = table(spark, sf_dir, "orders").where("o_totalprice > 100000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(rich, "c_custkey", "left_semi").select("c_custkey", "c_mktsegment")


@register("SELECT c_custkey, c_mktsegment FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def j_anti(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(orders, "c_custkey", "left_anti").select("c_custkey", "c_mktsegment")


@register("""
    SELECT r_name, n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name
""")
def j_star(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    joined = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("r_name", "n_name").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


BANDS = [(1, 5, "small"), (6, 15, "medium"), (16, 30, "large"), (31, 44, "huge")]


@register("""
    SELECT p_partkey, band, count(a) OVER (PARTITION BY p_partkey) AS matches FROM part LEFT JOIN (VALUES (1, 5, 'small'), (6, 15, 'medium'), (16, 30, 'large'), (31, 44, 'huge')) AS b(a, z, band)
    ON p_size BETWEEN a AND z
""")
def j_range_containment(spark, sf_dir):
    from plumbline.operators.ranges import containing

    bands = spark.createDataFrame(BANDS, "low int, high int, band string")
    found = containing(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_size", bands, "low", "high", ["p_partkey"])
    return found.select("p_partkey", "band", "matches")


@register("""
    WITH i AS (SELECT event_id, user_id, (epoch_us(ts) // 1000000) AS a, (epoch_us(ts) // 1000000) + 1800 AS z FROM events)
    SELECT l.user_id, l.event_id AS left_id, r.event_id AS right_id, least(l.z, r.z) - greatest(l.a, r.a) AS overlap
    FROM i l JOIN i r ON l.user_id = r.user_id AND l.a <= r.z AND r.a <= l.z AND l.event_id < r.event_id
""")
def j_interval_overlap(spark, sf_dir):
    from plumbline.operators.ranges import overlaps

    i = with_utc(table(spark, sf_dir, "events"), "ts").select("event_id", "user_id", F.unix_timestamp("ts").alias("a")).withColumn("z", F.col("a") + 1800)
    pairs = overlaps(i, "event_id", "a", "z", ["user_id"], width=1800)
    return pairs.select("user_id", "left_id", "right_id", "overlap")


@register("""
    WITH p AS (SELECT CAST(p_size AS BIGINT) AS s, p_brand || '/' || p_type AS p_brand FROM part),
    d AS (SELECT DISTINCT p_brand, s FROM p),
    e AS (SELECT p_brand, s, lead(s, 1, 61) OVER (PARTITION BY p_brand ORDER BY s) AS nxt, lag(s, 1, 0) OVER (PARTITION BY p_brand ORDER BY s) AS prev FROM d WHERE s BETWEEN 1 AND 60)
    SELECT p_brand, s + 1 AS low, nxt - 1 AS high FROM e WHERE nxt - s > 1
    UNION ALL SELECT p_brand, 1, min(s) - 1 FROM d WHERE s BETWEEN 1 AND 60 GROUP BY p_brand HAVING min(s) > 1
""")
def j_interval_subtraction(spark, sf_dir):
    from plumbline.operators.ranges import subtract_points

    points = table(spark, sf_dir, "part").select(F.concat_ws("/", "p_brand", "p_type").alias("p_brand"), F.col("p_size").cast("long").alias("s"))
    return subtract_points(points, "p_brand", "s", 1, 60)


GRID = [round(0.1 + 0.05 * k, 2) for k in range(17)]


@register("""
    WITH g AS (SELECT unnest([0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9]) AS threshold),
    s AS (SELECT event_type, value / 1000 AS score FROM events)
    SELECT event_type, CAST(threshold AS DOUBLE) AS threshold, count(*) FILTER (score >= CAST(threshold AS DOUBLE)) AS positives, count(*) AS n FROM s, g GROUP BY event_type, threshold
""")
def j_grid(spark, sf_dir):
    per = table(spark, sf_dir, "events").withColumn("score", F.col("value") / 1000)
    counts = per.groupBy("event_type").agg(F.count("*").alias("n"), *(F.count_if(F.col("score") >= g).alias(f"g{k}") for k, g in enumerate(GRID)))
    cells = F.explode(F.array(*(F.struct(F.lit(g).alias("threshold"), F.col(f"g{k}").alias("positives")) for k, g in enumerate(GRID)))).alias("c")
    return counts.select("event_type", "n", cells).select("event_type", "c.threshold", "c.positives", "n")


@register("""
    SELECT source, count(*) AS n, count(DISTINCT lang) AS langs, count(DISTINCT text) AS texts, max(n_chars) AS longest, min(n_chars) AS shortest,
        min(n_chars) <> max(n_chars) AS conflict, bool_and(n_chars > 10) AS all_long, bool_or(lang = 'de') AS any_de FROM documents GROUP BY source
""")
def a_group_summary(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(
        F.count("*").alias("n"), F.countDistinct("lang").alias("langs"), F.countDistinct("text").alias("texts"), F.max("n_chars").alias("longest"), F.min("n_chars").alias("shortest"),
        (F.min("n_chars") != F.max("n_chars")).alias("conflict"), F.bool_and(F.col("n_chars") > 10).alias("all_long"), F.bool_or(F.col("lang") == "de").alias("any_de"),
    )


@register("""
    SELECT lang, string_agg(source, ',' ORDER BY source) AS sources, count(*) AS n_sources FROM (SELECT DISTINCT lang, source FROM documents) GROUP BY lang
""")
def a_sorted_signature(spark, sf_dir):
    pairs = table(spark, sf_dir, "documents").select("lang", "source").distinct()
    return pairs.groupBy("lang").agg(fn.signature("source", ",").alias("sources"), F.count("*").alias("n_sources"))


@register("""
    SELECT conv_id, count(*) AS turns FROM conversations GROUP BY conv_id
    HAVING count(*) = 2 AND count(*) FILTER (role = 'user') = 1 AND count(*) FILTER (role = 'assistant') = 1
""")
def a_having_pairs(spark, sf_dir):
    per = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if(F.col("role") == "user").alias("u"), F.count_if(F.col("role") == "assistant").alias("a"))
    return per.where("turns = 2 and u = 1 and a = 1").select("conv_id", "turns")


@register("""
    SELECT event_type, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.75), 6) AS p75,
        round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) AS iqr, round(stddev_pop(value), 6) AS sd_pop, round(stddev_samp(value), 6) AS sd, round(avg(value), 6) AS mean FROM events GROUP BY event_type
""")
def a_exact_quantiles(spark, sf_dir):
    e = finite(table(spark, sf_dir, "events"))
    at = exact_quantiles(e, ["event_type"], "value", {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    rest = e.groupBy("event_type").agg(fn.rounded(F.stddev_pop("value")).alias("sd_pop"), fn.rounded(F.stddev_samp("value")).alias("sd"), fn.rounded(F.avg("value")).alias("mean"))
    at = at.select("event_type", *(fn.rounded(c).alias(c) for c in ("p25", "p50", "p75")), fn.rounded(F.col("p75") - F.col("p25")).alias("iqr"))
    return null_safe_join(at, rest, ["event_type"])


@register("""
    SELECT user_id, round(coalesce(regr_slope(value, epoch(ts) / 86400.0), 0), 5) + 0.0 AS slope, count(*) AS n FROM events GROUP BY user_id
""")
def a_linear_slope(spark, sf_dir):
    e = with_utc(table(spark, sf_dir, "events"), "ts").withColumn("x", F.unix_micros("ts") / 86400e6)
    return e.groupBy("user_id").agg(fn.rounded(F.coalesce(F.regr_slope("value", "x"), F.lit(0.0)), 5).alias("slope"), F.count("*").alias("n"))


@register("""
    SELECT l_shipmode_group AS flag, round(avg(m), 6) AS mean_of_means, count(*) AS orders FROM
        (SELECT l_returnflag AS l_shipmode_group, l_orderkey, avg(l_extendedprice) AS m FROM lineitem GROUP BY l_returnflag, l_orderkey) GROUP BY l_shipmode_group
""")
def a_two_stage_mean(spark, sf_dir):
    per = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("flag"), "l_orderkey").agg(F.avg("l_extendedprice").alias("m"))
    return per.groupBy("flag").agg(fn.rounded(F.avg("m")).alias("mean_of_means"), F.count("*").alias("orders"))


@register("""
    SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus
""")
def a_pricing_summary(spark, sf_dir):
    kept = table(spark, sf_dir, "lineitem").where("l_shipdate <= timestamp_ntz '1998-09-02'")
    return kept.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n")
    )


@register("SELECT lang, source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars, CAST(grouping(lang) AS INTEGER) AS no_lang, CAST(grouping(source) AS INTEGER) AS no_source FROM documents GROUP BY CUBE (lang, source)")
def a_cube(spark, sf_dir):
    return table(spark, sf_dir, "documents").cube("lang", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.grouping("lang").cast("int").alias("no_lang"), F.grouping("source").cast("int").alias("no_source"))


@register("""
    WITH d AS (SELECT DISTINCT CAST(doc_id AS VARCHAR) AS k FROM documents), b AS (SELECT substr(sha256(k), 1, 2) AS bucket, count(*) AS n, sha256(string_agg(k, chr(10) ORDER BY k)) AS h FROM d GROUP BY 1)
    SELECT sha256(string_agg(bucket || ':' || h, chr(10) ORDER BY bucket)) AS population_hash, CAST(sum(n) AS BIGINT) AS n FROM b
""")
def a_population_hash(spark, sf_dir):
    from plumbline.operators.records import population_hash

    return population_hash(table(spark, sf_dir, "documents"), "doc_id", 2)


@register("""
    SELECT source, max(CASE WHEN lang = 'en' THEN n END) AS en, max(CASE WHEN lang = 'fr' THEN n END) AS fr, max(CASE WHEN lang = 'de' THEN n END) AS de, max(CASE WHEN lang = 'es' THEN n END) AS es
    FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY source, lang) GROUP BY source
""")
def a_pivot(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").pivot("lang", ["en", "fr", "de", "es"]).agg(F.count(F.lit(1)))


@register("SELECT l_orderkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) - 1 AS INTEGER) AS place, round(sum(l_extendedprice) OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber ROWS UNBOUNDED PRECEDING), 2) AS running FROM lineitem")
def w_rank_and_running_sum(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(*LINE_KEY, "l_extendedprice", (-F.col("l_extendedprice")).alias("falling"))
    out = running(lines, ["l_orderkey"], ["falling", "l_linenumber"], {"n": ("count", F.lit(1)), "total": ("sum", F.col("l_extendedprice"))})
    return out.select(*LINE_KEY, (F.col("n") - 1).cast("int").alias("place"), F.round("total", 2).alias("running"))


@register("SELECT event_id, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS envelope FROM events")
def w_reverse_running_max(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    return running(events, ["user_id"], ["ts", "event_id"], {"envelope": ("max", F.col("value"))}, reverse=True).select("event_id", "envelope")


@register("""
    WITH g AS (SELECT user_id, (epoch_us(ts) // 1000000) - lag((epoch_us(ts) // 1000000)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events)
    SELECT user_id, coalesce(median(gap), 30.0) AS median_gap, count(gap) AS gaps, count(*) FILTER (gap < 0) AS backwards FROM g GROUP BY user_id
""")
def w_median_gap(spark, sf_dir):
    e = with_utc(table(spark, sf_dir, "events"), "ts").withColumn("e", F.unix_timestamp("ts"))
    known = running(e.select("user_id", "ts", "event_id", "e"), ["user_id"], ["ts", "event_id"], {"before": ("before", F.col("e"))})
    gaps = known.select("user_id", (F.col("e") - F.col("before")).alias("gap"))
    counts = gaps.groupBy("user_id").agg(F.count("gap").alias("gaps"), F.count_if(F.col("gap") < 0).alias("backwards"))
    return null_safe_join(exact_quantiles(gaps, ["user_id"], "gap", {"median_gap": 0.5}).fillna(30.0, ["median_gap"]), counts, ["user_id"])


@register("SELECT c_mktsegment, c_custkey, c_acctbal FROM customer QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) <= 3")
def w_top_n_per_group(spark, sf_dir):
    return selection.first_per_group(table(spark, sf_dir, "customer"), ["c_mktsegment"], [F.desc("c_acctbal"), "c_custkey"], 3).select("c_mktsegment", "c_custkey", "c_acctbal")


@register("""
    WITH r AS (SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY role ORDER BY sha256('9103|' || conv_id || '|' || turn), conv_id, turn) - 1 AS BIGINT) AS rn, count(*) OVER (PARTITION BY role) AS n, role FROM conversations),
    o AS (SELECT *, (rn + CASE WHEN n > 1 THEN 1 + (('0x' || substr(sha256('9103|' || role), 1, 8))::BIGINT % (n - 1)) ELSE 0 END) % n AS src FROM r)
    SELECT o.role, o.conv_id, o.turn, s.conv_id AS from_conv, s.turn AS from_turn FROM o JOIN r s ON o.role = s.role AND o.src = s.rn
""")
def w_derangement(spark, sf_dir):
    return selection.derangement(table(spark, sf_dir, "conversations").select("role", "conv_id", "turn"), "role", ["conv_id", "turn"], 9103)


@register("""
    WITH t AS (SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations)
    SELECT conv_id, string_agg(role, '>' ORDER BY turn) AS observed, count(*) AS runs FROM t WHERE prev IS NULL OR prev <> role GROUP BY conv_id
""")
def w_observed_order(spark, sf_dir):
    return selection.observed_order(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", "role")


@register("""
    WITH f AS (SELECT p_brand, p_partkey, p_retailprice, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rn, count(*) OVER (PARTITION BY p_brand) AS n FROM part)
    SELECT p_brand, p_partkey, p_retailprice FROM f WHERE rn = n // 2 + 1
""")
def w_median_rank(spark, sf_dir):
    return selection.median_rank(table(spark, sf_dir, "part"), ["p_brand"], [F.desc("p_retailprice"), "p_partkey"]).select("p_brand", "p_partkey", "p_retailprice")


@register("SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def o_top_k(spark, sf_dir):
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey", "o_orderpriority", "o_totalprice")


@register("""
    WITH c AS (SELECT event_type || '@' || CAST(t AS VARCHAR) AS candidate_id, event_type AS family_id, CAST(t AS DOUBLE) AS threshold,
            count(*) FILTER (value >= t AND user_id % 2 = 0) / 720.0 AS fa, 2.0 * count(*) FILTER (value >= t AND user_id % 2 = 1) / (count(*) FILTER (value >= t) + count(*) FILTER (user_id % 2 = 1)) AS f1,
            1 - count(*) FILTER (value >= t AND user_id % 2 = 1) / CAST(count(*) FILTER (user_id % 2 = 1) AS DOUBLE) AS miss
        FROM events, (SELECT unnest([10, 20, 40, 80, 160]) AS t) GROUP BY event_type, t),
    o AS (SELECT *, row_number() OVER (PARTITION BY family_id ORDER BY f1 DESC, miss, threshold DESC, candidate_id) AS rn FROM c WHERE fa <= 1),
    d AS (SELECT *, row_number() OVER (PARTITION BY family_id ORDER BY fa, miss, threshold DESC, candidate_id) AS rn FROM c)
    SELECT d.family_id, CASE WHEN o.candidate_id IS NULL THEN 'diagnostic_only_blocked' ELSE 'pass' END AS status, o.candidate_id AS selected, d.candidate_id AS diagnostic FROM d LEFT JOIN o ON o.family_id = d.family_id AND o.rn = 1 WHERE d.rn = 1
""")
def o_constrained_threshold(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", "value", (F.col("user_id") % 2 == 1).alias("truth"))
    marks = [10, 20, 40, 80, 160]
    per = e.groupBy("event_type").agg(F.count_if("truth").alias("pos"), *(F.count_if((F.col("value") >= t) & ~F.col("truth")).alias(f"fp{t}") for t in marks), *(F.count_if((F.col("value") >= t) & F.col("truth")).alias(f"tp{t}") for t in marks))
    rows = F.explode(F.array(*(F.struct(F.lit(t).alias("t"), F.col(f"tp{t}").alias("tp"), F.col(f"fp{t}").alias("fp")) for t in marks))).alias("r")
    c = per.select("event_type", "pos", rows).select(
        F.concat_ws("@", "event_type", F.col("r.t").cast("string")).alias("candidate_id"), F.col("event_type").alias("family_id"), F.col("r.t").cast("double").alias("threshold"),
        (F.col("r.fp") / 720).alias("false_alarms_per_hour"), (2 * F.col("r.tp") / (F.col("r.tp") + F.col("r.fp") + F.col("pos"))).alias("event_macro_f1"), (1 - F.col("r.tp") / F.col("pos")).alias("event_miss_rate"),
    )
    return selection.select_threshold(c, ["family_id"], 1.0)


@register("""
    SELECT c_custkey AS k, c_name AS name, c_acctbal AS bal, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_name, s_acctbal, NULL FROM supplier
""")
def u_union_by_name(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_acctbal").alias("bal"), F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))
    return c.unionByName(s, allowMissingColumns=True)


@register("SELECT user_id AS k FROM events INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def u_intersect(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("k")).intersect(table(spark, sf_dir, "customer").where("c_acctbal > 0").select("c_custkey"))


@register("SELECT p_brand, p_type FROM part WHERE p_size > 10 EXCEPT ALL SELECT p_brand, p_type FROM part WHERE p_retailprice > 1200")
def u_except_all(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.where("p_size > 10").select("p_brand", "p_type").exceptAll(p.where("p_retailprice > 1200").select("p_brand", "p_type"))


@register("SELECT DISTINCT lang, source FROM documents")
def u_distinct(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("lang", "source").distinct()


@register("""
    SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, lower(trim(regexp_replace(url, '[^A-Za-z0-9_]+', '_', 'g'), '_')) AS name,
        'grp_' || substr(sha256('["' || regexp_extract(url, '^https?://([^/]+)', 1) || '"]'), 1, 24) AS group_id, sha256('7|' || url) AS h,
        CAST(('0x' || substr(sha256('7|' || url), 1, 16))::UBIGINT % 97 AS BIGINT) AS slot FROM pages
""")
def c_names_and_hashes(spark, sf_dir):
    host = F.regexp_extract("url", "^https?://([^/]+)", 1)
    h = fn.joined_sha256(7, "url")
    return table(spark, sf_dir, "pages").select("page_id", host.alias("host"), fn.normalised_name("url").alias("name"), fn.group_identifier(host).alias("group_id"), h.alias("h"), fn.hash_modulo(h, 97).alias("slot"))


@register("""
    SELECT event_id, CAST(floor(epoch(ts) / 86400) * 86400 AS BIGINT) AS block, round(1 / (1 + exp(-greatest(-40, least(40, (value - 50) / 20)))), 6) AS p,
        round(ln(greatest(1e-6, least(1 - 1e-6, value / 1000)) / (1 - greatest(1e-6, least(1 - 1e-6, value / 1000)))), 6) AS logit, strftime(ts, '%Y-%m-%d') AS day FROM events
""")
def c_time_and_probability(spark, sf_dir):
    e = with_utc(table(spark, sf_dir, "events"), "ts")
    return e.select("event_id", fn.block_start(F.unix_timestamp("ts"), 86400).alias("block"), fn.rounded(fn.logistic((F.col("value") - 50) / 20)).alias("p"), fn.rounded(fn.clipped_logit(F.col("value") / 1000)).alias("logit"), F.date_format("ts", "yyyy-MM-dd").alias("day"))


@register("SELECT lang, n_chars FROM documents WHERE n_chars > 5000")
def f_projected_scan(spark, sf_dir):
    """Two columns and a predicate that reach the scan: the texts are never read."""
    return table(spark, sf_dir, "documents").where("n_chars > 5000").select("lang", "n_chars")


@register(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in ("orders", "lineitem", "events", "documents")))
def f_row_counts(spark, sf_dir):
    """Row counts from the files' footers."""
    counts = [table(spark, sf_dir, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n") for t in ("orders", "lineitem", "events", "documents")]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])


@register("""
    SELECT event_id, ts > TIMESTAMP '2024-01-10 00:00:00' AND ts <= TIMESTAMP '2024-01-15 00:00:00' AS history, ts > TIMESTAMP '2024-01-15 00:00:00' AND ts <= TIMESTAMP '2024-01-17 00:00:00' AS forecast FROM events
""")
def f_causal_masks(spark, sf_dir):
    t, at = F.col("ts"), lambda d: F.expr(f"timestamp_ntz '{d}'")
    anchor = at("2024-01-15")
    return table(spark, sf_dir, "events").select("event_id", ((t > at("2024-01-10")) & (t <= anchor)).alias("history"), ((t > anchor) & (t <= at("2024-01-17"))).alias("forecast"))


@register("SELECT event_id, last_value(CASE WHEN value >= 50 THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_high, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 2 PRECEDING), 6) AS mean3 FROM events")
def w_last_known_and_trailing(spark, sf_dir):
    events, key = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value"), (["user_id"], ["ts", "event_id"])
    events, cut = in_ranges(events, *key)
    one = running(events, *key, {"last_high": ("last", F.when(F.col("value") >= 50, F.col("value"))), "v1": ("before", F.col("value"))}, cut=cut)
    two = running(one, *key, {"v2": ("before", F.col("v1"))}, cut=cut)
    three = F.filter(F.array("v2", "v1", "value"), lambda x: x.isNotNull())
    return two.select("event_id", "last_high", fn.rounded(F.try_divide(F.aggregate(three, F.lit(0.0), lambda a, x: a + x), F.size(three))).alias("mean3"))


@register("SELECT lang, source, min(doc_id) AS doc_id, arg_min(n_chars, doc_id) AS n_chars FROM documents GROUP BY lang, source")
def a_first_of_each(spark, sf_dir):
    """Distinct combinations with one deterministic row each."""
    return table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.min("doc_id").alias("doc_id"), F.min_by("n_chars", "doc_id").alias("n_chars"))


@register("""
    WITH e AS (SELECT DISTINCT conv_id, role AS source_node, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS target_node FROM conversations QUALIFY target_node IS NOT NULL)
    SELECT e.*, 'no_reverse' AS fault FROM e ANTI JOIN (SELECT conv_id, target_node AS source_node, source_node AS target_node FROM e) USING (conv_id, source_node, target_node)
    UNION ALL SELECT e.*, 'self' FROM e WHERE source_node = target_node
""")
def v_edge_symmetry(spark, sf_dir):
    after = F.lead("role").over(Window.partitionBy("conv_id").orderBy("turn"))
    edges = table(spark, sf_dir, "conversations").select("conv_id", F.col("role").alias("source_node"), after.alias("target_node")).where("target_node is not null")
    return contracts.asymmetric_edges(edges, ["conv_id"], "source_node", "target_node")


@register("""
    SELECT user_id, count(*) AS rows FROM events GROUP BY user_id HAVING count(*) FILTER (event_type = 'signup') <> 10 OR count(*) FILTER (event_type = 'error') <> 10 OR count(DISTINCT user_id % 2) > 1
""")
def v_trace_counts(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("parity", F.col("user_id") % 2)
    return contracts.trace_faults(e, ["user_id"], "event_type", {"signup": 10, "error": 10}, ["parity"])


@register("""
    WITH s AS (SELECT event_type, stddev_samp(value) AS sd, count(*) AS n FROM events GROUP BY event_type)
    SELECT event_type, n, CAST(ceil(pow(1.96 * sd / 2.5, 2)) AS BIGINT) AS needed, n >= ceil(pow(1.96 * sd / 2.5, 2)) AS feasible FROM s
""")
def a_precision_feasibility(spark, sf_dir):
    """Rows that a mean needs for a half width of 2.5, and whether there are as many."""
    needed = F.ceil(F.pow(1.96 * F.stddev_samp("value") / 2.5, F.lit(2)))
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), needed.alias("needed"), (F.count("*") >= needed).alias("feasible"))
