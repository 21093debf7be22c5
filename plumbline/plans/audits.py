"""Queries that audit tables against each other and against contracts: lookups in ranges, differences, nested rules, confirmed duplicates, calibrations per concept."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import rounded
from plumbline.operators import calibration, contracts, dedup, fusion
from plumbline.operators.ranges import range_faults
from plumbline.plans.catalogue import register
from plumbline.plans.corpora import FINE, RADIUS, near_pairs
from plumbline.plans.evaluation import FOLDS, LOGISTIC, SCORED, grid_sql, isotonic_sql, newton_sql, scored
from plumbline.sources import files
from plumbline.sources.tables import table

#: Parts as files in two kinds of numbering, some without a number; suppliers and nations own ranges of numbers, some of which overlap or descend.
STEMS = "CASE WHEN p_partkey % 13 = 0 THEN 'cover' WHEN p_partkey % 2 = 0 THEN CAST(p_partkey AS {text}) ELSE concat('p', CAST(p_size AS {text}), '-', CAST(p_partkey AS {text})) END"
OWNERS = "concat('s', CAST(s_suppkey AS {text})) AS value, CAST(s_suppkey * 20 AS {text}) AS start, CAST(s_suppkey * 20 + 14 + (s_suppkey % 3) * 5 - (CASE WHEN s_suppkey % 7 = 0 THEN 30 ELSE 0 END) AS {text}) AS \"end\""
PAGES = "concat('n', CAST(n_nationkey AS {text})) AS value, concat('p', CAST(n_nationkey * 2 AS {text}), '-0') AS start, concat('P', CAST(n_nationkey * 2 + 1 AS {text}), '-', CAST(n_nationkey * 9 AS {text})) AS \"end\""
PATTERN = r"lib/(?P<kind>[a-z]+)/(?P<record>[A-Za-z0-9-]+)\.png"
_text = lambda s, kind: s.replace("{text}", kind).replace('"', "`" if kind == "string" else '"')
NUMBER = "CASE WHEN regexp_matches({c}, '^[0-9]+$') THEN [0, CAST({c} AS BIGINT), 0] WHEN regexp_matches({c}, '^[pP][0-9]+-[0-9]+$') THEN [1, CAST(regexp_extract({c}, '^[pP]([0-9]+)-', 1) AS BIGINT), CAST(regexp_extract({c}, '-([0-9]+)$', 1) AS BIGINT)] END"


def owned_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").selectExpr(*_split(_text(OWNERS, "string"))).unionByName(table(spark, sf_dir, "nation").selectExpr(*_split(_text(PAGES, "string"))))


def _split(columns: str) -> list[str]:
    """Top-level parts of a list of columns."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(columns):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(columns[start:i])
            start = i + 1
    return [*out, columns[start:]]


RANGES = f"r0 AS (SELECT {_text(OWNERS, 'VARCHAR')} FROM supplier UNION ALL SELECT {_text(PAGES, 'VARCHAR')} FROM nation), r AS (SELECT value, {NUMBER.format(c='start')} AS a, {NUMBER.format(c='\"end\"')} AS z FROM r0)"


@register(f"""
    WITH p AS (SELECT p_partkey, {_text(STEMS, 'VARCHAR')} AS stem, p_partkey % 11 <> 0 AS fits FROM part), k AS (SELECT *, CASE WHEN fits THEN {NUMBER.format(c='stem')} END AS num FROM p), {RANGES},
    m AS (SELECT p_partkey, fits, num, count(value) AS n, min(value) AS value FROM k LEFT JOIN r ON a <= z AND num BETWEEN a AND z GROUP BY ALL)
    SELECT p_partkey, CASE WHEN n = 1 THEN value END AS owner, CASE WHEN NOT fits THEN 'no_match' WHEN num IS NULL THEN 'no_number' WHEN n = 0 THEN 'no_range' WHEN n > 1 THEN 'several_ranges' ELSE 'ok' END AS owner_status FROM m
""")
def x_range_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The owner of each part's file, by ranges of file numbers in two namespaces."""
    stem = F.expr(_text(STEMS, "string"))
    paths = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.when(F.col("p_partkey") % 11 == 0, "x/").otherwise("lib/img/"), stem, F.lit(".png")).alias("path"))
    return files.looked_up_ids(paths, "path", PATTERN, owned_ranges(spark, sf_dir), "owner").drop("path")


@register(f"""
    WITH {RANGES}, s AS (SELECT *, max(z) OVER (ORDER BY a, z, value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r WHERE a <= z)
    SELECT value, 'missing_end' AS fault FROM r WHERE a IS NULL OR z IS NULL UNION ALL SELECT value, 'descending' FROM r WHERE a > z UNION ALL SELECT value, 'overlapping' FROM s WHERE a <= reach
""")
def v_range_faults(spark, sf_dir):
    from plumbline.functions import file_number

    return range_faults(owned_ranges(spark, sf_dir), file_number(F.col("start")), file_number(F.col("end")), "value")


TOTALS = "(SELECT l_orderkey, sum(l_extendedprice) AS total, count(*) AS lines, max(l_returnflag) AS flag FROM lineitem GROUP BY l_orderkey)"


@register(f"""
    WITH a AS (SELECT l_orderkey AS k, total, lines, flag FROM {TOTALS}),
    b AS (
        SELECT k, CASE WHEN k % 1000 = 2 THEN NULL WHEN k % 1000 = 3 THEN total + 0.5 WHEN k % 10 = 0 THEN total + 1e-5 ELSE total END AS total, CASE WHEN k % 1000 = 4 THEN lines + 1 ELSE lines END AS lines, CASE WHEN k % 1000 = 5 THEN 'Z' ELSE flag END AS flag FROM a WHERE k % 1000 <> 1
        UNION ALL SELECT -k, total, lines, flag FROM a WHERE k % 1000 = 6 UNION ALL SELECT k, total, lines, flag FROM a WHERE k % 1000 = 7
    ),
    n AS (SELECT k, count(*) AS n, any_value(total) AS total, any_value(lines) AS lines, any_value(flag) AS flag FROM b GROUP BY k), j AS (SELECT coalesce(a.k, n.k) AS k, a.k AS ak, n.k AS nk, n.n, a.total AS t, n.total AS u, a.lines AS l, n.lines AS m, a.flag AS f, n.flag AS g FROM a FULL JOIN n ON a.k = n.k),
    d AS (
        SELECT k, 'only_left' AS kind, CAST(NULL AS VARCHAR) AS c FROM j WHERE nk IS NULL UNION ALL SELECT k, 'only_right', NULL FROM j WHERE ak IS NULL UNION ALL SELECT k, 'repeated_right', NULL FROM j WHERE ak IS NOT NULL AND n > 1
        UNION ALL SELECT k, 'null', 'total' FROM j WHERE ak IS NOT NULL AND n = 1 AND (t IS NULL) <> (u IS NULL) UNION ALL SELECT k, 'value', 'total' FROM j WHERE ak IS NOT NULL AND n = 1 AND abs(t - u) > 0.001
        UNION ALL SELECT k, 'value', 'lines' FROM j WHERE ak IS NOT NULL AND n = 1 AND l <> m UNION ALL SELECT k, 'value', 'flag' FROM j WHERE ak IS NOT NULL AND n = 1 AND f <> g
    ),
    r AS (SELECT *, CAST(k AS VARCHAR) AS s, row_number() OVER (PARTITION BY kind, c ORDER BY CAST(k AS VARCHAR)) AS i FROM d)
    SELECT kind, c AS "column", count(*) AS rows, string_agg(s, ',' ORDER BY s) FILTER (i <= 3) AS "first" FROM r GROUP BY kind, c
""")
def v_table_differences(spark, sf_dir):
    """Orders' totals derived again, against a copy in which each kind of difference was planted."""
    a = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.sum("l_extendedprice").alias("total"), F.count("*").alias("lines"), F.max("l_returnflag").alias("flag"))
    m, total = F.col("k") % 1000, F.col("total")
    b = a.where(m != 1).select(
        "k", F.when(m == 2, None).when(m == 3, total + 0.5).when(F.col("k") % 10 == 0, total + 1e-5).otherwise(total).alias("total"), F.when(m == 4, F.col("lines") + 1).otherwise(F.col("lines")).alias("lines"), F.when(m == 5, "Z").otherwise(F.col("flag")).alias("flag")
    )
    b = b.unionByName(a.where(m == 6).withColumn("k", -F.col("k"))).unionByName(a.where(m == 7))
    return contracts.table_differences(a, b, ["k"], {"total": 0.001})


POOLS = ("tr", "sel", "pol", "te")


@register("""
    WITH d AS (SELECT doc_id // 10 AS c, list_sort(list(DISTINCT lang)) AS types, count(*) FILTER (doc_id % 4 = 0) AS n0, count(*) AS n FROM documents GROUP BY 1),
    t AS (SELECT *, CASE WHEN c % 7 = 0 THEN list_reverse(types) WHEN c % 23 = 0 THEN list_append(types, ' ') ELSE types END AS y, len(types) >= 2 OR c % 13 = 0 AS eligible FROM d),
    x AS (
        SELECT *, len(list_filter(y, lambda v: trim(v) = '')) AS blank, len(list_filter(range(1, len(y)), lambda i: y[i + 1] <= y[i])) AS falls, CASE WHEN c % 11 = 0 THEN 1 ELSE 0 END AS odd, CASE WHEN c % 29 = 0 THEN 1 ELSE 0 END AS negative,
            CASE WHEN c % 5 = 0 THEN n - 1 ELSE n END AS groups, CASE WHEN c % 17 = 0 THEN '' WHEN eligible AND c % 31 <> 0 THEN NULL ELSE 'few' END AS reason FROM t
    )
    SELECT r.* FROM (SELECT
        [{'rule': 'blank:eligible_branch_types', 'broken': count(*) FILTER (blank > 0), 'elements': CAST(sum(blank) AS BIGINT)}, {'rule': 'sorted:eligible_branch_types', 'broken': count(*) FILTER (falls > 0), 'elements': CAST(sum(falls) AS BIGINT)},
         {'rule': 'keys:multibranch_event_count_by_pool', 'broken': count(*) FILTER (odd > 0), 'elements': CAST(sum(odd) AS BIGINT)}, {'rule': 'element:event_count', 'broken': count(*) FILTER (negative > 0), 'elements': CAST(sum(negative) AS BIGINT)},
         {'rule': 'rule:graph_needs_fusion', 'broken': count(*) FILTER (NOT eligible AND c % 3 = 0), 'elements': count(*) FILTER (NOT eligible AND c % 3 = 0)}, {'rule': 'rule:episode_skeleton_candidate_hash', 'broken': count(*) FILTER (c % 19 = 0), 'elements': count(*) FILTER (c % 19 = 0)},
         {'rule': 'rule:ontology_lock_hash', 'broken': 0, 'elements': 0}, {'rule': 'rule:split_manifest_hash', 'broken': 0, 'elements': 0}, {'rule': 'rule:type_count', 'broken': count(*) FILTER (len(y) <> len(types)), 'elements': count(*) FILTER (len(y) <> len(types))},
         {'rule': 'rule:group_count', 'broken': 0, 'elements': 0}, {'rule': 'rule:two_types', 'broken': count(*) FILTER (eligible AND len(y) < 2), 'elements': count(*) FILTER (eligible AND len(y) < 2)},
         {'rule': 'rule:no_reason', 'broken': count(*) FILTER (eligible AND reason IS NOT NULL), 'elements': count(*) FILTER (eligible AND reason IS NOT NULL)},
         {'rule': 'rule:reason', 'broken': count(*) FILTER (NOT eligible AND coalesce(trim(reason), '') = ''), 'elements': count(*) FILTER (NOT eligible AND coalesce(trim(reason), '') = '')},
         {'rule': 'rule:floor', 'broken': count(*) FILTER (eligible AND groups < 10), 'elements': count(*) FILTER (eligible AND groups < 10)}, {'rule': 'key:concept_id', 'broken': 0, 'elements': 0}] AS rs FROM x), unnest(rs) AS u(r)
""")
def v_fusion_eligibility(spark, sf_dir):
    """Tens of documents as concepts, their languages as branch types, with faults of every kind."""
    d = table(spark, sf_dir, "documents").groupBy(F.expr("doc_id div 10").alias("c")).agg(F.array_sort(F.collect_set("lang")).alias("types"), F.count_if(F.col("doc_id") % 4 == 0).alias("n0"), F.count("*").alias("n"))
    c = F.col("c")
    types = F.when(c % 7 == 0, F.reverse("types")).when(c % 23 == 0, F.array_append("types", " ")).otherwise(F.col("types"))
    eligible = (F.size("types") >= 2) | (c % 13 == 0)
    counts = F.map_from_arrays(F.when(c % 11 == 0, F.array(*map(F.lit, POOLS[:3]))).otherwise(F.array(*map(F.lit, POOLS))), F.when(c % 11 == 0, F.array(*[F.col("n0")] * 3)).otherwise(F.array(*[F.col("n0")] * 4)))
    negative = F.map_from_arrays(F.map_keys(counts), F.transform(F.map_values(counts), lambda x, i: F.when((i == 0) & (c % 29 == 0), F.lit(-1).cast("long")).otherwise(x)))
    sha = F.sha2(c.cast("string"), 256)
    rows = d.select(
        c.cast("string").alias("concept_id"), eligible.alias("fusion_primary_eligible"), (c % 3 == 0).alias("graph_primary_eligible"), F.when(c % 19 == 0, "x").otherwise(sha).alias("episode_skeleton_candidate_hash"), sha.alias("ontology_lock_hash"),
        sha.alias("split_manifest_hash"), types.alias("eligible_branch_types"), F.size("types").alias("eligible_branch_type_count"), F.when(c % 5 == 0, F.col("n") - 1).otherwise(F.col("n")).alias("independent_multibranch_positive_group_count"),
        negative.alias("multibranch_event_count_by_pool"), F.when(c % 17 == 0, "").when(eligible & (c % 31 != 0), None).otherwise("few").alias("exclusion_reason"),
    )
    return contracts.fusion_eligibility(rows, POOLS, 10)


#: Looser than pictures need, so that vectors without near copies are found in every state.
BOUNDS = {"aspect_max": 0.2, "deviation_min": 0.05, "intensity_min": 0.2, "gradient_min": 0.05, "affine_rmse_max": 1.0}


@register(f"""
    WITH b AS (SELECT vec_id, label, {FINE} AS bits, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), c AS (SELECT label % 2 AS half, bits, min(vec_id) AS id FROM b GROUP BY ALL),
    l AS (SELECT l.id AS left_id, r.id AS right_id, CAST(bit_count(xor(l.bits, r.bits)) AS INTEGER) AS distance FROM c l JOIN c r ON l.half = r.half AND l.id < r.id AND bit_count(xor(l.bits, r.bits)) <= {RADIUS}),
    g AS (SELECT vec_id, label, v, list_transform(range(1, 57), lambda i: v[i + 8] - v[i]) || list_transform(list_filter(range(1, 64), lambda i: i % 8 <> 0), lambda i: v[i + 1] - v[i]) AS g FROM b),
    z AS (SELECT vec_id, label, list_transform(v, lambda x: x - list_avg(v)) AS v, list_transform(g, lambda x: x - list_avg(g)) AS g, (100 + vec_id % 7) / (90 + vec_id % 5)::DOUBLE AS ratio FROM g),
    p AS (
        SELECT l.*, a.label AS al, b.label AS bl, abs(a.ratio - b.ratio) / greatest(a.ratio, b.ratio) AS aspect, list_inner_product(a.v, a.v) AS aa, list_inner_product(b.v, b.v) AS bb, list_inner_product(a.v, b.v) AS ab,
            list_inner_product(a.g, b.g) / sqrt(list_inner_product(a.g, a.g)) / sqrt(list_inner_product(b.g, b.g)) AS gradient FROM l JOIN z a ON a.vec_id = left_id JOIN z b ON b.vec_id = right_id
    ),
    m AS (SELECT *, sqrt(least(aa, bb) / 64) AS deviation, ab / sqrt(aa) / sqrt(bb) AS intensity, sqrt(greatest(bb - ab * ab / aa, aa - ab * ab / bb) / 64) AS affine_rmse FROM p)
    SELECT left_id, right_id, distance, round(aspect, 6) + 0.0 AS aspect, round(deviation, 6) AS deviation, round(intensity, 6) AS intensity, round(gradient, 6) AS gradient, round(affine_rmse, 6) AS affine_rmse,
        CASE WHEN al // 2 % 3 <> bl // 2 % 3 THEN 'other_kind' WHEN NOT (aspect <= 0.2 AND deviation >= 0.05 AND intensity >= 0.2 AND gradient >= 0.05 AND affine_rmse <= 1.0) THEN 'rejected' WHEN al // 2 <> bl // 2 THEN 'conflict' ELSE 'confirmed' END AS status FROM m
""")
def e_confirmed_duplicates(spark, sf_dir):
    """Candidates by fingerprint, told apart by structure and meaning; a vector is a picture of 8 columns."""
    _, near = near_pairs(spark, sf_dir)
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", (100 + F.col("vec_id") % 7).alias("wide"), (90 + F.col("vec_id") % 5).alias("high"), F.expr("label div 2 % 3").alias("kind"), F.expr("label div 2").alias("means"))
    told = dedup.confirm_near(near.select("left_id", "right_id", "distance"), e, "vec_id", "embedding", 8, "wide", "high", "kind", "means", levels=1.0, bounds=BOUNDS)
    return told.select("left_id", "right_id", "distance", *(rounded(c).alias(c) for c in ("aspect", "deviation", "intensity", "gradient", "affine_rmse")), "status")


LOGITS = "z AS (SELECT lang AS k, quality AS y, doc_id, p, ln(greatest(1e-6, least(1 - 1e-6, p)) / (1 - greatest(1e-6, least(1 - 1e-6, p)))) AS z FROM d)"


@register(f"WITH {SCORED}, {LOGITS}, {grid_sql()} SELECT k AS lang, round((a + b) / 2, 4) + 0.0 AS log_temperature FROM t6")
def m_concept_temperatures(spark, sf_dir):
    fits = calibration.fit_temperatures(scored(spark, sf_dir), ["lang"], "p", "quality")
    return fits.select("lang", rounded(F.log("temperature"), 4).alias("log_temperature"))


@register(f"WITH {SCORED}, {LOGITS}, {isotonic_sql()} SELECT doc_id, z.k AS lang, round(value, 6) AS isotonic FROM z JOIN v ON v.k = z.k AND v.x = z.p")
def m_concept_isotonic(spark, sf_dir):
    """The isotonic fit of each language at its documents' scores."""
    d = scored(spark, sf_dir).select("doc_id", "lang", "p", "quality")
    return calibration.interpolated(d, ["lang"], "p", calibration.fit_isotonics(d, ["lang"], "p", "quality"), "isotonic").select("doc_id", "lang", rounded("isotonic").alias("isotonic"))


@register(f"""
    WITH {SCORED}, r AS (SELECT count(DISTINCT doc_id) AS n FROM d WHERE true), e AS (SELECT lang, doc_id, CASE WHEN doc_id % 9 = 0 THEN NULL WHEN doc_id % 10 = 0 THEN p + 1 ELSE p END AS p, CASE WHEN doc_id % 8 = 0 THEN 2 WHEN doc_id % 6 = 0 THEN NULL ELSE quality END AS y FROM d UNION ALL SELECT lang, doc_id, p, quality FROM d WHERE doc_id % 15 = 1),
    g AS (SELECT lang, count(*) - count(DISTINCT doc_id) AS repeated, count(*) FILTER (p IS NULL) AS no_score, count(*) FILTER (p < 0 OR p > 1) AS score_range, count(*) FILTER (y IS NULL) AS no_label, count(*) FILTER (y NOT IN (0, 1)) AS label_value, (SELECT n FROM r) - count(DISTINCT doc_id) AS missing_records, CASE WHEN min(y) = max(y) THEN count(*) ELSE 0 END AS one_class FROM e GROUP BY lang)
    SELECT lang, fault, rows FROM (UNPIVOT g ON repeated, no_score, score_range, no_label, label_value, missing_records, one_class INTO NAME fault VALUE rows) WHERE rows > 0
""")
def v_calibration_faults(spark, sf_dir):
    d = scored(spark, sf_dir).select("lang", "doc_id", "p", "quality")
    i = F.col("doc_id")
    p = F.when(i % 9 == 0, None).when(i % 10 == 0, F.col("p") + 1).otherwise(F.col("p"))
    y = F.when(i % 8 == 0, 2).when(i % 6 == 0, None).otherwise(F.col("quality"))
    e = d.select("lang", "doc_id", p.alias("p"), y.cast("int").alias("quality")).unionByName(d.where(i % 15 == 1).withColumn("quality", F.col("quality").cast("int")))
    return calibration.calibration_faults(e, ["doc_id"], ["lang"], "p", "quality")


@register(f"""
    WITH RECURSIVE {SCORED}, {FOLDS}, zf AS (SELECT d.*, fold, quality AS y, ln(greatest(1e-6, least(1 - 1e-6, p)) / (1 - greatest(1e-6, least(1 - 1e-6, p)))) AS z FROM d JOIN fo ON grp = doc_id // 7),
    tr AS MATERIALIZED (SELECT lang || '|' || h AS k, p, y, z FROM zf, range(-1, 3) AS x(h) WHERE fold <> h), {grid_sql("tr")}, {newton_sql("tr")}, {isotonic_sql("tr")},
    te AS (SELECT lang, lang || '|' || fold AS k, p, y, {LOGISTIC.format(x="z / exp((t6.a + t6.b) / 2)")} AS temperature, {LOGISTIC.format(x="n25.a * z + n25.b")} AS platt FROM zf JOIN t6 ON t6.k = lang || '|' || fold JOIN n25 ON n25.k = lang || '|' || fold),
    lo AS (SELECT te.*, v.x AS x0, v.value AS y0 FROM te ASOF LEFT JOIN v ON te.k = v.k AND te.p >= v.x), hi AS (SELECT lo.*, v.x AS x1, v.value AS y1 FROM lo ASOF LEFT JOIN v ON lo.k = v.k AND lo.p <= v.x),
    ev AS (SELECT lang, k, avg(pow(temperature - y, 2)) AS t, avg(pow(platt - y, 2)) AS q, avg(pow(CASE WHEN x0 IS NULL THEN y1 WHEN x1 IS NULL OR x0 = p THEN y0 ELSE y0 + (y1 - y0) * (p - x0) / (x1 - x0) END - y, 2)) AS i FROM hi GROUP BY ALL),
    me AS (SELECT lang, unnest([{{'m': 'temperature', 'b': avg(t)}}, {{'m': 'platt', 'b': avg(q)}}, {{'m': 'isotonic', 'b': avg(i)}}]) AS r FROM ev GROUP BY lang)
    SELECT lang, r.m AS method, round(r.b, 5) AS brier, r.b = min(r.b) OVER (PARTITION BY lang) AS selected, round((t6.a + t6.b) / 2, 3) + 0.0 AS log_temperature, round(n25.a, 4) + 0.0 AS slope, round(n25.b, 4) + 0.0 AS intercept
    FROM me JOIN t6 ON t6.k = lang || '|-1' JOIN n25 ON n25.k = lang || '|-1'
""")
def m_concept_calibrators(spark, sf_dir):
    """For each language, the calibration that does best over folds of whole groups, and the parameters fitted on all its rows."""
    d = scored(spark, sf_dir).withColumn("grp", F.expr("doc_id div 7"))
    choice, fits, _ = calibration.choose_calibrators(d, ["lang"], "p", "quality", "grp")
    return choice.join(fits, "lang").select("lang", "method", rounded("brier", 5).alias("brier"), "selected", rounded(F.log("temperature"), 3).alias("log_temperature"), *(rounded(c, 4).alias(c) for c in ("slope", "intercept")))


#: Roles as nodes, joined both ways.
ROLES = ("user", "assistant", "system")
EDGES = tuple((a, b) for a in range(3) for b in range(3) if a != b)


@register()
def m_graph_fusion(spark, sf_dir):
    """Pairs of turns as steps whose roles are nodes, through two rounds of messages; tested against a loop over nodes and edges."""
    c = table(spark, sf_dir, "conversations").withColumn("p", F.least(F.lit(1.0), F.length("text") / 800))
    cell = lambda r, v: F.max(F.when(F.col("role") == r, v))
    quality = lambda r: F.array(cell(r, F.col("turn") / 10), cell(r, F.col("p") * F.col("p")))
    steps = c.groupBy("conv_id", F.expr("turn div 2").alias("step")).agg(
        F.array(*(cell(r, F.col("p")) for r in ROLES)).alias("p"), F.array(*(F.coalesce(cell(r, F.lit(True)), F.lit(False)) for r in ROLES)).alias("available"), F.array(*(quality(r) for r in ROLES)).alias("quality"),
        F.array(F.lit(1.0), F.lit(-0.5)).alias("concept"), F.array(*(F.array(F.lit((a - b) / 2)) for a, b in EDGES)).alias("pairs"),
    )
    out = fusion.graph_fused(steps, fusion.seeded_fusion(3, 2, 2, 1, EDGES, hidden=8, threshold=0.3))
    return out.select("conv_id", "step", rounded("probability").alias("probability"), "abstained", F.aggregate("weights", F.lit(0.0), lambda a, x: a + x).cast("decimal(9,6)").alias("weight"))
