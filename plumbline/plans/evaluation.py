"""Queries of metrics, calibration, paired statistics and detections."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import rounded
from plumbline.operators import detection, metrics, models
from plumbline.operators.stash import stash
from plumbline.plans.catalogue import register
from plumbline.sources.tables import table


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with a stand-in score in [0, 1]."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    return d.withColumn("p", (F.col("n_chars") * 37 + F.col("doc_id")) % 1001 / 1000.0)


SCORED = "d AS (SELECT doc_id, lang, source, quality, toxic, ((n_chars * 37 + doc_id) % 1001) / 1000.0::DOUBLE AS p FROM documents JOIN labels USING (doc_id))"


@register(f"""
    WITH {SCORED}, b AS (SELECT lang, len(list_filter([0.1, 0.2, 0.1::DOUBLE * 3, 0.4, 0.5, 0.1::DOUBLE * 6, 0.1::DOUBLE * 7, 0.8, 0.9], lambda e: p >= e)) AS bin, count(*) AS n, avg(p) AS conf, avg(quality::DOUBLE) AS acc FROM d GROUP BY ALL)
    SELECT lang, round(sum(n * abs(conf - acc)) / sum(n), 6) AS ece, CAST(sum(n) AS BIGINT) AS n FROM b GROUP BY lang
""")
def m_calibration_error(spark, sf_dir):
    out = metrics.calibration_error(scored(spark, sf_dir), ["lang"], "p", "quality")
    return out.select("lang", rounded("ece").alias("ece"), "n")


@register(f"WITH {SCORED} SELECT lang, round(avg(pow(p - quality, 2)), 6) AS brier, count(*) AS n FROM d GROUP BY lang")
def m_brier(spark, sf_dir):
    return scored(spark, sf_dir).groupBy("lang").agg(rounded(metrics.brier("p", "quality")).alias("brier"), F.count("*").alias("n"))


@register(f"""
    WITH {SCORED}, t AS (SELECT lang, p, count(*) AS n, sum(quality) AS pos FROM d GROUP BY lang, p),
    c AS (SELECT *, sum(n) OVER w AS cn, sum(pos) OVER w AS cp FROM t WINDOW w AS (PARTITION BY lang ORDER BY p DESC))
    SELECT lang, round(sum(pos * cp / cn::DOUBLE) / sum(pos), 6) AS average_precision, CAST(sum(pos) AS BIGINT) AS positives FROM c GROUP BY lang
""")
def m_average_precision(spark, sf_dir):
    out = metrics.average_precision(scored(spark, sf_dir), ["lang"], "p", "quality")
    return out.select("lang", rounded("average_precision").alias("average_precision"), "positives")


@register(f"""
    WITH {SCORED} SELECT lang, count(*) FILTER (p >= 0.5 AND quality = 1) AS tp, count(*) FILTER (p >= 0.5 AND quality <> 1) AS fp, count(*) FILTER (p < 0.5 AND quality = 1) AS fn, count(*) FILTER (p < 0.5 AND quality <> 1) AS tn,
        round(coalesce(2.0 * count(*) FILTER (p >= 0.5 AND quality = 1) / nullif(count(*) FILTER (p >= 0.5) + count(*) FILTER (quality = 1), 0), 1.0), 6) AS f1 FROM d GROUP BY lang
""")
def m_confusion(spark, sf_dir):
    out = metrics.confusion(scored(spark, sf_dir), ["lang"], F.col("p") >= 0.5, "quality")
    return out.withColumn("f1", rounded("f1"))


@register(f"""
    WITH {SCORED} SELECT source, round(avg(CASE WHEN abs(p - 0.5) >= 0.2 THEN 1.0 ELSE 0.0 END), 6) AS coverage,
        round(coalesce(avg(CASE WHEN (p >= 0.5) <> (quality = 1) THEN 1.0 ELSE 0.0 END) FILTER (abs(p - 0.5) >= 0.2), 1.0), 6) AS risk FROM d GROUP BY source
""")
def m_selective_risk(spark, sf_dir):
    out = metrics.selective_risk(scored(spark, sf_dir), ["source"], F.abs(F.col("p") - 0.5) >= 0.2, (F.col("p") >= 0.5) != (F.col("quality") == 1))
    return out.select("source", rounded("coverage").alias("coverage"), rounded("risk").alias("risk"))


@register(f"""
    WITH {SCORED}, a AS (SELECT source, avg(quality::DOUBLE) AS clean, avg((quality = 1 AND toxic = 0)::INTEGER::DOUBLE) AS other FROM d GROUP BY source)
    SELECT source, CASE WHEN clean > 0 THEN round(100 * (clean - other) / clean, 6) + 0.0 END AS drop_percent FROM a
""")
def m_relative_drop(spark, sf_dir):
    good = F.avg(((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("double"))
    a = scored(spark, sf_dir).groupBy("source").agg(F.avg(F.col("quality").cast("double")).alias("clean"), good.alias("other"))
    return a.select("source", rounded(metrics.relative_drop(F.col("clean"), F.col("other"))).alias("drop_percent"))


PAIRS = f"{SCORED}, v AS (SELECT CASE WHEN CAST(round(p * 1000) AS BIGINT) % 2 = 0 THEN 'a' ELSE 'b' END AS family, lang, source, avg(p) AS value FROM d GROUP BY ALL), w AS (SELECT lang, source, max(value) FILTER (family = 'a') AS l, max(value) FILTER (family = 'b') AS r FROM v GROUP BY ALL)"


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    family = F.when(F.round(F.col("p") * 1000).cast("long") % 2 == 0, "a").otherwise("b")
    v = scored(spark, sf_dir).groupBy(family.alias("family"), "lang", "source").agg(F.avg("p").alias("value"))
    return metrics.paired_table(v, ["lang", "source"], "family", "value", "a", "b")


@register(f"""WITH {PAIRS} SELECT lang, source, round(l, 6) AS "left", round(r, 6) AS "right", round(l - r, 6) + 0.0 AS difference FROM w WHERE l IS NOT NULL AND r IS NOT NULL""")
def m_paired_table(spark, sf_dir):
    return pairs(spark, sf_dir).select("lang", "source", *(rounded(c).alias(c) for c in ("left", "right", "difference")))


DRAWS = 10_000

BOOTSTRAP = f"""
    WITH {PAIRS}, u AS (SELECT lang, l - r AS diff, row_number() OVER (PARTITION BY lang ORDER BY source) - 1 AS k, count(*) OVER (PARTITION BY lang) AS n FROM w WHERE l IS NOT NULL AND r IS NOT NULL),
    x AS (SELECT u.lang, draw, ('0x' || substr(sha256('12011|' || draw || '|' || lang || '|' || k), 1, 8))::BIGINT % n AS k FROM u, range(0, {DRAWS}) AS t(draw)),
    m AS (SELECT draw, round(avg(m), 12) AS mean FROM (SELECT draw, x.lang, avg(diff) AS m FROM x JOIN u ON u.lang = x.lang AND u.k = x.k GROUP BY ALL) GROUP BY draw)
"""


@register(BOOTSTRAP + """
    SELECT round(quantile_cont(mean, 0.025), 4) + 0.0 AS low, round(quantile_cont(mean, 0.975), 4) + 0.0 AS high, (SELECT round(avg(d), 6) + 0.0 FROM (SELECT avg(diff) AS d FROM u GROUP BY lang)) AS estimate,
        round(least(1.0, 2 * least(avg((mean <= 0)::INTEGER), avg((mean >= 0)::INTEGER))), 6) AS p_value FROM m
""")
def m_paired_bootstrap(spark, sf_dir):
    given = pairs(spark, sf_dir)
    means = metrics.paired_bootstrap(given, "lang", "source", "difference", DRAWS, 12011)
    return metrics.interval(given, means, "lang", "difference").select(*(rounded(c, 4).alias(c) for c in ("low", "high")), *(rounded(c).alias(c) for c in ("estimate", "p_value")))


CONTRASTS = f"""
    WITH {SCORED}, v AS (SELECT lang, source, avg(p) AS p, avg(quality::DOUBLE) AS q, avg(toxic::DOUBLE) AS t FROM d GROUP BY ALL),
    u0 AS (SELECT lang || ':' || kind AS contrast, lang, source, CASE kind WHEN 'lower' THEN p - q WHEN 'higher' THEN q - t ELSE p - 0.5 END AS diff FROM v, (VALUES ('lower'), ('higher'), ('same')) AS k(kind)),
    u AS (SELECT contrast, lang, diff, row_number() OVER (PARTITION BY contrast ORDER BY source) - 1 AS k, count(*) OVER (PARTITION BY contrast) AS n FROM u0),
    x AS (SELECT contrast, draw, ('0x' || substr(sha256('12011|' || contrast || '|' || draw || '|' || lang || '|' || k), 1, 8))::BIGINT % n AS k FROM u, range(0, {DRAWS}) AS t(draw)),
    m AS (SELECT contrast, draw, round(avg(diff), 12) AS mean FROM x JOIN u USING (contrast, k) GROUP BY ALL),
    i AS (SELECT contrast, quantile_cont(mean, 0.025) AS low, quantile_cont(mean, 0.975) AS high, least(1.0, 2 * least(avg((mean <= 0)::INTEGER), avg((mean >= 0)::INTEGER))) AS p FROM m GROUP BY contrast),
    e AS (SELECT i.*, (SELECT avg(diff) FROM u WHERE u.contrast = i.contrast) AS estimate, row_number() OVER (ORDER BY p, contrast) AS k, count(*) OVER () AS n FROM i),
    h AS (SELECT *, max(least(1.0, p * (n - k + 1))) OVER (ORDER BY p, contrast) AS ph FROM e)
    SELECT contrast, round(estimate, 6) + 0.0 AS estimate, round(low, 4) + 0.0 AS low, round(high, 4) + 0.0 AS high, round(p, 6) AS p_value, round(ph, 6) AS p_holm,
        CASE WHEN high < 0 THEN 'negative' WHEN low > 0 AND estimate >= 0.05 AND ph <= 0.05 THEN 'support' ELSE 'inconclusive' END AS decision FROM h
"""


@register(CONTRASTS)
def m_holm(spark, sf_dir):
    """Three contrasts a language, from bootstrap to decision: all three decisions occur."""
    v = scored(spark, sf_dir).groupBy("lang", "source").agg(F.avg("p").alias("p"), F.avg(F.col("quality").cast("double")).alias("q"), F.avg(F.col("toxic").cast("double")).alias("t"))
    kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), d.alias("difference")) for k, d in (("lower", F.col("p") - F.col("q")), ("higher", F.col("q") - F.col("t")), ("same", F.col("p") - 0.5))))).alias("c")
    given = v.select("lang", "source", kinds).select("lang", "source", F.concat_ws(":", "lang", "c.kind").alias("contrast"), "c.difference")
    means = metrics.paired_bootstrap(given, "lang", "source", "difference", DRAWS, 12011, ["contrast"])
    tested = metrics.interval(given, means, "lang", "difference", ["contrast"])
    held = metrics.holm(tested, "contrast", "p_value")
    decided = metrics.contrast_decision(F.col("estimate"), F.col("low"), F.col("high"), F.col("p_holm"), 0.05)
    return held.select("contrast", *(rounded(c, 4).alias(c) for c in ("low", "high")), *(rounded(c).alias(c) for c in ("estimate", "p_value", "p_holm")), decided.alias("decision"))


@register("""
    SELECT event_type, round(avg(value), 6) AS mean, round(avg(value) - coalesce(1.96 * stddev_samp(value) / sqrt(count(value)), 0), 6) AS low, round(avg(value) + coalesce(1.96 * stddev_samp(value) / sqrt(count(value)), 0), 6) AS high FROM events GROUP BY event_type
""")
def m_mean_interval(spark, sf_dir):
    out = table(spark, sf_dir, "events").groupBy("event_type").agg(*metrics.mean_interval("value"))
    return out.select("event_type", *(rounded(c).alias(c) for c in ("mean", "low", "high")))


@register("""
    WITH t AS (SELECT event_type AS module, CAST(value * 1000000 AS BIGINT) AS ns FROM events WHERE event_id % 5 <> 0)
    SELECT module, CAST(floor(quantile_cont(ns, 0.5)) AS BIGINT) AS latency_p50_ns, CAST(floor(quantile_cont(ns, 0.95)) AS BIGINT) AS latency_p95_ns, round(count(*) * 1e9 / sum(ns), 6) AS throughput_per_second, count(*) AS n FROM t GROUP BY module
""")
def m_latency_summary(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("module"), F.when(F.col("event_id") % 5 == 0, "warmup").otherwise("timed").alias("phase"), F.round(F.col("value") * 1000000).cast("long").alias("ns"))
    return metrics.latency_summary(e, ["module"], "phase", "ns").withColumn("throughput_per_second", rounded("throughput_per_second"))


FEATURES = ("l_quantity", "l_extendedprice", "l_discount")


@register(" UNION ALL ".join(f"SELECT l_returnflag, '{f}' AS feature, round(median({f}), 4) AS center, round(CASE WHEN quantile_cont({f}, 0.75) - quantile_cont({f}, 0.25) = 0 THEN 1.0 ELSE quantile_cont({f}, 0.75) - quantile_cont({f}, 0.25) END, 4) AS scale FROM lineitem GROUP BY l_returnflag" for f in FEATURES))
def m_robust_scale(spark, sf_dir):
    out = metrics.robust_scale(table(spark, sf_dir, "lineitem"), ["l_returnflag"], FEATURES)
    return out.select("l_returnflag", "feature", F.round("center", 4).alias("center"), F.round("scale", 4).alias("scale"))


@register(" UNION ALL ".join(f"SELECT '{f}' AS feature, round(median({f}), 4) AS median, round(avg({f}), 4) AS mean, round(stddev_pop({f}), 4) AS std FROM lineitem WHERE l_returnflag <> 'R'" for f in FEATURES))
def m_standardizer(spark, sf_dir):
    out = metrics.standardizer(table(spark, sf_dir, "lineitem"), FEATURES, F.col("l_returnflag") != "R")
    return out.select("feature", *(F.round(c, 4).alias(c) for c in ("median", "mean", "std")))


@register(f"""
    WITH RECURSIVE {SCORED}, g AS (SELECT doc_id // 7 AS grp, count(*) AS rows, row_number() OVER (ORDER BY count(*) DESC, sha256('13007|' || (doc_id // 7)), doc_id // 7) AS k FROM d GROUP BY 1),
    f(k, a, b, c, fold) AS (
        SELECT 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, -1
        UNION ALL SELECT k, a + CASE WHEN fold = 0 THEN rows ELSE 0 END, b + CASE WHEN fold = 1 THEN rows ELSE 0 END, c + CASE WHEN fold = 2 THEN rows ELSE 0 END, fold
        FROM (SELECT g.k, rows, a, b, c, CASE WHEN a <= b AND a <= c THEN 0 WHEN b <= c THEN 1 ELSE 2 END AS fold FROM f JOIN g ON g.k = f.k + 1)
    )
    SELECT grp, rows, CAST(fold AS INTEGER) AS fold FROM f JOIN g USING (k)
""")
def m_group_folds(spark, sf_dir):
    return models.group_folds(scored(spark, sf_dir).withColumn("grp", F.expr("doc_id div 7")), "grp")


LOGITS = "z AS (SELECT 'all' AS k, d.*, quality AS y, ln(greatest(1e-6, least(1 - 1e-6, p)) / (1 - greatest(1e-6, least(1 - 1e-6, p)))) AS z FROM d)"


def grid_sql(source: str = "z", rounds: int = 6, points: int = 17) -> str:
    """CTEs t0 to t6 (k, a, b): per key, the bracket of the log temperature of `source` (k, y, z), narrowed round by round."""
    out = [f"t0 AS (SELECT DISTINCT k, -5.0::DOUBLE AS a, 5.0::DOUBLE AS b FROM {source})"]
    for r in range(rounds):
        place = f"(a + (b - a) * i / {points - 1})"
        out.append(f"g{r} AS (SELECT k, a, b, i, avg(ln(1 + exp(-abs(z / exp({place})))) + greatest(z / exp({place}), 0) - y * z / exp({place})) AS loss FROM {source} JOIN t{r} USING (k), range(0, {points}) AS x(i) GROUP BY ALL)")
        out.append(f"b{r} AS (SELECT k, a, b, i FROM g{r} QUALIFY row_number() OVER (PARTITION BY k ORDER BY loss, i) = 1)")
        out.append(f"t{r + 1} AS (SELECT k, a + (b - a) * greatest(0, i - 1) / {points - 1} AS a, a + (b - a) * least({points - 1}, i + 1) / {points - 1} AS b FROM b{r})")
    return ", ".join(out)


def newton_sql(source: str = "z", rounds: int = 25) -> str:
    """CTEs n0 to n25 (k, a, b): per key, slope and intercept of the logistic regression of `source`, one Newton step of bounded length each."""
    out = [f"n0 AS (SELECT k, 1.0::DOUBLE AS a, 0.0::DOUBLE AS b, min(y) = max(y) AS one FROM {source} GROUP BY k)"]
    for r in range(rounds):
        sums = "sum((q - y) * z) + a AS ga, sum(q - y) AS gb, sum(q * (1 - q) * z * z) + 1 AS haa, sum(q * (1 - q) * z) AS hab, sum(q * (1 - q)) AS hbb"
        out.append(f"m{r} AS (SELECT k, a, b, one, {sums} FROM (SELECT k, a, b, one, z, y, 1 / (1 + exp(-greatest(-40, least(40, a * z + b)))) AS q FROM {source} JOIN n{r} USING (k)) GROUP BY k, a, b, one)")
        out.append(f"e{r} AS (SELECT k, a, b, one, CASE WHEN one THEN 0 ELSE coalesce((hbb * ga - hab * gb) / nullif(haa * hbb - hab * hab, 0), 0) END AS da, CASE WHEN one THEN 0 ELSE coalesce((haa * gb - hab * ga) / nullif(haa * hbb - hab * hab, 0), 0) END AS db FROM m{r})")
        out.append(f"n{r + 1} AS (SELECT k, a - da * least(1, {models.STRIDE} / greatest(abs(da) + abs(db), 1e-300)) AS a, b - db * least(1, {models.STRIDE} / greatest(abs(da) + abs(db), 1e-300)) AS b, one FROM e{r})")
    return ", ".join(out)


def isotonic_sql(source: str = "z") -> str:
    """CTE v (k, x, value): the isotonic fit of `source` (k, p, y) at its points: the greatest, over first points, of the least mean up to any last point."""
    return f"""
        w AS (SELECT k, p AS x, sum(y) AS total, count(*) AS n FROM {source} GROUP BY ALL), c AS (SELECT *, row_number() OVER o AS i, sum(total) OVER o AS st, sum(n) OVER o AS sn FROM w WINDOW o AS (PARTITION BY k ORDER BY x)),
        j AS (SELECT a.k, a.i AS a, z.i AS z, (z.st - a.st + a.total) / (z.sn - a.sn + a.n)::DOUBLE AS mean FROM c a JOIN c z ON a.k = z.k AND z.i >= a.i), l AS (SELECT k, a, z, min(mean) OVER (PARTITION BY k, a ORDER BY z DESC) AS low FROM j),
        v AS (SELECT c.k, c.x, max(low) AS value FROM l JOIN c ON c.k = l.k AND c.i = l.z GROUP BY c.k, c.x)"""


LOGISTIC = "1 / (1 + exp(-greatest(-40, least(40, {x}))))"


@register(f"""
    WITH {SCORED}, {LOGITS}, {grid_sql()}, {newton_sql()}, {isotonic_sql()}
    SELECT doc_id, p, round({LOGISTIC.format(x="z / exp((t6.a + t6.b) / 2)")}, 4) AS temperature, round({LOGISTIC.format(x="n25.a * z + n25.b")}, 5) AS platt, round(value, 6) AS isotonic
    FROM z JOIN t6 USING (k) JOIN n25 USING (k) JOIN v ON v.k = z.k AND v.x = z.p
""")
def m_calibrated(spark, sf_dir):
    """Each document's score under the three calibrations, fitted on all labelled documents."""
    d = stash(scored(spark, sf_dir).select("doc_id", "p", "quality"), "scored")
    out = d
    for method in models.METHODS:
        out = models.calibrate(out, "p", method, models.fit_calibrator(d, "p", "quality", method), method)
    return out.select("doc_id", "p", rounded("temperature", 4).alias("temperature"), rounded("platt", 5).alias("platt"), rounded("isotonic").alias("isotonic"))


#: Groups of seven documents dealt to three folds, largest first, each to the fold with the fewest rows.
FOLDS = """
    gs AS (SELECT doc_id // 7 AS grp, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, sha256('13007|' || (doc_id // 7)), doc_id // 7) AS r FROM d GROUP BY 1),
    fo(r, grp, fold, a, b, c) AS (
        SELECT 0::BIGINT, -1::BIGINT, -1, 0::BIGINT, 0::BIGINT, 0::BIGINT
        UNION ALL SELECT r, grp, f, CASE WHEN f = 0 THEN a + n ELSE a END, CASE WHEN f = 1 THEN b + n ELSE b END, CASE WHEN f = 2 THEN c + n ELSE c END FROM
            (SELECT gs.r, gs.grp, gs.n, fo.a, fo.b, fo.c, CASE WHEN fo.a <= fo.b AND fo.a <= fo.c THEN 0 WHEN fo.b <= fo.c THEN 1 ELSE 2 END AS f FROM fo JOIN gs ON gs.r = fo.r + 1)
    )"""


@register(f"""
    WITH RECURSIVE {SCORED}, {FOLDS}, {LOGITS}, zf AS (SELECT z.*, fold FROM z JOIN fo ON grp = doc_id // 7), tr AS MATERIALIZED (SELECT h AS k, p, y, z FROM zf, range(0, 3) AS x(h) WHERE fold <> h),
    {grid_sql("tr")}, {newton_sql("tr")}, {isotonic_sql("tr")},
    te AS (SELECT fold AS k, p, y, {LOGISTIC.format(x="z / exp((t6.a + t6.b) / 2)")} AS temperature, {LOGISTIC.format(x="n25.a * z + n25.b")} AS platt FROM zf JOIN t6 ON t6.k = fold JOIN n25 ON n25.k = fold),
    lo AS (SELECT te.*, v.x AS x0, v.value AS y0 FROM te ASOF LEFT JOIN v ON te.k = v.k AND te.p >= v.x), hi AS (SELECT lo.*, v.x AS x1, v.value AS y1 FROM lo ASOF LEFT JOIN v ON lo.k = v.k AND lo.p <= v.x),
    ev AS (SELECT k, avg(pow(temperature - y, 2)) AS t, avg(pow(platt - y, 2)) AS q, avg(pow(CASE WHEN x0 IS NULL THEN y1 WHEN x1 IS NULL OR x0 = p THEN y0 ELSE y0 + (y1 - y0) * (p - x0) / (x1 - x0) END - y, 2)) AS i FROM hi GROUP BY k),
    me AS (SELECT unnest([{{'m': 'temperature', 'b': avg(t)}}, {{'m': 'platt', 'b': avg(q)}}, {{'m': 'isotonic', 'b': avg(i)}}]) AS r FROM ev)
    SELECT r.m AS method, round(r.b, 5) AS brier, r.b = min(r.b) OVER () AS selected FROM me
""")
def m_calibrator_choice(spark, sf_dir):
    """Mean Brier score of each calibration over three folds of whole groups, and which is chosen."""
    method, _, losses = models.select_calibrator(scored(spark, sf_dir).withColumn("grp", F.expr("doc_id div 7")), "p", "quality", "grp")
    return spark.createDataFrame([(m, round(b, 5), m == method) for m, b in losses.items()], "method string, brier double, selected boolean")


@register("""
    WITH n AS (SELECT conv_id, turn // 2 AS step, role, least(1.0::DOUBLE, length(text) / 800.0::DOUBLE) AS p, ln(1 + exp(CASE role WHEN 'user' THEN 0.5 WHEN 'assistant' THEN -0.25 ELSE 0 END)) AS w FROM conversations),
    l AS (SELECT *, ln(greatest(1e-6, least(1 - 1e-6, p)) / (1 - greatest(1e-6, least(1 - 1e-6, p)))) AS z FROM n)
    SELECT conv_id, step, round(coalesce(1 / (1 + exp(-greatest(-40, least(40, sum(w * z) FILTER (role <> 'system') / sum(w) FILTER (role <> 'system') + 0.1)))), 0.5), 6) AS fused, count(*) FILTER (role <> 'system') AS nodes, count(*) FILTER (role <> 'system') = 0 AS abstained FROM l GROUP BY ALL
""")
def m_logit_fusion(spark, sf_dir):
    n = table(spark, sf_dir, "conversations").select("conv_id", F.expr("turn div 2").alias("step"), "role", F.least(F.lit(1.0), F.length("text") / 800).alias("p"), (F.col("role") != "system").alias("available"))
    return models.logit_fusion(n, ["conv_id", "step"], "role", "p", "available", {"user": 0.5, "assistant": -0.25}, 0.1).withColumn("fused", rounded("fused"))


@register(f"WITH {SCORED} SELECT lang, round(avg(pow(p - (1 - abs(quality - p)), 2)) FILTER (toxic = 0), 6) AS loss, count(*) FILTER (toxic = 0) AS n FROM d GROUP BY lang")
def m_reliability_loss(spark, sf_dir):
    d = scored(spark, sf_dir).withColumn("available", F.col("toxic") == 0)
    return d.groupBy("lang").agg(rounded(models.reliability_loss("p", "quality", "p", "available")).alias("loss"), F.count_if("available").alias("n"))


def boxes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Order lines as boxes of their order: odd lines annotated, even lines detected, flags as concepts."""
    w, h = 10 + F.col("l_quantity"), 10 + F.col("l_suppkey") % 17
    x, y = (F.col("l_orderkey") * 7 + F.expr("l_linenumber div 2") * 3) % 20, (F.col("l_partkey") % 20).cast("double")
    b = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("record"), F.col("l_returnflag").alias("concept"), F.col("l_linenumber").alias("n"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("id"), x.cast("double").alias("x1"), y.alias("y1"), (x + w).cast("double").alias("x2"), (y + h).cast("double").alias("y2"),
        (((F.col("l_partkey") * 31 + F.col("l_linenumber")) % 1000) / 1000).alias("score"),
    )
    return b.where("n % 2 = 1").withColumnRenamed("id", "box_id").drop("score", "n"), b.where("n % 2 = 0").withColumnRenamed("id", "detection_id").drop("n")


BOXES = """
    b AS (SELECT l_orderkey AS record, l_returnflag AS concept, l_linenumber AS n, l_partkey * 10 + l_linenumber AS id, ((l_orderkey * 7 + (l_linenumber // 2) * 3) % 20)::DOUBLE AS x1, (l_partkey % 20)::DOUBLE AS y1, 10 + l_quantity AS w, (10 + l_suppkey % 17)::DOUBLE AS h,
        ((l_partkey * 31 + l_linenumber) % 1000) / 1000.0::DOUBLE AS score FROM lineitem),
    o AS (SELECT p.record, p.concept, p.id AS detection_id, t.id AS box_id, p.score, greatest(0, least(p.x1 + p.w, t.x1 + t.w) - greatest(p.x1, t.x1)) * greatest(0, least(p.y1 + p.h, t.y1 + t.h) - greatest(p.y1, t.y1)) AS i, p.w * p.h + t.w * t.h AS a
        FROM b p JOIN b t ON p.record = t.record AND p.concept = t.concept AND p.n % 2 = 0 AND t.n % 2 = 1)
"""


@register(f"WITH {BOXES} SELECT record, concept, detection_id, box_id, score, round(i / (a - i), 6) AS iou FROM o WHERE i > 0 AND i / (a - i) >= 0.3")
def d_box_pairs(spark, sf_dir):
    truth, predicted = boxes(spark, sf_dir)
    return detection.box_pairs(truth, predicted, ["record", "concept"], 0.3).withColumn("iou", rounded("iou"))


OVERLAPS = [round(0.5 + 0.05 * k, 2) for k in range(10)]
AP = f"""
    WITH RECURSIVE {BOXES}, h AS (SELECT unnest(range(50, 100, 5)) / 100.0::DOUBLE AS threshold),
    y AS (SELECT concept, threshold, record, detection_id, any_value(score) AS score, list(box_id ORDER BY i / (a - i) DESC, box_id) AS boxes FROM o, h WHERE i / (a - i) >= threshold GROUP BY concept, threshold, record, detection_id),
    k AS (SELECT *, row_number() OVER (PARTITION BY concept, threshold, record ORDER BY score DESC, detection_id) AS k FROM y),
    m(concept, threshold, record, k, detection_id, used, box) AS (
        SELECT DISTINCT concept, threshold, record, 0::BIGINT, -1::BIGINT, []::BIGINT[], NULL::BIGINT FROM k
        UNION ALL SELECT k.concept, k.threshold, k.record, k.k, k.detection_id, CASE WHEN len(list_filter(k.boxes, lambda b: NOT list_contains(m.used, b))) > 0 THEN list_append(m.used, list_filter(k.boxes, lambda b: NOT list_contains(m.used, b))[1]) ELSE m.used END, list_filter(k.boxes, lambda b: NOT list_contains(m.used, b))[1]
        FROM m JOIN k ON k.concept = m.concept AND k.threshold = m.threshold AND k.record = m.record AND k.k = m.k + 1
    ),
    d AS (SELECT concept, threshold, score, record, id AS detection_id FROM b, h WHERE n % 2 = 0),
    f AS (SELECT d.*, CASE WHEN m.box IS NULL THEN 0 ELSE 1 END AS tp FROM d LEFT JOIN m ON m.concept = d.concept AND m.threshold = d.threshold AND m.record = d.record AND m.detection_id = d.detection_id AND m.box IS NOT NULL),
    c AS (SELECT *, sum(tp) OVER w / count(*) OVER w::DOUBLE AS precision FROM f WINDOW w AS (PARTITION BY concept, threshold ORDER BY score DESC, record, detection_id ROWS UNBOUNDED PRECEDING)),
    e AS (SELECT *, max(precision) OVER (PARTITION BY concept, threshold ORDER BY score DESC, record, detection_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS best FROM c),
    t AS (SELECT concept, count(*) AS truths FROM b WHERE n % 2 = 1 GROUP BY concept),
    ap AS (SELECT concept, threshold, truths, CAST(sum(tp) AS BIGINT) AS tp, CAST(count(*) - sum(tp) AS BIGINT) AS fp, CAST(truths - sum(tp) AS BIGINT) AS missed, sum(tp * best) / truths AS ap FROM e JOIN t USING (concept) GROUP BY concept, threshold, truths)
"""


@register(AP + "SELECT concept, threshold, truths, tp, fp, missed, round(ap, 6) AS ap FROM ap")
def d_average_precision(spark, sf_dir):
    truth, predicted = boxes(spark, sf_dir)
    return detection.detection_precision(truth, predicted, "record", "concept", OVERLAPS).withColumn("ap", rounded("ap"))


@register(AP + """, p AS (SELECT concept, any_value(truths) AS truths, max(tp) FILTER (threshold = 0.5) AS tp, max(fp) FILTER (threshold = 0.5) AS fp, max(missed) FILTER (threshold = 0.5) AS missed, max(ap) FILTER (threshold = 0.5) AS ap50, avg(ap) AS ap50_95 FROM ap GROUP BY concept)
    SELECT concept, truths, tp, fp, missed, round(ap50, 6) AS ap50, round(ap50_95, 6) AS ap50_95 FROM p
    UNION ALL SELECT NULL, CAST(sum(truths) AS BIGINT), CAST(sum(tp) AS BIGINT), CAST(sum(fp) AS BIGINT), CAST(sum(missed) AS BIGINT), round(avg(ap50), 6), round(avg(ap50_95), 6) FROM p
""")
def d_detection_summary(spark, sf_dir):
    truth, predicted = boxes(spark, sf_dir)
    out = detection.detection_summary(detection.detection_precision(truth, predicted, "record", "concept", OVERLAPS), "concept")
    return out.withColumns({c: rounded(c) for c in ("ap50", "ap50_95")})


@register("""
    WITH s AS (SELECT l_orderkey AS record, l_returnflag AS concept, max(((l_partkey * 31 + l_linenumber) % 1000) / 1000.0::DOUBLE) AS score FROM lineitem WHERE l_linenumber % 2 = 0 GROUP BY ALL)
    SELECT record, concept, coalesce(score, 0) AS score FROM (SELECT r.record, c.concept FROM (SELECT DISTINCT l_orderkey AS record FROM lineitem) r, (SELECT unnest(['A', 'N', 'R']) AS concept) c) LEFT JOIN s USING (record, concept)
""")
def d_concept_scores(spark, sf_dir):
    _, predicted = boxes(spark, sf_dir)
    records = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("record"))
    return detection.concept_scores(predicted, records, "record", "concept", ["A", "N", "R"])


@register("""
    WITH s AS (SELECT DISTINCT l_orderkey AS record, l_returnflag AS concept, 1 AS t FROM lineitem WHERE l_linenumber % 2 = 1)
    SELECT record, concept, coalesce(t, 0) AS concept_truth FROM (SELECT r.record, c.concept FROM (SELECT DISTINCT l_orderkey AS record FROM lineitem) r, (SELECT unnest(['A', 'N', 'R']) AS concept) c) LEFT JOIN s USING (record, concept)
""")
def d_concept_presence(spark, sf_dir):
    truth, _ = boxes(spark, sf_dir)
    records = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("record"))
    return detection.concept_presence(truth, records, "record", "concept", ["A", "N", "R"])
