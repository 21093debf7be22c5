"""Queries over documents, labels, embeddings and conversations: splits, duplicates, episodes."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import hex_boundaries, rounded
from plumbline.operators import dedup, episodes, events, selection, splits
from plumbline.plans.catalogue import register
from plumbline.plans.oracles import SUMMARY, greedy, islands
from plumbline.sources.tables import table

SEED = 13007


def _pool_case(h: str, weights: dict[str, float]) -> str:
    names = sorted(weights)
    bounds = hex_boundaries([weights[n] for n in names])
    return "CASE " + " ".join(f"WHEN {h} < '{b}' THEN '{n}'" for n, b in zip(names, bounds, strict=False)) + f" ELSE '{names[-1]}' END"


@register(f"SELECT doc_id, source, {_pool_case(f'''sha256('{SEED}|' || lang || '|' || source)''', splits.BRANCH)} AS pool FROM documents")
def e_hash_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return splits.assign_by_hash(docs, ["lang", "source"], splits.BRANCH, SEED).select("doc_id", "source", "pool")


@register(f"""
    WITH c AS (SELECT DISTINCT conv_id AS c FROM conversations), r AS (SELECT c, row_number() OVER (ORDER BY sha256('{SEED}|' || c), c) AS rank FROM c)
    SELECT c AS conv_id, rank FROM r
""")
def e_hash_ranks(spark, sf_dir):
    convs = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    return splits.hash_rank(convs, ["conv_id"], SEED).select("conv_id", "rank")


def _slots_sql(dataset: str, n: str, weights: dict[str, float]) -> str:
    """CTE q (pool, k): quotas of `n` components by largest remainder, where every pool gets one at least."""
    table = ", ".join(f"('{p}', {round(w * 100)})" for p, w in sorted(weights.items()))
    return f"""
        v AS (SELECT pool, {n} * w // 100 AS base, {n} * w % 100 AS rest FROM (VALUES {table}) AS x(pool, w)),
        q AS (SELECT pool, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, sha256('{SEED}|{dataset}|quota-remainder|' || pool)) <= {n} - sum(base) OVER () THEN 1 ELSE 0 END AS k FROM v)"""


@register(f"""
    WITH c AS (SELECT conv_id, row_number() OVER (ORDER BY sha256('{SEED}|chat|component|' || conv_id), conv_id) AS r FROM (SELECT DISTINCT conv_id FROM conversations)),
    {_slots_sql("chat", "(SELECT count(*) FROM c)", splits.EPISODE)},
    s AS (SELECT pool, row_number() OVER (ORDER BY sha256('{SEED}|chat|slot|' || pool || '|' || j), pool, j) AS r FROM (SELECT pool, unnest(range(0, CAST(k AS BIGINT))) AS j FROM q))
    SELECT conv_id, pool FROM c JOIN s USING (r)
""")
def e_quota_pools(spark, sf_dir):
    chats = table(spark, sf_dir, "conversations").select("conv_id", F.lit("chat").alias("dataset"))
    return splits.assign_components(chats, "conv_id", "dataset", splits.EPISODE, SEED)


@register(f"""
    WITH RECURSIVE g AS (SELECT DISTINCT sha256(text) AS h, doc_id // 4 AS grp FROM documents), e AS (SELECT DISTINCT a.grp AS a, b.grp AS b FROM g a JOIN g b ON a.h = b.h),
    r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
    c AS (SELECT a AS grp, min(b) AS component FROM r GROUP BY a),
    m AS (SELECT DISTINCT component, lang FROM documents JOIN c ON grp = doc_id // 4), n AS (SELECT lang, count(*) AS n FROM m GROUP BY lang),
    v AS (SELECT lang, n, pool, n * w // 100 AS base, n * w % 100 AS rest FROM n, (VALUES {", ".join(f"('{p}', {round(w * 100)})" for p, w in sorted(splits.EPISODE.items()))}) AS x(pool, w))
    SELECT lang, pool, CAST(base + CASE WHEN row_number() OVER (PARTITION BY lang ORDER BY rest DESC, sha256('{SEED}|' || lang || '|quota-remainder|' || pool)) <= n - sum(base) OVER (PARTITION BY lang) THEN 1 ELSE 0 END AS BIGINT) AS components FROM v
""")
def e_component_pools(spark, sf_dir):
    """Groups of documents that share contents, in one language or more, over the pools so that every language's quotas hold."""
    records = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("h"), F.expr("doc_id div 4").alias("grp"), "lang")
    groups = dedup.group_components(records.select("h", "grp"), "h", "grp")
    membership = records.select("grp", "lang").distinct().join(groups, "grp").select("component", "lang")
    pools = splits.assign_components(membership, "component", "lang", splits.EPISODE, SEED)
    return membership.distinct().join(pools, "component").groupBy("lang", "pool").agg(F.count("*").alias("components"))


TIME_ORDER = ("tr", "sel", "prob", "te")
DAYS = f"""
    WITH d AS (SELECT strftime(ts, '%Y-%m-%d') AS day, min(CAST(epoch(date_trunc('day', ts)) AS BIGINT)) AS first_second FROM events GROUP BY 1), c AS (SELECT *, row_number() OVER (ORDER BY day) AS place FROM d),
    {_slots_sql("events:temporal_cohorts", "(SELECT count(*) FROM c)", splits.BRANCH)},
    b AS (SELECT pool, sum(k) OVER (ORDER BY list_position(['tr', 'sel', 'prob', 'te'], pool)) AS last_place, k FROM q),
    a AS (SELECT day, first_second, place, pool FROM c JOIN b ON place <= last_place AND place > last_place - k)
"""


@register(DAYS + "SELECT day, place, pool FROM a")
def e_time_pools(spark, sf_dir):
    days = table(spark, sf_dir, "events").select(F.to_date("ts").cast("string").alias("day"))
    return splits.assign_by_time(days, "day", TIME_ORDER, splits.BRANCH, SEED, "events")


@register(DAYS + """, f AS (SELECT * FROM (VALUES ('branch', 'tr', 0), ('branch', 'sel', 1), ('branch', 'te', 2), ('calibration', 'sel', 0), ('calibration', 'prob', 1), ('calibration', 'te', 2)) AS x(family, pool, ordinal)),
    k AS (SELECT family, pool, CAST(ordinal AS INTEGER) AS ordinal, min(first_second) AS "first", max(first_second) AS "last", count(*) AS cohorts FROM f JOIN a USING (pool) GROUP BY ALL),
    g AS (SELECT *, CAST("first" - (lag("last") OVER (PARTITION BY family ORDER BY ordinal) + 86400) AS BIGINT) AS gap FROM k)
    SELECT *, coalesce(gap >= 86400, true) AS purged FROM g
""")
def v_pool_blocks(spark, sf_dir):
    """Whether a day at least lies between the pools of a family."""
    days = table(spark, sf_dir, "events").select(F.to_date("ts").cast("string").alias("day"))
    placed = splits.assign_by_time(days, "day", TIME_ORDER, splits.BRANCH, SEED, "events").withColumn("first_second", F.unix_date(F.col("day").cast("date")).cast("long") * 86400)
    return splits.pool_blocks(placed, "first_second", 86400, {"branch": ("tr", "sel", "te"), "calibration": ("sel", "prob", "te")}, 86400)


@register(f"""
    WITH p AS (SELECT lang, source, count(*) FILTER (quality = 1) AS positives, count(*) AS rows FROM documents JOIN labels USING (doc_id) WHERE {_pool_case(f"sha256('{SEED}|' || lang || '|' || source)", splits.BRANCH)} = 'tr' GROUP BY lang, source),
    s AS (SELECT p.*, seed FROM p, (SELECT unnest([5171, 6197, 7331]) AS seed)),
    r AS (SELECT *, row_number() OVER (PARTITION BY lang, seed ORDER BY sha256('0|' || seed || '|' || lang || '|' || source), source) AS rn, count(*) OVER (PARTITION BY lang, seed) AS n FROM s)
    SELECT lang, source, seed, positives, rows FROM r WHERE rn <= greatest(1, CAST(ceil(n * 0.1) AS BIGINT))
""")
def e_few_shot(spark, sf_dir):
    labelled = table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    pooled = splits.assign_by_hash(labelled, ["lang", "source"], splits.BRANCH, SEED)
    return splits.few_shot(pooled, "lang", "source", "quality", [5171, 6197, 7331], pool="pool").select("lang", "source", "seed", "positives", "rows")


@register("""
    WITH d AS (SELECT DISTINCT CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS start FROM events WHERE event_type = 'error' AND value >= 200), n AS (SELECT start, lead(start) OVER (ORDER BY start) AS "next" FROM d)
    SELECT start, "next", ("next" - start) / 86400.0::DOUBLE - 1 AS missing FROM n WHERE "next" - start <> 86400
""")
def v_cohort_gaps(spark, sf_dir):
    """Days without a high error, between days with one."""
    e = table(spark, sf_dir, "events").where("event_type = 'error' and value >= 200")
    return splits.cohort_gaps(e.select((F.unix_date(F.to_date("ts")).cast("long") * 86400).alias("start")), "start", 86400)


@register(f"SELECT doc_id, CASE WHEN sha256('7|' || source || '|' || (doc_id // 10)) < '{hex_boundaries([0.2, 0.8])[0]}' THEN 'val' ELSE 'train' END AS split FROM documents")
def e_group_holdout(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.expr("doc_id div 10").alias("block"))
    return splits.holdout(docs, ["source", "block"], 7, 0.2).select("doc_id", "split")


@register("""
    WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('1701|' || doc_id), doc_id) AS rn FROM documents) SELECT doc_id, source FROM r WHERE rn <= 5
""")
def e_source_sample(spark, sf_dir):
    return selection.hash_sample(table(spark, sf_dir, "documents").select("doc_id", "source"), ["source"], ["doc_id"], 1701, n=5)


@register("""
    SELECT conv_id, count(*) AS rows, count(*) = 2 AND count(*) FILTER (role = 'user') = 1 AND count(*) FILTER (role = 'assistant') = 1 AS complete, count(DISTINCT conv_id // 10) = 1 AS one_group, count(DISTINCT turn % 2) = 1 AS one_pool
    FROM conversations GROUP BY conv_id
""")
def e_pair_audit(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "role", F.expr("conv_id div 10").alias("g"), (F.col("turn") % 2).alias("pool"))
    return splits.pair_audit(c, "conv_id", "role", ("user", "assistant"), "g", "pool")


@register("SELECT sha256(text) AS h, min(doc_id) AS representative, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1")
def e_exact_duplicates(spark, sf_dir):
    return dedup.exact_classes(table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h")), "h", "doc_id").where("copies > 1")


BITS = "(SELECT bit_or(CASE WHEN embedding[i] > 0 THEN CASE WHEN i = 64 THEN (-9223372036854775808)::BIGINT ELSE (1::BIGINT << (i - 1)::INTEGER) END ELSE 0::BIGINT END) FROM range(1, 65) AS t(i))"


@register(f"SELECT vec_id, {BITS} AS bits FROM embeddings")
def c_sign_bits(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", dedup.sign_bits("embedding").alias("bits"))


COARSE = "(SELECT bit_or(CASE WHEN list_sum(embedding[4 * i + 1:4 * i + 4]::DOUBLE[]) > 0 THEN 1::BIGINT << (4 * i)::INTEGER ELSE 0::BIGINT END) FROM range(0, 16) AS t(i))"


#: 64 bits of which neighbours tell much the same: vectors without near copies have pairs within 4 bits, though few.
FINE = "(SELECT bit_or(CASE WHEN list_sum(list_slice(embedding || embedding, i + 1, i + 16)::DOUBLE[]) > list_sum(list_slice(embedding || embedding, i + 17, i + 32)::DOUBLE[]) THEN CASE WHEN i = 63 THEN (-9223372036854775808)::BIGINT ELSE (1::BIGINT << i::INTEGER) END ELSE 0::BIGINT END) FROM range(0, 64) AS t(i))"
RADIUS = 4


@register(f"""
    WITH b AS (SELECT vec_id, {FINE} AS bits FROM embeddings), c AS (SELECT bits, min(vec_id) AS id FROM b GROUP BY bits)
    SELECT l.id AS left_id, r.id AS right_id, CAST(bit_count(xor(l.bits, r.bits)) AS INTEGER) AS distance FROM c l JOIN c r ON l.id < r.id AND bit_count(xor(l.bits, r.bits)) <= {RADIUS}
""")
def j_hamming_pairs(spark, sf_dir):
    bits = table(spark, sf_dir, "embeddings").select("vec_id", dedup.difference_bits("embedding").alias("bits"))
    classes = dedup.exact_classes(bits, "bits", "vec_id").select(F.col("representative").alias("id"), "bits")
    return dedup.hamming_pairs(classes, "id", "bits", RADIUS)


NEAR = f"""
    b AS (SELECT vec_id, label % 2 AS half, {FINE} AS bits, {COARSE} AS coarse FROM embeddings), c AS (SELECT half, bits, min(vec_id) AS id FROM b GROUP BY half, bits),
    l AS (SELECT l.id AS left_id, r.id AS right_id, CAST(bit_count(xor(l.bits, r.bits)) AS INTEGER) AS distance FROM c l JOIN c r ON l.half = r.half AND l.id < r.id AND bit_count(xor(l.bits, r.bits)) <= {RADIUS})
"""


def near_pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Vectors with their bits, and near pairs of their classes; pairs must agree in the half of the labels they belong to."""
    bits = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("label") % 2).alias("half"), dedup.difference_bits("embedding").alias("bits"), dedup.coarse_bits("embedding").alias("coarse"))
    classes = bits.groupBy("half", "bits").agg(F.min("vec_id").alias("id"))
    return bits, dedup.hamming_pairs(classes, "id", "bits", RADIUS, ["half"])


@register(f"WITH {NEAR}, x AS (SELECT half, coarse, min(vec_id) AS id FROM b GROUP BY half, coarse) SELECT 'exact' AS kind, x.id AS left_id, b.vec_id AS right_id, 0 AS distance FROM b JOIN x USING (half, coarse) WHERE b.vec_id <> x.id UNION ALL SELECT 'near', left_id, right_id, distance FROM l")
def e_duplicate_audit(spark, sf_dir):
    """Exact copies as links to their class's first, near pairs between classes of one half."""
    bits, near = near_pairs(spark, sf_dir)
    return dedup.duplicate_audit(bits, "vec_id", ["half", "coarse"], near)


@register(f"""
    WITH RECURSIVE {NEAR}, k AS (SELECT *, row_number() OVER (ORDER BY distance, left_id, right_id) AS k FROM l), z AS (SELECT left_id AS x, right_id AS y, k FROM k UNION ALL SELECT right_id, left_id, k FROM k),
    r(k, x) AS (SELECT k, left_id FROM k UNION SELECT r.k, z.y FROM r JOIN z ON z.x = r.x AND z.k < r.k)
    SELECT left_id, right_id, distance FROM k WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.k = k.k AND r.x = k.right_id)
""")
def e_spanning_edges(spark, sf_dir):
    """Near links, nearest first, that each join two components not yet joined."""
    bits, near = near_pairs(spark, sf_dir)
    classes = bits.groupBy("half", "bits").agg(F.min("vec_id").alias("id")).select("id", F.col("id").alias("component"))
    return dedup.spanning_edges(near, classes, "id")


@register("""
    WITH RECURSIVE g AS (SELECT DISTINCT sha256(text) AS h, doc_id // 8 AS grp FROM documents), e AS (SELECT DISTINCT a.grp AS a, b.grp AS b FROM g a JOIN g b ON a.h = b.h),
    r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
    SELECT a AS grp, min(b) AS component FROM r GROUP BY a
""")
def e_group_components(spark, sf_dir):
    records = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("h"), F.expr("doc_id div 8").alias("grp"))
    return dedup.group_components(records, "h", "grp")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as episodes: a step's probability follows its text's length, system turns abstain."""
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", F.least(F.lit(1.0), F.length("text") / 800).alias("p"), (F.col("role") == "system").alias("abstain"), (F.length("text") > 600).cast("int").alias("truth"))


STATES = """
    WITH RECURSIVE t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, turn, least(1.0::DOUBLE, length(text) / 800.0::DOUBLE) AS p, role = 'system' AS ab FROM conversations),
    s(conv_id, k, m, run, armed, lvl, ab) AS (
        SELECT DISTINCT conv_id, 0::BIGINT, 0.0::DOUBLE, 0, 0, 0, false FROM t
        UNION ALL
        SELECT conv_id, k, CASE WHEN ab THEN m0 ELSE m END, CASE WHEN ab THEN run0 ELSE run END, CASE WHEN ab THEN armed0 ELSE armed END,
            CASE WHEN ab THEN lvl0 ELSE greatest(CASE WHEN lvl0 >= 2 AND m >= 0.3 THEN lvl0 ELSE 0 END, CASE WHEN armed >= 2 THEN 3 WHEN run >= 2 THEN 2 WHEN m >= 0.3 THEN 1 ELSE 0 END) END, ab
        FROM (SELECT *, CASE WHEN m >= 0.6 THEN run0 + 1 ELSE 0 END AS run, CASE WHEN m >= 0.8 THEN armed0 + 1 ELSE 0 END AS armed FROM
            (SELECT t.conv_id, t.k, t.ab, s.m AS m0, s.run AS run0, s.armed AS armed0, s.lvl AS lvl0, 0.7::DOUBLE * s.m + (1 - 0.7::DOUBLE) * t.p AS m FROM s JOIN t ON t.conv_id = s.conv_id AND t.k = s.k + 1))
    )
    SELECT t.conv_id, CAST(t.turn AS BIGINT) AS turn, round(s.m, 6) AS memory, CASE WHEN t.ab THEN 'abstain' ELSE (['normal', 'attention', 'prewarning', 'alarm'])[s.lvl + 1] END AS state FROM s JOIN t USING (conv_id, k)
"""
POLICY = episodes.Policy(beta=0.7, k=2, low=0.3, high=0.6, alarm=0.8)


@register(STATES)
def e_alarm_states(spark, sf_dir):
    out = episodes.policy_states(turns(spark, sf_dir), ["conv_id"], "turn", "p", F.col("abstain"), POLICY)
    return out.select("conv_id", "turn", rounded("memory").alias("memory"), "state")


#: CTEs k (step states by unit u) and r (their units), of policies pol (id, beta, mem, low, high, al, ab) over all conversations; `off` says where a step abstains.
EPISODE_STATES = """
    st AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, turn, least(1.0::DOUBLE, length(text) / 800.0::DOUBLE) AS p, role, length(text) > 600 AS truth FROM conversations),
    tt AS (SELECT pol.id || '/' || conv_id AS u, pol.*, conv_id, k, turn, p, truth, {off} AS off FROM st, pol),
    sm(u, k, m, run, armed, lvl) AS (
        SELECT DISTINCT u, 0::BIGINT, 0.0::DOUBLE, 0, 0, 0 FROM tt
        UNION ALL
        SELECT u, k, CASE WHEN off THEN m0 ELSE m END, CASE WHEN off THEN run0 ELSE run END, CASE WHEN off THEN armed0 ELSE armed END,
            CASE WHEN off THEN lvl0 ELSE greatest(CASE WHEN lvl0 >= 2 AND m >= low THEN lvl0 ELSE 0 END, CASE WHEN armed >= mem THEN 3 WHEN run >= mem THEN 2 WHEN m >= low THEN 1 ELSE 0 END) END
        FROM (SELECT *, CASE WHEN m >= high THEN run0 + 1 ELSE 0 END AS run, CASE WHEN m >= al THEN armed0 + 1 ELSE 0 END AS armed FROM
            (SELECT tt.*, sm.m AS m0, sm.run AS run0, sm.armed AS armed0, sm.lvl AS lvl0, tt.beta * sm.m + (1 - tt.beta) * tt.p AS m FROM sm JOIN tt ON tt.u = sm.u AND tt.k = sm.k + 1))
    ),
    k AS (SELECT tt.u, tt.id, tt.conv_id, tt.turn AS pos, 1 AS reach, tt.truth, CASE WHEN tt.off THEN 'abstain' ELSE (['normal', 'attention', 'prewarning', 'alarm'])[sm.lvl + 1] END AS state FROM tt JOIN sm USING (u, k)),
"""
EVALUATED = f"""{islands("t", "k", "truth")}, {islands("p", "k", "state IN ('prewarning', 'alarm')")}, {greedy(0)}, units AS (SELECT DISTINCT u FROM k), {SUMMARY},
    fl AS (SELECT *, coalesce(lag(state) OVER (PARTITION BY u ORDER BY pos) <> state, false) AS flip FROM k),
    sh AS (SELECT u, any_value(id) AS id, any_value(conv_id) AS conv_id, count(*) FILTER (state <> 'abstain') AS answered, count(*) FILTER (flip) AS flips, count(*) AS steps FROM fl GROUP BY u),
    dl AS (SELECT u, sum(ps - ts)::DOUBLE AS delay_total FROM x GROUP BY u)
"""


@register(f"""
    WITH RECURSIVE pol AS (SELECT 'one' AS id, 0.7::DOUBLE AS beta, 2 AS mem, 0.3::DOUBLE AS low, 0.6::DOUBLE AS high, 0.8::DOUBLE AS al), {EPISODE_STATES.format(off="role = 'system'")} {EVALUATED}
    SELECT conv_id, truths, predictions, matched, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round(miss_rate, 6) AS miss_rate, answered, flips, steps, delay_total,
        round(answered / steps::DOUBLE, 6) AS coverage, CASE WHEN matched > 0 THEN round(delay_total / matched, 6) END AS mean_delay FROM c JOIN sh USING (u) LEFT JOIN dl USING (u)
""")
def e_episode_evaluation(spark, sf_dir):
    t = turns(spark, sf_dir)
    states = episodes.policy_states(t, ["conv_id"], "turn", "p", F.col("abstain"), POLICY)
    out = events.episode_evaluation(states.join(t.select("conv_id", "turn", "truth"), ["conv_id", "turn"]), ["conv_id"], "turn", "truth", "state")
    shares = ("precision", "recall", "f1", "miss_rate", "coverage", "mean_delay")
    return out.select("conv_id", "truths", "predictions", "matched", "answered", "flips", "steps", "delay_total", *(rounded(c).alias(c) for c in shares))


def policy_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole policy grid over all episodes: each candidate's coverage, false alarms, misses, F1, delay, flips.

    A step abstains where its confidence, twice its distance from 0.5, is below the policy's. Concepts are two halves of the conversations.
    """
    grid = episodes.policy_grid()
    totals = episodes.policy_totals(turns(spark, sf_dir), ["conv_id"], "turn", "p", F.col("truth") == 1, F.col("conv_id") % 2, grid)
    ranks = spark.createDataFrame([(g["candidate_id"], g["complexity_rank"]) for g in grid], "candidate_id string, complexity_rank int")
    return events.pooled_metrics(totals, ["candidate_id"]).join(ranks, "candidate_id")


GRID = f"""
    WITH RECURSIVE pol0 AS (SELECT beta, mem, low, high, 0.8::DOUBLE AS al, ab / 100.0::DOUBLE AS ab FROM (VALUES (0.7::DOUBLE), (0.85::DOUBLE)) AS b(beta), (VALUES (2), (3)) AS m(mem), (VALUES (0.3::DOUBLE, 0.6::DOUBLE), (0.4::DOUBLE, 0.7::DOUBLE)) AS l(low, high), range(10, 91, 5) AS r(ab)),
    pol AS (SELECT printf('b%.2f_k%d_l%.2f_h%.2f_a%.2f_u%.2f', beta, mem, low, high, al, ab) AS id, *, CAST(row_number() OVER (ORDER BY beta, mem, low, ab) - 1 AS INTEGER) AS rank FROM pol0),
    {EPISODE_STATES.format(off="abs(2 * p - 1) < ab")} {EVALUATED},
    pc AS (SELECT id, conv_id % 2 AS concept, sum(truths) AS truths, sum(predictions) AS predictions, sum(matched) AS matched, sum(answered) AS answered, sum(steps) AS steps, sum(flips) AS flips, sum(delay_total) AS delay, count(*) AS n FROM c JOIN sh USING (u) LEFT JOIN dl USING (u) GROUP BY ALL),
    y AS (
        SELECT id AS candidate_id, sum(answered) / sum(steps)::DOUBLE AS answer_coverage, 100.0 * sum(predictions - matched) / sum(n) AS false_alarms_per_100_episodes, coalesce(1 - sum(matched) / nullif(sum(truths), 0)::DOUBLE, 0) AS event_miss_rate,
            coalesce(avg(2.0::DOUBLE * matched / (truths + predictions)) FILTER (truths > 0), 0) AS event_macro_f1, coalesce(sum(delay) / nullif(sum(matched), 0), 32.0) AS mean_detection_delay_steps, sum(flips) / sum(n)::DOUBLE AS mean_state_flips_per_episode FROM pc GROUP BY id
    ),
    z AS (SELECT y.*, pol.rank AS complexity_rank FROM y JOIN pol ON pol.id = y.candidate_id)
"""
GRID_METRICS = ("answer_coverage", "false_alarms_per_100_episodes", "event_miss_rate", "event_macro_f1", "mean_detection_delay_steps", "mean_state_flips_per_episode")


@register(GRID + f"SELECT candidate_id, complexity_rank, {', '.join(f'round({c}, 6) AS {c}' for c in GRID_METRICS)} FROM z")
def e_policy_grid(spark, sf_dir):
    return policy_candidates(spark, sf_dir).select("candidate_id", "complexity_rank", *(rounded(c).alias(c) for c in GRID_METRICS))


#: Constraints of two packages: one that no policy of the grid meets, one that some do.
LIMITS = {"strict": (0.9, 0.02, 10.0, 0.2), "wide": (0.5, 0.45, 100.0, 1.0)}


@register(GRID + ", " + ", ".join(f"""
    o_{n} AS (SELECT candidate_id FROM z WHERE abs(answer_coverage - {c}) <= {t} AND false_alarms_per_100_episodes <= {fa} AND event_miss_rate <= {miss} ORDER BY event_macro_f1 DESC, mean_detection_delay_steps, mean_state_flips_per_episode, complexity_rank, candidate_id LIMIT 1),
    d_{n} AS (SELECT candidate_id FROM z ORDER BY event_miss_rate, false_alarms_per_100_episodes, candidate_id LIMIT 1)""" for n, (c, t, fa, miss) in LIMITS.items()) + " " + " UNION ALL ".join(
    f"SELECT '{n}' AS package, CASE WHEN (SELECT count(*) FROM o_{n}) = 0 THEN 'diagnostic_only_blocked' ELSE 'pass' END AS status, (SELECT candidate_id FROM o_{n}) AS selected, candidate_id AS diagnostic FROM d_{n}" for n in LIMITS
))
def o_constrained_policy(spark, sf_dir):
    found = policy_candidates(spark, sf_dir)
    chosen = [selection.select_policy(found.withColumn("package", F.lit(n)), ["package"], *limits) for n, limits in LIMITS.items()]
    return chosen[0].unionByName(chosen[1])


@register("""
    WITH RECURSIVE g AS (SELECT role, conv_id % 4 AS seed, conv_id, least(count(*), 32) AS n, row_number() OVER (PARTITION BY role, conv_id % 4 ORDER BY conv_id) AS k FROM conversations GROUP BY role, conv_id),
    p(role, seed, k, episode, used, first_step) AS (
        SELECT role, seed, k, 0::BIGINT, n, 0::BIGINT FROM g WHERE k = 1
        UNION ALL SELECT g.role, g.seed, g.k, CASE WHEN used + n > 32 THEN episode + 1 ELSE episode END, CASE WHEN used + n > 32 THEN n ELSE used + n END, CASE WHEN used + n > 32 THEN 0 ELSE used END FROM p JOIN g ON g.role = p.role AND g.seed = p.seed AND g.k = p.k + 1
    )
    SELECT role, seed, conv_id, episode, CAST(first_step AS BIGINT) AS first_step FROM p JOIN g USING (role, seed, k)
""")
def e_episode_packing(spark, sf_dir):
    """Lanes are a role and a seed, of which there are as many as the table asks for."""
    groups = table(spark, sf_dir, "conversations").groupBy("role", "conv_id").agg(F.count("*").alias("n")).withColumn("seed", F.col("conv_id") % 4)
    return episodes.pack_groups(groups, ["role", "seed"], ["conv_id"], "n").select("role", "seed", "conv_id", "episode", "first_step")


@register("""
    SELECT conv_id, turn // 2 AS step, coalesce(avg(least(1.0, length(text) / 800.0)) FILTER (role <> 'system'), 0.5) AS fused, count(*) FILTER (role <> 'system') = 0 AS abstained
    FROM conversations GROUP BY conv_id, turn // 2
""".replace("SELECT conv_id, turn // 2 AS step, coalesce(", "SELECT conv_id, turn // 2 AS step, round(coalesce(").replace("0.5) AS fused", "0.5), 6) AS fused"))
def e_mean_fusion(spark, sf_dir):
    t = turns(spark, sf_dir).select("conv_id", F.expr("turn div 2").alias("step"), "p", (F.col("role") != "system").alias("available"))
    return episodes.mean_fusion(t, ["conv_id", "step"], "p", "available").select("conv_id", "step", rounded("fused").alias("fused"), "abstained")


@register("""
    SELECT conv_id, max(n) FILTER (role = 'user') AS "user", max(n) FILTER (role = 'assistant') AS assistant, max(n) FILTER (role = 'system') AS system,
        bool_or(role = 'user') AS user_available, bool_or(role = 'assistant') AS assistant_available, bool_or(role = 'system') AS system_available
    FROM (SELECT conv_id, role, count(*) AS n FROM conversations GROUP BY conv_id, role) GROUP BY conv_id
""")
def e_node_table(spark, sf_dir):
    counts = table(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.count("*").alias("n"))
    return episodes.node_table(counts, ["conv_id"], "role", ["user", "assistant", "system"], "n")


@register("""
    WITH n AS (SELECT DISTINCT conv_id, role FROM conversations) SELECT a.conv_id, a.role AS source_node, b.role AS target_node FROM n a JOIN n b ON a.conv_id = b.conv_id AND a.role <> b.role
""")
def e_node_edges(spark, sf_dir):
    return episodes.node_edges(table(spark, sf_dir, "conversations"), ["conv_id"], "role")


@register("""
    WITH t AS (SELECT conv_id, turn, CAST(length(text) > 600 AS INTEGER) AS truth FROM conversations), o AS (SELECT *, truth = 1 AND coalesce(lag(truth) OVER w, 0) = 0 AS onset FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
    SELECT conv_id, turn, truth, onset, CAST(sum(CASE WHEN onset THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS events_so_far FROM o
""")
def e_step_labels(spark, sf_dir):
    return episodes.step_labels(turns(spark, sf_dir), "conv_id", "turn", "truth")
