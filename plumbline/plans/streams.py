"""Streaming queries, each run to the end of what there is and read back."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import streaming
from plumbline.operators.episodes import Policy
from plumbline.operators.stash import new_path
from plumbline.plans.catalogue import register
from plumbline.sources.tables import finite, table, with_utc

FAR = "3650 days"


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streaming.read_stream(spark, f"{sf_dir}/events.parque[t]", table(spark, sf_dir, "events").schema)


def finished(stream: DataFrame) -> DataFrame:
    """All rows that the stream emits for what is there now, read back from its table."""
    folder = new_path(stream.sparkSession, "stream")
    streaming.run_to_table(stream, f"{folder}/rows", f"{folder}/state")
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")


@register("SELECT event_id, user_id, value FROM events WHERE event_type = 'error' AND value >= 50")
def s_filtered_stream(spark, sf_dir):
    return finished(events_stream(spark, sf_dir).where("event_type = 'error' and value >= 50").select("event_id", "user_id", "value"))


@register("SELECT min(event_id) AS event_id, event_id AS k FROM events GROUP BY event_id")
def s_distinct_stream(spark, sf_dir):
    return finished(streaming.distinct_events(events_stream(spark, sf_dir), ["event_id"], FAR).select("event_id", F.col("event_id").alias("k")))


@register("""
    WITH b AS (SELECT user_id, date_trunc('day', ts) AS d, count(*) AS n, max(value) AS top FROM events GROUP BY ALL)
    SELECT user_id, strftime(d, '%Y-%m-%d') AS day, n, top FROM b WHERE d + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR
""")
def s_tumbling_blocks(spark, sf_dir):
    """Closed days only: a day is told once the watermark has passed its end."""
    blocks = streaming.tumbling_blocks(events_stream(spark, sf_dir), "user_id", "1 day", "1 hour")
    return finished(blocks.select("user_id", F.date_format("start", "yyyy-MM-dd").alias("day"), "n", "top"))


@register("""
    WITH m AS (SELECT max(ts) - INTERVAL 1 HOUR AS mark FROM events), w AS (SELECT e.*, date_trunc('day', ts) + to_hours(6 * CAST(floor(hour(ts) / 6) - k AS BIGINT)) AS start FROM events e, range(0, 4) AS r(k))
    SELECT user_id, strftime(start + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS history_end, count(*) AS n, round(avg(value), 6) AS mean, max(value) AS top FROM w, m WHERE start + INTERVAL 1 DAY <= mark GROUP BY user_id, start
""")
def s_sliding_history(spark, sf_dir):
    """Windows of a day every six hours that the watermark has passed."""
    out = streaming.sliding_history(events_stream(spark, sf_dir), "user_id", "1 day", "6 hours", "1 hour")
    return finished(out.select("user_id", F.date_format("history_end", "yyyy-MM-dd HH:mm:ss").alias("history_end"), "n", F.round("mean", 6).alias("mean"), "top"))


@register("""
    WITH f AS (SELECT user_id, ts, CASE WHEN coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER w >= 86400000000, true) THEN 1 ELSE 0 END AS o FROM events WHERE value >= 50 WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    n AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM f), i AS (SELECT user_id, k, min(ts) AS a, max(ts) AS z, count(*) AS positions FROM n GROUP BY user_id, k)
    SELECT user_id, epoch_us(a) AS first_us, epoch_us(z) AS last_us, positions FROM i WHERE z + INTERVAL 1 DAY <= (SELECT max(ts) FROM events WHERE value >= 50)
""")
def s_event_sessions(spark, sf_dir):
    """Events of values over 50, at most a day apart, that the watermark has passed."""
    out = streaming.event_sessions(events_stream(spark, sf_dir), "user_id", 50.0, "1 day")
    return finished(out.select("user_id", F.unix_micros("start").alias("first_us"), F.unix_micros("end").alias("last_us"), "positions"))


ORDERED = Policy(beta=0.7, k=2, low=0.3, high=0.5, alarm=0.6)


@register("""
    WITH RECURSIVE t AS (
        SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, event_id, CASE WHEN isfinite(value) THEN least(1.0::DOUBLE, value / 150.0::DOUBLE) END AS p, event_type = 'error' OR NOT isfinite(value) AS ab
        FROM events WHERE ts <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 3 HOUR FROM events)
    ),
    s(u, k, m, run, armed, lvl) AS (
        SELECT DISTINCT user_id, 0::BIGINT, 0.0::DOUBLE, 0, 0, 0 FROM t
        UNION ALL
        SELECT user_id, k, CASE WHEN ab THEN m0 ELSE m END, CASE WHEN ab THEN run0 ELSE run END, CASE WHEN ab THEN armed0 ELSE armed END,
            CASE WHEN ab THEN lvl0 ELSE greatest(CASE WHEN lvl0 >= 2 AND m >= 0.3 THEN lvl0 ELSE 0 END, CASE WHEN armed >= 2 THEN 3 WHEN run >= 2 THEN 2 WHEN m >= 0.3 THEN 1 ELSE 0 END) END
        FROM (SELECT *, CASE WHEN m >= 0.5 THEN run0 + 1 ELSE 0 END AS run, CASE WHEN m >= 0.6 THEN armed0 + 1 ELSE 0 END AS armed FROM
            (SELECT t.user_id, t.k, t.ab, s.m AS m0, s.run AS run0, s.armed AS armed0, s.lvl AS lvl0, 0.7::DOUBLE * s.m + (1 - 0.7::DOUBLE) * t.p AS m FROM s JOIN t ON t.user_id = s.u AND t.k = s.k + 1))
    )
    SELECT t.user_id, t.event_id, round(s.m, 6) AS memory, CASE WHEN t.ab THEN 'abstain' ELSE (['normal', 'attention', 'prewarning', 'alarm'])[s.lvl + 1] END AS state FROM s JOIN t ON t.user_id = s.u AND t.k = s.k
""")
def s_ordered_states(spark, sf_dir):
    """Events as steps that arrive up to two hours out of order, over several batches; rows that the watermark has passed."""
    e = with_utc(finite(table(spark, sf_dir, "events")), "ts")
    ends = e.agg(F.min(F.unix_micros("ts")).alias("a"), F.max(F.unix_micros("ts")).alias("z")).first()
    shifted = F.unix_micros("ts") + F.pmod(F.xxhash64("event_id"), F.lit(2 * 3600)) * 1_000_000
    part = F.floor((shifted - ends.a) * 4 / (ends.z - ends.a + 1))
    steps = e.select("user_id", "ts", F.col("event_id").alias("step"), F.least(F.lit(1.0), F.col("value") / 150).alias("p"), (F.col("event_type") == "error").alias("abstain"), part.alias("part"))
    folder = new_path(spark, "steps")
    steps.withColumn("part", F.least("part", F.lit(4))).repartition("part").write.partitionBy("part").parquet(folder)
    batches = spark.read.parquet(folder).select("part").distinct().orderBy("part").collect()  # five at most
    for k in batches:  # a file a batch, the earlier steps first
        spark.read.parquet(f"{folder}/part={k.part}").coalesce(1).write.parquet(f"{folder}-batches/{k.part}")
    stream = streaming.read_stream(spark, f"{folder}-batches/*", steps.drop("part").schema)
    out = finished(streaming.ordered_alarm_states(stream, "user_id", ORDERED, "3 hours"))
    return out.select("user_id", F.col("step").alias("event_id"), F.round("memory", 6).alias("memory"), "state")


@register("SELECT 'high' AS output, count(*) AS n, round(sum(value), 2) AS total FROM events WHERE value >= 90 UNION ALL SELECT 'errors', count(*), round(sum(value), 2) FROM events WHERE event_type = 'error'")
def s_split_stream(spark, sf_dir):
    """One stream to two tables, batch by batch; a row may go to both. A second run finds nothing new."""
    folder = new_path(spark, "stream")
    outputs = {"high": F.col("value") >= 90, "errors": F.col("event_type") == "error"}
    for _ in range(2):
        streaming.run_to_tables(events_stream(spark, sf_dir), folder, f"{folder}-state", outputs)
    read = lambda n: spark.read.parquet(f"{folder}/{n}").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.lit(n).alias("output"), "n", "total")
    return read("high").unionByName(read("errors"))
