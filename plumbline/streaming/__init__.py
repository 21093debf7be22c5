"""Structured Streaming forms of the series operators."""
from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from plumbline.operators.episodes import STATES, Policy


def read_stream(spark: SparkSession, path: str, schema, files_a_trigger: int = 1) -> DataFrame:
    """Parquet files of a folder (or pattern) as a stream, `ts` as a UTC instant."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling_blocks(events: DataFrame, key: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Per key and block: rows and greatest value. Rows later than the watermark are dropped, and counted by Spark."""
    w = F.window("ts", width)
    out = events.withWatermark("ts", late).groupBy(key, w.alias("w")).agg(F.count("*").alias("n"), F.max("value").alias("top"))
    return out.select(key, F.col("w.start").alias("start"), "n", "top")


def sliding_history(events: DataFrame, key: str, width: str = "5 minutes", slide: str = "30 seconds", late: str = "5 minutes") -> DataFrame:
    """Per key and sliding window: rows, mean and greatest value; the watermark waits for the forecast horizon."""
    w = F.window("ts", width, slide)
    out = events.withWatermark("ts", late).groupBy(key, w.alias("w")).agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.max("value").alias("top"))
    return out.select(key, F.col("w.end").alias("history_end"), "n", "mean", "top")


def event_sessions(events: DataFrame, key: str, threshold: float, gap: str, late: str = "0 seconds") -> DataFrame:
    """Events as sessions of flagged rows: rows at most a gap apart are one event; its end is its last row."""
    hits = events.where(F.col("value") >= threshold).withWatermark("ts", late)
    out = hits.groupBy(key, F.session_window("ts", gap).alias("s")).agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("positions"))
    return out.select(key, "start", "end", "positions")


def distinct_events(events: DataFrame, key: list[str], late: str) -> DataFrame:
    """The first row of each key within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(key)


def alarm_states(steps: DataFrame, key: str, policy: Policy) -> DataFrame:
    """The alarm state machine over a stream of (key, step, p, abstain): memory and counters are the key's state.

    Steps of a key must arrive in order across batches; within a batch they are sorted.
    """
    alarm = float("inf") if policy.alarm is None else policy.alarm

    def run(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        memory, high, armed, level = state.get if state.exists else (0.0, 0, 0, 0)
        rows = pd.concat(list(frames)).sort_values("step")  # one key's rows of one micro-batch
        out = []
        for row in rows.itertuples():
            if row.abstain:
                out.append((name[0], row.step, memory, "abstain"))
                continue
            memory = policy.beta * memory + (1 - policy.beta) * row.p
            high = high + 1 if memory >= policy.high else 0
            armed = armed + 1 if memory >= alarm else 0
            held = level if level >= 2 and memory >= policy.low else 0
            level = max(held, 3 if armed >= policy.k else 2 if high >= policy.k else 1 if memory >= policy.low else 0)
            out.append((name[0], row.step, memory, STATES[level]))
        state.update((memory, high, armed, level))
        yield pd.DataFrame(out, columns=[key, "step", "memory", "state"])

    kind = dict(steps.dtypes)[key]
    return steps.select(key, "step", "p", "abstain").groupBy(key).applyInPandasWithState(run, f"`{key}` {kind}, step long, memory double, state string", "memory double, high int, armed int, level int", "append", GroupStateTimeout.NoTimeout)


def _advance(memory: float, high: int, armed: int, level: int, p: float, policy: Policy) -> tuple[float, int, int, int]:
    """The machine after one more probability."""
    memory = policy.beta * memory + (1 - policy.beta) * p
    high = high + 1 if memory >= policy.high else 0
    armed = armed + 1 if policy.alarm is not None and memory >= policy.alarm else 0
    held = level if level >= 2 and memory >= policy.low else 0
    return memory, high, armed, max(held, 3 if armed >= policy.k else 2 if high >= policy.k else 1 if memory >= policy.low else 0)


#: Keys of `ordered_alarm_states` share so many states: Spark calls Python once a state and batch, which costs some ten milliseconds.
KEY_BUCKETS = 1024


def ordered_alarm_states(steps: DataFrame, key: str, policy: Policy, late: str, idle_ms: int = 7 * 86_400_000, buckets: int = KEY_BUCKETS) -> DataFrame:
    """The alarm state machine over a stream of (key, ts, step, p, abstain) whose rows arrive in any order within `late`.

    A key's rows wait in its state until the watermark has passed them, and then go through the machine in
    the order of (ts, step), whatever batches they came in; a timer wakes keys that get no more rows.
    Rows later than the watermark are dropped, and counted by Spark. A key that has nothing waiting for
    `idle_ms` of event time is forgotten and starts anew. A null or NaN probability abstains. Keys are dealt
    to `buckets` by hash, which a checkpoint fixes; a bucket's keys stand in one state, each by itself.
    """
    kind = dict(steps.dtypes)[key]
    off = F.coalesce("abstain", F.lit(True)) | F.col("p").isNull() | F.isnan(F.col("p").cast("double"))
    watched = steps.select(F.pmod(F.xxhash64(key), F.lit(buckets)).alias("bucket"), F.col(key).cast("string").alias("k"), "ts", F.col("step").cast("long").alias("step"), F.coalesce(F.when(~off, F.col("p").cast("double")), F.lit(0.0)).alias("p"), off.alias("abstain"))
    watched = watched.withWatermark("ts", late).withColumn("us", F.unix_micros("ts"))

    def run(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        keys, held = state.get if state.exists else ([], [])
        machines = {k.k: (k.memory, k.high, k.armed, k.level, k.deadline) for k in keys}
        waiting: dict = {}
        for w in held:
            waiting.setdefault(w.k, []).append((w.us, w.step, w.p, w.abstain))
        fresh = set()
        for frame in frames:  # rows of one micro-batch
            for k, *row in zip(*(frame[c].tolist() for c in ("k", "us", "step", "p", "abstain")), strict=True):
                fresh.add(k)
                waiting.setdefault(k, []).append(tuple(row))
        mark = state.getCurrentWatermarkMs()
        out, kept, left = [], [], []
        for k in machines.keys() | waiting.keys():
            rows = sorted(waiting.get(k, ()))
            ready = bisect_right(rows, mark * 1000, key=lambda r: r[0])
            memory, high, armed, level, deadline = machines.get(k, (0.0, 0, 0, 0, 0))
            if not rows and mark > deadline:
                continue
            for _, step, p, abstain in rows[:ready]:
                if not abstain:
                    memory, high, armed, level = _advance(memory, high, armed, level, p, policy)
                out.append((k, step, memory, "abstain" if abstain else STATES[level]))
            if ready or k in fresh:
                deadline = mark + idle_ms
            kept.append((k, memory, high, armed, level, deadline))
            left += [(k, *r) for r in rows[ready:]]
        if kept:
            state.update((kept, left))
            busy = {r[0] for r in left}
            state.setTimeoutTimestamp(max(mark + 1, min([r[1] // 1000 for r in left] + [m[5] for m in kept if m[0] not in busy])))
        else:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["k", "step", "memory", "state"])

    kept = "keys array<struct<k:string,memory:double,high:int,armed:int,level:int,deadline:long>>, waiting array<struct<k:string,us:long,step:long,p:double,abstain:boolean>>"
    told = watched.groupBy("bucket").applyInPandasWithState(run, "k string, step long, memory double, state string", kept, "append", GroupStateTimeout.EventTimeTimeout)
    return told.select(F.col("k").cast(kind).alias(key), "step", "memory", "state")


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Everything available now into a Parquet table, each batch once, resumable from the checkpoint."""
    stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_to_tables(stream: DataFrame, path: str, checkpoint: str, outputs: dict[str, Column]) -> None:
    """Each batch to a table per condition, in a folder batch=<id> of each: a batch that runs again after a failure replaces its own."""

    def put(batch: DataFrame, number: int) -> None:
        batch.persist()
        for name, condition in outputs.items():
            batch.where(condition).write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
        batch.unpersist()

    stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
