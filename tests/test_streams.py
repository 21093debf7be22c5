"""The keyed fold in event-time order: rows in any order, over several batches and restarts."""
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from plumbline import streaming
from plumbline.operators import episodes

POLICY = episodes.Policy(0.6, 2, 0.3, 0.6, 0.8)
START = datetime(2024, 1, 1)


def put(spark, folder, number, rows):
    spark.createDataFrame(rows, "e string, ts timestamp, step long, p double, abstain boolean").coalesce(1).write.parquet(f"{folder}/in/{number}")


def advance(spark, folder):
    stream = streaming.read_stream(spark, f"{folder}/in/*", spark.read.parquet(f"{folder}/in/0").schema)
    streaming.run_to_table(streaming.ordered_alarm_states(stream, "e", POLICY, "1 hour", idle_ms=10 * 86_400_000), f"{folder}/out", f"{folder}/state")
    return {(r.e, r.step): (r.memory, r.state) for r in spark.read.parquet(f"{folder}/out").collect()}


def test_shuffled_steps_give_the_batch_result(spark, tmp_path):
    rng = random.Random(3)
    rows = [(e, START + timedelta(minutes=10 * k), k, rng.choice([None, rng.random(), 1.0]), rng.random() < 0.1) for e in "ab" for k in range(60)]
    rows.sort(key=lambda r: (r[1] + timedelta(minutes=rng.randint(0, 55)), r[0]))  # up to 55 minutes out of order
    flush = [("z", START + timedelta(days=2), 0, 0.0, False)]
    put(spark, tmp_path, 0, rows[:45])
    first = advance(spark, tmp_path)
    put(spark, tmp_path, 1, rows[45:90])
    put(spark, tmp_path, 2, rows[90:])
    second = advance(spark, tmp_path)  # goes on from its checkpoint
    put(spark, tmp_path, 3, flush)
    put(spark, tmp_path, 4, [("a", START + timedelta(minutes=5), 99, 1.0, False), ("z", START + timedelta(days=2, hours=3), 1, 0.0, False)])  # the first is too late
    last = advance(spark, tmp_path)
    assert 0 < len(first) < len(second) < len(last) and first.items() <= second.items() <= last.items()
    steps = spark.createDataFrame([(e, k, p, off) for e, _, k, p, off in rows], "e string, step long, p double, abstain boolean")
    want = {(r.e, r.step): (r.memory, r.state) for r in episodes.policy_states(steps, ["e"], "step", "p", F.col("abstain"), POLICY).collect()}
    got = {k: v for k, v in last.items() if k[0] != "z"}
    assert got.keys() == want.keys() and all(got[k][1] == want[k][1] and got[k][0] == pytest.approx(want[k][0]) for k in want)


def test_idle_keys_are_forgotten(spark, tmp_path):
    put(spark, tmp_path, 0, [("a", START, 0, 1.0, False), ("a", START + timedelta(minutes=1), 1, 1.0, False)])
    put(spark, tmp_path, 1, [("z", START + timedelta(days=1), 0, 0.0, False)])
    put(spark, tmp_path, 2, [("z", START + timedelta(days=20), 1, 0.0, False)])
    put(spark, tmp_path, 3, [("z", START + timedelta(days=21), 2, 0.0, False)])
    put(spark, tmp_path, 4, [("a", START + timedelta(days=22), 2, 1.0, False), ("z", START + timedelta(days=23), 3, 0.0, False)])
    got = advance(spark, tmp_path)
    assert [round(got["a", k][0], 6) for k in (0, 1, 2)] == [0.4, 0.64, 0.4]


def test_keys_of_one_bucket_stay_apart(spark, tmp_path):
    """Null and many keys in one state: each runs by itself, and Python is called once a bucket and batch."""
    rows = [(None if e == 0 else f"k{e}", START + timedelta(minutes=(7 * k + e) % 50), k, (k * e % 10) / 10, k % 9 == 0) for e in range(6) for k in range(20)]
    put(spark, tmp_path, 0, rows[::2])
    put(spark, tmp_path, 1, rows[1::2])
    put(spark, tmp_path, 2, [("z", START + timedelta(days=2), 0, 0.0, False)])
    made = {}
    for buckets in (1, 64):
        stream = streaming.read_stream(spark, f"{tmp_path}/in/*", spark.read.parquet(f"{tmp_path}/in/0").schema)
        streaming.run_to_table(streaming.ordered_alarm_states(stream, "e", POLICY, "1 hour", buckets=buckets), f"{tmp_path}/out{buckets}", f"{tmp_path}/state{buckets}")
        made[buckets] = sorted((str(r.e), r.step, r.memory, r.state) for r in spark.read.parquet(f"{tmp_path}/out{buckets}").collect() if r.e != "z")
    assert made[1] == made[64] and len(made[1]) == 120
    assert {r[0] for r in made[1]} == {"None", "k1", "k2", "k3", "k4", "k5"}
