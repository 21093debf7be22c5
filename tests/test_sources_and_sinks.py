"""Readers, sinks, seals and streams on small files."""
import json

import pytest
from pyspark.sql import functions as F

from plumbline import sinks, streaming
from plumbline.operators.episodes import Policy, policy_states
from plumbline.sources import annotations, files


def test_coco_objects_of_lines_and_in_files_are_alike(spark, tmp_path):
    kinds = [{"id": 1, "name": "person"}]
    parts = [{"images": [{"id": i, "file_name": f"i{i}", "width": 9, "height": 9}], "annotations": [{"id": i, "image_id": i, "category_id": 1, "bbox": [0, 0, i, 1], "iscrowd": 0}], "categories": kinds} for i in range(1, 6)]
    (tmp_path / "files").mkdir()
    (tmp_path / "lines").mkdir()
    for i, part in enumerate(parts):
        (tmp_path / "files" / f"{i}.json").write_text(json.dumps(part, indent=1))
    (tmp_path / "lines" / "all.json").write_text("\n".join(map(json.dumps, parts)))
    rows = [sorted(map(tuple, annotations.read_coco(spark, str(tmp_path / d), lines=d == "lines").select("record_id", F.size("boxes"), "dropped_crowd").collect())) for d in ("files", "lines")]
    assert rows[0] == rows[1] == [(f"i{i}", 1, 0) for i in range(1, 6)]
    (tmp_path / "lines" / "more.json").write_text(json.dumps(parts[0] | {"images": [], "annotations": [], "categories": kinds * 2}))
    with pytest.raises(ValueError, match="1 repeated categories"):
        annotations.read_coco(spark, str(tmp_path / "lines"), lines=True)


def test_voc_files_are_bounded(spark, tmp_path, monkeypatch):
    from plumbline.operators.stash import new_path, scratch
    from plumbline.plans import storage

    spark.createDataFrame([(o, n, 7, "N") for o in range(200) for n in range(1, 4)], "l_orderkey long, l_linenumber int, l_suppkey long, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(storage, "RECORDS_A_FILE", 10)
    told = []
    monkeypatch.setattr(storage, "new_path", lambda s, name: told.append(new_path(s, name)) or told[-1])
    with scratch(spark):
        assert storage.x_voc(spark, str(tmp_path)).count() == 200
        assert spark.read.text(told[0]).where("value like '%<filename>%'").groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0] <= 10


def test_voc_takes_little_disk(spark, tmp_path, monkeypatch):
    from plumbline.operators.stash import new_path, scratch
    from plumbline.plans import storage

    given = [(o, n, (o * 31 + n * 17) % 97, "ANR"[(o + n) % 3] if o % 50 else None) for o in range(3000) for n in range(1, 5)]
    spark.createDataFrame(given, "l_orderkey long, l_linenumber int, l_suppkey long, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    told = []
    monkeypatch.setattr(storage, "new_path", lambda s, name: told.append(new_path(s, name)) or told[-1])
    with scratch(spark):
        got = {tuple(r) for r in storage.x_voc(spark, str(tmp_path)).collect()}
        files = spark.read.format("binaryFile").load(told[0]).agg(F.sum("length")).first()[0]
    sound = lambda n, s: n < s % 40 <= 30
    want = {o: [0, 0, 0] for o in range(3000)}
    for o, n, s, _ in given:
        want[o][1 if n == 4 else 0 if sound(n, s) else 2] += 1
    assert got == {(f"o{o}", *w) for o, w in want.items()}
    assert files < 30 * len(given)  # indented and not compressed, a line takes over 300 bytes


def test_coco(spark, tmp_path):
    a = lambda i, image, cat, box, crowd=0: {"id": i, "image_id": image, "category_id": cat, "bbox": box, "iscrowd": crowd}
    spec = {"images": [{"id": 1, "file_name": "a.jpg", "width": 10, "height": 20}, {"id": 2, "file_name": "b.jpg", "width": 5, "height": 5}], "categories": [{"id": 7, "name": "person"}, {"id": 8, "name": "dog"}],
            "annotations": [a(1, 1, 7, [1, 2, 3, 4]), a(2, 1, 7, [0, 0, 0, 4]), a(3, 1, 7, [0, 0, 1, 1], 1), a(4, 1, 8, [0, 0, 1, 1])]}
    path = tmp_path / "coco.json"
    path.write_text(json.dumps(spec))
    got = {r.record_id: r for r in annotations.read_coco(spark, str(path), ["person"]).collect()}
    assert [tuple(b) for b in got["a.jpg"].boxes] == [("person", 1.0, 2.0, 4.0, 6.0)] and got["b.jpg"].boxes == []
    assert (got["a.jpg"].dropped_crowd, got["a.jpg"].dropped_invalid, got["a.jpg"].dropped_unselected) == (1, 1, 1)
    spec["categories"].append({"id": 7, "name": "person"})
    path.write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="1 repeated categories"):
        annotations.read_coco(spark, str(path))
    spec["categories"].pop()
    spec["annotations"].append(a(4, 99, 7, [0, 0, 1, 1]))
    path.write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="1 annotations of unknown"):
        annotations.read_coco(spark, str(path))


def test_yolo_round_trip(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1 0.5 0.5 0.2 0.4\n0 0.1 0.1 0.2 0.2\n")
    images = spark.createDataFrame([("a", 100, 50), ("b", 10, 10)], "record_id string, width int, height int")
    got = annotations.read_yolo(spark, str(tmp_path), images, ["cat", "dog"])
    rows = {r.record_id: r for r in got.collect()}
    assert [(b.source_label, round(b.x1, 6), round(b.y1, 6), round(b.x2, 6), round(b.y2, 6)) for b in rows["a"].boxes] == [("cat", 0, 0, 20, 10), ("dog", 40, 15, 60, 35)] and rows["b"].boxes == []
    lines = {r.record_id: r.content for r in sinks.label_lines(got, ["cat", "dog"]).collect()}
    assert lines["a"].split("\n")[1] == "1 0.5000000000 0.5000000000 0.2000000000 0.4000000000" and lines["b"] == ""
    with pytest.raises(ValueError, match="no label file"):
        annotations.read_yolo(spark, str(tmp_path), images, ["cat", "dog"], missing="error")
    for odd in ("-2 0.5 0.5 0.1 0.1", "0.5 0.5 0.5 0.1 0.1", "2 0.5 0.5 0.1 0.1"):
        (tmp_path / "b.txt").write_text(odd)
        with pytest.raises(ValueError, match="1 lines"):
            annotations.read_yolo(spark, str(tmp_path), images, ["cat", "dog"])
    (tmp_path / "sub").mkdir()
    (tmp_path / "b.txt").unlink()
    (tmp_path / "sub" / "a.txt").write_text("1 0.5 0.5 1 1")
    both = annotations.read_yolo(spark, str(tmp_path), images.unionByName(spark.createDataFrame([("sub/a", 10, 10)], images.schema)), ["cat", "dog"])
    assert {r.record_id: len(r.boxes) for r in both.collect()} == {"a": 2, "b": 0, "sub/a": 1}
    (tmp_path / "b.txt").write_text("0 0.5 1.5 0.1 0.1")
    with pytest.raises(ValueError, match="1 lines"):
        annotations.read_yolo(spark, str(tmp_path), images, ["cat", "dog"])


def test_voc(spark, tmp_path):
    obj = lambda n, d, b: f"<object><name>{n}</name><difficult>{d}</difficult><bndbox><xmin>{b[0]}</xmin><ymin>{b[1]}</ymin><xmax>{b[2]}</xmax><ymax>{b[3]}</ymax></bndbox></object>"
    (tmp_path / "a.xml").write_text(f"<annotation><filename>a.jpg</filename><size><width>10</width><height>10</height></size>{obj('x', 0, (1, 1, 5, 5))}{obj('x', 1, (1, 1, 5, 5))}{obj('y', 0, (5, 5, 4, 6))}</annotation>")
    (tmp_path / "b.xml").write_text("<annotation><filename>b.jpg</filename><size><width>10</width><height>10</height></size></annotation>")
    got = {r.record_id: r for r in annotations.read_voc(spark, str(tmp_path)).collect()}
    assert len(got["a.jpg"].boxes) == 1 and (got["a.jpg"].dropped_difficult, got["a.jpg"].dropped_invalid) == (1, 1) and got["b.jpg"].boxes == []


def test_sensor_files(spark, tmp_path):
    (tmp_path / "long").mkdir()
    (tmp_path / "long" / "s.csv").write_text("timestamp,sensor,value\n2024-01-01 00:00:00,S-1,1\n2024-01-01 00:30:00,S-1,2\n2024-01-01 01:00:00,S-1,x\n2024-03-31 02:30:00,S-1,4\n2024-10-27 02:30:00,S-1,5\n")
    long = files.read_sensors_long(spark, str(tmp_path / "long"), "timestamp", "sensor", "value", "Europe/Warsaw", 3600)
    rows = long.orderBy(F.col("epoch").asc_nulls_last(), "value").collect()
    assert [r.value for r in rows[:3]] == [1.0, 2.0, None] and len({r.block_epoch for r in rows[:3]}) == 2 and rows[0].source_csv == "s.csv"
    assert [r.ts for r in rows[3:]] == [None, None]  # skipped and repeated local times
    (tmp_path / "wide").mkdir()
    (tmp_path / "wide" / "w.csv").write_text("year,month,day,hour,minute,second,A,B\n2024,1,1,0,0,0,1.5,\n2024,1,1,0,30,0,2.5,3\n2024,1,1,1,0,0,4,5\n")
    wide = files.read_sensors_wide(spark, str(tmp_path / "wide"), ["A", "B"], "UTC", 3600)
    assert wide.count() == 5 and wide.select("sensor", "block_epoch").distinct().count() == 4
    sinks.write_sensor_blocks(wide, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).where("sensor = 'A'").count() == 3
    with pytest.raises(ValueError, match="two rows"):
        sinks.write_sensor_blocks(wide.unionByName(wide), str(tmp_path / "again"))


def test_manifest_inventory_and_rules(spark, tmp_path):
    (tmp_path / "m.csv").write_text("dataset_id,byte_size,note\nNA,12,\nb,7,null\n")
    m = files.read_manifest_csv(spark, str(tmp_path / "m.csv"), ["dataset_id", "byte_size", "note"], ["byte_size"]).orderBy("byte_size").collect()
    assert [tuple(r) for r in m] == [("b", 7, "null"), ("NA", 12, "")]
    for n in "abc":
        (tmp_path / "f").mkdir(exist_ok=True)
        (tmp_path / "f" / f"{n}.bin").write_bytes(n.encode())
    some, more = files.inventory(spark, str(tmp_path / "f"), 2)
    assert more and sorted(r.path[-5:] for r in some.collect()) == ["a.bin", "b.bin"]
    every, more = files.inventory(spark, str(tmp_path / "f"), 3)
    assert not more and every.count() == 3
    p = spark.createDataFrame([("x/scene12_003.jpg",), ("other",)], "p string")
    rule = {"regex": r"scene(\d+)_(\d+)", "template": "s$1-$2"}
    assert [r.i for r in p.select(files.record_id(rule, F.col("p")).alias("i")).collect()] == ["s12-003", None]
    with pytest.raises(ValueError, match="one form"):
        files.record_id({"constant": "a", "null": True}, F.col("p"))
    with pytest.raises(ValueError, match="no reader"):
        files.materialize(spark, "zip")


def test_write_once_and_seals(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", None), (2, None, 0.5)], "k int, s string, x double")
    path = f"file://{tmp_path}/t"
    told = sinks.write_once(df, path)
    assert sinks.write_once(df.repartition(2).orderBy(F.desc("k")), path) == told and told["rows"] == 2
    with pytest.raises(FileExistsError):
        sinks.write_once(df.withColumn("k", F.col("k") + 1), path)
    other = spark.createDataFrame([(1, None, None), (2, "a", 0.5)], "k int, s string, x double")
    assert sinks.content_digest(other) != told and sinks.content_digest(df.unionByName(df)) != told
    sinks.seal(spark, {"t": df}, f"file://{tmp_path}/seal")
    assert sinks.drift(spark, {"t": df}, f"file://{tmp_path}/seal") == [] and sinks.drift(spark, {"t": other}, f"file://{tmp_path}/seal") == ["t"]
    assert sinks.release(spark, df, "t", f"file://{tmp_path}/seal").count() == 2
    with pytest.raises(PermissionError):
        sinks.release(spark, other, "t", f"file://{tmp_path}/seal")
    broken = df.withColumn("k", F.when(F.col("k") == 2, F.raise_error(F.lit("lost"))).otherwise(F.col("k")))
    for write in (lambda: sinks.write_many(broken, f"file://{tmp_path}/torn", {"all": F.lit(True)}), lambda: sinks.write_csv(broken, f"file://{tmp_path}/torn", ["k"])):
        with pytest.raises(Exception, match="lost"):
            write()
        assert not [p for p in tmp_path.iterdir() if p.name.startswith("torn")]  # nothing stands in the way of the next try
    sinks.write_csv(df, f"file://{tmp_path}/torn", ["k"])
    assert [p.read_text() for p in (tmp_path / "torn").glob("*.csv")] == ["k,s,x\n1,a,\n2,,0.5\n"]
    many = sinks.write_many(df, f"file://{tmp_path}/many", {"low": F.col("k") < 2, "all": F.lit(True)})
    assert (many["low"]["rows"], many["all"]["rows"]) == (1, 2)
    with pytest.raises(FileExistsError):
        sinks.write_many(df, f"file://{tmp_path}/many", {"low": F.lit(True)})


def stream_of(spark, tmp_path, batches, schema):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return streaming.read_stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema, 1)


def test_streamed_events_equal_batch(spark, tmp_path):
    from datetime import datetime, timedelta

    t0 = datetime(2024, 1, 1)
    at = [0, 60, 121, 130, 400]
    rows = [[("u", t0 + timedelta(seconds=s), 5.0) for s in at[:3]], [("u", t0 + timedelta(seconds=s), 5.0) for s in at[3:]], [("z", t0 + timedelta(days=9), 0.0), ("z", t0 + timedelta(days=9), 9.0)]]
    stream = stream_of(spark, tmp_path, rows, "user string, ts timestamp, value double")
    streaming.run_to_table(streaming.event_sessions(stream, "user", 1.0, "60 seconds", "10 days"), str(tmp_path / "out"), str(tmp_path / "state"))
    streaming.run_to_table(streaming.tumbling_blocks(stream, "user", "1 day", "1 day"), str(tmp_path / "blocks"), str(tmp_path / "state2"))
    blocks = spark.read.parquet(str(tmp_path / "blocks")).where("user = 'u'").collect()
    assert [(b.n, b.top) for b in blocks] == [(5, 5.0)]
    assert streaming.sliding_history(stream, "user").isStreaming and spark.read.parquet(str(tmp_path / "out")).count() == 0  # the watermark has not passed
    streaming.run_to_table(streaming.event_sessions(stream, "user", 1.0, "60 seconds", "1 day"), str(tmp_path / "out2"), str(tmp_path / "state3"))
    got = sorted(((r.start - t0).seconds, (r.end - t0).seconds, r.positions) for r in spark.read.parquet(str(tmp_path / "out2")).where("user = 'u'").collect())
    assert got == [(0, 60, 2), (121, 130, 2), (400, 400, 1)]


def test_streamed_alarms_equal_batch(spark, tmp_path):
    from datetime import datetime

    p = [1.0, 1.0, 0.0, 1.0, 1.0, 0.9, 0.2, 0.0, 0.0, 0.0]
    rows = [(k, i, x, i == 2, datetime(2024, 1, 1)) for k in ("a", "b") for i, x in enumerate(p)]
    policy = Policy(0.7, 2, 0.3, 0.6, 0.7)
    stream = stream_of(spark, tmp_path, [[r for r in rows if r[1] < 4], [r for r in rows if r[1] >= 4]], "e string, step long, p double, abstain boolean, ts timestamp")
    streaming.run_to_table(streaming.alarm_states(stream, "e", policy), str(tmp_path / "out"), str(tmp_path / "state"))
    batch = policy_states(spark.createDataFrame(rows, "e string, step long, p double, abstain boolean, ts timestamp"), ["e"], "step", "p", F.col("abstain"), policy)
    key = lambda r: (r.e, r.step, round(r.memory, 9), r.state)
    got = sorted(map(key, spark.read.parquet(str(tmp_path / "out")).collect()))
    assert len(got) == 20 and got == sorted(map(key, batch.collect()))


def test_streamed_split_runs_once(spark, tmp_path):
    from datetime import datetime

    rows = [[(k, datetime(2024, 1, 1)) for k in range(5)], [(k, datetime(2024, 1, 1)) for k in range(5, 9)]]
    stream = stream_of(spark, tmp_path, rows, "k int, ts timestamp")
    for _ in range(2):
        streaming.run_to_tables(stream, str(tmp_path / "out"), str(tmp_path / "state"), {"even": F.col("k") % 2 == 0, "all": F.lit(True)})
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "out" / "even")).collect()) == [0, 2, 4, 6, 8]
    assert spark.read.parquet(str(tmp_path / "out" / "all")).count() == 9


def test_stash_scopes(spark):
    from plumbline.operators import stash as st

    fs = lambda path: spark._jvm.org.apache.hadoop.fs.Path(path)
    there = lambda path: fs(path).getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs(path))
    with st.scratch(spark):
        with st.scratch(spark):
            gone, kept = st.stash(spark.range(3), "a"), st.keep(st.stash(spark.range(4), "b"))
            bucketed = st.stash_bucketed(spark.range(5), "c", "id", 2)
            assert gone.count() + bucketed.count() == 8 and not spark.catalog.listTables()
        assert not there(gone.stashed_at) and not there(bucketed.stashed_at) and kept.count() == 4
    assert not there(kept.stashed_at)
    left = st.stash(spark.range(2), "d")
    st.discard(left)
    assert not there(left.stashed_at)
