"""Streams: committed batches, late rows, contacts closed by the watermark; several tables written at once."""
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from rallyframe.plans import q_streaming
from rallyframe.plans.q_streaming import rocksdb
from rallyframe.session import ship
from rallyframe.streaming import commits, streams

SCHEMA = "match_id BIGINT, segment_idx BIGINT, v BIGINT"


def test_batches_are_whole_idempotent_and_bounded(spark, tmp_path):
    table = commits.Batches(spark, str(tmp_path / "t"), every=4)
    want, most = [], 0
    for b in range(13):
        rows = [(b % 3, b, i) for i in range(5)]
        df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
        if b % 5 == 2:  # an attempt that dies before its commit
            commit, table.log.commit = table.log.commit, lambda *_: (_ for _ in ()).throw(OSError("lost"))
            with pytest.raises(OSError):
                table.append(df, 0, b)
            table.log.commit = commit
            assert sorted(map(tuple, table.read(SCHEMA).collect())) == sorted(want)
        table.append(df, 0, b)
        table.append(df, 0, b)  # the stream repeats a batch that was committed
        want += rows
        assert sorted(map(tuple, table.read(SCHEMA).collect())) == sorted(want)
        most = max(most, len(table.log.folders()))
    assert most <= 4 + 4 + 2 + 3  # open, kept for readers, two snapshots, failed attempts
    before = table.read(SCHEMA)  # a reader's state outlives one compaction
    table.compact()
    assert before.count() == len(want)


def test_a_snapshot_that_could_not_tidy_up_is_no_loss(spark, tmp_path):
    table = commits.Batches(spark, str(tmp_path / "t"), every=2)
    table.log.forget = lambda names: None
    table.log.remove = lambda folders: None
    for b in range(7):
        table.append(spark.createDataFrame([(0, b, b)], SCHEMA), 0, b)
    assert sorted(r.v for r in table.read(SCHEMA).collect()) == list(range(7))


def test_merge_keeps_the_latest_run(spark, tmp_path):
    for run, only in enumerate(("true", "segment_idx % 2 = 0")):
        src = str(tmp_path / f"in{run}")
        d = spark.range(60).selectExpr("id % 2 AS match_id", "id % 6 AS segment_idx", f"id + {1000 * run} AS v").where(only)
        d.repartition(5).write.parquet(src)
        for _ in range(2):  # the second start finds nothing new
            s = streams.segment_files(spark, src, SCHEMA, "parquet", 1)
            streams.merge_segments(s, str(tmp_path / "t"), str(tmp_path / f"c{run}"), run, 3).trigger(availableNow=True).start().awaitTermination()
    got = sorted(r.v for r in streams.merged_segments(spark, str(tmp_path / "t"), SCHEMA).collect())
    assert got == sorted(i + 1000 * (i % 6 % 2 == 0) for i in range(60))


def test_late_rows_are_routed_aside(spark, tmp_path):
    src, table = str(tmp_path / "in"), str(tmp_path / "t")
    start = dt.datetime(2024, 1, 1)
    for seconds in ((0, 10, 20), (25, 5, 16), (9, 100, 91), (89, 101)):
        spark.createDataFrame([(0, s, start + dt.timedelta(seconds=s)) for s in seconds], "match_id BIGINT, v BIGINT, ts TIMESTAMP").coalesce(1).write.mode("append").parquet(src)
    schema = "match_id BIGINT, v BIGINT, ts TIMESTAMP"
    for _ in range(2):
        rows = streams.segment_files(spark, src, schema, "parquet", 1)
        streams.route_late(rows, table, str(tmp_path / "c"), 10.0).trigger(availableNow=True).start().awaitTermination()
    late = sorted(r.v for r in streams.late_rows(spark, table, schema).collect())
    assert late == [5, 9, 89]  # behind 10, 15 and 90; 16 and 91 are within the delay
    assert sorted(r.v for r in spark.read.parquet(f"{table}/on_time").collect()) == [0, 10, 16, 20, 25, 91, 100, 101]


def plain_contacts(frames):
    s, found = list(streams.START), []
    for f, cx, cy, speed in sorted(frames):
        streams._fold(s, f, cx, cy, speed, found, 0)
    return [r[1] for r in found]


def test_contacts_close_by_the_watermark(spark, tmp_path):
    rnd = random.Random(3)
    start, src, want = dt.datetime(2024, 1, 1), str(tmp_path / "in"), {}
    data = []
    for match, first in ((0, 0), (1, 7_000)):
        x, dx, own = 0.0, 40.0, []
        for f in range(first, first + 400):
            if rnd.random() < 0.06:
                dx = -dx
            x += dx
            if f % 97 != 5:  # numbers that the recorder left out
                own.append((f, None if f % 61 == 3 else x, 0.0, 9.0))
        want[match] = plain_contacts(own)
        data += [(match, f, start + dt.timedelta(seconds=(f - first) / 30), cx, cy, v) for f, cx, cy, v in own]
    data.sort(key=lambda r: r[2] + dt.timedelta(seconds=rnd.uniform(0, 2)))
    data += data[100:110]
    n = len(data) // 5
    parts = [data[i * n:(i + 1) * n] for i in range(6)] + [[(9, 0, start + dt.timedelta(hours=1), None, None, None)]]
    schema = "match_id BIGINT, frame_idx BIGINT, ts TIMESTAMP, cx DOUBLE, cy DOUBLE, speed DOUBLE"
    for p in parts:
        if p:
            spark.createDataFrame(p, schema).coalesce(1).write.mode("append").parquet(src)
    ship(spark)
    with rocksdb(spark):
        s = streams.segment_files(spark, src, schema, "parquet", 1)
        got = streams.drain(streams.contact_stream(s, "3 seconds", 20.0), "contacts").collect()
    assert want[0] and want[1]
    for match in (0, 1):
        assert sorted(r.frame_idx for r in got if r.match_id == match) == want[match]


def test_the_first_frame_of_a_match_is_not_late(spark, fx):
    """A turn right after the start: the smoothed track depends on frame 0."""
    track = [(1158.37, 670.21), (1219.37, 573.21), (1280.37, 524.21), (1239.37, 621.21), (1178.37, 718.21), (1117.37, 815.21), (1056.37, 912.21)]
    rows = [(136, i, 25.0, x, y, 9.0, 1.0) for i, (x, y) in enumerate(track)]
    want = plain_contacts([(i, x, y, v) for _, i, _, x, y, v, _ in rows])
    d = spark.createDataFrame(rows, "match_id BIGINT, frame_idx BIGINT, fps DOUBLE, cx DOUBLE, cy DOUBLE, speed DOUBLE, ball_px DOUBLE")
    folder = q_streaming._segment_folder(fx, d)
    delay = q_streaming._closing(fx, folder)
    ship(spark)
    with rocksdb(spark):
        s = streams.segment_files(spark, folder, fmt="parquet", files_per_trigger=1)
        got = streams.drain(streams.contact_stream(s, delay), "contacts").where("match_id IS NOT NULL").collect()
    assert [r.frame_idx for r in got] == want == [4]


def test_two_tables_change_together(spark, tmp_path):
    root = str(tmp_path / "r")
    a, b = spark.range(5), spark.range(7)
    commits.write_together(spark, root, a=a, b=b)
    broken = spark.range(3).select(F.raise_error(F.lit("no")).cast("bigint").alias("id"))
    with pytest.raises(Exception):
        commits.write_together(spark, root, a=spark.range(1), b=broken)
    assert commits.read_table(spark, root, "a").count() == 5 and commits.read_table(spark, root, "b").count() == 7
    commits.write_together(spark, root, a=spark.range(2))
    commits.write_together(spark, root, a=commits.read_table(spark, root, "a").where("id < 1"), b=spark.range(0))
    assert commits.read_table(spark, root, "a").count() == 1 and commits.read_table(spark, root, "b").count() == 0
    commits.write_together(spark, root, a=spark.range(4))
    assert len(commits.Log(spark, root).folders()) <= 5
