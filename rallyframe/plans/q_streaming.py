"""Streaming queries, run until all given rows are processed."""
from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import functions as F

from rallyframe.plans.chain import Chain
from rallyframe.plans.q_stats import rounded
from rallyframe.plans.registry import query
from rallyframe.session import shared_folder, ship
from rallyframe.streaming import streams


@contextmanager
def rocksdb(spark):
    """State store that the stateful operator needs, restored afterwards."""
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, old) if old else spark.conf.unset(key)


FILES = 4  # the files of a stream, one for each micro-batch


def _arriving(rows, folder):
    """Write ``rows`` as a few files that share segments and overlap in time, as a backlog may arrive."""
    rows.repartition(FILES, F.xxhash64("frame_idx", F.lit(3))).write.parquet(folder)


def _events(fx):
    """The event table as a stream of frames (one source per match, value as speed) and the delay that its disorder needs. A row
    long after all others arrives last and closes every window."""
    folder = shared_folder(fx.spark, "events")
    d = fx.table("events").select(F.expr("user_id div 30").alias("match_id"), F.col("event_id").alias("frame_idx"), F.col("ts").cast("timestamp").alias("ts"),
                                  F.col("value").alias("speed"), F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("ball_px"))
    _arriving(d, folder)
    first, last = d.agg(F.min("ts"), F.max("ts")).first()
    end = d.limit(1).select(F.lit(None).cast("bigint").alias("match_id"), F.lit(-1).cast("bigint").alias("frame_idx"), F.lit(last + 10 * (last - first)).alias("ts"),
                            F.lit(0.0).alias("speed"), F.lit(0.0).alias("ball_px"))
    end.write.mode("append").parquet(folder)
    return streams.segment_files(fx.spark, folder, d.schema, "parquet", 1), f"{int((last - first).total_seconds()) + 1} seconds"


@query("stream_sessions", "SR-03", """
WITH e AS (SELECT user_id // 30 AS match_id, event_id, ts FROM events),
g AS (SELECT *, CASE WHEN ts < LAG(ts) OVER w + INTERVAL '1683333 milliseconds' THEN 0 ELSE 1 END AS b FROM e WINDOW w AS (PARTITION BY match_id ORDER BY ts)),
s AS (SELECT *, SUM(b) OVER (PARTITION BY match_id ORDER BY ts) AS sid FROM g)
SELECT match_id, MIN(event_id) AS rally_start, MAX(event_id) AS rally_end, COUNT(*) AS n FROM s GROUP BY match_id, sid""".replace("1683333", "1683334"))
def stream_sessions(fx):
    rows, delay = _events(fx)
    return streams.drain(streams.rally_session_stream(rows, 0.03, delay=delay), "sessions")


@query("stream_coverage", "SR-05", """
SELECT user_id // 30 AS match_id, date_trunc('day', ts) AS slice_start, COUNT(*) AS frames, ROUND(AVG(CASE WHEN event_id % 7 <> 0 AND value IS NOT NULL THEN 100.0::DOUBLE ELSE 0 END), 6) AS ball_pct FROM events GROUP BY 1, 2""")
def stream_coverage(fx):
    rows, delay = _events(fx)
    d = streams.drain(streams.coverage_stream(rows, "1 day", delay), "coverage")
    return rounded(d.withColumn("slice_start", F.col("slice_start").cast("timestamp_ntz")))


@query("stream_pace", "SR-06", """
SELECT user_id // 30 AS match_id, date_trunc('day', ts) - INTERVAL (k) DAY AS window_start, COUNT(*) AS n, ROUND(AVG(value), 6) AS avg_speed FROM events CROSS JOIN (VALUES (0), (1), (2)) AS w(k) WHERE value IS NOT NULL GROUP BY 1, 2""")
def stream_pace(fx):
    rows, delay = _events(fx)
    d = streams.drain(streams.pace_stream(rows, "3 days", "1 day", delay), "pace")
    return rounded(d.withColumn("window_start", F.col("window_start").cast("timestamp_ntz")))


@query("stream_first_copies", "SR-07", "SELECT user_id // 30 AS match_id, event_id AS frame_idx FROM events")
def stream_first_copies(fx):
    rows, delay = _events(fx)
    doubled = rows.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    return streams.drain(streams.first_copies(doubled, delay), "copies").where("match_id IS NOT NULL").select("match_id", "frame_idx")


@query("stream_status", "SR-08 ST-05", """
SELECT user_id // 30 AS job_id, arg_max(event_type, event_id) AS stage, CASE WHEN COUNT(*) FILTER (event_id % 5000 = 17) > 0 THEN 'error' ELSE arg_max(CASE WHEN event_id % 2 = 0 THEN 'running' ELSE 'complete' END, event_id) END AS status,
  CASE WHEN COUNT(*) FILTER (event_id % 5000 = 17) > 0 THEN 'failed' END AS error_message FROM events GROUP BY 1""")
def stream_status(fx):
    folder = shared_folder(fx.spark, "log")
    log = fx.table("events").select(F.expr("user_id div 30").alias("job_id"), F.col("event_id").alias("seq"), F.col("event_id").alias("frame_idx"), F.col("event_type").alias("stage"),
                                    F.when(F.col("event_id") % 2 == 0, "running").otherwise("complete").alias("status"), F.when(F.col("event_id") % 5000 == 17, "failed").alias("error_message"))
    _arriving(log, folder)
    rows = streams.segment_files(fx.spark, folder, log.schema, "parquet", 1)
    return streams.drain(streams.status_stream(rows), "status", ("job_id",), "n").drop("n")


def _segment_folder(fx, track=None, only="true"):
    """Projected track as segment files that arrive out of order: each holds frames of every segment. The clock starts a second after the
    epoch, where the first watermark of a stream stands: a row at the epoch itself is late and would be dropped."""
    folder = shared_folder(fx.spark, "segments")
    d = (Chain(fx).physics if track is None else track).select("match_id", "frame_idx", "fps", "cx", "cy", "speed", "ball_px")
    d = d.withColumn("segment_idx", F.expr("frame_idx div 300")).withColumn("ts", F.timestamp_seconds(1 + F.col("frame_idx") / F.col("fps")))
    _arriving(d.where(only), folder)
    return folder


def _closing(fx, folder):
    """A row of no match long after all others and after the minute in which a match closes, and the delay that files spanning whole matches need."""
    d = fx.spark.read.schema(streams.FRAME_STREAM).parquet(folder)
    last = d.agg(F.max("ts")).first()[0]
    span = d.agg(F.max(F.unix_seconds("ts")) - F.min(F.unix_seconds("ts"))).first()[0] + 2
    null = [F.lit(None).cast(f.dataType).alias(f.name) for f in d.schema if f.name not in ("ts", "frame_idx")]
    end = d.limit(1).select(*null, F.lit(0).cast("bigint").alias("frame_idx"), (F.lit(last) + F.make_interval(secs=F.lit(20 * span + 60))).alias("ts")).select(*d.columns)
    end.write.mode("append").parquet(folder)
    return f"{span} seconds"


@query("stream_merge", "SR-01 SR-02 SR-07", "SELECT match_id, segment_idx, COUNT(*) AS n FROM fx_frames GROUP BY 1, 2")
def stream_merge(fx):
    out, track = shared_folder(fx.spark, "merged"), Chain(fx).physics_table
    for version, only in enumerate(("true", "segment_idx % 2 = 0")):  # the re-run brings every second segment again
        s = streams.segment_files(fx.spark, _segment_folder(fx, track, only), fmt="parquet", files_per_trigger=1)
        streams.merge_segments(s, f"{out}/table", f"{out}/run{version}", version).trigger(availableNow=True).start().awaitTermination()
    return streams.merged_segments(fx.spark, f"{out}/table").groupBy("match_id", "segment_idx").agg(F.count(F.lit(1)).alias("n"))


@query("stream_contacts", "SR-04", "SELECT match_id, frame_idx FROM o_cool WHERE ok")
def stream_contacts(fx):
    """No match says that it is over: each is closed by the watermark."""
    folder = _segment_folder(fx)
    delay = _closing(fx, folder)
    ship(fx.spark)
    with rocksdb(fx.spark):
        s = streams.segment_files(fx.spark, folder, fmt="parquet", files_per_trigger=1)
        return streams.drain(streams.contact_stream(s, delay), "contacts").where("match_id IS NOT NULL").select("match_id", "frame_idx")


@query("stream_late_rows", "SR-05 SR-07", """
SELECT user_id // 30 AS match_id, date_trunc('day', ts) AS slice_start, COUNT(*) AS frames, ROUND(AVG(CASE WHEN event_id % 7 <> 0 AND value IS NOT NULL THEN 100.0::DOUBLE ELSE 0 END), 6) AS ball_pct FROM events GROUP BY 1, 2""")
def stream_late_rows(fx):
    """A delay far shorter than the disorder: what the watermark would drop is routed aside and merged afterwards."""
    rows, delay = _events(fx)
    delay = float(delay.split()[0]) / 50
    folder = shared_folder(fx.spark, "routed")
    streams.route_late(rows, f"{folder}/table", f"{folder}/checkpoint", delay).trigger(availableNow=True).start().awaitTermination()
    on_time = streams.segment_files(fx.spark, f"{folder}/table/on_time/*", rows.schema, "parquet")
    counts = streams.drain(streams.coverage_counts(on_time.withWatermark("ts", f"{int(delay)} seconds"), "1 day"), "coverage")
    late = streams.late_rows(fx.spark, f"{folder}/table", rows.schema)
    return rounded(streams.coverage_of(streams.with_late(counts, late, "1 day")).withColumn("slice_start", F.col("slice_start").cast("timestamp_ntz")))
