"""Rallies and points."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rallyframe import constants as K
from rallyframe.functions import scalars as S
from rallyframe.operators.greedy import islands, runs
from rallyframe.operators.scan import Agg, join_in_span, row_numbers, span_buckets
from rallyframe.session import pin

KEY = ["match_id"]


def rally_sessions(events: DataFrame, keys: Sequence[str] = KEY, gap: int = K.INACTIVITY_GAP, size: int | None = None,
                   **extra: Agg) -> DataFrame:
    """Add ``rally_start``: a new rally begins after more than ``gap`` frames without events."""
    tie = ["event_type"] if "event_type" in events.columns else []
    return islands(events, keys, "frame_idx", gap, "rally_start", tie=tie, size=size, **extra)


def low_confidence_runs(homography: DataFrame, threshold: float = K.LOW_CONFIDENCE, min_run: int = K.LOW_CONFIDENCE_RUN,
                        keys: Sequence[str] = KEY, size: int | None = None) -> DataFrame:
    """Frame ranges whose calibration confidence stays below the threshold."""
    low = homography.withColumn("_low", F.col("confidence") < threshold)
    return runs(low, keys, "frame_idx", "_low", size).filter(F.col("length") >= min_run)


def first_overlap(points: DataFrame, ranges: DataFrame, keys: Sequence[str] = KEY, width: int = 256) -> DataFrame:
    """First range that overlaps each point, with the confidence factor it costs."""
    p = points.select(*keys, "start_frame", "end_frame", F.explode(span_buckets("start_frame", "end_frame", width)).alias("_b"))
    r = ranges.select(*keys, "run_start", "run_end", F.explode(span_buckets("run_start", "run_end", width)).alias("_b"))
    j = p.join(r, [*keys, "_b"]).filter("start_frame <= run_end AND end_frame >= run_start")
    g = j.groupBy(*keys, "start_frame", "end_frame").agg(F.min(F.struct("run_start", "run_end")).alias("r"))
    overlap = F.least("end_frame", F.col("r.run_end")) - F.greatest("start_frame", F.col("r.run_start")) + 1
    span = F.col("end_frame") - F.col("start_frame") + 1
    return g.select(*keys, "start_frame", "end_frame", F.col("r.run_start").alias("run_start"), F.col("r.run_end").alias("run_end"),
                    F.greatest(F.lit(0.3), 1 - overlap / span * 0.5).alias("penalty"))


def point_events(events: DataFrame, min_events: int = K.MIN_POINT_EVENTS, keys: Sequence[str] = KEY,
                 size: int | None = None) -> DataFrame:
    """Events of valid points, from the first hit on, with what each bounce needs to judge a double bounce."""
    keys = list(keys)
    bounce = F.col("event_type") == "bounce"
    d = rally_sessions(events, keys, size=size,
                       _pb=Agg("last", "before", F.when(bounce, F.struct("frame_idx", "court_side"))),
                       _ph=Agg("last", "before", F.when(~bounce, F.col("frame_idx"))))
    d = pin(d)  # read twice below; events are few compared with frames
    serve = d.groupBy(*keys, "rally_start").agg(
        F.count(F.lit(1)).alias("_n"), F.min(F.when(~bounce, F.col("frame_idx"))).alias("serve_frame"))
    d = d.join(serve.filter((F.col("_n") >= min_events) & F.col("serve_frame").isNotNull()).drop("_n"), [*keys, "rally_start"])
    d = d.filter("frame_idx >= serve_frame")
    same = (F.col("_pb.frame_idx") >= F.col("serve_frame")) & (F.col("_pb.court_side") == F.col("court_side"))
    no_hit = F.col("_ph").isNull() | (F.col("_ph") <= F.col("_pb.frame_idx"))
    return d.withColumn("double_bounce", F.coalesce(bounce & same & no_hit, F.lit(False))).drop("_pb", "_ph")


def segment_points(events: DataFrame, fps: float | DataFrame, homography: DataFrame | None = None, start_sec: float = 0.0,
                   min_events: int = K.MIN_POINT_EVENTS, keys: Sequence[str] = KEY, size: int | None = None) -> DataFrame:
    """One row per point. The frames of its bounces stay in the events table, reachable by the frame span. ``fps`` is the rate of all
    matches, or a table of ``keys`` and ``fps``."""
    keys = list(keys)
    e = point_events(events, min_events, keys, size)
    hit, bounce = F.col("event_type") == "hit", F.col("event_type") == "bounce"
    frame = F.col("frame_idx")
    first = lambda cond, *cols: F.min_by(F.struct(*cols), F.when(cond, frame))
    g = e.groupBy(*keys, "rally_start").agg(
        F.count(F.lit(1)).alias("event_count"), F.min(frame).alias("start_frame"), F.max(frame).alias("end_frame"),
        F.first("serve_frame").alias("serve_frame"), first(hit, "player", "court_side").alias("_serve"),
        first(bounce, "frame_idx", "cx", "cy").alias("_b"), F.count_if(hit).alias("rally_hit_count"),
        F.count_if(bounce).alias("bounce_count"), F.avg("score").alias("_conf"),
        F.max(F.coalesce(F.col("in_out") == "out", F.lit(False))).alias("_out"), F.max("double_bounce").alias("_double"))
    g = g.filter(F.col("event_count") >= min_events)
    zone = S.serve_zone("_b.cx", "_b.cy")
    target = F.when(F.col("_serve.court_side") == "near", "far").otherwise("near")
    g = g.withColumn("serve_zone", zone).withColumn(
        "serve_fault_type", F.when(F.col("_b").isNotNull() & zone.isNull(), S.serve_fault("_b.cx", "_b.cy", target)))
    g = g.withColumn("end_reason", S.when_chain([(F.col("_out"), "OUT"), (F.col("_double"), "DOUBLE_BOUNCE")], "BALL_LOST"))
    g = pin(g)
    if homography is not None:
        cost = first_overlap(g, low_confidence_runs(homography, keys=keys, size=size), keys)
        g = g.join(cost, [*keys, "start_frame", "end_frame"], "left")
    else:
        g = g.withColumn("penalty", F.lit(None).cast("double"))
    g = row_numbers(g, keys, ["start_frame"], "_no", size=size)
    g = g.join(fps.select(*keys, "fps"), keys, "left") if isinstance(fps, DataFrame) else g.withColumn("fps", F.lit(float(fps)))
    sec = lambda c: S.frame_seconds(c, F.col("fps"), start_sec)
    return g.select(*keys, (F.col("_no") - 1).alias("point_idx"), "start_frame", "end_frame",
                    sec("start_frame").alias("start_sec"), sec("end_frame").alias("end_sec"), "serve_frame",
                    F.col("_serve.player").alias("serve_player"), F.col("_b.frame_idx").alias("first_bounce_frame"),
                    F.col("_b.cx").alias("bounce_cx"), F.col("_b.cy").alias("bounce_cy"), "serve_zone", "serve_fault_type",
                    "end_reason", "rally_hit_count", "bounce_count", "event_count",
                    S.round_up(F.col("_conf") * F.coalesce("penalty", F.lit(1.0)), 3).alias("confidence"),
                    F.col("penalty").isNotNull().alias("low_confidence_homography"))


def rows_in_points(rows: DataFrame, points: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Shots or events inside the frame span of a point, with its ``point_idx``."""
    p = points.select(*keys, "point_idx", "start_frame", "end_frame")
    return join_in_span(rows, p, keys, "frame_idx", "start_frame", "end_frame").drop("start_frame", "end_frame")
