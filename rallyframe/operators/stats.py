"""Match statistics over shots, points, events, tracks and calibration tables.

Results are long tables (match, player, key, value). Groups are reduced by algebraic aggregates, which
Spark combines before the shuffle, so a hot match or player costs no extra.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rallyframe import constants as K
from rallyframe.functions import scalars as S
from rallyframe.operators.points import rows_in_points
from rallyframe.operators.quantiles import mean_in_order, percentiles, summarise
from rallyframe.operators.scan import Agg, join_in_span, scan
from rallyframe.session import pin

KEY = ["match_id"]


def _share(part: str, *group: str) -> Column:
    return S.percent(part, F.sum(part).over(Window.partitionBy(*group)))


def shot_type(col: str = "shot_type") -> Column:
    return F.coalesce(F.col(col), F.lit("unknown"))


# --- shots ------------------------------------------------------------------------------------

def shot_mix(shots: DataFrame) -> DataFrame:
    """Shots per player and type with the share of the player's shots."""
    g = shots.groupBy("match_id", "owner", shot_type().alias("shot_type")).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("pct", _share("n", "match_id", "owner"))


def direction_mix(shots: DataFrame) -> DataFrame:
    """Shots per player, type and direction with the share inside the type."""
    g = shots.groupBy("match_id", "owner", shot_type().alias("shot_type"),
                      F.coalesce("direction", F.lit("unknown")).alias("direction")).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("pct", _share("n", "match_id", "owner", "shot_type"))


def average_speed(shots: DataFrame) -> DataFrame:
    fast = F.when(F.col("speed_m_s") > 0, F.col("speed_m_s"))
    return shots.groupBy("match_id", "owner").agg(F.count(F.lit(1)).alias("total_shots"),
                                                  F.coalesce(F.avg(fast), F.lit(0.0)).alias("avg_speed"))


def match_summary_rollup(shots: DataFrame) -> DataFrame:
    """Shot counts per player and type with subtotals per player, match and overall."""
    return shots.withColumn("shot_type", shot_type()).rollup("match_id", "owner", "shot_type").agg(F.count(F.lit(1)).alias("n"))


def pattern_top(shots: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` most frequent type/direction patterns per player, first seen first on ties."""
    g = shots.groupBy("match_id", "owner", shot_type().alias("shot_type"),
                      F.coalesce("direction", F.lit("unknown")).alias("direction")).agg(
        F.count(F.lit(1)).alias("n"), F.min("frame_idx").alias("_seen"))
    g = g.withColumn("pct", _share("n", "match_id", "owner"))
    w = Window.partitionBy("match_id", "owner").orderBy(F.desc("n"), "_seen")
    return (g.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .withColumn("pattern", F.concat_ws("_", "shot_type", "direction")).drop("_seen"))


# --- points and their shots -------------------------------------------------------------------

def last_shots(shots: DataFrame, points: DataFrame) -> DataFrame:
    """Last shot of each point: owner, type, direction and frame."""
    cols = ["match_id", "frame_idx", "owner", "shot_type", "direction", "speed_m_s"]
    j = rows_in_points(shots.select(*cols), points)
    g = j.groupBy("match_id", "point_idx").agg(
        F.max_by(F.struct("owner", "shot_type", "direction", "speed_m_s", "frame_idx"), "frame_idx").alias("s"),
        F.count(F.lit(1)).alias("shots_in_point"))
    return g.select("match_id", "point_idx", "shots_in_point", F.col("s.owner").alias("last_owner"),
                    F.col("s.shot_type").alias("last_type"), F.col("s.direction").alias("last_direction"),
                    F.col("s.speed_m_s").alias("last_speed"), F.col("s.frame_idx").alias("last_frame"))


def with_last_shot(points: DataFrame, shots: DataFrame) -> DataFrame:
    return points.join(last_shots(shots, points), ["match_id", "point_idx"], "left")


def winner_of(last_owner: Column, error: Column, unknown: str | None = "player_a") -> Column:
    """Opponent of the last hitter after an error, else the last hitter; ``unknown`` without shots."""
    return F.when(last_owner.isNull(), F.lit(unknown)).when(error, S.opponent(last_owner)).otherwise(last_owner)


def point_winners(points: DataFrame, shots: DataFrame, unknown: str | None = "player_a") -> DataFrame:
    d = with_last_shot(points, shots)
    return d.withColumn("winner", winner_of(F.col("last_owner"), F.col("end_reason").isin("OUT", "NET"), unknown))


def errors_by_type(points: DataFrame, shots: DataFrame, last: DataFrame | None = None) -> DataFrame:
    """Points lost by a player's own last shot, per shot type, against all shots of that type.

    ``last`` is ``with_last_shot(points, shots)`` when the caller already has it.
    """
    e = (last if last is not None else with_last_shot(points, shots)).filter(F.col("end_reason").isin("OUT", "NET") & F.col("last_owner").isNotNull())
    e = e.groupBy("match_id", F.col("last_owner").alias("owner"), shot_type("last_type").alias("shot_type")).agg(
        F.count(F.lit(1)).alias("errors"), F.min("point_idx").alias("first_at"))
    made = shots.groupBy("match_id", "owner", shot_type().alias("shot_type")).agg(F.count(F.lit(1)).alias("made"))
    return e.join(made, ["match_id", "owner", "shot_type"], "left").withColumn(
        "rate", S.percent("errors", F.greatest(F.coalesce("made", F.lit(1)), F.lit(1))))


def errors_by_rally(points: DataFrame, shots: DataFrame, last: DataFrame | None = None) -> DataFrame:
    """Same errors per rally length class, against all points of the class."""
    d = (last if last is not None else with_last_shot(points, shots)).withColumn("bucket", S.rally_bucket("rally_hit_count"))
    e = d.filter(F.col("end_reason").isin("OUT", "NET") & F.col("last_owner").isNotNull()) \
        .groupBy("match_id", F.col("last_owner").alias("owner"), "bucket").agg(F.count(F.lit(1)).alias("errors"))
    total = points.groupBy("match_id", S.rally_bucket("rally_hit_count").alias("bucket")).agg(F.count(F.lit(1)).alias("played"))
    return e.join(total, ["match_id", "bucket"]).withColumn("rate", S.percent("errors", "played"))


def with_serve_calls(points: DataFrame) -> DataFrame:
    """Add serve zone and fault from the first bounce; A serves from the near side."""
    zone = S.serve_zone("bounce_cx", "bounce_cy")
    target = F.when(F.col("serve_player") == "player_a", "far").otherwise("near")
    return points.withColumn("serve_zone", zone).withColumn(
        "serve_fault_type", F.when(F.col("bounce_cx").isNotNull() & zone.isNull(), S.serve_fault("bounce_cx", "bounce_cy", target)))


def double_faults(points: DataFrame, size: int | None = None) -> DataFrame:
    """Add ``double_fault``: a fault followed by a fault in the same server's next point."""
    fault = F.col("serve_fault_type").isNotNull()
    d = scan(points.filter("serve_player IS NOT NULL"), ["match_id", "serve_player"], ["point_idx"], size=size,
             _next=Agg("first", "after", fault))
    return d.withColumn("double_fault", fault & F.coalesce("_next", F.lit(False))).drop("_next")


def serve_summary(points: DataFrame) -> DataFrame:
    """Serve points, first-serve share and double faults per server; both players always appear."""
    g = double_faults(points).groupBy("match_id", F.col("serve_player").alias("owner")).agg(
        F.count(F.lit(1)).alias("serves"), (F.avg(F.col("serve_fault_type").isNull().cast("double")) * 100).alias("first_serve_pct"),
        F.count_if("double_fault").alias("double_faults"))
    both = points.select("match_id").distinct().select("match_id", F.explode(F.array(*[F.lit(p) for p in K.PLAYERS])).alias("owner"))
    return both.join(g, ["match_id", "owner"], "left").na.fill({"serves": 0, "first_serve_pct": 0.0, "double_faults": 0})


def serve_zone_wins(points: DataFrame) -> DataFrame:
    """Serves per zone and share of points the server did not lose or drop out of tracking."""
    win = ~F.col("end_reason").isin("OUT", "NET", "BALL_LOST")
    return points.filter("serve_player IS NOT NULL").groupBy(
        "match_id", F.col("serve_player").alias("owner"), F.coalesce("serve_zone", F.lit("unknown")).alias("zone")).agg(
        F.count(F.lit(1)).alias("serves"), (F.avg(win.cast("double")) * 100).alias("win_pct"))


def serve_placement(points: DataFrame) -> DataFrame:
    return points.filter("bounce_cx IS NOT NULL").select(
        "match_id", "point_idx", F.round("bounce_cx", 2).alias("court_x"), F.round("bounce_cy", 2).alias("court_y"), "serve_zone",
        F.col("serve_fault_type").isNotNull().alias("is_fault"), F.col("serve_fault_type").alias("fault_type"), "serve_player")


def rally_histogram(points: DataFrame) -> DataFrame:
    return points.groupBy("match_id", S.rally_bucket("rally_hit_count").alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("rally_hit_count").alias("hits"))


def rally_average(points: DataFrame) -> DataFrame:
    return points.groupBy("match_id").agg(F.count(F.lit(1)).alias("points"), F.avg("rally_hit_count").alias("avg_hits"))


def match_flow(points: DataFrame) -> DataFrame:
    return points.select("match_id", "point_idx", F.col("start_sec").alias("timestamp_sec"),
                         F.col("rally_hit_count").alias("rally_length"), F.coalesce("end_reason", F.lit("UNKNOWN")).alias("end_reason"),
                         (F.col("end_sec") - F.col("start_sec")).alias("duration_sec"))


def by_end_reason(points: DataFrame) -> DataFrame:
    """Points per end reason with their position inside the group, in play order."""
    r = points.withColumn("reason", F.coalesce("end_reason", F.lit("UNKNOWN")))
    d = scan(r, ["match_id", "reason"], ["point_idx"], member_no=Agg("count", "upto", F.lit(1)), members=Agg("count", "all", F.lit(1)))
    return d.select("match_id", "reason", "members", "member_no", "point_idx")


# --- rebuilt statistics -----------------------------------------------------------------------

def last_owner_by_time(points: DataFrame, shots: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """Fill a missing ``last_hit_owner`` with the last shot between start and end + tolerance."""
    if "last_hit_owner" not in points.columns:
        points = points.withColumn("last_hit_owner", F.lit(None).cast("string"))
    spans = points.select("match_id", "point_idx", F.col("start_sec").alias("_s"), (F.col("end_sec") + tolerance).alias("_e"))
    j = join_in_span(shots.select("match_id", "timestamp_sec", "frame_idx", "owner"), spans, KEY, "timestamp_sec", "_s", "_e", width=8)
    g = j.groupBy("match_id", "point_idx").agg(F.max_by("owner", F.struct("timestamp_sec", "frame_idx")).alias("_o"))
    d = points.join(g, ["match_id", "point_idx"], "left")
    return d.withColumn("last_hit_owner", F.coalesce("last_hit_owner", "_o")).drop("_o")


def with_rebuilt_winner(points: DataFrame, shots: DataFrame, extra_errors: Sequence[str] = ()) -> DataFrame:
    """Winner from last hitter by time, else the server, else A."""
    d = last_owner_by_time(points, shots)
    hitter = F.coalesce("last_hit_owner", "serve_player")
    error = F.col("end_reason").isin(*K.ERROR_REASONS, *extra_errors)
    return d.withColumn("hitter", hitter).withColumn("is_error", F.coalesce(error, F.lit(False))).withColumn(
        "winner", F.when(error, S.opponent(hitter)).otherwise(F.coalesce(hitter, F.lit("player_a"))))


def points_won_lost(points: DataFrame, shots: DataFrame) -> DataFrame:
    d = with_rebuilt_winner(points, shots)
    g = d.groupBy("match_id").agg(F.count_if(F.col("winner") == "player_a").alias("a"), F.count_if(F.col("winner") == "player_b").alias("b"))
    one = lambda label, won, lost: F.struct(F.lit(label).alias("owner"), F.col(won).alias("points_won"), F.col(lost).alias("points_lost"))
    return g.select("match_id", F.explode(F.array(one("player_a", "a", "b"), one("player_b", "b", "a"))).alias("r")).select("match_id", "r.*")


def shot_error_attribution(points: DataFrame, shots: DataFrame, within: float = 1.5) -> DataFrame:
    """Shots played less than ``within`` seconds from the end of a point their owner lost by error."""
    lost = with_rebuilt_winner(points, shots).filter("is_error").select(
        "match_id", F.col("hitter").alias("owner"), "end_sec", (F.col("end_sec") - within).alias("_s"), (F.col("end_sec") + within).alias("_e"))
    j = join_in_span(shots, lost.withColumnRenamed("end_sec", "_end"), ["match_id", "owner"], "timestamp_sec", "_s", "_e", width=8)
    near = j.filter(F.abs(F.col("timestamp_sec") - F.col("_end")) < within).select("match_id", "owner", "frame_idx").distinct()
    return shots.join(near, ["match_id", "owner", "frame_idx"], "left_semi")


def rebuilt_errors_by_type(points: DataFrame, shots: DataFrame) -> DataFrame:
    made = shots.groupBy("match_id", "owner", shot_type().alias("shot_type")).agg(F.count(F.lit(1)).alias("made"))
    e = shot_error_attribution(points, shots).groupBy("match_id", "owner", shot_type().alias("shot_type")).agg(
        F.count(F.lit(1)).alias("errors"), F.min("frame_idx").alias("first_at"))
    return e.join(made, ["match_id", "owner", "shot_type"]).withColumn("rate", S.percent("errors", "made"))


def rebuilt_errors_by_rally(points: DataFrame, shots: DataFrame) -> DataFrame:
    d = with_rebuilt_winner(points, shots).withColumn("bucket", S.rally_bucket("rally_hit_count"))
    e = d.filter("is_error").groupBy("match_id", F.col("hitter").alias("owner"), "bucket").agg(F.count(F.lit(1)).alias("errors"))
    total = points.groupBy("match_id", S.rally_bucket("rally_hit_count").alias("bucket")).agg(F.count(F.lit(1)).alias("played"))
    return e.join(total, ["match_id", "bucket"]).withColumn("rate", S.percent("errors", "played"))


def rebuilt_zone_wins(points: DataFrame, shots: DataFrame) -> DataFrame:
    d = with_rebuilt_winner(points, shots)
    return d.groupBy("match_id", F.col("serve_player").alias("owner"), F.coalesce("serve_zone", F.lit("unknown")).alias("zone")).agg(
        F.count(F.lit(1)).alias("serves"), (F.avg((F.col("winner") == F.col("serve_player")).cast("double")) * 100).alias("win_pct"))


def contact_path(shots: DataFrame, size: int | None = None) -> DataFrame:
    """Distance between a player's consecutive contact positions and their centroid."""
    d = scan(shots.filter("ball_cx IS NOT NULL AND ball_cy IS NOT NULL"), ["match_id", "owner"], ["frame_idx"], size=size,
             _p=Agg("last", "before", F.struct("ball_cx", "ball_cy")))
    step = F.hypot(F.col("ball_cx") - F.col("_p.ball_cx"), F.col("ball_cy") - F.col("_p.ball_cy"))
    return d.groupBy("match_id", "owner").agg(F.coalesce(F.sum(step), F.lit(0.0)).alias("distance"),
                                              F.avg("ball_cx").alias("centre_x"), F.avg("ball_cy").alias("centre_y"))


def rebuilt_players(points: DataFrame, shots: DataFrame) -> DataFrame:
    """Scalar part of the rebuilt statistics of each player; the maps are the tables above."""
    d = average_speed(shots).join(points_won_lost(points, shots), ["match_id", "owner"], "full")
    d = d.join(serve_summary(points), ["match_id", "owner"], "left").join(contact_path(shots), ["match_id", "owner"], "left")
    return d.na.fill({"total_shots": 0, "avg_speed": 0.0})


# --- movement, pace, samples ------------------------------------------------------------------

def with_previous(positions: DataFrame, keys: Sequence[str], size: int | None = None) -> DataFrame:
    """Add the previous known position of a track (columns x, y, t): ``pt``, ``px``, ``py``."""
    d = scan(positions.filter("x IS NOT NULL AND y IS NOT NULL AND t IS NOT NULL"), keys, ["frame_idx"], size=size,
             _p=Agg("last", "before", F.struct("t", "x", "y")))
    return d.select("*", F.col("_p.t").alias("pt"), F.col("_p.x").alias("px"), F.col("_p.y").alias("py")).drop("_p")


def court_coverage(positions: DataFrame, size: int | None = None) -> DataFrame:
    """Path length over known positions and centroid; players with fewer than two positions drop out."""
    d = with_previous(positions, ["match_id", "label"], size)
    return d.groupBy("match_id", "label").agg(
        F.coalesce(F.sum(F.hypot(F.col("x") - F.col("px"), F.col("y") - F.col("py"))), F.lit(0.0)).alias("distance"),
        F.avg("x").alias("centre_x"), F.avg("y").alias("centre_y"), F.count(F.lit(1)).alias("n")).filter("n >= 2")


def movement_samples(positions: DataFrame, max_gap: float = 0.5, size: int | None = None) -> DataFrame:
    """Steps between consecutive positions no more than ``max_gap`` seconds apart, with speed in m/s."""
    d = with_previous(positions, ["match_id", "label"], size).withColumn("dt", F.col("t") - F.col("pt"))
    d = d.filter((F.col("dt") > 0) & (F.col("dt") <= max_gap))
    step = F.hypot(F.col("x") - F.col("px"), F.col("y") - F.col("py")) * K.METRES_PER_UNIT
    return d.withColumn("step_m", step).withColumn("speed", F.col("step_m") / F.col("dt"))


def movement(positions: DataFrame, size: int | None = None) -> DataFrame:
    s = movement_samples(positions, size=size)
    dist = s.groupBy("match_id", "label").agg(F.sum("step_m").alias("distance_m"))
    zone = S.movement_zone("y")
    share = lambda z: (F.avg((zone == z).cast("double")) * 100).alias(f"{z}_pct")
    zones = positions.filter("x IS NOT NULL AND y IS NOT NULL").groupBy("match_id", "label").agg(
        F.count(F.lit(1)).alias("positions"), share("net"), share("baseline"), share("mid"))
    return (zones.join(dist, ["match_id", "label"], "left").join(summarise(s, ["match_id", "label"], "speed", "speed_"), ["match_id", "label"], "left")
            .na.fill({"distance_m": 0.0}))


def serve_samples(points: DataFrame) -> DataFrame:
    """Depth to the service line of the landing side and width from the centre, in metres."""
    x, y, zone = F.col("bounce_cx"), F.col("bounce_cy"), F.col("serve_zone")
    near = F.coalesce(zone.startswith("near"), F.lit(False)) | (y >= K.NET_Y)
    line = F.when(near, K.NEAR_SERVICE).otherwise(K.FAR_SERVICE)
    return points.filter(x.isNotNull() & y.isNotNull()).select(
        "match_id", "point_idx", "serve_zone", "serve_fault_type",
        (F.abs(line - y) * K.METRES_PER_UNIT).alias("depth_m"), (F.abs(x - K.CENTRE_X) * K.METRES_PER_UNIT).alias("width_m"))


def serve_depth_width(points: DataFrame) -> DataFrame:
    s = serve_samples(points)
    rate = s.groupBy("match_id").agg(F.count(F.lit(1)).alias("samples"), F.avg(F.col("serve_fault_type").isNotNull().cast("double")).alias("fault_rate"))
    return (rate.join(summarise(s, KEY, "depth_m", "depth_"), KEY).join(summarise(s, KEY, "width_m", "width_"), KEY)
            .drop("depth_n", "width_n"))


def inter_hit(hits: DataFrame, size: int | None = None) -> DataFrame:
    """Seconds between consecutive hits of a match, positive ones only."""
    d = scan(hits, KEY, ["frame_idx"], size=size, _t=Agg("last", "before", F.col("timestamp_sec")))
    return d.withColumn("interval", F.col("timestamp_sec") - F.col("_t")).filter("interval > 0").drop("_t")


def rally_structure(points: DataFrame, hits: DataFrame) -> DataFrame:
    span = F.col("end_sec") - F.col("start_sec")
    p = points.groupBy("match_id").agg(F.avg("rally_hit_count").alias("avg_hits"), F.avg(F.when(span > 0, span)).alias("avg_duration"),
                                       F.avg(F.when(span > 0, F.col("rally_hit_count") / span)).alias("hits_per_sec"))
    i = pin(inter_hit(hits).select("match_id", "frame_idx", "interval"))
    return (p.join(mean_in_order(i, KEY, "frame_idx", "interval", 6, "mean_inter_hit"), KEY, "left")
            .join(percentiles(i, KEY, "interval", {"p95_inter_hit": 0.95}), KEY, "left"))


def end_reason_counts(points: DataFrame) -> DataFrame:
    return points.filter("end_reason IS NOT NULL").groupBy("match_id", "end_reason").agg(F.count(F.lit(1)).alias("n"))


def out_ball_samples(events: DataFrame) -> DataFrame:
    out = events.filter("event_type = 'bounce' AND in_out = 'out' AND cx IS NOT NULL AND cy IS NOT NULL")
    return out.withColumn("out_m", S.outside_distance("cx", "cy") * K.METRES_PER_UNIT)


def out_ball_stats(events: DataFrame) -> DataFrame:
    return summarise(out_ball_samples(events), KEY, "out_m", "out_").withColumnRenamed("out_n", "out_count")


def ball_pace(track: DataFrame) -> DataFrame:
    """Speed summary, mean acceleration and 95th percentile of its size."""
    a = track.withColumn("_abs", F.abs("accel"))
    acc = a.groupBy("match_id").agg(F.avg("accel").alias("accel_mean")).join(percentiles(a, KEY, "_abs", {"accel_p95_abs": 0.95}), KEY, "left")
    return summarise(track, KEY, "speed", "speed_").join(acc, KEY, "left")


def hit_deltas(events: DataFrame) -> DataFrame:
    return events.filter("event_type = 'hit'").select("match_id", "frame_idx", F.col("speed_before").alias("before"), F.col("speed_after").alias("after"),
                                                      (F.col("speed_after") - F.col("speed_before")).alias("delta"))


def mean_hit_delta(events: DataFrame) -> DataFrame:
    return hit_deltas(events).groupBy("match_id").agg(F.avg("delta").alias("avg_delta"), F.count("delta").alias("n"))


# --- run level --------------------------------------------------------------------------------

def frame_table(track: DataFrame, homography: DataFrame, players: DataFrame) -> DataFrame:
    """Ball track joined per frame with calibration and both players (absent ones stay null)."""
    on = ["match_id", "frame_idx"]
    # both players of a frame come from one pass over the players
    side = lambda label, tag: [F.max(F.when(F.col("label") == label, v)).alias(n) for v, n in (
        (F.lit(True), f"has_{tag}"), (F.col("foot_x"), f"{tag}_x"), (F.col("foot_y"), f"{tag}_y"))]
    both = players.groupBy(*on).agg(*side("player_a", "a"), *side("player_b", "b"))
    d = track.join(homography.select(*on, "detected", "error", "confidence", "reliable", "carried"), on, "left").join(both, on, "left")
    return d.na.fill({"reliable": False, "carried": False, "has_a": False, "has_b": False})


def coverage_quality(frames: DataFrame, group: Sequence[str] = KEY) -> DataFrame:
    """Percentages of frames with ball, projection, calibration and players."""
    pct = lambda cond, name: (F.avg(cond.cast("double")) * 100).alias(name)
    return frames.groupBy(*group).agg(
        F.count(F.lit(1)).alias("frames_total"), pct(F.col("ball_px").isNotNull(), "ball_pct"), pct(F.col("cx").isNotNull(), "projected_pct"),
        pct(F.col("reliable"), "reliable_pct"), pct(F.col("has_a"), "a_pct"), pct(F.col("has_b"), "b_pct"),
        pct(F.col("has_a") & F.col("has_b"), "both_pct"))


def run_statistics(frames: DataFrame, located: DataFrame) -> DataFrame:
    """Counts and means of a run; ``located`` are the raw detections with the court test."""
    n = lambda cond, name: F.count_if(cond).alias(name)
    g = frames.groupBy("match_id").agg(
        F.count(F.lit(1)).alias("frames"), n(F.col("reliable"), "reliable_frames"), n(F.col("carried"), "carried_frames"),
        F.avg("confidence").alias("avg_confidence"), F.avg("error").alias("avg_error_px"), n(F.col("ball_px").isNotNull(), "ball_frames"),
        n(F.col("cx").isNotNull(), "projected_frames"), F.avg("speed").alias("avg_speed"), F.max("speed").alias("max_speed"),
        n(F.col("has_a"), "a_frames"), n(F.col("has_b"), "b_frames"), n(F.col("has_a") & F.col("has_b"), "both_frames"))
    med = percentiles(frames, KEY, "speed", {"median_speed": 0.5})
    raw = located.groupBy("match_id").agg(F.count(F.lit(1)).alias("raw_detections"), n(F.col("inside"), "kept_detections"))
    return g.join(med, KEY, "left").join(raw, KEY, "left").withColumn(
        "noise_pct", S.percent(F.col("raw_detections") - F.col("kept_detections"), "raw_detections"))


def event_statistics(events: DataFrame) -> DataFrame:
    hit, bounce = F.col("event_type") == "hit", F.col("event_type") == "bounce"
    n = lambda cond, name: F.count_if(cond).alias(name)
    return events.groupBy("match_id").agg(
        F.count(F.lit(1)).alias("events"), n(bounce, "bounces"), n(hit, "hits"), n(F.col("in_out") == "in", "bounces_in"),
        n(F.col("in_out") == "out", "bounces_out"), n(F.col("in_out") == "line", "bounces_line"), n(hit & F.col("player").isNotNull(), "hits_assigned"),
        F.avg(F.when(bounce, F.col("score"))).alias("avg_bounce_score"), F.avg(F.when(hit, F.col("score"))).alias("avg_hit_score"))


def point_statistics(points: DataFrame) -> DataFrame:
    kinds = [(kind, F.count_if(F.col("serve_fault_type") == kind)) for kind in ("long", "net", "wide")]
    return points.groupBy("match_id").agg(
        F.count(F.lit(1)).alias("points"), F.avg("rally_hit_count").alias("avg_hits"), F.max("rally_hit_count").alias("max_hits"),
        F.avg("confidence").alias("avg_confidence"), F.count("serve_fault_type").alias("faults"), F.count("serve_zone").alias("zoned"),
        F.concat_ws(", ", *[F.when(n > 0, F.concat(F.lit(f"{kind} "), n.cast("string"))) for kind, n in kinds]).alias("fault_types"))


def merged_statistics(frames: DataFrame, segments: DataFrame) -> DataFrame:
    """Counts over all segments of a match together with how many segments finished."""
    g = frames.groupBy("match_id").agg(F.count(F.lit(1)).alias("frames"), F.count("ball_px").alias("ball_frames"),
                                       F.countDistinct("segment_idx").alias("segments_seen"), F.avg("confidence").alias("avg_confidence"))
    done = segments.groupBy("match_id").agg(F.countDistinct(F.when(F.col("status") == "complete", F.col("segment_idx"))).alias("segments_done"))
    return g.join(done, KEY, "left")


# Per segment: what can be added up over segments, so that a new segment costs its own rows only.
SUMS = ("frames", "ball_frames", "reliable_frames", "confidence_sum", "confidence_n", "error_sum", "error_n", "speed_sum", "speed_n", "a_frames", "b_frames")


def segment_states(frames: DataFrame, keys: Sequence[str] = ("match_id", "segment_idx")) -> DataFrame:
    """Mergeable statistics of each segment of the frame table."""
    total = lambda c: [F.coalesce(F.sum(c), F.lit(0.0)).alias(f"{c}_sum"), F.count(c).alias(f"{c}_n")]
    return frames.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("frames"), F.count("ball_px").alias("ball_frames"), F.count_if("reliable").alias("reliable_frames"),
        *total("confidence"), *total("error"), *total("speed"), F.max("speed").alias("max_speed"), F.count_if("has_a").alias("a_frames"), F.count_if("has_b").alias("b_frames"))


def merged_states(states: DataFrame, segments: DataFrame) -> DataFrame:
    """Statistics of a match from the states of its segments; equal to those of all of its frames."""
    g = states.groupBy("match_id").agg(*[F.sum(c).alias(c) for c in SUMS], F.max("max_speed").alias("max_speed"), F.countDistinct("segment_idx").alias("segments_seen"))
    mean = lambda c: F.try_divide(F.col(f"{c}_sum"), F.col(f"{c}_n")).alias(f"avg_{c}")
    g = g.select("match_id", "frames", "ball_frames", "reliable_frames", "a_frames", "b_frames", "segments_seen", mean("confidence"), mean("error"), mean("speed"), "max_speed")
    done = segments.groupBy("match_id").agg(F.countDistinct(F.when(F.col("status") == "complete", F.col("segment_idx"))).alias("segments_done"))
    return g.join(done, KEY, "left")


def match_quality_report(frames: DataFrame, points: DataFrame, hits: DataFrame, positions: DataFrame) -> DataFrame:
    """Flagship: quality, serve, rally and movement of every match in one row."""
    m = movement(positions)
    side = lambda label, tag: m.filter(F.col("label") == label).select(
        "match_id", F.col("distance_m").alias(f"{tag}_distance_m"), F.col("speed_p95").alias(f"{tag}_speed_p95"))
    q = coverage_quality(frames)
    return (q.join(serve_depth_width(points).select("match_id", "samples", "fault_rate", "depth_median", "width_median"), KEY, "left")
            .join(rally_structure(points, hits), KEY, "left").join(side("player_a", "a"), KEY, "left").join(side("player_b", "b"), KEY, "left"))
