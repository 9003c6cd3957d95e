"""Joins and statistics."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rallyframe.operators import heatmaps, points, state, stats
from rallyframe.operators.quantiles import percentiles, summarise
from rallyframe.operators.scan import join_in_span
from rallyframe.plans.chain import Chain
from rallyframe.plans.registry import ORACLES, query
from rallyframe.session import pin, shared_folder
from rallyframe.streaming.commits import Batches


def rounded(df: DataFrame, *drop: str, digits: int = 6) -> DataFrame:
    """All doubles to ``digits`` decimals (and no negative zero)."""
    return df.drop(*drop).select(*[(F.round(f.name, digits) + 0.0).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
                                   for f in df.drop(*drop).schema])


class Tables(Chain):
    """Inputs of the statistics queries."""

    @property
    def serve_points(self):
        return stats.with_serve_calls(self.fx.points)

    @property
    def positions(self):
        return self.players.select("match_id", "label", "frame_idx", (F.col("frame_idx") / F.col("fps")).alias("t"), F.col("foot_x").alias("x"), F.col("foot_y").alias("y"))

    @property
    def frame_table(self):
        track = self.physics.select("match_id", "frame_idx", "ball_px", "cx", "cy", "speed", "accel").join(
            self.fx.frames.select("match_id", "frame_idx", "segment_idx", "t_sec"), ["match_id", "frame_idx"])
        return stats.frame_table(track, self.homography, self.players)


# --- shots --------------------------------------------------------------------------------------

@query("shot_mix", "AG-01", "SELECT match_id, owner, shot_type, n, ROUND(n * 100.0::DOUBLE / SUM(n) OVER (PARTITION BY match_id, owner), 6) AS pct FROM o_mix")
def shot_mix(fx):
    return rounded(stats.shot_mix(fx.shots))


@query("direction_mix", "AG-02 JN-10", """
WITH d AS (SELECT match_id, owner, COALESCE(shot_type, 'unknown') AS shot_type, CASE WHEN frame_idx % 5 = 3 OR direction IS NULL THEN 'unknown' ELSE direction END AS direction, COUNT(*) AS n FROM fx_shots GROUP BY 1, 2, 3, 4)
SELECT match_id, owner, shot_type, direction, n, ROUND(n * 100.0::DOUBLE / SUM(n) OVER (PARTITION BY match_id, owner, shot_type), 6) AS pct FROM d""")
def direction_mix(fx):
    shots, labels = fx.shots.drop("direction"), fx.shots.filter("frame_idx % 5 <> 3").select("match_id", "frame_idx", "direction")
    return rounded(stats.direction_mix(state.with_label(shots, labels, "direction")))


@query("shot_speed", "AG-03", "SELECT match_id, owner, COUNT(*) AS total_shots, ROUND(COALESCE(AVG(CASE WHEN speed_m_s > 0 THEN speed_m_s END), 0), 6) AS avg_speed FROM fx_shots GROUP BY 1, 2")
def shot_speed(fx):
    return rounded(stats.average_speed(fx.shots))


@query("match_summary_rollup", "AG-01", "SELECT match_id, owner, COALESCE(shot_type, 'unknown') AS shot_type, COUNT(*) AS n FROM (SELECT match_id, owner, COALESCE(shot_type, 'unknown') AS st FROM fx_shots) AS s(match_id, owner, st0), LATERAL (SELECT st0 AS shot_type) GROUP BY ROLLUP (match_id, owner, shot_type)"
       .replace("COALESCE(shot_type, 'unknown') AS shot_type, COUNT", "shot_type, COUNT"))
def match_summary_rollup(fx):
    return stats.match_summary_rollup(fx.shots)


@query("pattern_top5", "AG-12 SL-02", """
WITH r AS (SELECT *, n * 100.0::DOUBLE / SUM(n) OVER (PARTITION BY match_id, owner) AS pct, ROW_NUMBER() OVER (PARTITION BY match_id, owner ORDER BY n DESC, seen) AS rank FROM o_dirs)
SELECT match_id, owner, shot_type, direction, n, ROUND(pct, 6) AS pct, CAST(rank AS INTEGER) AS rank, shot_type || '_' || direction AS pattern FROM r WHERE rank <= 5""")
def pattern_top5(fx):
    return rounded(stats.pattern_top(fx.shots))


# --- joins of shots and points --------------------------------------------------------------------

@query("shots_in_points", "JN-03", "SELECT p.match_id, p.point_idx, s.frame_idx, s.owner FROM fx_points p JOIN fx_shots s ON s.match_id = p.match_id AND s.frame_idx BETWEEN p.start_frame AND p.end_frame")
def shots_in_points(fx):
    return points.rows_in_points(fx.shots.select("match_id", "frame_idx", "owner"), fx.points)


@query("last_shots", "JN-05", "SELECT match_id, point_idx, shots_in_point, last_owner, last_type, last_direction, last_speed, last_frame FROM o_last")
def last_shots(fx):
    return stats.last_shots(fx.shots, fx.points)


@query("point_winner", "AG-10", "SELECT match_id, point_idx, winner FROM o_winner")
def point_winner(fx):
    return stats.point_winners(fx.points, fx.shots).select("match_id", "point_idx", "winner")


@query("last_owner_by_time", "JN-06", "SELECT p.match_id, p.point_idx, b.last_hit_owner FROM fx_points p LEFT JOIN o_bytime b ON b.match_id = p.match_id AND b.point_idx = p.point_idx")
def last_owner_by_time(fx):
    return stats.last_owner_by_time(fx.points, fx.shots).select("match_id", "point_idx", "last_hit_owner")


@query("shot_error_attribution", "JN-07", """
SELECT s.match_id, s.frame_idx, s.owner FROM fx_shots s WHERE EXISTS (SELECT 1 FROM o_rebuilt p WHERE p.match_id = s.match_id AND p.is_error AND p.hitter = s.owner AND abs(s.timestamp_sec - p.end_sec) < 1.5)""")
def shot_error_attribution(fx):
    return stats.shot_error_attribution(fx.points, fx.shots).select("match_id", "frame_idx", "owner")


@query("low_confidence_overlap", "JN-08", """
WITH j AS (SELECT p.match_id, p.start_frame, p.end_frame, l.run_start, l.run_end, ROW_NUMBER() OVER (PARTITION BY p.match_id, p.start_frame ORDER BY l.run_start) AS k
  FROM fx_points p JOIN o_lowruns l ON l.match_id = p.match_id AND p.start_frame <= l.run_end AND p.end_frame >= l.run_start)
SELECT match_id, start_frame, end_frame, run_start, run_end, ROUND(GREATEST(0.3, 1 - CAST(LEAST(end_frame, run_end) - GREATEST(start_frame, run_start) + 1 AS DOUBLE) / (end_frame - start_frame + 1) * 0.5), 6) AS penalty FROM j WHERE k = 1""")
def low_confidence_overlap(fx):
    return rounded(points.first_overlap(fx.points, points.low_confidence_runs(Chain(fx).homography)))


@query("player_shots_in_points", "JN-21", """
SELECT p.match_id, p.point_idx, s.owner, COUNT(*) AS n FROM fx_points p JOIN fx_shots s ON s.match_id = p.match_id AND s.timestamp_sec >= p.start_sec AND s.timestamp_sec <= p.end_sec GROUP BY 1, 2, 3""")
def player_shots_in_points(fx):
    spans = fx.points.select("match_id", "point_idx", "start_sec", "end_sec")
    j = join_in_span(fx.shots.select("match_id", "owner", "timestamp_sec"), spans, ["match_id"], "timestamp_sec", "start_sec", "end_sec", width=8)
    return j.groupBy("match_id", "point_idx", "owner").agg(F.count(F.lit(1)).alias("n"))


@query("frame_table", "JN-09 IO-05", "SELECT match_id, frame_idx, ROUND(px, 6) AS ball_px, ROUND(cx, 3) AS cx, speed, ROUND(confidence, 6) AS confidence, reliable, carried, has_a, has_b FROM o_frame")
def frame_table(fx):
    return rounded(Tables(fx).frame_table.select("match_id", "frame_idx", "ball_px", F.round("cx", 3).alias("cx"), "speed", "confidence", "reliable", "carried", "has_a", "has_b"))


@query("bounce_call_at_frame", "JN-11", """
SELECT f.match_id, f.frame_idx, e.in_out FROM fx_frames f LEFT JOIN o_events e ON e.match_id = f.match_id AND e.frame_idx = f.frame_idx AND e.event_type = 'bounce'""")
def bounce_call_at_frame(fx):
    calls = Chain(fx).found.filter("event_type = 'bounce'").select("match_id", "frame_idx", "in_out")
    return state.with_label(fx.frames.select("match_id", "frame_idx"), calls, "in_out", None)


# --- errors, serves, rallies ------------------------------------------------------------------------

@query("error_by_shot_type", "AG-04", "SELECT match_id, owner, shot_type, errors, made, ROUND(rate, 6) AS rate FROM o_errtype")
def error_by_shot_type(fx):
    return rounded(stats.errors_by_type(fx.points, fx.shots), "first_at")


@query("error_by_rally", "AG-05", "SELECT match_id, owner, bucket, errors, played, ROUND(rate, 6) AS rate FROM o_errrally")
def error_by_rally(fx):
    return rounded(stats.errors_by_rally(fx.points, fx.shots))


@query("serve_summary", "AG-06", "SELECT match_id, owner, serves, ROUND(first_serve_pct, 6) AS first_serve_pct, double_faults FROM o_servesum")
def serve_summary(fx):
    return rounded(stats.serve_summary(Tables(fx).serve_points))


@query("double_faults", "WN-28", "SELECT match_id, serve_player, point_idx, double_fault FROM o_dfault")
def double_faults(fx):
    return stats.double_faults(Tables(fx).serve_points).select("match_id", "serve_player", "point_idx", "double_fault")


@query("serve_zone_win", "AG-07", "SELECT match_id, owner, zone, serves, ROUND(win_pct, 6) AS win_pct FROM o_zonewin")
def serve_zone_win(fx):
    return rounded(stats.serve_zone_wins(Tables(fx).serve_points))


@query("serve_placement", "AG-34", """
SELECT match_id, point_idx, bounce_cx AS court_x, bounce_cy AS court_y, serve_zone, serve_fault_type IS NOT NULL AS is_fault, serve_fault_type AS fault_type, serve_player FROM o_serve WHERE bounce_cx IS NOT NULL""")
def serve_placement(fx):
    return stats.serve_placement(Tables(fx).serve_points)


@query("rally_histogram", "AG-08", "SELECT match_id, bucket, COUNT(*) AS n, CAST(SUM(rally_hit_count) AS BIGINT) AS hits FROM o_bucketed GROUP BY 1, 2")
def rally_histogram(fx):
    return stats.rally_histogram(fx.points)


@query("rally_average", "AG-08", "SELECT match_id, COUNT(*) AS points, ROUND(AVG(rally_hit_count), 6) AS avg_hits FROM fx_points GROUP BY 1")
def rally_average(fx):
    return rounded(stats.rally_average(fx.points))


@query("match_flow", "AG-11", "SELECT match_id, point_idx, ROUND(start_sec, 6) AS timestamp_sec, rally_hit_count AS rally_length, end_reason, ROUND(end_sec - start_sec, 6) AS duration_sec FROM fx_points")
def match_flow(fx):
    return rounded(stats.match_flow(fx.points))


@query("points_by_end_reason", "AG-35", """
SELECT match_id, end_reason AS reason, COUNT(*) OVER (PARTITION BY match_id, end_reason) AS members, ROW_NUMBER() OVER (PARTITION BY match_id, end_reason ORDER BY point_idx) AS member_no, point_idx FROM fx_points""")
def points_by_end_reason(fx):
    return stats.by_end_reason(fx.points)


@query("end_reason_counts", "AG-17 AG-24", "SELECT match_id, end_reason, COUNT(*) AS n FROM fx_points GROUP BY 1, 2")
def end_reason_counts(fx):
    return stats.end_reason_counts(fx.points)


@query("points_won_lost", "AG-13", "SELECT match_id, owner, points_won, points_lost FROM o_won")
def points_won_lost(fx):
    return stats.points_won_lost(fx.points, fx.shots)


@query("rebuilt_players", "AG-14", """
WITH p AS (SELECT match_id, owner, ball_cx, ball_cy, sqrt(POWER(ball_cx - LAG(ball_cx) OVER w, 2) + POWER(ball_cy - LAG(ball_cy) OVER w, 2)) AS d, speed_m_s FROM fx_shots WINDOW w AS (PARTITION BY match_id, owner ORDER BY frame_idx)),
s AS (SELECT match_id, owner, COUNT(*) AS total_shots, COALESCE(AVG(CASE WHEN speed_m_s > 0 THEN speed_m_s END), 0) AS avg_speed, COALESCE(SUM(d), 0) AS distance, AVG(ball_cx) AS centre_x, AVG(ball_cy) AS centre_y FROM p GROUP BY 1, 2)
SELECT w.match_id, w.owner, COALESCE(s.total_shots, 0) AS total_shots, ROUND(COALESCE(s.avg_speed, 0), 6) AS avg_speed, w.points_won, w.points_lost, v.serves, ROUND(v.first_serve_pct, 6) AS first_serve_pct, v.double_faults,
  ROUND(s.distance, 4) AS distance, ROUND(s.centre_x, 6) AS centre_x, ROUND(s.centre_y, 6) AS centre_y
FROM o_won w LEFT JOIN s ON s.match_id = w.match_id AND s.owner = w.owner LEFT JOIN o_servesum v ON v.match_id = w.match_id AND v.owner = w.owner""")
def rebuilt_players(fx):
    return rounded(stats.rebuilt_players(Tables(fx).serve_points, fx.shots).withColumn("distance", F.round("distance", 4)))


@query("rebuilt_error_rates", "AG-14 JN-07", """
WITH e AS (SELECT s.match_id, s.owner, COALESCE(s.shot_type, 'unknown') AS shot_type, COUNT(*) AS errors FROM fx_shots s WHERE EXISTS (SELECT 1 FROM o_rebuilt p WHERE p.match_id = s.match_id AND p.is_error AND p.hitter = s.owner AND abs(s.timestamp_sec - p.end_sec) < 1.5) GROUP BY 1, 2, 3)
SELECT e.match_id, e.owner, e.shot_type, m.n AS made, e.errors, ROUND(e.errors * 100.0::DOUBLE / m.n, 6) AS rate FROM e JOIN o_mix m ON m.match_id = e.match_id AND m.owner = e.owner AND m.shot_type = e.shot_type""")
def rebuilt_error_rates(fx):
    return rounded(stats.rebuilt_errors_by_type(fx.points, fx.shots), "first_at")


@query("rebuilt_error_by_rally", "AG-14", """
WITH b AS (SELECT r.*, k.bucket FROM o_rebuilt r JOIN o_bucketed k ON k.match_id = r.match_id AND k.point_idx = r.point_idx), t AS (SELECT match_id, bucket, COUNT(*) AS played FROM b GROUP BY 1, 2)
SELECT b.match_id, b.hitter AS owner, b.bucket, COUNT(*) AS errors, ANY_VALUE(t.played) AS played, ROUND(COUNT(*) * 100.0::DOUBLE / ANY_VALUE(t.played), 6) AS rate FROM b JOIN t ON t.match_id = b.match_id AND t.bucket = b.bucket WHERE is_error GROUP BY 1, 2, 3""")
def rebuilt_error_by_rally(fx):
    return rounded(stats.rebuilt_errors_by_rally(fx.points, fx.shots))


@query("rebuilt_zone_win", "AG-14", "SELECT match_id, serve_player AS owner, COALESCE(serve_zone, 'unknown') AS zone, COUNT(*) AS serves, ROUND(AVG(CASE WHEN winner = serve_player THEN 100.0::DOUBLE ELSE 0 END), 6) AS win_pct FROM o_rebuilt GROUP BY 1, 2, 3")
def rebuilt_zone_win(fx):
    return rounded(stats.rebuilt_zone_wins(Tables(fx).serve_points, fx.shots))


# --- samples and summaries ----------------------------------------------------------------------------

_FIVE = "ROUND(AVG({v}), 6) AS {p}mean, ROUND(MAX({v}), 6) AS {p}max, ROUND(quantile_cont({v}, 0.5), 6) AS {p}median, ROUND(quantile_cont({v}, 0.9), 6) AS {p}p90, ROUND(quantile_cont({v}, 0.95), 6) AS {p}p95"


@query("speed_summary", "AG-15", f"SELECT match_id, owner, {_FIVE.format(v='speed_m_s', p='speed_')}, COUNT(speed_m_s) AS speed_n FROM fx_shots WHERE speed_m_s IS NOT NULL GROUP BY 1, 2")
def speed_summary(fx):
    return rounded(summarise(fx.shots, ["match_id", "owner"], "speed_m_s", "speed_"))


@query("serve_depth_width", "AG-16", f"""
WITH s AS (SELECT match_id, serve_fault_type, abs(CASE WHEN COALESCE(serve_zone LIKE 'near%', FALSE) OR bounce_cy >= 1748 THEN 2386 ELSE 1110 END - bounce_cy) * (10.97::DOUBLE / 1117) AS d, abs(bounce_cx - 832) * (10.97::DOUBLE / 1117) AS w FROM o_serve WHERE bounce_cx IS NOT NULL)
SELECT match_id, COUNT(*) AS samples, ROUND(AVG(CASE WHEN serve_fault_type IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END), 6) AS fault_rate, {_FIVE.format(v='d', p='depth_')}, {_FIVE.format(v='w', p='width_')} FROM s GROUP BY 1""")
def serve_depth_width(fx):
    return rounded(stats.serve_depth_width(Tables(fx).serve_points))


@query("serve_samples", "AG-16", """
SELECT match_id, point_idx, serve_zone, serve_fault_type, ROUND(abs(CASE WHEN COALESCE(serve_zone LIKE 'near%', FALSE) OR bounce_cy >= 1748 THEN 2386 ELSE 1110 END - bounce_cy) * (10.97::DOUBLE / 1117), 6) AS depth_m, ROUND(abs(bounce_cx - 832) * (10.97::DOUBLE / 1117), 6) AS width_m FROM o_serve WHERE bounce_cx IS NOT NULL""")
def serve_samples(fx):
    return rounded(stats.serve_samples(Tables(fx).serve_points))


@query("rally_structure", "AG-17 WN-38", """
WITH p AS (SELECT match_id, AVG(rally_hit_count) AS h, AVG(end_sec - start_sec) AS d, AVG(rally_hit_count / (end_sec - start_sec)) AS hs FROM fx_points GROUP BY 1),
i AS (SELECT match_id, timestamp_sec - LAG(timestamp_sec) OVER (PARTITION BY match_id ORDER BY frame_idx) AS iv FROM fx_shots),
j AS (SELECT match_id, AVG(iv) AS m, quantile_cont(iv, 0.95) AS q FROM i WHERE iv > 0 GROUP BY 1)
SELECT p.match_id, ROUND(h, 6) AS avg_hits, ROUND(d, 6) AS avg_duration, ROUND(hs, 6) AS hits_per_sec, ROUND(m, 6) AS mean_inter_hit, ROUND(q, 6) AS p95_inter_hit FROM p LEFT JOIN j ON j.match_id = p.match_id""")
def rally_structure(fx):
    return rounded(stats.rally_structure(fx.points, fx.shots))


@query("inter_hit_intervals", "WN-38", """
SELECT match_id, frame_idx, ROUND(iv, 6) AS interval FROM (SELECT match_id, frame_idx, timestamp_sec - LAG(timestamp_sec) OVER (PARTITION BY match_id ORDER BY frame_idx) AS iv FROM fx_shots) WHERE iv > 0""")
def inter_hit_intervals(fx):
    return rounded(stats.inter_hit(fx.shots).select("match_id", "frame_idx", "interval"))


_OUT = "sqrt(POWER(GREATEST(423 - cx, 0, cx - 1242), 2) + POWER(GREATEST(561 - cy, 0, cy - 2935), 2)) * (10.97::DOUBLE / 1117)"


@query("out_ball_stats", "AG-18", f"SELECT match_id, {_FIVE.format(v='v', p='out_')}, COUNT(*) AS out_count FROM (SELECT match_id, {_OUT} AS v FROM o_events WHERE event_type = 'bounce' AND in_out = 'out') GROUP BY 1")
def out_ball_stats(fx):
    return rounded(stats.out_ball_stats(Chain(fx).found))


@query("out_ball_positions", "AG-18", f"SELECT match_id, frame_idx, ROUND(cx, 3) AS cx, ROUND(cy, 3) AS cy, ROUND({_OUT}, 4) AS out_m FROM o_events WHERE event_type = 'bounce' AND in_out = 'out'")
def out_ball_positions(fx):
    return stats.out_ball_samples(Chain(fx).found).select("match_id", "frame_idx", *[(F.round(c, n) + 0.0).alias(c) for c, n in (("cx", 3), ("cy", 3), ("out_m", 4))])


@query("court_coverage", "AG-09", "SELECT match_id, label, ROUND(distance, 3) AS distance, ROUND(centre_x, 6) AS centre_x, ROUND(centre_y, 6) AS centre_y, n FROM o_cover")
def court_coverage(fx):
    return rounded(stats.court_coverage(Tables(fx).positions).withColumn("distance", F.round("distance", 3)))


@query("movement_samples", "WN-39", """
SELECT match_id, label, frame_idx, ROUND(sqrt(POWER(x - px, 2) + POWER(y - py, 2)) * (10.97::DOUBLE / 1117) / (t - pt), 5) AS speed
FROM (SELECT *, LAG(x) OVER w AS px, LAG(y) OVER w AS py, LAG(t) OVER w AS pt FROM o_pos WHERE x IS NOT NULL WINDOW w AS (PARTITION BY match_id, label ORDER BY frame_idx)) WHERE t - pt > 0 AND t - pt <= 0.5""")
def movement_samples(fx):
    return stats.movement_samples(Tables(fx).positions).select("match_id", "label", "frame_idx", F.round("speed", 5).alias("speed"))


@query("movement_stats", "AG-19 SC-23", f"""
WITH s AS (SELECT match_id, label, sqrt(POWER(x - px, 2) + POWER(y - py, 2)) * (10.97::DOUBLE / 1117) AS m, sqrt(POWER(x - px, 2) + POWER(y - py, 2)) * (10.97::DOUBLE / 1117) / (t - pt) AS v
  FROM (SELECT *, LAG(x) OVER w AS px, LAG(y) OVER w AS py, LAG(t) OVER w AS pt FROM o_pos WHERE x IS NOT NULL WINDOW w AS (PARTITION BY match_id, label ORDER BY frame_idx)) WHERE t - pt > 0 AND t - pt <= 0.5),
z AS (SELECT match_id, label, COUNT(*) AS positions, ROUND(AVG(CASE WHEN abs(y - 1748) <= 200 THEN 100.0::DOUBLE ELSE 0 END), 6) AS net_pct,
   ROUND(AVG(CASE WHEN abs(y - 1748) > 200 AND (y <= 1110 OR y >= 2386) THEN 100.0::DOUBLE ELSE 0 END), 6) AS baseline_pct, ROUND(AVG(CASE WHEN abs(y - 1748) > 200 AND y > 1110 AND y < 2386 THEN 100.0::DOUBLE ELSE 0 END), 6) AS mid_pct FROM o_pos WHERE x IS NOT NULL GROUP BY 1, 2),
g AS (SELECT match_id, label, ROUND(SUM(m), 4) AS distance_m, {_FIVE.format(v='v', p='speed_')}, COUNT(*) AS speed_n FROM s GROUP BY 1, 2)
SELECT z.*, g.* EXCLUDE (match_id, label) FROM z JOIN g ON g.match_id = z.match_id AND g.label = z.label""")
def movement_stats(fx):
    return rounded(stats.movement(pin(Tables(fx).positions)).withColumn("distance_m", F.round("distance_m", 4)))


@query("ball_pace", "AG-20", f"""
SELECT match_id, {_FIVE.format(v='speed', p='speed_')}, COUNT(speed) AS speed_n, ROUND(AVG(accel), 6) AS accel_mean, ROUND(quantile_cont(abs(accel), 0.95), 6) AS accel_p95_abs FROM o_physics GROUP BY 1""")
def ball_pace(fx):
    return rounded(stats.ball_pace(pin(Chain(fx).physics.select("match_id", "speed", "accel"))))


@query("hit_speed_deltas", "AG-20 AG-39", "SELECT match_id, COUNT(speed_after - speed_before) AS n, ROUND(AVG(speed_after - speed_before), 6) AS avg_delta FROM o_events WHERE event_type = 'hit' GROUP BY 1")
def hit_speed_deltas(fx):
    return rounded(stats.mean_hit_delta(Chain(fx).found))


@query("coverage_quality", "AG-21", """
SELECT match_id, COUNT(*) AS frames_total, ROUND(AVG(CASE WHEN px IS NOT NULL THEN 100.0::DOUBLE ELSE 0 END), 6) AS ball_pct, ROUND(AVG(CASE WHEN cx IS NOT NULL THEN 100.0::DOUBLE ELSE 0 END), 6) AS projected_pct,
  ROUND(AVG(CASE WHEN reliable THEN 100.0::DOUBLE ELSE 0 END), 6) AS reliable_pct, ROUND(AVG(CASE WHEN has_a THEN 100.0::DOUBLE ELSE 0 END), 6) AS a_pct, ROUND(AVG(CASE WHEN has_b THEN 100.0::DOUBLE ELSE 0 END), 6) AS b_pct,
  ROUND(AVG(CASE WHEN has_a AND has_b THEN 100.0::DOUBLE ELSE 0 END), 6) AS both_pct FROM o_frame GROUP BY 1""")
def coverage_quality(fx):
    return rounded(stats.coverage_quality(Tables(fx).frame_table))


@query("coverage_per_slice", "SR-05 AG-21", """
SELECT match_id, CAST(floor(t_sec / 10) AS BIGINT) AS slice, COUNT(*) AS frames, ROUND(AVG(CASE WHEN ball_px IS NOT NULL THEN 100.0::DOUBLE ELSE 0 END), 6) AS ball_pct FROM fx_frames GROUP BY 1, 2""")
def coverage_per_slice(fx):
    return rounded(fx.frames.groupBy("match_id", F.floor(F.col("t_sec") / 10).alias("slice")).agg(
        F.count(F.lit(1)).alias("frames"), (F.avg(F.col("ball_px").isNotNull().cast("double")) * 100).alias("ball_pct")))


@query("sliding_pace", "SR-06", """
WITH p AS (SELECT match_id, frame_idx, speed_m_s, timestamp_sec FROM fx_shots WHERE speed_m_s IS NOT NULL)
SELECT match_id, CAST(w AS BIGINT) AS window_start, COUNT(*) AS n, ROUND(AVG(speed_m_s), 6) AS avg_speed FROM p, UNNEST([floor(timestamp_sec), floor(timestamp_sec) - 1, floor(timestamp_sec) - 2]) AS u(w) GROUP BY 1, 2""")
def sliding_pace(fx):
    s = fx.shots.filter("speed_m_s IS NOT NULL").withColumn("ts", F.timestamp_seconds("timestamp_sec"))
    return rounded(s.groupBy("match_id", F.window("ts", "3 seconds", "1 second").alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("speed_m_s").alias("avg_speed")).select("match_id", F.col("w.start").cast("bigint").alias("window_start"), "n", "avg_speed"))


@query("run_statistics", "AG-22", """
WITH d AS (SELECT match_id, COUNT(*) AS raw_detections, COUNT(*) FILTER (inside) AS kept_detections FROM o_located GROUP BY 1)
SELECT f.match_id, COUNT(*) AS frames, COUNT(*) FILTER (reliable) AS reliable_frames, COUNT(*) FILTER (carried) AS carried_frames, ROUND(AVG(confidence), 6) AS avg_confidence, ROUND(AVG(error), 6) AS avg_error_px,
  COUNT(px) AS ball_frames, COUNT(cx) AS projected_frames, ROUND(AVG(speed), 6) AS avg_speed, MAX(speed) AS max_speed, COUNT(*) FILTER (has_a) AS a_frames, COUNT(*) FILTER (has_b) AS b_frames, COUNT(*) FILTER (has_a AND has_b) AS both_frames,
  ROUND(quantile_cont(speed, 0.5), 6) AS median_speed, ANY_VALUE(d.raw_detections) AS raw_detections, ANY_VALUE(d.kept_detections) AS kept_detections,
  ROUND((ANY_VALUE(d.raw_detections) - ANY_VALUE(d.kept_detections)) * 100.0::DOUBLE / ANY_VALUE(d.raw_detections), 6) AS noise_pct
FROM o_frame f JOIN d ON d.match_id = f.match_id GROUP BY 1""")
def run_statistics(fx):
    t = Tables(fx)
    return rounded(stats.run_statistics(pin(t.frame_table), t.located))


@query("event_statistics", "AG-23", """
SELECT match_id, COUNT(*) AS events, COUNT(*) FILTER (event_type = 'bounce') AS bounces, COUNT(*) FILTER (event_type = 'hit') AS hits, COUNT(*) FILTER (in_out = 'in') AS bounces_in, COUNT(*) FILTER (in_out = 'out') AS bounces_out,
  COUNT(*) FILTER (in_out = 'line') AS bounces_line, COUNT(player) FILTER (event_type = 'hit') AS hits_assigned, ROUND(AVG(score) FILTER (event_type = 'bounce'), 9) AS avg_bounce_score, ROUND(AVG(score) FILTER (event_type = 'hit'), 9) AS avg_hit_score FROM o_events GROUP BY 1""")
def event_statistics(fx):
    return rounded(stats.event_statistics(Chain(fx).events), digits=9)


@query("point_statistics", "AG-24", """
SELECT match_id, COUNT(*) AS points, ROUND(AVG(rally_hit_count), 6) AS avg_hits, MAX(rally_hit_count) AS max_hits, ROUND(AVG(confidence), 6) AS avg_confidence, COUNT(serve_fault_type) AS faults, COUNT(serve_zone) AS zoned,
  concat_ws(', ', CASE WHEN COUNT(*) FILTER (serve_fault_type = 'long') > 0 THEN 'long ' || COUNT(*) FILTER (serve_fault_type = 'long') END, CASE WHEN COUNT(*) FILTER (serve_fault_type = 'net') > 0 THEN 'net ' || COUNT(*) FILTER (serve_fault_type = 'net') END,
    CASE WHEN COUNT(*) FILTER (serve_fault_type = 'wide') > 0 THEN 'wide ' || COUNT(*) FILTER (serve_fault_type = 'wide') END) AS fault_types FROM o_serve GROUP BY 1""")
def point_statistics(fx):
    return rounded(stats.point_statistics(Tables(fx).serve_points))


@query("merged_statistics", "AG-25 SO-01", """
WITH s AS (SELECT match_id, COUNT(DISTINCT segment_idx) FILTER (status = 'complete') AS segments_done FROM fx_segments GROUP BY 1)
SELECT f.match_id, COUNT(*) AS frames, COUNT(ball_px) AS ball_frames, COUNT(DISTINCT segment_idx) AS segments_seen, ROUND(AVG(h.confidence), 6) AS avg_confidence, ANY_VALUE(s.segments_done) AS segments_done
FROM fx_frames f JOIN o_hom h ON h.match_id = f.match_id AND h.frame_idx = f.frame_idx JOIN s ON s.match_id = f.match_id GROUP BY 1""")
def merged_statistics(fx):
    f = fx.frames.select("match_id", "frame_idx", "segment_idx", "ball_px").join(Chain(fx).homography.select("match_id", "frame_idx", "confidence"), ["match_id", "frame_idx"])
    return rounded(stats.merged_statistics(f, fx.segments))


@query("merged_from_segments", "AG-25 AG-22 SO-01", """
WITH s AS (SELECT match_id, COUNT(DISTINCT segment_idx) FILTER (status = 'complete') AS segments_done FROM fx_segments GROUP BY 1)
SELECT f.match_id, COUNT(*) AS frames, COUNT(px) AS ball_frames, COUNT(*) FILTER (reliable) AS reliable_frames, COUNT(*) FILTER (has_a) AS a_frames, COUNT(*) FILTER (has_b) AS b_frames, COUNT(DISTINCT segment_idx) AS segments_seen,
  ROUND(AVG(confidence), 5) AS avg_confidence, ROUND(AVG(error), 4) AS avg_error, ROUND(AVG(speed), 5) AS avg_speed, MAX(speed) AS max_speed, ANY_VALUE(s.segments_done) AS segments_done FROM o_frame f LEFT JOIN s ON s.match_id = f.match_id GROUP BY 1""")
def merged_from_segments(fx):
    """Segments arrive in three parts; each leaves the states of its own segments, and the match is put together from those."""
    frames, folder = pin(Tables(fx).frame_table), shared_folder(fx.spark, "states")
    table = Batches(fx.spark, folder)
    for k in range(3):
        table.append(stats.segment_states(frames.where(F.col("segment_idx") % 3 == k)), 0, k)
    d = stats.merged_states(table.read(stats.segment_states(frames).schema), fx.segments)
    return d.withColumns({"avg_confidence": F.round("avg_confidence", 5), "avg_error": F.round("avg_error", 4), "avg_speed": F.round("avg_speed", 5)})


# --- heatmaps -------------------------------------------------------------------------------------------

def _bin(v, lo, hi, n):
    return f"CAST(LEAST(floor(({v} - {lo}) / (({hi} - {lo})::DOUBLE / {n})), {n - 1}) AS BIGINT)"


@query("ball_heatmap", "AG-26", f"SELECT match_id, {_bin('cx', 286, 1379, 19)} AS xb, {_bin('cy', 561, 2935, 29)} AS yb, COUNT(*) AS n FROM o_physics WHERE cx BETWEEN 286 AND 1379 AND cy BETWEEN 561 AND 2935 GROUP BY 1, 2, 3")
def ball_heatmap(fx):
    return heatmaps.ball_heatmap(Chain(fx).physics)


@query("speed_histogram", "AG-27", """
WITH h AS (SELECT match_id, CAST(LEAST(floor(speed * 3.6 / 10), 23) AS BIGINT) AS bin, COUNT(*) AS n FROM o_physics WHERE speed < 200 AND speed * 3.6 <= 240 GROUP BY 1, 2)
SELECT m.match_id, b.bin, COALESCE(h.n, 0) AS n, b.bin * 10 AS from_kmh FROM (SELECT DISTINCT match_id FROM o_physics WHERE speed < 200) m CROSS JOIN (SELECT UNNEST(range(24)) AS bin) b LEFT JOIN h ON h.match_id = m.match_id AND h.bin = b.bin""")
def speed_histogram(fx):
    return heatmaps.speed_histogram(pin(Chain(fx).physics.select("match_id", "speed")))


@query("speed_kmh_summary", "AG-27", "SELECT match_id, ROUND(AVG(speed * 3.6::DOUBLE), 6) AS kmh_mean, ROUND(quantile_cont(speed * 3.6::DOUBLE, 0.5), 6) AS kmh_median, ROUND(quantile_cont(speed * 3.6::DOUBLE, 0.95), 6) AS kmh_p95 FROM o_physics WHERE speed < 200 GROUP BY 1")
def speed_kmh_summary(fx):
    s = pin(Chain(fx).physics.filter("speed < 200").select("match_id", (F.col("speed") * 3.6).alias("kmh")))
    m = s.groupBy("match_id").agg(F.avg("kmh").alias("kmh_mean"))
    return rounded(m.join(percentiles(s, ["match_id"], "kmh", {"kmh_median": 0.5, "kmh_p95": 0.95}), "match_id"))


@query("out_ball_heatmap", "AG-28", f"SELECT match_id, {_bin('cx', 86, 1579, 19)} AS xb, {_bin('cy', 361, 3135, 29)} AS yb, COUNT(*) AS n FROM o_events WHERE event_type = 'bounce' AND in_out = 'out' AND cx BETWEEN 86 AND 1579 AND cy BETWEEN 361 AND 3135 GROUP BY 1, 2, 3")
def out_ball_heatmap(fx):
    return heatmaps.out_ball_heatmap(Chain(fx).found)


@query("player_heatmap", "AG-29", f"SELECT match_id, label, {_bin('foot_x', 286, 1379, 14)} AS xb, {_bin('foot_y', 561, 2935, 19)} AS yb, COUNT(*) AS n FROM o_players WHERE foot_x BETWEEN 286 AND 1379 AND foot_y BETWEEN 561 AND 2935 GROUP BY 1, 2, 3, 4")
def player_heatmap(fx):
    return heatmaps.player_heatmaps(Chain(fx).players)


@query("auto_heatmap", "AG-30", """
WITH r AS (SELECT match_id, ball_cx AS x, ball_cy AS y, MIN(ball_cx) OVER p AS x0, MAX(ball_cx) OVER p AS x1, MIN(ball_cy) OVER p AS y0, MAX(ball_cy) OVER p AS y1 FROM fx_frames WHERE ball_cx IS NOT NULL WINDOW p AS (PARTITION BY match_id))
SELECT match_id, CAST(LEAST(floor((x - x0) / ((x1 - x0) / 10)), 9) AS BIGINT) AS xb, CAST(LEAST(floor((y - y0) / ((y1 - y0) / 15)), 14) AS BIGINT) AS yb, COUNT(*) AS n FROM r GROUP BY 1, 2, 3""")
def auto_heatmap(fx):
    return heatmaps.auto_heatmap(fx.frames, "ball_cx", "ball_cy")


_SETS = """
WITH n AS (SELECT match_id, COUNT(*) AS n FROM fx_frames GROUP BY 1),
g AS (SELECT f.match_id, f.frame_idx, LEAST(f.frame_idx // (n.n // 3), 2) AS set_no FROM fx_frames f JOIN n ON n.match_id = f.match_id),
cells AS (SELECT g.match_id, g.set_no, LEAST(CAST(floor(b.cx * 64) AS BIGINT), 63) AS xb, LEAST(CAST(floor(b.cy * 64) AS BIGINT), 63) AS yb, COUNT(*) AS n FROM g JOIN fx_boxes b ON b.match_id = g.match_id AND b.frame_idx = g.frame_idx AND b.class_id = 0 GROUP BY 1, 2, 3, 4)
"""


@query("set_density", "AG-31", _SETS + "SELECT * FROM cells")
def set_density(fx):
    return heatmaps.set_density(fx.boxes, fx.frames)


@query("set_density_blurred", "AG-31 SC-35", _SETS + """,
t(o, w) AS (VALUES (-3, 0.03125::DOUBLE), (-2, 0.109375::DOUBLE), (-1, 0.21875::DOUBLE), (0, 0.28125::DOUBLE), (1, 0.21875::DOUBLE), (2, 0.109375::DOUBLE), (3, 0.03125::DOUBLE)),
k AS (SELECT p.p, CASE WHEN p.p + t.o < 0 THEN -(p.p + t.o) WHEN p.p + t.o > 63 THEN 126 - (p.p + t.o) ELSE p.p + t.o END AS src, t.w FROM (SELECT UNNEST(range(64)) AS p) p CROSS JOIN t),
b AS (SELECT c.match_id, c.set_no, kx.p AS xb, ky.p AS yb, SUM(c.n * kx.w * ky.w) AS heat FROM cells c JOIN k kx ON kx.src = c.xb JOIN k ky ON ky.src = c.yb GROUP BY 1, 2, 3, 4)
SELECT match_id, set_no, xb, yb, ROUND(heat / MAX(heat) OVER (PARTITION BY match_id, set_no), 6) AS density FROM b""")
def set_density_blurred(fx):
    return rounded(heatmaps.blurred_density(heatmaps.set_density(fx.boxes, fx.frames)).select("match_id", "set_no", "xb", "yb", "density"))


@query("match_report", "AG-15 AG-16 AG-17 AG-19 AG-21", f"""
WITH q AS ({ORACLES['coverage_quality']}), s AS ({ORACLES['serve_depth_width']}), r AS ({ORACLES['rally_structure']}), m AS ({ORACLES['movement_stats']})
SELECT q.*, s.samples, s.fault_rate, s.depth_median, s.width_median, r.* EXCLUDE (match_id), a.distance_m AS a_distance_m, a.speed_p95 AS a_speed_p95, b.distance_m AS b_distance_m, b.speed_p95 AS b_speed_p95
FROM q LEFT JOIN s ON s.match_id = q.match_id LEFT JOIN r ON r.match_id = q.match_id LEFT JOIN m a ON a.match_id = q.match_id AND a.label = 'player_a' LEFT JOIN m b ON b.match_id = q.match_id AND b.label = 'player_b'""")
def match_report(fx):
    """Flagship: quality, serve, rally and movement of both players, every column of the report."""
    t = Tables(fx)
    t.players = pin(t.players)
    r = stats.match_quality_report(pin(t.frame_table), t.serve_points, fx.shots, t.positions)
    return rounded(r.withColumns({c: F.round(c, 4) for c in ("a_distance_m", "b_distance_m")}))
