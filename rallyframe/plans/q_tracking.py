"""Track cleaning, calibration, players, events, contacts and points."""
from __future__ import annotations

from pyspark.sql import functions as F

from rallyframe.operators import calibrate, events, greedy, players, points, shots, tracking
from rallyframe.plans.chain import Chain
from rallyframe.plans.registry import query

R6 = lambda c: F.round(c, 6).alias(c)
# Values behind a fitted matrix: two ways of solving it agree to about 1e-9, so they are compared to three decimals.
R3 = lambda c: (F.round(c, 3) + 0.0).alias(c)
ZERO = lambda c: (F.col(c) + 0.0).alias(c)


@query("track_distances", "WN-01", "SELECT match_id, frame_idx, ROUND(d, 6) AS dist FROM o_dist")
def track_distances(fx):
    return tracking.frame_distances(fx.frames.select("match_id", "frame_idx", "ball_px", "ball_py")).select("match_id", "frame_idx", R6("dist"))


@query("track_outliers", "WN-02", "SELECT match_id, frame_idx, px AS ball_px, py AS ball_py FROM o_noout")
def track_outliers(fx):
    return tracking.remove_outliers(fx.frames.select("match_id", "frame_idx", "ball_px", "ball_py"))


@query("sub_tracks", "WN-03", "SELECT match_id, track_start, track_end FROM o_subtracks")
def sub_tracks(fx):
    d = tracking.sub_tracks(fx.frames.select("match_id", "frame_idx", "ball_px", "ball_py"))
    return d.filter("frame_idx = track_start").select("match_id", "track_start", "track_end")


@query("track_interpolated", "WN-04 WN-05", "SELECT match_id, frame_idx, ROUND(px, 6) AS ball_px, ROUND(py, 6) AS ball_py FROM o_clean")
def track_interpolated(fx):
    return Chain(fx).clean.select("match_id", "frame_idx", R6("ball_px"), R6("ball_py"))


@query("ball_physics", "WN-06 SC-07", "SELECT match_id, frame_idx, ROUND(cx, 3) + 0 AS cx, ROUND(cy, 3) + 0 AS cy, speed + 0 AS speed, accel + 0 AS accel FROM o_physics")
def ball_physics(fx):
    return Chain(fx).physics.select("match_id", "frame_idx", R3("cx"), R3("cy"), ZERO("speed"), ZERO("accel"))


@query("smoothed_track", "WN-07 WN-08 WN-10", """
SELECT match_id, frame_idx, ROUND(AVG(ball_cy) OVER (w ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) AS cy_smooth,
  ROUND(AVG(ball_cx) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 6) AS "before", ROUND(AVG(ball_cx) OVER (w ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), 6) AS "after",
  BOOL_OR(ball_cx IS NULL) OVER (w ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS gap
FROM fx_frames WINDOW w AS (PARTITION BY match_id ORDER BY frame_idx)""")
def smoothed_track(fx):
    d = tracking.smooth(fx.frames.select("match_id", "frame_idx", "ball_cx", "ball_cy"), "ball_cy", "cy_smooth")
    d = tracking.tracking_gap(tracking.side_averages(d, "ball_cx"), "ball_cx")
    return d.select("match_id", "frame_idx", R6("cy_smooth"), R6("before"), R6("after"), "gap")


@query("direction_means", "WN-09", """
WITH d AS (SELECT match_id, frame_idx, degrees(atan2(ball_cy - LAG(ball_cy) OVER w, ball_cx - LAG(ball_cx) OVER w)) AS a FROM fx_frames WINDOW w AS (PARTITION BY match_id ORDER BY frame_idx))
SELECT match_id, frame_idx, ROUND(CASE WHEN COUNT(a) OVER p > 0 THEN degrees(atan2(SUM(sin(radians(a))) OVER p, SUM(cos(radians(a))) OVER p)) END, 4) AS mean_before
FROM d WINDOW p AS (PARTITION BY match_id ORDER BY frame_idx ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)""")
def direction_means(fx):
    from rallyframe.operators.scan import bounded
    def local(d, w):
        a = F.degrees(F.atan2(F.col("ball_cy") - F.lag("ball_cy").over(w), F.col("ball_cx") - F.lag("ball_cx").over(w)))
        d = d.withColumn("_a", a)
        return d.withColumn("mean_before", tracking.circular_mean(F.col("_a"), w.rowsBetween(-3, -1)))
    d = bounded(fx.frames.select("match_id", "frame_idx", "ball_cx", "ball_cy"), ["match_id"], "frame_idx", 4, 0, local)
    return d.select("match_id", "frame_idx", F.round("mean_before", 4).alias("mean_before"))


_EV = "match_id, frame_idx, timestamp_sec, ROUND(cx, 3) AS cx, ROUND(cy, 3) AS cy, speed_before, speed_after, score, court_side"


def _event_columns():
    return ["match_id", "frame_idx", "timestamp_sec", R3("cx"), R3("cy"), "speed_before", "speed_after", "score", "court_side"]



@query("bounce_candidates", "WN-11", f"SELECT {_EV}, in_out FROM o_cand WHERE event_type = 'bounce'")
def bounce_candidates(fx):
    return Chain(fx).candidates.filter("event_type = 'bounce'").select(*_event_columns(), "in_out")


@query("hit_candidates", "WN-12", f"SELECT {_EV}, turn_deg FROM o_cand WHERE event_type = 'hit'")
def hit_candidates(fx):
    return Chain(fx).candidates.filter("event_type = 'hit'").select(*_event_columns(), "turn_deg")


@query("event_nms", "WN-13", "SELECT match_id, event_type, frame_idx, score FROM o_nms")
def event_nms(fx):
    return Chain(fx).nms.select("match_id", "event_type", "frame_idx", "score")


@query("event_cross_dedup", "WN-14 SO-02 SL-01", "SELECT match_id, event_type, frame_idx, score FROM o_events0 ORDER BY match_id, frame_idx")
def event_cross_dedup(fx):
    from rallyframe.session import pin
    d = events.cross_dedup(pin(Chain(fx).nms))
    return d.select("match_id", "event_type", "frame_idx", "score").orderBy("match_id", "frame_idx")


@query("hit_player_assignment", "JN-01", "SELECT match_id, frame_idx, player, player_distance FROM o_events WHERE event_type = 'hit'")
def hit_player_assignment(fx):
    return Chain(fx).events.filter("event_type = 'hit'").select("match_id", "frame_idx", "player", "player_distance")


@query("ema_track", "WN-15 WN-16 UD-03", """
SELECT match_id, frame_idx, ROUND(sx, 3) + 0 AS sx, ROUND(sy, 3) + 0 AS sy, ROUND(vx, 3) + 0 AS vx, ROUND(vy, 3) + 0 AS vy, stable FROM o_track""")
def ema_track(fx):
    d = tracking.ema_track(Chain(fx).physics_table.select("match_id", "frame_idx", "cx", "cy"), "cx", "cy")
    return d.select("match_id", "frame_idx", *[R3(c) for c in ("sx", "sy", "vx", "vy")], "stable")


@query("contact_debounce", "WN-18", "SELECT match_id, frame_idx FROM o_cool WHERE ok")
def contact_debounce(fx):
    return greedy.debounce(shots.contact_candidates(Chain(fx).physics_table), ["match_id"]).select("match_id", "frame_idx")


@query("contacts", "WN-17 JN-02", """
SELECT match_id, frame_idx, timestamp_sec, owner, ROUND(ball_cx, 3) AS ball_cx, ROUND(ball_cy, 3) AS ball_cy, direction_deg, speed_m_s, court_side, ownership FROM o_contacts""")
def contacts(fx):
    c = Chain(fx).contacts
    return c.select("match_id", "frame_idx", "timestamp_sec", "owner", R3("ball_cx"), R3("ball_cy"), "direction_deg", "speed_m_s", "court_side", "ownership")


@query("homography_carry", "WN-20", "SELECT match_id, frame_idx, ROUND(confidence, 4) AS confidence, reliable, carried FROM o_hom")
def homography_carry(fx):
    return Chain(fx).homography.select("match_id", "frame_idx", F.round("confidence", 4).alias("confidence"), "reliable", "carried")


@query("player_choice", "UD-04 SC-05", "SELECT match_id, frame_idx, label, track_id, ROUND(foot_px, 6) AS foot_px, ROUND(foot_py, 6) AS foot_py FROM o_chosen")
def player_choice(fx):
    return players.choose(Chain(fx).located, "frame_height").select("match_id", "frame_idx", "label", "track_id", R6("foot_px"), R6("foot_py"))


@query("player_carry", "WN-21", "SELECT match_id, frame_idx, label, ROUND(foot_x, 3) AS foot_x, ROUND(foot_y, 3) AS foot_y, carried FROM o_players")
def player_carry(fx):
    return Chain(fx).players.select("match_id", "frame_idx", "label", R3("foot_x"), R3("foot_y"), "carried")


@query("low_confidence_runs", "WN-22", "SELECT match_id, run_start, run_end, length FROM o_lowruns")
def low_confidence_runs(fx):
    return points.low_confidence_runs(Chain(fx).homography)


@query("rally_sessions", "WN-23", """
SELECT match_id, MIN(frame_idx) AS rally_start, MAX(frame_idx) AS rally_end, COUNT(*) AS n FROM o_rallies GROUP BY match_id, rally""")
def rally_sessions(fx):
    r = points.rally_sessions(Chain(fx).found)
    return r.groupBy("match_id", "rally_start").agg(F.max("frame_idx").alias("rally_end"), F.count(F.lit(1)).alias("n"))


@query("point_records", "AG-32 AG-33 JN-08 JN-18", """
SELECT match_id, point_idx, start_frame, end_frame, start_sec, end_sec, serve_frame, serve_player, first_bounce_frame, ROUND(bounce_cx, 3) AS bounce_cx, ROUND(bounce_cy, 3) AS bounce_cy,
  serve_zone, serve_fault_type, end_reason, rally_hit_count, bounce_count, event_count, confidence, low_confidence_homography FROM o_points""")
def point_records(fx):
    p = Chain(fx).points
    return p.select(*[R3(c) if c in ("bounce_cx", "bounce_cy") else c for c in p.columns])


@query("point_bounces", "AG-32", """
SELECT p.match_id, p.point_idx, e.frame_idx AS bounce_frame FROM o_points p JOIN o_events e ON e.match_id = p.match_id AND e.event_type = 'bounce' AND e.frame_idx BETWEEN p.start_frame AND p.end_frame""")
def point_bounces(fx):
    c = Chain(fx)
    b = c.events.filter("event_type = 'bounce'").select("match_id", "frame_idx")
    return points.rows_in_points(b, c.points).select("match_id", "point_idx", F.col("frame_idx").alias("bounce_frame"))


@query("events_in_points", "JN-04", """
SELECT p.match_id, p.point_idx, COUNT(*) AS n, COUNT(*) FILTER (e.event_type = 'hit') AS hits FROM fx_points p JOIN o_events e ON e.match_id = p.match_id AND e.frame_idx BETWEEN p.start_frame AND p.end_frame GROUP BY 1, 2""")
def events_in_points(fx):
    j = points.rows_in_points(Chain(fx).found.select("match_id", "frame_idx", "event_type"), fx.points)
    return j.groupBy("match_id", "point_idx").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "hit").alias("hits"))


@query("shot_classes", "WN-30 WN-31", """
WITH l AS (SELECT *, LAG(timestamp_sec) OVER (PARTITION BY match_id ORDER BY frame_idx) AS pt FROM o_contacts),
s AS (SELECT *, pt IS NULL OR timestamp_sec - pt > 2.5 AS fr, CASE WHEN court_side = 'near' THEN ball_cy > 3496 * 0.92::DOUBLE ELSE ball_cy < 3496 * 0.08::DOUBLE END AS beh,
   COALESCE(speed_m_s, 0) >= 6 AS fast, cos(radians(direction_deg)) AS dx FROM l)
SELECT match_id, frame_idx, fr AS first_in_rally,
  CASE WHEN fr AND (beh OR fast) THEN 'serve' WHEN direction_deg IS NULL OR abs(dx) < 0.15 THEN 'neutral' WHEN (court_side = 'near') = (dx > 0) THEN 'forehand' ELSE 'backhand' END AS shot_class,
  CASE WHEN fr AND beh AND fast THEN 0.85::DOUBLE WHEN fr AND (beh OR fast) THEN 0.65 WHEN direction_deg IS NULL THEN 0.3 WHEN abs(dx) < 0.15 THEN 0.35 ELSE 0.6 END AS class_confidence FROM s""")
def shot_classes(fx):
    from rallyframe.session import pin
    return shots.classify(pin(Chain(fx).contacts)).select("match_id", "frame_idx", "first_in_rally", "shot_class", "class_confidence")


@query("first_shots", "WN-30", """
SELECT match_id, frame_idx, COALESCE(timestamp_sec - LAG(timestamp_sec) OVER (PARTITION BY match_id ORDER BY frame_idx) > 0.25, TRUE) AS first_in_rally FROM fx_shots""")
def first_shots(fx):
    return shots.first_in_rally(fx.shots, gap_sec=0.25).select("match_id", "frame_idx", "first_in_rally")


@query("calibration", "UD-01 UD-02 AG-42 JN-19", """
SELECT match_id, frame_idx, detected, ROUND(error, 3) + 0 AS error, ROUND(confidence, 4) AS confidence, reliable, carried, CASE WHEN reliable THEN [ROUND(i[1] / i[9], 4) + 0, ROUND(i[2] / i[9], 4) + 0, ROUND(i[3] / i[9], 4) + 0] END AS inverse_row FROM o_hom""")
def calibration(fx):
    """Keypoints to one calibration per frame; the first row of the inverse, scaled to a last entry of 1, stands for the matrix."""
    d = Chain(fx).homography
    row = F.array(*[F.round(F.col("inverse")[i] / F.col("inverse")[8], 4) + 0.0 for i in range(3)])
    return d.select("match_id", "frame_idx", "detected", R3("error"), F.round("confidence", 4).alias("confidence"), "reliable", "carried",
                    F.when(F.col("reliable"), row).alias("inverse_row"))


@query("configuration_points", "JN-19", """
WITH conf(conf, k0, k1, k2, k3) AS (VALUES (1,0,1,2,3),(2,4,6,5,7),(3,4,1,5,3),(4,0,6,2,7),(5,8,9,10,11),(6,8,9,5,7),(7,4,6,10,11),(8,6,1,7,3),(9,0,4,2,5),(10,8,12,10,13),(11,12,9,13,11),(12,10,11,5,7))
SELECT f.match_id, f.frame_idx, c.conf FROM fx_frames f CROSS JOIN conf c
WHERE (f.event_id + c.k0) % 29 <> 0 AND (f.event_id + c.k1) % 29 <> 0 AND (f.event_id + c.k2) % 29 <> 0 AND (f.event_id + c.k3) % 29 <> 0""")
def configuration_points(fx):
    return calibrate.configuration_points(fx.keypoints).select("match_id", "frame_idx", "conf")


@query("configuration_errors", "AG-42", "SELECT match_id, frame_idx, conf, ROUND(error, 3) + 0 AS error FROM o_conf")
def configuration_errors(fx):
    """Median error of every complete configuration of every frame."""
    return calibrate.configuration_errors(fx.keypoints).select("match_id", "frame_idx", "conf", R3("error"))


@query("fitted_matrices", "UD-01", """
SELECT match_id, frame_idx, detected, CAST(cell AS INTEGER) AS cell, ROUND(m[cell + 1] * CASE WHEN cell IN (6, 7) THEN 1000 ELSE 1 END, 4) + 0 AS value
FROM (SELECT match_id, frame_idx, detected, m, UNNEST(range(9)) AS cell FROM o_fit)""")
def fitted_matrices(fx):
    """Best matrix of each frame as long rows; the two perspective terms in thousandths."""
    b = calibrate.best_fits(fx.keypoints)
    d = b.select("match_id", "frame_idx", "detected", F.posexplode("matrix").alias("cell", "value"))
    return d.withColumn("value", F.round(F.col("value") * F.when(F.col("cell").isin(6, 7), 1000).otherwise(1), 4) + 0.0)
