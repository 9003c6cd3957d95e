"""Scalar layer: calls, zones, labels, scores, formatting."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rallyframe import constants as K
from rallyframe.fixtures import VIEW
from rallyframe.functions import scalars as S
from rallyframe.operators.calibrate import invert
from rallyframe.plans.registry import query

R6 = lambda c, name: F.round(c, 6).alias(name)


@query("in_out_calls", "SC-01 SC-04", """
SELECT match_id, frame_idx,
  CASE WHEN ball_cx BETWEEN 423 AND 1242 AND ball_cy BETWEEN 561 AND 2935 THEN
         CASE WHEN LEAST(ball_cx - 423, 1242 - ball_cx, ball_cy - 561, 2935 - ball_cy) <= 20 THEN 'line' ELSE 'in' END
       WHEN sqrt(POWER(GREATEST(423 - ball_cx, 0, ball_cx - 1242), 2) + POWER(GREATEST(561 - ball_cy, 0, ball_cy - 2935), 2)) <= 20 THEN 'line'
       ELSE 'out' END AS in_out,
  CASE WHEN ball_cy > 1748 THEN 'near' ELSE 'far' END AS court_side
FROM fx_frames WHERE ball_cx IS NOT NULL""")
def in_out_calls(fx):
    return fx.frames.filter("ball_cx IS NOT NULL").select(
        "match_id", "frame_idx", S.in_out("ball_cx", "ball_cy").alias("in_out"),
        S.court_side("ball_cy").alias("court_side"))


_ZONE_SQL = """CASE WHEN {x} BETWEEN 423 AND 832 AND {y} BETWEEN 1110 AND 1748 THEN 'far_left'
 WHEN {x} BETWEEN 832 AND 1242 AND {y} BETWEEN 1110 AND 1748 THEN 'far_right'
 WHEN {x} BETWEEN 423 AND 832 AND {y} BETWEEN 1748 AND 2386 THEN 'near_left'
 WHEN {x} BETWEEN 832 AND 1242 AND {y} BETWEEN 1748 AND 2386 THEN 'near_right' END"""


@query("serve_zones", "SC-02 AG-34", f"""
SELECT match_id, point_idx, {_ZONE_SQL.format(x='bounce_cx', y='bounce_cy')} AS serve_zone FROM fx_points WHERE bounce_cx IS NOT NULL""")
def serve_zones(fx):
    return fx.points.filter("bounce_cx IS NOT NULL").select(
        "match_id", "point_idx", S.serve_zone("bounce_cx", "bounce_cy").alias("serve_zone"))


@query("serve_faults", "SC-03", f"""
WITH z AS (SELECT *, {_ZONE_SQL.format(x='bounce_cx', y='bounce_cy')} AS serve_zone,
                  CASE WHEN serve_player = 'player_a' THEN 'far' ELSE 'near' END AS target FROM fx_points)
SELECT match_id, point_idx, target,
  CASE WHEN target = 'far' AND bounce_cy < 1110 THEN 'long' WHEN target = 'far' AND bounce_cy > 1748 THEN 'net'
       WHEN target = 'near' AND bounce_cy > 2386 THEN 'long' WHEN target = 'near' AND bounce_cy < 1748 THEN 'net'
       WHEN bounce_cx < 423 OR bounce_cx > 1242 THEN 'wide' ELSE 'long' END AS fault
FROM z WHERE serve_zone IS NULL AND bounce_cx IS NOT NULL""")
def serve_faults(fx):
    p = fx.points.withColumn("target", F.when(F.col("serve_player") == "player_a", "far").otherwise("near"))
    return p.filter(S.serve_zone("bounce_cx", "bounce_cy").isNull() & F.col("bounce_cx").isNotNull()).select(
        "match_id", "point_idx", "target", S.serve_fault("bounce_cx", "bounce_cy", "target").alias("fault"))


@query("court_filter", "SC-05 SC-06 SC-07 SC-08", """
SELECT match_id, frame_idx, slot, ROUND(foot_cx + 0.37::DOUBLE, 6) AS cx, ROUND(foot_cy + 0.21::DOUBLE, 6) AS cy,
  (foot_cx + 0.37::DOUBLE BETWEEN 86 AND 1579 AND foot_cy + 0.21::DOUBLE BETWEEN 361 AND 3135) AS inside,
  ROUND((x1 + x2) / 2, 6) AS back_px, ROUND(y2, 6) AS back_py
FROM fx_detections""")
def court_filter(fx):
    """Pixel to court by the inverse of the match's camera, and back; the court positions behind the pixels are known."""
    mat = F.expr(VIEW)
    inv = invert(mat)
    fxx, fy = S.foot_point("x1", "x2", "y2")
    cx, cy = S.project(inv, fxx, fy)
    d = fx.detections.select("match_id", "frame_idx", "frame_height", "slot", cx.alias("cx"), cy.alias("cy"))
    bx, by = S.project(mat, "cx", "cy")
    return d.select("match_id", "frame_idx", "slot", R6(F.col("cx"), "cx"), R6(F.col("cy"), "cy"),
                    S.inside_court("cx", "cy").alias("inside"), R6(bx, "back_px"), R6(by, "back_py"))


@query("fit_confidence", "SC-09", """
SELECT match_id, frame_idx, ROUND(CASE WHEN e <= 5 THEN 1.0::DOUBLE WHEN e <= 20 THEN 1 - 0.5 * (e - 5) / 15
  WHEN e <= 50 THEN 0.5 - 0.5 * (e - 20) / 30 ELSE 0 END, 6) AS confidence
FROM (SELECT match_id, frame_idx, CAST(event_id % 70 AS DOUBLE) AS e FROM fx_frames)""")
def fit_confidence(fx):
    return fx.frames.select("match_id", "frame_idx", R6(S.error_confidence((F.col("event_id") % 70).cast("double")), "confidence"))


@query("turn_angles", "SC-10", """
WITH a AS (SELECT match_id, frame_idx, degrees(atan2(ball_cy - 1748, ball_cx - 832)) AS d1, CAST(event_id % 720 - 360 AS DOUBLE) AS d2,
                  sqrt(POWER(ball_cx - 832, 2) + POWER(ball_cy - 1748, 2)) AS dist
           FROM fx_frames WHERE ball_cx IS NOT NULL)
SELECT match_id, frame_idx, ROUND(d1, 6) AS direction, ROUND(dist, 6) AS dist,
       ROUND(CASE WHEN abs(d1 - d2) % 360 <= 180 THEN abs(d1 - d2) % 360 ELSE 360 - abs(d1 - d2) % 360 END, 6) AS turn
FROM a""")
def turn_angles(fx):
    dx, dy = F.col("ball_cx") - K.CENTRE_X, F.col("ball_cy") - K.NET_Y
    d2 = (F.col("event_id") % 720 - 360).cast("double")
    return fx.frames.filter("ball_cx IS NOT NULL").select(
        "match_id", "frame_idx", R6(S.direction_deg(dx, dy), "direction"), R6(F.hypot(dx, dy), "dist"),
        R6(S.angle_between(S.direction_deg(dx, dy), d2), "turn"))


@query("shot_labels", "SC-11 SC-12 SC-13 SC-14", """
WITH s AS (SELECT *, CASE WHEN frame_idx % 11 = 0 THEN NULL ELSE CAST((frame_idx * 37 + match_id) % 361 - 180 AS DOUBLE) END AS a FROM fx_shots)
SELECT match_id, frame_idx,
  CASE WHEN a IS NULL THEN 'unknown'
       WHEN court_side = 'near' AND a > -135 AND a < -45 THEN CASE WHEN ball_cx < 832 THEN 'cross_court' ELSE 'down_the_line' END
       WHEN court_side = 'near' AND a BETWEEN -45 AND 45 THEN 'middle'
       WHEN court_side = 'near' THEN CASE WHEN ball_cx < 832 THEN 'down_the_line' ELSE 'cross_court' END
       WHEN a > 45 AND a < 135 THEN CASE WHEN ball_cx > 832 THEN 'cross_court' ELSE 'down_the_line' END
       WHEN a BETWEEN -45 AND 45 THEN 'middle'
       ELSE CASE WHEN ball_cx > 832 THEN 'down_the_line' ELSE 'cross_court' END END AS direction_label,
  CASE WHEN court_side = 'near' THEN ball_cy > 3496 * 0.92 ELSE ball_cy < 3496 * 0.08 END AS behind,
  CASE WHEN abs(cos(radians(a))) < 0.15 THEN 'neutral'
       WHEN (court_side = 'near') = (cos(radians(a)) > 0) THEN 'forehand' ELSE 'backhand' END AS stroke,
  ROUND(CASE WHEN shot_type = 'serve' THEN 0.85 ELSE (1 - 0.85) / 3 END, 6) AS p_serve,
  ROUND(CASE WHEN shot_type = 'forehand' THEN 0.85 ELSE (1 - 0.85) / 3 END, 6) AS p_forehand
FROM s WHERE a IS NOT NULL OR frame_idx % 11 = 0""")
def shot_labels(fx):
    a = F.expr("if(frame_idx % 11 = 0, NULL, CAST((frame_idx * 37 + match_id) % 361 - 180 AS DOUBLE))")
    probs = S.class_probabilities(F.coalesce("shot_type", F.lit("neutral")), F.lit(0.85))
    return fx.shots.withColumn("a", a).select(
        "match_id", "frame_idx", S.shot_direction("a", "ball_cx", "court_side").alias("direction_label"),
        S.behind_baseline("ball_cy", "court_side").alias("behind"),
        S.forehand_backhand("a", "court_side").alias("stroke"),
        R6(probs["serve"], "p_serve"), R6(probs["forehand"], "p_forehand"))


@query("event_scores", "SC-15 SC-16", """
WITH v AS (SELECT match_id, frame_idx, CAST(event_id % 40 AS DOUBLE) AS b, CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(event_id % 33 AS DOUBLE) END AS s,
                  CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(event_id % 300 - 250 AS DOUBLE) END AS acc, CAST(event_id % 181 AS DOUBLE) AS ang FROM fx_frames)
SELECT match_id, frame_idx,
  ROUND(LEAST(1.0::DOUBLE, 0.3 + CASE WHEN b > 0 AND s IS NOT NULL THEN LEAST(1 - s / b, 0.5) * 0.4 ELSE 0 END
     + CASE WHEN acc < -20 THEN LEAST(abs(acc) / 500, 0.3) ELSE 0 END), 6) AS bounce_score,
  ROUND(LEAST(1.0::DOUBLE, LEAST(ang / 180, 1.0) * 0.5 + CASE WHEN s IS NOT NULL AND b > 0.01 THEN LEAST(s / b / 3, 0.3)
     WHEN s IS NOT NULL THEN LEAST(s / 50, 0.2) ELSE 0 END), 6) AS hit_score
FROM v""")
def event_scores(fx):
    e = F.col("event_id")
    d = fx.frames.select("match_id", "frame_idx", (e % 40).cast("double").alias("b"),
                         F.when(e % 7 != 0, (e % 33).cast("double")).alias("s"),
                         F.when(e % 5 != 0, (e % 300 - 250).cast("double")).alias("acc"), (e % 181).cast("double").alias("ang"))
    return d.select("match_id", "frame_idx", R6(S.bounce_score("b", "s", "acc"), "bounce_score"),
                    R6(S.hit_score("ang", "b", "s"), "hit_score"))


_POSE_SQL = """
WITH k AS (SELECT match_id, frame_idx, player, kps,
    kps[6].conf > 0.1 AND kps[10].conf > 0.1 AS hl, kps[7].conf > 0.1 AND kps[11].conf > 0.1 AS hr,
    GREATEST(abs((kps[12].y + kps[13].y) / 2 - (kps[6].y + kps[7].y) / 2), 0.05) AS torso FROM fx_poses),
m AS (SELECT *, GREATEST(CASE WHEN hl THEN (kps[6].y - kps[10].y) / torso ELSE -99 END, CASE WHEN hr THEN (kps[7].y - kps[11].y) / torso ELSE -99 END) AS lift,
    CASE WHEN hl THEN abs(kps[10].x - kps[6].x) / torso ELSE 0 END AS ll, CASE WHEN hr THEN abs(kps[11].x - kps[7].x) / torso ELSE 0 END AS lr,
    (kps[6].x + kps[7].x) / 2 AS mid FROM k),
t AS (SELECT *, CASE WHEN lr > ll THEN CASE WHEN kps[11].x < mid THEN 'backhand' ELSE 'forehand' END
                ELSE CASE WHEN kps[10].x > mid THEN 'forehand' ELSE 'backhand' END END AS swing,
    LEAST(kps[7].conf, kps[9].conf, kps[11].conf) AS vr, LEAST(kps[6].conf, kps[8].conf, kps[10].conf) AS vl FROM m)
"""


@query("pose_shots", "SC-17 SC-18 SC-19", _POSE_SQL + """,
a AS (SELECT match_id, frame_idx, player,
  CASE WHEN NOT hl AND NOT hr THEN 'neutral' WHEN lift > 0.6 THEN 'serve' WHEN ll > 0.15 OR lr > 0.15 THEN swing ELSE 'neutral' END AS pose_type,
  CASE WHEN NOT hl AND NOT hr THEN 0.3 WHEN lift > 0.6 THEN LEAST(0.8, 0.4 + lift * 0.2) WHEN ll > 0.3 OR lr > 0.3 THEN LEAST(0.7, 0.35 + GREATEST(ll, lr) * 0.15)
       WHEN ll > 0.15 OR lr > 0.15 THEN 0.35 ELSE 0.4 END AS pose_conf,
  CASE WHEN GREATEST(vr, vl) < 0.5 THEN 'neutral'
       WHEN vr >= vl THEN CASE WHEN kps[11].y < kps[7].y * 0.9 THEN 'serve' WHEN kps[11].x > kps[7].x THEN 'forehand' ELSE 'backhand' END
       ELSE CASE WHEN kps[10].y < kps[6].y * 0.9 THEN 'serve' WHEN kps[10].x > kps[6].x THEN 'forehand' ELSE 'backhand' END END AS side_type,
  CASE WHEN GREATEST(vr, vl) < 0.5 THEN 0.2
       WHEN (vr >= vl AND kps[11].y < kps[7].y * 0.9) OR (vr < vl AND kps[10].y < kps[6].y * 0.9) THEN CASE WHEN GREATEST(vr, vl) >= 0.7 THEN 0.85 ELSE 0.7 END
       ELSE CASE WHEN GREATEST(vr, vl) >= 0.7 THEN 0.78 ELSE 0.65 END END AS side_conf FROM t)
SELECT match_id, frame_idx, player, pose_type, ROUND(pose_conf::DOUBLE, 6) AS pose_conf, side_type, ROUND(side_conf::DOUBLE, 6) AS side_conf,
  CASE WHEN pose_conf >= 0.6 AND pose_type <> 'neutral' THEN pose_type ELSE 'backhand' END AS fused_type,
  CASE WHEN pose_conf >= 0.6 AND pose_type <> 'neutral' THEN 'pose' ELSE 'trajectory' END AS fused_source FROM a""")
def pose_shots(fx):
    d = fx.poses.select("match_id", "frame_idx", "player", S.pose_shot("kps").alias("p"), S.pose_side_shot("kps").alias("s"))
    f = S.fuse_classifiers(F.col("p.shot_type"), F.col("p.confidence"), F.lit("backhand"), F.lit(0.6))
    return d.withColumn("f", f).select(
        "match_id", "frame_idx", "player", F.col("p.shot_type").alias("pose_type"), R6(F.col("p.confidence"), "pose_conf"),
        F.col("s.shot_type").alias("side_type"), R6(F.col("s.confidence"), "side_conf"),
        F.col("f.shot_type").alias("fused_type"), F.col("f.source").alias("fused_source"))


@query("pose_features", "SC-20", """
SELECT match_id, frame_idx, player, u.i AS feature, CASE WHEN kps[u.i // 2 + 1].conf > 0.1 THEN
    CASE WHEN u.i % 2 = 0 THEN kps[u.i // 2 + 1].y ELSE kps[u.i // 2 + 1].x END ELSE 0 END AS value
FROM fx_poses CROSS JOIN (SELECT CAST(UNNEST(range(26)) AS INTEGER) AS i) AS u""")
def pose_features(fx):
    return fx.poses.select("match_id", "frame_idx", "player", F.posexplode(S.pose_features("kps")).alias("feature", "value"))


@query("value_buckets", "SC-21 SC-22 SC-23", """
WITH v AS (SELECT f.match_id, f.frame_idx, f.event_id % 13 AS hits, CAST(f.event_id % 2500 AS DOUBLE) / 10 AS kmh, f.ball_cy AS y FROM fx_frames f WHERE ball_cy IS NOT NULL)
SELECT match_id, CASE WHEN hits <= 3 THEN '1-3' WHEN hits <= 6 THEN '4-6' WHEN hits <= 9 THEN '7-9' ELSE '10+' END AS rally,
  CASE WHEN kmh < 50 THEN '0-50' WHEN kmh < 100 THEN '50-100' WHEN kmh < 150 THEN '100-150' WHEN kmh < 200 THEN '150-200' ELSE '200+' END AS speed,
  CASE WHEN abs(y - 1748) <= 200 THEN 'net' WHEN y <= 1110 OR y >= 2386 THEN 'baseline' ELSE 'mid' END AS zone, COUNT(*) AS n
FROM v GROUP BY 1, 2, 3, 4""")
def value_buckets(fx):
    d = fx.frames.filter("ball_cy IS NOT NULL").select(
        "match_id", S.rally_bucket(F.expr("event_id % 13")).alias("rally"),
        S.speed_bucket(F.expr("CAST(event_id % 2500 AS DOUBLE) / 10")).alias("speed"), S.movement_zone("ball_cy").alias("zone"))
    return d.groupBy("match_id", "rally", "speed", "zone").agg(F.count(F.lit(1)).alias("n"))


@query("speed_shares", "SC-22 SC-24", """
WITH b AS (SELECT match_id, CASE WHEN v < 50 THEN '0-50' WHEN v < 100 THEN '50-100' WHEN v < 150 THEN '100-150' WHEN v < 200 THEN '150-200' ELSE '200+' END AS bucket, COUNT(*) AS n
  FROM (SELECT match_id, speed_m_s * 3.6::DOUBLE AS v FROM fx_shots WHERE speed_m_s IS NOT NULL) GROUP BY 1, 2)
SELECT match_id, bucket, n, ROUND(n * 100.0::DOUBLE / SUM(n) OVER (PARTITION BY match_id), 6) AS pct FROM b""")
def speed_shares(fx):
    b = fx.shots.filter("speed_m_s IS NOT NULL").groupBy("match_id", S.speed_bucket(F.col("speed_m_s") * 3.6).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return b.select("match_id", "bucket", "n", R6(S.percent("n", F.sum("n").over(Window.partitionBy("match_id"))), "pct"))


@query("timing_checks", "SC-24 SC-25 SC-26 SC-27 SC-28 SC-29", """
WITH m AS (SELECT match_id, COUNT(*) AS n, MIN(t_sec) AS f, MAX(t_sec) AS l FROM fx_frames GROUP BY 1)
SELECT match_id, n, ROUND((n - 1) / (l - f), 6) AS fps, abs((n - 1) / (l - f) - 30) > 1 AS change_fps,
  ROUND(CASE WHEN match_id % 3 = 0 THEN l - f WHEN match_id % 3 = 1 THEN 12.5 ELSE 7 END, 6) AS duration,
  ROUND(10.0::DOUBLE + n / 30.0::DOUBLE, 3) AS end_stamp, ROUND(GREATEST(0, f - 1.0), 6) AS clip_start, ROUND(l + 0.2, 6) AS clip_end,
  ROUND(l + 0.2 - GREATEST(0, f - 1.0), 6) AS clip_len, CAST(NULL AS DOUBLE) AS cleaned
FROM m""")
def timing_checks(fx):
    m = fx.frames.groupBy("match_id").agg(F.count(F.lit(1)).alias("n"), F.min("t_sec").alias("f"), F.max("t_sec").alias("l"))
    k = F.col("match_id") % 3
    fps = S.infer_fps("n", "f", "l")
    dur = S.infer_duration(F.when(k == 2, 3.0), F.when(k == 2, 10.0), F.when(k == 1, 12.5), "f", "l", "n", fps)
    s, e, length = S.clip_bounds("f", "l")
    return m.select("match_id", "n", R6(fps, "fps"), S.fps_needs_change(fps).alias("change_fps"), R6(dur, "duration"),
                    S.frame_seconds("n", F.lit(30.0), 10.0).alias("end_stamp"), R6(s, "clip_start"), R6(e, "clip_end"),
                    R6(length, "clip_len"), S.safe_round(F.lit(float("nan"))).alias("cleaned"))


@query("clip_ranges", "SC-29", """
SELECT match_id, point_idx, ROUND(GREATEST(0, start_sec - 1.0), 6) AS clip_start, ROUND(end_sec + 0.2, 6) AS clip_end,
       ROUND(end_sec + 0.2 - GREATEST(0, start_sec - 1.0), 6) AS clip_len FROM fx_points""")
def clip_ranges(fx):
    s, e, length = S.clip_bounds("start_sec", "end_sec")
    return fx.points.select("match_id", "point_idx", R6(s, "clip_start"), R6(e, "clip_end"), R6(length, "clip_len"))


@query("event_log_filter", "SC-30", """
SELECT match_id, frame_idx, owner, court_side FROM fx_shots WHERE court_side = 'near' AND owner = 'player_a'""")
def event_log_filter(fx):
    from rallyframe.operators.state import filter_log
    return filter_log(fx.shots, court_side="near", owner="player_a", shot_type="all").select("match_id", "frame_idx", "owner", "court_side")


@query("quality_tiers", "SC-31", """
SELECT match_id, point_idx, CASE WHEN confidence * 100 >= 70 THEN 'high' WHEN confidence * 100 >= 40 THEN 'mid' ELSE 'low' END AS tier,
       rally_hit_count < 3 AS few_events FROM fx_points""")
def quality_tiers(fx):
    return fx.points.select("match_id", "point_idx", S.confidence_tier(F.col("confidence") * 100).alias("tier"),
                            S.coverage_warning("rally_hit_count", 3).alias("few_events"))


@query("heat_intensity", "SC-35", """
WITH c AS (SELECT match_id, CAST(floor(ball_cx / 100) AS BIGINT) AS xb, CAST(floor(ball_cy / 100) AS BIGINT) AS yb, COUNT(*) AS n FROM fx_frames WHERE ball_cx IS NOT NULL GROUP BY 1, 2, 3)
SELECT match_id, xb, yb, ROUND(n / CAST(GREATEST(MAX(n) OVER (PARTITION BY match_id), 1) AS DOUBLE), 6) AS intensity FROM c""")
def heat_intensity(fx):
    from rallyframe.operators.heatmaps import intensity
    c = fx.frames.filter("ball_cx IS NOT NULL").groupBy(
        "match_id", F.floor(F.col("ball_cx") / 100).alias("xb"), F.floor(F.col("ball_cy") / 100).alias("yb")).agg(F.count(F.lit(1)).alias("n"))
    return intensity(c, ["match_id"]).select("match_id", "xb", "yb", R6(F.col("intensity"), "intensity"))


@query("hash_distance", "SC-36", """
SELECT frame_no, CASE WHEN w0 IS NULL THEN 999 ELSE """ + " + ".join(
    f"CAST(bit_count(xor(w{i}, {1431655765 if i % 2 else 305419896})) AS INTEGER)" for i in range(8)) + """ END AS distance FROM fx_hashes""")
def hash_distance(fx):
    ref = [F.lit(1431655765 if i % 2 else 305419896).cast("bigint") for i in range(8)]
    return fx.hashes.select("frame_no", S.hamming([f"w{i}" for i in range(8)], ref).alias("distance"))


@query("text_helpers", "SC-37 SC-38", """
SELECT match_id, point_idx,
  CAST(point_idx AS VARCHAR) || CASE WHEN point_idx % 100 BETWEEN 10 AND 13 THEN 'th' WHEN point_idx % 10 = 1 THEN 'st' WHEN point_idx % 10 = 2 THEN 'nd' WHEN point_idx % 10 = 3 THEN 'rd' ELSE 'th' END AS nth,
  lower(replace(end_reason, '_', ' ')) AS reason_text,
  CASE end_reason WHEN 'OUT' THEN 'Error' WHEN 'NET' THEN 'Net' WHEN 'DOUBLE_BOUNCE' THEN 'Won' ELSE 'Tracking lost' END AS outcome,
  CAST(CAST(floor(start_sec / 60) AS BIGINT) AS VARCHAR) || ':' || lpad(CAST(CAST(round(start_sec % 60) AS INTEGER) AS VARCHAR), 2, '0') AS clock,
  'It''s "' || end_reason || '" - ok...' AS cleaned FROM fx_points""")
def text_helpers(fx):
    fancy = F.concat(F.lit("It’s “"), F.col("end_reason"), F.lit("”  –   ok… "))
    return fx.points.select("match_id", "point_idx", S.ordinal("point_idx").alias("nth"),
                            F.lower(S.spaced("end_reason")).alias("reason_text"), S.outcome_label("end_reason").alias("outcome"),
                            S.minutes_seconds("start_sec").alias("clock"), S.ascii_clean(fancy).alias("cleaned"))


@query("serve_candidates", "SC-32", """
SELECT b.match_id, b.frame_idx, b.box_no FROM fx_boxes b WHERE class_id = 1 AND cx > 0.2 AND cx < 0.8 AND cy > 0.3 AND cy < 0.7
  AND EXISTS (SELECT 1 FROM fx_boxes p WHERE p.match_id = b.match_id AND p.frame_idx = b.frame_idx AND p.class_id = 0 AND (p.cy > 0.75 OR p.cy < 0.25))""")
def serve_candidates(fx):
    from rallyframe.operators.curation import serve_candidates as op
    return op(fx.boxes).select("match_id", "frame_idx", "box_no")


@query("net_approaches", "SC-33", """
SELECT match_id, frame_idx, BOOL_OR(class_id = 0 AND cy > 0.35 AND cy < 0.65) AS at_net FROM fx_boxes GROUP BY 1, 2""")
def net_approaches(fx):
    from rallyframe.operators.curation import net_approach as op
    return op(fx.boxes)


@query("best_ball", "SC-34", """
SELECT match_id, frame_idx, box_no, cx, cy FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY match_id, frame_idx ORDER BY confidence DESC, box_no) AS rn
  FROM fx_boxes WHERE class_id = 1 AND confidence >= 0.15) WHERE rn = 1""")
def best_ball(fx):
    from rallyframe.operators.curation import best_ball as op
    return op(fx.boxes.filter("class_id = 1"))
