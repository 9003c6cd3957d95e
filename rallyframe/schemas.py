"""Schemas of the result files (read with a schema, never inferred)."""
from __future__ import annotations

PAIR = "ARRAY<DOUBLE>"
PLAYER = f"STRUCT<bbox: ARRAY<DOUBLE>, confidence: DOUBLE, track_id: BIGINT, foot_pixel: {PAIR}, foot_court: {PAIR}>"

FRAME = (f"frame_idx BIGINT, timestamp_sec DOUBLE, ball STRUCT<pixel_xy: {PAIR}, court_xy: {PAIR}, speed_m_s: DOUBLE, accel_m_s2: DOUBLE>, "
         "homography STRUCT<detected_keypoints: BIGINT, confidence: DOUBLE, reprojection_error_px: DOUBLE, reliable: BOOLEAN, carried_forward: BOOLEAN>, "
         f"court_keypoints ARRAY<{PAIR}>, players STRUCT<player_a: {PLAYER}, player_b: {PLAYER}>")

EVENT = ("event_type STRING, frame_idx BIGINT, timestamp_sec DOUBLE, court_xy ARRAY<DOUBLE>, speed_before_m_s DOUBLE, speed_after_m_s DOUBLE, "
         "direction_change_deg DOUBLE, score DOUBLE, court_side STRING, player STRING, player_distance DOUBLE, in_out STRING")

POINT = ("point_idx BIGINT, start_frame BIGINT, end_frame BIGINT, start_sec DOUBLE, end_sec DOUBLE, serve_frame BIGINT, serve_player STRING, "
         "first_bounce_frame BIGINT, first_bounce_court_xy ARRAY<DOUBLE>, serve_zone STRING, serve_fault_type STRING, end_reason STRING, "
         "rally_hit_count BIGINT, bounce_count BIGINT, bounce_frames ARRAY<BIGINT>, confidence DOUBLE, low_confidence_homography BOOLEAN, event_count BIGINT")

SHOT = ("frame_idx BIGINT, timestamp_sec DOUBLE, owner STRING, ball_court_xy ARRAY<DOUBLE>, shot_type STRING, shot_type_confidence DOUBLE, "
        "ball_direction_deg DOUBLE, ball_direction_label STRING, speed_m_s DOUBLE, court_side STRING, ownership_method STRING")

BALL_SERIES = "t DOUBLE, frame_idx BIGINT, x DOUBLE, y DOUBLE, speed_m_s DOUBLE, speed_km_h DOUBLE, accel_m_s2 DOUBLE"
PLAYER_SERIES = "t DOUBLE, frame_idx BIGINT, x DOUBLE, y DOUBLE, foot_pixel_x DOUBLE, foot_pixel_y DOUBLE"

_STATS = ("STRUCT<total_shots: BIGINT, shot_type_counts: MAP<STRING, BIGINT>, error_rate_by_shot_type: MAP<STRING, DOUBLE>, "
          "error_rate_by_rally_length: MAP<STRING, DOUBLE>, avg_shot_speed_m_s: DOUBLE, first_serve_pct: DOUBLE, double_fault_count: BIGINT, "
          "points_won: BIGINT, points_lost: BIGINT>")
ANALYTICS = f"total_points BIGINT, total_shots BIGINT, rally_length_avg DOUBLE, rally_length_distribution MAP<STRING, BIGINT>, player_a {_STATS}, player_b {_STATS}"

DOCUMENTS = {"events": EVENT, "points": POINT, "shots": SHOT, "ball_court": BALL_SERIES, "player_court": PLAYER_SERIES, "analytics": ANALYTICS}
