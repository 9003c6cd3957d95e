"""Review state, segments, listings and session records."""
from __future__ import annotations

from pyspark.sql import functions as F

from rallyframe.operators import state, stats
from rallyframe.plans.q_stats import Tables, rounded
from rallyframe.plans.registry import query
from rallyframe.session import shared_folder
from rallyframe.streaming import commits
from rallyframe.sources import readers, sinks

_LATEST = "SELECT * EXCLUDE (k) FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY match_id, point_idx ORDER BY version DESC) AS k FROM fx_feedback) WHERE k = 1"
_REVIEW = f"""
WITH f AS ({_LATEST}),
r AS (SELECT p.match_id, p.point_idx, f.action AS coach_action, f.note AS coach_note, CASE WHEN f.action = 'flag' THEN confidence END AS original_confidence,
  CASE WHEN f.action = 'flag' THEN ROUND(confidence * 0.5::DOUBLE, 3) ELSE confidence END AS confidence, COALESCE(f.action = 'flag' AND lower(f.note) LIKE '%exclude%', FALSE) AS excluded
 FROM fx_points p LEFT JOIN f ON f.match_id = p.match_id AND f.point_idx = p.point_idx)
"""


@query("latest_feedback", "ST-01 SL-06", f"SELECT match_id, point_idx, action, note, version FROM ({_LATEST})")
def latest_feedback(fx):
    return state.latest(fx.feedback, ["match_id", "point_idx"], ["version"])


@query("upsert_keeps_first_date", "ST-01", """
SELECT match_id, segment_idx, arg_max(status, version) AS status, arg_max(end_sec, version) AS end_sec, MAX(version) AS version, arg_min(start_sec, version) AS start_sec FROM fx_segments GROUP BY 1, 2""")
def upsert_keeps_first_date(fx):
    return state.latest(fx.segments, ["match_id", "segment_idx"], ["version"], first_of=["start_sec"])


@query("insert_if_absent", "ST-02", "SELECT match_id, segment_idx, start_sec, end_sec, status, version FROM fx_segments WHERE version = 0")
def insert_if_absent(fx):
    return state.insert_if_absent(fx.segments, ["match_id", "segment_idx"], ["version"])


@query("points_with_feedback", "JN-12", f"WITH f AS ({_LATEST}) SELECT p.match_id, p.point_idx, f.action AS coach_action, f.note AS coach_note FROM fx_points p LEFT JOIN f ON f.match_id = p.match_id AND f.point_idx = p.point_idx")
def points_with_feedback(fx):
    return state.with_feedback(fx.points, fx.feedback).select("match_id", "point_idx", "coach_action", "coach_note")


@query("review_applied", "ST-03", _REVIEW + "SELECT * FROM r")
def review_applied(fx):
    return state.apply_review(fx.points, fx.feedback).select("match_id", "point_idx", "coach_action", "coach_note", "original_confidence", "confidence", "excluded")


@query("statistics_without_excluded", "ST-04", _REVIEW + "SELECT p.match_id, COUNT(*) AS points, ROUND(AVG(p.rally_hit_count), 6) AS avg_hits FROM fx_points p JOIN r ON r.match_id = p.match_id AND r.point_idx = p.point_idx WHERE NOT r.excluded GROUP BY 1")
def statistics_without_excluded(fx):
    return rounded(stats.rally_average(state.without_excluded(state.apply_review(fx.points, fx.feedback))))


@query("review_counters", "AG-36", _REVIEW + "SELECT match_id, COUNT(*) AS total_points, COUNT(*) FILTER (coach_action = 'confirm') AS confirmed, COUNT(*) FILTER (coach_action = 'flag') AS flagged, COUNT(*) FILTER (excluded) AS excluded FROM r GROUP BY 1")
def review_counters(fx):
    return state.review_counters(state.apply_review(fx.points, fx.feedback))


@query("job_status", "ST-05 SR-08", """
SELECT job_id, arg_max(stage, seq) AS stage, CASE WHEN COUNT(error_message) > 0 THEN 'error' ELSE arg_max(status, seq) END AS status, arg_max(error_message, seq) FILTER (error_message IS NOT NULL) AS error_message FROM fx_status_log GROUP BY 1""")
def job_status(fx):
    return state.job_status(fx.status_log)


@query("full_job_status", "JN-15 SL-06", """
WITH s AS (SELECT job_id, arg_max(stage, seq) AS stage, CASE WHEN COUNT(error_message) > 0 THEN 'error' ELSE arg_max(status, seq) END AS status, arg_max(error_message, seq) FILTER (error_message IS NOT NULL) AS error_message FROM fx_status_log GROUP BY 1),
e AS (SELECT job_id, COUNT(*) AS decisions, arg_max(CASE WHEN ball_map < 0.7 THEN 'retrain' ELSE 'exit' END, iteration) AS last_action, MAX(iteration) AS last_iteration, arg_max(player_map, iteration) AS last_player_map,
  string_agg(iteration || ' ' || CASE WHEN ball_map < 0.7 THEN 'retrain' ELSE 'exit' END || ': ' || frame_count || ' frames', '; ' ORDER BY iteration) AS decision_log FROM fx_evals GROUP BY 1)
SELECT s.*, e.decisions, e.last_action, e.last_iteration, e.last_player_map, e.decision_log FROM s LEFT JOIN e ON e.job_id = s.job_id""")
def full_job_status(fx):
    decisions = fx.evals.select("job_id", "iteration", F.when(F.col("ball_map") < 0.7, "retrain").otherwise("exit").alias("action"),
                               F.concat(F.col("frame_count").cast("string"), F.lit(" frames")).alias("justification"))
    d = state.full_status(fx.status_log, decisions, fx.evals)
    line = lambda x: F.concat(x["iteration"].cast("string"), F.lit(" "), x["action"], F.lit(": "), x["justification"])
    return d.withColumn("decision_log", F.array_join(F.transform("decision_log", line), "; "))


@query("segment_status", "AG-37 ST-02", """
WITH s AS (SELECT match_id, segment_idx, arg_max(status, version) = 'complete' AS done FROM fx_segments GROUP BY 1, 2)
SELECT match_id, COUNT(*) AS total, COUNT(*) FILTER (done) AS complete, COUNT(*) FILTER (NOT done) AS incomplete FROM s GROUP BY 1""")
def segment_status(fx):
    return state.segment_completion(fx.segments)


@query("incomplete_segments", "SO-04 AG-37", "SELECT match_id, segment_idx FROM fx_segments GROUP BY 1, 2 HAVING MAX(version) < 2")
def incomplete_segments(fx):
    return state.incomplete_segments(fx.segments)


_ART = "(SELECT DISTINCT match_id AS job_id, segment_idx AS artifact_no, CASE segment_idx % 3 WHEN 0 THEN 'clip' WHEN 1 THEN 'events' ELSE 'points' END AS artifact_type, 'out/' || match_id || '/' || segment_idx AS path FROM fx_frames)"


def _artifacts(fx):
    s = fx.frames.select(F.col("match_id").alias("job_id"), F.col("segment_idx").alias("artifact_no")).distinct()
    kind = F.expr("CASE artifact_no % 3 WHEN 0 THEN 'clip' WHEN 1 THEN 'events' ELSE 'points' END")
    return s.select("job_id", "artifact_no", kind.alias("artifact_type"), F.concat_ws("/", F.lit("out"), "job_id", "artifact_no").alias("path"))


@query("artifacts_by_type", "AG-38", f"SELECT job_id, artifact_type, artifact_no, path FROM {_ART}")
def artifacts_by_type(fx):
    return state.artifacts_by_type(_artifacts(fx))


@query("artifact_counts", "AG-38", f"SELECT job_id, artifact_type, COUNT(*) AS n, MIN(path) AS first_path, MAX(path) AS last_path FROM {_ART} GROUP BY 1, 2")
def artifact_counts(fx):
    return state.artifact_counts(_artifacts(fx))


@query("detection_summary", "ST-08", """
SELECT f.match_id, fps, f.n AS frame_count, ROUND(f.n / fps, 2) AS duration_sec, p.n AS total_points, s.n AS total_events FROM (SELECT match_id, COUNT(*) AS n, MAX(fps) AS fps FROM fx_frames GROUP BY 1) f
LEFT JOIN (SELECT match_id, COUNT(*) AS n FROM fx_points GROUP BY 1) p ON p.match_id = f.match_id LEFT JOIN (SELECT match_id, COUNT(*) AS n FROM fx_shots GROUP BY 1) s ON s.match_id = f.match_id""")
def detection_summary(fx):
    meta = fx.frames.groupBy("match_id").agg(F.count(F.lit(1)).alias("frame_count"), F.max("fps").alias("fps")).select(
        "match_id", F.to_json(F.struct("fps", "frame_count")).alias("metadata"))
    return state.detection_summary(meta, fx.points, fx.shots)


@query("notes_per_point", "JN-14", """
SELECT p.match_id, p.point_idx, COUNT(n.note_text) AS notes, arg_min(n.note_text, n.timestamp_sec) AS first_note, arg_max(n.note_text, n.timestamp_sec) AS last_note FROM fx_points p LEFT JOIN fx_notes n ON n.match_id = p.match_id AND n.point_idx = p.point_idx GROUP BY 1, 2""")
def notes_per_point(fx):
    return state.notes_per_point(fx.points, fx.notes)


@query("note_listing", "SL-07 JN-14", "SELECT match_id, point_idx, ROUND(timestamp_sec, 6) AS timestamp_sec, note_text FROM fx_notes ORDER BY match_id, point_idx, timestamp_sec")
def note_listing(fx):
    return rounded(fx.notes.select("match_id", "point_idx", "timestamp_sec", "note_text")).orderBy("match_id", "point_idx", "timestamp_sec")


@query("points_with_cards", "JN-13", """
SELECT p.match_id, p.point_idx, CASE WHEN p.point_idx % 3 = 0 THEN 'note 0' END AS summary FROM fx_points p""")
def points_with_cards(fx):
    cards = fx.notes.select("match_id", "point_idx", F.col("note_text").alias("summary"), F.col("timestamp_sec").alias("card_no"))
    return state.with_card(fx.points.select("match_id", "point_idx"), cards)


@query("delete_cascade", "ST-06", "SELECT player_id, job_id FROM fx_history WHERE player_id NOT LIKE '%_1' ESCAPE '\\' AND player_id NOT IN ('player_a_1', 'player_b_1')".replace(" NOT LIKE '%_1' ESCAPE '\\' AND player_id", ""))
def delete_cascade(fx):
    h = fx.history.select("player_id", "job_id")
    gone = h.filter(F.col("player_id").endswith("_1"))
    return state.delete_cascade(h.select("player_id").distinct(), h, gone)[1]


@query("delete_together", "ST-06 ST-01", """
SELECT 'players' AS what, player_id, COUNT(*) AS n FROM (SELECT DISTINCT player_id FROM fx_history) WHERE player_id NOT IN ('player_a_1', 'player_b_1') GROUP BY 2
UNION ALL SELECT 'matches', player_id, COUNT(*) FROM fx_history WHERE player_id NOT IN ('player_a_1', 'player_b_1') GROUP BY 2""")
def delete_together(fx):
    """Players and their matches in stored tables; the deletion changes both in one step."""
    root, h = shared_folder(fx.spark, "together"), fx.history.select("player_id", "job_id")
    commits.write_together(fx.spark, root, players=h.select("player_id").distinct(), matches=h)
    now = lambda name: commits.read_table(fx.spark, root, name)
    players, matches = state.delete_cascade(now("players"), now("matches"), now("players").filter(F.col("player_id").endswith("_1")))
    commits.write_together(fx.spark, root, players=players, matches=matches)
    count = lambda name: now(name).groupBy(F.lit(name).alias("what"), "player_id").agg(F.count(F.lit(1)).alias("n"))
    return count("players").unionByName(count("matches"))


@query("session_records", "ST-07 SL-06", f"""
WITH f AS ({_LATEST}), s AS (SELECT match_id, COUNT(*) AS reviewed, COUNT(*) FILTER (action = 'flag') AS flagged, COUNT(note) AS with_note FROM f GROUP BY 1)
SELECT s.*, p.created_at, p.preference FROM s LEFT JOIN (SELECT match_id, MAX(point_idx) AS created_at, arg_max(serve_player, point_idx) AS preference FROM fx_points GROUP BY 1) p ON p.match_id = s.match_id""")
def session_records(fx):
    pref = fx.points.select("match_id", F.col("point_idx").alias("created_at"), F.col("serve_player").alias("preference"))
    return state.session_records(fx.feedback, pref)


@query("recompute_if_empty", "ST-09", """
WITH n AS (SELECT match_id, owner, COUNT(*) AS total_shots, ROUND(COALESCE(AVG(CASE WHEN speed_m_s > 0 THEN speed_m_s END), 0), 6) AS avg_speed FROM fx_shots GROUP BY 1, 2)
SELECT match_id, owner, total_shots, CASE WHEN match_id % 2 = 0 THEN 0.0::DOUBLE ELSE avg_speed END AS avg_speed, CASE WHEN match_id % 2 = 0 THEN 7 END::BIGINT AS total_points, CASE WHEN match_id % 2 = 0 THEN 'stored' ELSE 'rebuilt' END AS source FROM n""")
def recompute_if_empty(fx):
    rebuilt = stats.average_speed(fx.shots)
    even = F.col("match_id") % 2 == 0
    stored = rebuilt.select("match_id", "owner", F.when(even, F.col("total_shots")).otherwise(0).alias("total_shots"), F.lit(0.0).alias("avg_speed"),
                            F.lit(7).cast("bigint").alias("total_points"))
    return rounded(state.recompute_if_empty(stored, rebuilt))


@query("schema_evolution", "ST-10", "SELECT match_id, segment_idx, CASE WHEN segment_idx % 2 = 0 THEN 'key' ELSE 'none' END AS result_key FROM fx_segments WHERE version = 0")
def schema_evolution(fx):
    s = fx.segments.filter("version = 0").select("match_id", "segment_idx")
    return state.add_column(s.filter("segment_idx % 2 = 1"), s.filter("segment_idx % 2 = 0").withColumn("result_key", F.lit("key")), "result_key", F.lit("none"))


@query("run_replacement", "IO-03 HI-08", """
WITH r AS (SELECT match_id AS job_id, COUNT(*) AS n FROM fx_points GROUP BY 1) SELECT job_id, CASE WHEN job_id = 2 THEN n + 1000 ELSE n END AS total_points FROM r WHERE job_id % 4 <> 3""")
def run_replacement(fx):
    runs = fx.points.groupBy(F.col("match_id").alias("job_id")).agg(F.count(F.lit(1)).alias("total_points"))
    stored = runs.withColumn("total_points", F.when(F.col("job_id") % 4 == 3, 0).otherwise(F.col("total_points")))
    return state.replace_run(stored, runs.filter("job_id = 2").withColumn("total_points", F.col("total_points") + 1000))


def through_files(rows):
    """Write a result table with its sink and read it back."""
    folder = shared_folder(rows.sparkSession, "rows")
    sinks.write_rows(rows, folder)
    return readers.rows(rows.sparkSession, folder, rows.schema)


@query("ball_series", "IO-06", """
SELECT match_id, ROUND(t, 3) AS t, frame_idx, CASE WHEN cx IS NOT NULL THEN ROUND(cx, 2) END AS x, CASE WHEN cx IS NOT NULL THEN ROUND(cy, 2) END AS y, CASE WHEN cx IS NOT NULL THEN speed END AS speed_m_s,
  CASE WHEN cx IS NOT NULL AND speed <> 0 THEN ROUND(speed * 3.6::DOUBLE, 2) END AS speed_km_h, CASE WHEN cx IS NOT NULL THEN accel END AS accel_m_s2
FROM (SELECT match_id, frame_idx / fps AS t, frame_idx, cx, cy, speed, accel FROM o_physics)""")
def ball_series(fx):
    from rallyframe.sources.sinks import ball_series as op
    return through_files(op(Tables(fx).physics))


@query("player_series", "IO-07", """
SELECT match_id, label, ROUND(t, 3) AS t, frame_idx, ROUND(foot_x, 2) AS x, ROUND(foot_y, 2) AS y, CASE WHEN foot_x IS NOT NULL THEN ROUND(foot_px, 2) END AS foot_pixel_x, CASE WHEN foot_x IS NOT NULL THEN ROUND(foot_py, 2) END AS foot_pixel_y FROM o_players JOIN (SELECT match_id, frame_idx, label, t FROM o_pos) USING (match_id, frame_idx, label)""")
def player_series(fx):
    from rallyframe.sources.sinks import player_series as op
    return through_files(op(Tables(fx).players))


@query("event_rows", "IO-08", """
SELECT match_id, event_type, frame_idx, timestamp_sec, ROUND(cx, 2) AS x, ROUND(cy, 2) AS y, speed_before AS speed_before_m_s, speed_after AS speed_after_m_s, turn_deg AS direction_change_deg, score, court_side, player, player_distance, in_out FROM o_events""")
def event_rows(fx):
    from rallyframe.sources.sinks import event_rows as op
    return through_files(op(Tables(fx).events))


@query("shot_rows", "IO-10 JN-10", """
SELECT match_id, frame_idx, timestamp_sec, owner, ball_cx, ball_cy, shot_type, ROUND(speed_m_s, 2) AS speed_m_s, court_side, COALESCE(CASE WHEN frame_idx % 5 <> 0 THEN direction END, 'unknown') AS ball_direction_label FROM fx_shots""")
def shot_rows(fx):
    from rallyframe.sources.sinks import shot_rows as op
    labels = fx.shots.filter("frame_idx % 5 <> 0").select("match_id", "frame_idx", "direction")
    d = through_files(op(fx.shots.drop("direction"), labels))
    return d.select("match_id", "frame_idx", "timestamp_sec", "owner", "ball_cx", "ball_cy", "shot_type", "speed_m_s", "court_side", "ball_direction_label")


@query("point_rows", "IO-09", """
SELECT match_id, point_idx, start_frame, end_frame, serve_player, serve_zone, serve_fault_type, end_reason, rally_hit_count, confidence FROM o_serve""")
def point_rows(fx):
    from rallyframe.sources.sinks import point_rows as op
    return through_files(op(Tables(fx).serve_points)).select("match_id", "point_idx", "start_frame", "end_frame", "serve_player", "serve_zone", "serve_fault_type", "end_reason", "rally_hit_count", "confidence")
