"""Momentum, highlights, history, curation and evaluation."""
from __future__ import annotations

from pyspark.sql import functions as F

from rallyframe.operators import curation, history, momentum, points, stats
from rallyframe.plans.q_stats import Tables, rounded
from rallyframe.plans.registry import query


def won_points(fx):
    return stats.point_winners(fx.points, fx.shots)


@query("momentum_rolling", "WN-24", """
SELECT match_id, point_idx, winner, CAST(SUM(CASE WHEN winner = 'player_a' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS a_momentum,
  COUNT(*) OVER w - CAST(SUM(CASE WHEN winner = 'player_a' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS b_momentum
FROM o_winner WINDOW w AS (PARTITION BY match_id ORDER BY point_idx ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""")
def momentum_rolling(fx):
    return momentum.rolling_momentum(won_points(fx)).select("match_id", "point_idx", "winner", "a_momentum", "b_momentum")


_MOM = """
WITH p AS (SELECT *, CASE WHEN end_reason IN ('OUT', 'NET', 'NET_FAULT', 'OUT_LONG', 'OUT_WIDE', 'DOUBLE_BOUNCE') THEN CASE WHEN hitter = 'player_a' THEN 'player_b' ELSE 'player_a' END ELSE hitter END AS w2,
             ROW_NUMBER() OVER (PARTITION BY match_id ORDER BY point_idx) AS k FROM o_rebuilt)
"""


@query("momentum_decay", "WN-25", "WITH RECURSIVE " + _MOM.strip()[5:] + """,
r(match_id, k, point_idx, winner, a, b) AS (
  SELECT match_id, k, point_idx, w2, CASE WHEN w2 = 'player_a' THEN 1 ELSE 0 END, CASE WHEN w2 = 'player_a' THEN 0 ELSE 1 END FROM p WHERE k = 1
  UNION ALL SELECT p.match_id, p.k, p.point_idx, p.w2, CASE WHEN p.w2 = 'player_a' THEN r.a + 1 ELSE GREATEST(0, r.a - 1) END, CASE WHEN p.w2 = 'player_a' THEN GREATEST(0, r.b - 1) ELSE r.b + 1 END
  FROM r JOIN p ON p.match_id = r.match_id AND p.k = r.k + 1)
SELECT match_id, point_idx, winner, CAST(a AS BIGINT) AS a_momentum, CAST(b AS BIGINT) AS b_momentum FROM r""")
def momentum_decay(fx):
    d = stats.with_rebuilt_winner(fx.points, fx.shots, extra_errors=["DOUBLE_BOUNCE"])
    return momentum.decaying_momentum(d).select("match_id", "point_idx", "winner", "a_momentum", "b_momentum")


@query("running_score", "WN-26", """
SELECT match_id, point_idx, CAST(SUM(CASE WHEN winner = 'player_a' THEN 1 ELSE -1 END) OVER (PARTITION BY match_id ORDER BY point_idx) AS BIGINT) AS score FROM o_winner""")
def running_score(fx):
    return momentum.running_score(won_points(fx)).select("match_id", "point_idx", "score")


@query("running_score_fallback", "WN-26", """
SELECT match_id, point_idx, CAST(SUM(CASE WHEN end_reason = 'OUT' THEN -1 WHEN rally_hit_count > 6 THEN 1 ELSE 0 END) OVER (PARTITION BY match_id ORDER BY point_idx) AS BIGINT) AS score FROM fx_points""")
def running_score_fallback(fx):
    return momentum.running_score(fx.points.withColumn("winner", F.lit(None).cast("string"))).select("match_id", "point_idx", "score")


_STREAK = """
WITH g AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY match_id ORDER BY point_idx) - ROW_NUMBER() OVER (PARTITION BY match_id, winner ORDER BY point_idx) AS g, MAX(point_idx) OVER (PARTITION BY match_id) AS lastp FROM o_winner),
s AS (SELECT match_id, winner, COUNT(*) AS length, MIN(start_sec) AS start_sec, MAX(end_sec) AS end_sec, MAX(point_idx) = MAX(lastp) AS final FROM g GROUP BY match_id, winner, g HAVING COUNT(*) >= 3)
"""


@query("streaks", "WN-27", _STREAK + "SELECT match_id, winner, length, ROUND(start_sec, 6) AS start_sec, ROUND(end_sec, 6) AS end_sec, final FROM s")
def streaks(fx):
    return rounded(momentum.streaks(won_points(fx)))


@query("repeated_errors", "WN-29", """
WITH e AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY match_id, last_owner, COALESCE(last_type, ''), COALESCE(last_direction, '') ORDER BY point_idx) AS nth FROM o_winner WHERE end_reason IN ('OUT', 'NET') AND last_owner IS NOT NULL)
SELECT match_id, point_idx, nth, CASE WHEN nth > 1 THEN 'This is the ' || nth || CASE WHEN nth % 100 BETWEEN 10 AND 13 THEN 'th' WHEN nth % 10 = 1 THEN 'st' WHEN nth % 10 = 2 THEN 'nd' WHEN nth % 10 = 3 THEN 'rd' ELSE 'th' END
  || ' ' || COALESCE(last_type, '') || ' ' || COALESCE(last_direction, '') || ' error by ' || CASE WHEN last_owner = 'player_a' THEN 'Player A.' ELSE 'Player B.' END ELSE '' END AS pattern_context FROM e""")
def repeated_errors(fx):
    return momentum.repeated_errors(stats.with_last_shot(fx.points, fx.shots)).select("match_id", "point_idx", "nth", "pattern_context")


_INPOINT = "SELECT p.match_id, p.point_idx, s.frame_idx, s.owner, s.shot_type, s.direction FROM fx_points p JOIN fx_shots s ON s.match_id = p.match_id AND s.frame_idx BETWEEN p.start_frame AND p.end_frame"


@query("repeated_direction", "WN-36", f"""
WITH j AS ({_INPOINT}), o AS (SELECT j.*, ROW_NUMBER() OVER (PARTITION BY j.match_id, j.point_idx, j.owner ORDER BY j.frame_idx DESC) AS r, COUNT(*) OVER (PARTITION BY j.match_id, j.point_idx, j.owner) AS times
  FROM j JOIN o_last l ON l.match_id = j.match_id AND l.point_idx = j.point_idx AND l.last_owner = j.owner)
SELECT match_id, point_idx, owner, MIN(direction) AS direction, MIN(times) AS times FROM o WHERE r <= 3 GROUP BY 1, 2, 3 HAVING COUNT(*) = 3 AND MIN(direction) = MAX(direction) AND MIN(direction) <> 'unknown'""")
def repeated_direction(fx):
    return momentum.repeated_direction(points.rows_in_points(fx.shots.select("match_id", "frame_idx", "owner", "direction"), fx.points))


@query("key_shots", "SL-09 SL-08", f"""
WITH j AS ({_INPOINT}), n AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY match_id, point_idx ORDER BY frame_idx) AS shot_no, COUNT(*) OVER (PARTITION BY match_id, point_idx) AS shots_in_point FROM j)
SELECT match_id, point_idx, frame_idx, shot_no, shots_in_point FROM n WHERE shots_in_point <= 8 OR shot_no <= 2 OR shot_no > shots_in_point - 4""")
def key_shots(fx):
    return momentum.key_shots(points.rows_in_points(fx.shots.select("match_id", "frame_idx"), fx.points)).select("match_id", "point_idx", "frame_idx", "shot_no", "shots_in_point")


@query("trailing_positions", "WN-32", """
WITH m AS (SELECT *, COALESCE(MAX(CASE WHEN ball_px IS NULL THEN frame_idx END) OVER (PARTITION BY match_id ORDER BY frame_idx), -1) AS miss FROM fx_frames)
SELECT match_id, frame_idx, CAST(LEAST(10, frame_idx - miss) AS INTEGER) AS trail_length, CASE WHEN frame_idx > miss THEN GREATEST(miss + 1, frame_idx - 9) END AS oldest FROM m""")
def trailing_positions(fx):
    d = momentum.trailing_positions(fx.frames.select("match_id", "frame_idx", "ball_px", "ball_py"), "ball_px", "ball_py")
    return d.select("match_id", "frame_idx", F.size("trail").alias("trail_length"), F.when(F.size("trail") > 0, F.try_element_at("trail", F.lit(1)).frame_idx).alias("oldest"))


@query("pose_sequences", "WN-33", """
WITH l AS (SELECT s.match_id, s.frame_idx AS f, s.owner, p.kps FROM fx_shots s LEFT JOIN fx_poses p ON p.match_id = s.match_id AND p.player = s.owner AND p.frame_idx BETWEEN s.frame_idx - 15 AND s.frame_idx + 14),
v AS (SELECT match_id, f, owner, kps, list_sum(list_transform(range(1, 14), lambda i: CASE WHEN kps[i].conf > 0.1 THEN kps[i].y + kps[i].x ELSE 0 END)) AS total FROM l)
SELECT match_id, f AS frame_idx, owner, COUNT(*) FILTER (total > 0) AS pose_frames, COUNT(*) FILTER (total > 0) >= 3 AS usable, ROUND(COALESCE(SUM(total), 0), 6) AS total, 780 AS cells FROM v GROUP BY 1, 2, 3""")
def pose_sequences(fx):
    d = momentum.pose_sequences(fx.shots, fx.poses)
    flat = F.flatten("sequence")
    return d.select("match_id", "frame_idx", "owner", "pose_frames", "usable",
                    F.round(F.aggregate(flat, F.lit(0.0), lambda a, b: a + b), 6).alias("total"), F.size(flat).alias("cells"))


@query("live_frames", "WN-34", """
WITH s AS (SELECT match_id, frame_idx, frame_idx // 3 AS no, list_transform(range(16), lambda i: CAST((frame_idx // 7 * 31 + i * 17) % 256 AS INTEGER)) AS g FROM fx_frames WHERE frame_idx % 3 = 0),
d AS (SELECT *, list_sum(list_transform(range(1, 17), lambda i: abs(g[i] - p[i]))) / 16.0::DOUBLE / 255 AS delta FROM (SELECT *, LAG(g) OVER (PARTITION BY match_id ORDER BY no) AS p FROM s))
SELECT match_id, frame_idx FROM d WHERE delta IS NULL OR delta >= 0.02""")
def live_frames(fx):
    gray = F.expr("transform(sequence(0, 15), i -> CAST((frame_idx div 7 * 31 + i * 17) % 256 AS INT))")
    return momentum.live_frames(fx.frames.select("match_id", "frame_idx", gray.alias("gray")), 30.0, 10.0).select("match_id", "frame_idx")


_RUNS = """
WITH s AS (SELECT match_id, frame_idx // 2 AS no, ball_px IS NOT NULL AS seen FROM fx_frames WHERE frame_idx % 2 = 0),
g AS (SELECT *, no - ROW_NUMBER() OVER (PARTITION BY match_id ORDER BY no) AS g FROM s WHERE seen),
r AS (SELECT match_id, MIN(no) AS a, MAX(no) AS b, COUNT(*) AS length FROM g GROUP BY match_id, g HAVING COUNT(*) >= 8),
v AS (SELECT r.match_id, r.a * 2 AS frame_idx, length FROM r WHERE EXISTS (SELECT 1 FROM s WHERE s.match_id = r.match_id AND s.no = r.b + 1))
"""


def _visible(fx):
    return momentum.visible_runs(fx.frames.select("match_id", "frame_idx", "ball_px"), "ball_px IS NOT NULL", 2)


@query("visible_runs", "WN-35", _RUNS + "SELECT match_id, frame_idx, length FROM v")
def visible_runs(fx):
    return _visible(fx)


@query("clustered_highlights", "WN-19 SL-05", "WITH RECURSIVE " + _RUNS.strip()[5:] + """,
k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY match_id ORDER BY frame_idx) AS k FROM v),
c(match_id, k, frame_idx, kept, ok) AS (SELECT match_id, k, frame_idx, frame_idx, TRUE FROM k WHERE k = 1
  UNION ALL SELECT k.match_id, k.k, k.frame_idx, CASE WHEN k.frame_idx - c.kept > 300 THEN k.frame_idx ELSE c.kept END, k.frame_idx - c.kept > 300 FROM c JOIN k ON k.match_id = c.match_id AND k.k = c.k + 1),
n AS (SELECT match_id, frame_idx, ROW_NUMBER() OVER (PARTITION BY match_id ORDER BY frame_idx) AS rank FROM c WHERE ok)
SELECT match_id, frame_idx, CAST(rank AS INTEGER) AS rank FROM n WHERE rank <= 5""")
def clustered_highlights(fx):
    return momentum.first_k(momentum.cluster_events(_visible(fx), 300).select("match_id", "frame_idx"), 5)


@query("temporal_split", "WN-37", """
SELECT match_id, frame_idx, CASE WHEN ROW_NUMBER() OVER (PARTITION BY match_id ORDER BY frame_idx) <= floor(COUNT(*) OVER (PARTITION BY match_id) * 0.75) THEN 'train' ELSE 'test' END AS part FROM fx_frames""")
def temporal_split(fx):
    return momentum.temporal_split(fx.frames.select("match_id", "frame_idx"))


@query("merged_reindex", "SO-05", """
SELECT match_id, start_frame // 300 AS segment_idx, point_idx, ROW_NUMBER() OVER (PARTITION BY match_id ORDER BY start_frame // 300, point_idx) - 1 AS merged_idx FROM fx_points""")
def merged_reindex(fx):
    p = fx.points.select("match_id", F.expr("start_frame div 300").alias("segment_idx"), "point_idx")
    return momentum.reindex(p)


# --- history --------------------------------------------------------------------------------------

@query("match_snapshot", "HI-01 SL-04", """
WITH m AS (SELECT match_id, owner, arg_max(shot_type, n * 1000000 - seen) AS dominant_pattern FROM o_mix GROUP BY 1, 2),
s AS (SELECT match_id, owner, COUNT(*) AS total_shots, COALESCE(AVG(CASE WHEN speed_m_s > 0 THEN speed_m_s END), 0) AS v FROM fx_shots GROUP BY 1, 2)
SELECT w.match_id, w.owner, COALESCE(s.total_shots, 0) AS total_shots, w.points_won, w.points_lost, ROUND(v.first_serve_pct, 6) AS first_serve_pct, v.double_faults, m.dominant_pattern,
  (SELECT COUNT(*) FROM fx_points p WHERE p.match_id = w.match_id) AS total_points, ROUND(COALESCE(s.v, 0) * 3.6::DOUBLE, 1) AS avg_shot_speed_kmh,
  (SELECT SUM(x.n) FROM o_mix x WHERE x.match_id = w.match_id AND x.owner = w.owner AND x.shot_type = 'serve')::BIGINT AS serves_hit,
  (SELECT ROUND(rate / 100, 6) FROM o_errtype t WHERE t.match_id = w.match_id AND t.owner = w.owner AND t.shot_type = 'backhand') AS backhand_rate,
  (SELECT ROUND(rate / 100, 6) FROM o_errrally t WHERE t.match_id = w.match_id AND t.owner = w.owner AND t.bucket = '10+') AS long_rate
FROM o_won w LEFT JOIN m ON m.match_id = w.match_id AND m.owner = w.owner LEFT JOIN s ON s.match_id = w.match_id AND s.owner = w.owner LEFT JOIN o_servesum v ON v.match_id = w.match_id AND v.owner = w.owner""")
def match_snapshot(fx):
    d = history.snapshot(Tables(fx).serve_points, fx.shots)
    at = lambda m, k: F.try_element_at(m, F.lit(k))
    return rounded(d.select("match_id", "owner", "total_shots", "points_won", "points_lost", "first_serve_pct", "double_faults", "dominant_pattern", "total_points", "avg_shot_speed_kmh",
                            at("shot_type_counts", "serve").alias("serves_hit"), at("error_rate_by_shot", "backhand").alias("backhand_rate"), at("error_rate_by_rally", "10+").alias("long_rate")))


_SERIES = """
WITH h AS (SELECT *, CASE WHEN COUNT(rally_79) OVER (PARTITION BY player_id) > 0 THEN rally_79 ELSE rally_10 END AS long_rally FROM fx_history),
s AS (SELECT player_id, job_id, match_date, u.metric, ROUND(u.value, 3) AS value FROM h CROSS JOIN LATERAL (VALUES ('backhand', backhand), ('forehand', forehand), ('long_rally', long_rally), ('first_serve', first_serve), ('speed_kmh', speed_kmh)) AS u(metric, value) WHERE u.value IS NOT NULL)
"""


@query("player_trend", "HI-02 SL-07", _SERIES + "SELECT player_id, job_id, match_date, metric, value FROM s ORDER BY player_id, metric, match_date, job_id")
def player_trend(fx):
    return history.series(fx.history).orderBy("player_id", "metric", "match_date", "job_id")


@query("dominant_patterns", "HI-03", "SELECT player_id, dominant_pattern, COUNT(*) AS matches FROM fx_history GROUP BY 1, 2")
def dominant_patterns(fx):
    return history.dominant_counts(fx.history)


@query("confirmed_weakness", "HI-04", _SERIES + """,
g AS (SELECT player_id, metric, COUNT(*) AS n, COUNT(*) FILTER (CASE metric WHEN 'backhand' THEN value >= 0.3 WHEN 'long_rally' THEN value >= 0.5 ELSE value < 0.6 END) AS hi, AVG(value) AS a FROM s WHERE metric IN ('backhand', 'long_rally', 'first_serve') GROUP BY 1, 2),
c AS (SELECT *, hi >= GREATEST(1, round(n * 0.6)) AS confirmed FROM g)
SELECT player_id, CASE metric WHEN 'backhand' THEN 'Backhand consistency' WHEN 'long_rally' THEN 'Long rally endurance' ELSE 'First serve reliability' END AS weakness, n AS matches_count, hi AS high_error_matches,
  ROUND(CASE WHEN metric = 'first_serve' THEN 1 - a ELSE a END, 6) AS avg_rate, confirmed FROM c
WHERE CASE metric WHEN 'backhand' THEN a >= 0.25 OR confirmed WHEN 'long_rally' THEN a >= 0.4 ELSE a < 0.6 END""")
def confirmed_weakness(fx):
    return rounded(history.confirmed_weaknesses(fx.history))


@query("trend_summary", "HI-05", _SERIES + """
SELECT h.player_id, COUNT(*) AS match_count, ROUND(AVG(h.speed_kmh), 6) AS avg_shot_speed_kmh, MIN(h.match_date) AS first_date, MAX(h.match_date) AS last_date, COUNT(h.backhand) AS n_backhand, COUNT(h.forehand) AS n_forehand, COUNT(h.long_rally) AS n_long_rally, COUNT(h.first_serve) AS n_first_serve FROM h GROUP BY 1""")
def trend_summary(fx):
    return rounded(history.trend_summary(fx.history))


_BASE = """
WITH h AS (SELECT *, GREATEST(rally_79, rally_10) AS lr FROM fx_history),
b AS (SELECT player_key, COUNT(DISTINCT job_id) AS match_count, AVG(backhand) AS bb, AVG(lr) AS bl, AVG(first_serve) AS bs, AVG(speed_kmh) AS bv, COUNT(backhand) AS nb, COUNT(lr) AS nl, COUNT(first_serve) AS ns,
   COUNT(*) FILTER (backhand >= 0.3) AS hb, COUNT(*) FILTER (lr >= 0.5) AS hl, COUNT(*) FILTER (first_serve < 0.6) AS hs FROM h GROUP BY 1)
"""


@query("history_delta", "HI-06 HI-08", _BASE + """
SELECT player_key, job_id, match_count, match_count >= 3 AS enabled, ROUND((backhand - bb) * 100, 6) AS backhand_delta_pp, ROUND((lr - bl) * 100, 6) AS long_rally_delta_pp, ROUND((first_serve - bs) * 100, 6) AS first_serve_delta_pp, ROUND(speed_kmh - bv, 6) AS speed_delta_kmh FROM h JOIN b USING (player_key)""")
def history_delta(fx):
    return rounded(history.deltas(fx.history))


@query("persistent_weakness", "HI-07", _BASE + """
SELECT player_key, u.name, ROUND(u.base * 100, 6) AS baseline_rate_pct, u.hit AS matches_triggered, u.n AS matches_with_data, u.hit >= GREATEST(2, ceil(u.n * 0.6)) AS confirmed
FROM b CROSS JOIN LATERAL (VALUES ('Backhand consistency', bb, hb, nb), ('Long-rally errors (7+ shots)', bl, hl, nl), ('First-serve reliability', bs, hs, ns)) AS u(name, base, hit, n) WHERE u.n > 0""")
def persistent_weakness(fx):
    return rounded(history.persistent_weaknesses(fx.history))


@query("history_summary", "NA-15", _BASE + """
SELECT player_key, job_id, 'Backhand error averages ' || printf('%.1f', round_even(bb * 100, 1)) || '% across ' || match_count || ' matches. Long-rally error averages ' || printf('%.1f', round_even(bl * 100, 1)) || '% across ' || match_count
  || ' matches. Today vs baseline: backhand error ' || CASE WHEN (backhand - bb) * 100 >= 0 THEN '+' ELSE '' END || printf('%.1f', round_even((backhand - bb) * 100, 1)) || ' percentage points.' AS summary FROM h JOIN b USING (player_key) WHERE match_count >= 3""")
def history_summary(fx):
    return history.summary_lines(fx.history)


# --- curation -------------------------------------------------------------------------------------

@query("near_dup_frames", "CU-01 SC-36", "WITH RECURSIVE a AS MATERIALIZED (SELECT *, ROW_NUMBER() OVER (ORDER BY frame_no) AS k FROM fx_hashes WHERE w0 IS NOT NULL), nb AS MATERIALIZED (SELECT x.k, list(y.k) AS earlier FROM a x JOIN a y ON y.k < x.k AND "
       + " + ".join(f"bit_count(xor(x.w{i}, y.w{i}))::INTEGER" for i in range(8)) + """ <= 10 GROUP BY 1),
r(k, frame_no, kept, ok) AS (SELECT k, frame_no, [k], TRUE FROM a WHERE k = 1
  UNION ALL SELECT a.k, a.frame_no, CASE WHEN list_has_any(COALESCE(nb.earlier, []), r.kept) THEN r.kept ELSE list_append(r.kept, a.k) END, NOT list_has_any(COALESCE(nb.earlier, []), r.kept)
  FROM r JOIN a ON a.k = r.k + 1 LEFT JOIN nb ON nb.k = a.k)
SELECT frame_no FROM r WHERE ok UNION ALL SELECT frame_no FROM fx_hashes WHERE w0 IS NULL""")
def near_dup_frames(fx):
    return curation.near_duplicates(fx.hashes, [f"w{i}" for i in range(8)])


@query("diverse_frames", "CU-02", """
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), f AS (SELECT vec_id, e FROM v ORDER BY vec_id LIMIT 1),
d(step, vec_id, e, m) AS (SELECT 1, v.vec_id, v.e, CASE WHEN v.vec_id = f.vec_id THEN -1 ELSE list_distance(v.e, f.e) END FROM v, f
  UNION ALL SELECT step + 1, vec_id, e, CASE WHEN vec_id = pick THEN -1 ELSE LEAST(m, list_distance(e, pe)) END
  FROM (SELECT *, FIRST_VALUE(vec_id) OVER (ORDER BY m DESC, vec_id) AS pick, FIRST_VALUE(e) OVER (ORDER BY m DESC, vec_id) AS pe FROM d) WHERE step < 24)
SELECT vec_id FROM d WHERE step = 24 AND m = -1""")
def diverse_frames(fx):
    return curation.diverse_subset(fx.table("embeddings"))


@query("frame_shards", "CU-03", "SELECT match_id, frame_idx, (ROW_NUMBER() OVER (PARTITION BY match_id ORDER BY frame_idx) - 1) // 25 AS shard FROM fx_frames")
def frame_shards(fx):
    return curation.shards(fx.frames.select("match_id", "frame_idx"))


@query("shard_qc", "CU-04", """
WITH s AS (SELECT match_id, frame_idx, (ROW_NUMBER() OVER (PARTITION BY match_id ORDER BY frame_idx) - 1) // 25 AS shard FROM fx_frames),
f AS (SELECT match_id, frame_idx, COUNT(*) FILTER (class_id = 0) AS p, COUNT(*) FILTER (class_id = 1) AS b, arg_min(w * h, box_no) FILTER (w * h > 0.5) AS big FROM fx_boxes GROUP BY 1, 2),
r AS (SELECT s.*, CASE WHEN p > 4 THEN 'Unlikely count: ' || p || ' players in a frame (doubles has 4)' WHEN b > 2 THEN 'Too many balls: ' || b || ' in a frame'
   WHEN big IS NOT NULL THEN 'A box fills ' || CAST(round_even(big * 100, 0) AS BIGINT) || '% of the frame (limit 50%)' END AS reason FROM s LEFT JOIN f ON f.match_id = s.match_id AND f.frame_idx = s.frame_idx)
SELECT match_id, shard, arg_min(reason, frame_idx) FILTER (reason IS NOT NULL) AS reason, COUNT(*) AS frames, COUNT(reason) = 0 AS valid FROM r GROUP BY 1, 2""")
def shard_qc(fx):
    return curation.shard_quality(fx.boxes, curation.shards(fx.frames.select("match_id", "frame_idx")))


@query("hash_split", "CU-05", "SELECT match_id, frame_idx, CASE WHEN substring(md5(match_id || '_' || frame_idx), 1, 4) < 'cccd' THEN 'train' ELSE 'val' END AS part FROM fx_frames")
def hash_split(fx):
    return curation.hash_split(fx.frames.select("match_id", "frame_idx"), "match_id", "frame_idx")


_UNMET = """
list_filter([CASE WHEN frame_count < 500 THEN 'Too few frames: ' || frame_count || ' < 500 required' END,
 CASE WHEN player_map < 0.80 THEN 'Player detection under its target: ' || printf('%.2f', player_map) || ' < 0.80' END, CASE WHEN ball_map < 0.70 THEN 'Ball detection under its target: ' || printf('%.2f', ball_map) || ' < 0.70' END,
 CASE WHEN court_lines_map < 0.75 THEN 'Court lines detection under its target: ' || printf('%.2f', court_lines_map) || ' < 0.75' END, CASE WHEN net_map < 0.75 THEN 'Net detection under its target: ' || printf('%.2f', net_map) || ' < 0.75' END,
 CASE WHEN fp_rate > 0.10 THEN 'Too many false positives: ' || printf('%.2f', fp_rate) || ' > 0.10' END], lambda x: x IS NOT NULL)"""


@query("exit_criteria", "CU-06", f"SELECT job_id, iteration, len({_UNMET}) = 0 AS criteria_met, array_to_string({_UNMET}, '; ') AS unmet FROM fx_evals")
def exit_criteria(fx):
    return curation.exit_criteria(fx.evals).select("job_id", "iteration", "criteria_met", F.array_join("unmet", "; ").alias("unmet"))


_P = "CAST(round_even({} * 100, 0) AS BIGINT) || '%'"
_LOW = ("array_to_string(list_filter([CASE WHEN player_map < 0.8 THEN 'player at ' || " + _P.format("player_map") + " || ' (target 80%)' END, CASE WHEN ball_map < 0.7 THEN 'ball at ' || " + _P.format("ball_map")
        + " || ' (target 70%)' END, CASE WHEN court_lines_map < 0.75 THEN 'court lines at ' || " + _P.format("court_lines_map") + " || ' (target 75%)' END, CASE WHEN net_map < 0.75 THEN 'net at ' || " + _P.format("net_map")
        + " || ' (target 75%)' END], lambda x: x IS NOT NULL), ' and ')")


@query("next_action", "CU-07", f"""
WITH e AS (SELECT *, {_UNMET} AS unmet, LAG(player_map) OVER (PARTITION BY job_id ORDER BY iteration) AS prev, {_LOW} AS lows FROM fx_evals),
a AS (SELECT *, CASE WHEN len(unmet) = 0 THEN 1 WHEN iteration >= 3 THEN 2 WHEN ball_map < 0.7 AND player_map >= 0.8::DOUBLE * 0.9::DOUBLE THEN 3 WHEN player_map < 0.8 AND frame_count < 500 THEN 4 WHEN fp_rate > 0.1 THEN 5
  WHEN lows <> '' AND abs(player_map - prev) < 0.03::DOUBLE THEN 6 WHEN lows <> '' THEN 7 ELSE 8 END AS rule FROM e)
SELECT job_id, iteration, CASE rule WHEN 1 THEN 'exit' WHEN 2 THEN 'exit' WHEN 4 THEN 'mine_frames' WHEN 5 THEN 'relabel' WHEN 6 THEN 'mine_frames' ELSE 'retrain' END AS action,
 CASE rule WHEN 1 THEN 'Every target reached after ' || iteration || ' training pass' || CASE WHEN iteration <> 1 THEN 'es' ELSE '' END || '. Player: ' || {_P.format('player_map')} || ', Ball: ' || {_P.format('ball_map')} || ', Court lines: ' || {_P.format('court_lines_map')} || ', Net: ' || {_P.format('net_map')} || ', False positive rate: ' || {_P.format('fp_rate')} || '. Done.'
  WHEN 2 THEN 'Stopping at the limit of 3 training passes; the best model so far is kept. Still open: ' || array_to_string(unmet, '; ') || '.'
  WHEN 3 THEN 'The ball is found too rarely, at ' || {_P.format('ball_map')} || ' — below the 70% target, while players are at ' || {_P.format('player_map')} || '. The next pass works on ball labels and their augmentation.'
  WHEN 4 THEN 'Players are at ' || {_P.format('player_map')} || ' — below the 80% target, with only ' || frame_count || ' frames to train on (wanted: 500+). Sampling goes to ' || LEAST(fps * 2, 30) || ' frames per second, at net approaches, baseline exchanges and serves above all.'
  WHEN 5 THEN 'Too much is found that is not there: ' || {_P.format('fp_rate')} || ' false positives (allowed: below 10%). Stricter rules for people off court: ball kids, officials, crowd. The worst frames are reviewed again.'
  WHEN 6 THEN 'No more progress: ' || lows || '. More varied play is added (rallies and serves from both sides, volleys) and sampling goes to ' || LEAST(fps + 5, 30) || ' frames per second.'
  WHEN 7 THEN 'Better, not yet enough: ' || lows || '. One more pass on the same frames with corrected labels.'
  ELSE 'Training goes on. Now: player ' || {_P.format('player_map')} || ', ball ' || {_P.format('ball_map')} || ', court lines ' || {_P.format('court_lines_map')} || ', net ' || {_P.format('net_map')} || '. Unmet: ' || array_to_string(unmet, '; ') || '.' END AS justification,
 CASE rule WHEN 3 THEN 'focus_ball_augmentation,ball_label_refinement' WHEN 4 THEN 'mine_hard_frames,fps=' || LEAST(fps * 2, 30) WHEN 5 THEN 'strict_crowd_exclusion,rerun_labeling' WHEN 6 THEN 'mine_hard_frames,fps=' || LEAST(fps + 5, 30) WHEN 7 THEN 'fps=' || LEAST(fps + 5, 30) END AS config_updates FROM a""")
def next_action(fx):
    return curation.next_action(fx.evals)


@query("fp_rate", "AG-40", "SELECT job_id, iteration, ROUND(1 - \"precision\", 4) AS fp FROM fx_evals")
def fp_rate(fx):
    return curation.false_positive_rate(fx.evals).select("job_id", "iteration", "fp")


@query("box_agreement", "AG-41", """
WITH c AS (SELECT match_id, frame_idx, COUNT(*) FILTER (confidence >= 0.25) AS p, COUNT(*) FILTER (class_id < 3 AND frame_idx % 4 <> 0) AS t FROM fx_boxes GROUP BY 1, 2)
SELECT match_id, ROUND(AVG(CASE WHEN p = 0 THEN 0::DOUBLE ELSE LEAST(1.0, p / CAST(t AS DOUBLE) * 0.8) END), 6) AS score, COUNT(*) AS frames FROM c WHERE t > 0 GROUP BY 1""")
def box_agreement(fx):
    return rounded(curation.box_agreement(fx.boxes.filter("confidence >= 0.25"), fx.boxes.filter("class_id < 3 AND frame_idx % 4 <> 0")))


@query("without_rejected", "JN-16 SO-03", "SELECT match_id, frame_idx, box_no FROM fx_boxes b WHERE NOT EXISTS (SELECT 1 FROM fx_shots s WHERE s.match_id = b.match_id AND s.frame_idx = b.frame_idx AND s.owner = 'player_a')")
def without_rejected(fx):
    fb = fx.shots.select("match_id", "frame_idx", F.when(F.col("owner") == "player_a", "reject").otherwise("keep").alias("action"))
    return curation.without_rejected(fx.boxes, fb).select("match_id", "frame_idx", "box_no")


@query("labelled_frames", "JN-17", "SELECT match_id, frame_idx FROM fx_frames f WHERE EXISTS (SELECT 1 FROM fx_boxes b WHERE b.match_id = f.match_id AND b.frame_idx = f.frame_idx)")
def labelled_frames(fx):
    return curation.labelled_frames(fx.frames.select("match_id", "frame_idx"), fx.boxes)


@query("label_lines", "IO-12", "SELECT match_id, frame_idx, box_no, printf('%d %.6f %.6f %.6f %.6f', class_id, cx, cy, w, h) AS line FROM fx_boxes")
def label_lines(fx):
    return curation.label_lines(fx.boxes)
