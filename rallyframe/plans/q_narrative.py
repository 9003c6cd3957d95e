"""Text tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from rallyframe.operators import momentum, narrative, stats
from rallyframe.plans.oracle import _N0
from rallyframe.plans.q_sequences import _STREAK
from rallyframe.plans.q_stats import Tables, rounded
from rallyframe.plans.registry import ORACLES, query, with_ctes
from rallyframe.session import pin


def _profile(fx, rebuilt=False, coverage=None):
    return narrative.profile(Tables(fx).serve_points, fx.shots, coverage, rebuilt)


def _coverage(fx):
    return stats.contact_path(fx.shots)


_PART = "array_to_string(list_filter([{}], lambda x: x IS NOT NULL), ' ')"
_N1 = "printf('%.1f', round_even({}, 1))"


@query("player_card", "NA-01 IO-15", f"""
WITH t AS (SELECT *, ROUND(n * 100.0::DOUBLE / SUM(n) OVER (PARTITION BY match_id, owner), 1) AS pct, ROW_NUMBER() OVER (PARTITION BY match_id, owner ORDER BY n DESC, seen) AS k FROM o_mix),
a AS (SELECT match_id, owner, SUM(n) AS total, string_agg(shot_type || ': ' || n, ', ' ORDER BY k) AS parts FROM t GROUP BY 1, 2),
d AS (SELECT p.match_id, p.owner, string_agg(p.name || '''s ' || shot_type || ' goes ' || replace(direction, '_', ' ') || ' ' || printf('%.1f', pct) || '% of the attempts.', ' ' ORDER BY seen) AS txt
   FROM o_topdir d JOIN o_players2 p ON p.match_id = d.match_id AND p.owner = d.owner WHERE shot_type NOT IN ('neutral', 'serve') AND pct > 50 AND direction <> 'unknown' GROUP BY 1, 2),
b AS (SELECT *, ROUND(n * 100.0::DOUBLE / SUM(n) OVER (PARTITION BY match_id, owner), 1) AS pct, ROW_NUMBER() OVER (PARTITION BY match_id, owner ORDER BY n DESC, seen) AS k FROM o_dirs),
z AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY match_id, owner ORDER BY ROUND(win_pct, 1) DESC, zs) AS k FROM (SELECT w.*, (SELECT MIN(point_idx) FROM o_serve s WHERE s.match_id = w.match_id AND s.serve_player = w.owner AND COALESCE(s.serve_zone, 'unknown') = w.zone) AS zs FROM o_zonewin w)),
c AS (SELECT match_id, owner, SUM(d) AS dist, AVG(ball_cx) AS cx, AVG(ball_cy) AS cy FROM (SELECT *, sqrt(POWER(ball_cx - LAG(ball_cx) OVER w, 2) + POWER(ball_cy - LAG(ball_cy) OVER w, 2)) AS d FROM fx_shots WINDOW w AS (PARTITION BY match_id, owner ORDER BY frame_idx)) GROUP BY 1, 2),
x AS (SELECT p.*, {_PART.format("CASE WHEN t.shot_type <> 'neutral' AND t.pct > 30 THEN p.name || ' relies mostly on ' || t.shot_type || 's (' || printf('%.1f', t.pct) || '% of what they hit).' END, d.txt, CASE WHEN b.pct > 25 THEN p.name || '''s favourite combination is ' || b.shot_type || ' ' || replace(b.direction, '_', ' ') || ' (' || printf('%.1f', b.pct) || '% of strokes).' END")} AS tend,
   CASE WHEN s.first_serve_pct > 0 THEN p.name || ' has a ' || printf('%.1f', ROUND(s.first_serve_pct, 1)) || '% of first serves in.' || CASE WHEN ROUND(z.win_pct, 1) > 0 THEN ' Best serving target: ' || replace(z.zone, '_', ' ') || ' (' || printf('%.1f', ROUND(z.win_pct, 1)) || '% of those points won).' ELSE '' END ELSE '' END AS serve_summary,
   'Shots by type: ' || a.parts || ' (all: ' || a.total || ')' AS shot_distribution, p.name || ' covered ' || {_N0.format('c.dist')} || ' court units around a mean spot of (' || {_N0.format('c.cx')} || ', ' || {_N0.format('c.cy')} || ').' AS coverage_summary
  FROM o_players2 p JOIN t ON t.match_id = p.match_id AND t.owner = p.owner AND t.k = 1 JOIN a ON a.match_id = p.match_id AND a.owner = p.owner LEFT JOIN d ON d.match_id = p.match_id AND d.owner = p.owner JOIN b ON b.match_id = p.match_id AND b.owner = p.owner AND b.k = 1
  JOIN o_servesum s ON s.match_id = p.match_id AND s.owner = p.owner LEFT JOIN z ON z.match_id = p.match_id AND z.owner = p.owner AND z.k = 1 JOIN c ON c.match_id = p.match_id AND c.owner = p.owner)
SELECT match_id, owner, CASE WHEN tend = '' THEN 'Too few shots to describe ' || name || '''s habits.' ELSE tend END AS tendencies, serve_summary, shot_distribution, coverage_summary FROM x""")
def player_card(fx):
    c = narrative.player_cards(_profile(fx, coverage=_coverage(fx)), stats.pattern_top(fx.shots))
    return c.select("match_id", "owner", F.array_join("tendencies", " ").alias("tendencies"), "serve_summary", "shot_distribution", "coverage_summary")


@query("exploit_plan", "NA-02", f"""
WITH d AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY match_id, owner ORDER BY seen) AS f FROM o_topdir WHERE shot_type NOT IN ('neutral', 'serve', 'unknown') AND pct > 70 AND direction <> 'unknown')
SELECT p.match_id, p.owner, CASE WHEN p.long > p.short + 15 AND p.lost >= 2 THEN 'Keep the ball in play beyond shot 7: ' || name || '''s errors climb from ' || {_N0.format('short')} || '% to ' || {_N0.format('long')} || '% once a rally is long (' || lost || ' points given away so far).'
  WHEN w.rate > 25 AND w.errors >= 2 THEN 'Attack ' || name || '''s ' || w.shot_type || ' — ' || {_N0.format('w.rate')} || '% of them miss (' || w.errors || ' misses so far). Aim there when it matters.'
  WHEN d.pct > 70 THEN 'Expect ' || name || '''s ' || d.shot_type || ' — ' || {_N0.format('d.pct')} || '% go ' || replace(d.direction, '_', ' ') || '. Knowing this lets ' || opp || ' set up early.' ELSE '' END AS exploit_plan
FROM o_players2 p LEFT JOIN o_worst w ON w.match_id = p.match_id AND w.owner = p.owner LEFT JOIN d ON d.match_id = p.match_id AND d.owner = p.owner AND d.f = 1""")
def exploit_plan(fx):
    return _profile(fx).select("match_id", "owner", narrative.exploit_plan().alias("exploit_plan"))


@query("weakness_report", "NA-03 SL-03", "SELECT match_id, owner, weakness_no, description, data_point, points_cost, ROUND(severity, 6) AS severity FROM o_weak WHERE weakness_no <= 3")
def weakness_report(fx):
    return rounded(narrative.weakness_report(_profile(fx)))


@query("weakness_evidence", "JN-20", """
WITH b AS (SELECT match_id, point_idx, CAST((ROW_NUMBER() OVER (PARTITION BY match_id ORDER BY point_idx) - 1) // 2 + 1 AS INTEGER) AS weakness_no, ROW_NUMBER() OVER (PARTITION BY match_id ORDER BY point_idx) AS k FROM fx_points WHERE end_reason IN ('OUT', 'BALL_LOST'))
SELECT w.match_id, w.owner, w.weakness_no, b.point_idx FROM o_weak w JOIN b ON b.match_id = w.match_id AND b.weakness_no = w.weakness_no AND b.k <= 6 WHERE w.weakness_no <= 3""")
def weakness_evidence(fx):
    w = narrative.weakness_report(_profile(fx)).select("match_id", "owner", "weakness_no")
    return momentum.weakness_evidence(w, fx.points).select("match_id", "owner", "weakness_no", "point_idx")


_HALF = """
h AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY match_id ORDER BY point_idx) > COUNT(*) OVER (PARTITION BY match_id) // 2 AS late FROM fx_points),
hf AS (SELECT match_id, COUNT(*) AS n, AVG(rally_hit_count) FILTER (NOT late) AS e, AVG(rally_hit_count) FILTER (late) AS l, AVG(rally_hit_count) AS a FROM h GROUP BY 1)
"""


@query("match_flow_insights", "NA-04 WN-27", _STREAK + "," + _HALF + f"""
SELECT match_id, 'streak' AS kind, CASE WHEN winner = 'player_a' THEN 'Player A' ELSE 'Player B' END || ' won ' || CASE WHEN final THEN 'the final ' || length || ' points in a row.' ELSE length || ' points in a row and took over.' END AS description, ROUND(start_sec, 6) AS start_sec, ROUND(end_sec, 6) AS end_sec FROM s
UNION ALL SELECT match_id, 'trend', 'Mean exchange ' || CASE WHEN l > e THEN 'increased' ELSE 'decreased' END || ' from ' || {_N1.format('e')} || ' shots before half-time to ' || {_N1.format('l')} || ' shots after it' || CASE WHEN l > e THEN ', so more was settled from the baseline.' ELSE ', perhaps from tired legs or caution.' END, NULL, NULL FROM hf WHERE n >= 6 AND abs(l - e) > 1.5
UNION ALL SELECT match_id, CASE WHEN ROUND(a, 1) < 3 THEN 'short' ELSE 'long' END, CASE WHEN ROUND(a, 1) < 3 THEN 'Mostly brief exchanges (mean ' || printf('%.1f', ROUND(a, 1)) || ' shots): serve and attack decided.' ELSE 'Mostly long exchanges (mean ' || printf('%.1f', ROUND(a, 1)) || ' shots): a match from the baseline.' END, NULL, NULL FROM hf WHERE ROUND(a, 1) < 3 OR ROUND(a, 1) > 7""")
def match_flow_insights(fx):
    return rounded(narrative.flow_insights(stats.point_winners(fx.points, fx.shots)))


@query("rebuilt_flow_insights", "NA-12", _STREAK.replace("FROM o_winner", "FROM o_rebuilt") + "," + _HALF + f"""
SELECT match_id, 'streak' AS kind, CASE WHEN winner = 'player_a' THEN 'Player A' ELSE 'Player B' END || ' won ' || length || ' points in a row and took over.' AS description, ROUND(start_sec, 6) AS start_sec, ROUND(end_sec, 6) AS end_sec FROM s
UNION ALL SELECT match_id, 'trend', 'Mean exchange ' || CASE WHEN l > e THEN 'increased' ELSE 'decreased' END || ' from ' || {_N1.format('e')} || ' shots before half-time to ' || {_N1.format('l')} || ' shots after it.', NULL, NULL FROM hf WHERE n >= 4 AND abs(l - e) > 2
UNION ALL SELECT match_id, CASE WHEN a < 4 THEN 'short' ELSE 'long' END, CASE WHEN a < 4 THEN 'Brief exchanges (mean ' || {_N1.format('a')} || ' shots): points were ended fast.' ELSE 'Mostly long exchanges (mean ' || {_N1.format('a')} || ' shots): a match from the baseline.' END, NULL, NULL FROM hf WHERE a < 4 OR a > 8""")
def rebuilt_flow_insights(fx):
    return rounded(narrative.flow_insights(stats.with_rebuilt_winner(fx.points, fx.shots), rebuilt=True))


_DIGEST = f"""
j AS (SELECT p.match_id, p.point_idx, s.*, ROW_NUMBER() OVER (PARTITION BY p.match_id, p.point_idx ORDER BY s.frame_idx) AS no, COUNT(*) OVER (PARTITION BY p.match_id, p.point_idx) AS n FROM fx_points p JOIN (SELECT match_id AS m, frame_idx, owner, shot_type, direction, speed_m_s FROM fx_shots) s ON s.m = p.match_id AND s.frame_idx BETWEEN p.start_frame AND p.end_frame),
g AS (SELECT match_id, point_idx, MAX(n) AS n, string_agg(CASE WHEN owner = 'player_a' THEN 'A' ELSE 'B' END || ' ' || COALESCE(shot_type, 'shot') || ' ' || direction || CASE WHEN speed_m_s <> 0 THEN ' (' || {_N0.format('speed_m_s')} || ' m/s)' ELSE '' END, ' → ' ORDER BY no)
   || CASE WHEN MAX(n) > 6 THEN ' → ... +' || MAX(n) - 6 || ' more' ELSE '' END AS digest FROM j WHERE no <= 6 GROUP BY 1, 2)
"""


@query("point_summaries", "NA-06 SL-08", "WITH " + _DIGEST + f"""
SELECT p.match_id, p.point_idx, COALESCE(g.n || '-shot rally (' || {_N1.format('end_sec - start_sec')} || 's): ' || g.digest, 'Took ' || {_N1.format('end_sec - start_sec')} || 's with ' || rally_hit_count || ' hits seen.') || '. '
  || CASE WHEN serve_fault_type IS NOT NULL AND rally_hit_count <= 1 THEN CASE serve_fault_type WHEN 'net' THEN 'Served into net' ELSE 'Serve ' || serve_fault_type END
     WHEN end_reason = 'OUT' THEN 'Ball out' WHEN end_reason = 'NET' THEN 'Ball stopped by the net' WHEN end_reason = 'DOUBLE_BOUNCE' THEN 'Double bounce' ELSE 'Ball left the tracked area' END
  || CASE WHEN serve_zone IS NOT NULL THEN '. Served to ' || replace(serve_zone, '_', ' ') ELSE '' END || '.' AS summary
FROM o_serve p LEFT JOIN g ON g.match_id = p.match_id AND g.point_idx = p.point_idx""")
def point_summaries(fx):
    return narrative.point_summaries(Tables(fx).serve_points, fx.shots).select("match_id", "point_idx", "summary")


@query("point_suggestions", "NA-07 WN-36", f"""
WITH j AS (SELECT p.match_id, p.point_idx, s.frame_idx, s.owner, s.direction FROM fx_points p JOIN fx_shots s ON s.match_id = p.match_id AND s.frame_idx BETWEEN p.start_frame AND p.end_frame),
o AS (SELECT j.*, ROW_NUMBER() OVER (PARTITION BY j.match_id, j.point_idx ORDER BY j.frame_idx DESC) AS r, COUNT(*) OVER (PARTITION BY j.match_id, j.point_idx) AS times FROM j JOIN o_last l ON l.match_id = j.match_id AND l.point_idx = j.point_idx AND l.last_owner = j.owner),
rep AS (SELECT match_id, point_idx, MIN(direction) AS d, MIN(times) AS times FROM o WHERE r <= 3 GROUP BY 1, 2 HAVING COUNT(*) = 3 AND MIN(direction) = MAX(direction)),
x AS (SELECT w.*, q.name, q.opp, q.short, q.long, COALESCE(last_type, 'shot') AS t, COALESCE((SELECT ROUND(e.rate, 1) FROM o_errtype e WHERE e.match_id = w.match_id AND e.owner = w.last_owner AND e.shot_type = COALESCE(w.last_type, 'shot')), 0) AS er, rep.d AS rd, rep.times
   FROM o_winner w LEFT JOIN o_players2 q ON q.match_id = w.match_id AND q.owner = w.last_owner LEFT JOIN rep ON rep.match_id = w.match_id AND rep.point_idx = w.point_idx)
SELECT match_id, point_idx, CASE WHEN last_owner IS NULL THEN ''
  WHEN rally_hit_count >= 7 AND long > short + 15 THEN opp || '''s plan pays off: ' || name || ' fades when points last (' || {_N0.format('long')} || '% missed against ' || {_N0.format('short')} || '% early on). Stay patient beyond shot 7.'
  WHEN end_reason = 'OUT' AND er > 20 AND t NOT IN ('neutral', 'unknown') THEN name || '''s ' || t || ' does not hold: ' || {_N0.format('er')} || '% missed so far. Keep asking for that shot.'
  WHEN end_reason = 'OUT' THEN name || ' went for the ' || replace(last_direction, '_', ' ') || ' and overshot; they reach for it when pressed and it''s costing them.'
  WHEN end_reason = 'NET' THEN name || '''s ' || t || ' caught the tape, probably hurried. Moving them wide should bring more of these.'
  WHEN rd IS NOT NULL THEN name || ' went ' || replace(rd, '_', ' ') || ' ' || times || ' times running, which ' || opp || ' can wait for.'
  WHEN rally_hit_count >= 5 THEN rally_hit_count || '-shot exchange, steady from both sides.' ELSE '' END AS suggestion FROM x""")
def point_suggestions(fx):
    return narrative.suggestions(fx.points, fx.shots, _profile(fx)).select("match_id", "point_idx", "suggestion")


@query("shot_sequence", "NA-05", """
SELECT p.match_id, p.point_idx, ROW_NUMBER() OVER (PARTITION BY p.match_id, p.point_idx ORDER BY s.frame_idx) AS shot_no, s.owner, CASE WHEN s.owner = 'player_a' THEN 'A' ELSE 'B' END AS owner_short, COALESCE(s.shot_type, 'unknown') AS shot_type, s.direction, s.speed_m_s, s.court_side
FROM fx_points p JOIN fx_shots s ON s.match_id = p.match_id AND s.frame_idx BETWEEN p.start_frame AND p.end_frame""")
def shot_sequence(fx):
    return narrative.shot_sequence(fx.points, fx.shots)


@query("point_cards", "NA-05", f"""
SELECT s.match_id, s.point_idx, p.start_sec, p.end_sec, s.summary, p.end_reason, p.rally_hit_count, p.confidence, COALESCE(r.pattern_context, '') AS pattern_context, COALESCE(g.suggestion, '') AS suggestion
FROM ({with_ctes(ORACLES["point_summaries"])}) s JOIN o_serve p ON p.match_id = s.match_id AND p.point_idx = s.point_idx
LEFT JOIN ({with_ctes(ORACLES["repeated_errors"])}) r ON r.match_id = s.match_id AND r.point_idx = s.point_idx
LEFT JOIN ({with_ctes(ORACLES["point_suggestions"])}) g ON g.match_id = s.match_id AND g.point_idx = s.point_idx""")
def point_cards(fx):
    """Summary, pattern context and suggestion together (each has its own oracle query)."""
    return narrative.point_cards(Tables(fx).serve_points, fx.shots, pin(_profile(fx)))


@query("basic_cards", "NA-08", f"""
WITH s AS (SELECT *, CASE WHEN point_idx % 2 = 0 THEN CASE WHEN bounce_cy > 1748 THEN 'near' WHEN bounce_cy IS NOT NULL THEN 'far' END END AS side FROM o_serve)
SELECT match_id, point_idx, {_PART.format(f"'Point ' || point_idx || ': ' || rally_hit_count || ' hits in ' || {_N1.format('end_sec - start_sec')} || 's.', CASE WHEN serve_zone IS NOT NULL THEN 'First ball hit the ' || replace(serve_zone, '_', ' ') || ' box.' WHEN serve_fault_type IS NOT NULL THEN 'The serve was called out (' || serve_fault_type || ').' END, CASE end_reason WHEN 'OUT' THEN 'The last ball landed outside.' WHEN 'DOUBLE_BOUNCE' THEN 'The ball touched the same side twice before anyone returned it.' WHEN 'NET' THEN 'The net stopped the last ball.' ELSE 'The ball left the camera''s view, most likely once play was over.' END")} AS summary,
 COALESCE(NULLIF({_PART.format('''CASE serve_fault_type WHEN 'wide' THEN 'The serve missed wide; a target nearer the middle of the box leaves more room.' WHEN 'long' THEN 'The serve missed long; more spin or less power brings it down in time.' WHEN 'net' THEN 'The serve met the net; toss higher and swing up for more clearance.' END,
   CASE WHEN end_reason = 'OUT' AND side = 'near' THEN 'The last ball missed on the near side; mind the depth.' WHEN end_reason = 'OUT' AND side = 'far' THEN 'The last ball missed on the far side; pick targets further inside.' END,
   CASE WHEN rally_hit_count >= 8 THEN 'A long exchange. Stamina is there; look for a ball to attack or follow to the net.' WHEN rally_hit_count <= 2 AND end_reason <> 'BALL_LOST' THEN 'Over quickly; get more balls back before going for it.' END,
   CASE WHEN end_reason = 'DOUBLE_BOUNCE' THEN 'With a second bounce the player couldn''t get there. A better ready position and split step would help.' END,
   CASE WHEN end_reason = 'NET' THEN 'The net took the ball. Give returns and passing shots more height.' END''')}, ''), 'A sound point. Keep it up.') AS suggestion FROM s""")
def basic_cards(fx):
    p = Tables(fx).serve_points
    side = F.when(F.col("point_idx") % 2 == 0, F.when(F.col("bounce_cy") > 1748, "near").when(F.col("bounce_cy").isNotNull(), "far"))
    return narrative.basic_cards(p.withColumn("last_bounce_side", side))


@query("fallback_cards", "NA-09", """
SELECT match_id, point_idx, CASE end_reason WHEN 'OUT' THEN 'Point ended with an out ball after ' || rally_hit_count || ' hits.' WHEN 'BALL_LOST' THEN 'Ball tracking was lost after ' || rally_hit_count || ' hits in this rally.' WHEN 'NET' THEN 'Ball hit the net after ' || rally_hit_count || ' hits.' ELSE 'Double bounce detected after ' || rally_hit_count || ' hits.' END
  || CASE WHEN serve_fault_type IS NOT NULL THEN ' Serve fault: ' || serve_fault_type || '.' ELSE '' END AS summary,
 CASE WHEN serve_fault_type = 'wide' THEN 'Aim serves more toward the center of the service box.' WHEN serve_fault_type = 'long' THEN 'Reduce serve power or add more topspin to keep it in the box.' WHEN serve_fault_type = 'net' THEN 'Increase serve trajectory height to clear the net.'
  WHEN end_reason = 'OUT' THEN 'Focus on keeping the ball within the court lines during extended rallies.' WHEN end_reason = 'BALL_LOST' THEN 'This point may have ended due to a fast exchange or camera angle change.' WHEN end_reason = 'NET' THEN 'Try adding more height over the net on approach shots.' ELSE 'Work on court coverage to reach the ball before the second bounce.' END AS suggestion FROM o_serve""")
def fallback_cards(fx):
    return narrative.fallback_cards(Tables(fx).serve_points)


@query("match_stories", "NA-13", """
WITH t AS (SELECT *, n * 100.0::DOUBLE / SUM(n) OVER (PARTITION BY match_id, owner) AS share, ROW_NUMBER() OVER (PARTITION BY match_id, owner ORDER BY n DESC, seen) AS k FROM o_mix),
r AS (SELECT match_id, owner, COALESCE(MAX(ROUND(rate, 1)) FILTER (bucket = '7-9'), MAX(ROUND(rate, 1)) FILTER (bucket = '10+')) AS lr FROM o_errrally GROUP BY 1, 2)
SELECT p.match_id, p.owner, """ + _PART.format("CASE WHEN t.share > 30 THEN p.name || ' is a ' || t.shot_type || ' hitter above all (' || CAST(round(t.share) AS BIGINT) || '% of strokes).' END, w.description, CASE WHEN r.lr > 40 THEN 'Loses control as points go on: misses reach ' || CAST(round(r.lr) AS BIGINT) || '% beyond shot seven.' END, 'Won ' || o.points_won || ' of ' || (o.points_won + o.points_lost) || ' points here.'") + """ AS story
FROM o_players2 p JOIN t ON t.match_id = p.match_id AND t.owner = p.owner AND t.k = 1 LEFT JOIN r ON r.match_id = p.match_id AND r.owner = p.owner LEFT JOIN o_weak w ON w.match_id = p.match_id AND w.owner = p.owner AND w.weakness_no = 1 JOIN o_won o ON o.match_id = p.match_id AND o.owner = p.owner""")
def match_stories(fx):
    prof = pin(_profile(fx))
    return narrative.match_stories(prof, narrative.weakness_report(prof))


_SENTENCES = f"""
WITH s AS (SELECT p.match_id, p.point_idx, s.shot_type AS t, s.direction AS d, s.speed_m_s AS v, ROW_NUMBER() OVER (PARTITION BY p.match_id, p.point_idx ORDER BY s.frame_idx DESC) AS k FROM fx_points p JOIN fx_shots s ON s.match_id = p.match_id AND s.owner = 'player_a' AND s.frame_idx BETWEEN p.start_frame AND p.end_frame),
a AS (SELECT match_id, ROUND(AVG(speed_m_s) FILTER (speed_m_s > 0), 1) AS av FROM fx_shots WHERE owner = 'player_a' GROUP BY 1),
r AS (SELECT match_id, COALESCE(MAX(ROUND(rate, 1)) FILTER (bucket = '7-9'), MAX(ROUND(rate, 1)) FILTER (bucket = '10+')) AS lr FROM o_errrally WHERE owner = 'player_a' GROUP BY 1),
x AS (SELECT p.*, s.t, s.d, s.v, a.av, r.lr, rally_hit_count AS h, {_N1.format('end_sec - start_sec')} AS dur, CAST(CAST(round(s.v * 3.6) AS BIGINT) AS VARCHAR) AS kmh, COALESCE(end_reason = 'BALL_LOST' AND serve_fault_type IS NULL AND rally_hit_count >= 7 AND r.lr > 40, FALSE) AS dz
  FROM o_serve p LEFT JOIN s ON s.match_id = p.match_id AND s.point_idx = p.point_idx AND s.k = 1 LEFT JOIN a ON a.match_id = p.match_id LEFT JOIN r ON r.match_id = p.match_id),
y AS (SELECT *, dz AND SUM(CASE WHEN dz THEN 1 ELSE 0 END) OVER (PARTITION BY match_id ORDER BY point_idx) = 1 AS once FROM x)
SELECT match_id, point_idx, 'player_a' AS owner, CASE WHEN serve_fault_type = 'long' THEN 'Long serve. ' || h || ' shots, over at once.' WHEN serve_fault_type = 'net' THEN 'Net serve. ' || h || ' shots.' WHEN serve_fault_type IS NOT NULL THEN 'Fault on serve (' || serve_fault_type || '). ' || h || ' shots in all.'
 WHEN end_reason = 'OUT' AND t IS NOT NULL AND v > av * 1.2::DOUBLE THEN 'Player A overhit a ' || t || ' ' || d || ' at ' || kmh || ' km/h - ' || CAST(round((v / av - 1) * 100) AS BIGINT) || '% faster than usual, and out after ' || h || ' hits.'
 WHEN end_reason = 'OUT' AND t IS NOT NULL AND v IS NOT NULL THEN 'Player A failed with a ' || t || ' ' || d || ' (' || kmh || ' km/h) after ' || h || ' hits. ' || dur || 's rally.'
 WHEN end_reason = 'OUT' AND t IS NOT NULL THEN t || ' mistake closed the point after ' || h || ' hits.' WHEN end_reason = 'OUT' THEN 'Own error, out after ' || h || ' hits over ' || dur || 's.'
 WHEN end_reason = 'NET' AND t IS NOT NULL THEN 'Player A''s ' || t || ' ' || d || ' met the net after ' || h || ' hits. ' || dur || 's rally.' WHEN end_reason = 'NET' THEN 'Ball stopped by the net ended a ' || h || '-hit, ' || dur || 's rally.'
 WHEN end_reason = 'DOUBLE_BOUNCE' THEN 'Opponent couldn''t get to the second bounce after ' || h || ' hits.'
 WHEN once THEN h || ' hits before the track broke off, and this is Player A''s weak stretch: misses reach ' || CAST(round(lr) AS BIGINT) || '% at this length.'
 WHEN t IS NOT NULL THEN 'The track broke off in a ' || t || ' exchange. ' || h || ' hits, ' || dur || 's.' ELSE 'The track broke off after ' || h || ' hits. ' || dur || 's rally.' END AS sentence FROM y"""


@query("point_sentences", "NA-14", f"SELECT * FROM ({_SENTENCES}) UNION ALL SELECT * FROM ({_SENTENCES.replace('player_a', 'player_b').replace('Player A', 'Player B')})")
def point_sentences(fx):
    points, profile = pin(Tables(fx).serve_points), pin(_profile(fx))
    return narrative.point_sentences(points, fx.shots, profile).unionByName(narrative.point_sentences(points, fx.shots, profile, "player_b"))


_P2 = "regexp_replace(printf('%.2f', ROUND({} * 100, 2)), '([.][0-9])0$', '\\1')"


@query("run_insights", "NA-10 AG-22 AG-23 AG-24", f"""
WITH r AS (SELECT match_id, COUNT(*) AS n, COUNT(*) FILTER (reliable) AS rel, AVG(error) AS err, COUNT(px) AS ball, AVG(speed) AS sp, MAX(speed) AS mx, COUNT(*) FILTER (has_b) AS b FROM o_frame GROUP BY 1),
d AS (SELECT match_id, COUNT(*) AS raw, COUNT(*) FILTER (inside) AS kept FROM o_located GROUP BY 1),
e AS (SELECT match_id, COUNT(*) FILTER (event_type = 'bounce') AS bo, COUNT(*) FILTER (event_type = 'hit') AS hi, COUNT(*) FILTER (in_out = 'in') AS i, COUNT(*) FILTER (in_out = 'out') AS o FROM o_events GROUP BY 1),
k AS (SELECT match_id, string_agg(serve_fault_type || ' ' || n, ', ' ORDER BY serve_fault_type) AS kinds FROM (SELECT match_id, serve_fault_type, COUNT(*) AS n FROM o_serve WHERE serve_fault_type IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
p AS (SELECT s.match_id, COUNT(*) AS np, AVG(rally_hit_count) AS ah, COUNT(serve_fault_type) AS f, ANY_VALUE(kinds) AS kinds FROM o_serve s LEFT JOIN k ON k.match_id = s.match_id GROUP BY 1)
SELECT r.match_id, {_PART.format(f"CASE WHEN rel / n::DOUBLE >= 0.85 THEN 'Court found reliably: ' || rel || '/' || n || ' frames (' || {_P2.format('rel / n::DOUBLE')} || '%) have a trusted projection, mean error ' || {_N1.format('err')} || ' px.' ELSE 'Court often not found: only ' || rel || '/' || n || ' frames (' || {_P2.format('rel / n::DOUBLE')} || '%) have a trusted projection.' END, 'Ball speed: mean ' || {_N0.format('sp * 3.6')} || ' km/h, max ' || {_N0.format('mx * 3.6')} || ' km/h (capped at 80.0 m/s).', CASE WHEN ball / n::DOUBLE < 0.5 THEN 'The ball is rarely seen (' || {_P2.format('ball / n::DOUBLE')} || '%); replays, close-ups or a bad view are likely.' ELSE 'Ball seen in ' || ball || '/' || n || ' frames (' || {_P2.format('ball / n::DOUBLE')} || '%).' END, CASE WHEN b / n::DOUBLE < 0.3 THEN 'Player B, on the far side, is seen in just ' || {_P2.format('b / n::DOUBLE')} || '% of frames, as is usual when a player is far from the camera.' END, CASE WHEN raw > kept THEN 'Outside the court, ' || (raw - kept) || ' detections were dropped (' || {_P2.format('(raw - kept) / raw::DOUBLE')} || '% of all; crowd, officials, ball kids).' END, 'Found ' || bo || ' bounces and ' || hi || ' hits in this segment.', CASE WHEN bo > 0 THEN 'Bounces called: ' || i || ' in, ' || o || ' out, on the singles court with 20 units of margin.' END, 'Play splits into ' || np || ' point(s), mean ' || {_N1.format('ah')} || ' hits each.', CASE WHEN f > 0 THEN 'Serve faults: ' || f || ' (' || kinds || ').' END")} AS insights
FROM r JOIN d ON d.match_id = r.match_id JOIN e ON e.match_id = r.match_id JOIN p ON p.match_id = r.match_id""")
def run_insights(fx):
    t = Tables(fx)
    run = stats.run_statistics(pin(t.frame_table), t.located)
    return narrative.run_insights(run, stats.event_statistics(t.events), stats.point_statistics(t.serve_points).drop("avg_confidence"))


@query("rebuilt_cards", "NA-11", f"""
WITH t AS (SELECT *, ROUND(n * 100.0::DOUBLE / SUM(n) OVER (PARTITION BY match_id, owner), 1) AS pct, ROW_NUMBER() OVER (PARTITION BY match_id, owner ORDER BY n DESC, seen) AS k FROM o_mix),
d AS (SELECT p.match_id, p.owner, string_agg(p.name || '''s ' || shot_type || ' goes ' || replace(direction, '_', ' ') || ' ' || printf('%.1f', pct) || '% of the attempts.', ' ' ORDER BY seen) AS txt FROM o_topdir d JOIN o_players2 p ON p.match_id = d.match_id AND p.owner = d.owner WHERE pct >= 55 GROUP BY 1, 2),
b AS (SELECT *, ROUND(n * 100.0::DOUBLE / SUM(n) OVER (PARTITION BY match_id, owner), 1) AS pct, ROW_NUMBER() OVER (PARTITION BY match_id, owner ORDER BY n DESC, seen) AS k FROM o_dirs),
w AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY match_id, owner ORDER BY o_rerr.at DESC) AS k FROM o_rerr WHERE rate >= 30 AND errors >= 2),
zz AS (SELECT match_id, serve_player AS owner, COALESCE(serve_zone, 'unknown') AS zone, COUNT(*) AS n, ROUND(AVG(CASE WHEN winner = serve_player THEN 100.0::DOUBLE ELSE 0 END), 1) AS win, MIN(point_idx) AS zs FROM o_rebuilt GROUP BY 1, 2, 3),
z AS (SELECT match_id, owner, string_agg(zone || ': ' || n, ', ' ORDER BY zs) AS parts FROM zz GROUP BY 1, 2), zb AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY match_id, owner ORDER BY win DESC, zs) AS k FROM zz),
c AS (SELECT match_id, owner, SUM(d) AS dist, AVG(ball_cx) AS cx, AVG(ball_cy) AS cy FROM (SELECT *, sqrt(POWER(ball_cx - LAG(ball_cx) OVER w, 2) + POWER(ball_cy - LAG(ball_cy) OVER w, 2)) AS d FROM fx_shots WINDOW w AS (PARTITION BY match_id, owner ORDER BY frame_idx)) GROUP BY 1, 2)
SELECT p.match_id, p.owner, {_PART.format("p.name || ' relies mostly on ' || t.shot_type || 's (' || printf('%.1f', t.pct) || '% of what they hit).', d.txt, p.name || '''s favourite combination is ' || b.shot_type || ' ' || replace(b.direction, '_', ' ') || ' (' || printf('%.1f', b.pct) || '% of strokes).'")} AS tendencies,
  COALESCE('Attack ' || p.name || '''s ' || w.shot_type || ' — ' || {_N0.format('w.rate')} || '% of them miss (' || w.errors || ' misses so far). Aim there when it matters.', '') AS exploit_plan,
  'Serve zones: ' || z.parts || '. Best zone: ' || replace(zb.zone, '_', ' ') || ' (' || printf('%.1f', zb.win) || '% of those points won).' AS serve_summary,
  p.name || ' covered ' || CAST(floor(c.dist) AS BIGINT) || ' court units around a mean spot of (' || CAST(floor(c.cx) AS BIGINT) || ', ' || CAST(floor(c.cy) AS BIGINT) || ').' AS coverage_summary
FROM o_players2 p JOIN t ON t.match_id = p.match_id AND t.owner = p.owner AND t.k = 1 LEFT JOIN d ON d.match_id = p.match_id AND d.owner = p.owner JOIN b ON b.match_id = p.match_id AND b.owner = p.owner AND b.k = 1 LEFT JOIN w ON w.match_id = p.match_id AND w.owner = p.owner AND w.k = 1
JOIN z ON z.match_id = p.match_id AND z.owner = p.owner JOIN zb ON zb.match_id = p.match_id AND zb.owner = p.owner AND zb.k = 1 JOIN c ON c.match_id = p.match_id AND c.owner = p.owner""")
def rebuilt_cards(fx):
    c = narrative.rebuilt_cards(_profile(fx, rebuilt=True, coverage=_coverage(fx)), stats.pattern_top(fx.shots))
    return c.withColumn("tendencies", F.array_join("tendencies", " "))


@query("rebuilt_weaknesses", "NA-11", f"""
WITH x AS (
 SELECT e.match_id, e.owner, 0 AS g, e.at AS o, p.name || '''s ' || shot_type || ' is shaky when pressed: ' || {_N0.format('rate')} || '% of them miss (' || errors || ' errors from ' || made || ' tries). Aim at their ' || shot_type || ' side on big points.' AS description,
   errors || ' errors / ' || made || ' ' || shot_type || 's (' || {_N0.format('rate')} || '% error rate)' AS data_point, errors AS points_cost, rate AS v FROM o_rerr e JOIN o_players2 p ON p.match_id = e.match_id AND p.owner = e.owner WHERE rate >= 30 AND errors >= 2
 UNION ALL SELECT d.match_id, d.owner, 1, d.seen, p.name || ' shows their ' || shot_type || ' — ' || {_N0.format('pct')} || '% go ' || replace(direction, '_', ' ') || '. Opponent can move first and punish it.', {_N0.format('pct')} || '% of ' || shot_type || 's go ' || replace(direction, '_', ' '), 0, pct
  FROM o_topdir d JOIN o_players2 p ON p.match_id = d.match_id AND p.owner = d.owner WHERE pct >= 75
 UNION ALL SELECT r.match_id, r.owner, 2, CASE bucket WHEN '1-3' THEN 0 WHEN '4-6' THEN 1 WHEN '7-9' THEN 2 ELSE 3 END, p.name || '''s misses pile up in ' || bucket || '-shot rallies (' || {_N0.format('rate')} || '%). Make the exchanges that long.', {_N0.format('rate')} || '% error rate in ' || bucket || '-shot rallies', errors, rate
  FROM o_rrally r JOIN o_players2 p ON p.match_id = r.match_id AND p.owner = r.owner WHERE rate >= 50 AND errors >= 2)
SELECT match_id, owner, CAST(ROW_NUMBER() OVER (PARTITION BY match_id, owner ORDER BY ROUND(LEAST(v / 100, 1.0), 3) DESC, g, o) AS INTEGER) AS weakness_no, description, data_point, CAST(points_cost AS BIGINT) AS points_cost, ROUND(LEAST(v / 100, 1.0), 3) AS severity FROM x""")
def rebuilt_weaknesses(fx):
    return narrative.rebuilt_weaknesses(_profile(fx, rebuilt=True))


_J0 = "CAST(CAST(round({}) AS BIGINT) AS VARCHAR)"


@query("weakness_context", "NA-16", f"""
WITH w AS (SELECT match_id, owner, CAST(u.n AS INTEGER) AS weakness_no, u.d AS description FROM o_players2 CROSS JOIN (VALUES (1, 'Backhand breaks down'), (2, 'Loses long rallies'), (3, 'Forehand and serve')) AS u(n, d)),
r AS (SELECT match_id, owner, COALESCE(MAX(ROUND(rate, 1)) FILTER (bucket = '7-9'), MAX(ROUND(rate, 1)) FILTER (bucket = '10+')) AS lr, MAX(ROUND(rate, 1)) FILTER (bucket = '1-3') AS sr FROM o_errrally GROUP BY 1, 2)
SELECT w.match_id, w.owner, w.weakness_no, CASE weakness_no WHEN 1 THEN {_PART.format(f"'-> ' || {_J0.format('ROUND(b.rate, 1)')} || '% error rate on backhands overall', '-> Goes ' || replace(d.direction, '_', ' ') || ' ' || {_J0.format('d.pct')} || '% of the time - predictable'")}
  WHEN 2 THEN {_PART.format(f"'-> ' || {_J0.format('r.lr')} || '% error rate in rallies longer than 7 shots', '-> Only ' || {_J0.format('r.sr')} || '% error rate in short rallies - big contrast'")}
  ELSE {_PART.format(f"'-> ' || {_J0.format('ROUND(f.rate, 1)')} || '% error rate on forehands overall', CASE WHEN s.first_serve_pct > 0 THEN '-> First serve in: ' || {_J0.format('ROUND(s.first_serve_pct, 1)')} || '%' END, CASE WHEN s.double_faults > 0 THEN '-> Double faults this match: ' || s.double_faults END")} END AS context
FROM w LEFT JOIN o_errtype b ON b.match_id = w.match_id AND b.owner = w.owner AND b.shot_type = 'backhand' LEFT JOIN o_errtype f ON f.match_id = w.match_id AND f.owner = w.owner AND f.shot_type = 'forehand'
LEFT JOIN o_topdir d ON d.match_id = w.match_id AND d.owner = w.owner AND d.shot_type = 'backhand' LEFT JOIN r ON r.match_id = w.match_id AND r.owner = w.owner JOIN o_servesum s ON s.match_id = w.match_id AND s.owner = w.owner""")
def weakness_context(fx):
    """Context of three descriptions per player that touch every rule."""
    prof = pin(_profile(fx))
    texts = F.array(F.lit("Backhand breaks down"), F.lit("Loses long rallies"), F.lit("Forehand and serve"))
    w = prof.select("match_id", "owner", F.posexplode(texts).alias("_n", "description")).withColumn("weakness_no", F.col("_n") + 1).drop("_n")
    return narrative.weakness_context(w, prof)
