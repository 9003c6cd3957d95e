"""Shared views of the DuckDB side, written independently of the Spark operators."""
from rallyframe import constants as K

CTES: dict[str, str] = {}

# A match's rate, height and camera.
FPS = "CASE match_id % 3 WHEN 0 THEN 30e0 WHEN 1 THEN 25e0 ELSE 60e0 END"
_HEIGHT = "CASE WHEN match_id % 2 = 0 THEN 1000e0 ELSE 720e0 END"


def _pixel(x: str, y: str, height: str = "frame_height") -> tuple[str, str]:
    depth = f"(1 + ((match_id % 3 - 1) * 1e-5) * {x} + ((1 + match_id % 3) * 2e-5) * {y})"
    return f"(5e-1 * {x} + 1e-2 * {y} + 1e2) * ({height} / 1e3) / {depth}", f"(25e-2 * {y} + 5e1) * ({height} / 1e3) / {depth}"


_BALL, _FOOT, _MARK = _pixel("(cx + 37e-2)", "(cy + 21e-2)", f"({_HEIGHT})"), _pixel("(foot_cx + 37e-2)", "(foot_cy + 21e-2)"), _pixel("rx", "ry")

CTES["fx_frames"] = f"""
WITH base AS (
  SELECT user_id // 30 AS match_id, event_id, ts,
         CAST(ROW_NUMBER() OVER (PARTITION BY user_id // 30 ORDER BY ts, event_id) - 1 AS BIGINT) AS frame_idx
  FROM events),
pos AS (
  SELECT *, 380 + ABS(((frame_idx * 61 + match_id * 173) % 1820) - 910)
              + CASE WHEN event_id % 97 = 0 THEN 400 ELSE 0 END AS cx,
            500 + ABS(((frame_idx * 97 + match_id * 311) % 4996) - 2498) AS cy,
         (frame_idx % 400 < 320 AND event_id % 17 <> 0 AND NOT (frame_idx % 150 BETWEEN 100 AND 105)) AS seen
  FROM base)
SELECT match_id, frame_idx, {_HEIGHT} AS frame_height, frame_idx // 300 AS segment_idx, event_id, ts,
       {FPS} AS fps, CAST(frame_idx AS DOUBLE) / ({FPS}) AS t_sec,
       CASE WHEN seen THEN {_BALL[0]} END AS ball_px,
       CASE WHEN seen THEN {_BALL[1]} END AS ball_py,
       CASE WHEN seen THEN CAST(cx AS DOUBLE) END AS ball_cx,
       CASE WHEN seen THEN CAST(cy AS DOUBLE) END AS ball_cy,
       CAST(CASE WHEN frame_idx % 500 BETWEEN 200 AND 207 THEN 60 WHEN event_id % 19 = 0 THEN 30 ELSE 0 END AS DOUBLE) AS kp_noise_px
FROM pos"""

CTES["fx_detections"] = f"""
WITH d AS (SELECT f.match_id, f.frame_idx, f.frame_height, f.event_id, s.slot, s.w, s.h,
       s.x0 + ((f.frame_idx * 13 + s.slot * 29) % 401) - 200 AS foot_cx, s.y0 + ((f.frame_idx * 7) % 81) - 40 AS foot_cy FROM fx_frames f
  CROSS JOIN (VALUES (0, 832, 2800, 60, 160), (1, 832, 650, 30, 80), (2, 2100, 1700, 40, 90), (3, 500, 2600, 20, 50)) AS s(slot, x0, y0, w, h)
  WHERE NOT (s.slot = 0 AND f.event_id % 11 = 0) AND NOT (s.slot = 1 AND f.event_id % 7 = 0) AND NOT (s.slot = 3 AND f.event_id % 5 <> 0))
SELECT match_id, frame_idx, frame_height, slot, foot_cx, foot_cy, {_FOOT[0]} - CAST(w AS DOUBLE) / 2 AS x1, {_FOOT[1]} - h AS y1,
       {_FOOT[0]} + CAST(w AS DOUBLE) / 2 AS x2, {_FOOT[1]} AS y2, CAST(50 + (event_id * 3 + slot) % 50 AS DOUBLE) / 100 AS confidence, slot AS track_id
FROM d"""

CTES["fx_keypoints"] = f"""
WITH k AS (SELECT f.match_id, f.frame_idx, f.frame_height, f.event_id, f.kp_noise_px AS noise, c.* FROM fx_frames f
  CROSS JOIN (VALUES {', '.join(f'({i}, {x}, {y})' for i, (x, y) in enumerate(K.COURT_KEYPOINTS))}) AS c(kp, rx, ry))
SELECT match_id, frame_idx, kp, rx, ry, CASE WHEN (event_id + kp) % 29 <> 0 THEN {_MARK[0]} + noise * (((kp * 37) % 5) - 2) END AS px,
       CASE WHEN (event_id + kp) % 29 <> 0 THEN {_MARK[1]} + noise * (((kp * 23) % 3) - 1) END AS py FROM k"""

CTES["fx_shots"] = """
SELECT match_id, frame_idx, t_sec AS timestamp_sec,
       CASE WHEN (event_id * 7 + match_id) % 3 = 0 THEN 'player_a' ELSE 'player_b' END AS owner,
       CASE event_id % 5 WHEN 0 THEN 'forehand' WHEN 1 THEN 'backhand' WHEN 2 THEN 'serve' WHEN 3 THEN 'neutral' END AS shot_type,
       CASE event_id % 7 WHEN 0 THEN 'middle' WHEN 1 THEN 'cross_court' WHEN 2 THEN 'cross_court' WHEN 3 THEN 'down_the_line' WHEN 4 THEN 'cross_court' ELSE 'down_the_line' END AS direction,
       CASE WHEN event_id % 9 = 0 THEN NULL ELSE CAST(event_id % 600 AS DOUBLE) / 10 END AS speed_m_s,
       CAST(423 + (event_id * 37) % 820 AS DOUBLE) AS ball_cx, CAST(561 + (event_id * 53) % 2375 AS DOUBLE) AS ball_cy,
       CASE WHEN (561 + (event_id * 53) % 2375) > 1748 THEN 'near' ELSE 'far' END AS court_side
FROM fx_frames WHERE event_id % 4 = 0"""

CTES["fx_points"] = f"""
WITH p AS (SELECT match_id, frame_idx // 40 AS point_idx, MAX(event_id + 31 * (frame_idx // 40)) AS h FROM fx_frames GROUP BY 1, 2)
SELECT match_id, point_idx, point_idx * 40 AS start_frame, point_idx * 40 + 29 AS end_frame,
       CAST(point_idx * 40 AS DOUBLE) / ({FPS}) AS start_sec, CAST(point_idx * 40 + 29 AS DOUBLE) / ({FPS}) AS end_sec,
       CASE WHEN point_idx % 2 = 0 THEN 'player_a' ELSE 'player_b' END AS serve_player,
       CASE WHEN h % 6 = 0 THEN NULL ELSE CAST(380 + (h * 41) % 920 AS DOUBLE) END AS bounce_cx,
       CASE WHEN h % 6 = 0 THEN NULL ELSE CAST(900 + (h * 59) % 1700 AS DOUBLE) END AS bounce_cy,
       CASE h % 5 WHEN 0 THEN 'OUT' WHEN 1 THEN 'NET' WHEN 2 THEN 'DOUBLE_BOUNCE' ELSE 'BALL_LOST' END AS end_reason,
       1 + (h * 3) % 12 AS rally_hit_count, CAST(h % 100 AS DOUBLE) / 100 AS confidence
FROM p"""

CTES["fx_feedback"] = """
SELECT match_id, point_idx, CASE WHEN (point_idx * 7 + match_id + v.ver) % 3 = 0 THEN 'flag' ELSE 'confirm' END AS action,
       CASE WHEN (point_idx * 5 + match_id) % 4 = 0 THEN 'Exclude: replay' WHEN point_idx % 2 = 0 THEN 'looks fine' END AS note, v.ver AS version
FROM fx_points CROSS JOIN (VALUES (0), (1)) AS v(ver)
WHERE point_idx % 4 <> 3 AND (v.ver = 0 OR point_idx % 5 = 0)"""

CTES["fx_segments"] = """
WITH s AS (SELECT match_id, segment_idx, MIN(t_sec) AS s0, MAX(t_sec) AS end_sec FROM fx_frames GROUP BY 1, 2)
SELECT match_id, segment_idx, s0 + v.version AS start_sec, end_sec,
       CASE WHEN v.version = 2 THEN 'complete' ELSE 'pending' END AS status, v.version
FROM s CROSS JOIN (VALUES (0), (1), (2)) AS v(version)
WHERE v.version < 2 OR (segment_idx * 7 + match_id) % 5 <> 0"""

CTES["fx_status_log"] = """
SELECT DISTINCT match_id AS job_id, segment_idx AS seq,
       CASE segment_idx % 4 WHEN 0 THEN 'court' WHEN 1 THEN 'ball' WHEN 2 THEN 'players' ELSE 'analytics' END AS stage,
       CASE WHEN segment_idx % 4 = 3 THEN 'complete' ELSE 'running' END AS status,
       CASE WHEN match_id % 3 = 1 AND segment_idx % 4 = 2 THEN 'failed at ' || segment_idx END AS error_message
FROM fx_frames"""

CTES["fx_notes"] = """
SELECT match_id, point_idx, start_sec + k AS timestamp_sec, 'note ' || k AS note_text,
       CASE WHEN point_idx % 2 = 0 THEN 'player_a' ELSE 'player_b' END AS player
FROM fx_points CROSS JOIN (VALUES (0), (1)) AS v(k) WHERE point_idx % 3 = 0 AND k <= point_idx % 2"""

CTES["fx_evals"] = """
WITH g AS (SELECT l_orderkey AS job_id, CAST(l_linenumber AS BIGINT) AS iteration, MAX(l_partkey) AS a, MAX(l_suppkey) AS b,
                  MAX(CAST(l_quantity AS BIGINT)) AS q FROM lineitem GROUP BY 1, 2)
SELECT job_id, iteration, CAST(60 + (q * 3 + a) % 40 AS DOUBLE) / 100 AS player_map, CAST(55 + (a * 7) % 45 AS DOUBLE) / 100 AS ball_map,
       CAST(65 + (b * 11 + q) % 35 AS DOUBLE) / 100 AS court_lines_map, CAST(65 + (a + b) % 35 AS DOUBLE) / 100 AS net_map,
       CAST(80 + (b * 3 + a) % 20 AS DOUBLE) / 100 AS "precision", CAST(2 + (b * 3 + a) % 14 AS DOUBLE) / 100 AS fp_rate,
       300 + (a * 13) % 600 AS frame_count, 5 + b % 26 AS fps
FROM g"""

CTES["fx_boxes"] = """
SELECT match_id, frame_idx, box_no,
       CAST(CASE WHEN event_id % 53 = 0 THEN 0 WHEN event_id % 59 = 0 THEN 1 WHEN box_no < 2 THEN 0 ELSE (box_no - 1) % 4 END AS INTEGER) AS class_id,
       CAST((event_id * 31 + box_no * 17) % 1000 AS DOUBLE) / 1000 AS cx, CAST((event_id * 43 + box_no * 29) % 1000 AS DOUBLE) / 1000 AS cy,
       CASE WHEN event_id % 61 = 0 THEN 0.9::DOUBLE ELSE CAST(5 + (event_id + box_no) % 60 AS DOUBLE) / 200 END AS w,
       CASE WHEN event_id % 61 = 0 THEN 0.8::DOUBLE ELSE CAST(5 + (event_id * 3 + box_no) % 50 AS DOUBLE) / 200 END AS h,
       CAST((event_id * 7 + box_no * 11) % 100 AS DOUBLE) / 100 AS confidence
FROM (SELECT match_id, frame_idx, event_id,
             UNNEST(range(0, 4 + CASE WHEN event_id % 53 = 0 THEN 2 ELSE 0 END + event_id % 3)) AS box_no FROM fx_frames)
WHERE event_id % 13 <> 0"""

CTES["fx_history"] = """
SELECT owner || '_' || (match_id % 2) AS player_id, match_id AS job_id, owner AS player_key,
       '2024-' || lpad(CAST(1 + match_id % 12 AS VARCHAR), 2, '0') || '-01' AS match_date,
       CAST(COUNT(*) FILTER (shot_type = 'backhand' AND frame_idx % 3 = 0) AS DOUBLE) / NULLIF(COUNT(*) FILTER (shot_type = 'backhand'), 0) AS backhand,
       CAST(COUNT(*) FILTER (shot_type = 'forehand' AND frame_idx % 4 = 0) AS DOUBLE) / NULLIF(COUNT(*) FILTER (shot_type = 'forehand'), 0) AS forehand,
       CASE WHEN match_id % 2 = 1 THEN NULL ELSE CAST(COUNT(*) FILTER (frame_idx % 2 = 0) AS DOUBLE) / COUNT(*) END AS rally_79,
       CAST(COUNT(*) FILTER (frame_idx % 5 < 3) AS DOUBLE) / COUNT(*) AS rally_10,
       CAST(COUNT(*) FILTER (speed_m_s > 22) AS DOUBLE) / COUNT(speed_m_s) AS first_serve,
       AVG(speed_m_s) * 3.6::DOUBLE AS speed_kmh, COUNT(*) AS total_shots,
       CASE WHEN COUNT(*) FILTER (shot_type = 'serve') > COUNT(*) FILTER (shot_type = 'forehand') THEN 'serve' ELSE 'forehand' END AS dominant_pattern
FROM fx_shots GROUP BY match_id, owner"""

CTES["fx_hashes"] = """
WITH e AS (SELECT vec_id, embedding, c.copy FROM embeddings CROSS JOIN (VALUES (0), (1), (2)) AS c(copy)
           WHERE c.copy = 0 OR (c.copy = 1 AND vec_id % 3 = 0) OR (c.copy = 2 AND vec_id % 5 = 0))
SELECT copy * 1000000 + vec_id AS frame_no, """ + ", ".join(
    f"CASE WHEN vec_id % 101 <> 100 THEN CAST(list_sum(list_transform(range(32), lambda i: CASE WHEN CAST(embedding[{(w % 2) * 32} + i + 1] AS DOUBLE)"
    f" > CAST({('-0.1', '0', '0.05', '0.15')[w // 2]} AS DOUBLE) + CASE WHEN copy = 1 THEN 0.002::DOUBLE ELSE 0::DOUBLE END"
    f" THEN (1::BIGINT << i::INTEGER) ELSE 0 END)) AS BIGINT) END AS w{w}" for w in range(8)) + " FROM e"

CTES["fx_poses"] = """
SELECT match_id, frame_idx, CASE WHEN event_id % 2 = 0 THEN 'player_a' ELSE 'player_b' END AS player, event_id,
       list_transform(range(17), lambda i: {'y': CAST((event_id * 13 + i * 37) % 100 AS DOUBLE) / 100,
         'x': CAST((event_id * 29 + i * 53) % 100 AS DOUBLE) / 100, 'conf': CAST((event_id * 7 + i * 3) % 100 AS DOUBLE) / 100}) AS kps
FROM fx_frames WHERE event_id % 3 <> 0"""

# --- tracking chain ---------------------------------------------------------------------------

CTES["o_dist"] = """
SELECT match_id, frame_idx, ball_px, ball_py, fps,
  COALESCE(sqrt(POWER(ball_px - LAG(ball_px) OVER w, 2) + POWER(ball_py - LAG(ball_py) OVER w, 2)), -1) AS d
FROM fx_frames WINDOW w AS (PARTITION BY match_id ORDER BY frame_idx)"""

CTES["o_noout"] = """
SELECT match_id, frame_idx, fps, CASE WHEN gone THEN NULL ELSE ball_px END AS px, CASE WHEN gone THEN NULL ELSE ball_py END AS py
FROM (SELECT *, COALESCE(d > 100 AND (dn > 100 OR dn = -1), FALSE) OR COALESCE(d = -1 AND dn > 100 AND NOT (dn2 > 100 OR dn2 = -1), FALSE) AS gone
      FROM (SELECT *, LEAD(d) OVER w AS dn, LEAD(d, 2) OVER w AS dn2 FROM o_dist WINDOW w AS (PARTITION BY match_id ORDER BY frame_idx)))"""

CTES["o_subtracks"] = """
WITH known AS (SELECT match_id, frame_idx AS f, px, py, LAG(frame_idx) OVER w AS p, LAG(px) OVER w AS qx, LAG(py) OVER w AS qy
               FROM o_noout WHERE px IS NOT NULL WINDOW w AS (PARTITION BY match_id ORDER BY frame_idx)),
splits AS (SELECT match_id, p + 1 AS e, f - 1 AS s FROM known
           WHERE f - p > 1 AND (f - p - 1 >= 4 OR sqrt(POWER(px - qx, 2) + POWER(py - qy, 2)) / (f - p - 1) > 80)),
st AS (SELECT match_id, s, ROW_NUMBER() OVER (PARTITION BY match_id ORDER BY s) AS k
       FROM (SELECT match_id, s FROM splits UNION ALL SELECT DISTINCT match_id, 0 FROM fx_frames)),
en AS (SELECT match_id, e, ROW_NUMBER() OVER (PARTITION BY match_id ORDER BY e) AS k
       FROM (SELECT match_id, e FROM splits UNION ALL SELECT match_id, COUNT(*) FROM fx_frames GROUP BY 1))
SELECT st.match_id, s AS track_start, e AS track_end FROM st JOIN en ON st.match_id = en.match_id AND st.k = en.k WHERE e - s > 5"""

CTES["o_clean"] = """
WITH j AS (SELECT n.*, t.track_start AS ts FROM o_noout n LEFT JOIN o_subtracks t ON n.match_id = t.match_id AND n.frame_idx >= t.track_start AND n.frame_idx < t.track_end),
w AS (SELECT *, COUNT(px) OVER (PARTITION BY match_id, ts) AS seen,
   LAST_VALUE(CASE WHEN px IS NOT NULL THEN frame_idx END IGNORE NULLS) OVER b AS pf, LAST_VALUE(px IGNORE NULLS) OVER b AS pxp, LAST_VALUE(py IGNORE NULLS) OVER b AS pyp,
   FIRST_VALUE(CASE WHEN px IS NOT NULL THEN frame_idx END IGNORE NULLS) OVER a AS nf, FIRST_VALUE(px IGNORE NULLS) OVER a AS nx, FIRST_VALUE(py IGNORE NULLS) OVER a AS ny
  FROM j WINDOW b AS (PARTITION BY match_id, ts ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                a AS (PARTITION BY match_id, ts ORDER BY frame_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT match_id, frame_idx, fps,
  CASE WHEN px IS NOT NULL OR ts IS NULL OR seen < 2 THEN px WHEN pf IS NULL THEN nx WHEN nf IS NULL THEN pxp
       ELSE pxp + (nx - pxp) * (CAST(frame_idx - pf AS DOUBLE) / (nf - pf)) END AS px,
  CASE WHEN py IS NOT NULL OR ts IS NULL OR seen < 2 THEN py WHEN pf IS NULL THEN ny WHEN nf IS NULL THEN pyp
       ELSE pyp + (ny - pyp) * (CAST(frame_idx - pf AS DOUBLE) / (nf - pf)) END AS py
FROM w"""

# Four points in closed form: the map of the unit square to the seen quadrilateral, after the map of the court rectangle to that square.
CTES["o_quads"] = f"""
WITH c(conf, k0, k1, k2, k3) AS (VALUES {', '.join(f'({c}, {q[0]}, {q[1]}, {q[2]}, {q[3]})' for c, q in K.CONFIGURATIONS.items())}),
k AS (SELECT match_id, frame_idx, list(px ORDER BY kp) AS xs, list(py ORDER BY kp) AS ys, list(rx ORDER BY kp) AS rxs, list(ry ORDER BY kp) AS rys, COUNT(px) AS detected FROM fx_keypoints GROUP BY 1, 2),
q AS (SELECT k.*, c.*, xs[k0 + 1] AS x0, ys[k0 + 1] AS y0, xs[k1 + 1] AS x1, ys[k1 + 1] AS y1, xs[k3 + 1] AS x2, ys[k3 + 1] AS y2, xs[k2 + 1] AS x3, ys[k2 + 1] AS y3,
        CAST(rxs[k0 + 1] AS DOUBLE) AS rx, CAST(rys[k0 + 1] AS DOUBLE) AS ry, CAST(rxs[k3 + 1] - rxs[k0 + 1] AS DOUBLE) AS rw, CAST(rys[k3 + 1] - rys[k0 + 1] AS DOUBLE) AS rh FROM k CROSS JOIN c),
s AS (SELECT *, x1 - x2 AS ax, y1 - y2 AS ay, x3 - x2 AS bx, y3 - y2 AS b_y, x0 - x1 + x2 - x3 AS sx, y0 - y1 + y2 - y3 AS sy FROM q WHERE x0 + x1 + x2 + x3 IS NOT NULL),
t AS (SELECT *, (sx * b_y - sy * bx) / (ax * b_y - ay * bx) AS g, (ax * sy - ay * sx) / (ax * b_y - ay * bx) AS h FROM s),
u AS (SELECT *, (x1 - x0 + g * x1) / rw AS a, (x3 - x0 + h * x3) / rh AS b, (y1 - y0 + g * y1) / rw AS d, (y3 - y0 + h * y3) / rh AS e, g / rw AS gg, h / rh AS hh FROM t),
v AS (SELECT *, 1 - gg * rx - hh * ry AS n FROM u)
SELECT match_id, frame_idx, detected, conf, k0, k1, k2, k3, xs, ys, rxs, rys, a / n AS m0, b / n AS m1, (x0 - a * rx - b * ry) / n AS m2, d / n AS m3, e / n AS m4, (y0 - d * rx - e * ry) / n AS m5,
       gg / n AS m6, hh / n AS m7 FROM v"""

CTES["o_conf"] = """
WITH p AS (SELECT *, UNNEST(range(14)) AS kp FROM o_quads),
d AS (SELECT match_id, frame_idx, conf, sqrt(POWER((m0 * rxs[kp + 1] + m1 * rys[kp + 1] + m2) / (m6 * rxs[kp + 1] + m7 * rys[kp + 1] + 1) - xs[kp + 1], 2)
                                           + POWER((m3 * rxs[kp + 1] + m4 * rys[kp + 1] + m5) / (m6 * rxs[kp + 1] + m7 * rys[kp + 1] + 1) - ys[kp + 1], 2)) AS dist
      FROM p WHERE kp NOT IN (k0, k1, k2, k3) AND xs[kp + 1] IS NOT NULL)
SELECT match_id, frame_idx, conf, quantile_cont(dist, 0.5) AS error FROM d GROUP BY 1, 2, 3"""

CTES["o_fit"] = """
SELECT match_id, frame_idx, detected, error, [m0, m1, m2, m3, m4, m5, m6, m7, 1] AS m,
       [m4 - m5 * m7, m2 * m7 - m1, m1 * m5 - m2 * m4, m5 * m6 - m3, m0 - m2 * m6, m2 * m3 - m0 * m5, m3 * m7 - m4 * m6, m1 * m6 - m0 * m7, m0 * m4 - m1 * m3] AS inv
FROM (SELECT q.*, c.error, ROW_NUMBER() OVER (PARTITION BY q.match_id, q.frame_idx ORDER BY c.error, q.conf) AS k
      FROM o_quads q JOIN o_conf c ON c.match_id = q.match_id AND c.frame_idx = q.frame_idx AND c.conf = q.conf) WHERE k = 1"""

CTES["o_hom"] = """
WITH c AS (SELECT f.match_id, f.frame_idx, t.detected, t.error, t.inv, CASE WHEN error <= 5 THEN 1.0::DOUBLE WHEN error <= 20 THEN 1 - 0.5 * (error - 5) / 15 WHEN error <= 50 THEN 0.5 - 0.5 * (error - 20) / 30 ELSE 0 END AS confidence
  FROM fx_frames f LEFT JOIN o_fit t ON t.match_id = f.match_id AND t.frame_idx = f.frame_idx),
l AS (SELECT *, MAX(CASE WHEN confidence >= 0.7 THEN frame_idx END) OVER (PARTITION BY match_id ORDER BY frame_idx) AS lr FROM c)
SELECT l.match_id, l.frame_idx, l.error, l.detected, l.confidence, COALESCE(l.frame_idx - l.lr <= 5, FALSE) AS reliable, COALESCE(l.frame_idx - l.lr BETWEEN 1 AND 5, FALSE) AS carried, CASE WHEN l.frame_idx - l.lr <= 5 THEN g.inv END AS i
FROM l LEFT JOIN c g ON g.match_id = l.match_id AND g.frame_idx = l.lr"""


def court(x: str, y: str) -> tuple[str, str]:
    """Court position of a pixel position by the inverse ``h.i``, null without one."""
    depth = f"(h.i[7] * {x} + h.i[8] * {y} + h.i[9])"
    return f"(h.i[1] * {x} + h.i[2] * {y} + h.i[3]) / {depth}", f"(h.i[4] * {x} + h.i[5] * {y} + h.i[6]) / {depth}"


_BALL_AT, _FOOT_AT = court("c.px", "c.py"), court("((x1 + x2) / 2)", "y2")

CTES["o_physics"] = f"""
WITH p AS (SELECT c.match_id, c.frame_idx, c.fps, {_BALL_AT[0]} AS cx, {_BALL_AT[1]} AS cy
           FROM o_clean c JOIN o_hom h ON c.match_id = h.match_id AND c.frame_idx = h.frame_idx),
v AS (SELECT *, sqrt(POWER((cx - LAG(cx) OVER w) * (10.97::DOUBLE / 1117), 2) + POWER((cy - LAG(cy) OVER w) * (10.97::DOUBLE / 1117), 2)) * fps AS v0 FROM p WINDOW w AS (PARTITION BY match_id ORDER BY frame_idx)),
u AS (SELECT *, CASE WHEN v0 <= 80 THEN v0 END AS v FROM v)
SELECT match_id, frame_idx, fps, cx, cy, ROUND(v, 2) AS speed, ROUND((v - LAG(v) OVER (PARTITION BY match_id ORDER BY frame_idx)) * fps, 2) AS accel FROM u"""

CTES["o_cand"] = """
WITH a AS (SELECT *, AVG(cy) OVER (w ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS sy,
      AVG(speed) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS vb, AVG(speed) OVER (w ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS va,
      COUNT(*) OVER (w ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) - COUNT(cx) OVER (w ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS missing,
      cx - LAG(cx) OVER w AS dx, cy - LAG(cy) OVER w AS dy, MAX(frame_idx) OVER (PARTITION BY match_id) AS lastf
     FROM o_physics WINDOW w AS (PARTITION BY match_id ORDER BY frame_idx)),
b AS (SELECT *, sy - LAG(sy) OVER w AS step, CASE WHEN abs(dx) > 0.1 OR abs(dy) > 0.1 THEN degrees(atan2(dy, dx)) END AS dir
     FROM a WINDOW w AS (PARTITION BY match_id ORDER BY frame_idx)),
c AS (SELECT *, LAG(step) OVER w AS step0,
      CASE WHEN COUNT(dir) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) > 0 THEN degrees(atan2(SUM(sin(radians(dir))) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), SUM(cos(radians(dir))) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING))) END AS db,
      CASE WHEN COUNT(dir) OVER (w ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) > 0 THEN degrees(atan2(SUM(sin(radians(dir))) OVER (w ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), SUM(cos(radians(dir))) OVER (w ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING))) END AS da
     FROM b WINDOW w AS (PARTITION BY match_id ORDER BY frame_idx)),
d AS (SELECT *, CASE WHEN abs(db - da) % 360 <= 180 THEN abs(db - da) % 360 ELSE 360 - abs(db - da) % 360 END AS turn FROM c
     WHERE frame_idx BETWEEN 2 AND lastf - 2 AND missing = 0)
SELECT match_id, 'bounce' AS event_type, frame_idx, ROUND(frame_idx / fps, 3) AS timestamp_sec, cx, cy, ROUND(vb + 1e-9, 2) AS speed_before, ROUND(va + 1e-9, 2) AS speed_after,
  CAST(NULL AS DOUBLE) AS turn_deg,
  ROUND(LEAST(1.0::DOUBLE, 0.3 + CASE WHEN vb > 0 AND speed IS NOT NULL THEN LEAST(1 - speed / vb, 0.5) * 0.4 ELSE 0 END + CASE WHEN accel < -20 THEN LEAST(abs(accel) / 500, 0.3) ELSE 0 END) + 1e-9, 3) AS score,
  CASE WHEN cy > 1748 THEN 'near' ELSE 'far' END AS court_side,
  CASE WHEN cx BETWEEN 423 AND 1242 AND cy BETWEEN 561 AND 2935 THEN CASE WHEN LEAST(cx - 423, 1242 - cx, cy - 561, 2935 - cy) <= 20 THEN 'line' ELSE 'in' END
       WHEN sqrt(POWER(GREATEST(423 - cx, 0, cx - 1242), 2) + POWER(GREATEST(561 - cy, 0, cy - 2935), 2)) <= 20 THEN 'line' ELSE 'out' END AS in_out
FROM d WHERE ((step0 > 1e-3 AND step < -1e-3) OR (step0 < -1e-3 AND step > 1e-3)) AND (vb IS NULL OR vb >= 3 - 1e-9) AND (COALESCE(speed < vb * 0.8 - 1e-9, FALSE) OR COALESCE(accel < -10, FALSE))
UNION ALL
SELECT match_id, 'hit', frame_idx, ROUND(frame_idx / fps, 3), cx, cy, ROUND(vb + 1e-9, 2), ROUND(va + 1e-9, 2), ROUND(turn, 1),
  ROUND(LEAST(1.0::DOUBLE, LEAST(turn / 180, 1.0) * 0.5 + CASE WHEN va IS NOT NULL AND vb > 0.01 THEN LEAST(va / vb / 3, 0.3) WHEN va IS NOT NULL THEN LEAST(va / 50, 0.2) ELSE 0 END) + 1e-9, 3),
  CASE WHEN cy > 1748 THEN 'near' ELSE 'far' END, NULL
FROM d WHERE turn >= 50 AND COALESCE(GREATEST(speed, vb, va), 0) >= 5 - 1e-9"""

CTES["o_ranked"] = """SELECT *, ROW_NUMBER() OVER (PARTITION BY match_id, event_type ORDER BY score DESC, frame_idx) AS rn FROM o_cand"""

CTES["o_nmsrun"] = """
o_nmsrun(match_id, event_type, rn, kept) AS (
  SELECT DISTINCT match_id, event_type, CAST(0 AS BIGINT), CAST([] AS BIGINT[]) FROM o_ranked
  UNION ALL
  SELECT n.match_id, n.event_type, c.rn, CASE WHEN len(list_filter(n.kept, lambda k: abs(k - c.frame_idx) <= 5)) > 0 THEN n.kept ELSE list_append(n.kept, c.frame_idx) END
  FROM o_nmsrun n JOIN o_ranked c ON c.match_id = n.match_id AND c.event_type = n.event_type AND c.rn = n.rn + 1)"""

CTES["o_nms"] = """
WITH f AS (SELECT match_id, event_type, UNNEST(arg_max(kept, rn)) AS frame_idx FROM o_nmsrun GROUP BY 1, 2)
SELECT c.* EXCLUDE (rn) FROM o_ranked c JOIN f USING (match_id, event_type, frame_idx)"""

CTES["o_events0"] = """
WITH g AS (SELECT *, CASE WHEN frame_idx - LAG(frame_idx) OVER (PARTITION BY match_id ORDER BY frame_idx, event_type) <= 1 THEN 0 ELSE 1 END AS b FROM o_nms),
c AS (SELECT *, SUM(b) OVER (PARTITION BY match_id ORDER BY frame_idx, event_type) AS chain FROM g),
r AS (SELECT *, MIN(event_type) OVER p <> MAX(event_type) OVER p AS mixed, ROW_NUMBER() OVER (PARTITION BY match_id, chain ORDER BY score DESC, frame_idx, event_type) AS k FROM c WINDOW p AS (PARTITION BY match_id, chain))
SELECT * EXCLUDE (b, chain, mixed, k) FROM r WHERE NOT mixed OR k = 1"""

CTES["o_located"] = f"""
SELECT d.*, (x1 + x2) / 2 AS foot_px, y2 AS foot_py, {_FOOT_AT[0]} AS foot_x, {_FOOT_AT[1]} AS foot_y,
  CASE WHEN h.reliable THEN {_FOOT_AT[0]} BETWEEN 86 AND 1579 AND {_FOOT_AT[1]} BETWEEN 361 AND 3135 ELSE TRUE END AS inside
FROM fx_detections d JOIN o_hom h ON d.match_id = h.match_id AND d.frame_idx = h.frame_idx"""

CTES["o_chosen"] = """
SELECT * FROM (SELECT *, CASE WHEN foot_py >= frame_height / 2 THEN 'player_a' ELSE 'player_b' END AS label,
   ROW_NUMBER() OVER (PARTITION BY match_id, frame_idx, foot_py >= frame_height / 2 ORDER BY (x2 - x1) * (y2 - y1) DESC, slot) AS rn
 FROM o_located WHERE inside AND confidence >= 0.5) WHERE rn = 1"""

CTES["o_players"] = """
WITH s AS (SELECT f.match_id, f.frame_idx, l.label FROM fx_frames f CROSS JOIN (VALUES ('player_a'), ('player_b')) AS l(label)),
j AS (SELECT s.*, c.frame_idx AS own, MAX(c.frame_idx) OVER (PARTITION BY s.match_id, s.label ORDER BY s.frame_idx) AS src
      FROM s LEFT JOIN o_chosen c ON s.match_id = c.match_id AND s.frame_idx = c.frame_idx AND s.label = c.label)
SELECT j.match_id, j.frame_idx, j.label, c.foot_px, c.foot_py, c.foot_x, c.foot_y, c.track_id, j.own IS NULL AS carried
FROM j JOIN o_chosen c ON c.match_id = j.match_id AND c.frame_idx = j.src AND c.label = j.label"""

CTES["o_events"] = """
WITH n AS (SELECT e.match_id, e.frame_idx, p.label, sqrt(POWER(e.cx - p.foot_x, 2) + POWER(e.cy - p.foot_y, 2)) AS dist,
   ROW_NUMBER() OVER (PARTITION BY e.match_id, e.frame_idx ORDER BY sqrt(POWER(e.cx - p.foot_x, 2) + POWER(e.cy - p.foot_y, 2)), p.frame_idx, p.label) AS k
  FROM o_events0 e JOIN o_players p ON p.match_id = e.match_id AND p.frame_idx BETWEEN e.frame_idx - 2 AND e.frame_idx + 2 WHERE e.event_type = 'hit' AND p.foot_x IS NOT NULL)
SELECT e.*, CASE WHEN n.dist <= 350 THEN n.label END AS player, CASE WHEN n.dist <= 350 THEN ROUND(n.dist, 1) END AS player_distance
FROM o_events0 e LEFT JOIN n ON e.event_type = 'hit' AND n.match_id = e.match_id AND n.frame_idx = e.frame_idx AND n.k = 1"""

CTES["o_lowruns"] = """
WITH l AS (SELECT match_id, frame_idx, frame_idx - ROW_NUMBER() OVER (PARTITION BY match_id ORDER BY frame_idx) AS g FROM o_hom WHERE confidence < 0.7)
SELECT match_id, MIN(frame_idx) AS run_start, MAX(frame_idx) AS run_end, COUNT(*) AS length FROM l GROUP BY match_id, g HAVING COUNT(*) >= 5"""

CTES["o_rallies"] = """
SELECT *, SUM(b) OVER (PARTITION BY match_id ORDER BY frame_idx, event_type) AS rally
FROM (SELECT *, CASE WHEN frame_idx - LAG(frame_idx) OVER (PARTITION BY match_id ORDER BY frame_idx, event_type) <= 50 THEN 0 ELSE 1 END AS b FROM o_events)"""

CTES["o_points"] = f"""
WITH r AS (SELECT *, COUNT(*) OVER p AS n0, MIN(CASE WHEN event_type = 'hit' THEN frame_idx END) OVER p AS serve_frame FROM o_rallies WINDOW p AS (PARTITION BY match_id, rally)),
e AS (SELECT * FROM r WHERE n0 >= 2 AND frame_idx >= serve_frame),
b AS (SELECT match_id, rally, frame_idx, court_side, LAG(frame_idx) OVER w AS pf, LAG(court_side) OVER w AS ps FROM e WHERE event_type = 'bounce' WINDOW w AS (PARTITION BY match_id, rally ORDER BY frame_idx)),
dbl AS (SELECT DISTINCT match_id, rally FROM b WHERE ps = court_side AND NOT EXISTS (SELECT 1 FROM e WHERE e.match_id = b.match_id AND e.rally = b.rally AND e.event_type = 'hit' AND e.frame_idx > b.pf AND e.frame_idx < b.frame_idx)),
g AS (SELECT match_id, rally, COUNT(*) AS event_count, MIN(frame_idx) AS start_frame, MAX(frame_idx) AS end_frame, MIN(serve_frame) AS serve_frame,
   arg_min(player, frame_idx) FILTER (event_type = 'hit' AND frame_idx = serve_frame) AS serve_player, arg_min(court_side, frame_idx) FILTER (event_type = 'hit') AS serve_side,
   MIN(frame_idx) FILTER (event_type = 'bounce') AS first_bounce_frame, arg_min(cx, frame_idx) FILTER (event_type = 'bounce') AS bounce_cx, arg_min(cy, frame_idx) FILTER (event_type = 'bounce') AS bounce_cy,
   COUNT(*) FILTER (event_type = 'hit') AS rally_hit_count, COUNT(*) FILTER (event_type = 'bounce') AS bounce_count, AVG(score) AS conf, BOOL_OR(COALESCE(in_out = 'out', FALSE)) AS any_out
  FROM e GROUP BY 1, 2 HAVING COUNT(*) >= 2),
z AS (SELECT g.*, CASE WHEN bounce_cx BETWEEN 423 AND 832 AND bounce_cy BETWEEN 1110 AND 1748 THEN 'far_left' WHEN bounce_cx BETWEEN 832 AND 1242 AND bounce_cy BETWEEN 1110 AND 1748 THEN 'far_right'
    WHEN bounce_cx BETWEEN 423 AND 832 AND bounce_cy BETWEEN 1748 AND 2386 THEN 'near_left' WHEN bounce_cx BETWEEN 832 AND 1242 AND bounce_cy BETWEEN 1748 AND 2386 THEN 'near_right' END AS serve_zone,
    EXISTS (SELECT 1 FROM dbl WHERE dbl.match_id = g.match_id AND dbl.rally = g.rally) AS dbl,
    (SELECT arg_min({{'s': l.run_start, 'e': l.run_end}}, l.run_start) FROM o_lowruns l WHERE l.match_id = g.match_id AND g.start_frame <= l.run_end AND g.end_frame >= l.run_start) AS low FROM g)
SELECT match_id, ROW_NUMBER() OVER (PARTITION BY match_id ORDER BY start_frame) - 1 AS point_idx, start_frame, end_frame, ROUND(start_frame / ({FPS}), 3) AS start_sec, ROUND(end_frame / ({FPS}), 3) AS end_sec,
  serve_frame, serve_player, first_bounce_frame, bounce_cx, bounce_cy, serve_zone,
  CASE WHEN first_bounce_frame IS NULL OR serve_zone IS NOT NULL THEN NULL
       WHEN serve_side = 'near' AND bounce_cy < 1110 THEN 'long' WHEN serve_side = 'near' AND bounce_cy > 1748 THEN 'net'
       WHEN serve_side <> 'near' AND bounce_cy > 2386 THEN 'long' WHEN serve_side <> 'near' AND bounce_cy < 1748 THEN 'net'
       WHEN bounce_cx < 423 OR bounce_cx > 1242 THEN 'wide' ELSE 'long' END AS serve_fault_type,
  CASE WHEN any_out THEN 'OUT' WHEN dbl THEN 'DOUBLE_BOUNCE' ELSE 'BALL_LOST' END AS end_reason, rally_hit_count, bounce_count, event_count,
  ROUND(conf * CASE WHEN low IS NULL THEN 1 ELSE GREATEST(0.3, 1 - CAST(LEAST(end_frame, low.e) - GREATEST(start_frame, low.s) + 1 AS DOUBLE) / (end_frame - start_frame + 1) * 0.5) END + 1e-9, 3) AS confidence, low IS NOT NULL AS low_confidence_homography
FROM z"""

CTES["o_obs"] = """SELECT *, ROW_NUMBER() OVER (PARTITION BY match_id ORDER BY frame_idx) AS k FROM o_physics WHERE cx IS NOT NULL"""

CTES["o_ema"] = """
o_ema(match_id, k, frame_idx, sx, sy) AS (
  SELECT match_id, k, frame_idx, cx, cy FROM o_obs WHERE k = 1
  UNION ALL
  SELECT o.match_id, o.k, o.frame_idx, 0.3::DOUBLE * o.cx + 0.7::DOUBLE * e.sx, 0.3::DOUBLE * o.cy + 0.7::DOUBLE * e.sy
  FROM o_ema e JOIN o_obs o ON o.match_id = e.match_id AND o.k = e.k + 1)"""

CTES["o_track"] = """
WITH j AS (SELECT p.match_id, p.frame_idx, p.fps, p.cx, p.speed, LAST_VALUE(e.sx IGNORE NULLS) OVER w AS sx, LAST_VALUE(e.sy IGNORE NULLS) OVER w AS sy,
   MAX(CASE WHEN p.cx IS NULL THEN p.frame_idx END) OVER w AS miss, MAX(p.frame_idx) OVER (PARTITION BY p.match_id) AS lastf
  FROM o_physics p LEFT JOIN o_ema e ON e.match_id = p.match_id AND e.frame_idx = p.frame_idx WINDOW w AS (PARTITION BY p.match_id ORDER BY p.frame_idx))
SELECT *, sx - LAG(sx) OVER w AS vx, sy - LAG(sy) OVER w AS vy, frame_idx - COALESCE(miss, -1) AS stable FROM j WINDOW w AS (PARTITION BY match_id ORDER BY frame_idx)"""

CTES["o_contact0"] = """
WITH v AS (SELECT *, LAG(vx) OVER w AS ux, LAG(vy) OVER w AS uy FROM o_track WINDOW w AS (PARTITION BY match_id ORDER BY frame_idx)),
s AS (SELECT *, sqrt(ux * ux + uy * uy) AS sb, sqrt(vx * vx + vy * vy) AS sa FROM v WHERE frame_idx BETWEEN 2 AND lastf - 1 AND stable >= 3 AND ux IS NOT NULL)
SELECT match_id, frame_idx, fps, sx, sy, vx, vy, speed, ROW_NUMBER() OVER (PARTITION BY match_id ORDER BY frame_idx) AS k FROM s
WHERE GREATEST(sb, sa) BETWEEN 5 AND 300 AND sb * sa >= 0.01 AND degrees(acos(GREATEST(-1.0::DOUBLE, LEAST(1.0::DOUBLE, (ux * vx + uy * vy) / (sb * sa))))) >= 80"""

CTES["o_cool"] = """
o_cool(match_id, k, frame_idx, last_ok, ok) AS (
  SELECT match_id, k, frame_idx, frame_idx, TRUE FROM o_contact0 WHERE k = 1
  UNION ALL
  SELECT c.match_id, c.k, c.frame_idx, CASE WHEN c.frame_idx - d.last_ok >= 12 THEN c.frame_idx ELSE d.last_ok END, c.frame_idx - d.last_ok >= 12
  FROM o_cool d JOIN o_contact0 c ON c.match_id = d.match_id AND c.k = d.k + 1)"""

CTES["o_contacts"] = """
WITH c AS (SELECT a.* FROM o_contact0 a JOIN o_cool b ON a.match_id = b.match_id AND a.frame_idx = b.frame_idx WHERE b.ok),
n AS (SELECT c.match_id, c.frame_idx, p.label, sqrt(POWER(c.sx - p.foot_x, 2) + POWER(c.sy - p.foot_y, 2)) AS dist,
   ROW_NUMBER() OVER (PARTITION BY c.match_id, c.frame_idx ORDER BY sqrt(POWER(c.sx - p.foot_x, 2) + POWER(c.sy - p.foot_y, 2)), p.frame_idx, p.label) AS rk
  FROM c JOIN o_players p ON p.match_id = c.match_id AND p.frame_idx BETWEEN c.frame_idx - 2 AND c.frame_idx + 2 WHERE p.foot_x IS NOT NULL),
s AS (SELECT c.*, n.label, n.dist, CASE WHEN c.sy > 1748 THEN 'player_a' ELSE 'player_b' END AS so FROM c LEFT JOIN n ON n.match_id = c.match_id AND n.frame_idx = c.frame_idx AND n.rk = 1)
SELECT match_id, frame_idx, ROUND(frame_idx / fps, 3) AS timestamp_sec, CASE WHEN label IS NULL OR (label <> so AND dist > 500) THEN so ELSE label END AS owner,
  sx AS ball_cx, sy AS ball_cy, CASE WHEN abs(vx) > 0.01 OR abs(vy) > 0.01 THEN ROUND(degrees(atan2(vy, vx)), 1) END AS direction_deg, ROUND(speed, 2) AS speed_m_s,
  CASE WHEN sy > 1748 THEN 'near' ELSE 'far' END AS court_side, CASE WHEN label IS NULL THEN 'court_side' WHEN label = so THEN 'combined' WHEN dist > 500 THEN 'court_side' ELSE 'distance' END AS ownership
FROM s"""

# --- statistics -------------------------------------------------------------------------------

CTES["o_last"] = """
SELECT * EXCLUDE (k) FROM (SELECT p.match_id, p.point_idx, p.end_reason, p.rally_hit_count, s.owner AS last_owner, s.shot_type AS last_type, s.direction AS last_direction,
   s.speed_m_s AS last_speed, s.frame_idx AS last_frame, COUNT(*) OVER (PARTITION BY p.match_id, p.point_idx) AS shots_in_point,
   ROW_NUMBER() OVER (PARTITION BY p.match_id, p.point_idx ORDER BY s.frame_idx DESC) AS k
 FROM fx_points p JOIN fx_shots s ON s.match_id = p.match_id AND s.frame_idx BETWEEN p.start_frame AND p.end_frame) WHERE k = 1"""

CTES["o_winner"] = """
SELECT p.*, l.last_owner, l.last_type, l.last_direction, CASE WHEN l.last_owner IS NULL THEN 'player_a' WHEN p.end_reason IN ('OUT', 'NET') THEN CASE WHEN l.last_owner = 'player_a' THEN 'player_b' ELSE 'player_a' END ELSE l.last_owner END AS winner
FROM fx_points p LEFT JOIN o_last l ON l.match_id = p.match_id AND l.point_idx = p.point_idx"""

CTES["o_serve"] = """
SELECT *, CASE WHEN bounce_cx IS NULL OR serve_zone IS NOT NULL THEN NULL
    WHEN serve_player = 'player_a' AND bounce_cy < 1110 THEN 'long' WHEN serve_player = 'player_a' AND bounce_cy > 1748 THEN 'net'
    WHEN serve_player = 'player_b' AND bounce_cy > 2386 THEN 'long' WHEN serve_player = 'player_b' AND bounce_cy < 1748 THEN 'net'
    WHEN bounce_cx < 423 OR bounce_cx > 1242 THEN 'wide' ELSE 'long' END AS serve_fault_type
FROM (SELECT *, CASE WHEN bounce_cx BETWEEN 423 AND 832 AND bounce_cy BETWEEN 1110 AND 1748 THEN 'far_left' WHEN bounce_cx BETWEEN 832 AND 1242 AND bounce_cy BETWEEN 1110 AND 1748 THEN 'far_right'
    WHEN bounce_cx BETWEEN 423 AND 832 AND bounce_cy BETWEEN 1748 AND 2386 THEN 'near_left' WHEN bounce_cx BETWEEN 832 AND 1242 AND bounce_cy BETWEEN 1748 AND 2386 THEN 'near_right' END AS serve_zone FROM fx_points)"""

CTES["o_bytime"] = """
SELECT * EXCLUDE (k) FROM (SELECT p.match_id, p.point_idx, s.owner AS last_hit_owner, ROW_NUMBER() OVER (PARTITION BY p.match_id, p.point_idx ORDER BY s.timestamp_sec DESC) AS k
  FROM fx_points p JOIN fx_shots s ON s.match_id = p.match_id AND s.timestamp_sec >= p.start_sec AND s.timestamp_sec <= p.end_sec + 0.5::DOUBLE) WHERE k = 1"""

CTES["o_rebuilt"] = """
SELECT p.*, COALESCE(b.last_hit_owner, p.serve_player) AS hitter, p.end_reason IN ('OUT', 'NET', 'NET_FAULT', 'OUT_LONG', 'OUT_WIDE') AS is_error,
  CASE WHEN p.end_reason IN ('OUT', 'NET', 'NET_FAULT', 'OUT_LONG', 'OUT_WIDE') THEN CASE WHEN COALESCE(b.last_hit_owner, p.serve_player) = 'player_a' THEN 'player_b' ELSE 'player_a' END
       ELSE COALESCE(b.last_hit_owner, p.serve_player, 'player_a') END AS winner
FROM o_serve p LEFT JOIN o_bytime b ON b.match_id = p.match_id AND b.point_idx = p.point_idx"""

CTES["o_bucketed"] = """
SELECT *, CASE WHEN rally_hit_count <= 3 THEN '1-3' WHEN rally_hit_count <= 6 THEN '4-6' WHEN rally_hit_count <= 9 THEN '7-9' ELSE '10+' END AS bucket FROM fx_points"""

CTES["o_mix"] = """
SELECT match_id, owner, COALESCE(shot_type, 'unknown') AS shot_type, COUNT(*) AS n, MIN(frame_idx) AS seen FROM fx_shots GROUP BY 1, 2, 3"""

CTES["o_dirs"] = """
SELECT match_id, owner, COALESCE(shot_type, 'unknown') AS shot_type, COALESCE(direction, 'unknown') AS direction, COUNT(*) AS n, MIN(frame_idx) AS seen FROM fx_shots GROUP BY 1, 2, 3, 4"""

CTES["o_errtype"] = """
SELECT e.match_id, e.last_owner AS owner, COALESCE(e.last_type, 'unknown') AS shot_type, COUNT(*) AS errors, ANY_VALUE(m.n) AS made, COUNT(*) * 100.0::DOUBLE / ANY_VALUE(m.n) AS rate
FROM o_last e JOIN o_mix m ON m.match_id = e.match_id AND m.owner = e.last_owner AND m.shot_type = COALESCE(e.last_type, 'unknown')
WHERE e.end_reason IN ('OUT', 'NET') GROUP BY 1, 2, 3"""

CTES["o_errrally"] = """
WITH t AS (SELECT match_id, bucket, COUNT(*) AS played FROM o_bucketed GROUP BY 1, 2)
SELECT b.match_id, l.last_owner AS owner, b.bucket, COUNT(*) AS errors, ANY_VALUE(t.played) AS played, COUNT(*) * 100.0::DOUBLE / ANY_VALUE(t.played) AS rate
FROM o_bucketed b JOIN o_last l ON l.match_id = b.match_id AND l.point_idx = b.point_idx JOIN t ON t.match_id = b.match_id AND t.bucket = b.bucket
WHERE b.end_reason IN ('OUT', 'NET') GROUP BY 1, 2, 3"""

CTES["o_dfault"] = """
SELECT *, serve_fault_type IS NOT NULL AND COALESCE(LEAD(serve_fault_type) OVER (PARTITION BY match_id, serve_player ORDER BY point_idx) IS NOT NULL, FALSE) AS double_fault FROM o_serve"""

CTES["o_servesum"] = """
SELECT match_id, serve_player AS owner, COUNT(*) AS serves, AVG(CASE WHEN serve_fault_type IS NULL THEN 100.0::DOUBLE ELSE 0 END) AS first_serve_pct, COUNT(*) FILTER (double_fault) AS double_faults
FROM o_dfault GROUP BY 1, 2
UNION ALL SELECT m.match_id, p.label, 0, 0, 0 FROM (SELECT DISTINCT match_id FROM fx_points) m CROSS JOIN (VALUES ('player_a'), ('player_b')) AS p(label)
WHERE NOT EXISTS (SELECT 1 FROM fx_points q WHERE q.match_id = m.match_id AND q.serve_player = p.label)"""

CTES["o_zonewin"] = """
SELECT match_id, serve_player AS owner, COALESCE(serve_zone, 'unknown') AS zone, COUNT(*) AS serves, AVG(CASE WHEN end_reason NOT IN ('OUT', 'NET', 'BALL_LOST') THEN 100.0::DOUBLE ELSE 0 END) AS win_pct FROM o_serve GROUP BY 1, 2, 3"""

CTES["o_won"] = """
SELECT match_id, l.owner, COUNT(*) FILTER (winner = l.owner) AS points_won, COUNT(*) FILTER (winner <> l.owner) AS points_lost FROM o_rebuilt CROSS JOIN (VALUES ('player_a'), ('player_b')) AS l(owner) GROUP BY 1, 2"""

CTES["o_pos"] = f"""SELECT match_id, label, frame_idx, CAST(frame_idx AS DOUBLE) / ({FPS}) AS t, foot_x AS x, foot_y AS y FROM o_players"""

CTES["o_cover"] = """
WITH s AS (SELECT match_id, label, x, y, sqrt(POWER(x - LAG(x) OVER w, 2) + POWER(y - LAG(y) OVER w, 2)) AS d FROM o_pos WHERE x IS NOT NULL WINDOW w AS (PARTITION BY match_id, label ORDER BY frame_idx))
SELECT match_id, label, SUM(d) AS distance, AVG(x) AS centre_x, AVG(y) AS centre_y, COUNT(*) AS n FROM s GROUP BY 1, 2 HAVING COUNT(*) >= 2"""

CTES["o_frame"] = """
SELECT f.*, c.px, h.error, h.detected, h.confidence, h.reliable, h.carried, p.cx, p.cy, p.speed, p.accel,
  EXISTS (SELECT 1 FROM o_players a WHERE a.match_id = f.match_id AND a.frame_idx = f.frame_idx AND a.label = 'player_a') AS has_a,
  EXISTS (SELECT 1 FROM o_players b WHERE b.match_id = f.match_id AND b.frame_idx = f.frame_idx AND b.label = 'player_b') AS has_b
FROM fx_frames f JOIN o_clean c USING (match_id, frame_idx) JOIN o_hom h USING (match_id, frame_idx) JOIN o_physics p USING (match_id, frame_idx)"""

# --- narrative --------------------------------------------------------------------------------

CTES["o_rates"] = """
SELECT match_id, owner, """ + ", ".join(f"COALESCE(MAX(ROUND(rate, 1)) FILTER (bucket = '{b}'), 0) AS {t}, COALESCE(MAX(errors) FILTER (bucket = '{b}'), 0) AS {t}n"
                                        for b, t in (("1-3", "r1"), ("4-6", "r4"), ("7-9", "r7"), ("10+", "r10"))) + " FROM o_errrally GROUP BY 1, 2"

CTES["o_players2"] = """
SELECT o.match_id, o.owner, CASE WHEN o.owner = 'player_a' THEN 'Player A' ELSE 'Player B' END AS name, CASE WHEN o.owner = 'player_a' THEN 'Player B' ELSE 'Player A' END AS opp,
  GREATEST(COALESCE(r.r1, 0), COALESCE(r.r4, 0)) AS short, GREATEST(COALESCE(r.r7, 0), COALESCE(r.r10, 0)) AS long, COALESCE(r.r7n, 0) + COALESCE(r.r10n, 0) AS lost
FROM (SELECT DISTINCT match_id, owner FROM fx_shots) o LEFT JOIN o_rates r ON r.match_id = o.match_id AND r.owner = o.owner"""

CTES["o_worst"] = """
SELECT * FROM (SELECT e.match_id, e.owner, e.shot_type, e.errors, e.made, ROUND(e.rate, 1) AS rate, ROW_NUMBER() OVER (PARTITION BY e.match_id, e.owner ORDER BY ROUND(e.rate, 1) DESC, f.at) AS k
 FROM o_errtype e JOIN (SELECT match_id, last_owner AS owner, COALESCE(last_type, 'unknown') AS shot_type, MIN(point_idx) AS at FROM o_last WHERE end_reason IN ('OUT', 'NET') GROUP BY 1, 2, 3) f
   ON f.match_id = e.match_id AND f.owner = e.owner AND f.shot_type = e.shot_type WHERE e.shot_type NOT IN ('neutral', 'unknown')) WHERE k = 1"""

CTES["o_topdir"] = """
SELECT *, SUM(n0) OVER (PARTITION BY match_id, owner, shot_type) AS tn FROM (
 SELECT d.match_id, d.owner, d.shot_type, d.direction, d.n AS n0, ROUND(d.n * 100.0::DOUBLE / SUM(d.n) OVER (PARTITION BY d.match_id, d.owner, d.shot_type), 1) AS pct,
   SUM(d.n) OVER (PARTITION BY d.match_id, d.owner, d.shot_type) AS n, MIN(d.seen) OVER (PARTITION BY d.match_id, d.owner, d.shot_type) AS seen,
   ROW_NUMBER() OVER (PARTITION BY d.match_id, d.owner, d.shot_type ORDER BY d.n DESC, d.seen) AS k FROM o_dirs d) WHERE k = 1"""

_N0 = "CAST(CAST(round_even({}, 0) AS BIGINT) AS VARCHAR)"

CTES["o_weak"] = f"""
WITH w AS (
 SELECT match_id, owner, 1 AS rule, 'Against ' || name || ': go beyond seven shots. Their misses grow from ' || {_N0.format('short')} || '% early on to ' || {_N0.format('long')} || '% after shot seven. That was worth ' || lost || ' point' || CASE WHEN lost <> 1 THEN 's' ELSE '' END || ' in the match.' AS description,
   lost || ' own errors from shot 7 on, against ' || {_N0.format('short')} || '% before shot 6' AS data_point, lost AS points_cost, LEAST((long - short) / 50, 1.0) AS severity FROM o_players2 WHERE long > short + 15 AND long > 25
 UNION ALL SELECT p.match_id, p.owner, 2, name || '''s ' || w.shot_type || ' is shaky when pressed: ' || {_N0.format('w.rate')} || '% of them miss (' || w.errors || ' errors from ' || w.made || ' tries). Aim at their ' || w.shot_type || ' side on big points.',
   w.errors || ' errors / ' || w.made || ' ' || w.shot_type || 's (' || {_N0.format('w.rate')} || '% error rate)', w.errors, LEAST(w.rate / 100, 1.0) FROM o_players2 p JOIN o_worst w ON w.match_id = p.match_id AND w.owner = p.owner WHERE w.rate > 20 AND w.errors >= 2
 UNION ALL SELECT p.match_id, p.owner, 3, name || ' shows their ' || d.shot_type || ' — ' || {_N0.format('d.pct')} || '% go ' || replace(d.direction, '_', ' ') || '. ' || opp || ' can move first and punish it.',
   {_N0.format('d.pct')} || '% of ' || d.shot_type || 's go ' || replace(d.direction, '_', ' '), 0, LEAST(d.pct / 100, 0.8)
  FROM o_players2 p JOIN (SELECT *, ROW_NUMBER() OVER (PARTITION BY match_id, owner ORDER BY n DESC, shot_type) AS f FROM o_topdir WHERE shot_type NOT IN ('neutral', 'serve', 'unknown')) d ON d.match_id = p.match_id AND d.owner = p.owner AND d.f = 1 WHERE d.pct > 70 AND d.direction <> 'unknown')
SELECT match_id, owner, CAST(ROW_NUMBER() OVER (PARTITION BY match_id, owner ORDER BY severity DESC, rule) AS INTEGER) AS weakness_no, description, data_point, CAST(points_cost AS BIGINT) AS points_cost, CAST(severity AS DOUBLE) AS severity FROM w"""

CTES["o_rerr"] = """
SELECT s.match_id, s.owner, COALESCE(s.shot_type, 'unknown') AS shot_type, COUNT(*) AS errors, MIN(s.frame_idx) AS at, ANY_VALUE(m.n) AS made, ROUND(COUNT(*) * 100.0::DOUBLE / ANY_VALUE(m.n), 1) AS rate
FROM fx_shots s JOIN o_mix m ON m.match_id = s.match_id AND m.owner = s.owner AND m.shot_type = COALESCE(s.shot_type, 'unknown')
WHERE EXISTS (SELECT 1 FROM o_rebuilt p WHERE p.match_id = s.match_id AND p.is_error AND p.hitter = s.owner AND abs(s.timestamp_sec - p.end_sec) < 1.5) GROUP BY 1, 2, 3"""

CTES["o_rrally"] = """
WITH b AS (SELECT r.*, k.bucket FROM o_rebuilt r JOIN o_bucketed k ON k.match_id = r.match_id AND k.point_idx = r.point_idx), t AS (SELECT match_id, bucket, COUNT(*) AS played FROM b GROUP BY 1, 2)
SELECT b.match_id, b.hitter AS owner, b.bucket, COUNT(*) AS errors, ROUND(COUNT(*) * 100.0::DOUBLE / ANY_VALUE(t.played), 1) AS rate FROM b JOIN t ON t.match_id = b.match_id AND t.bucket = b.bucket WHERE is_error GROUP BY 1, 2, 3"""
