"""Tracking tables derived from the given tables, built with Spark.

``Fixtures(spark, sf_dir)`` offers each table as a DataFrame; ``rallyframe.plans.oracle`` holds the
plain-SQL form of the same tables.
"""
from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rallyframe import constants as K
from rallyframe.operators.scan import row_numbers
from rallyframe.session import pin

E = F.expr

# A camera per match: court to pixel with a vanishing point, scaled to the height of the video. Matrix rows of a match:
# (5e-1, 1e-2, 1e2) * s, (0, 25e-2, 5e1) * s, (g, h, 1) with s = height / 1000.
TILT_X, TILT_Y, SCALE = "((match_id % 3 - 1) * 1e-5)", "((1 + match_id % 3) * 2e-5)", "(frame_height / 1e3)"


def pixel(x: str, y: str) -> tuple[str, str]:
    """Pixel position of a court position in the video of ``match_id``."""
    depth = f"(1 + {TILT_X} * {x} + {TILT_Y} * {y})"
    return f"(5e-1 * {x} + 1e-2 * {y} + 1e2) * {SCALE} / {depth}", f"(25e-2 * {y} + 5e1) * {SCALE} / {depth}"


VIEW = f"array(5e-1 * {SCALE}, 1e-2 * {SCALE}, 1e2 * {SCALE}, 0e0, 25e-2 * {SCALE}, 5e1 * {SCALE}, {TILT_X}, {TILT_Y}, 1e0)"
FPS = "CASE match_id % 3 WHEN 0 THEN 30e0 WHEN 1 THEN 25e0 ELSE 60e0 END"
HEIGHT = "if(match_id % 2 = 0, 1000e0, 720e0)"


class Fixtures:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir, self.kept = spark, sf_dir, False

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def keep_frames(self) -> None:
        """Write the frames once, for queries that read them several times."""
        if not self.kept:
            self.frames, self.kept = pin(self.frames), True

    @cached_property
    def frames(self) -> DataFrame:
        """Frame spine with the ball track and keypoint noise; one row per frame of a match."""
        base = self.table("events").select(
            E("user_id div 30").alias("match_id"), "event_id", "ts")
        ten_minutes = E("CAST(FLOOR(unix_micros(CAST(ts AS TIMESTAMP)) / 600000000D) AS BIGINT)")
        base = row_numbers(base, ["match_id"], ["ts", "event_id"], "frame_no", ten_minutes)
        pos = base.select(
            "match_id", E(FPS).alias("fps"), E(HEIGHT).alias("frame_height"), E("frame_no - 1").alias("frame_idx"), "event_id", "ts").select(
            "*",
            E("380 + abs((frame_idx * 61 + match_id * 173) % 1820 - 910) + if(event_id % 97 = 0, 400, 0)").alias("cx"),
            E("500 + abs((frame_idx * 97 + match_id * 311) % 4996 - 2498)").alias("cy"),
            E("frame_idx % 400 < 320 AND event_id % 17 <> 0 AND NOT (frame_idx % 150 BETWEEN 100 AND 105)").alias("seen"))
        px, py = pixel("(cx + 37e-2)", "(cy + 21e-2)")  # off the grid of whole numbers on which calls and zones change
        return pos.select(
            "match_id", "frame_idx", "frame_height", E("frame_idx div 300").alias("segment_idx"), "event_id", "ts",
            "fps", E("CAST(frame_idx AS DOUBLE) / fps").alias("t_sec"),
            E(f"if(seen, {px}, NULL)").alias("ball_px"),
            E(f"if(seen, {py}, NULL)").alias("ball_py"),
            E("if(seen, CAST(cx AS DOUBLE), NULL)").alias("ball_cx"),
            E("if(seen, CAST(cy AS DOUBLE), NULL)").alias("ball_cy"),
            E("CAST(CASE WHEN frame_idx % 500 BETWEEN 200 AND 207 THEN 60 WHEN event_id % 19 = 0 THEN 30 ELSE 0 END AS DOUBLE)").alias("kp_noise_px"))

    @cached_property
    def detections(self) -> DataFrame:
        slots = E("""explode(array(
            named_struct('slot', 0, 'x0', 832, 'y0', 2800, 'w', 60, 'h', 160),
            named_struct('slot', 1, 'x0', 832, 'y0', 650, 'w', 30, 'h', 80),
            named_struct('slot', 2, 'x0', 2100, 'y0', 1700, 'w', 40, 'h', 90),
            named_struct('slot', 3, 'x0', 500, 'y0', 2600, 'w', 20, 'h', 50)))""").alias("s")
        d = self.frames.select("match_id", "frame_idx", "frame_height", "event_id", slots).filter(
            "NOT (s.slot = 0 AND event_id % 11 = 0) AND NOT (s.slot = 1 AND event_id % 7 = 0) "
            "AND NOT (s.slot = 3 AND event_id % 5 <> 0)")
        d = d.select("match_id", "frame_idx", "frame_height", "event_id", F.col("s.slot").alias("slot"), "s.w", "s.h",
                     E("s.x0 + ((frame_idx * 13 + s.slot * 29) % 401) - 200").alias("foot_cx"),
                     E("s.y0 + ((frame_idx * 7) % 81) - 40").alias("foot_cy"))
        px, py = pixel("(foot_cx + 37e-2)", "(foot_cy + 21e-2)")
        d = d.select("*", E(px).alias("foot_px"), E(py).alias("foot_py"))
        return d.select(
            "match_id", "frame_idx", "frame_height", "slot", "foot_cx", "foot_cy",
            E("foot_px - CAST(w AS DOUBLE) / 2").alias("x1"), E("foot_py - h").alias("y1"),
            E("foot_px + CAST(w AS DOUBLE) / 2").alias("x2"), F.col("foot_py").alias("y2"),
            E("CAST(50 + (event_id * 3 + slot) % 50 AS DOUBLE) / 100").alias("confidence"),
            E("slot").alias("track_id"))

    @cached_property
    def shots(self) -> DataFrame:
        return self.frames.filter("event_id % 4 = 0").select(
            "match_id", "frame_idx", F.col("t_sec").alias("timestamp_sec"),
            E("if((event_id * 7 + match_id) % 3 = 0, 'player_a', 'player_b')").alias("owner"),
            E("CASE event_id % 5 WHEN 0 THEN 'forehand' WHEN 1 THEN 'backhand' WHEN 2 THEN 'serve' WHEN 3 THEN 'neutral' END").alias("shot_type"),
            E("CASE event_id % 7 WHEN 0 THEN 'middle' WHEN 1 THEN 'cross_court' WHEN 2 THEN 'cross_court' WHEN 3 THEN 'down_the_line' WHEN 4 THEN 'cross_court' ELSE 'down_the_line' END").alias("direction"),
            E("if(event_id % 9 = 0, NULL, CAST(event_id % 600 AS DOUBLE) / 10)").alias("speed_m_s"),
            E("CAST(423 + (event_id * 37) % 820 AS DOUBLE)").alias("ball_cx"),
            E("CAST(561 + (event_id * 53) % 2375 AS DOUBLE)").alias("ball_cy"),
            E("if(561 + (event_id * 53) % 2375 > 1748, 'near', 'far')").alias("court_side"))

    @cached_property
    def points(self) -> DataFrame:
        p = (self.frames.select("match_id", E("frame_idx div 40").alias("point_idx"), "event_id")
             .groupBy("match_id", "point_idx").agg((F.max(F.col("event_id") + 31 * F.col("point_idx"))).alias("h")))
        return p.select(
            "match_id", "point_idx", E("point_idx * 40").alias("start_frame"), E("point_idx * 40 + 29").alias("end_frame"),
            E(f"CAST(point_idx * 40 AS DOUBLE) / ({FPS})").alias("start_sec"),
            E(f"CAST(point_idx * 40 + 29 AS DOUBLE) / ({FPS})").alias("end_sec"),
            E("if(point_idx % 2 = 0, 'player_a', 'player_b')").alias("serve_player"),
            E("if(h % 6 = 0, NULL, CAST(380 + (h * 41) % 920 AS DOUBLE))").alias("bounce_cx"),
            E("if(h % 6 = 0, NULL, CAST(900 + (h * 59) % 1700 AS DOUBLE))").alias("bounce_cy"),
            E("CASE h % 5 WHEN 0 THEN 'OUT' WHEN 1 THEN 'NET' WHEN 2 THEN 'DOUBLE_BOUNCE' ELSE 'BALL_LOST' END").alias("end_reason"),
            E("1 + (h * 3) % 12").alias("rally_hit_count"), E("CAST(h % 100 AS DOUBLE) / 100").alias("confidence"))

    @cached_property
    def feedback(self) -> DataFrame:
        v = self.points.select("match_id", "point_idx", E("explode(array(0, 1))").alias("version"))
        return v.filter("point_idx % 4 <> 3 AND (version = 0 OR point_idx % 5 = 0)").select(
            "match_id", "point_idx",
            E("if((point_idx * 7 + match_id + version) % 3 = 0, 'flag', 'confirm')").alias("action"),
            E("CASE WHEN (point_idx * 5 + match_id) % 4 = 0 THEN 'Exclude: replay' WHEN point_idx % 2 = 0 THEN 'looks fine' END").alias("note"),
            "version")

    @cached_property
    def keypoints(self) -> DataFrame:
        ref = ", ".join(f"named_struct('kp', {i}, 'rx', {x}, 'ry', {y})" for i, (x, y) in enumerate(K.COURT_KEYPOINTS))
        k = self.frames.select("match_id", "frame_idx", "frame_height", "event_id", "kp_noise_px", E(f"explode(array({ref}))").alias("k"))
        seen = "(event_id + k.kp) % 29 <> 0"
        px, py = pixel("k.rx", "k.ry")
        return k.select(
            "match_id", "frame_idx", F.col("k.kp").alias("kp"),
            E(f"if({seen}, {px} + kp_noise_px * (((k.kp * 37) % 5) - 2), NULL)").alias("px"),
            E(f"if({seen}, {py} + kp_noise_px * (((k.kp * 23) % 3) - 1), NULL)").alias("py"))

    @cached_property
    def segments(self) -> DataFrame:
        """Segment log: created rows (twice, with other bounds) and completions."""
        s = self.frames.groupBy("match_id", "segment_idx").agg(F.min("t_sec").alias("start_sec"), F.max("t_sec").alias("end_sec"))
        v = s.select("*", E("explode(array(0, 1, 2))").alias("version"))
        return v.filter("version < 2 OR (segment_idx * 7 + match_id) % 5 <> 0").select(
            "match_id", "segment_idx", E("start_sec + version").alias("start_sec"), "end_sec",
            E("if(version = 2, 'complete', 'pending')").alias("status"), "version")

    @cached_property
    def status_log(self) -> DataFrame:
        s = self.frames.groupBy("match_id", "segment_idx").agg(F.max("event_id").alias("e"))
        return s.select(
            F.col("match_id").alias("job_id"), F.col("segment_idx").alias("seq"),
            E("CASE segment_idx % 4 WHEN 0 THEN 'court' WHEN 1 THEN 'ball' WHEN 2 THEN 'players' ELSE 'analytics' END").alias("stage"),
            E("if(segment_idx % 4 = 3, 'complete', 'running')").alias("status"),
            E("if(match_id % 3 = 1 AND segment_idx % 4 = 2, concat('failed at ', CAST(segment_idx AS STRING)), NULL)").alias("error_message"))

    @cached_property
    def notes(self) -> DataFrame:
        n = self.points.filter("point_idx % 3 = 0").select("match_id", "point_idx", "start_sec", E("explode(sequence(0L, point_idx % 2))").alias("k"))
        return n.select("match_id", "point_idx", E("start_sec + k").alias("timestamp_sec"),
                        E("concat('note ', CAST(k AS STRING))").alias("note_text"),
                        E("if(point_idx % 2 = 0, 'player_a', 'player_b')").alias("player"))

    @cached_property
    def evals(self) -> DataFrame:
        """Evaluation rounds of labelling jobs."""
        li = self.table("lineitem")
        g = li.groupBy(F.col("l_orderkey").alias("job_id"), E("CAST(l_linenumber AS BIGINT)").alias("iteration")).agg(
            F.max("l_partkey").alias("a"), F.max("l_suppkey").alias("b"), F.max(E("CAST(l_quantity AS BIGINT)")).alias("q"))
        return g.select(
            "job_id", "iteration",
            E("CAST(60 + (q * 3 + a) % 40 AS DOUBLE) / 100").alias("player_map"),
            E("CAST(55 + (a * 7) % 45 AS DOUBLE) / 100").alias("ball_map"),
            E("CAST(65 + (b * 11 + q) % 35 AS DOUBLE) / 100").alias("court_lines_map"),
            E("CAST(65 + (a + b) % 35 AS DOUBLE) / 100").alias("net_map"),
            E("CAST(80 + (b * 3 + a) % 20 AS DOUBLE) / 100").alias("precision"),
            E("CAST(2 + (b * 3 + a) % 14 AS DOUBLE) / 100").alias("fp_rate"),
            E("300 + (a * 13) % 600").alias("frame_count"), E("5 + b % 26").alias("fps"))

    @cached_property
    def boxes(self) -> DataFrame:
        """Normalised label boxes (0 player, 1 ball, 2 lines, 3 net) per sampled frame."""
        f = self.frames.select(
            "match_id", "frame_idx", "event_id",
            E("explode(sequence(0L, 3 + if(event_id % 53 = 0, 2L, 0L) + event_id % 3))").alias("box_no")).filter("event_id % 13 <> 0")
        return f.select(
            "match_id", "frame_idx", "box_no",
            E("CASE WHEN event_id % 53 = 0 THEN 0 WHEN event_id % 59 = 0 THEN 1 WHEN box_no < 2 THEN 0 ELSE (box_no - 1) % 4 END").cast("int").alias("class_id"),
            E("CAST((event_id * 31 + box_no * 17) % 1000 AS DOUBLE) / 1000").alias("cx"),
            E("CAST((event_id * 43 + box_no * 29) % 1000 AS DOUBLE) / 1000").alias("cy"),
            E("if(event_id % 61 = 0, 0.9D, CAST(5 + (event_id + box_no) % 60 AS DOUBLE) / 200)").alias("w"),
            E("if(event_id % 61 = 0, 0.8D, CAST(5 + (event_id * 3 + box_no) % 50 AS DOUBLE) / 200)").alias("h"),
            E("CAST((event_id * 7 + box_no * 11) % 100 AS DOUBLE) / 100").alias("confidence"))

    @cached_property
    def history(self) -> DataFrame:
        """Per-match snapshots of a player, rates as fractions, maps unfolded into columns."""
        g = self.shots.groupBy("match_id", "owner").agg(
            E("CAST(count_if(shot_type = 'backhand' AND frame_idx % 3 = 0) AS DOUBLE) / nullif(count_if(shot_type = 'backhand'), 0)").alias("backhand"),
            E("CAST(count_if(shot_type = 'forehand' AND frame_idx % 4 = 0) AS DOUBLE) / nullif(count_if(shot_type = 'forehand'), 0)").alias("forehand"),
            E("if(match_id % 2 = 1, NULL, CAST(count_if(frame_idx % 2 = 0) AS DOUBLE) / count(1))").alias("rally_79"),
            E("CAST(count_if(frame_idx % 5 < 3) AS DOUBLE) / count(1)").alias("rally_10"),
            E("CAST(count_if(speed_m_s > 22) AS DOUBLE) / count(speed_m_s)").alias("first_serve"),
            E("avg(speed_m_s) * 3.6D").alias("speed_kmh"), E("count(1)").alias("total_shots"),
            E("count_if(shot_type = 'serve')").alias("n_serve"), E("count_if(shot_type = 'forehand')").alias("n_forehand"))
        return g.select(
            E("concat(owner, '_', CAST(match_id % 2 AS STRING))").alias("player_id"), F.col("match_id").alias("job_id"),
            F.col("owner").alias("player_key"),
            E("concat('2024-', lpad(CAST(1 + match_id % 12 AS STRING), 2, '0'), '-01')").alias("match_date"),
            "backhand", "forehand", "rally_79", "rally_10", "first_serve", "speed_kmh", "total_shots",
            E("if(n_serve > n_forehand, 'serve', 'forehand')").alias("dominant_pattern"))

    @cached_property
    def hashes(self) -> DataFrame:
        """256-bit frame hashes as eight 32-bit words, with exact and near copies of frames."""
        e = self.table("embeddings").select("vec_id", "embedding", E("explode(array(0L, 1L, 2L))").alias("copy"))
        e = e.filter("copy = 0 OR (copy = 1 AND vec_id % 3 = 0) OR (copy = 2 AND vec_id % 5 = 0)")
        cols = []
        for w in range(8):
            first, limit = (w % 2) * 32, ("-0.1", "0", "0.05", "0.15")[w // 2]
            cols.append(E(
                f"aggregate(sequence(0, 31), 0L, (acc, i) -> acc + if(CAST(embedding[{first} + i] AS DOUBLE) > "
                f"CAST('{limit}' AS DOUBLE) + if(copy = 1, 0.002D, 0D), shiftleft(1L, i), 0L))").alias(f"w{w}"))
        return e.select(E("copy * 1000000 + vec_id").alias("frame_no"),
                        *[F.when(F.col("vec_id") % 101 != 100, c).alias(f"w{i}") for i, c in enumerate(cols)])

    @cached_property
    def poses(self) -> DataFrame:
        """Pose keypoints of the shot owners around their shots: 17 structs (y, x, conf)."""
        kp = ("transform(sequence(0, 16), i -> named_struct("
              "'y', CAST((event_id * 13 + i * 37) % 100 AS DOUBLE) / 100, "
              "'x', CAST((event_id * 29 + i * 53) % 100 AS DOUBLE) / 100, "
              "'conf', CAST((event_id * 7 + i * 3) % 100 AS DOUBLE) / 100))")
        return self.frames.filter("event_id % 3 <> 0").select(
            "match_id", "frame_idx", E("if(event_id % 2 = 0, 'player_a', 'player_b')").alias("player"), E(kp).alias("kps"))
