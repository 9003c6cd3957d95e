"""File round trips: results written by the sinks and read back by the readers."""
from __future__ import annotations

from pyspark.sql import functions as F

from rallyframe import constants as K
from rallyframe.operators import curation, history, narrative, state, stats
from rallyframe.plans.q_stats import Tables, rounded
from rallyframe.plans.q_narrative import _profile
from rallyframe.plans.registry import ORACLES, query
from rallyframe.session import pin, shared_folder
from rallyframe.sources import labels, readers, sinks


@query("frame_files", "IO-01 IO-05", """
SELECT CAST(match_id AS VARCHAR) AS match_id, COUNT(*) AS frames_total, ROUND(AVG(CASE WHEN px IS NOT NULL THEN 100.0::DOUBLE ELSE 0 END), 6) AS ball_pct, ROUND(AVG(CASE WHEN cx IS NOT NULL THEN 100.0::DOUBLE ELSE 0 END), 6) AS projected_pct,
  ROUND(AVG(CASE WHEN reliable THEN 100.0::DOUBLE ELSE 0 END), 6) AS reliable_pct, ROUND(AVG(CASE WHEN has_a THEN 100.0::DOUBLE ELSE 0 END), 6) AS a_pct, ROUND(AVG(CASE WHEN has_b THEN 100.0::DOUBLE ELSE 0 END), 6) AS b_pct,
  ROUND(AVG(CASE WHEN has_a AND has_b THEN 100.0::DOUBLE ELSE 0 END), 6) AS both_pct FROM o_frame GROUP BY 1""")
def frame_files(fx):
    t, folder = Tables(fx), shared_folder(fx.spark, "frames")
    doc = sinks.frame_documents(t.physics, t.homography, t.players, fx.keypoints)
    sinks.write_json(doc.withColumn("run", F.col("match_id")), folder, ["run"])
    back = readers.frames(fx.spark, f"{folder}/*")
    back = back.withColumn("job_id", F.regexp_replace("job_id", "^run=", ""))
    return rounded(stats.coverage_quality(readers.flat_frames(back)))


@query("frame_keypoints", "IO-05 IO-01", """
SELECT match_id, frame_idx, COUNT(px) AS seen, ROUND(SUM(ROUND(px, 2)), 2) AS sum_px, ROUND(SUM(ROUND(py, 2)), 2) AS sum_py, ROUND(MAX(CASE WHEN kp = 13 THEN px END), 2) AS last_px FROM fx_keypoints GROUP BY 1, 2""")
def frame_keypoints(fx):
    """The 14 court keypoints of every frame through the frame documents."""
    t, folder = Tables(fx), shared_folder(fx.spark, "keypoints")
    doc = sinks.frame_documents(t.physics, t.homography, t.players, fx.keypoints)
    sinks.write_json(doc.select("match_id", "frame_idx", "court_keypoints").withColumn("run", F.col("match_id")), folder, ["run"])
    back = fx.spark.read.schema("match_id BIGINT, frame_idx BIGINT, court_keypoints ARRAY<ARRAY<DOUBLE>>").json(f"{folder}/*")
    k = back.select("match_id", "frame_idx", F.posexplode("court_keypoints").alias("kp", "xy"))
    return rounded(k.groupBy("match_id", "frame_idx").agg(F.count("xy").alias("seen"), F.round(F.sum(F.col("xy")[0]), 2).alias("sum_px"),
                                                          F.round(F.sum(F.col("xy")[1]), 2).alias("sum_py"), F.max(F.when(F.col("kp") == 13, F.col("xy")[0])).alias("last_px")))


@query("coaching_cards", "IO-15 NA-01 NA-02", f"SELECT c.*, e.exploit_plan FROM ({ORACLES['player_card']}) c JOIN ({ORACLES['exploit_plan']}) e ON e.match_id = c.match_id AND e.owner = c.owner")
def coaching_cards(fx):
    """Whole cards of both players written as the coaching document of a match and read back."""
    from rallyframe.plans.q_narrative import _coverage
    folder, profile = shared_folder(fx.spark, "cards"), pin(_profile(fx, coverage=_coverage(fx)))
    cards = narrative.player_cards(profile, stats.pattern_top(fx.shots)).withColumn("tendencies", F.array_join("tendencies", " "))
    keep = ["tendencies", "serve_summary", "shot_distribution", "coverage_summary", "exploit_plan"]
    plan = profile.select("match_id", "owner", narrative.exploit_plan().alias("exploit_plan"))
    cards = cards.drop("exploit_plan").join(plan, ["match_id", "owner"]).select("match_id", "owner", *keep)
    sinks.write_rows(sinks.coaching_documents(cards, narrative.weakness_report(profile)), folder)
    d = fx.spark.read.schema("match_id BIGINT, document STRING").option("basePath", folder).json(folder)
    card = F.from_json("document", f"MAP<STRING, STRUCT<{', '.join(f'{c}: STRING' for c in keep)}>>")
    return d.select("match_id", F.explode(card).alias("owner", "card")).select("match_id", "owner", "card.*")


@query("point_documents", "IO-02 IO-09", """
SELECT end_reason, COUNT(*) AS n, CAST(SUM(rally_hit_count) AS BIGINT) AS hits, COUNT(DISTINCT match_id) AS runs FROM fx_points GROUP BY 1""")
def point_documents(fx):
    """JSON array documents, one per segment of a run (a segment holds a few points)."""
    folder = shared_folder(fx.spark, "points")
    p = fx.points.select("match_id", F.expr("start_frame div 300").alias("segment"), F.struct("point_idx", "start_frame", "end_frame", "end_reason", "rally_hit_count").alias("p"))
    doc = p.groupBy("match_id", "segment").agg(F.to_json(F.collect_list("p")).alias("value")).repartition("match_id", "segment")
    doc.write.partitionBy("segment", "match_id").text(folder)
    d = readers.documents(fx.spark, f"{folder}/*/*", "points")
    return d.groupBy("end_reason").agg(F.count(F.lit(1)).alias("n"), F.sum("rally_hit_count").alias("hits"), F.countDistinct("job_id").alias("runs"))


@query("label_files", "IO-04 IO-12", """
SELECT match_id, frame_idx, class_id, ROUND(cx, 6) AS cx, ROUND(cy, 6) AS cy, ROUND(w, 6) AS w, ROUND(h, 6) AS h FROM fx_boxes""")
def label_files(fx):
    """One file per frame, written and read by tasks; every box comes back under the frame that the file's name says."""
    folder = shared_folder(fx.spark, "labels")
    labels.write_label_files(curation.label_lines(fx.boxes), folder)
    return rounded(labels.read_label_files(fx.spark, folder))


@query("run_metadata", "IO-11", """
SELECT match_id AS job_id, MAX(fps) AS fps, COUNT(*) AS frames, ROUND(MAX(t_sec), 6) AS segment_end, 100 AS outlier_max_dist FROM fx_frames GROUP BY 1""")
def run_metadata(fx):
    r = fx.frames.groupBy(F.col("match_id").alias("job_id")).agg(
        F.max("ts").cast("string").alias("created_at"), F.lit("footage").alias("source_path"), F.max("fps").alias("fps"), F.min("t_sec").alias("segment_start_sec"),
        F.max("t_sec").alias("segment_end_sec"), F.count(F.lit(1)).alias("frames_processed"))
    conf = {"person_conf_threshold": K.PLAYER_MIN_CONFIDENCE, "court_margin_units": K.COURT_MARGIN, "outlier_max_dist": K.OUTLIER_PX,
            "homography_confidence_threshold": K.LOW_CONFIDENCE, "max_carry_forward_frames": K.MAX_CARRY}
    at = lambda p, t: F.get_json_object("document", p).cast(t)
    d = sinks.run_metadata(r, conf)
    return rounded(d.select("job_id", at("$.video.fps", "double").alias("fps"), at("$.video.frames_processed", "bigint").alias("frames"),
                            at("$.video.segment_end_sec", "double").alias("segment_end"), at("$.config.outlier_max_dist", "int").alias("outlier_max_dist")))


@query("analysis_documents", "IO-13", """
SELECT f.match_id, f.n AS frames_total, ROUND(p.h, 6) AS avg_hits, s.n AS samples, ROUND(m.v, 6) AS max_speed, 2 AS players FROM (SELECT match_id, COUNT(*) AS n FROM fx_frames GROUP BY 1) f
JOIN (SELECT match_id, AVG(rally_hit_count) AS h FROM fx_points GROUP BY 1) p ON p.match_id = f.match_id JOIN (SELECT match_id, COUNT(*) AS n FROM fx_points WHERE bounce_cx IS NOT NULL GROUP BY 1) s ON s.match_id = f.match_id
JOIN (SELECT match_id, MAX(speed) AS v FROM o_physics GROUP BY 1) m ON m.match_id = f.match_id""")
def analysis_documents(fx):
    t = Tables(fx)
    t.physics, t.players = t.physics_table, pin(t.players)
    d = sinks.analysis_documents(stats.coverage_quality(t.frame_table), stats.serve_depth_width(t.serve_points), stats.rally_structure(fx.points, fx.shots),
                                 stats.movement(t.positions), stats.ball_pace(t.physics.select("match_id", "speed", "accel")))
    at = lambda p, kind: F.get_json_object("document", p).cast(kind)
    both = sum((at(f"$.players.{p}.positions", "bigint").isNotNull().cast("int") for p in K.PLAYERS), F.lit(0))
    return rounded(d.select("match_id", at("$.quality.frames_total", "bigint").alias("frames_total"), at("$.rally.avg_hits", "double").alias("avg_hits"),
                            at("$.serve.samples", "bigint").alias("samples"), at("$.ball.speed_max", "double").alias("max_speed"), both.alias("players")))


@query("analytics_documents", "IO-14 HI-01", """
SELECT f.match_id, f.n AS points, a.n AS a_backhands, w.points_won AS b_won FROM (SELECT match_id, COUNT(*) AS n FROM fx_points GROUP BY 1) f
LEFT JOIN o_mix a ON a.match_id = f.match_id AND a.owner = 'player_a' AND a.shot_type = 'backhand' JOIN o_won w ON w.match_id = f.match_id AND w.owner = 'player_b'""")
def analytics_documents(fx):
    d = sinks.analytics_documents(history.snapshot(Tables(fx).serve_points, fx.shots), stats.rally_average(fx.points))
    at = lambda p: F.get_json_object("document", p).cast("bigint")
    return d.select("match_id", at("$.points").alias("points"), at("$.players.player_a.shot_type_counts.backhand").alias("a_backhands"), at("$.players.player_b.points_won").alias("b_won"))


@query("analysis_bundle", "IO-13", """
SELECT e.match_id, e.n AS events, p.n AS points, p.hits, s.n AS shots FROM (SELECT match_id, COUNT(*) AS n FROM o_events GROUP BY 1) e
JOIN (SELECT match_id, COUNT(*) AS n, CAST(SUM(rally_hit_count) AS BIGINT) AS hits FROM fx_points GROUP BY 1) p ON p.match_id = e.match_id
JOIN (SELECT match_id, COUNT(*) AS n FROM fx_shots GROUP BY 1) s ON s.match_id = e.match_id""")
def analysis_bundle(fx):
    folder, t = shared_folder(fx.spark, "bundle"), Tables(fx)
    tables = {"frames": t.physics, "events": sinks.event_rows(t.events), "points": fx.points, "shots": fx.shots}
    sinks.write_bundle(tables, folder)
    back = lambda name: readers.rows(fx.spark, f"{folder}/{name}", tables[name].schema).groupBy("match_id")
    n = lambda name: F.count(F.lit(1)).alias(name)
    return back("events").agg(n("events")).join(back("points").agg(n("points"), F.sum("rally_hit_count").alias("hits")), "match_id").join(back("shots").agg(n("shots")), "match_id")


@query("coaching_files", "IO-15", ORACLES["weakness_report"])
def coaching_files(fx):
    """Cards and weaknesses as documents of a match, written, read back and taken apart."""
    folder, profile = shared_folder(fx.spark, "coaching"), pin(_profile(fx))
    cards = profile.select("match_id", "owner", narrative.exploit_plan().alias("exploit_plan"))
    sinks.write_rows(sinks.coaching_documents(cards, narrative.weakness_report(profile)), folder)
    d = fx.spark.read.schema("match_id BIGINT, document STRING").option("basePath", folder).json(folder)
    weakness = "ARRAY<STRUCT<weakness_no: INT, description: STRING, data_point: STRING, points_cost: BIGINT, severity: DOUBLE>>"
    cards = F.from_json("document", f"MAP<STRING, STRUCT<exploit_plan: STRING, weaknesses: {weakness}>>")
    d = d.select("match_id", F.explode(cards).alias("owner", "card")).select("match_id", "owner", F.explode("card.weaknesses").alias("w"))
    return rounded(d.select("match_id", "owner", "w.*"))


@query("stored_run_files", "IO-03", """
WITH r AS (SELECT match_id AS job_id, COUNT(*) AS n FROM fx_points GROUP BY 1)
SELECT CAST(job_id AS VARCHAR) AS job_id, CASE WHEN job_id = 2 THEN n + 1000 ELSE n END AS total_points FROM r WHERE job_id % 4 <> 3""")
def stored_run_files(fx):
    """One analytics document per run folder; run 2 is computed anew, runs without points are skipped."""
    folder = shared_folder(fx.spark, "runs")
    runs = fx.points.groupBy(F.col("match_id").alias("run")).agg(F.count(F.lit(1)).alias("n"))
    stored = runs.select("run", F.when(F.col("run") % 4 == 3, 0).otherwise(F.col("n")).alias("total_points"))
    sinks.write_json(stored, folder, ["run"])
    current = runs.where("run = 2").select((F.col("n") + 1000).alias("total_points"), F.concat(F.lit("run="), F.col("run")).alias("job_id"))
    d = readers.stored_runs(fx.spark, folder, files="*/*").select("total_points", "job_id")
    return state.replace_run(d, current).select(F.regexp_replace("job_id", "^run=", "").alias("job_id"), "total_points")
