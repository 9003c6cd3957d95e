"""Keyed state as append-only logs: latest-wins views, review, segments, artifacts, listings."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F




def latest(log: DataFrame, keys: Sequence[str], order: Sequence[str], first_of: Sequence[str] = (), newest: bool = True) -> DataFrame:
    """One row per key, the newest (or oldest) version; ``first_of`` columns keep their oldest value.

    A plain aggregate, so versions are combined before the shuffle.
    """
    keys = list(keys)
    rank = F.struct(*order)
    rest = [c for c in log.columns if c not in keys and c not in first_of]
    pick = F.max_by if newest else F.min_by
    g = log.groupBy(*keys).agg(pick(F.struct(*rest), rank).alias("_r"), *[F.min_by(c, rank).alias(c) for c in first_of])
    return g.select(*keys, "_r.*", *first_of)


def insert_if_absent(log: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return latest(log, keys, order, newest=False)


def with_label(rows: DataFrame, labels: DataFrame, label: str, default: str | None = "unknown", on: Sequence[str] = ("match_id", "frame_idx")) -> DataFrame:
    """Look a label up by frame, ``default`` where there is none."""
    d = rows.join(labels.select(*on, label), list(on), "left")
    return d if default is None else d.withColumn(label, F.coalesce(label, F.lit(default)))


def filter_log(log: DataFrame, **choices: str | None) -> DataFrame:
    """Equality filters; "all" or None leaves a column alone."""
    for column, value in choices.items():
        if value not in (None, "all"):
            log = log.filter(F.col(column) == value)
    return log


def with_feedback(points: DataFrame, feedback: DataFrame) -> DataFrame:
    """Points with the latest review action and note."""
    f = latest(feedback, ["match_id", "point_idx"], ["version"]).select(
        "match_id", "point_idx", F.col("action").alias("coach_action"), F.col("note").alias("coach_note"))
    return points.join(f, ["match_id", "point_idx"], "left")


def apply_review(points: DataFrame, feedback: DataFrame, penalty: float = 0.5) -> DataFrame:
    """Flagged points lose half their confidence and are excluded when the note says so."""
    d = with_feedback(points, feedback)
    flag = F.coalesce(F.col("coach_action") == "flag", F.lit(False))
    told = F.coalesce(F.lower("coach_note").contains("exclude"), F.lit(False))
    return (d.withColumn("original_confidence", F.when(flag, F.col("confidence")))
            .withColumn("confidence", F.when(flag, F.round(F.col("confidence") * penalty, 3)).otherwise(F.col("confidence")))
            .withColumn("excluded", flag & told))


def without_excluded(reviewed: DataFrame) -> DataFrame:
    return reviewed.filter(~F.col("excluded"))


def review_counters(reviewed: DataFrame) -> DataFrame:
    n = lambda c, name: F.count_if(c).alias(name)
    return reviewed.groupBy("match_id").agg(F.count(F.lit(1)).alias("total_points"), n(F.col("coach_action") == "confirm", "confirmed"),
                                            n(F.col("coach_action") == "flag", "flagged"), n(F.col("excluded"), "excluded"))


def segment_states(log: DataFrame) -> DataFrame:
    """Bounds from the first insert, status from the newest row."""
    base = insert_if_absent(log.filter("status = 'pending'"), ["match_id", "segment_idx"], ["version"]).drop("status", "version")
    now = latest(log, ["match_id", "segment_idx"], ["version"]).select("match_id", "segment_idx", "status")
    return base.join(now, ["match_id", "segment_idx"])


def incomplete_segments(log: DataFrame) -> DataFrame:
    done = log.filter("status = 'complete'").select("match_id", "segment_idx")
    return log.select("match_id", "segment_idx").distinct().join(done, ["match_id", "segment_idx"], "left_anti")


def segment_completion(log: DataFrame) -> DataFrame:
    s = segment_states(log)
    done = F.col("status") == "complete"
    return s.groupBy("match_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(done).alias("complete"), F.count_if(~done).alias("incomplete"))


def job_status(log: DataFrame) -> DataFrame:
    """Latest stage and status per job; an error wins over later updates."""
    g = log.groupBy("job_id").agg(F.max_by(F.struct("stage", "status"), "seq").alias("_l"),
                                  F.max_by("error_message", F.when(F.col("error_message").isNotNull(), F.col("seq"))).alias("error_message"))
    return g.select("job_id", F.col("_l.stage").alias("stage"),
                    F.when(F.col("error_message").isNotNull(), "error").otherwise(F.col("_l.status")).alias("status"), "error_message")


def full_status(log: DataFrame, decisions: DataFrame, evals: DataFrame) -> DataFrame:
    """Job status with the decisions in order (one an iteration), their number, the last one and the last evaluation."""
    listed = F.sort_array(F.collect_list(F.struct("iteration", "action", "justification")))
    d = decisions.groupBy("job_id").agg(F.count(F.lit(1)).alias("decisions"), F.max_by("action", "iteration").alias("last_action"), listed.alias("decision_log"))
    e = latest(evals, ["job_id"], ["iteration"]).select("job_id", F.col("iteration").alias("last_iteration"), F.col("player_map").alias("last_player_map"))
    return job_status(log).join(d, "job_id", "left").join(e, "job_id", "left")


def artifacts_by_type(artifacts: DataFrame) -> DataFrame:
    """Long form of the type -> list map: rows ordered by (job, type, number)."""
    return artifacts.select("job_id", "artifact_type", "artifact_no", "path").orderBy("job_id", "artifact_type", "artifact_no")


def artifact_counts(artifacts: DataFrame) -> DataFrame:
    return artifacts.groupBy("job_id", "artifact_type").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("first_path"), F.max("path").alias("last_path"))


def detection_summary(run_meta: DataFrame, points: DataFrame, events: DataFrame) -> DataFrame:
    """fps, frames and duration from the metadata JSON, totals from the result tables."""
    m = run_meta.select("match_id", F.from_json("metadata", "fps DOUBLE, frame_count BIGINT").alias("m")).select("match_id", "m.*")
    m = m.withColumn("duration_sec", F.round(F.try_divide("frame_count", "fps"), 2))
    count = lambda df, name: df.groupBy("match_id").agg(F.count(F.lit(1)).alias(name))
    return m.join(count(points, "total_points"), "match_id", "left").join(count(events, "total_events"), "match_id", "left")


def notes_per_point(points: DataFrame, notes: DataFrame) -> DataFrame:
    g = notes.groupBy("match_id", "point_idx").agg(F.count(F.lit(1)).alias("notes"), F.min_by("note_text", "timestamp_sec").alias("first_note"),
                                                   F.max_by("note_text", "timestamp_sec").alias("last_note"))
    return points.select("match_id", "point_idx").join(g, ["match_id", "point_idx"], "left").na.fill({"notes": 0})


def delete_cascade(players: DataFrame, match_stats: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Players and their match rows without the deleted ones."""
    ids = gone.select("player_id").distinct()
    return players.join(ids, "player_id", "left_anti"), match_stats.join(ids, "player_id", "left_anti")


def session_records(feedback: DataFrame, preferences: DataFrame) -> DataFrame:
    """Per match: review summary of the latest feedback and the newest saved preferences."""
    f = latest(feedback, ["match_id", "point_idx"], ["version"])
    s = f.groupBy("match_id").agg(F.count(F.lit(1)).alias("reviewed"), F.count_if(F.col("action") == "flag").alias("flagged"),
                                  F.count("note").alias("with_note"))
    return s.join(latest(preferences, ["match_id"], ["created_at"]), "match_id", "left")


def recompute_if_empty(stored: DataFrame, rebuilt: DataFrame, keys: Sequence[str] = ("match_id", "owner")) -> DataFrame:
    """Stored rows with shots and points, rebuilt rows for everything else."""
    ok = stored.filter("total_shots > 0 AND total_points > 0")
    rest = rebuilt.join(ok.select(*keys), list(keys), "left_anti")
    return ok.withColumn("source", F.lit("stored")).unionByName(rest.withColumn("source", F.lit("rebuilt")), allowMissingColumns=True)


def add_column(old: DataFrame, new: DataFrame, column: str, default: Column) -> DataFrame:
    """Read old and new rows together, filling the column old rows lack."""
    d = old.unionByName(new, allowMissingColumns=True)
    return d.withColumn(column, F.coalesce(column, default))


def replace_run(stored: DataFrame, current: DataFrame, key: str = "job_id") -> DataFrame:
    """Stored runs with points, where the current run replaces its stored copy."""
    others = stored.filter("total_points > 0").join(current.select(key).distinct(), key, "left_anti")
    return others.unionByName(current)


def with_card(points: DataFrame, cards: DataFrame) -> DataFrame:
    """First card of each point."""
    c = cards.groupBy("match_id", "point_idx").agg(F.min_by("summary", "card_no").alias("summary"))
    return points.join(c, ["match_id", "point_idx"], "left")
