"""Row shapes of the result files and their writers.

Each result is a table written as partitioned files; nothing is gathered into one row or one task.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rallyframe.functions import scalars as S
from rallyframe.operators.state import with_label

SEGMENT = ("match_id", "segment_idx")


def ball_series(physics: DataFrame, start_sec: float = 0.0) -> DataFrame:
    """Ball time series; everything but the time is absent without a court position."""
    known = F.col("cx").isNotNull()
    r = lambda c: F.when(known, S.safe_round(c))
    return physics.select(
        "match_id", S.frame_seconds("frame_idx", "fps", start_sec).alias("t"), "frame_idx", r("cx").alias("x"), r("cy").alias("y"), r("speed").alias("speed_m_s"),
        F.when(known & (F.col("speed") != 0), S.safe_round(F.col("speed") * 3.6)).alias("speed_km_h"), r("accel").alias("accel_m_s2"))


def player_series(players: DataFrame, fps: float | str = "fps", start_sec: float = 0.0) -> DataFrame:
    """``fps`` is a number or a column of ``players``."""
    known = F.col("foot_x").isNotNull()
    r = lambda c: F.when(known, S.safe_round(c))
    rate = F.col(fps) if isinstance(fps, str) else F.lit(fps)
    return players.select("match_id", "label", S.frame_seconds("frame_idx", rate, start_sec).alias("t"), "frame_idx", r("foot_x").alias("x"), r("foot_y").alias("y"),
                          r("foot_px").alias("foot_pixel_x"), r("foot_py").alias("foot_pixel_y"))


def event_rows(events: DataFrame) -> DataFrame:
    """Hits carry the player, bounces the call."""
    hit, bounce = F.col("event_type") == "hit", F.col("event_type") == "bounce"
    return events.select(
        "match_id", "event_type", "frame_idx", "timestamp_sec", S.safe_round("cx").alias("x"), S.safe_round("cy").alias("y"),
        F.col("speed_before").alias("speed_before_m_s"), F.col("speed_after").alias("speed_after_m_s"), F.col("turn_deg").alias("direction_change_deg"),
        "score", "court_side", F.when(hit, F.col("player")).alias("player"), F.when(hit, F.col("player_distance")).alias("player_distance"),
        F.when(bounce, F.col("in_out")).alias("in_out"))


def point_rows(points: DataFrame) -> DataFrame:
    """Flat points; the bounce frames of a point are rows of the events file within its frame span."""
    return points


def shot_rows(shots: DataFrame, directions: DataFrame) -> DataFrame:
    d = with_label(shots, directions, "direction").withColumnRenamed("direction", "ball_direction_label")
    return d.withColumn("speed_m_s", S.safe_round("speed_m_s"))


def frame_documents(track: DataFrame, homography: DataFrame, players: DataFrame, keypoints: DataFrame | None = None, start_sec: float = 0.0) -> DataFrame:
    """Nested per-frame records (ball, homography, court keypoints, players).

    Every array is bounded by the record itself: two players and 14 keypoints per frame.
    """
    on = ["match_id", "frame_idx"]
    r = S.safe_round
    pair = lambda a, b, cond=None: F.when(F.col(a).isNotNull(), F.array(r(a), r(b)))
    h = homography.select(*on, F.struct(F.col("detected").alias("detected_keypoints"), r("confidence", 3).alias("confidence"),
                                        r("error").alias("reprojection_error_px"), "reliable", F.col("carried").alias("carried_forward")).alias("homography"))
    p = players.select(*on, "label", F.struct(
        F.array(*[r(c) for c in ("x1", "y1", "x2", "y2")]).alias("bbox"), r("confidence", 3).alias("confidence"), "track_id",
        F.array(r("foot_px"), r("foot_py")).alias("foot_pixel"), pair("foot_x", "foot_y").alias("foot_court")).alias("p"))
    pick = lambda label: F.max(F.when(F.col("label") == label, F.col("p"))).alias(label)
    p = p.groupBy(*on).agg(pick("player_a"), pick("player_b")).select(*on, F.struct("player_a", "player_b").alias("players"))
    d = track.select(*on, S.frame_seconds("frame_idx", "fps", start_sec).alias("timestamp_sec"), F.struct(
        pair("ball_px", "ball_py").alias("pixel_xy"), pair("cx", "cy").alias("court_xy"), r("speed").alias("speed_m_s"), r("accel").alias("accel_m_s2")).alias("ball"))
    d = d.join(h, on, "left").join(p, on, "left")
    if keypoints is not None:
        k = keypoints.groupBy(*on).agg(F.sort_array(F.collect_list(F.struct("kp", pair("px", "py").alias("xy")))).alias("_k"))
        d = d.join(k.select(*on, F.transform("_k", lambda x: x.xy).alias("court_keypoints")), on, "left")
    return d


def run_metadata(runs: DataFrame, config: dict[str, object]) -> DataFrame:
    """One JSON document per run: source, frame rate, bounds, frames and configuration."""
    conf = F.struct(*[F.lit(v).alias(k) for k, v in config.items()])
    video = F.struct("source_path", "fps", "segment_start_sec", "segment_end_sec", "frames_processed")
    return runs.select("job_id", F.to_json(F.struct(F.col("job_id"), F.col("created_at"), video.alias("video"), conf.alias("config"))).alias("document"))


def analysis_documents(quality: DataFrame, serve: DataFrame, rally: DataFrame, movement: DataFrame, pace: DataFrame) -> DataFrame:
    """One nested document per match from the per-match summary tables (two movement rows at most)."""
    on = "match_id"
    pack = lambda df, name: df.select(on, F.struct(*[c for c in df.columns if c != on]).alias(name))
    m = movement.groupBy(on).agg(F.map_from_entries(F.collect_list(F.struct("label", F.struct(
        *[c for c in movement.columns if c not in (on, "label")])))).alias("players"))
    d = pack(quality, "quality").join(pack(serve, "serve"), on, "left").join(pack(rally, "rally"), on, "left").join(m, on, "left").join(pack(pace, "ball"), on, "left")
    return d.select(on, F.to_json(F.struct("match_id", "quality", "serve", "rally", "players", "ball")).alias("document"))


def analytics_documents(player_maps: DataFrame, match_scalars: DataFrame) -> DataFrame:
    """Per match: the statistics of both players (at most two rows) and match totals as JSON."""
    body = F.struct(*[c for c in player_maps.columns if c not in ("match_id", "owner")])
    p = player_maps.groupBy("match_id").agg(F.map_from_entries(F.collect_list(F.struct("owner", body))).alias("players"))
    d = match_scalars.join(p, "match_id", "left")
    return d.select("match_id", F.to_json(F.struct(*[c for c in d.columns])).alias("document"))


def coaching_documents(cards: DataFrame, weaknesses: DataFrame) -> DataFrame:
    """Per match: cards of both players with up to three weaknesses each."""
    w = weaknesses.groupBy("match_id", "owner").agg(F.sort_array(F.collect_list(F.struct("weakness_no", "description", "data_point", "points_cost", "severity"))).alias("weaknesses"))
    d = cards.join(w, ["match_id", "owner"], "left")
    body = F.struct(*[c for c in d.columns if c not in ("match_id", "owner")])
    g = d.groupBy("match_id").agg(F.map_from_entries(F.collect_list(F.struct("owner", body))).alias("players"))
    return g.select("match_id", F.to_json("players").alias("document"))


# --- writers ----------------------------------------------------------------------------------------

def write_json(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """JSON lines. Rows of a folder come together first, or every task would write a file into every folder; Spark
    spreads a folder that is too large for one task over several."""
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    w = df.write.mode(mode).option("ignoreNullFields", "false")
    (w.partitionBy(*partition_by) if partition_by else w).json(path)


def write_rows(df: DataFrame, path: str) -> None:
    """A result table (series, events, points, shots) as JSON lines, one folder per match."""
    write_json(df, path, ["match_id"])


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    w = df.write.mode(mode).option("partitionOverwriteMode", "dynamic")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def write_bundle(tables: dict[str, DataFrame], path: str, partition_by: Sequence[str] = ("match_id",)) -> None:
    """All result tables of a job below one folder; the per-frame table is left out."""
    for name, df in tables.items():
        if name != "frames":
            write_json(df, f"{path}/{name}", [c for c in partition_by if c in df.columns])
