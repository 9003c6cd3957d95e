"""Racket contacts: detection, ownership, direction and stroke class."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rallyframe import constants as K
from rallyframe.functions import scalars as S
from rallyframe.operators.greedy import debounce
from rallyframe.operators.players import nearest
from rallyframe.operators.scan import Agg, bounded, scan
from rallyframe.operators.tracking import ema_observed

KEY = ["match_id"]


def contact_candidates(physics: DataFrame, keys: Sequence[str] = KEY, alpha: float = K.EMA_ALPHA,
                       size: int | None = None) -> DataFrame:
    """Sharp turns of the smoothed track, before the cooldown."""
    d = bounded(physics, keys, "frame_idx", 0, 1, lambda s, w: s.withColumn("_room", F.lead(F.lit(1)).over(w).isNotNull()), size)
    d = ema_observed(d, "cx", "cy", alpha, keys, size)
    def local(s, w):
        return s.select("*", F.lag("frame_idx", 2).over(w).alias("_f2"),
                        (F.col("sx") - F.lag("sx").over(w)).alias("vx"), (F.col("sy") - F.lag("sy").over(w)).alias("vy")) \
                .select("*", F.lag("vx").over(w).alias("_vx"), F.lag("vy").over(w).alias("_vy"))
    d = bounded(d, keys, "obs_no", 2, 0, local, size)
    before, now = F.hypot("_vx", "_vy"), F.hypot("vx", "vy")
    cos = (F.col("_vx") * F.col("vx") + F.col("_vy") * F.col("vy")) / (before * now)
    turn = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos))))
    # three frames in a row must have been seen
    steady = F.col("frame_idx") - F.col("_f2") == K.STABLE_FRAMES - 1
    peak = F.greatest(before, now)
    return (d.filter((F.col("frame_idx") >= 2) & F.col("_room") & steady & peak.between(K.CONTACT_MIN_SPEED, K.CONTACT_MAX_SPEED)
                     & (before * now >= 0.01) & (turn >= K.CONTACT_ANGLE))
            .select(*keys, "frame_idx", "fps", "sx", "sy", "vx", "vy", "speed"))


def detect_contacts(physics: DataFrame, players: DataFrame, keys: Sequence[str] = KEY, start_sec: float = 0.0,
                    size: int | None = None) -> DataFrame:
    """Contacts with owner, direction, speed and side."""
    d = debounce(contact_candidates(physics, keys, size=size), keys, "frame_idx", K.COOLDOWN, size=size)
    d = own(d, players, "sx", "sy", keys)
    moved = (F.abs("vx") > 0.01) | (F.abs("vy") > 0.01)
    return d.select(*keys, "frame_idx", S.frame_seconds("frame_idx", "fps", start_sec).alias("timestamp_sec"), "owner",
                    F.col("sx").alias("ball_cx"), F.col("sy").alias("ball_cy"),
                    F.round(F.when(moved, S.direction_deg("vx", "vy")), 1).alias("direction_deg"),
                    F.round("speed", 2).alias("speed_m_s"), S.court_side("sy").alias("court_side"), "ownership")


def own(rows: DataFrame, players: DataFrame, x: str, y: str, keys: Sequence[str] = KEY, far: float = 500.0) -> DataFrame:
    """Add ``owner`` and ``ownership`` (how it was decided) from nearest player and court side."""
    d = nearest(rows, players, x, y, keys=keys)
    side_owner = F.when(F.col(y) > K.NET_Y, "player_a").otherwise("player_b")
    none, same, off = F.col("near_label").isNull(), F.col("near_label") == side_owner, F.col("near_dist") > far
    return (d.withColumn("owner", F.when(none | off, side_owner).otherwise(F.col("near_label")))
            .withColumn("ownership", S.when_chain([(none, "court_side"), (same, "combined"), (off, "court_side")], "distance"))
            .drop("near_label", "near_dist"))


def first_in_rally(shots: DataFrame, keys: Sequence[str] = KEY, gap_sec: float = 2.5, size: int | None = None) -> DataFrame:
    """Add ``first_in_rally``: no earlier shot, or the previous one more than ``gap_sec`` ago."""
    d = scan(shots, keys, ["frame_idx"], size=size, _t=Agg("last", "before", F.col("timestamp_sec")))
    return d.withColumn("first_in_rally", F.coalesce(F.col("timestamp_sec") - F.col("_t") > gap_sec, F.lit(True))).drop("_t")


def classify(shots: DataFrame, angle: str = "direction_deg", keys: Sequence[str] = KEY, size: int | None = None) -> DataFrame:
    """Add ``shot_class``, ``class_confidence`` and ``direction_label`` from the trajectory."""
    d = first_in_rally(shots, keys, size=size)
    behind = S.behind_baseline("ball_cy", "court_side")
    fast = F.coalesce(F.col("speed_m_s"), F.lit(0.0)) >= K.SERVE_MIN_SPEED
    serve = F.col("first_in_rally") & (behind | fast)
    stroke = S.forehand_backhand(angle, "court_side")
    unknown = F.col(angle).isNull()
    return (d.withColumn("shot_class", S.when_chain([(serve, "serve"), (unknown, "neutral")], stroke))
            .withColumn("class_confidence", S.when_chain([(serve & behind & fast, 0.85), (serve, 0.65), (unknown, 0.3),
                                                          (stroke == "neutral", 0.35)], 0.6))
            .withColumn("direction_label", S.shot_direction(angle, "ball_cx", "court_side")))
