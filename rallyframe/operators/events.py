"""Bounce and hit detection, suppression, cross-type clean-up and player assignment."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rallyframe import constants as K
from rallyframe.functions import scalars as S
from rallyframe.operators.greedy import islands, suppress
from rallyframe.operators.players import nearest
from rallyframe.operators.scan import bounded
from rallyframe.operators.tracking import circular_mean

KEY = ["match_id"]
EVENT_COLUMNS = ["event_type", "frame_idx", "timestamp_sec", "cx", "cy", "speed_before", "speed_after", "turn_deg",
                 "score", "court_side", "in_out"]
REACH = 8


def candidates(physics: DataFrame, keys: Sequence[str] = KEY, line_margin: float = K.LINE_MARGIN,
               size: int | None = None) -> DataFrame:
    """Bounce and hit candidates of all frames in one pass over the same window.

    A smoothed height that moves by no more than ``K.STILL`` stands still: frames of a symmetric arc cancel to zero, and the sign
    of what floating point leaves of them is no reversal. Limits and roundings that a value meets exactly are settled by ``K.TIE``.
    """
    def local(d, w):
        side = lambda a, b: w.rowsBetween(a, b)
        d = d.select("*", F.avg("cy").over(side(-1, 1)).alias("_sy"),
                     F.avg("speed").over(side(-3, -1)).alias("_vb"), F.avg("speed").over(side(1, 3)).alias("_va"),
                     F.max(F.col("cx").isNull()).over(side(-3, 3)).alias("_gap"),
                     F.lead(F.lit(1), 2).over(w).isNotNull().alias("_room"),
                     (F.col("cx") - F.lag("cx").over(w)).alias("_dx"), (F.col("cy") - F.lag("cy").over(w)).alias("_dy"))
        d = d.withColumn("_step", F.col("_sy") - F.lag("_sy").over(w)).withColumn(
            "_dir", F.when((F.abs("_dx") > 0.1) | (F.abs("_dy") > 0.1), S.direction_deg("_dx", "_dy")))
        return d.select("*", F.lag("_step").over(w).alias("_last_step"),
                        circular_mean(F.col("_dir"), side(-3, -1)).alias("_db"),
                        circular_mean(F.col("_dir"), side(1, 3)).alias("_da"))
    d = bounded(physics, keys, "frame_idx", REACH, REACH, local, size).filter(
        "frame_idx >= 2 AND _room AND NOT _gap AND cx IS NOT NULL")
    turn = S.angle_between("_db", "_da")
    up, down = lambda c: F.col(c) > K.STILL, lambda c: F.col(c) < -K.STILL
    reverses = (up("_last_step") & down("_step")) | (down("_last_step") & up("_step"))
    slow = F.coalesce(F.col("speed") < F.col("_vb") * 0.8 - K.TIE, F.lit(False)) | F.coalesce(F.col("accel") < -10, F.lit(False))
    is_bounce = reverses & F.coalesce(F.col("_vb") >= K.EVENT_MIN_SPEED - K.TIE, F.lit(True)) & slow
    top_speed = F.coalesce(F.greatest("speed", "_vb", "_va"), F.lit(0.0))
    is_hit = (turn >= K.TURN_DEG) & (top_speed >= K.HIT_MIN_SPEED - K.TIE)
    none = F.lit(None)
    row = lambda kind, deg, score, call: F.struct(
        F.lit(kind).alias("event_type"), deg.cast("double").alias("turn_deg"), S.round_up(score, 3).alias("score"),
        call.cast("string").alias("in_out"))
    found = F.array_compact(F.array(
        F.when(is_bounce, row("bounce", none, S.bounce_score("_vb", "speed", "accel"), S.in_out("cx", "cy", line_margin))),
        F.when(is_hit, row("hit", F.round(turn, 1), S.hit_score(turn, "_vb", "_va"), none))))
    return d.select(*keys, "frame_idx", F.round(F.col("frame_idx") / F.col("fps"), 3).alias("timestamp_sec"), "cx", "cy",
                    S.round_up("_vb", 2).alias("speed_before"), S.round_up("_va", 2).alias("speed_after"),
                    S.court_side("cy").alias("court_side"), F.explode(found).alias("_e")) \
            .select("*", "_e.*").drop("_e").select(*keys, *EVENT_COLUMNS)


def temporal_nms(cands: DataFrame, keys: Sequence[str] = KEY, reach: int = K.NMS_FRAMES, **kw) -> DataFrame:
    """Best candidate of each type within ``reach`` frames."""
    return suppress(cands, [*keys, "event_type"], "frame_idx", "score", reach, **kw)


def cross_dedup(events: DataFrame, keys: Sequence[str] = KEY, gap: int = K.DEDUP_GAP, size: int | None = None) -> DataFrame:
    """Of a chain of bounces and hits at most ``gap`` frames apart keep the best; pure chains stay."""
    keys = list(keys)
    d = islands(events, keys, "frame_idx", gap, "_chain", tie=["event_type"], size=size)
    rank = F.struct("score", (-F.col("frame_idx")).alias("f"), (F.col("event_type") == "bounce").alias("b"))
    best = d.groupBy(*keys, "_chain").agg((F.min("event_type") != F.max("event_type")).alias("_mixed"), F.max(rank).alias("_best"))
    j = d.join(best, [*keys, "_chain"]).filter(~F.col("_mixed") | (rank == F.col("_best")))
    return j.select(*events.columns)


def assign_players(events: DataFrame, players: DataFrame, keys: Sequence[str] = KEY,
                   proximity: float = K.PROXIMITY) -> DataFrame:
    """Add ``player``/``player_distance`` to hits with a player close enough."""
    hits = events.filter("event_type = 'hit'")
    near = nearest(hits, players, "cx", "cy", keys=keys)
    ok = F.col("near_dist") <= proximity
    hits = near.select(*events.columns, F.when(ok, F.col("near_label")).alias("player"),
                       F.when(ok, F.round("near_dist", 1)).alias("player_distance"))
    rest = events.filter("event_type <> 'hit'").withColumn("player", F.lit(None).cast("string")).withColumn(
        "player_distance", F.lit(None).cast("double"))
    return hits.unionByName(rest)
