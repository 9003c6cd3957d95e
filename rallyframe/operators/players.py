"""Player detections: court filter, choice of A and B, carry-forward."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rallyframe import constants as K
from rallyframe.functions import scalars as S
from rallyframe.operators.scan import Agg, scan

KEY = ["match_id"]


def locate(detections: DataFrame, homography: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Add foot point, court position and the court test; uncalibrated frames keep everybody."""
    h = homography.select(*keys, "frame_idx", F.when(F.col("reliable"), F.col("inverse")).alias("_inv"))
    fx, fy = S.foot_point("x1", "x2", "y2")
    d = detections.join(h, [*keys, "frame_idx"], "left").withColumn("foot_px", fx).withColumn("foot_py", fy)
    cx, cy = S.project("_inv", "foot_px", "foot_py")
    d = d.withColumn("foot_x", cx).withColumn("foot_y", cy)
    return d.withColumn("inside", F.when(F.col("_inv").isNull(), True).otherwise(S.inside_court("foot_x", "foot_y"))).drop("_inv")


BOX = ["foot_px", "foot_py", "foot_x", "foot_y", "confidence", "track_id", "x1", "y1", "x2", "y2"]


def by_frame(located: DataFrame, frame_height: float | str = 1000.0, min_confidence: float = K.PLAYER_MIN_CONFIDENCE,
             keys: Sequence[str] = KEY, keep: Sequence[str] = BOX) -> DataFrame:
    """One row per frame with a struct of the columns ``keep`` for each label, null where it is missing: the largest box of the near half is A, of the far half B.
    ``frame_height`` is a number or a column of ``located``. Rows that were joined per frame need no further shuffle or sort."""
    height = F.col(frame_height) if isinstance(frame_height, str) else F.lit(frame_height)
    d = located.filter(F.col("inside") & (F.col("confidence") >= min_confidence)).withColumn(
        "label", F.when(F.col("foot_py") >= height / 2, "player_a").otherwise("player_b"))
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    largest = lambda p: F.max_by(F.struct(*keep), F.when(F.col("label") == p, F.struct(area.alias("a"), (-F.col("slot")).alias("s"))))
    return d.groupBy(*keys, "frame_idx").agg(*[largest(p).alias(p) for p in K.PLAYERS])


def _labels() -> Column:
    return F.inline(F.array(*[F.struct(F.lit(p).alias("label"), F.col(p).alias("_p")) for p in K.PLAYERS]))


def choose(located: DataFrame, frame_height: float | str = 1000.0, min_confidence: float = K.PLAYER_MIN_CONFIDENCE,
           keys: Sequence[str] = KEY) -> DataFrame:
    """One row per (frame, label) that is seen."""
    d = by_frame(located, frame_height, min_confidence, keys)
    return d.select(*keys, "frame_idx", _labels()).filter("_p IS NOT NULL").select(*keys, "frame_idx", "label", "_p.*")


def carry(players: DataFrame, frames: DataFrame, keys: Sequence[str] = KEY, size: int | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Every frame gets both labels; a missing player keeps the last seen row (``carried``). ``players`` come from ``by_frame``; columns ``keep`` of the frames stay."""
    d = frames.select(*keys, "frame_idx", *keep).join(players, [*keys, "frame_idx"], "left")
    d = d.select(*keys, "frame_idx", *keep, _labels()).withColumn("_here", F.col("_p").isNotNull())
    d = scan(d, [*keys, "label"], ["frame_idx"], size=size, _q=Agg("last", "upto", F.col("_p")))
    return d.filter(F.col("_q").isNotNull()).select(*keys, "frame_idx", "label", *keep, "_q.*", (~F.col("_here")).alias("carried"))


def nearest(rows: DataFrame, players: DataFrame, x: str, y: str, radius: int = K.SEARCH_RADIUS,
            keys: Sequence[str] = KEY) -> DataFrame:
    """Add ``near_label``/``near_dist``: closest player within ``radius`` frames (earlier frame, then A, wins ties)."""
    at = rows.select(*keys, F.col("frame_idx").alias("_f"), F.col(x).alias("_x"), F.col(y).alias("_y")).distinct()
    look = at.select("*", F.explode(F.sequence(F.col("_f") - radius, F.col("_f") + radius)).alias("frame_idx"))
    p = players.filter(F.col("foot_x").isNotNull()).select(*keys, "frame_idx", "label", "foot_x", "foot_y")
    dist = F.hypot(F.col("_x") - F.col("foot_x"), F.col("_y") - F.col("foot_y"))
    best = (look.join(p, [*keys, "frame_idx"]).withColumn("_d", dist)
            .groupBy(*keys, "_f").agg(F.min(F.struct("_d", "frame_idx", "label")).alias("_b"))
            .select(*keys, F.col("_f").alias("frame_idx"), F.col("_b.label").alias("near_label"), F.col("_b._d").alias("near_dist")))
    return rows.join(best, [*keys, "frame_idx"], "left")
