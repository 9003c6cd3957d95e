"""Ball track: outliers, sub-tracks, interpolation, court projection, speed and smoothing."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rallyframe import constants as K
from rallyframe.functions import scalars as S
from rallyframe.operators.scan import Agg, bounded, decayed_sum, row_numbers, scan

KEY = ["match_id"]


def _distance(w, x, y):
    dx, dy = F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w)
    return F.coalesce(F.hypot(dx, dy), F.lit(-1.0))


def frame_distances(df: DataFrame, x: str = "ball_px", y: str = "ball_py", keys: Sequence[str] = KEY,
                    size: int | None = None) -> DataFrame:
    """Add ``dist``: pixels moved since the previous frame, -1 when unknown."""
    return bounded(df, keys, "frame_idx", 1, 0, lambda d, w: d.withColumn("dist", _distance(w, x, y)), size)


def _without_outliers(d, w, x, y, max_dist):
    d = d.withColumn("_d", _distance(w, x, y))
    d = d.select("*", F.lag("_d").over(w).alias("_dp"), F.lead("_d").over(w).alias("_dn"),
                 F.lead("_d", 2).over(w).alias("_dn2"))
    far = lambda c: F.col(c) > max_dist
    lost = lambda c: F.col(c) == -1
    jump_here = far("_d") & (far("_dn") | lost("_dn"))
    jump_next = lost("_d") & far("_dn") & ~(far("_dn2") | lost("_dn2"))
    gone = F.coalesce(jump_here, F.lit(False)) | F.coalesce(jump_next, F.lit(False))
    return (d.withColumn(x, F.when(~gone, F.col(x))).withColumn(y, F.when(~gone, F.col(y)))
            .drop("_d", "_dp", "_dn", "_dn2"))


def remove_outliers(df: DataFrame, x: str = "ball_px", y: str = "ball_py", max_dist: float = K.OUTLIER_PX,
                    keys: Sequence[str] = KEY, size: int | None = None) -> DataFrame:
    """Blank positions that jump away and do not settle, judged on the raw distances."""
    return bounded(df, keys, "frame_idx", 2, 3, lambda d, w: _without_outliers(d, w, x, y, max_dist), size)


def sub_tracks(df: DataFrame, x: str = "ball_px", y: str = "ball_py", max_gap: int = K.MAX_GAP,
               max_px: float = K.MAX_GAP_PX, min_len: int = K.MIN_SUBTRACK, max_dist: float | None = K.OUTLIER_PX,
               keys: Sequence[str] = KEY, size: int | None = None) -> DataFrame:
    """Add sub-track bounds [track_start, track_end) and the nearest seen positions around each frame.

    ``track_start`` is null where a frame belongs to no sub-track longer than ``min_len``. Whether a
    missing stretch splits the track is decidable within ``max_gap`` frames, so only the positions of
    the splits are carried along the match.
    """
    def local(d, w):
        if max_dist is not None:
            d = _without_outliers(d, w, x, y, max_dist)
        seen = F.col(x).isNotNull()
        pos = F.when(seen, F.struct("frame_idx", F.col(x).alias("x"), F.col(y).alias("y")))
        d = d.select("*", F.last(pos, True).over(w.rowsBetween(-max_gap, -1)).alias("_p"),
                     F.first(pos, True).over(w.rowsBetween(1, max_gap)).alias("_q"))
        # gap between a seen frame and the nearest seen frame at most max_gap frames away
        def splits(other, sign):
            length = sign * (F.col("frame_idx") - F.col(f"{other}.frame_idx")) - 1
            dist = F.hypot(F.col(x) - F.col(f"{other}.x"), F.col(y) - F.col(f"{other}.y"))
            return F.when(F.col(other).isNull(), True).when(length == 0, False).otherwise(
                (length >= max_gap) | (dist / length > max_px))
        d = d.select("*", (seen & splits("_p", 1)).alias("_open"), (seen & splits("_q", -1)).alias("_shut"))
        d = d.select("*", F.lead("_open").over(w).alias("_next_open"), F.lag("_shut").over(w).alias("_prev_shut"))
        return d.withColumn("_start", F.when(~seen & F.col("_next_open"), F.col("frame_idx"))) \
                .withColumn("_end", F.when(~seen & F.col("_prev_shut"), F.col("frame_idx"))) \
                .withColumn("_pos", F.when(seen, F.struct(
                    "frame_idx", F.col(x).alias("x"), F.col(y).alias("y"), (~F.col("_open")).alias("back"),
                    (~F.col("_shut")).alias("ahead"))))
    d = bounded(df, keys, "frame_idx", 2 * max_gap + 4, 2 * max_gap + 4, local, size, keep_chunk=True)
    seen_at = F.when(F.col("_pos").isNotNull(), F.col("frame_idx"))
    d = scan(d, keys, ["frame_idx"], size=size,
             _ls=Agg("last", "upto", F.col("_start")), _le=Agg("last", "upto", F.col("_end")),
             _ne=Agg("first", "after", F.col("_end")), _first=Agg("min", "all", seen_at),
             _last=Agg("max", "all", seen_at), _n=Agg("max", "all", F.col("frame_idx") + 1),
             prev_seen=Agg("last", "upto", F.col("_pos")), next_seen=Agg("first", "from", F.col("_pos")))
    # leading and trailing missing stretches do not split
    start = F.when(F.col("_ls") >= F.col("_first"), F.col("_ls")).otherwise(F.lit(0))
    end = F.when(F.col("_ne") <= F.col("_last"), F.col("_ne")).otherwise(F.col("_n"))
    in_gap = F.coalesce((F.col("_le") <= F.col("_last")) & (F.col("_le") > start), F.lit(False))
    d = d.withColumn("_s", start).withColumn("_e", end)
    keep = ~in_gap & (F.col("_e") - F.col("_s") > min_len)
    return (d.withColumn("track_start", F.when(keep, F.col("_s"))).withColumn("track_end", F.when(keep, F.col("_e")))
            .drop("_p", "_q", "_open", "_shut", "_next_open", "_prev_shut", "_start", "_end", "_pos",
                  "_ls", "_le", "_ne", "_first", "_last", "_n", "_s", "_e"))


def clean_track(df: DataFrame, x: str = "ball_px", y: str = "ball_py", keys: Sequence[str] = KEY,
                size: int | None = None, **kw) -> DataFrame:
    """Outliers blanked, gaps inside sub-tracks filled linearly, flat at sub-track ends."""
    cols = df.columns
    d = sub_tracks(df, x, y, keys=keys, size=size, **kw)
    p, q, f = F.col("prev_seen"), F.col("next_seen"), F.col("frame_idx")
    has_p = F.coalesce(p.frame_idx >= F.col("track_start"), F.lit(False))
    has_q = F.coalesce(q.frame_idx < F.col("track_end"), F.lit(False))
    def fill(c):
        a, b = p[c], q[c]
        line = a + (b - a) * ((f - p.frame_idx) / (q.frame_idx - p.frame_idx))
        return F.when(has_p & has_q, line).when(has_q & q.ahead, b).when(has_p & p.back, a)
    col = lambda name, c: F.coalesce(F.col(name), F.when(F.col("track_start").isNotNull(), fill(c))).alias(name)
    return d.select(*[col(c, "x") if c == x else col(c, "y") if c == y else F.col(c) for c in cols])


def project_track(track: DataFrame, homography: DataFrame, x: str = "ball_px", y: str = "ball_py",
                  keys: Sequence[str] = KEY) -> DataFrame:
    """Add ``cx``/``cy`` where the frame has a reliable calibration."""
    h = homography.select(*keys, "frame_idx", F.when(F.col("reliable"), F.col("inverse")).alias("_inv"))
    d = track.join(h, [*keys, "frame_idx"], "left")
    cx, cy = S.project("_inv", x, y)
    return d.withColumn("cx", cx).withColumn("cy", cy).drop("_inv")


def ball_physics(df: DataFrame, x: str = "cx", y: str = "cy", fps: str = "fps", scale: float = K.METRES_PER_UNIT,
                 cap: float = K.SPEED_CAP, keys: Sequence[str] = KEY, size: int | None = None) -> DataFrame:
    """Add ``speed`` (m/s, null above the cap) and ``accel`` (m/s2), both to 2 decimals."""
    def local(d, w):
        v = F.hypot((F.col(x) - F.lag(x).over(w)) * scale, (F.col(y) - F.lag(y).over(w)) * scale) * F.col(fps)
        d = d.withColumn("_raw", v).withColumn("_v", F.when(F.col("_raw") <= cap, F.col("_raw")))
        d = d.withColumn("_a", (F.col("_v") - F.lag("_v").over(w)) * F.col(fps))
        return d.withColumn("speed", F.round("_v", 2)).withColumn("accel", F.round("_a", 2)).drop("_raw", "_v", "_a")
    return bounded(df, keys, "frame_idx", 3, 0, local, size)


def smooth(df: DataFrame, value: str, name: str, half: int = 1, keys: Sequence[str] = KEY,
           size: int | None = None) -> DataFrame:
    """Centred moving average over 2 * half + 1 frames that skips missing values."""
    return bounded(df, keys, "frame_idx", half, half,
                   lambda d, w: d.withColumn(name, F.avg(value).over(w.rowsBetween(-half, half))), size)


def side_averages(df: DataFrame, value: str, window: int = 3, keys: Sequence[str] = KEY,
                  size: int | None = None) -> DataFrame:
    """Add ``before``/``after``: means over up to ``window`` frames on either side."""
    return bounded(df, keys, "frame_idx", window, window, lambda d, w: d.select(
        "*", F.avg(value).over(w.rowsBetween(-window, -1)).alias("before"),
        F.avg(value).over(w.rowsBetween(1, window)).alias("after")), size)


def circular_mean(angle, w):
    """Mean direction in degrees over a window, null without angles."""
    r = F.radians(angle)
    n = F.count(angle).over(w)
    return F.when(n > 0, F.degrees(F.atan2(F.sum(F.sin(r)).over(w), F.sum(F.cos(r)).over(w))))


def tracking_gap(df: DataFrame, value: str = "cx", radius: int = 3, keys: Sequence[str] = KEY,
                 size: int | None = None) -> DataFrame:
    """Add ``gap``: some frame within ``radius`` has no position."""
    return bounded(df, keys, "frame_idx", radius, radius, lambda d, w: d.withColumn(
        "gap", F.max(F.col(value).isNull()).over(w.rowsBetween(-radius, radius))), size)


def ema_observed(df: DataFrame, x: str, y: str, alpha: float = K.EMA_ALPHA, keys: Sequence[str] = KEY,
                 size: int | None = None) -> DataFrame:
    """Exponential moving averages ``sx``/``sy`` over the seen frames, with their position ``obs_no``. The first
    seen position counts in full, so each average is a decayed sum over all of the history."""
    seen = row_numbers(df.filter(F.col(x).isNotNull()), keys, ["frame_idx"], "obs_no", size=size)
    share = lambda c: F.when(F.col("obs_no") == 1, F.col(c)).otherwise(F.col(c) * alpha)
    return decayed_sum(seen, keys, "obs_no", 1 - alpha, size, sx=share(x), sy=share(y))


def ema_track(df: DataFrame, x: str, y: str, alpha: float = K.EMA_ALPHA, keys: Sequence[str] = KEY,
              size: int | None = None) -> DataFrame:
    """Smoothed position of every frame (the last one is carried over missing frames), the velocity
    against the previous frame, and the number of frames seen in a row."""
    obs = ema_observed(df.select(*keys, "frame_idx", x, y), x, y, alpha, keys, size).select(*keys, "frame_idx", "sx", "sy")
    d = df.join(obs, [*keys, "frame_idx"], "left")
    here = F.when(F.col("sx").isNotNull(), F.struct("sx", "sy"))
    d = scan(d, keys, ["frame_idx"], size=size, _s=Agg("last", "upto", here), _b=Agg("last", "before", here),
             _miss=Agg("last", "upto", F.when(F.col(x).isNull(), F.col("frame_idx"))))
    return d.select(*[c for c in df.columns], F.col("_s.sx").alias("sx"), F.col("_s.sy").alias("sy"),
                    (F.col("_s.sx") - F.col("_b.sx")).alias("vx"), (F.col("_s.sy") - F.col("_b.sy")).alias("vy"),
                    (F.col("frame_idx") - F.coalesce(F.col("_miss"), F.lit(-1))).alias("stable"))
