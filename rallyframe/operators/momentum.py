"""Ordered walks over the points of a match: momentum, score, streaks, repeats."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rallyframe.functions import scalars as S
from rallyframe.operators.greedy import debounce, runs
from rallyframe.operators.scan import Agg, bounded, row_numbers, scan

KEY = ["match_id"]
ORDER = ["point_idx"]


def rolling_momentum(points: DataFrame, window: int = 3, size: int | None = None) -> DataFrame:
    """Points won by A and by B among the last ``window`` points."""
    d = row_numbers(points, KEY, ORDER, "_no", size=size)
    def local(s, w):
        last = w.rowsBetween(1 - window, 0)
        a = F.sum((F.col("winner") == "player_a").cast("bigint")).over(last)
        return s.withColumn("a_momentum", a).withColumn("b_momentum", F.count(F.lit(1)).over(last) - F.col("a_momentum"))
    return bounded(d, KEY, "_no", window - 1, 0, local, size).drop("_no")


def decaying_momentum(points: DataFrame, size: int | None = None) -> DataFrame:
    """A counter per player: +1 for a won point, -1 but not below zero for a lost one.

    Closed form: the walk minus its running minimum below zero.
    """
    step = F.when(F.col("winner") == "player_a", 1).otherwise(-1)
    d = scan(points, KEY, ORDER, size=size, _s=Agg("sum", "upto", step))
    d = scan(d, KEY, ORDER, size=size, _lo=Agg("min", "upto", F.col("_s")), _hi=Agg("max", "upto", F.col("_s")))
    zero = F.lit(0)
    return (d.withColumn("a_momentum", F.col("_s") - F.least(zero, F.col("_lo")))
            .withColumn("b_momentum", F.greatest(zero, F.col("_hi")) - F.col("_s")).drop("_s", "_lo", "_hi"))


def running_score(points: DataFrame, size: int | None = None) -> DataFrame:
    """+1 for A, -1 for B; without a winner an out ball counts -1 and a rally over 6 hits +1."""
    step = S.when_chain([(F.col("winner") == "player_a", 1), (F.col("winner") == "player_b", -1),
                         (F.col("end_reason") == "OUT", -1), (F.col("rally_hit_count") > 6, 1)], 0)
    return scan(points, KEY, ORDER, size=size, score=Agg("sum", "upto", step))


def streaks(points: DataFrame, min_length: int = 3, size: int | None = None) -> DataFrame:
    """Maximal runs of points with one winner; ``final`` marks the run that ends the match."""
    d = row_numbers(points, KEY, ORDER, "_no", size=size)
    d = bounded(d, KEY, "_no", 1, 0, lambda s, w: s.withColumn(
        "_start", F.when(~F.coalesce(F.lag("winner").over(w) == F.col("winner"), F.lit(False)), F.col("_no"))), size, keep_chunk=True)
    d = scan(d, KEY, ["_no"], size=size, _run=Agg("last", "upto", F.col("_start")), _n=Agg("count", "all", F.lit(1)))
    g = d.groupBy("match_id", "_run").agg(
        F.first("winner").alias("winner"), F.count(F.lit(1)).alias("length"), F.min_by("start_sec", "_no").alias("start_sec"),
        F.max_by("end_sec", "_no").alias("end_sec"), (F.max("_no") == F.max("_n")).alias("final"))
    return g.filter(F.col("length") >= min_length).select("match_id", "winner", "length", "start_sec", "end_sec", "final")


def repeated_errors(points: DataFrame, size: int | None = None) -> DataFrame:
    """How often the same player made the same kind of error before; text from the second time on.

    Needs the last shot columns of ``stats.with_last_shot``.
    """
    e = points.filter(F.col("end_reason").isin("OUT", "NET") & F.col("last_owner").isNotNull())
    e = e.withColumn("_t", F.coalesce("last_type", F.lit(""))).withColumn("_d", F.coalesce("last_direction", F.lit("")))
    d = row_numbers(e, ["match_id", "last_owner", "_t", "_d"], ORDER, "nth", size=size)
    text = F.concat(F.lit("This is the "), S.ordinal("nth"), F.lit(" "), F.col("_t"), F.lit(" "), F.col("_d"),
                    F.lit(" error by "), S.player_name("last_owner"), F.lit("."))
    return d.withColumn("pattern_context", F.when(F.col("nth") > 1, text).otherwise("")).drop("_t", "_d")


def repeated_direction(point_shots: DataFrame, last: int = 3) -> DataFrame:
    """Points whose last hitter played the last three shots of their own in one known direction.

    ``point_shots`` are shots with ``point_idx``. Only the last three rows of a group survive the
    row-number filter, which Spark applies before the shuffle.
    """
    g = ["match_id", "point_idx"]
    hitter = point_shots.groupBy(*g).agg(F.max_by("owner", "frame_idx").alias("owner"), F.count(F.lit(1)).alias("_all"))
    own = point_shots.join(hitter, [*g, "owner"])
    w = Window.partitionBy(*g, "owner").orderBy(F.desc("frame_idx"))
    tail = own.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= last)
    one = tail.groupBy(*g, "owner").agg(F.count(F.lit(1)).alias("_n"), F.min("direction").alias("direction"),
                                        F.max("direction").alias("_hi"), F.count("direction").alias("_k"))
    ok = one.filter((F.col("_n") == last) & (F.col("_k") == last) & (F.col("direction") == F.col("_hi")) & (F.col("direction") != "unknown"))
    counts = own.groupBy(*g, "owner").agg(F.count(F.lit(1)).alias("times"))
    return ok.select(*g, "owner", "direction").join(counts, [*g, "owner"])


def trailing_positions(frames: DataFrame, x: str, y: str, n: int = 10, keys: Sequence[str] = KEY, size: int | None = None) -> DataFrame:
    """Last ``n`` positions of the current unbroken stretch (at most ``n`` array entries)."""
    def local(d, w):
        back = w.rowsBetween(1 - n, 0)
        miss = F.last(F.when(F.col(x).isNull(), F.col("frame_idx")), True).over(back)
        pts = F.collect_list(F.when(F.col(x).isNotNull(), F.struct("frame_idx", F.col(x).alias("x"), F.col(y).alias("y")))).over(back)
        d = d.select("*", pts.alias("_p"), F.coalesce(miss, F.lit(-1)).alias("_m"))
        return d.withColumn("trail", F.filter("_p", lambda p: p.frame_idx > F.col("_m"))).drop("_p", "_m")
    return bounded(frames, keys, "frame_idx", n - 1, 0, local, size)


def pose_sequences(shots: DataFrame, poses: DataFrame, half: int = 15, min_frames: int = 3) -> DataFrame:
    """30 x 26 pose features around each shot of its owner, zero-filled; ``usable`` with enough frames."""
    look = shots.select("match_id", F.col("frame_idx").alias("_f"), F.col("owner").alias("player"),
                        F.explode(F.sequence(F.col("frame_idx") - half, F.col("frame_idx") + half - 1)).alias("frame_idx"))
    f = poses.select("match_id", "frame_idx", "player", S.pose_features("kps").alias("v"))
    zero = F.array_repeat(F.lit(0.0), 26)
    d = look.join(f, ["match_id", "frame_idx", "player"], "left").withColumn("v", F.coalesce("v", zero))
    used = F.exists("v", lambda q: q != 0)
    g = d.groupBy("match_id", F.col("_f").alias("frame_idx"), F.col("player").alias("owner")).agg(
        F.sort_array(F.collect_list(F.struct("frame_idx", "v"))).alias("_s"), F.count_if(used).alias("pose_frames"))
    return g.select("match_id", "frame_idx", "owner", "pose_frames", (F.col("pose_frames") >= min_frames).alias("usable"),
                    F.transform("_s", lambda s: s.v).alias("sequence"))


def live_frames(frames: DataFrame, video_fps: float, fps: float, threshold: float = 0.02, pixels: str = "gray",
                keys: Sequence[str] = KEY, size: int | None = None) -> DataFrame:
    """Every k-th frame whose picture changed enough since the previous sampled one; the first stays."""
    k = max(1, round(video_fps / fps))
    s = frames.filter(F.col("frame_idx") % k == 0).withColumn("_no", F.expr(f"frame_idx div {k}"))
    def local(d, w):
        diff = F.aggregate(F.zip_with(pixels, F.lag(pixels).over(w), lambda a, b: F.abs(a - b).cast("double")), F.lit(0.0), lambda a, b: a + b)
        return d.withColumn("delta", diff / F.size(pixels) / 255)
    return bounded(s, keys, "_no", 1, 0, local, size).filter(F.col("delta").isNull() | (F.col("delta") >= threshold)).drop("_no")


def visible_runs(frames: DataFrame, seen: str, step: int, min_run: int = 8, keys: Sequence[str] = KEY, size: int | None = None) -> DataFrame:
    """Runs of sampled frames with a ball, closed by a sampled frame without one."""
    s = frames.filter(F.col("frame_idx") % step == 0).withColumn("_no", F.expr(f"frame_idx div {step}"))
    s = s.select(*keys, "_no", F.expr(seen).alias("_seen"))
    r = runs(s, keys, "_no", "_seen", size).filter(F.col("length") >= min_run)
    closed = s.filter(~F.col("_seen")).select(*keys, (F.col("_no") - 1).alias("run_end"))
    r = r.join(closed, [*keys, "run_end"], "left_semi")
    return r.select(*keys, (F.col("run_start") * step).alias("frame_idx"), "length")


def cluster_events(starts: DataFrame, gap_frames: int, keys: Sequence[str] = KEY, **kw) -> DataFrame:
    """Greedy clustering: keep a start more than ``gap_frames`` after the last kept one."""
    return debounce(starts, keys, "frame_idx", gap_frames + 1, **kw)


def first_k(df: DataFrame, k: int, keys: Sequence[str] = KEY, order: str = "frame_idx") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def temporal_split(frames: DataFrame, ratio: float = 0.75, keys: Sequence[str] = KEY, size: int | None = None) -> DataFrame:
    """First part of every match is train, the rest test."""
    d = scan(frames, keys, ["frame_idx"], size=size, _no=Agg("count", "upto", F.lit(1)), _n=Agg("count", "all", F.lit(1)))
    return d.withColumn("part", F.when(F.col("_no") <= F.floor(F.col("_n") * ratio), "train").otherwise("test")).drop("_no", "_n")


def key_shots(point_shots: DataFrame, all_up_to: int = 8, head: int = 2, tail: int = 4, size: int | None = None) -> DataFrame:
    """All shots of a short point, else the first two and the last four, in order."""
    d = scan(point_shots, ["match_id", "point_idx"], ["frame_idx"], size=size,
             shot_no=Agg("count", "upto", F.lit(1)), shots_in_point=Agg("count", "all", F.lit(1)))
    return d.filter((F.col("shots_in_point") <= all_up_to) | (F.col("shot_no") <= head) | (F.col("shot_no") > F.col("shots_in_point") - tail))


def reindex(points: DataFrame, order: Sequence[str] = ("segment_idx", "point_idx"), size: int | None = None) -> DataFrame:
    """Number points 0..n-1 over the merged segments of a match."""
    d = row_numbers(points, KEY, list(order), "_no", chunk=F.col(order[0]), size=size)
    return d.withColumn("merged_idx", F.col("_no") - 1).drop("_no")


def weakness_evidence(weaknesses: DataFrame, points: DataFrame, per: int = 2, top: int = 6) -> DataFrame:
    """Bad points 2i and 2i+1 of the first six go with weakness i of each player."""
    bad = first_k(points.filter(F.col("end_reason").isin("OUT", "BALL_LOST")).select("match_id", "point_idx"), top, order="point_idx")
    bad = bad.select("match_id", "point_idx", F.expr(f"(rank - 1) div {per} + 1").cast("int").alias("weakness_no"))
    return weaknesses.join(bad, ["match_id", "weakness_no"])
