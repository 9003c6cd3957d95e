"""Column -> Column building blocks: court geometry, labels, scores and formatting."""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from rallyframe import constants as K

ColumnLike = Column | str


def _c(x: ColumnLike) -> Column:
    return F.col(x) if isinstance(x, str) else x


def when_chain(pairs: Sequence[tuple[Column, object]], default: object = None) -> Column:
    """First matching (condition, value) pair."""
    out = None
    for cond, val in pairs:
        v = val if isinstance(val, Column) else F.lit(val)
        out = F.when(cond, v) if out is None else out.when(cond, v)
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


def round_up(x: ColumnLike, digits: int) -> Column:
    """Half-up rounding of means and shares of rounded values, which often lie halfway: the order of a sum does not decide them."""
    return F.round(_c(x) + K.TIE, digits)


# --- court geometry -------------------------------------------------------------------------

def outside_distance(x: ColumnLike, y: ColumnLike) -> Column:
    """Distance from a position to the singles box, 0 inside."""
    x, y, zero = _c(x), _c(y), F.lit(0.0)
    dx = F.greatest(F.lit(float(K.SINGLES_LEFT)) - x, zero, x - F.lit(float(K.SINGLES_RIGHT)))
    dy = F.greatest(F.lit(float(K.FAR_BASELINE)) - y, zero, y - F.lit(float(K.NEAR_BASELINE)))
    return F.hypot(dx, dy)


def in_out(x: ColumnLike, y: ColumnLike, margin: float = K.LINE_MARGIN) -> Column:
    x, y = _c(x), _c(y)
    edge = F.least(x - K.SINGLES_LEFT, K.SINGLES_RIGHT - x, y - K.FAR_BASELINE, K.NEAR_BASELINE - y)
    return when_chain([
        (x.isNull() | y.isNull(), None),
        ((edge >= 0) & (edge <= margin), "line"),
        (edge >= 0, "in"),
        (outside_distance(x, y) <= margin, "line")], "out")


def serve_zone(x: ColumnLike, y: ColumnLike) -> Column:
    x, y = _c(x), _c(y)
    return when_chain([(x.between(x0, x1) & y.between(y0, y1), name)
                       for name, (x0, y0, x1, y1) in K.SERVICE_BOXES.items()])


def serve_fault(x: ColumnLike, y: ColumnLike, target_side: ColumnLike) -> Column:
    x, y, far = _c(x), _c(y), _c(target_side) == "far"
    wide = ~x.between(K.SINGLES_LEFT, K.SINGLES_RIGHT)
    return when_chain([
        (x.isNull() | y.isNull(), None),
        (far & (y < K.FAR_SERVICE), "long"), (far & (y > K.NET_Y), "net"),
        (~far & (y > K.NEAR_SERVICE), "long"), (~far & (y < K.NET_Y), "net"),
        (wide, "wide")], "long")


def court_side(y: ColumnLike) -> Column:
    y = _c(y)
    return F.when(y > K.NET_Y, "near").when(y.isNotNull(), "far")


def inside_court(x: ColumnLike, y: ColumnLike, margin: float = K.COURT_MARGIN) -> Column:
    x, y = _c(x), _c(y)
    ok = (x.between(K.DOUBLES_LEFT - margin, K.DOUBLES_RIGHT + margin)
          & y.between(K.FAR_BASELINE - margin, K.NEAR_BASELINE + margin))
    return F.coalesce(ok, F.lit(False))


def foot_point(x1: ColumnLike, x2: ColumnLike, y2: ColumnLike) -> tuple[Column, Column]:
    return (_c(x1) + _c(x2)) / 2, _c(y2)


def project(matrix: ColumnLike, x: ColumnLike, y: ColumnLike) -> tuple[Column, Column]:
    """Perspective map by a row-major 3x3 array (inverse: pixel to court; forward: court to pixel); null on the horizon."""
    m, x, y = _c(matrix), _c(x), _c(y)
    row = lambda r: m[3 * r] * x + m[3 * r + 1] * y + m[3 * r + 2]
    return F.try_divide(row(0), row(2)), F.try_divide(row(1), row(2))


def error_confidence(error: ColumnLike) -> Column:
    e = _c(error)
    return when_chain([(e.isNull(), 0.0), (e <= 5, 1.0), (e <= 20, 1.0 - 0.5 * (e - 5) / 15),
                       (e <= 50, 0.5 - 0.5 * (e - 20) / 30)], 0.0)


def direction_deg(dx: ColumnLike, dy: ColumnLike) -> Column:
    return F.degrees(F.atan2(_c(dy), _c(dx)))


def angle_between(a: ColumnLike, b: ColumnLike) -> Column:
    d = F.abs(_c(a) - _c(b)) % 360
    return F.when(d <= 180, d).otherwise(360 - d)


# --- shots ------------------------------------------------------------------------------------

def shot_direction(angle: ColumnLike, x: ColumnLike, side: ColumnLike) -> Column:
    a, x, near = _c(angle), _c(x), _c(side) == "near"
    ahead = F.when(near, (a > -135) & (a < -45)).otherwise((a > 45) & (a < 135))
    # left half for a near hitter, right half for a far one
    pull_half = F.when(near, x < K.CENTRE_X).otherwise(x > K.CENTRE_X)
    return when_chain([(a.isNull(), "unknown"), (~ahead & a.between(-45, 45), "middle"),
                       (ahead == pull_half, "cross_court")], "down_the_line")


def behind_baseline(y: ColumnLike, side: ColumnLike, near_y: float = K.SERVE_NEAR_Y,
                    far_y: float = K.SERVE_FAR_Y) -> Column:
    y = _c(y)
    return F.when(_c(side) == "near", y > near_y * 0.92).otherwise(y < far_y + near_y * 0.08)


def forehand_backhand(angle: ColumnLike, side: ColumnLike) -> Column:
    dx = F.cos(F.radians(_c(angle)))
    toward = F.when(_c(side) == "near", dx).otherwise(-dx)
    return when_chain([(F.abs(dx) < 0.15, "neutral"), (toward > 0, "forehand")], "backhand")


def class_probabilities(main: ColumnLike, confidence: ColumnLike) -> Column:
    """Map of class -> probability: the main class keeps its confidence, the rest share evenly."""
    main, conf = _c(main), _c(confidence).cast("double")
    rest = (F.lit(1.0) - conf) / (len(K.SHOT_CLASSES) - 1)
    pairs = [c for k in K.SHOT_CLASSES for c in (F.lit(k), F.when(main == k, conf).otherwise(rest))]
    return F.create_map(*pairs)


def bounce_score(before: ColumnLike, at: ColumnLike, accel: ColumnLike) -> Column:
    before, at, accel = _c(before), _c(at), _c(accel)
    drop = F.when((before > 0) & at.isNotNull(), F.least(1 - at / before, F.lit(0.5)) * 0.4)
    brake = F.when(accel < -20, F.least(F.abs(accel) / 500, F.lit(0.3)))
    return F.least(F.lit(0.3) + F.coalesce(drop, F.lit(0.0)) + F.coalesce(brake, F.lit(0.0)), F.lit(1.0))


def hit_score(angle: ColumnLike, before: ColumnLike, after: ColumnLike) -> Column:
    angle, before, after = _c(angle), _c(before), _c(after)
    boost = F.when(after.isNull(), 0.0).when(before > 0.01, F.least(after / before / 3, F.lit(0.3))) \
        .otherwise(F.least(after / 50, F.lit(0.2)))
    return F.least(F.least(angle / 180, F.lit(1.0)) * 0.5 + boost, F.lit(1.0))


def fuse_classifiers(pose_type: ColumnLike, pose_conf: ColumnLike, path_type: ColumnLike,
                     path_conf: ColumnLike, floor: float = 0.6) -> Column:
    """Struct(shot_type, confidence, source): the pose result when sure and not neutral."""
    use = F.coalesce((_c(pose_conf) >= floor) & (_c(pose_type) != "neutral"), F.lit(False))
    pick = lambda p, t: F.when(use, _c(p)).otherwise(_c(t))
    return F.struct(pick(pose_type, path_type).alias("shot_type"), pick(pose_conf, path_conf).alias("confidence"),
                    F.when(use, "pose").otherwise("trajectory").alias("source"))


def pose_shot(kps: ColumnLike) -> Column:
    """Struct(shot_type, confidence) from 17 keypoints of struct(y, x, conf) in box coordinates."""
    k = _c(kps)
    p = lambda i: k[i]
    has_l = (p(5).conf > 0.1) & (p(9).conf > 0.1)
    has_r = (p(6).conf > 0.1) & (p(10).conf > 0.1)
    torso = F.greatest(F.abs((p(11).y + p(12).y) / 2 - (p(5).y + p(6).y) / 2), F.lit(0.05))
    lift = F.greatest(F.when(has_l, (p(5).y - p(9).y) / torso).otherwise(-99.0),
                      F.when(has_r, (p(6).y - p(10).y) / torso).otherwise(-99.0))
    lat_l = F.when(has_l, F.abs(p(9).x - p(5).x) / torso).otherwise(0.0)
    lat_r = F.when(has_r, F.abs(p(10).x - p(6).x) / torso).otherwise(0.0)
    mid = (p(5).x + p(6).x) / 2
    right = lat_r > lat_l
    swing = F.when(right, F.when(p(10).x < mid, "backhand").otherwise("forehand")) \
        .otherwise(F.when(p(9).x > mid, "forehand").otherwise("backhand"))
    reach = F.greatest(lat_l, lat_r)
    serve_conf = F.least(F.lit(0.8), 0.4 + lift * 0.2)
    swing_conf = F.least(F.lit(0.7), 0.35 + reach * 0.15)
    return F.struct(
        when_chain([(~has_l & ~has_r, "neutral"), (lift > 0.6, "serve"), (reach > 0.15, swing)],
                   "neutral").alias("shot_type"),
        when_chain([(~has_l & ~has_r, 0.3), (lift > 0.6, serve_conf), (reach > 0.3, swing_conf),
                    (reach > 0.15, 0.35)], 0.4).alias("confidence"))


def pose_side_shot(kps: ColumnLike) -> Column:
    """Struct(shot_type, confidence) from the better visible arm; keypoints in crop pixels."""
    k = _c(kps)
    vis_r = F.least(k[6].conf, k[8].conf, k[10].conf)
    vis_l = F.least(k[5].conf, k[7].conf, k[9].conf)
    vis, right = F.greatest(vis_r, vis_l), vis_r >= vis_l
    arm = lambda r, l, f: F.when(right, k[r][f]).otherwise(k[l][f])
    up = arm(10, 9, "y") < arm(6, 5, "y") * 0.9
    fore = arm(10, 9, "x") > arm(6, 5, "x")
    clear = vis >= 0.7
    return F.struct(
        when_chain([(vis < 0.5, "neutral"), (up, "serve"), (fore, "forehand")], "backhand").alias("shot_type"),
        when_chain([(vis < 0.5, 0.2), (up & clear, 0.85), (up, 0.7), (clear, 0.78)], 0.65).alias("confidence"))


def pose_features(kps: ColumnLike, min_conf: float = 0.1) -> Column:
    """26 values: (y, x) of the first 13 keypoints, zeros for unsure ones."""
    sure = lambda q: F.when(q.conf > min_conf, F.array(q.y, q.x)).otherwise(F.array(F.lit(0.0), F.lit(0.0)))
    return F.flatten(F.transform(F.slice(_c(kps), 1, 13), sure))


# --- buckets and labels -----------------------------------------------------------------------

def rally_bucket(hits: ColumnLike, zero: str = "1-3") -> Column:
    """Rally length class; ``zero`` is the class of a rally without hits ("10+" in one older report)."""
    h = _c(hits)
    return when_chain([(h <= 0, zero), (h <= 3, "1-3"), (h <= 6, "4-6"), (h <= 9, "7-9")], "10+")


def speed_bucket(kmh: ColumnLike) -> Column:
    v = _c(kmh)
    return when_chain([(v.isNull(), None), (v < 50, "0-50"), (v < 100, "50-100"), (v < 150, "100-150"),
                       (v < 200, "150-200")], "200+")


def movement_zone(y: ColumnLike) -> Column:
    y = _c(y)
    return when_chain([(y.isNull(), None), (F.abs(y - K.NET_Y) <= 200, "net"),
                       ((y <= K.FAR_SERVICE) | (y >= K.NEAR_SERVICE), "baseline")], "mid")


def safe_round(v: ColumnLike, decimals: int = 2) -> Column:
    v = _c(v).cast("double")
    bad = v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    return F.when(~bad, F.round(v, decimals))


def percent(part: ColumnLike, whole: ColumnLike) -> Column:
    """100 * part / whole, 0.0 when there is nothing to divide by."""
    return F.coalesce(F.try_divide(_c(part) * F.lit(100.0), _c(whole)), F.lit(0.0))


def frame_seconds(frame: ColumnLike, fps: ColumnLike, start: float = 0.0) -> Column:
    return F.round(F.lit(float(start)) + _c(frame) / _c(fps), 3)


def infer_fps(n: ColumnLike, first: ColumnLike, last: ColumnLike) -> Column:
    span = _c(last) - _c(first)
    return F.when((_c(n) >= 2) & (span > 0), (_c(n) - 1) / span)


def infer_duration(seg_start: ColumnLike, seg_end: ColumnLike, stats: ColumnLike, first: ColumnLike,
                   last: ColumnLike, n: ColumnLike, fps: ColumnLike) -> Column:
    s, e, f, l = _c(seg_start), _c(seg_end), _c(first), _c(last)
    return F.coalesce(F.when(e > s, e - s), _c(stats).cast("double"), F.when(l >= f, l - f),
                      F.when((_c(n) > 0) & (_c(fps) != 0), _c(n) / _c(fps)))


def fps_needs_change(fps: ColumnLike, target: float = 30.0, tolerance: float = 1.0) -> Column:
    return F.abs(_c(fps) - target) > tolerance


def clip_bounds(start: ColumnLike, end: ColumnLike, lead: float = 1.0, tail: float = 0.2):
    """(clip_start, clip_end, duration) columns around a point."""
    s = F.greatest(F.lit(0.0), _c(start) - lead)
    e = _c(end) + tail
    return s, e, e - s


def confidence_tier(pct: ColumnLike) -> Column:
    p = _c(pct)
    return when_chain([(p >= 70, "high"), (p >= 40, "mid")], "low")


def coverage_warning(value: ColumnLike, warn_below: float) -> Column:
    return _c(value) < warn_below


def hamming(a: Sequence[ColumnLike], b: Sequence[ColumnLike], unreadable: int = 999) -> Column:
    """Differing bits over matching integer words; ``unreadable`` when a word is missing."""
    bits = [F.bit_count(_c(x).bitwiseXOR(_c(y))) for x, y in zip(a, b, strict=True)]
    return F.coalesce(reduce(lambda p, q: p + q, bits), F.lit(unreadable))


def ordinal(n: ColumnLike) -> Column:
    n = _c(n)
    teen = (n % 100).between(10, 13)
    suffix = when_chain([(teen, "th"), (n % 10 == 1, "st"), (n % 10 == 2, "nd"), (n % 10 == 3, "rd")], "th")
    return F.concat(n.cast("string"), suffix)


def spaced(label: ColumnLike) -> Column:
    return F.replace(_c(label), F.lit("_"), F.lit(" "))


def ascii_clean(text: ColumnLike) -> Column:
    """Plain ASCII text: typographic marks replaced, the rest dropped, runs of space collapsed."""
    # Replacements applied in this order.
    marks = [("[‘’‚]", "'"), ("[“”„]", '"'), ("[–—−]", "-"),
             ("…", "..."), ("[•·]", "-"), ("[^\\x20-\\x7E\\n\\r\\t]", ""), ("\\s{2,}", " ")]
    return F.trim(reduce(lambda c, m: F.regexp_replace(c, m[0], m[1]), marks, _c(text)))


def minutes_seconds(sec: ColumnLike) -> Column:
    s = _c(sec)
    return F.format_string("%d:%02d", F.floor(s / 60), F.round(s % 60).cast("int"))


def outcome_label(reason: ColumnLike) -> Column:
    r = _c(reason)
    return when_chain([(r == "OUT", "Error"), (r == "NET", "Net"), (r == "WINNER", "Winner"),
                       (r == "DOUBLE_BOUNCE", "Won")], "Tracking lost")


def player_name(label: ColumnLike) -> Column:
    return F.when(_c(label) == "player_a", "Player A").otherwise("Player B")


def opponent(label: ColumnLike) -> Column:
    return F.when(_c(label) == "player_a", "player_b").otherwise("player_a")
