"""Court calibration: four-point fits, best configuration, carry-forward."""
from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rallyframe import constants as K
from rallyframe.functions import scalars as S
from rallyframe.operators.scan import bounded
from rallyframe.session import ship

KEY = ["match_id"]


def configuration_points(keypoints: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Frame x configuration rows whose four keypoints are all seen.

    Each seen keypoint is expanded to the fixed list of configurations it belongs to, then the
    (frame, configuration) groups of at most four rows are counted.
    """
    uses = {kp: [(c, q.index(kp)) for c, q in K.CONFIGURATIONS.items() if kp in q] for kp in range(14)}
    entries = [F.when(F.col("kp") == kp, F.array(*[F.struct(F.lit(c).alias("conf"), F.lit(i).alias("corner")) for c, i in u]))
               for kp, u in uses.items() if u]
    seen = keypoints.filter(F.col("px").isNotNull())
    ex = seen.select(*keys, "frame_idx", "px", "py", F.explode(F.coalesce(*entries)).alias("u"))
    corner = lambda i, c: F.max(F.when(F.col("u.corner") == i, F.col(c))).alias(f"{c}{i}")
    g = ex.groupBy(*keys, "frame_idx", F.col("u.conf").alias("conf")).agg(
        F.count(F.lit(1)).alias("corners"), *[corner(i, c) for i in range(4) for c in ("px", "py")])
    return g.filter("corners = 4").drop("corners")


UNIT = 1000.0
CORNERS = np.array(list(K.CONFIGURATIONS.values()))
POINTS = len(K.COURT_KEYPOINTS)


def _area(x: np.ndarray, y: np.ndarray, i: int, j: int, k: int) -> np.ndarray:
    return (x[:, j] - x[:, i]) * (y[:, k] - y[:, i]) - (x[:, k] - x[:, i]) * (y[:, j] - y[:, i])


def _weights(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of the first three points that make the fourth their sum, up to one factor."""
    return np.stack([_area(x, y, 3, 1, 2), _area(x, y, 0, 3, 2), _area(x, y, 0, 1, 3)], axis=1)


def _fit_all(x: np.ndarray, y: np.ndarray, ref: np.ndarray) -> np.ndarray:
    """Exact four-point fits: (frames, configurations, 3, 3), NaN where a corner is missing.

    Both quadrilaterals are images of the same frame of four points (the unit vectors and their sum), so a fit is one
    3x3 product: the weighted corners seen, times the inverse of the weighted corners of the court.
    """
    out = np.full((len(x), len(CORNERS), 3, 3), np.nan)
    for i, q in enumerate(CORNERS):
        rows = np.flatnonzero(~np.isnan(x[:, q]).any(axis=1))
        u, v = x[np.ix_(rows, q)], y[np.ix_(rows, q)]
        court = _weights(ref[None, q, 0], ref[None, q, 1])[0] * np.stack([ref[q[:3], 0], ref[q[:3], 1], np.ones(3)])
        w = _weights(u, v)
        h = np.stack([u[:, :3] * w, v[:, :3] * w, w], axis=1) @ np.linalg.inv(court)
        ok = np.abs(h[:, 2, 2]) > 1e-12 * np.abs(h).max(axis=(1, 2), initial=0)
        out[rows[ok], i] = h[ok] / h[ok, 2:, 2:]
    return out


def _median_errors(x: np.ndarray, y: np.ndarray, fits: np.ndarray, ref: np.ndarray) -> np.ndarray:
    """Median distance over seen keypoints outside each configuration, NaN without any."""
    out = np.full(fits.shape[:2], np.nan)
    court, cols = np.column_stack([ref, np.ones(POINTS)]), np.arange(len(x))
    for i, q in enumerate(CORNERS):
        rest = np.setdiff1d(np.arange(POINTS), q)
        px, py, depth = (court[rest] @ fits[:, i, r].T for r in range(3))
        with np.errstate(all="ignore"):
            d = (px / depth - x[:, rest].T) ** 2 + (py / depth - y[:, rest].T) ** 2
        d[np.isnan(d)] = np.inf
        m = np.count_nonzero(np.isfinite(d), axis=0)
        for k in range(len(rest)):  # all frames are sorted at once by exchanges of neighbours
            low, high = d[k % 2:len(rest) - 1:2], d[k % 2 + 1::2]
            smaller = np.minimum(low, high)
            np.maximum(low, high, out=high)
            low[...] = smaller
        pick = lambda k: np.sqrt(d[np.maximum(k, 0), cols])
        out[:, i] = np.where(m > 0, (pick((m - 1) // 2) + pick(m // 2)) / 2, np.nan)
    return out


def _inverses(m: np.ndarray) -> np.ndarray:
    """``invert`` for all rows of a batch: the same products in the same order, NaN when singular."""
    a, b, c, d, e, f, g, h, i = m.T
    det = a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)
    adjoint = np.stack([e * i - f * h, c * h - b * i, b * f - c * e, f * g - d * i, a * i - c * g, c * d - a * f,
                        d * h - e * g, b * g - a * h, a * e - b * d], axis=1)
    return adjoint / np.where(det == 0, np.nan, det)[:, None]


def _lists(values: np.ndarray) -> pa.ListArray:
    flat = pa.array(values.ravel(), from_pandas=True)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)), flat)


def _fit_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fit every frame of a batch at once; coordinates are scaled to about one for a stable solve."""
    ref = np.array(K.COURT_KEYPOINTS, dtype=float) / UNIT
    scale = np.array([[1, 1, UNIT], [1, 1, UNIT], [1 / UNIT, 1 / UNIT, 1]])
    for b in batches:
        if not b.num_rows:
            continue
        grid = lambda c: np.column_stack([b.column(f"{c}{i}").to_numpy(zero_copy_only=False).astype(float) for i in range(POINTS)]) / UNIT
        x, y = grid("px"), grid("py")
        fits = _fit_all(x, y, ref)
        errors = _median_errors(x, y, fits, ref) * UNIT
        best = np.where(np.isnan(errors), np.inf, errors).argmin(axis=1)
        rows = np.arange(len(best))
        matrix = (fits[rows, best] * scale).reshape(-1, 9)
        kept = [n for n in b.schema.names if n[:2] not in ("px", "py")]
        yield pa.RecordBatch.from_arrays(
            [*[b.column(n) for n in kept], _lists(errors), _lists(matrix), _lists(_inverses(matrix)), pa.array(errors[rows, best], from_pandas=True)],
            names=[*kept, "errors", "matrix", "inverse", "error"])


def frame_fits(keypoints: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Per frame: seen keypoints, median error of each configuration, matrix, inverse and error of the best one.

    One shuffle brings the 14 keypoints of a frame into one row; all frames and configurations of an Arrow
    batch are solved together. The first of equally good ones wins.
    """
    ship(keypoints.sparkSession)
    at = lambda c: [F.max(F.when(F.col("kp") == i, F.col(c))).alias(f"{c}{i}") for i in range(POINTS)]
    d = keypoints.groupBy(*keys, "frame_idx").agg(F.count("px").alias("detected"), *at("px"), *at("py"))
    kept = [f for f in d.schema if f.name in (*keys, "frame_idx", "detected")]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept) + ", errors array<double>, matrix array<double>, inverse array<double>, error double"
    return d.mapInArrow(_fit_batches, schema)


def configuration_errors(keypoints: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Long form of the median errors: one row per frame and complete configuration."""
    return frame_fits(keypoints, keys).select(*keys, "frame_idx", F.posexplode("errors").alias("_pos", "error")).filter("error IS NOT NULL") \
        .select(*keys, "frame_idx", (F.col("_pos") + 1).alias("conf"), "error")


def _best(fits: DataFrame, keys: Sequence[str], *names: str) -> DataFrame:
    ok = (F.col("detected") >= K.MIN_KEYPOINTS) & F.col("error").isNotNull()
    return fits.select(*keys, "frame_idx", "detected", *[F.when(ok, F.col(n)).alias(n) for n in names])


def best_fits(keypoints: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Per frame: number of seen keypoints, and matrix and error of the best configuration."""
    return _best(frame_fits(keypoints, keys), keys, "matrix", "error")


def invert(matrix):
    """Inverse of a row-major 3x3 array as column arithmetic, null when singular."""
    m = [matrix[i] for i in range(9)]
    det = (m[0] * (m[4] * m[8] - m[5] * m[7]) - m[1] * (m[3] * m[8] - m[5] * m[6]) + m[2] * (m[3] * m[7] - m[4] * m[6]))
    adj = [m[4] * m[8] - m[5] * m[7], m[2] * m[7] - m[1] * m[8], m[1] * m[5] - m[2] * m[4],
           m[5] * m[6] - m[3] * m[8], m[0] * m[8] - m[2] * m[6], m[2] * m[3] - m[0] * m[5],
           m[3] * m[7] - m[4] * m[6], m[1] * m[6] - m[0] * m[7], m[0] * m[4] - m[1] * m[3]]
    return F.when(det != 0, F.array(*[a / det for a in adj]))


def carry_forward(fits: DataFrame, threshold: float = K.LOW_CONFIDENCE, max_carry: int = K.MAX_CARRY,
                  keys: Sequence[str] = KEY, size: int | None = None) -> DataFrame:
    """Confidence, and the last reliable matrices for up to ``max_carry`` unreliable frames."""
    d = fits.withColumn("confidence", F.when(F.col("matrix").isNotNull(), S.error_confidence("error")).otherwise(0.0))
    good = F.col("confidence") >= threshold
    def local(s, w):
        known = F.when(good, F.struct("matrix", "inverse"))
        return s.withColumn("_k", F.last(known, True).over(w.rowsBetween(-max_carry, 0)))
    d = bounded(d, keys, "frame_idx", max_carry, 0, local, size)
    held = F.col("_k").isNotNull()
    return d.select(*[c for c in d.columns if c not in ("matrix", "inverse", "_k")],
                    F.col("_k.matrix").alias("matrix"), F.col("_k.inverse").alias("inverse"),
                    held.alias("reliable"), (held & ~good).alias("carried"))


def calibrate(keypoints: DataFrame, keys: Sequence[str] = KEY, size: int | None = None) -> DataFrame:
    """Keypoints in, one calibration row per frame out."""
    fits = _best(frame_fits(keypoints, keys), keys, "matrix", "inverse", "error")
    # a singular matrix has no inverse at all, as in ``invert``
    fits = fits.withColumn("inverse", F.when(F.col("inverse")[0].isNotNull(), F.col("inverse")))
    return carry_forward(fits, keys=keys, size=size)
