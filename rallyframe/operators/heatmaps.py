"""Two-dimensional position histograms as sparse (x_bin, y_bin, n) rows."""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rallyframe import constants as K
from rallyframe.operators.scan import Agg, scan
from rallyframe.session import ship

DOUBLES_BOX = (K.DOUBLES_LEFT, K.DOUBLES_RIGHT, K.FAR_BASELINE, K.NEAR_BASELINE)


def bin_of(v: Column, lo, hi, n: int) -> Column:
    """Bin number in equal steps, the upper end belongs to the last bin, null outside."""
    lo = lo if isinstance(lo, Column) else F.lit(float(lo))
    hi = hi if isinstance(hi, Column) else F.lit(float(hi))
    b = F.least(F.floor((v - lo) / ((hi - lo) / n)), F.lit(n - 1))
    return F.when((v >= lo) & (v <= hi), b).cast("bigint")


def heatmap(df: DataFrame, x: str, y: str, nx: int, ny: int, box: Sequence[float] = DOUBLES_BOX, margin: float = 0.0,
            keys: Sequence[str] = ("match_id",)) -> DataFrame:
    x0, x1, y0, y1 = box
    d = df.select(*keys, bin_of(F.col(x), x0 - margin, x1 + margin, nx).alias("xb"), bin_of(F.col(y), y0 - margin, y1 + margin, ny).alias("yb"))
    return d.filter("xb IS NOT NULL AND yb IS NOT NULL").groupBy(*keys, "xb", "yb").agg(F.count(F.lit(1)).alias("n"))


def ball_heatmap(track: DataFrame) -> DataFrame:
    return heatmap(track, "cx", "cy", 19, 29)


def out_ball_heatmap(events: DataFrame) -> DataFrame:
    return heatmap(events.filter("event_type = 'bounce' AND in_out = 'out'"), "cx", "cy", 19, 29, margin=200)


def player_heatmaps(positions: DataFrame) -> DataFrame:
    return heatmap(positions, "foot_x", "foot_y", 14, 19, keys=("match_id", "label"))


def auto_heatmap(df: DataFrame, x: str, y: str, nx: int = 10, ny: int = 15, keys: Sequence[str] = ("match_id",),
                 order: str = "frame_idx", size: int | None = None) -> DataFrame:
    """Grid over the range of the data itself; a single value widens to one unit."""
    d = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    d = scan(d, keys, [order], size=size, x0=Agg("min", "all", F.col(x)), x1=Agg("max", "all", F.col(x)),
             y0=Agg("min", "all", F.col(y)), y1=Agg("max", "all", F.col(y)))
    pad = lambda a, b: F.when(F.col(a) == F.col(b), 0.5).otherwise(0.0)
    xb = bin_of(F.col(x), F.col("x0") - pad("x0", "x1"), F.col("x1") + pad("x0", "x1"), nx)
    yb = bin_of(F.col(y), F.col("y0") - pad("y0", "y1"), F.col("y1") + pad("y0", "y1"), ny)
    return d.groupBy(*keys, xb.alias("xb"), yb.alias("yb")).agg(F.count(F.lit(1)).alias("n"))


def speed_histogram(track: DataFrame, step: int = 10, bins: int = 24, cap: float = 200.0) -> DataFrame:
    """Counts of km/h classes 0..240 per match, empty classes included."""
    kmh = F.col("speed") * 3.6
    d = track.filter(F.col("speed") < cap).select("match_id", bin_of(kmh, 0, step * bins, bins).alias("bin"))
    full = d.select("match_id").distinct().select("match_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(bins - 1).cast("bigint"))).alias("bin"))
    return full.join(d.groupBy("match_id", "bin").agg(F.count(F.lit(1)).alias("n")), ["match_id", "bin"], "left").na.fill({"n": 0}) \
        .withColumn("from_kmh", F.col("bin") * step)


def intensity(cells: DataFrame, keys: Sequence[str] = ("match_id",)) -> DataFrame:
    """Cell share of the fullest cell of its grid (grids have a fixed number of cells)."""
    peak = F.greatest(F.max("n").over(Window.partitionBy(*keys)), F.lit(1))
    return cells.withColumn("intensity", F.col("n") / peak)


def frame_sets(frames: DataFrame, sets: int = 3) -> DataFrame:
    """All frames of a match in ``sets`` equal frame ranges, the last one taking the remainder."""
    n = frames.groupBy("match_id").agg(F.count(F.lit(1)).alias("_n"))
    d = frames.select("match_id", "frame_idx").join(n, "match_id")
    width = F.floor(F.col("_n") / sets)
    s = F.when(width > 0, F.least(F.floor(F.col("frame_idx") / width), F.lit(sets - 1))).otherwise(sets - 1)
    return d.select("match_id", "frame_idx", s.cast("bigint").alias("set_no"))


def set_density(boxes: DataFrame, frames: DataFrame, res: int = 64) -> DataFrame:
    """Player box centres per set on a res x res grid."""
    p = boxes.filter("class_id = 0").select("match_id", "frame_idx", "cx", "cy")
    d = p.join(frame_sets(frames), ["match_id", "frame_idx"])
    cell = lambda c: F.least(F.floor(F.col(c) * res), F.lit(res - 1)).cast("bigint")
    return d.groupBy("match_id", "set_no", cell("cx").alias("xb"), cell("cy").alias("yb")).agg(F.count(F.lit(1)).alias("n"))


# 7-tap Gaussian weights.
BLUR = (0.03125, 0.109375, 0.21875, 0.28125, 0.21875, 0.109375, 0.03125)


def blurred_density(cells: DataFrame, keys: Sequence[str] = ("match_id", "set_no"), res: int = 64) -> DataFrame:
    """7x7 Gaussian blur (mirrored at the edges) scaled so that the peak is 1; cells that no count reaches have no row.

    A grid holds at most res * res cells, so each is blurred as a whole: what a task sorts are counts, not their 49 images.
    """
    ship(cells.sparkSession)
    keys, last = list(keys), res - 1
    blur = np.zeros((res, res))
    for at in range(res):
        for o, w in enumerate(BLUR, -3):
            blur[at, last - abs(last - abs(at + o))] += w

    def spread(grid: pd.DataFrame) -> pd.DataFrame:
        n = np.zeros((res, res))
        n[grid["xb"], grid["yb"]] = grid["n"]
        heat = blur @ n @ blur.T
        x, y = np.nonzero(heat)
        out = pd.DataFrame({k: grid[k].iloc[0] for k in keys} | {"xb": x, "yb": y, "heat": heat[x, y]})
        out["density"] = out["heat"] / heat.max()
        return out

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cells.select(*keys).schema)
    return cells.groupBy(*keys).applyInPandas(spread, f"{kinds}, xb bigint, yb bigint, heat double, density double")
