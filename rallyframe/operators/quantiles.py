"""Exact linear-interpolation percentiles without gathering a group in one task, and means that round as in SQL."""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rallyframe.operators.scan import Agg, scan
from rallyframe.session import pin

STEPS, BORDERS = 4096, 64


def magnitude_bucket(v: Column, steps: int = STEPS) -> Column:
    """Order-preserving bucket of a double: ``steps`` equal buckets per power of two, both signs.

    Needs no knowledge of the data, so values of any range spread over buckets.
    """
    size = F.abs(v)
    e = F.floor(F.log2(size))
    key = (e + 1100) * steps + F.floor((size / F.pow(F.lit(2.0), e) - 1) * steps)
    return F.when(v == 0, F.lit(0)).otherwise(F.signum(v).cast("bigint") * key)


def distribution(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], prefix: str = "",
                 steps: int = STEPS) -> DataFrame:
    """Count, mean, maximum and exact percentiles per key (keys without values give no row).

    Equal values are counted first (map-side combined). The distinct values of a key are ranked by a
    chunked running sum, so no task orders a whole key. Chunks are magnitude buckets cut further at
    about ``BORDERS`` evenly spread values of the key, so that values in a narrow band are split as
    well; the borders only place the cuts, ranks stay exact.
    """
    keys = list(keys)
    counted = pin(df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
                  .groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_m")))
    marks = [i / BORDERS for i in range(1, BORDERS)]
    borders = counted.groupBy(*keys).agg(F.percentile_approx("_v", marks, 10 * BORDERS).alias("_b"))
    same = [F.col(f"c.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    counted = counted.alias("c").join(borders.alias("b"), reduce(lambda x, y: x & y, same)).select("c.*", "_b")
    cut = F.size(F.filter("_b", lambda b: b <= F.col("_v"))).cast("bigint") * (1 << 40)
    ranked = scan(counted.withColumn("_chunk_at", cut + magnitude_bucket(F.col("_v"), steps)).drop("_b"), keys, ["_v"], chunk=F.col("_chunk_at"),
                  _upto=Agg("sum", "upto", F.col("_m")), _n=Agg("sum", "all", F.col("_m")))
    ends = []
    for name, p in probs.items():
        pos = F.lit(float(p)) * (F.col("_n") - 1)
        ends += [_value_at(F.floor(pos)).alias(f"_a_{name}"), _value_at(F.ceil(pos)).alias(f"_z_{name}")]
    g = ranked.groupBy(*keys).agg(F.max("_n").alias("_n"), F.sum(F.col("_v") * F.col("_m")).alias("_sum"), F.max("_v").alias("_max"), *ends)
    out = []
    for name, p in probs.items():
        pos = F.lit(float(p)) * (F.col("_n") - 1)
        a, z = F.col(f"_a_{name}"), F.col(f"_z_{name}")
        out.append((a + (z - a) * (pos - F.floor(pos))).alias(f"{prefix}{name}"))
    return g.select(*keys, F.col("_n").alias(f"{prefix}n"), (F.col("_sum") / F.col("_n")).alias(f"{prefix}mean"),
                    F.col("_max").alias(f"{prefix}max"), *out)


def _value_at(rank: Column) -> Column:
    """Value whose run of equal copies covers the 0-based rank."""
    inside = (rank >= F.col("_upto") - F.col("_m")) & (rank < F.col("_upto"))
    return F.max(F.when(inside, F.col("_v")))


def percentiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], steps: int = STEPS) -> DataFrame:
    """One row per key with a column per probability."""
    return distribution(df, keys, value, probs, steps=steps).select(*keys, *probs)


def summarise(df: DataFrame, keys: Sequence[str], value: str, prefix: str = "") -> DataFrame:
    """Mean, median, p90, p95 and maximum per key."""
    return distribution(df, keys, value, {"median": 0.5, "p90": 0.9, "p95": 0.95}, prefix)


def mean_in_order(df: DataFrame, keys: Sequence[str], order: str, value: str, digits: int, name: str) -> DataFrame:
    """Mean per key to ``digits`` decimals. A mean that lies halfway goes up or down by the last bit of its sum, so there, and only there, the
    values are added in ``order``, as SQL on one thread adds the rows of a sorted window. Only the rows of such keys meet in one task.
    """
    seen = df.filter(F.col(value).isNotNull()).select(*keys, order, F.col(value).cast("double").alias("_v"))
    means, unit = seen.groupBy(*keys).agg(F.avg("_v").alias("_mean")), 10.0 ** digits
    half = means.filter(F.abs(F.pmod(F.col("_mean") * unit, F.lit(1.0)) - 0.5) < 1e-6).select(*keys)
    rows = seen.join(half, keys, "left_semi").groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(order, "_v"))).alias("_r"))
    added = rows.select(*keys, (F.aggregate("_r", F.lit(0.0), lambda total, r: total + r["_v"]) / F.size("_r")).alias("_ordered"))
    return means.join(added, keys, "left").select(*keys, (F.round(F.coalesce("_ordered", "_mean") * unit) / unit).alias(name))
