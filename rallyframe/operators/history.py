"""Trends of a player over many matches."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rallyframe.functions import scalars as S
from rallyframe.operators import stats


def snapshot(points: DataFrame, shots: DataFrame) -> DataFrame:
    """One row per player and match; type and error maps have a fixed set of possible keys."""
    on = ["match_id", "owner"]
    mix = shots.groupBy(*on, stats.shot_type().alias("shot_type")).agg(F.count(F.lit(1)).alias("n"), F.min("frame_idx").alias("seen"))
    as_map = lambda df, k, v, name: df.groupBy(*on).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(k, v)))).alias(name))
    dominant = mix.groupBy(*on).agg(F.max_by("shot_type", F.struct("n", (-F.col("seen")).alias("s"))).alias("dominant_pattern"))
    fraction = lambda df: df.withColumn("rate", F.col("rate") / 100)
    d = stats.average_speed(shots).join(stats.points_won_lost(points, shots), on, "full").join(stats.serve_summary(points), on, "left")
    d = d.join(dominant, on, "left").join(as_map(mix, "shot_type", "n", "shot_type_counts"), on, "left")
    d = d.join(as_map(fraction(stats.errors_by_type(points, shots)), "shot_type", "rate", "error_rate_by_shot"), on, "left")
    d = d.join(as_map(fraction(stats.errors_by_rally(points, shots)), "bucket", "rate", "error_rate_by_rally"), on, "left")
    d = d.join(points.groupBy("match_id").agg(F.count(F.lit(1)).alias("total_points")), "match_id", "left")
    return d.na.fill({"total_shots": 0, "avg_speed": 0.0}).withColumn("avg_shot_speed_kmh", F.round(F.col("avg_speed") * 3.6, 1)).drop("avg_speed", "serves")


def series(history: DataFrame) -> DataFrame:
    """Long metric series: value per match rounded to 3 decimals; long rallies fall back to 10+ for
    players that never have a 7-9 value."""
    has = history.groupBy("player_id").agg((F.count("rally_79") > 0).alias("_has79"))
    h = history.join(has, "player_id").withColumn("long_rally", F.when(F.col("_has79"), F.col("rally_79")).otherwise(F.col("rally_10")))
    names = ["backhand", "forehand", "long_rally", "first_serve", "speed_kmh"]
    stack = ", ".join(f"'{n}', {n}" for n in names)
    d = h.select("player_id", "job_id", "match_date", F.expr(f"stack({len(names)}, {stack}) AS (metric, value)"))
    return d.filter("value IS NOT NULL").withColumn("value", F.round("value", 3))


def dominant_counts(history: DataFrame) -> DataFrame:
    return history.filter("dominant_pattern IS NOT NULL").groupBy("player_id", "dominant_pattern").agg(F.count(F.lit(1)).alias("matches"))


def confirmed_weaknesses(history: DataFrame) -> DataFrame:
    """Weaknesses whose average or frequency over the matches passes the rule's threshold."""
    s = series(history)
    v, m = F.col("value"), F.col("metric")
    low_serve = m == "first_serve"
    high = S.when_chain([(m == "backhand", v >= 0.3), (m == "long_rally", v >= 0.5), (low_serve, v < 0.6)])
    g = s.filter(m.isin("backhand", "long_rally", "first_serve")).groupBy("player_id", "metric").agg(
        F.count(F.lit(1)).alias("matches_count"), F.count_if(high).alias("high_error_matches"), F.avg("value").alias("avg_value"))
    need = F.greatest(F.lit(1), F.round(F.col("matches_count") * 0.6).cast("bigint"))
    g = g.withColumn("confirmed", F.col("high_error_matches") >= need)
    a = F.col("avg_value")
    keep = S.when_chain([(m == "backhand", (a >= 0.25) | F.col("confirmed")), (m == "long_rally", a >= 0.4), (low_serve, a < 0.6)], False)
    name = S.when_chain([(m == "backhand", "Backhand consistency"), (m == "long_rally", "Long rally endurance")], "First serve reliability")
    return g.filter(keep).select("player_id", name.alias("weakness"), "matches_count", "high_error_matches",
                                 F.when(low_serve, 1 - a).otherwise(a).alias("avg_rate"), "confirmed")


def trend_summary(history: DataFrame) -> DataFrame:
    """Match count and average speed per player with the number of values of every series."""
    n = lambda name: F.count_if(F.col("metric") == name).alias(f"n_{name}")
    s = series(history).groupBy("player_id").agg(n("backhand"), n("forehand"), n("long_rally"), n("first_serve"))
    g = history.groupBy("player_id").agg(F.count(F.lit(1)).alias("match_count"), F.avg("speed_kmh").alias("avg_shot_speed_kmh"),
                                         F.min("match_date").alias("first_date"), F.max("match_date").alias("last_date"))
    return g.join(s, "player_id", "left")


def baselines(history: DataFrame) -> DataFrame:
    """Per player slot: number of matches, averages and how often a threshold was crossed."""
    lr = F.greatest("rally_79", "rally_10")
    return history.withColumn("long_rally", lr).groupBy("player_key").agg(
        F.countDistinct("job_id").alias("match_count"), F.avg("backhand").alias("base_backhand"), F.avg("long_rally").alias("base_long"),
        F.avg("first_serve").alias("base_serve"), F.avg("speed_kmh").alias("base_speed"), F.count("backhand").alias("n_backhand"),
        F.count("long_rally").alias("n_long"), F.count("first_serve").alias("n_serve"), F.count_if(F.col("backhand") >= 0.3).alias("high_backhand"),
        F.count_if(F.col("long_rally") >= 0.5).alias("high_long"), F.count_if(F.col("first_serve") < 0.6).alias("low_serve"))


def deltas(history: DataFrame) -> DataFrame:
    """Every match against the baseline of its player slot, in percentage points and km/h.

    The baseline has one row per player slot; whether to broadcast it is left to Spark's size check.
    """
    d = history.withColumn("long_rally", F.greatest("rally_79", "rally_10")).join(baselines(history), "player_key")
    pp = lambda now, base, name: ((F.col(now) - F.col(base)) * 100).alias(name)
    return d.select("player_key", "job_id", "match_count", (F.col("match_count") >= 3).alias("enabled"),
                    pp("backhand", "base_backhand", "backhand_delta_pp"), pp("long_rally", "base_long", "long_rally_delta_pp"),
                    pp("first_serve", "base_serve", "first_serve_delta_pp"), (F.col("speed_kmh") - F.col("base_speed")).alias("speed_delta_kmh"))


def persistent_weaknesses(history: DataFrame) -> DataFrame:
    """Weaknesses seen in at least 60 % of a slot's matches (and in two at least)."""
    b = baselines(history)
    row = lambda name, base, hit, n: F.struct(F.lit(name).alias("name"), (F.col(base) * 100).alias("baseline_rate_pct"),
                                              F.col(hit).alias("matches_triggered"), F.col(n).alias("matches_with_data"))
    d = b.select("player_key", F.explode(F.array(
        row("Backhand consistency", "base_backhand", "high_backhand", "n_backhand"),
        row("Long-rally errors (7+ shots)", "base_long", "high_long", "n_long"),
        row("First-serve reliability", "base_serve", "low_serve", "n_serve"))).alias("r")).select("player_key", "r.*")
    need = F.greatest(F.lit(2), F.ceil(F.col("matches_with_data") * 0.6))
    return d.filter("matches_with_data > 0").withColumn("confirmed", F.col("matches_triggered") >= need)


def summary_lines(history: DataFrame) -> DataFrame:
    """Sentences per match and slot once three matches exist."""
    d = deltas(history).join(baselines(history).drop("match_count"), "player_key").filter("enabled")
    one = lambda c: F.format_string("%.1f", F.bround(c, 1))
    delta = F.col("backhand_delta_pp")
    sign = F.when(delta >= 0, "+").otherwise("-")  # a small loss reads -0.0: rounding has no negative zero of its own
    lines = F.array_compact(F.array(
        F.when(F.col("base_backhand").isNotNull(), F.concat(F.lit("Backhand error averages "), one(F.col("base_backhand") * 100),
               F.lit("% across "), F.col("match_count").cast("string"), F.lit(" matches."))),
        F.when(F.col("base_long").isNotNull(), F.concat(F.lit("Long-rally error averages "), one(F.col("base_long") * 100),
               F.lit("% across "), F.col("match_count").cast("string"), F.lit(" matches."))),
        F.when(F.col("backhand_delta_pp").isNotNull(), F.concat(F.lit("Today vs baseline: backhand error "), sign,
               one(F.abs(delta)), F.lit(" percentage points.")))))
    return d.select("player_key", "job_id", F.array_join(lines, " ").alias("summary"))
