"""Skew experiment: many copies of the frame table, a third of all rows in one match.

python scale_check.py [copies] - prints seconds and the largest share of rows any task received.
"""
from __future__ import annotations

import json
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import Window  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from rallyframe.fixtures import Fixtures  # noqa: E402
from rallyframe.operators import events, greedy, tracking  # noqa: E402
from rallyframe.operators.scan import Agg, scan  # noqa: E402
from rallyframe.session import build_session, pin  # noqa: E402


def hot_frames(fx: Fixtures, copies: int):
    """Copies of every match; a third of the copies is chained into one long match (id -1)."""
    f = fx.frames.select("match_id", "frame_idx", "fps", F.col("ball_px"), F.col("ball_py"), F.col("ball_cx").alias("cx"), F.col("ball_cy").alias("cy"))
    f = f.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    n = f.groupBy("match_id", "k").agg(F.count(F.lit(1)).alias("_len")).withColumn("_hot", (F.col("k") % 3 == 0).cast("int"))
    w = Window.partitionBy("_hot").orderBy("match_id", "k").rowsBetween(Window.unboundedPreceding, -1)  # one row per copy of a match
    n = n.withColumn("_off", F.coalesce(F.sum("_len").over(w), F.lit(0)))
    d = f.join(n.select("match_id", "k", "_off"), ["match_id", "k"])
    hot = F.col("k") % 3 == 0
    return d.select(F.when(hot, -1).otherwise(F.col("match_id") + F.col("k") * 100000).alias("match_id"),
                    (F.col("frame_idx") + F.when(hot, F.col("_off")).otherwise(0)).alias("frame_idx"), "fps", "ball_px", "ball_py", "cx", "cy")


def main() -> None:
    copies = int(sys.argv[1]) if len(sys.argv) > 1 else 60
    spark = build_session("local[8]", "scale", spark__sql__shuffle__partitions="64", spark__driver__memory="20g")
    spark.sparkContext.setLogLevel("ERROR")
    f = pin(hot_frames(Fixtures(spark, "/root/testdata/sf0.1"), copies))
    total = f.count()
    out = {"rows": total, "hot_share": round(f.filter("match_id = -1").count() / total, 3)}

    def timed(name, df):
        t = time.time()
        df.write.format("noop").mode("overwrite").save()
        out[name] = round(time.time() - t, 2)

    w = Window.partitionBy("match_id").orderBy("frame_idx")
    timed("plain_window_by_match", f.withColumn("p", F.last("ball_px", True).over(w.rowsBetween(Window.unboundedPreceding, -1))))
    timed("scan_by_chunk", scan(f, ["match_id"], ["frame_idx"], p=Agg("last", "before", F.col("ball_px"))))
    timed("clean_track", tracking.clean_track(f.drop("cx", "cy")))
    phys = tracking.ball_physics(f)
    timed("ball_physics", phys)
    timed("candidates", events.candidates(phys))
    t = time.time()
    kept = greedy.debounce(f.filter("frame_idx % 3 = 0").select("match_id", "frame_idx"), ["match_id"], step=12)
    out["debounce_one_endless_island"] = [round(time.time() - t, 2), kept.count()]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    part = scan(f, ["match_id"], ["frame_idx"], p=Agg("last", "before", F.col("ball_px"))).groupBy(F.spark_partition_id().alias("p")).count()
    out["largest_task_share"] = round(part.agg(F.max("count")).first()[0] / total, 3)
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
