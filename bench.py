"""Time the headline queries; prints one JSON line."""
from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from rallyframe.plans import all_queries  # noqa: E402
from rallyframe.session import build_session  # noqa: E402

HEADLINE = [
    "in_out_calls", "track_interpolated", "ball_physics", "bounce_candidates", "event_nms", "hit_player_assignment", "contacts",
    "calibration", "player_carry", "point_records", "shots_in_points", "error_by_shot_type", "serve_summary", "movement_stats",
    "ball_heatmap", "momentum_decay", "streaks", "history_delta", "near_dup_frames", "diverse_frames", "shard_qc", "next_action",
    "review_applied", "match_report",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", "bench", spark__sql__shuffle__partitions=cpus, spark__driver__memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    qs = all_queries()
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for n in names:
        t = time.time()
        qs[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[n] = round(time.time() - t, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": Path(sf_dir).name.removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
