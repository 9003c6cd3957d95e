"""Values that lie exactly on a limit: what floating point leaves of them decides nothing."""
import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from rallyframe.functions import scalars as S
from rallyframe.operators import events, stats
from rallyframe.operators.quantiles import mean_in_order
from rallyframe.plans.oracle import CTES

HEIGHTS = [1000, 1100, 1200, 1290, 1190, 1200, 1050, 950, 850, 750, 650, 550]  # frames 2 and 5 cancel: the smoothed height stands still at 4


def physics(spark, noise):
    speeds = [20.0] * 4 + [5.0] + [20.0] * 7
    rows = [(1, i, 30.0, 800.0 + 40 * i, y + (noise if i == 5 else 0.0), speeds[i], -50.0 if i == 4 else 0.0) for i, y in enumerate(HEIGHTS)]
    return rows, spark.createDataFrame(rows, "match_id long, frame_idx long, fps double, cx double, cy double, speed double, accel double")


@pytest.mark.parametrize("noise", [-1e-9, 0.0, 1e-9])
def test_a_height_that_stands_still_does_not_reverse(spark, noise):
    rows, d = physics(spark, noise)
    got = {(r.event_type, r.frame_idx) for r in events.candidates(d).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE o_physics(match_id BIGINT, frame_idx BIGINT, fps DOUBLE, cx DOUBLE, cy DOUBLE, speed DOUBLE, accel DOUBLE)")
    con.executemany("INSERT INTO o_physics VALUES (?, ?, ?, ?, ?, ?, ?)", rows)
    want = set(con.execute(f"SELECT event_type, frame_idx FROM ({CTES['o_cand']})").fetchall())
    assert got == want and not any(kind == "bounce" for kind, _ in got)


def test_halves_round_up_whatever_the_order_of_the_sum(spark):
    half = [(15.695 + 15.69), 31.385, math.nextafter(31.385, 0), math.nextafter(31.385, 99)]
    d = spark.createDataFrame([(v,) for v in half[1:]], "v double")
    assert {r.r for r in d.select(S.round_up("v", 2).alias("r")).collect()} == {31.39}
    assert spark.range(1).select(S.round_up(F.lit(0.3405), 3).alias("r")).first().r == 0.341


def test_a_mean_that_lies_halfway_rounds_as_its_rows_add_up(spark):
    """Speeds of one decimal: the mean of each match is k.x5 exactly, what floating point makes of it depends on the order of the rows."""
    rnd, rows = random.Random(1), []
    for match in range(20):
        tenths = [rnd.randrange(600) for _ in range(119)]
        tenths.append(120 * 306 + 60 - sum(tenths))
        rows += [(match, i, t / 10) for i, t in enumerate(tenths)]
    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute("CREATE TABLE s(match_id BIGINT, frame_idx BIGINT, v DOUBLE)")
    con.executemany("INSERT INTO s VALUES (?, ?, ?)", rows)
    want = dict(con.execute("SELECT match_id, ROUND(AVG(v), 1) FROM s GROUP BY 1").fetchall())
    assert set(want.values()) == {30.6, 30.7}
    for seed in (1, 2):
        d = spark.createDataFrame(random.Random(seed).sample(rows, len(rows)), "match_id long, frame_idx long, v double").repartition(8)
        assert dict(map(tuple, mean_in_order(d, ["match_id"], "frame_idx", "v", 1, "m").collect())) == want


def test_the_mean_between_hits_rounds_as_its_intervals_add_up(spark):
    """512 intervals at 25 frames a second over 4 * odd frames: the mean ends in 5 at the seventh decimal."""
    rnd, rows = random.Random(2), []
    for match in range(40):
        steps = [rnd.randrange(1, 8) for _ in range(511)]
        steps.append(1 + (4 - sum(steps) - 1) % 8)
        at = [sum(steps[:k]) for k in range(513)]
        rows += [(match, f, f / 25) for f in at]
    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute("CREATE TABLE s(match_id BIGINT, frame_idx BIGINT, t DOUBLE)")
    con.executemany("INSERT INTO s VALUES (?, ?, ?)", rows)
    want = dict(con.execute("""SELECT match_id, ROUND(AVG(iv), 6) FROM (SELECT match_id, t - LAG(t) OVER (PARTITION BY match_id ORDER BY frame_idx) AS iv FROM s)
                               WHERE iv > 0 GROUP BY 1""").fetchall())
    hits = spark.createDataFrame(rows, "match_id long, frame_idx long, timestamp_sec double").repartition(8)
    points = spark.createDataFrame([(m, 3, 0.0, 1.0) for m in range(40)], "match_id long, rally_hit_count long, start_sec double, end_sec double")
    got = stats.rally_structure(points, hits).selectExpr("match_id", "round(mean_inter_hit, 6)").collect()
    assert dict(map(tuple, got)) == want
