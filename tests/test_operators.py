"""Edge rules, curation against brute force, calibration, files."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rallyframe import constants as K
from rallyframe.functions import scalars as S
from rallyframe.operators import calibrate, curation, events, points, state, stats
from rallyframe.sources import readers, sinks


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first().v


@pytest.mark.parametrize("x,y,call", [(423, 1000, "line"), (443, 1000, "line"), (443.5, 1000, "in"), (403, 1000, "line"), (402.9, 1000, "out"),
                                      (411, 545, "line"), (408, 546, "out"), (800, 2956, "out"), (800, 2955, "line")])
def test_line_margin(spark, x, y, call):
    assert one(spark, S.in_out(F.lit(float(x)), F.lit(float(y)))) == call


def test_zone_borders(spark):
    z = lambda x, y: one(spark, S.serve_zone(F.lit(float(x)), F.lit(float(y))))
    assert z(832, 1748) == "far_left" and z(833, 1748) == "far_right" and z(832, 1749) == "near_left" and z(1242, 2386) == "near_right"
    assert z(1243, 1500) is None


def test_missing_values_do_not_score(spark):
    assert one(spark, S.bounce_score(F.lit(20.0), F.lit(None).cast("double"), F.lit(None).cast("double"))) == pytest.approx(0.3)
    assert one(spark, S.hit_score(F.lit(90.0), F.lit(None).cast("double"), F.lit(100.0))) == pytest.approx(0.45)


def test_text_helpers(spark):
    assert [one(spark, S.ordinal(F.lit(n))) for n in (1, 2, 3, 11, 13, 22, 111)] == ["1st", "2nd", "3rd", "11th", "13th", "22nd", "111th"]
    assert one(spark, S.ascii_clean(F.lit(" “a”  –  b… "))) == '"a" - b...'


def test_configurations_follow_the_court():
    assert set(K.CONFIGURATIONS) == set(range(1, 13))
    assert all(len(set(q)) == 4 for q in K.CONFIGURATIONS.values())


def test_calibration_recovers_the_map(spark, fx):
    d = calibrate.calibrate(fx.keypoints).filter("reliable AND NOT carried").select("inverse").limit(50).collect()
    want = [2, 0, -200, 0, 4, -200, 0, 0, 1]
    for r in d:
        inv = np.array(r.inverse) / r.inverse[8]
        assert inv == pytest.approx(want, abs=1e-6)


def test_calibration_needs_four_keypoints(spark):
    rows = [(0, 0, i, float(x) / 2, float(y) / 4) if i < 3 else (0, 0, i, None, None) for i, (x, y) in enumerate(K.COURT_KEYPOINTS)]
    r = calibrate.best_fits(spark.createDataFrame(rows, "match_id BIGINT, frame_idx BIGINT, kp INT, px DOUBLE, py DOUBLE")).first()
    assert (r.detected, r.matrix, r.error) == (3, None, None)


def test_carry_stops_after_five_frames(spark):
    rows = [(0, f, 0.0 if f in (2, 9) else 100.0) for f in range(20)]
    d = spark.createDataFrame(rows, "match_id BIGINT, frame_idx BIGINT, error DOUBLE").withColumn("matrix", F.array(F.col("frame_idx").cast("double"))).withColumn("inverse", F.col("matrix"))
    got = {r.frame_idx: (r.reliable, r.carried, r.matrix) for r in calibrate.carry_forward(d, size=8).collect()}
    assert [f for f in got if got[f][0]] and sorted(f for f in got if got[f][0]) == [2, 3, 4, 5, 6, 7, 9, 10, 11, 12, 13, 14]
    assert got[7] == (True, True, [2.0]) and got[9] == (True, False, [9.0])


EV = "match_id BIGINT, event_type STRING, frame_idx BIGINT, cx DOUBLE, cy DOUBLE, score DOUBLE, court_side STRING, in_out STRING, player STRING"


def ev(kind, frame, side="far", call="in", score=0.5):
    return (0, kind, frame, 800.0, 1300.0 if side == "far" else 2000.0, score, side, call if kind == "bounce" else None, "player_a" if kind == "hit" else None)


def cut(spark, *rows):
    return points.segment_points(spark.createDataFrame(list(rows), EV), 30.0, size=64).orderBy("point_idx").collect()


def test_gap_of_fifty_keeps_a_rally(spark):
    assert len(cut(spark, ev("hit", 0), ev("bounce", 50))) == 1
    assert cut(spark, ev("hit", 0), ev("bounce", 51)) == []
    assert [p.start_frame for p in cut(spark, ev("hit", 0), ev("bounce", 9), ev("hit", 60), ev("bounce", 70))] == [0, 60]


def test_end_reasons(spark):
    assert cut(spark, ev("hit", 0), ev("bounce", 5, call="out"), ev("hit", 9))[0].end_reason == "OUT"
    assert cut(spark, ev("hit", 0), ev("bounce", 5), ev("bounce", 9))[0].end_reason == "DOUBLE_BOUNCE"
    assert cut(spark, ev("hit", 0), ev("bounce", 5), ev("hit", 7), ev("bounce", 9))[0].end_reason == "BALL_LOST"
    assert cut(spark, ev("hit", 0), ev("bounce", 5), ev("bounce", 9, side="near"))[0].end_reason == "BALL_LOST"
    assert cut(spark, ev("bounce", 0), ev("bounce", 5)) == []


def test_cross_dedup_keeps_first_of_equals(spark):
    d = spark.createDataFrame([ev("bounce", 10), ev("hit", 11), ev("hit", 20), ev("bounce", 30, score=0.4), ev("hit", 30, score=0.6)], EV)
    got = {(r.event_type, r.frame_idx) for r in events.cross_dedup(d, size=8).collect()}
    assert got == {("bounce", 10), ("hit", 20), ("hit", 30)}


def test_heat_totals_equal_rows_in_range(spark, fx):
    from rallyframe.operators import heatmaps
    h = heatmaps.heatmap(fx.frames, "ball_cx", "ball_cy", 19, 29)
    inside = fx.frames.filter("ball_cx BETWEEN 286 AND 1379 AND ball_cy BETWEEN 561 AND 2935").count()
    assert h.agg(F.sum("n")).first()[0] == inside
    top = spark.createDataFrame([(0, 1379.0, 2935.0)], "match_id BIGINT, x DOUBLE, y DOUBLE")
    assert tuple(heatmaps.heatmap(top, "x", "y", 19, 29).first())[1:3] == (18, 28)


@pytest.mark.parametrize("block,peels", [(1024, 2), (3, 0)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, block, peels):
    """With blocks of 3 frames nearly every bucket is hot, without peeling all is decided on the graph."""
    monkeypatch.setattr(curation, "BLOCK", block)
    monkeypatch.setattr(curation, "PEELS", peels)
    rnd = random.Random(7)
    seeds = [rnd.getrandbits(256) for _ in range(12)]
    rows = []
    for i in range(150):
        h = rnd.choice(seeds)
        for _ in range(rnd.choice([0, 0, 3, 8, 10, 11, 14])):
            h ^= 1 << rnd.randrange(256)
        rows.append((i, None if i % 29 == 5 else h))
    kept, want = [], []
    for i, h in rows:
        if h is None or all((h ^ k).bit_count() > 10 for k in kept):
            want.append(i)
            if h is not None:
                kept.append(h)
    words = [f"w{k}" for k in range(8)]
    data = [(i, *[None if h is None else (h >> (32 * k)) & 0xFFFFFFFF for k in range(8)]) for i, h in rows]
    df = spark.createDataFrame(data, "frame_no BIGINT, " + ", ".join(f"{w} BIGINT" for w in words))
    got = curation.near_duplicates(df, words)
    assert sorted(r.frame_no for r in got.collect()) == want


def test_a_long_chain_of_near_frames_takes_few_rounds(spark, monkeypatch):
    """5,000 frames, each near the one before only: every second one stays."""
    edges = spark.range(1, 5000).selectExpr("id - 1 AS prev", "id")
    empty, rounds = type(edges).isEmpty, []
    monkeypatch.setattr(type(edges), "isEmpty", lambda self: (rounds.append(1), empty(self))[1])
    got = {r.id for r in curation._settle(edges).where("kept").collect()}
    assert got == set(range(0, 5000, 2)) and len(rounds) < 2 * 20


def test_graph_of_near_frames_equals_a_walk(spark):
    rnd = random.Random(11)
    edges = sorted({(min(a, b), max(a, b)) for a, b in ((rnd.randrange(120), rnd.randrange(120)) for _ in range(200)) if a != b})
    kept = set()
    for i in range(120):
        if not any(p in kept for p, k in edges if k == i):
            kept.add(i)
    nodes = {x for e in edges for x in e}
    got = {r.id: r.kept for r in curation._settle(spark.createDataFrame(edges, "prev BIGINT, id BIGINT")).collect()}
    assert got == {n: n in kept for n in nodes}


def test_diverse_subset_equals_brute_force(spark, monkeypatch, fx):
    rng = np.random.default_rng(8)
    v = rng.normal(size=(120, 6)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id BIGINT, embedding ARRAY<FLOAT>")
    chosen = [0]
    while len(chosen) < 10:
        d = np.linalg.norm(v[:, None].astype(float) - v[chosen][None].astype(float), axis=2).min(axis=1)
        d[chosen] = -1
        chosen.append(int(d.argmax()))
    assert sorted(r.vec_id for r in curation.diverse_subset(df, 10, candidates=7).collect()) == sorted(chosen)
    assert curation.diverse_subset(df, 120).count() == 120
    passes, one = [], curation._farthest
    monkeypatch.setattr(curation, "_farthest", lambda *a: (passes.append(1), one(*a))[1])
    assert curation.diverse_subset(fx.table("embeddings")).count() == 24 and len(passes) <= 6
    sparse = df.withColumn("embedding", F.when(F.col("vec_id") < 5, F.col("embedding")))
    assert sorted(r.vec_id for r in curation.diverse_subset(sparse, 10).collect()) == [i * 12 for i in range(10)]


def test_latest_wins_and_first_date_stays(spark):
    log = spark.createDataFrame([(1, 0, "a", "d0"), (1, 2, "c", "d2"), (1, 1, "b", "d1")], "k INT, version INT, v STRING, date STRING")
    assert tuple(state.latest(log, ["k"], ["version"], first_of=["date"]).select("v", "date").first()) == ("c", "d0")
    assert state.insert_if_absent(log, ["k"], ["version"]).first().v == "a"


def test_hot_match_does_not_change_results(spark, fx):
    """A third of all rows in one match: same numbers as alone."""
    f, p = fx.shots, stats.with_serve_calls(fx.points)
    alone = {tuple(r) for r in stats.errors_by_rally(p, f).collect()}
    shift = lambda d, k: d.withColumn("match_id", F.col("match_id") + k)
    both = stats.errors_by_rally(p.unionByName(shift(p.limit(3), 50)), f.unionByName(shift(f.limit(9), 50)))
    assert alone == {tuple(r) for r in both.filter("match_id < 50").collect()}


def test_round_trip_of_files(spark, fx, tmp_path):
    from rallyframe.plans.chain import Chain
    c = Chain(fx)
    track = c.physics.join(fx.frames.select("match_id", "frame_idx"), ["match_id", "frame_idx"])
    doc = sinks.frame_documents(track, c.homography, c.players, fx.keypoints)
    sinks.write_json(doc, str(tmp_path / "frames"), ["match_id"])
    bad = tmp_path / "frames" / "match_id=0" / "bad.json"
    bad.write_text('{"frame_idx": 1, "ball": \n')
    back = readers.frames(spark, str(tmp_path / "frames" / "*"))
    assert back.count() == fx.frames.count() and back.select("job_id").distinct().count() == 1
    q = stats.coverage_quality(readers.flat_frames(back)).first()
    assert q.frames_total == fx.frames.count() and 0 < q.reliable_pct < 100
    assert readers.documents(spark, str(tmp_path / "none" / "*.json"), "points").count() == 0


def test_documents_skip_broken_files(spark, tmp_path):
    for run, text in (("r1", '[{"point_idx": 0, "end_reason": "OUT"}, {"point_idx": 1}]'), ("r2", "[{"), ("r3", "[]")):
        (tmp_path / run).mkdir()
        (tmp_path / run / "points.json").write_text(text)
    d = readers.documents(spark, str(tmp_path / "*" / "points.json"), "points").filter("point_idx IS NOT NULL")
    assert sorted((r.job_id, r.point_idx, r.end_reason) for r in d.collect()) == [("r1", 0, "OUT"), ("r1", 1, None)]


def test_stored_runs(spark, tmp_path):
    for run, n in (("a", 3), ("b", 0), ("c", 5)):
        (tmp_path / run).mkdir()
        (tmp_path / run / "analytics.json").write_text(f'{{"total_points": {n}, "total_shots": 9}}')
    assert sorted(r.job_id for r in readers.stored_runs(spark, str(tmp_path)).collect()) == ["a", "c"]
    cur = readers.stored_runs(spark, str(tmp_path)).filter("job_id = 'a'").withColumn("total_points", F.lit(99).cast("bigint"))
    assert {(r.job_id, r.total_points) for r in readers.stored_runs(spark, str(tmp_path), cur).collect()} == {("a", 99), ("c", 5)}


def test_label_files(spark, fx, tmp_path):
    b = fx.boxes.filter("frame_idx < 5")
    sinks.write_label_files(curation.label_lines(b), str(tmp_path / "labels"))
    text = spark.read.text(str(tmp_path / "labels" / "*"))
    assert text.count() == b.count()
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "f7.txt").write_text("0 0.5 0.5 0.1 0.2\nnot a box\n1 0.1 0.2 0.3 0.4\n")
    got = readers.labels(spark, str(tmp_path / "one")).collect()
    assert [(r.frame, r.class_id, r.w) for r in got] == [("f7", 0, 0.1), ("f7", 1, 0.3)]


def test_plans_reach_the_scan(spark, fx):
    """Column pruning and filters arrive at the parquet scan."""
    plan = fx.shots.select("match_id", "frame_idx", "owner")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema" in plan and "props" not in plan and "value" not in plan.split("ReadSchema")[1].split("\n")[0]
