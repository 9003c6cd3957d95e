"""Chunked primitives and greedy filters against plain Python, with chunks far smaller than the data."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rallyframe.operators import greedy, momentum, quantiles, scan, tracking
from rallyframe.operators.scan import Agg


def frames(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("size", [5, 16, 8192])
def test_scan_equals_plain_walk(spark, size):
    rnd = random.Random(1)
    data = {m: sorted(rnd.sample(range(300), 60)) for m in (0, 1)}
    vals = {(m, f): rnd.choice([None, rnd.randint(-9, 9)]) for m in data for f in data[m]}
    df = frames(spark, [(m, f, v) for (m, f), v in vals.items()], "match_id BIGINT, frame_idx BIGINT, v BIGINT").repartition(7)
    v = F.col("v")
    out = scan.scan(df, ["match_id"], ["frame_idx"], size=size, s=Agg("sum", "upto", v), c=Agg("count", "before", v), lo=Agg("min", "upto", v),
                    last=Agg("last", "before", v), nxt=Agg("first", "after", v), frm=Agg("first", "from", F.struct("frame_idx", "v")),
                    hi=Agg("max", "all", v), n=Agg("count", "all", F.lit(1)), f0=Agg("first", "all", v))
    got = {(r.match_id, r.frame_idx): r for r in out.collect()}
    for m, fs in data.items():
        seq = [vals[m, f] for f in fs]
        known = [x for x in seq if x is not None]
        for i, f in enumerate(fs):
            r = got[m, f]
            upto, before, after = [x for x in seq[:i + 1] if x is not None], [x for x in seq[:i] if x is not None], [x for x in seq[i + 1:] if x is not None]
            assert r.s == sum(upto) and r.c == len(before) and r.lo == (min(upto) if upto else None)
            assert r.last == (before[-1] if before else None) and r.nxt == (after[0] if after else None)
            assert (r.frm.frame_idx, r.frm.v) == (f, seq[i])
            assert r.hi == max(known) and r.n == len(seq) and r.f0 == known[0]


def test_row_numbers_over_text_order(spark):
    df = frames(spark, [(0, i * 7 % 50, "ab"[i % 2]) for i in range(50)], "k BIGINT, t BIGINT, e STRING")
    out = scan.row_numbers(df, ["k"], ["t", "e"], "no", size=8)
    assert [r.no for r in out.orderBy("t", "e").collect()] == list(range(1, 51))


def nms(rows, reach):
    kept = []
    for f, s in sorted(rows, key=lambda r: (-r[1], r[0])):
        if all(abs(f - k) > reach for k in kept):
            kept.append(f)
    return sorted(kept)


def cool(rows, step):
    kept = []
    for f in sorted(rows):
        if not kept or f - kept[-1] >= step:
            kept.append(f)
    return kept


@pytest.mark.parametrize("size", [8192, 32, 12])
def test_suppress_and_debounce(spark, size):
    """One plan for all sizes; with chunks of 12 frames nearly every decision hangs on a neighbour chunk. Few score values give many ties."""
    rnd = random.Random(2)
    rows = {m: [(f, rnd.randint(0, 5) / 5) for f in sorted(rnd.sample(range(160), 60))] for m in (0, 1)}
    df = frames(spark, [(m, f, s) for m, r in rows.items() for f, s in r], "match_id BIGINT, frame_idx BIGINT, score DOUBLE")
    got = greedy.suppress(df, ["match_id"], size=size).collect()
    for m, r in rows.items():
        assert sorted(x.frame_idx for x in got if x.match_id == m) == nms(r, 5)
    got = greedy.debounce(df.drop("score"), ["match_id"], size=size).collect()
    for m, r in rows.items():
        assert sorted(x.frame_idx for x in got if x.match_id == m) == cool([f for f, _ in r], 12)


@pytest.mark.parametrize("step", [1, 4])
def test_suppression_along_a_chain(spark, step):
    """Rising scores: every row falls or stays by its right neighbour, through all chunks up to the last one. And equal scores: by the left one."""
    rows = [(0, f * step, float(f)) for f in range(400)] + [(1, f * step, 1.0) for f in range(400)] + [(2, f * 40 * step, 1.0) for f in range(9)]
    df = frames(spark, rows, "match_id BIGINT, frame_idx BIGINT, score DOUBLE").repartition(3)
    got = greedy.suppress(df, ["match_id"], size=16).collect()
    for m in (0, 1, 2):
        assert sorted(x.frame_idx for x in got if x.match_id == m) == nms([(f, s) for k, f, s in rows if k == m], 5)


def test_cooldown_over_an_endless_island(spark):
    df = spark.range(0, 30_000).selectExpr("0L AS match_id", "id * 3 + id % 2 AS frame_idx")
    got = sorted(r.frame_idx for r in greedy.debounce(df, ["match_id"], step=12, size=512).collect())
    assert got == cool([i * 3 + i % 2 for i in range(30_000)], 12)


def test_suppression_reach_is_free(spark):
    rnd = random.Random(9)
    rows = [(0, f, rnd.random()) for f in sorted(rnd.sample(range(900), 500))]
    got = greedy.suppress(frames(spark, rows, "match_id BIGINT, frame_idx BIGINT, score DOUBLE"), ["match_id"], reach=9, size=25).collect()
    assert sorted(x.frame_idx for x in got) == nms([(f, s) for _, f, s in rows], 9)


@pytest.mark.parametrize("alpha", [1.0, 0.97, 0.3, 1e-6])
def test_decayed_sum_keeps_all_history(spark, alpha):
    from rallyframe.operators.scan import decayed_sum
    rnd = random.Random(7)
    x = [rnd.uniform(-5, 5) for _ in range(1500)]
    df = frames(spark, [(0, i + 1, v) for i, v in enumerate(x)], "match_id BIGINT, no BIGINT, x DOUBLE").repartition(4)
    got = {r.no: r.s for r in decayed_sum(df, ["match_id"], "no", 1 - alpha, 64, s=F.col("x")).collect()}
    s = 0.0
    for i, v in enumerate(x):
        s = (1 - alpha) * s + v
        assert got[i + 1] == pytest.approx(s, rel=1e-9, abs=1e-9)


def test_cooldown_edge(spark):
    df = frames(spark, [(0, f) for f in (0, 11, 12, 23, 24)], "match_id BIGINT, frame_idx BIGINT")
    assert sorted(r.frame_idx for r in greedy.debounce(df, ["match_id"]).collect()) == [0, 12, 24]


def test_runs_need_neighbours(spark):
    df = frames(spark, [(0, f, f in (1, 2, 3, 5, 8, 9)) for f in range(11)], "match_id BIGINT, frame_idx BIGINT, m BOOLEAN")
    got = {(r.run_start, r.run_end, r.length) for r in greedy.runs(df, ["match_id"], "frame_idx", "m", size=3).collect()}
    assert got == {(1, 3, 3), (5, 5, 1), (8, 9, 2)}


@pytest.mark.parametrize("steps", [1, 4096])
def test_percentiles_equal_numpy(spark, steps):
    rng = np.random.default_rng(3)
    groups = {"a": rng.normal(size=400).round(1), "b": np.repeat(4.0, 7), "c": rng.integers(0, 5, 90).astype(float), "d": np.array([1.0, 2.0, 10.0]), "e": np.array([0.0, -8.0, 8.0, 4.0, -1e-9, 1e12, 7.999999, 0.5])}
    df = frames(spark, [(k, float(v)) for k, vs in groups.items() for v in vs] + [("a", None)], "k STRING, v DOUBLE")
    got = {r.k: r for r in quantiles.percentiles(df, ["k"], "v", {"p50": .5, "p90": .9, "p95": .95}, steps=steps).collect()}
    for k, vs in groups.items():
        assert got[k].p50 == pytest.approx(np.percentile(vs, 50)) and got[k].p90 == pytest.approx(np.percentile(vs, 90)) and got[k].p95 == pytest.approx(np.percentile(vs, 95))
    assert got["d"].p90 == pytest.approx(8.4)


def reference_clean(track):
    """Plain walk over one track (None where missing)."""
    n = len(track)
    d = [-1.0] + [(-1.0 if track[i] is None or track[i - 1] is None else float(np.hypot(*np.subtract(track[i], track[i - 1])))) for i in range(1, n)]
    t = list(track)
    for i in range(n - 1):
        if d[i] > 100:
            if d[i + 1] > 100 or d[i + 1] == -1:
                t[i] = None
            elif i and d[i - 1] == -1:
                t[i - 1] = None
    known = [i for i in range(n) if t[i] is not None]
    cuts = [(p, q) for p, q in zip(known, known[1:]) if q - p > 1 and (q - p - 1 >= 4 or np.hypot(*np.subtract(t[p], t[q])) / (q - p - 1) > 80)]
    starts, ends = [0] + [q - 1 for _, q in cuts], [p + 1 for p, _ in cuts] + [n]
    out = list(t)
    for a, b in zip(starts, ends):
        inside = [i for i in known if a <= i < b]
        if b - a > 5 and len(inside) >= 2:
            for i in range(a, b):
                if t[i] is None:
                    out[i] = tuple(float(np.interp(i, inside, [t[j][c] for j in inside])) for c in (0, 1))
    return out


@pytest.mark.parametrize("size", [15, 8192])
def test_clean_track_equals_plain_walk(spark, size):
    rnd = random.Random(4)
    tracks = {}
    for m in range(6):
        x, y, t = 500.0, 300.0, []
        for _ in range(90):
            x, y = x + rnd.uniform(-30, 30), y + rnd.uniform(-30, 30)
            p = (x, y) if rnd.random() > 0.04 else (x + 300, y)
            t.append(None if rnd.random() < 0.3 else p)
        for a in (20, 60):
            for i in range(a, a + rnd.randint(3, 6)):
                t[i] = None
        tracks[m] = t
    rows = [(m, i, *(p or (None, None))) for m, t in tracks.items() for i, p in enumerate(t)]
    df = frames(spark, rows, "match_id BIGINT, frame_idx BIGINT, ball_px DOUBLE, ball_py DOUBLE")
    got = {(r.match_id, r.frame_idx): r for r in tracking.clean_track(df, size=size).collect()}
    for m, t in tracks.items():
        for i, p in enumerate(reference_clean(t)):
            r = got[m, i]
            assert (r.ball_px is None) == (p is None), (m, i)
            if p is not None:
                assert (r.ball_px, r.ball_py) == pytest.approx(p)


def test_ema_equals_fold(spark):
    rnd = random.Random(5)
    seq = [None if rnd.random() < 0.2 else rnd.uniform(0, 1000) for _ in range(500)]
    df = frames(spark, [(0, i, v, v) for i, v in enumerate(seq)], "match_id BIGINT, frame_idx BIGINT, x DOUBLE, y DOUBLE")
    got = {r.frame_idx: r.sx for r in tracking.ema_track(df, "x", "y", size=130).collect()}
    s = None
    for i, v in enumerate(seq):
        if v is not None:
            s = v if s is None else 0.3 * v + 0.7 * s
        assert got[i] == (None if s is None else pytest.approx(s, rel=1e-12))


def test_decaying_momentum_equals_walk(spark):
    rnd = random.Random(6)
    win = [rnd.choice(["player_a", "player_b"]) for _ in range(80)]
    df = frames(spark, [(0, i, w) for i, w in enumerate(win)], "match_id BIGINT, point_idx BIGINT, winner STRING")
    got = {r.point_idx: (r.a_momentum, r.b_momentum) for r in momentum.decaying_momentum(df, size=7).collect()}
    a = b = 0
    for i, w in enumerate(win):
        a, b = (a + 1, max(0, b - 1)) if w == "player_a" else (max(0, a - 1), b + 1)
        assert got[i] == (a, b)


def test_span_join_has_no_duplicates(spark):
    spans = frames(spark, [(0, 0, 0, 700), (0, 1, 650, 900), (1, 0, 5, 5)], "match_id BIGINT, point_idx BIGINT, start_frame BIGINT, end_frame BIGINT")
    rows = frames(spark, [(m, f) for m in (0, 1) for f in range(0, 1000, 5)], "match_id BIGINT, frame_idx BIGINT")
    got = scan.join_in_span(rows, spans, ["match_id"], "frame_idx", "start_frame", "end_frame", width=64)
    want = sum(1 for f in range(0, 1000, 5) for a, b in ((0, 700), (650, 900)) if a <= f <= b) + 1
    assert got.count() == want == got.distinct().count()


def test_result_does_not_depend_on_layout(spark, fx):
    """One match alone, other partitionings and other chunk sizes give the same rows."""
    f = fx.frames.select("match_id", "frame_idx", "ball_px", "ball_py")
    base = {tuple(r) for r in tracking.clean_track(f).collect()}
    assert base == {tuple(r) for r in tracking.clean_track(f.repartition(5, "frame_idx"), size=64).collect()}
    two = f.unionByName(f.withColumn("match_id", F.col("match_id") + 100))
    assert base == {tuple(r) for r in tracking.clean_track(two, size=100).filter("match_id < 100").collect()}
