"""Work and files that must not grow faster than the input."""
import numpy as np
from pyspark.sql import functions as F

from rallyframe import constants as K
from rallyframe.fixtures import Fixtures
from rallyframe.operators import calibrate, curation, heatmaps, history, players, scan, stats
from rallyframe.plans import all_queries, q_streaming
from rallyframe.plans.chain import Chain
from rallyframe.sources import labels, sinks

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_frames_are_derived_once(spark):
    fx = Fixtures(spark, SMALL)
    rows = fx.frames.count()
    Chain(fx), Chain(fx)
    assert "Window" not in plan(fx.keypoints) and "Window" not in plan(fx.detections)
    assert fx.frames.count() == rows


def test_fits_and_median_errors_against_brute_force():
    rng = np.random.default_rng(5)
    ref = np.array(K.COURT_KEYPOINTS, float) / calibrate.UNIT
    p = np.column_stack([ref, np.ones(14)]) @ np.array([[.5, .01, .1], [0, .25, .05], [.01, .04, 1]]).T
    x, y = (p[:, c] / p[:, 2] + rng.normal(0, 1e-2, (200, 14)) for c in (0, 1))
    x[rng.random(x.shape) < 0.1] = np.nan
    y[np.isnan(x)] = np.nan
    fits = calibrate._fit_all(x, y, ref)
    errors = calibrate._median_errors(x, y, fits, ref)
    for n in range(len(x)):
        for i, q in enumerate(calibrate.CORNERS):
            assert np.isnan(fits[n, i]).all() == np.isnan(x[n, q]).any()
            if np.isnan(fits[n, i]).any():
                assert np.isnan(errors[n, i])
                continue
            at = np.column_stack([ref, np.ones(14)]) @ fits[n, i].T
            d = np.hypot(at[:, 0] / at[:, 2] - x[n], at[:, 1] / at[:, 2] - y[n])
            assert np.allclose(d[q], 0, atol=1e-9)
            rest = np.setdiff1d(np.arange(14), q)
            assert np.isclose(errors[n, i], np.nanmedian(d[rest]))


def test_three_corners_on_a_point_make_no_fit():
    ref = np.array(K.COURT_KEYPOINTS, float) / calibrate.UNIT
    assert np.isnan(calibrate._fit_all(np.full((1, 14), 0.3), np.full((1, 14), 0.4), ref)).all()


def test_inverses_come_with_the_fits(spark, fx):
    """The same bits as the column arithmetic, which took as long as all fits of a frame."""
    rows = calibrate.frame_fits(fx.keypoints.where("match_id = 0")).where("matrix IS NOT NULL").select("inverse", calibrate.invert(F.col("matrix")).alias("want")).collect()
    assert rows and all(r.inverse == r.want for r in rows)
    singular = calibrate._inverses(np.array([[1., 2, 3, 2, 4, 6, 0, 0, 1], [1, 0, 0, 0, 1, 0, 0, 0, 1]]))
    assert np.isnan(singular[0]).all() and singular[1].tolist() == [1, 0, 0, 0, 1, 0, 0, 0, 1]


def test_frames_go_to_their_buckets_without_their_pieces(spark):
    """A frame meets others once a band, so what goes with it counts eleven times: its id, its hash and a number for the bucket."""
    data = [(1, [5] + [0] * 7), (2, [5] + [1 << 31] * 7), (3, [9] * 8)]
    d = curation._in_buckets(spark.createDataFrame(data, "id BIGINT, w ARRAY<BIGINT>"))
    assert dict(d.dtypes) == {"key": "bigint", "id": "bigint", "w": "array<bigint>", "band": "int", "n": "bigint"}
    bits = {i: "".join(f"{x:032b}" for x in w) for i, w in data}
    piece = lambda i, k: bits[i][256 * k // 11:256 * (k + 1) // 11]
    want = {(k, i) for k in range(11) for i in bits if any(piece(i, k) == piece(j, k) for j in bits if j != i)}
    assert {(r.band, r.id) for r in d.collect()} == want and 0 < len(want) < 33


def test_a_folder_is_not_written_by_every_task(spark, tmp_path):
    d = spark.range(4000).repartition(8).select((F.col("id") % 5).alias("run"), "id")
    sinks.write_json(d, str(tmp_path / "rows"), ["run"])
    folders = list((tmp_path / "rows").glob("run=*"))
    assert len(folders) == 5 and all(len(list(f.glob("*.json"))) == 1 for f in folders)
    assert spark.read.json(str(tmp_path / "rows")).count() == 4000


def test_label_reader_has_no_task_per_match(spark, tmp_path):
    lines = spark.range(300).select((F.col("id") % 150).alias("match_id"), F.col("id").alias("frame_idx"), F.explode(F.array(F.lit(1), F.lit(0))).alias("box_no"))
    lines = lines.withColumn("box_no", F.col("box_no").cast("bigint")).withColumn("line", F.concat(F.col("box_no"), F.lit(" 0.5 0.25 0.1 0.2")))
    labels.write_label_files(lines, str(tmp_path / "labels"))
    assert (tmp_path / "labels" / "7" / "157.txt").read_text() == "0 0.5 0.25 0.1 0.2\n1 0.5 0.25 0.1 0.2\n"
    parts = labels.LabelReader(str(tmp_path / "labels"), 4).partitions()
    assert len(parts) == 4 * labels.GROUPS
    got = labels.read_label_files(spark, str(tmp_path / "labels")).collect()
    assert sorted((r.match_id, r.frame_idx, r.class_id) for r in got) == sorted((i % 150, i, c) for i in range(300) for c in (0, 1))


def test_a_rerun_of_segments_reads_the_track_that_is_there(spark, monkeypatch):
    seen, calibrated = [], calibrate.calibrate
    monkeypatch.setattr(calibrate, "calibrate", lambda *a, **k: seen.append(1) or calibrated(*a, **k))
    assert all_queries()["stream_merge"](spark, SMALL).count() > 0 and len(seen) == 1
    assert q_streaming.FILES == 4


def test_blur_takes_a_grid_at_once(spark):
    rng = np.random.default_rng(2)
    cells = {(int(a), int(b)): int(n) for a, b, n in zip(rng.integers(0, 64, 90), rng.integers(0, 64, 90), rng.integers(1, 50, 90))} | {(0, 63): 7, (63, 0): 3, (1, 1): 4}
    d = spark.createDataFrame([(1, 0, a, b, n) for (a, b), n in cells.items()] + [(2, 1, 5, 5, 9)], "match_id bigint, set_no bigint, xb bigint, yb bigint, n bigint")
    out = heatmaps.blurred_density(d)
    assert "Generate" not in plan(out)
    grid = np.zeros((64, 64))
    for (a, b), n in cells.items():
        grid[a, b] = n
    pad, want = np.pad(grid, 3, mode="reflect"), np.zeros((64, 64))
    for i, u in enumerate(heatmaps.BLUR):
        for j, v in enumerate(heatmaps.BLUR):
            want += u * v * pad[i:i + 64, j:j + 64]
    got = {(r.xb, r.yb): (r.heat, r.density) for r in out.where("match_id = 1").collect()}
    assert got == {(int(a), int(b)): (want[a, b], want[a, b] / want.max()) for a, b in zip(*np.nonzero(want))}
    assert out.where("match_id = 2").count() == 49


def test_a_small_loss_keeps_its_sign(spark):
    rows = [(f"p{i}", i, "player_a", "2024-01-01", b, None, None, 0.1, 0.5, 80.0, 10, "serve") for i, b in enumerate((0.3, 0.3006, 0.3006))]
    d = spark.createDataFrame(rows, "player_id string, job_id bigint, player_key string, match_date string, backhand double, forehand double, rally_79 double, rally_10 double, "
                                    "first_serve double, speed_kmh double, total_shots bigint, dominant_pattern string")
    text = {r.job_id: r.summary for r in history.summary_lines(d).collect()}
    assert text[0].endswith(" error -0.0 percentage points.") and text[1].endswith(" error +0.0 percentage points.")


def test_keys_are_folded_without_a_call_of_pandas_for_each(spark):
    """A task holds thousands of matches; keys may go on over Arrow batches, and null is a key."""
    rows = [(k, c, float(c % 7)) for k in (None, *range(40)) for c in range((k or 3) % 11 + 1)]
    d = spark.createDataFrame(rows, "k bigint, _chunk bigint, e double").repartition(5)
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        out = scan.fold_chunks(d, ["k"], lambda r: {"so_far": r["e"].cumsum().tolist(), "last": [None, *r["_chunk"].tolist()[:-1]]}, "so_far double, last long")
        assert "FlatMapGroupsInPandas" not in plan(out)
        got = sorted(((r.k is None, r.k or 0, r._chunk, r.so_far, r.last) for r in out.collect()), key=lambda r: r[:3])
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    want = sorted(((k is None, k or 0, c, sum(x % 7.0 for x in range(c + 1)), c - 1 if c else None) for k, c, _ in rows), key=lambda r: r[:3])
    assert got == want


def test_frame_table_reads_the_players_once(spark):
    on = "match_id bigint, frame_idx bigint"
    track = spark.createDataFrame([(1, f) for f in range(4)], on)
    hom = spark.createDataFrame([(1, 0, 14, 0.5, 1.0, True, False)], f"{on}, detected bigint, error double, confidence double, reliable boolean, carried boolean")
    found = [(1, 0, "player_a", 1.0, 2.0), (1, 0, "player_b", 3.0, 4.0), (1, 1, "player_b", None, None), (1, 3, "player_a", 5.0, 6.0)]
    d = stats.frame_table(track, hom, spark.createDataFrame(found, f"{on}, label string, foot_x double, foot_y double"))
    assert d._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 3
    got = {r.frame_idx: (r.has_a, r.a_x, r.a_y, r.has_b, r.b_x, r.b_y) for r in d.collect()}
    assert got == {0: (True, 1.0, 2.0, True, 3.0, 4.0), 1: (False, None, None, True, None, None), 2: (False, None, None, False, None, None), 3: (True, 5.0, 6.0, False, None, None)}


def test_chunks_are_walked_in_the_order_of_their_rows(spark):
    """Suppression folds the rows of a chunk as well: any order, and lists as results."""
    d = spark.createDataFrame([(k, c, (7 * a) % 10) for k in range(3) for c in range(2) for a in range(10)], "k bigint, _chunk bigint, _at bigint").repartition(4)
    out = scan.fold_chunks(d, ["k", "_chunk"], lambda r: {"seen": [list(range(n)) if n % 2 else None for n in r["_at"]]}, "seen array<int>", "_at")
    got = sorted((r.k, r._chunk, r._at, r.seen) for r in out.collect())
    assert got == [(k, c, a, list(range(a)) if a % 2 else None) for k in range(3) for c in range(2) for a in range(10)]


def test_hit_deltas_do_without_the_players(spark, monkeypatch):
    def asked(self):
        raise AssertionError("players are not asked for")
    monkeypatch.setattr(Chain, "located", property(asked))
    for name in ("hit_speed_deltas", "rally_sessions", "bounce_call_at_frame"):
        assert all_queries()[name](spark, SMALL).count() > 0


def test_players_of_a_frame_stay_where_it_was_joined(spark):
    on = "match_id bigint, frame_idx bigint"
    box = lambda f, slot, y, w, c=0.9: (1, f, slot, 10.0, y - 10, 10.0 + w, y, c, slot)
    found = spark.createDataFrame([box(0, 0, 800.0, 5), box(0, 1, 700.0, 9), box(0, 3, 700.0, 9), box(0, 2, 100.0, 3), box(2, 0, 900.0, 4), box(3, 0, 900.0, 4, 0.1)],
                                  f"{on}, slot int, x1 double, y1 double, x2 double, y2 double, confidence double, track_id int")
    hom = spark.createDataFrame([(1, f, False, None) for f in range(4)], f"{on}, reliable boolean, inverse array<double>")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        d = players.by_frame(players.locate(found, hom), keep=["track_id"])
        assert plan(d).count("Exchange hashpartitioning") == 2
        got = [tuple(r) for r in players.carry(d, hom.select("match_id", "frame_idx")).orderBy("frame_idx", "label").collect()]
        seen = [(r.frame_idx, r.label, r.track_id) for r in players.choose(players.locate(found, hom)).orderBy("frame_idx", "label").collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    a, b = "player_a", "player_b"
    assert got == [(1, 0, a, 1, False), (1, 0, b, 2, False), (1, 1, a, 1, True), (1, 1, b, 2, True), (1, 2, a, 0, False), (1, 2, b, 2, True), (1, 3, a, 0, True), (1, 3, b, 2, True)]
    assert seen == [(0, a, 1), (0, b, 2), (2, a, 0)]
