"""Registered queries against DuckDB. A sample by default, all of them with RALLYFRAME_FULL=1."""
import os

import pytest
from conftest import SMALL
from oracle_check import compare, connect

from rallyframe.plans import all_oracles, all_queries, coverage

FULL = os.environ.get("RALLYFRAME_FULL") == "1"
SAMPLE = ["in_out_calls", "track_interpolated", "event_cross_dedup", "point_records", "contacts", "serve_summary", "error_by_rally", "movement_stats",
          "ball_heatmap", "momentum_decay", "confirmed_weakness", "near_dup_frames", "shard_qc", "next_action", "review_applied", "player_card", "stream_merge",
          "calibration", "fitted_matrices", "label_files", "delete_together", "merged_from_segments", "stream_late_rows"]


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(all_oracles()) if FULL else SAMPLE)
def test_matches_oracle(spark, con, name):
    message, _ = compare(all_queries()[name](spark, SMALL), con, all_oracles()[name])
    assert message is None, message


def test_fixture_tables_match_their_sql(spark, con, fx):
    from rallyframe.plans.registry import with_ctes
    for name in ("frames", "detections", "shots", "points", "feedback", "segments", "notes", "boxes", "evals"):
        message, rows = compare(getattr(fx, name), con, with_ctes(f"SELECT * FROM fx_{name}"))
        assert message is None and rows > 0, (name, message)


def test_every_query_names_its_survey_rows():
    assert set(coverage()) == set(all_queries())
    assert all(coverage().values())


def test_entry(spark):
    import __spark_entry__ as e
    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
