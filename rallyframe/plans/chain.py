"""The main path from detections to points, stage by stage, on the tracking tables.

Stages read by several later ones are written once (``pin``): the frames, the calibration, the projected track, the events.
"""
from __future__ import annotations

from functools import cached_property

from rallyframe.fixtures import Fixtures
from rallyframe.operators import calibrate, events, players, points, shots, tracking
from rallyframe.session import pin


class Chain:
    def __init__(self, fx: Fixtures):
        self.fx = fx
        fx.keep_frames()

    @cached_property
    def homography(self):
        return pin(calibrate.calibrate(self.fx.keypoints))

    @cached_property
    def clean(self):
        return tracking.clean_track(self.fx.frames.select("match_id", "frame_idx", "fps", "ball_px", "ball_py"))

    @cached_property
    def physics(self):
        return tracking.ball_physics(tracking.project_track(self.clean, self.homography))

    @cached_property
    def physics_table(self):
        return pin(self.physics)

    @cached_property
    def candidates(self):
        return events.candidates(self.physics)

    @cached_property
    def nms(self):
        return events.temporal_nms(self.candidates)

    @cached_property
    def located(self):
        return players.locate(self.fx.detections, self.homography)

    @cached_property
    def players(self):
        return players.carry(players.by_frame(self.located, "frame_height"), self.fx.frames, keep=["fps"])

    @cached_property
    def spots(self):
        """Court positions of both players in every frame; the rest of their boxes stays behind."""
        return players.carry(players.by_frame(self.located, "frame_height", keep=["foot_x", "foot_y"]), self.fx.frames)

    @cached_property
    def found(self):
        """Events before their players, for what does not ask who hit."""
        return pin(events.cross_dedup(pin(self.nms)))

    @cached_property
    def events(self):
        return pin(events.assign_players(self.found, self.spots))

    @cached_property
    def points(self):
        return points.segment_points(self.events, self.fx.frames.select("match_id", "fps").distinct(), self.homography)

    @cached_property
    def contacts(self):
        return shots.detect_contacts(self.physics_table, self.spots)
