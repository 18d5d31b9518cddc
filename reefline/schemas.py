"""Declared table schemas and the fixed parameters of the analyses."""

from __future__ import annotations

from dataclasses import dataclass

FRAMES = "project_id STRING, frame_idx INT, npy_file STRING, pic_file STRING, time TIMESTAMP_NTZ, med DOUBLE, std DOUBLE, gp BIGINT, lof BOOLEAN, rel_day INT"
MOVIES = "project_id STRING, base_name STRING, start_time TIMESTAMP_NTZ, end_time TIMESTAMP_NTZ, h264_file STRING, mp4_file STRING, pic_file STRING, framerate DOUBLE, width INT, height INT"
DEPTH_CELLS = "project_id STRING, frame_idx INT, y INT, x INT, depth DOUBLE"
DEPTH_SAMPLES = "project_id STRING, window_end TIMESTAMP_NTZ, sample INT, y INT, x INT, raw BIGINT"
CLUSTERS = "project_id STRING, LID BIGINT, VideoID STRING, ClipName STRING, ClipCreated STRING, TimeStamp TIMESTAMP_NTZ, t DOUBLE, X DOUBLE, Y DOUBLE, X_span DOUBLE, Y_span DOUBLE, Prediction STRING, Confidence DOUBLE, modelID STRING"
PREDICTIONS = "VideoFile STRING, Prediction STRING, Confidence DOUBLE"
DETECTIONS = "base_name STRING, frame INT, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE, score DOUBLE, class_id DOUBLE, tracked BOOLEAN"
TRACKS = "base_name STRING, track_id BIGINT, frame INT, xc DOUBLE, yc DOUBLE, w DOUBLE, h DOUBLE, class_id DOUBLE, u_dot DOUBLE, v_dot DOUBLE, s_dot DOUBLE, p_value DOUBLE"
TRACK_SUMMARY = "track_id BIGINT, track_length BIGINT, base_name STRING, Reflection DOUBLE, p_value DOUBLE, InBounds DOUBLE"
EVENTS_REF = "pid STRING, dissection_time TIMESTAMP_NTZ, behave_or_control STRING"
STATES = "projectID STRING, Directory STRING, Notes STRING, tankID STRING, RunAnalysis STRING, StartingFiles STRING, Prep STRING, Depth STRING, Cluster STRING, ClusterClassification STRING, TrackFish STRING, Summary STRING"
HEARTBEATS = "RaspberryPiID STRING, TankID STRING, Status STRING, User STRING, Ping TIMESTAMP_NTZ"


@dataclass(frozen=True)
class Params:
    """Thresholds of the analyses (fixed values)."""

    pixel_length: float = 0.1030168618  # cm
    hourly_depth: float = 0.2
    daily_depth: float = 0.4
    total_depth: float = 1.0
    hourly_density: float = 0.6
    daily_density: float = 1.2
    total_density: float = 3.0
    min_pixels: int = 1000
    good_fraction: float = 0.8
    sparse_fraction: float = 0.95
    max_std: float = 1.5
    max_depth: float = 4.0
    max_height: float = 8.0
    savgol_window: int = 71
    savgol_order: int = 4
    day_start: int = 8
    day_stop: int = 18
    frame_rate: float = 29.0
    index_fraction: float = 0.1
    half_window: float = 0.5
    min_track: int = 30

    @property
    def area(self) -> float:
        return self.pixel_length**2


PARAMS = Params()

#: Behaviour codes and their labels, fixed values.
BEHAVIOURS = {"c": "bower scoop", "p": "bower spit", "b": "bower multiple", "f": "feed scoop", "t": "feed spit", "m": "feed multiple", "s": "spawn", "d": "sand drop", "o": "fish other", "x": "other"}
CATEGORIES = {"c": "Construction", "p": "Construction", "b": "Construction", "f": "Feeding", "t": "Feeding", "m": "Feeding", "s": "Quivering", "d": "Other", "o": "Other", "x": "Other"}
