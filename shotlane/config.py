"""All tunable numbers in one frozen record; defaults are the production values."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Settings:
    # regulation lane, metres
    lane_width_m: float = 1.0541
    lane_length_m: float = 18.288

    # ingest
    max_frames: int = 600
    max_dimension: int = 1024
    lane_max_dimension: int = 1280
    default_fps: float = 30.0
    default_start_frame: int = 40
    force_start_frame: bool = False
    min_confidence: float = 0.10
    max_lane_masks: int = 4

    # in-lane box
    x_margin_m: float = 0.15
    y_low_m: float = -0.20
    y_high_over_m: float = 0.40
    end_y_tol_m: float = 0.35
    contact_y_tol_m: float = 0.08

    # motion interval
    max_frame_gap: int = 36
    max_back_dy_m: float = -0.35
    max_step_dx_m: float = 0.42
    max_rate_dy_m: float = 0.75

    # lane candidates
    min_trapezoid_score: float = 0.20
    coverage_weight: float = 0.65
    support_bands: int = 14
    component_min_area: int = 300
    component_min_ratio: float = 0.03

    # lane tracker
    track_alpha: float = 0.3
    track_match_px: float = 80.0
    track_jump_px: float = 60.0
    stale_frames: int = 100_000
    observations_used: int = 40
    observations_min: int = 3

    # cleaning and departure
    smooth_sigma_m: float = 0.055
    fit_window: int = 5
    curve_window: int = 18
    max_departure_dx_m: float = 0.36
    quad_blend: float = 0.70
    quad_blend_strong: float = 0.82
    quad_exaggerate: float = 0.06
    curvature_cap: float = 0.20
    tail_weights: bool = True
    hook_inertia: bool = True

    # poses
    ema_alpha: float = 0.4


DEFAULT = Settings()

# The second published parameter set (overlay renderer) and the poster set.
OVERLAY = replace(
    DEFAULT,
    smooth_sigma_m=0.04,
    curve_window=14,
    max_departure_dx_m=0.28,
    quad_blend=0.65,
    quad_blend_strong=0.65,
    quad_exaggerate=0.0,
    curvature_cap=0.08,
    tail_weights=False,
    hook_inertia=False,
)
POSTER = replace(DEFAULT, stale_frames=30, observations_used=31, observations_min=5)
