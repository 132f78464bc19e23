"""End-to-end jobs: the compositions a user calls."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotlane.config import DEFAULT, Settings
from shotlane.functions import geometry as G
from shotlane.operators import evaluate as ev
from shotlane.operators import frames as fr
from shotlane.operators import lanes as ln
from shotlane.operators import masks as mk
from shotlane.operators import packs
from shotlane.operators import poses as ps
from shotlane.operators import sequences as sq
from shotlane.operators import store as st
from shotlane.operators.kinematics import kinematics_per_quarter
from shotlane.operators.smoothing import append_departure, smooth_trajectory
from shotlane.operators.trim import ball_path_score, trim_detections, trim_diagnostics
from shotlane.session import cut


@dataclass(frozen=True)
class ShotAnalysis:
    positions: DataFrame
    kinematics: DataFrame
    homographies: DataFrame
    health: DataFrame
    diagnostics: DataFrame
    rejects: DataFrame


def clean_positions(raw: DataFrame, fps="fps", conf: Settings = DEFAULT) -> DataFrame:
    """Trim, smooth and extend raw ball positions (shot_id, frame_index, timestamp_s, x_m, y_m, fps)."""
    raw = sq.first_per_frame(raw.withColumn("fps", F.col(fps)))
    smooth = smooth_trajectory(trim_detections(raw, conf), F.col("fps"), conf)
    return append_departure(smooth, F.col("fps"), conf)


def analyse_positions(raw: DataFrame, fps="fps", conf: Settings = DEFAULT) -> DataFrame:
    return kinematics_per_quarter(clean_positions(raw, fps, conf), conf)


def _lane_candidates(lane_runs: DataFrame, top: DataFrame, shots: DataFrame, conf: Settings) -> DataFrame:
    """Scored candidates (``top``: the masks that may be some) with a reason for each rejected one; masks are joined and written packed, not run by run."""
    runs = packs.pack(lane_runs, mk.MASK, mk.RUN).join(top.select(*mk.MASK), mk.MASK)
    # read by two steps below, one row per mask: written once instead of relabelled each time
    clean = cut(mk.significant_components(runs, conf, packed=True), "lane-masks")
    sizes = top.select(*mk.MASK, "lane_no").join(shots.select("shot_id", "height", "width"), "shot_id")
    # the corners are ordered before they are written, not by each of their readers
    ordered = F.when(F.col("polygon").isNotNull(), G.order_quad(F.col("polygon")))
    quads = cut(mk.quad_from_boundaries(clean, sizes, whole=True).withColumn("polygon", ordered), "mask-quads")
    found = quads.where("polygon is not null").drop("reason")
    scored = ln.validate_candidates(mk.evaluate_trapezoid(clean, found, conf=conf), conf)
    bad = quads.where("polygon is null").select(*mk.MASK, "lane_no", "height", "width", "reason")
    return scored.unionByName(bad, allowMissingColumns=True)


def analyse_shots(runs: DataFrame, shots: DataFrame, conf: Settings = DEFAULT) -> ShotAnalysis:
    """Masks of many shots to ball positions, kinematics, lane geometry and health.

    runs: mask rows (shot_id, frame_index, det_id, class_name, y, x0, x1) of
    frames already cut to the frame cap.  shots: shot_id, fps, height, width,
    frames, and the sensor result (sd_key, contact_frame).
    The lane side looks at every frame, the ball side from the contact frame on.
    """
    ranges = fr.frame_ranges(shots, conf, job="lane")
    lane_runs = runs.where(F.col("class_name") == "lane")
    balls = mk.mask_boxes(runs.where(F.col("class_name") == "ball"))
    pins = mk.mask_boxes(runs.where(F.col("class_name") == "pins"))
    top = cut(ln.top_lane_masks(mk.mask_area(lane_runs), conf.max_lane_masks), "top-masks")
    # candidates feed the tracker, the observations and the reject counts: made once
    cands = cut(_lane_candidates(lane_runs, top, shots, conf), "candidates")
    # read by the tracker, the votes, the tracks, the observations and the frames of the best
    passed = cut(ln.penalise_nested(cands.where("reason is null"), order="lane_no"), "passed")
    ok = passed.where(F.col("score") >= conf.min_trapezoid_score)
    late_rejects = passed.where(F.col("score") < conf.min_trapezoid_score).withColumn("reason", F.lit("below_min_score_after_nested"))
    rejects = ln.reject_counts(cands.unionByName(late_rejects.select(*cands.columns)))
    ok = ok.withColumn("centroid_x", G.centroid_x(F.col("polygon")))
    assigned = ln.track_lanes(ok, conf, order="lane_no")
    assigned = cut(assigned, "assigned")
    votes = ln.ball_votes(ok.join(assigned.select(*mk.MASK, "track_id"), mk.MASK), balls, order="lane_no")
    tracks = cut(ln.lane_quality(ln.summarise_tracks(assigned, ok, votes, order="lane_no")), "tracks")
    obs = ln.nearest_pins(ok, pins)
    matched = ln.match_observations(obs, tracks)
    stable = ln.aggregate_quad(matched, conf)
    n_obs = matched.groupBy(*ln.TRACK).agg(F.count(F.lit(1)).alias("matched"))
    quads = tracks.join(stable.select(*ln.TRACK, F.col("polygon").alias("_stable")), ln.TRACK, "left").join(n_obs, ln.TRACK, "left")
    quads = quads.withColumn("polygon", F.coalesce("_stable", "best_quad")).withColumn("homography", G.homography(F.col("polygon"), conf.lane_width_m, conf.lane_length_m))
    quads = cut(quads.join(ranges.select("shot_id", "fps", "lane_start_frame"), "shot_id"), "lane-quads")
    contacts = mk.mask_contact(runs.where(F.col("class_name") == "ball")).join(ranges.select("shot_id", "lane_start_frame"), "shot_id").where("frame_index >= lane_start_frame")
    chosen = ln.choose_contact(contacts, quads)
    raw = cut(ln.project_ball(chosen, quads.select(*ln.TRACK, "homography", "fps")), "ball-positions")
    scores = quads.join(ball_path_score(raw, conf, ln.TRACK), ln.TRACK, "left").withColumn("ball_score", F.coalesce("ball_score", F.lit(0.0)))
    scores = ln.track_metrics(scores.withColumn("bottom_width", G.bottom_width(F.col("polygon"))))
    active = cut(ln.select_track(scores).where("track_rank = 1"), "active-lanes")
    at_best = ok.groupBy("shot_id", F.col("frame_index").alias("best_frame")).agg(F.count(F.lit(1)).alias("_here"))
    active = active.join(at_best, ["shot_id", "best_frame"], "left").withColumn(
        "lane_polygons", F.greatest(F.coalesce("matched", F.lit(0)), F.coalesce("_here", F.lit(1))))
    mine = raw.join(active.select(*ln.TRACK, "fps"), ln.TRACK)
    mine = cut(sq.clip_positions(mine.select("shot_id", "frame_index", "timestamp_s", "x_m", "y_m", "fps"), conf), "active-positions")
    positions = cut(clean_positions(mine, "fps", conf), "clean-positions")
    every = shots.where("frames > 0").select("shot_id", "height", "width", F.explode(F.sequence(F.lit(0), F.col("frames") - 1)).alias("frame_index"))
    per_frame = mk.coverage_ratio(every, top.where("det_id IS NOT NULL"))
    health = ln.health_report(shots, per_frame, active, mine)
    kin = kinematics_per_quarter(positions, conf)
    # a shot without positions still answers with four zero quarters
    none = shots.join(positions.select("shot_id").distinct(), "shot_id", "left_anti").select(
        "shot_id", F.array().cast("array<struct<x:double,y:double>>").alias("ball_positions"), F.lit(conf.default_fps).alias("fps"))
    from shotlane.operators.kinematics import kinematics_from_points

    kin = kin.unionByName(kinematics_from_points(none, conf=conf))
    homs = active.select(
        "shot_id", "track_id", F.col("best_frame").alias("homography_frame"), "polygon", "homography", "lane_polygons", "selection_reason",
        F.lit(True).alias("is_trapezoid"))
    return ShotAnalysis(positions, kin, homs, health, trim_diagnostics(sq.first_per_frame(mine.drop("fps")), conf), rejects)


def analyse_poses(joints: DataFrame, shots: DataFrame, conf: Settings = DEFAULT, smooth: bool = True, order: Sequence[str] | None = None) -> DataFrame:
    """Joints before each shot's body stop frame, smoothed (the aggregate job asks for them raw); ``order``: columns of arrival, where a joint may repeat in a frame."""
    cut_off = fr.cut_body_frames(joints, fr.frame_ranges(shots, conf, job="body"))
    return ps.ema(cut_off, conf.ema_alpha, order=order) if smooth else cut_off.select(*ps.BODY, "frame_index", "x", "y", "z")


def analysed_sections(runs: DataFrame, shots: ShotAnalysis, poses: DataFrame) -> DataFrame:
    """The stored form of a job: updates for ``store.upsert_run_sections`` with points, kinematics, bodies and health of every run (shot_id, name, video_key, sd_key, fps, updated_at)."""
    return st.section_updates(runs, shots.positions, shots.kinematics, poses, shots.homographies, shots.health)


def query_lane_ball(shots: DataFrame, runs: DataFrame, numbers: Sequence[int], names: Sequence[str], conf: Settings = DEFAULT) -> DataFrame:
    a = st.shot_answers(st.query_shots(shots, numbers, "laneballs"), conf).drop("skeleton_points")
    return st.union_answers(a, st.run_section_answers(st.query_runs(runs, names), "laneballs", st.LANE_PAYLOAD))


def query_poses(shots: DataFrame, runs: DataFrame, numbers: Sequence[int], names: Sequence[str], conf: Settings = DEFAULT) -> DataFrame:
    a = st.shot_answers(st.query_shots(shots, numbers, "fourdbody"), conf).select("kind", "key", "fps", "skeleton_points")
    return st.union_answers(a, st.run_section_answers(st.query_runs(runs, names), "fourdbody", st.BODY_PAYLOAD))


def query_aggregate(shots: DataFrame, runs: DataFrame, numbers: Sequence[int], names: Sequence[str], conf: Settings = DEFAULT) -> DataFrame:
    a = st.shot_answers(st.query_shots(shots, numbers, "aggregated"), conf).drop("fps")
    r = st.merge_sections(st.query_runs(runs, names), ["asked_name"]).select(
        F.lit("run").alias("kind"), F.col("asked_name").alias("key"), "ball_points", "kinematics_table", "skeleton_points")
    return st.union_answers(a, r)


def list_names(runs: DataFrame) -> DataFrame:
    return st.list_names(runs)


@dataclass(frozen=True)
class Evaluation:
    fractions: DataFrame
    episodes: DataFrame
    summary: DataFrame


def evaluate(pred: DataFrame, truth: DataFrame, modes: Sequence[str] = ("none", "linear", "cubic")) -> Evaluation:
    """Predicted view positions against ground truth, every episode and interpolation mode in one plan.

    pred: episode_idx, frame_index, timestamp_s, x_m, y_m (view units).
    """
    return Evaluation(*ev.report(pred, truth, modes))
