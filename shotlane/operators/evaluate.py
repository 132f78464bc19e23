"""Lane metrics, calibration and accuracy against ground truth."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shotlane.config import DEFAULT, Settings
from shotlane.operators.sequences import SHOT, gradient, hypot, in_lane, orient
from shotlane.operators.smoothing import resample

FRACTIONS = (0.25, 0.5, 0.75, 1.0)
EPISODE = ["episode_idx"]
METRICS = ("vel_s", "vel_l", "speed", "acc_s", "acc_l", "accel_mag")


# ---- lane metrics ----------------------------------------------------------

def _picks(values: Sequence[str], fractions: Sequence[float], s: str = "s", seq: str = "seq") -> Column:
    """Aggregate: an array with the row nearest to each fraction of the way; rows carry _target0 and _length."""
    row = F.struct(F.col(s).alias("frac_position"), *[F.col(v) for v in values])
    near = lambda f: F.struct(F.abs(F.col(s) - F.col("_target0") - f * F.col("_length")).alias("d"), F.col(seq))
    held = [min(max(float(f), 0.0), 1.0) for f in fractions]
    return F.array(*[F.struct(F.lit(f).alias("fraction"), F.min_by(row, near(f)).alias("_r")) for f in held])


def sample_at_fractions(traj: DataFrame, values: Sequence[str], start: Column, length: Column, fractions: Sequence[float] = FRACTIONS, keys: Sequence[str] = SHOT, s: str = "s", seq: str = "seq") -> DataFrame:
    """The sample nearest to each fraction of the way; the earliest of equal distances.

    One grouping with one minimum per fraction; start and length are per-shot expressions.
    """
    rows = traj.withColumn("_target0", start).withColumn("_length", length)
    return rows.groupBy(*keys).agg(_picks(values, fractions, s, seq).alias("_f")).select(*keys, F.inline("_f")).select(*keys, "fraction", "_r.*")


def _with_motion(rows: DataFrame, dt: Column, keys: Sequence[str], s: str, l: str, order: str) -> DataFrame:
    v = gradient(rows, {s: "vel_s", l: "vel_l"}, dt, keys, order)
    a = gradient(v, {"vel_s": "acc_s", "vel_l": "acc_l"}, dt, keys, order)
    return a.withColumn("speed", hypot(F.col("vel_s"), F.col("vel_l"))).withColumn("accel_mag", hypot(F.col("acc_s"), F.col("acc_l")))


def _profiled(grid: DataFrame, keys: Sequence[str]) -> DataFrame:
    whole = Window.partitionBy(*keys)
    rows = orient(grid, keys, order="grid_no")
    n = F.count(F.lit(1)).over(whole)
    dt = (F.max("timestamp_s").over(whole) - F.min("timestamp_s").over(whole)) / F.nullif(n - 1, F.lit(0))
    rows = (
        rows.withColumn("dt", dt).withColumn("_s0", F.min_by("s", "seq").over(whole))
        .withColumn("_len", F.max_by("s", "seq").over(whole) - F.col("_s0")).where("dt > 0 and _len > 0")
    )
    return _with_motion(rows, F.col("dt"), keys, "s", "l", "seq")


def motion_profile(traj: DataFrame, mode: str = "none", keys: Sequence[str] = SHOT) -> DataFrame:
    """Oriented, evenly timed samples with velocity and acceleration; shots of fewer than two points or no length give none."""
    return _profiled(resample(traj, mode, keys=keys), keys)


def motion_profiles(traj: DataFrame, modes: Sequence[str], keys: Sequence[str] = SHOT) -> DataFrame:
    """The profiles of several interpolation modes as one table with column interpolation_mode; a mode named twice counts once."""
    one = traj.select(*keys, "timestamp_s", "x_m", "y_m").repartition(*keys)  # the modes share this exchange
    parts = [resample(one, m, keys=keys).withColumn("interpolation_mode", F.lit(m)) for m in dict.fromkeys(modes)]
    # by key alone: the windows of a mode and the joins of an episode need no other exchange
    return _profiled(reduce(DataFrame.unionByName, parts).repartition(*keys), ["interpolation_mode", *keys])


def _at_ends() -> list[Column]:
    return [F.abs(F.max_by("l", "seq") - F.min_by("l", "seq")).alias("total_break"), F.max_by("speed", "seq").alias("end_speed")]


def episode_rows(profile: DataFrame, keys: Sequence[str], fractions: Sequence[float] = FRACTIONS) -> DataFrame:
    """One row per key from one grouping: ``at`` (an array with the measures at each fraction), total_break, end_speed and primary_axis, if the profile has it."""
    axis = [F.first("primary_axis").alias("primary_axis")] if "primary_axis" in profile.columns else []
    rows = profile.withColumns({"_target0": F.col("_s0"), "_length": F.col("_len")})
    return rows.groupBy(*keys).agg(_picks(METRICS, fractions).alias("at"), *_at_ends(), *axis)


def lane_metrics(traj: DataFrame, mode: str = "none", fractions: Sequence[float] = FRACTIONS, keys: Sequence[str] = SHOT) -> DataFrame:
    """Position, velocity and acceleration at each lane fraction."""
    return sample_at_fractions(motion_profile(traj, mode, keys), METRICS, F.col("_s0"), F.col("_len"), fractions, keys)


def lane_summary(traj: DataFrame, mode: str = "none", keys: Sequence[str] = SHOT) -> DataFrame:
    """Total break, end speed, primary axis and direction per shot."""
    return motion_profile(traj, mode, keys).groupBy(*keys).agg(
        *_at_ends(), F.first("primary_axis").alias("primary_axis"), F.first("trajectory_reversed").alias("trajectory_reversed"))


def truth_profile(truth: DataFrame, fps: float = 30.0, keys: Sequence[str] = EPISODE) -> DataFrame:
    """Ground truth rows with velocity and acceleration, in lane coordinates: lane_s along, y across."""
    whole = Window.partitionBy(*keys)
    rows = truth.withColumn("seq", F.col("global_frame_idx")).withColumn("s", F.col("lane_s")).withColumn("l", F.col("y"))
    rows = rows.withColumn("_s0", F.min("s").over(whole)).withColumn("_len", F.max("s").over(whole) - F.col("_s0"))
    return _with_motion(rows, F.lit(1.0 / fps), keys, "s", "l", "seq")


def truth_metrics(truth: DataFrame, fractions: Sequence[float] = FRACTIONS, fps: float = 30.0, keys: Sequence[str] = EPISODE) -> tuple[DataFrame, DataFrame]:
    """(fraction rows, summary rows) of the ground truth."""
    rows = truth_profile(truth, fps, keys)
    return sample_at_fractions(rows, METRICS, F.col("_s0"), F.col("_len"), fractions, keys), rows.groupBy(*keys).agg(*_at_ends())


# ---- calibration -----------------------------------------------------------

def join_ground_truth(pred: DataFrame, truth: DataFrame, keys: Sequence[str] = EPISODE, min_matches: int = 4) -> DataFrame:
    """Predicted and true rows of the same episode and frame; episodes with fewer than four matches drop out."""
    met = pred.join(truth.withColumnRenamed("global_frame_idx", "frame_index"), [*keys, "frame_index"])
    enough = met.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_matches)
    return met.join(enough.select(*keys), list(keys), "left_semi")


def _fit(x: str, y: str, name: str) -> list[Column]:
    X, Y = F.col(x), F.col(y)
    sse = F.greatest(F.regr_syy(Y, X) - F.regr_sxy(Y, X) * F.regr_sxy(Y, X) / F.nullif(F.regr_sxx(Y, X), F.lit(0.0)), F.lit(0.0))
    return [
        F.regr_slope(Y, X).alias(f"a_{name}"), F.regr_intercept(Y, X).alias(f"b_{name}"),
        F.sqrt(sse / F.nullif(F.regr_count(Y, X), F.lit(0))).alias(f"rmse_{name}")]


def calibrate(pairs: DataFrame, keys: Sequence[str] = EPISODE, s: str = "s_bev", l: str = "l_bev", lane_s: str = "lane_s", lateral: str = "y") -> DataFrame:
    """World = a * view + b along and across the lane, with the fit error; warnings as flags."""
    out = pairs.groupBy(*keys).agg(*_fit(s, lane_s, "s"), *_fit(l, lateral, "l"), F.count(F.lit(1)).alias("matches"))
    return out.withColumn("poor_fit", (F.col("rmse_s") > 1.0) | (F.col("rmse_l") > 0.5))


def calibrate_axes(pred: DataFrame, truth: DataFrame, keys: Sequence[str] = EPISODE, min_matches: int = 4) -> DataFrame:
    """Slopes of lane_s and y on both view axes (a_xs, a_ys, a_xl, a_yl) per episode with at least ``min_matches`` common frames, from one grouping.

    Which of them hold depends on the primary axis, which may differ between interpolation modes; the fits do not.
    """
    met = pred.select(*keys, "frame_index", "x_m", "y_m").join(
        truth.select(*keys, F.col("global_frame_idx").alias("frame_index"), "lane_s", "y"), [*keys, "frame_index"])
    slope = lambda v, u, n: F.regr_slope(F.col(v), F.col(u)).alias(n)
    return met.groupBy(*keys).agg(
        slope("lane_s", "x_m", "a_xs"), slope("lane_s", "y_m", "a_ys"), slope("y", "x_m", "a_xl"), slope("y", "y_m", "a_yl"),
        F.count(F.lit(1)).alias("matches")).where(F.col("matches") >= min_matches)


def best_axis(pairs: DataFrame, keys: Sequence[str] = EPISODE, x: str = "bev_x", y: str = "bev_y", target: str = "x") -> DataFrame:
    """Which view axis follows the target better after a linear fit, by mean absolute error; x wins ties."""
    fits = pairs.groupBy(*keys).agg(*_fit(x, target, "x"), *_fit(y, target, "y"))
    met = pairs.join(fits, list(keys))
    err = lambda c, n: F.avg(F.abs(F.col(f"a_{n}") * F.col(c) + F.col(f"b_{n}") - F.col(target)))
    out = met.groupBy(*keys).agg(
        err(x, "x").alias("mae_x"), err(y, "y").alias("mae_y"), *[F.first(c).alias(c) for c in ("a_x", "b_x", "a_y", "b_y")])
    first = F.col("mae_x") <= F.col("mae_y")
    pick = lambda c: F.when(first, F.col(f"{c}_x")).otherwise(F.col(f"{c}_y"))
    return out.select(*keys, F.when(first, "x").otherwise("y").alias("axis"), pick("a").alias("a"), pick("b").alias("b"), pick("mae").alias("mae"))


def residual_summary(df: DataFrame, column: str, keys: Sequence[str] = EPISODE) -> DataFrame:
    """Mean, p75, p95 and max of absolute residuals per key (keys are episodes: bounded by their frames)."""
    v = F.abs(F.col(column))
    return df.groupBy(*keys).agg(
        F.avg(v).alias("mean_abs"), F.percentile(v, F.lit(0.75)).alias("p75_abs"), F.percentile(v, F.lit(0.95)).alias("p95_abs"), F.max(v).alias("max_abs"))


def convert_metrics(metrics: DataFrame, cal: DataFrame, keys: Sequence[str] = EPISODE) -> DataFrame:
    """View units to world units with the calibration magnitudes; speed and acceleration sizes are taken anew."""
    return _to_world(metrics.join(cal.select(*keys, "a_s", "a_l"), list(keys))).drop("a_s", "a_l")


def _to_world(m: DataFrame) -> DataFrame:
    a, b = F.abs(F.col("a_s")), F.abs(F.col("a_l"))
    return (
        m.withColumn("frac_position", F.col("frac_position") * a)
        .withColumn("vel_s", F.col("vel_s") * a).withColumn("vel_l", F.col("vel_l") * b)
        .withColumn("acc_s", F.col("acc_s") * a).withColumn("acc_l", F.col("acc_l") * b)
        .withColumn("speed", hypot(F.col("vel_s"), F.col("vel_l"))).withColumn("accel_mag", hypot(F.col("acc_s"), F.col("acc_l"))))


def convert_summary(summary: DataFrame, cal: DataFrame, keys: Sequence[str] = EPISODE) -> DataFrame:
    m = summary.join(cal.select(*keys, "a_s", "a_l"), list(keys))
    return m.withColumn("total_break", F.col("total_break") * F.abs("a_l")).withColumn("end_speed", F.col("end_speed") * F.abs("a_s")).drop("a_s", "a_l")


def truth_in_view(pairs: DataFrame, cal: DataFrame, keys: Sequence[str] = EPISODE, lane_s: str = "lane_s", lateral: str = "y") -> DataFrame:
    """True positions mapped back into the view (gt_x, gt_y); a zero slope maps to 0.

    Needs primary_axis on the pairs.
    """
    back = lambda v, n: F.when(F.abs(f"a_{n}") > 1e-9, (F.col(v) - F.col(f"b_{n}")) / F.nullif(F.col(f"a_{n}"), F.lit(0.0))).otherwise(0.0)
    m = pairs.join(cal.select(*keys, "a_s", "b_s", "a_l", "b_l"), list(keys)).withColumn("_gs", back(lane_s, "s")).withColumn("_gl", back(lateral, "l"))
    along_x = F.col("primary_axis") == 0
    return m.withColumn("gt_x", F.when(along_x, F.col("_gs")).otherwise(F.col("_gl"))).withColumn(
        "gt_y", F.when(along_x, F.col("_gl")).otherwise(F.col("_gs"))).drop("_gs", "_gl", "a_s", "b_s", "a_l", "b_l")


def bev_rmse(pairs: DataFrame, cal: DataFrame, keys: Sequence[str] = EPISODE, x: str = "bev_x", y: str = "bev_y", **truth: str) -> DataFrame:
    m = truth_in_view(pairs, cal, keys, **truth)
    dx, dy = F.col(x) - F.col("gt_x"), F.col(y) - F.col("gt_y")
    return m.groupBy(*keys).agg(
        F.sqrt(F.avg(dx * dx)).alias("bev_x_rmse"), F.sqrt(F.avg(dy * dy)).alias("bev_y_rmse"), F.sqrt(F.avg(dx * dx + dy * dy)).alias("bev_total_rmse"))


def median_speed_check(pred: DataFrame, truth: DataFrame, keys: Sequence[str] = EPISODE, speed: str = "speed", true_speed: str = "speed", tolerance: float = 1.0) -> DataFrame:
    """Median predicted against median true speed per episode."""
    med = lambda df, c, n: df.groupBy(*keys).agg(F.percentile(F.abs(F.col(c)), F.lit(0.5)).alias(n), F.count(c).alias(f"{n}_n"))
    out = med(pred, speed, "median_pred").join(med(truth, true_speed, "median_truth"), list(keys))
    return out.withColumn("agrees", F.abs(F.col("median_pred") - F.col("median_truth")) < tolerance)


# ---- evaluation rows -------------------------------------------------------

def fraction_errors(pred: DataFrame, truth: DataFrame, keys: Sequence[str] = EPISODE) -> DataFrame:
    """Evaluation rows per mode, episode and fraction: predicted, true and predicted minus true."""
    t = truth.select(*keys, "fraction", *[F.col(m).alias(f"gt_{m}") for m in METRICS])
    m = pred.join(t, [*keys, "fraction"])
    return m.select(
        "interpolation_mode", *keys, "fraction", "frac_position",
        *[F.col(c).alias(f"pred_{c}") for c in METRICS], *[f"gt_{c}" for c in METRICS],
        *[(F.col(c) - F.col(f"gt_{c}")).alias(f"{c}_error") for c in METRICS])


def episode_errors(pred: DataFrame, truth: DataFrame, keys: Sequence[str] = EPISODE) -> DataFrame:
    t = truth.select(*keys, F.col("total_break").alias("gt_total_break"), F.col("end_speed").alias("gt_end_speed"))
    m = pred.join(t, list(keys))
    return m.select(
        "interpolation_mode", *keys, F.col("total_break").alias("pred_total_break"), "gt_total_break",
        (F.col("total_break") - F.col("gt_total_break")).alias("total_break_error"),
        F.col("end_speed").alias("pred_end_speed"), "gt_end_speed", (F.col("end_speed") - F.col("gt_end_speed")).alias("end_speed_error"))


PER_FRACTION = [f"{m}_error" for m in METRICS]
PER_EPISODE = ["total_break_error", "end_speed_error"]


def _stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.groupBy("interpolation_mode").agg(F.array(
        F.struct(F.lit("averages").alias("stat"), *[F.avg(c).alias(c) for c in cols]),
        F.struct(F.lit("mae").alias("stat"), *[F.avg(F.abs(F.col(c))).alias(c) for c in cols])).alias("_s")
    ).select("interpolation_mode", F.inline("_s"))


def _named(stats: DataFrame) -> DataFrame:
    return stats.select("interpolation_mode", F.col("stat").alias("fraction"), *[
        F.col(c).alias("pred_" + c.removesuffix("_error")) for c in (*PER_FRACTION, *PER_EPISODE)])


def error_summary(fractions: DataFrame, episodes: DataFrame) -> DataFrame:
    """Mean and mean absolute error of the eight metrics per interpolation mode: rows "averages" and "mae"."""
    return _named(_stats(fractions, PER_FRACTION).join(_stats(episodes, PER_EPISODE), ["interpolation_mode", "stat"]))


def report(pred: DataFrame, truth: DataFrame, modes: Sequence[str], keys: Sequence[str] = EPISODE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(fraction errors, episode errors, summary) of all interpolation modes from one expanded profile.

    pred: keys, frame_index, timestamp_s, x_m, y_m in view units; truth: keys, global_frame_idx, lane_s, y.  Episodes need
    four common frames, and a prediction that has a length and a duration.  The rows of an episode stay in one array until the
    end, so every join is of one row per episode, and a summary averages an episode's own errors over its equally many fraction rows.
    """
    each = ["interpolation_mode", *keys]
    mine = episode_rows(motion_profiles(pred, modes, keys), each)
    true = episode_rows(truth_profile(truth, keys=keys), keys)
    true = true.select(*keys, F.col("at").alias("gt_at"), F.col("total_break").alias("gt_total_break"), F.col("end_speed").alias("gt_end_speed"))
    along = F.col("primary_axis") == 0
    ep = mine.join(calibrate_axes(pred, truth, keys), list(keys)).join(true, list(keys)).withColumns({
        "a_s": F.when(along, F.col("a_xs")).otherwise(F.col("a_ys")), "a_l": F.when(along, F.col("a_yl")).otherwise(F.col("a_xl"))})
    ep = ep.withColumns({"pred_total_break": F.col("total_break") * F.abs("a_l"), "pred_end_speed": F.col("end_speed") * F.abs("a_s")})
    ep = ep.withColumns({f"{c}_error": F.col(f"pred_{c}") - F.col(f"gt_{c}") for c in ("total_break", "end_speed")})
    rows = ep.select(*each, "a_s", "a_l", *PER_EPISODE, F.inline(F.arrays_zip("at", "gt_at")))
    rows = _to_world(rows.select(*each, "a_s", "a_l", *PER_EPISODE, "at.fraction", "at._r.*", *[F.col("gt_at._r")[c].alias(f"gt_{c}") for c in METRICS]))
    rows = rows.withColumns({f"{c}_error": F.col(c) - F.col(f"gt_{c}") for c in METRICS})
    fractions = rows.select(*each, "fraction", "frac_position", *[F.col(c).alias(f"pred_{c}") for c in METRICS], *[f"gt_{c}" for c in METRICS], *PER_FRACTION)
    episodes = ep.select(*each, *[p.format(c) for c in ("total_break", "end_speed") for p in ("pred_{}", "gt_{}", "{}_error")])
    return fractions, episodes, _named(_stats(rows, [*PER_FRACTION, *PER_EPISODE]))


def fraction_error_profile(fractions: DataFrame, first: Sequence[str] = EPISODE) -> DataFrame:
    """Absolute speed and acceleration error per lane fraction, averaged over modes; only the first episode of each mode counts."""
    one = fractions.groupBy("interpolation_mode", "fraction").agg(
        F.min_by(F.struct(F.abs(F.col("speed_error")).alias("s"), F.abs(F.col("accel_mag_error")).alias("a")), F.struct(*first)).alias("_e"))
    return one.groupBy("fraction").agg(F.avg("_e.s").alias("speed_error"), F.avg("_e.a").alias("accel_mag_error"))


def headline_metrics(summary: DataFrame) -> DataFrame:
    """The four headline errors, averaged over the modes' MAE rows; one row (zeros without any)."""
    names = {"speed_error": "pred_speed", "accel_mag_error": "pred_accel_mag", "total_break_error": "pred_total_break", "end_speed_error": "pred_end_speed"}
    return summary.where(F.col("fraction") == "mae").agg(*[F.coalesce(F.avg(F.abs(F.col(c))), F.lit(0.0)).alias(n) for n, c in names.items()])


def average_trajectory(trajs: DataFrame, run: str = "interpolation_mode", keys: Sequence[str] = SHOT, index: str = "idx") -> DataFrame:
    """Mean and population deviation across runs, index by index, over the length of the shortest run."""
    shortest = trajs.groupBy(*keys, run).agg(F.count(F.lit(1)).alias("_n")).groupBy(*keys).agg(F.min("_n").alias("_min"))
    m = trajs.join(shortest, list(keys)).where(F.col(index) < F.col("_min"))
    return m.groupBy(*keys, index).agg(
        F.avg("x_m").alias("x_mean"), F.avg("y_m").alias("y_mean"), F.stddev_pop("x_m").alias("x_std"), F.stddev_pop("y_m").alias("y_std"), F.count(F.lit(1)).alias("runs"))


def stage_diagnostics(raw: DataFrame, trimmed: DataFrame, smoothed: DataFrame, final: DataFrame, conf: Settings = DEFAULT, keys: Sequence[str] = SHOT) -> DataFrame:
    """Counts of each cleaning stage and the span of the raw detections, with the first and last four of them.

    Head and tail are picked by rank, so only eight points per shot are gathered.
    """
    w = Window.partitionBy(*keys).orderBy("frame_index")
    rows = (
        raw.withColumn("_g", F.col("frame_index") - F.lag("frame_index").over(w)).withColumn("_i", F.row_number().over(w))
        .withColumn("_d", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("frame_index"))))
    )
    pt = F.struct("frame_index", "x_m", "y_m")
    span = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("raw_count"), F.min("frame_index").alias("first_frame"), F.max("frame_index").alias("last_frame"),
        F.coalesce(F.max("_g"), F.lit(0)).alias("largest_gap"), F.sum(in_lane(F.col("x_m"), F.col("y_m"), conf).cast("int")).alias("in_bounds"),
        F.min("x_m").alias("x_min"), F.max("x_m").alias("x_max"), F.min("y_m").alias("y_min"), F.max("y_m").alias("y_max"),
        F.sort_array(F.collect_list(F.when(F.col("_i") <= 4, pt))).alias("head"), F.sort_array(F.collect_list(F.when(F.col("_d") <= 4, pt))).alias("tail"))
    count = lambda df, n: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(n))
    out = span
    for df, n in ((trimmed, "trimmed_count"), (smoothed, "smoothed_count"), (final, "final_count")):
        out = out.join(count(df, n), list(keys), "left").withColumn(n, F.coalesce(n, F.lit(0)))
    return out


def accuracy(df: DataFrame, pred: str, truth: str, keys: Sequence[str] = ()) -> DataFrame:
    """Share of equal predictions, 0 for no rows."""
    hit = F.coalesce(F.sum((F.col(pred) == F.col(truth)).cast("int")), F.lit(0))
    return df.groupBy(*keys).agg((hit / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("accuracy"), F.count(F.lit(1)).alias("total"))
