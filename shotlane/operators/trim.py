"""Motion segments and trimming of raw ball positions.

Every "walk until it fits" step of the cleaning rules has a closed form (first
row, last row or trailing run that meets a condition), so the whole operator is
windows over one (shot, frame) ordering: a single exchange and sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shotlane.config import DEFAULT, Settings
from shotlane.operators.sequences import SHOT, in_lane


def motion_segments(pos: DataFrame, conf: Settings = DEFAULT, keys: Sequence[str] = SHOT) -> DataFrame:
    """Number the stretches of plausible forward motion; a row that breaks one starts the next.

    Adds row_no (0-based), in_bounds and segment.
    """
    w = Window.partitionBy(*keys).orderBy("frame_index")
    gap = F.greatest(F.col("frame_index") - F.lag("frame_index").over(w), F.lit(1))
    dx = F.col("x_m") - F.lag("x_m").over(w)
    dy = F.col("y_m") - F.lag("y_m").over(w)
    breaks = (
        ~F.col("in_bounds")
        | (F.col("y_m") > conf.lane_length_m + conf.end_y_tol_m)
        | (F.col("_gap") > conf.max_frame_gap)
        | (F.col("_dy") < conf.max_back_dy_m)
        | (F.abs("_dx") > conf.max_step_dx_m)
        | (F.col("_dy") / F.col("_gap") > conf.max_rate_dy_m)
    )
    return (
        pos.withColumn("row_no", F.row_number().over(w) - 1)
        .withColumn("in_bounds", in_lane(F.col("x_m"), F.col("y_m"), conf))
        .withColumn("_gap", gap).withColumn("_dx", dx).withColumn("_dy", dy)
        .withColumn("_brk", F.when((F.col("row_no") > 0) & breaks, 1).otherwise(0))
        .withColumn("segment", F.sum("_brk").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .drop("_gap", "_dx", "_dy", "_brk")
    )


def _bounds(seg: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Attach _a, _b: the row range of the best segment (in-bounds count, then y span, then frame span, then first)."""
    whole, part = Window.partitionBy(*keys), Window.partitionBy(*keys, "segment")
    rank = F.struct(
        F.sum(F.col("in_bounds").cast("int")).over(part).alias("inb"),
        (F.max("y_m").over(part) - F.min("y_m").over(part)).alias("ys"),
        (F.max("frame_index").over(part) - F.min("frame_index").over(part)).alias("fs"),
        (-F.col("segment")).alias("first"),
    )
    out = seg.withColumn("_k", rank).withColumn("_best", -F.max("_k").over(whole)["first"])
    mine = F.col("segment") == F.col("_best")
    return (
        out.withColumn("_a", F.min(F.when(mine, F.col("row_no"))).over(whole))
        .withColumn("_b", F.max(F.when(mine, F.col("row_no"))).over(whole) + 1)
        .drop("_k", "_best")
    )


def best_interval(pos: DataFrame, conf: Settings = DEFAULT, keys: Sequence[str] = SHOT) -> DataFrame:
    """Per shot: first and one-past-last row of the best segment, before any trimming."""
    rows = _bounds(motion_segments(pos, conf, keys), keys)
    return rows.groupBy(*keys).agg(
        F.first("_a").alias("start_row"), F.first("_b").alias("end_row"),
        (F.max("segment") + 1).alias("segments"), F.count(F.lit(1)).alias("rows"),
    )


def _trim_ends(rows: DataFrame, conf: Settings, keys: Sequence[str]) -> DataFrame:
    whole = Window.partitionBy(*keys)
    w = whole.orderBy("frame_index")
    i, a, b, y = F.col("row_no"), F.col("_a"), F.col("_b"), F.col("y_m")
    inside = (i >= a) & (i < b)
    head_dy = F.lead("y_m", 3).over(w) - y
    back_dy = y - F.lag("y_m").over(w)
    ok_tail = F.col("in_bounds") & (y <= conf.lane_length_m + conf.end_y_tol_m) & (F.col("_back") >= -0.20)
    return (
        rows.withColumn("_head", head_dy).withColumn("_back", back_dy)
        .withColumn("_a", F.min(F.when(inside & ((i >= b - 1) | (y >= -conf.contact_y_tol_m)), i)).over(whole))
        .withColumn("_a", F.min(F.when(
            inside & ((i >= b - 3) | ((F.col("_head") >= -0.05) & F.col("in_bounds"))), i)).over(whole))
        .withColumn("_b", F.max(F.when(inside & ((i + 1 - a < 4) | ok_tail), i + 1)).over(whole))
        .drop("_head", "_back")
    )


def _steps(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Forward step of each row inside the kept range, its number _k and the bounds of the middle 60 %."""
    w = Window.partitionBy(*keys).orderBy("frame_index")
    n = F.col("_b") - F.col("_a") - 1
    return (
        rows.withColumn("_n", n)
        .withColumn("_k", F.col("row_no") - F.col("_a"))
        .withColumn("_sy", F.lead("y_m").over(w) - F.col("y_m"))
        .withColumn("_sx", F.lead("x_m").over(w) - F.col("x_m"))
        .withColumn("_valid", (F.col("_k") >= 0) & (F.col("_k") < F.col("_n")))
        .withColumn("_lo", F.floor(F.col("_n") * F.lit(0.2)))
        .withColumn("_hi", F.floor(F.col("_n") * F.lit(0.8)))
    )


def _middle(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    whole = Window.partitionBy(*keys)
    mid = F.col("_valid") & (F.col("_k") >= F.col("_lo")) & (F.col("_k") < F.col("_hi"))
    up = F.when(mid & (F.col("_sy") > 0), F.col("_sy"))
    return (
        rows.withColumn("_ups", F.count(up).over(whole))
        .withColumn("_med", F.percentile(up, F.lit(0.5)).over(whole))
        .withColumn("_sd", F.stddev_pop(F.when(mid, F.col("_sx"))).over(whole))
        .withColumn("_usable", (F.col("_b") - F.col("_a") >= 8) & (F.col("_ups") >= 3))
    )


_WORK = ("_n", "_k", "_sy", "_sx", "_valid", "_lo", "_hi", "_ups", "_med", "_sd", "_usable")


def _trim_loft(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Drop a lofted start: a stall early in the range, up to where three good steps follow each other."""
    whole = Window.partitionBy(*keys)
    w = whole.orderBy("frame_index")
    s = _middle(_steps(rows, keys), keys)
    k = F.col("_k")
    slow = F.col("_valid") & (F.col("_sy") < 0.30 * F.col("_med"))
    good = F.col("_sy") >= 0.45 * F.col("_med")
    scan = F.greatest(F.lit(2), F.floor(F.col("_n") * F.lit(0.4)))
    s = s.withColumn("_slow", slow).withColumn("_good", good)
    stall = F.when(
        F.col("_usable") & F.col("_slow") & F.lag("_slow").over(w) & (k >= 1) & (k < scan), k
    )
    three = F.col("_good") & F.lead("_good", 1).over(w) & F.lead("_good", 2).over(w)
    s = s.withColumn("_st", stall).withColumn("_three", three).withColumn("_stall", F.max("_st").over(whole))
    resume = F.when(F.col("_three") & (k > F.col("_stall")) & (k <= F.col("_n") - 3), k)
    return (
        s.withColumn("_r", resume).withColumn("_a", F.col("_a") + F.coalesce(F.min("_r").over(whole), F.lit(0)))
        .drop(*_WORK, "_slow", "_good", "_st", "_three", "_stall", "_r")
    )


def _trim_tail_cluster(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Drop up to six trailing rows whose step stalls or jumps sideways, never going below six rows."""
    whole = Window.partitionBy(*keys)
    s = _middle(_steps(rows, keys), keys)
    bad = (F.col("_sy") < 0.25 * F.col("_med")) | (F.abs("_sx") > F.greatest(2.5 * F.col("_sd"), F.lit(0.08)))
    last_good = F.max(F.when(F.col("_valid") & ~F.col("_bad"), F.col("_k"))).over(whole)
    run = F.col("_n") - 1 - F.coalesce(F.col("_lg"), F.lit(-1))
    cut = F.when(F.col("_usable"), F.least(run, F.lit(6), F.col("_b") - F.col("_a") - 6)).otherwise(0)
    return (
        s.withColumn("_bad", bad).withColumn("_lg", last_good)
        .withColumn("_b", F.col("_b") - F.greatest(cut, F.lit(0)))
        .drop(*_WORK, "_bad", "_lg")
    )


def _interval(pos: DataFrame, conf: Settings, keys: Sequence[str], cleaning: bool) -> DataFrame:
    """Rows with the final range; the scorer stops after the end trims, the cleaner goes on."""
    rows = _trim_ends(_bounds(motion_segments(pos, conf, keys), keys), conf, keys)
    if cleaning:
        rows = _trim_tail_cluster(_trim_loft(rows, keys), keys)
    return rows


def _kept(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    return rows.where((F.col("row_no") >= F.col("_a")) & (F.col("row_no") < F.col("_b"))).select(*columns)


def trim_ends(pos: DataFrame, conf: Settings = DEFAULT, keys: Sequence[str] = SHOT) -> DataFrame:
    return _kept(_interval(pos, conf, keys, cleaning=False), pos.columns)


def trim_loft(pos: DataFrame, conf: Settings = DEFAULT, keys: Sequence[str] = SHOT) -> DataFrame:
    return _kept(_trim_loft(_interval(pos, conf, keys, cleaning=False), keys), pos.columns)


def trim_tail_cluster(pos: DataFrame, conf: Settings = DEFAULT, keys: Sequence[str] = SHOT) -> DataFrame:
    return _kept(_trim_tail_cluster(_interval(pos, conf, keys, cleaning=False), keys), pos.columns)


def trim_detections(pos: DataFrame, conf: Settings = DEFAULT, keys: Sequence[str] = SHOT) -> DataFrame:
    """The kept positions of each shot."""
    return _kept(_interval(pos, conf, keys, cleaning=True), pos.columns)


def trim_diagnostics(pos: DataFrame, conf: Settings = DEFAULT, keys: Sequence[str] = SHOT) -> DataFrame:
    """One row per shot: why, where and how much was cut."""
    w = Window.partitionBy(*keys).orderBy("frame_index")
    rows = _interval(pos, conf, keys, cleaning=True)
    i, a, b = F.col("row_no"), F.col("_a"), F.col("_b")
    kept = (i >= a) & (i < b)
    rows = rows.withColumn("_step", F.when(kept & (i > a), F.col("y_m") - F.lag("y_m").over(w)))
    at_cut = F.when(a > 0, i == a).otherwise(i == b)

    def pick(cond: Column, col: str) -> Column:
        return F.max(F.when(cond, F.col(col)))

    agg = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("raw_count"),
        F.sum(kept.cast("int")).alias("kept_count"),
        F.first("_a").alias("_a"), F.first("_b").alias("_b"),
        pick(at_cut, "frame_index").alias("cut_frame_index"),
        pick(at_cut, "x_m").alias("cut_x_m"), pick(at_cut, "y_m").alias("cut_y_m"),
        pick(i == b - 1, "frame_index").alias("last_kept_frame_index"),
        pick(i == b - 1, "_step").alias("current_dy"),
        F.count("_step").alias("_steps"), F.percentile("_step", F.lit(0.5)).alias("median_dy"),
    )
    reason = F.when(F.col("_a") > 0, "pre_contact_or_artifact_interval").when(
        F.col("_b") < F.col("raw_count"), "post_track_artifact_interval"
    )
    return agg.select(
        *keys, "raw_count", "kept_count", reason.alias("cut_reason"),
        "cut_frame_index", "last_kept_frame_index", "current_dy",
        F.when(F.col("_steps") > 1, F.col("median_dy")).alias("median_dy"),
        "cut_x_m", "cut_y_m",
    )


def ball_path_score(pos: DataFrame, conf: Settings = DEFAULT, keys: Sequence[str] = SHOT) -> DataFrame:
    """How much one set of projected positions looks like a rolling ball, 0 to 1."""
    rows = _interval(pos, conf, keys, cleaning=False)
    good = F.col("in_bounds") & (F.col("row_no") >= F.col("_a")) & (F.col("row_no") < F.col("_b"))
    n = F.count(F.lit(1))
    yv, fv = F.when(good, F.col("y_m")), F.when(good, F.col("frame_index"))
    span = F.least(F.greatest(F.max(yv) - F.min(yv), F.lit(0.0)) / 4.0, F.lit(1.0))
    dur = F.least((F.max(fv) - F.min(fv) + 1) / 16.0, F.lit(1.0))
    score = (
        0.35 * F.sum(F.col("in_bounds").cast("int")) / n + 0.30 * F.count(yv) / n + 0.20 * span + 0.15 * dur
    )
    return rows.groupBy(*keys).agg(
        F.coalesce(F.when(F.count(yv) > 0, F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0))), F.lit(0.0)).alias("ball_score")
    )
