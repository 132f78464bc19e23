"""Per-shot frame sequences: dedupe, differences, runs of equal or increasing values.

A sequence has at most one row per (shot, frame).  ``first_per_frame`` makes it
so with a map-side aggregate, which also bounds every later window: a shot
never holds more rows than its video has frames, whatever the input repeats.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shotlane.config import DEFAULT, Settings
from shotlane.operators.scans import affine_scan

SHOT = ["shot_id"]


def _by_frame(keys: Sequence[str], order: str = "frame_index"):
    return Window.partitionBy(*keys).orderBy(order)


def first_per_frame(
    df: DataFrame, order: Sequence[str] = ("timestamp_s",), keys: Sequence[str] = SHOT,
    frame: str = "frame_index", last: bool = False,
) -> DataFrame:
    """Keep the first (or last) row of each frame; combines on the map side, so a hot frame costs one row per task."""
    rest = [c for c in df.columns if c not in (*keys, frame)]
    pick = F.max_by if last else F.min_by
    row, by = F.struct(*rest), F.struct(*order)
    out = df.groupBy(*keys, frame).agg(pick(row, by).alias("_row"))
    return out.select(*keys, frame, *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)


def hypot(x: Column, y: Column) -> Column:
    return F.sqrt(x * x + y * y)


def finite_diff(pos: DataFrame, keys: Sequence[str] = SHOT) -> DataFrame:
    """Speed and acceleration of each sample against the one before; the first sample has neither."""
    w = _by_frame(keys)
    dt = F.greatest(F.col("timestamp_s") - F.lag("timestamp_s").over(w), F.lit(1e-6))
    step = (
        pos.withColumn("_dt", dt)
        .withColumn("_dx", F.col("x_m") - F.lag("x_m").over(w))
        .withColumn("_dy", F.col("y_m") - F.lag("y_m").over(w))
        .withColumn("speed_mps", hypot(F.col("_dx"), F.col("_dy")) / F.col("_dt"))
        .withColumn("_prev", F.lag("speed_mps").over(w))
    )
    accel = F.when(F.col("speed_mps").isNotNull(), F.coalesce((F.col("speed_mps") - F.col("_prev")) / F.col("_dt"), F.lit(0.0)))
    return step.withColumn("accel_mps2", accel).drop("_dt", "_dx", "_dy", "_prev")


NON_FINITE = "non-finite position"


def non_finite(*columns: str) -> Column:
    """Whether one of the values is NaN or infinite; nulls are not."""
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.isnan(c) | (F.abs(F.col(c)) == float("inf")), F.lit(False))
    return out


def gap_velocity(pos: DataFrame, dt: float = 1.0 / 30.0, keys: Sequence[str] = SHOT) -> DataFrame:
    """Velocity and acceleration over the true frame gap.

    Missing detections (null x_m or y_m) keep the latest values seen.  A
    non-finite coordinate ends its shot, not the job: from that frame on the
    shot's rows carry an error text and no values.
    """
    w = _by_frame(keys)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    columns = [c for c in pos.columns if c != "error"]
    pos = pos.select(*columns, F.when(F.max(non_finite("x_m", "y_m")).over(upto), F.lit(NON_FINITE)).alias("error"))
    good = F.col("error").isNull()
    seen = F.col("x_m").isNotNull() & F.col("y_m").isNotNull() & good

    def last_seen(c: Column, frame) -> Column:
        return F.last(F.when(seen, c), ignorenulls=True).over(frame)

    now = F.struct("frame_index", "x_m", "y_m")
    prev = last_seen(now, before)
    gap = F.col("frame_index") - prev["frame_index"]
    step = F.lit(dt) * gap
    vel = F.when(seen & (gap > 0), F.struct(
        ((F.col("x_m") - prev["x_m"]) / F.nullif(step, F.lit(0.0))).alias("vx"),
        ((F.col("y_m") - prev["y_m"]) / F.nullif(step, F.lit(0.0))).alias("vy"),
        F.col("frame_index").alias("f"),
    ))
    out = pos.withColumn("_v", vel)
    pv = F.last("_v", ignorenulls=True).over(before)
    vstep = F.lit(dt) * (F.col("_v")["f"] - pv["f"])
    acc = F.when(F.col("_v").isNotNull() & pv.isNotNull(), F.struct(
        ((F.col("_v")["vx"] - pv["vx"]) / F.nullif(vstep, F.lit(0.0))).alias("ax"),
        ((F.col("_v")["vy"] - pv["vy"]) / F.nullif(vstep, F.lit(0.0))).alias("ay"),
    ))
    out = out.withColumn("_a", acc)
    out = out.withColumn("_v", F.last("_v", ignorenulls=True).over(upto)).withColumn(
        "_a", F.last("_a", ignorenulls=True).over(upto)
    )
    return out.select(
        *columns, *[F.when(good, F.col(f"{s}.{c}")).alias(c) for s, c in (("_v", "vx"), ("_v", "vy"), ("_a", "ax"), ("_a", "ay"))], "error",
    )


def gradient(df: DataFrame, columns: dict[str, str], dt: Column, keys: Sequence[str], order: str) -> DataFrame:
    """Central differences inside, one-sided at both ends; ``columns`` maps input to output name."""
    w = _by_frame(keys, order)
    out = df
    for src, dst in columns.items():
        p, n = F.lag(src).over(w), F.lead(src).over(w)
        g = F.when(p.isNull(), (n - F.col(src)) / dt).when(n.isNull(), (F.col(src) - p) / dt).otherwise((n - p) / (2.0 * dt))
        out = out.withColumn(dst, g)
    return out


def running_max(df: DataFrame, column: str, out: str, keys: Sequence[str] = SHOT, order: str = "frame_index") -> DataFrame:
    w = _by_frame(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(out, F.max(column).over(w))


def spread_flat(df: DataFrame, column: str, out: str, keys: Sequence[str] = SHOT, order: str = "frame_index") -> DataFrame:
    """Turn flat stretches of a non-decreasing series into even steps between their neighbours, then running max.

    Each flat run starts from where the run before it ended: an affine step from end to end, so the ends are a scan over the runs.
    """
    w = _by_frame(keys, order)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    new_run = F.when(F.abs(F.col(column) - F.lag(column).over(w)) < 1e-9, 0).otherwise(1)
    rows = df.withColumn("_run", new_run).withColumn("_run", F.sum("_run").over(upto))
    runs = rows.groupBy(*keys, "_run").agg(F.count(F.lit(1)).alias("_n"), F.min_by(column, order).alias("_v"))
    runs = runs.withColumn("_next", F.lead("_v").over(Window.partitionBy(*keys).orderBy("_run")))
    spreads = (F.col("_n") > 1) & F.col("_next").isNotNull() & (F.col("_next") > F.col("_v"))
    share = F.col("_n") / (F.col("_n") + 1)  # of the way from the last end to the next value
    term = F.when(spreads, share * F.col("_next")).otherwise(F.col("_v"))
    ends = affine_scan(runs.where("_v IS NOT NULL"), keys, "_run", F.when(spreads, 1 - share).otherwise(0.0), {"_from": (term, F.col("_v"))})
    starts = runs.join(ends.withColumn("_run", F.col("_run") + 1), [*keys, "_run"], "left").drop("_v")
    joined = rows.join(starts, [*keys, "_run"])
    k = F.row_number().over(Window.partitionBy(*keys, "_run").orderBy(order))
    inner = (F.col("_n") > 1) & F.col("_next").isNotNull() & F.col("_from").isNotNull() & (F.col("_next") > F.col("_from"))
    spread = joined.withColumn("_k", k).withColumn(
        "_s",
        F.when(inner, F.col("_from") + (F.col("_next") - F.col("_from")) / (F.col("_n") + 1) * F.col("_k")).otherwise(F.col(column)),
    )
    return spread.withColumn(out, F.max("_s").over(upto)).select(*df.columns, out)


def anchor_ends(df: DataFrame, smooth: str, raw: str, out: str, length: int = 5, keys: Sequence[str] = SHOT, order: str = "frame_index") -> DataFrame:
    """Pull both ends of a smoothed series toward the raw one, weight 0.5 at the very end falling to 0."""
    w = _by_frame(keys, order)
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    m = F.least(F.lit(length), F.col("_n"))
    head = F.when(F.col("_i") <= m, 0.5 - 0.5 * (F.col("_i") - 1) / F.greatest(m - 1, F.lit(1)))
    tail = F.when(F.col("_i") > F.col("_n") - m, 0.5 * (F.col("_i") - (F.col("_n") - m) - 1) / F.greatest(m - 1, F.lit(1)))
    hw, tw = F.coalesce(head, F.lit(0.0)), F.coalesce(tail, F.lit(0.0))
    once = hw * F.col(raw) + (1.0 - hw) * F.col(smooth)
    twice = tw * F.col(raw) + (1.0 - tw) * once
    return (
        df.withColumn("_i", F.row_number().over(w)).withColumn("_n", n)
        .withColumn(out, F.when(F.col("_n") <= 2, F.col(smooth)).otherwise(twice))
        .drop("_i", "_n")
    )


def contiguous_ranges(frames: DataFrame, keys: Sequence[str] = SHOT) -> DataFrame:
    """Runs of consecutive frame numbers: start, end and length of each."""
    uniq = frames.select(*keys, "frame_index").distinct()
    island = F.col("frame_index") - F.row_number().over(_by_frame(keys))
    return (
        uniq.withColumn("_g", island).groupBy(*keys, "_g")
        .agg(F.min("frame_index").alias("start_frame"), F.max("frame_index").alias("end_frame"), F.count(F.lit(1)).alias("frames"))
        .drop("_g")
    )


def largest_gap(pos: DataFrame, keys: Sequence[str] = SHOT) -> DataFrame:
    gap = F.col("frame_index") - F.lag("frame_index").over(_by_frame(keys))
    return pos.withColumn("_g", gap).groupBy(*keys).agg(F.coalesce(F.max("_g"), F.lit(0)).alias("largest_gap"))


def orient(traj: DataFrame, keys: Sequence[str] = SHOT, order: str = "frame_index", x: str = "x_m", y: str = "y_m") -> DataFrame:
    """Along-lane (s) and lateral (l) coordinate: the axis with the larger range, reversed so that s increases.

    Adds primary_axis (0 for x), trajectory_reversed, s, l and seq (1.. in travel order).
    """
    whole = Window.partitionBy(*keys)
    w = _by_frame(keys, order)
    out = (
        traj.withColumn("_rx", F.max(x).over(whole) - F.min(x).over(whole))
        .withColumn("_ry", F.max(y).over(whole) - F.min(y).over(whole))
        .withColumn("primary_axis", F.when(F.col("_rx") >= F.col("_ry"), 0).otherwise(1))
        .withColumn("s", F.when(F.col("primary_axis") == 0, F.col(x)).otherwise(F.col(y)))
        .withColumn("l", F.when(F.col("primary_axis") == 0, F.col(y)).otherwise(F.col(x)))
        .withColumn("trajectory_reversed", F.max_by("s", order).over(whole) < F.min_by("s", order).over(whole))
        .withColumn("_i", F.row_number().over(w))
        .withColumn("_n", F.count(F.lit(1)).over(whole))
        .withColumn("seq", F.when(F.col("trajectory_reversed"), F.col("_n") - F.col("_i") + 1).otherwise(F.col("_i")))
    )
    return out.drop("_rx", "_ry", "_i", "_n")


def in_lane(x: Column, y: Column, conf: Settings = DEFAULT) -> Column:
    return x.between(-conf.x_margin_m, conf.lane_width_m + conf.x_margin_m) & y.between(
        conf.y_low_m, conf.lane_length_m + conf.y_high_over_m
    )


def clip_positions(pos: DataFrame, conf: Settings = DEFAULT) -> DataFrame:
    def hold(c, lo, hi):
        return F.least(F.greatest(F.col(c), F.lit(lo)), F.lit(hi))

    return pos.withColumn("x_m", hold("x_m", -0.5, conf.lane_width_m + 0.5)).withColumn(
        "y_m", hold("y_m", -1.0, conf.lane_length_m + 1.0)
    )
