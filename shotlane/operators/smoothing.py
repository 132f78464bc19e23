"""Densify, smooth, resample and extend trajectories."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shotlane.config import DEFAULT, Settings
from shotlane.operators import kernels
from shotlane.operators.scans import stepwise
from shotlane.operators.sequences import SHOT, first_per_frame

#: Series that a Python worker works on at once.
TOGETHER = 256


def _series(df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str]) -> DataFrame:
    """One row per sequence with one sorted array per column (``order`` first)."""
    rows = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(order, *columns))).alias("_s"))
    return rows.select(*keys, *[F.col("_s")[c].cast("array<double>").alias(c) for c in (order, *columns)])


def _kernel(fn: Callable, arity: int, names: Sequence[str]):
    """Vectorised UDF: ``arity`` array columns in, a struct of ``names`` arrays out."""
    schema = "struct<" + ",".join(f"{n}:array<double>" for n in names) + ">"

    def run(args):
        rows = [fn(*vals) for vals in zip(*args)]
        return pd.DataFrame({n: [r[i] for r in rows] for i, n in enumerate(names)})

    if arity == 1:
        @F.pandas_udf(schema)
        def call(a: pd.Series) -> pd.DataFrame:
            return run((a,))
    elif arity == 2:
        @F.pandas_udf(schema)
        def call(a: pd.Series, b: pd.Series) -> pd.DataFrame:
            return run((a, b))
    else:
        @F.pandas_udf(schema)
        def call(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.DataFrame:
            return run((a, b, c))
    return call


def densify_linear(pos: DataFrame, columns: Sequence[str] = ("x_m", "y_m"), keys: Sequence[str] = SHOT) -> DataFrame:
    """One row per frame from first to last, straight lines between detections.

    Each row fills the frames up to the next one, so the gap rows are made where the data is.
    """
    w = Window.partitionBy(*keys).orderBy("frame_index")
    nxt = F.lead(F.struct("frame_index", *columns)).over(w)
    last = F.coalesce(F.col("_n.frame_index") - 1, F.col("frame_index"))
    rows = pos.select(*keys, "frame_index", *columns).withColumn("_n", nxt)
    rows = rows.withColumn("_f", F.explode(F.sequence("frame_index", last)))
    step = F.col("_f") - F.col("frame_index")
    out = [
        F.when(step == 0, F.col(c)).otherwise(
            (F.col("_n")[c] - F.col(c)) / F.nullif(F.col("_n.frame_index") - F.col("frame_index"), F.lit(0)) * step + F.col(c)
        ).alias(c)
        for c in columns
    ]
    return rows.select(*keys, F.col("_f").alias("frame_index"), *out)


def _per_sequence(df, keys, order, column, out, fn):
    series = _series(df, keys, order, [column])
    call = _kernel(lambda t, v: (t, fn(t, v)), 2, [order, out])
    return series.select(*keys, call(order, column).alias("_k")).select(
        *keys, F.inline(F.arrays_zip(F.col(f"_k.{order}").alias(order), F.col(f"_k.{out}").alias(out)))
    ).withColumn(order, F.col(order).cast(df.schema[order].dataType))


def isotonic(df: DataFrame, column: str = "y_m", out: str = "y_iso", keys: Sequence[str] = SHOT, order: str = "frame_index") -> DataFrame:
    return _per_sequence(df, keys, order, column, out, lambda t, v: kernels.isotonic(v))


def smooth_spline(pos: DataFrame, column: str, out: str, conf: Settings = DEFAULT, keys: Sequence[str] = SHOT) -> DataFrame:
    """Smoothing spline over the frame axis, evaluated at every frame; fewer than four points go linear."""
    sigma = conf.smooth_sigma_m

    def run(f, v):
        f = np.asarray(f, dtype=float)
        every = np.arange(f[0], f[-1] + 1.0)
        if f.size < 4:
            return every, np.interp(every, f, v)
        return every, kernels.smoothing_spline(f, v, f.size * sigma ** 2, every)

    series = _series(pos, keys, "frame_index", [column])
    kept = [series.schema[c] for c in keys]
    schema = T.StructType([*kept, T.StructField("frame_index", T.IntegerType()), T.StructField(out, T.DoubleType())])

    def curves(batches):
        # a series gives a row per frame of its shot: a task holds those of so many series
        for b in batches:
            for i in range(0, b.num_rows, TOGETHER):
                part = b.slice(i, TOGETHER)
                f, v = (part.column(len(keys) + j) for j in (0, 1))
                done = [run(*[np.asarray(c[r].values.to_numpy(zero_copy_only=False), dtype=float) for c in (f, v)]) for r in range(part.num_rows)]
                of = pa.array(np.repeat(np.arange(part.num_rows), [len(e) for e, _ in done]))
                frames, values = (np.concatenate(c) for c in zip(*done))
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(j).take(of) for j in range(len(keys))], pa.array(frames.astype(np.int32)), pa.array(values, mask=np.isnan(values))], names=schema.names)

    return series.mapInArrow(curves, schema)


def resmooth_x(dense: DataFrame, samples: int | Column, conf: Settings = DEFAULT, keys: Sequence[str] = SHOT) -> DataFrame:
    """Smooth x again against forward distance.  ``samples`` is the number of raw detections behind the sequence."""
    sigma = conf.smooth_sigma_m
    n = F.lit(samples) if isinstance(samples, int) else samples

    def run(x, y, count):
        x, y = np.asarray(x, dtype=float), np.asarray(y, dtype=float)
        raw = float(count[0])
        if raw < 4 or y.size < 6:
            return (x,)
        axis = np.maximum.accumulate(y) + np.arange(y.size) * 1e-6
        return (kernels.anchor_ends(kernels.smoothing_spline(axis, x, raw * sigma ** 2, axis), x),)

    series = _series(dense.withColumn("_raw", n.cast("double")), keys, "frame_index", ["x_m", "y_m", "_raw"])
    call = _kernel(run, 3, ["x"])
    return series.select(*keys, "frame_index", "y_m", call("x_m", "y_m", "_raw").alias("_k")).select(
        *keys, F.inline(F.arrays_zip("frame_index", F.col("_k.x").alias("x_m"), "y_m"))
    ).withColumn("frame_index", F.col("frame_index").cast("int"))


def clamp_hook_tail(dense: DataFrame, out: str = "x_m", keys: Sequence[str] = SHOT) -> DataFrame:
    """Freeze steps that reverse a committed hook in the last eighth.

    Only that tail (at most an eighth of one shot) is walked, all tails of a batch at once; the head passes straight through.
    """
    whole = Window.partitionBy(*keys)
    w = whole.orderBy("frame_index")
    n, i = F.col("_n"), F.col("_i")
    lo, hi = F.floor(n * F.lit(0.20)), F.floor(n * F.lit(0.80))
    start = F.greatest(hi, n - F.greatest(F.lit(6), F.floor(n / 8)))
    rows = (
        dense.withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", F.count(F.lit(1)).over(whole))
        .withColumn("_dx", F.max(F.when(i == hi, F.col("x_m"))).over(whole) - F.max(F.when(i == lo, F.col("x_m"))).over(whole))
        .withColumn("_dy", F.max(F.when(i == hi, F.col("y_m"))).over(whole) - F.max(F.when(i == lo, F.col("y_m"))).over(whole))
        .withColumn("_side", F.when(
            (n >= 12) & (hi > lo + 4) & (F.abs("_dx") >= 0.04) & (F.col("_dy") > 1.0), F.signum("_dx")))
        .withColumn("_tail", F.col("_side").isNotNull() & (i >= start))
    )
    head = rows.where(~F.coalesce(F.col("_tail"), F.lit(False)))
    tail = rows.where(F.col("_tail")).groupBy(*keys).agg(
        F.first("_side").alias("_side"), F.sort_array(F.collect_list(F.struct("_i", "x_m"))).alias("_t"),
        F.sort_array(F.collect_list(F.struct("_i", *[c for c in dense.columns if c not in keys]))).alias("_r"),
    )

    @F.pandas_udf("array<double>")
    def held(x: pd.Series, side: pd.Series) -> pd.Series:
        sizes = np.array([len(v) for v in x], dtype=np.int64)
        if not sizes.sum():
            return pd.Series([np.zeros(0)] * len(sizes))
        flat, way = np.concatenate(list(x)).astype(float), np.repeat(side.to_numpy(dtype=float), sizes)
        step = lambda c, v, s: np.where((v - c) * s < -1e-3, c, v)  # noqa: E731  no state yet: nan, so the value
        return pd.Series(np.split(stepwise(step, sizes, np.full(len(sizes), np.nan), flat, way), np.cumsum(sizes)[:-1]))

    kept = [c for c in dense.columns if c not in keys and c != out]
    done = tail.withColumn("_c", held(F.col("_t.x_m").cast("array<double>"), F.col("_side").cast("double"))).select(*keys, F.posexplode("_r").alias("_p", "_row"), "_c").select(
        *keys, *[F.col("_row")[c].alias(c) for c in kept], F.get("_c", F.col("_p")).alias(out)
    )
    if out != "x_m":
        head = head.withColumn(out, F.col("x_m"))
    columns = [*keys, *kept, out]
    return head.select(*columns).unionByName(done.select(*columns))


def smooth_trajectory(pos: DataFrame, fps: float | Column = DEFAULT.default_fps, conf: Settings = DEFAULT, keys: Sequence[str] = SHOT) -> DataFrame:
    """Full cleanup of kept detections: dedupe, densify, spline, anchors, forward-only y, x against distance, hook clamp.

    A shot with one distinct frame passes through unchanged.  A column fps is kept.
    """
    sigma, length = conf.smooth_sigma_m, conf.lane_length_m
    keep = ["fps"] if "fps" in pos.columns else []
    fps = F.lit(float(fps)) if not isinstance(fps, Column) else fps
    rows = first_per_frame(pos.withColumn("_fps", fps), order=("timestamp_s",), keys=keys)
    series = rows.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("frame_index", "x_m", "y_m", "timestamp_s"))).alias("_s"),
        F.first("_fps").alias("_fps"),
    )

    def run(f, x, y):
        f = np.asarray(f, dtype=float)
        if f.size < 2:
            return f, x, y
        return kernels.clean_trajectory(f, np.asarray(x, dtype=float), np.asarray(y, dtype=float), sigma, length)

    call = _kernel(run, 3, ["f", "x", "y"])
    cols = [F.col("_s")[c].cast("array<double>") for c in ("frame_index", "x_m", "y_m")]
    out = series.select(*keys, "_fps", F.size("_s").alias("_n"), F.get("_s", F.lit(0))["timestamp_s"].alias("_t0"), call(*cols).alias("_k"))
    out = out.select(*keys, "_fps", "_n", "_t0", F.inline(F.arrays_zip(
        F.col("_k.f").alias("f"), F.col("_k.x").alias("x"), F.col("_k.y").alias("y"))))
    stamp = F.when(F.col("_n") < 2, F.col("_t0")).otherwise(F.col("f") / F.greatest(F.col("_fps"), F.lit(1e-6)))
    return out.select(
        *keys, F.col("f").cast("int").alias("frame_index"), stamp.alias("timestamp_s"),
        F.col("x").alias("x_m"), F.col("y").alias("y_m"), *[F.col("_fps").alias(c) for c in keep],
    )


def resample(traj: DataFrame, mode: str, factor: int = 3, keys: Sequence[str] = SHOT, time: str = "timestamp_s", columns: Sequence[str] = ("x_m", "y_m")) -> DataFrame:
    """Even time grid with ``factor`` times the samples: none, linear or natural cubic.

    Fewer than three samples stay as they are; three samples make cubic fall back to linear.
    Adds grid_no, 0-based.  Where a time repeats within a sequence, its cubic is NaN.
    """
    if mode not in ("none", "linear", "cubic"):
        raise ValueError(f"unknown resampling mode {mode!r}")
    whole = Window.partitionBy(*keys)
    w = whole.orderBy(time)
    if mode == "none":
        return traj.select(*keys, (F.row_number().over(w) - 1).alias("grid_no"), time, *columns)
    if mode == "linear":
        nxt = F.lead(F.struct(time, *columns)).over(w)
        rows = (
            traj.select(*keys, time, *columns).withColumn("_n", F.count(F.lit(1)).over(whole))
            .withColumn("_t0", F.min(time).over(whole)).withColumn("_t1", F.max(time).over(whole))
            .withColumn("_i", F.row_number().over(w) - 1).withColumn("_nx", nxt)
            .withColumn("_h", (F.col("_t1") - F.col("_t0")) / (F.col("_n") * factor - 1))
        )
        few = rows.where(F.col("_n") < 3).select(*keys, F.col("_i").alias("grid_no"), time, *columns)
        seg = rows.where((F.col("_n") >= 3) & F.col("_nx").isNotNull())
        lo = F.greatest(F.floor((F.col(time) - F.col("_t0")) / F.col("_h")) - 1, F.lit(0))
        hi = F.least(F.ceil((F.col(f"_nx.{time}") - F.col("_t0")) / F.col("_h")) + 1, F.col("_n") * factor - 1)
        grid = seg.withColumn("_g", F.explode(F.sequence(lo, hi)))
        last = F.col("_g") == F.col("_n") * factor - 1
        grid = grid.withColumn("_t", F.when(last, F.col("_t1")).otherwise(F.col("_g") * F.col("_h") + F.col("_t0")))
        final_seg = F.col("_i") == F.col("_n") - 2
        mine = (F.col("_t") >= F.col(time)) & ((F.col("_t") < F.col(f"_nx.{time}")) | final_seg)
        grid = grid.where(mine)
        frac = (F.col("_t") - F.col(time)) / (F.col(f"_nx.{time}") - F.col(time))
        vals = [(F.col(c) + (F.col("_nx")[c] - F.col(c)) * frac).alias(c) for c in columns]
        return grid.select(*keys, F.col("_g").cast("int").alias("grid_no"), F.col("_t").alias(time), *vals).unionByName(
            few.withColumn("grid_no", F.col("grid_no").cast("int"))
        )

    @F.pandas_udf("struct<g:array<int>,t:array<double>,a:array<double>,b:array<double>>")
    def call(t: pd.Series, a: pd.Series, b: pd.Series) -> pd.DataFrame:
        """All series of an Arrow batch at once."""
        out = pd.DataFrame({"g": t.map(lambda s: np.arange(len(s))), "t": t, "a": a, "b": b}).astype(object)
        sizes = t.map(len).to_numpy(dtype=np.int64)
        for which, cubic in ((sizes == 3, False), (sizes > 3, True)):
            places = np.flatnonzero(which)
            # the steps of one elimination hold many numbers for every grid point: so many series at once
            for i in range(0, len(places), TOGETHER):
                part = places[i : i + TOGETHER]
                n = sizes[part]
                flat = [np.concatenate(c.iloc[part].to_list()).astype(float) for c in (t, a, b)]
                # without curvature the cubic is the line
                at, v = kernels.natural_cubics(flat[0], np.stack(flat[1:], axis=1), n, factor, curved=cubic)
                cuts = np.cumsum(n * factor)[:-1]
                parts = [[np.arange(k * factor) for k in n], np.split(at, cuts), np.split(v[:, 0].copy(), cuts), np.split(v[:, 1].copy(), cuts)]
                for c, values in enumerate(parts):
                    for row, value in zip(part, values):
                        out.iat[row, c] = value
        return out

    cx, cy = columns
    series = _series(traj, keys, time, [cx, cy])
    return series.select(*keys, call(time, cx, cy).alias("_k")).select(
        *keys, F.inline(F.arrays_zip(
            F.col("_k.g").alias("grid_no"), F.col("_k.t").alias(time), F.col("_k.a").alias(cx), F.col("_k.b").alias(cy))))


# ---- departure -------------------------------------------------------------

def _line(s0, s1, s2, t0, t1):
    det = F.nullif(s0 * s2 - s1 * s1, F.lit(0.0))
    return (s0 * t1 - s1 * t0) / det, (s2 * t0 - s1 * t1) / det


def _rates(pos: DataFrame, conf: Settings, keys: Sequence[str]) -> DataFrame:
    """Adds _r (1 on the last row), tail_slope, median_step and rate to every row."""
    whole = Window.partitionBy(*keys)
    rows = pos.withColumn("_dy", F.col("y_m") - F.lag("y_m").over(whole.orderBy("frame_index"))).withColumn(
        "_r", F.row_number().over(whole.orderBy(F.desc("frame_index"))))
    tail = F.col("_r") <= conf.fit_window
    fwd = F.when(F.col("_dy") > 1e-4, F.col("_dy"))
    slope = F.regr_slope(F.when(tail, F.col("y_m")), F.when(tail, F.col("frame_index").cast("double"))).over(whole)
    rows = rows.withColumn("tail_slope", F.coalesce(slope, F.lit(0.0))).withColumn("_steps", F.count(fwd).over(whole)).withColumn(
        "median_step", F.when(F.col("_steps") >= 3, F.percentile(fwd, F.lit(0.5)).over(whole)).otherwise(0.0))
    stalled = (F.col("tail_slope") < 0.30 * F.col("median_step")) & (F.col("median_step") > 1e-4)
    return rows.withColumn("rate", F.when(stalled, F.col("median_step")).otherwise(F.col("tail_slope"))).drop("_dy", "_steps")


def _curve(rows: DataFrame, conf: Settings, keys: Sequence[str]) -> DataFrame:
    """Adds last_x and x_at_end to every row: where the tail curve reaches the lane end.

    Weighted line and parabola by normal equations over the tail's distinct y
    (centred, so that the sums stay well conditioned), then the hook rules.
    """
    whole = Window.partitionBy(*keys)
    same_y = Window.partitionBy(*keys, "y_m")
    # one representative row per distinct y of the tail, with the median x there
    rep = (F.col("_r") <= conf.curve_window) & (F.row_number().over(same_y.orderBy("_r")) == 1)
    rows = rows.withColumn("_rep", rep).withColumn("_x", F.percentile(F.when(F.col("_r") <= conf.curve_window, F.col("x_m")), F.lit(0.5)).over(same_y))
    one = F.col("_rep").cast("int")
    rows = (
        rows.withColumn("_i", F.sum(one).over(whole.orderBy("y_m", "_r").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .withColumn("n", F.sum(one).over(whole)).withColumn("c", F.avg(F.when(F.col("_rep"), F.col("y_m"))).over(whole))
        .withColumn("_u", F.col("y_m") - F.col("c"))
    )
    weight = (0.5 + (F.col("_i") - 1) / F.greatest(F.col("n") - 1, F.lit(1))) if conf.tail_weights else F.lit(1.0)
    u, x, w, i, n = F.col("_u"), F.col("_x"), weight * weight, F.col("_i"), F.col("n")
    third = F.floor(n / 3)
    tail_n = F.greatest(F.lit(3), third)
    of = lambda e, cond=None: F.when(F.col("_rep") if cond is None else F.col("_rep") & cond, e)
    med = lambda cond, c: F.percentile(of(F.col(c), cond), F.lit(0.5))
    at = lambda cond, c: F.max(of(F.col(c), cond))
    early, late = i <= third, i > n - third
    aggs = {
        **{f"s{p}": F.sum(of(w * F.pow(u, F.lit(float(p))))) for p in range(5)},
        **{f"t{p}": F.sum(of(w * x * F.pow(u, F.lit(float(p))))) for p in range(3)},
        "ymax": F.max(of(F.col("y_m"))), "ymin": F.min(of(F.col("y_m"))),
        "ex": med(early, "_x"), "lx": med(late, "_x"), "ey": med(early, "y_m"), "ly": med(late, "y_m"),
        "x1": at(i == n, "_x"), "x0": at(i == n - tail_n + 1, "_x"), "y0": at(i == n - tail_n + 1, "y_m"),
        "last_x": F.max(F.when(F.col("_r") == 1, F.col("x_m"))),
    }
    fits = rows.withColumns({k: v.over(whole) for k, v in aggs.items()})
    s, t = [F.col(f"s{p}") for p in range(5)], [F.col(f"t{p}") for p in range(3)]
    target = F.lit(conf.lane_length_m) - F.col("c")
    slope, icpt = _line(s[0], s[1], s[2], t[0], t[1])
    m1, m2, m3 = s[2] * s[4] - s[3] * s[3], s[1] * s[4] - s[2] * s[3], s[1] * s[3] - s[2] * s[2]
    det = F.nullif(s[0] * m1 - s[1] * m2 + s[2] * m3, F.lit(0.0))
    r1, r2 = t[1] * s[4] - t[2] * s[3], s[1] * t[2] - s[2] * t[1]
    q0 = (t[0] * m1 - s[1] * r1 + s[2] * (t[1] * s[3] - t[2] * s[2])) / det
    q1 = (s[0] * r1 - t[0] * m2 + s[2] * r2) / det
    q2 = (s[0] * (s[2] * t[2] - s[3] * t[1]) - s[1] * r2 + t[0] * m3) / det
    hook = (n >= 9) & (F.abs(F.col("lx") - F.col("ex")) >= 0.04) & (F.col("ly") - F.col("ey") > 1.0)
    side = F.when(hook, F.signum(F.col("lx") - F.col("ex"))).otherwise(0.0) if conf.hook_inertia else F.lit(0.0)
    fits = (
        fits.withColumn("slope", slope).withColumn("curve", q2).withColumn("side", side)
        .withColumn("x_line", icpt + F.col("slope") * target).withColumn("x_quad", q0 + q1 * target + F.col("curve") * target * target)
        .withColumn("tdy", F.col("ymax") - F.col("y0"))
        .withColumn("delta", (F.col("x1") - F.col("x0")) / F.nullif(F.col("tdy"), F.lit(0.0)) - F.col("slope"))
    )
    turning = (F.abs("tdy") > 1e-6) & (n >= 6)
    strong = turning & (F.col("curve") * F.col("delta") > 0.0) & (F.abs("delta") > 0.02)
    b = F.when(strong, F.lit(conf.quad_blend_strong)).otherwise(F.lit(conf.quad_blend))
    push = F.when(turning & (F.col("side") != 0.0) & (F.col("curve") * F.col("side") > 0.0), F.lit(conf.quad_exaggerate)).otherwise(0.0)
    mixed = b * F.col("x_quad") + (1.0 - b) * F.col("x_line") + push * (F.col("x_quad") - F.col("x_line"))
    span = F.col("ymax") - F.col("ymin")
    line_only = (n < 5) | (span < 1.0) | F.col("curve").isNull() | (F.abs("curve") > conf.curvature_cap)
    fits = fits.withColumn("raw", F.when(F.coalesce(line_only, F.lit(True)), F.col("x_line")).otherwise(mixed))
    back = (F.col("side") != 0.0) & ((F.col("raw") - F.col("last_x")) * F.col("side") < 0.0)
    stay = (n < 2) | (span < 0.35) | F.col("raw").isNull() | back
    return fits.select(*rows.columns, "last_x", F.when(stay, F.col("last_x")).otherwise(F.col("raw")).alias("x_at_end")).drop(
        "_rep", "_x", "_i", "n", "c", "_u")


def tail_rate(pos: DataFrame, conf: Settings = DEFAULT, keys: Sequence[str] = SHOT) -> DataFrame:
    """Forward rate (metres per frame) at the tail; a stalled tail takes the median forward step of the shot."""
    return _rates(pos, conf, keys).where("_r = 1").select(*keys, "tail_slope", "median_step", "rate")


def predict_x_at_y(pos: DataFrame, conf: Settings = DEFAULT, keys: Sequence[str] = SHOT) -> DataFrame:
    """x where the tail curve reaches the lane end."""
    return _curve(_rates(pos, conf, keys), conf, keys).where("_r = 1").select(*keys, "last_x", "x_at_end")


def append_departure(pos: DataFrame, fps: float | Column = DEFAULT.default_fps, conf: Settings = DEFAULT, keys: Sequence[str] = SHOT) -> DataFrame:
    """Positions with at most one more point per shot, where the ball leaves the lane.

    The point is worked out on the last row by windows and emitted next to it:
    the input is read once and moved once.
    """
    fps = F.lit(float(fps)) if not isinstance(fps, Column) else fps
    rows = _curve(_rates(pos.withColumn("_fps", fps), conf, keys), conf, keys)
    rows = rows.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    hold = lambda v, lo, hi: F.least(F.greatest(v, lo), hi)
    cap = F.lit(conf.max_departure_dx_m)
    x = hold(F.col("x_at_end"), F.col("last_x") - cap, F.col("last_x") + cap)
    x = hold(x, F.lit(-conf.x_margin_m), F.lit(conf.lane_width_m + conf.x_margin_m))
    per_m = 1.0 / F.greatest(F.col("rate"), F.lit(1e-4))
    step = hold(F.rint((F.lit(conf.lane_length_m) - F.col("y_m")) * per_m), F.lit(1.0), F.lit(60.0)).cast("int")
    leaves = (F.col("_r") == 1) & (F.col("_n") >= 2) & (F.abs("rate") >= 1e-4) & (F.col("y_m") < conf.lane_length_m - 0.02)
    frame = (F.col("frame_index") + step).cast("int")
    here = F.struct(F.col("frame_index").cast("int").alias("frame_index"), "timestamp_s", "x_m", "y_m")
    gone = F.struct(
        frame.alias("frame_index"), (frame / F.greatest(F.col("_fps"), F.lit(1e-6))).alias("timestamp_s"),
        x.alias("x_m"), F.lit(conf.lane_length_m).alias("y_m"))
    return rows.select(*keys, F.inline(F.when(leaves, F.array(here, gone)).otherwise(F.array(here))))
