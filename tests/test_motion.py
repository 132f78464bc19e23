"""Hand-computed and brute-force checks of the sequence operators."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shotlane.operators import kernels as kn
from shotlane.operators import sequences as sq
from shotlane.operators import smoothing as sm
from shotlane.operators import trim as tr
from shotlane.operators.kinematics import kinematics_from_points, kinematics_per_quarter

POS = "shot_id string, frame_index int, timestamp_s double, x_m double, y_m double"


def frame(spark, rows):
    return spark.createDataFrame([("a", f, f / 30.0, x, y) for f, x, y in rows], POS)


def test_quarters_count_boundary_twice_and_keep_four_rows(spark):
    q = 18.288 / 4
    got = kinematics_per_quarter(frame(spark, [(0, 0.5, 0.0), (30, 0.5, q), (60, 0.5, 2 * q + 0.1), (90, 0.5, 30.0)])).orderBy("quarter").collect()
    assert [r["sample_count"] for r in got] == [1, 1, 1, 1]
    assert got[0]["mean_speed_mps"] == pytest.approx(q) and got[0]["mean_acceleration_mps2"] == 0.0
    assert got[3]["mean_speed_mps"] == pytest.approx(30.0 - 2 * q - 0.1)


def test_kinematics_of_one_point_is_zero(spark):
    got = kinematics_per_quarter(frame(spark, [(3, 0.5, 1.0)])).collect()
    assert len(got) == 4 and all(r["sample_count"] == 0 and r["mean_speed_mps"] == 0.0 for r in got)


def test_stored_points_default_rate_and_empty_shot(spark):
    df = spark.createDataFrame(
        [("a", None, [(0.5, 0.0), (0.5, 1.0)]), ("b", 25.0, [])], "shot_id string, fps double, ball_positions array<struct<x:double,y:double>>")
    got = {(r["shot_id"], r["quarter"]): r for r in kinematics_from_points(df).collect()}
    assert len(got) == 8
    assert got["a", 1]["mean_speed_mps"] == pytest.approx(30.0) and got["b", 1]["sample_count"] == 0


# ---- trimming against a plain restatement ----------------------------------

L, W = 18.288, 1.0541


def inside(p):
    return -0.15 <= p[1] <= W + 0.15 and -0.20 <= p[2] <= L + 0.40


def brute_interval(ps):
    cuts = [0]
    for i in range(1, len(ps)):
        g, dx, dy = max(ps[i][0] - ps[i - 1][0], 1), ps[i][1] - ps[i - 1][1], ps[i][2] - ps[i - 1][2]
        if not inside(ps[i]) or ps[i][2] > L + 0.35 or g > 36 or dy < -0.35 or abs(dx) > 0.42 or dy / g > 0.75:
            cuts.append(i)
    spans = list(zip(cuts, [*cuts[1:], len(ps)]))
    rank = lambda s: (sum(map(inside, ps[s[0]:s[1]])), max(p[2] for p in ps[s[0]:s[1]]) - min(p[2] for p in ps[s[0]:s[1]]), ps[s[1] - 1][0] - ps[s[0]][0])
    lo, hi = max(spans, key=rank)
    while hi - lo >= 2 and ps[lo][2] < -0.08:
        lo += 1
    while hi - lo >= 4 and not (ps[lo + 3][2] - ps[lo][2] >= -0.05 and inside(ps[lo])):
        lo += 1
    while hi - lo >= 4 and not (inside(ps[hi - 1]) and ps[hi - 1][2] <= L + 0.35 and ps[hi - 1][2] - ps[hi - 2][2] >= -0.2):
        hi -= 1

    def middle():
        y = np.diff([p[2] for p in ps[lo:hi]])
        x = np.diff([p[1] for p in ps[lo:hi]])
        a, b = int(len(y) * 0.2), int(len(y) * 0.8)
        up = y[a:b][y[a:b] > 0]
        return y, x, up, np.std(x[a:b]) if b > a else 0.0

    if hi - lo >= 8:
        y, _, up, _ = middle()
        if up.size >= 3:
            m = np.median(up)
            slow = [v < 0.3 * m for v in y]
            stalls = [k for k in range(1, max(2, int(len(y) * 0.4))) if slow[k] and slow[k - 1]]
            if stalls:
                good = [k for k in range(stalls[-1] + 1, len(y) - 2) if (y[k:k + 3] >= 0.45 * m).all()]
                lo += good[0] if good else 0
    if hi - lo >= 8:
        y, x, up, sd = middle()
        if up.size >= 3:
            bad = lambda k: y[k] < 0.25 * np.median(up) or abs(x[k]) > max(2.5 * sd, 0.08)
            n, k = 0, len(y) - 1
            while hi - lo > 6 and n < 6 and bad(k):
                hi, n, k = hi - 1, n + 1, k - 1
    return lo, hi


def test_trim_matches_restatement_on_random_shots(spark):
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for s in range(120):
        n = int(rng.integers(1, 45))
        f = np.cumsum(rng.choice([1, 1, 1, 2, 3, 40], n, p=[0.55, 0.2, 0.1, 0.1, 0.04, 0.01]))
        y = np.cumsum(rng.choice([0.4, 0.05, -0.02, 0.5, -0.3], n, p=[0.6, 0.14, 0.1, 0.12, 0.04])) - 0.3
        x = 0.5 + np.cumsum(rng.normal(0, 0.03, n))
        ps = [(int(a), float(b), float(c)) for a, b, c in zip(f, x, y)]
        lo, hi = brute_interval(ps)
        want[str(s)] = [p[0] for p in ps[lo:hi]]
        rows += [(str(s), a, a / 30.0, b, c) for a, b, c in ps]
    got: dict = {}
    for r in tr.trim_detections(spark.createDataFrame(rows, POS)).collect():
        got.setdefault(r["shot_id"], []).append(r["frame_index"])
    assert {k: sorted(v) for k, v in got.items()} == want


def test_diagnostics_of_short_shots(spark):
    r = tr.trim_diagnostics(frame(spark, [(4, 0.5, 1.0)])).collect()[0]
    assert (r["cut_reason"], r["last_kept_frame_index"], r["current_dy"]) == (None, 4, None)
    assert tr.ball_path_score(frame(spark, [(0, 9.0, 1.0)])).collect()[0]["ball_score"] == 0.0


# ---- kernels ---------------------------------------------------------------

@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(-50, 50), min_size=1, max_size=40))
def test_isotonic_is_the_minimax_mean(v):
    v = np.array(v)
    c = np.concatenate([[0.0], np.cumsum(v)])
    n = v.size
    want = [max(min((c[k + 1] - c[j]) / (k + 1 - j) for k in range(i, n)) for j in range(i + 1)) for i in range(n)]
    got = kn.isotonic(v)
    assert np.allclose(got, want, atol=1e-9)
    assert (np.diff(got) >= -1e-12).all() and np.allclose(kn.isotonic(got), got)


def test_spline_returns_the_cubic_when_it_fits_the_budget():
    x = np.arange(20.0)
    y = 0.3 + 0.1 * x - 0.002 * x ** 2 + 1e-4 * x ** 3
    assert np.allclose(kn.smoothing_spline(x, y, 20 * 0.055 ** 2, x), y, atol=1e-9)


def test_spline_spends_its_budget_and_follows_a_bend():
    x = np.arange(60.0)
    y = np.where(x < 30, 0.2 * x, 6.0 + 0.6 * (x - 30)) + 0.4 * np.sin(x / 4)
    s = 60 * 0.055 ** 2
    fit = kn.smoothing_spline(x, y, s, x)
    assert ((fit - y) ** 2).sum() == pytest.approx(s, rel=2e-3)


def test_natural_cubics_keep_lines_and_fit_the_tridiagonal_equations():
    rng = np.random.default_rng(4)
    sizes = np.array([5, 3, 40, 7, 5, 4])
    parts = [np.cumsum(rng.uniform(0.1, 2.0, n)) for n in sizes]
    t = np.concatenate(parts)
    v = np.stack([rng.normal(size=t.size), 2 * t + 1], axis=1)
    curv, starts = kn.curvatures(t, v, sizes), np.cumsum(sizes) - sizes
    at, out = kn.natural_cubics(t, v, sizes, 3)
    assert np.allclose(out[:, 1], 2 * at + 1)
    for n, s, g in zip(sizes, starts, starts * 3):
        h, m, y = np.diff(t[s : s + n]), curv[s : s + n, 0], v[s : s + n, 0]
        assert m[0] == m[-1] == 0
        assert np.allclose(h[:-1] * m[:-2] + 2 * (h[:-1] + h[1:]) * m[1:-1] + h[1:] * m[2:], 6 * np.diff(np.diff(y) / h))
        assert np.allclose(at[g : g + 3 * n], np.linspace(t[s], t[s + n - 1], 3 * n))
        assert np.allclose(out[[g, g + 3 * n - 1], 0], y[[0, -1]])
    # a grid on the points gives the points back
    even = np.arange(9.0)
    found = kn.natural_cubics(even, np.stack([even ** 3 - even, -even], axis=1), np.array([9]), 9)
    assert np.allclose(found[1][::10], np.stack([even ** 3 - even, -even], axis=1))


def test_resample_cubic_of_a_long_sequence_and_of_short_ones(spark):
    long = spark.range(30_000).select(F.lit("long").alias("shot_id"), (F.col("id") / 10.0).alias("timestamp_s"), (F.col("id") * 2.0).alias("x_m"), F.lit(1.0).alias("y_m"))
    short = spark.createDataFrame([("two", 0.0, 1.0, 2.0), ("two", 1.0, 3.0, 4.0), ("three", 0.0, 0.0, 0.0), ("three", 1.0, 9.0, 0.0), ("three", 2.0, 0.0, 0.0), ("again", 1.0, 0.0, 0.0)]
        + [("again", float(i), 0.0, 0.0) for i in range(4)], long.schema)
    got = sm.resample(long.unionByName(short), "cubic").cache()
    count = {r["shot_id"]: r["count"] for r in got.groupBy("shot_id").count().collect()}
    assert count == {"long": 90_000, "two": 2, "three": 9, "again": 15}
    assert got.where("shot_id = 'long' AND abs(x_m - 20 * timestamp_s) > 1e-6").count() == 0
    three = [r["x_m"] for r in got.where("shot_id = 'three'").orderBy("grid_no").collect()]
    assert np.allclose(three, np.interp(np.linspace(0, 2, 9), [0, 1, 2], [0, 9, 0]))
    assert got.where("shot_id = 'two' AND x_m IN (1.0, 3.0)").count() == 2
    got.unpersist()


def test_hook_clamp_freezes_reversal():
    y = np.linspace(0, 18, 40)
    x = np.concatenate([np.linspace(0.3, 0.7, 36), [0.68, 0.66, 0.69, 0.72]])
    out = kn.clamp_hook(x, y)
    assert out[36] == out[35] and out[37] == out[35] and out[39] == 0.72


def test_spread_flat_twin_of_the_kernel(spark):
    v = [0.0, 1.0, 1.0, 1.0, 2.0, 2.0, 3.0, 3.0]
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate(v)], "shot_id string, frame_index int, v double")
    got = [r["o"] for r in sq.spread_flat(df, "v", "o").orderBy("frame_index").collect()]
    assert np.allclose(got, kn.spread_flat(np.array(v)))


def test_smooth_trajectory_is_dense_forward_and_in_lane(spark):
    rng = np.random.default_rng(1)
    f = np.sort(rng.choice(np.arange(70), 45, replace=False))
    raw = frame(spark, [(int(i), float(0.5 + 0.002 * i + rng.normal(0, 0.02)), float(0.26 * i + rng.normal(0, 0.05))) for i in f])
    got = sm.smooth_trajectory(raw, 30.0).orderBy("frame_index").collect()
    assert [r["frame_index"] for r in got] == list(range(f[0], f[-1] + 1))
    y = np.array([r["y_m"] for r in got])
    assert (np.diff(y) >= -1e-12).all() and y.min() >= 0 and y.max() <= L
    assert np.abs(y - 0.26 * np.arange(f[0], f[-1] + 1)).max() < 0.3


def test_departure_on_a_straight_roll(spark):
    rows = frame(spark, [(i, 0.5, 0.25 * i) for i in range(60)])
    last = sm.append_departure(rows, 30.0).orderBy("frame_index").collect()[-1]
    assert last["y_m"] == L and last["x_m"] == pytest.approx(0.5)
    assert last["frame_index"] == 59 + round((L - 0.25 * 59) / 0.25)


def test_departure_not_added_at_the_end_or_to_one_point(spark):
    assert sm.append_departure(frame(spark, [(i, 0.5, L - 0.01 - 0.2 * (9 - i)) for i in range(10)])).count() == 10
    assert sm.append_departure(frame(spark, [(1, 0.5, 2.0)])).count() == 1


def test_gap_velocity_carries_over_misses(spark):
    df = spark.createDataFrame([("a", 0, 0.0, 0.0), ("a", 1, None, None), ("a", 2, 0.2, 0.4), ("a", 3, 0.3, 0.6)], "shot_id string, frame_index int, x_m double, y_m double")
    got = sq.gap_velocity(df, dt=0.1).orderBy("frame_index").collect()
    assert got[1]["vx"] is None and got[2]["vx"] == pytest.approx(1.0) and got[3]["vy"] == pytest.approx(2.0)
    assert got[2]["ax"] is None and got[3]["ax"] == pytest.approx(0.0, abs=1e-9)


def test_non_finite_position_ends_its_shot_only(spark):
    df = spark.createDataFrame([("a", 0, 0.0, 0.0), ("a", 1, math.inf, 0.0), ("a", 2, 0.1, 0.1), ("b", 0, 0.0, 0.0), ("b", 1, 1.0, 0.0)], "shot_id string, frame_index int, x_m double, y_m double")
    got = sq.gap_velocity(df, dt=1.0).orderBy("shot_id", "frame_index").collect()
    assert [r["error"] for r in got] == [None, sq.NON_FINITE, sq.NON_FINITE, None, None]
    assert [r["vx"] for r in got] == [None, None, None, None, 1.0]


def test_hot_frame_is_reduced_before_the_shuffle(spark):
    df = spark.range(50000).selectExpr("'a' shot_id", "0 frame_index", "cast(50000 - id as double) timestamp_s", "0.5d x_m", "1.0d y_m")
    assert sq.first_per_frame(df).collect()[0]["timestamp_s"] == 1.0
    plan = sq.first_per_frame(df)._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in plan
