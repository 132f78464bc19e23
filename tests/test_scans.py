"""Ranks and recurrences on sequences that no task holds whole."""

import io
from contextlib import redirect_stdout

import numpy as np
import pytest
from pyspark.sql import functions as F

from shotlane.operators import lanes as ln
from shotlane.operators import poses as ps
from shotlane.operators import sequences as sq
from shotlane.operators.scans import affine_scan, exact_ranks, stepwise


def test_ranks_are_places_within_a_key(spark):
    rng = np.random.default_rng(1)
    rows = [("hot" if i % 3 else f"k{i % 40}", int(v)) for i, v in enumerate(rng.integers(0, 10**9, 6000))] + [(None, 5), (None, 3)]
    df = spark.createDataFrame(rows, "k string, v long").repartition(7)
    want = {}
    for k in {r[0] for r in rows}:
        mine = sorted(v for a, v in rows if a == k)
        want |= {(k, v): (i, len(mine)) for i, v in enumerate(mine)}
    got = exact_ranks(df, ["k"], [F.col("v")]).collect()
    assert len(got) == len(rows) and {(r["k"], r["v"]): (r["_r"], r["_count"]) for r in got} == want


@pytest.mark.parametrize("piece", [1, 7, 10_000])
def test_scan_is_the_recurrence(spark, piece):
    rng = np.random.default_rng(2)
    rows = [(k, int(i), float(f), float(v)) for k, n in (("a", 300), ("b", 1), ("c", 40)) for i, f, v in zip(np.sort(rng.choice(900, n, replace=False)) - 50, rng.uniform(-1, 1, n), rng.normal(size=n))]
    df = spark.createDataFrame(rows, "k string, i long, f double, v double")
    got = {(r["k"], r["i"]): (r["p"], r["q"]) for r in affine_scan(df, ["k"], "i", F.col("f"), {"p": (F.col("v"), F.col("v")), "q": (F.col("v") * 2, F.lit(100.0))}, piece).collect()}
    last = {}
    for k, i, f, v in rows:
        p, q = last[k] if k in last else (None, None)
        last[k] = (v, 100.0) if p is None else (f * p + v, f * q + 2 * v)
        assert got[k, i] == pytest.approx(last[k], abs=1e-9)
    assert len(got) == len(rows)


def test_steps_of_many_sequences_at_once():
    out = stepwise(lambda s, v: s + v, np.array([3, 0, 1, 2]), np.array([0.0, 5, 10, 20]), np.arange(6.0))
    assert out.tolist() == [0, 1, 3, 13, 24, 29]


def test_average_of_a_joint_with_a_hundred_thousand_frames(spark):
    n, a = 100_000, 0.4
    df = spark.range(n).select(
        F.lit("s").alias("shot_id"), F.lit(0).alias("person_id"), F.lit(0).alias("joint_id"), F.col("id").cast("int").alias("frame_index"),
        *[((F.col("id") * k) % 101).cast("double").alias(c) for k, c in ((7, "x"), (13, "y"), (29, "z"))]).repartition(5)
    got = ps.ema(df, a).select("frame_index", "x", "y", "z").toPandas().set_index("frame_index").sort_index()
    for k, c in ((7, "x"), (13, "y"), (29, "z")):
        want = stepwise(lambda s, v: np.where(np.isnan(s), v, a * v + (1 - a) * s), np.array([n]), np.array([np.nan]), (np.arange(n) * k % 101).astype(float))
        assert np.allclose(got[c].to_numpy(), want, atol=1e-9)


def test_runs_of_a_long_series_spread_evenly(spark):
    # n runs of two equal values: each run ends two thirds of the way from the end before it to the next value
    n = 3000
    df = spark.range(2 * n).select(F.lit("s").alias("shot_id"), F.col("id").cast("int").alias("frame_index"), F.floor(F.col("id") / 2).cast("double").alias("v"))
    got = [r["o"] for r in sq.spread_flat(df, "v", "o").orderBy("frame_index").collect()]
    end, want = 0.0, [0.0, 0.0]
    for k in range(1, n):
        step = (k + 1 - end) / 3 if k + 1 < n else None
        want += [end + step, end + 2 * step] if step else [float(k)] * 2
        end = want[-1]
    assert np.allclose(got, np.maximum.accumulate(want))


def plan_of(df) -> str:
    with redirect_stdout(io.StringIO()) as out:
        df.explain("formatted")
    return out.getvalue()


def test_a_hot_key_of_points_is_spread(spark, monkeypatch):
    monkeypatch.setattr(ln, "STRETCH", 100)
    rng = np.random.default_rng(8)
    x, y = rng.uniform(0, 600, 3000), rng.uniform(0, 400, 3000)
    den = 1 + 1e-3 * x + 2e-3 * y
    u, v = (2 * x + 0.5 * y + 3) / den, (0.1 * x + 3 * y + 7) / den
    wrong = rng.random(3000) < 0.2
    u = np.where(wrong, u + 700, u)
    rows = [("hot" if i % 3 == 0 else f"s{i % 60}", i, *map(float, p)) for i, p in enumerate(zip(x, y, u, v))]
    df = spark.createDataFrame(rows, "shot_id string, point_id long, x double, y double, u double, v double").repartition(6)
    votes = []
    run = ln._stretch_votes
    monkeypatch.setattr(ln, "_stretch_votes", lambda *a: votes.append(a) or run(*a))
    fit = ln.fit_homography(df)
    got = {r["shot_id"]: r for r in fit.collect()}
    good = {k: sum(1 for r in rows if r[0] == k and not wrong[r[1]]) for k in got}
    assert {k: r["inliers"] for k, r in got.items()} == good and all(r["reason"] is None for r in got.values()) and len(votes) == 2
    assert "Window" not in plan_of(fit)
