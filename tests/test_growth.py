"""Steps whose memory, files or broadcasts must not grow with the number of shots."""

import os

import pytest
from pyspark.sql import functions as F

from shotlane.operators import dataset as ds
from shotlane.operators import lanes as ln
from shotlane.operators import smoothing as sm
from shotlane.sources import writers as wr

SHOT = "id string, timestamp string, source string, shot_number int, video_key string, fps double"


def _shots(spark, numbers, fps, stamp="2026-01-01"):
    rows = spark.createDataFrame([("a", stamp, "laneballs", n, "v", fps) for n in numbers], SHOT)
    return rows.withColumn("ball_positions", F.array().cast("array<struct<x:double,y:double>>")).withColumn(
        "skeleton_frames", F.array().cast("array<array<struct<joint_id:int,x:double,y:double,z:double>>>"))


def test_shot_store_has_files_by_bucket_and_replaces_only_named_shots(spark, tmp_path):
    path = str(tmp_path / "shots")
    wr.save_shots(_shots(spark, range(2000), 30.0, "2026-01-02"), path)
    wr.save_shots(_shots(spark, [5, 7, 2000, None], 25.0), path)
    got = {r["shot_number"]: r["fps"] for r in wr.load_shots(spark, path).collect()}
    assert len(got) == 2002 and {n for n, f in got.items() if f == 25.0} == {5, 7, 2000, None}
    assert sum(f.endswith(".parquet") for _, _, files in os.walk(path) for f in files) <= 260


def test_common_stems_reads_each_kind_once(spark):
    kinds = [spark.createDataFrame([(s,) for s in v], "stem string") for v in (["a", "b", "b", None], ["b", "a", None], ["b", "c", None])]
    df = ds.common_stems(*kinds)
    assert sorted(df.collect(), key=str) == [("b",), (None,)] or {r[0] for r in df.collect()} == {"b", None}
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 2 and "Join" not in plan


def test_homography_fit_broadcasts_nothing(spark):
    rows = [(k, i, float(i * 13 % 31), float(i * 7 % 19), float(i * 13 % 31) * 2 + 1, float(i * 7 % 19) * 3 + 2) for k in range(3) for i in range(30)]
    fit = ln.fit_homography(spark.createDataFrame(rows, "shot_id long, point_id long, x double, y double, u double, v double"))
    assert "Broadcast" not in fit._jdf.queryExecution().executedPlan().toString()
    assert [r["inliers"] for r in fit.collect()] == [30, 30, 30]


@pytest.mark.parametrize("together", [2, 256])
def test_series_in_small_lots_give_the_same_curves(spark, monkeypatch, together):
    monkeypatch.setattr(sm, "TOGETHER", together)
    rows = [(s, i * (1 + s % 2), i / 30.0, 0.1 * i * s, 0.3 * i) for s in range(7) for i in range(3 + s)]
    pos = spark.createDataFrame(rows, "shot_id long, frame_index int, timestamp_s double, x_m double, y_m double").coalesce(1)
    grid = sm.resample(pos, "cubic").groupBy("shot_id").agg(F.count("*").alias("n"), F.max("y_m").alias("y")).orderBy("shot_id").collect()
    assert [r["n"] for r in grid] == [3 * (3 + s) for s in range(7)]
    assert [round(r["y"], 6) for r in grid] == [round(0.3 * (2 + s), 6) for s in range(7)]
    curve = sm.smooth_spline(pos, "y_m", "y").groupBy("shot_id").agg(F.count("*").alias("n"), F.max("y").alias("y")).orderBy("shot_id").collect()
    assert [r["n"] for r in curve] == [(2 + s) * (1 + s % 2) + 1 for s in range(7)]
    assert [round(r["y"], 3) for r in curve] == [round(0.3 * (2 + s), 3) for s in range(7)]


def test_first_track_of_an_observation_is_the_least_of_its_pairs(spark):
    import random

    rng = random.Random(5)
    quad = lambda x, w: [(x, 10.0), (x + w, 10.0), (x + 2 * w + rng.choice([0, 30.5, -44.25]), 90.0), (x - w, 90.0)]
    shape = "array<struct<x:double,y:double>>"
    place = lambda: rng.choice([float(rng.randrange(-50, 600)), rng.uniform(-50, 600)])
    obs = [(rng.choice([0, 1, None]), i % 190, quad(place(), 20.0) if i % 50 else None) for i in range(200)]
    tracks = [(rng.choice([0, 1, None]), rng.choice([None, *range(40)]), quad(place(), 20.0) if i % 9 else None, rng.choice([None, rng.random()])) for i in range(60)]
    o = spark.createDataFrame(obs + obs[:5], f"shot_id long, det_id long, polygon {shape}")
    t = spark.createDataFrame(tracks, f"shot_id long, track_id int, best_quad {shape}, best_support_score double")
    for variant in ("production", "poster"):
        pairs = ln.match_observations(o, t, variant).groupBy("shot_id", "det_id").agg(F.min("track_id").alias("track_id"))
        got = ln.match_observations(o, t, variant, first=True)
        assert got.columns == [*o.columns, "track_id"]
        got = got.groupBy("shot_id", "det_id").agg(F.min("track_id").alias("track_id"))
        want = sorted(map(str, pairs.collect()))
        assert len(want) > 50 and sorted(map(str, got.collect())) == want
