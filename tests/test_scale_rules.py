"""What must hold whatever the size: no caps, no lost frames, no code needed on the workers."""

import datetime as dt
import os
import subprocess
import sys
import tempfile
from pathlib import Path

import numpy as np
import pytest

from shotlane.operators import kernels as kn
from shotlane.operators import lanes as ln
from shotlane.operators import masks as mk
from shotlane.operators import poses as ps
from shotlane.operators import store
from shotlane.session import cut, release, scratch, scratch_path

REPO = Path(__file__).resolve().parents[1]


def test_kernels_run_where_the_package_is_only_on_the_driver(tmp_path):
    code = f"""
import sys
sys.path.insert(0, {str(REPO)!r})
from shotlane.session import build_session
spark = build_session("local[2]", **{{"spark.sql.shuffle.partitions": "2", "spark.checkpoint.dir": "file://{tmp_path}"}})
import __spark_entry__ as entry
assert entry.queries()["clean_positions"](spark, "/root/testdata/sf0.001").count() > 0
"""
    with tempfile.TemporaryDirectory() as elsewhere:
        env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
        done = subprocess.run([sys.executable, "-c", code], cwd=elsewhere, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]


def test_homography_is_found_at_thirty_percent_inliers(spark):
    rng = np.random.default_rng(11)
    rows = []
    for shot in range(6):
        x, y = rng.uniform(0, 600, 160), rng.uniform(0, 400, 160)
        den = 1 + 1e-3 * x + 2e-3 * y
        u, v = (2 * x + 0.5 * y + 3) / den, (0.1 * x + 3 * y + 7) / den
        bad = np.arange(160) >= 48
        u, v = np.where(bad, rng.uniform(0, 900, 160), u), np.where(bad, rng.uniform(0, 900, 160), v)
        rows += [(f"s{shot}", i, *map(float, p)) for i, p in enumerate(zip(x, y, u, v))]
    got = ln.fit_homography(spark.createDataFrame(rows, "shot_id string, point_id long, x double, y double, u double, v double")).collect()
    assert len(got) == 6 and all(r["reason"] is None and 48 <= r["inliers"] <= 56 for r in got)


def test_every_frame_counts_in_the_map(spark):
    runs = "shot_id string, frame_index int, class_name string, det_id int, y int, x0 int, x1 int"
    both = spark.createDataFrame([("a", 0, "lane", 0, 0, 0, 9), ("a", 0, "ball", 1, 5, 0, 3)], runs)
    frames = spark.createDataFrame([("a", 0), ("a", 1)], "shot_id string, frame_index int")
    per_frame = mk.map_50_95(mk.mask_iou(both, both), frames)
    assert {r["frame_index"]: r["map_50_95"] for r in per_frame.collect()} == {0: 1.0, 1: 0.0}
    assert [tuple(r) for r in mk.episode_map(per_frame).collect()] == [("a", 0.5, 2)]


def test_repeats_of_a_joint_count_once(spark):
    rows = [("a", 0, 0, 0, 1.0, 0.0, 0.0, 0), ("a", 1, 0, 0, 9.0, 0.0, 0.0, 1), ("a", 1, 0, 0, 3.0, 0.0, 0.0, 2)]
    df = spark.createDataFrame(rows, "shot_id string, frame_index int, person_id int, joint_id int, x double, y double, z double, seq int")
    got = {r["frame_index"]: r["x"] for r in ps.ema(df, 0.4, order=("seq",)).collect()}
    assert got == pytest.approx({0: 1.0, 1: 1.8})


def test_store_keeps_its_number_of_buckets(spark):
    path = scratch_path(spark, "buckets")
    row = lambda payload, hour: spark.createDataFrame([("Run A", "laneballs", payload, "v", None, dt.datetime(2025, 1, 1, hour))], "name string, section string, payload string, video_key string, sd_key string, updated_at timestamp")
    store.upsert_run_sections(spark, path, row("one", 1), 8)
    store.upsert_run_sections(spark, path, row("two", 2))
    assert [r["payload"] for r in store.open_runs(spark, path).collect()] == ["two"]
    with pytest.raises(ValueError):
        store.upsert_run_sections(spark, path, row("three", 3), 16)


def test_kernels_by_hand():
    assert np.allclose(kn.spread_flat(np.array([0.0, 2, 2, 3])), [0, 1, 2, 3])
    assert np.allclose(kn.spread_flat(np.array([0.0, 1, 1, 1, 2, 2, 5])), [0, 0.5, 1, 1.5, 1.5 + 3.5 / 3, 1.5 + 7 / 3, 5])
    assert kn.spread_flat(np.array([])).size == 0 and np.allclose(kn.spread_flat(np.array([1.0, 1.0])), [1, 1])
    assert np.allclose(kn.anchor_ends(np.zeros(12), np.ones(12)), [0.5, 0.375, 0.25, 0.125, 0, 0, 0, 0, 0.125, 0.25, 0.375, 0.5])
    assert np.allclose(kn.anchor_ends(np.zeros(3), np.ones(3)), [0.5, 0.4375, 0.5])


def test_scratch_of_a_block_is_released(spark):
    outside = cut(spark.range(5), "outside")
    with scratch() as paths:
        inside = cut(spark.range(7), "inside")
        assert inside.count() == 7
    cut(spark.range(3), "later")
    assert len(paths) == 1 and "inside" in paths[0]
    release(spark, paths)
    assert not os.path.exists(paths[0].removeprefix("file://")) and outside.count() == 5
