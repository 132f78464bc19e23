import json
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from shotlane.config import DEFAULT, POSTER
from shotlane.functions import geometry as G
from shotlane.operators import lanes as ln
from shotlane.operators import masks as mk
from shotlane.operators.frames import contact_frame, read_sensor
from shotlane.plans import jobs

QUAD = "array<struct<x:double,y:double>>"


def q(*xy):
    return [(float(a), float(b)) for a, b in zip(xy[::2], xy[1::2])]


def test_homography_maps_corners_and_inverts(spark):
    quad = q(300, 100, 340, 104, 460, 400, 180, 396)
    df = spark.createDataFrame([(quad,)], f"p {QUAD}").withColumn("h", G.homography(F.col("p")))
    want = [(0, 18.288), (1.0541, 18.288), (1.0541, 0), (0, 0)]
    for i, w in enumerate(want):
        x, y = (F.lit(v) for v in quad[i])
        r = df.select(G.project(x, y, F.col("h")).alias("m")).collect()[0]["m"]
        assert (r["x"], r["y"]) == pytest.approx(w, abs=1e-9)
    r = df.select(G.unproject(F.lit(0.4), F.lit(7.0), F.col("h"), F.lit(640), F.lit(480)).alias("b"), "h").collect()[0]
    h = np.array(r["h"]).reshape(3, 3)
    v = h @ [r["b"]["x"], r["b"]["y"], 1.0]
    assert v[:2] / v[2] == pytest.approx([0.4, 7.0], abs=1e-9) and r["h"][8] == 1.0


def lane(x, y=0):
    """A lane whose centre is at x + 45."""
    return q(x + 20, y, x + 60, y, x + 90, y + 200, x, y + 200)


def tracked(spark, *rows, **conf):
    """(frame, quads): the assignment as (frame, track, accepted, created, x of the track's first corner), in order."""
    flat = [("s", f, 10 * f + k, quad) for f, quads in rows for k, quad in enumerate(quads)]
    df = spark.createDataFrame(flat, f"shot_id string, frame_index int, det_id long, polygon {QUAD}")
    got = ln.track_lanes(df, replace(DEFAULT, **conf)).orderBy("frame_index", "det_id").collect()
    return [(r["frame_index"], r["track_id"], r["accepted"], r["created"], r["track_quad"][0]) for r in got]


def test_track_quad_follows_by_the_share_of_the_new_one_in_whole_pixels(spark):
    # 0.3 * 35 + 0.7 * 20 = 24.5, cut to 24; then 0.3 * 35 + 0.7 * 24 = 27.3
    assert tracked(spark, (0, [lane(0)]), (1, [lane(15)]), (2, [lane(15)])) == [(0, 0, True, True, 20.0), (1, 0, True, False, 24.0), (2, 0, True, False, 27.0)]


def test_track_takes_but_does_not_follow_a_jumping_corner(spark):
    # centre 79 px away: near enough; all corners 79 px away: too far to follow
    assert tracked(spark, (0, [lane(0)]), (1, [lane(79)]), (2, [lane(80)])) == [(0, 0, True, True, 20.0), (1, 0, False, False, 20.0), (2, 1, True, True, 100.0)]


def test_candidates_choose_in_order_and_a_track_takes_one_per_frame(spark):
    got = tracked(spark, (0, [lane(0), lane(100)]), (1, [lane(60), lane(90)]), (2, [lane(200), lane(210)]))
    # the first candidate is nearer to the second track, so the other one is left with the first track, 90 px away: a new one
    assert [r[1:4] for r in got[:4]] == [(0, True, True), (1, True, True), (1, True, False), (2, True, True)]
    # a track opened in a frame may take a later candidate of it
    assert [r[1:4] for r in got[4:]] == [(3, True, True), (3, True, False)]


def test_track_ends_after_stale_frames(spark):
    # seen at 0, stale after 5 frames: still open when frame 5 comes, gone (at the end of frame 5) when frame 6 comes
    assert [r[1] for r in tracked(spark, (0, [lane(0)]), (5, [lane(0)]), stale_frames=5)] == [0, 0]
    assert [r[1] for r in tracked(spark, (0, [lane(0)]), (6, [lane(0)]), stale_frames=5)] == [0, 1]


def test_poster_sees_living_tracks_and_the_best_candidate_whatever_its_jump(spark):
    conf = replace(POSTER, stale_frames=5)
    rows = [("s", 0, 1, lane(0), 0.9, 500.0), ("s", 8, 2, lane(400), 0.5, 10.0), ("s", 9, 3, lane(479), 0.8, 10.0)]
    df = spark.createDataFrame(rows, f"shot_id string, frame_index int, det_id long, polygon {QUAD}, score double, mask_area double")
    df = df.withColumn("geometry_score", F.lit(0.0)).withColumn("support_score", F.lit(0.0))
    last = spark.createDataFrame([("s", 11)], "shot_id string, last_frame int")
    got = {r["track_id"]: r for r in ln.poster_tracks(ln.track_lanes(df, conf), df, last, conf=conf).collect()}
    assert (got[0]["born_frame"], got[0]["gone_frame"], got[0]["alive"]) == (0, 5, False) and (got[1]["gone_frame"], got[1]["alive"]) == (14, True)
    assert got[1]["best_frame"] == 9 and got[1]["best_quad"][0]["x"] == 499.0  # not followed, but the best score
    choice = ln.poster_active_lane(ln.poster_tracks(ln.track_lanes(df, conf), df, last, conf=conf).where("alive"))
    assert [r["track_id"] for r in choice.collect()] == [1]  # the first track's area is larger, but it is gone


def test_tracker_walks_a_long_shot(spark):
    n = 60_000  # several Arrow batches; two lanes drift apart from each other and never meet
    frames = spark.range(n).select(F.lit("s").alias("shot_id"), F.col("id").cast("int").alias("frame_index"), F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    x = F.col("k") * 300 + F.col("frame_index") / 2000.0 * (F.col("k") * 2 - 1)
    at = lambda a, b: F.struct((x + a).alias("x"), F.lit(float(b)).alias("y"))
    df = frames.select("shot_id", "frame_index", (F.col("frame_index") * 2 + F.col("k")).cast("long").alias("det_id"), F.array(at(20, 0), at(60, 0), at(90, 200), at(0, 200)).alias("polygon"))
    got = ln.track_lanes(df.repartition(4)).groupBy("track_id", (F.col("det_id") % 2).alias("k")).agg(F.count("*").alias("n"), F.sum(F.col("created").cast("int")).alias("c"))
    assert sorted(tuple(r) for r in got.collect()) == [(0, 0, n, 1), (1, 1, n, 1)]


def test_components_touch_at_corners(spark):
    runs = spark.createDataFrame([(1, 0, 0, 3), (1, 1, 4, 6), (1, 2, 8, 9), (1, 0, 20, 21)], "k int, y int, x0 int, x1 int")
    got = {(r["y"], r["x0"]): r["component_area"] for r in mk.mask_components(runs, ["k"]).collect()}
    assert got == {(0, 0): 7, (1, 4): 7, (2, 8): 2, (0, 20): 2}


def test_components_of_many_masks_against_a_flood_fill():
    rng = np.random.default_rng(11)
    runs, want, sizes = [], [], []
    for density in (0.2, 0.35, 0.5, 0.7, 1.0) * 8:
        grid = rng.random((int(rng.integers(1, 14)), int(rng.integers(1, 40)))) < density
        grid[0, 0] = True
        mine = [(y, x, x + int(np.argmin(np.append(grid[y, x:], False))) - 1) for y in range(grid.shape[0]) for x in range(grid.shape[1]) if grid[y, x] and not (x and grid[y, x - 1])]
        label = np.where(grid, -1, -2)
        for i, (y, x, _) in enumerate(mine):
            todo = [(y, x)]
            while todo:
                r, c = todo.pop()
                if 0 <= r < grid.shape[0] and 0 <= c < grid.shape[1] and label[r, c] == -1:
                    label[r, c] = i
                    todo += [(r + a, c + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
        want += [label[y, x] for y, x, _ in mine]
        runs += mine
        sizes.append(len(mine))
    y, x0, x1 = (np.array(c) for c in zip(*runs))
    assert mk._components(y, x0 - 7, x1 - 7, np.array(sizes)).tolist() == want


def test_iou_of_nothing_and_of_overlap(spark):
    s = "shot_id string, frame_index int, class_name string, y int, x0 int, x1 int"
    a = spark.createDataFrame([("a", 0, "ball", 0, 0, 9), ("a", 0, "ball", 0, 5, 12)], s)
    b = spark.createDataFrame([("a", 0, "ball", 0, 10, 19), ("a", 1, "ball", 0, 0, 0)], s)
    got = {r["frame_index"]: r["iou"] for r in mk.mask_iou(a, b).collect()}
    assert got == {0: pytest.approx(3 / 20), 1: 0.0}


def test_condition_number_against_numpy(spark):
    m = np.random.default_rng(0).normal(size=(20, 9))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(m)], "i int, homography array<double>")
    for r in ln.matrix_health(df).collect():
        assert r["condition_number"] == pytest.approx(np.linalg.cond(m[r["i"]].reshape(3, 3)))


def test_fit_homography_exact_on_four_points_and_none_below(spark):
    src, dst = [(0, 0), (10, 1), (12, 20), (-1, 18)], [(0, 18), (1, 18), (1, 0), (0, 0)]
    rows = [("a", i, float(x), float(y), float(u), float(v)) for i, ((x, y), (u, v)) in enumerate(zip(src, dst))] + [("b", 0, 1.0, 1.0, 1.0, 1.0)]
    got = {r["shot_id"]: r for r in ln.fit_homography(spark.createDataFrame(rows, "shot_id string, point_id long, x double, y double, u double, v double")).collect()}
    h = np.array(got["a"]["homography"]).reshape(3, 3)
    for (x, y), t in zip(src, dst):
        p = h @ [x, y, 1]
        assert p[:2] / p[2] == pytest.approx(t, abs=1e-6)
    assert got["b"]["reason"] == "no_solution"


def test_sensor_cases(spark):
    docs = [
        ('{"BufferData":[{"Timestamp":"2026-04-15T03:48:09.8261380-04:00"}],"AccelerometerJumpTimestamps":["2026-04-15T03:48:11.3261389-04:00"]}', 45),
        ('{"BufferData":[],"AccelerometerJumpTimestamps":["2026-04-15T03:48:11Z"]}', None),
        ('{"BufferData":[{"Timestamp":"2026-04-15T03:48:11Z"}],"AccelerometerJumpTimestamps":["2026-04-15T03:48:09Z"]}', None),
        ('{"BufferData":[{"Timestamp":"soon"}],"AccelerometerJumpTimestamps":["2026-04-15T03:48:09Z"]}', None),
    ]
    df = spark.createDataFrame([(i, d, 30.0) for i, (d, _) in enumerate(docs)], "i int, sensor_json string, fps double")
    got = [r["contact_frame"] for r in contact_frame(read_sensor(df)).orderBy("i").collect()]
    assert got == [w for _, w in docs]


def test_whole_shot_from_drawn_masks(spark):
    """A drawn lane and a ball rolling up it: the ball must come out in lane metres."""
    h, w, n = 240, 320, 40
    rows = []
    left = lambda y: 140 - 0.45 * (y - 40)
    right = lambda y: 180 + 0.45 * (y - 40)
    for f in range(n):
        rows += [("s", f, 100 * f, "lane", y, round(left(y)), round(right(y))) for y in range(40, 231)]
        # depth falls with the cross ratio, as a camera sees even speed
        k = f / (n - 1)
        rt = (right(40) - left(40)) / (right(230) - left(230))
        u = k * rt / (k * rt + 1 - k) if k < 1 else 1.0
        y = round(230 - 190 * (k * 1.0 / (k + (1 - k) * rt)))
        del u
        x = round((left(y) + right(y)) / 2)
        rows += [("s", f, 100 * f + 1, "ball", yy, x - 3, x + 3) for yy in range(max(y - 6, 0), y + 1)]
    runs = spark.createDataFrame(rows, "shot_id string, frame_index int, det_id long, class_name string, y int, x0 int, x1 int")
    shots = spark.createDataFrame([("s", 30.0, h, w, n, "key", None), ("none", 30.0, h, w, 5, "key", None)], "shot_id string, fps double, height int, width int, frames int, sd_key string, contact_frame int")
    from dataclasses import replace

    out = jobs.analyse_shots(runs, shots, replace(DEFAULT, default_start_frame=0))
    health = {r["shot_id"]: r for r in out.health.collect()}
    assert health["s"]["frames_with_lane"] == n and health["s"]["frames_with_ball"] == n and health["none"]["homography_determinant"] == 0.0
    pos = out.positions.orderBy("frame_index").collect()
    assert all(abs(r["x_m"] - 1.0541 / 2) < 0.1 for r in pos) and pos[0]["y_m"] < 1.0 and pos[-1]["y_m"] > 17.0
    kin = out.kinematics.collect()
    assert sorted((r["shot_id"], r["quarter"]) for r in kin) == [(s, i) for s in ("none", "s") for i in (1, 2, 3, 4)]
    runs_of = spark.createDataFrame([("s", "Run s", "v", "key", 30.0), ("none", "Run none", "v", None, 30.0)], "shot_id string, name string, video_key string, sd_key string, fps double")
    poses = spark.createDataFrame([("s", f, j, float(j), float(f), 0.0) for f in (1, 0) for j in (2, 1)], "shot_id string, frame_index int, joint_id int, x double, y double, z double")
    sections = jobs.analysed_sections(runs_of.withColumn("updated_at", F.lit("2024-01-01").cast("timestamp")), out, poses)
    held = {(r["name"], r["section"]): json.loads(r["payload"]) for r in sections.collect()}
    assert len(held) == 6 and held["Run none", "laneballs"]["ball_points"] == [] and held["Run none", "laneballs"]["is_trapezoid"] is False
    assert [p["y"] for p in held["Run s", "aggregated"]["ball_points"]] == [r["y_m"] for r in pos]
    assert held["Run s", "laneballs"]["health"]["frames_with_lane"] == n and len(held["Run s", "laneballs"]["kinematics_table"]) == 4
    assert [[j["joint_id"] for j in f] for f in held["Run s", "fourdbody"]["skeleton_points"]] == [[1, 2], [1, 2]]
    assert [f[0]["y"] for f in held["Run s", "fourdbody"]["skeleton_points"]] == [0.0, 1.0]
