"""Quads, scores and tracks of whole masks: every step's result, worked out a batch at a time."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shotlane.functions import geometry as G
from shotlane.operators import lanes as ln
from shotlane.operators import masks as mk
from shotlane.operators import packs

KEY = "shot_id long, frame_index int, det_id long"


def _lanes(spark, seed=0, masks=30):
    rng = np.random.default_rng(seed)
    rows = []
    for m in range(masks):
        top, tall, x, lean = int(rng.integers(0, 40)), int(rng.integers(4, 110)), int(rng.integers(20, 120)), rng.uniform(-0.5, 0.5)
        for y in range(top, top + tall):
            jag = int(rng.integers(-30, 30)) if rng.random() < 0.1 else int(rng.integers(-1, 2))
            left = max(0, int(x - (y - top) * 0.2 + lean * y) + jag)
            rows.append((m % 3, m % 4, m, y, left, left + 12 + (y - top) // 2))
    return spark.createDataFrame(rows, f"{KEY}, y int, x0 int, x1 int").coalesce(1)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _rows(df):
    return sorted(map(str, df.collect()))


def test_quads_come_from_one_pass_over_whole_masks(spark):
    r = _lanes(spark)
    sizes = r.select(*mk.MASK).distinct().withColumns({"height": F.lit(160), "width": F.lit(320)})
    one = r.groupBy(*mk.MASK).agg(*[F.collect_list(c).alias(c) for c in mk.RUN]).localCheckpoint()
    plan = _plan(mk.quad_from_boundaries(one, sizes, whole=True))
    assert plan.count("MapInArrow") == 1 and plan.count("Join") == 1
    assert _rows(mk.quad_from_boundaries(r, sizes)) == _rows(mk.quad_from_boundaries(one, sizes, whole=True))
    reasons = {x["reason"] for x in mk.quad_from_boundaries(r, sizes).collect()}
    assert None in reasons and "dense_few_scanline_samples" in reasons


def test_one_pass_has_what_its_operators_give(spark):
    r = _lanes(spark, 1)
    names = ["_n", "_lines", "_top", "_bot", "_growth", "_inl", "_ls", "_li", "_rs", "_ri", "_tl", "_tr", "_bl", "_br"]
    fields = [packs.whole(c) if i < 2 else packs.double(c) for i, c in enumerate(names)]
    got = {x["det_id"]: x for x in packs.per_group(packs.pack(r, mk.MASK, mk.RUN), mk.MASK, mk._measured, fields).collect()}
    scan = mk.scanline_boundaries(r).localCheckpoint()
    counts = {x["det_id"]: x["count"] for x in scan.groupBy("det_id").count().collect()}
    assert {d: x["_n"] for d, x in got.items() if x["_n"]} == counts and len(counts) > 15
    lines = []
    for side, slope, icpt in (("left", "_ls", "_li"), ("right", "_rs", "_ri")):
        for x in mk.robust_line(scan.select(*mk.MASK, F.col(f"{side}_x").alias("x"), "y"), mk.MASK).collect():
            assert (x["slope"], x["intercept"]) == pytest.approx((got[x["det_id"]][slope], got[x["det_id"]][icpt]), rel=1e-12)
            lines.append(x["det_id"])
    assert sorted(lines) == sorted(d for d, x in got.items() for _ in range(x["_lines"]))
    for target, left, right in (("_top", "_tl", "_tr"), ("_bot", "_bl", "_br")):
        at = spark.createDataFrame([(x["shot_id"], x["frame_index"], d, x[target]) for d, x in got.items() if x["_n"]], f"{KEY}, target_y double")
        near = {x["det_id"]: (x["left_x"], x["right_x"]) for x in mk.boundary_near(r, at).collect()}
        assert near == {d: (x[left], x[right]) for d, x in got.items() if x[left] is not None}


def test_trapezoid_scores_count_pixels(spark):
    r = _lanes(spark, 2, 12)
    odd = spark.createDataFrame([(0, 0, 0, None, 3, 9), (0, 0, 0, 41, None, 90), (0, 0, 0, 42, 5, None)], r.schema)
    corners = [(40.0, 10.0), (70.0, 12.0), (110.0, 90.0), (20.0, 88.0)]
    polys = r.select(*mk.MASK).distinct().withColumns({"polygon": G.quad(*corners), "height": F.lit(80), "width": F.lit(100)})
    df = mk.evaluate_trapezoid(packs.pack(r.unionByName(odd), mk.MASK, mk.RUN, nulls=True), polys)
    assert "Generate" not in _plan(df), "runs are not spread into rows again"

    def span(y):
        xs = []
        for (ax, ay), (bx, by) in zip(corners, corners[1:] + corners[:1]):
            if ay != by and min(ay, by) <= y <= max(ay, by):
                xs.append(ax + (y - ay) * (bx - ax) / (by - ay))
        return (max(int(np.ceil(min(xs) - 1e-9)), 0), min(int(np.floor(max(xs) + 1e-9)), 99)) if xs else None

    quad = {(y, x) for y in range(10, 80) if span(y) for x in range(span(y)[0], span(y)[1] + 1)}
    runs = {}
    for x in r.collect():
        runs.setdefault(x["det_id"], set()).update((x["y"], c) for c in range(x["x0"], x["x1"] + 1))
    seen = 0
    for x in df.collect():
        lane = runs[x["det_id"]]
        # rows below the image still count for the mask, but not for the quad's own pixels
        met = sum(1 for y, c in lane if (s := span(y)) and s[0] <= c <= s[1])
        total = len(lane)
        if x["det_id"] == 0:
            ends = [span(41), span(42)]
            met += (min(90, ends[0][1]) - ends[0][0] + 1) + (ends[1][1] - max(5, ends[1][0]) + 1)
            total += 7  # the run without a row; those without an end have no width
        assert x["mask_area"] == total and x["coverage"] == pytest.approx(met / total) and x["purity"] == pytest.approx(met / len(quad))
        seen += met > 0
    assert seen > 5
    bands, low, high = 14, 10, 79
    fills = {d: [] for d in runs}
    for i in range(bands):
        a, b = int(np.floor(low + i * (high - low) / bands)), int(np.ceil(low + (i + 1) * (high - low) / bands))
        own = sum(1 for y, _ in quad if a <= y < b)
        for d, lane in runs.items():
            fills[d].append(min(1.0, sum(1 for y, c in lane if a <= y < b and (y, c) in quad) / own / 0.55))
    for x in df.where("det_id <> 0").collect():
        v = fills[x["det_id"]]
        assert x["support_score"] == pytest.approx(0.65 * np.mean(v) + 0.35 * np.mean([f > 0.2 for f in v]))


def test_geometry_is_worked_out_once(spark):
    quads = spark.createDataFrame([(9.0,)], "x double").select(G.quad(("x", 9.0), (50.0, 8.0), (70.0, 90.0), (2.0, 95.0)).alias("q"))
    df = quads.select(G.order_quad(F.col("q")).alias("o"), G.valid_vanishing_point(F.col("q"), F.lit(160), F.lit(320)).alias("v"))
    analysed = df._jdf.queryExecution().analyzed().toString()
    assert analysed.count("array_sort") <= 3 and analysed.count("q#") < 60
    (got,) = df.collect()
    assert [tuple(p) for p in got["o"]] == [(9.0, 9.0), (50.0, 8.0), (70.0, 90.0), (2.0, 95.0)] and got["v"]


def test_settled_lines_are_not_fitted_again(monkeypatch):
    rng, sizes, real = np.random.default_rng(4), [], mk._fit_round
    ids, y = np.repeat(np.arange(50), 40), np.tile(np.arange(40.0), 50)
    x = 3 + 0.4 * y + rng.normal(0, 0.5, len(y))
    x[(ids % 5 == 0) & np.isin(y, (19, 20))] += 300
    monkeypatch.setattr(mk, "_fit_round", lambda *a: sizes.append(a[-1]) or real(*a))
    ok, slope, _, share = mk._fitted(ids, x, y, 50)
    assert sizes[0] == 50 and sizes[1] == 10 and ok.all()
    assert np.allclose(slope, 0.4, atol=0.05) and np.allclose(share, np.where(np.arange(50) % 5 == 0, 38 / 40, 1.0))


def test_tracker_moves_quads_as_numbers():
    from shotlane.config import DEFAULT

    t = ln.TrackTable(DEFAULT)
    first, second = [100.0, 10.0, 140.0, 10.0, 160.0, 90.0, 80.0, 90.0], [110.0, 12.0, 150.0, 10.0, 171.0, 91.0, 85.0, 90.0]
    t.step(0, [first])
    (got,) = t.step(1, [second])
    want = np.trunc(0.3 * np.array(second) + (1 - 0.3) * np.array(first)).tolist()
    assert got == (0, True, False, want, np.mean(want[::2]))
    (far,) = t.step(2, [[v + 70 * (i == 1) for i, v in enumerate(want)]])
    assert far[:3] == (0, False, False) and far[3] == want


def test_passed_candidates_are_written_once(spark, monkeypatch):
    from shotlane.plans import jobs
    from shotlane.session import cut as real

    class Stop(Exception):
        pass

    def cut(df, label):
        if label == "assigned":
            raise Stop(_plan(df), df.inputFiles())
        return real(df, label)

    monkeypatch.setattr(jobs, "cut", cut)
    rows = [("s", f, f, "lane", y, 90 - y // 2, 110 + y // 2) for f in range(4) for y in range(10, 110)]
    runs = spark.createDataFrame(rows, "shot_id string, frame_index int, det_id long, class_name string, y int, x0 int, x1 int").coalesce(1)
    shots = spark.createDataFrame([("s", 30.0, 160, 320, 4, "key", None)], "shot_id string, fps double, height int, width int, frames int, sd_key string, contact_frame int")
    with pytest.raises(Stop) as stop:
        jobs.analyse_shots(runs, shots)
    plan, files = stop.value.args
    assert "Window" not in plan and files and all("/passed-" in f for f in files)
