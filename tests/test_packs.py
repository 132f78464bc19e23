"""Mask operators on packed runs: whole results against pixel sets, and one exchange without windows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shotlane.operators import masks as mk
from shotlane.operators import packs

KEY = "shot_id long, frame_index int, det_id long"


def _runs(spark, seed=0, masks=40):
    rng = np.random.default_rng(seed)
    rows = []
    for m in range(masks):
        top = int(rng.integers(0, 30))
        for y in range(top, top + int(rng.integers(5, 60))):
            x = int(rng.integers(0, 20))
            rows.append((m % 3 if m % 7 else None, m % 4, m, "lane" if m % 2 else "ball", y, x, x + int(rng.integers(12, 40))))
    rng.shuffle(rows)
    return spark.createDataFrame([tuple(r) for r in rows], f"{KEY}, class_name string, y int, x0 int, x1 int").repartition(3)


def _pixels(rows, key):
    out = {}
    for r in rows:
        out.setdefault(tuple(r[c] for c in key), set()).update((r["y"], x) for x in range(r["x0"], r["x1"] + 1))
    return out


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("batch", ["7", "10000"])
def test_union_and_overlap_against_pixels(spark, batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        a, b = _runs(spark), _runs(spark, 1)
        want = _pixels(a.collect(), mk.CLASS)
        got = mk.union_masks(a).collect()
        assert _pixels(got, mk.CLASS) == want and sum(r["x1"] - r["x0"] + 1 for r in got) == sum(map(len, want.values()))
        other = _pixels(b.collect(), mk.CLASS)
        for r in mk.mask_iou(a, b).collect():
            one, two = (p.get(tuple(r[c] for c in mk.CLASS), set()) for p in (want, other))
            assert (r["intersection"], r["union_area"]) == (len(one & two), len(one | two))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_huge_open_group_is_reduced(spark, monkeypatch):
    import pyarrow as pa

    kept = []
    monkeypatch.setattr(packs, "OPEN", 10)
    rows = [pa.RecordBatch.from_arrays([pa.array([1]), pa.array([[0]]), pa.array([[5 * (i % 3)]]), pa.array([[5 * (i % 3) + 5]])], names=["k", "y", "x0", "x1"]) for i in range(200)]

    def shrink(g):
        kept.append(len(g.id))
        return g.repacked(*mk._merged(g.id, *g.flat))

    (g,) = packs.whole_groups(iter(rows), 1, shrink)
    assert max(kept) <= 12 and len(g.id) < 12
    assert [v.tolist() for v in mk._merged(g.id, *g.flat)] == [[0], [0], [0], [15]]


def test_masks_meet_in_one_exchange_without_windows(spark):
    r = _runs(spark)
    polys = spark.createDataFrame([(1, 1, 1, [(0.0, 0.0), (9.0, 0.0), (9.0, 9.0), (0.0, 9.0)])], f"{KEY}, polygon array<struct<x:double,y:double>>")
    for df in (mk.union_masks(r), mk.mask_iou(r, r), mk.mask_components(r), mk.significant_components(r), mk.largest_component(r), mk.scanline_boundaries(r), mk.polygon_runs(polys), mk.robust_line(r, mk.MASK, "x0", "y")):
        plan = _plan(df)
        assert "Window" not in plan and plan.count("Exchange hashpartitioning") == 1, plan


def test_quad_of_a_clean_mask_reads_its_scan_once(spark):
    rows = [(1, 1, 1, y, 50 - y // 4, 90 + y // 4) for y in range(10, 120)]
    r = spark.createDataFrame(rows, f"{KEY}, y int, x0 int, x1 int")
    sizes = r.select(*mk.MASK).distinct().withColumn("height", F.lit(160)).withColumn("width", F.lit(320))
    q = mk.quad_from_boundaries(r, sizes)
    (got,) = q.collect()
    assert got["reason"] is None and got["polygon"][0]["y"] == 11.0
    assert "Window" not in _plan(q)


def test_points_without_a_place_count_against_the_line(spark):
    rows = [(1, float(2 * i + 1) if i % 10 else None, float(i)) for i in range(40)]
    (got,) = mk.robust_line(spark.createDataFrame(rows, "k int, x double, y double"), ["k"]).collect()
    assert got["inlier_ratio"] == 0.9 and round(got["slope"], 9) == 2.0


def test_packed_masks_give_what_their_runs_give(spark):
    runs = _runs(spark, 2)
    odd = spark.createDataFrame([(1, 1, 1, "lane", None, 3, 9), (1, 1, 1, "lane", 12, None, 9)], runs.schema)
    runs = runs.unionByName(odd).select(*mk.MASK, *mk.RUN)
    polys = runs.groupBy(*mk.MASK).agg(F.max("y").cast("double").alias("_b"))
    at = lambda x, y: F.struct(F.lit(x).alias("x"), y.alias("y"))
    polys = polys.select(*mk.MASK, F.array(at(4.0, F.lit(2.0)), at(30.0, F.lit(2.0)), at(40.0, F.col("_b")), at(0.0, F.col("_b"))).alias("polygon"), F.lit(100).alias("height"), F.lit(60).alias("width"))
    packed = packs.pack(runs, mk.MASK, mk.RUN, nulls=True).persist()
    assert packed.selectExpr("sum(size(y))").first()[0] == runs.count() and packs.pack(packed, mk.MASK, mk.RUN).schema == packed.schema
    sure = packs.pack(runs, mk.MASK, mk.RUN)
    for f, p in ((lambda r: mk.evaluate_trapezoid(r, polys), packed), (mk.significant_components, sure), (mk.scanline_boundaries, sure)):
        one, two = f(runs), f(p)
        assert one.schema.simpleString() == two.schema.simpleString() and one.count() > 20
        assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
    packed.unpersist()


def test_shot_job_joins_and_writes_masks_packed(spark, monkeypatch):
    from shotlane.plans import jobs

    class Stop(Exception):
        pass

    def cut(df, label):
        if label == "lane-masks":
            raise Stop(df.count())
        return df

    monkeypatch.setattr(jobs, "cut", cut)
    rows = [("s", f, f, "lane", y, 90 - y // 2, 110 + y // 2) for f in range(6) for y in range(10, 110)]
    runs = spark.createDataFrame(rows, "shot_id string, frame_index int, det_id long, class_name string, y int, x0 int, x1 int").coalesce(1)
    shots = spark.createDataFrame([("s", 30.0, 160, 320, 6, "key", None)], "shot_id string, fps double, height int, width int, frames int, sd_key string, contact_frame int")
    with pytest.raises(Stop) as stop:
        jobs.analyse_shots(runs, shots)
    assert stop.value.args[0] <= 12


def test_coverage_from_areas_is_that_from_runs(spark):
    runs = _runs(spark, 3)
    frames = runs.select("shot_id", "frame_index").distinct().withColumn("height", F.lit(100)).withColumn("width", F.lit(60))
    one, two = (mk.coverage_ratio(frames, lanes).collect() for lanes in (runs, mk.mask_area(runs)))
    assert sorted(map(str, one)) == sorted(map(str, two)) and any(r["lane_area"] > 0 for r in one)
