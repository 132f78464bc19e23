"""Streaming twins, the store, files and the catalogue itself."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from shotlane.functions import text as tx
from shotlane.operators import dataset as ds
from shotlane.operators import lanes as ln
from shotlane.operators import poses as ps
from shotlane.operators import sequences as sq
from shotlane.operators import store as st
from shotlane.session import scratch_path
from shotlane.sources import readers as rd
from shotlane.sources import writers as wr
from shotlane.streaming import stateful as sf


def replay(spark, df, parts, build, tmp):
    """Write df in time order as ``parts`` files and run build over them one file per micro-batch."""
    src = f"{tmp}/in"
    df = df.withColumn("_p", F.ntile(parts).over(__import__("pyspark").sql.Window.orderBy("frame_index")))
    for p in range(1, parts + 1):
        df.where(F.col("_p") == p).drop("_p").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(df.drop("_p").schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = build(stream).writeStream.format("parquet").option("path", f"{tmp}/out").option("checkpointLocation", f"{tmp}/cp").trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None
    return spark.read.parquet(f"{tmp}/out")


def test_stream_ema_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [("a", f, 0, j, *[float(v) for v in rng.normal(size=3)]) for f in range(12) for j in (1, 2) if (f + j) % 4]
    df = spark.createDataFrame(rows, "shot_id string, frame_index int, person_id int, joint_id int, x double, y double, z double")
    key = lambda r: (r["joint_id"], r["frame_index"])
    got = {key(r): r["x"] for r in replay(spark, df, 3, sf.stream_ema, tmp_path).where("not late").collect()}
    want = {key(r): r["x"] for r in ps.ema(df).collect()}
    assert got == pytest.approx(want)


def test_stream_tracks_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = []
    for f in range(15):
        for k in range(2):
            x = float(rng.integers(0, 300))
            rows.append(("s", f, 2 * f + k, [(x + 20, 0.0), (x + 60, 0.0), (x + 90, 200.0), (x, 200.0)]))
    df = spark.createDataFrame(rows, "shot_id string, frame_index int, det_id long, polygon array<struct<x:double,y:double>>")
    cols = ["det_id", "track_id", "accepted", "track_centroid_x"]
    got = replay(spark, df, 5, sf.stream_tracks, tmp_path).where("not late").select(*cols).orderBy("det_id").collect()
    assert got == ln.track_lanes(df).select(*cols).orderBy("det_id").collect()


def test_stream_velocity_equals_batch_and_flags_late_rows(spark, tmp_path):
    rows = [("s", f, None if f % 5 == 3 else 0.1 * f * f, 0.2 * f) for f in range(14)]
    df = spark.createDataFrame(rows, "shot_id string, frame_index int, x_m double, y_m double")
    out = replay(spark, df, 4, sf.stream_velocity, tmp_path)
    got = {r["frame_index"]: r["vx"] for r in out.where("not late").collect()}
    want = {r["frame_index"]: r["vx"] for r in sq.gap_velocity(df).collect()}
    assert got == pytest.approx(want)
    assert sf.late_rows(out).count() == 0


def test_stream_velocity_ends_a_shot_with_a_broken_position(spark, tmp_path):
    rows = [(s, f, float("inf") if (s, f) == ("bad", 4) else 0.1 * f, 0.2 * f) for s in ("bad", "good") for f in range(8)]
    df = spark.createDataFrame(rows, "shot_id string, frame_index int, x_m double, y_m double")
    cols = ["shot_id", "frame_index", "vx", "error"]
    got = replay(spark, df, 4, sf.stream_velocity, tmp_path).select(*cols).orderBy(*cols[:2]).collect()
    assert got == sq.gap_velocity(df).select(*cols).orderBy(*cols[:2]).collect()
    assert [r["frame_index"] for r in got if r["error"]] == [4, 5, 6, 7] and {r["shot_id"] for r in got if r["error"]} == {"bad"}


def test_stream_upsert_is_repeatable(spark, tmp_path):
    src, store = f"{tmp_path}/u", scratch_path(spark, "stream-store")
    up = lambda s, p, t: spark.createDataFrame([("Shot 1", s, p, "v.mp4", None, t)], "name string, section string, payload string, video_key string, sd_key string, updated_at string").withColumn(
        "updated_at", F.col("updated_at").cast("timestamp"))
    up("laneballs", "1", "2026-01-01").write.mode("append").parquet(src)
    up("fourdbody", "2", "2026-01-02").write.mode("append").parquet(src)
    schema = up("x", "y", "2026-01-01").schema
    for run in ("cp1", "cp2"):
        sf.stream_upsert(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src), store, f"{tmp_path}/{run}").awaitTermination(120)
    rows = st.open_runs(spark, store).orderBy("section").collect()
    assert [(r["section"], r["payload"], r["slug"]) for r in rows] == [("fourdbody", "2", "Shot_1"), ("laneballs", "1", "Shot_1")]
    assert {r["created_at"].year for r in rows} == {2026} and len({r["id"] for r in rows}) == 1


def test_upsert_keeps_sensor_key_and_other_sections(spark):
    path = scratch_path(spark, "runs")
    cols = "name string, section string, payload string, video_key string, sd_key string, updated_at timestamp"
    from datetime import datetime

    st.upsert_run_sections(spark, path, spark.createDataFrame([("r", "laneballs", "a", "v1", "sd1", datetime(2026, 1, 1)), ("q", "laneballs", "z", "v9", None, datetime(2026, 1, 1))], cols))
    st.upsert_run_sections(spark, path, spark.createDataFrame([("r", "fourdbody", "b", "v2", None, datetime(2026, 1, 3))], cols))
    got = {(r["slug"], r["section"]): r for r in st.open_runs(spark, path).collect()}
    assert set(got) == {("r", "laneballs"), ("r", "fourdbody"), ("q", "laneballs")}
    r = got["r", "laneballs"]
    assert (r["payload"], r["video_key"], r["sd_key"], r["created_at"].day, r["updated_at"].day) == ("a", "v2", "sd1", 1, 3)


def test_run_documents_skip_corrupt_and_name_from_file(spark, tmp_path):
    (tmp_path / "good.json").write_text(json.dumps({"name": "Good one", "slug": "Good_one", "sections": {"laneballs": {"fps": 30}}}))
    (tmp_path / "plain.json").write_text(json.dumps({"sections": {}}))
    (tmp_path / "bad.json").write_text("{nope")
    runs = rd.read_runs(spark, str(tmp_path))
    assert {(r["slug"], r["name"]) for r in runs.collect()} == {("Good_one", "Good one"), ("plain", "plain")}
    assert rd.run_sections_of(runs).select("section", "payload").collect() == [("laneballs", '{"fps": 30}')]


def test_label_files_round_trip_with_an_empty_one(spark, tmp_path):
    path = str(tmp_path / "labels")
    df = spark.createDataFrame([("a", "0 0.1 0.2 0.3 0.4 0.5 0.6\n1 0.1 0.1 0.2 0.1 0.2 0.2\n"), ("b", "")], "image string, label_text string")
    wr.write_labels(df, path)
    lines = spark.read.schema("value string, image string").text(path)
    assert sorted(r["value"] for r in lines.where("image = 'a'").collect()) == ["0 0.1 0.2 0.3 0.4 0.5 0.6", "1 0.1 0.1 0.2 0.1 0.2 0.2"]
    assert "image=b" in {p.name for p in (tmp_path / "labels").iterdir()}
    (tmp_path / "one.txt").write_text("0 0.1 0.2 0.3 0.4 0.5 0.6\n\n1 0 0 1 0 1 1\n")
    got = rd.read_labels(spark, str(tmp_path / "one.txt")).orderBy("object_no").collect()
    assert [(r["image"], r["class_id"], len(r["polygon"])) for r in got] == [("one", 0, 3), ("one", 1, 3)]
    bad = rd.read_labels(spark, str(tmp_path / "one.txt"), min_coords=8).collect()
    assert [(r["polygon"], r["error"]) for r in bad] == [(None, "expected polygon pairs")] * 2 and all(r["error"] is None for r in got)


def test_a_late_batch_does_not_replace_newer_sections(spark):
    from datetime import datetime

    cols = "name string, section string, payload string, video_key string, sd_key string, updated_at timestamp"
    path = scratch_path(spark, "late-runs")
    one = lambda payload, video, sd, day: st.upsert_run_sections(spark, path, spark.createDataFrame([("r", "laneballs", payload, video, sd, datetime(2026, 1, day))], cols))
    one("first", "v1", "sd1", 1)
    one("new", "v3", None, 3)
    one("late", "v2", "sd2", 2)
    r = st.open_runs(spark, path).collect()
    assert [(x["payload"], x["video_key"], x["sd_key"], x["updated_at"].day) for x in r] == [("new", "v3", "sd2", 3)]


def test_stream_keeps_the_best_checkpoints_in_a_folder_per_batch(spark, tmp_path):
    src, kept = f"{tmp_path}/in", f"{tmp_path}/kept"
    for i in range(3):
        spark.createDataFrame([(10 * i + j, float((7 * (10 * i + j)) % 23)) for j in range(10)], "step long, objective double").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema("step long, objective double").option("maxFilesPerTrigger", 1).parquet(src)
    sf.stream_top_checkpoints(stream, kept, f"{tmp_path}/cp", 4).awaitTermination(120)
    want = sorted(((float((7 * s) % 23), -s) for s in range(30)), reverse=True)[:4]
    assert sorted(((r["objective"], -r["step"]) for r in sf.open_top_checkpoints(spark, kept).collect()), reverse=True) == want


def test_trial_rows_keep_all_fields(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text('{"objective": 0.5, "run_dir": "a", "params": {"lr": 0.1}, "epochs": 3}\n{oops\n\n{"run_dir": "b"}\n')
    got = {r["run_dir"]: (r["objective"], r["fields"]) for r in rd.read_trials(spark, str(tmp_path / "t.jsonl")).collect()}
    assert got == {"a": (0.5, {"params": '{"lr":0.1}', "epochs": "3"}), "b": (None, {})}


def test_shot_records_and_sensor_files(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"source": "laneballs", "shot_number": 1, "ball_positions": [{"x": 0.5163, "y": 1.6866}, {"x": 0.5249, "y": 2.0738}]}, indent=1))
    shots = rd.read_shots(spark, str(tmp_path / "s.json"), "laneballs")
    a = st.shot_answers(st.query_shots(shots, [1, 5])).collect()
    assert len(a) == 1 and a[0]["fps"] == 30.0 and len(a[0]["kinematics_table"]) == 4
    (tmp_path / "k.json").write_text('{"BufferData":[{"Timestamp":"2026-04-15T03:48:09Z"}],"AccelerometerJumpTimestamps":[]}')
    assert rd.read_sensor(spark, str(tmp_path / "k.json")).collect()[0]["sd_key"] == "k"


def test_names(spark):
    df = spark.createDataFrame([("videos/shot 1.final.mp4",), ("a/.hidden",), ("x/",), ("  ..  ",), ("Ünï-1.é",)], "k string")
    got = [tuple(r) for r in df.select(tx.default_run_name("k"), tx.slug("k")).collect()]
    assert [g[0] for g in got] == ["shot_1.final", "hidden", "x", "run", "Ünï-1"]
    assert got[3][1] == "run" and got[4][1] == "Ünï-1.é"


def test_split_is_exact_over_many_pieces(spark):
    df = spark.range(1001).selectExpr("concat('n', lpad(cast(1000 - id as string), 5, '0')) name").repartition(13)
    got = {r["name"]: r["split"] for r in ds.split_dataset(df, 0.7).collect()}
    names = sorted(got)
    assert [got[n] for n in names] == ["train"] * 700 + ["val"] * 301


def test_label_job_reports_broken_frames(spark):
    from shotlane.operators.dataset import build_label_set

    b = spark.createDataFrame([("ok",), ("empty",), ("broken",)], "stem string")
    poly = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0)]
    o = spark.createDataFrame([("ok", "5,0,0,255", 0, poly, 20, 20), ("broken", "5,0,0,255", 0, None, 20, 20)], "stem string, colour string, contour_no int, polygon array<struct<x:double,y:double>>, width int, height int")
    m = spark.createDataFrame([("ok", '{"(5, 0, 0, 255)": {"class": "Sphere"}}')], "stem string, mapping_json string")
    none = spark.createDataFrame([], "stem string, colour string, semantic_id int")
    cm = ds.parse_class_mapping(m)
    got = {r["stem"]: (r["label_text"], r["error"]) for r in build_label_set(b, o, cm, none, cm).collect()}
    assert got == {"ok": ("1 0.000000 0.000000 0.500000 0.000000 0.500000 0.500000\n", None), "empty": ("", None), "broken": (None, "missing polygon")}


def test_every_query_reads_the_tables_and_keeps_its_columns(spark):
    import os

    import __spark_entry__ as entry

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no tables here")
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 60
    for name in ("trim_diagnostics", "ema_joints", "mask_iou", "select_track", "contact_frame"):
        assert entry.queries()[name](spark, d).count() > 0
