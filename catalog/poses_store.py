"""Poses, run store, text, sensor and frame queries."""

from pyspark.sql import functions as F

from catalog.core import query
from catalog.motion import _KIN
from shotlane.config import DEFAULT
from shotlane.functions import text as tx
from shotlane.operators import frames as fr
from shotlane.operators import poses as ps
from shotlane.operators import sequences as sq
from shotlane.operators import store as st
from shotlane.operators.kinematics import kinematics_per_quarter
from shotlane.plans import jobs
from shotlane.session import scratch_path

# ---- poses -----------------------------------------------------------------

JOINT = "shot_id frame_index person_id joint_id || x y z"
_EMA = """walk AS (SELECT shot_id, joint_id, person_id, frame_index, x, y, z FROM JT WHERE frame_index = (SELECT min(frame_index) FROM JT m WHERE m.shot_id = JT.shot_id AND m.joint_id = JT.joint_id)
      UNION ALL SELECT j.shot_id, j.joint_id, j.person_id, j.frame_index, 0.4e0 * j.x + (1e0 - 0.4e0) * w.x, 0.4e0 * j.y + (1e0 - 0.4e0) * w.y, 0.4e0 * j.z + (1e0 - 0.4e0) * w.z
      FROM walk w JOIN JT j ON j.shot_id = w.shot_id AND j.joint_id = w.joint_id AND j.frame_index = w.frame_index + 1);;
    """


@query("explode_skeleton", JOINT, "joints", "SELECT * FROM joints")
def _(t):
    e = t.table("embeddings").select(
        F.expr("cast(vec_id div 100 as int)").alias("shot_id"), (F.col("vec_id") % 100).cast("int").alias("frame_index"), F.lit(0).alias("person_id"),
        F.transform(F.sequence(F.lit(0), F.lit(20)), lambda j: F.slice("embedding", j * 3 + 1, 3)).alias("keypoints"))
    return ps.explode_skeleton(e)


@query("ema_joints", JOINT, "joints", _EMA.replace("JT", "joints") + "SELECT * FROM walk")
def _(t):
    return ps.ema(t.joints())


@query("ema_joints_repeats", JOINT, "joints", _EMA.replace("JT", "joints") + "SELECT * FROM walk")
def _(t):
    """Every joint arrives twice; the second arrival, with the smaller values, counts."""
    j = t.joints().withColumn("arrival", F.lit(2))
    first = j.withColumns({c: F.col(c) + 1.0 for c in "xyz"}).withColumn("arrival", F.lit(1))
    return ps.ema(j.unionByName(first), order=("arrival",))


@query("analyse_poses", JOINT, "joints", "cutj AS (SELECT * FROM joints WHERE frame_index < 30 + shot_id % 3 * 10 + 30);; " + _EMA.replace("JT", "cutj") + "SELECT * FROM walk")
def _(t):
    j = t.joints()
    shots = j.select("shot_id").distinct().select(
        "shot_id", F.lit("sd").alias("sd_key"), F.lit(30.0).alias("fps"), (F.lit(30) + F.col("shot_id") % 3 * 10).cast("int").alias("contact_frame"))
    return jobs.analyse_poses(j, shots)


@query("join_joint_dim", "shot_id frame_index joint_id swap_id | joint_name body_part | x", "joints", """
    d AS (SELECT unnest([0,1,2,3,4,5,6,7,8,9,10,11,12,13,14,15,16,17,18,19,20]) AS joint_id,
      unnest(['nose','left_eye','right_eye','left_ear','right_ear','left_shoulder','right_shoulder','left_elbow','right_elbow','left_hip','right_hip','left_knee','right_knee','left_ankle','right_ankle','left_big_toe','left_small_toe','left_heel','right_big_toe','right_small_toe','right_heel']) AS joint_name,
      unnest([0,2,1,4,3,6,5,8,7,10,9,12,11,14,13,18,19,20,15,16,17]) AS swap_id);;
    SELECT shot_id, frame_index, joint_id, swap_id, joint_name, CASE WHEN joint_id < 9 THEN 'upper' ELSE 'lower' END AS body_part, x FROM joints JOIN d USING (joint_id)""")
def _(t):
    return ps.join_joint_dim(t.joints())


@query("body_links", "shot_id frame_index link_id || x0 y0 z0 x1 y1 z1", "joints", """
    l AS (SELECT unnest([0,1,2,3,4,5,6,7,8,9,12,13,14,15,16,17,18,19,20,21,22,23,24]) AS link_id, unnest([13,11,14,12,9,5,6,5,6,7,1,0,0,1,2,3,4,13,13,13,14,14,14]) AS a0, unnest([11,9,12,10,10,9,10,6,7,8,2,1,2,3,4,5,6,15,16,17,18,19,20]) AS b0);;
    k AS (SELECT link_id, CASE link_id WHEN 8 THEN 5 WHEN 9 THEN 6 ELSE a0 END AS a, CASE link_id WHEN 8 THEN 7 WHEN 9 THEN 8 ELSE b0 END AS b FROM l);;
    SELECT p.shot_id, p.frame_index, link_id, p.x AS x0, p.y AS y0, p.z AS z0, q.x AS x1, q.y AS y1, q.z AS z1 FROM k JOIN joints p ON p.joint_id = a JOIN joints q ON q.joint_id = b AND q.shot_id = p.shot_id AND q.frame_index = p.frame_index""")
def _(t):
    return ps.body_links(t.joints())


@query("last_person_wins", "shot_id frame_index joint_id person_id || x", "", """
    SELECT vec_id // 100 AS shot_id, vec_id % 100 AS frame_index, j AS joint_id, 2 AS person_id, CAST(embedding[3 * j + 1] AS DOUBLE) * 2 AS x FROM (SELECT *, unnest(generate_series(0, 20)) AS j FROM embeddings)""")
def _(t):
    j = t.joints()
    return ps.last_person_wins(j.unionByName(j.withColumn("person_id", F.lit(2)).withColumn("x", F.col("x") * 2)))


# ---- text and sensor -------------------------------------------------------

@query("norm_class", "doc_id | name plain", "", r"""
    SELECT doc_id, CASE WHEN n = 'sphere' THEN 'ball' ELSE n END AS name, lower(regexp_replace(raw, '^\s+|\s+$', '', 'g')) AS plain FROM (
      SELECT *, lower(regexp_replace(split_part(raw, ',', 1), '^\s+|\s+$', '', 'g')) AS n FROM (
        SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN ' Sphere , ' ELSE '  ' END || text AS raw FROM documents))""")
def _(t):
    d = t.table("documents").select("doc_id", F.concat(F.when(F.col("doc_id") % 5 == 0, " Sphere , ").otherwise("  "), F.col("text")).alias("raw"))
    return d.select("doc_id", tx.norm_class("raw").alias("name"), tx.norm_class("raw", first_token=False).alias("plain"))


@query("class_of_id", "event_id | name", "", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'ball' WHEN 1 THEN 'lane' WHEN 2 THEN 'pins' END AS name FROM events")
def _(t):
    return t.table("events").select("event_id", tx.class_of_id(F.col("event_id") % 5).alias("name"))


@query("slug", "doc_id | slug", "", r"""
    SELECT doc_id, CASE WHEN s = '' THEN 'run' ELSE s END AS slug FROM (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '[^\p{L}\p{N}\-_.]', '_', 'g'), '^[._]+|[._]+$', '', 'g') AS s FROM documents)""")
def _(t):
    return t.table("documents").select("doc_id", tx.slug("text").alias("slug"))


@query("default_run_name", "page_id | run_name", "", r"""
    n AS (SELECT page_id, url, regexp_extract(regexp_replace(url, '(/+\.?)+$', ''), '([^/]*)$', 1) AS f FROM pages);;
    s AS (SELECT page_id, CASE WHEN regexp_replace(f, '^(.+)\.[^.]+$', '\1') = '' THEN url ELSE regexp_replace(f, '^(.+)\.[^.]+$', '\1') END AS k FROM n);;
    SELECT page_id, CASE WHEN r = '' THEN 'run' ELSE r END AS run_name FROM (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(k, '^\s+|\s+$', '', 'g'), '[^\p{L}\p{N}\-_.]', '_', 'g'), '^[._]+|[._]+$', '', 'g') AS r FROM s)""")
def _(t):
    return t.table("pages").select("page_id", tx.default_run_name("url").alias("run_name"))


def _ticks():
    iso = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss")
    frac = F.date_format(F.col("ts").cast("timestamp"), "SSSSSS")
    k = F.col("event_id") % 5
    return (
        F.when(k == 0, F.concat(iso, F.lit("."), frac, F.lit("7-04:00"))).when(k == 1, F.concat(iso, F.lit("Z")))
        .when(k == 2, F.concat(iso, F.lit("."), F.substring(frac, 1, 3))).when(k == 3, F.concat(F.lit("at "), iso)).otherwise(F.concat(F.lit(" "), iso, F.lit("."), frac, F.lit("9+05:30 "))))


@query("parse_ticks", "event_id us", "", """
    SELECT event_id, CASE event_id % 5 WHEN 0 THEN epoch_us(ts) + 14400000000 WHEN 1 THEN epoch_us(ts) // 1000000 * 1000000 WHEN 2 THEN epoch_us(ts) // 1000 * 1000 WHEN 3 THEN NULL ELSE epoch_us(ts) - 19800000000 END AS us FROM events""")
def _(t):
    return t.table("events").select("event_id", F.unix_micros(tx.parse_ticks(_ticks())).alias("us"))


def _sensor(t):
    """Sensor documents written from the events: start, jump after cents * 100 microseconds, and the usual defects."""
    e = t.table("events")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    fmt = lambda c: F.concat(F.date_format(F.timestamp_micros(c), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("3Z"))
    cents = F.round(F.col("value") * 100).cast("long")
    k = F.col("event_id") % 10
    jump = us + F.when(k == 1, -1000).otherwise(cents * 100)
    start = F.when(k == 2, "yesterday").otherwise(fmt(us))
    jumps = F.when(k == 0, "[]").otherwise(F.concat(F.lit('["'), fmt(jump), F.lit('"]')))
    doc = F.concat(F.lit('{"BufferData": [{"Timestamp": "'), start, F.lit('", "n": 1}], "AccelerometerJumpTimestamps": '), jumps, F.lit("}"))
    return e.select("event_id", F.when(k == 3, F.lit("{broken")).otherwise(doc).alias("sensor_json"), F.lit(29.97).alias("fps"), F.when(k != 4, F.concat(F.lit("sd"), F.col("event_id"))).otherwise("key").alias("sd_key"))


_CONTACT = "c AS (SELECT event_id, event_id % 10 AS k, CASE WHEN event_id % 10 > 3 THEN CAST(round(value * 100) AS BIGINT) * 100 / 1e6 END AS dt_seconds FROM events);; "


@query("contact_frame", "event_id contact_frame || dt_seconds", "", _CONTACT + "SELECT event_id, floor(dt_seconds * 29.97e0) AS contact_frame, dt_seconds FROM c")
def _(t):
    return fr.contact_frame(fr.read_sensor(_sensor(t)))


@query("frame_ranges", "event_id start_default stop_default start_forced stop_forced stop_body_forced", "", _CONTACT + """
    SELECT event_id, CASE WHEN k > 4 THEN floor(dt_seconds * 29.97e0) ELSE 40 END AS start_default, CASE WHEN k > 4 THEN floor(dt_seconds * 29.97e0) + 29 END AS stop_default,
      40 AS start_forced, NULL AS stop_forced, CASE WHEN k > 4 THEN floor(dt_seconds * 29.97e0) + 29 END AS stop_body_forced FROM c""")
def _(t):
    from dataclasses import replace

    s = fr.contact_frame(fr.read_sensor(_sensor(t)))
    forced = replace(DEFAULT, force_start_frame=True)
    a = fr.frame_ranges(s).withColumnsRenamed({"lane_start_frame": "start_default", "body_stop_frame": "stop_default"})
    b = fr.frame_ranges(a, forced).withColumnsRenamed({"lane_start_frame": "start_forced", "body_stop_frame": "stop_forced"})
    return fr.frame_ranges(b, forced, job="body").withColumnRenamed("body_stop_frame", "stop_body_forced")


# ---- frames ----------------------------------------------------------------

_FRAMES = "f AS (SELECT *, row_number() OVER (PARTITION BY shot_id ORDER BY frame_index) - 1 AS i FROM one);; "


def _frames(t):
    from pyspark.sql import Window

    w = Window.partitionBy("shot_id").orderBy("frame_index")
    return t.one().select("shot_id", (F.row_number().over(w) - 1).alias("frame_index"), F.lit(30.0).alias("fps"))


@query("subsample_frames", "shot_id frame_index source_frame || fps", "one", _FRAMES + """
    s AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY shot_id) > 20 THEN greatest(1, count(*) OVER (PARTITION BY shot_id) // 20) ELSE 1 END AS st FROM f);;
    SELECT shot_id, i // st AS frame_index, i AS source_frame, 30e0 / st AS fps FROM s WHERE i % st = 0 AND i // st < 20""")
def _(t):
    return fr.subsample_frames(_frames(t), max_frames=20)


@query("scale_to_max", "det_id width height || scale", "det", """
    d AS (SELECT det_id, (x1 + 1) * 8 AS w, (y1 + 1) * 8 AS h FROM det);; s AS (SELECT *, CASE WHEN greatest(w, h) > 1024 THEN 1024e0 / greatest(w, h) ELSE 1e0 END AS scale FROM d);;
    SELECT det_id, CASE WHEN scale < 1 THEN floor(w * scale) ELSE w END AS width, CASE WHEN scale < 1 THEN floor(h * scale) ELSE h END AS height, scale FROM s""")
def _(t):
    return fr.scale_to_max(t.det().withColumn("width", (F.col("x1") + 1) * 8).withColumn("height", (F.col("y1") + 1) * 8))


@query("assign_batches", "shot_id frame_index batch_no dropping", "one", _FRAMES + """
    SELECT shot_id, i AS frame_index, i // 16 AS batch_no, 0 AS dropping FROM f
    UNION ALL SELECT shot_id, i, i // 16, 1 FROM (SELECT *, count(*) OVER (PARTITION BY shot_id) AS n FROM f) WHERE i // 16 < n // 16""")
def _(t):
    f = _frames(t)
    return fr.assign_batches(f, 16, drop_last=False).withColumn("dropping", F.lit(0)).unionByName(fr.assign_batches(f, 16).withColumn("dropping", F.lit(1)))


@query("filter_detections", "det_id | class_name | confidence", "det", "SELECT det_id, class_name, confidence FROM det WHERE class_name IN ('ball', 'lane') AND confidence >= 0.1e0")
def _(t):
    return fr.filter_detections(t.det(), ["ball", "lane"])


@query("score_frames", "shot_id frame_index det_id | class_name | confidence x0 y0 x1 y1", "det", "SELECT shot_id, frame_index, det_id, class_name, least(confidence * 2, 1) AS confidence, x0, y0, x1, y1 FROM det")
def _(t):
    def model(pdf):
        return pdf.assign(confidence=(pdf["confidence"] * 2).clip(upper=1.0), shot_id=pdf["shot_id"].astype(str))

    d = t.det().select("shot_id", "frame_index", "det_id", "class_name", "confidence", *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")])
    return fr.score_frames(d, model)


# ---- store -----------------------------------------------------------------

_MERGED = """sec AS (SELECT slug, section, arg_max(payload, {'u': updated_at, 'p': payload}) AS payload FROM @UP@ GROUP BY ALL);;
    rn AS (SELECT slug, arg_max(name, {'u': updated_at, 'n': name, 's': section, 'v': video_key}) AS name, arg_max(video_key, {'u': updated_at, 'n': name, 's': section, 'v': video_key}) AS video_key,
      arg_max(sd_key, {'u': updated_at, 's': section, 'k': sd_key}) FILTER (WHERE sd_key IS NOT NULL) AS sd_key, min(updated_at) AS created_at, max(updated_at) AS updated_at FROM @UP@ GROUP BY 1);;
    SELECT sec.slug, section, payload, name, video_key, sd_key, strftime(created_at, '%Y-%m-%d') AS created_on, strftime(updated_at, '%Y-%m-%d') AS updated_on FROM sec JOIN rn USING (slug)"""
_RUN = "| slug section payload name video_key sd_key created_on updated_on"


def _days(df):
    return df.withColumn("created_on", F.date_format("created_at", "yyyy-MM-dd")).withColumn("updated_on", F.date_format("updated_at", "yyyy-MM-dd"))


@query("merge_run_sections", _RUN, "updates", _MERGED.replace("@UP@", "updates"))
def _(t):
    empty = t.spark.createDataFrame([], st.RUN_SECTIONS)
    return _days(st.merge_run_sections(empty, t.updates()))


@query("upsert_run_sections", _RUN, "updates", "late AS (SELECT * FROM updates WHERE o_totalprice > 250000);; early AS (SELECT * FROM updates WHERE o_totalprice <= 250000);; "
       "allu AS (SELECT *, 0 AS b FROM early UNION ALL SELECT *, 1 AS b FROM late);; " + _MERGED.replace("@UP@", "allu").replace("{'u': updated_at,", "{'u': updated_at, 'b': b,"))
def _(t):
    path = scratch_path(t.spark, "run-store")
    u = t.updates()
    st.upsert_run_sections(t.spark, path, u.where("o_totalprice <= 250000"), buckets=8)
    st.upsert_run_sections(t.spark, path, u.where("o_totalprice > 250000"), buckets=8)
    return _days(st.open_runs(t.spark, path))


def _merged(t):
    return st.merge_run_sections(t.spark.createDataFrame([], st.RUN_SECTIONS), t.updates())


@query("query_runs", "| asked_name slug section", "updates", "SELECT DISTINCT 'run ' || substr(slug, 5) AS asked_name, slug, section FROM updates WHERE slug IN ('run_1', 'run_7', 'run_13', 'run_22', 'run_100')")
def _(t):
    return st.query_runs(_merged(t), ["run 1", "run 7", "run 13", "run 22", "run 100", "no such run"])


@query("query_shots", "shot_number | source", "", "SELECT DISTINCT user_id AS shot_number, 'laneballs' AS source FROM events WHERE user_id IN (1, 2, 5)")
def _(t):
    s = t.table("events").select(F.col("user_id").cast("int").alias("shot_number"), F.lit("laneballs").alias("source")).distinct()
    return st.query_shots(s, [1, 2, 5, 99999999], "laneballs")


@query("missing_keys", "c_custkey", "", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)")
def _(t):
    return st.missing_keys(t.table("customer"), t.table("orders").where("o_totalprice > 450000").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey")


@query("list_names", "| slug name", "updates", "SELECT slug, max(name) AS name FROM updates GROUP BY 1")
def _(t):
    return jobs.list_names(_merged(t))


@query("merge_sections", "points quarters joints | slug origin", "updates", """
    l AS (SELECT slug, section, arg_max(payload, {'u': updated_at, 'p': payload}) AS p FROM updates GROUP BY ALL);;
    w AS (SELECT slug, max(CASE WHEN section = 'aggregated' THEN CAST(p AS BIGINT) END) AS a, max(CASE WHEN section = 'laneballs' THEN CAST(p AS BIGINT) END) AS l, max(CASE WHEN section = 'fourdbody' THEN CAST(p AS BIGINT) END) AS b FROM l GROUP BY 1);;
    SELECT slug, CASE WHEN a IS NOT NULL THEN 'aggregated' ELSE 'merged' END AS origin, coalesce(CASE WHEN a IS NOT NULL THEN a % 7 ELSE l % 5 END, 0) AS points,
      CASE WHEN a IS NULL AND l IS NOT NULL THEN 1 ELSE 0 END AS quarters, CASE WHEN a IS NULL AND b IS NOT NULL THEN 1 ELSE 0 END AS joints FROM w WHERE coalesce(a, l, b) IS NOT NULL""")
def _(t):
    m = _merged(t)
    k = F.col("payload").cast("long")
    pts = lambda n: F.concat(F.lit("["), F.array_join(F.slice(F.array(*[F.lit('{"x":0.5,"y":1}')] * 7), 1, n.cast("int")), ","), F.lit("]"))
    body = (
        F.when(F.col("section") == "aggregated", F.concat(F.lit('{"ball_points":'), pts(k % 7), F.lit("}")))
        .when(F.col("section") == "laneballs", F.concat(F.lit('{"fps":30,"ball_points":'), pts(k % 5), F.lit(',"kinematics_table":[{"quarter":1}]}')))
        .when(F.col("section") == "fourdbody", F.lit('{"fps":30,"skeleton_points":[[{"joint_id":3,"x":1,"y":2,"z":3}]]}')).otherwise(F.col("payload")))
    out = st.merge_sections(m.withColumn("payload", body))
    return out.select("slug", "origin", F.size("ball_points").alias("points"), F.size("kinematics_table").alias("quarters"), F.size("skeleton_points").alias("joints"))


def _shots(t, source):
    pts = t.traj().groupBy("shot_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("frame_index", "x_m", "y_m"))), lambda p: F.struct(
        p["x_m"].alias("x"), p["y_m"].alias("y"))).alias("ball_positions"))
    return pts.select(
        F.lit(source).alias("source"), F.col("shot_id").cast("int").alias("shot_number"), F.when(F.col("shot_id") % 2 == 0, 25.0).alias("fps"), "ball_positions",
        F.array(F.array(F.struct(F.lit(1).alias("joint_id"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z")))).alias("skeleton_frames"))


def _payload_runs(t):
    body = F.when(F.col("section") == "laneballs", F.concat(F.lit('{"fps":24,"ball_points":[{"x":'), F.col("payload"), F.lit(',"y":2}],"kinematics_table":[]}'))).when(
        F.col("section") == "aggregated", '{"ball_points":[{"x":1,"y":2},{"x":1,"y":3}],"kinematics_table":[],"skeleton_points":[]}').otherwise('{"fps":24,"skeleton_points":[[],[]]}')
    return _merged(t).withColumn("payload", body)


_ASKED = ["run 1", "run 7", "run 13", "run 22", "run 100", "gone"]
_IN = "slug IN ('run_1', 'run_7', 'run_13', 'run_22', 'run_100')"
_CNT = "c AS (SELECT shot_id, count(*) AS n FROM traj WHERE shot_id IN (1, 2, 4) GROUP BY 1);; "


@query("query_lane_ball", "points quarters | kind key | fps", "traj updates", _CNT + f"""
    SELECT 'shot' AS kind, CAST(shot_id AS VARCHAR) AS key, n AS points, 4 AS quarters, CASE WHEN shot_id % 2 = 0 THEN 25 ELSE 30 END AS fps FROM c
    UNION ALL SELECT DISTINCT 'run', name, 1, 0, 24 FROM updates WHERE section = 'laneballs' AND {_IN}""")
def _(t):
    out = jobs.query_lane_ball(_shots(t, "laneballs"), _payload_runs(t), [1, 2, 4, 99999999], _ASKED)
    return out.select("kind", "key", "fps", F.size("ball_points").alias("points"), F.size("kinematics_table").alias("quarters"))


@query("query_poses", "frames | kind key | fps", "traj updates", _CNT + f"""
    SELECT 'shot' AS kind, CAST(shot_id AS VARCHAR) AS key, 1 AS frames, CASE WHEN shot_id % 2 = 0 THEN 25 ELSE 30 END AS fps FROM c
    UNION ALL SELECT DISTINCT 'run', name, 2, 24 FROM updates WHERE section = 'fourdbody' AND {_IN}""")
def _(t):
    out = jobs.query_poses(_shots(t, "fourdbody"), _payload_runs(t), [1, 2, 4], _ASKED)
    return out.select("kind", "key", "fps", F.size("skeleton_points").alias("frames"))


@query("query_aggregate", "points frames | kind key", "traj updates", _CNT + f"""
    w AS (SELECT name, max(CASE WHEN section = 'aggregated' THEN 1 END) AS a, max(CASE WHEN section = 'laneballs' THEN 1 END) AS l, max(CASE WHEN section = 'fourdbody' THEN 1 END) AS b FROM updates WHERE {_IN} GROUP BY 1);;
    SELECT 'shot' AS kind, CAST(shot_id AS VARCHAR) AS key, n AS points, 1 AS frames FROM c
    UNION ALL SELECT 'run', name, CASE WHEN a = 1 THEN 2 ELSE coalesce(l, 0) END, CASE WHEN a = 1 THEN 0 ELSE 2 * coalesce(b, 0) END FROM w WHERE coalesce(a, l, b) = 1""")
def _(t):
    out = jobs.query_aggregate(_shots(t, "aggregated"), _payload_runs(t), [1, 2, 4], _ASKED)
    return out.select("kind", "key", F.size("ball_points").alias("points"), F.size("skeleton_points").alias("frames"))


@query("union_answers", "kind_no points | kind key", "updates", """
    SELECT 'shot' AS kind, CAST(c_custkey AS VARCHAR) AS key, 0 AS kind_no, CAST(NULL AS BIGINT) AS points FROM customer UNION ALL SELECT DISTINCT 'run', name, 1, 3 FROM updates""")
def _(t):
    a = t.table("customer").select(F.lit("shot").alias("kind"), F.col("c_custkey").cast("string").alias("key"), F.lit(0).alias("kind_no"))
    b = t.updates().select(F.lit("run").alias("kind"), F.col("name").alias("key"), F.lit(1).alias("kind_no"), F.lit(3).alias("points")).distinct()
    return st.union_answers(a, b)


@query("first_person_frame", "shot_id frame_index event_id", "one", "SELECT user_id AS shot_id, (epoch_us(ts) - 1704067200000000) // 3600000000 AS frame_index, max(event_id) AS event_id FROM events GROUP BY ALL")
def _(t):
    from catalog.views import BASE_US

    e = t.table("events").select(
        F.col("user_id").alias("shot_id"), "event_id", F.expr(f"cast((unix_micros(cast(ts as timestamp)) - {BASE_US}) div 3600000000 as int)").alias("frame_index"))
    return sq.first_per_frame(e, order=("event_id",), last=True)


# ---- from a job to the store -------------------------------------------------

def _stored(t):
    """Sections of every shot with points or joints, stored and read back; even shots have no whole section, so theirs is put together."""
    traj, joints = t.traj(), t.joints()
    runs = traj.select("shot_id").union(joints.select("shot_id")).distinct().select(
        "shot_id", F.concat(F.lit("Run "), F.col("shot_id")).alias("name"), F.lit("v").alias("video_key"), F.lit("sd").alias("sd_key"), F.lit(30.0).alias("fps"),
        F.lit("2024-01-01 00:00:00").cast("timestamp").alias("updated_at"))
    updates = st.section_updates(runs, traj, kinematics_per_quarter(traj), joints)
    updates = updates.where((F.col("section") != "aggregated") | (F.regexp_extract("name", r"(\d+)", 1).cast("int") % 2 == 1))
    rows = st.merge_run_sections(t.spark.createDataFrame([], st.RUN_SECTIONS), updates)
    return st.merge_sections(rows).withColumn("shot_id", F.regexp_extract("slug", r"(\d+)", 1).cast("int")).withColumn("whole", (F.col("origin") == "aggregated").cast("int"))


@query("stored_points", "shot_id whole pos || x y", "traj", "SELECT shot_id, shot_id % 2 AS whole, row_number() OVER (PARTITION BY shot_id ORDER BY frame_index) - 1 AS pos, x_m AS x, y_m AS y FROM traj")
def _(t):
    return _stored(t).select("shot_id", "whole", F.posexplode("ball_points").alias("pos", "p")).select("shot_id", "whole", "pos", "p.*")


@query("stored_kinematics", "shot_id quarter sample_count || start_m end_m mean_speed_mps mean_acceleration_mps2", "traj", _KIN("traj"))
def _(t):
    return _stored(t).select("shot_id", F.inline("kinematics_table"))


@query("stored_bodies", "shot_id pos joint_id || x y z", "joints", "SELECT *, dense_rank() OVER (PARTITION BY shot_id ORDER BY frame_index) - 1 AS pos FROM joints")
def _(t):
    return _stored(t).select("shot_id", F.posexplode("skeleton_points").alias("pos", "j")).select("shot_id", "pos", F.inline("j"))
