"""The store of analysed runs and shots.

Runs live as one row per (slug, section), hash-bucketed by slug.  An upsert
rewrites only the buckets it touches.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotlane import schemas
from shotlane.config import DEFAULT, Settings
from shotlane.functions.text import slug
from shotlane.operators.kinematics import kinematics_from_points
from shotlane.session import cut

BUCKETS = 256
RUN_SECTIONS = (
    "slug string, section string, name string, payload string, video_key string, sd_key string, "
    "id string, created_at timestamp, updated_at timestamp, section_at timestamp, sd_key_at timestamp, bucket int"
)


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("slug"), F.lit(buckets)).cast("int")


def merge_run_sections(current: DataFrame, updates: DataFrame) -> DataFrame:
    """Current rows and updates to the new state, one row per (slug, section).

    updates: name, section, payload, video_key, sd_key (null keeps the old one),
    updated_at.  The newest update of a section wins, at equal times the later
    arrival, so a late batch never replaces what is newer; a run keeps its id and
    created_at, takes name, key and updated_at from its newest update.  All
    three levels are map-side aggregates, so a run updated very often is cheap.
    """
    stamp = F.when(F.col("sd_key").isNotNull(), F.col("updated_at"))
    new = updates.select(
        slug("name").alias("slug"), "section", "name", "payload", "video_key", "sd_key",
        F.lit(None).cast("string").alias("id"), F.col("updated_at").alias("created_at"), "updated_at", F.col("updated_at").alias("section_at"),
        stamp.alias("sd_key_at"), F.lit(1).alias("_new"))
    old = current.select(
        "slug", "section", "name", "payload", "video_key", "sd_key", "id", "created_at", "updated_at", "section_at",
        (F.col("sd_key_at") if "sd_key_at" in current.columns else stamp).alias("sd_key_at"), F.lit(0).alias("_new"))
    rows = old.unionByName(new)
    sections = rows.groupBy("slug", "section").agg(F.max_by(
        F.struct("payload", "section_at"), F.struct("section_at", "_new", "payload")).alias("_p")).select("slug", "section", "_p.*")
    runs = rows.groupBy("slug").agg(
        F.max_by(F.struct("name", "video_key"), F.struct("updated_at", "_new", "name", "section", "video_key")).alias("_n"),
        F.max_by(F.struct("sd_key", "sd_key_at"), F.when(F.col("sd_key").isNotNull(), F.struct("sd_key_at", "_new", "section", "sd_key"))).alias("_k"),
        F.max("id").alias("id"), F.min("created_at").alias("created_at"), F.max("updated_at").alias("updated_at"),
    ).select("slug", "_n.*", "_k.*", F.coalesce("id", F.sha2(F.concat_ws("|", "slug", F.col("created_at").cast("string")), 256)).alias("id"), "created_at", "updated_at")
    return sections.join(runs, "slug").select(
        "slug", "section", "name", "payload", "video_key", "sd_key", "id", "created_at", "updated_at", "section_at", "sd_key_at")


def open_runs(spark: SparkSession, path: str) -> DataFrame:
    """The stored rows; an absent store is empty."""
    try:
        return spark.read.schema(RUN_SECTIONS).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], RUN_SECTIONS)


def bucket_count(spark: SparkSession, path: str, asked: int | None) -> int:
    """The store's number of buckets, kept beside its rows; the first upsert sets it and another number is refused."""
    try:
        stored = spark.read.schema("buckets int").parquet(f"{path}/_meta").first()[0]
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        stored = asked or BUCKETS
        spark.range(1).select(F.lit(stored).alias("buckets")).write.parquet(f"{path}/_meta")
    if asked not in (None, stored):
        raise ValueError(f"the store has {stored} buckets, not {asked}")
    return stored


def upsert_run_sections(spark: SparkSession, path: str, updates: DataFrame, buckets: int | None = None) -> None:
    """Merge updates into the store at path.

    Only touched buckets are read and rewritten (at most ``buckets`` numbers
    reach the driver).  The merged rows go to a staging table first: the store
    is never read and overwritten by one job, and a retry finds the same rows.
    Updates carry their own updated_at, so applying a batch twice changes nothing.
    """
    buckets = bucket_count(spark, path, buckets)
    stamped = cut(updates.withColumn("bucket", F.pmod(F.xxhash64(slug("name")), F.lit(buckets)).cast("int")), "run-updates")
    touched = [r[0] for r in stamped.select("bucket").distinct().collect()]
    if not touched:
        return
    current = open_runs(spark, path).where(F.col("bucket").isin(touched))
    merged = merge_run_sections(current, stamped.drop("bucket")).withColumn("bucket", _bucket(buckets))
    staged = cut(merged, "run-merge")
    staged.select(*schemas.columns(RUN_SECTIONS)).repartition("bucket", "slug").write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


# ---- queries ---------------------------------------------------------------

def _wanted(spark: SparkSession, values: Sequence, column: str, type_: str) -> DataFrame:
    return spark.createDataFrame([(v,) for v in values], f"{column} {type_}").distinct()


def query_shots(shots: DataFrame, numbers: Sequence[int], source: str | None = None) -> DataFrame:
    """Stored shots of the asked numbers; absent ones are left out.  The list comes from the caller, so it is small; AQE picks the join."""
    rows = shots if source is None else shots.where(F.col("source") == source)
    return rows.join((_wanted(shots.sparkSession, numbers, "shot_number", "int")), "shot_number", "left_semi")


def query_runs(runs: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rows of the asked runs with the name as asked; names are compared as slugs."""
    want = _wanted(runs.sparkSession, names, "asked_name", "string").withColumn("slug", slug("asked_name"))
    return runs.join(want, "slug")


def missing_keys(wanted: DataFrame, store: DataFrame, key: str) -> DataFrame:
    return wanted.select(key).distinct().join(store.select(key), key, "left_anti")


def list_names(runs: DataFrame) -> DataFrame:
    """Run names in slug order; a run without a name shows its slug."""
    return runs.groupBy("slug").agg(F.max("name").alias("name")).select(
        "slug", F.coalesce(F.nullif("name", F.lit("")), "slug").alias("name")).orderBy("slug")


def pivot_sections(runs: DataFrame, keys: Sequence[str] = ("slug",)) -> DataFrame:
    pick = lambda s: F.max(F.when(F.col("section") == s, F.col("payload")))
    return runs.groupBy(*keys).agg(pick("aggregated").alias("aggregated"), pick("laneballs").alias("laneballs"), pick("fourdbody").alias("fourdbody"))


_POINTS = "array<struct<x:double,y:double>>"
_TABLE = "array<struct<quarter:int,start_m:double,end_m:double,mean_speed_mps:double,mean_acceleration_mps2:double,sample_count:int>>"
_BODY = "array<array<struct<joint_id:int,x:double,y:double,z:double>>>"
AGGREGATE_PAYLOAD = f"struct<ball_points:{_POINTS},kinematics_table:{_TABLE},skeleton_points:{_BODY}>"
LANE_PAYLOAD = f"struct<fps:double,ball_points:{_POINTS},kinematics_table:{_TABLE},is_trapezoid:boolean,homography_frame:int>"
BODY_PAYLOAD = f"struct<fps:double,skeleton_points:{_BODY}>"


def _parsed(col, schema: str):
    return F.when(~F.trim(col).isin("", "{}", "null"), F.from_json(col, schema))


def merge_sections(runs: DataFrame, keys: Sequence[str] = ("slug",)) -> DataFrame:
    """Aggregated section where there is one, else put together from lane and body; runs with neither drop out."""
    p = pivot_sections(runs, keys)
    p = (
        p.withColumn("_a", _parsed(F.col("aggregated"), AGGREGATE_PAYLOAD)).withColumn("_l", _parsed(F.col("laneballs"), LANE_PAYLOAD))
        .withColumn("_b", _parsed(F.col("fourdbody"), BODY_PAYLOAD)).where("_a is not null or _l is not null or _b is not null"))
    empty = lambda c, t: F.coalesce(c, F.array().cast(t))
    whole = F.col("_a").isNotNull()
    return p.select(
        *keys, F.when(whole, "aggregated").otherwise("merged").alias("origin"),
        empty(F.when(whole, F.col("_a.ball_points")).otherwise(F.col("_l.ball_points")), _POINTS).alias("ball_points"),
        empty(F.when(whole, F.col("_a.kinematics_table")).otherwise(F.col("_l.kinematics_table")), _TABLE).alias("kinematics_table"),
        empty(F.when(whole, F.col("_a.skeleton_points")).otherwise(F.col("_b.skeleton_points")), _BODY).alias("skeleton_points"))


def shot_answers(shots: DataFrame, conf: Settings = DEFAULT) -> DataFrame:
    """Stored shots with kinematics worked out anew from their points."""
    keys = ["source", "shot_number"]
    rows = shots.withColumn("fps", F.coalesce("fps", F.lit(conf.default_fps)))
    kin = kinematics_from_points(rows, keys=keys, conf=conf).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(
        "quarter", "start_m", "end_m", "mean_speed_mps", "mean_acceleration_mps2", F.col("sample_count").cast("int").alias("sample_count")))).alias("kinematics_table"))
    return rows.join(kin, keys).select(
        F.lit("shot").alias("kind"), F.col("shot_number").cast("string").alias("key"), "fps",
        F.coalesce("ball_positions", F.array().cast(_POINTS)).alias("ball_points"), "kinematics_table",
        F.coalesce("skeleton_frames", F.array().cast(_BODY)).alias("skeleton_points"))


def union_answers(shots: DataFrame, runs: DataFrame) -> DataFrame:
    """Answers from both stores in one frame, told apart by kind."""
    return shots.unionByName(runs, allowMissingColumns=True)


def section_updates(runs: DataFrame, positions: DataFrame, kinematics: DataFrame, poses: DataFrame, homographies: DataFrame | None = None, health: DataFrame | None = None) -> DataFrame:
    """Analysed shots as updates of their run's three sections, one row each, as ``merge_run_sections`` takes them.

    runs: shot_id, name, video_key, sd_key, fps, updated_at, one row per shot.  positions: shot_id, frame_index, x_m, y_m;
    kinematics: one row per quarter; poses: shot_id, frame_index, joint_id, x, y, z (by person_id, if there is one); homographies and health: one row per
    shot.  What a shot lacks is an empty list.  A shot's rows are bounded by its frames; the texts are made after one join per part.
    """
    gathered = lambda df, *cols: df.groupBy("shot_id").agg(F.sort_array(F.collect_list(F.struct(*cols))).alias("_v"))
    points = gathered(positions, "frame_index", "x_m", "y_m").select(
        "shot_id", F.transform("_v", lambda p: F.struct(p["x_m"].cast("double").alias("x"), p["y_m"].cast("double").alias("y"))).alias("ball_points"))
    quarters = gathered(kinematics, "quarter", "start_m", "end_m", "mean_speed_mps", "mean_acceleration_mps2", F.col("sample_count").cast("int").alias("sample_count"))
    person = [F.col("person_id")] if "person_id" in poses.columns else []
    frames = poses.groupBy("shot_id", "frame_index").agg(F.sort_array(F.collect_list(F.struct(*person, "joint_id", "x", "y", "z"))).alias("_j"))
    frames = frames.withColumn("_j", F.transform("_j", lambda j: F.struct(*[j[c].alias(c) for c in ("joint_id", "x", "y", "z")])))
    bodies = gathered(frames, "frame_index", "_j").select("shot_id", F.col("_v._j").alias("skeleton_points"))
    rows = runs.join(points, "shot_id", "left").join(quarters.withColumnRenamed("_v", "kinematics_table"), "shot_id", "left").join(bodies, "shot_id", "left")
    lane = []
    if homographies is not None:
        rows = rows.join(homographies.select("shot_id", "is_trapezoid", "homography_frame"), "shot_id", "left")
        lane = [F.coalesce("is_trapezoid", F.lit(False)).alias("is_trapezoid"), "homography_frame"]
    if health is not None:
        rows = rows.join(health.select("shot_id", F.struct(*[c for c in health.columns if c != "shot_id"]).alias("health")), "shot_id", "left")
        lane.append("health")
    full = lambda c, t: F.coalesce(F.col(c).cast(t), F.array().cast(t)).alias(c)
    ball, table, body = full("ball_points", _POINTS), full("kinematics_table", _TABLE), full("skeleton_points", _BODY)
    texts = {"aggregated": F.struct(ball, table, body), "laneballs": F.struct("fps", ball, table, *lane), "fourdbody": F.struct("fps", body)}
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("section"), F.to_json(v).alias("payload")) for k, v in texts.items()])).alias("_s")
    return rows.select("name", "video_key", "sd_key", "updated_at", each).select("name", "_s.*", "video_key", "sd_key", "updated_at")


def run_section_answers(runs: DataFrame, section: str, schema: str) -> DataFrame:
    """One parsed section of each asked run; runs without it, or with an unreadable one, are left out."""
    rows = runs.where(F.col("section") == section).withColumn("_p", _parsed(F.col("payload"), schema)).where("_p is not null")
    return rows.select(F.lit("run").alias("kind"), F.col("asked_name").alias("key"), "_p.*")
