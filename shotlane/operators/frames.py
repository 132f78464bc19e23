"""Frame selection, batching, sensor contact and detection filters."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shotlane import schemas
from shotlane.config import DEFAULT, Settings
from shotlane.functions import geometry as G
from shotlane.functions.text import parse_ticks


def contact_frame(sensor: DataFrame, fps: Column | str = "fps") -> DataFrame:
    """Adds dt_seconds and contact_frame from the recording start and the first jump; both null when unusable.

    Needs sensor (struct, see schemas.SENSOR) and a frame rate.
    """
    fps = F.col(fps) if isinstance(fps, str) else fps
    start = parse_ticks(F.get(F.col("sensor.BufferData"), F.lit(0))["Timestamp"])
    jump = parse_ticks(F.get(F.col("sensor.AccelerometerJumpTimestamps"), F.lit(0)))
    dt = (F.unix_micros(jump) - F.unix_micros(start)) / F.lit(1e6)
    out = sensor.withColumn("_dt", dt).withColumn("dt_seconds", F.when(F.col("_dt") >= 0, F.col("_dt"))).drop("_dt")
    return out.withColumn("contact_frame", F.floor(F.col("dt_seconds") * fps).cast("int"))


def read_sensor(df: DataFrame, json_col: str = "sensor_json") -> DataFrame:
    """Parse sensor documents; malformed text gives a null struct."""
    return df.withColumn("sensor", F.from_json(json_col, schemas.SENSOR))


def frame_ranges(shots: DataFrame, conf: Settings = DEFAULT, job: str = "aggregate") -> DataFrame:
    """First lane frame and one-past-last body frame per shot.

    shots: sd_key, fps, contact_frame (null when the sensor gave none).  The
    key "key" means no sensor; a forced start ignores it too, except for the
    body-only job.  A null stop means all frames.
    """
    has = F.coalesce(F.col("sd_key"), F.lit("key")) != "key"
    use = has if job == "body" else (has & F.lit(not conf.force_start_frame))
    hit = use & F.col("contact_frame").isNotNull()
    return shots.withColumn(
        "lane_start_frame", F.when(hit, F.col("contact_frame")).otherwise(F.lit(conf.default_start_frame))
    ).withColumn("body_stop_frame", F.when(hit, F.col("contact_frame") + F.floor("fps").cast("int")))


def cut_body_frames(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """Keep rows before the body stop frame of their shot (all when there is none)."""
    r = ranges.select("shot_id", "body_stop_frame")
    return rows.join(r, "shot_id").where(
        F.col("body_stop_frame").isNull() | (F.col("frame_index") < F.col("body_stop_frame"))).drop("body_stop_frame")


def subsample_frames(frames: DataFrame, max_frames: int, videos: DataFrame | None = None) -> DataFrame:
    """Keep every step-th frame so that at most max_frames remain, renumbered; fps falls by the same step.

    Frames are numbered 0,1,2... in the video, so the new number is a division
    and no shot is ever sorted or ranked.  ``videos`` (shot_id, total_frames,
    fps) gives the length; without it, it is counted.
    """
    if videos is None:
        videos = frames.groupBy("shot_id").agg(F.count(F.lit(1)).alias("total_frames"))
    step = F.when(F.col("total_frames") > max_frames, F.greatest(F.lit(1), F.floor(F.col("total_frames") / max_frames))).otherwise(1)
    v = videos.withColumn("step", step.cast("int")).select("shot_id", "step")
    kept = frames.join(v, "shot_id").where(F.col("frame_index") % F.col("step") == 0)
    kept = kept.withColumn("source_frame", F.col("frame_index")).withColumn("frame_index", F.expr("cast(frame_index div step as int)"))
    kept = kept.where(F.col("frame_index") < max_frames)
    if "fps" in frames.columns:
        kept = kept.withColumn("fps", F.col("fps") / F.col("step"))
    return kept


def scale_to_max(df: DataFrame, max_dim: int = DEFAULT.max_dimension) -> DataFrame:
    """Shrink width and height so that the longer edge fits; adds the scale, 1 when it already does."""
    longest = F.greatest("width", "height")
    scale = F.when(longest > max_dim, F.lit(float(max_dim)) / longest).otherwise(F.lit(1.0))
    out = df.withColumn("scale", scale)
    for c in ("width", "height"):
        out = out.withColumn(c, F.when(F.col("scale") < 1.0, F.floor(F.col(c) * F.col("scale"))).otherwise(F.col(c)).cast("int"))
    return out


def assign_batches(frames: DataFrame, batch_size: int, drop_last: bool = True) -> DataFrame:
    """Number frames into batches of batch_size per shot; a short last batch is dropped on request."""
    if batch_size <= 0:
        raise ValueError("batch_size must be positive")
    whole = Window.partitionBy("shot_id")
    rn = F.row_number().over(whole.orderBy("frame_index")) - 1
    out = frames.withColumn("_i", rn).withColumn("batch_no", F.floor(F.col("_i") / batch_size).cast("int"))
    if drop_last:
        out = out.withColumn("_n", F.count(F.lit(1)).over(whole)).where(F.col("batch_no") < F.floor(F.col("_n") / batch_size)).drop("_n")
    return out.drop("_i")


def filter_detections(det: DataFrame, classes: Sequence[str] = ("ball", "lane", "pins"), conf: Settings = DEFAULT) -> DataFrame:
    out = det.where(F.col("class_name").isin(list(classes)))
    return out.where(F.col("confidence") >= conf.min_confidence) if "confidence" in det.columns else out


def normalise_boxes(det: DataFrame, source: str, target: str, padding: float = 1.0, box: str = "box") -> DataFrame:
    return det.withColumn(box, G.convert_box(F.col(box), source, target, padding))


def score_frames(frames: DataFrame, predict_fn: Callable[[pd.DataFrame], pd.DataFrame], schema=schemas.DETECTIONS) -> DataFrame:
    """Run a user's model over batches of frames.  The function sees one Arrow batch as pandas and returns detection rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield predict_fn(b)

    return frames.mapInPandas(run, schema)


def frames_with_ball_px(frames: DataFrame, positions: DataFrame, homographies: DataFrame) -> DataFrame:
    """Every frame with the image position of its ball, null where there is none.

    homographies: shot_id, homography, width, height.
    """
    px = positions.join(homographies, "shot_id").withColumn(
        "_p", G.unproject(F.col("x_m"), F.col("y_m"), F.col("homography"), "width", "height")
    ).select("shot_id", "frame_index", F.col("_p.x").alias("ball_px"), F.col("_p.y").alias("ball_py"))
    return frames.join(px, ["shot_id", "frame_index"], "left")
