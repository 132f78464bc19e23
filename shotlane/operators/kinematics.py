"""Per-quarter speed and acceleration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotlane.config import DEFAULT, Settings
from shotlane.operators.sequences import SHOT, finite_diff


def kinematics_per_quarter(pos: DataFrame, conf: Settings = DEFAULT, keys: Sequence[str] = SHOT) -> DataFrame:
    """Four rows per shot.  A sample on a boundary counts on both sides; an empty quarter is zeros.

    The four quarters are conditional aggregates of one grouping, so nothing is
    joined or exploded before the aggregation, which reuses the window's exchange.
    """
    length, q = conf.lane_length_m, conf.lane_length_m / 4.0
    steps = finite_diff(pos, keys).withColumn("_y", F.least(F.greatest(F.col("y_m"), F.lit(0.0)), F.lit(length)))
    quarters = []
    for i in range(4):
        here = F.col("speed_mps").isNotNull() & F.col("_y").between(i * q, (i + 1) * q)
        quarters.append(F.struct(
            F.lit(i + 1).alias("quarter"), F.lit(i * q).alias("start_m"), F.lit((i + 1) * q).alias("end_m"),
            F.coalesce(F.avg(F.when(here, F.col("speed_mps"))), F.lit(0.0)).alias("mean_speed_mps"),
            F.coalesce(F.avg(F.when(here, F.col("accel_mps2"))), F.lit(0.0)).alias("mean_acceleration_mps2"),
            F.count(F.when(here, F.lit(1))).alias("sample_count"),
        ))
    return steps.groupBy(*keys).agg(F.array(*quarters).alias("_q")).select(*keys, F.inline("_q"))


def points_to_positions(shots: DataFrame, points: str = "ball_positions", keys: Sequence[str] = SHOT, conf: Settings = DEFAULT) -> DataFrame:
    """Stored points carry no frame number: renumber 0,1,2... at i/fps."""
    fps = F.coalesce(F.col("fps"), F.lit(conf.default_fps))
    return shots.select(*keys, fps.alias("_fps"), F.posexplode(points).alias("frame_index", "_p")).select(
        *keys, "frame_index", (F.col("frame_index") / F.col("_fps")).alias("timestamp_s"),
        F.col("_p.x").alias("x_m"), F.col("_p.y").alias("y_m"),
    )


def kinematics_from_points(shots: DataFrame, points: str = "ball_positions", keys: Sequence[str] = SHOT, conf: Settings = DEFAULT) -> DataFrame:
    """Kinematics as a query recomputes them; a shot without points still gives its four zero rows."""
    found = kinematics_per_quarter(points_to_positions(shots, points, keys, conf), conf, keys)
    q = conf.lane_length_m / 4.0
    zero = F.array(*[
        F.struct(
            F.lit(i + 1).alias("quarter"), F.lit(i * q).alias("start_m"), F.lit((i + 1) * q).alias("end_m"),
            F.lit(0.0).alias("mean_speed_mps"), F.lit(0.0).alias("mean_acceleration_mps2"),
            F.lit(0).cast("long").alias("sample_count"),
        ) for i in range(4)
    ])
    empty = shots.where(F.coalesce(F.size(points), F.lit(0)) <= 0).select(*keys, F.inline(zero))
    return found.unionByName(empty)
