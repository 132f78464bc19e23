"""Joint tables: explode, smooth, name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotlane.config import DEFAULT
from shotlane.operators.scans import affine_scan
from shotlane.operators.sequences import first_per_frame

BODY = ["shot_id", "person_id", "joint_id"]

# The 70 body joints in id order (fixed values of the published joint layout).
_FINGERS = ["thumb", "forefinger", "middle_finger", "ring_finger", "pinky_finger"]


def _hand(side: str) -> list[str]:
    names = []
    for f in _FINGERS:
        names += [f"{side}_{f}4", f"{side}_{f}3", f"{side}_{f}2", f"{side}_{f}_third_joint"]
    return [*names, f"{side}_wrist"]


JOINT_NAMES = [
    "nose", "left_eye", "right_eye", "left_ear", "right_ear",
    "left_shoulder", "right_shoulder", "left_elbow", "right_elbow",
    "left_hip", "right_hip", "left_knee", "right_knee", "left_ankle", "right_ankle",
    "left_big_toe", "left_small_toe", "left_heel",
    "right_big_toe", "right_small_toe", "right_heel",
    *_hand("right"), *_hand("left"),
    "left_olecranon", "right_olecranon", "left_cubital_fossa", "right_cubital_fossa",
    "left_acromion", "right_acromion", "neck",
]
_LOWER = ("hip", "knee", "ankle", "big_toe", "small_toe", "heel")
_UNTYPED = ("olecranon", "cubital_fossa", "acromion", "neck")


def _region(name: str) -> str | None:
    part = name.split("_", 1)[-1]
    return None if part in _UNTYPED else "lower" if part in _LOWER else "upper"


def _swap(name: str) -> str | None:
    if name.startswith("left_"):
        return "right_" + name[5:]
    return "left_" + name[6:] if name.startswith("right_") else None


# Body links (fixed values), then five finger chains from each wrist.
BODY_LINKS = [
    ("left_ankle", "left_knee"), ("left_knee", "left_hip"),
    ("right_ankle", "right_knee"), ("right_knee", "right_hip"),
    ("left_hip", "right_hip"),
    ("left_shoulder", "left_hip"), ("right_shoulder", "right_hip"),
    ("left_shoulder", "right_shoulder"),
    ("left_shoulder", "left_elbow"), ("right_shoulder", "right_elbow"),
    ("left_elbow", "left_wrist"), ("right_elbow", "right_wrist"),
    ("left_eye", "right_eye"), ("nose", "left_eye"), ("nose", "right_eye"),
    ("left_eye", "left_ear"), ("right_eye", "right_ear"),
    ("left_ear", "left_shoulder"), ("right_ear", "right_shoulder"),
    ("left_ankle", "left_big_toe"), ("left_ankle", "left_small_toe"), ("left_ankle", "left_heel"),
    ("right_ankle", "right_big_toe"), ("right_ankle", "right_small_toe"), ("right_ankle", "right_heel"),
    *[
        link
        for side in ("left", "right")
        for f in _FINGERS
        for link in (
            (f"{side}_wrist", f"{side}_{f}_third_joint"),
            (f"{side}_{f}_third_joint", f"{side}_{f}2"),
            (f"{side}_{f}2", f"{side}_{f}3"),
            (f"{side}_{f}3", f"{side}_{f}4"),
        )
    ],
]


def joint_dim(spark: SparkSession) -> DataFrame:
    ids = {n: i for i, n in enumerate(JOINT_NAMES)}
    rows = [(i, n, ids.get(_swap(n), i) if _swap(n) else i, _region(n)) for n, i in ids.items()]
    return spark.createDataFrame(rows, "joint_id int, joint_name string, swap_id int, body_part string")


def link_dim(spark: SparkSession) -> DataFrame:
    ids = {n: i for i, n in enumerate(JOINT_NAMES)}
    return spark.createDataFrame(
        [(k, ids[a], ids[b]) for k, (a, b) in enumerate(BODY_LINKS)], "link_id int, from_id int, to_id int"
    )


def explode_skeleton(df: DataFrame, points: str = "keypoints", keys: Sequence[str] = ("shot_id", "frame_index", "person_id")) -> DataFrame:
    """Array of [x, y, z] per person to one row per joint."""
    return df.select(*keys, F.posexplode(points).alias("joint_id", "_p")).select(
        *keys, "joint_id", *[F.get("_p", F.lit(i)).cast("double").alias(c) for i, c in enumerate("xyz")]
    )


def collect_skeleton(joints: DataFrame, keys: Sequence[str] = ("shot_id", "frame_index", "person_id")) -> DataFrame:
    """Back to one array of joints per person and frame (at most the joints of one body)."""
    return joints.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("joint_id", "x", "y", "z"))).alias("joints")
    )


def ema(joints: DataFrame, alpha: float = DEFAULT.ema_alpha, keys: Sequence[str] = BODY, order: Sequence[str] | None = None) -> DataFrame:
    """Exponential moving average of each joint over the frames it is seen in; state survives gaps.

    Where a joint may repeat in a frame, ``order`` names the columns of arrival and the last row counts; without it a
    frame must hold a joint once.  Rows with a null coordinate are not seen.  The average is an affine scan, so a
    joint may have any number of frames.
    """
    if alpha >= 1.0:
        return joints
    a = max(alpha, 0.01)
    pts = joints.select(*dict.fromkeys([*keys, "frame_index", "x", "y", "z", *(order or ())])).dropna(subset=["x", "y", "z"])
    if order:
        pts = first_per_frame(pts, order=order, keys=list(keys), last=True)
    terms = {c: (F.lit(a) * F.col(c), F.col(c)) for c in "xyz"}
    return affine_scan(pts, keys, "frame_index", F.lit(1.0 - a), terms)


def last_person_wins(joints: DataFrame) -> DataFrame:
    """Person identity dropped: of several people in a frame the last keeps each joint id."""
    return first_per_frame(joints, order=("person_id",), keys=["shot_id", "joint_id"], last=True)


def join_joint_dim(joints: DataFrame) -> DataFrame:
    """Names, left/right partner and body part; the dimension is 70 rows, so broadcasting it is bounded."""
    return joints.join(F.broadcast(joint_dim(joints.sparkSession)), "joint_id", "left")


def body_links(joints: DataFrame, keys: Sequence[str] = ("shot_id", "frame_index", "person_id")) -> DataFrame:
    """One row per body link with both end points.

    Both ends of a link come from the same person and frame, so each joint row
    is sent to its (at most a few) links and met there, without a self-join.
    """
    links = link_dim(joints.sparkSession)
    ends = links.select("link_id", F.col("from_id").alias("joint_id"), F.lit("a").alias("_e")).unionByName(
        links.select("link_id", F.col("to_id").alias("joint_id"), F.lit("b").alias("_e"))
    )
    met = joints.join(F.broadcast(ends), "joint_id")
    side = lambda e, c: F.max(F.when(F.col("_e") == e, F.col(c)))
    return met.groupBy(*keys, "link_id").agg(
        *[side("a", c).alias(f"{c}0") for c in "xyz"], *[side("b", c).alias(f"{c}1") for c in "xyz"],
        F.count(F.lit(1)).alias("_n"),
    ).where("_n = 2").drop("_n")
