"""Explicit schemas as DDL text; nothing is inferred."""


def columns(ddl: str) -> list[str]:
    """Column names of a flat DDL text."""
    return [part.split()[0] for part in ddl.split(", ")]


POINT = "struct<x:double,y:double>"
QUAD = f"array<{POINT}>"

DETECTIONS = (
    "shot_id string, frame_index int, det_id long, class_name string, confidence double, "
    "x0 double, y0 double, x1 double, y1 double"
)
MASK_RUNS = ("shot_id string, frame_index int, det_id long, class_name string, y int, x0 int, x1 int")
POSITIONS = ("shot_id string, frame_index int, timestamp_s double, x_m double, y_m double")
JOINTS = ("shot_id string, frame_index int, person_id int, joint_id int, x double, y double, z double")

SHOT_RECORD = (
    "id string, timestamp string, source string, shot_number int, video_key string, fps double, "
    "ball_positions array<struct<x:double,y:double>>, "
    "skeleton_frames array<array<struct<joint_id:int,x:double,y:double,z:double>>>"
)
# a section payload stays JSON text: its shape depends on the section
RUN_RECORD = (
    "id string, created_at string, updated_at string, name string, slug string, video_key string, "
    "sd_key string, sections map<string,string>, _corrupt_record string"
)
SENSOR = ("BufferData array<struct<Timestamp:string>>, AccelerometerJumpTimestamps array<string>")
GROUND_TRUTH = (
    "global_frame_idx int, episode_idx int, frame_in_episode int, t_sec double, x double, y double, "
    "vx_units_per_sec double, vy_units_per_sec double, speed_units_per_sec double, "
    "ax_units_per_sec2 double, ay_units_per_sec2 double, accel_units_per_sec2 double, "
    "lane_s double, lane_frac double, lat_from_center double, lat_from_start double, "
    "episode_total_break double, episode_end_speed double"
)
TRAINING_HISTORY = (
    "epoch int, train_box_loss double, train_cls_loss double, train_dfl_loss double, "
    "val_box_loss double, val_cls_loss double, val_dfl_loss double, map50 double, map50_95 double"
)
# header text of the history file -> our column; fixed values of the file format
TRAINING_HISTORY_HEADER = {
    "epoch": "epoch",
    "train/box_loss": "train_box_loss",
    "train/cls_loss": "train_cls_loss",
    "train/dfl_loss": "train_dfl_loss",
    "val/box_loss": "val_box_loss",
    "val/cls_loss": "val_cls_loss",
    "val/dfl_loss": "val_dfl_loss",
    "metrics/mAP50(B)": "map50",
    "metrics/mAP50-95(B)": "map50_95",
}

# column order of the evaluation file (a file format: fixed values)
EVAL_COLUMNS = [
    "timestamp", "test_name", "interpolation_mode", "episode_idx", "fraction", "frac_position",
    "pred_vel_s", "pred_vel_l", "pred_speed",
    "gt_vel_s", "gt_vel_l", "gt_speed",
    "vel_s_error", "vel_l_error", "speed_error",
    "pred_acc_s", "pred_acc_l", "pred_accel_mag",
    "gt_acc_s", "gt_acc_l", "gt_accel_mag",
    "acc_s_error", "acc_l_error", "accel_mag_error",
    "pred_total_break", "gt_total_break", "total_break_error",
    "pred_end_speed", "gt_end_speed", "end_speed_error",
    "frame_count", "segmentation_map_50_95",
]
