"""Headline timings: one JSON line.  BENCH_SF_DIR and BENCH_CPUS choose the data and the cores."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "kinematics_per_quarter", "gap_velocity", "trim_detections", "trim_diagnostics", "ball_path_score", "densify_linear",
    "isotonic", "smooth_trajectory", "append_departure", "analyse_positions", "lane_metrics", "resample_linear",
    "ema_joints", "body_links", "mask_contact", "union_masks", "mask_iou", "map_50_95", "evaluate_trapezoid", "scanline_boundaries",
    "bev_centroid_warped", "penalise_nested", "select_track", "choose_contact", "project_ball", "calibrate", "error_summary",
    "contact_frame", "merge_run_sections", "upsert_run_sections", "merge_sections", "bundle_frames", "build_label_set", "split_dataset",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from shotlane.session import build_session

    spark = build_session(
        f"local[{cpus}]", "bench",
        **{
            "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false",
            # the numeric kernels cost far more per byte than a scan: do not merge their partitions
            "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k", "spark.sql.files.openCostInBytes": "262144",
        })
    spark.sparkContext.setLogLevel("ERROR")
    from catalog import registry

    spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id").count().write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        t0 = time.time()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "shot analytics, total of headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
