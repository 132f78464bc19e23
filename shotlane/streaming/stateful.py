"""Streaming twins of the stateful operators.

Each key's rows are sorted by frame inside a micro-batch.  A row at or below
the last frame already seen for its key is late: it comes out flagged, with no
value, and changes no state.  That rule and the idle time after which state is
dropped (ttl_ms, none by default) are this library's own.

These operators need the RocksDB state store:
spark.sql.streaming.stateStore.providerClass =
org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from shotlane.config import DEFAULT, Settings
from shotlane.operators.dataset import top_checkpoints
from shotlane.operators.lanes import TrackTable, flat_quad
from shotlane.operators.sequences import NON_FINITE, non_finite
from shotlane.operators.store import upsert_run_sections

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _sorted(rows: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    return pd.concat(list(rows), ignore_index=True).sort_values(by, kind="stable")


class _Ema(StatefulProcessor):
    def __init__(self, alpha: float, ttl_ms: int | None):
        self.alpha, self.ttl_ms = alpha, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("ema", "frame_index int, x double, y double, z double", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = self.state.get() if self.state.exists() else None
        frame, prev = (None, None) if last is None else (last[0], np.array(last[1:4], dtype=float))
        out = []
        for r in _sorted(rows, ["frame_index"]).drop_duplicates("frame_index", keep="last").itertuples(index=False):
            late = frame is not None and r.frame_index <= frame
            if late:
                out.append((*key, r.frame_index, None, None, None, True))
                continue
            raw = np.array([r.x, r.y, r.z], dtype=float)
            prev = raw if prev is None else self.alpha * raw + (1.0 - self.alpha) * prev
            frame = int(r.frame_index)
            out.append((*key, frame, *prev.tolist(), False))
        if prev is not None:
            self.state.update((frame, *[float(v) for v in prev]))
        yield pd.DataFrame(out, columns=["shot_id", "person_id", "joint_id", "frame_index", "x", "y", "z", "late"])

    def close(self) -> None:
        pass


def _types(df: DataFrame, *names: str) -> str:
    return ", ".join(f"{n} {df.schema[n].dataType.simpleString()}" for n in names)


def stream_ema(joints: DataFrame, alpha: float = DEFAULT.ema_alpha, ttl_ms: int | None = None) -> DataFrame:
    """Smoothed joints per shot, person and joint; columns as the batch operator plus late."""
    a = max(min(alpha, 1.0), 0.01)
    keys = ["shot_id", "person_id", "joint_id"]
    schema = _types(joints, *keys, "frame_index") + ", x double, y double, z double, late boolean"
    return joints.select(*keys, "frame_index", "x", "y", "z").groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=_Ema(a, ttl_ms), outputStructType=schema, outputMode="Append", timeMode="ProcessingTime" if ttl_ms else "None")


class _Tracks(StatefulProcessor):
    def __init__(self, conf: Settings, order: str, ttl_ms: int | None):
        self.conf, self.order, self.ttl_ms = conf, order, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("tracks", "frame_index int, next_id int, tracks string", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame, table = None, TrackTable(self.conf)
        if self.state.exists():
            frame, next_id, packed = self.state.get()[:3]
            table = TrackTable.load(self.conf, json.loads(packed), next_id)
        out = []
        for f, part in _sorted(rows, ["frame_index", self.order]).groupby("frame_index", sort=True):
            if frame is not None and f <= frame:
                out += [(key[0], int(f), int(d), None, None, None, None, None, True) for d in part["det_id"]]
                continue
            got = table.step(int(f), [flat_quad(q) for q in part["corners"]])
            out += [(key[0], int(f), int(d), i, ok, new, q, c, False) for d, (i, ok, new, q, c) in zip(part["det_id"], got)]
            frame = int(f)
        if frame is not None:
            self.state.update((frame, table.next_id, json.dumps(table.dump())))
        yield pd.DataFrame(out, columns=["shot_id", "frame_index", "det_id", "track_id", "accepted", "created", "track_quad", "track_centroid_x", "late"])

    def close(self) -> None:
        pass


def stream_tracks(cands: DataFrame, conf: Settings = DEFAULT, order: str = "det_id", ttl_ms: int | None = None) -> DataFrame:
    """Lane tracker per shot; tracks unseen for stale_frames frames are dropped from the state."""
    flat = cands.select(
        "shot_id", "frame_index", "det_id", *([order] if order != "det_id" else []),
        F.flatten(F.transform("polygon", lambda p: F.array(p["x"], p["y"]))).alias("corners"))
    schema = _types(cands, "shot_id") + (
        ", frame_index int, det_id long, track_id int, accepted boolean, created boolean, track_quad array<double>, track_centroid_x double, late boolean")
    return flat.groupBy("shot_id").transformWithStateInPandas(
        statefulProcessor=_Tracks(conf, order, ttl_ms), outputStructType=schema, outputMode="Append", timeMode="ProcessingTime" if ttl_ms else "None")


class _Velocity(StatefulProcessor):
    """Keeps up to ``depth`` recent positions, and the latest velocity and acceleration."""

    def __init__(self, dt: float, depth: int, ttl_ms: int | None):
        self.dt, self.depth, self.ttl_ms = dt, depth, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.positions = handle.getListState("positions", "frame_index int, x double, y double", self.ttl_ms)
        self.latest = handle.getValueState("latest", "last_frame int, v_frame int, vx double, vy double, ax double, ay double, failed boolean", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        buf = [(int(p[0]), float(p[1]), float(p[2])) for p in self.positions.get()] if self.positions.exists() else []
        last, vf, vx, vy, ax, ay, failed = (self.latest.get() if self.latest.exists() else (None,) * 7)[:7]
        out = []
        for r in _sorted(rows, ["frame_index"]).drop_duplicates("frame_index", keep="first").itertuples(index=False):
            f = int(r.frame_index)
            if last is not None and f <= last:
                out.append((key[0], f, None, None, None, None, True, None))
                continue
            last = f
            failed = bool(failed or r.bad)
            if failed:
                out.append((key[0], f, None, None, None, None, False, NON_FINITE))
                continue
            if not (pd.isna(r.x_m) or pd.isna(r.y_m)):
                if buf:
                    step = self.dt * (f - buf[-1][0])
                    nx, ny = (r.x_m - buf[-1][1]) / step, (r.y_m - buf[-1][2]) / step
                    if vf is not None:
                        vstep = self.dt * (f - vf)
                        ax, ay = (nx - vx) / vstep, (ny - vy) / vstep
                    vf, vx, vy = f, float(nx), float(ny)
                buf = [*buf, (f, float(r.x_m), float(r.y_m))][-self.depth:]
            out.append((key[0], f, vx, vy, ax, ay, False, None))
        self.positions.clear()
        if buf:
            self.positions.put(buf)
        if last is not None:
            num = lambda v: None if v is None else float(v)
            self.latest.update((int(last), None if vf is None else int(vf), num(vx), num(vy), num(ax), num(ay), bool(failed)))
        yield pd.DataFrame(out, columns=["shot_id", "frame_index", "vx", "vy", "ax", "ay", "late", "error"])

    def close(self) -> None:
        pass


def stream_velocity(pos: DataFrame, dt: float = 1.0 / 30.0, depth: int = 12, ttl_ms: int | None = None) -> DataFrame:
    """Latest velocity and acceleration after each frame of each shot; a non-finite coordinate ends its shot with an error text, as in the batch operator."""
    schema = _types(pos, "shot_id", "frame_index") + ", vx double, vy double, ax double, ay double, late boolean, error string"
    return pos.select("shot_id", "frame_index", "x_m", "y_m", non_finite("x_m", "y_m").alias("bad")).groupBy("shot_id").transformWithStateInPandas(
        statefulProcessor=_Velocity(dt, depth, ttl_ms), outputStructType=schema, outputMode="Append", timeMode="ProcessingTime" if ttl_ms else "None")


def late_rows(out: DataFrame) -> DataFrame:
    return out.where("late")


def stream_upsert(updates: DataFrame, store: str, checkpoint: str, trigger: dict | None = None):
    """Start a query that merges every micro-batch into the run store.

    A replayed batch carries the same updated_at values, so it leaves the store as it was.
    """
    def apply(batch: DataFrame, batch_id: int) -> None:
        upsert_run_sections(batch.sparkSession, store, batch)

    w = updates.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return w.trigger(**(trigger or {"availableNow": True})).start()


def open_top_checkpoints(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """The list written last (by a batch under ``before``, if given)."""
    rows = spark.read.parquet(path)
    if before is not None:
        rows = rows.where(F.col("batch") < before)
    return rows.where(F.col("batch") == F.lit(rows.agg(F.max("batch")).first()[0])).drop("batch")


def stream_top_checkpoints(ckpts: DataFrame, path: str, checkpoint: str, k: int, direction: str = "maximize"):
    """Keep the k best checkpoints seen so far; each batch is merged with the k rows kept before.

    Every batch writes a folder of its own below path and reads only older ones, so a failure or a replay loses
    nothing; ``open_top_checkpoints`` reads the newest.
    """
    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        known = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
        rows = batch if not known else open_top_checkpoints(spark, path, batch_id).unionByName(batch).distinct()
        top_checkpoints(rows, k, direction).coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return ckpts.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
