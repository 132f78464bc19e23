"""Mask operators on run-length rows.

A mask is rows (key columns, y, x0, x1) with inclusive ends; runs of one mask
do not overlap.  Measures are plain aggregates, so a mask is never drawn.
Components, borders and trapezoids also take masks packed by ``packs.pack``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shotlane.config import DEFAULT, Settings
from shotlane.functions import geometry as G
from shotlane.operators import packs

MASK = ["shot_id", "frame_index", "det_id"]
CLASS = ["shot_id", "frame_index", "class_name"]
RUN = ["y", "x0", "x1"]


def _len() -> Column:
    return F.col("x1") - F.col("x0") + 1


def mask_area(runs: DataFrame, keys: Sequence[str] = MASK) -> DataFrame:
    return runs.groupBy(*keys).agg(F.sum(_len()).alias("area"))


def mask_boxes(runs: DataFrame, keys: Sequence[str] = MASK) -> DataFrame:
    return runs.groupBy(*keys).agg(
        F.min("x0").alias("x0"), F.min("y").alias("y0"), F.max("x1").alias("x1"), F.max("y").alias("y1")
    )


def mask_contact(runs: DataFrame, keys: Sequence[str] = MASK) -> DataFrame:
    """Where the ball touches the lane: lowest row, middle of the column extent; with the area."""
    return runs.groupBy(*keys).agg(
        ((F.min("x0") + F.max("x1")) / 2.0).alias("contact_x"),
        F.max("y").cast("double").alias("contact_y"), F.sum(_len()).alias("area"),
    )


def mask_centroid(runs: DataFrame, keys: Sequence[str] = MASK) -> DataFrame:
    n = F.sum(_len())
    return runs.groupBy(*keys).agg(
        (F.sum((F.col("x0") + F.col("x1")) * _len()) / (2.0 * n)).alias("cx"), (F.sum(F.col("y") * _len()) / n).alias("cy")
    )


def _rows(ids: np.ndarray, y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by (group, y, x), and the place of each sorted element's image row among all rows of all groups."""
    line = packs.order_by(ids, y)
    change = np.append(np.zeros(min(1, len(line)), bool), (np.diff(ids[line]) != 0) | (np.diff(y[line]) != 0))
    row = np.empty(len(line), np.int64)
    row[line] = np.cumsum(change)
    by = packs.order_by(row, x)
    return by, row[by]


def _merged(ids: np.ndarray, y: np.ndarray, x0: np.ndarray, x1: np.ndarray) -> tuple[np.ndarray, ...]:
    """Group, y, x0, x1 of the disjoint runs that overlapping or touching runs of a row make."""
    y, x0, x1 = (c.astype(np.int64) for c in (y, x0, x1))
    if not len(y):
        return ids, y, x0, x1
    by, row = _rows(ids, y, x0)
    ids, y, x0, x1 = ids[by], y[by], x0[by], x1[by]
    low, width = x0.min(), max(x1.max(), x0.max()) - x0.min() + 4
    reach = np.maximum.accumulate(row * width + (x1 - low))
    at = np.flatnonzero(np.append(True, row[1:] * width + (x0[1:] - low) > reach[:-1] + 1))
    end = np.append(at[1:], len(y)) - 1
    return ids[at], y[at], x0[at], reach[end] - row[at] * width + low


def _union(packed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Disjoint runs of packed ones; what is held of a key never exceeds twice its union, however many masks overlap."""
    fields = [T.StructField(c, packed.schema[c].dataType.elementType) for c in RUN]

    def merged(g: packs.Groups):
        of, *values = _merged(g.id, *g.flat)
        return g.rows(of, *[packs.cast_down(v, f.dataType) for v, f in zip(values, fields)])

    return packs.per_group(packed, keys, merged, fields, shrink=lambda g: g.repacked(*_merged(g.id, *g.flat)))


def union_masks(runs: DataFrame, keys: Sequence[str] = CLASS) -> DataFrame:
    """Overlapping or touching runs of one (keys, row) merged into disjoint runs.

    Packed runs of a key meet in one exchange and are merged batch by batch.
    """
    return _union(packs.pack(runs, keys, RUN), keys)


def mask_iou(pred: DataFrame, truth: DataFrame, keys: Sequence[str] = CLASS) -> DataFrame:
    """Intersection over union of everything predicted and true in each key; 0 when both are empty.

    No run is ever paired with another: the runs of both sides of a key meet packed in one exchange, and one pass over
    their edges gives all areas.
    """
    sides = [df.select(*keys, *RUN, F.lit(i).cast("byte").alias("_s")) for i, df in enumerate((pred, truth))]
    both = packs.pack(sides[0].unionByName(sides[1]), [*keys, "_s"], RUN)
    both = both.withColumn("_s", F.array_repeat("_s", F.size("y"))).select(*keys, *RUN, "_s")

    def areas(g: packs.Groups):
        y, x0, x1 = (c.astype(np.int64) for c in g.flat[:3])
        ids, at, step = np.concatenate([g.id, g.id]), np.concatenate([x0, x1 + 1]), np.repeat([1, -1], len(y))
        by, _ = _rows(ids, np.concatenate([y, y]), at)
        first = np.concatenate([g.flat[3], g.flat[3]])[by] == 0
        # every row's steps sum to zero, so nothing is open between rows
        a, b = np.cumsum(np.where(first, step[by], 0)) > 0, np.cumsum(np.where(first, 0, step[by])) > 0
        width, ids = np.diff(at[by], append=0), ids[by]
        sums = [np.bincount(ids[on], weights=width[on], minlength=g.count).astype(np.int64) for on in (a & b, a | b)]
        return g.rows(np.arange(g.count), *map(pa.array, sums))

    def shrink(g: packs.Groups):
        parts = []
        for s in (0, 1):
            on = g.flat[3] == s
            merged = _merged(g.id[on], *[c[on] for c in g.flat[:3]])
            parts.append([*merged, np.full(len(merged[0]), s, np.int8)])
        ids, *values = (np.concatenate(c) for c in zip(*parts))
        by = np.argsort(ids, kind="stable")
        return g.repacked(ids[by], *[v[by] for v in values])

    met = packs.per_group(both, keys, areas, [packs.whole("intersection"), packs.whole("union_area")], shrink)
    return met.withColumn("iou", F.when(F.col("union_area") > 0, F.col("intersection") / F.col("union_area")).otherwise(0.0))


# ten thresholds from 0.5 in steps of 0.05, as a float range makes them
_STEP = (0.5 + 0.05) - 0.5
IOU_THRESHOLDS = [0.5 + i * _STEP for i in range(10)]


def map_50_95(iou: DataFrame, frames: DataFrame, keys: Sequence[str] = ("shot_id", "frame_index"), classes: Sequence[str] = ("lane", "ball")) -> DataFrame:
    """Share of passed thresholds, averaged over the classes, for every frame of ``frames``; a class or frame with no mask at all passes none."""
    hits = F.size(F.filter(F.array(*[F.lit(t) for t in IOU_THRESHOLDS]), lambda t: F.col("iou") >= t))
    passed = iou.where(F.col("class_name").isin(list(classes))).groupBy(*keys).agg(
        (F.sum(hits) / (10.0 * len(classes))).alias("map_50_95")
    )
    return frames.select(*keys).distinct().join(passed, list(keys), "left").select(*keys, F.coalesce("map_50_95", F.lit(0.0)).alias("map_50_95"))


def episode_map(frame_map: DataFrame, keys: Sequence[str] = ("shot_id",)) -> DataFrame:
    return frame_map.groupBy(*keys).agg(F.avg("map_50_95").alias("map_50_95"), F.count(F.lit(1)).alias("frames"))


def coverage_ratio(frames: DataFrame, lanes: DataFrame) -> DataFrame:
    """Lane area over frame area per frame, capped at 1; ``frames`` holds every frame with its height and width.

    ``lanes``: mask rows, or masks with their ``area``.
    """
    key = ["shot_id", "frame_index"]
    area = lanes.groupBy(*key).agg(F.sum("area").alias("area")) if "area" in lanes.columns else mask_area(lanes, key)
    return frames.join(area, ["shot_id", "frame_index"], "left").select(
        "shot_id", "frame_index", F.coalesce(F.col("area"), F.lit(0)).alias("lane_area"),
        F.least(F.coalesce(F.col("area"), F.lit(0)) / F.greatest(F.col("height") * F.col("width"), F.lit(1)), F.lit(1.0)).alias("coverage"),
    )


def mean_coverage(per_frame: DataFrame) -> DataFrame:
    return per_frame.groupBy("shot_id").agg(F.avg("coverage").alias("mean_lane_coverage_ratio"))


def polygon_runs(polys: DataFrame, keys: Sequence[str] = MASK, poly: str = "polygon", height=None, width=None) -> DataFrame:
    """Pixels whose centre is inside or on the polygon, as runs.

    Every row takes the even-odd spans just below and just above it, so that
    top and bottom edges count; a row cut twice the same way is merged.  The edges of all polygons of an Arrow batch are cut at once, and a
    polygon's spans leave its task as one packed row.
    """
    nan = lambda c: F.transform(poly, lambda p: F.coalesce(p[c].cast("double"), F.lit(float("nan"))))
    ys = F.transform(poly, lambda p: p["y"])
    top, bottom = F.ceil(F.array_min(ys)), F.floor(F.array_max(ys))
    if height is not None:
        top, bottom = F.greatest(top, F.lit(0)), F.least(bottom, G._c(height).cast("long") - 1)
    wide = F.lit(np.iinfo(np.int32).max) if width is None else G._c(width).cast("int")
    rows = polys.select(*keys, nan("x").alias("_x"), nan("y").alias("_y"), top.cast("long").alias("_top"), bottom.cast("long").alias("_bottom"), wide.alias("_w")).where("_top <= _bottom")
    if width is not None:
        rows = packs.present(rows, ["_w"])
    k, clip = len(keys), width is not None
    schema = T.StructType([*[rows.schema[c] for c in keys], *[T.StructField(c, T.ArrayType(T.IntegerType())) for c in RUN]])

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            top, bottom, w = (b.column(k + j).to_numpy(zero_copy_only=False).astype(np.int64) for j in (2, 3, 4))
            # at most so many rows of polygons at once
            part = np.cumsum(bottom - top + 1) // (1 << 18)
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), b.num_rows]
            for i, j in zip(cuts, cuts[1:]):
                lists = [b.column(k + n).slice(i, j - i) for n in (0, 1)]
                ids, y, x0, x1 = _spans(*[c.flatten().to_numpy() for c in lists], lists[0].value_lengths().to_numpy().astype(np.int64), top[i:j], bottom[i:j])
                if clip:
                    x0, x1 = np.maximum(x0, 0), np.minimum(x1, w[i:j][ids] - 1)
                on = np.flatnonzero(x0 <= x1)
                at = pa.array(np.searchsorted(ids[on], np.arange(j - i + 1)), pa.int32())
                packed = [pa.ListArray.from_arrays(at, pa.array(v[on], pa.int32())) for v in (y, x0, x1)]
                yield pa.RecordBatch.from_arrays([*[b.column(n).slice(i, j - i) for n in range(k)], *packed], names=schema.names)

    names = [*keys, "_x", "_y", "_top", "_bottom", "_w"]
    return _union(rows.select(*names).mapInArrow(run, schema), keys)


def _spans(px: np.ndarray, py: np.ndarray, sizes: np.ndarray, top: np.ndarray, bottom: np.ndarray) -> tuple[np.ndarray, ...]:
    """Polygon, row, first and last pixel of the spans of many polygons, whose corners lie one after another, on rows top to bottom."""
    ids = np.repeat(np.arange(len(sizes)), sizes)
    after = np.arange(1, len(px) + 1)
    after[np.cumsum(sizes)[sizes > 0] - 1] = (np.cumsum(sizes) - sizes)[sizes > 0]
    qx, qy = px[after], py[after]
    with np.errstate(invalid="ignore"):
        edge = np.flatnonzero((py != qy) & ~np.isnan(py + qy))
    low, high = np.minimum(py, qy)[edge], np.maximum(py, qy)[edge]
    first, last = np.maximum(np.ceil(low), top[ids[edge]]).astype(np.int64), np.minimum(np.floor(high), bottom[ids[edge]]).astype(np.int64)
    many = np.maximum(last - first + 1, 0)
    which = np.repeat(np.arange(len(edge)), many)
    y = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + first[which]
    e = edge[which]
    x = px[e] + (y - py[e]) * (qx[e] - px[e]) / (qy[e] - py[e])
    out = []
    for open_end in (high, low):
        on = np.flatnonzero((y != open_end[which]) & ~np.isnan(x))
        of, row, at = ids[e[on]], y[on], x[on]
        by = np.lexsort((at, row, of))
        of, row, at = of[by], row[by], at[by]
        start = np.append(True, (np.diff(of) != 0) | (np.diff(row) != 0))[: len(of)]
        place = np.arange(len(of)) - np.maximum.accumulate(np.where(start, np.arange(len(of)), 0))
        second = np.flatnonzero(place % 2 == 1)
        out.append((of[second], row[second], np.ceil(at[second - 1] - 1e-9).astype(np.int64), np.floor(at[second] + 1e-9).astype(np.int64)))
    of, row, x0, x1 = (np.concatenate(c) for c in zip(*out))
    by = np.argsort(of, kind="stable")
    return of[by], row[by], x0[by], x1[by]


# ---- trapezoid support -----------------------------------------------------

_XY = [(f"_x{i}", f"_y{i}") for i in range(4)]


def _corner_columns(poly: str) -> list[Column]:
    return [G.corner(F.col(poly), i)[k].alias(_XY[i][k]) for i in range(4) for k in (0, 1)]


def _row_ends(ids: np.ndarray, y: np.ndarray, quads: tuple[np.ndarray, np.ndarray], width: np.ndarray) -> tuple[np.ndarray, ...]:
    """Which rows ``y`` meet their quad (place ``ids``), and the first and last pixel there, as ``G.quad_span`` has the ends.

    quads: corners x0, y0 .. y3 (rows) of all quads (columns), and which are no nulls.  A missing width holds no pixel back.
    """
    at, there = quads
    low, high = np.full(len(y), np.nan), np.full(len(y), -np.inf)
    met = np.zeros(len(y), bool)
    with np.errstate(all="ignore"):
        for i in range(4):
            j = (i + 1) % 4
            ax, ay, bx, by = at[2 * i], at[2 * i + 1], at[2 * j], at[2 * j + 1]
            fine = there[[2 * i, 2 * i + 1, 2 * j, 2 * j + 1]].all(axis=0) & (by - ay != 0)
            # a NaN is larger than any number
            hit = np.flatnonzero(fine[ids] & (y >= np.fmin(ay, by)[ids]) & ~(y > np.maximum(ay, by)[ids]) & ~np.isnan(y))
            of = ids[hit]
            x = ax[of] + (y[hit] - ay[of]) * (bx - ax)[of] / (by - ay)[of]
            low[hit], high[hit], met[hit] = np.fmin(low[hit], x), np.maximum(high[hit], x), True
        first, last = _long(np.ceil(low - 1e-9)), _long(np.floor(high + 1e-9))
    return met, np.maximum(first, 0.0), np.fmin(last, width[ids] - 1)


def _long(v: np.ndarray) -> np.ndarray:
    """Whole doubles as a cast to a long leaves them."""
    return np.clip(np.where(np.isnan(v), 0.0, v), -(2.0 ** 63), 2.0 ** 63)


def _band_sums(ids: np.ndarray, y: np.ndarray, px: np.ndarray, bands: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Sums of ``px`` on the rows [start, stop) of every band (rows) of every quad (columns)."""
    start, stop = bands
    if not len(y):
        return np.zeros(start.shape)
    low, high = y.min(), y.max() + 1
    place = lambda ids, y: ids * (high - low + 1) + (y - low)
    key = place(ids, y)
    by = np.argsort(key, kind="stable")
    key, upto = key[by], np.append(0.0, np.cumsum(px[by]))
    below = lambda edge: upto[np.searchsorted(key, place(np.arange(edge.shape[1]), np.clip(edge, low, high)).ravel())].reshape(edge.shape)
    return np.where(np.isnan(stop), 0.0, np.maximum(below(np.where(np.isnan(stop), low, stop)) - below(start), 0.0))


_EDGE = ["width", "height", *[c for xy in _XY for c in xy], "_b0", "_b1"]


def _edges(b: pa.RecordBatch, k: int, n: int) -> tuple:
    """Quads, widths, the bands' rows and whether there are bands, from the columns of ``_EDGE`` that begin at ``k``."""
    width, height, *corners, b0, b1 = (b.column(k + j).to_numpy(zero_copy_only=False).astype(float) for j in range(len(_EDGE)))
    there = np.array([b.column(k + 2 + j).is_valid().to_numpy(zero_copy_only=False) for j in range(8)])
    i = np.arange(n)[:, None]
    with np.errstate(invalid="ignore"):
        step = (b1 - b0) / float(n)
        start = np.fmax(np.floor(i * step + b0), 0.0)
        stop = np.fmin(np.ceil(np.where(i == n - 1, b1, (i + 1) * step + b0)), height)
    return (np.array(corners), there), width, (start, stop), b1 > b0


def _sizes(c: pa.Array) -> np.ndarray:
    return c.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def evaluate_trapezoid(runs: DataFrame, polys: DataFrame, keys: Sequence[str] = MASK, poly: str = "polygon", conf: Settings = DEFAULT) -> DataFrame:
    """Coverage, purity, band support and total score of one lane quad per mask.

    ``polys`` has keys, polygon, height, width.  The polygon side is one row per
    mask, so the join is on the mask key alone, and masks meet it packed; a run meets the quad's span on
    its row, and the total and all band sums of the masks of an Arrow batch are worked out at once and leave it as one row per packed row.
    """
    n, k = conf.support_bands, len(keys)
    top, bottom = F.least("_y0", "_y1"), F.greatest("_y2", "_y3")
    # rows [start, stop) the bands divide
    edge = polys.select(*keys, "width", "height", *_corner_columns(poly)).withColumn(
        "_b0", F.greatest(F.floor(top), F.lit(0))).withColumn("_b1", F.least(F.ceil(bottom), F.col("height") - 1))
    fills, areas = [f"_f{i}" for i in range(n)], [f"_a{i}" for i in range(n)]

    def over(b: pa.RecordBatch):
        y, x0, x1 = (b.column(k + j).flatten().to_numpy(zero_copy_only=False).astype(float) for j in range(3))
        ids = np.repeat(np.arange(b.num_rows), _sizes(b.column(k)))
        quads, width, bands, _ = _edges(b, k + 3, n)
        met, first, last = _row_ends(ids, y, quads, width)
        # a missing end of a run holds nothing back
        px = np.where(met, np.trunc(np.maximum(np.fmin(x1, last) - np.fmax(x0, first) + 1, 0.0)), 0.0)
        lane = np.nan_to_num(x1 - x0 + 1)
        whole = [np.bincount(ids, weights=v, minlength=b.num_rows) for v in (px, lane)]
        return [pa.array(v) for v in (*whole, *_band_sums(ids[met], y[met], px[met], bands))]

    met = packs.pack(runs, keys, RUN, nulls=True).join(edge, list(keys)).select(*keys, *RUN, *_EDGE)
    sums = packs.per_row(met, keys, over, [packs.double(c) for c in ("_inter", "_lane", *fills)])

    def own(b: pa.RecordBatch):
        quads, width, bands, banded = _edges(b, k, n)
        ends = [b.column(k + len(_EDGE) + j).to_numpy(zero_copy_only=False).astype(np.int64) for j in (0, 1)]
        low, many = np.minimum(*ends), np.abs(ends[1] - ends[0]) + 1
        # at most so many rows of quads at once
        cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(many) // (1 << 18))) + 1).tolist(), b.num_rows]
        area, parts = np.zeros(b.num_rows), np.zeros((n, b.num_rows))
        for i, j in zip(cuts, cuts[1:]):
            size = many[i:j]
            ids = np.repeat(np.arange(j - i), size)
            y = (np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low[i:j], size)).astype(float)
            met, first, last = _row_ends(ids, y, tuple(q[:, i:j] for q in quads), width[i:j])
            px = np.where(met, np.maximum(last - first + 1, 0.0), 0.0)
            area[i:j] = np.bincount(ids, weights=px, minlength=j - i)
            parts[:, i:j] = _band_sums(ids, y, px, tuple(e[:, i:j] for e in bands))
        return [pa.array(banded.astype(np.int64)), *[pa.array(v) for v in (area, *parts)]]

    # pixels of the quad itself, whole and per band, from one pass over its rows
    rows = edge.select(
        *keys, *_EDGE, F.greatest(F.ceil(F.least("_y0", "_y1", "_y2", "_y3")), F.lit(0)).cast("long"),
        F.greatest(F.least(F.floor(F.greatest("_y0", "_y1", "_y2", "_y3")), F.col("height") - 1), F.lit(0)).cast("long"))
    area = packs.per_row(rows, keys, own, [packs.whole("_banded"), *[packs.double(c) for c in ("_area", *areas)]])
    both = sums.unionByName(area, allowMissingColumns=True).groupBy(*keys).agg(
        F.max("_banded").alias("_banded"), *[F.sum(c).alias(c) for c in ("_inter", "_lane", "_area", *fills, *areas)])

    def support(b: pa.RecordBatch):
        banded, inter, lane, area, *bands = (b.column(k + j).to_numpy(zero_copy_only=False).astype(float) for j in range(4 + 2 * n))
        total, count, good = (np.zeros(b.num_rows) for _ in range(3))
        with np.errstate(all="ignore"):
            for fill, own in zip(bands[:n], bands[n:]):
                on = (banded == 1) & (own > 0)
                v = np.where(on, np.fmin(np.nan_to_num(fill) / own / 0.55, 1.0), 0.0)
                total, count, good = total + v, count + on, good + (v > 0.20)
            score = np.clip(0.65 * (total / count) + 0.35 * (good / count), 0.0, 1.0)
        return [*map(packs.nullable, (inter, lane, area)), pa.array(np.where(count > 0, score, 0.0))]

    measured = packs.per_row(both, keys, support, [packs.double(c) for c in ("_inter", "_lane", "_area", "_support")])
    joined = polys.join(measured, list(keys), "left")
    ok = (F.col("_area") > 0) & (F.coalesce(F.col("_lane"), F.lit(0.0)) > 0)
    cw = conf.coverage_weight
    out = (
        joined.withColumn("support_score", F.coalesce("_support", F.lit(0.0)))
        .withColumn("_g", G.geometry_scores(F.col(poly), "height", "width"))
        .withColumn("coverage", F.when(ok, F.col("_inter") / F.nullif(F.col("_lane"), F.lit(0.0))).otherwise(0.0))
        .withColumn("purity", F.when(ok, F.col("_inter") / F.nullif(F.col("_area"), F.lit(0.0))).otherwise(0.0))
    )
    score = (
        0.55 * (cw * F.col("coverage") + (1.0 - cw) * F.col("purity"))
        + 0.25 * F.col("_g.geometry_score") + 0.20 * F.col("support_score")
    )
    return out.withColumn("score", F.when(ok, score).otherwise(0.0)).select(
        *polys.columns, "coverage", "purity", "support_score", "score",
        "_g.geometry_score", "_g.width_ratio", "_g.bottom_width", "_g.y_span_ratio",
        F.coalesce(F.col("_lane"), F.lit(0.0)).alias("mask_area"),
    )


# ---- row statistics without pixels -----------------------------------------

def _pixel_percentiles(group: np.ndarray, x0: np.ndarray, x1: np.ndarray, count: int, low: float, high: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pixels, and two percentiles of the pixel columns, of each group of runs.

    Runs become +1/-1 edges; the depth between edges tells how many pixels each column holds, and an order statistic is
    read from the running count.
    """
    ids, at = np.concatenate([group, group]), np.concatenate([x0, x1 + 1])
    by = packs.order_by(ids, at)
    ids, at = ids[by], at[by]
    depth = np.cumsum(np.repeat([1, -1], len(group))[by])
    px = depth * np.diff(at, append=0)
    on = (depth > 0) & (px > 0)
    ids, at, depth, px = ids[on], at[on], depth[on], px[on]
    upto = np.cumsum(px)
    n = np.bincount(ids, weights=px, minlength=count).astype(np.int64)
    base = np.cumsum(n) - n

    def pick(k: np.ndarray) -> np.ndarray:
        want = base + np.clip(k, 0, None).astype(np.int64)
        i = np.minimum(np.searchsorted(upto, want, side="right"), max(len(upto) - 1, 0))
        return at[i] + (want - (upto[i] - px[i])) // depth[i] if len(upto) else np.zeros(count, np.int64)

    out = []
    for p in (low, high):
        pos = p * (n - 1)
        a, b = pick(np.floor(pos)), pick(np.ceil(pos))
        out.append(a + (b - a) * (pos - np.floor(pos)))
    return n, *out


def _scan(ids: np.ndarray, y: np.ndarray, x0: np.ndarray, x1: np.ndarray, count: int) -> tuple[np.ndarray, ...]:
    """Mask, row, left and right border on up to 90 evenly spaced rows of each mask (three rows pooled), in order of mask and row."""
    top, bottom = np.full(count, np.iinfo(np.int64).max), np.full(count, np.iinfo(np.int64).min)
    np.minimum.at(top, ids, y)
    np.maximum.at(bottom, ids, y)
    # a mask without runs has no rows (its bottom is not below its top)
    tall = (bottom > top) & (bottom - top >= 20)
    heights = np.where(tall, bottom - top + 1, 0)
    base = np.cumsum(heights) - heights
    wanted = np.zeros(int(heights.sum()), bool)
    a, b = top[tall][:, None], bottom[tall][:, None]
    i = np.arange(90)
    rows = np.where(i == 89, b, np.floor(i * ((b - a) / 89.0) + a).astype(np.int64))
    wanted[(base[tall][:, None] + rows - a).ravel()] = True
    on = tall[ids]
    ids, y, x0, x1 = ids[on], y[on], x0[on], x1[on]
    place = (base[ids] + y - top[ids])[None, :] + np.array([[-1], [0], [1]])
    inside = (place >= base[ids]) & (place < (base + heights)[ids])
    inside[inside] = wanted[place[inside]]
    _, which = np.nonzero(inside)
    slot = place[inside]
    number = np.cumsum(wanted) - 1
    at = np.flatnonzero(wanted)
    n, left, right = _pixel_percentiles(number[slot], x0[which], x1[which], len(at), 0.01, 0.99)
    mask = np.repeat(np.arange(count), heights)[at]
    keep = np.flatnonzero((n >= 12) & (right - left >= 10))
    return mask[keep], (at - base[mask] + top[mask])[keep], left[keep], right[keep]


def scanline_boundaries(runs: DataFrame, keys: Sequence[str] = MASK) -> DataFrame:
    """Left and right border on up to 90 evenly spaced rows of each mask (three rows pooled); none for masks without a key.

    A mask's packed runs meet in one exchange; its rows are counted there.
    """
    row_of = packs.element(runs.schema["y"])

    def lines(g: packs.Groups):
        mask, row, left, right = _scan(g.id, *(c.astype(np.int64) for c in g.flat), g.count)
        return g.rows(mask, packs.cast_down(row, row_of.dataType), *[pa.array(v, pa.float64()) for v in (left, right, right - left)])

    return packs.per_group(packs.pack(packs.present(runs, keys), keys, RUN), keys, lines, [row_of, *map(packs.double, ("left_x", "right_x", "width"))])


def _near(ids: np.ndarray, x0: np.ndarray, x1: np.ndarray, count: int) -> tuple[np.ndarray, ...]:
    """Groups of runs with at least 8 pixels, and their left and right border."""
    n, left, right = _pixel_percentiles(ids, x0, x1, count, 0.005, 0.995)
    keep = np.flatnonzero(n >= 8)
    return keep, left[keep], right[keep]


#: Rows above and below a target whose runs are pooled.
NEAR = 4


def boundary_near(runs: DataFrame, targets: DataFrame, keys: Sequence[str] = MASK, row: str = "target_y", by: Sequence[str] = ()) -> DataFrame:
    """Left and right border around given rows of masks (nine rows pooled); absent with fewer than 8 pixels.

    ``targets``: the row to look at, one per mask or one per mask and ``by``.  A mask meets its targets packed, and only its runs near them go on.
    """
    each = [*keys, *by]
    want = targets.select(*each, F.rint(F.col(row)).cast("int").alias("_at"))
    met = packs.pack(packs.present(runs, keys), keys, RUN).join(want.hint("merge"), list(keys))
    near = met.select(*each, "_at", F.filter(F.arrays_zip(*RUN), lambda r: F.abs(r["y"] - F.col("_at")) <= NEAR).alias("_r")).where(F.size("_r") > 0)
    near = near.select(*each, "_at", *[F.col(f"_r.{c}").alias(c) for c in RUN])

    def ends(g: packs.Groups):
        keep, left, right = _near(g.id, *(c.astype(np.int64) for c in g.flat[1:]), g.count)
        return g.rows(keep, pa.array(left, pa.float64()), pa.array(right, pa.float64()))

    out = packs.per_group(near, [*each, "_at"], ends, [packs.double("left_x"), packs.double("right_x")])
    return out.select(*each, F.col("_at").alias("y"), "left_x", "right_x")


def _fitted(ids: np.ndarray, px: np.ndarray, py: np.ndarray, m: int, rounds: int = 4) -> tuple[np.ndarray, ...]:
    """Which of ``m`` groups have a line, slope, intercept and share of inliers (see ``robust_line``)."""
    keep, ok, slope, icpt = np.ones(len(px), bool), np.ones(m, bool), np.full(m, np.nan), np.full(m, np.nan)
    # a round on the same points as the one before gives the same line: only groups that lost or regained a point go on
    open_, at, of = np.arange(m), np.arange(len(px)), ids
    for _ in range(rounds):
        enough, slope[open_], icpt[open_], kept = _fit_round(of, px[at], py[at], keep[at], len(open_))
        ok[open_] &= enough
        moved = np.bincount(of[kept != keep[at]], minlength=len(open_)) > 0
        keep[at] = kept
        open_, at, of = open_[moved], at[moved[of]], (np.cumsum(moved) - 1)[of[moved[of]]]
        if not len(open_):
            break
    with np.errstate(invalid="ignore"):
        share = np.bincount(ids[keep], minlength=m) / np.bincount(ids, minlength=m)
    return ok, slope, icpt, share


def _fit_round(ids: np.ndarray, px: np.ndarray, py: np.ndarray, keep: np.ndarray, m: int) -> tuple[np.ndarray, ...]:
    """Which groups have points enough, the lines through their kept points, and which points lie near their line."""

    def mean(on, v):
        n = np.bincount(ids[on], minlength=m)
        with np.errstate(all="ignore"):
            return np.bincount(ids[on], weights=v[on], minlength=m) / n

    has_x, has_y = keep & ~np.isnan(px), keep & ~np.isnan(py)
    enough = np.bincount(ids[has_x], minlength=m) >= 8
    both = has_x & has_y
    cx, cy = mean(both, px), mean(both, py)
    dx, dy = px - cx[ids], py - cy[ids]
    low, high = np.full(m, np.inf), np.full(m, -np.inf)
    np.minimum.at(low, ids[both], py[both])
    np.maximum.at(high, ids[both], py[both])
    sums = [np.bincount(ids[both], weights=v[both], minlength=m) for v in (dx * dy, dy * dy)]
    with np.errstate(all="ignore"):
        slope = np.where(high > low, sums[0] / sums[1], np.nan)
    icpt = mean(has_x, px) - slope * mean(has_y, py)
    far = np.abs(px - (slope[ids] * py + icpt[ids]))
    on = keep & ~np.isnan(far)
    med = packs.quantiles(ids[on], far[on], m, 0.5)[0]
    mad = packs.quantiles(ids[on], np.abs(far - med[ids])[on], m, 0.5)[0]
    # greatest() passes over nulls: without a deviation the floors hold
    limit = np.fmax(8.0, med + 3.0 * 1.4826 * np.fmax(mad, 1.0))
    with np.errstate(invalid="ignore"):
        return enough, slope, icpt, far <= limit[ids]


def robust_line(points: DataFrame, keys: Sequence[str], x: str = "x", y: str = "y", rounds: int = 4) -> DataFrame:
    """Line x = slope * y + intercept, refitted ``rounds`` times without points far from it.

    Far means over max(8, median + 3 * 1.4826 * max(MAD, 1)).  Keys with fewer
    than 8 points, before any round, give no row.  A key's points are gathered as two arrays; all keys of a batch are fitted at once.
    """
    nan = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(float("nan")))
    packed = packs.pack(points.select(*keys, nan(x).alias("_x"), nan(y).alias("_y")), keys, ["_x", "_y"])

    def fit(g: packs.Groups):
        ok, slope, icpt, share = _fitted(g.id, *(c.astype(float) for c in g.flat), g.count, rounds)
        at = np.flatnonzero(ok)
        return g.rows(at, packs.nullable(slope[at]), packs.nullable(icpt[at]), pa.array(share[at], pa.float64()))

    return packs.per_group(packed, list(keys), fit, [packs.double(c) for c in ("slope", "intercept", "inlier_ratio")])


def _row_stats(ids: np.ndarray, y: np.ndarray, width: np.ndarray, count: int) -> tuple[np.ndarray, ...]:
    """Number of scanned rows, the rows where the quad ends and the growth of the width, per mask; NaN without a row."""
    top, bottom = packs.quantiles(ids, y, count, 0.02, 0.995, times=2)
    wide, narrow = packs.quantiles(ids, width, count, 0.85, 0.15)
    return np.bincount(ids, minlength=count), top, bottom, wide - narrow


def _measured(g: packs.Groups) -> pa.RecordBatch:
    """Scan lines, their ends, a line through either border and the borders near both ends, of the masks of one batch."""
    m = g.count
    y, x0, x1 = (c.astype(np.int64) for c in g.flat)
    mask, row, left, right = _scan(g.id, y, x0, x1, m)
    n, top, bottom, growth = _row_stats(mask, row, right - left, m)
    side = np.concatenate([mask, mask + m])
    ok, slope, icpt, share = _fitted(side, np.concatenate([left, right]), np.concatenate([row, row]).astype(float), 2 * m)
    slope, icpt, share = (np.where(ok, v, np.nan) for v in (slope, icpt, share))
    ends = []
    for target in (top, bottom):
        with np.errstate(invalid="ignore"):
            on = np.abs(y - np.rint(target)[g.id]) <= NEAR
        keep, *borders = _near(g.id[on], x0[on], x1[on], m)
        for border in borders:
            ends.append(np.full(m, np.nan))
            ends[-1][keep] = border
    lines = [v for i in (0, 1) for v in (slope[i * m : (i + 1) * m], icpt[i * m : (i + 1) * m])]
    values = [top, bottom, growth, np.fmin(share[:m], share[m:]), *lines, *ends]
    return g.rows(np.arange(m), pa.array(n, pa.int64()), pa.array(ok[:m].astype(np.int64) + ok[m:]), *map(packs.nullable, values))


def quad_from_boundaries(runs: DataFrame, sizes: DataFrame, keys: Sequence[str] = MASK, whole: bool = False) -> DataFrame:
    """Lane quad from the mask borders, or the reason there is none.

    ``sizes``: one row per mask with height and width.  Output: keys, height,
    width, polygon (null when rejected), reason (null when accepted).
    The steps of ``scanline_boundaries``, ``robust_line`` and ``boundary_near`` follow each other on the masks of a batch, so a
    mask crosses the network once, or not at all where each packed row is a ``whole`` mask, and leaves as one row.
    """
    fields = [packs.whole("_n"), packs.whole("_lines"), *map(packs.double, ("_top", "_bot", "_growth", "_inl", "_ls", "_li", "_rs", "_ri", "_tl", "_tr", "_bl", "_br"))]
    met = packs.per_group(packs.pack(packs.present(runs, keys), keys, RUN), keys, _measured, fields, whole=whole)
    j = sizes.join(met, list(keys), "left")
    on = lambda s, y: F.col(f"_{s}s") * F.col(y) + F.col(f"_{s}i")
    # a border found only on one of its two sides cannot happen: both come from the same pixels
    j = (
        j.withColumn("_tl", F.coalesce("_tl", on("l", "_top"))).withColumn("_tr", F.coalesce("_tr", on("r", "_top")))
        .withColumn("_bl", F.coalesce("_bl", on("l", "_bot"))).withColumn("_br", F.coalesce("_br", on("r", "_bot")))
    )
    wt, wb = F.col("_tr") - F.col("_tl"), F.col("_br") - F.col("_bl")
    reason = (
        F.when(F.coalesce(F.col("_n"), F.lit(0)) < 10, "dense_few_scanline_samples")
        .when(F.coalesce(F.col("_lines"), F.lit(0)) < 2, "dense_line_fit_failed")
        .when(F.col("_inl") < 0.55, "dense_low_line_inliers")
        .when(F.col("_bot") - F.col("_top") < F.col("height") * F.lit(0.045), "dense_short_y_span")
        .when((wt + wb).isNull() | F.isnan(wt + wb), "dense_nonfinite_quad")
        .when((wt <= 0) | (wb <= 0), "dense_invalid_width_order")
        .when((wb <= wt) & (F.col("_growth") > 5.0), "dense_bottom_not_wider")
    )
    hold = lambda c, n: F.least(F.greatest(F.col(c), F.lit(0.0)), F.col(n) - 1.0)
    q = G.trunc_quad(G.quad(
        (hold("_tl", "width"), hold("_top", "height")), (hold("_tr", "width"), hold("_top", "height")),
        (hold("_br", "width"), hold("_bot", "height")), (hold("_bl", "width"), hold("_bot", "height"))))
    return j.withColumn("reason", reason).select(
        *sizes.columns, F.when(F.col("reason").isNull(), q).alias("polygon"), "reason")


# ---- components ------------------------------------------------------------

def _touching(y: np.ndarray, x0: np.ndarray, x1: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of runs of one mask that touch, at least at a corner; ``sizes`` masks one after another, each in order of (y, x0)."""
    n = len(y)
    starts = np.cumsum(sizes) - sizes
    low, high = np.minimum.reduceat(y, starts), np.maximum.reduceat(y, starts)
    # one number line: a stretch for each image row of each mask, with an empty row between masks
    heights = high - low + 2
    row = y - np.repeat(low, sizes) + np.repeat(np.cumsum(heights) - heights, sizes)
    left, width = x0.min(), x1.max() - x0.min() + 4
    begin, end = row * width + (x0 - left + 1), row * width + (x1 - left + 1)
    reach = np.maximum.accumulate(end)
    side = np.flatnonzero(begin[1:] <= reach[:-1] + 1)
    # in the row below: from the first run that may still reach this one to the last that begins in time
    first, last = np.searchsorted(reach, begin + width - 1), np.searchsorted(begin, end + width + 1, side="right")
    counts = np.maximum(last - first, 0)
    above = np.repeat(np.arange(n), counts)
    below = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(first, counts)
    real = end[below] >= begin[above] + width - 1
    return np.concatenate([side, above[real]]), np.concatenate([side + 1, below[real]])


def _components(y: np.ndarray, x0: np.ndarray, x1: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The place in its mask of the first run of each run's component, for many masks at once."""
    a, b = _touching(y, x0, x1, sizes)
    label = np.arange(len(y))
    while True:
        low = np.minimum(label[a], label[b])
        open_ = (label[a] != low) | (label[b] != low)
        if not open_.any():
            break
        a, b, low = a[open_], b[open_], low[open_]  # a settled pair has one root for good
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while not np.array_equal(label, label[label]):
            label = label[label]
    return label - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _labelled(runs: DataFrame, keys: Sequence[str], keep, out: Sequence[str], packed: bool = False) -> DataFrame:
    """Runs of whole masks, in order of (y, x0), with ``component`` and ``component_area``; ``keep`` picks among the runs of many masks.

    keep: (area of each run's component, its number, first run of each mask, place of each run's mask) to flags.
    ``packed``: the runs of a mask stay one row; masks without a run go.
    """
    fields = {**{c: packs.element(runs.schema[c]) for c in RUN}, "component": T.StructField("component", T.IntegerType()), "component_area": packs.whole("component_area")}

    def labelled(g: packs.Groups):
        y, x0, x1 = (c.astype(np.int64) for c in g.flat)
        by = np.lexsort((x1, x0, y, g.id))
        ids, y, x0, x1 = g.id[by], y[by], x0[by], x1[by]
        sizes = np.bincount(ids, minlength=g.count)
        first = np.cumsum(sizes) - sizes
        label = _components(y, x0, x1, sizes)
        area = np.bincount(label + first[ids], weights=x1 - x0 + 1, minlength=len(y)).astype(np.int64)[label + first[ids]]
        on = np.flatnonzero(keep(area, label, first, ids))
        made = {**{c: packs.cast_down(v[on], fields[c].dataType) for c, v in zip(RUN, (y, x0, x1))}, "component": pa.array(label[on], pa.int32()), "component_area": pa.array(area[on])}
        if not packed:
            return g.rows(ids[on], *[made[c] for c in out])
        some, at = np.unique(ids[on], return_index=True)
        cuts = pa.array(np.append(at, len(on)), pa.int32())
        return g.rows(some, *[pa.ListArray.from_arrays(cuts, made[c]) for c in out])

    kinds = [T.StructField(c, T.ArrayType(fields[c].dataType)) if packed else fields[c] for c in out]
    return packs.per_group(packs.pack(runs, keys, RUN), keys, labelled, kinds)


def mask_components(runs: DataFrame, keys: Sequence[str] = MASK) -> DataFrame:
    """Runs with the number (place of its first run) and area of their 8-connected component.

    Grouped by mask: the runs of one mask are bounded by its image.
    """
    return _labelled(runs, keys, lambda area, label, first, ids: np.ones(len(area), bool), [*RUN, "component", "component_area"])


def significant_components(runs: DataFrame, conf: Settings = DEFAULT, keys: Sequence[str] = MASK, packed: bool = False) -> DataFrame:
    """Keep components of at least max(300, 3 % of the largest) pixels; ``packed``: one row per mask."""
    least, share = float(conf.component_min_area), conf.component_min_ratio
    return _labelled(runs, keys, lambda area, label, first, ids: area >= np.maximum(least, np.maximum.reduceat(area, first) * share)[ids], RUN, packed)


def largest_component(runs: DataFrame, keys: Sequence[str] = MASK) -> DataFrame:
    """Keep only the largest component; the topmost, leftmost one wins ties."""

    def best(area, label, first, ids):
        # a component's number is the place of its topmost, leftmost run
        top = np.where(area == np.maximum.reduceat(area, first)[ids], label, len(label))
        return label == np.minimum.reduceat(top, first)[ids]

    return _labelled(runs, keys, best, RUN)


# ---- top-down view ---------------------------------------------------------

def bev_centroid(runs: DataFrame, homographies: DataFrame, keys: Sequence[str] = MASK, on: Sequence[str] = ("shot_id",), mode: str = "warped", out_size: tuple[int, int] = (400, 800)) -> DataFrame:
    """Ball centre in the top-down view.

    ``projected`` maps the mask's centroid.  ``warped`` averages the top-down
    pixels whose source pixel is in the mask: on one top-down row, those coming
    from one run are an interval with closed-form ends, so no pixel is listed.
    """
    if mode == "projected":
        c = mask_centroid(runs, keys).join(homographies, list(on))
        return c.withColumn("_p", G.project(F.col("cx"), F.col("cy"), F.col("homography"))).where("_p is not null").select(
            *keys, F.col("_p.x").alias("bev_x"), F.col("_p.y").alias("bev_y"))
    extra = [c for c in on if c not in keys]
    hom = homographies.select(*on, F.col("homography").cast("array<double>").alias("_h"), G.inverse3(F.col("homography")).cast("array<double>").alias("_i"))
    hom = hom.where((F.size("_h") == 9) & ~F.exists(F.concat("_h", "_i"), lambda v: v.isNull()))
    met = packs.pack(runs, [*keys, *extra], RUN).join(hom, list(on)).select(*keys, *RUN, "_h", "_i")
    k, sums = len(keys), ["_u", "_v", "_n"]
    schema = T.StructType([*[met.schema[c] for c in keys], *map(packs.whole, sums)])

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            y, x0, x1 = (b.column(k + j).flatten().to_numpy().astype(np.int64) for j in range(3))
            ids = np.repeat(np.arange(b.num_rows), b.column(k).value_lengths().to_numpy())
            mats = [b.column(k + j).flatten().to_numpy().reshape(-1, 9) for j in (3, 4)]
            total = _warped_sums(ids, y, x0, x1, *mats, out_size)
            at = pa.array(np.flatnonzero(total[2]))
            yield pa.RecordBatch.from_arrays([*[b.column(j).take(at) for j in range(k)], *[pa.array(t).take(at) for t in total]], names=schema.names)

    u, v, n = (F.sum(c) for c in sums)
    return met.mapInArrow(run, schema).groupBy(*keys).agg((u / (2.0 * n)).alias("bev_x"), (v / n).alias("bev_y"))


def _warped_sums(ids: np.ndarray, y: np.ndarray, x0: np.ndarray, x1: np.ndarray, mats: np.ndarray, inverses: np.ndarray, out_size: tuple[int, int]) -> list[np.ndarray]:
    """Per packed mask: twice the sum of u, the sum of v and the count of its top-down pixels."""
    w, h = out_size

    def fwd(on, x, at):
        H = mats[ids[on]].T
        den = H[6] * x + H[7] * at + H[8]
        den = np.where(den == 0, np.nan, den)
        return (H[0] * x + H[1] * at + H[2]) / den, (H[3] * x + H[4] * at + H[5]) / den

    every = np.arange(len(y))
    total = [np.zeros(len(mats), np.int64) for _ in range(3)]
    with np.errstate(all="ignore"):
        ends = [fwd(every, x + dx, y + dy)[1] for x, dx in ((x0, -0.5), (x1, 0.5)) for dy in (-0.5, 0.5)]
        low, high = np.floor(np.fmin.reduce(ends)), np.ceil(np.fmax.reduce(ends))
        seen = np.flatnonzero((high >= 0) & (low <= h - 1))
        first, last = (np.clip(c[seen], 0, h - 1).astype(np.int64) for c in (low, high))
        many = last - first + 1
        # top-down rows of at most so many at once
        part = np.cumsum(many) // (1 << 18)
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(seen)]
        for i, j in zip(cuts, cuts[1:]):
            size = many[i:j]
            r = np.repeat(seen[i:j], size)
            v = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first[i:j], size)
            inv = inverses[ids[r]].T
            mu, mv = fwd(r, (x0[r] + x1[r]) / 2.0, y[r].astype(float))
            side = np.sign(inv[6] * mu + inv[7] * mv + inv[8])
            den = inv[6], inv[7] * v + inv[8]
            lo, hi, fine = np.zeros(len(r)), np.full(len(r), w - 1.0), ~np.isnan(side)
            # source pixel conditions as a*u + b >= 0 (the upper ones strict), linear in u on one top-down row
            sx, sy = (inv[0], inv[1] * v + inv[2]), (inv[3], inv[4] * v + inv[5])
            for num, at, strict in ((sx, x0[r] - 0.5, False), (sx, x1[r] + 0.5, True), (sy, y[r] - 0.5, False), (sy, y[r] + 0.5, True)):
                sign = -side if strict else side
                a, b = sign * (num[0] - at * den[0]), sign * (num[1] - at * den[1])
                cut_at = -b / a
                lo = np.where(a > 0, np.fmax(lo, np.floor(cut_at) + 1 if strict else np.ceil(cut_at)), lo)
                hi = np.where(a < 0, np.fmin(hi, np.ceil(cut_at) - 1 if strict else np.floor(cut_at)), hi)
                fine &= (a != 0) | (b > 0 if strict else b >= 0)
            on = np.flatnonzero(fine & (lo <= hi))
            lo, hi, of = lo[on].astype(np.int64), hi[on].astype(np.int64), ids[r[on]]
            for t, c in zip(total, ((lo + hi) * (hi - lo + 1), v[on] * (hi - lo + 1), hi - lo + 1)):
                np.add.at(t, of, c)
    return total
