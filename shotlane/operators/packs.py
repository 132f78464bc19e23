"""Rows of a key as arrays: packed where they lie, gathered per key in one exchange, worked on in numpy batch by batch.

A mask of forty runs crosses the network as one row instead of forty or eighty, and a task holds the groups of one Arrow
batch, never all rows of its partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Elements that a task holds of one open group before ``shrink`` is asked to reduce it.
OPEN = 1 << 20


def starts(batch: pa.RecordBatch, columns: int) -> np.ndarray:
    """Where one of the first columns changes, the first row included; nulls are equal."""
    n = batch.num_rows
    differ = np.zeros(max(0, n - 1), dtype=bool)
    for i in range(columns):
        c = batch.column(i)
        one, two = c.slice(0, max(0, n - 1)), c.slice(1)
        gap = pc.not_equal(pc.is_null(one), pc.is_null(two))
        differ |= pc.if_else(pc.or_(pc.is_null(one), pc.is_null(two)), gap, pc.not_equal(one, two)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(np.append(n > 0, differ)).astype(np.int64)


def present(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows without a null among the columns; NaN is a value."""
    return reduce(lambda rows, c: rows.where(F.col(c).isNotNull()), columns, df)


def element(field: T.StructField) -> T.StructField:
    """The field of one element of a packed column; a plain column's is its own."""
    return T.StructField(field.name, field.dataType.elementType) if isinstance(field.dataType, T.ArrayType) else field


def pack(df: DataFrame, keys: Sequence[str], columns: Sequence[str], nulls: bool = False) -> DataFrame:
    """Neighbouring rows of the same keys as one row with an array per column; a key may come in several such rows.

    Rows with a null among the columns hold nothing and go, unless ``nulls``.  Rows that are packed already stay as they are.
    """
    k, names = len(keys), [*keys, *columns]
    if all(isinstance(df.schema[c].dataType, T.ArrayType) for c in columns):
        return df.select(*names)
    rows = df.select(*names) if nulls else present(df.select(*names), columns)
    schema = T.StructType([*[rows.schema[c] for c in keys], *[T.StructField(c, T.ArrayType(rows.schema[c].dataType)) for c in columns]])

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            at = starts(b, k)
            cuts = pa.array(np.append(at, b.num_rows), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*[b.column(i).take(pa.array(at)) for i in range(k)], *[pa.ListArray.from_arrays(cuts, b.column(k + j)) for j in range(len(columns))]], names=names)

    return rows.mapInArrow(run, schema)


class Groups:
    """Whole groups: ``keys`` (one Arrow array per key column), ``id`` (the group of each element), ``count`` groups, ``flat`` (numpy array per column)."""

    def __init__(self, batch: pa.RecordBatch, k: int):
        at = starts(batch, k)
        self.count, self.batch, self.k = len(at), batch, k
        self.keys = [batch.column(i).take(pa.array(at)) for i in range(k)]
        lists = [batch.column(i) for i in range(k, batch.num_columns)]
        lengths = lists[0].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        self.id = np.repeat(np.repeat(np.arange(self.count), np.diff(np.append(at, batch.num_rows))), lengths)
        self.flat = [c.flatten().to_numpy(zero_copy_only=False) for c in lists]

    def rows(self, of: np.ndarray, *values: pa.Array) -> pa.RecordBatch:
        """Rows with the keys of the groups ``of``, then the values."""
        columns = [*[c.take(pa.array(of)) for c in self.keys], *values]
        return pa.RecordBatch.from_arrays(columns, names=[f"c{i}" for i in range(len(columns))])

    def repacked(self, of: np.ndarray, *values: np.ndarray) -> pa.RecordBatch:
        """The groups in packed form again, with these elements (in order of their groups)."""
        cuts = pa.array(np.searchsorted(of, np.arange(self.count + 1)), pa.int32())
        kinds = [self.batch.schema.field(self.k + j).type.value_type for j in range(len(values))]
        columns = [*self.keys, *[pa.ListArray.from_arrays(cuts, pa.array(v, t)) for v, t in zip(values, kinds)]]
        return pa.RecordBatch.from_arrays(columns, names=self.batch.schema.names)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def _elements(batch: pa.RecordBatch) -> int:
    return len(batch.column(batch.num_columns - 1).flatten())


def whole_groups(batches: Iterator[pa.RecordBatch], k: int, shrink: Callable[[Groups], pa.RecordBatch] | None = None) -> Iterator[Groups]:
    """The groups of packed rows that come sorted by their first ``k`` columns; the last group of a batch waits for the next one.

    ``shrink`` reduces a group that stays open over many rows, so that not even the partial results of a huge group are held.
    """
    held: list[pa.RecordBatch] = []
    size = most = 0
    for b in batches:
        if not b.num_rows:
            continue
        if held:
            at = starts(_joined([held[-1].slice(held[-1].num_rows - 1), b]), k)
            first = int(at[at > 0][0]) - 1 if (at > 0).any() else b.num_rows  # rows that still belong to the open group
        else:
            first = 0
        if first:
            held.append(b.slice(0, first))
            size += _elements(held[-1])
            if shrink is not None and size > max(OPEN, 2 * most):
                held = [shrink(Groups(_joined(held), k))]
                size = most = _elements(held[0])
        if first < b.num_rows:
            if held:
                yield Groups(_joined(held), k)
            rest = b.slice(first)
            last = int(starts(rest, k)[-1])
            if last:
                yield Groups(rest.slice(0, last), k)
            held, most = [rest.slice(last)], 0
            size = _elements(held[0])
    if held:
        yield Groups(_joined(held), k)


def per_group(packed: DataFrame, keys: Sequence[str], fn: Callable[[Groups], pa.RecordBatch], fields: Sequence[T.StructField], shrink: Callable[[Groups], pa.RecordBatch] | None = None, whole: bool = False) -> DataFrame:
    """``fn`` over the whole groups of packed rows: keys and ``fields``.  One exchange, sorted by key; none where every row is a ``whole`` group."""
    k = len(keys)
    schema = T.StructType([*[packed.schema[c] for c in keys], *fields])

    def run(batches):
        for g in whole_groups(batches, k, shrink):
            out = fn(g)
            if out.num_rows:
                yield out.rename_columns(schema.names)

    return (packed if whole else packed.repartition(*keys).sortWithinPartitions(*keys)).mapInArrow(run, schema)


def per_row(rows: DataFrame, keys: Sequence[str], fn: Callable[[pa.RecordBatch], list[pa.Array]], fields: Sequence[T.StructField]) -> DataFrame:
    """``fn`` over the batches as they lie, one value per row for each of ``fields``: keys and ``fields``."""
    k = len(keys)
    schema = T.StructType([*[rows.schema[c] for c in keys], *fields])

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(k)], *fn(b)], names=schema.names)

    return rows.mapInArrow(run, schema)


# ---- numbers of many groups at once ------------------------------------------

def order_by(major: np.ndarray, minor: np.ndarray) -> np.ndarray:
    """Order by two columns of whole numbers."""
    if not len(major):
        return np.zeros(0, np.int64)
    low, width = int(minor.min()), int(minor.max()) - int(minor.min()) + 1
    if (int(major.max()) - int(major.min()) + 1) * width < 1 << 62:
        return np.argsort((major - major.min()).astype(np.int64) * width + (minor - low), kind="stable")
    return np.lexsort((minor, major))


def _sorted(group: np.ndarray, values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The values of each group in order, group after group; NaN comes last."""
    if sizes.size * int(sizes.max(initial=0)) > 4 * len(values) + (1 << 16):
        return values[np.lexsort((values, group))]
    if (np.diff(group) < 0).any():
        values = values[np.argsort(group, kind="stable")]
    # groups of about one size are the rows of a table
    inside = np.arange(sizes.max(initial=0)) < sizes[:, None]
    table = np.full(inside.shape, np.nan)
    table[inside] = values
    table.sort(axis=1)
    return table[inside]


def quantiles(group: np.ndarray, values: np.ndarray, count: int, *shares: float, times: int = 1) -> list[np.ndarray]:
    """Interpolated quantiles of the values of each group, each value counted ``times``; NaN for a group without values."""
    n = np.bincount(group, minlength=count)
    v = _sorted(group, values.astype(float), n)
    base = np.cumsum(n) - n
    out = []
    for q in shares:
        at = q * (n * times - 1.0)
        low, high = np.floor(at), np.ceil(at)
        pick = lambda p: v[np.minimum(base + np.maximum(p, 0).astype(np.int64) // times, max(len(v) - 1, 0))] if len(v) else np.zeros(count)
        a, b = pick(low), pick(high)
        out.append(np.where(n > 0, a + (b - a) * (at - low), np.nan))
    return out


def nullable(values: np.ndarray) -> pa.Array:
    """Doubles with null for NaN."""
    return pa.array(values, pa.float64(), mask=np.isnan(values))


def double(name: str) -> T.StructField:
    return T.StructField(name, T.DoubleType())


def whole(name: str) -> T.StructField:
    return T.StructField(name, T.LongType())


def cast_down(values: np.ndarray, like: T.DataType) -> pa.Array:
    """Whole numbers in the column type they came in."""
    return pa.array(values.astype(np.int64)).cast({T.IntegerType: pa.int32(), T.LongType: pa.int64(), T.ShortType: pa.int16(), T.ByteType: pa.int8()}.get(type(like), pa.float64()))


__all__ = ["Groups", "cast_down", "double", "element", "nullable", "order_by", "pack", "per_group", "per_row", "present", "quantiles", "starts", "whole", "whole_groups"]
