"""Hard negatives through a multiway hyperplane tree (GNAT).

Scores are integer inner products.  With one coordinate more, that lifts every stored vector to the length of the longest,
a score is a distance: |a - x|^2 = |a|^2 + R^2 - 2 a.x, so "score in a window" is a ring around the anchor.

1. Tree.  A node has up to ``DEGREE`` split points, chosen far apart from a bounded sample (``SAMPLE`` rows and ``SAMPLE_BYTES`` at most);
   a vector belongs to the nearest one.  The sample only places the split points: every row is descended to its leaf, and each split
   point's least and largest distance to every sibling subtree is taken over all rows (a map-side minimum and maximum).
2. Pruning.  A subtree goes if, for some split point, its range of distances misses what the anchor's ring allows by the
   triangle inequality.  It needs no estimate, so the result is exact; rounding is met by a small allowance.
3. Leaves.  Members of a leaf (in chunks of ``CHUNK`` where it is large, so repeated vectors spread over tasks) meet the anchors that reach
   it, in blocks, by exact integer products.  Each pair of leaf chunk and anchor gives at most as many rows as are asked for.
4. Rings.  An anchor first searches its own leaf; what it finds there narrows the ring for the other leaves.  So done for
   the positives (the best of the same label), and then, with the positives' scores as windows, for the negatives.

Defined cases: rows with a null id, label or vector, or with a null or non-finite component, take no part; a shorter vector counts
as filled up with zeros; repeated rows are rows of their own (a row is only left out for itself, by its place); an anchor row that
occurs twice gives its rows twice; ties go to the smaller id; an empty table gives an empty result; other columns are not read.
Products are exact while they fit in 63 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shotlane.session import cut

POSITIVES, NEGATIVES, EVERY = 5, 10, 100
#: Percent of the positive's score that a negative's must lie between.
LOW, HIGH = 30, 90
DEGREE, SAMPLE, SAMPLE_BYTES, LEAF, CHUNK, AT_ONCE = 16, 20_000, 64 << 20, 2048, 8192, 1 << 22


def taking_part(emb: DataFrame, label: Column) -> DataFrame:
    """uid, vec_id, label, v (floor(256 * x)) of every row that takes part."""
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    held = emb.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(sound, F.lit(False)))
    scaled = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("bigint"))
    return held.select(F.monotonically_increasing_id().alias("uid"), F.col("vec_id").cast("long").alias("vec_id"), label.cast("int").alias("label"), scaled.alias("v"))


@dataclass
class Node:
    """Split points (a row each, with the lifting coordinate last), the children, and the ranges low[i, j], high[i, j] of distances from point i to subtree j."""

    points: np.ndarray
    children: list["Node | int"] = field(default_factory=list)
    low: np.ndarray | None = None
    high: np.ndarray | None = None
    number: int = 0


class Tree:
    def __init__(self, sample: np.ndarray, radius2: float, most: float):
        self.radius2, self.dim, self.leaves, self.nodes = radius2, sample.shape[1], 0, []
        self.root = self._grow(self.lifted(sample), most)

    def lifted(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([x, np.sqrt(np.maximum(self.radius2 - (x * x).sum(axis=1), 0))[:, None]])

    def _grow(self, x: np.ndarray, most: float) -> "Node | int":
        at = _far_apart(x, DEGREE) if len(x) > most else []
        if len(at) < 2:
            self.leaves += 1
            return self.leaves - 1
        node = Node(x[at], number=len(self.nodes))
        self.nodes.append(node)
        own = _distances(x, node.points, self.radius2).argmin(axis=1)
        node.children = [self._grow(x[own == j], most) for j in range(len(at))]
        node.low, node.high = np.full((len(at), len(at)), np.inf), np.full((len(at), len(at)), -np.inf)
        return node

    def leaf_of(self, v: np.ndarray, saw=lambda node, own, d: None) -> np.ndarray:
        """Each vector's leaf; ``saw`` gets every node passed, with the distances to its split points."""
        x, out = self.lifted(v), np.zeros(len(v), np.int64)
        todo = [(self.root, np.arange(len(v)))]
        while todo:
            node, rows = todo.pop()
            if isinstance(node, int):
                out[rows] = node
                continue
            d = _distances(x[rows], node.points, self.radius2)
            own = d.argmin(axis=1)
            saw(node, own, d)
            todo += [(child, rows[own == j]) for j, child in enumerate(node.children) if (own == j).any()]
        return out

    def reached(self, a: np.ndarray, least: np.ndarray, most: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, rows of ``a``) wherever a leaf may hold a score within one of the row's windows [least, most] (a column each, least > most: none)."""
        square = (a * a).sum(axis=1) + self.radius2
        slack = 1e-6 * np.sqrt(square + 1)
        with np.errstate(invalid="ignore"):
            far = np.sqrt(np.maximum(square[:, None] - 2 * least, 0)) + slack[:, None]
            close = np.sqrt(np.maximum(square[:, None] - 2 * most, 0)) - slack[:, None]
        far[least > most] = -np.inf
        todo = [(self.root, np.flatnonzero((least <= most).any(axis=1)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if isinstance(node, int):
                yield node, rows
                continue
            d = np.sqrt(np.maximum(square[rows, None] - 2 * a[rows] @ node.points[:, :-1].T, 0))
            may = np.zeros((len(rows), len(node.children)), bool)
            for w in range(least.shape[1]):
                f, c = far[rows, w][:, None, None], close[rows, w][:, None, None]
                low, high, at = node.low[None], node.high[None], d[:, :, None]
                may |= ((low <= at + f) & (high >= at - f) & (high + at >= c)).all(axis=1)
            todo += [(child, rows[may[:, j]]) for j, child in enumerate(node.children)]


def _distances(x: np.ndarray, points: np.ndarray, radius2: float) -> np.ndarray:
    return np.sqrt(np.maximum(2 * radius2 - 2 * x @ points.T, 0))


def _far_apart(x: np.ndarray, n: int) -> list[int]:
    """Up to ``n`` different rows, each the farthest from those before it (of at most 4,096 rows spread over ``x``)."""
    some = np.unique(np.linspace(0, len(x) - 1, min(len(x), 4096)).astype(np.int64))
    found, near = [int(some[0])], np.full(len(some), np.inf)
    while len(found) < n:
        near = np.minimum(near, ((x[some] - x[found[-1]]) ** 2).sum(axis=1))
        if near.max() <= 1e-9:
            break
        found.append(int(some[near.argmax()]))
    return found


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors as rows of float64, short ones filled with zeros."""
    ends = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(ends)
    if len(sizes) and (sizes == dim).all():
        return flat[ends[0] : ends[-1]].astype(float).reshape(-1, dim)
    out = np.zeros((len(sizes), dim))
    for i, (a, b) in enumerate(zip(ends, ends[1:])):
        out[i, : b - a] = flat[a:b]
    return out


def fit(rows: DataFrame, leaf: int = LEAF, sample: int = SAMPLE) -> Tree | None:
    """The tree with the ranges of all rows; None for an empty table."""
    square = F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x)
    total, longest, dim = rows.agg(F.count("*"), F.max(square), F.max(F.size("v"))).first()
    if not total:
        return None
    dim = max(1, dim)
    share = min(1.0, min(sample, SAMPLE_BYTES // (8 * dim)) / total)
    some = rows.filter(F.pmod(F.xxhash64("uid"), F.lit(1 << 30)) < int(share * (1 << 30))) if share < 1 else rows
    taken = some.select("uid", "v").toArrow()
    order = np.argsort(taken["uid"].to_numpy())
    v = matrix(taken["v"].combine_chunks(), dim)[order]
    tree = Tree(v, float(longest or 0), max(2.0, leaf * share))

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = [n.low.copy() for n in tree.nodes]
        high = [n.high.copy() for n in tree.nodes]

        def saw(node: Node, own: np.ndarray, d: np.ndarray) -> None:
            for j in np.unique(own):
                low[node.number][:, j] = np.minimum(low[node.number][:, j], d[own == j].min(axis=0))
                high[node.number][:, j] = np.maximum(high[node.number][:, j], d[own == j].max(axis=0))

        for batch in batches:
            tree.leaf_of(matrix(batch.column(0), dim), saw)
        for k, (a, b) in enumerate(zip(low, high)):
            i, j = np.nonzero(a <= b)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), k)), pa.array(i), pa.array(j), pa.array(a[i, j]), pa.array(b[i, j])], names=["node", "i", "j", "low", "high"])

    seen = rows.select("v").mapInArrow(ranges, "node bigint, i bigint, j bigint, low double, high double")
    # a row for each pair of split points of a node: bounded by the sample, whatever the data
    for r in seen.groupBy("node", "i", "j").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():
        tree.nodes[r.node].low[r.i, r.j], tree.nodes[r.node].high[r.i, r.j] = r.low, r.high
    return tree


def in_leaves(rows: DataFrame, tree: Tree) -> DataFrame:
    """``rows`` (uid, vec_id, label, v) plus leaf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = tree.leaf_of(matrix(batch.column(3), tree.dim))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], names=["uid", "vec_id", "label", "v", "leaf"])

    return rows.mapInArrow(run, "uid bigint, vec_id bigint, label int, v array<bigint>, leaf bigint")


ASKING = "uid bigint, label int, v array<bigint>, leaf bigint, least array<bigint>, most array<bigint>"
_FREE = (1 << 62) - 1


def _elsewhere(tree: Tree):
    """The asking rows once for every leaf but their own that a window of theirs may reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least, most = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            width = max(map(len, least), default=0)
            lo, hi = np.full((len(least), width), 1.0), np.full((len(least), width), 0.0)
            for i, (a, b) in enumerate(zip(least, most)):
                lo[i, : len(a)], hi[i, : len(b)] = a, b
            own = batch.column(3).to_numpy()
            for leaf, rows in tree.reached(matrix(batch.column(2), tree.dim), lo, hi):
                rows = rows[own[rows] != leaf]
                if len(rows):
                    part = batch.take(pa.array(rows))
                    yield part.set_column(3, "leaf", pa.array(np.full(len(rows), leaf)))

    return run


FOUND = "uid bigint, slot int, found_uid bigint, found_id bigint, score bigint"


def _search(dim: int, same_label: bool, most_rows: int):
    """Best rows of a bucket for every asking row and window; rows come sorted by bucket and role."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, parts, ready = None, [], None
        for batch in batches:
            buckets, roles = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = np.flatnonzero((np.diff(buckets) != 0) | (np.diff(roles) != 0)) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(buckets)]):
                if a == b:
                    continue
                piece = batch.slice(a, b - a)
                if buckets[a] != bucket:
                    bucket, parts, ready = buckets[a], [], None
                if roles[a] == 0:
                    parts.append(piece)
                    continue
                if ready is None:
                    ready = _members(parts, dim)
                if ready is not None:
                    yield _best(ready, piece, dim, same_label, most_rows)

    return run


def _members(parts: list[pa.RecordBatch], dim: int):
    if not parts:
        return None
    uid, vec_id, label = (np.concatenate([p.column(k).to_numpy() for p in parts]) for k in (2, 3, 4))
    v = np.concatenate([matrix(p.column(5), dim) for p in parts])
    order = np.argsort(vec_id, kind="stable")  # by id, so that a stable sort by score settles ties
    return uid[order], vec_id[order], label[order], v[order]


def _products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact integer products: floats hold them up to 2^53."""
    if float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * q.shape[1] < 2**53:
        return (q @ v.T).astype(np.int64)
    return q.astype(np.int64) @ v.astype(np.int64).T


def _best(members, asking: pa.RecordBatch, dim: int, same_label: bool, most_rows: int) -> pa.RecordBatch:
    uid, vec_id, label, v = members
    own, own_label, q = asking.column(2).to_numpy(), asking.column(4).to_numpy(), matrix(asking.column(5), dim)
    least, most = asking.column(6).to_pylist(), asking.column(7).to_pylist()
    out = [[], [], [], []]
    step = max(1, AT_ONCE // max(1, len(v)))
    for a in range(0, len(q), step):
        scores = _products(q[a : a + step], v)
        for i, s in enumerate(scores, a):
            fits = (label == own_label[i]) & (uid != own[i]) if same_label else label != own_label[i]
            for slot, (lo, hi) in enumerate(zip(least[i], most[i])):
                at = np.flatnonzero(fits & (s >= lo) & (s <= hi))
                if len(at) > most_rows:
                    edge = np.partition(s[at], len(at) - most_rows)[len(at) - most_rows]
                    at = at[s[at] >= edge]
                at = at[np.argsort(-s[at], kind="stable")][:most_rows]
                for column, x in zip(out, (np.full(len(at), own[i]), np.full(len(at), slot, np.int32), at, s[at])):
                    column.append(x)
    who, slots, at, s = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)
    at = at.astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(who), pa.array(slots.astype(np.int32)), pa.array(uid[at]), pa.array(vec_id[at]), pa.array(s)], names=["uid", "slot", "found_uid", "found_id", "score"])


class Index:
    """All rows in the leaves of a fitted tree."""

    def __init__(self, rows: DataFrame, tree: Tree, chunk: int = CHUNK):
        spark = rows.sparkSession
        self.tree, self.rows = tree, cut(in_leaves(rows, tree), "leaves")
        self.parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        sizes = self.rows.groupBy("leaf").agg(F.ceil(F.count("*") / chunk).cast("int").alias("chunks"))
        self.chunks = F.broadcast(cut(sizes, "leaf-chunks"))  # one row of a leaf, bounded by the sample

    def search(self, asking: DataFrame, same_label: bool, most_rows: int) -> DataFrame:
        """uid, slot, found_uid, found_id, score: the best rows of the asked leaf, per chunk of it."""
        bucket = lambda at: (F.col("leaf") * (1 << 24) + at).alias("bucket")
        none = F.lit(None).cast("array<bigint>")
        data = self.rows.join(self.chunks, "leaf").select(bucket(F.pmod(F.xxhash64("uid"), F.col("chunks"))), F.lit(0).alias("role"), "uid", "vec_id", "label", "v", none.alias("least"), none.alias("most"))
        each = asking.join(self.chunks, "leaf").withColumn("at", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        asked = each.select(bucket(F.col("at")), F.lit(1).alias("role"), "uid", F.lit(None).cast("long").alias("vec_id"), "label", "v", "least", "most")
        met = data.unionByName(asked).repartition(self.parts, "bucket").sortWithinPartitions("bucket", "role")
        return met.mapInArrow(_search(self.tree.dim, same_label, most_rows), FOUND)

    def best(self, asking: DataFrame, same_label: bool, most_rows: int, label: str) -> DataFrame:
        """uid, slot, found_uid, found_id, score, rank: the best rows overall, at most ``most_rows`` of a slot; ``asking`` as in ``ASKING``."""
        rank = F.row_number().over(Window.partitionBy("uid", "slot").orderBy(F.desc("score"), "found_id", "found_uid"))
        top = lambda df: df.withColumn("rank", rank).filter(F.col("rank") <= most_rows)
        own = cut(top(self.search(asking, same_label, most_rows)), f"{label}-own-leaf")
        # a full slot raises the least score that still matters elsewhere
        full = own.groupBy("uid", "slot").agg(F.count("*").alias("n"), F.min("score").alias("edge")).filter(F.col("n") == most_rows)
        edges = full.groupBy("uid").agg(F.map_from_entries(F.collect_list(F.struct("slot", "edge"))).alias("edges"))
        raised = F.transform("least", lambda x, i: F.greatest(x, F.coalesce(F.element_at("edges", i.cast("int")), x)))
        narrowed = asking.join(edges, "uid", "left").select("uid", "label", "v", "leaf", raised.alias("least"), "most")
        rest = narrowed.mapInArrow(_elsewhere(self.tree), ASKING)
        return cut(top(own.drop("rank").unionByName(self.search(rest, same_label, most_rows))), label)


def mine(rows: DataFrame, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, leaf: int = LEAF, chunk: int = CHUNK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; ``rows`` as of ``taking_part``.

    Anchors are the rows whose id ``every`` divides.  A negative's score is between ``low`` and ``high`` percent of the positive's.
    """
    rows = cut(rows, "vectors")
    tree = fit(rows, leaf)
    if tree is None:
        return rows.select(*[F.lit(None).cast("long").alias(c) for c in ("anchor_id", "positive_id")], F.lit(None).cast("int").alias("rank"), *[F.lit(None).cast("long").alias(c) for c in ("negative_id", "positive_score", "negative_score")])
    index = Index(rows, tree, chunk)
    anchors = index.rows.filter(F.col("vec_id") % every == 0)
    asking = anchors.select("uid", "label", "v", "leaf", F.array(F.lit(-_FREE)).alias("least"), F.array(F.lit(_FREE)).alias("most"))
    found = index.best(asking, True, positives, "positives")
    # a window of scores for each positive, in the order of rank: slot = rank - 1
    wins = found.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("p"))
    least = F.transform("p.score", lambda s: F.ceil(s * low / F.lit(100).cast("decimal(3,0)")).cast("long"))
    most = F.transform("p.score", lambda s: F.floor(s * high / F.lit(100).cast("decimal(3,0)")).cast("long"))
    asking = anchors.select("uid", "label", "v", "leaf").join(wins, "uid").select("uid", "label", "v", "leaf", least.alias("least"), most.alias("most"))
    hard = index.best(cut(asking, "windows"), False, negatives, "negatives")
    pos = found.select("uid", (F.col("rank") - 1).alias("slot"), F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = hard.join(pos, ["uid", "slot"]).join(anchors.select("uid", F.col("vec_id").alias("anchor_id")), "uid")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("found_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
