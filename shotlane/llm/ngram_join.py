"""N-gram Jaccard join with a prefix tree.

A document's set is its distinct 4-word shingles (64-bit hashes).  Two sets link when 100 * intersection >= 85 * union.

1. Equal sets are one node.  A first pass drops sets that can have no partner: with f = floor(0.15 * size), the 2f + 1
   smallest hashes of a set with a partner hold at most 2f - floor(0.15 * ceil(0.85 * size)) that no other set has there.
   It is a count per hash (its first 40 bits) with map-side combine, and leaves near copies and texts made of shared passages.
2. The rest are ordered globally, rare shingles first (document frequency, then hash).  Linked sets share one of their first
   f + 1 shingles; sets that share one are joined into blocks (connected components), so every link lies inside a block
   and every set is sent to one task once.
3. A block's sets, frequent shingles first, make a trie; shingles that no other set of the block has are only counted.  Each set
   descends it once: the overlap of a shared path is computed once for all sets below, a subtree ends where the overlap plus
   what may remain cannot reach the least overlap of its sizes, and also where all its sets are already in the asking set's component, since
   a link more would not change the result.  Every link is checked on the exact overlap.
4. A block of more than ``BLOCK`` shingles is not sent to one task: its sets go by shared shingle (one of the shingles with the same sets), and where such a group is
   too large as well, by pairs of chunks of it, so tasks stay bounded and no pair is lost; links are then joined by components.

Defined cases: fewer than four words make one shingle; null, empty and blank texts have an empty set, linked with nothing, and
are their own component; repeated rows are one node; a null doc_id never names a component unless all its ids are null; no other column is read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField

from shotlane.llm import words as W
from shotlane.llm.common import K1, K2, components, map_text, row_key
from shotlane.session import cut

SHINGLE, PERCENT = 4, 85
#: Shingles of a block that one task may hold.
BLOCK = 2_000_000
#: Bits of the bitmap that spares the shuffle texts without a partner.
MARKS = 1 << 23
#: Bits of a hash that the first pass does without: 40 are enough to tell hashes apart, and a chance meeting only keeps a set.
SPARED = 24
_U = np.uint64
#: All bytes but blank and those from \x09 to \x0D.
INSIDE = np.ones(256, dtype=bool)
INSIDE[[9, 10, 11, 12, 13, 32]] = False


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, one after the other, and the bounds of each text."""
    w = W.split(texts, INSIDE)
    h, counts = w.hashes(), w.counts()
    bounds = np.concatenate([[0], np.cumsum(counts)])
    # a shingle's hash is a mix of its words' hashes, each times its place's factor; a short text's words are all in one
    places = [_U(W.BASE), _U(pow(W.BASE, 3, 1 << 64)), _U(pow(W.BASE, 5, 1 << 64)), _U(pow(W.BASE, 7, 1 << 64))]
    total = h * places[0]
    for k in range(1, SHINGLE):
        total[:-k] += h[k:] * places[k]
    last = np.repeat(bounds[1:], counts)
    full = np.arange(len(h)) + SHINGLE <= last
    rows = w.row[full]
    found = W.mixed(total[full])
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    if len(short):
        first = bounds[short]
        sums = np.zeros(len(short), _U)
        for k in range(SHINGLE - 1):
            there = counts[short] > k
            sums[there] += h[first[there] + k] * places[k]
        rows, found = np.concatenate([rows, short]), np.concatenate([found, W.mixed(sums + _U(1) + counts[short].astype(_U))])
    found = found.view(np.int64)
    order = np.lexsort((found, rows))
    rows, found = rows[order], found[order]
    new = np.ones(len(found), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (found[1:] != found[:-1])
    rows, found = rows[new], found[new]
    return found, np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(counts)))])


def _set_ids(found: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A set's id: a hash of its sorted shingles; null for the empty set."""
    ids = [int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(found[a:b].tobytes())))) if b > a else None for a, b in zip(bounds, bounds[1:])]
    return pa.array(ids, pa.int64())


def _lists(found: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(sizes)])
    at = np.arange(ends[-1]) - np.repeat(ends[:-1], sizes) + np.repeat(starts, sizes)
    return pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(found[at])).cast(pa.list_(pa.int64()))


def _prefix_step():
    def step(texts: pa.Array) -> list:
        found, bounds = shingle_sets(texts)
        sizes = np.diff(bounds)
        return [_set_ids(found, bounds), pa.array(sizes), _lists(found, bounds[:-1], np.minimum(sizes, 2 * (sizes * (100 - PERCENT) // 100) + 1))]

    return step


def _set_step():
    def step(texts: pa.Array) -> list:
        found, bounds = shingle_sets(texts)
        return [_set_ids(found, bounds), pa.array(np.diff(bounds)), _lists(found, bounds[:-1], np.diff(bounds))]

    return step


def _spare(n: Column) -> Column:
    """Shingles of a set of n that a partner may lack."""
    return F.floor(n * (100 - PERCENT) / 100)


def set_rows(docs: DataFrame) -> DataFrame:
    """doc_id, row key, fp (set id, null for the empty set), n_shingles and the smallest hashes of every row."""
    fields = [StructField("fp", LongType()), StructField("n_shingles", LongType()), StructField("low", ArrayType(LongType()))]
    return map_text(docs.select("doc_id", "text", *row_key()), ["doc_id", K1, K2], fields, _prefix_step)


def with_partner(rows: DataFrame) -> DataFrame:
    """fp, n and the row key of one text of every set that may have a partner; rows as of ``set_rows``."""
    heads = rows.filter("fp IS NOT NULL")
    seen = heads.select("fp", F.explode("low").alias("t")).select("fp", F.shiftleft(F.shiftright("t", SPARED), SPARED).alias("t")).groupBy("t").agg(F.min("fp").alias("fp"), F.max("fp").alias("other"))
    alone = seen.filter("fp = other").groupBy("fp").agg(F.count("*").alias("alone"))
    sets = heads.groupBy("fp").agg(F.min("n_shingles").alias("n"), F.min(F.struct(K1, K2)).alias("k"))
    n = F.col("n")
    most = 2 * _spare(n) - _spare(F.ceil(n * PERCENT / 100))
    return sets.join(alone, "fp", "left").filter(F.coalesce("alone", F.lit(0)) <= most).select("fp", "n", F.col("k")[K1].alias(K1), F.col("k")[K2].alias(K2))


def _marked(wanted: DataFrame) -> DataFrame:
    """(bucket, bits): a bitmap of ``MARKS`` bits at most with a bit for each wanted row key; it only spares the shuffle rows, the join decides."""
    place = F.pmod(F.col(K1), F.lit(MARKS))
    return wanted.select(F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))


def _wanted_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """text and row key of the rows whose key is in ``wanted``; texts that a bitmap of the keys rules out are not shuffled."""
    place = F.pmod(F.col(K1), F.lit(MARKS))
    held = docs.select("text", *row_key()).withColumns({"bucket": F.bitmap_bucket_number(place), "bit": F.bitmap_bit_position(place)})
    marked = F.broadcast(cut(_marked(wanted), "marks"))  # MARKS / 32,768 rows of 4 KB, whatever the data
    byte = F.conv(F.hex(F.substring(F.col("bits"), (F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    held = held.join(marked, "bucket").filter(F.getbit(byte, F.col("bit") % 8) == 1)
    # an inner join (keys are unique in ``wanted``): a semi join would be moved below the bitmap
    return held.select("text", K1, K2).join(wanted.select(K1, K2), [K1, K2])


def ordered_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """fp, n, df and t (shingles that other sets have too, rare first), and prefix, how many of them are among the set's first f + 1."""
    texts = _wanted_texts(docs, wanted)
    fields = [StructField("fp", LongType()), StructField("n", LongType()), StructField("t", ArrayType(LongType()))]
    sets = cut(map_text(texts, [], fields, _set_step), "ngram-sets")
    if sets.count() > wanted.count():  # a row of the document table that is repeated whole
        sets = cut(sets.dropDuplicates(["fp"]), "ngram-sets-once")
    each = sets.select("fp", F.explode("t").alias("t"))
    df = each.groupBy("t").agg(F.count("*").alias("df")).filter("df > 1")
    # a set is one document's; two lists of plain numbers are less to shuffle than one of structs
    shared = each.join(df, "t").groupBy("fp").agg(F.collect_list("df").alias("df"), F.collect_list("t").alias("t"))
    shared = shared.select("fp", F.sort_array(F.arrays_zip("df", "t")).alias("s")).join(sets.select("fp", "n"), "fp")
    prefix = (_spare(F.col("n")) + 1 - (F.col("n") - F.size("s"))).cast("int")
    return shared.select("fp", "n", F.col("s.df").alias("df"), F.col("s.t").alias("t"), prefix.alias("prefix")).filter("prefix > 0")


class _Trie:
    """The compressed trie of one block: sets in lexical order of their ranked shingles, nodes as ranges of sets with a common path."""

    def __init__(self, fps: list[int], sizes: list[int], dfs: list[np.ndarray], shingles: list[np.ndarray]):
        flat, freq = np.concatenate(shingles), np.concatenate(dfs)
        values, first, inverse, counts = np.unique(flat, return_index=True, return_inverse=True, return_counts=True)
        rank = np.empty(len(values), np.int64)
        kept = counts > 1
        order = np.lexsort((values, -freq[first], ~kept))  # frequent first; what only one set has comes last and is dropped
        rank[order] = np.arange(len(values))
        self.width = int(kept.sum())
        bounds = np.cumsum([0, *map(len, shingles)])
        paths = [np.sort(r[r < self.width]) for r in (rank[inverse[a:b]] for a, b in zip(bounds, bounds[1:]))]
        by = sorted(range(len(paths)), key=lambda i: paths[i].astype(">u4").tobytes())
        self.paths, self.fps, self.sizes = [paths[i] for i in by], [fps[i] for i in by], np.array([sizes[i] for i in by], np.int64)
        self.depths = np.array([len(p) for p in self.paths], np.int64)
        self.boss = list(range(len(by)))
        self.common = np.array([0] + [self._common(i - 1, i) for i in range(1, len(by))], np.int64)
        self.nodes: dict[tuple[int, int], tuple] = {}
        self.same: set[tuple[int, int]] = set()

    def _common(self, a: int, b: int) -> int:
        n = min(self.depths[a], self.depths[b])
        differ = np.flatnonzero(self.paths[a][:n] != self.paths[b][:n])
        return int(differ[0]) if len(differ) else int(n)

    def root_of(self, i: int) -> int:
        while self.boss[i] != i:
            self.boss[i] = self.boss[self.boss[i]]
            i = self.boss[i]
        return i

    def node(self, lo: int, hi: int) -> tuple:
        """Depth of the common path of sets [lo, hi), the least and largest size, the longest path, and the children's ranges."""
        if (lo, hi) not in self.nodes:
            depth = int(self.depths[lo]) if hi - lo == 1 else min(int(self.common[lo + 1 : hi].min()), int(self.depths[lo]))
            cuts = [lo, *(np.flatnonzero(self.common[lo + 1 : hi] == depth) + lo + 1).tolist(), hi] if hi - lo > 1 else []
            size, long = self.sizes[lo:hi], self.depths[lo:hi]
            self.nodes[lo, hi] = (depth, int(size.min()), int(size.max()), int(long.max()), list(zip(cuts, cuts[1:])))
        return self.nodes[lo, hi]

    def join(self) -> None:
        """Unite the components of all linked sets."""
        inside = np.zeros(self.width + 1, bool)
        for i in range(len(self.paths) - 1):
            path, n = self.paths[i], int(self.sizes[i])
            inside[path] = True
            todo = [(0, len(self.paths), 0, 0, False)]
            while todo:
                lo, hi, above, overlap, back = todo.pop()
                if back:  # all children were visited: are they one component by now?
                    if all(c in self.same or c[1] - c[0] == 1 for c in self.nodes[lo, hi][4]) and len({self.root_of(c[0]) for c in self.nodes[lo, hi][4]}) == 1:
                        self.same.add((lo, hi))
                    continue
                if hi <= i + 1 or ((hi - lo == 1 or (lo, hi) in self.same) and self.root_of(lo) == self.root_of(i)):
                    continue
                depth, least, most, longest, children = self.node(lo, hi)
                if PERCENT * least > 100 * n or 100 * most < PERCENT * n:
                    continue
                segment = self.paths[lo][above:depth]
                overlap += int(inside[segment].sum())
                rest = len(path) - (int(np.searchsorted(path, self.paths[lo][depth - 1], "right")) if depth else 0)
                possible = overlap + min(rest, longest - depth)
                least = max(least, -(-PERCENT * n // 100))
                if possible * (100 + PERCENT) < PERCENT * (n + least):
                    continue
                if not children:
                    if lo > i and 100 * overlap >= PERCENT * (n + int(self.sizes[lo]) - overlap):
                        self.boss[self.root_of(lo)] = self.root_of(i)
                    continue
                todo.append((lo, hi, 0, 0, True))
                todo += [(a, b, depth, overlap, False) for a, b in children]
            inside[path] = False


def _linked(fps: list[int], sizes: list[int], dfs: list[np.ndarray], shingles: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """(fp, the smallest fp of its component) of every set of a group that has a link."""
    trie = _Trie(fps, sizes, dfs, shingles)
    trie.join()
    roots = [trie.root_of(i) for i in range(len(trie.fps))]
    low: dict[int, int] = {}
    for fp, r in zip(trie.fps, roots):
        low[r] = min(low.get(r, fp), fp)
    yield from ((fp, low[r]) for fp, r in zip(trie.fps, roots) if low[r] != fp)


def _join_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each group from rows (g, fp, n, df, t) sorted by group."""
    now, held = None, ([], [], [], [])

    def done() -> pa.RecordBatch:
        pairs = list(_linked(*held)) if len(held[0]) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["u", "v"])

    for batch in batches:
        groups = batch.column(0).to_numpy()
        fps, sizes = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        arrays = []
        for c in (3, 4):
            column = batch.column(c)
            ends = column.offsets.to_numpy()
            flat = column.values.to_numpy()
            arrays.append([flat[a:b].copy() for a, b in zip(ends, ends[1:])])
        for k, g in enumerate(groups.tolist()):
            if g != now:
                if now is not None:
                    yield done()
                now, held = g, ([], [], [], [])
            for at, value in zip(held, (fps[k], sizes[k], arrays[0][k], arrays[1][k])):
                at.append(value)
    if now is not None:
        yield done()


def links(sets: DataFrame, block: int = BLOCK) -> DataFrame:
    """(u, v): every set (of ``ordered_sets``) that has links, and the smallest set it can reach."""
    spark = sets.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    group = lambda rows: rows.repartition(parts, "g").sortWithinPartitions("g").mapInArrow(_join_groups, "u bigint, v bigint")
    posts = cut(sets.select("fp", F.explode(F.slice("t", 1, F.col("prefix"))).alias("t")), "prefixes")
    hubs = posts.groupBy("t").agg(F.min("fp").alias("hub"), F.max("fp").alias("most")).filter("hub < most")
    blocks = components(posts.join(hubs, "t").filter("fp > hub").select(F.col("fp").alias("u"), F.col("hub").alias("v")))
    blocks = blocks.withColumnsRenamed({"node": "fp", "root": "g"})
    sizes = sets.select("fp", F.size("t").alias("size")).join(blocks, "fp").groupBy("g").agg(F.sum("size").alias("shingles"))
    of = cut(sets.join(blocks.join(sizes, "g"), "fp"), "blocks")
    found = group(of.filter(F.col("shingles") <= block).select("g", "fp", "n", "df", "t"))
    large = of.filter(F.col("shingles") > block)
    if not large.limit(1).count():
        return found
    # large blocks by shingle: groups of the same sets once, those too large by pairs of chunks
    post = large.select("fp", F.size("t").alias("size"), F.explode(F.slice("t", 1, F.col("prefix"))).alias("t"))
    member = F.xxhash64(F.lit(31), "fp")
    groups = post.groupBy("t").agg(F.count("*").alias("sets"), F.sum(member.cast("decimal(38,0)")).alias("digest"), F.sum("size").alias("size"))
    groups = groups.filter("sets > 1").groupBy("sets", "digest").agg(F.min("t").alias("t"), F.min("size").alias("size"))
    chunks = F.ceil(F.col("size") * 2 / F.lit(block)).cast("int")  # two chunks fill a task
    groups = cut(groups.select("t", F.when(F.col("size") <= block, F.lit(1)).otherwise(chunks).alias("chunks")), "large-groups")
    dealt = post.join(groups, "t").withColumn("mine", F.pmod(F.xxhash64(F.lit(37), "fp"), F.col("chunks")))
    dealt = dealt.select("fp", "t", "mine", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    dealt = dealt.select("fp", F.xxhash64("t", F.least("mine", "other"), F.greatest("mine", "other")).alias("g"))
    tiles = large.drop("g").join(dealt, "fp").select("g", "fp", "n", "df", "t")
    joined = components(group(tiles))
    return found.unionByName(joined.filter("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v")))


def joined(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, row key, n_shingles and component_id (smallest doc_id reachable) of every row."""
    rows = cut(set_rows(docs), "ngram-prefixes")
    sets = cut(ordered_sets(docs, cut(with_partner(rows), "may-link")), "ordered-sets")
    roots = cut(links(sets, block), "ngram-links")
    first = rows.filter("fp IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("first"))
    rooted = first.join(roots.withColumnsRenamed({"u": "fp", "v": "root"}), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    known = rooted.join(named, "root").select("fp", "component_id")
    out = rows.filter("fp IS NOT NULL").join(known, "fp").select("doc_id", K1, K2, "n_shingles", "component_id")
    return out.unionByName(rows.filter("fp IS NULL").select("doc_id", K1, K2, "n_shingles", F.col("doc_id").alias("component_id")))
