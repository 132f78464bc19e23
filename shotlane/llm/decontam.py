"""Benchmark decontamination by winnowing.

Of every window of n words the smallest k-gram hash is kept (k + w - 1 = n, w
k-grams to a window), on both sides.  Equal windows keep equal k-grams, so every
shared span of n words or more meets in the join of fingerprints; a hit is then
extended to its whole window and compared byte by byte, so nothing else is
reported.  An item of fewer than n words is a single window of its own length
and its fingerprint is the hash of all its words.

The benchmark is the query set: its distinct windows are dealt by hash into blocks of bounded
size and each block is held against all documents.  Documents are never shuffled:
a block travels to them.  With one block (the usual case) they are read once.

Defined cases: a null or wordless text has no windows and is clean; a null item
or one without words is ignored; a null item_id reads as the empty string;
repeated rows get equal results; empty tables give empty or clean results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField

from shotlane.llm import words as W
from shotlane.llm.common import K1, K2, map_text, row_key, set_aside, without
from shotlane.session import cut

_U = np.uint64
NGRAM, KGRAM = 10, 5
#: Odd factors that keep the order of the words in a gram's hash.
_FACTORS = np.array([pow(0xD6E8FEB86659FD93, i + 1, 1 << 64) for i in range(NGRAM)], dtype=_U)
RESULT = ["n_words", "n_hit", "__hit", "__sets"]


def _grams(h: np.ndarray, k: int) -> np.ndarray:
    n = max(0, len(h) - k + 1)
    out = np.zeros(n, dtype=_U)
    for t in range(k):
        out += h[t : t + n] * _FACTORS[t]
    return W.mixed(out)


def fingerprints(h: np.ndarray, row: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of all windows of ``length`` words inside one text, and the fingerprint of each."""
    k = KGRAM if length == NGRAM else length
    g = _grams(h, k)
    n = max(0, len(h) - length + 1)
    low = g[:n].copy()
    for t in range(1, length - k + 1):
        np.minimum(low, g[t : t + n], out=low)
    at = np.flatnonzero(row[:n] == row[length - 1 : length - 1 + n])
    return at, low[at]


def _window(w: W.Words, first: int, length: int) -> bytes:
    data = w.data
    return b" ".join(data[w.start[i] : w.end[i]].tobytes() for i in range(first, first + length))


def _item_step():
    def step(texts: pa.Array) -> list:
        w = W.split(texts)
        h, counts = w.hashes(), w.counts()
        bounds = np.concatenate([[0], np.cumsum(counts)])
        out = []
        for i, n in enumerate(counts):
            length = min(int(n), NGRAM)
            if not length:
                out.append([])
                continue
            a, b = bounds[i], bounds[i + 1]
            at, low = fingerprints(h[a:b], w.row[a:b], length)
            out.append([{"length": length, "print": int(p), "window": _window(w, int(a + x), length)} for x, p in zip(at, low.astype(np.int64))])
        kind = pa.list_(pa.struct([("length", pa.int32()), ("print", pa.int64()), ("window", pa.binary())]))
        return [pa.array(out, type=kind)]

    return step


def benchmark_windows(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct windows (length, print, window, set_id) and, by set, its items (set_id, item).

    Windows that occur in the same items share a set, named by a digest of them; no list of items is gathered.
    """
    from pyspark.sql.types import StructType

    one = StructType([StructField("length", IntegerType()), StructField("print", LongType()), StructField("window", BinaryType())])
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    rows = map_text(items, ["item"], [StructField("found", ArrayType(one))], _item_step)
    pairs = cut(rows.select("item", F.inline("found")).distinct(), "bench-windows")
    a, b = F.xxhash64(F.lit(5), F.col("item")), F.xxhash64(F.lit(7), F.col("item"))
    sets = pairs.groupBy("length", "print", "window").agg(F.xxhash64(F.bit_xor(a), F.bit_xor(b), F.sum(F.shiftrightunsigned(a, 33)), F.count("*")).alias("set_id"))
    sets = cut(sets, "bench-sets")
    return sets, pairs.join(sets, ["length", "print", "window"]).select("set_id", "item").distinct()


def _block(rows: list) -> dict:
    """The fingerprints and windows of one block, by window length."""
    by_length = {}
    for length in sorted({r["length"] for r in rows}):
        mine = [r for r in rows if r["length"] == length]
        prints = np.unique(np.array([r["print"] for r in mine], dtype=np.int64).view(_U))
        bits = np.zeros(1 << 20, dtype=bool)
        bits[(prints & _U((1 << 20) - 1)).astype(np.int64)] = True
        by_length[length] = (prints, bits, {bytes(r["window"]): r["set_id"] for r in mine})
    return by_length


def _search_step(block):
    def start():
        lengths = block.value

        def step(texts: pa.Array) -> list:
            w = W.split(texts)
            h, counts = w.hashes(), w.counts()
            hit = np.zeros(len(h) + 1, dtype=np.int32)
            sets: list[set] = [set() for _ in range(len(counts))]
            for length, (prints, bits, windows) in lengths.items():
                at, low = fingerprints(h, w.row, length)
                maybe = np.flatnonzero(bits[(low & _U((1 << 20) - 1)).astype(np.int64)])
                maybe = maybe[np.isin(low[maybe], prints)]
                for x in at[maybe]:
                    found = windows.get(_window(w, int(x), length))
                    if found is not None:
                        hit[x] += 1
                        hit[x + length] -= 1
                        sets[w.row[x]].add(found)
            inside = np.cumsum(hit[:-1]) > 0
            bounds = np.concatenate([[0], np.cumsum(counts)])
            total = np.concatenate([[0], np.cumsum(inside)])
            masks = [np.packbits(inside[a:b]).tobytes() if total[b] > total[a] else b"" for a, b in zip(bounds, bounds[1:])]
            n_hit = np.diff(total[bounds])
            return [pa.array(counts, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(masks, pa.binary()), pa.array([sorted(s) for s in sets], pa.list_(pa.int64()))]

        return step

    return start


def scan(docs: DataFrame, sets: DataFrame, block_windows: int = 200_000) -> DataFrame:
    """All columns of ``docs`` plus n_words, n_hit, __sets (sets of items met); rows stay where they are.

    ``block_windows`` bounds what the driver and each task hold of the benchmark; more windows mean more blocks, not fewer windows.
    """
    blocks = max(1, -(-sets.count() // block_windows))
    keep = without(docs, RESULT)
    fields = [StructField("n_words", LongType()), StructField("n_hit", LongType()), StructField("__hit", BinaryType()), StructField("__sets", ArrayType(LongType()))]
    out = None
    for b in range(blocks):
        mine = sets if blocks == 1 else sets.filter(F.pmod(F.xxhash64("window"), F.lit(blocks)) == b)
        held = docs.sparkSession.sparkContext.broadcast(_block(mine.collect()))
        if out is None:
            out = map_text(docs.select(keep), keep, fields, _search_step(held))
            continue
        old = out.withColumnsRenamed({"__hit": "__hit0", "__sets": "__sets0"}).drop("n_words", "n_hit")
        out = map_text(old, [*keep, "__hit0", "__sets0"], fields, _search_step(held))
        # masks of one text have equal length, or are empty where nothing was hit
        out = out.withColumn("__hit", _either("__hit0", "__hit")).withColumn("__sets", F.array_union("__sets0", "__sets")).drop("__hit0", "__sets0")
    return (out if blocks == 1 else out.withColumn("n_hit", _ones("__hit"))).drop("__hit")


def _bytes(c: str):
    return F.expr(f"transform(sequence(1, greatest(length({c}), 1)), i -> cast(coalesce(conv(hex(substring({c}, i, 1)), 16, 10), '0') as int))")


def _either(a: str, b: str):
    """Bytewise OR of two masks."""
    both = F.zip_with(_bytes(a), _bytes(b), lambda x, y: F.lpad(F.hex(x.bitwiseOR(y)), 2, "0"))
    return F.when(F.length(a) == 0, F.col(b)).when(F.length(b) == 0, F.col(a)).otherwise(F.unhex(F.array_join(both, "")))


def _ones(c: str):
    """Bits set in a mask."""
    return F.when(F.length(c) == 0, F.lit(0).cast("long")).otherwise(F.aggregate(_bytes(c), F.lit(0).cast("long"), lambda s, x: s + F.bit_count(x)))


def contamination(docs: DataFrame, benchmark: DataFrame, block_windows: int = 200_000) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items (sorted as strings), contaminated."""
    sets, members = benchmark_windows(benchmark)
    slim = docs.select("doc_id", "text")
    seen = cut(scan(slim.select("doc_id", "text", *row_key()), sets, block_windows).drop("text"), "contamination")
    hits = seen.filter("n_hit > 0").select(K1, K2, F.explode("__sets").alias("set_id")).distinct()
    items = hits.join(members, "set_id").groupBy(K1, K2).agg(F.array_sort(F.collect_set("item")).alias("items"))
    out = seen.join(items, [K1, K2], "left")
    found = F.coalesce("items", F.array().cast("array<string>"))
    return out.select("doc_id", "n_words", "n_hit", F.size(found).cast("long").alias("n_items"), found.alias("items"), (F.col("n_hit") > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, block_windows: int = 200_000) -> DataFrame:
    """The documents without any window of the benchmark, columns unchanged."""
    sets, _ = benchmark_windows(benchmark)
    held, back = set_aside(docs)
    return scan(held, sets, block_windows).filter("n_hit = 0").select(back)
