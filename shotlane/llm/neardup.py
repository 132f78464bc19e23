"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprints link at ``RADIUS`` = 3 or fewer differing bits.  Half the radius is one bit
on one side and two on the other: two fingerprints at distance d <= 3 meet in a
variant that is at most one bit from the one and at most two from the other.

* Distance 1 and 2: every distinct fingerprint emits its ball of radius one (itself and 64
  variants).  Members of a variant are within two bits of each other by
  construction, so a star to the smallest member is a set of true links.
* Distance 3: the parities of the two differ, so odd fingerprints emit their 64 one-bit
  variants and even ones two-bit variants.  Two of the three bits lie in the
  same 32-bit half, so only pairs of bits of one half are flipped (496 for each).
  A variant with an odd member links all its even members to it, and the odd ones to each other.
  Only fingerprints with a possible partner emit: for these one half (at most one of the three bits is in
  it) lies within one bit of another's half, seen by counting 33 variants of
  each half; the two flipped bits are then in the other half.

A variant has at most 65 (or 64 + 992) members, a bound of geometry, not of the data, so a cluster of any size is
joined by linear stars and no pairs are listed.  Every star link is within the radius, or
follows from two such links, so components are those of the full link graph.  Copies share a fingerprint and enter once.

A fingerprint is the majority of the 64-bit hashes (XXH64, seed 42) of all 3-word shingles, repeats
included.  Defined cases: fewer than three words make one shingle; no words (null, empty)
give fingerprint zero, linked like any other; a null doc_id never names a component unless all its ids are null.

``one_of_each``, the stage of the pipeline, has its own contract: five-word shingles and Jaccard similarity ``SIMILAR`` = 0.8.
Texts that similar are some ten bits of a SimHash apart, out of reach of a ball, so the stage's
fingerprint has one bit of each of ``BITS`` minimum hashes of the shingle set: two texts differ in a bit with chance
(1 - J) / 2.  Every 32-bit band of it is ball-hashed at radius two (one bit on each side), and every
candidate is verified on the whole shingle sets.  Equal shingle sets are one node.  Bands hold their distinct values
only, so a variant has at most 33 members, and a value's texts are linked to its smallest one.  That link is to a true partner only
while members by chance are rare, so a band's key is lengthened with the number of sets (``key_bits``): some bits of another
band are added, in several ways (a way per other band), so that a pair that differs in the bits of one way meets in the next.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField
from pyspark.sql.window import Window

from shotlane.llm.common import K1, K2, components, keyed, map_text, row_key
from shotlane.session import cut

RADIUS, SHINGLE = 3, 3
#: Of the stage: words of a shingle, similarity, bits of the fingerprint, and the distance that no pair as similar has (over six standard errors).
STAGE_SHINGLE, SIMILAR, BITS, FAR = 5, 0.8, 256, 56
#: Members that a variant may have by chance, and the share of the pairs meeting in a band that must meet in a lengthened key of it.
CHANCE, KEPT = 0.25, 0.95
_PART = 1 << 15


def fingerprint(text: bytes) -> int:
    """The SimHash of one text as a signed long."""
    words = text.lower().split()  # for bytes: A-Z only, and cut at \\x20 and \\x09-\\x0D
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths)
    n = max(1, len(words) - SHINGLE + 1)
    first, last = (ends - lengths)[:n].tolist(), (ends - 1)[-n:].tolist()
    digest = xxhash.xxh64_intdigest
    votes = np.zeros(64, dtype=np.int64)
    for a in range(0, n, _PART):
        h = np.array([digest(joined[i:j], 42) for i, j in zip(first[a : a + _PART], last[a : a + _PART])], dtype=np.uint64)
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits((votes * 2 > n).astype(np.uint8), bitorder="little")
    return int(bits.view(np.int64)[0])


def _step():
    def step(texts: pa.Array) -> list:
        return [pa.array([fingerprint(t or b"") for t in texts.cast(pa.binary()).to_pylist()], pa.int64())]

    return step


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, row key and fingerprint (long) of every row."""
    return map_text(docs.select("doc_id", "text", *row_key()), ["doc_id", K1, K2], [StructField("fp", LongType())], _step)


def _flips(bits: list[int]):
    """A literal array of masks."""
    return F.from_json(F.lit("[" + ",".join(str(b - (1 << 64) if b >> 63 else b) for b in bits) + "]"), "array<bigint>")


ONE = [1 << i for i in range(64)]
LOW, HIGH = ONE[:32], ONE[32:]


def _pairs(half: list[int]) -> list[int]:
    return [a | b for i, a in enumerate(half) for b in half[i + 1 :]]


def links(fps: DataFrame) -> DataFrame:
    """Star links (u, v) whose components are those of all pairs within the radius; ``fps`` has distinct ``fp``."""
    def variants(df: DataFrame, masks: list[int], *more) -> DataFrame:
        return df.select("fp", *more, F.explode(_flips(masks)).alias("m")).select("fp", *more, F.col("fp").bitwiseXOR(F.col("m")).alias("x"))

    low = F.min("fp").over(Window.partitionBy("x"))
    near = variants(fps, [0, *ONE]).select("fp", low.alias("v")).filter("fp > v").select(F.col("fp").alias("u"), "v")
    # which half of a fingerprint is within one bit of another's half
    half = fps.select("fp", F.explode(F.array(F.lit(0), F.lit(1))).alias("side"))
    word = F.when(F.col("side") == 0, F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.shiftrightunsigned("fp", 32))
    ball = half.select("fp", "side", word.alias("w"), F.explode(_flips([0, *LOW])).alias("m"))
    # a half has a partner if its own word, as a variant, is met by a second fingerprint
    met = ball.groupBy("side", F.col("w").bitwiseXOR(F.col("m")).alias("w")).agg(F.min("fp").alias("a"), F.max("fp").alias("b")).filter("a < b")
    open_ = cut(half.select("fp", "side", word.alias("w")).join(met.select("side", "w"), ["side", "w"], "left_semi").select("fp", "side"), "half-partners")
    odd = (F.bit_count("fp") % 2 == 1).alias("odd")
    far = variants(open_.select("fp").distinct().filter("bit_count(fp) % 2 = 1"), ONE, odd)
    for side, pairs in ((0, _pairs(HIGH)), (1, _pairs(LOW))):  # the half ``side`` is close, so the two bits are in the other
        far = far.unionByName(variants(open_.filter((F.col("side") == side) & (F.bit_count("fp") % 2 == 0)), pairs, odd))
    hub = F.min(F.when(F.col("odd"), F.col("fp"))).over(Window.partitionBy("x"))
    far = far.select("fp", hub.alias("v")).filter("v IS NOT NULL AND fp <> v").select(F.col("fp").alias("u"), "v")
    return near.unionByName(far).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, row key, fp and component_id (smallest doc_id reachable) of every row."""
    seen = cut(fingerprints(docs), "fingerprints")
    fps = cut(seen.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fps")
    # a row becomes over a hundred: spread the distinct fingerprints before that
    roots = components(links(fps.select("fp").repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")))
    rooted = fps.join(roots, fps.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return seen.join(rooted.join(named, "root").select("fp", "root", "component_id"), "fp")


_A = np.random.default_rng(5).integers(0, 1 << 31, BITS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = np.random.default_rng(6).integers(0, 1 << 32, BITS, dtype=np.uint32)


def shingles(text: bytes, size: int = STAGE_SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles; a text of fewer words is one shingle, no words give none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.int64)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths)
    n = max(1, len(words) - size + 1)
    digest = xxhash.xxh64_intdigest
    found = np.fromiter((digest(joined[i:j], 42) for i, j in zip((ends - lengths)[:n].tolist(), (ends - 1)[-n:].tolist())), np.uint64, n)
    return np.unique(found.view(np.int64))


def min_bits(sets: np.ndarray) -> np.ndarray:
    """One bit of each of BITS minimum hashes of a shingle set, as four longs."""
    h = (sets.view(np.uint64) >> np.uint64(32)).astype(np.uint32)
    low = np.full(BITS, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(h), 2048):
        np.minimum(low, ((h[None, a : a + 2048] ^ _B[:, None]) * _A[:, None]).min(axis=1), out=low)
    low ^= low >> np.uint32(16)
    bits = (low * np.uint32(0x85EBCA6B)) >> np.uint32(31)
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64)


def _set_id(sets: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(sets.tobytes(), 7)).view(np.int64)) if len(sets) else 0


def _signature_step():
    def step(texts: pa.Array) -> list:
        sets = [shingles(t or b"") for t in texts.cast(pa.binary()).to_pylist()]
        bits = np.stack([min_bits(x) for x in sets]) if sets else np.zeros((0, BITS // 64), np.int64)
        return [pa.array([_set_id(x) for x in sets], pa.int64()), *[pa.array(bits[:, i]) for i in range(BITS // 64)]]

    return step


def _shingle_step():
    def step(texts: pa.Array) -> list:
        sets = [shingles(t or b"") for t in texts.cast(pa.binary()).to_pylist()]
        return [pa.array([_set_id(x) for x in sets], pa.int64()), pa.array([x.tolist() for x in sets], pa.list_(pa.int64()))]

    return step


SIGNATURE = [f"s{i}" for i in range(BITS // 64)]


def key_bits(n_sets: int, similar: float = SIMILAR) -> tuple[int, int]:
    """Bits to add to a band's key so that a variant has at most ``CHANCE`` members by chance, and in how many ways to add them."""
    bits = max(0, math.ceil(math.log2(max(1, n_sets) * (1 + 32) / 2**32 / CHANCE)))
    met = (1 - (1 - similar) / 2) ** bits
    ways = 1 if met == 1 else math.ceil(math.log(1 - KEPT) / math.log(1 - met))
    return bits, min(ways, BITS // 32 - 1)


def candidate_pairs(sets: DataFrame, bits: int = 0, ways: int = 1) -> DataFrame:
    """Pairs (u, v) of set ids to verify, from distinct rows (fp, *SIGNATURE): star links within the ball of a band's key.

    A key is the band's number and way, ``bits`` low bits of another band (the way says which), and the 32 bits of the band, which alone are flipped.
    """
    bands = [F.col(c).bitwiseAND(F.lit(0xFFFFFFFF)) if k == 0 else F.shiftrightunsigned(c, 32) for c in SIGNATURE for k in (0, 1)]
    n = len(bands)
    keys = []
    for i, b in enumerate(bands):
        for way in range(ways):
            more = bands[(i + 1 + way) % n].bitwiseAND(F.lit((1 << bits) - 1))
            keys.append(F.lit((i * n + way) << 56).bitwiseOR(F.shiftleft(more, 32)).bitwiseOR(b))
    rows = cut(sets.select("fp", F.explode(F.array(keys)).alias("w")), "bands")
    hubs = cut(rows.groupBy("w").agg(F.min("fp").alias("hub")), "band-hubs")
    # the texts of one value to its smallest; then values within two bits of each other, their smallest texts
    own = rows.join(hubs, "w").filter("fp <> hub").select(F.col("fp").alias("u"), F.col("hub").alias("v"))
    ball = hubs.select("w", "hub", F.explode(_flips([0, *LOW])).alias("m")).select("hub", F.col("w").bitwiseXOR(F.col("m")).alias("x"))
    near = ball.withColumn("v", F.min("hub").over(Window.partitionBy("x"))).filter("hub <> v").select(F.col("hub").alias("u"), "v")
    return own.unionByName(near).distinct()


def similar_groups(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """doc_id, row key, fp (id of the shingle set) and root (the smallest fp reachable) of every row."""
    fields = [StructField("fp", LongType()), *[StructField(c, LongType()) for c in SIGNATURE]]
    seen = cut(map_text(docs.select("doc_id", "text", *row_key()), ["doc_id", K1, K2], fields, _signature_step), "signatures")
    least = seen.groupBy("fp").agg(*[F.min(c).alias(c) for c in SIGNATURE], F.min(F.struct(K1, K2)).alias("k"))
    sets = cut(least.select("fp", *SIGNATURE, F.col("k")[K1].alias(K1), F.col("k")[K2].alias(K2)), "shingle-sets")
    spread = sets.filter("fp <> 0").select("fp", *SIGNATURE).repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    pairs = candidate_pairs(spread, *key_bits(sets.count(), similar))
    of = lambda name: sets.select(F.col("fp").alias(name), *[F.col(c).alias(f"{name}{c}") for c in SIGNATURE])
    apart = sum((F.bit_count(F.col(f"u{c}").bitwiseXOR(F.col(f"v{c}"))) for c in SIGNATURE), F.lit(0))
    close = cut(pairs.join(of("u"), "u").join(of("v"), "v").filter(apart <= FAR).select("u", "v"), "close-pairs")
    # shingle sets of the texts that are in a pair, one text of each set
    asked = close.select(F.col("u").alias("fp")).unionByName(close.select(F.col("v").alias("fp"))).distinct()
    wanted = sets.join(asked, "fp", "left_semi").select(K1, K2)
    texts = docs.select("text", *row_key()).join(wanted, [K1, K2], "left_semi")
    held = cut(map_text(texts, [], [StructField("fp", LongType()), StructField("shingles", ArrayType(LongType()))], _shingle_step), "shingles")
    held = held.groupBy("fp").agg(F.first("shingles").alias("shingles")) if held.groupBy("fp").count().filter("count > 1").limit(1).count() else held
    both = close.join(held.select(F.col("fp").alias("u"), F.col("shingles").alias("su")), "u").join(held.select(F.col("fp").alias("v"), F.col("shingles").alias("sv")), "v")
    shared = F.size(F.array_intersect("su", "sv"))
    linked = both.filter(shared >= similar * (F.size("su") + F.size("sv") - shared)).select("u", "v")
    roots = components(linked)
    rooted = sets.select("fp").join(roots, sets.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"))
    return seen.select("doc_id", K1, K2, "fp").join(rooted, "fp")


def one_of_each(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """One document of each group of five-word Jaccard similarity ``similar``, the one with the smallest doc_id (then row key); columns unchanged.

    Where doc_id and text are both repeated, one of the equal rows stays.
    """
    rows = cut(similar_groups(docs, similar), "near-groups")
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", K1, K2)
    best = rows.groupBy("root").agg(F.min(rank).alias("best")).select("root", F.col("best")[K1].alias("b1"), F.col("best")[K2].alias("b2"))
    is_best = (F.col(K1) == F.col("b1")) & (F.col(K2) == F.col("b2"))
    judged = rows.join(best, "root")
    dropped = judged.filter(~is_best).select(K1, K2)
    repeated = bool(judged.filter(is_best).groupBy("root").count().filter("count > 1").limit(1).count())
    held, back = keyed(docs)
    out = held.join(dropped, [K1, K2], "left_anti")
    return (out.dropDuplicates([K1, K2]) if repeated else out).select(back)
