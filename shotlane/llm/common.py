"""What several operators share: row keys, row-wise Arrow steps, a stratified bounded sample of labels, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from shotlane.session import cut

K1, K2 = "__k1", "__k2"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def two_hashes(*cols: Column) -> tuple[Column, Column]:
    """128 bits in two longs: the same hash under two seeds (a leading literal changes the seed)."""
    return F.xxhash64(F.lit(11), *cols), F.xxhash64(F.lit(23), *cols)


def row_key() -> list[Column]:
    """A row's key: two longs over doc_id and whole text; rows equal in both share it."""
    a, b = two_hashes(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), whole_text())
    return [a.alias(K1), b.alias(K2)]


def without(df: DataFrame, names: list[str]) -> list[str]:
    """The columns of ``df`` but for those that a result column will replace."""
    taken = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in taken]


def set_aside(docs: DataFrame) -> tuple[DataFrame, list[Column]]:
    """``docs`` with all columns but the text renamed, and the columns that bring the names back: no name can clash meanwhile."""
    names = {c: f"__c{i}" for i, c in enumerate(docs.columns) if c != "text"}
    return docs.select([F.col(c).alias(names.get(c, c)) for c in docs.columns]), [F.col(names.get(c, c)).alias(c) for c in docs.columns]


def keyed(docs: DataFrame) -> tuple[DataFrame, list[Column]]:
    """As ``set_aside``, with the row key beside."""
    held, back = set_aside(docs)
    return docs.select([F.col(c).alias(h) for c, h in zip(docs.columns, held.columns)] + row_key()), back


def map_text(df: DataFrame, keep: list[str], fields: list[StructField], start: Callable[[], Callable[[pa.Array], list]], slice_bytes: int = 512 << 10) -> DataFrame:
    """``keep`` columns of every row plus ``fields`` computed from its whole text.

    ``start()`` runs once per task and returns a function from an Arrow array of
    texts (nulls are empty) to one Arrow array per field.  Batches are cut into
    slices of about ``slice_bytes`` of text, so memory follows the longest text
    and not the batch.  A text that is kept travels once.
    """
    once = "text" in keep and df.schema["text"].dataType == StringType()
    held = df.select(*keep) if once else df.select(*keep, whole_text().alias("__text"))
    place = keep.index("text") if once else len(keep)
    out = StructType([held.schema[c] for c in keep] + fields)
    names = [*keep, *[f.name for f in fields]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = start()
        for batch in batches:
            for a, b in slices(batch.column(place), slice_bytes):
                part = batch.slice(a, b - a)
                new = step(pc.fill_null(part.column(place), ""))
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(len(keep))] + list(new), names=names)

    return held.mapInArrow(run, out)


def slices(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes of text, at least one row each."""
    sizes = pc.binary_length(texts).to_pylist()
    a = total = 0
    for i, n in enumerate(sizes):
        if i > a and total + (n or 0) > most:
            yield a, i
            a, total = i, 0
        total += n or 0
    if len(sizes) > a:
        yield a, len(sizes)


def held_out() -> Column:
    """Rows that no model may learn labels from: crc32(doc_id as text) mod 3 = 1."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def label_sample(labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """At most ``per_class`` labelled, not held-out ids of each class, those with the smallest hash of the id: (doc_id, label).

    Its size is bounded by the parameter, so it may be broadcast.  Rows without id
    or label are left out; an id with both labels counts as the larger one.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out())
    one = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    parts = [one.filter(F.col("label") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for v in (0, 1)]
    return parts[0].unionByName(parts[1])


def components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """Connected components of an undirected graph ``(u, v)`` of longs: (node, root), root the smallest node.

    Alternating large-star and small-star steps: each is a minimum per node with
    map-side combine and one join, so a hub of any degree is never gathered.
    Every round is written to the shared folder.  Nodes without edges are absent.
    """
    e = cut(edges.filter(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e1 = large.filter(F.col("u") != F.col("v")).distinct()
        low = e1.groupBy("u").agg(F.min("v").alias("m"))
        small = e1.join(low, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "stars")
        seen = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
