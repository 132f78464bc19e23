"""Exact deduplication by content sort.

Rows are range-partitioned by sampled splitters over (first characters, hash of the text, salt) and
sorted externally inside each range by these and the whole text, so equal texts
lie next to each other; a window over the run of equal texts compares
neighbours in full.  The range exchange already clusters what the window needs, so texts move once.
Splitters are short whatever the texts' length.

A text that makes up more than a fraction of a partition is salted by doc_id into several runs, which sort next
to each other and may fall into several ranges; its runs are merged by their SHA-256 afterwards.  The
number of such texts is bounded by the number of partitions (``SHARE`` for each), which also
bounds the broadcast; they are found by counting hashes before the sort.

Defined cases: null counts as empty; nothing else is normalised; of equal texts the row with the largest doc_id
stays (``keep="largest"``) or the smallest (``"smallest"``); a null doc_id only stays in a group of nulls; of rows equal in both
exactly one stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shotlane.llm.common import K1, K2, keyed, two_hashes, whole_text
from shotlane.session import cut

PREFIX, SHARE = 16, 8


def groups(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    best, order = (F.max, F.col("doc_id").desc_nulls_last()) if keep == "largest" else (F.min, F.col("doc_id").asc_nulls_last())
    h1, h2 = two_hashes(F.col("t"))
    rows = docs.select("doc_id", whole_text().alias("t")).withColumns({"h1": h1, "h2": h2})
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = cut(rows.groupBy("h1", "h2").agg(F.count("*").alias("n")), "text-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    piece = max(1, total // (SHARE * n))
    hot = F.broadcast(counts.filter(F.col("n") > piece).select("h1", "h2", F.ceil(F.col("n") / piece).cast("int").alias("runs")))  # at most SHARE * n rows and a few
    salted = rows.join(hot, ["h1", "h2"], "left").withColumn("salt", F.when(F.col("runs").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc_id"), F.col("runs")).cast("int")))
    keyed = salted.select("doc_id", "t", F.col("runs").isNotNull().alias("hot"), F.substring("t", 1, PREFIX).alias("prefix"), "h1", "salt")
    ranged = keyed.repartitionByRange("prefix", "h1", "salt")
    run = Window.partitionBy("prefix", "h1", "salt", "t")
    sorted_ = ranged.withColumns({"place": F.row_number().over(run.orderBy(order)), "size": F.count("*").over(run), "best": best("doc_id").over(run)})
    runs = cut(sorted_.select("doc_id", "hot", "salt", "place", "size", "best", F.sha2("t", 256).alias("text_sha256")), "text-runs")
    heads = runs.filter("hot AND place = 1")
    merged = F.broadcast(heads.groupBy("text_sha256").agg(F.sum("size").alias("all_size"), best("best").alias("all_best"), F.min(F.when(F.col("best").isNull(), F.col("salt"))).alias("null_salt")))  # as many rows as hot texts
    out = runs.join(merged, "text_sha256", "left")
    head = F.col("place") == 1
    of_best = F.when(F.col("all_best").isNull(), F.col("salt") == F.col("null_salt")).otherwise(F.col("doc_id").eqNullSafe(F.col("all_best")))
    return out.select("doc_id", F.when(F.col("hot"), F.col("all_best")).otherwise(F.col("best")).alias("keep_id"), F.when(F.col("hot"), F.col("all_size")).otherwise(F.col("size")).alias("group_size"), F.when(F.col("hot"), head & of_best).otherwise(head).alias("kept"), "text_sha256")


def deduplicate(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """The documents with one row of each group of equal texts; columns unchanged."""
    # a kept row is known by its id and text; of rows equal in both, dropDuplicates leaves one
    kept = groups(docs, keep).filter("kept").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")).alias("__id"), F.col("text_sha256").alias("__sha"))
    held, back = keyed(docs)
    mine = held.columns[docs.columns.index("doc_id")]
    tagged = held.withColumns({"__id": F.coalesce(F.col(mine).cast("string"), F.lit("-")), "__sha": F.sha2(whole_text(), 256)})
    return tagged.join(kept, ["__id", "__sha"], "left_semi").dropDuplicates([K1, K2]).select(back)
