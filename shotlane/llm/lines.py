"""Line deduplication by distinct-site spread.

1. Every line is hashed (128 bits, surrounding white space dropped); texts stay where they are.
2. One HyperLogLog sketch of sites per line hash, merged by aggregation, with map-side combine, so a line
   that a third of all rows share costs one sketch per task.
3. Far above the threshold (by three standard errors and one) the sketch decides; every other line of two
   sites or more gets its exact count of distinct sites.  A line with fewer sites than two cannot reach a threshold.
4. A line on at least ``sites`` sites (``long_sites`` if it has over ``long_words`` words) is boilerplate and goes from every
   document but the one with the smallest doc_id that has it.

Defined cases: blank lines are kept and never counted; a null site counts as no site; a null text
stays null; a document that had words and loses all its lines is dropped by ``clean`` and has an empty text in ``edited``;
rows equal in doc_id and text get equal results; a null doc_id is never the smallest unless all are null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotlane.llm.common import K1, K2, keyed, row_key, two_hashes, whole_text
from shotlane.session import cut

SITES, LONG_SITES, LONG_WORDS, ERROR = 5, 3, 50, 0.13
REMOVED = "__lines_removed"


def _lines(docs: DataFrame, site: str) -> DataFrame:
    rows = docs.select(*row_key(), "doc_id", F.col(site).cast("string").alias("site"), F.posexplode(F.split(whole_text(), "\n", -1)).alias("at", "line"))
    trimmed = F.trim(F.translate("line", "\t\r", "  "))
    h1, h2 = two_hashes(F.col("key"))
    words = F.length("key") - F.length(F.replace("key", F.lit(" "), F.lit(""))) + 1
    return rows.select(K1, K2, "doc_id", "site", "at", trimmed.alias("key")).filter("key <> ''").select(K1, K2, "doc_id", "site", "at", h1.alias("h1"), h2.alias("h2"), (words > LONG_WORDS).alias("long"))


def boilerplate(lines: DataFrame, sites: int, long_sites: int) -> DataFrame:
    """Hashes of boilerplate lines with their number of sites (exact where it was near the threshold) and first document."""
    need = F.when(F.col("long"), F.lit(long_sites)).otherwise(F.lit(sites))
    s = F.xxhash64("site")
    of = F.when(F.col("site").isNotNull(), s)
    spread = lines.groupBy("h1", "h2", "long").agg(F.approx_count_distinct("site", ERROR).alias("about"), F.min(of).alias("s0"), F.max(of).alias("s1"), F.min("doc_id").alias("first"))
    spread = cut(spread.filter("s0 < s1").withColumn("need", need), "line-sites")  # two sites or more
    sure = F.col("about") > F.col("need") * (1 + 3 * ERROR) + 1
    near = spread.filter(~sure)
    # one row per line and site before anything is dealt by line; an inner join, as a semi-join would be pushed below the distinct
    pairs = lines.filter("site IS NOT NULL").select("h1", "h2", "site").distinct()
    exact = pairs.join(near.select("h1", "h2"), ["h1", "h2"]).groupBy("h1", "h2").agg(F.count("*").alias("sites"))
    kept = near.join(exact, ["h1", "h2"]).filter("sites >= need").select("h1", "h2", "sites", "first")
    return spread.filter(sure).select("h1", "h2", F.col("about").alias("sites"), "first").unionByName(kept)


def edited(docs: DataFrame, site: str = "source", sites: int = SITES, long_sites: int = LONG_SITES) -> DataFrame:
    """All columns of ``docs`` with the cleaned text, plus __lines_removed (number of lines taken out)."""
    lines = cut(_lines(docs, site), "lines")
    bad = boilerplate(lines, sites, long_sites)
    hits = lines.join(bad, ["h1", "h2"]).filter(~F.col("doc_id").eqNullSafe(F.col("first")))
    gone = hits.groupBy(K1, K2).agg(F.collect_set("at").alias("__gone"))
    held, back = keyed(docs)
    joined = held.join(gone, [K1, K2], "left")
    # places that stay by a hashed difference of arrays: linear in the lines of a text
    joined = joined.withColumn("__lines", F.when(F.col("__gone").isNotNull(), F.split("text", "\n", -1)))
    places = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), "__gone")
    left = F.array_join(F.transform(places, lambda i: F.get("__lines", i)), "\n")
    text = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(left)
    kept = [b for b, c in zip(back, docs.columns) if c != REMOVED]
    return joined.withColumn("text", text).select(*kept, F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias(REMOVED))


def clean(docs: DataFrame, site: str = "source", sites: int = SITES, long_sites: int = LONG_SITES) -> DataFrame:
    """The documents with boilerplate lines taken out, columns unchanged; ``n_chars`` follows the text where there is such a column."""
    out = edited(docs, site, sites, long_sites).filter("__lines_removed = 0 OR trim(translate(text, '\\t\\r\\n', '   ')) <> ''")
    chars = F.when(F.col("__lines_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars").cast("long")) if "n_chars" in docs.columns else None
    return out.select([chars.alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])
