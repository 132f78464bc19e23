"""The registered queries of this package, one per operator, and their SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotlane.llm import bpe, decontam, exact, lines, neardup, negatives, ngram_join, pii, quality, sharding, spelling, toxicity, urls
from shotlane.llm.common import held_out, table

SHARDS = 24


def op1_quality_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = quality.score(docs, quality.fit(docs, labels))
    return out.withColumns({"held_out": held_out(), "kept": F.col("predicted") == 1})


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.edited(table(spark, sf_dir, "documents"))
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", F.col(lines.REMOVED).alias("n_removed"), F.length(text).cast("long").alias("n_chars"), F.sha2(text, 256).alias("text_sha256"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op4_slot_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(table(spark, sf_dir, "documents"), SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot", "map_version")


def op5_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = toxicity.score(docs, toxicity.fit(docs, labels), ["doc_id"])
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted", F.size("passages").alias("n_passages"))


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.spans(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return out.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(pii.KINDS)], F.sha2("base_text", 256).alias("base_sha256"), "spans", F.col("added").alias("n_added"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ["doc_id"])


def op9_simhash_balls(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = neardup.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.groups(table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(negatives.taking_part(table(spark, sf_dir, "embeddings"), label))


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.joined(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_quality_cotraining, op2_line_dedup, op3_decontaminate, op4_slot_sharding, op5_toxic_segments, op6_url_rules, op7_personal_data, op8_byte_bpe, op9_simhash_balls, op10_content_sort,
              op11_spelling_variants, op12_hard_negatives, op13_ngram_join, pipeline)
}

ORACLES: dict[str, str] = {
    "op2_line_dedup": """
WITH l AS (
  SELECT rowid_, doc_id, source, i AS pos, parts[i] AS line, trim(translate(parts[i], chr(9) || chr(13), '  ')) AS key
  FROM (SELECT row_number() OVER () AS rowid_, doc_id, source, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents), LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS i)),
spread AS (
  SELECT key, count(DISTINCT source) AS sites, min(doc_id) AS first,
    CASE WHEN length(key) - length(replace(key, ' ', '')) + 1 > 50 THEN 3 ELSE 5 END AS need
  FROM l WHERE key <> '' GROUP BY key),
bad AS (SELECT key, first FROM spread WHERE sites >= need),
marked AS (SELECT l.*, bad.key IS NOT NULL AND l.doc_id IS DISTINCT FROM bad.first AS gone FROM l LEFT JOIN bad ON l.key = bad.key),
answer AS (
  SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS t
  FROM marked GROUP BY rowid_, doc_id)
SELECT doc_id, CAST(n_removed AS BIGINT) AS n_removed, CAST(length(t) AS BIGINT) AS n_chars, sha256(t) AS text_sha256 FROM answer
""",
    "op10_content_sort": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM d
""",
    "op11_spelling_variants": r"""
WITH RECURSIVE bits AS (
  SELECT i, i AS c, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY i) AS tab FROM bits WHERE k = 8),
runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents) GROUP BY ALL),
keyed AS (SELECT row_number() OVER () AS r, run, n, hex(encode(id || ':' || run)) AS h FROM runs WHERE length(run) >= 7),
crc AS (
  SELECT r, h, 4294967295 AS c, 0 AS pos FROM keyed
  UNION ALL
  SELECT r, h, xor(c >> 8, tab[CAST((xor(c, CAST('0x' || substr(h, 2 * pos + 1, 2) AS BIGINT)) & 255) + 1 AS BIGINT)]), pos + 1
  FROM crc, crc_table WHERE 2 * pos < length(h)),
hashed AS (SELECT run, n, xor(c, 4294967295) AS h FROM keyed JOIN crc USING (r) WHERE 2 * pos = length(crc.h)),
damaged AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM damaged WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
less AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM words, LATERAL (SELECT unnest(range(1, length(word) + 1)) AS i)),
near AS (
  SELECT a.word, b.word AS other, b.n AS m FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word),
best AS (SELECT word, other, m, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY m DESC, other) AS k FROM near),
forms AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.m >= 10 * w.n THEN b.other END AS form, CASE WHEN b.m >= 10 * w.n THEN b.m END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word AND b.k = 1),
chain AS (
  SELECT word, word AS at FROM forms
  UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON c.at = f.word WHERE f.form IS NOT NULL),
roots AS (SELECT c.word, c.at AS root FROM chain c JOIN forms f ON c.at = f.word WHERE f.form IS NULL)
SELECT word, form, root, n, CAST(n_near AS BIGINT) AS n_near, form_n FROM forms JOIN roots USING (word)
""",
    "op12_hard_negatives": """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND list_count(embedding) = len(embedding) AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS s
  FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM (SELECT a, b, s, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS k FROM s WHERE same) WHERE k <= 5),
n AS (
  SELECT p.a, p.b AS pos, p.s AS ps, s.b AS neg, s.s AS ns, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.s DESC, s.b) AS k
  FROM p JOIN s ON p.a = s.a AND NOT s.same WHERE 30 * p.s <= 100 * s.s AND 100 * s.s <= 90 * p.s)
SELECT a AS anchor_id, pos AS positive_id, CAST(k AS INT) AS rank, neg AS negative_id, ps AS positive_score, ns AS negative_score FROM n WHERE k <= 10
""",
    "op13_ngram_join": r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id,
    list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT DISTINCT r, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 3], ' ') END AS g
  FROM d, LATERAL (SELECT unnest(range(1, greatest(len(w) - 2, 2))) AS i) WHERE len(w) > 0),
sizes AS (SELECT r, count(*) AS n FROM s GROUP BY r),
shared AS (SELECT a.r AS a, b.r AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.r <> b.r GROUP BY ALL),
linked AS (SELECT a, b FROM shared JOIN sizes x ON x.r = a JOIN sizes y ON y.r = b WHERE 100 * o >= 85 * (x.n + y.n - o)),
reach AS (SELECT r AS a, r AS b FROM d UNION SELECT reach.a, linked.b FROM reach JOIN linked ON reach.b = linked.a)
SELECT d.doc_id, CAST(coalesce(sizes.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM d LEFT JOIN sizes ON d.r = sizes.r JOIN (SELECT reach.a, min(o.doc_id) AS component_id FROM reach JOIN d o ON reach.b = o.r GROUP BY reach.a) c ON c.a = d.r
""",
}
