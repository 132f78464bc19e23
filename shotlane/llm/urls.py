"""URL filtering by association rules.

1. A url becomes a set of tokens: scheme, host labels with their place from the right, path words, query keys, number shapes.
2. Labels come from the given rules (host and path patterns, the longest fitting one decides): urls that a rule covers are labelled.
3. Spark's FP-growth mines frequent token combinations together with the label; rules that conclude the label
   are pruned by support, confidence and by any shorter rule that is as sure.  Before it, what can only repeat rules
   is taken out, so that many tokens shared by the same urls don't make exponentially many sets: tokens with equal url sets
   become one item (a url has it if it has any of them, the rules they would each have), and a token that is always on one label, or on every
   url, makes its own rule and no longer one.
4. Matching goes through an inverted index: a rule is listed under the tokens of its rarest item; a url's
   tokens look up rules, and the other items of the rule are then checked in the url's set.
5. A url without a given rule gets the verdict of its surest matched rule (by confidence, support, verdict and text, the largest first), else allow.

Work is done once per distinct url.  Only DataFrame and ML operations; no Python runs in tasks.

Defined cases: null urls and urls without "://" have empty host and path, fit no rule and are allowed; repeated rows get equal results;
with no labelled url no rules are mined.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shotlane.session import cut

#: A rule needs LEAST_URLS labelled urls whatever the size, or SUPPORT of them where that is fewer.
SUPPORT, LEAST_URLS, CONFIDENCE = 0.05, 20, 0.9


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The given rules.
RULES = (Rule("org", "/", "allow"), Rule("example.org", "/es/", "block"), Rule("example.org", "/en/1", "block"), Rule("com", "/fr/", "allow"), Rule("com", "/de/", "block"))
LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(df: DataFrame, url: str = "url") -> DataFrame:
    """``df`` plus host and path."""
    u = F.coalesce(F.col(url), F.lit(""))
    rest = F.when(F.instr(u, "://") > 0, F.substring(u, F.instr(u, "://") + 3, F.length(u))).otherwise("")
    df = df.withColumn("__rest", rest)
    host = F.regexp_extract("__rest", r"(?s)^([^/?#]*)", 1)
    df = df.withColumn("__host", host)
    tail = F.substring(F.col("__rest"), F.length("__host") + 1, F.length("__rest") + 1)
    return df.withColumns({"host": F.translate("__host", *LOWER), "path": F.regexp_extract(tail, r"(?s)^([^?#]*)", 1)}).drop("__rest", "__host")


def given_rule(rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits (host, path), or nulls; rules of equal length: the first listed."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.name), reverse=True)[::-1]:
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        name, verdict = F.when(fits, r.name).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


def tokens(url: str = "url") -> Column:
    """Distinct tokens of a url that has host and path columns."""
    labels = F.reverse(F.split("host", r"\."))
    hosts = F.transform(labels, lambda x, i: F.concat(F.lit("h"), F.least(i, F.lit(3)).cast("string"), F.lit(":"), x))
    shape = lambda x: F.regexp_replace(x, "[0-9]+", "9")
    segments = F.transform(F.filter(F.split("path", "/"), lambda x: x != ""), lambda x: F.concat(F.lit("p:"), shape(F.translate(x, *LOWER))))
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("q:"), F.split(x, "=")[0]))
    scheme = F.array(F.concat(F.lit("s:"), F.substring_index(F.coalesce(url, F.lit("")), "://", 1)))
    leading = F.array(F.concat(F.lit("d:"), F.regexp_extract("path", r"/([0-9])[^/]*/?$", 1)))
    end = F.array(F.when(F.coalesce(url, F.lit("")).contains("#"), F.lit("f:1")).otherwise(F.lit("f:0")))
    return F.array_distinct(F.concat(scheme, hosts, segments, keys, leading, end))


def items(rows: DataFrame, least: int) -> DataFrame:
    """item (one of its tokens), tokens, n and the label's best: verdict and hits; from rows (row, verdict, tokens), items on ``least`` urls or more."""
    each = rows.select("row", "verdict", F.explode("tokens").alias("token"))
    mark = F.xxhash64("row")
    by = each.groupBy("token", "verdict").agg(F.count("*").alias("hits"), F.bit_xor(mark).alias("x"), F.sum(mark.cast("decimal(38,0)")).alias("s"))
    per = by.groupBy("token").agg(F.sum("hits").alias("n"), F.bit_xor("x").alias("x"), F.sum("s").alias("s"), F.max(F.struct("hits", "verdict")).alias("best")).filter(F.col("n") >= least)
    same = per.groupBy("n", "x", "s").agg(F.array_sort(F.collect_list("token")).alias("tokens"), F.max("best").alias("best"))  # one url has them all, so they are few
    return same.select(F.array_min("tokens").alias("item"), "tokens", "n", F.col("best.hits").alias("hits"), F.col("best.verdict").alias("verdict"))


def mine(labelled: DataFrame, support: float | None = None, confidence: float = CONFIDENCE) -> DataFrame:
    """Association rules (rule_id, antecedent, alternatives, verdict, confidence, support) from rows (tokens, verdict); ``support`` is a share, None for that of LEAST_URLS.

    ``alternatives`` has, for each item of the antecedent, the tokens that stand for it.
    """
    rows = cut(labelled.select(F.monotonically_increasing_id().alias("row"), "tokens", "verdict"), "labelled-urls")
    n = rows.count()
    support = min(SUPPORT, LEAST_URLS / max(n, 1)) if support is None else support
    every = cut(items(rows, math.ceil(support * n - 1e-9)), "url-items")
    alone = F.col("hits") == F.col("n")
    plain = (alone | (F.col("n") == n)) & (F.col("hits") >= confidence * F.col("n"))
    sure = every.filter(plain).select(F.array("item").alias("antecedent"), "verdict", (F.col("hits") / F.col("n")).alias("confidence"), (F.col("hits") / F.lit(max(n, 1))).alias("support"))
    mixed = every.filter(~alone & (F.col("n") < n)).select("item", F.explode("tokens").alias("token"))
    label = F.concat(F.lit("label:"), F.col("verdict"))
    met = rows.select("row", F.explode("tokens").alias("token")).join(mixed, "token").groupBy("row").agg(F.collect_set("item").alias("items"))
    baskets = rows.join(met, "row", "left").select(F.concat(F.coalesce("items", F.array().cast("array<string>")), F.array(label)).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(baskets)
    sets = cut(model.freqItemsets, "itemsets")
    is_label = lambda x: x.startswith("label:")
    split = sets.select(F.array_sort(F.filter("items", lambda x: ~is_label(x))).alias("antecedent"), F.try_element_at(F.filter("items", is_label), F.lit(1)).alias("label"), "freq")
    bodies = split.filter("label IS NULL").select("antecedent", F.col("freq").alias("covered"))
    rules = split.filter("label IS NOT NULL AND size(antecedent) > 0").join(bodies, "antecedent").withColumn("confidence", F.col("freq") / F.col("covered")).filter(F.col("confidence") >= confidence)
    rules = rules.select("antecedent", F.substring("label", 7, 100).alias("verdict"), "confidence", (F.col("freq") / F.lit(max(n, 1))).alias("support"))
    rules = cut(rules.unionByName(sure).withColumn("rule_id", F.xxhash64("antecedent", "verdict")), "rules")
    # a rule is redundant if one of its items can go and the shorter rule is as sure
    shorter = rules.select("rule_id", "verdict", "confidence", F.explode("antecedent").alias("token"), "antecedent").select("rule_id", "verdict", "confidence", F.array_remove("antecedent", F.col("token")).alias("antecedent"))
    better = rules.select("antecedent", "verdict", F.col("confidence").alias("c"))
    redundant = shorter.join(better, ["antecedent", "verdict"]).filter("c >= confidence").select("rule_id").distinct()
    left = rules.join(redundant, "rule_id", "left_anti")
    meant = left.select("rule_id", F.explode("antecedent").alias("item")).join(every.select("item", "tokens"), "item").groupBy("rule_id").agg(F.collect_list("tokens").alias("alternatives"))
    return left.join(meant, "rule_id")


def match(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The surest rule of each url that has one: (url_id, verdict, confidence)."""
    postings = rules.select("rule_id", F.posexplode("alternatives").alias("at", "meant")).select("rule_id", "at", "meant", F.explode("meant").alias("token"))
    seen = urls.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    counted = postings.join(seen, "token", "left").groupBy("rule_id", "at", "meant").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"))
    rarest = counted.groupBy("rule_id").agg(F.min(F.struct("n", "at", "meant")).getField("meant").alias("meant"))
    index = cut(rules.join(rarest.select("rule_id", F.explode("meant").alias("token")), "rule_id"), "url-index")
    met = urls.select("url_id", "tokens", F.explode("tokens").alias("token")).join(index, "token")
    fits = met.filter(F.forall("alternatives", lambda a: F.arrays_overlap(a, F.col("tokens"))))
    key = F.struct(F.col("confidence"), F.col("support"), F.col("verdict"), F.array_join("antecedent", " ").alias("rule"))
    return fits.groupBy("url_id").agg(F.max(key).alias("best")).select("url_id", F.col("best.verdict").alias("mined"), F.col("best.rule").alias("mined_rule"))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, support: float | None = None, confidence: float = CONFIDENCE) -> DataFrame:
    """page_id, host, path, rule, verdict and mined_rule of every row."""
    name, verdict = given_rule(rules)
    rows = split_url(pages.select("page_id", F.col("url").cast("string").alias("url"))).withColumns({"rule": name, "given": verdict})
    distinct = rows.select("url", "host", "path", "given").filter("host <> ''").distinct()
    urls = cut(distinct.select(F.xxhash64("url").alias("url_id"), F.xxhash64(F.lit(7), "url").alias("url_id2"), "given", tokens().alias("tokens")), "urls")
    key = F.struct("url_id", "url_id2").alias("url_id")
    labelled = urls.filter("given IS NOT NULL").select("tokens", F.col("given").alias("verdict"))
    open_ = urls.filter("given IS NULL").select(key, "tokens")
    if labelled.limit(1).count():
        found = match(open_, mine(labelled, support, confidence)).select("url_id.*", "mined", "mined_rule")
    else:
        found = urls.limit(0).select("url_id", "url_id2", F.lit("").alias("mined"), F.lit("").alias("mined_rule"))
    keyed = rows.withColumns({"url_id": F.xxhash64("url"), "url_id2": F.xxhash64(F.lit(7), "url")})
    out = keyed.join(found, ["url_id", "url_id2"], "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("given", "mined", F.lit("allow")).alias("verdict"), "mined_rule")
