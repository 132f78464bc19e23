"""Toxicity by maximum-scoring segments.

1. Token log-odds.  A word counts once per training document, as itself and as its
   first 6, 5, 4 and 3 bytes.  The toxic share of each such token is a posterior mean
   with a Dirichlet prior centred on that of the next shorter one (the shortest
   on the share of all documents), so an unseen word is judged by how it begins.
   The prior's weight on "no evidence" and a drift make ordinary words slightly negative.
2. Segments.  All maximal-scoring segments of a document are found in one linear
   scan (Ruzzo and Tompa); those whose score is rare by the extreme-value law of
   maximal segments (Karlin and Altschul: E = K n exp(-lambda S)) are its toxic passages.
3. Document score.  The evidence, -log E of the best passage and the sum over significant ones,
   is turned into a probability by a two-parameter logistic curve, and weighted back to the label
   shares of all training rows.

The model is fitted on a bounded sample (``per_class`` labelled rows of each class), equal texts counted once: the
calibration on a third of it with counts from the other two, the final counts on all of it.  Every
document's whole text is scored.  Inputs of a score are the text alone.

Defined cases: null and empty texts have no tokens and get the score of a document without evidence;
equal texts get equal scores; without labels of both classes every score is the toxic share of the labels (0 if there are none).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from shotlane.llm import words as W
from shotlane.llm.common import held_out, label_sample, map_text, set_aside, whole_text, without
from shotlane.session import cut

_U = np.uint64
#: Levels of a token: whole word, then its first so many bytes.
LEVELS = (None, 6, 5, 4, 3)
PER_CLASS, PRIOR, DRIFT = 12_000, 4.0, 2.0
#: Documents with a token, by label; in all rows of the sample and in those that the trial model counts.
COUNTS = ["toxic", "clean", "fit_toxic", "fit_clean"]
RESULT = ["score", "predicted", "passages"]


@dataclass
class Model:
    """Token scores (sorted hashes and values by level), extreme-value parameters and the logistic curve."""

    hashes: list[np.ndarray]
    values: list[np.ndarray]
    base: float
    lam: float
    log_k: float
    slope: float
    offset: float

    def token_scores(self, w: W.Words) -> np.ndarray:
        """The score of the longest known form of each word; unknown words get the base score."""
        out = np.full(len(w.start), self.base)
        open_ = np.ones(len(w.start), dtype=bool)
        for level, keys, values in zip(LEVELS, self.hashes, self.values):
            if not len(keys) or not open_.any():
                continue
            h = w.hashes(level)
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hit = open_ & (keys[at] == h)
            out[hit] = values[at[hit]]
            open_ &= ~hit
        return out


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, past the last, score), in order, in linear time."""
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    at = np.flatnonzero(scores > 0)
    found: list[tuple[int, int, float, float]] = []  # first, past the last, sum before, sum after
    lower: list[int] = []  # the nearest earlier segment with a smaller sum before, so that no segment is passed over twice
    for i, before, after in zip(at.tolist(), sums[at].tolist(), sums[at + 1].tolist()):
        seg, j = (i, i + 1, before, after), len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= seg[2]:
                j = lower[j]
            if j < 0 or found[j][3] >= seg[3]:
                break
            seg, k = (found[j][0], seg[1], found[j][2], seg[3]), lower[j]
            del found[j:], lower[j:]
            j = k
        found.append(seg)
        lower.append(j)
    return [(a, b, r - l) for a, b, l, r in found]


def _count_step():
    def step(texts: pa.Array) -> list:
        w = W.split(texts)
        forms = [w.hashes(n).astype(np.int64) for n in LEVELS] + [np.zeros(len(w.start), dtype=np.int64)]
        rows, levels, tokens, parents = [], [], [], []
        for level, h in enumerate(forms[:-1]):
            order = np.lexsort((h, w.row))
            r, k = w.row[order], h[order]
            new = np.append(True, (r[1:] != r[:-1]) | (k[1:] != k[:-1])) if len(r) else np.zeros(0, dtype=bool)
            rows.append(r[new])
            levels.append(np.full(len(rows[-1]), level, dtype=np.int32))
            tokens.append(k[new])
            parents.append(forms[level + 1][order][new])
        row = np.concatenate(rows)
        order = np.argsort(row, kind="stable")
        ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(texts)))]).astype(np.int32)
        columns = [np.concatenate(x)[order] for x in (levels, tokens, parents)]
        found = pa.StructArray.from_arrays([pa.array(x) for x in columns], names=["level", "token", "parent"])
        return [pa.ListArray.from_arrays(pa.array(ends), found)]

    return step


def _signals(model: Model, w: W.Words) -> tuple[np.ndarray, list[list[tuple[int, int, float]]]]:
    """Evidence of each text, and its significant passages as word ranges."""
    s, counts = model.token_scores(w), w.counts()
    bounds = np.concatenate([[0], np.cumsum(counts)])
    evidence, passages = np.zeros(len(counts)), []
    for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
        kept = []
        for x, y, score in maximal_segments(s[a:b]):
            rare = model.lam * score - model.log_k - np.log(max(int(b - a), 1))
            if rare > 0:
                kept.append((int(a) + x, int(a) + y, float(rare)))
        passages.append(kept)
        evidence[i] = np.log1p(sum(r for _, _, r in kept))
    return evidence, passages


def _score_step(model: Model, cut_at: float):
    def start():
        def step(texts: pa.Array) -> list:
            w = W.split(texts)
            evidence, passages = _signals(model, w)
            score = 1 / (1 + np.exp(-np.clip(model.slope * evidence + model.offset, -40, 40)))
            spans = [[{"start": int(w.start[x] - w.offsets[i]), "end": int(w.end[y - 1] - w.offsets[i]), "evidence": e} for x, y, e in p] for i, p in enumerate(passages)]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("evidence", pa.float64())]))
            return [pa.array(score, pa.float64()), pa.array((score >= cut_at).astype(np.int32)), pa.array(spans, kind)]

        return step

    return start


def _evidence_step(model: Model):
    def start():
        def step(texts: pa.Array) -> list:
            w = W.split(texts)
            s, counts = model.token_scores(w), w.counts()
            bounds = np.concatenate([[0], np.cumsum(counts)])
            best = [max((x[2] for x in maximal_segments(s[a:b])), default=0.0) for a, b in zip(bounds, bounds[1:])]
            return [pa.array(counts, pa.int64()), pa.array(best, pa.float64()), pa.array(_signals(model, w)[0], pa.float64())]

        return step

    return start


def _token_table(tokens: list[dict[str, np.ndarray]], toxic: str, clean: str, n_toxic: int, n_clean: int) -> Model:
    """Scores from document counts by level: posterior log-odds, the shortest form first so that each has its prior ready.

    The prior of a token is the posterior of its shorter form without the token's own documents, so no document is counted twice.
    ``tokens`` has, for each level, token (sorted), parent and the named counts.
    """
    share = n_toxic / max(1, n_toxic + n_clean)
    # counts weighted so that both classes are equally large
    weight_t, weight_c = 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9)
    hashes, values = [], []
    above = None
    for level in reversed(range(len(LEVELS))):
        mine = tokens[level]
        t, c = mine[toxic] * weight_t, mine[clean] * weight_c
        if above is None:
            rest_t = rest_c = np.zeros(len(t))
            from_above = np.full(len(t), 0.5)
        else:
            keys, up_t, up_c, up_prior = above
            at = np.searchsorted(keys, mine["parent"])
            rest_t, rest_c, from_above = np.maximum(up_t[at] - t, 0), np.maximum(up_c[at] - c, 0), up_prior[at]
        prior = (rest_t + PRIOR * from_above) / (rest_t + rest_c + PRIOR)
        post = (t + PRIOR * prior) / (t + c + PRIOR)
        above = mine["token"], t, c, prior
        seen = t + c > 0
        hashes.insert(0, mine["token"][seen])
        values.insert(0, (np.log(post / (1 - post)) - DRIFT)[seen])
    return Model(hashes, values, -DRIFT, 1.0, 0.0, 0.0, 0.0)


def _collected(sums: DataFrame) -> list[dict[str, np.ndarray]]:
    """The counts of each level as arrays sorted by token; the labelled sample bounds them."""
    out = []
    for level in range(len(LEVELS)):
        got = sums.filter(F.col("level") == level).select("token", "parent", *COUNTS).toArrow()
        columns = {c: got[c].to_numpy() for c in got.column_names}
        columns |= {c: columns[c].view(_U) for c in ("token", "parent")}
        order = np.argsort(columns["token"])
        out.append({c: x[order] for c, x in columns.items()})
    return out


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """A weighted logistic curve in one variable by Newton's method, with a small ridge."""
    a = b = 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -40, 40)))
        g, h = weight * (p - y), weight * p * (1 - p) + 1e-9
        grad = np.array([np.sum(g * x) + 0.01 * a, np.sum(g)])
        hess = np.array([[np.sum(h * x * x) + 0.01, np.sum(h * x)], [np.sum(h * x), np.sum(h) + 1e-6]])
        step = np.linalg.solve(hess, grad)
        step *= min(1.0, 2 / max(1e-12, np.abs(step).max()))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(a), float(b)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS) -> Model:
    """The model from at most ``per_class`` training rows of each class; it holds every token of them."""
    shares = dict(labels.filter(~held_out()).groupBy(F.col(label).cast("int")).count().collect())
    n1, n0 = shares.get(1, 0), shares.get(0, 0)
    nothing = Model([np.zeros(0, _U)] * len(LEVELS), [np.zeros(0)] * len(LEVELS), -DRIFT, 1.0, 0.0, 0.0, float(np.log(max(n1, 1e-9) / max(n0, 1e-9))) if n1 + n0 else -40.0)
    if not n1 or not n0:
        return nothing
    sample = F.broadcast(label_sample(labels, label, per_class))  # at most 2 * per_class rows of two numbers
    rows = docs.select("doc_id", whole_text().alias("text")).join(sample, "doc_id").select("text", "label")
    # equal texts count once; a text with both labels counts as toxic
    rows = cut(rows.groupBy("text").agg(F.max("label").alias("label")).withColumn("tune", F.pmod(F.xxhash64("text"), F.lit(3)) == 0), "toxic-sample")
    token = StructType([StructField("level", IntegerType()), StructField("token", LongType()), StructField("parent", LongType())])
    counted = map_text(rows, ["label", "tune"], [StructField("tokens", ArrayType(token))], _count_step)
    fitting = (~F.col("tune")).cast("long")
    sums = counted.select("label", "tune", F.inline("tokens")).groupBy("level", "token").agg(
        F.min("parent").alias("parent"), F.sum("label").cast("int").alias("toxic"), F.sum(1 - F.col("label")).cast("int").alias("clean"),
        F.sum(F.col("label") * fitting).cast("int").alias("fit_toxic"), F.sum((1 - F.col("label")) * fitting).cast("int").alias("fit_clean"))
    sizes = {(r["tune"], r["label"]): r["count"] for r in rows.groupBy("tune", "label").count().collect()}
    if len(sizes) < 4:
        return nothing
    tokens = _collected(cut(sums, "toxic-tokens"))
    trial = _token_table(tokens, "fit_toxic", "fit_clean", sizes[False, 1], sizes[False, 0])
    tuned = lambda: map_text(rows.filter("tune"), ["label"], [StructField("n", LongType()), StructField("best", DoubleType()), StructField("seen", DoubleType())], _evidence_step(trial)).toPandas()
    clean = tuned().query("label == 0")
    # extreme-value fit on clean documents: lambda S - ln(K n) is Gumbel; lambda from the spread of S between its median and its
    # 99th percentile, K from the 99th percentile, so that single odd documents don't set them; E below about 0.05 counts as significant
    g50, g99 = -np.log(-np.log(0.5)), -np.log(-np.log(0.99))
    spread = float(np.quantile(clean.best, 0.99) - np.quantile(clean.best, 0.5))
    trial.lam = (g99 - g50) / max(spread, 0.5)
    trial.log_k = float(np.quantile(trial.lam * clean.best - np.log(np.maximum(clean.n, 1)), 0.99)) - g99 + 3.0
    seen = tuned()
    y = seen.label.to_numpy(float)
    weight = np.where(y == 1, n1 / max(1, y.sum()), n0 / max(1, (1 - y).sum())) * len(y) / (n1 + n0)
    # the calibration is the trial's; the tokens are counted again over the whole sample
    model = _token_table(tokens, "toxic", "clean", sizes[False, 1] + sizes[True, 1], sizes[False, 0] + sizes[True, 0])
    model.lam, model.log_k = trial.lam, trial.log_k
    model.slope, model.offset = _logistic(seen.seen.to_numpy(float), y, weight)
    return model


def score(docs: DataFrame, model: Model, keep: list[str], cut_at: float = 0.7) -> DataFrame:
    """``keep`` columns plus score, predicted and passages (byte ranges of the text with their evidence)."""
    span = StructType([StructField("start", LongType()), StructField("end", LongType()), StructField("evidence", DoubleType())])
    fields = [StructField("score", DoubleType()), StructField("predicted", IntegerType()), StructField("passages", ArrayType(span))]
    return map_text(docs, [c for c in keep if c in without(docs, RESULT)], fields, _score_step(model, cut_at))


def clean(docs: DataFrame, labels: DataFrame, cut_at: float = 0.7) -> DataFrame:
    """The documents not judged toxic, columns unchanged."""
    held, back = set_aside(docs)
    return score(held, fit(docs, labels), held.columns, cut_at).filter("predicted = 0").select(back)
