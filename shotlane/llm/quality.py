"""Quality by co-training two views of a document.

* Text view: the content alone - hashed lower-cased words, hashed gaps between words (punctuation,
  separators), case shapes, word lengths and repetition.
* Metadata view: what is known about the page without reading it - source, language, stated length.

Each view is a logistic regression (Spark ML).  In each round both are fitted to the
labelled rows and to rows the *other* view was sure about; then their
calibrated probabilities are computed for every unlabelled document, and confident ones (both sides,
``sure``) become pseudo-labels for the other view.  A view that separates nothing is never sure
and hands over nothing.  At the end the two calibrated log-odds are combined by a
logistic regression on labelled rows kept out of the fit, and every document is scored.

The fit uses bounded samples by hash of the id: ``per_class`` labelled rows of each class and, of the rows that a view is
sure about in a round, ``per_pseudo`` of each class, drawn from all unlabelled documents.  Every round scores every unlabelled document's whole
text in a pass of its own, and the end scores all documents in another.

Defined cases: null and empty texts have all-zero text features; null metadata is a value of its own;
equal rows get equal scores; without labels of both classes the score is the share of label 1 (0 if there is none).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, StructField

from shotlane.llm import words as W
from shotlane.llm.common import held_out, label_sample, map_text, whole_text
from shotlane.session import cut

PER_CLASS, PER_PSEUDO, ROUNDS, SURE = 8_000, 8_000, 2, 0.95
N_WORD, N_GAP, N_SHAPE = 128, 128, 12
N_TEXT = N_WORD + N_GAP + N_SHAPE
SOURCES, LANGS, SIZES = 32, 8, 12


def _hashed(row: np.ndarray, bucket: np.ndarray, n: int, width: int) -> np.ndarray:
    return np.bincount(row * width + bucket, minlength=n * width).reshape(n, width)[:, :width].astype(np.float64)


def text_features(texts: pa.Array) -> np.ndarray:
    """One row of N_TEXT numbers per text: square roots of relative frequencies, and shapes."""
    w = W.split(texts)
    n, counts = len(texts), np.maximum(w.counts(), 1)
    out = np.zeros((n, N_TEXT), dtype=np.float32)
    if not len(w.start):
        return out
    h = w.hashes()
    out[:, :N_WORD] = np.sqrt(_hashed(w.row, (h % np.uint64(N_WORD)).astype(np.int64), n, N_WORD) / counts[:, None])
    # the gap after a word, to the next word of the same text or the text's end, as a hash of its first 8 bytes
    nxt = np.append(w.start[1:], len(w.raw))
    nxt = np.minimum(nxt, w.offsets[w.row + 1])
    size = nxt - w.end
    code = size.astype(np.uint64)
    padded = np.append(w.raw, np.zeros(8, np.uint8)).astype(np.uint64)
    for k in range(8):
        code = code * np.uint64(1099511628211) + np.where(size > k, padded[w.end + k], 0).astype(np.uint64)
    out[:, N_WORD : N_WORD + N_GAP] = np.sqrt(_hashed(w.row, (W.mixed(code) % np.uint64(N_GAP)).astype(np.int64), n, N_GAP) / counts[:, None])
    share = lambda flag: np.bincount(w.row, weights=flag, minlength=n) / counts
    first = w.raw[w.start]
    last = w.raw[w.end - 1]
    upper = lambda x: (x >= 65) & (x <= 90)
    length = w.end - w.start
    repeated = np.zeros(len(h))
    order = np.lexsort((h, w.row))
    repeated[order[1:]] = (h[order][1:] == h[order][:-1]) & (w.row[order][1:] == w.row[order][:-1])
    again = np.append(False, (h[1:] == h[:-1]) & (w.row[1:] == w.row[:-1]))
    shapes = [share(upper(first) & upper(last) & (length > 1)), share(upper(first)), share((first >= 48) & (first <= 57)), share(length <= 2), share(length >= 12), share(np.minimum(length, 40) / 10), share(repeated), share(again),
              share(size > 2), share(np.minimum(size, 40) / 10), np.log1p(counts) / 10, (w.counts() > 0).astype(float)]
    out[:, N_WORD + N_GAP :] = np.stack(shapes, axis=1)
    return out


def _feature_step():
    def step(texts: pa.Array) -> list:
        x = text_features(texts)
        return [pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1), pa.float32()), N_TEXT).cast(pa.list_(pa.float32()))]

    return step


def metadata_bins() -> list[Column]:
    """Indices of the three metadata values: hashed source, hashed language, size class of the stated length."""
    bucket = lambda c, n: F.when(F.col(c).isNull(), n - 1).otherwise(F.pmod(F.xxhash64(F.col(c).cast("string")), F.lit(n - 1))).cast("int")
    size = F.least(F.floor(F.log1p(F.greatest(F.coalesce(F.col("n_chars"), F.lit(0)), F.lit(0)))), F.lit(SIZES - 1)).cast("int")
    return [bucket("source", SOURCES).alias("m_source"), bucket("lang", LANGS).alias("m_lang"), size.alias("m_size")]


def _metadata_vector() -> Column:
    one = lambda c, n: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (i == F.col(c)).cast("double"))
    return array_to_vector(F.concat(one("m_source", SOURCES), one("m_lang", LANGS), one("m_size", SIZES)))


def _fit(rows: DataFrame, features: str, strength: float) -> tuple[np.ndarray, float]:
    model = LogisticRegression(featuresCol=features, labelCol="y", weightCol="w", regParam=strength, maxIter=15, standardization=True).fit(rows)
    return np.asarray(model.coefficients.toArray()), float(model.intercept)


def _margin(features: str, weights: tuple[np.ndarray, float]) -> Column:
    beta = F.from_json(F.lit("[" + ",".join(repr(float(v)) for v in weights[0]) + "]"), "array<double>")
    return F.aggregate(F.zip_with(vector_to_array(features), beta, lambda a, b: a * b), F.lit(float(weights[1])), lambda s, v: s + v)


class Model:
    """Weights of both views, their calibration, and the combination."""

    def __init__(self, text, meta, combined, share):
        self.text, self.meta, self.combined, self.share = text, meta, combined, share


def _features(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """label and both feature vectors of the documents in ``ids`` (doc_id, label), a bounded sample."""
    picked = docs.select("doc_id", "text", *metadata_bins()).join(F.broadcast(ids), "doc_id")
    rows = cut(map_text(picked, ["doc_id", "label", "m_source", "m_lang", "m_size"], [StructField("x", ArrayType(FloatType()))], _feature_step), "quality-sample")
    return rows.select("doc_id", "label", array_to_vector(F.col("x").cast("array<double>")).alias("fa"), _metadata_vector().alias("fb")).repartition(8, "doc_id")


def _pseudo_rows(docs: DataFrame, taken: DataFrame, text: tuple, meta: tuple, most: int, sure: float) -> dict[str, DataFrame]:
    """Rows of pseudo-labels by the view that learns from them: at most ``most`` of each class that the other view is sure about, of all documents but ``taken``."""
    edge = float(np.log(sure / (1 - sure)))
    sides = _logits(docs, text, meta).filter(f"doc_id IS NOT NULL AND (abs(text_logit) >= {edge} OR abs(meta_logit) >= {edge})")
    seen = cut(sides.select("doc_id", "text_logit", "meta_logit").join(taken, "doc_id", "left_anti"), "quality-sure")
    out = {}
    for f, said in (("fa", "meta_logit"), ("fb", "text_logit")):
        parts = [seen.filter(on).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).withColumn("label", F.lit(y)) for y, on in ((0, F.col(said) <= -edge), (1, F.col(said) >= edge))]
        # a repeated id that got both counts as the larger one
        ids = parts[0].unionByName(parts[1]).groupBy("doc_id").agg(F.max("label").alias("label"))
        out[f] = cut(_features(docs, ids), "quality-pseudo")
    return out


def _logits(docs: DataFrame, text: tuple, meta: tuple) -> DataFrame:
    """doc_id and the calibrated log-odds of both views, text_logit and meta_logit, of every row."""
    beta, shift = text

    def start():
        def step(texts: pa.Array) -> list:
            return [pa.array(text_features(texts) @ beta + shift, pa.float64())]

        return step

    rows = map_text(docs.select("doc_id", "text", *metadata_bins()), ["doc_id", "m_source", "m_lang", "m_size"], [StructField("text_logit", DoubleType())], start)
    weights = F.from_json(F.lit("[" + ",".join(repr(float(v)) for v in meta[0]) + "]"), "array<double>")
    at = lambda i: F.element_at(weights, (i + 1).cast("int"))
    return rows.withColumn("meta_logit", at(F.col("m_source")) + at(F.col("m_lang") + SOURCES) + at(F.col("m_size") + SOURCES + LANGS) + F.lit(meta[1]))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS, per_pseudo: int = PER_PSEUDO, rounds: int = ROUNDS, sure: float = SURE) -> Model:
    shares = dict(labels.filter(~held_out()).groupBy(F.col(label).cast("int")).count().collect())
    n1, n0 = shares.get(1, 0), shares.get(0, 0)
    nothing = Model(None, None, None, n1 / max(1, n1 + n0))
    if not n1 or not n0:
        return nothing
    known = label_sample(labels, label, per_class)
    taken = labels.filter(~held_out()).select("doc_id").distinct()  # all others are unlabelled, held-out ones too: their labels are not read
    rows = _features(docs, known).withColumn("tune", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(4)) == 0)
    rows = cut(rows, "quality-features")
    sizes = {(r["tune"], r["label"]): r["count"] for r in rows.groupBy("tune", "label").count().collect()}
    if len(sizes) < 4:
        return nothing
    of = {v: sizes[False, v] for v in (0, 1)}
    weight = lambda y: F.when(y == 1, n1 / of[1]).otherwise(n0 / of[0]) / ((n1 + n0) / (of[0] + of[1]))
    own = rows.filter("not tune").select(F.col("label").cast("double").alias("y"), weight(F.col("label")).alias("w"), "fa", "fb")
    fold = lambda f: (views[f][0][0] * views[f][1][0], views[f][0][1] * views[f][1][0] + views[f][1][1])
    pseudo: dict[str, DataFrame] = {}  # what the other view said, by view; the fold that calibrates takes none
    for k in range(rounds + 1):
        views = {}
        for f, strength in (("fa", 0.002), ("fb", 0.05)):
            train = own.select("y", "w", f)
            if f in pseudo:
                train = train.unionByName(pseudo[f].select(F.col("label").cast("double").alias("y"), F.lit(0.3).alias("w"), f))
            beta = _fit(train, f, strength)
            tune = rows.filter("tune").select(F.col("label").cast("double").alias("y"), _margin(f, beta).alias("m"), weight(F.col("label")).alias("w"))
            views[f] = (beta, _line(tune, "m"))
        if k < rounds:
            pseudo = _pseudo_rows(docs, taken, fold("fa"), fold("fb"), per_pseudo, sure)
    tune = rows.filter("tune").select(F.col("label").cast("double").alias("y"), weight(F.col("label")).alias("w"), *[(_margin(f, b) * c[0] + F.lit(c[1])).alias(f"z{f}") for f, (b, c) in views.items()])
    got = tune.toPandas()  # part of the bounded sample: three numbers a row
    a, b, c = _plane(got[["zfa", "zfb"]].to_numpy(), got.y.to_numpy(), got.w.to_numpy())
    return Model(fold("fa"), fold("fb"), (a, b, c), n1 / (n1 + n0))


def _line(rows: DataFrame, column: str) -> tuple[float, float]:
    got = rows.select(column, "y", "w").toPandas()  # the calibration fold of the bounded sample
    a, _, c = _plane(np.stack([got[column].to_numpy(), np.zeros(len(got))], axis=1), got.y.to_numpy(), got.w.to_numpy())
    return a, c


def _plane(z: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float, float]:
    """Weighted logistic regression on two calibrated log-odds by Newton steps, lightly tied to zero; negative weights are set to zero."""
    x = np.column_stack([np.clip(z, -20, 20), np.ones(len(z))])
    beta = np.zeros(3)
    tie = np.diag([0.1, 0.1, 1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (w * p * (1 - p) + 1e-9)[:, None]).T @ x + tie, x.T @ (w * (p - y)) + tie @ beta)
        beta = beta - step * min(1.0, 2 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return max(0.0, float(beta[0])), max(0.0, float(beta[1])), float(beta[2])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, text_logit and meta_logit (calibrated log-odds of the views) and predicted (score of a half or more) of every row."""
    if model.text is None:
        return docs.select("doc_id", F.lit(float(model.share)).alias("score"), F.lit(0.0).alias("text_logit"), F.lit(0.0).alias("meta_logit"), F.lit(int(model.share >= 0.5)).alias("predicted"))
    rows = _logits(docs, model.text, model.meta)
    a, b, c = model.combined
    clip = lambda x: F.greatest(F.least(F.col(x), F.lit(20.0)), F.lit(-20.0))
    p = 1 / (1 + F.exp(-(clip("text_logit") * a + clip("meta_logit") * b + F.lit(c))))
    return rows.select("doc_id", p.alias("score"), "text_logit", "meta_logit").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
