"""Ordered work on sequences of any length: exact ranks and recurrences, cut into pieces.

No key is ever gathered or walked by one task: a rank is a place in a range-sorted piece plus the rows of
the key in earlier pieces, and an affine recurrence is composed piece by piece, since two affine
steps are one affine step.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shotlane.session import cut

PIECE = 512


def exact_ranks(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str = "_r", count: str = "_count") -> DataFrame:
    """Adds each row's place within its key (from 0) and the rows of the key.

    One range sort over keys and order; the only table per key counts rows by sorted piece (one entry of a
    key for each piece that it touches).
    """
    k = list(keys)
    marked = rows.orderBy(*k, *order).withColumn("_m", F.monotonically_increasing_id())
    marked = cut(marked.withColumns({"_p": F.shiftright("_m", 33), "_o": F.col("_m").bitwiseAND((1 << 33) - 1)}).drop("_m"), "sorted-rows")
    per = marked.groupBy(*k, "_p").agg(F.min("_o").alias("_first"), F.count(F.lit(1)).alias("_n"))
    whole = per.groupBy(*k).agg(F.sort_array(F.collect_list(F.struct("_p", "_first", "_n"))).alias("_all"), F.sum("_n").alias(count))
    before = F.transform("_all", lambda q, i: F.struct(q["_p"].alias("_p"), q["_first"].alias("_first"), F.aggregate(
        F.slice("_all", F.lit(1), i), F.lit(0).cast("long"), lambda acc, e: acc + e["_n"]).alias("_before")))
    offsets = whole.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(k)], count, F.inline(before))
    same = [marked[c].eqNullSafe(offsets[f"_k{i}"]) for i, c in enumerate(k)]
    met = marked.join(offsets.hint("merge"), [*same, marked["_p"] == offsets["_p"]])
    return met.select(*[marked[c] for c in rows.columns], (F.col("_o") - F.col("_first") + F.col("_before")).alias(out), count)


def stepwise(step: Callable, lengths: np.ndarray, start: np.ndarray, *flat: np.ndarray) -> np.ndarray:
    """``step(state, *values)`` along many sequences at once, which lie one after the other in ``flat``; all states in place."""
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    by = np.argsort(-lengths, kind="stable")
    state, out = start[by].astype(float), np.empty(int(lengths.sum()))
    sizes, first = lengths[by], first[by]
    for t in range(int(sizes[0]) if len(sizes) else 0):
        live = int(np.searchsorted(-sizes, -t, side="left"))
        at = first[:live] + t
        state[:live] = step(state[:live], *[f[at] for f in flat])
        out[at] = state[:live]
    return out


def _affine(state, factor, term, start):
    return np.where(np.isnan(state), start, factor * state + term)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _states(factor: pd.Series, term: pd.Series, start: pd.Series, before: pd.Series) -> pd.Series:
    """The state after each element; a null ``before`` means none."""
    lengths = np.array([len(a) for a in factor], dtype=np.int64)
    if not lengths.sum():
        return pd.Series([np.zeros(0)] * len(lengths))
    flat = [np.concatenate(list(c)).astype(float) for c in (factor, term, start)]
    done = stepwise(_affine, lengths, before.to_numpy(dtype=float), *flat)
    return pd.Series(np.split(done, np.cumsum(lengths)[:-1]))


def affine_scan(rows: DataFrame, keys: Sequence[str], index: str, factor: Column, terms: dict[str, tuple[Column, Column]], piece: int = PIECE) -> DataFrame:
    """States of ``state = factor * state + term`` along ``index`` (whole numbers, unique within a key), one column per entry of ``terms``.

    ``terms``: name to (term, value of the state where there is none before).  No input may be null.  Pieces of
    ``piece`` index values are composed to one step each; a key's steps give the states at the piece borders, and every piece
    is then walked from its border.  Columns: keys, index, names.
    """
    k, names = list(keys), list(terms)
    cols = [F.col(index).alias("_i"), factor.cast("double").alias("_f")]
    cols += [x.cast("double").alias(f"_{kind}{j}") for j, c in enumerate(names) for kind, x in zip("ts", terms[c])]
    at = F.floor(F.col(index) / F.lit(piece)).cast("long").alias("_piece")
    pieces = rows.select(*k, at, F.struct(*cols).alias("_e")).groupBy(*k, "_piece").agg(F.sort_array(F.collect_list("_e")).alias("_s"))
    pieces = cut(pieces, "scan-pieces")

    def composed(acc, e):
        parts = [(acc["f"] * e["_f"]).alias("f")]
        for j in range(len(names)):
            parts.append((e["_f"] * acc[f"t{j}"] + e[f"_t{j}"]).alias(f"t{j}"))
            parts.append(F.coalesce(e["_f"] * acc[f"s{j}"] + e[f"_t{j}"], e[f"_s{j}"]).alias(f"s{j}"))
        return F.struct(*parts)

    none = F.struct(F.lit(1.0).alias("f"), *[x for j in range(len(names)) for x in (F.lit(0.0).alias(f"t{j}"), F.lit(None).cast("double").alias(f"s{j}"))])
    steps = pieces.select(*k, "_piece", F.aggregate("_s", none, composed).alias("_c"))
    lists = steps.groupBy(*k).agg(F.sort_array(F.collect_list(F.struct("_piece", "_c"))).alias("_all"))
    ends = [_states(F.col("_all._c.f"), F.col(f"_all._c.t{j}"), F.col(f"_all._c.s{j}"), F.lit(None).cast("double")).alias(f"_b{j}") for j in range(len(names))]
    lists = lists.select(*k, F.col("_all._piece").alias("_piece"), *ends)
    borders = lists.select(*k, F.posexplode("_piece").alias("_at", "_piece"), *[f"_b{j}" for j in range(len(names))])
    borders = borders.select(*k, "_piece", *[F.get(f"_b{j}", F.col("_at") - 1).alias(f"_b{j}") for j in range(len(names))])
    met = pieces.join(borders, [*k, "_piece"])
    walked = [_states(F.col("_s._f"), F.col(f"_s._t{j}"), F.col(f"_s._s{j}"), F.col(f"_b{j}")).alias(f"_w{j}") for j in range(len(names))]
    done = met.select(*k, F.col("_s._i").alias("_i"), *walked)
    return done.select(*k, F.inline(F.arrays_zip("_i", *[f"_w{j}" for j in range(len(names))]))).select(
        *k, F.col("_i").alias(index), *[F.col(f"_w{j}").alias(c) for j, c in enumerate(names)])
