"""Spelling variants by k-d trees over letter-count vectors.

One inserted or deleted code point changes one letter count by one; a replaced one raises one count and
lowers another: the vectors of near words are at L1 distance two at most.  So near words of length L are
found in two range searches, in the tree of the words of length L (at most one count up and one
down) and in that of length L + 1 (one up, none down).

1. Words.  Runs of letters are counted on the JVM, one row per distinct word.
2. Cells.  For each length a k-d tree is cut from a bounded sample of words (``SAMPLE`` in all) until a leaf
   stands for at most ``CELL`` words of the whole vocabulary.  The sample only places the cuts: every word is a member of the
   cell that holds its vector, and asks every cell whose box its range meets.  Boxes fill the space, so no pair is lost.
3. Search.  A task reads one cell's members, builds the tree down to ``LEAF`` words with tight boxes, and streams
   the asking words through it; what reaches a leaf is verified letter by letter.
4. Forms.  Near words are counted and the most frequent kept by a map-side aggregate.  A form is ten times as
   frequent as its word, so chains are short: the roots come from pointer doubling, log2(log10(largest n)) rounds.

A word's near words are bounded by its length (some 180 a letter), not by the data.

Defined cases: null and empty texts have no words; repeated rows count as often as they occur; a null doc_id is written as
the empty string; ties of n go to the smaller word by code points; an empty table gives an empty result; no other column is read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shotlane.llm.common import whole_text
from shotlane.session import cut

#: Least length and least occurrences of a word; a text's run is damaged where DAMAGE divides its hash.
LEAST_LENGTH, LEAST_COUNT, DAMAGE, FORM_RATIO = 7, 2, 31, 10
#: Words of the sample, members of a cell, members of a leaf of the search, letters compared at once.
SAMPLE, CELL, LEAF, AT_ONCE = 100_000, 4096, 48, 1 << 22
LETTERS = 26 + 64
_UPPER, _LOWER = "".join(map(chr, range(65, 91))), "".join(map(chr, range(97, 123)))


def damaged(doc_id: Column, run: Column) -> Column:
    """The lower-cased run, one code point short where ``DAMAGE`` divides the crc32 of ``<doc_id>:<run>``."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.char_length(run)).cast("int")
    return F.when(h % DAMAGE == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))).otherwise(run)


def vocabulary(docs: DataFrame) -> DataFrame:
    """word, n of every word of ``LEAST_LENGTH`` letters and ``LEAST_COUNT`` occurrences."""
    runs = F.regexp_extract_all(whole_text(), F.lit(f"[A-Za-z\\u00C0-\\u00FF]{{{LEAST_LENGTH},}}"), F.lit(0))
    run = docs.select("doc_id", F.explode(runs).alias("run")).select("doc_id", F.translate("run", _UPPER, _LOWER).alias("run"))
    words = run.select(damaged(F.col("doc_id"), F.col("run")).alias("word")).filter(F.char_length("word") >= LEAST_LENGTH)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def codes(words: list[str], length: int) -> np.ndarray:
    """Code points of words of one length, a row each; all are below 256."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), length)


def letter_counts(c: np.ndarray) -> np.ndarray:
    """Letter-count vectors (a-z, then from U+00C0 on).  Counts stop at 32,767; that only brings vectors closer."""
    slot = np.where(c < 192, c - 97, c.astype(np.int64) - 192 + 26).astype(np.int64)
    at = slot + np.arange(len(c))[:, None] * LETTERS
    return np.minimum(np.bincount(at.ravel(), minlength=len(c) * LETTERS), 32767).astype(np.int16).reshape(len(c), LETTERS)


@dataclass
class Tree:
    """Inner nodes: a letter and the last count that goes left.  Leaves have letter -1 and their number in ``left``."""

    letter: list[int]
    last: list[int]
    left: list[int]
    right: list[int]
    members: list[np.ndarray]

    def visits(self, x: np.ndarray, up: np.ndarray, down: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, rows of ``x``) of every leaf box that a row's range meets.

        ``up`` and ``down``: what each row may still gain or lose; ``low`` and ``high``: the root's box.
        """
        stack = [(0, np.arange(len(x)), up, down, low, high)]
        while stack:
            node, rows, up, down, low, high = stack.pop()
            letter = self.letter[node]
            if letter < 0:
                yield self.left[node], rows
                continue
            last, at = self.last[node], x[rows, letter]
            beyond = np.maximum(at - high[letter], 0)
            less = down - (np.maximum(at - last, 0) - beyond)
            before = np.maximum(low[letter] - at, 0)
            more = up - (np.maximum(last + 1 - at, 0) - before)
            for child, keep, u, d, lo, hi in ((self.left[node], less >= 0, up, less, low[letter], last), (self.right[node], more >= 0, more, down, last + 1, high[letter])):
                if keep.any():
                    a, b = low.copy(), high.copy()
                    a[letter], b[letter] = lo, hi
                    stack.append((child, rows[keep], u[keep], d[keep], a, b))


def grow(x: np.ndarray, most: float) -> Tree:
    """A k-d tree with at most ``most`` rows of ``x`` in a leaf, but for rows that no letter tells apart; each cut is the most even one."""
    tree = Tree([], [], [], [], [])
    todo = [(np.arange(len(x)), None, 0)]
    while todo:
        rows, parent, side = todo.pop()
        node = len(tree.letter)
        if parent is not None:
            (tree.right if side else tree.left)[parent] = node
        for a in (tree.letter, tree.last, tree.left, tree.right):
            a.append(-1)
        found = _even_cut(x[rows]) if len(rows) > most else None
        if found is None:
            tree.left[node] = len(tree.members)
            tree.members.append(rows)
            continue
        tree.letter[node], tree.last[node] = found
        goes = x[rows, found[0]] <= found[1]
        todo += [(rows[~goes], node, 1), (rows[goes], node, 0)]
    return tree


def _even_cut(x: np.ndarray) -> tuple[int, int] | None:
    """The letter and count that split the rows most evenly."""
    best, found = 0, None
    for last in range(int(x.max())):
        left = (x <= last).sum(axis=0)
        even = np.minimum(left, len(x) - left)
        letter = int(even.argmax())
        if even[letter] > best:
            best, found = int(even[letter]), (letter, last)
        if last >= 8 and found:  # large counts only where small ones don't tell rows apart
            break
    return found


def near(q: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows of ``q`` and ``w`` (as long, or one longer) that are one edit apart."""
    step = max(1, AT_ONCE // max(1, w.size))
    found = [_near(q[a : a + step], w) for a in range(0, len(q), step)] if len(w) else []
    return (np.concatenate([i + a * step for a, (i, _) in enumerate(found)]), np.concatenate([j for _, j in found])) if found else (np.zeros(0, int), np.zeros(0, int))


def _near(q: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = q.shape[1]
    count = np.uint8 if n < 256 else np.int32
    if n == w.shape[1]:
        differ = np.zeros((len(q), len(w)), count)
        for k in range(n):
            differ += q[:, k, None] != w[None, :, k]
        return np.nonzero(differ == 1)
    # letters that agree from the front and, one further on, from the back must cover the shorter word
    covered = np.zeros((len(q), len(w)), count)
    for order, ahead in ((range(n), 0), (range(n - 1, -1, -1), 1)):
        agree = np.ones(covered.shape, bool)
        for k in order:
            agree &= q[:, k, None] == w[None, :, k + ahead]
            covered += agree & (covered < n)
    return np.nonzero(covered >= n)


def cell_trees(words: DataFrame, sample: int, cell: int) -> dict[int, Tree]:
    """The cells' tree of each length, from about ``sample`` words, those with the smallest hashes (as vectors, so long words cost no more)."""
    total = words.count()
    share = min(1.0, sample / max(1, total))
    slots = 1 << 30
    taken = words.filter(F.pmod(F.xxhash64("word"), F.lit(slots)) < int(share * slots)) if share < 1 else words
    step = lambda batches: (_vectors(b) for b in batches)
    rows = taken.select("word").mapInArrow(step, "length bigint, vector binary").toPandas()
    out = {}
    for length, part in rows.groupby("length"):
        x = np.frombuffer(b"".join(part.vector), np.int16).reshape(len(part), LETTERS)
        out[int(length)] = grow(x, max(1.0, cell * share))
        out[int(length)].members = []  # only the cuts travel
    return out


def _by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for length in np.unique(lengths):
        yield int(length), np.flatnonzero(lengths == length)


def _vectors(batch: pa.RecordBatch) -> pa.RecordBatch:
    words = batch.column(0).to_pylist()
    sizes, vectors = [], []
    for length, at in _by_length(words):
        x = letter_counts(codes([words[i] for i in at], length))
        sizes += [length] * len(at)
        vectors += [r.tobytes() for r in x]
    return pa.RecordBatch.from_arrays([pa.array(sizes, pa.int64()), pa.array(vectors, pa.binary())], names=["length", "vector"])


def _whole_box() -> tuple[np.ndarray, np.ndarray]:
    return np.zeros(LETTERS, np.int64), np.full(LETTERS, 1 << 20, np.int64)


ASKED = "cell bigint, role int, word string, n bigint"


def _to_cells(trees: dict[int, Tree]):
    """Rows (cell, role, word, n): role 0 in the word's own cell, role 1 in every other cell that its range meets.

    A pair of one length is searched from the lower cell only, and inside a cell by its members.
    """
    one_leaf = Tree([-1], [-1], [0], [-1], [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, counts = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            for length, at in _by_length(words):
                x = letter_counts(codes([words[i] for i in at], length))
                tree, longer, zero = trees.get(length, one_leaf), trees.get(length + 1, one_leaf), np.zeros(len(x), np.int64)
                own = np.zeros(len(x), np.int64)
                cells, roles, rows = [], [], []
                for leaf, r in tree.visits(x, zero, zero, *_whole_box()):
                    own[r] = leaf
                cells.append(own), roles.append(zero), rows.append(np.arange(len(x)))
                for leaf, r in tree.visits(x, zero + 1, zero + 1, *_whole_box()):
                    r = r[own[r] < leaf]
                    cells.append(np.full(len(r), leaf)), roles.append(np.ones(len(r), np.int64)), rows.append(r)
                cells = [c + (length << 32) for c in cells]
                for leaf, r in longer.visits(x, zero + 1, zero, *_whole_box()):
                    cells.append(np.full(len(r), leaf) + ((length + 1) << 32)), roles.append(np.ones(len(r), np.int64)), rows.append(r)
                picked = pa.array(at[np.concatenate(rows)])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(cells)), pa.array(np.concatenate(roles).astype(np.int32)), batch.column(0).take(picked), pa.array(counts[picked.to_numpy()])], names=["cell", "role", "word", "n"])

    return run


class _Cell:
    """Members of one cell, with their tree."""

    def __init__(self, cell: int):
        self.cell, self.length, self.parts, self.counts, self.ready = cell, cell >> 32, [], [], False

    def add(self, words: pa.Array, counts: np.ndarray) -> None:
        self.parts.append(words)
        self.counts.append(counts)

    def settle(self) -> Iterator[pa.RecordBatch]:
        """Build the tree once all members are there, and find the near pairs among them."""
        self.ready = True
        self.words = pa.concat_arrays(self.parts) if self.parts else pa.array([], pa.string())
        self.n = np.concatenate(self.counts) if self.counts else np.zeros(0, np.int64)
        self.codes = codes(self.words.to_pylist(), self.length)
        self.x = letter_counts(self.codes)
        if len(self.words):
            self.tree = grow(self.x, LEAF)
            self.low, self.high = self.x.min(axis=0), self.x.max(axis=0)
            yield from self.search(self.words, self.n, False)

    def search(self, words: pa.Array, counts: np.ndarray, both: bool) -> Iterator[pa.RecordBatch]:
        """Near pairs of ``words`` and members, in both directions where the members don't ask back."""
        if not len(self.words):
            return
        for length, at in _by_length(words.to_pylist()):
            q = codes(words.take(pa.array(at)).to_pylist(), length)
            x = letter_counts(q)
            up = 1 - np.maximum(self.low - x, 0).sum(axis=1, dtype=np.int64)
            down = int(length == self.length) - np.maximum(x - self.high, 0).sum(axis=1, dtype=np.int64)
            open_ = np.flatnonzero((up >= 0) & (down >= 0))
            for leaf, r in self.tree.visits(x[open_], up[open_], down[open_], self.low, self.high):
                members, r = self.tree.members[leaf], open_[r]
                i, j = near(q[r], self.codes[members])
                if not len(i):
                    continue
                i, j = at[r[i]], members[j]
                mine, other = words.take(pa.array(i)), self.words.take(pa.array(j))
                yield pa.RecordBatch.from_arrays([mine, other, pa.array(self.n[j])], names=["word", "near", "near_n"])
                if both:
                    yield pa.RecordBatch.from_arrays([other, mine, pa.array(counts[i])], names=["word", "near", "near_n"])


PAIRS = "word string, near string, near_n bigint"


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near pairs from rows sorted by cell and role; one cell's members are held at a time."""
    return _joined(_pieces(batches))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now = None
    for batch in batches:
        cells, roles = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        edges = np.flatnonzero((np.diff(cells) != 0) | (np.diff(roles) != 0)) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(cells)]):
            if a == b:
                continue
            if now is None or now.cell != cells[a]:
                if now is not None and not now.ready:
                    yield from now.settle()
                now = _Cell(int(cells[a]))
            words, counts = batch.column(2).slice(a, b - a), batch.column(3).slice(a, b - a).to_numpy()
            if roles[a] == 0:
                now.add(words, counts)
                continue
            if not now.ready:
                yield from now.settle()
            yield from now.search(words, counts, True)
    if now is not None and not now.ready:
        yield from now.settle()


def _joined(pieces: Iterator[pa.RecordBatch], rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Small pieces put together."""
    held, n = [], 0
    for piece in pieces:
        held.append(piece)
        n += piece.num_rows
        if n >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def near_words(words: DataFrame, sample: int = SAMPLE, cell: int = CELL) -> DataFrame:
    """word, near, near_n: all near words of every word of ``words`` (word, n; each word once)."""
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = words.select("word", "n").mapInArrow(_to_cells(cell_trees(words, sample, cell)), ASKED)
    return asked.repartition(parts, "cell").sortWithinPartitions("cell", "role").mapInArrow(_search, PAIRS)


def variants(docs: DataFrame, sample: int = SAMPLE, cell: int = CELL) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the documents."""
    words = cut(vocabulary(docs), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("w")))  # the most frequent, then the smallest
    found = near_words(words, sample, cell).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    known = words.join(found, "word", "left")
    fits = -F.col("best.m") >= FORM_RATIO * F.col("n")
    held = cut(known.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("best.w")).alias("form"), F.when(fits, -F.col("best.m")).alias("form_n")), "forms")
    roots = held.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    top = held.agg(F.max("n")).first()[0] or 1
    hops = int(math.log10(max(1, top / LEAST_COUNT))) + 1  # every hop multiplies n by FORM_RATIO
    for _ in range(math.ceil(math.log2(max(1, hops)))):
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = cut(roots.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    out = held.join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
