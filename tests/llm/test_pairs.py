"""Operators on pairs (spelling variants, hard negatives, n-gram join) against brute force, and on odd rows."""

from __future__ import annotations

import collections
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from shotlane.llm import negatives, ngram_join, queries, spelling

SMALL = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, source string"
CLASH = ("fp", "word", "n", "t", "g", "uid", "leaf", "component_id", "__k1", "__text", "low", "cell", "v", "root")


def clashing(df):
    return df.withColumns({c: F.lit("x") for c in CLASH})


def one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(rows) -> dict:
    count = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    n = {w: c for w, c in count.items() if len(w) >= 7 and c >= 2}
    near, by = collections.defaultdict(list), collections.defaultdict(list)
    for w in n:
        by[len(w)].append(w)
    for w in n:
        near[w] = [v for size in (len(w) - 1, len(w), len(w) + 1) for v in by[size] if v != w and one_edit(w, v)]
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n.get(form[w]))
    return out


@pytest.mark.parametrize("sample,cell", [(spelling.SAMPLE, spelling.CELL), (400, 8)])
def test_variants_are_brute_force(spark, sample, cell):
    rnd, words = random.Random(3), ["language", "españolas", "procedure", "Entschädigung", "aaaaaaa"]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(40))) for i in range(60)]
    for i in range(60):  # chains of forms: rare variants of rare variants
        w = list(rnd.choice(words))
        for _ in range(rnd.randint(1, 3)):
            k = rnd.randrange(len(w))
            w[k : k + rnd.randint(0, 1)] = rnd.choice(["x", "é", "", "l"])
        rows.append((100 + i, f"{''.join(w)} {''.join(w)}, " * rnd.choice([1, 2, 15])))
    rows += [(None, None), (900, ""), (901, "y" * 20_000 + " " + "y" * 20_000), (901, "y" * 19_999 + "z"), (901, "y" * 19_999 + "z"), (None, "Schönheit SCHÖnheit")]
    docs = clashing(spark.createDataFrame([(a, b, "s") for a, b in rows], COLUMNS).repartition(5))
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.variants(docs, sample, cell).collect()}
    want = brute_variants(rows)
    assert got == want and any(v[0] != v[1] and v[0] for v in want.values())


def test_range_search_visits_every_near_vector():
    rnd = np.random.default_rng(5)
    words = ["".join(chr(97 + c) for c in rnd.integers(0, 4, 9)) for _ in range(900)]
    x = spelling.letter_counts(spelling.codes(words, 9))
    tree = spelling.grow(x, 6)
    assert sorted(np.concatenate(tree.members)) == list(range(900)) and len(tree.members) > 40
    leaf_of = {i: k for k, m in enumerate(tree.members) for i in m}
    one = np.ones(900, int)
    seen = collections.defaultdict(set)
    visited = 0
    for leaf, rows in tree.visits(x, one, one, *spelling._whole_box()):
        visited += len(rows)
        for r in rows.tolist():
            seen[r].add(leaf)
    ups = np.maximum(x[None] - x[:, None], 0).sum(axis=2)
    assert all(leaf_of[j] in seen[i] for i, j in zip(*np.nonzero((ups <= 1) & (ups.T <= 1))))
    assert visited < 900 * len(tree.members) / 2  # boxes are pruned


SETS = queries.ORACLES["op13_ngram_join"]


def brute_components(rows, percent: int = 85) -> list:
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sets.append({tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set())
    boss = list(range(len(rows)))

    def find(i):
        while boss[i] != i:
            i = boss[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        o = len(sets[i] & sets[j])
        if o and 100 * o >= percent * (len(sets[i]) + len(sets[j]) - o):
            boss[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return sorted(((d, len(s), low.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


@pytest.mark.parametrize("block", [ngram_join.BLOCK, 400, 10])
def test_join_is_brute_force(spark, block):
    rnd = random.Random(7)
    passage = " ".join(f"p{i}" for i in range(30))
    rows = []
    for base in range(6):
        text = [f"w{base}_{rnd.randint(0, 60)}" for _ in range(rnd.choice([3, 8, 40, 90]))]
        for _ in range(18):  # copies at every similarity around the border
            t = list(text)
            for _ in range(rnd.randint(0, 4)):
                t[rnd.randrange(len(t))] = f"x{rnd.randint(0, 9)}"
            if rnd.random() < 0.3:
                t = t[: rnd.randint(1, len(t))]
            rows.append((rnd.randint(0, 10_000), " ".join(t)))
    rows += [(20_000 + i, passage + " " + " ".join(f"u{i}_{k}" for k in range(rnd.randint(0, 12)))) for i in range(40)]  # a passage that many share
    rows += [(30_000, None), (30_001, ""), (30_002, " \t\n"), (None, "one two"), (None, "one two"), (30_003, "One  TWO"), (30_004, "one two three"), (30_005, "Ä ä b c")]
    rows += [rows[0]] * 3 + [(None, rows[40][1])]
    docs = clashing(spark.createDataFrame([(a, b, "s") for a, b in rows], COLUMNS).repartition(4))
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.joined(docs, block).collect()), key=str)
    assert got == brute_components(rows)


def test_trie_finds_the_components_of_all_links():
    rnd = np.random.default_rng(11)
    for size, width in ((2, 30), (60, 40), (120, 200)):
        base = [rnd.choice(10_000, width, replace=False) for _ in range(4)]
        sets = []
        for i in range(size):
            s = set(base[i % 4].tolist())
            drop = rnd.choice(sorted(s), rnd.integers(0, max(2, width // 6)), replace=False)
            sets.append(sorted((s - set(drop.tolist())) | set(rnd.integers(10_000, 10_040, rnd.integers(0, 4)).tolist())))
        df = collections.Counter(t for s in sets for t in s)
        got = dict(ngram_join._linked(list(range(size)), [len(s) for s in sets], [np.array([df[t] for t in s]) for s in sets], [np.array(s) for s in sets]))
        boss = list(range(size))
        for _ in range(size):
            for i, j in itertools.combinations(range(size), 2):
                o = len(set(sets[i]) & set(sets[j]))
                if 100 * o >= 85 * (len(sets[i]) + len(sets[j]) - o):
                    boss[i] = boss[j] = min(boss[i], boss[j])
        assert [got.get(i, i) for i in range(size)] == boss


NEG = "vec_id long, embedding array<float>, label int"


def brute_negatives(rows) -> list:
    kept = [(i, [int(np.floor(256 * float(x))) for x in v], (l + 1) % 10 if i % 7 == 0 else l) for i, v, l in rows if None not in (i, v, l) and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for k, (i, v, l) in enumerate(kept):
        if i % 100:
            continue
        other = sorted((-sum(a * b for a, b in zip(v, w)), j, m) for q, (j, w, m) in enumerate(kept) if q != k)
        for s, j, _ in [x for x in other if x[2] == l][:5]:
            fits = [(t, h) for t, h, m in other if m != l and 30 * -s <= 100 * -t <= 90 * -s][:10]
            out += [(i, j, r, h, -s, -t) for r, (t, h) in enumerate(fits, 1)]
    return sorted(out)


@pytest.mark.parametrize("leaf,chunk", [(16, 7), (negatives.LEAF, negatives.CHUNK)])
def test_negatives_are_brute_force(spark, leaf, chunk):
    rnd = np.random.default_rng(2)
    centres = rnd.normal(size=(5, 12))
    rows = []
    for i in range(700):
        v = centres[i % 5] * rnd.uniform(0.2, 3) + rnd.normal(size=12) * 0.3  # vectors of very different lengths
        rows.append((int(i * 4 if i % 3 else i * 50), [float(x) for x in v.astype(np.float32)], int(rnd.integers(0, 3))))
    hot = rows[5][1]
    rows += [(5_000 + 25 * i, hot, 1 + i % 2) for i in range(200)]  # one vector, very often
    rows += [rows[0], rows[0], (100, [float("nan")] * 12, 1), (200, [float("inf")] + [0.0] * 11, 1), (300, None, 1), (400, [0.5] * 12, None), (None, [0.5] * 12, 1), (500, [None] * 12, 1), (600, [1.0, 2.0], 1), (700, [], 1)]
    df = spark.createDataFrame(rows, NEG).repartition(5)
    df = df.withColumns({c: F.lit("x") for c in ("uid", "leaf", "v", "bucket", "rank", "score", "slot", "role")})
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = sorted(tuple(r) for r in negatives.mine(negatives.taking_part(df, label), leaf=leaf, chunk=chunk).collect())
    assert got == brute_negatives(rows) and len(got) > 500


def test_tree_prunes_and_keeps_every_score_in_the_window():
    rnd = np.random.default_rng(4)
    centres = rnd.normal(size=(30, 8)) * 100
    x = np.floor(centres[rnd.integers(0, 30, 4000)] + rnd.normal(size=(4000, 8)) * 5)
    tree = negatives.Tree(x[:800], float((x * x).sum(axis=1).max()), 20)

    def saw(node, own, d):
        for j in np.unique(own):
            node.low[:, j] = np.minimum(node.low[:, j], d[own == j].min(axis=0))
            node.high[:, j] = np.maximum(node.high[:, j], d[own == j].max(axis=0))

    leaf = tree.leaf_of(x, saw)
    scores = x[:50] @ x.T
    least = np.sort(scores, axis=1)[:, -20:-19]
    reached = collections.defaultdict(set)
    for k, rows in tree.reached(x[:50], least, np.full((50, 1), np.inf)):
        for r in rows.tolist():
            reached[r].add(k)
    assert all({leaf[j] for j in np.flatnonzero(scores[i] >= least[i])} <= reached[i] for i in range(50))
    assert np.mean([len(r) for r in reached.values()]) < tree.leaves / 3


def test_empty_tables(spark):
    docs = spark.createDataFrame([], COLUMNS)
    assert spelling.variants(docs).count() == 0 and ngram_join.joined(docs).count() == 0
    emb = spark.createDataFrame([], NEG)
    out = negatives.mine(negatives.taking_part(emb, F.col("label")))
    assert out.count() == 0 and out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_join_and_sql_agree_on_the_given_table(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    want = sorted(con.sql(f"SELECT doc_id, n_shingles, component_id FROM ({SETS})").fetchall())
    got = ngram_join.joined(spark.read.parquet(f"{SMALL}/documents.parquet"), 60)
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == want


def test_first_pass_tells_hashes_apart_by_forty_bits(spark):
    far, near = (5 << 40) + 1, (5 << 40) + 2  # they differ in the last bits only
    rows = spark.createDataFrame(
        [(1, 1, 1, 101, 1, [far]), (2, 2, 2, 102, 1, [near]), (3, 3, 3, 103, 1, [9 << 40])], "doc_id long, __k1 long, __k2 long, fp long, n_shingles long, low array<long>")
    assert sorted(r["fp"] for r in ngram_join.with_partner(rows).collect()) == [101, 102]


def test_sets_move_as_plain_lists(spark):
    docs = spark.createDataFrame([(i, f"a b c d e f g h i j k l m n o p q r s t u{i % 2}") for i in range(4)], "doc_id long, text string")
    sets = ngram_join.ordered_sets(docs, ngram_join.with_partner(ngram_join.set_rows(docs)))
    plan = sets._jdf.queryExecution().analyzed().toString()
    assert "collect_list(struct" not in plan and "collect_list(t" in plan
    assert [(r["n"], len(r["t"]), r["prefix"]) for r in sets.collect()] == [(18, 17, 2)] * 2
