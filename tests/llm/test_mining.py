"""Spelling variants, word-window dedup and hard negatives against brute force on small tables."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import gnat, hard_negatives, queries, spelling

# --- spelling variants


def brute_words(pairs):
    count = Counter()
    for i, t in pairs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_spelling(pairs):
    words = brute_words(pairs)
    near = {w: {x for x in words if one_edit(w, x)} for w in words}
    form = {}
    for w, ws in near.items():
        top = min(ws, key=lambda x: (-words[x], x), default=None)
        form[w] = top if top is not None and words[top] >= 2 * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), form[w] and words[form[w]]))
    return sorted(map(repr, out))


def typo_texts(seed, n):
    rng = random.Random(seed)
    base = ["letters", "grouping", "variant", "Straße", "naïveté", "çaçaça", "abcde", "aaaaa", "aaaaaa", "zzzzz×", "LONGWORD" * 20]
    for i in range(n):
        text = []
        for _ in range(12):
            w = rng.choice(base)
            if rng.random() < 0.35:
                k = rng.randrange(len(w) + 1)
                w = w[:k] + rng.choice(["", "e", "é", "q"]) + w[k + rng.randrange(2) :]
            text += [w] * (1 if rng.random() < 0.7 else 3)
        yield i, " ".join(text) + rng.choice([".", ",", " 12", "\n"])


SPELL = [*typo_texts(1, 60), (None, "letters lettres"), (None, "letters"), (3, None), (4, ""), (5, "12 +- !"), (0, "letters"), (0, "letters")]
DOCS = "doc_id long, text string, word string, n long, form string, wid string"


@pytest.mark.parametrize("symbols,crowd", [(8, 512), (2, 3), (1, 0)])
def test_variants(spark, symbols, crowd):
    """With few symbols forms are shared by many words, which then meet letter by letter."""
    df = spark.createDataFrame([(i, t, "w", 1, None, "x") for i, t in SPELL], DOCS)
    got = spelling.variants(df, symbols=symbols, crowd=crowd).collect()
    want = brute_spelling(SPELL)
    assert len(want) > 30 and sorted(repr(tuple(r)) for r in got) == want


def test_variants_edges(spark):
    assert spelling.variants(spark.createDataFrame([], DOCS)).count() == 0
    long = "x" * 200_000
    rows = [(i, f"{long} {long[:-1]} {long}", "w", 1, None, "x") for i in range(1, 3)]
    got = {len(r["word"]): (r["n"], r["n_near"]) for r in spelling.variants(spark.createDataFrame(rows, DOCS)).collect()}
    want = brute_words([(r[0], r[1]) for r in rows])
    assert got == {len(w): (n, len(want) - 1) for w, n in want.items()}


def test_neighbourhood_is_whole():
    rng = random.Random(4)
    for _ in range(30):
        a = "".join(rng.choice("abc") for _ in range(rng.randrange(5, 9)))
        for symbols in (0, 3):
            sign = lambda w, s=symbols: spelling.reduced(np.array([[ord(c) for c in w]]), s)
            forms = np.concatenate([x.ravel() for x in spelling.neighbourhood(sign(a), spelling.alphabet(symbols))])
            near = {a[:k] + c + a[k + d :] for k in range(len(a) + 1) for c in ["", *"abcé"] for d in (0, 1)}
            assert all(spelling.form(sign(w))[0] in forms for w in near if len(w) >= len(a) - 1)


def test_roots_of_long_chains(spark):
    steps = [(f"w{k:02}", f"w{k + 1:02}") for k in range(21)]
    got = {r["word"]: r["root"] for r in spelling.roots(spark.createDataFrame(steps, "word string, form string")).collect()}
    assert got == {w: "w21" for w, _ in steps}


# --- hard negatives


def brute_negatives(rows):
    fit = []
    for uid, (i, v, label) in enumerate(rows):
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        fit.append((uid, i, label, [math.floor(256 * x) for x in v]))
    last = lambda i: (i is None, i or 0)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for uid, i, label, v in fit:
        if i is None or i % 100:
            continue
        score = [(dot(v, w), j, x, u) for u, j, x, w in fit if u != uid]
        order = lambda s: (-s[0], last(s[1]), s[3])
        for p in sorted((s for s in score if s[2] == label), key=order)[:5]:
            bad = [s for s in score if s[2] != label and 30 * p[0] <= 100 * s[0] <= 90 * p[0]]
            out += [(i, p[1], k, s[1], p[0], s[0]) for k, s in enumerate(sorted(bad, key=order)[:10], 1)]
    return sorted(map(repr, out))


def vectors(seed, n, dim=6):
    rng = random.Random(seed)
    for i in range(n):
        yield i, [round(rng.gauss(0.3, 0.5), 3) for _ in range(dim)], rng.randrange(4)


ODD = [
    (None, [0.5] * 6, 1), (None, [0.4] * 6, 2), (600, None, 1), (700, [0.1] * 6, None), (800, [0.1, None, 0.2, 0.1, 0.3, 0.1], 1), (900, [0.1, float("nan")] * 3, 2),
    (901, [float("inf")] * 6, 2), (1000, [], 1), (1100, [0.5, 0.5], 2), (1200, [0.0] * 6, 3), (1300, [-0.5] * 6, 3), (1400, [0.5] * 6, 1), (1400, [0.5] * 6, 1), (1401, [0.5] * 6, 2),
]
ROWS = "vec_id long, embedding array<double>, label int, uid string, leaf string, anchor string"


@pytest.mark.parametrize("fanout,block,levels", [(16, 4096, None), (3, 7, 3), (4, 1000, 2)])
def test_hard_negatives(spark, fanout, block, levels):
    rows = [*vectors(1, 400), *ODD, *[(2000 + k, [0.3] * 6, k % 2) for k in range(90)]]
    df = spark.createDataFrame([(*r, "u", "l", None) for r in rows], ROWS)
    got = hard_negatives.mine(df, F.col("vec_id") % 100 == 0, fanout=fanout, block=block, levels=levels).collect()
    want = brute_negatives(rows)
    assert len(want) > 100 and sorted(repr(tuple(r)) for r in got) == want


def test_hard_negatives_edges(spark):
    empty = spark.createDataFrame([], ROWS)
    mine = lambda df: hard_negatives.mine(df, F.col("vec_id") % 100 == 0)
    assert mine(empty).count() == 0
    one = spark.createDataFrame([(0, [1.0], 1, "", "", "")], ROWS)
    assert mine(one).count() == 0
    rows = [(0, [1e9, 1.0], 1), (1, [1e7, 3.0], 1), (2, [9e6, 5.0], 2), (3, [1e307, 1.0], 1)]
    got = mine(spark.createDataFrame([(*r, "", "", "") for r in rows], ROWS)).collect()
    assert sorted(repr(tuple(r)) for r in got) == brute_negatives(rows[:3])  # sums beyond exact doubles; 256e307 is no number


def test_tree_rules_out_and_keeps():
    """Clustered vectors: most leaves go, and none that holds a vector of the window."""
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 100, (24, 8))
    rows = np.floor(centres[rng.integers(0, 24, 4000)] + rng.normal(0, 4, (4000, 8)))
    tree = gnat.Tree(rows[:1000], 8, 2)
    leaf = tree.place(rows)
    asked = rows[::200]
    score = asked @ rows.T
    least, most = 0.8 * (asked * asked).sum(1), (asked * asked).sum(1) * 0.98
    found = tree.search(asked, least, most)
    for q in range(len(asked)):
        held = set(leaf[(score[q] >= least[q]) & (score[q] <= most[q])].tolist())
        assert held <= {x for x, qs in found.items() if q in qs}
    assert sum(map(len, found.values())) < 0.5 * len(asked) * tree.leaves


def test_placed_rows_keep_ranges():
    rows = np.random.default_rng(1).normal(0, 9, (500, 5))
    one, two = gnat.Tree(rows[:99], 4, 2), gnat.Tree(rows[:99], 4, 2)
    one.place(rows)
    half = gnat.Tree(rows[:99], 4, 2)
    half.place(rows[:250])
    two.place(rows[250:])
    two.widen(half.ranges())
    assert all(np.array_equal(a, b) for a, b in zip(one.low + one.high + one.norms, two.low + two.high + two.norms, strict=True))


def test_op13_on_the_tables(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    moved = [(i, v, (x + 1) % 10 if i is not None and i % 7 == 0 and x is not None else x) for i, v, x in rows]
    assert sorted(repr(tuple(r)) for r in queries.op13_hard_negatives(spark, small).collect()) == brute_negatives(moved)
