"""Word-window dedup and its index against brute force."""

import random

import numpy as np
import pytest

from ledgerlens.llm import passage_dedup
from ledgerlens.llm.fm_index import FMIndex


def flat(runs):
    return np.array([s for r in runs for s in r], np.int64), np.array([len(r) for r in runs], np.int64)


@pytest.mark.parametrize("symbols", [1, 2, 3, 8])
def test_matching_statistics(symbols):
    rng = random.Random(symbols)
    some = lambda n: [rng.randrange(1, symbols + 1) for _ in range(n)]
    for most in (1, 3, 20):
        runs = [some(rng.randrange(1, 45)) for _ in range(rng.randrange(1, 9))]
        asked = [some(rng.randrange(0, 40)) for _ in range(5)] + [r[1:] + [1] for r in runs] + [[0, 1, 1, 0]]
        text = [s for r in runs for s in [*r, 0]]
        index = FMIndex(*flat(runs), symbols)
        length, low = index.matching_statistics(*flat(asked), most)
        k = 0
        for p in asked:
            for i in range(len(p)):
                spots = lambda n, p=p, i=i: [j for j in range(len(text)) if text[j : j + n] == p[i : i + n] and 0 not in p[i : i + n]]
                best = next((n for n in range(min(most, len(p) - i), 0, -1) if spots(n)), 0)
                assert length[k] == best
                if best == most:
                    assert index.earliest(low[k : k + 1], most)[0] == spots(best)[0]
                k += 1


def brute(pairs, length):
    """pairs of distinct ids, or of one id with texts in the order of their hash."""
    seen, out = set(), []
    for i, t in pairs:
        words = (t or "").encode().split()
        gone = [False] * len(words)
        for s in range(len(words) - length + 1):
            w = tuple(words[s : s + length])
            if w in seen:
                gone[s : s + length] = [True] * length
            seen.add(w)
        out.append((i, len(words), sum(gone), b" ".join(w for w, g in zip(words, gone, strict=True) if not g)))
    return out


DOCS = "doc_id long, text string, start long, key string, r1 string, n string, id string"


def frame(spark, pairs):
    return spark.createDataFrame([(i, t, None, "k", "r", "n", "i") for i, t in pairs], DOCS)


def passages(seed, n):
    rng = random.Random(seed)
    words = ["one", "two", "trois", "vier,", "Fünf", "six.", " x", "SEVEN"]
    shared = [" ".join(rng.choice(words) + str(rng.randrange(4)) for _ in range(rng.randrange(10, 60))) for _ in range(6)]
    for i in range(n):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            own = " ".join(rng.choice(words) + str(rng.randrange(30)) for _ in range(rng.randrange(0, 25)))
            parts += [own, rng.choice(shared) if rng.random() < 0.6 else ""]
        yield i, rng.choice([" ", "\n", "\t  "]).join(parts)


ODD = [(-5, None), (-4, ""), (-3, " \n "), (-2, "a " * 300), (-1, "b a " * 100), (200, "a " * 300), (201, "x" * 50_000 + " " + "a " * 40)]


@pytest.mark.parametrize("length,gram,hot", [(20, 4, 4096), (20, 4, 1), (5, 2, 2), (5, 5, 4096), (1, 1, 0)])
def test_dedup_passages(spark, length, gram, hot):
    pairs = sorted([*passages(1, 60), *ODD])
    rng = random.Random(2)
    got = passage_dedup.dedup_passages(frame(spark, rng.sample(pairs, len(pairs))), length=length, gram=gram, hot=hot).collect()
    want = brute(pairs, length)
    assert sum(w[2] for w in want) > 300
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], bytes(r["kept"])) for r in got) == want


def test_long_text_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(passage_dedup, "PIECE", 64)
    pairs = sorted([*passages(3, 12), (50, " ".join(t for _, t in passages(4, 40)))])
    found = list(passage_dedup._pieces([(t or "").encode() for _, t in pairs], 20))
    windows = {tuple(words[s : s + 20]) for words, cuts, _, _ in found for a, z in zip(cuts, cuts[1:], strict=False) for s in range(a, z - 19)}
    assert windows == {tuple(t.encode().split()[s : s + 20]) for _, t in pairs for s in range(len(t.split()) - 19)}
    whole = " ".join(f"w{k % 70_001}" for k in range(300_000))
    got = passage_dedup.dedup_passages(frame(spark, [(1, whole), (2, whole[5000:])])).collect()
    assert sorted((r["n_words"], r["n_removed"], bytes(r["kept"])) for r in got) == sorted(w[1:] for w in brute([(1, whole), (2, whole[5000:])], 20))


def test_repeats_and_nulls(spark):
    text = " ".join(f"w{k}" for k in range(30))
    got = passage_dedup.dedup_passages(frame(spark, [(None, text), (7, text), (7, text), (None, text), (8, None)])).collect()
    assert sorted((r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in got) == [(0, 30, 0), (0, 30, 0), (7, 30, 30), (7, 30, 30), (8, 0, 0)]
    one = passage_dedup.dedup_passages(frame(spark, [(7, text), (7, text + " more")])).collect()
    assert sorted(r["n_removed"] for r in one) in ([0, 30], [0, 30]) and len(one) == 2
    assert passage_dedup.dedup_passages(spark.createDataFrame([], DOCS)).count() == 0
