"""Exact, line and substring dedup, and SimHash components, against brute force on small tables."""

import hashlib
import random

import numpy as np
import pytest
from compare import rows, views
from pyspark.sql import functions as F

from ledgerlens.llm import exact_dedup, line_dedup, queries, simhash, suffix_dedup, suffix_sort
from ledgerlens.llm.components import components
from ledgerlens.llm.words import shingle_hashes, words_of

DOCS = "doc_id long, text string, ID string, h string, recipe string"


def docs(spark, pairs):
    """With null columns and columns whose names clash with those that operators use inside."""
    return spark.createDataFrame([(i, t, None, "h", "r") for i, t in pairs], DOCS)


def long_text(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(["alpha", "beta", "Gämma", "delta,", "eps.", "\n"]) + str(rng.randrange(50)) for _ in range(n))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_with_sql(spark, small, name):
    got = queries.QUERIES[name](spark, small).toPandas()
    want = views(small).execute(queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


# --- exact dedup

EXACT = [(1, "Ab"), (2, "aB"), (3, None), (4, ""), (5, "ÄB"), (6, "äb"), (None, "ab"), (7, long_text(1, 4000)), (8, long_text(1, 4000)), (9, long_text(1, 4000) + "x"), (7, long_text(1, 4000)), (None, "only"), (10, "zz"), (10, "zz")]


def brute_exact(pairs):
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    groups = {}
    for i, t in pairs:
        groups.setdefault(low(t), []).append(i)
    out, seen = [], set()
    for i, t in pairs:
        g = groups[low(t)]
        top = max((x for x in g if x is not None), default=None)
        first = (low(t), i) not in seen
        seen.add((low(t), i))
        out.append((i, top, len(g), i == top and first, hashlib.sha256(low(t).encode()).hexdigest()))
    return sorted(map(str, out))


@pytest.mark.parametrize("weak", [False, True])
def test_exact_groups(spark, weak):
    # A hash of two values makes nearly all chunks collide: they are then told apart by their bytes.
    kind = (lambda c: F.pmod(F.xxhash64(c), F.lit(2))) if weak else F.xxhash64
    got = exact_dedup.exact_groups(docs(spark, EXACT), least=16, most=64, hash_of=kind)
    assert sorted(str(tuple(r)) for r in got.collect()) == brute_exact(EXACT)


def test_chunks_cover_and_shift(spark):
    a, b = long_text(5, 3000), "inserted in front " + long_text(5, 3000)
    df = docs(spark, [(1, a), (2, b)]).select(exact_dedup.chunks(F.col("text"), 64, 512).alias("c"))
    x, y = (r["c"] for r in df.collect())
    assert "".join(x) == a and "".join(y) == b and len(set(x) & set(y)) > 0.8 * len(x)


def test_exact_edges(spark):
    assert exact_dedup.exact_groups(docs(spark, [])).count() == 0
    kept = exact_dedup.keep_one(docs(spark, EXACT))
    assert kept.columns == ["doc_id", "text", "ID", "h", "recipe"]
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["2", "4", "5", "6", "8", "9", "10", "None"])


# --- line dedup


def brute_lines(pairs):
    h = lambda x: int(hashlib.md5(x.encode()).hexdigest()[:15], 16) % line_dedup.PRIME
    chunks, first = {}, {}
    order = sorted(set(pairs), key=lambda p: (p[0] is not None, p[0] or 0))
    for i, t in order:
        lines = (t or "").split("\n")
        cut = [0, *[k for k in range(1, len(lines)) if (h(lines[k - 1]) * line_dedup.FACTOR + h(lines[k])) % line_dedup.DIVISOR == 0], len(lines)]
        chunks[i, t] = [tuple(lines[a:b]) for a, b in zip(cut, cut[1:])]
        for k, c in enumerate(chunks[i, t]):
            if len(c) > 1:
                first.setdefault(c, (i, t, k))
    out = []
    for i, t in pairs:
        kept = [c for k, c in enumerate(chunks[i, t]) if len(c) == 1 or first[c] == (i, t, k)]
        n = len((t or "").split("\n"))
        left = [x for c in kept for x in c]
        out.append((i, n, n - len(left), len(chunks[i, t]) - len(kept), "\n".join(left)))
    return sorted(map(str, out))


def line_docs():
    rng = random.Random(3)
    block = [f"shared line {k}" for k in range(12)]
    out = [(None, "a\nb"), (1, None), (2, ""), (3, "\n\n"), (4, "one"), (4, "one")]
    for i in range(10, 40):
        own = [f"own {i} {rng.randrange(9)}" for _ in range(rng.randrange(6))]
        out.append((i, "\n".join(own[:2] + block[: rng.randrange(13)] + own[2:] + block)))
    return out


@pytest.mark.parametrize("weak", [False, True])
def test_line_dedup(spark, weak):
    kind = (lambda c: F.pmod(F.xxhash64(c), F.lit(2))) if weak else F.xxhash64
    got = line_dedup.dedup_lines(docs(spark, line_docs()), hash_of=kind)
    found = sorted(str(tuple(r)) for r in got.collect())
    assert found == brute_lines(line_docs())
    assert got.agg(F.sum("n_removed_lines")).first()[0] > 100
    assert line_dedup.dedup_lines(docs(spark, [])).count() == 0


# --- substrings


def brute_substrings(pairs):
    seen, out = {}, []
    for i, t in sorted(pairs, key=lambda p: (p[0] is not None, p[0] or 0)):
        b = (t or "").encode()
        mark = bytearray(len(b))
        for s in range(len(b) - 99):
            w = b[s : s + 100]
            if w in seen:
                mark[s : s + 100] = b"\x01" * 100
            else:
                seen[w] = 1
        kept = bytes(x for x, m in zip(b, mark, strict=True) if not m)
        out.append((i, len(b), sum(mark), sum(mark[k] and not (k and mark[k - 1]) for k in range(len(b))), kept))
    return sorted(map(str, out))


def substring_docs():
    rng = random.Random(11)
    base = long_text(7, 300)
    out = [(None, base[:400]), (1, None), (2, ""), (3, "x" * 99), (4, "x" * 100), (5, "x" * 350), (6, "ab" * 120), (7, "Ünï" * 90)]
    for i in range(10, 60):
        a = rng.randrange(len(base) - 300)
        out.append((i, long_text(100 + i, 20) + base[a : a + rng.randrange(60, 300)] + long_text(200 + i, 15)))
    return [*out, (70, base), (71, base), (72, base[50:])]


@pytest.mark.parametrize("hot", [4096, 1])
def test_suffix_dedup(spark, hot):
    got = suffix_dedup.dedup_substrings(docs(spark, substring_docs()).repartition(5), hot=hot)
    found = sorted(str((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"]))) for r in got.collect())
    assert found == brute_substrings(substring_docs())


def test_suffix_dedup_repeats_and_edges(spark):
    assert suffix_dedup.dedup_substrings(docs(spark, [])).count() == 0
    text = long_text(1, 60)
    got = suffix_dedup.dedup_substrings(docs(spark, [(1, text), (1, text), (2, text)]))
    assert sorted((r["doc_id"], r["n_removed"]) for r in got.collect()) == [(1, 0), (1, 0), (2, len(text.encode()))]


def test_runs_are_copies_only_if_the_whole_digest_agrees():
    import hashlib

    import numpy as np

    data = long_text(5, 60).encode()
    got = suffix_dedup.run_digests(data, np.array([0, 7]), np.array([3, 7]))
    want = [hashlib.sha256(data[a:b]).digest()[:16] for a, b in ((0, 103), (7, 107))]
    assert [r.tobytes() for r in got] == want
    assert suffix_dedup.run_digests(data, np.array([], int), np.array([], int)).shape == (0, 2)
    # key, run, run2, id, t, start, end: the first half agrees in all four, the second in the first three.
    rows = [np.array(c) for c in ([9] * 4, [1] * 4, [2, 2, 2, 3], [10, 11, 10, 12], [0] * 4, [0, 0, 5, 0], [110] * 4)]
    firsts, copy = suffix_dedup._settle(rows)
    assert copy.tolist() == [False, True, True, False] and firsts[3].tolist() == [10, 12]


def test_long_texts_are_cut_into_pieces(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 1000)
    text = long_text(3, 2000).encode()
    seen = []
    for data, cuts, who, at in suffix_dedup._pieces([b"short", text]):
        import numpy as np

        _, first, last = suffix_dedup.anchors(np.frombuffer(data, np.uint8), cuts)
        spot = np.searchsorted(cuts, first, side="right") - 1
        for a, z, s in zip(first, last, spot, strict=True):
            assert who[s] == 1
            seen += range(a - cuts[s] + at[s], z - cuts[s] + at[s] + 1)
    assert sorted(seen) == list(range(len(text) - 99))  # every window has one anchor


def test_deep_shallow_sort():
    import numpy as np

    rng = random.Random(5)
    data = bytes(rng.choice(b"ab") for _ in range(600)) + b"ab" * 300 + b"a" * 300
    starts = np.array(rng.sample(range(len(data) - 100), 700) + [0, 0, 5, 5, 5])
    order, group = suffix_sort.sort_windows(data, starts, 100)
    windows = [data[starts[k] : starts[k] + 100] for k in order]
    assert windows == sorted(windows) and sorted(order) == list(range(len(starts)))
    assert all((windows[k] == windows[k + 1]) == (group[k] == group[k + 1]) for k in range(len(windows) - 1))


# --- SimHash


def _joined(nodes, pairs):
    top = {n: n for n in nodes}

    def root(n):
        while top[n] != n:
            n = top[n]
        return n

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        top[b] = a
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("radius", [0, 2, 5])
def test_large_groups_of_fingerprints_join_the_same(radius):
    rng = np.random.default_rng(radius)
    # Ten bits vary, so many of the group's fingerprints are near, and some are not.
    fps = rng.choice(1 << 22, 700, replace=False).astype(np.int64)
    fps = np.unique(np.where(rng.random(700) < 0.5, fps & 0x3FF, fps)) | np.int64(-(1 << 62))
    nodes = np.arange(len(fps))
    got = simhash._large_forest(nodes, fps, radius)
    apart = simhash.bits_apart(fps[:, None], fps[None, :])
    want = zip(*np.nonzero(np.triu(apart <= radius, 1)), strict=True)
    assert (apart[got] <= radius).all()
    assert _joined(nodes.tolist(), zip(*map(np.ndarray.tolist, got), strict=True)) == _joined(nodes.tolist(), [(int(a), int(b)) for a, b in want])


def test_a_node_of_very_many_links(spark):
    star = [(7, n) for n in range(100, 3000)] + [(2999, 3), (5000, 5001)]
    got = components(spark.createDataFrame(star, "a long, b long")).collect()
    want = {n: 3 for n in [*range(100, 3000), 7]} | {5001: 5000}
    assert {r["node"]: r["root"] for r in got} == want and len(got) == len(want)


def brute_components(pairs, shingle=3, radius=2):
    prints = [simhash.fingerprint(shingle_hashes(words_of(t), shingle)) & (2**64 - 1) for _, t in pairs]
    root = list(range(len(pairs)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(pairs)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                root[find(a)] = find(b)
    ids = {}
    for k, (i, _) in enumerate(pairs):
        ids.setdefault(find(k), []).append(i)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    return sorted(str((i, f"{prints[k]:016x}", least[find(k)])) for k, (i, _) in enumerate(pairs))


def naive_print(text, n):
    import xxhash

    words = words_of(text)
    shingles = [b" ".join(words[k : k + n]) for k in range(len(words) - n + 1)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near_docs():
    rng = random.Random(9)
    out = [(None, "a b"), (1, None), (2, ""), (3, " \n"), (4, "A b"), (5, "one"), (5, "one"), (6, "a b c d")]
    for i in range(10, 60):
        words = long_text(i % 7, 400).split()
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = "edit"
        out.append((i, " ".join(words)))
    return out


def test_fingerprint_components(spark):
    got = simhash.fingerprint_components(docs(spark, near_docs()))
    assert sorted(str(tuple(r)) for r in got.collect()) == brute_components(near_docs())
    assert simhash.fingerprint_components(docs(spark, [])).count() == 0
    for _, t in near_docs():
        assert simhash.fingerprint(shingle_hashes(words_of(t), 3)) & (2**64 - 1) == naive_print(t, 3)


def test_native_hash_is_the_same(spark):
    value = spark.sql("SELECT xxhash64('a b c')").first()[0]
    assert int(shingle_hashes([b"a", b"b", b"c"], 3).view("int64")[0]) == value


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5])
def test_links_keep_components(spark, radius):
    rng = random.Random(radius)
    points = []
    for c in range(40):
        f = rng.getrandbits(64)
        for _ in range(30):
            for _ in range(rng.randrange(radius + 2)):
                f ^= 1 << rng.randrange(64)
            points.append(f)
    points = sorted(set(points))
    signed = [p - (1 << 64) if p >> 63 else p for p in points]
    df = spark.createDataFrame([(s, s) for s in signed], "node long, fp long")
    found = [tuple(r) for r in simhash.links(df, radius).collect()]
    where = dict(zip(signed, range(len(points)), strict=True))

    def parts(edges):
        root = list(range(len(points)))

        def find(k):
            while root[k] != k:
                root[k] = root[root[k]]
                k = root[k]
            return k

        for a, b in edges:
            root[find(a)] = find(b)
        return [find(k) for k in range(len(points))]

    every = [(a, b) for a in range(len(points)) for b in range(a) if (points[a] ^ points[b]).bit_count() <= radius]
    mine, want = parts([(where[a], where[b]) for a, b in found]), parts(every)
    assert len(set(zip(mine, want, strict=True))) == len(set(mine)) == len(set(want))


def test_components(spark):
    from ledgerlens.llm.components import components

    rng = random.Random(4)
    edges = [(k, k + 1) for k in range(0, 300)] + [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)] + [(7, 7)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = dict((r["node"], r["root"]) for r in components(df).collect())
    assert all(got[k] == 0 for k in range(1, 301)) and 7 in got and 0 not in got
    root = {}
    find = lambda k: k if root.setdefault(k, k) == k else find(root[k])
    for a, b in edges[300:-1]:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    assert {k: find(k) for k in root if find(k) != k} == {k: v for k, v in got.items() if k >= 1000}
    assert components(df.limit(0)).count() == 0


def test_near_groups(spark):
    rng = random.Random(2)
    pairs = [(None, "x y z a b c"), (1, None), (2, "short text")]
    want = {}
    for i in range(10, 60):
        words = [f"{rng.choice(['stone', 'river', 'window', 'garden'])}{rng.randrange(400)}" for _ in range(200)]
        pairs.append((i, " ".join(words)))
        if i % 2:
            words[rng.randrange(200)] = "changed"
            pairs.append((i + 100, " ".join(words)))
            want[i + 100] = i
    got = {r["node"]: r["root"] for r in simhash.near_groups(docs(spark, pairs)).collect()}
    assert got == want
    kept = simhash.keep_first(docs(spark, pairs))
    assert kept.columns == ["doc_id", "text", "ID", "h", "recipe"] and kept.count() == len(pairs) - len(want)


def test_a_large_family_of_near_copies(spark):
    """Copies edited apart: each is like the first text and hardly any like one another."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice(["er", "tion", "an", "th", "on", "re", "in", "es"]) for _ in range(rng.randrange(2, 5)))
    base = [word() for _ in range(300)]
    pairs = [(500, " ".join(base))]
    for i in range(300):
        words = list(base)
        for _ in range(6):
            words[rng.randrange(300)] = word()
        pairs.append((1000 + i, " ".join(words)))
    sets = [set(shingle_hashes(words_of(t), 5).tolist()) for _, t in pairs]
    like = [len(s & sets[0]) / len(s | sets[0]) >= 0.8 for s in sets]
    assert sum(like) > 200
    got = {r["node"]: r["root"] for r in simhash.near_groups(docs(spark, pairs)).collect()}
    missed = [i for (i, _), near in zip(pairs[1:], like[1:], strict=True) if near and got.get(i) != 500]
    assert not missed


def brute_near(pairs, similarity=0.8):
    """(node, root) of the components of all pairs at the similarity."""
    sets = {i: set(shingle_hashes(words_of(t), 5).tolist()) for i, t in pairs}
    ids, root = sorted(sets), {i: i for i in sets}

    def find(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for k, b in enumerate(ids):
        for a in ids[:k]:
            x, y = sets[a], sets[b]
            if min(len(x), len(y)) >= similarity * max(len(x), len(y)) and (len(x & y) / len(x | y) if x | y else 1.0) >= similarity:
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: find(i) for i in ids if find(i) != i}


def test_near_copies_far_apart_in_bits(spark):
    """A notice in front of a short text moves many bits of the fingerprint and few of the shingles."""
    rng = random.Random(6)
    pairs = [(1, ""), (2, " \n"), (3, "one two"), (4, "One  two")]
    for i in range(10, 90):
        words = [f"{rng.choice(['er', 'tion', 'an', 'in'])}{rng.randrange(10**6)}" for _ in range(50)]
        notice = [f"notice{rng.randrange(10**6)}" * 2 for _ in range(5)]
        pairs += [(i, " ".join(words)), (1000 + i, " ".join(notice + words))]
    apart = [bin((simhash.word_print(x[1]) ^ simhash.word_print(y[1])) & (2**64 - 1)).count("1") for x, y in zip(pairs[4::2], pairs[5::2], strict=True)]
    assert max(apart) > 9
    want = brute_near(pairs)
    assert len(want) == 82
    assert {r["node"]: r["root"] for r in simhash.near_groups(docs(spark, pairs)).collect()} == want


def test_fingerprints_of_all_texts_link(spark, monkeypatch):
    """Every text's fingerprint is dealt to Golay keys, not those of crowds only, and a family that they join is no crowd."""
    rng = random.Random(21)
    text = lambda: [f"{rng.choice(['er', 'tion', 'an', 'in'])}{rng.randrange(10**6)}" for _ in range(300)]
    base, pairs = text(), [(i, " ".join(text())) for i in range(30)]
    for i in range(40):
        words = list(base)
        words[7 * i] = f"changed{i}"
        pairs.append((100 + i, " ".join(words)))
    dealt, links = [], simhash.links

    def spy(points, radius):
        dealt.append({r["fp"] for r in points.collect()})
        return links(points, radius)

    monkeypatch.setattr(simhash, "links", spy)
    monkeypatch.setattr(simhash, "_crowd_links", None)
    assert {r["node"]: r["root"] for r in simhash.near_groups(docs(spark, pairs)).collect()} == {100 + i: 100 for i in range(1, 40)}
    assert dealt == [{simhash.word_print(t) for _, t in pairs}]


def test_unlike_texts_of_a_shared_passage_are_no_crowd(spark, monkeypatch):
    """Shingles that the sample does not show to be common make a crowd at first; counted, they come last in the crowd's
    prefixes, and no text is left whose shingles are all counted."""
    monkeypatch.setattr(simhash, "COMMON", 10**6)
    monkeypatch.setattr(simhash, "_crowd_links", None)
    monkeypatch.setattr(simhash, "_print_links", lambda points, *_: points.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0))
    rng = random.Random(22)
    text = lambda n: [f"{rng.choice(['er', 'tion', 'an', 'in'])}{rng.randrange(10**6)}" for _ in range(n)]
    shared, pairs = text(40), []
    for i in range(60):
        own = text(200)
        pairs.append((i, " ".join(own + shared)))
        if i % 3 == 0:
            own[rng.randrange(200)] = "changed"
            pairs.append((100 + i, " ".join(own + shared)))
    want = brute_near(pairs)
    assert want == {100 + i: i for i in range(0, 60, 3)}
    assert {r["node"]: r["root"] for r in simhash.near_groups(docs(spark, pairs)).collect()} == want


def test_slots_mark_whole_hashes(spark):
    hashes = np.array([0, 1, 63, 64, -1, -(2**63), 2**63 - 1, 123456789012345], np.int64)
    table = simhash._slots(spark.createDataFrame([(int(h),) for h in hashes], "h long"))
    assert simhash._marked(table, hashes.view(np.uint64)).all()
    assert int(np.bitwise_count(table).sum()) == len({int(h) & (simhash.SLOTS - 1) for h in hashes})
    assert not simhash._slots(spark.createDataFrame([], "h long")).any()


def test_repeated_ids_and_clean_rows(spark):
    """A row goes for its own text only, not for another text under its id; copies of both id and text are one row."""
    rng = random.Random(5)
    text = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(120))
    b, c, d = text(), text(), text()
    pairs = [(1, b), (2, b + " x"), (2, c), (3, d), (3, d), (None, b), (None, b), (4, None), (5, ""), (6, " \n")]
    kept = sorted(((r["doc_id"], r["text"]) for r in simhash.keep_first(docs(spark, pairs)).collect()), key=repr)
    assert kept == sorted([(1, b), (2, c), (3, d), (None, b), (None, b), (4, None)], key=repr)
    assert simhash.keep_first(docs(spark, [])).count() == 0
    found = sorted((r["node"], r["root"]) for r in simhash.near_groups(docs(spark, pairs)).collect())
    assert found == [(2, 1), (5, 4), (6, 4)]


@pytest.mark.parametrize("listed", [16, 256])
def test_crowds_lose_no_link(spark, monkeypatch, listed):
    """A chain of versions edited one after the other, and copies edited apart without their first text: both over the
    size of a block. The larger groups are compared in blocks or listed."""
    monkeypatch.setattr(simhash, "LISTED", listed)
    rng = random.Random(12)
    word = lambda: "".join(rng.choice(["er", "tion", "an", "th", "on", "re", "in", "es"]) for _ in range(rng.randrange(2, 5)))
    pairs, words = [], [word() for _ in range(200)]
    for i in range(200):
        for _ in range(rng.choice([3, 4, 8])):
            words[rng.randrange(150)] = word()
        pairs.append((5000 - i, " ".join(words)))
    base = [word() for _ in range(200)]
    for i in range(200):
        words = list(base)
        for _ in range(4):
            words[rng.randrange(200)] = word()
        pairs.append((i, " ".join(words)))
    want = brute_near(pairs)
    assert 50 < len(want) < 395
    assert {r["node"]: r["root"] for r in simhash.near_groups(docs(spark, pairs)).collect()} == want
