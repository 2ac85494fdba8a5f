import random
import re

import pytest

from glyphmill.llm import jaccard

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, size):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def brute(rows, size, num, den):
    sets = [shingle_set(t, size) for _, t in rows]
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and rows[i][0] is not None and rows[j][0] is not None and den * len(a & b) >= num * len(a | b):
                x, y = find(rows[i][0]), find(rows[j][0])
                root[max(x, y)] = min(x, y) if x != y else x
    return sorted(((d, len(s), None if d is None else find(d)) for (d, _), s in zip(rows, sets, strict=True)), key=str)


def near_copies(seed, n, edits):
    rng = random.Random(seed)
    rows = []
    for g in range(n):
        words = [f"w{rng.randrange(200)}" for _ in range(rng.choice([1, 2, 3, 6, 30, 120, 300]))]
        for _ in range(rng.choice([1, 1, 2, 5, 12])):
            own = list(words)
            for _ in range(rng.randrange(edits)):
                own[rng.randrange(len(own))] = rng.choice(["X", "é", f"W{rng.randrange(200)}"])
            if rng.random() < 0.3:
                own += ["tail"] * rng.randrange(8)
            rows.append((rng.randrange(10**6), " ".join(own)))
    return rows


def run(spark, rows, size, num, den, **options):
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, component_id string").repartition(6)
    got = jaccard.similar_groups(df, size, num, den, **options).collect()
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str)


@pytest.mark.parametrize("case", [(3, 9, 10), (5, 8, 10)])
def test_matches_brute_force(spark, case):
    rows = near_copies(1, 120, 5)
    rows += [(rows[0][0], rows[0][1]), (None, rows[1][1]), (-5, rows[2][1]), (7, None), (8, ""), (9, " \n"), (10, "a"), (11, "A")]
    expected = brute(rows, *case)
    assert len({x[2] for x in expected}) < len(expected) - 30
    assert run(spark, rows, *case) == expected


def test_splits_of_hot_regions_and_clusters(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(150):
        own = list(words)
        for _ in range(rng.choice([0, 1, 3, 5, 9])):
            own[rng.randrange(300)] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    expected = brute(rows, 3, 9, 10)
    assert run(spark, rows, 3, 9, 10) == expected
    assert run(spark, rows, 3, 9, 10, cluster_bytes=20_000, region=20, few=0) == expected


def test_chains_of_large_clusters(spark):
    """Documents that drift apart: one cluster whose ends don't link, in many rounds of pivots."""
    rng = random.Random(8)
    words, rows = [f"w{i}" for i in range(120)], []
    for i in range(220):
        words[rng.randrange(120)] = f"e{i}"
        if i % 11 == 0:
            for _ in range(9):
                words[rng.randrange(120)] = f"e{i}"
        rows.append((i, " ".join(words)))
    expected = brute(rows, 3, 9, 10)
    assert 3 < len({x[2] for x in expected}) < 150
    assert run(spark, rows, 3, 9, 10, cluster_bytes=9000) == expected
    assert run(spark, rows, 3, 9, 10) == expected


def test_regions_of_pivots_lose_no_link():
    import numpy as np

    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 60, (6, 60)).astype(np.uint64)
    sets = []
    for _ in range(250):
        s = base[rng.integers(6)].copy()
        s[rng.random(60) < rng.choice([0.02, 0.1, 0.3])] = rng.integers(0, 1 << 60)
        sets.append(np.unique(s))
    root = list(range(len(sets)))
    for i, s in enumerate(sets):
        for j in range(i):
            both = len(np.intersect1d(s, sets[j]))
            if both * 10 >= 8 * (len(s) + len(sets[j]) - both) and root[i] != root[j]:
                old, new = root[i], root[j]
                root = [new if x == old else x for x in root]
    u = jaccard.Union(len(sets))
    for a, b in zip(*jaccard.voronoi_links(sets, 8, 10), strict=True):
        u.join(a, np.array([b]))
    groups = lambda labels: sorted(sorted(i for i in range(len(sets)) if labels[i] == x) for x in set(labels))
    assert groups(u.label.tolist()) == groups(root) and len(set(root)) > 10


@pytest.mark.parametrize("case", [(3, 9, 10), (5, 8, 10)])
def test_sets_of_one_shingle(spark, case):
    texts = [" ".join(["a"] * n) for n in range(1, 9)] + ["b b b", "B b b b", "b b b b b", "b b b b b b c", "x y z", "x y z", "x y", "x y"]
    rows = [(i, t) for i, t in enumerate(texts)]
    assert run(spark, rows, *case) == brute(rows, *case)


def test_empty(spark):
    assert run(spark, [], 3, 9, 10) == []


@pytest.mark.parametrize("case", [(3, 9, 10), (5, 8, 10)])
def test_words_that_a_polynomial_confuses(spark, case):
    rows = []
    for k in (1024, 2048, 4096, 8192):
        a = "".join("ab"[bin(i).count("1") % 2] for i in range(k))
        b = a.translate(str.maketrans("ab", "ba"))
        rows += [(k, f"{a} {b}"), (k + 1, f"{b} {a}"), (k + 2, a), (k + 3, b)]
    assert run(spark, rows, *case) == brute(rows, *case)


@pytest.mark.parametrize("case", [(3, 9, 10), (5, 8, 10)])
def test_large_clusters_write_little(spark, monkeypatch, case):
    """Families of edited copies and a chain that are far too large for a task: no round multiplies their documents."""
    rng = random.Random(11)
    rows, moving = [], [f"m{i}" for i in range(150)]
    for g in range(2):
        words = [f"g{g}w{i}" for i in range(150)]
        for i in range(120):
            own = list(words)
            for _ in range(0 if i % 3 == 0 else rng.choice([1, 2, 4, 7])):
                own[rng.randrange(150)] = f"e{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(own)))
    for i in range(80):
        for _ in range(6 if i % 20 == 0 else 2):
            moving[rng.randrange(150)] = f"c{i}x{rng.randrange(100)}"
        rows.append((len(rows), " ".join(moving)))
    written, real = [], jaccard.cut

    def cut(df, name):
        out = real(df, name)
        if "text" in out.columns:
            written.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "cut", cut)
    expected = brute(rows, *case)
    assert 3 < len({x[2] for x in expected}) < 200
    assert run(spark, rows, *case, cluster_bytes=1500) == expected
    assert sum(written) <= 2 * len(rows)


def test_finer_parts_lose_no_link():
    import numpy as np

    rng = np.random.default_rng(2)
    sets = []
    for size in (40, 300, 700, 3000):
        for _ in range(4):
            base = rng.integers(0, 1 << 62, size).astype(np.uint64)
            for _ in range(6):
                s = base.copy()
                s[rng.random(size) < rng.choice([0.02, 0.08, 0.3])] = rng.integers(0, 1 << 62)
                sets.append(np.unique(s[: int(size * rng.choice([1, 0.85]))]))
    u, n = jaccard.Union(len(sets)), np.array([len(s) for s in sets])
    for a, b in zip(*jaccard.near_by_parts(n, [jaccard.fine_parts(s) for s in sets], 8, 10), strict=True):
        u.join(a, np.array([b]))
    for i, s in enumerate(sets):
        for j in range(i):
            both = len(np.intersect1d(s, sets[j]))
            assert both * 10 < 8 * (len(s) + len(sets[j]) - both) or u.label[i] == u.label[j]
    assert len(set(u.label.tolist())) >= 16


def test_copies_in_many_tasks_make_no_pairs(spark, monkeypatch):
    """A table repeated with other ids, one copy in each of many tasks, makes no more candidates than the table once."""
    texts = [t for _, t in near_copies(4, 40, 4)]
    once = brute(list(enumerate(texts)), 3, 9, 10)
    sizes: dict = {}
    real = jaccard.cut

    def cut(df, name):
        out = real(df, name)
        if name in ("regions", "pairs", "clusters"):
            sizes[name, copies, region] = out.count()
        return out

    monkeypatch.setattr(jaccard, "cut", cut)
    for copies, region in ((1, jaccard.REGION), (12, jaccard.REGION), (12, 20)):
        rows = [(k * 1000 + i, t) for k in range(copies) for i, t in enumerate(texts)]
        df = spark.createDataFrame(rows, "doc_id long, text string").repartitionByRange(copies, "doc_id")
        got = jaccard.similar_groups(df, 3, 9, 10, region=region).collect()
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted((k * 1000 + i, n, c) for k in range(copies) for i, n, c in once)
    for name in ("regions", "pairs", "clusters"):  # ranks of words are rounded, so prefixes differ a little
        assert 0 < sizes[name, 12, jaccard.REGION] <= 1.2 * sizes[name, 1, jaccard.REGION]


def test_id_shared_by_a_copy_and_another_text(spark):
    rng = random.Random(6)
    one, other = ([f"{x}{rng.randrange(10**6)}" for _ in range(60)] for x in "ab")
    rows = [(3, " ".join(one)), (5, " ".join(one)), (5, " ".join(other)), (9, " ".join([*other, "tail"]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {(r.doc_id, r.component_id) for r in jaccard.similar_groups(df, 3, 9, 10).collect()}
    assert got == {(3, 3), (5, 3), (9, 3)}
