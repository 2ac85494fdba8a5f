import numpy as np

from glyphmill.llm import vectors


def brute(rows, threshold=0.95):
    ids = [r[0] for r in rows]
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    unit = [np.array(v) / np.linalg.norm(v) if o else None for (_, v), o in zip(rows, ok, strict=True)]
    root = {i: i for i in ids}

    def find(x):
        return x if root[x] == x else find(root[x])

    n = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold:
                n[i] += 1
                n[j] += 1
                x, y = find(ids[i]), find(ids[j])
                root[max(x, y)] = min(x, y)
    return sorted((i, k, find(i), i == find(i)) for i, k in zip(ids, n, strict=True))


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, component_id string").repartition(5)
    return sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(df, **options).collect())


def sample(seed, n, dim, noise):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    return [(int(i), list(map(float, centres[rng.integers(12)] + noise * rng.normal(size=dim)))) for i in rng.permutation(n)]


def test_exact_over_cells_and_blocks(spark):
    rows = sample(1, 400, 8, 0.3)
    rows += [(1000, rows[0][1]), (1001, None), (1002, [0.0] * 8), (1003, [1.0] * 7 + [None]), (1004, [float("nan")] * 8), (1005, [1e-200] * 8), (1006, [1e200] * 8)]
    expected = brute([(i, [x * 1e200 for x in v] if i == 1005 else [x * 1e-200 for x in v] if i == 1006 else v) for i, v in rows])
    assert sum(k > 0 for _, k, _, _ in expected) > 200
    rows += [(2000 + i, [1.0, 1e-3 * i, 2.0]) for i in range(6)] + [(2100 + i, v[:5]) for i, v in rows[:150]]  # other lengths
    expected = sorted(expected + brute(rows[407:]))
    assert run(spark, rows, cell_rows=20, block_bytes=1024, slack=None) == expected
    assert run(spark, rows, slack=None) == expected


def test_hot_group_and_empty(spark):
    rows = [(i, [1.0, 0.001 * i, 0.0]) for i in range(120)] + [(500 + i, [0.0, 1.0, float(i)]) for i in range(60)]
    assert run(spark, rows, cell_rows=30, block_bytes=600, slack=None) == brute(rows)
    assert run(spark, []) == []
    assert run(spark, [(3, None)]) == [(3, 0, 3, True)]


def test_equal_vectors_of_any_length_link(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [1.0, 0.0, 0.0]), (5, [1.0, 0.0, 0.0])]
    assert run(spark, rows) == brute(rows)
    assert [x[1] for x in run(spark, rows)] == [1, 1, 0, 1, 1]


def recall(spark, rows, **options):
    expected = {r[0]: r[1:] for r in brute(rows)}
    got = {r[0]: r[1:] for r in run(spark, rows, **options)}
    assert all(got[i][0] <= expected[i][0] for i in got)
    assert sum(got[i][1] == expected[i][1] for i in got) >= 0.99 * len(got)
    found, links = (sum(x[0] for x in side.values()) for side in (got, expected))
    return found / links if links else 1 - found


def test_recall_on_the_table(spark):
    """Against brute force: the table as it is, then with noisy copies near the threshold and 25 cells."""
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    assert recall(spark, rows) == 1
    rng = np.random.default_rng(4)
    for i, v in rows[:600]:
        x = np.array(v) / np.linalg.norm(v)
        x = x + rng.uniform(0.2, 0.32) * (d := rng.normal(size=len(x))) / np.linalg.norm(d)
        rows.append((100_000 + i, list(map(float, x))))
    assert recall(spark, rows, cell_rows=100) >= 0.999
