import hashlib
import random
import re

from glyphmill.llm import substring

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window=50):
    docs = [(d, WORD.findall(t or "")) for d, t in rows]
    first = {}
    for d, w in docs:
        if d is not None:
            for k in range(len(w) - window + 1):
                key = tuple(w[k : k + window])
                first[key] = min(first.get(key, d), d)
    out = []
    for d, w in docs:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if d is not None and first[tuple(w[k : k + window])] < d:
                gone[k : k + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, **options):
    df = spark.createDataFrame([(d, t, "x", 3) for d, t in rows], "doc_id long, text string, tag string, removed int").repartition(5)
    got = substring.strip_repeats(df, **options).collect()
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in got)
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=str)


def test_cover():
    assert {(a - b) % substring.PERIOD for a in substring.COVER for b in substring.COVER} == set(range(substring.PERIOD))


def test_random_overlaps_match_brute_force(spark):
    rng = random.Random(5)
    vocab = ["alpha", "Beta", "γάμμα", "delta.", "e", "zz"]
    base = [[rng.choice(vocab) + str(rng.randrange(40)) for _ in range(400)] for _ in range(4)]
    rows = []
    for i in range(120):
        words = []
        for _ in range(rng.randrange(1, 5)):
            if rng.random() < 0.7:
                src, at, n = rng.choice(base), rng.randrange(350), rng.randrange(10, 160)
                words += src[at : at + n]
            words += [f"own{i}x{k}" for k in range(rng.randrange(30))]
        rows.append((rng.randrange(10_000), rng.choice([" ", "\n", "\t  ", "\x0b"]).join(words)))
    rows += [(rows[3][0], rows[3][1]), (rows[4][0], rows[5][1]), (-7, rows[6][1]), (None, rows[7][1]), (1, None), (2, ""), (3, " \n "), (4, "w " * 500), (5, "w " * 60), (6, "w " * 49), (20_000, "nb\xa0sp " * 80)]
    expected = brute(rows)
    assert sum(x[2] > 0 for x in expected) > 40
    assert run(spark, rows) == expected
    assert run(spark, rows, few=0) == expected


def test_many_copies_and_empty(spark):
    text = " ".join(f"w{i}" for i in range(90))
    rows = [(i, text + f" tail{i % 3}") for i in range(300)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_words_that_a_polynomial_confuses(spark):
    pair = []
    for k in (1024, 2048, 4096, 8192):
        a = "".join("ab"[bin(i).count("1") % 2] for i in range(k))
        pair.append((a, a.translate(str.maketrans("ab", "ba"))))
    rows = [(2 * i + j, f"{' '.join(f'w{n}' for n in range(49))} {x}") for i, p in enumerate(pair) for j, x in enumerate(p)]
    rows += [(50, " ".join(["long"] * 30_000)), (51, " ".join(["long"] * 60))]
    assert run(spark, rows) == brute(rows)
