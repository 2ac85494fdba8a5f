import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from glyphmill.llm import packing

SCHEMA = "doc_id long, text string, start string, shard long"
ODD = ["a b  c\n\nd", "", None, "x" * 30_000, " lead and trail \n ", "naïve   nbsp wide \n x", "a<|endoftext|>b <|endoftext|>", "it's 42,000 kg!! \t\t end", "　　ab", "\x1c\x1d x"]


def rows_of(spark, texts, **options):
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)], SCHEMA)
    return packing.pack_documents(df, public_tokenizers.path("byte_bpe_50k.json"), **options).collect()


def check(rows, texts, window=1024):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = [np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for t in texts]
    at, full = {}, {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert r.start == at.get(r.doc_id, 0) and r.length > 0 and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        at[r.doc_id] = r.start + r.length
    assert at == {i: len(x) for i, x in enumerate(ids)}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == full.get(r.sequence_id, 0)
        full[r.sequence_id] = r.offset + r.length
    assert max(full.values()) <= window
    return full


def test_every_id_once_and_odd_texts(spark):
    texts = ODD * 3 + [f"word{i} again and again {i * i}" for i in range(300)]
    full = check(rows_of(spark, texts, window=64), texts, 64)
    assert sum(n < 64 for n in full.values()) <= 1


def test_whole_table_matches_the_tokenizer(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    texts = [d.text for d in docs]
    check(rows_of(spark, texts), texts)


def brute_pack(docs, weights, window):
    """The packing of one shard in plain Python, with BM25 by its formula."""
    length = [len(d) for d in docs]

    def score(q, d):
        total = 0.0
        for t in set(q):
            if tf := list(d).count(t):
                total += weights.idf[t] * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / weights.mean))
        return total

    unused, pieces, at, sequence = set(range(len(docs))), [], 0, 0

    def put(doc):
        nonlocal at, sequence
        unused.discard(doc)
        start = 0
        while start < length[doc] + 1:  # the end id
            n = min(length[doc] + 1 - start, window - at)
            pieces.append((doc, start, n, sequence, at))
            start, at = start + n, at + n
            if at == window:
                sequence, at = sequence + 1, 0

    for seed in sorted(range(len(docs)), key=lambda i: (-length[i], i)):
        if seed not in unused:
            continue
        put(seed)
        while at:
            last, got = sequence, [(-score(docs[seed], docs[d]), d) for d in sorted(unused)]
            for s, d in sorted(x for x in got if x[0] < 0):
                put(d)
                if sequence != last:
                    seed = d
                    break
            else:
                break
    return pieces


def test_packing_equals_plain_bm25():
    rng = np.random.default_rng(3)
    docs = [rng.integers(0, 60, rng.integers(0, 40)) for _ in range(80)] + [np.arange(5)] * 9
    df = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=60)
    weights = packing.Weights(df, len(docs), 20.0)
    lengths = np.array([len(d) + 1 for d in docs])
    packing.DENSE, dense = 200, packing.DENSE  # few rows fit: both parts of the index are used
    try:
        got = packing.Packer(64).pack(lengths, packing.Index(docs, weights))
    finally:
        packing.DENSE = dense
    assert got == brute_pack(docs, weights, 64)
    assert got == packing.Packer(64).pack(lengths, packing.Index(docs, weights))


def test_neighbours_are_lexical():
    # Two topics; each window of two documents must stay within one.
    docs = [np.array([t * 100 + k for k in range(10)] + [7]) for t in (0, 1) for _ in range(4)]
    weights = packing.Weights(np.full(400, 4), 8, 12.0)
    topic = {}
    for doc, _, _, sequence, _ in packing.Packer(24).pack(np.full(8, 12), packing.Index(docs, weights)):
        topic.setdefault(sequence, set()).add(doc // 4)
    assert all(len(x) == 1 for x in topic.values())


def test_ranked_is_a_stable_sort():
    rng = np.random.default_rng(1)
    score, unused = rng.integers(0, 40, 5000).astype(float), rng.random(5000) < 0.7
    at = np.flatnonzero(unused & (score > 0))
    assert list(packing.ranked(score, unused)) == at[np.argsort(-score[at], kind="stable")].tolist()


def test_deal_takes_the_weightiest_terms():
    # Few distinct weights: most are ties. Some documents have no term that is frequent enough, or none at all.
    rng = np.random.default_rng(4)
    docs = [rng.integers(0, 30, rng.integers(0, 25)) for _ in range(200)] + [np.zeros(0, int), np.array([40]), np.array([40, 3]), np.arange(3)]
    df = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=50)
    df[:30] //= 20
    df[:30] *= 20
    weights = packing.Weights(df, len(docs), 12.0)
    got = weights.deal(docs)
    for d, have in zip(docs, got.tolist(), strict=True):
        _, term, weight = weights.counted([d])
        best = sorted((-w, t) for w, t in zip(weight.tolist(), term.tolist(), strict=True) if df[t] * packing.COMMON >= len(docs))
        assert have == ([t for _, t in best] + [50] * packing.DEAL)[: packing.DEAL]
    assert weights.deal([]).shape == (0, packing.DEAL)


def test_groups_and_frequencies():
    values = np.random.default_rng(5).integers(0, 300, 4000).astype(np.uint64) << np.uint64(50)
    keys, at, group = packing._groups(values)
    assert keys.tolist() == np.unique(values).tolist()
    assert (values[at] == keys).all() and (keys[group] == values).all()
    docs = [np.array(x, np.uint16) for x in ([5, 5, 1], [], [5], [1, 9, 9, 9], [])]
    assert packing.frequencies(docs, 12).tolist() == [0, 2, 0, 0, 0, 2, 0, 0, 0, 1, 0, 0]
    assert packing.frequencies([], 3).tolist() == [0, 0, 0]


def test_shards_are_dealt_by_content(spark):
    # Ten topics of 40 texts each in random order: most windows of many small shards stay within one topic.
    rng = np.random.default_rng(2)
    topic = rng.permutation(np.repeat(np.arange(10), 40))
    texts = [" ".join(f"{'bcdfghklmn'[t]}ap{rng.integers(6)}" for _ in range(30)) for t in topic]
    rows = rows_of(spark, texts, window=256, shard_tokens=3000, part_tokens=9000)
    full = check(rows, texts, 256)
    assert sum(n < 256 for n in full.values()) <= 8
    seen = {}
    for r in rows:
        seen.setdefault(r.sequence_id, set()).add(topic[r.doc_id])
    assert sum(len(x) == 1 for x in seen.values()) > 0.6 * len(seen)


def test_parts_hold_odd_texts_and_many_copies(spark):
    texts = ODD * 3 + [f"word{i} again and again {i * i}" for i in range(300)] + ["the same text in many copies"] * 200
    full = check(rows_of(spark, texts, window=64, shard_tokens=500, part_tokens=2000), texts, 64)
    assert sum(n < 64 for n in full.values()) <= 60  # one a part at most


def test_segments_that_a_polynomial_confuses(spark):
    # Thue-Morse words of two letters and their complements: any polynomial modulo 2**64 in an odd base gives both one hash.
    texts = []
    for k in (1024, 2048, 4096, 8192):
        a = "".join("ab"[bin(i).count("1") % 2] for i in range(k))
        texts += [f"x {a} {a.translate(str.maketrans('ab', 'ba'))}", a.translate(str.maketrans("ab", "ba"))]
    check(rows_of(spark, texts), texts)


def test_ids_are_right_even_if_hashes_meet(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(packing.wh, "hash_spans", lambda data, starts, ends: (ends - starts).astype(np.uint64))
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokens, texts = packing.Tokens(open(path).read()), ["some words and other words", "more of them", ""]
    (got,) = [tokens.encode(data, offsets) for _, _, data, offsets in packing.wh.chunks(pa.array(texts))]
    assert [x.tolist() for x in got] == [Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids for t in texts]


def test_empty_and_null_ids(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert packing.pack_documents(empty, public_tokenizers.path("byte_bpe_50k.json")).collect() == []
    df = spark.createDataFrame([(None, "a b"), (None, "a b"), (3, "a b")], "doc_id long, text string")
    rows = packing.pack_documents(df, public_tokenizers.path("byte_bpe_50k.json")).collect()
    assert sorted(str(r.doc_id) for r in rows) == ["3", "None", "None"]


if __name__ == "__main__":
    pytest.main([__file__])
