"""Registered queries without SQL against plain Python, over the whole tables of the smallest data set."""

import zlib
from itertools import groupby

import numpy as np
from test_native import base, linked_by_hand

from glyphmill.llm import queries

SF = "/root/testdata/sf0.001"


def documents(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_op2_spans_and_counts(spark):
    docs, got = documents(spark), queries.op2_secret_scan(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        text = docs[r.doc_id].text or ""
        kinds = [k for k, _, _ in base(text)]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(kinds.count(k) for k in ("assign", "access", "hex"))
        assert r.spans == linked_by_hand(text)


def test_op3_contract(spark):
    docs, got = documents(spark), queries.op3_kd_sharding(spark, SF).collect()
    data = {i: (r.text or "").encode() for i, r in docs.items()}
    assert sorted((r.doc_id, r["size"], r.text_crc32) for r in got) == sorted((i, len(t) + 8, zlib.crc32(t)) for i, t in data.items())
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None} and {r.shard for r in got} <= set(range(24))
    for shard, rows in groupby(sorted(got, key=lambda r: (r.shard, r.slot)), key=lambda r: r.shard):
        assert [r.slot for r in rows] == list(range(sum(x.shard == shard for x in got)))
    sizes = [sum(r["size"] for r in got if r.shard == s) for s in range(24)]
    assert max(sizes) - min(sizes) <= 4 * max(len(t) + 8 for t in data.values())


def test_op4_contract_and_accuracy(spark):
    docs, got = documents(spark), queries.op4_language_id(spark, SF).collect()
    learned = {r.lang for i, r in docs.items() if r.lang is not None and zlib.crc32(str(i).encode()) % 4 != 2}
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        text = docs[r.doc_id].text
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
        assert r.lang_pred in learned if any(c.isalpha() for c in text or "") else r.lang_pred == "und"
    held = [r for r in got if r.held_out and docs[r.doc_id].lang in learned and r.lang_pred != "und"]
    assert len(held) > 5 and sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.9 * len(held)


def test_op5_pieces_restore_every_id(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    docs, got = documents(spark), queries.op5_packing(spark, SF).collect()
    ids = {i: [*tok.encode(r.text or "", add_special_tokens=False).ids, 0] for i, r in docs.items()}
    seen = {i: 0 for i in docs}
    for r in sorted(got, key=lambda r: (r.doc_id, r.start)):  # pieces of a document follow one another without gap or overlap
        assert r.start == seen[r.doc_id] and r.length > 0 and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
        seen[r.doc_id] += r.length
    assert seen == {i: len(x) for i, x in ids.items()}
    full = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == full.get(r.sequence_id, 0)
        full[r.sequence_id] = r.offset + r.length
    assert max(full.values()) <= 1024 and sum(full.values()) >= 0.9 * 1024 * len(full)
