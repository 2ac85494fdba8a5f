"""WARC archives: an exact round trip, and damage that the reader must notice."""

import hashlib

import pytest

from glyphmill.llm import warc


def test_round_trip_is_exact(spark):
    big, bigger = "é" * 600, "<p>" + "word " * 100_000
    html = [big, big, "small", "small", None, "", bigger, big, bigger, "x" * 999, "x" * 999, "x" * 1000, "x" * 1000]
    pages = spark.createDataFrame([(i, None if i == 3 else f"http://a.example/{i}", h, "clash") for i, h in enumerate(html)], "page_id long, url string, html string, digest string")
    want = set()
    for i, h in enumerate(html):
        raw = (h or "").encode()
        last = max(j for j, g in enumerate(html) if (g or "") == (h or ""))
        refers = last if len(raw) >= 1000 and last != i else None
        want.add((i, len(raw), hashlib.sha1(raw).hexdigest(), "response" if refers is None else "revisit", refers))
    got = warc.round_trip(pages, payload=True).collect()
    assert {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got} == want and len(got) == len(html)
    assert all(bytes(r.payload) == (html[r.page_id] or "").encode() for r in got if r.record_type == "response")
    assert warc.round_trip(pages.where("false")).collect() == []


def test_damage_is_noticed():
    payload = b"<p>text</p>" * 10
    good = warc.make_record(1, "http://a", payload, hashlib.sha1(payload).digest(), None)
    assert warc.parse_record(good)["payload"] == payload
    for bad in (good[:-1], good.replace(b"WARC/1.1", b"WORC/1.1"), good.replace(b"text", b"tent"), good.replace(b"WARC-Date", b"WARC-Data")):
        with pytest.raises(warc.WarcError):
            warc.parse_record(bad)


def archive(n=40, dictionary=True):
    """Bytes of an archive as they are written: its dictionary frame, then one frame a record."""
    import hashlib
    import struct

    import zstandard

    pages = [(i, f"http://a/{i}", b"<html><head><title>page</title></head><body>common words in all pages %d</body></html>" % (i * 7919) * (1 + i % 5)) for i in range(n)]
    body = zstandard.train_dictionary(2048, [p for _, _, p in pages]).as_bytes() if dictionary else b""
    context = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(body) if body else None)
    frames = [context.compress(warc.make_record(i, u, p, hashlib.sha1(p).digest(), None)) for i, u, p in pages]
    return pages, (struct.pack("<II", warc.DICTIONARY_MAGIC, len(body)) + body if body else b""), frames


def test_dictionary_frame_is_needed_and_used():
    pages, head, frames = archive()
    assert [(r["page_id"], r["payload"]) for r in warc.read_archive(head + b"".join(frames))] == [(i, p) for i, _, p in pages]
    assert sum(map(len, frames)) < sum(map(len, archive(dictionary=False)[2]))
    for damaged in (b"".join(frames), head[:-5], head + frames[0][:-3], head + frames[0] + head + frames[1], head + b"\0\0\0", head + frames[0][:20] + b"\xff" + frames[0][21:]):
        with pytest.raises(warc.WarcError):
            list(warc.read_archive(damaged))
    skippable = b"\x50\x2a\x4d\x18" + (3).to_bytes(4, "little") + b"abc"
    assert len(list(warc.read_archive(head + skippable + frames[0]))) == 1


def test_round_trip_with_a_trained_dictionary(spark):
    pages, _, _ = archive(300)
    df = spark.createDataFrame([(i, u, p.decode(), "x") for i, u, p in pages] + [(1000 + i, None, pages[4][2].decode() * 9, "x") for i in range(6)], "page_id long, url string, html string, digest string")
    assert len(warc.train_dictionary(df, sample_rows=64)) > 0 and warc.train_dictionary(df, sample_rows=8) == b""
    got = {r.page_id: r for r in warc.round_trip(df, payload=True).collect()}
    assert all(bytes(got[i].payload) == p and got[i].payload_bytes == len(p) for i, _, p in pages)
    same = pages[4][2] * 9
    assert len(same) >= 1000 and {i: got[i].refers_to for i in range(1000, 1006)} == {**dict.fromkeys(range(1000, 1005), 1005), 1005: None}
