"""Exact substring deduplication with difference-cover anchors.

Windows of ``window`` words that also start in an earlier document are
removed. Hashes are taken only at cover positions: word positions that lie,
modulo the period, in a difference cover. Of any two places where a long
match starts, some common shift puts both on cover positions, so every match
shares an aligned anchor, and it is extended from there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm import wordhash as wh
from glyphmill.llm.common import cut

#: A perfect difference cover: every residue modulo 31 is a difference of two of these (fixed values).
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
OCCURRENCE = (("key", "<u8"), ("kind", "<u8"), ("doc", "<i8"), ("tag", "<u4"), ("pos", "<u4"), ("left", "<u4"), ("right", "<u4"))
MARK = (("doc", "<i8"), ("tag", "<u4"), ("start", "<u4"), ("end", "<u4"), ("ask", "u1"))
BLOB_SCHEMA = "bucket int, what string, blob binary"
MARK_SCHEMA = "doc_id long, tag long, removed binary, asked binary"
#: Anchors or windows that a task gathers before it combines and ships them.
FLUSH = 1 << 20


def pack(form: tuple, columns: dict[str, np.ndarray]) -> bytes:
    """Columns of equal length as one compressed value, their bytes sorted by significance."""
    parts = []
    for name, kind in form:
        x = np.ascontiguousarray(columns[name].astype(kind))
        parts.append(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(form: tuple, blobs: list[bytes]) -> dict[str, np.ndarray]:
    """The columns of many packed values, one after the other."""
    out: dict[str, list] = {name: [np.zeros(0, kind)] for name, kind in form}
    width = sum(np.dtype(kind).itemsize for _, kind in form)
    for blob in blobs:
        raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
        n, at = len(raw) // width, 0
        for name, kind in form:
            size = np.dtype(kind).itemsize
            out[name].append(np.ascontiguousarray(raw[at : at + n * size].reshape(size, n).T).view(kind).reshape(n))
            at += n * size
    return {name: np.concatenate(x) for name, x in out.items()}


def bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    return ((key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _ship(what: str, form: tuple, columns: dict[str, np.ndarray], bucket: np.ndarray) -> Iterator[pa.RecordBatch]:
    order = np.argsort(bucket, kind="stable")
    names, at = np.unique(bucket[order], return_index=True)
    if len(names):
        blobs = [pack(form, {k: v[rows] for k, v in columns.items()}) for rows in np.split(order, at[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array([what] * len(names), pa.string()), pa.array(blobs, pa.binary())], ["bucket", "what", "blob"])


def _marks(occ: dict, rows: np.ndarray, ask: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """The stretches around the given occurrences, dealt by document."""
    pos = occ["pos"][rows].astype(np.int64)
    columns = {"doc": occ["doc"][rows], "tag": occ["tag"][rows], "start": pos - occ["left"][rows], "end": pos + occ["right"][rows], "ask": np.full(len(rows), ask)}
    yield from _ship("mark", MARK, columns, bucket_of(wh.mix(columns["doc"].astype(np.uint64)), buckets))


def _ranked(occ: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by (key, kind, doc); there, which rows are the earliest document of their kind, and where keys begin."""
    order = np.lexsort((occ["doc"], occ["kind"], occ["key"]))
    key, kind, doc = (occ[c][order] for c in ("key", "kind", "doc"))
    new_key = np.ones(len(order), bool)
    new_key[1:] = key[1:] != key[:-1]
    new_kind = new_key.copy()
    new_kind[1:] |= kind[1:] != kind[:-1]
    least = doc[np.flatnonzero(new_kind)][np.cumsum(new_kind) - 1] if len(order) else doc
    return order, doc == least, new_key


def _combine(occ: dict, buckets: int) -> Iterator[pa.RecordBatch]:
    """Before the shuffle: only the earliest document of each kind travels, later ones are decided here."""
    order, earliest, _ = _ranked(occ)
    yield from _marks(occ, order[~earliest], 0, buckets)
    kept = order[earliest]
    yield from _ship("seen", OCCURRENCE, {k: v[kept] for k, v in occ.items()}, bucket_of(occ["key"][kept], buckets))


def _joined(parts: list[dict]) -> dict[str, np.ndarray]:
    return {name: np.concatenate([p[name] for p in parts]) if parts else np.zeros(0, kind) for name, kind in OCCURRENCE}


def _anchors(data: np.ndarray, offsets: np.ndarray, doc: np.ndarray, tag: np.ndarray, window: int) -> dict[str, np.ndarray]:
    """Anchors at cover positions of texts with at least one window, and hashes of all that a window with them can hold."""
    starts, ends, first = wh.words(data, offsets)
    size, reach = window - PERIOD + 1, PERIOD - 1
    count = np.diff(first)
    place = np.arange(len(starts)) - np.repeat(first[:-1], count)
    owner = np.repeat(np.arange(len(doc)), count)
    n = count[owner]
    at = np.flatnonzero(np.isin(place % PERIOD, COVER) & (place + size <= n) & (n >= window))
    sums = wh.WINDOW.sums(wh.hash_spans(data, starts, ends))
    left, right = np.minimum(reach, place[at]), np.minimum(window, n[at] - place[at])
    shape = (left * (window + 1) + right).astype(np.uint64)
    return {
        "key": wh.windows(sums, at, size, sums=sums),
        "kind": wh.windows(sums, at - left, left + right, sums=sums) + wh.mix(shape),
        "doc": doc[owner[at]], "tag": tag[owner[at]], "pos": place[at], "left": left, "right": right,
    }


def _windows(data: np.ndarray, offsets: np.ndarray, doc: np.ndarray, tag: np.ndarray, asked: list[bytes], window: int) -> dict[str, np.ndarray]:
    """Every window inside the asked stretches, by two independent hashes."""
    starts, ends, first = wh.words(data, offsets)
    hashes = wh.hash_spans(data, starts, ends)
    at, owner = [], []
    for i, blob in enumerate(asked):
        for lo, hi in np.frombuffer(blob, "<u4").reshape(-1, 2).astype(np.int64):
            at.append(np.arange(first[i] + lo, first[i] + hi - window + 1))
            owner.append(np.full(len(at[-1]), i))
    at, owner = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (at, owner))
    place = at - first[owner]
    return {
        "key": wh.windows(hashes, at, window), "kind": wh.windows(hashes, at, window, wh.WINDOW2), "doc": doc[owner], "tag": tag[owner],
        "pos": place, "left": np.zeros(len(at)), "right": np.full(len(at), window),
    }


def _reduce(buckets: int, extend: bool):
    """Per bucket: documents after the earliest of a kind are decided. If ``extend``, earliest
    ones whose anchor has more kinds ask for their windows to be compared."""

    def reduce(t: pa.Table) -> pa.Table:
        blobs = {w: [b for b, x in zip(t["blob"].to_pylist(), t["what"].to_pylist(), strict=True) if x == w] for w in ("seen", "mark")}
        out = []
        if blobs["seen"]:
            occ = unpack(OCCURRENCE, blobs["seen"])
            order, earliest, new_key = _ranked(occ)
            out += _marks(occ, order[~earliest], 0, buckets)
            if extend:
                group = np.cumsum(new_key) - 1
                kind = occ["kind"][order]
                varied = np.zeros(group[-1] + 1, bool)
                varied[group[1:][(group[1:] == group[:-1]) & (kind[1:] != kind[:-1])]] = True
                out += _marks(occ, order[earliest & varied[group]], 1, buckets)
        out += [pa.RecordBatch.from_arrays([pa.array([t["bucket"][0].as_py()] * len(blobs["mark"]), pa.int32()), pa.array(["mark"] * len(blobs["mark"]), pa.string()), pa.array(blobs["mark"], pa.binary())], ["bucket", "what", "blob"])]
        return pa.Table.from_batches(out)

    return reduce


def _unite(start: np.ndarray, end: np.ndarray) -> bytes:
    """Overlapping and adjacent stretches of one document as (start, end) pairs."""
    order = np.argsort(start, kind="stable")
    s, e = start[order].astype(np.int64), np.maximum.accumulate(end[order].astype(np.int64))
    new = np.ones(len(s), bool)
    new[1:] = s[1:] > e[:-1]
    last = np.append(np.flatnonzero(new)[1:] - 1, len(s) - 1)
    return np.stack([s[new], e[last]], 1).astype("<u4").tobytes() if len(s) else b""


def _merge(t: pa.Table) -> pa.Table:
    m = unpack(MARK, t["blob"].to_pylist())
    order = np.lexsort((m["tag"], m["doc"]))
    doc, tag = m["doc"][order], m["tag"][order]
    new = np.ones(len(order), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])
    rows = np.split(order, np.flatnonzero(new)[1:]) if len(order) else []
    pick = [[_unite(m["start"][r[m["ask"][r] == ask]], m["end"][r[m["ask"][r] == ask]]) for r in rows] for ask in (0, 1)]
    return pa.table([pa.array(doc[new]), pa.array(tag[new].astype(np.int64)), pa.array(pick[0], pa.binary()), pa.array(pick[1], pa.binary())], names=["doc_id", "tag", "removed", "asked"])


def repeated_spans(docs: DataFrame, window: int = 50, doc_id: str = "doc_id", text: str = "text", few: int = 1_000_000) -> DataFrame:
    """(doc_id, tag, removed): word stretches covered by windows that also start in a smaller doc_id.

    ``tag`` tells apart rows that share a doc_id but not the text; ``removed``
    holds little-endian uint32 (start, end) pairs, end exclusive.

    1. Tasks hash anchors at cover positions, together with the hash of the
       whole stretch that windows around the anchor can reach (its *kind*).
       Of equal kinds in a task only the earliest document travels; the later
       ones are decided on the spot. So a passage in a third of all documents
       sends few rows, and no group is gathered beyond one row per task.
    2. Per bucket of anchor hashes, later documents of a kind are removed in
       that stretch. Where one anchor has several kinds, the earliest
       documents of each are compared window by window, in a second exchange
       of the same form, by two 64-bit hashes.
    """
    if window < PERIOD + 1:
        raise ValueError(f"window must have more than {PERIOD} words")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    rows = rows.withColumn("tag", F.xxhash64("doc_id", "text").bitwiseAND(F.lit(0xFFFFFFFF)))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(16, total >> 24)

    def gather(batches: Iterator[pa.RecordBatch], make) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for b in batches:
            for lo, hi, data, offsets in wh.chunks(b.column(0)):
                doc, tag = (b.column(k).slice(lo, hi - lo).to_numpy() for k in (1, 2))
                parts.append(make(data, offsets, doc, tag.astype(np.uint32), b, lo, hi))
                size += len(parts[-1]["key"])
                if size >= FLUSH:
                    yield from _combine(_joined(parts), buckets)
                    parts, size = [], 0
        if parts:
            yield from _combine(_joined(parts), buckets)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return gather(batches, lambda data, offsets, doc, tag, b, lo, hi: _anchors(data, offsets, doc, tag, window))

    def extensions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return gather(batches, lambda data, offsets, doc, tag, b, lo, hi: _windows(data, offsets, doc, tag, b.column(3).slice(lo, hi - lo).to_pylist(), window))

    # Texts with fewer words than a window, told by their length, hold no anchor.
    long_enough = rows.where(F.octet_length("text") >= 2 * window - 1)
    found = cut(long_enough.select("text", "doc_id", "tag").mapInArrow(anchors, BLOB_SCHEMA).groupBy("bucket").applyInArrow(_reduce(buckets, True), BLOB_SCHEMA), "anchors")
    marks = cut(found.groupBy("bucket").applyInArrow(_merge, MARK_SCHEMA), "marks")
    asked = marks.where(F.octet_length("asked") > 0).select("doc_id", "tag", "asked")
    texts = some(rows, asked, few).join(asked, ["doc_id", "tag"])
    more = texts.select("text", "doc_id", "tag", "asked").mapInArrow(extensions, BLOB_SCHEMA).groupBy("bucket").applyInArrow(_reduce(buckets, False), BLOB_SCHEMA)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            runs = [np.frombuffer(x, "<u4").reshape(-1, 2) for x in b.column(2).to_pylist()]
            n = [len(r) for r in runs]
            both = np.concatenate(runs) if runs else np.zeros((0, 2), np.uint32)
            doc = np.repeat(b.column(0).to_numpy(), n)
            columns = {"doc": doc, "tag": np.repeat(b.column(1).to_numpy(), n), "start": both[:, 0], "end": both[:, 1], "ask": np.zeros(len(both))}
            yield from _ship("mark", MARK, columns, bucket_of(wh.mix(doc.astype(np.uint64)), buckets))

    decided = marks.where(F.octet_length("removed") > 0).select("doc_id", "tag", "removed").mapInArrow(again, BLOB_SCHEMA)
    return decided.unionByName(more).groupBy("bucket").applyInArrow(_merge, MARK_SCHEMA).select("doc_id", "tag", "removed")


def some(rows: DataFrame, keys: DataFrame, few: int, how: str = "left_semi") -> DataFrame:
    """``rows`` whose doc_id is (or, left_anti, isn't) among ``keys``: by a broadcast of the
    ids if they are few, counted first. A plan for more is the caller's."""
    ids = keys.select("doc_id").distinct()
    if ids.limit(few + 1).count() > few:
        return rows
    return rows.join(F.broadcast(ids), "doc_id", how)


def strip_repeats(docs: DataFrame, window: int = 50, doc_id: str = "doc_id", text: str = "text", few: int = 1_000_000) -> DataFrame:
    """Per row: doc_id, ``n_words``, ``n_removed``, ``kept_sha256`` and ``kept_text``.

    A word is removed if a window of ``window`` words that covers it also
    starts in a document with a smaller doc_id; windows are judged on the
    input. ``kept_text`` joins the other words by one space. Words are runs
    of anything but space, tab, LF, VT, FF and CR, unchanged.

    Null text has no words. Rows with a null doc_id lose nothing and remove
    nothing. Rows that share a doc_id don't remove from each other. Other
    columns are not read; an empty table gives an empty result.
    """
    marks = cut(repeated_spans(docs, window, doc_id, text, few), "repeats")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offsets in wh.chunks(b.column(1)):
                starts, ends, first = wh.words(data, offsets)
                change = np.zeros(len(starts) + 1, np.int64)
                for i, blob in enumerate(b.column(2).slice(lo, hi - lo).to_pylist()):
                    if blob:
                        runs = np.frombuffer(blob, "<u4").reshape(-1, 2).astype(np.int64) + first[i]
                        np.add.at(change, runs[:, 0], 1)
                        np.add.at(change, runs[:, 1], -1)
                kept = np.cumsum(change[:-1]) == 0
                # A kept word's bytes, and the separator after it as a space.
                inside = np.zeros(len(data) + 1, np.int8)
                inside[starts[kept]] += 1
                np.add.at(inside, ends[kept], -1)
                take = np.cumsum(inside[:-1]) > 0
                gap = ends[kept & ~wh.text_starts(len(data), offsets)[ends]] if len(starts) else starts
                take[gap] = True
                body = np.where(wh.SPACE[data], np.uint8(32), data)[take].tobytes()
                upto = np.concatenate(([0], np.cumsum(take)))[offsets]
                texts = [body[x:y].rstrip(b" ") for x, y in zip(upto[:-1], upto[1:], strict=True)]
                kept_upto = np.concatenate(([0], np.cumsum(kept)))[first]
                n = np.diff(first)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), pa.array(n), pa.array(n - np.diff(kept_upto)), pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string()), pa.array([x.decode() for x in texts], pa.string())],
                    ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"],
                )

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"
    tag = F.xxhash64("doc_id", "text").bitwiseAND(F.lit(0xFFFFFFFF))
    if marks.select("doc_id").distinct().limit(few + 1).count() > few:
        return rows.withColumn("tag", tag).join(marks, ["doc_id", "tag"], "left").select("doc_id", "text", "removed").mapInArrow(strip, schema)
    touched = some(rows, marks, few).withColumn("tag", tag).join(marks, ["doc_id", "tag"], "left").select("doc_id", "text", "removed")
    rest = some(rows, marks, few, "left_anti").select("doc_id", "text", F.lit(None).cast("binary").alias("removed"))
    return touched.unionByName(rest).mapInArrow(strip, schema)
