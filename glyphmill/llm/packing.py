"""Sequence packing by lexical retrieval: a sharded BM25 index proposes what follows a document."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm import wordhash as wh
from glyphmill.llm.common import cut

#: UTF-8 of non-ASCII white space. Texts with it, or with a special token's string, are tokenised in one piece.
WIDE_SPACE = rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80"
PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


#: How byte-level BPE of this family splits a text, and the characters that stand for bytes in its vocabulary (fixed values).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]


def byte_letters() -> dict[str, int]:
    """The letter for each byte: itself if printable, else the next one from U+0100 on."""
    rest = [b for b in range(256) if b not in set(PRINTABLE)]
    return {chr(b): b for b in PRINTABLE} | {chr(256 + i): b for i, b in enumerate(rest)}


def _append(store: np.ndarray, used: int, more: np.ndarray) -> tuple[np.ndarray, int]:
    """``store`` with ``more`` after its first ``used`` entries, doubled as needed, and how many are used then."""
    while used + len(more) > len(store):
        store = np.concatenate((store, np.zeros_like(store)))
    store[used : used + len(more)] = more
    return store, used + len(more)


def _words(data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """The first ``HELD`` words of eight bytes of each span, zeros after its end; ``data`` must reach beyond."""
    every = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    masks = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
    return [every[starts + 8 * k] & masks[(size - 8 * k).clip(0, 8)] for k in range(HELD)]


def _distinct(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each document's length, the sorted ids of each document in turn, and where an id of a document occurs first."""
    length = np.array([len(d) for d in docs], np.int64)
    ids = np.concatenate([*(np.sort(d, kind="stable") for d in docs), np.zeros(0, np.uint16)])
    new = np.ones(len(ids), bool)
    new[1:] = ids[1:] != ids[:-1]
    new[(np.cumsum(length) - length)[length > 0]] = True
    return length, ids, np.flatnonzero(new)


def terms_of(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, occurrences), by document and then term."""
    length, ids, at = _distinct(docs)
    return np.repeat(np.arange(len(docs)), length)[at], ids[at].astype(np.int64), np.diff(np.append(at, len(ids)))


def frequencies(docs: list[np.ndarray], size: int) -> np.ndarray:
    """In how many documents each of ``size`` ids occurs."""
    _, ids, at = _distinct(docs)
    return np.bincount(ids[at], minlength=size)


def _groups(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct values in order, a place of each (any one: that saves a stable sort), and each value's number among them."""
    order = np.argsort(values)
    ranked = values[order]
    new = np.ones(len(order), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    at, group = np.flatnonzero(new), np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    return ranked[at], order[at], group


def _equal(a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray, size: np.ndarray) -> bool:
    """Whether the spans of ``size`` bytes at ``a_at`` and ``b_at`` hold the same bytes."""
    upto = np.cumsum(size) - size
    ramp = np.arange(int(size.sum()))
    return bool((a[np.repeat(a_at - upto, size) + ramp] == b[np.repeat(b_at - upto, size) + ramp]).all())


def _merge(a: np.ndarray, a_number: np.ndarray, b: np.ndarray, b_number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sorted lists of keys with their numbers as one."""
    place = np.searchsorted(a, b)
    return np.insert(a, place, b), np.insert(a_number, place, b_number)


class Tokens:
    """Token ids of many texts by a byte-level BPE tokenizer, each distinct segment once.

    A segment is a run of white space and the word after it, or a lone line
    feed. The pre-tokenizer never joins a word with the white space after it,
    nor a line feed with the word after it, so the ids of a text are those of
    its segments in order. What is known is found by a hash, and the bytes of
    every segment are then compared with those that its ids were made of; texts
    of a chunk in which any differ are encoded whole, so no collision can give
    wrong ids. New segments are encoded together, one a line. What is known is
    dropped beyond ``most`` segments or ``most_bytes`` bytes of them.
    """

    def __init__(self, model: str, most: int = 500_000, most_bytes: int = 1 << 25) -> None:
        import tiktoken

        self.model, self.most, self.most_bytes, self.whole = model, most, most_bytes, None
        letters, spec = byte_letters(), json.loads(model)
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(letters[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in added}
        self.size = max(*ranks.values(), *added.values(), 0) + 1
        self.odd = re.compile(b"|".join([*(re.escape(t.encode()) for t in added), WIDE_SPACE]))
        self.fast = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        (self.line,) = self._encode("\n").tolist()
        self.forget()

    def forget(self) -> None:
        self.n, (self.old, self.recent) = 0, ((np.zeros(0, np.uint64), np.zeros(0, np.int64)) for _ in range(2))
        self.start, self.count, self.at, self.size_of = (np.zeros(1 << 16, np.int32) for _ in range(4))
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.pool, self.filled = np.zeros(1 << 16, np.uint8), 0

    def _encode(self, text: str) -> np.ndarray:
        return self.fast.encode_to_numpy(text, disallowed_special=())

    def _encode_lines(self, data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of segments that are encoded as the lines of one text, and how many each has."""
        body = np.full(int(size.sum()) + len(size), 10, np.uint8)
        begin = np.cumsum(size + 1) - size - 1
        ramp = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        body[np.repeat(begin, size) + ramp] = data[np.repeat(starts, size) + ramp]
        ids = self._encode(body.tobytes().decode())
        at = np.flatnonzero(ids == self.line)
        if len(at) == len(size):
            return np.delete(ids, at), np.diff(np.concatenate(([-1], at))) - 1
        every = [self._encode(data[x : x + n].tobytes().decode()) for x, n in zip(starts.tolist(), size.tolist(), strict=True)]
        return np.concatenate([*every, np.zeros(0, np.uint32)]), np.array([len(x) for x in every], np.int64)

    def learn(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> None:
        """Encodes new segments; ``data`` must reach beyond the last."""
        # A line may hold a segment without white space but one leading space.
        head, second = data[starts], np.where(size > 1, data[starts + 1], 32)
        odd = np.isin(head, (9, 10, 11, 12, 13)) | (head == 32) & wh.SPACE[second]
        order = np.concatenate((np.flatnonzero(~odd), np.flatnonzero(odd)))
        parts = [self._encode_lines(data, starts[~odd], size[~odd])]
        for x, n in zip(starts[odd].tolist(), size[odd].tolist(), strict=True):
            ids = self._encode(data[x : x + n].tobytes().decode())
            parts.append((ids, np.array([len(ids)])))
        ids, lengths = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        count, start = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        count[order], start[order] = lengths, self.used + np.cumsum(lengths) - lengths
        self.ids, self.used = _append(self.ids, self.used, ids)
        at = self.filled + np.cumsum(size) - size
        self.pool, self.filled = _append(self.pool, self.filled, data[np.repeat(starts - (at - self.filled), size) + np.arange(int(size.sum()))])
        n = self.n
        for name, new in (("start", start), ("count", count), ("at", at), ("size_of", size)):
            setattr(self, name, _append(getattr(self, name), n, new)[0])
        self.n += len(keys)
        # New keys are merged into a short list, and that now and then into the long one.
        self.recent = _merge(*self.recent, keys, np.arange(n, self.n))
        if len(self.recent[0]) > 1 << 16:
            self.old, self.recent = _merge(*self.old, *self.recent), (np.zeros(0, np.uint64), np.zeros(0, np.int64))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of known segments; -1 for others."""
        out = np.full(len(keys), -1)
        for have, number in (self.old, self.recent):
            if len(have):
                at = np.searchsorted(have, keys).clip(max=len(have) - 1)
                hit = have[at] == keys
                out[hit] = number[at[hit]]
        return out

    def _look_up(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray | None:
        """Each segment's number among the known ones, new ones included; None if a hash stands for two segments."""
        size = ends - starts
        padded = np.append(data, np.zeros(8 * HELD + 8, np.uint8))
        held = _words(padded, starts, size)
        value = size.astype(np.uint64)
        for w in held:
            value = wh.mix(value * np.uint64(0xD6E8FEB86659FD93) + w)
        long = np.flatnonzero(size > 8 * HELD)
        if len(long):
            begin = np.cumsum(size[long]) - size[long]
            body = data[np.repeat(starts[long] - begin, size[long]) + np.arange(int(size[long].sum()))]
            value[long] = wh.mix(value[long] + wh.hash_spans(body, begin, begin + size[long]))
        keys, first, group = _groups(value)
        head = first[group]
        if not (size[head] == size).all() or any((w[head] != w).any() for w in held) or not _equal(data, starts[long], data, starts[head[long]], size[long]):
            return None
        known = self.find(keys)
        new = np.flatnonzero(known < 0)
        if len(new):
            n = self.n
            self.learn(keys[new], padded, starts[first[new]], size[first[new]])
            known[new] = np.arange(n, self.n)
        if not (self.size_of[known] == size[first]).all() or not _equal(data, starts[first], self.pool, self.at[known], size[first]):
            return None
        return known[group]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """The ids of each text."""
        if self.n > self.most or self.filled > self.most_bytes:
            self.forget()
        if not len(data):
            return [np.zeros(0, np.uint32)] * (len(offsets) - 1)
        space, edge = wh.SPACE[data], wh.text_starts(len(data), offsets)
        cut_here = edge[:-1].copy()
        cut_here[1:] |= space[1:] & ~space[:-1]
        # A lone line feed is a segment of its own.
        alone = (data[:-1] == 10) & ~space[1:]
        alone[1:] &= ~space[:-2] | edge[1:-2]
        cut_here[1:] |= alone
        starts = np.flatnonzero(cut_here)
        raw = data.tobytes()
        known = self._look_up(data, starts, np.append(starts[1:], len(data)))
        if known is None:
            out, odd = [np.zeros(0, np.uint32)] * (len(offsets) - 1), set(range(len(offsets) - 1))
        else:
            counts = self.count[known]
            upto = np.concatenate(([0], np.cumsum(counts)))
            ids = self.ids[np.repeat(self.start[known] - upto[:-1], counts) + np.arange(upto[-1])]
            bounds = upto[np.searchsorted(starts, offsets)]
            out = [ids[x:y] for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
            odd = {int(np.searchsorted(offsets, m.start(), "right")) - 1 for m in self.odd.finditer(raw)}
        for i in odd:
            if self.whole is None:
                from tokenizers import Tokenizer

                self.whole = Tokenizer.from_str(self.model)
            out[i] = np.array(self.whole.encode(raw[offsets[i] : offsets[i + 1]].decode(), add_special_tokens=False).ids, np.uint32)
        return out


def tokenise(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text", end_id: int = 0) -> DataFrame:
    """(row, doc_id, n, ids) for every document, and per task one row with document frequencies.

    ``ids`` are compressed uint32 values with ``end_id`` after each document;
    ``row`` numbers the rows. A task's last row has a null ``n`` and, in
    ``ids``, in how many of its documents each id occurs.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, packer = Tokens(shared.value), zstandard.ZstdCompressor(level=1)
        df = np.zeros(tokens.size, np.uint32)
        row = TaskContext.get().partitionId() << 36
        types = (pa.int64(), pa.int64(), pa.int64(), pa.binary())

        def batch(*columns) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["row", "doc_id", "n", "ids"])

        for b in batches:
            for lo, hi, data, offsets in wh.chunks(b.column(1)):
                every = [x.astype("<u2" if tokens.size <= 1 << 16 else "<u4") for x in tokens.encode(data, offsets)]
                df += frequencies(every, tokens.size).astype(np.uint32)
                ended = [np.append(x, x.dtype.type(end_id)) for x in every]
                sizes, blobs = [len(x) for x in ended], [packer.compress(x.tobytes()) for x in ended]
                yield batch(range(row, row + hi - lo), b.column(0).slice(lo, hi - lo), sizes, blobs)
                row += hi - lo
        yield batch([row], [None], [None], [packer.compress(df.tobytes())])
        tokens.forget()
        wh.give_back()

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(encode, "row long, doc_id long, n long, ids binary")


#: Words of eight bytes by which a segment is compared at once; longer ones byte by byte.
HELD = 3
#: Entries of the dense part of an index; ids that one index shard holds and that one task deals with.
DENSE, SHARD, PART = 1 << 22, 1 << 19, 1 << 21
#: Rows a part that are drawn to find the parts' bounds.
DRAWN = 64
#: Terms that say where a document is dealt, and the share of documents that such a term must be in.
DEAL, COMMON = 4, 50


class Weights:
    """BM25 weights from the document frequencies of the whole corpus; a frequency is one number per vocabulary entry."""

    def __init__(self, df: np.ndarray, n_docs: int, mean_length: float, k1: float = 1.2, b: float = 0.75) -> None:
        self.df, self.n_docs, self.mean, self.k1, self.b = df, n_docs, max(mean_length, 1.0), k1, b
        self.idf = np.log1p((n_docs - df + 0.5) / (df + 0.5))

    def counted(self, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, term, weight), by document and then term."""
        doc, term, tf = terms_of(docs)
        length = np.array([len(d) for d in docs])[doc]
        return doc, term, self.idf[term] * tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * length / self.mean))

    def deal(self, docs: list[np.ndarray]) -> np.ndarray:
        """Each document's ``DEAL`` weightiest terms among those in a ``COMMON``-th of all documents; missing ones come last."""
        doc, term, weight = self.counted(docs)
        often = self.df[term] * COMMON >= self.n_docs
        doc, term, weight = doc[often], term[often], weight[often]
        out = np.full((len(docs), DEAL), len(self.df), np.int32)
        for rank in range(DEAL if len(doc) else 0):
            # The weightiest term left of each document, the smallest among equals; weights are above 0.
            start = np.flatnonzero(np.diff(doc, prepend=-1))
            most = np.repeat(np.maximum.reduceat(weight, start), np.diff(np.append(start, len(doc))))
            at = np.flatnonzero((weight == most) & (most > 0))
            at = at[np.diff(doc[at], prepend=-1) > 0]
            out[doc[at], rank] = term[at]
            weight[at] = 0
        return out


class Index:
    """An inverted BM25 index of one shard: frequent terms as rows of a matrix, the others as postings."""

    def __init__(self, docs: list[np.ndarray], weights: Weights) -> None:
        doc, term, weight = weights.counted(docs)
        self.n = len(docs)
        self.terms, self.of = term, np.searchsorted(doc, np.arange(self.n + 1))
        names, first, n = np.unique(term, return_index=True, return_counts=True) if len(term) else (term, term, term)
        often = names[np.argsort(-n, kind="stable")[: max(1, DENSE // max(self.n, 1))]]
        often = often[n[np.searchsorted(names, often)] * 32 > self.n]
        column = np.full(len(weights.df) + 1, -1)
        column[often] = np.arange(len(often))
        self.column, at = column, column[term]
        self.dense = np.zeros((len(often), self.n), np.float32)
        self.dense[at[at >= 0], doc[at >= 0]] = weight[at >= 0]
        order = np.argsort(term[at < 0], kind="stable")
        self.doc, self.weight = doc[at < 0][order], weight[at < 0][order]
        self.first = np.searchsorted(term[at < 0][order], np.arange(len(weights.df) + 2))

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of all documents of the shard for all terms of ``seed``."""
        terms = self.terms[self.of[seed] : self.of[seed + 1]]
        at = self.column[terms]
        out = self.dense[at[at >= 0]].sum(0, dtype=np.float64)
        rare = terms[at < 0]
        start, count = self.first[rare], self.first[rare + 1] - self.first[rare]
        upto = np.cumsum(count)
        if len(upto) and upto[-1]:
            at = np.repeat(start - (upto - count), count) + np.arange(upto[-1])
            out += np.bincount(self.doc[at], self.weight[at], minlength=self.n)
        return out


def ranked(score: np.ndarray, unused: np.ndarray) -> Iterator[int]:
    """Unused documents with a score, best first and by number among equals; sorted in parts, as far as is asked."""
    at = np.flatnonzero(unused & (score > 0))
    while len(at):
        part = at
        if len(at) > 512:
            part = at[score[at] >= np.partition(score[at], len(at) - 256)[len(at) - 256]]
        yield from part[np.argsort(-score[part], kind="stable")].tolist()
        at = np.setdiff1d(at, part, assume_unique=True)


class Packer:
    """Fills windows one after the other; the open one goes on from shard to shard, so only the last can stay short."""

    def __init__(self, window: int, sequence: int = 0) -> None:
        self.window, self.sequence, self.offset = window, sequence, 0

    def pack(self, lengths: np.ndarray, index: Index) -> list[tuple[int, int, int, int, int]]:
        """Pieces (document, start, length, sequence, offset) that hold every id of the shard once.

        A seed, the longest unused document, opens a window; the unused
        neighbours that the index returns for it fill the window by falling
        score. One that doesn't fit is cut and seeds the next window with its
        rest.
        """
        unused, pieces = np.ones(len(lengths), bool), []

        def put(doc: int) -> None:
            unused[doc] = False
            start, left = 0, int(lengths[doc])
            while left:
                n = min(left, self.window - self.offset)
                pieces.append((doc, start, n, self.sequence, self.offset))
                start, left, self.offset = start + n, left - n, self.offset + n
                if self.offset == self.window:
                    self.sequence, self.offset = self.sequence + 1, 0

        for seed in np.argsort(-lengths, kind="stable").tolist():
            if not unused[seed]:
                continue
            put(seed)
            while self.offset:
                last = self.sequence
                for doc in ranked(index.scores(seed), unused):
                    put(doc)
                    if self.sequence != last:
                        seed = doc
                        break
                else:
                    break  # no neighbour is left: the next seed goes on in this window
        return pieces


def pack_documents(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", window: int = 1024, shard_tokens: int = SHARD, part_tokens: int = PART) -> DataFrame:
    """Pieces of sequences of at most ``window`` ids that hold every id of every document once.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id and
    offset. Each document is tokenised once; the ids are kept in the shared
    folder. Document frequencies cover the whole corpus and take one number
    per vocabulary entry.

    The index is sharded by content: documents are ordered by their weightiest
    terms (BM25 weight, among terms in a fiftieth of all documents or more),
    and a run of about ``shard_tokens`` ids in that order is a shard. Ranges of
    about ``part_tokens`` ids are dealt to tasks, with bounds from a sample of
    rows; the row number is the last part of the order, so copies or documents
    with the same terms in any number still divide. A task holds one shard at a time. For each seed the shard's
    index returns the unused neighbours, by all of the seed's terms, and they
    fill its window. A task's last window alone can be shorter than ``window``.
    Which share of the neighbours in the whole corpus lies in the shard is in
    the README.

    Null and empty texts are one end id. Null document ids pass through,
    repeated rows are packed one by one, other columns don't matter, and an
    empty table gives no pieces. ``doc_id`` must be castable to a long.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:  # a file of the driver; executors get its content
        model = f.read()
    tokens = cut(tokenise(docs, model, doc_id, text), "tokens")
    rows = tokens.where(F.col("n").isNotNull())
    total = rows.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("docs")).first()
    if not total.docs:
        return spark.createDataFrame([], PIECE_SCHEMA)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df: np.ndarray | int = 0
        for b in batches:
            for blob in b.column(0).to_pylist():
                df = df + np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint32).astype(np.int64)
        at = np.flatnonzero(df) if not isinstance(df, int) else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(df[at] if len(at) else [], pa.int64())], ["id", "n"])

    got = tokens.where(F.col("n").isNull()).select("ids").mapInArrow(add, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    size = Tokens(model).size
    df = np.zeros(size, np.int64)
    df[got["id"].to_numpy()] = got["n"].to_numpy()
    shared = spark.sparkContext.broadcast(Weights(df, total.docs, total.n / total.docs))  # one number an id
    kind = "<u2" if size <= 1 << 16 else "<u4"

    def read(blobs: pa.Array) -> list[np.ndarray]:
        unpack = zstandard.ZstdDecompressor().decompress
        return [np.frombuffer(unpack(x.as_buffer()), kind) for x in blobs]

    def keys_of(b: pa.RecordBatch) -> list[np.ndarray]:
        """The order of documents: their terms, then the row."""
        found = [shared.value.deal([x[:-1] for x in read(b.column(3).slice(lo, 256))]) for lo in range(0, b.num_rows, 256)]
        return [*np.concatenate([*found, np.zeros((0, DEAL), np.int32)]).astype(np.int64).T, b.column(0).to_numpy()]

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()) for k in keys_of(b)], names)

    names = [*(f"k{i}" for i in range(DEAL)), "at"]
    parts, bounds = max(1, round(total.n / part_tokens)), None
    rows = rows.select("row", "doc_id", "n", "ids")
    if parts > 1:
        # Bounds of the parts, from rows drawn by a hash: DRAWN rows a part reach the driver, five numbers each.
        drawn = rows.where(F.pmod(F.xxhash64("row"), F.lit(1 << 30)) < (1 << 30) * min(1.0, DRAWN * parts / total.docs))
        got = drawn.mapInArrow(draw, ", ".join(f"{k} long" for k in names)).toArrow()
        every = np.stack([got[k].to_numpy() for k in names], 1)
        every = every[np.lexsort(every.T[::-1])]
        bounds = spark.sparkContext.broadcast(every[np.unique(np.arange(1, parts) * len(every) // parts)] if len(every) else every)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = np.stack(keys_of(b), 1)
            part = np.zeros(len(keys), np.int32)
            if bounds is not None:  # how many bounds lie at or before each row, both merged in order
                both = np.concatenate((bounds.value, keys))
                order = np.lexsort((np.arange(len(both)), *both.T[::-1]))
                upto = np.cumsum(order < len(bounds.value))
                own = order >= len(bounds.value)
                part[order[own] - len(bounds.value)] = upto[own]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(part), *(pa.array(k, pa.int64()) for k in keys.T)], [*b.schema.names, "part", *names])

    dealt = rows.mapInArrow(deal, "row long, doc_id long, n long, ids binary, part int, " + ", ".join(f"{k} long" for k in names))
    dealt = (dealt.repartitionById(parts, F.col("part")) if parts > 1 else dealt.coalesce(1)).sortWithinPartitions(*names)

    def pack_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(window, TaskContext.get().partitionId() << 36)

        def shard(ids: list[np.ndarray], who: list) -> Iterator[pa.RecordBatch]:
            lengths = np.array([len(x) for x in ids])
            pieces = packer.pack(lengths, Index([x[:-1] for x in ids], shared.value))
            for lo in range(0, len(pieces), 10_000):
                doc, start, n, sequence, offset = np.array(pieces[lo : lo + 10_000], np.int64).T
                crc = [zlib.crc32(ids[d][s : s + k].astype("<u4").tobytes()) for d, s, k in zip(doc.tolist(), start.tolist(), n.tolist(), strict=True)]
                columns = [[who[d] for d in doc], start, n, crc, lengths[doc], sequence, offset]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
            wh.give_back()

        ids, who, held = [], [], 0
        for b in batches:
            for i, blob, n in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                ids += read([blob])
                who.append(i)
                held += n
                if held >= shard_tokens:
                    yield from shard(ids, who)
                    ids, who, held = [], [], 0
        if ids:
            yield from shard(ids, who)

    return dealt.select("doc_id", "ids", "n").mapInArrow(pack_part, PIECE_SCHEMA)
