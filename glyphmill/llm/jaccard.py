"""Exact Jaccard join of n-gram sets as a metric-space join over pivots.

The Jaccard distance is a metric, and the join goes by pivots, Voronoi regions
and triangle-inequality windows on two levels.

Documents of a corpus lie at distances near 1 from any document that one could
take as a pivot, so pivots that are documents would send nearly every one to
nearly all regions (measured in the README). The first level therefore takes
the single shingles, {s}, as pivots. A set lies nearest to those of its own
shingles, all at the same distance; ties are broken by one order of all
shingles, those of rare words first. A set within the distance bound of another
has its region among the first shingles of the other, so each set is replicated
into the regions of its first ``n - ceil(t n) + 1`` shingles and no pair is
lost. Within a region the triangle inequality prunes: for parts P of the
shingle universe, ``||A n P| - |B n P||`` summed over the parts is at most the
size of the symmetric difference. The candidate pairs that remain link
documents to clusters.

The second level joins each cluster with documents as pivots, whose distances
tell much there: a document's home is the region of its nearest pivot, and it
visits those whose pivot is at most the distance bound farther. Regions are
joined recursively within a task. Clusters too large for one are first split by
finer parts; in what stays large, documents that links with pivots connect are
one component, and only the others visit regions, by windows of twice the bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm import wordhash as wh
from glyphmill.llm.common import apart, bounded, cut, release
from glyphmill.llm.components import components
from glyphmill.llm.substring import FLUSH, bucket_of, pack, unpack

#: Places of the frequency sketch and slices in which it travels; parts of the shingle universe.
PLACES, SLICES, PARTS = 1 << 20, 64, 32
PIVOT = (("key", "<u8"), ("row", "<u4"))
SETS = (("doc", "<i8"), ("n", "<u4"), ("mark", "<u8"), *((f"p{i}", "<u2") for i in range(PARTS)))
REGION_SCHEMA = "bucket int, what string, a long, b long, sets binary, pivots binary"
#: Sets from which on a candidate pair is tested once more, by finer parts.
FINE = 256
#: Documents of one region that one task compares; larger regions are split into pairs of blocks.
REGION = 20_000
#: Documents that are compared without pivots; pivots of a region; a region that keeps more of its parent isn't split again.
FEW, PIVOTS, SHRINK = 32, 8, 0.7
#: Bytes of finer parts, times those of a cluster's texts, that one task compares with as many others.
WIDE = 4


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, text bounds, word hashes, first words) of all windows of ``size`` folded words; shorter texts are one window."""
    starts, ends, first = wh.words(data, offsets)
    n = np.diff(first)
    place = np.arange(len(starts)) - np.repeat(first[:-1], n)
    total = np.repeat(n, n)
    at = np.flatnonzero((place + size <= total) | ((place == 0) & (total < size)))
    words = wh.hash_spans(wh.FOLD[data], starts, ends)
    hashes = wh.windows(words, at, np.minimum(size, total[at])) + total[at].clip(max=size).astype(np.uint64)
    return hashes, np.searchsorted(at, first), words, at


def sets_of(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    hashes, bounds, _, _ = shingles(data, offsets, size)
    return [np.unique(hashes[x:y]) for x, y in zip(bounds[:-1], bounds[1:], strict=True)]


def ordered_sets(data: np.ndarray, offsets: np.ndarray, size: int, weight: np.ndarray) -> list[np.ndarray]:
    """Each text's distinct shingles as sorted keys: the weight of the shingle's rarest word in 8 bits, then 56 bits of its hash."""
    hashes, bounds, words, at = shingles(data, offsets, size)
    own = np.append(weight[place_of(words)], np.full(size, 255))
    rank = own[at]
    for k in range(1, size):  # a shingle is in no more documents than its rarest word
        np.minimum(rank, own[at + k], out=rank)
    rank = rank.astype(np.uint64)
    # A text that is shorter than a window has one: its rank reads its hash instead. Others keep their rank,
    # which depends on the shingle alone, so equal sets of one shingle meet whatever their texts' lengths.
    short = np.repeat(np.diff(bounds) == 1, np.diff(bounds)) & (np.diff(at, append=len(words)) < size)
    rank[short] = hashes[short] >> np.uint64(56)
    key = (rank << np.uint64(56)) | (hashes >> np.uint64(8))
    return [np.unique(key[x:y]) for x, y in zip(bounds[:-1], bounds[1:], strict=True)]


def prefix_length(n: int, num: int, den: int) -> int:
    return n - -(-n * num // den) + 1


def place_of(shingle: np.ndarray) -> np.ndarray:
    return (shingle >> np.uint64(44)).astype(np.int64)


def _frequency(texts: DataFrame, size: int) -> np.ndarray:
    """How often words, and shingles, of each place occur: twice ``PLACES`` numbers, whatever the corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * PLACES, np.int64)
        for b in batches:
            for _, _, data, offsets in wh.chunks(b.column(0)):
                hashes, _, words, _ = shingles(data, offsets, size)
                total[:PLACES] += np.bincount(place_of(words), minlength=PLACES)
                total[PLACES:] += np.bincount(place_of(hashes), minlength=PLACES)
        blobs = [zstandard.compress(x.tobytes(), 1) for x in np.split(total, SLICES)]
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array(blobs, pa.binary())], ["slice", "counts"])

    def add(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(zstandard.decompress(x.as_py()), np.int64) for x in t["counts"])
        return pa.table([t["slice"][:1].combine_chunks(), pa.array([zstandard.compress(total.tobytes(), 1)], pa.binary())], names=["slice", "counts"])

    rows = texts.mapInArrow(count, "slice int, counts binary").groupBy("slice").applyInArrow(add, "slice int, counts binary").collect()
    total = np.zeros(2 * PLACES, np.int64)
    for r in rows:
        total.reshape(SLICES, -1)[r.slice] = np.frombuffer(zstandard.decompress(r.counts), np.int64)
    return total


class Union:
    """Components of 0..n-1 as labels; merging relabels in one numpy step."""

    def __init__(self, n: int) -> None:
        self.label, self.moved = np.arange(n), False

    def join(self, i: int, others: np.ndarray) -> None:
        names = self.label[others]
        names = names[names != self.label[i]]
        if len(names):
            self.label[np.isin(self.label, names)] = self.label[i]
            self.moved = True

    def leaders(self) -> Iterator[int]:
        """Members to compare with all others until none outside the largest component is left."""
        used = np.zeros(len(self.label), bool)
        rest = iter(range(min(1, len(used))))
        self.moved = False
        while True:
            if self.moved or (used.sum() == 1):
                names, counts = np.unique(self.label, return_counts=True)
                rest, self.moved = iter(np.flatnonzero(~used & (self.label != names[np.argmax(counts)]))), False
            if (i := next(rest, None)) is None:
                return
            used[i] = True
            yield int(i)

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """(member, first member of its component) for all others."""
        names, first, inverse = np.unique(self.label, return_index=True, return_inverse=True)
        root = first[inverse]
        at = np.flatnonzero(root != np.arange(len(root)))
        return at, root[at]


def _near(n_a, n_b, p_a, p_b, num: int, den: int) -> np.ndarray:
    """Whether sizes and parts leave room for the similarity."""
    sizes = n_a + n_b
    gap = np.abs(p_a - p_b).sum(-1)
    return (np.minimum(n_a, n_b) * den >= np.maximum(n_a, n_b) * num) & (gap * (den + num) <= sizes * (den - num))


def _mark(s: np.ndarray) -> bytes:
    """The same for equal sets only, up to hashes."""
    return np.add.reduce(s).tobytes() + np.bitwise_xor.reduce(wh.mix(s)).tobytes() + len(s).to_bytes(8, "little")


def first_of_equal(doc: np.ndarray, n: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """For each set the place of the one with the smallest id among those of its size and mark."""
    order = np.lexsort((doc, n, mark))
    new = np.append(True, (mark[order[1:]] != mark[order[:-1]]) | (n[order[1:]] != n[order[:-1]]))
    out = np.empty(len(doc), np.int64)
    out[order] = order[new][np.cumsum(new) - 1]
    return out


def _equal(scanned: DataFrame) -> DataFrame:
    """Links (a, b) of all documents of a scan to the smallest id among those with an equal set; equal sets within a task are linked first."""
    marks = scanned.where("what = 'mark'").select("a", F.col("sets").alias("mark"))
    first = marks.groupBy("mark").agg(F.min("a").alias("b"), F.max("a").alias("last")).where("last > b").select("mark", "b")
    return scanned.where("what = 'copy'").select("a", "b").unionByName(marks.join(first, "mark").where("a <> b").select("a", "b"))


def fine_parts(s: np.ndarray) -> np.ndarray:
    """How many of a set are in each of its finer parts, of about four to eight each; 255 stands for more too."""
    p = 1 << max(5, len(s).bit_length() - 3)
    return np.bincount((s & np.uint64(p - 1)).astype(np.int64), minlength=p).clip(max=255).astype(np.uint8)


def _deal(bucket: np.ndarray, table: dict, key: np.ndarray, row: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sets and their pivots, one row a bucket."""
    order = np.lexsort((key, bucket))
    names, at = np.unique(bucket[order], return_index=True)
    out: tuple[list, list] = ([], [])
    for part in np.split(order, at[1:]) if len(order) else []:
        used, inverse = np.unique(row[part], return_inverse=True)
        out[0].append(pack(SETS, {k: v[used] for k, v in table.items()}))
        out[1].append(pack(PIVOT, {"key": key[part], "row": inverse}))
    none = [None] * len(names)
    yield _rows(["sets"] * len(names), none, none, *out, names.tolist())


def _scan(texts: DataFrame, size: int, num: int, den: int, buckets: int, frequency: np.ndarray) -> DataFrame:
    """Rows ``doc`` (id, set size), ``copy`` (ids of equal sets), ``mark`` (id and mark of a set that travels) and ``sets`` (sets with the pivots of a bucket)."""
    weight = np.rint(6 * np.log2(frequency[:PLACES] + 1.0)).clip(max=255).astype(np.int64)
    shared = texts.sparkSession.sparkContext.broadcast(weight)

    def flush(docs: list[int], sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        copies, keys, rows, n, parts, ids, marks = [], [], [], [], [], [], []
        for doc, s in zip(docs, sets, strict=True):
            if not len(s):
                continue
            mark = _mark(s)
            if (other := seen.setdefault(mark, doc)) != doc:
                copies.append((doc, other))
                continue
            key = s[: prefix_length(len(s), num, den)]
            rows.append(np.full(len(key), len(ids)))
            keys.append(key)
            ids.append(doc)
            marks.append(mark)
            n.append(len(s))
            parts.append(np.bincount((s & np.uint64(PARTS - 1)).astype(np.int64), minlength=PARTS).clip(max=65535))
        none = [None] * len(copies)
        yield _rows(["copy"] * len(copies), [x for x, _ in copies], [y for _, y in copies], none, none, [x % buckets for x, _ in copies])
        if ids:
            none = [None] * len(ids)
            yield _rows(["mark"] * len(ids), ids, none, marks, none, [x % buckets for x in ids])
            key, row = np.concatenate(keys), np.concatenate(rows)
            table = {"doc": np.array(ids), "n": np.array(n), "mark": np.array([int.from_bytes(x[:8], "little") for x in marks], np.uint64)} | {f"p{i}": x for i, x in enumerate(np.array(parts).T)}
            yield from _deal(bucket_of(key, buckets), table, key, row)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, sets, held = [], [], 0
        for b in batches:
            for lo, hi, data, offsets in wh.chunks(b.column(1)):
                ids, got = b.column(0).slice(lo, hi - lo).to_pylist(), ordered_sets(data, offsets, size, shared.value)
                none = [None] * len(ids)
                yield _rows(["doc"] * len(ids), ids, [len(s) for s in got], none, none, [i % buckets for i in range(len(ids))])
                for i, s in zip(ids, got, strict=True):
                    if i is not None:
                        docs.append(i)
                        sets.append(s)
                        held += len(s)
                if held >= FLUSH:
                    yield from flush(docs, sets)
                    docs, sets, held = [], [], 0
        yield from flush(docs, sets)

    return texts.select("doc_id", "text").mapInArrow(scan, REGION_SCHEMA)


def _split_hot(sets: DataFrame, frequency: np.ndarray, buckets: int, region: int) -> DataFrame:
    """``sets``, where each region of more than ``region`` documents is replaced by all pairs of its blocks.

    Sizes are counted exactly, for those shingles only that share a place of
    the sketch with more than ``region`` occurrences. The driver gets one row
    for each region that is too large, at most one for ``region`` pivots.
    """
    hot_place = frequency[PLACES:] > region
    if not hot_place.any():
        return sets
    spark = sets.sparkSession
    places = spark.sparkContext.broadcast(np.packbits(hot_place))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = np.unpackbits(places.value).astype(bool)
        for b in batches:
            key = np.concatenate([unpack(PIVOT, [x])["key"] for x in b.column(0).to_pylist()] or [np.zeros(0, np.uint64)])
            names, n = np.unique(key[hot[place_of(key << np.uint64(8))]], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(n)], ["key", "n"])

    large = sets.select("pivots").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > region).toArrow()
    if not len(large):
        return sets
    names = large["key"].to_numpy().view(np.uint64)
    order = np.argsort(names)
    shared = spark.sparkContext.broadcast((names[order], large["n"].to_numpy()[order]))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, n = shared.value
        for b in batches:
            for i in range(b.num_rows):
                one = b.slice(i, 1)
                pivot = unpack(PIVOT, one.column(5).to_pylist())
                key, row = pivot["key"], pivot["row"].astype(np.int64)
                at = np.searchsorted(names, key).clip(max=len(names) - 1)
                hot = names[at] == key
                if not hot.any():
                    yield pa.RecordBatch.from_arrays(one.columns, one.schema.names)
                    continue
                table = unpack(SETS, one.column(4).to_pylist())
                keys, rows = [key[~hot]], [row[~hot]]
                blocks = (n[at[hot]] // region + 1).astype(np.int64)
                own = (wh.mix(table["mark"][row[hot]]) >> np.uint64(32)).astype(np.int64) % blocks  # equal sets share a block
                other = _ramp(blocks)
                own, blocks, base = (np.repeat(x, blocks) for x in (own, blocks, key[hot]))
                pair = np.minimum(own, other) * blocks + np.maximum(own, other)
                keys.append(wh.mix(base + pair.astype(np.uint64) + np.uint64(1)))
                rows.append(np.repeat(row[hot], (n[at[hot]] // region + 1).astype(np.int64)))
                key, row = np.concatenate(keys), np.concatenate(rows)
                yield from _deal(bucket_of(key, buckets), table, key, row)

    return sets.mapInArrow(split, REGION_SCHEMA)


def _join_regions(sets: DataFrame, num: int, den: int) -> DataFrame:
    """Rows (what, a, b), ``near`` and ``pair``: ids of candidates; a pair is to be tested by finer parts.

    Equal sets are in the same regions. Only that of the smallest id is compared, so copies make no pairs.
    """

    def join(t: pa.Table) -> pa.Table:
        tables, keys, rows, upto = [], [], [], 0
        for sets, pivots in zip(t["sets"].to_pylist(), t["pivots"].to_pylist(), strict=True):
            tables.append(unpack(SETS, [sets]))
            p = unpack(PIVOT, [pivots])
            keys.append(p["key"])
            rows.append(p["row"].astype(np.int64) + upto)
            upto += len(tables[-1]["doc"])
        doc = np.concatenate([x["doc"] for x in tables])
        n = np.concatenate([x["n"] for x in tables]).astype(np.int64)
        part = np.stack([np.concatenate([x[f"p{i}"] for x in tables]) for i in range(PARTS)], 1).astype(np.int32)
        key, row = np.concatenate(keys), first_of_equal(doc, n, np.concatenate([x["mark"] for x in tables]))[np.concatenate(rows)]
        order = np.lexsort((row, key))
        key, row = key[order], row[order]
        own = np.append(True, (key[1:] != key[:-1]) | (row[1:] != row[:-1]))
        key, row = key[own], row[own]
        begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        count = np.diff(np.append(begin, len(key)))
        small = (count > 1) & (count <= 16)
        pairs = [np.zeros(0, np.int64)]
        base, size_of = begin[small], count[small]
        for step in range(1, 16):  # within small regions: members that are ``step`` apart
            base, size_of = base[size_of > step], size_of[size_of > step]
            if not len(base):
                break
            left = np.repeat(base, size_of - step) + _ramp(size_of - step)
            pairs.append(np.unique(row[left] * upto + row[left + step]))
        code = np.unique(np.concatenate(pairs))
        a, b = code // upto, code % upto
        ok = np.concatenate([_near(n[x], n[y], part[x], part[y], num, den) for x, y in zip(np.array_split(a, len(a) // 65536 + 1), np.array_split(b, len(b) // 65536 + 1), strict=True)])
        a, b = a[ok], b[ok]
        fine = np.maximum(n[a], n[b]) >= FINE
        pairs = doc[a[fine]], doc[b[fine]]
        ends = [(a[~fine], b[~fine])]
        for k in np.flatnonzero(count > 16):  # larger ones: only as many comparisons as connect them
            members = np.unique(row[begin[k] : begin[k] + count[k]])
            u = Union(len(members))
            for i in u.leaders():
                u.join(i, np.flatnonzero(_near(n[members[i]], n[members], part[members[i]], part[members], num, den)))
            x, y = u.edges()
            ends.append((members[x], members[y]))
        a, b = (doc[np.concatenate([e[i] for e in ends])] for i in (0, 1))
        out = []
        for what, x, y in (("near", a, b), ("pair", *pairs)):
            out.append(pa.table([pa.array([what] * len(x), pa.string()), pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["what", "a", "b"]))
        wh.give_back()
        return pa.concat_tables(out)

    return sets.select("bucket", "sets", "pivots").groupBy("bucket").applyInArrow(join, "what string, a long, b long")


def _ramp(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count, one after the other."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def _rows(what: list, a: list, b: list, sets: list, pivots: list, bucket: list) -> pa.RecordBatch:
    types = (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((bucket, what, a, b, sets, pivots), types, strict=True)], ["bucket", "what", "a", "b", "sets", "pivots"])


def _picked(rows: DataFrame, keys: DataFrame, few: int) -> DataFrame:
    """``rows`` with the columns of ``keys``, which holds a doc_id once: by a broadcast of up to
    ``few`` counted keys, so that texts stay where they are, else by a shuffle."""
    return rows.join(F.broadcast(keys) if keys.limit(few + 1).count() <= few else keys, "doc_id")


def _test_pairs(rows: DataFrame, pairs: DataFrame, size: int, num: int, den: int, few: int) -> DataFrame:
    """The candidate pairs (a, b) that pass the bound by parts of about four shingles each.

    Each document of a pair is scanned once for its counts, a byte a part.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offsets in wh.chunks(b.column(1)):
                out = []
                for s in sets_of(data, offsets, size):
                    out.append(np.int64(len(s)).tobytes() + fine_parts(s).tobytes())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(out, pa.binary())], ["doc_id", "parts"])

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                both = int.from_bytes(x[:8], "little") + int.from_bytes(y[:8], "little")
                x, y = (np.frombuffer(z, np.uint8, offset=8) for z in (x, y))
                full = (x == 255).any() or (y == 255).any()
                p = min(len(x), len(y))
                gap = np.abs(x.reshape(-1, p).sum(0, dtype=np.int64) - y.reshape(-1, p).sum(0, dtype=np.int64)).sum()
                keep.append(bool(full or gap * (den + num) <= both * (den - num)))
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    pairs = cut(pairs.distinct(), "pairs")
    ids = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    # Rows that share a doc_id are one node; such a node's pairs pass if any of its rows does.
    counts = cut(_picked(rows, ids, few).select("doc_id", "text").mapInArrow(count, "doc_id long, parts binary"), "parts")
    both = pairs.join(counts.select(F.col("doc_id").alias("a"), F.col("parts").alias("x")), "a").join(counts.select(F.col("doc_id").alias("b"), F.col("parts").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(test, "a long, b long")


class Overlaps:
    """Sizes of the intersections of one set with many, by an inverted index."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.n = np.array([len(s) for s in sets], np.int64)
        owner = np.repeat(np.arange(len(sets)), self.n)
        every = np.concatenate([*sets, np.zeros(0, np.uint64)])
        order = np.argsort(every, kind="stable")
        self.owner, every = owner[order], every[order]
        self.value, first = np.unique(every, return_index=True)
        self.first = np.append(first, len(every))

    def common(self, s: np.ndarray) -> np.ndarray:
        if not len(s) or not len(self.value):
            return np.zeros(len(self.n), np.int64)
        at = np.searchsorted(self.value, s).clip(max=len(self.value) - 1)
        at = at[self.value[at] == s]
        count = self.first[at + 1] - self.first[at]
        return np.bincount(self.owner[np.repeat(self.first[at], count) + _ramp(count)], minlength=len(self.n))

    def linked(self, s: np.ndarray, num: int, den: int) -> np.ndarray:
        both = self.common(s)
        return np.flatnonzero((both > 0) & (both * den >= (self.n + len(s) - both) * num))

    def distance(self, s: np.ndarray) -> np.ndarray:
        both = self.common(s)
        return 1 - both / np.maximum(self.n + len(s) - both, 1)


def _all_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    return [s for _, _, data, offsets in wh.chunks(texts) for s in sets_of(data, offsets, size)]


def visits(distance: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """From distances [pivot, document]: homes, and which regions [pivot, document] each belongs to, its home among them.

    Let x live with pivot a and y with b, at most r apart. Then d(x, b) -
    d(x, a) and d(y, a) - d(y, b) add up to at most 2 r, so one of them is at
    most r, and that document visits the other's region.
    """
    home = distance.argmin(0)
    nearest = distance[home, np.arange(distance.shape[1])]
    return home, distance - nearest <= 1 - num / den + 1e-9


def voronoi_links(sets: list[np.ndarray], num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(member, first member of its component) of sets that links connect; regions of pivots are joined recursively."""
    out = Union(len(sets))

    def join(members: np.ndarray) -> None:
        own = [sets[i] for i in members]
        index = Overlaps(own)
        if len(members) > FEW:
            rows = [index.distance(own[0])]
            while len(rows) < PIVOTS:  # farthest first
                rows.append(index.distance(own[int(np.argmax(np.min(rows, axis=0)))]))
            _, inside = visits(np.array(rows), num, den)
            parts = [members[x] for x in np.unique(inside, axis=0) if x.any()]
            if max(map(len, parts)) <= SHRINK * len(members):
                for part in parts:
                    join(part)
                return
        u = Union(len(members))
        for i in u.leaders():
            u.join(i, index.linked(own[i], num, den))
        for x, y in zip(*u.edges(), strict=True):
            out.join(members[x], members[y : y + 1])

    join(np.arange(len(sets)))
    return out.edges()


def _join_clusters(members: DataFrame, size: int, num: int, den: int, cluster: str = "cluster") -> DataFrame:
    """True links that connect each cluster (cluster, doc_id, text), one task a cluster."""

    def join(t: pa.Table) -> pa.Table:
        doc = t["doc_id"].to_numpy()
        a, b = voronoi_links(_all_sets(t["text"], size), num, den)
        return pa.table([pa.array(doc[a]), pa.array(doc[b])], names=["a", "b"])

    return members.groupBy(cluster).applyInArrow(join, "a long, b long")


def _sketched(members: DataFrame, size: int) -> DataFrame:
    """(cluster, doc_id, w, n, mark, parts) of (cluster, doc_id, text): bytes, set size, mark and finer parts of each set that isn't empty."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offsets in wh.chunks(b.column(2)):
                sets = sets_of(data, offsets, size)
                columns = [pa.array(np.diff(offsets), pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([_mark(s) for s in sets], pa.binary()), pa.array([fine_parts(s).tobytes() for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays([*(b.column(i).slice(lo, hi - lo) for i in (0, 1)), *columns], ["cluster", "doc_id", "w", "n", "mark", "parts"])

    return members.select("cluster", "doc_id", "text").mapInArrow(sketch, "cluster long, doc_id long, w long, n long, mark binary, parts binary").where("n > 0")


def near_by_parts(n: np.ndarray, parts: list[np.ndarray], num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(member, first member of its component) of sets that may link by their finer parts, which are folded to the fewer ones of two."""
    order = np.argsort(n, kind="stable")
    n, parts = n[order], [parts[i] for i in order]
    width = np.array([len(x) for x in parts])
    full = np.array([(x == 255).any() for x in parts])
    coarse = np.stack([x.reshape(-1, 32).sum(0, dtype=np.int32) for x in parts])
    tables = {p: np.stack([parts[i] for i in np.flatnonzero(width == p)]) for p in np.unique(width).tolist()}
    place = np.zeros(len(n), np.int64)
    for p in tables:
        place[width == p] = np.arange((width == p).sum())
    u = Union(len(n))
    for i in u.leaders():
        lo, hi = np.searchsorted(n, -(-n[i] * num // den)), np.searchsorted(n, n[i] * den // num, "right")
        some = np.arange(lo, hi)[(u.label[lo:hi] != u.label[i])]
        room = (n[some] + n[i]) * (den - num)
        fits = full[some] | full[i] | (np.abs(coarse[some] - coarse[i]).sum(1) * (den + num) <= room)
        some, room = some[fits], room[fits]
        for p in np.unique(width[some]).tolist():
            those = np.flatnonzero(width[some] == p)
            q = min(p, width[i])
            own = parts[i].reshape(-1, q).sum(0, dtype=np.int32)
            for at in np.array_split(those, len(those) * p // (1 << 22) + 1):
                gap = np.abs(tables[p][place[some[at]]].reshape(len(at), -1, q).sum(1, dtype=np.int32) - own).sum(1)
                u.join(i, some[at][full[some[at]] | full[i] | (gap * (den + num) <= room[at])])
    x, y = u.edges()
    return order[x], order[y]


def _narrow(sketches: DataFrame, num: int, den: int, block: int) -> DataFrame:
    """Links (a, b) that the finer parts allow and that connect their components, by pairs of blocks of about ``block`` bytes of parts."""

    def near(t: pa.Table) -> pa.Table:
        doc, parts = t["doc_id"].to_numpy(), [np.frombuffer(x.as_py(), np.uint8) for x in t["parts"]]
        x, y = near_by_parts(t["n"].to_numpy(), parts, num, den)
        wh.give_back()
        return pa.table([pa.array(doc[x]), pa.array(doc[y])], names=["a", "b"])

    weight = sketches.groupBy("cluster").agg(F.ceil(F.sum(F.octet_length("parts")) / block).cast("long").alias("blocks"))
    dealt = sketches.join(weight, "cluster").withColumn("own", F.pmod(F.xxhash64("doc_id", "mark"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("cluster", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "doc_id", "n", "parts")
    return dealt.groupBy("cluster", "x", "y").applyInArrow(near, "a long, b long")


def _join_large(rows: DataFrame, sent: DataFrame, size: int, num: int, den: int, block: int, few: int) -> DataFrame:
    """True links that connect clusters (doc_id, cluster) which are too large for a task.

    Equal sets are linked first, and one of them goes on. Finer parts, a few
    hundredths of the texts, split chains of documents that only the coarse
    ones hold for near. Clusters of up to ``block`` bytes of text are then
    joined in a task, and larger ones by :func:`_join_by_pivots`.
    """
    sketches = cut(_sketched(_picked(rows, sent, few), size), "sketches")
    first = sketches.groupBy("cluster", "mark").agg(F.min("doc_id").alias("b"))
    same = cut(sketches.join(first, ["cluster", "mark"]).where("doc_id <> b").select(F.col("doc_id").alias("a"), "b"), "links")
    one = cut(sketches.groupBy("cluster", "mark").agg(F.min_by(F.struct("doc_id", "w", "n", "parts"), "doc_id").alias("x"), F.count(F.lit(1)).alias("k")).select("cluster", "mark", "x.*", "k"), "sketches")
    release(sketches)
    groups = components(_narrow(one, num, den, WIDE * block))
    groups = cut(one.join(groups, F.col("doc_id") == F.col("node")).groupBy("doc_id", F.col("component").alias("cluster")).agg(F.sum("w").alias("w"), F.sum("k").alias("k")), "clusters")
    release(one)
    weight = groups.groupBy("cluster").agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("c"))
    large = cut(weight.where(F.col("w") > block), "oversize")
    small = groups.join(large, "cluster", "left_anti").select("doc_id", "cluster")
    links = same.unionByName(cut(_join_clusters(_picked(rows, small, few), size, num, den), "links"))
    if large.isEmpty():
        return links
    rest = groups.select("doc_id", "cluster", "k").join(large, "cluster")
    return links.unionByName(_join_by_pivots(_picked(rows, rest, few), size, num, den, block))


def _join_by_pivots(members: DataFrame, size: int, num: int, den: int, block: int) -> DataFrame:
    """True links that connect clusters (cluster, doc_id, text, ``k`` equal sets; bytes ``w`` and documents ``c`` of the cluster).

    Some documents of every cluster are drawn as pivots, that with the most
    equal sets, the likely origin of edited ones, among them. Their exact
    distances to its documents are measured in blocks of about ``block`` text
    bytes. Links with pivots connect most near copies at once. Of the
    components that they make the largest is left alone, and each other
    document is compared with all documents that could link with it: if x lives
    with pivot a and y, at most r from x, with b, then d(x, b) <= r + d(y, b)
    <= r + d(y, a) <= 2 r + d(x, a). So every document stays with its nearest
    pivot, and x visits the regions within twice the bound.
    """
    here = members.withColumn("n", F.ceil(F.col("w") / block).cast("long")).withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.col("n")))
    here = cut(here.select("cluster", "doc_id", "text", "k", "c", "n", "block"), "large")
    # About twice PIVOTS of each cluster are drawn by a hash.
    drawn = here.select("cluster", "doc_id", "text", F.xxhash64("doc_id", F.lit(0)).alias("r"), "k", "c", "n")
    first = drawn.groupBy("cluster").agg(F.min_by(F.struct("doc_id", "text", "n"), F.struct(-F.col("k"), "r", "doc_id")).alias("x")).select("cluster", "x.*")
    pivots = first.unionByName(drawn.where(F.pmod("r", F.col("c")) < 2 * PIVOTS).select(*first.columns)).dropDuplicates(["cluster", "doc_id"])
    pivots = pivots.select(F.col("cluster").alias("at"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("in"), F.col("doc_id").alias("pivot"), F.col("text").alias("words"))

    def measure(left: pa.Table, right: pa.Table) -> pa.Table:
        index = Overlaps(_all_sets(left["text"], size))
        right = right.sort_by("pivot")
        sets, names = _all_sets(right["words"], size), right["pivot"].to_numpy()
        distance = np.array([index.distance(p) for p in sets]).reshape(len(sets), left.num_rows)
        home = distance.argmin(0)
        inside = distance - distance.min(0) <= 2 * (1 - num / den) + 1e-9
        near = np.zeros(distance.shape, bool)
        for j, p in enumerate(sets):
            near[j, index.linked(p, num, den)] = True
        lists = [pa.array([names[x].tolist() for x in y.T], pa.list_(pa.int64())) for y in (inside, near)]
        return pa.table([left["cluster"], left["doc_id"], left["text"], pa.array(names[home]), *lists], names=["cluster", "doc_id", "text", "home", "visits", "linked"])

    def cross(left: pa.Table, right: pa.Table) -> pa.Table:
        """Links of the documents of one block with those that visit it."""
        a, b = _all_sets(left["text"], size), _all_sets(right["words"], size)
        index, u = Overlaps(a), Union(len(a) + len(b))
        for i, s in enumerate(b):
            u.join(len(a) + i, index.linked(s, num, den))
        doc = np.concatenate((left["doc_id"].to_numpy(), right["visitor"].to_numpy()))
        x, y = u.edges()
        return pa.table([pa.array(doc[x]), pa.array(doc[y])], names=["a", "b"])

    schema = "cluster long, doc_id long, text string, home long, visits array<long>, linked array<long>"
    every = cut(here.select("cluster", "block", "doc_id", "text").groupBy("cluster", "block").cogroup(pivots.groupBy("at", "in")).applyInArrow(measure, schema), "regions")
    release(here)
    links = cut(every.select(F.col("doc_id").alias("a"), F.explode("linked").alias("b")).where("a <> b"), "links")
    part = components(links)
    whose = cut(every.select("cluster", "doc_id").distinct().join(part, F.col("doc_id") == F.col("node"), "left").select("cluster", "doc_id", F.coalesce("component", "doc_id").alias("part")), "parts")
    main = whose.groupBy("cluster", "part").count().groupBy("cluster").agg(F.max_by("part", F.struct("count", "part")).alias("main"))
    open_ = cut(whose.join(main, "cluster").where("part <> main").select("cluster", "doc_id"), "open")
    visitors = every.join(open_, ["cluster", "doc_id"]).select("cluster", F.explode("visits").alias("home"), F.col("doc_id").alias("visitor"), F.col("text").alias("words"))
    weight = lambda df, text, k: df.groupBy("cluster", "home").agg(F.ceil(F.sum(F.octet_length(text)) / block).cast("long").alias(k))
    blocks = cut(weight(every, "text", "n").join(weight(visitors, "words", "m"), ["cluster", "home"]), "weights")
    numbers = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.col(k) - 1))
    left = every.join(blocks, ["cluster", "home"]).select("cluster", "home", F.pmod(F.xxhash64("doc_id", "text"), F.col("n")).alias("i"), numbers("m").alias("j"), "doc_id", "text")
    right = visitors.join(blocks, ["cluster", "home"]).select(F.col("cluster").alias("at"), F.col("home").alias("by"), numbers("n").alias("in"), F.pmod(F.xxhash64("visitor", "words"), F.col("m")).alias("against"), "visitor", "words")
    found = cut(left.groupBy("cluster", "home", "i", "j").cogroup(right.groupBy("at", "by", "in", "against")).applyInArrow(cross, "a long, b long"), "links")
    release(every, whose, open_, blocks)
    return links.unionByName(found)


def similar_groups(docs: DataFrame, size: int = 5, num: int = 8, den: int = 10, doc_id: str = "doc_id", text: str = "text", few: int = 1_000_000, cluster_bytes: int = 4 << 20, region: int = REGION) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row.

    A document's set holds its distinct ``size``-word shingles, words being
    runs of anything but ASCII white space with A-Z lowered; a text with fewer
    words is one shingle. Two documents link when ``den * |A n B| >=
    num * |A u B|``; ``component_id`` is the smallest doc_id reachable by
    links. The join is exact up to 64-bit hashes of shingles.

    Equal sets within a task travel once; of those of all tasks one is compared. A region of more than ``region``
    documents, counted exactly, is joined by pairs of blocks, and a cluster of
    more than ``cluster_bytes`` by finer parts and pivots over the cluster's texts.

    Null, empty and blank texts have no shingles and link with nothing. A null
    doc_id links with nothing and has a null component. Rows that share a
    doc_id are one node. Other columns are not read; an empty table gives an
    empty result.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    frequency = _frequency(rows.select("text"), size)
    buckets = max(48, total >> 22)
    scanned = cut(_scan(rows, size, num, den, buckets, frequency), "scan")
    found = cut(_join_regions(_split_hot(scanned.where("what = 'sets'"), frequency, buckets, region), num, den), "regions")

    near = found.where("what = 'near' and a <> b").select("a", "b")
    near = near.unionByName(_test_pairs(rows, found.where("what = 'pair' and a <> b").select("a", "b"), size, num, den, few)).distinct()
    sent = cut(components(near).select(F.col("node").alias("doc_id"), F.col("component").alias("cluster")), "clusters")
    lengths = rows.select("doc_id", F.octet_length("text").alias("w"))
    weight = _picked(lengths, sent, few).groupBy("cluster").agg(F.sum("w").alias("w"))
    large = cut(weight.where(F.col("w") > cluster_bytes).select("cluster"), "oversize")
    members = _picked(rows, sent, few).select("cluster", "doc_id", "text")
    if large.isEmpty():
        links = _join_clusters(members, size, num, den)
    else:
        links = _join_clusters(members.join(large, "cluster", "left_anti"), size, num, den)
        links = links.unionByName(_join_large(rows, sent.join(large, "cluster").select("doc_id", "cluster"), size, num, den, cluster_bytes, few))
    group = components(links.unionByName(_equal(scanned)))
    out = scanned.where("what = 'doc'").select(F.col("a").alias("doc_id"), F.col("b").alias("n_shingles"))
    return out.join(group, F.col("node") == F.col("doc_id"), "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def one_per_group(docs: DataFrame, groups: DataFrame, doc_id: str = "doc_id", few: int = 1_000_000) -> DataFrame:
    """``docs`` without those that aren't their group's smallest doc_id, and with repeated rows once.

    The ids that go are broadcast up to ``few`` counted ones, else joined by a
    shuffle. Only rows whose id repeats are compared with each other. Rows
    with a null id stay.
    """
    gone_id, twice_id = apart("gone_id", docs.columns), apart("twice_id", docs.columns)
    gone = cut(groups.where(F.col("doc_id") > F.col("component_id")).select(F.col("doc_id").alias(gone_id)).distinct(), "duplicates")
    number = apart("n", docs.columns)
    twice = docs.groupBy(F.col(doc_id).cast("long").alias(twice_id)).agg(F.count(F.lit(1)).alias(number)).where((F.col(number) > 1) & F.col(twice_id).isNotNull())
    twice = cut(twice.select(twice_id), "repeated")
    kept = docs.join(bounded(gone, few), docs[doc_id].cast("long") == F.col(gone_id), "left_anti")
    if twice.isEmpty():
        return kept
    twice = bounded(twice, few)
    same = F.col(doc_id).cast("long") == F.col(twice_id)
    return kept.join(twice, same, "left_anti").unionByName(kept.join(twice, same, "left_semi").distinct())
