"""Derived relations of an index: words, trigrams, byte pairs, sparse n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions.shared import spread
from glyphmill.functions.text import fold, lines, subtokens, words


def word_hits(files: DataFrame, parts: bool = True) -> DataFrame:
    """Distinct (word, path, line_num): folded words of two or more characters and, if ``parts``, identifier parts.

    Repeats lie within one line, so they go before the words become rows; nothing is shuffled.
    """

    def of(token: Column) -> Column:
        own = F.filter(F.array(fold(token)), lambda w: F.length(w) >= 2)
        return F.concat(own, subtokens(token)) if parts else own

    every = F.array_distinct(F.flatten(F.transform(words(F.col("line_text")), of)))
    return lines(spread(files.select("path", "content"))).select(F.explode(every).alias("word"), "path", "line_num")


def _chunks(batches: Iterator[pa.RecordBatch], size: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of (path, content) rows of about ``size`` bytes: the rows, all bytes, and where each content begins and ends."""
    for b in batches:
        b = b.filter(pc.is_valid(b.column(1)))
        lengths = pc.binary_length(b.column(1)).to_numpy(zero_copy_only=False).astype(np.int64) if b.num_rows else np.zeros(0, np.int64)
        upto, lo = np.concatenate(([0], np.cumsum(lengths))), 0
        while lo < b.num_rows:
            hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + size, "right")) - 1)
            part = b.slice(lo, hi - lo)
            yield part, np.frombuffer("".join(part.column(1).to_pylist()).encode(), np.uint8), upto[lo : hi + 1] - upto[lo]
            lo = hi


def _starts(offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(owner, byte) of every start of ``size`` bytes that lie in one content."""
    n = np.maximum(np.diff(offsets) - size + 1, 0)
    owner = np.repeat(np.arange(len(n)), n)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + offsets[owner]


#: ASCII lower case of every byte.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def trigrams(files: DataFrame) -> DataFrame:
    """(tri, path, next_mask, loc_mask): folded byte trigrams as numbers of 24 bits, without those of white space only.

    Bit i of ``loc_mask`` is set if the trigram starts at a position i modulo
    8, of ``next_mask`` if the byte after it is i modulo 8. The masks of a
    file are combined where its content lies; nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in _chunks(batches):
            b = FOLD[data].astype(np.int64)
            owner, at = _starts(offsets, 3)
            tri = (b[at] << 16) | (b[at + 1] << 8) | b[at + 2]
            blank = np.isin(b, (32, 9, 10, 13))
            keep = ~(blank[at] & blank[at + 1] & blank[at + 2])
            owner, at, tri = owner[keep], at[keep], tri[keep]
            after = np.append(b, 0)[at + 3]
            follow = np.where(at + 3 < offsets[owner + 1], 1 << (after & 7), 0)
            place = 1 << ((at - offsets[owner]) & 7)
            code = (owner << 40) | (tri << 16) | (follow << 8) | place
            code = np.unique(code)
            group = code >> 16
            first = np.flatnonzero(np.append(True, group[1:] != group[:-1])[: len(group)])
            masks = np.bitwise_or.reduceat(code & 0xFFFF, first) if len(first) else first
            for lo in range(0, len(first), 100_000):
                g, m = group[first[lo : lo + 100_000]], masks[lo : lo + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(g & 0xFFFFFF, pa.int32()), part.column(0).take(pa.array(g >> 24)), pa.array(m >> 8, pa.int32()), pa.array(m & 255, pa.int32())], ["tri", "path", "next_mask", "loc_mask"])

    return spread(files.select("path", "content")).mapInArrow(run, "tri int, path string, next_mask int, loc_mask int")


def trigram_text(tri: Column) -> Column:
    """A trigram as six hex digits."""
    return F.lower(F.lpad(F.hex(tri), 6, "0"))


def pair_frequency(files: DataFrame) -> DataFrame:
    """(a, b, weight) of adjacent bytes: rare pairs weigh up to 0xFE00, the most frequent 0x1000."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for _, data, offsets in _chunks(batches):
            _, at = _starts(offsets, 2)
            total += np.bincount((data[at].astype(np.int64) << 8) | data[at + 1], minlength=1 << 16)
        pairs = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(pairs, pa.int32()), pa.array(total[pairs])], ["p", "n"])

    counts = spread(files.select("path", "content")).mapInArrow(run, "p int, n long").groupBy("p").agg(F.sum("n").alias("count"))
    most = counts.agg(F.max("count").alias("m"))
    weight = F.expr(f"{0xFE00} - cast(floor(count * {0xFE00 - 0x1000} / m) as int)")
    return counts.crossJoin(F.broadcast(most)).select(F.shiftright("p", 8).alias("a"), F.col("p").bitwiseAND(F.lit(255)).alias("b"), weight.cast("int").alias("weight"))


#: Weight of a pair that was never counted.
RAREST = 0xFE00


def pair_weight(frequency: dict[tuple[int, int], int] | None = None, jitter: bool = False) -> np.ndarray:
    """The weight of each of the 65,536 byte pairs: its frequency weight, or that of a pair never seen.

    ``jitter`` adds up to 255 by a fixed scramble of the pair, so that pairs of equal frequency differ.
    """
    out = np.full(1 << 16, RAREST, np.int64)
    for (a, b), w in (frequency or {}).items():
        out[a << 8 | b] = w
    if jitter:
        code = np.arange(1 << 16, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        out += ((code >> np.uint64(40)) & np.uint64(255)).astype(np.int64)
    return out


def sparse_ngrams(files: DataFrame, weights: dict[tuple[int, int], int], longest: int = 16, jitter: bool = False) -> DataFrame:
    """(ngram, path, pos, len): spans of three or more bytes between local maxima of the pair weights.

    ``weights`` has at most 65,536 entries. Spans over ``longest`` bytes are
    split, each part overlapping the next by two bytes. Whole batches are
    worked on at once.
    """
    table = pair_weight(weights, jitter)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in _chunks(batches):
            size = np.diff(offsets)
            # Pairs that cross a border count as none: they are lower than any other, and edges are set by hand there.
            w = table[(data[:-1].astype(np.int64) << 8) | data[1:]] if len(data) > 1 else np.zeros(0, np.int64)
            peak = np.zeros(len(data), bool)
            if len(w) > 2:
                peak[1 : len(w) - 1] = (w[1:-1] > w[:-2]) & (w[1:-1] > w[2:])
            starts, ends = offsets[:-1], offsets[1:]
            place = np.arange(len(data)) - np.repeat(starts, size)
            left = np.repeat(size, size) - place
            edge = peak & (place >= 1) & (left >= 3) | (place == 0) | (left == 2)
            at = np.flatnonzero(edge)
            owner = np.searchsorted(ends, at, "right")
            same = owner[1:] == owner[:-1]
            x, y, who = at[:-1][same], at[1:][same] + 2, owner[:-1][same]
            # A long span becomes ceil((n - longest) / (longest - 2)) full parts and a rest.
            extra = np.maximum(0, -(-(y - x - longest) // (longest - 2)))
            step = np.arange(int((extra + 1).sum())) - np.repeat(np.cumsum(extra + 1) - extra - 1, extra + 1)
            begin = np.repeat(x, extra + 1) + step * (longest - 2)
            end = np.minimum(np.repeat(y, extra + 1), begin + longest)
            end = np.where(step == np.repeat(extra, extra + 1), np.repeat(y, extra + 1), end)
            who = np.repeat(who, extra + 1)
            keep = end - begin >= 3
            begin, end, who = begin[keep], end[keep], who[keep]
            raw = FOLD[data].tobytes()
            for lo in range(0, len(begin), 100_000):
                b, e, o = begin[lo : lo + 100_000], end[lo : lo + 100_000], who[lo : lo + 100_000]
                grams = [raw[i:j].hex() for i, j in zip(b.tolist(), e.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), part.column(0).take(pa.array(o)), pa.array(b - starts[o], pa.int32()), pa.array(e - b, pa.int32())], ["ngram", "path", "pos", "len"])

    return spread(files.select("path", "content")).mapInArrow(run, "ngram string, path string, pos int, len int")


def sparse_candidates(ngrams: DataFrame, query: str, longest: int = 16) -> DataFrame:
    """Paths that hold at least one n-gram of the query's covering set: a superset of the files with a hit that any index of spans can tell."""
    return ngrams.where(F.col("ngram").isin(covering_set(query, longest))).select("path").distinct()


def covering_set(query: str, longest: int = 16) -> list[str]:
    """Hex of every substring of 3 to ``longest`` bytes."""
    b = query.encode().lower()
    return sorted({b[i:j].hex() for i in range(len(b)) for j in range(i + 3, min(len(b), i + longest) + 1)})


def reindex(relation: DataFrame, fresh: DataFrame) -> DataFrame:
    """``relation`` with all rows of the paths of ``fresh`` replaced by those of ``fresh``."""
    return relation.join(fresh.select("path").distinct(), "path", "left_anti").select(*fresh.columns).unionByName(fresh)


def build(files: DataFrame, outline: bool = True, trigram: bool = True, sparse: bool = False) -> dict[str, DataFrame]:
    """All derived relations of ``files``; the flags leave some out. What isn't used is never computed."""
    from glyphmill.operators.outline import imports, symbols

    out = {"words": word_hits(files)}
    if outline:
        out |= {"symbols": symbols(files), "imports": imports(files)}
    if trigram:
        out["trigrams"] = trigrams(files)
    if sparse:
        frequency = pair_frequency(files)
        out |= {"pair_freq": frequency, "sparse_ngrams": sparse_ngrams(files, {(r.a, r.b): r.weight for r in frequency.collect()})}  # at most 65,536 pairs
    return out


def remove_paths(relations: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """The relations without the rows of the paths of ``gone``; relations without a path stay."""
    keys = gone.select("path").distinct()
    return {n: d.join(keys, "path", "left_anti") if "path" in d.columns else d for n, d in relations.items()}
