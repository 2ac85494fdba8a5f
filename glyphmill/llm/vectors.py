"""Near-duplicate vectors: spherical k-means cells, blocked cosines within cells."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import cut
from glyphmill.llm.components import components


def unit(vectors: list) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: (indices, unit rows in double precision) of the vectors that are finite and not zero."""
    rows: dict[int, list] = {}
    for i, v in enumerate(vectors):
        if v is not None and len(v) and not any(x is None for x in v):
            x = np.asarray(v, np.float64)
            top = np.abs(x).max()
            if np.isfinite(top) and top > 0:
                x = x / top  # so that squares neither vanish nor overflow
                rows.setdefault(len(x), []).append((i, x / np.sqrt(x @ x)))
    return {n: (np.array([i for i, _ in r]), np.array([x for _, x in r])) for n, r in rows.items()}


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids of unit rows, started farthest-first from the first row; deterministic."""
    seeds, best = [0], x @ x[0]
    while len(seeds) < min(k, len(x)):
        seeds.append(int(np.argmin(best)))
        best = np.maximum(best, x @ x[seeds[-1]])
    c = x[seeds]
    for _ in range(rounds):
        cell = (x @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, cell, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 1e-12, total / np.maximum(norm, 1e-12), c)
    return c


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.95, vec_id: str = "vec_id", embedding: str = "embedding", cell_rows: int = 16_384,
    least_cells: int = 4, most_cells: int = 2048, sample_rows: int = 20_000, block_bytes: int = 8 << 20, slack: float | None = 4.0,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    Vectors of one length are clustered on their own: one centroid per
    ``cell_rows`` of them, ``least_cells`` at least and ``most_cells`` at most,
    fitted on about ``sample_rows`` rows drawn by a hash; a length with fewer
    than 64 rows in that sample is one cell. A vector's home is the cell of its
    nearest centroid. It also visits cells whose vectors it could link with. If
    x lives in cell a and y in b, their margins ``x.(a - b)`` and ``y.(b - a)``
    add up to ``(x - y).(a - b)``, which is at most ``r |a - b|`` for linked
    vectors, ``r = sqrt(2 - 2 threshold)`` apart at most. So the smaller margin
    is at most half of that, and it is enough that its vector visits the other
    cell. With ``slack=None`` every such cell is visited and no link is lost.
    By default the bound is that of ``slack`` standard deviations of a
    difference of length r in a random direction, ``slack r / sqrt(dimensions)``
    in place of r, which loses a link only if both margins lie beyond half of
    that (the tests measure the recall). Every link that is found counts once
    at both ends.

    A cell is compared in blocks of about ``block_bytes`` of its rows with
    blocks of twice that of its visitors, so a cell with a large part of all
    rows becomes many block pairs. A task returns one count per vector and the
    edges of a spanning forest, never the pairs.

    Vectors that are null, empty, zero, or hold null or non-finite components
    link with nothing; those of different lengths don't link. Repeated rows are
    vectors of their own, with one node if they share an id. A null id has a
    null component and isn't kept; ids must be castable to a long. Empty tables
    give no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("embedding"), F.monotonically_increasing_id().alias("row"))
    rows = cut(rows, "vectors")
    known = rows.where(F.size("embedding") > 0)
    n = known.count()
    sample = known if n <= sample_rows else known.where(F.pmod(F.xxhash64("row"), F.lit(1_000_000)) < 1_000_000 * sample_rows / n)
    fit = unit([r.embedding for r in sample.orderBy(F.xxhash64("row")).select("embedding").limit(2 * sample_rows).collect()])
    drawn = max(1, sum(len(x) for _, x in fit.values()))
    cells, base = {}, 0  # by length: (number of the first cell, centroids)
    for width, (_, x) in sorted(fit.items()):
        if len(x) >= 64:
            k = min(most_cells, max(least_cells, n * len(x) // drawn // cell_rows), len(x) // 8)
            cells[width] = (base, spherical_kmeans(x, k))
            base += len(cells[width][1])
    shared = spark.sparkContext.broadcast((cells, base))  # most_cells rows a length, whatever the input

    def visits(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's home, and which cells it visits."""
        reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) * (1 if slack is None else min(1.0, slack / np.sqrt(x.shape[1]))) / 2 + 1e-9
        dot = x @ centroids.T
        home = dot.argmax(1)
        apart = np.sqrt(np.maximum(0, 2 - 2 * centroids @ centroids.T)) + 1e-7
        near = dot[np.arange(len(x)), home][:, None] - dot <= reach * apart[home] + 1e-12
        near[np.arange(len(x)), home] = False
        return home, near

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for a vector's home and for each cell that it visits; ``cells`` lists them all, home first."""
        cells, base = shared.value
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                for width, (at, x) in unit(part.column(1).to_pylist()).items():
                    first, centroids = cells.get(width, (base + width, None))
                    home, near = visits(x, centroids) if centroids is not None else (np.zeros(len(x), np.int64), np.zeros((len(x), 1), bool))
                    lists = [(np.append(h, np.flatnonzero(v)) + first).astype("<i4").tobytes() for h, v in zip(home, near, strict=True)]
                    blobs = [y.tobytes() for y in x]
                    near[np.arange(len(x)), home] = True
                    who, cell = np.nonzero(near)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cell + first, pa.int32()), pa.array(home[who] == cell), part.column(2).take(pa.array(at[who])), part.column(0).take(pa.array(at[who])), pa.array([blobs[i] for i in who], pa.binary()), pa.array([lists[i] for i in who], pa.binary())],
                        ["cell", "home", "row", "vec_id", "x", "cells"],
                    )

    placed = cut(rows.select("vec_id", "embedding", "row").mapInArrow(place, "cell int, home boolean, row long, vec_id long, x binary, cells binary"), "cells")
    # Blocks of every cell: homes and all members; at most most_cells rows a length.
    size = placed.groupBy("cell").agg(F.sum(F.octet_length("x").cast("long")).alias("m"), F.sum(F.when(F.col("home"), F.octet_length("x")).otherwise(0).cast("long")).alias("h"))
    size = size.select("cell", F.ceil(F.col("h") / block_bytes).cast("int").alias("homes"), F.ceil(F.col("m") / (2 * block_bytes)).cast("int").alias("members"))
    placed = placed.join(F.broadcast(size), "cell")
    mine = lambda n: F.pmod(F.xxhash64("row"), F.greatest(n, F.lit(1))).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1))
    # A row of home block i is sent to every member block j of its cell, and one of member block j to every i.
    sent = placed.where("home").select("cell", mine(F.col("homes")).alias("i"), every(F.col("members")).alias("j"), "home", "row", "vec_id", "x", "cells").unionByName(
        placed.select("cell", every(F.col("homes")).alias("i"), mine(F.col("members")).alias("j"), F.lit(False).alias("home"), "row", "vec_id", "x", "cells")
    )

    def compare(t: pa.Table) -> pa.Table:
        home = t["home"].to_numpy()
        row, x = t["row"].to_numpy(), np.frombuffer(b"".join(t["x"].to_pylist()), np.float64).reshape(len(home), -1)
        ids = t["vec_id"].to_pylist()
        lists = [np.frombuffer(c, "<i4") for c in t["cells"].to_pylist()]
        cell, lives = t["cell"][0].as_py(), np.array([c[0] for c in lists])
        a, b = np.flatnonzero(home), np.flatnonzero(~home)
        other = x[b]
        counts, ends = np.zeros(len(home), np.int64), []
        label = np.arange(len(home))  # spanning forest of the rows at hand
        for lo in range(0, len(a), 128):
            part = a[lo : lo + 128]
            near = (x[part] @ other.T >= threshold) & (row[part][:, None] != row[b][None])
            counts[part] = near.sum(1)
            for k in np.flatnonzero(counts[part]):
                others = b[near[k]]
                # A visitor whose own cell this row doesn't visit meets it here alone.
                strange = others[lives[others] != cell]
                if len(strange):
                    counts[strange[~np.isin(lives[strange], lists[part[k]])]] += 1
                new = others[label[others] != label[part[k]]]
                if len(new):
                    _, first = np.unique(label[new], return_index=True)
                    ends += [(part[k], o) for o in new[first]]
                    label[np.isin(label, np.append(label[new], label[part[k]]))] = label[part[k]]
        e = [(ids[p], ids[q]) for p, q in ends]
        m, some = len(e), np.flatnonzero(counts)
        return pa.table([pa.array([*row[some].tolist(), *[None] * m], pa.int64()), pa.array([*counts[some].tolist(), *[None] * m], pa.int64()), pa.array([*[None] * len(some), *[p for p, _ in e]], pa.int64()), pa.array([*[None] * len(some), *[q for _, q in e]], pa.int64())], names=["row", "n", "a", "b"])

    found = cut(sent.groupBy("cell", "i", "j").applyInArrow(compare, "row long, n long, a long, b long"), "cosines")
    links = found.where(F.col("n") > 0).groupBy("row").agg(F.sum("n").alias("n"))
    group = components(found.select("a", "b"))
    out = rows.select("row", "vec_id").join(links, "row", "left").join(group, F.col("node") == F.col("vec_id"), "left")
    out = out.select("vec_id", F.coalesce("n", F.lit(0)).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")) & F.col("vec_id").isNotNull())
