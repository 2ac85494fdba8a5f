"""Fuzzy path search by local alignment with affine gaps, vectorised over paths."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from glyphmill.functions.shared import settle

# Scores, and names of files where programs start.
MATCH, MISMATCH, OPEN, EXTEND, BOUNDARY, IN_NAME, RUN, CASE, START = (np.float32(x) for x in (16, -8, -3, -1, 8, 6, 4, 2, 6))
ENTRY_POINTS = [
    "main.zig", "lib.zig", "root.zig", "main.rs", "lib.rs", "mod.rs", "main.go", "main.c", "main.cpp", "index.ts", "index.tsx", "index.js", "index.jsx", "index.mjs",
    "index.cjs", "index.vue", "index.php", "main.rb", "index.rb", "__init__.py", "__main__.py", "Makefile", "build.zig", "Cargo.toml", "package.json",
]


def fuzzy_score(query: str, paths: list[str]) -> np.ndarray:
    """Scores of many paths (NaN: no match), all columns of the alignment at once over a padded byte matrix."""
    q, raw = query.encode(), [p.encode() for p in paths]
    out = np.full(len(raw), np.nan, np.float32)
    at = [i for i, p in enumerate(raw) if 0 < len(p) <= 512]
    if not q or len(q) > 128 or not at:
        return out
    size = np.array([len(raw[i]) for i in at])
    width = size.max()
    text = np.zeros((len(at), width), np.uint8)
    for k, i in enumerate(at):
        text[k, : size[k]] = np.frombuffer(raw[i], np.uint8)
    low = np.where((text >= 65) & (text <= 90), text + 32, text)
    real = np.arange(width) < size[:, None]
    name = np.array([raw[i].rfind(b"/") + 1 for i in at])[:, None]
    column = np.arange(width)
    edge = np.ones_like(real)
    edge[:, 1:] = np.isin(text[:, :-1], np.frombuffer(b"/_-.\\", np.uint8))
    bonus = BOUNDARY * edge + IN_NAME * (column >= name) + START * ((column == 0) | (column == name))
    above, gap = np.zeros((len(at), width + 1), np.float32), np.full((len(at), width + 1), OPEN, np.float32)
    matched = np.zeros(len(at), np.int64)
    for i, c in enumerate(q):
        same = low == (c + 32 if 65 <= c <= 90 else c)
        score = np.where(same, MATCH + bonus + CASE * (text == c), MISMATCH).astype(np.float32)
        if i:
            run = same & (above[:, :-1] > above[:, 1:] * np.float32(0.5))
            run[:, 0] = False
            score += RUN * run
        gap[:, 1:] = np.maximum(above[:, 1:] + OPEN, gap[:, 1:] + EXTEND)
        gap[:, 0] = OPEN
        best = np.maximum(np.float32(0), np.maximum(above[:, :-1] + score, gap[:, 1:]))
        row, side = np.zeros_like(above), np.full(len(at), OPEN, np.float32)
        for j in range(width):
            side = np.maximum(row[:, j] + OPEN, side + EXTEND)
            row[:, j + 1] = np.maximum(best[:, j], side)
        row[:, 1:] *= real
        matched[(row[:, 1:] > 0).any(1)] = i + 1
        above = row
    top = above.max(1)
    ok = (top > 0) & (matched >= (len(q) + 1) // 2) & (top >= np.float32(len(q)) * MATCH * np.float32(0.3))
    top = np.where([paths[i].rsplit("/", 1)[-1] in ENTRY_POINTS for i in at], top + top * np.float32(0.05), top).astype(np.float32)
    out[at] = np.where(ok, top / np.sqrt(size.astype(np.float32)), np.nan)
    return out


def find_files(files: DataFrame, query: str, k: int = 10, retry: bool = True, most: int = 50) -> DataFrame:
    """(path, score) of the ``k`` best (1 to ``most``): every part must match and scores add up; ``*.ext`` filters by suffix."""
    parts = query.split()
    suffixes = [p[1:] for p in parts if p.startswith("*.")]
    parts = [p for p in parts if not p.startswith("*.")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            paths = b.path.tolist()
            total = sum((fuzzy_score(p, paths) for p in parts), np.zeros(len(paths), np.float32))
            keep = ~np.isnan(total)
            yield pd.DataFrame({"path": np.array(paths, object)[keep], "score": total[keep]})

    rows = files.select("path")
    if suffixes:
        rows = rows.where(F.col("path").endswith(suffixes[-1]))
    found = rows.mapInPandas(run, "path string, score float").orderBy(F.desc("score"), "path").limit(max(1, min(k, most)))
    if retry and len(query) > 3 and any(c in query for c in "_-.") and not suffixes and found.isEmpty():
        return find_files(files, query[:256].translate(str.maketrans("", "", "_-.")), k, False, most)
    return found


def combo_boost(log: DataFrame, query: str, window_ms: int = 5000, bonus: float = 5.0) -> DataFrame:
    """(path, boost) from a log (pos, ts, ev, query, path[, session]): accesses soon after a query that is like this one.

    Without sessions the log is one order: rows are dealt by ranges of it, and
    the last query before each range is carried over by the driver, one row a
    range. No task sees more than its range.
    """
    last = lambda w: F.last(F.when(F.col("ev") == "query", F.struct("query", "ts")), ignorenulls=True).over(w)
    if "session" in log.columns:
        rows = log.withColumn("q", last(W.partitionBy("session").orderBy("pos")))
    else:
        rows = settle(log.repartitionByRange("pos")).withColumn("_part", F.spark_partition_id())
        ends = {r["_part"]: r.q for r in rows.groupBy("_part").agg(F.max_by(F.struct("query", "ts"), F.when(F.col("ev") == "query", F.col("pos"))).alias("q"), F.max(F.col("ev") == "query").alias("any")).where("any").collect()}
        carried, now = [], None
        for p in range(rows.select(F.max("_part")).first()[0] + 1 if ends else 0):
            carried.append((p, now.query if now else None, int(now.ts) if now else None))
            now = ends.get(p, now)
        before = log.sparkSession.createDataFrame(carried, "_part int, _query string, _ts long")
        rows = rows.withColumn("q", last(W.partitionBy("_part").orderBy("pos"))).join(F.broadcast(before), "_part", "left")
        rows = rows.withColumn("q", F.coalesce("q", F.when(F.col("_query").isNotNull(), F.struct(F.col("_query").alias("query"), F.col("_ts").cast(log.schema["ts"].dataType).alias("ts")))))
    rows = rows.where((F.col("ev") == "access") & (F.col("ts") - F.col("q.ts") <= window_ms))
    like = F.contains(F.col("q.query"), F.lit(query)) | F.contains(F.lit(query), F.col("q.query"))
    return rows.where(like).groupBy("path").agg((F.count(F.lit(1)) * bonus).alias("boost"))


def boosted(found: DataFrame, boost: DataFrame) -> DataFrame:
    return found.join(boost, "path", "left").select("path", (F.col("score") + F.coalesce("boost", F.lit(0.0))).alias("score")).orderBy(F.desc("score"), "path")
