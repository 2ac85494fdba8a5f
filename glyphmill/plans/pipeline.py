"""Composable queries: a fold of steps over an ordered set of paths."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.functions.shared import numbered
from glyphmill.functions.text import glob_to_regex, lines
from glyphmill.operators import fuzzy, graph, outline, search, symbols

MOST_STEPS = 10


@dataclass
class Corpus:
    files: DataFrame
    imports: DataFrame | None = None
    symbols: DataFrame | None = None


def _ranked(df: DataFrame, *order) -> DataFrame:
    """Numbers the rows by ranges of the order: no task holds them all."""
    return numbered(df, list(order)).select("path", "pos")


def run(corpus: Corpus, steps: list[dict]) -> DataFrame:
    """(path, pos), or what the last printing step (search, outline, read) shows.

    ``find`` and ``search`` start a set or narrow it and keep its order;
    ``deps`` appends; ``filter``, ``sort`` and ``limit`` do what they say, in
    the order given. Only bounded sets are numbered.
    """
    if not 1 <= len(steps) <= MOST_STEPS:
        raise ValueError(f"1 to {MOST_STEPS} steps")
    now, shown = None, None
    everything = lambda: corpus.files.select("path", F.lit(0).alias("pos"))
    for s in steps:
        op = s["op"]
        if op == "find":
            got = _ranked(fuzzy.find_files(corpus.files, s["query"], min(s.get("limit", 50), 200), most=200), F.desc("score"), "path")
            now = got if now is None else now.join(got.select("path"), "path", "left_semi")
        elif op == "search":
            shown = search.search(corpus.files, s["query"], min(s.get("limit", 50), 200))
            got = _ranked(shown.groupBy("path").agg(F.max(F.struct("score", -F.col("line_num"))).alias("b")), F.desc("b.score"), "path")
            now = got if now is None else now.join(got.select("path"), "path", "left_semi")
        elif op == "deps":
            base = now if now is not None else everything()
            e, reverse = graph.edges(corpus.imports if corpus.imports is not None else outline.imports(corpus.files)), s.get("direction", "imported_by") == "imported_by"
            step = graph.transitive_of(e, base, reverse, (max(1, s["max_depth"]) if "max_depth" in s else None) if s.get("transitive") else 1)
            last = base.agg(F.coalesce(F.max("pos"), F.lit(0)).alias("m"))
            more = _ranked(step.distinct().join(base, "path", "left_anti"), "path").crossJoin(F.broadcast(last)).select("path", (F.col("pos") + F.col("m")).alias("pos"))
            now = base.unionByName(more)
        elif op == "filter":
            now = now if now is not None else everything()
            now = now.where(F.col("path").endswith(s["ext"])) if "ext" in s else now
            now = now.where(F.col("path").rlike(glob_to_regex(s["glob"]))) if "glob" in s else now
        elif op == "sort":
            now = _ranked(now if now is not None else everything(), "path")
        elif op == "limit":
            now = (now if now is not None else everything()).orderBy("pos", "path").limit(max(1, min(s.get("n", 10), 100)))
        elif op == "outline":
            shown = (corpus.symbols if corpus.symbols is not None else symbols.symbols(corpus.files)).join(now, "path", "left_semi")
        elif op == "read":
            shown = lines(corpus.files.join(now, "path", "left_semi")).where(F.col("line_num") <= max(1, min(s.get("lines", 50), 200)))
        else:
            raise ValueError(f"unknown step {op}")
    return shown if steps[-1]["op"] in ("search", "outline", "read") else now


def bundle(plans: dict[str, DataFrame]) -> DataFrame:
    """Up to 20 named results as (name, row as JSON)."""
    if not 1 <= len(plans) <= 20:
        raise ValueError("1 to 20 plans")
    out = None
    for name, df in plans.items():
        part = df.select(F.lit(name).alias("name"), F.to_json(F.struct(*df.columns)).alias("row"))
        out = part if out is None else out.unionByName(part)
    return out
