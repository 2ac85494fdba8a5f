"""One entry for every tool: a request by name and arguments becomes a plan over an index."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.operators import fuzzy, graph, index, outline, read, search, status, symbols, telemetry, versions
from glyphmill.plans import pipeline


@dataclass
class Engine:
    """The relations that requests run over; those that are None are derived from ``files`` when they are asked for."""

    files: DataFrame
    symbols: DataFrame | None = None
    imports: DataFrame | None = None
    words: DataFrame | None = None
    trigrams: DataFrame | None = None
    versions: DataFrame | None = None

    @classmethod
    def of(cls, relations: dict[str, DataFrame]) -> Engine:
        return cls(relations["files"], *(relations.get(n) for n in ("symbols", "imports", "words", "trigrams", "versions")))

    def get(self, name: str) -> DataFrame:
        if getattr(self, name) is None:
            made = {"symbols": outline.symbols, "imports": outline.imports, "words": index.word_hits, "trigrams": index.trigrams}
            empty = "path string, seq long, agent long, ts long, op string, hash long, size long"
            setattr(self, name, made[name](self.files) if name in made else self.files.sparkSession.createDataFrame([], empty))
        return getattr(self, name)

    def corpus(self) -> pipeline.Corpus:
        return pipeline.Corpus(self.files, self.imports, self.symbols)


def _clamp(value, low: int, high: int) -> int:
    return max(low, min(int(value), high))


def _find(e: Engine, a: dict) -> DataFrame:
    found = fuzzy.find_files(e.files, a["query"], _clamp(a.get("max_results", 10), 1, 50))
    return fuzzy.boosted(found, fuzzy.combo_boost(a["log"], a["query"])) if a.get("log") is not None else found


def _search(e: Engine, a: dict) -> DataFrame:
    limit, pattern = _clamp(a.get("max_results", 50), 1, 10_000), a["query"]
    if a.get("regex"):
        return search.indexed_regex(e.files, e.get("trigrams"), pattern, limit) if a.get("indexed") else search.search_regex(e.files, pattern, limit)
    if a.get("scope"):
        return search.search_scoped(e.files, e.get("symbols"), pattern, limit, e.get("trigrams") if a.get("indexed") else None)
    return search.indexed_search(e.files, e.get("trigrams"), pattern, limit=limit, per_file=a.get("per_file")) if a.get("indexed") else search.search(e.files, pattern, limit, a.get("per_file"))


def _edit(e: Engine, a: dict) -> DataFrame:
    changed: Column = versions.apply_edit(F.col("content"), a["op"], int(a.get("start", 0)), int(a.get("end", a.get("start", 0))), a.get("content", ""))
    return e.files.where(F.col("path") == a["path"]).select("path", changed.alias("content"))


def _changes(e: Engine, a: dict) -> DataFrame:
    return versions.changes_since(versions.history(e.get("versions")), int(a.get("since", 0))).orderBy("seq")


TOOLS: dict[str, Callable[[Engine, dict], DataFrame]] = {
    "tree": lambda e, a: symbols.tree_leaves(e.files, e.get("symbols")).orderBy("path"),
    "outline": lambda e, a: symbols.outline_of(e.files, e.get("symbols"), a["path"], bool(a.get("compact"))),
    "symbol": lambda e, a: symbols.symbol_bodies(e.files, symbols.find_symbol(e.get("symbols"), a["name"])) if a.get("body") else symbols.find_symbol(e.get("symbols"), a["name"]),
    "search": _search,
    "word": lambda e, a: search.word_lookup(e.get("words"), a["word"]).orderBy("path", "line_num"),
    "prefix": lambda e, a: search.prefix_lookup(e.get("words"), a["prefix"], a.get("max_results", 100)),
    "find": _find,
    "hot": lambda e, a: versions.hot(e.files, e.get("versions"), _clamp(a.get("limit", 10), 1, 1000)),
    "deps": lambda e, a: graph.dependencies(graph.edges(e.get("imports")), a["path"], a.get("direction", "imported_by"), bool(a.get("transitive")), a.get("max_depth")),
    "read": lambda e, a: read.read_path(e.files, a["path"], first=a.get("line_start", 1), last=a.get("line_end", read.MOST_LINES), compact=bool(a.get("compact")), known=e.files.sparkSession.createDataFrame([(a["path"], a["if_hash"])], "path string, hash string") if a.get("if_hash") else None),
    "edit": _edit,
    "changes": _changes,
    "status": lambda e, a: status.status(e.files, e.get("versions"), e.get("symbols"), e.get("words"), e.get("trigrams")),
    "stats": lambda e, a: telemetry.corpus_stats(e.files),
    "query": lambda e, a: pipeline.run(e.corpus(), a["steps"]),
    "bundle": lambda e, a: bundle(e, a["calls"]),
}


def call(engine: Engine, tool: str, args: dict | None = None) -> DataFrame:
    """The plan of one request; an unknown tool or a missing argument raises an error."""
    if tool not in TOOLS:
        raise ValueError(f"unknown tool {tool}; known are {', '.join(sorted(TOOLS))}")
    try:
        return TOOLS[tool](engine, args or {})
    except KeyError as e:
        raise ValueError(f"{tool} needs the argument {e}") from e


def bundle(engine: Engine, calls: list[dict]) -> DataFrame:
    """Up to 20 requests as (name, row); bundles within bundles and edits are refused."""
    if any(c["tool"] in ("bundle", "edit") for c in calls):
        raise ValueError("a bundle holds no bundle and no edit")
    return pipeline.bundle({f"{i}:{c['tool']}": call(engine, c["tool"], c.get("args")) for i, c in enumerate(calls)})
