"""Dependency edges (path, ord, dep): neighbours and bounded or full traversal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.functions.shared import settle
from glyphmill.functions.text import basename


def edges(imports: DataFrame) -> DataFrame:
    """Edges of imports that don't climb out of their folder."""
    return imports.where(~F.col("dep").contains("..")).select("path", "ord", "dep")


def forward(e: DataFrame, path: str) -> DataFrame:
    return e.where(F.col("path") == path).orderBy("ord").select("ord", "dep")


def imported_by(e: DataFrame, path: str) -> DataFrame:
    return e.where(F.col("dep").isin(path, path.rsplit("/", 1)[-1])).select("path").distinct()


def transitive(e: DataFrame, start: str, reverse: bool = True, max_depth: int | None = None) -> DataFrame:
    """(path, depth) reached from ``start``; dependents if ``reverse``, else dependencies.

    Against the direction of imports a node is also found under its base name.
    One frontier is expanded per round; what is reached is written to the
    shared folder, so the lineage stays short and survives lost executors.
    """
    spark = e.sparkSession
    pairs = (e.select(F.col("dep").alias("a"), F.col("path").alias("b")) if reverse else e.select(F.col("path").alias("a"), F.col("dep").alias("b"))).distinct()
    first = [start, start.rsplit("/", 1)[-1]] if reverse else [start]
    seen = spark.createDataFrame([(x, 0) for x in dict.fromkeys(first)], "path string, depth int")
    frontier, depth = seen.select("path"), 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = pairs.join(frontier, pairs.a == frontier.path, "left_semi").select(F.col("b").alias("path")).distinct()
        new = settle(step.join(seen, "path", "left_anti").withColumn("depth", F.lit(depth)))
        if new.isEmpty():
            break
        seen = seen.unionByName(new)
        frontier = new.select("path").unionByName(new.select(basename(F.col("path")).alias("path"))).distinct() if reverse else new.select("path")
    return seen.where("depth > 0")


def transitive_of(e: DataFrame, starts: DataFrame, reverse: bool = True, max_depth: int | None = None) -> DataFrame:
    """Paths reached from any of ``starts`` (path), which don't count themselves; the traversal of :func:`transitive` from many at once."""
    pairs = (e.select(F.col("dep").alias("a"), F.col("path").alias("b")) if reverse else e.select(F.col("path").alias("a"), F.col("dep").alias("b"))).distinct()
    both = lambda d: d.select("path").unionByName(d.select(basename(F.col("path")).alias("path"))).distinct() if reverse else d.select("path").distinct()
    own = settle(both(starts))
    seen, frontier, depth = own, own, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        new = settle(pairs.join(frontier, pairs.a == frontier.path, "left_semi").select(F.col("b").alias("path")).distinct().join(seen, "path", "left_anti"))
        if new.isEmpty():
            break
        seen, frontier = seen.unionByName(new), both(new)
    return seen.join(own, "path", "left_anti")


def set_deps(e: DataFrame, path: str, deps: list[str]) -> DataFrame:
    """The edges with those of ``path`` replaced, in the order given; repeats stay."""
    own = e.sparkSession.createDataFrame([(path, i, d) for i, d in enumerate(deps)], "path string, ord int, dep string")
    return remove(e, path).unionByName(own.select(*[F.col(c).cast(e.schema[c].dataType).alias(c) for c in ("path", "ord", "dep")]))


def remove(e: DataFrame, path: str) -> DataFrame:
    """The edges without those that start at ``path``; who imports it still does."""
    return e.where(F.col("path") != path).select("path", "ord", "dep")


def reverse_edges(e: DataFrame) -> DataFrame:
    """(dep, path): each importer once."""
    return e.select("dep", "path").distinct()


def sources(e: DataFrame) -> DataFrame:
    """(path, n): every file with imports, and how many."""
    return e.groupBy("path").agg(F.count(F.lit(1)).alias("n"))


def dependencies(e: DataFrame, path: str, direction: str = "imported_by", full: bool = False, max_depth: int | None = None) -> DataFrame:
    """(path) of one file's importers, or with ``depends_on`` of what it imports; ``full`` follows edges, up to ``max_depth`` (at least 1)."""
    if direction not in ("imported_by", "depends_on"):
        raise ValueError(f"unknown direction {direction}")
    if full:
        return transitive(e, path, direction == "imported_by", None if max_depth is None else max(1, max_depth)).select("path")
    return imported_by(e, path) if direction == "imported_by" else forward(e, path).select(F.col("dep").alias("path"))
