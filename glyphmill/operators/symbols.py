"""Queries over outlines: files, symbols, bodies and the tree of paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.functions.text import basename
from glyphmill.operators.outline import symbols
from glyphmill.sources.files import language

__all__ = ["find_symbol", "outlines", "symbol_bodies", "symbols", "tree", "tree_leaves"]


def outlines(files: DataFrame, s: DataFrame) -> DataFrame:
    """(path, language, line_count, byte_size, n_symbols) of every file."""
    n = s.groupBy("path").agg(F.count(F.lit(1)).alias("n_symbols"))
    return files.select("path", language(F.col("path")).alias("language"), F.size(F.split("content", "\n")).alias("line_count"), F.octet_length("content").cast("long").alias("byte_size")).join(n, "path", "left").withColumn("n_symbols", F.coalesce("n_symbols", F.lit(0)))


def outline_of(files: DataFrame, s: DataFrame, path: str, compact: bool = False) -> DataFrame:
    """One file's symbols in order, with its language and line count; ``compact`` leaves details out."""
    one = outlines(files.where(F.col("path") == path), s.where(F.col("path") == path)).select("path", "language", "line_count")
    rows = s.where(F.col("path") == path).select("path", "ord", "name", "kind", "line_start", "line_end", F.lit(None).cast("string").alias("detail") if compact else F.col("detail"))
    return one.join(rows, "path").orderBy("ord")


def find_symbol(s: DataFrame, name: str, every: bool = True) -> DataFrame:
    found = s.where(F.col("name") == name)
    return found.orderBy("path", "ord") if every else found.orderBy(F.col("kind") == "import", "path", "ord").limit(1)


def symbol_bodies(files: DataFrame, s: DataFrame) -> DataFrame:
    part = F.slice(F.split("content", "\n"), F.col("line_start"), F.col("line_end") - F.col("line_start") + 1)
    return s.join(files, "path").select("path", "name", F.array_join(F.transform(part, lambda x, i: F.format_string("%5d | %s", i + F.col("line_start"), x)), "\n").alias("body"))


def tree(paths: DataFrame) -> DataFrame:
    """(path, depth, is_dir): files and every folder above them, once each."""
    parts = F.split("path", "/")
    dirs = paths.where(F.contains("path", F.lit("/"))).select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("path")).where("path <> ''")
    own = paths.select("path").distinct().withColumn("is_dir", F.lit(False))
    return dirs.distinct().withColumn("is_dir", F.lit(True)).unionByName(own).select("path", (F.size(F.split("path", "/")) - 1).alias("depth"), "is_dir")


def tree_leaves(files: DataFrame, s: DataFrame) -> DataFrame:
    """:func:`tree` with, for files, the language, lines and number of symbols, and a line of text with two spaces a level."""
    facts = outlines(files, s).select(F.col("path").alias("_p"), "language", "line_count", "n_symbols")
    rows = tree(files.select("path")).join(facts, (F.col("path") == F.col("_p")) & ~F.col("is_dir"), "left").drop("_p")
    leaf = F.concat_ws("  ", basename(F.col("path")), "language", F.concat(F.col("line_count").cast("string"), F.lit("L")), F.concat(F.col("n_symbols").cast("string"), F.lit(" sym")))
    text = F.concat(F.expr("repeat('  ', depth)"), F.when(F.col("is_dir"), F.concat(basename(F.col("path")), F.lit("/"))).otherwise(leaf))
    return rows.withColumn("text", text)
