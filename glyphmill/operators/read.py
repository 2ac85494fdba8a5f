"""Reading files: single lines, ranges, compact views and reads that depend on a hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions.text import lines
from glyphmill.operators.search import comment_or_blank
from glyphmill.sources.files import LARGEST, has_skipped_suffix, is_sensitive, language, safe_path, sensitive_path

MOST_LINES = 1 << 30


def content_hash(content: Column) -> Column:
    """The hash by which readers tell whether a content changed, as 16 hex digits."""
    return F.lower(F.lpad(F.hex(F.xxhash64(content)), 16, "0"))


def file_hash(path: Column, content: Column, largest: int = LARGEST) -> Column:
    """A file's hash for listings: 0 if it is skipped or too large, -1 if it could not be read."""
    return F.when(has_skipped_suffix(path) | is_sensitive(path), 0).when(content.isNull(), -1).when(F.octet_length(content) > largest, 0).otherwise(F.xxhash64(content)).cast("long")


def line_at(content: Column, number: int) -> Column:
    """The line with a number from 1, or null beyond the end."""
    return F.get(F.split(content, "\n"), F.lit(number - 1)) if number >= 1 else F.lit(None).cast("string")


def read_lines(files: DataFrame, first: int = 1, last: int = MOST_LINES, compact: bool = False) -> DataFrame:
    """(path, line_num, line_text) of a range of lines; ``compact`` drops blank lines and comment lines of the file's language."""
    rows = lines(files).where(F.col("line_num").between(max(first, 1), last))
    return rows.where(~comment_or_blank(F.col("line_text"), language(F.col("path")))) if compact else rows


def read_texts(files: DataFrame, first: int = 1, last: int = MOST_LINES, compact: bool = False, numbered: bool = True, known: DataFrame | None = None) -> DataFrame:
    """(path, hash, state, text): the hash, and ``text`` unless ``known`` (path, hash) tells that it is unchanged.

    Sensitive files are refused: their state is ``refused`` and text is null.
    ``numbered`` puts the number before each line. Lines of one file are
    picked within its row.
    """
    path, every = F.col("path"), F.split("content", "\n")
    rows = files.select("path", "content", content_hash(F.col("content")).alias("hash"))
    rows = rows.join(known.select("path", F.col("hash").alias("_known")), "path", "left") if known is not None else rows.withColumn("_known", F.lit(None).cast("string"))
    part = F.transform(F.slice(every, max(first, 1), max(last - max(first, 1) + 1, 0)), lambda x, i: F.struct((i + max(first, 1)).alias("n"), x.alias("t")))
    if compact:
        part = F.filter(part, lambda x: ~comment_or_blank(x["t"], language(path)))
    shown = F.array_join(F.transform(part, lambda x: F.format_string("%5d | %s", x["n"], x["t"]) if numbered else x["t"]), "\n")
    state = F.when(is_sensitive(path), "refused").when(F.col("_known") == F.col("hash"), "unchanged").otherwise("read")
    return rows.withColumn("state", state).select("path", F.when(F.col("state") != "refused", F.col("hash")).alias("hash"), "state", F.when(F.col("state") == "read", shown).alias("text"))


def read_path(files: DataFrame, path: str, **options) -> DataFrame:
    """:func:`read_texts` of one file; an unsafe or sensitive path raises an error."""
    if not safe_path(path) or sensitive_path(path):
        raise ValueError(f"{path!r} may not be read")
    return read_texts(files.where(F.col("path") == path), **options)
