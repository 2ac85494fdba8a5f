"""Column helpers for text: lines, folding, words, sub-tokens, paths, globs, regexes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Where an identifier is cut: at underscores, lower to upper case, the end of an acronym, and around digits.
SUBTOKEN_CUT = "_|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|(?<=[0-9])(?=[^0-9_])|(?<=[^0-9_])(?=[0-9])"


def fold(c: Column) -> Column:
    """ASCII lower case; other characters stay."""
    return F.translate(c, UPPER, LOWER)


def fold_text(s: str) -> str:
    return s.translate(str.maketrans(UPPER, LOWER))


def lines(files: DataFrame) -> DataFrame:
    """(path, line_num from 1, line_text); a trailing line feed gives an empty last line."""
    return files.select("path", F.posexplode(F.split("content", "\n")).alias("_p", "line_text")).select("path", (F.col("_p") + 1).alias("line_num"), "line_text")


def occurrences(haystack: Column, needle: str) -> Column:
    """Non-overlapping occurrences, both sides folded already."""
    return ((F.octet_length(haystack) - F.octet_length(F.replace(haystack, F.lit(needle), F.lit("")))) / len(needle.encode())).cast("int")


def words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit("[A-Za-z0-9_]+"), F.lit(0))


def subtokens(token: Column) -> Column:
    """Folded parts of two or more characters of tokens that have four or more and an underscore or capital."""
    body = F.when(token.rlike("^_[^_]"), F.substring(token, 2, 1 << 30)).otherwise(token)
    parts = F.split(body, SUBTOKEN_CUT)
    lead = F.when(token.rlike("^_[^_]"), F.lit("_")).otherwise(F.lit(""))
    parts = F.transform(parts, lambda x, i: F.when(i == 0, F.concat(lead, x)).otherwise(x))
    cut = F.filter(F.transform(parts, fold), lambda x: F.length(x) >= 2)
    return F.when((F.length(token) >= 4) & token.rlike("[_A-Z]"), cut).otherwise(F.expr("cast(array() as array<string>)"))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def glob_to_regex(glob: str) -> str:
    """``?`` and ``*`` stay within a path part, ``**`` crosses parts and takes a slash after it along."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**", i):
            i += 3 if glob[i + 2 : i + 3] == "/" else 2
            out += ".*"
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(glob[i]) or re.escape(glob[i])
            i += 1
    return f"^{out}$"


def line_regex(pattern: str) -> str | None:
    """``pattern`` for ``rlike`` on one line; None if it cannot match (a lone trailing backslash)."""
    if re.search(r"(?<!\\)(?:\\\\)*\\$", pattern):
        return None
    return re.sub(r"((?:^|[^\\])(?:\\\\)*)\\s", r"\1[ \\t\\n\\r]", pattern)


def strip_ansi(c: Column) -> Column:
    return F.regexp_replace(c, "\\x1b\\[[0-9;]*[@-~]", "")


def semver_key(c: Column) -> Column:
    """Comparable array of three numbers; a leading v goes and missing parts are 0."""
    parts = F.split(F.regexp_replace(c, "^[vV]", ""), "\\.")
    part = lambda i: F.coalesce(F.regexp_extract(F.get(parts, F.lit(i)), "^[0-9]+", 0).try_cast("int"), F.lit(0))
    return F.array(part(0), part(1), part(2))
