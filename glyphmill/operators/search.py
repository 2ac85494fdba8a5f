"""Search: ranked substrings, regexes, words, prefixes, scopes and candidates."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from glyphmill.operators.index import sparse_candidates
from glyphmill.functions.text import fold, fold_text, line_regex, lines, occurrences

ORDER = [F.desc, F.asc, F.asc]


def search(files: DataFrame, query: str, limit: int | None = 50, per_file: int | None = None) -> DataFrame:
    """(path, line_num, line_text, score): folded substring hits, by falling count, then path and line.

    The content is tested before it is split, so files without a hit are not
    exploded; a bounded result is a distributed top-k.
    """
    q = fold_text(query)
    found = lines(files.where(F.contains(fold(F.col("content")), F.lit(q)))).where(F.contains(fold(F.col("line_text")), F.lit(q)))
    found = found.withColumn("score", occurrences(fold(F.col("line_text")), q) if q else F.lit(0))
    if per_file:
        rank = F.row_number().over(W.partitionBy("path").orderBy(F.desc("score"), "line_num"))
        found = found.withColumn("_r", rank).where(F.col("_r") <= per_file).drop("_r")
    found = found.orderBy(F.desc("score"), "path", "line_num")
    return found.limit(limit) if limit else found


def search_regex(files: DataFrame, pattern: str, limit: int | None = 50) -> DataFrame:
    """(path, line_num, line_text) of lines that match, case-sensitively, by path and line."""
    p = line_regex(pattern)
    found = lines(files)
    found = found.where(F.lit(False)) if p is None else found.where(F.col("line_text").rlike(p))
    found = found.orderBy("path", "line_num")
    return found.limit(limit) if limit else found


def word_lookup(hits: DataFrame, word: str) -> DataFrame:
    return hits.where(F.col("word") == fold_text(word)).select("path", "line_num").distinct()


def prefix_lookup(hits: DataFrame, prefix: str, limit: int | None = None) -> DataFrame:
    """Hits of words that are strictly longer than the prefix."""
    p = fold_text(prefix)
    found = hits.where(F.col("word").startswith(p) & (F.length("word") > len(p))).select("path", "line_num").distinct()
    return found.orderBy("path", "line_num").limit(limit) if limit else found


def _sequence(query: str) -> list[int]:
    b = fold_text(query).encode()
    return [int.from_bytes(b[i : i + 3]) for i in range(len(b) - 2)]


def query_trigrams(query: str) -> list[int]:
    """The trigrams of a query, as numbers, without those of white space only."""
    return sorted({t for t in _sequence(query) if t.to_bytes(3).strip(b" \t\n\r")})


def trigram_candidates(trigrams: DataFrame, query: str) -> DataFrame:
    """Paths that hold all trigrams of ``query`` and whose masks allow each to follow the one before it."""
    b, seq = fold_text(query).encode(), _sequence(query)
    wanted = query_trigrams(query)
    rows = trigrams.where(F.col("tri").isin(wanted))
    agg = [F.count(F.lit(1)).alias("n")]
    tests: Column = F.col("n") == len(wanted)
    for i in range(len(seq) - 1):
        if seq[i] in wanted and seq[i + 1] in wanted:
            first, after = F.when(F.col("tri") == seq[i], 1), F.when(F.col("tri") == seq[i + 1], 1)
            agg += [F.max(first * F.col("next_mask")).alias(f"n{i}"), F.max(first * F.col("loc_mask")).alias(f"l{i}"), F.max(after * F.col("loc_mask")).alias(f"m{i}")]
            turned = F.expr(f"((l{i} * 2) & 255) | shiftright(l{i}, 7)")
            tests = tests & (F.col(f"n{i}").bitwiseAND(F.lit(1 << (b[i + 3] % 8))) != 0) & (turned.bitwiseAND(F.col(f"m{i}")) != 0)
    return rows.groupBy("path").agg(*agg).where(tests).select("path")


def regex_trigrams(pattern: str) -> tuple[list[int], list[list[int]]]:
    """(trigrams that all must occur, groups of which one each must) for a pattern; both may be empty.

    Only literal runs of three or more bytes count. With a top-level ``|``
    there is one group of all branches' trigrams, and none if some branch has
    no trigram, since such a branch matches without any.
    """
    depth, branches, current, escape, in_set = 0, [], "", False, False
    for c in pattern:
        if not escape and not in_set and c == "|" and depth == 0:
            branches.append(current)
            current = ""
            continue
        current += c
        if escape or c == "\\":
            escape = not escape
        elif in_set or c == "[":
            in_set = c != "]"
        else:
            depth += (c == "(") - (c == ")")
    branches.append(current)

    def literals(p: str) -> list[int]:
        if "(" in p:
            p = re.sub(r"\((?:[^()\\]|\\.)*\)[*+?{]?", "\0", p)
        p = re.sub(r"\[(?:\\.|[^\]\\])*\]", "\0", p)
        p = re.sub(r"\\[a-zA-Z]", "\0", p)
        p = re.sub(r"\\(.)", lambda m: "\1" if m[1] in ".*+?{}()[]|^$" else m[1], p)
        p = re.sub(r".(?:\*|\?|\{[^}]*\})", "\0", p, flags=re.S)
        return [t for run in re.split(r"[\x00\x01.+^$(){}]", p) for t in query_trigrams(run)]

    each = [sorted(set(literals(b))) for b in branches]
    if len(each) == 1:
        return each[0], []
    return [], [sorted({t for e in each for t in e})] if all(each) else []


def regex_candidates(trigrams: DataFrame, pattern: str) -> DataFrame | None:
    """Paths that may match, or None if the pattern implies no trigram."""
    every, groups = regex_trigrams(pattern)
    if not every and not groups:
        return None
    agg = [F.count(F.when(F.col("tri").isin(every), 1)).alias("n")] + [F.max(F.col("tri").isin(g).cast("int")).alias(f"g{i}") for i, g in enumerate(groups)]
    test = F.col("n") == len(every)
    for i in range(len(groups)):
        test = test & (F.col(f"g{i}") == 1)
    return trigrams.where(F.col("tri").isin(every + [t for g in groups for t in g])).groupBy("path").agg(*agg).where(test).select("path")


def indexed_search(files: DataFrame, trigrams: DataFrame, query: str, **options) -> DataFrame:
    """:func:`search` over the candidates of the trigram index only; the same rows."""
    if len(query.encode()) < 3 or not query_trigrams(query):
        return search(files, query, **options)
    return search(files.join(trigram_candidates(trigrams, query), "path", "left_semi"), query, **options)


def indexed_regex(files: DataFrame, trigrams: DataFrame, pattern: str, limit: int | None = 50) -> DataFrame:
    """:func:`search_regex` over the files that the trigram index doesn't rule out; the same rows."""
    found = regex_candidates(trigrams, pattern)
    return search_regex(files if found is None else files.join(found, "path", "left_semi"), pattern, limit)


def enclosing_symbols(hits: DataFrame, symbols: DataFrame) -> DataFrame:
    """Each hit with the tightest symbol around its line, or else the nearest one before it; of equals the later.

    A file's hits and symbols meet in its own row, symbols sorted by start, so
    no hit is multiplied by the symbols before it.
    """
    s = symbols.groupBy(F.col("path").alias("_path")).agg(F.array_sort(F.collect_list(F.struct("line_start", "ord", "line_end", "name", "kind"))).alias("_s"))
    j = hits.join(s, F.col("path") == F.col("_path"), "left").drop("_path")
    before = F.filter("_s", lambda x: x["line_start"] <= F.col("line_num"))
    around = F.filter(before, lambda x: x["line_end"] >= F.col("line_num"))
    tight = F.array_max(F.transform(around, lambda x: F.struct((x["line_start"] - x["line_end"]).alias("n"), x["line_start"].alias("l"), x["ord"].alias("o"), x.alias("x"))))["x"]
    best = F.coalesce(tight, F.try_element_at(before, F.lit(-1)))
    out = j.withColumn("_b", best)
    return out.select(*hits.columns, F.col("_b.name").alias("scope_name"), F.col("_b.kind").alias("scope_kind"), F.col("_b.line_start").alias("scope_start"), F.col("_b.line_end").alias("scope_end"))


def search_scoped(files: DataFrame, symbols: DataFrame, query: str, limit: int | None = 50, trigrams: DataFrame | None = None, ngrams: DataFrame | None = None) -> DataFrame:
    """Ranked hits with their enclosing symbols.

    Candidates come from the trigram index and, if ``ngrams`` is given, from
    the sparse one as well; where both name files, only those of both are
    searched, and where one names none, the other decides.
    """
    if len(query.encode()) >= 3 and query_trigrams(query) and (trigrams is not None or ngrams is not None):
        sides = [trigram_candidates(trigrams, query)] if trigrams is not None else []
        sides += [sparse_candidates(ngrams, query)] if ngrams is not None else []
        for side in sides:
            if not side.isEmpty():
                files = files.join(side, "path", "left_semi")
    found = enclosing_symbols(search(files, query, limit=None), symbols).orderBy(F.desc("score"), "path", "line_num")
    return found.limit(limit) if limit else found


# What a comment line starts with, by language.
COMMENTS = {
    **dict.fromkeys(("zig", "rust", "go_lang"), ["//"]), **dict.fromkeys(("python", "ruby", "r"), ["#"]), "hcl": ["#", "//", "/*", "*"],
    **dict.fromkeys(("javascript", "typescript", "c", "cpp", "dart"), ["//", "/*", "*"]),
}


def comment_or_blank(line: Column, language: Column) -> Column:
    t = F.regexp_replace(line, "^[ \\t]+|[ \\t]+$", "")
    out = t == ""
    for name, marks in COMMENTS.items():
        for m in marks:
            out = out | ((language == name) & t.startswith(m))
    return out
