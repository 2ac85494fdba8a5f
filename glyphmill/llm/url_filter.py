"""URL filtering by host and path rules, by hashed expressions.

Every URL is expanded into expressions ``host suffix + path prefix``. A rule
is one such expression. URLs and rules meet in an equi-join on the first hex
digits of the expressions' SHA-256; the full digest then confirms a hit and
the longest rule wins.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import apart, literal_table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL_PARTS = "://([^/?#]*)([^?#]*)"


def url_host(url: Column) -> Column:
    """Between the first ``://`` and the next of ``/?#``, ASCII lower case; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, URL_PARTS, 1), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """From the host's end up to ``?`` or ``#``; empty if there is no ``://``."""
    return F.coalesce(F.regexp_extract(url, URL_PARTS, 2), F.lit(""))


def rule_table(spark, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    """(host, path, verdict) triples as the rule relation of :func:`filter_urls`."""
    return literal_table(spark, [dict(zip(("host", "path", "verdict"), r, strict=True)) for r in rules], "host string, path string, verdict string")


def filter_urls(
    pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow",
    prefix_hex: int = 8, broadcast_rows: int = 20_000,
) -> DataFrame:
    """Judge each row's URL; adds ``host``, ``path``, ``rule`` and ``verdict``.

    A rule (host, path, verdict) fits its host and all subdomains when the
    URL's path starts with the rule's path. Of the rules that fit, the longest
    wins; of equally long ones the first by (rule, verdict). Where none fits,
    ``rule`` is null and the verdict is ``default``.

    Distinct (host, path) pairs are judged once, so a URL or host with a large
    part of the rows costs one row here, and the verdicts are joined back.
    The rule side is broadcast up to ``broadcast_rows`` counted rows; a larger
    list is joined by a shuffle on the digest prefix.

    Null or malformed URLs have empty host and path and meet the default.
    Repeated rows are all kept. Columns of ``pages`` that are named like a
    result column are replaced; all others stay. An empty table gives an
    empty result.
    """
    digest = lambda c: F.sha2(c, 256)
    r = (
        rules.select(F.translate(F.col("host"), UPPER, LOWER).alias("rhost"), F.coalesce(F.col("path"), F.lit("")).alias("rpath"), F.col("verdict").alias("rverdict"))
        .where(F.col("rhost").isNotNull())
        .withColumn("rrule", F.concat("rhost", "rpath"))
        .withColumn("full", digest(F.concat_ws("\0", "rhost", "rpath")))
        .withColumn("short", F.substring("full", 1, prefix_hex))
    )
    # The lengths that rule paths have: as many values as the longest path has characters, at most.
    lengths = sorted(x[0] for x in r.select(F.length("rpath")).distinct().collect())
    r = r.select("short", "full", "rrule", "rverdict")
    if r.limit(broadcast_rows + 1).count() <= broadcast_rows:
        r = F.broadcast(r)

    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    rows = pages.select(*kept, url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    pairs = rows.select("host", "path").distinct()

    labels = F.split("host", "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))
    cuts = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length("path"))
    prefixes = F.transform(cuts, lambda n: F.substring(F.col("path"), F.lit(1), n))
    expressions = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat_ws("\0", s, p))))
    hits = (
        pairs.select("host", "path", F.explode(expressions).alias("expression"))
        .withColumn("digest", digest(F.col("expression")))
        .withColumn("short", F.substring("digest", 1, prefix_hex))
        .join(r, "short")
        .where(F.col("digest") == F.col("full"))
    )
    best = hits.groupBy("host", "path").agg(F.min(F.struct((-F.length("rrule")).alias("n"), F.col("rrule").alias("rule"), F.col("rverdict").alias("verdict"))).alias("best"))
    judged = {c: apart(f"judged_{c}", pages.columns) for c in ("host", "path", "best")}
    best = best.select(*[F.col(c).alias(name) for c, name in judged.items()])
    out = rows.join(best, (F.col("host") == F.col(judged["host"])) & (F.col("path") == F.col(judged["path"])), "left")
    found = F.col(judged["best"])
    return out.select(*kept, "host", "path", found["rule"].alias("rule"), F.coalesce(found["verdict"], F.lit(default)).alias("verdict"))
