"""What an index holds, in one row, and how large it is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes that a posting takes by the size model: a word hit, a trigram posting, a sparse posting; and of a trigram or n-gram key.
HIT, POSTING, SPAN, TRIGRAM, NGRAM = 8, 10, 8, 4, 8


def _one(df: DataFrame, value: Column, name: str) -> DataFrame:
    return df.agg(F.coalesce(value, F.lit(0)).cast("long").alias(name))


def index_size(words: DataFrame, trigrams: DataFrame | None = None, ngrams: DataFrame | None = None) -> DataFrame:
    """(words, trigrams, sparse, total) in bytes: keys once, and so many bytes for each posting."""
    per_word = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    out = _one(per_word, F.sum(F.octet_length("word") + F.col("n") * HIT), "words")
    for name, df, key, each, size in (("trigrams", trigrams, "tri", POSTING, TRIGRAM), ("sparse", ngrams, "ngram", SPAN, NGRAM)):
        part = _one(df.groupBy(key).agg(F.count(F.lit(1)).alias("n")), F.sum(F.col("n") * each + size), name) if df is not None else out.select(F.lit(0).cast("long").alias(name)).limit(1)
        out = out.crossJoin(part)  # one row each
    return out.withColumn("total", F.col("words") + F.col("trigrams") + F.col("sparse"))


def status(files: DataFrame, versions: DataFrame, symbols: DataFrame, words: DataFrame, trigrams: DataFrame, state: str = "ready") -> DataFrame:
    """One row: the last sequence number, files with versions, outlined files, contents, files with trigrams, bytes of the index, state of the scan."""
    parts = [
        versions.agg(F.coalesce(F.max("seq"), F.lit(0)).cast("long").alias("seq"), F.countDistinct("path").alias("files")),
        symbols.agg(F.countDistinct("path").alias("outlines")),
        files.agg(F.count(F.lit(1)).alias("contents")),
        trigrams.agg(F.countDistinct("path").alias("trigram_files")),
        index_size(words, trigrams).select(F.col("total").alias("index_bytes")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # one row each
    return out.withColumn("scan", F.lit(state))
