"""Benchmark decontamination by templates: numbers, names and units become typed slots.

A benchmark question that returns with other numbers or names has the same
template. Windows of template words of documents and items meet in a hash
join; each alignment that a window proposes is then checked over the whole
item, word by word, and its slots must map consistently. Alignments of one
item that lie a few words apart, as an inserted or dropped word leaves them,
are added up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from glyphmill.llm.common import apart, bind, bounded, cut, literal_table

SPACE = "[\\x20\\x09-\\x0D]+"
UNITS = "kg|g|mg|lb|lbs|km|m|cm|mm|mi|miles?|meters?|feet|ft|inch|inches|l|ml|liters?|hours?|hrs?|h|minutes?|mins?|min|seconds?|secs?|s|days?|weeks?|months?|years?|dollars?|euros?|cents?|percent|degrees?"
NUMBER, NAME, UNIT = "#num", "#name", "#unit"


def words(text: Column) -> Column:
    """The words of a text, unchanged; none for a null or blank text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def template(text: Column) -> Column:
    """The text with typed placeholders, lower-cased and without the punctuation of its words.

    A unit is a unit word after a number, a name a capitalised word inside a
    sentence. Each word stays one word, so template words and words align.
    """
    t = F.coalesce(text, F.lit(""))
    t = F.regexp_replace(t, f"(?<=[0-9])(\\x20?)(?:{UNITS})(?![\\p{{L}}\\p{{N}}])", f"$1{UNIT}")
    t = F.regexp_replace(t, "(?<=[\\p{Ll},;:]\\x20)\\p{Lu}\\p{Ll}+", NAME)
    t = F.regexp_replace(t, "[0-9]+(?:[.,][0-9]+)*", NUMBER)
    t = F.regexp_replace(t, "(?<=[\\p{L}\\p{N}])[^\\p{L}\\p{N}#\\x20\\x09-\\x0D]+", "")
    return F.lower(t)


def collapse(raw: Column, tpl: Column) -> Column:
    """Struct of ``raw`` and ``tpl`` in which a run of equal placeholders is one slot, so that a name may have any number of words."""
    same = lambda i: F.get(tpl, i).isin(NUMBER, NAME, UNIT) & (F.get(tpl, i) == F.get(tpl, i - 1))
    places = F.sequence(F.lit(1), F.size(tpl) - 1)
    runs = F.when(F.size(tpl) > 1, F.exists(places, same)).otherwise(False)
    starts = F.concat(F.array(F.lit(0)), F.filter(places, lambda i: ~same(i)))
    ends = F.concat(F.slice(starts, 2, F.size(tpl)), F.array(F.size(tpl)))
    joined = F.zip_with(starts, ends, lambda x, y: F.array_join(F.slice(raw, x + 1, y - x), " "))
    return F.when(runs, F.struct(joined.alias("raw"), F.transform(starts, lambda i: F.get(tpl, i)).alias("tpl"))).otherwise(F.struct(raw.alias("raw"), tpl.alias("tpl")))


def _consistent(agree: Column) -> Column:
    """Whether each slot value of the item stands for one value of the document."""
    slots = F.filter(agree, lambda x: x["it"].contains("#"))
    count = lambda *names: F.size(F.array_distinct(F.transform(slots, lambda x: F.concat_ws("\0", *[x[n] for n in names]))))
    return count("it", "ir", "r") == count("it", "ir")


def _windows(tpl: Column, sizes: list[int]) -> Column:
    """(pos, hash) of every run of ``sizes`` template words, by hashes of the words."""

    def runs(words_: Column, n: int) -> Column:
        last = F.size(words_) - n
        starts = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.expr("cast(array() as array<int>)"))
        return F.transform(starts, lambda i: F.struct(i.alias("pos"), F.xxhash64(F.slice(words_, i + 1, n)).alias("hash")))

    return bind(F.transform(tpl, lambda w: F.xxhash64(w)), lambda w: F.concat(*[runs(w, n) for n in sizes]))


def _templates(text: Column) -> Column:
    """Struct of ``raw`` and ``tpl``: the words of a text and of its template, runs of placeholders collapsed."""
    return bind(F.struct(words(text).alias("r"), words(template(text)).alias("t")), lambda x: collapse(x["r"], x["t"]))


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = 8, coverage: float = 0.6, drift: int = 4, broadcast_rows: int = 100_000,
) -> DataFrame:
    """Alignments of benchmark items with documents, one row for each distinct one.

    Returns ``text_key`` (MD5 of the document's text), ``item_id``, ``pos``
    (the document word at which the item's first word would lie), ``matched``
    (template words that agree there), ``item_words``, ``exact`` (matched words
    whose spelling agrees too) and ``consistent`` (no slot value of the item
    stands for two of the document; two may share one). Kept are consistent
    alignments with ``matched >= coverage * item_words``. A word here is a
    word of the template, where a run of equal placeholders counts as one.

    An alignment also counts the item words that others of its item, at most
    ``drift`` words off, add in runs of three or more, as long as all slots
    together stay consistent; the nearest are added first.

    Windows start at every word on both sides, so any shared run of
    ``window`` template words meets, whatever other items there are. Items
    shorter than ``window`` are matched by windows of their own length. Only
    hashes and positions enter the first join; the words are fetched
    afterwards, for texts with a hit alone and once for all copies of a text.
    The smaller sides are broadcast up to ``broadcast_rows`` counted rows, else
    shuffled.

    Null and empty texts match nothing, null items are ignored, an item with
    a null id is reported without one, repeated rows give one row here, empty
    tables give an empty result; other columns do not matter.
    """
    items = benchmark.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("item_text")).where(F.col("item_text").isNotNull()).distinct()
    items = items.select(F.md5(F.concat_ws("\0", F.coalesce(F.col("item_id").cast("string"), F.lit("")), "item_text")).alias("item_key"), "item_id", _templates(F.col("item_text")).alias("c"))
    items = cut(items.select("item_key", "item_id", F.col("c.raw").alias("item_raw"), F.col("c.tpl").alias("item_tpl")).where(F.size("item_tpl") > 0), "items")
    sizes = sorted(r[0] for r in items.select(F.least(F.size("item_tpl"), F.lit(window))).distinct().collect())
    if not sizes:
        return literal_table(docs.sparkSession, [], f"text_key string, item_id {items.schema['item_id'].dataType.simpleString()}, pos int, matched int, item_words int, exact int, consistent boolean")
    own = None
    for size in sizes:
        part = items.where(F.size("item_tpl") >= size) if size == window else items.where(F.size("item_tpl") == size)
        part = part.select("item_key", F.explode(_windows(F.col("item_tpl"), [size])).alias("w")).select("item_key", F.col("w.pos").alias("item_pos"), F.col("w.hash").alias("hash"))
        own = part if own is None else own.unionByName(part)
    own = bounded(own, broadcast_rows)

    texts = docs.select(F.col(text).alias("text")).where(F.col("text").isNotNull()).select(F.md5("text").alias("text_key"), "text")
    seen = texts.select("text_key", _templates(F.col("text"))["tpl"].alias("tpl")).select("text_key", F.explode(_windows(F.col("tpl"), sizes)).alias("w"))
    hits = seen.select("text_key", F.col("w.pos").alias("at"), F.col("w.hash").alias("hash")).join(own, "hash").select("text_key", "item_key", (F.col("at") - F.col("item_pos")).alias("pos"))
    hits = cut(hits.distinct(), "hits")
    keys = bounded(hits.select("text_key").distinct(), broadcast_rows)
    texts = texts.join(keys, "text_key", "left_semi").groupBy("text_key").agg(F.first("text").alias("text")).select("text_key", _templates(F.col("text")).alias("c"))

    found = hits.join(bounded(items, broadcast_rows), "item_key").join(texts, "text_key")
    # What of the item lies before the document's start or after its end is missing.
    skip, begin = F.greatest(-F.col("pos"), F.lit(0)), F.greatest(F.col("pos"), F.lit(0))
    length = F.size("item_tpl") - skip
    part = lambda c: F.slice(c, begin + 1, length)
    found = found.select("text_key", "item_key", "item_id", "pos", "item_raw", "item_tpl", skip.alias("skip"), part(F.col("c.raw")).alias("raw"), part(F.col("c.tpl")).alias("tpl"))
    pair = F.arrays_zip(
        F.col("raw").alias("r"), F.col("tpl").alias("t"),
        F.slice("item_raw", F.col("skip") + 1, F.size("tpl")).alias("ir"), F.slice("item_tpl", F.col("skip") + 1, F.size("tpl")).alias("it"),
    )
    pair = F.transform(pair, lambda x, k: F.struct((F.col("skip") + k).alias("i"), x["t"].alias("t"), x["it"].alias("it"), x["r"].alias("r"), x["ir"].alias("ir")))
    agree = F.filter(pair, lambda x: x["t"].eqNullSafe(x["it"]))
    own = found.select("text_key", "item_key", "item_id", "pos", F.size("item_tpl").alias("item_words"), agree.alias("agree"))
    own = own.withColumn("consistent", _consistent(F.col("agree"))).withColumn("places", F.transform("agree", lambda x: x["i"]))
    at = lambda i: F.array_contains("places", i)
    in_run = lambda i: (at(i - 2) & at(i - 1)) | (at(i - 1) & at(i + 1)) | (at(i + 1) & at(i + 2))
    own = own.withColumn("runs", F.filter("agree", lambda x: in_run(x["i"])))
    around = W.partitionBy("text_key", "item_key").orderBy("pos").rangeBetween(-drift, drift)
    own = own.withColumn("near", F.collect_list(F.struct("pos", "runs")).over(around))
    near = F.array_sort(F.transform(F.filter("near", lambda x: x["pos"] != F.col("pos")), lambda x: F.struct(F.abs(x["pos"] - F.col("pos")).alias("off"), x["pos"].alias("pos"), x["runs"].alias("runs"))))

    def add(have: Column, other: Column) -> Column:
        both = F.concat(have, F.filter(other["runs"], lambda x: ~F.exists(have, lambda y: y["i"] == x["i"])))
        return F.when(_consistent(both), both).otherwise(have)

    out = own.where("consistent").withColumn("near", near).withColumn("agree", F.aggregate("near", F.col("agree"), add)).select(
        "text_key", "item_id", "pos", F.size("agree").alias("matched"), "item_words",
        F.size(F.filter("agree", lambda x: x["r"] == x["ir"])).alias("exact"), "consistent",
    )
    return out.where(F.col("matched") >= coverage * F.col("item_words"))


def leaked_documents(docs: DataFrame, leaks: DataFrame, doc_id: str = "doc_id", text: str = "text", broadcast_rows: int = 100_000) -> DataFrame:
    """(doc_id, item_id) with the best alignment of each: ``matched``, ``item_words``, ``exact``, ``pos``; of equal ones the first."""
    best = leaks.groupBy("text_key", "item_id").agg(F.max_by(F.struct("matched", "item_words", "exact", "pos"), F.struct("matched", "exact", -F.col("pos"))).alias("b"))
    keys = docs.select(F.col(doc_id).alias("doc_id"), F.md5(F.col(text)).alias("text_key"))
    return keys.join(bounded(cut(best, "best"), broadcast_rows), "text_key").select(F.col("doc_id").alias(doc_id), "item_id", "b.*").distinct()


def decontaminate(docs: DataFrame, leaks: DataFrame, text: str = "text", broadcast_rows: int = 100_000) -> DataFrame:
    """``docs`` without the rows whose text holds a leak. Null texts stay; any other columns are kept as they are."""
    key = apart("text_key", docs.columns)
    keys = bounded(leaks.select(F.col("text_key").alias(key)).distinct(), broadcast_rows)
    return docs.join(keys, F.md5(docs[text]) == F.col(key), "left_anti")
