"""Snapshots: the derived relations as Parquet, with a meta file that readers validate."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.sources.files import is_sensitive

VERSION = 1


#: The column by which a relation is looked up: it is written sorted, so that readers skip row groups by their statistics.
LOOKUP = {"words": "word", "trigrams": "tri", "sparse_ngrams": "ngram", "symbols": "name", "imports": "dep"}


def write_relation(df: DataFrame, path: str, key: str | None = None) -> None:
    """One relation as Parquet, in ranges of ``key`` and sorted by it if given."""
    df = df.repartitionByRange(key).sortWithinPartitions(key) if key else df
    df.write.mode("overwrite").parquet(path)


def lookup(spark: SparkSession, path: str, name: str, values: list) -> DataFrame:
    """The rows of a stored relation with one of some keys; the filter reaches the scan."""
    return spark.read.parquet(f"{path}/{name}").where(F.col(LOOKUP[name]).isin(values))


def write_snapshot(files: DataFrame, relations: dict[str, DataFrame], path: str, root: str = "", git_head: str = "") -> None:
    """Relations first, meta last: a reader that finds no meta finds no snapshot. Sensitive files and their rows are left out."""
    spark = files.sparkSession
    kept = files.where(~is_sensitive(F.col("path")))
    kept.write.mode("overwrite").parquet(f"{path}/files")
    for name, df in relations.items():
        df = df.where(~is_sensitive(F.col("path"))) if "path" in df.columns else df
        write_relation(df, f"{path}/{name}", LOOKUP.get(name))
    meta = {"version": VERSION, "root": root, "git_head": git_head, "files": spark.read.parquet(f"{path}/files").count(), "relations": sorted(relations)}
    spark.range(1).select(F.lit(json.dumps(meta)).alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def read_meta(spark: SparkSession, path: str) -> dict | None:
    """A snapshot's meta, or None if there is none."""
    try:
        return json.loads(spark.read.text(f"{path}/meta").first().value)
    except (AnalysisException, AttributeError, ValueError):  # missing, empty or no JSON
        return None


def read_snapshot(spark: SparkSession, path: str, root: str | None = None, git_head: str | None = None) -> dict[str, DataFrame] | None:
    """The relations, or None if there is no complete snapshot for ``root`` and, if given, for the commit ``git_head``."""
    meta = read_meta(spark, path)
    if meta is None or meta.get("version") != VERSION or (root is not None and meta["root"] != root) or (git_head is not None and meta["git_head"] != git_head):
        return None
    try:
        files = spark.read.parquet(f"{path}/files")
        if files.count() != meta["files"]:
            return None
        return {"files": files} | {n: spark.read.parquet(f"{path}/{n}") for n in meta["relations"]}
    except AnalysisException:  # a part is missing
        return None


def json_snapshot(files: DataFrame, symbols: DataFrame, imports: DataFrame, seq: int = 0) -> DataFrame:
    """(section, key, value): the snapshot as JSON lines in order of section and key.

    Sections are ``seq``, ``tree`` (all paths), ``outlines`` (a file's
    symbols), ``symbol_index`` (a name's places) and ``dep_graph`` (a file's
    imports). One line holds one file's or name's part, so no task builds the
    whole document; :func:`json_document` joins small ones.
    """
    sym = F.struct("name", "kind", "line_start", "line_end")
    ordered = lambda *c: F.array_sort(F.collect_list(F.struct(*c)))
    parts = [
        files.sparkSession.range(1).select(F.lit("seq").alias("section"), F.lit("").alias("key"), F.lit(str(seq)).alias("value")),
        files.select(F.lit("tree").alias("section"), F.col("path").alias("key"), F.to_json(F.struct("path")).alias("value")),
        symbols.groupBy("path").agg(ordered("ord", sym.alias("s")).alias("s")).select(F.lit("outlines"), "path", F.to_json(F.transform("s", lambda x: x["s"]))),
        symbols.where(~F.col("kind").isin("import", "comment_block")).groupBy("name").agg(ordered("path", "line_start", "kind").alias("s")).select(F.lit("symbol_index"), "name", F.to_json("s")),
        imports.groupBy("path").agg(ordered("ord", "dep").alias("s")).select(F.lit("dep_graph"), "path", F.to_json(F.transform("s", lambda x: x["dep"]))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.orderBy("section", "key")


def json_document(rows: DataFrame) -> str:
    """The whole snapshot of a small project as one JSON object with sorted keys, built on the driver."""
    doc: dict = {"seq": 0, "tree": [], "outlines": {}, "symbol_index": {}, "dep_graph": {}}
    for r in rows.toLocalIterator():
        if r.section == "seq":
            doc["seq"] = int(r.value)
        elif r.section == "tree":
            doc["tree"].append(r.key)
        else:
            doc[r.section][r.key] = json.loads(r.value)
    return json.dumps(doc, sort_keys=True)


def overlay(base: DataFrame, changed: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """``base`` with the rows of changed paths replaced and those of removed paths dropped."""
    gone = changed.select("path").distinct()
    gone = gone if removed is None else gone.unionByName(removed.select("path")).distinct()
    return base.join(gone, "path", "left_anti").unionByName(changed)


def newer_files(listing: DataFrame, snapshot_files: DataFrame, mtime) -> DataFrame:
    """Paths to read again: changed after the snapshot, or not in it."""
    return listing.where(F.col("mtime") > mtime).select("path").unionByName(listing.join(snapshot_files, "path", "left_anti").select("path")).distinct()
