"""Append-only logs: queries and accesses, telemetry, edit data, and notices of changed paths."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions.shared import running_total

WAL_SCHEMA = "ts long, ev string, tool string, query string, path string, result_bytes long, latency_us long"
TELEMETRY_SCHEMA = "timestamp_ms long, event_type string, tool string, latency_ns long, error boolean, response_bytes long, file_count long, total_lines long, languages array<string>, version string, platform string"
#: Longest query or path that a line of the query log holds, escaped.
LONGEST = 255


def log_text(c: Column) -> Column:
    """A query or path as the log keeps it: quotes become apostrophes, line breaks and tabs spaces, and it is cut."""
    return F.substring(F.regexp_replace(F.replace(c, F.lit('"'), F.lit("'")), "[\\n\\r\\t]", " "), 1, LONGEST)


def append_events(events: DataFrame, path: str) -> None:
    """Appends rows as JSON lines; readers see whole files only."""
    events.write.mode("append").json(path)


def log_queries(spark: SparkSession, path: str, rows: list[dict]) -> None:
    """Appends queries (with ``query``) and accesses (with ``path``) to the query log."""
    df = spark.read.json(spark.sparkContext.parallelize([json.dumps(r | {"ev": "access" if r.get("path") else "query"}) for r in rows]), schema=WAL_SCHEMA)
    append_events(df.withColumn("query", log_text(F.col("query"))).withColumn("path", log_text(F.col("path"))), path)


def read_events(spark: SparkSession, path: str, schema: str = WAL_SCHEMA) -> DataFrame:
    """A log as a relation; lines that are no JSON are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def telemetry_sink(path: str):
    """For ``foreachBatch``: appends each micro-batch of telemetry, under its number, so a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").json(f"{path}/batch={number}")

    return write


def data_log(versions: DataFrame, diff: str = "diff") -> DataFrame:
    """Adds ``data_offset`` and ``data_len``: where each version's diff lies when all are written one after the other by seq."""
    size = F.coalesce(F.octet_length(diff), F.lit(0))
    out = running_total(versions, ["seq"], size, "data_offset").withColumn("data_len", size.cast("long"))
    return out.withColumn("data_offset", F.when(F.col(diff).isNotNull(), F.col("data_offset")))


def notices(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of changed paths: the lines of every file that appears in ``folder``."""
    return spark.readStream.text(folder).select(F.trim("value").alias("path")).where("path <> ''")


def take_notices(spark: SparkSession, folder: str) -> list[str]:
    """The paths that the notices in a local folder name, once each; the files that were read are removed."""
    import pyarrow.fs as pafs

    fs, base = pafs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
    paths: dict[str, None] = {}
    for info in fs.get_file_info(pafs.FileSelector(base, allow_not_found=True)):
        if info.type == pafs.FileType.File:
            with fs.open_input_stream(info.path) as f:
                paths |= dict.fromkeys(x.strip() for x in f.read().decode("utf-8", "replace").split("\n") if x.strip())
            fs.delete_file(info.path)
    return list(paths)
