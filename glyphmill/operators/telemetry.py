"""Telemetry: normalised events, latency summaries and corpus statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.sources.files import language


def normalise(raw: DataFrame, line: str = "value") -> DataFrame:
    """Events from JSON lines with old and new field names; seconds become milliseconds."""
    get = lambda *names: F.coalesce(*[F.get_json_object(line, f"$.{n}") for n in names])
    ts = get("timestamp_ms", "ts").cast("double")
    kind = get("event_type", "ev", "kind")
    langs = get("languages")
    split = F.when(langs.startswith("["), F.from_json(langs, "array<string>")).otherwise(F.transform(F.split(langs, ","), F.trim))
    return raw.select(
        F.when(ts < 1e12, ts * 1000).otherwise(ts).cast("long").alias("timestamp_ms"), F.when(kind == "tool", "tool_call").when(kind == "start", "session_start").otherwise(kind).alias("event_type"),
        get("tool").alias("tool"), get("latency_ns", "ns").cast("long").alias("latency_ns"), get("error", "err").cast("boolean").alias("error"), get("response_bytes", "bytes").cast("int").alias("response_bytes"),
        get("file_count", "files").cast("int").alias("file_count"), get("total_lines", "lines").cast("long").alias("total_lines"), split.alias("languages"), get("version").alias("version"), get("platform").alias("platform"),
    )


def tool_summary(events: DataFrame, tool: str, latency: Column, error: Column) -> DataFrame:
    return events.groupBy(tool).agg(F.count(F.lit(1)).alias("calls"), F.sum(error.cast("int")).alias("errors"), F.max(latency).alias("max_latency"))


def corpus_stats(files: DataFrame) -> DataFrame:
    return files.groupBy(language(F.col("path")).alias("language")).agg(F.count(F.lit(1)).alias("file_count"), F.sum(F.size(F.split("content", "\n"))).alias("total_lines"), F.sum(F.octet_length("content")).alias("bytes"))
