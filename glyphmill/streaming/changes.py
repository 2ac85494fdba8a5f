"""Structured Streaming forms of the change feed and of query correlation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions.shared import settle
from glyphmill.operators.read import file_hash
from glyphmill.operators.versions import listing_diff
from glyphmill.sources import files as source
from glyphmill.sources.projects import git_head


def latest_changes(stream: DataFrame, since: int = 0) -> DataFrame:
    """The latest (seq, op) of every path after ``since``; run in update or complete mode."""
    return stream.where(F.col("seq") > since).groupBy("path").agg(F.max_by(F.struct("seq", "op"), "seq").alias("v")).select("path", "v.seq", "v.op")


def correlate(queries: DataFrame, accesses: DataFrame, within: str = "5 seconds", late: str = "1 minute") -> DataFrame:
    """Accesses (ts, session, path) within ``within`` after a query (ts, session, query): an interval join with watermarks."""
    q = queries.withWatermark("ts", late).select(F.col("ts").alias("q_ts"), F.col("session").alias("q_session"), "query")
    a = accesses.withWatermark("ts", late)
    return a.join(q, F.expr(f"session = q_session and ts >= q_ts and ts <= q_ts + interval {within}")).select("session", "query", "path", "ts")


def tool_windows(stream: DataFrame, tool: str = "tool", window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Calls per tool and window of event time."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", window), tool).agg(F.count(F.lit(1)).alias("calls"))


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, mtime, size, hash) of a folder's text files, as :func:`~glyphmill.operators.versions.listing_diff` compares them."""
    files = source.read_files(spark, root, policy=False)
    return files.select("path", "mtime", "size", file_hash(F.col("path"), F.col("content")).alias("hash"))


class Watcher:
    """Polls a folder: each round gives what was created, modified or deleted since the one before.

    The listing of the last round is kept in the shared folder. A folder whose
    commit changed is reported as such, so that callers may build anew.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root, self.head = spark, root, git_head(root)
        self.last = settle(listing(spark, root))

    def poll(self) -> tuple[DataFrame, bool]:
        """((path, change), whether the commit changed)."""
        now, head = settle(listing(self.spark, self.root)), git_head(self.root)
        out, moved = settle(listing_diff(self.last, now)), head != self.head
        self.last, self.head = now, head
        return out, moved

    def run(self, handle: Callable[[DataFrame, int], None], rounds: int, seconds: float = 2.0) -> None:
        """Calls ``handle`` with the changes and the number of each round that has some."""
        import time

        for k in range(rounds):
            changes, _ = self.poll()
            if not changes.isEmpty():
                handle(changes, k)
            time.sleep(seconds if k + 1 < rounds else 0)


def event_queue(changes: DataFrame, path: str) -> None:
    """Appends change events to a folder that :func:`events` streams from: a queue without a bound that loses nothing."""
    changes.write.mode("append").json(path)


def events(spark: SparkSession, path: str) -> DataFrame:
    """The stream of (path, change) of a queue; a checkpoint of the reader keeps its place."""
    return spark.readStream.schema("path string, change string").json(path)


def file_changes(spark: SparkSession, folder: str, refresh: Callable[[DataFrame], None], checkpoint: str):
    """A streaming query that takes the notices in ``folder`` and calls ``refresh`` with the distinct paths of each micro-batch."""
    from glyphmill.sources.logs import notices

    return notices(spark, folder).writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: refresh(batch.distinct())).trigger(availableNow=True).start()
