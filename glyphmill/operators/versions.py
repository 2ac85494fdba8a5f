"""Version log: latest, as-of, change feeds, history caps, listings, locks, edits."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from glyphmill.functions.shared import numbered

KEPT = 100


def history(versions: DataFrame, keep: int = KEPT) -> DataFrame:
    """The last ``keep`` versions of every path."""
    return versions.withColumn("_r", F.row_number().over(W.partitionBy("path").orderBy(F.desc("seq")))).where(F.col("_r") <= keep).drop("_r")


def latest(versions: DataFrame) -> DataFrame:
    rest = [c for c in versions.columns if c != "path"]
    return versions.groupBy("path").agg(F.max_by(F.struct(*rest), "seq").alias("v")).select("path", "v.*")


def at_cursor(versions: DataFrame, cursor: int) -> DataFrame:
    return latest(versions.where(F.col("seq") <= cursor))


def at_cursors(versions: DataFrame, cursors: DataFrame) -> DataFrame:
    """As-of join of (path, cursor): both sides merged in order, each cursor takes the last version before it."""
    rest = [c for c in versions.columns if c != "path"]
    v = versions.select("path", F.col("seq").alias("_at"), F.lit(0).alias("_c"), F.struct(*rest).alias("v"))
    c = cursors.select("path", F.col("cursor").alias("_at"), F.lit(1).alias("_c"), F.lit(None).cast(v.schema["v"].dataType).alias("v"))
    last = F.last("v", ignorenulls=True).over(W.partitionBy("path").orderBy("_at", "_c").rowsBetween(W.unboundedPreceding, 0))
    return v.unionByName(c).withColumn("v", last).where("_c = 1").select("path", F.col("_at").alias("cursor"), "v.*")


def changes_since(versions: DataFrame, seq: int) -> DataFrame:
    return latest(versions.where(F.col("seq") > seq))


def hot(files: DataFrame, versions: DataFrame, k: int = 10) -> DataFrame:
    last = versions.groupBy("path").agg(F.max("seq").alias("seq"))
    return files.select("path").distinct().join(last, "path", "left").select("path", F.coalesce("seq", F.lit(0)).alias("seq")).orderBy(F.desc("seq"), "path").limit(max(1, min(k, 1000)))


def listing_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change): created, deleted, or modified where the time changed and size or hash did too."""
    o, n = (d.select("path", *[F.col(c).alias(f"{p}_{c}") for c in ("mtime", "size", "hash")]) for d, p in ((old, "o"), (new, "n")))
    j = o.join(n, "path", "full")
    change = F.when(F.col("o_mtime").isNull(), "created").when(F.col("n_mtime").isNull(), "deleted").when((F.col("o_mtime") != F.col("n_mtime")) & ((F.col("o_size") != F.col("n_size")) | (F.col("o_hash") != F.col("n_hash")) | (F.col("o_hash") == 0)), "modified")
    return j.select("path", change.alias("change")).where("change is not null")


def append_versions(log: DataFrame, changes: DataFrame, keep: int | None = KEPT) -> DataFrame:
    """The log (path, seq, agent, ts, op, hash, size) with ``changes`` (the same without seq, but with ``pos``, their order) appended.

    Sequence numbers go on from the last one; a tombstone has hash and size 0.
    Only the last ``keep`` versions of a path stay (None: all).
    """
    last = log.agg(F.coalesce(F.max("seq"), F.lit(0)).cast("long")).first()[0]
    gone = F.col("op") == "tombstone"
    new = numbered(changes, ["pos"], "seq", int(last) + 1).drop("pos")
    new = new.withColumn("hash", F.when(gone, 0).otherwise(F.col("hash")).cast("long")).withColumn("size", F.when(gone, 0).otherwise(F.col("size")).cast("long"))
    out = log.unionByName(new.select(*[F.col(c).cast(log.schema[c].dataType).alias(c) for c in log.columns]))
    return out if keep is None else history(out, keep)


def current_seq(log: DataFrame) -> DataFrame:
    return log.agg(F.coalesce(F.max("seq"), F.lit(0)).cast("long").alias("seq"))


def listed_files(log: DataFrame) -> DataFrame:
    return log.select("path").distinct()


def register(agents: DataFrame, names: list[str], now: int) -> DataFrame:
    """``agents`` (id, name, state, cursor, last_seen, edit_count) with new ones, whose ids go on from the last."""
    last = agents.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    return agents.unionByName(agents.sparkSession.createDataFrame([(last + 1 + i, n, "active", 0, now, 0) for i, n in enumerate(names)], agents.schema))


def heartbeat(agents: DataFrame, ids: list[int], now) -> DataFrame:
    """Agents that were heard of are active again."""
    hit = F.col("id").isin(ids)
    return agents.withColumn("last_seen", F.when(hit, F.lit(now)).otherwise(F.col("last_seen"))).withColumn("state", F.when(hit, "active").otherwise(F.col("state")))


def reap_stale(agents: DataFrame, now: Column, timeout) -> DataFrame:
    """Active agents that were last seen before ``now - timeout`` are crashed."""
    return agents.withColumn("state", F.when((F.col("state") == "active") & (now - F.col("last_seen") > timeout), "crashed").otherwise(F.col("state")))


def held_locks(locks: DataFrame, agents: DataFrame) -> DataFrame:
    """``locks`` (agent_id, path, expiry) without those of agents that are crashed or gone."""
    return locks.join(agents.where(F.col("state").isin("crashed", "gone")).select(F.col("id").alias("agent_id")), "agent_id", "left_anti").select(*locks.columns)


def release_lock(locks: DataFrame, agent_id: int, path: str) -> DataFrame:
    """``locks`` without that of one agent on one path; another's lock stays."""
    return locks.where(~((F.col("agent_id") == agent_id) & (F.col("path") == path)))


def grant_locks(requests: DataFrame) -> DataFrame:
    """(pos, path, granted) of requests (pos, agent_id, path, ts, ttl), in order of pos: granted if nobody else holds an unexpired lock.

    A lock's holder and end follow from the grant before, so the requests of
    one path are read in order; they stream through their task, which keeps
    one holder a path and gathers nothing.
    """
    rows = requests.select("path", *[F.col(c).cast("long").alias(c) for c in ("pos", "agent_id", "ts", "ttl")])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, holder, end = None, None, 0
        for b in batches:
            granted = []
            for path, agent, ts, ttl in zip(b.path, b.agent_id, b.ts, b.ttl, strict=True):
                if path != now:
                    now, holder = path, None
                granted.append(holder is None or holder == agent or end <= ts)
                if granted[-1]:
                    holder, end = agent, ts + ttl
            yield b.assign(granted=granted)[["path", "pos", "granted"]]

    return rows.repartition("path").sortWithinPartitions("path", "pos").mapInPandas(run, "path string, pos long, granted boolean")


def apply_edit(content: Column, op: str, start: int, end: int, new: str = "") -> Column:
    """The content after replacing, deleting (lines start..end) or inserting (after line start); null if the range is invalid."""
    every = F.split(content, "\n")
    closed = content.endswith("\n")
    own = F.when(closed, F.slice(every, 1, F.size(every) - 1)).otherwise(every)
    n, added = F.size(own), F.array(*[F.lit(x) for x in new.split("\n")])
    if op == "insert":
        at = F.least(F.lit(start), n)
        out, ok = F.concat(F.slice(own, 1, at), added, F.slice(own, at + 1, n)), F.lit(True)
    else:
        ok = F.lit(start >= 1 and end >= start) & (F.lit(start) <= n)
        head, tail = F.slice(own, 1, start - 1 if start > 1 else 0), F.slice(own, F.least(F.lit(end), n) + 1, n)
        out = F.concat(head, added, tail) if op == "replace" else F.concat(head, tail)
    return F.when(ok, F.concat(F.array_join(out, "\n"), F.when(closed, "\n").otherwise("")))


def extract_lines(content: Column, first: int, last: int, numbered: bool = False) -> Column:
    """Lines first..last, 1-based; ``numbered`` puts the number before each."""
    part = F.slice(F.split(content, "\n"), first, last - first + 1)
    if numbered:
        part = F.transform(part, lambda x, i: F.format_string("%5d | %s", i + first, x))
    return F.array_join(part, "\n")
