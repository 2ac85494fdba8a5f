"""Helpers shared by the operators: cut points in the shared folder, table access."""

from __future__ import annotations

import atexit
import contextlib
import json
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions.shared import spread

_made: list[str] = []
#: Paths of the copies that :func:`cut` has written and nothing has deleted yet.
cuts: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    ``spark.checkpoint.dir`` of the session wins. Where it is unset, a local
    master (tests) gets a temporary folder of its own and a cluster the
    warehouse, which all its machines see.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
        path = tempfile.mkdtemp(prefix="glyphmill-")
        _made.append(path)
        spark.conf.set("spark.checkpoint.dir", f"file://{path}")
        return f"file://{path}"
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/")


@atexit.register
def _sweep() -> None:
    for path in _made:
        with contextlib.suppress(OSError):
            shutil.rmtree(path)


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends here.

    What is read survives the loss of any executor, and a frame that two
    branches use is computed once. The copy is deleted by :func:`release`, or
    else when the driver ends.
    """
    spark = df.sparkSession
    path = fresh(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    cuts.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def delete(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        if path in cuts:
            cuts.remove(path)


def release(*frames: DataFrame | None) -> None:
    """Delete the copies of cut frames that nothing will read again."""
    for df in frames:
        if df is not None and getattr(df, "_cut_path", None) in cuts:
            delete(df.sparkSession, [df._cut_path])


@atexit.register
def _release_all() -> None:
    from pyspark import SparkContext

    if cuts and SparkContext._active_spark_context is not None:
        with contextlib.suppress(Exception):  # the session may have ended already
            delete(SparkSession.builder.getOrCreate(), list(cuts))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; one of few files is spread over all cores."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def literal_table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small relation from driver values, parsed by the JVM: no Python runs on executors."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>"))).coalesce(1)


def apart(name: str, *taken: list[str]) -> str:
    """``name``, with underscores before it until it clashes with no column in ``taken`` (case does not count)."""
    used = {c.lower() for columns in taken for c in columns}
    while name.lower() in used:
        name = f"_{name}"
    return name


def bounded(df: DataFrame, most: int) -> DataFrame:
    """``df``, marked for a broadcast if it has at most ``most`` rows, which are counted first."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, also where ``use`` reads it inside of a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
