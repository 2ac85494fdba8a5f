"""Cut points in the folder that the driver and all executors share, and numbering without a single task."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """Where the session checkpoints: its own ``spark.checkpoint.dir``, else below the warehouse."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"


def settle(df: DataFrame) -> DataFrame:
    """``df``, computed once and kept in the shared folder: short lineage, safe from lost executors."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(checkpoint_dir(spark))
    return df.checkpoint()


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores if its scan has fewer parts than there are cores, as small tables of one file have; else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df._jdf.rdd().getNumPartitions() < cores else df


def _parts(df: DataFrame, name: str, values: list[tuple[int, int]]) -> DataFrame:
    rows = json.dumps([{"part": p, name: v} for p, v in values])
    return df.sparkSession.range(1).select(F.inline(F.from_json(F.lit(rows), f"array<struct<part:int,{name}:bigint>>")))


def running_total(df: DataFrame, order: list, value: Column, name: str) -> DataFrame:
    """Adds the sum of ``value`` over all rows before each in ``order``.

    Rows are dealt by ranges of the order and summed within each range; the
    driver adds up one number a range. No task sees more than its range.
    """
    from pyspark.sql.window import Window as W

    rows = settle(df.withColumn("_v", value.cast("long")).repartitionByRange(*order)).withColumn("_part", F.spark_partition_id())
    sizes, upto, before = {r["_part"]: r["s"] for r in rows.groupBy("_part").agg(F.sum("_v").alias("s")).collect()}, 0, []
    for p in sorted(sizes):
        before.append((p, upto))
        upto += sizes[p] or 0
    own = F.coalesce(F.sum("_v").over(W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn(name, own).join(F.broadcast(_parts(df, "_before", before).withColumnRenamed("part", "_part")), "_part").withColumn(name, F.col(name) + F.col("_before")).drop("_v", "_part", "_before")


def numbered(df: DataFrame, order: list, name: str = "pos", first: int = 1) -> DataFrame:
    """Adds the number of each row in ``order``, which must be total."""
    out = running_total(df, order, F.lit(1), name)
    return out.withColumn(name, F.col(name) + first)
