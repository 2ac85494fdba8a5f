"""K-d tree sharding: recursive weighted medians along the widest metadata dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from glyphmill.llm.common import cut, literal_table

BINS = 1024


def text_size(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 8."""
    return (F.octet_length(F.coalesce(text, F.lit(""))) + 8).cast("long")


def category(value: Column) -> Column:
    """A category as a coordinate: equal values meet at one place, null at its own."""
    return F.coalesce(F.pmod(F.xxhash64(value), F.lit(1 << 20)), F.lit(-1)).cast("double")


def _narrow(rows: DataFrame, value: str, state: dict[int, dict]) -> None:
    """One round: for each open node, the bin of ``value`` that holds its target weight.

    The histogram has at most ``BINS`` rows a node; one row a node reaches the driver.
    """
    spark = rows.sparkSession
    open_ = [{"node": n, "lo": s["lo"], "hi": s["hi"], "want": float(s["left"])} for n, s in state.items() if s["lo"] < s["hi"]]
    if not open_:
        return
    bounds = literal_table(spark, open_, "node int, lo double, hi double, want double")
    bounds = F.broadcast(bounds) if len(open_) <= 10_000 else bounds
    inside = rows.join(bounds, "node").where(F.col(value).between(F.col("lo"), F.col("hi")))
    bins = inside.groupBy("node", F.floor((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS).alias("bin")).agg(
        F.sum("size").alias("w"), F.min(value).alias("from"), F.max(value).alias("to"), F.first("want").alias("want")
    )
    run = bins.withColumn("upto", F.sum("w").over(W.partitionBy("node").orderBy("bin"))).where(F.col("upto") >= F.col("want"))
    for r in run.groupBy("node").agg(F.min_by(F.struct("w", "upto", "from", "to"), "bin").alias("x")).collect():
        s = state[r.node]
        s["lo"], s["hi"], s["left"], s["inside"] = r.x["from"], r.x["to"], s["left"] - (r.x["upto"] - r.x["w"]), r.x["w"]


def kd_shards(
    docs: DataFrame, dims: dict[str, Column], row_id: str = "doc_id", text: str = "text",
    target_bytes: int | None = None, n_shards: int | None = None,
) -> DataFrame:
    """Shards of nearly equal bytes; neighbours in metadata stay together.

    ``dims`` names coordinates as numeric columns. A node that must yield k
    shards is split at the weighted quantile floor(k/2)/k along the dimension
    in which its rows spread widest, relative to the whole table (first listed
    on ties), until every leaf is one shard; k is the total over
    ``target_bytes``, or ``n_shards``. Medians come from distributed
    histograms, refined until a bin holds one value; rows that share the value
    are split by a hash, so a source or value with most of the rows, or many
    copies of one row, still divides evenly.

    Returns ``row_id``, ``size``, ``text_crc32``, ``shard`` and ``slot`` for
    every row. Null text has no bytes, a coordinate that is null, infinite or
    not a number counts as -1, repeated rows are placed one by one, an empty table gives no rows, and
    other columns of ``docs`` are neither read nor returned.
    """
    spark, names = docs.sparkSession, list(dims)
    body = F.coalesce(F.col(text), F.lit(""))
    meta = docs.select(
        F.col(row_id), text_size(F.col(text)).alias("size"), F.crc32(body).alias("text_crc32"),
        *[F.when(F.abs(c.cast("double")) < float("inf"), c.cast("double")).otherwise(-1.0).alias(f"_d{i}") for i, c in enumerate(dims.values())],
    ).withColumn("_m", F.monotonically_increasing_id())
    # The row number is fixed once it is written; hashed, it spreads equal rows.
    meta = cut(meta, "kd-meta").withColumn("_h", F.shiftright(F.xxhash64(F.col(row_id), F.col("_m")), 11).cast("double"))

    extent = [f(F.col(f"_d{i}")).alias(f"{n}{i}") for i in range(len(names)) for n, f in (("lo", F.min), ("hi", F.max))]
    whole = meta.agg(F.sum("size").alias("w"), F.count(F.lit(1)).alias("n"), *extent).first()
    if not whole.n:
        return meta.select(row_id, "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    k = n_shards or max(1, -(-whole.w // target_bytes))
    spread = [max(whole[f"hi{i}"] - whole[f"lo{i}"], 1e-300) for i in range(len(names))]

    rows, nodes = meta.withColumn("node", F.lit(0)), {0: k}  # a node's number is that of its first shard
    while open_nodes := {n: c for n, c in nodes.items() if c > 1}:
        state: dict[int, dict] = {}
        for r in rows.groupBy("node").agg(F.sum("size").alias("w"), *extent).collect():
            if r.node in open_nodes:
                d = max(range(len(names)), key=lambda i: ((r[f"hi{i}"] - r[f"lo{i}"]) / spread[i], -i))
                c = open_nodes[r.node]
                state[r.node] = {"dim": d, "lo": r[f"lo{d}"], "hi": r[f"hi{d}"], "left": r.w * (c // 2) / c, "inside": r.w}
        pick = literal_table(spark, [{"node": n, "dim": s["dim"]} for n, s in state.items()], "node int, dim int")
        pick = F.broadcast(pick) if len(state) <= 10_000 else pick
        at = rows.join(pick, "node").withColumn("v", F.get(F.array(*[f"_d{i}" for i in range(len(names))]), F.col("dim")))
        while any(s["lo"] < s["hi"] for s in state.values()):
            _narrow(at.select("node", "size", "v"), "v", state)
        for s in state.values():
            s["v"], s["lo"], s["hi"] = s["lo"], float(-(1 << 52)), float(1 << 52)
        ties = literal_table(spark, [{"node": n, "tie": s["v"]} for n, s in state.items()], "node int, tie double")
        ties = F.broadcast(ties) if len(state) <= 10_000 else ties
        tied = at.join(ties, "node").where(F.col("v") == F.col("tie")).select("node", "size", "_h")
        while any(s["lo"] < s["hi"] for s in state.values()):
            _narrow(tied, "_h", state)
        # The row at the target goes to the side that it leaves nearer to the target.
        splits = [{"node": n, "dim": s["dim"], "sv": s["v"], "sh": s["lo"], "taken": s["left"] * 2 >= s["inside"], "right": n + open_nodes[n] // 2} for n, s in state.items()]
        split = literal_table(spark, splits, "node int, dim int, sv double, sh double, taken boolean, right int")
        split = F.broadcast(split) if len(splits) <= 10_000 else split
        v = F.get(F.array(*[f"_d{i}" for i in range(len(names))]), F.col("dim"))
        left = (v < F.col("sv")) | ((v == F.col("sv")) & ((F.col("_h") < F.col("sh")) | ((F.col("_h") == F.col("sh")) & F.col("taken"))))
        rows = rows.join(split, "node", "left").withColumn("node", F.when(F.col("right").isNull() | left, F.col("node")).otherwise(F.col("right"))).drop("dim", "sv", "sh", "taken", "right")
        rows = cut(rows, "kd-level")  # the next level reads its nodes, not all splits before it
        nodes = {m: c for n, cnt in nodes.items() for m, c in ([(n, cnt)] if cnt == 1 else [(n, cnt // 2), (n + cnt // 2, cnt - cnt // 2)])}

    placed = rows.select(row_id, "size", "text_crc32", F.col("node").alias("shard"), "_m", "_h")
    return _slots(placed, row_id, max(1, whole.n // (k * 2_000)))


def _slots(placed: DataFrame, row_id: str, runs: int) -> DataFrame:
    """Gapless slots: number the rows of each (shard, run), then add what earlier runs hold."""
    placed = placed.withColumn("_run", F.pmod(F.col("_h").cast("long"), F.lit(runs)))
    sizes = placed.groupBy("shard", "_run").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("shard", "_run", (F.sum("_n").over(W.partitionBy("shard").orderBy("_run")) - F.col("_n")).alias("_before"))
    number = F.row_number().over(W.partitionBy("shard", "_run").orderBy("_h", row_id, "_m")) - 1
    return placed.withColumn("_i", number).join(before, ["shard", "_run"]).select(row_id, "size", "text_crc32", F.col("shard").cast("int").alias("shard"), (F.col("_i") + F.col("_before")).cast("long").alias("slot"))
