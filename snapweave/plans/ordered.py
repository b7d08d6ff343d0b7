"""Positions and running sums along an order, without one task per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .durable import materialize


def running(df: DataFrame, key: str | tuple[str, ...], order: list[Column], index: str, total: str | None = None, value: Column | None = None) -> DataFrame:
    """``df`` with ``index``: the position of each row among those of its key, from 0, and with
    ``total``: the sum of ``value`` over the rows before it.

    Rows are dealt by ranges of (key, order), so a key with most of the rows is spread over many
    tasks. Each range numbers and sums its own rows; what stands before a range is summed over one
    row per key and range. The ranges are written once, since a second run may cut them elsewhere.
    Rows that tie in ``order`` come in any order."""
    keys = [key] if isinstance(key, str) else list(key)
    amount = value if value is not None else F.lit(0)
    cols = [c for c in df.columns if c not in (index, total)]
    rows = df.select(*cols, amount.cast("long").alias("__v"), *[c.alias(f"__o{i}") for i, c in enumerate(order)])
    by = [*[F.col(k) for k in keys], *[F.col(f"__o{i}") for i in range(len(order))]]
    dealt = materialize(rows.repartitionByRange(*by).withColumn("__part", F.spark_partition_id()), "ranges")
    own = W.partitionBy("__part", *keys).orderBy(*by[len(keys) :]).rowsBetween(W.unboundedPreceding, W.currentRow)
    local = dealt.withColumns({"__i": F.row_number().over(own).cast("long") - 1, "__s": F.sum("__v").over(own) - F.col("__v")})
    sums = dealt.groupBy(*keys, "__part").agg(F.count("*").alias("__n"), F.sum("__v").alias("__t"))
    over = W.partitionBy(*keys).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    before = sums.select(*keys, "__part", F.coalesce(F.sum("__n").over(over), F.lit(0)).alias("__bn"), F.coalesce(F.sum("__t").over(over), F.lit(0)).alias("__bt"))
    out = local.join(before, [*keys, "__part"])
    found = [(F.col("__i") + F.col("__bn")).alias(index)]
    if total is not None:
        found.append((F.col("__s") + F.col("__bt")).alias(total))
    return out.select(*cols, *found)
