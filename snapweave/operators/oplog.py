"""Replay of operation logs per file, on windows only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Operations.
CREATE, APPEND, DELETE, OVERWRITE, CHMOD = "create", "append", "delete", "overwrite", "chmod"


def effective(oplog: DataFrame) -> DataFrame:
    """``oplog(file_id, ts, event_id, op, arg)`` with seq, effective (the operation did something),
    epoch (times the content began anew) and exists_after.

    create works on a file that is absent, all others on one that is there."""
    w = W.partitionBy("file_id").orderBy("ts", "event_id")
    so_far = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    alive = F.coalesce(F.last(F.when(F.col("op").isin(CREATE, DELETE), F.col("op") == CREATE), True).over(so_far), F.lit(False))
    out = oplog.withColumn("seq", F.row_number().over(w)).withColumn("exists_after", alive)
    before = F.coalesce(F.lag("exists_after").over(w), F.lit(False))
    out = out.withColumn("effective", F.when(F.col("op") == CREATE, ~before).otherwise(before))
    anew = F.col("effective") & F.col("op").isin(CREATE, OVERWRITE)
    return out.withColumn("epoch", F.sum(anew.cast("long")).over(so_far))


def _content(rows: DataFrame, *key: str) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct("seq", "arg")))
    return rows.groupBy(*key).agg(F.array_join(F.transform(parts, lambda x: x["arg"]), "").alias("content"), F.count("*").alias("n_parts"))


def final_state(oplog: DataFrame) -> DataFrame:
    """(file_id, content, n_parts) of the files that are there at the end."""
    rows = effective(oplog)
    end = rows.groupBy("file_id").agg(F.max_by("exists_after", "seq").alias("alive"), F.max("epoch").alias("epoch")).where("alive")
    writes = rows.where(F.col("effective") & F.col("op").isin(CREATE, APPEND, OVERWRITE))
    return _content(writes.join(end.select("file_id", "epoch"), ["file_id", "epoch"]), "file_id")


def checkpoints(oplog: DataFrame, every: int = 10) -> DataFrame:
    """(file_id, step, content, n_parts) after every so many operations of each file, where it is there.

    The writes of an epoch are gathered once, in order; a checkpoint takes as many of them as there
    were by then. So rows grow with operations, not with pairs of writes and checkpoints, and what is
    gathered is no more than the file holds at the end of the epoch."""
    wrote = F.col("effective") & F.col("op").isin(CREATE, APPEND, OVERWRITE)
    w = W.partitionBy("file_id", "epoch").orderBy("seq").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = effective(oplog).withColumn("n_parts", F.sum(wrote.cast("long")).over(w))
    marks = rows.where(F.col("seq") % every == 0).where("exists_after").select("file_id", "epoch", F.col("seq").alias("step"), "n_parts")
    parts = rows.where(wrote).groupBy("file_id", "epoch").agg(F.array_sort(F.collect_list(F.struct("seq", "arg"))).alias("__p"))
    joined = marks.join(parts, ["file_id", "epoch"])
    content = F.array_join(F.transform(F.slice("__p", F.lit(1), F.col("n_parts").cast("int")), lambda x: x["arg"]), "")
    return joined.select("file_id", "step", content.alias("content"), "n_parts")
