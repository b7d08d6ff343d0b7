"""Access events on files that are loaded on demand, in batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The bit of a permission event for an open; bytes of an event's head.
OPEN_PERM, EVENT_BYTES = 0x10000, 24


def checked(access: DataFrame) -> DataFrame:
    """``access``; raises on an event that is no permission event for an open, and, where there is a
    column event_len, on one shorter than an event's head."""
    bad = F.raise_error(F.concat(F.lit("unexpected event mask "), F.col("mask").cast("string"))).cast("long")
    if "event_len" in access.columns:
        short = F.raise_error(F.concat(F.lit("event of "), F.col("event_len").cast("string"), F.lit(" bytes"))).cast("long")
        access = access.withColumn("mask", F.when(F.col("event_len") >= EVENT_BYTES, F.col("mask")).otherwise(short))
    return access.withColumn("mask", F.when(F.col("mask").bitwiseAND(OPEN_PERM) != 0, F.col("mask")).otherwise(bad))


def _verdicts(own: Column, pending: Column, available: Column, first: Column) -> tuple[Column, Column]:
    role = F.when(own, "self").when(~pending, "ready").when(~available | first, "initiator").otherwise("loaded")
    return role, F.when(own | ~pending | available, "allow").otherwise("deny")


def decide(access: DataFrame, pending: DataFrame, blobs: DataFrame, self_pid: int) -> DataFrame:
    """``access(ts, event_id, pid, path, mask)`` with role and decision.

    Events of the own process and on files that are not pending are allowed as they are. The first
    other event of a pending path loads it, later ones find it loaded. Where the blob cannot be
    had, every event tries anew and is denied. First events are map-side combined minima per path,
    so a path with very many events is not gathered."""
    known = pending.select("path", "sha256").dropDuplicates(["path"])
    have = blobs.select("sha256", F.lit(True).alias("__have")).dropDuplicates(["sha256"])
    files = known.join(have, "sha256", "left").select("path", F.lit(True).alias("__pending"), F.coalesce("__have", F.lit(False)).alias("__have"))
    rows = checked(access)
    at = F.struct("ts", "event_id")
    firsts = rows.where(F.col("pid") != self_pid).groupBy("path").agg(F.min(at).alias("__first"))
    joined = rows.join(files, "path", "left").join(firsts, "path", "left")
    role, decision = _verdicts(F.col("pid") == self_pid, F.coalesce("__pending", F.lit(False)), F.coalesce("__have", F.lit(False)), F.coalesce(at == F.col("__first"), F.lit(False)))
    return joined.withColumns({"role": role, "decision": decision}).select(*access.columns, "role", "decision")
