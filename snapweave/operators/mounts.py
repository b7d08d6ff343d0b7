"""Mount lookup by longest prefix, and volume aliases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths


def resolve(access: DataFrame, mounts: DataFrame) -> DataFrame:
    """``access(path, ...)`` with mount and relative path, by the longest mount that holds the path.

    Paths meet mounts by equality of an ancestor, so no nested loop; ``mounts(mount)`` may be large.
    Paths outside every mount have null for both. Only distinct paths are looked up."""
    wanted = access.select("path").distinct()
    at = wanted.select("path", F.explode(paths.ancestors(F.col("path"))).alias("mount"))
    best = at.join(mounts.select("mount"), "mount", "left_semi").groupBy("path").agg(F.max_by("mount", F.length("mount")).alias("mount"))
    below = F.when(F.col("path") == F.col("mount"), "").otherwise(paths.relative(F.col("path"), F.col("mount")))
    return access.join(best, "path", "left").withColumn("rel_path", below)


def logical_ids(volumes: DataFrame, aliases: DataFrame) -> DataFrame:
    """``volumes(volume_id, ...)`` with logical_id: the alias, or the id itself without one."""
    names = aliases.select("volume_id", F.col("logical_id").alias("__l")).dropDuplicates(["volume_id"])
    named = F.when(F.coalesce("__l", F.lit("")) != "", F.col("__l")).otherwise(F.col("volume_id"))
    return volumes.join(names, "volume_id", "left").withColumn("logical_id", named).drop("__l")
