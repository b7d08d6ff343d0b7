"""Restore plans: what to skip, to fetch now and to leave for later."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.blobs import is_lazy


def plan(snapshot: DataFrame, local: DataFrame, threshold: int | Column = -1) -> DataFrame:
    """``snapshot`` with action: skip (the local file has the digest), lazy or eager. The threshold
    may be a column of ``snapshot``."""
    have = local.select("path", F.col("sha256").alias("__local")).dropDuplicates(["path"])
    same = F.col("__local").isNotNull() & (F.col("__local") == F.col("sha256"))
    action = F.when(same, "skip").when(is_lazy(F.col("size"), threshold), "lazy").otherwise("eager")
    return snapshot.join(have, "path", "left").withColumn("action", action).select(*snapshot.columns, "action")


def drained(planned: DataFrame) -> DataFrame:
    """A plan without on-demand loading: what would be lazy is eager."""
    return planned.withColumn("action", F.when(F.col("action") == "lazy", "eager").otherwise(F.col("action")))


def bytes_by_action(planned: DataFrame, *key: str) -> DataFrame:
    return planned.groupBy(*key, "action").agg(F.count("*").alias("n_files"), F.sum("size").alias("bytes"))


def materialized(planned: DataFrame, blobs: DataFrame) -> DataFrame:
    """A plan with content where it is eager; lazy rows keep their size as a placeholder."""
    eager = planned.where(F.col("action") == "eager").join(blobs.select("sha256", "content"), "sha256", "left")
    rest = planned.where(F.col("action") != "eager").withColumn("content", F.lit(None).cast(blobs.schema["content"].dataType))
    return eager.select(*planned.columns, "content").unionByName(rest.select(*planned.columns, "content"))


def pending_by_volume(planned: DataFrame) -> DataFrame:
    return planned.where(F.col("action") == "lazy").groupBy("volume_id").agg(F.count("*").alias("n_pending"))


# Ways to restore a volume.
FILES, IMAGE, LAYERS = "files", "image", "layers"


def mode(layers: Column, image: Column, images: bool = False, stacks: bool = False) -> Column:
    """How a snapshot is restored: by its layers or as an image where that is asked for (``stacks``,
    ``images``) and it has some, layers first; file by file else."""
    some = F.coalesce(F.size(layers) > 0, F.lit(False)) | (F.coalesce(image, F.lit("")) != "")
    one = F.coalesce(image, F.lit("")) != ""
    return F.when(F.lit(stacks) & some, LAYERS).when(F.lit(images) & one, IMAGE).otherwise(FILES)
