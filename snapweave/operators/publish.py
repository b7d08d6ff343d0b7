"""Snapshots compiled to images when they are read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.modes import unix_seconds
from ..plans.durable import materialize
from . import image, restore, snapshot, tree
from .blobs import with_content


def images_on_read(manifest: DataFrame, blobs: DataFrame, threshold: int = -1, volume_id: str | None = None) -> DataFrame:
    """(image, content): the latest version of each volume (or of one) as an image.

    Files from ``threshold`` bytes on (if it is not negative) are placeholders: zeros of their size, to
    be loaded when they are opened. All others need their blob; a missing one raises. A volume without
    files has no image."""
    latest = snapshot.latest(manifest, volume_id)
    planned = restore.plan(latest, latest.limit(0), threshold)
    files = planned.withColumnsRenamed({"volume_id": "image"}).withColumns({"is_dir": F.lit(False), "mtime": unix_seconds(F.col("mod_time_ns"))})
    nodes = materialize(tree.nodes(files.select("image", "path", "is_dir", "mode", "size", "mtime")), "nodes")
    placed = nodes.where("NOT is_dir").join(files.select("image", "path", "sha256", "action"), ["image", "path"]).select("image", "nid", "sha256", "action")
    eager = with_content(placed.where("action <> 'lazy'"), blobs).select("image", "nid", F.col("content").cast("binary").alias("content"))
    return image.build(nodes, eager, placed.where("action = 'lazy'"))
