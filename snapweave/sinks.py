"""Sinks: blob stores, gated snapshot commits, exports."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.blobs import digest
from .operators import blobs as blob_ops
from .operators import fsck, layers, snapshot
from .plans.durable import materialize
from .ship import ship


def ingest_blobs(candidates: DataFrame, path: str) -> DataFrame:
    """Append to the blob table at ``path`` the ``candidates(sha256, size, content)`` it lacks.

    Raises if a content does not have its digest. Returns (sha256, size) of what was added."""
    spark = candidates.sparkSession
    wrong = F.raise_error(F.concat(F.lit("content does not have digest "), F.coalesce("sha256", F.lit("?")))).cast("binary")
    sound = candidates.select("sha256", "size", F.when(digest(F.col("content").cast("binary")).eqNullSafe(F.col("sha256")), F.col("content").cast("binary")).otherwise(wrong).alias("content"))
    have = _table(spark, path)
    new = materialize(sound.dropDuplicates(["sha256"]) if have is None else blob_ops.missing(sound, have), "new-blobs")
    new.write.mode("append").parquet(path)
    return new.select("sha256", "size")


def _table(spark: SparkSession, path: str) -> DataFrame | None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)
    return spark.read.parquet(path) if there else None


def commit_snapshot(manifest: DataFrame, stored: DataFrame, path: str, volume_id: str, expected: int) -> None:
    """Write a manifest as the next version of a volume, if every blob of it is stored and no other
    writer has written that version."""
    lost = manifest.join(stored.select("sha256"), "sha256", "left_anti").select("path").take(1)
    if lost:
        raise ValueError(f"no blob for {lost[0][0]}")
    snapshot.append_version(manifest, path, volume_id, expected)


def commit_layers(snapshots: DataFrame, stored: DataFrame, path: str, violations: DataFrame | None = None) -> None:
    """Write snapshots whose layers all have sound blobs; raises on the first that has not.

    The blobs ``stored(sha256, content)`` of the layers are checked here, unless their violations are
    given. Single writer: a folder that exists is refused before writing, not claimed."""
    if violations is None:
        wanted = layers.unnest(snapshots).select("sha256").distinct()
        images = stored.join(wanted, "sha256", "left_semi").dropDuplicates(["sha256"]).select(F.col("sha256").alias("image"), F.col("content").cast("binary").alias("content"))
        violations = fsck.fsck(materialize(images, "layers", wide=True))
    unfit = layers.unfit_layers(snapshots, stored, violations).take(1)
    if unfit:
        raise ValueError(f"layer {unfit[0].layer_idx} of {unfit[0].volume_id}: {unfit[0].reason}")
    snapshots.write.mode("errorifexists").parquet(path)


def export_files(files: DataFrame, root: str) -> DataFrame:
    """Write ``files(path, content, mode, mod_time_ns)`` below a folder that all executors see.

    Each file is written beside its place and then renamed, so a task that runs again does no harm.
    Rows without content become sparse files of their ``size``. Returns (path, bytes)."""
    ship(files.sparkSession)
    base = os.path.abspath(root)

    def run(frames: Iterator) -> Iterator:
        for frame in frames:
            sizes = []
            for row in frame.itertuples(index=False):
                target = os.path.normpath(os.path.join(base, row.path))
                if not target.startswith(base + os.sep):
                    raise ValueError(f"{row.path} leads out of the folder")
                os.makedirs(os.path.dirname(target), exist_ok=True)
                part = f"{target}.{os.getpid()}.part"
                with open(part, "wb") as f:
                    if row.content is None:
                        f.truncate(int(row.size))
                    else:
                        f.write(row.content)
                os.chmod(part, int(row.mode) & 0o7777)
                os.utime(part, ns=(int(row.mod_time_ns), int(row.mod_time_ns)))
                os.replace(part, target)
                sizes.append(os.path.getsize(target))
            yield frame[["path"]].assign(bytes=sizes)

    return files.select("path", F.col("content").cast("binary").alias("content"), "mode", "mod_time_ns", "size").mapInPandas(run, "path string, bytes long")
