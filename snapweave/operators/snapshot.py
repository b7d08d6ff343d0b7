"""Versioned manifests: latest version, commit of a delta, differences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..plans.ordered import running
from ..schemas import DIR, FILE, OPAQUE, WHITEOUT


def latest(manifest: DataFrame, volume_id: str | None = None) -> DataFrame:
    """Rows of the greatest version of each volume (of one volume if given; none if it has none).

    The greatest versions are one row per volume from a map-side combined aggregation, so a
    volume with many files is not gathered in one task."""
    rows = manifest if volume_id is None else manifest.where(F.col("volume_id") == volume_id)
    top = rows.groupBy("volume_id").agg(F.max("version").alias("version"))
    return rows.join(top, ["volume_id", "version"], "left_semi")


def dead_paths(base: DataFrame, whiteouts: DataFrame, key: tuple[str, ...] = ()) -> DataFrame:
    """Paths of ``base`` that are a whiteout's path or lie below one.

    A prefix anti-join as an equi-join: each path's ancestors meet the whiteouts by hash."""
    each = base.select(*key, "path", F.explode(paths.ancestors(F.col("path"))).alias("at"))
    marks = whiteouts.select(*key, F.col("path").alias("at"))
    return each.join(marks, [*key, "at"], "left_semi").select(*key, "path").distinct()


def descendants(base: DataFrame, dirs: DataFrame, key: tuple[str, ...] = ()) -> DataFrame:
    """Paths of ``base`` strictly below a path of ``dirs``."""
    each = base.select(*key, "path", F.explode(paths.ancestors(F.col("path"), own=False)).alias("at"))
    return each.join(dirs.select(*key, F.col("path").alias("at")), [*key, "at"], "left_semi").select(*key, "path").distinct()


def commit(base: DataFrame, delta: DataFrame, opaque: bool = False, strict: bool = False, key: tuple[str, ...] = ()) -> DataFrame:
    """The manifest after a delta: base without what whiteouts delete, upper files over it.

    Directories of the delta carry no rows. ``opaque``: opaque directories hide what the base has
    below them. ``strict``: a file that becomes a directory, or a directory that becomes a file,
    takes the other's rows with it; else both stay."""
    upper = delta.where(F.col("kind") == FILE)
    gone = [dead_paths(base, delta.where(F.col("kind") == WHITEOUT), key)]
    if opaque:
        gone.append(descendants(base, delta.where(F.col("kind") == OPAQUE), key))
    if strict:
        gone.append(descendants(base, upper, key))
        folders = upper.select(*key, F.explode(paths.ancestors(F.col("path"), own=False)).alias("path"))
        folders = folders.unionByName(delta.where(F.col("kind").isin(DIR, OPAQUE)).select(*key, "path"))
        gone.append(base.select(*key, "path").join(folders, [*key, "path"], "left_semi"))
    on = [*key, "path"]
    dead = reduce(DataFrame.unionByName, [*gone, upper.select(*on)])
    return base.join(dead, on, "left_anti").unionByName(upper.select(*base.columns))


def diff(old: DataFrame, new: DataFrame, key: tuple[str, ...] = ()) -> DataFrame:
    """Every path of either manifest with status added, removed, modified or same, and digests."""
    on = [*key, "path"]
    a = old.select(*on, F.col("sha256").alias("old_sha256"), F.lit(True).alias("__a"))
    b = new.select(*on, F.col("sha256").alias("new_sha256"), F.lit(True).alias("__b"))
    status = (
        F.when(F.col("__a").isNull(), "added")
        .when(F.col("__b").isNull(), "removed")
        .when(F.col("old_sha256").eqNullSafe(F.col("new_sha256")), "same")
        .otherwise("modified")
    )
    return a.join(b, on, "full").select(*on, status.alias("status"), "old_sha256", "new_sha256")


def pinned(manifest: DataFrame, pins: DataFrame) -> DataFrame:
    """Rows of the versions that ``pins(volume_id, version)`` name, whatever was written since; raises on
    a version that is not there."""
    asked = pins.select("volume_id", "version").distinct()
    found = asked.join(manifest, ["volume_id", "version"], "left")
    none = F.raise_error(F.concat(F.lit("no such version of "), F.col("volume_id"))).cast("string")
    return found.withColumn("path", F.when(F.col("path").isNotNull(), F.col("path")).otherwise(none)).select(*manifest.columns)


def without_volumes(rows: DataFrame, volumes: DataFrame) -> DataFrame:
    """``rows(volume_id, ...)`` without those of volumes that are cleaned up, by equality of the id."""
    return rows.join(volumes.select("volume_id").distinct(), "volume_id", "left_anti")


def changed_volumes(delta: DataFrame) -> DataFrame:
    """(volume_id, n_changes) of volumes whose delta has anything but plain directories."""
    return delta.where(F.col("kind") != DIR).groupBy("volume_id").agg(F.count("*").alias("n_changes"))


def as_lists(manifest: DataFrame, most: int = 10_000) -> DataFrame:
    """(volume_id, version, part, files): a manifest as lists of its files by path, of at most ``most``
    each, so that a volume of any size is no single value."""
    columns = [c for c in manifest.columns if c not in ("volume_id", "version")]
    placed = running(manifest, ("volume_id", "version"), [F.col("path")], "__i")
    files = F.array_sort(F.collect_list(F.struct("path", *[c for c in columns if c != "path"])))
    return placed.groupBy("volume_id", "version", F.floor(F.col("__i") / most).alias("part")).agg(files.alias("files"))


def append_version(manifest: DataFrame, path: str, volume_id: str, expected: int) -> None:
    """Write ``manifest`` as version expected + 1 of a volume; refuses one that exists.

    The version is claimed first by creating a file that must not exist, which file systems do
    atomically, so of several writers one passes. A writer that dies after its claim leaves the number
    without rows: readers take the greatest version that has some, the next writer goes on from its number."""
    spark = manifest.sparkSession
    claim = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_claims/volume_id={volume_id}/version={expected + 1}")
    try:
        claim.getFileSystem(spark._jsc.hadoopConfiguration()).create(claim, False).close()
    except Exception as error:
        raise FileExistsError(f"version {expected + 1} of {volume_id} exists or is being written") from error
    target = f"{path}/volume_id={volume_id}/version={expected + 1}"
    manifest.drop("volume_id", "version").write.mode("errorifexists").parquet(target)
