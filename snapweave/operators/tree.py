"""File trees as rows: implied directories, children, pre-order numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import modes, paths
from ..plans.ordered import running


#: Columns of a tree that files may bring along.
OWNERS = ("uid", "gid", "mtime")


def from_arrays(trees: DataFrame, image: str = "image") -> DataFrame:
    """``files`` for ``nodes``, with content, from rows (image, paths, is_dirs, contents, modes): four
    arrays of one length each; raises where lengths differ."""
    arrays = ("paths", "is_dirs", "contents", "modes")
    sizes = F.array(*[F.size(c) for c in arrays])
    first = F.when(F.array_min(sizes) == F.array_max(sizes), F.col("paths")).otherwise(F.raise_error(F.lit("arrays of different lengths")).cast("array<string>"))
    rows = trees.select(image, F.explode(F.arrays_zip(first.alias("paths"), *arrays[1:])).alias("z"))
    path = F.array_join(paths.parts(F.col("z.paths")), "/")
    return rows.select(image, path.alias("path"), F.col("z.is_dirs").alias("is_dir"), F.col("z.modes").alias("mode"), F.octet_length("z.contents").cast("long").alias("size"), F.col("z.contents").alias("content"))


def implied_dirs(files: DataFrame, key: tuple[str, ...] = ()) -> DataFrame:
    """Directories that paths imply and no row names: proper ancestors, without the root."""
    above = files.select(*key, F.explode(paths.ancestors(F.col("path"), own=False)).alias("path")).distinct()
    return above.join(files.select(*key, "path"), [*key, "path"], "left_anti")


def nodes(files: DataFrame, image: str = "image") -> DataFrame:
    """All nodes of each image's tree from ``files(image, path, is_dir, mode, size)``: the root,
    implied directories, and the files, numbered in pre-order with children by name. uid, gid and
    mtime (seconds) are those of the files that have such columns, else 0.

    Ordering by the components of paths is pre-order: a parent is a prefix of its children. Nodes are
    numbered along ranges of that order, so a large image is spread over many tasks."""
    made = [F.lit(True).alias("is_dir"), F.lit(0o755).alias("mode"), *[F.lit(0).cast("long").alias(c) for c in ("size", *OWNERS)]]
    implied = implied_dirs(files, (image,)).select(image, "path", *made)
    roots = files.select(image).distinct().select(image, F.lit("").alias("path"), *made)
    owners = [(F.coalesce(F.col(c).cast("long"), F.lit(0)) if c in files.columns else F.lit(0).cast("long")).alias(c) for c in OWNERS]
    rows = files.select(image, "path", "is_dir", F.col("mode").cast("int").alias("mode"), F.col("size").cast("long").alias("size"), *owners)
    every = rows.unionByName(implied).unionByName(roots)
    mode = F.when(F.col("is_dir"), F.col("mode").bitwiseOR(modes.S_IFDIR)).otherwise(modes.default_type(F.col("mode")))
    numbered = running(every.withColumns({"mode": mode, "__parts": paths.parts(F.col("path"))}), image, [F.col("__parts")], "nid")
    name = F.coalesce(F.try_element_at("__parts", F.lit(-1)), F.lit(""))
    own = numbered.select(image, "nid", name.alias("name"), "path", paths.parent(F.col("path")).alias("__up"), "is_dir", "mode", "size", *OWNERS)
    ups = numbered.select(image, F.col("path").alias("__up"), F.col("nid").alias("parent_nid"))
    return own.join(ups, [image, "__up"]).select(F.col(image).alias("image"), "nid", "parent_nid", "name", "path", "is_dir", "mode", "size", *OWNERS)


def children(tree: DataFrame) -> DataFrame:
    """(image, dir_nid, nid, name, file_type) of every directory's entries, the root no one's."""
    return tree.where("nid <> 0").select("image", F.col("parent_nid").alias("dir_nid"), "nid", "name", modes.dirent_type(F.col("mode")).alias("file_type"))


def child_counts(tree: DataFrame) -> DataFrame:
    """Entries of each directory, with those for itself and its parent."""
    counts = children(tree).groupBy("image", F.col("dir_nid").alias("nid")).agg(F.count("*").alias("n"))
    dirs = tree.where("is_dir").select("image", "nid")
    return dirs.join(counts, ["image", "nid"], "left").select("image", "nid", (F.coalesce("n", F.lit(0)) + 2).alias("n_entries"))


def dirents(tree: DataFrame) -> DataFrame:
    """All directory entries with idx: itself, its parent, then children by name."""
    dirs = tree.where("is_dir")
    dot = dirs.select("image", F.col("nid").alias("dir_nid"), "nid", F.lit(".").alias("name"), F.lit(modes.FT_DIR).alias("file_type"), F.lit(0).alias("g"))
    up = dirs.select("image", F.col("nid").alias("dir_nid"), F.col("parent_nid").alias("nid"), F.lit("..").alias("name"), F.lit(modes.FT_DIR).alias("file_type"), F.lit(1).alias("g"))
    every = dot.unionByName(up).unionByName(children(tree).withColumn("g", F.lit(2)))
    placed = running(every, ("image", "dir_nid"), [F.col("g"), F.col("name")], "idx")
    return placed.withColumn("idx", F.col("idx").cast("int")).drop("g")
