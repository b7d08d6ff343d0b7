"""Relations of filesystem images: superblock, inodes, directory entries and file contents.

Images come as rows (image, content), as ``binaryFile`` reads them. All decoding is by column
functions on slices of the content, so Spark parallelizes over images and prunes what a query does
not use. Bytes that do not make sense are decoded as they are; ``operators.fsck`` judges them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.modes import S_IFDIR, file_type, read_le
from ..operators.image import BLOCK, DIRENT, SLOT, SUPER_OFFSET, SUPER_SIZE
from ..plans.durable import materialize


def read_images(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(image, content) of the files below ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return files.select(F.col("path").alias("image"), "content")


# Fields of the superblock and of both kinds of inode (name, offset, bytes).
SUPERBLOCK = (
    ("magic", 0, 4), ("checksum", 4, 4), ("feature_compat", 8, 4), ("blkszbits", 12, 1), ("sb_extslots", 13, 1), ("root_nid16", 14, 2),
    ("inodes", 16, 8), ("build_time", 24, 8), ("build_time_nsec", 32, 4), ("blocks", 36, 4), ("meta_blkaddr", 40, 4), ("xattr_blkaddr", 44, 4),
    ("feature_incompat", 80, 4), ("extra_devices", 84, 2), ("devt_slotoff", 86, 2), ("dirblkbits", 88, 1), ("xattr_prefix_count", 89, 1),
    ("xattr_prefix_start", 90, 4), ("packed_nid", 94, 8), ("meta_nid", 102, 8), ("root_nid64", 110, 8),
)
COMPACT = (("xattr_icount", 2, 2), ("mode", 4, 2), ("nlink", 6, 2), ("size", 8, 4), ("raw_blkaddr", 16, 4), ("ino", 20, 4), ("uid", 24, 2), ("gid", 26, 2))
EXTENDED = (("xattr_icount", 2, 2), ("mode", 4, 2), ("nlink", 44, 4), ("size", 8, 8), ("raw_blkaddr", 16, 4), ("ino", 20, 4), ("uid", 24, 4), ("gid", 28, 4))

#: Slots that are cut out of an image at once.
SLOTS = 128
TIMES = (("mtime", 32, 8), ("mtime_nsec", 40, 4))  # of extended inodes only


def superblocks(images: DataFrame) -> DataFrame:
    """One row per image: all fields, root_nid, block_size, expected (the checksum it should have)
    and whole (all its bytes are there)."""
    block = F.substr("content", F.lit(SUPER_OFFSET + 1), F.lit(SUPER_SIZE))
    rows = images.select("image", F.length("content").cast("long").alias("image_bytes"), block.alias("b"))
    fields = [read_le(F.col("b"), at, n).alias(name) for name, at, n in SUPERBLOCK]
    bare = F.concat(F.substr("b", F.lit(1), F.lit(4)), F.unhex(F.lit("00000000")), F.substr("b", F.lit(9)))
    out = rows.select("image", "image_bytes", (F.length("b") == SUPER_SIZE).alias("whole"), *fields, F.crc32(bare).alias("expected"), F.substr("b", F.lit(49), F.lit(16)).alias("uuid"), F.substr("b", F.lit(65), F.lit(16)).alias("volume_name"))
    root = F.when(F.col("root_nid64") != 0, F.col("root_nid64")).otherwise(F.col("root_nid16"))
    size = F.when(F.col("blkszbits") == 0, F.lit(BLOCK)).otherwise(F.expr("shiftleft(1, CAST(least(blkszbits, 30) AS INT))"))
    return out.withColumns({"root_nid": root, "block_size": size.cast("long")})


def inodes(images: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """Inodes of all slots that the superblock declares, as far as the image has them. Images may use
    slots beyond: ``inodes_at`` reads any, ``operators.fsck.reached`` those that the root leads to.
    ``heads`` are the images' superblocks, where they were read before."""
    heads = superblocks(images) if heads is None else heads
    start = F.col("meta_blkaddr") * F.col("block_size")
    slots = F.least(F.col("inodes"), F.floor((F.col("image_bytes") - start) / SLOT))
    where = heads.where("inodes > 0 AND image_bytes > meta_blkaddr * block_size").select("image", start.alias("start"), slots.alias("slots")).where("slots > 0")
    run = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / SLOTS)))
    runs = where.select("image", "start", "slots", run.alias("run"))
    last = F.least(F.col("slots"), (F.col("run") + 1) * SLOTS) - 1
    return _inodes_of(runs.select("image", "start", "run", F.sequence(F.col("run") * SLOTS, last).alias("nids")).join(images.select("image", "content"), "image"))


def inodes_at(images: DataFrame, wanted: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """(image, nid, inode_offset, version, data_layout, mode, size, raw_blkaddr, ...) of the slots
    ``wanted(image, nid)`` that begin inside their image; whole tells whether all their bytes are there.
    ``heads`` are the images' superblocks, where they were read before."""
    heads = superblocks(images) if heads is None else heads
    head = heads.select("image", (F.col("meta_blkaddr") * F.col("block_size")).alias("start"), "image_bytes")
    offset = F.col("start") + F.col("nid") * SLOT
    places = wanted.select("image", "nid").join(head, "image").where((F.col("nid") >= 0) & (offset >= 0) & (offset < F.col("image_bytes")) & (offset < 2147483647))
    runs = places.groupBy("image", "start", F.floor(F.col("nid") / SLOTS).alias("run")).agg(F.collect_list("nid").alias("nids"))
    return _inodes_of(runs.join(images.select("image", "content"), "image"))


def _inodes_of(rows: DataFrame) -> DataFrame:
    """Inodes of ``rows(image, start, run, nids, content)``: the bytes of a run are cut out first, so
    that not each slot is a row with the whole image."""
    at = (F.col("start") + F.col("run") * SLOTS * SLOT).cast("int")
    cut = rows.select("image", "start", "run", "nids", F.substr("content", at + 1, F.lit((SLOTS + 1) * SLOT)).alias("area"))
    each = cut.select("image", "start", "run", "area", F.explode("nids").alias("nid"))
    slot = F.substr("area", ((F.col("nid") - F.col("run") * SLOTS) * SLOT).cast("int") + 1, F.lit(2 * SLOT))
    raw = each.select("image", "nid", (F.col("start") + F.col("nid") * SLOT).alias("inode_offset"), slot.alias("b"))
    fmt = raw.withColumn("format", read_le(F.col("b"), 0, 2)).withColumns({"version": F.col("format").bitwiseAND(1), "data_layout": F.shiftright("format", 1).bitwiseAND(7)})
    pick = [F.when(F.col("version") == 0, read_le(F.col("b"), c[1], c[2])).otherwise(read_le(F.col("b"), e[1], e[2])).alias(c[0]) for c, e in zip(COMPACT, EXTENDED, strict=True)]
    times = [F.when(F.col("version") == 1, read_le(F.col("b"), at, n)).alias(name) for name, at, n in TIMES]
    whole = F.coalesce(F.length("b") >= F.when(F.col("version") == 0, SLOT).otherwise(2 * SLOT), F.lit(False))
    return fmt.select("image", "nid", "inode_offset", "format", "version", "data_layout", *pick, *times, whole.alias("whole"))


def inline_offset(version: Column, xattr_icount: Column) -> Column:
    """Where inline data begins after the start of its inode."""
    head = F.when(version == 0, F.lit(SLOT)).otherwise(F.lit(2 * SLOT))
    return head + F.when(xattr_icount > 0, 8 + 4 * xattr_icount).otherwise(F.lit(0))


def file_contents(images: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(image, nid, mode, content) of inodes (all, or the given ones): whole blocks, and the tail
    beside the inode in the inline layout."""
    own = inodes(images) if nodes is None else nodes
    rows = own.join(images, "image")
    at = (F.col("raw_blkaddr") * BLOCK + 1).cast("int")
    tail = (F.col("size") % BLOCK).cast("int")
    body = F.substr("content", at, (F.col("size") - tail).cast("int"))
    beside = F.substr("content", (F.col("inode_offset") + inline_offset(F.col("version"), F.col("xattr_icount")) + 1).cast("int"), tail)
    content = F.when(F.col("data_layout") == 2, F.concat(body, beside)).otherwise(F.substr("content", at, F.col("size").cast("int")))
    return rows.select("image", "nid", "mode", F.when(F.col("size") == 0, F.unhex(F.lit(""))).otherwise(content).alias("content"))


def raw_dirents(images: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(image, dir_nid, block, idx, nid, nameoff, file_type, reserved, room, name, block_bytes) as
    stored; the last name of a block ends at its first zero byte. Blocks of under 12 bytes and
    those that start with an offset that no entry count explains have one row of null idx."""
    own = inodes(images) if nodes is None else nodes
    dirs = file_contents(images, own.where(file_type(F.col("mode")) == S_IFDIR)).where(F.length("content") > 0)
    block = F.sequence(F.lit(0), F.ceil(F.length("content") / BLOCK).cast("int") - 1)
    cut = dirs.select("image", F.col("nid").alias("dir_nid"), "content", F.explode(block).alias("block"))
    cut = cut.select("image", "dir_nid", "block", F.substr("content", F.col("block") * BLOCK + 1, F.lit(BLOCK)).alias("b"))
    cut = cut.withColumn("first", F.when(F.length("b") >= DIRENT, read_le(F.col("b"), 8, 2))).where("first IS NULL OR first <> 0")
    sound = (F.col("first") % DIRENT == 0) & (F.col("first") <= F.length("b"))
    idx = F.when(sound, F.sequence(F.lit(0), F.floor(F.col("first") / DIRENT).cast("int") - 1)).otherwise(F.array(F.lit(None).cast("int")))
    rows = cut.select("image", "dir_nid", "block", "b", "first", F.explode(idx).alias("idx"))
    at = F.col("idx") * DIRENT
    rows = rows.withColumns({"nid": read_le(F.col("b"), at, 8), "nameoff": read_le(F.col("b"), at + 8, 2), "file_type": read_le(F.col("b"), at + 10, 1), "reserved": read_le(F.col("b"), at + 11, 1)})
    last = F.col("idx") == F.floor(F.col("first") / DIRENT) - 1
    after = F.when(last, F.length("b").cast("long")).otherwise(read_le(F.col("b"), at + DIRENT + 8, 2))
    rows = rows.withColumn("room", after - F.col("nameoff"))
    taken = F.hex(F.substr("b", (F.col("nameoff") + 1).cast("int"), F.greatest(F.col("room"), F.lit(0)).cast("int")))
    ended = F.regexp_extract(taken, "^((?:(?!00)..)*)", 1)
    name = F.unhex(F.when(last, ended).otherwise(taken))
    return rows.select("image", "dir_nid", "block", "idx", "nid", "nameoff", "file_type", "reserved", "room", name.alias("name"), F.length("b").cast("long").alias("block_bytes"))


def dirents(images: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(image, dir_nid, block, idx, nid, name, file_type): entries with names as text; a directory's in
    the order of block and idx."""
    return raw_dirents(images, nodes).where("idx IS NOT NULL").select("image", "dir_nid", "block", "idx", "nid", F.try_validate_utf8(F.col("name").cast("string")).alias("name"), "file_type")


def paths(images: DataFrame, nodes: DataFrame, max_depth: int = 100) -> DataFrame:
    """(image, nid, path) of ``nodes``, from the root down, one level of all images at a time. A node
    with several names has the least path of its least depth."""
    names = dirents(images, nodes).where("name NOT IN ('.', '..')").select("image", F.col("dir_nid").alias("up"), "nid", "name")
    names = materialize(names, "names")
    level = materialize(superblocks(images).select("image", F.col("root_nid").alias("nid"), F.lit("").alias("path")), "level")
    seen = level
    for _ in range(max_depth):
        step = names.join(level.select("image", F.col("nid").alias("up"), F.col("path").alias("above")), ["image", "up"])
        step = step.groupBy("image", "nid").agg(F.min(F.concat("above", F.when(F.col("above") == "", "").otherwise("/"), "name")).alias("path"))
        level = materialize(step.join(seen.select("image", "nid"), ["image", "nid"], "left_anti"), "level")
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return seen
