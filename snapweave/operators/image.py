"""Layout of filesystem images from trees, and images as bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import modes
from ..plans.durable import materialize
from ..plans.ordered import running
from .tree import dirents

# Fixed values of the image format.
BLOCK, SLOT, SUPER_OFFSET, SUPER_SIZE, DIRENT, MAGIC, BLOCK_BITS, META_BLOCK = 4096, 32, 1024, 128, 12, 0xE0F5E1E2, 12, 1


def layout(tree: DataFrame) -> DataFrame:
    """``tree`` with data_len, n_blocks and data_offset: inodes first, then a block for each
    directory, then the files' blocks, each in the order of nid. Empty data has offset 0."""
    length = F.when(F.col("is_dir"), F.lit(BLOCK)).otherwise(F.col("size")).cast("long")
    out = tree.withColumn("data_len", length).withColumn("n_blocks", F.ceil(F.col("data_len") / BLOCK).cast("long"))
    order = [(~F.col("is_dir")).cast("int"), F.col("nid")]
    summed = running(out, "image", order, "__index", "__before", F.col("n_blocks"))
    counts = tree.groupBy("image").agg((META_BLOCK + F.ceil(F.count("*") * SLOT / BLOCK)).cast("long").alias("__base"))
    first = F.col("__base") + F.col("__before")
    placed = summed.join(counts, "image").withColumn("data_offset", F.when(F.col("data_len") > 0, first * BLOCK).otherwise(F.lit(0).cast("long")))
    return placed.select(*out.columns, "data_offset")


def totals(tree: DataFrame) -> DataFrame:
    """(image, inodes, blocks): one map-side combined aggregation."""
    sizes = F.when(F.col("is_dir"), F.lit(1)).otherwise(F.ceil(F.col("size") / BLOCK)).cast("long")
    sums = tree.groupBy("image").agg(F.count("*").alias("inodes"), F.sum(sizes).alias("data_blocks"))
    return sums.select("image", "inodes", (META_BLOCK + F.ceil(F.col("inodes") * SLOT / BLOCK).cast("long") + F.col("data_blocks")).alias("blocks"))


def dirent_offsets(entries: DataFrame) -> DataFrame:
    """``entries(image, dir_nid, idx, name)`` with name_len and nameoff in the directory's block."""
    out = entries.withColumn("name_len", F.octet_length("name").cast("long"))
    placed = running(out, ("image", "dir_nid"), [F.col("idx")], "__i", "__before", F.col("name_len"))
    counts = entries.groupBy("image", "dir_nid").agg(F.count("*").alias("__n"))
    return placed.join(counts, ["image", "dir_nid"]).withColumn("nameoff", DIRENT * F.col("__n") + F.col("__before")).select(*out.columns, "nameoff")


def name_lengths(offsets: DataFrame, block: int = BLOCK) -> DataFrame:
    """Lengths of names as a reader finds them: to the next offset, the last one's to the block's
    end; monotonic tells whether the next offset does not go back."""
    key = ["image", "dir_nid", "idx"]
    following = offsets.select("image", "dir_nid", (F.col("idx") - 1).alias("idx"), F.col("nameoff").alias("__after"))
    after = F.col("__after")
    return offsets.join(following, key, "left").withColumns({"room": F.coalesce(after, F.lit(block)) - F.col("nameoff"), "monotonic": F.coalesce(after >= F.col("nameoff"), F.lit(True))}).drop("__after")


def overflowing_dirs(entries: DataFrame, block: int = BLOCK) -> DataFrame:
    """(image, dir_nid, bytes) of directories whose entries do not fit one block."""
    sums = entries.groupBy("image", "dir_nid").agg(F.sum(DIRENT + F.octet_length("name")).alias("bytes"))
    return sums.where(F.col("bytes") > block)


def _padded(hex_: Column, n_bytes: Column) -> Column:
    return F.rpad(hex_, (n_bytes * 2).cast("int"), "0")


def build(tree: DataFrame, contents: DataFrame, placeholders: DataFrame | None = None) -> DataFrame:
    """(image, content): each image as bytes. ``contents(image, nid, content)`` has the files' data, but for
    those of ``placeholders(image, nid)``, which are zeros of their size, made where the image is put together.

    An image is one value, so this is for images of bounded size; directories that overflow their
    block, contents of another size than declared and owners beyond 16 bits raise an error. Inodes are
    compact ones, which have no modification time: mtime stays a column of the tree."""
    le = modes.write_le
    placed = layout(tree)
    offsets = dirent_offsets(dirents(tree))
    entry = F.hex(F.concat(le(F.col("nid"), 8), le(F.col("nameoff"), 2), le(F.col("file_type"), 1), le(F.lit(0), 1)))
    rows = F.array_sort(F.collect_list(F.struct("idx", entry.alias("e"), F.hex(F.encode("name", "utf-8")).alias("n"))))
    joined = lambda f: F.array_join(F.transform("rows", lambda r: r[f]), "")
    blocks = offsets.groupBy("image", F.col("dir_nid").alias("nid")).agg(rows.alias("rows")).select("image", "nid", F.concat(joined("e"), joined("n")).alias("raw"))
    fits = F.when(F.length("raw") <= 2 * BLOCK, F.unhex("raw")).otherwise(F.raise_error(F.lit("directory overflows its block")).cast("binary"))
    data = blocks.select("image", "nid", fits.alias("raw")).unionByName(contents.select("image", "nid", F.col("content").cast("binary").alias("raw"))).withColumn("zeros", F.lit(False))
    if placeholders is not None:
        data = data.unionByName(placeholders.select("image", "nid", F.unhex(F.lit("")).alias("raw"), F.lit(True).alias("zeros")))
    with_data = placed.join(data, ["image", "nid"], "left").withColumn("raw", F.coalesce("raw", F.unhex(F.lit(""))))
    sized = F.when(F.col("is_dir") | F.col("zeros") | (F.length("raw") == F.col("data_len")), F.col("raw")).otherwise(F.raise_error(F.lit("content is not of the declared size")).cast("binary"))
    zeros = lambda n: F.unhex(F.lit("00" * n))
    owner = lambda c: F.col(c) if c in tree.columns else F.lit(0)
    inode = F.concat(
        zeros(4), le(F.col("mode"), 2), le(F.when(F.col("is_dir"), 2).otherwise(1), 2), le(F.col("data_len"), 4), zeros(4),
        le(F.floor(F.col("data_offset") / BLOCK), 4), le(F.col("nid"), 4), le(owner("uid"), 2), le(owner("gid"), 2), zeros(4),
    )
    each = with_data.select("image", F.struct("nid", F.hex(inode).alias("inode")).alias("i"), F.struct("data_offset", "n_blocks", sized.alias("raw")).alias("d"))
    both = each.groupBy("image").agg(F.array_sort(F.collect_list("i")).alias("i"), F.array_sort(F.collect_list("d")).alias("d"))
    total = totals(tree).withColumnRenamed("image", "__i")
    both = both.join(total, F.col("image") == F.col("__i"))
    head = F.concat(zeros(4), F.unhex(F.lit(f"{BLOCK_BITS:02x}00")), le(F.lit(0), 2), le(F.col("inodes"), 8), zeros(12), le(F.col("blocks"), 4), le(F.lit(META_BLOCK), 4), zeros(SUPER_SIZE - 44))
    magic = le(F.lit(MAGIC), 4)
    block = F.concat(magic, le(F.crc32(F.concat(magic, zeros(4), head)), 4), head)
    first = F.concat(F.lit("00" * SUPER_OFFSET), F.hex(block))
    inodes = F.array_join(F.transform("i", lambda x: x["inode"]), "")
    size = F.ceil(F.size("i") * SLOT / BLOCK) * BLOCK
    whole = F.concat(_padded(first, F.lit(BLOCK)), _padded(inodes, size), F.array_join(F.transform("d", lambda x: _padded(F.hex(x["raw"]), x["n_blocks"] * BLOCK)), ""))
    return both.select("image", F.unhex(whole).alias("content"))


def compare(tree: DataFrame, images: DataFrame, contents: DataFrame) -> DataFrame:
    """(image, path, problem) of every path in which images, read back, differ from a tree with
    ``contents(image, nid, content)``: missing, unexpected, other mode, other size or other content."""
    from ..sources import image as source
    from .fsck import reached

    have = reached(images)
    paths = materialize(source.paths(images, have), "paths")
    digest = lambda d: d.select("image", "nid", F.sha2("content", 256).alias("sha256"))
    files = have.where(modes.file_type(F.col("mode")) != modes.S_IFDIR)
    got = paths.join(have.select("image", "nid", F.col("mode").alias("mode_b"), F.col("size").alias("size_b")), ["image", "nid"])
    got = got.join(digest(source.file_contents(images, files)).withColumnRenamed("sha256", "sha_b"), ["image", "nid"], "left")
    want = tree.join(digest(contents), ["image", "nid"], "left").select("image", "path", "is_dir", "mode", "size", F.coalesce("sha256", F.when(~F.col("is_dir"), F.sha2(F.lit("").cast("binary"), 256))).alias("sha256"))
    both = want.join(got.drop("nid"), ["image", "path"], "full")
    problem = (
        F.when(F.col("mode_b").isNull(), "missing").when(F.col("mode").isNull(), "unexpected").when(F.col("mode") != F.col("mode_b"), "other mode")
        .when(~F.col("is_dir") & (F.col("size") != F.col("size_b")), "other size").when(~F.col("sha256").eqNullSafe(F.col("sha_b")), "other content")
    )
    return both.withColumn("problem", problem).where("problem IS NOT NULL").select("image", "path", "problem")
