"""Checks of filesystem images: each is a predicate that gives rows of violations.

All violations of an image are found, not the first alone; ``first_error`` has the earliest. Walks
from the root go level by level over edges, each node once, a few levels to a written table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.modes import S_IFDIR, S_IFLNK, S_IFREG, file_type
from ..plans.durable import discard, materialize
from ..schemas import VIOLATIONS
from .image import BLOCK, BLOCK_BITS, DIRENT, MAGIC

#: Depth that a node may have, the root's being 1; inodes beyond the declared ones that may be met.
MAX_DEPTH, SPARE_INODES = 100, 100
#: Levels of a walk that are taken in one written table.
LEVELS = 5
#: Nodes of a turn of a walk that may be sent to every executor.
FEW = 100_000


def _faults(rows: DataFrame, code: str, nid: Column, *checks: tuple[Column, str]) -> DataFrame:
    """Violations of each row for which a check holds, one for each check."""
    found = F.filter(F.array(*[F.when(bad, F.lit(text)) for bad, text in checks]), lambda x: x.isNotNull())
    return rows.select("image", F.lit(code).alias("code"), nid.cast("long").alias("nid"), F.explode(found).alias("message"))


def check_superblocks(superblocks: DataFrame) -> DataFrame:
    c = F.col
    whole = F.coalesce(c("whole"), F.lit(False))
    return _faults(
        superblocks, "InvalidSuperblock", F.lit(None),
        (~whole, "truncated superblock"), (whole & (c("magic") != MAGIC), "invalid magic"),
        (whole & (c("checksum") != 0) & (c("checksum") != c("expected")), "checksum mismatch"),
        (whole & (c("blkszbits") != BLOCK_BITS), "unsupported block size"), (whole & (c("blocks") == 0), "zero blocks"),
        (whole & (F.coalesce(c("inodes"), F.lit(1)) == 0), "zero inodes"), (whole & (c("meta_blkaddr") == 0), "zero meta block address"),
    )


def data_faults(inodes: DataFrame, blocks: Column) -> DataFrame:
    """Violations of inodes (with ``blocks`` of the image at hand): layout, bounds, inline tails."""
    c = F.col
    n = F.when(c("data_layout") == 0, F.ceil(c("size") / BLOCK)).otherwise(F.floor(c("size") / BLOCK))
    beyond = c("data_layout").isin(0, 2) & (n > 0) & (c("raw_blkaddr") + n > blocks)
    tail = c("size") % BLOCK
    at = c("inode_offset") + F.when(c("version") == 0, 32).otherwise(64) + F.when(c("xattr_icount") > 0, 8 + 4 * c("xattr_icount")).otherwise(0)
    crosses = (c("data_layout") == 2) & (tail > 0) & (at + tail > (F.floor(c("inode_offset") / BLOCK) + 1) * BLOCK)
    known = file_type(c("mode")).isin(S_IFREG, S_IFDIR, S_IFLNK)
    code = F.when(file_type(c("mode")) == S_IFDIR, "InvalidDirectoryBlock").otherwise("InvalidInode")
    rows = _faults(inodes, "InvalidInode", c("nid"), (~c("whole"), "truncated inode"), (c("whole") & ~c("data_layout").isin(0, 2), "unsupported data layout"))
    data = inodes.where(c("whole") & known & (beyond | crosses)).select(
        "image", code.alias("code"), "nid", F.when(beyond, "block address out of bounds").otherwise("inline data crosses its block").alias("message")
    )
    return rows.unionByName(data)


def name_faults(dirents: DataFrame) -> DataFrame:
    """Violations of entries' names (binary): zero byte, slash, bad UTF-8, empty."""
    hexed, name = F.hex("name"), F.col("name")
    return _faults(
        dirents, "PathTraversal", F.col("dir_nid"),
        (hexed.rlike("^(..)*00"), "name holds a zero byte"), (hexed.rlike("^(..)*2F"), "name holds a slash"),
        (~F.is_valid_utf8(name.cast("string")), "name is not UTF-8"), (F.length(name) == 0, "empty name"),
    )


def dirent_faults(raw: DataFrame) -> DataFrame:
    """Violations of directory blocks as stored."""
    c = F.col
    none = c("idx").isNull()
    return _faults(
        raw, "InvalidDirectoryBlock", c("dir_nid"),
        (none & (c("block_bytes") < DIRENT), "block too small"), (none & (c("block_bytes") >= DIRENT), "invalid first name offset"),
        (~none & (c("reserved") != 0), "reserved byte is not zero"), (~none & (c("room") < 0) & (c("nameoff") <= c("block_bytes")), "name offsets go back"),
        (~none & (c("nameoff") + F.greatest(c("room"), F.lit(0)) > c("block_bytes")), "name beyond the block"),
    )


def reach(edges: DataFrame, roots: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(image, nid, depth) of the nodes that ``edges(image, parent, child)`` lead to from
    ``roots(image, nid)``, least depth first; nodes of depth max_depth + 1 are not walked on from.

    Where edges have a ``place`` among those of their parent, the result has ``way``: the places on the
    way to a node, whose order is that of a walk depth first. LEVELS levels make one written table."""
    placed = "place" in edges.columns
    own = F.min("place").alias("place") if placed else F.lit(0).alias("place")
    edges = materialize(edges.groupBy("image", "parent", "child").agg(own), "edges")
    at = F.array().cast("array<bigint>")
    frontier = materialize(roots.select("image", "nid", F.lit(1).alias("depth"), at.alias("way")), "level")
    seen, depth = frontier, 1
    n_edges, n_walked = edges.count(), 0
    while depth <= max_depth:
        steps, level = [], frontier
        for _ in range(min(LEVELS, max_depth + 1 - depth)):
            depth += 1
            step = edges.join(_dealt(level.select("image", F.col("nid").alias("parent"), "way")), ["image", "parent"])
            way = F.min(F.concat("way", F.array(F.col("place").cast("long")))) if placed else F.first("way")
            level = step.groupBy("image", F.col("child").alias("nid")).agg(way.alias("way")).withColumn("depth", F.lit(depth))
            steps.append(level)
        found = reduce(DataFrame.unionByName, steps).groupBy("image", "nid").agg(F.min(F.struct("depth", "way")).alias("s")).select("image", "nid", "s.*")
        found = materialize(found, "found")
        new = materialize(found.join(_of(seen, found), ["image", "nid"], "left_anti"), "level")
        discard(found)
        frontier = new.where(F.col("depth") == depth)
        seen = seen.unionByName(new)
        if frontier.isEmpty():
            break
        n_walked += new.count()
        if 2 * n_walked >= n_edges:  # an edge of a node that was walked on from is not needed again
            walked = seen.where(F.col("depth") < depth).select("image", F.col("nid").alias("parent"))
            rest = materialize(edges.join(_dealt(walked), ["image", "parent"], "left_anti"), "edges")
            discard(edges)
            edges, n_edges, n_walked = rest, rest.count(), 0
    discard(edges)
    return seen if placed else seen.drop("way")


def _dealt(side: DataFrame) -> DataFrame:
    """A side of a join that may have as many rows as the images have inodes: both sides are shuffled.
    Such a side is a small file, and Spark would send it whole through the driver for each join."""
    return side.hint("merge")


def _of(seen: DataFrame, found: DataFrame) -> DataFrame:
    """(image, nid) of the ``seen`` nodes that are in ``found``, a written table, for a join with it.
    A turn mostly finds few nodes beside those seen before: then only the few are sent around."""
    key = ["image", "nid"]
    if found.count() > FEW:
        return _dealt(seen.select(*key))
    return F.broadcast(seen.select(*key).join(F.broadcast(found.select(*key)), key, "left_semi"))


def _peeled(left: DataFrame, a: str, b: str) -> DataFrame:
    """Edges whose end ``a`` is the end ``b`` of another edge, without those on chains that such an
    end leads out of: nodes that are b of one edge alone point to its a; the pointers double."""
    ends = left.groupBy("image", F.col(b).alias("x")).agg(F.count("*").alias("n"), F.min(a).alias("to"))
    ends = materialize(ends, "ends")
    has = ends.select("image", F.col("x").alias("to"))
    pointer, moved = materialize(ends.where("n = 1").select("image", "x", "to"), "pointer"), -1
    while True:
        onward = pointer.select("image", F.col("x").alias("to"), F.col("to").alias("far"))
        new = pointer.join(_dealt(onward), ["image", "to"], "left").select("image", "x", F.coalesce("far", "to").alias("to"), F.col("far").isNotNull().alias("on"))
        new = materialize(new, "pointer")
        now = new.where("on").count()
        discard(pointer)
        pointer = new.drop("on")
        pointer._written = new.__dict__.pop("_written", None)
        if now == moved or now == 0:  # what still moves goes round, or hangs from what does
            break
        moved = now
    gone = pointer.join(_dealt(has), ["image", "to"], "left_anti").select("image", F.col("x").alias(a))
    out = left.join(_dealt(has.withColumnRenamed("to", a)), ["image", a], "left_semi").join(_dealt(gone), ["image", a], "left_anti")
    out = materialize(out.select("image", "parent", "child"), "edges")
    discard(ends, pointer)
    return out


def cycle_nodes(edges: DataFrame) -> DataFrame:
    """(image, nid) of nodes on cycles or between two of them: what is left when nodes without an
    edge in or without one out are taken away until none is; whole chains go in one turn."""
    left = materialize(edges.select("image", "parent", "child").distinct(), "edges")
    count = left.count()
    while count:
        left = _peeled(_peeled(left, "parent", "child"), "child", "parent")
        now = left.count()
        if now == count:
            break
        count = now
    return left.select("image", F.col("parent").alias("nid")).distinct()


def walk_faults(edges: DataFrame, reached: DataFrame, declared: DataFrame, max_depth: int = MAX_DEPTH, spare: int = SPARE_INODES) -> DataFrame:
    """Cycles, depth and number of inodes of what is ``reached``; ``declared(image, inodes)``."""
    met = edges.join(_dealt(reached.select("image", F.col("nid").alias("parent"))), ["image", "parent"], "left_semi")
    cycles = cycle_nodes(met).select("image", F.lit("CycleDetected").alias("code"), "nid", F.lit("on a cycle").alias("message"))
    deep = reached.where(F.col("depth") > max_depth).select("image", F.lit("MaxDepthExceeded").alias("code"), "nid", F.lit("too deep").alias("message"))
    many = reached.groupBy("image").agg(F.count("*").alias("n")).join(declared, "image").where(F.col("n") > F.col("inodes") + spare)
    many = many.select("image", F.lit("InvalidInode").alias("code"), F.lit(None).cast("long").alias("nid"), F.lit("more inodes than declared").alias("message"))
    return cycles.unionByName(deep).unionByName(many)


def fsck(images: DataFrame, max_depth: int = MAX_DEPTH, walked: tuple[DataFrame, ...] | None = None) -> DataFrame:
    """All violations (image, code, nid, message) of ``images(image, content)``; ``walked`` is their
    ``walk``, where that is at hand.

    An image with a bad superblock has those violations alone; of the others only what the root
    leads to is judged. Structure is checked without reading file contents."""
    bad, good, nodes, damaged, raw, edges, met = walk(images, max_depth) if walked is None else walked
    lost = met.join(_dealt(nodes.select("image", "nid")), ["image", "nid"], "left_anti").select("image", F.lit("InvalidInode").alias("code"), "nid", F.lit("truncated inode").alias("message"))
    of = lambda d, c: d.join(_dealt(met.select("image", F.col("nid").alias(c))), ["image", c], "left_semi")
    parts = [
        bad, lost, of(damaged, "nid"), dirent_faults(of(raw, "dir_nid")), name_faults(of(raw, "dir_nid").where("idx IS NOT NULL")),
        walk_faults(edges, met, good.select("image", "inodes"), max_depth),
    ]
    return reduce(DataFrame.unionByName, [p.select(*VIOLATIONS.names) for p in parts]).distinct()


def walk(images: DataFrame, max_depth: int = MAX_DEPTH) -> tuple[DataFrame, ...]:
    """Violations of superblocks, the superblocks of the other images, and of those images ``_walk``."""
    from ..sources import image as source

    heads = materialize(source.superblocks(images), "superblocks")
    bad = check_superblocks(heads)
    good = heads.join(bad.select("image").distinct(), "image", "left_anti")
    return bad, good, *_walk(images.join(good.select("image"), "image", "left_semi"), good, max_depth)


def _walk(images: DataFrame, heads: DataFrame, max_depth: int) -> tuple[DataFrame, ...]:
    """Of images with sound superblocks: inodes, damaged ones, directory entries, edges, and what the
    root reaches. The declared slots are read first; slots beyond them that entries lead to are read
    as they are met, until none is new. Images are read once for inodes and once for directories in a
    turn, and not where a turn has none."""
    from ..sources import image as source

    sizes = heads.select("image", "blocks")
    roots = heads.select("image", F.col("root_nid").alias("nid"))
    tables: list[list[DataFrame]] = [[], [], []]
    fresh, met = materialize(source.inodes(images, heads), "inodes"), None
    while True:
        # Directories whose data is out of bounds cannot be read on.
        damaged = materialize(data_faults(fresh.join(sizes, "image"), F.col("blocks")), "damaged")
        readable = fresh.join(_dealt(damaged.select("image", "nid")), ["image", "nid"], "left_anti")
        dirs = materialize(readable.where(file_type(F.col("mode")) == S_IFDIR), "dirs")
        tables[0].append(fresh)
        tables[1].append(damaged)
        closed = met is not None and dirs.isEmpty()  # nothing leads on
        if not closed:
            tables[2].append(materialize(source.raw_dirents(images, dirs), "dirents"))
        discard(dirs)
        nodes, damaged, raw = (reduce(DataFrame.unionByName, t) for t in tables)
        plain = raw.where("idx IS NOT NULL").where(~F.hex("name").isin("2E", "2E2E"))
        edges = plain.select("image", F.col("dir_nid").alias("parent"), F.col("nid").alias("child"), (F.col("block").cast("long") * BLOCK + F.col("idx")).alias("place"))
        if closed:
            return nodes, damaged, raw, edges.drop("place"), met
        discard(met)
        met = materialize(reach(edges, roots, max_depth), "reached")
        wanted = materialize(met.join(_dealt(nodes.select("image", "nid")), ["image", "nid"], "left_anti").select("image", "nid"), "wanted")
        fresh = wanted if wanted.isEmpty() else materialize(source.inodes_at(images, wanted, heads), "inodes")
        if fresh.isEmpty():
            return nodes, damaged, raw, edges.drop("place"), met


def reached(images: DataFrame, max_depth: int = MAX_DEPTH, walked: tuple[DataFrame, ...] | None = None) -> DataFrame:
    """Inodes that the roots of images with sound superblocks lead to, wherever their slots are."""
    _, _, nodes, *_, met = walk(images, max_depth) if walked is None else walked
    return materialize(nodes.join(_dealt(met.select("image", "nid")), ["image", "nid"], "left_semi"), "reached")


def walk_order(images: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(image, nid, way) of what the roots lead to; the order of ways is that of a walk depth first."""
    return walk(images, max_depth)[-1].select("image", "nid", "way")


def first_error(violations: DataFrame, order: DataFrame | None = None) -> DataFrame:
    """The violation that a walk depth first meets first in each image, those of the whole image before
    all; ``order(image, nid, way)`` is ``walk_order``, else nodes come by number."""
    rows = violations if order is None else violations.join(order, ["image", "nid"], "left")
    way = F.array(F.coalesce("nid", F.lit(-1))) if order is None else F.when(F.col("nid").isNotNull(), F.concat(F.array(F.lit(0).cast("long")), F.coalesce("way", F.array(F.lit(1 << 62).cast("long"))))).otherwise(F.array().cast("array<bigint>"))
    best = rows.groupBy("image").agg(F.min(F.struct(way.alias("w"), "code", "message", F.coalesce("nid", F.lit(-1).cast("long")).alias("n"))).alias("e"))
    return best.select("image", F.col("e.code").alias("code"), F.nullif(F.col("e.n"), F.lit(-1).cast("long")).alias("nid"), F.col("e.message").alias("message"))


def of_code(violations: DataFrame, code: str) -> DataFrame:
    return violations.where(F.col("code") == code)
