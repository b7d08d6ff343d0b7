"""Snapshots, deltas, layers, trees, logs and accesses made of the test tables by rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.blobs import digest
from ..functions.modes import unix_seconds
from ..operators.access import OPEN_PERM

#: Fixed start of modification times, in nanoseconds.
EPOCH_NS = 1_600_000_000_000_000_000
SELF_PID = 3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_path() -> Column:
    return F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))


def documents(spark: SparkSession, sf_dir: str, suffix: Column | None = None) -> DataFrame:
    """Documents as files: path, mode, size, mod_time_ns, sha256, content, and their columns."""
    docs = table(spark, sf_dir, "documents")
    text = F.col("text") if suffix is None else F.concat("text", suffix)
    docs = docs.select("doc_id", "source", "lang", text.alias("content"))
    return docs.select(
        "doc_id", "source", "lang", doc_path().alias("path"), F.lit(0o644).cast("long").alias("mode"), F.octet_length("content").cast("long").alias("size"),
        (F.lit(EPOCH_NS) + F.col("doc_id") * 1000).alias("mod_time_ns"), digest(F.col("content")).alias("sha256"), "content",
    )


def in_dead_dir() -> Column:
    return (F.col("lang") == "fr") & F.col("source").isin("src3", "src4")


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).where(F.col("doc_id") % 10 < 8)


def upper(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir, F.lit("-v2"))
    return rows.where((F.col("doc_id") % 10 >= 7) & ~in_dead_dir())


def whiteouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir)
    dirs = rows.where(in_dead_dir()).select(F.concat_ws("/", "source", "lang").alias("path")).distinct()
    return dirs.unionByName(rows.where((F.col("doc_id") % 10 == 0) & ~in_dead_dir()).select("path"))


FILE_COLUMNS = ("path", "mode", "size", "mod_time_ns", "sha256")


def delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = upper(spark, sf_dir).select(*FILE_COLUMNS).withColumn("kind", F.lit("file"))
    marks = whiteouts(spark, sf_dir).withColumn("kind", F.lit("whiteout"))
    return files.unionByName(marks, allowMissingColumns=True)


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions 0 to 3 of a volume for each source: version v holds documents of doc_id % 4 <= v."""
    rows = documents(spark, sf_dir).withColumn("version", F.explode(F.sequence(F.col("doc_id") % 4, F.lit(3).cast("long"))))
    return rows.select(F.col("source").alias("volume_id"), "version", *FILE_COLUMNS)


def blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents that are stored: those of documents with doc_id % 3 <> 0."""
    return documents(spark, sf_dir).where(F.col("doc_id") % 3 != 0).select("sha256", "size", "content").dropDuplicates(["sha256"])


def all_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contents of all documents."""
    return documents(spark, sf_dir).select("sha256", "size", "content").dropDuplicates(["sha256"])


def layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layer i holds documents of doc_id % 3 <= i with i after their text; layer 2 deletes the
    files of doc_id % 10 = 0 that it does not hold, and the directories of dead files."""
    docs = table(spark, sf_dir, "documents").withColumn("layer_idx", F.explode(F.sequence(F.col("doc_id") % 3, F.lit(2).cast("long"))))
    content = F.concat("text", F.lit("-"), F.col("layer_idx").cast("string"))
    files = docs.where(~((F.col("layer_idx") == 2) & ((F.col("doc_id") % 10 == 0) | in_dead_dir()))).select(
        F.col("layer_idx").cast("int").alias("layer_idx"), doc_path().alias("path"), F.lit("file").alias("kind"), F.octet_length(content).cast("long").alias("size"), digest(content).alias("sha256")
    )
    marks = whiteouts(spark, sf_dir).select(F.lit(2).alias("layer_idx"), "path", F.lit("whiteout").alias("kind"))
    return files.unionByName(marks, allowMissingColumns=True)


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot per supplier: as many layers as the key modulo 4 says, an image for even keys."""
    rows = table(spark, sf_dir, "supplier").select("s_suppkey")
    n = (F.col("s_suppkey") % 4).cast("int")
    names = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.sha2(F.concat(F.col("s_suppkey").cast("string"), F.lit("/"), i.cast("string")), 256)))
    image = F.when(F.col("s_suppkey") % 2 == 0, F.sha2(F.col("s_suppkey").cast("string"), 256)).otherwise("")
    return rows.select(F.concat(F.lit("vol-"), F.col("s_suppkey").cast("string")).alias("volume_id"), F.lit(1).cast("long").alias("version"), image.alias("image_sha256"), F.coalesce(names, F.array().cast("array<string>")).alias("layers"))


def url_path() -> Column:
    return F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image, path, is_dir, mode, size, uid, gid, mtime): an image per source with its documents."""
    rows = documents(spark, sf_dir)
    return rows.select(F.col("source").alias("image"), F.concat_ws("/", "lang", (F.col("doc_id") % 7).cast("string"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"), F.lit(False).alias("is_dir"), "mode", "size", *owners())


def owners() -> list[Column]:
    return [(F.col("doc_id") % 1000).alias("uid"), (F.col("doc_id") % 77).alias("gid"), unix_seconds(F.col("mod_time_ns")).alias("mtime")]


def oplog(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = {"signup": "create", "view": "append", "error": "delete", "purchase": "overwrite", "click": "chmod"}
    names = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
    rows = table(spark, sf_dir, "events")
    return rows.select(F.col("user_id").alias("file_id"), "ts", "event_id", F.element_at(names, F.col("event_type")).alias("op"), F.concat(F.lit("["), F.col("event_id").cast("string"), F.lit("]")).alias("arg"))


def access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event on the path of document event_id * 7 modulo their number, every fifth on that of
    document 0, by pids 0 to 7."""
    n = table(spark, sf_dir, "documents").count()
    doc = F.when(F.col("event_id") % 5 == 0, F.lit(0)).otherwise(F.col("event_id") * 7 % n).cast("long")
    rows = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_id", (F.col("event_id") % 8).cast("int").alias("pid"), doc.alias("doc_id"))
    docs = table(spark, sf_dir, "documents").select("doc_id", doc_path().alias("path"))
    return rows.join(docs, "doc_id").select("ts", "event_id", "pid", "path", F.lit(OPEN_PERM).cast("long").alias("mask"))


def pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).where("size >= 1000").select("path", "sha256", "size")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image, parent, child): root to regions to nations to customers; a chain of suppliers below
    the root; and an edge from nation 24 back to its region, which closes a cycle."""
    read = lambda n: table(spark, sf_dir, n)
    long = lambda x: x.cast("long")
    region = read("region").select(F.lit(0).alias("parent"), long(F.col("r_regionkey") + 1).alias("child"))
    nation = read("nation").select(long(F.col("n_regionkey") + 1).alias("parent"), long(F.col("n_nationkey") + 100).alias("child"))
    customer = read("customer").select(long(F.col("c_nationkey") + 100).alias("parent"), (F.col("c_custkey") + 1_000_000).alias("child"))
    chain = read("supplier").select(F.when(F.col("s_suppkey") == 1, 0).otherwise(F.col("s_suppkey") + 9999).cast("long").alias("parent"), (F.col("s_suppkey") + 10_000).alias("child"))
    back = read("nation").where("n_nationkey = 24").select(F.lit(124).alias("parent"), long(F.col("n_regionkey") + 1).alias("child"))
    rows = [x.select(long(F.col("parent")).alias("parent"), "child") for x in (region, nation, customer, chain, back)]
    out = rows[0]
    for x in rows[1:]:
        out = out.unionByName(x)
    return out.select(F.lit("tree").alias("image"), "parent", "child")
