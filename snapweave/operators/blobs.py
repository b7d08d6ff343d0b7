"""Content-addressed blobs: what is missing, duplicate statistics, chunks, requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.blobs import CHUNK, chunk_offsets, digest, parse_blob_id, parse_request


def missing(candidates: DataFrame, blobs: DataFrame) -> DataFrame:
    """One row for each digest of ``candidates`` that ``blobs`` does not have."""
    return candidates.dropDuplicates(["sha256"]).join(blobs.select("sha256"), "sha256", "left_anti").select(*candidates.columns)


def present(candidates: DataFrame, blobs: DataFrame) -> DataFrame:
    """Rows of ``candidates`` whose digest ``blobs`` has."""
    return candidates.join(blobs.select("sha256"), "sha256", "left_semi").select(*candidates.columns)


def dedup_stats(manifest: DataFrame) -> DataFrame:
    """For each digest: references, logical bytes, stored bytes."""
    return manifest.groupBy("sha256").agg(F.count("*").alias("refs"), F.sum("size").alias("logical_bytes"), F.max("size").alias("stored_bytes"))


def with_content(manifest: DataFrame, blobs: DataFrame) -> DataFrame:
    """``manifest`` with content; raises where a blob is missing."""
    have = blobs.select("sha256", "content", F.lit(True).alias("__have"))
    checked = F.when(F.col("__have"), F.col("content")).otherwise(
        F.raise_error(F.concat(F.lit("missing blob "), F.coalesce("sha256", F.lit("?")))).cast(blobs.schema["content"].dataType)
    )
    return manifest.join(have, "sha256", "left").withColumn("content", checked).drop("__have")


def chunks(blobs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(sha256, chunk_idx, offset, content): blobs in chunks, an empty blob as one empty chunk."""
    content = F.col("content").cast("binary")
    rows = blobs.select("sha256", content.alias("content"), F.posexplode(chunk_offsets(F.octet_length("content"), chunk)).alias("chunk_idx", "offset"))
    return rows.select("sha256", "chunk_idx", "offset", F.substr("content", (F.col("offset") + 1).cast("int"), F.lit(chunk)).alias("content"))


def reconcile(chunk_rows: DataFrame, blobs: DataFrame) -> DataFrame:
    """For each blob the bytes in its chunks and whether they are all of them."""
    sums = chunk_rows.groupBy("sha256").agg(F.count("*").alias("n_chunks"), F.sum(F.octet_length("content").cast("long")).alias("bytes"))
    return blobs.select("sha256", "size").join(sums, "sha256", "left").withColumn("complete", F.col("bytes").eqNullSafe(F.col("size")))


def assemble(chunk_rows: DataFrame) -> DataFrame:
    """(sha256, size, content) from chunks, in order."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("chunk_idx", "content"))), lambda x: F.hex(x["content"]))
    whole = chunk_rows.groupBy("sha256").agg(F.unhex(F.array_join(parts, "")).alias("content"))
    return whole.select("sha256", F.octet_length("content").cast("long").alias("size"), "content")


def corrupt(blobs: DataFrame) -> DataFrame:
    """Blobs whose content does not have their digest."""
    return blobs.where(~digest(F.col("content").cast("binary")).eqNullSafe(F.col("sha256")))


def answer(requests: DataFrame, cache: DataFrame, origin: DataFrame) -> DataFrame:
    """Replies to ``requests(line)``: OK <size>, or ERR and why. A digest is looked up in the cache,
    then at the origin (source says where it was found). Blank lines get no reply."""
    parsed = requests.withColumn("__r", parse_request(F.col("line"))).where("__r IS NOT NULL").withColumn("__b", parse_blob_id(F.col("__r.arg")))
    known = (F.col("__r.command") == "GET") & F.col("__r.arg").isNotNull()
    at = lambda d, n: d.select(F.col("sha256").alias("__id"), F.col("size").alias(n)).dropDuplicates(["__id"])
    found = parsed.withColumn("__id", F.when(known, F.col("__b.id"))).join(at(cache, "__c"), "__id", "left").join(at(origin, "__o"), "__id", "left")
    size = F.coalesce("__c", "__o")
    reply = (
        F.when(~known, "ERR invalid command")
        .when(F.col("__b.error").isNotNull(), F.concat(F.lit("ERR "), F.col("__b.error")))
        .when(size.isNull(), "ERR not found")
        .otherwise(F.concat(F.lit("OK "), size.cast("string")))
    )
    source = F.when(F.col("__c").isNotNull(), "cache").when(F.col("__o").isNotNull(), "origin")
    return found.withColumns({"reply": reply, "source": source}).select(*requests.columns, "reply", "source")


def read(wanted: DataFrame, blobs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``wanted(sha256, ...)`` with chunk_idx, offset and content: the blobs of these digests, in chunks.

    Digests are parsed like those of requests; raises on one that is none, or that no blob has."""
    parsed = parse_blob_id(F.col("sha256"))
    bad = lambda text: F.raise_error(text).cast("string")
    own = F.when(parsed["error"].isNull(), parsed["id"]).otherwise(bad(parsed["error"]))
    have = blobs.select(F.col("sha256").alias("__id"), F.col("content").cast("binary").alias("content")).dropDuplicates(["__id"])
    found = wanted.withColumn("__want", own).join(have, F.col("__want") == F.col("__id"), "left")
    content = F.when(F.col("__id").isNotNull(), F.col("content")).otherwise(F.raise_error(F.concat(F.lit("not found: "), F.coalesce("__want", F.lit("?")))).cast("binary"))
    cut = found.withColumn("content", content).select(*wanted.columns, "content", F.posexplode(chunk_offsets(F.octet_length("content"), chunk)).alias("chunk_idx", "offset"))
    return cut.withColumn("content", F.substr("content", (F.col("offset") + 1).cast("int"), F.lit(chunk)))


def stream_faults(messages: DataFrame) -> DataFrame:
    """(stream_id, fault) of upload streams ``messages(stream_id, seq, sha256, content)``, where a message
    has either a digest (the header) or content: a message with both or neither, or content before the
    first header. A header without content is no fault (an empty blob)."""
    both = F.col("sha256").isNotNull() == F.col("content").isNotNull()
    heads = F.min(F.when(F.col("sha256").isNotNull(), F.col("seq")))
    data = F.min(F.when(F.col("content").isNotNull(), F.col("seq")))
    sums = messages.groupBy("stream_id").agg(F.count_if(both).alias("n_bad"), heads.alias("head"), data.alias("data"))
    fault = (
        F.when(F.col("n_bad") > 0, "message with both or neither of digest and content")
        .when(F.col("head").isNull() | (F.col("data") < F.col("head")), "content before digest")
    )
    return sums.withColumn("fault", fault).where("fault IS NOT NULL").select("stream_id", "fault")
