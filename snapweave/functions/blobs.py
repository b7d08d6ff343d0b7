"""Digests, chunks, endpoints, requests and layer lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of a chunk of a blob stream.
CHUNK = 1 << 20


def digest(content: Column) -> Column:
    """SHA-256 as lower-case hex."""
    return F.sha2(content, 256)


def trim_space(text: Column) -> Column:
    """``text`` without white space of any kind (Unicode's) at its ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def parse_blob_id(text: Column) -> Column:
    """struct<id, error>: a trimmed digest of 64 hex digits in lower case, or why it is none. Lengths
    are in bytes."""
    t = trim_space(text)
    error = F.when(F.octet_length(t) != 64, F.concat(F.lit("invalid sha256 length: "), F.octet_length(t).cast("string"))).when(
        ~t.rlike("^[0-9a-fA-F]*$"), F.lit("invalid sha256 characters")
    )
    error = F.when(text.isNull(), F.lit("invalid sha256 length: 0")).otherwise(error)
    return F.struct(F.when(error.isNull(), F.lower(t)).alias("id"), error.alias("error"))


def parse_request(line: Column) -> Column:
    """struct<command, arg>: a trimmed request line at its first space; null for a blank one."""
    t = trim_space(line)
    cut = F.split(t, " ", 2)
    return F.when(t != "", F.struct(F.upper(cut[0]).alias("command"), F.get(cut, F.lit(1)).alias("arg")))


def parse_reply(reply: Column) -> Column:
    """struct<size, error> of a reply to a request: the size after OK, or what went wrong."""
    t = trim_space(reply)
    size = trim_space(F.substr(t, F.lit(3)))
    whole = F.when(size.rlike("^[+-]?[0-9]+$"), size.try_cast("long"))
    error = (
        F.when(t.startswith("ERR"), F.concat(F.lit("server error: "), F.regexp_replace(t, "^ERR ", "")))
        .when(~t.startswith("OK"), F.concat(F.lit("unexpected server response: "), t))
        .when(whole.isNull(), F.concat(F.lit("invalid size: "), size))
    )
    error = F.when(reply.isNull(), F.lit("unexpected server response: ")).otherwise(error)
    return F.struct(F.when(error.isNull(), whole).alias("size"), error.alias("error"))


def parse_endpoint(endpoint: Column) -> Column:
    """struct<scheme, address> of scheme://address with scheme unix or tcp, the address may be empty; null else."""
    cut = F.split(endpoint, "://", 2)
    return F.when((F.size(cut) == 2) & cut[0].isin("unix", "tcp"), F.struct(cut[0].alias("scheme"), cut[1].alias("address")))


def chunk_offsets(size: Column, chunk: int = CHUNK) -> Column:
    """Offsets of a blob's chunks; an empty blob has one empty chunk."""
    n = F.greatest(F.ceil(size / chunk), F.lit(1)).cast("long")
    return F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: i * chunk)


def layers_or_image(layers: Column, image: Column) -> Column:
    """The layer list, or the image alone where there is none."""
    empty = F.array().cast("array<string>")
    return F.when(F.size(F.coalesce(layers, empty)) > 0, layers).when(F.coalesce(image, F.lit("")) != "", F.array(image)).otherwise(empty)


def next_layers(layers: Column, new: Column, most: int = 2) -> Column:
    """Layers after a commit: one more, or a single combined one from ``most`` existing on."""
    return F.when(F.size(layers) >= most, F.array(new)).otherwise(F.array_append(layers, new))


def lower_dirs(layers: Column, prefix: str = "layer-") -> Column:
    """Mount names of the layers, newest first, joined by colons."""
    n = F.size(layers)
    names = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.concat(F.lit(prefix), i.cast("string"))))
    return F.coalesce(F.array_join(F.reverse(names), ":"), F.lit(""))


def is_lazy(size: Column, threshold: int | Column) -> Column:
    """Whether a file is left to be loaded on demand; a negative threshold turns that off."""
    t = F.lit(threshold) if isinstance(threshold, int) else threshold
    return (t >= 0) & (size >= t)
