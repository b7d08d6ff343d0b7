"""Snapshots as protobuf messages, as they are stored and sent.

Messages come as rows (volume_id, content), as ``binaryFile`` reads them, and give rows of files. A
repeated field may be spread over pieces of a message, so ``encode`` writes bounded pieces whose
concatenation in order is the message, and ``files`` reads whole messages and pieces alike."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ordered import running
from ..ship import ship

# Fields of the messages (name, number, type), repeated ones with *.
FILE_FIELDS = (("path", 1, "STRING"), ("mode", 2, "UINT32"), ("size", 3, "INT64"), ("mod_time", 4, "Time"), ("sha256", 5, "STRING"))
SNAPSHOT_FIELDS = (("*files", 1, "File"), ("image_sha256", 2, "STRING"), ("*layers", 3, "STRING"))
TIME_FIELDS = (("seconds", 1, "INT64"), ("nanos", 2, "INT32"))

_FILES = "path string, mode bigint, size bigint, mod_time_ns bigint, sha256 string"
#: Rows of a batch that decoding gives; files of a piece that encoding writes.
_ROWS, PIECE = 10_000, 10_000


@functools.cache
def _message():
    """The class of snapshot messages."""
    from google.protobuf import descriptor_pb2, descriptor_pool, message_factory

    kinds = descriptor_pb2.FieldDescriptorProto
    file = descriptor_pb2.FileDescriptorProto(name="snapshots.proto", package="snapshots", syntax="proto3")
    for name, fields in (("Time", TIME_FIELDS), ("File", FILE_FIELDS), ("Snapshot", SNAPSHOT_FIELDS)):
        own = file.message_type.add(name=name)
        for field, number, kind in fields:
            label = kinds.LABEL_REPEATED if field.startswith("*") else kinds.LABEL_OPTIONAL
            one = own.field.add(name=field.lstrip("*"), number=number, label=label)
            if kind in ("Time", "File"):
                one.type, one.type_name = kinds.TYPE_MESSAGE, f".snapshots.{kind}"
            else:
                one.type = getattr(kinds, f"TYPE_{kind}")
    pool = descriptor_pool.DescriptorPool()
    pool.Add(file)
    return message_factory.GetMessageClass(pool.FindMessageTypeByName("snapshots.Snapshot"))


def _parsed(content: bytes):
    try:
        return _message().FromString(content)
    except Exception as error:
        raise ValueError("not a snapshot message") from error


def files(messages: DataFrame) -> DataFrame:
    """``messages(volume_id, content, ...)`` as rows of files: their other columns with path, mode, size,
    mod_time_ns and sha256. Fields that a message leaves out have their defaults ('' and 0)."""
    ship(messages.sparkSession)
    others = [c for c in messages.columns if c != "content"]
    schema = messages.select(*others, *[F.lit(None).cast(k).alias(n) for n, k in (f.split(" ") for f in _FILES.split(", "))]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.names.index("content")
            for i, content in enumerate(batch.column(at)):
                found = _parsed(content.as_py() or b"").files
                for k in range(0, len(found), _ROWS):
                    some = found[k : k + _ROWS]
                    keys = [pa.array([batch.column(n)[i].as_py()] * len(some), batch.column(n).type) for n in range(len(batch.columns)) if n != at]
                    own = [[f.path for f in some], [f.mode for f in some], [f.size for f in some], [f.mod_time.seconds * 10**9 + f.mod_time.nanos for f in some], [f.sha256 for f in some]]
                    yield pa.RecordBatch.from_arrays([*keys, *[pa.array(x, t) for x, t in zip(own, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)]], schema.names)

    return messages.mapInArrow(run, schema)


def heads(messages: DataFrame) -> DataFrame:
    """``messages(volume_id, content, ...)`` without content, with image_sha256 and layers."""
    ship(messages.sparkSession)
    others = [c for c in messages.columns if c != "content"]
    schema = messages.select(*others, F.lit("").alias("image_sha256"), F.array(F.lit("")).alias("layers")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_parsed(c or b"") for c in batch.column(batch.schema.names.index("content")).to_pylist()]
            new = [pa.array([m.image_sha256 for m in found], pa.string()), pa.array([list(m.layers) for m in found], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in others], *new], schema.names)

    return messages.mapInArrow(run, schema)


def encode(manifest: DataFrame, piece: int = PIECE) -> DataFrame:
    """(volume_id, version, part, content): each version's files by path in pieces of its message."""
    ship(manifest.sparkSession)
    placed = running(manifest, ("volume_id", "version"), [F.col("path")], "__i").withColumn("part", F.floor(F.col("__i") / piece))

    def write(pdf):
        message = _message()()
        for r in pdf.sort_values("i").itertuples(index=False):
            f = message.files.add(path=r.path, mode=int(r.mode), size=int(r.size), sha256=r.sha256)
            f.mod_time.seconds, f.mod_time.nanos = divmod(int(r.mod_time_ns), 10**9)
        return pdf.iloc[:1][["volume_id", "version", "part"]].assign(content=message.SerializeToString(deterministic=True))

    rows = placed.withColumnRenamed("__i", "i").select("volume_id", "version", "part", "i", "path", "mode", "size", "mod_time_ns", "sha256")
    return rows.groupBy("volume_id", "version", "part").applyInPandas(write, "volume_id string, version bigint, part bigint, content binary")
