"""Schemas of the tables that the operators exchange."""

from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "boolean": T.BooleanType(), "binary": T.BinaryType(),
    "timestamp": T.TimestampType(), "strings": T.ArrayType(T.StringType()),
}


def _table(**columns: str) -> T.StructType:
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in columns.items()])


SNAPSHOTS = _table(volume_id="string", version="long", image_sha256="string", layers="strings")
MANIFEST = _table(volume_id="string", version="long", path="string", mode="long", size="long", mod_time_ns="long", sha256="string")
DELTA = _table(volume_id="string", path="string", kind="string", mode="long", size="long", mod_time_ns="long", sha256="string")
BLOBS = _table(sha256="string", size="long", content="binary")
CHUNKS = _table(sha256="string", chunk_idx="int", offset="long", content="binary")
NODES = _table(image="string", nid="long", parent_nid="long", name="string", path="string", is_dir="boolean", mode="int", size="long", uid="long", gid="long", mtime="long")
VIOLATIONS = _table(image="string", code="string", nid="long", message="string")
ACCESS = _table(ts="timestamp", event_id="long", pid="int", path="string", mask="long")
OPLOG = _table(file_id="long", ts="timestamp", event_id="long", op="string", arg="string")

# Kinds of a delta's rows, and codes of violations.
FILE, DIR, WHITEOUT, OPAQUE = "file", "dir", "whiteout", "opaque"
CODES = ("InvalidSuperblock", "InvalidInode", "InvalidDirectoryBlock", "PathTraversal", "CycleDetected", "MaxDepthExceeded", "Unknown")
