"""Intermediate tables that survive lost executors, and that go when they are no longer read."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_scopes: list[list[DataFrame]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only on one machine (a local master), where the session names none, a temporary folder is set;
    a cluster without such a folder is an error."""
    sc = spark.sparkContext
    path = sc._jsc.sc().getCheckpointDir()
    if path.isDefined():
        return path.get()
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if conf is None and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    sc.setCheckpointDir(conf or tempfile.mkdtemp(prefix="tables-"))
    return sc._jsc.sc().getCheckpointDir().get()


#: Rows of a row group where each row is a value of many bytes, as an image is.
WIDE_ROWS = 4


def materialize(df: DataFrame, name: str, wide: bool = False) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts the lineage, survives lost executors and gives the optimizer the real size. Spark's reader
    holds up to 4,096 rows of a row group at once, however large they are, and a row group is bounded by
    its compressed bytes alone: ``wide`` rows come in row groups of WIDE_ROWS, without statistics, since the
    writer would hold the least and the greatest value of each row group until a file ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    options = {"parquet.block.row.count.limit": WIDE_ROWS, "parquet.column.statistics.enabled": False} if wide else {}
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    for made in _scopes:
        made.append(out)
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete written tables that nothing reads any more; others are left alone."""
    for table in tables:
        path = table.__dict__.pop("_written", None) if table is not None else None
        if path is not None:
            spark = table.sparkSession
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextlib.contextmanager
def scope() -> Iterator[list[DataFrame]]:
    """The tables written inside are deleted at the end, but for those taken out of the list."""
    made: list[DataFrame] = []
    _scopes.append(made)
    try:
        yield made
    finally:
        _scopes.pop()
        discard(*made)


def keep(made: list[DataFrame], table: DataFrame) -> DataFrame:
    """Take one table out of a scope's list."""
    made[:] = [m for m in made if m is not table]
    return table
