"""Tables of images are read a few images at a time."""

from pathlib import Path

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from snapweave.plans import durable, queries


def _row_groups(table):
    files = [pq.ParquetFile(p).metadata for p in Path(table._written.removeprefix("file:")).glob("*.parquet")]
    return [m.row_group(g) for m in files for g in range(m.num_row_groups)]


def _read_at_once(table):
    """Most rows of a written table that Spark's reader takes at once: those of a row group."""
    return max(g.num_rows for g in _row_groups(table))


def _held(table):
    """Row groups whose least and greatest content the writer held until its file ended."""
    return sum(g.column(c).is_stats_set for g in _row_groups(table) for c in range(g.num_columns) if g.column(c).path_in_schema == "content")


def test_images_on_read_are_read_few_at_once(spark, tmp_path, monkeypatch):
    """Placeholders compress to next to nothing, so that one row group would hold any number of images."""
    monkeypatch.setattr(queries, "IMAGE_BLOCKS", 1)
    text = F.when(F.col("id") % 3 == 0, F.repeat(F.lit("b"), (2000 + F.col("id")).cast("int"))).otherwise(F.concat(F.lit("a"), F.col("id").cast("string")))
    docs = spark.range(120).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"), F.lit("src1").alias("source"))
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    made = []
    durable._scopes.append(made)
    try:
        got = queries.image_on_read(spark, str(tmp_path)).collect()
    finally:
        durable._scopes.remove(made)
    want = {(f"en-{r.doc_id}", 1, len(r.text), len(r.text) >= 1000, r.sha if len(r.text) < 1000 else None) for r in docs.withColumn("sha", F.sha2("text", 256)).collect()}
    assert {tuple(r) for r in got} == want and len(got) == 120
    images = [t for t in made if "/images-" in t.__dict__.get("_written", "")]
    assert len(images) == 1 and images[0].count() == 120
    assert _read_at_once(images[0]) <= 8
    assert _held(images[0]) == 0
