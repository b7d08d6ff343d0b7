"""Line dedup by overlapping windows of three lines, on DataFrame functions only.

A window is three consecutive lines of a text, each without spaces, tabs and carriage returns at
its ends; windows of three blank lines do not count. The first occurrence of a window in the
order of (doc_id, text hash, line) stays; every other one covers its three lines, and the union
of what is covered goes.

All windows are hashed to 128 bits. One map-side combined aggregation finds the repeated hashes
and their first places; only those are written, and a join back finds the later places: so a
window that a third of all documents hold is one row of that table, and Spark can split the
other side. The documents join with the covered spans (broadcast only after a count).

Defined results: null text stays null, an empty text and one of fewer than three lines stay as
they are. Null doc_id comes last in the order. Rows equal in doc_id and text count as one place:
all keep or lose the same lines. Other columns pass through; columns named n_lines or n_removed
are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..plans.durable import materialize
from .common import checked_broadcast

#: Lines of a window.
LINES = 3


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def windows(docs: DataFrame) -> DataFrame:
    """(doc_id, th, pos, h1, h2): the windows of all texts; pos counts lines from 1."""
    hashed = docs.where("text IS NOT NULL").select(
        "doc_id",
        F.xxhash64("text").alias("th"),
        F.transform(_lines(F.col("text")), lambda line: F.xxhash64(F.btrim(line, F.lit(" \t\r")))).alias("hl"),
    )
    own = [F.element_at("hl", F.col("pos") + k) for k in range(LINES)]
    rows = (
        hashed.where(F.size("hl") >= LINES)
        .select("doc_id", "th", "hl", F.explode(F.expr(f"sequence(1, size(hl) - {LINES - 1})")).alias("pos"))
        .select("doc_id", "th", "pos", *[x.alias(f"l{k}") for k, x in enumerate(own)])
    )
    blank = F.xxhash64(F.lit(""))
    return rows.where(~((F.col("l0") == blank) & (F.col("l1") == blank) & (F.col("l2") == blank))).select(
        "doc_id", "th", "pos", F.xxhash64("l0", "l1", "l2").alias("h1"), F.xxhash64("l2", "l0", "l1", F.lit(1)).alias("h2")
    )


def _place() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "th", "pos")


def covered(docs: DataFrame) -> DataFrame:
    """(doc_id, th, gone): for each text that loses lines, the merged spans [s, e) of them."""
    found = windows(docs)
    repeated = materialize(
        found.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(_place()).alias("first")).where("n > 1").drop("n"), "windows"
    )
    later = found.join(checked_broadcast(repeated), ["h1", "h2"]).where(~_place().eqNullSafe(F.col("first")))
    later = later.select("doc_id", "th", "pos").distinct()
    row = W.partitionBy("doc_id", "th").orderBy("pos")
    gap = F.coalesce((F.col("pos") > F.lag("pos").over(row) + LINES).cast("int"), F.lit(1))
    spans = (
        later.withColumn("gap", gap)
        .withColumn("island", F.sum("gap").over(row))
        .groupBy("doc_id", "th", "island")
        .agg(F.min("pos").alias("s"), (F.max("pos") + LINES).alias("e"))
    )
    return spans.groupBy("doc_id", "th").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("gone"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with later occurrences of repeated windows taken from ``text``, and with the
    number of lines before (n_lines) and of lines taken (n_removed)."""
    docs = docs.drop("n_lines", "n_removed")
    gone = materialize(covered(docs.select("doc_id", "text")), "covered")
    # Rows hold arrays, so the check counts rows and spans.
    rows = gone.agg(F.coalesce(F.sum(F.size("gone") + 1), F.lit(0))).first()[0]
    gone = checked_broadcast(gone.select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), F.col("gone").alias("__gone")), rows)
    joined = docs.join(gone, docs["doc_id"].eqNullSafe(gone["__id"]) & (F.xxhash64(docs["text"]) == gone["__th"]), "left")
    lines = _lines(F.col("text"))
    n = F.size(lines)
    starts = F.concat(F.array(F.lit(1)), F.transform("__gone", lambda x: x["e"].cast("int")))
    ends = F.concat(F.transform("__gone", lambda x: x["s"].cast("int")), F.array(n + 1))
    kept = F.flatten(F.zip_with(starts, ends, lambda a, b: F.slice(lines, a, b - a)))
    removed = F.aggregate("__gone", F.lit(0).cast("long"), lambda acc, x: acc + x["e"] - x["s"])
    touched = F.col("__gone").isNotNull()
    out = joined.withColumns(
        {
            "n_lines": F.when(F.col("text").isNull(), F.lit(0)).otherwise(n).cast("long"),
            "n_removed": F.when(touched, removed).otherwise(F.lit(0)).cast("long"),
            "text": F.when(touched, F.array_join(kept, "\n")).otherwise(F.col("text")),
        }
    )
    return out.drop("__id", "__th", "__gone")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", "text")


SQL = r"""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
x AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS q FROM l),
t AS (SELECT doc_id, q, line, trim(line, ' ' || chr(9) || chr(13)) AS k FROM x),
w AS (
  SELECT doc_id, q, k || chr(10) || lead(k, 1) OVER o || chr(10) || lead(k, 2) OVER o AS win
  FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY q)),
r AS (
  SELECT doc_id, q, row_number() OVER (PARTITION BY win ORDER BY doc_id, q) AS n
  FROM w WHERE win IS NOT NULL AND win <> chr(10) || chr(10)),
c AS (SELECT DISTINCT doc_id, q + s AS q FROM r, (SELECT unnest(range(0, 3)) AS s) WHERE n > 1),
k AS (
  SELECT t.doc_id, count(*) AS n_lines, count(c.q) AS n_removed,
         string_agg(CASE WHEN c.q IS NULL THEN t.line END, chr(10) ORDER BY t.q) AS text
  FROM t LEFT JOIN c ON t.doc_id = c.doc_id AND t.q = c.q GROUP BY t.doc_id)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CASE WHEN d.text IS NOT NULL THEN coalesce(k.text, '') END AS text
FROM documents d LEFT JOIN k USING (doc_id)
"""
