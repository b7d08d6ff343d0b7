"""Mixing sources to target weights by fitting word budgets.

Sizes are counted in words. Each source gets a target from its weight; targets stop at a multiple
of the source's size and the excess goes to the others by weight. What a target holds beyond whole
passes over its source is a budget: documents are counted by exact length, long budgets are first
filled in proportion to those counts, the rest is fitted by bounded-knapsack dynamic programming
over the lengths that remain, and of each length the wanted number is drawn by a seeded hash.

Only counts meet in one place: a group of the fit holds one row per distinct length of a source.
A length that very many documents share is drawn through hash ranges of about the root of their number each,
so no source and no length lands in one task. Words of texts are counted once into a narrow table of
sizes and draws, on which all planning works; only where the result keeps the texts are they read, and
counted, once more. Weights and levels come from distributed aggregates
over the sources; sources are numbered by range partitions, not in one task.

Defined results: null text has size 0; null source is a source of its own and comes last. Rows
equal in doc_id and text draw the same number, so they are all in or all out. Documents of size 0
are taken as often as whole passes go. No documents give no rows. Other columns pass; columns
named like a result are replaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..plans.durable import discard, materialize
from ..ship import ship
from .common import checked_broadcast

#: Weights of the sources in their order, repeating.
WEIGHTS = (3, 1, 2)
#: All targets together, as a multiple of all sizes; and the most a source is repeated.
SHARE, MOST = 1.5, 2.0
SEED = 17
#: Words of a budget that the knapsack fits; what is beyond is filled in proportion.
KNAPSACK_WORDS = 65_536
#: Documents of one length are ranked in hash ranges of so many rows, or of the root of their number.
RANGE_ROWS = 64
ADDED = ("size", "source_size", "target", "copies", "taken")


def size_of(text: Column) -> Column:
    """Number of words of a text."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(totals: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from ``totals(source, source_size)``."""
    spark = totals.sparkSession
    order = [F.col("source").isNull().asc(), F.col("source").asc()]
    ranged = totals.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = materialize(
        ranged.select("source", "source_size", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("row")), "sources"
    )
    begin, rows = 0, []
    for part, n in sorted((r[0], r[1]) for r in numbered.groupBy("part").count().collect()):  # a row for each partition
        rows.append((part, begin))
        begin += n
    starts = spark.createDataFrame(rows, "part int, begin long")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("begin") + F.col("row")) % len(weights) + 1).cast("int"))
    weighted = numbered.join(F.broadcast(starts), "part").select("source", "source_size", w.alias("w"), (F.col("source_size") * most).alias("cap"))
    all_words, all_weight = weighted.agg(F.sum("source_size"), F.sum("w")).first()
    level, n_capped = (share * (all_words or 0)) / (all_weight or 1.0), 0
    while True:  # the level only rises; each turn caps more sources or ends
        capped = weighted.where(F.col("cap") <= F.col("w") * level).agg(F.count("*"), F.sum("cap"), F.sum("w")).first()
        if capped[0] == n_capped or capped[2] == all_weight:
            break
        n_capped, level = capped[0], (share * all_words - capped[1]) / (all_weight - capped[2])
    return weighted.select("source", "source_size", F.least("cap", F.col("w") * level).alias("target"))


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, seed: int = SEED, window: int = KNAPSACK_WORDS) -> np.ndarray:
    """How many items of each length to take so that their sum comes nearest to ``budget``."""
    take = np.zeros(len(lengths), np.int64)
    total = int((lengths * counts).sum())
    if budget <= 0 or total <= 0:
        return take
    if budget >= total:
        return counts.astype(np.int64)
    share, carry = max(0, budget - window) / total, 0.0
    for i in np.argsort(-lengths, kind="stable") if share else ():
        if lengths[i] > 0:
            want = share * counts[i] * lengths[i] + carry
            take[i] = min(counts[i], int(want // lengths[i]))
            carry = want - float(take[i]) * float(lengths[i])
    left = budget - int((take * lengths).sum())
    # by[s]: the piece that first reached the sum s; pieces of doubling counts bound each length.
    by = np.full(2 * left + 1, -1, np.int32)
    by[0] = -2
    pieces: list[tuple[int, int]] = []
    for i in np.random.default_rng(seed).permutation(len(lengths)):
        length = int(lengths[i])
        if not 0 < length <= 2 * left:
            continue
        have, piece = min(int(counts[i] - take[i]), 2 * left // length), 1
        while have > 0:
            n = min(piece, have)
            have, piece = have - n, piece * 2
            step = n * length
            new = np.flatnonzero((by[:-step] != -1) & (by[step:] == -1)) + step
            by[new] = len(pieces)
            pieces.append((i, n))
        if by[left] != -1:
            break
    sums = np.flatnonzero(by != -1)
    at = int(sums[np.argmin(np.abs(sums - left))])
    while at:
        i, n = pieces[by[at]]
        take[i] += n
        at -= n * int(lengths[i])
    return take


def _plan(pdf: pd.DataFrame, most: float, seed: int) -> pd.DataFrame:
    size, target = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
    passes = 0 if size == 0 else min(int(most), int(target // size))
    budget = int(target - passes * size + 0.5)
    extra = fit(pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64), budget, seed)
    return pd.DataFrame({"source": pdf["source"], "size": pdf["size"], "n": pdf["n"], "source_size": size, "target": target, "passes": passes, "extra": extra})


def _same(left: DataFrame, right: DataFrame, *more: str) -> Column:
    on = left["source"].eqNullSafe(right["source"]) & (left["size"] == right["size"])
    for c in more:
        on &= left[c] == right[c]
    return on


def _sized(docs: DataFrame, seed: int) -> DataFrame:
    """``docs`` with size and draw, a seeded number of each (doc_id, text)."""
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")), 1)
    return docs.withColumns({"size": size_of(F.col("text")), "__draw": draw})


def _planned(thin: DataFrame, weights: tuple, share: float, most: float, seed: int) -> DataFrame:
    """For each source and size of ``thin(source, size, __draw)`` what the mix takes of it."""
    counts = materialize(thin.groupBy("source", "size").agg(F.count("*").alias("n")), "lengths")
    totals = counts.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    goal = targets(totals, weights, share, most)
    both = counts.join(checked_broadcast(goal.withColumnRenamed("source", "s"), limit=100_000), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    plan = both.groupBy("source").applyInPandas(
        lambda pdf: _plan(pdf, most, seed), "source string, size long, n long, source_size long, target double, passes long, extra long"
    )
    plan = materialize(plan, "plan")
    # The greatest number drawn of the `extra` least ones of each length, through ranges of them.
    n_ranges = F.ceil(F.col("n") / F.greatest(F.lit(float(RANGE_ROWS)), F.sqrt("n")))
    some = checked_broadcast(plan.where("extra > 0 AND extra < n").select("source", "size", "extra", n_ranges.alias("parts")), limit=100_000)
    of = thin.join(some, _same(thin, some)).select(
        thin["source"], thin["size"], F.col("__draw").alias("draw"), "extra", F.least(F.col("parts") - 1, F.floor(F.col("__draw") / float(1 << 63) * F.col("parts"))).alias("range")
    )
    of_length = W.partitionBy("source", "size").orderBy("range")
    before = of.groupBy("source", "size", "range", "extra").agg(F.count("*").alias("k"))
    before = before.withColumn("before", F.sum("k").over(of_length) - F.col("k")).where("before < extra AND before + k >= extra")
    cut_in = checked_broadcast(materialize(before.select("source", "size", "range", "before"), "ranges"), limit=100_000)
    in_range = W.partitionBy("source", "size", "range").orderBy("draw")
    cut = of.join(cut_in, _same(of, cut_in, "range")).select(of["source"], of["size"], of["range"], "draw", "extra", "before")
    cut = cut.withColumn("rank", F.row_number().over(in_range) + F.col("before")).where("rank = extra").select("source", "size", F.col("draw").alias("cut"))
    whole = plan.join(cut, _same(plan, cut), "left").select(
        plan["source"].alias("__s"), plan["size"].alias("__z"), "source_size", "target", *[F.col(c).alias(f"__{c}") for c in ("n", "passes", "extra", "cut")]
    )
    whole = materialize(whole, "plan")
    discard(counts, plan)
    return checked_broadcast(whole, limit=100_000)


def _taken(sized: DataFrame, whole: DataFrame, *columns: str) -> DataFrame:
    """``columns`` of ``sized(source, size, __draw, ...)`` with the results, by a plan."""
    out = sized.join(whole, sized["source"].eqNullSafe(whole["__s"]) & (sized["size"] == whole["__z"]))
    drawn = (F.col("__extra") > 0) & ((F.col("__extra") >= F.col("__n")) | F.coalesce(F.col("__draw") <= F.col("__cut"), F.lit(False)))
    out = out.withColumn("copies", F.col("__passes") + drawn.cast("long"))
    out = out.withColumn("taken", F.col("copies") * F.col("size"))
    return out.select(*[F.col(f"`{c}`") for c in columns], *ADDED)


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED) -> DataFrame:
    """All documents with size, source_size, target (its source's), copies and taken (words)."""
    ship(docs.sparkSession)
    docs = docs.drop(*ADDED)
    sized = _sized(docs, seed)
    thin = materialize(sized.select("source", "size", "__draw"), "sizes")
    return _taken(sized, _planned(thin, weights, share, most, seed), *docs.columns)


def mix_ids(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED) -> DataFrame:
    """As ``mix``, but of the documents only doc_id and source; texts are read once."""
    ship(docs.sparkSession)
    thin = materialize(_sized(docs.select("doc_id", "text", "source"), seed).drop("text"), "sizes")
    return _taken(thin, _planned(thin, weights, share, most, seed), "doc_id", "source")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix_ids(docs).select("doc_id", "size", "source_size", "target", "taken")
