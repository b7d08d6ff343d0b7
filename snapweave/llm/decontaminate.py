"""Benchmark decontamination over suffix arrays.

The documents of a task are cut into shards. Their words become numbers of the benchmark's
vocabulary; runs of words that are all known, long enough for a window, are kept, and all their
suffixes are sorted by prefix doubling: the shard's suffix array. The benchmark's suffixes are ranked
along with them, so each is found in the array by a binary search over ranks, and the ranks by 1, 2,
4, ... words give the words that two suffixes share. A suffix that shares a window with its neighbour
in the array stands for the whole range of places that share it; these places are hit. Each place
gets its longest verbatim match from its neighbours among the benchmark's suffixes: one match for
each place, left out where the match of the place before covers it. So the output of a text is linear
in its words, however often they repeat.

The benchmark goes to the tasks in blocks of at most ``BLOCK_BYTES`` of text and one item more. A
block is one pass over the documents without a shuffle of them, and one block is in a task at a
time: a task's arrays take about 60 bytes for each word of a shard and of a block. Blocks beyond the
first give narrow tables of what they found, which are joined to the documents by a text's hash.

Defined results: null and empty texts (documents or items) have no words and match nothing. An item
of fewer words than the window counts as one window. Repeated items of one id count once; items of
null id mark words as hit but are not listed. Documents keep every row, repeated ones and those of
null doc_id too, and their columns; in ``find_matches`` and ``report``, columns named like a result
(n_words, items, matches; n_hit, contaminated) are replaced. No items: nothing is hit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.durable import materialize
from ..plans.ordered import running
from ..ship import ship
from .common import FOLD, checked_broadcast, set_aside, slices, trimmed

#: Words of a window.
WINDOW = 10
#: Bytes of benchmark text that go to the tasks at once, and one item more.
BLOCK_BYTES = 4_000_000
#: Characters of document text in one shard, or one longer document.
SHARD_CHARS = 4_000_000
#: Pairs of a shard's documents and items that are listed at once.
_PAIRS = 2_000_000


def words(text: str | None) -> list[bytes]:
    """Words of a text: A-Z lower-cased, runs of ASCII letters, digits and non-ASCII characters."""
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split() if text else []


class Block:
    """Items of the benchmark as numbers of their vocabulary (from 1), one after another, each with
    a 0 behind it."""

    def __init__(self, items: list[tuple[object, str]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        own = [(i, [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(t)]) for i, t in items]
        own = [(i, ws) for i, ws in own if ws]
        self.ids = [i for i, _ in own]
        length = np.array([len(ws) for _, ws in own], np.int64)
        self.begin = np.cumsum(length + 1) - length - 1
        self.tokens = np.zeros(int((length + 1).sum()), np.int32)
        for b, (_, ws) in zip(self.begin.tolist(), own, strict=True):
            self.tokens[b : b + len(ws)] = ws
        self.item = np.repeat(np.arange(len(own)), length + 1)
        left = np.repeat(self.begin + length, length + 1) - np.arange(len(self.tokens))
        need = np.repeat(np.minimum(length, window), length + 1)
        #: By size of a window, the places of suffixes that begin with one.
        self.suffixes = {s: np.flatnonzero((need == s) & (left >= s)) for s in np.unique(need).tolist()}
        self.least, self.longest = min(self.suffixes, default=1), int(length.max(initial=0))


class Suffixes:
    """Suffixes of some numbers, sorted by at least their first ``depth`` numbers (prefix doubling;
    only suffixes that are still equal are sorted again). 0 ends a suffix."""

    def __init__(self, tokens: np.ndarray, depth: int):
        ends = tokens == 0
        n_ends = int(ends.sum())
        values = tokens + (n_ends - 1)
        values[ends] = np.arange(n_ends)  # every end is another one, so no match goes beyond it
        self.order = np.argsort(values, kind="stable").astype(np.int32)
        sorted_ = values[self.order]
        first = np.ones(len(values), bool)
        first[1:] = sorted_[1:] != sorted_[:-1]
        slots = np.arange(len(values), dtype=np.int32)
        start = np.maximum.accumulate(np.where(first, slots, 0))
        rank = np.empty_like(start)
        rank[self.order] = start
        #: (number of words, rank of each suffix by that many words).
        self.levels = [(1, rank)]
        h = 1
        while h < depth:
            equal = np.flatnonzero(~(first & np.append(first[1:], True)))
            if not len(equal):
                break
            at, group = self.order[equal], start[equal]
            after = rank[np.minimum(at + h, len(values) - 1)]
            by = np.argsort((group.astype(np.int64) << 32) | after, kind="stable")
            at, after = at[by], after[by]
            self.order[equal] = at
            new = np.ones(len(equal), bool)
            new[1:] = (group[1:] != group[:-1]) | (after[1:] != after[:-1])
            first[equal] = new
            start[equal] = np.maximum.accumulate(np.where(new, equal, 0))
            rank = rank.copy()
            rank[at] = start[equal]
            h *= 2
            self.levels.append((h, rank))
        self.rank = rank

    def shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that suffixes at other places begin with alike (exact up to the depth)."""
        a, b, n = a.astype(np.int64), b.astype(np.int64), np.zeros(len(a), np.int64)
        last = len(self.order) - 1
        for h, rank in reversed(self.levels):
            alike = rank[np.minimum(a + n, last)] == rank[np.minimum(b + n, last)]
            n += h * alike
        return n


def _neighbours(found: Suffixes, at: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix the number of the one of ``among`` (in sorted order) that shares most words with
    it, found by binary search, and how many they are."""
    ranks = found.rank[among]
    place = np.searchsorted(ranks, found.rank[at])
    low, high = np.maximum(place - 1, 0), np.minimum(place, len(among) - 1)
    n_low, n_high = found.shared(at, among[low]), found.shared(at, among[high])
    return np.where(n_low > n_high, low, high), np.maximum(n_low, n_high)


def _listed(group_item: np.ndarray, group_doc: np.ndarray, n_items: int, n_docs: int) -> np.ndarray:
    """Codes (document, item) of all pairs that meet in a group; both inputs are sorted codes."""
    groups = group_item // n_items
    own = group_doc // n_docs
    first = np.searchsorted(groups, own, "left")
    count = np.searchsorted(groups, own, "right") - first
    out, begin = np.zeros(0, np.int64), 0
    ends = np.cumsum(count)
    while begin < len(own):
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + _PAIRS, "right")))
        k, f = count[begin:end], first[begin:end]
        at = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(f, k)
        doc = np.repeat(group_doc[begin:end] % n_docs, k)
        out = np.union1d(out, doc * n_items + group_item[at] % n_items)
        begin = end
    return out


def _shard(texts: list[str | None], block: Block) -> tuple[list[int], dict[int, list], dict[int, list]]:
    """Number of words of each text; of those that hold a window the item numbers, and the matches
    (item, item word, word, words), one at most for each word."""
    get = block.vocabulary.get
    each = [[get(w, 0) for w in words(t)] for t in texts]
    sizes = np.array([len(x) for x in each], np.int64)
    begin = np.cumsum(sizes + 1) - sizes - 1
    tokens = np.zeros(int(sizes.sum()) + len(each) + 1, np.int32)
    for b, x in zip(begin.tolist(), each, strict=True):
        tokens[b : b + len(x)] = x
    del each
    edge = np.flatnonzero(np.diff((tokens > 0).view(np.int8), prepend=0))
    start, length = edge[::2], edge[1::2] - edge[::2]
    start, length = start[length >= block.least], length[length >= block.least]
    if not len(start) or not block.ids:
        return sizes.tolist(), {}, {}
    # The kept runs, each with a 0 behind it, after the benchmark's words.
    place = np.repeat(start - np.cumsum(length + 1) + length + 1, length + 1) + np.arange((length + 1).sum())
    whole = np.concatenate([block.tokens, tokens[place]])
    whole[len(block.tokens) + np.cumsum(length + 1) - 1] = 0
    found = Suffixes(whole, block.longest)
    offset = len(block.tokens)
    array = found.order[(found.order >= offset) & (whole[found.order] > 0)]  # the shard's suffix array
    alike = found.shared(array[:-1], array[1:])
    best, item_at = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
    pairs = np.zeros(0, np.int64)
    n_items, n_docs = len(block.ids), len(texts)
    for size, suffixes in block.suffixes.items():
        entry, n = _neighbours(found, suffixes, array)
        hit = n >= size
        group = np.concatenate(([0], np.cumsum(alike < size)))
        groups = group[entry[hit]]
        is_hit = np.zeros(group[-1] + 1, bool)
        is_hit[groups] = True
        entries = np.flatnonzero(is_hit[group])
        if not len(entries):
            continue
        at = array[entries]
        doc = np.searchsorted(begin, place[at - offset], "right") - 1
        group_item = np.unique(groups * n_items + block.item[suffixes[hit]])
        pairs = np.union1d(pairs, _listed(group_item, np.unique(group[entries] * n_docs + doc), n_items, n_docs))
        ranked = suffixes[np.argsort(found.rank[suffixes], kind="stable")]
        nearest, n = _neighbours(found, at, ranked)
        longer = n > best[at - offset]
        best[at[longer] - offset] = n[longer]
        item_at[at[longer] - offset] = ranked[nearest[longer]]
    keep = np.flatnonzero((best > 0) & (best >= np.concatenate(([0], best[:-1]))))
    doc = np.searchsorted(begin, place[keep], "right") - 1
    rows = zip(doc.tolist(), block.item[item_at[keep]].tolist(), (item_at[keep] - block.begin[block.item[item_at[keep]]]).tolist(), (place[keep] - begin[doc]).tolist(), best[keep].tolist(), strict=True)
    matches: dict[int, list] = {}
    for d, item, q, p, n in rows:
        matches.setdefault(d, []).append((item, q, p, n))
    items: dict[int, list] = {}
    for d, item in zip((pairs // n_items).tolist(), (pairs % n_items).tolist(), strict=True):
        items.setdefault(d, []).append(item)
    return sizes.tolist(), items, matches


_MATCHES = "array<struct<item_id:{0},item_start:bigint,start:bigint,length:bigint>>"


def _results(texts: list[str | None], b: Block) -> tuple[list[int], list[list], list[list]]:
    """n_words, items and matches of each text."""
    n_words, items, matches = [], [], []
    for lo, hi in slices([len(t or "") for t in texts], SHARD_CHARS):
        n, listed, found = _shard(texts[lo:hi], b)
        n_words += n
        for d in range(hi - lo):
            items.append([str(b.ids[i]) for i in listed.get(d, ()) if b.ids[i] is not None])
            matches.append([{"item_id": b.ids[i], "item_start": q, "start": p, "length": m} for i, q, p, m in found.get(d, ())])
    return n_words, items, matches


def _first(block):
    """Every row with what the block finds in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _results(batch.column("text").to_pylist(), block.value)
            new = dict(zip(("n_words", "items", "matches"), found, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(new[f.name], f.type) if f.name in new else c for f, c in zip(batch.schema, batch.columns, strict=True)], schema=batch.schema)

    return run


def _further(block, kind: pa.DataType):
    """(key, items, matches) of the texts in which the block finds something."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, items, matches = _results(batch.column(1).to_pylist(), block.value)
            at = [i for i, m in enumerate(matches) if m]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int32())), pa.array([items[i] for i in at], pa.list_(pa.string())), pa.array([matches[i] for i in at], kind)], ["key", "items", "matches"]
            )

    return run


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple]]:
    """(item_id, text) rows in blocks of at most so many bytes and one item more."""
    items = benchmark.where("length(text) > 0").select("item_id", "text").distinct()
    items = materialize(items.withColumn("bytes", F.octet_length("text").cast("long")), "items")
    total = items.agg(F.sum("bytes")).first()[0] or 0
    if total <= block_bytes:
        yield [tuple(r) for r in items.select("item_id", "text").collect()]
        return
    placed = running(items.withColumn("all", F.lit(0)), "all", [F.xxhash64("item_id", "text")], "index", "before", F.col("bytes"))
    placed = materialize(placed.select("item_id", "text", F.floor(F.col("before") / block_bytes).alias("block")), "items")
    for k in range(placed.agg(F.max("block")).first()[0] + 1):
        yield [tuple(r) for r in placed.where(F.col("block") == k).select("item_id", "text").collect()]


def find_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with ``n_words``, ``items`` (array<string>: the ids of items with occurring windows) and
    ``matches``: the longest verbatim match of at least a window at each place, in words from 0."""
    spark = docs.sparkSession
    ship(spark)
    kind = _MATCHES.format(benchmark.schema["item_id"].dataType.simpleString())
    clash = [c for c in docs.columns if c in ("n_words", "items", "matches")]
    docs = docs.drop(*clash)
    empty = {"n_words": F.lit(0).cast("long"), "items": F.array().cast("array<string>"), "matches": F.array().cast(kind)}
    key = F.unhex(F.md5(F.col("text").cast("binary")))
    out, more = None, []
    for rows in _blocks(benchmark, block_bytes):
        shared = spark.sparkContext.broadcast(Block(sorted(rows, key=str), window))
        if out is None:
            wide = docs.withColumns(empty)
            out = wide.mapInArrow(trimmed(_first(shared)), wide.schema)
        else:
            part = docs.where("text IS NOT NULL").select(key.alias("key"), "text")
            schema = part.withColumns(empty).select("key", "items", "matches").schema
            row = pa.list_(pa.struct([("item_id", _arrow(benchmark)), ("item_start", pa.int64()), ("start", pa.int64()), ("length", pa.int64())]))
            more.append(materialize(part.mapInArrow(trimmed(_further(shared, row)), schema).dropDuplicates(["key"]), "matches"))
    if not more:
        return out
    every = more[0]
    for m in more[1:]:
        every = every.unionByName(m)
    merged = every.groupBy("key").agg(F.flatten(F.collect_list("items")).alias("__i"), F.flatten(F.collect_list("matches")).alias("__m"))
    merged = materialize(merged.withColumnRenamed("key", "__k"), "matches")
    n = merged.agg(F.coalesce(F.sum(F.size("__i") + F.size("__m") + 1), F.lit(0))).first()[0]
    both = out.join(checked_broadcast(merged, n), key == F.col("__k"), "left")
    items = F.array_distinct(F.concat("items", F.coalesce("__i", F.array().cast("array<string>"))))
    matches = F.concat("matches", F.coalesce("__m", F.array().cast(kind)))
    return both.withColumns({"items": items, "matches": matches}).drop("__k", "__i", "__m")


def _arrow(benchmark: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(benchmark.schema["item_id"].dataType)


def n_covered(matches: Column) -> Column:
    """Number of words under any match."""
    ends = F.array_sort(F.transform(matches, lambda m: F.struct(m["start"].alias("s"), (m["start"] + m["length"]).alias("e"))))
    return F.aggregate(
        ends,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")),
        lambda acc, x: F.struct(
            (acc["n"] + F.greatest(F.lit(0).cast("long"), x["e"] - F.greatest(x["s"], acc["to"]))).alias("n"),
            F.greatest(acc["to"], x["e"]).alias("to"),
        ),
        lambda acc: acc["n"],
    )


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``find_matches`` with n_hit, items sorted, and contaminated (some word is hit)."""
    found = find_matches(docs, benchmark, window)
    found = found.withColumns({"n_hit": n_covered(F.col("matches")), "items": F.array_sort(F.array_distinct("items"))})
    return found.withColumn("contaminated", F.col("n_hit") > 0)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents, with all their own columns and rows, that hold no window of the benchmark."""
    aside, own = set_aside(docs, "text")
    return find_matches(aside, benchmark, window).where(F.size("matches") == 0).select(*own)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = report(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[p:p + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM b WHERE len(w) > 0)),
dp AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d WHERE len(w) > 0),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, p, k, array_to_string(w[p:p + k - 1], ' ') AS win FROM dp, ks WHERE p + k - 1 <= len(w)),
hits AS (SELECT doc_id, p, dw.k, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.k = bw.k),
cov AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit
  FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM (SELECT DISTINCT doc_id, p, k FROM hits)) GROUP BY doc_id),
its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS s
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""
