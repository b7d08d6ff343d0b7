"""Near-duplicate embeddings by E8 lattice hashing.

Unit vectors are projected to eight dimensions, once per table, and decoded to the nearest point of
the E8 lattice; a vector goes to its own cell and to its nearest neighbouring cells. Vectors of one
label that meet in a cell are compared by cosine in double precision, in blocks of bounded size.
A block gives a spanning forest of its links, not all pairs, and for each vector the number of its
links; a pair counts in the first cell (the least hash) that both vectors go to, so once, wherever
else it meets. Work and rows grow with what shares a cell, not with what a chain of links joins.

Equal vectors of one label are one node with a count from the start, so copies cost one row.

Defined results: a null label, and a vector that is null, empty, zero or holds null or non-finite
components, link with nothing: no links, a component of its own (also where rows repeat). Vectors
of different lengths do not link. Null vec_ids have components of null only if all members have.
Repeated rows are other vectors to each other. Other columns pass; result names are replaced.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.durable import discard, materialize
from ..ship import ship
from .common import checked_broadcast, components, groups, mix, trimmed

COSINE = 0.98
#: Tables; neighbouring cells that a vector goes to in each; width of a lattice unit.
TABLES, PROBES, WIDTH = 6, 4, 0.8
#: Vectors on either side of a block.
BLOCK = 256
SEED = 8
_U = np.uint64


def _roots() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    pairs = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1, -1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            pairs.append(v)
    halves = [np.array(s) / 2 for s in itertools.product((1, -1), repeat=8) if s.count(-1) % 2 == 0]
    return np.array(pairs + halves)


ROOTS = _roots()


def _even(x: np.ndarray) -> np.ndarray:
    """Nearest integer points of even sum."""
    near = np.rint(x)
    off = x - near
    odd = np.flatnonzero(near.sum(axis=1) % 2)
    worst = np.abs(off[odd]).argmax(axis=1)
    near[odd, worst] += np.where(off[odd, worst] < 0, -1, 1)
    return near


def decode(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8 (even integer points and those shifted by a half)."""
    whole, half = _even(x), _even(x - 0.5) + 0.5
    nearer = ((x - half) ** 2).sum(axis=1) < ((x - whole) ** 2).sum(axis=1)
    return np.where(nearer[:, None], half, whole)


def cells(unit: np.ndarray, tables: int = TABLES, probes: int = PROBES, width: float = WIDTH, seed: int = SEED) -> np.ndarray:
    """Cell hashes [n, tables, 1 + probes] of unit vectors, the own cell first."""
    out = np.zeros((len(unit), tables, 1 + probes), _U)
    for t in range(tables):
        draw = np.random.default_rng((seed, t, unit.shape[1]))
        x = unit @ draw.normal(size=(unit.shape[1], 8)) / width + draw.random(8)
        point = decode(x)
        # The neighbours nearest to x are those whose direction goes along with what is left of x.
        along = np.argpartition(-(x - point) @ ROOTS.T, probes, axis=1)[:, :probes] if probes else np.zeros((len(x), 0), int)
        for k in range(1 + probes):
            at = point if k == 0 else point + ROOTS[along[:, k - 1]]
            h = np.full(len(x), t + 1, _U)
            for j in range(8):
                h = mix(h ^ (at[:, j] * 2).astype(np.int64).view(_U) * _U(0x9E3779B97F4A7C15))
            out[:, t, k] = h
    return out


def _unit(vectors: list) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, labels, vectors = (c.to_pylist() for c in batch.columns)
        sizes = np.array([len(v) for v in vectors], int)
        for d in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == d)
            for own in np.array_split(at, len(at) // 4000 + 1):
                found = cells(_unit([vectors[i] for i in own]))
                salt = mix(np.array([labels[i] for i in own], np.int64).view(_U) * _U(31) + _U(d))
                found = mix(found ^ salt[:, None, None]).reshape(len(own), -1).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in own]), pa.array(list(found), pa.list_(pa.int64()))], ["key", "cells"])


def _sides(rows: list[tuple]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of either side of a block pair (group, lo, hi, block, ...) by the length of their vectors
    (of which a cell holds one but for collisions of hashes); one block meets itself."""
    group = rows[0]
    block, size = np.array([r[3] for r in rows]), np.array([len(r[5]) for r in rows])
    for d in np.unique(size).tolist():
        left = np.flatnonzero((block == group[1]) & (size == d))
        yield left, (left if group[1] == group[2] else np.flatnonzero((block == group[2]) & (size == d)))


def _spanning(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, j) between n nodes, as few as connect what all of them connect."""
    root = np.arange(n)
    a, b = [], []
    while len(i):  # each turn hooks every tree to the least one that it touches
        ri, rj = root[i], root[j]
        apart = ri != rj
        i, j, ri, rj = i[apart], j[apart], ri[apart], rj[apart]
        if not len(i):
            break
        high, low = np.maximum(ri, rj), np.minimum(ri, rj)
        order = np.lexsort((low, high))
        first = order[np.concatenate(([True], high[order][1:] != high[order][:-1]))]
        a.append(i[first])
        b.append(j[first])
        root[high[first]] = low[first]
        while (root[root] != root).any():
            root = root[root]
        # every member points to a row that is a root of this turn
    none = np.zeros(0, int)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def _met_before(cell: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs of rows of two tables of cells share a cell before ``cell``."""
    out = np.zeros(len(a), bool)
    for k in range(0, len(a), 20_000):
        x, y = a[k : k + 20_000], b[k : k + 20_000]
        for c in range(a.shape[1]):
            out[k : k + 20_000] |= (x[:, c] < cell) & (y == x[:, c : c + 1]).any(axis=1)
    return out


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each block its links (a, b) that span what they connect, and (a, links): how many links a
    vector has by pairs that meet here first."""
    for rows in groups(batches, 3):
        group = rows[0]
        for left, right in _sides(rows):
            if not len(left) or not len(right):
                continue
            unit = _unit([rows[i][5] for i in left])
            labels = np.array([r[6] for r in rows])
            other = unit if left is right else _unit([rows[i][5] for i in right])
            linked = (unit @ other.T >= COSINE) & (labels[left][:, None] == labels[right][None, :])
            if left is right:
                linked = np.triu(linked, 1)
            i, j = np.nonzero(linked)
            i, j = left[i], right[j]
            a, b = _spanning(i, j, len(rows))
            cells_ = np.stack([r[8] for r in rows])
            new = ~_met_before(group[0], cells_[i], cells_[j])
            n = np.array([r[7] for r in rows], np.int64)
            counts = np.zeros(len(rows), np.int64)
            np.add.at(counts, i[new], n[j[new]])
            np.add.at(counts, j[new], n[i[new]])
            some = np.flatnonzero(counts)
            keys = [rows[k][4] for k in [*a.tolist(), *some.tolist()]]
            to = [rows[k][4] for k in b.tolist()] + [None] * len(some)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(to, pa.string()), pa.array([None] * len(a) + counts[some].tolist(), pa.int64())], ["a", "b", "links"])


def blocks(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """Members of each cell dealt to block pairs: those of a cell of n go to n / BLOCK of them each,
    so what is dealt for a cell grows with its pairs, divided by BLOCK."""
    parts = sizes.select("cell", F.ceil(F.col("n_in") / BLOCK).cast("int").alias("parts"))
    dealt = members.join(parts, "cell").withColumn("block", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return dealt.select("cell", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "key", "embedding", "label", "n", "cells")


def link_vectors(vectors: DataFrame) -> DataFrame:
    """``vectors(vec_id, embedding, label)`` with n_links, component_id and kept."""
    ship(vectors.sparkSession)
    vectors = vectors.drop("n_links", "component_id", "kept", "__key")
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    usable = F.col("label").isNotNull() & F.coalesce(F.forall("embedding", number) & F.exists("embedding", lambda x: x != 0), F.lit(False))
    hashed = F.concat_ws("-", F.hex(F.xxhash64("label", "embedding")), F.hex(F.xxhash64(F.lit(1), "embedding", "label")))
    keyed = vectors.withColumn("__key", F.when(usable, hashed))
    # Keys and counts first: only one vector of each key travels on.
    nodes = keyed.where("__key IS NOT NULL").groupBy(F.col("__key").alias("key")).agg(
        F.min("vec_id").alias("least"), F.count("*").alias("n"), F.first(F.col("label").cast("long")).alias("label"), F.first("embedding").alias("embedding")
    )
    nodes = materialize(nodes, "nodes")
    hashes = materialize(nodes.select("key", "label", "embedding").mapInArrow(trimmed(_hash), "key string, cells array<long>"), "cells")
    rows = hashes.select("key", F.explode(F.array_distinct("cells")).alias("cell"))
    shared = materialize(rows.groupBy("cell").agg(F.count("*").alias("n_in")).where("n_in > 1"), "shared")
    members = rows.join(checked_broadcast(shared.select("cell")), "cell").join(nodes.select("key", "embedding", "label", "n"), "key").join(hashes, "key")
    dealt = blocks(members, shared).repartition("cell", "lo", "hi").sortWithinPartitions("cell", "lo", "hi")
    found = materialize(dealt.mapInArrow(trimmed(_compare), "a string, b string, links long"), "links")
    discard(hashes, shared)
    roots = components(found.where("b IS NOT NULL").select("a", "b"))
    degrees = found.where("b IS NULL").groupBy(F.col("a").alias("key")).agg(F.sum("links").alias("links"))
    own = nodes.select("key", "least", "n").join(roots, F.col("key") == F.col("node"), "left")
    own = materialize(own.join(degrees, "key", "left").select("key", "least", "n", "root", F.coalesce("links", F.lit(0).cast("long")).alias("links")).where("root IS NOT NULL OR n > 1"), "linked")
    discard(found)
    names = own.where("root IS NOT NULL").groupBy("root").agg(F.min("least").alias("component"))
    some = own.where("root IS NOT NULL").join(checked_broadcast(materialize(names, "names")), "root").select("key", "component", (F.col("links") + F.col("n") - 1).alias("links"))
    copies = own.where("root IS NULL").select("key", F.col("least").alias("component"), (F.col("n") - 1).alias("links"))
    known = checked_broadcast(materialize(some.unionByName(copies).toDF("__k", "__c", "__l"), "found"))
    out = keyed.join(known, F.col("__key") == F.col("__k"), "left")
    out = out.withColumns({"n_links": F.coalesce("__l", F.lit(0).cast("long")), "component_id": F.when(F.col("__k").isNotNull(), F.col("__c")).otherwise(F.col("vec_id"))})
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))).drop("__key", "__k", "__c", "__l")


def query(spark, sf_dir: str) -> DataFrame:
    return link_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).select("vec_id", "n_links", "component_id", "kept")


SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL),
n AS (SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS z FROM v),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE a.z > 0 AND b.z > 0 AND list_dot_product(a.e, b.e) / (a.z * b.z) >= 0.98),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS m FROM r GROUP BY a),
d AS (SELECT a, count(*) AS k FROM l GROUP BY a)
SELECT e.vec_id, CAST(coalesce(k, 0) AS BIGINT) AS n_links, c.m AS component_id, e.vec_id = c.m AS kept
FROM embeddings e JOIN c ON e.vec_id = c.a LEFT JOIN d ON e.vec_id = d.a
"""
