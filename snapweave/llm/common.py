"""Helpers shared by the training-data operators: checked broadcasts, prefix sums over arrays,
connected components and hashing of words in bulk."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.durable import discard, materialize

#: Rows of a side that may be broadcast once it has been written and counted.
BROADCAST_ROWS = 400_000


def checked_broadcast(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a written table of narrow rows for broadcast if it has at most ``limit`` rows.

    A larger one comes back as it is, and Spark shuffles both sides."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= min(limit, BROADCAST_ROWS) else df


def set_aside(docs: DataFrame, *read: str) -> tuple[DataFrame, list[Column]]:
    """``docs`` with all columns but those that are ``read`` renamed, so that no result takes the place
    of one, and the columns that give them their names back."""
    own = {c: f"__own_{i}" for i, c in enumerate(docs.columns) if c not in read}
    return docs.withColumnsRenamed(own), [F.col(f"`{own.get(c, c)}`").alias(c) for c in docs.columns]


def prefix_sums(xs: Column) -> Column:
    """Exclusive prefix sums of an array of longs, as an array of the same length.

    Arrays are cut into runs of about the root of their length, so that no step copies
    more than that many numbers for each element."""
    n = F.size(xs)
    step = F.greatest(F.lit(1), F.ceil(F.sqrt(n.cast("double"))).cast("int"))
    running = lambda a: F.aggregate(
        a, F.array(F.lit(0).cast("long")), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))
    )
    chunks = F.transform(F.sequence(F.lit(1), n, step), lambda i: F.slice(xs, i, step))
    totals = running(F.transform(chunks, lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)))
    inner = F.transform(chunks, lambda c: F.slice(running(c), 1, F.size(c)))
    whole = F.flatten(
        F.zip_with(inner, F.slice(totals, 1, F.size(chunks)), lambda c, t: F.transform(c, lambda x: x + t))
    )
    return F.when(n > 0, whole).otherwise(F.array().cast("array<bigint>"))


#: A key with more than this share of all rows is joined by a broadcast of its one row; there are at
#: most 1 / HOT_SHARE such keys.
HOT_SHARE = 1e-4


def join_least(rows: DataFrame, least: DataFrame, n_rows: int) -> DataFrame:
    """``rows(u, v)`` with m of ``least(u, m, k)``, one row for each u with k, its number of rows.

    Rows of a hot u (a hub) stay where they are: its m comes by a broadcast of a bounded table. The
    rest is shuffled by u, of which each has at most HOT_SHARE of all rows then."""
    hot = F.broadcast(least.where(F.col("k") > n_rows * HOT_SHARE).select("u", "m"))
    rest = least.where(F.col("k") <= n_rows * HOT_SHARE).select("u", "m")
    return rows.join(hot, "u").unionByName(rows.join(hot, "u", "left_anti").join(rest, "u"))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)``: (node, root), root the smallest node of each.

    Alternating large-star and small-star steps; each is a map-side combined minimum per node and a
    join back that leaves hubs where they are, and ends in a written table; tables of a round go
    with the next one. Nodes without edges do not appear. Loops and null ends are ignored; no edges
    give no rows."""
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = materialize(e, "edges")
    own = lambda d: d.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("k"))
    mark = lambda d: d.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    now = mark(e)
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Written first, so that the join reads two plain tables.
        least = materialize(own(both).withColumn("m", F.least("u", "m")), "least")
        large = join_least(both, least, 2 * now[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "large")
        under = materialize(own(large), "least")
        small = join_least(large, under, now[0])
        small = (
            small.select("u", F.col("m").alias("v"))
            .unionByName(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
            .distinct()
        )
        small = materialize(small, "small")
        discard(e, least, large, under)
        before, now, e = now, mark(small), small
        if now == before:
            # Combined before the shuffle, so a root of very many nodes is one row of each partition.
            some = e.select(F.col("v").alias("node")).distinct()
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(some.withColumn("root", F.col("node")))
    raise RuntimeError("components did not settle")


# --- words and hashes of a batch of texts, on numpy arrays inside a task ---

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[str, np.ndarray] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, at least ``n`` of each."""
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 21)
        inverse = pow(_BASE, -1, 1 << 64)
        for key, base in (("up", _BASE), ("down", inverse)):
            steps = np.full(size, base, _U)
            steps[0] = 1
            _powers[key] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> _U(33))
    h = h * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


#: ASCII letters to lower case, digits and bytes from 128 on kept, all else a space.
FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of some folded texts, and the number of words of each text.

    Words are runs of non-space bytes; a word's hash is a polynomial over its bytes, taken
    from prefix sums over the whole batch."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    solid = data != 32
    edge = np.flatnonzero(np.diff(np.concatenate(([False], solid, [False])).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    up, down = _power_table(len(data) + 1)
    sums = np.zeros(len(data) + 1, _U)
    np.cumsum((data.astype(_U) + _U(1)) * up[: len(data)], out=sums[1:])
    hashes = mix((sums[end] - sums[start]) * down[start])
    borders = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.concatenate(([0], np.searchsorted(start, borders)))) if texts else np.zeros(0, int)
    return hashes, counts


def list_rows(column: pa.Array) -> list[np.ndarray]:
    """The rows of a list column of numbers, without nulls."""
    ends = column.offsets.to_numpy()
    values = column.values.to_numpy()
    return [values[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def groups(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[list[tuple]]:
    """Rows of the same first ``n`` columns, which come sorted by them; lists as arrays."""
    kept: list[tuple] = []
    for batch in batches:
        columns = [list_rows(c) if pa.types.is_list(c.type) else c.to_pylist() for c in batch.columns]
        for row in zip(*columns, strict=True):
            if kept and kept[-1][:n] != row[:n]:
                yield kept
                kept = []
            kept.append(row)
    if kept:
        yield kept


def trimmed(run):
    """A function of batches that gives memory it no longer needs back to the system at its end;
    the Python process lives on between tasks, beside the JVM's own memory."""

    def wrapped(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def slices(lengths: list[int], most: int = 1_000_000) -> list[tuple[int, int]]:
    """Ranges of consecutive items whose lengths add up to about ``most``, so that arrays
    over one range stay small; one long item is a range of its own."""
    out, begin, total = [], 0, 0
    for i, n in enumerate(lengths):
        if total and total + n > most:
            out.append((begin, i))
            begin, total = i, 0
        total += n
    return [*out, (begin, len(lengths))] if lengths else []
