"""Near-duplicate documents by DartMinHash signatures and a banded join.

A text's elements are its shingles of five words, each weighted by how often it stands there. The
k-th occurrence of a shingle is the k-th unit of its weight, a column of the region into which
darts are thrown: each column has its own Poisson process of darts in the order of their rank,
from a hash, the same in every text. A text sees the darts of its columns up to a rank that
yields about k ln k + 2k of them; each falls on one of k coordinates, and the earliest per
coordinate is the signature. Two texts agree in a coordinate with the probability of their
weighted Jaccard similarity (sum of least over sum of greatest weights). If a coordinate got no
dart, the text goes on to twice the rank.

Texts that are equal are one node from the start, so a group of copies costs one row however large
it is. Bands of the signatures are joined without pairs inside a bucket: each member is compared
with one centre, exactly, on its shingles, and linked nodes are contracted. Only buckets that still
hold several components go on: there the members outside the largest one (usually few) are compared
with all members of other components, in blocks of bounded size, so what is dealt grows with the
members and not with their pairs. Signatures sieve the pairs of a block first; only members of
likely pairs get their shingles, for an exact comparison on 64-bit hashes. A block gives the links
that connect components.

What can be lost is what the hashing loses: a pair at a similarity of exactly 0.8 shares no band with
a probability of 3 in a million, and agrees in under SIEVE of the coordinates with one of 2 in a
billion; both fall as the similarity rises. No other link is left out.

Defined results: words are runs of ASCII letters (A-Z folded), digits and non-ASCII characters; a
text of under five words is one shingle. Texts without words link only to equal texts, null texts
to nothing. Null doc_ids join classes; a class is named by its least doc_id (null if all are
null). Repeated rows are in one class and are all marked as kept if their doc_id is the least.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.durable import discard, materialize
from ..ship import ship
from .common import FOLD, checked_broadcast, components, groups, mix, set_aside, slices, trimmed, word_hashes

SHINGLE = 5
SIMILARITY = 0.8
#: Coordinates of a signature: BANDS bands of ROWS. A pair of similarity 0.8 shares a band with
#: probability 1 - (1 - 0.8**5)**32, all but 3 in a million.
BANDS, ROWS = 32, 5
#: Least share of coordinates that signatures agree in, for a pair in a block to be compared exactly.
SIEVE = 0.6
#: Members of a bucket on either side of a block, and weight units there (or one larger text).
BLOCK, BLOCK_UNITS = 512, 2_000_000
#: Pairs with one centre that may be compared in one task.
CENTRE_ROWS = 50_000
_U = np.uint64


def _shift(x: np.ndarray, n: int) -> np.ndarray:
    return (x << _U(n)) | (x >> _U(64 - n))


def elements(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the weight units (shingle, occurrence) of some texts, and the text of each."""
    hashes, counts = word_hashes([t.encode("utf-8", "surrogatepass").translate(FOLD) for t in texts])
    begin = np.cumsum(counts) - counts
    n = np.where(counts == 0, 0, np.maximum(counts - SHINGLE + 1, 1))
    doc = np.repeat(np.arange(len(texts)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin, n)
    padded = np.concatenate([hashes, np.zeros(SHINGLE, _U)])
    end = (begin + counts)[doc]
    shingles = np.zeros(len(at), _U)
    for k in range(SHINGLE):
        shingles = mix(_shift(shingles, 7) ^ np.where(at + k < end, padded[at + k], _U(k + 1)))
    order = np.lexsort((shingles, doc))
    shingles, doc = shingles[order], doc[order]
    first = np.ones(len(doc), bool)
    first[1:] = (shingles[1:] != shingles[:-1]) | (doc[1:] != doc[:-1])
    place = np.arange(len(doc))
    occurrence = place - np.maximum.accumulate(np.where(first, place, 0))
    return mix(shingles + occurrence.astype(_U) * _U(0x9E3779B97F4A7C15)), doc


def signatures(units: np.ndarray, doc: np.ndarray, n_docs: int, k: int = BANDS * ROWS, part: np.ndarray | None = None) -> np.ndarray:
    """DartMinHash signatures [n_docs, k]; 0 for texts without units.

    ``part``: how much of each unit's weight counts (1 if not given), for weights that are not whole."""
    part = np.ones(len(units)) if part is None else part
    weight = np.bincount(doc, part, n_docs)
    rank = (k * math.log(k) + 2 * k) / np.maximum(weight, 1e-12)
    value = np.zeros(n_docs * k, _U)
    pending = weight > 0
    while pending.any():
        own = pending[doc]
        u, d, p = units[own], doc[own], part[own]
        best, when = np.full(n_docs * k, np.inf), np.zeros(len(u))
        thrown: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        turn = 0
        while len(u):
            turn += 1
            h = mix(u + _U(turn * 0xD1342543DE82EF95 % (1 << 64)))
            when = when - np.log((h >> _U(11)).astype(np.float64) * 2.0**-53 + 2.0**-54)
            seen = when < rank[d]
            u, d, p, when, h = u[seen], d[seen], p[seen], when[seen], h[seen]
            other = mix(h ^ _U(0xA0761D6478BD642F))
            inside = (other & _U(0xFFFFFFFF)).astype(np.float64) < p * 2.0**32
            slot = d[inside] * k + ((other[inside] >> _U(32)) % _U(k)).astype(np.int64)
            np.minimum.at(best, slot, when[inside])
            thrown.append((slot, when[inside], h[inside]))
        slot, at, h = (np.concatenate(x) for x in zip(*thrown, strict=True))
        won = at == best[slot]
        value[slot[won]] = h[won]
        full = np.isfinite(best.reshape(n_docs, k)).all(axis=1)
        pending &= ~full
        rank = np.where(pending, rank * 2, rank)
    return value.reshape(n_docs, k)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], list[str]]]:
    """Keys and texts of a task, each text once per batch, in slices of bounded size."""
    for batch in batches:
        texts = dict(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        keys = list(texts)
        # However short a text is, it gets as many darts as any other.
        for a, b in slices([max(len(texts[x]), 4000) for x in keys], 1_000_000):
            yield keys[a:b], [texts[x] for x in keys[a:b]]


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for keys, texts in _batches(batches):
        units, doc = elements(texts)
        found = signatures(units, doc, len(texts))
        size = np.bincount(doc, minlength=len(texts))
        bands = np.zeros((len(texts), BANDS), _U)
        for r in range(ROWS):
            bands = mix(_shift(bands, 9) ^ found[:, r::ROWS])
        bands = mix(bands + np.arange(1, BANDS + 1, dtype=_U)).view(np.int64)
        short = (found & _U(255)).astype(np.uint8)
        rows = [i for i in range(len(keys)) if size[i]]
        yield pa.RecordBatch.from_arrays(
            [pa.array([keys[i] for i in rows], pa.binary()), pa.array(size[rows], pa.int64()), pa.array(list(bands[rows]), pa.list_(pa.int64())), pa.array([short[i].tobytes() for i in rows], pa.binary())],
            ["key", "size", "bands", "sig"],
        )


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for keys, texts in _batches(batches):
        units, doc = elements(texts)
        units = units.view(np.int64)
        order = np.lexsort((units, doc))
        cut = np.split(units[order], np.searchsorted(doc[order], np.arange(1, len(texts))))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(cut, pa.list_(pa.int64()))], ["key", "units"])


def _likely(rows: list[tuple]) -> list[tuple[float, int, int]]:
    """Pairs of a block's outsiders with members of other components that may be similar, with the
    share of coordinates in which they agree (negative, so likely pairs sort first).

    A pair that shares several bands counts in the first one, two outsiders in one direction."""
    band = rows[0][0]
    left = np.array([i for i, r in enumerate(rows) if r[3]], int)
    right = np.array([i for i, r in enumerate(rows) if not r[3]], int)
    if not len(left) or not len(right):
        return []
    sig = np.stack([np.frombuffer(r[8], np.uint8) for r in rows])
    bands = np.stack([r[9] for r in rows])
    comp = np.unique(np.array([r[6].hex() for r in rows]), return_inverse=True)[1]
    size = np.array([r[7] for r in rows])
    inside = ~np.array([r[4] for r in rows])  # in the bucket's largest component
    place = np.unique(np.array([r[5].hex() for r in rows]), return_inverse=True)[1]
    found = []
    for i in left.tolist():
        o = right[(comp[right] != comp[i]) & (inside[right] | (place[right] > place[i]))]
        o = o[np.minimum(size[o], size[i]) >= SIMILARITY * np.maximum(size[o], size[i])]
        agree = (sig[o] == sig[i]).mean(axis=1)
        likely = agree >= SIEVE
        o, agree = o[likely], agree[likely]
        if len(o):
            first = (bands[o] == bands[i]).argmax(axis=1)
            own = bands[i][first] == band
            found += zip((-agree[own]).tolist(), [i] * int(own.sum()), o[own].tolist(), strict=True)
    return found


def _sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each block that stand in a likely pair, without signatures."""
    names = ["band", "lo", "hi", "given", "out", "key", "comp", "size"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.binary(), pa.binary(), pa.int64()]
    for rows in groups(batches, 3):
        some = sorted({k for _, i, j in _likely(rows) for k in (i, j)})
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([rows[i][c] for i in some], kind) for c, kind in enumerate(kinds)], names)


def _forest(rows: list[tuple]) -> tuple[list, list]:
    """Links of one block, enough to span what its likely pairs connect: they are compared on their
    shingles, unless other links already connect them."""
    comp = np.unique(np.array([r[6].hex() for r in rows]), return_inverse=True)[1]
    root = list(range(int(comp.max()) + 1))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    out: tuple[list, list] = ([], [])
    for _, i, j in sorted(_likely(rows)):
        a, b = find(int(comp[i])), find(int(comp[j]))
        if a != b:
            both = len(np.intersect1d(rows[i][10], rows[j][10], assume_unique=True))
            if both >= SIMILARITY * (len(rows[i][10]) + len(rows[j][10]) - both):
                root[max(a, b)] = min(a, b)
                out[0].append(rows[i][5])
                out[1].append(rows[j][5])
    return out


def _connect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``_forest`` of each block (band, of outsiders, of members)."""
    for rows in groups(batches, 3):
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in _forest(rows)], ["a", "b"])


def key_of(text: Column) -> Column:
    """A text's node: 128 bits of its MD5; null for null."""
    return F.unhex(F.md5(text.cast("binary")))


def _verify(pairs: DataFrame, units: DataFrame, copies: DataFrame) -> DataFrame:
    """Those of ``pairs(a, b, parts)`` whose weighted Jaccard similarity reaches SIMILARITY.

    The pairs with one b are dealt to ``parts`` tasks; ``copies(b, parts)`` has the most of each b."""
    left = units.select(F.col("key").alias("a"), F.col("units").alias("ua"))
    right = units.join(copies.select(F.col("b").alias("key"), "parts"), "key")
    right = right.select(F.col("key").alias("b"), F.col("units").alias("ub"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    dealt = pairs.select("a", "b", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part"))
    both = F.size(F.array_intersect("ua", "ub"))
    all_ = F.size("ua") + F.size("ub") - both
    return dealt.join(left, "a").join(right, ["b", "part"]).where(both >= SIMILARITY * all_).select("a", "b")


def outsiders(placed: DataFrame) -> DataFrame:
    """(band, main, left, right) of the buckets of ``placed(band, key, size, comp)`` that hold several
    components: the one of most members, and the blocks of members outside it and of all members."""
    parts = placed.groupBy("band", "comp").agg(F.count("*").alias("n"), F.sum("size").alias("s"))
    sums = parts.groupBy("band").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.max(F.struct("n", "comp", "s")).alias("most"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.count("*").alias("c"))
    number = lambda n, s: F.greatest(F.ceil(n / BLOCK), F.ceil(s / BLOCK_UNITS)).cast("int")
    return sums.where("c > 1").select("band", "main", number(F.col("n") - F.col("most.n"), F.col("s") - F.col("most.s")).alias("left"), number(F.col("n"), F.col("s")).alias("right"))


def blocks(members: DataFrame) -> DataFrame:
    """``members(band, key, comp, main, left, right, ...)`` dealt to the blocks (band, lo, hi): an
    outsider to one for each block of members, a member to one for each block of outsiders."""
    out = F.col("comp") != F.col("main")
    lo, hi = F.pmod(F.xxhash64("key"), F.col("left")).cast("int"), F.pmod(F.xxhash64("key"), F.col("right")).cast("int")
    to = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    given = members.where(out).withColumns({"lo": lo, "hi": to("right"), "given": F.lit(True), "out": F.lit(True)})
    asked = members.withColumns({"lo": to("left"), "hi": hi, "given": F.lit(False), "out": out})
    return given.unionByName(asked)


def once_a_key(rows: DataFrame, own: list[str], *sides: DataFrame) -> DataFrame:
    """``rows`` joined with ``sides``, which have one row for each key. A text stands in as many rows as
    its buckets and blocks; it is joined once, and spread over them after. ``own`` are columns of a key."""
    at = [c for c in rows.columns if c not in ("key", *own)]
    each = rows.groupBy("key", *own).agg(F.collect_list(F.struct(*at)).alias("at"))
    for side in sides:
        each = each.join(side, "key")
    return each.withColumn("at", F.explode("at")).select(*[c for c in each.columns if c != "at"], "at.*")


def links(docs: DataFrame) -> DataFrame:
    """Verified links (a, b) between the nodes of different texts: enough of them to connect every
    two nodes that a chain of similar nodes sharing a band connects."""
    ship(docs.sparkSession)
    texts = docs.where("text IS NOT NULL").select(key_of(F.col("text")).alias("key"), "text")
    signed = texts.mapInArrow(trimmed(_sign), "key binary, size long, bands array<long>, sig binary").dropDuplicates(["key"])
    signed = materialize(signed, "signatures")
    rows = signed.select(F.explode("bands").alias("band"), "key", "size")
    buckets = rows.groupBy("band").agg(F.count("*").alias("n"), F.min(F.xxhash64("key")).alias("centre")).where("n > 1")
    buckets = buckets.select("band", "centre", F.ceil(F.col("n") / CENTRE_ROWS).cast("int").alias("parts"))
    shared = materialize(rows.join(checked_broadcast(materialize(buckets, "buckets")), "band"), "shared")
    centres = shared.where(F.xxhash64("key") == F.col("centre")).select("band", F.col("key").alias("b"), F.col("size").alias("size_b"), "parts")
    near = F.least("size", "size_b") >= SIMILARITY * F.greatest("size", "size_b")
    pairs = shared.drop("parts").join(centres, "band").where((F.col("key") != F.col("b")) & near)
    pairs = materialize(pairs.groupBy(F.col("key").alias("a"), "b").agg(F.max("parts").alias("parts")), "pairs")
    nodes = checked_broadcast(materialize(shared.select("key").distinct(), "nodes"))
    units = materialize(texts.join(nodes, "key", "left_semi").mapInArrow(trimmed(_units), "key binary, units array<long>").dropDuplicates(["key"]), "units")
    copies = checked_broadcast(materialize(pairs.groupBy("b").agg(F.max("parts").alias("parts")), "copies"))
    first = materialize(_verify(pairs, units, copies), "links")
    # Buckets that still hold several components: compare members of different ones, in blocks.
    roots = components(first)
    placed = shared.select("band", "key", "size").join(roots, F.col("key") == F.col("node"), "left")
    placed = materialize(placed.select("band", "key", "size", F.coalesce("root", "key").alias("comp")), "placed")
    open_ = materialize(outsiders(placed), "open")
    members = placed.join(checked_broadcast(open_), "band")
    row = ["band", "lo", "hi", "given", "out", "key", "comp", "size"]
    of_key = signed.select("key", "sig", "bands")
    to_block = lambda d: d.repartition("band", "lo", "hi").sortWithinPartitions("band", "lo", "hi")
    signed_members = once_a_key(members, ["comp", "size"], of_key)
    sifted = to_block(blocks(signed_members).select(*row, "sig", "bands")).mapInArrow(trimmed(_sift), blocks(members).select(*row).schema)
    sifted = materialize(sifted, "sifted")  # few of the dealt rows: only these need their shingles
    dealt = to_block(once_a_key(sifted, ["comp", "size"], of_key, units).select(*row, "sig", "bands", "units"))
    more = materialize(dealt.mapInArrow(trimmed(_connect), "a binary, b binary"), "links")
    discard(signed, shared, pairs, units, placed, open_, sifted)
    return first.unionByName(more)


def classes(docs: DataFrame) -> DataFrame:
    """``docs`` with component_id (the least doc_id of its class) and kept (it is the row's own)."""
    docs = docs.drop("component_id", "kept", "__key")
    roots = components(links(docs))
    keyed = docs.withColumn("__key", key_of(F.col("text")))
    nodes = keyed.where("__key IS NOT NULL").groupBy("__key").agg(F.min("doc_id").alias("least"))
    nodes = materialize(
        nodes.join(roots, F.col("__key") == F.col("node"), "left").select("__key", "least", F.coalesce("root", "__key").alias("root")), "nodes"
    )
    named = nodes.groupBy("root").agg(F.min("least").alias("least"), F.count("*").alias("n"))
    # Only texts with copies or links differ from their own doc_id: the others need no join.
    copied = keyed.where("__key IS NOT NULL").groupBy("__key").agg(F.count("*").alias("n")).where("n > 1").select("__key", F.lit(True).alias("copied"))
    grouped = nodes.join(named.select("root", F.col("least").alias("component"), "n"), "root").join(copied, "__key", "left")
    grouped = materialize(grouped.where("n > 1 OR copied").select(F.col("__key").alias("__k"), F.col("component").alias("__c")), "classes")
    out = keyed.join(checked_broadcast(grouped), F.col("__key") == F.col("__k"), "left")
    out = out.withColumn("component_id", F.when(F.col("__k").isNotNull(), F.col("__c")).otherwise(F.col("doc_id")))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))).drop("__key", "__k", "__c")


def dedup(docs: DataFrame) -> DataFrame:
    """One row of each class, with the columns of ``docs``: that of the least doc_id. Rows of null
    doc_id stay only where their whole class has none, and then one of each text."""
    aside, names = set_aside(docs, "doc_id", "text")
    marked = classes(aside)
    own = marked.where("kept")
    own = own.withColumn("__key", key_of(F.col("text")))
    lone = own.where("text IS NULL").drop("__key", "component_id", "kept")
    return own.where("text IS NOT NULL").dropDuplicates(["doc_id", "__key"]).drop("__key", "component_id", "kept").unionByName(lone).select(*names)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return classes(docs).select("doc_id", "component_id", "kept")


SQL = r"""
WITH RECURSIVE t AS (
  SELECT text, min(doc_id) AS least,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents WHERE text IS NOT NULL GROUP BY text),
tx AS (SELECT row_number() OVER (ORDER BY least) AS id, text, least, w FROM t),
sh AS (
  SELECT id, array_to_string(w[p:p + 4], ' ') AS s
  FROM (SELECT id, w, unnest(range(1, greatest(2, len(w) - 3))) AS p FROM tx WHERE len(w) > 0)),
e AS (SELECT id, s, row_number() OVER (PARTITION BY id, s) AS k FROM sh),
n AS (SELECT id, count(*) AS n FROM e GROUP BY id),
o AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM e a JOIN e b ON a.s = b.s AND a.k = b.k AND a.id < b.id GROUP BY a.id, b.id),
l AS (SELECT o.a, o.b FROM o JOIN n x ON x.id = o.a JOIN n y ON y.id = o.b WHERE c >= 0.8 * (x.n + y.n - c)),
s2 AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT id AS a, id AS b FROM tx UNION SELECT r.a, s2.b FROM r JOIN s2 ON r.b = s2.a),
m AS (SELECT r.a, min(tx.least) AS component FROM r JOIN tx ON tx.id = r.b GROUP BY r.a)
SELECT d.doc_id, coalesce(m.component, d.doc_id) AS component_id, d.doc_id = coalesce(m.component, d.doc_id) AS kept
FROM documents d LEFT JOIN tx ON d.text = tx.text LEFT JOIN m ON m.a = tx.id
"""
