"""One query for each group of operators over the fixtures, and SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import blobs as bf
from ..functions import modes, paths
from ..operators import access, blobs, fsck, image, layers, mounts, oplog, publish, restore, snapshot, tree
from ..sources import image as image_source
from ..sources import messages
from . import fixtures as fx
from .durable import materialize
from .ordered import running

#: Depth that walks may reach.
WALK_DEPTH = fsck.MAX_DEPTH
#: Blocks of data between the beginnings of two images of documents.
IMAGE_BLOCKS = 64

_PATH = "source || '/' || lang || '/' || CAST(doc_id AS VARCHAR) || '.txt'"
_DEAD = "(lang = 'fr' AND source IN ('src3', 'src4'))"
_FILES = f"""files AS (
  SELECT doc_id, source, lang, {_PATH} AS path, CAST(420 AS BIGINT) AS mode, CAST(strlen(text) AS BIGINT) AS size,
         1600000000000000000 + doc_id * 1000 AS mod_time_ns, sha256(text) AS sha256, text FROM documents)"""
_COMMIT = f"""{_FILES},
base AS (SELECT * FROM files WHERE doc_id % 10 < 8),
upper AS (
  SELECT path, mode, CAST(strlen(text || '-v2') AS BIGINT) AS size, mod_time_ns, sha256(text || '-v2') AS sha256, lang, source
  FROM files WHERE doc_id % 10 >= 7 AND NOT {_DEAD}),
whiteouts AS (
  SELECT DISTINCT source || '/' || lang AS path FROM files WHERE {_DEAD}
  UNION ALL SELECT path FROM files WHERE doc_id % 10 = 0 AND NOT {_DEAD}),
dead AS (SELECT DISTINCT b.path FROM base b, whiteouts w WHERE b.path = w.path OR starts_with(b.path, w.path || '/'))"""
_COLUMNS = "path, mode, size, mod_time_ns, sha256"
_STACK = f"""d AS (SELECT doc_id, source, lang, {_PATH} AS path, text, unnest(range(0, 3)) AS layer_idx FROM documents),
lf AS (
  SELECT layer_idx, path, CAST(strlen(text) + 2 AS BIGINT) AS size, sha256(text || '-' || CAST(layer_idx AS VARCHAR)) AS sha256
  FROM d WHERE layer_idx >= doc_id % 3 AND NOT (layer_idx = 2 AND (doc_id % 10 = 0 OR {_DEAD}))),
w AS (
  SELECT DISTINCT source || '/' || lang AS path FROM documents WHERE {_DEAD}
  UNION ALL SELECT {_PATH} FROM documents WHERE doc_id % 10 = 0 AND NOT {_DEAD}),
r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY layer_idx DESC) AS n FROM lf),
shown AS (
  SELECT CAST(layer_idx AS INTEGER) AS layer_idx, path, size, sha256 FROM r
  WHERE n = 1 AND (layer_idx = 2 OR NOT EXISTS (SELECT 1 FROM w WHERE r.path = w.path OR starts_with(r.path, w.path || '/'))))"""
_SNAPS = """s AS (
  SELECT 'vol-' || CAST(s_suppkey AS VARCHAR) AS volume_id, s_suppkey AS k,
         CASE WHEN s_suppkey % 2 = 0 THEN sha256(CAST(s_suppkey AS VARCHAR)) ELSE '' END AS image_sha256,
         list_transform(range(1, CAST(s_suppkey % 4 AS BIGINT) + 1), lambda i: sha256(CAST(s_suppkey AS VARCHAR) || '/' || CAST(i AS VARCHAR))) AS layers
  FROM supplier),
e AS (SELECT *, CASE WHEN len(layers) > 0 THEN layers WHEN image_sha256 <> '' THEN [image_sha256] ELSE [] END AS own FROM s)"""
_TREE = """f AS (
  SELECT source AS image, lang || '/' || CAST(doc_id % 7 AS VARCHAR) || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS path, false AS is_dir,
         33188 AS mode, CAST(strlen(text) AS BIGINT) AS size, doc_id % 1000 AS uid, doc_id % 77 AS gid, 1600000000 + doc_id // 1000000 AS mtime FROM documents),
dirs AS (
  SELECT DISTINCT image, split_part(path, '/', 1) AS path FROM f
  UNION SELECT DISTINCT image, split_part(path, '/', 1) || '/' || split_part(path, '/', 2) FROM f),
a AS (
  SELECT * FROM f UNION ALL SELECT image, path, true, 16877, 0, 0, 0, 0 FROM dirs UNION ALL SELECT DISTINCT image, '', true, 16877, 0, 0, 0, 0 FROM f),
n AS (
  SELECT image, CAST(row_number() OVER (PARTITION BY image ORDER BY CASE WHEN path = '' THEN [] ELSE string_split(path, '/') END) - 1 AS BIGINT) AS nid, path, is_dir, mode, size, uid, gid, mtime,
         regexp_replace(path, '/?[^/]*$', '') AS up, regexp_extract(path, '[^/]*$') AS name FROM a),
t AS (
  SELECT n.image, n.nid, p.nid AS parent_nid, n.name, n.path, n.is_dir, CAST(n.mode AS INTEGER) AS mode, n.size, n.uid, n.gid, n.mtime
  FROM n JOIN n p ON n.image = p.image AND n.up = p.path)"""
_LAYOUT = _TREE + """,
l AS (
  SELECT *, CASE WHEN is_dir THEN 4096 ELSE size END AS data_len, CASE WHEN is_dir THEN 1 ELSE CAST(ceil(size / 4096.0) AS BIGINT) END AS n_blocks FROM t),
b AS (SELECT image, CAST(1 + ceil(count(*) * 32 / 4096.0) AS BIGINT) AS first, count(*) AS inodes, sum(n_blocks) AS k FROM l GROUP BY image)"""
_ENTRIES = _TREE + """,
en AS (
  SELECT image, nid AS dir_nid, nid, '.' AS name, 0 AS g, 2 AS file_type FROM t WHERE is_dir
  UNION ALL SELECT image, nid, parent_nid, '..', 1, 2 FROM t WHERE is_dir
  UNION ALL SELECT image, parent_nid, nid, name, 2, CASE WHEN is_dir THEN 2 ELSE 1 END FROM t WHERE nid <> 0),
ix AS (SELECT *, CAST(row_number() OVER (PARTITION BY image, dir_nid ORDER BY g, name) - 1 AS INTEGER) AS idx, CAST(strlen(name) AS BIGINT) AS name_len FROM en),
o AS (
  SELECT *, CAST(12 * count(*) OVER (PARTITION BY image, dir_nid) + sum(name_len) OVER (PARTITION BY image, dir_nid ORDER BY idx) - name_len AS BIGINT) AS nameoff FROM ix)"""
_OPLOG = """x AS (
  SELECT user_id AS file_id, ts, event_id, '[' || CAST(event_id AS VARCHAR) || ']' AS arg,
         CASE event_type WHEN 'signup' THEN 'create' WHEN 'view' THEN 'append' WHEN 'error' THEN 'delete' WHEN 'purchase' THEN 'overwrite' ELSE 'chmod' END AS op,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events),
k AS (SELECT *, max(CASE WHEN op IN ('create', 'delete') THEN seq END) OVER (PARTITION BY file_id ORDER BY seq) AS m FROM x),
al AS (SELECT k.*, coalesce(y.op = 'create', false) AS alive FROM k LEFT JOIN x y ON y.file_id = k.file_id AND y.seq = k.m),
bf AS (SELECT *, coalesce(lag(alive) OVER (PARTITION BY file_id ORDER BY seq), false) AS before FROM al),
ef AS (SELECT *, CASE WHEN op = 'create' THEN NOT before ELSE before END AS eff FROM bf),
ep AS (SELECT *, sum(CASE WHEN eff AND op IN ('create', 'overwrite') THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY seq) AS epoch FROM ef)"""
_ACCESS = f"""{_FILES},
acc AS (
  SELECT ts, event_id, CAST(event_id % 8 AS INTEGER) AS pid, f.path, f.size, f.doc_id AS d FROM events e JOIN files f ON f.doc_id = CASE WHEN e.event_id % 5 = 0 THEN 0 ELSE e.event_id * 7 % (SELECT count(*) FROM documents) END),
st AS (SELECT DISTINCT sha256 FROM files WHERE doc_id % 3 <> 0),
pe AS (SELECT path, sha256 IN (SELECT sha256 FROM st) AS ok FROM files WHERE size >= 1000),
fi AS (SELECT path, min(struct_pack(ts := ts, e := event_id)) AS m FROM acc WHERE pid <> 3 GROUP BY path)"""
_EDGES = """e AS (
  SELECT 0 AS parent, CAST(r_regionkey + 1 AS BIGINT) AS child FROM region
  UNION ALL SELECT n_regionkey + 1, n_nationkey + 100 FROM nation
  UNION ALL SELECT c_nationkey + 100, c_custkey + 1000000 FROM customer
  UNION ALL SELECT CASE WHEN s_suppkey = 1 THEN 0 ELSE s_suppkey + 9999 END, s_suppkey + 10000 FROM supplier
  UNION ALL SELECT 124, n_regionkey + 1 FROM nation WHERE n_nationkey = 24)"""
_REACH = f"""{_EDGES},
w AS (SELECT CAST(0 AS BIGINT) AS nid, 1 AS depth UNION SELECT e.child, w.depth + 1 FROM w JOIN e ON e.parent = w.nid WHERE w.depth <= {WALK_DEPTH}),
r AS (SELECT nid, min(depth) AS depth FROM w GROUP BY nid)"""

_ALL: dict[str, tuple] = {}


def _query(sql: str | None):
    def add(f):
        _ALL[f.__name__] = (f, sql)
        return f

    return add


# --- snapshots ---


@_query(f"WITH {_FILES} SELECT source AS volume_id, CAST(3 AS BIGINT) AS version, {_COLUMNS} FROM files")
def snapshot_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot.latest(fx.manifest(spark, sf_dir))


_AFTER = f"""SELECT {_COLUMNS} FROM base WHERE path NOT IN (SELECT path FROM dead) AND path NOT IN (SELECT path FROM upper)
UNION ALL SELECT {_COLUMNS} FROM upper"""


@_query(f"WITH {_COMMIT} {_AFTER}")
def snapshot_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot.commit(fx.base(spark, sf_dir).select(*fx.FILE_COLUMNS), fx.delta(spark, sf_dir))


@_query(f"""WITH {_COMMIT}, new AS ({_AFTER})
SELECT coalesce(b.path, n.path) AS path, b.sha256 AS old_sha256, n.sha256 AS new_sha256,
       CASE WHEN b.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' WHEN b.sha256 = n.sha256 THEN 'same' ELSE 'modified' END AS status
FROM base b FULL JOIN new n ON b.path = n.path""")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot.diff(fx.base(spark, sf_dir), snapshot_commit(spark, sf_dir))


@_query(f"WITH {_COMMIT} SELECT path FROM dead")
def whiteout_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot.dead_paths(fx.base(spark, sf_dir), fx.whiteouts(spark, sf_dir))


@_query(f"""WITH {_COMMIT}, op AS (SELECT DISTINCT source || '/' || lang AS path FROM files WHERE source = 'src1')
SELECT {_COLUMNS} FROM base WHERE path NOT IN (SELECT path FROM dead) AND path NOT IN (SELECT path FROM upper)
  AND NOT EXISTS (SELECT 1 FROM op WHERE starts_with(base.path, op.path || '/'))
UNION ALL SELECT {_COLUMNS} FROM upper""")
def opaque_dir_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = fx.documents(spark, sf_dir).where("source = 'src1'").select(F.concat_ws("/", "source", "lang").alias("path"), F.lit("opaque").alias("kind")).distinct()
    delta = fx.delta(spark, sf_dir).unionByName(marks, allowMissingColumns=True)
    return snapshot.commit(fx.base(spark, sf_dir).select(*fx.FILE_COLUMNS), delta, opaque=True)


@_query(f"""WITH {_FILES},
u AS (SELECT path || '/inner' AS path, mode, size, mod_time_ns, sha256 FROM files WHERE doc_id % 10 = 1
      UNION ALL SELECT DISTINCT source || '/' || lang, CAST(420 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), 'x' FROM files WHERE source = 'src2')
SELECT {_COLUMNS} FROM files WHERE doc_id % 10 <> 1 AND source <> 'src2' UNION ALL SELECT {_COLUMNS} FROM u""")
def type_change_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = fx.documents(spark, sf_dir).select(*fx.FILE_COLUMNS)
    docs = fx.documents(spark, sf_dir)
    inner = docs.where("doc_id % 10 = 1").withColumn("path", F.concat("path", F.lit("/inner"))).select(*fx.FILE_COLUMNS)
    zero = F.lit(0).cast("long")
    flat = docs.where("source = 'src2'").select(F.concat_ws("/", "source", "lang").alias("path"), "mode", zero.alias("size"), zero.alias("mod_time_ns"), F.lit("x").alias("sha256")).distinct()
    return snapshot.commit(base, inner.unionByName(flat).withColumn("kind", F.lit("file")), strict=True)


# --- blobs ---


@_query(f"WITH {_FILES} SELECT sha256, count(*) AS refs, CAST(sum(size) AS BIGINT) AS logical_bytes, max(size) AS stored_bytes FROM files GROUP BY sha256")
def blob_dedupe_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blobs.dedup_stats(fx.documents(spark, sf_dir).select("sha256", "size"))


@_query(f"WITH {_FILES} SELECT DISTINCT sha256, size FROM files WHERE sha256 NOT IN (SELECT sha256 FROM files WHERE doc_id % 3 <> 0)")
def missing_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blobs.missing(fx.documents(spark, sf_dir).select("sha256", "size"), fx.blobs(spark, sf_dir))


@_query(f"WITH {_FILES} SELECT path, sha256 FROM files WHERE sha256 IN (SELECT sha256 FROM files WHERE doc_id % 3 <> 0)")
def present_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blobs.present(fx.documents(spark, sf_dir).select("path", "sha256"), fx.blobs(spark, sf_dir))


@_query(f"WITH {_FILES} SELECT path, sha256, text AS content FROM files")
def strict_restore_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blobs.with_content(fx.documents(spark, sf_dir).select("path", "sha256"), fx.all_blobs(spark, sf_dir))


@_query("""WITH b AS (SELECT DISTINCT sha256(text) AS sha256, CAST(strlen(text) AS BIGINT) AS size FROM documents)
SELECT sha256, CAST(i AS INTEGER) AS chunk_idx, CAST(i * 4096 AS BIGINT) AS "offset", CAST(greatest(0, least(4096, size - i * 4096)) AS BIGINT) AS n_bytes
FROM (SELECT sha256, size, unnest(range(0, CAST(greatest(1, ceil(size / 4096.0)) AS BIGINT))) AS i FROM b)""")
def blob_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = blobs.chunks(fx.all_blobs(spark, sf_dir), 4096)
    return rows.select("sha256", "chunk_idx", "offset", F.octet_length("content").cast("long").alias("n_bytes"))


@_query("""WITH b AS (SELECT DISTINCT sha256(text) AS sha256, CAST(strlen(text) AS BIGINT) AS size FROM documents)
SELECT sha256, size, CAST(greatest(1, ceil(size / 4096.0)) AS BIGINT) AS n_chunks, size AS bytes, true AS complete FROM b""")
def chunk_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = fx.all_blobs(spark, sf_dir)
    return blobs.reconcile(blobs.chunks(own, 4096), own)


@_query("""WITH r AS (
  SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN sha256(text) WHEN 1 THEN '  ' || upper(sha256(text)) || chr(9) || chr(13) || chr(160) WHEN 2 THEN left(sha256(text), 58) || 'é' ELSE 'g' || substr(sha256(text), 2) END AS raw FROM documents)
SELECT doc_id, CASE WHEN doc_id % 4 < 2 THEN lower(trim(raw, ' ' || chr(9) || chr(13) || chr(160))) END AS id,
       CASE doc_id % 4 WHEN 2 THEN 'invalid sha256 length: 60' WHEN 3 THEN 'invalid sha256 characters' END AS error FROM r""")
def parse_blob_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, sha = F.col("doc_id") % 4, F.col("sha256")
    raw = F.when(k == 0, sha).when(k == 1, F.concat(F.lit("  "), F.upper(sha), F.lit("\t\r\u00a0"))).when(k == 2, F.concat(F.left(sha, F.lit(58)), F.lit("é"))).otherwise(F.concat(F.lit("g"), F.substr(sha, F.lit(2))))
    parsed = fx.documents(spark, sf_dir).select("doc_id", bf.parse_blob_id(raw).alias("b"))
    return parsed.select("doc_id", F.col("b.id").alias("id"), F.col("b.error").alias("error"))


@_query("""WITH r AS (
  SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'GET ' || sha256(text) || chr(13) WHEN 1 THEN '  get ' || chr(9) || upper(sha256(text)) WHEN 2 THEN 'GET' || chr(9) || sha256(text)
         WHEN 3 THEN 'GET' WHEN 4 THEN ' ' || chr(9) || chr(13) ELSE 'GET nonsense' END AS line, sha256(text) AS sha, CAST(strlen(text) AS BIGINT) AS size FROM documents),
c AS (SELECT DISTINCT sha256(text) AS sha FROM documents WHERE doc_id % 3 <> 0),
o AS (SELECT DISTINCT sha256(text) AS sha FROM documents WHERE doc_id % 2 = 0)
SELECT doc_id, line,
  CASE WHEN doc_id % 6 IN (2, 3) THEN 'ERR invalid command' WHEN doc_id % 6 = 5 THEN 'ERR invalid sha256 length: 8'
       WHEN sha IN (SELECT sha FROM c) OR sha IN (SELECT sha FROM o) THEN 'OK ' || CAST(size AS VARCHAR) ELSE 'ERR not found' END AS reply,
  CASE WHEN doc_id % 6 > 1 THEN NULL WHEN sha IN (SELECT sha FROM c) THEN 'cache' WHEN sha IN (SELECT sha FROM o) THEN 'origin' END AS source
FROM r WHERE doc_id % 6 <> 4""")
def cas_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fx.documents(spark, sf_dir)
    k, sha = F.col("doc_id") % 6, F.col("sha256")
    line = (
        F.when(k == 0, F.concat(F.lit("GET "), sha, F.lit("\r"))).when(k == 1, F.concat(F.lit("  get \t"), F.upper(sha))).when(k == 2, F.concat(F.lit("GET\t"), sha))
        .when(k == 3, "GET").when(k == 4, " \t\r").otherwise("GET nonsense")
    )
    return blobs.answer(docs.select("doc_id", line.alias("line")), fx.blobs(spark, sf_dir), docs.where("doc_id % 2 = 0").select("sha256", "size"))


# --- restore ---


def _plan(spark: SparkSession, sf_dir: str, threshold: int) -> DataFrame:
    return restore.plan(snapshot_commit(spark, sf_dir), fx.base(spark, sf_dir).where("doc_id % 2 = 0"), threshold)


@_query(f"""WITH {_COMMIT}, new AS ({_AFTER}), th AS (SELECT unnest([-1, 0, 4096]) AS threshold)
SELECT th.threshold, n.*, CASE WHEN b.sha256 = n.sha256 THEN 'skip' WHEN th.threshold >= 0 AND n.size >= th.threshold THEN 'lazy' ELSE 'eager' END AS action
FROM new n CROSS JOIN th LEFT JOIN (SELECT path, sha256 FROM base WHERE doc_id % 2 = 0) b ON b.path = n.path""")
def restore_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    thresholds = F.explode(F.array(*[F.lit(t) for t in (-1, 0, 4096)]))
    new = snapshot_commit(spark, sf_dir).withColumn("threshold", thresholds)
    return restore.plan(new, fx.base(spark, sf_dir).where("doc_id % 2 = 0"), F.col("threshold"))


@_query(f"""WITH {_COMMIT}, new AS ({_AFTER}),
p AS (SELECT n.size, CASE WHEN b.sha256 = n.sha256 THEN 'skip' WHEN n.size >= 4096 THEN 'lazy' ELSE 'eager' END AS action
      FROM new n LEFT JOIN (SELECT path, sha256 FROM base WHERE doc_id % 2 = 0) b ON b.path = n.path)
SELECT action, count(*) AS n_files, CAST(sum(size) AS BIGINT) AS bytes FROM p GROUP BY action""")
def bytes_eager_vs_lazy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return restore.bytes_by_action(_plan(spark, sf_dir, 4096))


@_query(f"""WITH {_COMMIT}, new AS ({_AFTER})
SELECT n.path, CASE WHEN b.sha256 = n.sha256 THEN 'skip' ELSE 'eager' END AS action
FROM new n LEFT JOIN (SELECT path, sha256 FROM base WHERE doc_id % 2 = 0) b ON b.path = n.path""")
def restore_drained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return restore.drained(_plan(spark, sf_dir, 0)).select("path", "action")


@_query(f"""WITH {_FILES} SELECT path, size, CASE WHEN size >= 4096 THEN 'lazy' ELSE 'eager' END AS action,
  CASE WHEN size < 4096 THEN text END AS content FROM files""")
def restore_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = fx.documents(spark, sf_dir).select("path", "size", "sha256")
    planned = restore.plan(own, own.limit(0), 4096)
    return restore.materialized(planned, fx.all_blobs(spark, sf_dir)).select("path", "size", "action", "content")


@_query(f"WITH {_FILES} SELECT source AS volume_id, count(*) AS n_pending FROM files WHERE size >= 4096 GROUP BY source")
def pending_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = fx.documents(spark, sf_dir).select(F.col("source").alias("volume_id"), "path", "size", "sha256")
    return restore.pending_by_volume(restore.plan(own, own.limit(0), 4096))


# --- layers ---


@_query(f"WITH {_STACK} SELECT layer_idx, path, 'file' AS kind, size, sha256 FROM shown")
def layer_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.stack(fx.layers(spark, sf_dir))


@_query(f"WITH {_STACK} SELECT 0 AS layer_idx, path, 'file' AS kind, size, sha256 FROM shown")
def layer_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.flatten(fx.layers(spark, sf_dir))


@_query(f"""WITH {_SNAPS}
SELECT volume_id, array_to_string(CASE WHEN k % 3 = 0 THEN own WHEN len(own) >= 2 THEN ['new'] ELSE list_append(own, 'new') END, ',') AS layers FROM e""")
def layer_append_or_combine(spark: SparkSession, sf_dir: str) -> DataFrame:
    snaps = fx.snapshots(spark, sf_dir)
    key = F.substr("volume_id", F.lit(5)).cast("long")
    new = snaps.where(key % 3 != 0).select("volume_id", F.lit("new").alias("sha256"))
    return layers.commit_layer(snaps, new).select("volume_id", F.array_join("layers", ",").alias("layers"))


@_query(f"""WITH {_SNAPS}, sv AS (
  SELECT volume_id, layers, own AS a, CASE WHEN k % 5 = 0 THEN list_append(layers, 'x') WHEN k % 5 = 1 AND len(layers) > 0 THEN list_prepend('y', layers[2:]) ELSE own END AS b, k FROM e WHERE k % 7 <> 0)
SELECT volume_id, array_to_string(a, ',') AS local_layers, array_to_string(b, ',') AS server_layers,
       CAST(CASE WHEN k % 5 = 0 THEN len(layers) ELSE 0 END AS BIGINT) AS first_difference FROM sv WHERE array_to_string(a, ',') <> array_to_string(b, ',')""")
def layer_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    local = fx.snapshots(spark, sf_dir)
    key = F.substr("volume_id", F.lit(5)).cast("long")
    changed = F.when(key % 5 == 0, F.array_append("layers", "x")).when((key % 5 == 1) & (F.size("layers") > 0), F.array_prepend(F.slice("layers", 2, 100), "y")).otherwise(F.col("layers"))
    # Where the key is 3 modulo 5, the server names the image as a layer, which is no conflict.
    listed = F.when((key % 5 == 3) & (F.size("layers") == 0) & (F.col("image_sha256") != ""), F.array("image_sha256")).otherwise(changed)
    server = local.where(key % 7 != 0).withColumn("layers", listed)
    found = layers.conflicts(local, server.withColumn("image_sha256", F.when(key % 5 == 3, "").otherwise(F.col("image_sha256"))))
    return found.select("volume_id", *[F.array_join(c, ",").alias(c) for c in ("local_layers", "server_layers")], "first_difference")


@_query(f"WITH {_SNAPS} SELECT volume_id, CAST(unnest(range(0, len(own))) AS INTEGER) AS layer_idx, unnest(own) AS sha256 FROM e WHERE len(own) > 0")
def layer_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.unnest(fx.snapshots(spark, sf_dir))


@_query(f"""WITH {_SNAPS}
SELECT volume_id, CASE len(layers) WHEN 0 THEN '' WHEN 1 THEN 'layer-0' WHEN 2 THEN 'layer-1:layer-0' ELSE 'layer-2:layer-1:layer-0' END AS lower_dirs FROM s""")
def layer_mount_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.snapshots(spark, sf_dir).select("volume_id", bf.lower_dirs(F.col("layers")).alias("lower_dirs"))


@_query(f"""WITH {_SNAPS}, u AS (SELECT volume_id, k, CAST(unnest(range(0, len(own))) AS INTEGER) AS layer_idx, unnest(own) AS sha256 FROM e WHERE len(own) > 0)
SELECT volume_id, layer_idx, sha256, CASE WHEN layer_idx = 1 THEN 'missing blob' ELSE 'fails check' END AS reason FROM u WHERE layer_idx = 1 OR (layer_idx = 0 AND k % 3 = 0)""")
def layer_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    snaps = fx.snapshots(spark, sf_dir)
    rows = layers.unnest(snaps)
    key = F.substr("volume_id", F.lit(5)).cast("long")
    return layers.unfit_layers(snaps, rows.where("layer_idx <> 1").select("sha256"), rows.where((F.col("layer_idx") == 0) & (key % 3 == 0)).select(F.col("sha256").alias("image")))


# --- trees and images ---


@_query(f"WITH {_TREE} SELECT image, path FROM dirs")
def implicit_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.implied_dirs(fx.files(spark, sf_dir), ("image",))


@_query(f"WITH {_TREE} SELECT * FROM t")
def preorder_nids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.nodes(fx.files(spark, sf_dir))


@_query(f"WITH {_TREE} SELECT image, parent_nid AS dir_nid, nid, name, CASE WHEN is_dir THEN 2 ELSE 1 END AS file_type FROM t WHERE nid <> 0")
def dir_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.children(tree.nodes(fx.files(spark, sf_dir)))


@_query(f"WITH {_TREE} SELECT d.image, d.nid, (SELECT count(*) FROM t c WHERE c.image = d.image AND c.parent_nid = d.nid AND c.nid <> 0) + 2 AS n_entries FROM t d WHERE d.is_dir")
def dir_child_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.child_counts(tree.nodes(fx.files(spark, sf_dir)))


@_query(f"""WITH {_LAYOUT}
SELECT l.image, nid, parent_nid, name, path, is_dir, mode, size, uid, gid, mtime, CAST(data_len AS BIGINT) AS data_len, CAST(n_blocks AS BIGINT) AS n_blocks,
  CAST(CASE WHEN data_len > 0 THEN 4096 * (first + sum(n_blocks) OVER (PARTITION BY l.image ORDER BY CASE WHEN is_dir THEN 0 ELSE 1 END, nid) - n_blocks) ELSE 0 END AS BIGINT) AS data_offset
FROM l JOIN b ON l.image = b.image""")
def image_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return image.layout(tree.nodes(fx.files(spark, sf_dir)))


@_query(f"WITH {_LAYOUT} SELECT image, inodes, CAST(first + k AS BIGINT) AS blocks FROM b")
def image_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return image.totals(tree.nodes(fx.files(spark, sf_dir)))


@_query(f"WITH {_ENTRIES} SELECT image, dir_nid, nid, name, file_type, idx, name_len, nameoff FROM o")
def dirent_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return image.dirent_offsets(tree.dirents(tree.nodes(fx.files(spark, sf_dir))))


@_query(f"""WITH {_ENTRIES}, dm AS (SELECT image, dir_nid, idx, nameoff - CASE WHEN nid % 11 = 5 THEN 500 ELSE 0 END AS nameoff FROM o),
nx AS (SELECT *, lead(nameoff) OVER (PARTITION BY image, dir_nid ORDER BY idx) AS after FROM dm)
SELECT image, dir_nid, idx, CAST(coalesce(after, 4096) - nameoff AS BIGINT) AS room, coalesce(after >= nameoff, true) AS monotonic FROM nx""")
def dirent_name_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged = dirent_offsets(spark, sf_dir).withColumn("nameoff", F.col("nameoff") - F.when(F.col("nid") % 11 == 5, 500).otherwise(0))
    return image.name_lengths(damaged).select("image", "dir_nid", "idx", "room", "monotonic")


@_query("""WITH e AS (SELECT source AS image, lang, 12 + strlen(CAST(doc_id AS VARCHAR) || '.txt') AS n FROM documents)
SELECT image, lang AS dir_name, CAST(sum(n) + 27 AS BIGINT) AS bytes FROM e GROUP BY image, lang HAVING sum(n) + 27 > 300""")
def dir_block_overflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.documents(spark, sf_dir).select(F.col("source").alias("image"), F.concat_ws("/", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"), F.lit(False).alias("is_dir"), "mode", "size")
    nodes = tree.nodes(rows)
    found = image.overflowing_dirs(tree.dirents(nodes), 300).where("dir_nid <> 0")
    return found.join(nodes.select("image", F.col("nid").alias("dir_nid"), F.col("name").alias("dir_name")), ["image", "dir_nid"]).select("image", "dir_name", "bytes")


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as files of images: (doc_id, image, path, ...). Those of a language are dealt along their ids to images that
    begin at most IMAGE_BLOCKS blocks apart (an empty file counts as one), so an image is bounded by
    that and one file, and its directory by so many entries."""
    docs = fx.documents(spark, sf_dir)
    blocks = F.greatest(F.ceil(F.col("size") / image.BLOCK), F.lit(1))
    placed = running(docs.select("lang", "doc_id", "mode", "size", "mod_time_ns"), "lang", [F.col("doc_id")], "idx", "before", blocks)
    name = F.concat("lang", F.lit("-"), F.floor(F.col("before") / IMAGE_BLOCKS).cast("string"))
    path = F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))
    return placed.select("doc_id", name.alias("image"), path.alias("path"), F.lit(False).alias("is_dir"), "mode", "size", "mod_time_ns", *fx.owners())


def _document_trees(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, contents and images as bytes of all documents."""
    docs, files = fx.documents(spark, sf_dir), _packed(spark, sf_dir)
    nodes = materialize(tree.nodes(files.drop("doc_id")), "nodes")
    places = nodes.where("NOT is_dir").join(files.select("doc_id", "image", "path"), ["image", "path"]).select("doc_id", "image", "nid")
    data = docs.select("doc_id", "content").join(places, "doc_id").select("image", "nid", "content")
    return nodes, data, materialize(image.build(nodes, data), "images", wide=True)


def _document_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _document_trees(spark, sf_dir)[2]


_PACKED = """pk AS (
  SELECT doc_id, lang, text, CAST(strlen(text) AS BIGINT) AS size, greatest(1, CAST(ceil(strlen(text) / 4096.0) AS BIGINT)) AS b FROM documents),
pl AS (SELECT *, lang || '-' || CAST((CAST(sum(b) OVER (PARTITION BY lang ORDER BY doc_id) AS BIGINT) - b) // 64 AS VARCHAR) AS image, CAST(doc_id AS VARCHAR) || '.txt' AS name FROM pk),
im AS (SELECT *, CAST(row_number() OVER (PARTITION BY image ORDER BY name) AS BIGINT) AS nid FROM pl),
su AS (SELECT image, count(*) + 1 AS inodes, CAST(sum(CAST(ceil(size / 4096.0) AS BIGINT)) + 1 AS BIGINT) AS k FROM im GROUP BY image),
hd AS (SELECT image, CAST(inodes AS BIGINT) AS inodes, CAST(1 + CAST(ceil(inodes * 32 / 4096.0) AS BIGINT) + k AS BIGINT) AS blocks FROM su)"""


@_query(f"WITH {_PACKED} SELECT image, nid, name, sha256(text) AS sha256, size FROM im")
def image_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written to images of bounded size, by language, and read back."""
    images = _document_images(spark, sf_dir)
    nodes = fsck.reached(images)
    names = image_source.dirents(images, nodes).where(~F.col("name").isin(".", "..")).select("image", "nid", "name")
    back = image_source.file_contents(images, nodes).join(names, ["image", "nid"])
    return back.select("image", "nid", "name", F.sha2("content", 256).alias("sha256"), F.length("content").cast("long").alias("size"))


@_query(f"""WITH {_PACKED}, im2 AS (SELECT image FROM hd),
dm AS (SELECT unnest(['magic', 'magic', 'checksum', 'blocks', 'blocks', 'short']) AS d, unnest(['invalid magic', 'checksum mismatch', 'checksum mismatch', 'checksum mismatch', 'zero blocks', 'truncated superblock']) AS message)
SELECT image || '-' || d AS image, 'InvalidSuperblock' AS code, CAST(NULL AS BIGINT) AS nid, message FROM im2, dm""")
def fsck_superblock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations of the images of all documents, each of them sound and with each damage."""
    images = _document_images(spark, sf_dir)
    at = lambda n, x: F.concat(F.substr("content", F.lit(1), F.lit(n)), F.unhex(F.lit(x)), F.substr("content", F.lit(n + 1 + len(x) // 2)))
    damage = {"none": F.col("content"), "magic": at(1024, "00"), "checksum": at(1028, "00000001"), "blocks": at(1024 + 36, "00000000"), "short": F.substr("content", F.lit(1), F.lit(1100))}
    each = images.select("image", "content", F.explode(F.array(*[F.lit(name) for name in damage])).alias("damage"))
    content = F.coalesce(*[F.when(F.col("damage") == name, made) for name, made in damage.items()])
    return fsck.fsck(each.select(F.concat_ws("-", "image", "damage").alias("image"), content.alias("content")))


# --- checks ---


@_query("""SELECT CAST(doc_id AS BIGINT) AS nid, CASE doc_id % 4 WHEN 0 THEN 'name holds a zero byte' WHEN 1 THEN 'name holds a slash' WHEN 2 THEN 'empty name' ELSE 'name is not UTF-8' END AS message, 'PathTraversal' AS code
FROM documents WHERE doc_id % 8 <> 7""")
def fsck_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 4
    name = F.when(k == 0, F.unhex(F.lit("610062"))).when(k == 1, F.lit("a/b").cast("binary")).when(k == 2, F.lit("").cast("binary")).when(F.col("doc_id") % 8 == 3, F.unhex(F.lit("61ff"))).otherwise(F.lit("fine.txt").cast("binary"))
    rows = fx.table(spark, sf_dir, "documents").select(F.lit("i").alias("image"), F.col("doc_id").alias("dir_nid"), name.alias("name"))
    return fsck.name_faults(rows).select("code", "nid", "message")


def _reached(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    edges = fx.edges(spark, sf_dir)
    roots = spark.range(1).select(F.lit("tree").alias("image"), F.col("id").alias("nid"))
    return edges, fsck.reach(edges, roots, WALK_DEPTH)


@_query(f"WITH RECURSIVE {_REACH} SELECT nid, depth, depth > {WALK_DEPTH} AS too_deep FROM r")
def fsck_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reached(spark, sf_dir)[1].select("nid", "depth", (F.col("depth") > WALK_DEPTH).alias("too_deep"))


@_query(f"""WITH RECURSIVE {_EDGES},
p AS (SELECT parent AS a, child AS b FROM e UNION SELECT p.a, i.child FROM p JOIN e i ON i.parent = p.b)
SELECT DISTINCT CAST(a AS BIGINT) AS nid FROM p WHERE a = b""")
def fsck_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fsck.cycle_nodes(fx.edges(spark, sf_dir)).select("nid")


@_query(f"WITH RECURSIVE {_REACH} SELECT count(*) AS n, count(*) > 30 + 100 AS too_many FROM r")
def fsck_inode_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reached(spark, sf_dir)[1].agg(F.count("*").alias("n")).withColumn("too_many", F.col("n") > 30 + fsck.SPARE_INODES)


@_query("""WITH i AS (SELECT p_partkey AS nid, p_size * 1000 AS size, p_partkey % 50 AS addr, CASE p_partkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 1 END AS lay FROM part),
b AS (SELECT *, CASE WHEN lay = 0 THEN CAST(ceil(size / 4096.0) AS BIGINT) ELSE size // 4096 END AS n FROM i)
SELECT nid, 'InvalidInode' AS code, CASE WHEN lay = 1 THEN 'unsupported data layout' WHEN n > 0 AND addr + n > 40 THEN 'block address out of bounds' ELSE 'inline data crosses its block' END AS message
FROM b WHERE lay = 1 OR (n > 0 AND addr + n > 40) OR (lay = 2 AND size % 4096 > 0 AND (nid * 32) % 4096 + 32 + size % 4096 > 4096)""")
def fsck_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    nodes = fx.table(spark, sf_dir, "part").select(
        F.lit("i").alias("image"), c("p_partkey").alias("nid"), (c("p_partkey") * 32).alias("inode_offset"), F.lit(0).alias("version"), F.lit(0).alias("xattr_icount"), F.lit(0o100644).alias("mode"),
        (c("p_size") * 1000).alias("size"), (c("p_partkey") % 50).alias("raw_blkaddr"), F.when(c("p_partkey") % 3 == 0, 0).when(c("p_partkey") % 3 == 1, 2).otherwise(1).alias("data_layout"), F.lit(True).alias("whole"),
    )
    return fsck.data_faults(nodes, F.lit(40)).select("nid", "code", "message")


# --- mounts and accesses ---


@_query("""WITH m AS (SELECT DISTINCT source AS mount FROM documents UNION SELECT DISTINCT source || '/en' FROM documents WHERE source <= 'src15'),
f AS (SELECT source || '/' || lang || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS path FROM documents UNION ALL SELECT 'elsewhere/' || CAST(doc_id AS VARCHAR) FROM documents),
b AS (SELECT f.path, max(m.mount) AS mount FROM f JOIN m ON f.path = m.mount OR starts_with(f.path, m.mount || '/') GROUP BY f.path)
SELECT f.path, b.mount, substr(f.path, length(b.mount) + 2) AS rel_path FROM f LEFT JOIN b ON f.path = b.path""")
def mount_longest_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fx.documents(spark, sf_dir)
    m = docs.select(F.col("source").alias("mount")).unionByName(docs.where("source <= 'src15'").select(F.concat("source", F.lit("/en")).alias("mount"))).distinct()
    wanted = docs.select("path").unionByName(docs.select(F.concat(F.lit("elsewhere/"), F.col("doc_id").cast("string")).alias("path")))
    return mounts.resolve(wanted, m).select("path", "mount", "rel_path")


@_query("""SELECT c_custkey, 'k' || CAST(c_custkey AS VARCHAR) AS volume_id,
  CASE WHEN s_suppkey IS NOT NULL AND s_suppkey % 5 <> 0 THEN s_name ELSE 'k' || CAST(c_custkey AS VARCHAR) END AS logical_id FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey""")
def volume_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = lambda c: F.concat(F.lit("k"), F.col(c).cast("string"))
    volumes = fx.table(spark, sf_dir, "customer").select("c_custkey", key("c_custkey").alias("volume_id"))
    names = fx.table(spark, sf_dir, "supplier").select(key("s_suppkey").alias("volume_id"), F.when(F.col("s_suppkey") % 5 == 0, "").otherwise(F.col("s_name")).alias("logical_id"))
    return mounts.logical_ids(volumes, names)


@_query(f"""WITH {_ACCESS}
SELECT a.event_id, a.path, CASE WHEN pid = 3 THEN 'self' WHEN p.path IS NULL THEN 'ready' WHEN NOT p.ok THEN 'initiator'
    WHEN struct_pack(ts := a.ts, e := a.event_id) = fi.m THEN 'initiator' ELSE 'loaded' END AS role,
  CASE WHEN pid = 3 OR p.path IS NULL OR p.ok THEN 'allow' ELSE 'deny' END AS decision
FROM acc a LEFT JOIN pe p ON p.path = a.path LEFT JOIN fi ON fi.path = a.path""")
def access_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = access.decide(fx.access(spark, sf_dir), fx.pending(spark, sf_dir), fx.blobs(spark, sf_dir), fx.SELF_PID)
    return out.select("event_id", "path", "role", "decision")


@_query(f"""WITH {_ACCESS}
SELECT a.path, min(a.event_id) AS event_id, count(*) AS n FROM acc a JOIN pe p ON p.path = a.path AND p.ok JOIN fi ON fi.path = a.path
WHERE pid <> 3 AND struct_pack(ts := a.ts, e := a.event_id) = fi.m GROUP BY a.path""")
def access_single_flight(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = access.decide(fx.access(spark, sf_dir), fx.pending(spark, sf_dir), fx.blobs(spark, sf_dir), fx.SELF_PID)
    return out.where("role = 'initiator' AND decision = 'allow'").groupBy("path").agg(F.min("event_id").alias("event_id"), F.count("*").alias("n"))


# --- operation logs ---


@_query(f"""WITH {_OPLOG}, en AS (SELECT file_id, max(seq) AS last, max(epoch) AS epoch FROM ep GROUP BY file_id),
lv AS (SELECT en.* FROM en JOIN ep ON ep.file_id = en.file_id AND ep.seq = en.last WHERE ep.alive)
SELECT ep.file_id, string_agg(arg, '' ORDER BY seq) AS content, count(*) AS n_parts FROM ep JOIN lv ON ep.file_id = lv.file_id AND ep.epoch = lv.epoch
WHERE eff AND op IN ('create', 'append', 'overwrite') GROUP BY ep.file_id""")
def oplog_final_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oplog.final_state(fx.oplog(spark, sf_dir))


@_query(f"""WITH {_OPLOG}, mk AS (SELECT file_id, seq AS step, epoch FROM ep WHERE seq % 10 = 0 AND alive)
SELECT mk.file_id, CAST(mk.step AS INTEGER) AS step, sha256(string_agg(arg, '' ORDER BY seq)) AS content_sha256, count(*) AS n_parts
FROM mk JOIN ep ON ep.file_id = mk.file_id AND ep.epoch = mk.epoch AND ep.seq <= mk.step
WHERE eff AND op IN ('create', 'append', 'overwrite') GROUP BY mk.file_id, mk.step""")
def oplog_verify_every_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oplog.checkpoints(fx.oplog(spark, sf_dir)).select("file_id", "step", F.sha2("content", 256).alias("content_sha256"), "n_parts")


# --- scalar functions ---


@_query("""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path FROM pages),
q AS (SELECT page_id, path, list_filter(string_split(path, '/'), lambda x: x <> '') AS c FROM p)
SELECT page_id, CAST(len(c) AS INTEGER) AS depth, c[len(c)] AS base, array_to_string(c[1:len(c) - 1], '/') AS parent, array_to_string(c, '/') AS clean,
  array_to_string(list_transform(range(1, len(c) + 1), lambda i: array_to_string(c[1:i], '/')), ' ') AS ancestors FROM q""")
def scalar_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fx.table(spark, sf_dir, "pages").select("page_id", fx.url_path().alias("path"))
    c = F.col("path")
    return p.select("page_id", F.size(paths.parts(c)).alias("depth"), paths.base(c).alias("base"), paths.parent(c).alias("parent"), F.array_join(paths.parts(c), "/").alias("clean"), F.array_join(paths.ancestors(c), " ").alias("ancestors"))


@_query("""SELECT doc_id, CAST(CASE WHEN quality = 1 THEN 16384 WHEN toxic = 1 THEN 40960 ELSE 32768 END + 384 + doc_id % 77 AS BIGINT) AS mode,
  CAST(CASE WHEN quality = 1 THEN 2 WHEN toxic = 1 THEN 7 ELSE 1 END AS INTEGER) AS file_type FROM labels""")
def mode_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.table(spark, sf_dir, "labels")
    mode = modes.with_type(F.lit(0o600) + F.col("doc_id") % 77, F.col("quality") == 1, F.col("toxic") == 1)
    return rows.select("doc_id", mode.cast("long").alias("mode")).withColumn("file_type", modes.dirent_type(F.col("mode")))


@_query("""SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'unix' WHEN 1 THEN 'tcp' END AS scheme,
  CASE WHEN s_suppkey % 8 = 4 THEN '' WHEN s_suppkey % 4 = 0 THEN '/run/' || s_name WHEN s_suppkey % 4 = 1 THEN s_name || ':50051' END AS address FROM supplier""")
def endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, name = F.col("s_suppkey") % 4, F.col("s_name")
    text = F.when(F.col("s_suppkey") % 8 == 4, "unix://").when(k == 0, F.concat(F.lit("unix:///run/"), name)).when(k == 1, F.concat(F.lit("tcp://"), name, F.lit(":50051"))).when(k == 2, F.concat(F.lit("http://"), name)).otherwise(name)
    e = fx.table(spark, sf_dir, "supplier").select("s_suppkey", bf.parse_endpoint(text).alias("e"))
    return e.select("s_suppkey", F.col("e.scheme").alias("scheme"), F.col("e.address").alias("address"))


# --- reading images, publishing, messages, requests ---


@_query(f"WITH {_PACKED} SELECT image, inodes, blocks, CAST(3774210530 AS BIGINT) AS magic, CAST(12 AS BIGINT) AS blkszbits, CAST(1 AS BIGINT) AS meta_blkaddr, CAST(0 AS BIGINT) AS root_nid, CAST(4096 AS BIGINT) AS block_size, true AS sound FROM hd")
def superblock_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = image_source.superblocks(_document_images(spark, sf_dir))
    return heads.select("image", "inodes", "blocks", "magic", "blkszbits", "meta_blkaddr", "root_nid", "block_size", (F.col("checksum") == F.col("expected")).alias("sound"))


@_query(f"""WITH {_PACKED} SELECT image, nid, CAST(33188 AS BIGINT) AS mode, size, CAST(1 AS BIGINT) AS nlink, doc_id % 1000 AS uid, doc_id % 77 AS gid, nid AS ino FROM im
UNION ALL SELECT image, 0, 16877, 4096, 2, 0, 0, 0 FROM hd""")
def inode_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return image_source.inodes(_document_images(spark, sf_dir)).select("image", "nid", "mode", "size", "nlink", "uid", "gid", "ino")


@_query(f"""WITH {_PACKED}, en AS (SELECT image, nid, name, 1 AS file_type, 2 AS g FROM im UNION ALL SELECT image, 0, '.', 2, 0 FROM hd UNION ALL SELECT image, 0, '..', 2, 1 FROM hd)
SELECT image, CAST(0 AS BIGINT) AS dir_nid, CAST(row_number() OVER (PARTITION BY image ORDER BY g, name) - 1 AS INTEGER) AS idx, nid, name, CAST(file_type AS BIGINT) AS file_type FROM en""")
def image_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return image_source.dirents(_document_images(spark, sf_dir)).select("image", "dir_nid", "idx", "nid", "name", "file_type")


@_query(f"WITH {_PACKED} SELECT hd.image, hd.inodes AS n_reached, CAST(sum(size) AS BIGINT) AS bytes, CASE WHEN hd.inodes > 101 THEN 'more inodes than declared' END AS message FROM hd JOIN im ON hd.image = im.image GROUP BY hd.image, hd.inodes")
def fsck_sparse_nids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images that declare one inode and use slots beyond: all are read; the count alone is at fault."""
    images = _document_images(spark, sf_dir)
    one = lambda b: F.concat(F.substr(b, F.lit(1), F.lit(1028)), F.unhex(F.lit("00" * 4)), F.substr(b, F.lit(1033), F.lit(8)), F.unhex(F.lit("01" + "00" * 7)), F.substr(b, F.lit(1049)))
    sparse = materialize(images.select("image", one(F.col("content")).alias("content")), "sparse", wide=True)
    walked = fsck.walk(sparse)
    sums = fsck.reached(sparse, walked=walked).groupBy("image").agg(F.count("*").alias("n_reached"), F.sum(F.when(F.col("nid") > 0, F.col("size"))).alias("bytes"))
    return sums.join(fsck.fsck(sparse, walked=walked).select("image", "message"), "image", "left")


@_query("""WITH r AS (SELECT p_partkey AS nid, p_partkey % 7 AS k FROM part)
SELECT nid, 'InvalidDirectoryBlock' AS code, CASE k WHEN 0 THEN 'block too small' WHEN 1 THEN 'invalid first name offset' WHEN 2 THEN 'reserved byte is not zero' WHEN 3 THEN 'name offsets go back' ELSE 'name beyond the block' END AS message
FROM r WHERE k < 5""")
def fsck_dir_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 7
    raw = fx.table(spark, sf_dir, "part").select(
        F.lit("i").alias("image"), F.col("p_partkey").alias("dir_nid"), F.when(k < 2, F.lit(None)).otherwise(F.lit(3)).cast("int").alias("idx"), F.when(k == 0, 8).otherwise(4096).cast("long").alias("block_bytes"),
        F.when(k == 2, 1).otherwise(0).cast("long").alias("reserved"), F.when(k == 3, -4).when(k == 4, 100).otherwise(9).cast("long").alias("room"), F.when(k == 4, 4000).otherwise(40).cast("long").alias("nameoff"),
    )
    return fsck.dirent_faults(raw).select("nid", "code", "message")


@_query(f"""WITH {_PACKED} SELECT image, name AS path, CASE WHEN doc_id % 10 = 0 THEN 'unexpected' WHEN doc_id % 10 = 1 THEN 'missing' WHEN doc_id % 10 = 2 THEN 'other mode' WHEN doc_id % 10 = 3 THEN 'other size' ELSE 'other content' END AS problem
FROM im WHERE doc_id % 10 < 4 OR (doc_id % 10 = 4 AND size > 0)""")
def image_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images against trees that differ by rule: what is missing here, unexpected there, or other."""
    nodes, data, images = _document_trees(spark, sf_dir)
    k = F.try_to_number(F.regexp_extract("path", "^([0-9]+)", 1), F.lit("999999999999")).cast("long") % 10
    changed = nodes.where(F.col("is_dir") | (k != 0)).withColumns({
        "path": F.when(~F.col("is_dir") & (k == 1), F.concat("path", F.lit(".none"))).otherwise(F.col("path")),
        "mode": F.when(~F.col("is_dir") & (k == 2), F.col("mode") + 1).otherwise(F.col("mode")), "size": F.when(~F.col("is_dir") & (k == 3), F.col("size") + 1).otherwise(F.col("size")),
    })
    other = data.join(nodes.where(~F.col("is_dir")).select("image", "nid", (k == 4).alias("other")), ["image", "nid"])
    other = other.withColumn("content", F.when(F.col("other"), F.concat(F.unhex(F.lit("00")), F.substr(F.col("content").cast("binary"), F.lit(2)))).otherwise(F.col("content").cast("binary")))
    # A file of another name is missing under it and unexpected under its own: the first of both is kept.
    found = image.compare(changed, images, other.drop("other"))
    return found.where(~((F.col("problem") == "unexpected") & (k == 1))).withColumn("path", F.regexp_replace("path", "\\.none$", ""))


@_query(f"""WITH {_PACKED}
SELECT image, nid, size, size >= 1000 AS zeros, CASE WHEN size < 1000 THEN sha256(text) END AS sha256 FROM im""")
def image_on_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest snapshots compiled to images, files from 1000 bytes on as zeros, and read back. Volumes are
    as bounded as the images of all documents are."""
    rows = _packed(spark, sf_dir).join(fx.documents(spark, sf_dir).select("doc_id", "sha256"), "doc_id")
    rows = rows.select(F.col("image").alias("volume_id"), F.lit(1).cast("long").alias("version"), "path", "mode", "size", "mod_time_ns", "sha256")
    images = materialize(publish.images_on_read(rows, fx.all_blobs(spark, sf_dir), 1000), "images", wide=True)
    nodes = fsck.reached(images).where("nid > 0")
    back = image_source.file_contents(images, nodes).select("image", "nid", F.octet_length("content").cast("long").alias("size"), F.sha2("content", 256).alias("s"), F.hex("content").alias("h"))
    zeros = (F.col("size") >= 1000) & ~F.col("h").rlike("[1-9A-F]")
    return back.select("image", "nid", "size", zeros.alias("zeros"), F.when(~zeros, F.col("s")).alias("sha256"))


@_query(f"WITH {_FILES} SELECT source AS volume_id, CAST(3 AS BIGINT) AS version, {_COLUMNS} FROM files")
def message_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest snapshots written as protobuf messages, in pieces, and read back."""
    pieces = materialize(messages.encode(snapshot_latest(spark, sf_dir), 100), "messages")
    return messages.files(pieces).select("volume_id", "version", *fx.FILE_COLUMNS)


@_query(f"WITH {_FILES} SELECT source AS volume_id, CAST(1 AS BIGINT) AS version, {_COLUMNS} FROM files WHERE doc_id % 4 <= 1")
def snapshot_pinned(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = fx.manifest(spark, sf_dir)
    return snapshot.pinned(manifest, manifest.where("version = 1").select("volume_id", "version").distinct()).select("volume_id", "version", *fx.FILE_COLUMNS)


@_query(f"WITH {_FILES} SELECT source AS volume_id, count(*) AS n FROM files WHERE source NOT IN ('src1', 'src12') GROUP BY source")
def volume_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = snapshot_latest(spark, sf_dir)
    gone = rows.where("volume_id IN ('src1', 'src12')").select("volume_id")
    return snapshot.without_volumes(rows, gone).groupBy("volume_id").agg(F.count("*").alias("n"))


@_query("SELECT source AS volume_id, CAST(sum(CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 1 END) AS BIGINT) AS n_changes FROM documents GROUP BY source HAVING sum(CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 1 END) > 0")
def changed_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("doc_id") % 3 == 0, "dir").when(F.col("doc_id") % 3 == 1, "file").otherwise("whiteout")
    return snapshot.changed_volumes(fx.documents(spark, sf_dir).select(F.col("source").alias("volume_id"), kind.alias("kind")))


@_query(f"""WITH {_FILES}, n AS (SELECT source, path, sha256, (row_number() OVER (PARTITION BY source ORDER BY path) - 1) // 16 AS part FROM files)
SELECT source AS volume_id, CAST(part AS BIGINT) AS part, count(*) AS n_files, string_agg(path || ':' || sha256, ',' ORDER BY path) AS listed FROM n GROUP BY source, part""")
def snapshot_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = snapshot.as_lists(snapshot_latest(spark, sf_dir), 16)
    listed = F.array_join(F.transform("files", lambda f: F.concat_ws(":", f["path"], f["sha256"])), ",")
    return lists.select("volume_id", "part", F.size("files").cast("long").alias("n_files"), listed.alias("listed"))


@_query(f"""WITH {_SNAPS} SELECT volume_id, CASE WHEN len(own) > 0 THEN 'layers' ELSE 'files' END AS stacks, CASE WHEN image_sha256 <> '' THEN 'image' ELSE 'files' END AS images, 'files' AS neither FROM e""")
def restore_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    way = lambda **o: restore.mode(F.col("layers"), F.col("image_sha256"), **o)
    return fx.snapshots(spark, sf_dir).select("volume_id", way(images=True, stacks=True).alias("stacks"), way(images=True).alias("images"), way().alias("neither"))


@_query("""SELECT doc_id AS stream_id, CASE doc_id % 4 WHEN 2 THEN 'content before digest' ELSE 'message with both or neither of digest and content' END AS fault FROM documents WHERE doc_id % 4 > 1""")
def upload_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams of a header and content; of a header alone; of content first; of an empty message."""
    docs, k, none = fx.documents(spark, sf_dir), F.col("doc_id") % 4, F.lit(None).cast("string")
    head = docs.select(F.col("doc_id").alias("stream_id"), F.when(k == 2, 2).otherwise(0).alias("seq"), "sha256", none.alias("content"))
    body = docs.where(k != 1).select(F.col("doc_id").alias("stream_id"), F.lit(1).alias("seq"), none.alias("sha256"), F.when(k != 3, F.col("content")).alias("content"))
    return blobs.stream_faults(head.unionByName(body))


@_query("""WITH w AS (SELECT doc_id, text, CAST(strlen(text) AS BIGINT) AS size FROM documents)
SELECT doc_id, CAST(i AS INTEGER) AS chunk_idx, CAST(i * 8192 AS BIGINT) AS "offset", CAST(greatest(0, least(8192, size - i * 8192)) AS BIGINT) AS n_bytes, CASE WHEN size <= 8192 THEN sha256(text) END AS sha256
FROM (SELECT *, unnest(range(0, CAST(greatest(1, ceil(size / 8192.0)) AS BIGINT))) AS i FROM w)""")
def blob_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = fx.documents(spark, sf_dir).select("doc_id", "size", F.concat(F.lit(" "), F.upper("sha256"), F.lit("\n")).alias("sha256"))
    rows = blobs.read(wanted, fx.all_blobs(spark, sf_dir), 8192)
    return rows.select("doc_id", "chunk_idx", "offset", F.octet_length("content").cast("long").alias("n_bytes"), F.when(F.col("size") <= 8192, F.sha2("content", 256)).alias("sha256"))


@_query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN event_id WHEN 1 THEN -event_id END AS size,
  CASE event_id % 5 WHEN 2 THEN 'server error: not found' WHEN 3 THEN 'unexpected server response: HELLO' WHEN 4 THEN 'invalid size: 12x' END AS error FROM events""")
def cas_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("event_id") % 5, F.col("event_id").cast("string")
    text = F.when(k == 0, F.concat(F.lit("OK "), n, F.lit("\r\n"))).when(k == 1, F.concat(F.lit("OK -"), n)).when(k == 2, "ERR not found\n").when(k == 3, "HELLO").otherwise("OK 12x")
    got = fx.table(spark, sf_dir, "events").select("event_id", bf.parse_reply(text).alias("r"))
    return got.select("event_id", F.col("r.size").alias("size"), F.col("r.error").alias("error"))


@_query(f"""WITH {_FILES}, a AS (SELECT source AS image, CAST(doc_id AS VARCHAR) AS d, text, doc_id FROM files)
SELECT image, d || '/' || 'f.txt' AS path, false AS is_dir, CAST(384 + doc_id % 64 AS INTEGER) AS mode, CAST(strlen(text) AS BIGINT) AS size, sha256(text) AS sha256 FROM a
UNION ALL SELECT image, d, true, 493, 0, sha256('') FROM a""")
def tree_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees of two nodes each, given as four parallel arrays."""
    name = F.col("doc_id").cast("string")
    text = F.col("content").cast("binary")
    rows = fx.documents(spark, sf_dir).select(
        F.col("source").alias("image"), F.array(F.concat(F.lit("/"), name, F.lit("//f.txt")), name).alias("paths"), F.array(F.lit(False), F.lit(True)).alias("is_dirs"),
        F.array(text, F.unhex(F.lit(""))).alias("contents"), F.array((F.lit(384) + F.col("doc_id") % 64).cast("int"), F.lit(493)).alias("modes"),
    )
    return tree.from_arrays(rows).select("image", "path", "is_dir", "mode", "size", F.sha2("content", 256).alias("sha256"))


@_query("SELECT doc_id, 1600000000 + doc_id // 1000000 AS seconds, 1600000000 - 1 - doc_id // 1000000000 AS before FROM documents")
def unix_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    ns = F.lit(fx.EPOCH_NS) + F.col("doc_id") * 1000
    return fx.table(spark, sf_dir, "documents").select("doc_id", modes.unix_seconds(ns).alias("seconds"), modes.unix_seconds(F.lit(fx.EPOCH_NS) - F.col("doc_id") - 1).alias("before"))


def queries() -> dict:
    return {name: f for name, (f, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
