"""Snapshots, layers, blobs, trees, logs and accesses on small inputs, with models in plain Python."""

import random
import struct
import zlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from snapweave.functions import blobs as bf
from snapweave.functions import modes, paths
from snapweave.operators import access, blobs, fsck, image, layers, mounts, oplog, restore, snapshot, tree
from snapweave.plans.durable import materialize
from snapweave.sources import directory
from snapweave.sources import image as source
from snapweave.streaming.lazyload import decide_stream

FILES = "path string, sha256 string"


def pairs(df):
    return sorted(tuple(r) for r in df.collect())


# --- functions ---


def test_blob_ids(spark):
    sha = "0123456789abcdef" * 4
    rows = [(sha,), (sha.upper(),), ("short",), ("g" * 64,), (None,)]
    got = [tuple(r[0]) for r in spark.createDataFrame(rows, "x string").select(bf.parse_blob_id(F.col("x"))).collect()]
    assert got[:2] == [(sha, None)] * 2 and all(r[0] is None and r[1].startswith("invalid sha256") for r in got[2:])


def test_paths(spark):
    df = spark.createDataFrame([("a/b//c",), ("",), ("x",)], "p string")
    got = df.select(paths.parts(F.col("p")), paths.base(F.col("p")), paths.parent(F.col("p")), paths.ancestors(F.col("p"))).collect()
    assert [tuple(r) for r in got] == [(["a", "b", "c"], "c", "a/b", ["a", "a/b", "a/b/c"]), ([], ".", "", []), (["x"], "x", "", ["x"])]


def test_little_endian(spark):
    values = [0, 1, 255, 256, 0xE0F5E1E2, 2**31, 2**40 + 5]
    df = spark.createDataFrame([(v, struct.pack("<Q", v)) for v in values], "v long, b binary")
    got = df.select(modes.read_le(F.col("b"), 0, 8), modes.write_le(F.col("v"), 8), modes.read_le(F.col("b"), 0, 4), modes.read_le(F.col("b"), 5, 4)).collect()
    assert [r[0] for r in got] == values and [bytes(r[1]) for r in got] == [struct.pack("<Q", v) for v in values]
    assert [r[2] for r in got] == [v & 0xFFFFFFFF for v in values] and {r[3] for r in got} == {None}
    with pytest.raises(Exception, match="does not fit"):
        df.select(modes.write_le(F.col("v"), 2)).collect()


# --- snapshots ---


def test_incremental_commit(spark):
    base = spark.createDataFrame([("file1.txt", "a"), ("file2.txt", "b")], FILES)
    delta = spark.createDataFrame([("file1.txt", None, "whiteout"), ("file3.txt", "c", "file")], FILES + ", kind string")
    assert pairs(snapshot.commit(base, delta)) == [("file2.txt", "b"), ("file3.txt", "c")]


def test_whiteout_is_by_component(spark):
    base = spark.createDataFrame([("a/b", "1"), ("a/bc", "2"), ("a/b/c", "3"), ("ab", "4")], FILES)
    delta = spark.createDataFrame([("a/b", None, "whiteout")], FILES + ", kind string")
    assert pairs(snapshot.commit(base, delta)) == [("a/bc", "2"), ("ab", "4")]


def test_type_changes_and_opaque(spark):
    base = spark.createDataFrame([("a", "1"), ("b/c", "2"), ("d/e", "3")], FILES)
    delta = spark.createDataFrame([("a/x", "4", "file"), ("b", "5", "file"), ("d", None, "opaque"), ("d/n", "6", "file")], FILES + ", kind string")
    assert pairs(snapshot.commit(base, delta)) == [("a", "1"), ("a/x", "4"), ("b", "5"), ("b/c", "2"), ("d/e", "3"), ("d/n", "6")]
    assert pairs(snapshot.commit(base, delta, opaque=True, strict=True)) == [("a/x", "4"), ("b", "5"), ("d/n", "6")]


def test_latest_and_append(spark, tmp_path):
    rows = [("v1", 1, "a"), ("v1", 2, "b"), ("v1", 2, "c"), ("v10", 1, "d")]
    m = spark.createDataFrame(rows, "volume_id string, version long, path string")
    assert pairs(snapshot.latest(m)) == [("v1", 2, "b"), ("v1", 2, "c"), ("v10", 1, "d")]
    assert pairs(snapshot.latest(m, "v1")) == [("v1", 2, "b"), ("v1", 2, "c")] and snapshot.latest(m, "none").count() == 0
    snapshot.append_version(m.where("volume_id = 'v1'"), str(tmp_path), "v1", 2)
    with pytest.raises(Exception, match="(?i)exist"):
        snapshot.append_version(m, str(tmp_path), "v1", 2)


# --- layers ---


def model_stack(rows):
    seen = {}
    for idx in sorted({r[0] for r in rows}):
        for _, path, kind, _ in [r for r in rows if r[0] == idx and r[2] == "whiteout"]:
            seen = {p: v for p, v in seen.items() if p != path and not p.startswith(path + "/")}
        for i, path, kind, sha in [r for r in rows if r[0] == idx and r[2] == "file"]:
            seen[path] = (i, path, kind, sha)
    return sorted(seen.values())


def test_layer_stack_against_folding(spark):
    rnd = random.Random(4)
    names = ["a", "b", "a/x", "a/y", "b/x/z", "b/x", "c"]
    for _ in range(6):
        rows = {}
        for _ in range(25):
            i, p = rnd.randrange(5), rnd.choice(names)
            rows[i, p] = (i, p, rnd.choice(["file", "file", "whiteout"]), str(rnd.random()))
        rows = [r if r[2] == "file" else (*r[:3], None) for r in rows.values()]
        # a whiteout and a file below it do not stand in one layer
        rows = [r for r in rows if not any(w[0] == r[0] and w[2] == "whiteout" and r[1].startswith(w[1] + "/") for w in rows)]
        df = spark.createDataFrame(rows, "layer_idx int, path string, kind string, sha256 string")
        assert pairs(layers.stack(df)) == model_stack(rows)


def test_layers_one_two_one(spark):
    s = spark.createDataFrame([("v", None, [])], "volume_id string, image_sha256 string, layers array<string>")
    counts = []
    for k in range(3):
        new = spark.createDataFrame([("v", f"l{k}")], "volume_id string, sha256 string")
        s = layers.commit_layer(s, new)
        counts.append(len(s.first().layers))
    assert counts == [1, 2, 1]


def test_conflicts(spark):
    kind = "volume_id string, layers array<string>"
    local = spark.createDataFrame([("a", ["x"]), ("b", ["x", "y"]), ("c", ["z"]), ("d", ["q"])], kind)
    server = spark.createDataFrame([("a", ["x"]), ("b", ["x"]), ("c", ["y"])], kind)
    assert [(r.volume_id, r.first_difference) for r in layers.conflicts(local, server).orderBy("volume_id").collect()] == [("b", 1), ("c", 0)]


# --- blobs and restore ---


def test_chunks_and_strict_join(spark):
    rows = [("e", 0, b""), ("s", 5, b"12345"), ("l", 10, b"0123456789")]
    b = spark.createDataFrame(rows, "sha256 string, size long, content binary")
    cut = blobs.chunks(b, 4)
    assert [(r[0], r[1], r[2]) for r in cut.orderBy("sha256", "chunk_idx").collect()] == [("e", 0, 0), ("l", 0, 0), ("l", 1, 4), ("l", 2, 8), ("s", 0, 0), ("s", 1, 4)]
    assert blobs.reconcile(cut, b).where("NOT complete").count() == 0
    assert {r.sha256: bytes(r.content) for r in blobs.assemble(cut).collect()} == {r[0]: r[2] for r in rows}
    want = spark.createDataFrame([("p", "s"), ("q", "none")], "path string, sha256 string")
    with pytest.raises(Exception, match="missing blob none"):
        blobs.with_content(want, b).collect()
    assert blobs.corrupt(b).count() == 3


def test_requests(spark):
    sha = "ab" * 32
    lines = spark.createDataFrame([(f"get {sha.upper()}",), ("GET",), ("",), ("PUT x",), ("GET zz",), ("GET " + "c" * 64,)], "line string")
    have = spark.createDataFrame([(sha, 7)], "sha256 string, size long")
    got = {r.line: (r.reply, r.source) for r in blobs.answer(lines, have.limit(0), have).collect()}
    assert got[f"get {sha.upper()}"] == ("OK 7", "origin") and got["GET"][0] == got["PUT x"][0] == "ERR invalid command"
    assert "" not in got and got["GET " + "c" * 64] == ("ERR not found", None) and got["GET zz"][0].startswith("ERR invalid")


def test_restore_plan(spark):
    snap = spark.createDataFrame([("a", 10, "1"), ("b", 5000, "2"), ("c", 0, "3")], "path string, size long, sha256 string")
    local = spark.createDataFrame([("a", "1"), ("b", "other")], FILES)
    act = lambda t: {r.path: r.action for r in restore.plan(snap, local, t).collect()}
    assert act(-1) == {"a": "skip", "b": "eager", "c": "eager"} and act(0) == {"a": "skip", "b": "lazy", "c": "lazy"} and act(4096)["b"] == "lazy" and act(4096)["c"] == "eager"
    assert {r.action for r in restore.drained(restore.plan(snap, local, 0)).collect()} == {"skip", "eager"}


# --- trees and images ---


@pytest.fixture(scope="module")
def built(spark):
    rows = [("i", "hello.txt", False, 0o644, b"hello world"), ("i", "foo/bar.txt", False, 0o644, b"bar"), ("i", "foo/baz", True, 0o755, b""), ("i", "foo/baz/deep.txt", False, 0o600, b"x" * 5000), ("i", "sym_link", False, 0o120777, b"hello.txt"), ("i", "empty", False, 0o644, b""), ("i", "a.txt", False, 0o644, b"1"), ("i", "a/b", False, 0o644, b"2")]
    files = spark.createDataFrame([(*r[:4], len(r[4]), r[4]) for r in rows], "image string, path string, is_dir boolean, mode int, size long, content binary")
    nodes = materialize(tree.nodes(files.drop("content")), "nodes")
    data = nodes.where("NOT is_dir").join(files.select("image", "path", "content"), ["image", "path"]).select("image", "nid", "content")
    return rows, nodes, materialize(image.build(nodes, data), "images")


def test_preorder(built):
    order = [r.path for r in built[1].orderBy("nid").collect()]
    assert order == ["", "a", "a/b", "a.txt", "empty", "foo", "foo/bar.txt", "foo/baz", "foo/baz/deep.txt", "hello.txt", "sym_link"]


def test_image_round_trip(built):
    rows, nodes, images = built
    raw = bytes(images.first().content)
    total = image.totals(nodes).first()
    head = bytearray(raw[1024:1152])
    crc = struct.unpack("<I", head[4:8])[0]
    head[4:8] = b"\0" * 4
    assert crc == zlib.crc32(head) and len(raw) == total.blocks * 4096 and struct.unpack("<Q", raw[1040:1048])[0] == 11
    by_nid = {r.nid: r for r in nodes.collect()}
    content = {by_nid[r.nid].path: bytes(r.content) for r in source.file_contents(images).collect() if not by_nid[r.nid].is_dir}
    assert content == {r[1]: r[4] for r in rows if not r[2]}
    names = {}
    for r in source.dirents(images).collect():
        names.setdefault(by_nid[r.dir_nid].path, []).append((r.name, r.nid, r.file_type))
    for path, found in names.items():
        own = next(n for n in by_nid.values() if n.path == path)
        kids = [(n.name, n.nid, {True: 2}.get(n.is_dir, 7 if n.mode & 0o170000 == 0o120000 else 1)) for n in by_nid.values() if n.nid and n.parent_nid == own.nid]
        assert sorted(found) == sorted([*kids, (".", own.nid, 2), ("..", own.parent_nid, 2)])


def test_fsck(spark, built):
    raw = bytes(built[2].first().content)
    nodes = {r.path: r for r in image.layout(built[1]).collect()}

    def damaged(at, data):
        b = bytearray(raw)
        b[at : at + len(data)] = data
        return bytes(b)

    root, foo = nodes[""].data_offset, nodes["foo"].data_offset
    name = raw.index(b"hello.txt", root)
    inode = lambda p: 4096 + 32 * nodes[p].nid
    first = struct.unpack("<H", raw[root + 8 : root + 10])[0]
    cases = {
        "good": (raw, set()),
        "magic": (damaged(1024, b"\0"), {"InvalidSuperblock"}),
        "checksum": (damaged(1028, bytes([raw[1028] ^ 255])), {"InvalidSuperblock"}),
        "unchecked": (damaged(1028, b"\0" * 4), set()),
        "short": (raw[:1100], {"InvalidSuperblock"}),
        "zero byte": (damaged(name, b"\0"), {"PathTraversal"}),
        "slash": (damaged(name + 2, b"/"), {"PathTraversal"}),
        "utf-8": (damaged(name, b"\xff"), {"PathTraversal"}),
        "cycle": (damaged(inode("foo/baz") + 16, raw[inode("foo") + 16 : inode("foo") + 20]), {"CycleDetected"}),
        "bounds": (damaged(inode("foo/baz/deep.txt") + 16, b"\xff\xff\0\0"), {"InvalidInode"}),
        "dir bounds": (damaged(inode("foo") + 16, b"\xff\xff\0\0"), {"InvalidDirectoryBlock"}),
        "layout": (damaged(inode("empty"), struct.pack("<H", 6)), {"InvalidInode"}),
        "reserved": (damaged(foo + 11, b"\1"), {"InvalidDirectoryBlock"}),
        "offset": (damaged(foo + 8, struct.pack("<H", 13)), {"InvalidDirectoryBlock"}),
        "back": (damaged(foo + 12 + 8, struct.pack("<H", 4000)), {"InvalidDirectoryBlock"}),
        "inline": (damaged(inode("foo/bar.txt"), struct.pack("<H", 4)), set()),
    }
    assert first == 12 * 8
    df = spark.createDataFrame([(k, bytearray(v)) for k, (v, _) in cases.items()], "image string, content binary")
    got = {}
    found = materialize(fsck.fsck(df), "violations")
    for r in found.collect():
        got.setdefault(r.image, set()).add(r.code)
    assert "InvalidDirectoryBlock" in got.pop("back")  # its shifted names are at fault too
    assert {k: got.get(k, set()) for k in cases if k != "back"} == {k: v for k, (_, v) in cases.items() if k != "back"}
    assert {r.image for r in fsck.first_error(found).collect()} == {*got, "back"} and fsck.of_code(found, "CycleDetected").where("image = 'cycle'").count() == 1


def test_depth_and_inode_count(spark):
    edges = spark.createDataFrame([("i", k, k + 1) for k in range(6)] + [("i", 0, 100), ("i", 100, 2)], "image string, parent long, child long")
    roots = spark.createDataFrame([("i", 0)], "image string, nid long")
    seen = fsck.reach(edges, roots, 4)
    assert pairs(seen) == [("i", 0, 1), ("i", 1, 2), ("i", 2, 3), ("i", 3, 4), ("i", 4, 5), ("i", 100, 2)]
    declared = spark.createDataFrame([("i", 1)], "image string, inodes long")
    codes = sorted(r.code for r in fsck.walk_faults(edges, seen, declared, 4, 4).collect())
    assert codes == ["InvalidInode", "MaxDepthExceeded"]


def test_directory_scan(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text("hello")
    (tmp_path / "sub" / "b c.txt").write_text("x")
    (tmp_path / "sub" / ".wh.gone").write_text("")
    (tmp_path / "sub" / ".wh..wh..opq").write_text("")
    (tmp_path / "sub" / "deep").mkdir()
    (tmp_path / "sub" / "deep" / "link").symlink_to("../../a.txt")
    want = {("a.txt", "file", 5), ("sub", "dir", 0), ("sub/b c.txt", "file", 1), ("sub/gone", "whiteout", 0), ("sub", "opaque", 0), ("sub/deep", "dir", 0), ("sub/deep/link", "file", 11)}
    for levels in (0, 1, 3):
        got = directory.delta(spark, str(tmp_path), levels).collect()
        assert sorted((r.path, r.kind, r.size) for r in got) == sorted(want)
    digest = {r.path: r.sha256 for r in got if r.kind == "file"}
    plain = {r.path: r.sha256 for r in directory.scan(spark, str(tmp_path)).collect()}
    assert {p: plain[p] for p in ("a.txt", "sub/b c.txt")} == {p: digest[p] for p in ("a.txt", "sub/b c.txt")}
    base = spark.createDataFrame([("sub/gone", "x"), ("sub/old", "y"), ("top", "z")], FILES)
    own = directory.delta(spark, str(tmp_path)).select("path", "kind", "sha256")
    assert {r.path for r in snapshot.commit(base, own, opaque=True).collect()} == {"a.txt", "sub/b c.txt", "sub/deep/link", "top"}


# --- mounts, logs, accesses ---


def test_longest_mount(spark):
    m = spark.createDataFrame([("v",), ("v/sub",), ("v1",)], "mount string")
    a = spark.createDataFrame([("v/sub/x",), ("v/other",), ("v10/x",), ("v/sub",), ("v/subway",)], "path string")
    got = {r.path: (r.mount, r.rel_path) for r in mounts.resolve(a, m).collect()}
    assert got == {"v/sub/x": ("v/sub", "x"), "v/other": ("v", "other"), "v10/x": (None, None), "v/sub": ("v/sub", ""), "v/subway": ("v", "subway")}


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 3), st.sampled_from(["create", "append", "delete", "overwrite", "chmod"])), max_size=60))
def test_oplog_against_model(spark, ops):
    state, marks, n = {}, {}, {}
    for i, (f, op) in enumerate(ops):
        arg = f"[{i}]"
        if op == "create" and f not in state or op == "overwrite" and f in state:
            state[f] = arg
        elif op == "append" and f in state:
            state[f] += arg
        elif op == "delete":
            state.pop(f, None)
        n[f] = n.get(f, 0) + 1
        if n[f] % 5 == 0 and f in state:
            marks[f, n[f]] = state[f]
    rows = [(f, i, i, op, f"[{i}]") for i, (f, op) in enumerate(ops)]
    df = spark.createDataFrame(rows, "file_id long, ts long, event_id long, op string, arg string")
    assert {r.file_id: r.content for r in oplog.final_state(df).collect()} == state
    assert {(r.file_id, r.step): r.content for r in oplog.checkpoints(df, 5).collect()} == marks


def events(spark, n=400):
    rnd = random.Random(6)
    rows = [(i, i, rnd.randrange(4), f"p{rnd.randrange(9)}", access.OPEN_PERM) for i in range(n)]
    df = spark.createDataFrame(rows, "s long, event_id long, pid int, path string, mask long")
    df = df.select(F.timestamp_seconds("s").alias("ts"), "event_id", "pid", "path", "mask")
    pending = spark.createDataFrame([(f"p{i}", f"s{i % 4}") for i in range(7)], FILES)
    return df, pending, spark.createDataFrame([("s0",), ("s1",), ("s2",)], "sha256 string")


def test_access_model(spark):
    df, pending, have = events(spark)
    loaded, want = set(), {}
    for r in df.orderBy("event_id").collect():
        k = int(r.path[1:])
        if r.pid == 2:
            want[r.event_id] = ("self", "allow")
        elif k >= 7:
            want[r.event_id] = ("ready", "allow")
        elif k % 4 == 3:
            want[r.event_id] = ("initiator", "deny")
        else:
            want[r.event_id] = ("loaded" if r.path in loaded else "initiator", "allow")
            loaded.add(r.path)
    got = {r.event_id: (r.role, r.decision) for r in access.decide(df, pending, have, 2).collect()}
    assert got == want
    with pytest.raises(Exception, match="unexpected event mask"):
        access.decide(df.withColumn("mask", F.lit(1).cast("long")), pending, have, 2).collect()


def test_access_stream_equals_batch(spark, tmp_path):
    df, pending, have = events(spark)
    for k in range(3):  # three micro-batches, in the order of time
        df.where((F.col("event_id") >= 150 * k) & (F.col("event_id") < 150 * (k + 1))).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = decide_stream(stream, pending, have, 2).writeStream.format("memory").queryName("verdicts").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    got = pairs(spark.table("verdicts").select("event_id", "path", "role", "decision"))
    assert got == pairs(access.decide(df, pending, have, 2).select("event_id", "path", "role", "decision"))


# --- sinks ---


def test_sinks(spark, tmp_path):
    from snapweave import sinks

    row = lambda s: (__import__("hashlib").sha256(s).hexdigest(), len(s), bytearray(s))
    kind = "sha256 string, size long, content binary"
    store = str(tmp_path / "blobs")
    assert sinks.ingest_blobs(spark.createDataFrame([row(b"a"), row(b"b"), row(b"a")], kind), store).count() == 2
    assert sinks.ingest_blobs(spark.createDataFrame([row(b"b"), row(b"c")], kind), store).count() == 1
    with pytest.raises(Exception, match="does not have digest"):
        sinks.ingest_blobs(spark.createDataFrame([("0" * 64, 1, bytearray(b"x"))], kind), store)
    have = spark.read.parquet(store)
    assert have.count() == 3 and blobs.corrupt(have).count() == 0
    files = have.select(F.concat(F.lit("d/"), F.col("sha256")).alias("path"), "sha256", "size", F.lit(0o640).alias("mode"), F.lit(10**18).alias("mod_time_ns"))
    sinks.commit_snapshot(files, have, str(tmp_path / "m"), "v", 0)
    with pytest.raises(ValueError, match="no blob"):
        sinks.commit_snapshot(files, have.limit(1), str(tmp_path / "m"), "v", 1)
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.commit_snapshot(files, have, str(tmp_path / "m"), "v", 0)
    planned = restore.plan(files.withColumn("size", F.lit(5000).cast("long")), files.limit(0).select("path", "sha256"), 4096)
    out = restore.materialized(planned, have).unionByName(restore.materialized(restore.plan(files, files.limit(0).select("path", "sha256")), have).withColumn("path", F.concat(F.lit("e/"), "sha256")))
    assert sinks.export_files(out, str(tmp_path / "out")).agg(F.sum("bytes")).first()[0] == 3 * 5000 + 3
    made = sorted(p for p in (tmp_path / "out" / "e").iterdir())
    assert sorted(p.read_bytes() for p in made) == [b"a", b"b", b"c"] and made[0].stat().st_mode & 0o777 == 0o640 and made[0].stat().st_mtime_ns == 10**18
    s = spark.createDataFrame([("v", None, ["l"])], "volume_id string, image_sha256 string, layers array<string>")
    none = spark.createDataFrame([], "image string, code string, nid long, message string")
    with pytest.raises(ValueError, match="missing blob"):
        sinks.commit_layers(s, have, str(tmp_path / "s"), none)
    bad = spark.createDataFrame([("v", None, [row(b"a")[0]])], "volume_id string, image_sha256 string, layers array<string>")
    with pytest.raises(ValueError, match="fails check"):
        sinks.commit_layers(bad, have, str(tmp_path / "s"))


# --- messages, publishing, live streams ---


def test_messages(spark):
    from snapweave.sources import messages

    rows = [("v", 1, f"p{i}", 0o644, i, -5 + i * 10**9, f"s{i}") for i in range(25)] + [("w", 2, "é", 2**31, 2**40, 0, "")]
    m = spark.createDataFrame(rows, "volume_id string, version long, path string, mode long, size long, mod_time_ns long, sha256 string")
    pieces = messages.encode(m, 10).cache()
    assert pieces.count() == 4 and pairs(messages.files(pieces.drop("part"))) == sorted(rows)
    joined = {}
    for r in pieces.orderBy("volume_id", "part").collect():  # the pieces of a volume are one message
        joined[r.volume_id] = joined.get(r.volume_id, b"") + bytes(r.content)
    whole = spark.createDataFrame([(k, 1, bytearray(v)) for k, v in joined.items()], "volume_id string, version long, content binary")
    assert messages.files(whole.where("volume_id = 'v'")).count() == 25
    # image digest (field 2) and two layers (field 3), as bytes of the wire format
    head = spark.createDataFrame([("v", bytearray(b"\x12\x02im\x1a\x02l0\x1a\x02l1")), ("e", None)], "volume_id string, content binary")
    assert pairs(messages.heads(head)) == [("e", "", []), ("v", "im", ["l0", "l1"])] and messages.files(head).count() == 0
    with pytest.raises(Exception, match="not a snapshot message"):
        messages.files(spark.createDataFrame([("v", bytearray(b"\x0a\xff"))], "volume_id string, content binary")).collect()


def test_sparse_nids_and_walk_order(spark, built):
    """An image that declares two inodes and has files beyond; the first error is the walk's first."""
    raw = bytearray(bytes(built[2].first().content))
    raw[1028:1032] = b"\0" * 4
    raw[1040:1048] = struct.pack("<Q", 2)
    one = spark.createDataFrame([("i", raw)], "image string, content binary")
    got = fsck.reached(one)
    assert got.count() == 11 and fsck.fsck(one).count() == 0
    assert pairs(source.paths(one, got).select("path", "nid")) == pairs(built[1].select("path", "nid"))
    nodes = {r.path: r for r in image.layout(built[1]).collect()}
    bad = bytearray(bytes(built[2].first().content))
    for p in ("foo/baz/deep.txt", "hello.txt"):
        bad[4096 + 32 * nodes[p].nid + 16 : 4096 + 32 * nodes[p].nid + 20] = b"\xff\xff\0\0"
    df = spark.createDataFrame([("i", bad)], "image string, content binary")
    order = fsck.walk_order(df)
    assert [r.nid for r in order.orderBy("way").collect()] == list(range(11))
    assert fsck.first_error(fsck.fsck(df), order).first().nid == nodes["foo/baz/deep.txt"].nid
    contents = spark.createDataFrame([("i", n.nid, bytearray(b"")) for n in nodes.values() if not n.is_dir], "image string, nid long, content binary")
    assert {r.problem for r in image.compare(built[1], built[2], contents).collect()} == {"other content"}


def test_cycles_against_peeling(spark):
    rnd = random.Random(5)
    for n in (4, 8, 15):
        edges = {(rnd.randrange(n), rnd.randrange(n)) for _ in range(n + n // 3)} | {(100 + i, 101 + i) for i in range(40)} | {(140, rnd.randrange(n)), (rnd.randrange(n), 200)}
        left = set(edges)
        while True:
            now = {(a, b) for a, b in left if a in {y for _, y in left} and b in {x for x, _ in left}}
            if now == left:
                break
            left = now
        got = fsck.cycle_nodes(spark.createDataFrame([("i", *e) for e in edges], "image string, parent long, child long"))
        assert sorted(r.nid for r in got.collect()) == sorted({a for a, _ in left})


def test_pins_claims_and_lengths(spark, tmp_path):
    m = spark.createDataFrame([("v", 1, "a"), ("v", 2, "b")], "volume_id string, version long, path string")
    assert pairs(snapshot.pinned(m, spark.createDataFrame([("v", 1)], "volume_id string, version long"))) == [("v", 1, "a")]
    with pytest.raises(Exception, match="no such version"):
        snapshot.pinned(m, spark.createDataFrame([("v", 3)], "volume_id string, version long")).collect()
    snapshot.append_version(m, str(tmp_path), "v", 5)
    with pytest.raises(FileExistsError, match="version 6"):
        snapshot.append_version(m, str(tmp_path), "v", 5)
    assert pairs(spark.read.parquet(str(tmp_path)).select("volume_id", "version", "path")) == [("v", 6, "a"), ("v", 6, "b")]
    event = spark.createDataFrame([(access.OPEN_PERM, 24)], "mask long, event_len int")
    assert access.checked(event).count() == 1
    with pytest.raises(Exception, match="event of 8 bytes"):
        access.checked(event.withColumn("event_len", F.lit(8))).collect()
    bad = spark.createDataFrame([("i", ["a", "b"], [True], [bytearray(b"")], [1])], "image string, paths array<string>, is_dirs array<boolean>, contents array<binary>, modes array<int>")
    with pytest.raises(Exception, match="arrays of different lengths"):
        tree.from_arrays(bad).collect()
    with pytest.raises(Exception, match="not found"):
        blobs.read(spark.createDataFrame([("ab" * 32,)], "sha256 string"), spark.createDataFrame([], "sha256 string, content binary")).collect()


def test_live_stream_against_model(spark, tmp_path):
    from snapweave.streaming import lazyload as live

    rnd, rows, state, want = random.Random(8), [], {}, {}
    for i in range(600):
        p, kind, pid = f"p{rnd.randrange(7)}", rnd.choice(["open"] * 6 + ["pending", "pending", "done", "evict"]), rnd.randrange(4)
        rows.append((i, i, kind, pid if kind == "open" else None, p, access.OPEN_PERM if kind == "open" else None, f"s{int(p[1:]) % 4}"))
        if kind != "open":
            state[p] = False if kind == "pending" else None
        elif pid == 2:
            want[i] = ("self", "allow")
        elif state.get(p) is None:
            want[i] = ("ready", "allow")
        else:
            have = int(p[1:]) % 4 != 3
            want[i] = ("loaded" if state[p] else "initiator", "allow" if have or state[p] else "deny")
            state[p] = state[p] or have
    df = spark.createDataFrame(rows, "s long, event_id long, kind string, pid int, path string, mask long, sha256 string")
    df = df.select(F.timestamp_seconds("s").alias("ts"), "event_id", "kind", "pid", "path", "mask", "sha256")
    for k in range(3):
        df.where((F.col("event_id") >= 200 * k) & (F.col("event_id") < 200 * (k + 1))).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    have = spark.createDataFrame([("s0",), ("s1",), ("s2",)], "sha256 string")
    q = live.decide_live(stream, have, 2).writeStream.format("memory").queryName("live").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    assert {r.event_id: (r.role, r.decision) for r in spark.table("live").collect()} == want
    kept = [p.stateOperators[0].numRowsTotal for p in q.recentProgress if p.stateOperators]
    assert kept[-1] == sum(v is not None for v in state.values())  # nothing is kept of paths that are done
    control = spark.createDataFrame([(1, "evict", "v")], "event_id long, kind string, volume_id string").withColumn("ts", F.current_timestamp())
    files = spark.createDataFrame([("v", "a", "s"), ("v", "b", "s"), ("v1", "c", "s")], "volume_id string, path string, sha256 string")
    assert sorted(r.path for r in live.expand(control, files).collect()) == ["a", "b"]
