"""What queries send through the driver grows no faster than their input."""

from pyspark.sql import functions as F

from snapweave.operators import fsck, image, tree
from snapweave.plans.durable import materialize
from snapweave.sources import image as source


def _sent(spark, run, node="BroadcastExchange", told=""):
    """Rows of all nodes of plans that are named so while ``run`` is evaluated, and its result."""
    store = spark._jsparkSession.sharedState().statusStore()
    first = store.executionsCount()
    out = run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    rows = 0
    executions = store.executionsList()
    for i in range(int(first), executions.size()):
        at = executions.apply(i).executionId()
        values, nodes = store.executionMetrics(at), store.planGraph(at).allNodes()
        for n in range(nodes.size()):
            if nodes.apply(n).name().startswith(node) and told in nodes.apply(n).desc():
                metrics = nodes.apply(n).metrics()
                for m in range(metrics.size()):
                    value = values.get(metrics.apply(m).accumulatorId())
                    if metrics.apply(m).name() == "number of output rows" and value.isDefined():
                        rows += int(value.get().replace(",", ""))
    return rows, out


def _tree(spark, leaves, chain):
    """A root with leaves, and a chain below it."""
    leaf = [("i", 0, 100_000 + k) for k in range(leaves)]
    return spark.createDataFrame([*leaf, *[("i", k, k + 1) for k in range(chain)]], "image string, parent long, child long")


def test_walks_send_few_rows(spark):
    edges, roots = _tree(spark, 3000, 40), spark.createDataFrame([("i", 0)], "image string, nid long")
    sent, got = _sent(spark, lambda: sorted((r.nid, r.depth) for r in fsck.reach(edges, roots).collect()))
    assert got == [(k, k + 1) for k in range(41)] + [(100_000 + k, 2) for k in range(3000)]
    assert sent <= 2 * 3041


def test_walks_beyond_few_nodes(spark, monkeypatch):
    monkeypatch.setattr(fsck, "FEW", 10)
    edges = _tree(spark, 30, 12).union(spark.createDataFrame([("i", 12, 3), ("i", 100_000, 5), ("i", 9, 100_001)], "image string, parent long, child long"))
    got = sorted((r.nid, r.depth) for r in fsck.reach(edges, spark.createDataFrame([("i", 0)], "image string, nid long")).collect())
    depth = {0: 1, 1: 2, 2: 3, 3: 4, 4: 5, 5: 3, 6: 4, 7: 5, 8: 6, 9: 7, 10: 8, 11: 9, 12: 10}
    assert got == sorted([*depth.items(), *[(100_000 + k, 2) for k in range(30)]])


def test_cycles_send_few_rows(spark):
    edges = _tree(spark, 3000, 40).union(spark.createDataFrame([("i", 40, 38)], "image string, parent long, child long"))
    sent, got = _sent(spark, lambda: sorted(r.nid for r in fsck.cycle_nodes(edges).collect()))
    assert got == [38, 39, 40]
    assert sent <= 3041


def _images(spark, n, files):
    rows = spark.range(n * files).select((F.col("id") % n).cast("string").alias("image"), F.col("id").cast("string").alias("path"), F.lit(False).alias("is_dir"), F.lit(0o644).alias("mode"), F.lit(3).alias("size"))
    nodes = tree.nodes(rows)
    data = nodes.where("NOT is_dir").select("image", "nid", F.lit("abc").cast("binary").alias("content"))
    return materialize(image.build(nodes, data), "images")


def test_checks_read_images_few_times(spark, tmp_path):
    _images(spark, 6, 3).write.parquet(str(tmp_path / "images"))
    images = spark.read.parquet(str(tmp_path / "images"))
    read, found = _sent(spark, lambda: fsck.fsck(images).collect(), "Scan parquet", "content:binary")
    assert found == []
    assert 0 < read <= 3 * 6  # superblocks, inodes, directories


def test_slots_beyond_one_cut(spark):
    images = _images(spark, 1, 140)
    assert [r.nid for r in source.inodes(images).orderBy("nid").collect()] == list(range(141))
    wanted = source.inodes(images).where("nid IN (0, 127, 128, 140)").select("image", "nid")
    some = source.inodes(images).join(wanted, ["image", "nid"]).select("nid", "inode_offset", "size", "raw_blkaddr", "ino")
    at = source.inodes_at(images, wanted).select("nid", "inode_offset", "size", "raw_blkaddr", "ino")
    assert sorted(map(tuple, at.collect())) == sorted(map(tuple, some.collect()))
    assert {r.nid for r in at.where("ino = nid").collect()} == {0, 127, 128, 140}
