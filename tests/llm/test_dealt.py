"""Joins of near-duplicates make no more rows than there are texts."""

from snapweave.llm import minhash


def _made(spark, df):
    """Rows that the joins of ``df`` make, and its rows."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        own = df.select(*df.columns)
        rows = own.collect()
        made, todo = 0, [own._jdf.queryExecution().executedPlan()]
        while todo:
            node = todo.pop()
            if "Join" in node.nodeName():
                made += node.metrics().apply("numOutputRows").value()
            todo += [node.children().apply(i) for i in range(node.children().size())]
        return made, rows
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_signatures_are_joined_once_a_key(spark):
    keys = [bytes([k]) * 16 for k in range(20)]
    rows = spark.createDataFrame([(b, k, keys[0], 9, 1, 1) for b in range(30) for k in keys], "band long, key binary, comp binary, size long, left int, right int")
    side = spark.createDataFrame([(k, k) for k in keys], "key binary, sig binary")
    made, got = _made(spark, minhash.once_a_key(rows, ["comp", "size"], side))
    want = {(b, k, k) for b in range(30) for k in keys}
    assert {(r.band, bytes(r.key), bytes(r.sig)) for r in got} == want and len(got) == len(want)
    assert made <= len(keys)
